"""The pipeline's line stage on a leaf of very many lines."""

import hashlib

import corpus_pipeline


def test_other_lines_change_nothing(spark, sf):
    letters = str.maketrans("0123456789", "ghijklmnop")
    word = lambda k, j: hashlib.sha256(f"{k} {j}".encode()).hexdigest()[:6].translate(letters)
    own = lambda k: " ".join(word(k, 100 + j) for j in range(40))
    pair = [(k, f"{own(-k)}\nerror reading file {w} from the main disk of this host") for k, w in ((1, "alpha"), (2, "beta"))]
    others = [(k, "\n".join(f"error reading file {' '.join(word(i, j) for j in range(8))}" for i in range(k * 700, k * 700 + 700))) for k in (3, 4, 5)]
    for rows in (pair, pair + others):
        docs = spark.createDataFrame([(i, t, "en", "web", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
        got = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.line_dedup(spark, docs, sf).collect()}
        assert got[1][0] == pair[0][1] and got[2] == (own(-2), len(own(-2)))
