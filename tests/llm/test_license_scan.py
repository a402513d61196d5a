import random
import re

from flowloom.llm.license_scan import Scanner, op2_license_scan, scan_licenses
from flowloom.llm.license_templates import TEMPLATES

DOC = "doc_id long, text string, license string, notices int"


def _prose(rnd, n):
    return " ".join(rnd.choice(["alpha", "Beta,", "gamma.", "under", "the", "version", "software", "license"]) for _ in range(n))


def test_every_wording_is_found_in_place(spark):
    rnd = random.Random(8)
    rows, want = [], {}
    for i, (name, wording) in enumerate(TEMPLATES):
        before = _prose(rnd, rnd.randint(0, 80)) + "\n"
        rows.append((i, f"{before}{wording}\n{_prose(rnd, 30)}", "x", 1))
        want[i] = (name, len(before))
    got = {r.doc_id: r.notices for r in scan_licenses(spark.createDataFrame(rows, DOC)).collect()}
    for i, (name, at) in want.items():
        assert any(n.license == name and n.start == at for n in got[i]), (i, name, got[i])


def test_differences_and_repeats():
    mit = next(t for n, t in TEMPLATES if n == "MIT" and len(t) > 500)
    s = Scanner()
    _, (a,) = s.scan("Copyright 2020 me. " + mit.replace("any person", "any human").upper())
    assert a["license"] == "MIT" and 0.98 < a["similarity"] < 1 and a["differences"] == "-person+human"
    assert s.scan("This work is licensed under the GNU General Public License, version 7.")[1] == []
    line = "Released under the MIT License."
    n, found = s.scan("\n".join(["some words"] * 50 + [line] * 3 + ["word"] * 5000 + [line]))
    assert len(found) == 4 and n >= 2
    assert s.scan("no such thing here") == (0, [])


def test_near_misses_hide_no_notice():
    s = Scanner()
    mit = next(t for n, t in TEMPLATES if n == "MIT" and len(t) > 500)
    at = mit.index("The above copyright")
    cut = mit[:at] + mit[mit.index(".", at) + 1 :]
    found = lambda t: [f["license"] for f in s.scan(t)[1]]
    assert found(cut) == [] and found(cut + " SPDX-License-Identifier: Apache-2.0") == ["Apache-2.0"]
    assert found("This work is licensed under the GNU General Public License, version 7. Licensed under CC BY 4.0.") == ["CC-BY-4.0"]
    assert found(cut + " filler" * 20 + " " + mit) == ["MIT"]


def test_long_blocks_are_cut_without_losing_notices():
    s = Scanner()
    parts = ["software " * 900, "Licensed under CC BY-NC 4.0.", "software " * 3000, TEMPLATES[-1][1], "software " * 10]
    assert [f["license"] for f in s.scan(" ".join(parts))[1]] == ["CC-BY-NC-4.0", "Unlicense"]


def test_query_and_odd_rows(spark):
    d = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{d}/documents.parquet").collect()
    short = [(n, re.escape(t)) for n, t in TEMPLATES if len(t) < 90]
    want = {r.doc_id: sorted({n for n, p in short if re.search(p, r.text)}) for r in rows}
    got = {r.doc_id: r.licenses for r in op2_license_scan(spark, d).collect()}
    assert {i for i in want if not set(want[i]) <= set(got[i])} == set() and len(got) == len(rows)
    assert sum(map(bool, got.values())) == sum(map(bool, want.values()))
    odd = spark.createDataFrame([(1, None, None, None), (None, "", "", 0), (1, "License", "", 0)], DOC)
    assert [r.notices for r in scan_licenses(odd).collect()] == [[], [], []] and scan_licenses(odd.limit(0)).count() == 0


def test_long_wordings():
    """Wordings of 600 and 6,000 words, and short notices beside them, are found in long texts."""
    import random

    rnd = random.Random(2)
    body = lambda n: " ".join(["license"] + [f"{rnd.choice('abcdefgh')}{rnd.randint(0, 400)}" for _ in range(n - 1)])
    mid, long = body(600), body(6000)
    from flowloom.llm.license_scan import Scanner

    scanner = Scanner([("Mid", mid), ("Long", long), ("Short", "licensed under the short license")])
    plain = " ".join(f"x{k % 17}" for k in range(400))
    changed = long.split(" ")
    changed[3000:3010] = ["other"] * 10
    _, found = scanner.scan(f"{plain} {mid} {plain} Licensed under the Short License. {plain} {' '.join(changed)} {plain}")
    assert [n["license"] for n in found] == ["Mid", "Short", "Long"] and found[2]["similarity"] > 0.99


def _common(a, b):
    """Longest common subsequence of words."""
    row = [0] * (len(b) + 1)
    for x in a:
        before = row[:]
        for j, y in enumerate(b, 1):
            row[j] = before[j - 1] + 1 if x == y else max(before[j], row[j - 1])
    return row[-1]


def test_every_wording_against_edit_distance():
    """Each long wording with words changed here and there: found if and only if 90 % of its words agree in order, by an
    alignment of its own."""
    import random
    import re

    from flowloom.llm.license_scan import AGREE, SHORT, Scanner
    from flowloom.llm.license_templates import TEMPLATES

    rnd, scanner = random.Random(6), Scanner()
    around = " ".join(f"plain{chr(97 + k % 26)}" for k in range(60))
    for name, text in TEMPLATES:
        words = re.findall(r"\w+", text)
        if len(words) < SHORT:
            assert name in [n["license"] for n in scanner.scan(f"{around} {text} {around}")[1]]
            continue
        for share in (0.0, 0.03, 0.06, 0.16, 0.3):
            changed = [f"zz{i}" if rnd.random() < share else w for i, w in enumerate(words)]
            agree = _common([w.lower() for w in words], [w.lower() for w in changed]) / len(words)
            found = [n["license"] for n in scanner.scan(f"{around} {' '.join(changed)} {around}")[1]]
            if agree >= AGREE + 0.01:
                assert name in found, (name, agree)
            elif agree < AGREE - 0.01:
                assert name not in found, (name, agree)


def test_sixty_notices_in_a_row_are_sixty():
    mit = next(t for n, t in TEMPLATES if n == "MIT" and len(t) > 500)
    text = "\n\n".join([mit] * 60)
    _, found = Scanner().scan(text)
    assert [(f["start"], f["end"]) for f in found] == [(k * (len(mit) + 2), k * (len(mit) + 2) + len(mit) - 1) for k in range(60)]


def test_short_notices_and_spellings():
    s = Scanner()
    for text, want in [
        ("SPDX-License-Identifier: BSD-3-Clause", "BSD-3-Clause"), ("// SPDX-License-Identifier: GPL-2.0-only\n", "GPL-2.0-only"), ("Released under the MIT licence.", "MIT"),
        ("Licensed under Apache 2.0", "Apache-2.0"), ("licensed under CC BY 3.0", "CC-BY-3.0"), ("Licensed under the CC BY-NC-ND 4.0", "CC-BY-NC-ND-4.0"), ("released under GPLv3", "GPL-3.0"),
    ]:
        assert [f["license"] for f in s.scan(f"some words before {text} and after")[1]] == [want], text


def _changed(rnd, words, how):
    """words, of which as many as may be are replaced: evenly, anywhere, or in a row."""
    n, c = len(words), Scanner._changes(len(words))
    at = range(5, n, 10) if how == 0 else rnd.sample(range(n), c) if how == 1 else range(a := rnd.randrange(n - c), a + c)
    out = list(words)
    for i in list(at)[:c]:
        out[i] = "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randint(2, 12)))
    return out


def test_what_a_wording_saves_is_beyond_the_bound():
    """With the most changes that are allowed, alone, within prose, among other wordings and repeated, each long wording saves
    a quarter more than is asked of it; texts without it save less than half of that."""
    from flowloom.llm.license_scan import SHORT, _words

    rnd, s = random.Random(5), Scanner()
    prose = [rnd.choice("seren orita malo vend quist taro belim under the version and of to in software license".split()) for _ in range(6000)]
    pad = lambda n: prose[(a := rnd.randrange(len(prose) - n)) : a + n]
    long = [k for k, w in enumerate(s.words) if len(w) >= SHORT]
    for k in long:
        others = [j for j in long if j != k]
        for how in (0, 1, 2):
            m = _changed(rnd, s.words[k], how)
            for block in (m, pad(300) + m + pad(300), pad(1500) + m + pad(900), m + pad(40) + m + m, sum([s.words[j] for j in rnd.sample(others, 5)], []) + m):
                from collections import Counter

                found = dict((j, saved) for saved, j in s.ranked(block, Counter(block)))
                assert found.get(k, 0) >= 1.25 * s.need[k], (s.names[k], how)
        everywhere = Counter({w: 10**6 for x in s.words for w in x})
        assert k not in dict((j, saved) for saved, j in s.ranked(pad(900), everywhere) if 2 * saved > s.need[j])


def test_compression_decides_what_is_aligned(monkeypatch):
    """All words of a licence, in another order among others, pass the count of words, but save little: nothing is aligned.
    Without savings no long wording is found at all."""
    s = Scanner()
    mit = next(t for n, t in TEMPLATES if n == "MIT" and len(t) > 500)
    words, rnd = re.findall(r"\w+", mit), random.Random(3)
    rnd.shuffle(words)
    apart = " ".join(f"{w} " + " ".join("".join(rnd.choice("abcdefghij") for _ in range(6)) for _ in range(2)) for w in words)
    assert s.scan(apart)[1] == [] and s.alignments == 0
    assert [f["license"] for f in s.scan(mit)[1]] == ["MIT"] and 0 < s.alignments <= 4
    monkeypatch.setattr(Scanner, "ranked", lambda self, words, counts: [])
    assert Scanner().scan(mit)[1] == []


def test_every_wording_keeps_a_cue():
    from flowloom.llm.license_scan import _CUE_WORD, SHORT

    s = Scanner()
    for name, w in zip(s.names, s.words):
        cues = sum(bool(_CUE_WORD.fullmatch(x)) for x in w)
        assert cues > s._changes(len(w)), name
    assert all(len(w) < SHORT or len(w) // 10 >= s._changes(len(w)) for w in s.words)


def test_query_against_brute_force(spark):
    """What a search for all short wordings in all texts of sf0.01 tells is all that is found (no long wording), and each once."""
    from flowloom.llm.license_scan import SHORT, _words

    d = "/root/testdata/sf0.01"
    s = Scanner()
    short = [(n, w) for n, w in zip(s.names, s.words) if len(w) < SHORT]
    want = {}
    for r in spark.read.parquet(f"{d}/documents.parquet").collect():
        words = _words(r.text or "")[1]
        hits = sorted((i, i + len(w), n) for n, w in short for i in range(len(words) - len(w) + 1) if words[i] == w[0] and words[i : i + len(w)] == w)
        want[r.doc_id] = sorted(n for a, z, n in hits if not any((x, y) != (a, z) and x <= a and z <= y for x, y, _ in hits))
    got = {r.doc_id: sorted(n.license for n in r.notices) for r in op2_license_scan(spark, d).collect()}
    assert got == want and sum(map(len, want.values())) > 20
