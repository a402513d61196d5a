"""LM scoring with a hashed maximum-entropy model.

log p(token) = log p(class | context) + log p(token | class, context), the context being the two tokens before it.

Classes: the EXPLICIT most frequent tokens stand in classes of WIDTH by falling count, all others, unknown ones too, in
classes by their last two characters. After an explicit token the class softmax has two features, the token before (a
2-gram) and the one before that (a skip feature), in a table of hashed rows; its weights are trained by gradient steps,
summed over all partitions of all training texts: how often each feature was seen with each class, less how often the
model expected it. After any other token all words are one class.

Tokens: within a class the softmax has an indicator feature for each hashed 2-gram and 3-gram of the training texts, on top
of the tokens' own counts. There are as many as the corpus has, so they are never gathered: tokens are dealt by hashed
context, and the task that gets a context holds its weights, normalises and scores. Features of one length don't overlap,
so one full step of the gradient, seen less discount against expected, settles them: with n sightings of a feature in a
context of m sightings and k features, p' = (n - d) / m + d * k / m * p, which is p * exp(weight) / normaliser. The 2-grams
are settled first, the 3-grams on top of them.

A context that many tokens share is spread by class; pairs of two of the HOT most frequent tokens are counted in a matrix
of fixed size instead, and dealt by the token before them, if that isn't one of these too. So no context in a task has
more rows than a token of lower rank than EXPLICIT, or a class after one, has in the corpus. Counts are exact throughout.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.llm.common import crc_mod, read, settle, text_or_empty

WIDTH, EXPLICIT, TAIL_CLASSES, HOT = 64, 2048, 32, 256
HEAD = 1 << 18
#: Rows of the class table for skipped tokens that are not explicit.
BUCKETS = 1 << 10
ROUNDS, STEP, DAMPING = 2, 0.6, 30.0
#: What is taken off the sightings of 2-grams and 3-grams.
DISCOUNTS = (0.75, 0.75)
#: Tokens that a task deals at once, and that each of the parts they are dealt to holds on average.
DEALT, PART = 1 << 19, 1 << 20
#: Tokens of a part that are weighed at once, on average: a strip of its contexts. Weighing takes some 150 bytes a token.
STRIP = 1 << 17
_CHUNK, _BLOCK = 16_384, 1024
#: Texts, and bytes of them, whose tokens are numbered together.
_ROWS, _BYTES = 1 << 9, 1 << 19
#: Texts that a task deals at once, at most: their numbers have 14 bits. Up to _ROWS more may be under way.
_TEXTS = (1 << 14) - 2 * _ROWS
END = b" "


def tokens_of(text: str) -> list[bytes]:
    """Words of the A-Z-lower-cased text (cut at ASCII white space), and the end."""
    out = text.encode("utf-8", "surrogatepass").lower().split()
    out.append(END)
    return out


def _ending(word: bytes) -> int:
    return zlib.crc32(word.decode("utf-8", "surrogatepass")[-2:].encode("utf-8", "surrogatepass")) % TAIL_CLASSES


def _ending_column(word: str = "word"):
    return (F.crc32(F.right(F.col(word), F.lit(2))) % TAIL_CLASSES).cast("int")


class Lexicon:
    """Head tokens by falling count, and the sums that smoothing needs: of count + 1 over the tokens of each tail class,
    and over those of them outside the head, with their number."""

    def __init__(self, words: list[bytes], counts: list[int], total: int, distinct: int, tail: list[int], rare: list[int], rare_n: list[int]):
        self.words, self.counts = words, np.array(counts, np.int64)
        self.total, self.distinct = total, distinct
        self.tail, self.rare, self.rare_n = (np.array(x, np.float64) for x in (tail, rare, rare_n))
        self.known: pa.Array | None = None

    def ready(self) -> Lexicon:
        if self.known is None:
            self.known = _array(self.words)
            n = len(self.words)
            self.explicit = min(EXPLICIT, n)
            self.hot = min(HOT, self.explicit)
            self.classes = -(-self.explicit // WIDTH)
            own = np.arange(n)
            self.class_of = np.where(own < self.explicit, own // WIDTH, 0)
            self.class_of[self.explicit :] = [self.classes + _ending(w) for w in self.words[self.explicit :]]
            self._smooth()
        return self

    def _smooth(self) -> None:
        """class_log: log share of each class; word_log and rare_log: of tokens of the head, and of any other, in theirs.
        All tokens of a tail class outside the head share alike, with one more for unknown ones."""
        k, e = self.classes, self.explicit
        mass = np.bincount(self.class_of[:e], self.counts[:e], k)
        every = np.concatenate([mass, self.tail + 1])
        self.class_log = np.log(every / every.sum())
        own = np.concatenate([self.counts[:e].astype(float), self.counts[e:] + 1.0])
        self.word_log = np.log(own) - np.log(every)[self.class_of]
        self.rare_log = np.log((self.rare + 1) / (self.rare_n + 1)) - np.log(self.tail + 1)

    @property
    def codes(self) -> dict[bytes, int]:
        """Numbers of the head's tokens."""
        return {w: i for i, w in enumerate(self.words)}

    def __getstate__(self):
        return {**self.__dict__, "known": None}


class Model:
    def __init__(self, lex: Lexicon, buckets: int = BUCKETS):
        lex.ready()
        self.bias = lex.class_log.astype(np.float32)
        self.table = np.zeros((2 * lex.explicit + buckets, len(self.bias)), np.float32)
        self.pairs = np.zeros((lex.hot, lex.hot), np.float64)
        self.pair_log: np.ndarray | None = None

    def learn(self, seen: np.ndarray, expected: np.ndarray, step: float = STEP, damping: float = DAMPING) -> None:
        """One scaled gradient step; features seen rarely move little."""
        often = seen.sum(1, keepdims=True)
        share = np.where(often > 0, expected / np.maximum(often, 1e-9), 1)
        self.table += (step * np.log((seen + damping * share + 1e-9) / (expected + damping * share + 1e-9))).astype(np.float32)

    def settle_pairs(self, lex: Lexicon) -> None:
        """Log probability, within its class, of each hot token after each."""
        h = lex.hot
        own, p = lex.class_of[:h], np.exp(lex.word_log[:h])
        each = np.zeros((h, lex.classes))
        kinds = np.zeros((h, lex.classes))
        np.add.at(each.T, own, self.pairs.T)
        np.add.at(kinds.T, own, (self.pairs > 0).T)
        # hot tokens fill whole classes: HOT is a multiple of WIDTH, or there are no other explicit tokens
        self.pair_log = np.log(_updated(self.pairs, each[:, own], kinds[:, own], np.broadcast_to(p, (h, h)), DISCOUNTS[0]))


def _updated(n: np.ndarray, m: np.ndarray, k: np.ndarray, p: np.ndarray, d: float) -> np.ndarray:
    """Probabilities p after the step that settles one length of features; contexts never seen change nothing."""
    m_ = np.maximum(m, 1)
    return np.where(m > 0, np.maximum(n - d, 0) / m_ + d * k / m_ * p, p)


def _mix(seed: int, *parts: np.ndarray) -> np.ndarray:
    h = np.full(len(parts[0]), seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1, np.uint64)
    for p in parts:
        h = (h ^ p.astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(31)
        h *= np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(29)
    return h


def _array(words: list[bytes]) -> pa.Array:
    return pa.array(words, pa.binary()).view(pa.string())


def _bytes(words: pa.Array) -> list[bytes]:
    ends, data = np.frombuffer(words.buffers()[1], np.int32)[words.offset :][: len(words) + 1].tolist(), words.buffers()[2]
    data = data.to_pybytes() if data else b""
    return [data[a:z] for a, z in zip(ends, ends[1:])]


def _pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of up to _ROWS texts, and of up to _BYTES if they have several."""
    ends = np.cumsum(pc.binary_length(batch.column("text")).to_numpy())
    lo = 0
    while lo < len(ends):
        hi = int(np.searchsorted(ends, _BYTES + (ends[lo - 1] if lo else 0), side="right"))
        hi = min(max(hi, lo + 1), lo + _ROWS)
        yield batch.slice(lo, hi - lo)
        lo = hi


def _cut(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """As `tokens_of`, of many texts: numbers of tokens, each token's place among the distinct ones, and these."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    found = lists.flatten().dictionary_encode()
    sizes, which = pc.list_value_length(lists).to_numpy().astype(np.int64), found.indices.to_numpy()
    blank = pc.index(found.dictionary, pa.scalar("", found.dictionary.type)).as_py()
    if blank >= 0:  # beside white space at a text's ends
        good = which != blank
        sizes = sizes - np.bincount(np.repeat(np.arange(len(sizes)), sizes)[~good], minlength=len(sizes))
        which = which[good]
    ends = np.cumsum(sizes + 1) - 1
    out = np.full(len(which) + len(sizes), len(found.dictionary), np.int64)
    out[np.delete(np.arange(len(out)), ends)] = which
    return sizes + 1, out, pa.concat_arrays([found.dictionary, pa.array([END.decode()], found.dictionary.type)])


class Batch:
    """Codes, contexts and classes of the tokens of many texts."""

    def __init__(self, lex: Lexicon, texts: pa.Array | list[str]):
        if isinstance(texts, list):
            texts = _array([t.encode("utf-8", "surrogatepass") for t in texts])
        self.sizes, self._which, self._words = _cut(texts)
        head = len(lex.words)
        codes = pc.index_in(self._words, value_set=lex.known).fill_null(-1).to_numpy().astype(np.int64)
        other = np.flatnonzero(codes < 0)  # tokens outside the head have hashed numbers after it
        classes = lex.class_of[codes] if head else np.zeros(len(codes), np.int64)
        words = _bytes(self._words.take(pa.array(other)))
        codes[other] = [head + zlib.crc32(w) for w in words]
        classes[other] = [lex.classes + _ending(w) for w in words]
        begin = codes[-1]
        self.head, self.codes, self.classes = head, codes[self._which], classes[self._which]
        start = np.cumsum(self.sizes) - self.sizes
        first = np.zeros(len(self.codes), bool)
        first[start] = True
        self.one = np.append(begin, self.codes[:-1])[: len(self.codes)]
        self.one[first] = begin
        self.two = np.append(begin, self.one[:-1])[: len(self.codes)]
        self.two[first] = begin

    def rare(self) -> pa.Array:
        """Each text's tokens outside the head."""
        at = np.flatnonzero(self.codes >= self.head)
        bounds = np.searchsorted(at, np.append(0, np.cumsum(self.sizes)))
        return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), self._words.take(pa.array(self._which[at])))


def _class_rows(lex: Lexicon, model: Model, one: np.ndarray, two: np.ndarray) -> list[np.ndarray]:
    """Rows of the class table: the token before, and the skipped one's, hashed if it isn't explicit."""
    e = lex.explicit
    other = 2 * e + (_mix(2, two) % np.uint64(len(model.table) - 2 * e)).astype(np.int64)
    return [one, np.where(two < e, e + two, other)]


def _forward(lex: Lexicon, model: Model, b: Batch, divide: bool = False):
    """For each chunk of the tokens after explicit ones: their places, features, classes, class probabilities (only to be
    divided yet, unless divide) and the log probability of their class. Biases are at most 0 and a few damped steps keep
    weights far from where single precision would overflow."""
    after = np.flatnonzero(b.one < lex.explicit)
    for lo in range(0, len(after), _CHUNK):
        at = after[lo : lo + _CHUNK]
        rows, cls = _class_rows(lex, model, b.one[at], b.two[at]), b.classes[at]
        x = model.table.take(rows[0], 0)
        x += model.table.take(rows[1], 0)
        x += model.bias
        raw = x[np.arange(len(x)), cls].astype(np.float64)
        np.exp(x, out=x)
        total = x @ np.ones(x.shape[1], np.float32)
        if divide:
            x /= total[:, None]
        yield at, rows, cls, x, raw - np.log(total)


def _add_rows(table: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
    """table[at] += rows, repeated places adding up; long runs of one place are summed by a product."""
    order = np.argsort(at.astype(np.uint16) if len(table) <= 1 << 16 else at, kind="stable")  # 16 bits are sorted by counting
    rows, at = rows.take(order, 0), at[order]
    start = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    length = np.diff(np.append(start, len(at)))
    long = length > 16
    ones = np.ones(int(length.max()), np.float32)
    for a, n in zip(start[long].tolist(), length[long].tolist()):
        table[at[a]] += ones[:n] @ rows[a : a + n]
    start, length = start[~long], length[~long]
    if len(start):  # short runs side by side: first rows, second rows and so on
        total = rows[start]
        for k in range(1, int(length.max())):
            more = np.flatnonzero(length > k)
            total[more] += rows[start[more] + k]
        table[at[start]] += total


def _gather(lex: Lexicon, model: Model, texts: pa.Array, sums: list[np.ndarray]) -> None:
    """Add to sums: of two, how often each feature was seen with each class, and hot pairs; of one, how often the model
    expects the former."""
    b = Batch(lex, texts)
    if len(sums) == 1:
        for _, rows, _, p, _ in _forward(lex, model, b, divide=True):
            for r in rows:
                _add_rows(sums[0], r, p)
        return
    after = b.one < lex.explicit
    cls = b.classes[after]
    marks = [r * sums[0].shape[1] + cls for r in _class_rows(lex, model, b.one[after], b.two[after])]
    sums[0] += np.bincount(np.concatenate(marks), minlength=sums[0].size).reshape(sums[0].shape)
    both = (b.one < lex.hot) & (b.codes < lex.hot)
    sums[1] += np.bincount(b.one[both] * lex.hot + b.codes[both], minlength=lex.hot**2).reshape(sums[1].shape)


def _count(train: DataFrame) -> DataFrame:
    """(word, c): how often each token occurs; equal tokens are summed batch by batch before they are sent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, which, words = _cut(b.column("text"))
            n = np.bincount(which, minlength=len(words))
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([words.take(pa.array(some)), pa.array(n[some], pa.int64())], ["word", "c"])

    return train.select("text").mapInArrow(run, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def lexicon(counts: DataFrame, head: int = HEAD) -> Lexicon:
    """The head: all tokens with counts from a bound that at most `head` of them reach."""
    size = F.floor(F.log2("c") * 16).cast("int")
    sums = counts.groupBy(size.alias("size")).agg(F.count("*").alias("n"), F.sum("c").alias("c")).collect()
    total, distinct = sum(r.c for r in sums), sum(r.n for r in sums)
    bound, room = None, head
    for r in sorted(sums, key=lambda r: -r.size):
        if r.n > room:
            break
        bound, room = r.size, room - r.n
    rows = [] if bound is None else sorted(((r.word.encode("utf-8", "surrogatepass"), r.c) for r in counts.where(size >= bound).collect()), key=lambda x: (-x[1], x[0]))
    tail, rare, rare_n = np.zeros(TAIL_CLASSES), np.zeros(TAIL_CLASSES), np.zeros(TAIL_CLASSES)
    outside = F.lit(True) if bound is None else size < bound
    for r in counts.groupBy(_ending_column().alias("g")).agg(F.sum(F.col("c") + 1).alias("s"), F.sum(F.when(outside, F.col("c") + 1)).alias("rare"), F.count_if(outside).alias("n")).collect():
        tail[r.g], rare[r.g], rare_n[r.g] = r.s, r.rare or 0, r.n
    for w, c in rows[:EXPLICIT]:
        tail[_ending(w)] -= c + 1
    return Lexicon([w for w, _ in rows], [c for _, c in rows], total, distinct, tail, rare, rare_n)


def train_model(train: DataFrame, lex: Lexicon, lex_sent, rounds: int = ROUNDS, buckets: int = BUCKETS) -> Model:
    """The class model after `rounds` steps, each over all rows (text), and the counts of hot pairs. What is seen is the
    same in all steps and counted in the first, for which the model expects the classes' shares of it."""
    spark = train.sparkSession
    model = Model(lex, buckets)
    sc = spark.sparkContext
    parts = train.rdd.getNumPartitions()
    seen = None
    for k in range(rounds):
        sent = sc.broadcast(model)
        shapes = [model.table.shape, model.pairs.shape] if k == 0 else [model.table.shape]

        def run(batches: Iterator[pa.RecordBatch], sent=sent, shapes=shapes) -> Iterator[pa.RecordBatch]:
            own, now = lex_sent.value.ready(), sent.value
            sums = [np.zeros(s, np.float32) for s in shapes]
            for b in batches:
                for piece in _pieces(b):
                    _gather(own, now, piece.column("text"), sums)
            for i, s in enumerate(sums):
                for lo in range(0, len(s), _BLOCK):
                    part = s[lo : lo + _BLOCK]
                    if part.any():
                        yield pa.RecordBatch.from_arrays([pa.array([i << 32 | lo], pa.int64()), pa.array([part.tobytes()], pa.binary())], ["block", "sums"])

        made = train.select("text").mapInArrow(run, "block long, sums binary")
        salted = _add_up(made.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(max(1, parts // 32)))).repartition("block", "salt"))
        sums = [np.zeros(s) for s in shapes]
        for r in _add_up(salted.repartition("block")).collect():  # no more rows than the tables have blocks
            i, lo = r.block >> 32, r.block & (1 << 32) - 1
            part = np.frombuffer(r.sums, np.float32).reshape(-1, shapes[i][1])
            sums[i][lo : lo + len(part)] = part
        if seen is None:
            seen, model.pairs = sums
            model.learn(seen, seen.sum(1, keepdims=True) * np.exp(lex.ready().class_log))
        else:
            model.learn(seen, sums[0])
    model.settle_pairs(lex.ready())
    return model


def _add_up(parts: DataFrame) -> DataFrame:
    """Sum blocks of equal numbers within each partition, one at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for k, s in zip(b.column("block").to_pylist(), b.column("sums")):
                x = np.frombuffer(s.as_buffer(), np.float32)
                if k in total:
                    total[k] += x
                else:
                    total[k] = x.copy()
        for k, x in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([x.tobytes()], pa.binary())], ["block", "sums"])

    return parts.select("block", "sums").mapInArrow(run, "block long, sums binary")


_FAR = np.uint32(1 << 31)


def _bases(lex: Lexicon, model: Model, word: np.ndarray, skipped: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Log probability of each token before its 2-grams and 3-grams are weighed: within its class after an explicit token,
    else among all words; of hot pairs (skipped is then the hot token before), with the 2-gram weighed."""
    far = word >= _FAR
    code = np.where(far, 0, word)
    cls = np.where(far, lex.classes + (word >> np.uint32(26) & np.uint32(TAIL_CLASSES - 1)), np.append(lex.class_of, 0)[code])
    out = np.append(lex.word_log, 0.0)[code]
    out[far] = lex.rare_log[cls[far] - lex.classes]
    out += np.where(after, 0, lex.class_log[cls])
    hot = skipped < HOT
    out[hot] = model.pair_log[skipped[hot], code[hot]]
    return out


def class_part(lex: Lexicon, model: Model, b: Batch) -> tuple[np.ndarray, ...]:
    """What is known of each token where its text is: the log probability so far; and of those whose 2-grams and 3-grams
    are yet to be weighed: places, hashed context, token, skipped token (HOT or more; less: the hot token before, where
    one length is to be weighed only), and whether it stands after an explicit one. Tokens outside the head are hashed to 26
    bits, beside their class."""
    head = len(lex.words)

    def short(codes: np.ndarray, classes: np.ndarray | int) -> np.ndarray:
        return np.where(codes < head, codes, _FAR | (_mix(7, codes) >> np.uint64(38)).astype(np.uint32) | classes << 26).astype(np.uint32)

    after = b.one < lex.explicit
    known = np.zeros(len(b.codes))
    for at, _, _, _, log in _forward(lex, model, b):
        known[at] = log
    word, skipped = short(b.codes, np.where(b.codes < head, 0, b.classes - lex.classes)), short(b.two, 0) + np.uint32(HOT)
    context = _mix(3, b.one, np.where(after, b.classes + 1, 0))
    hot = (b.one < lex.hot) & (b.codes < lex.hot)
    context[hot] = _mix(5, b.one[hot], b.two[hot], b.classes[hot])
    skipped[hot] = b.one[hot]
    done = hot & (b.two < lex.hot)
    known[done] += _bases(lex, model, word[done], skipped[done], after[done])
    rest = np.flatnonzero(~done)
    return known, rest, context[rest], word[rest], skipped[rest], after[rest]


def weigh(context: np.ndarray, word: np.ndarray, skipped: np.ndarray, base: np.ndarray, train: np.ndarray) -> np.ndarray:
    """Log probability of each token, given all tokens of its context: hashed numbers, log base, and whether it is learned
    from. Settles the 2-grams' weights, then the 3-grams'."""
    p, every, short = np.exp(base), np.arange(len(base)), np.uint64(32)
    two, low = context.astype(np.uint64) << short | word, word & np.uint32((1 << 26) - 1)
    longer = np.flatnonzero(skipped >= HOT)
    three = _mix(6, context[longer], skipped[longer]) >> np.uint64(26) << np.uint64(26) | low[longer]
    for d, at, key, bits in ((DISCOUNTS[0], every, two, 32), (DISCOUNTS[1], longer, three, 26)):
        if not len(at):
            continue
        order = np.argsort(key)
        key = key[order]
        new = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        n = np.add.reduceat(train[at[order]].astype(np.float64), new)
        whose = key[new] >> np.uint64(bits)
        first = np.append(True, whose[1:] != whose[:-1])
        of, first = np.cumsum(first) - 1, np.flatnonzero(first)
        m, k = np.add.reduceat(n, first)[of], np.add.reduceat((n > 0).astype(np.float64), first)[of]
        size = np.diff(np.append(new, len(key)))
        at = at[order]
        p[at] = _updated(np.repeat(n, size), np.repeat(m, size), np.repeat(k, size), p[at], d)
    return np.log(p)


def weigh_strips(lex: Lexicon, model: Model, pieces: list[list[np.ndarray]], strip: int = STRIP) -> list[np.ndarray]:
    """As `weigh`, of a part's pieces (columns as `_dealt` sends them), each sorted by context: strips of contexts one after
    the other, as a context's tokens need no others."""
    logs = [np.empty(len(p[0])) for p in pieces]
    strips = max(1, -(-sum(map(len, logs)) // strip))
    bounds = np.array([(k << 32) // strips for k in range(1, strips)], np.uint32)
    ends = [[0, *np.searchsorted(p[0], bounds).tolist(), len(p[0])] for p in pieces]
    for k in range(strips):
        at = [(e[k], e[k + 1]) for e in ends]
        context, word, skipped, own = (np.concatenate([p[c][a:z] for p, (a, z) in zip(pieces, at)]) for c in range(4))
        log = weigh(context, word, skipped, _bases(lex, model, word, skipped, own & 1), own >> 1 & 1)
        lo = 0
        for out, (a, z) in zip(logs, at):
            out[a:z] = log[lo : lo + z - a]
            lo += z - a
    return logs


def _packed(columns: list[np.ndarray]) -> bytes:
    """Columns of 16-bit and 32-bit numbers by planes of equal bytes, compressed; the first is sorted and sent as steps."""
    columns = [np.diff(columns[0], prepend=columns[0].dtype.type(0)), *columns[1:]]
    planes = [c.view(np.uint8).reshape(len(c), c.itemsize).T.tobytes() for c in columns]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def _opened(data: bytes, kinds: list) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    widths = [np.dtype(k).itemsize for k in kinds]
    n, at, out = len(raw) // sum(widths), 0, []
    for k, w in zip(kinds, widths):
        out.append(np.ascontiguousarray(raw[at : at + n * w].reshape(w, n).T).view(k).ravel())
        at += n * w
    out[0] = np.cumsum(out[0], dtype=kinds[0])
    return out


_TOKENS, _SUMS = [np.uint32, np.uint32, np.uint32, np.uint16], [np.uint16, np.float32]


def _dealt(parts: int, tokens: list) -> Iterator[tuple[int, bytes]]:
    """(part, data) of many batches' tokens: hashed context, token, skipped token, and four times the text's number, plus 2
    if it is learned from, plus 1 after an explicit token."""
    context, word, skipped, own = (np.concatenate(x) for x in zip(*tokens))
    key = (context >> np.uint64(32)) % np.uint64(parts) << np.uint64(32) | context & np.uint64((1 << 32) - 1)
    order = np.argsort(key)
    key = key[order]
    part, columns = (key >> np.uint64(32)).astype(np.int64), [key.astype(np.uint32), word[order], skipped[order], own[order]]
    start = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
    for a, z in zip(start.tolist(), np.append(start[1:], len(part)).tolist()):
        yield int(part[a]), _packed([c[a:z] for c in columns])


def score_texts(docs: DataFrame, buckets: int = BUCKETS, rounds: int = ROUNDS, head: int = HEAD, dealt: int = DEALT, part_tokens: int = PART) -> DataFrame:
    """One row (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row of docs.

    Learned from are the rows with crc32(doc_id) mod 7 other than 2 (a null doc_id counts as the empty string); repeated
    rows count as often as they are there. Null texts count as empty: they have one token, the end. Without training rows
    all tokens are unknown; an empty table gives no rows. Very long texts are whole: their tokens are dealt like all others.
    """
    spark = docs.sparkSession
    slim = docs.select("doc_id", text_or_empty().alias("text"), (crc_mod(F.col("doc_id"), 7) == 2).alias("held_out"))
    train = slim.where(~F.col("held_out")).select("text")
    counts = settle(_count(train))
    lex = lexicon(counts, head)
    lex_sent = spark.sparkContext.broadcast(lex)
    model = train_model(train, lex, lex_sent, rounds, buckets)
    sent = spark.sparkContext.broadcast(model)
    parts = -(-lex.total // part_tokens) + 1
    kind = slim.schema["doc_id"].dataType.simpleString()
    about = f"struct<doc_id {kind}, held_out boolean, n long, known long, base double, log double, rare array<string>>"

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, now = lex_sent.value.ready(), sent.value
        place, turn = TaskContext.get().partitionId(), 0
        texts: list = []
        tokens: list = []

        def deal():
            nonlocal turn, texts, tokens
            group = place << 32 | turn
            rows = list(_dealt(parts, tokens)) if any(len(t[0]) for t in tokens) else []
            whole = pa.concat_tables(texts).combine_chunks()
            doc = pa.StructArray.from_arrays([whole.column(c).chunk(0) for c in whole.column_names], names=whole.column_names)
            turn, texts, tokens = turn + 1, [], []
            lists = pa.ListArray.from_arrays(pa.array([0] * (len(rows) + 1) + [len(doc)], pa.int32()), doc)
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in rows] + [group % parts], pa.int64()), pa.array([group] * (len(rows) + 1), pa.int64()), pa.array([d for _, d in rows] + [None], pa.binary()), lists], ["part", "group", "data", "docs"])

        for b in batches:
            for piece in _pieces(b):
                held = piece.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
                facts = Batch(own, piece.column("text"))
                known, rest, context, word, skipped, after = class_part(own, now, facts)
                counted = facts.codes < len(own.words)
                plus = np.zeros(len(known))
                plus[counted] = np.log10(own.counts[facts.codes[counted]] + 1.0) if len(own.words) else 0.0
                start = np.cumsum(facts.sizes) - facts.sizes
                which = np.repeat(np.arange(len(held)), facts.sizes)
                first = sum(map(len, texts))
                tokens.append((context, word, skipped, (4 * (first + which[rest]) + 2 * ~held[which[rest]] + after).astype(np.uint16)))
                columns = [piece.column("doc_id"), piece.column("held_out"), pa.array(facts.sizes, pa.int64())] + [pa.array(np.add.reduceat(x, start), t) for x, t in ((counted.astype(np.int64), pa.int64()), (plus, pa.float64()), (known, pa.float64()))]
                texts.append(pa.table([*columns, facts.rare()], ["doc_id", "held_out", "n", "known", "base", "log", "rare"]))
                if sum(len(t[0]) for t in tokens) >= dealt or first > _TEXTS:
                    yield from deal()
        if texts:
            yield from deal()

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex, model = lex_sent.value.ready(), sent.value
        now, groups, data = None, [], []

        def done():
            pieces = [_opened(d, _TOKENS) for d in data]
            sums = []
            for (*_, mine), log in zip(pieces, weigh_strips(lex, model, pieces)):
                total = np.bincount(mine >> 2, log)
                some = np.flatnonzero(total)
                sums.append(_packed([some.astype(np.uint16), total[some].astype(np.float32)]))
            yield pa.RecordBatch.from_arrays([pa.array(groups, pa.int64()), pa.array([now] * len(groups), pa.int64()), pa.array(sums, pa.binary()), pa.array([None] * len(groups), pa.list_(batch_kind))], ["group", "part", "data", "docs"])

        for b in batches:
            for p, g, d, i in zip(b.column("part").to_pylist(), b.column("group").to_pylist(), b.column("data"), range(b.num_rows)):
                if not d.is_valid:
                    yield pa.RecordBatch.from_arrays([pa.array([g], pa.int64()), pa.array([-1], pa.int64()), pa.array([None], pa.binary()), b.column("docs").slice(i, 1)], ["group", "part", "data", "docs"])
                    continue
                if p != now and data:
                    yield from done()
                    groups, data = [], []
                now = p
                groups.append(g)
                data.append(d.as_buffer())
        if data:
            yield from done()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        facts, log = None, None

        def done():
            names = ["doc_id", "held_out", "n", "known", "base", "rare"]
            yield pa.RecordBatch.from_arrays([*[facts.field(c) for c in names], pa.array(log / math.log(10), pa.float64())], [*names, "score"])

        for b in batches:
            for i, d in enumerate(b.column("data")):
                if not d.is_valid:  # each group's texts come first, then what its parts have found
                    if facts is not None:
                        yield from done()
                    facts = b.column("docs").slice(i, 1).flatten()
                    log = facts.field("log").to_numpy(zero_copy_only=False).copy()
                    continue
                text, sums = _opened(d.as_py(), _SUMS)
                log[text] += sums
        if facts is not None:
            yield from done()

    from pyspark.sql.pandas.types import to_arrow_type

    sides = f"part long, group long, data binary, docs array<{about}>"
    looked = slim.mapInArrow(look, sides)
    batch_kind = to_arrow_type(looked.schema["docs"].dataType.elementType)
    learned = looked.repartition(parts, "part").sortWithinPartitions("part", "group").mapInArrow(learn, f"group long, part long, data binary, docs array<{about}>")
    merged = learned.repartition("group").sortWithinPartitions("group", "part").mapInArrow(merge, f"doc_id {kind}, held_out boolean, n long, known long, base double, rare array<string>, score double")
    scored = settle(merged.withColumn("row", F.monotonically_increasing_id()))
    rare = scored.select("row", F.explode("rare").alias("word"))  # no word outside the head can be hot
    found = rare.join(counts, "word").select("row", F.log10(F.col("c") + 1).alias("plus"))
    added = found.groupBy("row").agg(F.count("*").alias("more"), F.sum("plus").alias("plus"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    whole = scored.drop("rare").join(added, "row", "left")
    base = F.col("base") + zero("plus") - F.col("n") * math.log10(lex.total + lex.distinct + 1)
    return whole.select("doc_id", "held_out", F.col("n").alias("n_tokens"), (F.col("known") + zero("more")).alias("n_known"), F.lit(lex.total).cast("bigint").alias("train_tokens"), base.alias("base_score"), "score")


def op8_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(read(spark, sf_dir, "documents"))
