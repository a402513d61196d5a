"""License scans by conditional compression.

Around words that licences use, candidate blocks are cut from a text. Windows of a block are compressed by themselves and with each
wording as a raw zstandard dictionary. A wording that saves less than a share LEAST_SAVED of its own compressed size isn't there with few
enough changes (measured by a test) and is passed over; the others are ranked by the bytes that they save and aligned word by
word, in that order, until no later one can win. The longest that agrees wins. Short notices must agree in all words and are
looked for as they are. Where blocks overlap, notices are settled over the whole text.
"""

from __future__ import annotations

import bisect
import math
import re
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.llm.common import read, text_or_empty
from flowloom.llm.license_templates import TEMPLATES

#: Words around which blocks are cut: each wording has more of them than may be changed, and so keeps one.
_CUES = r"licen[sc]\w*|mozilla|mpl|copyright\w*|permission\w*|permit\w*|redistribut\w*|warrant\w*|spdx|domain|liab\w+|software|notice|granted|provided|implied|merchantability|fitness|damages|gnu|conditions|released|distribute|modify|unencumbered"
_CUE = re.compile(rf"\b(?:{_CUES})\b", re.I)
_CUE_WORD = re.compile(_CUES, re.I)
#: Spellings that count as one.
_SAME = {"licence": "license", "licences": "licenses", "licenced": "licensed"}
_WORD = re.compile(r"licen[sc]\w*|mozilla|mpl|copyright\w*|permission\w*|permit\w*|redistribut\w*|warrant\w*|spdx|domain|liab\w+|software", re.I)
_WORD = re.compile(r"\w+")
_GAP, _PAD, _CHUNK = 40, 40, 1200
#: Wordings of fewer words must agree in all of them; longer ones in this share.
SHORT, AGREE = 24, 0.9
#: A wording that is in a window saves more than this share of its own compressed size, one of LONG words or more the second:
#: unrelated texts save a few hundredths, its own words in another order up to 0.42 (0.27 below LONG words).
LEAST_SAVED, LONG = (0.3, 0.45), 64


def _words(text: str) -> tuple[list[tuple[int, int]], list[str]]:
    """Spans of a text's words, and the words in lower case and one spelling."""
    spans = [m.span() for m in _WORD.finditer(text)]
    return spans, [_SAME.get(w := text[a:z].lower(), w) for a, z in spans]


def _bytes(words: list[str]) -> bytes:
    return " ".join(words).encode("utf-8", "surrogatepass")


class Scanner:
    def __init__(self, templates: list[tuple[str, str]] = TEMPLATES):
        self.names = [n for n, _ in templates]
        self.words = [_words(t)[1] for _, t in templates]
        self.counts = [Counter(w) for w in self.words]
        self.plain = zstandard.ZstdCompressor(level=3)
        self.given = [zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(" ".join(w).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)) for w in self.words]
        self.need = [LEAST_SAVED[len(w) >= LONG] * len(self.plain.compress(_bytes(w))) for w in self.words]
        self.longest = max(map(len, self.words))
        self.pad = max(_PAD, *map(self._without_cue, self.words))
        # windows of at least twice a wording's length, of few sizes, so that a window is compressed by itself only once
        self.sizes: dict[int, list[int]] = {}
        for k, w in enumerate(self.words):
            if len(w) >= SHORT:
                self.sizes.setdefault(max(256, 1 << (2 * len(w)).bit_length()), []).append(k)
        self.alignments = 0

    @staticmethod
    def _changes(n: int) -> int:
        """How many words of a wording of n may differ."""
        return n - math.ceil(AGREE * n) if n >= SHORT else 0

    @classmethod
    def _without_cue(cls, words: list[str]) -> int:
        """The longest stretch of a wording that may be left without a cue word, so that blocks around these hold all of it."""
        at, c = [-1, *[i for i, w in enumerate(words) if _CUE_WORD.fullmatch(w)], len(words)], cls._changes(len(words))
        return max(at[min(len(at) - 1, i + 1 + c)] - at[i] for i in range(len(at) - 1))

    def blocks(self, words: list[str]) -> list[tuple[int, int]]:
        """Word ranges around groups of cue words; longer ones are cut with overlaps that hold any wording."""
        out: list[list[int]] = []
        for i, w in enumerate(words):
            if _CUE_WORD.fullmatch(w):
                if out and i - self.pad <= out[-1][1] + _GAP:
                    out[-1][1] = min(len(words), i + 1 + self.pad)
                else:
                    out.append([max(0, i - self.pad), min(len(words), i + 1 + self.pad)])
        size = max(_CHUNK, 4 * self.longest)  # so that a step is never shorter than the longest wording
        step = size - 2 * self.longest
        return [(lo, min(z, lo + size)) for a, z in out for lo in range(a, max(a + 1, z - 2 * self.longest), step)]

    def ranked(self, words: list[str], counts: Counter) -> list[tuple[int, int]]:
        """(bytes saved, wording), best first, for the long wordings that save enough in a window. Each place that one could
        take lies in a window as a whole. Wordings of which the block has too few words aren't tried."""
        found: dict[int, int] = {}
        for size, own in self.sizes.items():
            own = [k for k in own if sum((self.counts[k] & counts).values()) >= AGREE * len(self.words[k])]
            if own:
                step = size - math.ceil(max(len(self.words[k]) for k in own) / AGREE)
                for lo in range(0, max(1, len(words) - size + step), step):
                    data = _bytes(words[lo : lo + size])
                    alone = len(self.plain.compress(data))
                    for k in own:
                        found[k] = max(found.get(k, 0), alone - len(self.given[k].compress(data)))
        return sorted(((saved, k) for k, saved in found.items() if saved >= self.need[k]), key=lambda x: (-x[0], x[1]))

    def place(self, k: int, words: list[str], counts: Counter) -> tuple[float, int, int, str] | None:
        """As align, if wording k is there with few enough differences. Regions that are refused are split around."""
        own = self.words[k]
        n = len(own)
        if n < SHORT:
            at = next((i for i in range(len(words) - n + 1) if words[i] == own[0] and words[i : i + n] == own), None) if self.counts[k] <= counts else None
            return None if at is None else (1.0, at, at + n, "")
        open_ = [(0, len(words))]
        while open_:
            lo, hi = open_.pop()
            have = counts if hi - lo == len(words) else Counter(words[lo:hi])
            if sum((self.counts[k] & have).values()) < AGREE * n:  # more words than these cannot agree
                continue
            if found := self.align(k, words[lo:hi]):
                share, a, z, diff = found
                if share >= AGREE:
                    return share, lo + a, lo + z, diff
                open_ += [(lo + z, hi), (lo, lo + a)]
        return None

    def align(self, k: int, words: list[str]) -> tuple[float, int, int, str] | None:
        """(similarity, first word, one past the last, differences) of the best place for wording k."""
        own = self.words[k]
        self.alignments += 1
        best = None
        matcher = SequenceMatcher(None, own, words, autojunk=False)
        for at in sorted({m.b - m.a for m in matcher.get_matching_blocks() if m.size}):
            lo, hi = max(0, at), min(len(words), at + len(own) + len(own) // 10)
            m = SequenceMatcher(None, own, words[lo:hi], autojunk=False)
            met = [x for x in m.get_matching_blocks() if x.size]
            if not met:
                continue
            a, z = lo + met[0].b, lo + met[-1].b + met[-1].size
            share = sum(x.size for x in met) / max(len(own), z - a)
            if best is None or share > best[0]:
                changes = [f"-{' '.join(own[i1:i2])}+{' '.join(words[lo + j1 : lo + j2])}" for op, i1, i2, j1, j2 in m.get_opcodes() if op != "equal" and (i1 != i2 or met[0].b < j1 < met[-1].b)]
                best = (share, a, z, "; ".join(changes))
        return best

    def search(self, words: list[str]) -> list[tuple]:
        """(wording, first word, one past the last, similarity, saved, differences), apart from each other."""
        out, open_ = [], [(0, len(words))]
        while open_:
            lo, hi = open_.pop()
            part = words[lo:hi]
            if not any(_CUE_WORD.fullmatch(w) for w in part):
                continue
            winner = None
            counts = Counter(part)
            short = [k for k, w in enumerate(self.words) if len(w) < SHORT and self.counts[k] <= counts]
            tried = [*self.ranked(part, counts), *((0, k) for k in sorted(short, key=lambda k: -len(self.words[k])))]
            spans = [len(self.words[k]) if len(self.words[k]) < SHORT else int(len(self.words[k]) / AGREE) for _, k in tried]
            for i, (saved, k) in enumerate(tried):
                if winner and max(spans[i:]) < winner[2] - winner[1]:
                    break  # none of the others can be as long
                found = self.place(k, part, counts)
                if found and (winner is None or (found[2] - found[1], found[0]) > (winner[2] - winner[1], winner[3])):
                    winner = (k, found[1], found[2], found[0], saved or self._saved(k, part), found[3])
            if winner:
                k, a, z, *rest = winner
                out.append((k, lo + a, lo + z, *rest))
                open_ += [(lo, lo + a), (lo + z, hi)]
        return out

    def _saved(self, k: int, words: list[str]) -> int:
        data = _bytes(words)
        return len(self.plain.compress(data)) - len(self.given[k].compress(data))

    def scan(self, text: str) -> tuple[int, list[dict]]:
        """Blocks, and notices in order with offsets in code points. Of notices that overlap, found in two blocks, the
        longest stays, then the one that agrees better, then the first."""
        if not _CUE.search(text):
            return 0, []
        spans, words = _words(text)
        blocks = self.blocks(words)
        found = {}
        for lo, hi in blocks:
            for k, a, z, *rest in self.search(words[lo:hi]):
                found.setdefault((lo + a, lo + z), (k, *rest))
        kept: list[tuple[int, int]] = []
        for a, z in sorted(found, key=lambda x: (x[0] - x[1], -found[x][1], x[0])):
            i = bisect.bisect(kept, (a, z))
            if (i == 0 or kept[i - 1][1] <= a) and (i == len(kept) or kept[i][0] >= z):
                kept.insert(i, (a, z))
        out = []
        for a, z in kept:
            k, share, saved, diff = found[a, z]
            out.append({"license": self.names[k], "start": spans[a][0], "end": spans[z - 1][1], "similarity": share, "saved": saved, "differences": diff})
        return len(blocks), out


def scan_licenses(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """One row (doc_id, n_blocks, notices array<struct>) for each row of docs; null and empty texts have none.

    Texts of any length are scanned whole, in blocks that overlap by two of the longest wording; an empty table gives no rows.
    Of wordings that agree with one place, the longest wins, then the one that agrees better, then the one that saves more
    bytes, then the first. A wording of any length will do, if it holds one of the cue words. A notice has its licence, code point offsets, share of agreeing words, bytes saved by its wording as dictionary, and
    what words differ. Repeated notices are all reported. No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates)
        kind = pa.list_(pa.struct([("license", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("similarity", pa.float64()), ("saved", pa.int64()), ("differences", pa.string())]))
        for b in batches:
            n, found = zip(*map(scanner.scan, b.column("text").to_pylist())) if b.num_rows else ((), ())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(found, kind)], ["doc_id", "n_blocks", "notices"])

    slim = docs.select("doc_id", text_or_empty().alias("text"))
    return slim.mapInArrow(run, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, n_blocks long, notices array<struct<license string, start long, end long, similarity double, saved long, differences string>>")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_blocks", F.size("notices").cast("bigint").alias("n_notices"), F.array_sort(F.array_distinct(F.col("notices.license"))).alias("licenses"), "notices")
