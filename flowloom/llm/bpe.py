"""Byte-pair encoding on numpy arrays: vocabulary, pre-tokens, rank-synchronous merging and tree concatenation.

A vocabulary file of the tokenizers library is read, never trained. Merging relies on the rule that holds for every
vocabulary made by counting pairs: a merge only joins symbols that earlier merges or the byte alphabet made. `Vocabulary`
checks it on loading. From the rule follow both exact shortcuts used here: all occurrences of a sequence's lowest rank
can merge at once, and a token sequence is *the* encoding when all its neighbouring tokens encode to themselves.
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata
from collections.abc import Callable

import numpy as np

_NONE = np.iinfo(np.int64).max
#: Sequences of more symbols are encoded by tree concatenation, in leaves of so many: rounds of merging grow with a leaf, not
#: with the sequence.
LONG, LEAF = 256, 48
#: The largest code point for which Python and the tokenizers library are known to fold and classify alike.
_PLAIN = 0x17F


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> list[str]:
    """The printable letter for each byte in byte-level vocabularies: itself if printable, else the next free one."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    free = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(free)) for b in range(256)]


def _char_class(kind: str) -> str:
    return "".join(f"\\u{c:04x}" for c in range(_PLAIN + 1) if unicodedata.category(chr(c))[0] == kind)


#: The pieces that word-end vocabularies cut from text: contractions, letter runs, single digits, other runs.
_WORD_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_SPACES = "\\t-\\r \\x85\\xa0"


class Vocabulary:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("byte_fallback") or model.get("continuing_subword_prefix"):
            raise ValueError(f"{path}: only byte-level BPE vocabularies are supported")
        vocab: dict[str, int] = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.ignore_merges = bool(model.get("ignore_merges"))
        added = spec.get("added_tokens", [])
        if any(t.get(k) for t in added for k in ("single_word", "lstrip", "rstrip")) or any(t.get("normalized") and spec.get("normalizer") for t in added):
            raise ValueError(f"{path}: added tokens that take blanks with them, stand for whole words or are looked for in normalised text are not supported")
        self.specials = {t["content"]: t["id"] for t in added}
        self._first = re.compile("[" + "".join(re.escape(c) for c in sorted({t[0] for t in self.specials})) + "]").search if self.specials else None
        self._special = re.compile("(" + "|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None
        self.size = 1 + max([*vocab.values(), *self.specials.values()])
        self.token = [""] * self.size
        for t, i in [*vocab.items(), *self.specials.items()]:
            self.token[i] = t
        letters = _byte_letters()
        self.inner = np.array([vocab[c] for c in letters], np.int64)
        self.final = np.array([vocab[c + self.suffix] for c in letters], np.int64)
        self._load_merges(model["merges"], vocab)
        self.decoder = (spec.get("decoder") or {}).get("type")
        self._byte = {c: b for b, c in enumerate(letters)}
        self._library = Tokenizer.from_file(path)
        self._plain = self._plain_splitter(spec)
        self.prefixed = '"add_prefix_space": true' in json.dumps(spec.get("pre_tokenizer"))
        self._expanded: dict[int, np.ndarray] = {int(i): np.array([i]) for i in {*self.inner.tolist(), *self.final.tolist()}}

    def _load_merges(self, merges: list, vocab: dict[str, int]) -> None:
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        born = np.full(self.size, -1, np.int64)
        born[made] = np.arange(len(made))
        if len(np.unique(made)) != len(made) or (np.maximum(born[left], born[right]) >= np.arange(len(made))).any():
            raise ValueError("the merges are not in the order in which their parts were made")
        key = left * self.size + right
        order = np.argsort(key)
        self._keys, self._ranks, self._made = key[order], order.astype(np.int64), made[order]
        self.parts = {int(m): (int(a), int(b)) for m, a, b in zip(made, left, right)}

    # ---- pre-tokens -------------------------------------------------------------------------------------------

    def _plain_splitter(self, spec: dict):
        """A regular expression for texts of plain code points, if the file's rules are those of word-end vocabularies."""
        norm = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        pre = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        if norm != ["NFC", "Replace", "Lowercase"] or not pre or pre[0].get("pattern") != {"Regex": _WORD_SPLIT}:
            return None
        letters, digits = _char_class("L"), _char_class("N")
        find = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{digits}]|[^{_SPACES}{letters}{digits}]+").findall
        return find, re.compile(f"[^\\x00-\\u{_PLAIN:04x}]").search

    def sections(self, text: str) -> list:
        """The text cut at special strings, these as their ids."""
        if self._special is None or self._first(text) is None or not self._special.search(text):
            return [text]
        return [self.specials[part] if k % 2 else part for k, part in enumerate(self._special.split(text)) if k % 2 or part]

    def pieces(self, text: str) -> list:
        """Pre-tokens as text in order; a special token appears as its id."""
        out: list = []
        for part in self.sections(text):
            if part.__class__ is int:
                out.append(part)
            else:
                text, cut = self.normal(part)
                out += cut(text)
        return out

    def normal(self, text: str) -> tuple[str, Callable[[str], list[str]]]:
        """The normalised text, and how it and parts of it are cut into pre-tokens. These are parts of it, in order."""
        if self._plain is not None:
            find, odd = self._plain
            if odd(text) is None:
                return text.lower(), find
        lib = self._library
        return text if lib.normalizer is None else lib.normalizer.normalize_str(text), self._library_cut

    def _library_cut(self, text: str) -> list[str]:
        byte = self._byte
        return [bytes(map(byte.__getitem__, w)).decode("utf-8", "surrogateescape") for w, _ in self._library.pre_tokenizer.pre_tokenize_str(text)]

    def symbols(self, piece: str) -> np.ndarray:
        raw = np.frombuffer(piece.encode("utf-8", "surrogateescape"), np.uint8)
        out = self.inner[raw]
        if len(out):
            out[-1] = self.final[raw[-1]]
        return out

    def ragged(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Alphabet symbols of many non-empty words in one array, and how many each has."""
        raw = [w.encode("utf-8", "surrogateescape") for w in words]
        lengths = np.array(list(map(len, raw)), np.int64)
        data = np.frombuffer(b"".join(raw), np.uint8)
        out, last = self.inner[data], np.cumsum(lengths) - 1
        out[last] = self.final[data[last]]
        return out, lengths

    # ---- merging ----------------------------------------------------------------------------------------------

    def merge(self, sequences: list[np.ndarray]) -> list[np.ndarray]:
        """Token ids of each sequence of symbols."""
        if not sequences:
            return []
        flat, counts = self.merge_ragged(np.concatenate(sequences), np.array([len(s) for s in sequences]))
        return np.split(flat, np.cumsum(counts)[:-1])

    def merge_ragged(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge many sequences held in one array: each round applies every sequence's lowest-rank pair at once."""
        owner = np.repeat(np.arange(len(lengths)), lengths)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbols):
            key = symbols[:-1] * self.size + symbols[1:]
            at = np.searchsorted(self._keys, key)
            at[at == len(self._keys)] = 0
            rank = np.where((self._keys[at] == key) & (owner[:-1] == owner[1:]), self._ranks[at], _NONE)
            rank, at = np.append(rank, _NONE), np.append(at, 0)
            start = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            lowest = np.repeat(np.minimum.reduceat(rank, start), np.diff(np.append(start, len(symbols))))
            over = lowest == _NONE
            if over.any():
                done.append((owner[over], symbols[over]))
                go = ~over
                symbols, owner, rank, at, lowest = symbols[go], owner[go], rank[go], at[go], lowest[go]
                if not len(symbols):
                    break
            hit = rank == lowest
            place = np.arange(len(hit))
            first = np.maximum.accumulate(np.where(hit & ~np.append(False, hit[:-1]), place, 0))
            hit &= (place - first) % 2 == 0  # in a run such as "aaa" the leftmost pair goes first
            symbols = np.where(hit, self._made[at], symbols)
            keep = np.ones(len(symbols), bool)
            keep[np.flatnonzero(hit) + 1] = False
            symbols, owner = symbols[keep], owner[keep]
        if not done:
            return np.zeros(0, np.int64), np.zeros(len(lengths), np.int64)
        who, what = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(who, kind="stable")
        return what[order], np.bincount(who, minlength=len(lengths))

    # ---- tree concatenation -----------------------------------------------------------------------------------

    def expand(self, token: int) -> np.ndarray:
        """The alphabet symbols of a token."""
        found = self._expanded.get(token)
        if found is None:
            a, b = self.parts[token]
            found = self._expanded[token] = np.concatenate([self.expand(a), self.expand(b)])
        return found

    def encode_by_tree(self, symbols: np.ndarray, leaf: int = LEAF) -> np.ndarray:
        """Encode one long sequence: leaves side by side, then pairs of halves, level by level."""
        level = self.merge([symbols[i : i + leaf] for i in range(0, len(symbols), leaf)])
        while len(level) > 1:
            joined = self.join_halves(level[0 : len(level) - 1 : 2], level[1::2])
            level = joined + level[len(level) - len(level) % 2 :]
        return level[0]

    def join_halves(self, left: list[np.ndarray], right: list[np.ndarray], window: int = 8) -> list[np.ndarray]:
        """Encodings of left + right. Around each join a window is encoded anew; it grows until its outermost token
        on either side is the one that was there before, so that nothing further away can differ."""
        out: list = [None] * len(left)
        open_, k = list(range(len(left))), window
        while open_:
            fresh = self.merge([np.concatenate([self.expand(t) for t in [*left[i][-k:].tolist(), *right[i][:k].tolist()]]) for i in open_])
            again = []
            for i, mid in zip(open_, fresh):
                a, b = left[i], right[i]
                if (k >= len(a) or mid[0] == a[-k]) and (k >= len(b) or mid[-1] == b[k - 1]):
                    out[i] = np.concatenate([a[: max(0, len(a) - k)], mid, b[k:]])
                else:
                    again.append(i)
            open_, k = again, 2 * k
        return out

    # ---- decoding ---------------------------------------------------------------------------------------------

    def decode(self, ids) -> str:
        """As the library's decode with special tokens kept: without a decoder, tokens are joined by blanks."""
        if self.decoder is None:
            return " ".join(map(self.token.__getitem__, ids))
        special, out, run = set(self.specials.values()), [], []
        for i in ids:
            if i in special:
                out += [self._text(run), self.token[i]]
                run = []
            else:
                run.append(self.token[i])
        return "".join([*out, self._text(run)])

    def _text(self, tokens: list[str]) -> str:
        return bytes(self._byte[c] for c in "".join(tokens)).decode("utf-8", "replace")


@functools.lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    """One per worker process."""
    return Vocabulary(path)
