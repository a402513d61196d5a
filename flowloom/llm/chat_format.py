r"""Chat formatting by columnar byte assembly.

Template, for each turn: `<s>[INST] role\n` text ` [/INST]</s>\n`. The control strings are `<s>`, `</s>`, `[INST]` and
`[/INST]`. In texts a backslash goes in after the first character of each of them; where backslashes stand there
already, one more is added, so that taking one away restores every text. In roles the backslash, newline, `<` and `[`
become `\0` to `\3`. So no control string occurs in formatted text but those that the template puts there. The loss
mask covers the (escaped) texts of assistant turns.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.llm.common import read, text_or_empty

OPEN, CLOSE, END = "<s>[INST] ", "\n", " [/INST]</s>\n"
#: A conversation is cut at turns into parts of about so many bytes; memory is bounded by this and one turn.
PART_BYTES = 8_000_000
_CONTROL = r"([<\[])(\\*)(s>|/s>|INST\]|/INST\])"
_ESCAPED = re.compile(r"([<\[])\\(\\*)(s>|/s>|INST\]|/INST\])")
_TURN = re.compile(re.escape(OPEN) + r"([^\n]*)\n(.*?)" + re.escape(END), re.S)
_ROLE = {"\\": "\\0", "\n": "\\1", "<": "\\2", "[": "\\3"}
_OUT = "part int, n_turns long, formatted string, loss_start array<long>, loss_length array<long>"


def escape(texts: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(texts, pattern=_CONTROL, replacement=r"\1\2\\\3")


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text) if "\\" in text else text


def escape_role(role: str) -> str:
    return "".join(_ROLE.get(c, c) for c in role)


def unescape_role(role: str) -> str:
    return re.sub(r"\\([0-3])", lambda m: "\\\n<["[int(m[1])], role)


def _bytes(a: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (counted from 0) and bytes of a string array without nulls."""
    at = np.frombuffer(a.buffers()[1], np.int32)[a.offset : a.offset + len(a) + 1].astype(np.int64)
    data = np.frombuffer(a.buffers()[2], np.uint8)[at[0] : at[-1]] if a.buffers()[2] is not None and len(a) else np.zeros(0, np.uint8)
    return (at - at[0] if len(at) else np.zeros(1, np.int64)), data


def assemble(roles: pa.Array, texts: pa.Array, first: np.ndarray) -> tuple[pa.Array, list[np.ndarray], list[np.ndarray]]:
    """Format turns whose conversations (or parts) begin at the positions `first`: the formatted strings, and where the
    assistants' texts start in each and how long they are, in code points."""
    n = len(roles)
    codes = roles.dictionary_encode()
    own = codes.dictionary.to_pylist()
    header = pa.array([OPEN + escape_role(r) + CLOSE for r in own], pa.string()).take(codes.indices)
    content = escape(texts)
    pieces = [(*_bytes(header), pc.utf8_length(header)), (*_bytes(content), pc.utf8_length(content))]
    end = np.frombuffer(END.encode(), np.uint8)
    size = np.stack([np.diff(pieces[0][0]), np.diff(pieces[1][0]), np.full(n, len(end))], axis=1)
    start = np.cumsum(size.ravel()) - size.ravel()
    start = start.reshape(n, 3)
    total = int(size.sum())
    buffer = pa.allocate_buffer(total)
    out = np.frombuffer(buffer, np.uint8)
    for k, (at, data, _) in enumerate(pieces):
        out[np.repeat(start[:, k] - at[:-1], size[:, k]) + np.arange(len(data))] = data
    out[(start[:, 2, None] + np.arange(len(end))).ravel()] = np.tile(end, n)
    bounds = np.append(start[first, 0], total)
    formatted = pa.StringArray.from_buffers(len(first), pa.py_buffer(bounds.astype(np.int32)), buffer)
    chars = [p[2].to_numpy(zero_copy_only=False).astype(np.int64) for p in pieces]
    turn_chars = chars[0] + chars[1] + len(END)
    turn_at = np.cumsum(turn_chars) - turn_chars
    part = np.repeat(np.arange(len(first)), np.diff(np.append(first, n)))
    mask = np.array([r == "assistant" for r in own], bool)[codes.indices.to_numpy()] if n else np.zeros(0, bool)
    where = (turn_at - turn_at[first][part] + chars[0])[mask]
    cut = np.searchsorted(part[mask], np.arange(1, len(first)))
    return formatted, np.split(where, cut), np.split(chars[1][mask], cut)


def _parts(ids: list, sizes: np.ndarray, limit: int) -> list[int]:
    """Where parts begin: at each new conversation, and where a part would exceed the limit."""
    out, held = [], 0
    for i, n in enumerate(sizes.tolist()):
        if i == 0 or ids[i] != ids[i - 1] or held + n > limit:
            out.append(i)
            held = 0
        held += n
    return out


def format_conversations(df: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """Rows (conv_id, part, n_turns, formatted, loss_start, loss_length): each conversation's turns in the order of
    turn (then role and text for ties), in one part or, if long, in several numbered ones.

    Null texts and roles are empty; null conversation ids are one conversation, null turns come first; repeated rows
    are repeated turns; an empty table gives no rows. The rows are dealt by conversation and sorted by Spark, which spills; a task holds a batch and
    an unfinished part at most, so that one conversation may have any number of turns.
    """
    slim = df.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), text_or_empty().alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, held, last, number = ["conv_id", "role", "text"], None, (), 0
        for b in _and_end(batches):
            if b is not None:
                t = pa.table([b.column(c) for c in names], names)
                held = t if held is None else pa.concat_tables([held, t])
            if held is None or not held.num_rows:
                continue
            ids = held.column("conv_id").to_pylist()
            sizes = pc.binary_length(held.column("text")).to_numpy().astype(np.int64) + 64
            first = _parts(ids, sizes, part_bytes)
            whole = held.num_rows if b is None else first[-1]  # the last part may go on in the next batch
            if not whole:
                continue
            first = [i for i in first if i < whole]
            # Arrow's string offsets have 31 bits, so parts are assembled in runs of bounded size
            run_at, runs = 0, []
            for k, i in enumerate(first):
                if sizes[first[run_at] : i].sum() > 4 * part_bytes:
                    runs.append((run_at, k))
                    run_at = k
            runs.append((run_at, len(first)))
            for lo, hi in runs:
                a, z = first[lo], first[hi] if hi < len(first) else whole
                rows = held.slice(a, z - a)
                own = np.array(first[lo:hi]) - a
                formatted, starts, lengths = assemble(rows.column("role").combine_chunks(), rows.column("text").combine_chunks(), own)
                numbers = []
                for i in first[lo:hi]:
                    number = number + 1 if last == (ids[i],) else 0
                    last = (ids[i],)
                    numbers.append(number)
                lists = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays([rows.column("conv_id").combine_chunks().take(pa.array(own)), pa.array(numbers, pa.int32()), pa.array(np.diff(np.append(own, z - a)), pa.int64()), formatted, pa.array(starts, lists), pa.array(lengths, lists)], ["conv_id", "part", "n_turns", "formatted", "loss_start", "loss_length"])
            held = held.slice(whole)

    dealt = slim.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").drop("turn")
    return dealt.mapInArrow(run, f"conv_id {slim.schema['conv_id'].dataType.simpleString()}, {_OUT}")


def _and_end(batches: Iterator) -> Iterator:
    yield from batches
    yield None


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts, read back from a formatted part."""
    out, at = [], 0
    for m in _TURN.finditer(formatted):
        if m.start() != at:
            raise ValueError(f"no turn at {at}")
        out.append((unescape_role(m[1]), unescape(m[2])))
        at = m.end()
    if at != len(formatted):
        raise ValueError(f"no turn at {at}")
    return out


def digest_formatted(formatted: DataFrame) -> DataFrame:
    """One row for each conversation, read back from its parts, which must follow each other as
    format_conversations leaves them: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows, kind = None, [], None

        def flush():
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], kind), *[pa.array([r[k] for r in rows], t) for k, t in ((1, pa.int64()), (2, pa.string()), (3, pa.int64()), (4, pa.string()), (5, pa.int64()), (6, pa.int64()))]], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_parts"])

        def done(x):
            return (x[0], x[1], x[2].hexdigest(), x[3], x[4].hexdigest(), x[5], x[6])

        for b in batches:
            kind = b.column("conv_id").type
            for conv, text, starts, lengths in zip(*[b.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_start", "loss_length")]):
                if now is None or now[0] != conv:
                    if now is not None:
                        rows.append(done(now))
                    now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                for role, said in read_turns(text):
                    now[1] += 1
                    now[2].update(f"{role}\n{said}\n".encode())
                for a, n in zip(starts, lengths):
                    said = unescape(text[a : a + n])
                    now[3] += len(said)
                    now[4].update(said.encode())
                now[5] += len(text)
                now[6] += 1
            if len(rows) >= 1000:
                yield flush()
                rows = []
        if now is not None:
            rows.append(done(now))
            yield flush()

    key = formatted.schema["conv_id"].dataType.simpleString()
    return formatted.mapInArrow(run, f"conv_id {key}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_parts long")


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], rows.schema)
    return digest_formatted(format_conversations(rows.unionByName(extra))).drop("n_parts")
