"""Chat formatting by columnar byte assembly.

A turn becomes ``[INST]role[/INST]text</s>``, a conversation starts with ``<s>``.
In roles and texts, a backslash goes before every backslash and control string, so
the format can be read back (``parse``). The bytes of all conversations of a batch
are put together at once: segment lengths, cumulative offsets and scatter indices
are numpy arrays, and headers and contents are copied into one preallocated buffer,
which becomes the values of an Arrow column without another copy.

Corner cases: null roles and texts count as empty; turns with equal numbers go by
role and text, null turns first; rows with a null conv_id form one conversation;
repeated rows are turns of their own; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankforge.llm.workspace import bounded_batches

#: Control strings of the format (fixed values).
BEGIN, HEAD, BODY, END = "<s>", "[INST]", "[/INST]", "</s>"
CONTROL = r"(\\|<s>|</s>|\[INST\]|\[/INST\])"
TOKEN = re.compile(r"\\(\\|<s>|</s>|\[INST\]|\[/INST\])|(<s>|</s>|\[INST\]|\[/INST\])|([^\\<\[]+|.)", re.S)
LOSS_ROLE = "assistant"
#: Bytes for which scatter indices, 8 bytes each, are made at a time.
SCATTER = 1 << 20

COLUMNS = "conv_id long, formatted string, n_turns long, loss_spans array<struct<start:long,end:long>>"


def escape(column: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(pc.fill_null(column, ""), pattern=CONTROL, replacement=r"\\\1")


def unescape(text: str) -> str:
    return re.sub(r"\\" + CONTROL, r"\1", text)


def scatter(out: np.ndarray, at: np.ndarray, column: pa.Array) -> None:
    """Copies the strings of a column to the given offsets of a buffer; indices are made for SCATTER bytes at a time."""
    off = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4).astype(np.int64)
    n = np.diff(off)
    if not n.sum():
        return
    data = np.frombuffer(column.buffers()[2], np.uint8)
    for i in np.flatnonzero(n > SCATTER).tolist():
        out[at[i] : at[i] + n[i]] = data[off[i] : off[i + 1]]
    n = np.where(n > SCATTER, 0, n)
    cuts = np.searchsorted(np.cumsum(n), np.arange(SCATTER, n.sum(), SCATTER), "right")
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(n)], strict=True):
        m = n[a:b]
        inside = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
        out[np.repeat(at[a:b], m) + inside] = data[np.repeat(off[a:b], m) + inside]


def assemble(conv: np.ndarray, roles: pa.Array, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Formats turns that are ordered by conversation (conv: 0, 0, 1, ...).

    Returns the strings, the number of turns of each, and for each turn the first and
    last byte of its text, counted from the start of its conversation's string.
    """
    parts = [pa.array(np.where(np.r_[True, conv[1:] != conv[:-1]], BEGIN + HEAD, HEAD).tolist(), pa.string()), escape(roles), pa.array([BODY] * len(conv), pa.string()), escape(texts), pa.array([END] * len(conv), pa.string())]
    lengths = np.stack([pc.binary_length(p).to_numpy(zero_copy_only=False).astype(np.int64) for p in parts], 1)
    ends = np.cumsum(lengths.ravel()).reshape(lengths.shape)
    starts = ends - lengths
    out = np.empty(int(ends[-1, -1]), np.uint8)
    for i, p in enumerate(parts):
        scatter(out, starts[:, i], p)
    first = np.flatnonzero(np.r_[True, conv[1:] != conv[:-1]])
    offsets = np.r_[starts[first, 0], ends[-1, -1]]
    strings = pa.Array.from_buffers(pa.large_string(), len(first), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(out)])
    begin = offsets[np.cumsum(np.r_[True, conv[1:] != conv[:-1]]) - 1]
    return strings, np.diff(np.r_[first, len(conv)]), starts[:, 3] - begin, ends[:, 3] - begin


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted conversation."""
    turns, field, role = [], [], ""
    for m in TOKEN.finditer(formatted):
        if m[2] is None:
            field.append(m[1] or m[3])
            continue
        if m[2] == BODY:
            role = "".join(field)
        elif m[2] == END:
            turns.append((role, "".join(field)))
        field = []
    return turns


def whole_conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by conv_id, in tables that never part a conversation."""
    rest: list[pa.RecordBatch] = []
    rest_id = None
    for b in batches:
        if not b.num_rows:
            continue
        ids = b.column(0).fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
        other = np.flatnonzero(ids != ids[-1])
        last = int(other[-1]) + 1 if len(other) else 0  # where the batch's last conversation starts
        if last:
            yield pa.Table.from_batches([*rest, b.slice(0, last)])
            rest = []
        elif rest and rest_id != ids[0]:
            yield pa.Table.from_batches(rest)
            rest = []
        rest.append(b.slice(last))
        rest_id = ids[-1]
    if rest:
        yield pa.Table.from_batches(rest)


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in whole_conversations(batches):
        t = table.combine_chunks()
        ids = t["conv_id"].combine_chunks()
        key = ids.fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
        conv = np.cumsum(np.r_[False, key[1:] != key[:-1]])
        roles, texts = (pc.cast(t[c].combine_chunks(), pa.string()) for c in ("role", "text"))
        strings, n, lo, hi = assemble(conv, roles, texts)
        loss = pc.fill_null(pc.equal(roles, LOSS_ROLE), False).to_numpy(zero_copy_only=False)
        spans = pa.StructArray.from_arrays([pa.array(lo[loss]), pa.array(hi[loss])], ["start", "end"])
        per = np.bincount(conv[loss], minlength=len(n))
        spans = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(per)].astype(np.int32)), spans)
        first = np.r_[0, np.cumsum(n)[:-1]]
        yield pa.record_batch([ids.take(pa.array(first)), pc.cast(strings, pa.string()), pa.array(n.astype(np.int64)), spans], ["conv_id", "formatted", "n_turns", "loss_spans"])


def format_chats(turns: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, formatted, n_turns and loss_spans, the byte spans of the assistant texts in ``formatted``.

    A conversation is one string, so it is the unit of work: rows go to tasks by
    conv_id, and a task holds one batch of rows and one conversation at a time.
    """
    bounded_batches(turns.sparkSession)
    turns = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    dealt = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.select("conv_id", "role", "text").mapInArrow(_format, COLUMNS)


def digests(chats: DataFrame) -> DataFrame:
    """What can be read back from the formatted strings and their loss spans."""
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for conv, text, spans in zip(*(b.column(i).to_pylist() for i in (0, 1, 3)), strict=True):
                turns = parse(text)
                data = text.encode()
                loss = "".join(unescape(data[s["start"] : s["end"]].decode()) for s in spans)
                sha = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
                rows.append((conv, len(turns), sha, len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            cols = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return chats.select("conv_id", "formatted", "n_turns", "loss_spans").mapInArrow(run, schema)
