"""Substring dedup by prefix-partitioned suffix trees over words.

A window is ``WINDOW`` consecutive words. Words are removed that a window covers
whose words also start earlier (in a document before it, or further left).

Suffixes are taken at anchors only: the smallest hashed ``GRAM``-word prefix among
those that start in a window is the window's anchor, so equal windows have equal
anchors at equal places. Anchor prefixes that occur once cannot repeat; they are
counted and dropped before any text moves. The others partition the suffixes into
groups; each group's trees, to the right of the anchor and, mirrored, to the left,
are built level by level (a node is a run of equal words), and a window repeats if a
node ``WINDOW`` words deep, right and left together, has an earlier leaf.

Groups beyond ``GROUP`` suffixes are dealt into parts first. A part settles all but
the first leaf of each of its deep nodes; what is left goes on with a longer prefix,
the whole window, as key: by then only its first place matters, which is a minimum
that is aggregated before the shuffle. So no group is ever held whole.

A document is an id and a text: rows that share both are one document (each has its
row in the result), different texts under one id are different documents, ordered by
a hash of the text. Corner cases: null and empty texts have no words and the digest of
nothing; shorter texts than a window keep all words; a null doc_id comes before all
others; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankforge.llm.words import BASE, gram_hashes, mix, split_words, word_hashes
from rankforge.llm.workspace import Workspace, identified, once, releasing

WINDOW, GRAM = 20, 6
#: Places in a window where its anchor can be.
PLACES = WINDOW - GRAM + 1
#: Words beyond the anchor's own, on either side, that its windows can reach.
SIDE = WINDOW - GRAM
#: Suffixes of one group.
GROUP = 512
#: Positions of one document that are dealt together, so that no document is one task's work either.
STRETCH = 128
#: Rows whose trees are built at a time.
CHUNK = 20_000
NO_ID = -(1 << 63)
#: Low bits of a sort key that hold a position; texts may have as many words.
AT = np.uint64((1 << 28) - 1)
#: Bytes of a word's hash that a suffix carries: two different words are taken for one with odds of 2**-40, where all else around an equal anchor is equal.
WORD_BYTES = 5


def anchors_of(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(positions, prefix hashes, lowest and highest place in the windows that chose them) for one document's word hashes."""
    grams = gram_hashes(hashes, GRAM)
    if len(grams) < PLACES:
        none = np.empty(0, np.int64)
        return none, np.empty(0, np.uint64), none, none
    m = len(grams) - PLACES + 1
    # Hash and position in one number; the least of PLACES neighbours by doubling, equal hashes go to the left one.
    low = (grams & ~AT) | np.arange(len(grams), dtype=np.uint64)
    width = 1
    while width * 2 <= PLACES:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    pos = (np.minimum(low[:m], low[PLACES - width : PLACES - width + m]) & AT).astype(np.int64)
    edge = np.flatnonzero(np.r_[True, pos[1:] != pos[:-1]])
    last = np.r_[edge[1:], m] - 1
    at = pos[edge]
    return at, grams[at], at - last, at - edge


def anchors(rows: DataFrame) -> DataFrame:
    """key, doc_id, variant, pos of every anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key, pos = [], []
            for t in b.column(2):
                at, k, _, _ = anchors_of(word_hashes(t.as_buffer()))
                key.append(k)
                pos.append(at)
            if key:
                owner = pa.array(np.repeat(np.arange(len(key)), [len(k) for k in key]))
                yield pa.record_batch([pa.array(np.concatenate(key).view(np.int64)), b.column(0).take(owner), b.column(1).take(owner), pa.array(np.concatenate(pos).astype(np.int32))], ["key", "doc_id", "variant", "pos"])

    return rows.mapInArrow(releasing(run), "key long, doc_id long, variant long, pos int")


def packed(rows: DataFrame) -> DataFrame:
    """doc_id, variant and the compressed text, in a third of the bytes that the text would take in a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=1)
        for b in batches:
            yield pa.record_batch([b.column(0), b.column(1), pa.array([z.compress(t.as_buffer() or b"") for t in b.column(2)], pa.binary())], ["doc_id", "variant", "z"])

    return rows.mapInArrow(releasing(run), "doc_id long, variant long, z binary")


def sides_of(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The words on both sides of the anchors at these rising positions, nearest first, as WORD_BYTES each."""
    begin, end = int(at[0]) - SIDE, int(at[-1]) + GRAM + SIDE
    few = hashes[max(begin, 0) : end]
    few = np.ascontiguousarray(few.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :WORD_BYTES]
    padded = np.zeros((end - begin, WORD_BYTES), np.uint8)
    padded[max(-begin, 0) : max(-begin, 0) + len(few)] = few
    near, at = np.arange(SIDE), at - begin
    left, right = padded[(at - 1)[:, None] - near], padded[(at + GRAM)[:, None] + near]
    return np.concatenate([left, right], 1).reshape(len(at), 2 * SIDE * WORD_BYTES)


def contexts(rows: DataFrame) -> DataFrame:
    """From doc_id, variant, z and hits (pos, key, part): one row for each suffix, with the words on both sides of its anchor."""
    schema = "key long, part int, doc_id long, variant long, pos int, low int, high int, sides binary"
    width = 2 * SIDE * WORD_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = zstandard.ZstdDecompressor()
        for b in batches:
            hits, ids, variants = b.column(3), b.column(0).to_numpy(), b.column(1).to_numpy()
            ends, flat = hits.offsets.to_numpy() - hits.offsets[0].as_py(), hits.flatten()
            where, part = (flat.field(c).to_numpy() for c in ("pos", "part"))
            out: list[list[np.ndarray]] = [[] for _ in range(8)]
            held = 0  # suffixes gathered so far
            for i, z in enumerate(b.column(2)):
                h = word_hashes(d.decompress(z.as_buffer()))
                at, keys, low, high = anchors_of(h)
                mine, first = np.unique(where[ends[i] : ends[i + 1]], return_index=True)
                here = np.isin(at, mine)
                at, keys, low, high = at[here], keys[here], low[here], high[here]
                own = part[ends[i] : ends[i + 1]][first][np.isin(mine, at)]
                for s in range(0, len(at), CHUNK):  # a long document's suffixes are many times its text
                    some = slice(s, s + CHUNK)
                    n = len(at[some])
                    for c, v in zip(out, (keys[some].view(np.int64), own[some], np.full(n, ids[i]), np.full(n, variants[i]), at[some], low[some], high[some], sides_of(h, at[some])), strict=True):
                        c.append(v)
                    held += n
                    if held > CHUNK:
                        yield batch(out)
                        out, held = [[] for _ in range(8)], 0
            if held:
                yield batch(out)

    def batch(columns: list[list[np.ndarray]]) -> pa.RecordBatch:
        key, own, doc, variant, at, low, high, sides = (np.concatenate(c) for c in columns)
        offsets = np.arange(len(key) + 1, dtype=np.int32) * width
        binary = pa.Array.from_buffers(pa.binary(), len(key), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(sides))])
        own, at, low, high = (pa.array(x.astype(np.int32)) for x in (own, at, low, high))
        return pa.record_batch([pa.array(key), own, pa.array(doc.astype(np.int64)), pa.array(variant.astype(np.int64)), at, low, high, binary], [x.split()[0] for x in schema.split(", ")])

    return rows.select("doc_id", "variant", "z", "hits").mapInArrow(releasing(run), schema)


def tree_levels(root: np.ndarray, words: np.ndarray) -> list[np.ndarray]:
    """Node of every suffix at each depth: level t splits the nodes of level t-1 by their next word."""
    out, node = [root], root
    for t in range(words.shape[1]):
        order = np.lexsort((words[:, t], node))
        w, n = words[order, t], node[order]
        node = np.empty_like(node)
        node[order] = np.cumsum(np.r_[False, (w[1:] != w[:-1]) | (n[1:] != n[:-1])])
        out.append(node)
    return out


def settle(group: np.ndarray, low: np.ndarray, high: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Bits of the windows (by the anchor's place in them) that have an earlier equal one in the same group. Rows go by document and position."""
    rights, lefts = tree_levels(group, right), tree_levels(group, left)
    bits = np.zeros(len(group), np.int32)
    for o in range(PLACES):
        live = np.flatnonzero((low <= o) & (o <= high))
        if len(live) < 2:
            continue
        r, lft = rights[SIDE - o][live], lefts[o][live]
        order = np.lexsort((live, lft, r))
        same = np.r_[False, (r[order][1:] == r[order][:-1]) & (lft[order][1:] == lft[order][:-1])]
        bits[live[order[same]]] |= 1 << o
    return bits


def window_hash(left: np.ndarray, right: np.ndarray, place: int) -> np.ndarray:
    """Hash of the words of windows around anchors of equal prefixes."""
    h = np.full(len(left), place + 1, np.uint64)
    for words in (left[:, :place], right[:, : SIDE - place]):
        for t in range(words.shape[1]):
            h = h * BASE + words[:, t]
    return mix(h)


def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trees of whole groups, several at a time. Rows: doc_id, variant, pos, bits of removed windows, and, where a group has parts, windows that go on: word key, start."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        rows += b.num_rows
        if rows >= CHUNK:
            table = pa.Table.from_batches(held).combine_chunks()
            key, part = table["key"].to_numpy(), table["part"].to_numpy()
            other = np.flatnonzero((key != key[-1]) | (part != part[-1]))
            cut = int(other[-1]) + 1 if len(other) else 0
            if cut:
                yield from _build(table.slice(0, cut))
                held = table.slice(cut).to_batches()
                rows = table.num_rows - cut
    if rows:
        yield from _build(pa.Table.from_batches(held).combine_chunks())


NAMES = ["doc_id", "variant", "pos", "bits", "more", "start"]


def _build(table: pa.Table) -> Iterator[pa.RecordBatch]:
    key, part, doc, variant, pos, low, high = (table[c].to_numpy() for c in ("key", "part", "doc_id", "variant", "pos", "low", "high"))
    sides = np.zeros((len(key), 2 * SIDE, 8), np.uint8)
    sides[:, :, :WORD_BYTES] = np.frombuffer(b"".join(table["sides"].to_pylist()), np.uint8).reshape(len(key), 2 * SIDE, WORD_BYTES)
    sides = sides.view("<u8")[:, :, 0]
    left, right = sides[:, :SIDE], sides[:, SIDE:]
    group = np.cumsum(np.r_[False, (key[1:] != key[:-1]) | (part[1:] != part[:-1])])
    bits = settle(group, low, high, left, right)
    hit = np.flatnonzero(bits)
    null = lambda n, t: pa.nulls(n, t)
    yield pa.record_batch([pa.array(doc[hit]), pa.array(variant[hit]), pa.array(pos[hit].astype(np.int32)), pa.array(bits[hit]), null(len(hit), pa.int64()), null(len(hit), pa.int32())], NAMES)
    for o in range(PLACES):
        go = np.flatnonzero((part >= 0) & (low <= o) & (o <= high) & ((bits >> o) & 1 == 0))
        if len(go):
            more = window_hash(left[go], right[go], o) ^ mix(key[go].view(np.uint64))
            yield pa.record_batch([pa.array(doc[go]), pa.array(variant[go]), null(len(go), pa.int32()), null(len(go), pa.int32()), pa.array(more.view(np.int64)), pa.array((pos[go] - o).astype(np.int32))], NAMES)


def repeats(rows: DataFrame, work: Workspace) -> DataFrame:
    """Of rows that differ in id or text: doc_id, variant, pos, bits: the windows that start at pos minus each set bit repeat an earlier one."""
    found = work.table(anchors(rows), "anchors")
    # Written apart, so that the join deals both sides anew and can split a common key.
    counts = work.table(found.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "counts")
    hits = found.join(counts, "key")
    stretch = F.xxhash64("doc_id", "variant", F.floor(F.col("pos") / STRETCH))
    part = F.when(F.col("n") > GROUP, F.pmod(stretch, F.ceil(F.col("n") / GROUP)).cast("int")).otherwise(-1)
    hits = work.table(hits.select("doc_id", "variant", "key", "pos", part.alias("part")), "hits")
    work.drop("anchors", "counts")
    per_doc = hits.groupBy("doc_id", "variant").agg(F.collect_list(F.struct("pos", "key", "part")).alias("hits"))
    suffixes = contexts(packed(rows).join(per_doc, ["doc_id", "variant"]))
    dealt = suffixes.repartition("key", "part").sortWithinPartitions("key", "part", "doc_id", "variant", "pos")
    built = work.table(dealt.mapInArrow(releasing(build), "doc_id long, variant long, pos int, bits int, more long, start int"), "built")
    work.drop("hits")
    place = F.struct("doc_id", "variant", "start")
    on = built.where("more is not null").select("more", "doc_id", "variant", "start")
    first = on.groupBy("more").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    later = on.join(first, "more").where(place != F.col("first"))
    one = later.select("doc_id", "variant", F.col("start").alias("pos"), F.lit(1).alias("bits"))
    return built.where("bits is not null").select("doc_id", "variant", "pos", "bits").unionByName(one)


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words left, joined by one blank) and kept_sha256 of every row."""
    work = Workspace(docs.sparkSession, "substrings")
    rows = identified(docs, work).select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), "variant", "text")
    flags = repeats(once(rows), work).groupBy("doc_id", "variant").agg(F.collect_list(F.struct("pos", "bits")).alias("flags"))
    schema = "doc_id long, n_words long, n_removed long, kept string, kept_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = zstandard.ZstdDecompressor()
        for b in batches:
            ids, hits = b.column(0).to_pylist(), b.column(2)
            ends, flat = hits.offsets.to_numpy() - hits.offsets[0].as_py(), hits.flatten()
            pos, bits = (flat.field(c).to_numpy() for c in ("pos", "bits"))
            rows, held = [], 0
            for i, z in enumerate(b.column(1)):
                words = split_words(d.decompress(z.as_buffer()).decode("utf-8", "surrogatepass"))
                n = len(words)
                own = slice(ends[i], ends[i + 1])
                if ends[i + 1] > ends[i]:
                    edge = np.zeros(n + 1, np.int64)
                    for o in range(PLACES):
                        s = pos[own][(bits[own] >> o) & 1 == 1] - o
                        np.add.at(edge, s, 1)
                        np.add.at(edge, s + WINDOW, -1)
                    gone = np.cumsum(edge[:n]) > 0
                    words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                kept = " ".join(words)
                rows.append((None if ids[i] == NO_ID else ids[i], n, n - len(words), kept, hashlib.sha256(kept.encode("utf-8", "surrogatepass")).hexdigest()))
                held += len(kept) + 200
                if held > 4 << 20:
                    yield batch(rows)
                    rows, held = [], 0
            if rows:
                yield batch(rows)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], [x.split()[0] for x in schema.split(", ")])

    return packed(rows).join(flags, ["doc_id", "variant"], "left").select("doc_id", "z", "flags").mapInArrow(releasing(run), schema)
