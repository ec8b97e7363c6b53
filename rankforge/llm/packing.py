"""Best-fit packing of tokenised documents into fixed-length sequences by bin completion.

The lengths of all pieces are counted; the histogram has at most ``capacity`` rows
at any input size, so the search (``plan``) runs on the driver: branch and bound over
the undominated fillings of one bin after another, each around the longest length
left, with best fit as the first incumbent. Pieces are then numbered within their
length in the cluster and looked up in the bins.

Corner cases: null and empty texts give the single id 1; repeated rows are packed
once for each row; a null doc_id is packed like any other; an empty table gives an
empty result; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import bisect
import os
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from rankforge.llm.workspace import Workspace, releasing

CAPACITY = 4096
END_ID = 1
#: Steps of the search for one filling, and of the whole search; when they are used up, the best found so far is taken.
SEARCH_STEPS, PLAN_STEPS = 20_000, 200_000
#: With more pieces left than these, fillings are first repeated as often as their lengths last; with more than those, that is the only branch.
EXACT_PIECES, WIDE_PIECES = 64, 512
#: States of the search that are remembered, so that none is searched twice.
SEEN_STATES = 100_000
#: Parts into which each length is dealt for numbering, so that a common length is not one task's work.
PARTS = 64
#: Bytes of the texts that are encoded together.
LOT = 8 << 20
#: Words of which a worker keeps the ids.
CACHE_WORDS = 300_000

#: Words whose ids are put together at a time.
GATHER = 100_000
#: Parts words in the encoder's input.
MARK = "|"
LOT_WORDS = 512

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class WordIds(dict):
    """word -> its ids as little-endian 32-bit bytes. The tokenizer never joins what white space parts, so texts can be encoded by word."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.encoder = Tokenizer.from_file(path)
        self.encoder.model._resize_cache(0)  # words come once, so its own cache only costs
        (self.mark,) = self.encoder.encode(MARK, add_special_tokens=False).ids
        self.tails = np.array([self.encoder.encode(f"a{c}", add_special_tokens=False).ids[1] for c in ".,"], "<u4")

    def encode_all(self, words: list[str]) -> list[bytes]:
        """Ids of each word. Words go to the encoder in long texts, parted by a mark that is one token; words that hold the mark go alone."""
        plain = [i for i, w in enumerate(words) if MARK not in w]
        lots = [plain[k : k + LOT_WORDS] for k in range(0, len(plain), LOT_WORDS)]
        out = [b""] * len(words)
        for lot, e in self._encodings(words, lots):
            ids = np.array(e.ids, "<u4")
            ends = np.append(np.flatnonzero(ids == self.mark), len(ids)).tolist()
            begin = 0
            for i, end in zip(lot, ends, strict=True):
                out[i] = ids[begin:end].tobytes()
                begin = end + 1
        alone = [i for i, w in enumerate(words) if MARK in w]
        for i, e in zip(alone, self.encoder.encode_batch([words[i] for i in alone], add_special_tokens=False), strict=True):
            out[i] = np.array(e.ids, "<u4").tobytes()
        return out

    def _encodings(self, words: list[str], lots: list[list[int]]) -> Iterator[tuple[list[int], Any]]:
        """(lot, its encoding), a few lots at a time: an encoding is many times as large as its ids."""
        for k in range(0, len(lots), 32):
            some = lots[k : k + 32]
            yield from zip(some, self.encoder.encode_batch_fast([f" {MARK} ".join(words[i] for i in lot) for lot in some], add_special_tokens=False), strict=True)

    def encode_texts(self, texts: pa.Array, words_kept: int = CACHE_WORDS) -> Iterator[bytes]:
        """Ids of each text; nulls are empty.

        Arrow numbers the words of the texts, and again what is left of the distinct
        ones without case and a last point or comma, neither of which the tokenizer
        joins to a letter. What is new of that is encoded together; ids are gathered by number.
        """
        texts = pc.fill_null(texts, "")
        for c in "\n\t\r":
            texts = pc.replace_substring(texts, pattern=c, replacement=" ")
        lists = pc.split_pattern(texts, pattern=" ")
        ends = lists.offsets.to_numpy()[1:] - lists.offsets[0].as_py()
        coded = lists.flatten().dictionary_encode()
        words, code = coded.dictionary, coded.indices.to_numpy()
        del texts, lists

        tail = np.where(pc.match_substring_regex(words, pattern=r"[A-Za-z]\.$"), 1, np.where(pc.match_substring_regex(words, pattern="[A-Za-z],$"), 2, 0))
        cores = pc.if_else(pa.array(tail > 0), pc.utf8_slice_codeunits(words, 0, -1), words)
        # Only of ASCII is lower case the same before and after normalisation; the mark is part of special tokens.
        plain = pc.and_(pc.string_is_ascii(cores), pc.invert(pc.match_substring(cores, pattern=MARK)))
        cores = pc.if_else(plain, pc.ascii_lower(cores), cores).dictionary_encode()
        keys, core = cores.dictionary.to_pylist(), cores.indices.to_numpy()
        if len(self) > words_kept:
            self.clear()
        new = [w for w in keys if w not in self]
        self.update(zip(new, self.encode_all(new), strict=True))
        known = list(map(self.__getitem__, keys))
        size = np.fromiter(map(len, known), np.int64, len(known)) // 4

        # Ids of each distinct word, then of each word.
        ids, n = gather(np.frombuffer(b"".join(known), "<u4"), size, core, tail > 0)
        ids[np.cumsum(n)[tail > 0] - 1] = self.tails[tail[tail > 0] - 1]
        begin = np.cumsum(n) - n
        del known, words, cores
        first = 0
        while first < len(ends):  # texts of about GATHER words at a time
            word = int(ends[first - 1]) if first else 0
            last = max(first + 1, int(np.searchsorted(ends, word + GATHER, "right")))
            some = code[word : ends[last - 1]]
            out, length = gather(ids, n, some, np.zeros(len(some), bool), begin)
            stop = np.concatenate([[0], np.cumsum(length)])[ends[first:last] - word].tolist()
            for a, b in zip([0, *stop], stop, strict=False):
                yield out[a:b].tobytes()
            first = last


def gather(ids: np.ndarray, size: np.ndarray, at: np.ndarray, more: np.ndarray, begin: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(the runs of ids with these numbers, one after the other, with a free place behind those that have more; their lengths)."""
    begin = (np.cumsum(size) - size if begin is None else begin).astype(np.int32)
    n = size[at].astype(np.int32)
    length = n + more
    start = (np.cumsum(length) - length).astype(np.int32)
    out = np.zeros(int(length.sum()), "<u4")
    inside = np.arange(int(n.sum()), dtype=np.int32)
    inside -= np.repeat((np.cumsum(n) - n).astype(np.int32), n)
    place = np.repeat(start, n)
    place += inside
    inside += np.repeat(begin[at], n)
    out[place] = ids[inside]
    return out, length


@cache
def word_ids(path: str) -> WordIds:
    """One encoder for each worker process; the words are forgotten after each task."""
    return WordIds(path)


def encoded(ids: WordIds, texts: pa.Array, lot: int = LOT, words_kept: int = CACHE_WORDS) -> Iterator[bytes]:
    """Ids of a column's texts, in lots of bounded size."""
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + lot, "right")))
        yield from ids.encode_texts(texts.slice(at, to - at), words_kept)
        at = to


def cut_pieces(tokenizer: str, capacity: int, lot: int = LOT, words_kept: int = CACHE_WORDS):
    from rankforge.llm.packing import word_ids  # by name, so that workers keep one

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = word_ids(tokenizer)
        end = np.array([END_ID], "<u4").tobytes()
        for b in batches:
            rows: list[tuple] = []
            for doc, data in zip(b.column(0).to_pylist(), encoded(ids, b.column(1), lot, words_kept), strict=True):
                data += end
                n = len(data) // 4
                rows += [(doc, k, s, min(capacity, n - s), zlib.crc32(data[4 * s : 4 * (s + capacity)])) for k, s in enumerate(range(0, n, capacity))]
            cols = list(zip(*rows, strict=True)) or [()] * 5
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])
        ids.clear()

    return releasing(run)


Filling = tuple[int, ...]


def best_filling(space: int, asc: list[int], left: dict[int, int], steps: int = SEARCH_STEPS) -> list[int]:
    """The filling of ``space`` with lengths that are left (rising in ``asc``) which wastes least; longest lengths first.

    Branch and bound: the incumbent is best fit (the longest length that fits, again
    and again). A branch adds lengths in falling order, which enumerates each filling
    once; a branch whose lengths cannot beat the incumbent's waste is cut.
    """
    best: list[int] = []
    best_waste = space
    budget = steps
    smallest = asc[0] if asc else space + 1

    # A stack instead of recursion: a bin may hold ``capacity`` pieces, more than Python's frames go deep.
    chosen: list[int] = []
    places: list[int] = []  # of the chosen lengths in asc
    used: dict[int, int] = {}
    room, i, entered = space, -1, True
    while True:
        if entered:
            if room < best_waste:
                best, best_waste = list(chosen), room
            top = min(room, chosen[-1]) if chosen else room
            i = -1 if room < smallest else bisect.bisect_right(asc, top) - 1
            entered = False
        x = asc[i] if i >= 0 else 0
        # Bound: with lengths of at most x, each used as often as it is left, can the room be filled better than the incumbent does?
        if i < 0 or not best_waste or budget <= 0 or (x < room - best_waste + 1 and _reach(asc, i, left, used, room) <= room - best_waste):
            if not chosen:
                return best
            x = chosen.pop()
            used[x] -= 1
            room += x
            i = places.pop() - 1
        elif left[x] > used.get(x, 0):
            budget -= 1
            used[x] = used.get(x, 0) + 1
            chosen.append(x)
            places.append(i)
            room -= x
            entered = True
        else:
            i -= 1


def _reach(asc: list[int], i: int, left: dict[int, int], used: dict[int, int], room: int) -> int:
    """Sum of the lengths left up to asc[i], as far as the room goes."""
    total = 0
    while i >= 0 and total < room:
        total += asc[i] * (left[asc[i]] - used.get(asc[i], 0))
        i -= 1
    return total


def dominated(filling: Filling, waste: int, free: int) -> bool:
    """Whether some pieces of a filling can be exchanged for one longer (or as long) piece that is left, or that piece just added.

    What is taken out goes where the piece that came in was, so the exchange costs no
    bin. free: bit n for each length n that is left besides the filling.
    """
    one, many, mask = 0, 0, (1 << (sum(filling) + 1)) - 1
    for n in filling:  # sums of one piece, and of two or more
        many |= ((one | many) << n) & mask
        one |= 1 << n
    longer, gap = (one << 1) | 2, waste  # a piece for a longer one; a piece added: from a sum of nothing
    if waste:
        spread, width = longer, 1
        while width < gap:  # bit s becomes the bits s to s + waste - 1
            step = min(width, gap - width)
            spread |= spread << step
            width += step
        if spread & free:
            return True
    spread, width = many, 1
    while width < waste + 1:
        step = min(width, waste + 1 - width)
        spread |= spread << step
        width += step
    return bool(spread & free)


def fillings(space: int, asc: list[int], left: dict[int, int], most_waste: int, counter: list[int]) -> list[tuple[int, Filling]]:
    """(waste, filling) of all undominated fillings of ``space`` that waste at most ``most_waste``, least waste first.

    counter[0] is the number of steps that may still be made; the list is not whole if it runs out.
    """
    out = []
    free = sum(1 << n for n in asc if left[n])
    # How far the lengths up to each place can fill a room.
    sums = [0]
    for n in asc:
        sums.append(sums[-1] + n * left[n])
    stack: list[tuple[int, int, Filling]] = [(space, len(asc) - 1, ())]
    while stack and counter[0] > 0:
        counter[0] -= 1
        room, i, chosen = stack.pop()
        i = min(i, bisect.bisect_right(asc, room) - 1)
        if i < 0 or room == 0:
            if room <= most_waste:
                used = Counter(chosen)
                bits = free
                for n, k in used.items():
                    if left[n] == k:
                        bits &= ~(1 << n)
                if not dominated(chosen, room, bits):
                    out.append((room, chosen))
            continue
        if room - sums[i + 1] > most_waste:
            continue
        n = asc[i]
        for k in range(min(left[n], room // n) + 1):
            stack.append((room - n * k, i - 1, chosen + (n,) * k))
    return sorted(out, key=lambda f: (f[0], len(f[1])))


def lower_bound(left: dict[int, int], capacity: int) -> int:
    """A number of bins that no packing can go below: the sum of lengths, and the pieces of which no two share a bin with those that fit beside them."""
    asc = sorted(n for n, c in left.items() if c)
    if not asc:
        return 0
    best = -(-sum(n * left[n] for n in asc) // capacity)
    half = capacity // 2
    big = [n for n in asc if n > half]
    small = [n for n in asc if n <= half]
    total_big = sum(left[n] for n in big)
    best = max(best, total_big)
    # Pieces shorter than k do not count; pieces longer than capacity - k are alone; the rest of the big ones lend their room to k..half.
    held, j = 0, len(big)
    alone = 0
    beside_sum, beside = sum(n * left[n] for n in big), total_big
    tail = sum(n * left[n] for n in small)
    for k in small:
        while j and big[j - 1] > capacity - k:
            j -= 1
            alone += left[big[j]]
            beside_sum -= big[j] * left[big[j]]
            beside -= left[big[j]]
        need = (tail - held) - (beside * capacity - beside_sum)
        best = max(best, alone + beside + max(0, -(-need // capacity)))
        held += k * left[k]
    return best


def best_fit(histogram: dict[int, int], capacity: int) -> list[tuple[int, Filling]]:
    """(repeats, filling): falling lengths, each piece into the fullest bin that has room. Bins that are alike are handled together."""
    bins: dict[int, dict[Filling, int]] = {}  # room -> fillings and their numbers
    rooms: list[int] = []  # rising

    def put(room: int, filling: Filling, k: int) -> None:
        if room not in bins:
            bins[room] = {}
            bisect.insort(rooms, room)
        bins[room][filling] = bins[room].get(filling, 0) + k

    def take(room: int, filling: Filling, k: int) -> None:
        bins[room][filling] -= k
        if not bins[room][filling]:
            del bins[room][filling]
        if not bins[room]:
            del bins[room]
            rooms.remove(room)

    for n in sorted((n for n, c in histogram.items() if c > 0), reverse=True):
        c = histogram[n]
        while c:
            at = bisect.bisect_left(rooms, n)
            # As long as a piece fits, the bin that took the last one stays the fullest.
            if at < len(rooms):
                room = rooms[at]
                filling, held = next(iter(bins[room].items()))
            else:
                room, filling, held = capacity, (), c
            each = min(room // n, c)
            k = min(held, c // each)
            if at < len(rooms):
                take(room, filling, k)
            put(room - each * n, filling + (n,) * each, k)
            c -= k * each
    return [(k, f) for held in bins.values() for f, k in held.items()]


@dataclass
class Plan:
    """bins: (repeats, lengths in one sequence); bound: bins that any packing needs; proved: whether fewer than these are impossible."""

    bins: list[tuple[int, Filling]]
    bound: int
    proved: bool

    @property
    def size(self) -> int:
        return sum(k for k, _ in self.bins)


def plan(histogram: dict[int, int], capacity: int = CAPACITY, steps: int = PLAN_STEPS) -> Plan:
    """A packing of all pieces that the histogram counts, by bin completion.

    The incumbent is best fit. A node of the search takes the longest length left and
    branches over the fillings around it: the one that wastes least first, repeated as
    often as its lengths last while many pieces are left, then every other undominated
    one. A branch is cut when its bins and the lower bound of what is left reach the
    incumbent, so all its bins together may waste only what the incumbent's do, less
    one bin. When ``steps`` run out the incumbent stands, and ``proved`` says so. Never worse than best fit.
    """
    left = {n: c for n, c in histogram.items() if c > 0}
    bound = lower_bound(left, capacity)
    best = best_fit(left, capacity)
    size = sum(k for k, _ in best)
    counter = [steps]
    whole = True  # whether every branch that was not cut has been searched
    seen: dict[tuple, int] = {}
    path: list[tuple[int, Filling]] = []
    asc = sorted(left)
    used, total, pieces = 0, sum(n * c for n, c in left.items()), sum(left.values())

    def change(k: int, filling: Filling) -> None:
        """Takes out k times a filling; puts it back where k is negative."""
        nonlocal used, total, pieces
        used, total, pieces = used + k, total - k * sum(filling), pieces - k * len(filling)
        for n, m in Counter(filling).items():
            if not left[n]:
                bisect.insort(asc, n)
            left[n] -= k * m
            if not left[n]:
                asc.remove(n)

    def branches() -> Iterator[tuple[int, Filling]]:
        nonlocal whole
        x = asc[-1]
        first: Filling | None = None
        if pieces > EXACT_PIECES:
            whole = False  # repeats are not undone one by one
            left[x] -= 1
            first = (x, *best_filling(capacity - x, asc, left))
            left[x] += 1
            yield min(left[n] // k for n, k in Counter(first).items()), first
            if pieces > WIDE_PIECES:
                return
        # Waste that a better packing than the incumbent can still have.
        most = (size - 1 - used) * capacity - total
        left[x] -= 1
        found = fillings(capacity - x, asc[: bisect.bisect_right(asc, capacity - x)], left, most, counter) if most >= 0 else []
        left[x] += 1
        for _, f in found:
            if (x, *f) != first:
                yield 1, (x, *f)

    def worth() -> bool:
        """Whether what is left may still make a better packing than the incumbent."""
        if not pieces or used - (-total // capacity) >= size:
            return False
        if pieces > WIDE_PIECES:
            return True
        state = tuple((n, left[n]) for n in asc)
        if used + lower_bound(left, capacity) >= size or seen.get(state, used + 1) <= used:
            return False
        if len(seen) < SEEN_STATES:
            seen[state] = used
        return True

    stack: list[Iterator[tuple[int, Filling]]] = [branches()] if worth() else []
    while stack and size > bound:
        branch = next(stack[-1], None) if counter[0] > 0 else None
        if branch is None:
            stack.pop()
            if path:
                k, f = path.pop()
                change(-k, f)
            continue
        counter[0] -= 1
        path.append(branch)
        change(*branch)
        if not pieces and used < size:
            best, size = list(path), used
        if worth():
            stack.append(branches())
        else:
            k, f = path.pop()
            change(-k, f)
    return Plan(best, bound, size == bound or (whole and counter[0] > 0))


def runs(bins: list[tuple[int, Filling]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, repeats, offset of the first slot), by length and rank."""
    rows, rank, sequence = [], {}, 0
    for repeats, filling in bins:
        offset = 0
        for n, k in sorted(Counter(filling).items(), reverse=True):
            r = rank.get(n, 0)
            rows.append((n, r, sequence, repeats, offset))
            rank[n] = r + k * repeats
            offset += n * k
        sequence += repeats
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def place(table: np.ndarray):
    """length, rank -> sequence_id, offset, by binary search in the runs."""
    keys = (table[:, 0] << 44) + table[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "rank"))
            r = table[np.searchsorted(keys, (length << 44) + rank, "right") - 1] if len(length) else table[:0]
            k = rank - r[:, 1]
            repeats = np.maximum(r[:, 3], 1)
            yield pa.record_batch(
                [*(b.column(i) for i in range(5)), pa.array(r[:, 2] + k % repeats), pa.array(r[:, 4] + k // repeats * length)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return run


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, lot: int = LOT, words_kept: int = CACHE_WORDS) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    lot (bytes of text encoded together) and words_kept trade a worker's memory for time; the result is the same.
    """
    spark: SparkSession = docs.sparkSession
    work = Workspace(spark, "packing")
    pieces = work.table(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut_pieces(tokenizer, capacity, lot, words_kept), PIECES), "pieces")
    pieces = pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(PARTS)).cast("int"))
    parts = pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("rows"))
    # capacity x PARTS rows at most, whatever the input.
    parts = parts.withColumn("before", F.coalesce(F.sum("rows").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    histogram = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.sum("rows").alias("n")).collect()}
    table = runs(plan(histogram, capacity).bins)
    ranked = pieces.withColumn("at", F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32")))
    ranked = ranked.join(F.broadcast(parts.select("length", "part", "before")), ["length", "part"]).withColumn("rank", F.col("before") + F.col("at") - 1)
    schema = T.StructType([*T._parse_datatype_string(PIECES).fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(place(table), schema)
