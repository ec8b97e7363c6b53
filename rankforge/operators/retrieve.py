"""Full-catalogue retrievers: the top n unseen items of each user, in long form (user_idx, item_idx, score, rank)."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rankforge.operators import scorers
from rankforge.operators.ranking import by_user, dense_index, exclude, last_item, positions, recent
from rankforge.operators.trainers import settled

#: Quantiles by which a global order is dealt.
MARKS = 64
#: Bytes up to which lists of items by kind go to all tasks.
KIND_BYTES = 16 << 20


def best(scores: DataFrame, seen: DataFrame, n: int, high_id: bool = False) -> DataFrame:
    tie = F.desc("item_idx") if high_id else F.col("item_idx")
    ranked = exclude(scores, seen).withColumn("rank", F.row_number().over(by_user().orderBy(F.desc("score"), tie)))
    return ranked.where(F.col("rank") <= n).select("user_idx", "item_idx", "score", "rank")


#: Users that share one copy of the edges that they need, tried from the largest on, and the edges that a task may hold for them.
SHARING, HELD = (16_384, 8192, 4096, 2048, 512, 128), 6_000_000
#: Edges that are summed at a time.
SUMMED = 1 << 20


def planes(x: np.ndarray) -> bytes:
    """All first bytes of the numbers, then all second ones, and so on."""
    return x.view(np.uint8).reshape(len(x), -1).T.tobytes()


def unplanes(x: bytes, n: int, kind: type) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(-1, n).T).view(kind).ravel()


def short_lists(lists: DataFrame) -> DataFrame:
    """item_idx, size, to, v, wide, kinds: lists (item_idx, to, v) in a few bytes for each edge, for a shuffle; nothing is lost.

    Targets are steps between sorted ids. Values of nine digits are whole billionths, others
    (``wide``) stay doubles; where few differ, these come first (``kinds``), then a byte for each edge.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ends = np.cumsum(b.column("to").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
            every, values = b.column("to").flatten().to_numpy(), b.column("v").flatten().to_numpy()
            to, v, wide, kinds = [], [], [], []
            for lo, hi in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                order = np.argsort(every[lo:hi], kind="stable")
                x, y = every[lo:hi][order], values[lo:hi][order]
                some, code = np.unique(y, return_inverse=True)
                few = len(some) <= min(256, len(y) // 4)
                y = some if few else y
                whole = np.rint(y * 1e9)
                wide.append(not ((np.abs(whole) < 1 << 31) & (whole / 1e9 == y)).all())
                kinds.append(len(some) if few else 0)
                to.append(zlib.compress(planes(np.diff(x, prepend=0)), 1))
                v.append(zlib.compress(planes(y if wide[-1] else whole.astype(np.int32)) + (code.astype(np.uint8).tobytes() if few else b""), 1))
            size = np.diff(ends, prepend=0).astype(np.int32)
            yield pa.record_batch([b.column("item_idx"), pa.array(size), pa.array(to, pa.binary()), pa.array(v, pa.binary()), pa.array(wide, pa.bool_()), pa.array(kinds, pa.int32())], ["item_idx", "size", "to", "v", "wide", "kinds"])

    return lists.where(F.size("to") > 0).select(F.col("item_idx").cast("long"), "to", "v").mapInArrow(run, "item_idx long, size int, to binary, v binary, wide boolean, kinds int")


def long_lists(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(targets, values) of all lists of ``short_lists``."""
    to, v = [], []
    for n, x, y, wide, kinds in zip(*(table[c].to_pylist() for c in ("size", "to", "v", "wide", "kinds")), strict=True):
        to.append(np.cumsum(unplanes(zlib.decompress(x), n, np.int64)))
        y, m = zlib.decompress(y), kinds or n
        width = 8 if wide else 4
        some = unplanes(y[: m * width], m, np.float64) if wide else unplanes(y[: m * width], m, np.int32) / 1e9
        v.append(some[np.frombuffer(y[m * width :], np.uint8)] if kinds else some)
    return np.concatenate(to), np.concatenate(v)


def best_of_edges(history: DataFrame, edges: DataFrame, source: str, target: str, value: str, seen: DataFrame, n: int, high_id: bool = False) -> DataFrame:
    """``best`` of ``scorers.expand``, where edges are written tables, as rows or as arrays of targets and values by source: the products of histories and edges, far more than both, do not move.

    Users with neighbouring ids share one copy of each edge that any of them needs, so
    what moves is no more than the products, and much less if they have items in common.
    """
    low, high, count = history.agg(F.min("user_idx"), F.max("user_idx"), F.count_distinct("user_idx")).first()
    if dict(edges.dtypes)[value].startswith("array"):
        packed = edges.select(F.col(source).alias("item_idx"), F.col(target).alias("to"), F.col(value).alias("v"))
    else:
        packed = edges.groupBy(F.col(source).alias("item_idx")).agg(F.collect_list(F.struct(F.col(target).cast("long").alias("to"), F.col(value).cast("double").alias("v"))).alias("e"))
        packed = packed.select("item_idx", F.col("e.to").alias("to"), F.col("e.v").alias("v"))
    degree = (packed.agg(F.sum(F.size("to"))).first()[0] or 0) / max(1, history.select("item_idx").distinct().count())
    for users in SHARING:
        batch = F.floor((F.col("user_idx") - F.lit(low or 0)) / F.lit(max(1, users * ((high or 0) - (low or 0) + 1) // max(1, count))))
        most = history.select(batch.alias("b"), "item_idx").distinct().groupBy("b").count().agg(F.max("count")).first()[0] or 0
        if most * degree <= HELD:
            break
    rows = history.select("user_idx", "item_idx", F.col("w").cast("double").alias("w"))
    rows = rows.unionByName(seen.join(history.select("user_idx").distinct(), "user_idx", "left_semi").select("user_idx", "item_idx", F.lit(None).cast("double").alias("w")))
    rows = rows.select(batch.alias("batch"), "user_idx", "item_idx", "w")
    packed = short_lists(packed)
    packed = rows.where("w is not null").select("batch", "item_idx").distinct().join(packed, "item_idx").select(F.col("batch").alias("part"), F.col("item_idx").alias("held"), "size", "wide", "kinds", "to", "v")
    digits, summed, unpack = scorers.DIGITS, SUMMED, long_lists  # workers need not import the scorers

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            left, right = left.combine_chunks(), right.combine_chunks()
            held = right["held"].to_numpy()
            size, order = right["size"].to_numpy().astype(np.int64), np.argsort(held)
            begin, held = (np.cumsum(size) - size)[order], held[order]
            size = size[order]
            to, v = unpack(right)
            names = np.unique(to)
            # Places among the names, a part at a time, in half the bytes.
            to, m = np.concatenate([np.searchsorted(names, to[x : x + summed]).astype(np.int32) for x in range(0, len(to), summed)]), len(names)
            user, item, w = (left[c].to_numpy() for c in ("user_idx", "item_idx", "w"))
            by = np.argsort(user, kind="stable")
            user, item, w = user[by], item[by], w[by]
            known = np.isnan(w)
            at = np.minimum(np.searchsorted(held, item), len(held) - 1)
            make = np.where(~known & (held[at] == item), size[at], 0)
            # Whole users, as many as make about ``summed`` products.
            first = np.flatnonzero(np.r_[True, user[1:] != user[:-1]])
            end = np.append(first[1:], len(user))
            done = np.append(0, np.cumsum(make))[end]
            a = 0
            while a < len(first):
                z = max(a + 1, int(np.searchsorted(done, (done[a - 1] if a else 0) + summed, "right")))
                part = slice(first[a], end[z - 1])
                own = np.searchsorted(user[first[a:z]], user[part])
                k, p, old = make[part], at[part], known[part]
                index = np.repeat(begin[p] - (np.cumsum(k) - k), k) + np.arange(int(k.sum()))
                keys, where = np.unique(np.repeat(own, k) * m + to[index], return_inverse=True)
                score = np.round(np.bincount(where, np.repeat(w[part], k) * v[index], len(keys)), digits)
                # What a user has seen goes; then each user's n best, ties by item.
                gone = np.minimum(np.searchsorted(names, item[part][old]), m - 1)
                gone = (own[old] * m + gone)[names[gone] == item[part][old]]
                stays = ~np.isin(keys, gone)
                keys, score = keys[stays], score[stays]
                who = keys // m
                edge = np.searchsorted(who, np.arange(z - a + 1))
                for u in range(z - a):
                    s = score[edge[u] : edge[u + 1]]
                    if len(s):
                        near = np.flatnonzero(s >= np.partition(s, len(s) - n)[len(s) - n]) if len(s) > n else np.arange(len(s))
                        near = near[::-1] if high_id else near
                        near = near[np.argsort(-s[near], kind="stable")[:n]]
                        out.append((np.full(len(near), user[first[a + u]], np.int64), names[keys[edge[u] + near] - u * m], s[near], np.arange(1, len(near) + 1, dtype=np.int32)))
                a = z
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.empty(0, t) for t in (np.int64, np.int64, np.float64, np.int32)]
        return pa.table(dict(zip(("user_idx", "item_idx", "score", "rank"), columns, strict=True)))

    return rows.groupBy("batch").cogroup(packed.groupBy("part")).applyInArrow(run, "user_idx long, item_idx long, score double, rank int")


def global_order(counts: DataFrame) -> DataFrame:
    """item_idx, score, place: the catalogue by falling score, ties by item, without sorting it in one task.

    Items are numbered within ranges between quantiles of the score (at most MARKS
    numbers reach the driver); a score that is a quantile itself is a range of its own,
    dealt by item, as many items may share it.
    """
    marks = sorted(set(counts.approxQuantile("score", [i / MARKS for i in range(MARKS + 1)], 0.25 / MARKS)))
    level = sum((((F.col("score") < m).cast("int") + (F.col("score") <= m).cast("int")) for m in marks), F.lit(0))
    low, high = counts.agg(F.min("item_idx"), F.max("item_idx")).first()
    slice_ = F.floor((F.col("item_idx") - F.lit(low or 0)) / F.lit(((high or 0) - (low or 0)) // MARKS + 1))
    bucket = level * (MARKS + 1) + F.when(F.col("score").isin(marks), slice_).otherwise(0) if marks else F.lit(0)
    return positions(counts, bucket, [F.desc("score"), F.col("item_idx")], "place").select("item_idx", "score", "place")


#: Places of an order that go to all tasks as one array.
HEAD = 4096


def by_global_order(order: DataFrame, users: DataFrame, seen: DataFrame, n: int) -> DataFrame:
    """The first n unseen items of one order for all users: a user needs no more than its first n + |seen| places.

    The head of the order goes to where the users are, so that only users and what they
    have seen move. Users who need more places than HEAD walk through the order by a join.
    """
    mine = seen.groupBy("user_idx").agg(F.collect_set("item_idx").alias("mine"))
    known = users.select("user_idx").distinct().join(mine, "user_idx", "left").withColumn("need", F.lit(n) + F.coalesce(F.size("mine"), F.lit(0)))
    most = known.agg(F.max("need")).first()[0] or 0
    first = order.where(F.col("place") <= min(most, HEAD))
    head = first.agg(F.array_sort(F.collect_list(F.struct("place", "item_idx"))).alias("head")).select(F.col("head.item_idx").alias("head"))
    left = F.array_except(F.slice("head", F.lit(1), F.col("need")), F.coalesce("mine", F.array().cast("array<long>")))
    rows = known.where(F.col("need") <= HEAD).join(F.broadcast(head)).select("user_idx", F.posexplode(F.slice(left, 1, n)).alias("at", "item_idx"))
    out = rows.join(F.broadcast(first.select("item_idx", "score")), "item_idx").select("user_idx", "item_idx", "score", (F.col("at") + 1).alias("rank"))
    if most <= HEAD:
        return out
    places = known.where(F.col("need") > HEAD).select("user_idx", F.explode(F.sequence(F.lit(1), "need")).alias("place"))
    rows = exclude(places.join(order, "place"), seen).withColumn("rank", F.row_number().over(by_user().orderBy("place")))
    return out.unionByName(rows.where(F.col("rank") <= n).select("user_idx", "item_idx", "score", "rank"))


def popularity(users: DataFrame, train: DataFrame, items: DataFrame, seen: DataFrame, n: int) -> DataFrame:
    counts = train.groupBy("item_idx").agg(F.count(F.lit(1)).alias("c"))
    counts = items.select("item_idx").join(counts, "item_idx", "left").select("item_idx", F.coalesce("c", F.lit(0)).cast("double").alias("score"))
    return by_global_order(global_order(counts), users, seen, n)


def recency(users: DataFrame, train: DataFrame, items: DataFrame, seen: DataFrame, n: int, share: float = 0.1) -> DataFrame:
    """Popularity in which an interaction's weight decays with its age, over ``share`` of the time span."""
    span = train.agg(F.max("ts").alias("last"), F.greatest(F.max("ts") - F.min("ts"), F.lit(1.0)).alias("span"))
    decay = F.exp(-(F.col("last") - F.col("ts")) / (share * F.col("span")))
    scores = train.join(F.broadcast(span)).groupBy("item_idx").agg(F.round(F.sum(decay), scorers.DIGITS).alias("s"))
    scores = items.select("item_idx").join(scores, "item_idx", "left").select("item_idx", F.coalesce("s", F.lit(0.0)).alias("score"))
    return by_global_order(global_order(scores), users, seen, n)


def itemknn(users: DataFrame, train: DataFrame, seen: DataFrame, n: int, k: int = 100, edges: DataFrame | None = None) -> DataFrame:
    edges = settled(scorers.neighbours(train, k)) if edges is None else edges
    history = settled(scorers.weights(train).join(users.select("user_idx").distinct(), "user_idx", "left_semi"))
    return best_of_edges(history, edges, "item_i", "to" if "to" in edges.columns else "item_j", "sim", seen, n)


def markov(users: DataFrame, train: DataFrame, seen: DataFrame, n: int) -> DataFrame:
    last = last_item(train).join(users.select("user_idx").distinct(), "user_idx", "left_semi").select("user_idx", F.col("last_item").alias("item_idx"), F.lit(1.0).alias("w"))
    return best(scorers.expand(last, scorers.markov_edges(train), "item_from", "item_to", "p"), seen, n)


def tfidf(users: DataFrame, train: DataFrame, items: DataFrame, seen: DataFrame, n: int, window: int = 10) -> DataFrame:
    """Exact top n by the product of the profile of the last ``window`` items and an item's vector, if it is positive.

    Items with one text are met as one. The products, which are as many as users times
    items where terms are frequent, are summed where users and texts meet.
    """
    kinds = settled(items.select("item_idx", F.min("item_idx").over(Window.partitionBy("text")).alias("kind")))
    vectors = settled(scorers.tfidf_vectors(items).join(scorers.large(kinds.where("item_idx = kind").select("item_idx")), "item_idx", "left_semi"))
    history = recent(train, window).join(scorers.large(users.select("user_idx").distinct()), "user_idx", "left_semi").select("user_idx", "item_idx")
    history = history.join(scorers.large(kinds), "item_idx").select("user_idx", F.col("kind").alias("item_idx"))
    at = settled(dense_index(vectors, "term", "at"))
    row = lambda df, key, a, b: df.join(at, "term").groupBy(key).agg(F.collect_list(F.struct("at", "x")).alias("e")).select(key, F.col("e.at").alias(a), F.col("e.x").alias(b))
    sized = kinds.groupBy(F.col("kind").alias("item_idx")).agg(F.count(F.lit(1)).alias("size"))
    held = row(vectors, "item_idx", "t", "v").join(scorers.large(sized), "item_idx")
    mine = seen.groupBy("user_idx").agg(F.collect_set("item_idx").alias("mine"))
    wanted = row(scorers.tfidf_profiles(vectors, history), "user_idx", "t", "u")
    near = sparse_top(settled(wanted), settled(held), n, mine.select("user_idx", F.size("mine").cast("long").alias("had")))
    return of_kinds(near, kinds, mine, n)


def cooccurrence(train: DataFrame, window: int = 50, least: int = 2) -> DataFrame:
    """item_a, item_b, n (both ways): items that meet in the last ``window`` rows of at least ``least`` users."""
    rows = recent(train, window).select("user_idx", "item_idx").distinct()
    a, b = rows.withColumnRenamed("item_idx", "item_a"), rows.withColumnRenamed("item_idx", "item_b")
    half = a.join(b, "user_idx").where("item_a < item_b").groupBy("item_a", "item_b").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return half.select(F.explode(F.array(F.struct("item_a", "item_b", "n"), F.struct(F.col("item_b").alias("item_a"), F.col("item_a").alias("item_b"), "n"))).alias("e")).select("e.*")


def graph_expansion(users: DataFrame, train: DataFrame, edges: DataFrame, seen: DataFrame, n: int, window: int = 50) -> DataFrame:
    """Sum of edges (item_a, item_b, n) from a user's recent items; ties by the higher id; no padding."""
    history = recent(train, window).join(users.select("user_idx").distinct(), "user_idx", "left_semi").select("user_idx", "item_idx").distinct().withColumn("w", F.lit(1.0))
    return best_of_edges(settled(history), settled(edges), "item_a", "item_b", "n", seen, n, high_id=True)


#: Rows of one block of the catalogue, and users of one batch, in the search by sparse vectors: what a task holds.
BLOCK, BATCH = 32_768, 32_768
#: In the search by dense vectors: users of one task and numbers of their vectors, items of one row of a shuffle, users whose lists are ordered at a time, users and items of one product.
USERS, NUMBERS, PACK, SOME, PRODUCT, TILE = 65_536, 1 << 22, 4096, 4096, 256, 2048
#: Items of one piece of similar direction, and the share of users and pieces up to which pieces are taken one by one.
PIECE, SPARSE = 512, 0.25
#: One in so many items is met before the others of its length.
EARLY = 64
#: Items that are met before lists are ordered again: most (and numbers of their vectors), and a part of the first ones, after which they double.
WIDTH, MET, STRETCH = 131_072, 1 << 21, 64


def dealt(users: DataFrame, items: DataFrame, extra: DataFrame | None, blocks: int | None) -> tuple[DataFrame, DataFrame]:
    """Users (with ``had``) and items (with ``size``), each with the block and batch in which they meet: every batch of users meets every block of items."""
    wanted = users.withColumn("had", F.lit(0).cast("long")) if extra is None else users.join(scorers.large(extra), "user_idx", "left")
    blocks = max(1, -(-items.count() // BLOCK)) if blocks is None else blocks
    # Few users still make work for all cores.
    count = users.count()
    batches = max(1, -(-count // BATCH), min(users.sparkSession.sparkContext.defaultParallelism, count // 1024))
    parts = wanted.withColumn("had", F.coalesce("had", F.lit(0).cast("long"))).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    parts = parts.withColumn("batch", F.pmod(F.xxhash64("user_idx"), F.lit(batches)).cast("int"))
    held = items if "size" in items.columns else items.withColumn("size", F.lit(1))
    held = held.withColumn("block", F.pmod(F.xxhash64("item_idx"), F.lit(blocks)).cast("int")).withColumn("batch", F.explode(F.sequence(F.lit(0), F.lit(batches - 1))))
    return parts, held


def nearest(row: np.ndarray, size: np.ndarray | None, want: int) -> np.ndarray:
    """Places of the best scores that make ``want`` items, best first, with all that tie with the last where places stand for several (size)."""
    k = min(len(row), want)
    # All that tie with the k-th stay until they are ordered by item.
    near = np.flatnonzero(row >= np.partition(row, len(row) - k)[len(row) - k])
    near = near[np.argsort(-row[near], kind="stable")]
    if size is None:
        return near[:k]
    last = np.searchsorted(np.cumsum(size[near]), want)
    return near[row[near] >= row[near[min(last, len(near) - 1)]]]


def direction(v: np.ndarray) -> np.ndarray:
    """A number of each vector's direction: the leading bits of its first components in turn, so that near numbers mean near directions."""
    some = min(v.shape[1], 8)
    bits, unit = 32 // max(1, some), v[:, :some] / np.maximum(np.sqrt((v * v).sum(1, keepdims=True)), 1e-300)
    whole = np.clip(np.nan_to_num((unit + 1) * 2.0 ** (bits - 1)), 0, 2**bits - 1).astype(np.int64)
    code = np.zeros(len(v), np.int64)
    for bit in range(bits - 1, -1, -1):
        for x in whole.T:
            code = code << 1 | (x >> bit & 1)
    return code


def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (item_idx, v, size, length) with the number of their direction; one in EARLY has a negative one, drawn, so that users meet some items from everywhere first."""
    for b in batches:
        v = b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1) if b.num_rows else np.empty((0, 1))
        yield b.append_column("code", pa.array(with_early(b.column("item_idx").to_numpy(), direction(v))))


def with_early(ids: np.ndarray, code: np.ndarray) -> np.ndarray:
    x = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x = ((x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(20)
    return np.where(x % np.uint64(EARLY) == 0, -1 - x.astype(np.int64), code)


def packed(items: DataFrame, parts: int) -> DataFrame:
    """length, ids, v, size, single, early: items (item_idx, v, size) of similar length and direction, many in a row, longest first; numbers are short where nothing is lost by it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, PACK):
                part = b.slice(at, PACK)
                v = part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                with np.errstate(over="ignore"):
                    short = v.astype(np.float32)
                single = bool((short == v).all())
                size = part.column("size").to_numpy().astype(np.int64)
                row = [[part.column("length").to_numpy().max()], [part.column("item_idx").to_numpy().tobytes()], [(short if single else v).tobytes()], [None if (size == 1).all() else size.tobytes()], [single], [bool(part.column("code")[0].as_py() < 0)]]
                yield pa.record_batch([pa.array(x, t) for x, t in zip(row, (pa.float64(), pa.binary(), pa.binary(), pa.binary(), pa.bool_(), pa.bool_()), strict=True)], ["length", "ids", "v", "size", "single", "early"])

    rows = items.select(F.col("item_idx").cast("long"), F.col("v").cast("array<double>"), F.col("size").cast("long") if "size" in items.columns else F.lit(1).cast("long").alias("size"))
    rows = rows.withColumn("length", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))
    rows = rows.mapInArrow(coded, "item_idx long, v array<double>, size long, length double, code long")
    kind = F.floor(F.log2(F.greatest("length", F.lit(1e-300))) * 16)
    rows = rows.repartitionByRange(parts, F.desc(kind), "code").sortWithinPartitions(F.desc(kind), "code", "item_idx")
    return rows.mapInArrow(run, "length double, ids binary, v binary, size binary, single boolean, early boolean")


class Lists:
    """The best items of some users, held while the catalogue goes by: after each part, what cannot be among a user's best is dropped.

    Products are taken in single precision; what they cannot rule out, by a bound on their
    error, is taken again in double precision and rounded. What the middle of a piece and
    the distance of its items from there rule out is not multiplied at all.
    """

    def __init__(self, u: np.ndarray, want: np.ndarray, digits: int, some: int = SOME, product: int = PRODUCT, tile: int = TILE, piece: int = PIECE, sparse: float = SPARSE) -> None:
        self.u, self.want, self.digits, self.some, self.product, self.tile, self.piece, self.sparse = u, want, digits, some, product, tile, piece, sparse
        self.length = np.sqrt((u * u).sum(1))
        self.floor, self.sizes = np.full(len(u), -np.inf), False
        # By so many users: (user, item, score, size).
        self.held = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64)) for _ in range(0, len(u), some)]

    def meet(self, ids: np.ndarray, v: np.ndarray, size: np.ndarray) -> None:
        longest, m = float(np.sqrt((v * v).sum(1)).max()), len(v)
        whole = bool(np.isfinite(v).all() and np.isfinite(self.u).all())
        kind = np.float32 if whole and max(np.abs(v).max(), np.abs(self.u).max(initial=0)) < 1e15 else np.float64
        error = (v.shape[1] + 8) * float(np.finfo(kind).eps) * self.length * longest
        vt = np.ascontiguousarray(v.astype(kind).T)
        starts = np.arange(0, m, self.piece)
        middle = np.add.reduceat(v, starts) / np.diff(np.r_[starts, m])[:, None] if whole else None
        reach = np.sqrt(np.maximum.reduceat(((v - np.repeat(middle, np.diff(np.r_[starts, m]), 0)) ** 2).sum(1), starts)) if whole else None
        far = np.maximum.reduceat((v * v).sum(1), starts) if whole else None
        for part in range(len(self.held)):
            lo, hi, found = part * self.some, min(len(self.u), (part + 1) * self.some), []
            bound = self.floor[lo:hi] - error[lo:hi] - 2e-9
            if whole and m > self.piece and np.isfinite(bound).any():
                # The nearest that an item of a piece may be, and by that its product.
                product, own = self.u[lo:hi] @ middle.T, (self.length[lo:hi] ** 2)[:, None]
                gap = np.maximum(0, np.sqrt(np.maximum(0, own + (middle * middle).sum(1) - 2 * product)) - reach)
                most_near = np.minimum(product + self.length[lo:hi, None] * reach, (own + far - gap * gap) / 2)
                near = most_near + 2 * error[lo:hi, None] + 1e-9 * (1 + own + far) >= bound[:, None]
                if near.mean() <= self.sparse:
                    u, bound = self.u[lo:hi].astype(kind), np.nextafter(bound.astype(kind), kind(-np.inf))
                    for p in np.flatnonzero(near.any(0)):
                        live = np.flatnonzero(near[:, p])
                        who, place = np.nonzero(u[live] @ vt[:, starts[p] : starts[p] + self.piece] >= bound[live, None])
                        found.append((live[who] + lo, place + starts[p]))
                    lo = hi
            for a in range(lo, hi, self.product):
                # Scores are rounded afterwards, so a little less may be as good.
                live = np.arange(a, min(hi, a + self.product))
                live = live[~(self.length[live] * longest + error[live] + 2e-9 < self.floor[live])]
                if not len(live):
                    continue
                u, least = self.u[live].astype(kind), self.floor[live] - error[live] - 2e-9
                new = np.flatnonzero(np.isneginf(self.floor[live]) & (self.want[live] <= m))
                if whole and len(new) and m <= self.tile:
                    s = np.sort(u[new] @ vt, 1)
                    least[new] = s[np.arange(len(new)), m - self.want[live[new]]] - 2 * error[live[new]] - 4e-9
                least = np.nextafter(least.astype(kind), kind(-np.inf))
                for at in range(0, m, self.tile):
                    s = u @ vt[:, at : at + self.tile]
                    hit = np.flatnonzero((s.max(1) if whole else np.fmax.reduce(s, 1)) >= least)
                    if len(hit):
                        who, place = np.nonzero(s[hit] >= least[hit, None])
                        found.append((live[hit[who]], place + at))
            if found:
                who, place = (np.concatenate(x) for x in zip(*found, strict=True))
                exact = [np.einsum("ij,ij->i", self.u[who[x : x + 65_536]], v[place[x : x + 65_536]]) for x in range(0, len(who), 65_536)]
                score = np.round(np.concatenate(exact), self.digits)
                good = score >= self.floor[who]
                self.order(part, who[good], ids[place[good]], score[good], size[place[good]])

    def order(self, part: int, *new: np.ndarray) -> None:
        who, item, score, size = (np.concatenate(x) for x in zip(self.held[part], new, strict=True))
        if not len(who):
            return
        by = np.lexsort((item, -score, who))
        who, item, score, size = who[by], item[by], score[by], size[by]
        first = np.flatnonzero(np.r_[True, who[1:] != who[:-1]])
        many = np.diff(np.r_[first, len(who)])
        total = np.cumsum(size)
        before = total - size - np.repeat(total[first] - size[first], many)
        stays = before < self.want[who]
        last = first + np.add.reduceat(stays.astype(np.int64), first) - 1
        full = before[last] + size[last] >= self.want[who[first]]
        self.floor[who[first[full]]] = score[last[full]]
        if self.sizes:  # rows stand for several items: all that tie with the last
            stays |= score >= np.repeat(score[last], many)
        self.held[part] = (who[stays], item[stays], score[stays], size[stays])


def met(users: DataFrame, items: DataFrame, n: int, blocks: int | None, final: bool) -> DataFrame:
    """Users (user_idx, u, had, mine) with their best items (item_idx, v, and size, if rows stand for several).

    Each task has a batch of users, and the whole catalogue goes by, so that no list moves;
    a user travels once, an item once for each batch. final: what a user has seen
    (``mine``) is left out, and rows have a rank.
    """
    shape = items.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("m")).first()
    dim, count = max(1, shape["m"] or 1), users.count()
    cores = users.sparkSession.sparkContext.defaultParallelism
    tasks = -(-count // min(USERS, max(PACK, NUMBERS // dim)))
    # All cores have equal work; few users still make work for all.
    tasks = max(1, -(-tasks // cores) * cores if tasks > 1 else 1, min(cores, count // 1024))
    parts = max(1, -(-shape["n"] // max(1, MET // dim))) if blocks is None else blocks
    left = users.select(F.pmod(F.xxhash64("user_idx"), F.lit(tasks)).cast("int").alias("batch"), F.lit(-1.0).alias("at"), F.col("user_idx").cast("long"), F.col("u").cast("array<double>"), F.col("had").cast("long"), F.col("mine").cast("array<long>"))
    right = packed(items, parts).select(F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))).alias("batch"), (1 / (1 + F.col("length"))).alias("at"), "ids", "v", "size", "single", "early")
    both = left.unionByName(right, allowMissingColumns=True).repartitionById(tasks, F.col("batch"))
    # Directions come in a drawn order, so that every user soon has met some items that are near.
    both = both.sortWithinPartitions(F.col("at") >= 0, F.floor(-F.log2(F.greatest(1 / F.col("at") - 1, F.lit(1e-300))) * 16), F.desc("early"), F.xxhash64("ids"))
    most, start, some, how = min(WIDTH, max(PACK, MET // dim)), 16 * STRETCH, SOME, (scorers.DIGITS, SOME, PRODUCT, TILE, PIECE, SPARSE)  # workers need not import the scorers
    names = ["user_idx", "item_idx", "score", "rank"][: 3 + final]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, vectors, had, mine, lists, waiting, width = [], [], [], [], None, [], start

        def meet(least: int) -> None:
            nonlocal waiting, width
            while (there := sum(len(w[0]) for w in waiting)) >= max(1, min(width, least)):
                every = [np.concatenate(x) for x in zip(*waiting, strict=True)]
                lists.sizes = lists.sizes or bool((every[2] != 1).any())
                now = min(width, there)
                lists.meet(*(x[:now] for x in every))
                waiting, width = [tuple(x[now:] for x in every)], min(2 * width, most)

        for b in batches:
            users = b.filter(b.column("user_idx").is_valid())
            if users.num_rows:
                own.append(users.column("user_idx").to_numpy())
                vectors.append(users.column("u").flatten().to_numpy(zero_copy_only=False).reshape(users.num_rows, -1))
                had.append(users.column("had").to_numpy().astype(np.int64))
                if final:
                    size = users.column("mine").value_lengths().to_numpy(zero_copy_only=False)
                    mine += np.split(users.column("mine").flatten().to_numpy(zero_copy_only=False), np.cumsum(size)[:-1])
            items = b.filter(b.column("ids").is_valid())
            if items.num_rows and own:
                if lists is None:
                    lists = Lists(np.concatenate(vectors), n + np.concatenate(had), *how)
                    vectors = []
                for ids, v, size, single in zip(*(items.column(c).to_pylist() for c in ("ids", "v", "size", "single")), strict=True):
                    ids = np.frombuffer(ids, np.int64)
                    waiting.append((ids, np.frombuffer(v, np.float32 if single else np.float64).reshape(len(ids), -1).astype(np.float64), np.ones(len(ids), np.int64) if size is None else np.frombuffer(size, np.int64)))
                    meet(width)
        if lists is None:
            return
        meet(1)
        own = np.concatenate(own)
        for part, (who, item, score, _) in enumerate(lists.held):
            columns = [own[who], item, score]
            if final:
                old = mine[part * some : (part + 1) * some]
                gone, by = np.concatenate([*old, np.empty(0, np.int64)]), np.repeat(np.arange(len(old)), [len(x) for x in old]) + part * some
                known = np.unique(item)
                at = np.minimum(np.searchsorted(known, gone), max(0, len(known) - 1))
                there = known[at] == gone if len(known) else np.zeros(len(gone), bool)
                stays = ~np.isin(who * len(known) + np.searchsorted(known, item), by[there] * len(known) + at[there])
                columns, who = [x[stays] for x in columns], who[stays]
                first = np.flatnonzero(np.r_[True, who[1:] != who[:-1]][: len(who)])
                rank = np.arange(len(who)) - np.repeat(first, np.diff(np.r_[first, len(who)])) + 1
                columns = [x[rank <= n] for x in (*columns, rank.astype(np.int32))]
            yield pa.record_batch([pa.array(x) for x in columns], names)

    return both.mapInArrow(run, "user_idx long, item_idx long, score double" + ", rank int" * final)


def dense_top(users: DataFrame, items: DataFrame, n: int, extra: DataFrame | None = None, blocks: int | None = None) -> DataFrame:
    """user_idx, item_idx, score: the n best dot products of vectors u (users) and v (items).

    ``extra`` has, by user, how many more items than n are wanted (as many as the user has
    seen). Rows of items that stand for several (``size``) are listed until they make as
    many, with all that tie with the last.
    """
    wanted = users.withColumn("had", F.lit(0)) if extra is None else users.join(extra, "user_idx", "left").withColumn("had", F.coalesce("had", F.lit(0)))
    return met(wanted.withColumn("mine", F.lit(None)), items, n, blocks, False)


def dense_lists(users: DataFrame, items: DataFrame, seen: DataFrame, n: int) -> DataFrame:
    """``best`` of ``dense_top``: user_idx, item_idx, score, rank; what users have seen goes to where their lists are made."""
    mine = seen.join(users.select("user_idx"), "user_idx", "left_semi").groupBy("user_idx").agg(F.collect_set(F.col("item_idx").cast("long")).alias("mine"))
    wanted = users.join(mine, "user_idx", "left").withColumn("mine", F.coalesce("mine", F.array().cast("array<long>")))
    return met(wanted.withColumn("had", F.size("mine")), items, n, None, True)


def sparse_top(users: DataFrame, items: DataFrame, n: int, extra: DataFrame | None = None, blocks: int | None = None) -> DataFrame:
    """As ``dense_top`` for sparse vectors (user_idx, t, u and item_idx, t, v, with places t), and for positive products only."""
    parts, held = dealt(users.select("user_idx", "t", "u"), items, extra, blocks)
    digits, best_places = scorers.DIGITS, nearest  # workers need not import the scorers

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        users, found, scores = [], [], []
        if len(left) and len(right):
            right = right.sort_values("item_idx")
            ids, size = right["item_idx"].to_numpy(), right["size"].to_numpy()
            size = None if int(size.max()) == 1 else size
            # Inverted lists: by term, the rows that have it.
            t, v = np.concatenate(right["t"].to_numpy()), np.concatenate(right["v"].to_numpy())
            row = np.repeat(np.arange(len(ids)), [len(x) for x in right["t"]])
            order = np.argsort(t, kind="stable")
            v, row = v[order], row[order]
            names, begin, many = np.unique(t[order], return_index=True, return_counts=True)
            for user, had, t, u in zip(left["user_idx"], left["had"], left["t"], left["u"], strict=True):
                at = np.minimum(np.searchsorted(names, t), len(names) - 1)
                known = names[at] == t
                at, u = at[known], u[known]
                k = many[at]
                index = np.repeat(begin[at] - (np.cumsum(k) - k), k) + np.arange(int(k.sum()))
                score = np.round(np.bincount(row[index], np.repeat(u, k) * v[index], len(ids)), digits)
                near = best_places(score, size, n + int(had))
                near = near[score[near] > 0]
                users.append(np.full(len(near), user, np.int64))
                found.append(ids[near])
                scores.append(score[near])
        if not users:
            return pd.DataFrame({"user_idx": [], "item_idx": [], "score": []})
        return pd.DataFrame({"user_idx": np.concatenate(users), "item_idx": np.concatenate(found), "score": np.concatenate(scores)})

    return parts.groupBy("block", "batch").cogroup(held.groupBy("block", "batch")).applyInPandas(run, "user_idx long, item_idx long, score double")


def of_kinds(near: DataFrame, kinds: DataFrame, mine: DataFrame, n: int) -> DataFrame:
    """The n best unseen items of each user from scores of kinds (user_idx, item_idx, score). kinds: item_idx, kind; mine: user_idx, what they have seen."""
    held = kinds.groupBy("kind").agg(F.sort_array(F.collect_set("item_idx")).alias("items"))
    items, many = kinds.agg(F.count(F.lit(1)), F.count_distinct("kind")).first()
    held = F.broadcast(held) if 8 * items + 64 * many <= KIND_BYTES else scorers.large(held)
    # Of a kind, a user needs the first n items that they have not seen.
    rows = near.select("user_idx", "item_idx", "score").repartition("user_idx").join(scorers.large(mine), "user_idx", "left").withColumn("mine", F.coalesce("mine", F.array().cast("array<long>")))
    rows = rows.join(held.withColumnRenamed("kind", "item_idx"), "item_idx").select("user_idx", "score", F.explode(F.slice(F.array_except(F.slice("items", F.lit(1), F.lit(n) + F.size("mine")), "mine"), 1, n)).alias("item_idx"))
    ranked = rows.withColumn("rank", F.row_number().over(by_user().orderBy(F.desc("score"), "item_idx")))
    return ranked.where(F.col("rank") <= n).select("user_idx", "item_idx", "score", "rank")


def embedding(users: DataFrame, train: DataFrame, vectors: DataFrame, seen: DataFrame, n: int, window: int = 10, catalogue: int | None = None, kinds: DataFrame | None = None) -> DataFrame:
    """Exact top n by dot product with the profile of the last ``window`` items.

    kinds (item_idx, kind): where many items share a vector, ``vectors`` has one row for
    each kind, with the kind as item_idx. Users then meet kinds, not items.
    """
    unit = scorers.unit_rows(vectors)
    history = recent(train, window).join(users.select("user_idx").distinct(), "user_idx", "left_semi")
    if kinds is None:
        had = seen.select("user_idx", "item_idx").distinct().groupBy("user_idx").agg(F.count(F.lit(1)).alias("had"))
        size = vectors.count() if catalogue is None else catalogue
        return best(dense_top(scorers.profiles(unit, history), unit, n, had, max(1, -(-size // BLOCK))), seen, n)
    history = history.select("user_idx", "item_idx").join(kinds, "item_idx").select("user_idx", F.col("kind").alias("item_idx"))
    return dense_lists_of_kinds(scorers.profiles(unit, history), unit, kinds, seen, n)


def dense_lists_of_kinds(users: DataFrame, vectors: DataFrame, kinds: DataFrame, seen: DataFrame, n: int) -> DataFrame:
    """``dense_lists`` where many items share a vector: kinds (item_idx, kind), and vectors by kind (item_idx, v)."""
    sized = kinds.groupBy(F.col("kind").alias("item_idx")).agg(F.count_distinct("item_idx").alias("size"))
    mine = seen.groupBy("user_idx").agg(F.collect_set("item_idx").alias("mine"))
    near = dense_top(users, vectors.join(sized, "item_idx"), n, mine.select("user_idx", F.size("mine").cast("long").alias("had")))
    return of_kinds(near, kinds, mine, n)


def vector_neighbours(vectors: DataFrame, k: int = 50) -> DataFrame:
    """item_a, item_b, n: cosine to the k nearest items, the item itself left out."""
    unit = scorers.dense(scorers.unit_vectors(vectors), "item_idx")
    own = unit.select(F.col("item_idx").alias("user_idx"), F.col("v").alias("u"))
    near = dense_top(own, settled(unit), k + 1).where("user_idx != item_idx")
    ranked = near.withColumn("rank", F.row_number().over(by_user().orderBy(F.desc("score"), "item_idx"))).where(F.col("rank") <= k)
    return ranked.select(F.col("user_idx").alias("item_a"), F.col("item_idx").alias("item_b"), F.col("score").alias("n"))


def as_pool(top: DataFrame) -> DataFrame:
    """A retrieved list as a scored pool: the list's length down to 1."""
    size = F.count(F.lit(1)).over(Window.partitionBy("user_idx"))
    return top.select("user_idx", "item_idx", (size - F.col("rank") + 1).cast("double").alias("score"))


class Registry(dict[str, Callable[..., DataFrame]]):
    """Retrievers by name. ``run`` skips unknown names and keeps on after a failure, which it reports."""

    def run(self, names: list[str], **context: DataFrame) -> tuple[DataFrame | None, dict[str, str]]:
        pools, failed = None, {}
        for name in names:
            if name not in self:
                failed[name] = "unknown retriever"
                continue
            try:
                found = self[name](**context).withColumn("model", F.lit(name))
            except Exception as e:  # noqa: BLE001  one model's failure must not end the run
                failed[name] = f"{type(e).__name__}: {e}"
                continue
            pools = found if pools is None else pools.unionByName(found)
        return pools, failed
