"""Approximate nearest neighbours: inverted file, product-quantised residuals, exact reranking.

``fit`` learns coarse centroids and residual codebooks by k-means on a bounded,
seeded sample (``SAMPLE`` vectors). There are about as many cells as the root of the
number of vectors, as far as the sample can tell centroids. ``search`` keeps of every
distinct vector its cell and its code, apart from the vectors themselves, and deals
cells to shards of bounded size (a cell may hold most vectors; it is split). A query
goes to the shards of its nearest cells, where asymmetric distance tables rank the
codes of these cells; the best ``depth`` of all shards together are its shortlist.
Only for shortlists are vectors read, and reranked by the exact distance in double
precision.

How many cells a query probes is measured on the sample (``COVER``), and how long its
shortlist is (``DEEP``); it goes on until cells hold enough candidates, so it finds k
neighbours wherever there are k.

Corner cases: vectors that are null, zero, of another length than most, or hold null
or non-finite components take no part, nor do rows without an id; rows that share an
id are candidates with each of their vectors, and the id is found once, at its
smallest distance (as a query, the smallest vector stands for it); equal vectors are
one candidate until the end, so copies displace nothing, and go by the smaller id; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rankforge.llm.workspace import Workspace, releasing, small

SAMPLE, SEED = 32_768, 7
#: Cells: the root of the number of vectors times ROOT, but at least so many sample vectors each.
ROOT, PER_CELL = 1.0, 16
SUBSPACES, CODES = 16, 256
K = 10
#: Cells that a query probes: as few as hold this share of the true neighbours of TRIED sample vectors within the sample.
#: Clustered vectors need a few cells, isotropic ones, whose neighbours lie all over, many.
COVER, TRIED = 0.97, 512
#: Length of a shortlist: so many times k, or more if the codes rank this share of the sample's true neighbours further down.
DEPTH, DEEP = 10, 0.99
#: Codes of one shard and queries that meet it at a time, by which memory is bounded, and codes that are worth a shard.
BLOCK, LOT, LEAST = 65_536, 16_384, 4096


def kmeans(x: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    rng = np.random.default_rng(seed)
    x = x.astype(np.float64)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        at = nearest(x, c)
        n = np.bincount(at, minlength=len(c))
        sums = np.stack([np.bincount(at, x[:, d], len(c)) for d in range(x.shape[1])], 1)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (c**2).sum(1) - 2 * x @ c.T


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.concatenate([np.argmin(distances(x[s : s + 4096], c), 1) for s in range(0, len(x), 4096)]) if len(x) else np.empty(0, np.int64)


@dataclass
class Index:
    """Centroids and one codebook for each subspace; at most SAMPLE / PER_CELL x dimension and CODES x dimension numbers, whatever the input."""

    centroids: np.ndarray
    books: list[np.ndarray]
    parts: list[tuple[int, int]]
    probes: int
    depth: int

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cell = nearest(x, self.centroids)
        rest = x - self.centroids[cell]
        return cell, np.stack([nearest(rest[:, a:b], book) for (a, b), book in zip(self.parts, self.books, strict=True)], 1).astype(np.uint8)

    def calibrate(self, x: np.ndarray, k: int = K) -> None:
        """Sets how many cells must be probed to meet COVER of the k nearest sample vectors of sample vectors, and how long a shortlist must be."""
        cell, code = self.encode(x)
        ask = x[:TRIED]
        k = min(k, len(x) - 1)
        if k < 1:
            self.probes = len(self.centroids)
            return
        own = np.arange(len(ask))
        far = distances(ask, x)
        far[own, own] = np.inf
        true = np.argpartition(far, k - 1, 1)[:, :k]
        place = np.argsort(np.argsort(distances(ask, self.centroids), 1, kind="stable"), 1)
        self.probes = quantile(np.take_along_axis(place, cell[true], 1), COVER) + 1
        # Where the codes rank the true neighbours among the sample.
        near = self.centroids[cell]
        for i, ((a, b), book) in enumerate(zip(self.parts, self.books, strict=True)):
            near[:, a:b] += book[code[:, i]]
        ranks = []
        for s in range(0, len(ask), 64):
            d = distances(ask[s : s + 64], near)
            d[np.arange(len(d)), own[s : s + 64]] = np.inf
            ordered = np.sort(d, 1)
            ranks += [np.searchsorted(ordered[i], d[i, true[s + i]]) for i in range(len(d))]
        self.depth = max(self.depth, quantile(np.array(ranks), DEEP) + 1 + k)


def quantile(values: np.ndarray, share: float) -> int:
    values = np.sort(values.ravel())
    return int(values[min(len(values) - 1, int(np.ceil(share * len(values))))])


def usable(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """vec_id and embedding of the rows that take part."""
    df = rows.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("embedding")).where("vec_id is not null and embedding is not null and size(embedding) > 0")
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.where(F.coalesce(fine, F.lit(False)) & F.exists("embedding", lambda x: x != 0))


def fit(rows: DataFrame, count: int, sample: int = SAMPLE) -> Index | None:
    """Index of usable rows; None without any. The sample's bound is what reaches the driver."""
    first = rows.select("embedding", F.xxhash64(F.lit(SEED), "vec_id").alias("draw")).orderBy("draw", "embedding").limit(sample)
    table = first.select("embedding").toArrow()["embedding"].combine_chunks()
    if not len(table):
        return None
    x = np.unique(np.asarray(table.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(table), -1), axis=0)
    x = x[np.random.default_rng(SEED).permutation(len(x))]
    centroids = kmeans(x, max(1, min(round(ROOT * count**0.5), len(x) // PER_CELL)), SEED)
    rest = x - centroids[nearest(x, centroids)]
    cuts = np.linspace(0, x.shape[1], min(SUBSPACES, x.shape[1]) + 1).astype(int)
    parts = list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))
    books = [kmeans(rest[:, a:b], min(CODES, len(x)), SEED + 1 + i, 8) for i, (a, b) in enumerate(parts)]
    index = Index(centroids, books, parts, 1, DEPTH * K)
    index.calibrate(x)
    return index


def matrix(column: pa.Array) -> np.ndarray:
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.empty((0, 1))


def encoded(rows: DataFrame, index: Index) -> DataFrame:
    """vec_id, same (two hashes of the vector, by which equal ones are known), cell, code."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column(3))
            cell, code = index.encode(x) if len(x) else (np.empty(0, int), np.empty((0, 1), np.uint8))
            binary = pa.array([c.tobytes() for c in code], pa.binary())
            yield pa.record_batch([b.column(0), b.column(1), b.column(2), pa.array(cell.astype(np.int32)), binary], ["vec_id", "same", "same2", "cell", "code"])

    hashed = rows.select("vec_id", F.xxhash64("embedding").alias("same"), F.xxhash64(F.lit(SEED), "embedding").alias("same2"), "embedding")
    return hashed.mapInArrow(releasing(run), "vec_id long, same long, same2 long, cell int, code binary")


class Shard:
    """Codes of some cells, by cell."""

    def __init__(self, index: Index, cells: np.ndarray, codes: np.ndarray) -> None:
        self.index, self.order = index, np.argsort(cells, kind="stable")
        cells = cells[self.order]
        self.held, self.begin = np.unique(cells, return_index=True)
        self.end = np.append(self.begin[1:], len(cells))
        self.place = np.arange(len(index.books)) * CODES
        self.codes = codes[self.order].astype(np.int32) + self.place
        # |q - c - r|^2 = |q - c|^2 + |r|^2 + 2 c.r - 2 q.r for a residual r of cell c: only the last part needs a table for each query.
        self.fixed = np.zeros(len(cells))
        for i, ((a, b), book) in enumerate(zip(index.parts, index.books, strict=True)):
            self.fixed += (book**2).sum(1)[codes[self.order, i]] + 2 * (index.centroids[cells, a:b] * book[codes[self.order, i]]).sum(1)

    def nearest(self, query: np.ndarray, probed: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """(rows, distances by codes) of the nearest ``depth`` in the probed cells."""
        here = np.flatnonzero(np.isin(self.held, probed))
        if not len(here):
            return np.empty(0, np.int64), np.empty(0)
        at = np.concatenate([np.arange(self.begin[i], self.end[i]) for i in here])
        far = ((query - self.index.centroids[self.held[here]]) ** 2).sum(1)
        d = self.fixed[at] + np.repeat(far, self.end[here] - self.begin[here])
        table = np.zeros(len(self.place) * CODES)
        for i, ((a, b), book) in enumerate(zip(self.index.parts, self.index.books, strict=True)):
            table[self.place[i] : self.place[i] + len(book)] = -2 * book @ query[a:b]
        codes = self.codes[at]
        for i in range(codes.shape[1]):
            d += table[codes[:, i]]
        near = np.argpartition(d, depth - 1)[:depth] if len(d) > depth else np.arange(len(d))
        return self.order[at[near]], d[near]


def search(vectors: DataFrame, queries: DataFrame, k: int = K, probes: int | None = None, depth: int | None = None, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score (Euclidean distance): the k nearest found of each query's id, not itself."""
    spark = vectors.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    work = Workspace(spark, "ann")
    rows = usable(vectors, key, vector)
    size = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if size is None:
        return empty
    rows = rows.where(F.size("embedding") == size["d"])
    index = fit(rows, size["count"])
    probes = index.probes if probes is None else probes
    # A shortlist is of distinct vectors, the query's own one among them.
    depth = max(k + 1, index.depth * k // K if depth is None else depth)

    # Of equal vectors the first k + 1 ids are all that can be found; ranks are limited before they are shuffled.
    codes = work.table(encoded(rows, index), "codes")
    nth = F.row_number().over(Window.partitionBy("same", "same2").orderBy("vec_id"))
    ids = codes.groupBy("same", "same2", "vec_id").agg(F.first("cell").alias("cell"), F.first("code").alias("code")).withColumn("nth", nth)
    ids = work.table(ids.where(F.col("nth") <= k + 1), "ids")
    held = {r["cell"]: (r["ids"], r["vectors"]) for r in ids.groupBy("cell").agg(F.count(F.lit(1)).alias("ids"), F.count_if(F.col("nth") == 1).alias("vectors")).collect()}  # a row for each cell
    counts, distinct = (np.array([held.get(c, (0, 0))[i] for c in range(len(index.centroids))]) for i in (0, 1))
    ask = usable(queries, key, vector).where(F.size("embedding") == size["d"]).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    ask = work.table(ask, "queries")

    # A cell's vectors are dealt to the shards from its own number on, so many that none gets more than its share.
    shards = int(max(1, -(-distinct.sum() // BLOCK), min(spark.sparkContext.defaultParallelism, distinct.sum() // LEAST)))
    split = np.minimum(shards, np.maximum(1, -(-distinct * shards // max(1, distinct.sum()))))
    lots = int(max(1, -(-ask.count() * min(1.0, probes / len(counts)) // LOT)))

    def probed(x: np.ndarray) -> list[np.ndarray]:
        """The cells that each query probes: the nearest ones, and more until they hold enough ids."""
        order = np.argsort(distances(x, index.centroids), 1, kind="stable")
        enough = np.cumsum(counts[order], 1) >= k + 1
        need = np.maximum(np.where(enough.any(1), enough.argmax(1) + 1, len(counts)), probes)
        return [cells[:n][distinct[cells[:n]] > 0] for cells, n in zip(order, need, strict=True)]

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column(1))
            to = [np.unique(np.concatenate([(c + np.arange(split[c])) % shards for c in cells] or [np.empty(0, np.int64)])) for cells in probed(x)] if len(x) else []
            take = pa.array(np.repeat(np.arange(len(to)), [len(t) for t in to]))
            yield pa.record_batch([b.column(0).take(take), b.column(1).take(take), pa.array(np.concatenate([*to, np.empty(0)]).astype(np.int32))], ["vec_id", "embedding", "shard"])

    lot = lambda c: F.pmod(F.xxhash64(c), F.lit(lots)).cast("int")
    asked = ask.mapInArrow(route, "vec_id long, embedding array<double>, shard int").withColumn("lot", lot("vec_id"))
    parts = F.element_at(F.array(*[F.lit(int(n)) for n in split]), F.col("cell") + 1)
    first = ids.where("nth = 1").withColumn("shard", F.pmod(F.col("cell") + F.pmod(F.col("same"), parts), F.lit(shards)).cast("int"))
    dealt = first.withColumn("lot", F.explode(F.sequence(F.lit(0), F.lit(lots - 1)))).select("vec_id", "same", "same2", "cell", "code", "shard", "lot")

    def both(q: pa.Table, r: pa.Table) -> pa.Table:
        found: list[list[np.ndarray]] = [[np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]]
        r = r.combine_chunks()
        if q.num_rows and r.num_rows:
            codes = np.frombuffer(b"".join(r["code"].to_pylist()), np.uint8).reshape(r.num_rows, -1)
            shard, x = Shard(index, r["cell"].to_numpy(), codes), matrix(q["embedding"].combine_chunks())
            for at in range(0, len(x), 1024):
                for qid, v, cells in zip(q["vec_id"].to_numpy()[at : at + 1024], x[at : at + 1024], probed(x[at : at + 1024]), strict=True):
                    row, d = shard.nearest(v, cells, depth)
                    for c, values in zip(found, (np.full(len(row), qid), row, d), strict=True):
                        c.append(values)
        qid, row, d = (pa.array(np.concatenate(c)) for c in found)
        return pa.table([qid, r["vec_id"].take(row), r["same"].take(row), r["same2"].take(row), d], ["query_id", "vec_id", "same", "same2", "near"])

    found = asked.groupBy("shard", "lot").cogroup(dealt.groupBy("shard", "lot")).applyInArrow(both, "query_id long, vec_id long, same long, same2 long, near double")
    best = F.row_number().over(Window.partitionBy("query_id").orderBy("near", "same", "same2"))
    short = work.table(found.withColumn("at", best).where(F.col("at") <= depth).drop("at", "near"), "shortlist")

    # Vectors are read for shortlists only, by the id that stands for equal ones.
    wanted = work.table(short.select("vec_id").distinct(), "wanted")
    exact = rows.join(small(wanted), "vec_id", "left_semi").select(F.xxhash64("embedding").alias("same"), F.xxhash64(F.lit(SEED), "embedding").alias("same2"), "embedding").dropDuplicates(["same", "same2"])
    pairs = short.join(exact, ["same", "same2"]).join(small(ask.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))), "query_id")
    square = F.aggregate(F.zip_with("embedding", "query", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    pairs = pairs.select("query_id", "vec_id", "same", "same2", F.sqrt(square).alias("score"))
    # Each vector has an id at least, so only the k + 1 nearest ones count; then all their ids.
    order = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    near = pairs.withColumn("at", order).where(F.col("at") <= k + 1).select("query_id", "same", "same2", "score")
    near = near.join(ids.select("same", "same2", "vec_id"), ["same", "same2"]).where("vec_id != query_id")
    near = near.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    return near.withColumn("rank", order).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
