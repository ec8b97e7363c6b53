"""Trained embeddings: matrix factorisation by pairwise loss, graph convolution, two towers, and a contract for sequence models.

Pairwise training is a loop of DataFrame plans over all interactions: an epoch joins
triples (user, item, drawn item) with the vectors of their nodes and sums gradients by
node, so that it is distributed as any aggregation is, and the same in every run. With
layers it is the light graph convolution: its mean of neighbourhood sums is linear and
symmetric, so a gradient goes back through the same propagation. Towers are matrices of
features x dimension; their gradients are summed over all rows, the matrices stay on
the driver. Sequence models are plugged in with their weights (``SequenceModel``).
"""

from __future__ import annotations

import threading
from collections.abc import Iterator
from contextlib import contextmanager
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.ml.recommendation import ALS
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankforge.operators.ranking import dense_index, draw
from rankforge.sources.readers import shared_folder


def checkpoints(spark: SparkSession) -> None:
    """Checkpoints go to the shared folder."""
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))


def settled(df: DataFrame) -> DataFrame:
    """df, written to the shared folder and read from there, so that plans of loops stay short and survive lost executors."""
    checkpoints(df.sparkSession)
    return df.checkpoint()


@contextmanager
def collecting(spark: SparkSession, seconds: float = 5) -> Iterator[None]:
    """Meanwhile, the driver collects its garbage every few seconds: shuffle files stay until it does."""
    done = threading.Event()

    def run() -> None:
        while not done.wait(seconds):
            spark.sparkContext._jvm.System.gc()

    thread = threading.Thread(target=run, daemon=True)
    thread.start()
    try:
        yield
    finally:
        done.set()
        thread.join()


def als(train: DataFrame, dim: int = 32, rounds: int = 10, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(users, items) with embeddings, by implicit-feedback alternating least squares.

    Each round's factors travel to the other side's blocks. They are checkpointed, so that
    no round needs an earlier one's files, and the driver collects its garbage meanwhile,
    so that these go.
    """
    checkpoints(train.sparkSession)
    w = train.groupBy(F.col("user_idx").cast("int").alias("user"), F.col("item_idx").cast("int").alias("item")).agg(F.count(F.lit(1)).cast("float").alias("rating"))
    with collecting(train.sparkSession):
        fitted = ALS(rank=dim, maxIter=rounds, implicitPrefs=True, userCol="user", itemCol="item", ratingCol="rating", seed=seed, checkpointInterval=1).fit(w)
    name = lambda df, key: df.select(F.col("id").cast("long").alias(key), F.col("features").cast("array<double>").alias("embedding"))
    return name(fitted.userFactors, "user_idx"), name(fitted.itemFactors, "item_idx")


def bipartite_edges(train: DataFrame) -> DataFrame:
    """(src, dst, w): normalised adjacency of users (u<id>) and items (i<id>), both ways."""
    e = train.groupBy("user_idx", "item_idx").agg(F.count(F.lit(1)).cast("double").alias("n"))
    du = e.groupBy("user_idx").agg(F.sum("n").alias("du"))
    di = e.groupBy("item_idx").agg(F.sum("n").alias("di"))
    w = F.col("n") / F.sqrt((F.col("du") + 1e-8) * (F.col("di") + 1e-8))
    half = e.join(du, "user_idx").join(di, "item_idx").select(F.concat(F.lit("u"), "user_idx").alias("src"), F.concat(F.lit("i"), "item_idx").alias("dst"), w.alias("w"))
    return half.unionByName(half.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))


def places(dim: int) -> list[str]:
    """Columns of a table of vectors (node, x0, x1, ...)."""
    return [f"x{i}" for i in range(dim)]


def dimension(x: DataFrame) -> int:
    return sum(c.startswith("x") for c in x.columns)


def hash_vectors(edges: DataFrame, dim: int, seed: int = 42) -> DataFrame:
    """(node, x0, ...): start values in -0.1..0.1 from the md5 of seed, node and place, the same in every engine."""
    h = lambda i: F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), "node", F.lit(i))), 1, 8), 16, 10).cast("double")
    return edges.select(F.col("src").alias("node")).distinct().select("node", *[((h(i) / 4294967295.0 - 0.5) * 0.2).alias(f"x{i}") for i in range(dim)])


def propagate(edges: DataFrame, start: DataFrame, layers: int = 2) -> DataFrame:
    """(node, x0, ...): mean of the start values and ``layers`` rounds of neighbourhood sums; each round is a join and a sum."""
    names, total, x = places(dimension(start)), start, start
    for _ in range(layers):
        x = edges.join(x, edges["dst"] == x["node"]).groupBy("src").agg(*[F.sum(F.col("w") * F.col(c)).alias(c) for c in names]).withColumnRenamed("src", "node")
        total = total.unionByName(x)
    return total.groupBy("node").agg(*[(F.sum(c) / (layers + 1)).alias(c) for c in names])


def drawn_triples(pairs: DataFrame, slots: DataFrame, size: int, seed: int) -> DataFrame:
    """(u, i, j): nodes of each user and item with another item, drawn by the md5 of seed and ids; draws that the user has are left out."""
    drawn = pairs.withColumn("slot", draw(seed, size, "user_idx", "item_idx")).join(slots.select("slot", F.col("item_idx").alias("other")), "slot")
    drawn = drawn.join(pairs.select("user_idx", F.col("item_idx").alias("other")), ["user_idx", "other"], "left_anti")
    node = lambda kind, c, name: F.concat(F.lit(kind), F.col(c).cast("string")).alias(name)
    return drawn.select(node("u", "user_idx", "u"), node("i", "item_idx", "i"), node("i", "other", "j"))


def pairwise_gradient(x: DataFrame, triples: DataFrame) -> DataFrame:
    """(node, x0, ...): by node, the sum of the gradients of log sigmoid(u.i - u.j) over triples."""
    names = places(dimension(x))
    t = triples
    for side in "uij":
        t = t.join(x.select(F.col("node").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in names]), side)
    gap = sum((F.col(f"u_{c}") * (F.col(f"i_{c}") - F.col(f"j_{c}")) for c in names), F.lit(0.0))
    t = t.withColumn("g", 1 / (1 + F.exp(gap)))
    rows = [
        F.struct(F.col("u").alias("node"), *[(F.col("g") * (F.col(f"i_{c}") - F.col(f"j_{c}"))).alias(c) for c in names]),
        F.struct(F.col("i").alias("node"), *[(F.col("g") * F.col(f"u_{c}")).alias(c) for c in names]),
        F.struct(F.col("j").alias("node"), *[(-F.col("g") * F.col(f"u_{c}")).alias(c) for c in names]),
    ]
    return t.select(F.explode(F.array(*rows)).alias("r")).select("r.*").groupBy("node").agg(*[F.sum(c).alias(c) for c in names])


def fit_pairwise(train: DataFrame, layers: int = 0, dim: int = 64, epochs: int = 20, rate: float = 0.5, decay: float = 1e-4, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(users, items) with embeddings of all users and items of the log, by gradient ascent on the pairwise likelihood.

    layers 0: matrix factorisation. Otherwise vectors are propagated over the graph of
    users and items before they are compared. A node's step is its summed gradient over
    the root of its degree, so that frequent nodes neither stand still nor run away.
    """
    edges = settled(bipartite_edges(train))
    pairs = settled(train.select("user_idx", "item_idx").distinct())
    slots = settled(dense_index(train, "item_idx", "slot"))
    size, names = slots.count(), places(dim)
    degree = settled(edges.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("n")))
    x = settled(hash_vectors(edges, dim, seed))
    for epoch in range(epochs):
        final = settled(propagate(edges, x, layers)) if layers else x
        step = pairwise_gradient(final, drawn_triples(pairs, slots, size, seed + 1 + epoch))
        step = propagate(edges, settled(step), layers) if layers else step
        step = step.select("node", *[F.col(c).alias(f"g_{c}") for c in names])
        moved = [(F.col(c) * (1 - rate * decay) + rate * F.coalesce(f"g_{c}", F.lit(0.0)) / F.sqrt("n")).alias(c) for c in names]
        x = settled(x.join(degree, "node").join(step, "node", "left").select("node", *moved))
    final = settled(propagate(edges, x, layers)) if layers else x

    def of(kind: str, key: str) -> DataFrame:
        return final.where(F.col("node").startswith(kind)).select(F.substring("node", 2, 30).cast("long").alias(key), F.array(*names).alias("embedding"))

    return of("u", "user_idx"), of("i", "item_idx")


def fit_bpr(train: DataFrame, **how: float) -> tuple[DataFrame, DataFrame]:
    return fit_pairwise(train, layers=0, **how)


def fit_lightgcn(train: DataFrame, layers: int = 2, **how: float) -> tuple[DataFrame, DataFrame]:
    return fit_pairwise(train, layers=layers, **how)


def decayed_markov(train: DataFrame, history: int = 50, decay: float = 0.8) -> DataFrame:
    """user_idx, item_idx, score: transitions from a user's last items, each step back counts less. A sequential stand-in, no transformer."""
    from rankforge.operators.ranking import recent
    from rankforge.operators.scorers import expand, markov_edges

    rows = recent(train, history).groupBy("user_idx", "item_idx").agg(F.sum(F.pow(F.lit(decay), F.col("back") - 1)).alias("w"))
    return expand(rows, markov_edges(train), "item_from", "item_to", "p")


def sequences(train: DataFrame, length: int = 50) -> DataFrame:
    """user_idx, seq: the last ``length`` items plus 1, padded with 0 on the left."""
    from rankforge.operators.ranking import recent_items

    rows = recent_items(train, length).withColumn("items", F.transform("items", lambda x: x + 1))
    return rows.select("user_idx", F.concat(F.array_repeat(F.lit(0).cast("long"), length - F.size("items")), "items").alias("seq"))


def tower_gradient(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray, scale: float = 10.0) -> tuple[np.ndarray, np.ndarray, float]:
    """(gradients of the two projections, loss), summed over the rows of a batch: a row's item is to beat the items of the other rows (softmax)."""
    p, q = x @ a, y @ b
    s = scale * p @ q.T
    top = s.max(1, keepdims=True)
    e = np.exp(s - top)
    total = e.sum(1, keepdims=True)
    loss = float((top[:, 0] + np.log(total[:, 0]) - np.diag(s)).sum())
    g = scale * (e / total - np.eye(len(x)))
    return x.T @ (g @ q), y.T @ (g.T @ p), loss


#: Columns of rows that are packed for towers: ids of users, vectors of users and items, and the places of each row's user and item among these.
PACKED = "ids binary, u binary, v binary, i binary, j binary, n long, wide_u int, wide_v int"
#: Users of one pack.
PACK_USERS = 2048


def pack(ids: np.ndarray, u: np.ndarray, v: np.ndarray, i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
    row = {"ids": ids.astype(np.int64).tobytes(), "u": u.tobytes(), "v": v.tobytes(), "i": i.astype(np.int32).tobytes(), "j": j.astype(np.int32).tobytes(), "n": len(i), "wide_u": u.shape[1], "wide_v": v.shape[1]}
    kinds = dict.fromkeys(row, pa.binary()) | {"n": pa.int64(), "wide_u": pa.int32(), "wide_v": pa.int32()}
    return pa.record_batch([pa.array([x], kinds[c]) for c, x in row.items()], list(row))


def matrix(column: pa.Array) -> np.ndarray:
    """An array of lists of one length, as doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def packed_rows(users: DataFrame, items: DataFrame, rows: DataFrame, seed: int = 42) -> DataFrame:
    """Rows (user_idx, item_idx) with the vectors of users (user_idx, u) and items (item_idx, v), packed by users: a vector is held once in a pack, not once for each row.

    The rows of a pack are in a drawn order, so that the batches of a pack mix its users.
    """
    packs = max(1, -(-rows.select("user_idx").distinct().count() // PACK_USERS))
    own = rows.groupBy("user_idx").agg(F.sort_array(F.collect_list(F.col("item_idx").cast("long"))).alias("items"))
    block = F.pmod(F.xxhash64(F.lit(seed), "user_idx"), F.lit(packs)).cast("int").alias("block")
    left = settled(users.where("u is not null").join(own, "user_idx").select(block, F.col("user_idx").cast("long"), F.col("u").cast("array<double>"), "items"))
    right = left.select("block", F.explode("items").alias("item_idx")).distinct().join(items.where("v is not null"), "item_idx").select(F.col("block").alias("part"), F.col("item_idx").cast("long"), F.col("v").cast("array<double>"))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not (left.num_rows and right.num_rows):
            return pa.Table.from_batches([pack(np.empty(0), np.empty((0, 1)), np.empty((0, 1)), np.empty(0), np.empty(0))]).slice(1)
        left, right = left.sort_by("user_idx").combine_chunks(), right.sort_by("item_idx").combine_chunks()
        names, lists = right["item_idx"].to_numpy(), left["items"].combine_chunks()
        item, i = lists.flatten().to_numpy(), np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
        j = np.minimum(np.searchsorted(names, item), len(names) - 1)
        there = names[j] == item
        i, j = i[there], j[there]
        mixed = np.random.default_rng([seed, left["block"][0].as_py()]).permutation(len(i))
        return pa.Table.from_batches([pack(left["user_idx"].to_numpy(), matrix(left["u"].combine_chunks()), matrix(right["v"].combine_chunks()), i[mixed], j[mixed])])

    return left.groupBy("block").cogroup(right.groupBy("part")).applyInArrow(run, PACKED)


def unpack(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, u, v, i, j) of each pack."""
    for ids, u, v, i, j, wide_u, wide_v in zip(*(b.column(c).to_pylist() for c in ("ids", "u", "v", "i", "j", "wide_u", "wide_v")), strict=True):
        yield np.frombuffer(ids, np.int64), np.frombuffer(u).reshape(-1, wide_u), np.frombuffer(v).reshape(-1, wide_v), np.frombuffer(i, np.int32), np.frombuffer(j, np.int32)


def fit_two_tower(rows: DataFrame, dim: int = 32, epochs: int = 5, rate: float = 0.05, batch: int = 256, seed: int = 42, scale: float = 10.0) -> tuple[np.ndarray, np.ndarray]:
    """Projections of user features ``u`` and item features ``v`` (arrays), trained on all rows (user_idx, item_idx, u, v)."""
    rows = rows.where("u is not null and v is not null").repartition(F.xxhash64(F.lit(seed), "user_idx", "item_idx"))
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pack(b.column(0).to_numpy(), matrix(b.column(1)), matrix(b.column(2)), np.arange(b.num_rows), np.arange(b.num_rows))

    return fit_towers(settled(rows.select(F.col("user_idx").cast("long"), F.col("u").cast("array<double>"), F.col("v").cast("array<double>")).mapInArrow(run, PACKED)), dim, epochs, rate, batch, seed, scale)


def fit_towers(packs: DataFrame, dim: int = 32, epochs: int = 5, rate: float = 0.05, batch: int = 256, seed: int = 42, scale: float = 10.0) -> tuple[np.ndarray, np.ndarray]:
    """Projections of the features of users and items, trained on all rows of a written table of packs.

    Each epoch sums the gradients of all batches in the cluster, and takes one step of
    Adam on the driver, which holds numbers of features x dimension only.
    """
    n, wide_u, wide_v = packs.agg(F.sum("n"), F.max("wide_u"), F.max("wide_v")).first()
    rng = np.random.default_rng(seed)
    shapes = [(wide_u or 1, dim), (wide_v or 1, dim)]
    towers = [rng.normal(0, 1 / np.sqrt(n_), (n_, m)) for n_, m in shapes]
    state = [(np.zeros(s), np.zeros(s)) for s in shapes]
    for epoch in range(1, epochs + 1 if n else 0):
        a, b = towers

        def run(batches: Iterator[pa.RecordBatch], a: np.ndarray = a, b: np.ndarray = b) -> Iterator[pa.RecordBatch]:
            total = np.zeros(a.size + b.size)
            for part in batches:
                for _, u, v, i, j in unpack(part):
                    for at in range(0, len(i), batch):
                        da, db, _ = tower_gradient(a, b, u[i[at : at + batch]], v[j[at : at + batch]], scale)
                        total += np.concatenate([da.ravel(), db.ravel()])
            yield pa.record_batch([pa.array(np.arange(len(total))), pa.array(total)], ["at", "g"])

        summed = packs.mapInArrow(run, "at long, g double").groupBy("at").agg(F.sum("g").alias("g")).orderBy("at").toArrow()
        g = summed["g"].to_numpy() / n
        parts = [g[: a.size].reshape(a.shape), g[a.size :].reshape(b.shape)]
        for i, d in enumerate(parts):
            m, v = state[i]
            state[i] = m, v = 0.9 * m + 0.1 * d, 0.99 * v + 0.01 * d * d
            towers[i] = towers[i] - rate * (m / (1 - 0.9**epoch)) / (np.sqrt(v / (1 - 0.99**epoch)) + 1e-9)
    return towers[0], towers[1]


def project_users(packs: DataFrame, tower: np.ndarray) -> DataFrame:
    """user_idx, embedding: ``project`` of the users of packs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, u, *_ in unpack(b):
                offsets = pa.array(np.arange(len(ids) + 1, dtype=np.int32) * tower.shape[1])
                yield pa.record_batch([pa.array(ids), pa.ListArray.from_arrays(offsets, pa.array((u @ tower).ravel()))], ["user_idx", "embedding"])

    return packs.select("ids", "u", "v", "i", "j", "wide_u", "wide_v").mapInArrow(run, "user_idx long, embedding array<double>")


def project(vectors: DataFrame, tower: np.ndarray, key: str, column: str) -> DataFrame:
    """key and embedding: the column's arrays times a tower."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1) @ tower if b.num_rows else np.empty((0, tower.shape[1]))
            offsets = pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * tower.shape[1])
            yield pa.record_batch([b.column(0), pa.ListArray.from_arrays(offsets, pa.array(x.ravel()))], [key, "embedding"])

    return vectors.select(F.col(key).cast("long"), F.col(column).cast("array<double>")).where(F.col(column).isNotNull()).mapInArrow(run, f"{key} long, embedding array<double>")


class SequenceModel(Protocol):
    """A trained sequence model: ``encode`` turns sequences (rows x length, item + 1, 0 for none) into vectors that are compared with its items'."""

    length: int

    def encode(self, sequences: np.ndarray) -> np.ndarray: ...


class SelfAttention:
    """A self-attentive sequence model with given weights, forward pass only.

    weights: ``items`` (catalogue + 1 x dim), ``places`` (length x dim), ``norm`` (gain,
    bias), and for each layer ``qkv`` (dim x 3 dim, bias), ``out`` (dim x dim, bias),
    ``norm1``, ``up`` (dim x 4 dim, bias), ``down`` (4 dim x dim, bias), ``norm2``.
    """

    def __init__(self, weights: dict, heads: int = 2) -> None:
        self.w, self.heads = weights, heads
        self.length = len(weights["places"])

    @staticmethod
    def norm(x: np.ndarray, gain: np.ndarray, bias: np.ndarray) -> np.ndarray:
        mean = x.mean(-1, keepdims=True)
        return (x - mean) / np.sqrt(((x - mean) ** 2).mean(-1, keepdims=True) + 1e-5) * gain + bias

    def attention(self, x: np.ndarray, seen: np.ndarray, layer: dict) -> np.ndarray:
        n, length, dim = x.shape
        q, k, v = np.split(x @ layer["qkv"][0] + layer["qkv"][1], 3, -1)
        split = lambda z: z.reshape(n, length, self.heads, dim // self.heads).transpose(0, 2, 1, 3)
        s = split(q) @ split(k).transpose(0, 1, 3, 2) / np.sqrt(dim // self.heads)
        s = np.where(seen[:, None], s, -1e9)
        e = np.exp(s - s.max(-1, keepdims=True))
        mixed = (e / e.sum(-1, keepdims=True)) @ split(v)
        return mixed.transpose(0, 2, 1, 3).reshape(n, length, dim) @ layer["out"][0] + layer["out"][1]

    def encode(self, sequences: np.ndarray) -> np.ndarray:
        """The vector at the last place of each sequence."""
        x = self.norm(self.w["items"][sequences] + self.w["places"], *self.w["norm"])
        # A place sees itself and the items before it.
        seen = np.tril(np.ones((self.length, self.length), bool)) & (sequences != 0)[:, None, :] | np.eye(self.length, dtype=bool)
        for layer in self.w["layers"]:
            x = self.norm(x + self.attention(x, seen, layer), *layer["norm1"])
            h = x @ layer["up"][0] + layer["up"][1]
            h = 0.5 * h * (1 + np.tanh(np.sqrt(2 / np.pi) * (h + 0.044715 * h**3)))
            x = self.norm(x + h @ layer["down"][0] + layer["down"][1], *layer["norm2"])
        return x[:, -1]


def encode_sequences(train: DataFrame, model: SequenceModel) -> DataFrame:
    """user_idx, embedding: what a sequence model makes of each user's last items."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = model.encode(b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)).astype(np.float64)
                offsets = pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * x.shape[1])
                yield pa.record_batch([b.column(0), pa.ListArray.from_arrays(offsets, pa.array(x.ravel()))], ["user_idx", "embedding"])

    return sequences(train, model.length).select(F.col("user_idx").cast("long"), "seq").mapInArrow(run, "user_idx long, embedding array<double>")
