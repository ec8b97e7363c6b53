"""Scores of a given candidate pool, and the edge tables that retrievers share.

Matrices are edge tables; products are joins and sums. Sums are rounded to nine
digits before anything is ranked by them, so that the order does not hang on the
order of additions.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rankforge.functions.columns import bigrams, tokens
from rankforge.operators.ranking import minmax, recent
from rankforge.operators.trainers import settled

DIGITS = 9
#: Items of a history that meet each other under one key.
PART = 2048
#: Bytes of vectors that may be sent to all tasks.
VECTOR_BYTES = 4 << 20


def weights(train: DataFrame) -> DataFrame:
    """user_idx, item_idx, w: how often a user had an item."""
    return train.groupBy("user_idx", "item_idx").agg(F.count(F.lit(1)).cast("double").alias("w"))


def gather(pool: DataFrame, scores: DataFrame) -> DataFrame:
    """pool with the scores of its pairs; pairs without one have 0."""
    return pool.join(scores.select("user_idx", "item_idx", "score"), ["user_idx", "item_idx"], "left").na.fill(0.0, ["score"])


def popularity(pool: DataFrame, train: DataFrame) -> DataFrame:
    counts = train.groupBy("item_idx").agg(F.count(F.lit(1)).cast("double").alias("score"))
    return pool.join(counts, "item_idx", "left").na.fill(0.0, ["score"])


def pairs(w: DataFrame, part: int = PART) -> DataFrame:
    """item_i < item_j, wi, wj: each pair of a user's items (user_idx, item_idx, w) once.

    A history beyond ``part`` items is dealt into parts, and each pair of parts is a
    key of its own, so a heavy user's pairs are many tasks' work.
    """
    sizes = w.groupBy("user_idx").agg(F.ceil(F.count(F.lit(1)) / part).cast("int").alias("__parts"))
    dealt = w.join(sizes, "user_idx").withColumn("__own", F.pmod(F.xxhash64("item_idx"), F.col("__parts")).cast("int"))
    side = lambda low, high, n: dealt.select("user_idx", F.col("item_idx").alias(f"item_{n}"), F.col("w").alias(f"w{n}"), F.col("__own").alias(f"__p{n}"), F.explode(F.sequence(low, high)).alias("__with"))
    # Parts p <= q meet in the key (p, q): the left side goes to all q from its own on, the right side to all p up to its own.
    left = side(F.col("__own"), F.col("__parts") - 1, "a").withColumnsRenamed({"__pa": "__p", "__with": "__q"})
    right = side(F.lit(0), F.col("__own"), "b").withColumnsRenamed({"__pb": "__q", "__with": "__p"})
    met = left.join(right, ["user_idx", "__p", "__q"]).where("__p < __q or item_a < item_b")
    low = F.col("item_a") < F.col("item_b")
    pick = lambda a, b, name: F.when(low, F.col(a)).otherwise(F.col(b)).alias(name)
    return met.select(pick("item_a", "item_b", "item_i"), pick("item_b", "item_a", "item_j"), pick("wa", "wb", "wi"), pick("wb", "wa", "wj"))


#: Rows of histories for each block of items, and products that are summed at a time.
ROWS, SUMMED = 1 << 18, 1 << 20


def slot(column: Column, marks: list[int], low: int = 0, high: int | None = None) -> Column:
    """How many of the sorted marks are at most the value; a tree of comparisons."""
    high = len(marks) if high is None else high
    if low == high:
        return F.lit(low)
    mid = (low + high) // 2
    return F.when(column < marks[mid], slot(column, marks, low, mid)).otherwise(slot(column, marks, mid + 1, high))


def neighbours(train: DataFrame, k: int = 100) -> DataFrame:
    """item_i, to, sim (arrays): cosine of item columns; of each item_i the k most similar, ties at the k-th place included.

    Pairs, far more than histories, do not move: the catalogue is cut into ranges with
    about as many history rows each, and a range gets the histories of all users who
    have one of its items, in parts of at most PART items. It sums its own items' rows.
    """
    w = settled(weights(train))
    blocks = max(1, min(1024, -(-w.count() // ROWS)))
    marks = sorted({int(x) for x in w.approxQuantile("item_idx", [i / blocks for i in range(1, blocks)], 0.1 / blocks)}) if blocks > 1 else []
    norms = w.groupBy("item_idx").agg((F.sqrt(F.sum(F.col("w") * F.col("w"))) + 1e-8).alias("norm"))
    rows = w.join(norms, "item_idx").repartition("user_idx")
    rows = rows.withColumn("__parts", F.ceil(F.count(F.lit(1)).over(Window.partitionBy("user_idx")) / PART).cast("int"))
    rows = rows.select("user_idx", slot(F.col("item_idx"), marks).cast("int").alias("block"), F.pmod(F.xxhash64("item_idx"), F.col("__parts")).cast("int").alias("part"), F.struct(F.col("item_idx").cast("long").alias("item"), "w", "norm").alias("e"))
    lists = rows.groupBy("user_idx", "part").agg(F.collect_list("e").alias("e"))
    met = rows.groupBy("user_idx").agg(F.collect_set("block").alias("blocks"))
    lists = lists.join(met, "user_idx").select(F.explode("blocks").alias("block"), F.col("user_idx").cast("long").alias("user"), F.col("e.item").alias("item"), F.col("e.w").alias("w"), F.col("e.norm").alias("norm"))
    digits, summed = DIGITS, SUMMED  # workers need not import this module

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        block = table["block"][0].as_py()
        flat = lambda c: np.concatenate([x.flatten().to_numpy(zero_copy_only=False) for x in table[c].chunks])
        sizes = np.concatenate([x.value_lengths().to_numpy(zero_copy_only=False) for x in table["item"].chunks]).astype(np.int64)
        user, item, w, norm = np.repeat(table["user"].to_numpy(), sizes), flat("item"), flat("w"), flat("norm")
        by = np.argsort(user, kind="stable")
        user, item, w, norm = user[by], item[by], w[by], norm[by]
        first = np.flatnonzero(np.r_[True, user[1:] != user[:-1]])
        length = np.diff(np.append(first, len(user)))
        at = np.repeat(np.arange(len(first)), length)
        names, one, column = np.unique(item, return_index=True, return_inverse=True)
        norms, m = norm[one], len(names)
        # Rows of the range's own items, item by item; each makes as many products as its user has items.
        inside = np.searchsorted(np.array(marks, np.int64), names, "right") == block
        own = np.flatnonzero(inside[column])
        own = own[np.argsort(column[own], kind="stable")]
        made = length[at[own]]
        start = np.flatnonzero(np.r_[True, column[own][1:] != column[own][:-1]])
        end = np.append(start[1:], len(own))
        done = np.append(0, np.cumsum(made))

        def products(a: int, z: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """(row's own item, other item, product) of rows a to z."""
            k, r = made[a:z], own[a:z]
            index = np.repeat(first[at[r]] - (np.cumsum(k) - k), k) + np.arange(int(k.sum()))
            return np.repeat(column[r], k), column[index], np.repeat(w[r], k) * w[index]

        out, a = [], 0
        while a < len(start):
            z = max(a + 1, int(np.searchsorted(done[end], done[start[a]] + summed, "right")))
            if z == a + 1 and done[end[a]] - done[start[a]] > summed:
                # One item of many products: they are added up in steps.
                dot, r = np.zeros(m), int(start[a])
                while r < end[a]:
                    stop = min(int(end[a]), max(r + 1, int(np.searchsorted(done, done[r] + summed, "right")) - 1))
                    _, j, x = products(r, stop)
                    dot += np.bincount(j, x, m)
                    r = stop
                j = np.flatnonzero(dot)
                i, dot = np.full(len(j), column[own[start[a]]]), dot[j]
            else:
                i, j, x = products(int(start[a]), int(end[z - 1]))
                keys, where = np.unique(i * m + j, return_inverse=True)
                dot, i, j = np.bincount(where, x, len(keys)), keys // m, keys % m
            sim = np.round(dot / norms[i] / norms[j], digits)
            keep = (i != j) & (sim > 0)
            i, j, sim = i[keep], j[keep], sim[keep]
            edge = np.flatnonzero(np.r_[True, i[1:] != i[:-1]]) if len(i) else np.empty(0, np.int64)
            stay = np.ones(len(i), bool)
            for lo, hi in zip(edge.tolist(), np.append(edge[1:], len(i)).tolist(), strict=True):
                if hi - lo > k:
                    s = sim[lo:hi]
                    stay[lo:hi] = s >= np.partition(s, hi - lo - k)[hi - lo - k]
            out.append((i[stay], names[j[stay]], sim[stay]))
            a = z
        i, to, sim = (np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        edge = np.flatnonzero(np.r_[True, i[1:] != i[:-1]]) if len(i) else np.empty(0, np.int64)
        offsets = pa.array(np.append(edge, len(i)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (to, sim)]
        return pa.table([pa.array(names[i[edge]]), *lists], ["item_i", "to", "sim"])

    return lists.groupBy("block").applyInArrow(run, "item_i long, to array<long>, sim array<double>")


def edge_rows(lists: DataFrame) -> DataFrame:
    """item_i, item_j, sim of ``neighbours``."""
    return lists.select("item_i", F.explode(F.arrays_zip("to", "sim")).alias("e")).select("item_i", F.col("e.to").alias("item_j"), F.col("e.sim").alias("sim"))


def item_similarity(train: DataFrame, k: int = 100) -> DataFrame:
    """item_i, item_j, sim: the edges of ``neighbours`` as rows."""
    return edge_rows(neighbours(train, k))


def large(df: DataFrame) -> DataFrame:
    """df, for a join that moves both sides: it grows with the input, and estimates from compressed files would send it through the driver to all tasks."""
    return df.hint("merge")


def expand(history: DataFrame, edges: DataFrame, source: str, target: str, value: str) -> DataFrame:
    """user_idx, item_idx, score: edges summed over a history (user_idx, item_idx, w)."""
    e = edges.select(F.col(source).alias("item_idx"), F.col(target).alias("__to"), F.col(value).alias("__v"))
    scores = history.join(e, "item_idx").groupBy("user_idx", "__to").agg(F.round(F.sum(F.col("w") * F.col("__v")), DIGITS).alias("score"))
    return scores.select("user_idx", F.col("__to").alias("item_idx"), "score")


def itemknn(pool: DataFrame, train: DataFrame, k: int = 100, edges: DataFrame | None = None) -> DataFrame:
    """Only the pool's users and the edges into its items take part in the sum. edges: ``item_similarity``, where it has been written before."""
    edges = item_similarity(train, k) if edges is None else edges
    users = weights(train).join(pool.select("user_idx").distinct(), "user_idx", "left_semi")
    return gather(pool, expand(users, edges, "item_i", "item_j", "sim"))


def markov_edges(train: DataFrame) -> DataFrame:
    """item_from, item_to, p."""
    from rankforge.operators.ranking import transitions

    t = transitions(train)
    return t.withColumn("p", F.round(F.col("n") / (F.sum("n").over(Window.partitionBy("item_from")) + 1e-8), DIGITS))


def markov(pool: DataFrame, train: DataFrame) -> DataFrame:
    """P(item | last item); 0 without a history."""
    from rankforge.operators.ranking import last_item

    edges = markov_edges(train).select(F.col("item_from").alias("last_item"), F.col("item_to").alias("item_idx"), F.col("p").alias("score"))
    return pool.join(last_item(train), "user_idx", "left").join(edges, ["last_item", "item_idx"], "left").na.fill(0.0, ["score"]).drop("last_item")


def tfidf_vectors(items: DataFrame, features: int = 50_000) -> DataFrame:
    """item_idx, term, x: unit vectors of words and word pairs; the most frequent terms of the corpus; empty texts count for the idf."""
    words = items.select("item_idx", tokens(F.col("text")).alias("__w"))
    terms = words.select("item_idx", F.explode(F.concat("__w", bigrams(F.col("__w")))).alias("term")).groupBy("item_idx", "term").agg(F.count(F.lit(1)).alias("tf"))
    vocabulary = terms.groupBy("term").agg(F.sum("tf").alias("total"), F.count(F.lit(1)).alias("df")).orderBy(F.desc("total"), "term").limit(features)
    n = items.agg(F.count(F.lit(1)).alias("n"))
    vocabulary = vocabulary.join(F.broadcast(n)).select("term", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))
    x = terms.join(vocabulary, "term").withColumn("x", F.col("tf") * F.col("idf"))
    norms = x.groupBy("item_idx").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    return x.join(large(norms), "item_idx").select("item_idx", "term", (F.col("x") / F.col("norm")).alias("x"))


def tfidf_profiles(vectors: DataFrame, history: DataFrame) -> DataFrame:
    """user_idx, term, x: unit sum of the vectors of a user's history rows."""
    p = history.select("user_idx", "item_idx").join(large(vectors), "item_idx").groupBy("user_idx", "term").agg(F.sum("x").alias("x"))
    norms = p.groupBy("user_idx").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    return p.join(large(norms), "user_idx").select("user_idx", "term", (F.col("x") / F.col("norm")).alias("x"))


def tfidf(pool: DataFrame, train: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    vectors = tfidf_vectors(items)
    profiles = tfidf_profiles(vectors, recent(train, window))
    pairs = pool.select("user_idx", "item_idx").join(vectors, "item_idx").join(profiles.withColumnRenamed("x", "y"), ["user_idx", "term"])
    return gather(pool, pairs.groupBy("user_idx", "item_idx").agg(F.round(F.sum(F.col("x") * F.col("y")), DIGITS).alias("score")))


def unit_vectors(vectors: DataFrame) -> DataFrame:
    """item_idx, pos, x: components of the embeddings, scaled to length 1; zero vectors have none."""
    flat = vectors.select("item_idx", F.posexplode("embedding").alias("at", "x")).withColumn("x", F.col("x").cast("double"))
    norms = flat.groupBy("item_idx").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm")).where("norm > 0")
    return flat.join(norms, "item_idx").select("item_idx", "at", (F.col("x") / F.col("norm")).alias("x"))


def user_profiles(vectors: DataFrame, history: DataFrame) -> DataFrame:
    """user_idx, at, x: mean vector of the history, scaled to length 1."""
    mean = history.select("user_idx", "item_idx").join(vectors, "item_idx").groupBy("user_idx", "at").agg(F.avg("x").alias("x"))
    norms = mean.groupBy("user_idx").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm")).where("norm > 0")
    return mean.join(norms, "user_idx").select("user_idx", "at", (F.col("x") / F.col("norm")).alias("x"))


def unit_rows(vectors: DataFrame) -> DataFrame:
    """item_idx, v: as unit_vectors, one array for each item, and nothing moves. A filter may be asked after the division, so 0 divides nothing."""
    x = vectors.select("item_idx", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    x = x.withColumn("__norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + F.coalesce(x * x, F.lit(0.0))))).where("__norm > 0")
    return x.select("item_idx", F.transform("v", lambda x: x / F.nullif(F.col("__norm"), F.lit(0.0))).alias("v"))


def profiles(unit: DataFrame, history: DataFrame) -> DataFrame:
    """user_idx, u: as user_profiles of unit_rows, as arrays. Few vectors go to where the users are; rows of a user meet once."""
    first = unit.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("m")).first()
    unit = F.broadcast(unit) if first["n"] * 8 * (first["m"] or 0) <= VECTOR_BYTES else unit
    mean = history.select("user_idx", "item_idx").repartition("user_idx").join(unit, "item_idx").select("user_idx", F.posexplode("v").alias("at", "x")).groupBy("user_idx", "at").agg(F.avg("x").alias("x"))
    u = dense(mean, "user_idx", "u").withColumn("__norm", F.sqrt(F.aggregate("u", F.lit(0.0), lambda a, x: a + F.coalesce(x * x, F.lit(0.0))))).where("__norm > 0")
    return u.select("user_idx", F.transform("u", lambda x: x / F.nullif(F.col("__norm"), F.lit(0.0))).alias("u"))


def dense(components: DataFrame, key: str, name: str = "v") -> DataFrame:
    """Components (key, at, x) as arrays."""
    rows = components.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("at", "x"))).alias("__c"))
    return rows.select(key, F.col("__c.x").alias(name))


def embedding(pool: DataFrame, train: DataFrame, vectors: DataFrame, window: int = 10) -> DataFrame:
    """Dot product of the user's profile (last ``window`` items) and the item."""
    from rankforge.functions.columns import dot

    unit = unit_vectors(vectors)
    users, items = dense(user_profiles(unit, recent(train, window)), "user_idx", "u"), dense(unit, "item_idx", "v")
    df = pool.join(users, "user_idx", "left").join(items, "item_idx", "left")
    return df.withColumn("score", F.coalesce(F.round(dot(F.col("u"), F.col("v")), DIGITS), F.lit(0.0))).drop("u", "v")


def graph_aware(pool: DataFrame, semantic: DataFrame, graph: DataFrame, base: DataFrame, pop: DataFrame, stats: DataFrame, alpha: float = 0.5, beta: float = 0.45, gamma: float = 0.30, penalty: float = 0.10, tail_boost: float = 0.05) -> DataFrame:
    """Weighted sum of per-user scaled scores, less popularity, with a bonus for tail items; missing scores are 0."""
    df = pool.select("user_idx", "item_idx")
    for name, scored in (("semantic", semantic), ("graph", graph), ("base", base), ("popularity", pop)):
        df = minmax(gather(df, scored).withColumnRenamed("score", "__s"), "__s", name).drop("__s")
    df = df.join(stats.select("item_idx", "is_tail"), "item_idx", "left").withColumn("tail_bonus", F.coalesce(F.col("is_tail"), F.lit(False)).cast("double") * tail_boost)
    score = alpha * F.col("semantic") + beta * F.col("graph") + gamma * F.col("base") - penalty * F.col("popularity") + F.col("tail_bonus")
    return df.withColumn("score", F.round(score, DIGITS)).drop("is_tail")
