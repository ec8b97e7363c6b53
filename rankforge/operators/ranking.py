"""Windows over users: ranks, ties, pools, histories. Every order is total, so that reruns and other engines agree."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

#: Equal ranges of values into which a global ranking is dealt.
RANGES = 1024


def by_user() -> WindowSpec:
    """The rows of a user. A function, as windows need a running session and modules must not."""
    return Window.partitionBy("user_idx")



def tie_key(seed: int, *cols: str) -> Column:
    """A reproducible draw: the md5 text of seed and ids. It replaces random draws by row order."""
    return F.md5(F.concat_ws(":", F.lit(seed), *[F.col(c).cast("string") for c in cols]))


def draw(seed: int, modulus: Column | int, *cols: str) -> Column:
    """A number below the modulus from the first 32 bits of the tie key."""
    return F.conv(F.substring(tie_key(seed, *cols), 1, 8), 16, 10).cast("long") % modulus


def positions(df: DataFrame, bucket: Column, order: Sequence[Column | str], name: str) -> DataFrame:
    """1-based positions in a global order, without sorting everything in one task.

    ``bucket`` must rise with the order. Rows before a bucket are counted by bucket
    (few rows), the place inside it is a window over the bucket.
    """
    df = df.withColumn("__bucket", bucket)
    counts = df.groupBy("__bucket").agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("__bucket", before.alias("__before"))
    inside = F.row_number().over(Window.partitionBy("__bucket").orderBy(*order))
    return df.withColumn("__at", inside).join(counts, "__bucket").withColumn(name, F.col("__before") + F.col("__at")).drop("__bucket", "__at", "__before")


def dense_index(ids: DataFrame, column: str, name: str, buckets: int = 256) -> DataFrame:
    """column and its 0-based place among the distinct ids; numbers in equal ranges, texts by their first two characters."""
    ids = ids.select(column).where(F.col(column).isNotNull()).distinct()
    if dict(ids.dtypes)[column] == "string":
        bucket = F.substring(column, 1, 2)
    else:
        low, high = ids.agg(F.min(column), F.max(column)).first()
        bucket = F.floor((F.col(column) - F.lit(low or 0)) / F.lit(max(1, ((high or 0) - (low or 0)) // buckets + 1)))
    return positions(ids, bucket, [column], name).withColumn(name, F.col(name) - 1)


def rank_scored(scored: DataFrame, seed: int | None = 42, name: str = "rank") -> DataFrame:
    """Rank by falling score within a user; ties by draw (seed) or by item."""
    tie = [F.col("item_idx")] if seed is None else [tie_key(seed, "user_idx", "item_idx"), F.col("item_idx")]
    return scored.withColumn(name, F.row_number().over(by_user().orderBy(F.desc("score"), *tie)))


def top(scored: DataFrame, n: int, seed: int | None = None) -> DataFrame:
    return rank_scored(scored, seed).where(F.col("rank") <= n)


def limit_candidates(pool: DataFrame, k: int) -> DataFrame:
    """The first k candidates of each user, positives always kept.

    With k positives or more: the first k of them. Else the first k rows, of which the
    last negatives make room for positives further down. Without labels: the first k rows.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    if "label" not in pool.columns:
        return pool.where(F.col("pool_pos") <= k)
    positive, head = F.col("label") == 1, F.col("__at") <= k
    df = pool.withColumn("__at", F.row_number().over(by_user().orderBy("pool_pos")))
    df = df.withColumn("__pos", F.sum(positive.cast("int")).over(by_user())).withColumn("__late", F.sum((positive & ~head).cast("int")).over(by_user()))
    df = df.withColumn("__nth", F.sum(positive.cast("int")).over(by_user().orderBy("__at")))
    after = F.sum((~positive & head).cast("int")).over(by_user().orderBy(F.desc("__at")))
    df = df.withColumn("__back", after)
    keep = F.when(F.col("__pos") >= k, positive & (F.col("__nth") <= k)).otherwise((head & (positive | (F.col("__back") > F.col("__late")))) | (positive & ~head))
    df = df.where(keep).withColumn("pool_pos", F.row_number().over(by_user().orderBy("__at")))
    return df.select(*pool.columns)


def recent(log: DataFrame, n: int) -> DataFrame:
    """The last n interactions of each user; ``back`` is 1 for the latest."""
    return log.withColumn("back", F.row_number().over(by_user().orderBy(F.desc("ts"), F.desc("pos")))).where(F.col("back") <= n)


def recent_items(log: DataFrame, n: int) -> DataFrame:
    """user_idx and its last n items, oldest first."""
    rows = recent(log, n).groupBy("user_idx").agg(F.sort_array(F.collect_list(F.struct((-F.col("back")).alias("at"), "item_idx"))).alias("h"))
    return rows.select("user_idx", F.col("h.item_idx").alias("items"))


def last_item(log: DataFrame) -> DataFrame:
    return log.groupBy("user_idx").agg(F.max_by("item_idx", F.struct("ts", "pos")).alias("last_item"))


def transitions(log: DataFrame) -> DataFrame:
    """(item_from, item_to, n): adjacent items of a user's history."""
    nxt = F.lead("item_idx").over(by_user().orderBy("ts", "pos"))
    return log.select(F.col("item_idx").alias("item_from"), nxt.alias("item_to"), "user_idx").where("item_to is not null").groupBy("item_from", "item_to").agg(F.count(F.lit(1)).alias("n"))


def percentile_rank(df: DataFrame, column: str, name: str, by: str | None = "user_idx") -> DataFrame:
    """Average-tie rank as a percentage of the number of rows, by user or over all rows."""
    if by is not None:
        w = Window.partitionBy(by)
        ties = Window.partitionBy(by, column)
        return df.withColumn(name, (F.rank().over(w.orderBy(column)) + (F.count(F.lit(1)).over(ties) - 1) / 2) / F.count(F.lit(1)).over(w) * 100)
    # Over all rows: ranks of the distinct values, numbered within equal ranges of the values.
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("__n"))
    ends = counts.agg(F.min(column).cast("double").alias("__lo"), F.max(column).cast("double").alias("__hi"), F.sum("__n").alias("__total"))
    place = F.when(F.col("__hi") > F.col("__lo"), F.floor((F.col(column) - F.col("__lo")) / (F.col("__hi") - F.col("__lo")) * RANGES)).otherwise(0)
    counts = counts.join(F.broadcast(ends)).withColumn("__range", place)
    ranges = counts.groupBy("__range").agg(F.sum("__n").alias("__m"))
    ranges = ranges.select("__range", F.coalesce(F.sum("__m").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    inside = F.coalesce(F.sum("__n").over(Window.partitionBy("__range").orderBy(column).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranks = counts.withColumn("__inside", inside).join(ranges, "__range")
    ranks = ranks.select(column, ((F.col("__before") + F.col("__inside") + (F.col("__n") + 1) / 2) / F.col("__total") * 100).alias(name))
    return df.join(ranks, column)


def minmax(df: DataFrame, column: str, name: str) -> DataFrame:
    """Scaled to 0..1 within a user; 0 where all values are equal."""
    low, high = F.min(column).over(by_user()), F.max(column).over(by_user())
    return df.withColumn(name, F.when(high <= low, 0.0).otherwise((F.col(column) - low) / (high - low)))


def zscore(df: DataFrame, column: str, name: str) -> DataFrame:
    return df.withColumn(name, (F.col(column) - F.avg(column).over(by_user())) / (F.stddev_pop(column).over(by_user()) + 1e-8))


def best_worst(scored: DataFrame, gold: DataFrame) -> DataFrame:
    """user_idx, best and worst rank of the gold item under ties; users whose gold has no score drop out."""
    df = scored.join(gold.select("user_idx", "true_item"), "user_idx")
    own = F.max(F.when(F.col("item_idx") == F.col("true_item"), F.col("score"))).over(by_user())
    df = df.withColumn("own", own).where("own is not null")
    return df.groupBy("user_idx").agg((F.sum((F.col("score") > F.col("own")).cast("int")) + 1).alias("best"), F.sum((F.col("score") >= F.col("own")).cast("int")).alias("worst"))


def gate_features(ranked: DataFrame) -> DataFrame:
    """user_idx, top score, margin to the second, entropy of the softmax."""
    df = ranked.withColumn("__e", F.exp(F.col("score") - F.max("score").over(by_user())))
    df = df.withColumn("__p", F.col("__e") / F.sum("__e").over(by_user()))
    first = F.max(F.when(F.col("rank") == 1, F.col("score")))
    second = F.max(F.when(F.col("rank") == 2, F.col("score")))
    return df.groupBy("user_idx").agg(first.alias("top"), F.coalesce(first - second, F.lit(0.0)).alias("margin"), (-F.sum(F.col("__p") * F.log(F.col("__p") + 1e-12))).alias("entropy"))


def exclude(rows: DataFrame, seen: DataFrame) -> DataFrame:
    """Rows without the (user, item) pairs that were seen."""
    return rows.join(seen.select("user_idx", "item_idx").distinct(), ["user_idx", "item_idx"], "left_anti")


def sample_users(users: DataFrame, n: int, seed: int = 42) -> DataFrame:
    return users.select("user_idx").distinct().orderBy(tie_key(seed, "user_idx"), "user_idx").limit(n)


def first_users(pool: DataFrame, n: int) -> DataFrame:
    """The first n distinct users in pool order."""
    return pool.groupBy("user_idx").agg(F.min("pool_pos").alias("at")).orderBy("at", "user_idx").limit(n).select("user_idx")
