"""Fusion and allocation of retrieved pools in long form (user_idx, item_idx, rank, model).

All operators are one primitive: give every (user, item, model) row a priority, keep
an item's best, number a user's rows by it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankforge.operators.ranking import by_user

#: Components and budgets (fixed values).
COMPONENTS = ("lightgcn", "itemknn", "sbert", "popularity")
CARA_COLD = {"sbert": 0.35, "tfidf": 0.20, "itemknn": 0.20, "lightgcn": 0.15, "popularity": 0.10}
CARA_WARM = {"lightgcn": 0.60, "itemknn": 0.15, "popularity": 0.10, "sbert": 0.10, "tfidf": 0.05}
CF_MODELS = ("lightgcn", "itemknn", "bpr", "sasrec")


def ordinal(models: Sequence[str]) -> Column:
    """A model's place in a list; null for others."""
    out = F
    for i, m in enumerate(models):
        out = out.when(F.col("model") == m, i)
    return out


def by_priority(rows: DataFrame, priority: Sequence[Column], n: int | None) -> DataFrame:
    """user_idx, item_idx, rank by the least priority of each item; the first n if given."""
    first = rows.groupBy("user_idx", "item_idx").agg(F.min(F.struct(*[p.alias(f"p{i}") for i, p in enumerate(priority)])).alias("__p"))
    ranked = first.withColumn("rank", F.row_number().over(by_user().orderBy("__p", "item_idx")))
    return (ranked if n is None else ranked.where(F.col("rank") <= n)).select("user_idx", "item_idx", "rank")


def rrf(pools: DataFrame, models: Sequence[str], n: int, k: int = 60) -> DataFrame:
    """Sum of 1 / (k + rank); ties by the first component that lists the item, then by its rank there."""
    rows = pools.withColumn("__o", ordinal(models)).where("__o is not null")
    s = rows.groupBy("user_idx", "item_idx").agg(F.round(F.sum(1 / (k + F.col("rank"))), 12).alias("score"), F.min(F.struct("__o", "rank")).alias("__first"))
    ranked = s.withColumn("rank", F.row_number().over(by_user().orderBy(F.desc("score"), "__first")))
    return ranked.where(F.col("rank") <= n).select("user_idx", "item_idx", "score", "rank")


def interleave(pools: DataFrame, models: Sequence[str], n: int) -> DataFrame:
    """Round robin by rank, then component."""
    rows = pools.withColumn("__o", ordinal(models)).where("__o is not null")
    return by_priority(rows, [F.col("rank"), F.col("__o")], n)


def cara(pools: DataFrame, users: DataFrame, n: int, cold: Mapping[str, float] = CARA_COLD, warm: Mapping[str, float] = CARA_WARM) -> DataFrame:
    """Budgets by regime: each component gives its share of n, largest share first; then all go on in the same order to fill up.

    users: user_idx, user_cold. A budget counts list places, so items that an earlier
    component gave already use it up.
    """
    spark = pools.sparkSession
    rows = [(is_cold, m, i, max(1, round(share * n))) for is_cold, profile in ((True, cold), (False, warm)) for i, (m, share) in enumerate(sorted(profile.items(), key=lambda p: -p[1]))]
    profile = spark.createDataFrame(rows, "user_cold boolean, model string, ord int, budget int")
    joined = pools.join(users.select("user_idx", "user_cold"), "user_idx").join(F.broadcast(profile), ["user_cold", "model"])
    return by_priority(joined, [F.when(F.col("rank") <= F.col("budget"), 0).otherwise(1), F.col("ord"), F.col("rank")], n)


def apply_quota(pools: DataFrame, quota: Mapping[str, int]) -> DataFrame:
    """The first q of each model, each item once; neither filled up nor cut."""
    spark = pools.sparkSession
    table = spark.createDataFrame([(m, int(q), i) for i, (m, q) in enumerate(quota.items())], "model string, quota int, ord int")
    rows = pools.join(F.broadcast(table), "model").where(F.col("rank") <= F.col("quota"))
    return by_priority(rows, [F.col("ord"), F.col("rank")], None)


def quota_grid(models: Sequence[str], n: int, step: int) -> list[dict[str, int]]:
    """All shares in multiples of step that sum to n; equal shares if there are none."""
    units = n // step
    cuts = combinations(range(units + len(models) - 1), len(models) - 1) if n % step == 0 else ()
    grid = [{m: (b - a - 1) * step for m, a, b in zip(models, (-1, *c), (*c, units + len(models) - 1), strict=True)} for c in cuts]
    return grid or [{m: n // len(models) for m in models}]


def preset_quotas(models: Sequence[str], n: int) -> dict[str, dict[str, int]]:
    """equal, cf_heavy and text_heavy (70 : 30); all that is not collaborative counts as text."""
    cf, text = [m for m in models if m in CF_MODELS], [m for m in models if m not in CF_MODELS]
    out = {"equal": {m: n // len(models) for m in models}}
    if cf and text:
        for name, share in (("cf_heavy", 0.7), ("text_heavy", 0.3)):
            out[name] = {m: int(n * share) // len(cf) for m in cf} | {m: int(n * (1 - share)) // len(text) for m in text}
    return out


def quota_coverage(pools: DataFrame, gold: DataFrame, grid: Sequence[Mapping[str, int]], by: str | None = None) -> DataFrame:
    """quota_id (and ``by``), coverage, n_users: only the gold item's rank in each pool is needed, not the lists."""
    spark = pools.sparkSession
    table = spark.createDataFrame([(i, m, int(q)) for i, g in enumerate(grid) for m, q in g.items()], "quota_id int, model string, quota int")
    keys = ["quota_id", *([by] if by else [])]
    users = gold.select("user_idx", "true_item", *([by] if by else []))
    ranks = pools.join(users, (pools["user_idx"] == users["user_idx"]) & (pools["item_idx"] == users["true_item"])).select(users["user_idx"], "model", "rank", *([by] if by else []))
    hits = ranks.join(F.broadcast(table), "model").where(F.col("rank") <= F.col("quota")).groupBy(*keys).agg(F.count_distinct("user_idx").alias("hits"))
    total = users.groupBy(*([by] if by else [])).agg(F.count(F.lit(1)).alias("n_users"))
    ids = table.select("quota_id").distinct()
    base = ids.join(F.broadcast(total))
    return base.join(hits, keys, "left").select(*keys, (F.coalesce("hits", F.lit(0)) / F.col("n_users")).alias("coverage"), "n_users")


def tuned_quota(coverage: DataFrame, by: str | None = None) -> DataFrame:
    """The best quota (of each group): highest coverage, first of equals."""
    rows = coverage.groupBy(*([by] if by else [])).agg(F.max_by("quota_id", F.struct("coverage", -F.col("quota_id"))).alias("quota_id"), F.max("coverage").alias("coverage"))
    return rows


def quota_union(history: DataFrame, intent: DataFrame, n: int, q: int) -> DataFrame:
    """n - q items by history, then intent, then what history has left."""
    rows = history.select("user_idx", "item_idx", "rank", F.when(F.col("rank") <= n - q, 0).otherwise(2).alias("phase"))
    rows = rows.unionByName(intent.select("user_idx", "item_idx", "rank", F.lit(1).alias("phase")))
    return by_priority(rows, [F.col("phase"), F.col("rank")], n)


def union(pools: DataFrame) -> DataFrame:
    return pools.select("user_idx", "item_idx").distinct()
