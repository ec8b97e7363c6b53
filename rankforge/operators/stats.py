"""Intervals and paired tests. Counts and resampled means come from Spark."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankforge.functions.columns import discount, mcnemar, student_t_two_sided, wilson
from rankforge.schema import K_LIST

#: Where the cumulated Poisson probabilities of mean 1 lie on a scale of 16 bits.
POISSON = tuple(math.floor(65_536 * sum(math.exp(-1) / math.factorial(i) for i in range(k + 1))) for k in range(8))


def per_user(ranks: DataFrame, k_list: Sequence[int] = K_LIST) -> DataFrame:
    """user_idx and its recall, ndcg and mrr at each k."""
    out = []
    for k in k_list:
        hit = F.coalesce(F.col("rank") <= k, F.lit(False))
        out += [hit.cast("double").alias(f"recall_at_{k}"), F.when(hit, discount(F.col("rank"))).otherwise(0.0).alias(f"ndcg_at_{k}"), F.when(hit, 1 / F.col("rank")).otherwise(0.0).alias(f"mrr_at_{k}")]
    return ranks.select("user_idx", *out)


def weight(replicate: Column, key: str = "user_idx", seed: int = 42) -> Column:
    """How often a user counts in a replicate: a Poisson number of mean 1 from 16 bits of the md5 text of seed, user and every eighth replicate."""
    text = F.md5(F.concat_ws(":", F.lit(seed), F.col(key).cast("string"), F.floor(replicate / 8).cast("string")))
    return _poisson(F.substring(text, (F.pmod(replicate, F.lit(8)) * 4 + 1).cast("int"), F.lit(4)))


def _poisson(digits: Column) -> Column:
    """The weight of 16 bits, given as four hex digits, which compare as their numbers do."""
    out = F
    for i, x in enumerate(POISSON):
        out = out.when(digits < f"{x:04x}", i)
    return out.otherwise(len(POISSON))


def bootstrap(values: DataFrame, n_boot: int = 1000, level: float = 0.95, seed: int = 42) -> DataFrame:
    """metric, mean, ci_lo, ci_hi, n_users of the columns besides user_idx.

    All replicates are one aggregation, at any number of users: users are dealt to
    replicates with Poisson weights, sums are combined before they are shuffled, and a
    replicate's value is the weighted mean. Equal weights for a user in every run. Eight
    replicates share an md5 text and a row, so a user makes an eighth as many of both.
    """
    names = [c for c in values.columns if c != "user_idx"]
    rows = values.withColumn("__g", F.explode(F.sequence(F.lit(0), F.lit((n_boot - 1) // 8)))).withColumn("__text", F.md5(F.concat_ws(":", F.lit(seed), F.col("user_idx").cast("string"), F.col("__g").cast("string"))))
    rows = rows.select("__g", *names, *[_poisson(F.substring("__text", 4 * i + 1, 4)).alias(f"__w{i}") for i in range(8)])
    sums = rows.groupBy("__g").agg(*[F.sum(f"__w{i}").alias(f"__n{i}") for i in range(8)], *[F.sum(F.col(f"__w{i}") * F.col(c)).alias(f"__s{i}_{j}") for i in range(8) for j, c in enumerate(names)])
    each = F.array(*[F.struct((F.col("__g") * 8 + i).alias("b"), F.col(f"__n{i}").alias("w"), *[F.col(f"__s{i}_{j}").alias(f"s{j}") for j in range(len(names))]) for i in range(8)])
    means = sums.select(F.explode(each).alias("r")).where(f"r.b < {int(n_boot)} and r.w > 0").select(*[(F.col(f"r.s{j}") / F.col("r.w")).alias(c) for j, c in enumerate(names)])
    ends = means.agg(*[F.percentile(c, [(1 - level) / 2, (1 + level) / 2]).alias(c) for c in names])
    centre = values.agg(F.count(F.lit(1)).alias("n_users"), *[F.avg(c).alias(f"__m_{c}") for c in names]).where("n_users > 0")
    out = centre.join(F.broadcast(ends))
    rows = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(f"__m_{c}").alias("mean"), F.col(c)[0].alias("ci_lo"), F.col(c)[1].alias("ci_hi")) for c in names])
    return out.select("n_users", F.explode(rows).alias("r")).select("r.*", "n_users")


def with_wilson(df: DataFrame, hits: str, n: str, digits: int = 6) -> DataFrame:
    low, high = wilson(F.col(hits), F.col(n))
    return df.withColumn("ci_low", F.round(low, digits)).withColumn("ci_high", F.round(high, digits))


def paired(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row from (user_idx, hit) tables: users in both, means, gained and lost hits."""
    both = a.select("user_idx", F.col("hit").alias("ha")).join(b.select("user_idx", F.col("hit").alias("hb")), "user_idx")
    return both.agg(F.count(F.lit(1)).alias("n_users"), F.round(F.avg(F.col("ha") - F.col("hb")), 6).alias("mean_delta"), F.sum(((F.col("ha") == 1) & (F.col("hb") == 0)).cast("int")).alias("gained"), F.sum(((F.col("ha") == 0) & (F.col("hb") == 1)).cast("int")).alias("lost"))


def paired_table(a: DataFrame, b: DataFrame, n_boot: int = 1000, seed: int = 42) -> DataFrame:
    """One row: n_users, mean_delta, ci_low, ci_high (of resampled differences), gained, lost, significant (the interval leaves out 0). No users: 0 users."""
    both = a.select("user_idx", F.col("hit").alias("ha")).join(b.select("user_idx", F.col("hit").alias("hb")), "user_idx").select("user_idx", (F.col("ha") - F.col("hb")).alias("delta"))
    counts = both.agg(F.count(F.lit(1)).alias("n_users"), F.coalesce(F.avg("delta"), F.lit(0.0)).alias("mean_delta"), F.count_if(F.col("delta") > 0).alias("gained"), F.count_if(F.col("delta") < 0).alias("lost"))
    ends = bootstrap(both, n_boot, seed=seed).select(F.col("ci_lo").alias("ci_low"), F.col("ci_hi").alias("ci_high"))
    out = counts.join(F.broadcast(ends), how="left").na.fill(0.0, ["ci_low", "ci_high"])
    return out.withColumn("significant", (F.col("ci_low") > 0) | (F.col("ci_high") < 0))


def paired_report(a: DataFrame, b: DataFrame, n_boot: int = 1000, seed: int = 42) -> dict[str, float]:
    """``paired_table`` as a dictionary, with the exact McNemar p."""
    r = paired_table(a, b, n_boot, seed).first().asDict()
    return r | {"p": mcnemar(int(r["gained"]), int(r["lost"]))}


def welch_p(row: dict[str, float]) -> float:
    """Two-sided p-value of Welch's t from a row of ``metrics.separation``."""
    a, b = row["std_relevant"] ** 2 / row["n_relevant"], row["std_irrelevant"] ** 2 / row["n_irrelevant"]
    if a + b == 0:
        return 1.0
    df = (a + b) ** 2 / (a * a / max(1, row["n_relevant"] - 1) + b * b / max(1, row["n_irrelevant"] - 1))
    return student_t_two_sided(row["t_stat"], df)


def multiseed(rows: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """Mean, standard deviation and standard error over seeds; 0 where there is one seed."""
    n = F.count(value)
    std = F.coalesce(F.stddev_samp(value), F.lit(0.0))
    return rows.groupBy(*by).agg(n.alias("n_seeds"), F.round(F.avg(value), 6).alias("mean"), F.round(std, 6).alias("std"), F.round(std / F.sqrt(n.cast("double")), 6).alias("sem"))
