"""Oracle ceilings, headroom and regret, reweighting to natural prevalence, decompositions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPS = 1e-9


def union_coverage(coverage: DataFrame, pools: DataFrame, gold: DataFrame, n: int) -> DataFrame:
    """scenario, best (single model), union, model of the best, from ``metrics.coverage`` and the union of the pools."""
    from rankforge.operators.metrics import coverage as cover

    one = pools.where(F.col("rank") <= n).select("user_idx", "item_idx").distinct().withColumn("rank", F.lit(1)).withColumn("model", F.lit("union"))
    together = cover(one, gold, n).select("scenario", F.col("coverage").alias("union_coverage"))
    best = coverage.groupBy("scenario").agg(F.max("coverage").alias("best_single"), F.max_by("model", F.struct("coverage", "model")).alias("best_model"))
    return best.join(together, "scenario")


def regret(coverage: DataFrame, union: DataFrame) -> DataFrame:
    """model, scenario, coverage, regret (union less coverage) and its share of the union."""
    gap = F.col("union_coverage") - F.col("coverage")
    return coverage.join(union, "scenario").select("model", "scenario", "coverage", F.round(gap, 6).alias("regret"), F.round(gap / F.nullif(F.col("union_coverage"), F.lit(0.0)) * 100, 4).alias("regret_pct"))


def headroom(coverage: DataFrame, union: DataFrame) -> DataFrame:
    """Share of the way from the best single model to the union; null where there is no way."""
    room = F.col("union_coverage") - F.col("best_single")
    return coverage.join(union, "scenario").select("model", "scenario", F.round(F.when(room > EPS, (F.col("coverage") - F.col("best_single")) / room), 6).alias("realised"))


def router(a: DataFrame, b: DataFrame, gold: DataFrame) -> DataFrame:
    """scenario, recall of a, of b and of an oracle that takes the better one for each user; a, b: (user_idx, hit)."""
    from rankforge.operators.split import scenario_rows

    both = gold.join(a.select("user_idx", F.col("hit").alias("ha")), "user_idx").join(b.select("user_idx", F.col("hit").alias("hb")), "user_idx")
    mean = lambda c, n: F.round(F.avg(c), 6).alias(n)
    return scenario_rows(both).groupBy("scenario").agg(F.count(F.lit(1)).alias("n_users"), mean("ha", "recall_a"), mean("hb", "recall_b"), mean(F.greatest("ha", "hb"), "recall_oracle"))


def natural_weights(flagged: DataFrame) -> DataFrame:
    """primary_scenario, weight: share of the test rows."""
    n = flagged.groupBy("primary_scenario").agg(F.count(F.lit(1)).alias("n"))
    return n.join(n.agg(F.sum("n").alias("total"))).select("primary_scenario", (F.col("n") / F.col("total")).alias("weight"))


def reweight(values: DataFrame, weights: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Mean of the scenarios' values under natural weights, over the scenarios that have a value."""
    v = F.when(F.col(value).isNotNull() & (F.col("weight") > 0), F.col("weight"))
    return values.join(weights, "primary_scenario").groupBy(*by).agg(F.round(F.sum(v * F.col(value)) / F.sum(v), 6).alias("natural"))


def tail_prior(full: Column, no_evidence: Column, no_tail: Column) -> tuple[Column, Column, Column]:
    """(evidence effect, tail effect, tail's share): tail / (tail + max(evidence, 0))."""
    evidence, tail = full - no_evidence, full - no_tail
    return evidence, tail, tail / F.nullif(tail + F.greatest(evidence, F.lit(0.0)), F.lit(0.0))


def conditional_success(end_to_end: Column, coverage: Column) -> Column:
    return F.try_divide(end_to_end, coverage)


def verdict(gain: Column, threshold: float = 0.02) -> Column:
    return F.when(gain > threshold, "yes").when(gain > 0, "weak").otherwise("no")
