"""Ranking metrics, exposure, coverage, ties and score separation. Results are long (metric, k, value) or one wide row per model."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rankforge.functions.columns import discount
from rankforge.operators.ranking import best_worst, percentile_rank, rank_scored
from rankforge.operators.split import scenario_rows
from rankforge.schema import K_LIST


def usable_k(k_list: Sequence[int], n: int) -> list[int]:
    """The k up to n, and n itself."""
    return sorted({k for k in k_list if k <= n} | {n})


def gold_rank(gold: DataFrame, ranked: DataFrame) -> DataFrame:
    """gold rows with the rank of their item (null if it is not in the list). A user missing from the lists counts as a miss."""
    r = ranked.select("user_idx", F.col("item_idx").alias("true_item"), "rank").groupBy("user_idx", "true_item").agg(F.min("rank").alias("rank"))
    return gold.join(r, ["user_idx", "true_item"], "left")


def at_k(k_list: Sequence[int] = K_LIST, rank: str = "rank") -> list[Column]:
    """recall, ndcg and mrr at each k as means over rows with a rank."""
    out = []
    r = F.col(rank)
    for k in k_list:
        hit = F.coalesce(r <= k, F.lit(False))
        out += [
            F.round(F.avg(hit.cast("double")), 6).alias(f"recall_at_{k}"),
            F.round(F.avg(F.when(hit, discount(r)).otherwise(0.0)), 6).alias(f"ndcg_at_{k}"),
            F.round(F.avg(F.when(hit, 1 / r).otherwise(0.0)), 6).alias(f"mrr_at_{k}"),
        ]
    return out


def long_metrics(gold: DataFrame, ranked: DataFrame, k_list: Sequence[int] = K_LIST, by: Sequence[str] = ()) -> DataFrame:
    """(by..., metric, k, value, n_users) in one aggregation."""
    wide = gold_rank(gold, ranked).groupBy(*by).agg(F.count(F.lit(1)).alias("n_users"), *at_k(k_list))
    names = [f"{m}_at_{k}" for k in k_list for m in ("recall", "ndcg", "mrr")]
    stack = ", ".join(f"'{x.split('_at_')[0]}', {x.split('_at_')[1]}, {x}" for x in names)
    return wide.select(*by, "n_users", F.expr(f"stack({len(names)}, {stack}) AS (metric, k, value)"))


def gini(values: DataFrame, column: str) -> DataFrame:
    """One row: gini of the values (0 for none). Equal values are taken together, so the order is over distinct values."""
    c = values.groupBy(F.col(column).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("m"))
    low = F.least(F.min("v").over(Window.partitionBy()), F.lit(0.0))
    c = c.withColumn("x", F.col("v") - low + 1e-12)
    before = F.coalesce(F.sum("m").over(Window.orderBy("v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # The sum of 2i - n - 1 over the places of one value, n taken out afterwards.
    c = c.withColumn("places", F.col("m") * (2 * before + F.col("m")))
    n, total = F.sum("m"), F.sum(F.col("x") * F.col("m"))
    value = (F.sum(F.col("places") * F.col("x")) - n * total) / (n * total)
    return c.agg(F.coalesce(F.round(value, 6), F.lit(0.0)).alias("gini"))


def exposure(ranked: DataFrame, gold: DataFrame, stats: DataFrame, k: int) -> DataFrame:
    """One row: items and tail items in the first k places of users with gold, and the Gini of how often; items never shown do not count."""
    shown = ranked.where(F.col("rank") <= k).join(gold.select("user_idx").distinct(), "user_idx", "left_semi").groupBy("item_idx").agg(F.count(F.lit(1)).alias("n"))
    tails = shown.join(stats.where("is_tail").select("item_idx"), "item_idx", "left_semi").agg(F.count(F.lit(1)).alias("unique_tail_exposed_items"))
    return shown.agg(F.count(F.lit(1)).alias("unique_exposed_items")).join(gini(shown, "n").withColumnRenamed("gini", "gini_exposure")).join(tails)


def evaluate(scored: DataFrame, gold: DataFrame, stats: DataFrame, k_list: Sequence[int] = K_LIST, seed: int = 42, cut: int | None = None) -> DataFrame:
    """One row of all metrics; ``cut`` shortens the ranked lists before any k."""
    ranked = rank_scored(scored, seed)
    if cut is not None:
        ranked = ranked.where(F.col("rank") <= cut)
    return gold_rank(gold, ranked).agg(F.count(F.lit(1)).alias("n_users"), *at_k(k_list)).join(exposure(ranked, gold, stats, max(k_list)))


def subgroups(gold: DataFrame, ranked: DataFrame, k_list: Sequence[int] = K_LIST) -> DataFrame:
    """Metrics overall and for each scenario, in one pass."""
    return scenario_rows(gold_rank(gold, ranked)).groupBy("scenario").agg(F.count(F.lit(1)).alias("n_users"), *at_k(k_list))


def oracle_recall(gold: DataFrame, pool: DataFrame, k_list: Sequence[int] = K_LIST) -> DataFrame:
    """n_eval_users, pool_coverage, median_true_rank and the recall of the pool's own order."""
    r = gold_rank(gold, pool.withColumnRenamed("pool_pos", "rank") if "rank" not in pool.columns else pool)
    recall = [F.round(F.avg(F.coalesce(F.col("rank") <= k, F.lit(False)).cast("double")), 6).alias(f"oracle_recall_at_{k}") for k in k_list]
    return r.agg(F.count(F.lit(1)).alias("n_eval_users"), F.round(F.avg(F.col("rank").isNotNull().cast("double")), 6).alias("pool_coverage"), F.percentile("rank", 0.5).alias("median_true_rank"), *recall)


def tie_diagnostic(scored: DataFrame, gold: DataFrame, k_list: Sequence[int] = K_LIST) -> DataFrame:
    """n_users, tie_rate, recall and ndcg at the best and the worst rank that ties allow."""
    df = best_worst(scored, gold)
    out = [F.count(F.lit(1)).alias("n_users"), F.round(F.avg((F.col("worst") > F.col("best")).cast("double")), 6).alias("tie_rate")]
    for k in k_list:
        hit = lambda c, k=k: (F.col(c) <= k).cast("double")
        gain = lambda c, k=k: F.when(F.col(c) <= k, discount(F.col(c))).otherwise(0.0)
        out += [F.round(F.avg(hit("best")), 6).alias(f"recall_at_{k}_best"), F.round(F.avg(hit("worst")), 6).alias(f"recall_at_{k}_worst"), F.round(F.avg(gain("best")), 6).alias(f"ndcg_at_{k}_best"), F.round(F.avg(gain("worst")), 6).alias(f"ndcg_at_{k}_worst")]
    return df.agg(*out)


def separation(scored: DataFrame, gold: DataFrame, bins: int = 100) -> DataFrame:
    """One row: how far scores of gold items lie from the others. p-values are left to ``welch``."""
    df = scored.join(gold.select("user_idx", "true_item"), "user_idx", "left").withColumn("y", F.coalesce(F.col("item_idx") == F.col("true_item"), F.lit(False)).cast("int"))
    rel, irr = F.when(F.col("y") == 1, F.col("score")), F.when(F.col("y") == 0, F.col("score"))
    a = df.agg(
        F.count(rel).alias("n_relevant"), F.count(irr).alias("n_irrelevant"), F.avg(rel).alias("mr"), F.avg(irr).alias("mi"),
        F.coalesce(F.stddev_samp(rel), F.lit(0.0)).alias("sr"), F.coalesce(F.stddev_samp(irr), F.lit(0.0)).alias("si"), F.min("score").alias("lo"), F.max("score").alias("hi"),
    )
    ranked = percentile_rank(df.select("score", "y"), "score", "p", by=None)
    spread = F.nullif(F.stddev_pop("p") * F.stddev_pop("q"), F.lit(0.0))
    spearman = percentile_rank(ranked, "y", "q", by=None).agg(F.coalesce(F.covar_pop("p", "q") / spread, F.lit(0.0)).alias("rho"))
    bucket = F.least(F.lit(bins), F.floor((F.col("score") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / bins)) + 1)
    hist = df.join(F.broadcast(a)).where("hi > lo").groupBy(bucket.alias("b")).agg(F.try_divide(F.count(rel), F.max("n_relevant")).alias("dr"), F.try_divide(F.count(irr), F.max("n_irrelevant")).alias("di"))
    overlap = hist.agg(F.sum(F.least("dr", "di")).alias("ov"))
    pooled = F.sqrt(F.try_divide((F.col("n_relevant") - 1) * F.col("sr") ** 2 + (F.col("n_irrelevant") - 1) * F.col("si") ** 2, F.col("n_relevant") + F.col("n_irrelevant") - 2))
    d = F.coalesce(F.try_divide(F.col("mr") - F.col("mi"), pooled), F.lit(0.0))
    t = F.try_divide(F.col("mr") - F.col("mi"), F.sqrt(F.try_divide(F.col("sr") ** 2, F.col("n_relevant")) + F.try_divide(F.col("si") ** 2, F.col("n_irrelevant"))))
    r = lambda c, n: F.round(c, 4).alias(n)
    return a.join(spearman).join(overlap).select(
        "n_relevant", "n_irrelevant", r(F.col("mr"), "mean_relevant"), r(F.col("mi"), "mean_irrelevant"), r(F.col("sr"), "std_relevant"), r(F.col("si"), "std_irrelevant"),
        r(d, "cohens_d"), r(F.col("rho"), "spearman_r"), r(F.coalesce(t, F.lit(0.0)), "t_stat"), r(F.coalesce("ov", F.lit(1.0)), "overlap_coef"),
    )


def coverage(pools: DataFrame, gold: DataFrame, n: int) -> DataFrame:
    """model, scenario, coverage, n_users at n, over all gold users."""
    hits = pools.where(F.col("rank") <= n).select("model", "user_idx", F.col("item_idx").alias("true_item")).distinct().withColumn("hit", F.lit(1.0))
    models = pools.select("model").distinct()
    rows = scenario_rows(gold).select("scenario", "user_idx", "true_item")
    total = rows.groupBy("scenario").agg(F.count(F.lit(1)).alias("n_users"))
    got = rows.join(hits, ["user_idx", "true_item"]).groupBy("model", "scenario").agg(F.sum("hit").alias("hits"))
    base = total.join(F.broadcast(models))
    return base.join(got, ["model", "scenario"], "left").select("model", "scenario", F.round(F.coalesce("hits", F.lit(0.0)) / F.col("n_users"), 6).alias("coverage"), "n_users")


def recall_curve(pools: DataFrame, gold: DataFrame, k_list: Sequence[int] = (10, 50, 100, 200, 500)) -> DataFrame:
    """model, k, recall: the rank of gold is found once for all k."""
    ranks = pools.join(gold.select("user_idx", F.col("true_item").alias("item_idx")), ["user_idx", "item_idx"]).select("model", "rank")
    users = gold.agg(F.count(F.lit(1)).alias("n_users"))
    sums = ranks.groupBy("model").agg(*[F.sum((F.col("rank") <= k).cast("int")).alias(f"k{k}") for k in k_list])
    stack = ", ".join(f"{k}, k{k}" for k in k_list)
    return sums.join(F.broadcast(users)).select("model", "n_users", F.expr(f"stack({len(k_list)}, {stack}) AS (k, hits)")).select("model", "k", F.round(F.col("hits") / F.col("n_users"), 6).alias("recall"), "n_users")


def pool_sizes(pool: DataFrame) -> DataFrame:
    """describe() of the pool sizes."""
    n = pool.groupBy("user_idx").agg(F.count(F.lit(1)).alias("n"))
    q = [F.percentile("n", p).alias(c) for c, p in (("q25", 0.25), ("q50", 0.5), ("q75", 0.75))]
    return n.agg(F.count(F.lit(1)).alias("n_users"), F.round(F.avg("n"), 6).alias("mean"), F.round(F.stddev_samp("n"), 6).alias("std"), F.min("n").alias("smallest"), *q, F.max("n").alias("largest"))


def scenario_counts(flagged: DataFrame) -> DataFrame:
    return scenario_rows(flagged).groupBy("scenario").agg(F.count(F.lit(1)).alias("num_test_cases"))
