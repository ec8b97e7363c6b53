"""Temporal splits, thresholds, scenario flags, candidate pools."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rankforge.operators.ranking import by_user, dense_index, draw, exclude, positions, tie_key
from rankforge.schema import SCENARIOS
from rankforge.sources.readers import shared_folder

DAY = 86_400
#: Rows that are numbered together.
SLOTS = 65_536
#: Steps of a walk through a catalogue: primes, of which one has no common factor with its size.
WALK = (1_000_003, 1_000_033)


def kcore(log: DataFrame, min_user: int, min_item: int, rounds: int = 50) -> DataFrame:
    """Drops users and items with too few interactions until nothing changes. Each round is checkpointed, so plans stay short."""
    context = log.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_folder(log.sparkSession))
    n = log.count()
    for _ in range(rounds):
        users = log.groupBy("user_idx").count().where(F.col("count") >= min_user).select("user_idx")
        log = log.join(users, "user_idx", "left_semi")
        items = log.groupBy("item_idx").count().where(F.col("count") >= min_item).select("item_idx")
        log = log.join(items, "item_idx", "left_semi").checkpoint()
        m = log.count()
        if m == n:
            return log
        n = m
    raise RuntimeError("k-core did not settle")


def temporal_order(log: DataFrame) -> DataFrame:
    """pos (1-based) in time; ties by user, item and the row's keys k1, k2."""
    return positions(log, F.floor(F.col("ts") / DAY), ["ts", "user_idx", "item_idx", "k1", "k2"], "pos")


def temporal_split(log: DataFrame, train: tuple[int, int] = (7, 10), valid_end: tuple[int, int] = (8, 10)) -> DataFrame:
    """log with pos and part (train, valid, test): one cut in time for all users."""
    ordered = temporal_order(log)
    total = log.agg(F.count(F.lit(1)).alias("__total"))
    cut = lambda share: F.floor(F.col("__total") * share[0] / F.lit(share[1]))
    part = F.when(F.col("pos") <= cut(train), "train").when(F.col("pos") <= cut(valid_end), "valid").otherwise("test")
    return ordered.join(F.broadcast(total)).withColumn("part", part).drop("__total")


def leave_last(log: DataFrame, valid_n: int, test_n: int) -> DataFrame:
    """Per user: the last test_n rows are test, valid_n before them validation."""
    back = F.row_number().over(by_user().orderBy(F.desc("ts"), F.desc("item_idx"), F.desc("k1"), F.desc("k2")))
    return log.withColumn("part", F.when(back <= test_n, "test").when(back <= test_n + valid_n, "valid").otherwise("train"))


def launch_rule(split: DataFrame, every: int = 25) -> DataFrame:
    """Items whose id divides by ``every`` are launched at the test period: their earlier rows go."""
    return split.where((F.col("part") == "test") | (F.col("item_idx") % every != 0))


def item_counts(train: DataFrame, items: DataFrame) -> DataFrame:
    """item_idx, train_count of the whole catalogue, zeros included."""
    counts = train.groupBy("item_idx").agg(F.count(F.lit(1)).alias("train_count"))
    return items.select("item_idx").join(counts, "item_idx", "left").select("item_idx", F.coalesce("train_count", F.lit(0)).alias("train_count"))


def user_counts(train: DataFrame) -> DataFrame:
    return train.groupBy("user_idx").agg(F.count(F.lit(1)).alias("train_user_count"))


def thresholds(train: DataFrame, cold: float = 0.05, tail: float = 0.20, user_cold: float = 0.05) -> DataFrame:
    """One row: item_p5, item_p20 over items in train, user_p5 over users in train (linear interpolation)."""
    items = train.groupBy("item_idx").agg(F.count(F.lit(1)).alias("c")).agg(F.percentile("c", cold).alias("item_p5"), F.percentile("c", tail).alias("item_p20"))
    users = train.groupBy("user_idx").agg(F.count(F.lit(1)).alias("c")).agg(F.percentile("c", user_cold).alias("user_p5"))
    return items.join(users)


def item_stats(train: DataFrame, items: DataFrame, limits: DataFrame) -> DataFrame:
    """item_idx, train_count, is_tail."""
    return item_counts(train, items).join(F.broadcast(limits)).select("item_idx", "train_count", (F.col("train_count") < F.col("item_p20")).alias("is_tail"))


def with_flags(test: DataFrame, train: DataFrame, limits: DataFrame) -> DataFrame:
    """test with train counts, the five flags and primary_scenario."""
    c, u = F.col("train_item_count"), F.col("train_user_count")
    items = train.groupBy("item_idx").agg(F.count(F.lit(1)).alias("train_item_count"))
    df = test.join(items, "item_idx", "left").join(user_counts(train), "user_idx", "left").na.fill(0, ["train_item_count", "train_user_count"]).join(F.broadcast(limits))
    df = df.withColumn("item_new", c == 0).withColumn("item_cold", (c > 0) & (c <= F.col("item_p5"))).withColumn("long_tail", (c > F.col("item_p5")) & (c < F.col("item_p20"))).withColumn("user_cold", u <= F.col("user_p5"))
    df = df.withColumn("warm", ~(F.col("item_new") | F.col("item_cold") | F.col("long_tail") | F.col("user_cold")))
    return df.withColumn("primary_scenario", primary()).drop("item_p5", "item_p20", "user_p5")


def primary() -> Column:
    return F.coalesce(*[F.when(F.col(s), s) for s in SCENARIOS], F.lit("warm"))


def gold(test: DataFrame) -> DataFrame:
    """One row per user: the last test row, its item as true_item, with all its columns."""
    last = test.withColumn("__back", F.row_number().over(by_user().orderBy(F.desc("ts"), F.desc("pos")))).where("__back = 1").drop("__back")
    return last.withColumnRenamed("item_idx", "true_item")


def scenario_rows(df: DataFrame, scenarios: tuple[str, ...] = SCENARIOS) -> DataFrame:
    """Each row once as ``overall`` and once for each of its scenarios, so that one aggregation serves all."""
    names = F.filter(F.array(F.lit("overall"), *[F.when(F.col(s), s) for s in scenarios]), lambda x: x.isNotNull())
    return df.withColumn("scenario", F.explode(names))


def uniform_candidates(gold_rows: DataFrame, seen: DataFrame, items: DataFrame, negatives: int, seed: int = 42, draws: int = 4) -> DataFrame:
    """The gold item and ``negatives`` unseen items, or as many as there are: seeded draws from the catalogue, not a product with it.

    ``draws`` times as many are drawn as wanted; a user to whom that leaves too few walks through the whole catalogue (``walk``).
    """
    at = dense_index(items, "item_idx", "slot")
    return _pool(gold_rows, seen, at, at, negatives, seed, draws)


def popularity_candidates(gold_rows: DataFrame, seen: DataFrame, train: DataFrame, negatives: int, seed: int = 42, draws: int = 8) -> DataFrame:
    """As uniform_candidates; a draw is a random training row, so items come in proportion to their counts. What draws leave open is filled by a walk through the items of the rows."""
    at = positions(train.select("item_idx", "pos"), F.floor(F.col("pos") / SLOTS), ["pos"], "slot").select("item_idx", (F.col("slot") - 1).alias("slot"))
    return _pool(gold_rows, seen, at, dense_index(train, "item_idx", "slot"), negatives, seed, draws)


def _pool(gold_rows: DataFrame, seen: DataFrame, slots: DataFrame, catalogue: DataFrame, negatives: int, seed: int, draws: int) -> DataFrame:
    users = gold_rows.select("user_idx", "true_item")
    size = slots.agg(F.count(F.lit(1)).alias("n"))
    tries = users.withColumn("try", F.explode(F.sequence(F.lit(1), F.lit(negatives * draws)))).join(F.broadcast(size))
    tries = tries.withColumn("slot", draw(seed, F.col("n"), "user_idx", "try")).join(slots, "slot").where("item_idx != true_item")
    tries = exclude(tries.groupBy("user_idx", "item_idx").agg(F.min("try").alias("try")), seen)
    fill = tries.withColumn("pool_pos", F.row_number().over(by_user().orderBy("try")) + 1).where(F.col("pool_pos") <= negatives + 1)
    fill = fill.select("user_idx", "item_idx", "pool_pos")
    fill = fill.unionByName(walk(users, fill, seen, catalogue, negatives, seed)).withColumn("label", F.lit(0)).select("user_idx", "item_idx", "label", "pool_pos")
    return users.select("user_idx", F.col("true_item").alias("item_idx"), F.lit(1).alias("label"), F.lit(1).alias("pool_pos")).unionByName(fill)


def walk(users: DataFrame, fill: DataFrame, seen: DataFrame, catalogue: DataFrame, negatives: int, seed: int) -> DataFrame:
    """What is missing in pools shorter than ``negatives`` + 1: the next unseen items on a seeded walk that passes every slot of the catalogue once.

    Of a walk's first places, no more than the items that a user has seen or holds can be void, so it is as long as these and what is missing.
    """
    held = fill.groupBy("user_idx").agg(F.count(F.lit(1)).alias("held"))
    short = users.join(held, "user_idx", "left").na.fill(0, ["held"]).where(F.col("held") < negatives)
    had = seen.join(short.select("user_idx"), "user_idx", "left_semi").select("user_idx", "item_idx").distinct().groupBy("user_idx").agg(F.count(F.lit(1)).alias("had"))
    n = F.col("n")
    # A step without a common factor with the number of slots passes all of them.
    step = F.when(n % WALK[0] != 0, WALK[0]).otherwise(WALK[1])
    places = short.join(had, "user_idx", "left").na.fill(0, ["had"]).join(F.broadcast(catalogue.agg(F.count(F.lit(1)).alias("n"))))
    places = places.withColumn("at", F.explode(F.sequence(F.lit(1).cast("long"), F.least(n, F.col("had") + 1 + negatives))))
    places = places.withColumn("slot", (draw(seed, n, "user_idx", "n") + F.col("at") * step) % n).join(catalogue, "slot").where("item_idx != true_item")
    free = exclude(exclude(places, seen), fill).withColumn("nth", F.row_number().over(by_user().orderBy("at")))
    return free.withColumn("pool_pos", (F.col("held") + F.col("nth") + 1).cast("int")).where(F.col("pool_pos") <= negatives + 1).select("user_idx", "item_idx", "pool_pos")


def hard_first(pool: DataFrame, hard: DataFrame, negatives: int) -> DataFrame:
    """Negatives from impressions without a click go first, random ones fill up; the positive stays in front."""
    first = hard.select("user_idx", "item_idx").distinct().join(pool.where("label = 1").select("user_idx", F.col("item_idx").alias("g")), "user_idx").where("item_idx != g")
    rows = pool.withColumn("__p", F.when(F.col("label") == 1, 0).otherwise(2)).unionByName(first.select("user_idx", "item_idx", F.lit(0).alias("label"), F.lit(0).alias("pool_pos"), F.lit(1).alias("__p")))
    rows = rows.withColumn("__r", F.row_number().over(Window.partitionBy("user_idx", "item_idx").orderBy("__p"))).where("__r = 1")
    rows = rows.withColumn("pool_pos", F.row_number().over(by_user().orderBy("__p", "pool_pos", "item_idx")))
    return rows.where(F.col("pool_pos") <= negatives + 1).select("user_idx", "item_idx", "label", "pool_pos")


def rerank_users(flagged: DataFrame, total: int, seed: int = 42, scenarios: tuple[str, ...] = ("item_cold", "long_tail", "user_cold", "warm")) -> DataFrame:
    """A stratified sample: total / 4 users of each scenario in seeded order, each user once."""
    rows = scenario_rows(flagged, scenarios).where("scenario != 'overall'").select("scenario", "user_idx").distinct()
    w = Window.partitionBy("scenario").orderBy(tie_key(seed, "user_idx"), "user_idx")
    return rows.withColumn("at", F.row_number().over(w)).where(F.col("at") <= total // len(scenarios)).select("user_idx").distinct()
