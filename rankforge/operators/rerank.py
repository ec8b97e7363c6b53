"""Rerankers as plug-ins, their prompts and parsers, evidence tables, probes.

Neural models are not part of the engine. A plug-in is a function from a pandas
frame with a ``prompt`` column to scores (or texts); ``score_with`` runs it in Arrow
batches. ``overlap_stub`` is a deterministic stand-in for tests: it is no language model.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankforge.functions.columns import parse_order, parse_score
from rankforge.operators.ranking import draw, percentile_rank, recent

SEPARATOR, QUERY = " ; ", "Recommend items similar to: "
NEUTRAL, TAIL_BONUS = 50.0, 5.0


def history_text(log: DataFrame, items: DataFrame, n: int = 10) -> DataFrame:
    """user_idx, history: the titles of the last n items, oldest first."""
    rows = recent(log, n).join(items.select("item_idx", F.coalesce("title", F.lit("")).alias("title")), "item_idx", "left")
    rows = rows.groupBy("user_idx").agg(F.sort_array(F.collect_list(F.struct((-F.col("back")).alias("at"), F.coalesce("title", F.lit("")).alias("title")))).alias("h"))
    return rows.select("user_idx", F.array_join(F.col("h.title"), SEPARATOR).alias("history"))


def baseline_prompt(history: Column, item: Column) -> Column:
    return F.concat(F.lit("User history: "), history, F.lit("\nCandidate: "), F.substring(item, 1, 120), F.lit("\nWill the user like the candidate? Answer yes or no."))


def evidence_lines(names: Column, graph: Column, semantic: Column, strength: Column, popularity: Column, tail: Column) -> Column:
    """Evidence as text: places among the candidates, overlap with the history, popularity."""
    top = lambda c: F.concat(F.lit("top "), F.bround(100 - c, 0).cast("int").cast("string"), F.lit("%"))
    overlap = F.when(F.size(names) > 0, F.concat(F.lit("\nOften seen with: "), F.array_join(names, ", "), F.lit(" ("), strength.cast("string"), F.lit(")"))).otherwise("")
    pop = F.when(tail, F.concat(F.lit("bottom "), F.bround(popularity, 0).cast("int").cast("string"), F.lit("%"))).otherwise(top(popularity))
    return F.concat(F.lit("Graph: "), top(graph), F.lit(" of candidates\nText: "), top(semantic), F.lit(" of candidates"), overlap, F.lit("\nPopularity: "), pop)


def gala_prompt(history: Column, item: Column, evidence: Column) -> Column:
    return F.concat(baseline_prompt(history, item), F.lit("\n"), evidence)


def listwise_prompt(history: Column, titles: Column) -> Column:
    lines = F.transform(titles, lambda t, i: F.concat((i + 1).cast("string"), F.lit(". "), F.substring(t, 1, 120)))
    return F.concat(F.lit("User history: "), history, F.lit("\nOrder these from best to worst, by number:\n"), F.array_join(lines, "\n"))


def pairwise_prompt(history: Column, a: Column, b: Column) -> Column:
    return F.concat(F.lit("User history: "), history, F.lit("\nA: "), F.substring(a, 1, 120), F.lit("\nB: "), F.substring(b, 1, 120), F.lit("\nWhich one fits better? Answer A or B."))


def score_with(rows: DataFrame, scorer: Callable[[pd.DataFrame], pd.Series], column: str = "score", kind: str = "double", chunk: int = 20_000) -> DataFrame:
    """rows with a column from a plug-in, called on at most ``chunk`` rows at a time; a model is loaded once by a scorer that caches it."""
    rows = rows.drop(column)
    schema = f"{', '.join(f'`{n}` {t}' for n, t in rows.dtypes)}, `{column}` {kind}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), chunk):
                part = pdf.iloc[at : at + chunk]
                yield part.assign(**{column: scorer(part).to_numpy()})

    return rows.mapInPandas(run, schema)


def overlap_stub(pdf: pd.DataFrame) -> pd.Series:
    """Share of the candidate's words that the history has; stands in for a model in tests."""

    def one(prompt: str) -> float:
        head, _, tail = prompt.partition("\nCandidate: ")
        words = set(tail.split("\n")[0].lower().split())
        return len(words & set(head.lower().split())) / max(1, len(words))

    return pdf["prompt"].map(one).astype(float)


def generated_scores(rows: DataFrame, text: str = "answer") -> DataFrame:
    """Scores 0..100 from answers; 0 and ``failed`` where none can be read."""
    number = parse_score(F.col(text))
    return rows.withColumn("failed", number.isNull()).withColumn("score", F.coalesce(number, F.lit(0.0)))


def listwise_scores(pool: DataFrame, answers: DataFrame) -> DataFrame:
    """user_idx, item_idx, score: n less the place in the answer; items that it leaves out keep the pool's order behind."""
    n = pool.groupBy("user_idx").agg(F.max("pool_pos").cast("int").alias("n"))
    order = answers.join(n, "user_idx").select("user_idx", "n", F.posexplode(parse_order(F.col("answer"), F.col("n"))).alias("place", "pool_pos"))
    return pool.join(order, ["user_idx", "pool_pos"]).select("user_idx", "item_idx", (F.col("n") - F.col("place")).cast("double").alias("score"))


def random_pairs(pool: DataFrame, pairs: int = 60, seed: int = 42) -> DataFrame:
    """user_idx, pair, a, b: seeded pairs of different places of each user's pool."""
    n = pool.groupBy("user_idx").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    p = n.withColumn("pair", F.explode(F.sequence(F.lit(1), F.lit(pairs))))
    p = p.withColumn("pa", draw(seed, F.col("n"), "user_idx", "pair") + 1).withColumn("shift", draw(seed + 1, F.col("n") - 1, "user_idx", "pair") + 1)
    p = p.withColumn("pb", (F.col("pa") - 1 + F.col("shift")) % F.col("n") + 1)
    at = lambda c, n: pool.select("user_idx", F.col("pool_pos").alias(c), F.col("item_idx").alias(n))
    return p.join(at("pa", "a"), ["user_idx", "pa"]).join(at("pb", "b"), ["user_idx", "pb"]).select("user_idx", "pair", "a", "b")


def wins(pool: DataFrame, judged: DataFrame) -> DataFrame:
    """user_idx, item_idx, score: pairs (user_idx, a, b, a_wins) that an item has won."""
    won = judged.select("user_idx", F.when(F.col("a_wins"), F.col("a")).otherwise(F.col("b")).alias("item_idx")).groupBy("user_idx", "item_idx").agg(F.count(F.lit(1)).cast("double").alias("score"))
    return pool.select("user_idx", "item_idx").join(won, ["user_idx", "item_idx"], "left").na.fill(0.0, ["score"])


def issue_rate(scored: DataFrame, weak: Column) -> DataFrame:
    return scored.agg(F.count(F.lit(1)).alias("n"), F.sum(weak.cast("int")).alias("issues"), F.round(F.avg(weak.cast("double")), 6).alias("issue_rate"))


def with_tail_bonus(scored: DataFrame, stats: DataFrame, bonus: float = TAIL_BONUS) -> DataFrame:
    tail = stats.where("is_tail").select("item_idx", F.lit(bonus).alias("__b"))
    return scored.join(tail, "item_idx", "left").withColumn("score", F.col("score") + F.coalesce("__b", F.lit(0.0))).drop("__b")


def directed_cooccurrence(log: DataFrame, window: int = 50, least: int = 2) -> DataFrame:
    """item_a, item_b (both ways): a stood before b in the last ``window`` rows of at least ``least`` users' pairs; directions are counted apart."""
    rows = recent(log, window).select("user_idx", "item_idx", F.col("back"))
    a, b = rows.select("user_idx", F.col("item_idx").alias("item_a"), F.col("back").alias("at")), rows.select("user_idx", F.col("item_idx").alias("item_b"), F.col("back").alias("bt"))
    n = a.join(b, "user_idx").where("at > bt and item_a != item_b").groupBy("item_a", "item_b").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    both = n.select("item_a", "item_b").union(n.select("item_b", "item_a"))
    return both.distinct()


def evidence(pool: DataFrame, log: DataFrame, items: DataFrame, stats: DataFrame, graph: DataFrame | None = None, semantic: DataFrame | None = None, window: int = 10) -> DataFrame:
    """Per candidate: graph and text places in percent (50 without scores), overlap with the history, its first three names, popularity place, tail."""
    df = pool.select("user_idx", "item_idx")
    for name, scored in (("graph_pct", graph), ("semantic_pct", semantic)):
        if scored is None:
            df = df.withColumn(name, F.lit(NEUTRAL))
        else:
            s = df.join(scored.select("user_idx", "item_idx", F.col("score").alias("__s")), ["user_idx", "item_idx"], "left").na.fill(0.0, ["__s"])
            df = percentile_rank(s, "__s", name).drop("__s")
    near = directed_cooccurrence(log)
    hist = recent(log, window).select("user_idx", F.col("item_idx").alias("item_b"), "back").join(items.select(F.col("item_idx").alias("item_b"), F.substring(F.coalesce("title", F.lit("")), 1, 40).alias("name")), "item_b", "left")
    hits = df.select("user_idx", F.col("item_idx").alias("item_a")).join(hist, "user_idx").join(near, ["item_a", "item_b"])
    hits = hits.groupBy("user_idx", F.col("item_a").alias("item_idx")).agg(F.count(F.lit(1)).alias("overlap"), F.sort_array(F.collect_list(F.struct((-F.col("back")).alias("at"), F.coalesce("name", F.lit("")).alias("name")))).alias("h"))
    hits = hits.select("user_idx", "item_idx", "overlap", F.slice(F.col("h.name"), 1, 3).alias("names"))
    pop = percentile_rank(stats.select("item_idx", "train_count", "is_tail"), "train_count", "popularity_pct", by=None).select("item_idx", "popularity_pct", "is_tail")
    out = df.join(hits, ["user_idx", "item_idx"], "left").join(pop, "item_idx", "left")
    return out.select("user_idx", "item_idx", "graph_pct", "semantic_pct", F.coalesce("overlap", F.lit(0)).cast("long").alias("overlap"), F.coalesce("names", F.array().cast("array<string>")).alias("names"), F.coalesce("popularity_pct", F.lit(0.0)).alias("popularity_pct"), F.coalesce("is_tail", F.lit(False)).alias("is_tail"))


def intent_scores(phrase_scores: DataFrame) -> DataFrame:
    """Best similarity over a user's phrases, from (user_idx, phrase, item_idx, score)."""
    return phrase_scores.groupBy("user_idx", "item_idx").agg(F.max("score").alias("score"))


def compare(variants: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, scored in variants.items():
        part = scored.select("user_idx", "item_idx", F.col("score").cast("double").alias("score")).withColumn("variant", F.lit(name))
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no variant")
    return out

