"""Mixing sources to target weights by subset-sum budget fitting.

A document's size is its number of words. Each source gets a target number of
words (``with_targets``). A source repeats all its documents as often as the target
allows; what remains of the target is a budget that some documents get once more:
documents are counted by exact size, and bounded-knapsack dynamic programming over
the sizes meets the budget (``fit_budget``). Of each size, the seeded first documents
are taken: those up to a limit in a seeded order, so that texts never move.

The sum never exceeds the budget. Budgets up to ``WINDOW`` words are met as nearly from
below as any choice of documents can; of larger ones, a like share of every size is
taken first and the program fits the last ``WINDOW`` words.

Corner cases: null text has size 0; null is a source of its own, last in order;
sources without words have target 0; repeated rows are documents of their own; where
only some of the rows that share id and text are taken, which of them is decided by
their place in a written table, so that results agree but for other columns; an empty
table gives an empty result. Size 0 takes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from rankforge.llm.workspace import Workspace, releasing, small

WEIGHTS = (5.0, 2.0, 1.0)
SHARE, MOST = 1.5, 2
SEED = 20_240
#: Words of a budget that dynamic programming fits at most; its tables hold five bytes for each.
WINDOW = 1 << 20
#: Words that are tried first: less for the program to do, and more of the budget is a like share of every size.
WINDOWS = (1 << 12, 1 << 16)
#: Columns of the result; columns of the input with these names, besides source, do not pass through.
RESULTS = ("source", "size", "source_size", "target", "copies", "taken")
#: Equal ranges of the seeded order, as bits, by which the documents of one size and source are counted.
RANGE_BITS = 10


def with_size(docs: DataFrame, name: str = "size") -> DataFrame:
    """docs and the number of words of ``text`` as a long column; other columns pass through."""
    docs = docs.drop(name)
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())])
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = pc.fill_null(pc.cast(pc.count_substring_regex(b.column(at), pattern=r"[^\x20\x09-\x0D]+"), pa.int64()), 0)
            yield pa.record_batch([*b.columns, n], [*b.schema.names, name])

    return docs.mapInArrow(releasing(run), schema)


def with_weights(sources: DataFrame, weights: Sequence[float], work: Workspace) -> DataFrame:
    """__key and words of each source, and its weight: weights go round by code point of the key, the empty one (null) last.

    Numbered by range, so that any number of sources can be.
    """
    last = (F.col("__key") == "").alias("__last")
    dealt = sources.select("__key", "words", last).repartitionByRange("__last", "__key").withColumn("__range", F.spark_partition_id())
    dealt = work.table(dealt, "ranges")
    counts = dealt.groupBy("__range").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("__range", (F.sum("n").over(Window.orderBy("__range")) - F.col("n")).alias("__before"))
    at = F.row_number().over(Window.partitionBy("__range").orderBy("__last", "__key")) - 1
    place = (F.col("__before") + F.col("__at")) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place + 1).cast("int"))
    return dealt.withColumn("__at", at).join(F.broadcast(before), "__range").select("__key", "words", weight.alias("weight"))


def with_targets(sources: DataFrame, share: float = SHARE, most: float = MOST) -> DataFrame:
    """words and weight of each source, and target: ``share`` times all words dealt by weight; none above ``most`` times its own, the excess dealt again.

    A source is full if its part, ``unit`` times its weight, is above ``most`` times its
    words. Each round sums up who is full at the last unit; one row goes to the driver.
    """
    total = share * (sources.agg(F.sum("words")).first()[0] or 0)
    unit, held = 0.0, -1
    while True:
        full = F.lit(unit) * F.col("weight") > most * F.col("words")
        n, words, weight = sources.where("words > 0").agg(F.count_if(full), F.sum(F.when(full, F.col("words"))), F.sum(F.when(~full, F.col("weight")))).first()
        if n == held or not weight:
            break
        held, unit = n, max(unit, (total - most * (words or 0)) / weight)
    target = F.least(F.lit(unit) * F.col("weight"), (most * F.col("words")).cast("double"))
    return sources.withColumn("target", F.when(F.col("words") > 0, target).otherwise(0.0))


def knapsack(counts: dict[int, int], room: int) -> tuple[dict[int, int], int]:
    """(how many documents of each size, what is left of the room) for the largest sum within the room."""
    reach = np.zeros(room + 1, bool)
    reach[0] = True
    by = np.zeros(room + 1, np.int32)  # the step that first reached a sum
    steps: list[tuple[int, int]] = []
    for n in sorted(counts):
        left, k = min(counts[n], room // n), 1
        while left > 0 and not reach[room]:
            k = min(k, left)  # a count is split into powers of two and a rest
            new = np.flatnonzero(reach[: room + 1 - n * k] & ~reach[n * k :]) + n * k
            reach[new], by[new] = True, len(steps)
            steps.append((n, k))
            left, k = left - k, 2 * k
    best = int(np.flatnonzero(reach)[-1])
    take: dict[int, int] = {}
    s = best
    while s:
        n, k = steps[by[s]]
        take[n] = take.get(n, 0) + k
        s -= n * k
    return take, room - best


def fit_budget(counts: dict[int, int], budget: int, window: int = WINDOW) -> dict[int, int]:
    """How many documents of each size to take so that their words come nearest to the budget from below.

    A like share of every size leaves a small window to the program; where that cannot
    meet the budget, shares are given back until it works on ``window`` words.
    """
    counts = {n: c for n, c in counts.items() if n > 0 and c > 0}
    total = sum(n * c for n, c in counts.items())
    if budget >= total:
        return counts
    best, best_gap = {}, budget + 1
    for width in sorted({min(w, window) for w in (*WINDOWS, window)}):
        take = {n: c * max(0, budget - width) // total for n, c in counts.items()}
        rest = budget - sum(n * k for n, k in take.items())
        for n in sorted(counts, reverse=True):
            k = max(0, min(counts[n] - take[n], -(-(rest - width) // n), rest // n))
            take[n] += k
            rest -= n * k
        more, gap = knapsack({n: c - take[n] for n, c in counts.items()}, min(rest, width))
        gap += max(0, rest - width)
        if gap < best_gap:
            best, best_gap = {n: k + more.get(n, 0) for n, k in take.items()}, gap
        if not gap or width >= budget:
            break
    return best


def keyed(docs: DataFrame, seed: int) -> DataFrame:
    """docs and __key (of the source, never null), __size, __digest (of the text), __draw (the seeded order)."""
    key = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))
    sized = with_size(docs, "__size").withColumn("__key", key).withColumn("__digest", F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    return sized.withColumn("__draw", F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("__digest")))


def limits(sized: DataFrame, sources: DataFrame, work: Workspace) -> DataFrame:
    """For each source and size of which some documents are taken once more: the last that is (__at_draw, __at_digest), and how many (some) of the rows equal to it (same)."""
    part = F.shiftright("__draw", 64 - RANGE_BITS).alias("__part")
    counts = work.table(sized.where("__size > 0").groupBy("__key", "__size", part).agg(F.count(F.lit(1)).alias("n")), "counts")
    by_size = counts.groupBy("__key", "__size").agg(F.sum("n").alias("n")).join(small(sources.select("__key", "budget")), "__key")

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        take = fit_budget(dict(zip(pdf["__size"].tolist(), pdf["n"].tolist(), strict=True)), int(pdf["budget"].iloc[0]))
        return pd.DataFrame({"__key": pdf["__key"], "__size": pdf["__size"], "extra": [take.get(int(n), 0) for n in pdf["__size"]]})

    # One group has a row for each distinct size of a source.
    extra = work.table(by_size.groupBy("__key").applyInPandas(fit, "__key string, __size long, extra long").where("extra > 0"), "extra")
    # The range of the seeded order in which the count is reached, then the place in it.
    before = F.sum("n").over(Window.partitionBy("__key", "__size").orderBy("__part")) - F.col("n")
    parts = counts.withColumn("before", before).join(small(extra), ["__key", "__size"])
    parts = work.table(parts.where("before < extra and extra <= before + n").select("__key", "__size", "__part", (F.col("extra") - F.col("before")).alias("quota")), "parts")
    near = sized.withColumn("__part", part).join(small(parts), ["__key", "__size", "__part"])
    near = near.groupBy("__key", "__size", "quota", "__draw", "__digest").agg(F.count(F.lit(1)).alias("same"))
    upto = F.sum("same").over(Window.partitionBy("__key", "__size").orderBy("__draw", "__digest")) - F.col("same")
    last = near.withColumn("upto", upto).where("upto < quota and quota <= upto + same")
    return work.table(last.select("__key", "__size", F.col("__draw").alias("__at_draw"), F.col("__digest").alias("__at_digest"), (F.col("quota") - F.col("upto")).alias("some"), "same"), "limits")


def numbered(rows: DataFrame, work: Workspace) -> DataFrame:
    """rows and ``__number``, 0-based among rows of equal key, size, draw and digest, by their place in a written table."""
    group = ["__key", "__size", "__draw", "__digest"]
    held = work.table(rows, "equal").select("*", F.col("_metadata.file_name").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    files = held.groupBy(*group, "__file").agg(F.count(F.lit(1)).alias("n"))
    before = files.select(*group, "__file", (F.sum("n").over(Window.partitionBy(*group).orderBy("__file")) - F.col("n")).alias("__before"))
    at = F.row_number().over(Window.partitionBy(*group, "__file").orderBy("__row")) - 1
    return held.withColumn("__at", at).join(before, [*group, "__file"]).withColumn("__number", F.col("__before") + F.col("__at")).drop("__file", "__row", "__at", "__before")


def mix(docs: DataFrame, keep: Sequence[str] = ("doc_id",), weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: int = MOST, seed: int = SEED) -> DataFrame:
    """The columns ``keep``, source, size, source_size, target, copies (0 to ``most``) and taken (size times copies) of every document."""
    work = Workspace(docs.sparkSession, "mixing")
    cols = [c for c in dict.fromkeys(keep) if c not in RESULTS]
    marks = ["__key", "__size", "__draw", "__digest"]
    docs = docs.select(*dict.fromkeys([*cols, "doc_id", "source", "text"]))
    sized = work.table(keyed(docs.select("doc_id", "source", "text"), seed).select("doc_id", "source", *marks), "sized")
    sources = sized.groupBy("__key").agg(F.sum("__size").alias("words"))
    sources = work.table(with_weights(sources, weights, work), "weights")
    base = F.when(F.col("words") > 0, F.least(F.lit(most), F.floor(F.col("target") / F.col("words")))).otherwise(0).cast("int")
    sources = with_targets(sources, share, most).withColumn("base", base)
    sources = work.table(sources.select("__key", F.col("words").alias("source_size"), "target", "base", F.rint(F.col("target") - F.col("base") * F.col("words")).cast("long").alias("budget")), "sources")
    last = limits(sized, sources, work)

    # Documents are compared with the limit of their size; whole rows are read only where more than ids are asked for.
    rows = sized if set(cols) <= {"doc_id"} else keyed(docs, seed)
    rows = rows.select(*cols, "source", *marks).join(small(sources), "__key").join(small(last), ["__key", "__size"], "left")
    own, limit = F.struct("__draw", "__digest"), F.struct(F.col("__at_draw").alias("__draw"), F.col("__at_digest").alias("__digest"))
    more = F.coalesce((own <= limit).cast("int"), F.lit(0))
    split = F.coalesce((own == limit) & (F.col("some") < F.col("same")), F.lit(False))
    out = rows.withColumn("more", more)
    if last.where("some < same").limit(1).count():  # only some of the rows that share id and text
        out = out.where(~split).unionByName(numbered(rows.where(split), work).withColumn("more", (F.col("__number") < F.col("some")).cast("int")).drop("__number"))
    out = out.select(*cols, "source", F.col("__size").alias("size"), "source_size", "target", (F.col("base") + F.col("more")).alias("copies"))
    return out.withColumn("taken", F.col("size") * F.col("copies"))
