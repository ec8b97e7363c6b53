"""URL filters: host and path rules, and association rules for what they leave open.

Rules (host, path, verdict) judge the urls that they fit; the longest wins. Those
urls, labelled by their rules, are transactions of tokens (host words, path
segments, file endings, query keys; tokens that always occur together are one family);
FP-growth mines token sets that go along with a verdict, and rules with enough support and confidence judge the urls left: an
inverted index leads from each rule's rarest token to the rule, all its tokens must
be in the url, and the rule with the highest confidence (then support, then the
longest, then block before allow) decides. Urls that no rule reaches are allowed.

Corner cases: null urls and urls without ``://`` have empty host and path and no
tokens, so they are allowed; repeated rows give repeated rows; without a labelled
url nothing is mined; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankforge.llm.workspace import Workspace, small

#: (host, path, verdict) in the order of the contract (fixed values).
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
MIN_SUPPORT, MIN_CONFIDENCE = 0.01, 0.8
DEFAULT = "allow"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def with_parts(pages: DataFrame) -> DataFrame:
    """page_id, __url, host and path."""
    df = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("__url"))
    df = df.withColumn("__rest", F.expr("CASE WHEN locate('://', __url) > 0 THEN substring(__url, locate('://', __url) + 3) ELSE '' END"))
    df = df.withColumn("__rest", F.coalesce("__rest", F.lit(""))).withColumn("__host", F.regexp_extract("__rest", r"^[^/?#]*", 0))
    df = df.withColumn("path", F.regexp_extract(F.expr("substring(__rest, length(__host) + 1)"), r"^[^?#]*", 0))
    return df.select("page_id", "__url", F.translate("__host", UPPER, LOWER).alias("host"), "path")


def rule_of(rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, its verdict) of the longest rule that fits host and path; null without one."""
    name = verdict = None
    for host, path, v in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r)):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        name = F.when(fits, host + path) if name is None else name.when(fits, host + path)
        verdict = F.when(fits, v) if verdict is None else verdict.when(fits, v)
    return (F.lit(None).cast("string"), F.lit(None).cast("string")) if name is None else (name, verdict)


def tokens() -> Column:
    """The distinct tokens of a url, sorted: words of the host, path words (numbers as #), ending, query keys."""
    words = lambda c, by: F.filter(F.split(c, by), lambda x: x != "")
    host = F.transform(words(F.col("host"), r"[.-]"), lambda x: F.concat(F.lit("host="), x))
    path = F.transform(words(F.regexp_replace("path", r"\.[A-Za-z0-9]+$", ""), "/"), lambda x: F.concat(F.lit("path="), F.regexp_replace(x, "[0-9]+", "#")))
    ending = F.filter(F.array(F.concat(F.lit("end="), F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))), lambda x: x != "end=")
    query = F.transform(words(F.regexp_extract("__url", r"\?([^#]*)", 1), "&"), lambda x: F.concat(F.lit("key="), F.regexp_extract(x, "^[^=]*", 0)))
    return F.array_sort(F.array_distinct(F.concat(host, path, ending, F.coalesce(query, F.array().cast("array<string>")))))


def families(labelled: DataFrame, min_support: float) -> DataFrame:
    """word, family: of the frequent tokens, those that occur in exactly the same urls (by count and sum of hashes) under the name of the first.

    What holds for one of them holds for all, and long urls from one template would
    else have as many token sets as their tokens have subsets. At most the mean number
    of tokens of a url over ``min_support`` are frequent.
    """
    place = F.xxhash64("words").cast("decimal(20,0)")
    seen = labelled.select(place.alias("at"), F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.sum("at").alias("where"))
    seen = seen.join(F.broadcast(labelled.agg(F.count(F.lit(1)).alias("total")))).where(F.col("n") >= F.lit(min_support) * F.col("total"))
    return seen.groupBy("n", "where").agg(F.min("word").alias("family"), F.collect_list("word").alias("words")).select(F.explode("words").alias("word"), "family")


def mine(labelled: DataFrame, named: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """Rules (words, verdict, confidence, support) from rows (words, verdict): sets of families (``named``) that imply a verdict."""
    kept = labelled.join(F.broadcast(named.agg(F.collect_set("family").alias("kept"))))
    items = kept.select(F.concat(F.array_intersect("words", "kept"), F.array(F.concat(F.lit("label="), "verdict"))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(items)
    found = model.associationRules.where(F.col("consequent")[0].startswith("label=") & ~F.exists("antecedent", lambda x: x.startswith("label=")))
    return found.select(F.array_sort("antecedent").alias("words"), F.substring(F.col("consequent")[0], 7, 100).alias("verdict"), "confidence", "support")


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """page_id, host, path, rule, verdict of every page."""
    work = Workspace(pages.sparkSession, "urls")
    name, verdict = rule_of(rules)
    rows = with_parts(pages).withColumn("rule", name).withColumn("by_rule", verdict).withColumn("words", tokens())
    rows = work.table(rows.select("page_id", "host", "path", "rule", "by_rule", "words"), "rows")
    labelled = rows.where("by_rule is not null")
    labelled = labelled.select("words", F.col("by_rule").alias("verdict"))
    named = work.table(families(labelled, min_support), "families")
    mined = work.table(mine(labelled, named, min_support, min_confidence), "mined")

    # The rarest token of each rule leads to it; how often a token occurs is counted over all pages.
    df = rows.select(F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    mined = mined.withColumn("rule_id", F.sha2(F.concat_ws("\x01", "verdict", "words"), 256))
    terms = mined.select("rule_id", F.explode("words").alias("word")).join(df, "word")
    index = terms.groupBy("rule_id").agg(F.min_by("word", F.struct("df", "word")).alias("word")).join(mined, "rule_id")
    # Urls with the same tokens are judged once.
    sets = rows.where("by_rule is null").select(F.col("words")).distinct()
    # A url has a family if it has any of its tokens.
    have = sets.select("words", F.explode("words").alias("word")).join(small(named), "word").groupBy("words").agg(F.collect_set("family").alias("have"))
    hits = have.select("words", "have", F.explode("have").alias("word")).join(index.withColumnRenamed("words", "needed"), "word")
    hits = hits.where(F.size(F.array_except("needed", "have")) == 0)
    best = hits.groupBy("words").agg(F.max_by("verdict", F.struct("confidence", "support", F.size("needed"), "verdict", "rule_id")).alias("mined_verdict"))
    best = work.table(best, "best")
    return rows.join(best, "words", "left").select("page_id", "host", "path", "rule", F.coalesce("by_rule", "mined_verdict", F.lit(DEFAULT)).alias("verdict"))
