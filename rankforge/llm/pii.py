"""Personal data by patterns and by bootstrapped contextual extraction, in DataFrame functions only.

Four kinds have base patterns and checks (``KINDS``). Their matches are the seeds:
the two words before a seed are a lexical pattern. Patterns and the instances that
stand behind them (words with a digit or an @, and the seeds) form a graph, which Spark
scores in ``ROUNDS`` rounds: a pattern's confidence for a kind is the mean score of
its distinct instances, an instance's score the noisy-or of its patterns. Patterns
with at least ``MIN_SUPPORT`` instances and ``MIN_CONFIDENCE`` add the other words
that stand behind them, with the kind of the pattern. Base spans always stay.

Nothing is quadratic in a text: regular expressions that scan it once cut it into
matches and what lies between them, matches become rows, and places are running sums
over a document's rows. What moves are matches and words with a digit, not texts.

Positions are code points, the end exclusive. Corner cases: null text is empty and
has no spans; rows that repeat have the same spans each; documents with the same
doc_id and different texts are told apart by a hash of the text; an empty table
gives an empty result; columns other than doc_id and text are ignored by ``find``
and passed through by ``redact``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rankforge.llm.workspace import Workspace, identified, once, small

#: Kinds in the order of the contract. The patterns match what the plain ones of the
#: contract match; possessive repeats and the look-behinds (a match can only start
#: where a run of its first class starts, or where the match before ended) keep them
#: linear in the text.
KINDS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must have for a match to be possible at all; cheaper than the patterns.
HINTS = {
    "email": lambda t: t.contains("@"),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){15}"),
    "phone": lambda t: t.contains("+"),
}
#: Blanks besides the space.
BLANKS = "\t\n\x0b\x0c\r"
#: A word with a digit or an @, in a text whose blanks are spaces. Every base match starts in one.
INSTANCE = "(?<![^ ])[^ 0-9@]*+[0-9@][^ ]*+"
#: What does not belong to the end of an instance.
MARKS = ".,;:!?)]}\"'"
MIN_SUPPORT, MIN_CONFIDENCE, ROUNDS = 3, 0.8, 3
#: Code points of the blocks into which a text is cut, so that a piece is found without reading all before it.
CUT = 1024


def tail(gap: Column) -> Column:
    """The last two words of what lies between two matches."""
    gap = F.trim(gap)
    return F.trim(F.substring_index(F.when(gap.contains("  "), F.regexp_replace(gap, "  +", " ")).otherwise(gap), " ", -2))


def matches(kind: str, text: Column, pattern: str, hint: Column) -> Column:
    """The matches of a pattern in order: kind, code points since the match before, value, and of words what stands before them."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    before = lambda g: tail(g) if kind == "word" else F.lit("")
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.struct(F.length(g).alias("gap"), before(g).alias("tail")))
    # The split leaves one piece more than there are matches; it falls out where a match is missing.
    rows = F.zip_with(gaps, found, lambda g, v: F.struct(F.lit(kind).alias("kind"), g["gap"].alias("gap"), v.alias("value"), g["tail"].alias("tail")))
    return F.filter(F.when(hint, rows).otherwise(F.array()), lambda r: r["value"].isNotNull())


def luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(acc: Column, i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int") * (1 + i % 2)
        return acc + d - F.when(d > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        digits = lambda p: F.regexp_replace(p, "^0+(?=.)", "")
        return F.forall(F.split(value, r"\."), lambda p: F.when(F.length(digits(p)) <= 3, digits(p).cast("int") <= 255).otherwise(False))
    if kind == "card":
        digits = F.regexp_replace(value, "[^0-9]", "")
        return F.when(F.length(digits).between(16, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(F.regexp_replace(value, "[^0-9]", "")).between(8, 15)
    return F.lit(True)


def scan(docs: DataFrame) -> DataFrame:
    """Base spans and other words that may be instances: doc_id, variant, kind (word: null), start, end, value, left (the two words before, digits as #; empty without two)."""
    t = F.coalesce(F.col("text"), F.lit(""))
    spaced = F.translate(t, BLANKS, " " * len(BLANKS))
    found = [matches(kind, t, pattern, HINTS[kind](t)) for kind, pattern in KINDS.items()]
    found.append(matches("word", spaced, INSTANCE, t.rlike("[0-9@]")))
    rows = docs.select("doc_id", "variant", F.posexplode(F.concat(*found)).alias("i", "m")).select("doc_id", "variant", "i", "m.*")
    rows = rows.repartition("doc_id", "variant")
    key = ["doc_id", "variant"]
    run = Window.partitionBy(*key, "kind").orderBy("i")
    end = F.sum(F.col("gap") + F.length("value")).over(run)
    # Words with a digit or an @ may stand next to each other: then they are each other's words before.
    before = [F.lag("value", 2).over(run), F.nullif(F.lag("tail").over(run), F.lit("")), F.lag("value").over(run), F.nullif("tail", F.lit(""))]
    left = F.substring_index(F.concat_ws(" ", *before), " ", -2)
    rows = rows.withColumn("end", end).withColumn("left", F.when((F.col("kind") == "word") & left.contains(" "), F.regexp_replace(F.lower(left), "[0-9]+", "#")).otherwise(""))
    rows = rows.withColumn("start", F.col("end") - F.length("value")).withColumn("word", F.col("kind") == "word")
    fine = F.col("word")
    for kind in KINDS:
        fine = fine | ((F.col("kind") == kind) & valid(kind, F.col("value")))
    # A word comes before the base spans that start in it.
    order = Window.partitionBy(*key).orderBy("start", F.desc("word"), "kind")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.last(F.when(F.col("word"), F.struct("start", "left")), ignorenulls=True).over(so_far)
    rows = rows.where(fine).withColumn("last", last).withColumn("reach", F.max(F.when(~F.col("word"), F.col("end"))).over(so_far))
    free = ~(F.coalesce(F.col("reach") > F.col("start"), F.lit(False)) | F.coalesce(~F.lead("word").over(order), F.lit(False)))
    rows = rows.withColumn("free", free).where("not word or (free and left != '')")
    cut = F.rtrim("value", F.lit(MARKS))
    return rows.select(
        *key, F.when(~F.col("word"), F.col("kind")).alias("kind"), "start", F.when(F.col("word"), F.col("start") + F.length(cut)).otherwise(F.col("end")).alias("end"),
        F.lower(F.when(F.col("word"), cut).otherwise(F.col("value"))).alias("value"), F.when(F.col("last.start") == F.col("start"), F.col("last.left")).otherwise("").alias("left"),
    )


def bootstrap(rows: DataFrame, work: Workspace, min_support: int = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, rounds: int = ROUNDS) -> DataFrame:
    """Patterns (left, kind, confidence) that the graph of patterns and instances trusts."""
    edges = rows.where("left != ''").groupBy("left", "value").agg(F.max("kind").alias("kind"))
    # A pattern with fewer distinct instances than the support can never count.
    wide = edges.groupBy("left").agg(F.count(F.lit(1)).alias("instances"), F.count("kind").alias("seeds")).where((F.col("instances") >= min_support) & (F.col("seeds") > 0))
    edges = work.table(edges.join(wide.select("left", "instances"), "left"), "edges")
    known = edges.where("kind is not null").select("value", "kind").distinct().withColumn("score", F.lit(1.0))
    scores, patterns = known, None
    for i in range(rounds):
        sums = edges.select("left", "value", "instances").join(scores, "value").groupBy("left", "kind")
        graded = sums.agg((F.sum("score") / F.max("instances")).alias("confidence"), F.sum((F.col("score") >= 0.5).cast("int")).alias("support"))
        patterns = work.table(graded.where((F.col("support") >= min_support) & (F.col("confidence") >= min_confidence)).select("left", "kind", "confidence"), f"patterns{i}")
        reached = edges.where("kind is null").select("left", "value").join(patterns, "left").groupBy("value", "kind")
        scores = known.unionByName(reached.agg((1 - F.exp(F.sum(F.log(1 - F.least("confidence", F.lit(0.999)))))).alias("score"))).groupBy("value", "kind").agg(F.max("score").alias("score"))
    return patterns.groupBy("left").agg(F.max_by("kind", F.struct("confidence", "kind")).alias("kind"))


def spans(docs: DataFrame, work: Workspace) -> DataFrame:
    """doc_id, variant, kind, start, end, base (whether a base span) of the documents that ``once`` gives."""
    rows = work.table(scan(docs), "rows")
    patterns = bootstrap(rows, work)
    base = rows.where("kind is not null").select("doc_id", "variant", "kind", "start", "end", F.lit(True).alias("base"))
    found = rows.where("kind is null").drop("kind").join(patterns, "left").select("doc_id", "variant", "kind", "start", "end", F.lit(False).alias("base"))
    return work.table(base.unionByName(found), "spans")


def same_document(rows: DataFrame, other: DataFrame) -> Column:
    return rows["doc_id"].eqNullSafe(other["doc_id"]) & (rows["variant"] == other["variant"])


def find(docs: DataFrame) -> DataFrame:
    """doc_id, the number of base spans of each kind, base_sha256 and spans of every row."""
    work = Workspace(docs.sparkSession, "pii")
    rows = identified(docs.select("doc_id", "text"), work)
    every = spans(once(rows), work)
    place = F.element_at(F.create_map(*[F.lit(x) for p in enumerate(KINDS) for x in p[::-1]]), F.col("kind"))
    one = F.struct(place.alias("place"), "start", F.concat_ws(":", "kind", "start", "end").alias("said"))
    in_order = lambda c: F.array_join(F.transform(F.array_sort(c), lambda s: s["said"]), ",")
    counts = [F.count_if((F.col("kind") == k) & F.col("base")).alias(f"n_{k}") for k in KINDS]
    said = every.groupBy("doc_id", "variant").agg(*counts, in_order(F.collect_list(F.when(F.col("base"), one))).alias("base"), in_order(F.collect_list(one)).alias("spans"))
    said = work.table(said, "said")
    out = rows.join(small(said), same_document(rows, said), "left")
    none = lambda c: F.coalesce(said[c], F.lit(""))
    return out.select(rows["doc_id"], *[F.coalesce(said[f"n_{k}"], F.lit(0).cast("long")).alias(f"n_{k}") for k in KINDS], F.sha2(none("base"), 256).alias("base_sha256"), none("spans").alias("spans"))


def piece(begin: Column, end: Column) -> Column:
    """A part of a text, given as __blocks of CUT code points."""
    first = F.floor(begin / CUT)
    blocks = F.slice("__blocks", (first + 1).cast("int"), F.greatest(F.lit(0), F.ceil(end / CUT) - first).cast("int"))
    return F.substring(F.array_join(blocks, ""), (begin - first * CUT + 1).cast("int"), F.greatest(F.lit(0), end - begin).cast("int"))


def redact(docs: DataFrame) -> DataFrame:
    """docs with every span of ``text`` replaced by its kind in brackets, and n_chars, if there is one, counted anew.

    Spans that overlap are replaced together, by the kind of the first and then longest one.
    """
    work = Workspace(docs.sparkSession, "pii-redact")
    own = ["__doc", "__variant"]
    rows = identified(docs.select("doc_id", "text"), work)
    every = spans(once(rows), work)
    key = ["doc_id", "variant"]
    order = Window.partitionBy(*key).orderBy("start", F.desc("end"), "kind")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    every = every.withColumn("new", F.coalesce(F.col("start") >= reach, F.lit(True)).cast("int")).withColumn("region", F.sum("new").over(order))
    regions = every.groupBy(*key, "region").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("kind", F.struct("start", -F.col("end"), "kind")).alias("kind"))
    regions = regions.withColumn("from", F.coalesce(F.lag("end").over(Window.partitionBy(*key).orderBy("region")), F.lit(0)))
    marks = regions.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("start", "end", "from", "kind"))).alias("__marks"))
    marks = work.table(marks.select(F.col("doc_id").alias("__doc"), F.col("variant").alias("__variant"), "__marks"), "marks")
    every_row = identified(docs.withColumnRenamed("variant", "__kept") if "variant" in docs.columns else docs, work)
    wide = every_row.join(small(marks), F.col("doc_id").eqNullSafe(F.col("__doc")) & (F.col("variant") == F.col("__variant")), "left")
    wide = wide.withColumn("__blocks", F.when(F.col("__marks").isNotNull(), F.regexp_extract_all("text", F.lit(f"(?s).{{1,{CUT}}}"), F.lit(0))))
    parts = F.transform("__marks", lambda m: F.concat(piece(m["from"], m["start"]), F.lit("["), F.upper(m["kind"]), F.lit("]")))
    rest = piece(F.element_at("__marks", -1)["end"], F.length("text").cast("long"))
    masked = F.when(F.col("__marks").isNull(), F.col("text")).otherwise(F.concat(F.array_join(parts, ""), rest))
    out = wide.withColumn("text", masked).drop("variant", "__blocks", "__marks", *own)
    out = (out.withColumnRenamed("__kept", "variant") if "variant" in docs.columns else out).select(*docs.columns)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out
