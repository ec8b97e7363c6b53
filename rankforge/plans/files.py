"""Every input format: the tables are written in it, read back by the sources, and compared with the tables in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankforge.operators import scorers
from rankforge.plans import oracles as O
from rankforge.plans.context import Context
from rankforge.plans.registry import query, r6
from rankforge.sources import datasets, readers


def _folder(c: Context, name: str) -> str:
    return f"{c.root}/files/{name}"


def _table(c: Context, name: str) -> DataFrame:
    return c.spark.read.parquet(f"{c.sf_dir}/{name}.parquet")


def _log(c: Context) -> DataFrame:
    """user_id, item_id, rating, timestamp of all line items."""
    raw = datasets.from_orders(c.spark, c.sf_dir, 0)
    return raw.select(F.col("user_idx").alias("user_id"), F.col("item_idx").alias("item_id"), "rating", F.col("ts").cast("long").alias("timestamp"))


def _summed(log: DataFrame, items: DataFrame) -> DataFrame:
    """All items with their texts and what the log says of them."""
    n = log.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("user_id").alias("n_users"), r6(F.sum("rating"), "rating", 2), F.max("timestamp").alias("last_ts"))
    return items.select("item_id", "title", "genres", "text").join(n, "item_id", "left").na.fill(0, ["n_rows", "n_users"])


LOG = "lg AS (SELECT o_custkey AS user_id, l_partkey AS item_id, l_quantity AS rating, epoch(l_shipdate)::DOUBLE AS ts FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"
SUMMED = """SELECT i.item_id::VARCHAR AS item_id, title, genres, trim(concat_ws(' ', coalesce(title, ''), coalesce(genres, ''))) AS text, coalesce(n_rows, 0) AS n_rows, coalesce(n_users, 0) AS n_users, rating, last_ts
FROM its i LEFT JOIN (SELECT item_id, count(*) AS n_rows, count(DISTINCT user_id) AS n_users, round(sum(rating), 2) AS rating, max(ts) AS last_ts FROM lg GROUP BY 1) n USING (item_id)"""
FLAGS = "[" + ", ".join(f"CASE WHEN (p_size * {i + 3} + p_partkey) % 5 = 0 THEN '{g}' END" for i, g in enumerate(datasets.GENRES)) + "]"


@query(O.with_(LOG, f"its AS (SELECT p_partkey AS item_id, p_name AS title, coalesce(nullif(array_to_string(list_filter({FLAGS}, lambda x: x IS NOT NULL), '|'), ''), 'unknown') AS genres FROM part)") + SUMMED)
def source_movielens_100k(c):
    """Headerless TSV, and a file with bars between title and 19 genre flags, both in Latin-1."""
    folder = _folder(c, "ml-100k")
    _log(c).write.mode("overwrite").option("sep", "\t").option("encoding", "ISO-8859-1").csv(f"{folder}/u.data")
    flags = [((F.col("p_size") * (i + 3) + F.col("p_partkey")) % 5 == 0).cast("int").alias(f"g{i}") for i in range(len(datasets.GENRES))]
    none = [F.lit(None).cast("string").alias(x) for x in ("released", "video", "link")]
    _table(c, "part").select("p_partkey", "p_name", *none, *flags).write.mode("overwrite").option("sep", "|").option("encoding", "ISO-8859-1").csv(f"{folder}/u.item")
    return _summed(*datasets.movielens(c.spark, folder, "ml-100k"))


TYPED = "its AS (SELECT p_partkey AS item_id, p_name AS title, replace(p_type, ' ', '|') || '|' || p_brand AS genres FROM part)"


def _typed(c: Context) -> DataFrame:
    return _table(c, "part").select("p_partkey", "p_name", F.concat(F.replace("p_type", F.lit(" "), F.lit("|")), F.lit("|"), "p_brand").alias("genres"))


@query(O.with_(LOG, TYPED) + SUMMED)
def source_movielens_1m(c):
    """Lines with two colons between the fields."""
    folder = _folder(c, "ml-1m")
    for df, name in ((_log(c), "ratings.dat"), (_typed(c), "movies.dat")):
        df.select(F.concat_ws("::", *df.columns)).write.mode("overwrite").text(f"{folder}/{name}")
    return _summed(*datasets.movielens(c.spark, folder, "ml-1m"))


@query(O.with_(LOG, TYPED) + SUMMED)
def source_movielens_csv(c):
    """CSV with a header whose columns are renamed."""
    folder = _folder(c, "ml-20m")
    _log(c).toDF("userId", "movieId", "rating", "timestamp").write.mode("overwrite").option("header", True).csv(f"{folder}/ratings.csv")
    _typed(c).toDF("movieId", "title", "genres").write.mode("overwrite").option("header", True).csv(f"{folder}/movies.csv")
    return _summed(*datasets.movielens(c.spark, folder, "ml-20m"))


@query(O.with_("its AS (SELECT p_partkey AS item_id, p_name AS title, 'Restaurants|' || p_brand AS genres FROM part WHERE p_size % 3 = 0 AND p_partkey % 4 <> 1)", LOG + ", lg2 AS (SELECT lg.* FROM lg JOIN its USING (item_id))") + SUMMED.replace("FROM lg GROUP", "FROM lg2 GROUP"))
def source_yelp(c):
    """JSON lines, filtered by city and category of a dataset's name; dates become seconds; reviews by a semi join."""
    folder = _folder(c, "yelp")
    city = F.when(F.col("p_size") % 3 == 0, "New Orleans").when(F.col("p_size") % 3 == 1, "Tampa").otherwise("Philadelphia")
    kind = F.when(F.col("p_partkey") % 4 == 1, "Shops").otherwise("Restaurants")
    part = _table(c, "part").select(F.col("p_partkey").cast("string").alias("business_id"), F.col("p_name").alias("name"), city.alias("city"), F.concat(kind, F.lit(", "), "p_brand").alias("categories"))
    part.write.mode("overwrite").json(f"{folder}/yelp_academic_dataset_business.json")
    review = _log(c).select(F.col("user_id").cast("string"), F.col("item_id").cast("string").alias("business_id"), F.col("rating").alias("stars"), F.date_format(F.timestamp_seconds("timestamp"), "yyyy-MM-dd HH:mm:ss").alias("date"))
    review.write.mode("overwrite").json(f"{folder}/yelp_academic_dataset_review.json")
    return _summed(*datasets.yelp(c.spark, folder, "yelp-new_orleans-restaurants"))


AMAZON = "its AS (SELECT p_partkey AS item_id, p_name AS title, {genres} AS genres FROM part WHERE p_partkey % 7 <> 0)"
AMAZON_LOG = LOG + ", lg2 AS (SELECT lg.* FROM lg JOIN its USING (item_id))"


def _amazon(c: Context, folder: str, category: str) -> DataFrame:
    reviews = _log(c).select(F.col("item_id").cast("string").alias("parent_asin"), F.col("user_id").cast("string"), "rating", "timestamp")
    reviews.write.mode("overwrite").json(f"{folder}/{category}.jsonl")
    return _summed(*datasets.amazon(c.spark, folder, category))


def _twice(meta: DataFrame) -> DataFrame:
    """Items that come again with a title further back in the order, and items without an id."""
    again = meta.withColumn("title", F.concat(F.col("title"), F.lit(" again")))
    return meta.unionByName(again).unionByName(meta.limit(3).withColumn("parent_asin", F.lit(None).cast("string")))


@query(O.with_(AMAZON.format(genres="p_type || '|' || p_brand"), AMAZON_LOG) + SUMMED.replace("FROM lg GROUP", "FROM lg2 GROUP"))
def source_amazon_gzip(c):
    """Gzipped JSON lines with lists of categories; the first row of an id stays."""
    folder = _folder(c, "amazon-gz")
    meta = _table(c, "part").where("p_partkey % 7 != 0").select(F.col("p_partkey").cast("string").alias("parent_asin"), F.col("p_name").alias("title"), F.array("p_type", "p_brand").alias("categories"))
    _twice(meta).write.mode("overwrite").option("compression", "gzip").json(f"{folder}/meta_Gifts.jsonl.gz")
    return _amazon(c, folder, "Gifts")


@query(O.with_(AMAZON.format(genres="p_type"), AMAZON_LOG) + SUMMED.replace("FROM lg GROUP", "FROM lg2 GROUP"))
def source_amazon_parquet(c):
    """Several Parquet parts whose categories are text."""
    folder = _folder(c, "amazon-parquet")
    meta = _table(c, "part").where("p_partkey % 7 != 0").select(F.col("p_partkey").cast("string").alias("parent_asin"), F.col("p_name").alias("title"), F.col("p_type").alias("categories"))
    both = _twice(meta)
    for i in range(2):
        both.where(F.coalesce(F.crc32("parent_asin") % 2, F.lit(0)) == i).write.mode("overwrite").parquet(f"{folder}/raw_meta_Gifts/full-0000{i}.parquet")
    return _amazon(c, folder, "Gifts")


@query("SELECT s_suppkey, s_name, s_nationkey, round(s_acctbal, 2) AS s_acctbal FROM supplier")
def source_arrow(c):
    """Arrow shards of a folder, in the stream and in the file format."""
    import pyarrow as pa

    folder, jvm = _folder(c, "arrow"), c.spark.sparkContext._jvm
    rows = _table(c, "supplier").select("s_suppkey", "s_name", "s_nationkey", "s_acctbal").toArrow()  # the smallest table with texts; writing shards is the test's part
    for i, form in enumerate((pa.ipc.new_stream, pa.ipc.new_file)):
        part, sink = rows.slice(i * (len(rows) // 2), len(rows) // 2 if i == 0 else len(rows)), pa.BufferOutputStream()
        with form(sink, part.schema) as writer:
            writer.write_table(part)
        path = jvm.org.apache.hadoop.fs.Path(f"{folder}/part{i}.arrow")
        out = path.getFileSystem(c.spark.sparkContext._jsc.hadoopConfiguration()).create(path, True)
        out.write(bytearray(sink.getvalue().to_pybytes()))
        out.close()
    got = readers.arrow_shards(c.spark, folder, "s_suppkey long, s_name string, s_nationkey long, s_acctbal double")
    return got.withColumn("s_acctbal", F.round("s_acctbal", 2))


MIND = """ev AS (SELECT event_id, user_id, epoch(date_trunc('second', ts))::DOUBLE AS ts, (props::JSON->>'k')::BIGINT AS k FROM events),
known AS (SELECT 'N' || range AS item_id FROM range(0, 90)),
shown AS (SELECT user_id, ts, unnest([{'item': 'N' || k, 'clicked': event_id % 3 = 0}, {'item': 'N' || (k * 7 % 100), 'clicked': false}, {'item': 'N' || ((k + 11) % 100), 'clicked': event_id % 2 = 0}]) AS s FROM ev)"""


def _mind(c: Context) -> tuple[DataFrame, DataFrame, DataFrame]:
    folder = _folder(c, "mind")
    name = lambda k: F.concat(F.lit("N"), k.cast("string"))
    news = c.spark.range(90).select(name(F.col("id")).alias("item_id"), F.lit("news").alias("c"), F.concat(F.lit("kind"), F.col("id") % 4).alias("s"), F.concat(F.lit("Title "), "id").alias("t"), F.when(F.col("id") % 5 != 0, F.concat(F.lit("about "), "id")).alias("a"), *[F.lit("").alias(x) for x in "uvw"])
    news.unionByName(news.withColumn("t", F.concat("t", F.lit(" later")))).write.mode("overwrite").option("sep", "\t").csv(f"{folder}/news.tsv")
    k, e = F.get_json_object("props", "$.k").cast("long"), F.col("event_id")
    mark = lambda item, clicked: F.concat(name(item), F.lit("-"), clicked.cast("int").cast("string"))
    shown = F.concat_ws(" ", mark(k, e % 3 == 0), mark(k * 7 % 100, F.lit(False)), mark((k + 11) % 100, e % 2 == 0))
    past = F.when(e % 4 != 0, F.concat_ws(" ", name((k + 1) % 100), name((k + 2) % 100)))
    rows = _table(c, "events").select(e, F.concat(F.lit("U"), F.col("user_id")).alias("u"), F.date_format(F.col("ts").cast("timestamp"), "M/d/yyyy h:mm:ss a").alias("time"), past.alias("history"), shown.alias("impressions"))
    rows.write.mode("overwrite").option("sep", "\t").csv(f"{folder}/behaviors.tsv")
    return datasets.mind(c.spark, folder)


@query(O.with_(MIND) + """SELECT user_id, item_id, 5.0::DOUBLE AS rating, min(ts) AS timestamp FROM (SELECT 'U' || user_id AS user_id, s.item AS item_id, ts FROM shown WHERE s.clicked
  UNION ALL SELECT 'U' || user_id, 'N' || ((k + unnest([1, 2])) % 100), ts FROM ev WHERE event_id % 4 <> 0) WHERE item_id IN (SELECT item_id FROM known) GROUP BY 1, 2""")
def source_mind(c):
    """Histories and clicked impressions, each user and item at its earliest."""
    return _mind(c)[0].select("user_id", "item_id", "rating", "timestamp")


@query(O.with_(MIND) + "SELECT DISTINCT 'U' || user_id AS user_id, s.item AS item_id FROM shown WHERE NOT s.clicked AND s.item IN (SELECT item_id FROM known)")
def source_mind_shown(c):
    """Shown but not clicked: hard negatives."""
    return _mind(c)[2].select("user_id", "item_id")


@query("SELECT 'N' || range AS item_id, 'Title ' || range AS title, 'news|kind' || (range % 4) AS genres, trim('Title ' || range || CASE WHEN range % 5 <> 0 THEN ' about ' || range ELSE '' END) AS text FROM range(0, 90)")
def source_mind_news(c):
    """The first row of an id stays; null abstracts are empty."""
    return _mind(c)[1].select("item_id", "title", "genres", "text")


def _scores(c: Context) -> dict[str, DataFrame]:
    return {"popularity": scorers.popularity(c.candidates, c.train), "markov": scorers.markov(c.candidates, c.train)}


SCORES = "both_scores AS (SELECT 'popularity' AS model, user_idx, item_idx, score FROM scored UNION ALL SELECT 'markov', c.user_idx, c.item_idx, coalesce(score, 0) FROM candidates c LEFT JOIN markov_scores USING (user_idx, item_idx))"


@query(O.with_(O.BASE, O.CANDIDATES, O.POPULARITY, O.MARKOV, SCORES) + "SELECT model, user_idx, item_idx, round(score, 6)::DOUBLE AS score FROM both_scores UNION ALL SELECT 'missing', user_idx, item_idx, 0::DOUBLE FROM candidates WHERE label = 1")
def source_scores(c):
    """A glob of score files with the model in their names, and an optional file that is not there: its pairs count as 0."""
    folder = _folder(c, "scores")
    for name, scored in _scores(c).items():
        scored.select("user_idx", "item_idx", "score").write.mode("overwrite").option("header", True).csv(f"{folder}/{name}_scores.csv")
    got = readers.scores(c.spark, f"{folder}/*_scores.csv")
    none = scorers.gather(c.candidates.where("label = 1"), readers.optional_scores(c.spark, f"{folder}/none/other_scores.csv")).withColumn("model", F.lit("missing"))
    cols = ["model", "user_idx", "item_idx", r6(F.col("score"), "score")]
    return got.select(*cols).unionByName(none.select(*cols))


@query(O.with_(O.BASE, O.CANDIDATES, O.POPULARITY, O.MARKOV, SCORES) + "SELECT CASE model WHEN 'markov' THEN 'markov2' ELSE model END AS model, count(*) AS n, round(sum(CASE model WHEN 'popularity' THEN 2 * score ELSE score END), 4)::DOUBLE AS total FROM both_scores GROUP BY 1 UNION ALL SELECT 'constant', count(*), count(*)::DOUBLE FROM candidates")
def score_sink(c):
    """Scores by model: one is written again, one renamed, one added."""
    folder = _folder(c, "sink")
    for name, scored in _scores(c).items():
        readers.write_scores(scored.select("user_idx", "item_idx", "score").withColumn("model", F.lit(name)), folder)
    twice = _scores(c)["popularity"].select("user_idx", "item_idx", (F.col("score") * 2).alias("score")).withColumn("model", F.lit("popularity"))
    readers.write_scores(twice, folder)
    old = readers.relabel(c.spark.read.parquet(folder), "markov", "markov2")
    new = c.candidates.select("user_idx", "item_idx", F.lit(1.0).alias("score"), F.lit("constant").alias("model"))
    out = readers.upsert(old, new)
    return out.groupBy("model").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("score"), "total", 4))


@query("SELECT 'nations' AS dataset, n_nationkey::BIGINT AS key, n_name AS name FROM nation UNION ALL SELECT 'regions', r_regionkey::BIGINT, r_name FROM region")
def source_merged(c):
    """CSV files of several datasets as one table, with the dataset from the path."""
    folder = _folder(c, "merged")
    _table(c, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name")).write.mode("overwrite").option("header", True).csv(f"{folder}/nations/summary")
    _table(c, "region").select(F.col("r_regionkey").alias("key"), F.col("r_name").alias("name")).write.mode("overwrite").option("header", True).csv(f"{folder}/regions/summary")
    return readers.merged(c.spark, f"{folder}/*/summary/*.csv", 3).select("dataset", F.col("key").cast("long").alias("key"), "name")
