"""Every input format, from files written on the spot."""

import gzip
import json
import zipfile

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rankforge.schema import SCORED
from rankforge.sources import datasets, readers
from rankforge.streaming import events


def test_movielens_formats(spark, tmp_path):
    (tmp_path / "u.data").write_text("1\t10\t5\t100\n2\t11\t3\t200\n")
    flags = ["0"] * 19
    flags[1] = flags[5] = "1"
    (tmp_path / "u.item").write_bytes(("10|Caf\xe9 (1995)|1|2|u|" + "|".join(flags) + "\n11|X|1|2|u|" + "|".join(["0"] * 19) + "\n").encode("latin-1"))
    log, items = datasets.movielens(spark, str(tmp_path), "ml-100k")
    assert [tuple(r) for r in log.orderBy("user_id").collect()] == [("1", "10", 5.0, 100.0), ("2", "11", 3.0, 200.0)]
    assert [tuple(r) for r in items.orderBy("item_id").collect()] == [("10", "Café (1995)", "Action|Comedy", "Café (1995) Action|Comedy"), ("11", "X", "unknown", "X unknown")]
    (tmp_path / "ratings.dat").write_text("1::10::4::7\n")
    (tmp_path / "movies.dat").write_text("10::A: B::Drama|War\n")
    log, items = datasets.movielens(spark, str(tmp_path), "ml-1m")
    assert tuple(log.first()) == ("1", "10", 4.0, 7.0) and items.first()["title"] == "A: B"
    (tmp_path / "ratings.csv").write_text("userId,movieId,rating,timestamp\n1,10,4.5,7\n")
    (tmp_path / "movies.csv").write_text('movieId,title,genres\n10,"A, B",Drama\n')
    log, items = datasets.movielens(spark, str(tmp_path), "ml-25m")
    assert tuple(log.first()) == ("1", "10", 4.5, 7.0) and items.first()["text"] == "A, B Drama"


def test_yelp(spark, tmp_path):
    assert datasets.yelp_name("yelp-philly-restaurants") == ("Philadelphia", "Restaurants")
    business = [{"business_id": "a", "name": "N", "city": "Philadelphia", "categories": "Restaurants, Pizza"}, {"business_id": "b", "name": "M", "city": "Tampa", "categories": "Restaurants"}]
    reviews = [{"user_id": "u", "business_id": b, "stars": 4.0, "date": "2020-01-01 00:00:10"} for b in "ab"]
    for name, rows in (("business", business), ("review", reviews)):
        (tmp_path / f"yelp_academic_dataset_{name}.json").write_text("\n".join(map(json.dumps, rows)))
    log, items = datasets.yelp(spark, str(tmp_path), "yelp-philly-restaurants")
    assert [tuple(r) for r in log.collect()] == [("u", "a", 4.0, 1577836810.0)] and items.first()["genres"] == "Restaurants|Pizza"


def test_amazon_gzip_and_duplicates(spark, tmp_path):
    with gzip.open(tmp_path / "meta_Toys.jsonl.gz", "wt") as f:
        f.write("\n".join(json.dumps({"parent_asin": a, "title": t, "categories": ["x", "y"]}) for a, t in (("p", "B"), ("p", "A"), ("q", None))))
    (tmp_path / "Toys.jsonl").write_text("\n".join(json.dumps({"parent_asin": a, "user_id": "u", "rating": 5.0, "timestamp": 9}) for a in ("p", "z")))
    log, items = datasets.amazon(spark, str(tmp_path), "Toys")
    assert [tuple(r) for r in log.collect()] == [("u", "p", 5.0, 9.0)]
    assert [tuple(r) for r in items.orderBy("item_id").collect()] == [("p", "A", "x|y", "A x|y"), ("q", None, "x|y", "x|y")]
    with pytest.raises(FileNotFoundError):
        datasets.amazon(spark, str(tmp_path), "Books")


def test_mind(spark, tmp_path):
    (tmp_path / "news.tsv").write_text("N1\tc\ts\tT1\tA1\tu\t[]\t[]\nN-2\tc\ts\tT2\t\tu\t[]\t[]\n")
    (tmp_path / "behaviors.tsv").write_text("1\tU1\t11/13/2019 8:36:57 AM\tN1\tN-2-1 N1-0\n2\tU1\t11/12/2019 8:36:57 AM\t\tN1-1 N9-1\n")
    log, items, hard = datasets.mind(spark, str(tmp_path))
    rows = {(r["user_id"], r["item_id"]): r["timestamp"] for r in log.collect()}
    assert set(rows) == {("U1", "N1"), ("U1", "N-2")} and rows["U1", "N1"] < rows["U1", "N-2"]
    assert [tuple(r) for r in hard.collect()] == [("U1", "N1")]


def test_arrow_shards(spark, tmp_path):
    table = pa.table({"a": [1, 2], "b": ["x", "y"]})
    with pa.ipc.new_stream(str(tmp_path / "1.arrow"), table.schema) as w:
        w.write_table(table)
    with pa.ipc.new_file(str(tmp_path / "2.arrow"), table.schema) as w:
        w.write_table(table)
    assert readers.arrow_shards(spark, str(tmp_path), "a long").groupBy("a").count().where("count = 2").count() == 2


def test_score_files_and_upsert(spark, tmp_path):
    for m in ("bpr", "pop"):
        (tmp_path / f"{m}_scores.csv").write_text("user_idx,item_idx,score\n1,2,0.5\n")
    got = readers.scores(spark, f"{tmp_path}/*_scores.csv")
    assert sorted(r["model"] for r in got.collect()) == ["bpr", "pop"]
    assert readers.optional_scores(spark, f"{tmp_path}/none.csv").schema == SCORED
    new = got.where("model = 'pop'").withColumn("score", F.lit(9.0))
    assert sorted((r["model"], r["score"]) for r in readers.upsert(got, new).collect()) == [("bpr", 0.5), ("pop", 9.0)]
    out = f"{tmp_path}/out"
    readers.write_scores(got, out)
    readers.write_scores(new, out)
    assert sorted((r["model"], r["score"]) for r in spark.read.parquet(out).collect()) == [("bpr", 0.5), ("pop", 9.0)]
    assert {r["model"] for r in readers.relabel(got, "pop", "popularity").collect()} == {"bpr", "popularity"}


def test_merged_datasets(spark, tmp_path):
    for d in ("x", "y"):
        (tmp_path / d).mkdir()
        (tmp_path / d / "m.csv").write_text("model,recall\na,0.5\n")
    assert sorted(r["dataset"] for r in readers.merged(spark, f"{tmp_path}/*/m.csv").collect()) == ["x", "y"]


def test_extract(tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("top/a.txt", "1")
        z.writestr("top/b/c.txt", "2")
    readers.extract(str(tmp_path / "a.zip"), str(tmp_path / "out"))
    assert (tmp_path / "out/b/c.txt").read_text() == "2"
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("../evil.txt", "1")
        z.writestr("x", "1")
    with pytest.raises(ValueError):
        readers.extract(str(tmp_path / "b.zip"), str(tmp_path / "out"))


def test_stream_counts_like_a_batch(spark, tmp_path):
    source = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    source.repartition(3).write.parquet(f"{tmp_path}/in")
    q = events.item_counts(events.read(spark, f"{tmp_path}/in"), "1 day", "3650 days").writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r["start"], r["item_idx"]): r["n"] for r in spark.table("counts").collect()}
    want = {(r["start"], r["item_idx"]): r["n"] for r in events.item_counts(source, "1 day").collect()}
    assert got == want and sum(got.values()) == source.count()
