"""A run from raw rows to reports on a small log."""

import random

import pytest
from pyspark.sql import functions as F

from rankforge.operators import learned, rerank
from rankforge.plans import report, runs
from rankforge.plans.config import SplitConfig
from rankforge.sources import readers
from tests.test_operators import attention_weights

#: Settings of training that are quick, not good.
QUICK = {"dim": 4, "epochs": 2}


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    rng = random.Random(1)
    rows = [(f"u{rng.randrange(40)}", f"i{min(rng.randrange(60), rng.randrange(60))}", float(rng.randrange(1, 6)), float(t * 3600)) for t in range(2500)]
    log = spark.createDataFrame(rows, "user_id string, item_id string, rating double, timestamp double")
    items = spark.createDataFrame([(f"i{i}", f"title {i % 7}", f"title {i % 7} word{i % 11}") for i in range(60)], "item_id string, title string, text string")
    folder = str(tmp_path_factory.mktemp("split"))
    config = SplitConfig(rating_threshold=2, num_negatives=9)
    return runs.prepare(log, items, folder, config), log, items, config


def test_split_tables(spark, made):
    s, log, items, config = made
    n = s.train.count() + s.valid.count() + s.test.count()
    assert s.train.count() == n * 7 // 10 and s.users_mapped.agg(F.max("user_idx")).first()[0] == s.users_mapped.count() - 1
    assert s.train.agg(F.max("ts")).first()[0] <= s.test.agg(F.min("ts")).first()[0]
    pool = s.candidates
    assert pool.where("label = 1").count() == s.gold.count() and pool.groupBy("user_idx").count().agg(F.max("count")).first()[0] <= 10
    assert pool.where("label = 0").join(s.train, ["user_idx", "item_idx"], "left_semi").count() == 0
    assert runs.prepare(log.limit(0), items, s.folder, config).train.count() == s.train.count()  # taken as it is


def test_baselines_and_analysis(spark, made, tmp_path):
    s = made[0]
    models = {k: v for k, v in runs.baselines(s).items() if k in ("popularity", "itemknn", "tfidf", "markov", "decayed_markov")} | {"broken": lambda: 1 / 0}
    done, failed = runs.score_all(models, str(tmp_path / "scores"))
    assert set(failed) == {"broken"} and len(done) == 5
    scored = spark.read.parquet(str(tmp_path / "scores"))
    assert scored.count() == 5 * s.candidates.count()
    out = runs.failure_analysis(s, scored.where("model in ('popularity', 'markov')"), (5,), n_boot=50)
    assert out["metrics"].count() == 2 and out["pool_order"].first()["pool_coverage"] == 1.0
    runs.write_report({"metrics": out["metrics"], "none": None}, str(tmp_path / "report.md"))
    assert "popularity" in (tmp_path / "report.md").read_text()


def test_retrieval_fusion_and_end_to_end(spark, made):
    s = made[0]
    vectors = s.items_mapped.select("item_idx", F.array(*[F.sin(F.col("item_idx") * k + k).cast("float") for k in range(1, 6)]).alias("embedding"))
    pools, failed = runs.retrieval(s, 15, ("popularity", "itemknn", "tfidf", "markov", "embedding", "graph_cooccur", "graph_emb", "recency", "nothing"), vectors, how=QUICK)
    assert set(failed) == {"nothing"}
    pools = pools.cache()
    assert pools.join(s.seen.distinct(), ["user_idx", "item_idx"], "left_semi").count() == 0
    both = runs.fused(pools, s.gold, 15, ("itemknn", "embedding", "popularity"))
    r = runs.coverage_report(both, s.gold, 15)
    assert {"rrf", "cara", "interleave"} <= {x["model"] for x in r["coverage"].collect()}
    assert all(x["union_coverage"] >= x["best_single"] for x in r["ceiling"].collect())
    titles = s.items_mapped.select("item_idx", "title")
    history = rerank.history_text(s.train, s.items_mapped)

    def prompts(df):
        return df.join(titles, "item_idx").join(history, "user_idx", "left").withColumn("prompt", rerank.baseline_prompt(F.coalesce("history", F.lit("")), F.col("title")))

    for x in runs.end_to_end(pools, s.gold, prompts, rerank.overlap_stub, 5, 15).collect():
        assert x["conditional_recall"] is None or x["e2e_recall"] == pytest.approx(x["coverage"] * x["conditional_recall"])
    valid, _ = runs.retrieval(s, 15, ("popularity", "markov"), on="valid")
    top = runs.learned_fusion(s, pools.where("model in ('popularity', 'markov')"), valid, ("popularity", "markov"), 15, "logreg", "rank_only")
    assert top.groupBy("user_idx").count().agg(F.max("count")).first()[0] <= 15


def test_trained_and_plugged_in_retrievers(spark, made):
    s = made[0]
    vectors = runs.encode_items(s.items_mapped, lambda texts: [[float(len(t)), float(t.count("w")), 1.0] for t in texts], "e5_large")
    assert vectors.count() == s.items_mapped.count()
    model = runs.trainers.SelfAttention(attention_weights(s.items_mapped.count(), 5, 4))
    pools, failed = runs.retrieval(s, 8, ("bpr", "lightgcn", "graph_emb", "two_tower", "e5_large", "sasrec"), {"e5_large": vectors}, sasrec=(model, item_table(spark, model)), how=QUICK)
    pools = pools.cache()
    assert failed == {} and {r[0] for r in pools.select("model").distinct().collect()} == {"bpr", "lightgcn", "graph_emb", "two_tower", "e5_large", "sasrec"}
    assert pools.join(s.seen.distinct(), ["user_idx", "item_idx"], "left_semi").count() == 0
    assert set(runs.retrieval(s, 8, ("sasrec", "two_tower"))[1]) == {"sasrec", "two_tower"}


def item_table(spark, model):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(model.w["items"][1:])], "item_idx long, embedding array<double>")


def test_warnings(spark, made, caplog):
    s = made[0]
    pool = s.candidates.select("user_idx", "item_idx")
    half = s.gold.select("user_idx").orderBy("user_idx").limit(s.gold.count() // 2)
    flat = pool.withColumn("score", F.lit(1.0)).withColumn("model", F.lit("flat"))
    some = pool.join(half, "user_idx").withColumn("score", -F.col("item_idx").cast("double")).withColumn("model", F.lit("some"))
    scored = flat.unionByName(some)
    said = runs.warnings_of(s, scored, runs.failure_analysis(s, scored, (5,), n_boot=20))
    assert any(t.startswith("some covers") for t in said) and any("different numbers" in t for t in said)
    assert any(t.startswith("flat: 100.0 %") for t in said) and len(caplog.records) >= len(said)
    runs.fused(scored.withColumn("rank", F.lit(1)), s.gold, 5, ("flat", "nothing"))
    assert "not among the pools: nothing" in caplog.text


def test_run_folders(spark, tmp_path):
    top = spark.createDataFrame([(1, 5, 1), (1, 7, 2), (2, 5, 1)], "user_idx long, item_idx long, rank int")
    root = str(tmp_path)
    assert runs.find_retrieval(spark, root, "ml-1m", 3) is None
    tag = learned.variant_tag(["rank_only", "no_metadata"], {"item_new": 5, "warm": 2})
    assert tag == "nometa_rankonly_regwt_n5w2" and learned.variant_tag() == ""
    path = runs.write_fused(top, root, "ml-1m", 3, 50, tag=tag)
    found = runs.find_retrieval(spark, root, "ml-1m", 3)
    assert found.endswith("ml-1m-retrieval-s3-N50") and path.endswith(f"/lhf_{tag}_scores.csv")
    assert sorted(map(tuple, readers.scores(spark, f"{found}/*_scores.csv").collect())) == [(1, 5, 2.0, f"lhf_{tag}"), (1, 7, 1.0, f"lhf_{tag}"), (2, 5, 1.0, f"lhf_{tag}")]
    assert runs.read_metrics(spark, found, "recall_at_10") == {}
    spark.createDataFrame([("a", 0.5), ("b", 0.25)], "model string, recall_at_10 double").coalesce(1).write.option("header", True).csv(f"{found}/all_model_metrics.csv")
    assert runs.read_metrics(spark, found, "recall_at_10") == {"a": 0.5, "b": 0.25} and runs.read_metrics(spark, found, "none") == {}
    timing = report.Timing()
    timing.save(spark, f"{root}/none")
    assert timing.record("m", lambda: 10) == 10 and not (tmp_path / "none").exists()
    timing.save(spark, f"{root}/timing")
    assert spark.read.option("header", True).csv(f"{root}/timing").first()["num_pairs"] == "10"
    assert runs.resources()["peak_mb"] > 1


def test_shared_folder_and_changed_inputs(spark, tmp_path):
    class Cluster:
        def __init__(self, folder=None):
            self.sparkContext, self.master, self.folder = self, "spark://host:7077", folder

        def getConf(self):
            return {"spark.checkpoint.dir": self.folder}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        readers.shared_folder(Cluster())
    assert readers.shared_folder(Cluster("hdfs://x/y/")) == "hdfs://x/y"
    spark.range(3).write.parquet(f"{tmp_path}/t")
    before = readers.fingerprint(spark, str(tmp_path))
    assert before == readers.fingerprint(spark, str(tmp_path))
    spark.range(4).write.mode("overwrite").parquet(f"{tmp_path}/t")
    assert before != readers.fingerprint(spark, str(tmp_path))


def test_second_stage_and_comparison(spark, made):
    s = made[0]
    test, valid = (runs.retrieval(s, 10, ("popularity", "markov"), on=on)[0].cache() for on in ("test", "valid"))
    one = lambda pools, m: pools.where(F.col("model") == m)
    top = runs.second_stage(s, one(valid, "popularity"), one(test, "popularity"), 10, rounds=3)
    assert top.groupBy("user_idx").count().agg(F.max("count")).first()[0] <= 10
    rows = {r["pair"]: r for r in runs.compare_rankers(s.gold, {"list": one(test, "popularity"), "trees": top, "markov": one(test, "markov")}, 5, 50).collect()}
    assert set(rows) == {"list_vs_trees", "list_vs_markov", "trees_vs_markov"} and len({r["n_users"] for r in rows.values()}) == 1
    for r in rows.values():
        assert r["mean_delta"] == pytest.approx(r["recall_a"] - r["recall_b"]) and r["gained"] - r["lost"] == pytest.approx(r["mean_delta"] * r["n_users"])
    assert learned.ablated(("sbert", "bpr", "popularity"), "no_text") == ["bpr", "popularity"] and learned.ablated(("sbert", "bpr"), "no_cf") == ["sbert"]


def test_rerank_variants_of_several_models(spark):
    rows = spark.createDataFrame([(1, 2, "a b"), (1, 3, "c")], "user_idx long, item_idx long, title string")
    prompts = {name: (lambda df, word=name: df.withColumn("prompt", F.concat("title", F.lit(f"\nCandidate: {word}")))) for name in ("a", "c")}
    got = runs.rerank_variants(rows, prompts, {"x": rerank.overlap_stub, "y": lambda pdf: pdf["prompt"].str.len().astype(float)})
    assert got.groupBy("variant").count().count() == 4
    assert {r["score"] for r in got.where("variant = 'x_a' and item_idx = 2").collect()} == {1.0}
    assert {r[0] for r in runs.rerank_variants(rows, prompts, {"x": rerank.overlap_stub}).select("variant").distinct().collect()} == {"a", "c"}
