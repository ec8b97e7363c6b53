"""Whole runs: split, baselines, retrieval, failure analysis, fusion, end to end. Each returns DataFrames and writes Parquet where a folder is given."""

from __future__ import annotations

import logging
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankforge.functions import columns
from rankforge.operators import ceiling, fuse, learned, metrics, ranking, rerank, retrieve, scorers, split, stats, trainers
from rankforge.plans.config import FusionConfig, SplitConfig
from rankforge.plans.report import report, run_models
from rankforge.schema import K_LIST
from rankforge.sources.readers import exists, listed

LOGGER = logging.getLogger("rankforge")
#: Below this effect and above this rate, a failure analysis warns.
SMALL_EFFECT, MANY_TIES = 0.2, 0.05

TABLES = ("train", "valid", "test", "candidates", "valid_candidates", "items_mapped", "users_mapped", "item_stats", "rerank_eval_users")


@dataclass(frozen=True)
class Split:
    """The tables of a split, read back from their folder."""

    spark: SparkSession
    folder: str

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}")

    @property
    def gold(self) -> DataFrame:
        return split.gold(self.test)

    @property
    def seen(self) -> DataFrame:
        return self.train.select("user_idx", "item_idx").union(self.valid.select("user_idx", "item_idx"))


def prepare(log: DataFrame, items: DataFrame, folder: str, config: SplitConfig = SplitConfig(), hard: DataFrame | None = None, sample_users: int = 200) -> Split:
    """Positives, k-core, dense ids, split, flags, pools, strata. log: user_id, item_id, rating, timestamp; items: item_id, title, text.

    A folder that has all tables is taken as it is.
    """
    spark = log.sparkSession
    if all(exists(spark, f"{folder}/{t}/_SUCCESS") for t in TABLES):
        return Split(spark, folder)

    def write(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    rows = log.where(F.col("rating") >= config.rating_threshold).select(F.col("user_id").alias("user_idx"), F.col("item_id").alias("item_idx"), "rating", F.col("timestamp").alias("ts"))
    rows = split.kcore(rows, config.min_user_interactions, config.min_item_interactions).withColumnsRenamed({"user_idx": "user_id", "item_idx": "item_id"})
    users = write(ranking.dense_index(rows, "user_id", "user_idx"), "users_mapped")
    known = items.join(rows.select("item_id").distinct(), "item_id", "left_semi")
    mapped = write(ranking.dense_index(known, "item_id", "item_idx").join(known, "item_id"), "items_mapped")
    rows = rows.join(users, "user_id").join(mapped.select("item_id", "item_idx"), "item_id").select("user_idx", "item_idx", "rating", "ts")
    # Rows that agree in all of these are interchangeable.
    rows = rows.withColumn("k1", F.lit(0).cast("long")).withColumn("k2", F.lit(0).cast("long"))
    parts = split.temporal_split(rows, config.train_share, config.valid_end)
    if config.test_per_user is not None:
        parts = split.leave_last(parts.drop("part"), config.valid_per_user or 0, config.test_per_user)
    parts = write(parts, "_parts")
    train, valid = write(parts.where("part = 'train'").drop("part"), "train"), write(parts.where("part = 'valid'").drop("part"), "valid")
    limits = split.thresholds(train, config.item_cold_quantile, config.long_tail_quantile, config.user_cold_quantile)
    test = parts.where("part = 'test'").drop("part")
    if config.max_test_users is not None:
        test = test.join(ranking.sample_users(test, config.max_test_users, config.seed), "user_idx", "left_semi")
    test = write(split.with_flags(test, train, limits), "test")
    write(split.item_stats(train, mapped, limits), "item_stats")
    catalogue = mapped.select("item_idx")

    def pool(part: DataFrame) -> DataFrame:
        g = split.gold(part)
        out = split.popularity_candidates(g, train, train, config.num_negatives, config.seed) if config.negative_sampling == "popularity" else split.uniform_candidates(g, train, catalogue, config.num_negatives, config.seed)
        if hard is None:
            return out
        ids = hard.join(users, "user_id").join(mapped.select("item_id", "item_idx"), "item_id").select("user_idx", "item_idx")
        return split.hard_first(out, ids.join(out.select("user_idx").distinct(), "user_idx", "left_semi"), config.num_negatives)

    write(pool(test), "candidates")
    write(pool(valid), "valid_candidates")
    write(split.rerank_users(test, sample_users, config.seed), "rerank_eval_users")
    return Split(spark, folder)


def baselines(s: Split, vectors: DataFrame | None = None, fusion: FusionConfig = FusionConfig(), sasrec: tuple[trainers.SequenceModel, DataFrame] | None = None, how: Mapping[str, float] | None = None) -> dict[str, Callable[[], DataFrame]]:
    """Scorers of the candidate pool by name; ``run_models`` runs them with failures kept apart. how: settings of training (dim, epochs, rate)."""
    pool, train, items, how = s.candidates, s.train, s.items_mapped, dict(how or {})

    out: dict[str, Callable[[], DataFrame]] = {
        "popularity": lambda: scorers.popularity(pool, train),
        "itemknn": lambda: scorers.itemknn(pool, train),
        "tfidf": lambda: scorers.tfidf(pool, train, items),
        "markov": lambda: scorers.markov(pool, train),
        "bpr": lambda: dot_scores(pool, *trainers.fit_bpr(train, **how)),
        "lightgcn": lambda: dot_scores(pool, *trainers.fit_lightgcn(train, **how)),
        "als": lambda: dot_scores(pool, *trainers.als(train)),
        "decayed_markov": lambda: scorers.gather(pool, trainers.decayed_markov(train)),
    }
    if sasrec is not None:
        out["sasrec"] = lambda: dot_scores(pool, *sequential(train, *sasrec))
    if vectors is not None:
        out["embedding"] = lambda: scorers.embedding(pool, train, vectors)
        out["two_tower"] = lambda: dot_scores(pool, *two_tower(train, vectors, **how))
        out["graph_aware"] = lambda: scorers.graph_aware(pool, out["embedding"](), out["lightgcn"](), out["itemknn"](), out["popularity"](), s.item_stats, fusion.alpha, fusion.beta, fusion.gamma, fusion.popularity_penalty, fusion.tail_boost)
    return out


def two_tower(train: DataFrame, vectors: DataFrame, window: int = 10, kinds: DataFrame | None = None, **how: float) -> tuple[DataFrame, DataFrame]:
    """(users, items) with embeddings: profiles of the last items and item vectors, each through its trained projection.

    kinds (item_idx, kind): where many items share a vector, ``vectors`` has one row for
    each kind, with the kind as item_idx, and so have the items that are returned.
    """
    unit = scorers.unit_rows(vectors)
    rows, history = train.select("user_idx", "item_idx").distinct(), ranking.recent(train, window).select("user_idx", "item_idx")
    if kinds is not None:
        rows, history = (x.join(kinds, "item_idx").select("user_idx", F.col("kind").alias("item_idx")) for x in (rows, history))
    packs = trainers.settled(trainers.packed_rows(scorers.profiles(unit, history), unit, rows))
    a, b = trainers.fit_towers(packs, **how)
    return trainers.project_users(packs, a), trainers.project(unit, b, "item_idx", "v")


#: Texts that encoders of these names expect before a document (fixed values).
PREFIXES = {"sbert": "", "bge_large": "", "bge_m3": "", "e5_large": "passage: "}


def encode_items(items: DataFrame, encode: Callable[[list[str]], Sequence[Sequence[float]]], name: str = "sbert", batch: int = 256) -> DataFrame:
    """item_idx, embedding: item texts through a plugged-in encoder (list of texts to list of vectors), with the prefix of its name."""
    import pyarrow as pa

    prefix = PREFIXES.get(name, "")

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, batch):
                part = b.slice(at, batch)
                texts = [prefix + (t or "") for t in part.column(1).to_pylist()]
                yield pa.record_batch([part.column(0), pa.array([[float(x) for x in v] for v in encode(texts)], pa.list_(pa.float64()))], ["item_idx", "embedding"])

    return items.select(F.col("item_idx").cast("long"), F.col("text").cast("string")).mapInArrow(run, "item_idx long, embedding array<double>")


def sequential(train: DataFrame, model: trainers.SequenceModel, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(users, items) with embeddings by a plugged-in sequence model; items: item_idx, embedding."""
    return trainers.encode_sequences(train, model), items


def dot_scores(pool: DataFrame, users: DataFrame, items: DataFrame) -> DataFrame:
    from rankforge.functions.columns import dot

    df = pool.join(users.withColumnRenamed("embedding", "__u"), "user_idx", "left").join(items.withColumnRenamed("embedding", "__v"), "item_idx", "left")
    return df.withColumn("score", F.coalesce(F.round(dot(F.col("__u"), F.col("__v")), scorers.DIGITS), F.lit(0.0))).drop("__u", "__v")


def score_all(models: Mapping[str, Callable[[], DataFrame]], folder: str) -> tuple[list[str], dict[str, str]]:
    """Writes each model's scores as a partition of one table; (names that worked, failures)."""
    def sink(name: str, scored: DataFrame) -> None:
        scored.select("user_idx", "item_idx", F.col("score").cast("double").alias("score")).write.mode("overwrite").parquet(f"{folder}/model={name}")

    failed = run_models(dict(models), sink)
    return [m for m in models if m not in failed], failed


def failure_analysis(s: Split, scored: DataFrame, k_list: Sequence[int] = K_LIST, seed: int = 42, n_boot: int = 1000) -> dict[str, DataFrame]:
    """Metrics, subgroups, intervals, ties, separation, pool order and counts of all models in ``scored`` (model, user_idx, item_idx, score)."""
    g, out = s.gold, {}
    parts: dict[str, list[DataFrame]] = {"metrics": [], "subgroups": [], "intervals": [], "ties": [], "separation": []}
    for (m,) in scored.select("model").distinct().orderBy("model").collect():
        own = scored.where(F.col("model") == m).drop("model")
        # Models that score some users only are judged on those.
        users = g.join(own.select("user_idx").distinct(), "user_idx", "left_semi")
        ranked = ranking.rank_scored(own, seed)
        tag = lambda df, m=m: df.withColumn("model", F.lit(m))
        parts["metrics"].append(tag(metrics.evaluate(own, users, s.item_stats, k_list, seed)))
        parts["subgroups"].append(tag(metrics.subgroups(users, ranked, k_list)))
        parts["intervals"].append(tag(stats.bootstrap(stats.per_user(metrics.gold_rank(users, ranked), k_list), n_boot, seed=seed)))
        parts["ties"].append(tag(metrics.tie_diagnostic(own, users, k_list)))
        parts["separation"].append(tag(metrics.separation(own, users)))
    for name, frames in parts.items():
        df = None
        for f in frames:
            df = f if df is None else df.unionByName(f)
        if df is not None:
            out[name] = df
    out["pool_order"] = metrics.oracle_recall(g, s.candidates, k_list)
    out["scenario_counts"] = metrics.scenario_counts(s.test)
    out["pool_sizes"] = metrics.pool_sizes(s.candidates)
    return out


def retrieval(s: Split, n: int = 200, names: Sequence[str] = ("popularity", "itemknn", "tfidf", "markov", "embedding", "graph_cooccur", "graph_emb", "recency", "als", "bpr", "lightgcn", "two_tower"), vectors: DataFrame | Mapping[str, DataFrame] | None = None, on: str = "test", sasrec: tuple[trainers.SequenceModel, DataFrame] | None = None, how: Mapping[str, float] | None = None) -> tuple[DataFrame | None, dict[str, str]]:
    """Long pools (user_idx, item_idx, score, rank, model) of the named retrievers, and the failures. On validation, only training rows count as seen.

    vectors: item vectors of a text encoder, or of several by name, each of which is a retriever of that name (sbert, bge, e5); ``encode_items`` makes them.
    how: settings of training (dim, epochs, rate).
    """
    how = dict(how or {})
    train, items = s.train, s.items_mapped
    users = (s.test if on == "test" else s.valid).select("user_idx").distinct()
    seen = s.seen if on == "test" else train.select("user_idx", "item_idx")

    def by_vectors(u: DataFrame, v: DataFrame) -> DataFrame:
        u = u.join(users, "user_idx", "left_semi").withColumnRenamed("embedding", "u")
        return retrieve.dense_lists(u, v.withColumnRenamed("embedding", "v"), seen, n)

    encoders = {} if vectors is None else dict(vectors) if isinstance(vectors, Mapping) else {"embedding": vectors}

    def need() -> DataFrame:
        if not encoders:
            raise ValueError("item vectors are needed")
        return next(iter(encoders.values()))

    def model() -> tuple[trainers.SequenceModel, DataFrame]:
        if sasrec is None:
            raise ValueError("a sequence model and its item vectors are needed")
        return sasrec

    graph = cache(lambda: trainers.fit_lightgcn(train, **how))  # trained once for both retrievers that use it

    reg = retrieve.Registry(
        popularity=lambda: retrieve.popularity(users, train, items, seen, n),
        itemknn=lambda: retrieve.itemknn(users, train, seen, n),
        tfidf=lambda: retrieve.tfidf(users, train, items, seen, n),
        markov=lambda: retrieve.markov(users, train, seen, n),
        embedding=lambda: retrieve.embedding(users, train, need(), seen, n),
        graph_cooccur=lambda: retrieve.graph_expansion(users, train, retrieve.cooccurrence(train), seen, n),
        graph_emb=lambda: retrieve.graph_expansion(users, train, retrieve.vector_neighbours(graph()[1]), seen, n),
        recency=lambda: retrieve.recency(users, train, items, seen, n),
        als=lambda: by_vectors(*trainers.als(train)),
        bpr=lambda: by_vectors(*trainers.fit_bpr(train, **how)),
        lightgcn=lambda: by_vectors(*graph()),
        two_tower=lambda: by_vectors(*two_tower(train, need(), **how)),
        sasrec=lambda: by_vectors(*sequential(train, *model())),
    )
    for name, own in encoders.items():
        reg.setdefault(name, lambda own=own: retrieve.embedding(users, train, own, seen, n))
    return reg.run(list(names))


def fused(pools: DataFrame, users: DataFrame, n: int, components: Sequence[str]) -> DataFrame:
    """Pools and their fusions: rrf, interleave, and cara with equal shares where a component has no budget of its own."""
    present = {r["model"] for r in pools.select("model").distinct().collect()}
    names = [c for c in components if c in present]
    if missing := [c for c in components if c not in present]:
        LOGGER.warning("not among the pools: %s", ", ".join(missing))
    if len(names) < 2:
        LOGGER.warning("nothing to fuse: %d of the components are there", len(names))
        return pools
    def profile(shares: Mapping[str, float]) -> dict[str, float]:
        return {m: shares.get(m, 1 / len(names)) for m in names}

    out = pools.select("user_idx", "item_idx", F.col("rank").cast("int").alias("rank"), "model")
    for name, df in (("rrf", fuse.rrf(pools, names, n)), ("interleave", fuse.interleave(pools, names, n)), ("cara", fuse.cara(pools, users, n, profile(fuse.CARA_COLD), profile(fuse.CARA_WARM)))):
        out = out.unionByName(df.select("user_idx", "item_idx", F.col("rank").cast("int").alias("rank")).withColumn("model", F.lit(name)))
    return out


def coverage_report(pools: DataFrame, gold: DataFrame, n: int) -> dict[str, DataFrame]:
    cov = metrics.coverage(pools, gold, n)
    top = ceiling.union_coverage(cov, pools, gold, n)
    return {"coverage": cov, "ceiling": top, "regret": ceiling.regret(cov, top), "headroom": ceiling.headroom(cov, top), "curve": metrics.recall_curve(pools, gold)}


def end_to_end(pools: DataFrame, gold: DataFrame, prompts: Callable[[DataFrame], DataFrame], scorer, k: int = 10, n: int = 50) -> DataFrame:
    """model, coverage, retriever recall, recall after reranking, conditional success. prompts adds a ``prompt`` column to (user_idx, item_idx)."""
    from pyspark.sql.window import Window

    rows = pools.where(F.col("rank") <= n).join(gold.select("user_idx", "true_item"), "user_idx")
    scored = rerank.score_with(prompts(rows), scorer)
    again = F.row_number().over(Window.partitionBy("model", "user_idx").orderBy(F.desc(F.round("score", 9)), "rank", "item_idx"))
    mine = (F.col("item_idx") == F.col("true_item")).cast("int")
    sums = scored.withColumn("again", again).groupBy("model").agg(F.sum(mine).alias("g"), F.sum(mine * (F.col("rank") <= k).cast("int")).alias("a"), F.sum(mine * (F.col("again") <= k).cast("int")).alias("b"))
    total = gold.agg(F.count(F.lit(1)).alias("t"))
    return sums.join(F.broadcast(total)).select("model", (F.col("g") / F.col("t")).alias("coverage"), (F.col("a") / F.col("t")).alias("retriever_recall"), (F.col("b") / F.col("t")).alias("e2e_recall"), ceiling.conditional_success(F.col("b"), F.col("g")).alias("conditional_recall"))


def learned_fusion(s: Split, test_pools: DataFrame, valid_pools: DataFrame | None, models: Sequence[str], n: int, kind: str = "gbt", ablation: str = "", rounds: int = 300, regime: Mapping[str, float] | None = None) -> DataFrame:
    """The first n of the union by a learned ranker: fitted on validation pools, or cross-fitted on the test pools where there are none."""
    models = learned.ablated(models, ablation)
    names = learned.feature_names(models, ablation)
    test = learned.features(test_pools, models, n, s.gold, s.train, s.items_mapped)
    if valid_pools is None:
        p = learned.cross_fit(test, kind, names, rounds=rounds)
    else:
        p = learned.valid_fit(learned.features(valid_pools, models, n, split.gold(s.valid), s.train, s.items_mapped), test, kind, names, rounds=rounds, regime=regime)
    return learned.reranked(p, n)


def warnings_of(s: Split, scored: DataFrame, tables: Mapping[str, DataFrame]) -> list[str]:
    """What a reader of a failure analysis should know first: models that miss users, barely separate, or tie too often."""
    total = s.gold.count()
    covered = scored.join(s.gold.select("user_idx"), "user_idx", "left_semi").groupBy("model").agg(F.count_distinct("user_idx").alias("n")).collect()
    out = [f"{r['model']} covers {r['n']} of {total} users; metrics are those of covered users" for r in covered if r["n"] < total]
    if len({r["n"] for r in covered}) > 1:
        out.append("models are evaluated on different numbers of users")
    for r in tables["separation"].select("model", "cohens_d").collect() if "separation" in tables else []:
        if r["cohens_d"] is not None and abs(r["cohens_d"]) < SMALL_EFFECT:
            out.append(f"{r['model']}: Cohen's d is {r['cohens_d']:.3f}, scores hardly tell relevant items from others")
    for r in tables["ties"].select("model", "tie_rate").collect() if "ties" in tables else []:
        if r["tie_rate"] is not None and r["tie_rate"] > MANY_TIES:
            out.append(f"{r['model']}: {100 * r['tie_rate']:.1f} % of users have ties with the true item, ranks are partly arbitrary")
    for text in out:
        LOGGER.warning(text)
    return out


def matrix_shape(train: DataFrame, candidates: DataFrame, items: DataFrame | None = None) -> DataFrame:
    """One row: n_users, n_items, one more than the largest index that any table has."""
    index = lambda df, c: df.select(F.max(c).alias("m"))
    users = index(train, "user_idx").unionAll(index(candidates, "user_idx")).agg((F.max("m") + 1).alias("n_users"))
    found = index(train, "item_idx").unionAll(index(candidates, "item_idx"))
    found = found if items is None else found.unionAll(index(items, "item_idx"))
    return users.join(found.agg((F.max("m") + 1).alias("n_items")))


def find_retrieval(spark: SparkSession, root: str, dataset: str, seed: int) -> str | None:
    """The folder of a retrieval run that has score files: ``<dataset>-retrieval-s<seed>-N*``, else ``<dataset>-top*-s<seed>/retrieval``."""
    for pattern in (f"{root}/{dataset}-retrieval-s{seed}-N*", f"{root}/{dataset}-top*-s{seed}/retrieval"):
        for folder in listed(spark, pattern):
            if exists(spark, f"{folder}/*_scores.csv"):
                return folder
    return None


def read_metrics(spark: SparkSession, folder: str, metric: str) -> dict[str, float]:
    """model -> metric of a run's table of metrics; empty where there is none."""
    path = f"{folder}/all_model_metrics.csv"
    if not exists(spark, path):
        return {}
    df = spark.read.option("header", True).option("inferSchema", True).csv(path)
    return {r["model"]: r[metric] for r in df.select("model", metric).collect()} if metric in df.columns else {}


def write_fused(top: DataFrame, root: str, dataset: str, seed: int, n: int, kind: str = "lhf", tag: str = "") -> str:
    """Writes a learned list as a scored pool whose folder names the variant; returns its path."""
    path = f"{root}/{dataset}-retrieval-s{seed}-N{n}/{kind}{'_' + tag if tag else ''}_scores.csv"
    retrieve.as_pool(top).write.mode("overwrite").option("header", True).csv(path)
    return path


def resources() -> dict[str, float]:
    """What the driver's process has used so far: seconds of CPU, and its largest resident memory in MB."""
    import resource

    used = resource.getrusage(resource.RUSAGE_SELF)
    out = {"cpu_seconds": used.ru_utime + used.ru_stime, "peak_mb": used.ru_maxrss / 1024}
    LOGGER.info("resources: %s", out)
    return out


def second_stage(s: Split, valid_top: DataFrame, test_top: DataFrame, n: int = 50, rounds: int = 200, seed: int = 42) -> DataFrame:
    """The first n of the test lists (user_idx, item_idx, rank, score), ordered by trees that were fitted on the validation lists."""
    items = s.items_mapped
    valid = learned.second_stage(valid_top, s.train, items, split.gold(s.valid))
    test = learned.second_stage(test_top, s.train, items, s.gold)
    return learned.reranked(learned.fit_second_stage(valid, test, seed, rounds), n)


def hits_at(gold: DataFrame, top: DataFrame, k: int) -> DataFrame:
    """user_idx, hit (0 or 1) of the users that a list has."""
    users = gold.join(top.select("user_idx").distinct(), "user_idx", "left_semi")
    return metrics.gold_rank(users, top).select("user_idx", F.coalesce(F.col("rank") <= k, F.lit(False)).cast("double").alias("hit"))


def compare_rankers(gold: DataFrame, lists: Mapping[str, DataFrame], k: int = 10, n_boot: int = 1000, seed: int = 42) -> DataFrame:
    """Every pair of named lists on the users that all of them have: both recalls, mean difference, interval, gained, lost, significant."""
    hits = {name: hits_at(gold, top, k) for name, top in lists.items()}
    names, out = list(hits), None
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            own = [hits[a], hits[b]]
            for other in hits.values():
                own = [h.join(other.select("user_idx"), "user_idx", "left_semi") for h in own]
            row = stats.paired_table(own[0], own[1], n_boot, seed).withColumn("pair", F.lit(f"{a}_vs_{b}"))
            row = row.join(F.broadcast(own[0].agg(F.avg("hit").alias("recall_a")))).join(F.broadcast(own[1].agg(F.avg("hit").alias("recall_b"))))
            out = row if out is None else out.unionByName(row)
    if out is None:
        raise ValueError("two lists at least")
    return out


def rerank_variants(rows: DataFrame, prompts: Mapping[str, Callable[[DataFrame], DataFrame]], scorers_by_name: Mapping[str, Callable]) -> DataFrame:
    """user_idx, item_idx, score, variant: every prompt variant (baseline, evidence, without a part of it) scored by every plugged-in model."""
    out = {f"{model}_{name}" if len(scorers_by_name) > 1 else name: rerank.score_with(prompt(rows), scorer) for model, scorer in scorers_by_name.items() for name, prompt in prompts.items()}
    return rerank.compare(out)


def coverage_at(gold: DataFrame, top: DataFrame, n: int) -> DataFrame:
    """scenario, n_users, coverage: the share of users whose true item is among the first n."""
    r = split.scenario_rows(metrics.gold_rank(gold, top))
    return r.groupBy("scenario").agg(F.count(F.lit(1)).alias("n_users"), F.round(F.avg(F.coalesce(F.col("rank") <= n, F.lit(False)).cast("double")), 6).alias("coverage"))


def freshness_probe(gold: DataFrame, train: DataFrame, items: DataFrame, seen: DataFrame, n: int = 200, share: float = 0.1) -> DataFrame:
    """method, scenario, n_users, coverage of popularity and of popularity by age."""
    users, out = gold.select("user_idx"), None
    for name, top in (("popularity", retrieve.popularity(users, train, items, seen, n)), ("recency", retrieve.recency(users, train, items, seen, n, share))):
        part = coverage_at(gold, top, n).withColumn("method", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def intent_probe(gold: DataFrame, items: DataFrame, seen: DataFrame, history: DataFrame, answers: DataFrame, n: int = 50, quota: int = 20, phrases: int = 5) -> DataFrame:
    """method, scenario, n_users, coverage of history lists, of lists by what users are after, and of their union.

    history: user_idx, item_idx, rank; answers: user_idx, answer, whose lines are
    phrases. A phrase is compared with item texts by TF-IDF, an item's score is its best phrase's.
    """
    said = answers.select("user_idx", F.posexplode(columns.phrases(F.col("answer"), phrases)).alias("phrase", "text"))
    vectors = scorers.tfidf_vectors(items)
    words = said.select("user_idx", "phrase", F.explode(columns.with_bigrams(F.col("text"))).alias("term")).groupBy("user_idx", "phrase", "term").agg(F.count(F.lit(1)).alias("tf"))
    norms = words.groupBy("user_idx", "phrase").agg(F.sqrt(F.sum(F.col("tf") * F.col("tf"))).alias("norm"))
    scores = words.join(vectors, "term").groupBy("user_idx", "phrase", "item_idx").agg(F.sum(F.col("tf") * F.col("x")).alias("dot")).join(norms, ["user_idx", "phrase"])
    scores = rerank.intent_scores(scores.select("user_idx", "phrase", "item_idx", F.round(F.col("dot") / F.col("norm"), scorers.DIGITS).alias("score")))
    intent = retrieve.best(scores, seen, n)
    out = None
    for name, top in (("history", history.where(F.col("rank") <= n)), ("intent", intent), ("union", fuse.quota_union(history, intent, n, quota))):
        part = coverage_at(gold, top, n).withColumn("method", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def write_report(tables: Mapping[str, DataFrame | None], path: str, title: str = "Run") -> None:
    with open(path, "w") as f:
        f.write(report(title, dict(tables)))
