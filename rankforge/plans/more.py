"""Queries over the remaining operators: pools from hard negatives, budgets, expressions, diagnostics, probes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rankforge.functions import columns as C
from rankforge.operators import ceiling, fuse, learned, metrics, ranking, rerank, scorers, split, stats
from rankforge.plans import catalog as K
from rankforge.plans import oracles as O
from rankforge.plans import runs
from rankforge.plans.context import MODELS, RETRIEVED
from rankforge.plans.registry import query, r6
from rankforge.sources import datasets


@query("SELECT o_custkey AS user_idx, count(*) AS n_positives, count(DISTINCT l_partkey) AS n_items FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity >= 40 GROUP BY 1")
def rating_threshold(c):
    rows = datasets.from_orders(c.spark, c.sf_dir, 40)
    return rows.groupBy("user_idx").agg(F.count(F.lit(1)).alias("n_positives"), F.count_distinct("item_idx").alias("n_items"))


VALID = O.BASE.replace("WHERE t.part = 'test'", "WHERE t.part = 'valid'")


@query(O.with_(VALID, O.CANDIDATES) + "SELECT user_idx, item_idx, label, pool_pos FROM candidates")
def candidates_validation(c):
    """The pool of the users of the validation period."""
    valid = split.with_flags(c.log.where("part = 'valid'"), c.train, c.limits)
    return split.uniform_candidates(split.gold(valid), c.train, c.items, 19)


@query(O.with_(O.BASE, O.CANDIDATES) + """, hard AS (SELECT DISTINCT o_custkey AS user_idx, l_partkey AS item_idx FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity < 10),
both_kinds AS (SELECT user_idx, item_idx, label, pool_pos, CASE WHEN label = 1 THEN 0 ELSE 2 END AS p FROM candidates UNION ALL SELECT h.user_idx, h.item_idx, 0, 0, 1 FROM hard h JOIN gold g ON g.user_idx = h.user_idx AND g.true_item <> h.item_idx),
once AS (SELECT * FROM both_kinds QUALIFY row_number() OVER (PARTITION BY user_idx, item_idx ORDER BY p) = 1),
placed AS MATERIALIZED (SELECT user_idx, item_idx, label, row_number() OVER (PARTITION BY user_idx ORDER BY p, pool_pos, item_idx)::INT AS at_place FROM once)
SELECT user_idx, item_idx, label, at_place AS pool_pos FROM placed WHERE at_place < 13""")
def candidates_hard(c):
    """Purchases of few pieces stand for what was shown and not clicked."""
    few = datasets.from_orders(c.spark, c.sf_dir, 0).where("rating < 10").select("user_idx", "item_idx")
    return split.hard_first(c.candidates, few, 11)


@query(O.with_(O.BASE, O.CANDIDATES) + "SELECT user_idx FROM candidates GROUP BY 1 ORDER BY min(pool_pos), user_idx LIMIT 50")
def first_users(c):
    return ranking.first_users(c.candidates, 50)


@query(O.with_(O.BASE, O.CANDIDATES) + "SELECT greatest((SELECT max(user_idx) FROM train), (SELECT max(user_idx) FROM candidates)) + 1 AS n_users, greatest((SELECT max(item_idx) FROM train), (SELECT max(item_idx) FROM candidates), (SELECT max(item_idx) FROM items)) + 1 AS n_items")
def matrix_shape(c):
    return runs.matrix_shape(c.train, c.candidates, c.items)


@query("""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), h AS (SELECT vec_id, e[1:32] AS a, e[33:64] AS b FROM v),
l AS (SELECT vec_id, list_max(a) + ln(list_sum(list_transform(a, lambda x: exp(x - list_max(a))))) - list_max(b) - ln(list_sum(list_transform(b, lambda x: exp(x - list_max(b))))) AS gap FROM h)
SELECT vec_id, round(gap, 6) AS gap, round(100 / (1 + exp(-gap)), 6) AS score FROM l""")
def log_odds(c):
    """The first half of a vector against the second: log-sum-exp, and the difference as a percentage."""
    e = F.col("embedding").cast("array<double>")
    df = c.spark.read.parquet(f"{c.sf_dir}/embeddings.parquet").select("vec_id", (C.logsumexp(F.slice(e, 1, 32)) - C.logsumexp(F.slice(e, 33, 32))).alias("gap"))
    return df.select("vec_id", r6(F.col("gap"), "gap"), r6(C.probability(F.col("gap")), "score"))


@query(O.with_(O.BASE, O.RECENT.format(n=50)) + """, dir AS (SELECT a.item_idx AS item_a, b.item_idx AS item_b FROM recent a JOIN recent b USING (user_idx) WHERE a.back > b.back AND a.item_idx <> b.item_idx GROUP BY 1, 2 HAVING count(*) >= 2)
SELECT item_a, item_b FROM dir UNION SELECT item_b, item_a FROM dir""")
def directed_cooccurrence(c):
    return rerank.directed_cooccurrence(c.train)


def _model(c, name: str) -> DataFrame:
    return c.pools_of((name,))


@query(O.with_(*K.POOLS) + """, phased AS (SELECT user_idx, item_idx, rank, CASE WHEN rank <= 14 THEN 0 ELSE 2 END AS phase FROM pools WHERE model = 'itemknn' UNION ALL SELECT user_idx, item_idx, rank, 1 FROM pools WHERE model = 'embedding'),
firsts AS (SELECT user_idx, item_idx, min({'p': phase, 'r': rank}) AS p FROM phased GROUP BY 1, 2), placed AS MATERIALIZED (SELECT user_idx, item_idx, row_number() OVER (PARTITION BY user_idx ORDER BY p, item_idx) AS rank FROM firsts)
SELECT user_idx, item_idx, rank FROM placed WHERE rank < 21""")
def quota_union(c):
    out = fuse.quota_union(_model(c, "itemknn"), _model(c, "embedding"), 20, 6)
    return out.select("user_idx", "item_idx", F.col("rank").cast("long").alias("rank"))


PRESETS = fuse.preset_quotas(MODELS, 50)
PRESET_SQL = "presets AS (SELECT * FROM (VALUES " + ", ".join(f"('{p}', '{m}', {q})" for p, g in PRESETS.items() for m, q in g.items()) + ") t(preset, model, quota))"


@query(O.with_(*K.POOLS, PRESET_SQL) + "SELECT preset, round(count(DISTINCT CASE WHEN rank <= quota THEN g.user_idx END) / (SELECT count(*) FROM gold)::DOUBLE, 6) AS coverage FROM presets s LEFT JOIN pools p USING (model) LEFT JOIN gold g ON g.user_idx = p.user_idx AND g.true_item = p.item_idx GROUP BY 1")
def preset_quotas(c):
    """Equal shares, and shares of 70 to 30 between collaborative and other retrievers."""
    cov = fuse.quota_coverage(c.pools, c.gold, list(PRESETS.values()))
    names = F.element_at(F.array(*[F.lit(p) for p in PRESETS]), F.col("quota_id") + 1)
    return cov.select(names.alias("preset"), r6(F.col("coverage"), "coverage"))


@query(O.with_(*K.POOLS, K.COVERAGE) + "SELECT scenario, round(union_coverage - best_single, 6) AS gain, CASE WHEN union_coverage - best_single > 0.02 THEN 'yes' WHEN union_coverage - best_single > 0 THEN 'weak' ELSE 'no' END AS verdict FROM ceiling")
def verdicts(c):
    """Whether the union of all pools is worth more than the best of them."""
    top = ceiling.union_coverage(metrics.coverage(c.pools, c.gold, RETRIEVED), c.pools, c.gold, RETRIEVED)
    gain = F.col("union_coverage") - F.col("best_single")
    return top.select("scenario", r6(gain, "gain"), ceiling.verdict(gain).alias("verdict"))


BONUS = "bonus AS (SELECT s.user_idx, s.item_idx, s.score + CASE WHEN is_tail THEN 5 ELSE 0 END AS score FROM scored s LEFT JOIN stats USING (item_idx))"
VARIANTS = "variants AS MATERIALIZED (SELECT 'full' AS variant, user_idx, item_idx, score FROM bonus UNION ALL SELECT 'no_tail', user_idx, item_idx, score FROM scored UNION ALL SELECT 'no_evidence', c.user_idx, c.item_idx, coalesce(score, 0) FROM candidates c LEFT JOIN markov_scores USING (user_idx, item_idx))"
AT_TEN = "ranked_variants AS (SELECT variant, user_idx, item_idx, row_number() OVER (PARTITION BY variant, user_idx ORDER BY score DESC, md5(concat_ws(':', 42, user_idx, item_idx)), item_idx) AS rank FROM variants), at_ten AS MATERIALIZED (SELECT variant, sum(CASE WHEN rank <= 10 THEN 1 ELSE 0 END) / (SELECT count(*) FROM gold)::DOUBLE AS recall FROM ranked_variants r JOIN gold g ON g.user_idx = r.user_idx AND g.true_item = r.item_idx GROUP BY 1)"
VARIANT_PARTS = (O.BASE, O.CANDIDATES, O.POPULARITY, O.MARKOV, BONUS, VARIANTS)


def _variants(c) -> DataFrame:
    pop = scorers.popularity(c.candidates, c.train)
    return rerank.compare({"full": rerank.with_tail_bonus(pop, c.stats), "no_tail": pop, "no_evidence": scorers.markov(c.candidates, c.train)})


@query(O.with_(*VARIANT_PARTS) + "SELECT variant, user_idx, item_idx, score::DOUBLE AS score FROM variants")
def rerank_variants(c):
    """A reranker's variants side by side; popularity with a bonus for tail items stands for the model."""
    return _variants(c).select("variant", "user_idx", "item_idx", "score")


@query(O.with_(*VARIANT_PARTS, AT_TEN) + """, w AS (SELECT max(recall) FILTER (variant = 'full') AS f, max(recall) FILTER (variant = 'no_evidence') AS e, max(recall) FILTER (variant = 'no_tail') AS t FROM at_ten)
SELECT round(f - e, 6) AS evidence, round(f - t, 6) AS tail, round((f - t) / nullif((f - t) + greatest(f - e, 0), 0), 6) AS share FROM w""")
def evidence_tail_decomposition(c):
    v = _variants(c).withColumn("rank", F.row_number().over(Window.partitionBy("variant", "user_idx").orderBy(F.desc("score"), ranking.tie_key(42, "user_idx", "item_idx"), "item_idx")))
    hits = v.join(c.gold.select("user_idx", F.col("true_item").alias("item_idx")), ["user_idx", "item_idx"]).groupBy("variant").agg(F.sum((F.col("rank") <= 10).cast("int")).alias("n"))
    n = c.gold.agg(F.count(F.lit(1)).alias("t"))
    pick = lambda name: F.max(F.when(F.col("variant") == name, F.col("n") / F.col("t")))
    row = hits.join(F.broadcast(n)).agg(pick("full").alias("f"), pick("no_evidence").alias("e"), pick("no_tail").alias("t"))
    evidence, tail, share = ceiling.tail_prior(F.col("f"), F.col("e"), F.col("t"))
    return row.select(r6(evidence, "evidence"), r6(tail, "tail"), r6(share, "share"))


@query(O.with_(O.BASE, O.CANDIDATES, O.MARKOV) + ", s AS (SELECT coalesce(score, 0) AS score FROM candidates LEFT JOIN markov_scores USING (user_idx, item_idx)) SELECT count(*) AS n, sum((score = 0)::INT)::BIGINT AS issues, round(avg((score = 0)::INT::DOUBLE), 6) AS issue_rate FROM s")
def issue_rate(c):
    """Pairs that a scorer says nothing of."""
    return rerank.issue_rate(scorers.markov(c.candidates, c.train), F.col("score") == 0)


REGIME = {"item_new": 5.0, "user_cold": 2.0}


@query(K._lhf_sql().replace("SELECT f.*, coalesce(uc.c", ", rows_of AS MATERIALIZED (SELECT f.*, coalesce(uc.c").rstrip() + """), n AS (SELECT count(*) AS n, sum(label) AS p FROM rows_of),
weighed AS (SELECT label, CASE WHEN label = 1 THEN n / (2 * greatest(p, 1))::DOUBLE * CASE WHEN item_new = 1 THEN 5 WHEN user_cold = 1 THEN 2 ELSE 1 END ELSE n / (2 * greatest(n - p, 1))::DOUBLE END AS w FROM rows_of, n)
SELECT label, count(*) AS n_rows, round(sum(w), 4) AS mass FROM weighed GROUP BY 1""")
def regime_weights(c):
    """Classes of equal mass, positives of new items five times, of cold users twice."""
    df = learned.features(c.pools, K.LHF_MODELS, RETRIEVED, c.gold, c.train, c.items)
    return learned.balanced(df, REGIME).groupBy("label").agg(F.count(F.lit(1)).alias("n_rows"), r6(F.sum("weight"), "mass", 4))


@query(K._lhf_sql().replace("SELECT f.*, coalesce(uc.c", ", rows_of AS MATERIALIZED (SELECT f.*, coalesce(uc.c").rstrip() + ") SELECT count(*) AS n_rows, sum(rank_itemknn)::BIGINT AS ranks, (count(*) * 201)::BIGINT AS missing_ranks, 0::BIGINT AS missing_scores FROM rows_of")
def aligned_features(c):
    """Features of a retriever that is not there: one beyond the list for ranks, 0 for scores."""
    df = learned.aligned(learned.features(c.pools, K.LHF_MODELS, RETRIEVED, c.gold, c.train, c.items), ["rank_itemknn", "rank_sbert", "score_sbert"])
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.sum("rank_itemknn").alias("ranks"), F.sum("rank_sbert").alias("missing_ranks"), F.sum("score_sbert").cast("long").alias("missing_scores"))


@query(O.with_(*K.POOLS) + """, listed AS (SELECT user_idx, item_idx, rank, score FROM pools WHERE model = 'itemknn')
SELECT l.user_idx, l.item_idx, rank::INT AS lhf_rank, score::DOUBLE AS lhf_score, round(1 / (rank + 1)::DOUBLE, 6) AS lhf_recip, coalesce(uc.c, 0) AS user_hist_len, coalesce(ic.c, 0) AS item_pop, round(ln(1 + coalesce(ic.c, 0)), 6) AS item_logpop, (coalesce(ic.c, 0) = 0)::INT AS item_new, length(i.text)::INT AS item_textlen, (g.true_item = l.item_idx)::INT AS label
FROM listed l LEFT JOIN uc USING (user_idx) LEFT JOIN ic USING (item_idx) LEFT JOIN items i USING (item_idx) JOIN gold g USING (user_idx)""")
def second_stage_features(c):
    df = learned.second_stage(_model(c, "itemknn"), c.train, c.items, c.gold)
    for x in ("lhf_recip", "item_logpop"):
        df = df.withColumn(x, F.round(x, 6))
    return df.withColumn("lhf_rank", F.col("lhf_rank").cast("int"))


DELTA = (
    "delta AS MATERIALIZED (SELECT a.user_idx, a.hit - b.hit AS d FROM a JOIN b USING (user_idx))",
    "resampled AS (SELECT d, b, ('0x' || substr(md5(concat_ws(':', 42, user_idx, b // 8)), ((b % 8) * 4 + 1)::INT, 4))::INT AS bits FROM delta, range(0, 1000) t(b))",
    "counted_in AS (SELECT *, " + " + ".join(f"(bits >= {x})::INT" for x in stats.POISSON) + " AS w FROM resampled)",
    "means AS MATERIALIZED (SELECT sum(w * d) / sum(w) AS m FROM counted_in WHERE w > 0 GROUP BY b)",
    "ends AS (SELECT quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi FROM means)",
)


@query(O.with_(*K.POOLS, *K.HITS, *DELTA) + "SELECT n_users, mean_delta, gained, lost, round(lo, 6) AS ci_low, round(hi, 6) AS ci_high, lo > 0 OR hi < 0 AS significant FROM (SELECT count(*) AS n_users, round(avg(d), 6) AS mean_delta, count(*) FILTER (d > 0) AS gained, count(*) FILTER (d < 0) AS lost FROM delta), ends")
def paired_interval(c):
    t = stats.paired_table(K._hits(c, "itemknn", 20), K._hits(c, "embedding", 20))
    return t.select("n_users", r6(F.col("mean_delta"), "mean_delta"), "gained", "lost", r6(F.col("ci_low"), "ci_low"), r6(F.col("ci_high"), "ci_high"), "significant")


@query(O.with_(O.BASE, O.POP_ITEMS, K.RECENCY, O.ORDER.format(source="pop_items"), O.by_order(50, "pop_list"), O.ORDER.format(source="rec_items").replace("ranked_items", "aged_items"), O.by_order(50, "aged_list").replace("ranked_items", "aged_items"))
       + f", lists AS (SELECT 'popularity' AS method, * FROM pop_list UNION ALL SELECT 'recency', * FROM aged_list), gs AS MATERIALIZED (SELECT g.user_idx, g.true_item, s.scenario::VARCHAR AS scenario, m.method::VARCHAR AS method FROM gold g, {O.NAMES}, (VALUES ('popularity'), ('recency')) m(method) WHERE {O.IN_SCENARIO}) SELECT g.method, scenario, count(*) AS n_users, round(avg(CASE WHEN l.item_idx IS NULL THEN 0::DOUBLE ELSE 1 END), 6) AS coverage FROM gs g LEFT JOIN lists l ON l.method = g.method AND l.user_idx = g.user_idx AND l.item_idx = g.true_item GROUP BY 1, 2")
def freshness_probe(c):
    return runs.freshness_probe(c.gold, c.train, c.items, c.seen, 50).select("method", "scenario", "n_users", "coverage")


INTENT = r"""said AS MATERIALIZED (SELECT user_idx, item_idx AS phrase, title AS said_text FROM recent JOIN items USING (item_idx) JOIN gold USING (user_idx) WHERE back <= 2),
said_toks AS (SELECT user_idx, phrase, regexp_extract_all(lower(said_text), '[\p{L}\p{N}_]{2,}') AS t FROM said),
said_terms AS (SELECT user_idx, phrase, unnest(list_concat(t, CASE WHEN len(t) > 1 THEN list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]) ELSE [] END)) AS term FROM said_toks),
said_tf AS MATERIALIZED (SELECT user_idx, phrase, term, count(*) AS tf FROM said_terms GROUP BY 1, 2, 3),
said_norm AS (SELECT user_idx, phrase, sqrt(sum(tf * tf)) AS norm FROM said_tf GROUP BY 1, 2),
said_dot AS MATERIALIZED (SELECT s.user_idx, s.phrase, tv.item_idx, sum(tf * x) AS d FROM said_tf s JOIN tv USING (term) GROUP BY 1, 2, 3),
intent_scores AS MATERIALIZED (SELECT user_idx, item_idx, max(round(d / norm, 9)) AS score FROM said_dot JOIN said_norm USING (user_idx, phrase) GROUP BY 1, 2)"""


@query(O.with_(O.BASE, O.RECENT.format(n=50), O.TFIDF, INTENT, O.best("intent_scores", 50, "intent_list"))
       + f", gs AS MATERIALIZED (SELECT g.user_idx, g.true_item, s.scenario::VARCHAR AS scenario FROM gold g, {O.NAMES} WHERE {O.IN_SCENARIO}) SELECT scenario, count(*) AS n_users, round(avg(CASE WHEN l.item_idx IS NULL THEN 0::DOUBLE ELSE 1 END), 6) AS coverage FROM gs LEFT JOIN intent_list l ON l.user_idx = gs.user_idx AND l.item_idx = true_item GROUP BY 1")
def intent_probe(c):
    """The titles of the last two items, as marked lines, stand for a model's answer."""
    last = ranking.recent(c.train, 2).join(c.items, "item_idx").groupBy("user_idx").agg(F.concat_ws("\n", F.collect_list(F.concat(F.lit("- "), "title", F.lit(" -")))).alias("answer"))
    answers = last.join(c.gold.select("user_idx"), "user_idx", "left_semi")
    out = runs.intent_probe(c.gold, c.items, c.seen, _model(c, "itemknn"), answers)
    return out.where("method = 'intent'").select("scenario", "n_users", "coverage")


@query("SELECT 'mix-retrieval-s7-N50' AS found, 2::BIGINT AS n_models")
def find_retrieval(c):
    """A run's folder by dataset and seed, among others without scores or of another seed."""
    root = f"{c.root}/files/runs"
    one = c.spark.createDataFrame([(1, 2, 0.5)], "user_idx long, item_idx long, score double")
    for path in ("mix-retrieval-s7-N50/a_scores.csv", "mix-retrieval-s7-N50/b_scores.csv", "mix-retrieval-s8-N50/a_scores.csv", "mix-retrieval-s7-N10/notes.csv", "mix-top50-s7/retrieval/a_scores.csv"):
        one.write.mode("overwrite").option("header", True).csv(f"{root}/{path}")
    from rankforge.sources import readers

    found = runs.find_retrieval(c.spark, root, "mix", 7)
    scores = readers.scores(c.spark, f"{found}/*_scores.csv")
    return scores.agg(F.lit(found.rsplit("/", 1)[1]).alias("found"), F.count_distinct("model").alias("n_models"))


@query()
def second_stage_trees(c):
    """A fused list, ordered again by trees that were fitted on other users' lists."""
    df = learned.second_stage(_model(c, "itemknn"), c.train, c.items, c.gold)
    p = learned.cross_fit(df, "gbt", learned.SECOND_STAGE, folds=2, rounds=5)
    return runs.compare_rankers(c.gold, {"list": _model(c, "itemknn"), "trees": learned.reranked(p, 50), "embedding": _model(c, "embedding")}, 10, 200)
