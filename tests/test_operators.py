"""Operators on frames whose results are known by hand, and against small plain versions."""

import hashlib
import math

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rankforge.functions import columns as C
from rankforge.operators import ceiling, fuse, learned, metrics, ranking, rerank, retrieve, scorers, split, stats, trainers
from rankforge.plans import config, report

FEW = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow])


def scored(spark, rows):
    return spark.createDataFrame([(u, i, float(s)) for u, i, s in rows], "user_idx long, item_idx long, score double")


def pool(spark, rows):
    return spark.createDataFrame(rows, "user_idx long, item_idx long, label int, pool_pos int")


def gold(spark, rows):
    return spark.createDataFrame(rows, "user_idx long, true_item long")


def log(spark, rows):
    return spark.createDataFrame([(u, i, float(t), p, p, 0) for p, (u, i, t) in enumerate(rows)], "user_idx long, item_idx long, ts double, pos long, k1 long, k2 long")


def asked(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


# ---- metrics


def test_metrics_of_gold_at_first_third_and_no_place(spark):
    s = scored(spark, [(1, 10, 3), (1, 11, 2), (2, 10, 3), (2, 11, 2), (2, 12, 1), (3, 10, 1)])
    r = metrics.gold_rank(gold(spark, [(1, 10), (2, 12), (3, 99)]), ranking.rank_scored(s, None))
    row = r.agg(*metrics.at_k((3,))).first()
    assert row["recall_at_3"] == pytest.approx(2 / 3, abs=1e-6) and row["ndcg_at_3"] == pytest.approx((1 + 0.5) / 3, abs=1e-6) and row["mrr_at_3"] == pytest.approx((1 + 1 / 3) / 3, abs=1e-6)


def test_ties_span_the_whole_list(spark):
    s = scored(spark, [(1, i, 5) for i in range(4)])
    assert asked(ranking.best_worst(s, gold(spark, [(1, 2)])), "best", "worst") == [(1, 4)]
    assert metrics.tie_diagnostic(s, gold(spark, [(1, 2)]), (2,)).first()["tie_rate"] == 1.0


def test_gini(spark):
    df = spark.createDataFrame([(1,)] * 3, "n long")
    assert metrics.gini(df, "n").first()[0] == pytest.approx(0, abs=1e-6)
    assert metrics.gini(spark.createDataFrame([(0,), (0,), (3,)], "n long"), "n").first()[0] == pytest.approx(2 / 3, abs=1e-6)
    assert metrics.gini(df.where("n > 5"), "n").first()[0] == 0


def test_constant_scores(spark):
    s = scored(spark, [(1, i, 7) for i in range(5)])
    assert {r["x"] for r in ranking.minmax(s, "score", "x").collect()} == {0.0}
    assert {r["x"] for r in ranking.percentile_rank(s, "score", "x").collect()} == {60.0}
    sep = metrics.separation(s, gold(spark, [(1, 0)])).first()
    assert sep["overlap_coef"] == 1.0 and sep["cohens_d"] == 0.0 and sep["spearman_r"] == 0.0


@given(st.lists(st.sampled_from([0.0, 0.5, 1.0, -3.25, 1e9, 7.0]), min_size=1, max_size=12))
@FEW
def test_global_percentiles(spark, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, v double")
    for r in ranking.percentile_rank(df, "v", "p", by=None).collect():
        below, same = sum(x < r["v"] for x in values), sum(x == r["v"] for x in values)
        assert r["p"] == pytest.approx((below + (same + 1) / 2) / len(values) * 100)


def test_evaluate_counts_exposure(spark):
    s = scored(spark, [(1, 10, 2), (1, 11, 1), (2, 10, 2), (9, 12, 5)])
    tails = spark.createDataFrame([(10, 5, False), (11, 1, True), (12, 1, True)], "item_idx long, train_count long, is_tail boolean")
    row = metrics.evaluate(s, gold(spark, [(1, 11), (2, 10)]), tails, (1, 2)).first()
    assert (row["unique_exposed_items"], row["unique_tail_exposed_items"], row["recall_at_1"], row["recall_at_2"]) == (2, 1, 0.5, 1.0)
    assert metrics.evaluate(s, gold(spark, [(1, 11)]), tails, (2,), cut=1).first()["recall_at_2"] == 0.0


def test_pool_invariants(spark):
    p = pool(spark, [(1, 1, 1, 1), (1, 2, 0, 2), (2, 3, 1, 1), (2, 4, 0, 2)])
    row = metrics.oracle_recall(gold(spark, [(1, 1), (2, 3)]), p, (1, 2)).first()
    assert row["pool_coverage"] == 1.0 and row["median_true_rank"] == 1.0
    assert metrics.usable_k((5, 10, 20), 12) == [5, 10, 12]


# ---- pools, histories


def test_budget_keeps_positives(spark):
    six = [(1, i, int(i == 6), i) for i in range(1, 7)]
    assert asked(ranking.limit_candidates(pool(spark, six), 3), "pool_pos", "item_idx", "label") == [(1, 1, 0), (2, 2, 0), (3, 6, 1)]
    many = [(1, i, 1, i) for i in range(1, 5)]
    assert asked(ranking.limit_candidates(pool(spark, many), 2), "item_idx") == [(1,), (2,)]
    assert asked(ranking.limit_candidates(pool(spark, six).drop("label"), 2), "item_idx") == [(1,), (2,)]
    with pytest.raises(ValueError):
        ranking.limit_candidates(pool(spark, six), 0)


def plain_budget(rows, k):
    pos = [r for r in rows if r[1]]
    if len(pos) >= k:
        return pos[:k]
    head, late = rows[:k], [r for r in rows[k:] if r[1]]
    drop = [r for r in head if not r[1]][::-1][: len(late)]
    return [r for r in head if r not in drop] + late


@given(st.lists(st.booleans(), min_size=1, max_size=9), st.integers(1, 6))
@FEW
def test_budget_like_the_plain_rule(spark, labels, k):
    rows = [(i, int(x)) for i, x in enumerate(labels)]
    got = ranking.limit_candidates(pool(spark, [(1, i, x, i + 1) for i, x in rows]), k).orderBy("pool_pos").collect()
    assert [(r["item_idx"], r["label"]) for r in got] == plain_budget(rows, k)


def test_smaller_budgets_are_nested(spark):
    p = pool(spark, [(1, i, int(i == 1), i) for i in range(1, 9)])
    small, large = (set(asked(ranking.limit_candidates(p, k), "item_idx")) for k in (3, 6))
    assert small < large


def test_history_and_transitions(spark):
    rows = log(spark, [(1, 5, 1), (1, 6, 2), (1, 7, 2), (2, 5, 1)])
    assert ranking.recent_items(rows, 2).where("user_idx = 1").first()["items"] == [6, 7]
    assert asked(ranking.last_item(rows), "user_idx", "last_item") == [(1, 7), (2, 5)]
    assert asked(ranking.transitions(rows), "item_from", "item_to", "n") == [(5, 6, 1), (6, 7, 1)]
    assert asked(scorers.markov(scored(spark, [(1, 5, 0), (3, 5, 0)]).drop("score"), rows), "user_idx", "score") == [(1, 0.0), (3, 0.0)]
    assert trainers.sequences(rows, 3).where("user_idx = 2").first()["seq"] == [0, 0, 6]


def test_dense_index_of_texts_and_numbers(spark):
    df = spark.createDataFrame([("b",), ("a",), ("ba",), ("b",), (None,), ("é",)], "x string")
    assert asked(ranking.dense_index(df, "x", "i"), "x", "i") == [("a", 0), ("b", 1), ("ba", 2), ("é", 3)]
    assert asked(ranking.dense_index(spark.createDataFrame([(5,), (-3,), (900,)], "x long"), "x", "i"), "x", "i") == [(-3, 0), (5, 1), (900, 2)]


def test_kcore(spark):
    rows = log(spark, [(1, 1, 1), (1, 2, 1), (2, 1, 1), (2, 2, 1), (3, 1, 1), (3, 9, 1), (4, 9, 1)])
    assert asked(split.kcore(rows, 2, 2), "user_idx", "item_idx") == [(1, 1), (1, 2), (2, 1), (2, 2)]


def test_split_counts_and_flags(spark):
    rows = log(spark, [(u, i, u * 86_400 + i) for u in range(10) for i in range(10)])
    parts = split.temporal_split(rows)
    assert asked(parts.groupBy("part").count(), "part", "count") == [("test", 20), ("train", 70), ("valid", 10)]
    train = parts.where("part = 'train'")
    flagged = split.with_flags(parts.where("part = 'test'"), train, split.thresholds(train))
    assert {r["primary_scenario"] for r in flagged.collect()} <= set(split.SCENARIOS)
    assert flagged.where("user_cold").count() == 20  # test users were never in train


def test_hard_negatives_come_first(spark):
    p = pool(spark, [(1, 1, 1, 1), (1, 2, 0, 2), (1, 3, 0, 3)])
    hard = spark.createDataFrame([(1, 8), (1, 1), (1, 3)], "user_idx long, item_idx long")
    assert asked(split.hard_first(p, hard, 3), "pool_pos", "item_idx") == [(1, 1), (2, 3), (3, 8), (4, 2)]


# ---- fusion


def lists(spark, **models):
    return spark.createDataFrame([(m, 1, i, float(len(v) - r), r + 1) for m, v in models.items() for r, i in enumerate(v)], "model string, user_idx long, item_idx long, score double, rank long")


def items_of(df):
    return [r["item_idx"] for r in df.orderBy("rank").collect()]


def test_fusion_by_hand(spark):
    p = lists(spark, a=[1, 2, 3], b=[2, 4])
    assert items_of(fuse.rrf(p, ["a", "b"], 3)) == [2, 1, 4]
    assert items_of(fuse.interleave(p, ["a", "b"], 3)) == [1, 2, 4]
    assert items_of(fuse.apply_quota(p, {"b": 2, "a": 1})) == [2, 4, 1]


def test_cara_uses_up_budgets_and_fills(spark):
    p = lists(spark, a=[1, 2, 3, 4, 5], b=[1, 2, 9])
    users = spark.createDataFrame([(1, False)], "user_idx long, user_cold boolean")
    assert items_of(fuse.cara(p, users, 4, {"a": 1.0}, {"a": 0.5, "b": 0.5})) == [1, 2, 3, 4]
    assert items_of(fuse.cara(p, users, 6, {"a": 1.0}, {"b": 0.5, "a": 0.5})) == [1, 2, 9, 3, 4, 5]


@given(st.lists(st.lists(st.integers(0, 8), max_size=6, unique=True), min_size=2, max_size=3), st.integers(1, 8))
@FEW
def test_fusion_like_the_plain_rules(spark, ranked, n):
    names = [f"m{i}" for i in range(len(ranked))]
    if not any(ranked):
        return
    p = lists(spark, **dict(zip(names, ranked, strict=True)))
    turn = []
    for r in range(6):
        for v in ranked:
            if r < len(v) and v[r] not in turn:
                turn.append(v[r])
    assert items_of(fuse.interleave(p, names, n)) == turn[:n]
    score, first = {}, {}
    for o, v in enumerate(ranked):
        for r, i in enumerate(v):
            score[i] = score.get(i, 0) + 1 / (61 + r)
            first.setdefault(i, (o, r))
    want = sorted(score, key=lambda i: (-round(score[i], 12), first[i]))
    assert items_of(fuse.rrf(p, names, n)) == want[:n]


def test_quota_grid_and_presets():
    grid = fuse.quota_grid(["a", "b"], 4, 2)
    assert sorted(tuple(g.values()) for g in grid) == [(0, 4), (2, 2), (4, 0)] and len(fuse.quota_grid(list("abcde"), 200, 40)) == 126
    assert fuse.quota_grid(["a", "b"], 5, 2) == [{"a": 2, "b": 2}]
    assert fuse.preset_quotas(["bpr", "popularity"], 10) == {"equal": {"bpr": 5, "popularity": 5}, "cf_heavy": {"bpr": 7, "popularity": 3}, "text_heavy": {"bpr": 3, "popularity": 7}}


def test_quota_union(spark):
    h, i = lists(spark, a=[1, 2, 3, 4]), lists(spark, a=[2, 8])
    assert items_of(fuse.quota_union(h, i, 4, 2)) == [1, 2, 8, 3]


def test_union_is_never_worse_than_its_best_part(spark):
    p, g = lists(spark, a=[1, 2], b=[3]), spark.createDataFrame([(1, 3, False, False, False, False, True)], "user_idx long, true_item long, item_new boolean, item_cold boolean, long_tail boolean, user_cold boolean, warm boolean")
    cov = metrics.coverage(p, g, 2)
    row = ceiling.union_coverage(cov, p, g, 2).where("scenario = 'overall'").first()
    assert row["union_coverage"] >= row["best_single"] and row["best_model"] == "b"
    assert metrics.recall_curve(p, g, (1, 2)).where("model = 'b' and k = 1").first()["recall"] == 1.0


# ---- scorers, retrievers


def test_itemknn_against_matrices(spark):
    rng = np.random.default_rng(4)
    rows = [(int(u), int(i), 1) for u, i in zip(rng.integers(0, 12, 90), rng.integers(0, 9, 90), strict=True)]
    x = np.zeros((12, 9))
    for u, i, _ in rows:
        x[u, i] += 1
    n = np.sqrt((x**2).sum(0)) + 1e-8
    sim = (x / n).T @ (x / n)
    np.fill_diagonal(sim, 0)
    for i in range(9):
        sim[i, sim[i] < np.sort(sim[i])[-3] - 1e-12] = 0
    want = x @ sim
    pairs = scored(spark, [(u, i, 0) for u in range(12) for i in range(9)]).drop("score")
    for r in scorers.itemknn(pairs, log(spark, rows), 3).collect():
        assert r["score"] == pytest.approx(want[r["user_idx"], r["item_idx"]], abs=1e-6)


@pytest.mark.parametrize(("rows", "summed", "part"), [(1 << 18, 1 << 20, 2048), (40, 7, 3)])
def test_similar_items_need_no_shuffle_of_pairs(spark, monkeypatch, rows, summed, part):
    for name, value in (("ROWS", rows), ("SUMMED", summed), ("PART", part)):
        monkeypatch.setattr(scorers, name, value)
    rng = np.random.default_rng(14)
    train = [(int(u), int(i), 1) for u, i in zip(rng.integers(0, 30, 400), rng.integers(0, 25, 400) ** 2, strict=True)]
    x = np.zeros((30, 577))
    for u, i, _ in train:
        x[u, i] += 1
    norm = np.sqrt((x**2).sum(0)) + 1e-8
    dot = x.T @ x
    np.fill_diagonal(dot, 0)
    want = set()
    for i in range(577):
        s = {j: round(dot[i, j] / norm[i] / norm[j], 9) for j in np.flatnonzero(dot[i])}
        least = sorted(s.values(), reverse=True)[:5]
        want |= {(i, int(j), v) for j, v in s.items() if v >= least[-1]}
    lists = scorers.neighbours(log(spark, train), 5)
    assert {tuple(r) for r in scorers.edge_rows(lists).collect()} == want
    # Nothing but histories moves: no exchange holds pairs.
    assert "item_j" not in lists._jdf.queryExecution().executedPlan().toString()


def test_short_lists_lose_nothing(spark):
    rng = np.random.default_rng(15)
    rows = [(1, [5, 2, 1 << 60], [0.5, 1e-9, 0.25]), (2, list(range(300, 0, -1)), [0.125] * 300), (3, [7], [1 / 3]), (4, [-4, 9], [3e9, -1.5]), (5, list(range(400)), rng.choice([1 / 3, 2 / 7], 400).tolist()), (6, [], [])]
    lists = spark.createDataFrame(rows, "item_idx long, to array<long>, v array<double>")
    table = retrieve.short_lists(lists).orderBy("item_idx").toArrow()
    to, v = retrieve.long_lists(table)
    want = [x for _, a, b in rows for x in sorted(zip(a, b, strict=True))]
    assert list(zip(to.tolist(), v.tolist(), strict=True)) == want and table["size"].to_pylist() == [3, 300, 1, 2, 400]
    assert len(table["to"][1].as_py()) + len(table["v"][1].as_py()) < 300  # 4,800 bytes as numbers


@pytest.mark.parametrize("head", [4096, 4])
def test_first_unseen_places_move_with_users_only(spark, monkeypatch, head):
    monkeypatch.setattr(retrieve, "HEAD", head)
    order = spark.createDataFrame([(i, float(40 - i), i + 1) for i in range(30)], "item_idx long, score double, place long")
    seen = scored(spark, [(1, 0, 0), (1, 2, 0), (1, 2, 0), (2, 1, 0), *[(3, i, 0) for i in range(28)]]).drop("score")
    users = spark.createDataFrame([(1,), (2,), (3,), (4,)], "user_idx long")
    got = retrieve.by_global_order(order, users, seen, 3)
    want = [(1, 1, 1), (1, 2, 3), (1, 3, 4), (2, 1, 0), (2, 2, 2), (2, 3, 3), (3, 1, 28), (3, 2, 29), (4, 1, 0), (4, 2, 1), (4, 3, 2)]
    assert asked(got, "user_idx", "rank", "item_idx") == want and asked(got, "item_idx", "score")[0] == (0, 40.0)
    if head == 4096:
        assert "array_except" in got._jdf.queryExecution().optimizedPlan().toString()


def test_popularity_list_skips_seen_and_reaches_the_end(spark):
    train = log(spark, [(1, 1, 1), (2, 1, 1), (2, 2, 1)])
    items = spark.createDataFrame([(i,) for i in (1, 2, 3, 4)], "item_idx long")
    users = spark.createDataFrame([(1,), (7,)], "user_idx long")
    got = retrieve.popularity(users, train, items, train, 3)
    assert asked(got, "user_idx", "rank", "item_idx") == [(1, 1, 2), (1, 2, 3), (1, 3, 4), (7, 1, 1), (7, 2, 2), (7, 3, 3)]


def test_dense_top_in_blocks(spark):
    rng = np.random.default_rng(2)
    u, v = rng.normal(size=(6, 5)), rng.normal(size=(40, 5))
    users = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(u)], "user_idx long, u array<double>")
    items = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "item_idx long, v array<double>")
    none = scored(spark, [(99, 99, 0)])
    for blocks in (1, 3):
        got = retrieve.best(retrieve.dense_top(users, items, 4, None, blocks), none, 4)
        want = np.argsort(-(u @ v.T), 1)[:, :4]
        assert asked(got, "user_idx", "rank", "item_idx") == [(a, r + 1, int(want[a, r])) for a in range(6) for r in range(4)]


def test_pieces_that_are_far_away_are_not_multiplied():
    rng = np.random.default_rng(3)
    v = rng.normal(size=(6000, 4))
    v /= np.sqrt((v * v).sum(1, keepdims=True))
    v = v[np.argsort(retrieve.direction(v), kind="stable")]
    lists = retrieve.Lists(v[::7], np.full(len(v[::7]), 5), 9, piece=64)
    ids, ones = np.arange(6000), np.ones(6000, np.int64)
    lists.meet(ids[:3000], v[:3000], ones[:3000])
    lists.tile = 0  # products with all items would end in an error
    lists.floor[:] = np.sort(np.round(v[::7] @ v.T, 9), 1)[:, -5]
    lists.meet(ids[3000:], v[3000:], ones[3000:])
    got = {}
    for who, item, *_ in lists.held:
        for a, b in zip(who.tolist(), item.tolist(), strict=True):
            got.setdefault(a, []).append(b)
    want = np.argsort(-np.round(v[::7] @ v.T, 9), axis=1, kind="stable")[:, :5]
    assert all(got[a] == want[a].tolist() for a in range(len(want)))


def test_graph_expansion_is_summed_where_users_are(spark):
    rows = log(spark, [(u, (u * u + 3 * k) % 17, k) for u in range(12) for k in range(5)])
    edges = spark.createDataFrame([(a, b, float((a * b) % 5) / 4) for a in range(17) for b in range(17) if a != b], "item_a long, item_b long, n double")
    users, seen = rows.select("user_idx").distinct(), rows.select("user_idx", "item_idx")
    history = rows.select("user_idx", "item_idx").distinct().withColumn("w", F.lit(1.0))
    want = retrieve.best(retrieve.scorers.expand(history, edges, "item_a", "item_b", "n"), seen, 6, high_id=True)
    got = retrieve.graph_expansion(users, rows, edges, seen, 6)
    assert asked(got, "user_idx", "item_idx", "score", "rank") == asked(want, "user_idx", "item_idx", "score", "rank")
    assert "FlatMapCoGroups" in got._jdf.queryExecution().executedPlan().toString()


def test_tfidf_lists_send_one_table_through_the_driver(spark):
    items = spark.createDataFrame([(i, f"red part {i % 7}") for i in range(40)], "item_idx long, text string")
    rows = log(spark, [(u, (u * 3 + k) % 40, k) for u in range(9) for k in range(4)])
    out = retrieve.tfidf(rows.select("user_idx").distinct(), rows, items, rows.select("user_idx", "item_idx"), 5)
    assert out._jdf.queryExecution().sparkPlan().toString().count("BroadcastHashJoin") == 1 and out.count() == 45


def test_dense_top_rounds_and_sorts_few_scores(spark, monkeypatch):
    rng = np.random.default_rng(17)
    u, v = rng.normal(size=(20, 3)), np.round(rng.normal(size=(900, 3)), 1)
    users = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(u)], "user_idx long, u array<double>")
    items = spark.createDataFrame([(i, x.tolist(), int(i % 3) + 1) for i, x in enumerate(v)], "item_idx long, v array<double>, size int")
    for name, value in (("BLOCK", 100), ("WIDTH", 128), ("STRETCH", 4)):
        monkeypatch.setattr(retrieve, name, value)
    s = np.round(u @ v.T, 9)
    want = {(a, int(b), s[a, b]) for a in range(20) for b in np.flatnonzero(s[a] >= np.sort(s[a])[-5])}
    got = retrieve.dense_top(users, items.drop("size"), 5)
    assert got.count() == 100 and {tuple(r) for r in got.collect()} <= want  # one block: vectors are short; before, nine
    sized = {tuple(r) for r in retrieve.dense_top(users, items, 5).collect()}
    for a in range(20):
        order = sorted(range(900), key=lambda b: -s[a, b])
        k = next(k for k in range(900) if sum(int(b % 3) + 1 for b in order[: k + 1]) >= 5)
        assert {b for x, b, _ in sized if x == a} >= {b for b in range(900) if s[a, b] >= s[a, order[k]]}


def test_registry_isolates_failures(spark):
    reg = retrieve.Registry(good=lambda **c: c["x"], bad=lambda **c: c["missing"])
    pools, failed = reg.run(["good", "bad", "none"], x=lists(spark, a=[1]).drop("model"))
    assert pools.select("model").first()[0] == "good" and set(failed) == {"bad", "none"}


def test_propagation_keeps_a_uniform_vector(spark):
    edges = trainers.bipartite_edges(log(spark, [(u, i, 1) for u in range(3) for i in range(3)]))
    start = edges.select(F.col("src").alias("node")).distinct().withColumn("x0", F.lit(1.0))
    assert all(r["x0"] == pytest.approx(1, abs=1e-6) for r in trainers.propagate(edges, start).collect())


def plain_pairwise(pairs, layers, dim, epochs, rate, decay, seed):
    """The same training with dictionaries and loops."""
    md5 = lambda *x: int(hashlib.md5(":".join(map(str, x)).encode()).hexdigest()[:8], 16)
    items = sorted({i for _, i in pairs})
    nodes = sorted({f"u{u}" for u, _ in pairs} | {f"i{i}" for _, i in pairs})
    deg = {n: sum(n in (f"u{u}", f"i{i}") for u, i in pairs) for n in nodes}
    near = {n: [] for n in nodes}
    for u, i in pairs:
        w = 1 / math.sqrt((deg[f"u{u}"] + 1e-8) * (deg[f"i{i}"] + 1e-8))
        near[f"u{u}"].append((f"i{i}", w))
        near[f"i{i}"].append((f"u{u}", w))

    def spread(x):
        total, now = {n: v.copy() for n, v in x.items()}, x
        for _ in range(layers):
            now = {n: sum((w * now[m] for m, w in near[n]), np.zeros(dim)) for n in nodes}
            total = {n: total[n] + now[n] for n in nodes}
        return {n: v / (layers + 1) for n, v in total.items()}

    x = {n: np.array([(md5(seed, n, k) / 4294967295.0 - 0.5) * 0.2 for k in range(dim)]) for n in nodes}
    for epoch in range(epochs):
        f, grad = spread(x), {n: np.zeros(dim) for n in nodes}
        for u, i in pairs:
            j = items[md5(seed + 1 + epoch, u, i) % len(items)]
            if (u, j) in pairs:
                continue
            u_, i_, j_ = f"u{u}", f"i{i}", f"i{j}"
            g = 1 / (1 + math.exp(f[u_] @ (f[i_] - f[j_])))
            grad[u_] += g * (f[i_] - f[j_])
            grad[i_] += g * f[u_]
            grad[j_] -= g * f[u_]
        grad = spread(grad) if layers else grad
        x = {n: v * (1 - rate * decay) + rate * grad[n] / math.sqrt(deg[n]) for n, v in x.items()}
    return spread(x)


@pytest.mark.parametrize("layers", [0, 2])
def test_pairwise_training_is_that_of_a_plain_loop(spark, layers):
    pairs = {(u, (3 * u + k * k) % 11) for u in range(7) for k in range(4)}
    rows = log(spark, [(u, i, 1) for u, i in sorted(pairs)])
    users, items = trainers.fit_pairwise(rows, layers, 3, 2, 0.4, 0.01, 5)
    want = plain_pairwise(pairs, layers, 3, 2, 0.4, 0.01, 5)
    for r in users.collect():
        assert np.allclose(r["embedding"], want[f"u{r['user_idx']}"])
    for r in items.collect():
        assert np.allclose(r["embedding"], want[f"i{r['item_idx']}"])


@pytest.mark.parametrize("fit", [trainers.fit_bpr, trainers.fit_lightgcn])
def test_pairwise_training_learns_blocks(spark, fit):
    rows = log(spark, [(u, (u % 2) * 10 + k, 1) for u in range(20) for k in range(5)])
    users, items = fit(rows, dim=4, epochs=6, rate=2.0)
    u, i = ({r[0]: np.array(r["embedding"]) for r in x.collect()} for x in (users, items))
    own = [x @ y for a, x in u.items() for b, y in i.items() if (a % 2) == (b >= 10)]
    other = [x @ y for a, x in u.items() for b, y in i.items() if (a % 2) != (b >= 10)]
    assert np.mean(own) > np.mean(other) + 0.2


def test_graph_lists_come_from_a_whole_training():
    import inspect

    from rankforge.plans import catalog

    whole = inspect.signature(trainers.fit_pairwise).parameters
    assert catalog.WHOLE == (whole["dim"].default, whole["epochs"].default)
    sql = catalog.ORACLES["retrieve_lightgcn"]
    assert "u.x63 * i.x63" in sql and "x64" not in sql and "v20 AS" in sql and "v21" not in sql


def test_tower_gradient_is_that_of_its_loss():
    rng = np.random.default_rng(0)
    x, y, a, b = (rng.normal(size=s) for s in ((5, 4), (5, 3), (4, 2), (3, 2)))
    da, db, _ = trainers.tower_gradient(a, b, x, y, 2.0)
    for m, d in ((a, da), (b, db)):
        for at in np.ndindex(m.shape):
            m[at] += 1e-5
            up = trainers.tower_gradient(a, b, x, y, 2.0)[2]
            m[at] -= 2e-5
            down = trainers.tower_gradient(a, b, x, y, 2.0)[2]
            m[at] += 1e-5
            assert d[at] == pytest.approx((up - down) / 2e-5, rel=1e-3, abs=1e-6)


def test_two_tower_training(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(30, 6))
    rows = spark.createDataFrame([(i, i, v.tolist(), v.tolist()) for i, v in enumerate(x)], "user_idx long, item_idx long, u array<double>, v array<double>")

    def hits(a, b):
        return np.mean(np.argmax((x @ a) @ (x @ b).T, 1) == np.arange(30))

    trained = trainers.fit_two_tower(rows, 6, epochs=12, rate=0.1)
    assert hits(*trained) > max(0.5, hits(*trainers.fit_two_tower(rows, 6, epochs=0)))
    got = {r["user_idx"]: r["embedding"] for r in trainers.project(rows, trained[0], "user_idx", "u").collect()}
    assert np.allclose([got[i] for i in range(30)], x @ trained[0])


def attention_weights(items, length, dim, seed=1):
    rng = np.random.default_rng(seed)
    r = lambda *s: rng.normal(0, 0.3, s)
    layer = lambda: {"qkv": (r(dim, 3 * dim), r(3 * dim)), "out": (r(dim, dim), r(dim)), "norm1": (1 + r(dim), r(dim)), "up": (r(dim, 4 * dim), r(4 * dim)), "down": (r(4 * dim, dim), r(dim)), "norm2": (1 + r(dim), r(dim))}
    return {"items": r(items + 1, dim), "places": r(length, dim), "norm": (1 + r(dim), r(dim)), "layers": [layer(), layer()]}


def plain_attention(w, seq, heads):
    """One sequence, place by place."""
    norm = lambda v, g, b: (v - v.mean()) / np.sqrt(v.var() + 1e-5) * g + b
    x = [norm(w["items"][s] + w["places"][t], *w["norm"]) for t, s in enumerate(seq)]
    for layer in w["layers"]:
        qkv = [v @ layer["qkv"][0] + layer["qkv"][1] for v in x]
        d = len(x[0])
        out = []
        for t in range(len(seq)):
            mixed = []
            for h in range(heads):
                part = slice(h * d // heads, (h + 1) * d // heads)
                may = [k for k in range(t + 1) if seq[k] != 0 or k == t]
                s = np.array([qkv[t][:d][part] @ qkv[k][d : 2 * d][part] / math.sqrt(d // heads) for k in may])
                p = np.exp(s - s.max())
                p /= p.sum()
                mixed.append(sum(a * qkv[k][2 * d :][part] for a, k in zip(p, may, strict=True)))
            out.append(norm(x[t] + np.concatenate(mixed) @ layer["out"][0] + layer["out"][1], *layer["norm1"]))
        x = []
        for v in out:
            h = v @ layer["up"][0] + layer["up"][1]
            h = 0.5 * h * (1 + np.tanh(np.sqrt(2 / np.pi) * (h + 0.044715 * h**3)))
            x.append(norm(v + h @ layer["down"][0] + layer["down"][1], *layer["norm2"]))
    return x[-1]


def test_sequence_model(spark):
    w = attention_weights(12, 4, 6)
    model = trainers.SelfAttention(w)
    assert np.allclose(model.encode(np.array([[0, 0, 3, 7], [1, 2, 3, 4]])), [plain_attention(w, s, 2) for s in ([0, 0, 3, 7], [1, 2, 3, 4])])
    rows = spark.createDataFrame([(1, 2, 1.0, 1), (1, 6, 2.0, 2), (2, 5, 1.0, 3)], "user_idx long, item_idx long, ts double, pos long")
    got = {r[0]: r[1] for r in trainers.encode_sequences(rows, model).collect()}
    assert np.allclose(got[1], plain_attention(w, [0, 0, 3, 7], 2)) and np.allclose(got[2], plain_attention(w, [0, 0, 0, 6], 2))


def test_pools_of_users_who_have_seen_nearly_everything(spark):
    seen = spark.createDataFrame([(1, i) for i in range(40) if i not in (3, 17, 30)] + [(2, 1)], "user_idx long, item_idx long")
    items = spark.range(40).select(F.col("id").alias("item_idx"))
    truth = gold(spark, [(1, 30), (2, 30), (3, 5)])
    got = {}
    for r in split.uniform_candidates(truth, seen, items, 8, draws=1).orderBy("user_idx", "pool_pos").collect():
        got.setdefault(r["user_idx"], []).append((r["pool_pos"], r["item_idx"], r["label"]))
    assert {i for _, i, _ in got[1]} == {30, 3, 17}
    for u, rows in got.items():
        assert [p for p, _, _ in rows] == list(range(1, len(rows) + 1)) and rows[0][2] == 1 and len({i for _, i, _ in rows}) == len(rows)
    assert len(got[2]) == len(got[3]) == 9 and 1 not in {i for _, i, _ in got[2]}
    hot = spark.createDataFrame([(u, 1 if k else u, p) for p, (u, k) in enumerate((u, k) for u in range(30) for k in range(40))], "user_idx long, item_idx long, pos long")
    short = split.popularity_candidates(gold(spark, [(99, 1), (5, 7)]), hot, hot, 6).groupBy("user_idx").count().collect()
    assert {r["user_idx"]: r["count"] for r in short} == {99: 7, 5: 7}


def test_pairs_of_a_heavy_user(spark):
    w = spark.createDataFrame([(1, i, float(i)) for i in range(40)] + [(2, 3, 1.0), (2, 9, 2.0)], "user_idx long, item_idx long, w double")
    got = sorted(map(tuple, scorers.pairs(w, 6).select("item_i", "item_j", "wi", "wj").collect()))
    want = sorted([(i, j, float(i), float(j)) for i in range(40) for j in range(i + 1, 40)] + [(3, 9, 1.0, 2.0)])
    assert got == want


def test_global_order_with_many_ties(spark):
    rng = np.random.default_rng(3)
    rows = [(i, float(s)) for i, s in enumerate(np.where(rng.random(900) < 0.6, 0, rng.integers(0, 50, 900)))] + [(2000 + i, float(x)) for i, x in enumerate(rng.random(300))]
    got = [tuple(r) for r in retrieve.global_order(spark.createDataFrame(rows, "item_idx long, score double").repartition(5)).orderBy("place").collect()]
    assert got == [(i, s, k + 1) for k, (i, s) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])))]
    assert retrieve.global_order(spark.createDataFrame([], "item_idx long, score double")).collect() == []


# ---- statistics


def test_wilson_and_mcnemar(spark):
    df = stats.with_wilson(spark.createDataFrame([(5, 10), (0, 0)], "h long, n long"), "h", "n", 4)
    assert [tuple(r)[2:] for r in df.collect()] == [(0.2366, 0.7634), (None, None)]
    assert C.mcnemar(0, 0) == 1.0 and C.mcnemar(5, 0) == pytest.approx(0.0625)
    assert C.student_t_two_sided(2.0, 10) == pytest.approx(0.07338803, abs=1e-7) and C.student_t_two_sided(0.0, 5) == pytest.approx(1)


def test_bootstrap_covers_the_mean(spark):
    v = spark.createDataFrame([(i, float(i % 2)) for i in range(200)], "user_idx long, recall double")
    row = stats.bootstrap(v, 200).first()
    assert row["ci_lo"] < 0.5 < row["ci_hi"] and row["n_users"] == 200
    assert stats.bootstrap(v.where("user_idx < 0")).count() == 0


def test_paired_report(spark):
    a = spark.createDataFrame([(i, 1.0 if i < 30 else 0.0) for i in range(60)], "user_idx long, hit double")
    b = spark.createDataFrame([(i, 1.0 if i < 5 else 0.0) for i in range(60)], "user_idx long, hit double")
    r = stats.paired_report(a, b, 2000)
    assert (r["gained"], r["lost"], r["significant"]) == (25, 0, True) and r["ci_low"] < 25 / 60 < r["ci_high"]
    assert stats.paired_report(a.where("user_idx < 0"), b)["p"] == 1.0


def test_multiseed_of_one_seed(spark):
    df = spark.createDataFrame([("m", 0.5)], "model string, v double")
    assert tuple(stats.multiseed(df, "v", ["model"]).first()) == ("m", 1, 0.5, 0.0, 0.0)


# ---- parsers, prompts, evidence


def test_parsers(spark):
    df = spark.createDataFrame([("score: 250.5", "3, 1 and 3, 9"), ("none", ""), (None, None)], "t string, o string")
    assert [r[0] for r in df.select(C.parse_score(F.col("t"))).collect()] == [100.0, None, None]
    got = df.where("o is not null").select(C.parse_order(F.col("o"), F.lit(4))).collect()
    assert [r[0] for r in got] == [[3, 1, 2, 4], [1, 2, 3, 4]]
    lines = spark.createDataFrame([("- Red wine\n2) x\n* jazz\n" + "y" * 99,)], "t string").select(C.phrases(F.col("t"), 5)).first()[0]
    assert lines == ["Red wine", "jazz"]
    both = spark.createDataFrame([("1. wireless mouse 2.\r\n- usb cable -\n\u2003\u3000\n",)], "t string").select(C.phrases(F.col("t"), 5)).first()[0]
    assert both == ["wireless mouse", "usb cable"]


def test_tokens(spark):
    df = spark.createDataFrame([("Été a b2 x_y É",), (None,), ("",)], "t string").select(C.tokens(F.col("t")).alias("w")).select("w", C.bigrams(F.col("w")))
    assert [tuple(map(list, r)) for r in df.collect()] == [(["été", "b2", "x_y"], ["été b2", "b2 x_y"]), ([], []), ([], [])]


def test_column_functions(spark):
    r = spark.range(1).select(C.probability(F.lit(0.0)), C.logsumexp(F.array(F.lit(1.0), F.lit(1.0))), C.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(2.0), F.lit(0.0))), C.cosine(F.array(F.lit(0.0)), F.array(F.lit(2.0)))).first()
    assert r[0] == 50.0 and r[1] == pytest.approx(1 + math.log(2)) and r[2] == 1.0 and r[3] is None


def test_stub_reranker_in_batches(spark):
    df = spark.createDataFrame([("h", "red car"), ("h", "blue boat")], "history string, title string").withColumn("prompt", rerank.baseline_prompt(F.lit("a red car"), F.col("title")))
    assert sorted(r["score"] for r in rerank.score_with(df, rerank.overlap_stub, chunk=1).collect()) == [0.0, 1.0]


def test_directed_cooccurrence_counts_directions_apart(spark):
    rows = log(spark, [(1, 1, 1), (1, 2, 2), (2, 2, 1), (2, 1, 2), (3, 5, 1), (3, 6, 2), (4, 5, 1), (4, 6, 2)])
    assert asked(rerank.directed_cooccurrence(rows), "item_a", "item_b") == [(5, 6), (6, 5)]
    assert asked(retrieve.cooccurrence(rows), "item_a", "item_b", "n") == [(1, 2, 2), (2, 1, 2), (5, 6, 2), (6, 5, 2)]


def test_pairs_are_of_different_places(spark):
    p = pool(spark, [(u, i, 0, i) for u in (1, 2) for i in range(1, 6)] + [(3, 1, 0, 1)])
    got = rerank.random_pairs(p, 20)
    assert got.where("a = b").count() == 0 and got.count() == 40


# ---- learned


def test_features_of_missing_lists(spark):
    p = lists(spark, a=[1, 2], b=[2])
    f = learned.features(p, ["a", "b"], 10, gold(spark, [(1, 2)]), log(spark, [(1, 1, 1)]), spark.createDataFrame([(1, "xy")], "item_idx long, text string"))
    r = f.where("item_idx = 1").first()
    assert (r["rank_b"], r["has_b"], r["score_b"], r["n_hits"], r["min_rank"], r["label"], r["item_new"], r["item_textlen"], r["user_hist_len"]) == (11, 0, 0.0, 1, 1, 0, 0, 2, 1)
    assert set(learned.feature_names(["a", "b"])) <= set(f.columns) and "user_cold" not in learned.feature_names(["a"], "no_cold_metadata")


def test_cross_fit_separates_an_easy_case(spark):
    df = spark.createDataFrame([(u, i, float(i), int(i == 3)) for u in range(30) for i in range(4)], "user_idx long, item_idx long, x double, label int")
    top = learned.reranked(learned.cross_fit(df, "gbt", ["x"], 2, rounds=3), 1)
    assert {r["item_idx"] for r in top.collect()} == {3}


def test_features_are_made_once_for_all_folds(spark):
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    df = spark.createDataFrame([(u, i, float(i), int(i == 3)) for u in range(30) for i in range(4)], "user_idx long, item_idx long, x double, label int")
    assert learned.cross_fit(df.mapInArrow(count, df.schema), "logreg", ["x"], 2).count() == 120
    assert made.value == 120


def test_only_lists_that_are_asked_for_are_made(spark, monkeypatch, tmp_path):
    from rankforge.plans.context import Context

    made = []
    c = Context(spark, "/root/testdata/sf0.001")
    c.root = str(tmp_path)
    monkeypatch.setattr(c, "retrieved", lambda m: made.append(m) or spark.createDataFrame([(1, 2, 0.5, 1)], "user_idx long, item_idx long, score double, rank int"))
    assert [r["model"] for r in c.pools_of(("markov",)).collect()] == ["markov"] and made == ["markov"]
    assert c.pools.count() == 4 and sorted(made) == ["embedding", "itemknn", "markov", "popularity"]


def test_regime_weights(spark):
    df = spark.createDataFrame([(1, 1, 1), (1, 0, 1), (0, 0, 0), (0, 0, 0)], "label int, x int, cold int")
    w = {(r["label"], r["cold"]): r["weight"] for r in learned.balanced(df, {"cold": 3.0}).collect()}
    assert w[1, 1] == 3 * 1.0 and w[0, 0] == 1.0


# ---- configuration, reports


def test_config_and_report(spark, tmp_path):
    c = config.overlay(config.SplitConfig(), {"seed": 7})
    assert c.seed == 7 and config.family("ml-100k") == "movielens"
    with pytest.raises(ValueError):
        config.overlay(config.SplitConfig(), {"sead": 7})
    text = report.report("Run", {"metrics": spark.createDataFrame([("a", 0.1), ("b", 0.2)], "model string, recall_at_10 double"), "other": None})
    assert text.index("| b |") < text.index("| a |") and "not available" in text
    failed = report.run_models({"x": lambda: 1 / 0, "y": lambda: None}, lambda n, d: None, str(tmp_path / "s.json"))
    assert list(failed) == ["x"] and "partial" in (tmp_path / "s.json").read_text()
    t = report.Timing()
    assert t.record("m", lambda: 5) == 5 and t.table(spark).first()["num_pairs"] == 5


def test_bootstrap_makes_a_row_for_eight_replicates(spark):
    v = spark.createDataFrame([(i, float(i % 3 - 1)) for i in range(40)], "user_idx long, x double")
    out = stats.bootstrap(v, 20)
    # Old plans had one row for each of the 20 replicates; groups of eight are 3.
    assert "Aggregate [__g#" in out._jdf.queryExecution().optimizedPlan().toString()
    # The same means as one row for each replicate and user gives.
    rows = v.crossJoin(spark.range(20).withColumnRenamed("id", "b")).withColumn("w", stats.weight(F.col("b")))
    means = sorted(r["m"] for r in rows.groupBy("b").agg((F.sum(F.col("w") * F.col("x")) / F.sum("w")).alias("m")).collect())
    row = out.first()
    assert row["ci_lo"] == pytest.approx(np.percentile(means, 2.5)) and row["ci_hi"] == pytest.approx(np.percentile(means, 97.5))


def test_embedding_by_kinds_finds_what_items_with_own_vectors_find(spark, monkeypatch):
    """Six items share each vector, two vectors tie, users have seen items of several kinds; no more than kinds meet users."""
    base = [(k, [1.0 + k % 3, float(k % 2), 0.5 * (k % 3)]) for k in range(7)] + [(7, [0.0, 0.0, 0.0])]
    kinds = spark.createDataFrame([(i, i % 8) for i in range(48)], "item_idx long, kind long")
    vectors = spark.createDataFrame(base, "item_idx long, embedding array<double>")
    own = kinds.join(vectors.withColumnRenamed("item_idx", "kind"), "kind").select("item_idx", "embedding")
    train = spark.createDataFrame([(u, (u * 5 + j * 7) % 48, float(j), j) for u in range(9) for j in range(2 + 3 * u)], "user_idx long, item_idx long, ts double, pos long")
    users, met = train.select("user_idx").distinct(), []
    whole = retrieve.dense_top
    monkeypatch.setattr(retrieve, "dense_top", lambda u, v, *rest: met.append(v.count()) or whole(u, v, *rest))
    want = sorted(map(tuple, retrieve.embedding(users, train, own, train, 9).collect()))
    got = sorted(map(tuple, retrieve.embedding(users, train, vectors, train, 9, kinds=kinds).collect()))
    assert got == want and len(got) > 60 and met == [42, 7]


def test_tfidf_lists_meet_texts_not_items(spark, monkeypatch):
    rng = np.random.default_rng(16)
    words = ["red", "blue", "green", "old", "new", "pen", "cup"]
    texts = [" ".join(rng.choice(words, 3)) for _ in range(9)] + [""]
    items = spark.createDataFrame([(i, texts[int(rng.integers(0, 10))]) for i in range(60)], "item_idx long, text string")
    train = log(spark, [(int(u), int(i), 1) for u, i in zip(rng.integers(0, 9, 60), rng.integers(0, 60, 60), strict=True)])
    users = train.select("user_idx").distinct()
    vectors = scorers.tfidf_vectors(items)
    profiles = scorers.tfidf_profiles(vectors, ranking.recent(train, 10)).withColumnRenamed("x", "y")
    plain = profiles.join(vectors, "term").groupBy("user_idx", "item_idx").agg(F.round(F.sum(F.col("x") * F.col("y")), 9).alias("score")).where("score > 0")
    met, whole = [], retrieve.sparse_top
    monkeypatch.setattr(retrieve, "sparse_top", lambda u, v, *rest: met.append(v.count()) or whole(u, v, *rest))
    got = sorted(map(tuple, retrieve.tfidf(users, train, items, train, 8).collect()))
    assert got == sorted(map(tuple, retrieve.best(plain, train, 8).collect())) and len(got) > 50 and met[0] <= 9


def test_itemknn_sums_edges_where_users_are(spark, monkeypatch):
    """The same lists as from products that move, for users in many parts, users who have seen what is near, and one without edges."""
    train = spark.createDataFrame([(u * (1 + u % 3), (u * j * j + 3 * j) % 23, float(j), j) for u in range(40) for j in range(1 + u % 9)] + [(500, 99, 0.0, 0)], "user_idx long, item_idx long, ts double, pos long")
    seen = train.select("user_idx", "item_idx").unionByName(spark.createDataFrame([(u, i) for u in (6, 24) for i in range(15)], "user_idx long, item_idx long"))
    edges = scorers.item_similarity(train, 5).localCheckpoint()
    users = train.select("user_idx").distinct()
    want = sorted(map(tuple, retrieve.best(scorers.expand(scorers.weights(train), edges, "item_i", "item_j", "sim"), seen, 4).collect()))

    def moved(*args):
        raise AssertionError("products of histories and edges move")

    monkeypatch.setattr(scorers, "expand", moved)
    assert sorted(map(tuple, retrieve.itemknn(users, train, seen, 4, edges=edges).collect())) == want and len(want) > 50
    monkeypatch.setattr(retrieve, "HELD", 10)
    monkeypatch.setattr(retrieve, "SHARING", (64, 2))
    monkeypatch.setattr(retrieve, "SUMMED", 8)
    assert sorted(map(tuple, retrieve.itemknn(users, train, seen, 4, edges=edges).collect())) == want
    assert retrieve.itemknn(users, train.where("pos < 0"), seen, 4, edges=edges).count() == 0


def test_best_products_leave_a_task_once_and_without_what_was_seen(spark, monkeypatch):
    rng = np.random.default_rng(5)
    u, v = rng.normal(size=(60, 4)), np.round(rng.normal(size=(3000, 4)), 1)
    v[2990:], u[7] = 1e-12 * v[2990:], 0  # almost nothing, and a user whose scores all tie
    users = spark.createDataFrame([(i * 3, x.tolist()) for i, x in enumerate(u)], "user_idx long, u array<double>")
    items = spark.createDataFrame([(i * 2, x.tolist()) for i, x in enumerate(v)], "item_idx long, v array<double>")
    for name, value in (("WIDTH", 512), ("STRETCH", 2), ("SOME", 16), ("PRODUCT", 8), ("TILE", 100), ("PACK", 70), ("MET", 1)):
        monkeypatch.setattr(retrieve, name, value)
    s = np.round(u @ v.T, 9)
    order = [sorted(range(3000), key=lambda b, a=a: (-s[a, b], b)) for a in range(60)]
    seen = spark.createDataFrame([(a * 3, b * 2) for a in range(0, 60, 2) for b in order[a][: a + 1]] * 2 + [(1, 4), (3, 999)], "user_idx long, item_idx long")
    want = [(a * 3, r + 1, b * 2) for a in range(60) for r, b in enumerate(order[a][(a + 1) * (a % 2 == 0) :][:5])]
    assert asked(retrieve.dense_lists(users, items, seen, 5), "user_idx", "rank", "item_idx") == want
    # Before, each of several blocks gave its best for every user, all of which moved.
    assert retrieve.dense_top(users, items, 5, None, 4).count() == 300


def test_als_rounds_need_no_earlier_files(spark, monkeypatch):
    made = []
    whole = trainers.ALS
    monkeypatch.setattr(trainers, "ALS", lambda **how: made.append(how) or whole(**how))
    users, items = trainers.als(log(spark, [(u, (u + k) % 7, 1) for u in range(9) for k in range(3)]), 4, 3)
    assert made[0].get("checkpointInterval") == 1 and spark.sparkContext._jsc.sc().getCheckpointDir().isDefined()
    assert users.count() == 9 and items.count() == 7


def test_packs_of_towers_hold_a_vector_once_and_all_rows(spark):
    rng = np.random.default_rng(3)
    u, v = {a: rng.normal(size=4) for a in range(12)}, {b: rng.normal(size=3) for b in range(0, 20, 2)}
    pairs = [(a, (a * 5 + k * k) % 22) for a in range(14) for k in range(9)]  # some users and items have no vector, some pairs come twice
    table = lambda x, key, name: spark.createDataFrame([(k, y.tolist()) for k, y in x.items()], f"{key} long, {name} array<double>")
    packs = trainers.packed_rows(table(u, "user_idx", "u"), table(v, "item_idx", "v"), spark.createDataFrame(pairs, "user_idx long, item_idx long"), 7)
    got, rows = packs.collect(), []
    assert sum(len(r["ids"]) // 8 for r in got) == 12 and all(len(r["v"]) // 24 <= 10 for r in got)
    for r in got:
        ids, x, y, i, j = next(trainers.unpack(pa.record_batch([pa.array([r[c]]) for c in packs.columns], packs.columns)))
        assert r["n"] == len(i) and all(np.array_equal(x[k], u[a]) for k, a in enumerate(ids))
        rows += [(int(ids[a]), next(k for k in v if np.array_equal(v[k], y[b]))) for a, b in zip(i, j)]
    want = sorted((a, b) for a, b in pairs if a in u and b in v)
    assert sorted(rows) == want and rows != want
    # One epoch over one batch is a step of Adam on the gradient of all rows.
    rng = np.random.default_rng(1)
    a, b = (rng.normal(0, 1 / np.sqrt(n), (n, 2)) for n in (4, 3))
    da, db, _ = trainers.tower_gradient(a, b, *(np.array(x) for x in zip(*[(u[k], v[m]) for k, m in rows])))
    trained = trainers.fit_towers(packs, 2, 1, 0.1, 256, 1)
    for old, new, d in zip((a, b), trained, (da / len(want), db / len(want))):
        assert np.allclose(new, old - 0.1 * d / (np.abs(d) + 1e-9))
    assert {r[0]: r[1] for r in trainers.project_users(packs, a).collect()} == {k: pytest.approx(list(x @ a)) for k, x in u.items()}
