"""Search, packing, url filters, mixing, language ID, chat and media against plain versions, round trips and held-out accuracy."""

import cmath
import hashlib
import io
import math
import re
import wave
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

import corpus_pipeline
from rankforge.llm import ann, chat, langid, media, mixing, packing, urls
from rankforge.llm import queries as q
from rankforge.llm.words import split_words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, length long, size string"
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, None, 5, "clash") for i, t, lang, s in rows], DOCS)


@given(st.text(alphabet="aB é\t\n\x0b\x0c\r\x85\u2003ẞ.", max_size=40))
@settings(max_examples=200, deadline=None)
def test_words_are_those_of_the_contract(text):
    assert split_words(text) == WORD.findall(text)
    assert split_words(text, lower=True) == WORD.findall("".join(c.lower() if c.isascii() else c for c in text))


# ---- nearest neighbours


def exact(rows, queries, k):
    ok = {i: np.array(v, float) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    return {i: sorted((float(np.sqrt(((v - ok[i]) ** 2).sum())), j) for j, v in ok.items() if j != i)[:k] for i in queries if i in ok}


def test_ann_recall_on_the_small_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    want = exact(rows, [i for i, _ in rows if i % 100 == 0], 10)
    got = defaultdict(list)
    for r in q.op1_ann(spark, sf).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["score"], r["vec_id"]))
    assert got.keys() == want.keys() and all(len(v) == 10 and v == sorted(v) for v in got.values())
    score = {(a, b): d for a in want for d, b in exact(rows, [a], len(rows))[a]}
    assert all(abs(score[a, b] - d) < 1e-9 for a in got for d, b in got[a])
    assert np.mean([b in {x[1] for x in want[a]} for a in got for _, b in got[a]]) >= 0.9


def test_ann_corner_cases(spark):
    good = [(i, [float(i % 7), 1.0, float(i // 7)]) for i in range(0, 60)]
    bad = [(100, None), (200, [0.0, 0.0, 0.0]), (300, [1.0, None, 2.0]), (400, [float("nan"), 1.0, 1.0]), (500, [1.0]), (None, [1.0, 1.0, 1.0]), (600, [])]
    copies = [(1000 + i, [3.0, 1.0, 3.0]) for i in range(40)]
    rows = good + bad + copies + copies[:3]
    df = spark.createDataFrame([(i, v, 0, 0.0) for i, v in rows], "vec_id long, embedding array<double>, cell int, score double")
    got = defaultdict(list)
    for r in ann.search(df, df.where("vec_id % 20 = 0"), probes=128).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((round(r["score"], 9), r["vec_id"]))
    want = exact([r for r in rows if r[1] is None or len(r[1]) == 3], [i for i, _ in good + copies if i % 20 == 0], 10)
    assert got == {i: [(round(d, 9), j) for d, j in v] for i, v in want.items()}
    assert ann.search(df.where("vec_id < 0"), df).collect() == []
    few = df.where("vec_id < 4")
    assert {(r["query_id"], r["vec_id"]) for r in ann.search(few, few.where("vec_id = 0")).collect()} == {(0, 1), (0, 2), (0, 3)}


# ---- packing


def check_packing(rows, texts, repeats=None):
    t = Tokenizer.from_file(TOKENIZER)
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append(r)
    assert by_doc.keys() == set(texts)
    total = 0
    for i, text in texts.items():
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        want = [(k, s, len(ids[s : s + 4096]), zlib.crc32(ids[s : s + 4096].tobytes())) for k, s in enumerate(range(0, len(ids), 4096))]
        assert sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in by_doc[i]) == sorted(want * (repeats or {}).get(i, 1))
        total += len(ids) * (repeats or {}).get(i, 1)
    for v in by_seq.values():
        at = 0
        for r in sorted(v, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 4096
    return len(by_seq), -(-total // 4096)


def test_packing_query(spark, sf):
    texts = {r[0]: r[1] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    rows = q.op4_packing(spark, sf).collect()
    used, least = check_packing(rows, texts)
    assert least <= used <= best_fit_falling([r["length"] for r in rows], 4096)
    assert used == packing.plan(Counter(r["length"] for r in rows)).size <= least + max(1, least // 100)


def test_packing_corner_cases(spark):
    texts = {1: None, 2: "", 3: "it's\x0bOdd <|endoftext|> Σ é́ İ", 4: "word " * 9000, 5: "a " * 4095, 6: "a " * 4096, None: "null id"}
    rows = [(i, t, None, None) for i, t in texts.items()]
    df = docs(spark, rows + [rows[3]] * 2)
    check_packing(packing.pack(df, TOKENIZER).collect(), texts, {4: 3})
    assert packing.pack(df.where("doc_id = 99"), TOKENIZER).collect() == []


def test_packing_thousands_of_short_texts(spark):
    texts = {i: None if i % 2 else "" for i in range(5000)}
    rows = packing.pack(docs(spark, [(i, t, None, None) for i, t in texts.items()]), TOKENIZER).collect()
    assert check_packing(rows, texts) == (2, 2)


def placed_by(plan, capacity):
    assert all(sum(f) <= capacity for _, f in plan.bins)
    placed = Counter()
    for m, filling in plan.bins:
        placed.update({n: m * k for n, k in Counter(filling).items()})
    return placed


@pytest.mark.parametrize("histogram", [{1: 2000}, {4: 3000}, {1: 900, 2: 900, 3: 900, 4: 5000}, {1500: 70_000, 1300: 50_001, 7: 90_000, 4096: 12}])
def test_plan_of_many_pieces(histogram):
    plan = packing.plan(histogram)
    assert placed_by(plan, 4096) == Counter(histogram)
    assert plan.bound <= plan.size <= sum(k for k, _ in packing.best_fit(histogram, 4096))


def best_fit_falling(items, capacity):
    bins: list[int] = []
    for n in sorted(items, reverse=True):
        room = [b for b in bins if b + n <= capacity]
        if room:
            bins[bins.index(max(room))] += n
        else:
            bins.append(n)
    return len(bins)


def fewest(items, capacity):
    """The least number of bins, by trying every bin for every piece."""
    items, best = sorted(items, reverse=True), [len(items)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for j in range(len(bins)):
            if bins[j] + items[i] <= capacity and bins[j] not in bins[:j]:
                go(i + 1, [*bins[:j], bins[j] + items[i], *bins[j + 1 :]])
        go(i + 1, [*bins, items[i]])

    go(0, [])
    return best[0]


def test_plan_is_optimal_on_small_instances():
    rng = np.random.default_rng(4)
    assert packing.plan(Counter([51, 46, 45, 44, 44, 43, 41, 31, 23, 16]), 100).size == 4
    for _ in range(1500):
        capacity = int(rng.choice([12, 20, 100]))
        items = rng.integers(1, max(2, int(capacity * rng.choice([0.4, 0.6, 1.0]))) + 1, rng.integers(0, 11)).clip(max=capacity).tolist()
        plan = packing.plan(dict(Counter(items)), capacity)
        assert placed_by(plan, capacity) == Counter(items)
        assert plan.proved and plan.size == fewest(items, capacity) >= plan.bound


def test_plan_is_never_worse_than_best_fit():
    rng = np.random.default_rng(5)
    better = 0
    for _ in range(10_000):
        capacity = int(rng.choice([50, 400, 4096]))
        items = rng.integers(1, int(capacity * rng.choice([0.3, 0.5, 0.8])) + 1, rng.integers(1, 60)).tolist()
        plan = packing.plan(dict(Counter(items)), capacity, 300)
        plain = best_fit_falling(items, capacity)
        assert placed_by(plan, capacity) == Counter(items) and plan.bound <= plan.size <= plain
        assert sum(k for k, _ in packing.best_fit(dict(Counter(items)), capacity)) == plain
        better += plan.size < plain
    assert better


# ---- url filters


def plain_rule(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if c.isascii() else c for c in host)
    fits = [(len(h + p), h + p, v) for h, p, v in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits)[1:] if fits else (None, None))


def test_url_rules_and_mined_rules(spark):
    def page(i, u):
        return i, u, "<p>", "clash", "clash"

    rows = [page(i, f"https://w{i}.example.org/es/{i}?ref=a") for i in range(30)] + [page(50 + i, f"http://example.org/en/3{i}") for i in range(30)]
    rows += [page(100, "https://x.net/es/4?ref=b"), page(101, "https://x.net/en/4"), page(102, None), page(103, "no url"), page(104, "http://ORG"), page(105, "http://a.Org/x"), page(106, "http://É.org/é?q#f"), page(107, "a://b://c/d"), page(100, "https://x.net/es/4?ref=b"), page(None, "http://notorg/x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, words string, rule string")
    got = urls.judge(df).collect()
    assert len(got) == len(rows)
    want = {i: plain_rule(u) for i, u, *_ in rows}
    for r in got:
        host, path, rule, verdict = want[r["page_id"]]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert verdict is None or r["verdict"] == verdict
    said = {r["page_id"]: r["verdict"] for r in got}
    assert said[100] == "block" and said[101] == "allow" and said[102] == said[103] == "allow"
    assert urls.judge(df.where("page_id = -5")).collect() == []
    assert {r["verdict"] for r in urls.judge(df.where("page_id in (100, 101)")).collect()} == {"allow"}


def test_urls_of_one_long_template(spark):
    # Fifty tokens that always occur together have 2 ** 50 subsets.
    long = "/".join(f"part{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(50))
    rows = [(i, f"https://w.example.org/es/{long}/{i}") for i in range(60)] + [(100 + i, f"https://a.org/x/{i}") for i in range(60)] + [(200, f"https://z.net/es/{long}/7"), (201, "https://z.net/other")]
    said = {r["page_id"]: r["verdict"] for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert said[200] == "block" and said[201] == "allow" and all(v == ("block" if i < 60 else "allow") for i, v in said.items() if i < 200)


def test_url_query(spark, sf):
    raw = {r[0]: r[1] for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url").collect()}
    got = q.op5_urls(spark, sf).collect()
    assert len(got) == len(raw)
    for r in got:
        host, path, rule, verdict = plain_rule(raw[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule) and (verdict is None or r["verdict"] == verdict)


# ---- mixing


def plain_targets(sizes):
    """Water level by bisection, in exact fractions: every source has the smaller of level times weight and twice its words."""
    weight = [Fraction((5, 2, 1)[i % 3]) for i in range(len(sizes))]
    total = Fraction(3 * sum(sizes), 2)
    levels = sorted({Fraction(2 * n) / w for n, w in zip(sizes, weight, strict=True)})
    lo = max([Fraction(0), *[x for x in levels if sum(min(x * w, 2 * n) for n, w in zip(sizes, weight, strict=True)) <= total]])
    free = sum(w for n, w in zip(sizes, weight, strict=True) if lo * w < 2 * n)
    level = lo + (total - sum(min(lo * w, 2 * n) for n, w in zip(sizes, weight, strict=True))) / free if free else lo
    return [float(min(level * w, 2 * n)) for n, w in zip(sizes, weight, strict=True)]


@pytest.mark.parametrize("sizes", [[], [0], [7], [1000, 1, 1], [0, 5, 0, 9, 100, 3], [10**9, 1, 10**6, 10**3, 0, 17], list(range(1, 40))])
def test_targets(spark, sizes):
    from rankforge.llm.workspace import Workspace

    names = [f"s{i:02d}" for i in range(len(sizes))]
    names[-1:] = [""] * min(1, len(names))  # null, last
    table = spark.createDataFrame(list(zip(names, sizes, strict=True)), "__key string, words long").repartition(3)
    got = {r["__key"]: r["target"] for r in mixing.with_targets(mixing.with_weights(table, mixing.WEIGHTS, Workspace(spark, "test"))).collect()}
    assert [got[k] for k in names] == pytest.approx(plain_targets(sizes))


@given(st.dictionaries(st.integers(0, 60), st.integers(0, 5), max_size=6), st.integers(0, 400), st.sampled_from([1, 20, 1000]))
@settings(max_examples=300, deadline=None)
def test_fit_budget(counts, budget, window):
    take = mixing.fit_budget(counts, budget, window)
    assert all(0 <= k <= counts[n] for n, k in take.items())
    got = sum(n * k for n, k in take.items())
    assert got <= budget
    if window == 1000:
        reach = {0}
        for n, c in counts.items():
            reach = {s + n * k for s in reach for k in range(c + 1)}
        assert got == max(s for s in reach if s <= budget)


def test_fit_budget_gives_shares_back(monkeypatch):
    monkeypatch.setattr(mixing, "WINDOWS", (8, 64))
    rng = np.random.default_rng(2)
    for _ in range(300):
        counts = {int(n): int(c) for n, c in zip(rng.integers(1, 70, 4), rng.integers(1, 6, 4), strict=True)}
        total = sum(n * c for n, c in counts.items())
        budget = int(rng.integers(0, total + 1))
        reach = {0}
        for n, c in counts.items():
            reach = {s + n * k for s in reach for k in range(c + 1)}
        take = mixing.fit_budget(counts, budget)
        assert sum(n * k for n, k in take.items()) == max(s for s in reach if s <= budget) and all(k <= counts[n] for n, k in take.items())
    assert mixing.fit_budget({4: 5, 58: 2}, 124) == {4: 2, 58: 2}


def test_mixing_query(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source").collect()
    size = {r[0]: len(WORD.findall(r[1] or "")) for r in rows}
    total = Counter()
    for r in rows:
        total[r[2]] += size[r[0]]
    order = sorted(total, key=lambda s: (s is None, (s or "").encode()))
    want = dict(zip(order, plain_targets([total[s] for s in order]), strict=True))
    source = {r[0]: r[2] for r in rows}
    got = q.op6_mixing(spark, sf).collect()
    taken = Counter()
    for r in got:
        s = source[r["doc_id"]]
        assert (r["size"], r["source_size"], r["target"]) == (size[r["doc_id"]], total[s], pytest.approx(want[s]))
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        taken[s] += r["taken"]
    assert len(got) == len(rows) and all(abs(taken[s] - want[s]) <= 1 for s in want if total[s] > 1000)
    assert sorted(map(tuple, got)) == sorted(map(tuple, q.op6_mixing(spark, sf).collect()))


@pytest.mark.parametrize("keep", [("doc_id",), ("doc_id", "text", "lang")])
def test_mixing_of_repeated_rows(spark, keep):
    # One document a hundred times, and texts that differ under one id: words are taken to the last one.
    rows = [(1, "a b c", "x", "one")] * 100 + [(2, "d e", None, "one"), (2, "f g", None, "one"), (3, "h " * 41, None, "two")] + [(None, "k l m n", None, None)] * 9
    got = mixing.mix(docs(spark, rows).repartition(5), keep=keep).collect()
    total = {"one": 304, "two": 41, None: 36}
    want = dict(zip(total, plain_targets(list(total.values())), strict=True))
    taken = Counter()
    for r in got:
        taken[r["source"]] += r["taken"]
        assert r["copies"] in (0, 1, 2) and (r["source_size"], r["target"]) == (total[r["source"]], pytest.approx(want[r["source"]]))
    assert len(got) == len(rows)
    assert want["two"] == 82 and taken["two"] == 82 and taken[None] <= want[None] < taken[None] + 4
    assert abs(taken["one"] - want["one"]) <= 1


def test_mixing_corner_cases(spark):
    rows = [(1, None, None, "a"), (2, "", None, "a"), (3, "x y z", None, None), (3, "x y z", None, None), (4, "w " * 50, None, "b"), (None, "q", None, "b"), (5, "v " * 500, None, "é")]
    got = mixing.mix(docs(spark, rows), keep=("doc_id", "n_chars", "size", "length")).collect()
    assert all(isinstance(r["size"], int) and r["length"] == 5 for r in got)
    assert len(got) == len(rows) and {r["source_size"] for r in got if r["source"] is None} == {6}
    assert all(r["copies"] in (0, 1, 2) and r["taken"] == r["copies"] * r["size"] for r in got)
    assert mixing.mix(docs(spark, rows).where("doc_id = 77")).collect() == []


# ---- language ID


def test_langid_held_out_accuracy(spark, sf):
    truth = {r[0]: r[1] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    got = q.op7_langid(spark, sf).collect()
    assert len(got) == len(truth)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["held_out"] and truth[r["doc_id"]]]
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held]) > 0.95


def test_langid_corner_cases(spark, monkeypatch):
    monkeypatch.setattr(langid, "BLOCK", 64)
    en, fr = "the cat and the dog of that house", "le chat et la maison de cette ville"
    rows = [(1, en, "en", "s"), (2, fr, "fr", "s"), (3, None, "en", "s"), (4, "", None, "s"), (5, "123 !!", "fr", "s"), (6, f"{en} " * 50, None, "s"), (7, "é", None, "s"), (6, f"{fr} " * 50, None, "s"), (8, "²½", "en", "s")]
    model = langid.fit(docs(spark, rows))
    got = [(r["doc_id"], r["lang_pred"]) for r in langid.detect(docs(spark, rows), model).collect()]
    assert Counter(got) - Counter([(7, "en"), (7, "fr")]) == Counter([(1, "en"), (2, "fr"), (3, "und"), (4, "und"), (5, "und"), (6, "en"), (6, "fr"), (8, "und")])
    none = langid.fit(docs(spark, rows).where("lang is null"))
    assert {(r["lang_pred"], r["score"]) for r in langid.detect(docs(spark, rows), none).collect()} == {("und", 0.0)}
    assert langid.detect(docs(spark, rows).where("doc_id = 50"), model).collect() == []


@given(st.lists(st.text(alphabet="aB c.É1ΣİǅΑ", max_size=30), max_size=5), st.sampled_from([1, 4, 9]))
@settings(max_examples=80, deadline=None)
def test_langid_parts_have_the_trigrams_of_whole_texts(texts, languages):
    old, langid.BLOCK = langid.BLOCK, 7
    try:
        got = Counter()
        for at, parts in langid.blocks(texts, languages):
            owner, bucket = langid.grams_of(parts)
            got.update(zip(np.array(at)[owner].tolist(), bucket.tolist(), strict=True))
    finally:
        langid.BLOCK = old
    assert got == Counter(zip(*(x.tolist() for x in langid.trigrams(texts)), strict=True))


def test_mixture_proportions_of_a_two_language_text(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").where("lang is not null and length(text) > 2000")
    model = langid.fit(rows)
    en, fr = (rows.where(f"lang = '{k}'").orderBy("doc_id").first()["text"][:2000] for k in ("en", "fr"))
    owner, bucket = langid.trigrams([en + " " + fr, en])
    _, score = langid.infer(model, owner, bucket, 2)
    assert 0.35 < score[0] < 0.65 and score[1] > 0.9


# ---- chat


@given(st.lists(st.tuples(st.text(max_size=8), st.text(alphabet="\\<s>/[INST] é😀x\n", max_size=30)), min_size=1, max_size=5))
@settings(max_examples=150, deadline=None)
def test_chat_round_trip(turns):
    check_round_trip(turns)


@pytest.mark.parametrize("scatter", [1, 5, 64])
def test_chat_round_trip_in_small_steps(monkeypatch, scatter):
    monkeypatch.setattr(chat, "SCATTER", scatter)
    check_round_trip([("user", "é" * n + "</s>" * (n % 3)) for n in range(12)])


def check_round_trip(turns):
    import pyarrow as pa

    turns = [(r.encode("utf-8", "ignore").decode(), t) for r, t in turns]
    out, n, lo, hi = chat.assemble(np.zeros(len(turns), int), pa.array([r for r, _ in turns], pa.string()), pa.array([t for _, t in turns], pa.string()))
    text = out[0].as_py()
    assert n.tolist() == [len(turns)] and chat.parse(text) == turns
    assert [chat.unescape(text.encode()[a:b].decode()) for a, b in zip(lo, hi, strict=True)] == [t for _, t in turns]


def chat_rows(rows):
    by = defaultdict(list)
    for c, turn, role, text in rows:
        by[c].append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for c, v in by.items():
        v.sort()
        loss = "".join(t for _, _, r, t in v if r == "assistant")
        out[c] = (len(v), hashlib.sha256("".join(f"{r}\n{t}\n" for _, _, r, t in v).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_chat_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    said = "</s>[INST] ok [/INST]"
    want = chat_rows([*rows, (-1, 0, "user", said), (-1, 1, "assistant", said)])
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in q.op8_chat(spark, sf).collect()}
    assert got == want


def test_chat_corner_cases(spark):
    rows = [(1, 1, "user", None), (1, 0, None, "a"), (None, 0, "assistant", "é</s>"), (2, None, "assistant", "x"), (2, None, "assistant", "x"), (3, 0, "system", "s" * 100_000)] + [(4, i, "assistant", f"t{i}\\") for i in range(25_000)]
    df = spark.createDataFrame([(*r, 1, "c") for r in rows], "conv_id long, turn long, role string, text string, n_turns long, formatted string")
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in chat.digests(chat.format_chats(df)).collect()}
    assert got == chat_rows(rows)
    assert chat.format_chats(df.where("conv_id = 9")).collect() == []


# ---- media


def test_media_query(spark, sf):
    texts = {r[0]: r[1] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    got = q.op10_media(spark, sf).collect()
    assert len(got) == len(texts)
    feature = {}
    for r in got:
        data = (texts[r["doc_id"]] or "").encode()
        pad = data + b" " * (max(192, -(-len(data) // 192) * 192) - len(data))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(pad), hashlib.sha256(pad).hexdigest(), zlib.crc32(pad[-16:]))
        assert r["media_bytes"] == len(pad) + 44 and r["media_sha256"] == hashlib.sha256(plain_wav(pad)).hexdigest()
        assert feature.setdefault(texts[r["doc_id"]], r["feature"]) == r["feature"]


def test_media_features():
    t = np.arange(16_000) / 16_000
    tone = np.where((t > 0.3) & (t < 0.6), np.sin(2 * np.pi * 1000 * t) * 100, np.sin(2 * np.pi * 1000 * t)) + 128
    tensors, spans, parts, n = media.analyse(media.to_wav(tone.astype(np.uint8).tobytes()))
    assert len(parts) == 1 and abs(parts[0][0] - 0.3) < 0.05 and abs(parts[0][1] - 0.6) < 0.05
    assert tensors.shape == (len(spans), media.FRAMES * media.MELS) and spans[0][0] == 0 and spans[-1][1] <= 1.0
    stored, times = media.from_stream(media.to_stream(tensors, spans))
    assert np.array_equal(stored.reshape(tensors.shape), tensors) and times.tolist() == [list(x) for x in spans] and n > 60
    assert media.stream_schema().field("tensor").type.shape == [media.FRAMES, media.MELS]
    x = np.random.default_rng(1).normal(size=500).astype(np.float32)
    h = media._phases()[0]
    full = np.convolve(np.pad(x, (len(h) // 2, len(h))), h, "valid")
    assert np.allclose(media.resample(x), full[:: media.DOWN][:250], atol=1e-5)


def plain_wav(samples):
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(media.RATE)
        w.writeframes(samples)
    return out.getvalue()


def plain_log_mel(y, rate):
    """Frame by frame, by the sums of the definitions."""
    mel = lambda f: 2595 * math.log10(1 + f / 700)
    step = (mel(rate / 2) - mel(20)) / (media.MELS + 1)
    edges = [700 * (10 ** ((mel(20) + i * step) / 2595) - 1) for i in range(media.MELS + 2)]
    out, at, n = [], 0, media.WINDOW
    while not out or at + n - media.HOP < len(y):
        frame = [(y[at + i] if at + i < len(y) else 0) * (0.5 - 0.5 * math.cos(2 * math.pi * i / (n - 1))) for i in range(n)]
        power = [abs(sum(v * cmath.exp(-2j * math.pi * i * k / n) for i, v in enumerate(frame))) ** 2 for k in range(n // 2 + 1)]
        row = []
        for lo, mid, hi in zip(edges, edges[1:], edges[2:], strict=False):
            tri = (max(0.0, min((k * rate / n - lo) / (mid - lo), (hi - k * rate / n) / (hi - mid))) for k in range(n // 2 + 1))
            row.append(math.log10(max(1e-10, sum(p * t for p, t in zip(power, tri, strict=True)))))
        out.append(row)
        at += media.HOP
    return out


def test_media_features_match_plain_definitions():
    rng = np.random.default_rng(8)
    y = (rng.normal(size=700) * 0.2).astype(np.float32)
    assert np.allclose(media.log_mel(y), plain_log_mel(y.tolist(), media.RATE * media.UP / media.DOWN), atol=1e-3)
    for _ in range(50):
        energy = rng.normal(size=rng.integers(1, 60))
        low, high = energy.mean() - 0.5 * energy.std(), energy.mean() + 0.5 * energy.std()
        want, run = [], []
        for i, e in enumerate([*energy, -np.inf]):
            if e >= low:
                run.append(i)
            elif run:
                want += [(run[0], run[-1] + 1)] if any(energy[j] >= high for j in run) else []
                run = []
        assert media.segment(energy) == want
    for data in (b"", b"abc", bytes(range(192)) * 3):
        padded = media.payload_of(data.decode("latin-1"))
        assert media.to_wav(padded) == plain_wav(padded)


def test_media_corner_cases(spark):
    rows = [(1, None, None, None), (2, "", None, None), (2, "", None, None), (None, "é" * 95, None, None), (3, "x" * 300_000, None, None)]
    got = media.digests(media.audio_columns(docs(spark, rows))).collect()
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["payload_bytes"]) for r in got) == sorted([("1", 0, 192), ("2", 0, 192), ("2", 0, 192), ("None", 190, 192), ("3", 300_000, 300_096)])
    assert media.audio_columns(docs(spark, rows).where("doc_id = 8")).collect() == []


# ---- pipeline


def test_pipeline(spark, sf):
    from tests.llm.test_text_operators import base_spans, components

    all_docs = spark.read.parquet(f"{sf}/documents.parquet")
    raw = {r["doc_id"]: r for r in all_docs.collect()}
    rows = all_docs
    kept = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        rows = spark.createDataFrame(stage(spark, rows, sf).collect(), all_docs.schema)
        assert rows.columns == all_docs.columns
        kept.append(rows.collect())
    letters = {i for i, r in raw.items() if any(c.isalpha() for c in r["text"] or "")}
    assert {r["doc_id"] for r in kept[0]} == letters
    comp = components([(r["doc_id"], r["text"]) for r in kept[0]])
    assert {r["doc_id"] for r in kept[1]} == {i for i, (_, c) in comp.items() if i == c}
    before = {r["doc_id"]: r["text"] for r in kept[1]}
    for r in kept[2]:
        assert not base_spans(r["text"]) and (base_spans(before[r["doc_id"]]) or r["text"] == before[r["doc_id"]]) and r["n_chars"] == len(r["text"])
    size, total, taken = {}, Counter(), Counter()
    for r in kept[2]:
        size[r["doc_id"]] = len(WORD.findall(r["text"]))
        total[r["source"]] += size[r["doc_id"]]
    for r in kept[3]:
        taken[r["source"]] += size[r["doc_id"]]
    order = sorted(total, key=lambda s: (s is None, (s or "").encode()))
    want = plain_targets([total[s] for s in order])
    assert all(abs(taken[s] - t) <= max(1, 0.01 * t) for s, t in zip(order, want, strict=True))
    texts = {r["doc_id"]: r["text"] for r in kept[3]}
    packed = corpus_pipeline.STAGES[-1][1](spark, rows, sf).collect()
    used, least = check_packing(packed, texts, Counter(r["doc_id"] for r in kept[3]))
    assert used <= least + max(1, least // 100)
