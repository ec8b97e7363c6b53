"""SQL text for an independent engine: shared WITH parts, and small generators for repeated columns."""

from __future__ import annotations

from rankforge.schema import K_LIST, SCENARIOS

RAW = """raw AS (
  SELECT o_custkey AS user_idx, l_partkey AS item_idx, l_quantity AS rating, epoch(l_shipdate)::DOUBLE AS ts, l_orderkey AS k1, l_linenumber::BIGINT AS k2
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity >= 25),
ordered AS (SELECT *, row_number() OVER (ORDER BY ts, user_idx, item_idx, k1, k2) AS pos, count(*) OVER () AS n FROM raw),
cut AS (SELECT *, CASE WHEN pos <= (n * 7) // 10 THEN 'train' WHEN pos <= (n * 8) // 10 THEN 'valid' ELSE 'test' END AS part FROM ordered),
log AS MATERIALIZED (SELECT * EXCLUDE (n) FROM cut WHERE part = 'test' OR item_idx % 25 <> 0)"""

BASE = (
    RAW
    + """,
train AS MATERIALIZED (SELECT * FROM log WHERE part = 'train'),
seen AS MATERIALIZED (SELECT DISTINCT user_idx, item_idx FROM log WHERE part <> 'test'),
items AS (SELECT p_partkey AS item_idx, p_name AS title, trim(concat_ws(' ', coalesce(p_name, ''), coalesce(p_brand, ''), coalesce(p_type, ''))) AS text FROM part),
ic AS MATERIALIZED (SELECT item_idx, count(*) AS c FROM train GROUP BY 1),
uc AS MATERIALIZED (SELECT user_idx, count(*) AS c FROM train GROUP BY 1),
limits AS MATERIALIZED (SELECT (SELECT quantile_cont(c, 0.05) FROM ic) AS item_p5, (SELECT quantile_cont(c, 0.2) FROM ic) AS item_p20, (SELECT quantile_cont(c, 0.05) FROM uc) AS user_p5),
stats AS MATERIALIZED (SELECT i.item_idx, coalesce(c, 0) AS train_count, coalesce(c, 0) < item_p20 AS is_tail FROM items i LEFT JOIN ic USING (item_idx), limits),
counted AS (SELECT t.user_idx, t.item_idx, t.ts, t.pos, coalesce(ic.c, 0) AS train_item_count, coalesce(uc.c, 0) AS train_user_count, l.*
  FROM log t LEFT JOIN ic USING (item_idx) LEFT JOIN uc USING (user_idx), limits l WHERE t.part = 'test'),
flags AS (SELECT *, train_item_count = 0 AS item_new, train_item_count > 0 AND train_item_count <= item_p5 AS item_cold,
  train_item_count > item_p5 AND train_item_count < item_p20 AS long_tail, train_user_count <= user_p5 AS user_cold FROM counted),
flagged AS MATERIALIZED (SELECT user_idx, item_idx, ts, pos, train_item_count, train_user_count, item_new, item_cold, long_tail, user_cold,
  NOT (item_new OR item_cold OR long_tail OR user_cold) AS warm,
  CASE WHEN item_new THEN 'item_new' WHEN item_cold THEN 'item_cold' WHEN long_tail THEN 'long_tail' WHEN user_cold THEN 'user_cold' ELSE 'warm' END AS primary_scenario FROM flags),
gold AS MATERIALIZED (SELECT * EXCLUDE (item_idx), item_idx AS true_item FROM flagged QUALIFY row_number() OVER (PARTITION BY user_idx ORDER BY ts DESC, pos DESC) = 1)"""
)

NAMES = "(VALUES ('overall'), " + ", ".join(f"('{s}')" for s in SCENARIOS) + ") AS s(scenario)"
IN_SCENARIO = "(scenario = 'overall' OR " + " OR ".join(f"(scenario = '{s}' AND {s})" for s in SCENARIOS) + ")"

DRAW = "(('0x' || substr(md5(concat_ws(':', {seed}, {cols})), 1, 8))::BIGINT)"


def walked(negatives: int, catalogue: str) -> str:
    """unseen (user_idx, item_idx, pool_pos) from draws, and what a walk through the catalogue (item_idx, slot) adds to pools that are short."""
    return f"""drawn AS MATERIALIZED (SELECT user_idx, item_idx, pool_pos::INT AS pool_pos FROM unseen WHERE pool_pos <= {negatives + 1}),
held AS (SELECT g.user_idx, g.true_item, count(u.item_idx) AS held FROM gold g LEFT JOIN drawn u ON u.user_idx = g.user_idx GROUP BY 1, 2 HAVING count(u.item_idx) < {negatives}),
size AS (SELECT count(*) AS n FROM {catalogue}),
places AS (SELECT h.*, t.pl, ({DRAW.format(seed=42, cols="user_idx, n")} % n + t.pl * CASE WHEN n % 1000003 <> 0 THEN 1000003 ELSE 1000033 END) % n AS slot FROM held h, size, range(1, n + 1) t(pl)),
free AS (SELECT p.user_idx, c.item_idx, held, row_number() OVER (PARTITION BY p.user_idx ORDER BY p.pl) AS nth FROM places p JOIN {catalogue} c USING (slot) WHERE c.item_idx <> p.true_item
  AND NOT EXISTS (SELECT 1 FROM train t WHERE t.user_idx = p.user_idx AND t.item_idx = c.item_idx) AND NOT EXISTS (SELECT 1 FROM drawn u WHERE u.user_idx = p.user_idx AND u.item_idx = c.item_idx)),
filled AS (SELECT user_idx, item_idx, pool_pos FROM drawn UNION ALL SELECT user_idx, item_idx, (held + nth + 1)::INT FROM free WHERE held + nth <= {negatives})"""


#: Uniform candidates: the gold item, then draws from the catalogue in the order of their numbers, then a walk through it.
CANDIDATES = """slots AS (SELECT item_idx, row_number() OVER (ORDER BY item_idx) - 1 AS slot, count(*) OVER () AS n FROM items),
tries AS (SELECT g.user_idx, g.true_item, t.i AS try, {draw} % (SELECT count(*) FROM items) AS slot FROM gold g, range(1, 77) t(i)),
fill AS (SELECT t.user_idx, s.item_idx, min(try) AS try FROM tries t JOIN slots s USING (slot) WHERE s.item_idx <> t.true_item GROUP BY 1, 2),
unseen AS (SELECT *, row_number() OVER (PARTITION BY user_idx ORDER BY try) + 1 AS pool_pos FROM fill f WHERE NOT EXISTS (SELECT 1 FROM train t WHERE t.user_idx = f.user_idx AND t.item_idx = f.item_idx)),
{walk},
candidates AS MATERIALIZED (SELECT user_idx, true_item AS item_idx, 1 AS label, 1 AS pool_pos FROM gold UNION ALL SELECT user_idx, item_idx, 0, pool_pos FROM filled)""".format(
    draw=DRAW.format(seed=42, cols="user_idx, t.i"), walk=walked(19, "slots")
)
POPULARITY = "scored AS MATERIALIZED (SELECT user_idx, item_idx, coalesce(c, 0)::DOUBLE AS score FROM candidates LEFT JOIN ic USING (item_idx))"

ORDER = "ranked_items AS MATERIALIZED (SELECT item_idx, score, row_number() OVER (ORDER BY score DESC, item_idx) AS place FROM {source})"


def by_order(n: int, name: str) -> str:
    """The first n unseen items of one order, for every gold user."""
    return f"""{name} AS MATERIALIZED (SELECT user_idx, item_idx, score, rank FROM (
  SELECT g.user_idx, r.item_idx, r.score, row_number() OVER (PARTITION BY g.user_idx ORDER BY r.place) AS rank FROM gold g, ranked_items r
  WHERE r.place <= {n} + (SELECT max(c) FROM (SELECT count(*) AS c FROM seen GROUP BY user_idx)) AND NOT EXISTS (SELECT 1 FROM seen s WHERE s.user_idx = g.user_idx AND s.item_idx = r.item_idx))
  WHERE rank <= {n})"""


def best(source: str, n: int, name: str, tie: str = "item_idx") -> str:
    return f"""{name} AS MATERIALIZED (SELECT user_idx, item_idx, score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY user_idx ORDER BY score DESC, {tie}) AS rank FROM {source} x WHERE NOT EXISTS (SELECT 1 FROM seen s WHERE s.user_idx = x.user_idx AND s.item_idx = x.item_idx)) WHERE rank <= {n})"""


POP_ITEMS = "pop_items AS (SELECT item_idx, train_count::DOUBLE AS score FROM stats)"
SIMILARITY = """w AS MATERIALIZED (SELECT user_idx, item_idx, count(*)::DOUBLE AS w FROM train GROUP BY 1, 2),
norms AS (SELECT item_idx, sqrt(sum(w * w)) + 1e-8 AS norm FROM w GROUP BY 1),
dots AS (SELECT a.item_idx AS item_i, b.item_idx AS item_j, sum(a.w * b.w) AS dot FROM w a JOIN w b USING (user_idx) WHERE a.item_idx <> b.item_idx GROUP BY 1, 2),
cosines AS (SELECT item_i, item_j, round(dot / ni.norm / nj.norm, 9) AS sim FROM dots JOIN norms ni ON ni.item_idx = item_i JOIN norms nj ON nj.item_idx = item_j),
sims AS MATERIALIZED (SELECT * FROM cosines WHERE sim > 0 QUALIFY rank() OVER (PARTITION BY item_i ORDER BY sim DESC) <= 100),
knn_scores AS MATERIALIZED (SELECT w.user_idx, item_j AS item_idx, round(sum(w * sim), 9) AS score FROM w JOIN gold USING (user_idx) JOIN sims ON item_i = w.item_idx GROUP BY 1, 2)"""
MARKOV = """steps AS (SELECT item_idx AS item_from, lead(item_idx) OVER (PARTITION BY user_idx ORDER BY ts, pos) AS item_to FROM train),
edges AS (SELECT item_from, item_to, count(*) AS n FROM steps WHERE item_to IS NOT NULL GROUP BY 1, 2),
moves AS MATERIALIZED (SELECT item_from, item_to, n, round(n / (sum(n) OVER (PARTITION BY item_from) + 1e-8), 9) AS p FROM edges),
last AS (SELECT user_idx, item_idx AS last_item FROM train QUALIFY row_number() OVER (PARTITION BY user_idx ORDER BY ts DESC, pos DESC) = 1),
markov_scores AS MATERIALIZED (SELECT l.user_idx, item_to AS item_idx, round(p, 9) AS score FROM last l JOIN gold USING (user_idx) JOIN moves ON item_from = last_item)"""
RECENT = "recent AS MATERIALIZED (SELECT user_idx, item_idx, ts, pos, row_number() OVER (PARTITION BY user_idx ORDER BY ts DESC, pos DESC) AS back FROM train QUALIFY back <= {n})"
VECTORS = """vec AS (SELECT i.item_idx, e.embedding::DOUBLE[] AS v FROM items i JOIN embeddings e ON e.vec_id = i.item_idx % (SELECT count(*) FROM embeddings)),
unit AS MATERIALIZED (SELECT item_idx, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM vec),
flat AS (SELECT r.user_idx, generate_subscripts(u.v, 1) AS pl, unnest(u.v) AS x FROM recent r JOIN unit u USING (item_idx) WHERE r.back <= 10),
mean AS (SELECT user_idx, pl, avg(x) AS x FROM flat GROUP BY 1, 2),
wide AS (SELECT user_idx, list(x ORDER BY pl) AS u FROM mean GROUP BY 1),
profiles AS MATERIALIZED (SELECT user_idx, list_transform(u, lambda x: x / sqrt(list_dot_product(u, u))) AS u FROM wide)"""
EMBEDDING = "emb_scores AS (SELECT g.user_idx, i.item_idx, round(list_dot_product(p.u, i.v), 9) AS score FROM gold g JOIN profiles p USING (user_idx), unit i)"
TFIDF = r"""toks AS (SELECT item_idx, regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}') AS t FROM items),
grams AS (SELECT item_idx, unnest(list_concat(t, CASE WHEN len(t) > 1 THEN list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]) ELSE [] END)) AS term FROM toks),
tf AS (SELECT item_idx, term, count(*) AS tf FROM grams GROUP BY 1, 2),
vocab AS (SELECT term, sum(tf) AS total, count(*) AS df FROM tf GROUP BY 1 ORDER BY total DESC, term LIMIT 50000),
x AS (SELECT item_idx, term, tf * (ln((1 + (SELECT count(*) FROM items)) / (1 + df)::DOUBLE) + 1) AS x FROM tf JOIN vocab USING (term)),
tv AS MATERIALIZED (SELECT item_idx, term, x / sqrt(sum(x * x) OVER (PARTITION BY item_idx)) AS x FROM x),
tsum AS (SELECT user_idx, term, sum(x) AS x FROM recent JOIN tv USING (item_idx) WHERE back <= 10 GROUP BY 1, 2),
tp AS MATERIALIZED (SELECT user_idx, term, x / sqrt(sum(x * x) OVER (PARTITION BY user_idx)) AS y FROM tsum)"""


def pools(n: int = 50) -> str:
    """The long table of the four retrievers."""
    parts = [POP_ITEMS, ORDER.format(source="pop_items"), by_order(n, "pop_top"), SIMILARITY, best("knn_scores", n, "knn_top"), MARKOV, best("markov_scores", n, "markov_top"), RECENT.format(n=50), VECTORS, EMBEDDING, best("emb_scores", n, "emb_top")]
    union = " UNION ALL ".join(f"SELECT '{m}' AS model, user_idx, item_idx, score, rank FROM {t}" for m, t in (("popularity", "pop_top"), ("itemknn", "knn_top"), ("markov", "markov_top"), ("embedding", "emb_top")))
    return ",\n".join([*parts, f"pools AS MATERIALIZED ({union})"])


def at_k(k_list: tuple[int, ...] = K_LIST, rank: str = "rank") -> str:
    out = []
    for k in k_list:
        hit = f"{rank} <= {k}"
        out += [
            f"round(avg(CASE WHEN {hit} THEN 1.0::DOUBLE ELSE 0 END), 6) AS recall_at_{k}",
            f"round(avg(CASE WHEN {hit} THEN 1 / log2({rank} + 1) ELSE 0::DOUBLE END), 6) AS ndcg_at_{k}",
            f"round(avg(CASE WHEN {hit} THEN 1.0::DOUBLE / {rank} ELSE 0 END), 6) AS mrr_at_{k}",
        ]
    return ", ".join(out)


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"
