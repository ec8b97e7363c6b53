"""The queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from rankforge.llm import ann, chat, jaccard, langid, media, mixing, packing, pii, substrings, urls


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.search(vectors, vectors.where("vec_id % 100 = 0"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link(table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", langid.held_out())
    model = langid.fit(docs.where("not held_out"))
    return langid.detect(docs.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score")


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.digests(chat.format_chats(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)))


def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digests(media.audio_columns(table(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_ann, op2_pii, op3_jaccard, op4_packing, op5_urls, op6_mixing, op7_langid, op8_chat, op9_substrings, op10_media)
}


WORDS = r"regexp_extract_all({text}, '[^\x20\x09-\x0D]+')"
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Sets of shingles, pairs by a common shingle, and components as the smallest document that links reach.
JACCARD = f"""WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, {WORDS.format(text=LOWER)} AS ws FROM documents),
sh AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(list_slice(ws, s, s + 4), ' ') AS x FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS s FROM w WHERE len(ws) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
links AS MATERIALIZED (SELECT a, b FROM (SELECT l.doc_id AS a, r.doc_id AS b, count(*) AS c FROM sh l JOIN sh r USING (x) WHERE l.doc_id <> r.doc_id GROUP BY 1, 2) JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 75 * (na.n + nb.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1) c USING (doc_id)"""

CONTROL = r"'(\\|<s>|</s>|\[INST\]|\[/INST\])', '\\\1', 'g'"

#: The template, its escapes and the loss mask, without forming the strings.
CHAT = f"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (3 + sum(length('[INST][/INST]</s>') + length(regexp_replace(role, {CONTROL})) + length(regexp_replace(text, {CONTROL}))))::BIGINT AS formatted_chars FROM t GROUP BY 1"""

#: Windows by their words, in the order of documents and starts; words of later ones go.
SUBSTRINGS = f"""WITH w AS MATERIALIZED (SELECT doc_id, {WORDS.format(text="coalesce(text, '')")} AS ws FROM documents),
windows AS MATERIALIZED (SELECT doc_id, s, md5(array_to_string(list_slice(ws, s, s + 19), ' ')) AS x FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS s FROM w WHERE len(ws) >= 20)),
later AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY x ORDER BY doc_id, s) AS nth FROM windows) WHERE nth > 1),
gone AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS at_word FROM later),
kept AS (SELECT p.doc_id, string_agg(word, ' ' ORDER BY p.at_word) AS text, count(*) AS n FROM (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS at_word FROM w) p WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.doc_id = p.doc_id AND g.at_word = p.at_word) GROUP BY 1)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(text, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)"""

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "word": r"[^\x20\x09-\x0D]+",
}
DIGITS = "regexp_replace(v, '[^0-9]', '', 'g')"
FINE = f"""CASE kind WHEN 'email' THEN true WHEN 'word' THEN true WHEN 'phone' THEN length({DIGITS}) BETWEEN 8 AND 15
  WHEN 'ip' THEN len(list_filter(string_split(v, '.'), lambda x: length(ltrim(x, '0')) > 3 OR coalesce(try_cast(nullif(ltrim(x, '0'), '') AS INT), 0) > 255)) = 0
  ELSE length({DIGITS}) BETWEEN 16 AND 19 AND list_sum(list_transform(range(0, length({DIGITS})), lambda i: CASE WHEN i % 2 = 0 THEN substr({DIGITS}, length({DIGITS}) - i, 1)::INT ELSE (2 * substr({DIGITS}, length({DIGITS}) - i, 1)::INT) // 10 + (2 * substr({DIGITS}, length({DIGITS}) - i, 1)::INT) % 10 END)) % 10 = 0 END"""
MATCHES = " UNION ALL ".join(f"SELECT doc_id, '{k}' AS kind, generate_subscripts(vs, 1) AS i, unnest(vs) AS v, unnest(gs[1:len(vs)]) AS g FROM (SELECT doc_id, regexp_extract_all(t, '{r}') AS vs, string_split_regex(t, '{r}') AS gs FROM d)" for k, r in PLAIN.items())


def _rounds(n: int) -> str:
    """Patterns and scores of n rounds, each a pair of tables."""
    parts = ["s0 AS MATERIALIZED (SELECT value, kind, 1.0::DOUBLE AS score FROM known)"]
    for r in range(n):
        parts += [
            f"p{r} AS MATERIALIZED (SELECT left_words, s.kind, sum(score) / max(instances) AS confidence FROM graph JOIN s{r} s USING (value) GROUP BY 1, 2 HAVING sum((score >= 0.5)::INT) >= 3 AND sum(score) / max(instances) >= 0.8)",
            f"s{r + 1} AS MATERIALIZED (SELECT value, kind, max(score) AS score FROM (SELECT value, kind, 1.0::DOUBLE AS score FROM known UNION ALL SELECT value, p.kind, 1 - exp(sum(ln(1 - least(confidence, 0.999::DOUBLE)))) FROM graph g JOIN p{r} p USING (left_words) WHERE g.kind IS NULL GROUP BY 1, 2) GROUP BY 1, 2)",
        ]
    return ", ".join(parts)


#: Places of all matches and words, contexts, and the graph of patterns and instances in three rounds.
PERSONAL = f"""WITH d AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS MATERIALIZED (SELECT doc_id, kind, i, v, sum(length(g) + length(v)) OVER (PARTITION BY doc_id, kind ORDER BY i)::BIGINT AS e FROM ({MATCHES})),
placed AS MATERIALIZED (SELECT doc_id, kind, i, v, e - length(v) AS s, e FROM m),
base AS MATERIALIZED (SELECT doc_id, kind, s, e, v FROM placed WHERE kind <> 'word' AND {FINE}),
words AS MATERIALIZED (SELECT doc_id, s, e, v, CASE WHEN i > 2 THEN regexp_replace(lower(lag(v, 2) OVER o || ' ' || lag(v) OVER o), '[0-9]+', '#', 'g') END AS left_words FROM placed WHERE kind = 'word' WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
others AS MATERIALIZED (SELECT doc_id, s, s + length(rtrim(v, '.,;:!?)]}}"' || chr(39))) AS e, lower(rtrim(v, '.,;:!?)]}}"' || chr(39))) AS value, left_words FROM words w WHERE left_words IS NOT NULL AND regexp_matches(v, '[0-9@]') AND NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = w.doc_id AND b.s < w.e AND w.s < b.e)),
edges AS MATERIALIZED (SELECT left_words, value, max(kind) AS kind FROM (SELECT left_words, lower(b.v) AS value, kind FROM base b JOIN words w ON w.doc_id = b.doc_id AND w.s = b.s WHERE left_words IS NOT NULL UNION ALL SELECT left_words, value, NULL FROM others) GROUP BY 1, 2),
wide AS MATERIALIZED (SELECT left_words, count(*) AS instances FROM edges GROUP BY 1 HAVING count(*) >= 3 AND count(kind) > 0),
graph AS MATERIALIZED (SELECT e.*, instances FROM edges e JOIN wide USING (left_words)),
known AS MATERIALIZED (SELECT DISTINCT value, kind FROM graph WHERE kind IS NOT NULL),
{_rounds(3)},
trusted AS (SELECT left_words, arg_max(kind, {{'c': confidence, 'k': kind}}) AS kind FROM p2 GROUP BY 1),
every AS (SELECT doc_id, kind, s, e, true AS base FROM base UNION ALL SELECT doc_id, kind, s, e, false FROM others JOIN trusted USING (left_words)),
said AS (SELECT *, kind || ':' || s || ':' || e AS said, list_position(['email', 'ip', 'card', 'phone'], kind) AS pl FROM every),
summed AS (SELECT doc_id, {", ".join(f"count(*) FILTER (base AND kind = '{k}') AS n_{k}" for k in list(PLAIN)[:4])}, string_agg(said, ',' ORDER BY pl, s) FILTER (base) AS base, string_agg(said, ',' ORDER BY pl, s) AS spans FROM said GROUP BY 1)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in list(PLAIN)[:4])}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM documents LEFT JOIN summed USING (doc_id)"""

#: Tokenizers, k-means, mined rules, dynamic programs, mixtures and spectra have no SQL; tests hold their queries against plain versions.
ORACLES: dict[str, str] = {"op2_pii": PERSONAL, "op3_jaccard": JACCARD, "op8_chat": CHAT, "op9_substrings": SUBSTRINGS}
