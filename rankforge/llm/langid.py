"""Language identification by mixture inference over character n-gram likelihoods.

``fit`` counts the hashed character trigrams of every labelled training text; the
model has ``BUCKETS`` probabilities for each language, whatever the input.
``detect`` estimates each document's language proportions by expectation
maximisation (a document is a mixture of languages, a trigram comes from one of
them) and takes the language set with the best likelihood less half log n for each
language; the prediction is the set's largest member.

Corner cases: null texts and texts without a letter are ``und`` with score 0; so
are all texts if nothing was labelled. Repeated rows and ties (the smaller language
name wins) have defined results; columns of the input pass through, save that
lang_pred and score replace columns of these names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankforge.llm.workspace import bounded_batches, releasing

BUCKETS = 1 << 15
#: Code points worked on at a time with up to four languages; longer texts are taken in overlapping parts.
BLOCK = 1 << 19
ROUNDS = 5
LETTER = regex.compile(r"\p{L}")


def framed(text: str) -> str:
    """A text as its trigrams see it: lower-cased, between two spaces."""
    return f" {text.lower()} "


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(index of the text, bucket) for each trigram of the texts."""
    return grams_of([framed(t) for t in texts])


def grams_of(parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(index of the part, bucket) for each trigram of framed texts or parts of them."""
    code = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), "<u4")
    owner = np.repeat(np.arange(len(parts), dtype=np.int32), [len(p) for p in parts])
    # Digits and marks say nothing of a language: they count as spaces.
    code = np.where((code < 65) | ((code > 90) & (code < 97)) | ((code > 122) & (code < 170)), 32, code).astype(np.uint32)
    if len(code) < 3:
        return np.empty(0, np.int32), np.empty(0, np.int64)
    h = (code[:-2] * np.uint32(0x9E3779B1) + code[1:-1]) * np.uint32(0x85EBCA6B) + code[2:]
    h ^= h >> np.uint32(15)
    h *= np.uint32(0xC2B2AE35)
    good = (owner[:-2] == owner[2:]) & ((code[:-2] != 32) | (code[1:-1] != 32)) & ((code[1:-1] != 32) | (code[2:] != 32))
    return owner[:-2][good], (h >> np.uint32(17))[good].astype(np.int64)


def blocks(texts: list[str], languages: int = 4) -> Iterator[tuple[list[int], list[str]]]:
    """Framed texts in blocks of bounded size; (indices, parts). Every trigram lies in one part, and there are no others.

    Inference holds some numbers for each language and trigram, so more languages make smaller blocks.
    """
    block = max(3, BLOCK * 4 // max(4, languages))
    at, parts, size = [], [], 0
    for i, t in enumerate(map(framed, texts)):
        for s in range(0, len(t), block):
            p = t[max(0, s - 2) : s + block]
            if parts and size + len(p) > block:
                yield at, parts
                at, parts, size = [], [], 0
            at.append(i)
            parts.append(p)
            size += len(p)
    if parts:
        yield at, parts


class Model:
    """Smoothed log probabilities of the buckets by language."""

    def __init__(self, counts: dict[str, np.ndarray]) -> None:
        self.languages = sorted(counts)
        if self.languages:
            c = np.stack([counts[k] for k in self.languages]).astype(np.float64) + 0.05
            self.p = (c / c.sum(1, keepdims=True)).astype(np.float32)


def fit(docs: DataFrame, lang: str = "lang") -> Model:
    """Counts over all given documents with a language and a text; BUCKETS rows for each language reach the driver at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for b in batches:
            langs, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for k in dict.fromkeys(langs):
                for _, parts in blocks([t for t, x in zip(texts, langs, strict=True) if x == k]):
                    n = np.bincount(grams_of(parts)[1], minlength=BUCKETS)
                    total[k] = total[k] + n if k in total else n
        for k, n in total.items():
            at = np.flatnonzero(n)
            yield pa.record_batch([pa.array([k] * len(at), pa.string()), pa.array(at), pa.array(n[at])], ["lang", "bucket", "n"])

    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(lang).cast("string").alias("lang"), F.col("text").cast("string").alias("text")).where("lang is not null and text is not null")
    found = rows.mapInArrow(releasing(run), "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    table = found.toArrow()
    counts: dict[str, np.ndarray] = {}
    bucket, n = table["bucket"].to_numpy(), table["n"].to_numpy()
    names = np.array(table["lang"].to_pylist(), object)
    for k in sorted(set(names.tolist())):
        counts[k] = np.zeros(BUCKETS, np.int64)
        counts[k][bucket[names == k]] = n[names == k]
    return Model(counts)


def expectation(like: np.ndarray, count: np.ndarray, owner: np.ndarray, docs: int, allowed: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Mixture proportions (languages x documents) within the allowed languages, and the log likelihoods."""
    k = len(like)
    share = allowed / np.maximum(allowed.sum(0), 1)
    total = np.maximum(np.bincount(owner, count, docs), 1e-9)
    for _ in range(rounds):
        w = share[:, owner] * like
        w *= count / np.maximum(w.sum(0), 1e-30)
        share = np.stack([np.bincount(owner, w[i], docs) for i in range(k)]) / total
    mass = (share[:, owner] * like).sum(0)
    return share, np.bincount(owner, count * np.log(np.maximum(mass, 1e-30)), docs)


def infer(model: Model, owner: np.ndarray, bucket: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of the language, score) of each document; -1 without trigrams."""
    key, n = np.unique(owner.astype(np.int64) * BUCKETS + bucket, return_counts=True)
    own, like = (key // BUCKETS).astype(np.int64), model.p[:, key % BUCKETS].astype(np.float64)
    n = n.astype(np.float64)
    size = np.bincount(own, n, docs)
    k = len(model.languages)
    share, _ = expectation(like, n, own, docs, np.ones((k, docs)))
    order = np.argsort(-share, axis=0, kind="stable")
    single = np.stack([np.bincount(own, n * np.log(x), docs) for x in like])
    penalty = 0.5 * np.log(np.maximum(size, 2))
    best = np.argmax(single, 0)
    value = single.max(0) - penalty
    score = share[best, np.arange(docs)]
    todo = np.arange(docs)
    for s in range(2, k + 1):
        # Sets grow along the estimated proportions as long as the penalised likelihood does.
        allowed = np.zeros((k, docs))
        np.put_along_axis(allowed, order[:s], 1.0, 0)
        keep = np.isin(own, todo)
        if not keep.any():
            break
        mixed, ll = expectation(like[:, keep], n[keep], own[keep], docs, allowed, 4)
        won = todo[(ll - s * penalty)[todo] > value[todo]]
        value[won] = (ll - s * penalty)[won]
        best[won], score[won] = np.argmax(mixed, 0)[won], mixed.max(0)[won]
        todo = won
    return np.where(size > 0, best, -1), np.clip(score, 0, 1)


def detect(docs: DataFrame, model: Model) -> DataFrame:
    """docs with lang_pred and score (the estimated proportion of that language)."""
    bounded_batches(docs.sparkSession)
    docs = docs.drop("lang_pred", "score")
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    column = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column(column).to_pylist()]
            lang, score = ["und"] * len(texts), np.zeros(len(texts))
            live = [i for i, t in enumerate(texts) if model.languages and LETTER.search(t)]
            group: list[tuple[list[int], np.ndarray, np.ndarray]] = []

            def settle() -> None:
                """Predicts the documents gathered so far; a document's parts are always in one group."""
                if not group:
                    return
                ids = sorted({i for at, _, _ in group for i in at})
                place = {i: j for j, i in enumerate(ids)}
                own = np.concatenate([np.array([place[i] for i in at], np.int64)[o] for at, o, _ in group])
                best, s = infer(model, own, np.concatenate([x for _, _, x in group]), len(ids))
                for j, i in enumerate(ids):
                    if best[j] < 0:  # letters, but no trigram of them: the first language, undecided
                        best[j], s[j] = 0, 1 / len(model.languages)
                    lang[i], score[i] = model.languages[best[j]], s[j]
                group.clear()

            for at, parts in blocks([texts[i] for i in live], len(model.languages)):
                here = [live[i] for i in at]
                if group and here[0] != group[-1][0][-1]:
                    settle()
                group.append((here, *grams_of(parts)))
            settle()
            yield pa.record_batch([*b.columns, pa.array(lang, pa.string()), pa.array(score)], [*b.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(releasing(run), schema)


def held_out(doc_id: str = "doc_id") -> F.Column:
    """Documents that are kept from training: crc32 of the id's text leaves 2 modulo 4; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))
