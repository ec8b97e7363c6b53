"""What the queries share: the split, its thresholds and flags, the pools. Heavy parts are written once and read back."""

from __future__ import annotations

import gc
from collections.abc import Sequence
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankforge.operators import retrieve, scorers, split
from rankforge.sources import datasets
from rankforge.sources.readers import exists, fingerprint, shared_folder

POOL, RETRIEVED = 20, 50
#: What queries share, in the order in which it is built.
ARTEFACTS = ("log", "flagged", "candidates", "similarity", "pools")
MODELS = ("popularity", "itemknn", "markov", "embedding")


class Context:
    """The default log: purchases of 25 pieces and more, items launched at the test period, one cut in time."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir
        # Tables that change under the same path get artefacts of their own.
        self.root = f"{shared_folder(spark)}/rankforge-{spark.sparkContext.applicationId}/{fingerprint(spark, sf_dir)[:16]}"

    def artefact(self, name: str, build) -> DataFrame:
        """A table that is built once in a session; complete tables have Spark's marker."""
        path = f"{self.root}/{name}"
        if not exists(self.spark, f"{path}/_SUCCESS"):
            build().write.mode("overwrite").parquet(path)
            # Shuffle files stay until the driver collects its garbage.
            gc.collect()
            self.spark.sparkContext._jvm.System.gc()
        return self.spark.read.parquet(path)

    @cached_property
    def raw(self) -> DataFrame:
        return datasets.from_orders(self.spark, self.sf_dir)

    @cached_property
    def log(self) -> DataFrame:
        return self.artefact("log", lambda: split.launch_rule(split.temporal_split(self.raw)))

    @cached_property
    def train(self) -> DataFrame:
        return self.log.where("part = 'train'")

    @cached_property
    def seen(self) -> DataFrame:
        return self.log.where("part != 'test'").select("user_idx", "item_idx")

    @cached_property
    def items(self) -> DataFrame:
        return datasets.catalogue(self.spark, self.sf_dir)

    @cached_property
    def limits(self) -> DataFrame:
        return split.thresholds(self.train)

    @cached_property
    def stats(self) -> DataFrame:
        return split.item_stats(self.train, self.items, self.limits)

    @cached_property
    def flagged(self) -> DataFrame:
        return self.artefact("flagged", lambda: split.with_flags(self.log.where("part = 'test'"), self.train, self.limits))

    @cached_property
    def gold(self) -> DataFrame:
        return split.gold(self.flagged)

    @cached_property
    def vectors(self) -> DataFrame:
        return datasets.item_vectors(self.spark, self.sf_dir, self.items)

    @cached_property
    def candidates(self) -> DataFrame:
        return self.artefact("candidates", lambda: split.uniform_candidates(self.gold, self.train, self.items, POOL - 1))

    @cached_property
    def neighbours(self) -> DataFrame:
        """Lists of similar items, which scorers and retrievers share."""
        return self.artefact("similarity", lambda: scorers.neighbours(self.train))

    @cached_property
    def similarity(self) -> DataFrame:
        """The same as edges."""
        return scorers.edge_rows(self.neighbours)

    def retrieved(self, model: str, n: int = RETRIEVED) -> DataFrame:
        users = self.gold.select("user_idx")
        if model == "popularity":
            return retrieve.popularity(users, self.train, self.items, self.seen, n)
        if model == "itemknn":
            return retrieve.itemknn(users, self.train, self.seen, n, edges=self.neighbours)
        if model == "markov":
            return retrieve.markov(users, self.train, self.seen, n)
        if model == "embedding":
            kinds, vectors = datasets.vector_kinds(self.spark, self.sf_dir, self.items)
            return retrieve.embedding(users, self.train, vectors, self.seen, n, kinds=kinds)
        if model == "tfidf":
            return retrieve.tfidf(users, self.train, self.items, self.seen, n)
        if model == "recency":
            return retrieve.recency(users, self.train, self.items, self.seen, n)
        if model == "cooccur":
            return retrieve.graph_expansion(users, self.train, retrieve.cooccurrence(self.train), self.seen, n)
        raise ValueError(model)

    @cached_property
    def pools(self) -> DataFrame:
        """The long table of all retrieved lists, by model."""
        return self.pools_of(MODELS)

    def pools_of(self, models: Sequence[str]) -> DataFrame:
        """The lists of some models; others are not made. One model's lists are written at a time, so that one model's shuffle files are on disk."""
        for m in models:
            self.artefact(f"pools/model={m}", lambda m=m: self.retrieved(m))
        every = self.spark.read.option("basePath", f"{self.root}/pools").parquet(*[f"{self.root}/pools/model={m}" for m in models])
        return every.select("user_idx", "item_idx", "score", "rank", F.col("model").cast("string").alias("model"))
