"""Schemas and names that all modules share."""

from __future__ import annotations

from pyspark.sql import types as T

INTERACTIONS = T.StructType([T.StructField("user_id", T.StringType()), T.StructField("item_id", T.StringType()), T.StructField("rating", T.DoubleType()), T.StructField("timestamp", T.DoubleType())])
ITEMS = T.StructType([T.StructField(c, T.StringType()) for c in ("item_id", "title", "genres", "text")])
SCORED = T.StructType([T.StructField("user_idx", T.LongType()), T.StructField("item_idx", T.LongType()), T.StructField("score", T.DoubleType())])
CANDIDATES = T.StructType([T.StructField("user_idx", T.LongType()), T.StructField("item_idx", T.LongType()), T.StructField("label", T.IntegerType()), T.StructField("pool_pos", T.IntegerType())])

#: Scenario flags in order of priority, and those that the published breakdowns show.
SCENARIOS = ("item_new", "item_cold", "long_tail", "user_cold", "warm")
SHOWN_SCENARIOS = SCENARIOS[1:]
K_LIST = (5, 10, 20, 50)
