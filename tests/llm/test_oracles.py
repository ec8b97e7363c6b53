"""Queries with SQL give the same rows in an independent engine."""

import glob
import os

import duckdb
import pytest

from rankforge.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, sf, name):
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    want = con.sql(ORACLES[name]).df()
    got = QUERIES[name](spark, sf).toPandas()[list(want.columns)]
    key = want.columns[0]
    assert got.sort_values(key).values.tolist() == want.sort_values(key).values.tolist()


def test_pii_sql_with_discovered_spans(spark):
    import random

    import pandas as pd

    from rankforge.llm import pii

    rng = random.Random(3)
    kinds = [("mail to", "x{}@a.org"), ("at host", "10.0.0.{}"), ("call on", "+1 555 01{}9 22"), ("see 7 of", "n{},")]
    odd = ["u{}(at)b.org", "host-{}", "y@z", "fe80::{}"]
    texts = []
    for _ in range(300):
        parts = []
        for _ in range(rng.randrange(1, 6)):
            left, usual = rng.choice(kinds)
            parts += [left, (usual if rng.random() < 0.95 else rng.choice(odd)).format(rng.randrange(10, 99))]
        texts.append(rng.choice([" ", "  ", "\n"]).join(parts))
    texts += [None, "", "mail to"]
    con = duckdb.connect()
    con.register("documents", pd.DataFrame({"doc_id": range(len(texts)), "text": texts}))
    want = con.sql(ORACLES["op2_pii"]).df().sort_values("doc_id")
    got = pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).toPandas().sort_values("doc_id")[list(want.columns)]
    assert got.values.tolist() == want.values.tolist()
    assert want["spans"].str.count(":").sum() > 2 * want[["n_email", "n_ip", "n_card", "n_phone"]].sum().sum()
