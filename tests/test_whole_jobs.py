"""Queries that once did less than their whole job."""

import duckdb
import numpy as np
from pyspark.sql import functions as F

from quarry.plans.registry import oracle_sql, queries

SF01 = "/root/testdata/sf0.01"


def test_neighbour_join_has_every_pair_within_its_first_radius(spark):
    rows = duckdb.sql(f"SELECT embedding FROM read_parquet('{SF01}/embeddings.parquet')").fetchall()
    x = np.array([r[0] for r in rows], np.float64)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    got = queries()["x3_eps_neighbours"](spark, SF01).agg(F.count("*"), F.max("dist")).first()
    assert got[0] == int((d <= 1.2).sum()) and 1.15 < got[1] <= 1.2
    assert "<= 1.2" in oracle_sql()["x3_eps_neighbours"]


def test_texts_are_cleaned_once_and_as_before(spark):
    import re

    from quarry.functions.text import STOP_WORDS, valid_tokens
    texts = [None, "", "the of", "Déjà-vu 12 kg/ha\tPlant\x0bB", "İstanbul Kelvin", "x y  z\n w", "A1b2_c"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    found = valid_tokens(df, "text", "tokens")
    stops, want = set(STOP_WORDS), {}
    for k, text in enumerate(texts):
        lower = spark.createDataFrame([(text or "",)], "t string").selectExpr("lower(t)").first()[0]
        words = re.sub(r"[^a-zA-Z \t\n\x0b\f\r]", " ", lower).split()
        want[k] = [w for w in words if w not in stops]
    assert {r.id: r.tokens for r in found.collect()} == {k: v for k, v in want.items() if v}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("regexp_extract_all") == 1 and "regexp_replace" not in plan
