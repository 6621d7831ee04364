"""Every registered query against its DuckDB oracle on sf0.001 (the driver uses sf0.01)."""

import pytest

from quarry.plans.registry import oracle_sql, queries
from tools.oracle_check import rows_of

SF = "/root/testdata/sf0.001"
NAMES = sorted(oracle_sql())


@pytest.mark.parametrize("name", NAMES)
def test_matches_oracle(spark, duck, name):
    df = queries()[name](spark, SF)
    sc, sr = rows_of(df.columns, [tuple(r) for r in df.collect()])
    rel = duck.execute(oracle_sql()[name])
    dc, dr = rows_of([d[0] for d in rel.description], rel.fetchall())
    assert sc == dc
    assert len(sr) == len(dr)
    assert sr == dr


def _ids(duck, column, table):
    return sorted(r[0] for r in duck.execute(f"SELECT {column} FROM {table}").fetchall())


@pytest.mark.parametrize("name", sorted(set(queries()) - set(NAMES)))
def test_queries_without_sql(spark, duck, name):
    rows = queries()[name](spark, SF).collect()
    columns = set(rows[0].asDict())
    if "cluster_id" in columns:  # each row once, labels from -1 up without gaps
        key, of = ("doc_id", "documents") if "doc_id" in columns else ("vec_id", "embeddings")
        assert sorted(r[key] for r in rows) == _ids(duck, key, of)
        labels = {r["cluster_id"] for r in rows}
        assert all(label is not None and label >= -1 for label in labels)
        if name.startswith(("c1_", "c3_")):
            assert labels == set(range(10))
        if name.startswith(("c5", "c6", "c8")):
            assert labels - {-1} == set(range(len(labels - {-1})))
    elif name == "m9_fused_features":
        assert len({r["doc_id"] for r in rows}) == len(rows) and len({r["n_dims"] for r in rows}) == 1
        assert all(r["sq_norm"] > 0 for r in rows)
    elif name == "m11_hybrid_neighbours":
        by = {}
        for r in sorted(rows, key=lambda r: (r["src"], r["rank"])):
            by.setdefault(r["src"], []).append(r)
        for src, own in by.items():
            assert [r["rank"] for r in own] == [1, 2, 3, 4, 5] and src not in {r["dst"] for r in own}
            assert [r["dist"] for r in own] == sorted(r["dist"] for r in own)
    else:
        pytest.fail(f"{name} has neither SQL nor a check")
