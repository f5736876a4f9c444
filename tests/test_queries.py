"""Every query with SQL gives the rows of that SQL; the others run."""

import duckdb
import pytest

from hexflow.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ROWS_ONLY = [q for q in registry.QUERIES if q not in registry.ORACLES]


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


def _cells(rows, columns):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(None if r[k] is None else float(r[k]) if isinstance(r[k], (int, float)) and not isinstance(r[k], bool) else str(r[k]) for k in order) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_matches_sql(spark, small, duck, name):
    got = registry.QUERIES[name](spark, small)
    want = duck.execute(registry.ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert _cells(got.collect(), got.columns) == _cells(want.fetchall(), columns)


@pytest.mark.parametrize("name", [q for q in ROWS_ONLY if q not in ("lambdamart_scores", "gmm")])
def test_runs(spark, small, name):
    assert registry.QUERIES[name](spark, small).count() > 0


def test_entry(spark, small):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(registry.QUERIES) <= set(__spark_entry__.queries())
