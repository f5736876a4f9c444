"""Rows of tables that are larger than the small ones: SQL decides."""

import duckdb
import pytest

from hexflow.plans import registry


@pytest.fixture(scope="module")
def every_place(tmp_path_factory):
    """An event at each place the adapter knows: homes repeat after 2,001 users, positions after 100 values of k."""
    path = tmp_path_factory.mktemp("grown")
    duckdb.execute(f"""COPY (SELECT u * 100 + k AS event_id, TIMESTAMP '2024-01-05 00:00:00' + INTERVAL (u * 100 + k) SECOND * 17 AS ts, u AS user_id, 'view' AS event_type, 1.0::DOUBLE AS value, '{{"k": ' || k || '}}' AS props
        FROM range(2001) a(u), range(100) b(k)) TO '{path}/events.parquet' (FORMAT parquet)""")
    return str(path)


@pytest.mark.parametrize("name", ["hex_assign", "player_hex_counts", "set_union"])
def test_cells_on_an_edge_are_those_of_the_sql(spark, every_place, tmp_path, name):
    registry.QUERIES[name](spark, every_place).write.parquet(f"{tmp_path}/got")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{every_place}/events.parquet'")
    con.execute(f"CREATE VIEW got AS SELECT * FROM '{tmp_path}/got/*.parquet'")
    con.execute(f"CREATE TABLE want AS {registry.ORACLES[name]}")
    columns = ", ".join(c[0] for c in con.execute("DESCRIBE want").fetchall())
    for a, b in (("got", "want"), ("want", "got")):
        assert con.execute(f"SELECT {columns} FROM {a} EXCEPT ALL SELECT {columns} FROM {b}").fetchall() == []


def test_mean_duration_does_not_depend_on_the_order_of_sessions(spark):
    """Six sessions of user 1394 of sf0.1 among 71: their mean is 1.4109935 minutes, which rounds up whatever order they are added in."""
    from itertools import permutations

    from hexflow.operators import features

    micros = [29071442, 1581386444, 1794248764, 1773785543, 145203925, 687136192]
    rows = [(f"p{k}", j, 1, 0, m) for k, order in enumerate(permutations(micros)) if k % 8 == 0 for j, m in enumerate([*order, *[0] * 65])]
    rollup = spark.createDataFrame(rows, "player_id string, session_seq int, n_events int, a long, z long").coalesce(1)
    rollup = rollup.selectExpr("player_id", "session_seq", "n_events", "timestamp_micros(a) AS first_ts", "timestamp_micros(z) AS last_ts", "(z - a) / 6e7D AS minutes")
    means = {r.m for r in registry.rounded(features.session_stats(rollup)).selectExpr("mean_session_duration_minutes AS m").collect()}
    assert means == {1.410994}
