"""Every query that has SQL gives what DuckDB gives, on the smallest tables."""

import math
from pathlib import Path

import pytest

from rookery.plans.catalogue import ORACLE_SQL, QUERIES

SF = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return ""
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)):
        return f"{float(v):.9g}"
    return str(v)


@pytest.mark.skipif(not SF.exists(), reason="the tables aren't here")
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, str(SF))
    columns = sorted(df.columns)
    want = duck.sql(ORACLE_SQL[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    got = sorted(tuple(plain(v) for v in r) for r in df.select(columns).collect())
    assert got == sorted(tuple(plain(r[i]) for i in at) for r in want.fetchall()) and got


def test_rows_only(spark):
    for name in set(QUERIES) - set(ORACLE_SQL):
        assert QUERIES[name](spark, str(SF)).count() > 0


def test_one_python_pass_and_pruned_scan(spark):
    """Games are decoded by one Arrow function, from a scan of the columns it needs."""
    from pyspark.sql import functions as F

    from rookery.operators import columns as C
    from rookery.plans.book import order_games

    g = order_games(spark, str(SF)).select("o_orderkey", C.move_details("movedata").alias("d")).select("o_orderkey", F.size("d").alias("n"), F.exists("d", lambda x: x["is_check"]).alias("c"))
    plan = g._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "o_totalprice" not in plan and "BroadcastHashJoin" in plan


def test_rivals_are_counted_without_pairs(spark, tmp_path):
    """Nobody is joined with anybody, and ends of bands, ties, odd numbers, nulls and repeated keys count as in SQL."""
    import random

    import duckdb

    r = random.Random(3)
    odd = [math.nan, math.inf, -math.inf, 1e300, -0.0, 0.0, None]
    balance = lambda: r.choice([*odd, 300.0, -300.0, 100.25, 700.25]) if r.random() < 0.3 else r.randrange(-40, 400) * 25.0
    nation = lambda: r.choice([0, 1, 2, 7, None])
    key = lambda k: None if k % 50 == 9 else k // 2
    con = duckdb.connect()
    for table, a, n in (("customer", "c", 600), ("supplier", "s", 200)):
        rows = [(key(k), nation(), balance()) for k in range(n)]
        names = [f"{a}_custkey" if a == "c" else f"{a}_suppkey", f"{a}_nationkey", f"{a}_acctbal"]
        spark.createDataFrame(rows, f"{names[0]} long, {names[1]} int, {names[2]} double").coalesce(1).write.parquet(str(tmp_path / f"{table}.parquet"))
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
    df = QUERIES["rivals_in_range"](spark, str(tmp_path))
    assert "Join" not in df._jdf.queryExecution().optimizedPlan().toString()
    want = con.sql(ORACLE_SQL["rivals_in_range"]).fetchall()
    order = lambda rows: sorted((-1 if k is None else k, n) for k, n in rows)
    assert order(map(tuple, df.collect())) == order(want) and sum(n for _, n in want) > 1000

    spark.createDataFrame([], "s_suppkey long, s_nationkey int, s_acctbal double").write.mode("overwrite").parquet(str(tmp_path / "supplier.parquet"))
    assert {n for _, n in QUERIES["rivals_in_range"](spark, str(tmp_path)).collect()} == {0}
