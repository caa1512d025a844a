"""Every registered query of the engine against its oracle in DuckDB."""

import os

import duckdb
import pytest

from tidefold.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(names, data):
    at = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(repr([r[k] for k in at]) for r in data)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_matches_oracle(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF)
    want = duck.execute(catalog.ORACLE[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    expected = rows(names, want.fetchall())
    assert expected
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == expected


def test_every_query_has_an_oracle():
    assert set(catalog.QUERIES) == set(catalog.ORACLE)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_key_filter_and_columns_reach_the_scan(spark):
    from tidefold.operators import fold, scan

    view = fold.fold(catalog.event_log(spark, SF), carry=["value"])
    plan = scan.between(view, 2, 9, "int").select("key")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(user_id,2)" in plan
    assert "props" not in plan.split("ReadSchema")[1]
