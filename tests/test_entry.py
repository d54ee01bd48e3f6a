import importlib
import math
import os

import duckdb
import pytest

SF = "/root/testdata/sf0.001"
entry = importlib.import_module("__spark_entry__")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SF}/{name}'")
    return con


def plain(rows, columns):
    def value(x):
        if isinstance(x, float):
            return "nan" if math.isnan(x) else f"{x:.9g}"
        return f"{float(x):.9g}" if isinstance(x, int) and not isinstance(x, bool) else str(x)

    return sorted(tuple(value(r[c]) for c in sorted(columns)) for r in rows)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    want = duck.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(df.columns)
    assert plain([r.asDict() for r in df.collect()], columns) == plain([dict(zip(columns, r, strict=True)) for r in want.fetchall()], columns)


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
