"""Every query with SQL gives the rows that DuckDB gives on the same tables."""

import math
from decimal import Decimal
from pathlib import Path

import pytest

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not DATA.exists():
        pytest.skip("no test tables")
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, (float, Decimal)):
        return f"{float(v):.9g}"
    return str(v)


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in found)


def names_with_sql():
    from corpusloom.plans import registry

    return sorted(registry.oracles())


@pytest.mark.parametrize("name", names_with_sql())
def test_same_rows_as_sql(spark, duck, name):
    from corpusloom.plans import registry

    got = registry.queries()[name](spark, str(DATA))
    want = duck.sql(registry.oracles()[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())


def test_every_query_but_rendering_has_sql():
    from corpusloom.plans import registry

    assert registry.queries().keys() - registry.oracles().keys() == {"page_markdown"}


def test_entry(spark):
    if not DATA.exists():
        pytest.skip("no test tables")
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
