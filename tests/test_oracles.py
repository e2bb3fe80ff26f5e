"""Every query with a SQL twin against DuckDB, and the others for a stable schema."""

import math

import duckdb
import pytest

from quillon.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if hasattr(v, "as_tuple"):
        return float(v)
    return v


def _rows(rows):
    return sorted((tuple(map(_plain, r)) for r in rows), key=repr)


def duck(sf, sql):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return [names[i] for i in order], _rows([tuple(r[i] for i in order) for r in got.fetchall()])


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_equals_sql(spark, sf, name):
    df = catalog.queries()[name](spark, sf)
    columns = sorted(df.columns)
    names, want = duck(sf, catalog.oracle_sql()[name])
    assert columns == names
    got = _rows([tuple(r) for r in df.select(*columns).collect()])
    assert len(got) == len(want)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_runs(spark, sf, name):
    assert catalog.queries()[name](spark, sf).count() > 0
