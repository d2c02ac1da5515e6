"""Every query with a SQL twin gives the same rows on the smallest tables; the others run."""

import math

import duckdb
import pytest

from querent import registry

TABLES = "documents embeddings pages benchmark labels conversations events".split()
SQL = registry.oracle_sql()
QUICK = [n for n in sorted(registry.queries()) if n not in ("ann_recall", "density_layers")]


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return f"{v:.9g}" if isinstance(v, float) else str(v)


def rows(records, names):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(cell(r[i]) for i in order) for r in records), key=lambda r: tuple((x is None, x or "") for x in r))


@pytest.fixture(scope="module")
def con(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", QUICK)
def test_query(spark, sf_dir, con, name):
    df = registry.queries()[name](spark, sf_dir)
    got = df.collect()
    if name not in SQL:
        assert df.columns
        return
    cur = con.execute(SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert rows(got, df.columns) == rows(cur.fetchall(), names)
