"""Every registered query of the library against its SQL on the smallest tables."""

import duckdb
import pytest

from chiasma.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def canonical(v):
    if isinstance(v, float):
        return repr(round(v, 6) + 0.0)
    return str([canonical(x) for x in v]) if isinstance(v, list | tuple) else str(v)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(map(canonical, r)) for r in df.select(*[f"`{c}`" for c in columns]).collect())
    if name not in catalog.oracle_sql():
        assert got
        return
    rel = duck.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert sorted(tuple(canonical(r[k]) for k in at) for r in rel.fetchall()) == got
