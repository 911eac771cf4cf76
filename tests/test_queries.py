"""Every query against its SQL on the small tables."""

import duckdb
import pytest

from corpusloom.plans.registry import REGISTRY

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, float):
        return float(f"{x:.8g}")
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    return x


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_query(spark, duck, name):
    run, sql = REGISTRY[name]
    df = run(spark, SF)
    rows = df.collect()
    if sql is None:
        assert df.columns
        return
    got = duck.execute(sql)
    names = [d[0] for d in got.description]
    columns = sorted(df.columns)
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    want = sorted((tuple(plain(r[i]) for i in at) for r in got.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in columns) for r in rows), key=repr) == want
