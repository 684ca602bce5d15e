import duckdb
import pytest

from strandline.plans import queries

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, duck, name):
    df = queries.QUERIES[name](spark, DIR)
    cols = sorted(df.columns)
    rows = sorted(str(tuple(r)) for r in df.select(*cols).collect())
    if name in queries.ORACLES:
        names = ", ".join(f'"{c}"' for c in cols)
        assert rows == sorted(map(str, duck.execute(f"select {names} from ({queries.ORACLES[name]})").fetchall()))
    else:
        assert rows


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
