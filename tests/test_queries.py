"""Every registered query of the engine against its SQL, on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from quillon.queries import ORACLE_SQL, QUERIES
from tests.conftest import DATA

SF = f"{DATA}/sf0.001"


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def normal(df):
    def one(x):
        if x is None or x is pd.NA or x is pd.NaT or x != x:
            return "null"
        return str(x) if isinstance(x, (str, bool)) or type(x).__name__ == "bool" else format(float(x), ".9g") if hasattr(x, "__float__") else str(x)

    return sorted(tuple(map(one, r)) for r in df[sorted(df.columns)].itertuples(index=False, name=None)), sorted(df.columns)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sql, name):
    got = QUERIES[name](spark, SF).toPandas()
    assert normal(got) == normal(sql.sql(ORACLE_SQL[name]).df())


def test_entry_points(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_whole_tables(spark, sql, monkeypatch):
    from quillon.sources import xbf

    put, written = xbf.write_xbf, []
    monkeypatch.setattr(xbf, "write_xbf", lambda *a: written.append(put(*a)))
    assert QUERIES["xbf_round_trip"](spark, SF).count() == sql.sql(ORACLE_SQL["xbf_round_trip"]).count("*").fetchall()[0][0]
    assert written == [sql.sql("SELECT count(*) FROM orders").fetchall()[0][0]]
    assert QUERIES["find_or_not"](spark, SF).count() > 0
    assert sum(r.n for r in QUERIES["expr_mod"](spark, SF).collect()) == sql.sql("SELECT count(*) FROM lineitem").fetchall()[0][0]
    assert QUERIES["find_not"](spark, SF).count() > 0
