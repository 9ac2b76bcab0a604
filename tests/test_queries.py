"""Every registered query against its SQL twin on the smallest tables."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))
import compare  # noqa: E402

import __spark_entry__ as entry  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="test tables are not here")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in compare.TABLES.split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query_matches_sql(spark, con, name):
    df = entry.queries()[name](spark, FOLDER)
    rows = df.collect()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    order = sorted(cols)
    assert order == sorted(df.columns)
    mine = sorted((tuple(compare.tidy(r[c]) for c in order) for r in rows), key=compare.key)
    theirs = sorted((tuple(compare.tidy(r[cols.index(c)]) for c in order) for r in cur.fetchall()), key=compare.key)
    assert mine == theirs


def test_flagship_runs(spark):
    assert entry.entry(spark).columns == ["symbol", "time", "close", "bb_upper", "bb_lower", "side"]
