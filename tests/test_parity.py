"""Every query with SQL gives the rows that DuckDB gives; the others run."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from querywell.plans import catalogue  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return c


def plain(row):
    return tuple(repr(round(x, 6) + 0.0) if isinstance(x, float) else repr(x) for x in row)


@pytest.mark.parametrize("name", list(catalogue.queries()))
def test_query(spark, sf_dir, con, name):
    df = catalogue.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted(plain(r) for r in df.select(*columns).collect())
    sql = catalogue.oracle_sql().get(name)
    if sql:
        want = sorted(plain(r) for r in con.execute(f"select {', '.join(f'\"{c}\"' for c in columns)} from ({sql})").fetchall())
        assert got == want
    assert got or name in ("neighbors_1hop",)
