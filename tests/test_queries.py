"""Every query of the catalog against its SQL, run by DuckDB on the same tables."""

import math
from pathlib import Path

import duckdb
import pytest

from tidemark.catalog import ORACLE, QUERIES

TABLES = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    own = duckdb.connect()
    for path in TABLES.glob("*.parquet"):
        own.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return own


def plain(rows, columns):
    at = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(round(r[i], 6) if isinstance(r[i], float) and math.isfinite(r[i]) else r[i] for i in at) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    out = QUERIES[name](spark, str(TABLES))
    got = plain([tuple(r) for r in out.collect()], out.columns)
    assert name in ORACLE
    want = duck.execute(ORACLE[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(out.columns)
    assert got == plain(want.fetchall(), columns)
