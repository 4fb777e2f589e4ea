"""Every question gives the rows of its SQL."""

from datetime import datetime

import duckdb
import pytest

from pathloom.queries import ORACLE_SQL, QUERIES

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "events")


@pytest.fixture(scope="module")
def duck(data_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data_dir}/{t}.parquet'")
    return con


def plain(x):
    """A value without what tells the engines apart: widths of numbers, time zones, kinds of sequences."""
    if x is None or isinstance(x, (bool, str)):
        return repr(x)
    if isinstance(x, (bytes, bytearray)):
        return bytes(x).hex()
    if isinstance(x, datetime):
        return x.replace(tzinfo=None).isoformat()
    if isinstance(x, dict):
        return plain(sorted(x.items()))
    if isinstance(x, (list, tuple)):
        return f"[{', '.join(map(plain, x))}]"
    return repr(float(x))


def rows(names: list[str], values: list[tuple]) -> list[tuple]:
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(tuple(plain(r[i]) for i in order) for r in values)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_question(spark, duck, data_dir, name):
    got, want = QUERIES[name](spark, data_dir), duck.execute(ORACLE_SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(names)
    assert rows(got.columns, got.collect()) == rows(names, want.fetchall())
