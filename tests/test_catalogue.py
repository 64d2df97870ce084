"""Every query against its SQL in DuckDB, over the smallest tables."""

import zlib
from pathlib import Path

import duckdb
import pytest

from tidelake.plans import catalogue

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def rows(columns, values):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    cell = lambda x: round(float(x), 9) if isinstance(x, float) else x
    return sorted(columns), sorted((tuple(repr(cell(v[i])) for i in order) for v in values))


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(name, spark, duck):
    got = catalogue.QUERIES[name](spark, DATA)
    if name not in catalogue.ORACLES:
        assert got.count() > 0
        return
    want = duck.execute(catalogue.ORACLES[name])
    assert rows(got.columns, got.collect()) == rows([d[0] for d in want.description], want.fetchall())


def test_every_oracle_has_a_query():
    assert set(catalogue.ORACLES) <= set(catalogue.QUERIES)


def test_file_crc32_of_the_log(spark):
    data = Path(DATA, "events.parquet").read_bytes()
    assert [(r["name"], r["length"], r["crc32"]) for r in catalogue.QUERIES["file_crc32"](spark, DATA).collect()] == [("events.parquet", len(data), f"{zlib.crc32(data):08x}")]
