"""Every registered query of the core against its SQL in DuckDB."""

import subprocess
import sys
import zlib
from decimal import Decimal
from pathlib import Path

import duckdb
import pytest

from tariffloom.plans.registry import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, Decimal):
        return format(v, "f")
    if isinstance(v, float):
        return repr(round(v, 6))
    return "[" + ",".join(map(plain, v)) + "]" if isinstance(v, (list, tuple)) else str(v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, con, name):
    frame = QUERIES[name](spark, SF)
    columns = sorted(frame.columns)
    got = sorted([plain(r[c]) for c in columns] for r in frame.collect())
    result = con.execute(SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    assert got == sorted([plain(r[names.index(c)]) for c in columns] for r in result.fetchall())


def test_import_needs_no_session():
    subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; assert e.queries() and e.oracle_sql()"], cwd=Path(__file__).resolve().parent.parent, check=True)


def test_every_query_has_sql():
    assert set(QUERIES) - set(SQL) == {"zip_entries", "stream_matched", "stream_retried", "coupled_machines", "coupled_machines_stream"}  # DuckDB has no crc32; folds with state are held to brute force


def test_zip_entries(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["zip_entries"](spark, SF).collect()
    assert len(rows) == len(docs) == len({r.name for r in rows})
    for r in rows:
        text = (docs[r.doc_id].text or "").encode()
        assert (r.bytes, r.crc32) == (len(text), zlib.crc32(text))
