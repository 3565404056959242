"""The registered queries beside their SQL, and the contracts of those without SQL."""

from __future__ import annotations

import collections
import zlib
from pathlib import Path

import pytest

import __spark_entry__ as entry
from corpusprep.llm import queries

duckdb = pytest.importorskip("duckdb")
FOLDER = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="tables not present")


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    connection.execute("SET TimeZone='UTC'")
    for file in FOLDER.glob("*.parquet"):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return connection


def rows(table):
    names = sorted(table.column_names)
    return names, sorted(zip(*[map(repr, table[n].to_pylist()) for n in names]))


def test_all_are_registered():
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{k}" for k in range(1, 14)}
    assert set(queries.QUERIES) | {"pipeline"} <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, con, name):
    ours = queries.QUERIES[name](spark, str(FOLDER)).toArrow()
    assert rows(ours) == rows(con.sql(queries.ORACLES[name]).to_arrow_table())


def test_language_contract(spark):
    docs = {r.doc_id: r for r in queries.table(spark, str(FOLDER), "documents").collect()}
    got = queries.QUERIES["op2_language"](spark, str(FOLDER)).collect()
    assert {r.doc_id for r in got} == set(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in held) >= 0.95 * len(held)


def test_toxicity_contract(spark):
    got = queries.QUERIES["op7_toxicity"](spark, str(FOLDER)).collect()
    assert len(got) == queries.table(spark, str(FOLDER), "documents").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)


def test_shard_contract(spark):
    docs = {r.doc_id: r.text or "" for r in queries.table(spark, str(FOLDER), "documents").collect()}
    got = queries.QUERIES["op6_uniform_shards"](spark, str(FOLDER)).collect()
    assert collections.Counter(r.doc_id for r in got) == collections.Counter(list(docs))
    slots = collections.defaultdict(list)
    for r in got:
        raw = docs[r.doc_id].encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(raw) + 16, zlib.crc32(raw), "rows", None)
        slots[r.shard].append(r.slot)
    assert set(slots) <= set(range(40)) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
