"""The driver contract: names, SQL of the library's queries against DuckDB on the smallest tables."""

import json
import os

import duckdb
import pytest

import __spark_entry__ as entry
from docloom.config import Config
from docloom.plans import ingest, queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(rows, order):
    def value(v):
        return round(v, 6) if isinstance(v, float) else tuple(map(value, v)) if isinstance(v, (list, tuple)) else v

    return sorted((tuple(value(r[i]) for i in order) for r in rows), key=repr)


def test_entry(spark):
    assert entry.entry(spark).columns == ["query_id", "id", "score", "rank"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, duck, name):
    got = queries.QUERIES[name](spark, SF)
    names = sorted(got.columns)
    want = duck.execute(queries.ORACLES[name])
    theirs = [d[0] for d in want.description]
    assert sorted(theirs) == names
    assert plain([tuple(r) for r in got.collect()], [got.columns.index(c) for c in names]) == plain(want.fetchall(), [theirs.index(c) for c in names])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_runs(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0


def test_entity_match_edges(spark, tmp_path):
    """Names that are empty, end in signs or stand beside marks, number signs and letters above U+FFFF; case of single characters."""
    found = ["A.", "", "C++ and c", "café x", "theⅧ Thé", "İthe", "\U0001d400the", "\U00031350the theࡰ", "ΛΌΓΟΣ'Α", "\\E.q the\n"]
    langs = ["en", "", "C++", "İ", "λόγοσ", "\\E.q", None]
    rows = [(100 + len(langs) * i + j, t, lang) for i, t in enumerate([*found, "a b", None]) for j, lang in enumerate(langs)]
    spark.createDataFrame([*rows, (-6, "Word, C++", "en")], "doc_id bigint, text string, lang string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = plain([tuple(r) for r in queries.entity_match(spark, str(tmp_path)).collect()], range(3))
    assert got == plain(con.execute(f"SELECT doc_id, name, cjk FROM ({queries.ORACLES['entity_match']})").fetchall(), range(3))
    assert (100, "", False) in got and (-6, "C++", False) in got and not any(r[1] == "the" for r in got if r[0] in range(135, 156))


def test_empty_names_tag_no_chunk(spark):
    call = json.dumps({"title": "T", "tags": ["testing"], "metadata": {"entities": [{"name": "", "type": "ORG"}, {"name": "C++", "type": "PRODUCT"}]}, "body": "C++ is here."})
    chunks, _ = ingest.build_index(spark.createDataFrame([("1", "a.txt", "C++")], "doc_id string, source_file string, text string"), Config(embedding_mode="hash", embedding_dim=8), lambda: lambda system, prompt: call)
    assert [r["entity_names"] for r in chunks.collect()] == [["C++"]]
