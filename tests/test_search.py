"""Search and storage on small tables, BM25 against SQLite's full-text index."""

import random
import sqlite3

import numpy as np
import pytest

from docloom.operators import search
from docloom.plans import answer
from docloom.plans.store import Index

CORPUS = ["the cat sat on the mat", "a dog and a cat", "naïve café owner", "Étude in C", "nothing here", "cat cat cat dog"]


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_bm25_equals_sqlite(spark):
    rng = random.Random(1)
    words = "alpha beta gamma delta epsilon zeta eta theta".split()
    corpus = CORPUS + [" ".join(rng.choices(words, k=rng.randint(3, 30))) for _ in range(60)]
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE f USING fts5(text)")
    con.executemany("INSERT INTO f(rowid, text) VALUES (?, ?)", list(enumerate(corpus, 1)))
    docs = frame(spark, list(enumerate(corpus, 1)), "id bigint, text string")
    for n, q in enumerate(["cat dog", "alpha zeta zeta", "cafe etude"]):
        terms = " OR ".join(f'"{t}"' for t in q.split())
        want = {r: -s for r, s in con.execute("SELECT rowid, rank FROM f WHERE f MATCH ?", (terms,))}
        got = search.bm25(search.text_index(docs), frame(spark, [(n, q)], "query_id bigint, question string"), None).collect()
        assert {r["id"]: r["score"] for r in got} == pytest.approx(want, abs=1e-8)


def test_cjk_is_found(spark):
    docs = frame(spark, [(1, "机器学习"), (2, "深度")], "id bigint, text string")
    got = search.bm25(search.text_index(docs), frame(spark, [(0, "学习 AND")], "query_id bigint, question string")).collect()
    assert [r["id"] for r in got] == [1]


def test_vector_search_many_equals_brute_force(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(200, 8))
    v[10] = 0
    rows = [(i, [float(x) for x in v[i]] if i != 11 else None) for i in range(200)]
    index = frame(spark, rows, "id bigint, embedding array<double>").repartition(5)
    queries = frame(spark, [(i, [float(x) for x in v[i]]) for i in (0, 5, 7)], "query_id bigint, vector array<double>")
    for block in (2048, 2):
        got = search.vector_search_many(index, queries, 4, block=block).orderBy("query_id", "rank").collect()
        for q in (0, 5, 7):
            d = sorted((1 - v[q] @ v[i] / np.linalg.norm(v[q]) / np.linalg.norm(v[i]), i) for i in range(200) if i not in (10, 11))
            assert [r["id"] for r in got if r["query_id"] == q] == [i for _, i in d[:4]]


def test_fusion_modes(spark):
    v = frame(spark, [(0, 1, 1), (0, 2, 2)], "query_id bigint, id bigint, rank int")
    t = frame(spark, [(0, 2, 1), (0, 9, 2)], "query_id bigint, id bigint, rank int")
    assert [r["id"] for r in search.fuse(v, t).orderBy("rank").collect()] == [2, 1]
    assert {r["id"] for r in search.fuse(v, t, mode="union").collect()} == {1, 2, 9}


def test_mmr(spark):
    assert search.mmr_order(np.array([1.0, 0.9, 0.5]), np.array([[1.0, 0], [1.0, 0], [0, 1.0]]), 2, 0.5) == [0, 2]
    rows = [(0, "cat dog", i, t, [1.0, float(i)], i) for i, t in enumerate(["cat", "dog cat", "x"])]
    c = frame(spark, rows, "query_id bigint, question string, id bigint, text string, embedding array<double>, rank int")
    assert [r["id"] for r in search.mmr_rerank(c, 5).orderBy("rank").collect()] == [1, 0, 2]
    assert search.mmr_rerank(c, 2).count() == 2


def test_index_upsert_tail_delete(spark, tmp_path):
    index = Index(spark, str(tmp_path / "ix"), 4)
    chunk = "source_doc_id string, chunk_index int, text string"
    index.upsert_chunks(frame(spark, [("a", i, f"old {i}") for i in range(3)] + [("b", 0, "keep")], chunk))
    before = {r["chunk_index"]: r["id"] for r in index.chunks_of("a").collect()}
    index.upsert_chunks(frame(spark, [("a", 0, "new"), ("a", 1, "new two")], chunk))
    rows = index.chunks_of("a").collect()
    assert [r["text"] for r in rows] == ["new", "new two"] and rows[0]["id"] == before[0]  # no stale tail, ids stay
    assert rows[0]["section_path"] == ["General"] and list(rows[0]["embedding"]) == [0.0] * 4 and rows[1]["word_count"] == 2
    index.upsert_chunks(frame(spark, [], chunk))
    assert index.chunks.count() == 3
    index.upsert_chunk(frame(spark, [("a", 1, "single")], chunk))
    assert [r["text"] for r in index.chunks_of("a").collect()] == ["new", "single"]
    assert index.delete_chunks("a") == 2 and index.delete_chunks("a") == 0
    index.upsert_documents(frame(spark, [("T", ["x"], "s" * 2000, "f.txt")], "title string, tags array<string>, text_summary string, source_file string"))
    d = index.documents.first()
    assert len(d["text_summary"]) == 1000 and d["embedding"] is None
    assert index.delete_document("f.txt") and not index.delete_document("f.txt")


def test_answers(spark):
    from docloom.config import Config

    config = Config(embedding_mode="hash", embedding_dim=32)
    from pyspark.sql import functions as F

    from docloom.functions import vectors as vx

    chunks = frame(spark, [(i, t, f"d{i}", ["General"], 3) for i, t in enumerate(CORPUS)], "id bigint, text string, source_doc_id string, section_path array<string>, word_count int").withColumn("embedding", vx.hash_embedding(F.col("text"), 32).cast("array<float>"))
    documents = frame(spark, [("f", "T", "summary")], "source_file string, title string, text_summary string").withColumn("embedding", vx.hash_embedding(F.col("text_summary"), 32).cast("array<float>"))
    asked = frame(spark, [(0, "where is the cat")], "query_id bigint, question string")
    r = answer.answer(asked, chunks, documents, 3, config=config).first()
    assert r["answer"] and r["context"].startswith("[Chunk 1 (source: ") and len(r["sources"]) == 3
    none = answer.answer(asked, chunks.limit(0), documents.limit(0), 3, config=config).first()
    assert none["answer"] == answer.NOTHING and none["sources"] == []


def test_questions_are_embedded_once(spark):
    from docloom.config import Config

    calls = spark.sparkContext.accumulator(0)

    def make():
        def embed(texts):
            calls.add(len(texts))
            return [[float(len(t)), 1.0, 0.5, 0.25] for t in texts]

        return embed

    config = Config(embedding_dim=4, llm_endpoint="http://x")
    chunks = frame(spark, [(i, t, f"d{i}", ["General"], 3, [1.0, float(i), 0.0, 0.0]) for i, t in enumerate(CORPUS)], "id bigint, text string, source_doc_id string, section_path array<string>, word_count int, embedding array<float>")
    documents = frame(spark, [("f", "T", "summary", [1.0, 0.0, 0.0, 0.0])], "source_file string, title string, text_summary string, embedding array<float>")
    asked = frame(spark, [(i, f"where is the cat {i}") for i in range(10)], "query_id bigint, question string")
    got = answer.answer(asked, chunks, documents, 3, config=config, embedder=make)
    assert got.count() == 10 and len(got.collect()) == 10 and calls.value == 10
    # candidates without a vector get one before they are re-ranked
    filled = answer.with_vectors(chunks.selectExpr("id", "text", "IF(id = 2, array(0f, 0f, 0f, 0f), IF(id = 3, null, embedding)) AS embedding"), config, make).collect()
    assert calls.value == 12 and {r["id"]: list(r["embedding"])[0] for r in filled}[2] == float(len(CORPUS[2]))


def test_texts_are_tokenised_once(spark):
    docs = frame(spark, list(enumerate(CORPUS)), "id bigint, text string")
    q = frame(spark, [(0, "cat dog")], "query_id bigint, question string")
    plan = search.bm25(search.text_index(docs), q)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan  # they are read from the written index


def test_index_is_changed_in_one_step(spark, tmp_path):
    import os

    index = Index(spark, str(tmp_path / "ix"), 4, buckets=3)
    chunk = "source_doc_id string, chunk_index int, text string"
    doc = "title string, text_summary string, source_file string"
    index.replace(frame(spark, [("a", 0, "one"), ("a", 0, "two"), ("b", 0, "x")], chunk), frame(spark, [("T", "s", "a"), ("U", "t", "a")], doc))
    assert index._state()["number"] == 1  # one pointer for both tables
    assert sorted(r["text"] for r in index.chunks.collect()) == ["two", "x"] and index.documents.count() == 1  # repeated keys count once
    old = index.chunks
    for i in range(4):
        index.upsert_chunks(frame(spark, [("a", 0, f"v{i}")], chunk))
        if i == 0:
            assert sorted(r["text"] for r in old.collect()) == ["two", "x"]  # a reader of the state before goes on
    assert sorted(r["text"] for r in index.chunks.collect()) == ["v3", "x"]
    leaves = [d for d, _, _ in os.walk(tmp_path / "ix") if "_b=" in d and "chunks-" in d]
    assert len(leaves) <= 4 and len(os.listdir(tmp_path / "ix" / "pointers")) <= 4
    again = Index(spark, str(tmp_path / "ix"), 4)
    assert again.chunks.count() == 2 and again.delete_chunks("b") == 1 and [r["text"] for r in again.chunks.collect()] == ["v3"]
