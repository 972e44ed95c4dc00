"""Files to index, markdown files, models, streams, SQL functions."""

import io
import json
import zipfile

from pyspark.sql import functions as F

from docloom import cli, sqlfuncs
from docloom.config import Config
from docloom.operators import formatting, tags
from docloom.operators.embedding import embed_column
from docloom.plans import ingest
from docloom.plans.store import Index
from docloom.sources import files
from docloom.streaming.ingest import ingest_stream, stream_documents

SMALL = Config(embedding_mode="hash", embedding_dim=16, chunk_size=200, chunk_overlap=20)


def docx(*paragraphs):
    out = io.BytesIO()
    body = "".join(f'<w:p>{f"<w:pPr><w:pStyle w:val=\"{s}\"/></w:pPr>" if s else ""}<w:r><w:t>{t}</w:t></w:r></w:p>' for s, t in paragraphs)
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="w"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def folder(tmp_path):
    root = tmp_path / "in"
    (root / "deep").mkdir(parents=True)
    (root / "a.txt").write_text("First paragraph about cats.\n\nSecond paragraph about dogs.")
    (root / "deep" / "B.MD").write_text("# Title B\n\nBody of b.\n\n## References\n\n1. none")
    (root / "c.html").write_text("<html><head><title>x</title></head><body><nav>menu</nav><article><h1>Head</h1><p>Text one.<p>Text two.<table><tr><td>a</td><td>b</td></tr></table></article><div class='ad'>buy</div></body></html>")
    (root / "d.docx").write_bytes(docx(("Heading1", "Doc head"), ("", "Doc text")))
    (root / "bad.docx").write_bytes(b"nonsense")
    (root / "e.pdf").write_bytes(b"%PDF")
    (root / "f.xyz").write_text("ignored")
    return root


def test_read_folder(spark, tmp_path):
    rows = {r["source_file"]: r for r in files.read_documents(spark, str(folder(tmp_path))).collect()}
    assert set(rows) == {"a.txt", "deep/B.MD", "c.html", "d.docx", "bad.docx", "e.pdf"}
    assert rows["deep/B.MD"]["doc_id"] == "deep_B.MD"
    assert rows["c.html"]["text"] == "# Head\n\nText one.\n\nText two.\n\n| a | b |"
    assert rows["d.docx"]["text"] == "# Doc head\n\nDoc text"
    assert rows["bad.docx"]["status"] == "failed" and rows["e.pdf"]["error"].startswith("ParserNotFoundError")


def test_folder_to_index_and_answer(spark, tmp_path, capsys):
    index = Index(spark, str(tmp_path / "ix"), 16)
    state = ingest.ingest_folder(spark, str(folder(tmp_path)), index, SMALL).collect()
    assert {r["source_file"] for r in state if r["status"] == "failed"} == {"bad.docx", "e.pdf"}
    texts = [r["text"] for r in index.chunks.collect()]
    assert any("cats" in t for t in texts) and not any("References" in t for t in texts)
    docs = {r["source_file"]: r for r in index.documents.collect()}
    assert docs["deep/B.MD"]["title"] == "Title B" and docs["deep/B.MD"]["total_chunks"] >= 1
    again = index.chunks.count()
    ingest.ingest_folder(spark, str(tmp_path / "in"), index, SMALL)
    assert index.chunks.count() == again  # idempotent


def test_markdown_files_and_reingest(spark, tmp_path):
    docs = spark.createDataFrame([("1", "a.txt", "# Same\n\none"), ("2", "b.txt", "# Same\n\ntwo")], "doc_id string, source_file string, text string")
    out = ingest.to_markdown(docs)
    assert sorted(r["file_name"] for r in out.collect()) == ["Same-1.md", "Same.md"]
    ingest.write_markdown(out, str(tmp_path / "md"))
    chunks, documents = ingest.ingest_markdown(files.read_documents(spark, str(tmp_path / "md")), SMALL)
    assert {r["title"] for r in documents.collect()} == {"Same"} and chunks.count() >= 2
    assert not any(r["text"].startswith("---") for r in chunks.collect())


def test_model_path(spark):
    def fake_model():
        def call(system, prompt):
            if "one part" in system:
                return json.dumps({"part_md": "# Long title\n\n## Part\n\n" + prompt[-40:], "summary": "s"})
            if "boom" in prompt:
                raise RuntimeError("down")
            return json.dumps({"title": "T", "tags": ["testing", "Alpha Beta"], "metadata": {"entities": [{"name": "Alpha", "type": "ORG"}]}, "body": "Alpha is here."})

        return call

    long = "\n\n".join("Deep Learning works well. " * 8 for _ in range(6))
    docs = spark.createDataFrame([("1", "a.txt", "Alpha"), ("2", "b.txt", "boom"), ("3", "c.txt", long)], "doc_id string, source_file string, text string")
    config = Config(embedding_mode="hash", embedding_dim=8, chunk_threshold_chars=300)
    rows = {r["doc_id"]: r for r in ingest.formatted(docs, config, fake_model).collect()}
    assert rows["1"]["tags"] == ["Alpha Beta"] and rows["2"]["status"] == "failed" and "down" in rows["2"]["error"]
    assert rows["3"]["title"] == "Long title" and rows["3"]["tags"] and [s["title"] for s in rows["3"]["sections"]][0] == "Part"
    chunks, _ = ingest.build_index(docs, config, fake_model)
    assert any(r["entity_names"] == ["Alpha"] for r in chunks.collect())


def test_tags(spark):
    d = spark.createDataFrame([(1, "Payment network", "Hidden Markov models and Hidden Markov chains. sequence sequence sequence labels"), (2, "", "")], "doc_id bigint, title string, body string")
    got = {r["doc_id"]: r["tags"] for r in tags.extract_tags(d).collect()}
    assert got[1][0] == "hidden markov" and "sequence" in got[1] and "network" not in got[1] and got[2] == []


def test_embedding_adapter(spark):
    calls = spark.sparkContext.accumulator(0)

    def make():
        def embed(texts):
            calls.add(len(texts))
            if any("bad" in t for t in texts):
                raise RuntimeError
            return [[float(len(t)), 1.0] for t in texts]

        return embed

    d = spark.createDataFrame([("aa",), ("aa",), ("bbb",), (None,)], "text string")
    got = embed_column(d, config=Config(embedding_dim=2), factory=make).collect()
    assert sorted((r["text"] or "", list(r["embedding"] or [])) for r in got) == [("", []), ("aa", [2.0, 1.0]), ("aa", [2.0, 1.0]), ("bbb", [3.0, 1.0])]
    assert calls.value == 2  # each distinct text once
    bad = spark.createDataFrame([("bad",)], "text string")
    assert len(embed_column(bad, config=Config(embedding_dim=2, hash_fallback=True), factory=make).first()["embedding"]) == 2


def test_stream(spark, tmp_path):
    src = str(tmp_path / "src")
    spark.createDataFrame([("1", "a", "# A\n\ntext"), ("2", "b", "plain text")], "doc_id string, source_file string, text string").write.parquet(src)
    index = Index(spark, str(tmp_path / "ix"), 16)
    ingest_stream(stream_documents(spark, src), index, str(tmp_path / "cp"), SMALL, once=True).awaitTermination()
    spark.createDataFrame([("2", "b", "changed text")], "doc_id string, source_file string, text string").write.mode("append").parquet(src)
    ingest_stream(stream_documents(spark, src), index, str(tmp_path / "cp"), SMALL, once=True).awaitTermination()
    assert {r["source_doc_id"] for r in index.chunks.collect()} == {"1", "2"}
    assert any("changed" in r["text"] for r in index.chunks_of("2").collect()) and index.documents.count() == 2


def test_sql_functions(spark):
    assert "chunk_markdown" in sqlfuncs.register(spark)
    spark.createDataFrame([(1, "# A\n\nbody")], "id bigint, md string").createOrReplaceTempView("mds")
    assert spark.sql("SELECT normalize_markdown('1) x') AS t").first()["t"] == "1. x"
    assert spark.sql("SELECT c.section_path FROM mds, LATERAL chunk_markdown(md, 100, 10) c").first()["section_path"] == ["A"]


def test_cli(spark, tmp_path, capsys):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "a.txt").write_text("Cats sleep. Dogs bark.")
    assert cli.main(["chunk", str(tmp_path / "x")], spark) == 0
    assert "Cats sleep" in capsys.readouterr().out


def test_running_summary(spark):
    d = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, 3, None)], "doc_id int, part int, summary string")
    assert [r["so_far"] for r in formatting.running_summary(d).orderBy("part").collect()] == ["", "a ", "a b "]


def test_format_result_schema(spark):
    d = spark.createDataFrame([('{"title": "t", "body": "b"}',)], "raw string")
    assert d.select(F.size(formatting.problems_column(F.col("raw"))).alias("n")).first()["n"] == 1


def counting_model(calls):
    def make():
        def call(system, prompt):
            calls.add(1)
            return json.dumps({"title": "T" + prompt[-3:], "tags": ["Alpha Beta"], "metadata": {"entities": []}, "body": "Body of " + prompt[-3:]})

        return call

    return make


def test_model_is_called_once_a_document(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)
    docs = spark.createDataFrame([(str(i), f"{i}.txt", f"Text number {i:03d}") for i in range(20)], "doc_id string, source_file string, text string")
    index = Index(spark, str(tmp_path / "ix"), 16)
    cache = str(tmp_path / "cache")
    for rounds in range(2):
        index.replace(*ingest.build_index(docs, SMALL, counting_model(calls), cache=cache))
        assert calls.value == 20, rounds  # the second time all replies are kept ones
    assert index.documents.count() == 20 and index.chunks.count() == 20
    index.replace(*ingest.build_index(docs, SMALL, counting_model(calls)))
    assert calls.value == 40
    twice = docs.union(docs.withColumn("doc_id", F.concat(F.lit("x"), "doc_id")))
    assert ingest.formatted(twice, SMALL, counting_model(calls)).count() == 40 and calls.value == 60  # each distinct text once


def test_existing_markdown_is_not_formatted(spark):
    calls = spark.sparkContext.accumulator(0)
    docs = spark.createDataFrame([("1", "a.txt", "Plain 001", None), ("2", "b.txt", "ignored", "---\ntags:\n  - kept\n---\n# Head\n\nOld body")], "doc_id string, source_file string, text string, markdown string")
    rows = {r["doc_id"]: r for r in ingest.formatted(docs, SMALL, counting_model(calls)).collect()}
    assert calls.value == 1 and rows["2"]["title"] == "Head" and "Old body" in rows["2"]["body"] and rows["1"]["title"] == "T001"
    chunks, documents = ingest.build_index(docs, SMALL)
    assert {r["title"] for r in documents.collect()} >= {"Head"} and any("Old body" in r["text"] for r in chunks.collect())


def test_written_markdown_is_reused(spark, tmp_path):
    from pathlib import Path

    docs = [("1", "a.txt", "# Same\n\none"), ("2", "b.txt", "# Same\n\ntwo"), ("3", "c.txt", "# Other\n\nx")]
    out = str(tmp_path / "md")
    frame = lambda rows: spark.createDataFrame(rows, "doc_id string, source_file string, text string")
    names = lambda: sorted(x.name for x in Path(out).iterdir() if x.suffix == ".md")
    for _ in range(2):
        ingest.write_markdown(ingest.to_markdown(frame(docs)), out)
        assert names() == ["Other.md", "Same-1.md", "Same.md"]
    before = {n: (Path(out) / n).read_text() for n in names()}
    ingest.write_markdown(ingest.to_markdown(frame([("9", "z.txt", "# Same\n\nthree"), docs[0]])), out)
    assert len(names()) == 4 and all((Path(out) / n).read_text() == t for n, t in before.items())
    assert "three" in (Path(out) / "Same-2.md").read_text()


def test_numbers_in_one_large_group(spark):
    keys = spark.range(1000).select(F.when(F.col("id") % 10 == 0, F.concat(F.lit("g"), F.col("id") % 7)).otherwise("same").alias("_name"), F.col("id").alias("doc_id")).repartition(7)
    got = ingest.numbered_in_groups(keys, "_name", "doc_id").collect()
    by = {}
    for r in sorted(got, key=lambda r: r["doc_id"]):
        assert r["_n"] == by.get(r["_name"], 0)
        by[r["_name"]] = r["_n"] + 1
    assert by["same"] == 900 and len(got) == 1000


def test_rules_of_the_configuration(spark, tmp_path):
    (tmp_path / "rules.yaml").write_text("rules:\n  - pattern: 'secret\\d+'\n    replace: 'X'\n")
    config = Config(embedding_mode="hash", embedding_dim=8, clean_rules=str(tmp_path / "rules.yaml"))
    docs = spark.createDataFrame([("1", "a.txt", "a secret42 here")], "doc_id string, source_file string, text string")
    assert "X here" in ingest.formatted(docs, config).first()["body"]
    deep = Config(embedding_mode="hash", embedding_dim=8, heading_levels=1)
    chunks, _ = ingest.build_index(docs.withColumn("text", F.lit("# A\n\none\n\n## B\n\ntwo")), deep)
    assert chunks.count() == 1


def test_schema_is_dropped_where_it_is_rejected():
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    seen = []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            seen.append("response_format" in asked)
            body = b"this grammar can not be parsed" if seen[-1] else json.dumps({"choices": [{"message": {"content": "{}"}}]}).encode()
            self.send_response(500 if seen[-1] else 200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    model = formatting.http_model(Config(llm_endpoint=f"http://127.0.0.1:{server.server_port}/v1"))()
    assert model(formatting.SYSTEM_PROMPT, "x") == "{}" and model(formatting.SYSTEM_PROMPT, "y") == "{}" and model("part", "z") == "{}"
    assert seen == [True, False, False, False]
    server.shutdown()


def test_batches_are_bounded():
    from docloom.operators.embedding import batches_of

    assert [*batches_of([1] * 10, 4)] == [(0, 4), (4, 8), (8, 10)]
    assert [*batches_of([9000] * 9, 32)] == [(0, 4), (4, 8), (8, 9)]
    assert [*batches_of([], 4)] == []
