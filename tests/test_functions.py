"""Scalar functions against values worked out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from docloom.config import Config, load_config
from docloom.errors import ChunkingError, ConfigError
from docloom.functions import text as tx
from docloom.functions import vectors as vx
from docloom.operators import chunking, cleaning, formatting, markdown


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


def test_counts_words_and_cjk(spark):
    got = [one(spark, tx.count_words(F.col("t")), t=t) for t in ("ab中cd 12", "a b  c", "中文", "x　y")]
    assert got == [3, 3, 2, 2]  # CJK is deleted before words are counted; the ideographic space separates


def test_threshold_has_constant_token_budget(spark):
    assert one(spark, tx.effective_threshold(F.col("t")), t="abc") == 20000
    assert one(spark, tx.effective_threshold(F.col("t")), t="中文") == 5000


def test_clean(spark):
    t = "a\x01b\tc  \r\n--- PAGE 1 ---\n---\n\n\n\nend\n"
    assert one(spark, tx.clean(F.col("t")), t=t) == "ab c\n---\n\nend"


def test_tables_lose_no_cell():
    assert cleaning.mend_tables("| a | b | c |\n| d |\n| e |") == "| a | b | c d e |"


def test_rules(spark, tmp_path):
    f = tmp_path / "r.yaml"
    f.write_text("rules:\n  - {pattern: '^x(\\d)', replace: '<\\1>', flags: MULTILINE}\n  - {pattern: '(', replace: ''}\n")
    assert one(spark, cleaning.apply_rules(F.col("t"), cleaning.load_rules(f)), t="x1\nx2 x3") == "<1>\n<2> x3"
    assert cleaning.load_rules(tmp_path / "none.yaml") == []


@pytest.mark.parametrize(("title", "want"), [("References", True), ("3. References (2024)", True), ("Reference Architecture", False), ("参考文献（三）", True), ("系统引用说明", False)])
def test_reference_titles(spark, title, want):
    assert one(spark, tx.is_reference_title(F.col("t")), t=title) is want
    assert markdown.is_reference(title) is want


def test_strip_references():
    md = "# T\nbody\n## References\n1. x\n### deep\ny\n## Next\nz\n```\n## References\n```"
    assert markdown.strip_references(md) == "# T\nbody\n## Next\nz\n```\n## References\n```"


def test_normalize():
    got = markdown.normalize("Overview\ntext with https://a.b/c. And\n\n1) one\n* two\n|a|b|\n\n```\nhttps://x.y\n```\n**bold")
    assert got.startswith("## Overview\n")
    assert "[https://a.b/c](https://a.b/c)." in got and "1. one" in got and "- two" in got and "| a | b |" in got
    assert "\nhttps://x.y\n" in got and got.endswith("\n\n**")
    assert markdown.normalize(" \n") == ""
    assert "## ---" not in markdown.normalize("a\n\n---\n\nb.")


def test_headings_setext_fences_quotes():
    text = "Top\n===\n\n```\n# no\n```\n> ## quoted ##\n\nSub\n---\nx"
    assert [(h[1], h[2]) for h in markdown.headings(text.split("\n"))] == [(1, "Top"), (2, "quoted"), (2, "Sub")]


def test_sections_keep_hierarchy():
    got = markdown.sections("# A\n## B\n### C\nbody\n## D\nmore")
    assert [s["metadata"] for s in got] == [{"H1": "A", "H2": "B", "H3": "C"}, {"H1": "A", "H2": "D"}]
    assert markdown.path_of(got[0]["metadata"]) == ["B", "C"] and markdown.path_of({}) == ["General"] and markdown.path_of({"H1": "A"}) == ["A"]


def test_wikilinks_longest_first_outside_code_and_links():
    got = markdown.wikilinks("New York and York, `York`, [York](u), [[York]]", ["York", "New York"])
    assert got == "[[New York]] and [[York]], `York`, [York](u), [[York]]"


def test_front_matter_round_trip():
    md = markdown.format_markdown({"title": "T: x", "tags": ["a", "b"], "metadata": {"total_words": 3, "sections": [{"level": 2, "title": "S"}]}, "body": "# T: x\n## S\nbody"})
    assert markdown.front_matter_tags(md) == ["a", "b"] and markdown.front_matter(md)["title"] == "T: x"
    assert markdown.without_front_matter(md).strip().startswith("# T: x\n\n- **Words:** 3")
    assert markdown.front_matter("---\n[bad\n---\nx") == {} and markdown.front_matter("x") == {}


def test_sentences():
    assert chunking.sentences("Mr. Smith paid 3.14 dollars. He left. v2.0 is out") == ["Mr. Smith paid 3.14 dollars.", "He left.", "v2.0 is out"]
    assert chunking.sentences("你好。再见！") == ["你好。", "再见！"]


@pytest.mark.parametrize("size", [40, 100, 300])
def test_chunks_fit_and_lose_nothing(size):
    text = "# H\n\n" + " ".join(f"Sentence number {i} is here." for i in range(30)) + "\n\n" + "x" * 500 + " tail. Last one."
    got = chunking.chunk_markdown(text, size, 0)
    assert all(len(c["text"]) <= size for c in got)
    assert [c["chunk_index"] for c in got] == list(range(len(got)))
    joined = "".join("".join(c["text"].split()) for c in got)
    assert joined == "".join(text.split())
    lapped = chunking.chunk_markdown(text, size, 20)
    assert all(len(c["text"]) <= size for c in lapped)


def test_chunk_parameters():
    with pytest.raises(ChunkingError):
        chunking.check_sizes(0, 1)
    assert chunking.check_sizes(100, 64) == (100, 25)
    assert chunking.chunk_markdown(None) == [] and chunking.chunk_markdown("  ") == []


def test_paragraph_groups():
    got = chunking.split_paragraphs("a" * 30 + "\n\n" + "b" * 30 + "\n\n" + "One two. " * 20, 70)
    assert got[0] == "a" * 30 + "\n\n" + "b" * 30 and all(len(g) <= 70 for g in got)


def test_replies():
    assert formatting.parse_reply('```json\n{"a": 1}\n```') == {"a": 1}
    assert formatting.parse_reply('Sure: {"a": "}"} ok') == {"a": "}"}
    assert formatting.parse_reply("no json") is None
    assert formatting.parse_reply('{"title": "t", "body": "say "hi" now"}') == {"title": "t", "body": 'say "hi" now'}
    assert formatting.parse_reply('{"body": "a\nb"}') == {"body": "a\nb"}
    assert formatting.escape_body_quotes('{"body": "fine"}') is None
    assert formatting.problems({"title": "t", "tags": ["a"], "body": "b"}) == []
    assert len(formatting.problems({})) == 3


def test_tags_are_fixed(spark):
    got = one(spark, formatting.fixed_tags(F.col("t")), t=["testing", "AI", "abc", "deep learning", "x1"])
    assert got == ["AI", "deep learning", "x1"]


def test_vectors(spark):
    assert one(spark, vx.cosine(F.col("a"), F.col("b")), a=[1.0, 0.0], b=[1.0, 1.0]) == pytest.approx(1 / math.sqrt(2))
    assert one(spark, vx.cosine(F.col("a"), F.col("b")), a=[0.0], b=[1.0]) == 0.0
    h = one(spark, vx.hash_embedding(F.col("t"), 64), t="x")
    assert len(h) == 64 and h[:32] == h[32:] and all(-1 <= v <= 1 for v in h)
    assert one(spark, vx.parsed_vector(F.col("t")), t="1, 2.5") == [1.0, 2.5] and one(spark, vx.parsed_vector(F.col("t")), t="1,x") == []


def test_lexical_score(spark):
    assert one(spark, tx.lexical_score(F.col("q"), F.col("t")), q="the the cat 中", t="The cat sat") == pytest.approx(0.5)
    assert one(spark, tx.lexical_score(F.col("q"), F.col("t")), q="1 ?", t="x") == 0.0


def test_config(tmp_path):
    f = tmp_path / "c.yaml"
    f.write_text("llm: {model: m}\nchunk_size: 99\n")
    assert load_config(f).llm_model == "m" and load_config(f).chunk_size == 99
    with pytest.raises(ConfigError):
        Config(chunk_size=0).checked()
