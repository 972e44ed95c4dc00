"""Small literal tables for what the data tables don't hold (markdown, CJK, messy text), the same in Spark and SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

CJK_TEXTS = [
    (-1, "机器学习 is 有趣的 topic 2024"),
    (-2, "日本語のテキスト and English words"),
    (-3, "ab中cd 12"),
    (-4, ""),
    (-5, "全文都是中文没有其他字符"),
    (-6, "Plain English only, with numbers 42 and 7."),
    (-7, "a\x01b\x0bc\td   \n\n\n\n--- PAGE 1 ---\n*** 12 ***\n---\nlast  line  "),
]
MARKDOWN = [
    ("m1", "# Guide\n\nIntro text.\n\n## Setup\n\nInstall it.\n\n### Linux\n\nUse apt.\n\n## Use\n\nRun it."),
    ("m2", "No heading at all.\nSecond line."),
    ("m3", "## Only second\n\nBody.\n\n## References\n\n1. A paper."),
    ("m4", "# One\n## Two\n### Three\nBody under three.\n# Four\nBody under four."),
]
#: The chunks of MARKDOWN: source_doc_id, chunk_index, text, section_path.
MARKDOWN_CHUNKS = [
    ("m1", 0, "# Guide\n\nIntro text.", "Guide"),
    ("m1", 1, "## Setup\n\nInstall it.", "Setup"),
    ("m1", 2, "### Linux\n\nUse apt.", "Setup/Linux"),
    ("m1", 3, "## Use\n\nRun it.", "Use"),
    ("m2", 0, "No heading at all.\nSecond line.", "General"),
    ("m3", 0, "## Only second\n\nBody.", "Only second"),
    ("m3", 1, "## References\n\n1. A paper.", "References"),
    ("m4", 0, "### Three\nBody under three.", "Two/Three"),
    ("m4", 1, "# Four\nBody under four.", "Four"),
]
TITLES = [
    (1, "References"),
    (2, "3. References"),
    (3, "References (2024)"),
    (4, "Reference Architecture"),
    (5, "Bibliography:"),
    (6, "Further reading"),
    (7, "参考文献"),
    (8, "三、参考文献（三）"),
    (9, "系统引用说明"),
    (10, "See also"),
    (11, "Sources of income"),
    (12, "EXTERNAL LINKS"),
    (13, "Introduction"),
]
ENTITIES = [(-1, "机器学习"), (-1, "Topic"), (-2, "english"), (-2, "word"), (-3, "中"), (-6, "English only"), (-6, "42"), (-6, "C++")]
PATHS = ["a/b.PDF", "a_b.docx", "x.html", "y.htm", "z.md", "z.mkd", "t.txt", "noext", "deep/er/file.epub", "a\\b.md"]
NAMES = ["a/b:c*d?", '  "quoted" <name> | x ', "", "   ", "日本語", "x" * 230]
RESULTS = [
    (1, "Good", ["one topic", "two"], [("A", "ORG")], "Body"),
    (2, "", ["x"], [("A", "PLACE")], "Body"),
    (3, "T" * 201, [], [], " "),
    (4, "Title", ["a", "b", "c", "d", "e", "f"], [], "Body"),
    (5, "Title", ["ok", " "], [], "Body"),
    (6, None, None, [], None),
]
TAGS = [
    (1, ["testing", "CNCC", "payment systems", "abc", "python", "management", "x1y", "AI", "kindness"]),
    (2, ["ab", "Nation", "deep learning", "GPT-4"]),
    (3, []),
]
CHUNK_SETS = [("m1", 0, "old a"), ("m1", 1, "old b"), ("m1", 2, "old c"), ("m2", 0, "keep 中文 me"), ("m3", 0, "old d")]
NEW_CHUNKS = [("m1", 0, "new a"), ("m1", 1, "new b"), ("m4", 0, "fresh one two")]


def literal(value) -> str:
    """A value as a DuckDB literal."""
    if value is None:
        return "NULL"
    if isinstance(value, str):
        body = value.replace("'", "''")
        plain = all(c >= " " for c in value)
        return f"'{body}'" if plain else "(" + " || ".join(f"chr({ord(c)})" if c < " " else "'" + c.replace("'", "''") + "'" for c in value) + ")"
    if isinstance(value, list):
        return "[" + ", ".join(map(literal, value)) + "]"
    if isinstance(value, tuple):
        return "{" + f"'name': {literal(value[0])}, 'type': {literal(value[1])}" + "}"
    return str(value)


def values(rows: list, columns: str) -> str:
    """A literal table as a DuckDB subquery."""
    shown = ", ".join("(" + ", ".join(map(literal, r if isinstance(r, tuple) else (r,))) + ")" for r in rows)
    return f"(SELECT * FROM (VALUES {shown}) AS v({columns}))"


def frame(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    return spark.createDataFrame([r if isinstance(r, tuple) else (r,) for r in rows], schema)
