"""The registered queries of the library's operators, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.config import Config
from docloom.functions import text as tx
from docloom.functions import vectors as vx
from docloom.operators import chunking, cleaning, formatting, markdown, search, tags
from docloom.operators.kernels import kernel
from docloom.plans import answer, fixtures, ingest, store
from docloom.plans.fixtures import frame, values
from docloom.sources import files
from docloom.staging import library, spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

C = r"[\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{20000}-\x{2A6DF}\x{2A700}-\x{2EBEF}\x{3040}-\x{309F}\x{30A0}-\x{30FF}]"
HAN = r"[\x{4E00}-\x{9FFF}]"
TEXTS = f"(SELECT doc_id, text FROM documents UNION ALL SELECT CAST(doc_id AS BIGINT), text FROM {values(fixtures.CJK_TEXTS, 'doc_id, text')})"


def n(pattern: str, text: str = "text") -> str:
    return f"len(regexp_extract_all({text}, '{pattern}'))"


def query(sql: str | None = None):
    def add(fn: Callable[[SparkSession, str], DataFrame]):
        name = fn.__name__.lstrip("_")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf}/{name}.parquet")
    return spread(rows) if name in ("documents", "pages") else rows


def texts(spark: SparkSession, sf: str) -> DataFrame:
    """All documents and the literal texts."""
    return table(spark, sf, "documents").select("doc_id", "text").unionByName(frame(spark, fixtures.CJK_TEXTS, "doc_id bigint, text string"))


def _text() -> Column:
    return F.col("text")

# -- counting


@query(f"SELECT doc_id, CAST({n(C)} + {n(r'[^ \t\n\x0b\f\r]+', f"regexp_replace(text, '{C}', '', 'g')")} AS INTEGER) AS words FROM {TEXTS}")
def count_words(spark, sf):
    return texts(spark, sf).select("doc_id", tx.count_words(_text()).cast("int").alias("words"))


@query(f"SELECT doc_id, CAST({n(r'[^ \t\n\x0b\f\r]+')} AS INTEGER) AS words FROM {TEXTS}")
def ws_word_count(spark, sf):
    return texts(spark, sf).select("doc_id", tx.whitespace_words(_text()).cast("int").alias("words"))


RATIO = f"(CASE WHEN {n(C)} + {n('[A-Za-z0-9]')} > 0 THEN CAST({n(C)} AS DOUBLE) / ({n(C)} + {n('[A-Za-z0-9]')}) ELSE 0.0 END)"


@query(f"SELECT doc_id, round({RATIO}, 9) AS ratio FROM {TEXTS}")
def cjk_ratio(spark, sf):
    return texts(spark, sf).select("doc_id", F.round(tx.cjk_ratio(_text()), 9).alias("ratio"))


@query(f"SELECT doc_id, CAST(CASE WHEN r <= 0 THEN 20000 ELSE greatest(1, trunc(5000.0::DOUBLE / (r + (1 - r) / 4.0::DOUBLE))) END AS INTEGER) AS threshold FROM (SELECT doc_id, {RATIO} AS r FROM {TEXTS})")
def effective_threshold(spark, sf):
    return texts(spark, sf).select("doc_id", tx.effective_threshold(_text()).cast("int").alias("threshold"))


@query(f"SELECT doc_id, CASE WHEN h + a > 0 AND CAST(h AS DOUBLE) / (h + a) > 0.15 THEN 'cjk' ELSE 'latin' END AS script FROM (SELECT doc_id, {n(HAN)} AS h, {n('[A-Za-z]')} AS a FROM {TEXTS})")
def script_detect(spark, sf):
    return texts(spark, sf).select("doc_id", tx.script(_text()).alias("script"))


@query(f"SELECT doc_id, CAST(h + a // 4 + (length(text) - h - a) // 2 AS INTEGER) AS tokens FROM (SELECT doc_id, text, {n(HAN)} AS h, {n('[A-Za-z0-9]')} AS a FROM {TEXTS})")
def token_estimate(spark, sf):
    return texts(spark, sf).select("doc_id", tx.token_estimate(_text()).alias("tokens"))


# -- cleaning

_SP = r"[ \t\n\r\f\x0b]"


CLEANED = (
    f"""
WITH control AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]', '', 'g') AS t FROM {TEXTS}),
kept AS (SELECT doc_id, array_to_string(list_filter(string_split(CASE WHEN t LIKE '%' || chr(10) THEN t[:-2] ELSE t END, chr(10)),
  lambda x: NOT (length(trim(x, ' ' || chr(9))) > 8 AND regexp_matches(trim(x, ' ' || chr(9)), '^(?:[-=_*]\\s*){{3,}}[\\pL\\pN_\\s]*?(?:[-=_*]\\s*){{2,}}$'))), chr(10)) AS t FROM control),
spaced AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(t, '[\\t\\x0b\\f]+', ' ', 'g'), ' +(\\n|$)', '\\1', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g') AS t FROM kept)
SELECT doc_id, regexp_replace(regexp_replace(t, '^{_SP}+', ''), '{_SP}+$', '') AS text FROM spaced"""
)


@query(CLEANED)
def clean_text(spark, sf):
    return texts(spark, sf).select("doc_id", tx.clean(_text()).alias("text"))


#: A table whose third row has a cell less, which goes into the last cell of the row above.
_TABLE = "| a | b |\n|---|---|\n| x | y |\n| more |\n\nend"


@query(f"SELECT doc_id, text || chr(10) || chr(10) || '| a | b |' || chr(10) || '|---|---|' || chr(10) || '| x | y more |' || chr(10) || chr(10) || 'end' AS text FROM ({CLEANED}) WHERE text <> '' UNION ALL SELECT doc_id, '| a | b |' || chr(10) || '|---|---|' || chr(10) || '| x | y more |' || chr(10) || chr(10) || 'end' FROM ({CLEANED}) WHERE text = ''")
def clean_with_tables(spark, sf):
    return texts(spark, sf).select("doc_id", cleaning.clean_text(F.concat(F.coalesce(_text(), F.lit("")), F.lit("\n\n" + _TABLE))).alias("text"))




# -- structure


@query("SELECT doc_id, trim(concat('Title: ', 'Document ' || doc_id, chr(10), 'Tags: ', concat_ws(' ', lang, source), chr(10), substr(coalesce(text, ''), 1, 800), CASE WHEN length(text) > 1200 THEN chr(10) || '...' || chr(10) || right(text, 400) ELSE '' END), ' ' || chr(10) || chr(9) || chr(13)) AS summary FROM documents")
def doc_summary(spark, sf):
    d = table(spark, sf, "documents")
    title = F.concat(F.lit("Document "), F.col("doc_id").cast("string"))
    return d.select("doc_id", tx.summary(title, F.filter(F.array("lang", "source"), lambda x: x.isNotNull()), _text()).alias("summary"))


MD = values(fixtures.MARKDOWN, "doc_id, md")
#: The literal texts, and all documents under headings of their source, language and number.
MD_ALL = f"(SELECT * FROM {MD} UNION ALL SELECT CAST(doc_id AS VARCHAR), '# ' || source || chr(10) || '## ' || lang || chr(10) || text || chr(10) || '### Number ' || doc_id || chr(10) || 'end' FROM documents)"


def headed(spark, sf):
    m = frame(spark, fixtures.MARKDOWN, "doc_id string, md string")
    page = F.concat(F.lit("# "), "source", F.lit("\n## "), "lang", F.lit("\n"), "text", F.lit("\n### Number "), F.col("doc_id").cast("string"), F.lit("\nend"))
    return m.unionByName(table(spark, sf, "documents").select(F.col("doc_id").cast("string"), page.alias("md")))


@query(f"SELECT doc_id, coalesce(nullif(trim(regexp_extract(md, '(?m)^#\\s+(.+)$', 1)), ''), 'Untitled') AS title FROM {MD} UNION ALL SELECT CAST(doc_id AS VARCHAR), coalesce(nullif(trim(regexp_extract(text, '(?m)^#\\s+(.+)$', 1)), ''), 'Untitled') FROM documents")
def title_extract(spark, sf):
    m = frame(spark, fixtures.MARKDOWN, "doc_id string, md string")
    d = table(spark, sf, "documents").select(F.col("doc_id").cast("string"), _text().alias("md"))
    return m.unionByName(d).select("doc_id", tx.title_of(F.col("md")).alias("title"))


@query(f"SELECT doc_id, CAST(i AS INTEGER) AS pos, CAST(length(regexp_extract(h, '^(#+)', 1)) AS INTEGER) AS level, trim(regexp_extract(h, '^#+[ \\t]+(.+)$', 1)) AS title FROM (SELECT doc_id, unnest(hs) AS h, unnest(range(1, len(hs) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(md, '(?m)^#{{2,3}}[ \\t]+.+$') AS hs FROM {MD_ALL}))")
def section_outline(spark, sf):
    m = headed(spark, sf)
    return m.select("doc_id", F.posexplode(tx.outline(F.col("md"))).alias("p", "s")).select("doc_id", (F.col("p") + 1).alias("pos"), "s.level", "s.title")


def section_lines(md: DataFrame) -> DataFrame:
    """doc_id, line, text, path: the section path in force at every line, by windows over lines."""
    rows = md.select("doc_id", F.posexplode(F.split("md", "\n", -1)).alias("line", "text"))
    level = F.length(F.regexp_extract("text", r"^(#{1,3})\s+.+$", 1))
    rows = rows.withColumn("level", level).withColumn("head", F.regexp_extract("text", r"^#{1,3}\s+(.+)$", 1))
    upto = Window.partitionBy("doc_id").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # the last heading of a level counts unless a higher one came after it
    for h in (1, 2, 3):
        rows = rows.withColumn(f"at{h}", F.max(F.when(F.col("level") == h, F.col("line"))).over(upto)).withColumn(f"h{h}", F.max_by("head", F.when(F.col("level") == h, F.col("line"))).over(upto))
    high = lambda *at: F.greatest(F.lit(-1), *[F.coalesce(F.col(a), F.lit(-1)) for a in at])
    h2 = F.when(F.col("at2") > high("at1"), F.col("h2"))
    h3 = F.when(F.col("at3") > high("at1", "at2"), F.col("h3"))
    return rows.select("doc_id", "line", "text", tx.section_path(F.col("h1"), h2, h3).alias("path"))


@query(
    f"""
WITH lines AS (SELECT doc_id, unnest(ls) AS text, unnest(range(len(ls))) AS line FROM (SELECT doc_id, string_split(md, chr(10)) AS ls FROM {MD_ALL})),
marked AS (SELECT *, length(regexp_extract(text, '^(#{{1,3}})\\s+.+$', 1)) AS level, regexp_extract(text, '^#{{1,3}}\\s+(.+)$', 1) AS head FROM lines),
w AS (SELECT *, max(CASE WHEN level = 1 THEN line END) OVER u AS at1, max(CASE WHEN level = 2 THEN line END) OVER u AS at2, max(CASE WHEN level = 3 THEN line END) OVER u AS at3,
  last_value(CASE WHEN level = 1 THEN head END IGNORE NULLS) OVER u AS h1, last_value(CASE WHEN level = 2 THEN head END IGNORE NULLS) OVER u AS b2, last_value(CASE WHEN level = 3 THEN head END IGNORE NULLS) OVER u AS b3
  FROM marked WINDOW u AS (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
p AS (SELECT doc_id, line, text, h1, list_filter([h1, CASE WHEN at2 > coalesce(at1, -1) THEN b2 END, CASE WHEN at3 > greatest(coalesce(at1, -1), coalesce(at2, -1)) THEN b3 END], lambda x: x IS NOT NULL) AS hs FROM w)
SELECT doc_id, CAST(line AS INTEGER) AS line, text, array_to_string(CASE WHEN len(hs) = 0 THEN ['General'] WHEN h1 IS NOT NULL AND len(hs) > 1 THEN hs[2:] ELSE hs END, '/') AS path FROM p"""
)
def section_path_windows(spark, sf):
    return section_lines(headed(spark, sf)).withColumn("path", F.array_join("path", "/"))


_REF = tx.REFERENCE_TITLE.replace(r"\b)|", r"\b)|").replace("'", "''")


@query(f"SELECT id, title, regexp_matches(title, '{_REF}') AS is_reference FROM (SELECT CAST(id AS BIGINT) AS id, title FROM {values(fixtures.TITLES, 'id, title')} UNION ALL SELECT 1000 + item_id, text FROM benchmark)")
def reference_title(spark, sf):
    titles = frame(spark, fixtures.TITLES, "id bigint, title string").unionByName(table(spark, sf, "benchmark").select((F.col("item_id") + 1000).alias("id"), _text().alias("title")))
    return titles.select("id", "title", tx.is_reference_title(F.col("title")).alias("is_reference"))


_CITED = f"(SELECT doc_id, md || chr(10) || '## References' || chr(10) || '1. x' || chr(10) || '### Sub' || chr(10) || 'y' || chr(10) || '## After' || chr(10) || 'z' AS t FROM {MD_ALL} WHERE md IS NOT NULL)"


@query(
    f"""WITH ls AS (SELECT doc_id, unnest(ls) AS l, unnest(range(len(ls))) AS i FROM (SELECT doc_id, string_split(t, chr(10)) AS ls FROM {_CITED})),
heads AS (SELECT *, length(regexp_extract(l, '^(#{{1,6}})\\s+.+$', 1)) AS level, trim(regexp_extract(l, '^#{{1,6}}\\s+(.+)$', 1)) AS title FROM ls WHERE regexp_matches(l, '^#{{1,6}}\\s+.+$')),
refs AS (SELECT r.doc_id, r.i, min(h.i) AS until FROM heads r LEFT JOIN heads h ON h.doc_id = r.doc_id AND h.i > r.i AND h.level <= r.level WHERE regexp_matches(r.title, '{_REF}') GROUP BY r.doc_id, r.i)
SELECT doc_id, string_agg(l, chr(10) ORDER BY i) AS md FROM ls WHERE NOT EXISTS (SELECT 1 FROM refs WHERE refs.doc_id = ls.doc_id AND ls.i >= refs.i AND (until IS NULL OR ls.i < until)) GROUP BY doc_id"""
)
def strip_references(spark, sf):
    page = F.concat("md", F.lit("\n## References\n1. x\n### Sub\ny\n## After\nz"))
    return headed(spark, sf).where("md IS NOT NULL").select("doc_id", markdown.strip_references_column(page).alias("md"))


# -- lines


@query("SELECT doc_id, CAST(i AS INTEGER) AS line, regexp_extract(coalesce(lag(l) OVER (PARTITION BY doc_id ORDER BY i), ''), '([^ \\t]{0,64})$', 1) || l AS text FROM (SELECT doc_id, unnest(ls) AS l, unnest(range(len(ls))) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))")
def line_overlap(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line", "l"))
    before = F.coalesce(F.lag("l").over(Window.partitionBy("doc_id").orderBy("line")), F.lit(""))
    return rows.select("doc_id", "line", F.concat(F.regexp_extract(before, r"([^ \t]{0,64})$", 1), F.col("l")).alias("text"))


# -- single steps


def line_step(fn: Callable[[list[str]], list[str]]) -> Callable[..., Column]:
    """A step over a text's lines as a column function."""
    return kernel(lambda t: None if t is None else "\n".join(fn(t.split("\n"))), T.StringType())


#: Documents with lines that the markdown steps change, the same in Spark and SQL.
_NOTES = "(SELECT doc_id, coalesce(text, '') || chr(10) || chr(10) || 'Notes on ' || coalesce(source, '') || chr(10) || '1) first ' || doc_id || chr(10) || '  * second  ' || chr(10) || 'b. third' || chr(10) || '| a|' || coalesce(lang, '') || ' |' || chr(10) || 'see https://a.org/' || doc_id || '. or (http://b.org/x)' || chr(10) || '*open' AS t FROM documents)"


def notes(spark, sf):
    c = lambda x: F.coalesce(x, F.lit(""))
    i = F.col("doc_id").cast("string")
    added = F.concat(F.lit("\n\nNotes on "), c(F.col("source")), F.lit("\n1) first "), i, F.lit("\n  * second  \nb. third\n| a|"), c(F.col("lang")), F.lit(" |\nsee https://a.org/"), i, F.lit(". or (http://b.org/x)\n*open"))
    return table(spark, sf, "documents").select("doc_id", F.concat(c(_text()), added).alias("t"))


def lines(source: str) -> str:
    return f"(SELECT doc_id, unnest(ls) AS l, unnest(range(len(ls))) AS i FROM (SELECT doc_id, string_split(t, chr(10)) AS ls FROM {source}))"


_ROW = "(length(trim(l)) > 1 AND trim(l) LIKE '|%|')"
_MARKED = r"regexp_matches(l, '^\s*(\d+[.)]|[a-zA-Z][.)]|[•·*+\-])\s+')"


def by_line(sql: str, source: str = _NOTES) -> str:
    """Each line by an expression over l, put together again."""
    return f"SELECT doc_id, string_agg({sql}, chr(10) ORDER BY i) AS text FROM {lines(source)} GROUP BY doc_id"


_LISTED = rf"CASE WHEN {_MARKED} THEN regexp_extract(l, '^(\s*)', 1) || CASE WHEN regexp_matches(l, '^\s*\d') THEN regexp_extract(l, '^\s*(\d+)', 1) || '.' WHEN regexp_matches(l, '^\s*[a-zA-Z]') THEN regexp_extract(l, '^\s*([a-zA-Z])', 1) || ')' ELSE '-' END || ' ' || regexp_replace(regexp_replace(l, '^\s*(\d+[.)]|[a-zA-Z][.)]|[•·*+\-])\s+', ''), '\s+$', '') ELSE l END"
_LINKED = "CASE WHEN contains(l, '`') THEN l ELSE regexp_replace(l, '(^|[^\\])])(https?://[^\\s)\\]`]*[^\\s)\\].,;:!?''\"`])', '\\1[\\2](\\2)', 'gi') END"
_ALIGNED = f"CASE WHEN {_ROW} THEN '| ' || array_to_string(list_transform(string_split(trim(trim(l), '|'), '|'), lambda c: trim(c)), ' | ') || ' |' ELSE l END"


def promoted(source: str) -> str:
    return rf"""SELECT doc_id, string_agg(CASE WHEN trim(coalesce(before, '')) = '' AND trim(l) <> '' AND length(trim(l)) <= 80 AND trim(l) NOT LIKE '>%' AND NOT {_ROW} AND NOT {_MARKED}
  AND NOT regexp_matches(trim(l), '^#{{1,6}}\s') AND NOT regexp_matches(trim(l), '[.!?;:]') AND NOT regexp_matches(l, '^\s*(-(\s*-){{2,}}|=(\s*=){{2,}}|_(\s*_){{2,}}|\*(\s*\*){{2,}})\s*$') THEN '## ' || trim(l) ELSE l END, chr(10) ORDER BY i) AS text
FROM (SELECT *, lag(l) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM {lines(source)}) GROUP BY doc_id"""


def closed(source: str) -> str:
    return f"SELECT doc_id, t || CASE WHEN list_sum(list_transform(r, lambda x: length(x) // 2)) % 2 = 1 THEN chr(10) || chr(10) || '**' ELSE '' END || CASE WHEN len(list_filter(r, lambda x: length(x) = 1)) % 2 = 1 THEN chr(10) || chr(10) || '*' ELSE '' END AS text FROM (SELECT doc_id, t, regexp_extract_all(t, '\\*+') AS r FROM {source})"


def then(sql: str) -> str:
    """A step's result as the source of the next."""
    return f"(SELECT doc_id, text AS t FROM ({sql}))"


@query(by_line(_LISTED))
def list_markers(spark, sf):
    return notes(spark, sf).select("doc_id", line_step(markdown.unify_lists)(F.col("t")).alias("text"))


@query(by_line(_LINKED))
def link_addresses(spark, sf):
    return notes(spark, sf).select("doc_id", line_step(markdown.link_urls)(F.col("t")).alias("text"))


@query(by_line(_ALIGNED))
def table_alignment(spark, sf):
    return notes(spark, sf).select("doc_id", line_step(markdown.align_tables)(F.col("t")).alias("text"))


@query(promoted(_NOTES))
def heading_promotion(spark, sf):
    return notes(spark, sf).select("doc_id", line_step(markdown.promote_headings)(F.col("t")).alias("text"))


@query(by_line(_ALIGNED, then(closed(then(by_line(_LINKED, then(by_line(_LISTED, then(promoted(_NOTES))))))))))
def normalize_markdown(spark, sf):
    return notes(spark, sf).select("doc_id", markdown.normalize_column(F.col("t")).alias("text"))


@query(closed(_NOTES))
def emphasis_repair(spark, sf):
    return notes(spark, sf).select("doc_id", kernel(lambda t: None if t is None else markdown.close_emphasis(t), T.StringType())(F.col("t")).alias("text"))


_ABBREVIATIONS = ", ".join(f"'{w}'" for w in sorted(chunking.ABBREVIATIONS))
_WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def sentences_sql(source: str) -> str:
    """k, pos, sentence of texts (k, text)."""
    return rf"""
WITH t AS (SELECT k, text, length(text) - length(regexp_extract(text, '[^。！？]*$')) AS z FROM {source}),
split AS (SELECT k, text, z, unnest(xs) AS x, unnest(range(len(xs))) AS n FROM (SELECT *, string_split_regex(text, '[.。！？]') AS xs FROM t)),
spots AS (SELECT * FROM (SELECT k, text, z, CAST(sum(length(x) + 1) OVER (PARTITION BY k ORDER BY n) AS BIGINT) AS i FROM split) WHERE i <= length(text)),
stops AS (SELECT *, substr(text, i, 1) AS c, regexp_extract(substr(text, CAST(greatest(z + 1, i - 64) AS BIGINT), CAST(i - greatest(z + 1, i - 64) AS BIGINT)), '([A-Za-z]+(?:\.[A-Za-z]+)*)\s*$', 1) AS w FROM spots),
cuts AS (SELECT k, text, i FROM stops WHERE c <> '.' OR (i > z AND NOT (regexp_matches(substr(text, i - 1, 1), '^[0-9]$') AND i > 1 AND regexp_matches(substr(text, i + 1, 1), '^[0-9]$')) AND lower(w) NOT IN ({_ABBREVIATIONS}) AND replace(lower(w), '.', '') NOT IN ({_ABBREVIATIONS}))
  UNION ALL SELECT k, text, length(text) FROM t),
pieces AS (SELECT k, i, trim(substr(text, CAST(coalesce(lag(i) OVER (PARTITION BY k ORDER BY i), 0) + 1 AS BIGINT), CAST(i - coalesce(lag(i) OVER (PARTITION BY k ORDER BY i), 0) AS BIGINT)), {_WS}) AS sentence FROM cuts)
SELECT k, CAST(row_number() OVER (PARTITION BY k ORDER BY i) - 1 AS INTEGER) AS pos, sentence FROM pieces WHERE sentence <> ''"""


@query(f"SELECT k AS doc_id, pos, sentence FROM ({sentences_sql(f'(SELECT doc_id AS k, text FROM {TEXTS})')})")
def sentence_split(spark, sf):
    return texts(spark, sf).select("doc_id", F.posexplode(chunking.sentences_column(_text())).alias("pos", "sentence"))


def pieces_sql(source: str, size: int, overlap: int) -> str:
    """k, n, text: the pieces of texts (k, text) without headings, by recursion over paragraphs and over windows."""
    return rf"""
WITH RECURSIVE source AS (SELECT k, text FROM {source} WHERE trim(text, {_WS}) <> ''),
split AS (SELECT k, list_filter(string_split(text, chr(10) || chr(10)), lambda p: trim(p, {_WS}) <> '') AS ps FROM source WHERE length(text) > {size}),
units AS (SELECT k, unnest(ps) AS p, unnest(range(1, len(ps) + 1)) AS i FROM split),
pack AS (
  SELECT k, i, length(p) AS held, 1 AS g FROM units WHERE i = 1
  UNION ALL
  SELECT u.k, u.i, CASE WHEN held + 2 + length(p) <= {size} THEN held + 2 + length(p) ELSE length(p) END, CASE WHEN held + 2 + length(p) <= {size} THEN g ELSE g + 1 END FROM pack JOIN units u ON u.k = pack.k AND u.i = pack.i + 1),
blocks AS (SELECT pack.k, g, string_agg(p, chr(10) || chr(10) ORDER BY pack.i) AS b FROM pack JOIN units ON units.k = pack.k AND units.i = pack.i GROUP BY pack.k, g),
parts AS (
  SELECT k, g, 0 AS pos, b AS s FROM blocks WHERE length(b) <= {size}
  UNION ALL SELECT k.k, k.g, pos, sentence FROM ({sentences_sql(f"(SELECT {{'k': k, 'g': g}} AS k, b AS text FROM blocks WHERE length(b) > {size})")})),
spans AS (
  SELECT k, g, pos, s, 0 AS w, CAST(0 AS BIGINT) AS a, CAST(CASE WHEN strpos(reverse(substr(s, {size} - {chunking.REACH} + 1, {chunking.REACH})), ' ') > 0 THEN {size} - strpos(reverse(substr(s, {size} - {chunking.REACH} + 1, {chunking.REACH})), ' ') + 1 ELSE {size} END AS BIGINT) AS e
  FROM parts WHERE length(s) > {size}
  UNION ALL
  SELECT k, g, pos, s, w, a, CAST(CASE WHEN a + {size} >= length(s) THEN length(s) WHEN space > 0 THEN a + {size} - space + 1 ELSE a + {size} END AS BIGINT) FROM (
    SELECT k, g, pos, s, w + 1 AS w, a, strpos(reverse(substr(s, CAST(greatest(a + 1, a + {size} - {chunking.REACH}) + 1 AS BIGINT), CAST(a + {size} - greatest(a + 1, a + {size} - {chunking.REACH}) AS BIGINT))), ' ') AS space FROM (
      SELECT k, g, pos, s, w, CASE WHEN back > 0 AND back <= {overlap} AND {overlap} < shown THEN greatest(e - back, a + 1) ELSE e END AS a FROM (
        SELECT *, length(trim(substr(s, a + 1, e - a), {_WS})) AS shown, strpos(reverse(trim(substr(s, a + 1, e - a), {_WS})), ' ') AS back FROM spans WHERE e < length(s))))),
cut AS (
  SELECT k, g, pos, 0 AS w, s AS x FROM parts WHERE length(s) <= {size}
  UNION ALL SELECT k, g, pos, w, trim(substr(s, a + 1, e - a), {_WS}) FROM spans
  UNION ALL SELECT k, 0, 0, 0, text FROM source WHERE length(text) <= {size}),
ordered AS (SELECT k, row_number() OVER (PARTITION BY k ORDER BY g, pos, w) - 1 AS n, x, lag(x) OVER (PARTITION BY k ORDER BY g, pos, w) AS before FROM cut WHERE x <> '')
SELECT k, CAST(n AS INTEGER) AS n, CASE WHEN before IS NULL THEN x ELSE trim(right(regexp_extract(right(before, {overlap}), '[^\s]*$') || x, {size}), {_WS}) END AS text FROM ordered"""


def paragraphs_sql(source: str, longest: int) -> str:
    """k, pos, part: groups of whole paragraphs (k, text), of sentences where a paragraph is too long."""
    return rf"""
WITH RECURSIVE ps AS (SELECT k, list_filter(list_transform(string_split_regex(coalesce(text, ''), '\n\n+'), lambda p: trim(p, {_WS})), lambda p: p <> '') AS ps FROM {source}),
para AS (SELECT k, unnest(ps) AS p, unnest(range(len(ps))) AS j FROM ps),
units AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY j, o) AS i FROM (SELECT k, j, long, unnest(xs) AS x, unnest(range(len(xs))) AS o FROM (SELECT k, j, length(p) > {longest} AS long, CASE WHEN length(p) > {longest} THEN string_split(regexp_replace(p, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) ELSE [p] END AS xs FROM para))),
packed AS (
  SELECT k, i, j, long, CASE WHEN long THEN length(x) + 1 ELSE length(x) + 2 END AS held, 0 AS g FROM units WHERE i = 1
  UNION ALL
  SELECT k, i, j, long, CASE WHEN fits THEN held + more ELSE more END, CASE WHEN fits THEN g ELSE g + 1 END FROM (
    SELECT u.k, u.i, u.j, u.long, held, g, length(x) + CASE WHEN u.long THEN 1 ELSE 2 END AS more, u.long = q.long AND (NOT u.long OR u.j = q.j) AND held + length(x) + CASE WHEN u.long THEN 1 ELSE 2 END <= {longest} AS fits
    FROM packed q JOIN units u ON u.k = q.k AND u.i = q.i + 1))
SELECT k, CAST(g AS INTEGER) AS pos, CASE WHEN one THEN array_to_string(xs, ' ') ELSE array_to_string(xs, chr(10) || chr(10)) END AS part FROM (SELECT q.k AS k, g, bool_or(q.long) AS one, list(x ORDER BY q.i) AS xs FROM packed q JOIN units ON units.k = q.k AND units.i = q.i GROUP BY q.k, g)"""


_PLAIN = f"(SELECT CAST(doc_id AS VARCHAR) AS k, trim(text, {_WS}) AS text FROM documents WHERE text IS NOT NULL)"


@query(f"SELECT k AS source_doc_id, n AS chunk_index, text, 'General' AS section_path FROM ({pieces_sql(_PLAIN, 1024, 64)}) UNION ALL SELECT * FROM {values(fixtures.MARKDOWN_CHUNKS, 'source_doc_id, chunk_index, text, section_path')}")
def chunk_documents(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), _text())
    m = frame(spark, fixtures.MARKDOWN, "doc_id string, text string")
    return chunking.chunk_documents(d.unionByName(m)).drop("metadata").withColumn("section_path", F.array_join("section_path", "/"))


@query(f"SELECT k AS doc_id, pos, part FROM ({paragraphs_sql(f'(SELECT doc_id AS k, text FROM {TEXTS})', 2000)})")
def paragraph_split(spark, sf):
    return texts(spark, sf).select("doc_id", F.posexplode(chunking.split_paragraphs_column(_text(), F.lit(2000))).alias("pos", "part"))


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN '## ' || coalesce(source, '') ELSE '### ' || coalesce(lang, '') || chr(10) || chr(10) || '### ' || coalesce(source, '') END AS header FROM documents")
def section_header(spark, sf):
    lang, source = F.coalesce("lang", F.lit("")), F.coalesce("source", F.lit(""))
    path = F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("General"))).when(F.col("doc_id") % 3 == 1, F.array(source)).otherwise(F.array(lang, source))
    return table(spark, sf, "documents").select("doc_id", tx.section_header(path).alias("header"))


@query("SELECT doc_id, array_to_string(list_filter(string_split('# ' || source || ' and more' || chr(10) || text || chr(10) || '# other', chr(10)), lambda x: NOT (regexp_matches(x, '^\\s*#\\s') AND starts_with(ltrim(x), '# ' || source))), chr(10)) AS text FROM documents")
def duplicate_title(spark, sf):
    page = F.concat(F.lit("# "), "source", F.lit(" and more\n"), "text", F.lit("\n# other"))
    return table(spark, sf, "documents").select("doc_id", tx.drop_duplicate_title(page, F.col("source")).alias("text"))


@query("SELECT doc_id, array_to_string(list_slice(ls, greatest(len(ls) - 10, 0) + 1, len(ls)), chr(10)) AS lines FROM (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS ls FROM documents)")
def last_lines(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.last_lines(_text()).alias("lines"))


@query("SELECT doc_id, concat_ws(chr(10), CASE WHEN n_chars > 0 THEN '- **Words:** ' || n_chars END, chr(10) || '- **Sections:**' || chr(10) || '1. **' || lang || '**' || chr(10) || '2.   **' || source || '**') AS block FROM documents")
def metadata_block(spark, sf):
    part = lambda level, title: F.struct(F.lit(level).alias("level"), F.col(title).alias("title"))
    return table(spark, sf, "documents").select("doc_id", tx.metadata_block(F.col("n_chars"), F.array(part(2, "lang"), part(4, "source"))).alias("block"))


@query("SELECT conv_id, turn, coalesce(string_agg(coalesce(text, '') || ' ', '') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS so_far FROM conversations")
def running_summary(spark, sf):
    c = table(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("part"), F.col("text").alias("summary"))
    return formatting.running_summary(c).select(F.col("doc_id").alias("conv_id"), F.col("part").alias("turn"), "so_far")


@query("SELECT item_id, 'Find passages that answer this question: ' || text AS asked FROM benchmark")
def question_instruction(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", vx.with_instruction(_text(), Config().query_instruction).alias("asked"))


@query("SELECT doc_id, CAST(CASE WHEN doc_id % 5 = 0 THEN 0 ELSE 3 END AS INTEGER) AS size, CASE WHEN doc_id % 5 = 0 THEN 0 ELSE CAST(doc_id % 1000 + n_chars % 1000 AS DOUBLE) + 0.5 END AS total FROM documents")
def vector_of_text(spark, sf):
    i = F.col("doc_id")
    shown = F.concat_ws(",", F.when(i % 5 == 0, "x").otherwise((i % 1000).cast("string")), F.concat(F.lit(" "), (F.col("n_chars") % 1000).cast("string")), F.lit("0.5"))
    v = vx.parsed_vector(shown)
    return table(spark, sf, "documents").select("doc_id", F.size(v).alias("size"), F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double")).alias("total"))


@query("SELECT vec_id, CAST(len(embedding) AS INTEGER) AS size FROM embeddings")
def checked_vectors(spark, sf):
    e = table(spark, sf, "embeddings")
    dim = e.where("embedding IS NOT NULL").select(F.size("embedding")).first()[0]
    return e.select("vec_id", F.when(F.col("embedding").isNotNull(), F.size(vx.checked_vector(F.col("embedding"), dim))).alias("size"))


_RULED = "coalesce(text, '') || chr(10) || '[Edit]' || chr(10) || 'kept[12] ' || doc_id || chr(10) || 'Retrieved from there' || chr(10) || 'Jump to search'"


@query(f"SELECT doc_id, {'regexp_replace(' * 5}{_RULED}, '(?im)^\\[(?:edit|citation needed)\\]$', '', 'g'), '\\[\\d+\\]', '', 'g'), '(?m)^Jump to (?:navigation|search)$', '', 'g'), '(?m)^Retrieved from .*$', '', 'g'), '(?m)^This page was last (?:edited|modified) on .*$', '', 'g') AS text FROM documents")
def custom_rules(spark, sf):
    ruled = F.concat(F.coalesce(_text(), F.lit("")), F.lit("\n[Edit]\nkept[12] "), F.col("doc_id").cast("string"), F.lit("\nRetrieved from there\nJump to search"))
    rules = cleaning.load_rules(Path(__file__).resolve().parents[2] / "conf" / "clean_rules.yaml")
    return table(spark, sf, "documents").select("doc_id", cleaning.apply_rules(ruled, rules).alias("text"))


@query(rf"SELECT doc_id, name FROM (SELECT doc_id, unnest(regexp_extract_all(substr(text, 1, 5000), '[\x{{4E00}}-\x{{9FFF}}]+')) AS name FROM {TEXTS}) WHERE length(name) BETWEEN 2 AND 16")
def cjk_names(spark, sf):
    return texts(spark, sf).select("doc_id", F.explode(tags.cjk_names(_text())).alias("name"))


@query(
    rf"""SELECT doc_id, token, count(*) AS freq FROM (SELECT doc_id, unnest(list_concat(list_transform(list_filter(string_split_regex(text, '[\s\x0b]+'), lambda w: length(w) > 1), lambda w: lower(w)),
  flatten(list_transform(regexp_extract_all(text, '[\x{{4E00}}-\x{{9FFF}}]{{2,}}'), lambda r: list_transform(range(1, length(r)), lambda i: substr(r, i, 2)))))) AS token FROM {TEXTS}) GROUP BY ALL"""
)
def cjk_token_freq(spark, sf):
    return tags.token_counts(texts(spark, sf), tags.cjk_tokens(_text())).select("doc_id", "token", "freq")


# -- tags and entities


@query("SELECT doc_id, token, count(*) AS freq FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) AS token FROM documents) GROUP BY ALL")
def latin_token_freq(spark, sf):
    return tags.token_counts(table(spark, sf, "documents"), tags.latin_tokens(_text())).select("doc_id", "token", "freq")


_STOP = ", ".join(f"'{w}'" for w in tags.STOP_LATIN)


@query(
    f"""
WITH b AS (SELECT doc_id, unnest(ts) AS token, unnest(range(len(ts))) AS pos FROM (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[a-z]{{3,}}'), lambda t: t NOT IN ({_STOP})) AS ts FROM documents)),
h AS (SELECT doc_id, unnest(ts) AS token, unnest(range(len(ts))) AS pos FROM (SELECT doc_id, regexp_extract_all(lower(string_split(text, chr(10))[1]), '[a-z]{{3,}}') AS ts FROM documents)),
c AS (SELECT doc_id, token, sum(w) AS freq, min(pos) AS pos FROM (SELECT doc_id, token, 1 AS w, pos FROM b UNION ALL SELECT doc_id, token, 2, pos + 1000000000 FROM h) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY freq DESC, pos) AS rank FROM c)
SELECT doc_id, token, CAST(freq AS BIGINT) AS freq, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5"""
)
def top_tags_per_doc(spark, sf):
    d = table(spark, sf, "documents")
    body = tags.token_counts(d, F.filter(tags.latin_tokens(_text()), lambda t: ~t.isin(tags.STOP_LATIN)))
    head = tags.token_counts(d, tags.latin_tokens(F.element_at(F.split("text", "\n", -1), 1)), 2).withColumn("pos", F.col("pos") + 1_000_000_000)
    both = body.unionByName(head).groupBy("doc_id", "token").agg(F.sum("freq").alias("freq"), F.min("pos").alias("pos"))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("freq"), "pos"))
    return both.withColumn("rank", rank).where("rank <= 5").select("doc_id", "token", "freq", "rank")


@query("SELECT doc_id, noun, count(*) AS freq FROM (SELECT doc_id, unnest(regexp_extract_all(substr(text, 1, 200), '[A-Z][a-zA-Z0-9\\-]+(?:\\s+[A-Z][a-zA-Z0-9\\-]+)*')) AS noun FROM documents) GROUP BY ALL")
def leading_names(spark, sf):
    names = F.regexp_extract_all(F.substring(_text(), 1, 200), F.lit(tags.NAMES), F.lit(0))
    return tags.token_counts(table(spark, sf, "documents"), names).select("doc_id", F.col("token").alias("noun"), "freq")


@query()
def extract_tags(spark, sf):
    d = table(spark, sf, "documents")
    return tags.extract_tags(d.select("doc_id", F.element_at(F.split("text", "\n", -1), 1).alias("title"), _text().alias("body")))


_ESC = r"regexp_escape(lower(e.name))"


@query(
    f"""
SELECT t.doc_id, e.name, regexp_matches(e.name, '{C}') AS cjk FROM {TEXTS} t
  JOIN (SELECT CAST(doc_id AS BIGINT) AS doc_id, name FROM {values(fixtures.ENTITIES, 'doc_id, name')} UNION ALL SELECT doc_id, unnest([lang, regexp_extract(text, '[A-Za-z]{{2,}}'), 'The']) FROM documents) e USING (doc_id)
WHERE CASE WHEN regexp_matches(e.name, '{C}') THEN contains(lower(t.text), lower(e.name)) ELSE regexp_matches(lower(t.text), '(^|[^\\pL\\pN_])' || {_ESC} || '($|[^\\pL\\pN_])') END"""
)
def entity_match(spark, sf):
    named = F.explode(F.array(F.col("lang"), F.regexp_extract(_text(), "[A-Za-z]{2,}", 0), F.lit("The"))).alias("name")
    e = frame(spark, fixtures.ENTITIES, "doc_id bigint, name string").unionByName(table(spark, sf, "documents").select("doc_id", named)).groupBy("doc_id").agg(F.collect_list(F.struct("name", F.lit("CONCEPT").alias("type"))).alias("entities"))
    t = texts(spark, sf).join(e, "doc_id")
    return t.select("doc_id", F.explode(tags.matched_entities(_text(), F.col("entities"))).alias("name")).withColumn("cjk", tx.contains_cjk(F.col("name")))


@query()
def wikilinks(spark, sf):
    t = table(spark, sf, "documents").select("doc_id", _text(), tags.proper_nouns(_text()).alias("names"))
    return t.select("doc_id", markdown.wikilinks_column(_text(), F.col("names")).alias("text"))


# -- full text


@query("SELECT item_id, CAST(i AS INTEGER) AS pos, term FROM (SELECT item_id, unnest(ts) AS term, unnest(range(len(ts))) AS i FROM (SELECT item_id, list_filter(regexp_extract_all(strip_accents(lower(text)), '[\\pL\\pN]+'), lambda t: length(t) > 1) AS ts FROM benchmark))")
def fts_terms(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", F.posexplode(tx.query_terms(_text())).alias("pos", "term"))


BM25 = """
WITH toks AS (SELECT doc_id AS id, regexp_extract_all(strip_accents(lower(coalesce(text, ''))), '[\\pL\\pN]+') AS t FROM documents),
st AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM toks),
post AS (SELECT term, id, dl, count(*) AS tf FROM (SELECT id, len(t) AS dl, unnest(t) AS term FROM toks) GROUP BY ALL),
asked AS (SELECT query_id, term, count(*) AS times FROM (SELECT item_id AS query_id, unnest(list_filter(regexp_extract_all(strip_accents(lower(text)), '[\\pL\\pN]+'), lambda t: length(t) > 1)) AS term FROM benchmark) GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df FROM post GROUP BY term),
idf AS (SELECT term, CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END AS idf, avgdl FROM dfs, st),
scored AS (SELECT query_id, id, round(sum(times * idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 9) AS score FROM post JOIN idf USING (term) JOIN asked USING (term) GROUP BY ALL),
hits AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM scored)
"""


def asked(spark, sf):
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), _text().alias("question"))


def bm25_hits(spark, sf, k=10):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), _text())
    return search.bm25(search.text_index(d), asked(spark, sf), k)


@query(BM25 + "SELECT query_id, id, round(score, 6) AS score, rank FROM hits WHERE rank <= 10")
def bm25_topk(spark, sf):
    return bm25_hits(spark, sf).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@query(BM25 + "SELECT query_id, rank, id, lang, substr(text, 1, 80) AS head FROM hits JOIN documents ON id = doc_id WHERE rank <= 5")
def bm25_text_only(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "lang", F.substring(_text(), 1, 80).alias("head"))
    return bm25_hits(spark, sf, 5).join(d, "id").select("query_id", "rank", "id", "lang", "head")


# -- vectors: a benchmark item asks with the vector of its number (a convention)

_DIST = "greatest(0.0, 1 - list_cosine_similarity(CAST(c.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])))"


def near_sql(k: int, where: str = "TRUE") -> str:
    return f"""near AS (SELECT * FROM (SELECT q.vec_id AS query_id, c.vec_id AS id, round({_DIST}, 9) AS distance, CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY round({_DIST}, 9), c.vec_id) AS INTEGER) AS rank
  FROM embeddings c, (SELECT vec_id, embedding FROM embeddings JOIN benchmark ON vec_id = item_id) q WHERE {where}) WHERE rank <= {k})"""


def near(spark, sf, k=10):
    e = table(spark, sf, "embeddings")
    q = e.join(table(spark, sf, "benchmark").select("item_id"), F.col("vec_id") == F.col("item_id")).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return search.vector_search_many(e, q, k, "vec_id").withColumn("distance", F.round("distance", 9))


def first_vector(spark, sf) -> list[float]:
    return [float(x) for x in table(spark, sf, "embeddings").where("embedding IS NOT NULL").orderBy("vec_id").first()["embedding"]]


_FIRST = "(SELECT embedding FROM embeddings WHERE embedding IS NOT NULL ORDER BY vec_id LIMIT 1) q"


@query(f"SELECT c.vec_id, c.label, round({_DIST}, 6) AS distance FROM embeddings c, {_FIRST} ORDER BY {_DIST}, c.vec_id LIMIT 10")
def vector_topk(spark, sf):
    return search.vector_search(table(spark, sf, "embeddings"), first_vector(spark, sf), 10, "vec_id").select("vec_id", "label", F.round("distance", 6).alias("distance"))


@query(f"SELECT c.vec_id, c.label, round({_DIST}, 6) AS distance FROM embeddings c, {_FIRST} WHERE c.label = 1 ORDER BY {_DIST}, c.vec_id LIMIT 10")
def vector_topk_filtered(spark, sf):
    return search.vector_search(table(spark, sf, "embeddings"), first_vector(spark, sf), 10, "vec_id", where=F.col("label") == 1).select("vec_id", "label", F.round("distance", 6).alias("distance"))


@query(f"WITH {near_sql(10)} SELECT query_id, id, round(distance, 6) AS distance, rank FROM near")
def vector_topk_multi_query(spark, sf):
    return near(spark, sf).select("query_id", "id", F.round("distance", 6).alias("distance"), "rank")


@query("SELECT doc_id, lang, source FROM documents WHERE list_contains([lang, source], 'en') AND list_contains([lang, source], 'src1')")
def doc_search_tags(spark, sf):
    d = table(spark, sf, "documents").withColumn("tags", F.array("lang", "source")).withColumn("source_file", F.col("doc_id").cast("string"))
    return search.document_search(d, tags=["en", "src1"], k=None).select("doc_id", "lang", "source")


@query("SELECT w.query_id, CAST(w.pos AS INTEGER) AS pos, w.id, round(CAST(list_sum(CAST(e.embedding AS DOUBLE[])) AS DOUBLE), 6) AS total FROM (SELECT item_id AS query_id, unnest([item_id + 1, item_id, -5, item_id]) AS id, unnest([0, 1, 2, 3]) AS pos FROM benchmark) w LEFT JOIN embeddings e ON e.vec_id = w.id")
def embeddings_by_ids(spark, sf):
    i = F.col("item_id")
    wanted = table(spark, sf, "benchmark").select(i.alias("query_id"), F.array(i + 1, i, F.lit(-5).cast("long"), i).alias("ids"))
    found = search.embeddings_by_ids(table(spark, sf, "embeddings"), wanted, "vec_id")
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return found.select("query_id", "pos", "id", F.round(total, 6).alias("total"))


def fused_sql(join: str) -> str:
    return f"""{BM25}, texth AS (SELECT query_id, id, rank FROM hits WHERE rank <= 10), {near_sql(10)},
sizes AS (SELECT query_id, greatest(sum(a), sum(b), 1) + 1 AS absent FROM (SELECT query_id, 1 AS a, 0 AS b FROM near UNION ALL SELECT query_id, 0, 1 FROM texth) GROUP BY query_id),
f AS (SELECT query_id, id, v.rank AS v, 1.0::DOUBLE / (coalesce(t.rank, absent) + 60) + 1.0::DOUBLE / (coalesce(v.rank, absent) + 60) AS score
  FROM near v {join} JOIN texth t USING (query_id, id) JOIN sizes USING (query_id)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, v NULLS LAST, id) AS INTEGER) AS rank FROM f)
SELECT query_id, id, round(score, 9) AS score, rank FROM r WHERE rank <= 10"""


@query(fused_sql("LEFT"))
def rrf_vector_anchored(spark, sf):
    return search.fuse(near(spark, sf), bm25_hits(spark, sf)).withColumn("score", F.round("score", 9))


@query(fused_sql("FULL"))
def rrf_union(spark, sf):
    return search.fuse(near(spark, sf), bm25_hits(spark, sf), mode="union").withColumn("score", F.round("score", 9))


# -- re-ranking and context

LEX = """
lex AS (SELECT qt.query_id, qt.id, sum(least(qt.c, coalesce(tt.c, 0))) / any_value(qt.total) AS score FROM
  (SELECT query_id, id, tok, count(*) AS c, any_value(total) AS total FROM (SELECT query_id, id, unnest(qs) AS tok, len(qs) AS total FROM (SELECT h.query_id, h.id, list_transform(regexp_extract_all(b.text, '[a-zA-Z]{2,}'), lambda x: lower(x)) AS qs FROM cand h JOIN benchmark b ON b.item_id = h.query_id)) GROUP BY query_id, id, tok) qt
  LEFT JOIN (SELECT id, tok, count(*) AS c FROM (SELECT DISTINCT id FROM cand) JOIN (SELECT doc_id, unnest(list_transform(regexp_extract_all(text, '[a-zA-Z]{2,}'), lambda x: lower(x))) AS tok FROM documents) ON id = doc_id GROUP BY id, tok) tt
  ON qt.id = tt.id AND qt.tok = tt.tok GROUP BY qt.query_id, qt.id)
"""


def candidates(spark, sf, k=10):
    hits = bm25_hits(spark, sf, k).select("query_id", "id", "rank")
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), _text())
    return hits.join(d, "id").join(asked(spark, sf), "query_id")


@query(BM25 + ", cand AS (SELECT query_id, id FROM hits WHERE rank <= 10)," + LEX + "SELECT query_id, id, round(CAST(score AS DOUBLE), 9) AS score FROM lex")
def lexical_score(spark, sf):
    return candidates(spark, sf).select("query_id", "id", F.round(tx.lexical_score(F.col("question"), _text()), 9).alias("score"))


@query(BM25 + ", cand AS (SELECT query_id, id, rank AS old FROM hits WHERE rank <= 5)," + LEX + "SELECT query_id, id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY lex.score DESC, old) AS INTEGER) AS rank FROM lex JOIN cand USING (query_id, id)")
def rerank_small(spark, sf):
    return search.rerank_lexical(candidates(spark, sf, 5)).select("query_id", "id", "rank")


def mmr_sql(k: int, balance: float = 0.7) -> str:
    """k greedy choices among ranked candidates m (query_id, id, rank, score, e), one CTE each."""
    steps = [f"p1 AS (SELECT query_id, id, score, e, 1 AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {balance} * score DESC, old) AS n FROM m) WHERE n = 1)"]
    for i in range(2, k + 1):
        chosen = " UNION ALL ".join(f"SELECT * FROM p{j}" for j in range(1, i))
        steps.append(f"""p{i} AS (SELECT query_id, id, score, e, {i} AS rank FROM (SELECT m.*, row_number() OVER (PARTITION BY m.query_id ORDER BY {balance} * m.score - {1 - balance:.1f} * c.closest DESC, m.old) AS n
  FROM m JOIN (SELECT m.query_id, m.id, max(list_cosine_similarity(m.e, x.e)) AS closest FROM m JOIN ({chosen}) x USING (query_id) GROUP BY m.query_id, m.id) c ON c.query_id = m.query_id AND c.id = m.id
  WHERE NOT EXISTS (SELECT 1 FROM ({chosen}) y WHERE y.query_id = m.query_id AND y.id = m.id)) WHERE n = 1)""")
    return ",\n".join(steps) + "\nSELECT query_id, id, round(score, 9) AS score, CAST(rank AS INTEGER) AS rank FROM (" + " UNION ALL ".join(f"SELECT * FROM p{j}" for j in range(1, k + 1)) + ")"


@query(
    BM25
    + ", cand AS (SELECT query_id, id, rank AS old FROM hits WHERE rank <= 10),"
    + LEX
    + """, hashed AS (SELECT doc_id, list_transform(range(64), lambda i: CAST(('0x' || substr(h, 2 * (i % 32) + 1, 2)) AS INTEGER) / 255.0::DOUBLE * 2 - 1) AS e FROM (SELECT doc_id, sha256(coalesce(text, '')) AS h FROM documents)),
m AS (SELECT cand.query_id, cand.id, cand.old, CAST(lex.score AS DOUBLE) AS score, e FROM cand JOIN lex USING (query_id, id) JOIN hashed ON doc_id = cand.id),
"""
    + mmr_sql(4)
)
def mmr_rerank(spark, sf):
    c = candidates(spark, sf, 10).withColumn("embedding", vx.hash_embedding(_text(), 64))
    return search.mmr_rerank(c, 4).withColumn("score", F.round("score", 9))


@query(
    BM25
    + """, h AS (SELECT query_id, rank, id, lang, text FROM hits JOIN documents ON id = doc_id WHERE rank <= 3)
SELECT query_id, string_agg('[Chunk ' || rank || ' (source: ' || id || ', section: ' || lang || ', words: ' || length(text) || ')]' || chr(10) || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS context, array_to_string(list_sort(list_distinct(list(CAST(id AS VARCHAR)))), ',') AS sources, CAST(count(*) AS INTEGER) AS n_chunks FROM h GROUP BY query_id"""
)
def context_assembly(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("doc_id").cast("string").alias("source_doc_id"), F.array("lang").alias("section_path"), F.length(_text()).alias("word_count"), _text())
    return answer.assemble_context(bm25_hits(spark, sf, 3).join(d, "id")).withColumn("sources", F.array_join("sources", ","))


@query(BM25 + "SELECT query_id, array_to_string(list_sort(list_distinct(list(source))), ',') AS sources FROM hits JOIN documents ON id = doc_id WHERE rank <= 10 GROUP BY query_id")
def sources_of_answer(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "source")
    return bm25_hits(spark, sf).join(d, "id").groupBy("query_id").agg(F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))


@query("SELECT doc_id, CAST(i AS INTEGER) AS dim, round(CAST(('0x' || substr(h, 2 * i + 1, 2)) AS INTEGER) / 255.0::DOUBLE * 2 - 1, 9) AS value FROM (SELECT doc_id, sha256(text) AS h, unnest(range(32)) AS i FROM documents)")
def hash_embed(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.posexplode(vx.hash_embedding(_text(), 32)).alias("dim", "value")).withColumn("value", F.round("value", 9))


# -- the store

_OLD, _NEW = values(fixtures.CHUNK_SETS, "source_doc_id, chunk_index, text"), values(fixtures.NEW_CHUNKS, "source_doc_id, chunk_index, text")
_WORDS = f"CAST({n(C)} + {n(r'[^ \t\n]+', f"regexp_replace(text, '{C}', '', 'g')")} AS INTEGER) AS word_count"


def stored(spark, rows):
    return store.with_defaults(frame(spark, rows, "source_doc_id string, chunk_index int, text string"), 4)


@query(f"SELECT source_doc_id, chunk_index, text, {_WORDS} FROM (SELECT * FROM {_NEW} UNION ALL SELECT * FROM {_OLD} o WHERE NOT EXISTS (SELECT 1 FROM {_NEW} w WHERE w.source_doc_id = o.source_doc_id AND w.chunk_index = o.chunk_index))")
def upsert_merge(spark, sf):
    return store.merge(stored(spark, fixtures.CHUNK_SETS), stored(spark, fixtures.NEW_CHUNKS), "source_doc_id", "chunk_index").select("source_doc_id", "chunk_index", "text", "word_count")


@query(f"SELECT source_doc_id, chunk_index, text, {_WORDS} FROM (SELECT * FROM {_NEW} UNION ALL SELECT * FROM {_OLD} WHERE source_doc_id NOT IN (SELECT source_doc_id FROM {_NEW}))")
def stale_tail(spark, sf):
    return store.replace_documents(stored(spark, fixtures.CHUNK_SETS), stored(spark, fixtures.NEW_CHUNKS)).select("source_doc_id", "chunk_index", "text", "word_count")


@query("SELECT c.conv_id AS source_doc_id, CAST(c.turn AS INTEGER) AS chunk_index, c.role || ': ' || c.text AS text, CAST(count(*) OVER (PARTITION BY c.conv_id) AS INTEGER) AS total_chunks FROM conversations c")
def conversation_chunks(spark, sf):
    c = table(spark, sf, "conversations")
    totals = c.groupBy("conv_id").agg(F.count(F.lit(1)).cast("int").alias("total_chunks"))
    return c.join(totals, "conv_id").select(F.col("conv_id").alias("source_doc_id"), F.col("turn").cast("int").alias("chunk_index"), F.concat("role", F.lit(": "), "text").alias("text"), "total_chunks")


def conversation_index(spark, sf) -> store.Index:
    """An index of the conversations' turns, each conversation a document."""
    c = table(spark, sf, "conversations").select(F.col("conv_id").cast("string").alias("source_doc_id"), F.col("turn").cast("int").alias("chunk_index"), "text", F.array("role").alias("entity_names"))
    index = store.Index(spark, library.new_path(spark, "index"), 4, buckets=16)
    index.upsert_chunks(c)
    return index


_TURNS = "(SELECT CAST(conv_id AS VARCHAR) AS source_doc_id, CAST(turn AS INTEGER) AS chunk_index, role, text FROM conversations)"


@query(f"SELECT source_doc_id, chunk_index, text FROM {_TURNS} WHERE source_doc_id = (SELECT min(source_doc_id) FROM {_TURNS})")
def chunks_of_document(spark, sf):
    index = conversation_index(spark, sf)
    return index.chunks_of(index.chunks.agg(F.min("source_doc_id")).first()[0]).select("source_doc_id", "chunk_index", "text")


@query(f"SELECT source_doc_id, chunk_index, text FROM {_TURNS} WHERE role = 'user'")
def chunks_with_entity(spark, sf):
    return conversation_index(spark, sf).with_entity("user").select("source_doc_id", "chunk_index", "text")


@query(f"SELECT source_doc_id, chunk_index, text FROM {_TURNS} WHERE source_doc_id <> (SELECT min(source_doc_id) FROM {_TURNS})")
def delete_chunks(spark, sf):
    index = conversation_index(spark, sf)
    index.delete_chunks(index.chunks.agg(F.min("source_doc_id")).first()[0])
    return index.chunks.select("source_doc_id", "chunk_index", "text")


@query(f"SELECT source_doc_id, chunk_index, CASE WHEN chunk_index = 0 THEN 'changed: ' || text ELSE text END AS text FROM {_TURNS} WHERE chunk_index = 0 OR role <> 'user' OR source_doc_id NOT IN (SELECT source_doc_id FROM {_TURNS} WHERE chunk_index = 0)")
def upsert_chunk(spark, sf):
    index = conversation_index(spark, sf)
    turns = index.chunks
    index.upsert_chunks(turns.where("chunk_index = 0 OR NOT array_contains(entity_names, 'user')").join(turns.where("chunk_index = 0").select("source_doc_id"), "source_doc_id", "left_semi"))
    index.upsert_chunk(index.chunks.where("chunk_index = 0").withColumn("text", F.concat(F.lit("changed: "), "text")))
    return index.chunks.select("source_doc_id", "chunk_index", "text")


def document_index(spark, sf) -> store.Index:
    d = table(spark, sf, "documents").select(F.col("source").alias("title"), F.array("lang").alias("tags"), _text().alias("text_summary"), F.col("doc_id").cast("string").alias("source_file"))
    index = store.Index(spark, library.new_path(spark, "index"), 4, buckets=16)
    index.upsert_documents(d)
    index.upsert_documents(d.where("title = 'src1'").withColumn("title", F.lit("first")))
    return index


_ROWS = "SELECT CASE WHEN source = 'src1' THEN 'first' ELSE source END AS title, lang AS tags, substr(text, 1, 1000) AS text_summary, CAST(doc_id AS VARCHAR) AS source_file, CAST(0 AS INTEGER) AS total_chunks FROM documents"


@query(_ROWS)
def upsert_document(spark, sf):
    return document_index(spark, sf).documents.select("title", F.array_join("tags", ",").alias("tags"), "text_summary", "source_file", "total_chunks")


@query(_ROWS + " WHERE doc_id <> (SELECT min(doc_id) FROM documents)")
def delete_document(spark, sf):
    index = document_index(spark, sf)
    index.delete_document(str(table(spark, sf, "documents").agg(F.min("doc_id")).first()[0]))
    return index.documents.select("title", F.array_join("tags", ",").alias("tags"), "text_summary", "source_file", "total_chunks")


@query("SELECT d.doc_id, d.lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.toxic = 1)")
def delete_documents(spark, sf):
    gone = table(spark, sf, "labels").where("toxic = 1").select("doc_id")
    return table(spark, sf, "documents").join(gone, "doc_id", "left_anti").select("doc_id", "lang")


# -- names, validation, keys


@query(f"SELECT name, substr(coalesce(nullif(trim(regexp_replace(name, '[/\\\\:*?\"<>|]', '_', 'g')), ''), 'untitled'), 1, 200) AS safe FROM {values(fixtures.NAMES, 'name')} UNION ALL SELECT url, substr(coalesce(nullif(trim(regexp_replace(url, '[/\\\\:*?\"<>|]', '_', 'g')), ''), 'untitled'), 1, 200) FROM pages")
def safe_filename(spark, sf):
    names = frame(spark, fixtures.NAMES, "name string").unionByName(table(spark, sf, "pages").select(F.col("url").alias("name")))
    return names.select("name", tx.safe_filename(F.col("name")).alias("safe"))


@query(f"SELECT path, CASE WHEN ext IN ('pdf', 'docx') THEN 'pdf' WHEN ext IN ('md', 'mkd') THEN 'markdown' ELSE 'web' END AS source_type, regexp_replace(path, '[/\\\\]', '_', 'g') AS doc_id FROM (SELECT path, lower(regexp_extract(path, '\\.([^./\\\\]+)$', 1)) AS ext FROM (SELECT * FROM {values(fixtures.PATHS, 'path')} UNION ALL SELECT url FROM pages))")
def source_type(spark, sf):
    p = F.col("path")
    paths = frame(spark, fixtures.PATHS, "path string").unionByName(table(spark, sf, "pages").select(F.col("url").alias("path")))
    return paths.select("path", tx.source_type(p).alias("source_type"), tx.doc_id_of(p).alias("doc_id"))


_TYPES = "('PERSON', 'ORG', 'PRODUCT', 'LOCATION', 'CONCEPT')"


@query(
    f"""SELECT id, concat_ws('; ',
  CASE WHEN coalesce(trim(title), '') = '' THEN 'title missing' WHEN length(trim(title)) > 200 THEN 'title too long' END,
  CASE WHEN tags IS NULL THEN 'tags not a list' WHEN len(tags) NOT BETWEEN 1 AND 5 THEN 'tags not 1 to 5' WHEN len(list_filter(tags, lambda t: coalesce(trim(t), '') = '')) > 0 THEN 'tag empty or not text' END,
  CASE WHEN len(list_filter(entities, lambda e: e.type NOT IN {_TYPES})) > 0 THEN 'entity type unknown' END,
  CASE WHEN coalesce(trim(body), '') = '' THEN 'body missing' END) AS problems FROM (SELECT CAST(id AS BIGINT) AS id, title, tags, entities, body FROM {values(fixtures.RESULTS, 'id, title, tags, entities, body')}
  UNION ALL SELECT 1000 + doc_id, substr(text, 1, 150 + doc_id % 100), list_resize([source, lang, 'x'], 1 + doc_id % 3), [{{'name': source, 'type': CASE WHEN doc_id % 4 = 0 THEN 'PLACE' ELSE 'ORG' END}}], text FROM documents)"""
)
def validate_output(spark, sf):
    r = frame(spark, fixtures.RESULTS, "id bigint, title string, tags array<string>, entities array<struct<name:string,type:string>>, body string")
    i = F.col("doc_id")
    kind = F.when(i % 4 == 0, "PLACE").otherwise("ORG")
    made = table(spark, sf, "documents").select((i + 1000).alias("id"), _text().substr(F.lit(1), (150 + i % 100).cast("int")).alias("title"), F.slice(F.array("source", "lang", F.lit("x")), F.lit(1), (1 + i % 3).cast("int")).alias("tags"), F.array(F.struct(F.col("source").alias("name"), kind.alias("type"))).alias("entities"), _text().alias("body"))
    r = r.unionByName(made)
    return r.select("id", F.array_join(formatting.validate(F.col("title"), F.col("tags"), F.col("entities"), F.col("body")), "; ").alias("problems"))


@query(f"SELECT id, array_to_string(list_filter(tags, lambda t: NOT (regexp_matches(trim(t), '^\\pL+$') AND NOT (trim(t) = upper(trim(t)) AND length(trim(t)) >= 2) AND (length(trim(t)) < 4 OR regexp_matches(lower(t), '(ing|tion|ment|ness)$')))), ',') AS tags FROM (SELECT CAST(id AS BIGINT) AS id, tags FROM {values(fixtures.TAGS, 'id, tags')} UNION ALL SELECT 1000 + doc_id, string_split(substr(text, 1, 60), ' ') FROM documents WHERE text IS NOT NULL)")
def fix_tags(spark, sf):
    more = table(spark, sf, "documents").where("text IS NOT NULL").select((F.col("doc_id") + 1000).alias("id"), F.split(F.substring(_text(), 1, 60), " ").alias("tags"))
    return frame(spark, fixtures.TAGS, "id bigint, tags array<string>").unionByName(more).select("id", F.array_join(formatting.fixed_tags(F.col("tags")), ",").alias("tags"))


@query("SELECT doc_id, md5(concat_ws('|', source, sha256('Source type: ' || source || chr(10) || chr(10) || 'Document:' || chr(10) || text), sha256(text))) AS key FROM documents")
def cache_key(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", formatting.cache_key(F.col("source"), formatting.user_prompt(F.col("source"), _text()), _text()).alias("key"))


# -- pages


@query("SELECT page_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title FROM pages")
def page_title(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1).alias("title"))


@query()
def html_extract(spark, sf):
    return table(spark, sf, "pages").select("page_id", files.html_text_column(F.col("html")).alias("text"))


# -- whole plans


def _as_files(spark, sf):
    d = table(spark, sf, "documents")
    return d.select(F.col("doc_id").cast("string").alias("doc_id"), F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("source_file"), _text())


_CLEAN = f"(SELECT 'doc' || doc_id || '.txt' AS k, text FROM ({CLEANED}) WHERE doc_id >= 0)"


@query(f"SELECT text, k AS source FROM ({pieces_sql(_CLEAN, 512, 64)})")
def traditional_chunks(spark, sf):
    return ingest.chunk_files(_as_files(spark, sf)).select("text", F.col("metadata")["source"].alias("source"))


@query()
def index_chunks(spark, sf):
    chunks, _ = ingest.build_index(_as_files(spark, sf))
    return store.with_defaults(chunks).drop("embedding")


@query()
def index_documents(spark, sf):
    return ingest.build_index(_as_files(spark, sf))[1].drop("embedding")


@query(
    f"""SELECT doc_id, name || CASE WHEN n > 0 THEN '-' || n ELSE '' END || '.md' AS file_name FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY doc_id) - 1 AS n FROM
  (SELECT CAST(doc_id AS VARCHAR) AS doc_id, substr(coalesce(nullif(trim(regexp_replace(coalesce(nullif(trim(regexp_extract(text, '(?m)^#\\s+(.+)$', 1)), ''), 'Untitled'), '[/\\\\:*?"<>|]', '_', 'g')), ''), 'untitled'), 1, 200) AS name FROM documents))"""
)
def markdown_names(spark, sf):
    return ingest.to_markdown(_as_files(spark, sf)).select("doc_id", "file_name")


@query()
def markdown_files(spark, sf):
    return ingest.to_markdown(_as_files(spark, sf))


@query("SELECT conv_id, turn, '{\"title\": \"t\", \"body\": ' || CAST(to_json(text) AS VARCHAR) || '}' AS reply FROM conversations")
def json_repair(spark, sf):
    c = table(spark, sf, "conversations")
    raw = F.concat(F.lit('```json\n{"title": "t", "body": "'), F.regexp_replace("text", r"\n", r"\\n"), F.lit('"}\n```'))
    return c.select("conv_id", "turn", formatting.parsed_json_column(raw).alias("reply"))


@query()
def answer_questions(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), _text(), F.col("doc_id").cast("string").alias("source_doc_id"), F.array("lang").alias("section_path"), tx.count_words(_text()).alias("word_count"), vx.hash_embedding(_text(), 64).cast("array<float>").alias("embedding"))
    rows = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("source_file"), F.col("source").alias("title"), F.substring(_text(), 1, 1000).alias("text_summary"), vx.hash_embedding(_text(), 64).cast("array<float>").alias("embedding"))
    return answer.answer(asked(spark, sf), docs, rows, k=3, fetch_k=6, config=Config(embedding_mode="hash", embedding_dim=64)).withColumn("sources", F.array_join("sources", ","))
