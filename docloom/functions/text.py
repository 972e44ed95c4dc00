"""Text functions as column expressions: counting, cleaning, titles, names.

Everything here stays inside the JVM. Patterns are Java regular expressions; ``(?U)`` makes \\s, \\w
and \\S follow Unicode.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# The character ranges that count as CJK (ideographs, then kana).
CJK_RANGES = r"\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{20000}-\x{2A6DF}\x{2A700}-\x{2EBEF}\x{3040}-\x{309F}\x{30A0}-\x{30FF}"
CJK = f"[{CJK_RANGES}]"
#: The basic ideographs only, for script detection, bigrams and the token estimate.
HAN = r"[\x{4E00}-\x{9FFF}]"


def _count(text: Column, pattern: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0))


# -- counting


def contains_cjk(text: Column) -> Column:
    return text.rlike(CJK)


def count_cjk(text: Column) -> Column:
    return _count(text, CJK)


def count_words(text: Column) -> Column:
    """CJK characters, plus runs of other non-space characters once those are taken out."""
    return count_cjk(text) + _count(F.regexp_replace(text, CJK, ""), r"(?U)\S+")


def whitespace_words(text: Column) -> Column:
    return _count(text, r"(?U)\S+")


def cjk_ratio(text: Column) -> Column:
    """CJK characters, of these and ASCII letters and digits."""
    cjk, latin = count_cjk(text), _count(text, "[A-Za-z0-9]")
    return F.when(cjk + latin > 0, cjk / (cjk + latin)).otherwise(F.lit(0.0))


def effective_threshold(text: Column, base: int = 20000) -> Column:
    """The length from which a text is formatted in parts: ``base`` for Latin, a quarter for CJK, the same number of tokens between."""
    r = cjk_ratio(text)
    mixed = F.lit(base / 4.0) / (r / 1.0 + (F.lit(1.0) - r) / 4.0)
    return F.when(r <= 0, F.lit(base)).otherwise(F.greatest(F.lit(1), mixed.cast("int")))


def script(text: Column) -> Column:
    """'cjk' if ideographs are over 15 % of ideographs and Latin letters, else 'latin'."""
    han, latin = _count(text, HAN), _count(text, "[A-Za-z]")
    return F.when((han + latin > 0) & (han / (han + latin) > 0.15), "cjk").otherwise("latin")


def token_estimate(text: Column) -> Column:
    """Ideographs, a quarter of ASCII letters and digits, half of the rest (each rounded down)."""
    han, ascii_, n = _count(text, HAN), _count(text, "[A-Za-z0-9]"), F.coalesce(F.length(text), F.lit(0))
    return (han + F.floor(ascii_ / 4) + F.floor((n - han - ascii_) / 2)).cast("int")


# -- cleaning, in this order


def drop_control(text: Column) -> Column:
    # fixed value: the control characters that go
    return F.regexp_replace(text, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")


# Fixed value: what a page break looks like.
PAGE_BREAK = r"(?U)^(?:[-=_*]\s*){3,}[\w\s]*?(?:[-=_*]\s*){2,}$"


def lines_of(text: Column) -> Column:
    """Lines at any Unicode line end; a last line end opens no further line."""
    parts = F.split(text, r"\R", -1)
    return F.when((F.size(parts) > 0) & (F.element_at(parts, -1) == ""), F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def strip(text: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def drop_page_breaks(text: Column) -> Column:
    """Without lines of more than 8 characters that are a rule with at most a label in it."""
    # few lines begin like a rule: the others are not looked at any further
    kept = F.filter(lines_of(text), lambda x: ~(x.rlike(r"(?U)^\s*[-=_*]") & (F.length(strip(x)) > 8) & strip(x).rlike(PAGE_BREAK)))
    return F.array_join(kept, "\n")


def collapse_space(text: Column) -> Column:
    spaced = F.regexp_replace(text, r"[\t\x0b\f]+", " ")
    return F.regexp_replace(F.regexp_replace(spaced, r"(?m) +$", ""), r"\n{3,}", "\n\n")


def clean(text: Column, repair=None, rules=None) -> Column:
    """All cleaning steps. ``repair`` mends tables and ``rules`` applies custom rules (column functions)."""
    out = drop_page_breaks(drop_control(F.coalesce(text, F.lit(""))))
    for step in (repair, rules):
        out = step(out) if step else out
    return strip(collapse_space(out))


# -- titles and outlines


def title_of(markdown: Column, default: str = "Untitled") -> Column:
    """The first level-1 heading."""
    return F.coalesce(F.nullif(strip(F.regexp_extract(markdown, r"(?m)^#\s+(.+)$", 1)), F.lit("")), F.lit(default))


def outline(markdown: Column) -> Column:
    """The level-2 and level-3 headings as struct(level, title)."""
    marks = F.regexp_extract_all(markdown, F.lit(r"(?m)^(#{2,3})[ \t]+(.+)$"), F.lit(1))
    names = F.regexp_extract_all(markdown, F.lit(r"(?m)^(#{2,3})[ \t]+(.+)$"), F.lit(2))
    return F.zip_with(marks, names, lambda m, t: F.struct(F.length(m).alias("level"), strip(t).alias("title")))


def section_path(h1: Column, h2: Column, h3: Column) -> Column:
    """The headings in force, without the first level where there is a deeper one; else General."""
    filled = lambda h: (h.isNotNull()) & (F.trim(h) != "")
    parts = F.filter(F.array(h1, h2, h3), filled)
    deeper = F.coalesce(filled(h1), F.lit(False)) & (F.size(parts) > 1)
    return F.when(F.size(parts) == 0, F.array(F.lit("General"))).when(deeper, F.slice(parts, F.lit(2), F.size(parts))).otherwise(parts)


def section_header(path: Column) -> Column:
    """Headings for a section path, one level below its length; General has none."""
    marks = F.repeat(F.lit("#"), F.size(path) + 1)
    shown = F.array_join(F.transform(path, lambda s: F.concat(marks, F.lit(" "), s)), "\n\n")
    return F.when((F.size(path) <= 0) | (F.array_join(path, "\n") == "General"), F.lit("")).otherwise(shown)


def drop_duplicate_title(markdown: Column, title: Column) -> Column:
    """Without level-1 heading lines that start with the title."""
    first = lambda x: x.rlike(r"^\s*#\s") & F.startswith(F.ltrim(x), F.concat(F.lit("# "), title))
    return F.array_join(F.filter(F.split(markdown, "\n", -1), lambda x: ~first(x)), "\n")


def last_lines(text: Column, n: int = 10) -> Column:
    """The last n non-empty lines."""
    full = F.filter(F.split(text, "\n", -1), lambda x: F.trim(x) != "")
    return F.array_join(F.slice(full, F.greatest(F.size(full) - n, F.lit(0)) + 1, F.lit(n)), "\n")


def summary(title: Column, tags: Column, body: Column, head: int = 800, tail: int = 400) -> Column:
    """Title, tags and the body's first ``head`` characters; of long bodies its last ``tail``, too."""
    body = F.coalesce(body, F.lit(""))
    ending = F.concat(F.lit("\n...\n"), F.substring(body, -tail, tail)) if tail else F.lit("")
    cut = F.concat(F.substring(body, 1, head), F.when(F.length(body) > head + tail, ending).otherwise(F.lit("")))
    return strip(F.concat(F.lit("Title: "), title, F.lit("\nTags: "), F.array_join(F.coalesce(tags, F.array().cast("array<string>")), " "), F.lit("\n"), cut))


# Words that open a reference section, and the decoration that may stand around them.
REFERENCE_WORDS = "references?|reference list|bibliography|further reading|works cited|sources?|footnotes?|endnotes?|citations?|see also|external links"
REFERENCE_CJK = "参考文献|参考资料|参考文獻|參考資料|引用文献|引用文獻|延伸閱讀|延伸阅读|脚注|注脚|註腳|文獻|注释|註釋|参考|參考|引用|外部链接|外部連結"
NUMBERING = r"[\s(（\[【]*[0-9一二三四五六七八九十]+[.、.)）】\]]*\s*"
DECORATION = r"[\s0-9一二三四五六七八九十百千零〇两.,;:!?)('\"“”’\-—–·。、；：！？（）【】《》\[\]]*"
REFERENCE_TITLE = rf"^\s*(?:{NUMBERING})?(?:(?:(?i:{REFERENCE_WORDS})\b)|(?:{REFERENCE_CJK})){DECORATION}$"


def is_reference_title(title: Column) -> Column:
    """Whether a heading opens a list of references: a keyword first, then only decoration."""
    return title.rlike(REFERENCE_TITLE)


# -- names


def source_type(path: Column) -> Column:
    """pdf, markdown or web, by extension."""
    ext = F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))
    return F.when(ext.isin("pdf", "docx"), "pdf").when(ext.isin("md", "mkd"), "markdown").otherwise("web")


def doc_id_of(path: Column, unique: bool = False) -> Column:
    """A relative path as an identifier; with ``unique`` a hash keeps a/b and a_b apart."""
    flat = F.regexp_replace(path, r"[/\\]", "_")
    return F.concat(flat, F.lit("-"), F.substring(F.sha2(path, 256), 1, 8)) if unique else flat


def safe_filename(title: Column) -> Column:
    """A file name without the characters that file systems refuse, 200 at most."""
    plain = strip(F.regexp_replace(title, r'[/\\:*?"<>|]', "_"))
    return F.substring(F.coalesce(F.nullif(plain, F.lit("")), F.lit("untitled")), 1, 200)


def metadata_block(words: Column, sections: Column) -> Column:
    """The word count and the numbered outline as markdown; null without either."""
    shown = F.transform(sections, lambda s, i: F.concat((i + 1).cast("string"), F.lit(". "), F.repeat(F.lit("  "), F.greatest(s["level"] - 3, F.lit(0))), F.lit("**"), s["title"], F.lit("**")))
    head = F.when(words > 0, F.concat(F.lit("- **Words:** "), words.cast("string")))
    listed = F.when(F.size(sections) > 0, F.concat(F.lit("\n- **Sections:**\n"), F.array_join(shown, "\n")))
    return F.nullif(F.concat_ws("\n", head, listed), F.lit(""))


# -- tokens


def _folding() -> tuple[str, str]:
    """Accented Latin letters and the letters they are folded to (by canonical decomposition)."""
    pairs = []
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        c = chr(code)
        base = unicodedata.normalize("NFD", c)
        if len(base) > 1 and base[0].isascii() and all(unicodedata.combining(x) for x in base[1:]):
            pairs.append((c, base[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, PLAIN = _folding()


def folded(text: Column) -> Column:
    """Lower case without Latin accents."""
    return F.translate(F.lower(text), ACCENTED, PLAIN)


def index_tokens(text: Column, compat: bool = False) -> Column:
    """Full-text tokens: runs of letters and digits, folded; every CJK character by itself.

    With ``compat`` a CJK run is one token, as in a plain word index.
    """
    other = r"(?U)[\p{L}\p{N}\p{Co}&&[^" + CJK_RANGES + "]]+"
    return F.regexp_extract_all(folded(F.coalesce(text, F.lit(""))), F.lit(r"(?U)[\p{L}\p{N}\p{Co}]+" if compat else f"{CJK}|{other}"), F.lit(0))


def query_terms(text: Column, compat: bool = False) -> Column:
    """The terms of a question: the tokens of the index without single Latin letters or digits.

    ``compat``: ASCII runs of two or more and single CJK characters, accents cut words.
    """
    if compat:
        found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"[A-Za-z0-9]+|{CJK}"), F.lit(0))
    else:
        found = index_tokens(text)
    return F.filter(found, lambda t: (F.length(t) > 1) | t.rlike(CJK))


def lexical_tokens(text: Column) -> Column:
    """Lower-case ASCII words of two letters or more, then CJK characters."""
    t = F.coalesce(text, F.lit(""))
    words = F.transform(F.regexp_extract_all(t, F.lit("[a-zA-Z]{2,}"), F.lit(0)), F.lower)
    return F.concat(words, F.regexp_extract_all(t, F.lit(CJK), F.lit(0)))


def lexical_score(query: Column, text: Column) -> Column:
    """The share of the query's tokens that the text holds (as often as it holds them)."""

    def score(q: Column, t: Column) -> Column:
        times = lambda xs, x: F.size(F.filter(xs, lambda y: y == x))
        hits = F.aggregate(F.array_distinct(q), F.lit(0), lambda acc, x: acc + F.least(times(q, x), times(t, x)))
        return F.when(F.size(q) == 0, F.lit(0.0)).otherwise(hits / F.size(q))

    both = F.array(F.struct(lexical_tokens(query).alias("q"), lexical_tokens(text).alias("t")))
    return F.element_at(F.transform(both, lambda p: score(p["q"], p["t"])), 1)
