"""Reading folders of files: one row a file, with a status instead of an exception."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.errors import ParseError, ParserNotFoundError
from docloom.functions import text as tx
from docloom.operators.kernels import kernel
from docloom.shipping import ship

Parser = Callable[[bytes], str]


def decode(data: bytes) -> str:
    """UTF-8 (with or without a mark), else GBK with replacements."""
    try:
        return data.decode("utf-8-sig")
    except UnicodeDecodeError:
        return data.decode("gbk", "replace")


class _Main(HTMLParser):
    """Collects the main text of a page as markdown-like blocks."""

    SKIP = {"script", "style", "noscript", "template", "nav", "aside", "footer", "form", "button", "select", "iframe", "svg", "head"}
    BLOCK = {"p", "div", "section", "article", "main", "header", "li", "ul", "ol", "table", "tr", "blockquote", "pre", "br", "hr", "figure", "figcaption", "dl", "dt", "dd", "h1", "h2", "h3", "h4", "h5", "h6"}
    VOID = {"br", "hr", "img", "input", "meta", "link", "source", "wbr", "col", "area", "base", "embed"}
    FURNITURE = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|banner|breadcrumbs?|comments?|cookie|menu|nav\w*|popup|promo|related|share|sidebar|social|sponsor\w*)(?:$|[\s_-])", re.I)

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple[bool, str]] = []  # (in the main part, text)
        self.open: list[tuple[str, bool, bool]] = []  # tag, skipped, main
        self.text = ""
        self.prefix = ""
        self.cells: list[str] | None = None
        self.title = ""
        self.in_title = False

    def _state(self) -> tuple[bool, bool]:
        return (self.open[-1][1], self.open[-1][2]) if self.open else (False, False)

    def flush(self) -> None:
        words = " ".join(self.text.split())
        if words:
            self.blocks.append((self._state()[1], self.prefix + words))
        self.text = self.prefix = ""

    def handle_starttag(self, tag, attrs) -> None:
        self.in_title |= tag == "title"
        skipped, main = self._state()
        if tag in ("td", "th"):
            if self.cells is not None and self.text.strip():
                self.cells.append(" ".join(self.text.split()))
                self.text = ""
        elif tag in self.BLOCK:
            self.flush()
            if tag[0] == "h" and tag[1:].isdigit():
                self.prefix = "#" * int(tag[1]) + " "
            elif tag == "li":
                self.prefix = "- "
            elif tag == "tr":
                self.cells = []
        if tag in self.VOID:
            return
        if tag == "p" and self.open and self.open[-1][0] == "p":  # an unclosed paragraph ends here
            self.open.pop()
            skipped, main = self._state()
        names = " ".join(v or "" for k, v in attrs if k in ("class", "id", "role"))
        skipped = skipped or tag in self.SKIP or tag not in ("html", "body", "article", "main") and bool(self.FURNITURE.search(names))
        self.open.append((tag, skipped, main or tag in ("article", "main")))

    def handle_endtag(self, tag) -> None:
        if tag == "title":
            self.in_title = False
        if tag in ("td", "th") and self.cells is not None:
            self.cells.append(" ".join(self.text.split()))
            self.text = ""
        elif tag == "tr" and self.cells is not None:
            if self.cells:
                self.blocks.append((self._state()[1], "| " + " | ".join(self.cells) + " |"))
            self.cells, self.text = None, ""
        elif tag in self.BLOCK:
            self.flush()
        if any(t == tag for t, _, _ in self.open):
            while self.open.pop()[0] != tag:
                pass

    def handle_data(self, data) -> None:
        if self.in_title:
            self.title += data
        if not self._state()[0]:
            self.text += data


def html_text(page: str | None) -> str:
    """The main text of a page: headings, paragraphs, lists and tables, without navigation, scripts and notices.

    If an article or main element holds text only that is taken. Comments in the markup don't count.
    """
    parser = _Main()
    parser.feed(page or "")
    parser.close()
    parser.flush()
    main = [t for m, t in parser.blocks if m]
    out, last = [], ""
    for t in main or [t for _, t in parser.blocks]:
        tight = t.startswith(("- ", "| ")) and last[:2] == t[:2]
        out.append(("\n" if tight else "\n\n") + t)
        last = t
    return "".join(out).strip()


def page_title(page: str | None) -> str:
    parser = _Main()
    parser.feed(page or "")
    return " ".join(parser.title.split())


html_text_column = kernel(html_text, T.StringType())


# -- office files, by their XML


def _xml(archive: zipfile.ZipFile, name: str) -> ElementTree.Element:
    return ElementTree.fromstring(archive.read(name))


def _local(e: ElementTree.Element) -> str:
    return e.tag.rpartition("}")[2]


def _open(data: bytes) -> zipfile.ZipFile:
    try:
        return zipfile.ZipFile(io.BytesIO(data))
    except zipfile.BadZipFile as e:
        raise ParseError("not a zip archive") from e


def _numbered(archive: zipfile.ZipFile, pattern: str) -> list[str]:
    names = [(int(m[1]), n) for n in archive.namelist() if (m := re.fullmatch(pattern, n))]
    return [n for _, n in sorted(names)]


def docx_text(data: bytes) -> str:
    out = []
    body = _xml(_open(data), "word/document.xml")
    for p in body.iter():
        if _local(p) == "tr":
            out.append("| " + " | ".join("".join(t.text or "" for t in c.iter() if _local(t) == "t") for c in p if _local(c) == "tc") + " |")
        elif _local(p) == "p":
            words = "".join(t.text or "" for t in p.iter() if _local(t) == "t")
            style = next((v for s in p.iter() if _local(s) == "pStyle" for v in s.attrib.values()), "")
            m = re.fullmatch(r"(?:Heading|heading )(\d)", style)
            mark = "# " if style == "Title" else "#" * int(m[1]) + " " if m else ""
            if words.strip() and not (out and out[-1].startswith("|") and words in out[-1]):
                out.append(mark + words)
    return "\n\n".join(out)


def pptx_text(data: bytes) -> str:
    archive = _open(data)
    slides = []
    for i, name in enumerate(_numbered(archive, r"ppt/slides/slide(\d+)\.xml"), 1):
        lines = ["".join(t.text or "" for t in p.iter() if _local(t) == "t") for p in _xml(archive, name).iter() if _local(p) == "p"]
        slides.append("\n\n".join([f"## Slide {i}", *[x for x in lines if x.strip()]]))
    return "\n\n".join(slides)


def xlsx_text(data: bytes) -> str:
    archive = _open(data)
    shared: list[str] = []
    if "xl/sharedStrings.xml" in archive.namelist():
        shared = ["".join(t.text or "" for t in s.iter() if _local(t) == "t") for s in _xml(archive, "xl/sharedStrings.xml") if _local(s) == "si"]
    sheets = []
    for i, name in enumerate(_numbered(archive, r"xl/worksheets/sheet(\d+)\.xml"), 1):
        rows = []
        for row in (r for r in _xml(archive, name).iter() if _local(r) == "row"):
            cells = []
            for c in (c for c in row if _local(c) == "c"):
                value = next((v.text or "" for v in c.iter() if _local(v) in ("v", "t")), "")
                cells.append(shared[int(value)] if c.attrib.get("t") == "s" and value.isdigit() else value)
            if any(cells):
                rows.append("| " + " | ".join(cells) + " |")
        if rows:
            width = rows[0].count("|") - 1
            sheets.append("\n".join([f"## Sheet {i}", "", rows[0], "|" + " --- |" * width, *rows[1:]]))
    return "\n\n".join(sheets)


def epub_text(data: bytes) -> str:
    archive = _open(data)
    root = next((e.attrib["full-path"] for e in _xml(archive, "META-INF/container.xml").iter() if _local(e) == "rootfile"), None)
    if root is None:
        raise ParseError("no package file")
    package = _xml(archive, root)
    items = {e.attrib.get("id"): e.attrib.get("href", "") for e in package.iter() if _local(e) == "item"}
    base = root.rpartition("/")[0]
    names = [f"{base}/{items.get(e.attrib.get('idref'), '')}".lstrip("/") for e in package.iter() if _local(e) == "itemref"]
    return "\n\n".join(x for n in names if n in archive.namelist() and (x := html_text(decode(archive.read(n)))))


def _unsupported(kind: str) -> Parser:
    def parse(data: bytes) -> str:
        raise ParserNotFoundError(f"no library for {kind} files is installed")

    return parse


#: Parsers by extension; ``register_parser`` adds to them.
PARSERS: dict[str, Parser] = {
    "txt": decode,
    "md": decode,
    "mkd": decode,
    "markdown": decode,
    "html": lambda b: html_text(decode(b)),
    "htm": lambda b: html_text(decode(b)),
    "docx": docx_text,
    "pptx": pptx_text,
    "xlsx": xlsx_text,
    "epub": epub_text,
    "pdf": _unsupported("pdf"),
    "xls": _unsupported("xls"),
}
ALIASES = {"markdown": ("md", "mkd"), "html": ("htm",)}


def register_parser(extension: str, parser: Parser) -> None:
    """Use ``parser`` for an extension (any case) and its aliases."""
    ext = extension.lower().lstrip(".")
    for e in (ext, *ALIASES.get(ext, ())):
        PARSERS[e] = parser


def scan_files(spark: SparkSession, folder: str, extensions: list[str] | None = None) -> DataFrame:
    """path, relative, ext, content of the files under a folder that have a registered extension (or one of these)."""
    wanted = sorted(x.lower().lstrip(".") for x in extensions or PARSERS)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    ext = F.lower(F.regexp_extract("path", r"\.([^./\\]+)$", 1))
    base = re.sub(r"^[a-z0-9]+:/+", "/", folder, flags=re.I).rstrip("/") + "/"
    plain = F.regexp_replace("path", r"^[a-z0-9]+:/+", "/")
    relative = F.when(plain.startswith(base), F.substring(plain, len(base) + 1, 1 << 30)).otherwise(plain)
    return files.select("path", relative.alias("relative"), ext.alias("ext"), "content").where(F.col("ext").isin(*wanted))


def parse_files(files: DataFrame) -> DataFrame:
    """doc_id, source_file, text, status, error of scanned files; unknown extensions are skipped, failures told."""
    ship(files.sparkSession)
    parsers = dict(PARSERS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, states, errors = [], [], []
            for ext, data in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                text = error = None
                if ext not in parsers:
                    state = "skipped"
                else:
                    try:
                        text, state = parsers[ext](data), "ok"
                    except Exception as e:
                        state, error = "failed", f"{type(e).__name__}: {e}"
                texts.append(text)
                states.append(state)
                errors.append(error)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(states, pa.string()), pa.array(errors, pa.string())], names=["source_file", "text", "status", "error"])

    done = files.select(F.col("relative").alias("source_file"), "ext", "content").mapInArrow(run, "source_file string, text string, status string, error string")
    return done.withColumn("doc_id", tx.doc_id_of(F.col("source_file")))


def read_documents(spark: SparkSession, folder: str, extensions: list[str] | None = None) -> DataFrame:
    """Scan and parse a folder."""
    return parse_files(scan_files(spark, folder, extensions))
