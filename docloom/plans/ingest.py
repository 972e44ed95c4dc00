"""Documents to index tables: one lazy plan from text to chunks and document rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.config import Config
from docloom.functions import text as tx
from docloom.operators import formatting
from docloom.operators import markdown as md
from docloom.operators.chunking import check_sizes, chunker
from docloom.operators.cleaning import clean_text, load_rules
from docloom.operators.embedding import Embedder, embed_column
from docloom.operators.tags import extract_tags, matched_entities
from docloom.plans.store import Index
from docloom.schemas import ENTITY
from docloom.sources.files import read_documents
from docloom.staging import file_system, library


def chunk_files(docs: DataFrame, size: int = 512, overlap: int = 64, rules: list[dict] | None = None) -> DataFrame:
    """The plain path: clean and chunk documents (source_file, text); text and metadata{source} per chunk."""
    check_sizes(size, overlap)
    chunks = docs.where("text IS NOT NULL").select("source_file", F.explode(chunker(size, overlap)(clean_text(F.col("text"), rules))).alias("c"))
    return chunks.select(F.col("c.text").alias("text"), F.create_map(F.lit("source"), F.col("source_file")).alias("metadata"))


def existing(docs: DataFrame) -> DataFrame:
    """Documents with a ``markdown`` of their own as ``formatted`` gives them: title and front matter's tags of it, no entities."""
    page = F.col("markdown")
    none = F.array().cast(f"array<{ENTITY.simpleString()}>")
    return docs.select("doc_id", "source_file", "text", tx.title_of(page, "Untitled").alias("title"), md.front_matter_tags_column(page).alias("tags"), tx.outline(page).alias("sections"), none.alias("entities"), md.without_front_matter_column(page).alias("body"), F.lit("ok").alias("status"), F.lit(None).cast("string").alias("error"))


def formatted(docs: DataFrame, config: Config, model: Callable[[], formatting.Model] | None = None, rules: list[dict] | None = None, cache: str | None = None) -> DataFrame:
    """Documents (doc_id, source_file, text) with title, tags, sections, entities, body, status, error.

    Documents that have a ``markdown`` already (an optional column) keep it and are not formatted.
    Without a model the body is normalised deterministically. A model is called once for each
    distinct text, and not for what ``cache`` holds; documents that it formatted in parts get the
    tags that their body's words suggest. ``rules`` are those of the configuration's file if not given.
    """
    rules = rules if rules is not None else load_rules(config.clean_rules) if config.clean_rules else None
    if "markdown" in docs.columns:
        has = F.coalesce(F.trim("markdown") != "", F.lit(False))
        fresh = formatted(docs.where(~has).drop("markdown"), config, model, rules, cache)
        return existing(docs.where(has)).unionByName(fresh.select("doc_id", "source_file", "text", "title", "tags", "sections", "entities", "body", "status", "error"))
    cleaned = docs.withColumn("text", clean_text(F.col("text"), rules))
    if model is None:
        plain = formatting.format_plain(cleaned)
        return plain.withColumns({"entities": F.array().cast(f"array<{ENTITY.simpleString()}>"), "status": F.coalesce(F.col("status"), F.lit("ok")) if "status" in docs.columns else F.lit("ok"), "error": F.col("error") if "error" in docs.columns else F.lit(None).cast("string")})
    done = formatting.format_documents(cleaned, model, config, cache=cache)
    rows = cleaned.drop("status", "error").join(done, "doc_id", "left")
    rows = rows.select("doc_id", "source_file", "text", F.col("result.title").alias("title"), formatting.fixed_tags(F.col("result.tags")).alias("tags"), F.col("result.tags").isNull().alias("_untagged"), F.col("result.metadata.sections").alias("sections"), F.col("result.metadata.entities").alias("entities"), F.col("result.body").alias("body"), "status", "error")
    rows = library.written(rows, "formatted")
    found = extract_tags(rows.where("_untagged").select("doc_id", "title", "body")).withColumnRenamed("tags", "_found")
    return rows.join(found, "doc_id", "left").withColumn("tags", F.when(F.col("_untagged"), F.coalesce("_found", "tags")).otherwise(F.col("tags"))).drop("_found", "_untagged")


def numbered_in_groups(keys: DataFrame, group: str, order: str) -> DataFrame:
    """``keys`` with ``_n``, from 0 in each group in the given order; no group is brought into one task.

    A range sort by (group, order) numbers rows within its partitions; how many rows of its group
    came before a partition is a sum over one row for each partition's first and last group.
    """
    from pyspark.sql import Window

    low = (1 << 33) - 1
    placed = library.written(library.written(keys, "names").orderBy(group, order).withColumn("_mid", F.monotonically_increasing_id()), "names-sorted")
    placed = placed.withColumn("_part", F.shiftright("_mid", 33)).withColumn("_at", F.col("_mid").bitwiseAND(F.lit(low)))
    begins = placed.groupBy("_part", group).agg(F.min("_at").alias("_begin"), F.count(F.lit(1)).alias("_rows"))
    # a group goes on in a partition if it begins it; groups that lie within one partition start from 0
    spread = begins.groupBy(group).agg(F.count(F.lit(1)).alias("_p")).where("_p > 1").select(group)
    before = F.coalesce(F.sum("_rows").over(Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifted = begins.join(spread, group).withColumn("_before", before).select(group, "_part", "_before")
    rows = placed.join(begins.select("_part", group, "_begin"), ["_part", group]).join(shifted, ["_part", group], "left")
    return rows.withColumn("_n", F.col("_at") - F.col("_begin") + F.coalesce("_before", F.lit(0))).drop("_part", "_at", "_mid", "_begin", "_before")


def to_markdown(docs: DataFrame, config: Config | None = None, model: Callable[[], formatting.Model] | None = None, cache: str | None = None) -> DataFrame:
    """doc_id, file_name, markdown of documents (doc_id, source_file, text).

    Documents of one title get file names with -1, -2 and so on, in the order of doc_id.
    """
    rows = formatted(docs, config or Config(), model, cache=cache).where("title IS NOT NULL")
    meta = F.struct(F.lit(None).cast("string").alias("source_type"), F.col("source_file").alias("source_file"), tx.whitespace_words(F.col("body")).alias("total_words"), F.col("sections").alias("sections"), F.lit(None).cast("string").alias("created_at"), F.lit(None).cast("string").alias("modified_date"), F.col("entities").alias("entities"))
    shown = md.format_markdown_column(F.struct("title", "tags", meta.alias("metadata"), "body"))
    name = tx.safe_filename(F.col("title")).alias("_name")
    numbers = numbered_in_groups(rows.select("doc_id", name), "_name", "doc_id").select(F.col("doc_id").alias("_id"), "_name", "_n")
    pages = rows.select("doc_id", name, shown.alias("markdown"))
    named = pages.join(numbers, (F.col("doc_id") == F.col("_id")) & (pages["_name"] == numbers["_name"])).select("doc_id", numbers["_name"], "_n", "markdown")
    return named.select("doc_id", F.concat("_name", F.when(F.col("_n") > 0, F.concat(F.lit("-"), F.col("_n"))).otherwise(F.lit("")), F.lit(".md")).alias("file_name"), "markdown")


def write_markdown(files: DataFrame, folder: str) -> None:
    """Write (file_name, markdown) rows as files of a folder on any file system that Spark writes to.

    Where a file of the same title with the same content exists it is left alone, so writing again
    changes nothing; where files of that title have other content, a new one gets the number after
    theirs. Spark writes each text as a file, and the driver moves the new files to their names.
    """
    spark = files.sparkSession
    fs, path = file_system(spark, folder)
    fs.mkdirs(path(folder))
    base = lambda name: F.regexp_replace(name, r"(-[0-9]+)?\.md$", "")
    page = F.concat(F.regexp_replace("markdown", r"\n\z", ""), F.lit("\n"))  # as Spark's text writer ends a file
    held = library.written(files.select("file_name", page.alias("page"), F.sha2(page, 256).alias("h"), base(F.col("file_name")).alias("base")), "pages")
    name = F.regexp_extract("path", "([^/]+)$", 1)
    old = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").load(folder).select(name.alias("name"), F.sha2("content", 256).alias("h"))
    old = library.written(old.select("h", base(F.col("name")).alias("base"), F.coalesce(F.regexp_extract("name", r"-([0-9]+)\.md$", 1).try_cast("long"), F.lit(0)).alias("n")), "files")
    new = held.join(old.select("base", "h"), ["base", "h"], "left_anti")
    new = new.join(old.groupBy("base").agg((F.max("n") + 1).alias("next")), "base", "left")
    number = numbered_in_groups(new.where("next IS NOT NULL").select("base", "file_name"), "base", "file_name")
    moved = new.join(number, ["base", "file_name"], "left").withColumn("name", F.coalesce(F.concat("base", F.lit("-"), F.col("next") + F.col("_n"), F.lit(".md")), "file_name"))
    named = library.written(moved.select("name", F.expr("substring(page, 1, length(page) - 1)").alias("page"), F.monotonically_increasing_id().alias("f")), "named")
    made = library.new_path(spark, "md-files")
    named.select("f", "page").write.partitionBy("f").text(made)
    for r in named.select("f", "name").toLocalIterator():
        for part in fs.globStatus(path(f"{made}/f={r['f']}/part-*")):
            fs.rename(part.getPath(), path(f"{folder}/{r['name']}"))


def build_index(docs: DataFrame, config: Config | None = None, model: Callable[[], formatting.Model] | None = None, embedder: Callable[[], Embedder] | None = None, rules: list[dict] | None = None, cache: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Chunks and documents of a table (doc_id, source_file, text): format, render, drop references, chunk, match entities, embed.

    With a model or an embedder, what they give is written out once for both tables.
    """
    config = config or Config(embedding_mode="hash")
    rows = formatted(docs, config, model, rules, cache).where("body IS NOT NULL AND trim(body) <> ''")
    page = md.strip_references_column(md.render_column(F.col("title"), F.col("body")))
    pieces = rows.select(F.col("doc_id").cast("string").alias("source_doc_id"), "entities", F.explode(chunker(config.chunk_size, config.chunk_overlap, config.heading_levels)(page)).alias("c"))
    named = F.filter(F.coalesce("entities", F.array().cast(f"array<{ENTITY.simpleString()}>")), lambda e: e["name"] != "")
    chunks = pieces.select("source_doc_id", "c.chunk_index", "c.text", "c.section_path", matched_entities(F.col("c.text"), named).alias("entity_names"))
    chunks = embed_column(chunks, "text", "embedding", config, embedder)
    totals = chunks.groupBy("source_doc_id").agg(F.count(F.lit(1)).cast("int").alias("total_chunks"))
    documents = rows.join(totals, F.col("doc_id").cast("string") == F.col("source_doc_id"), "left").select("title", "tags", tx.summary(F.col("title"), F.col("tags"), F.col("body")).alias("text_summary"), "source_file", F.coalesce("total_chunks", F.lit(0)).alias("total_chunks"))
    documents = embed_column(documents, "text_summary", "embedding", config, embedder)
    return chunks, documents


def ingest_markdown(files: DataFrame, config: Config | None = None, embedder: Callable[[], Embedder] | None = None) -> tuple[DataFrame, DataFrame]:
    """Chunks and documents of existing markdown (doc_id, source_file, text): tags of the front matter, which itself is not chunked."""
    config = config or Config(embedding_mode="hash")
    rows = files.where("text IS NOT NULL").select(F.col("doc_id").cast("string").alias("source_doc_id"), "source_file", md.front_matter_tags_column(F.col("text")).alias("tags"), md.without_front_matter_column(F.col("text")).alias("body"))
    chunks = rows.select("source_doc_id", F.explode(chunker(config.chunk_size, config.chunk_overlap, config.heading_levels)(F.col("body"))).alias("c")).select("source_doc_id", "c.chunk_index", "c.text", "c.section_path")
    chunks = embed_column(chunks, "text", "embedding", config, embedder)
    totals = chunks.groupBy("source_doc_id").agg(F.count(F.lit(1)).cast("int").alias("total_chunks"))
    documents = rows.join(totals, "source_doc_id", "left").withColumn("title", tx.title_of(F.col("body"), "Untitled")).select("title", "tags", tx.summary(F.col("title"), F.col("tags"), F.col("body")).alias("text_summary"), "source_file", F.coalesce("total_chunks", F.lit(0)).alias("total_chunks"))
    return chunks, embed_column(documents, "text_summary", "embedding", config, embedder)


def ingest_folder(spark: SparkSession, folder: str, index: Index, config: Config | None = None, model: Callable[[], formatting.Model] | None = None, embedder: Callable[[], Embedder] | None = None, extensions: list[str] | None = None, cache: str | None = None) -> DataFrame:
    """Read a folder into an index; returns source_file, status, error of every file. A bad file stops nothing."""
    docs = read_documents(spark, folder, extensions)
    chunks, documents = build_index(docs.where("status = 'ok'"), config, model, embedder, cache=cache)
    index.replace(chunks, documents)
    library.release(spark)
    return docs.select("source_file", "status", "error")
