"""The text operators as SQL functions of a session."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from docloom.operators import chunking, cleaning, formatting, markdown
from docloom.shipping import ship
from docloom.sources import files

FUNCTIONS = {
    "mend_tables": cleaning.mend_tables_column,
    "normalize_markdown": markdown.normalize_column,
    "strip_references": markdown.strip_references_column,
    "wikilinks": markdown.wikilinks_column,
    "render_markdown": markdown.render_column,
    "split_sentences": chunking.sentences_column,
    "split_paragraphs": chunking.split_paragraphs_column,
    "html_text": files.html_text_column,
    "extract_json": formatting.extract_json_column,
    "mend_json": formatting.escape_body_quotes_column,
    "parse_reply": formatting.parsed_json_column,
    "format_problems": formatting.problems_column,
}


@udtf(returnType="chunk_index int, text string, section_path array<string>")
class ChunkMarkdown:
    """chunk_markdown(text, size, overlap) for LATERAL joins."""

    def eval(self, text: str, size: int, overlap: int):
        size, overlap = chunking.check_sizes(size, overlap)
        for c in chunking.chunk_markdown(text, size, overlap):
            yield c["chunk_index"], c["text"], c["section_path"]


def register(spark: SparkSession) -> list[str]:
    """Register all functions; returns their names."""
    ship(spark)
    for name, column in FUNCTIONS.items():
        spark.udf.register(name, column.udf)
    spark.udtf.register("chunk_markdown", ChunkMarkdown)
    return [*FUNCTIONS, "chunk_markdown"]
