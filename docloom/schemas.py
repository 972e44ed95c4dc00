"""Schemas of the index tables and of what flows between the operators."""

from __future__ import annotations

from pyspark.sql import types as T

STRINGS = T.ArrayType(T.StringType())
VECTOR = T.ArrayType(T.FloatType())

#: Fine index: one row per chunk, key (source_doc_id, chunk_index).
CHUNKS = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("embedding", VECTOR),
        T.StructField("source_doc_id", T.StringType()),
        T.StructField("chunk_index", T.IntegerType()),
        T.StructField("section_path", STRINGS),
        T.StructField("word_count", T.IntegerType()),
        T.StructField("entity_names", STRINGS),
    ]
)

#: Coarse index: one row per document, key source_file.
DOCUMENTS = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("title", T.StringType()),
        T.StructField("tags", STRINGS),
        T.StructField("text_summary", T.StringType()),
        T.StructField("source_file", T.StringType()),
        T.StructField("total_chunks", T.IntegerType()),
        T.StructField("embedding", VECTOR),
        T.StructField("created_at", T.TimestampType()),
    ]
)

#: What chunking makes of one text.
CHUNK_LIST = T.ArrayType(
    T.StructType(
        [
            T.StructField("chunk_index", T.IntegerType()),
            T.StructField("text", T.StringType()),
            T.StructField("section_path", STRINGS),
            T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
        ]
    )
)

SECTION = T.StructType([T.StructField("level", T.IntegerType()), T.StructField("title", T.StringType())])
ENTITY = T.StructType([T.StructField("name", T.StringType()), T.StructField("type", T.StringType())])
ENTITY_TYPES = ("PERSON", "ORG", "PRODUCT", "LOCATION", "CONCEPT")

#: A formatted document, usable with from_json.
FORMAT_RESULT = T.StructType(
    [
        T.StructField("title", T.StringType()),
        T.StructField("tags", STRINGS),
        T.StructField(
            "metadata",
            T.StructType(
                [
                    T.StructField("source_type", T.StringType()),
                    T.StructField("source_file", T.StringType()),
                    T.StructField("total_words", T.IntegerType()),
                    T.StructField("sections", T.ArrayType(SECTION)),
                    T.StructField("created_at", T.StringType()),
                    T.StructField("modified_date", T.StringType()),
                    T.StructField("entities", T.ArrayType(ENTITY)),
                ]
            ),
        ),
        T.StructField("body", T.StringType()),
    ]
)
PART_RESULT = T.StructType([T.StructField("part_md", T.StringType()), T.StructField("summary", T.StringType())])
