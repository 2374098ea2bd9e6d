"""Schemas of the chunk table, the vector collection and the manifest."""

from __future__ import annotations

from pyspark.sql import types as T

CHUNK = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("pdf_name", T.StringType()),
        T.StructField("file_hash", T.StringType()),
        T.StructField("pipeline_version", T.StringType()),
        T.StructField("page_number", T.IntegerType()),
        T.StructField("chunk_index", T.IntegerType()),
        T.StructField("pdf_path", T.StringType()),
        T.StructField("char_count", T.IntegerType()),
        T.StructField("word_count", T.IntegerType()),
        T.StructField("has_numbers", T.BooleanType()),
        T.StructField("has_formula", T.BooleanType()),
        T.StructField("text_with_context", T.StringType()),
        T.StructField("is_garbled", T.BooleanType()),
    ]
)
#: Fields without which a checkpoint row is dropped, and those with a default.
REQUIRED = ("id", "text", "file_hash", "pdf_name", "page_number", "chunk_index")
DEFAULTS = {"pipeline_version": "0.0", "is_garbled": False, "pdf_path": "", "char_count": 0, "word_count": 0, "has_numbers": False, "has_formula": False}

METADATA = T.StructType([T.StructField("source", T.StringType()), T.StructField("page", T.IntegerType()), T.StructField("is_garbled", T.BooleanType())])
COLLECTION = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("document", T.StringType()),
        T.StructField("metadata", METADATA),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
    ]
)
MANIFEST = T.StructType([T.StructField("store", T.StringType()), T.StructField("pdf_name", T.StringType()), T.StructField("file_hash", T.StringType())])
