"""Row types of the tables the operators exchange."""

from __future__ import annotations

from pyspark.sql import types as T

VECTOR = T.ArrayType(T.FloatType())

# One stored chunk. ``chunk_id`` is the key; ``seq`` orders the changes of one key.
STORE_ROW = T.StructType(
    [
        T.StructField("chunk_id", T.StringType()),
        T.StructField("doc_id", T.StringType()),
        T.StructField("doc_title", T.StringType()),
        T.StructField("doc_path", T.StringType()),
        T.StructField("doc_summary", T.StringType()),
        T.StructField("knowledge_type", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("embedding", VECTOR),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("deleted", T.BooleanType()),
        T.StructField("deleted_at", T.TimestampType()),
        T.StructField("seq", T.LongType()),
    ]
)
STORE_COLUMNS = STORE_ROW.fieldNames()

# Text to embed, one row per document.
VECTOR_INPUT_COLUMNS = ["doc_id", "doc_title", "doc_path", "doc_summary", "content"]

SUMMARY_ROW = T.StructType(
    [T.StructField(name, T.StringType()) for name in ("doc_id", "doc_title", "doc_path", "summary")]
)

# Field names of the form records.
FORM_FIELDS = (
    "FK_NYLQ_NUMBER",
    "FK_NYLQ_NAME",
    "FK_NYLQ_STRUCTURE_TAG",
    "form_id",
    "form_name",
)
FORM_RECORD = T.StructType([T.StructField(name, T.StringType()) for name in FORM_FIELDS])

# Envelope keys of a form file, first match wins.
FORM_ENVELOPES = ("RECORDS", "data", "forms")
FORM_FILE = T.StructType(
    [T.StructField(name, T.ArrayType(FORM_RECORD)) for name in FORM_ENVELOPES] + FORM_RECORD.fields
)

TYPE_CONFIG = T.StructType(
    [
        T.StructField("knowledge_type", T.StringType()),
        T.StructField("type_order", T.IntegerType()),
        T.StructField("vector_field", T.StringType()),
        T.StructField("search_k", T.IntegerType()),
        T.StructField("search_min_score", T.DoubleType()),
    ]
)
