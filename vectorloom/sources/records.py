"""Summary records and form records kept in JSON files."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vectorloom import settings
from vectorloom.schemas import FORM_ENVELOPES, FORM_FIELDS, SUMMARY_ROW
from vectorloom.sources.byte_streams import json_arrays, json_elements, read_pieces

_STRUCTURE = "FK_NYLQ_STRUCTURE_TAG"


def scan_summaries(spark: SparkSession, path: str) -> DataFrame:
    """Summary records of JSON array files, with missing fields empty.

    ``position`` orders the records: files by name, then records as they stand. A JSON array is
    read by one task per file, in order, so the row id of the scan keeps the order inside a file.
    """
    rows = spark.read.schema(SUMMARY_ROW).json(path, multiLine=True, recursiveFileLookup=True)
    fields = [F.coalesce(F.col(f.name), F.lit("")).alias(f.name) for f in SUMMARY_ROW.fields]
    return rows.select(
        *fields,
        F.struct(
            F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("row")
        ).alias("position"),
    )


def _member(value: Column, name: str, kind: str) -> Column:
    return F.try_variant_get(value, f"$.{name}", kind)


def _large_file_records(path: str) -> Iterator[str | None]:
    """Texts of the form records of one file, by the envelope rule; one null for a file that is not JSON."""
    try:
        arrays = json_arrays(read_pieces(path))
    except ValueError:
        yield None
        return
    places = {key: member for member, key in arrays}
    listed = next((key for key in (None, *FORM_ENVELOPES) if key in places), "")
    if listed == "":
        yield "".join(read_pieces(path))
    else:
        yield from json_elements(read_pieces(path), places[listed])


RECORDS_A_BATCH_BYTES = 4 << 20


def _record_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["file_path", "position", "text"]

    def packed(file: str, first: int, texts: list[str | None]) -> pa.RecordBatch:
        places = pa.array(range(first, first + len(texts)), pa.int32())
        columns = [pa.array([file] * len(texts), pa.string()), places, pa.array(texts, pa.string())]
        return pa.RecordBatch.from_arrays(columns, names=names)

    for batch in batches:
        for row in batch.to_pylist():
            first, texts, weight = 0, [], 0
            for text in _large_file_records(row["path"]):
                texts.append(text)
                weight += len(text or "") + 16
                if weight >= RECORDS_A_BATCH_BYTES:
                    yield packed(row["file_path"], first, texts)
                    first, texts, weight = first + len(texts), [], 0
            if texts:
                yield packed(row["file_path"], first, texts)


def scan_form_records(
    spark: SparkSession, path: str, cap: int = settings.WHOLE_JSON_BYTES
) -> DataFrame:
    """Form records from any envelope: a list under a known key, a bare list or a single object.

    ``position`` counts from zero inside a file. A structure that is missing is empty, one that is
    explicitly null stays null: such a record cannot be rendered.

    Files up to ``cap`` bytes are parsed whole by Spark. Larger ones are cut into records in pieces, twice over the
    file (once for the place of the list, which may stand behind other members, once for its records): a task
    holds a piece, a record and one batch, and Spark parses the records. A file that is not JSON gives one
    record without fields; in a large file a record that is not JSON does so by itself, and of equal keys the
    last one counts.
    """
    files = (
        spark.read.option("singleVariantColumn", "doc")
        .json(path, multiLine=True, recursiveFileLookup=True)
        .where(F.col("_metadata.file_size") <= cap)
    )
    doc = F.col("doc")
    listed = [_member(doc, key, "array<variant>") for key in FORM_ENVELOPES]
    bare = F.try_variant_get(doc, "$", "array<variant>")
    whole = files.select(
        F.col("_metadata.file_path").alias("file_path"),
        F.posexplode(F.coalesce(bare, *listed, F.array(doc))).alias("position", "record"),
    )
    large = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
        .where(F.col("length") > cap)
        .select("path", F.col("_metadata.file_path").alias("file_path"))
    )
    cut = large.mapInArrow(_record_batches, "file_path string, position int, text string")
    parsed = cut.select("file_path", "position", F.try_parse_json("text").alias("record"))
    return whole.unionByName(parsed).select("file_path", "position", *_form_fields(F.col("record")))


def _form_fields(record: Column) -> list[Column]:
    fields = {name: _member(record, name, "string") for name in FORM_FIELDS}
    explicit_null = F.is_variant_null(_member(record, _STRUCTURE, "variant"))
    fields[_STRUCTURE] = F.when(
        ~F.coalesce(explicit_null, F.lit(False)), F.coalesce(fields[_STRUCTURE], F.lit(""))
    )
    return [value.alias(name) for name, value in fields.items()]
