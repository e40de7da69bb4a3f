"""Row keys of tables whose ids may repeat or be null, and small sides of joins."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectorloom.plans.ordering import number_rows
from vectorloom.session import materialise

# Rows of a file have keys of so many bits.
FILE_ROW_BITS = 38
# Files that are numbered by one task and broadcast; more are numbered and joined by a shuffle.
BROADCAST_FILES = 100_000
# Bitmaps that are broadcast: 64 MB, and the marks of 500 million rows.
BROADCAST_BITMAPS = 16_384


def with_row_index(df: DataFrame, name: str) -> DataFrame:
    """``df`` with the place of each row in its file, which tells equal rows apart. Any table that is not read
    from files is written first."""
    try:
        stored = df.select(*(f"`{column}`" for column in df.columns), F.col("_metadata.row_index").alias(name))
        stored.schema  # noqa: B018  resolves the columns
    except AnalysisException:
        return with_row_index(materialise(df, "rows"), name)
    return stored


def with_row_key(df: DataFrame, name: str = "_row_key") -> DataFrame:
    """``df`` with a key of each row that every later read finds again.

    Rows of stored files, unchanged in number, are named by their file and place in it, without a copy. Any
    other table is written first.
    """
    try:
        place = (F.col("_metadata.file_path").alias("_path"), F.col("_metadata.row_index").alias("_at"))
        stored = df.select(*df.columns, *place)
        stored.schema  # noqa: B018  resolves the columns
    except AnalysisException:
        return materialise(df.withColumn(name, F.monotonically_increasing_id()), "rows")
    files = materialise(stored.select("_path").distinct(), "files")  # one row per file
    if files.count() <= BROADCAST_FILES:
        numbered = F.broadcast(materialise(files.coalesce(1).withColumn("_file", F.monotonically_increasing_id()), "files"))
    else:
        numbered = materialise(number_rows(files, [], ["_path"], "_file"), "files")
    key = F.shiftleft("_file", FILE_ROW_BITS).bitwiseOR(F.col("_at"))
    return stored.join(numbered, "_path").select(*df.columns, key.alias(name))


def small_side(df: DataFrame, rows: int = 2_000_000) -> DataFrame:
    """A written table of a few numbers a row, to be broadcast in a join if it has at most ``rows`` rows."""
    return F.broadcast(df) if df.count() <= rows else df


def without_rows(df: DataFrame, gone: DataFrame, row_col: str) -> DataFrame:
    """``df`` without the rows whose key (``with_row_key``) the one column of ``gone`` names.

    Keys are dense within a file, so the rows that go are marked in bitmaps of 32,768 keys, 4 KB each. These are
    broadcast however many rows go: ``df``, which may hold texts, is not shuffled.
    """

    def place(key: Column) -> tuple[Column, Column]:
        return F.bitmap_bucket_number(key), F.bitmap_bit_position(key)

    bucket, at = place(F.col(gone.columns[0]))
    marked = gone.groupBy(bucket.alias("_bucket")).agg(F.bitmap_construct_agg(at).alias("_gone"))
    marked = small_side(materialise(marked, "gone"), BROADCAST_BITMAPS)
    bucket, at = place(F.col(row_col))
    byte = F.conv(F.hex(F.expr("substring(_gone, cast(_at div 8 + 1 as int), 1)")), 16, 10).cast("int")
    bit = F.getbit(byte, F.pmod("_at", F.lit(8)).cast("int"))
    joined = df.withColumns({"_bucket": bucket, "_at": at}).join(marked, "_bucket", "left")
    return joined.where(F.col("_gone").isNull() | (bit == 0)).select(*df.columns)
