"""Knowledge files."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectorloom import settings
from vectorloom.functions.text import file_suffix


def _files(reader, only_md: bool):
    reader = reader.format("binaryFile").option("recursiveFileLookup", "true")
    return reader.option("pathGlobFilter", "*.[mM][dD]") if only_md else reader


def scan_knowledge_files(spark: SparkSession, path: str, only_md: bool = True) -> DataFrame:
    """``(path, length)`` of all files below a folder. Contents are not read, so a core lists its share in one task."""
    listed = _files(spark.read, only_md).load(path).select("path", "length")
    return listed.coalesce(spark.sparkContext.defaultParallelism)


def stored_place(spark: SparkSession, path: str) -> str | None:
    """The path of a file or folder as Spark's sources show it, with its file system; ``None`` where there is none."""
    named = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = named.getFileSystem(spark._jsc.hadoopConfiguration())
    return system.makeQualified(named).toString() if system.exists(named) else None


def filter_allowed_files(
    files: DataFrame,
    extensions: Iterable[str] = settings.ALLOWED_EXTENSIONS,
    max_bytes: int = settings.MAX_FILE_BYTES,
) -> DataFrame:
    """Files with an allowed suffix and size."""
    suffix = F.lower(file_suffix(F.col("path")))
    return files.where(suffix.isin(*extensions) & (F.col("length") <= max_bytes))


def read_text_files(spark: SparkSession, path: str, glob: str = "*.md") -> DataFrame:
    """``(path, length, content)``: one row per file with its whole UTF-8 text."""
    lines = (
        spark.read.option("recursiveFileLookup", "true")
        .option("pathGlobFilter", glob)
        .text(path, wholetext=True)
    )
    return lines.select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_size").alias("length"),
        F.col("value").alias("content"),
    )
