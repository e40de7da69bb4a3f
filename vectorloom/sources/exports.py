"""Sinks for reports and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame


def export_json(df: DataFrame, path: str) -> None:
    """Write a report or log table as JSON lines."""
    df.write.json(path)


def write_form_markdown(converted: DataFrame, path: str) -> DataFrame:
    """Write ``(filename, md)`` as a table and read it back.

    One row per document instead of one file each: millions of small files would burden any
    cluster file system.
    """
    converted.where(converted["md"].isNotNull()).write.parquet(path)
    return converted.sparkSession.read.parquet(path)
