"""Conversations kept as one row per message: ``(conv_id, turn, role, text)``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vectorloom.functions.text import preview

# Messages sent along as context, and lengths of title and preview.
CHAT_HISTORY = 10
REQUIREMENT_HISTORY = 6
TITLE_CHARS = 30
PREVIEW_CHARS = 50


def recent_history(messages: DataFrame, limit: int = CHAT_HISTORY) -> DataFrame:
    """Last messages of every conversation; ``position`` keeps their order from 1.

    The limit is applied map-side, so a very long conversation moves ``limit`` rows per task. Messages of an equal
    turn are ordered by a hash of their columns, so a repeated run keeps the same ones.
    """
    tie = F.xxhash64(*(F.col(f"`{column}`") for column in messages.columns))
    newest = Window.partitionBy("conv_id").orderBy(F.col("turn").desc(), tie.desc())
    kept = messages.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= limit)
    oldest = Window.partitionBy("conv_id").orderBy("turn", tie)
    return kept.withColumn("position", F.row_number().over(oldest)).drop("_n")


def conversation_list(messages: DataFrame, updated: str = "turn") -> DataFrame:
    """Title from the first message, preview from the last, newest conversation first.

    Texts are cut before they are aggregated, so the aggregate buffers stay short.
    """
    cut = messages.select(
        "conv_id",
        "turn",
        F.col(updated).alias("_updated"),
        preview(F.col("text"), TITLE_CHARS).alias("_title"),
        preview(F.col("text"), PREVIEW_CHARS).alias("_preview"),
    )
    listed = cut.groupBy("conv_id").agg(
        F.min_by("_title", "turn").alias("title"),
        F.max_by("_preview", "turn").alias("preview"),
        F.max("_updated").alias("updated"),
    )
    return listed.orderBy(F.col("updated").desc(), F.col("conv_id"))


def session_message_counts(messages: DataFrame, updated: str = "turn") -> DataFrame:
    """Messages and latest update per session."""
    return messages.groupBy("conv_id").agg(
        F.count("*").alias("message_count"), F.max(updated).alias("updated")
    )
