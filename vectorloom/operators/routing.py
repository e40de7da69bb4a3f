"""From files to the rows to embed: type routing, validation, summary lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectorloom.functions.text import file_stem
from vectorloom.session import lookup_table

# Ways to choose the text of a type.
BY_FILE_NAME = "file_name"
BY_SUMMARY = "summary"


def route_knowledge_type(df: DataFrame, rules: DataFrame, path: str = "path") -> DataFrame:
    """Add ``knowledge_type``: of the rules whose pattern the path contains, the one with the
    lowest priority; null when none matches.

    ``rules`` is ``(pattern, knowledge_type, priority)``, a hand-written table. It becomes one
    CASE expression in priority order, so files are neither joined nor multiplied by rules.
    """
    listed = rules.select("pattern", "knowledge_type", "priority").limit(MAX_RULES + 1).collect()
    if len(listed) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} routing rules")
    ordered = sorted(listed, key=lambda rule: (rule["priority"], rule["pattern"]))
    routed = F.coalesce(
        *(F.when(F.col(path).contains(r["pattern"]), F.lit(r["knowledge_type"])) for r in ordered),
        F.lit(None).cast("string"),
    )
    return df.withColumn("knowledge_type", routed)


MAX_RULES = 1000


def type_config_join(df: DataFrame, config: DataFrame) -> DataFrame:
    """Per-type settings of every row; rows of unconfigured types are dropped.

    The settings, a hand-written table, are broadcast: rows of one type would meet in one task.
    """
    return df.join(F.broadcast(config), "knowledge_type")


def validate_types(df: DataFrame, config: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with a configured type, and the rejected rest (unknown or null type)."""
    known = F.broadcast(config.select("knowledge_type"))
    return (
        df.join(known, "knowledge_type", "left_semi"),
        df.join(known, "knowledge_type", "left_anti"),
    )


def vector_input_file_name(df: DataFrame, path: str = "path") -> DataFrame:
    """The file stem is id, title, summary and text at once."""
    stem = file_stem(F.col(path))
    kept = [column for column in df.columns if column != path]
    return df.select(
        *kept,
        stem.alias("doc_id"),
        stem.alias("doc_title"),
        F.col(path).alias("doc_path"),
        stem.alias("doc_summary"),
        stem.alias("content"),
    )


def summary_lookup(
    files: DataFrame, summaries: DataFrame, stem: str = "stem", position: str = "position"
) -> DataFrame:
    """Files with the first summary, by position, whose id or title equals the file stem.

    Summaries are first folded to one row per key (map-side), so the join cannot multiply rows
    and a stem shared by very many files is skewed on the file side only.
    """
    record = F.struct("doc_id", "doc_title", "doc_path", "summary")
    keys = F.explode(F.array_distinct(F.array("doc_id", "doc_title")))
    by_key = (
        summaries.select(keys.alias("_key"), record.alias("_summary"), position)
        .where(F.coalesce(F.col("_key"), F.lit("")) != "")
        .groupBy("_key")
        .agg(F.min_by("_summary", position).alias("_summary"))
    )
    by_key = lookup_table(by_key)
    return files.join(by_key, F.col(stem) == F.col("_key"), "left").drop("_key")


def vector_input_summary(
    df: DataFrame,
    summaries: DataFrame,
    path: str = "path",
    position: str = "position",
    source_file: str | None = "source_file",
) -> DataFrame:
    """The matched summary is the text; without a match all vector input columns are null.

    The file itself is kept under the name ``source_file``.
    """
    kept = [column for column in df.columns if column != path]
    stemmed = df.withColumn("_stem", file_stem(F.col(path)))
    found = summary_lookup(stemmed, summaries, "_stem", position)

    def field(name: str, default: Column) -> Column:
        value = F.coalesce(F.col(f"_summary.{name}"), default)
        return F.when(F.col("_summary").isNotNull(), value)

    return found.select(
        *kept,
        field("doc_id", F.col("_stem")).alias("doc_id"),
        field("doc_title", F.col("_stem")).alias("doc_title"),
        field("doc_path", F.col(path)).alias("doc_path"),
        field("summary", F.lit("")).alias("doc_summary"),
        field("summary", F.lit("")).alias("content"),
        *([F.col(path).alias(source_file)] if source_file else []),
    )
