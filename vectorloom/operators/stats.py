"""Statistics over the store, imports, conversations' usage and logs.

Plain grouped aggregates: Spark combines them map-side, so hot groups cost one row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vectorloom.functions.tokens import length_bucket, token_estimate


def store_stats(store: DataFrame) -> DataFrame:
    """Active and soft-deleted chunks, one row."""
    return store.agg(
        F.count_if(~F.col("deleted")).alias("total_chunks"),
        F.count_if(F.col("deleted")).alias("deleted_chunks"),
    )


def stats_by_type(store: DataFrame) -> DataFrame:
    """Active chunks per type; the row with a null type and ``is_total`` is the sum."""
    live = store.where(~F.col("deleted"))
    return live.rollup("knowledge_type").agg(
        F.count("*").alias("chunks"), F.grouping("knowledge_type").cast("int").alias("is_total")
    )


def stats_by_source(store: DataFrame) -> DataFrame:
    return store.where(~F.col("deleted")).groupBy("source").agg(F.count("*").alias("chunks"))


def stats_by_chunk_type(store: DataFrame) -> DataFrame:
    """Active chunks and distinct documents per length bucket."""
    live = store.where(~F.col("deleted"))
    bucket = length_bucket(token_estimate(F.col("content")))
    return live.groupBy(bucket.alias("chunk_type")).agg(
        F.count("*").alias("chunks"), F.count_distinct("doc_id").alias("documents")
    )


def indexed_documents(store: DataFrame) -> DataFrame:
    """Distinct documents with at least one active vector, one row."""
    live = store.where(~F.col("deleted") & F.col("embedding").isNotNull())
    return live.agg(F.count_distinct("doc_id").alias("documents"))


def vector_count(vectors: DataFrame) -> DataFrame:
    return vectors.agg(F.count("embedding").alias("vectors"))


def index_info(indexed: DataFrame, kind: str = "flat") -> DataFrame:
    """Kind, size, dimension range and, where the columns exist, cells and code width."""
    measures = [
        F.lit(kind).alias("kind"),
        F.count("*").alias("vectors"),
        F.min(F.size("embedding")).alias("min_dim"),
        F.max(F.size("embedding")).alias("max_dim"),
    ]
    if "cell" in indexed.columns:
        measures.append(F.count_distinct("cell").alias("nlist"))
    if "codes" in indexed.columns:
        measures.append(F.max(F.size("codes")).alias("m"))
    return indexed.agg(*measures)


def import_summary(ledger: DataFrame) -> DataFrame:
    """Totals of an import, one row. ``import_errors`` lists the failures."""
    failed = F.col("status") == "failed"
    return ledger.agg(
        F.count_if(F.col("status") == "completed").alias("total_knowledge"),
        F.coalesce(F.sum("chunks_count"), F.lit(0)).alias("total_chunks"),
        F.count_if(failed).alias("error_count"),
        (F.count_if(failed) == 0).alias("success"),
    )


def import_errors(ledger: DataFrame) -> DataFrame:
    """Failed files with their messages, one row each; the list stays a table."""
    return ledger.where(F.col("status") == "failed").select("file_path", "error_message")


def build_stats(ledger: DataFrame) -> DataFrame:
    """Documents, embedded and failed chunks of a build, one row.

    ``ledger`` has ``doc_id``, ``success``, ``failed`` per document.
    """
    return ledger.agg(
        F.count("*").alias("total"),
        F.coalesce(F.sum("success"), F.lit(0)).alias("success"),
        F.coalesce(F.sum("failed"), F.lit(0)).alias("failed"),
    )


def doc_chunk_counts(chunks: DataFrame) -> DataFrame:
    """Chunks, embedded chunks and failed chunks per document."""
    return chunks.groupBy("doc_id").agg(
        F.count("*").alias("chunks"),
        F.count("embedding").alias("success"),
        F.count_if(F.col("embedding").isNull()).alias("failed"),
    )


def with_outcome(df: DataFrame, value: str = "embedding") -> DataFrame:
    """Add ``status``: completed where a value was produced, failed otherwise."""
    return df.withColumn(
        "status", F.when(F.col(value).isNotNull(), "completed").otherwise("failed")
    )


def outcome_ledger_stats(ledger: DataFrame) -> DataFrame:
    """Tasks and batches per status. Expects ``status`` and ``batch_id``."""
    return ledger.groupBy("status").agg(
        F.count("*").alias("tasks"), F.count_distinct("batch_id").alias("batches")
    )


def conversion_stats(converted: DataFrame, result: str = "md") -> DataFrame:
    """Total, successful and failed conversions, one row."""
    done = F.col(result).isNotNull()
    return converted.agg(
        F.count("*").alias("total"),
        F.count_if(done).alias("success"),
        F.count_if(~done).alias("failed"),
    )


def embed_cache_stats(df: DataFrame, text: str = "content") -> DataFrame:
    """Reuse of texts if every distinct text is encoded once, one row."""
    misses = F.count_distinct(F.sha2(F.col(text), 256))
    total = F.count(text)
    return df.agg(misses.alias("misses"), total.alias("total")).select(
        F.col("misses").alias("size"),
        (F.col("total") - F.col("misses")).alias("hits"),
        "misses",
        F.when(F.col("total") > 0, (F.col("total") - F.col("misses")) / F.col("total"))
        .otherwise(0.0)
        .alias("hit_rate"),
    )


def usage_from_messages(messages: DataFrame, extra: list[str]) -> DataFrame:
    """Token usage per conversation: user messages are prompts, assistant messages completions.

    ``extra`` names columns that are constant per conversation (model, provider, time).
    """
    tokens = token_estimate(F.col("text")).cast("long")

    def of_role(role: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("role") == role, tokens)), F.lit(0))

    usage = messages.groupBy("conv_id", *extra).agg(
        of_role("user").alias("prompt_tokens"), of_role("assistant").alias("completion_tokens")
    )
    return usage.withColumn("total_tokens", F.col("prompt_tokens") + F.col("completion_tokens"))


def token_usage_report(usage: DataFrame) -> DataFrame:
    """Sessions and tokens overall, by model, by provider and by date in one pass.

    ``section`` says which grouping a row belongs to, ``name`` its value (null for the total) and
    ``position`` its place there: models and providers by tokens, the largest first, dates by date.
    """
    sections = [["model_name"], ["provider"], ["usage_date"], []]
    grouped = usage.groupingSets(sections, "model_name", "provider", "usage_date").agg(
        F.grouping_id().alias("_set"),
        F.count("*").alias("sessions"),
        F.sum("prompt_tokens").alias("prompt_tokens"),
        F.sum("completion_tokens").alias("completion_tokens"),
        F.sum("total_tokens").alias("total_tokens"),
    )
    section = (
        F.when(F.col("_set") == 0b011, "by_model")
        .when(F.col("_set") == 0b101, "by_provider")
        .when(F.col("_set") == 0b110, "by_date")
        .otherwise("summary")
    )
    report = grouped.select(
        section.alias("section"),
        F.coalesce("model_name", "provider", "usage_date").alias("name"),
        "sessions",
        "prompt_tokens",
        "completion_tokens",
        "total_tokens",
        F.round(F.col("total_tokens") / F.col("sessions"), 0).alias("avg_tokens"),
    )
    # One row per model, provider or day is left, so a section is small whatever the usage.
    tokens = F.when(F.col("section") != "by_date", F.col("total_tokens"))
    order = Window.partitionBy("section").orderBy(tokens.desc(), F.col("name").asc())
    return report.withColumn("position", F.row_number().over(order))


def tokens_on(usage: DataFrame, day: Column) -> DataFrame:
    """Tokens used on one day, one row."""
    spent = F.sum(F.when(F.col("usage_date") == day, F.col("total_tokens")))
    return usage.agg(F.coalesce(spent, F.lit(0)).alias("today_tokens"))


def recent_sessions(usage: DataFrame, order: list[Column], limit: int = 10) -> DataFrame:
    """Newest usage rows."""
    return usage.orderBy(*order).limit(limit)


def log_summary(logs: DataFrame, today: Column) -> DataFrame:
    """Entries in all, of today, errors and warnings, one row."""
    level = F.lower("level")
    return logs.agg(
        F.count("*").alias("total"),
        F.count_if(F.to_date("ts") == today).alias("today_count"),
        F.count_if(level == "error").alias("error_count"),
        F.count_if(level == "warning").alias("warning_count"),
    )


def log_query(
    logs: DataFrame, level: str | None = None, kind: str | None = None, limit: int = 100
) -> DataFrame:
    """Newest entries of a level and type; ties are broken by id."""
    rows = logs
    if level:
        rows = rows.where(F.col("level") == level)
    if kind:
        rows = rows.where(F.col("type") == kind)
    return rows.orderBy(F.col("ts").desc(), F.col("log_id").desc()).limit(limit)
