"""Token counts, length buckets and encode batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectorloom import settings
from vectorloom.functions.tokens import length_bucket, token_estimate
from vectorloom.plans.ordering import number_rows


def with_token_info(df: DataFrame, text: str = "content") -> DataFrame:
    """Add ``token_count`` and ``bucket``."""
    counted = df.withColumn("token_count", token_estimate(F.col(text)))
    return counted.withColumn("bucket", length_bucket(F.col("token_count")))


def assign_batches(
    df: DataFrame,
    order: str,
    sizes: dict[str, int] | None = None,
    current_max: int = settings.MAX_BATCH,
) -> DataFrame:
    """Cut every bucket, in input order, into batches; adds ``batch_id`` (per bucket, from 0).

    Expects ``bucket``. There are only three buckets, so positions come from ``number_rows``,
    which spreads one bucket over many tasks.
    """
    capped = {name: min(size, current_max) for name, size in (sizes or settings.BATCH_SIZES).items()}
    size: Column | None = None
    for name, rows in capped.items():
        hit = F.col("bucket") == name
        size = F.when(hit, rows) if size is None else size.when(hit, rows)
    numbered = number_rows(df, ["bucket"], [order])
    return numbered.withColumn("batch_id", F.floor(F.col("position") / size)).drop("position")


def bucket_stats(df: DataFrame) -> DataFrame:
    return df.groupBy("bucket").agg(F.count("*").alias("texts"))


def _mb_per_token(dim: int, bytes_per_value: int) -> float:
    return dim * bytes_per_value / (1024 * 1024)


def batch_memory_mb(
    df: DataFrame, dim: int = settings.EMBEDDING_DIM, bytes_per_value: int = 2
) -> DataFrame:
    """Estimated memory of each batch; two bytes per value for half precision, else four."""
    per_token = _mb_per_token(dim, bytes_per_value)
    return df.groupBy("bucket", "batch_id").agg(
        F.count("*").alias("texts"), (F.sum("token_count") * F.lit(per_token)).alias("memory_mb")
    )


def optimal_batch_size(
    df: DataFrame,
    available_mb: float = settings.AVAILABLE_MEMORY_MB,
    dim: int = settings.EMBEDDING_DIM,
    bytes_per_value: int = 2,
) -> DataFrame:
    """One row: how many average texts fit the memory share, within the batch limits."""
    per_item = F.avg("token_count") * F.lit(_mb_per_token(dim, bytes_per_value))
    fitting = F.floor(F.lit(available_mb * settings.MEMORY_SHARE) / per_item)
    limited = F.greatest(F.lit(settings.MIN_BATCH), F.least(fitting, F.lit(settings.MAX_BATCH)))
    # An empty input has no average and takes the smallest batch.
    chosen = F.when(F.count("token_count") > 0, limited).otherwise(F.lit(settings.MIN_BATCH))
    return df.agg(chosen.cast("int").alias("batch_size"))
