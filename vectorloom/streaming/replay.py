"""Keyed state of a change stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vectorloom.operators.store import fold_changes
from vectorloom.streaming.ingest import commit_policy


# State store of Spark that keeps the keys on disk.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_replay(
    log: DataFrame,
    path: str,
    checkpoint: str,
    key: str = "chunk_id",
    payload: str | None = None,
    continuous: bool = False,
) -> StreamingQuery:
    """Fold a change stream ``(key, seq, op)`` and write the keys that changed.

    The fold is a native streaming aggregate: changes are combined map-side, the state store keeps
    the last operations per key, outside the JVM heap. Each micro-batch replaces its own folder, so a
    repeated one does no harm.
    """
    def commit(batch: DataFrame, number: int) -> None:
        changed = batch.withColumn("batch", F.lit(number))
        changed.write.mode("overwrite").parquet(f"{path}/part-{number}")

    writer = (
        fold_changes(log, key, payload)
        .writeStream.outputMode("update")
        .foreachBatch(commit)
        .option("checkpointLocation", checkpoint)
    )
    # A query takes the session's settings when it starts; other queries keep theirs.
    conf, name = log.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(name)
    conf.set(name, ROCKSDB)
    try:
        return commit_policy(writer, continuous).start()
    finally:
        conf.set(name, before)


def read_replay(spark: SparkSession, path: str, key: str = "chunk_id") -> DataFrame:
    """Current state: the newest row of every key, keys that exist only."""
    rows = spark.read.option("recursiveFileLookup", "true").parquet(path)
    columns = [column for column in rows.columns if column not in (key, "batch")]
    newest = rows.groupBy(key).agg(F.max_by(F.struct(*columns), "batch").alias("_newest"))
    return newest.select(key, "_newest.*").where("present").drop("present")
