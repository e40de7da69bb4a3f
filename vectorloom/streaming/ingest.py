"""Continuous ingest into the store."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery, StreamingQueryListener

from vectorloom import settings
from vectorloom.operators.embedding import HashEncoder, VectorTable
from vectorloom.operators.store import live_rows
from vectorloom.plans.pipelines import EncoderFactory, embedded_files, file_batch
from vectorloom.session import temporary_steps
from vectorloom.sources.snapshots import append_absent, append_store, merge_deltas

_FILE_SCHEMA = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("modificationTime", T.TimestampType()),
        T.StructField("length", T.LongType()),
        T.StructField("content", T.BinaryType()),
    ]
)


def commit_policy(
    writer: DataStreamWriter, continuous: bool, delay_ms: int = settings.COMMIT_DELAY_MS
) -> DataStreamWriter:
    """Commit every ``delay_ms``, or drain what is there and stop.

    The amount per commit is bounded at the source (``maxFilesPerTrigger``). A failed commit is
    repeated from the checkpoint.
    """
    if continuous:
        return writer.trigger(processingTime=f"{delay_ms} milliseconds")
    return writer.trigger(availableNow=True)


def stream_upsert(
    rows: DataFrame, root: str, checkpoint: str, continuous: bool = False
) -> StreamingQuery:
    """Upsert a stream of store rows, one committed delta per micro-batch.

    A micro-batch writes its own rows and nothing else. Rows older than the stored ones are ignored by
    readers, so a repeated or late micro-batch is harmless. Rows without a type are stored like others.
    """

    def commit(batch: DataFrame, _: int) -> None:
        with temporary_steps(batch.sparkSession):
            append_store(live_rows(batch), root)
            merge_deltas(batch.sparkSession, root)

    return _start(rows, commit, checkpoint, continuous)


def knowledge_file_stream(
    spark: SparkSession, path: str, max_files: int = settings.COMMIT_ROWS
) -> DataFrame:
    """Stream of Markdown files ``(path, length)`` below a folder."""
    return (
        spark.readStream.format("binaryFile")
        .schema(_FILE_SCHEMA)
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.[mM][dD]")
        .option("maxFilesPerTrigger", max_files)
        .load(path)
        .select("path", "length")
    )


def stream_import(
    files: DataFrame,
    root: str,
    ledger_path: str,
    rules: DataFrame,
    config: DataFrame,
    checkpoint: str,
    summaries: DataFrame | None = None,
    encoder: EncoderFactory = HashEncoder,
    continuous: bool = False,
    kept: VectorTable | None = None,
) -> StreamingQuery:
    """Import files as they arrive: the batch import per micro-batch, with outcomes in a ledger.

    A micro-batch does not read the store: readers prefer what was stored before. Its ledger is written under its
    number, so a repeated one replaces it. With ``kept`` vectors, texts of earlier micro-batches are not encoded
    again.
    """

    def commit(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        with temporary_steps(spark):
            rows, ledger = file_batch(embedded_files(batch, rules, config, summaries, encoder, kept))
            append_absent(rows, root)
            merge_deltas(spark, root)
            ledger.write.mode("overwrite").parquet(f"{ledger_path}/batch={number}")

    return _start(files, commit, checkpoint, continuous)


def _start(
    df: DataFrame, commit: Callable[[DataFrame, int], None], checkpoint: str, continuous: bool
) -> StreamingQuery:
    writer = df.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint)
    return commit_policy(writer, continuous).start()


class ProgressListener(StreamingQueryListener):
    """Reports rows per micro-batch to a callback ``(batch id, input rows)``."""

    def __init__(self, callback: Callable[[int, int], None]):
        self._callback = callback

    def onQueryStarted(self, event) -> None: ...

    def onQueryProgress(self, event) -> None:
        self._callback(event.progress.batchId, event.progress.numInputRows)

    def onQueryIdle(self, event) -> None: ...

    def onQueryTerminated(self, event) -> None: ...
