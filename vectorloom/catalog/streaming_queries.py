"""Queries of the streaming jobs: streams run until their input is used up, then the result is
read."""

from __future__ import annotations

from pyspark.sql import functions as F

from vectorloom.catalog.registry import query, sql, table, values
from vectorloom.catalog.store_queries import REPLAYED, change_log
from vectorloom.operators.store import as_store_rows
from vectorloom.session import scratch_path
from vectorloom.sources.snapshots import read_store
from vectorloom.streaming.ingest import stream_import, stream_upsert
from vectorloom.streaming.replay import read_replay, stream_replay


def _event_stream(spark, folder, per_trigger=2):
    """The events as a stream of four files, two per micro-batch."""
    path = scratch_path(spark, "events")
    events = table(spark, folder, "events")
    events.repartitionByRange(4, "event_id").write.parquet(path)
    reader = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", per_trigger)
    return reader.parquet(path)


@query(
    "stream_upsert",
    """
    SELECT chunk_id, knowledge_type, content, seq FROM (
      SELECT 'u' || user_id AS chunk_id, 'events' AS knowledge_type, props || event_type AS content,
             event_id AS seq, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n
      FROM events) WHERE n = 1
    """,
)
def _(spark, folder):
    rows = as_store_rows(
        _event_stream(spark, folder).select(
            F.concat(F.lit("u"), "user_id").alias("chunk_id"),
            F.lit("events").alias("knowledge_type"),
            F.concat("props", "event_type").alias("content"),
            F.col("event_id").alias("seq"),
        )
    )
    root = scratch_path(spark, "store")
    running = stream_upsert(rows, root, scratch_path(spark, "checkpoint"))
    running.awaitTermination()
    return read_store(spark, root).select("chunk_id", "knowledge_type", "content", "seq")


@query(
    "stream_import",
    """
    SELECT DISTINCT regexp_extract(url, '([^/]+?)(\\.[^./]+)?/*$', 1) AS chunk_id,
           CASE WHEN contains(url, 'blog.') THEN 'blog' ELSE 'page' END AS knowledge_type
    FROM pages WHERE contains(url, 'example')
      AND regexp_matches(regexp_extract(url, '([^/]+?)(\\.[^./]+)?/*$', 1), '[^ \\t\\r\\n]')
    """,
)
def _(spark, folder):
    # Page addresses arrive as files; ids are kept apart per type.
    path = scratch_path(spark, "pages")
    pages = table(spark, folder, "pages").select(F.col("url").alias("path"))
    pages.repartition(3).write.parquet(path)
    reader = spark.readStream.schema("path string").option("maxFilesPerTrigger", 2)
    rules = values(
        spark,
        [("blog.", "blog", 0), ("example", "page", 1)],
        "pattern string, knowledge_type string, priority int",
    )
    config = values(
        spark,
        [("blog", "file_name"), ("page", "file_name")],
        "knowledge_type string, vector_field string",
    )
    root = scratch_path(spark, "store")
    running = stream_import(
        reader.parquet(path),
        root,
        scratch_path(spark, "ledger"),
        rules,
        config,
        scratch_path(spark, "checkpoint"),
    )
    running.awaitTermination()
    return read_store(spark, root).select("chunk_id", "knowledge_type")


@query("stream_replay", REPLAYED)
def _(spark, folder):
    log = change_log(_event_stream(spark, folder))
    path = scratch_path(spark, "replay")
    running = stream_replay(log, path, scratch_path(spark, "checkpoint"), payload="value")
    running.awaitTermination()
    return read_replay(spark, path).select("chunk_id", "value", "deleted")


@query("commit_policy", sql("SELECT count(*) AS rows, count(DISTINCT user_id) AS keys FROM events"))
def _(spark, folder):
    # One file per commit: every commit is a version of its own, and none loses rows.
    stream = _event_stream(spark, folder, per_trigger=1)
    path = scratch_path(spark, "commits")

    def commit(batch, number):
        batch.select("event_id", "user_id").write.mode("overwrite").parquet(f"{path}/part-{number}")

    from vectorloom.streaming.ingest import commit_policy

    writer = stream.writeStream.foreachBatch(commit)
    writer = writer.option("checkpointLocation", scratch_path(spark, "checkpoint"))
    commit_policy(writer, continuous=False).start().awaitTermination()
    rows = spark.read.option("recursiveFileLookup", "true").parquet(path)
    return rows.agg(F.count("*").alias("rows"), F.count_distinct("user_id").alias("keys"))
