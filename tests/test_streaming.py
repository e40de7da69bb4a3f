"""Streams give the state of the batch operators, also when they stop and go on."""

from pyspark.sql import functions as F

from vectorloom.catalog.registry import table
from vectorloom.catalog.store_queries import change_log
from vectorloom.operators.store import as_store_rows, replay_changes, upsert_documents
from vectorloom.schemas import STORE_ROW
from vectorloom.session import scratch_path
from vectorloom.sources.snapshots import current_versions, read_store
from vectorloom.streaming.ingest import knowledge_file_stream, stream_import, stream_upsert
from vectorloom.streaming.replay import read_replay, stream_replay


def _two_parts(spark, folder):
    events = table(spark, folder, "events")
    half = events.agg(F.percentile_approx("event_id", 0.5)).head()[0]
    return events, events.where(F.col("event_id") <= half), events.where(F.col("event_id") > half)


def test_replay_goes_on_from_its_checkpoint(spark, folder):
    events, first, second = _two_parts(spark, folder)
    source, out, checkpoint = (scratch_path(spark, name) for name in ("in", "out", "check"))
    for part in (first, second):
        part.write.mode("append").parquet(source)
        stream = spark.readStream.schema(events.schema).parquet(source)
        stream_replay(change_log(stream), out, checkpoint, payload="value").awaitTermination()
    batch = replay_changes(change_log(events), payload="value")
    columns = ["chunk_id", "deleted", "value"]
    assert sorted(map(tuple, read_replay(spark, out).select(columns).collect())) == sorted(
        map(tuple, batch.select(columns).collect())
    )


def test_upsert_in_any_order(spark, folder):
    events, first, second = _two_parts(spark, folder)

    def rows(df):
        return as_store_rows(
            df.select(
                F.col("user_id").cast("string").alias("chunk_id"),
                F.concat(F.lit("t"), F.col("user_id") % 2).alias("knowledge_type"),
                F.col("props").alias("content"),
                F.col("event_id").alias("seq"),
            )
        )

    source, root, checkpoint = (scratch_path(spark, name) for name in ("in", "store", "check"))
    for part in (second, first):  # late data comes last
        part.coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(events.schema).parquet(source)
        stream_upsert(rows(stream), root, checkpoint).awaitTermination()
    batch = upsert_documents(spark.createDataFrame([], STORE_ROW), rows(events))
    columns = ["chunk_id", "knowledge_type", "content", "seq"]
    assert sorted(map(tuple, read_store(spark, root).select(columns).collect())) == sorted(
        map(tuple, batch.select(columns).collect())
    )
    assert {version for version, _ in current_versions(spark, root).values()} == {2}


def test_import_of_arriving_files(spark, tmp_path):
    (tmp_path / "forms").mkdir()
    rules = spark.createDataFrame([("forms", "form", 1)], "pattern string, knowledge_type string, priority int")
    config = spark.createDataFrame([("form", "file_name")], "knowledge_type string, vector_field string")
    root, ledger, checkpoint = (scratch_path(spark, name) for name in ("store", "ledger", "check"))
    for name in ("a.md", "b.MD", "c.txt"):
        (tmp_path / "forms" / name).write_text("x")
        stream = knowledge_file_stream(spark, str(tmp_path), max_files=1)
        stream_import(stream, root, ledger, rules, config, checkpoint).awaitTermination()
    assert {r["chunk_id"] for r in read_store(spark, root).collect()} == {"a", "b"}
    outcomes = spark.read.option("recursiveFileLookup", "true").parquet(ledger)
    assert [r["status"] for r in outcomes.collect()] == ["completed", "completed"]


def test_import_does_not_read_the_store(spark, tmp_path, monkeypatch):
    from vectorloom.operators.embedding import VectorTable
    from vectorloom.sources import snapshots

    (tmp_path / "new").mkdir()
    for name in ("a", "b"):
        (tmp_path / "new" / f"{name}.md").write_text(name)
    rules = spark.createDataFrame([("", "t", 0)], "pattern string, knowledge_type string, priority int")
    config = spark.createDataFrame([("t", "file_name")], "knowledge_type string, vector_field string")
    root, ledger, checkpoint = (scratch_path(spark, name) for name in ("store", "ledger", "check"))
    stored = spark.createDataFrame([("a", "t", "stored", True)], "chunk_id string, knowledge_type string, content string, deleted boolean")
    snapshots.write_store(as_store_rows(stored), root, ["t"])

    def refuse(*_):
        raise AssertionError("the store is read")

    kept = VectorTable(scratch_path(spark, "kept"), "hash")
    with monkeypatch.context() as patched:
        patched.setattr(snapshots, "_scan", refuse)
        for name in ("b", "c"):
            (tmp_path / "new" / f"{name}{name}.md").write_text(name)
            stream = knowledge_file_stream(spark, str(tmp_path / "new"))
            stream_import(stream, root, ledger, rules, config, checkpoint, kept=kept).awaitTermination()
    found = {r["chunk_id"]: (r["content"], r["deleted"]) for r in read_store(spark, root).collect()}
    assert found.pop("a") == ("stored", True) and set(found) == {"b", "bb", "cc"}
    assert kept.read(spark).count() == 4
