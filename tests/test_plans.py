"""What the physical plans must look like to hold at scale."""

from pyspark.sql import functions as F

from vectorloom.catalog.registry import label_queries, store_table, table
from vectorloom.operators import chunking, conversations, embedding, search, stats, store
from vectorloom.plans.ordering import number_rows
from vectorloom.session import scratch_path
from vectorloom.sources import snapshots


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_python_functions_run_once(spark, folder):
    documents = table(spark, folder, "documents").select("doc_id", F.col("text").alias("content"))
    embedded = embedding.filter_embedded(embedding.embed_text(documents))
    assert plan(embedded).count("ArrowEvalPython") == 1
    assert plan(chunking.chunk_documents(documents)).count("ArrowEvalPython") == 1


def test_top_k_is_limited_before_the_shuffle(spark, folder):
    for df in (
        conversations.recent_history(table(spark, folder, "conversations")),
        store.latest_rows(store_table(spark, folder)),
        search.store_search(store_table(spark, folder), label_queries(spark, folder)),
    ):
        text = plan(df)
        assert text.index("Final") < text.index("Exchange hashpartitioning") < text.index("Partial")


def test_hits_do_not_shuffle_the_store(spark, folder):
    root = scratch_path(spark, "store")
    snapshots.write_store(store_table(spark, folder), root, ["t0", "t1"])
    stored = snapshots.read_store(spark, root)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        types = spark.createDataFrame([("t0", 0)], "knowledge_type string, type_order int")
        found = search.search_multi_query(stored, label_queries(spark, folder), types)
        assert "SortMergeJoin" not in plan(found)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_store_scans_are_pruned(spark, folder):
    root = scratch_path(spark, "store")
    snapshots.write_store(store_table(spark, folder), root, ["t0", "t1"])
    counted = plan(stats.stats_by_source(snapshots.read_store(spark, root, ["t1"])))
    assert "ReadSchema: struct<source:string,deleted:boolean>" in counted
    assert "PartitionFilters: [" in counted and "knowledge_type" in counted.split("PartitionFilters")[1]
    assert "EqualTo(deleted,false)" in counted or "Not(EqualTo(deleted,true))" in counted


def test_aggregates_combine_before_the_shuffle(spark, folder):
    text = plan(store.replay_changes(
        table(spark, folder, "events").select(
            F.col("user_id").alias("chunk_id"), F.col("event_id").alias("seq"), F.lit("upsert").alias("op")
        )
    ))
    assert "partial_max" in text and "HashAggregate" in text and "SortAggregate" not in text


def test_numbering_a_hot_group(spark):
    rows = spark.range(3000).select(
        (F.col("id") * 7919 % 3000).alias("id"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("group"),
    )
    numbered = number_rows(rows.repartition(5), ["group"], ["id"])
    from pyspark.sql import Window

    expected = F.row_number().over(Window.partitionBy("group").orderBy("id")) - 1
    assert numbered.withColumn("wanted", expected).where("position <> wanted").count() == 0
    assert numbered.count() == 3000


def test_a_hot_text_is_split_by_the_skew_join(spark):
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "50KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "50KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    }
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        text = F.when(F.col("id") % 3 == 0, F.lit("one hot text")).otherwise(
            F.concat(F.lit("text "), F.col("id"))
        )
        payload = F.sha2(F.col("id").cast("string"), 256).alias("payload")
        rows = spark.range(0, 30_000, 1, 6).select("id", payload, text.alias("content"))
        embedded = embedding.embed_distinct(rows)
        assert len(embedded.collect()) == 30_000
        assert "SortMergeJoin(skew=true)" in plan(embedded)
    finally:
        for key in settings:
            spark.conf.unset(key)


def test_null_groups_are_numbered(spark):
    from vectorloom.plans.ordering import number_rows

    rows = [(None, 1), (None, 2), ("a", 1), ("a", 2)]
    numbered = number_rows(spark.createDataFrame(rows, "g string, n int"), ["g"], ["n"])
    assert sorted(map(tuple, numbered.collect()), key=str) == sorted(
        [(None, 1, 0), (None, 2, 1), ("a", 1, 0), ("a", 2, 1)], key=str
    )
    assert numbered.columns == ["g", "n", "position"]


def test_native_encoder_does_not_shuffle(spark, folder):
    documents = table(spark, folder, "documents")
    assert "Exchange" not in plan(embedding.hash_encode(documents, "doc_id", "text"))


def test_texts_are_folded_by_hash_and_null_texts_spread(spark):
    rows = spark.createDataFrame([(1, None), (2, None), (3, "a"), (4, "a")], "id long, content string")
    embedded = embedding.embed_distinct(rows)
    vectors = {r["id"]: r["embedding"] for r in embedded.collect()}
    assert vectors[1] is None and vectors[2] is None and vectors[3] == vectors[4] is not None
    assert embedded.columns == ["id", "content", "embedding"]


def test_steps_of_an_ended_job_are_deleted(spark):
    import pathlib

    from vectorloom.session import materialise, temporary_steps

    with temporary_steps(spark):
        step = scratch_path(spark, "gone")
        spark.range(3).write.parquet(step)
        materialise(spark.range(2)).count()
    kept = scratch_path(spark, "kept")
    spark.range(3).write.parquet(kept)
    assert not pathlib.Path(step).exists() and pathlib.Path(kept).exists()
