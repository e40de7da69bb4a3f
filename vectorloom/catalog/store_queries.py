"""Queries of store mutations."""

from __future__ import annotations

from pyspark.sql import functions as F

from vectorloom.catalog.registry import cte, query, sql, store_table, table
from vectorloom.operators import store
from vectorloom.operators.stats import store_stats
from vectorloom.session import scratch_path
from vectorloom.sources import snapshots

AT = "2024-02-01 00:00:00"
SHOWN = ["chunk_id", "doc_id", "knowledge_type", "content", "deleted"]
_SHOWN = ", ".join(SHOWN)

# A batch of changes: one row per event, keyed by user. Many rows share a key, and only some keys
# are stored already.
cte(
    "batch",
    """
    SELECT 'c' || (user_id * 5) AS chunk_id, 'u' || user_id AS doc_id,
           't' || (user_id % 4) AS knowledge_type,
           props || event_type AS content, event_id AS seq FROM events
    """,
)
cte(
    "newest",
    """
    SELECT chunk_id, doc_id, knowledge_type, content, FALSE AS deleted FROM (
      SELECT *, row_number() OVER (PARTITION BY knowledge_type, chunk_id ORDER BY seq DESC) AS n FROM batch)
    WHERE n = 1
    """,
)
# Ids to change: all users that had an error.
cte("ids", "SELECT DISTINCT 'c' || (user_id * 3) AS chunk_id FROM events WHERE event_type = 'error'")


def _batch(spark, folder):
    events = table(spark, folder, "events").select(
        F.concat(F.lit("c"), F.col("user_id") * 5).alias("chunk_id"),
        F.concat(F.lit("u"), "user_id").alias("doc_id"),
        F.concat(F.lit("t"), F.col("user_id") % 4).alias("knowledge_type"),
        F.concat("props", "event_type").alias("content"),
        F.col("event_id").alias("seq"),
    )
    return store.as_store_rows(events)


def _ids(spark, folder):
    errors = table(spark, folder, "events").where("event_type = 'error'")
    return errors.select(F.concat(F.lit("c"), F.col("user_id") * 3).alias("chunk_id"))


@query(
    "upsert_documents",
    sql(
        f"SELECT {_SHOWN} FROM st ANTI JOIN newest USING (knowledge_type, chunk_id) "
        f"UNION ALL SELECT {_SHOWN} FROM newest",
        "st",
        "newest",
    ),
)
def _(spark, folder):
    merged = store.upsert_documents(store_table(spark, folder), _batch(spark, folder))
    return merged.select(*SHOWN)


@query(
    "insert_if_absent",
    sql(
        f"SELECT {_SHOWN} FROM st UNION ALL SELECT {_SHOWN} FROM newest "
        "ANTI JOIN st USING (knowledge_type, chunk_id)",
        "st",
        "newest",
    ),
)
def _(spark, folder):
    merged = store.insert_if_absent(store_table(spark, folder), _batch(spark, folder))
    return merged.select(*SHOWN)


@query(
    "batch_counts",
    sql(
        "SELECT count(*) FILTER (NOT known) AS inserted, "
        "coalesce(sum(n) FILTER (known), 0)::BIGINT AS existing, "
        "coalesce(sum(n - 1) FILTER (NOT known), 0)::BIGINT AS superseded FROM ("
        "SELECT b.n, s.chunk_id IS NOT NULL AS known FROM (SELECT knowledge_type, chunk_id, "
        "count(*) AS n FROM batch GROUP BY ALL) b "
        "LEFT JOIN st s USING (knowledge_type, chunk_id))",
        "st",
        "batch",
    ),
)
def _(spark, folder):
    return store.batch_counts(store_table(spark, folder), _batch(spark, folder))


@query(
    "soft_delete",
    sql(
        f"SELECT chunk_id, deleted OR chunk_id IN (SELECT chunk_id FROM ids) AS deleted, "
        f"CASE WHEN chunk_id IN (SELECT chunk_id FROM ids) THEN '{AT}' END AS deleted_at FROM st",
        "st",
        "ids",
    ),
)
def _(spark, folder):
    at = F.to_timestamp(F.lit(AT))
    changed = store.soft_delete(store_table(spark, folder), _ids(spark, folder), at)
    stamp = F.date_format("deleted_at", "yyyy-MM-dd HH:mm:ss").alias("deleted_at")
    return changed.select("chunk_id", "deleted", stamp)


@query(
    "restore_documents",
    sql(
        "SELECT chunk_id, deleted AND chunk_id NOT IN (SELECT chunk_id FROM ids) AS deleted FROM st",
        "st",
        "ids",
    ),
)
def _(spark, folder):
    changed = store.restore_documents(store_table(spark, folder), _ids(spark, folder))
    return changed.select("chunk_id", "deleted")


@query(
    "restore_report",
    sql(
        "SELECT chunk_id, chunk_id IN (SELECT chunk_id FROM st) AS restored FROM ids", "st", "ids"
    ),
)
def _(spark, folder):
    return store.restore_report(store_table(spark, folder), _ids(spark, folder))


_KEPT = sql(
    f"SELECT {_SHOWN} FROM st WHERE chunk_id NOT IN (SELECT chunk_id FROM ids)", "st", "ids"
)


@query("hard_delete", _KEPT)
def _(spark, folder):
    return store.hard_delete(store_table(spark, folder), _ids(spark, folder)).select(*SHOWN)


@query("delete_by_positions", _KEPT)
def _(spark, folder):
    return store.delete_by_positions(store_table(spark, folder), _ids(spark, folder)).select(*SHOWN)


# Documents to delete: those named by the users that had an error.
cte("gone", "SELECT DISTINCT 'd' || user_id AS doc_id FROM events WHERE event_type = 'error'")


def _gone(spark, folder):
    errors = table(spark, folder, "events").where("event_type = 'error'")
    return errors.select(F.concat(F.lit("d"), "user_id").alias("doc_id"))


@query(
    "delete_document_chunks",
    sql(
        "SELECT chunk_id, doc_id, deleted OR doc_id IN (SELECT doc_id FROM gone) AS deleted FROM st",
        "st",
        "gone",
    ),
)
def _(spark, folder):
    at = F.to_timestamp(F.lit(AT))
    changed = store.delete_document_chunks(store_table(spark, folder), _gone(spark, folder), at)
    return changed.select("chunk_id", "doc_id", "deleted")


@query(
    "delete_document_chunks_hard",
    sql(
        "SELECT chunk_id, doc_id, deleted FROM st WHERE deleted "
        "OR doc_id NOT IN (SELECT doc_id FROM gone)",
        "st",
        "gone",
    ),
)
def _(spark, folder):
    at = F.to_timestamp(F.lit(AT))
    changed = store.delete_document_chunks(
        store_table(spark, folder), _gone(spark, folder), at, hard=True
    )
    return changed.select("chunk_id", "doc_id", "deleted")


@query(
    "count_document_chunks",
    sql(
        "SELECT count(*) AS chunks FROM st WHERE NOT deleted "
        "AND doc_id IN (SELECT doc_id FROM gone)",
        "st",
        "gone",
    ),
)
def _(spark, folder):
    return store.count_document_chunks(store_table(spark, folder), _gone(spark, folder))


@query("purge_deleted", sql(f"SELECT {_SHOWN} FROM st WHERE NOT deleted", "st"))
def _(spark, folder):
    return store.purge_deleted(store_table(spark, folder)).select(*SHOWN)


@query("delete_by_type", sql(f"SELECT {_SHOWN} FROM st WHERE knowledge_type <> 't2'", "st"))
def _(spark, folder):
    return store.delete_by_type(store_table(spark, folder), "t2").select(*SHOWN)


@query(
    "delete_by_type_counts",
    sql(
        "SELECT knowledge_type, count(DISTINCT doc_id) AS documents, count(*) AS chunks, "
        "count(embedding) AS vectors FROM st GROUP BY knowledge_type",
        "st",
    ),
)
def _(spark, folder):
    return store.delete_by_type_counts(store_table(spark, folder))


_OP = (
    "CASE WHEN event_type IN ('signup', 'purchase') THEN 'upsert' WHEN event_type = 'error' "
    "THEN 'soft' WHEN event_type = 'view' THEN 'restore' ELSE 'hard' END"
)
# Final state from the rules one at a time: the last upsert of each key, dropped if a hard delete
# follows it, then the last flag operation after it.
cte("log", f"SELECT user_id AS chunk_id, event_id AS seq, {_OP} AS op, value FROM events")
cte(
    "replayed",
    """
    SELECT u.chunk_id, u.value,
           coalesce((SELECT f.op = 'soft' FROM log f WHERE f.chunk_id = u.chunk_id
                     AND f.seq > u.seq AND f.op IN ('soft', 'restore')
                     ORDER BY f.seq DESC LIMIT 1), FALSE) AS deleted
    FROM (SELECT chunk_id, max(seq) AS seq, max_by(value, seq) AS value FROM log
          WHERE op = 'upsert' GROUP BY chunk_id) u
    WHERE NOT EXISTS (SELECT 1 FROM log h WHERE h.chunk_id = u.chunk_id AND h.op = 'hard'
                      AND h.seq > u.seq)
    """,
)
REPLAYED = sql("SELECT chunk_id, value, deleted FROM replayed", "replayed")


def change_log(events):
    kind = F.col("event_type")
    op = (
        F.when(kind.isin("signup", "purchase"), "upsert")
        .when(kind == "error", "soft")
        .when(kind == "view", "restore")
        .otherwise("hard")
    )
    return events.select(
        F.col("user_id").alias("chunk_id"), F.col("event_id").alias("seq"), op.alias("op"), "value"
    )


@query("replay_changes", REPLAYED)
def _(spark, folder):
    log = change_log(table(spark, folder, "events"))
    return store.replay_changes(log, payload="value").select("chunk_id", "value", "deleted")


_TYPES = ["t0", "t1", "t2", "t3"]
_ROUND_TRIP = (
    "SELECT knowledge_type, count(*) AS chunks, count(embedding) AS vectors, "
    "sum(length(content))::BIGINT AS chars FROM {0} GROUP BY knowledge_type"
)


def _by_type(rows):
    return rows.groupBy("knowledge_type").agg(
        F.count("*").alias("chunks"),
        F.count("embedding").alias("vectors"),
        F.sum(F.length("content")).alias("chars"),
    )


@query("write_store", sql(_ROUND_TRIP.format("st"), "st"))
def _(spark, folder):
    root = scratch_path(spark, "store")
    snapshots.write_store(store_table(spark, folder), root, _TYPES)
    return _by_type(snapshots.read_store(spark, root))


@query("read_store", sql(_ROUND_TRIP.format("(SELECT * FROM st WHERE knowledge_type = 't1')"), "st"))
def _(spark, folder):
    root = scratch_path(spark, "store")
    snapshots.write_store(store_table(spark, folder), root, _TYPES)
    return _by_type(snapshots.read_store(spark, root, ["t1"]))


@query(
    "write_store_one_type",
    sql(
        _ROUND_TRIP.format("(SELECT * FROM st WHERE knowledge_type <> 't1' OR NOT deleted)"), "st"
    ),
)
def _(spark, folder):
    # Purging one type writes a new version of that type and leaves the others alone.
    root = scratch_path(spark, "store")
    snapshots.write_store(store_table(spark, folder), root, _TYPES)
    purged = store.purge_deleted(snapshots.read_store(spark, root, ["t1"]))
    snapshots.write_store(purged, root, ["t1"])
    return _by_type(snapshots.read_store(spark, root))


@query("clear_store", sql(_ROUND_TRIP.format("(SELECT * FROM st WHERE knowledge_type <> 't3')"), "st"))
def _(spark, folder):
    root = scratch_path(spark, "store")
    snapshots.write_store(store_table(spark, folder), root, _TYPES)
    snapshots.clear_store(spark, root, "t3")
    return _by_type(snapshots.read_store(spark, root))


@query("clear_all", "SELECT 0::BIGINT AS total_chunks, 0::BIGINT AS deleted_chunks")
def _(spark, folder):
    root = scratch_path(spark, "store")
    snapshots.write_store(store_table(spark, folder), root, _TYPES)
    snapshots.clear_all(spark, root)
    return store_stats(snapshots.read_store(spark, root))
