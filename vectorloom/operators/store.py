"""Mutations of the keyed store, as functions from the old table to the new one.

Rows are keyed by ``(knowledge_type, chunk_id)``: every type has its own ids. ``seq`` orders the
changes of one batch. Id lists hold ``chunk_id`` and may narrow it by ``knowledge_type``. Batches and id lists are
joined to the store, so a small change is broadcast by Spark and leaves the stored rows in place;
a large one is shuffled by key. ``sources.snapshots`` makes the result durable.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vectorloom.schemas import STORE_ROW
from vectorloom.session import lookup_table

KEY = ["knowledge_type", "chunk_id"]

# What a null ``seq`` stands for: older than any change with a number. Only rows that were added where nothing was
# stored (``sources.snapshots.append_absent``) lie below it.
NO_SEQ = -(2**62)


def age(seq: Column) -> Column:
    """``seq`` as a number that can be compared."""
    return F.coalesce(seq, F.lit(NO_SEQ))


def as_store_rows(df: DataFrame, *extra: str) -> DataFrame:
    """Bring a table to the store columns: missing ones are null, ``deleted`` defaults to false.

    ``extra`` columns are kept behind them, for example one that orders the rows of a batch.
    """
    present = set(df.columns)
    columns = []
    for field in STORE_ROW.fields:
        value = F.col(field.name) if field.name in present else F.lit(None)
        value = value.cast(field.dataType)
        if field.name == "deleted":
            value = F.coalesce(value, F.lit(False))
        columns.append(value.alias(field.name))
    return df.select(*columns, *extra)


def latest_rows(batch: DataFrame, order: str = "seq") -> DataFrame:
    """Last row of every key; all but one row per key and task are dropped before the shuffle.

    Rows of equal order are told apart by a hash of the whole row, so the choice does not depend on the plan.
    """
    hashed = [name for name, kind in batch.dtypes if "map<" not in kind and kind != "variant"]
    newest = Window.partitionBy(*KEY).orderBy(F.col(order).desc(), F.xxhash64(*hashed))
    return batch.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")


def _live(batch: DataFrame) -> DataFrame:
    """Written rows are never deleted."""
    cleared = {"deleted": F.lit(False)}
    if "deleted_at" in batch.columns:
        cleared["deleted_at"] = F.lit(None).cast("timestamp")
    return batch.withColumns(cleared)


def live_rows(batch: DataFrame, order: str = "seq") -> DataFrame:
    """The last row of every key of a batch, not deleted."""
    return _live(latest_rows(batch, order))


def match_keys(left: DataFrame, right: DataFrame, how: str, also: Column | None = None) -> DataFrame:
    """Join by key; rows without a type match rows without a type. The key of ``right`` is not kept."""
    named = right.withColumnsRenamed({column: f"_of_{column}" for column in KEY})
    same = F.col("chunk_id") == F.col("_of_chunk_id")
    same = same & F.col("knowledge_type").eqNullSafe(F.col("_of_knowledge_type"))
    joined = left.join(named, same if also is None else same & also, how)
    return joined.drop(*(f"_of_{column}" for column in KEY))


def stored_rows(store: DataFrame, batch: DataFrame, *columns: str) -> DataFrame:
    """Keys (and more columns) of the stored rows that a batch touches.

    The batch keys are the build side: a small batch is broadcast and the store only scanned, and
    what is left is small enough for the joins that follow.
    """
    return match_keys(store.select(*KEY, *columns), batch.select(*KEY).distinct(), "left_semi")


def replace_rows(
    store: DataFrame, fresh: DataFrame, batch: DataFrame, newer_only: bool = False
) -> DataFrame:
    """``store`` with the rows of ``fresh`` (one per key, the newest of ``batch``) in place of its own.

    With ``newer_only`` the row of the higher ``seq`` stays. Which stored rows go is decided by the keys and
    ``seq`` of ``batch`` alone, so its payload is read once.
    """
    if newer_only:
        stored = stored_rows(store, batch, "seq").select(*KEY, age(F.col("seq")).alias("_stored"))
        fresh = match_keys(fresh, stored, "left").where(
            F.col("_stored").isNull() | (F.col("_stored") <= age(F.col("seq")))
        )
        newest = batch.groupBy(*KEY).agg(F.max(age(F.col("seq"))).alias("_newest"))
        older = age(F.col("seq")) <= F.col("_newest")
        kept = match_keys(store, newest, "left_anti", older)
    else:
        kept = match_keys(store, batch.select(*KEY).distinct(), "left_anti")
    return kept.select(*store.columns).unionByName(fresh.select(*store.columns))


def upsert_documents(
    store: DataFrame, batch: DataFrame, order: str = "seq", newer_only: bool = False
) -> DataFrame:
    """Insert or replace by key; the last row of the batch wins and clears the deleted flag.

    With ``newer_only`` a row that is older than the stored one (by ``seq``) is ignored, so
    batches may arrive in any order and may be applied again.
    """
    return replace_rows(store, live_rows(batch, order), batch, newer_only)


def new_rows(store: DataFrame, batch: DataFrame, order: str = "seq") -> DataFrame:
    """The rows of a batch whose key is not stored, last one per key."""
    # One row per key first: a key with very many rows in the batch never reaches the join.
    newest = latest_rows(batch, order)
    unknown = match_keys(newest, stored_rows(store, batch), "left_anti")
    return _live(unknown).select(*store.columns)


def insert_if_absent(store: DataFrame, batch: DataFrame, order: str = "seq") -> DataFrame:
    """Add only keys that are not stored yet."""
    return store.unionByName(new_rows(store, batch, order))


def batch_counts(store: DataFrame, batch: DataFrame) -> DataFrame:
    """What a batch does, one row.

    ``inserted`` new keys, ``existing`` rows whose key is stored (skipped by ``insert_if_absent``,
    replacing by ``upsert_documents``), ``superseded`` earlier rows of a new key.
    """
    keys = batch.groupBy(*KEY).agg(F.count("*").alias("rows"))
    stored = stored_rows(store, batch).withColumn("known", F.lit(True))
    per_key = match_keys(keys, stored, "left")
    known = F.coalesce(F.col("known"), F.lit(False))
    return per_key.agg(
        F.count_if(~known).alias("inserted"),
        F.coalesce(F.sum(F.when(known, F.col("rows"))), F.lit(0)).alias("existing"),
        F.coalesce(F.sum(F.when(~known, F.col("rows") - 1)), F.lit(0)).alias("superseded"),
    )


def _given(ids: DataFrame) -> list[str]:
    """Key columns of an id list."""
    return [column for column in KEY if column in ids.columns]


def _mark(store: DataFrame, ids: DataFrame) -> DataFrame:
    given = _given(ids)
    hit = ids.select(*given).distinct().withColumn("_hit", F.lit(True))
    return store.join(hit, given, "left").withColumn("_hit", F.col("_hit").isNotNull())


def _set_flag(marked: DataFrame, columns: list[str], deleted: bool, at: Column) -> DataFrame:
    hit = F.col("_hit")
    return marked.withColumns(
        {
            "deleted": F.when(hit, F.lit(deleted)).otherwise(F.col("deleted")),
            "deleted_at": F.when(hit, at.cast("timestamp")).otherwise(F.col("deleted_at")),
        }
    ).select(*columns)


def soft_delete(store: DataFrame, ids: DataFrame, at: Column) -> DataFrame:
    """Flag rows by id; unknown ids change nothing."""
    return _set_flag(_mark(store, ids), store.columns, True, at)


def restore_documents(store: DataFrame, ids: DataFrame) -> DataFrame:
    """Clear the flag of rows by id."""
    return _set_flag(_mark(store, ids), store.columns, False, F.lit(None))


def restore_report(store: DataFrame, ids: DataFrame) -> DataFrame:
    """``(chunk_id, restored)`` per requested id; false for unknown ones."""
    given = _given(ids)
    asked = ids.select(*given).distinct()
    # An id without a type may be stored under several types and is still one answer.
    found = store.select(*given).join(asked, given, "left_semi").distinct()
    found = found.withColumn("_known", F.lit(True))
    return asked.join(found, given, "left").select(
        *given, F.col("_known").isNotNull().alias("restored")
    )


def hard_delete(store: DataFrame, ids: DataFrame) -> DataFrame:
    """Remove rows by id, vectors included."""
    given = _given(ids)
    return store.join(ids.select(*given).distinct(), given, "left_anti").select(*store.columns)


def delete_by_positions(vectors: DataFrame, ids: DataFrame) -> DataFrame:
    """Remove vectors from an index table. Rows have no positions here; ids identify them."""
    return hard_delete(vectors, ids)


def delete_document_chunks(
    store: DataFrame, doc_ids: DataFrame, at: Column, hard: bool = False
) -> DataFrame:
    """Soft or hard delete all live chunks of some documents."""
    wanted = lookup_table(doc_ids.select("doc_id").distinct().withColumn("_doc", F.lit(True)))
    marked = store.join(wanted, "doc_id", "left").withColumn(
        "_hit", F.col("_doc").isNotNull() & ~F.col("deleted")
    )
    if hard:
        return marked.where(~F.col("_hit")).select(*store.columns)
    return _set_flag(marked, store.columns, True, at)


def count_document_chunks(store: DataFrame, doc_ids: DataFrame) -> DataFrame:
    """How many chunks ``delete_document_chunks`` would delete, one row."""
    live = store.where(~F.col("deleted")).select("doc_id")
    wanted = lookup_table(doc_ids.select("doc_id").distinct())
    return live.join(wanted, "doc_id", "left_semi").agg(
        F.count("*").alias("chunks")
    )


def purge_deleted(store: DataFrame) -> DataFrame:
    """Drop all soft-deleted rows."""
    return store.where(~F.col("deleted"))


def delete_by_type(store: DataFrame, knowledge_type: str) -> DataFrame:
    """Remove a whole type."""
    return store.where(~F.col("knowledge_type").eqNullSafe(F.lit(knowledge_type)))


def delete_by_type_counts(store: DataFrame) -> DataFrame:
    """The dry run: documents, chunks and vectors of every type."""
    return store.groupBy("knowledge_type").agg(
        F.count_distinct("doc_id").alias("documents"),
        F.count("*").alias("chunks"),
        F.count("embedding").alias("vectors"),
    )


# Codes of the change operations; the order has no meaning.
UPSERT, HARD, SOFT, RESTORE = range(4)


def op_code(op: Column) -> Column:
    """Code of an operation name."""
    return (
        F.when(op == "upsert", UPSERT)
        .when(op == "hard", HARD)
        .when(op == "soft", SOFT)
        .when(op == "restore", RESTORE)
    )


def fold_changes(
    log: DataFrame, key: str = "chunk_id", payload: str | None = None, at: str | None = None
) -> DataFrame:
    """Fold a change log ``(key, seq, op)`` to ``(key, present, deleted)`` per key ever seen.

    The last upsert or hard delete decides whether a key exists, a later soft delete or restore
    decides its flag. Sequence and operation share one decimal, wide enough for any sequence number,
    so both are plain ``max`` aggregates with map-side combine: a key with very many changes sends one row per task. The same
    aggregate runs on a stream, with Spark keeping the two numbers per key as state.
    """
    code = op_code(F.col("op"))
    event = F.col("seq").cast("decimal(20,0)") * 4 + code
    structural = F.max(F.when(code.isin(UPSERT, HARD), event))
    flags = F.max(F.when(code.isin(SOFT, RESTORE), event))
    measures = [structural.alias("_structural"), flags.alias("_flag")]
    if payload:
        written = F.when(code == UPSERT, F.col("seq"))
        measures.append(F.max_by(payload, written).alias(payload))
    if at:
        measures.append(F.max_by(at, F.when(code == SOFT, F.col("seq"))).alias("_soft_at"))
    present = F.pmod("_structural", F.lit(4)) == UPSERT
    flagged = (F.col("_flag") > F.col("_structural")) & (F.pmod("_flag", F.lit(4)) == SOFT)
    columns = {"present": F.coalesce(present, F.lit(False))}
    columns["deleted"] = columns["present"] & F.coalesce(flagged, F.lit(False))
    if payload:
        columns[payload] = F.when(columns["present"], F.col(payload))
    if at:
        columns["deleted_at"] = F.when(columns["deleted"], F.col("_soft_at"))
    return log.groupBy(key).agg(*measures).select(
        key, *(column.alias(name) for name, column in columns.items())
    )


def replay_changes(
    log: DataFrame, key: str = "chunk_id", payload: str | None = None, at: str | None = None
) -> DataFrame:
    """Final state of a change log, one row per key that exists."""
    return fold_changes(log, key, payload, at).where("present").drop("present")
