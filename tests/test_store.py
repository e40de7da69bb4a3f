"""Mutations against a plain dictionary model, and durable versions."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from vectorloom.operators import store
from vectorloom.session import materialise, scratch_path
from vectorloom.sources import snapshots

AT = datetime.datetime(2024, 1, 1)


def rows(spark, entries):
    """Entries are (chunk_id, doc_id, content, deleted, seq) of one type."""
    frame = spark.createDataFrame(
        entries, "chunk_id string, doc_id string, content string, deleted boolean, seq long"
    )
    return store.as_store_rows(frame.withColumn("knowledge_type", F.lit("t")))


def state(df):
    return {r["chunk_id"]: (r["content"], r["deleted"]) for r in df.collect()}


def ids(spark, *names):
    return spark.createDataFrame([(name,) for name in names], "chunk_id string")


@pytest.fixture
def base(spark):
    return rows(
        spark,
        [("a", "d1", "a0", False, 0), ("b", "d1", "b0", True, 0), ("c", "d2", "c0", False, 0)],
    )


def test_upsert_last_wins_and_clears_the_flag(spark, base):
    batch = rows(spark, [("b", "d1", "b1", False, 1), ("b", "d1", "b2", True, 2), ("z", "d9", "z1", False, 3)])
    assert state(store.upsert_documents(base, batch)) == {
        "a": ("a0", False), "b": ("b2", False), "c": ("c0", False), "z": ("z1", False),
    }


def test_upsert_newer_only_ignores_stale_rows(spark, base):
    newer = rows(spark, [("a", "d1", "a5", False, 5)])
    older = rows(spark, [("a", "d1", "a3", False, 3), ("n", "d1", "n1", False, 1)])
    merged = store.upsert_documents(store.upsert_documents(base, newer, newer_only=True), older, newer_only=True)
    assert state(merged)["a"] == ("a5", False) and state(merged)["n"] == ("n1", False)


def test_insert_if_absent_and_counts(spark, base):
    batch = rows(spark, [("a", "d1", "a1", False, 1), ("n", "d1", "n1", False, 1), ("n", "d1", "n2", False, 2)])
    assert state(store.insert_if_absent(base, batch)) == {
        "a": ("a0", False), "b": ("b0", True), "c": ("c0", False), "n": ("n2", False),
    }
    assert tuple(store.batch_counts(base, batch).head()) == (1, 1, 1)


def test_the_same_id_of_another_type_is_another_row(spark, base):
    other = rows(spark, [("a", "d1", "other", False, 1)]).withColumn("knowledge_type", F.lit("u"))
    assert store.insert_if_absent(base, other).count() == 4
    narrowed = ids(spark, "a").withColumn("knowledge_type", F.lit("u"))
    assert store.hard_delete(store.upsert_documents(base, other), narrowed).count() == 3


def test_flags(spark, base):
    at = F.lit(AT)
    soft = store.soft_delete(base, ids(spark, "a", "a", "nobody"), at)
    assert state(soft) == {"a": ("a0", True), "b": ("b0", True), "c": ("c0", False)}
    assert soft.where("chunk_id = 'a'").head()["deleted_at"] == AT
    back = store.restore_documents(soft, ids(spark, "a", "nobody"))
    assert state(back)["a"] == ("a0", False)
    assert back.where("chunk_id = 'a'").head()["deleted_at"] is None
    report = store.restore_report(base, ids(spark, "b", "nobody"))
    assert {r["chunk_id"]: r["restored"] for r in report.collect()} == {"b": True, "nobody": False}


def test_document_chunks(spark, base):
    docs = spark.createDataFrame([("d1",)], "doc_id string")
    assert store.count_document_chunks(base, docs).head()[0] == 1
    assert state(store.delete_document_chunks(base, docs, F.lit(AT))) == {
        "a": ("a0", True), "b": ("b0", True), "c": ("c0", False),
    }
    # A hard delete takes live chunks only.
    hard = store.delete_document_chunks(base, docs, F.lit(AT), hard=True)
    assert state(hard) == {"b": ("b0", True), "c": ("c0", False)}


def test_removals(spark, base):
    assert set(state(store.hard_delete(base, ids(spark, "a", "nobody")))) == {"b", "c"}
    assert set(state(store.purge_deleted(base))) == {"a", "c"}
    assert store.delete_by_type(base, "t").count() == 0
    assert tuple(store.delete_by_type_counts(base).head()) == ("t", 2, 3, 0)


def test_replay_equals_sequential_application(spark):
    generator = random.Random(7)
    changes = [
        # One key holds a third of all changes.
        ("hot" if generator.random() < 0.33 else f"k{generator.randrange(40)}", seq,
         generator.choice(["upsert", "soft", "restore", "hard"]))
        for seq in range(1200)
    ]
    expected = {}
    for key, seq, op in changes:
        if op == "upsert":
            expected[key] = (seq, False)
        elif op == "hard":
            expected.pop(key, None)
        elif key in expected:
            expected[key] = (expected[key][0], op == "soft")
    log = spark.createDataFrame(changes, "chunk_id string, seq long, op string").repartition(5)
    got = store.replay_changes(log.withColumn("written", F.col("seq")), payload="written")
    assert {r["chunk_id"]: (r["written"], r["deleted"]) for r in got.collect()} == expected


def test_versions(spark, base):
    root = scratch_path(spark, "versions")
    assert snapshots.read_store(spark, root).count() == 0
    other = rows(spark, [("x", "d5", "x0", False, 0)]).withColumn("knowledge_type", F.lit("u/v w"))
    assert snapshots.write_store(base.unionByName(other), root, ["t", "u/v w"]) == 1
    # Reading and replacing the same type never overwrites the files being read.
    current = snapshots.read_store(spark, root, ["t"])
    assert snapshots.write_store(store.purge_deleted(current), root, ["t"]) == 2
    assert set(state(snapshots.read_store(spark, root))) == {"a", "c", "x"}
    assert snapshots.current_versions(spark, root) == {"t": (2, False), "u/v w": (1, False)}
    snapshots.clear_store(spark, root, "t")
    assert set(state(snapshots.read_store(spark, root))) == {"x"}
    snapshots.write_store(base, root, ["t"])
    assert snapshots.read_store(spark, root).count() == 4
    # A type written without rows is empty.
    snapshots.write_store(base, root, ["u/v w"])
    assert set(state(snapshots.read_store(spark, root))) == {"a", "b", "c"}
    snapshots.clear_all(spark, root)
    assert snapshots.read_store(spark, root).count() == 0


def entry(spark, name, content, seq, kind="t"):
    made = spark.createDataFrame(
        [(name, kind, content, seq)], "chunk_id string, knowledge_type string, content string, seq long"
    )
    return store.as_store_rows(made)


def test_a_writer_lost_before_its_commit_blocks_nobody(spark, base):
    root = scratch_path(spark, "store")
    snapshots.write_store(base, root, ["t"])
    snapshots._stage(entry(spark, "z", "lost", 9), root)  # written, never committed
    assert snapshots.append_store(entry(spark, "x", "x1", 1), root) == 2
    assert set(state(snapshots.read_store(spark, root))) == {"a", "b", "c", "x"}


def test_an_upsert_writes_its_own_rows_only(spark, base):
    root = scratch_path(spark, "store")
    snapshots.write_store(base, root, ["t"])
    snapshots.append_store(entry(spark, "a", "a1", 1), root)
    newest = max(snapshots.live_commits(spark, root), key=lambda row: row["version"])
    assert newest["delta"]
    assert spark.read.parquet(f"{root}/rows/folder={newest['folder']}").count() == 1
    assert state(snapshots.read_store(spark, root))["a"] == ("a1", False)


def test_deltas_merge_on_read(spark, base):
    root = scratch_path(spark, "store")
    changes = [("a", "a2", 2), ("a", "a1", 1), ("n", "n0", None), ("n", "n1", None), ("b", "old", -1)]
    snapshots.write_store(base, root, ["t"])
    for change in changes:
        snapshots.append_store(entry(spark, *change), root)
    snapshots.append_store(entry(spark, "q", "q0", 0, None), root)
    snapshots.append_store(entry(spark, "q", "q1", 1, None), root)
    expected = {"a": ("a2", False), "b": ("b0", True), "c": ("c0", False), "n": ("n1", False), "q": ("q1", False)}
    assert snapshots.read_store(spark, root).count() == len(expected)
    assert state(snapshots.read_store(spark, root)) == expected
    assert set(state(snapshots.read_store(spark, root, [None]))) == {"q"}
    assert snapshots.merge_deltas(spark, root, limit=3) == 1
    snapshots.append_store(entry(spark, "a", "a3", 3), root)
    expected["a"] = ("a3", False)
    assert state(snapshots.read_store(spark, root)) == expected
    assert len([row for row in snapshots.live_commits(spark, root) if row["delta"]]) == 4
    snapshots.compact_store(spark, root)
    assert not [row for row in snapshots.live_commits(spark, root) if row["delta"]]
    assert state(snapshots.read_store(spark, root)) == expected
    versions = snapshots.current_versions(spark, root)
    assert snapshots.vacuum_store(spark, root) == 0  # too young
    assert snapshots.vacuum_store(spark, root, keep_hours=0) == 10  # all but the compacted one
    assert snapshots.current_versions(spark, root) == versions
    assert state(snapshots.read_store(spark, root)) == expected


def test_rows_of_unnamed_types_are_rejects(spark, base):
    root = scratch_path(spark, "store")
    given = base.unionByName(entry(spark, "u", "u0", 0, "other")).unionByName(entry(spark, "q", "q0", 0, None))
    snapshots.write_store(given, root, ["t"])
    assert set(state(snapshots.read_store(spark, root))) == {"a", "b", "c"}
    assert set(state(snapshots.read_rejects(spark, root))) == {"u", "q"}


def test_two_writers_of_one_type(spark, base):
    root = scratch_path(spark, "store")
    snapshots.write_store(base, root, ["t"])
    staged = snapshots._stage

    def meanwhile(rows, where):
        snapshots._stage = staged
        snapshots.append_store(entry(spark, "x", "x1", 1), where)
        return staged(rows, where)

    snapshots._stage = meanwhile
    try:
        with pytest.raises(RuntimeError, match="another writer"):
            snapshots.write_store(base, root, ["t"])
    finally:
        snapshots._stage = staged
    assert "x" in state(snapshots.read_store(spark, root))


def test_rows_read_before_another_commit_are_not_written_back(spark, base):
    root = scratch_path(spark, "store")
    snapshots.write_store(base, root, ["t"])
    current = snapshots.read_store(spark, root)
    seen = snapshots.current_versions(spark, root)
    snapshots.append_store(entry(spark, "n", "n1", 1), root)
    with pytest.raises(RuntimeError, match="after they were read"):
        snapshots.write_store(store.purge_deleted(current), root, ["t"])
    # Rows that went through a table of their own do not show where they come from.
    copied = materialise(store.purge_deleted(current), "copy")
    with pytest.raises(RuntimeError, match="another writer"):
        snapshots.write_store(copied, root, ["t"], expected=seen)
    assert set(state(snapshots.read_store(spark, root))) == {"a", "b", "c", "n"}
    snapshots.write_store(store.purge_deleted(snapshots.read_store(spark, root)), root, ["t"])
    assert set(state(snapshots.read_store(spark, root))) == {"a", "c", "n"}


def test_compaction_keeps_what_is_appended_beside_it(spark, base, monkeypatch):
    root = scratch_path(spark, "store")
    snapshots.write_store(base, root, ["t"])
    snapshots.append_store(entry(spark, "a", "a1", 1), root)
    staged, between = snapshots._stage, []

    def meanwhile(rows, where):
        monkeypatch.setattr(snapshots, "_stage", staged)
        for change in between:
            change()
        return staged(rows, where)

    between.append(lambda: snapshots.append_store(entry(spark, "n", "n1", 1), root))
    monkeypatch.setattr(snapshots, "_stage", meanwhile)
    snapshots.compact_store(spark, root)
    found = state(snapshots.read_store(spark, root))
    assert found["a"] == ("a1", False) and found["n"] == ("n1", False) and set(found) == {"a", "b", "c", "n"}
    assert sum(row["delta"] for row in snapshots.live_commits(spark, root)) == 1
    # A full version written meanwhile wins.
    between[:] = [lambda: snapshots.write_store(entry(spark, "z", "z1", 5), root, ["t"])]
    monkeypatch.setattr(snapshots, "_stage", meanwhile)
    assert snapshots.compact_store(spark, root) is None
    assert set(state(snapshots.read_store(spark, root))) == {"z"}


def test_large_sequence_numbers_are_folded(spark):
    log = spark.createDataFrame(
        [("a", 2**62, "upsert"), ("a", 2**62 + 1, "soft"), ("b", 2**63 - 2, "upsert"), ("b", 2**63 - 1, "hard")],
        "chunk_id string, seq long, op string",
    )
    folded = {r["chunk_id"]: (r["present"], r["deleted"]) for r in store.fold_changes(log).collect()}
    assert folded == {"a": (True, True), "b": (False, False)}


def test_rows_added_where_nothing_is_stored(spark, base):
    root = scratch_path(spark, "store")
    snapshots.write_store(base, root, ["t"])
    before = {r["chunk_id"]: tuple(r) for r in snapshots.read_store(spark, root).collect()}

    def contents():
        rows = snapshots.read_store(spark, root).where("chunk_id IN ('n', 'm', 'k')").collect()
        return {r["chunk_id"]: (r["content"], r["seq"]) for r in rows}

    # Stored rows stay as they are, deleted ones and those without a number too.
    for key in before:
        snapshots.append_absent(entry(spark, key, "other", 99), root)
    assert {r["chunk_id"]: tuple(r) for r in snapshots.read_store(spark, root).collect()} == before
    # Of several added rows the first stays, also one that is added again.
    snapshots.append_absent(entry(spark, "n", "n1", 7), root)
    snapshots.append_absent(entry(spark, "n", "n2", 9), root)
    snapshots.append_absent(entry(spark, "n", "n1", 7), root)
    assert contents() == {"n": ("n1", None)}
    # Changes win over added rows, whichever is first and whether they have a number or not.
    snapshots.append_store(entry(spark, "m", "m1", None), root)
    snapshots.append_absent(entry(spark, "m", "m2", 5), root)
    snapshots.append_absent(entry(spark, "k", "k1", 5), root)
    snapshots.append_store(entry(spark, "k", "k2", None), root)
    wanted = {"n": ("n1", None), "m": ("m1", None), "k": ("k2", None)}
    assert contents() == wanted
    assert snapshots.merge_deltas(spark, root, limit=1) == 1
    assert contents() == wanted
    snapshots.append_absent(entry(spark, "n", "n3", 1), root)
    assert contents() == wanted
    snapshots.compact_store(spark, root)
    snapshots.append_absent(entry(spark, "n", "n4", 1), root)
    assert contents() == wanted
    snapshots.append_store(entry(spark, "n", "n5", 0), root)
    assert contents()["n"] == ("n5", 0)
