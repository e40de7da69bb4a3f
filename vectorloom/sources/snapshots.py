"""Durable versions of the store: full versions, appended deltas, one commit table.

Layout: ``root/rows/folder=<f>/knowledge_type=<t>/*.parquet`` and ``root/commits``, one row per type and
change. Every attempt to write has a folder of its own, and its rows become visible with the commit, which
also takes the number. So a writer that is lost before its commit leaves files that nobody reads, and
blocks nobody; files being read are never overwritten.

A full version replaces what its types held. A delta only adds rows: readers take the newest row of a key
(by ``seq``, then by version; a null ``seq`` is the oldest), and a small delta is broadcast to a scan of the
full version. ``merge_deltas`` keeps the number of deltas small, ``compact_store`` folds them into full
versions, ``vacuum_store`` removes files and commits that no reader needs.

A null type is a type like any other (``None`` in lists of types).
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterable
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vectorloom import settings
from vectorloom.operators.store import KEY, NO_SEQ, age, as_store_rows, replace_rows
from vectorloom.schemas import STORE_COLUMNS, STORE_ROW

_COMMIT = (
    "knowledge_type string, version long, cleared boolean, folder string, delta boolean, covers array<string>"
)
_SCANNED = T.StructType([*STORE_ROW.fields, T.StructField("folder", T.StringType())])

Types = Iterable[str | None] | None


def live_commits(spark: SparkSession, root: str) -> list[Row]:
    """Of every type the newest full version and the deltas after it that no merged delta covers."""
    try:
        commits = spark.read.schema(_COMMIT).json(f"{root}/commits").distinct()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
    place = F.struct("version", "folder")
    of_type = Window.partitionBy("knowledge_type")
    newest = F.max(F.when(~F.col("delta"), place)).over(of_type)
    covered = F.flatten(F.collect_list(F.coalesce("covers", F.array().cast("array<string>"))).over(of_type))
    marked = commits.withColumns({"_full": newest, "_covered": covered})
    # A delta of the same number was committed at the same time: it is covered by name or not at all.
    after = F.col("_full").isNull() | (F.col("version") >= F.col("_full.version"))
    open_delta = F.col("delta") & after & ~F.array_contains("_covered", F.col("folder"))
    is_full = ~F.col("delta") & place.eqNullSafe(F.col("_full"))
    return marked.where(open_delta | is_full).drop("_full", "_covered").collect()


def current_versions(spark: SparkSession, root: str) -> dict[str | None, tuple[int, bool]]:
    """Current version of every committed type, and whether it is empty."""
    newest: dict[str | None, tuple[int, bool]] = {}
    for row in live_commits(spark, root):
        at = (row["version"], row["cleared"])
        newest[row["knowledge_type"]] = max(newest.get(row["knowledge_type"], at), at)
    return newest


def _is_type(names: Iterable[str | None]) -> Column:
    names = list(names)
    named = F.col("knowledge_type").isin([name for name in names if name is not None])
    return named | F.col("knowledge_type").isNull() if None in names else named


def _scan(spark: SparkSession, root: str, commits: list[Row]) -> DataFrame:
    """Rows of some commits with their ``folder``; the scan is pruned to their folders and types."""
    by_folder: dict[str, list[str | None]] = {}
    for row in commits:
        by_folder.setdefault(row["folder"], []).append(row["knowledge_type"])
    if not by_folder:
        return spark.createDataFrame([], _SCANNED)
    rows = (
        spark.read.schema(_SCANNED)
        .option("basePath", f"{root}/rows")
        .parquet(*(f"{root}/rows/folder={folder}" for folder in sorted(by_folder)))
    )
    current = F.lit(False)
    for folder, names in by_folder.items():
        current = current | ((F.col("folder") == folder) & _is_type(names))
    return rows.where(current)


def _place(commit: Row) -> str:
    name = commit["knowledge_type"]
    return commit["folder"] if name is None else f"{commit['folder']}={name}"


def _newest(rows: DataFrame, commits: list[Row]) -> DataFrame:
    """Newest row of every key in rows of deltas."""
    # A folder may hold several types, and a merged one has a version for each.
    version_of = F.create_map(*(F.lit(x) for c in commits for x in (_place(c), c["version"])))
    name = F.coalesce(F.concat(F.lit("="), "knowledge_type"), F.lit(""))
    version = version_of[F.concat("folder", name)]
    order = [age(F.col("seq")).desc(), version.desc(), F.xxhash64(*STORE_COLUMNS)]
    place = F.row_number().over(Window.partitionBy(*KEY).orderBy(*order))
    return rows.withColumn("_n", place).where("_n = 1").select(*STORE_COLUMNS)


def read_store(spark: SparkSession, root: str, types: Types = None) -> DataFrame:
    """Current rows of the store; the scan is pruned to the versions and types asked for."""
    wanted = None if types is None else list(types)
    live = [
        row
        for row in live_commits(spark, root)
        if not row["cleared"] and (wanted is None or row["knowledge_type"] in wanted)
    ]
    return _current_rows(spark, root, live)


def _current_rows(spark: SparkSession, root: str, live: list[Row]) -> DataFrame:
    """Rows of live commits: full versions with their deltas laid over them. Rows added where nothing was
    stored show no ``seq``: their place in time has done its work."""
    rows = _layered_rows(spark, root, live)
    if not any(row["delta"] for row in live):
        return rows
    return rows.withColumn("seq", F.when(F.col("seq") >= NO_SEQ, F.col("seq")))


def _layered_rows(spark: SparkSession, root: str, live: list[Row]) -> DataFrame:
    deltas = [row for row in live if row["delta"]]
    if not deltas:
        return _scan(spark, root, live).select(*STORE_COLUMNS)
    layered = {row["knowledge_type"] for row in deltas}
    fresh = _newest(_scan(spark, root, deltas), deltas)
    base = [row for row in live if not row["delta"] and row["knowledge_type"] in layered]
    if base:
        stored = _scan(spark, root, base).select(*STORE_COLUMNS)
        fresh = replace_rows(stored, fresh, _scan(spark, root, deltas), newer_only=True)
    plain = [row for row in live if row["knowledge_type"] not in layered]
    if not plain:
        return fresh
    return _scan(spark, root, plain).select(*STORE_COLUMNS).unionByName(fresh)


def _stage(rows: DataFrame, root: str) -> str:
    """Write rows to a new folder. The rebalance gives every type few files and splits a large type by its
    measured size."""
    folder = f"w{uuid.uuid4().hex}"
    staged = as_store_rows(rows).hint("rebalance", "knowledge_type")
    staged.write.partitionBy("knowledge_type").parquet(f"{root}/rows/folder={folder}")
    return folder


def _commit(spark: SparkSession, root: str, rows: list[tuple]) -> None:
    spark.createDataFrame(rows, _COMMIT).coalesce(1).write.mode("append").json(f"{root}/commits")


def _next_number(versions: dict[str | None, tuple[int, bool]]) -> int:
    return 1 + max((version for version, _ in versions.values()), default=0)


def _stale_types(rows: DataFrame, root: str, types: list[str | None]) -> list[str | None]:
    """Of the types, those that the rows were read from and that have changed since.

    The plan of the rows tells which folders of the store it reads. A type of which it reads a folder, but not
    all that are live now, was read before another writer's commit.
    """
    marker = f"{root.rstrip('/').split('://')[-1].removeprefix('file:')}/rows/folder="
    read = {file.split(marker, 1)[1].split("/", 1)[0] for file in map(unquote, rows.inputFiles()) if marker in file}
    if not read:
        return []
    spark = rows.sparkSession
    commits = spark.read.schema(_COMMIT).json(f"{root}/commits").where(F.col("folder").isin(sorted(read)))
    ever = {row["knowledge_type"] for row in commits.select("knowledge_type").distinct().collect()}
    live = live_commits(spark, root)
    missed = {row["knowledge_type"] for row in live if row["folder"] not in read}
    return [name for name in types if name in ever and name in missed]


def write_store(
    rows: DataFrame,
    root: str,
    types: list[str | None],
    expected: dict[str | None, tuple[int, bool]] | None = None,
) -> int:
    """Write a new full version of the given types, commit it and return its number.

    A type without rows becomes empty. Rows of types that are not named are written but not committed:
    ``read_rejects`` returns them. Nothing is committed and the write fails if another writer has changed one of
    the types: since the rows were read, where their plan reads the store; since ``expected`` (what
    ``current_versions`` gave), where it is given, as for rows that were written elsewhere in between; and in
    any case since the write began.
    """
    spark = rows.sparkSession
    before = current_versions(spark, root) if expected is None else expected
    stale = _stale_types(rows, root, types)
    if stale:
        raise RuntimeError(f"types {stale} were changed by another writer after they were read")
    folder = _stage(rows, root)
    versions = current_versions(spark, root)
    changed = [name for name in types if versions.get(name) != before.get(name)]
    if changed:
        raise RuntimeError(f"types {changed} were changed by another writer")
    number = _next_number(versions)
    _commit(spark, root, [(name, number, False, folder, False, None) for name in types])
    return number


def append_store(rows: DataFrame, root: str) -> int | None:
    """Add rows to the store and return the version, or ``None`` if there are none.

    Only these rows are written. A row replaces the stored one of its key unless that has a higher
    ``seq``. Appending the same rows again changes nothing, so a repeated attempt is harmless.
    """
    spark = rows.sparkSession
    folder = _stage(rows, root)
    written = spark.read.schema(STORE_ROW).parquet(f"{root}/rows/folder={folder}")
    types = [row["knowledge_type"] for row in written.select("knowledge_type").distinct().collect()]
    if not types:
        return None
    number = _next_number(current_versions(spark, root))
    _commit(spark, root, [(name, number, False, folder, True, None) for name in types])
    return number


def append_absent(rows: DataFrame, root: str) -> int | None:
    """Add rows whose key the store does not hold, without reading the store; the version, or ``None``.

    Rows are written with the time of writing as a place below all changes, the earlier the higher. So readers take
    what was stored or changed by others, else the row that was added first. A repeated attempt lies
    below the first one. ``rows`` has one row per key, and its ``seq`` is not kept.
    """
    place = NO_SEQ - time.time_ns() // 1000
    return append_store(rows.withColumn("seq", F.lit(place).cast("long")), root)


def read_rejects(spark: SparkSession, root: str) -> DataFrame:
    """Rows that current full versions were given beside their types; kept as long as these versions."""
    full = [row for row in live_commits(spark, root) if not row["delta"] and not row["cleared"]]
    if not full:
        return spark.createDataFrame([], STORE_ROW)
    folders = sorted({row["folder"] for row in full})
    rows = (
        spark.read.schema(_SCANNED)
        .option("basePath", f"{root}/rows")
        .parquet(*(f"{root}/rows/folder={folder}" for folder in folders))
    )
    rejected = F.lit(False)
    for folder in folders:
        names = _named_in(spark, root, folder)
        rejected = rejected | ((F.col("folder") == folder) & ~F.coalesce(_is_type(names), F.lit(False)))
    return rows.where(rejected).select(*STORE_COLUMNS)


def _named_in(spark: SparkSession, root: str, folder: str) -> list[str | None]:
    """Types that a folder was ever committed for."""
    commits = spark.read.schema(_COMMIT).json(f"{root}/commits").where(F.col("folder") == folder)
    return [row["knowledge_type"] for row in commits.select("knowledge_type").distinct().collect()]


def merge_deltas(spark: SparkSession, root: str, limit: int = settings.MERGE_DELTAS) -> int:
    """Merge the deltas of types that have more than ``limit`` of them; full versions are not touched.

    The merged delta names the folders that it covers, so one appended meanwhile stays. Returns the
    number of types merged.
    """
    by_type: dict[str | None, list[Row]] = {}
    for row in live_commits(spark, root):
        if row["delta"]:
            by_type.setdefault(row["knowledge_type"], []).append(row)
    crowded = {name: rows for name, rows in by_type.items() if len(rows) > limit}
    if crowded:
        merged = [row for rows in crowded.values() for row in rows]
        folder = _stage(_newest(_scan(spark, root, merged), merged), root)
        _commit(
            spark,
            root,
            [
                (name, max(r["version"] for r in rows), False, folder, True, [r["folder"] for r in rows])
                for name, rows in crowded.items()
            ],
        )
    return len(crowded)


def compact_store(spark: SparkSession, root: str, types: Types = None) -> int | None:
    """Fold deltas into full versions; types without deltas are left alone.

    The full version takes the number of the newest delta that it holds and names its deltas, so one that is
    appended meanwhile lies over it. A type that gets another full version meanwhile is left to that.
    """
    live = live_commits(spark, root)
    layered = {row["knowledge_type"] for row in live if row["delta"]}
    names = [name for name in (layered if types is None else types) if name in layered]
    if not names:
        return None
    held = {name: [row for row in live if row["knowledge_type"] == name] for name in names}
    rows = _current_rows(spark, root, [row for rows in held.values() for row in rows if not row["cleared"]])
    folder = _stage(rows, root)
    full = lambda rows: {(r["knowledge_type"], r["version"], r["folder"]) for r in rows if not r["delta"]}
    now = live_commits(spark, root)
    kept = [name for name in names if full(held[name]) == full(r for r in now if r["knowledge_type"] == name)]
    # Above the full version that it replaces, and not above any delta that it does not hold.
    number = {name: max(row["version"] + (not row["delta"]) for row in held[name]) for name in kept}
    covers = {name: [row["folder"] for row in held[name] if row["delta"]] for name in kept}
    if kept:
        _commit(spark, root, [(name, number[name], False, folder, False, covers[name]) for name in kept])
    return max(number.values(), default=None)


def clear_store(spark: SparkSession, root: str, knowledge_type: str | None) -> None:
    """Empty one type by committing an empty version; ``vacuum_store`` removes the files."""
    versions = current_versions(spark, root)
    if knowledge_type in versions:
        _commit(spark, root, [(knowledge_type, _next_number(versions), True, None, False, None)])


def clear_all(spark: SparkSession, root: str) -> None:
    """Empty every type in one commit."""
    versions = current_versions(spark, root)
    if versions:
        number = _next_number(versions)
        _commit(spark, root, [(name, number, True, None, False, None) for name in versions])


def vacuum_store(spark: SparkSession, root: str, keep_hours: float = 24.0) -> int:
    """Remove folders that no current version uses and fold the commit table into one file.

    A folder is kept for ``keep_hours`` after its last change: a reader may still use it, or a writer
    may be about to commit it. Returns the number of folders removed.
    """
    paths = spark._jvm.org.apache.hadoop.fs.Path
    files = paths(root).getFileSystem(spark._jsc.hadoopConfiguration())

    def listed(folder: str) -> list:
        path = paths(f"{root}/{folder}")
        return list(files.listStatus(path)) if files.exists(path) else []

    commit_files = [status.getPath() for status in listed("commits")]
    live = live_commits(spark, root)
    used = {f"folder={row['folder']}" for row in live}
    oldest = (time.time() - keep_hours * 3600) * 1000
    gone = [
        status.getPath()
        for status in listed("rows")
        if status.getPath().getName() not in used and status.getModificationTime() <= oldest
    ]
    for path in gone:
        files.delete(path, True)
    data_files = [path for path in commit_files if path.getName().startswith("part-")]
    if live and len(data_files) > 1:
        # Duplicates of commits do no harm, so the new file may be there together with the old ones.
        _commit(spark, root, [tuple(row) for row in live])
        for path in data_files:
            files.delete(path, False)
    return len(gone)
