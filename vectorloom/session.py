"""Session helpers: a tuned session for local use and the shared folder for materialised steps."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", name: str = "vectorloom", **conf: str) -> SparkSession:
    """A session for tests and benchmarks; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", cores if cores.isdigit() else "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


# Rows and bytes of an Arrow batch of texts.
TEXT_BATCH_ROWS = 1000
TEXT_BATCH_BYTES = 8 * 1024 * 1024


def small_batches(spark: SparkSession) -> None:
    """Let Arrow batches hold 1,000 rows and 8 MB unless the session asks for less.

    At Spark's 10,000 rows a batch of long texts takes hundreds of MB outside the heap and in the worker.
    """
    for name, most in (("maxRecordsPerBatch", TEXT_BATCH_ROWS), ("maxBytesPerBatch", TEXT_BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        asked = re.fullmatch(r"(\d+)([kmg]?)b?", spark.conf.get(key).lower())
        if asked is None or not 0 < int(asked[1]) << 10 * " kmg".index(asked[2] or " ") <= most:
            spark.conf.set(key, str(most))


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, for checkpoints and intermediate tables.

    It is the one the cluster names in ``spark.checkpoint.dir``. Only a local session that names
    none gets a temporary folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    active = context.getCheckpointDir()
    if active:
        return active.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    folder = tempfile.mkdtemp(prefix="vectorloom-")
    context.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    if (paths := _temporary.get()) is not None:
        paths.append(path)
    return path


_temporary: ContextVar[list[str] | None] = ContextVar("temporary", default=None)


@contextmanager
def temporary_steps(spark: SparkSession) -> Iterator[None]:
    """Delete the steps written inside the block at its end, whether it fails or not.

    For jobs that have stored their results by then, as a micro-batch has: nothing that is read from
    a step may be used afterwards.
    """
    token = _temporary.set([])
    try:
        yield
    finally:
        paths = _temporary.get()
        _temporary.reset(token)
        for path in paths:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Let each query that runs inside the block remove its shuffle files when it ends.

    Otherwise they stay until the driver collects its garbage. For chains of steps that are written and read back;
    a result that is fetched later, as by ``toLocalIterator``, must be read from a step.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


# Tasks for each core, at least, where rows are dealt anew.
TASKS_A_CORE = 4


def dealt(df: DataFrame) -> DataFrame:
    """``df`` dealt evenly to some tasks for each core, at least as many as shuffles have.

    For few bytes that become much work: Spark counts the tasks of a scan by the bytes of its files.
    """
    spark = df.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(partitions, TASKS_A_CORE * spark.sparkContext.defaultParallelism))


def lookup_table(df: DataFrame) -> DataFrame:
    """Write the side of a join that has one row per key.

    Read back as a table it has a known size (Spark broadcasts it if small) and is shuffled on its
    own. That lets the adaptive skew join split a key that is very frequent on the other side;
    straight behind an aggregate it could not.
    """
    return materialise(df, "lookup")


def materialise(df: DataFrame, label: str = "step") -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    The result no longer depends on its lineage: lost executors cannot change or undo it, and
    readers see file sizes and read only the columns they need. ``temporary_steps`` removes the steps
    of a job that has ended; others stay until the folder's owner removes them.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
