"""Exact row numbers for groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vectorloom.session import materialise


# Offsets (one per partition and group in it) that may be broadcast.
MAX_BROADCAST_OFFSETS = 500_000


def number_rows(
    df: DataFrame, group: Sequence[str], order: Sequence[str], name: str = "position"
) -> DataFrame:
    """Zero-based position of every row inside its group, in the given order.

    ``row_number() over (partition by group)`` sends a whole group to one task, which fails when
    there are three groups. Here rows are range-partitioned by (group, order), so a group spreads
    over as many tasks as its size needs. The sorted rows are written to the shared folder: their
    partition numbers are then data and survive the loss of an executor. Only one count per (partition,
    group) is windowed. The offsets are broadcast only after they have been counted.

    The input is written first as well, because range partitioning reads it twice (sample, then
    shuffle): pass the columns needed, not whole texts, and join the numbers back by id.
    """
    keys = [*group, *order]
    placed = materialise(
        materialise(df, "unordered")
        .repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn("_slot", F.monotonically_increasing_id())
    ).withColumn("_part", F.shiftright("_slot", 33))
    sizes = placed.groupBy("_part", *group).agg(
        F.count("*").alias("_rows"), F.min("_slot").alias("_first")
    )
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = materialise(
        sizes.select(
            "_part",
            *group,
            (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first")).alias("_shift"),
        ),
        "offsets",
    )
    # Null is a group like any other.
    named = offsets.toDF(*(f"_of_{column}" for column in offsets.columns))
    same = placed["_part"] == named["_of__part"]
    for column in group:
        same = same & placed[column].eqNullSafe(named[f"_of_{column}"])
    if offsets.count() <= MAX_BROADCAST_OFFSETS:
        named = F.broadcast(named)
    joined = placed.join(named, same)
    return joined.withColumn(name, F.col("_slot") + F.col("_of__shift")).drop("_part", "_slot", *named.columns)
