"""Byte-bounded shards by extendible hashing, in DataFrame operations.

A row's hash is the first 48 bits of its key's digest. The directory is indexed by prefix bits of the
hash; a bucket that exceeds the byte limit is split on one more bit, others keep their local depth, until
every bucket fits. Sums by prefix are taken for many bits at once: rows are summed once by the finest
prefix of a round (combined before the shuffle), and coarser buckets are sums of those sums.

A bucket that holds a single key cannot be split by bits. If it exceeds the limit, its rows are numbered
and dealt to parts, so a key that holds a third of all rows does not overfill a shard.

Defined results: a null text has no bytes; a null key hashes as an empty one; a row larger than the limit
gets a part of its own; an empty table has no shards; extra columns pass through, but for those named
like the ones that are added.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectorloom.plans.ordering import number_rows
from vectorloom.session import materialise

SHARD_BYTES = 1 << 20
HASH_BITS = 48
ROUND_BITS = 8
ADDED = ["bytes", "shard", "local_depth", "shard_bytes", "shard_rows"]


def key_hash(key: str) -> Column:
    """48 bits of the key's digest as a long."""
    digest = F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")))
    return F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("bigint")


def prefix(bits: int) -> Column:
    return F.shiftright("_hash", HASH_BITS - bits)


def assign_shards(
    rows: DataFrame, key: str = "doc_id", text_col: str = "text", limit: int = SHARD_BYTES
) -> DataFrame:
    """``rows`` without the text, with ``bytes`` and the shard of each row.

    ``shard`` is the bucket's prefix in bits and, behind a slash, the part of the bucket.
    """
    columns = [name for name in rows.columns if name not in (text_col, "_hash", *ADDED)]
    narrow = materialise(
        rows.select(
            *columns,
            F.coalesce(F.octet_length(text_col), F.lit(0)).cast("bigint").alias("bytes"),
            key_hash(key).alias("_hash"),
        ),
        "shards",
    )
    total = narrow.agg(F.sum("bytes")).first()[0] or 0
    finest = min(HASH_BITS, max(1, math.ceil(math.log2(total / limit + 1)) + 2))
    slots, used, rest, depth = [], [], narrow.select("_hash", "bytes"), 0
    while True:
        cells = materialise(_cells(rest, depth, finest), "shards")
        buckets = materialise(_buckets(cells), "shards")
        used.append(finest)
        slots.append(_directory(cells, buckets, limit, depth, finest))
        over = buckets.where((F.col("local_depth") == finest) & (F.col("shard_bytes") > limit))
        if finest == HASH_BITS or over.isEmpty():
            break
        rest = materialise(
            rest.withColumn("prefix", prefix(finest)).join(over, "prefix", "left_semi").drop("prefix"),
            "shards",
        )
        depth, finest = finest, min(HASH_BITS, finest + ROUND_BITS)
    return _place(narrow, slots, used, columns, limit)


def _cells(rows: DataFrame, depth: int, finest: int) -> DataFrame:
    """Bytes and rows by the finest prefix, once for each depth of a bucket that the cell is in."""
    summed = rows.groupBy(prefix(finest).alias("cell")).agg(
        F.sum("bytes").alias("bytes"), F.count("*").alias("n")
    )
    above = F.explode(F.sequence(F.lit(depth), F.lit(finest)))
    return summed.select("*", above.alias("local_depth")).withColumn(
        "prefix", F.expr(f"shiftright(cell, {finest} - local_depth)")
    )


def _buckets(cells: DataFrame) -> DataFrame:
    return cells.groupBy("local_depth", "prefix").agg(
        F.sum("bytes").alias("shard_bytes"), F.sum("n").alias("shard_rows")
    )


def _directory(
    cells: DataFrame, buckets: DataFrame, limit: int, depth: int, finest: int
) -> DataFrame:
    """Bucket of every cell that has one: it fits (or cannot be split), and its parent was split."""
    ends = F.col("shard_bytes") <= limit
    if finest == HASH_BITS:
        ends = ends | (F.col("local_depth") == HASH_BITS)
    split = buckets.where(F.col("shard_bytes") > limit).select(
        (F.col("local_depth") + 1).alias("local_depth"), F.col("prefix").alias("parent")
    )
    leaves = buckets.where("local_depth > 0").withColumn("parent", F.shiftright("prefix", 1))
    leaves = leaves.join(split, ["local_depth", "parent"], "left_semi").drop("parent")
    if depth == 0:
        leaves = leaves.unionByName(buckets.where("local_depth = 0"))
    slots = cells.select("cell", "local_depth", "prefix").join(leaves.where(ends), ["local_depth", "prefix"])
    return materialise(slots.withColumn("finest", F.lit(finest)), "shards")


def _place(
    narrow: DataFrame, slots: list[DataFrame], used: list[int], columns: list[str], limit: int
) -> DataFrame:
    """Rows joined with the directory; over all rounds there is one slot for a row."""
    directory = slots[0]
    for table in slots[1:]:
        directory = directory.unionByName(table)
    places = F.explode(F.array(*(F.struct(F.lit(n).alias("f"), prefix(n).alias("c")) for n in used)))
    placed = (
        narrow.withColumn("_place", places)
        .withColumns({"finest": F.col("_place.f"), "cell": F.col("_place.c")})
        .join(directory, ["finest", "cell"])
    )
    bits = F.when(F.col("local_depth") == 0, F.lit("")).otherwise(
        F.expr(f"right(lpad(bin(prefix), {HASH_BITS}, '0'), local_depth)")
    )
    placed = placed.withColumn("shard", bits)
    whole = placed.where(F.col("shard_bytes") <= limit).withColumn("shard", F.concat("shard", F.lit("/0")))
    single = placed.where(F.col("shard_bytes") > limit)
    kept = [*columns, *ADDED]
    if slots[-1].where(F.col("shard_bytes") > limit).isEmpty():
        return whole.select(*kept)
    return whole.select(*kept).unionByName(_parts(single, kept, limit))


def _parts(single: DataFrame, kept: list[str], limit: int) -> DataFrame:
    """Deal the rows of buckets of a single key to parts that fit."""
    most = single.groupBy("shard").agg(F.max("bytes").alias("_most"))
    single = single.drop("_place").withColumn("_row", F.monotonically_increasing_id())
    numbered = number_rows(materialise(single, "shards"), ["shard"], ["_row"], "_number")
    share = F.greatest(F.lit(1), F.floor(F.lit(limit) / F.greatest("_most", F.lit(1))))
    parts = (
        numbered.join(materialise(most, "shards"), "shard")
        .withColumn("shard", F.concat_ws("/", "shard", F.floor(F.col("_number") / share).cast("string")))
        .drop("shard_bytes", "shard_rows")
    )
    parts = materialise(parts, "shards")
    sums = parts.groupBy("shard").agg(
        F.sum("bytes").alias("shard_bytes"), F.count("*").alias("shard_rows")
    )
    return parts.join(materialise(sums, "shards"), "shard").select(*kept)
