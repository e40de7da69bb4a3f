"""Near-duplicates by SimHash: fingerprints, a grid join of segment popcounts, components.

A fingerprint's embedding is the number of set bits in each of its 32 two-bit segments. The Manhattan
distance of two embeddings never exceeds the number of differing bits, so it is a lower bound. The grid
is over groups of coordinates: with ``blocks`` groups and at most ``max_bits`` of distance, at least
``blocks - max_bits`` groups are equal, so every linked pair meets in a cell of one of the grids that
fix so many groups. Pairs of a cell are filtered by the Manhattan bound and then verified exactly.

Cells are read as a sorted stream and hold distinct fingerprints. A cell that grows beyond
``CELL_LIMIT`` is not compared there but split: first by a finer grid over the coordinates that it does
not fix, and what is still too large into blocks, of which every pair of blocks is compared by a task of
its own. No candidate is left out. Of a cell's links only a spanning forest is kept.

Defined results: a text without words has fingerprint zero and links like any other; fingerprints of
repeated rows and copies are one node; a null id is never the name of a component while another id is
there; extra columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectorloom.llm.arrays import SPACED_WORD, lower_ascii, slices, small_batches
from vectorloom.llm.components import connected_components
from vectorloom.llm.rows import without_rows
from vectorloom.session import materialise

SHINGLE_WORDS = 4
MAX_BITS = 4
BLOCKS = 8
CELL_LIMIT = 4096
SEED = 42
_LOW = 0x5555555555555555


def fingerprint(text: str | None, shingle_words: int = SHINGLE_WORDS) -> int:
    """64-bit SimHash of a text: a bit is set if it is set in over half the shingle hashes."""
    words = SPACED_WORD.findall(lower_ascii(text)) if text else []
    if not words:
        return 0
    joined = " ".join(words).encode()
    hashed = xxhash.xxh64_intdigest
    if len(words) <= shingle_words:
        return hashed(joined, SEED)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    if not joined.isascii():
        lengths = np.fromiter((len(word.encode()) for word in words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - shingle_words + 1].tolist()
    stops = ends[shingle_words - 1 :].tolist()
    values = [hashed(joined[i:j], SEED) for i, j in zip(starts, stops, strict=True)]
    return majority(np.array(values, np.uint64))


def majority(values: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    counts = np.zeros(64, np.int64)
    for start in range(0, len(values), 65536):
        part = values[start : start + 65536].astype(">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(values)).view(">u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, fp)`` per row; ``fp`` holds the 64 bits as a signed long."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            values = np.array([fingerprint(t) for t in batch.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(values.view(np.int64))], ["id", "fp"]
            )

    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(scan, "id bigint, fp bigint")


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _popcounts(fp: Column) -> Column:
    """Popcounts of the 32 two-bit segments, in thermometer code: 00, 01 and 11 stand for 0, 1 and 2."""
    low = F.lit(_LOW).cast("bigint")
    high, own = F.shiftrightunsigned(fp, 1).bitwiseAND(low), fp.bitwiseAND(low)
    return high.bitwiseOR(own).bitwiseOR(F.shiftleft(high.bitwiseAND(own), 1))


def popcounts(fps: np.ndarray) -> np.ndarray:
    """The same of an array; the Manhattan distance of two is their number of differing bits."""
    high, own = (fps >> np.uint64(1)) & np.uint64(_LOW), fps & np.uint64(_LOW)
    return (high | own) | ((high & own) << np.uint64(1))


def _grids(segments: list[int], blocks: int, kept: int) -> list[tuple[int, list[int]]]:
    """Every choice of ``kept`` out of ``blocks`` groups of segments: its mask and the segments left."""
    groups = [part.tolist() for part in np.array_split(np.array(segments), blocks)]
    grids = []
    for chosen in itertools.combinations(range(blocks), kept):
        fixed = [segment for group in chosen for segment in groups[group]]
        grids.append((sum(3 << (2 * segment) for segment in fixed), sorted(set(segments) - set(fixed))))
    return grids


def _in_grid(mask: Column) -> Column:
    return F.col("pop").bitwiseAND(mask)


def _near(left: np.ndarray, right: np.ndarray, max_bits: int) -> np.ndarray:
    """Positions within the Manhattan bound and then within the distance itself."""
    maybe = np.flatnonzero(np.bitwise_count(popcounts(left) ^ popcounts(right)) <= max_bits)
    left = left[maybe] if left.ndim and len(left) > 1 else left
    return maybe[np.bitwise_count(left ^ right[maybe]) <= max_bits]


def spanning_links(fps: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Links (positions) of a spanning forest of the fingerprints of one cell."""
    parent = list(range(len(fps)))

    def root(node: int) -> int:
        while parent[node] != node:
            parent[node] = parent[parent[node]]
            node = parent[node]
        return node

    links = []
    for first in range(len(fps) - 1):
        for second in (first + 1 + _near(fps[first : first + 1], fps[first + 1 :], max_bits)).tolist():
            a, b = root(first), root(second)
            if a != b:
                parent[b] = a
                links.append((first, second))
    return links


def _join_cells(cells: DataFrame, max_bits: int, limit: int | None) -> DataFrame:
    """Links ``(a, b, null)`` within cells, and ``(a, null, cell)`` for members of cells over ``limit``."""
    partitions = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = cells.repartition(partitions, "cell").sortWithinPartitions("cell", "fp")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, fps = np.array([], np.int64), np.array([], np.int64)
        large = None
        for batch in batches:
            cells = np.concatenate([cells, batch.column("cell").to_numpy()])
            fps = np.concatenate([fps, batch.column("fp").to_numpy()])
            if not len(cells):
                continue
            done = int(np.searchsorted(cells, cells[-1]))  # the last cell may go on in the next batch
            if large == cells[-1] or (limit is not None and len(cells) - done > limit):
                large, done = int(cells[-1]), len(cells)
            yield _compare_runs(cells[:done], fps[:done], max_bits, limit, large)
            cells, fps = cells[done:], fps[done:]
        yield _compare_runs(cells, fps, max_bits, limit, large)

    return ordered.mapInArrow(compare, "a bigint, b bigint, cell bigint")


def _compare_runs(
    cells: np.ndarray, fps: np.ndarray, max_bits: int, limit: int | None, large: int | None
) -> pa.RecordBatch:
    """Compare the members of each run of equal cells; those of large cells are passed on."""
    unsigned = fps.view(np.uint64)
    changes = np.flatnonzero(cells[1:] != cells[:-1]) + 1
    starts = np.concatenate([[0], changes]).astype(np.int64) if len(cells) else changes
    sizes = np.diff(starts, append=len(cells))
    over = np.zeros(len(starts), bool)
    if limit is not None:
        over = (sizes > limit) | (cells[starts] == large)
    two = starts[(sizes == 2) & ~over]  # by far the most: all at once
    near = two[_near(unsigned[two], unsigned[two + 1], max_bits)]
    left, right = [near], [near + 1]
    for run in np.flatnonzero((sizes > 2) & ~over).tolist():
        links = spanning_links(unsigned[starts[run] : starts[run] + sizes[run]], max_bits)
        if links:
            pairs = np.array(links) + starts[run]
            left.append(pairs[:, 0])
            right.append(pairs[:, 1])
    first, second = np.concatenate(left), np.concatenate(right)
    passed = np.flatnonzero(np.repeat(over, sizes))
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.concatenate([fps[first], fps[passed]])),
            pa.array(fps[second].tolist() + [None] * len(passed), pa.int64()),
            pa.array([None] * len(first) + cells[passed].tolist(), pa.int64()),
        ],
        ["a", "b", "cell"],
    )


def near_links(
    nodes: DataFrame, max_bits: int = MAX_BITS, blocks: int = BLOCKS, limit: int = CELL_LIMIT
) -> DataFrame:
    """Links ``(a, b)`` between the distinct fingerprints ``fp`` of ``nodes`` that span all components
    of the relation "at most ``max_bits`` bits differ"."""
    spark = nodes.sparkSession
    if not max_bits < blocks <= 9:
        raise ValueError("blocks must exceed max_bits and be 9 at most")
    kept = blocks - max_bits
    grids = _grids(list(range(32)), blocks, kept)
    rows = nodes.select("fp", _popcounts(F.col("fp")).alias("pop"))

    # The number of the grid is in the cell's low bits.
    def cell(salt: Column, number: Column, mask: Column) -> Column:
        return F.xxhash64(salt, number, _in_grid(mask)).bitwiseAND(F.lit(-128)).bitwiseOR(number)

    names = [
        cell(F.lit(0), F.lit(number).cast("bigint"), F.lit(_signed(mask)).cast("bigint"))
        for number, (mask, _) in enumerate(grids)
    ]
    first = materialise(
        _join_cells(rows.select(F.explode(F.array(*names)).alias("cell"), "fp"), max_bits, limit),
        "cells",
    )
    found = [first]
    large = first.where("cell is not null").select(F.col("a").alias("fp"), F.col("cell").alias("parent"))
    if not large.isEmpty():
        finer = spark.createDataFrame(
            [
                (number, place, _signed(mask))
                for number, (_, rest) in enumerate(grids)
                for place, (mask, _) in enumerate(_grids(rest, 2 * max_bits, max_bits))
            ],
            "grid bigint, place bigint, mask bigint",
        )  # at most a few thousand rows: choices of groups
        split = (
            large.withColumn("pop", _popcounts(F.col("fp")))
            .withColumn("grid", F.col("parent").bitwiseAND(F.lit(127).cast("bigint")))
            .join(F.broadcast(finer), "grid")
            .select(cell(F.col("parent"), F.col("place"), F.col("mask")).alias("cell"), "fp")
        )
        second = materialise(_join_cells(split, max_bits, limit), "cells")
        found.append(second)
        rest = second.where("cell is not null").select(F.col("a").alias("fp"), "cell")
        if not rest.isEmpty():
            found.append(_block_pairs(rest, max_bits, limit))
    links = found[0].where("b is not null").select("a", "b")
    for more in found[1:]:
        links = links.unionByName(more.where("b is not null").select("a", "b"))
    return links.distinct()


def _block_pairs(rows: DataFrame, max_bits: int, limit: int) -> DataFrame:
    """Cells of any size: blocks of about ``limit / 2`` members, each pair of blocks a cell of its own."""
    sizes = materialise(
        rows.groupBy("cell").agg(F.ceil(F.count("*") * 2 / limit).cast("bigint").alias("n_blocks")),
        "cells",
    )
    own = F.pmod(F.xxhash64("fp"), F.col("n_blocks"))
    pairs = (
        rows.join(sizes, "cell")
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_blocks") - 1)))
        .select(F.xxhash64("cell", F.least("own", "other"), F.greatest("own", "other")).alias("cell"), "fp")
    )
    return _join_cells(pairs, max_bits, None)


def near_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_bits: int = MAX_BITS,
    blocks: int = BLOCKS,
    limit: int = CELL_LIMIT,
) -> DataFrame:
    """``(id, fp, component)`` of every row: its fingerprint and the smallest id that links reach."""
    rows = materialise(fingerprints(docs, id_col, text_col), "fingerprints")
    nodes = materialise(rows.groupBy("fp").agg(F.min("id").alias("least")), "nodes")
    grouped = connected_components(near_links(nodes, max_bits, blocks, limit))
    named = nodes.join(grouped, nodes.fp == grouped.node, "left").select(
        "fp", F.coalesce("component", "fp").alias("root"), "least"
    )
    named = materialise(named, "nodes")
    roots = materialise(named.groupBy("root").agg(F.min("least").alias("component")), "nodes")
    names = materialise(named.join(roots, "root").select("fp", "component"), "nodes")
    return rows.join(names, "fp").select("id", "fp", "component")


def keep_first(docs: DataFrame, groups: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One document of each group: that of the smallest id goes on, the others go.

    The few ids that go are joined, not the many that stay. Rows without an id stay; an id that is the
    smallest of any group stays with all rows that repeat it.
    """
    heads = groups.where("id = component").select("id").distinct()
    gone = groups.where("id <> component").select("id").distinct().join(heads, "id", "left_anti")
    gone = materialise(gone.withColumnRenamed("id", "_gone_id"), "gone")
    return docs.join(gone, docs[id_col] == gone["_gone_id"], "left_anti")


def keep_one(docs: DataFrame, groups: DataFrame, row_col: str, id_col: str = "doc_id") -> DataFrame:
    """One row of each group: that of the smallest id (null is the largest), then of the smallest row key.

    ``groups`` has ``(id, component)`` by ``row_col``, which must be unique and written with ``docs``.
    """
    order = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("name"), F.col(row_col).alias("_row"))
    rows = docs.select(F.col(row_col).alias("_key"), order.alias("order"))
    grouped = groups.select(F.col("id").alias("_key"), "component")
    rows = materialise(grouped.join(rows, "_key"), "rows")
    heads = rows.groupBy("component").agg(F.min("order").alias("head"), F.count("*").alias("n"))
    heads = materialise(heads.where("n > 1").select("component", F.col("head._row").alias("head")), "heads")
    gone = rows.join(heads, "component").where("_key <> head").select(F.col("_key").alias("_gone_key"))
    return without_rows(docs, gone, row_col)
