"""Groups of texts with similar shingle sets: SimHash and min-hash bands for candidates, exact Jaccard for links.

The shingles of a text are its runs of ``SHINGLE_WORDS`` lower-cased words, as 64-bit hashes. Texts of equal
shingle sets are one node. Candidates are the nodes whose SimHash fingerprints differ in few bits, found by the grid
join of segment popcounts (``simhash.near_links``: Manhattan bound, then the exact distance). Pairs at a similarity of
0.8 often differ in more bits than a grid can afford, so nodes that agree in one of ``BANDS`` bands of ``BAND_ROWS``
min-hashes are candidates too; a pair at 0.8 is missed by these with a probability of ``(1 - 0.8^6)^40``, 5 in a
million, and a more similar pair with less. The components of the candidates are bundles: linked texts are
always in one bundle, and most texts are in none. The texts of a bundle are compared exactly, all pairs
that links found so far do not already connect. Bundles that are too large for a task are cut into blocks,
and every pair of blocks is a task of its own.

Defined results: a text of fewer words than a shingle has one shingle of all its words; null and wordless
texts have equal (empty) sets; repeated rows are grouped one by one; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectorloom.llm.arrays import SPACED_WORD, lower_ascii, slices, small_batches
from vectorloom.llm.components import connected_components
from vectorloom.llm.rows import small_side
from vectorloom.llm.simhash import majority, near_links
from vectorloom.session import materialise

SHINGLE_WORDS = 5
SIMILARITY = 0.8
BANDS = 40
BAND_ROWS = 6
# Members and characters of a block; a task holds two blocks.
BLOCK_ROWS = 512
BLOCK_CHARS = 8_000_000
_DRAWN = np.random.default_rng(42).integers(0, 1 << 63, (2, BANDS * BAND_ROWS), np.int64).astype(np.uint64)
_FACTORS, _MASKS = (_DRAWN[0] << np.uint64(1)) | np.uint64(1), _DRAWN[1]


def shingles(text: str | None, words: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles."""
    found = SPACED_WORD.findall(lower_ascii(text)) if text else []
    if not found:
        return np.array([], np.uint64)
    last = max(len(found) - words, 0)
    hashed = {xxhash.xxh64_intdigest(" ".join(found[i : i + words])) for i in range(last + 1)}
    return np.sort(np.fromiter(hashed, np.uint64, len(hashed)))


def similarity(left: np.ndarray, right: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets; that of two empty ones is 1."""
    if not len(left) or not len(right):
        return float(len(left) == len(right))
    at = np.searchsorted(right, left)
    at[at == len(right)] = 0
    common = int((right[at] == left).sum())
    return common / (len(left) + len(right) - common)


def bands(values: np.ndarray) -> list[int]:
    """Names of the cells that a set is in, one of each band (signed)."""
    if not len(values):
        return []
    least = np.full(BANDS * BAND_ROWS, np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(values), 512):
        part = (values[start : start + 512, None] ^ _MASKS) * _FACTORS
        least = np.minimum(least, part.min(axis=0))
    rows = least.reshape(BANDS, BAND_ROWS)
    names = [xxhash.xxh64_intdigest(row.tobytes(), band) for band, row in enumerate(rows)]
    return np.array(names, np.uint64).view(np.int64).tolist()


def compare(sets: list[np.ndarray], least: float = SIMILARITY) -> list[tuple[int, int]]:
    """Links (positions) of a spanning forest of the pairs that are similar enough."""
    sizes = np.array([len(values) for values in sets])
    group = np.arange(len(sets))
    links = []
    for first in range(len(sets) - 1):
        rest = slice(first + 1, None)
        small, large = np.minimum(sizes[rest], sizes[first]), np.maximum(sizes[rest], sizes[first])
        for second in (first + 1 + np.flatnonzero((group[rest] != group[first]) & (small >= least * large))).tolist():
            if group[second] != group[first] and similarity(sets[first], sets[second]) >= least:
                group[group == group[second]] = group[first]
                links.append((first, second))
    return links


def _described(docs: DataFrame) -> DataFrame:
    """``(id, node, size, fp, cells)`` per row of ``docs``: the name of its shingle set, its fingerprint and its
    cells."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            nodes, sizes, fps, cells = [], [], [], []
            for text in batch.column("text").to_pylist():
                values = shingles(text)
                nodes.append(xxhash.xxh64_intdigest(values.tobytes()))
                sizes.append(len(text or ""))
                fps.append(majority(values))
                cells.append(bands(values))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    pa.array(np.array(nodes, np.uint64).view(np.int64)),
                    pa.array(sizes, pa.int64()),
                    pa.array(np.array(fps, np.uint64).view(np.int64)),
                    pa.array(cells, pa.list_(pa.int64())),
                ],
                ["id", "node", "size", "fp", "cells"],
            )

    return docs.mapInArrow(scan, "id bigint, node bigint, size bigint, fp bigint, cells array<bigint>")


def _near_fingerprints(nodes: DataFrame) -> DataFrame:
    """Links ``(a, b)`` of the nodes ``(node, fp)`` with equal or near fingerprints; one node stands for all of a
    fingerprint."""
    heads = materialise(nodes.groupBy("fp").agg(F.min("node").alias("head")), "fingerprints")
    equal = nodes.join(heads, "fp").where("node <> head").select(F.col("node").alias("a"), F.col("head").alias("b"))
    near = near_links(heads.select("fp"))
    for side in ("a", "b"):
        named = heads.select(F.col("fp").alias(side), F.col("head").alias(f"head_{side}"))
        near = near.join(named, side)
    return equal.unionByName(near.select(F.col("head_a").alias("a"), F.col("head_b").alias("b")))


def _candidates(nodes: DataFrame) -> DataFrame:
    """``(node, bundle)`` of the nodes that have a near fingerprint or share a cell with another one."""
    cells = materialise(nodes.select("node", F.explode("cells").alias("cell")), "cells")
    heads = cells.groupBy("cell").agg(F.min("node").alias("head"), F.count("*").alias("n"))
    heads = materialise(heads.where("n > 1").select("cell", "head"), "cells")
    links = cells.join(heads, "cell").where("node <> head")
    links = links.select(F.col("node").alias("a"), F.col("head").alias("b"))
    links = links.unionByName(_near_fingerprints(nodes.select("node", "fp"))).distinct()
    return connected_components(links).withColumnRenamed("component", "bundle")


def _compare_cells(members: DataFrame, least: float) -> DataFrame:
    """Links ``(a, b)`` of the members ``(cell, node, text)`` of each cell."""
    partitions = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = members.repartition(partitions, "cell").sortWithinPartitions("cell", "node")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, nodes, sets = None, [], []

        def flush() -> pa.RecordBatch:
            found = compare(sets, least)
            sides = [pa.array([nodes[link[side]] for link in found], pa.int64()) for side in (0, 1)]
            return pa.RecordBatch.from_arrays(sides, ["a", "b"])

        for batch in slices(batches):
            columns = (batch.column(name).to_pylist() for name in ("cell", "node", "text"))
            for own, node, text in zip(*columns, strict=True):
                if own != cell:
                    yield flush()
                    cell, nodes, sets = own, [], []
                nodes.append(node)
                sets.append(shingles(text))
        yield flush()

    return ordered.mapInArrow(scan, "a bigint, b bigint")


def similar_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    least: float = SIMILARITY,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``(id, component)`` of every row; rows of one component are linked by similar texts.

    ``id_col`` must be unique; ``component`` names a shingle set of the group.
    """
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    rows = materialise(_described(texts), "shingles")
    nodes = rows.groupBy("node").agg(F.min_by(F.struct("id", "size", "fp", "cells"), "id").alias("first"))
    nodes = materialise(nodes.select("node", "first.*"), "nodes")
    bundles = materialise(_candidates(nodes), "bundles")
    members = materialise(nodes.select("node", "id", "size").join(bundles, "node"), "bundles")
    blocks = F.greatest(F.ceil(F.count("*") / block_rows), F.ceil(F.sum("size") / BLOCK_CHARS))
    sizes = materialise(members.groupBy("bundle").agg(blocks.cast("bigint").alias("n_blocks")), "bundles")
    own, other = F.col("own"), F.col("other")
    placed = (
        members.join(sizes, "bundle")
        .withColumn("own", F.pmod(F.xxhash64("node"), F.col("n_blocks")))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_blocks") - 1)))
        .where((own != other) | (F.col("n_blocks") == 1))  # a pair of blocks also compares within each
        .select("id", "node", F.xxhash64("bundle", F.least(own, other), F.greatest(own, other)).alias("cell"))
    )
    placed = small_side(materialise(placed, "placed"))
    links = materialise(_compare_cells(texts.join(placed, "id").select("cell", "node", "text"), least), "links")
    grouped = materialise(connected_components(links.distinct()), "grouped")
    named = rows.select("id", "node").join(grouped, "node", "left")
    return named.select("id", F.coalesce("component", "node").alias("component"))
