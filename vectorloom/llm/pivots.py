"""Exact top-k by inner product with a pivot-distance index.

Vectors get one more component, so that all have the norm of the longest: the largest inner product is then
the smallest distance. A vector's key is its nearest pivot and the distance to it. The index is sorted by
key and cut into annuli (a pivot and a range of distances). For a query at distance ``d`` from a pivot, the
triangle inequality bounds the distance to anything in an annulus from below, and so its score from above.

Search takes blocks of queries of bounded size. The annuli in which the queries themselves lie give each a
first k-th score; then annuli are expanded from the best bound on, and a query stops at an annulus whose
bound is below its k-th score. Bounds have a small slack for rounding; scores are exact integers. Every
vector is in the index and every query meets every annulus that its bound does not rule out.

Pivots come from a bounded sample (``SAMPLE_ROWS`` rows); they change speed, not results.

Defined results: a vector that is null, empty, or holds a component that is null, not finite or beyond 62 bits
when scaled takes no part, nor does one with another number of components than the most common; ties go to the
smaller id; rows that repeat an id are separate candidates but for the query's own id, and each query row is
answered; scores beyond 64 bits count as 2**63 - 1 or its negative; fewer than k candidates give fewer rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vectorloom.session import materialise

SCALE = 256
PIVOTS = 64
SAMPLE_ROWS = 4096
ANNULUS_ROWS = 512
# Bound of one broadcast of queries.
QUERY_BLOCK_BYTES = 16_000_000
SLACK = 1e-9

INDEX = "pivot int, low double, high double, ids binary, vectors binary"


def quantise(rows: DataFrame, id_col: str, vector_col: str, scale: int = SCALE) -> DataFrame:
    """``(id, vec)`` of the valid vectors, components ``floor(scale * x)`` as longs."""
    vectors = F.transform(vector_col, lambda x: x.cast("double"))
    # Infinite components are beyond the range too.
    bad = F.exists("_v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) >= 2.0**62 / scale))
    valid = (
        rows.select(F.col(id_col).cast("bigint").alias("id"), vectors.alias("_v"))
        .where(F.col("_v").isNotNull() & (F.size("_v") > 0) & F.col("id").isNotNull())
        .where(~bad)
    )
    return valid.select("id", F.transform("_v", lambda x: F.floor(x * scale).cast("bigint")).alias("vec"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(-1, width)


def choose_pivots(sample: np.ndarray, pivots: int) -> np.ndarray:
    """Points far from each other: each next one is farthest from those chosen."""
    chosen = [0]
    nearest = np.linalg.norm(sample - sample[0], axis=1)
    while len(chosen) < min(pivots, len(sample)) and nearest.max() > 0:
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, np.linalg.norm(sample - sample[chosen[-1]], axis=1))
    return sample[chosen]


class Space:
    """Vectors with the added component, and their pivots."""

    def __init__(self, longest: float, sample: np.ndarray, pivots: int):
        self.longest = longest  # squared norm
        self.pivots = choose_pivots(self.lift(sample), pivots)

    def lift(self, vectors: np.ndarray) -> np.ndarray:
        rest = np.maximum(self.longest - (vectors**2).sum(axis=1), 0)
        return np.hstack([vectors, np.sqrt(rest)[:, None]])

    def distances(self, vectors: np.ndarray) -> np.ndarray:
        """To every pivot; of vectors with the added component."""
        squares = (
            (vectors**2).sum(axis=1)[:, None] - 2 * vectors @ self.pivots.T + (self.pivots**2).sum(axis=1)
        )
        return np.sqrt(np.maximum(squares, 0))

    def query_distances(self, queries: np.ndarray) -> np.ndarray:
        """Queries lie in the plane where the added component is zero."""
        return self.distances(np.hstack([queries, np.zeros((len(queries), 1))]))


def build_index(vectors: DataFrame, pivots: int = PIVOTS, annulus_rows: int = ANNULUS_ROWS) -> tuple:
    """The annuli of ``(id, vec)`` rows as a table, the space they are in, and their width."""
    spark = vectors.sparkSession
    widths = vectors.groupBy(F.size("vec").alias("width")).count()
    first = widths.orderBy(F.desc("count"), "width").first()
    if first is None:
        return spark.createDataFrame([], INDEX), None, 0
    width = first["width"]
    vectors = vectors.where(F.size("vec") == width)
    square = F.aggregate("vec", F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double"))
    longest = vectors.agg(F.max(square)).first()[0]
    # About twice the sample passes the hash, so tasks send few rows however many there are.
    most = (2 * SAMPLE_ROWS << 40) // first["count"] + 1
    drawn = vectors.where(F.pmod(F.xxhash64("id"), F.lit(1 << 40)) < most)
    sample = drawn.orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS).toPandas()
    if sample.empty:
        sample = vectors.limit(1).toPandas()
    space = Space(float(longest), np.array(sample["vec"].tolist(), np.float64), pivots)
    shared = spark.sparkContext.broadcast(space)

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            away = known.distances(known.lift(_matrix(batch.column("vec"), width)))
            nearest = away.argmin(axis=1)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    batch.column("vec"),
                    pa.array(nearest.astype(np.int32)),
                    pa.array(away[np.arange(len(away)), nearest]),
                ],
                ["id", "vec", "pivot", "away"],
            )

    keyed = vectors.mapInArrow(key, "id bigint, vec array<bigint>, pivot int, away double")
    keyed = materialise(keyed, "pivot-keys")
    ordered = keyed.repartitionByRange("pivot", "away", "id").sortWithinPartitions("pivot", "away", "id")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner = batch.column("pivot").to_numpy()
            away = batch.column("away").to_numpy()
            ids = batch.column("id").to_numpy()
            matrix = _matrix(batch.column("vec"), width).astype(np.int64)
            changes = np.flatnonzero(np.diff(owner)) + 1
            rows = []
            for a, b in zip([0, *changes], [*changes, len(owner)], strict=True):
                for start in range(int(a), int(b), annulus_rows):
                    stop = min(start + annulus_rows, int(b))
                    rows.append(
                        {
                            "pivot": int(owner[start]),
                            "low": away[start],
                            "high": away[stop - 1],
                            "ids": ids[start:stop].tobytes(),
                            "vectors": matrix[start:stop].tobytes(),
                        }
                    )
            if rows:
                yield pa.RecordBatch.from_pylist(rows, _INDEX_TYPE)

    return materialise(ordered.mapInArrow(cut, INDEX), "pivot-index"), space, width


_INDEX_TYPE = pa.schema(
    [("pivot", pa.int32()), ("low", pa.float64()), ("high", pa.float64())]
    + [("ids", pa.binary()), ("vectors", pa.binary())]
)


class _Best:
    """The k best of every query so far: scores descending, then ids ascending."""

    def __init__(self, k: int, first: int, ids: np.ndarray, floor: np.ndarray):
        self.k, self.first, self.ids, self.floor = k, first, ids, floor.copy()
        self.scores: dict[int, np.ndarray] = {}
        self.found: dict[int, np.ndarray] = {}

    def add(self, query: int, ids: np.ndarray, scores: np.ndarray) -> None:
        keep = (scores >= self.floor[query]) & (ids != self.ids[query])
        ids, scores = ids[keep], scores[keep]
        if not len(ids):
            return
        if query in self.scores:
            ids = np.concatenate([self.found[query], ids])
            scores = np.concatenate([self.scores[query], scores])
        order = np.lexsort((ids, -scores))[: self.k]
        self.found[query], self.scores[query] = ids[order], scores[order]
        if len(order) == self.k:
            self.floor[query] = max(self.floor[query], scores[order[-1]])

    def batch(self) -> pa.RecordBatch:
        queries = sorted(self.found)
        counts = [len(self.found[q]) for q in queries]
        none = [np.array([], np.int64)]
        numbers = np.array(queries, np.int64)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(self.first + numbers, counts)),
                pa.array(np.repeat(self.ids[numbers], counts)),
                pa.array(np.concatenate([self.found[q] for q in queries] or none)),
                pa.array(np.concatenate([self.scores[q] for q in queries] or none)),
            ],
            ["query", "query_id", "id", "score"],
        )


def _read(batch: pa.RecordBatch, row: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(batch.column("ids")[row].as_py(), np.int64)
    vectors = np.frombuffer(batch.column("vectors")[row].as_py(), np.int64).reshape(-1, width)
    return ids, vectors


HITS = "query bigint, query_id bigint, id bigint, score bigint"
# Both can be negated.
LONGS = (-(2**63 - 1), 2**63 - 1)


def _search_block(index: DataFrame, space: Space, width: int, first: int, ids, queries, k: int) -> DataFrame:
    """Hits of one block of queries, numbered from ``first``: at most k per query and task."""
    spark = index.sparkSession
    # No product, nor the distances' error, is larger.
    largest = float(np.abs(queries).max() if queries.size else 0) * np.sqrt(space.longest) * width
    lowest = np.full(len(ids), LONGS[0])
    seeds = spark.sparkContext.broadcast((ids, queries, largest))

    def scores(queries: np.ndarray, vectors: np.ndarray, largest: float) -> np.ndarray:
        if largest < 2.0**52:  # products of doubles are whole numbers below 2**53
            return (queries.astype(np.float64) @ vectors.T.astype(np.float64)).astype(np.int64)
        if largest < 2.0**62:
            return queries @ vectors.T
        return np.clip(queries.astype(object) @ vectors.T.astype(object), *LONGS).astype(np.int64)

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, matrix, largest = seeds.value
        best = _Best(k, first, known, lowest)
        places: dict[int, list[int]] = {}
        for number, query in enumerate(known.tolist()):
            places.setdefault(query, []).append(number)
        for batch in batches:
            for row in range(batch.num_rows):
                members, vectors = _read(batch, row, width)
                own = sorted({number for m in members.tolist() for number in places.get(m, ())})
                if own:
                    for query, line in zip(own, scores(matrix[own], vectors, largest), strict=True):
                        best.add(query, members, line)
        yield best.batch()

    # The hits at home of a query come from several tasks: the k-th best of all of them is the bound.
    near = _ranked(index.mapInArrow(home, HITS), k).where(F.col("rank") == k)
    floors = lowest.copy()
    for row in near.select("query", "score").toLocalIterator():  # one row per query of the block
        floors[row["query"] - first] = row["score"]
    shared = spark.sparkContext.broadcast((space, ids, queries, largest, floors))

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space, known, matrix, largest, floors = shared.value
        best = _Best(k, first, known, floors)
        away = space.query_distances(matrix.astype(np.float64))
        own = (matrix.astype(np.float64) ** 2).sum(axis=1)
        for batch in batches:
            pivot = batch.column("pivot").to_numpy()
            low, high = batch.column("low").to_numpy(), batch.column("high").to_numpy()
            d = away[:, pivot]
            least = np.maximum(np.maximum(low - d, d - high), 0)
            bound = (own[:, None] + space.longest - least**2) / 2
            bound += SLACK * (own[:, None] + space.longest) + 1
            for row in np.argsort(-bound.max(axis=0), kind="stable").tolist():
                asks = np.flatnonzero(bound[:, row] >= best.floor)
                if not len(asks):
                    continue
                members, vectors = _read(batch, row, width)
                for start in range(0, len(asks), 1024):
                    part = asks[start : start + 1024]
                    lines = scores(matrix[part], vectors, largest)
                    for at in np.flatnonzero((lines >= best.floor[part][:, None]).any(axis=1)).tolist():
                        best.add(int(part[at]), members, lines[at])
        yield best.batch()

    return index.mapInArrow(expand, HITS)


def _query_blocks(queries: DataFrame, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Queries in blocks of bounded size; the driver holds one block."""
    limit = max(1, QUERY_BLOCK_BYTES // (8 * (width + 1)))
    ids, vectors = [], []
    for row in queries.select("id", "vec").toLocalIterator():
        ids.append(row["id"])
        vectors.append(row["vec"])
        if len(ids) == limit:
            yield np.array(ids, np.int64), np.array(vectors, np.int64)
            ids, vectors = [], []
    if ids:
        yield np.array(ids, np.int64), np.array(vectors, np.int64)


def top_k(vectors: DataFrame, queries: DataFrame, k: int, pivots: int = PIVOTS) -> DataFrame:
    """``(query_id, rank, id, score)``: the k vectors of highest inner product for every query, but its own.

    Both sides are ``(id, vec)`` of whole numbers; queries are a subset of the vectors.
    """
    index, space, width = build_index(vectors, pivots)
    ranked = vectors.sparkSession.createDataFrame([], f"{HITS}, rank int")
    if space is not None:
        asked, first = queries.where(F.size("vec") == width), 0
        for ids, matrix in _query_blocks(asked, width):
            found = materialise(_search_block(index, space, width, first, ids, matrix, k), "hits")
            ranked = ranked.unionByName(_ranked(found, k))
            first += len(ids)
    return ranked.select("query_id", "rank", "id", "score")


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    """The k best hits of every query; a task has given k at most."""
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
