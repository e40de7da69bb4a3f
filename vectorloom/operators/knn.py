"""Exact cosine top-k by block scoring.

Every query has to meet every vector it may return, so the work is one matrix product per pair of
blocks. No row pair is ever materialised: tasks stream Arrow batches of vectors against a block of
queries, keep only the best k per query and emit those. While the queries stay within ``QUERY_BROADCAST_ROWS``
and ``QUERY_BROADCAST_BYTES`` their matrix is broadcast and vectors are not moved. A larger query set takes one
job as well: queries and vectors are dealt to blocks of bounded size, and a block of vectors is grouped with every
block of queries of its group, and with no other.

Vectors and queries may carry a group (a type or an index cell); then a query meets only the
vectors of its groups and k holds per (query, group). A query of the group ``ALL`` meets every
vector.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from vectorloom import settings
from vectorloom.session import materialise

GROUP = "_group"
ALL = "*"
# Groups whose numbers of blocks may be broadcast.
BROADCAST_GROUPS = 500_000
# Hits that a task holds, and rows of a batch that it gives out.
HELD_HITS = 200_000
OUT_ROWS = 10_000


@dataclass
class QueryBlock:
    """Queries of one block: ids and unit vectors, and the rows to use per group."""

    ids: np.ndarray
    matrix: np.ndarray
    rows_by_group: dict[str, np.ndarray]

    @classmethod
    def from_frame(cls, frame: pd.DataFrame) -> QueryBlock:
        unique = frame.drop_duplicates("query_idx")
        ids = unique["query_idx"].to_numpy()
        row_of = pd.Series(np.arange(len(ids)), index=ids)
        rows = row_of.loc[frame["query_idx"]].to_numpy()
        groups = frame[GROUP].to_numpy()
        by_group = {group: rows[groups == group] for group in pd.unique(groups)}
        return cls(ids, unit_rows(to_matrix(unique["embedding"])), by_group)


def to_matrix(vectors: pd.Series) -> np.ndarray:
    return np.array(vectors.tolist(), dtype=np.float64).reshape(len(vectors), -1)


def list_matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Matrix of an Arrow list column without building Python objects."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(set(pc.unique(pc.list_value_length(column)).to_pylist())) > 1:
        raise ValueError("vectors of different dimensions in one search")
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.astype(np.float64).reshape(len(column), -1)


def unit_rows(matrix: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)


def round_scores(scores: np.ndarray) -> np.ndarray:
    """Fixed decimals, and no negative zero."""
    return np.round(scores, settings.SCORE_DIGITS) + 0.0


def best_per_query(hits: pd.DataFrame, k: int) -> pd.DataFrame:
    """First k hits of each (query, group) by score, then id."""
    ordered = hits.sort_values(["score", "chunk_id"], ascending=[False, True])
    return ordered[ordered.groupby(["query_idx", GROUP], sort=False, dropna=False).cumcount() < k]


def block_hits(
    ids: np.ndarray, group: str, scores: np.ndarray, query_ids: np.ndarray, k: int, least: np.ndarray | None = None
) -> pd.DataFrame:
    """The best k of each query in a score matrix (queries x vectors, vectors in id order).

    Scores are compared with the k-th best of the row. Where many vectors tie at that score, as
    copies do, the first ones by id fill up k, so a block never yields more than k per query. ``least`` gives for
    each query a score that k other vectors reach: lower ones are left out at once.
    """
    count = len(ids)
    keep = np.ones(scores.shape, dtype=bool) if least is None else scores >= least[:, None]
    crowded = np.flatnonzero(keep.sum(axis=1) > k) if count > k else []
    if len(crowded):
        of = scores[crowded]
        bar = np.partition(of, count - k, axis=1)[:, count - k, None]
        above, ties = of > bar, of == bar
        room = k - above.sum(axis=1, keepdims=True)
        keep[crowded] = above | (ties & (np.cumsum(ties, axis=1) <= room))
    queries, vectors = np.nonzero(keep)
    return pd.DataFrame(
        {
            "query_idx": query_ids[queries],
            GROUP: group,
            "chunk_id": ids[vectors],
            "score": scores[queries, vectors],
        }
    )


def top_hits(hits: DataFrame, k: int, by: list[str], order: list) -> DataFrame:
    """Rank hits and keep k per key; the limit is applied map-side before the shuffle."""
    window = Window.partitionBy(*by).orderBy(*order)
    return hits.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k)


@dataclass
class Hits:
    """Hits per task that contain the best k per (query, group), and how many can remain.

    ``bound`` is the number of rows left after ranking, where it is known.
    """

    rows: DataFrame
    bound: int | None

    def ranked(self, k: int, by: list[str], order: list) -> DataFrame:
        """The best k per key."""
        return self.hinted(top_hits(self.rows, k, by, order))

    def hinted(self, ranked: DataFrame) -> DataFrame:
        """Ranked hits of proven small number are broadcast in the next join, so the other side (a
        whole store) is not shuffled for a handful of hits."""
        small = self.bound is not None and self.bound <= settings.HIT_BROADCAST_ROWS
        return ranked.hint("broadcast") if small else ranked


Scorer = Callable[[pa.RecordBatch, np.ndarray, np.ndarray, QueryBlock], np.ndarray]


def cosine_scores(
    batch: pa.RecordBatch, rows: np.ndarray, wanted: np.ndarray, block: QueryBlock
) -> np.ndarray:
    """Inner products of some queries with the unit vectors of some batch rows."""
    vectors = unit_rows(list_matrix(batch.column("embedding").take(pa.array(rows))))
    return round_scores(block.matrix[wanted] @ vectors.T)


class RunningTop:
    """Best hits seen so far in one task; merges whenever the pending part outgrows the kept one.

    The k-th best score of each query, once it has k, is the least that later hits must reach.
    """

    def __init__(self, block: QueryBlock, k: int, score: Scorer, block_rows: int):
        self.block, self.k, self.score, self.block_rows = block, k, score, block_rows
        self._kept: list[pd.DataFrame] = []
        self._pending = 0
        self._limit = 100_000
        self._least: dict[str, np.ndarray] = {}
        self._place = pd.Index(block.ids)

    def add(self, batch: pa.RecordBatch) -> None:
        groups = batch.column(GROUP).to_numpy(zero_copy_only=False)
        ids = batch.column("chunk_id").to_numpy(zero_copy_only=False)
        by_id = np.argsort(ids, kind="stable")
        for group in pd.unique(groups):
            asked = [self.block.rows_by_group[key] for key in (group, ALL) if key in self.block.rows_by_group]
            if not asked:
                continue
            wanted = asked[0] if len(asked) == 1 else np.union1d(*asked)
            members = by_id[groups[by_id] == group]
            # A slice of rows at a time keeps the score matrix small for any number of queries.
            step = max(1, min(self.block_rows, 4_000_000 // len(wanted)))
            for start in range(0, len(members), step):
                rows = members[start : start + step]
                scores = self.score(batch, rows, wanted, self.block)
                least = self._least[group][wanted] if group in self._least else None
                found = block_hits(ids[rows], group, scores, self.block.ids[wanted], self.k, least)
                self._kept.append(found)
                self._pending += len(found)
                if self._pending > self._limit:
                    self.merge()

    def merge(self) -> pd.DataFrame | None:
        if not self._kept:
            return None
        best = best_per_query(pd.concat(self._kept, ignore_index=True), self.k)
        self._kept, self._pending = [best], len(best)
        self._limit = max(100_000, 2 * len(best))
        last = best[best.groupby(["query_idx", GROUP], sort=False, dropna=False).cumcount() == self.k - 1]
        for group, of in last.groupby(GROUP, sort=False):
            least = self._least.setdefault(group, np.full(len(self._place), -np.inf))
            least[self._place.get_indexer(of["query_idx"])] = of["score"]
        return best

    def overflow(self) -> pd.DataFrame | None:
        """The best hits, no longer kept, if they are more than a task should hold, as with a very large k.

        They are given out as they are; later ones are compared with them when all hits are ranked.
        """
        if self._pending <= HELD_HITS:
            return None
        best = self.merge()
        if len(best) <= HELD_HITS:
            return None
        self._kept, self._pending = [], 0
        return best


def _hit_schema(vectors: DataFrame, queries: DataFrame) -> T.StructType:
    return T.StructType(
        [
            T.StructField("query_idx", queries.schema["query_idx"].dataType),
            T.StructField(GROUP, T.StringType()),
            T.StructField("chunk_id", vectors.schema["chunk_id"].dataType),
            T.StructField("score", T.DoubleType()),
        ]
    )


def bounded_queries(queries: DataFrame, max_rows: int, max_bytes: int) -> pd.DataFrame | None:
    """The query rows if they fit both bounds, else ``None``. Never fetches more than the rows."""
    frame = queries.limit(max_rows + 1).toPandas()
    if len(frame) > max_rows:
        return None
    size = sum(8 * len(vector) for vector in frame["embedding"])
    return frame if size <= max_bytes else None


def local_hits(
    vectors: DataFrame,
    queries: DataFrame,
    k: int,
    score: Scorer = cosine_scores,
    max_queries: int = settings.QUERY_BROADCAST_ROWS,
    block_rows: int = settings.VECTOR_BLOCK_ROWS,
    prepare: Callable[[QueryBlock], QueryBlock] = lambda block: block,
    scored: str = "embedding",
) -> Hits:
    """Hits ``(query_idx, _group, chunk_id, score)`` that contain the best k per (query, group).

    ``vectors`` has ``chunk_id``, ``_group`` and whatever ``score`` reads, ``queries`` has
    ``query_idx``, ``_group``, ``embedding``. Rows without a value in the ``scored`` column take no
    part.
    """
    schema = _hit_schema(vectors, queries)
    vectors = vectors.where(F.col(scored).isNotNull())
    queries = queries.where(F.col("embedding").isNotNull())

    columns = to_arrow_schema(schema)

    def best_of(block: QueryBlock, batches: Iterator[pa.RecordBatch], step: int) -> Iterator[pa.Table]:
        top = RunningTop(block, k, score, step)
        for batch in batches:
            top.add(batch)
            if (more := top.overflow()) is not None:
                yield pa.Table.from_pandas(more, schema=columns, preserve_index=False)
        if (best := top.merge()) is not None:
            yield pa.Table.from_pandas(best, schema=columns, preserve_index=False)

    small = bounded_queries(queries, max_queries, settings.QUERY_BROADCAST_BYTES)
    if small is None:
        written = materialise(queries.select("query_idx", GROUP, "embedding"), "queries")

        def score_blocks(found: pa.Table, asked: pa.Table) -> pa.Table:
            if not found.num_rows or not asked.num_rows:
                return columns.empty_table()
            frame = asked.select(["query_idx", GROUP, "embedding"]).to_pandas()
            block = prepare(QueryBlock.from_frame(frame))
            return pa.concat_tables([columns.empty_table(), *best_of(block, found.to_batches(), len(found))])

        # Every block is moved once for each block of the other side, so blocks are as large as a task's memory
        # allows; the bounds of a broadcast and of the scan do not make them smaller.
        rows_of = max(max_queries, settings.QUERY_BLOCK_ROWS), max(block_rows, settings.VECTOR_BLOCK_ROWS)
        left, right = dealt_blocks(vectors, written, *rows_of)
        keys = ["_key", "_vector_block", "_query_block"]
        hits = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(score_blocks, schema)
        return Hits(hits, written.count() * k)
    if small.empty:
        return Hits(vectors.sparkSession.createDataFrame([], schema), 0)
    packed = vectors.sparkSession.sparkContext.broadcast(prepare(QueryBlock.from_frame(small)))

    def score_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for best in best_of(packed.value, batches, block_rows):
            yield from best.to_batches(max_chunksize=OUT_ROWS)

    return Hits(vectors.mapInArrow(score_partition, schema), len(small) * k)


def dealt_blocks(
    vectors: DataFrame, queries: DataFrame, max_queries: int, block_rows: int
) -> tuple[DataFrame, DataFrame]:
    """Both sides with ``_key`` (a group, or ``ALL`` for queries that meet every vector), ``_vector_block`` and
    ``_query_block``.

    The number of blocks of a key follows from its rows (and the bytes of its queries), so a key that holds much
    of a table is split on both sides. A row is in one block of its own side and is repeated once for every block
    of the other side that has its key; rows of keys that the other side lacks are left out.
    """
    size = F.sum(F.size("embedding").cast("bigint") * 8)
    asked = queries.groupBy(F.col(GROUP).alias("_key")).agg(F.count("*").alias("n"), size.alias("bytes"))
    wanted = materialise(
        asked.select(
            "_key",
            F.greatest(
                F.ceil(F.col("n") / max_queries), F.ceil(F.col("bytes") / settings.QUERY_BROADCAST_BYTES)
            ).alias("_query_blocks"),
        ),
        "groups",
    )
    everywhere = wanted.where(F.col("_key") == ALL).count() > 0
    named = wanted.where(F.col("_key") != ALL).count()
    own = [F.col(GROUP)] if named else []
    keyed = vectors.withColumn("_key", F.explode(F.array(*own, *([F.lit(ALL)] if everywhere else []))))
    held = keyed.groupBy("_key").agg(F.ceil(F.count("*") / block_rows).alias("_vector_blocks"))
    blocks = materialise(wanted.join(held, "_key"), "groups")
    if named <= BROADCAST_GROUPS:
        blocks = F.broadcast(blocks)

    def dealt(rows: DataFrame, name: str, own: str, other: str) -> DataFrame:
        place = F.pmod(F.xxhash64(name), F.col(f"_{own}_blocks")).alias(f"_{own}_block")
        copies = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(f"_{other}_blocks") - 1))
        return rows.join(blocks, "_key").select(*rows.columns, place, copies.alias(f"_{other}_block"))

    asking = queries.withColumn("_key", F.col(GROUP))
    return dealt(keyed, "chunk_id", "vector", "query"), dealt(asking, "query_idx", "query", "vector")


def score_order() -> list:
    return [F.col("score").desc(), F.col("chunk_id")]


def knn_exact(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = settings.SEARCH_K,
    max_queries: int = settings.QUERY_BROADCAST_ROWS,
    block_rows: int = settings.VECTOR_BLOCK_ROWS,
) -> DataFrame:
    """``(query_idx, chunk_id, score, rank)``: the k vectors closest to each query by cosine.

    ``vectors`` needs ``chunk_id`` and ``embedding``, ``queries`` needs ``query_idx`` and
    ``embedding``. Fewer than k vectors give that many hits.
    """
    grouped = vectors.select("chunk_id", "embedding", F.lit(ALL).alias(GROUP))
    wanted = queries.select("query_idx", "embedding", F.lit(ALL).alias(GROUP))
    hits = local_hits(grouped, wanted, k, max_queries=max_queries, block_rows=block_rows)
    return hits.ranked(k, ["query_idx"], score_order()).select(
        "query_idx", "chunk_id", "score", "rank"
    )
