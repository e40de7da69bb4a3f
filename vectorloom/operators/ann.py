"""Approximate search as clustered tables and pruned scans."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vectorloom import settings
from vectorloom.functions.vectors import dot, l2_normalize
from vectorloom.operators.chunking import run_once
from vectorloom.operators.knn import (
    ALL,
    GROUP,
    Hits,
    QueryBlock,
    knn_exact,
    list_matrix,
    local_hits,
    round_scores,
    score_order,
    top_hits,
    unit_rows,
)
from vectorloom.session import materialise

# Largest model table (cells or codes) that is brought to the driver and broadcast.
MAX_CELLS = 65_536
MAX_MODEL_BYTES = 256 * 1024 * 1024

# Scores held at once when vectors are assigned to cells.
SLICE_SCORES = 4_000_000
PARALLEL_FITS = 4


@dataclass(frozen=True)
class IndexPlan:
    """What ``choose_index`` decided."""

    kind: str
    nlist: int = 0
    m: int = 0
    nbits: int = 0


def choose_index(
    rows: int,
    policy: str = "auto",
    use_ivf: bool = False,
    use_pq: bool = False,
    nlist: int = settings.IVF_NLIST,
    m: int = settings.PQ_M,
    nbits: int = settings.PQ_NBITS,
) -> IndexPlan:
    """Index kind for a number of rows, by size (``auto``) or by flags (``flags``)."""
    if policy == "flags":
        # Fixed value: below this size an index does not pay.
        if 0 < rows < 1000 or not (use_ivf or use_pq):
            return IndexPlan("flat")
        kind = "_".join(name for name, used in (("ivf", use_ivf), ("pq", use_pq)) if used)
        return IndexPlan(
            kind, nlist if use_ivf else 0, m if use_pq else 0, nbits if use_pq else 0
        )
    # Size steps of the automatic policy.
    if rows < 10_000:
        return IndexPlan("flat")
    if rows < 100_000:
        return IndexPlan("ivf", min(100, rows // 100))
    if rows < 1_000_000:
        return IndexPlan("ivf_pq", min(256, rows // 1000), 8, nbits)
    return IndexPlan("ivf_pq", 1024, 16, nbits)


def choose_index_table(sizes: DataFrame, rows: str = "rows") -> DataFrame:
    """The automatic policy for a table of sizes: adds ``kind``, ``nlist``, ``m``."""
    n = F.col(rows)

    def by_size(flat, ivf, ivf_pq, large) -> Column:
        # Size steps of the automatic policy.
        return (
            F.when(n < 10_000, flat).when(n < 100_000, ivf).when(n < 1_000_000, ivf_pq).otherwise(large)
        )

    nlist = by_size(
        F.lit(0),
        F.least(F.lit(100), F.floor(n / 100)),
        F.least(F.lit(256), F.floor(n / 1000)),
        F.lit(1024),
    )
    return sizes.select(
        *sizes.columns,
        by_size(*map(F.lit, ("flat", "ivf", "ivf_pq", "ivf_pq"))).alias("kind"),
        nlist.cast("int").alias("nlist"),
        by_size(*map(F.lit, (0, 0, 8, 16))).alias("m"),
    )


def _kmeans(points: DataFrame, k: int, seed: int, cosine: bool, iterations: int) -> list[np.ndarray]:
    model = (
        KMeans(k=k, seed=seed, maxIter=iterations, featuresCol="features", initMode="k-means||")
        .setDistanceMeasure("cosine" if cosine else "euclidean")
        .fit(points)
    )
    return model.clusterCenters()


def _training_rows(vectors: DataFrame) -> int:
    rows = vectors.count()
    if rows < settings.MIN_TRAINING_ROWS:
        raise ValueError(f"{rows} vectors are too few to train on")
    return rows


def training_sample(vectors: DataFrame, rows: int, centers: int, seed: int) -> DataFrame:
    """About ``TRAINING_ROWS_A_CENTER`` rows for each center, drawn row by row; all rows if there are fewer.

    Drawing changes how good the centers are, never which vectors are indexed.
    """
    share = settings.TRAINING_ROWS_A_CENTER * centers / rows
    return vectors if share >= 1 else vectors.sample(share, seed)


def ivf_fit(
    vectors: DataFrame, nlist: int = settings.IVF_NLIST, seed: int = 42, iterations: int = 10
) -> DataFrame:
    """Train cells on a sample of the vectors: ``(cell, centroid, center)``.

    Centroids are unit vectors, by which rows are assigned; the center is the mean of the sample's unit vectors in
    the cell, from which residuals and distances are taken. Zero vectors have no direction and take no part in the
    training. The vectors are read once to count them and once to draw the sample, which is written; the passes of the
    training read the sample alone.
    """
    directed = vectors.where(F.exists("embedding", lambda x: x != 0))
    rows = _training_rows(directed)
    cells = min(nlist, rows)
    drawn = training_sample(directed, rows, cells, seed).select(l2_normalize(F.col("embedding")).alias("embedding"))
    drawn = materialise(drawn, "sample")
    points = drawn.select(array_to_vector("embedding").alias("features"))
    centroids = unit_rows(np.array(_kmeans(points, cells, seed, True, iterations)))
    spark = vectors.sparkSession
    trained = spark.createDataFrame(
        [(i, centroid.tolist()) for i, centroid in enumerate(centroids)], "cell int, centroid array<double>"
    )
    mean = vector_to_array(Summarizer.mean(array_to_vector("embedding")))
    centers = ivf_assign(drawn, trained).groupBy("cell").agg(mean.alias("center"))
    own = {row["cell"]: row["center"] for row in centers.collect()}  # one row for each cell
    return spark.createDataFrame(
        [(i, centroid.tolist(), own.get(i, centroid.tolist())) for i, centroid in enumerate(centroids)],
        "cell int, centroid array<double>, center array<double>",
    )


def _bounded_matrix(table: DataFrame, key: str, vector: str) -> tuple[np.ndarray, np.ndarray]:
    """Keys and rows of a small model table, in key order; refuses one that is not small."""
    frame = _model_table(table.select(key, vector), vector).sort_by(key)
    return frame[key].to_numpy(), list_matrix(frame[vector])


def _model_table(table: DataFrame, vector: str) -> pa.Table:
    """A model table as Arrow, its rows and bytes checked before it is fetched."""
    rows, values = table.agg(F.count("*"), F.sum(F.size(vector))).head()
    if rows > MAX_CELLS or 8 * (values or 0) > MAX_MODEL_BYTES:
        raise ValueError(f"a model table of {rows} rows and {values} values is not small")
    return table.toArrow()


def ivf_assign(vectors: DataFrame, centroids: DataFrame) -> DataFrame:
    """Add ``cell``: the centroid with the largest inner product, lowest number on ties; null for a null vector."""
    cells, matrix = _bounded_matrix(centroids, "cell", "centroid")
    model = vectors.sparkSession.sparkContext.broadcast((cells, matrix))

    @F.arrow_udf("int")
    def nearest(embeddings: pa.Array) -> pa.Array:
        names, centers = model.value
        known, unit = _known_units(embeddings)
        found = np.zeros(len(embeddings), dtype=np.int32)
        # In slices, so the score matrix stays small however many cells there are.
        step = max(1, SLICE_SCORES // max(1, len(names)))
        for start in range(0, len(known), step):
            scores = round_scores(unit[start : start + step] @ centers.T)
            found[known[start : start + step]] = names[scores.argmax(axis=1)]
        return pa.array(found, mask=_unknown(known, len(embeddings)))

    return vectors.withColumn("cell", run_once(nearest)(F.col("embedding")))


def _known_units(embeddings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Places of the vectors that are not null, and these vectors on the unit sphere."""
    known = np.flatnonzero(embeddings.is_valid().to_numpy(zero_copy_only=False))
    if not len(known):
        return known, np.zeros((0, 0))
    return known, unit_rows(list_matrix(embeddings.take(pa.array(known))))


class Cells:
    """Centers by cell, for use inside tasks; centroids where a table gives no centers."""

    def __init__(self, centroids: DataFrame):
        center = "center" if "center" in centroids.columns else "centroid"
        self.names, self.matrix = _bounded_matrix(centroids, "cell", center)

    def of(self, cells: np.ndarray) -> np.ndarray:
        place = np.minimum(np.searchsorted(self.names, cells), len(self.names) - 1)
        if not np.array_equal(self.names[place], cells):
            raise ValueError("a cell without a centroid")
        return self.matrix[place]


def _known_points(columns: tuple[pa.Array, ...], cells: Cells | None) -> tuple[np.ndarray, np.ndarray]:
    """Like ``_known_units`` of the first column; with cells in a second one, less the center of the cell."""
    known, unit = _known_units(columns[0])
    if cells is not None and len(known):
        unit = unit - cells.of(columns[1].take(pa.array(known)).to_numpy(zero_copy_only=False))
    return known, unit


def _point_columns(centroids: DataFrame | None) -> list[Column]:
    return [F.col("embedding")] if centroids is None else [F.col("embedding"), F.col("cell")]


def cell_distance(indexed: DataFrame, centroids: DataFrame) -> DataFrame:
    """Add ``distance``: the squared distance of the unit vector to the center of its cell; null for a null
    vector."""
    shared = indexed.sparkSession.sparkContext.broadcast(Cells(centroids))

    @F.arrow_udf("double")
    def squared(embeddings: pa.Array, cells: pa.Array) -> pa.Array:
        known, rest = _known_points((embeddings, cells), shared.value)
        found = np.zeros(len(embeddings))
        if len(known):
            found[known] = (rest**2).sum(axis=1)
        return pa.array(found, mask=_unknown(known, len(embeddings)))

    return indexed.withColumn("distance", run_once(squared)(F.col("embedding"), F.col("cell")))


def _unknown(known: np.ndarray, size: int) -> np.ndarray:
    mask = np.ones(size, dtype=bool)
    mask[known] = False
    return mask


def probe_cells(queries: DataFrame, centroids: DataFrame, nprobe: int) -> DataFrame:
    """``(query_idx, embedding, cell)``: the cells each query looks into."""
    cells = centroids.select(F.col("cell").alias("chunk_id"), F.col("centroid").alias("embedding"))
    best = knn_exact(cells, queries, nprobe)
    return queries.join(best.select("query_idx", F.col("chunk_id").alias("cell")), "query_idx")


def _search_cells(
    indexed: DataFrame, centroids: DataFrame, queries: DataFrame, k: int, nprobe: int, run
) -> DataFrame:
    """Search only the probed cells: the scan is pruned to them by a literal list."""
    probes = materialise(probe_cells(queries, centroids, nprobe), "probes")
    wanted = [row["cell"] for row in probes.select("cell").distinct().collect()]
    rows = indexed.where(F.col("cell").isin(wanted)).withColumn(GROUP, F.col("cell").cast("string"))
    grouped = probes.select("query_idx", "embedding", F.col("cell").cast("string").alias(GROUP))
    return run(rows, grouped).ranked(k, ["query_idx"], score_order()).select(
        "query_idx", "chunk_id", "score", "rank"
    )


def ivf_search(
    indexed: DataFrame,
    centroids: DataFrame,
    queries: DataFrame,
    k: int = settings.SEARCH_K,
    nprobe: int = settings.NPROBE,
    **blocks,
) -> DataFrame:
    """Exact scores inside the best ``nprobe`` cells per query.

    A cell is a group of the block scorer: its vectors are scored where they are read, so a cell
    that holds much of the table is split like the files it is stored in.
    """

    def run(rows: DataFrame, grouped: DataFrame) -> Hits:
        return local_hits(rows.select("chunk_id", "embedding", GROUP), grouped, k, **blocks)

    return _search_cells(indexed, centroids, queries, k, nprobe, run)


def _sub_vectors(v: Column, dim: int, m: int) -> list[Column]:
    if dim % m:
        raise ValueError(f"dimension {dim} is not a multiple of {m}")
    width = dim // m
    return [F.slice(v, sub * width + 1, width) for sub in range(m)]


def pq_fit(
    vectors: DataFrame,
    dim: int,
    m: int = settings.PQ_M,
    nbits: int = settings.PQ_NBITS,
    seed: int = 42,
    iterations: int = 10,
    centroids: DataFrame | None = None,
) -> DataFrame:
    """Codebook ``(sub, code, centroid)`` of m sub-vectors with up to 2^nbits codes each, trained on a sample.

    With ``centroids`` the codes are for residuals: what is left of a vector when the center of its cell is
    taken off. The sample is assigned to cells here.
    """
    vectors = vectors.where("embedding is not null").select("embedding")
    rows = _training_rows(vectors)
    codes = min(2**nbits, rows)
    drawn = training_sample(vectors, rows, codes, seed)
    shared = None
    if centroids is not None:
        drawn = ivf_assign(drawn, centroids)
        shared = vectors.sparkSession.sparkContext.broadcast(Cells(centroids))

    @F.arrow_udf("array<double>")
    def point(*columns: pa.Array) -> pa.Array:
        _, points = _known_points(columns, shared.value if shared else None)
        offsets = np.arange(len(points) + 1, dtype=np.int32) * dim
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(points.ravel()))

    points = drawn.select(run_once(point)(*_point_columns(centroids)).alias("_point"))
    # Sub-vectors are written as columns of one table, so each fit reads only its own.
    parts = materialise(
        points.select(
            *(
                array_to_vector(part).alias(f"s{sub}")
                for sub, part in enumerate(_sub_vectors(F.col("_point"), dim, m))
            )
        ),
        "sub-vectors",
    )

    def fit(sub: int) -> list[tuple]:
        features = parts.select(F.col(f"s{sub}").alias("features"))
        centers = _kmeans(features, codes, seed, False, iterations)
        return [(sub, code, center.tolist()) for code, center in enumerate(centers)]

    # The fits are independent jobs; a few at a time keep the cluster busy.
    with ThreadPool(min(m, PARALLEL_FITS)) as pool:
        fitted = pool.map(inheritable_thread_target(vectors.sparkSession)(fit), range(m))
    book = [entry for entries in fitted for entry in entries]
    return vectors.sparkSession.createDataFrame(book, "sub int, code int, centroid array<double>")


def _codebook(book: DataFrame) -> list[np.ndarray]:
    """Centroids per sub-vector, in code order; bounded by m times 2^nbits rows."""
    ordered = _model_table(book, "centroid").sort_by([("sub", "ascending"), ("code", "ascending")])
    subs = ordered["sub"].to_numpy()
    starts = np.flatnonzero(np.diff(subs, prepend=subs[0] - 1)) if len(subs) else []
    return np.split(list_matrix(ordered["centroid"]), starts[1:]) if len(subs) else []


def pq_encode(vectors: DataFrame, book: DataFrame, centroids: DataFrame | None = None) -> DataFrame:
    """Add ``codes``: the nearest centroid of every sub-vector; null for a null vector.

    With ``centroids`` the residual against the center of the row's ``cell`` is encoded.
    """
    cells = Cells(centroids) if centroids is not None else None
    model = vectors.sparkSession.sparkContext.broadcast((_codebook(book), cells))

    @F.arrow_udf("array<int>")
    def encode(*columns: pa.Array) -> pa.Array:
        books, cells = model.value
        known, points = _known_points(columns, cells)
        size = len(columns[0])
        codes = np.zeros((size, len(books)), dtype=np.int32)
        if len(known):
            for sub, (part, centers) in enumerate(zip(np.split(points, len(books), axis=1), books, strict=True)):
                # Squared distance without its constant term.
                codes[known, sub] = ((centers**2).sum(axis=1) - 2 * part @ centers.T).argmin(axis=1)
        offsets = np.arange(size + 1, dtype=np.int32) * len(books)
        unknown = pa.array(_unknown(known, size))
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(codes.ravel()), mask=unknown)

    return vectors.withColumn("codes", run_once(encode)(*_point_columns(centroids)))


def code_distance(encoded: DataFrame, book: DataFrame, centroids: DataFrame | None = None) -> DataFrame:
    """Add ``distance``: the squared distance of the unit vector to what its codes (and cell) stand for."""
    cells = Cells(centroids) if centroids is not None else None
    model = encoded.sparkSession.sparkContext.broadcast((_codebook(book), cells))

    @F.arrow_udf("double")
    def squared(codes: pa.Array, *columns: pa.Array) -> pa.Array:
        books, cells = model.value
        known, points = _known_points(columns, cells)
        found = np.zeros(len(codes))
        if len(known):
            chosen = list_matrix(codes.take(pa.array(known))).astype(np.int64)
            meant = np.hstack([centers[chosen[:, sub]] for sub, centers in enumerate(books)])
            found[known] = ((points - meant) ** 2).sum(axis=1)
        return pa.array(found, mask=_unknown(known, len(codes)))

    return encoded.withColumn("distance", run_once(squared)(F.col("codes"), *_point_columns(centroids)))


def _pq_scoring(spark: SparkSession, book: DataFrame, centroids: DataFrame | None = None) -> dict:
    """Scorer over codes: per query a table of inner products with every code.

    Where codes stand for residuals, the product with the center of the cell is added; the rows that are
    scored together are of one cell.
    """
    cells = Cells(centroids) if centroids is not None else None
    model = spark.sparkContext.broadcast((_codebook(book), cells))

    def prepare(block: QueryBlock) -> QueryBlock:
        books, _ = model.value
        parts = np.split(block.matrix, len(books), axis=1)
        block.tables = [part @ centers.T for part, centers in zip(parts, books, strict=True)]
        return block

    def score(batch, rows, wanted, block) -> np.ndarray:
        _, cells = model.value
        codes = list_matrix(batch.column("codes").take(pa.array(rows))).astype(np.int64)
        total = np.zeros((len(wanted), len(rows)))
        for sub, table in enumerate(block.tables):
            total += table[wanted][:, codes[:, sub]]
        if cells is not None:
            cell = int(batch.column(GROUP)[int(rows[0])].as_py())
            total += (block.matrix[wanted] @ cells.of(np.array([cell]))[0])[:, None]
        return round_scores(total)

    return {"score": score, "prepare": prepare, "scored": "codes"}


def pq_search(
    encoded: DataFrame,
    book: DataFrame,
    queries: DataFrame,
    k: int = settings.SEARCH_K,
    rerank: int = 0,
    **blocks,
) -> DataFrame:
    """Scores from codes only: the scan never reads ``embedding``.

    With ``rerank`` the best ``rerank * k`` candidates are scored again exactly.
    """
    depth = k * max(1, rerank)
    rows = encoded.select("chunk_id", "codes", F.lit(ALL).alias(GROUP))
    wanted = queries.select("query_idx", "embedding", F.lit(ALL).alias(GROUP))
    hits = local_hits(rows, wanted, depth, **_pq_scoring(encoded.sparkSession, book), **blocks)
    best = hits.ranked(depth, ["query_idx"], score_order())
    if rerank:
        best = top_hits(_exact_scores(best, encoded, queries), k, ["query_idx"], score_order())
    return best.select("query_idx", "chunk_id", "score", "rank")


def _exact_scores(hits: DataFrame, vectors: DataFrame, queries: DataFrame) -> DataFrame:
    pairs = hits.select("query_idx", "chunk_id").join(
        vectors.select("chunk_id", "embedding"), "chunk_id"
    )
    wanted = queries.select("query_idx", F.col("embedding").alias("_query"))
    exact = dot(l2_normalize(F.col("embedding")), l2_normalize(F.col("_query")))
    return pairs.join(wanted, "query_idx").select(
        "query_idx", "chunk_id", F.round(exact, settings.SCORE_DIGITS).alias("score")
    )


def ivf_pq_search(
    indexed: DataFrame,
    centroids: DataFrame,
    book: DataFrame,
    queries: DataFrame,
    k: int = settings.SEARCH_K,
    nprobe: int = settings.NPROBE,
    rerank: int = 0,
    residual: bool = True,
    **blocks,
) -> DataFrame:
    """Code scores inside the probed cells.

    Codes are those of residuals (``pq_encode`` with centroids); ``residual=False`` reads codes of the vectors
    themselves. With ``rerank`` the best ``rerank * k`` candidates are scored again exactly.
    """
    depth = k * max(1, rerank)
    scoring = _pq_scoring(indexed.sparkSession, book, centroids if residual else None)

    def run(rows: DataFrame, grouped: DataFrame) -> Hits:
        return local_hits(rows.select("chunk_id", "codes", GROUP), grouped, depth, **scoring, **blocks)

    best = _search_cells(indexed, centroids, queries, depth, nprobe, run)
    if rerank:
        best = top_hits(_exact_scores(best, indexed, queries), k, ["query_idx"], score_order())
    return best.select("query_idx", "chunk_id", "score", "rank")


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """Share of the exact hits that were found, one row."""
    marked = exact.select("query_idx", "chunk_id").join(
        found.select("query_idx", "chunk_id", F.lit(1).alias("_found")),
        ["query_idx", "chunk_id"],
        "left",
    )
    return marked.agg((F.count("_found") / F.count("*")).alias("recall"))


def write_cells(indexed: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write a clustered table, one folder per cell.

    The rebalance puts a cell into few files and splits a large cell by its measured size.
    """
    indexed.hint("rebalance", "cell").write.mode(mode).partitionBy("cell").parquet(path)


# Batch of the rows that an index was trained with.
TRAINED = "trained"


@dataclass(frozen=True)
class Index:
    """A stored index: its rows and model tables."""

    rows: DataFrame
    centroids: DataFrame | None
    book: DataFrame | None


def open_index(spark: SparkSession, path: str) -> Index:
    """The index stored in a folder. Its rows carry ``batch`` and, with cells, ``cell`` and ``distance``."""

    def model(name: str, needed: str) -> DataFrame | None:
        return spark.read.parquet(f"{path}/{name}") if needed in rows.columns else None

    rows = spark.read.parquet(f"{path}/rows")
    return Index(rows, model("centroids", "cell"), model("codebook", "codes"))


def _write_batch(rows: DataFrame, path: str, batch: str, centroids: DataFrame | None, book: DataFrame | None) -> None:
    """Assign and encode rows with given model tables and write them as one batch, in place of an earlier try."""
    if centroids is not None:
        rows = cell_distance(ivf_assign(rows, centroids), centroids)
    if book is not None:
        rows = pq_encode(rows, book, centroids)
    folder = f"{path}/rows/batch={batch}"
    if centroids is None:
        rows.write.mode("overwrite").parquet(folder)
    else:
        write_cells(rows, folder, "overwrite")


def reindex(
    vectors: DataFrame,
    path: str,
    dim: int,
    plan: IndexPlan | None = None,
    seed: int = 42,
) -> tuple[IndexPlan, DataFrame]:
    """Rebuild the index of all vectors in a fresh folder: model tables and clustered rows.

    The chosen kind decides what is trained. Where there are cells and codes, codes are of residuals. Returns the
    plan and the rows read back.
    """
    plan = plan or choose_index(vectors.count())
    rows = vectors.select("chunk_id", "embedding")
    centroids = book = None
    if plan.nlist:
        ivf_fit(rows, plan.nlist, seed).write.parquet(f"{path}/centroids")
        centroids = vectors.sparkSession.read.parquet(f"{path}/centroids")
    if plan.m:
        pq_fit(rows, dim, plan.m, plan.nbits, seed, centroids=centroids).write.parquet(f"{path}/codebook")
        book = vectors.sparkSession.read.parquet(f"{path}/codebook")
    _write_batch(rows, path, TRAINED, centroids, book)
    return plan, open_index(vectors.sparkSession, path).rows.drop("batch", "distance")


def add_to_index(vectors: DataFrame, path: str, batch: str) -> DataFrame:
    """Add new vectors to a stored index by its own cells and codes; nothing stored is read but these.

    The rows become the named batch below ``rows``. Adding a batch again replaces it, so a failed attempt is
    repeated with the same name. Ids are not compared with those stored. Returns the rows of the whole index.
    """
    if batch == TRAINED:
        raise ValueError("the trained batch is written by reindex")
    index = open_index(vectors.sparkSession, path)
    _write_batch(vectors.select("chunk_id", "embedding"), path, batch, index.centroids, index.book)
    return open_index(vectors.sparkSession, path).rows


def index_drift(rows: DataFrame) -> DataFrame:
    """Per cell of an index: rows and mean distance of the trained ones and of those added since.

    Reads the batch, the cell and the stored distance, not the vectors.
    """
    trained = F.col("batch") == TRAINED
    return rows.groupBy("cell").agg(
        F.count(F.when(trained, True)).alias("trained_rows"),
        F.count(F.when(~trained, True)).alias("added_rows"),
        F.sum(F.when(trained, F.col("distance"))).alias("trained_distance"),
        F.sum(F.when(~trained, F.col("distance"))).alias("added_distance"),
    )


def training_due(drift: DataFrame) -> DataFrame:
    """One row: how far the index has drifted from its training, and whether it is to be trained anew.

    ``growth`` is rows by trained rows, ``distance_ratio`` the mean distance of added rows by that of trained ones,
    ``cell_ratio`` how much more the largest cell has grown than all rows. Without added rows nothing is due.
    """
    rows = F.col("trained_rows") + F.col("added_rows")
    total = drift.agg(
        F.sum("trained_rows").alias("t"),
        F.sum("added_rows").alias("a"),
        F.sum("trained_distance").alias("td"),
        F.sum("added_distance").alias("ad"),
        F.max(rows).alias("largest"),
        F.max("trained_rows").alias("trained_largest"),
    )
    mean = lambda distance, n: F.try_divide(F.coalesce(distance, F.lit(0.0)), n)
    ratios = total.select(
        F.col("a").alias("added_rows"),
        F.try_divide(F.col("t") + F.col("a"), F.col("t")).alias("growth"),
        F.try_divide(mean(F.col("ad"), F.col("a")), mean(F.col("td"), F.col("t"))).alias("distance_ratio"),
        F.try_divide(
            F.try_divide(F.col("largest"), F.col("t") + F.col("a")), F.try_divide(F.col("trained_largest"), F.col("t"))
        ).alias("cell_ratio"),
    )
    due = (
        (F.col("growth") >= settings.RETRAIN_ROWS)
        | (F.col("distance_ratio") >= settings.RETRAIN_DISTANCE)
        | (F.col("cell_ratio") >= settings.RETRAIN_CELL)
    )
    return ratios.withColumn("due", (F.col("added_rows") > 0) & F.coalesce(due, F.lit(True)))
