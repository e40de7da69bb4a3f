"""Queries of approximate search.

Trained cells and codes cannot be stated in SQL; where cells are given (the label means), they can.
"""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from vectorloom.catalog.registry import cte, label_queries, query, sql, table
from vectorloom.operators import ann
from vectorloom.functions.vectors import dot, l2_normalize
from vectorloom.operators.stats import index_info
from vectorloom.session import materialise, scratch_path

DIM = 64

cte(
    "assigned",
    """
    SELECT * EXCLUDE (n) FROM (
      SELECT e.vec_id, 'c' || e.vec_id AS chunk_id, e.embedding, q.query_idx AS cell,
             row_number() OVER (PARTITION BY e.vec_id ORDER BY
               round(list_inner_product(e.embedding::DOUBLE[], q.q), 12) DESC, q.query_idx) AS n
      FROM embeddings e CROSS JOIN qv q) WHERE n = 1
    """,
)
# Every query (a label mean) looks into its best three cells.
cte(
    "probes",
    """
    SELECT query_idx, cell, q FROM (
      SELECT a.query_idx, b.query_idx AS cell, a.q, row_number() OVER (PARTITION BY a.query_idx
             ORDER BY round(list_cosine_similarity(a.q, b.q), 12) DESC, b.query_idx) AS n
      FROM qv a CROSS JOIN qv b) WHERE n <= 3
    """,
)


def _vectors(spark, folder):
    return table(spark, folder, "embeddings").select(
        F.concat(F.lit("c"), "vec_id").alias("chunk_id"), "embedding"
    )


def _label_cells(spark, folder):
    return label_queries(spark, folder).select(
        F.col("query_idx").alias("cell"), F.col("embedding").alias("centroid")
    )


def _stored(index):
    """An index is written before it is read: each stage then has one Python step, and a task one Python worker."""
    return materialise(index, "index")


@query("ivf_assign", sql("SELECT chunk_id, cell FROM assigned", "assigned"))
def _(spark, folder):
    return ann.ivf_assign(_vectors(spark, folder), _label_cells(spark, folder)).select(
        "chunk_id", "cell"
    )


@query(
    "ivf_search",
    sql(
        """
        SELECT query_idx, chunk_id, score, rank::INTEGER AS rank FROM (
          SELECT *, row_number() OVER (PARTITION BY query_idx ORDER BY score DESC, chunk_id) AS rank
          FROM (SELECT p.query_idx, a.chunk_id,
                round(list_cosine_similarity(a.embedding::DOUBLE[], p.q), 12) + 0.0 AS score
                FROM assigned a JOIN probes p USING (cell))) WHERE rank <= 10
        """,
        "assigned",
        "probes",
    ),
)
def _(spark, folder):
    cells = _label_cells(spark, folder)
    indexed = ann.ivf_assign(_vectors(spark, folder), cells)
    path = scratch_path(spark, "cells")
    ann.write_cells(indexed, path)
    written = spark.read.parquet(path)
    return ann.ivf_search(written, cells, label_queries(spark, folder), 10, nprobe=3)


def _fitted(spark, folder):
    vectors = _vectors(spark, folder)
    centroids = ann.ivf_fit(vectors, nlist=8)
    return vectors, centroids


def _constant(vectors):
    """Trained centers (a bounded table, in the order of their numbers) as one constant column."""
    return F.from_json(F.lit(json.dumps(vectors)), "array<array<double>>")


def _nearest(point, centers, chosen, likeness):
    """Whether no center is more alike than the chosen one, by built-in expressions alone."""
    best = F.array_max(F.transform(centers, lambda center: likeness(point, center)))
    return likeness(point, F.get(centers, chosen)) >= best - 1e-9


@query("ivf_fit", "SELECT 'c' || vec_id AS chunk_id, true AS nearest FROM embeddings")
def _(spark, folder):
    # Every vector lies in the cell whose trained centroid is the nearest of all.
    vectors, centroids = _fitted(spark, folder)
    centers = _constant([row["centroid"] for row in centroids.orderBy("cell").collect()])
    indexed = ann.ivf_assign(vectors, centroids)
    nearest = _nearest(l2_normalize(F.col("embedding")), centers, F.col("cell"), dot)
    return indexed.select("chunk_id", nearest.alias("nearest"))


@query(
    "ivf_search_all_cells",
    sql(
        "SELECT query_idx, chunk_id, score, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER "
        "(PARTITION BY query_idx ORDER BY score DESC, chunk_id) AS rank FROM scored) "
        "WHERE rank <= 10",
        "scored",
    ),
)
def _(spark, folder):
    # Looking into every trained cell gives the exact result.
    vectors, centroids = _fitted(spark, folder)
    indexed = _stored(ann.ivf_assign(vectors, centroids))
    return ann.ivf_search(indexed, centroids, label_queries(spark, folder), 10, nprobe=8)


# A given codebook: the label means cut into eight parts, one code per label.
cte(
    "book",
    """
    SELECT sub, query_idx AS code, list_slice(q, sub * 8 + 1, sub * 8 + 8) AS centroid
    FROM qv CROSS JOIN (SELECT range AS sub FROM range(8))
    """,
)
cte(
    "coded",
    """
    SELECT chunk_id, sub, code, centroid FROM (
      SELECT v.chunk_id, b.sub, b.code, b.centroid, row_number() OVER (
               PARTITION BY v.chunk_id, b.sub ORDER BY round(list_distance(
                 list_slice(v.u, b.sub * 8 + 1, b.sub * 8 + 8), b.centroid), 9), b.code) AS n
      FROM (SELECT 'c' || vec_id AS chunk_id, list_transform(embedding::DOUBLE[], lambda x: x /
              sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS u
            FROM embeddings) v CROSS JOIN book b) WHERE n = 1
    """,
)
cte(
    "code_scores",
    """
    SELECT query_idx, chunk_id, round(sum(list_inner_product(
             list_slice(u, sub * 8 + 1, sub * 8 + 8), centroid)), 12) + 0.0 AS score
    FROM coded CROSS JOIN (SELECT query_idx, list_transform(q, lambda x: x /
           sqrt(list_inner_product(q, q))) AS u FROM qv) GROUP BY query_idx, chunk_id
    """,
)


def _given_book(spark, folder):
    """Codebook that SQL can state: parts of the label means."""
    means = label_queries(spark, folder)
    parts = [F.slice("embedding", sub * 8 + 1, 8) for sub in range(8)]
    return means.select(
        F.col("query_idx").alias("code"), F.posexplode(F.array(*parts)).alias("sub", "centroid")
    )


def _encoded(spark, folder):
    book = _given_book(spark, folder)
    return book, ann.pq_encode(_vectors(spark, folder), book)


def _closeness(a, b):
    """Negative squared distance."""
    square = F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y))
    return -F.aggregate(square, F.lit(0.0), lambda total, x: total + x)


@query(
    "pq_fit",
    "SELECT 'c' || vec_id AS chunk_id, sub::INTEGER AS sub, true AS nearest "
    "FROM embeddings CROSS JOIN (SELECT range AS sub FROM range(8))",
)
def _(spark, folder):
    # Every part of a vector has the code of the trained centroid that is the nearest of all.
    vectors = _vectors(spark, folder)
    book = ann.pq_fit(vectors, DIM)
    coded = ann.pq_encode(vectors, book).withColumn("_unit", l2_normalize(F.col("embedding")))
    trained = [[] for _ in range(8)]
    for row in book.orderBy("sub", "code").collect():
        trained[row["sub"]].append(row["centroid"])
    parts = [
        _nearest(
            F.slice("_unit", sub * 8 + 1, 8), _constant(centers), F.get("codes", F.lit(sub)), _closeness
        )
        for sub, centers in enumerate(trained)
    ]
    return coded.select("chunk_id", F.posexplode(F.array(*parts)).alias("sub", "nearest"))


@query("pq_encode", sql("SELECT chunk_id, sub::INTEGER AS sub, code FROM coded", "coded"))
def _(spark, folder):
    _, encoded = _encoded(spark, folder)
    return encoded.select("chunk_id", F.posexplode("codes").alias("sub", "code"))


_BEST_CODES = """
    SELECT query_idx, chunk_id, score, rank::INTEGER AS rank FROM (
      SELECT *, row_number() OVER (PARTITION BY query_idx ORDER BY score DESC, chunk_id) AS rank
      FROM {0}) WHERE rank <= 10
    """


@query("pq_search", sql(_BEST_CODES.format("code_scores"), "code_scores"))
def _(spark, folder):
    book, encoded = _encoded(spark, folder)
    return ann.pq_search(_stored(encoded), book, label_queries(spark, folder), 10)


@query(
    "ivf_pq_search_whole",
    sql(
        _BEST_CODES.format(
            "(SELECT s.query_idx, s.chunk_id, s.score FROM code_scores s "
            "JOIN assigned a USING (chunk_id) JOIN probes p USING (query_idx, cell))"
        ),
        "code_scores",
        "assigned",
        "probes",
    ),
)
def _(spark, folder):
    # Codes of the vectors themselves.
    book, encoded = _encoded(spark, folder)
    cells = _label_cells(spark, folder)
    indexed = _stored(ann.ivf_assign(_stored(encoded), cells))
    return ann.ivf_pq_search(
        indexed, cells, book, label_queries(spark, folder), 10, nprobe=3, residual=False
    )


# Codes of residuals: what is left of a unit vector beside the centroid of its cell.
cte(
    "residual_codes",
    """
    SELECT chunk_id, cell, sub, code, centroid, rest, own FROM (
      SELECT r.*, b.sub, b.code, b.centroid, row_number() OVER (
               PARTITION BY r.chunk_id, b.sub ORDER BY round(list_distance(
                 list_slice(r.rest, b.sub * 8 + 1, b.sub * 8 + 8), b.centroid), 9), b.code) AS n
      FROM (SELECT a.chunk_id, a.cell, q.q AS own, list_transform(list_zip(list_transform(a.embedding::DOUBLE[],
                     lambda x: x / sqrt(list_inner_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[]))), q.q),
                     lambda z: z[1] - z[2]) AS rest
            FROM assigned a JOIN qv q ON q.query_idx = a.cell) r CROSS JOIN book b) WHERE n = 1
    """,
)


@query(
    "ivf_pq_search",
    sql(
        _BEST_CODES.format(
            """(SELECT s.query_idx, c.chunk_id, round(any_value(list_inner_product(s.u, c.own)) + sum(
                 list_inner_product(list_slice(s.u, c.sub * 8 + 1, c.sub * 8 + 8), c.centroid)), 12) + 0.0 AS score
               FROM residual_codes c JOIN probes p USING (cell)
               JOIN (SELECT query_idx, list_transform(q, lambda x: x / sqrt(list_inner_product(q, q))) AS u FROM qv) s
                 USING (query_idx)
               GROUP BY s.query_idx, c.chunk_id)"""
        ),
        "residual_codes",
        "probes",
    ),
)
def _(spark, folder):
    cells = _label_cells(spark, folder)
    book = _given_book(spark, folder)
    assigned = _stored(ann.ivf_assign(_vectors(spark, folder), cells))
    indexed = _stored(ann.pq_encode(assigned, book, cells))
    return ann.ivf_pq_search(indexed, cells, book, label_queries(spark, folder), 10, nprobe=3)


# Every vector asks as well, and looks into its best two cells.
cte(
    "vector_probes",
    """
    SELECT query_idx, cell, q FROM (
      SELECT e.vec_id AS query_idx, c.query_idx AS cell, e.embedding::DOUBLE[] AS q, row_number() OVER (
               PARTITION BY e.vec_id ORDER BY
               round(list_cosine_similarity(e.embedding::DOUBLE[], c.q), 12) DESC, c.query_idx) AS n
      FROM embeddings e CROSS JOIN qv c) WHERE n <= 2
    """,
)


@query(
    "ivf_search_many",
    sql(
        """
        SELECT query_idx, chunk_id, round(score, 6) AS score, rank::INTEGER AS rank FROM (
          SELECT *, row_number() OVER (PARTITION BY query_idx ORDER BY score DESC, chunk_id) AS rank
          FROM (SELECT p.query_idx, a.chunk_id,
                round(list_cosine_similarity(a.embedding::DOUBLE[], p.q), 12) + 0.0 AS score
                FROM assigned a JOIN vector_probes p USING (cell))) WHERE rank <= 5
        """,
        "assigned",
        "vector_probes",
    ),
)
def _(spark, folder):
    # More queries than one broadcast may hold: blocks of them meet blocks of their cells' vectors.
    cells = _label_cells(spark, folder)
    indexed = _stored(ann.ivf_assign(_vectors(spark, folder), cells))
    queries = table(spark, folder, "embeddings").select(F.col("vec_id").alias("query_idx"), "embedding")
    found = ann.ivf_search(indexed, cells, queries, 5, nprobe=2, max_queries=100, block_rows=200)
    return found.withColumn("score", F.round("score", 6))


def _index_in_two_parts(spark, folder):
    """Label cells, half of the vectors as the trained batch and the others added to it."""
    path = scratch_path(spark, "index")
    _label_cells(spark, folder).write.parquet(f"{path}/centroids")
    _given_book(spark, folder).write.parquet(f"{path}/codebook")
    cells, book = spark.read.parquet(f"{path}/centroids"), spark.read.parquet(f"{path}/codebook")
    number = F.substring("chunk_id", 2, 20).cast("bigint")
    vectors = _vectors(spark, folder)
    ann._write_batch(vectors.where(number % 2 == 0), path, ann.TRAINED, cells, book)
    return ann.add_to_index(vectors.where(number % 2 == 1), path, "added")


cte(
    "cell_distances",
    """
    SELECT a.chunk_id, a.vec_id, a.cell, list_distance(list_transform(a.embedding::DOUBLE[],
             lambda x: x / sqrt(list_inner_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[]))), q.q) ** 2 AS distance
    FROM assigned a JOIN qv q ON q.query_idx = a.cell
    """,
)


@query(
    "index_add",
    sql(
        """
        SELECT d.chunk_id, d.cell, CASE WHEN vec_id % 2 = 0 THEN 'trained' ELSE 'added' END AS batch,
               round(any_value(distance), 6) AS distance, string_agg(code, ',' ORDER BY sub) AS codes
        FROM cell_distances d JOIN residual_codes c USING (chunk_id) GROUP BY ALL
        """,
        "cell_distances",
        "residual_codes",
    ),
)
def _(spark, folder):
    rows = _index_in_two_parts(spark, folder)
    return rows.select(
        "chunk_id",
        "cell",
        "batch",
        F.round("distance", 6).alias("distance"),
        F.concat_ws(",", F.col("codes").cast("array<string>")).alias("codes"),
    )


@query(
    "index_drift",
    sql(
        """
        SELECT cell, count(*) FILTER (vec_id % 2 = 0) AS trained_rows, count(*) FILTER (vec_id % 2 = 1) AS added_rows,
               round(sum(distance) FILTER (vec_id % 2 = 0), 6) AS trained_distance,
               round(sum(distance) FILTER (vec_id % 2 = 1), 6) AS added_distance
        FROM cell_distances GROUP BY cell
        """,
        "cell_distances",
    ),
)
def _(spark, folder):
    drift = ann.index_drift(_index_in_two_parts(spark, folder))
    rounded = {name: F.round(name, 6) for name in ("trained_distance", "added_distance")}
    return drift.withColumns(rounded)


def _recomputed(points, centers, chosen):
    """Squared distance to the chosen of some constant centers, by built-in expressions."""
    return -_closeness(points, F.get(centers, chosen))


@query(
    "ivf_training",
    sql(
        "SELECT count(*) AS vectors, round(sum(distance), 6) AS label_error, true AS checked, true AS beats_labels "
        "FROM cell_distances",
        "cell_distances",
    ),
)
def _(spark, folder):
    # Trained cells, a few more than labels: the reported error is that of a second computation, and
    # smaller than the error of the given label cells. Cells that are all alike would fail.
    vectors = _vectors(spark, folder)
    labels = _label_cells(spark, folder)
    given = ann.cell_distance(ann.ivf_assign(vectors, labels), labels).withColumnRenamed("distance", "given")
    centroids = ann.ivf_fit(vectors, nlist=16)
    centers = _constant([row["center"] for row in centroids.orderBy("cell").collect()])
    both = ann.cell_distance(ann.ivf_assign(given.drop("cell"), centroids), centroids)
    again = _recomputed(l2_normalize(F.col("embedding")), centers, F.col("cell"))
    return both.agg(
        F.count("*").alias("vectors"),
        F.round(F.sum("given"), 6).alias("label_error"),
        (F.abs(F.sum("distance") - F.sum(again)) < 1e-6).alias("checked"),
        (F.sum("distance") < F.sum("given")).alias("beats_labels"),
    )


@query(
    "pq_training",
    sql(
        "SELECT count(DISTINCT chunk_id) AS vectors, round(sum(list_distance(list_slice(rest, sub * 8 + 1, sub * 8 + 8), "
        "centroid) ** 2), 6) AS label_error, true AS beats_labels, true AS residuals_beat_whole FROM residual_codes",
        "residual_codes",
    ),
)
def _(spark, folder):
    # A trained book of residuals is better than the given one, and than a trained book of whole vectors.
    cells, vectors = _label_cells(spark, folder), _vectors(spark, folder)
    book = _given_book(spark, folder)
    assigned = ann.ivf_assign(vectors, cells)
    given = ann.code_distance(ann.pq_encode(assigned, book, cells), book, cells)
    trained = ann.pq_fit(vectors, DIM, nbits=4, centroids=cells)
    own = ann.code_distance(ann.pq_encode(assigned, trained, cells), trained, cells)
    plain = ann.pq_fit(vectors, DIM, nbits=4)
    whole = ann.code_distance(ann.pq_encode(vectors, plain), plain)
    errors = [t.agg(F.count("*").alias(f"n{i}"), F.sum("distance").alias(f"e{i}")) for i, t in enumerate((given, own, whole))]
    return errors[0].crossJoin(errors[1]).crossJoin(errors[2]).select(
        F.col("n0").alias("vectors"),
        F.round("e0", 6).alias("label_error"),
        (F.col("e1") < F.col("e0")).alias("beats_labels"),
        (F.col("e1") < F.col("e2")).alias("residuals_beat_whole"),
    )


@query("pq_search_recall", sql(_BEST_CODES.format("scored"), "scored"))
def _(spark, folder):
    # Codes only choose whom to score again: if that is everybody, the result is the exact one.
    vectors, queries = _vectors(spark, folder), label_queries(spark, folder)
    book = ann.pq_fit(vectors, DIM)
    everybody = -(-vectors.count() // 10)
    return ann.pq_search(_stored(ann.pq_encode(vectors, book)), book, queries, 10, rerank=everybody)


_TABLES = ["documents", "embeddings", "events", "lineitem", "orders", "part", "customer", "supplier"]
_SIZES = " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS rows FROM {t}" for t in _TABLES)


@query(
    "choose_index",
    f"""
    SELECT *, CASE WHEN rows < 10000 THEN 'flat' WHEN rows < 100000 THEN 'ivf' ELSE 'ivf_pq' END AS kind,
           (CASE WHEN rows < 10000 THEN 0 WHEN rows < 100000 THEN least(100, rows // 100)
                 WHEN rows < 1000000 THEN least(256, rows // 1000) ELSE 1024 END)::INTEGER AS nlist,
           (CASE WHEN rows < 100000 THEN 0 WHEN rows < 1000000 THEN 8 ELSE 16 END)::INTEGER AS m
    FROM ({_SIZES})
    """,
)
def _(spark, folder):
    sizes = None
    for name in _TABLES:
        counted = table(spark, folder, name).agg(F.lit(name).alias("name"), F.count("*").alias("rows"))
        sizes = counted if sizes is None else sizes.unionByName(counted)
    return ann.choose_index_table(sizes)


@query(
    "reindex_policy",
    "SELECT CASE WHEN n < 1000 THEN 'flat' ELSE 'ivf_pq' END AS kind, n AS vectors, dim AS min_dim, dim AS max_dim, "
    "(CASE WHEN n < 1000 THEN 0 ELSE 10 END)::BIGINT AS nlist "
    "FROM (SELECT count(*) AS n, max(len(embedding))::INTEGER AS dim FROM embeddings)",
)
def _(spark, folder):
    # The rows decide whether anything is trained.
    vectors = _vectors(spark, folder)
    plan = ann.choose_index(vectors.count(), "flags", use_ivf=True, use_pq=True, nlist=10, nbits=4)
    plan, rows = ann.reindex(vectors, scratch_path(spark, "index"), DIM, plan)
    cells = F.lit(plan.nlist).cast("bigint").alias("nlist")
    return index_info(rows, plan.kind).select("kind", "vectors", "min_dim", "max_dim", cells)


@query(
    "reindex",
    "SELECT 'ivf' AS kind, count(*) AS vectors, min(len(embedding))::INTEGER AS min_dim, "
    "max(len(embedding))::INTEGER AS max_dim, 6::BIGINT AS nlist FROM embeddings",
)
def _(spark, folder):
    plan = ann.IndexPlan("ivf", nlist=6)
    plan, rows = ann.reindex(_vectors(spark, folder), scratch_path(spark, "index"), DIM, plan)
    return index_info(rows, plan.kind)
