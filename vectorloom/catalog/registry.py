"""Registration of queries and the tables several of them share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectorloom.functions.vectors import masked_mean
from vectorloom.operators.store import as_store_rows

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

# Named subqueries of the statements, in dependency order.
_CTES: dict[str, str] = {}


def cte(name: str, body: str) -> None:
    _CTES[name] = body


def sql(body: str, *names: str) -> str:
    """A statement with the named subqueries (and what they need) in front."""
    needed = set(names)
    if unknown := needed - set(_CTES):
        raise KeyError(f"unknown subqueries {unknown}")
    for name in reversed(list(_CTES)):
        if name in needed:
            needed |= {other for other in _CTES if other != name and _mentions(_CTES[name], other)}
    parts = [f"{name} AS ({text})" for name, text in _CTES.items() if name in needed]
    return (f"WITH RECURSIVE {', '.join(parts)} " if parts else "") + body


def _mentions(text: str, name: str) -> bool:
    words = text.replace("(", " ").replace(")", " ").replace(",", " ").replace(".", " ").split()
    return name in words


def query(name: str, statement: str | None = None) -> Callable[[Query], Query]:
    """Register a query under a name, with its statement if it has one."""

    def register(function: Query) -> Query:
        QUERIES[name] = function
        if statement:
            SQL[name] = statement
        return function

    return register


def show_scores(*names: str, digits: int = 6) -> None:
    """Show the scores of queries with few decimals; they are ranked and filtered before."""

    def rounded(function: Query) -> Query:
        return lambda spark, folder: function(spark, folder).withColumn(
            "score", F.round("score", digits) + F.lit(0.0)
        )

    for name in names:
        QUERIES[name] = rounded(QUERIES[name])
        SQL[name] = f"SELECT * REPLACE (round(score, {digits}) + 0.0 AS score) FROM ({SQL[name]})"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def values(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small parameter table: routing rules, type settings."""
    return spark.createDataFrame(rows, schema)


# The store used by many queries: one chunk per vector, two chunks per document.
cte(
    "st",
    """
    SELECT 'c' || e.vec_id AS chunk_id, 'd' || (e.vec_id // 2) AS doc_id,
           'title ' || (e.vec_id // 2) AS doc_title, p.url AS doc_path, d.text AS doc_summary,
           't' || (e.label % 4) AS knowledge_type, d.source AS source, d.text AS content,
           e.embedding AS embedding, coalesce(l.toxic, 0) = 1 AS deleted, e.vec_id AS seq
    FROM embeddings e LEFT JOIN documents d ON d.doc_id = e.vec_id
    LEFT JOIN pages p ON p.page_id = e.vec_id // 2
    LEFT JOIN labels l ON l.doc_id = e.vec_id
    """,
)


def store_table(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    documents = table(spark, folder, "documents").select(
        F.col("doc_id").alias("vec_id"), "text", "source"
    )
    pages = table(spark, folder, "pages").select(
        F.col("page_id").alias("_pair"), F.col("url").alias("doc_path")
    )
    labels = table(spark, folder, "labels").select(F.col("doc_id").alias("vec_id"), "toxic")
    joined = (
        vectors.withColumn("_pair", F.expr("vec_id div 2"))
        .join(documents, "vec_id", "left")
        .join(pages, "_pair", "left")
        .join(labels, "vec_id", "left")
    )
    return as_store_rows(
        joined.select(
            F.concat(F.lit("c"), F.col("vec_id")).alias("chunk_id"),
            F.concat(F.lit("d"), F.col("_pair")).alias("doc_id"),
            F.concat(F.lit("title "), F.col("_pair")).alias("doc_title"),
            "doc_path",
            F.col("text").alias("doc_summary"),
            F.concat(F.lit("t"), F.col("label") % 4).alias("knowledge_type"),
            "source",
            F.col("text").alias("content"),
            "embedding",
            (F.coalesce("toxic", F.lit(0)) == 1).alias("deleted"),
            F.col("vec_id").alias("seq"),
        )
    )


# Query vectors: the mean vector of every label.
cte(
    "qv",
    """
    SELECT query_idx, list(m ORDER BY pos) AS q FROM (
      SELECT label AS query_idx, pos, avg(v) AS m FROM (
        SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS pos
        FROM embeddings) GROUP BY label, pos) GROUP BY query_idx
    """,
)
cte(
    "scored",
    """
    SELECT query_idx, chunk_id, knowledge_type, doc_id, doc_title, doc_path, doc_summary, deleted,
           round(list_cosine_similarity(embedding::DOUBLE[], q), 12) + 0.0 AS score
    FROM st CROSS JOIN qv
    """,
)


def label_queries(spark: SparkSession, folder: str) -> DataFrame:
    return (
        table(spark, folder, "embeddings")
        .groupBy(F.col("label").alias("query_idx"))
        .agg(masked_mean(F.col("embedding"), F.lit(1)).alias("embedding"))
    )


TYPE_NAMES = ["t0", "t1", "t2", "t3"]


def type_table(spark: SparkSession) -> DataFrame:
    """Types in search order, with settings per type."""
    rows = [("t2", 0, 3, 0.05), ("t0", 1, 4, 0.1), ("t1", 2, 5, 0.0), ("t3", 3, 2, 0.2)]
    return values(
        spark, rows, "knowledge_type string, type_order int, search_k int, search_min_score double"
    )


cte(
    "cfg",
    """
    SELECT * FROM (VALUES ('t2', 0, 3, 0.05), ('t0', 1, 4, 0.1), ('t1', 2, 5, 0.0),
    ('t3', 3, 2, 0.2)) v(knowledge_type, type_order, search_k, search_min_score)
    """,
)

_STRIP = r"regexp_replace({0}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"


def sql_strip(expression: str) -> str:
    return _STRIP.format(expression)


def sql_tokens(text: str) -> str:
    """Token estimate of a text expression."""
    cjk = rf"length(regexp_replace({text}, '[^\x{{4E00}}-\x{{9FFF}}]', '', 'g'))"
    return f"greatest(1, (3 * {cjk} + 2 * ((length({text}) - {cjk}) // 3)) // 2)::INTEGER"


def sql_bucket(tokens: str) -> str:
    return f"CASE WHEN {tokens} <= 64 THEN 'short' WHEN {tokens} <= 256 THEN 'medium' ELSE 'long' END"


def sql_hash_vectors(source: str, key: str, text: str) -> str:
    """Hash-encoded vectors ``(key, embedding)`` of a table expression."""
    return rf"""
    SELECT {key}, list((coalesce(c, 0) / n)::FLOAT ORDER BY b) AS embedding FROM (
      SELECT n.{key}, r.b, k.c, n.n FROM (
        SELECT {key}, sqrt(sum(c * c)::DOUBLE) AS n FROM (
          SELECT {key}, b, count(*) AS c FROM (
            SELECT {key}, (('0x' || substr(md5(t), 1, 8))::BIGINT % 64) AS b FROM (
              SELECT {key}, unnest(string_split_regex({text}, '[ \t\r\n]+')) AS t FROM {source})
            WHERE t <> '') GROUP BY ALL) GROUP BY {key}) n
      CROSS JOIN (SELECT range AS b FROM range(64)) r
      LEFT JOIN (SELECT {key}, b, count(*) AS c FROM (
            SELECT {key}, (('0x' || substr(md5(t), 1, 8))::BIGINT % 64) AS b FROM (
              SELECT {key}, unnest(string_split_regex({text}, '[ \t\r\n]+')) AS t FROM {source})
            WHERE t <> '') GROUP BY ALL) k ON k.{key} = n.{key} AND k.b = r.b)
    GROUP BY {key}
    """
