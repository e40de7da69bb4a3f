"""Queries of exact search and of result shaping."""

from __future__ import annotations

from pyspark.sql import functions as F

from vectorloom.catalog.registry import (
    TYPE_NAMES,
    cte,
    label_queries,
    query,
    sql,
    sql_strip,
    store_table,
    table,
    type_table,
)
from vectorloom.operators import search
from vectorloom.operators.knn import knn_exact

_RANKED = "row_number() OVER (PARTITION BY query_idx ORDER BY score DESC, chunk_id)"

cte("live_top", f"SELECT *, {_RANKED} AS rank FROM scored WHERE NOT deleted")
cte("hits10", "SELECT * FROM live_top WHERE rank <= 10")
cte(
    "typed",
    """
    SELECT s.*, c.type_order, c.search_k, c.search_min_score,
           row_number() OVER (PARTITION BY query_idx, s.knowledge_type
                              ORDER BY score DESC, chunk_id) AS type_rank
    FROM scored s JOIN cfg c USING (knowledge_type) WHERE NOT deleted
    """,
)
cte(
    "multi",
    """
    SELECT * FROM (
      SELECT *, row_number() OVER (PARTITION BY query_idx
                                   ORDER BY score DESC, type_order, type_rank) AS rank
      FROM typed WHERE type_rank <= search_k AND score >= search_min_score) WHERE rank <= 10
    """,
)


def _vectors(spark, folder):
    return table(spark, folder, "embeddings").select(
        F.concat(F.lit("c"), F.col("vec_id")).alias("chunk_id"), "embedding"
    )


@query(
    "knn_exact",
    sql(
        f"SELECT query_idx, chunk_id, score, rank::INTEGER AS rank FROM (SELECT *, {_RANKED} AS rank "
        "FROM scored) WHERE rank <= 5",
        "scored",
    ),
)
def _(spark, folder):
    return knn_exact(_vectors(spark, folder), label_queries(spark, folder), 5)


@query(
    "knn_cross",
    sql(
        "SELECT query_idx, max(score) AS best_score, min_by(chunk_id, rank) AS best_chunk FROM "
        f"(SELECT *, {_RANKED} AS rank FROM scored) GROUP BY query_idx",
        "scored",
    ),
)
def _(spark, folder):
    best = knn_exact(_vectors(spark, folder), label_queries(spark, folder), 1)
    return best.select(
        "query_idx", F.col("score").alias("best_score"), F.col("chunk_id").alias("best_chunk")
    )


@query(
    "knn_shuffled_blocks",
    sql(
        f"SELECT query_idx, chunk_id, score, rank::INTEGER AS rank FROM (SELECT *, {_RANKED} AS rank "
        "FROM scored) WHERE rank <= 5",
        "scored",
    ),
)
def _(spark, folder):
    # The path for query sets beyond the broadcast bound, forced by a low bound.
    return knn_exact(
        _vectors(spark, folder), label_queries(spark, folder), 5, max_queries=4, block_rows=400
    )


_HITS = "query_idx, knowledge_type, chunk_id, score, rank::INTEGER AS rank"


def _top(spark, folder):
    store = store_table(spark, folder)
    return store, search.store_search(store, label_queries(spark, folder), 10, -1.0)


@query(
    "store_search",
    sql(f"SELECT {_HITS} FROM live_top WHERE rank <= 8 AND score >= 0.1", "live_top"),
)
def _(spark, folder):
    return search.store_search(store_table(spark, folder), label_queries(spark, folder), 8, 0.1)


@query(
    "store_search_overfetch",
    sql(
        f"""
        SELECT {_HITS} FROM (
          SELECT * EXCLUDE (rank), {_RANKED} AS rank FROM (
            SELECT *, {_RANKED} AS rank FROM scored) WHERE rank <= 16 AND NOT deleted
            AND score >= 0.1) WHERE rank <= 8
        """,
        "scored",
    ),
)
def _(spark, folder):
    store, queries = store_table(spark, folder), label_queries(spark, folder)
    return search.store_search(store, queries, 8, 0.1, overfetch=2)


@query("search_multi_type", sql(f"SELECT {_HITS} FROM multi", "multi"))
def _(spark, folder):
    store, queries = store_table(spark, folder), label_queries(spark, folder)
    return search.search_multi_type(store, queries, type_table(spark), 10)


_FIRST_PATHS = """
    SELECT doc_path, query_idx, rank::INTEGER AS rank, doc_summary, score FROM (
      SELECT *, row_number() OVER (PARTITION BY doc_path ORDER BY query_idx, rank) AS n
      FROM {0} WHERE coalesce(doc_path, '') <> '') WHERE n = 1
    """


@query("search_multi_query", sql(_FIRST_PATHS.format("multi"), "multi"))
def _(spark, folder):
    store, queries = store_table(spark, folder), label_queries(spark, folder)
    return search.search_multi_query(store, queries, type_table(spark), 10)


@query("dedupe_paths", sql(_FIRST_PATHS.format("hits10"), "hits10"))
def _(spark, folder):
    store, hits = _top(spark, folder)
    found = search.hit_document_join(hits, store, ["doc_path", "doc_summary"])
    return search.dedupe_paths(found, ["doc_summary", "score"])


@query(
    "hit_document_join",
    sql(
        "SELECT query_idx, rank::INTEGER AS rank, chunk_id, score, doc_id, doc_title FROM hits10",
        "hits10",
    ),
)
def _(spark, folder):
    store, hits = _top(spark, folder)
    found = search.hit_document_join(hits, store, ["doc_id", "doc_title"])
    return found.select("query_idx", "rank", "chunk_id", "score", "doc_id", "doc_title")


@query(
    "hit_projection",
    sql(
        "SELECT query_idx, rank::INTEGER AS rank, doc_id, doc_title, doc_path, doc_summary, score, "
        "knowledge_type FROM hits10",
        "hits10",
    ),
)
def _(spark, folder):
    store, hits = _top(spark, folder)
    return search.hit_projection(hits, store)


@query(
    "search_titled",
    sql(
        "SELECT query_idx, rank::INTEGER AS rank, doc_title, doc_path, score, "
        "substr(doc_summary, 1, 100) AS doc_summary, t0 || ', ' || t1 || ', ' || t2 AS core_classes "
        "FROM (SELECT *, 'k' || chunk_id AS t0, 'k' || doc_id AS t1, 'k' || knowledge_type AS t2 "
        "FROM hits10)",
        "hits10",
    ),
)
def _(spark, folder):
    store, hits = _top(spark, folder)
    named = ["chunk_id", "doc_id", "knowledge_type", "source"]
    classes = F.array(*(F.concat(F.lit("k"), F.col(name)) for name in named))
    return search.search_titled(hits, store.withColumn("classes", classes), 100, "classes")


@query(
    "filter_min_score",
    sql("SELECT query_idx, chunk_id, score FROM hits10 WHERE score >= 0.3", "hits10"),
)
def _(spark, folder):
    _, hits = _top(spark, folder)
    return search.filter_min_score(hits, 0.3).select("query_idx", "chunk_id", "score")


@query("filter_live", sql("SELECT chunk_id, doc_id FROM st WHERE NOT deleted", "st"))
def _(spark, folder):
    return search.filter_live(store_table(spark, folder)).select("chunk_id", "doc_id")


@query(
    "filter_has_path",
    sql("SELECT chunk_id, doc_path FROM st WHERE coalesce(doc_path, '') <> ''", "st"),
)
def _(spark, folder):
    return search.filter_has_path(store_table(spark, folder)).select("chunk_id", "doc_path")


@query(
    "union_type_results",
    sql(
        "SELECT query_idx, knowledge_type, chunk_id, score, type_rank::INTEGER AS rank, "
        "substr(knowledge_type, 2)::INTEGER AS type_order FROM typed WHERE type_rank <= 3",
        "typed",
    ),
)
def _(spark, folder):
    store, queries = store_table(spark, folder), label_queries(spark, folder)
    return search.union_type_results(
        [
            search.store_search(store.where(F.col("knowledge_type") == name), queries, 3, -1.0)
            for name in TYPE_NAMES
        ]
    )


@query(
    "concat_query_results",
    sql("SELECT query_idx, rank::INTEGER AS rank, chunk_id, score FROM hits10", "hits10"),
)
def _(spark, folder):
    _, hits = _top(spark, folder)
    ordered = search.concat_query_results(hits).orderBy("result_order")
    return ordered.select("query_idx", "rank", "chunk_id", "score")


@query(
    "query_input",
    "SELECT item_id AS query_idx, " + sql_strip("text") + " AS query FROM benchmark WHERE "
    + sql_strip("text") + " <> ''",
)
def _(spark, folder):
    return search.query_input(table(spark, folder, "benchmark"), "text", "item_id")


@query(
    "knowledge_results",
    sql(
        "SELECT query_idx, rank::INTEGER AS rank, doc_id AS knowledge_id, knowledge_type, "
        "doc_title AS name, doc_summary AS description, score AS relevance_score, "
        "doc_path AS source_file FROM hits10",
        "hits10",
    ),
)
def _(spark, folder):
    store, hits = _top(spark, folder)
    return search.knowledge_results(hits, store)


@query(
    "assemble_answer",
    sql(
        r"""
        SELECT query_idx, '根据知识库检索，为您找到以下相关信息：' || chr(10) || chr(10)
          || string_agg('**' || rank || '. ' || doc_title || '** (' || knowledge_type || ')'
             || chr(10) || CASE WHEN coalesce(doc_summary, '') <> ''
                                THEN doc_summary || chr(10) ELSE '' END || chr(10), ''
             ORDER BY rank)
          || chr(10) || '*以上信息来自知识库检索，相关度: '
          || round(max(score) * 100, 0)::INTEGER || '%*' AS answer
        FROM live_top WHERE rank <= 5 AND score >= 0.9 GROUP BY query_idx
        UNION ALL SELECT query_idx, replace('""" + search.NO_ANSWER.replace("\n", "|") + r"""', '|', chr(10))
        FROM qv WHERE query_idx NOT IN (SELECT query_idx FROM live_top WHERE rank <= 5 AND score >= 0.9)
        """,
        "live_top",
        "qv",
    ),
)
def _(spark, folder):
    store, queries = store_table(spark, folder), label_queries(spark, folder)
    # A high bar leaves some queries without a hit.
    hits = search.store_search(store, queries, 5, 0.9)
    return search.assemble_answer(search.knowledge_results(hits, store), queries=queries)
