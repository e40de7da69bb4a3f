"""Every operator as a runnable query over the driver's tables, with its DuckDB statement.

``QUERIES`` maps a name to ``(spark, folder) -> DataFrame``; ``SQL`` maps it to the statement that
must give the same rows. Operators whose result SQL cannot state have no statement.
"""

from vectorloom.catalog.registry import QUERIES, SQL, show_scores

from vectorloom.catalog import (  # noqa: F401  isort: skip
    ann_queries,
    form_queries,
    pipeline_queries,
    search_queries,
    source_queries,
    stat_queries,
    store_queries,
    streaming_queries,
    text_queries,
)

show_scores(
    "ivf_search",
    "ivf_search_all_cells",
    "pq_search",
    "pq_search_recall",
    "ivf_pq_search",
    "retrieve",
    "sdk_search",
    "knn_exact",
    "knn_shuffled_blocks",
    "store_search",
    "store_search_overfetch",
    "search_multi_type",
    "search_multi_query",
    "dedupe_paths",
    "hit_document_join",
    "hit_projection",
    "search_titled",
    "filter_min_score",
    "union_type_results",
    "concat_query_results",
)

__all__ = ["QUERIES", "SQL"]
