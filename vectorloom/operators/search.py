"""Search over the store: filters, one or many types, one or many queries, result shaping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectorloom import settings
from vectorloom.functions.text import strip
from vectorloom.operators.knn import ALL, GROUP, local_hits, score_order, top_hits
from vectorloom.operators.store import KEY, match_keys

MAX_TYPES = 10_000

HIT_COLUMNS = ["query_idx", "knowledge_type", "chunk_id", "score", "rank"]


def query_input(df: DataFrame, query: str = "query", order: str = "query_idx") -> DataFrame:
    """Stripped query texts, blank ones dropped, in their given order."""
    cleaned = df.select(F.col(order).alias("query_idx"), strip(F.col(query)).alias("query"))
    return cleaned.where(F.col("query") != "")


def filter_min_score(hits: DataFrame, min_score: float | Column) -> DataFrame:
    return hits.where(F.col("score") >= min_score)


def filter_live(store: DataFrame) -> DataFrame:
    return store.where(~F.col("deleted"))


def filter_has_path(hits: DataFrame) -> DataFrame:
    return hits.where(F.coalesce(F.col("doc_path"), F.lit("")) != "")


def hit_document_join(hits: DataFrame, store: DataFrame, columns: list[str]) -> DataFrame:
    """Stored columns of each hit; hits without a stored document are dropped.

    Hits carry a broadcast hint while their number is proven small; the store is then scanned in
    place, and only for ``columns``. Hits that know their type are matched by the full key.
    """
    if "knowledge_type" in hits.columns:
        return match_keys(hits, store.select(*KEY, *(c for c in columns if c not in KEY)), "inner")
    return hits.join(store.select("chunk_id", *(c for c in columns if c != "chunk_id")), "chunk_id")


def _store_hits(store: DataFrame, queries: DataFrame, k: int, **blocks) -> DataFrame:
    """Best k rows of a store per query, whatever their type; the type is part of the key."""
    vectors = store.select("chunk_id", "embedding", F.col("knowledge_type").alias(GROUP))
    wanted = queries.select("query_idx", "embedding", F.lit(ALL).alias(GROUP))
    hits = local_hits(vectors, wanted, k, **blocks)
    best = hits.ranked(k, ["query_idx"], [*score_order(), F.col(GROUP)])
    return best.withColumnRenamed(GROUP, "knowledge_type").select(*HIT_COLUMNS)


def store_search(
    store: DataFrame,
    queries: DataFrame,
    k: int = settings.SEARCH_K,
    min_score: float = 0.0,
    overfetch: int | None = None,
    **blocks,
) -> DataFrame:
    """Best k live hits per query: ``(query_idx, knowledge_type, chunk_id, score, rank)``.

    By default rows are filtered before they are ranked, so soft-deleted rows never use up k. With
    ``overfetch`` the best ``overfetch * k`` of all rows are taken first and filtered afterwards.
    """
    if overfetch is None:
        return filter_min_score(_store_hits(filter_live(store), queries, k, **blocks), min_score)
    fetched = _store_hits(store, queries, k * overfetch, **blocks).drop("rank")
    found = hit_document_join(fetched, store, ["deleted"])
    kept = filter_min_score(filter_live(found), min_score)
    order = [*score_order(), F.col("knowledge_type")]
    return top_hits(kept, k, ["query_idx"], order).select(*HIT_COLUMNS)


def search_multi_type(
    store: DataFrame,
    queries: DataFrame,
    types: DataFrame,
    k: int = settings.SEARCH_K,
    min_score: float = settings.SEARCH_MIN_SCORE,
    **blocks,
) -> DataFrame:
    """Best k per requested type, merged and cut to the best k per query.

    ``types`` has ``knowledge_type`` and ``type_order`` and may carry ``search_k`` and
    ``search_min_score`` per type. All types are answered by one scan of the store, pruned to
    the requested types; equal scores are ordered by type order, then rank inside the type.
    """
    limits = {
        "search_k": F.col("search_k") if "search_k" in types.columns else F.lit(k),
        "search_min_score": (
            F.col("search_min_score") if "search_min_score" in types.columns else F.lit(min_score)
        ),
    }
    wanted = types.select(
        "knowledge_type", "type_order", *(limits[name].alias(name) for name in limits)
    )
    # Only the type settings reach the driver: one row per type, and their number is checked.
    config = wanted.select("knowledge_type", "search_k").limit(MAX_TYPES + 1).collect()
    if len(config) > MAX_TYPES:
        raise ValueError(f"more than {MAX_TYPES} types in one search")
    wanted = F.broadcast(wanted)
    deepest = max((row["search_k"] for row in config), default=k)
    names = [row["knowledge_type"] for row in config]
    rows = filter_live(store).where(F.col("knowledge_type").isin(names))
    spread = queries.select(
        "query_idx",
        "embedding",
        F.explode(F.array(*map(F.lit, names)).cast("array<string>")).alias(GROUP),
    )
    vectors = rows.select("chunk_id", "embedding", F.col("knowledge_type").alias(GROUP))
    hits = local_hits(vectors, spread, deepest, **blocks)
    ranked = hits.ranked(deepest, ["query_idx", GROUP], score_order())
    allowed = (
        ranked.withColumnRenamed(GROUP, "knowledge_type")
        .join(wanted, "knowledge_type")
        .where(F.col("rank") <= F.col("search_k"))
        .where(F.col("score") >= F.col("search_min_score"))
        .withColumnRenamed("rank", "type_rank")
    )
    order = [F.col("score").desc(), F.col("type_order"), F.col("type_rank")]
    return hits.hinted(top_hits(allowed, k, ["query_idx"], order).select(*HIT_COLUMNS))


def union_type_results(results: list[DataFrame]) -> DataFrame:
    """Results of several types, appended in type order."""
    tagged = [result.withColumn("type_order", F.lit(i)) for i, result in enumerate(results)]
    merged = tagged[0]
    for result in tagged[1:]:
        merged = merged.unionByName(result)
    return merged


def concat_query_results(hits: DataFrame) -> DataFrame:
    """One sequence over all queries: ``result_order`` sorts by query, then rank.

    The position is a sortable struct, not a number, so no global window is needed.
    """
    return hits.withColumn("result_order", F.struct("query_idx", "rank"))


def dedupe_paths(hits: DataFrame, payload: list[str]) -> DataFrame:
    """First hit of every path in (query, rank) order.

    An aggregate with map-side combine: a path that collects very many hits costs one row per
    task.
    """
    ordered = concat_query_results(filter_has_path(hits))
    first = F.min_by(F.struct("query_idx", "rank", *payload), "result_order").alias("first")
    return ordered.groupBy("doc_path").agg(first).select("doc_path", "first.*")


def search_multi_query(
    store: DataFrame,
    queries: DataFrame,
    types: DataFrame,
    k: int = settings.SEARCH_K,
    min_score: float = settings.SEARCH_MIN_SCORE,
    **blocks,
) -> DataFrame:
    """Distinct document paths over all queries, first occurrence first."""
    hits = search_multi_type(store, queries, types, k, min_score, **blocks)
    found = hit_document_join(hits, store, ["doc_path", "doc_summary"])
    return dedupe_paths(found, ["doc_summary", "score"])


def search_titled(
    hits: DataFrame, store: DataFrame, summary_chars: int = 100, classes: str | None = None
) -> DataFrame:
    """Hits with title, path, score and the head of the summary, and up to three core classes."""
    columns = ["doc_title", "doc_path", "doc_summary"] + ([classes] if classes else [])
    found = hit_document_join(hits, store, columns)
    shown = [
        "query_idx",
        "rank",
        "doc_title",
        "doc_path",
        "score",
        F.substring("doc_summary", 1, summary_chars).alias("doc_summary"),
    ]
    if classes:
        shown.append(F.array_join(F.slice(classes, 1, 3), ", ").alias("core_classes"))
    return found.select(*shown)


def hit_projection(hits: DataFrame, store: DataFrame) -> DataFrame:
    """Hits as result records: document fields, score and type."""
    found = hit_document_join(hits, store, ["doc_id", "doc_title", "doc_path", "doc_summary"])
    return found.select(
        "query_idx",
        "rank",
        "doc_id",
        "doc_title",
        "doc_path",
        "doc_summary",
        "score",
        "knowledge_type",
    )


def knowledge_results(hits: DataFrame, store: DataFrame) -> DataFrame:
    """The same records under the names of the query interface."""
    return hit_projection(hits, store).select(
        "query_idx",
        "rank",
        F.col("doc_id").alias("knowledge_id"),
        "knowledge_type",
        F.col("doc_title").alias("name"),
        F.col("doc_summary").alias("description"),
        F.col("score").alias("relevance_score"),
        F.col("doc_path").alias("source_file"),
    )


# Fixed value: the answer to a query without results.
NO_ANSWER = (
    "抱歉，我在知识库中没有找到与您问题相关的信息。\n\n建议您：\n1. 尝试使用不同的关键词重新搜索\n"
    "2. 在设置中导入相关的知识文档\n3. 配置AI模型以获得更智能的回答"
)


def assemble_answer(
    results: DataFrame, limit: int = settings.ANSWER_LIMIT, queries: DataFrame | None = None
) -> DataFrame:
    """One text per query: numbered results and the best score in percent.

    Expects the columns of ``knowledge_results``; a query has at most ``limit`` of them. With
    ``queries`` a query that has no results gets an answer too, one that says so.
    """
    # The sentences around the list.
    intro = "根据知识库检索，为您找到以下相关信息：\n\n"
    number = F.col("rank").cast("string")
    described = F.coalesce(F.col("description"), F.lit("")) != ""
    entry = F.concat(
        F.lit("**"), number, F.lit(". "), F.col("name"), F.lit("** ("), F.col("knowledge_type"),
        F.lit(")\n"), F.when(described, F.concat("description", F.lit("\n"))).otherwise(""),
        F.lit("\n"),
    )
    shown = results.where(F.col("rank") <= limit)
    grouped = shown.groupBy("query_idx").agg(
        F.array_sort(F.collect_list(F.struct("rank", entry.alias("entry")))).alias("_entries"),
        F.max("relevance_score").alias("_best"),
    )
    percent = F.round(F.col("_best") * 100, 0).cast("int").cast("string")
    answers = grouped.select(
        "query_idx",
        F.concat(
            F.lit(intro),
            F.array_join(F.col("_entries.entry"), ""),
            F.lit("\n*以上信息来自知识库检索，相关度: "),
            percent,
            F.lit("%*"),
        ).alias("answer"),
    )
    if queries is None:
        return answers
    asked = queries.select("query_idx").distinct().join(answers, "query_idx", "left")
    return asked.withColumn("answer", F.coalesce("answer", F.lit(NO_ANSWER)))
