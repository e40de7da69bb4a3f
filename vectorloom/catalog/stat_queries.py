"""Queries of statistics, conversations and logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from vectorloom.catalog.registry import (
    cte,
    query,
    sql,
    sql_bucket,
    sql_tokens,
    store_table,
    table,
)
from vectorloom.functions.text import relative_time
from vectorloom.operators import conversations, stats

DAY = "2024-01-15"


@query(
    "store_stats",
    sql(
        "SELECT count(*) FILTER (NOT deleted) AS total_chunks, count(*) FILTER (deleted) "
        "AS deleted_chunks FROM st",
        "st",
    ),
)
def _(spark, folder):
    return stats.store_stats(store_table(spark, folder))


@query(
    "stats_by_type",
    sql(
        "SELECT knowledge_type, count(*) AS chunks, grouping(knowledge_type)::INTEGER AS is_total "
        "FROM st WHERE NOT deleted GROUP BY ROLLUP (knowledge_type)",
        "st",
    ),
)
def _(spark, folder):
    return stats.stats_by_type(store_table(spark, folder))


@query(
    "stats_by_source",
    sql("SELECT source, count(*) AS chunks FROM st WHERE NOT deleted GROUP BY source", "st"),
)
def _(spark, folder):
    return stats.stats_by_source(store_table(spark, folder))


@query(
    "stats_by_chunk_type",
    sql(
        f"SELECT {sql_bucket('tokens')} AS chunk_type, count(*) AS chunks, "
        "count(DISTINCT doc_id) AS documents FROM "
        f"(SELECT doc_id, {sql_tokens('content')} AS tokens FROM st WHERE NOT deleted) GROUP BY 1",
        "st",
    ),
)
def _(spark, folder):
    return stats.stats_by_chunk_type(store_table(spark, folder))


@query(
    "indexed_documents",
    sql(
        "SELECT count(DISTINCT doc_id) AS documents FROM st "
        "WHERE NOT deleted AND embedding IS NOT NULL",
        "st",
    ),
)
def _(spark, folder):
    return stats.indexed_documents(store_table(spark, folder))


@query("vector_count", "SELECT count(embedding) AS vectors FROM embeddings")
def _(spark, folder):
    return stats.vector_count(table(spark, folder, "embeddings"))


@query(
    "index_info",
    "SELECT 'ivf' AS kind, count(*) AS vectors, min(len(embedding))::INTEGER AS min_dim, "
    "max(len(embedding))::INTEGER AS max_dim, count(DISTINCT label) AS nlist FROM embeddings",
)
def _(spark, folder):
    cells = table(spark, folder, "embeddings").withColumnRenamed("label", "cell")
    return stats.index_info(cells, "ivf")


# Import ledger derived from the labels: toxic documents failed.
cte(
    "ledger",
    """
    SELECT d.source || '/' || d.doc_id || '.md' AS file_path,
           CASE WHEN l.toxic = 1 THEN 'failed' WHEN l.toxic = 0 THEN 'completed' ELSE 'pending' END
           AS status, coalesce(l.quality, 0) AS chunks_count,
           CASE WHEN l.toxic = 1 THEN 'rejected ' || d.lang END AS error_message
    FROM documents d LEFT JOIN labels l USING (doc_id)
    """,
)


def _ledger(spark, folder):
    joined = table(spark, folder, "documents").join(
        table(spark, folder, "labels"), "doc_id", "left"
    )
    return joined.select(
        F.concat("source", F.lit("/"), "doc_id", F.lit(".md")).alias("file_path"),
        F.when(F.col("toxic") == 1, "failed")
        .when(F.col("toxic") == 0, "completed")
        .otherwise("pending")
        .alias("status"),
        F.coalesce("quality", F.lit(0)).alias("chunks_count"),
        F.when(F.col("toxic") == 1, F.concat(F.lit("rejected "), "lang")).alias("error_message"),
    )


@query(
    "import_summary",
    sql(
        "SELECT count(*) FILTER (status = 'completed') AS total_knowledge, "
        "sum(chunks_count)::BIGINT AS total_chunks, count(*) FILTER (status = 'failed') "
        "AS error_count, count(*) FILTER (status = 'failed') = 0 AS success FROM ledger",
        "ledger",
    ),
)
def _(spark, folder):
    return stats.import_summary(_ledger(spark, folder))


@query(
    "import_errors",
    sql("SELECT file_path, error_message FROM ledger WHERE status = 'failed'", "ledger"),
)
def _(spark, folder):
    return stats.import_errors(_ledger(spark, folder))


@query(
    "outcome_ledger_stats",
    """
    SELECT status, count(*) AS tasks, count(DISTINCT batch_id) AS batches FROM (
      SELECT CASE WHEN event_type = 'error' THEN 'failed' ELSE 'completed' END AS status,
             event_id // 256 AS batch_id FROM events) GROUP BY status
    """,
)
def _(spark, folder):
    # An event that is not an error produced a value.
    events = table(spark, folder, "events").select(
        F.expr("event_id div 256").alias("batch_id"),
        F.when(F.col("event_type") != "error", F.col("value")).alias("result"),
    )
    return stats.outcome_ledger_stats(stats.with_outcome(events, "result"))


@query(
    "embed_cache_stats",
    "SELECT count(DISTINCT text) AS size, count(*) - count(DISTINCT text) AS hits, "
    "count(DISTINCT text) AS misses, round((count(*) - count(DISTINCT text)) / count(*), 6) "
    "AS hit_rate FROM documents",
)
def _(spark, folder):
    cache = stats.embed_cache_stats(table(spark, folder, "documents"), "text")
    return cache.withColumn("hit_rate", F.round("hit_rate", 6))


# Token usage: one session per conversation, with a model, provider and day derived from its id.
cte(
    "usage",
    f"""
    SELECT *, prompt_tokens + completion_tokens AS total_tokens FROM (
      SELECT conv_id, 'model-' || (conv_id % 3) AS model_name, 'provider-' || (conv_id % 2) AS provider,
             strftime(DATE '2024-01-01' + (conv_id % 30)::INTEGER, '%Y-%m-%d') AS usage_date,
             coalesce(sum({sql_tokens('text')}) FILTER (role = 'user'), 0)::BIGINT AS prompt_tokens,
             coalesce(sum({sql_tokens('text')}) FILTER (role = 'assistant'), 0)::BIGINT
             AS completion_tokens
      FROM conversations GROUP BY ALL)
    """,
)


def _usage(spark, folder):
    day = F.date_add(F.to_date(F.lit("2024-01-01")), (F.col("conv_id") % 30).cast("int"))
    messages = table(spark, folder, "conversations").select(
        "conv_id",
        "role",
        "text",
        F.concat(F.lit("model-"), F.col("conv_id") % 3).alias("model_name"),
        F.concat(F.lit("provider-"), F.col("conv_id") % 2).alias("provider"),
        F.date_format(day, "yyyy-MM-dd").alias("usage_date"),
    )
    return stats.usage_from_messages(messages, ["model_name", "provider", "usage_date"])


@query(
    "token_usage_report",
    sql(
        """
        SELECT *, row_number() OVER (PARTITION BY section ORDER BY CASE WHEN section <> 'by_date'
               THEN total_tokens END DESC, name NULLS FIRST)::INTEGER AS position FROM (
        SELECT CASE grouping(model_name, provider, usage_date) WHEN 3 THEN 'by_model'
               WHEN 5 THEN 'by_provider' WHEN 6 THEN 'by_date' ELSE 'summary' END AS section,
               coalesce(model_name, provider, usage_date) AS name, count(*) AS sessions,
               sum(prompt_tokens)::BIGINT AS prompt_tokens,
               sum(completion_tokens)::BIGINT AS completion_tokens,
               sum(total_tokens)::BIGINT AS total_tokens,
               round(sum(total_tokens)::DOUBLE / count(*), 0) AS avg_tokens
        FROM usage GROUP BY GROUPING SETS ((model_name), (provider), (usage_date), ()))
        """,
        "usage",
    ),
)
def _(spark, folder):
    return stats.token_usage_report(_usage(spark, folder))


@query(
    "today_tokens",
    sql(
        f"SELECT coalesce(sum(total_tokens) FILTER (usage_date = '{DAY}'), 0)::BIGINT "
        "AS today_tokens FROM usage",
        "usage",
    ),
)
def _(spark, folder):
    return stats.tokens_on(_usage(spark, folder), F.lit(DAY))


@query(
    "recent_sessions",
    sql(
        "SELECT conv_id, model_name, usage_date, prompt_tokens, completion_tokens, total_tokens "
        "FROM usage ORDER BY usage_date DESC, conv_id DESC LIMIT 10",
        "usage",
    ),
)
def _(spark, folder):
    newest = [F.col("usage_date").desc(), F.col("conv_id").desc()]
    return stats.recent_sessions(_usage(spark, folder), newest).select(
        "conv_id", "model_name", "usage_date", "prompt_tokens", "completion_tokens", "total_tokens"
    )


# Logs derived from the events.
cte(
    "logs",
    """
    SELECT event_id AS log_id, ts, event_type AS type, props AS message,
           CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'click' THEN 'WARNING' ELSE 'INFO' END
           AS level FROM events
    """,
)


def _logs(spark, folder):
    kind = F.col("event_type")
    return table(spark, folder, "events").select(
        F.col("event_id").alias("log_id"),
        "ts",
        kind.alias("type"),
        F.col("props").alias("message"),
        F.when(kind == "error", "ERROR").when(kind == "click", "WARNING").otherwise("INFO").alias(
            "level"
        ),
    )


@query(
    "log_summary",
    sql(
        f"SELECT count(*) AS total, count(*) FILTER (ts::DATE = DATE '{DAY}') AS today_count, "
        "count(*) FILTER (level = 'ERROR') AS error_count, "
        "count(*) FILTER (level = 'WARNING') AS warning_count FROM logs",
        "logs",
    ),
)
def _(spark, folder):
    return stats.log_summary(_logs(spark, folder), F.to_date(F.lit(DAY)))


@query(
    "log_query",
    sql(
        "SELECT log_id, level, type, message FROM logs WHERE level = 'INFO' AND type = 'view' "
        "ORDER BY ts DESC, log_id DESC LIMIT 100",
        "logs",
    ),
)
def _(spark, folder):
    rows = stats.log_query(_logs(spark, folder), "INFO", "view")
    return rows.select("log_id", "level", "type", "message")


@query(
    "relative_time",
    """
    SELECT log_id, CASE WHEN s < 60 THEN '刚刚' WHEN s < 3600 THEN (s // 60) || '分钟前'
           WHEN s < 86400 THEN (s // 3600) || '小时前' WHEN s < 604800 THEN (s // 86400) || '天前'
           ELSE strftime(ts, '%Y-%m-%d') END AS age FROM (
      SELECT event_id AS log_id, ts,
             ((epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(ts)) // 1000000)::BIGINT AS s
      FROM events)
    """,
)
def _(spark, folder):
    now = F.to_timestamp(F.lit("2024-01-31 00:00:00"))
    return _logs(spark, folder).select("log_id", relative_time(F.col("ts"), now).alias("age"))


@query(
    "session_message_counts",
    "SELECT conv_id, count(*) AS message_count, max(turn) AS updated FROM conversations "
    "GROUP BY conv_id",
)
def _(spark, folder):
    return conversations.session_message_counts(table(spark, folder, "conversations"))


def _recent_sql(limit: int) -> str:
    return f"""
    SELECT conv_id, turn, role, text,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn)::INTEGER AS position FROM (
      SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n
      FROM conversations) WHERE n <= {limit}
    """


@query("recent_history", _recent_sql(10))
def _(spark, folder):
    return conversations.recent_history(table(spark, folder, "conversations"))


@query("recent_history_requirement", _recent_sql(6))
def _(spark, folder):
    messages = table(spark, folder, "conversations")
    return conversations.recent_history(messages, conversations.REQUIREMENT_HISTORY)


@query(
    "conversation_list",
    """
    SELECT conv_id, substr(a, 1, 30) || CASE WHEN length(a) > 30 THEN '...' ELSE '' END AS title,
           substr(z, 1, 50) || CASE WHEN length(z) > 50 THEN '...' ELSE '' END AS preview, updated
    FROM (SELECT conv_id, min_by(text, turn) AS a, max_by(text, turn) AS z, max(turn) AS updated
          FROM conversations GROUP BY conv_id)
    """,
)
def _(spark, folder):
    return conversations.conversation_list(table(spark, folder, "conversations"))


@query(
    "doc_chunk_counts",
    sql(
        "SELECT doc_id, count(*) AS chunks, count(*) FILTER (NOT deleted) AS success, "
        "count(*) FILTER (deleted) AS failed FROM st GROUP BY doc_id",
        "st",
    ),
)
def _(spark, folder):
    # Deleted rows stand for chunks without a vector.
    rows = store_table(spark, folder).withColumn(
        "embedding", F.when(~F.col("deleted"), F.col("embedding"))
    )
    return stats.doc_chunk_counts(rows)


@query(
    "build_stats",
    sql(
        "SELECT count(*) AS total, sum(success)::BIGINT AS success, sum(failed)::BIGINT AS failed "
        "FROM (SELECT doc_id, count(*) FILTER (NOT deleted) AS success, "
        "count(*) FILTER (deleted) AS failed FROM st GROUP BY doc_id)",
        "st",
    ),
)
def _(spark, folder):
    rows = store_table(spark, folder).withColumn(
        "embedding", F.when(~F.col("deleted"), F.col("embedding"))
    )
    return stats.build_stats(stats.doc_chunk_counts(rows))
