"""Queries of the end-to-end jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from vectorloom.catalog import text_queries  # noqa: F401  its subqueries are used below
from vectorloom.catalog.form_queries import CREATED, _FILE, _records
from vectorloom.catalog.registry import (
    cte,
    query,
    sql,
    sql_hash_vectors,
    sql_strip,
    store_table,
    table,
    values,
)
from vectorloom.operators.stats import build_stats, import_summary
from vectorloom.operators.store import as_store_rows
from vectorloom.plans import pipelines
from vectorloom.session import materialise

AT = "2024-02-01 00:00:00"
_SHOWN = ["chunk_id", "doc_path", "knowledge_type", "content"]


def _at():
    return F.to_timestamp(F.lit(AT))


def _rules(spark):
    rows = [("src1", "wide", 5), ("src2", "summary", 4), ("src15", "narrow", 1)]
    return values(spark, rows, "pattern string, knowledge_type string, priority int")


def _config(spark):
    rows = [("wide", "file_name"), ("summary", "summary"), ("narrow", "file_name")]
    return values(spark, rows, "knowledge_type string, vector_field string")


# Files: one per document, named after half its id, so two documents can share a stem.
cte(
    "kfiles",
    """
    SELECT path, stem, CASE WHEN contains(path, 'src15') THEN 'narrow' WHEN contains(path, 'src2')
           THEN 'summary' WHEN contains(path, 'src1') THEN 'wide' END AS knowledge_type FROM (
      SELECT source || '/' || lang || '/' || (doc_id // 2) || '.md' AS path,
             (doc_id // 2)::VARCHAR AS stem FROM documents)
    """,
)
cte(
    "ksumm",
    """
    SELECT k, min_by({'id': doc_id, 'path': doc_path, 'summary': summary}, position) AS s FROM (
      SELECT unnest([doc_id, doc_title]) AS k, * FROM (
        SELECT doc_id::VARCHAR AS doc_id, 'title ' || doc_id AS doc_title,
               'labels/' || doc_id AS doc_path, 'quality ' || quality AS summary, doc_id AS position
        FROM labels)) GROUP BY k
    """,
)
cte(
    "kinput",
    """
    SELECT f.path AS source_file, f.knowledge_type,
           CASE WHEN f.knowledge_type = 'summary' THEN s.id ELSE f.stem END AS chunk_id,
           CASE WHEN f.knowledge_type = 'summary' THEN s.path ELSE f.path END AS doc_path,
           CASE WHEN f.knowledge_type = 'summary' THEN s.summary
                WHEN f.knowledge_type IS NOT NULL THEN f.stem END AS content
    FROM kfiles f LEFT JOIN (SELECT k, s.id AS id, s.path AS path, s.summary AS summary FROM ksumm) s
    ON s.k = f.stem
    """,
)
cte(
    "kstored",
    "SELECT chunk_id, doc_path, knowledge_type, content FROM (SELECT *, row_number() OVER "
    "(PARTITION BY knowledge_type, chunk_id ORDER BY source_file DESC) AS n FROM kinput WHERE content IS NOT NULL) "
    "WHERE n = 1",
)


def _files(spark, folder):
    stem = F.expr("doc_id div 2").cast("string")
    return table(spark, folder, "documents").select(
        F.concat("source", F.lit("/"), "lang", F.lit("/"), stem, F.lit(".md")).alias("path")
    )


def _summaries(spark, folder):
    return table(spark, folder, "labels").select(
        F.col("doc_id").cast("string").alias("doc_id"),
        F.concat(F.lit("title "), "doc_id").alias("doc_title"),
        F.concat(F.lit("labels/"), "doc_id").alias("doc_path"),
        F.concat(F.lit("quality "), "quality").alias("summary"),
        F.col("doc_id").alias("position"),
    )


# Stored before the import: the labels' documents with quality 1.
cte(
    "kold",
    "SELECT doc_id::VARCHAR AS chunk_id, 'old' AS doc_path, 'wide' AS knowledge_type, "
    "'old ' || doc_id AS content FROM labels WHERE quality = 1",
)


def _stored(spark, folder):
    return as_store_rows(
        table(spark, folder, "labels")
        .where("quality = 1")
        .select(
            F.col("doc_id").cast("string").alias("chunk_id"),
            F.col("doc_id").cast("string").alias("doc_id"),
            F.lit("old").alias("doc_path"),
            F.lit("wide").alias("knowledge_type"),
            F.concat(F.lit("old "), "doc_id").alias("content"),
        )
    )


def _import(spark, folder):
    return pipelines.import_directory(
        _stored(spark, folder),
        _files(spark, folder),
        _rules(spark),
        _config(spark),
        _summaries(spark, folder),
        created_at=_at(),
    )


@query(
    "import_directory",
    sql(
        "SELECT * FROM kold UNION ALL SELECT * FROM kstored "
        "ANTI JOIN kold USING (knowledge_type, chunk_id)",
        "kold",
        "kstored",
    ),
)
def _(spark, folder):
    return _import(spark, folder).rows.select(*_SHOWN)


@query(
    "import_directory_ledger",
    sql(
        "SELECT source_file AS file_path, CASE WHEN content IS NULL THEN 'failed' ELSE 'completed' "
        "END AS status, CASE WHEN content IS NULL THEN 0 ELSE 1 END AS chunks_count, "
        f"CASE WHEN content IS NULL THEN '{pipelines.ERROR_NO_INPUT}' END AS error_message "
        "FROM kinput",
        "kinput",
    ),
)
def _(spark, folder):
    ledger = _import(spark, folder).ledger
    return ledger.select("file_path", "status", "chunks_count", "error_message")


@query(
    "import_directory_summary",
    sql(
        "SELECT count(content) AS total_knowledge, count(content) AS total_chunks, "
        "count(*) - count(content) AS error_count, count(*) = count(content) AS success FROM kinput",
        "kinput",
    ),
)
def _(spark, folder):
    return import_summary(_import(spark, folder).ledger)


def _import_folder(spark, folder, directory):
    job = pipelines.import_folder(
        _stored(spark, folder),
        directory,
        _files(spark, folder),
        _rules(spark),
        _config(spark),
        _summaries(spark, folder),
        created_at=_at(),
    )
    return job.rows.select(*_SHOWN)


@query(
    "import_folder",
    sql(
        """
        SELECT * FROM kold UNION ALL SELECT chunk_id, doc_path, knowledge_type, content FROM (
          SELECT *, row_number() OVER (PARTITION BY knowledge_type, chunk_id ORDER BY source_file DESC) AS n
          FROM kinput WHERE content IS NOT NULL AND starts_with(source_file, 'src1/')) WHERE n = 1
          AND (knowledge_type, chunk_id) NOT IN (SELECT (knowledge_type, chunk_id) FROM kold)
        """,
        "kold",
        "kinput",
    ),
)
def _(spark, folder):
    return _import_folder(spark, folder, "src1")


@query(
    "import_folder_summary",
    sql(
        "SELECT * FROM kold UNION ALL SELECT doc_id::VARCHAR, 'labels/' || doc_id, 'summary', "
        "'quality ' || quality FROM labels",
        "kold",
    ),
)
def _(spark, folder):
    # The directory is of a summary type: all summaries come in, its files do not matter.
    return _import_folder(spark, folder, "src2")


@query("import_folder_unknown", sql("SELECT * FROM kold", "kold"))
def _(spark, folder):
    return _import_folder(spark, folder, "elsewhere")


@query(
    "import_file",
    "SELECT 'documents' AS chunk_id, 'wide' AS knowledge_type, 'documents' AS content "
    "UNION ALL SELECT doc_id::VARCHAR, 'wide', 'old ' || doc_id FROM labels WHERE quality = 1",
)
def _(spark, folder):
    # The file of the documents table itself is imported by its name.
    rules = values(spark, [("documents", "wide", 1)], "pattern string, knowledge_type string, priority int")
    job = pipelines.import_file(
        _stored(spark, folder), f"{folder}/documents.parquet", rules, _config(spark), created_at=_at()
    )
    return job.rows.select("chunk_id", "knowledge_type", "content")


@query(
    "import_summaries",
    sql(
        "SELECT * FROM kold UNION ALL SELECT doc_id::VARCHAR, 'labels/' || doc_id, 'wide', "
        "'quality ' || quality FROM labels WHERE quality <> 1",
        "kold",
    ),
)
def _(spark, folder):
    job = pipelines.import_summaries(
        _stored(spark, folder), _summaries(spark, folder), "wide", created_at=_at()
    )
    return job.rows.select(*_SHOWN)


@query(
    "sdk_build",
    "SELECT count(*) AS total, count(*) FILTER (quality <> 1) AS success, 0::BIGINT AS failed, "
    "count(*) FILTER (quality = 1) AS skipped FROM labels",
)
def _(spark, folder):
    _, counts = pipelines.summary_index_build(
        _stored(spark, folder), _summaries(spark, folder), "wide", created_at=_at()
    )
    return counts


# Documents as a summary-type store, and the benchmark texts as queries.
cte("docvec", sql_hash_vectors("documents", "doc_id", "text"))
cte("benchvec", sql_hash_vectors("benchmark", "item_id", "text"))
cte(
    "doc_scores",
    """
    SELECT b.item_id AS query_idx, 'c' || v.doc_id AS chunk_id, 'doc ' || v.doc_id AS doc_title,
           d.source || '/' || d.lang AS doc_path, d.source || ', ' || d.lang || ', first' AS core_classes, d.text AS doc_summary, d.lang AS knowledge_type,
           coalesce(l.toxic, 0) = 1 AS deleted,
           round(list_cosine_similarity(v.embedding::DOUBLE[], b.embedding::DOUBLE[]), 12) AS score
    FROM docvec v JOIN documents d USING (doc_id) LEFT JOIN labels l USING (doc_id)
    CROSS JOIN benchvec b
    """,
)
_TYPES = [("fr", 0), ("en", 1), ("de", 2)]
cte(
    "doc_hits",
    """
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_idx ORDER BY score DESC,
      CASE knowledge_type WHEN 'fr' THEN 0 WHEN 'en' THEN 1 ELSE 2 END, chunk_id) AS rank
      FROM doc_scores WHERE NOT deleted AND score >= 0.3 AND knowledge_type IN ('fr', 'en', 'de'))
    WHERE rank <= 10
    """,
)


def _document_store(spark, folder):
    labels = table(spark, folder, "labels").select("doc_id", "toxic")
    rows = table(spark, folder, "documents").join(labels, "doc_id", "left")
    embedded = pipelines.embed_distinct(
        rows.select(
            F.concat(F.lit("c"), "doc_id").alias("chunk_id"),
            F.col("doc_id").cast("string").alias("doc_id"),
            F.concat(F.lit("doc "), "doc_id").alias("doc_title"),
            F.concat("source", F.lit("/"), "lang").alias("doc_path"),
            F.col("text").alias("doc_summary"),
            F.col("lang").alias("knowledge_type"),
            F.col("text").alias("content"),
            (F.coalesce("toxic", F.lit(0)) == 1).alias("deleted"),
            F.array("source", "lang", F.lit("first"), F.lit("second")).alias("core_classes"),
        )
    )
    # A store is a written table; searches read it several times.
    written = materialise(embedded.where(F.col("embedding").isNotNull()))
    return as_store_rows(written, "core_classes")


def _texts(spark, folder):
    return table(spark, folder, "benchmark").select(
        F.col("item_id").alias("query_idx"), F.col("text").alias("query")
    )


@query(
    "retrieve",
    sql(
        "SELECT doc_path, query_idx, rank::INTEGER AS rank, doc_summary, score FROM (SELECT *, "
        "row_number() OVER (PARTITION BY doc_path ORDER BY query_idx, rank) AS n FROM doc_hits) "
        "WHERE n = 1",
        "doc_hits",
    ),
)
def _(spark, folder):
    types = values(spark, _TYPES, "knowledge_type string, type_order int")
    return pipelines.retrieve(_document_store(spark, folder), _texts(spark, folder), types)


@query(
    "sdk_search",
    sql(
        "SELECT query_idx, rank::INTEGER AS rank, doc_title, doc_path, score, "
        "substr(doc_summary, 1, 150) AS doc_summary, core_classes FROM (SELECT *, row_number() OVER "
        "(PARTITION BY query_idx ORDER BY score DESC, chunk_id) AS rank FROM doc_scores "
        "WHERE NOT deleted AND knowledge_type = 'en') WHERE rank <= 5 AND score >= 0",
        "doc_scores",
    ),
)
def _(spark, folder):
    store = _document_store(spark, folder)
    return pipelines.summary_index_search(store, _texts(spark, folder), "en", classes="core_classes")


@query(
    "sdk_stats",
    "SELECT count(*) AS total_summaries, count(*) FILTER (quality = 1) AS indexed FROM labels",
)
def _(spark, folder):
    return pipelines.summary_index_stats(
        _summaries(spark, folder), _stored(spark, folder), "wide"
    )


_INPUTS = ["doc_id", "doc_title", "doc_path", "doc_summary", "content"]


def _inputs(spark, folder):
    return table(spark, folder, "documents").select(
        F.col("doc_id").cast("string").alias("doc_id"),
        F.col("lang").alias("doc_title"),
        F.col("source").alias("doc_path"),
        F.col("lang").alias("doc_summary"),
        F.col("text").alias("content"),
    )


@query(
    "build_index",
    sql(
        """
        SELECT CASE WHEN total = 1 THEN doc_id::VARCHAR ELSE doc_id || '_chunk_' || n END
               AS chunk_id, 'en' AS knowledge_type, piece AS content
        FROM (SELECT *, count(*) OVER (PARTITION BY doc_id) AS total FROM ch_tiered)
        WHERE regexp_matches(piece, '[^ \\t\\r\\n]')
        UNION ALL SELECT chunk_id, knowledge_type, content FROM st
        """,
        "ch_tiered",
        "st",
    ),
)
def _(spark, folder):
    rebuilt, _ = pipelines.build_index(
        store_table(spark, folder), _inputs(spark, folder), "en", created_at=_at()
    )
    return rebuilt.select("chunk_id", "knowledge_type", "content")


@query(
    "rebuild_stats",
    sql(
        """
        SELECT count(*) AS total, sum(coalesce(good, 0))::BIGINT AS success,
               sum(coalesce(bad, 1))::BIGINT AS failed
        FROM documents d LEFT JOIN (
          SELECT doc_id, count(*) FILTER (regexp_matches(piece, '[^ \\t\\r\\n]')) AS good,
                 count(*) FILTER (NOT regexp_matches(piece, '[^ \\t\\r\\n]')) AS bad
          FROM ch_tiered GROUP BY doc_id) USING (doc_id)
        """,
        "ch_tiered",
    ),
)
def _(spark, folder):
    _, ledger = pipelines.build_index(
        store_table(spark, folder), _inputs(spark, folder), "en", created_at=_at()
    )
    return build_stats(ledger)


cte(
    "form_files",
    f"""
    SELECT f AS filename, max_by(text, p_partkey) AS text FROM (
      SELECT {_FILE} AS f, p_partkey, coalesce(l.result, r.md) AS text
      FROM rendered r LEFT JOIN filled l USING (p_partkey) WHERE r.md IS NOT NULL) GROUP BY f
    """,
)


def _form_etl(spark, folder):
    rules = values(spark, [("forms/", "form", 1)], "pattern string, knowledge_type string, priority int")
    config = values(spark, [("form", "file_name")], "knowledge_type string, vector_field string")
    return pipelines.form_etl(
        _stored(spark, folder), _records(spark, folder), "forms", rules, config, F.lit(CREATED)
    )


@query(
    "form_etl",
    sql(
        """
        SELECT regexp_replace(filename, '\\.md$', '') AS chunk_id, 'forms/' || filename AS doc_path,
               'form' AS knowledge_type, regexp_replace(filename, '\\.md$', '') AS content, text AS document
        FROM form_files
        UNION ALL SELECT *, NULL FROM kold
        """,
        "form_files",
        "kold",
    ),
)
def _(spark, folder):
    # The imported rows with the described document each of them stands for.
    job = _form_etl(spark, folder)
    written = job.documents.select(
        F.concat(F.lit("forms/"), "filename").alias("doc_path"), F.col("md").alias("document")
    )
    return job.rows.select(*_SHOWN).join(written, "doc_path", "left")


@query(
    "form_etl_ledger",
    sql(
        f"""
        SELECT 'forms/' || filename AS file_path, 'completed' AS status, NULL AS error_message FROM form_files
        UNION ALL SELECT 'forms/' || {_FILE}, 'failed', '{pipelines.ERROR_NO_DOCUMENT}'
        FROM rendered WHERE md IS NULL
        """,
        "form_files",
        "rendered",
    ),
)
def _(spark, folder):
    return _form_etl(spark, folder).ledger.select("file_path", "status", "error_message")
