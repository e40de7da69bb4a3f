"""Queries of scans, routing and exports. Files are written by Spark from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from vectorloom.catalog.form_queries import form_table
from vectorloom.catalog.registry import QUERIES, SQL, cte, query, sql, table, values
from vectorloom.operators import routing
from vectorloom.session import scratch_path
from vectorloom.sources import exports, files, records


def _text_files(spark, folder):
    """The documents as text files, one folder per language; every text ends its line."""
    path = scratch_path(spark, "texts")
    documents = table(spark, folder, "documents").select("lang", "text")
    documents.write.partitionBy("lang").text(path)
    return path


def _lang():
    return F.regexp_extract("path", "lang=([^/]+)", 1).alias("lang")


@query(
    "scan_knowledge_files",
    "SELECT lang, sum(strlen(text) + 1)::BIGINT AS bytes FROM documents GROUP BY lang",
)
def _(spark, folder):
    found = files.scan_knowledge_files(spark, _text_files(spark, folder), only_md=False)
    return found.groupBy(_lang()).agg(F.sum("length").alias("bytes"))


@query(
    "read_text_files",
    "SELECT lang, sum(length(text) + 1)::BIGINT AS chars, "
    "sum(strlen(text) + 1)::BIGINT AS bytes FROM documents GROUP BY lang",
)
def _(spark, folder):
    texts = files.read_text_files(spark, _text_files(spark, folder), "*.txt")
    return texts.groupBy(_lang()).agg(
        F.sum(F.length("content")).alias("chars"), F.sum("length").alias("bytes")
    )


@query(
    "filter_allowed_files",
    r"""
    SELECT url AS path, strlen(html) AS length FROM pages
    WHERE lower(regexp_extract(url, '[^/](\.[^./]+)/*$', 1)) = '.html'
      AND strlen(html) <= 20000
    """,
)
def _(spark, folder):
    listed = table(spark, folder, "pages").select(
        F.col("url").alias("path"), F.octet_length("html").cast("long").alias("length")
    )
    return files.filter_allowed_files(listed, [".html"], 20_000)


# Routing rules over page addresses; lower priority wins.
_RULES = [
    ("/en/", "english", 2),
    ("spam", "spam", 0),
    ("blog.", "blog", 1),
    ("/fr/", "french", 2),
]


@query(
    "route_knowledge_type",
    "SELECT page_id, CASE WHEN contains(url, 'spam') THEN 'spam' WHEN contains(url, 'blog.') "
    "THEN 'blog' WHEN contains(url, '/en/') THEN 'english' WHEN contains(url, '/fr/') THEN 'french' "
    "END AS knowledge_type FROM pages",
)
def _(spark, folder):
    rules = values(spark, _RULES, "pattern string, knowledge_type string, priority int")
    routed = routing.route_knowledge_type(table(spark, folder, "pages"), rules, "url")
    return routed.select("page_id", "knowledge_type")


def _typed(spark, folder):
    return table(spark, folder, "documents").select("doc_id", F.col("lang").alias("knowledge_type"))


def _config(spark):
    return values(
        spark, [("en", 0, 5), ("fr", 1, 3)], "knowledge_type string, type_order int, search_k int"
    )


@query(
    "type_config_join",
    "SELECT doc_id, lang AS knowledge_type, CASE lang WHEN 'en' THEN 0 ELSE 1 END AS type_order, "
    "CASE lang WHEN 'en' THEN 5 ELSE 3 END AS search_k FROM documents WHERE lang IN ('en', 'fr')",
)
def _(spark, folder):
    joined = routing.type_config_join(_typed(spark, folder), _config(spark))
    return joined.select("doc_id", "knowledge_type", "type_order", "search_k")


@query(
    "validate_types",
    "SELECT doc_id, lang AS knowledge_type, lang IN ('en', 'fr') AS accepted FROM documents",
)
def _(spark, folder):
    accepted, rejected = routing.validate_types(_typed(spark, folder), _config(spark))
    return accepted.withColumn("accepted", F.lit(True)).unionByName(
        rejected.withColumn("accepted", F.lit(False))
    )


_STEM = r"regexp_extract(url, '([^/]+?)(\.[^./]+)?/*$', 1)"


@query(
    "vector_input_file_name",
    f"SELECT page_id, {_STEM} AS doc_id, {_STEM} AS doc_title, url AS doc_path, "
    f"{_STEM} AS doc_summary, {_STEM} AS content FROM pages",
)
def _(spark, folder):
    pages = table(spark, folder, "pages").select("page_id", F.col("url").alias("path"))
    return routing.vector_input_file_name(pages)


# Summaries derived from the labels, twice per document: by id and by title. A file's stem is a
# document id; the first summary with that id or title counts.
cte(
    "summ",
    """
    SELECT doc_id::VARCHAR AS doc_id, (doc_id + quality + 1)::VARCHAR AS doc_title,
           'labels/' || doc_id AS doc_path, 'quality ' || quality || ' toxic ' || toxic AS summary,
           doc_id AS position FROM labels
    """,
)


def _summaries(spark, folder):
    return table(spark, folder, "labels").select(
        F.col("doc_id").cast("string").alias("doc_id"),
        (F.col("doc_id") + F.col("quality") + 1).cast("string").alias("doc_title"),
        F.concat(F.lit("labels/"), "doc_id").alias("doc_path"),
        F.concat(F.lit("quality "), "quality", F.lit(" toxic "), "toxic").alias("summary"),
        F.col("doc_id").alias("position"),
    )


cte(
    "looked_up",
    """
    SELECT d.doc_id::VARCHAR AS stem, d.source || '/' || d.doc_id || '.md' AS path,
           s.doc_id, s.doc_title, s.doc_path, s.summary
    FROM documents d LEFT JOIN (
      SELECT *, row_number() OVER (PARTITION BY k ORDER BY position) AS n FROM (
        SELECT doc_id AS k, * FROM summ UNION ALL SELECT doc_title AS k, * FROM summ)) s
    ON s.k = d.doc_id::VARCHAR AND s.n = 1
    """,
)


@query(
    "summary_lookup",
    sql("SELECT stem, doc_id, doc_title, doc_path, summary FROM looked_up", "looked_up"),
)
def _(spark, folder):
    stems = table(spark, folder, "documents").select(F.col("doc_id").cast("string").alias("stem"))
    return routing.summary_lookup(stems, _summaries(spark, folder)).select("stem", "_summary.*")


@query(
    "vector_input_summary",
    sql(
        "SELECT path AS source_file, doc_id, doc_title, doc_path, summary AS doc_summary, "
        "summary AS content FROM looked_up",
        "looked_up",
    ),
)
def _(spark, folder):
    path = F.concat("source", F.lit("/"), "doc_id", F.lit(".md")).alias("path")
    paths = table(spark, folder, "documents").select(path)
    return routing.vector_input_summary(paths, _summaries(spark, folder))


def _json_files(spark, rows, key, wrap, label, size=200):
    """Rows as JSON files of up to ``size`` records each."""
    path = scratch_path(spark, label)
    record = F.struct(key, F.struct(*[c for c in rows.columns if c != key]).alias("record"))
    grouped = rows.groupBy(F.floor(F.col(key) / size).alias("part")).agg(
        F.array_sort(F.collect_list(record)).alias("sorted")
    )
    text = F.to_json(wrap(F.col("sorted.record")), {"ignoreNullFields": "true"})
    grouped.select("part", text.alias("value")).write.partitionBy("part").text(path)
    return path


@query(
    "scan_summaries",
    "SELECT doc_id::VARCHAR AS doc_id, CASE WHEN lang = 'de' THEN '' ELSE lang || ' ' || source END "
    "AS doc_title, source AS doc_path, text AS summary FROM documents",
)
def _(spark, folder):
    rows = table(spark, folder, "documents").select(
        F.col("doc_id").alias("_key"),
        F.col("doc_id").cast("string").alias("doc_id"),
        F.when(F.col("lang") != "de", F.concat_ws(" ", "lang", "source")).alias("doc_title"),
        F.col("source").alias("doc_path"),
        F.col("text").alias("summary"),
    )
    path = _json_files(spark, rows, "_key", lambda found: found, "summaries")
    return records.scan_summaries(spark, path).drop("position")


_FORM_RECORDS = sql(
    "SELECT p_partkey // 200 AS part, (row_number() OVER (PARTITION BY p_partkey // 200 "
    "ORDER BY p_partkey) - 1)::INTEGER AS position, form_id AS number, form_name AS name, "
    "coalesce(structure, '') AS structure FROM forms",
    "forms",
)


def _form_records(spark, folder, wrap, **limits):
    rows = form_table(spark, folder).select(
        "p_partkey",
        F.col("form_id").alias("FK_NYLQ_NUMBER"),
        F.col("form_name").alias("FK_NYLQ_NAME"),
        F.col("structure").alias("FK_NYLQ_STRUCTURE_TAG"),
    )
    path = _json_files(spark, rows, "p_partkey", wrap, "forms")
    return records.scan_form_records(spark, path, **limits).select(
        F.regexp_extract("file_path", "part=([0-9]+)", 1).cast("long").alias("part"),
        "position",
        F.col("FK_NYLQ_NUMBER").alias("number"),
        F.col("FK_NYLQ_NAME").alias("name"),
        F.col("FK_NYLQ_STRUCTURE_TAG").alias("structure"),
    )


@query("scan_form_records", _FORM_RECORDS)
def _(spark, folder):
    return _form_records(spark, folder, lambda found: F.struct(found.alias("RECORDS")))


@query("scan_form_records_in_pieces", _FORM_RECORDS)
def _(spark, folder):
    """All files by the way of large ones; the list stands behind another list."""

    def wrap(found):
        return F.struct(F.array(F.lit("x], {")).alias("notes"), found.alias("forms"))

    return _form_records(spark, folder, wrap, cap=0)


def _export_query() -> None:
    """Export of the token report, read back; runs the report's own query."""

    def run(spark, folder):
        report = QUERIES["token_usage_report"](spark, folder)
        path = scratch_path(spark, "export")
        exports.export_json(report, path)
        return spark.read.schema(report.schema).json(path)

    QUERIES["export_json"] = run
    SQL["export_json"] = SQL["token_usage_report"]


from vectorloom.catalog import stat_queries  # noqa: E402,F401  isort: skip

_export_query()
