"""End-to-end jobs composed from the operators."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vectorloom import settings
from vectorloom.functions.text import file_stem
from vectorloom.operators import forms, search, stats, store
from vectorloom.operators.embedding import (
    Encoder,
    HashEncoder,
    VectorTable,
    embed_chunks,
    embed_distinct,
    embed_kept,
    embed_text,
    filter_embedded,
)
from vectorloom.operators.routing import (
    BY_FILE_NAME,
    BY_SUMMARY,
    route_knowledge_type,
    vector_input_file_name,
    vector_input_summary,
)
from vectorloom.schemas import VECTOR_INPUT_COLUMNS
from vectorloom.session import materialise, scratch_path
from vectorloom.sources.exports import write_form_markdown
from vectorloom.sources.files import stored_place

EncoderFactory = Callable[[], Encoder]

# Messages of the import ledger.
ERROR_MISSING = "文件不存在"
ERROR_NO_INPUT = "无法获取向量数据"
ERROR_NO_VECTOR = "向量生成失败"

# Message of the ledger for a form record without a structure.
ERROR_NO_DOCUMENT = "the record has no structure to render"


@dataclass
class ImportJob:
    """Results of an import: the new store, one outcome row per file, the vectors, the rows that
    the store did not hold, and the documents that a form job has written."""

    rows: DataFrame
    ledger: DataFrame
    embedded: DataFrame | None = None
    added: DataFrame | None = None
    documents: DataFrame | None = None


def file_inputs(
    files: DataFrame, rules: DataFrame, config: DataFrame, summaries: DataFrame | None
) -> DataFrame:
    """Vector input of every file: routed, then by file name or by summary as its type says.

    Every file keeps a row; ``content`` is null where no input can be made. Files are read and
    routed once: both kinds of input are columns of one projection, not branches of a union.
    """
    by_type = config.select("knowledge_type", "vector_field")
    # Broadcast, as files of one type would meet in one task.
    routed = (
        route_knowledge_type(files.select("path"), rules)
        .join(F.broadcast(by_type), "knowledge_type", "left")
        .withColumn("source_file", F.col("path"))
        .withColumn("_file", F.col("path"))
    )
    named = vector_input_file_name(routed)
    by_name = F.col("vector_field") == BY_FILE_NAME
    chosen = {name: F.when(by_name, F.col(name)) for name in VECTOR_INPUT_COLUMNS}
    if summaries is None:
        return named.select("knowledge_type", "source_file", *_aliased(chosen))
    found = vector_input_summary(
        named.select(
            "knowledge_type",
            "vector_field",
            "source_file",
            F.struct(*VECTOR_INPUT_COLUMNS).alias("_named"),
            F.col("_file").alias("path"),
        ),
        summaries,
        source_file=None,
    )
    by_summary = F.col("vector_field") == BY_SUMMARY
    chosen = {
        name: F.when(by_name, F.col(f"_named.{name}")).when(by_summary, F.col(name))
        for name in VECTOR_INPUT_COLUMNS
    }
    return found.select("knowledge_type", "source_file", *_aliased(chosen))


def _aliased(columns: dict[str, Column]) -> list[Column]:
    return [column.alias(name) for name, column in columns.items()]


def _ledger(embedded: DataFrame) -> DataFrame:
    """Outcome of every file: status, name, chunks, error."""
    failed = (
        F.when(F.col("content").isNull(), ERROR_NO_INPUT)
        .when(F.col("embedding").isNull(), ERROR_NO_VECTOR)
        .otherwise(F.lit(None))
    )
    return embedded.select(
        F.col("source_file").alias("file_path"),
        "knowledge_type",
        file_stem(F.col("source_file")).alias("knowledge_name"),
        F.when(failed.isNull(), "completed").otherwise("failed").alias("status"),
        F.when(F.col("content").isNull(), 0).otherwise(1).alias("chunks_count"),
        failed.alias("error_message"),
    )


def _embedded(inputs: DataFrame, encoder: EncoderFactory, kept: VectorTable | None) -> DataFrame:
    return embed_distinct(inputs, encoder) if kept is None else embed_kept(inputs, kept, encoder)[0]


def _batch(embedded: DataFrame, created_at: Column | None, order: str) -> DataFrame:
    """Store rows of the inputs that got a vector; the document id is the key.

    ``order`` is kept: it says which of several rows with one key is the last.
    """
    stored_at = F.current_timestamp() if created_at is None else created_at
    rows = filter_embedded(embedded).select(
        F.col("doc_id").alias("chunk_id"),
        "doc_id",
        "doc_title",
        "doc_path",
        "doc_summary",
        "knowledge_type",
        F.col("source_file").alias("source"),
        "content",
        "embedding",
        stored_at.cast("timestamp").alias("created_at"),
        F.col(order).alias("_order"),
    )
    return store.as_store_rows(rows, "_order")


def import_directory(
    store_rows: DataFrame,
    files: DataFrame,
    rules: DataFrame,
    config: DataFrame,
    summaries: DataFrame | None = None,
    encoder: EncoderFactory = HashEncoder,
    created_at: Column | None = None,
    kept: VectorTable | None = None,
) -> ImportJob:
    """Route, read the vector input, embed distinct texts, add keys that are not stored yet.

    The inputs are written to the shared folder, so rows and ledger speak of the same files. Of
    several files with one id the last by path counts. With ``kept`` vectors, texts of earlier jobs are not
    encoded again.
    """
    embedded = embedded_files(files, rules, config, summaries, encoder, kept)
    batch = _batch(embedded, created_at, "source_file")
    rows = store.insert_if_absent(store_rows, batch, "_order")
    added = store.new_rows(store_rows, batch, "_order")
    return ImportJob(rows, _ledger(embedded), embedded, added)


def embedded_files(
    files: DataFrame,
    rules: DataFrame,
    config: DataFrame,
    summaries: DataFrame | None = None,
    encoder: EncoderFactory = HashEncoder,
    kept: VectorTable | None = None,
) -> DataFrame:
    """The vector input of files with its vectors; the inputs are written first."""
    inputs = materialise(file_inputs(files, rules, config, summaries), "inputs")
    return _embedded(inputs, encoder, kept)


def file_batch(embedded: DataFrame, created_at: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Of ``embedded_files`` the store rows, the last by path of every key, and the ledger. The store is not read."""
    batch = store.live_rows(_batch(embedded, created_at, "source_file"), "_order").drop("_order")
    return batch, _ledger(embedded)


def import_folder(
    store_rows: DataFrame,
    directory: str,
    files: DataFrame,
    rules: DataFrame,
    config: DataFrame,
    summaries: DataFrame | None = None,
    encoder: EncoderFactory = HashEncoder,
    created_at: Column | None = None,
) -> ImportJob:
    """The import of a directory as a whole: its own path decides what is imported.

    A directory without a type, or of a type without settings, imports nothing. One of a summary
    type imports all summary records of the type (``summaries`` without any: nothing), whatever
    files there are. Any other imports those of ``files`` that lie below it, each by its own path.
    """
    spark = store_rows.sparkSession
    place = spark.createDataFrame([(directory,)], "path string")
    settled = route_knowledge_type(place, rules).join(config, "knowledge_type").head()
    by_summary = settled is not None and settled["vector_field"] == BY_SUMMARY
    if settled is None or (by_summary and summaries is None):
        nothing = spark.createDataFrame([], "source_file string, knowledge_type string, content string")
        return ImportJob(store_rows, _ledger(nothing.withColumn("embedding", F.array().cast("array<float>"))))
    if by_summary:
        return import_summaries(store_rows, summaries, settled["knowledge_type"], encoder, created_at)
    below = files.where(F.col("path").startswith(directory.rstrip("/") + "/"))
    return import_directory(store_rows, below, rules, config, summaries, encoder, created_at)


def import_file(
    store_rows: DataFrame,
    path: str,
    rules: DataFrame,
    config: DataFrame,
    summaries: DataFrame | None = None,
    encoder: EncoderFactory = HashEncoder,
    created_at: Column | None = None,
) -> ImportJob:
    """One file: as a directory import, but an existing key is replaced.

    A file that is stored as a folder of parts, as Spark writes tables, is one file: it is imported by its own
    name, not by those of its parts. A missing file gives a failed outcome.
    """
    spark = store_rows.sparkSession
    place = stored_place(spark, path)
    if place is None:
        ledger = spark.createDataFrame(
            [(path, None, "failed", 0, ERROR_MISSING)],
            "file_path string, knowledge_type string, status string, chunks_count int, "
            "error_message string",
        ).withColumn("knowledge_name", file_stem(F.col("file_path")))
        return ImportJob(store_rows, ledger)
    files = spark.createDataFrame([(place,)], "path string")
    inputs = file_inputs(files, rules, config, summaries)
    embedded = materialise(embed_text(inputs, encoder))
    batch = _batch(embedded, created_at, "source_file")
    rows = store.upsert_documents(store_rows, batch, "_order")
    return ImportJob(rows, _ledger(embedded), embedded)


def summary_inputs(summaries: DataFrame, knowledge_type: str) -> DataFrame:
    """Vector input of every summary record: the summary is the text."""
    return summaries.select(
        "doc_id",
        "doc_title",
        "doc_path",
        F.col("summary").alias("doc_summary"),
        F.col("summary").alias("content"),
        F.lit(knowledge_type).alias("knowledge_type"),
        F.col("doc_path").alias("source_file"),
        "position",
    )


def import_summaries(
    store_rows: DataFrame,
    summaries: DataFrame,
    knowledge_type: str,
    encoder: EncoderFactory = HashEncoder,
    created_at: Column | None = None,
    kept: VectorTable | None = None,
) -> ImportJob:
    """Embed the summary records of a type and add the keys that are not stored yet."""
    inputs = summary_inputs(summaries, knowledge_type)
    embedded = _embedded(materialise(inputs, "inputs"), encoder, kept)
    rows = store.insert_if_absent(store_rows, _batch(embedded, created_at, "position"), "_order")
    return ImportJob(rows, _ledger(embedded), embedded)


def build_index(
    store_rows: DataFrame,
    inputs: DataFrame,
    knowledge_type: str,
    encoder: EncoderFactory = HashEncoder,
    created_at: Column | None = None,
    mode: str = "tiered",
) -> tuple[DataFrame, DataFrame]:
    """Rebuild one type: its old rows go, the inputs are chunked, embedded and stored.

    Returns the new store and ``build_stats``-ready rows ``(doc_id, success, failed)``; an input
    without any chunk counts as one failure.
    """
    stored_at = F.current_timestamp() if created_at is None else created_at
    chunks = embed_chunks(inputs, encoder, mode=mode).withColumn(
        "knowledge_type", F.lit(knowledge_type)
    )
    batch = store.as_store_rows(
        filter_embedded(chunks)
        .withColumn("created_at", stored_at.cast("timestamp"))
        .withColumn("seq", F.col("chunk_index").cast("long"))
    )
    rebuilt = store.delete_by_type(store_rows, knowledge_type).unionByName(store.latest_rows(batch))
    counted = stats.doc_chunk_counts(chunks).select("doc_id", "success", "failed")
    ledger = (
        inputs.select("doc_id")
        .join(counted, "doc_id", "left")
        .select(
            "doc_id",
            F.coalesce("success", F.lit(0)).alias("success"),
            F.coalesce("failed", F.lit(1)).alias("failed"),
        )
    )
    return rebuilt, ledger


def retrieve(
    store_rows: DataFrame,
    queries: DataFrame,
    types: DataFrame,
    encoder: EncoderFactory = HashEncoder,
    k: int = settings.SEARCH_K,
    min_score: float = settings.SEARCH_MIN_SCORE,
) -> DataFrame:
    """Query texts to distinct documents, in the order they are first found."""
    asked = search.query_input(queries)
    embedded = filter_embedded(embed_text(asked, encoder, "query"))
    return search.search_multi_query(store_rows, embedded, types, k, min_score)


def summary_index_build(
    store_rows: DataFrame,
    summaries: DataFrame,
    knowledge_type: str,
    encoder: EncoderFactory = HashEncoder,
    created_at: Column | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Index the summaries of one type; counts total, success, failed and skipped.

    A summary is skipped when its key is already stored.
    """
    job = import_summaries(store_rows, summaries, knowledge_type, encoder, created_at)
    asked = job.embedded.withColumn("chunk_id", F.col("doc_id"))
    stored = store.stored_rows(store_rows, asked).withColumn("_stored", F.lit(True))
    known = F.col("_stored").isNotNull()
    encoded = F.col("embedding").isNotNull()
    counts = asked.join(stored, store.KEY, "left").agg(
        F.count("*").alias("total"),
        F.count_if(~known & encoded).alias("success"),
        F.count_if(~encoded).alias("failed"),
        F.count_if(known & encoded).alias("skipped"),
    )
    return job.rows, counts


def summary_index_search(
    store_rows: DataFrame,
    queries: DataFrame,
    knowledge_type: str,
    encoder: EncoderFactory = HashEncoder,
    k: int = 5,
    min_score: float = 0.0,
    classes: str | None = None,
) -> DataFrame:
    """Titled hits of one type with 150 characters of summary.

    ``classes`` names an array column of the store; up to three of its entries are shown.
    """
    embedded = filter_embedded(embed_text(search.query_input(queries), encoder, "query"))
    rows = store_rows.where(F.col("knowledge_type") == knowledge_type)
    hits = search.store_search(rows, embedded, k, min_score)
    return search.search_titled(hits, rows, summary_chars=150, classes=classes)


def summary_index_stats(
    summaries: DataFrame, store_rows: DataFrame, knowledge_type: str
) -> DataFrame:
    """Number of summaries and of those with an active row, one row."""
    live = store_rows.where((F.col("knowledge_type") == knowledge_type) & ~F.col("deleted"))
    return (
        summaries.select("doc_id")
        .join(live.groupBy("doc_id").agg(F.lit(1).alias("_live")), "doc_id", "left")
        .agg(F.count("*").alias("total_summaries"), F.count("_live").alias("indexed"))
    )


def form_documents(records: DataFrame, created_at: Column, prefix: str = "") -> DataFrame:
    """Form records to their described Markdown ``(position, filename, md)``, one row per record.

    ``md`` is null for a record without a structure, and the plain rendering where a document has
    no markers to fill. Needs no shuffle.
    """
    described = forms.describe_documents(forms.convert_forms(records, created_at, prefix, "position"))
    return described.select("position", "filename", F.coalesce("described", "md").alias("md"))


def form_etl(
    store_rows: DataFrame,
    records: DataFrame,
    directory: str,
    rules: DataFrame,
    config: DataFrame,
    created_at: Column,
    encoder: EncoderFactory = HashEncoder,
    path: str | None = None,
) -> ImportJob:
    """Form records to described Markdown, written, and imported as the files of a directory.

    The documents are written once, to ``path`` or the shared folder. Of several records with one
    file name the last by ``position`` is the document. A record that cannot be rendered is a failed
    row of the ledger; all others are there as imported files.
    """
    rendered = materialise(form_documents(records, created_at), "forms")
    last = F.max_by(F.struct("md"), F.struct("position", "md"))
    sound = rendered.where(F.col("md").isNotNull()).groupBy("filename").agg(last.alias("_last"))
    target = path or scratch_path(records.sparkSession, "documents")
    documents = write_form_markdown(sound.select("filename", "_last.md"), target)
    location = F.concat(F.lit(f"{directory}/"), "filename")
    job = import_directory(
        store_rows, documents.select(location.alias("path")), rules, config, None, encoder, created_at
    )
    failed = rendered.where(F.col("md").isNull()).select(
        location.alias("file_path"),
        F.lit(None).cast("string").alias("knowledge_type"),
        file_stem(F.col("filename")).alias("knowledge_name"),
        F.lit("failed").alias("status"),
        F.lit(0).alias("chunks_count"),
        F.lit(ERROR_NO_DOCUMENT).alias("error_message"),
    )
    return replace(job, ledger=job.ledger.unionByName(failed), documents=documents)
