"""Queries of chunking, token estimates, batching and embedding."""

from __future__ import annotations

from pyspark.sql import functions as F

from vectorloom.catalog.registry import (
    cte,
    query,
    sql,
    sql_bucket,
    sql_hash_vectors,
    sql_strip,
    sql_tokens,
    table,
)
from vectorloom.functions.tokens import token_estimate, token_estimate_alt
from vectorloom.functions.vectors import l2_normalize, masked_mean
from vectorloom.operators import batching, chunking, embedding
from vectorloom.session import scratch_path
from vectorloom.sources.files import scan_knowledge_files

SIZE, OVERLAP = 1000, 100
_TIERS = (("[。！？\\n]", 100), ("[，、；：]", 50), ("[ ]", 20))


def _cut(window: str, chars: str, base: str) -> str:
    """Position after the last break in a window, null when there is none."""
    return (
        f"CASE WHEN regexp_matches({window}, '{chars}') THEN {base} + "
        f"length(regexp_extract({window}, '(?s)^(.*){chars}', 1)) END"
    )


def sql_backward_chunks(source: str, key: str, text: str, tiers=_TIERS) -> str:
    """Recursive statement: one row per scan step of each text, ``piece`` may be blank."""
    end = f"(start_ + {SIZE})"
    cuts = ", ".join(
        _cut(f"substr(txt, {end} - {reach - 2}, {reach})", chars, f"{end} - {reach - 2}")
        for chars, reach in tiers
    )
    piece = sql_strip("substr(txt, start_ + 1, cut - start_)")
    return f"""
    SELECT {key}, {text} AS txt, 0 AS start_, -1 AS kept, 0 AS step, NULL::VARCHAR AS piece
    FROM {source} WHERE length({text}) > {SIZE}
    UNION ALL
    SELECT {key}, txt,
           CASE WHEN resume <= new_kept THEN cut ELSE resume END, new_kept, step + 1, piece
    FROM (
      SELECT *, CASE WHEN piece <> '' THEN length(piece) ELSE kept END AS new_kept,
             CASE WHEN cut = length(txt) THEN cut ELSE cut - {OVERLAP} END AS resume
      FROM (
        SELECT {key}, txt, start_, kept, step, cut, {piece} AS piece
        FROM (
          SELECT {key}, txt, start_, kept, step,
                 CASE WHEN {end} >= length(txt) THEN length(txt)
                      ELSE coalesce({cuts}, {end}) END AS cut
          FROM {{name}} WHERE start_ < length(txt))))
    """


def sql_lookahead_chunks(source: str, key: str, text: str) -> str:
    base = f"start_ + {SIZE - 98}"
    cuts = ", ".join(_cut(f"substr(txt, {base}, 200)", chars, base) for chars, _ in _TIERS)
    return f"""
    SELECT {key}, {text} AS txt, 0 AS start_, FALSE AS done, 0 AS step, NULL::VARCHAR AS piece
    FROM {source} WHERE {text} <> ''
    UNION ALL
    SELECT {key}, txt, cut - {OVERLAP}, rest <= {SIZE} OR cut >= length(txt), step + 1,
           CASE WHEN rest = {SIZE} THEN substr(txt, start_ + 1)
                ELSE {sql_strip("substr(txt, start_ + 1, cut - start_)")} END
    FROM (
      SELECT *, length(txt) - start_ AS rest,
             CASE WHEN length(txt) - start_ <= {SIZE} THEN length(txt)
                  ELSE coalesce({cuts}, start_ + {SIZE}) END AS cut
      FROM {{name}} WHERE NOT done)
    """


def _numbered(steps: str, key: str, whole: str) -> str:
    return f"""
    SELECT {key}, row_number() OVER (PARTITION BY {key} ORDER BY step) AS n, piece FROM (
      SELECT {key}, step, piece FROM {steps} WHERE step > 0 AND {sql_strip("piece")} <> ''
      {whole})
    """


def _whole(source: str, key: str, text: str) -> str:
    return (
        f"UNION ALL SELECT {key}, 1, {text} FROM {source} "
        f"WHERE {text} <> '' AND length({text}) <= {SIZE}"
    )


cte("steps_tiered", sql_backward_chunks("documents", "doc_id", "text").replace("{name}", "steps_tiered"))
cte("ch_tiered", _numbered("steps_tiered", "doc_id", _whole("documents", "doc_id", "text")))
cte(
    "steps_sentence",
    sql_backward_chunks("documents", "doc_id", "text", _TIERS[:1]).replace("{name}", "steps_sentence"),
)
cte("ch_sentence", _numbered("steps_sentence", "doc_id", _whole("documents", "doc_id", "text")))
cte("steps_look", sql_lookahead_chunks("documents", "doc_id", "text").replace("{name}", "steps_look"))
cte("ch_look", _numbered("steps_look", "doc_id", ""))
cte("look_key", "SELECT doc_id * 100000 + n AS piece_id, piece FROM ch_look")
cte("steps_nested", sql_backward_chunks("look_key", "piece_id", "piece").replace("{name}", "steps_nested"))
cte("ch_piece", _numbered("steps_nested", "piece_id", _whole("look_key", "piece_id", "piece")))
cte(
    "ch_nested",
    """
    SELECT piece_id // 100000 AS doc_id, piece,
           row_number() OVER (PARTITION BY piece_id // 100000 ORDER BY piece_id, n) AS n
    FROM ch_piece
    """,
)


def _chunk_sql(name: str) -> str:
    return sql(
        "SELECT doc_id, doc_id || '_chunk_' || n AS chunk_id, n::INTEGER AS chunk_index, "
        f"piece AS content FROM {name}",
        name,
    )


def _texts(spark, folder):
    return table(spark, folder, "documents").select("doc_id", F.col("text").alias("content"))


@query("chunk_documents", _chunk_sql("ch_tiered"))
def _(spark, folder):
    return chunking.chunk_documents(_texts(spark, folder), "tiered")


@query("chunk_documents_sentence", _chunk_sql("ch_sentence"))
def _(spark, folder):
    return chunking.chunk_documents(_texts(spark, folder), "sentence")


@query("chunk_documents_lookahead", _chunk_sql("ch_look"))
def _(spark, folder):
    return chunking.chunk_documents(_texts(spark, folder), "lookahead")


@query("chunk_nested", _chunk_sql("ch_nested"))
def _(spark, folder):
    return chunking.chunk_nested(_texts(spark, folder))


@query(
    "chunk_by_size",
    sql(
        """
        SELECT doc_id, doc_id || '_chunk_' || n AS chunk_id, n::INTEGER AS chunk_index,
               piece AS content FROM (
          SELECT t.doc_id, t.n, t.piece FROM ch_tiered t JOIN documents d USING (doc_id)
          WHERE strlen(d.text) <= 4000
          UNION ALL
          SELECT t.doc_id, t.n, t.piece FROM ch_nested t JOIN documents d USING (doc_id)
          WHERE strlen(d.text) > 4000)
        """,
        "ch_tiered",
        "ch_nested",
    ),
)
def _(spark, folder):
    sized = _texts(spark, folder).withColumn("length", F.octet_length("content"))
    chunks = chunking.chunk_by_size(sized, cap=4000)
    return chunks.select("doc_id", "chunk_id", "chunk_index", "content")


# Files of twenty documents each, every text a line.
cte(
    "text_files",
    "SELECT doc_id // 20 AS part, string_agg(text, chr(10) ORDER BY doc_id) || chr(10) AS body "
    "FROM documents GROUP BY doc_id // 20",
)
cte("file_steps_tiered", sql_backward_chunks("text_files", "part", "body").replace("{name}", "file_steps_tiered"))
cte("file_tiered", _numbered("file_steps_tiered", "part", _whole("text_files", "part", "body")))
cte("file_steps_look", sql_lookahead_chunks("text_files", "part", "body").replace("{name}", "file_steps_look"))
cte("file_look", _numbered("file_steps_look", "part", ""))
cte("file_key", "SELECT part * 1000000 + n AS piece_id, piece FROM file_look")
cte("file_steps_nested", sql_backward_chunks("file_key", "piece_id", "piece").replace("{name}", "file_steps_nested"))
cte("file_piece", _numbered("file_steps_nested", "piece_id", _whole("file_key", "piece_id", "piece")))
cte(
    "file_nested",
    """
    SELECT piece_id // 1000000 AS part, piece,
           row_number() OVER (PARTITION BY piece_id // 1000000 ORDER BY piece_id, n) AS n
    FROM file_piece
    """,
)
FILE_CAP = 45_000


@query(
    "chunk_files",
    sql(
        f"""
        SELECT part, part || '_chunk_' || n AS chunk_id, n::INTEGER AS chunk_index, piece AS content FROM (
          SELECT t.part, t.n, t.piece FROM file_tiered t JOIN text_files f USING (part)
          WHERE strlen(f.body) <= {FILE_CAP}
          UNION ALL
          SELECT t.part, t.n, t.piece FROM file_nested t JOIN text_files f USING (part)
          WHERE strlen(f.body) > {FILE_CAP})
        """,
        "file_tiered",
        "file_nested",
    ),
)
def _(spark, folder):
    path = scratch_path(spark, "large")
    row = F.struct("doc_id", "text")
    texts = table(spark, folder, "documents").groupBy(F.floor(F.col("doc_id") / 20).alias("part")).agg(
        F.array_join(F.array_sort(F.collect_list(row)).getField("text"), "\n").alias("value")
    )
    texts.write.partitionBy("part").text(path)
    files = scan_knowledge_files(spark, path, only_md=False).withColumn(
        "part", F.regexp_extract("path", "part=([0-9]+)", 1).cast("long")
    )
    return chunking.chunk_files(files, doc_id="part", cap=FILE_CAP).select(
        "part", "chunk_id", "chunk_index", "content"
    )


@query(
    "chunk_with_metadata",
    sql(
        "SELECT c.doc_id || '_chunk_' || n AS chunk_id, c.doc_id, d.lang || ' ' || d.source "
        "AS doc_title, d.source AS doc_path, d.lang AS doc_summary, piece AS content, "
        "n::INTEGER AS chunk_index FROM ch_tiered c JOIN documents d USING (doc_id)",
        "ch_tiered",
    ),
)
def _(spark, folder):
    inputs = table(spark, folder, "documents").select(
        "doc_id",
        F.concat_ws(" ", "lang", "source").alias("doc_title"),
        F.col("source").alias("doc_path"),
        F.col("lang").alias("doc_summary"),
        F.col("text").alias("content"),
    )
    return chunking.chunk_with_metadata(inputs)


@query(
    "filter_blank_text",
    rf"""
    SELECT doc_id, n::INTEGER AS line, piece AS content FROM (
      SELECT doc_id, unnest(string_split(text, chr(10))) AS piece,
             generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n FROM documents)
    WHERE {sql_strip("piece")} <> ''
    """,
)
def _(spark, folder):
    lines = table(spark, folder, "documents").select(
        "doc_id", F.posexplode(F.split("text", "\n")).alias("line", "content")
    )
    return chunking.filter_blank_text(lines)


@query("token_estimate", f"SELECT doc_id, {sql_tokens('text')} AS tokens FROM documents")
def _(spark, folder):
    return table(spark, folder, "documents").select(
        "doc_id", token_estimate(F.col("text")).alias("tokens")
    )


_CJK = r"length(regexp_replace(text, '[^\x{4E00}-\x{9FFF}]', '', 'g'))"


@query(
    "token_estimate_alt",
    f"SELECT doc_id, greatest(1, {_CJK} + (length(text) - {_CJK}) // 4)::INTEGER AS tokens "
    "FROM documents",
)
def _(spark, folder):
    return table(spark, folder, "documents").select(
        "doc_id", token_estimate_alt(F.col("text")).alias("tokens")
    )


cte(
    "tok",
    f"SELECT doc_id, token_count, {sql_bucket('token_count')} AS bucket FROM "
    f"(SELECT doc_id, {sql_tokens('text')} AS token_count FROM documents)",
)
cte(
    "batched",
    """
    SELECT *, (row_number() OVER (PARTITION BY bucket ORDER BY doc_id) - 1)
           // CASE bucket WHEN 'short' THEN 256 WHEN 'medium' THEN 64 ELSE 16 END AS batch_id
    FROM tok
    """,
)


def _tokens(spark, folder):
    counted = batching.with_token_info(table(spark, folder, "documents"), "text")
    return counted.select("doc_id", "token_count", "bucket")


@query("length_bucket", sql("SELECT doc_id, token_count, bucket FROM tok", "tok"))
def _(spark, folder):
    return _tokens(spark, folder)


@query(
    "assign_batches", sql("SELECT doc_id, token_count, bucket, batch_id FROM batched", "batched")
)
def _(spark, folder):
    return batching.assign_batches(_tokens(spark, folder), "doc_id")


@query("bucket_stats", sql("SELECT bucket, count(*) AS texts FROM tok GROUP BY bucket", "tok"))
def _(spark, folder):
    return batching.bucket_stats(_tokens(spark, folder))


@query(
    "batch_memory_mb",
    sql(
        "SELECT bucket, batch_id, count(*) AS texts, round(sum(token_count) * 1024 * 2 "
        "/ 1048576.0, 6)::DOUBLE AS memory_mb FROM batched GROUP BY bucket, batch_id",
        "batched",
    ),
)
def _(spark, folder):
    batched = batching.assign_batches(_tokens(spark, folder), "doc_id")
    return batching.batch_memory_mb(batched).withColumn("memory_mb", F.round("memory_mb", 6))


@query(
    "optimal_batch_size",
    sql(
        "SELECT greatest(16, least(512, floor(4096 * 0.7::DOUBLE "
        "/ (avg(token_count) * (1024 * 2 / 1048576.0::DOUBLE)))))::INTEGER AS batch_size FROM tok",
        "tok",
    ),
)
def _(spark, folder):
    return batching.optimal_batch_size(_tokens(spark, folder))


cte("dv", sql_hash_vectors("documents", "doc_id", "text"))
cte(
    "dv_flat",
    "SELECT doc_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS pos FROM dv",
)
_FLAT = sql("SELECT doc_id, pos::INTEGER AS pos, round(v::DOUBLE, 6) AS v FROM dv_flat", "dv_flat")


def _flat(df):
    rows = df.where(F.col("embedding").isNotNull()).select(
        "doc_id", F.posexplode("embedding").alias("pos", "v")
    )
    return rows.withColumn("v", F.round(F.col("v").cast("double"), 6))


@query("hash_encoder", _FLAT)
def _(spark, folder):
    return _flat(embedding.hash_encode(table(spark, folder, "documents"), "doc_id", "text"))


@query("embed_text", _FLAT)
def _(spark, folder):
    return _flat(embedding.embed_text(table(spark, folder, "documents"), text="text"))


@query("embed_distinct", _FLAT)
def _(spark, folder):
    documents = table(spark, folder, "documents").select("doc_id", "text")
    return _flat(embedding.embed_distinct(documents, text="text"))


def _second_job(spark, folder):
    """The whole table embedded behind a job that has embedded the English texts."""
    documents = table(spark, folder, "documents").select("doc_id", "lang", "text")
    kept = embedding.VectorTable(scratch_path(spark, "kept"), "hash/64")
    embedding.embed_kept(documents.where("lang = 'en'"), kept, text="text")
    return embedding.embed_kept(documents, kept, text="text")


@query("embed_kept", _FLAT)
def _(spark, folder):
    return _flat(_second_job(spark, folder)[0])


@query(
    "embed_kept_counts",
    r"""
    SELECT size, total - misses AS hits, misses, total, round((total - misses) / total, 6) AS hit_rate FROM (
      SELECT count(DISTINCT text) FILTER (regexp_matches(text, '[^ \t\r\n]')) AS size,
             count(DISTINCT text) FILTER (text NOT IN (SELECT text FROM documents WHERE lang = 'en'
               AND regexp_matches(text, '[^ \t\r\n]'))) AS misses,
             count(text) AS total FROM documents)
    """,
)
def _(spark, folder):
    return _second_job(spark, folder)[1].withColumn("hit_rate", F.round("hit_rate", 6))


@query(
    "embed_chunks",
    sql(
        """
        SELECT doc_id, CASE WHEN total = 1 THEN doc_id::VARCHAR
                            ELSE doc_id || '_chunk_' || n END AS chunk_id,
               n::INTEGER AS chunk_index, piece AS content,
               regexp_matches(piece, '[^ \\t\\r\\n]') AS embedded
        FROM (SELECT *, count(*) OVER (PARTITION BY doc_id) AS total FROM ch_tiered)
        """,
        "ch_tiered",
    ),
)
def _(spark, folder):
    chunks = embedding.embed_chunks(_texts(spark, folder))
    return chunks.withColumn("embedded", F.col("embedding").isNotNull()).drop("embedding")


@query(
    "filter_embedded",
    sql("SELECT doc_id FROM dv", "dv"),
)
def _(spark, folder):
    embedded = embedding.embed_text(table(spark, folder, "documents"), text="text")
    return embedding.filter_embedded(embedded).select("doc_id")


@query(
    "l2_normalize",
    """
    SELECT vec_id, pos::INTEGER AS pos, round(v / n, 6) AS v FROM (
      SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS pos,
             sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n
      FROM embeddings)
    """,
)
def _(spark, folder):
    unit = l2_normalize(F.col("embedding"))
    rows = table(spark, folder, "embeddings").select("vec_id", F.posexplode(unit).alias("pos", "v"))
    return rows.withColumn("v", F.round("v", 6))


@query(
    "masked_mean_pool",
    """
    SELECT label, pos::INTEGER AS pos, round(sum(v * m) / greatest(sum(m), 1e-9), 6) + 0.0 AS v
    FROM (
      SELECT e.label, unnest(e.embedding)::DOUBLE AS v, generate_subscripts(e.embedding, 1) - 1
             AS pos, coalesce(l.quality, 0) AS m
      FROM embeddings e LEFT JOIN labels l ON l.doc_id = e.vec_id)
    GROUP BY label, pos
    """,
)
def _(spark, folder):
    mask = table(spark, folder, "labels").select(F.col("doc_id").alias("vec_id"), "quality")
    joined = table(spark, folder, "embeddings").join(mask, "vec_id", "left")
    weight = F.coalesce("quality", F.lit(0))
    pooled = joined.groupBy("label").agg(masked_mean(F.col("embedding"), weight).alias("mean"))
    rows = pooled.select("label", F.posexplode("mean").alias("pos", "v"))
    return rows.withColumn("v", F.round("v", 6) + F.lit(0.0))


@query(
    "validate_dimension",
    "SELECT vec_id, len(embedding)::INTEGER AS dim FROM embeddings WHERE len(embedding) <> 32",
)
def _(spark, folder):
    # A store configured for 32 dimensions rejects all of these vectors.
    rejected = embedding.validate_dimension(table(spark, folder, "embeddings"), 32)
    return rejected.select("vec_id", F.size("embedding").alias("dim"))


@query(
    "map_partitions", "SELECT doc_id, length(text) AS chars FROM documents"
)
def _(spark, folder):
    def lengths(frames):
        for frame in frames:
            yield frame.assign(chars=frame["text"].str.len())[["doc_id", "chars"]]

    documents = table(spark, folder, "documents").select("doc_id", "text")
    return embedding.map_partitions(documents, lengths, "doc_id long, chars long")
