"""The queries of this subpackage, with their DuckDB statements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectorloom.llm import (
    chat,
    decontaminate,
    licenses,
    native,
    ordermin,
    packing,
    periods,
    perplexity,
    pivots,
    ranked,
    sharding,
    simhash,
    substrings,
    warc,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, statement: str | None = None) -> Callable:
    def register(function: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = function
        if statement:
            SQL[name] = statement
        return function

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


_NORMAL = (
    "regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)


@query(
    "op2_decontaminate",
    f"""
    WITH items AS (SELECT item_id, {_NORMAL.format("text")} AS w FROM benchmark),
    wins AS (
      SELECT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS win
      FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
            FROM (SELECT *, least(10, len(w)) AS n FROM items WHERE len(w) > 0))),
    docs AS (SELECT doc_id, coalesce({_NORMAL.format("text")}, []) AS w FROM documents),
    places AS (
      SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS win
      FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
            FROM docs, (SELECT DISTINCT n FROM wins) WHERE len(w) >= n)),
    hits AS (SELECT DISTINCT p.doc_id, p.i, p.n, x.item_id FROM places p JOIN wins x USING (n, win)),
    words AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (
      SELECT doc_id, unnest(range(i, i + n)) AS pos FROM hits) GROUP BY doc_id),
    found AS (SELECT doc_id, count(DISTINCT item_id) AS n_items,
                string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS names
              FROM hits GROUP BY doc_id)
    SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
           coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(names, '')) AS items_sha256,
           coalesce(n_hit, 0) > 0 AS contaminated
    FROM docs d LEFT JOIN words USING (doc_id) LEFT JOIN found USING (doc_id)
    """,
)
def op2_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    marked = decontaminate.mark_hits(
        table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "benchmark")
    )
    return marked.select(
        "doc_id",
        F.col("_n_words").alias("n_words"),
        F.size("_hit_words").cast("bigint").alias("n_hit"),
        F.size("_hit_items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("_hit_items")), 256).alias("items_sha256"),
        (F.size("_hit_words") > 0).alias("contaminated"),
    )


@query("op6_simhash")
def op6_simhash(spark: SparkSession, folder: str) -> DataFrame:
    groups = simhash.near_groups(table(spark, folder, "documents"))
    return groups.select(
        F.col("id").alias("doc_id"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


@query("op8_licenses")
def op8_licenses(spark: SparkSession, folder: str) -> DataFrame:
    found = licenses.scan_licenses(table(spark, folder, "documents"))
    best = F.array_max(F.transform("spans", lambda s: s["coverage"]))
    return found.select(
        F.col("id").alias("doc_id"),
        "n_words",
        F.concat_ws(",", F.array_sort(F.array_distinct(F.col("spans.license")))).alias("licenses"),
        F.size("spans").cast("bigint").alias("n_spans"),
        F.coalesce(best, F.lit(0.0)).alias("best_coverage"),
    )


_SPACED = r"coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), [])"


@query(
    "op9_substrings",
    f"""
    WITH docs AS (SELECT doc_id, {_SPACED} AS w FROM documents),
    wins AS (
      SELECT doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) AS h
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM docs WHERE len(w) >= 35)),
    twice AS (SELECT h FROM wins GROUP BY h HAVING count(*) > 1),
    gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS pos FROM wins SEMI JOIN twice USING (h)),
    kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS kept FROM (
      SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM docs)
      ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id),
    lost AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed,
           sha256(coalesce(kept, '')) AS kept_sha256
    FROM docs LEFT JOIN lost USING (doc_id) LEFT JOIN kept USING (doc_id)
    """,
)
def op9_substrings(spark: SparkSession, folder: str) -> DataFrame:
    marked = substrings.mark_repeats(table(spark, folder, "documents").select("doc_id", "text"))
    return marked.select(
        "doc_id",
        F.col("_n_words").alias("n_words"),
        F.col("_n_removed").alias("n_removed"),
        F.sha2("_kept", 256).alias("kept_sha256"),
    )


_SHARD_HASH = "('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT"


@query(
    "op3_sharding",
    f"""
    WITH RECURSIVE r AS (
      SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS bytes, {_SHARD_HASH} AS h FROM documents),
    buckets(depth, prefix, bytes, n) AS (
      SELECT 0, 0::BIGINT, coalesce(sum(bytes), 0)::BIGINT, count(*) FROM r
      UNION ALL
      SELECT depth + 1, r.h >> (47 - depth), sum(r.bytes)::BIGINT, count(*)
      FROM buckets b JOIN r ON r.h >> (48 - depth) = prefix
      WHERE b.bytes > {sharding.SHARD_BYTES} AND depth < 48 GROUP BY ALL)
    SELECT doc_id, r.bytes, CASE WHEN depth = 0 THEN '' ELSE right(lpad(bin(prefix), 64, '0'), depth) END
             || '/0' AS shard, depth AS local_depth, b.bytes AS shard_bytes, n AS shard_rows
    FROM r JOIN buckets b ON r.h >> (48 - depth) = prefix AND b.bytes <= {sharding.SHARD_BYTES}
    """,
)
def op3_sharding(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "text")
    return sharding.assign_shards(documents).select(
        "doc_id", "bytes", "shard", "local_depth", "shard_bytes", "shard_rows"
    )


_CONTROL = "|".join(x.replace("[", r"\[").replace("]", r"\]") for x in chat.CONTROL)


_ANY = r"(?:<<SYS>>|<</SYS>>|\[INST\]|\[/INST\]|<s>|</s>|\[ROLE\]|\[/ROLE\]|\[SEP\])"
_TURN = (
    r"(?s)<<SYS>> .*? <</SYS>>|\[INST\] .*? \[/INST\]|<s> .*? </s>|\[ROLE\] .*? \[/ROLE\]"
)


def _sql_render(role: str, text: str) -> str:
    return (
        f"CASE {role} WHEN 'system' THEN '<<SYS>> ' || {text} || ' <</SYS>>' "
        f"WHEN 'user' THEN '[INST] ' || {text} || ' [/INST]' WHEN 'assistant' THEN '<s> ' || {text} || ' </s>' "
        f"ELSE '[ROLE] ' || {{0}} || ' [SEP] ' || {text} || ' [/ROLE]' END"
    )


def _sql_escape(text: str) -> str:
    return rf"regexp_replace({text}, '(\\*{_ANY})', '\\\1', 'g')"


def _sql_unescape(text: str) -> str:
    return rf"regexp_replace({text}, '\\(\\*{_ANY})', '\1', 'g')"


@query(
    "op10_chat",
    f"""
    WITH source AS (
      SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
      UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
      UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
    turns AS (
      SELECT *, {_sql_render("role", "text").format("role")} AS plain,
             {_sql_render("role", _sql_escape("text")).format(_sql_escape("role"))} AS safe FROM source),
    chats AS (
      SELECT conv_id, count(*) AS n_turns,
             string_agg(plain, '' ORDER BY turn NULLS FIRST, role, text) AS plain,
             string_agg(safe, '' ORDER BY turn NULLS FIRST, role, text) AS safe,
             list(role || chr(10) || text ORDER BY turn NULLS FIRST, role, text) AS said,
             string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS t,
             coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text)
                      FILTER (role = 'assistant'), '') AS loss
      FROM turns GROUP BY conv_id),
    read AS (
      SELECT *, list_transform(regexp_extract_all(plain, '{_TURN}', 0), lambda p: CASE
          WHEN starts_with(p, '<<SYS>> ') THEN 'system' || chr(10) || {_sql_unescape("p[9:-10]")}
          WHEN starts_with(p, '[INST] ') THEN 'user' || chr(10) || {_sql_unescape("p[8:-9]")}
          WHEN starts_with(p, '<s> ') THEN 'assistant' || chr(10) || {_sql_unescape("p[5:-6]")}
          ELSE {_sql_unescape("split_part(p[8:-9], ' [SEP] ', 1)")} || chr(10) || {_sql_unescape(
              "substr(p[8:-9], length(split_part(p[8:-9], ' [SEP] ', 1)) + 8)")} END) AS heard,
             array_to_string(regexp_extract_all(plain, '{_TURN}', 0), '') AS joined
      FROM chats)
    SELECT conv_id, n_turns, sha256(t) AS turns_sha256, length(loss)::BIGINT AS loss_chars,
           sha256(loss) AS loss_sha256,
           length(CASE WHEN heard = said AND joined = plain THEN plain ELSE safe END)::BIGINT AS formatted_chars
    FROM read
    """,
)
def op10_chat(spark: SparkSession, folder: str) -> DataFrame:
    conversations = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    planted = spark.createDataFrame(
        [(-7, 0, "user", said), (-7, 1, "assistant", said)], conversations.schema
    )
    chats = chat.format_chats(conversations.unionByName(planted))
    return chats.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(
            F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""),
            256,
        ).alias("turns_sha256"),
        F.length("loss_text").cast("bigint").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


@query(
    "op5_warc",
    f"""
    WITH p AS (SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS digest FROM pages),
    d AS (
      SELECT page_id, strlen(payload)::BIGINT AS payload_bytes, min(page_id) OVER (PARTITION BY digest) AS first,
             array_to_string(list_transform(range(0, 32), lambda i: substr('{_BASE32}', 1 + ((
               ('0x' || substr(digest, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INTEGER, 1)), '')
               AS payload_digest
      FROM p)
    SELECT page_id, payload_bytes, payload_digest,
           CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN page_id <> first THEN first END AS refers_to
    FROM d
    """,
)
def op5_warc(spark: SparkSession, folder: str) -> DataFrame:
    archives = warc.write_archives(warc.responses(table(spark, folder, "pages")))
    deduplicated = warc.deduplicate(archives)
    return warc.resolve(warc.read_archives(spark, deduplicated, payloads=False)).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


@query(
    "op4_pivots",
    """
    WITH v AS (
      SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS vec
      FROM embeddings
      WHERE embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
    SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
      SELECT q.vec_id AS query_id, c.vec_id,
             list_inner_product(q.vec::DOUBLE[], c.vec::DOUBLE[])::BIGINT AS score,
             row_number() OVER (PARTITION BY q.vec_id ORDER BY
               list_inner_product(q.vec::DOUBLE[], c.vec::DOUBLE[]) DESC, c.vec_id) AS rank
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id)
    WHERE rank <= 5
    """,
)
def op4_pivots(spark: SparkSession, folder: str) -> DataFrame:
    vectors = pivots.quantise(table(spark, folder, "embeddings"), "vec_id", "embedding")
    found = pivots.top_k(vectors, vectors.where("id % 50 = 0"), 5)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


@query("op1_perplexity")
def op1_perplexity(spark: SparkSession, folder: str) -> DataFrame:
    scored = perplexity.classify(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return scored.select(
        "doc_id",
        "lang",
        "n_words",
        F.round("perplexity", 6).alias("perplexity"),
        F.round("threshold", 6).alias("threshold"),
        F.round("toxicity", 6).alias("toxicity"),
        "rejected",
    )


@query("op7_packing")
def op7_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(table(spark, folder, "documents"))


# CRC-32 of the bytes of {0}: every byte is added and followed by eight shifts (-1).
_CRC32 = (
    "xor(list_reduce([4294967295::BIGINT] || list_transform(range(0, 9 * (length(hex(encode({0}))) // 2)), "
    "lambda i: CASE WHEN i % 9 = 0 THEN ('0x' || substr(hex(encode({0})), 1 + 2 * (i // 9), 2))::BIGINT ELSE -1 END), "
    "lambda c, b: CASE WHEN b >= 0 THEN xor(c, b) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END), "
    "4294967295)"
)


_FACTORS = [(ordermin.GOLDEN * (2 * n + 1)) % (1 << 28) | 1 for n in range(3)]


@query(
    "op12_ordermin",
    f"""
    WITH base AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
    following AS (
      SELECT doc_id, text, length(text) // 2 AS half,
             coalesce(lead(text) OVER (ORDER BY doc_id), first_value(text) OVER (ORDER BY doc_id)) AS next_text,
             coalesce(lead(doc_id) OVER (ORDER BY doc_id), first_value(doc_id) OVER (ORDER BY doc_id)) AS next_id
      FROM base),
    edits AS (
      SELECT *, substr(text, 1, length(text) - half) || substr(next_text, 1, half) AS edited FROM following),
    texts AS (SELECT doc_id, 'o' AS kind, text FROM edits UNION ALL SELECT doc_id, 'e', edited FROM edits),
    words AS (SELECT doc_id, kind, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w FROM texts),
    sizes AS (SELECT *, greatest(len(w) - 3, 0) + 1 AS n, length(bin(greatest(len(w) - 3, 0) + 1)) AS b
              FROM words WHERE len(w) > 0),
    checked AS (
      SELECT word, {_CRC32.format("word")} AS c
      FROM (SELECT DISTINCT unnest(w) AS word FROM sizes)),
    flat AS (
      SELECT doc_id, kind, n, b, pos, coalesce(c, 0) AS c0,
             coalesce(lead(c, 1) OVER (PARTITION BY doc_id, kind ORDER BY pos), 0) AS c1,
             coalesce(lead(c, 2) OVER (PARTITION BY doc_id, kind ORDER BY pos), 0) AS c2
      FROM (SELECT doc_id, kind, n, b, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM sizes)
      JOIN checked USING (word)),
    kmers AS (
      SELECT doc_id, kind, n, b, pos,
             (c0 * {_FACTORS[0]} + c1 * {_FACTORS[1]} + c2 * {_FACTORS[2]}) & {(1 << 60) - 1} AS h
      FROM flat WHERE pos <= n),
    numbered AS (
      SELECT *, row_number() OVER (PARTITION BY doc_id, kind, h >> b ORDER BY pos) - 1 AS occ FROM kmers),
    packed AS (
      SELECT *, ((((h + (((occ * {ordermin.GOLDEN}) & {(1 << 30) - 1}) << 30)) & {(1 << 60) - 1}) >> b) << b) | pos AS p
      FROM numbered),
    ranked AS MATERIALIZED (
      SELECT doc_id, kind, pos, h, (p >> 54)::INTEGER AS part,
             row_number() OVER (PARTITION BY doc_id, kind ORDER BY p) - 1 AS r
      FROM packed),
    firsts AS (SELECT doc_id, kind, part, min(r) AS r FROM ranked GROUP BY ALL),
    begins AS (
      SELECT doc_id, kind, n, g.part, coalesce(min(r) OVER (
        PARTITION BY doc_id, kind ORDER BY g.part ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS r
      FROM (SELECT doc_id, kind, n, unnest(range(0, 64)) AS part FROM sizes) g
      LEFT JOIN firsts USING (doc_id, kind, part)),
    members AS MATERIALIZED (
      SELECT doc_id, kind, part, r FROM begins UNION ALL SELECT doc_id, kind, part, (r + 1) % n FROM begins),
    pairs AS (
      SELECT doc_id, kind, m.part AS part, string_agg(h, ',' ORDER BY pos) AS chosen
      FROM members m JOIN ranked USING (doc_id, kind, r) GROUP BY ALL),
    prints AS (
      SELECT doc_id, kind, string_agg(substr(md5(chosen), 1, 4), '' ORDER BY part) AS fp FROM pairs GROUP BY ALL),
    whole AS (
      SELECT e.*, coalesce(o.fp, repeat('0', 256)) AS fingerprint, coalesce(d.fp, repeat('0', 256)) AS edited_fingerprint,
             coalesce(x.fp, repeat('0', 256)) AS next_fingerprint
      FROM edits e LEFT JOIN prints o ON o.doc_id = e.doc_id AND o.kind = 'o'
      LEFT JOIN prints d ON d.doc_id = e.doc_id AND d.kind = 'e'
      LEFT JOIN prints x ON x.doc_id = e.next_id AND x.kind = 'o')
    SELECT doc_id, length(text)::BIGINT AS n_chars, sha256(edited) AS edited_sha256, fingerprint, edited_fingerprint,
           len(list_filter(range(0, 64), lambda j: substr(fingerprint, 4 * j + 1, 4)
             = substr(edited_fingerprint, 4 * j + 1, 4))) / 64 AS near_edited,
           len(list_filter(range(0, 64), lambda j: substr(fingerprint, 4 * j + 1, 4)
             = substr(next_fingerprint, 4 * j + 1, 4))) / 64 AS near_next
    FROM whole
    """,
)
def op12_ordermin(spark: SparkSession, folder: str) -> DataFrame:
    compared = ordermin.edited_fingerprints(table(spark, folder, "documents"))
    return compared.select(
        "doc_id",
        F.length("text").cast("bigint").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        "near_edited",
        "near_next",
    )


def planted_repeats(docs: DataFrame) -> DataFrame:
    """Documents of op13: those whose id has a checksum divisible by ten repeat some of their words."""
    check = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(check / 10)

    def repeated(words):
        n = F.size(words)
        a = (g % n).cast("int")
        p = (F.floor((n - a) / (F.lit(3) + g % 8)) + 1).cast("int")

        def changed(place):
            def word(i):
                return F.get(words, F.when(i < place["a"], i).otherwise(place["a"] + (i - place["a"]) % place["p"]))

            return F.array_join(F.transform(F.sequence(F.lit(0), n - 1), word), " ")

        return F.when(n > 0, native.bound(F.struct(a.alias("a"), p.alias("p")), changed)).otherwise("")

    whole = native.bound(native.spaced_words("text"), repeated)
    text = F.when((check % 10 == 0) & F.col("text").isNotNull(), whole).otherwise(F.col("text"))
    return docs.select("doc_id", text.alias("text"))


@query("op13_periods")
def op13_periods(spark: SparkSession, folder: str) -> DataFrame:
    marked = periods.mark_runs(planted_repeats(table(spark, folder, "documents")))
    line = F.transform(
        "_runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    )
    # The least of these is the longest run, the earliest of such, the one of the smallest period of these.
    ranked = F.transform("_runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p")))
    best = F.array_min(ranked)
    return marked.select("doc_id", F.size("_runs").cast("bigint").alias("n_runs"), best.alias("best"), line.alias("line"), "_collapsed").select(
        "doc_id",
        "n_runs",
        F.col("best.s").alias("start"),
        (-F.col("best.l")).alias("length"),
        F.col("best.p").alias("period"),
        F.floor(-F.col("best.l") * 1000 / F.col("best.p")).cast("bigint").alias("exponent_milli"),
        F.sha2(F.array_join("line", ""), 256).alias("runs_sha256"),
        F.sha2("_collapsed", 256).alias("collapsed_sha256"),
    )


_TERMS = (
    "regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
)


@query(
    "op11_ranked",
    f"""
    WITH docs AS (
      SELECT doc_id, w, len(w) AS n FROM (SELECT doc_id, {_TERMS.format("text")} AS w FROM documents) WHERE len(w) > 0),
    totals AS (SELECT count(*)::BIGINT AS texts, sum(n)::BIGINT AS terms FROM docs),
    asked AS (SELECT DISTINCT item_id, unnest({_TERMS.format("text")}) AS term FROM benchmark),
    found AS (
      SELECT doc_id, n, term, count(*) AS tf
      FROM (SELECT doc_id, n, unnest(w) AS term FROM docs) SEMI JOIN asked USING (term) GROUP BY ALL),
    weights AS (
      SELECT term, floor(1000 * ln((2 * any_value(texts) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS weight
      FROM found, totals GROUP BY term),
    scored AS (
      SELECT item_id, doc_id,
             sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * texts) // terms))))::BIGINT AS score
      FROM asked JOIN found USING (term) JOIN weights USING (term), totals GROUP BY ALL),
    ranked AS (
      SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank
      FROM scored WHERE score > 0)
    SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
    """,
)
def op11_ranked(spark: SparkSession, folder: str) -> DataFrame:
    return ranked.search_items(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
