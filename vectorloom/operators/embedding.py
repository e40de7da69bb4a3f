"""Turning texts into vectors with a pluggable encoder."""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from typing import Protocol
from urllib.parse import quote

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vectorloom import settings
from vectorloom.functions.vectors import l2_normalize
from vectorloom.operators.chunking import chunk_array, run_once
from vectorloom.session import lookup_table, materialise, small_batches


class Encoder(Protocol):
    """Encodes a batch of texts; a text that cannot be encoded gives ``None``."""

    def encode(self, texts: list[str]) -> list[np.ndarray | None]: ...


# Tokens are separated by blanks, tabs and line ends.
TOKEN_SEPARATOR = r"[ \t\r\n]+"
TOKEN = r"[^ \t\r\n]+"


class _TokenBuckets(dict):
    """Bucket of a token: the first 32 bits of its MD5 modulo ``dim``; remembers a bounded number of short ones.

    Where texts have no blanks, a token is a line of any length.
    """

    LIMIT, CHARS = 100_000, 32

    def __init__(self, dim: int):
        super().__init__()
        self.dim = dim

    def __missing__(self, token: str) -> int:
        digest = hashlib.md5(token.encode("utf-8"), usedforsecurity=False).digest()
        bucket = int.from_bytes(digest[:4], "big") % self.dim
        if len(self) < self.LIMIT and len(token) <= self.CHARS:
            self[token] = bucket
        return bucket


class HashEncoder:
    """Offline stand-in for a model: hashed token counts on the unit sphere."""

    def __init__(self, dim: int = 64):
        self.dim = dim
        self._tokens = re.compile(TOKEN).findall
        self._buckets = _TokenBuckets(dim)

    def encode(self, texts: list[str]) -> list[np.ndarray | None]:
        vectors: list[np.ndarray | None] = []
        for text in texts:
            tokens = self._tokens(text)
            hits = np.fromiter(map(self._buckets.__getitem__, tokens), np.int64, len(tokens))
            counts = np.bincount(hits, minlength=self.dim).astype(np.float64)
            norm = np.sqrt((counts * counts).sum())
            vectors.append(counts / norm if norm else None)
        return vectors


def embed_text(
    df: DataFrame,
    encoder: Callable[[], Encoder] = HashEncoder,
    text: str = "content",
    out: str = "embedding",
) -> DataFrame:
    """Add the vector of a text column; null where the text is null or the encoder refuses it.

    ``encoder`` is a factory: the model is built once per Python worker and then sees Arrow
    batches (``spark.sql.execution.arrow.maxRecordsPerBatch`` texts each, 1,000 and 8 MB at most). Filter rows before
    this step: nothing is pushed below it.
    """
    small_batches(df.sparkSession)

    @F.pandas_udf("array<float>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = encoder()
        for texts in batches:
            known = texts.notna()
            vectors = np.full(len(texts), None, dtype=object)
            encoded = model.encode(texts[known].tolist())
            for slot, vector in zip(np.flatnonzero(known.to_numpy()), encoded, strict=True):
                vectors[slot] = None if vector is None else np.asarray(vector, dtype=np.float32)
            yield pd.Series(vectors)

    return df.withColumn(out, run_once(encode)(F.col(text)))


def embed_distinct(
    df: DataFrame,
    encoder: Callable[[], Encoder] = HashEncoder,
    text: str = "content",
    out: str = "embedding",
) -> DataFrame:
    """Encode every distinct text once and give the vector to all its copies.

    Copies are folded map-side, by hash, before distinct texts are shuffled; the vectors come back
    on a 32-byte digest. They are written to the shared folder at once: neither several uses of the
    result nor a lost executor run the encoder again. While the vectors are small enough for Spark
    to broadcast them, the rows stay where they are; beyond that the rows are shuffled once, with
    all their columns, and the adaptive skew join can split a text that has very many copies. Rows
    without a text get keys of their own that match nothing, so they do not meet in one task.
    """
    distinct = df.where(F.col(text).isNotNull()).select(F.col(text).alias("_text")).distinct()
    encoded = embed_text(distinct.withColumn("_digest", _digest("_text")), encoder, "_text", out)
    return _with_vectors(df, lookup_table(encoded.select("_digest", out)), text)


def _digest(text: str) -> Column:
    return F.unhex(F.sha2(F.col(text), 256))


def _with_vectors(df: DataFrame, vectors: DataFrame, text: str) -> DataFrame:
    """Rows with the vector of their text, from a table that has one row per digest."""
    no_text = F.unhex(F.hex(F.monotonically_increasing_id()))
    keyed = df.withColumn("_digest", F.coalesce(_digest(text), no_text))
    return keyed.join(vectors, "_digest", "left").drop("_digest")


@dataclass(frozen=True)
class VectorTable:
    """Vectors kept between jobs, by the digest of their text: ``folder/model=<m>/batch=<b>/*.parquet``.

    ``model`` names the encoder and its version; vectors of other models are not looked at. Every job adds a
    batch. Two jobs at once may add the same text: they add the same vector, and readers take one. Nothing is ever
    thrown out; the owner may remove a model's folder, or batches of it, while no job runs.
    """

    folder: str
    model: str

    @property
    def path(self) -> str:
        return f"{self.folder.rstrip('/')}/model={quote(self.model, safe='')}"

    def read(self, spark: SparkSession) -> DataFrame:
        """``(digest, vector)``, a digest possibly more than once."""
        schema = "digest binary, vector array<float>"
        try:
            return spark.read.schema(schema).parquet(self.path).select("digest", "vector")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return spark.createDataFrame([], schema)

    def add(self, vectors: DataFrame) -> DataFrame:
        """Write a batch and read it back."""
        place = f"{self.path}/batch={uuid.uuid4().hex}"
        vectors.write.parquet(place)
        return vectors.sparkSession.read.schema(vectors.schema).parquet(place)


def embed_kept(
    df: DataFrame,
    kept: VectorTable,
    encoder: Callable[[], Encoder] = HashEncoder,
    text: str = "content",
    out: str = "embedding",
) -> tuple[DataFrame, DataFrame]:
    """``embed_distinct`` that encodes only texts without a kept vector, and keeps the new ones.

    Returns the rows with their vectors and one row of counts: ``total`` texts, ``misses`` (distinct texts that went
    to the encoder), ``hits`` (all others), ``hit_rate``, and ``size``, the distinct texts kept when it is read.

    Digests (32 bytes, folded before the shuffle) decide what is new; texts are shuffled only if they
    are. A kept table that is larger than the job is scanned, with the job's digests on the build side. Both lists of
    digests are written, so a retry cannot change which texts are new. Texts that the encoder refuses are not
    kept, the next job tries them again. Rows without a text get no vector and are not counted.
    """
    spark = df.sparkSession
    known_text = df.where(F.col(text).isNotNull())
    asked = lookup_table(known_text.groupBy(_digest(text).alias("digest")).agg(F.count("*").alias("copies")))
    found = kept.read(spark).join(asked.select("digest"), "digest", "left_semi")
    found = lookup_table(found.groupBy("digest").agg(F.any_value("vector").alias("vector")))
    new = lookup_table(asked.select("digest").join(found.select("digest"), "digest", "left_anti"))

    texts = known_text.select(_digest(text).alias("digest"), F.col(text).alias("_text"))
    texts = texts.join(new, "digest", "left_semi").distinct()
    encoded = embed_text(texts, encoder, "_text", "vector").select("digest", "vector")
    added = kept.add(filter_embedded(encoded, "vector"))

    vectors = found.unionByName(added).select(F.col("digest").alias("_digest"), F.col("vector").alias(out))
    counted = {
        "total": asked.select("copies"),
        "misses": new.select(F.lit(1)),
        "size": kept.read(spark).select("digest").distinct().select(F.lit(1)),
    }
    parts = [rows.toDF("n").select(F.lit(name).alias("what"), "n") for name, rows in counted.items()]
    total, misses, size = (
        F.coalesce(F.sum(F.when(F.col("what") == name, F.col("n"))), F.lit(0)).alias(name) for name in counted
    )
    hits = F.col("total") - F.col("misses")
    report = reduce(DataFrame.union, parts).agg(total, misses, size).select(
        "size",
        hits.alias("hits"),
        "misses",
        "total",
        F.when(F.col("total") > 0, hits / F.col("total")).otherwise(0.0).alias("hit_rate"),
    )
    return _with_vectors(df, vectors, text), report


def hash_encode(df: DataFrame, key: str, text: str = "content", dim: int = 64) -> DataFrame:
    """The hash encoder without Python and without a shuffle: ``(key, embedding)`` per text with a token.

    A text is folded inside its row, in time linear to its tokens (but for the sort): its buckets
    are sorted together with one mark per bucket, and the distance between the places of
    neighbouring marks is the count. Every row gives its own vector, also rows that share a key.
    """
    tokens = F.filter(F.split(F.col(text), TOKEN_SEPARATOR), lambda token: token != "")

    def bucket(token: Column) -> Column:
        word = F.conv(F.substring(F.md5(token), 1, 8), 16, 10).cast("long")
        return F.pmod(word, F.lit(dim)).cast("int")

    marked = F.sort_array(
        F.concat(F.transform(tokens, bucket), F.sequence(F.lit(0), F.lit(dim)).cast("array<int>"))
    )

    def counts(sorted_buckets: Column) -> Column:
        places = F.filter(
            F.sequence(F.lit(0), F.size(sorted_buckets) - 1),
            lambda i: (i == 0) | (F.get(sorted_buckets, i) != F.get(sorted_buckets, i - 1)),
        )
        return _once(places, lambda p: F.transform(
            F.sequence(F.lit(0), F.lit(dim - 1)),
            lambda i: (F.get(p, i + 1) - F.get(p, i) - 1).cast("double"),
        ))

    vector = _once(_once(marked, counts), l2_normalize).cast("array<float>")
    spoken = F.col(text).rlike(TOKEN)
    # Always true, but not a deterministic expression: as in ``run_once``, filters on the result
    # cannot be moved below it, where they would build the vector again.
    once = F.monotonically_increasing_id() >= 0
    return df.where(spoken).select(key, F.when(once, vector).alias("embedding"))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value built once per row, not once per place it is named."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def chunks_to_embed(
    df: DataFrame,
    mode: str = "tiered",
    size: int = settings.CHUNK_MAX_SIZE,
    overlap: int = settings.CHUNK_OVERLAP,
) -> DataFrame:
    """Chunk rows of a vector-input table, with the ids they are stored under.

    A document with one chunk keeps its own id as chunk id, others get numbered chunk ids. The
    number of chunks is read off the array before it is exploded, so no window is needed.
    """
    carried = [column for column in df.columns if column != "content"]
    small_batches(df.sparkSession)
    chunked = df.withColumn("_chunks", chunk_array(F.col("content"), mode, size, overlap))
    rows = chunked.select(
        *carried, F.size("_chunks").alias("_n"), F.posexplode("_chunks").alias("_pos", "content")
    )
    doc_id = F.col("doc_id").cast("string")
    numbered = F.concat(doc_id, F.lit("_chunk_"), F.col("_pos") + 1)
    return rows.select(
        *carried,
        F.when(F.col("_n") == 1, doc_id).otherwise(numbered).alias("chunk_id"),
        (F.col("_pos") + 1).alias("chunk_index"),
        "content",
    )


def embed_chunks(
    df: DataFrame,
    encoder: Callable[[], Encoder] = HashEncoder,
    **cutting,
) -> DataFrame:
    """Chunk the ``content`` of a vector-input table and embed every distinct chunk once.

    The chunks are written to the shared folder first: they are cut once though both sides of the
    vector join read them.
    """
    return embed_distinct(materialise(chunks_to_embed(df, **cutting), "chunks"), encoder)


def filter_embedded(df: DataFrame, column: str = "embedding") -> DataFrame:
    return df.where(F.col(column).isNotNull())


def validate_dimension(df: DataFrame, dim: int, column: str = "embedding") -> DataFrame:
    """Rows whose vector does not have the configured width."""
    return df.where(F.size(column) != dim)


def map_partitions(df: DataFrame, fn, schema) -> DataFrame:
    """Apply a function over iterators of pandas frames, in parallel over partitions."""
    return df.mapInPandas(fn, schema)
