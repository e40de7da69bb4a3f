"""Cutting texts into overlapping chunks.

A cut depends on where the previous one fell, so one text is a sequential scan; the work is
parallel over documents. Only the text column crosses to Python (in Arrow batches), the document
columns stay in the JVM and are joined to the chunks by ``posexplode``.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import islice

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vectorloom import settings
from vectorloom.functions.text import is_blank
from vectorloom.session import materialise, small_batches
from vectorloom.sources.byte_streams import file_bytes, read_pieces

# Break characters, strongest first, with the distance each may be searched.
SENTENCE_BREAKS = "。！？\n"
CLAUSE_BREAKS = "，、；："
WORD_BREAKS = " "
SENTENCE_REACH, CLAUSE_REACH, WORD_REACH = 100, 50, 20
LOOKAHEAD_REACH = 100

_BACKWARD_RULES = {
    "tiered": (
        (SENTENCE_BREAKS, SENTENCE_REACH),
        (CLAUSE_BREAKS, CLAUSE_REACH),
        (WORD_BREAKS, WORD_REACH),
    ),
    "sentence": ((SENTENCE_BREAKS, SENTENCE_REACH),),
}
MODES = (*_BACKWARD_RULES, "lookahead", "nested")


def _last_break(text: str, chars: str, low: int, high: int) -> int:
    """Cut position right after the last of ``chars`` in text[low:high], 0 when there is none."""
    return max(text.rfind(char, low, high) for char in chars) + 1


def _backward_chunks(text: str, rules, size: int, overlap: int) -> Iterator[str]:
    """Cut near ``size``, preferring the closest break before it."""
    if len(text) <= size:
        if text:
            yield text
        return
    start, last_kept = 0, -1
    while start < len(text):
        cut = start + size
        if cut >= len(text):
            cut = len(text)
        else:
            reached = (
                _last_break(text, chars, max(cut - reach, 0) + 1, cut + 1) for chars, reach in rules
            )
            cut = next((position for position in reached if position), cut)
        piece = text[start:cut].strip()
        if piece:
            last_kept = len(piece)
            yield piece
        resume = cut if cut == len(text) else cut - overlap
        # The overlap starts only once the scan is past the length of the chunk just kept.
        start = cut if resume <= last_kept else resume


def _lookahead_chunks(pieces: Iterable[str], size: int, overlap: int) -> Iterator[str]:
    """Cut at the last break within reach on either side of ``size``.

    The text may come in pieces: a cut needs no more than ``size`` and the reach ahead, so that much is kept
    and what lies before the next start is forgotten.
    """
    pieces, text, start, ended = iter(pieces), "", 0, False
    while True:
        while not ended and len(text) - start <= size + LOOKAHEAD_REACH + 1:
            more = next(pieces, None)
            ended = more is None
            text, start = (text, start) if ended else (text[start:] + more, 0)
        rest = len(text) - start
        if rest < size:
            break
        if rest == size:
            yield text[start:]
            return
        window = start + max(size - LOOKAHEAD_REACH, 0) + 1, start + size + LOOKAHEAD_REACH + 1
        found = (
            _last_break(text, chars, *window)
            for chars in (SENTENCE_BREAKS, CLAUSE_BREAKS, WORD_BREAKS)
        )
        cut = next((position for position in found if position), start + size)
        yield text[start:cut].strip()
        if cut >= len(text):
            return
        start = cut - overlap
    yield text[start:].strip()


def _nested_chunks(pieces: Iterable[str], size: int, overlap: int) -> Iterator[str]:
    """Lookahead chunks, each cut again by the tiered rule."""
    for piece in _lookahead_chunks(pieces, size, overlap):
        if piece.strip():
            yield from _backward_chunks(piece, _BACKWARD_RULES["tiered"], size, overlap)


def split_text(text: str | None, mode: str, size: int, overlap: int) -> list[str]:
    """All chunks of one text."""
    if not text:
        return []
    if mode in _BACKWARD_RULES:
        return list(_backward_chunks(text, _BACKWARD_RULES[mode], size, overlap))
    if mode == "nested":
        return list(_nested_chunks([text], size, overlap))
    return [piece for piece in _lookahead_chunks([text], size, overlap) if piece.strip()]


def _check(mode: str, size: int, overlap: int) -> None:
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    if overlap < 0 or size <= overlap + LOOKAHEAD_REACH:
        raise ValueError("chunk size must exceed overlap + 100, or the scan may not advance")


def run_once(function):
    """Keep Spark from copying a Python function into filters it derives from the result.

    A filter or generator on the result of a deterministic function makes the optimizer evaluate
    the function a second time to drop rows early; these functions are too costly for that.
    """
    return function.asNondeterministic()


def chunk_array(
    text: Column,
    mode: str = "tiered",
    size: int = settings.CHUNK_MAX_SIZE,
    overlap: int = settings.CHUNK_OVERLAP,
) -> Column:
    """Array of the chunks of a text column."""
    _check(mode, size, overlap)

    @F.pandas_udf("array<string>")
    def split(texts: pd.Series) -> pd.Series:
        return texts.map(lambda text: split_text(text, mode, size, overlap))

    return run_once(split)(text)


def _explode_chunks(df: DataFrame, chunks: Column, text: str, doc_id: str) -> DataFrame:
    small_batches(df.sparkSession)
    carried = [column for column in df.columns if column != text]
    split = df.select(*carried, chunks.alias("_chunks"))
    exploded = split.select(*carried, F.posexplode("_chunks").alias("_pos", text))
    return exploded.select(
        *carried,
        F.concat(F.col(doc_id).cast("string"), F.lit("_chunk_"), F.col("_pos") + 1).alias("chunk_id"),
        (F.col("_pos") + 1).alias("chunk_index"),
        text,
    )


def chunk_documents(
    df: DataFrame,
    mode: str = "tiered",
    text: str = "content",
    doc_id: str = "doc_id",
    size: int = settings.CHUNK_MAX_SIZE,
    overlap: int = settings.CHUNK_OVERLAP,
) -> DataFrame:
    """One row per chunk: the document columns, ``chunk_id``, ``chunk_index`` from 1, the chunk."""
    return _explode_chunks(df, chunk_array(F.col(text), mode, size, overlap), text, doc_id)


def chunk_nested(df: DataFrame, **kwargs) -> DataFrame:
    """Lookahead chunks, each cut again by the tiered rule, numbered through."""
    return chunk_documents(df, mode="nested", **kwargs)


def chunk_by_size(
    df: DataFrame,
    length: str = "length",
    cap: int = settings.LARGE_TEXT_BYTES,
    text: str = "content",
    doc_id: str = "doc_id",
    size: int = settings.CHUNK_MAX_SIZE,
    overlap: int = settings.CHUNK_OVERLAP,
) -> DataFrame:
    """Tiered chunks for files up to ``cap`` bytes, nested ones for larger files."""
    _check("tiered", size, overlap)

    @F.pandas_udf("array<string>")
    def split(texts: pd.Series, small: pd.Series) -> pd.Series:
        modes = small.map({True: "tiered", False: "nested"})
        pairs = zip(texts, modes, strict=True)
        return pd.Series([split_text(text, mode, size, overlap) for text, mode in pairs])

    chunks = run_once(split)(F.col(text), F.coalesce(F.col(length) <= cap, F.lit(True)))
    return _explode_chunks(df, chunks, text, doc_id)


CHUNKS_A_BATCH = 1_000


def _file_chunks(path: str, large: bool, size: int, overlap: int) -> Iterator[str]:
    if large:
        return _nested_chunks(read_pieces(path), size, overlap)
    return _backward_chunks("".join(read_pieces(path)), _BACKWARD_RULES["tiered"], size, overlap)


# Files that a task reads: their bytes, and tasks for each core if there are enough files.
TASK_BYTES = 64 * 1024 * 1024
TASKS_A_CORE = 4


def _dealt_files(files: DataFrame, length: str) -> DataFrame:
    """``files``, listed once and dealt to tasks by number and bytes.

    Spark's file scan counts each file as 4 MB at least, so a folder of small files is a task for every few of them.
    """
    listed = materialise(files, "files")
    count, size = listed.agg(F.count("*"), F.sum(F.col(length).cast("long"))).first()
    tasks = max(TASKS_A_CORE * files.sparkSession.sparkContext.defaultParallelism, (size or 0) // TASK_BYTES)
    return listed.repartition(max(1, min(count, tasks)))


def chunk_files(
    files: DataFrame,
    path: str = "path",
    length: str = "length",
    doc_id: str = "doc_id",
    cap: int = settings.LARGE_TEXT_BYTES,
    text: str = "content",
    size: int = settings.CHUNK_MAX_SIZE,
    overlap: int = settings.CHUNK_OVERLAP,
) -> DataFrame:
    """The chunks of ``chunk_by_size`` for files of any size, without a row that holds a whole file.

    ``files`` has a row per file, as ``scan_knowledge_files`` gives it, and its columns are carried to the chunks.
    Files up to ``cap`` bytes are read at once, larger ones piece by piece: a task holds a piece, what
    the last cut left over, and one batch of chunks. A lost task reads its file again. A null ``length`` is looked
    up; a row without a path has no chunks; a file that cannot be read fails the job.
    """
    _check("tiered", size, overlap)
    carried = [column for column in files.columns if column != text]
    inner = "_carried"
    schema = T.StructType(
        [
            T.StructField(inner, files.select(*carried).schema),
            T.StructField("chunk_index", T.IntegerType()),
            T.StructField(text, T.StringType()),
        ]
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch.column("_path").to_pylist(), batch.column("_length").to_pylist(), strict=True)
            for row, (place, known) in enumerate(rows):
                if place is None:
                    continue
                large = (file_bytes(place) if known is None else known) > cap
                chunks, done = _file_chunks(place, large, size, overlap), 0
                while found := list(islice(chunks, CHUNKS_A_BATCH)):
                    same = batch.column(inner).take(pa.array([row] * len(found), pa.int64()))
                    numbers = pa.array(range(done + 1, done + len(found) + 1), pa.int32())
                    yield pa.RecordBatch.from_arrays(
                        [same, numbers, pa.array(found, pa.string())], names=[inner, "chunk_index", text]
                    )
                    done += len(found)

    packed = _dealt_files(files, length).select(
        F.struct(*carried).alias(inner), F.col(path).alias("_path"), F.col(length).cast("long").alias("_length")
    )
    number = F.col("chunk_index")
    return packed.mapInArrow(cut, schema).select(
        f"{inner}.*",
        F.concat(F.col(f"{inner}.{doc_id}").cast("string"), F.lit("_chunk_"), number).alias("chunk_id"),
        number,
        text,
    )


def chunk_with_metadata(df: DataFrame, **kwargs) -> DataFrame:
    """Chunks of a vector-input table with exactly the chunk columns."""
    return chunk_documents(df, **kwargs).select(
        "chunk_id", "doc_id", "doc_title", "doc_path", "doc_summary", "content", "chunk_index"
    )


def filter_blank_text(df: DataFrame, text: str = "content") -> DataFrame:
    return df.where(~is_blank(F.col(text)))
