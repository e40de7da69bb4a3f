"""Benchmark decontamination: find, verify and cut passages of test items in training documents.

Items become windows of ``window`` normalised words (an item of fewer words is one window). Every
task gets the vocabulary and the hash set of the windows; a document position can start a window only
if its words are all in the vocabulary, and a hit in the hash set is verified word by word.

Defined results: a null or wordless text has no hits; an item without words has no windows; an item
whose id is null marks words but is not listed; repeated rows are scanned one by one; extra columns
pass through, but for those named like the three that are added.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectorloom.llm.arrays import NORMAL_WORD, lower_ascii, slices, small_batches
from vectorloom.session import materialise

WINDOW = 10
# Bound of what one pass broadcasts: characters of item texts. More items take further passes.
SLICE_CHARS = 8_000_000


@dataclasses.dataclass
class WindowSet:
    """Windows of some items, by their length: hash -> windows (word ids) and the items they are in."""

    vocabulary: dict[str, int]
    by_length: dict[int, dict[int, list[tuple[tuple[int, ...], list[str]]]]]
    hashes: dict[int, np.ndarray]


def word_list(text: str | None) -> list[str]:
    return NORMAL_WORD.findall(lower_ascii(text)) if text else []


_BASE = 0x9E3779B97F4A7C15


def _window_hashes(ids: np.ndarray, length: int) -> np.ndarray:
    """Hash of every run of ``length`` word ids."""
    count = len(ids) - length + 1
    value = np.zeros(count, np.uint64)
    for offset in range(length):
        value = value * np.uint64(_BASE) + ids[offset : offset + count]
    return value


def window_set(items: list[tuple[str | None, str | None]], window: int) -> WindowSet:
    """Hash set of the windows of items ``(id, text)``."""
    vocabulary: dict[str, int] = {}
    by_length: dict = {}
    for item, text in items:
        words = word_list(text)
        if not words:
            continue
        ids = np.array([vocabulary.setdefault(w, len(vocabulary) + 1) for w in words], np.uint64)
        length = min(window, len(words))
        for start, hashed in enumerate(_window_hashes(ids, length).tolist()):
            key = tuple(ids[start : start + length].tolist())
            same = by_length.setdefault(length, {}).setdefault(hashed, [])
            owners = next((found for known, found in same if known == key), None)
            if owners is None:
                same.append((key, owners := []))
            if item is not None and item not in owners:
                owners.append(item)
    hashes = {n: np.array(sorted(table), np.uint64) for n, table in by_length.items()}
    return WindowSet(vocabulary, by_length, hashes)


def find_hits(words: list[str], windows: WindowSet) -> tuple[set[int], set[str]]:
    """Positions of the words inside occurring windows, and the items of these windows."""
    get = windows.vocabulary.get
    ids = np.fromiter((get(word, 0) for word in words), np.uint64, len(words))
    known = np.concatenate([[0], np.cumsum(ids != 0)])
    positions: set[int] = set()
    items: set[str] = set()
    for length, table in windows.by_length.items():
        if len(ids) < length:
            continue
        starts = np.flatnonzero(known[length:] - known[:-length] == length)
        if not len(starts):
            continue
        hashed = _window_hashes(ids, length)[starts]
        for start, value in zip(starts.tolist(), hashed.tolist(), strict=True):
            key = None
            for candidate, owners in table.get(value, ()):
                key = key or tuple(ids[start : start + length].tolist())
                if candidate == key:
                    positions.update(range(start, start + length))
                    items.update(owners)
    return positions, items


def item_slices(items: DataFrame, id_col: str, text_col: str, limit: int) -> Iterator[list[tuple]]:
    """Items in slices of at most ``limit`` characters (or one item); each is held by the driver alone."""
    size = F.coalesce(F.length(text_col), F.lit(0)) + F.length(F.coalesce(id_col, F.lit("")))
    rows = items.select(
        F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), size.alias("size")
    )
    current: list[tuple] = []
    held = 0
    for row in rows.toLocalIterator():
        if current and held + row["size"] > limit:
            yield current
            current, held = [], 0
        current.append((row["id"], row["text"]))
        held += row["size"]
    yield current


def _scan(docs: DataFrame, windows: WindowSet, text_col: str, cut: bool) -> DataFrame:
    """Add the hits of one slice of windows to those that the rows carry already, and maybe cut all."""
    shared = docs.sparkSession.sparkContext.broadcast(windows)
    schema = docs.schema
    arrow_hits = pa.list_(pa.int32())

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in slices(batches):
            counts, hits, items, texts = [], [], [], []
            for text, old_hits, old_items in zip(
                batch.column(text_col).to_pylist(),
                batch.column("_hit_words").to_pylist(),
                batch.column("_hit_items").to_pylist(),
                strict=True,
            ):
                words = word_list(text)
                found, names = find_hits(words, known)
                counts.append(len(words))
                found.update(old_hits)
                hits.append(sorted(found))
                texts.append(cut_words(text, found) if cut and found else text)
                items.append(sorted(names.union(old_items)))
            columns = dict(zip(batch.schema.names, batch.columns, strict=True))
            columns[text_col] = pa.array(texts, pa.string())
            columns["_n_words"] = pa.array(counts, pa.int64())
            columns["_hit_words"] = pa.array(hits, arrow_hits)
            columns["_hit_items"] = pa.array(items, pa.list_(pa.string()))
            yield pa.RecordBatch.from_pydict(columns)

    return docs.mapInArrow(scan, schema)


def mark_hits(
    docs: DataFrame,
    items: DataFrame,
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    slice_chars: int = SLICE_CHARS,
    cut: bool = False,
) -> DataFrame:
    """``docs`` with ``_n_words``, ``_hit_words`` (positions of hit words) and ``_hit_items``.

    With ``cut`` the hit words (and the text up to the next kept word) are removed from the texts; a
    document left without words stays, with an empty text. One pass broadcasts items of at most
    ``slice_chars`` characters. More items take one pass after another over the marked table, so nothing
    that is broadcast grows with the benchmark.
    """
    small_batches(docs.sparkSession)
    marked = docs.withColumns(
        {
            "_n_words": F.lit(None).cast("bigint"),
            "_hit_words": F.array().cast("array<int>"),
            "_hit_items": F.array().cast("array<string>"),
        }
    )
    before: list[tuple] | None = None
    for part in item_slices(items, item_id, item_text, slice_chars):
        if before is not None:
            marked = materialise(_scan(marked, window_set(before, window), text_col, False), "decontaminate")
        before = part
    return _scan(marked, window_set(before or [], window), text_col, cut)


def drop_contaminated(marked: DataFrame, share: float) -> DataFrame:
    """Documents of which less than ``share`` of the words is hit."""
    return marked.where((F.size("_hit_words") == 0) | (F.size("_hit_words") < F.col("_n_words") * share))


def cut_words(text: str, hits: set[int]) -> str:
    """``text`` without the words at the given positions."""
    spans = [match.span() for match in NORMAL_WORD.finditer(lower_ascii(text))]
    pieces, position = [], 0
    for number, (start, _) in enumerate(spans):
        if number in hits:
            pieces.append(text[position:start])
            position = spans[number + 1][0] if number + 1 < len(spans) else len(text)
    return "".join(pieces) + text[position:]
