"""Runs: stretches of words that repeat with a period, four times or more.

A run is a maximal stretch of consecutive words whose smallest period is ``q`` and whose length is at least
``max(6, 4 * q)``. Periods below eight are found by scanning lags directly: words that equal the one ``q``
places on form stretches.

Longer periods are found by minimizers on one scale for each power of two: with ``w <= q < 2 * w`` the hashes
of the ``2 * w`` words from every place on are taken, and every place that has the smallest hash of a window
of ``w`` places is a minimizer. Inside a run the windows repeat at distance ``q``, so their minimizers do, and as ``2 *
w > q`` no place between the two has the same words: two minimizers that follow each other among those of
equal hash are exactly one period apart. A run has ``2 * q + 1`` such places or more, so it holds a window
together with its repetition, and each run is met on the scale of its period. Pairs of equal minimizers at a
distance of ``w`` to ``2 * w`` are seeds; a seed is extended to both sides by comparing words, and a stretch
already covered is not extended again. Stretches that have a smaller period too are left to that one.

All comparisons are of words; hashes only choose seeds. Texts are scanned where they are read, several short
ones at a time as one sequence with marks between them; nothing is shuffled.

Defined results: a null or wordless text has no runs and an empty collapsed text; runs that share words are all
reported; repeated rows are scanned one by one; a text is held by one task, whatever its length; extra columns
pass through, but for those named like the three that are added.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from vectorloom.llm.arrays import SPACED_WORD, slices, small_batches

LEAST_LENGTH = 6
LEAST_PERIODS = 4
# Periods up to this one are scanned directly; the first scale is the next power of two.
DIRECT_PERIODS = 7
# Words of short texts that are scanned at a time.
SCAN_WORDS = 50_000

RUN = T.ArrayType(
    T.StructType([T.StructField(name, T.LongType()) for name in ("start", "length", "period")])
)
_RUN_TYPE = pa.list_(pa.struct([(name, pa.int64()) for name in ("start", "length", "period")]))


def _mixed(values: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of the unsigned value."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def _least(period: int) -> int:
    return max(LEAST_LENGTH, LEAST_PERIODS * period)


def _has_smaller_period(root: np.ndarray) -> bool:
    """Whether the words of one period are themselves a repetition."""
    size, factor, rest = len(root), 2, len(root)
    while rest > 1:
        if rest % factor and factor * factor <= rest:
            factor += 1
            continue
        factor = factor if rest % factor == 0 else rest
        shorter = size // factor
        if np.array_equal(root[shorter:], root[: size - shorter]):
            return True
        while rest % factor == 0:
            rest //= factor
    return False


def _short_periods(ids: np.ndarray, longest: int) -> Iterator[tuple[int, int, int]]:
    for period in range(1, min(DIRECT_PERIODS, longest // LEAST_PERIODS) + 1):
        same = np.zeros(len(ids) - period + 2, np.int8)
        same[1:-1] = ids[period:] == ids[:-period]
        edges = np.flatnonzero(np.diff(same))
        starts, stops = edges[::2], edges[1::2]
        for start, stop in zip(starts.tolist(), stops.tolist(), strict=True):
            if stop - start + period >= _least(period):
                yield start, stop - start + period, period


def _extend(ids: np.ndarray, place: int, period: int) -> tuple[int, int]:
    """The stretch around ``place`` in which words equal those one period on: first place, first not."""
    first, step = place, 64
    while first > 0:
        low = max(0, first - step)
        unequal = np.flatnonzero(ids[low:first] != ids[low + period : first + period])
        if len(unequal):
            first = low + int(unequal[-1]) + 1
            break
        first, step = low, step * 2
    stop, end, step = place, len(ids) - period, 64
    while stop < end:
        high = min(end, stop + step)
        unequal = np.flatnonzero(ids[stop:high] != ids[stop + period : high + period])
        if len(unequal):
            return first, stop + int(unequal[0])
        stop, step = high, step * 2
    return first, stop


def _seeds(hashes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and distances of minimizers that follow each other among those of equal hash."""
    smallest, width = hashes, 1
    while width < window:
        smallest = np.minimum(smallest[:-width], smallest[width:])
        width *= 2
    # A place is a minimizer if its hash is the smallest of some window, so the largest of these minima.
    pad = np.zeros(window - 1, np.uint64)
    largest, width = np.concatenate([pad, smallest, pad]), 1
    while width < window:
        largest = np.maximum(largest[:-width], largest[width:])
        width *= 2
    places = np.flatnonzero(largest == hashes)
    places = places[np.argsort(hashes[places], kind="stable")]
    away = np.diff(places)
    paired = (hashes[places[1:]] == hashes[places[:-1]]) & (away >= window) & (away < 2 * window)
    return places[:-1][paired], away[paired]


def _long_periods(ids: np.ndarray, longest: int) -> Iterator[tuple[int, int, int]]:
    window = DIRECT_PERIODS + 1
    hashes, words = _mixed(ids.astype(np.uint64)), 1
    while LEAST_PERIODS * window <= longest:
        while words < 2 * window:
            hashes = _mixed(hashes[:-words] * np.uint64(0x9E3779B97F4A7C15) + hashes[words:])
            words *= 2
        places, periods = _seeds(hashes, window)
        order = np.lexsort((places, periods))
        places, periods = places[order], periods[order]
        cuts = np.flatnonzero(np.diff(periods)) + 1
        for seeds, same in zip(np.split(places, cuts), np.split(periods, cuts), strict=True):
            if not len(seeds):
                continue
            period, at = int(same[0]), 0
            while at < len(seeds):
                first, stop = _extend(ids, int(seeds[at]), period)
                length = stop - first + period
                if length >= _least(period) and not _has_smaller_period(ids[first : first + period]):
                    yield first, length, period
                at = max(at + 1, int(np.searchsorted(seeds, stop)))
        window *= 2


def runs_of(ids: np.ndarray, longest: int | None = None) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of all runs of a sequence of word numbers, by start and period.

    ``longest`` bounds the length of a run from above.
    """
    longest = len(ids) if longest is None else longest
    if longest < LEAST_LENGTH:
        return []
    short = [r for r in _short_periods(ids, longest) if not _has_smaller_period(ids[r[0] : r[0] + r[2]])]
    return sorted([*short, *_long_periods(ids, longest)], key=lambda run: (run[0], run[2]))


def _scan(texts: list[list[str]]) -> Iterator[tuple[list[dict], str]]:
    """Runs and collapsed text of every list of words."""
    numbers: dict[str, int] = {}
    sizes = np.array([len(words) for words in texts], np.int64)
    # One mark behind each text, unlike every word and every other mark.
    ids = np.full(int(sizes.sum()) + len(texts), -1, np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes + 1)])
    for number, words in enumerate(texts):
        begin = starts[number]
        ids[begin : begin + len(words)] = [numbers.setdefault(word, len(numbers)) for word in words]
    marks = starts[1:] - 1
    ids[marks] = len(numbers) + np.arange(len(texts))
    found = runs_of(ids, int(sizes.max(initial=0)))
    owners = np.searchsorted(starts, [run[0] for run in found], side="right") - 1
    by_text: dict[int, list[tuple[int, int, int]]] = {}
    for owner, (start, length, period) in zip(owners.tolist(), found, strict=True):
        by_text.setdefault(owner, []).append((start - int(starts[owner]), length, period))
    for number, words in enumerate(texts):
        runs = by_text.get(number, [])
        if not runs:
            yield [], " ".join(words)
            continue
        change = np.zeros(len(words) + 1, np.int64)
        for start, length, period in runs:
            change[start + period] += 1
            change[start + length] -= 1
        kept = np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()
        named = [{"start": s, "length": length, "period": p} for s, length, p in runs]
        yield named, " ".join([words[i] for i in kept])


def mark_runs(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``_n_words``, ``_runs`` (start, length, period; by start and period) and ``_collapsed``.

    The collapsed text holds, joined by one space, the words that no run contains after its first period.
    """
    small_batches(docs.sparkSession)
    added = ("_n_words", "_runs", "_collapsed")
    kept = [column for column in docs.columns if column not in added]
    schema = T.StructType([field for field in docs.schema if field.name in kept])
    schema = schema.add("_n_words", T.LongType()).add("_runs", RUN).add("_collapsed", T.StringType())

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            counts, runs, collapsed, waiting, held = [], [], [], [], 0
            column = batch.column(text_col)
            for row in range(batch.num_rows):
                words = SPACED_WORD.findall(column[row].as_py() or "")
                counts.append(len(words))
                waiting.append(words)
                held += len(words)
                if held >= SCAN_WORDS or row + 1 == batch.num_rows:
                    for found, text in _scan(waiting):
                        runs.append(found)
                        collapsed.append(text)
                    waiting, held = [], 0
            columns = {name: batch.column(name) for name in kept}
            columns["_n_words"] = pa.array(counts, pa.int64())
            columns["_runs"] = pa.array(runs, _RUN_TYPE)
            columns["_collapsed"] = pa.array(collapsed, pa.string())
            yield pa.RecordBatch.from_pydict(columns)

    return docs.select(*kept).mapInArrow(scan, schema)
