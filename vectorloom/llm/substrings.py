"""Removal of long repeated passages by compaction of a De Bruijn graph of words.

The edges of the graph are the windows of ``window`` consecutive words. An edge is repeated if its word
sequence starts at two places or more, in one document or in several.

1. Documents are dealt to chunks of bounded size. A chunk sends its distinct edges, with how often each
   occurs in it, to shards by ranges of the edge's hash, as sorted and compressed arrays.
2. A shard holds one range of hashes from all chunks; it joins them and answers each chunk with the total
   of every edge, in the order asked. An edge that a third of all documents share is one entry per chunk.
3. A chunk joins its documents with the answers. Consecutive repeated edges with the same total form a
   nonbranching path, which is compacted to one span (source coordinates and a digest of its words).
4. ``compact_paths`` joins the spans of all documents to paths and verifies them: the digest of the words
   read at the source coordinates must occur as often as each edge of the path was counted.

Edges are compared by 64 hash bits and 8 * ``check_bytes`` more bits of a second hash: 80 bits by
default, where a false match anywhere is to be expected once in ``2 ** 81 / n ** 2`` corpora of ``n`` words
(10 ** 7 runs at 10 ** 9 words); more bytes are for larger corpora. ``compact_paths`` shows what is left
unverified by 128-bit digests.

Defined results: a null text has no words; texts of fewer words than a window lose nothing; repeated rows
count as separate documents, so both lose what they share; extra columns pass through, but for those named
like the ones that are added.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vectorloom.llm.arrays import (
    SPACED_WORD,
    WordHashes,
    pack,
    pack_sorted,
    small_batches,
    unpack,
    unpack_sorted,
)
from vectorloom.llm.rows import with_row_index

WINDOW = 35
CHUNK_CHARS = 2_000_000
SHARD_CHARS = 16_000_000
CHECK_BYTES = 2
MAX_TOTAL = 2**32 - 1

_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_MIX = np.uint64(0xFF51AFD7ED558CCD)

ASKED = pa.schema(
    [("chunk", pa.int32()), ("shard", pa.int32())]
    + [(name, pa.binary()) for name in ("keys", "checks", "counts")]
)
ANSWERED = pa.schema([("_chunk", pa.int32()), ("shard", pa.int32()), ("totals", pa.binary())])
SPANS = "array<struct<start: int, n_words: int, total: bigint, digest: binary>>"


class _Rolling:
    """Hashes of all windows of a document, from running sums of a polynomial modulo 2**64."""

    def __init__(self, window: int, check_bytes: int):
        self.window, self.check_bits = window, 8 * check_bytes
        self.words = WordHashes()
        self.powers: list[tuple[np.ndarray, np.ndarray]] = []

    def _power(self, number: int, count: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.powers) < 2:
            self.powers = [(np.ones(1, np.uint64), np.ones(1, np.uint64))] * 2
        if len(self.powers[number][0]) < count:
            size = max(count, 2 * len(self.powers[number][0]), 4096)
            base = _BASES[number]
            both = []
            for factor in (base, pow(base, -1, 1 << 64)):
                steps = np.full(size, factor, np.uint64)
                steps[0] = 1
                both.append(np.cumprod(steps, dtype=np.uint64))
            self.powers[number] = (both[0], both[1])
        return self.powers[number]

    def edges(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Hash and check bits of every window."""
        count = len(words) - self.window + 1
        if count < 1:
            return np.array([], np.uint64), np.array([], np.uint64)
        values = self.words.of(words)
        hashed = []
        for number in (0, 1):
            up, down = self._power(number, len(words))
            own = values if number == 0 else (values ^ (values >> np.uint64(31))) * _MIX
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(own * up[: len(words)], dtype=np.uint64)])
            value = (sums[self.window :] - sums[: -self.window]) * down[:count]
            value = (value ^ (value >> np.uint64(33))) * _MIX
            hashed.append(value ^ (value >> np.uint64(29)))
        return hashed[0], hashed[1] >> np.uint64(64 - self.check_bits)


def _distinct(keys: np.ndarray, checks: np.ndarray):
    """Order by (key, check), first position of each distinct edge in that order, and group numbers."""
    order = np.argsort(keys, kind="stable")
    sorted_keys = keys[order]
    same = np.flatnonzero(sorted_keys[1:] == sorted_keys[:-1])
    if len(same) and (checks[order[same]] != checks[order[same + 1]]).any():
        order = np.lexsort((checks, keys))
        sorted_keys = keys[order]
    sorted_checks = checks[order]
    new = np.ones(len(keys), bool)
    new[1:] = (sorted_keys[1:] != sorted_keys[:-1]) | (sorted_checks[1:] != sorted_checks[:-1])
    return order, sorted_keys[new], sorted_checks[new], np.cumsum(new) - 1


def _check_type(check_bytes: int) -> type:
    return {1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.uint64}[check_bytes]


def _words(text: str | None) -> list[str]:
    return SPACED_WORD.findall(text) if text else []


def _chunk_edges(texts: list[str | None], rolling: _Rolling):
    """Number of windows of each text, and the edges of all texts."""
    edges = [rolling.edges(_words(text)) for text in texts]
    none = [np.array([], np.uint64)]
    keys, checks = (np.concatenate([e[i] for e in edges] or none) for i in (0, 1))
    return [len(e[0]) for e in edges], keys, checks


def shard_bounds(shards: int) -> np.ndarray:
    """First hash of every shard but the first."""
    return np.array([(number << 64) // shards for number in range(1, shards)], np.uint64)


def mark_repeats(
    docs: DataFrame,
    text_col: str = "text",
    window: int = WINDOW,
    chunk_chars: int = CHUNK_CHARS,
    shard_chars: int = SHARD_CHARS,
    check_bytes: int = CHECK_BYTES,
    layout: bool = False,
) -> DataFrame:
    """``docs`` with ``_n_words``, ``_spans`` (repeated spans, overlapping where windows do),
    ``_n_removed`` and ``_kept``: the words outside spans, joined by one space, or with ``layout`` the
    text itself without the spans."""
    size = F.coalesce(F.length(text_col), F.lit(0))
    small_batches(docs.sparkSession)
    chars = docs.agg(F.sum(size)).first()[0] or 0
    chunks, shards = 1 + chars // chunk_chars, 1 + chars // shard_chars
    columns = [c for c in docs.columns if c not in ("_n_words", "_spans", "_n_removed", "_kept", "_chunk")]
    others = [F.col(f"`{name}`") for name in columns]
    # The place in the file parts equal rows, however many there are.
    chunk: Column = F.pmod(F.xxhash64(*others, "_place"), F.lit(chunks)).cast("int")
    dealt = with_row_index(docs.select(*others), "_place").select(*others, chunk.alias("_chunk"))
    asked = _ask(dealt, text_col, window, shards, check_bytes)
    return _apply(dealt, _answer(asked, check_bytes), text_col, window, check_bytes, layout)


def _ask(dealt: DataFrame, text_col: str, window: int, shards: int, check_bytes: int) -> DataFrame:
    bounds = shard_bounds(shards)
    check_type = _check_type(check_bytes)

    def ask(key: tuple, table: pa.Table) -> pa.Table:
        chunk = key[0].as_py()
        _, keys, checks = _chunk_edges(table[text_col].to_pylist(), _Rolling(window, check_bytes))
        _, keys, checks, groups = _distinct(keys, checks)
        counts = np.minimum(np.bincount(groups, minlength=len(keys)), MAX_TOTAL).astype(np.uint32)
        cuts = [0, *np.searchsorted(keys, bounds).tolist(), len(keys)]
        rows = [
            {
                "chunk": chunk,
                "shard": shard,
                "keys": pack_sorted(keys[a:b]),
                "checks": pack(checks[a:b].astype(check_type)),
                "counts": pack(counts[a:b]),
            }
            for shard, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))
            if a < b
        ]
        return pa.Table.from_pylist(rows, ASKED)

    # All columns, as in the other pass over the chunks: Spark then shuffles the texts only once.
    return dealt.groupBy("_chunk").applyInArrow(
        ask, "chunk int, shard int, keys binary, checks binary, counts binary"
    )


def _answer(asked: DataFrame, check_bytes: int) -> DataFrame:
    check_type = _check_type(check_bytes)

    def answer(key: tuple, table: pa.Table) -> pa.Table:
        keys = [unpack_sorted(data, np.uint64) for data in table["keys"].to_pylist()]
        sizes = np.cumsum([0, *map(len, keys)])
        checks = np.concatenate([unpack(data, check_type) for data in table["checks"].to_pylist()])
        counts = np.concatenate([unpack(data, np.uint32) for data in table["counts"].to_pylist()])
        order, found, _, groups = _distinct(np.concatenate(keys), checks)
        sums = np.bincount(groups, weights=counts[order], minlength=len(found))
        totals = np.empty(len(counts), np.uint32)
        totals[order] = np.minimum(sums, MAX_TOTAL).astype(np.uint32)[groups]
        rows = [
            {"_chunk": chunk, "shard": key[0].as_py(), "totals": pack(totals[a:b])}
            for chunk, a, b in zip(table["chunk"].to_pylist(), sizes[:-1], sizes[1:], strict=True)
        ]
        return pa.Table.from_pylist(rows, ANSWERED)

    return asked.groupBy("shard").applyInArrow(answer, "_chunk int, shard int, totals binary")


def find_spans(totals: np.ndarray, window: int) -> list[tuple[int, int, int]]:
    """``(first word, words, total)`` of maximal runs of windows with one total of two or more."""
    if not len(totals):
        return []
    starts = np.concatenate([[0], np.flatnonzero(totals[1:] != totals[:-1]) + 1])
    stops = np.concatenate([starts[1:], [len(totals)]])
    return [
        (a, b - a + window - 1, t)
        for a, b, t in zip(starts.tolist(), stops.tolist(), totals[starts].tolist(), strict=True)
        if t >= 2
    ]


def _apply(
    dealt: DataFrame, answers: DataFrame, text_col: str, window: int, check_bytes: int, layout: bool
) -> DataFrame:
    names = [name for name in dealt.columns if name != "_chunk"]
    schema = T.StructType([dealt.schema[name] for name in names])
    for field in T._parse_datatype_string(
        f"_n_words bigint, _n_removed bigint, _kept string, _spans {SPANS}"
    ).fields:
        schema = schema.add(field)
    span_type = pa.list_(
        pa.struct(
            [("start", pa.int32()), ("n_words", pa.int32()), ("total", pa.int64()), ("digest", pa.binary())]
        )
    )

    def apply(key: tuple, table: pa.Table, reply: pa.Table) -> pa.Table:
        texts = table[text_col].to_pylist()
        lengths, keys, checks = _chunk_edges(texts, _Rolling(window, check_bytes))
        order, found, _, groups = _distinct(keys, checks)
        totals = np.zeros(len(keys), np.uint32)
        if len(found):
            parts = reply.sort_by("shard")["totals"].to_pylist()
            totals[order] = np.concatenate([unpack(data, np.uint32) for data in parts])[groups]
        n_words, n_removed, kept_texts, all_spans = [], [], [], []
        at = 0
        for text, length in zip(texts, lengths, strict=True):
            words = _words(text)
            spans = find_spans(totals[at : at + length], window)
            at += length
            removed = np.zeros(len(words), bool)
            rows = []
            for start, count, total in spans:
                removed[start : start + count] = True
                passage = " ".join(words[start : start + count]).encode()
                digest = hashlib.blake2b(passage, digest_size=16).digest()
                rows.append({"start": start, "n_words": count, "total": total, "digest": digest})
            n_words.append(len(words))
            n_removed.append(int(removed.sum()))
            all_spans.append(rows)
            if layout:
                kept_texts.append(cut_words(text, removed) if spans else text)
            else:
                kept = [words[i] for i in np.flatnonzero(~removed).tolist()] if spans else words
                kept_texts.append(" ".join(kept))
        columns = [table[name] for name in names]
        columns += [
            pa.array(n_words, pa.int64()),
            pa.array(n_removed, pa.int64()),
            pa.array(kept_texts, pa.string()),
            pa.array(all_spans, span_type),
        ]
        return pa.Table.from_arrays(columns, schema.names)

    return dealt.groupBy("_chunk").cogroup(answers.groupBy("_chunk")).applyInArrow(apply, schema)


def cut_words(text: str, removed: np.ndarray) -> str:
    """``text`` without the removed words and the white space behind them."""
    pieces, position, open_cut = [], 0, False
    for number, match in enumerate(SPACED_WORD.finditer(text)):
        if removed[number]:
            if not open_cut:
                pieces.append(text[position : match.start()])
                open_cut = True
        elif open_cut:
            position, open_cut = match.start(), False
    return "".join(pieces) + ("" if open_cut else text[position:])


def compact_paths(marked: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Nonbranching repeated paths: ``(digest, n_words, total, occurrences, doc_id, start, verified)``.

    ``doc_id`` and ``start`` are the first source coordinate. A path is verified if its words, read at
    their source coordinates, occur as often as its edges were counted.
    """
    spans = marked.select(F.col(id_col).alias("doc_id"), F.explode("_spans").alias("s"))
    return (
        spans.groupBy("s.digest", "s.n_words", "s.total")
        .agg(
            F.count("*").alias("occurrences"),
            F.min(F.struct("doc_id", "s.start")).alias("source"),
        )
        .select(
            "digest",
            "n_words",
            "total",
            "occurrences",
            "source.doc_id",
            "source.start",
            (F.col("occurrences") == F.col("total")).alias("verified"),
        )
    )
