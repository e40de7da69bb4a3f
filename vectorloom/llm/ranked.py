"""Ranked lexical search over impact lists with the Best Position Algorithm.

Documents are read once for a slice of items: of each the terms that occur in the slice are kept, packed for some
thousand documents at a time into one row of a written table, a shard. The numbers of documents, of terms and
of documents that hold a term are sums over the shards. A shard's impact lists (for each term its documents,
highest impact first) are built where it is read.

Search walks the lists of an item's terms side by side. Every document met is looked up in all the lists
(direct access), which gives its score and marks its position in each list as seen. The best position of a
list is the last one up to which all are seen; it may be far beyond the last one read. Whatever has not
been seen lies behind the best positions, so its score is at most the sum of the impacts that follow them:
search ends when this threshold is strictly below the k-th score (an equal score could win by its id) or
nothing is left. A task carries the k-th scores from shard to shard; the best of the tasks are ranked per item.

Scores are whole numbers: ``weight * impact`` summed over the distinct terms of the item.

Defined results: a null or wordless text has no terms and does not count as a document; documents without an id
take no part; rows that repeat an id are ranked one by one; every item row is answered, repeated ones each by
itself, with unique ranks; items without terms or without matches have no rows; equal scores are ordered by id;
extra columns do not matter.
"""

from __future__ import annotations

import dataclasses
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vectorloom.llm.arrays import NORMAL_WORD, lower_ascii, pack, slices, small_batches, unpack
from vectorloom.session import materialise

# Bounds of a shard.
SHARD_TEXTS = 16_384
SHARD_POSTINGS = 2_000_000
# Bound of the item texts whose terms are broadcast at a time; more items take further passes.
SLICE_CHARS = 2_000_000
# Positions read from every list in the first round; each round reads twice as many.
FIRST_STEP = 32

SHARD = (
    "texts bigint, terms bigint, ids binary, lengths binary, owners binary, numbers binary, counts binary"
)
_SHARD_TYPE = pa.schema(
    [("texts", pa.int64()), ("terms", pa.int64())]
    + [(name, pa.binary()) for name in ("ids", "lengths", "owners", "numbers", "counts")]
)
HITS = "item int, id bigint, score bigint"


def term_list(text: str | None) -> list[str]:
    """Terms with repeats, A-Z lower-cased."""
    return NORMAL_WORD.findall(lower_ascii(text)) if text else []


class _Shard:
    """The postings of some documents: document (place in ``ids``), term number, occurrences."""

    def __init__(self):
        self.texts = self.terms = self.postings = 0
        self.ids: list[int] = []
        self.lengths: list[int] = []
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, batch: pa.RecordBatch, numbers: dict[str, int]) -> None:
        owners: list[int] = []
        found: list[int] = []
        for identity, text in zip(batch.column("id").to_pylist(), batch.column("text"), strict=True):
            terms = term_list(text.as_py())
            self.texts += bool(terms)
            self.terms += len(terms)
            known = [number for term in terms if (number := numbers.get(term)) is not None]
            if known:
                owners.extend([len(self.ids)] * len(known))
                found.extend(known)
                self.ids.append(identity)
                self.lengths.append(len(terms))
        if found:
            keys = np.array(owners, np.int64) << 32 | np.array(found, np.int64)
            self.parts.append(np.unique(keys, return_counts=True))
            self.postings += len(self.parts[-1][0])

    def row(self) -> pa.RecordBatch:
        keys = np.concatenate([part[0] for part in self.parts] or [np.array([], np.int64)])
        counts = np.concatenate([part[1] for part in self.parts] or [np.array([], np.int64)])
        arrays = (
            np.array(self.ids, np.int64),
            np.array(self.lengths, np.int64),
            (keys >> 32).astype(np.int32),
            (keys & 0xFFFFFFFF).astype(np.int32),
            counts.astype(np.int64),
        )
        values = [self.texts, self.terms, *(pack(array) for array in arrays)]
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, _SHARD_TYPE, strict=True)], schema=_SHARD_TYPE)


def build_shards(docs: DataFrame, numbers: dict[str, int]) -> DataFrame:
    """The written shards of ``(id, text)`` rows, for the numbered terms."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(numbers)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = _Shard()
        for batch in slices(batches):
            shard.add(batch, shared.value)
            if len(shard.ids) >= SHARD_TEXTS or shard.postings >= SHARD_POSTINGS:
                yield shard.row()
                shard = _Shard()
        if shard.texts:
            yield shard.row()

    return materialise(docs.mapInArrow(scan, SHARD), "shards")


def document_counts(shards: DataFrame, terms: int) -> np.ndarray:
    """Documents that hold a term, by its number."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(terms, np.int64)
        for batch in batches:
            for data in batch.column("numbers").to_pylist():
                total += np.bincount(unpack(data, np.int32), minlength=terms)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(total[held])], ["number", "n"])

    counts = np.zeros(terms, np.int64)
    per_task = shards.select("numbers").mapInArrow(count, "number int, n bigint")
    for row in per_task.groupBy("number").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[row["number"]] = row["n"]  # one row for each term of the slice
    return counts


@dataclasses.dataclass
class Collection:
    """What scores depend on besides a document: its items' term numbers, weights, and the totals."""

    items: list[np.ndarray]
    weights: np.ndarray
    texts: int
    terms: int


def term_weight(texts: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * texts + 2) / (2 * holding + 1)))


def impacts(lengths: np.ndarray, counts: np.ndarray, texts: int, terms: int) -> np.ndarray:
    """Share of a term in a score, by the document's terms and the term's occurrences in it."""
    if 90 * int(lengths.max(initial=0)) * texts < 2**63:
        spread = (90 * lengths * texts) // terms
    else:
        spread = np.array([90 * n * texts // terms for n in lengths.tolist()], np.int64)
    return (1_000_000_000 * counts) // (1000 * counts + 8 * (100 - 90 + spread))


class ImpactLists:
    """The lists of one shard."""

    def __init__(self, row: dict, known: Collection):
        self.ids = unpack(row["ids"], np.int64)
        lengths = unpack(row["lengths"], np.int64)
        owners = unpack(row["owners"], np.int32)
        numbers = unpack(row["numbers"], np.int32)
        values = impacts(lengths[owners], unpack(row["counts"], np.int64), known.texts, known.terms)
        order = np.lexsort((owners, -values, numbers))
        self.owners, self.values = owners[order], values[order]
        self.bounds = np.searchsorted(numbers[order], np.arange(len(known.weights) + 1))
        self.weights = known.weights

    def of(self, terms: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Documents and shares of the score for every term that counts here."""
        found = []
        for term in terms.tolist():
            a, b = self.bounds[term], self.bounds[term + 1]
            if a < b and self.weights[term] > 0:
                found.append((self.owners[a:b], self.values[a:b] * self.weights[term]))
        return found


class Best:
    """The k best so far: scores descending, then ids ascending."""

    def __init__(self, k: int):
        self.k = k
        self.scores = self.ids = np.array([], np.int64)

    @property
    def floor(self) -> int:
        """The k-th score, or zero: scores of zero do not count."""
        return int(self.scores[-1]) if len(self.scores) == self.k else 0

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        keep = (scores >= self.floor) & (scores > 0)
        if not keep.any():
            return
        ids, scores = np.concatenate([self.ids, ids[keep]]), np.concatenate([self.scores, scores[keep]])
        order = np.lexsort((ids, -scores))[: self.k]
        self.ids, self.scores = ids[order], scores[order]


def search_lists(lists: list[tuple[np.ndarray, np.ndarray]], ids: np.ndarray, best: Best) -> int:
    """Add the documents of the lists to the best ones; returns the number of documents looked up."""
    # All lists behind each other, each closed by a share of zero where documents without the term point.
    sizes = np.array([len(docs) for docs, _ in lists], np.int64)
    ends = np.cumsum(sizes + 1) - 1
    begins = ends - sizes
    shares = np.zeros(int(ends[-1]) + 1, np.int64)
    place = np.empty((len(lists), len(ids)), np.int64)
    for n, (docs, values) in enumerate(lists):
        shares[begins[n] : ends[n]] = values
        place[n] = ends[n]
        place[n, docs] = np.arange(begins[n], ends[n])
    seen = np.zeros(len(shares), bool)
    met = np.zeros(len(ids), bool)
    position = begins.copy()  # the first unseen of every list: one behind its best position
    depth, step = 0, FIRST_STEP
    while True:
        read = [docs[depth : depth + step] for docs, _ in lists if len(docs) > depth]
        depth, step = depth + step, step * 2
        if read:
            new = np.concatenate(read)
            new = np.unique(new[~met[new]])
            met[new] = True
            places = place[:, new]
            seen[places] = True
            best.add(ids[new], shares[places].sum(axis=0))
        seen[ends] = False
        for n in range(len(lists)):
            # The closing entry is never seen, so the search for the first unseen stops there.
            position[n] += int(seen[position[n] : ends[n] + 1].argmin())
        threshold = int(shares[position].sum())
        if threshold == 0 or threshold < best.floor:
            return int(met.sum())


def _item_slices(items: DataFrame, limit: int) -> Iterator[list[tuple]]:
    """``(id, text)`` rows in slices of bounded size, one of which the driver holds."""
    current, held = [], 0
    for row in items.toLocalIterator():
        size = 64 + len(row["text"] or "")
        if current and held + size > limit:
            yield current
            current, held = [], 0
        current.append((row["id"], row["text"]))
        held += size
    if current:
        yield current


def _search_slice(docs: DataFrame, items: list[tuple], k: int) -> DataFrame | None:
    """The k best documents of every item of a slice, as ``(item, id, score, rank)``."""
    numbers: dict[str, int] = {}
    asked = []
    for _, text in items:
        terms = dict.fromkeys(term_list(text))
        asked.append(np.array([numbers.setdefault(term, len(numbers)) for term in terms], np.int64))
    if not numbers:
        return None
    shards = build_shards(docs, numbers)
    totals = shards.agg(F.sum("texts").alias("texts"), F.sum("terms").alias("terms")).first()
    if not totals["texts"]:
        return None
    holding = document_counts(shards, len(numbers))
    weights = np.array([term_weight(totals["texts"], n) for n in holding.tolist()], np.int64)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(Collection(asked, weights, totals["texts"], totals["terms"]))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        best = [Best(k) for _ in known.items]
        for batch in batches:
            for n in range(batch.num_rows):
                lists = ImpactLists(batch.slice(n, 1).to_pylist()[0], known)
                for item, terms in enumerate(known.items):
                    if found := lists.of(terms):
                        search_lists(found, lists.ids, best[item])
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(np.arange(len(best), dtype=np.int32), [len(b.ids) for b in best])),
                pa.array(np.concatenate([b.ids for b in best])),
                pa.array(np.concatenate([b.scores for b in best])),
            ],
            ["item", "id", "score"],
        )

    hits = shards.select("ids", "lengths", "owners", "numbers", "counts").mapInArrow(search, HITS)
    order = Window.partitionBy("item").orderBy(F.desc("score"), "id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search_items(
    docs: DataFrame,
    items: DataFrame,
    k: int = 10,
    doc_id: str = "doc_id",
    doc_text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    slice_chars: int = SLICE_CHARS,
) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the k documents of highest score above zero for every item."""
    spark = docs.sparkSession
    texts = docs.where(F.col(doc_id).isNotNull()).select(
        F.col(doc_id).cast("bigint").alias("id"), F.col(doc_text).alias("text")
    )
    wanted = items.select(F.col(item_id).alias("id"), F.col(item_text).alias("text"))
    names = T.StructType([T.StructField("item", T.IntegerType()), T.StructField("name", wanted.schema["id"].dataType)])
    answer = None
    for part in _item_slices(wanted, slice_chars):
        found = _search_slice(texts, part, k)
        if found is None:
            continue
        named = spark.createDataFrame([(n, identity) for n, (identity, _) in enumerate(part)], names)
        found = found.join(F.broadcast(named), "item")
        rows = found.select(F.col("name").alias(item_id), "rank", F.col("id").alias(doc_id), "score")
        answer = rows if answer is None else answer.unionByName(rows)
    if answer is None:
        empty = T.StructType([T.StructField(item_id, wanted.schema["id"].dataType)])
        empty = empty.add("rank", T.IntegerType()).add(doc_id, T.LongType()).add("score", T.LongType())
        return spark.createDataFrame([], empty)
    return answer
