"""Quality classifier: an interpolated modified Kneser-Ney bigram model of trusted text.

Trusted text is every document whose label says good quality and not toxic. All its words and bigrams are
counted, in shards, and none is left out. What is known about the ``FREQUENT`` most frequent words goes to
every task; about all other words, and bigrams with one of them, it stays in the shards. Documents send
the bigrams and rarer words they need (sorted, compressed, with the document's number in its chunk) to the shards,
are joined with the counts there, and get back sums of log-probabilities; texts are not shuffled. Keys of a shard
have 32 bits for bigrams of frequent words, which name them, and 40 bits of a hash otherwise; shards grow in number
with the text. Bigrams that make up more than ``1 / HOT`` of the trusted text (so ``HOT`` of them at most)
are broadcast instead, so a very frequent one does not fill a shard.

A trusted document would see its own counts. Its own occurrences of a bigram are taken off the bigram's
count before it is scored, so trusted and other documents are judged alike.

A document is rejected if its log-perplexity exceeds its language's threshold, the ``QUANTILE`` of trusted
documents of that language. Short documents have uncertain means, so the mean log-probability is taken over
``PRIOR_WORDS`` more words that cost what the language's median word costs. A quantile needs documents: of a
language with ``n`` trusted ones, fewer than ``ENOUGH``, the distance from the median to the threshold is
``n / ENOUGH`` parts its own and for the rest that of all trusted documents, each measured from its own
language's median.

A few toxic words hardly move the mean of a fluent text. So a document is also rejected for its toxicity: the sum,
over its distinct words, of the logarithm of how much more frequent the word is among documents labelled toxic than
among trusted ones (its own label left out). Words count if they are in ``TOXIC_SHARE`` of the toxic documents
(so there are at most ``1 / TOXIC_SHARE`` times as many as a document has on average), in three at least, and that
logarithm is ``EVIDENCE`` or more. The threshold is again the quantile of the language's trusted documents, and
of languages with few of them the larger of that and the quantile of all.

Defined results: a document without words has no perplexity and is kept; a null language is a group of its own;
a language without trusted documents takes the threshold of all; without any trusted document nothing is rejected;
repeated rows are scored one by one; labels of one document that differ do not make it trusted, and make it toxic if
one says so; other columns of documents, whatever their names, do not matter and are not returned.
"""

from __future__ import annotations

import math
import pickle
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectorloom.llm.arrays import (
    WordHashes,
    pack,
    pack_sorted,
    slices,
    small_batches,
    unpack,
    unpack_sorted,
)
from vectorloom.llm.rows import small_side
from vectorloom.session import materialise, shuffles_removed

# Words whose statistics every task has; numbers of words have 16 bits, two are taken.
FREQUENT = 65_534
HOT = 4096
CHUNK_WORDS = 500_000
SHARD_CHARS = 48_000_000
# Documents are scored in so many jobs, each of which removes its shuffled requests: they take more disk than all else.
SLICES = 3
QUANTILE = 0.995
PRIOR_WORDS = 20
TOXIC_SHARE = 0.01
EVIDENCE = 2.0
# Trusted documents of a language from which its own quantile is taken as it is.
ENOUGH = 100
# Trusted ids are broadcast up to this many; more are joined by a shuffle.
BROADCAST_IDS = 2_000_000
UNKNOWN, START, FIRST = 0, 1, 2
# The highest bit marks the hash of a rarer word; numbers of frequent words are below it.
RARER = np.uint64(1 << 63)
KEY_BITS = 40
# Documents of a chunk are numbered in so many bits, beside a key.
OWNER_BITS = np.uint64(24)
OWNERS = np.uint64((1 << 24) - 1)
FREQUENT_PAIR, RARER_PAIR, RARER_WORD = 0, 1, 2
_FLUSH = 200_000


def words_of(text: bytes | None) -> list[bytes]:
    """Words of a text in UTF-8: bytes are split at just the ASCII white space."""
    return text.split() if text else []


def texts_of(batch: pa.RecordBatch) -> list[bytes | None]:
    return batch.column("text").cast(pa.binary()).to_pylist()


def label_flags(labels: DataFrame) -> DataFrame:
    """``(_id, _good, _toxic)``: whether all labels say good quality and not toxic, and whether one says toxic."""
    good = F.coalesce((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0), F.lit(False))
    toxic = F.coalesce(F.col("toxic") == 1, F.lit(False))
    rows = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("_id"))
    return rows.agg(F.min(good).alias("_good"), F.max(toxic).alias("_toxic")).where("_good or _toxic")


def with_trust(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents ``(doc_id, lang, text, trusted, toxic)``."""
    flags = materialise(label_flags(labels), "trusted")
    if flags.count() <= BROADCAST_IDS:
        flags = F.broadcast(flags)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "lang", "text")
    joined = rows.join(flags, rows["doc_id"] == flags["_id"], "left")
    said = (F.coalesce(f"_{name}", F.lit(False)).alias(alias) for name, alias in (("good", "trusted"), ("toxic", "toxic")))
    return joined.select("doc_id", "lang", "text", *said)


def toxic_words(rows: DataFrame, share: float = TOXIC_SHARE, least: float = EVIDENCE) -> dict[str, tuple[float, float]]:
    """Words that speak for toxicity, with their weight, and their weight for a trusted document that has them."""

    def holding(wanted: frozenset[bytes] | None):
        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: Counter = Counter()
            for batch in slices(batches):
                for text in texts_of(batch):
                    words = set(words_of(text))
                    seen.update(words if wanted is None else words & wanted)
                    if len(seen) > _FLUSH:
                        yield _counts(seen)
                        seen = Counter()
            yield _counts(seen)

        return count

    def documents(kind: str, wanted: frozenset[bytes] | None) -> DataFrame:
        counted = rows.where(kind).select("text").mapInArrow(holding(wanted), "word string, n bigint")
        return counted.groupBy("word").agg(F.sum("n").alias("n"))

    toxic, good = rows.agg(*(F.count(F.when(F.col(kind), True)) for kind in ("toxic", "trusted"))).first()
    often = documents("toxic", None).where(F.col("n") >= max(3, share * toxic))
    known = {row["word"]: row["n"] for row in often.collect()}
    if not known or not good:
        return {}
    among = {row["word"]: row["n"] for row in documents("trusted", frozenset(map(str.encode, known))).collect()}

    def weight(word: str, own: int) -> float:
        held = among.get(word, 0) - own
        return math.log((known[word] + 0.5) / (toxic + 1)) - math.log((held + 0.5) / (good + 1))

    return {word: (weight(word, 0), weight(word, min(1, among.get(word, 0)))) for word in sorted(known) if weight(word, 0) >= least}


def vocabulary(trusted: DataFrame, size: int = FREQUENT) -> list[str]:
    """The most frequent words, at most ``size``.

    They are taken by steps of frequency (an eighth of an octave each) as long as all words of a step have
    room, so only one number per step and the words themselves reach the driver.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in slices(batches):
            for text in texts_of(batch):
                seen.update(words_of(text))
                if len(seen) > _FLUSH:
                    yield _counts(seen)
                    seen = Counter()
        yield _counts(seen)

    counted = trusted.select("text").mapInArrow(count, "word string, n bigint")
    step = F.floor(F.log2(F.sum("n")) * 8)
    summed = materialise(counted.groupBy("word").agg(step.alias("step")), "words")
    room, lowest = size, None
    for row in summed.groupBy("step").count().orderBy(F.desc("step")).collect():
        room -= row["count"]
        if room < 0:
            break
        lowest = row["step"]
    if lowest is None:
        return []
    return sorted(row["word"] for row in summed.where(F.col("step") >= lowest).select("word").collect())


def _counts(seen: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(list(seen), pa.binary()).cast(pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"]
    )


class Stretch:
    """Words of successive documents, as names: numbers of frequent words and marked hashes of the others."""

    # Words that are held as such, and given names together.
    HELD = 50_000

    def __init__(self, words: list[str]):
        self.get = {word.encode(): number for number, word in enumerate(words, FIRST)}.get
        self.hashes = WordHashes()
        self.clear()

    def clear(self) -> None:
        self.named: list[np.ndarray] = []
        self.held: list[bytes] = []
        self.lengths: list[int] = []

    def add(self, words: list[bytes]) -> None:
        self.held += words
        self.lengths.append(len(words))
        if len(self.held) >= self.HELD:
            self._name()

    def _name(self) -> None:
        words, self.held = self.held, []
        names = np.fromiter(map(self.get, words, repeat(UNKNOWN)), np.uint64, len(words))
        rarer = np.flatnonzero(names == UNKNOWN)
        if len(rarer):
            names[rarer] = self.hashes.of([words[i] for i in rarer.tolist()]) | RARER
        self.named.append(names)

    def take(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The names, for each the one before it in its document (whose start is one), and the numbers of words of
        the documents; nothing is kept."""
        self._name()
        names, lengths = np.concatenate(self.named), np.array(self.lengths, np.int64)
        self.clear()
        before = np.empty_like(names)
        before[1:] = names[:-1]
        before[(np.cumsum(lengths) - lengths)[lengths > 0]] = START
        return names, before, lengths


def frequent_pairs(before: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where both words of a bigram are frequent, and the keys of these bigrams."""
    known = np.flatnonzero((before | names) < RARER)
    return known, (before[known] << np.uint64(16)) | names[known]


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def pair_hash(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return _mixed(_mixed(before) + np.uint64(0x9E3779B97F4A7C15) * word)


def place_of(hashes: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Shard of a hash, and the key in it."""
    shard = ((hashes >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)
    return shard.astype(np.int64), hashes & np.uint64((1 << KEY_BITS) - 1)


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of a bigram of frequent words, by a multiplicative hash."""
    mixed = (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
    return ((mixed * np.uint64(shards)) >> np.uint64(32)).astype(np.int64)


def _split(owner: np.ndarray, shards: int) -> Iterator[tuple[int, np.ndarray]]:
    """Positions by shard, in order."""
    owner = owner.astype(np.uint16) if shards <= 1 << 16 else owner  # numbers of 16 bits are sorted fastest
    order = np.argsort(owner, kind="stable")
    cuts = np.searchsorted(owner[order], np.arange(shards + 1))
    for shard in range(shards):
        if cuts[shard] < cuts[shard + 1]:
            yield shard, order[cuts[shard] : cuts[shard + 1]]


def count_bigrams(trusted: DataFrame, shared: Broadcast, shards: int) -> DataFrame:
    """All bigrams of trusted text, in shards: ``(shard, key, n, part, tail)``.

    ``shared`` holds the frequent words. A bigram of two of them is a row with its key and count. Bigrams with a
    rarer word are packed, one ``part`` a shard: those with a rarer word are counted in the shard of that word (so
    there its distinct contexts are known), those with a rarer context in the shard of the context. A bigram of two
    rarer words is in both; the shard of its word sends a ``tail`` with the word's contexts to that of its context.
    """
    asked = pa.schema(
        [("shard", pa.int32())] + [(name, pa.binary()) for name in ("keys", "counts", "before", "word", "by_context")]
    )

    def flush(names: np.ndarray, before: np.ndarray) -> pa.RecordBatch:
        keys, counts = np.unique(frequent_pairs(before, names)[1].astype(np.uint32), return_counts=True)
        rows = [
            {"shard": shard, "keys": pack_sorted(keys[at]), "counts": pack(counts[at].astype(np.uint32))}
            for shard, at in _split(shard_of(keys, shards), shards)
        ]
        marked = (before | names) >= RARER
        before, word, counts = _summed(before[marked], names[marked])
        for by_context, owner in ((b"", word), (b"1", before)):
            mine = np.flatnonzero(owner >= RARER)
            mine = mine[np.argsort(owner[mine], kind="stable")]
            other = (word if by_context else before)[mine]
            for shard, at in _split(word_place(owner[mine], shards)[0], shards):
                rows.append(
                    {
                        "shard": shard,
                        "by_context": by_context,
                        "before" if by_context else "word": pack_sorted(owner[mine][at]),
                        "word" if by_context else "before": pack(other[at]),
                        "counts": pack(counts[mine][at]),
                    }
                )
        return pa.RecordBatch.from_pylist(rows, asked)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stretch, size = Stretch(shared.value), 0
        for batch in slices(batches):
            for text in texts_of(batch):
                found = words_of(text)
                if not found:
                    continue
                stretch.add(found)
                size += len(found)
                if size >= CHUNK_WORDS:
                    yield flush(*stretch.take()[:2])
                    size = 0
        if size:
            yield flush(*stretch.take()[:2])

    def add(key: tuple, table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        plain = [row for row in rows if row["keys"] is not None]
        keys = _all(unpack_sorted(row["keys"], np.uint32) for row in plain).astype(np.uint32)
        counts = _all(unpack(row["counts"], np.uint32) for row in plain)
        found, groups = np.unique(keys, return_inverse=True)
        sums = np.bincount(groups, weights=counts, minlength=len(found)).astype(np.int64)
        by_word = _collected([row for row in rows if row["by_context"] == b""], "before", "word")
        by_context = _collected([row for row in rows if row["by_context"] == b"1"], "word", "before")
        part, tails = pack_part(by_word, by_context, shards)
        own = key[0].as_py()
        more = [{"shard": own, "part": part}] + [{"shard": to, "tail": tail} for to, tail in tails]
        plain = pa.table({"shard": np.full(len(found), own, np.int32), "key": found.astype(np.int64), "n": sums})
        return pa.concat_tables([plain, pa.Table.from_pylist(more, _COUNTED_TYPE)], promote_options="default")

    sent = trusted.select("text").mapInArrow(count, "shard int, " + ", ".join(f"{f.name} binary" for f in list(asked)[1:]))
    return sent.groupBy("shard").applyInArrow(add, "shard int, key bigint, n bigint, part binary, tail binary")


_COUNTED_TYPE = pa.schema(
    [("shard", pa.int32()), ("key", pa.int64()), ("n", pa.int64()), ("part", pa.binary()), ("tail", pa.binary())]
)


def word_place(names: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Shard of a rarer word, and its key there."""
    return place_of(_mixed(names), shards)


def _collected(rows: list[dict], other: str, owner: str) -> tuple:
    """``(owner, other, n)`` of the bigrams that a shard got, summed and sorted by owner."""
    owners = _all(unpack_sorted(row[owner], np.uint64) for row in rows).astype(np.uint64)
    others = _all(unpack(row[other], np.uint64) for row in rows).astype(np.uint64)
    return _summed(owners, others, _all(unpack(row["counts"], np.uint32) for row in rows))


def _runs(owners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct owners in order, and for each row the number of its owner."""
    new = np.ones(len(owners), bool)
    new[1:] = owners[1:] != owners[:-1]
    return owners[new], np.cumsum(new) - 1


def _numbered(names: np.ndarray) -> np.ndarray:
    """Numbers of frequent words, zero for others."""
    return np.where(names >= RARER, 0, names).astype(np.uint16)


def pack_part(by_word: tuple, by_context: tuple, shards: int) -> tuple[bytes, list[tuple[int, bytes]]]:
    """A shard's bigrams with rarer words, and the tails for other shards."""
    word, before, n = by_word
    words, at = _runs(word)
    contexts = np.bincount(at, minlength=len(words))
    plain = before < RARER
    arrays = {
        "words": words,
        "contexts": contexts.astype(np.uint32),
        "keys": place_of(pair_hash(before[plain], word[plain]), shards)[1],
        "n": n[plain],
        "before": _numbered(before[plain]),
        "at": at[plain].astype(np.uint32),
        "classes": np.array([(n == i).sum() for i in (1, 2, 3, 4)] + [n.sum(), len(n)], np.int64),
    }
    tails = []
    both = np.flatnonzero(~plain)
    if len(both):
        keys = place_of(pair_hash(before[both], word[both]), shards)[1]
        order = np.argsort(keys, kind="stable")
        keys, both = keys[order], both[order]
        for to, some in _split(word_place(before[both], shards)[0], shards):
            tails.append((to, _bundle({"keys": keys[some], "contexts": contexts[at[both[some]]].astype(np.uint32)})))
    before, word, n = by_context
    befores, at = _runs(before)
    frequent = n[word < RARER]
    arrays |= {
        "c_words": befores,
        "c_n": np.bincount(at, weights=n, minlength=len(befores)).astype(np.uint32),
        "c_keys": place_of(pair_hash(before, word), shards)[1],
        "c_pair_n": n,
        "c_word": _numbered(word),
        "c_at": at.astype(np.uint32),
        "c_classes": np.array([(frequent == i).sum() for i in (1, 2, 3, 4)] + [frequent.sum(), len(frequent)], np.int64),
    }
    for i in (1, 2, 3):
        of_class = (n == i) if i < 3 else (n > 2)
        arrays[f"c_n{i}"] = np.bincount(at[of_class], minlength=len(befores)).astype(np.uint32)
    return _bundle(arrays), tails


def _bundle(arrays: dict[str, np.ndarray]) -> bytes:
    return pickle.dumps({name: (values.dtype.str, pack(values) if len(values) else b"") for name, values in arrays.items()})


def _unbundle(data: bytes) -> dict[str, np.ndarray]:
    return {
        name: unpack(packed, np.dtype(kind).type) if packed else np.array([], kind)
        for name, (kind, packed) in pickle.loads(data).items()
    }


class ShardPart:
    """A shard's rarer words and the bigrams with them, ready to be looked up."""

    def __init__(self, part: dict[str, np.ndarray], tails: list[dict[str, np.ndarray]], model: Model, shards: int):
        lowest = model.lowest_of(part["contexts"].astype(np.int64))
        self.words = self._table(word_place(part["words"], shards)[1], np.log(lowest) - math.log(model.share))
        counts = np.stack([part[f"c_n{i}"] for i in (1, 2, 3)], axis=1).astype(np.int64).reshape(-1, 3)
        totals = part["c_n"].astype(np.float64)
        backoff = model.backoff_of(totals, counts)
        self.contexts = self._table(word_place(part["c_words"], shards)[1], np.log(backoff))
        # What the words of bigrams with a rarer context are worth: by number, or by the tails.
        low = model.lowest[part["c_word"]].copy()
        rarer = np.flatnonzero(part["c_word"] == 0)
        keys = _all(tail["keys"] for tail in tails).astype(np.uint64)
        known = _all(tail["contexts"] for tail in tails).astype(np.int64)
        order = np.argsort(keys, kind="stable")
        if len(rarer):
            at = np.searchsorted(keys[order], part["c_keys"][rarer])
            low[rarer] = model.lowest_of(known[order][at])
        self.pairs = self._table(
            np.concatenate([part["keys"], part["c_keys"]]),
            np.concatenate([part["n"], part["c_pair_n"]]).astype(np.int64),
            np.concatenate([model.backoff[part["before"]] * lowest[part["at"]], backoff[part["c_at"]] * low]),
            np.concatenate([model.totals[part["before"]], totals[part["c_at"]]]),
        )

    @staticmethod
    def _table(keys: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
        order = np.argsort(keys, kind="stable")
        return [column[order] for column in (keys, *values)]


def matched(have: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the keys that a sorted array has, and where it has them."""
    at = np.searchsorted(have, keys)
    at[at == len(have)] = 0
    found = np.flatnonzero(have[at] == keys) if len(have) else at[:0]
    return found, at[found]


def _all(parts) -> np.ndarray:
    parts = list(parts)
    return np.concatenate(parts) if parts else np.array([], np.int64)


def _summed(before: np.ndarray, word: np.ndarray, counts: np.ndarray | None = None) -> tuple:
    """Distinct pairs, sorted by context and word, with their counts."""
    counts = np.ones(len(before), np.uint32) if counts is None else counts
    order = np.lexsort((word, before))
    before, word = before[order], word[order]
    new = np.ones(len(before), bool)
    new[1:] = (before[1:] != before[:-1]) | (word[1:] != word[:-1])
    sums = np.bincount(np.cumsum(new) - 1, weights=counts[order]) if len(before) else np.array([])
    return before[new], word[new], sums.astype(np.uint32)


def discounts(classes: list[int]) -> np.ndarray:
    """Discounts for counts of 0, 1, 2 and 3 or more, from the numbers of counts of 1 to 4."""
    n1, n2, n3, n4 = classes
    if not n1 or not n2:
        return np.array([0.0, 0.5, 0.5, 0.5])
    y = n1 / (n1 + 2 * n2)
    raw = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return np.array([0.0, *(min(max(value, 0.0), limit) for value, limit in zip(raw, (1, 2, 3), strict=True))])


class Model:
    """What every task needs; arrays over the frequent words, so of bounded size."""

    def __init__(self, words, contexts: np.ndarray, followers: np.ndarray, classes, low_classes, total, distinct, hot, toxic):
        """``contexts``: n, n1, n2, n3+ by context; ``followers``: distinct contexts by word; ``total``, ``distinct``
        and ``low_classes``: bigrams, words, and words by followers, of all words."""
        self.words = words
        self.toxic = {word.encode(): weights for word, weights in toxic.items()}
        self.discounts = discounts(classes)
        # The lowest order: continuation counts, interpolated with the uniform distribution.
        self.low = discounts(low_classes)
        self.bigrams = max(float(total), 1.0)
        ones, twos, threes = low_classes[0], low_classes[1], distinct - low_classes[0] - low_classes[1]
        left = float(self.low[1] * ones + self.low[2] * twos + self.low[3] * threes) / self.bigrams
        self.share = (left if left > 0 else 1.0 / (self.bigrams + 1)) / (distinct + 1)
        self.lowest = self.lowest_of(followers)
        self.totals = contexts[:, 0].astype(np.float64)
        self.backoff = self.backoff_of(self.totals, contexts[:, 1:])
        self.hot_keys = np.array(sorted(hot), np.uint32)
        self.hot_counts = np.array([hot[key] for key in self.hot_keys.tolist()], np.int64)

    def lowest_of(self, followers: np.ndarray) -> np.ndarray:
        """Probability of words by the number of their distinct contexts."""
        return np.maximum(followers - self.low[np.minimum(followers, 3)], 0) / self.bigrams + self.share

    def backoff_of(self, totals: np.ndarray, classes: np.ndarray) -> np.ndarray:
        """Share that contexts leave to unseen words, by their total and their bigrams seen once, twice and more."""
        left = np.where(totals > 0, classes.astype(np.float64) @ self.discounts[1:] / np.maximum(totals, 1), 1.0)
        return np.where(left > 0, left, 1.0 / (totals + 1))

    def toxicity(self, words: list[bytes], trusted: bool) -> float:
        return float(sum(sorted(self.toxic[word][trusted] for word in self.toxic.keys() & words))) if self.toxic else 0.0

    def gain(self, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """What a bigram's own count adds to its log-probability."""
        before, word = keys >> np.uint32(16), keys & np.uint32(0xFFFF)
        return self.above(counts, self.backoff[before] * self.lowest[word], self.totals[before])

    def above(self, counts: np.ndarray, unseen: np.ndarray, totals: np.ndarray) -> np.ndarray:
        """Log-probability of bigrams seen ``counts`` times, less that of unseen ones."""
        own = np.maximum(counts - self.discounts[np.clip(counts, 0, 3)], 0) / np.maximum(totals, 1)
        return np.log(own + unseen) - np.log(unseen)


def train(rows: DataFrame, shards: int, size: int = FREQUENT) -> tuple[Model, DataFrame]:
    """The model and the table of what is kept in shards, bigrams of frequent words that are hot left out."""
    trusted = rows.where("trusted")
    spark = rows.sparkSession
    words = vocabulary(trusted, size)
    shared = spark.sparkContext.broadcast(words)
    table = materialise(count_bigrams(trusted, shared, shards), "bigrams")
    shared.destroy()
    plain, width = table.where("key is not null"), len(words) + FIRST
    is_class = [(F.col("n") == n).cast("bigint") for n in (1, 2, 3, 4)]
    # Sums over the rarer words' parts: those by frequent word or context (one row each), and those of all.
    parts = materialise(table.where("part is not null").select("part").mapInArrow(_part_sums, _SUMS_OF_PARTS), "sums")
    added = parts.groupBy("what", "number").agg(*(F.sum(f"s{i}").alias(f"s{i}") for i in range(6)))
    total = np.zeros(6, np.int64)  # n, bigrams, bigrams seen 1 to 4 times
    low = np.zeros(5, np.int64)  # words, words with 1 to 4 contexts
    contexts, followers = np.zeros((width, 4), np.int64), np.zeros(width, np.int64)
    for row in materialise(added, "sums").toLocalIterator():  # at most two rows for each frequent word
        sums = np.array(row[2:], np.int64)
        if row["what"] == "all":
            total += sums
        elif row["what"] == "words":
            low += sums[:5]
        elif row["what"] == "context":
            contexts[row["number"]] += sums[:4]
        else:
            followers[row["number"]] += sums[0]
    one_row = plain.agg(F.sum("n"), F.count("*"), *(F.sum(c) for c in is_class)).first()
    total += np.array([value or 0 for value in one_row], np.int64)
    before, word = F.shiftright("key", 16), F.col("key").bitwiseAND(F.lit(0xFFFF).cast("bigint"))
    by_context = plain.groupBy(before.alias("w")).agg(
        F.sum("n"), F.sum(is_class[0]), F.sum(is_class[1]), F.sum((F.col("n") > 2).cast("bigint"))
    )
    for row in by_context.collect():  # one row for each frequent word
        contexts[row[0]] += np.array(row[1:], np.int64)
    for row in plain.groupBy(word.alias("w")).count().collect():
        followers[row[0]] += row[1]
    low += np.array([(followers > 0).sum()] + [(followers == n).sum() for n in (1, 2, 3, 4)], np.int64)
    often = F.col("n") * HOT > int(total[0])
    hot = {row["key"]: row["n"] for row in plain.where(often).select("key", "n").collect()}
    model = Model(
        words, contexts, followers, total[2:].tolist(), low[1:].tolist(), int(total[1]), int(low[0]), hot, toxic_words(rows)
    )
    return model, table.where(F.col("key").isNull() | ~often)


_SUMS_OF_PARTS = "what string, number int, " + ", ".join(f"s{i} bigint" for i in range(6))


def _part_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the bigrams with rarer words add: to totals, to frequent contexts, and to frequent words."""

    def rows(what: str, numbers: np.ndarray, *sums: np.ndarray) -> pa.RecordBatch:
        none = np.zeros(len(numbers), np.int64)
        columns = [*sums, *[none] * (6 - len(sums))]
        return pa.RecordBatch.from_pydict(
            {"what": pa.array([what] * len(numbers), pa.string()), "number": pa.array(numbers.astype(np.int32))}
            | {f"s{i}": pa.array(np.asarray(column).astype(np.int64)) for i, column in enumerate(columns)}
        )

    one = np.zeros(1, np.int32)
    for batch in batches:
        for data in batch.column("part").to_pylist():
            part = _unbundle(data)
            sums = part["classes"] + part["c_classes"]
            yield rows("all", one, *([sums[i]] for i in (4, 5, 0, 1, 2, 3)))
            held = part["contexts"]
            yield rows("words", one, [len(held)], *([(held == i).sum()] for i in (1, 2, 3, 4)))
            numbers, n = part["before"], part["n"].astype(np.int64)
            known = np.unique(numbers)
            size = int(known.max(initial=0)) + 1
            classes = (n == 1, n == 2, n > 2)
            of = [np.bincount(numbers, weights=n, minlength=size)] + [np.bincount(numbers[c], minlength=size) for c in classes]
            yield rows("context", known, *(column[known] for column in of))
            numbers = part["c_word"][part["c_word"] > 0]
            known = np.unique(numbers)
            yield rows("word", known, np.bincount(numbers)[known] if len(known) else known)


_ASKED_NAMES = ("docs", "keys", "owners", "counts", "as_context", "trusted")
_ASKED = "shard int, chunk bigint, kind int, " + ", ".join(f"{name} binary" for name in _ASKED_NAMES)
_ASKED_TYPE = pa.schema(
    [("shard", pa.int32()), ("chunk", pa.int64()), ("kind", pa.int32())]
    + [(name, pa.binary()) for name in _ASKED_NAMES]
)


def score(docs: DataFrame, shared: Broadcast, counts: DataFrame, shards: int) -> DataFrame:
    """``(doc_id, lang, trusted, n_words, log_prob, toxicity)`` per row of ``docs``, by joins in shards.

    ``shared`` holds the model.
    """
    place = (F.spark_partition_id().cast("bigint") * F.lit(1 << 33)).alias("place")

    def asked_by(keys: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct pairs of a key and a document, sorted, as one number each; and how often each occurs."""
        return np.unique((keys << OWNER_BITS) | owners, return_counts=True)

    def flush(known: Model, chunk: int, stretch: Stretch, heads: list) -> pa.RecordBatch:
        """Requests of a chunk: sorted keys with their documents and occurrences, by shard; its documents' own part
        goes to one of the shards."""
        names, before, lengths = stretch.take()
        owners = np.repeat(np.arange(len(heads), dtype=np.uint64), lengths)
        trusted = np.array([head[2] for head in heads], bool)
        # Log-probabilities if no bigram had been seen.
        ids, contexts = (np.where(each < RARER, each, UNKNOWN).astype(np.int64) for each in (names, before))
        unseen = np.log(known.lowest)[ids] + np.log(known.backoff)[contexts]
        base = np.bincount(owners.astype(np.int64), weights=unseen, minlength=len(heads))
        rows = []

        def send(kind: int, shard: int, both: np.ndarray, times: np.ndarray, as_context: np.ndarray | None = None) -> None:
            wide = np.uint32 if kind == FREQUENT_PAIR else np.uint64
            row = {
                "shard": shard,
                "chunk": chunk,
                "kind": kind,
                "keys": pack_sorted((both >> OWNER_BITS).astype(wide)),
                "owners": pack((both & OWNERS).astype(np.uint32)),
                "counts": pack(times.astype(np.uint32)),
                "trusted": np.packbits(trusted).tobytes(),
            }
            rows.append(row if as_context is None else row | {"as_context": pack(as_context.astype(np.uint32))})

        at, keys = frequent_pairs(before, names)
        both, times = asked_by(keys, owners[at])
        keys, owner = (both >> OWNER_BITS).astype(np.uint32), (both & OWNERS).astype(np.int64)
        hot, place = matched(known.hot_keys, keys)
        if len(hot):
            n = known.hot_counts[place] - np.where(trusted[owner[hot]], times[hot], 0)
            base += np.bincount(owner[hot], weights=known.gain(keys[hot], n) * times[hot], minlength=len(heads))
            both, times, keys = (np.delete(each, hot) for each in (both, times, keys))
        for shard, some in _split(shard_of(keys, shards), shards):
            send(FREQUENT_PAIR, shard, both[some], times[some])

        # Bigrams are looked up with their context, or their word if only that is rarer.
        at = np.flatnonzero((before | names) >= RARER)
        keys = place_of(pair_hash(before[at], names[at]), shards)[1]
        lead = np.where(before[at] >= RARER, before[at], names[at])
        for shard, some in _split(word_place(lead, shards)[0], shards):
            send(RARER_PAIR, shard, *asked_by(keys[some], owners[at[some]]))

        at = np.flatnonzero(names >= RARER)
        last = np.zeros(len(names), bool)
        last[np.cumsum(lengths)[lengths > 0] - 1] = True
        shard_of_word, keys = word_place(names[at], shards)
        for shard, some in _split(shard_of_word, shards):
            both, times = asked_by(keys[some], owners[at[some]])
            some = some[last[at[some]]]
            as_context = times.copy()  # the last word of a document is no context
            as_context[np.searchsorted(both, (keys[some] << OWNER_BITS) | owners[at[some]])] -= 1
            send(RARER_WORD, shard, both, times, as_context)

        heads = [(*head[:4], value, head[4]) for head, value in zip(heads, base.tolist(), strict=True)]
        table = pa.Table.from_pylist([dict(zip(_HEAD, head, strict=True)) for head in heads], _HEAD_TYPE)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as writer:
            writer.write_table(table)
        rows.append({"shard": chunk % shards, "chunk": chunk, "docs": sink.getvalue().to_pybytes()})
        return pa.RecordBatch.from_pylist(rows, _ASKED_TYPE)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        stretch, heads, size, chunk = Stretch(known.words), [], 0, None
        for batch in slices(batches):
            columns = (batch.column(name).to_pylist() for name in ("doc_id", "lang", "trusted", "place"))
            for doc, lang, trusted, partition, text in zip(*columns, texts_of(batch), strict=True):
                chunk = partition if chunk is None else chunk
                found = words_of(text)
                stretch.add(found)
                heads.append((doc, lang, trusted, len(found), known.toxicity(found, trusted)))
                size += len(found) + 20
                if size >= CHUNK_WORDS:
                    yield flush(known, chunk, stretch, heads)
                    heads, size, chunk = [], 0, chunk + 1
        if heads:
            yield flush(known, chunk, stretch, heads)

    def join(key: tuple, asked: pa.Table, table: pa.Table) -> pa.Table:
        known = shared.value
        plain = table.filter(table["key"].is_valid())
        have, numbers = plain["key"].to_numpy(), plain["n"].to_numpy()
        order = np.argsort(have, kind="stable")
        have, numbers = have[order], numbers[order]
        parts = [_unbundle(data) for data in table["part"].drop_null().to_pylist()]
        tails = [_unbundle(data) for data in table["tail"].drop_null().to_pylist()]
        rarer = ShardPart(parts[0], tails, known, shards) if parts else None
        rows = []
        for chunk, kind, docs, keys, owners, times, as_context, trusted in zip(
            *(asked[name].to_pylist() for name in ("chunk", "kind", *_ASKED_NAMES)), strict=True
        ):
            if docs is not None:
                rows.append({"chunk": chunk, "docs": docs})
                continue
            keys = unpack_sorted(keys, np.uint32 if kind == FREQUENT_PAIR else np.uint64)
            owners = unpack(owners, np.uint32)
            times = unpack(times, np.uint32).astype(np.int64)
            own = np.unpackbits(np.frombuffer(trusted, np.uint8))[owners].astype(np.int64) * times
            gains = np.zeros(len(keys))
            if kind == FREQUENT_PAIR:
                found, at = matched(have, keys.astype(np.int64))
                gains[found] = known.gain(keys[found], numbers[at] - own[found]) * times[found]
            elif rarer and kind == RARER_PAIR:
                found, at = matched(rarer.pairs[0], keys)
                _, n, unseen, totals = rarer.pairs
                gains[found] = known.above(n[at] - own[found], unseen[at], totals[at]) * times[found]
            elif rarer:
                found, at = matched(rarer.words[0], keys)
                gains[found] = rarer.words[1][at] * times[found]
                found, at = matched(rarer.contexts[0], keys)
                gains[found] += rarer.contexts[1][at] * unpack(as_context, np.uint32)[found]
            sums = np.bincount(owners, weights=gains)
            rows.append({"chunk": chunk, "sums": pack(sums.astype(np.float64))})
        return pa.Table.from_pylist(rows, _SUMS_TYPE)

    def finish(key: tuple, table: pa.Table) -> pa.Table:
        docs = next(data for data in table["docs"].to_pylist() if data is not None)
        heads = pa.ipc.open_stream(docs).read_all()
        total = heads["base"].to_numpy().copy()
        parts = sorted(data for data in table["sums"].to_pylist() if data is not None)
        for data in parts:  # in a fixed order, so that sums do not depend on the shuffle
            sums = unpack(data, np.float64)
            total[: len(sums)] += sums
        return pa.table(
            {
                "doc_id": heads["doc_id"],
                "lang": heads["lang"],
                "trusted": heads["trusted"],
                "n_words": heads["n_words"],
                "log_prob": pa.array(total),
                "toxicity": heads["toxicity"],
            }
        )

    asked = docs.select("doc_id", "lang", "trusted", "text", place).mapInArrow(ask, _ASKED)
    sums = (
        asked.groupBy("shard").cogroup(counts.groupBy("shard")).applyInArrow(join, "chunk bigint, docs binary, sums binary")
    )
    return sums.where("chunk is not null").groupBy("chunk").applyInArrow(
        finish, "doc_id bigint, lang string, trusted boolean, n_words bigint, log_prob double, toxicity double"
    )


_HEAD = ("doc_id", "lang", "trusted", "n_words", "base", "toxicity")
_HEAD_TYPE = pa.schema(
    [("doc_id", pa.int64()), ("lang", pa.string()), ("trusted", pa.bool_()), ("n_words", pa.int64())]
    + [("base", pa.float64()), ("toxicity", pa.float64())]
)
_SUMS_TYPE = pa.schema([("chunk", pa.int64()), ("docs", pa.binary()), ("sums", pa.binary())])


def classify(
    docs: DataFrame,
    labels: DataFrame,
    size: int = FREQUENT,
    quantile: float = QUANTILE,
    prior_words: int = PRIOR_WORDS,
) -> DataFrame:
    """``(doc_id, lang, trusted, n_words, perplexity, threshold, toxicity, toxic_threshold, rejected)`` per row of
    ``docs``."""
    small_batches(docs.sparkSession)
    cost = -F.col("log_prob") / F.col("n_words")
    with shuffles_removed(docs.sparkSession):
        scored = _scored(docs, labels, size)
        trusted = scored.where("trusted and n_words > 0").withColumn("cost", cost)
        middle = F.percentile_approx("cost", 0.5, 10_000)
        whole = trusted.agg(middle).first()[0]
        medians = materialise(trusted.groupBy("lang").agg(middle.alias("median")), "medians")
        if whole is None:
            none = F.lit(None).cast("double")
            bare = scored.withColumns({"median": none, "limit": none, "toxic_limit": none})
        else:
            bare = _with_limits(scored, medians, float(whole), quantile, prior_words)
    smooth = _smooth(prior_words)
    bad = (smooth > F.col("limit")) | (F.col("toxicity") > F.col("toxic_limit"))
    return bare.select(
        "doc_id",
        "lang",
        "trusted",
        "n_words",
        F.when(F.col("n_words") > 0, F.exp(cost)).alias("perplexity"),
        F.exp("limit").alias("threshold"),
        "toxicity",
        F.col("toxic_limit").alias("toxic_threshold"),
        F.coalesce((F.col("n_words") > 0) & bad, F.lit(False)).alias("rejected"),
    )


def _scored(docs: DataFrame, labels: DataFrame, size: int) -> DataFrame:
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    shards = 1 + chars // SHARD_CHARS
    rows = with_trust(docs, labels)
    model, counts = train(rows, shards, size)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    jobs = min(SLICES, shards)
    own = F.pmod(F.xxhash64("doc_id"), F.lit(jobs))
    parts = [materialise(score(rows.where(own == job), shared, counts, shards), "scores") for job in range(jobs)]
    shared.destroy()
    return reduce(DataFrame.unionByName, parts)


def _smooth(prior_words: int):
    return (-F.col("log_prob") + F.lit(prior_words) * F.col("median")) / (F.col("n_words") + prior_words)


def _by_lang(rows: DataFrame, table: DataFrame) -> DataFrame:
    """Join with a table of one row per language (null is one)."""
    named = table.withColumnRenamed("lang", "_lang")
    return rows.join(named, rows["lang"].eqNullSafe(named["_lang"]), "left").drop("_lang")


def _with_limits(
    scored: DataFrame, medians: DataFrame, whole: float, quantile: float, prior_words: int
) -> DataFrame:
    rows = _by_lang(scored, medians).withColumn("median", F.coalesce("median", F.lit(whole)))
    trusted = rows.where("trusted and n_words > 0").withColumn("smooth", _smooth(prior_words))
    trusted = trusted.withColumn("apart", F.col("smooth") - F.col("median"))

    def ends(column: str) -> tuple:
        middle, end = (F.percentile_approx(column, share, 10_000) for share in (0.5, quantile))
        return middle, end - middle

    middle, spread = ends("smooth")
    apart = ends("apart")[1]
    toxic = F.percentile_approx("toxicity", quantile, 10_000)
    for_all, reach, most = trusted.agg(middle + spread, apart, toxic).first()
    own = F.least(F.count("*") / ENOUGH, F.lit(1.0))
    limit = middle + own * spread + (1 - own) * reach
    own_toxic = F.when(F.count("*") >= ENOUGH, toxic).otherwise(F.greatest(toxic, F.lit(most)))
    ends_of = trusted.groupBy("lang").agg(limit.alias("limit"), own_toxic.alias("toxic_limit"))
    filled = {"limit": F.coalesce("limit", F.lit(for_all)), "toxic_limit": F.coalesce("toxic_limit", F.lit(most))}
    return _by_lang(rows, materialise(ends_of, "limits")).withColumns(filled)


def keep_good(docs: DataFrame, verdicts: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Documents that are not rejected. ``verdicts`` name them by ``id_col``: where ids repeat or are null,
    judge and name rows by a row key (``labels_by_row``)."""
    bad = verdicts.where("rejected").select(F.col("doc_id").alias("_bad_id"))
    bad = small_side(materialise(bad.where("_bad_id is not null").distinct(), "rejected"))
    return docs.join(bad, docs[id_col] == bad["_bad_id"], "left_anti")


def labels_by_row(docs: DataFrame, labels: DataFrame, row_col: str) -> DataFrame:
    """Labels of documents as labels of their rows: ``doc_id`` is the row key."""
    known = materialise(labels.select("doc_id", "quality", "toxic").distinct(), "labels")
    rows = docs.select("doc_id", F.col(row_col).alias("_row")).where("doc_id is not null")
    return rows.join(known, "doc_id").select(F.col("_row").alias("doc_id"), "quality", "toxic")
