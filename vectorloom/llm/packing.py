"""Best-fit packing of documents into training sequences, with conflicts.

A bin (sequence) holds ``capacity`` words and at most one document of a source and one of a duplicate
cluster. Open bins are kept in order of what is left in them, each with a bitmap of its sources and one
of its clusters. A document, longest first, goes to the tightest bin that it fits in and does not
conflict with: the search starts at the first bin with enough room and goes on to its successors.

Packing is done in batches of ``BATCH`` documents, which are dealt by id; only ids, sources, clusters and
lengths move, and a task holds one batch. A hot source costs bins (it needs one per document), not memory:
batches of a partition are cut off its stream by number.

Defined results: a document longer than a bin is cut into full pieces and a rest, all in different bins; a document
without words is in no bin (null); a null source or cluster conflicts with nothing; repeated rows are packed
one by one (in different bins, as they are duplicates); extra columns are ignored.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectorloom.llm.rows import with_row_index
from vectorloom.session import materialise

CAPACITY = 2048
BATCH = 4096

PACKED = "doc_id bigint, piece int, first_word bigint, n_words bigint, bin_id bigint, position int"
_PACKED_TYPE = pa.schema(
    [("doc_id", pa.int64()), ("piece", pa.int32()), ("first_word", pa.int64()), ("n_words", pa.int64())]
    + [("bin_id", pa.int64()), ("position", pa.int32())]
)


class Bins:
    """Open bins in order of the room that is left."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.order: list[tuple[int, int]] = []  # (room, bin)
        self.sources: list[int] = []
        self.clusters: list[int] = []
        self.members: list[int] = []

    def place(self, need: int, source: int, cluster: int) -> tuple[int, int]:
        """Bin and position of a piece; ``source`` and ``cluster`` are bits, or zero for none."""
        at = bisect.bisect_left(self.order, (need, -1))
        while at < len(self.order):
            room, number = self.order[at]
            if not self.sources[number] & source and not self.clusters[number] & cluster:
                del self.order[at]
                break
            at += 1
        else:
            room, number = self.capacity, len(self.members)
            self.sources.append(0)
            self.clusters.append(0)
            self.members.append(0)
        self.sources[number] |= source
        self.clusters[number] |= cluster
        position = self.members[number]
        self.members[number] += 1
        if room > need:
            bisect.insort(self.order, (room - need, number))
        return number, position


def pack_batch(rows: list[tuple], capacity: int) -> list[tuple]:
    """``(doc, piece, first word, words, bin, position)`` for rows ``(doc, source, cluster, words)``."""
    source_bits: dict = {}
    cluster_bits: dict = {}
    for _, source, cluster, _ in rows:
        if source is not None:
            source_bits.setdefault(source, 1 << len(source_bits))
        if cluster is not None:
            cluster_bits[cluster] = cluster_bits.get(cluster, 0) + 1
    repeated = [cluster for cluster, count in cluster_bits.items() if count > 1]
    cluster_bits = {cluster: 1 << bit for bit, cluster in enumerate(repeated)}
    pieces = []
    for number, (doc, source, cluster, words) in enumerate(rows):
        whole, rest = divmod(words, capacity)
        for piece in range(whole + (rest > 0)):
            size = min(capacity, words - piece * capacity)
            bits = (source_bits.get(source, 0), cluster_bits.get(cluster, 0))
            pieces.append((-size, number, piece, doc, bits))
    bins = Bins(capacity)
    placed = []
    for size, _, piece, doc, (source, cluster) in sorted(pieces, key=lambda p: p[:3]):
        number, position = bins.place(-size, source, cluster)
        placed.append((doc, piece, piece * capacity, -size, number, position))
    return placed


def pack_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    cluster_col: str | None = None,
    capacity: int = CAPACITY,
    batch_rows: int = BATCH,
) -> DataFrame:
    """Pieces of documents with their bin and their position in it.

    Without ``cluster_col`` documents of equal lower-cased text form a duplicate cluster.
    """
    cluster = F.xxhash64(F.lower(text_col)) if cluster_col is None else F.xxhash64(cluster_col)
    known = F.col(text_col if cluster_col is None else cluster_col)
    words = F.size(F.filter(F.split(text_col, r"[\x20\x09-\x0D]+"), lambda word: word != ""))
    rows = materialise(
        docs.select(
            F.col(id_col).cast("bigint").alias("doc_id"),
            F.col(source_col).cast("string").alias("source"),
            F.when(known.isNotNull(), cluster).alias("cluster"),
            F.when(F.col(text_col).isNull(), 0).otherwise(words).cast("bigint").alias("n_words"),
        ),
        "lengths",
    )
    partitions = 1 + rows.count() // (8 * batch_rows)
    dealt = (
        with_row_index(rows, "_place")
        .where("n_words > 0")
        .withColumn("_deal", F.xxhash64("doc_id", "_place"))  # rows of one id are parted as well
        .repartition(partitions, "_deal")
        .sortWithinPartitions("_deal", "doc_id", "source", "cluster", "n_words")
        .withColumn("place", F.spark_partition_id().cast("bigint") * F.lit(1 << 40))
    )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        first = None

        def flush(part: list[tuple]) -> pa.RecordBatch:
            nonlocal first
            placed = pack_batch(part, capacity)
            base, first = first, first + 1 + max(row[4] for row in placed)
            columns = list(zip(*placed, strict=True))
            columns[4] = [base + number for number in columns[4]]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(columns, _PACKED_TYPE, strict=True)], _PACKED_TYPE.names
            )

        for batch in batches:
            names = ("doc_id", "source", "cluster", "n_words")
            held.extend(zip(*(batch.column(name).to_pylist() for name in names), strict=True))
            if first is None and batch.num_rows:
                first = batch.column("place")[0].as_py()
            while len(held) >= batch_rows:
                yield flush(held[:batch_rows])
                held = held[batch_rows:]
        if held:
            yield flush(held)

    none = rows.where("n_words = 0").select(
        "doc_id",
        F.lit(0).alias("piece"),
        F.lit(0).cast("bigint").alias("first_word"),
        "n_words",
        F.lit(None).cast("bigint").alias("bin_id"),
        F.lit(None).cast("int").alias("position"),
    )
    return dealt.mapInArrow(pack, PACKED).unionByName(none)
