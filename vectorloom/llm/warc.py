r"""WARC archives: writing, reading, and revisit records for repeated payloads.

Archives are gzip-compressed WARC/1.1 files, written and read by Spark's text source: a record's trailer
(two line ends) is the line separator, which also ends both headers of a record. Compressed files are not split, so
the pieces of a file arrive in order, and a record is put together from as many bytes as its ``Content-Length``
says, wherever its payload was split. A task holds one record at a time, whatever the size of an archive. Archives are
compressed at zlib's fastest level, which takes less than half the time of its default.

Deduplication shuffles record headers by payload digest: the response with the smallest page id stays,
equal payloads of at least ``min_bytes`` become revisit records that refer to it. Revisits and originals
are joined by record id when archives are read back.

Defined results: a null payload is an empty one; a null url has no target header; line ends in a url are
percent-encoded; a record without a page id stays a response unless another one has its payload and an id;
of rows that repeat a page id the first by record id is the response; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vectorloom.llm.arrays import slices, small_batches
from vectorloom.session import lookup_table, materialise, scratch_path

END = "\r\n"
TRAILER = (END + END).encode()
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"

RECORD = (
    "record_id string, record_type string, page_id bigint, url string, payload string, "
    "payload_bytes bigint, payload_digest string, refers_to_record string"
)


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def responses(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html"
) -> DataFrame:
    """Response records of pages; ids of records are drawn here and fixed once archives are written."""
    small_batches(pages.sparkSession)
    rows = pages.select(
        F.col(id_col).cast("bigint").alias("page_id"),
        F.col(url_col).alias("url"),
        F.coalesce(payload_col, F.lit("")).alias("payload"),
        F.monotonically_increasing_id().alias("place"),
    )

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            payloads = [text.encode() for text in batch.column("payload").to_pylist()]
            digests = [payload_digest(payload) for payload in payloads]
            ids = [
                str(uuid.uuid5(uuid.NAMESPACE_URL, f"{place}/{page}/{digest}"))
                for place, page, digest in zip(
                    batch.column("place").to_pylist(), batch.column("page_id").to_pylist(), digests, strict=True
                )
            ]
            count = len(payloads)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.string()),
                    pa.array(["response"] * count, pa.string()),
                    batch.column("page_id"),
                    batch.column("url"),
                    batch.column("payload"),
                    pa.array([len(payload) for payload in payloads], pa.int64()),
                    pa.array(digests, pa.string()),
                    pa.nulls(count, pa.string()),
                ],
                [field.split()[0] for field in RECORD.split(", ")],
            )

    return rows.mapInArrow(make, RECORD)


def _header(name: str, value: Column) -> Column:
    """A header line, or nothing for a null value."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(END)), F.lit(""))


def _one_line(value: Column) -> Column:
    return F.replace(F.replace(value, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def record_text(http: str = "HTTP/1.1 200 OK") -> Column:
    """A record as text, up to its trailer."""
    response = F.col("record_type") == "response"
    block = F.concat(
        F.lit(http + END),
        F.lit("Content-Type: text/html; charset=utf-8" + END),
        _header("Content-Length", F.col("payload_bytes").cast("string")),
        F.lit(END),
        F.when(response, F.col("payload")).otherwise(F.lit("")),
    )
    return F.concat(
        F.lit("WARC/1.1" + END),
        _header("WARC-Type", F.col("record_type")),
        _header("WARC-Record-ID", F.concat(F.lit("<urn:uuid:"), F.col("record_id"), F.lit(">"))),
        _header("WARC-Date", F.lit(DATE)),
        _header("WARC-Target-URI", _one_line(F.col("url"))),
        _header("WARC-Page-ID", F.col("page_id").cast("string")),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        _header("WARC-Profile", F.when(~response, F.lit(PROFILE))),
        _header(
            "WARC-Refers-To", F.concat(F.lit("<urn:uuid:"), F.col("refers_to_record"), F.lit(">"))
        ),
        F.lit("Content-Type: application/http; msgtype=response" + END),
        _header("Content-Length", F.octet_length(block).cast("string")),
        F.lit(END),
        block,
    )


def write_archives(records: DataFrame, path: str | None = None) -> str:
    """Write records to archives, one per partition; gives their folder."""
    path = path or scratch_path(records.sparkSession, "warc")
    texts = records.select(record_text().alias("value"))
    texts.write.options(lineSep=END + END, compression="gzip").option("zlib.compress.level", "BEST_SPEED").text(path)
    return path


class _Reader:
    """Puts records together from the pieces of one archive."""

    def __init__(self) -> None:
        self.head: dict[str, str] | None = None
        self.held: list[bytes] = []
        self.size = self.missing = 0

    def feed(self, piece: bytes) -> Iterator[tuple]:
        """Records that end in this piece. A piece that is read had a separator behind it, which may belong to a
        payload, as may the line ends at the start of the next piece."""
        self.held += (piece, TRAILER)
        self.size += len(piece) + len(TRAILER)
        if self.size < self.missing:
            return
        data = b"".join(self.held)
        while True:
            if self.head is None:
                data = data.lstrip(TRAILER)
                if not data:
                    break
                head, _, data = data.partition(TRAILER)
                self.head = self._fields(head.decode())
                self.missing = int(self.head["content-length"]) + len(TRAILER)
            if len(data) < self.missing:
                break
            block, data = data[: self.missing], data[self.missing :]
            if not block.endswith(TRAILER):
                raise ValueError(f"record {self.head.get('warc-record-id')} is longer than it says")
            yield self._record(block[: -len(TRAILER)])
            self.head, self.missing = None, 0
        self.held, self.size = [data], len(data)

    @staticmethod
    def _fields(head: str) -> dict[str, str]:
        first, *lines = head.split(END)
        if first != "WARC/1.1":
            raise ValueError(f"not the start of a record: {first[:80]!r}")
        return {name.lower(): value for name, _, value in (line.partition(": ") for line in lines)}

    def _record(self, block: bytes) -> tuple:
        head = self.head
        http, _, payload = block.partition(TRAILER)
        size = next(
            (int(h.partition(": ")[2]) for h in http.decode().split(END) if h.startswith("Content-Length: ")), 0
        )
        page = head.get("warc-page-id")
        digest = head["warc-payload-digest"].removeprefix("sha1:")
        response = head["warc-type"] == "response"
        if response and (len(payload) != size or payload_digest(payload) != digest):
            raise ValueError(f"payload of {head['warc-record-id']} does not match its header")
        return (
            _uuid(head["warc-record-id"]),
            head["warc-type"],
            None if page is None else int(page),
            head.get("warc-target-uri"),
            payload if response else None,
            size,
            digest,
            _uuid(head["warc-refers-to"]) if "warc-refers-to" in head else None,
        )


def _uuid(field: str) -> str:
    return field.removeprefix("<urn:uuid:").removesuffix(">")


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Records of the archives in a folder, checked against their digests. Without ``payloads`` these are null, once
    they have been checked."""
    small_batches(spark)
    pieces = (
        spark.read.option("lineSep", END + END)
        .schema("value string")
        .text(path)
        .select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"))
    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, current = _Reader(), None
        names = [field.split()[0] for field in RECORD.split(", ")]
        types = [pa.int64() if " bigint" in field else pa.string() for field in RECORD.split(", ")]
        for batch in batches:
            found = []
            for piece, file in zip(
                batch.column("value").to_pylist(), batch.column("file").to_pylist(), strict=True
            ):
                if file != current:
                    if reader.head is not None:
                        raise ValueError(f"{current} ends inside a record")
                    reader, current = _Reader(), file
                found.extend(reader.feed(piece))
            columns = dict(zip(names, zip(*found, strict=True), strict=True)) if found else dict.fromkeys(names, ())
            arrays = {name: pa.array(columns[name], kind) for name, kind in zip(names, types, strict=True) if name != "payload"}
            held = pa.array(columns["payload"], pa.binary()) if payloads else pa.nulls(len(found), pa.binary())
            arrays["payload"] = held.cast(pa.string())
            yield pa.RecordBatch.from_arrays([arrays[name] for name in names], names)
        if reader.head is not None:
            raise ValueError(f"{current} ends inside a record")

    return pieces.mapInArrow(read, RECORD)


def deduplicate(path: str, out: str | None = None, min_bytes: int = 0) -> str:
    """Write archives in which repeated payloads are revisit records; gives their folder."""
    spark = SparkSession.active()
    records = read_archives(spark, path)
    order = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "record_id")
    headers = read_archives(spark, path, payloads=False)
    headers = headers.where((F.col("record_type") == "response") & (F.col("payload_bytes") >= min_bytes))
    headers = headers.select("payload_digest", "payload_bytes", "page_id", "record_id")
    firsts = headers.groupBy("payload_digest", "payload_bytes").agg(
        F.min(order).alias("first"), F.count("*").alias("n")
    )
    originals = lookup_table(
        firsts.where("n > 1").select(
            "payload_digest", "payload_bytes", F.col("first.record_id").alias("original")
        )
    )
    joined = records.join(originals, ["payload_digest", "payload_bytes"], "left")
    revisit = (F.col("record_type") == "revisit") | (F.col("original") != F.col("record_id"))
    fresh = joined.select(
        "record_id",
        F.when(F.coalesce(revisit, F.lit(False)), F.lit("revisit")).otherwise(F.lit("response")).alias("record_type"),
        "page_id",
        "url",
        "payload",
        "payload_bytes",
        "payload_digest",
        F.coalesce(
            F.when(F.col("original") != F.col("record_id"), F.col("original")), F.col("refers_to_record")
        ).alias("refers_to_record"),
    )
    return write_archives(fresh, out)


def resolve(records: DataFrame) -> DataFrame:
    """Records with ``refers_to``: the page id of the response that a revisit record refers to."""
    records = materialise(records.drop("payload"), "warc-heads")
    originals = lookup_table(
        records.where("refers_to_record is not null")
        .select(F.col("refers_to_record").alias("record_id"))
        .distinct()
        .join(records.where("record_type = 'response'"), "record_id")
        .select(F.col("record_id").alias("refers_to_record"), F.col("page_id").alias("refers_to"))
    )
    return records.join(originals, "refers_to_record", "left")
