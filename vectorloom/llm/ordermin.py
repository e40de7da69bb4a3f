"""Order-sensitive fingerprints of texts, in DataFrame operations.

A text is taken as its words; every ``k`` consecutive words (all of them, if fewer) are a k-mer. Equal k-mers of
a text are told apart by an occurrence number, so that each has a hash of its own. A fingerprint has ``PARTS``
parts. Part ``j`` belongs to one permutation of the hashes (their order from the ``j``-th of ``PARTS`` equal
steps of the hash range on, around its end): the ``CHOSEN`` smallest k-mers in that order are taken, put back in
the order in which they stand in the text, and their tuple is hashed to 16 bits. Two texts agree in a part if
they share its k-mers and have them in the same order; so the share of equal parts falls with moved words as
well as with changed ones.

All permutations are read off one sorted array: where a step of the hash range holds no k-mer, the next one
that does is taken. Work on a text is two sorts and some passes over its k-mers, inside its row.

An edited text needs the next document by order. Rows are numbered over their ids alone; a document is then
asked by its predecessor for the beginning of its text, so a text is shuffled once, and that beginning once.

Defined results: a null text is an empty one; texts without words have all parts zero; equal texts have equal
fingerprints, and so have texts that differ in white space only; rows of equal id are ordered by their place in
the table, rows without an id come first; one row is its own successor; extra columns do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectorloom.llm.native import bound, spaced_words
from vectorloom.plans.ordering import number_rows
from vectorloom.llm.rows import with_row_key
from vectorloom.session import materialise

KMER_WORDS = 3
# A power of two.
PARTS = 64
CHOSEN = 2
PART_DIGITS = 4
HASH_BITS = 60
HASHES = 1 << HASH_BITS
GOLDEN = 0x9E3779B1


def _right(value: Column, bits: Column | int) -> Column:
    return F.call_function("shiftright", value, bits if isinstance(bits, Column) else F.lit(bits))


def _left(value: Column, bits: Column | int) -> Column:
    return F.call_function("shiftleft", value, bits if isinstance(bits, Column) else F.lit(bits))


def _long(value: int) -> Column:
    return F.lit(value).cast("bigint")


def _at(array: str | Column, place: Column) -> Column:
    return F.coalesce(F.get(array, place.cast("int")), F.lit(0).cast("bigint"))


def _kmer_hash(checks: str, place: Column, k: int) -> Column:
    """60 bits of the checksums of ``k`` words; words beyond the last count as zero.

    Factors are below 2**28 and checksums below 2**32, so the sum of up to eight products is a long.
    """
    factors = [(GOLDEN * (2 * n + 1)) % (1 << 28) | 1 for n in range(k)]
    total = sum((_at(checks, place + n) * _long(factors[n]) for n in range(1, k)), _at(checks, place) * _long(factors[0]))
    return total.bitwiseAND(_long(HASHES - 1))


def _told_apart(value: Column, number: Column) -> Column:
    """The hash of a k-mer's occurrence ``number``; the first keeps that of the k-mer."""
    moved = _left((number.cast("bigint") * _long(GOLDEN)).bitwiseAND(_long((1 << 30) - 1)), HASH_BITS - 30)
    return (value + moved).bitwiseAND(_long(HASHES - 1))


def _with_place(value: Column, place: Column, bits: Column) -> Column:
    """A hash with its lowest bits replaced by a place (from one on) that fits into them."""
    return _left(_right(value, bits), bits).bitwiseOR(place.cast("bigint"))


def with_fingerprint(
    rows: DataFrame,
    text_col: str,
    name: str,
    k: int = KMER_WORDS,
    parts: int = PARTS,
    chosen: int = CHOSEN,
) -> DataFrame:
    """``rows`` with the fingerprint of a text column as a string of four hexadecimal digits a part.

    Steps are columns of their own and arrays are named twice or bound, so none is computed per element.
    """
    kept = [column for column in rows.columns if column != name]
    words = spaced_words(F.coalesce(F.col(text_col), F.lit("")))
    steps = rows.select(*kept, F.transform(words, lambda word: F.crc32(word)).alias("_checks"))
    last = F.greatest(F.size("_checks") - k, F.lit(0))
    hashes = F.transform(F.sequence(F.lit(0), last), lambda place: _kmer_hash("_checks", place, k))
    none = F.array().cast("array<bigint>")
    steps = steps.select(*kept, F.when(F.size("_checks") > 0, hashes).otherwise(none).alias("_hashes"))
    steps = steps.withColumns(
        {
            "_bits": F.length(F.bin(F.size("_hashes"))),
            "_repeats": F.size(F.array_distinct("_hashes")) < F.size("_hashes"),
        }
    )
    bits = F.col("_bits")
    mask = _left(_long(1), bits) - 1
    placed = F.transform("_hashes", lambda value, place: _with_place(value, place + 1, bits))
    steps = steps.withColumn("_places", F.sort_array(placed))

    # Only where a hash repeats: places of the sorted hashes at which another begins, and from them the
    # number of every occurrence, counted in the order of the text.
    def begins(place: Column) -> Column:
        here, before = _right(_at("_places", place), bits), _right(_at("_places", place - 1), bits)
        return (place == 0) | (here != before)

    every = F.sequence(F.lit(0), F.size("_places") - 1)
    steps = steps.withColumn("_runs", F.when(F.col("_repeats"), F.filter(every, begins)))
    until = lambda n: F.coalesce(F.get("_runs", n + 1), F.size("_places"))
    numbers = F.flatten(F.transform("_runs", lambda begin, n: F.sequence(F.lit(0), until(n) - begin - 1)))

    def told(occurrences: Column) -> Column:
        def one(packed: Column, n: Column) -> Column:
            place = packed.bitwiseAND(mask)
            own = _told_apart(_at("_hashes", place - 1), F.coalesce(F.get(occurrences, n), F.lit(0)))
            return _with_place(own, place, bits)

        return F.transform("_places", one)

    values = F.when(F.col("_repeats"), F.sort_array(bound(numbers, told))).otherwise(F.col("_places"))
    steps = steps.withColumn("_values", values)
    # Where each permutation begins among the sorted values: its step is sorted in with them. No value
    # ends in zeros as a step does, as its place is one or more.
    step = HASH_BITS - (parts.bit_length() - 1)
    steps_of = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda part: _left(part.cast("bigint"), step))
    merged = F.sort_array(F.concat("_values", steps_of))
    is_step = lambda value: value.bitwiseAND(_long((1 << step) - 1)) == 0
    found = F.array_compact(F.transform(merged, lambda value, n: F.when(is_step(value), n)))
    steps = steps.withColumn("_begins", F.transform(found, lambda at, part: at - part))

    def tuple_hash(begin: Column) -> Column:
        members = (
            _at("_values", (begin + n) % F.size("_values")).bitwiseAND(mask) for n in range(chosen)
        )
        in_text = lambda places: F.concat_ws(",", *(_at("_hashes", F.get(places, n) - 1) for n in range(chosen)))
        return F.substring(F.md5(bound(F.sort_array(F.array(*members)), in_text)), 1, PART_DIGITS)

    joined = F.array_join(F.transform("_begins", tuple_hash), "")
    empty = F.lit("0" * (PART_DIGITS * parts))
    return steps.select(*kept, F.when(F.size("_hashes") > 0, joined).otherwise(empty).alias(name))


def likeness(left: str, right: str, parts: int = PARTS) -> Column:
    """Share of equal parts of two fingerprints."""

    def equal(part: Column) -> Column:
        at = part * PART_DIGITS + 1
        return F.col(left).substr(at, F.lit(PART_DIGITS)) == F.col(right).substr(at, F.lit(PART_DIGITS))

    return F.size(F.filter(F.sequence(F.lit(0), F.lit(parts - 1)), equal)) / F.lit(float(parts))


def successors(rows: DataFrame, order: str, row: str, length: str) -> DataFrame:
    """``(asker, order, ask, row)``: every row, half its length and the next row; the first follows the last."""
    numbered = materialise(number_rows(rows, [], [order, row], "_position"), "numbered")
    count = F.lit(numbered.count())
    after = numbered.select(F.pmod(F.col("_position") - 1, count).alias("_position"), row)
    ask = F.floor(F.col(length) / 2).cast("int").alias("ask")
    own = numbered.select("_position", F.col(row).alias("asker"), order, ask)
    return materialise(own.join(after, "_position").drop("_position"), "successors")


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document beside its edited text, in which the second half is the beginning of the next document.

    Returns the id, ``text``, ``edited``, ``fingerprint``, ``edited_fingerprint``, ``next_fingerprint`` and the
    likeness of the fingerprint to both.
    """
    narrow = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = with_row_key(narrow, "row")
    links = successors(rows.select("id", "row", F.length("text").alias("n")), "id", "row", "n")
    # Both joins read the same columns of this table, so they share one shuffle of the texts.
    marked = with_fingerprint(rows.select("row", "text"), "text", "fingerprint")
    begins = marked.join(links, "row").select(
        F.col("asker").alias("row"),
        "id",
        F.col("text").substr(F.lit(1), F.col("ask")).alias("begin"),
        F.col("fingerprint").alias("next_fingerprint"),
    )
    size = F.length("text")
    cut = F.col("text").substr(F.lit(1), size - F.floor(size / 2).cast("int"))
    paired = marked.join(begins, "row").select(
        F.col("id").alias(id_col), "text", F.concat(cut, "begin").alias("edited"), "fingerprint", "next_fingerprint"
    )
    both = with_fingerprint(paired, "edited", "edited_fingerprint")
    return both.select(
        "*",
        likeness("fingerprint", "edited_fingerprint").alias("near_edited"),
        likeness("fingerprint", "next_fingerprint").alias("near_next"),
    )
