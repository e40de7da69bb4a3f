"""Chunk rules on CJK and edge-case texts, which the driver's tables do not hold."""

import tracemalloc

import duckdb
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vectorloom.catalog import text_queries as sql
from vectorloom.operators.chunking import (
    _nested_chunks,
    chunk_by_size,
    chunk_documents,
    chunk_files,
    split_text,
)
from vectorloom.sources.byte_streams import read_pieces
from vectorloom.sources.files import scan_knowledge_files

SIZE, OVERLAP = 1000, 100


def chunks(text, mode="tiered"):
    return split_text(text, mode, SIZE, OVERLAP)


def test_short_texts_stay_untouched():
    assert chunks("") == [] and chunks(None) == []
    assert chunks("  a \n") == ["  a \n"]
    assert chunks("x" * 1000) == ["x" * 1000]


def test_no_break_character_cuts_at_size_and_overlaps_from_the_second_cut():
    text = "".join(chr(97 + i % 26) for i in range(2500))
    # No overlap at the first boundary; 100 characters at the second.
    assert chunks(text) == [text[:1000], text[1000:2000], text[1900:]]


def test_one_character_too_many():
    text = "x" * 1001
    assert chunks(text) == ["x" * 1000, "x"]


def test_sentence_end_beats_closer_comma():
    text = "字" * 930 + "。" + "字" * 60 + "，" + "字" * 500
    assert chunks(text)[0] == "字" * 930 + "。"


def test_comma_is_searched_in_fifty_and_space_in_twenty_characters():
    far_comma = "字" * 940 + "，" + "字" * 500
    assert len(chunks(far_comma)[0]) == 1000
    near_comma = "字" * 960 + "，" + "字" * 500
    assert len(chunks(near_comma)[0]) == 961
    near_space = "x" * 985 + " " + "x" * 500
    assert chunks(near_space)[0] == "x" * 985
    assert len(chunks(near_space, "sentence")[0]) == 1000


def test_break_at_the_cut_position_itself_counts():
    text = "字" * 1000 + "。" + "字" * 300
    assert chunks(text)[0] == "字" * 1000 + "。"


def test_lookahead_searches_both_sides():
    text = "字" * 1080 + "！" + "字" * 300
    first, second = chunks(text, "lookahead")
    assert first == "字" * 1080 + "！"
    assert second == "字" * 99 + "！" + "字" * 300
    assert chunks("y" * 1000, "lookahead") == ["y" * 1000]
    assert chunks("   ", "lookahead") == []


def test_nested_cuts_long_pieces_again():
    text = "字" * 1080 + "！" + "字" * 300
    assert [len(piece) for piece in chunks(text, "nested")] == [1000, 81, 400]


TEXTS = st.lists(
    st.sampled_from(["字" * 37, "word", " ", "，", "。", "\n", "x" * 90, "：", "é" * 250, "  "]),
    min_size=0,
    max_size=60,
).map("".join)


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_properties(text):
    for mode, longest in (("tiered", SIZE + 1), ("sentence", SIZE + 1), ("lookahead", SIZE + 101)):
        pieces = chunks(text, mode)
        if len(text) > SIZE:
            assert all(piece.strip() for piece in pieces)
            assert all(len(piece) <= longest for piece in pieces)


@settings(max_examples=100, deadline=None)
@given(TEXTS)
def test_every_character_is_covered(text):
    # Letters become distinct characters, so covering them all is a set comparison.
    breaks = set("。！？\n，、；： ")
    marked = "".join(c if c in breaks else chr(0x20000 + i) for i, c in enumerate(text))
    for mode in ("tiered", "sentence", "lookahead", "nested"):
        pieces = chunks(marked, mode)
        assert set("".join(pieces)) - breaks == set(marked) - breaks


def _sql_chunks(texts, steps, whole):
    connection = duckdb.connect()
    connection.register("inline", pd.DataFrame({"k": range(len(texts)), "body": texts}))
    numbered = sql._numbered("steps", "k", whole)
    rows = connection.execute(
        f"WITH RECURSIVE steps AS ({steps.replace('{name}', 'steps')}) "
        f"SELECT k, piece FROM ({numbered}) ORDER BY k, n"
    ).fetchall()
    found = [[] for _ in texts]
    for key, piece in rows:
        found[key].append(piece)
    return found


@settings(max_examples=20, deadline=None)
@given(st.lists(TEXTS, min_size=1, max_size=5))
def test_equal_to_the_recursive_statement(texts):
    backward = sql.sql_backward_chunks("inline", "k", "body")
    assert _sql_chunks(texts, backward, sql._whole("inline", "k", "body")) == [
        chunks(text) for text in texts
    ]
    lookahead = sql.sql_lookahead_chunks("inline", "k", "body")
    assert _sql_chunks(texts, lookahead, "") == [chunks(text, "lookahead") for text in texts]


def test_too_small_chunks_are_refused(spark):
    rows = spark.createDataFrame([(1, "x")], "doc_id long, content string")
    with pytest.raises(ValueError):
        chunk_documents(rows, size=200, overlap=100)
    with pytest.raises(ValueError):
        chunk_documents(rows, mode="other")


def test_chunk_rows(spark):
    rows = spark.createDataFrame(
        [(1, "a", "x" * 1500), (2, "b", ""), (3, "c", None), (4, "d", "short")],
        "doc_id long, tag string, content string",
    )
    got = sorted(tuple(r) for r in chunk_documents(rows).select("tag", "chunk_id", "chunk_index").collect())
    assert got == [("a", "1_chunk_1", 1), ("a", "1_chunk_2", 2), ("d", "4_chunk_1", 1)]


def test_by_size_switches_mode(spark):
    text = "字" * 1080 + "！" + "字" * 300
    rows = spark.createDataFrame([(1, 10, text), (2, 99, text)], "doc_id long, length long, content string")
    got = {}
    for row in chunk_by_size(rows, cap=50).orderBy("chunk_index").collect():
        got.setdefault(row["doc_id"], []).append(row["content"])
    assert got == {1: chunks(text), 2: chunks(text, "nested")}


@settings(max_examples=60, deadline=None)
@given(TEXTS, st.integers(1, 700))
def test_pieces_give_the_chunks_of_the_whole_text(text, width):
    pieces = [text[i : i + width] for i in range(0, len(text), width)]
    assert list(_nested_chunks(pieces, SIZE, OVERLAP)) == chunks(text, "nested")


def test_characters_cut_by_a_piece(tmp_path):
    text = "a字é😀" * 50
    (tmp_path / "f").write_text(text, encoding="utf-8")
    for width in (1, 2, 3, 7, 1000):
        assert "".join(read_pieces(f"file:{tmp_path}/f", width)) == text
    (tmp_path / "f").write_bytes(b"a\xff\xe5")
    assert "".join(read_pieces(str(tmp_path / "f"), 1)) == "a\ufffd\ufffd"


def test_large_files_are_chunked_without_being_held(spark, tmp_path):
    sentence = "Ein Satz mit Wörtern, 字 und 😀. "
    (tmp_path / "big one%20.md").write_text(sentence * 250_000, encoding="utf-8")
    (tmp_path / "small.md").write_text(sentence * 60, encoding="utf-8")
    (tmp_path / "empty.md").write_text("")
    files = scan_knowledge_files(spark, str(tmp_path)).selectExpr("path", "length", "7 AS doc_id", "'t' AS title")
    files = files.unionByName(files.where("path LIKE '%small%'").selectExpr(
        "path", "CAST(NULL AS bigint) AS length", "8 AS doc_id", "title"))
    files = files.unionByName(spark.createDataFrame([(None, 5, 9, "t")], files.schema))
    got = {}
    for row in chunk_files(files, cap=5_000).orderBy("doc_id", "path", "chunk_index").collect():
        found = got.setdefault((row["doc_id"], row["path"].rsplit("/", 1)[1]), [])
        found.append(row["content"])
        assert row["chunk_id"] == f"{row['doc_id']}_chunk_{len(found)}" and row["title"] == "t"
    assert got == {
        (7, "big one%20.md"): chunks(sentence * 250_000, "nested"),
        (7, "small.md"): chunks(sentence * 60),
        (8, "small.md"): chunks(sentence * 60),
    }


def test_memory_of_a_large_file_is_bounded(tmp_path):
    with open(tmp_path / "f", "w") as out:
        for _ in range(30):
            out.write("no break at all " * 65_536)
    tracemalloc.start()
    count = sum(1 for _ in _nested_chunks(read_pieces(str(tmp_path / "f")), SIZE, OVERLAP))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert count > 30_000 and peak < 12 << 20


def test_batches_of_long_texts_are_small(spark):
    keys = [f"spark.sql.execution.arrow.{name}" for name in ("maxRecordsPerBatch", "maxBytesPerBatch")]
    before = {key: spark.conf.get(key) for key in keys}
    seen = []

    @F.pandas_udf("bigint")
    def together(texts: pd.Series) -> pd.Series:
        return pd.Series([int(texts.str.len().sum())] * len(texts))

    try:
        for key, value in zip(keys, ("10000", "268435456")):
            spark.conf.set(key, value)
        long = spark.range(0, 3000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 4000).alias("content"))
        chunked = chunk_documents(long)
        seen = [row[0] for row in long.select(together("content").alias("n")).distinct().collect()]
        assert chunked.where("chunk_index = 1").count() == 3000
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    assert max(seen) < 10_000_000  # 60 million characters in all


def test_many_small_files_are_few_tasks(spark, tmp_path):
    for i in range(200):
        (tmp_path / f"{i}.md").write_text(f"text {i}")
    files = scan_knowledge_files(spark, str(tmp_path)).selectExpr("path", "length", "7 AS doc_id")
    cores = spark.sparkContext.defaultParallelism
    assert files.rdd.getNumPartitions() <= cores
    chunks = chunk_files(files)
    assert chunks.rdd.getNumPartitions() <= 4 * cores
    assert {row["content"] for row in chunks.collect()} == {f"text {i}" for i in range(200)}
    assert chunk_files(files.limit(0)).count() == 0
