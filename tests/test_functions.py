import datetime

import pytest
from pyspark.sql import functions as F

from vectorloom.functions import text, tokens, vectors
from vectorloom.operators.batching import assign_batches, optimal_batch_size
from vectorloom.operators.embedding import (
    HashEncoder,
    VectorTable,
    embed_distinct,
    embed_kept,
    embed_text,
    hash_encode,
)


def _one(spark, column):
    return spark.range(1).select(column.alias("v")).head()["v"]


@pytest.mark.parametrize(
    "body, main, other",
    [("", 1, 1), ("ab", 1, 1), ("abcdef", 2, 1), ("中文字", 4, 3), ("中abc", 2, 1), ("中文ab", 3, 2)],
)
def test_token_estimates(spark, body, main, other):
    assert _one(spark, tokens.token_estimate(F.lit(body))) == main
    assert _one(spark, tokens.token_estimate_alt(F.lit(body))) == other


def test_length_bucket(spark):
    got = [_one(spark, tokens.length_bucket(F.lit(n))) for n in (1, 64, 65, 256, 257)]
    assert got == ["short", "short", "medium", "medium", "long"]


@pytest.mark.parametrize(
    "path, stem, suffix",
    [
        ("/k/a.b.md", "a.b", ".md"),
        ("/k/README", "README", ""),
        ("/k/.md", ".md", ""),
        ("/k/表单_1.MD", "表单_1", ".MD"),
        ("a.", "a.", ""),
    ],
)
def test_paths(spark, path, stem, suffix):
    assert _one(spark, text.file_stem(F.lit(path))) == stem
    assert _one(spark, text.file_suffix(F.lit(path))) == suffix


def test_strip_and_blank(spark):
    assert _one(spark, text.strip(F.lit("　 \n a b\t "))) == "a b"
    assert _one(spark, text.is_blank(F.lit(" 　\n")))
    assert not _one(spark, text.is_blank(F.lit(" x")))


def test_safe_file_name(spark):
    assert _one(spark, text.safe_file_name(F.lit('a<>:"/\\|?*b'))) == "a_________b"


def test_relative_time(spark):
    now = F.lit(datetime.datetime(2024, 1, 10, 12, 0, 0))

    def age(**back):
        ts = F.lit(datetime.datetime(2024, 1, 10, 12, 0, 0) - datetime.timedelta(**back))
        return _one(spark, text.relative_time(ts, now))

    assert [age(seconds=59), age(minutes=5), age(hours=23), age(days=6), age(days=8)] == [
        "刚刚", "5分钟前", "23小时前", "6天前", "2024-01-02",
    ]


def test_normalize_keeps_the_zero_vector(spark):
    assert _one(spark, vectors.l2_normalize(F.array(F.lit(3.0), F.lit(4.0)))) == [0.6, 0.8]
    assert _one(spark, vectors.l2_normalize(F.array(F.lit(0.0), F.lit(0.0)))) == [0.0, 0.0]


def test_masked_mean_without_any_mask_is_zero(spark):
    rows = spark.createDataFrame(
        [("a", [1.0, 2.0], 1), ("a", [3.0, 6.0], 1), ("a", [9.0, 9.0], 0), ("b", [5.0, 5.0], 0)],
        "id string, v array<float>, m int",
    )
    got = rows.groupBy("id").agg(vectors.masked_mean(F.col("v"), F.col("m")).alias("mean"))
    assert dict(tuple(row) for row in got.collect()) == {"a": [2.0, 4.0], "b": [0.0, 0.0]}


def test_encoders_agree_and_reuse(spark):
    rows = spark.createDataFrame(
        [(1, "a b a"), (2, "a b a"), (3, "数据 结构"), (4, " \n"), (5, None), (6, "")],
        "id long, content string",
    )
    by_row = {r["id"]: r["embedding"] for r in embed_text(rows).collect()}
    by_text = {r["id"]: r["embedding"] for r in embed_distinct(rows).collect()}
    native = {r["id"]: r["embedding"] for r in hash_encode(rows, "id", "content").collect()}
    assert by_row == by_text
    assert by_row[1] == by_row[2] and by_row[4] is None and by_row[5] is None and by_row[6] is None
    assert native == {key: by_row[key] for key in (1, 2, 3)}


def test_kept_vectors_are_not_encoded_again(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    class Counting(HashEncoder):
        def encode(self, texts):
            seen.add(len(texts))
            return super().encode(texts)

    def job(rows, kept, name="content"):
        before = seen.value
        table = spark.createDataFrame(rows, f"digest long, {name} string")
        found, report = embed_kept(table, kept, Counting, name)
        got = {r["digest"]: r["embedding"] for r in found.collect()}
        plain = {r["digest"]: r["embedding"] for r in embed_distinct(table, text=name).collect()}
        assert got == plain and found.columns == ["digest", name, "embedding"]
        return seen.value - before, tuple(report.select("size", "hits", "misses", "total").first())

    kept = VectorTable(str(tmp_path), "hash/64 v1")
    first = [(1, "a b"), (2, "a b"), (3, "c"), (4, None), (5, " ")]
    assert job(first, kept) == (3, (2, 1, 3, 4))
    # The blank text was refused and is tried again; everything else is known.
    assert job(first * 2, kept, "vector") == (1, (2, 7, 1, 8))
    assert job([(1, "a b"), (6, "d"), (7, "d")], kept) == (1, (3, 2, 1, 3))
    assert job([(1, None)], kept) == (0, (3, 0, 0, 0))
    assert job([], kept) == (0, (3, 0, 0, 0))
    # Another model has vectors of its own; a text kept twice counts once.
    assert job([(1, "a b")], VectorTable(str(tmp_path), "hash/64 v2")) == (1, (1, 0, 1, 1))
    kept.add(kept.read(spark))
    assert job([(1, "a b")], kept) == (0, (3, 1, 0, 1))


def test_encoder_is_pluggable(spark):
    class Lengths:
        def encode(self, texts):
            return [[float(len(text))] if text != "bad" else None for text in texts]

    rows = spark.createDataFrame([(1, "abc"), (2, "bad")], "id long, content string")
    got = {r["id"]: r["embedding"] for r in embed_text(rows, Lengths).collect()}
    assert got == {1: [3.0], 2: None}
    assert len(HashEncoder(8).encode(["x"])[0]) == 8


def test_batches_follow_input_order_and_cap(spark):
    rows = spark.range(100).select("id", F.when(F.col("id") < 90, "long").otherwise("short").alias("bucket"))
    got = assign_batches(rows.repartition(7), "id", current_max=8).collect()
    for row in got:
        first = 0 if row["bucket"] == "long" else 90
        assert row["batch_id"] == (row["id"] - first) // 8
    assert len(got) == 100


def test_optimal_batch_size_limits(spark):
    def size(count):
        return optimal_batch_size(spark.createDataFrame([(count,)], "token_count int")).head()[0]

    assert size(1) == 512 and size(10_000_000) == 16 and size(20_000) == 73
    assert optimal_batch_size(spark.createDataFrame([], "token_count int")).head()[0] == 16


def test_history_of_equal_turns_is_the_same_on_every_run(spark):
    from vectorloom.operators import conversations

    rows = [(1, 5, "user", f"text {i}") for i in range(30)] + [(1, 6, "user", "last")]
    messages = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = {
        tuple((r["position"], r["text"]) for r in conversations.recent_history(messages.repartition(n), 4).orderBy("position").collect())
        for n in (1, 3, 7)
    }
    assert len(found) == 1 and found.pop()[-1] == (4, "last")
