"""The pipeline's stages on small documents."""

import collections
import itertools
import random
import re

import corpus_pipeline as pipeline
import pytest

from vectorloom.llm import decontaminate, jaccard, simhash
from vectorloom.llm.rows import with_row_key, without_rows


def brute_groups(texts):
    """The least key of the group of every text: links at Jaccard 0.8 of five-word shingles."""
    lower = {c: c + 32 for c in range(65, 91)}
    split = {i: re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower)) for i, t in texts.items()}
    sets = {i: {tuple(w[n : n + 5]) for n in range(max(len(w) - 4, 1))} if w else set() for i, w in split.items()}
    parent = {i: i for i in texts}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(texts, 2):
        if sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            first, last = sorted((root(a), root(b)))
            parent[last] = first
    return {i: root(i) for i in texts}


def test_stages_keep_their_contract(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    items = spark.read.parquet(f"{folder}/benchmark.parquet")
    before = docs
    for _, stage in pipeline.STAGES[:-1]:
        before = pipeline.materialise(stage(spark, before, folder), "test")
        assert before.columns == pipeline.COLUMNS
        assert before.dtypes == docs.select(*pipeline.COLUMNS).dtypes
        assert 0 < before.count() <= docs.count()
    assert decontaminate.mark_hits(before, items).where("size(_hit_words) > 0").count() == 0
    assert before.where("n_chars <> length(text)").count() == 0
    packed = pipeline.run(spark, folder)
    assert packed.select("doc_id").distinct().count() == before.count()


def test_near_duplicate_stage_leaves_one_of_a_group(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    head = brute_groups({r["doc_id"]: r["text"] for r in docs.collect()})
    kept = {r["doc_id"] for r in pipeline.near_duplicates(spark, docs, folder).collect()}
    assert kept == {i for i, first in head.items() if i == first}


def test_one_row_of_repeated_and_nameless_copies_stays(spark, folder):
    long = " ".join(f"word{i}" for i in range(60))
    other = " ".join(f"term{i}" for i in range(60))
    rows = [(1, long), (1, long), (4, long), (None, other), (None, other), (7, "something else"), (None, "alone")]
    docs = spark.createDataFrame(
        [(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long"
    )
    kept = pipeline.near_duplicates(spark, docs.repartition(3), folder)
    found = sorted(((r["doc_id"] or 0, r["text"]) for r in kept.collect()))
    assert found == sorted([(1, long), (0, other), (7, "something else"), (0, "alone")])
    passed = pipeline.repeated_passages(spark, pipeline.materialise(kept, "test"), folder)
    assert {long, other} <= {r["text"] for r in passed.collect()}


def test_quality_stage_judges_rows(spark, tmp_path):
    good = ["the quick brown fox runs over the old stone bridge and the river " * 4] * 30
    junk = "zzqx kkvw pprt jjhh wwqq xxzz vvbb nnmm ggff ddss " * 6
    rows = [(i, text) for i, text in enumerate(good)] + [(3, junk), (None, junk), (None, good[0])]
    docs = spark.createDataFrame(
        [(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long"
    )
    labels = [(i, 1, 0) for i in range(30) if i != 3]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = pipeline.quality(spark, docs, str(tmp_path)).collect()
    assert sorted(r["doc_id"] for r in kept if r["doc_id"] is not None) == list(range(30))
    assert [r["text"] for r in kept if r["doc_id"] is None] == [good[0]]


@pytest.mark.parametrize("block_rows", [512, 4])
def test_similar_groups_equal_brute_force(spark, block_rows):
    draw = random.Random(5)
    texts = [None, "", "One two", "one  TWO", "a b c d e"]
    for size in (8, 40, 120, 300):
        base = [f"w{draw.randrange(5000)}" for _ in range(size)]
        for changes in (0, 0, 1, 1, 2, 3, 4, 5, 6, 8, 12):
            copy = list(base)
            for _ in range(changes):
                copy[draw.randrange(size)] = f"x{draw.randrange(5000)}"
            texts.append(" ".join(copy))
    heads = brute_groups(dict(enumerate(texts)))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    wanted, found = collections.defaultdict(set), collections.defaultdict(set)
    for i, first in heads.items():
        wanted[first].add(i)
    for row in jaccard.similar_groups(docs, block_rows=block_rows).collect():
        found[row["component"]].add(row["id"])
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, wanted.values()))


def test_near_duplicate_stage_takes_similarity_of_four_fifths(spark, folder):
    words = [f"w{i}" for i in range(100)]
    near = " ".join([*words[:50], "other", *words[51:]])  # 91 of 101 shingles are shared
    far = " ".join([*words[:20], "x", *words[21:50], "y", *words[51:80], "z", *words[81:]])
    rows = [(1, " ".join(words)), (2, near), (3, far)]
    docs = spark.createDataFrame(
        [(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long"
    )
    assert sorted(r["doc_id"] for r in pipeline.near_duplicates(spark, docs, folder).collect()) == [1, 3]


def test_near_fingerprints_are_candidates_without_a_common_band(spark):
    nodes = [(1, 0b0, [10]), (2, 0b1011, [20]), (3, 0b0, [30]), (4, -1, [40]), (5, 0b11111, [50, 60]), (6, 255 << 20, [60])]
    docs = spark.createDataFrame(nodes, "node long, fp long, cells array<long>")
    found = {row["node"]: row["bundle"] for row in jaccard._candidates(docs).collect()}
    assert found == {1: 1, 2: 1, 3: 1, 5: 1, 6: 1}  # 4 is far from all; 5 and 6 share a band
    described = jaccard._described(spark.createDataFrame([(1, "a b c d e f"), (2, None)], "id long, text string"))
    wanted = simhash.majority(jaccard.shingles("a b c d e f"))
    assert {row["id"]: row["fp"] % (1 << 64) for row in described.collect()} == {1: wanted, 2: 0}


def test_row_keys_of_stored_rows_need_no_copy(spark, tmp_path):
    spark.range(0, 5000, 1, 7).selectExpr("id % 3 as doc_id", "id as at").write.parquet(f"{tmp_path}/rows")
    stored = with_row_key(spark.read.parquet(f"{tmp_path}/rows"))
    other = with_row_key(spark.range(0, 5000, 1, 7).selectExpr("id % 3 as doc_id", "id as at"))
    for keyed in (stored, other):
        first = {r["_row_key"]: r["at"] for r in keyed.collect()}
        assert len(first) == 5000
        assert {r["_row_key"]: r["at"] for r in keyed.where("at % 2 = 0").repartition(3).collect()}.items() <= first.items()


def test_rows_go_without_a_shuffle_of_the_texts(spark, tmp_path):
    spark.range(0, 100_000, 1, 3).selectExpr("id as at", "'text' as text").write.parquet(f"{tmp_path}/rows")
    rows = with_row_key(spark.read.parquet(f"{tmp_path}/rows"))
    gone = rows.where("at % 3 = 0 or at between 32000 and 34000").select("_row_key")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1k")
    try:
        kept = without_rows(rows, gone, "_row_key")
        assert sorted(r["at"] for r in kept.collect()) == [i for i in range(100_000) if i % 3 and not 32000 <= i <= 34000]
        assert "SortMergeJoin" not in kept._jdf.queryExecution().executedPlan().toString()
        assert without_rows(rows, gone.limit(0), "_row_key").count() == 100_000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
