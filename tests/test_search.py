import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vectorloom.catalog import QUERIES
from vectorloom.operators import ann, knn, search, store
from vectorloom.operators.knn import knn_exact
from vectorloom.session import scratch_path

DIM = 16


def vectors(spark, matrix, **columns):
    data = [(f"c{i:05d}", [float(x) for x in row]) for i, row in enumerate(matrix)]
    return spark.createDataFrame(data, "chunk_id string, embedding array<float>").repartition(3)


def queries(spark, matrix):
    data = [(i, [float(x) for x in row]) for i, row in enumerate(matrix)]
    return spark.createDataFrame(data, "query_idx long, embedding array<float>")


def brute_force(matrix, asked, k):
    def unit(m):
        m = np.asarray(m, dtype=np.float32).astype(float)
        norms = np.linalg.norm(m, axis=1, keepdims=True)
        return np.divide(m, norms, out=np.zeros_like(m), where=norms > 0)

    scores = np.round(unit(asked) @ unit(matrix).T, 12) + 0.0
    return {
        q: [(f"c{i:05d}", row[i]) for i in sorted(range(len(row)), key=lambda i: (-row[i], i))[:k]]
        for q, row in enumerate(scores)
    }


def as_dict(hits):
    found = {}
    for row in hits.orderBy("query_idx", "rank").collect():
        found.setdefault(row["query_idx"], []).append((row["chunk_id"], row["score"]))
    return found


@pytest.fixture(scope="module")
def data():
    generator = np.random.default_rng(3)
    matrix = generator.normal(size=(600, DIM))
    matrix[200:400] = matrix[200]  # a third of all rows are copies
    matrix[10] = 0
    return matrix, generator.normal(size=(9, DIM))


def test_exact_search_on_both_paths(spark, data):
    matrix, asked = data
    asked = np.vstack([asked, matrix[200], np.zeros(DIM)])
    rows, wanted = vectors(spark, matrix), queries(spark, asked)
    expected = brute_force(matrix, asked, 7)
    assert as_dict(knn_exact(rows, wanted, 7)) == expected
    assert as_dict(knn_exact(rows, wanted, 7, max_queries=3, block_rows=100)) == expected


def test_fewer_vectors_than_k_and_no_queries(spark, data):
    matrix, asked = data
    rows = vectors(spark, matrix[:4])
    assert as_dict(knn_exact(rows, queries(spark, asked), 10)) == brute_force(matrix[:4], asked, 10)
    assert knn_exact(rows, queries(spark, asked).where("query_idx < 0"), 10).count() == 0


def _store(spark, matrix):
    kind = F.when(F.substring("chunk_id", 2, 5).cast("int") % 3 == 0, "a").otherwise("b")
    return store.as_store_rows(
        vectors(spark, matrix)
        .withColumn("knowledge_type", kind)
        .withColumn("deleted", F.substring("chunk_id", 2, 5).cast("int") < 150)
        .withColumn("doc_path", F.concat(F.lit("p"), F.substring("chunk_id", 5, 2)))
    )


def test_deleted_rows_do_not_use_up_k_unless_asked(spark):
    matrix = np.outer(np.ones(300), np.eye(DIM)[0]) + np.eye(DIM)[1] * np.arange(300)[:, None] / 300
    rows, wanted = _store(spark, matrix), queries(spark, np.eye(DIM)[:1])
    assert search.store_search(rows, wanted, 10).count() == 10
    # The best 20 rows are all deleted, so over-fetching twice k finds nothing.
    assert search.store_search(rows, wanted, 10, overfetch=2).count() == 0


def test_equal_scores_follow_type_order(spark):
    rows = _store(spark, np.outer(np.ones(300), np.eye(DIM)[0]))
    types = spark.createDataFrame([("b", 0), ("a", 1)], "knowledge_type string, type_order int")
    hits = search.search_multi_type(rows, queries(spark, np.eye(DIM)[:1]), types, k=5)
    got = [(r["knowledge_type"], r["chunk_id"]) for r in hits.orderBy("rank").collect()]
    assert got == [("b", f"c{i:05d}") for i in (151, 152, 154, 155, 157)]
    only = search.search_multi_type(
        rows, queries(spark, np.eye(DIM)[:1]), types.where("knowledge_type = 'a'"), k=5
    )
    assert {r["knowledge_type"] for r in only.collect()} == {"a"}


def test_query_input(spark):
    rows = spark.createDataFrame([(0, " a "), (1, "　\n"), (2, "b")], "query_idx int, query string")
    assert [tuple(r) for r in search.query_input(rows).orderBy("query_idx").collect()] == [(0, "a"), (2, "b")]


def test_answer(spark):
    rows = spark.createDataFrame(
        [(0, 2, "表单B", "t", None, 0.4), (0, 1, "表单A", "t", "说明", 0.876)],
        "query_idx int, rank int, name string, knowledge_type string, description string, "
        "relevance_score double",
    )
    assert search.assemble_answer(rows).head()["answer"] == (
        "根据知识库检索，为您找到以下相关信息：\n\n**1. 表单A** (t)\n说明\n\n**2. 表单B** (t)\n\n"
        "\n*以上信息来自知识库检索，相关度: 88%*"
    )


@pytest.mark.parametrize(
    "rows, kind, nlist, m",
    [
        (0, "flat", 0, 0), (9_999, "flat", 0, 0), (10_000, "ivf", 100, 0), (99_999, "ivf", 100, 0),
        (100_000, "ivf_pq", 100, 8), (999_999, "ivf_pq", 256, 8), (1_000_000, "ivf_pq", 1024, 16),
    ],
)
def test_index_policy(spark, rows, kind, nlist, m):
    plan = ann.choose_index(rows)
    assert (plan.kind, plan.nlist, plan.m) == (kind, nlist, m)
    sizes = spark.createDataFrame([(rows,)], "rows long")
    assert tuple(ann.choose_index_table(sizes).head()) == (rows, kind, nlist, m)


def test_index_policy_by_flags():
    assert ann.choose_index(999, "flags", use_ivf=True).kind == "flat"
    assert ann.choose_index(5000, "flags").kind == "flat"
    assert ann.choose_index(5000, "flags", use_ivf=True, use_pq=True).kind == "ivf_pq"
    assert ann.choose_index(5000, "flags", use_pq=True).nlist == 0


def test_training_needs_rows(spark, data):
    with pytest.raises(ValueError):
        ann.ivf_fit(vectors(spark, data[0][:50]), 4)


def test_cells(spark, data):
    matrix, asked = data
    rows, wanted = vectors(spark, matrix), queries(spark, asked)
    centroids = ann.ivf_fit(rows, 6)
    indexed = ann.ivf_assign(rows, centroids)
    exact = knn_exact(rows, wanted, 10)
    everywhere = ann.ivf_search(indexed, centroids, wanted, 10, nprobe=6)
    assert as_dict(everywhere) == as_dict(exact)
    # The copies make one cell hold a third of all rows; blocks split it.
    blocks = {"max_queries": 2, "block_rows": 50}
    split = ann.ivf_search(indexed, centroids, wanted, 10, nprobe=6, **blocks)
    assert as_dict(split) == as_dict(exact)
    probed = ann.ivf_search(indexed, centroids, wanted, 10, nprobe=3)
    assert ann.recall(probed, exact).head()[0] >= 0.6


def test_codes(spark, data):
    matrix, asked = data
    rows, wanted = vectors(spark, matrix), queries(spark, asked)
    book = ann.pq_fit(rows, DIM, m=4, nbits=5)
    encoded = ann.pq_encode(rows, book)
    exact = knn_exact(rows, wanted, 10)
    assert ann.recall(ann.pq_search(encoded, book, wanted, 10), exact).head()[0] >= 0.3
    reranked = ann.pq_search(encoded, book, wanted, 10, rerank=60)
    assert as_dict(reranked) == as_dict(exact)
    centroids = ann.ivf_fit(rows, 6)
    both = ann.ivf_assign(encoded, centroids)
    cells = ann.ivf_pq_search(both, centroids, book, wanted, 10, nprobe=6, residual=False)
    assert as_dict(cells) == as_dict(ann.pq_search(encoded, book, wanted, 10))


def test_reindex_kinds(spark, data):
    rows = vectors(spark, data[0])
    for plan, columns in (
        (None, {"chunk_id", "embedding"}),
        (ann.IndexPlan("ivf_pq", nlist=4, m=4, nbits=3), {"chunk_id", "embedding", "codes", "cell"}),
    ):
        _, written = ann.reindex(rows, scratch_path(spark, "reindex"), DIM, plan)
        assert set(written.columns) == columns and written.count() == len(data[0])


def test_ranks_and_filters_by_unrounded_scores(spark):
    from vectorloom.operators.knn import knn_exact

    vectors = spark.createDataFrame([("a", [1.0, 0.001]), ("b", [1.0, 0.0])], "chunk_id string, embedding array<double>")
    query = spark.createDataFrame([(0, [1.0, 0.0])], "query_idx int, embedding array<double>")
    assert [r["chunk_id"] for r in knn_exact(vectors, query, 1).collect()] == ["b"]
    near = 0.2999998
    low = spark.createDataFrame([("c", [near, (1 - near**2) ** 0.5])], "chunk_id string, embedding array<double>")
    assert knn_exact(low, query, 1).where("score >= 0.3").count() == 0


def test_vectors_as_queries_on_both_sides_of_the_bound(spark):
    rows = spark.createDataFrame(
        [(f"c{i}", i, [float(i % 7), float(i % 5), 1.0]) for i in range(60)],
        "chunk_id string, query_idx int, embedding array<double>",
    )
    columns = ["query_idx", "chunk_id", "score", "rank"]
    whole = sorted(map(tuple, knn_exact(rows, rows, 4).select(columns).collect()))
    sliced = sorted(map(tuple, knn_exact(rows, rows, 4, max_queries=7, block_rows=11).select(columns).collect()))
    assert whole == sliced and len(whole) == 240


def test_rows_without_a_type_are_found(spark):
    stored = store.as_store_rows(
        spark.createDataFrame(
            [("a", None, [1.0, 0.0]), ("b", "t", [0.0, 1.0])],
            "chunk_id string, knowledge_type string, embedding array<float>",
        )
    )
    wanted = spark.createDataFrame([(0, [1.0, 0.1])], "query_idx int, embedding array<double>")
    for more in ({}, {"overfetch": 2}):
        found = search.store_search(stored, wanted, 2, **more).collect()
        assert [(r["chunk_id"], r["knowledge_type"]) for r in sorted(found, key=lambda r: r["rank"])] == [
            ("a", None), ("b", "t")
        ]
    hits = search.store_search(stored, wanted, 2)
    assert search.hit_projection(hits, stored).count() == 2


def test_a_query_without_hits_is_answered(spark):
    rows = spark.createDataFrame(
        [(0, 1, "表单A", "t", "说明", 0.876)],
        "query_idx long, rank int, name string, knowledge_type string, description string, relevance_score double",
    )
    asked = spark.createDataFrame([(0,), (1,), (1,)], "query_idx long")
    answers = {r["query_idx"]: r["answer"] for r in search.assemble_answer(rows, queries=asked).collect()}
    assert answers[1] == search.NO_ANSWER and answers[0].endswith("相关度: 88%*")
    assert search.assemble_answer(rows.limit(0), queries=asked).count() == 2


def test_null_vectors_get_no_cell_and_no_code(spark):
    rows = spark.createDataFrame(
        [("a", [1.0, 0.0]), ("b", None), ("c", [0.0, 0.0]), ("d", [0.1, 2.0])],
        "chunk_id string, embedding array<float>",
    ).repartition(1)
    cells = spark.createDataFrame([(5, [0.0, 1.0]), (3, [1.0, 0.0])], "cell int, centroid array<double>")
    found = {r["chunk_id"]: r["cell"] for r in ann.ivf_assign(rows, cells).collect()}
    assert found == {"a": 3, "b": None, "c": 3, "d": 5}
    book = spark.createDataFrame(
        [(1, 1, [1.0]), (1, 0, [0.0]), (0, 0, [0.0]), (0, 1, [1.0])],
        "sub int, code int, centroid array<double>",
    )
    codes = {r["chunk_id"]: r["codes"] for r in ann.pq_encode(rows, book).collect()}
    assert codes == {"a": [1, 0], "b": None, "c": [0, 0], "d": [0, 1]}
    only_null = rows.where("embedding is null")
    assert [r["cell"] for r in ann.ivf_assign(only_null, cells).collect()] == [None]
    assert [r["codes"] for r in ann.pq_encode(only_null, book).collect()] == [None]


def test_a_large_model_table_is_refused(spark, monkeypatch):
    cells = spark.createDataFrame([(0, [0.0, 1.0])], "cell int, centroid array<double>")
    monkeypatch.setattr(ann, "MAX_MODEL_BYTES", 15)
    with pytest.raises(ValueError, match="not small"):
        ann.ivf_assign(spark.createDataFrame([], "embedding array<float>"), cells)


def clustered(seed, rows, groups, spread):
    """Vectors around some directions."""
    draw = np.random.default_rng(seed)
    directions = draw.normal(size=(groups, DIM))
    return directions[draw.integers(0, groups, rows)] + spread * draw.normal(size=(rows, DIM))


def test_residual_codes_recall_more_than_codes_of_whole_vectors(spark):
    matrix = clustered(3, 3000, 24, 0.35)
    rows, wanted = vectors(spark, matrix), queries(spark, matrix[:40] + 0.01)
    exact = knn_exact(rows, wanted, 10)
    centroids = ann.ivf_fit(rows, 24)
    assigned = ann.ivf_assign(rows, centroids)
    share = {}
    for residual in (True, False):
        origin = centroids if residual else None
        book = ann.pq_fit(rows, DIM, m=4, nbits=5, centroids=origin)
        coded = ann.pq_encode(assigned, book, origin)
        found = ann.ivf_pq_search(coded, centroids, book, wanted, 10, nprobe=10, residual=residual)
        share[residual] = ann.recall(found, exact).head()[0]
        if residual:
            better = ann.ivf_pq_search(coded, centroids, book, wanted, 10, nprobe=10, rerank=20)
            assert ann.recall(better, exact).head()[0] >= 0.9
    assert share[True] > share[False] + 0.05


def test_recall_at_the_default_number_of_probes(spark):
    matrix = clustered(5, 4000, 60, 0.5)
    rows, wanted = vectors(spark, matrix), queries(spark, matrix[::100] * 1.1)
    centroids = ann.ivf_fit(rows, 64)
    found = ann.ivf_search(ann.ivf_assign(rows, centroids), centroids, wanted, 10)
    assert ann.recall(found, knn_exact(rows, wanted, 10)).head()[0] >= 0.9


def test_training_reads_a_bounded_sample(spark, monkeypatch):
    monkeypatch.setattr(ann.settings, "TRAINING_ROWS_A_CENTER", 20)
    rows = vectors(spark, clustered(7, 3000, 12, 0.1))
    drawn = ann.training_sample(rows, 3000, 12, 42).count()
    assert 120 < drawn < 400
    assert ann.training_sample(rows, 3000, 200, 42) is rows
    centroids = ann.ivf_fit(rows, 12)
    total = ann.cell_distance(ann.ivf_assign(rows, centroids), centroids).agg(F.avg("distance")).head()[0]
    alike = spark.createDataFrame([(0, matrix_mean(rows))], "cell int, centroid array<double>")
    single = ann.cell_distance(ann.ivf_assign(rows, alike), alike).agg(F.avg("distance")).head()[0]
    assert total < 0.5 * single


def matrix_mean(rows):
    matrix = np.array([r["embedding"] for r in rows.collect()])
    return (matrix / np.linalg.norm(matrix, axis=1, keepdims=True)).mean(axis=0).tolist()


def test_batches_added_equal_one_build(spark):
    matrix = clustered(9, 1200, 8, 0.3)
    rows = vectors(spark, matrix)
    old, new = rows.where("chunk_id < 'c00800'"), rows.where("chunk_id >= 'c00800'")
    path = scratch_path(spark, "index")
    ann.reindex(old, path, DIM, ann.IndexPlan("ivf_pq", nlist=8, m=4, nbits=4))
    for batch in ("first", "second", "second"):  # the last was repeated
        part = new.where(f"(chunk_id < 'c01000') = {batch == 'first'}")
        added = ann.add_to_index(part, path, batch)
    index = ann.open_index(spark, path)
    whole = ann.pq_encode(ann.ivf_assign(rows, index.centroids), index.book, index.centroids)
    got = {r["chunk_id"]: (r["cell"], r["codes"]) for r in added.collect()}
    assert got == {r["chunk_id"]: (r["cell"], r["codes"]) for r in whole.collect()} and len(got) == 1200
    assert added.count() == 1200
    assert not ann.training_due(ann.index_drift(added)).head()["due"]
    strange = vectors(spark, np.random.default_rng(1).normal(size=(300, DIM))).withColumn("chunk_id", F.concat(F.lit("x"), "chunk_id"))
    drifted = ann.training_due(ann.index_drift(ann.add_to_index(strange, path, "strange"))).head()
    assert drifted["due"] and drifted["distance_ratio"] > 1.25
    with pytest.raises(ValueError):
        ann.add_to_index(new, path, ann.TRAINED)


def test_blocks_of_queries_meet_only_vectors_of_their_cells(spark):
    rows = vectors(spark, clustered(2, 900, 3, 0.2)).withColumn(
        "_group", F.when(F.col("chunk_id") < "c00600", "hot").otherwise(F.substring("chunk_id", 6, 1))
    )
    asked = queries(spark, clustered(4, 90, 3, 0.2)).withColumn(
        "_group", F.when(F.col("query_idx") < 50, "hot").otherwise((F.col("query_idx") % 3).cast("string"))
    )
    left, right = knn.dealt_blocks(rows, asked, 20, 100)
    keys = ["_key", "_vector_block", "_query_block"]
    sizes = left.groupBy(*keys).count()
    assert sizes.where("count > 200").count() == 0 and sizes.where("_key = 'hot'").count() == 18
    assert right.groupBy(*keys).count().where("count > 40").count() == 0
    assert left.where("_key <> _group").count() == right.where("_key <> _group").count() == 0
    pairs = left.select("chunk_id", "_group", *keys).join(
        right.select("query_idx", F.col("_group").alias("_asked"), *keys), keys
    )
    wanted = rows.join(asked.select("query_idx", "_group"), "_group").count()
    assert pairs.count() == pairs.distinct().count() == wanted
    assert pairs.where("_group <> _asked").count() == 0
    hits = knn.local_hits(rows, asked, 3, max_queries=20, block_rows=100).rows
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_queries_of_all_groups_beside_queries_of_one(spark):
    rows = vectors(spark, clustered(2, 60, 3, 0.2)).withColumn("_group", F.substring("chunk_id", 6, 1))
    asked = queries(spark, clustered(4, 6, 3, 0.2)).withColumn(
        "_group", F.when(F.col("query_idx") < 3, knn.ALL).otherwise(F.lit("4"))
    )
    by = ["query_idx", "_group"]
    few, many = (
        sorted(map(tuple, knn.local_hits(rows, asked, 2, max_queries=n).ranked(2, by, knn.score_order()).collect()))
        for n in (100, 2)
    )
    assert few == many
    groups = {(q, g) for q, g, *_ in few}
    assert groups == {(q, str(g)) for q in range(3) for g in range(10)} | {(q, "4") for q in range(3, 6)}


def test_hits_given_out_early_hold_the_best(monkeypatch):
    draw = np.random.default_rng(3)
    asked = pd.DataFrame({"query_idx": [0, 1, 2], "_group": ["g"] * 3, "embedding": list(draw.normal(size=(3, 4)))})
    points = np.round(draw.normal(size=(400, 4)), 1)
    for k, held in ((5, 200_000), (300, 200)):
        monkeypatch.setattr(knn, "HELD_HITS", held)
        top = knn.RunningTop(knn.QueryBlock.from_frame(asked), k, knn.cosine_scores, 7)
        found = []
        for start in range(0, 400, 50):
            ids = [f"c{i:03}" for i in range(start, start + 50)]
            columns = [pa.array(ids), pa.array(["g"] * 50), pa.array(points[start : start + 50].tolist())]
            top.add(pa.RecordBatch.from_arrays(columns, ["chunk_id", "_group", "embedding"]))
            found.append(top.overflow())
        assert (k == 300) == any(part is not None for part in found)
        best = knn.best_per_query(pd.concat([part for part in (*found, top.merge()) if part is not None]), k)
        unit = knn.unit_rows(points)
        for query in range(3):
            scores = knn.round_scores(knn.unit_rows(np.array([asked["embedding"][query]])) @ unit.T)[0]
            wanted = sorted(range(400), key=lambda i: (-scores[i], i))[:k]
            assert best[best["query_idx"] == query]["chunk_id"].tolist() == [f"c{i:03}" for i in wanted]


@pytest.mark.parametrize(
    "name", ["ivf_search_all_cells", "ivf_search_many", "ivf_pq_search", "ivf_pq_search_whole", "pq_search", "pq_search_recall"]
)
def test_index_queries_have_one_python_step_in_a_stage(spark, folder, name):
    """A task has a worker for each Python step of its stage, all at once."""
    plan = QUERIES[name](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"(?:MapInArrow|FlatMapCoGroupsInArrow) ", plan)) == 1 and "ArrowEvalPython" not in plan
