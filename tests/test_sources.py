import json
import tracemalloc

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vectorloom.operators.routing import (
    route_knowledge_type,
    summary_lookup,
    vector_input_summary,
)
from vectorloom.plans import pipelines
from vectorloom.operators.store import as_store_rows
from vectorloom.schemas import FORM_FIELDS, STORE_ROW
from vectorloom.sources import byte_streams, files, records


def _tree(tmp_path):
    (tmp_path / "forms" / "deep").mkdir(parents=True)
    (tmp_path / "forms" / "a.md").write_text("# 一\n二", encoding="utf-8")
    (tmp_path / "forms" / "deep" / "b.c.MD").write_text("text", encoding="utf-8")
    (tmp_path / "forms" / "note.txt").write_text("no", encoding="utf-8")
    return str(tmp_path)


def test_scan_files(spark, tmp_path):
    root = _tree(tmp_path)
    found = files.scan_knowledge_files(spark, root)
    assert sorted(r["path"].rsplit("/", 1)[1] for r in found.collect()) == ["a.md", "b.c.MD"]
    everything = files.scan_knowledge_files(spark, root, only_md=False)
    assert everything.count() == 3
    assert files.filter_allowed_files(everything).count() == 2
    assert files.filter_allowed_files(everything, max_bytes=5).count() == 1
    texts = files.read_text_files(spark, root, "*.md")
    assert [r["content"] for r in texts.collect()] == ["# 一\n二"]


RECORDS = [
    {"FK_NYLQ_NUMBER": "n1", "FK_NYLQ_NAME": "甲", "FK_NYLQ_STRUCTURE_TAG": "body"},
    {"form_id": "n2", "form_name": "乙"},
    {"FK_NYLQ_NUMBER": "n3", "FK_NYLQ_NAME": "丙", "FK_NYLQ_STRUCTURE_TAG": None},
]


def test_form_envelopes(spark, tmp_path):
    for key in ("RECORDS", "data", "forms"):
        (tmp_path / f"{key}.json").write_text(json.dumps({key: RECORDS, "other": 1}, indent=1))
    (tmp_path / "bare.json").write_text(json.dumps(RECORDS))
    (tmp_path / "single.json").write_text(json.dumps(RECORDS[0]))
    rows = records.scan_form_records(spark, str(tmp_path)).collect()
    by_file = {}
    for row in rows:
        by_file.setdefault(row["file_path"].rsplit("/", 1)[1], []).append(
            (row["position"], row["FK_NYLQ_NUMBER"], row["form_id"], row["FK_NYLQ_STRUCTURE_TAG"])
        )
    full = [(0, "n1", None, "body"), (1, None, "n2", ""), (2, "n3", None, None)]
    for name in ("RECORDS.json", "data.json", "forms.json", "bare.json"):
        assert sorted(by_file[name]) == full, name
    assert by_file["single.json"] == full[:1]


def _by_file(rows):
    found = {}
    for row in sorted(rows, key=lambda row: row["position"]):
        values = tuple(row[name] for name in FORM_FIELDS)
        found.setdefault(row["file_path"].rsplit("/", 1)[1], []).append((row["position"], values))
    return found


def test_large_form_files_give_the_records_of_small_ones(spark, tmp_path):
    hard = RECORDS + [
        {"form_id": 'q"]},{ \\', "form_name": "\\\\", "more": {"RECORDS": [1, {"a": [2]}]}},
        {"FK_NYLQ_NUMBER": 12, "FK_NYLQ_STRUCTURE_TAG": "<a b=\"c\">\n字</a>"},
    ]
    cases = {
        "first": {"RECORDS": hard, "data": RECORDS},
        "behind": {"x": {"RECORDS": [1]}, "data": RECORDS, "n": [[1], 2], "RECORDS": hard},
        "nolist": {"RECORDS": 5, "forms": hard},
        "bare": hard,
        "single": {"form_id": "one", "other": [1, 2]},
        "none": {"RECORDS": []},
        "numbers": [1, "two", None, RECORDS[0]],
        "blank": [],
    }
    for name, value in cases.items():
        for indent in (None, 2):
            path = tmp_path / f"{name}{indent}.json"
            path.write_text(json.dumps(value, indent=indent, ensure_ascii=indent == 2), encoding="utf-8")
    whole = _by_file(records.scan_form_records(spark, str(tmp_path)).collect())
    assert len(whole) == 2 * (len(cases) - 2)
    assert _by_file(records.scan_form_records(spark, str(tmp_path), cap=0).collect()) == whole
    mixed = (tmp_path / "firstNone.json").stat().st_size
    assert _by_file(records.scan_form_records(spark, str(tmp_path), cap=mixed).collect()) == whole


def test_broken_form_files_give_one_record_without_fields(spark, tmp_path):
    broken = ['{"RECORDS": [{"form_id": "a"}', '[{"form_id": "a"}] x', '["a', "[1}", "12", '{"a": [1]]', "[1\\"]
    for number, text in enumerate(broken):
        (tmp_path / f"{number}.json").write_text(text)
    found = _by_file(records.scan_form_records(spark, str(tmp_path), cap=0).collect())
    assert found == {f"{n}.json": [(0, (None, None, "", None, None))] for n in range(len(broken))}


@settings(max_examples=150, deadline=None)
@given(
    st.recursive(
        st.none() | st.integers() | st.text(), lambda inner: st.lists(inner) | st.dictionaries(st.text(), inner)
    ),
    st.integers(1, 9),
    st.sampled_from([None, 1]),
)
def test_json_is_cut_as_it_is_parsed(value, width, indent):
    def pieces(text):
        return [text[i : i + width] for i in range(0, len(text), width)]

    members = {"a": value, "b\\\"": [value, [value]], "c": []}
    text = json.dumps(members, indent=indent)
    arrays = dict(byte_streams.json_arrays(pieces(text)))
    assert list(arrays.values()) == [key for key, held in members.items() if isinstance(held, list)]
    for place, key in arrays.items():
        assert [json.loads(e) for e in byte_streams.json_elements(pieces(text), place)] == members[key]
    bare = json.dumps([value, members], indent=indent)
    assert byte_streams.json_arrays(pieces(bare)) == [(None, None)]
    assert [json.loads(e) for e in byte_streams.json_elements(pieces(bare), None)] == [value, members]


def test_memory_of_a_large_form_file_is_bounded(tmp_path):
    path = tmp_path / "large.json"
    record = json.dumps({"form_id": "f", "FK_NYLQ_STRUCTURE_TAG": '<f "a">\n' * 2_000}) + ",\n"
    with open(path, "w") as out:
        out.write('{"data": [')
        for _ in range(2_000):
            out.write(record)
        out.write("{}]}")
    tracemalloc.start()
    count = sum(1 for _ in records._large_file_records(str(path)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert count == 2_001 and path.stat().st_size > 40 << 20 and peak < 12 << 20


def test_summaries_keep_order_and_fill_missing(spark, tmp_path):
    found = [{"doc_id": "x", "summary": "first"}, {"doc_title": "x", "summary": "second"}]
    (tmp_path / "s.json").write_text(json.dumps(found))
    summaries = records.scan_summaries(spark, str(tmp_path))
    assert {(r["doc_id"], r["doc_title"], r["summary"]) for r in summaries.collect()} == {
        ("x", "", "first"), ("", "x", "second"),
    }
    stems = spark.createDataFrame([("x",), ("",), ("y",)], "stem string")
    got = {r["stem"]: r["_summary"] for r in summary_lookup(stems, summaries).collect()}
    assert got["x"]["summary"] == "first" and got[""] is None and got["y"] is None
    paths = spark.createDataFrame([("/k/x.md",), ("/k/y.md",)], "path string")
    inputs = {r["source_file"]: r["content"] for r in vector_input_summary(paths, summaries).collect()}
    assert inputs == {"/k/x.md": "first", "/k/y.md": None}


def _rules(spark):
    return spark.createDataFrame(
        [("forms", "form", 2), ("deep", "deep", 1)], "pattern string, knowledge_type string, priority int"
    )


def test_routing(spark):
    paths = spark.createDataFrame([("/forms/a",), ("/forms/deep/b",), ("/x",)], "path string")
    got = {r["path"]: r["knowledge_type"] for r in route_knowledge_type(paths, _rules(spark)).collect()}
    assert got == {"/forms/a": "form", "/forms/deep/b": "deep", "/x": None}


def test_imports(spark, tmp_path):
    root = _tree(tmp_path)
    empty = spark.createDataFrame([], STORE_ROW)
    config = spark.createDataFrame(
        [("form", "file_name"), ("deep", "file_name")], "knowledge_type string, vector_field string"
    )
    found = files.scan_knowledge_files(spark, root)
    job = pipelines.import_directory(empty, found, _rules(spark), config)
    assert {(r["knowledge_type"], r["chunk_id"]) for r in job.rows.collect()} == {("form", "a"), ("deep", "b.c")}
    assert {r["status"] for r in job.ledger.collect()} == {"completed"}
    # A second import changes nothing, a single file is replaced.
    stored = as_store_rows(job.rows.withColumn("content", F.lit("old")))
    again = pipelines.import_directory(stored, found, _rules(spark), config)
    assert {r["content"] for r in again.rows.collect()} == {"old"}
    one = pipelines.import_file(stored, f"{root}/forms/a.md", _rules(spark), config)
    assert {r["chunk_id"]: r["content"] for r in one.rows.collect()} == {"a": "a", "b.c": "old"}
    missing = pipelines.import_file(stored, f"{root}/forms/none.md", _rules(spark), config)
    assert missing.ledger.head()["error_message"] == pipelines.ERROR_MISSING
    unrouted = spark.createDataFrame([("/x/y.md",)], "path string")
    failed = pipelines.import_directory(stored, unrouted, _rules(spark), config).ledger.head()
    assert (failed["status"], failed["error_message"]) == ("failed", pipelines.ERROR_NO_INPUT)


def test_a_file_stored_in_parts_is_one_file(spark, tmp_path):
    spark.range(0, 40, 1, 4).write.parquet(f"{tmp_path}/forms/a.b.parquet")
    config = spark.createDataFrame([("form", "file_name")], "knowledge_type string, vector_field string")
    rules = spark.createDataFrame([("forms", "form", 1)], "pattern string, knowledge_type string, priority int")
    stored = as_store_rows(
        spark.createDataFrame([("a.b", "form", "old")], "chunk_id string, knowledge_type string, content string")
    )
    job = pipelines.import_file(stored, f"{tmp_path}/forms/a.b.parquet", rules, config)
    rows = [(r["chunk_id"], r["content"], r["doc_path"]) for r in job.rows.collect()]
    assert rows == [("a.b", "a.b", f"file:{tmp_path}/forms/a.b.parquet")]
    assert job.ledger.count() == 1
