from pyspark.sql import functions as F

from vectorloom.operators import forms
from vectorloom.operators import form_rules as rules

DOCUMENT = "\n".join(
    [
        "# 采购订单列表 PO_1 数据结构文档",
        "",
        "intro",
        "## 字段",
        "| 层级 | 字段路径 | 字段名称 | 字段类型 |",
        "|---|---|---|---|",
        "| 1 | `head.status` | 状态 | Text |",
        "| 1 | `head.by` | 创建人 | User |",
        "| 1 | x | 字段名称 | Text |",
        "| 2 | `row.BillNo` | BillNo | Text |",
        "| 2 | `row.total` | 金额 | Decimal |",
        "| broken |",
        "",
        "---",
        "| 1 | `after` | 忽略 | Text |",
    ]
)


def _one(spark, column):
    return spark.range(1).select(column.alias("v")).head()["v"]


def test_parse(spark):
    found = _one(spark, forms.parse_form_fields(F.lit(DOCUMENT)))
    assert [tuple(f) for f in found] == [
        ("状态", "head.status", "Text"), ("创建人", "head.by", "User"),
        ("BillNo", "row.BillNo", "Text"), ("金额", "row.total", "Decimal"),
    ]
    assert _one(spark, forms.parse_form_fields(F.lit("no table"))) == []
    info = _one(spark, forms.extract_form_info(F.lit(DOCUMENT)))
    assert tuple(info) == ("采购订单列表", "PO_1")
    assert tuple(_one(spark, forms.extract_form_info(F.lit("x")))) == ("未命名表单", "unknown")


def _describe(spark, name, *fields):
    names = F.array(*map(F.lit, fields)).cast("array<string>")
    return _one(
        spark,
        F.struct(
            forms.detect_domain(F.lit(name), names).alias("domain"),
            forms.detect_type(F.lit(name)).alias("kind"),
            forms.form_scenarios(F.lit(name), names).alias("scenarios"),
        ),
    )


def test_rules_in_order(spark):
    # 订单 belongs to two domains; the earlier one wins.
    assert _describe(spark, "订单")["domain"] == "供应链"
    assert _describe(spark, "甲")["domain"] == "业务"
    assert _describe(spark, "甲", "员工")["domain"] == "人力"
    # A word may span the end of the name and the first field, which follow without a blank.
    assert _describe(spark, "甲员", "工")["domain"] == "人力"
    assert _describe(spark, "甲", "员", "工")["domain"] == "业务"
    assert _describe(spark, "审批查询")["kind"] == "查询"
    assert _describe(spark, "甲")["kind"] == "默认"


def test_scenarios(spark):
    assert _describe(spark, "甲")["scenarios"] == ["创建和管理甲记录", "查询甲详细信息", "维护甲基础数据"]
    assert _describe(spark, "甲", "fBILLNO", "BillStatus")["scenarios"] == ["创建新的甲记录", "提交甲进行审批流程"]
    # 状态 must be a field of exactly that name.
    assert _describe(spark, "甲", "单据状态")["scenarios"][0] == "创建和管理甲记录"
    many = _describe(spark, "新增查询审批修改导出", "状态", "组织")["scenarios"]
    assert len(many) == 5 and many[-1] == "导出或打印新增查询审批修改导出报表"


def test_render_and_fill(spark):
    built = _one(spark, forms.render_form_markdown(F.lit("id1"), F.lit("甲"), F.lit(""), F.lit("T")))
    assert built.split("\n") == [
        "# 甲", "", "**表单标识**: `id1`", "",
        "## 功能描述", "", rules.DESCRIPTION_MARKER, rules.DESCRIPTION_TODO, "",
        "## 业务场景", "", rules.SCENARIO_MARKER, rules.SCENARIO_TODO, "",
        "## 字段信息", "", "<!-- 无字段信息 -->", "", "---", "",
        "- **创建时间**: T", "- **数据来源**: Oracle 数据库导出", "",
    ]
    nothing = F.lit(None).cast("string")
    assert _one(spark, forms.render_form_markdown(nothing, nothing, nothing, F.lit("T"))) is None
    assert _one(spark, forms.render_form_markdown(nothing, nothing, F.lit("x"), F.lit("T"))).startswith(
        "# 未命名表单\n\n**表单标识**: `unknown`"
    )
    row = (
        spark.range(1)
        .select(forms.render_form_markdown(nothing, nothing, F.lit(DOCUMENT), F.lit("T")).alias("md"))
        .transform(forms.describe_documents)
        .head()
    )
    assert row["md"].index("## 功能描述") < row["md"].index("## 字段")
    assert row["described"].startswith("# 采购订单列表 PO_1 数据结构文档\n\nintro\n\n## 功能描述\n")
    assert (
        "采购订单列表用于展示和管理供应链列表数据，支持列表查询、筛选和操作。主要包含状态, BillNo, 金额等关键字段。"
        in row["described"]
    )
    assert "- 创建新的采购订单列表记录\n- 查询和检索采购订单列表数据\n" in row["described"]
    assert rules.DESCRIPTION_MARKER not in row["described"]


def test_inject_without_any_heading_goes_first(spark):
    assert _one(spark, forms.inject_placeholders(F.lit("# t\ntext"))).startswith("\n## 功能描述\n")
    done = "# t\n## 功能描述\n"
    assert _one(spark, forms.inject_placeholders(F.lit(done))) == done


def test_file_names(spark):
    nothing = F.lit(None).cast("string")
    assert _one(spark, forms.form_filename(F.lit('a/b:"c'), F.lit("甲|乙"), F.lit(0), "p_")) == "p_a_b__c_甲_乙.md"
    assert _one(spark, forms.form_filename(nothing, nothing, F.lit(7))) == "unknown_7_未命名.md"


def test_form_job_writes_documents_and_lists_failures(spark):
    from vectorloom.operators.store import as_store_rows
    from vectorloom.plans import pipelines
    from vectorloom.session import scratch_path

    fields = "position int, FK_NYLQ_NUMBER string, FK_NYLQ_NAME string, FK_NYLQ_STRUCTURE_TAG string, "
    records = spark.createDataFrame(
        [(0, "1", "a", "first", None, None), (1, "1", "a", "second", None, None),
         (2, "2", "b", None, None, None), (3, "1", "a", None, None, None)],
        fields + "form_id string, form_name string",
    )
    rules = spark.createDataFrame([("forms/", "form", 1)], "pattern string, knowledge_type string, priority int")
    config = spark.createDataFrame([("form", "file_name")], "knowledge_type string, vector_field string")
    empty = as_store_rows(spark.createDataFrame([], "chunk_id string"))
    target = scratch_path(spark, "forms")
    job = pipelines.form_etl(empty, records, "forms", rules, config, F.lit("now"), path=target)
    written = spark.read.parquet(target).collect()
    assert [row["filename"] for row in written] == ["1_a.md"]
    assert "second" in written[0]["md"] and "AI_GENERATED" not in written[0]["md"]
    assert [row["chunk_id"] for row in job.rows.collect()] == ["1_a"]
    ledger = sorted((row["file_path"], row["status"]) for row in job.ledger.collect())
    assert ledger == [("forms/1_a.md", "completed"), ("forms/1_a.md", "failed"), ("forms/2_b.md", "failed")]


def test_field_table_ends_before_a_rule_or_heading(spark):
    head = "| 层级 | 字段路径 | 字段名称 | 类型 |\n"
    row = "| 1 | `a` | {} | Text |\n"
    texts = {
        head + row.format("甲") + "\n" + row.format("乙"): ["甲", "乙"],
        head + row.format("甲") + "---\n" + row.format("乙"): ["甲"],
        head + row.format("甲") + "##\n" + row.format("乙"): ["甲"],
        head + row.format("甲") + "--\n#\n ---\n" + row.format("乙"): ["甲", "乙"],
        head + "---\n" + row.format("乙"): ["乙"],
        head + row.format("甲") * 20_000: ["甲"] * 20_000,
        head.strip(): [],
    }
    found = spark.createDataFrame([(text,) for text in texts], "md string").select(
        "md", F.transform(forms.parse_form_fields(F.col("md")), lambda field: field["name"]).alias("names")
    )
    assert {row["md"]: row["names"] for row in found.collect()} == texts


def _tasks(frame):
    return frame.select(F.spark_partition_id().alias("task")).distinct().count()


def test_records_of_one_small_file_are_dealt_to_all_cores(spark, folder):
    from vectorloom.catalog.form_queries import form_table
    from vectorloom.catalog.registry import table

    assert _tasks(table(spark, folder, "part")) == 1
    assert _tasks(form_table(spark, folder)) >= spark.sparkContext.defaultParallelism


def test_files_of_one_type_stay_in_their_tasks(spark):
    from vectorloom.operators.routing import type_config_join, validate_types
    from vectorloom.plans.pipelines import file_inputs

    rules = spark.createDataFrame([("forms/", "form", 1)], "pattern string, knowledge_type string, priority int")
    config = spark.createDataFrame([("form", "file_name")], "knowledge_type string, vector_field string")
    files = spark.range(0, 4000, 1, 8).select(F.concat(F.lit("forms/"), "id", F.lit(".md")).alias("path"))
    inputs = file_inputs(files, rules, config, None)
    assert inputs.where("content is not null").count() == 4000 and _tasks(inputs) == 8
    typed = files.withColumn("knowledge_type", F.concat(F.lit("form"), F.substring("path", 1, 0)))
    assert _tasks(type_config_join(typed, config)) == 8
    assert [_tasks(part) for part in validate_types(typed, config)] == [8, 0]
