"""Queries of the form-to-Markdown rules, over form records derived from the parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from vectorloom.catalog.registry import cte, query, sql, sql_strip, table
from vectorloom.operators import form_rules as rules
from vectorloom.operators import forms
from vectorloom.operators.stats import conversion_stats
from vectorloom.session import dealt, scratch_path
from vectorloom.sources.exports import write_form_markdown

CREATED = "2024-02-01 00:00:00"
_NL = "chr(10)"

# Form records: names with and without form types and domains, missing ids and names, structures
# that are null, empty, plain text, Markdown without headings, already described, and full.
_NAME = """CASE p_type WHEN 'STANDARD' THEN p_name || '采购订单列表' WHEN 'ECONOMY' THEN p_name || '财务报告'
  WHEN 'MEDIUM' THEN p_name || '审批单据' WHEN 'PROMO' THEN p_name WHEN 'SMALL' THEN p_name || '客户/档案' END"""
_FIRST_FIELD = """CASE p_size % 7 WHEN 0 THEN '金额' WHEN 1 THEN '状态' WHEN 2 THEN '组织' WHEN 3 THEN '日期'
  WHEN 4 THEN '编号' WHEN 5 THEN '费用' ELSE 'name' END"""
_LAST_FIELD = "CASE p_type WHEN 'LARGE' THEN '查询' WHEN 'SMALL' THEN 'BillStatus' ELSE '时间' END"
_DOCUMENT = """'# ' || replace(coalesce(form_name, 'form'), ' ', '_') || ' ' || p_brand || ' 数据结构文档' || nl || nl
  || 'intro ' || p_partkey || nl || nl || '## 表' || nl || nl
  || '| 层级 | 字段路径 | 字段名称 | 类型 |' || nl || '|---|---|---|---|' || nl
  || '| 1 | `a.' || p_size || '` | ' || first_field || ' | Text |' || nl
  || '| 1 | `b` | 创建人 | Text |' || nl || '| 2 | `c` | ' || last_field || ' | Date |' || nl
  || '| 2 | `d` | billno' || p_size || ' | Int |' || nl || '| short |' || nl || nl || '---' || nl || nl || 'tail'"""
_STRUCTURE = f"""CASE p_size % 10 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'plain ' || p_type
  WHEN 3 THEN '# ' || p_name || nl || nl || 'no headings'
  WHEN 4 THEN '# x y 数据结构文档' || nl || nl || '## 功能描述' || nl || nl || p_name
  ELSE {_DOCUMENT} END"""
_FORMS = f"""
    SELECT p_partkey, CASE WHEN p_size > 1 THEN p_brand || ':' || p_partkey END AS form_id,
           form_name, {_STRUCTURE} AS structure
    FROM (SELECT *, {_NAME} AS form_name, {_FIRST_FIELD} AS first_field,
                 {_LAST_FIELD} AS last_field, {{nl}} AS nl FROM {{part}})
    """
cte("forms", _FORMS.format(nl=_NL, part="part"))


def form_table(spark, folder):
    """The records ``(p_partkey, form_id, form_name, structure)``; the same SQL runs on Spark.

    The parts are dealt first: a few bytes of a part become a document, and a file of a million parts is one or two tasks.
    """
    part = dealt(table(spark, folder, "part"))
    return spark.sql(_FORMS.format(nl="char(10)", part="{part}"), part=part)


def _lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _lines(*parts: str) -> str:
    return f" || {_NL} || ".join(parts)


_SECTIONS = [
    _lit(line)
    for line in (
        rules.DESCRIPTION_HEADING, "", rules.DESCRIPTION_MARKER, rules.DESCRIPTION_TODO, "",
        rules.SCENARIO_HEADING, "", rules.SCENARIO_MARKER, rules.SCENARIO_TODO, "",
    )
]
_BUILT = _lines(
    f"'# ' || coalesce(form_name, {_lit(rules.UNNAMED_FORM)})",
    "''",
    f"{_lit(rules.ID_LABEL)} || ': `' || coalesce(form_id, 'unknown') || '`'",
    "''",
    *_SECTIONS,
    _lit(rules.FIELDS_HEADING),
    "''",
    f"CASE WHEN structure = '' THEN {_lit(rules.NO_FIELDS)} ELSE structure END",
    "''",
    "'---'",
    "''",
    f"{_lit(rules.CREATED_LABEL + CREATED)}",
    _lit(rules.ORIGIN_LINE),
    "''",
)
cte(
    "injected",
    f"""
    SELECT p_partkey, form_id, form_name, structure,
           CASE WHEN contains(structure, {_lit(rules.DESCRIPTION_HEADING)}) THEN structure
           ELSE array_to_string(lines[1:head] || ['', {', '.join(_SECTIONS)}] || lines[head + 1:],
                {_NL}) END AS md
    FROM (
      SELECT *, greatest(coalesce(list_position(list_transform(lines,
                lambda l: starts_with(l, '##')), TRUE), 0) - 1, 0) AS head
      FROM (SELECT *, string_split(structure, {_NL}) AS lines FROM forms
            WHERE structure IS NOT NULL))
    """,
)
cte(
    "rendered",
    f"""
    SELECT f.p_partkey, f.form_id, f.form_name, CASE WHEN f.structure IS NULL THEN NULL
           WHEN starts_with({sql_strip("f.structure")}, '#') THEN i.md
           ELSE (SELECT {_BUILT.replace("structure", "f.structure").replace("form_name", "f.form_name").replace("form_id", "f.form_id")})
           END AS md
    FROM forms f LEFT JOIN injected i USING (p_partkey)
    """,
)
_TITLE = "'^# (.+?) (.+?) 数据结构文档'"
cte(
    "parsed",
    f"""
    SELECT p_partkey, md,
           CASE WHEN regexp_matches(md, {_TITLE}) THEN trim(regexp_extract(md, {_TITLE}, 1))
                ELSE {_lit(rules.UNNAMED_FORM)} END AS name,
           CASE WHEN regexp_matches(md, {_TITLE}) THEN trim(regexp_extract(md, {_TITLE}, 2))
                ELSE 'unknown' END AS id
    FROM rendered WHERE md IS NOT NULL
    """,
)
cte(
    "field_rows",
    f"""
    SELECT p_partkey, row_number() OVER (PARTITION BY p_partkey ORDER BY n) AS pos,
           trim(cells[4]) AS field_name, replace(trim(cells[3]), '`', '') AS path,
           trim(cells[5]) AS field_type
    FROM (
      SELECT p_partkey, n, string_split(line, '|') AS cells FROM (
        SELECT p_partkey, unnest(string_split(md, {_NL})) AS line,
               generate_subscripts(string_split(md, {_NL}), 1) AS n FROM parsed)
      WHERE starts_with(line, '|') AND NOT starts_with(line, '| 层级')
        AND NOT starts_with(line, '|---'))
    WHERE len(cells) >= 5 AND trim(cells[4]) NOT IN ('', '字段名称')
    """,
)
cte(
    "named",
    """
    SELECT p.p_partkey, p.md, p.name, p.id,
           coalesce(l.names, []::VARCHAR[]) AS names,
           p.name || coalesce(array_to_string(l.names, ' '), '') AS txt
    FROM parsed p LEFT JOIN (
      SELECT p_partkey, list(field_name ORDER BY pos) AS names FROM field_rows GROUP BY p_partkey) l
    USING (p_partkey)
    """,
)


def _case(pairs: list[tuple[str, str]], default: str) -> str:
    whens = " ".join(f"WHEN {test} THEN {value}" for test, value in pairs)
    return f"CASE {whens} ELSE {default} END"


_DOMAIN = _case(
    [(f"regexp_matches(txt, {_lit('|'.join(words))})", _lit(d)) for d, words in rules.DOMAINS.items()],
    _lit(rules.DEFAULT_DOMAIN),
)
_TYPE = _case(
    [(f"contains(name, {_lit(t)})", _lit(t)) for t in rules.DESCRIPTIONS], _lit(rules.DEFAULT_TYPE)
)
_TEMPLATE = _case(
    [(f"form_type = {_lit(t)}", _lit(text)) for t, text in rules.DESCRIPTIONS.items()], "NULL"
)
_AUDIT = ", ".join(map(_lit, rules.AUDIT_FIELDS))


def _scenario_sql() -> str:
    items = []
    for words, part, exact, template in rules.SCENARIOS:
        tests = [f"contains(txt, {_lit(word)})" for word in words]
        tests += [f"list_contains(names, {_lit(name)})" for name in exact]
        if part:
            tests.append(f"contains(lower(array_to_string(names, ' ')), {_lit(part)})")
        text = f"replace({_lit(template)}, '{{name}}', name)"
        items.append(f"CASE WHEN {' OR '.join(tests)} THEN {text} END")
    general = ", ".join(f"replace({_lit(t)}, '{{name}}', name)" for t in rules.FALLBACK_SCENARIOS)
    found = f"list_filter([{', '.join(items)}], lambda s: s IS NOT NULL)"
    return f"CASE WHEN len({found}) > 0 THEN {found}[1:5] ELSE [{general}] END"


cte(
    "typed_forms",
    f"SELECT *, {_DOMAIN} AS domain, {_TYPE} AS form_type, {_scenario_sql()} AS scenarios, "
    f"list_filter(names[1:5], lambda f: f NOT IN ('', {_AUDIT})) AS keys FROM named",
)
cte(
    "described",
    f"""
    SELECT *, replace(replace({_TEMPLATE}, '{{domain}}', domain), '{{name}}', name)
           || CASE WHEN len(keys) > 0 THEN {_lit(rules.KEY_FIELDS_BEFORE)}
              || array_to_string(keys[1:3], ', ') || {_lit(rules.KEY_FIELDS_AFTER)} ELSE '' END
           AS description
    FROM typed_forms
    """,
)
cte(
    "filled",
    f"""
    SELECT *, CASE WHEN contains(md, {_lit(rules.DESCRIPTION_MARKER)}) THEN
      replace(replace(md, {_lines(_lit(rules.DESCRIPTION_MARKER), _lit(rules.DESCRIPTION_TODO))},
                      description),
              {_lines(_lit(rules.SCENARIO_MARKER), _lit(rules.SCENARIO_TODO))},
              '- ' || array_to_string(scenarios, {_NL} || '- ')) END AS result
    FROM described
    """,
)
_FILE = (
    "regexp_replace(coalesce(form_id, 'unknown_' || p_partkey), '[<>:\"/\\\\|?*]', '_', 'g') || '_' || "
    f"regexp_replace(coalesce(form_name, {_lit(rules.UNNAMED_FILE)}), '[<>:\"/\\\\|?*]', '_', 'g') "
    "|| '.md'"
)


def _records(spark, folder):
    """The records under their source names; the part key stands for the position in the file."""
    return form_table(spark, folder).select(
        F.col("p_partkey").alias("position"),
        F.col("form_id").alias("FK_NYLQ_NUMBER"),
        F.col("form_name").alias("FK_NYLQ_NAME"),
        F.col("structure").alias("FK_NYLQ_STRUCTURE_TAG"),
        F.lit(None).cast("string").alias("form_id"),
        F.lit(None).cast("string").alias("form_name"),
    )


def _rendered(spark, folder, sound=False):
    """Documents of all records, or of the ``sound`` ones that have a structure."""
    rows = form_table(spark, folder)
    if sound:
        rows = rows.where(F.col("structure").isNotNull())
    md = forms.render_form_markdown(
        F.col("form_id"), F.col("form_name"), F.col("structure"), F.lit(CREATED)
    )
    return rows.select("p_partkey", "form_id", "form_name", md.alias("md"))


def _parsed(spark, folder):
    parsed = _rendered(spark, folder, sound=True).select(
        "p_partkey",
        "md",
        forms.extract_form_info(F.col("md")).alias("info"),
        forms.parse_form_fields(F.col("md")).alias("fields"),
    )
    return parsed.select(
        "p_partkey",
        "md",
        F.col("info.form_name").alias("name"),
        F.col("info.form_id").alias("id"),
        "fields",
        F.transform("fields", lambda field: field["name"]).alias("names"),
    )


@query("form_filename", sql(f"SELECT p_partkey, {_FILE} AS filename FROM forms", "forms"))
def _(spark, folder):
    name = forms.form_filename(F.col("form_id"), F.col("form_name"), F.col("p_partkey"))
    return form_table(spark, folder).select("p_partkey", name.alias("filename"))


@query("render_form_markdown", sql("SELECT p_partkey, md FROM rendered", "rendered"))
def _(spark, folder):
    return _rendered(spark, folder).select("p_partkey", "md")


@query("inject_placeholders", sql("SELECT p_partkey, md FROM injected", "injected"))
def _(spark, folder):
    rows = form_table(spark, folder).where(F.col("structure").isNotNull())
    return rows.select("p_partkey", forms.inject_placeholders(F.col("structure")).alias("md"))


@query(
    "extract_form_info",
    sql("SELECT p_partkey, name AS form_name, id AS form_id FROM parsed", "parsed"),
)
def _(spark, folder):
    return _parsed(spark, folder).select(
        "p_partkey", F.col("name").alias("form_name"), F.col("id").alias("form_id")
    )


@query(
    "parse_form_fields",
    sql("SELECT p_partkey, pos::INTEGER AS pos, field_name, path, field_type FROM field_rows", "field_rows"),
)
def _(spark, folder):
    rows = _parsed(spark, folder).select("p_partkey", F.posexplode("fields").alias("pos", "f"))
    return rows.select(
        "p_partkey",
        (F.col("pos") + 1).alias("pos"),
        F.col("f.name").alias("field_name"),
        F.col("f.path").alias("path"),
        F.col("f.type").alias("field_type"),
    )


@query("detect_domain", sql("SELECT p_partkey, domain FROM typed_forms", "typed_forms"))
def _(spark, folder):
    domain = forms.detect_domain(F.col("name"), F.col("names"))
    return _parsed(spark, folder).select("p_partkey", domain.alias("domain"))


# Keywords for the documents' languages: the word list is a parameter.
_WORDS = {
    "english": [" the ", " and ", " with "],
    "french": [" une ", " dans ", " des "],
    "german": [" und ", " der ", " die "],
}


@query(
    "detect_domain_documents",
    "SELECT doc_id, "
    + _case(
        [(f"regexp_matches(text || lang, '{'|'.join(words)}')", _lit(d)) for d, words in _WORDS.items()],
        "'other'",
    )
    + " AS domain FROM documents",
)
def _(spark, folder):
    domain = forms.detect_domain(F.col("text"), F.array("lang"), _WORDS, "other")
    return table(spark, folder, "documents").select("doc_id", domain.alias("domain"))


@query("detect_type", sql("SELECT p_partkey, form_type FROM typed_forms", "typed_forms"))
def _(spark, folder):
    kind = forms.detect_type(F.col("name"))
    return _parsed(spark, folder).select("p_partkey", kind.alias("form_type"))


@query("describe_forms", sql("SELECT p_partkey, description FROM described", "described"))
def _(spark, folder):
    name, names = F.col("name"), F.col("names")
    text = forms.describe_forms(
        name, names, forms.detect_domain(name, names), forms.detect_type(name)
    )
    return _parsed(spark, folder).select("p_partkey", text.alias("description"))


@query(
    "form_scenarios",
    sql(
        f"SELECT p_partkey, array_to_string(scenarios, {_NL}) AS scenarios FROM typed_forms",
        "typed_forms",
    ),
)
def _(spark, folder):
    found = forms.form_scenarios(F.col("name"), F.col("names"))
    return _parsed(spark, folder).select(
        "p_partkey", F.array_join(found, "\n").alias("scenarios")
    )


@query(
    "fill_placeholders",
    sql("SELECT p_partkey, name AS form_name, domain, form_type, result AS described FROM filled", "filled"),
)
def _(spark, folder):
    rendered = _rendered(spark, folder, sound=True).select("p_partkey", "md")
    return forms.describe_documents(rendered).select(
        "p_partkey", "form_name", "domain", "form_type", "described"
    )


@query(
    "conversion_stats",
    sql(
        "SELECT count(*) AS total, count(md) AS success, count(*) - count(md) AS failed "
        "FROM rendered",
        "rendered",
    ),
)
def _(spark, folder):
    return conversion_stats(forms.convert_forms(_records(spark, folder), F.lit(CREATED)))


@query(
    "write_form_markdown",
    sql(f"SELECT {_FILE} AS filename, md FROM rendered WHERE md IS NOT NULL", "rendered"),
)
def _(spark, folder):
    converted = forms.convert_forms(_records(spark, folder), F.lit(CREATED))
    return write_form_markdown(converted, scratch_path(spark, "forms"))
