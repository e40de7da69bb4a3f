"""Form records to described Markdown: one chain of column expressions, no shuffle."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectorloom.functions.text import safe_file_name, strip
from vectorloom.operators import form_rules as rules

_SECTIONS = [
    rules.DESCRIPTION_HEADING,
    "",
    rules.DESCRIPTION_MARKER,
    rules.DESCRIPTION_TODO,
    "",
    rules.SCENARIO_HEADING,
    "",
    rules.SCENARIO_MARKER,
    rules.SCENARIO_TODO,
    "",
]


def _lit_lines(lines: list[str]) -> Column:
    return F.array(*(F.lit(line) for line in lines))


def form_filename(
    form_id: Column, form_name: Column, position: Column, prefix: str = ""
) -> Column:
    """``prefix + id + _ + name + .md`` with safe characters and numbered fallback ids."""
    identifier = F.coalesce(form_id, F.concat(F.lit("unknown_"), position.cast("string")))
    name = F.coalesce(form_name, F.lit(rules.UNNAMED_FILE))
    return F.concat(
        F.lit(prefix), safe_file_name(identifier), F.lit("_"), safe_file_name(name), F.lit(".md")
    )


def inject_placeholders(md: Column) -> Column:
    """Insert the two description sections before the first line that starts with ``##``.

    Text that already has a description heading is returned as it is; without any ``##`` line the
    sections come first.
    """
    lines = F.split(md, "\n")
    heading = F.array_position(F.transform(lines, lambda line: line.startswith("##")), True)
    before = F.greatest(heading - 1, F.lit(0)).cast("int")
    merged = F.concat(
        F.slice(lines, F.lit(1), before),
        _lit_lines(["", *_SECTIONS]),
        F.slice(lines, before + 1, F.size(lines)),
    )
    has_heading = md.contains(rules.DESCRIPTION_HEADING)
    return F.when(has_heading, md).otherwise(F.array_join(merged, "\n"))


def render_form_markdown(
    form_id: Column,
    form_name: Column,
    structure: Column,
    created_at: Column,
    placeholders: bool = True,
) -> Column:
    """The Markdown document of one form record; null when the structure is null.

    A structure that is Markdown itself is kept and only gets its missing sections; anything else
    becomes the field section of a new document.
    """
    identifier = F.coalesce(form_id, F.lit(rules.UNKNOWN_ID))
    name = F.coalesce(form_name, F.lit(rules.UNNAMED_FORM))
    body = F.when(structure == "", F.lit(rules.NO_FIELDS)).otherwise(structure)
    sections = _SECTIONS if placeholders else []
    lines = [
        F.concat(F.lit("# "), name),
        F.lit(""),
        F.concat(F.lit(rules.ID_LABEL + ": `"), identifier, F.lit("`")),
        F.lit(""),
        *map(F.lit, sections),
        F.lit(rules.FIELDS_HEADING),
        F.lit(""),
        body,
        F.lit(""),
        F.lit("---"),
        F.lit(""),
        F.concat(F.lit(rules.CREATED_LABEL), created_at),
        F.lit(rules.ORIGIN_LINE),
        F.lit(""),
    ]
    complete = inject_placeholders(structure) if placeholders else structure
    built = F.concat_ws("\n", *lines)
    rendered = F.when(strip(structure).startswith("#"), complete).otherwise(built)
    return F.when(structure.isNotNull(), rendered)


def extract_form_info(md: Column) -> Column:
    """Struct ``(form_name, form_id)`` from the title line, with defaults."""
    found = md.rlike(rules.TITLE_PATTERN)

    def part(group: int, default: str) -> Column:
        value = strip(F.regexp_extract(md, rules.TITLE_PATTERN, group))
        return F.when(found, value).otherwise(F.lit(default))

    return F.struct(
        part(1, rules.UNNAMED_FORM).alias("form_name"), part(2, rules.UNKNOWN_ID).alias("form_id")
    )


def parse_form_fields(md: Column) -> Column:
    """Array of ``(name, path, type)`` from the field table, separator rows skipped."""
    table = strip(F.regexp_extract(md, rules.TABLE_PATTERN, 1))
    rows = F.filter(
        F.split(table, "\n"),
        lambda line: line.startswith("|") & ~line.startswith(rules.TABLE_HEADER),
    )
    cells = F.transform(rows, lambda line: F.transform(F.split(line, r"\|"), strip))

    def is_field(row: Column) -> Column:
        inner = F.slice(row, F.lit(2), F.greatest(F.size(row) - 2, F.lit(0)))
        separator = F.forall(inner, lambda cell: cell.rlike("^[-: ]+$"))
        name = F.get(row, F.lit(3))
        return (F.size(row) >= 5) & (name != "") & (name != rules.NAME_HEADER) & ~separator

    return F.transform(
        F.filter(cells, is_field),
        lambda row: F.struct(
            F.get(row, F.lit(3)).alias("name"),
            F.replace(F.get(row, F.lit(2)), F.lit("`"), F.lit("")).alias("path"),
            F.get(row, F.lit(4)).alias("type"),
        ),
    )


def _any_word(text: Column, words: list[str]) -> Column:
    """True when the text contains one of the words."""
    return F.exists(_lit_lines(words), lambda word: text.contains(word))


def _with_combined(name: Column, field_names: Column, use) -> Column:
    """Apply ``use`` to form name and field names as one text.

    The one-element array makes Spark build the text once per row, not once per word looked for.
    """
    text = F.concat(name, F.array_join(field_names, " "))
    return F.get(F.transform(F.array(text), use), F.lit(0))


def detect_domain(
    name: Column,
    field_names: Column,
    domains: dict[str, list[str]] = rules.DOMAINS,
    default: str = rules.DEFAULT_DOMAIN,
) -> Column:
    """First domain with a keyword in the form name or a field name."""

    def first_hit(text: Column) -> Column:
        hits = [F.when(_any_word(text, words), F.lit(domain)) for domain, words in domains.items()]
        return F.coalesce(*hits, F.lit(default))

    return _with_combined(name, field_names, first_hit)


def detect_type(
    name: Column, types: list[str] = list(rules.DESCRIPTIONS), default: str = rules.DEFAULT_TYPE
) -> Column:
    """First form type whose name is part of the form name."""
    return F.coalesce(*(F.when(name.contains(t), F.lit(t)) for t in types), F.lit(default))


def describe_forms(
    name: Column,
    field_names: Column,
    domain: Column,
    form_type: Column,
    templates: dict[str, str] = rules.DESCRIPTIONS,
    default: str = rules.DEFAULT_TYPE,
) -> Column:
    """Template of the form type, followed by the key fields."""
    template = F.coalesce(
        *(F.when(form_type == kind, F.lit(text)) for kind, text in templates.items()),
        F.lit(templates[default]),
    )
    text = F.replace(F.replace(template, F.lit("{domain}"), domain), F.lit("{name}"), name)
    audit = [F.lit(field) for field in rules.AUDIT_FIELDS]
    eligible = F.filter(
        F.slice(field_names, 1, rules.KEY_FIELDS_SEEN), lambda f: (f != "") & ~f.isin(*audit)
    )
    named = F.array_join(F.slice(eligible, 1, rules.KEY_FIELDS_NAMED), ", ")
    sentence = F.concat(F.lit(rules.KEY_FIELDS_BEFORE), named, F.lit(rules.KEY_FIELDS_AFTER))
    return F.concat(text, F.when(F.size(eligible) > 0, sentence).otherwise(""))


def _contains(word: str):
    return lambda text: text.contains(word)


def form_scenarios(name: Column, field_names: Column) -> Column:
    """Array of up to five scenarios that the rules find, or the three general ones."""

    def filled(template: str) -> Column:
        return F.replace(F.lit(template), F.lit("{name}"), name)

    def rule(text: Column, words, part, exact, template) -> Column:
        tests = []
        if words:
            tests.append(_any_word(text, words))
        if part:
            tests.append(F.exists(F.transform(field_names, F.lower), _contains(part)))
        if exact:
            tests.append(F.arrays_overlap(field_names, _lit_lines(exact)))
        return F.when(reduce(or_, tests), filled(template))

    matched = _with_combined(
        name,
        field_names,
        lambda text: F.array_compact(F.array(*(rule(text, *entry) for entry in rules.SCENARIOS))),
    )
    general = F.array(*(filled(template) for template in rules.FALLBACK_SCENARIOS))
    return F.get(
        F.transform(
            F.array(matched),
            lambda hits: F.slice(
                F.when(F.size(hits) > 0, hits).otherwise(general), 1, rules.MAX_SCENARIOS
            ),
        ),
        F.lit(0),
    )


def fill_placeholders(md: Column, description: Column, scenarios: Column) -> Column:
    """Put description and scenario list in place of the markers; null without the first marker."""
    items = F.array_join(F.transform(scenarios, lambda s: F.concat(F.lit("- "), s)), "\n")

    def marker(first: str, second: str) -> Column:
        return F.lit(f"{first}\n{second}")

    described = F.replace(
        md, marker(rules.DESCRIPTION_MARKER, rules.DESCRIPTION_TODO), description
    )
    filled = F.replace(described, marker(rules.SCENARIO_MARKER, rules.SCENARIO_TODO), items)
    return F.when(md.contains(rules.DESCRIPTION_MARKER), filled)


def convert_forms(
    records: DataFrame, created_at: Column, prefix: str = "", *kept: str
) -> DataFrame:
    """Form records to ``(filename, md)``; ``md`` is null for a failed record.

    ``kept`` names columns of the records to carry along.
    """
    identifier = F.coalesce("FK_NYLQ_NUMBER", "form_id")
    name = F.coalesce("FK_NYLQ_NAME", "form_name")
    md = render_form_markdown(
        F.col("FK_NYLQ_NUMBER"), F.col("FK_NYLQ_NAME"), F.col("FK_NYLQ_STRUCTURE_TAG"), created_at
    )
    return records.select(
        *kept,
        form_filename(identifier, name, F.col("position"), prefix).alias("filename"),
        md.alias("md"),
    )


def describe_documents(df: DataFrame, md: str = "md") -> DataFrame:
    """Parse form documents, derive description and scenarios, and fill them in.

    Adds ``form_name``, ``form_id``, ``domain``, ``form_type``, ``described``; ``described`` is
    null for a document without markers.
    """
    parsed = df.withColumn("_info", extract_form_info(F.col(md))).withColumn(
        "_names", F.transform(parse_form_fields(F.col(md)), lambda field: field["name"])
    )
    name, names = F.col("_info.form_name"), F.col("_names")
    typed = parsed.withColumns(
        {
            "form_name": name,
            "form_id": F.col("_info.form_id"),
            "domain": detect_domain(name, names),
            "form_type": detect_type(name),
        }
    )
    description = describe_forms(name, names, F.col("domain"), F.col("form_type"))
    filled = fill_placeholders(F.col(md), description, form_scenarios(name, names))
    return typed.withColumn("described", filled).drop("_info", "_names")
