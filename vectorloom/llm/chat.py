r"""Chat formatting with a grammar round trip, in DataFrame operations.

    formatted := turn*
    turn      := open " " body " " close
    open/close: <<SYS>> <</SYS>> (system), [INST] [/INST] (user), <s> </s> (assistant)
                [ROLE] [/ROLE] (any other role: the body is the role, " [SEP] " and the text)

A body ends at the first close marker behind a space. Inside bodies, a backslash is put in front of every
control string (and its backslashes, if it has some already), so no body contains a marker behind a space;
reading takes one backslash away again. The first rendering leaves texts as they are. It is read with
the parser and compared with the source; conversations that come back changed are rendered with escapes,
which always come back.

Turns are ordered by ``turn`` (null first), then role and text. A null role or text is an empty one. Repeated
rows are repeated turns. Rows without a conversation id are one conversation. Extra columns are ignored.
A conversation is one value, so its turns are gathered in one row; conversations are spread by their id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The markers of the template; the first three pairs belong to roles.
MARKERS = {
    "system": ("<<SYS>>", "<</SYS>>"),
    "user": ("[INST]", "[/INST]"),
    "assistant": ("<s>", "</s>"),
    None: ("[ROLE]", "[/ROLE]"),
}
SEPARATOR = "[SEP]"
CONTROL = [marker for pair in MARKERS.values() for marker in pair] + [SEPARATOR]


def _literal(text: str) -> str:
    """A regular expression that matches the text."""
    return "".join("\\" + c if c in "[]" else c for c in text)


ANY_CONTROL = "|".join(map(_literal, CONTROL))
ESCAPES = rf"(\\*(?:{ANY_CONTROL}))"
UNESCAPES = rf"\\(\\*(?:{ANY_CONTROL}))"
TURN = "|".join(rf"{_literal(a)} .*? {_literal(b)}" for a, b in MARKERS.values())


def escape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPES, r"\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, UNESCAPES, "$1")


def _render_turn(turn: Column, escaped: bool) -> Column:
    own = escape if escaped else (lambda text: text)
    parts = F.when(F.lit(False), F.lit(""))
    for role, (start, stop) in MARKERS.items():
        body = own(turn["text"])
        if role is None:
            body = F.concat(own(turn["role"]), F.lit(f" {SEPARATOR} "), body)
            return parts.otherwise(F.concat(F.lit(f"{start} "), body, F.lit(f" {stop}")))
        parts = parts.when(turn["role"] == role, F.concat(F.lit(f"{start} "), body, F.lit(f" {stop}")))
    raise AssertionError("the last pair of markers takes any role")


def render(turns: Column, escaped: bool) -> Column:
    return F.array_join(F.transform(turns, lambda turn: _render_turn(turn, escaped)), "")


def segments(formatted: Column) -> Column:
    """The turns of a formatted text as they stand there."""
    return F.regexp_extract_all(formatted, F.lit(f"(?s){TURN}"), F.lit(0))


def _read_segment(segment: Column) -> Column:
    result = F.when(F.lit(False), F.struct(F.lit("").alias("role"), F.lit("").alias("text")))
    for role, (start, stop) in MARKERS.items():
        lead = len(start) + 1
        body = F.substring(segment, F.lit(lead + 1), F.length(segment) - (lead + len(stop) + 1))
        if role is None:
            gap = f" {SEPARATOR} "
            name = F.substring_index(body, gap, 1)
            text = F.substring(body, F.length(name) + len(gap) + 1, F.length(body))
            return result.otherwise(
                F.struct(unescape(name).alias("role"), unescape(text).alias("text"))
            )
        result = result.when(
            F.startswith(segment, F.lit(f"{start} ")),
            F.struct(F.lit(role).alias("role"), unescape(body).alias("text")),
        )
    raise AssertionError("the last pair of markers takes any role")


def parse(formatted: Column) -> Column:
    """Turns ``(role, text)`` read from a formatted text."""
    return F.transform(segments(formatted), _read_segment)


def _loss_spans(pieces: Column) -> Column:
    """``(start, length)`` of the assistant bodies, in characters of the formatted text."""
    start, stop = MARKERS["assistant"]
    lead, rest = len(start) + 1, len(stop) + 1
    zero = F.struct(
        F.lit(0).alias("at"), F.array().cast("array<struct<start: int, length: int>>").alias("spans")
    )

    def step(state: Column, piece: Column) -> Column:
        span = F.struct(
            (state["at"] + lead).alias("start"), (F.length(piece) - lead - rest).alias("length")
        )
        own = F.when(F.startswith(piece, F.lit(f"{start} ")), F.array(span)).otherwise(
            F.array().cast("array<struct<start: int, length: int>>")
        )
        return F.struct(
            (state["at"] + F.length(piece)).alias("at"), F.concat(state["spans"], own).alias("spans")
        )

    return F.aggregate(pieces, zero, step, lambda state: state["spans"])


def format_chats(rows: DataFrame) -> DataFrame:
    """``(conv_id, formatted, escaped, turns, loss_spans, loss_text, same)`` per conversation.

    ``turns``, the spans and ``loss_text`` (all text under the loss mask, unescaped) are read back from
    ``formatted``; ``same`` says that the turns read equal the source.
    """
    ordered = F.array_sort(
        F.collect_list(
            F.struct(
                F.col("turn").isNotNull().alias("has_turn"),
                F.coalesce("turn", F.lit(0)).alias("turn"),
                F.coalesce("role", F.lit("")).alias("role"),
                F.coalesce("text", F.lit("")).alias("text"),
            )
        )
    )
    source = rows.groupBy("conv_id").agg(ordered.alias("rows")).select(
        "conv_id",
        F.transform("rows", lambda r: F.struct(r["role"].alias("role"), r["text"].alias("text"))).alias("source"),
    )
    plain = source.withColumn("plain", render(F.col("source"), escaped=False))
    compared = plain.withColumn("escaped", ~_says(F.col("plain"), F.col("source")))
    formatted = compared.withColumn(
        "formatted", F.when(F.col("escaped"), render(F.col("source"), escaped=True)).otherwise(F.col("plain"))
    )
    read = formatted.withColumn("pieces", segments(F.col("formatted"))).select(
        "conv_id",
        "formatted",
        "escaped",
        "source",
        F.transform("pieces", _read_segment).alias("turns"),
        _loss_spans(F.col("pieces")).alias("loss_spans"),
    )
    loss = F.array_join(
        F.transform(
            "loss_spans",
            lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["length"])),
        ),
        "",
    )
    return read.select(
        "conv_id",
        "formatted",
        "escaped",
        "turns",
        "loss_spans",
        loss.alias("loss_text"),
        (_says(F.col("formatted"), F.col("source"))).alias("same"),
    )


def _says(formatted: Column, source: Column) -> Column:
    """Whether a formatted text consists of turns only and these equal the source."""
    pieces = segments(formatted)
    return (F.array_join(pieces, "") == formatted) & (F.transform(pieces, _read_segment) == source)
