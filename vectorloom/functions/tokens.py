"""Token estimates and length buckets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vectorloom import settings

# Fixed value: the CJK range U+4E00..U+9FFF.
_CJK = "[一-鿿]"


def cjk_chars(text: Column) -> Column:
    return F.regexp_count(text, F.lit(_CJK))


def token_estimate(text: Column) -> Column:
    """One and a half tokens per CJK character, one per three others, at least one."""
    cjk = cjk_chars(text)
    others = F.floor((F.length(text) - cjk) / 3)
    return F.greatest(F.lit(1), F.floor((cjk * 3 + others * 2) / 2)).cast("int")


def token_estimate_alt(text: Column) -> Column:
    """One token per CJK character, one per four others, at least one."""
    cjk = cjk_chars(text)
    return F.greatest(F.lit(1), cjk + F.floor((F.length(text) - cjk) / 4)).cast("int")


def length_bucket(
    tokens: Column, short: int = settings.SHORT_TOKENS, medium: int = settings.MEDIUM_TOKENS
) -> Column:
    return F.when(tokens <= short, "short").when(tokens <= medium, "medium").otherwise("long")
