"""String, path and time expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space of any script: separators, line ends and control spaces.
_SPACES = "".join(chr(code) for code in range(0x3001) if chr(code).isspace())


def strip(text: Column) -> Column:
    """Remove white space of any kind from both ends."""
    return F.btrim(text, F.lit(_SPACES))


def is_blank(text: Column) -> Column:
    """True for null, empty and white-space-only text."""
    return text.isNull() | (strip(text) == "")


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def file_stem(path: Column) -> Column:
    """File name without its last suffix: ``a.b.md`` gives ``a.b``, ``.md`` stays ``.md``."""
    return F.regexp_extract(path, r"([^/]+?)(\.[^./]+)?/*$", 1)


def file_suffix(path: Column) -> Column:
    """Last suffix with its dot, empty when there is none."""
    return F.regexp_extract(path, r"[^/](\.[^./]+)/*$", 1)


def safe_file_name(name: Column) -> Column:
    """Replace the characters that file systems refuse."""
    # Fixed value: the refused characters.
    return F.regexp_replace(name, r'[<>:"/\\|?*]', "_")


def preview(text: Column, size: int) -> Column:
    """First ``size`` characters, marked with an ellipsis when something was cut."""
    head = F.substring(text, 1, size)
    return F.when(F.length(text) > size, F.concat(head, F.lit("..."))).otherwise(head)


def relative_time(ts: Column, now: Column) -> Column:
    """Age in words: just now, minutes, hours, days, then the date."""
    age = F.unix_micros(now.cast("timestamp")) - F.unix_micros(ts.cast("timestamp"))
    minute = 60 * 1_000_000

    def units(size: int, label: str) -> Column:
        return F.concat(F.floor(age / F.lit(size)).cast("string"), F.lit(label))

    # Labels and limits.
    return (
        F.when(age < minute, F.lit("刚刚"))
        .when(age < 60 * minute, units(minute, "分钟前"))
        .when(age < 24 * 60 * minute, units(60 * minute, "小时前"))
        .when(age < 7 * 24 * 60 * minute, units(24 * 60 * minute, "天前"))
        .otherwise(F.date_format(ts, "yyyy-MM-dd"))
    )
