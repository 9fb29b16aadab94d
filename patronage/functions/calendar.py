"""Calendar parts, month keys and strptime-style date formats."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

# The two month-key layouts.  The short one sorts as a string, so
# 00_01 comes before 95_01; the long one is chronological.
SHORT_MONTH = "yy_MM"
LONG_MONTH = "yyyy_MM"
MONTH_FORMATS = (SHORT_MONTH, LONG_MONTH)

# Strptime directive -> Spark datetime pattern.
STRPTIME_TO_SPARK = {
    "%d": "d",
    "%m": "M",
    "%b": "MMM",
    "%B": "MMMM",
    "%y": "yy",
    "%Y": "yyyy",
    "%j": "D",
    "%H": "H",
    "%I": "h",
    "%p": "a",
    "%M": "m",
    "%S": "s",
    "%f": "SSSSSS",
}
TWO_DIGIT_FIELDS = ("d", "M", "H", "h", "m", "s")


def spark_pattern(strptime_format: str) -> str:
    """Translate a strptime format; letters outside directives are quoted.

    A lone ``d`` reads both ``1`` and ``01``, as strptime does.  Between
    directives that touch, as in ``%Y%m%d``, only fixed widths can be told apart.
    """
    tokens = re.findall(r"%.|[^%]|%$", strptime_format, flags=re.DOTALL)
    directive = [t[0] == "%" and t != "%%" for t in tokens]
    out, text = [], ""
    for i, token in enumerate(tokens):
        if not directive[i]:
            text += token[-1]
            continue
        if token not in STRPTIME_TO_SPARK:
            raise ValueError(f"unsupported date directive {token!r}")
        out.append(_literal(text))
        text = ""
        pattern = STRPTIME_TO_SPARK[token]
        touches = any(directive[max(i - 1, 0) : i]) or any(directive[i + 1 : i + 2])
        out.append(pattern * 2 if touches and pattern in TWO_DIGIT_FIELDS else pattern)
    return "".join([*out, _literal(text)])


def _literal(text: str) -> str:
    """Text as it stands; letters and signs that patterns give a meaning are quoted."""
    if re.search(r"[A-Za-z\[\]{}#'%]", text) is None:
        return text
    return "'" + text.replace("'", "''") + "'"


def pivot_two_digit_year(date: Column) -> Column:
    """strptime reads %y 69..99 as 19xx, Spark's yy reads them as 20xx."""
    return F.when(F.year(date) >= 2069, date - F.make_ym_interval(F.lit(100))).otherwise(date)


def month_key(date: Column, month_format: str = SHORT_MONTH) -> Column:
    """Integer month key whose order equals the order of its text form.

    Integers are what gets grouped and shuffled; the text is rendered from the
    reduced result with :func:`month_label`.
    """
    year = F.year(date)
    if month_format == SHORT_MONTH:
        year = F.pmod(year, F.lit(100))
    return year * 100 + F.month(date)


def month_label(key: str | Column = "ym", month_format: str = SHORT_MONTH) -> Column:
    """Text form of a month key, ``95_01`` or ``1995_01``; NULL for NULL."""
    key = F.col(key) if isinstance(key, str) else key
    width = 2 if month_format == SHORT_MONTH else 4
    year = F.floor(key / 100).cast("int").cast("string")
    month = (key % 100).cast("string")
    return F.concat(F.lpad(year, width, "0"), F.lit("_"), F.lpad(month, 2, "0"))


def month_of_year(key: str = "ym") -> Column:
    """Month 1..12 of a month key."""
    return F.col(key) % 100
