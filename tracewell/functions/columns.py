"""Column expressions that the operators share."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tokens that stand for a missing value in tab-separated sidecar files.
NA_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
_NUMBER = r"^\s*[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?|[iI]nf(inity)?|[nN]a[nN])\s*$"


def null_tokens(c: Column, tokens: Sequence[str] = NA_TOKENS) -> Column:
    return F.when(~c.isin(*tokens), c)


def to_number(c: Column) -> Column:
    """Double, or null where the text is no plain number (a suffix such as 1d is none) or not a number."""
    text = c.cast("string")
    value = F.when(text.rlike(_NUMBER), F.trim(text).try_cast("double"))
    return F.when(~F.isnan(value), value)


def finite(c: Column) -> Column:
    return F.coalesce(c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.lit(False))


def seconds(ts: Column) -> Column:
    """Seconds since 1970 as double; zoneless time counts as UTC."""
    return F.unix_micros(ts.cast("timestamp")) / F.lit(1e6)


def entity(name: Column, key: str) -> Column:
    """Value of key- in a name of underscore-separated parts; null where the part is missing."""
    return F.nullif(F.regexp_extract(name, rf"(?:^|_){key}-([^_]+)", 1), F.lit(""))


def base_name(path: Column) -> Column:
    """File name without directories; both kinds of slash separate."""
    return F.regexp_extract(F.replace(path, F.lit("\\"), F.lit("/")), r"([^/]*)$", 1)


def json_first_number(raw: Column, keys: Sequence[str]) -> Column:
    """The first of the keys whose value is a finite number above 0."""

    def one(key: str) -> Column:
        v = F.get_json_object(raw, f"$.{key}").try_cast("double")
        return F.when(finite(v) & (v > 0), v)

    return F.coalesce(*(one(k) for k in keys))
