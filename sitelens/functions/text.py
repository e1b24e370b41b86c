"""Percent decoding and URL parts (P1 to P4), and numbers in text."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

HOUR_MS = 3_600_000
#: What counts as a number in text: sign, decimals, exponent.
NUMBER = r"^[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?$"


def decoded_path(stem: Column) -> Column:
    """The path, which the log writes percent-encoded twice; a bad escape gives null."""
    return F.try_url_decode(F.try_url_decode(stem))


def raw_parameter(query: Column, name: str) -> Column:
    """The value of a query parameter as it stands; empty if it isn't there."""
    return F.regexp_extract(query, rf"(?:^|&){re.escape(name)}=([^&]*)", 1)


def parameter(query: Column, name: str) -> Column:
    """A query parameter, decoded twice: by the log's own encoding and the client's."""
    return F.try_url_decode(F.try_url_decode(raw_parameter(query, name)))


def half_decoded_parameter(query: Column, name: str) -> Column:
    """A query parameter, decoded once; '' where it is absent or badly escaped."""
    return F.coalesce(F.try_url_decode(raw_parameter(query, name)), F.lit(""))


def referrer_host(referer: Column) -> Column:
    """The host of a URL; null for '-' and for what is no URL."""
    return F.try_parse_url(referer, F.lit("HOST"))


def hour_number(ts_ms: Column) -> Column:
    """Hours since the epoch."""
    return F.floor(ts_ms / HOUR_MS).cast("long")


def is_number(text: Column) -> Column:
    return text.rlike(NUMBER)


def measured(text: Column) -> Column:
    """The number a text holds, or null."""
    return F.when(is_number(text), text.try_cast("double"))


def percent(part: Column, whole: Column) -> Column:
    """100 * part / whole to one decimal; null when the whole is 0."""
    return F.round(F.lit(100.0) * part / F.nullif(whole, F.lit(0)), 1).cast("double")


def count_where(condition: Column) -> Column:
    """Rows that meet a condition; null over no rows at all, as in SQL."""
    return F.sum(F.when(condition, 1).otherwise(0)).cast("long")


def any_of(column: Column, values) -> Column:
    """Membership; an empty list holds nothing."""
    values = list(values)
    return column.isin(*values) if values else F.lit(False)
