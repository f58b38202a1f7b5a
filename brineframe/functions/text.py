"""Small text helpers for manifests, attributes and catalog links."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .missing import as_col


def is_url(c: Column | str) -> Column:
    return F.coalesce(as_col(c).rlike("^https?://"), F.lit(False))


def join_url(base: Column | str, href: Column | str) -> Column:
    """Absolute links stay; relative ones hang below ``base`` with one slash."""
    href = as_col(href)
    below = F.concat(F.rtrim(as_col(base), F.lit("/")), F.lit("/"), F.ltrim(href, F.lit("/")))
    return F.when(is_url(href), href).otherwise(below)


def like_glob(c: Column | str, pattern: str) -> Column:
    """File-name globbing with ``*`` and ``?``; everything else is literal."""
    escaped = pattern.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return as_col(c).like(escaped.replace("*", "%").replace("?", "_"))


def date_token(c: Column | str) -> Column:
    """The first eight-digit date in a file name, whatever follows it."""
    digits = F.regexp_extract(as_col(c), r"(\d{8})", 1)
    return F.try_to_date(digits, "yyyyMMdd")


def version_token(c: Column | str, default: str = "v1") -> Column:
    token = F.regexp_extract(as_col(c), r"_(v\d+)(?:[._]|$)", 1)
    return F.when(token == "", F.lit(default)).otherwise(token)
