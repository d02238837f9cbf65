"""Scalar functions of the fact queries, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def basename(path: Column) -> Column:
    """The part behind the last slash or backslash."""
    return F.element_at(F.split(path, r"[/\\]"), -1)


def qualifier(name: Column) -> Column:
    """What stands before the last ::, or an empty text."""
    return F.regexp_extract(name, "^(.*)::[^:]+$", 1)


def last_part(name: Column) -> Column:
    return F.element_at(F.split(name, "::"), -1)


def unquoted(text: Column) -> Column:
    """Text for a double-quoted place: backslashes and quotes escaped."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))


def signature(name: Column, types: Column) -> Column:
    """name(t1, t2): array types decay to pointers."""
    return F.concat(name, F.lit("("), F.array_join(F.transform(types, lambda t: F.regexp_replace(t, r"\s*\[[^\]]*\]$", " *")), ", "), F.lit(")"))
