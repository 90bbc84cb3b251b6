"""Texts: numbers in them, their ends, lists of names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def number_text(value: Column, pattern: str | None = None) -> Column:
    """A number as text: by a printf pattern, or as short as it can be; truth values as ``True`` and ``False``."""
    return F.format_string(pattern, value) if pattern else value.cast("string")


def list_text(values: Column, pattern: str | None = None) -> Column:
    """Numbers as one text, with a comma and a blank between."""
    return F.array_join(F.transform(values, lambda v: number_text(v, pattern)), ", ")


def chomp(text: Column) -> Column:
    """A text up to its first NUL, without blanks at its end."""
    return F.rtrim(F.substring_index(text, "\0", 1))


def copied(text: Column, length: int, strict: bool = False) -> Column:
    """A text in a field of ``length``: padded with blanks, cut, or (``strict``) an error if it is longer."""
    cut = F.rpad(text, length, " ")
    if strict:
        cut = F.when(F.length(F.rtrim(text)) > length, F.raise_error(F.concat(F.lit("too long: "), text)).cast("string")).otherwise(cut)
    return cut


def name_index(names: Column, name: Column) -> Column:
    """The place of a name among others, from 1, ends trimmed; 0 if it is not there, null of null."""
    return F.array_position(F.transform(names, lambda x: F.rtrim(x)), F.rtrim(name)).cast("int")


def all_indices(names: Column, name: Column) -> Column:
    """All places of a name, from 1."""
    at = F.transform(names, lambda x, n: F.when(F.rtrim(x) == F.rtrim(name), n + 1))
    return F.array_compact(at)


def count_unique(names: Column) -> Column:
    return F.size(F.array_distinct(F.transform(names, lambda x: F.rtrim(x))))


def append_unique(names: Column, more: Column) -> Column:
    """Names and those of ``more`` that they lack, each once, in the order of coming."""
    return F.array_union(F.transform(names, lambda x: F.rtrim(x)), F.transform(more, lambda x: F.rtrim(x)))
