"""Predicates as columns (R19-R26). Terms are parameters; only columns are data."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import is_blank, is_obfuscated_package, trimmed


def keyword_in(lowered: Column, keyword: str | None) -> Column:
    """A trimmed, case-insensitive substring of an already lower-cased column; blank passes all."""
    return F.lit(True) if is_blank(keyword) else lowered.contains(trimmed(keyword).lower())


def term_in(lowered: Column, term: str) -> Column:
    """As keyword_in, but the term isn't trimmed."""
    return lowered.contains(term.lower())


def code_has(code: Column, term: str) -> Column:
    """Case-insensitive; null never matches."""
    return F.lower(code).contains(term.lower())


def search_locations(search_in: str | None) -> frozenset[str]:
    """Which of name and code to search."""
    parts = [] if is_blank(search_in) else search_in.split(",")
    found = {place for word, place in (("class_name", "name"), ("code", "code")) if any(word in p for p in parts)}
    return frozenset(found or {"name"})


def in_package(full_name: Column, prefix: str | None, segments: bool = False) -> Column:
    """Starts with the prefix, inside a segment too unless `segments`; blank and obfuscated prefixes pass all."""
    if is_blank(prefix) or is_obfuscated_package(prefix):
        return F.lit(True)
    if segments:
        return (full_name == prefix) | full_name.startswith(prefix.rstrip(".") + ".")
    return full_name.startswith(prefix)


def first_signature(code: Column, signatures: list[str]) -> Column:
    """The first signature, in list order, that the text holds; null without one."""
    return F.coalesce(*[F.when(code.contains(s), F.lit(s)) for s in signatures]) if signatures else F.lit(None).cast("string")


def any_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))
