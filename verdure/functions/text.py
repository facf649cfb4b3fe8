"""Names, tokens and hashes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that search ignores (fixed values).
STOP = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "how", "in", "is", "it", "of", "on", "or", "that", "the", "to", "what", "when", "which", "with")


def name_key(c: Column) -> Column:
    return F.upper(F.trim(c))


def column_key(name: str) -> str:
    """Column names match regardless of case, spaces, - and _."""
    return "".join(x for x in name.lower() if x not in " -_")


def file_name(c: Column) -> Column:
    return F.translate(c, " /", "_-")


def tokens(c: Column) -> Column:
    """Lower-case words of letters, digits and _, and the parts of words with _; without stop words."""
    return once(F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9_]+)"), 1), _without_stops)


def _without_stops(found: Column) -> Column:
    parts = F.flatten(F.transform(F.filter(found, lambda w: w.contains("_")), lambda w: F.filter(F.split(w, "_"), lambda p: p != "")))
    return F.filter(F.concat(found, parts), lambda w: ~w.isin(*STOP))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value evaluated once, however often ``use`` names it: collapsed projections would repeat it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def digest(*cols: Column) -> Column:
    """Ten hex digits that name a combination of values."""
    return F.substring(F.md5(F.to_json(F.struct(*cols))), 1, 10)
