"""Identifier lists, flag strings and mixed truth values."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def parse_ids(text: Column) -> Column:
    """Integers of a comma list; entries that are not numbers are skipped."""
    numbers = F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda t: F.trim(t).try_cast("double"))
    return F.transform(F.filter(numbers, lambda v: v.isNotNull() & ~F.isnan(v)), lambda v: v.cast("long"))


def join_ids(ids: Column) -> Column:
    return F.concat_ws(",", F.transform(ids, lambda v: v.cast("string")))


def tags(pairs: list[tuple[Column, str | Column]], separator: str = ",") -> Column:
    """The names whose condition holds, in the order given, without repeats."""
    names = [
        F.when(condition, name if isinstance(name, Column) else F.lit(name)) for condition, name in pairs
    ]
    return F.concat_ws(separator, F.array_distinct(F.array_compact(F.array(*names))))


def truthy(value: Column) -> Column:
    return F.coalesce(F.lower(F.trim(value.cast("string"))).isin("1", "true", "yes", "y", "t"), F.lit(False))


def json_number(payload: Column, key: str) -> Column:
    return F.get_json_object(payload, f"$.{key}").try_cast("double")


def safe_identifier(value: Column) -> Column:
    """True when a text can serve as an identifier in paths."""
    text = F.trim(value.cast("string"))
    bad = text.rlike(r"[/\\*?\[\]\x00-\x1f\x7f]") | text.isin("", ".", "..")
    return F.coalesce(~bad, F.lit(False))
