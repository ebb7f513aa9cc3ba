"""Substitution that decides on every match, without a user function."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value worked out once, however often body names it."""
    return F.transform(F.array(value), body)[0]


def sub_each(text: Column, pattern: str, decide: Callable[..., Column], groups: int = 0) -> Column:
    """Every match of ``pattern`` replaced by ``decide(match, group 1, ...)``; what lies between stays.

    A match that decide gives back unchanged is passed over whole, as a callback replacement would.
    The pattern must not match nothing. Groups that took no part in a match are empty strings.
    """

    def replace(t: Column) -> Column:
        found = [F.regexp_extract_all(t, F.lit(pattern), F.lit(k)) for k in range(groups + 1)]
        matches = F.arrays_zip(*[f.alias(f"g{k}") for k, f in enumerate(found)]) if groups else F.transform(found[0], lambda m: F.struct(m.alias("g0")))
        done = F.transform(matches, lambda m: decide(*[m[f"g{k}"] for k in range(groups + 1)]))
        joined = F.array_join(F.zip_with(F.split(t, pattern, -1), done, lambda gap, new: F.concat(gap, F.coalesce(new, F.lit("")))), "")
        return F.when(t.rlike(pattern), joined).otherwise(t)

    return let(text, replace)
