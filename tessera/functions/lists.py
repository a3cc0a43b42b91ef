"""Lists, ranges and maps as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import text


def item(l: Column, i: int) -> Column:
    """Element ``i`` from 0, or from the end if negative; raises outside the list."""
    return F.element_at(l, i + 1 if i >= 0 else i)


def cut(l: Column, low: int | None = None, high: int | None = None) -> Column:
    """``l[low:high]`` with negative and open ends, clamped."""
    n = F.size(l)

    def bound(i: int | None, open_: Column) -> Column:
        return open_ if i is None else F.greatest(F.lit(0), n + i) if i < 0 else F.least(F.lit(i), n)

    a, b = bound(low, F.lit(0)), bound(high, n)
    return F.slice(l, a + 1, F.greatest(b - a, F.lit(0)))


def has(l: Column, value: Column, inner: str = "string", value_type: str = "string") -> Column:
    """Membership by text."""
    return F.array_contains(F.transform(l, lambda x: text(x, inner)), text(value, value_type))


def join(l: Column, separator: str, inner: str = "string") -> Column:
    return F.array_join(F.transform(l, lambda x: text(x, inner)), separator)


def repeat(l: Column, n: Column) -> Column:
    return F.flatten(F.array_repeat(l, F.greatest(n, F.lit(0)).cast("int")))


def append(l: Column, value: Column) -> Column:
    return F.array_append(F.coalesce(l, F.array()), value)


def unique(l: Column, drop_empty: bool = False) -> Column:
    """Distinct elements, the first of each in place."""
    out = F.array_distinct(l)
    return F.array_remove(out, "") if drop_empty else out


def same_set(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_distinct(a)) == F.array_sort(F.array_distinct(b))


def any_contains(l: Column, part: str) -> Column:
    return F.exists(l, lambda x: F.contains(x, F.lit(part)))


def listed(c: Column) -> Column:
    """A value as a list of one; null as the empty list."""
    return F.when(c.isNull(), F.array().cast("array<string>")).otherwise(F.array(c.cast("string")))


def range_length(low: Column, high: Column) -> Column:
    return F.abs(high - low) + 1


def range_has(low: Column, high: Column, value: Column) -> Column:
    return value.between(F.least(low, high), F.greatest(low, high))


def range_item(low: Column, high: Column, i: int) -> Column:
    """Element ``i`` of an inclusive range that may descend; null outside."""
    n, step = range_length(low, high), F.when(high >= low, 1).otherwise(-1)
    at = F.lit(i) if i >= 0 else n + i
    return F.when((at >= 0) & (at < n), low + step * at)


def range_list(low: Column, high: Column) -> Column:
    return F.sequence(low, high)


def map_get(m: Column, key: str, otherwise: Column | None = None) -> Column:
    """The value of a key that is there, be it null, else the default."""
    return F.when(F.map_contains_key(m, key), m[key]).otherwise(F.lit(None) if otherwise is None else otherwise)


def map_item(m: Column, i: int) -> Column:
    return F.element_at(F.map_values(m), i + 1 if i >= 0 else i)


def map_put(m: Column, key: Column, value: Column) -> Column:
    return F.map_concat(F.map_filter(m, lambda k, _: k != key), F.create_map(key, value))


def map_put_missing(m: Column, key: Column, value: Column) -> Column:
    return F.when(F.map_contains_key(m, key), m).otherwise(F.map_concat(m, F.create_map(key, value)))


#: Settings that only steer a run.
STEERING = ("name", "depids", "custom", "setup", "shell", "run_id", "parallelenv", "mailtype", "array")


def settings(m: Column, prefix: str = "job.") -> Column:
    """A job's settings worth keeping: those with the prefix, without it, but the steering ones."""
    bare = F.transform_keys(F.map_filter(m, lambda k, _: k.startswith(prefix)), lambda k, _: k.substr(F.lit(len(prefix) + 1), F.length(k)))
    return F.map_filter(bare, lambda k, _: ~k.isin(*STEERING))


def signature(m: Column, prefix: str = "job.", skip: tuple[str, ...] = ("job.array",)) -> Column:
    """``k=v;`` text of the settings in key order: equal for equal settings."""
    entries = F.array_sort(F.filter(F.map_entries(m), lambda e: e["key"].startswith(prefix) & ~e["key"].isin(*skip)))
    return F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("")), F.lit(";"))), "")
