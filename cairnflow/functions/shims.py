"""Column functions for spellings that Spark lacks, with defaults instead of nulls and first match instead of all."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def map_value(m: Column, key: Column, default) -> Column:
    """m[key], or the value type's default if the key is missing."""
    return F.coalesce(F.try_element_at(m, key), F.lit(default))


def map_concat_first(*maps: Column) -> Column:
    """One map; of entries with the same key the first stays."""
    entries = F.flatten(F.array(*[F.map_entries(m) for m in maps]))
    keys = F.array_distinct(F.transform(entries, lambda e: e["key"]))
    return F.map_from_entries(F.transform(keys, lambda k: F.struct(k, F.get(F.filter(entries, lambda e: e["key"] == k), F.lit(0))["value"])))


def array_value(a: Column, i: int, default) -> Column:
    """a[i] from 1, from the end if negative; the default if there is none."""
    return F.lit(default) if i == 0 else F.coalesce(F.try_element_at(a, F.lit(i)), F.lit(default))


def replace_first(s: Column, pattern: str, by: str) -> Column:
    """Only the first match replaced, without references to groups."""
    at = F.regexp_instr(s, F.lit(pattern))
    return F.when(at > 0, F.overlay(s, F.lit(by), at, F.length(F.regexp_substr(s, F.lit(pattern))))).otherwise(s)


def start_of_interval(ts: Column, seconds: int) -> Column:
    """The start of the interval of the epoch's grid that ts is in: 3600, 300 and 60 seconds are hours, five minutes and minutes."""
    return F.timestamp_seconds(F.floor(F.unix_seconds(ts.cast("timestamp")) / seconds) * seconds)


def start_of_week(ts: Column, mode: int = 0) -> Column:
    """The week's first day: Sunday for even modes, Monday for odd ones."""
    day = F.to_date(ts)
    return F.date_sub(day, (F.dayofweek(day) + 5) % 7) if mode % 2 else F.date_sub(day, F.dayofweek(day) - 1)


def split_by_char(separator: str, s: Column) -> Column:
    """The parts between separators, whatever these mean in patterns."""
    if len(separator) != 1:
        raise ValueError("one character")
    return F.split(s, rf"\Q{separator}\E", -1)


def position_ci(haystack: Column, needle: str, start: int = 1) -> Column:
    """Where needle is first found from start on, counted from 1, in any case; 0 if it isn't."""
    return F.when(F.lit(start) > F.length(haystack) + 1, F.lit(0)).otherwise(F.locate(needle.lower(), F.lower(haystack), max(1, start))).cast("long")


def in_frame(x: Column, order, first: int, last: int, offset: int, default=None) -> Column:
    """The value offset rows after the current one (before it, if negative) if that row is in the frame of rows first to last around
    the current one, else the default."""
    if not first <= offset <= last:
        return F.lit(default)
    return F.lag(x, -offset, default).over(order) if offset < 0 else F.lead(x, offset, default).over(order)


def epoch(ts: Column) -> Column:
    return F.unix_micros(ts) / F.lit(1e6)


def correlation(x: Column, y: Column) -> Column:
    """Pearson correlation, null for constant input instead of a division error.

    Extremes tell a constant: the deviation of equal numbers from several partitions may be above zero, by rounding of the merged means."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    constant = lambda c: (F.min(c) == F.max(c)) & ~F.isnan(F.max(c))
    return F.when(~(constant(a) | constant(b)), F.try_divide(F.covar_pop(a, b), F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0))))
