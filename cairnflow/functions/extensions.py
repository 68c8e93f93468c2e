"""Aggregates that users add by name: a name stands for a function from column expressions to an aggregate column."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_AGGREGATES: dict[str, Callable[..., Column]] = {}


def register(name: str, build: Callable[..., Column]) -> None:
    """Makes an aggregate known. `build` takes its arguments as columns and returns an expression that aggregates them:
    built-in functions keep it in the JVM with partial sums; a grouped-aggregate pandas_udf is taken as well."""
    if not name.isidentifier():
        raise ValueError(f"{name!r} is no name")
    if _AGGREGATES.setdefault(name, build) is not build:
        raise ValueError(f"{name} is registered already")


def names() -> list[str]:
    return sorted(_AGGREGATES)


def call(name: str, *arguments: Column | str) -> Column:
    """The aggregate as a column, for groupBy().agg() and for windows."""
    if name not in _AGGREGATES:
        raise ValueError(f"no aggregate is called {name}; there are {names()}")
    return _AGGREGATES[name](*[F.col(a) if isinstance(a, str) else a for a in arguments])


def aggregate(df: DataFrame, keys: Sequence[str], **wanted: tuple) -> DataFrame:
    """One row per key with columns named as given: aggregate(df, ["k"], m=("geometric_mean", "v"))."""
    return df.groupBy(*keys).agg(*[call(name, *arguments).alias(out) for out, (name, *arguments) in wanted.items()])


# registered by the library itself
register("geometric_mean", lambda x: F.exp(F.avg(F.ln(F.when(x > 0, x)))))
register("harmonic_mean", lambda x: F.try_divide(F.count(F.when(x != 0, x)), F.sum(F.when(x != 0, 1 / x))))
register("weighted_mean", lambda x, w: F.try_divide(F.sum(x * w), F.sum(F.when(x.isNotNull(), w))))
