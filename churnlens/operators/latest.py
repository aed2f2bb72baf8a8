"""Event log -> one authoritative row per key.

``ROW_NUMBER() OVER (PARTITION BY k ORDER BY ...) = 1`` sorts every key's
whole history.  Here the winner is picked with ``max_by`` over an ordering
struct instead: an aggregate that Spark splits into a map-side partial and a
final step, so each key ships one candidate row per map task, and a hot key
with a third of all events is folded on the map side before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def desc(c: str) -> Column:
    """Ordering term for ``c DESC`` (larger wins)."""
    return F.col(c)


def asc(c: str, boolean: bool = False) -> Column:
    """Ordering term for ``c ASC``: booleans by NOT, numbers by negation."""
    x = F.col(c)
    return ~x if boolean else -x


def latest_per_key(
    df: DataFrame,
    key: str | Sequence[str],
    rank_by: Sequence[Column],
    carry: Sequence[str],
    extra_aggs: Sequence[Column] = (),
) -> DataFrame:
    """One row per ``key``: the ``carry`` columns of the row with the largest ``rank_by`` tuple, plus ``extra_aggs``.

    Equivalent to ``ROW_NUMBER() OVER (PARTITION BY key ORDER BY ...) = 1``
    next to whole-partition aggregates (``COUNT(*) OVER``, ``SUM() OVER``)
    when the order is total (ties broken by a unique column).
    """
    keys = [key] if isinstance(key, str) else list(key)
    order = F.struct(*[t.alias(f"k{i}") for i, t in enumerate(rank_by)])
    winner = F.max_by(F.struct(*[F.col(c) for c in carry]), order).alias("_last")
    out = df.groupBy(*keys).agg(winner, *extra_aggs)
    rest = [c for c in out.columns if c not in keys and c != "_last"]
    return out.select(*keys, *[F.col(f"_last.{c}").alias(c) for c in carry], *rest)


def state_intervals(
    events: DataFrame,
    key: str,
    day_col: str,
    rank_by: Sequence[Column],
    carry: Sequence[str],
    counts: Sequence[Column] = (),
) -> DataFrame:
    """The event log as validity intervals: one row per (key, day with events).

    ``carry`` are the columns of the day's deciding event (the largest ``rank_by``); ``counts``, aliased
    aggregates, are summed up over the days so far.  The row holds after its day up to and including the
    key's next day with events: the state "before day D" is the row with from_day < D <= to_day (to_day
    NULL: still).  Before its first event a key has no row.

    A day's events are folded before the sort (map side first), so a key brings its days, not its events.
    """
    per_day = latest_per_key(events, [key, day_col], rank_by, [c for c in carry if c != day_col], counts)
    names = [c for c in per_day.columns if c not in (key, day_col, *carry)]
    order = Window.partitionBy(key).orderBy(day_col)
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return per_day.select(
        key,
        F.col(day_col).alias("from_day"),
        F.lead(day_col).over(order).alias("to_day"),
        *[F.col(c) for c in carry if c != day_col],
        *([F.col(day_col)] if day_col in carry else []),
        *[F.sum(c).over(so_far).alias(c) for c in names],
    )


def state_before(points: DataFrame, intervals: DataFrame, key: str, at_col: str) -> DataFrame:
    """Each point (key, at, ...) with the columns of the interval that holds before ``at``; NULL if none does.

    An equi join on the key whose residual lets at most one interval of the key through.
    """
    held = intervals.withColumnRenamed(key, "_key")
    hit = (F.col(key) == F.col("_key")) & (F.col("from_day") < F.col(at_col)) & (F.col("to_day").isNull() | (F.col("to_day") >= F.col(at_col)))
    return points.join(held, hit, "left").drop("_key", "from_day", "to_day")
