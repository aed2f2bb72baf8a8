"""Point-in-time aggregates: facts in a trailing window ending at each entity's own reference date.

Three shapes:

* ``window_at_date`` - one reference date for everybody (a literal).  The
  window bounds become literal filters that reach the parquet scan, facts
  are aggregated per key first (map-side partial aggregation), and only then
  joined to the entities.  Nothing but one row per key crosses the shuffle.
* ``trailing_window_agg`` - a reference date per entity.  Entities are
  left-joined to the facts with the window as a residual predicate of the
  join (not a WHERE after it, which would drop entities without activity),
  then aggregated by key.  The join output is already hash-partitioned by the
  key, so the aggregation adds no exchange.

* ``running_windows`` - any number of reference dates per entity and any number of
  windows per date.  The facts are rolled up per key and day once; running
  totals over a key's days, read at both ends of a window, give its sums as a
  difference.  One sort by key and day serves all dates, windows and measures.

Empty windows give count 0 (``count(fact column)``) and NULL averages, as in
SQL.  Several windows over the same facts can share one pass with
conditional aggregates.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FACT_KEY = "_fact_key"


def windowed_join(
    entities: DataFrame,
    facts: DataFrame,
    key: str,
    ref_col: str,
    ts_col: str,
    lookback_days: int | None,
) -> DataFrame:
    """Left join of entities with their facts dated ``<= ref`` (and ``> ref - lookback_days`` when given)."""
    f = facts.withColumnRenamed(key, FACT_KEY)
    cond = (F.col(key) == F.col(FACT_KEY)) & (F.col(ts_col) <= F.col(ref_col))
    if lookback_days is not None:
        cond = cond & (F.col(ts_col) > F.date_sub(F.col(ref_col), lookback_days))
    return entities.join(f, cond, "left")


def trailing_window_agg(
    entities: DataFrame,
    facts: DataFrame,
    key: str,
    ref_col: str,
    ts_col: str,
    days: int | None,
    aggs: Sequence[Column],
    keep: Sequence[str] = (),
) -> DataFrame:
    """Aggregate the facts in (ref - days, ref] per entity; every entity is kept.

    ``days=None`` means everything up to and including the reference date.
    ``keep`` are entity columns carried to the output (functionally dependent on ``key``).
    """
    joined = windowed_join(entities.select(key, ref_col, *[k for k in keep if k != ref_col]),
                           facts, key, ref_col, ts_col, days)
    group = [key, *[k for k in keep]]
    return joined.groupBy(*group).agg(*aggs)


def facts_within(facts: DataFrame, ts_col: str, after: dt.date | None, until: dt.date | None) -> DataFrame:
    """Facts with ``after`` < ts <= ``until`` (None: unbounded), as literal bounds that reach the scan."""
    # A date literal compared with a timestamp column means midnight, as in SQL.
    for bound, inside, month in ((after, F.col(ts_col) > F.lit(after), F.col("month") >= (after or dt.date.min).strftime("%Y-%m")),
                                 (until, F.col(ts_col) <= F.lit(until), F.col("month") <= (until or dt.date.max).strftime("%Y-%m"))):
        if bound is not None:
            facts = facts.where(inside)
            if "month" in facts.columns:
                # Facts written month-partitioned (sources.io.write_roles): prune partitions too.
                facts = facts.where(month)
    return facts


def window_at_date(
    entities: DataFrame,
    facts: DataFrame,
    key: str,
    ts_col: str,
    ref_date: dt.date,
    days: int,
    aggs: Sequence[Column],
) -> DataFrame:
    """Trailing window ending at one literal date for all entities.

    Facts are filtered with literal bounds (pushed down), pre-aggregated per
    key, and left-joined to the entities; entities without facts get NULLs
    from the join (callers coalesce counts to 0).
    """
    window = facts_within(facts, ts_col, ref_date - dt.timedelta(days=days), ref_date)
    per_key = window.groupBy(F.col(key)).agg(*aggs)
    return entities.select(key).join(per_key, key, "left")


def daily_rollup(facts: DataFrame, key: str, ts_col: str, sums: Sequence[str], counts: Sequence[str] = ()) -> DataFrame:
    """Roll facts up to one row per (key, day): row count, sums, non-null counts.

    Averages over a window are then ``sum(sum_x) / sum(n)``, exactly the same
    value as the average over the raw rows, while far fewer rows reach the
    per-entity join when accounts produce many events per day.
    """
    return facts.groupBy(key, ts_col).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(c).alias(f"sum_{c}") for c in sums],
        *[F.count(c).alias(f"n_{c}") for c in counts],
    )


def running_windows(
    points: DataFrame,
    daily: Sequence[DataFrame],
    key: str,
    ref_col: str,
    day_col: str,
    measures: Sequence[str],
    windows: dict[str, tuple[int, int]],
    last_days: dict[str, str] | None = None,
) -> DataFrame:
    """Sums of ``measures`` over several day windows at several reference dates per key.

    ``points``: distinct (key, ref).  ``daily``: frames of at most one row per (key, day), each with
    some of the measures (integers or decimals, so that differences are exact; a missing measure adds
    nothing).  ``windows``: name -> (far, near) for the days in (ref - far, ref - near].  ``last_days``:
    name -> measure, the latest day up to the reference date on which that measure is there.

    The points' window ends are merged with the days by one sort per key; the sums up to and including
    each end are running totals.  A key brings its active days and its window ends to that sort, never
    its raw facts.  Days without a key belong to no point and stay out.  Columns:
    key, ref, ``{window}_{measure}`` (0 for an empty window), the ``last_days`` names.
    """
    last_days = last_days or {}
    ends = sorted({end for pair in windows.values() for end in pair} | ({0} if last_days else set()))
    facts = None
    for d in daily:
        part = d.where(F.col(key).isNotNull()).select(key, day_col, *[m for m in measures if m in d.columns])
        facts = part if facts is None else facts.unionByName(part, allowMissingColumns=True)
    lookups = points.select(key, ref_col, F.explode(F.array(*[F.lit(e) for e in ends])).alias("_end"))
    lookups = lookups.withColumn(day_col, F.date_sub(F.col(ref_col), F.col("_end")))
    merged = facts.unionByName(lookups, allowMissingColumns=True)
    upto = Window.partitionBy(key).orderBy(F.col(day_col), F.col("_end").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = [F.coalesce(F.sum(m).over(upto), F.lit(0)).alias(m) for m in measures]
    latest = [F.max(F.when(F.col(m).isNotNull(), F.col(day_col))).over(upto).alias(name) for name, m in last_days.items()]
    at_ends = merged.select(key, ref_col, "_end", *totals, *latest).where(F.col("_end").isNotNull())

    def at(end: int, c: str) -> Column:
        return F.max(F.when(F.col("_end") == end, F.col(c)))

    sums = [(at(near, m) - at(far, m)).alias(f"{name}_{m}") for name, (far, near) in windows.items() for m in measures]
    return at_ends.groupBy(key, ref_col).agg(*sums, *[at(0, name).alias(name) for name in last_days])
