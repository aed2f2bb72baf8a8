"""Scalar building blocks: bucketing, custom order, flags, ratios, date labels.

All helpers return JVM-side ``Column`` expressions (no UDFs), so they stay
inside whole-stage code generation.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def first_match(cases: Sequence[tuple[Column, object]], default=None) -> Column:
    """Searched CASE: the first true predicate wins; ``default=None`` leaves NULL (CASE without ELSE)."""
    expr = None
    for pred, value in cases:
        v = value if isinstance(value, Column) else F.lit(value)
        expr = F.when(pred, v) if expr is None else expr.when(pred, v)
    if default is not None:
        expr = expr.otherwise(default if isinstance(default, Column) else F.lit(default))
    return expr


def field_order(c, *values) -> Column:
    """1-based position of ``c`` in ``values``, 0 when absent (custom sort order)."""
    return F.array_position(F.array(*[F.lit(v) for v in values]), col(c)).cast("int")


def flag(c) -> Column:
    """Boolean as 0/1 integer (NULL stays NULL) so it can be summed or averaged."""
    return col(c).cast("int")


def ratio(num, den) -> Column:
    """num / den as double; NULL when the divisor is 0 or NULL."""
    return F.try_divide(col(num).cast("double"), col(den).cast("double"))


def pct(num, den) -> Column:
    return ratio(num, den) * 100


def share_of_groups(c, *within) -> Column:
    """``c`` as % of its total over the grouped rows (optionally within ``within`` groups).

    Applied after a ``groupBy``: the window runs over the handful of group
    rows, so the base is read once (a scalar subquery would re-run the whole
    upstream plan for the total).  Decimal sums stay exact until the division.
    """
    from pyspark.sql import Window

    x = col(c)
    return pct(x, F.sum(x).over(Window.partitionBy(*within)))


def month_label(c, first_day: bool = False) -> Column:
    """'yyyy-MM' (or 'yyyy-MM-01') text label of a date."""
    return F.date_format(col(c), "yyyy-MM-01" if first_day else "yyyy-MM")


def lit_date(d: dt.date) -> Column:
    return F.lit(d).cast("date")


def valid_at(start, end, at) -> Column:
    """Interval [start, end] contains ``at``; an open end (NULL) is still valid."""
    return (col(start) <= col(at)) & (col(end).isNull() | (col(end) >= col(at)))


def in_trailing_window(ts, ref, days: int) -> Column:
    """``ts`` falls in the half-open window (ref - days, ref].

    When ``ts`` is a timestamp and ``ref`` a date, the date means midnight,
    so events later on the reference day fall out.
    """
    return (col(ts) > F.date_sub(col(ref), days)) & (col(ts) <= col(ref))


STABLE_DIGITS = 9


def stable(c, digits: int = STABLE_DIGITS) -> Column:
    """A mean/variance over doubles, reported to ``digits`` decimals.

    Summing doubles depends on the order rows meet, i.e. on partitioning, so
    the last bits of such statistics change from run to run and cluster to
    cluster.  Nine decimals keep every meaningful digit and make the output
    reproducible.
    """
    return F.round(col(c), digits)


SIGNIFICANT = 11


def significant(c) -> Column:
    """A double to :data:`SIGNIFICANT` significant digits, whatever its size; NaN and infinities stay."""
    x = col(c).cast("double")
    finite = F.abs(x) < float("inf")
    return F.when(x.isNull() | F.isnan(x) | ~finite, x).otherwise(F.format_string(f"%.{SIGNIFICANT - 1}e", x).cast("double"))


#: Values that are summed in 64 bits are split at so many bits, so that 2**32 of them fit.
HALF = 31


def exact_sum(df: DataFrame, name: str) -> Column:
    """``F.sum`` of a column, with the same result and type.

    Spark adds decimals whose sum may pass 18 digits as big numbers, a new one for each row.  Here the upper and
    the lower bits of the unscaled value are summed as 64-bit integers and put together once a group.
    """
    kind = df.schema[name].dataType
    if not isinstance(kind, DecimalType) or not 8 < kind.precision <= 18 - kind.scale:
        return F.sum(name)
    unscaled = (F.col(name) * 10**kind.scale).cast("long")
    upper, lower = F.sum(F.shiftright(unscaled, HALF)), F.sum(unscaled.bitwiseAND(F.lit((1 << HALF) - 1)))
    wide = upper.cast("decimal(20,0)") * F.lit(1 << HALF).cast("decimal(10,0)") + lower.cast("decimal(20,0)")
    return (wide * F.lit(Decimal(1).scaleb(-kind.scale))).cast(DecimalType(kind.precision + 10, kind.scale))
