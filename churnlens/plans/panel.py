"""Many reference dates in one plan: the accounts' risk signals and the back-test over a table of cut dates.

A row is an (account, cut date).  The facts are read once for all cuts, between the earliest window's start
and the latest cut, and rolled up per account and day; ``running_windows`` then reads every window off the
same sort.  Terciles are taken within each cut by the same range buckets.  A further cut adds its rows, not a scan.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import flag, lit_date, ratio
from ..operators.latest import asc, desc, state_before, state_intervals
from ..operators.windows import facts_within, running_windows
from .context import Context

#: Measures that are doubles are summed as decimals of so many places, which subtract exactly.
PLACES = "decimal(18,6)"


def usage_days(usage: DataFrame, after: dt.date | None = None, until: dt.date | None = None) -> DataFrame:
    """Usage per (account, day): sessions, and sums and counts of use and errors."""
    return facts_within(usage, "usage_date", after, until).groupBy("account_id", F.col("usage_date").alias("day")).agg(
        F.count(F.lit(1)).alias("sessions"),
        F.sum("usage_count").alias("use_sum"), F.count("usage_count").alias("use_n"),
        F.sum("error_count").alias("error_sum"), F.count("error_count").alias("error_n"),
    )


def ticket_days(tickets: DataFrame, after: dt.date | None = None, until: dt.date | None = None) -> DataFrame:
    """Tickets per (account, day).  Windows are bounded by midnights, the later one included: a ticket at
    midnight is of its day, any other of the next."""
    date = F.to_date("submitted_at")
    day = F.when(F.col("submitted_at") == date.cast("timestamp_ntz"), date).otherwise(F.date_add(date, 1))
    return facts_within(tickets, "submitted_at", after, until).groupBy("account_id", day.alias("day")).agg(
        F.count("ticket_id").alias("tickets"),
        F.sum(F.col("resolution_time_hours").cast(PLACES)).alias("hours_sum"), F.count("resolution_time_hours").alias("hours_n"),
        F.sum(flag("escalation_flag")).alias("escalated_sum"), F.count("escalation_flag").alias("escalated_n"),
        F.sum("satisfaction_score").alias("satisfaction_sum"), F.count("satisfaction_score").alias("satisfaction_n"),
    )


MEASURES = (
    "sessions", "use_sum", "use_n", "error_sum", "error_n",
    "tickets", "hours_sum", "hours_n", "escalated_sum", "escalated_n", "satisfaction_sum", "satisfaction_n",
)


def signals_at(ctx: Context, points: DataFrame, cuts: Sequence[dt.date], days: int | None = None) -> DataFrame:
    """E1 for every point (account_id, cut_date), the cut dates being among ``cuts``; columns as
    ``risk.risk_signals`` gives them, and cut_date."""
    days = days or ctx.cfg.window_days
    bounds = (min(cuts) - dt.timedelta(days=days), max(cuts))
    daily = [usage_days(ctx.roles.usage, *bounds), ticket_days(ctx.roles.tickets, *bounds)]
    w = running_windows(points, daily, "account_id", "cut_date", "day", MEASURES, {"w": (days, 0)})
    mean = lambda m: ratio(f"w_{m}_sum", f"w_{m}_n")
    return w.select(
        "account_id", "cut_date",
        F.coalesce(mean("use"), F.lit(0.0)).alias("intensity"),
        F.col("w_sessions").cast("long").alias("sessions"),
        F.coalesce(mean("error"), F.lit(0.0)).alias("errors"),
        F.col("w_tickets").cast("long").alias("tickets"),
        mean("hours").alias("resolution_hours"),
        (mean("escalated") * 100).alias("escalated_pct"),
        mean("satisfaction").alias("satisfaction"),
    )


def at_dates(df: DataFrame, dates: Sequence[dt.date], name: str) -> DataFrame:
    """Every row at every date (the rows of the panel)."""
    return df.withColumn(name, F.explode(F.array(*[lit_date(d) for d in dates])))


def churn_intervals(ctx: Context) -> DataFrame:
    """V1 as intervals: each account's state after each of its event days, events and reactivations so far."""
    return state_intervals(
        ctx.roles.churn_events, "account_id", "churn_date",
        rank_by=[asc("is_reactivation", boolean=True), desc("churn_event_id")],
        carry=["churn_date", "is_reactivation", "reason_code", "refund_amount_usd"],
        counts=[F.count(F.lit(1)).alias("n_events"), F.sum(flag("is_reactivation")).alias("n_reactivations")],
    )


def states_before(ctx: Context, points: DataFrame, at_col: str, intervals: DataFrame | None = None) -> DataFrame:
    """V1 as of any date: each point (account_id, ``at_col``, ...) with the state that the events before that date make."""
    held = state_before(points, churn_intervals(ctx) if intervals is None else intervals, "account_id", at_col)
    churned = F.col("is_reactivation") == F.lit(False)
    return held.select(
        *points.columns,
        F.coalesce("n_events", F.lit(0)).cast("long").alias("n_events"),
        F.coalesce("n_reactivations", F.lit(0)).cast("long").alias("n_reactivations"),
        F.when(churned, 1).otherwise(0).cast("int").alias("is_churned"),
        F.when(churned, F.col("churn_date")).alias("churn_date"),
        F.when(churned, F.col("reason_code")).alias("churn_reason"),
        F.when(churned, F.col("refund_amount_usd")).alias("refund_amount"),
    )


def cohorts(ctx: Context, cuts: Sequence[dt.date], state_mode: str = "final") -> DataFrame:
    """Accounts live at each cut with at least ``min_history_days`` of history, and ``outcome``:
    (account_id, cut_date, outcome).  State modes as in ``risk.backtest_cohort``."""
    cfg = ctx.cfg
    cut, churn = F.col("cut_date"), F.col("churn_date")
    known = at_dates(ctx.roles.accounts.select("account_id", "signup_date"), cuts, "cut_date")
    known = known.where(F.col("signup_date") <= F.date_sub(cut, cfg.min_history_days)).select("account_id", "cut_date")
    end = F.date_add(cut, cfg.horizon_days)
    if state_mode == "final":
        outcome = (F.col("is_churned") == 1) & (churn >= cut) & (churn < end)
        return (
            known.join(ctx.state.select("account_id", "is_churned", "churn_date"), "account_id")
            .where((F.col("is_churned") == 0) | (churn >= cut))
            .select("account_id", "cut_date", F.when(outcome, 1).otherwise(0).alias("outcome"))
        )
    if state_mode != "as_of":
        raise ValueError(f"state_mode must be 'final' or 'as_of', not {state_mode!r}")
    # both dates of a point are looked up in one join, so the events are read once
    both = known.select("account_id", "cut_date", F.explode(F.array(cut, end)).alias("_at"))
    state = states_before(ctx, both, "_at")
    gone = F.col("is_churned") == 1
    per = state.groupBy("account_id", "cut_date").agg(
        F.max(F.when((F.col("_at") == cut) & gone, 1).otherwise(0)).alias("_gone"),
        F.max(F.when((F.col("_at") == end) & gone & (churn >= cut), 1).otherwise(0)).alias("outcome"),
    )
    return per.where(F.col("_gone") == 0).select("account_id", "cut_date", "outcome")


def backtest_panel(ctx: Context, cuts: Sequence[dt.date], state_mode: str = "final") -> DataFrame:
    """Scores of every cohort member at every cut: points, cut_date, outcome.  Two writes, however many cuts."""
    from .risk import risk_scores

    members = ctx.materialize(cohorts(ctx, cuts, state_mode))
    signals = signals_at(ctx, members.select("account_id", "cut_date"), cuts).join(members, ["account_id", "cut_date"])
    return risk_scores(signals, ctx.cfg, keep=["cut_date", "outcome"], group_col="cut_date")
