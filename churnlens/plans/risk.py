"""Early-warning system: risk signals, points card, headcount, priority matrix, back-test (E1-E5, M5).

Everything is parameterised by the reference date, so the same code scores
the live portfolio at the period close and a back-dated portfolio at a cut.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import ACTIONS, RISK_LABELS, VALUE_LABELS, ChurnConfig
from ..functions.expr import first_match, flag, ratio, stable
from ..operators.bootstrap import replicates
from ..operators.ranking import OrderSpec, distributed_ntile
from ..operators.windows import window_at_date
from . import panel
from .context import Context


# ---------------------------------------------------------------- E1 signals
def live_at_close(ctx: Context) -> DataFrame:
    return ctx.state.where(F.col("is_churned") == 0).select("account_id")


def risk_signals(ctx: Context, entities: DataFrame, ref_date: dt.date, days: int | None = None) -> DataFrame:
    """E1 - per entity, in the window (ref - days, ref]:

    product: sessions, intensity (mean usage count), errors (mean error
    count) - missing -> 0; support: tickets, mean resolution hours, escalated
    %, mean satisfaction - missing stays NULL (tickets 0).

    The reference date is one literal for all entities, so both fact tables
    are filtered with literal bounds and aggregated per account before the
    join to the entities.
    """
    days = days or ctx.cfg.window_days
    usage = window_at_date(
        entities, ctx.roles.usage, "account_id", "usage_date", ref_date, days,
        [
            F.count(F.lit(1)).alias("_sessions"),
            F.avg("usage_count").alias("_intensity"),
            F.avg("error_count").alias("_errors"),
        ],
    )
    support = window_at_date(
        entities, ctx.roles.tickets, "account_id", "submitted_at", ref_date, days,
        [
            F.count("ticket_id").alias("_tickets"),
            F.avg("resolution_time_hours").alias("resolution_hours"),
            (F.avg(flag("escalation_flag")) * 100).alias("escalated_pct"),
            F.avg("satisfaction_score").alias("satisfaction"),
        ],
    )
    return usage.join(support, "account_id").select(
        "account_id",
        F.coalesce("_intensity", F.lit(0.0)).alias("intensity"),
        F.coalesce("_sessions", F.lit(0)).cast("long").alias("sessions"),
        F.coalesce("_errors", F.lit(0.0)).alias("errors"),
        F.coalesce("_tickets", F.lit(0)).cast("long").alias("tickets"),
        "resolution_hours",
        "escalated_pct",
        "satisfaction",
    )


# ---------------------------------------------------------------- E2 points card
def support_points(cfg: ChurnConfig) -> list[Column]:
    t_hi, t_lo = cfg.ticket_cuts
    e_hi, e_lo = cfg.escalation_cuts
    s_hi, s_lo = cfg.satisfaction_cuts
    tickets, esc, sat = F.col("tickets"), F.col("escalated_pct"), F.col("satisfaction")
    return [
        first_match([(tickets >= t_hi, 2), (tickets >= t_lo, 1)], 0).alias("p_tickets"),
        first_match([(esc.isNull(), 0), (esc > e_hi, 2), (esc > e_lo, 1)], 0).alias("p_escalation"),
        first_match([(sat.isNull(), 0), (sat < s_hi, 2), (sat < s_lo, 1)], 0).alias("p_satisfaction"),
    ]


def risk_scores(signals: DataFrame, cfg: ChurnConfig, keep: Sequence[str] = (), group_col: str | None = None, stored: bool = False) -> DataFrame:
    """E2 - points card: product signals by tercile (3 - tercile: low intensity, few sessions, many errors
    score 2), support signals by fixed cuts; subtotals and total (0-12).

    The three terciles are global orderings (within ``group_col``, if given), computed with
    ``distributed_ntile`` (ties broken by account id) from one written table: ``signals``
    itself if it is ``stored``.
    """
    k = cfg.n_terciles
    tiles = distributed_ntile(
        signals,
        k,
        {
            "t_intensity": OrderSpec("intensity"),
            "t_sessions": OrderSpec("sessions"),
            "t_errors": OrderSpec("errors", descending=True),
        },
        "account_id",
        cfg.ntile_buckets,
        group_col,
        stored,
    )
    scored = tiles.select(
        "account_id",
        *keep,
        (F.lit(k) - F.col("t_intensity")).alias("p_intensity"),
        (F.lit(k) - F.col("t_sessions")).alias("p_sessions"),
        (F.lit(k) - F.col("t_errors")).alias("p_errors"),
        *support_points(cfg),
    )
    product = F.col("p_intensity") + F.col("p_sessions") + F.col("p_errors")
    support = F.col("p_tickets") + F.col("p_escalation") + F.col("p_satisfaction")
    return scored.select(
        "*",
        product.cast("long").alias("product_points"),
        support.cast("long").alias("support_points"),
        (product + support).cast("long").alias("total_points"),
    )


def risk_level(points: Column, cfg: ChurnConfig) -> Column:
    hi, med, low = RISK_LABELS
    return first_match([(points >= cfg.risk_high, hi), (points >= cfg.risk_medium, med)], low)


def risk_headcount(scores: DataFrame, cfg: ChurnConfig) -> DataFrame:
    """E3 - high (>= 8), medium-or-high (>= 5, includes high), stable (< 5)."""
    p = F.col("total_points")
    return scores.agg(
        F.count(F.when(p >= cfg.risk_high, 1)).alias("high"),
        F.count(F.when(p >= cfg.risk_medium, 1)).alias("medium_or_high"),
        F.count(F.when(p < cfg.risk_medium, 1)).alias("stable"),
    )


# ---------------------------------------------------------------- E4 priority matrix
def priority_portfolio(scores: DataFrame, metrics: DataFrame, cfg: ChurnConfig) -> DataFrame:
    """E4 - risk level (points 8 / 5) x value level (ARR decile <= 3 / <= 7, decile 1 = highest) -> action.

    Accounts without a value (NULL ARR) drop out, as in the source.
    """
    valued = scores.join(metrics.where(F.col("arr").isNotNull()).select("account_id", "arr"), "account_id")
    tiles = distributed_ntile(valued, 10, {"value_decile": OrderSpec("arr", descending=True)}, "account_id",
                              cfg.ntile_buckets)
    p, d = F.col("total_points"), F.col("value_decile")
    r_hi, r_med, r_low = RISK_LABELS
    v_hi, v_med, v_low = VALUE_LABELS
    risk = first_match([(p >= cfg.risk_high, r_hi), (p >= cfg.risk_medium, r_med)], r_low)
    value = first_match([(d <= cfg.value_high_decile, v_hi), (d <= cfg.value_medium_decile, v_med)], v_low)
    out = tiles.select(
        "account_id",
        risk.alias("risk_level"),
        first_match([(p >= cfg.risk_high, 1), (p >= cfg.risk_medium, 2)], 3).cast("long").alias("risk_order"),
        value.alias("value_level"),
        first_match([(d <= cfg.value_high_decile, 1), (d <= cfg.value_medium_decile, 2)], 3).cast("long").alias("value_order"),
        "total_points",
        "product_points",
        "support_points",
        "arr",
    )
    rl, vl = F.col("risk_level"), F.col("value_level")
    action = first_match([((rl == risk) & (vl == value), label) for (risk, value), label in ACTIONS.items()])
    return out.withColumn("action", action)


def action_summary(priority: DataFrame) -> DataFrame:
    """E4s - accounts and ARR exposed per action."""
    return priority.groupBy("action").agg(
        F.count(F.lit(1)).alias("accounts"), F.sum("arr").cast("double").alias("arr")
    )


# ---------------------------------------------------------------- E5 back-test
def backtest_cohort(ctx: Context, cut: dt.date, state_mode: str = "final") -> DataFrame:
    """Accounts live at ``cut`` with at least ``min_history_days`` of history, and ``outcome``.

    ``state_mode="final"`` (the source's definition, kept as is): live = final
    state not churned, or churned on/after the cut; outcome = final churn date
    in [cut, cut + horizon).  An account that left before the cut and came back
    later counts as live - the final state looks ahead.

    ``state_mode="as_of"``: no look-ahead.  Live = the state built from the
    events dated before the cut is not churned; outcome = the state built from
    the events dated before cut + horizon is churned, on or after the cut.
    """
    return panel.cohorts(ctx, [cut], state_mode).select("account_id", "outcome")


def backtest_scores(ctx: Context, cut: dt.date, state_mode: str = "final") -> DataFrame:
    return panel.backtest_panel(ctx, [cut], state_mode).drop("cut_date")


def lift_per_level(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    """Churn % and lift over the cohort's rate from (by..., risk_level, accounts, churned): the cohort's
    totals are sums over its few level rows."""
    cohort = Window.partitionBy(*by)
    rate = ratio("churned", "accounts")
    base = ratio(F.sum("churned").over(cohort), F.sum("accounts").over(cohort))
    return counts.select(*by, "risk_level", "accounts", "churned", (rate * 100).alias("churn_pct"), ratio(rate, base).alias("lift"))


def backtest_lift(ctx: Context, cut: dt.date | None = None, state_mode: str = "final") -> DataFrame:
    """E5 - per risk level at the cut: accounts, churned within the horizon, churn %, lift over the cohort rate."""
    return backtest_sweep(ctx, [cut or ctx.cfg.cut_date], state_mode).drop("cut_date")


def backtest_sweep(ctx: Context, cuts: Sequence[dt.date], state_mode: str = "final") -> DataFrame:
    """M5 - the back-test at several cut dates in one plan, one row per (cut, level); mean and deviation via :func:`lift_stability`."""
    scores = ctx.backtest_panel(cuts, state_mode)
    counts = scores.groupBy("cut_date", risk_level(F.col("total_points"), ctx.cfg).alias("risk_level")).agg(
        F.count(F.lit(1)).alias("accounts"), F.sum("outcome").cast("long").alias("churned")
    )
    return lift_per_level(counts, ["cut_date"])


def lift_over_seeds(ctx: Context, cuts: Sequence[dt.date], seeds: Sequence[int], state_mode: str = "final") -> DataFrame:
    """M5 - mean and sample deviation of the lift per risk level over seeds x cuts.

    The source generates its data anew per seed; on given data a seed stands for a bootstrap replicate of the
    accounts (:mod:`churnlens.operators.bootstrap`).  One grouped sum holds all replicates of all cuts.  A
    replicate without accounts in a level, or without any churn, has no lift there and does not count.
    """
    scores = ctx.backtest_panel(cuts, state_mode).select("account_id", "cut_date", risk_level(F.col("total_points"), ctx.cfg).alias("risk_level"), "outcome")
    counts = replicates(scores, "account_id", seeds).groupBy("cut_date", "seed", "risk_level").agg(
        F.sum("weight").alias("accounts"), F.sum(F.col("weight") * F.col("outcome")).alias("churned")
    )
    lift = lift_per_level(counts, ["cut_date", "seed"]).where(F.col("lift").isNotNull())
    return lift.groupBy("risk_level").agg(
        F.count(F.lit(1)).alias("replicates"), F.sum("accounts").alias("accounts"),
        stable(F.avg("lift")).alias("mean_lift"), stable(F.stddev_samp("lift")).alias("sd_lift"),
        F.min("lift").alias("min_lift"), F.max("lift").alias("max_lift"),
    )


def lift_stability(sweep: DataFrame) -> DataFrame:
    """Mean and sample deviation of the lift per risk level across cuts."""
    return sweep.groupBy("risk_level").agg(
        F.count(F.lit(1)).alias("cuts"), stable(F.avg("lift")).alias("mean_lift"), stable(F.stddev_samp("lift")).alias("sd_lift")
    )
