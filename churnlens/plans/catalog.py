"""Named queries: every operator of the churn model as ``Context -> DataFrame``.

The names are the query keys registered with the driver (``__spark_entry__``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import share_of_groups
from ..session import collecting
from . import state as st
from .context import Context

QUERIES: dict[str, Callable[[Context], DataFrame]] = {}


def query(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn

    return deco


# ---------------------------------------------------------------- base views
@query("churn_state")
def q_churn_state(ctx: Context) -> DataFrame:
    return ctx.state


@query("churn_rate")
def q_churn_rate(ctx: Context) -> DataFrame:
    """Q17 - accounts per final state and their share of all accounts."""
    return ctx.state.groupBy("is_churned").agg(F.count(F.lit(1)).alias("accounts")).select(
        "is_churned", "accounts", share_of_groups("accounts").alias("pct")
    )


# ---------------------------------------------------------------- diagnosis C1-C15
from . import diagnosis as dg  # noqa: E402

for _name in (
    "cohort_churn", "churn_by_month", "signups_by_month", "lifetime_quartiles", "lifetime_bands", "refund_cost",
    "revenue_churn", "seat_quartiles", "seat_band_churn", "value_concentration", "reason_share", "reason_cost",
    "reason_by_size", "reason_by_lifetime", "claim_features_check", "claim_support_check",
    "behaviour_before_churn", "support_before_churn", "channel_risk", "churn_by_segment", "alltime_comparison",
    "trailing_usage", "trailing_support", "recency_at_ref",
):
    QUERIES[_name] = getattr(dg, _name)


@query("account_metrics")
def q_account_metrics(ctx: Context) -> DataFrame:
    """V2 - value at reference and all-time usage profile per account."""
    return ctx.metrics


@query("value_at_ref")
def q_value_at_ref(ctx: Context) -> DataFrame:
    """V2b - MRR and ARR of the contracts live at each account's value date."""
    return ctx.value


@query("usage_profile")
def q_usage_profile(ctx: Context) -> DataFrame:
    """V2c - all-time usage per account that has any."""
    return st.usage_profile(ctx.roles.usage, ctx.cfg)


# ---------------------------------------------------------------- early warning E1-E5, M5
from . import extras as ex  # noqa: E402
from . import marts as mt  # noqa: E402
from . import panel as pn  # noqa: E402
from . import recommend as rc  # noqa: E402
from . import risk as rk  # noqa: E402


@query("risk_signals")
def q_risk_signals(ctx: Context) -> DataFrame:
    return ctx.signals


@query("risk_scores")
def q_risk_scores(ctx: Context) -> DataFrame:
    return ctx.scores


@query("risk_headcount")
def q_risk_headcount(ctx: Context) -> DataFrame:
    return rk.risk_headcount(ctx.scores, ctx.cfg)


@query("priority_portfolio")
def q_priority_portfolio(ctx: Context) -> DataFrame:
    return ctx.priority


@query("action_summary")
def q_action_summary(ctx: Context) -> DataFrame:
    return rk.action_summary(ctx.priority)


@query("backtest_lift")
def q_backtest_lift(ctx: Context) -> DataFrame:
    return rk.backtest_lift(ctx)


@query("backtest_lift_as_of")
def q_backtest_lift_as_of(ctx: Context) -> DataFrame:
    """E5 without look-ahead: live-at-cut and outcome from as-of states."""
    return rk.backtest_lift(ctx, state_mode="as_of")


BACKTEST_CUTS_OFFSETS_DAYS = (0, -184)  # the cut and half a year before it
BACKTEST_SEEDS = (1, 2, 3)
PANEL_OFFSETS_DAYS = (0, -91, -182, -273)  # the quarters up to the cut


def _cuts(ctx: Context, offsets) -> list:
    import datetime as dt

    return [ctx.cfg.cut_date + dt.timedelta(days=d) for d in offsets]


@query("backtest_sweep")
def q_backtest_sweep(ctx: Context) -> DataFrame:
    return rk.backtest_sweep(ctx, _cuts(ctx, BACKTEST_CUTS_OFFSETS_DAYS))


@query("backtest_sweep_as_of")
def q_backtest_sweep_as_of(ctx: Context) -> DataFrame:
    """M5 without look-ahead, by quarter: live-at-cut and outcome from the states as of each date."""
    return rk.backtest_sweep(ctx, _cuts(ctx, PANEL_OFFSETS_DAYS), state_mode="as_of")


@query("lift_stability")
def q_lift_stability(ctx: Context) -> DataFrame:
    """M5 - mean and deviation of the lift over the cuts of the sweep."""
    return rk.lift_stability(q_backtest_sweep(ctx))


@query("lift_over_seeds")
def q_lift_over_seeds(ctx: Context) -> DataFrame:
    """M5 - mean and deviation of the lift over three seeds and two cuts."""
    return rk.lift_over_seeds(ctx, _cuts(ctx, BACKTEST_CUTS_OFFSETS_DAYS), BACKTEST_SEEDS)


@query("signals_at_cuts")
def q_signals_at_cuts(ctx: Context) -> DataFrame:
    """E1 at several dates: the signals of every account known by then, at the quarters up to the cut."""
    cuts = _cuts(ctx, PANEL_OFFSETS_DAYS)
    accounts = pn.at_dates(ctx.roles.accounts.select("account_id", "signup_date"), cuts, "cut_date")
    return pn.signals_at(ctx, accounts.where("signup_date <= cut_date").select("account_id", "cut_date"), cuts)


@query("state_as_of")
def q_state_as_of(ctx: Context) -> DataFrame:
    """V1 as of several dates: per quarter, the state that the events before it make of every account."""
    cuts = _cuts(ctx, PANEL_OFFSETS_DAYS)
    points = pn.at_dates(ctx.roles.accounts.select("account_id"), cuts, "as_of")
    return pn.states_before(ctx, points, "as_of")


# ---------------------------------------------------------------- recommender E6-E8, M2
@query("adoption_gap")
def q_adoption_gap(ctx: Context) -> DataFrame:
    return rc.gaps_of(ctx.catalogue, ctx.cfg).drop("_gap100")


@query("recommend_features")
def q_recommend_features(ctx: Context) -> DataFrame:
    return ctx.recommendations


@query("recommend_counts")
def q_recommend_counts(ctx: Context) -> DataFrame:
    return rc.recommend_counts(ctx.recommendations)


@query("breadth_gap_threshold")
def q_breadth_gap_threshold(ctx: Context) -> DataFrame:
    return rc.threshold_of(ctx.catalogue)


# ---------------------------------------------------------------- marts E9, E10, M7
@query("account_mart")
def q_account_mart(ctx: Context) -> DataFrame:
    return mt.account_mart(ctx.state, ctx.value, ctx.signals, ctx.scores, ctx.priority)


@query("monthly_flow")
def q_monthly_flow(ctx: Context) -> DataFrame:
    return mt.monthly_flow(ctx.roles.accounts, ctx.state)


@query("value_cumulative")
def q_value_cumulative(ctx: Context) -> DataFrame:
    return mt.value_cumulative(dg.value_concentration(ctx))


# ---------------------------------------------------------------- prose methods M1, M3, M4, M6
QUERIES["signal_significance"] = ex.signal_significance
QUERIES["own_baseline_trend"] = ex.own_baseline_trend
QUERIES["breadth_normalised"] = ex.breadth_normalised
QUERIES["seat_mismatch"] = ex.seat_mismatch


# ---------------------------------------------------------------- quality pack Q1-Q19, S5, J7
from . import checks as ck  # noqa: E402

for _name in (
    "profile_schema", "null_counts", "profile_numeric", "profile_text", "profile_dates", "profile_flags",
    "duplicate_rows", "key_uniqueness", "fk_orphans", "domain_violations", "distinct_values", "subs_without_usage",
    "trial_revenue_check", "flag_discrepancy", "base_counts", "post_churn_activity", "view_counts", "missing_value",
    "ever_churned_rate", "churn_source_sets", "load_reconcile",
):
    QUERIES[_name] = getattr(ck, _name)


# ---------------------------------------------------------------- sources, sinks, presentation S1-S7, O1-O3, F10
from . import storage as sg  # noqa: E402

for _name in (
    "csv_round_trip", "date_text_audit", "batch_load", "published_marts", "duplicates_in_order", "risk_levels_in_order", "reasons_in_order",
):
    QUERIES[_name] = getattr(sg, _name)


def _tracked(fn: Callable[[Context], DataFrame]) -> Callable[[Context], DataFrame]:
    """Everything a query writes while it is built belongs to its context, which releases it."""

    def run(ctx: Context) -> DataFrame:
        with collecting(ctx._paths):
            return fn(ctx)

    return run


QUERIES.update({name: _tracked(fn) for name, fn in QUERIES.items()})


VIEWS = ("churn_state", "account_metrics", "risk_signals", "risk_scores", "priority_portfolio", "recommend_features", "account_mart", "monthly_flow")


def create_views(ctx: Context, prefix: str = "") -> list[str]:
    """S6 - the published views as temporary views of the session, replaced if they exist."""
    for name in VIEWS:
        QUERIES[name](ctx).createOrReplaceTempView(prefix + name)
    return [prefix + name for name in VIEWS]
