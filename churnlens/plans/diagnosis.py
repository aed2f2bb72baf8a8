"""Diagnostic questions: cohorts, timing, lifetime, cost, size, value concentration, reasons,
stated-vs-observed behaviour, pre-churn signals, acquisition channel (C1-C15).

Outputs are unrounded (doubles); rounding is a presentation step
(:mod:`churnlens.plans.presentation`).  Shares of a total are
computed over the grouped rows (:func:`share_of_groups`), so the base is
read once; money stays decimal (exact) until the final division.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import REASON_FAMILY_OTHER, ChurnConfig
from ..functions.expr import first_match, flag, lit_date, month_label, pct, ratio, share_of_groups, stable
from ..operators.ranking import OrderSpec, distributed_ntile
from ..operators.windows import daily_rollup, trailing_window_agg
from .context import Context


def dec_mean(c) -> Column:
    """Mean of a decimal column as exact-sum / count (order-independent double)."""
    x = F.col(c) if isinstance(c, str) else c
    return ratio(F.sum(x), F.count(x))


def dsum(c) -> Column:
    x = F.col(c) if isinstance(c, str) else c
    return F.sum(x).cast("double")


def observed_days(cfg: ChurnConfig) -> Column:
    return F.datediff(F.coalesce(F.col("churn_date"), lit_date(cfg.close_date)), F.col("signup_date"))


def lifetime_days() -> Column:
    return F.datediff(F.col("churn_date"), F.col("signup_date"))


def reason_family(cfg: ChurnConfig) -> Column:
    cases = [(F.col("churn_reason").isin(*vals), name) for name, vals in cfg.reason_families.items()]
    return first_match(cases, REASON_FAMILY_OTHER)


def _accounts_state(ctx: Context) -> DataFrame:
    return ctx.roles.accounts.join(ctx.state, "account_id")


def _churned(ctx: Context) -> DataFrame:
    return ctx.state.where(F.col("is_churned") == 1)


# ---------------------------------------------------------------- Q1 quantification
def cohort_churn(ctx: Context) -> DataFrame:
    """C1 - sign-up cohort (year, quarter): accounts, churned, churn %, mean observed days."""
    df = _accounts_state(ctx)
    return df.groupBy(
        F.year("signup_date").alias("signup_year"), F.quarter("signup_date").alias("signup_quarter")
    ).agg(
        F.count(F.lit(1)).alias("accounts"),
        F.sum("is_churned").cast("long").alias("churned"),
        (F.avg("is_churned") * 100).alias("churn_pct"),
        F.avg(observed_days(ctx.cfg)).alias("mean_observed_days"),
    )


def churn_by_month(ctx: Context) -> DataFrame:
    """C2a - churned accounts per churn month."""
    return _churned(ctx).groupBy(month_label("churn_date").alias("month")).agg(F.count(F.lit(1)).alias("churned"))


def signups_by_month(ctx: Context) -> DataFrame:
    """C2b - sign-ups per month."""
    return ctx.roles.accounts.groupBy(month_label("signup_date").alias("month")).agg(
        F.count(F.lit(1)).alias("signups")
    )


def _lifetimes(ctx: Context) -> DataFrame:
    return ctx.roles.accounts.select("account_id", "signup_date").join(
        _churned(ctx).select("account_id", "churn_date", "churn_reason"), "account_id"
    ).withColumn("days", lifetime_days())


def lifetime_quartiles(ctx: Context) -> DataFrame:
    """C3a - quartiles of days-to-churn (NTILE(4), ties by account): accounts, min and max days."""
    tiles = distributed_ntile(_lifetimes(ctx), 4, {"quartile": OrderSpec("days")}, "account_id",
                              ctx.cfg.ntile_buckets)
    return tiles.groupBy("quartile").agg(
        F.count(F.lit(1)).alias("accounts"), F.min("days").alias("min_days"), F.max("days").alias("max_days")
    )


def lifetime_band(days: Column, cuts) -> Column:
    a, b, c, d = cuts
    return first_match(
        [
            (days <= a, f"a. <={a} days"),
            (days <= b, f"b. {a + 1}-{b} days"),
            (days <= c, f"c. {b + 1}-{c} days"),
            (days <= d, f"d. {c + 1}-{d} days"),
        ],
        f"e. >{d} days",
    )


def lifetime_bands(ctx: Context) -> DataFrame:
    """C3b - churned accounts per lifetime band and share of all churned."""
    lt = _lifetimes(ctx)
    return (
        lt.groupBy(lifetime_band(F.col("days"), ctx.cfg.lifetime_cuts).alias("lifetime_band"))
        .agg(F.count(F.lit(1)).alias("accounts"))
        .withColumn("pct", share_of_groups("accounts"))
    )


def refund_cost(ctx: Context) -> DataFrame:
    """C4 - refund cost of churn: churned, with refund, mean per churn / per refund, min, max, total."""
    r = F.col("refund_amount")
    positive = F.when(r > 0, r)
    return _churned(ctx).agg(
        F.sum("is_churned").cast("long").alias("churned"),
        F.count(positive).alias("with_refund"),
        dec_mean(r).alias("mean_per_churn"),
        dec_mean(positive).alias("mean_per_refund"),
        F.min(positive).cast("double").alias("min_refund"),
        F.max(r).cast("double").alias("max_refund"),
        dsum(r).alias("total_refund"),
    )


def revenue_churn(ctx: Context) -> DataFrame:
    """C5 - ARR lost (value at the churn reference), ARR live, lost share, churned accounts without value."""
    df = ctx.state.select("account_id", "is_churned").join(ctx.value.select("account_id", "arr"), "account_id")
    churned = F.col("is_churned") == 1
    agg = df.agg(
        F.sum("is_churned").cast("long").alias("churned"),
        F.count(F.when(churned & F.col("arr").isNull(), 1)).alias("no_value"),
        dsum(F.when(churned, F.col("arr"))).alias("arr_lost"),
        dsum(F.when(F.col("is_churned") == 0, F.col("arr"))).alias("arr_live"),
    )
    return agg.withColumn("lost_pct", pct("arr_lost", F.col("arr_lost") + F.col("arr_live")))


# ---------------------------------------------------------------- Q2 characterisation
def seat_quartiles(ctx: Context) -> DataFrame:
    """C6a - NTILE(4) of seats over all accounts (ties by account): accounts, min and max seats."""
    df = _accounts_state(ctx).select("account_id", "seats")
    tiles = distributed_ntile(df, 4, {"quartile": OrderSpec("seats")}, "account_id", ctx.cfg.ntile_buckets)
    return tiles.groupBy("quartile").agg(
        F.count(F.lit(1)).alias("accounts"), F.min("seats").alias("min_seats"), F.max("seats").alias("max_seats")
    )


def seat_band(seats: Column, cuts) -> Column:
    """Overlapping bands as written in the source (5 and 15 belong to the earlier band: first match wins)."""
    a, b, c = cuts
    return first_match(
        [
            (seats <= a, "a. small"),
            (seats.between(a, b), "b. medium"),
            (seats.between(b, c), "c. large"),
            (seats > c, "d. very large"),
        ]
    )


def seat_band_churn(ctx: Context) -> DataFrame:
    """C6b - churn rate per seat band."""
    return (
        _accounts_state(ctx)
        .groupBy(seat_band(F.col("seats"), ctx.cfg.seat_cuts).alias("size_band"))
        .agg(
            F.count(F.lit(1)).alias("accounts"),
            F.sum("is_churned").cast("long").alias("churned"),
            (F.avg("is_churned") * 100).alias("churn_pct"),
        )
    )


def value_concentration(ctx: Context) -> DataFrame:
    """C7 - ARR deciles (1 = highest): accounts, ARR, ARR share, churned, churn %, share of lost ARR."""
    df = (
        ctx.value.where(F.col("arr").isNotNull())
        .select("account_id", "arr")
        .join(ctx.state.select("account_id", "is_churned"), "account_id")
    )
    df = ctx.materialize(df)
    tiles = distributed_ntile(df, 10, {"decile": OrderSpec("arr", descending=True)}, "account_id",
                              ctx.cfg.ntile_buckets)
    lost = F.when(F.col("is_churned") == 1, F.col("arr"))
    per = tiles.groupBy("decile").agg(
        F.count(F.lit(1)).alias("accounts"),
        F.sum("arr").alias("_arr"),
        F.sum("is_churned").cast("long").alias("churned"),
        (F.avg("is_churned") * 100).alias("churn_pct"),
        F.sum(lost).alias("_lost"),
    )
    return per.select(
        "decile", "accounts", F.col("_arr").cast("double").alias("arr"), share_of_groups("_arr").alias("arr_pct"),
        "churned", "churn_pct", share_of_groups("_lost").alias("lost_pct"),
    )


# ---------------------------------------------------------------- Q3 causes
def reason_share(ctx: Context) -> DataFrame:
    """C8 - churned accounts per reason and share."""
    return _churned(ctx).groupBy("churn_reason").agg(F.count(F.lit(1)).alias("churned")).withColumn(
        "pct", share_of_groups("churned")
    )


def reason_cost(ctx: Context) -> DataFrame:
    """C9 - per reason: churned, without value, share of churned, ARR lost and its share."""
    df = _churned(ctx).select("account_id", "churn_reason").join(ctx.value.select("account_id", "arr"), "account_id")
    per = df.groupBy("churn_reason").agg(
        F.count(F.lit(1)).alias("churned"),
        F.count(F.when(F.col("arr").isNull(), 1)).alias("no_value"),
        F.sum("arr").alias("_arr"),
    )
    return per.select(
        "churn_reason", "churned", "no_value", share_of_groups("churned").alias("pct_accounts"),
        F.col("_arr").cast("double").alias("arr_lost"), share_of_groups("_arr").alias("arr_lost_pct"),
    )


def _share_within(df: DataFrame, keys: list[str], within: str) -> DataFrame:
    """Counts per ``keys`` and their share inside ``within`` (window over the grouped rows only)."""
    g = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("accounts"))
    return g.withColumn("pct", pct("accounts", F.sum("accounts").over(Window.partitionBy(within))))


def reason_by_size(ctx: Context) -> DataFrame:
    """C10 - reason family x size (<= 15 seats small), share within family."""
    df = _churned(ctx).select("account_id", "churn_reason").join(ctx.roles.accounts.select("account_id", "seats"),
                                                                   "account_id")
    df = df.select(
        reason_family(ctx.cfg).alias("reason_family"),
        F.when(F.col("seats") <= ctx.cfg.seat_cuts[1], "small").otherwise("large").alias("size_band"),
    )
    return _share_within(df, ["reason_family", "size_band"], "reason_family")


def reason_by_lifetime(ctx: Context) -> DataFrame:
    """C11 - reason family x lifetime band (<=90, 91-365, >365), share within band."""
    days = F.col("days")
    band = first_match([(days <= 90, "a. early"), (days.between(91, 365), "b. middle"), (days > 365, "c. late")])
    df = _lifetimes(ctx).select(reason_family(ctx.cfg).alias("reason_family"), band.alias("life_band"))
    return _share_within(df, ["reason_family", "life_band"], "life_band")


def claim_features_check(ctx: Context) -> DataFrame:
    """C12a - do accounts that name 'features' use fewer features?  Mean breadth and usage."""
    df = _churned(ctx).select("account_id", "churn_reason").join(
        ctx.metrics.select("account_id", "breadth", "usage_total"), "account_id"
    )
    return df.groupBy(F.when(F.col("churn_reason") == "features", 1).otherwise(0).alias("claims_features")).agg(
        F.count(F.lit(1)).alias("accounts"),
        F.avg("breadth").alias("mean_breadth"),
        F.avg("usage_total").alias("mean_usage"),
    )


def tickets_per_account(tickets: DataFrame) -> DataFrame:
    return tickets.groupBy("account_id").agg(
        F.count("ticket_id").alias("n_tickets"),
        F.avg("resolution_time_hours").alias("hours"),
        F.avg("satisfaction_score").alias("satisfaction"),
        F.avg(flag("escalation_flag")).alias("escalation_rate"),
    )


def claim_support_check(ctx: Context) -> DataFrame:
    """C12b - do accounts that name 'support' show a worse support history?  Two-level average."""
    per = tickets_per_account(ctx.roles.tickets)
    df = _churned(ctx).select("account_id", "churn_reason").join(per, "account_id", "left")
    return df.groupBy(F.when(F.col("churn_reason") == "support", 1).otherwise(0).alias("claims_support")).agg(
        F.count(F.lit(1)).alias("accounts"),
        F.avg("n_tickets").alias("mean_tickets"),
        stable(F.avg("hours")).alias("mean_hours"),
        stable(F.avg("satisfaction")).alias("mean_satisfaction"),
        stable(F.avg("escalation_rate") * 100).alias("escalated_pct"),
    )


# ---------------------------------------------------------------- Q4 anticipation
def usage_daily(ctx: Context) -> DataFrame:
    """Usage rolled up per (account, day): a hot account sends at most one row per active day."""
    return daily_rollup(ctx.roles.usage, "account_id", "usage_date", sums=["usage_count", "error_count"])


def usage_before_ref(ctx: Context, refs: DataFrame, days: int, keep=("is_churned",)) -> DataFrame:
    """Per account: events, intensity and errors in (ref - days, ref], and days since the last use on or before ref.

    One pass over the rolled-up usage serves both the window and the recency.
    """
    ts, ref = F.col("usage_date"), F.col("ref_date")
    inside = (ts > F.date_sub(ref, days)) & (ts <= ref)
    events = F.coalesce(F.sum(F.when(inside, F.col("n"))), F.lit(0)).cast("long")
    return trailing_window_agg(
        refs, ctx.usage_daily, "account_id", "ref_date", "usage_date", None,
        [
            events.alias("events"),
            ratio(F.sum(F.when(inside, F.col("sum_usage_count"))), F.sum(F.when(inside, F.col("n")))).alias("intensity"),
            ratio(F.sum(F.when(inside, F.col("sum_error_count"))), F.sum(F.when(inside, F.col("n")))).alias("errors"),
            F.datediff(F.col("ref_date"), F.max("usage_date")).alias("silence_days"),
        ],
        keep=[*keep, "ref_date"],
    )


def behaviour_before_churn(ctx: Context) -> DataFrame:
    """C13 - behaviour in the window before each account's own reference date, churned vs active."""
    per = usage_before_ref(ctx, ctx.refs, ctx.cfg.window_days)
    return per.groupBy("is_churned").agg(
        F.count(F.lit(1)).alias("accounts"),
        F.count(F.when(F.col("events") == 0, 1)).alias("no_use"),
        F.avg("silence_days").alias("mean_silence_days"),
        stable(F.avg("intensity")).alias("mean_intensity"),
        F.avg("events").alias("mean_events"),
        stable(F.avg("errors")).alias("mean_errors"),
    )


def tickets_rollup(tickets: DataFrame) -> DataFrame:
    """Tickets rolled up to at most two rows per (account, day).

    Window bounds are midnights, so within a day only "exactly at midnight"
    versus "later that day" matters: later tickets are represented by noon of
    their day.  Every window test against a midnight bound gives the same
    answer as the real instant, and a hot account contributes at most two
    rows per day to the per-account join.
    """
    day = F.to_date("submitted_at").cast("timestamp_ntz")
    at = F.when(F.col("submitted_at") == day, day).otherwise(day + F.expr("INTERVAL 12 HOURS"))
    return tickets.groupBy("account_id", at.alias("submitted_at")).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("resolution_time_hours").alias("sum_hours"),
        F.sum("first_response_time_minutes").alias("sum_first_response"),
        F.sum("satisfaction_score").alias("sum_satisfaction"),
        F.count("satisfaction_score").alias("n_satisfaction"),
        F.sum(flag("escalation_flag")).alias("sum_escalated"),
    )


def support_window_aggs(inside: Column) -> list[Column]:
    n = F.sum(F.when(inside, F.col("n")))
    return [
        F.coalesce(n, F.lit(0)).cast("long").alias("tickets"),
        ratio(F.sum(F.when(inside, F.col("sum_hours"))), n).alias("hours"),
        ratio(F.sum(F.when(inside, F.col("sum_first_response"))), n).alias("first_response"),
        ratio(F.sum(F.when(inside, F.col("sum_satisfaction"))), F.sum(F.when(inside, F.col("n_satisfaction")))).alias("satisfaction"),
        (ratio(F.sum(F.when(inside, F.col("sum_escalated"))), n) * 100).alias("escalated_pct"),
    ]


def support_before_ref(ctx: Context, refs: DataFrame, days: int, keep=("is_churned",)) -> DataFrame:
    ts, ref = F.col("submitted_at"), F.col("ref_date")
    inside = (ts > F.date_sub(ref, days)) & (ts <= ref)
    return trailing_window_agg(
        refs, ctx.tickets_daily, "account_id", "ref_date", "submitted_at", days,
        support_window_aggs(inside), keep=list(keep),
    )


def support_before_churn(ctx: Context) -> DataFrame:
    """C14 - support experience in the window before each account's reference date, churned vs active."""
    per = support_before_ref(ctx, ctx.refs, ctx.cfg.window_days)
    return per.groupBy("is_churned").agg(
        F.count(F.lit(1)).alias("accounts"),
        F.count(F.when(F.col("tickets") == 0, 1)).alias("no_tickets"),
        F.avg("tickets").alias("mean_tickets"),
        stable(F.avg("hours")).alias("mean_hours"),
        stable(F.avg("first_response")).alias("mean_first_response"),
        stable(F.avg("satisfaction")).alias("mean_satisfaction"),
        stable(F.avg("escalated_pct")).alias("escalated_pct"),
    )


def channel_risk(ctx: Context) -> DataFrame:
    """C15 - acquisition channel: churn rate, exposure days, ARR lost and its share."""
    df = (
        ctx.roles.accounts.select("account_id", "referral_source", "signup_date")
        .join(ctx.state.select("account_id", "is_churned", "churn_date"), "account_id")
        .join(ctx.value.select("account_id", "arr"), "account_id")
    )
    lost = F.when(F.col("is_churned") == 1, F.col("arr"))
    per = df.groupBy(F.col("referral_source").alias("channel")).agg(
        F.count(F.lit(1)).alias("accounts"),
        F.sum("is_churned").cast("long").alias("churned"),
        (F.avg("is_churned") * 100).alias("churn_pct"),
        F.avg(observed_days(ctx.cfg)).alias("mean_observed_days"),
        F.sum(lost).alias("_lost"),
    )
    return per.select(
        "channel", "accounts", "churned", "churn_pct", "mean_observed_days",
        F.col("_lost").cast("double").alias("arr_lost"), share_of_groups("_lost").alias("arr_lost_pct"),
    )


# ---------------------------------------------------------------- flat controls and all-time comparison
SEGMENTS = ("plan_tier", "industry", "country")


def churn_by_segment(ctx: Context) -> DataFrame:
    """Accounts, churned and churn % per value of plan tier, industry and country (one pass)."""
    pairs = ", ".join(f"'{c}', `{c}`" for c in SEGMENTS)
    df = _accounts_state(ctx).select("is_churned", F.expr(f"stack({len(SEGMENTS)}, {pairs}) as (dimension, value)"))
    return df.groupBy("dimension", "value").agg(
        F.count(F.lit(1)).alias("accounts"),
        F.sum("is_churned").cast("long").alias("churned"),
        (F.avg("is_churned") * 100).alias("churn_pct"),
    )


def alltime_comparison(ctx: Context) -> DataFrame:
    """Leaving against staying accounts over all time: breadth, tickets, resolution, satisfaction, escalation, value.

    Accounts without usage or tickets count as 0 in breadth and tickets, and are left out of the means of the rest.
    """
    df = (
        ctx.state.select("account_id", "is_churned")
        .join(ctx.metrics.select("account_id", "breadth", "arr"), "account_id")
        .join(tickets_per_account(ctx.roles.tickets), "account_id", "left")
    )
    return df.groupBy("is_churned").agg(
        F.count(F.lit(1)).alias("accounts"),
        F.avg(F.coalesce("breadth", F.lit(0))).alias("mean_breadth"),
        F.avg(F.coalesce("n_tickets", F.lit(0))).alias("mean_tickets"),
        stable(F.avg("hours")).alias("mean_hours"),
        stable(F.avg("satisfaction")).alias("mean_satisfaction"),
        stable(F.avg("escalation_rate") * 100).alias("escalated_pct"),
        dec_mean("arr").alias("mean_arr"),
    )


# ---------------------------------------------------------------- per-account windows (A12, A13)
def trailing_usage(ctx: Context) -> DataFrame:
    """A12 - usage in the window that ends at each account's own reference date."""
    return usage_before_ref(ctx, ctx.refs, ctx.cfg.window_days).select("account_id", "events", "intensity", "errors")


def trailing_support(ctx: Context) -> DataFrame:
    """A12 - tickets in the window that ends at each account's own reference date."""
    per = support_before_ref(ctx, ctx.refs, ctx.cfg.window_days)
    return per.select("account_id", "tickets", "hours", "first_response", "satisfaction", "escalated_pct")


def recency_at_ref(ctx: Context) -> DataFrame:
    """A13 - days since the last use on or before the reference date (NULL: never used before it)."""
    return usage_before_ref(ctx, ctx.refs, ctx.cfg.window_days).select("account_id", "ref_date", "silence_days")
