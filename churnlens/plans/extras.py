"""Methods the analysis describes in prose: signal significance (M1), own-baseline trend (M3),
age-normalised breadth (M4), seat consistency (M6)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import ratio, stable
from ..operators.windows import trailing_window_agg
from .context import Context
from .diagnosis import support_before_ref, usage_before_ref

Z_95 = 1.96


def group_difference(per_entity: DataFrame, group_col: str, metrics: Sequence[str], z: float = Z_95) -> DataFrame:
    """M1 - Welch difference of means between group 1 and group 0 for each metric, with its margin
    ``z * sqrt(s1^2/n1 + s0^2/n0)``; significant when |diff| > margin.

    The metrics are unpivoted into (metric, value) rows and aggregated per
    metric with conditional moments: one pass, partial aggregation.
    """
    stack = "stack({n}, {pairs}) as (metric, value)".format(
        n=len(metrics), pairs=", ".join(f"'{m}', cast(`{m}` as double)" for m in metrics)
    )
    long = per_entity.select(F.col(group_col).alias("_g"), F.expr(stack))
    g1, g0 = F.col("_g") == 1, F.col("_g") == 0
    v = F.col("value")
    agg = long.groupBy("metric").agg(
        F.count(F.when(g1, v)).alias("n_1"),
        F.avg(F.when(g1, v)).alias("mean_1"),
        F.var_samp(F.when(g1, v)).alias("_v1"),
        F.count(F.when(g0, v)).alias("n_0"),
        F.avg(F.when(g0, v)).alias("mean_0"),
        F.var_samp(F.when(g0, v)).alias("_v0"),
    )
    margin = F.lit(z) * F.sqrt(ratio("_v1", "n_1") + ratio("_v0", "n_0"))
    out = agg.select(
        "metric", "n_1", "mean_1", "n_0", "mean_0",
        (F.col("mean_1") - F.col("mean_0")).alias("diff"),
        margin.alias("margin"),
    ).withColumn("significant", (F.abs(F.col("diff")) > F.col("margin")).cast("int"))
    return out.select("metric", "n_1", stable("mean_1").alias("mean_1"), "n_0", stable("mean_0").alias("mean_0"),
                      stable("diff").alias("diff"), stable("margin").alias("margin"), "significant")


def proportion_difference(per_entity: DataFrame, group_col: str, flags: Sequence[str], z: float = Z_95) -> DataFrame:
    """M1 for flags - difference of the shares of group 1 and group 0, with the margin of the two-proportion z test
    ``z * sqrt(p (1 - p) (1/n1 + 1/n0))``, p being the pooled share; significant when |diff| > margin.

    A NULL flag is not counted; a group without any has no share, and no difference is significant then.
    Counts are integers, so the result does not depend on their order.  One pass, partial aggregation.
    """
    stack = "stack({n}, {pairs}) as (metric, hit)".format(
        n=len(flags), pairs=", ".join(f"'{m}', cast(`{m}` as int)" for m in flags)
    )
    long = per_entity.select(F.col(group_col).alias("_g"), F.expr(stack))
    g1, g0, hit = F.col("_g") == 1, F.col("_g") == 0, F.col("hit")
    agg = long.groupBy("metric").agg(
        F.count(F.when(g1, hit)).alias("n_1"), F.sum(F.when(g1, hit)).alias("_x1"),
        F.count(F.when(g0, hit)).alias("n_0"), F.sum(F.when(g0, hit)).alias("_x0"),
    )
    share1, share0 = ratio("_x1", "n_1"), ratio("_x0", "n_0")
    pooled = ratio(F.col("_x1") + F.col("_x0"), F.col("n_1") + F.col("n_0"))
    margin = F.lit(z) * F.sqrt(pooled * (1 - pooled) * (ratio(F.lit(1), "n_1") + ratio(F.lit(1), "n_0")))
    out = agg.select("metric", "n_1", share1.alias("mean_1"), "n_0", share0.alias("mean_0"), (share1 - share0).alias("diff"), margin.alias("margin"))
    return out.select("metric", "n_1", stable("mean_1").alias("mean_1"), "n_0", stable("mean_0").alias("mean_0"), stable("diff").alias("diff"),
                      stable("margin").alias("margin"), (F.abs(F.col("diff")) > F.col("margin")).cast("int").alias("significant"))


SIGNAL_METRICS = ("events", "intensity", "errors", "silence_days", "tickets", "hours", "satisfaction", "escalated_pct")


#: Shares of accounts among the same signals; NULL where the account has no such tickets.
SIGNAL_FLAGS = {"no_use": "events = 0", "no_tickets": "tickets = 0", "any_escalation": "escalated_pct > 0", "dissatisfied": "satisfaction < 3"}


def signal_significance(ctx: Context) -> DataFrame:
    """M1 on the pre-reference signals (C13 + C14 per account): churned (1) vs active (0), means by Welch's
    margin and shares of accounts by the two-proportion z."""
    days = ctx.cfg.window_days
    u = usage_before_ref(ctx, ctx.refs, days)
    s = support_before_ref(ctx, ctx.refs, days, keep=())
    per = u.join(s, "account_id")
    means = group_difference(per, "is_churned", SIGNAL_METRICS).withColumn("test", F.lit("welch"))
    shares = proportion_difference(per.select("is_churned", *[F.expr(c).alias(m) for m, c in SIGNAL_FLAGS.items()]), "is_churned", list(SIGNAL_FLAGS))
    return means.unionByName(shares.withColumn("test", F.lit("two_proportion")))


def own_baseline_trend(ctx: Context, recent_days: int | None = None, base_days: int = 180) -> DataFrame:
    """M3 - recent window (ref - recent, ref] against the account's own earlier baseline
    (ref - recent - base, ref - recent]: intensity ratio and per-day frequency ratio.

    One pass over the rolled-up usage with conditional sums serves both windows.
    """
    recent = recent_days or ctx.cfg.window_days
    ts, ref = F.col("usage_date"), F.col("ref_date")
    in_recent = (ts > F.date_sub(ref, recent)) & (ts <= ref)
    in_base = (ts > F.date_sub(ref, recent + base_days)) & (ts <= F.date_sub(ref, recent))

    def s(pred, c):
        return F.coalesce(F.sum(F.when(pred, F.col(c))), F.lit(0)).cast("long")

    per = trailing_window_agg(
        ctx.refs, ctx.usage_daily, "account_id", "ref_date", "usage_date", recent + base_days,
        [
            s(in_recent, "n").alias("recent_events"),
            s(in_base, "n").alias("base_events"),
            ratio(F.sum(F.when(in_recent, F.col("sum_usage_count"))), F.sum(F.when(in_recent, F.col("n")))).alias("recent_intensity"),
            ratio(F.sum(F.when(in_base, F.col("sum_usage_count"))), F.sum(F.when(in_base, F.col("n")))).alias("base_intensity"),
        ],
        keep=["is_churned"],
    )
    return per.select(
        "*",
        ratio("recent_intensity", "base_intensity").alias("intensity_ratio"),
        ratio(F.col("recent_events") * base_days, F.col("base_events") * recent).alias("frequency_ratio"),
    )


def breadth_normalised(ctx: Context) -> DataFrame:
    """M4 - distinct features used / sqrt(usage events), per account (all time)."""
    return ctx.roles.usage.groupBy("account_id").agg(
        F.countDistinct("feature_name").alias("breadth"),
        F.count(F.lit(1)).alias("events"),
    ).select("account_id", "breadth", "events", (F.col("breadth") / F.sqrt("events")).alias("breadth_norm"))


def seat_mismatch(ctx: Context) -> DataFrame:
    """M6 - contracts whose seats differ from the account's seats."""
    a = ctx.roles.accounts.select("account_id", F.col("seats").alias("account_seats"))
    s = ctx.roles.subscriptions.select("subscription_id", "account_id", F.col("seats").alias("subscription_seats"))
    return s.join(a, "account_id").where(~F.col("account_seats").eqNullSafe(F.col("subscription_seats")))
