"""Data-quality pack over the five roles, and the consistency checks of the analysis
(Q1-Q19, S5, J7)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import first_match, pct, share_of_groups
from ..operators import quality as qa
from ..sources.schemas import CONTRACTS
from .context import Context

# Columns profiled per role.
NUMERIC = {
    "accounts": ["seats"],
    "subscriptions": ["seats", "mrr_amount", "arr_amount"],
    "usage": ["usage_count", "usage_duration_secs", "error_count"],
    "churn_events": ["refund_amount_usd"],
    "tickets": ["resolution_time_hours", "first_response_time_minutes", "satisfaction_score"],
}
TEXT = {
    "accounts": ["account_id", "account_name", "industry", "country", "referral_source", "plan_tier"],
    "subscriptions": ["subscription_id", "account_id", "plan_tier", "billing_frequency"],
    "usage": ["usage_id", "subscription_id", "account_id", "feature_name"],
    "churn_events": ["churn_event_id", "account_id", "reason_code", "feedback_text"],
    "tickets": ["ticket_id", "account_id", "priority"],
}
DATES = {
    "accounts": ["signup_date"],
    "subscriptions": ["start_date", "end_date"],
    "usage": ["usage_date"],
    "churn_events": ["churn_date"],
    "tickets": ["submitted_at", "closed_at"],
}
FLAGS = {
    "accounts": ["is_trial", "churn_flag"],
    "subscriptions": ["is_trial", "upgrade_flag", "downgrade_flag", "churn_flag", "auto_renew_flag"],
    "usage": ["is_beta_feature"],
    "churn_events": ["preceding_upgrade_flag", "preceding_downgrade_flag", "is_reactivation"],
    "tickets": ["escalation_flag"],
}
KEYS = {
    "accounts": ["account_id"],
    "subscriptions": ["subscription_id"],
    "usage": ["usage_id"],
    "churn_events": ["churn_event_id"],
    "tickets": ["ticket_id"],
}


def _union(frames):
    return reduce(lambda a, b: a.unionByName(b), frames)


def _tables(ctx: Context) -> dict[str, DataFrame]:
    return ctx.roles.as_dict()


def profile_schema(ctx: Context) -> DataFrame:
    return _union([qa.profile_schema(df, name) for name, df in _tables(ctx).items()])


def null_counts(ctx: Context) -> DataFrame:
    return profile_schema(ctx).select("table_name", "column_name", "nulls")


def profile_numeric(ctx: Context) -> DataFrame:
    t = _tables(ctx)
    return qa.profile_numeric_many([(n, t[n], cols) for n, cols in NUMERIC.items()])


def profile_text(ctx: Context) -> DataFrame:
    t = _tables(ctx)
    return _union([qa.profile_text(t[n], n, cols) for n, cols in TEXT.items()])


def profile_dates(ctx: Context) -> DataFrame:
    t = _tables(ctx)
    return qa.profile_dates_many([(n, t[n], cols) for n, cols in DATES.items()])


def profile_flags(ctx: Context) -> DataFrame:
    t = _tables(ctx)
    return _union([qa.profile_flags(t[n], n, cols) for n, cols in FLAGS.items()])


def duplicate_rows(ctx: Context) -> DataFrame:
    """Q7 - usage rows sharing a usage id (a known defect of the source: distinct events, kept)."""
    return qa.duplicate_rows(ctx.roles.usage, ["usage_id"])


def key_uniqueness(ctx: Context) -> DataFrame:
    t = _tables(ctx)
    return _union([qa.key_uniqueness(t[n], n, k) for n, k in KEYS.items()])


def fk_orphans(ctx: Context) -> DataFrame:
    return qa.fk_orphan_report(_tables(ctx), CONTRACTS)


def domain_violations(ctx: Context) -> DataFrame:
    t = _tables(ctx)
    return _union([qa.domain_violations(t[n], CONTRACTS[n]) for n in t])


def distinct_values(ctx: Context) -> DataFrame:
    t = _tables(ctx)
    cols = {n: list(CONTRACTS[n].domains) for n in t}
    cols["churn_events"].append("feedback_text")
    return _union([qa.distinct_values(t[n], n, c) for n, c in cols.items() if c])


def subs_without_usage(ctx: Context) -> DataFrame:
    """Q11 - subscriptions with no usage row."""
    return qa.parents_without_children(
        ctx.roles.subscriptions.select("subscription_id", "account_id"), ctx.roles.usage, "subscription_id"
    )


# The published labels of the classes.
TRIAL_CLASSES = ("a. trial, zero MRR (expected)", "b. paid contract", "c. anomaly: trial with MRR", "d. alarm")


def trial_revenue_check(ctx: Context) -> DataFrame:
    """Q12 - trial <-> zero MRR classes of the contracts."""
    m, t = F.col("mrr_amount"), F.col("is_trial")
    a, b, c, d = TRIAL_CLASSES
    cls = first_match([((m == 0) & t, a), ((m > 0) & ~t, b), ((m > 0) & t, c)], d)
    return ctx.roles.subscriptions.groupBy(cls.alias("check_class")).agg(F.count("subscription_id").alias("subscriptions"))


# The published labels of the classes.
FLAG_CLASSES = ("a. agree: churned", "b. agree: active", "c. disagree: flag misses churn", "d. disagree: flag over-reports")


def flag_discrepancy(ctx: Context) -> DataFrame:
    """Q13 - event-log state against the account flag, with shares."""
    s, f = F.col("is_churned"), F.col("source_churn_flag")
    a, b, c, d = FLAG_CLASSES
    cls = first_match([((s == 1) & (f == 1), a), ((s == 0) & (f == 0), b), ((s == 1) & (f == 0), c)], d)
    return ctx.state.groupBy(cls.alias("check_class")).agg(F.count(F.lit(1)).alias("accounts")).withColumn(
        "pct", share_of_groups("accounts")
    )


def base_counts(ctx: Context) -> DataFrame:
    """Q14 - lost and active accounts (SUM of CASE without ELSE: NULL when there are none)."""
    s = F.col("is_churned")
    return ctx.state.agg(
        F.sum(F.when(s == 1, 1)).cast("long").alias("lost"), F.sum(F.when(s == 0, 1)).cast("long").alias("active")
    )


def post_churn_activity(ctx: Context) -> DataFrame:
    """Q15 - usage events after the churn date of churned accounts, and accounts affected."""
    churned = ctx.state.where(F.col("is_churned") == 1).select("account_id", "churn_date")
    # daily counts: a hot account sends one row per active day to the join
    after = ctx.usage_daily.select("account_id", "usage_date", "n").join(churned, "account_id").where(
        F.col("usage_date") > F.col("churn_date")
    )
    return after.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("events"), F.countDistinct("account_id").alias("accounts")
    )


def view_counts(ctx: Context) -> DataFrame:
    """Q16 - completeness: rows of the two base views (one per account expected)."""
    return ctx.state.agg(F.count(F.lit(1)).alias("rows")).select(F.lit("churn_state").alias("view_name"), "rows").unionByName(
        ctx.metrics.agg(F.count(F.lit(1)).alias("rows")).select(F.lit("account_metrics").alias("view_name"), "rows")
    )


def missing_value(ctx: Context) -> DataFrame:
    """Q18 - accounts without value at their reference, per final state."""
    df = ctx.state.select("account_id", "is_churned").join(ctx.value.select("account_id", "arr"), "account_id")
    return df.groupBy("is_churned").agg(
        F.count(F.lit(1)).alias("accounts"), F.count(F.when(F.col("arr").isNull(), 1)).alias("no_value")
    )


def ever_churned_rate(ctx: Context) -> DataFrame:
    """Q19 - accounts with any churn event over all accounts."""
    ever = ctx.roles.churn_events.agg(F.countDistinct("account_id").alias("accounts_ever"))
    total = ctx.roles.accounts.agg(F.count(F.lit(1))).scalar()
    return ever.select("accounts_ever", F.lit(total).cast("long").alias("accounts"),
                       pct("accounts_ever", total).alias("pct"))


def churn_source_sets(ctx: Context) -> DataFrame:
    """J7 - accounts with churn events vs accounts flagged as churned: only events, only flag, both."""
    ev = ctx.roles.churn_events.select("account_id")
    fl = ctx.roles.accounts.where(F.col("churn_flag")).select("account_id")
    return qa.key_set_compare(ev, fl, "account_id").select(
        F.col("only_a").alias("only_events"), F.col("only_b").alias("only_flag"), "both"
    )


def load_reconcile(ctx: Context) -> DataFrame:
    """S5 - rows of each role against the rows of the source selection it comes from."""
    if ctx.sources is None:
        raise ValueError("load_reconcile needs the source tables (Context.from_testdata)")
    from ..sources.roles import expected_counts

    return qa.load_reconcile(_tables(ctx), expected_counts(ctx.sources))
