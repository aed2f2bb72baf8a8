"""Base views: one authoritative churn state per account, and per-account value/usage metrics.

Every output is keyed by ``account_id`` and stays hash-partitioned on it, so
downstream joins between these frames re-use one partitioning.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import ChurnConfig
from ..functions.expr import exact_sum, flag, lit_date, valid_at
from ..operators.latest import asc, desc, latest_per_key
from ..sources.roles import Roles


def churn_state(accounts: DataFrame, churn_events: DataFrame) -> DataFrame:
    """V1 - final churn state per account.

    The last event (``churn_date DESC, is_reactivation ASC, churn_event_id
    DESC``) decides: no event or a reactivation -> active (0); otherwise
    churned (1) with that event's date, reason and refund.  Also the number of
    events, of reactivations, and the account's own churn flag.  All accounts
    are kept.
    """
    last = latest_per_key(
        churn_events,
        "account_id",
        rank_by=[desc("churn_date"), asc("is_reactivation", boolean=True), desc("churn_event_id")],
        carry=["churn_date", "is_reactivation", "reason_code", "refund_amount_usd"],
        extra_aggs=[
            F.count(F.lit(1)).alias("_n_events"),
            F.sum(flag("is_reactivation")).alias("_n_reactivations"),
        ],
    )
    churned = F.col("is_reactivation") == F.lit(False)
    return accounts.select("account_id", "churn_flag").join(last, "account_id", "left").select(
        "account_id",
        F.coalesce("_n_events", F.lit(0)).cast("long").alias("n_events"),
        F.coalesce("_n_reactivations", F.lit(0)).cast("long").alias("n_reactivations"),
        F.when(churned, 1).otherwise(0).cast("int").alias("is_churned"),
        F.when(churned, F.col("churn_date")).alias("churn_date"),
        F.when(churned, F.col("reason_code")).alias("churn_reason"),
        F.when(churned, F.col("refund_amount_usd")).alias("refund_amount"),
        flag("churn_flag").alias("source_churn_flag"),
    )


def reference_dates(state: DataFrame, cfg: ChurnConfig) -> DataFrame:
    """V2a - each account's reference date (churn date, else the period close) and value date (ref - lag)."""
    ref = F.coalesce(F.col("churn_date"), lit_date(cfg.close_date))
    return state.select(
        "account_id",
        "is_churned",
        ref.alias("ref_date"),
        F.date_sub(ref, cfg.arr_lag_days).alias("value_date"),
    )


def value_at_ref(refs: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """V2b - MRR/ARR summed over the contracts live at each account's value date.

    Accounts without a live contract are absent (NULL value after a left join).
    """
    # one row per account and validity interval reaches the join, however many contracts share it
    subs = subscriptions.groupBy("account_id", "start_date", "end_date").agg(
        exact_sum(subscriptions, "mrr_amount").alias("mrr_amount"), exact_sum(subscriptions, "arr_amount").alias("arr_amount")
    )
    return (
        refs.select("account_id", "value_date")
        .join(subs, "account_id")
        .where(valid_at("start_date", "end_date", "value_date"))
        .groupBy("account_id")
        .agg(F.sum("mrr_amount").alias("mrr"), F.sum("arr_amount").alias("arr"))
    )


def usage_profile(usage: DataFrame, cfg: ChurnConfig) -> DataFrame:
    """V2c - all-time usage per account: days since last use (to the fixed close), total use, breadth, mean errors."""
    return usage.groupBy("account_id").agg(
        F.datediff(lit_date(cfg.close_date), F.max("usage_date")).alias("recency_days"),
        F.sum("usage_count").cast("long").alias("usage_total"),
        F.countDistinct("feature_name").alias("breadth"),
        F.avg("error_count").alias("errors_per_event"),
    )


def account_metrics(roles: Roles, state: DataFrame, cfg: ChurnConfig) -> DataFrame:
    """V2 - value and usage metrics per account (all accounts kept)."""
    refs = reference_dates(state, cfg)
    value = value_at_ref(refs, roles.subscriptions)
    usage = usage_profile(roles.usage, cfg)
    return (
        roles.accounts.select("account_id")
        .join(value, "account_id", "left")
        .join(usage, "account_id", "left")
        .select("account_id", "recency_days", "usage_total", "breadth", "errors_per_event", "mrr", "arr")
    )
