"""Published marts: one row per account with everything the dashboard needs, and the monthly
sign-up / churn flow (E9, E10, S7), plus the cumulative value curve (M7).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import month_label, pct


def account_mart(state: DataFrame, metrics: DataFrame, signals: DataFrame, scores: DataFrame,
                 priority: DataFrame) -> DataFrame:
    """E9 - state + value + signals + points + priority; lost accounts kept (NULL signals).

    Five frames keyed by account_id: the left joins share the key, so with
    hash partitioning on account_id the star is assembled without reshuffling
    the fact side between joins.
    """
    return (
        state.select(
            "account_id", "is_churned",
            F.when(F.col("is_churned") == 1, "Lost").otherwise("Active").alias("account_status"),
            "churn_date", "churn_reason",
        )
        .join(metrics.select("account_id", "arr"), "account_id", "left")
        .join(signals.select("account_id", "intensity", "sessions", "errors", "tickets", "resolution_hours",
                             "escalated_pct", "satisfaction"), "account_id", "left")
        .join(scores.select("account_id", "product_points", "support_points", "total_points"), "account_id", "left")
        .join(priority.select("account_id", "risk_level", "risk_order", "value_level", "value_order", "action"),
              "account_id", "left")
    )


def monthly_flow(accounts: DataFrame, state: DataFrame) -> DataFrame:
    """E10 - sign-ups and churns per month ('yyyy-MM-01'); months with neither are absent."""
    signups = accounts.select(month_label("signup_date", first_day=True).alias("month"),
                              F.lit(1).alias("signups"), F.lit(0).alias("churned"))
    churns = state.where(F.col("is_churned") == 1).select(
        month_label("churn_date", first_day=True).alias("month"), F.lit(0).alias("signups"), F.lit(1).alias("churned")
    )
    return signups.unionByName(churns).groupBy("month").agg(
        F.sum("signups").cast("long").alias("signups"), F.sum("churned").cast("long").alias("churned")
    )


def value_cumulative(concentration: DataFrame) -> DataFrame:
    """M7 - cumulative share of accounts, ARR and lost ARR from the top decile down (ten rows)."""
    w = Window.orderBy("decile").rowsBetween(Window.unboundedPreceding, 0)
    return concentration.select(
        "decile",
        pct(F.sum("accounts").over(w), F.sum("accounts").over(Window.partitionBy())).alias("cum_accounts_pct"),
        F.sum("arr_pct").over(w).alias("cum_arr_pct"),
        F.sum("lost_pct").over(w).alias("cum_lost_pct"),
    )
