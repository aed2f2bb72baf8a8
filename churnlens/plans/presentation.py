"""Presentation of result tables: the published ordering and decimals.

The queries return unrounded values (reproducible and comparable); this layer
rounds (HALF_UP) and orders a result the way the published tables show it.
Sorting is a global order, meant for the small report tables, not for
account-level outputs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import RISK_LABELS
from ..functions.expr import field_order


def _desc(c: str) -> str:
    return f"-{c}"


_risk_order = "@risk_level"  # FIELD(risk_level, 'High', 'Medium', 'Low')


def _key(spec: str) -> Column:
    if spec == _risk_order:
        return field_order("risk_level", *RISK_LABELS)
    return F.col(spec[1:]).desc() if spec.startswith("-") else F.col(spec)


# Ordering and decimals of the published result tables, per query key
# ("-c" = descending, "@risk_level" = High, Medium, Low).
PRESENTATION: dict[str, tuple[list[str], dict[str, int]]] = {
    "churn_rate": (["is_churned"], {"pct": 2}),
    "cohort_churn": (["signup_year", "signup_quarter"], {"churn_pct": 2, "mean_observed_days": 0}),
    "churn_by_month": (["month"], {}),
    "signups_by_month": (["month"], {}),
    "lifetime_quartiles": (["quartile"], {}),
    "lifetime_bands": (["lifetime_band"], {"pct": 2}),
    "refund_cost": ([], {"mean_per_churn": 2, "mean_per_refund": 2}),
    "revenue_churn": ([], {"lost_pct": 2}),
    "seat_quartiles": (["quartile"], {}),
    "seat_band_churn": (["size_band"], {"churn_pct": 2}),
    "value_concentration": (["decile"], {"arr": 0, "arr_pct": 2, "churn_pct": 2, "lost_pct": 2}),
    "reason_share": ([_desc("pct")], {"pct": 2}),
    "reason_cost": ([_desc("arr_lost_pct")], {"pct_accounts": 2, "arr_lost": 0, "arr_lost_pct": 2}),
    "reason_by_size": (["reason_family", "size_band"], {"pct": 2}),
    "reason_by_lifetime": (["life_band", "reason_family"], {"pct": 2}),
    "claim_features_check": ([], {"mean_breadth": 2, "mean_usage": 0}),
    "claim_support_check": ([], {"mean_tickets": 2, "mean_hours": 1, "mean_satisfaction": 2, "escalated_pct": 2}),
    "behaviour_before_churn": ([_desc("is_churned")], {"mean_silence_days": 1, "mean_intensity": 2,
                                                      "mean_events": 1, "mean_errors": 3}),
    "support_before_churn": (["is_churned"], {"mean_tickets": 2, "mean_hours": 1, "mean_first_response": 1,
                                              "mean_satisfaction": 2, "escalated_pct": 2}),
    "channel_risk": ([_desc("churn_pct")], {"churn_pct": 2, "mean_observed_days": 0, "arr_lost": 0,
                                            "arr_lost_pct": 2}),
    "flag_discrepancy": (["check_class"], {"pct": 2}),
    "trial_revenue_check": (["check_class"], {}),
    "backtest_lift": ([_risk_order], {"churn_pct": 2, "lift": 2}),
    "backtest_lift_as_of": ([_risk_order], {"churn_pct": 2, "lift": 2}),
    "backtest_sweep": (["cut_date", _risk_order], {"churn_pct": 2, "lift": 2}),
    "action_summary": (["action"], {}),
    "recommend_counts": ([_desc("accounts"), "feature_name"], {}),
    "adoption_gap": ([_desc("gap"), "feature_name"], {}),
    "monthly_flow": (["month"], {}),
    "account_metrics": ([], {"errors_per_event": 3}),
    "duplicate_rows": (["usage_id", "usage_date", "feature_name"], {}),
    "churn_by_segment": (["dimension", _desc("churn_pct"), "value"], {"churn_pct": 2}),
    "lift_stability": ([_risk_order], {"mean_lift": 2, "sd_lift": 2}),
    "lift_over_seeds": ([_risk_order], {"mean_lift": 2, "sd_lift": 2, "min_lift": 2, "max_lift": 2}),
    "backtest_sweep_as_of": (["cut_date", _risk_order], {"churn_pct": 2, "lift": 2}),
    "reasons_in_order": (["position"], {"pct": 2}),
    "risk_levels_in_order": (["position"], {}),
    "published_marts": (["account_status", "month"], {"arr": 0}),
}


def present(name: str, df: DataFrame) -> DataFrame:
    """Round and order ``df`` (the result of query ``name``) as the published table does."""
    order, digits = PRESENTATION.get(name, ([], {}))
    out = df.select(*[F.round(F.col(c), digits[c]).alias(c) if c in digits else F.col(c) for c in df.columns])
    keys = [_key(o) for o in order]
    return out.orderBy(*keys) if keys else out
