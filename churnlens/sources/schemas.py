"""Declared table contracts of the five input roles (types, NOT NULL, domains).

The contracts are data: a ``StructType`` plus a :class:`Contract` listing the
constraints that the quality operators check before anything is written.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

DEC = T.DecimalType(12, 2)

# Fixed value domains of the enumerated columns.
INDUSTRIES = ("EdTech", "FinTech", "DevTools", "HealthTech", "Cybersecurity")
REFERRAL_SOURCES = ("partner", "other", "organic", "event", "ads")
PLAN_TIERS = ("Basic", "Pro", "Enterprise")
BILLING_FREQUENCIES = ("monthly", "annual")
REASON_CODES = ("pricing", "support", "budget", "features", "competitor", "unknown")
PRIORITIES = ("low", "medium", "high", "urgent")


def _f(name, dtype, nullable=True):
    return T.StructField(name, dtype, nullable)


def schema(role: str, id_type: T.DataType = T.StringType()) -> T.StructType:
    """StructType of a role.  ``id_type`` is string for CSV sources, long for the test adapter."""
    s, b, d, i = T.StringType(), T.BooleanType(), T.DateType(), T.IntegerType()
    ts = T.TimestampNTZType()
    fields = {
        "accounts": [
            _f("account_id", id_type, False), _f("account_name", s), _f("industry", s), _f("country", s),
            _f("signup_date", d), _f("referral_source", s), _f("plan_tier", s), _f("seats", i),
            _f("is_trial", b), _f("churn_flag", b),
        ],
        "subscriptions": [
            _f("subscription_id", id_type, False), _f("account_id", id_type), _f("start_date", d),
            _f("end_date", d), _f("plan_tier", s), _f("seats", i), _f("mrr_amount", DEC),
            _f("arr_amount", DEC), _f("is_trial", b), _f("upgrade_flag", b), _f("downgrade_flag", b),
            _f("churn_flag", b), _f("billing_frequency", s), _f("auto_renew_flag", b),
        ],
        "usage": [
            _f("usage_id", s), _f("subscription_id", id_type), _f("account_id", id_type),
            _f("usage_date", d), _f("feature_name", s), _f("usage_count", i),
            _f("usage_duration_secs", i), _f("error_count", i), _f("is_beta_feature", b),
        ],
        "churn_events": [
            _f("churn_event_id", id_type, False), _f("account_id", id_type), _f("churn_date", d),
            _f("reason_code", s), _f("refund_amount_usd", DEC), _f("preceding_upgrade_flag", b),
            _f("preceding_downgrade_flag", b), _f("is_reactivation", b), _f("feedback_text", s),
        ],
        "tickets": [
            _f("ticket_id", s), _f("account_id", id_type), _f("submitted_at", ts), _f("closed_at", ts),
            _f("resolution_time_hours", T.DoubleType()), _f("priority", s),
            _f("first_response_time_minutes", i), _f("satisfaction_score", i), _f("escalation_flag", b),
        ],
    }[role]
    return T.StructType(fields)


@dataclass(frozen=True)
class Contract:
    """Constraints of one role: key, NOT NULL columns, domains, non-negative columns, FKs."""

    role: str
    key: tuple
    not_null: tuple
    domains: dict = field(default_factory=dict)
    non_negative: tuple = ()
    ranges: dict = field(default_factory=dict)
    foreign_keys: tuple = ()  # (column, parent role, parent column)


CONTRACTS = {
    "accounts": Contract(
        "accounts", ("account_id",),
        ("account_id", "account_name", "industry", "country", "signup_date", "referral_source",
         "plan_tier", "seats", "is_trial", "churn_flag"),
        {"industry": INDUSTRIES, "referral_source": REFERRAL_SOURCES, "plan_tier": PLAN_TIERS},
        ("seats",),
    ),
    "subscriptions": Contract(
        "subscriptions", ("subscription_id",),
        ("subscription_id", "account_id", "start_date", "plan_tier", "seats", "mrr_amount", "arr_amount",
         "is_trial", "upgrade_flag", "downgrade_flag", "churn_flag", "billing_frequency", "auto_renew_flag"),
        {"plan_tier": PLAN_TIERS, "billing_frequency": BILLING_FREQUENCIES},
        ("seats", "mrr_amount", "arr_amount"),
        foreign_keys=(("account_id", "accounts", "account_id"),),
    ),
    "usage": Contract(
        "usage", (),  # usage_id is not unique in the source: no key
        ("usage_id", "subscription_id", "usage_date", "feature_name", "usage_count",
         "usage_duration_secs", "error_count", "is_beta_feature"),
        {},
        ("usage_count", "usage_duration_secs", "error_count"),
        foreign_keys=(("subscription_id", "subscriptions", "subscription_id"),),
    ),
    "churn_events": Contract(
        "churn_events", ("churn_event_id",),
        ("churn_event_id", "account_id", "churn_date", "reason_code", "refund_amount_usd",
         "preceding_upgrade_flag", "preceding_downgrade_flag", "is_reactivation"),
        {"reason_code": REASON_CODES},
        ("refund_amount_usd",),
        foreign_keys=(("account_id", "accounts", "account_id"),),
    ),
    "tickets": Contract(
        "tickets", ("ticket_id",),
        ("ticket_id", "account_id", "submitted_at", "closed_at", "resolution_time_hours", "priority",
         "first_response_time_minutes", "escalation_flag"),
        {"priority": PRIORITIES},
        ("resolution_time_hours", "first_response_time_minutes", "satisfaction_score"),
        {"satisfaction_score": (1, 5)},
        foreign_keys=(("account_id", "accounts", "account_id"),),
    ),
}

# Load order that respects the foreign keys (parents first).
LOAD_ORDER = ("accounts", "subscriptions", "usage", "churn_events", "tickets")
