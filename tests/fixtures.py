"""Hand-made micro-frames for operator edge cases."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from pyspark.sql import types as T

from churnlens.plans.context import Context
from churnlens.sources.roles import Roles
from churnlens.sources.schemas import schema

ROLES = ("accounts", "subscriptions", "usage", "churn_events", "tickets")


def frame(spark, role, rows):
    s = schema(role, T.LongType())
    data = []
    for r in rows:
        vals = []
        for f in s.fields:
            v = r.get(f.name)
            if isinstance(f.dataType, T.DecimalType) and v is not None and not isinstance(v, Decimal):
                v = Decimal(str(v))
            if isinstance(f.dataType, T.DateType) and isinstance(v, str):
                v = dt.date.fromisoformat(v)
            if isinstance(f.dataType, T.TimestampNTZType) and isinstance(v, str):
                v = dt.datetime.fromisoformat(v)
            vals.append(v)
        data.append(tuple(vals))
    return spark.createDataFrame(data, s)


def context(spark, cfg, **tables):
    frames = {r: frame(spark, r, tables.get(r, [])) for r in ROLES}
    return Context(Roles(**frames), cfg)


def account(i, signup="2023-01-01", seats=10, channel="organic", flag=False):
    return dict(account_id=i, account_name=f"a{i}", industry="EdTech", country="ES", signup_date=signup,
                referral_source=channel, plan_tier="Pro", seats=seats, is_trial=False, churn_flag=flag)


def event(eid, acc, date, reactivation=False, reason="pricing", refund=0):
    return dict(churn_event_id=eid, account_id=acc, churn_date=date, reason_code=reason, refund_amount_usd=refund,
                preceding_upgrade_flag=False, preceding_downgrade_flag=False, is_reactivation=reactivation)


def sub(sid, acc, start, end=None, arr=1200, mrr=100, seats=10, trial=False):
    return dict(subscription_id=sid, account_id=acc, start_date=start, end_date=end, plan_tier="Pro", seats=seats,
                mrr_amount=mrr, arr_amount=arr, is_trial=trial, upgrade_flag=False, downgrade_flag=False,
                churn_flag=False, billing_frequency="monthly", auto_renew_flag=True)


def use(acc, date, feature="F01", count=1, errors=0, sid=None, uid=None):
    return dict(usage_id=uid or f"{acc}-{date}-{feature}", subscription_id=sid if sid is not None else acc,
                account_id=acc, usage_date=date, feature_name=feature, usage_count=count, usage_duration_secs=60,
                error_count=errors, is_beta_feature=False)


def ticket(tid, acc, at, hours=1.0, sat=4, esc=False, first=10, priority="low"):
    return dict(ticket_id=tid, account_id=acc, submitted_at=at, closed_at=at, resolution_time_hours=hours,
                priority=priority, first_response_time_minutes=first, satisfaction_score=sat, escalation_flag=esc)
