"""Role adapter: builds the five churn roles from the TPC-H-shaped test tables.

Operators never use table names; they take ``Roles`` (accounts,
subscriptions, usage, churn_events, tickets).  This module maps the driver's
parquet tables onto those roles with plain column expressions, so every
role grows with the underlying tables:

* accounts       <- customer (+ first order date as sign-up)
* subscriptions  <- orders (one contract per order)
* usage          <- lineitem joined once to orders for the account key
* churn_events   <- urgent, finished orders
* tickets        <- returned line items

Money is carried as integer cents and turned into ``decimal(12,2)`` so sums
are exact and independent of summation order.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .schemas import DEC, INDUSTRIES, PLAN_TIERS, PRIORITIES, REASON_CODES

# Fixed mapping of market segments onto acquisition channels.
SEGMENT_TO_CHANNEL = {
    "AUTOMOBILE": "ads",
    "BUILDING": "event",
    "FURNITURE": "organic",
    "HOUSEHOLD": "other",
    "MACHINERY": "partner",
}
N_FEATURES = 40  # size of the product feature catalogue


@dataclass(frozen=True)
class Roles:
    accounts: DataFrame
    subscriptions: DataFrame
    usage: DataFrame
    churn_events: DataFrame
    tickets: DataFrame

    def as_dict(self) -> dict:
        return {
            "accounts": self.accounts,
            "subscriptions": self.subscriptions,
            "usage": self.usage,
            "churn_events": self.churn_events,
            "tickets": self.tickets,
        }


def _pick(values, index: Column) -> Column:
    """``values[index]`` for a 0-based integer column (constant list lookup)."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def _money(cents: Column) -> Column:
    return (cents / 100).cast(DEC)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def testdata_roles(spark: SparkSession, sf_dir: str) -> Roles:
    customer = read_table(spark, sf_dir, "customer")
    orders = read_table(spark, sf_dir, "orders")
    lineitem = read_table(spark, sf_dir, "lineitem")

    first_order = orders.groupBy(F.col("o_custkey").alias("account_id")).agg(
        F.to_date(F.min("o_orderdate")).alias("signup_date")
    )
    channel = F.coalesce(*[F.when(F.col("c_mktsegment") == k, F.lit(v)) for k, v in SEGMENT_TO_CHANNEL.items()])
    accounts = (
        customer.select(
            F.col("c_custkey").alias("account_id"),
            F.col("c_name").alias("account_name"),
            _pick(INDUSTRIES, F.col("c_nationkey") % 5).alias("industry"),
            F.col("c_nationkey").cast("string").alias("country"),
            channel.alias("referral_source"),
            _pick(PLAN_TIERS, F.col("c_custkey") % 3).alias("plan_tier"),
            (F.lit(1) + (F.col("c_custkey") * 7) % 60).cast("int").alias("seats"),
            ((F.col("c_custkey") % 10) == 0).alias("is_trial"),
            (F.col("c_acctbal") < 0).alias("churn_flag"),
        )
        .join(first_order, "account_id", "left")
        .select("account_id", "account_name", "industry", "country", "signup_date", "referral_source",
                "plan_tier", "seats", "is_trial", "churn_flag")
    )

    okey = F.col("o_orderkey")
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    trial = (okey % 7) == 0
    start = F.to_date("o_orderdate")
    subscriptions = orders.select(
        okey.alias("subscription_id"),
        F.col("o_custkey").alias("account_id"),
        start.alias("start_date"),
        F.when(F.col("o_orderstatus") == "F", F.date_add(start, 365)).alias("end_date"),
        _pick(PLAN_TIERS, okey % 3).alias("plan_tier"),
        (F.lit(1) + (F.col("o_custkey") * 7) % 60 + F.when(okey % 9 == 0, 1).otherwise(0)).cast("int").alias("seats"),
        F.when(trial, F.lit(0).cast(DEC)).otherwise(_money(F.expr("cast(round(o_totalprice * 100) as bigint) div 12"))).alias("mrr_amount"),
        F.when(trial, F.lit(0).cast(DEC)).otherwise(_money(cents)).alias("arr_amount"),
        trial.alias("is_trial"),
        ((okey % 11) == 0).alias("upgrade_flag"),
        ((okey % 13) == 0).alias("downgrade_flag"),
        (F.col("o_orderstatus") == "F").alias("churn_flag"),
        F.when(okey % 2 == 0, "annual").otherwise("monthly").alias("billing_frequency"),
        (F.col("o_orderstatus") != "F").alias("auto_renew_flag"),
    )

    order_account = orders.select("o_orderkey", F.col("o_custkey").alias("account_id"))
    # Every item stays, also one whose order is missing (its account is unknown) or that shipped after
    # the period's close: dates are bounded by the windows that ask for it.
    items = lineitem.join(order_account, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    item_id = F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    usage = items.select(
        item_id.alias("usage_id"),
        F.col("l_orderkey").alias("subscription_id"),
        "account_id",
        F.to_date("l_shipdate").alias("usage_date"),
        F.concat(F.lit("F"), F.lpad((F.col("l_partkey") % N_FEATURES).cast("string"), 2, "0")).alias("feature_name"),
        F.floor("l_quantity").cast("int").alias("usage_count"),
        (F.floor("l_extendedprice").cast("long") % 3600).cast("int").alias("usage_duration_secs"),
        (F.col("l_linenumber") % 3).cast("int").alias("error_count"),
        ((F.col("l_partkey") % 7) == 0).alias("is_beta_feature"),
    )

    events = orders.where((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") == "F"))
    churn_events = events.select(
        okey.alias("churn_event_id"),
        F.col("o_custkey").alias("account_id"),
        start.alias("churn_date"),
        _pick(REASON_CODES, okey % 6).alias("reason_code"),
        F.when(okey % 4 == 0, _money(F.expr("cast(round(o_totalprice * 100) as bigint) div 1000"))).otherwise(F.lit(0).cast(DEC)).alias("refund_amount_usd"),
        ((okey % 3) == 0).alias("preceding_upgrade_flag"),
        ((okey % 7) == 0).alias("preceding_downgrade_flag"),
        ((okey % 5) == 0).alias("is_reactivation"),
        F.when(okey % 4 == 1, "missing features").when(okey % 4 == 2, "too expensive")
        .when(okey % 4 == 3, "switched to competitor").alias("feedback_text"),
    )

    hours = F.col("l_quantity") * 1.5
    # a time of day on most tickets: an hour for each line after the first, which is at midnight
    submitted = F.col("l_shipdate").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), (F.col("l_linenumber") - 1).cast("int"))
    tickets = items.where(F.col("l_returnflag") == "R").select(
        item_id.alias("ticket_id"),
        "account_id",
        submitted.alias("submitted_at"),
        (submitted + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (hours * 3600).cast("decimal(18,6)"))).alias("closed_at"),
        hours.alias("resolution_time_hours"),
        _pick(PRIORITIES, F.col("l_linenumber") % 4).alias("priority"),
        (F.col("l_partkey") % 181).cast("int").alias("first_response_time_minutes"),
        F.when(F.col("l_linenumber") != 7, (F.lit(1) + F.col("l_partkey") % 5).cast("int")).alias("satisfaction_score"),
        (F.col("l_tax") >= 0.07).alias("escalation_flag"),
    )
    return Roles(accounts, subscriptions, usage, churn_events, tickets)


def expected_counts(sources: dict[str, DataFrame]) -> dict[str, Column]:
    """Rows each role should hold, counted on the source selection it is built from (scalar Columns)."""
    orders, lineitem = sources["orders"], sources["lineitem"]

    def n(df: DataFrame) -> Column:
        return df.agg(F.count(F.lit(1))).scalar()

    return {
        "accounts": n(sources["customer"]),
        "subscriptions": n(orders),
        "usage": n(lineitem),
        "churn_events": n(orders.where((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") == "F"))),
        "tickets": n(lineitem.where(F.col("l_returnflag") == "R")),
    }
