import datetime as dt
from decimal import Decimal

from fixtures import account, context, event, sub, use
from pyspark.sql import functions as F

from churnlens.functions.expr import exact_sum
from churnlens.plans.state import value_at_ref


def rows_by_id(df):
    return {r["account_id"]: r.asDict() for r in df.collect()}


def test_churn_state_edges(spark, cfg):
    ctx = context(
        spark, cfg,
        accounts=[account(i) for i in range(1, 8)],
        churn_events=[
            # 2: one churn
            event(20, 2, "2024-03-01", reason="support", refund=12.5),
            # 3: churn then reactivation -> active
            event(30, 3, "2024-03-01"), event(31, 3, "2024-04-01", reactivation=True),
            # 4: reactivation then churn -> churned
            event(40, 4, "2024-03-01", reactivation=True), event(41, 4, "2024-05-01", reason="budget"),
            # 5: same day churn + reactivation -> churn wins (reactivation sorts last)
            event(50, 5, "2024-06-01", reactivation=True), event(51, 5, "2024-06-01", reason="features"),
            # 6: same day, same flag, two ids -> the higher id wins
            event(60, 6, "2024-07-01", reason="pricing"), event(61, 6, "2024-07-01", reason="competitor"),
            # 7: only a reactivation
            event(70, 7, "2024-01-01", reactivation=True),
        ],
    )
    got = rows_by_id(ctx.state)
    assert len(got) == 7
    assert got[1]["is_churned"] == 0 and got[1]["n_events"] == 0 and got[1]["churn_date"] is None
    assert got[2]["is_churned"] == 1 and got[2]["churn_reason"] == "support" and float(got[2]["refund_amount"]) == 12.5
    assert got[3]["is_churned"] == 0 and got[3]["n_events"] == 2 and got[3]["n_reactivations"] == 1
    assert got[4]["is_churned"] == 1 and got[4]["churn_date"] == dt.date(2024, 5, 1)
    assert got[5]["is_churned"] == 1 and got[5]["churn_reason"] == "features"
    assert got[6]["is_churned"] == 1 and got[6]["churn_reason"] == "competitor"
    assert got[7]["is_churned"] == 0 and got[7]["churn_reason"] is None


def test_value_at_reference_edges(spark, cfg):
    # Account 1 churned on 2024-06-16 -> value date 2024-06-01.
    ctx = context(
        spark, cfg,
        accounts=[account(1), account(2)],
        churn_events=[event(10, 1, "2024-06-16")],
        subscriptions=[
            sub(1, 1, "2024-01-01", None, arr=100),          # open contract: in
            sub(2, 1, "2023-06-01", "2024-06-01", arr=10),   # ends on the value date: in
            sub(3, 1, "2023-06-01", "2024-05-31", arr=1),    # ends the day before: out
            sub(4, 1, "2024-06-01", "2025-06-01", arr=1000),  # starts on it: in
            sub(5, 1, "2024-06-02", None, arr=5000),         # starts after: out
        ],
    )
    m = rows_by_id(ctx.metrics)
    assert float(m[1]["arr"]) == 1110.0
    assert m[2]["arr"] is None  # no contract -> no value


def test_usage_profile_recency_to_close(spark, cfg):
    ctx = context(
        spark, cfg,
        accounts=[account(1)],
        usage=[use(1, "2024-12-01", "F01", count=3, errors=1), use(1, "2024-12-21", "F02", count=5, errors=0)],
    )
    m = rows_by_id(ctx.metrics)[1]
    assert m["recency_days"] == 10 and m["usage_total"] == 8 and m["breadth"] == 2
    assert abs(m["errors_per_event"] - 0.5) < 1e-12


def test_exact_sum_is_the_sum_of_decimals(spark):
    big = Decimal("9999999999.99")
    rows = [(1, Decimal("-0.01")), (1, Decimal("21474836.48")), (1, None), (2, None), (3, big), (3, big), (4, -big), (4, Decimal("0.02")), (None, big)]
    df = spark.createDataFrame(rows, "k int, v decimal(12,2)")
    plain, exact = (df.groupBy("k").agg(s.alias("s")) for s in (F.sum("v"), exact_sum(df, "v")))
    assert exact.dtypes == plain.dtypes and sorted(exact.collect(), key=str) == sorted(plain.collect(), key=str)
    floats = df.select("k", df["v"].cast("double").alias("v"))
    assert floats.groupBy("k").agg(exact_sum(floats, "v").alias("s")).dtypes[1] == ("s", "double")


def test_contracts_of_one_interval_are_summed_as_integers(spark):
    subs = spark.createDataFrame([(1, dt.date(2024, 1, 1), None, Decimal("1.50"), Decimal("18.00"))] * 2, "account_id int, start_date date, end_date date, mrr_amount decimal(12,2), arr_amount decimal(12,2)")
    refs = spark.createDataFrame([(1, dt.date(2024, 6, 1))], "account_id int, value_date date")
    out = value_at_ref(refs, subs)
    assert [tuple(r) for r in out.collect()] == [(1, Decimal("3.00"), Decimal("36.00"))]
    assert "shiftright" in out._jdf.queryExecution().optimizedPlan().toString()
