import datetime as dt

from fixtures import account, context, event, sub, ticket, use

from churnlens.plans import diagnosis as dg
from churnlens.plans import risk as rk


def by_id(df):
    return {r["account_id"]: r.asDict() for r in df.collect()}


def test_trailing_window_edges(spark, cfg):
    # Account 1 churned 2024-06-30 -> window (2024-04-01, 2024-06-30].
    ctx = context(
        spark, cfg,
        accounts=[account(1), account(2)],
        churn_events=[event(1, 1, "2024-06-30")],
        usage=[
            use(1, "2024-04-01", count=100),  # ref - 90: out
            use(1, "2024-04-02", count=2),    # ref - 89: in
            use(1, "2024-06-30", count=4),    # ref: in
            use(1, "2024-07-01", count=100),  # ref + 1: out
        ],
        tickets=[
            ticket("t1", 1, "2024-06-30 00:00:00", hours=2.0),   # midnight of ref day: in
            ticket("t2", 1, "2024-06-30 10:00:00", hours=50.0),  # later that day: out
        ],
    )
    u = by_id(dg.usage_before_ref(ctx, ctx.refs, 90))
    assert u[1]["events"] == 2 and u[1]["intensity"] == 3.0 and u[1]["silence_days"] == 0
    assert u[2]["events"] == 0 and u[2]["intensity"] is None and u[2]["silence_days"] is None
    s = by_id(dg.support_before_ref(ctx, ctx.refs, 90))
    assert s[1]["tickets"] == 1 and s[1]["hours"] == 2.0
    assert s[2]["tickets"] == 0 and s[2]["satisfaction"] is None


def test_risk_signals_and_points(spark, cfg):
    close = cfg.close_date
    accts = [account(i) for i in range(1, 7)]
    usage = [use(1, "2024-12-30", count=10), use(1, "2024-12-29", count=10), use(2, "2024-12-30", count=1, errors=3)]
    tickets = [
        ticket("a", 3, "2024-12-01 00:00:00", sat=2), ticket("b", 3, "2024-12-02 00:00:00", sat=2),
        ticket("c", 3, "2024-12-03 00:00:00", sat=2, esc=True),
        ticket("d", 4, "2024-12-01 00:00:00", sat=None), ticket("e", 5, "2024-12-01 00:00:00", sat=3, esc=True),
    ]
    ctx = context(spark, cfg, accounts=accts, usage=usage, tickets=tickets)
    sig = rk.risk_signals(ctx, rk.live_at_close(ctx), close)
    s = by_id(sig)
    assert s[6]["sessions"] == 0 and s[6]["intensity"] == 0.0 and s[6]["tickets"] == 0 and s[6]["satisfaction"] is None
    assert s[3]["tickets"] == 3 and abs(s[3]["escalated_pct"] - 100 / 3) < 1e-9
    sc = by_id(rk.risk_scores(sig, cfg))
    # tickets >= 3 -> 2, escalation 33 % > 25 -> 2, satisfaction 2 < 3 -> 2
    assert (sc[3]["p_tickets"], sc[3]["p_escalation"], sc[3]["p_satisfaction"]) == (2, 2, 2)
    # NULL satisfaction and 0 % escalation score 0
    assert (sc[4]["p_tickets"], sc[4]["p_escalation"], sc[4]["p_satisfaction"]) == (1, 0, 0)
    # escalation exactly 100 > 25 -> 2; satisfaction 3 -> 1
    assert (sc[5]["p_escalation"], sc[5]["p_satisfaction"]) == (2, 1)
    for r in sc.values():
        assert 0 <= r["total_points"] <= 12
        assert r["total_points"] == r["product_points"] + r["support_points"]
    # account 1 (most intense, most sessions, no errors) has the fewest product points
    assert sc[1]["product_points"] == min(r["product_points"] for r in sc.values())


def test_priority_matrix_and_null_value(spark, cfg):
    from pyspark.sql import functions as F

    scores = spark.createDataFrame(
        [(i, p, 0, p) for i, p in zip(range(1, 11), [8, 8, 5, 5, 4, 8, 5, 9, 7, 2])],
        "account_id long, total_points long, product_points long, support_points long",
    )
    metrics = spark.createDataFrame(
        [(i, float(1000 - i * 10)) for i in range(1, 10)] + [(10, None)], "account_id long, arr double"
    ).withColumn("arr", F.col("arr").cast("decimal(12,2)"))
    pr = by_id(rk.priority_portfolio(scores, metrics, cfg))
    assert 10 not in pr  # NULL value drops out
    assert pr[1]["value_level"] == "High" and pr[1]["risk_level"] == "High" and pr[1]["action"] == "1. Direct intervention"
    assert pr[3]["action"] == "2. Proactive contact"  # medium risk, high value
    assert pr[5]["action"] == "4. No action"          # low risk
    assert pr[6]["value_level"] == "Medium" and pr[6]["action"] == "2. Proactive contact"
    assert pr[9]["value_level"] == "Low" and pr[9]["risk_level"] == "Medium" and pr[9]["action"] == "4. No action"
    assert pr[8]["value_level"] == "Low" and pr[8]["action"] == "3. Automated campaign"


def test_backtest_cohort_edges(spark, cfg):
    cut = cfg.cut_date  # 2024-06-30
    accts = [account(1), account(2), account(3), account(4), account(5, signup="2024-05-01"),
             account(6, signup="2024-05-01"), account(7)]
    accts[5]["signup_date"] = (cut - dt.timedelta(days=60)).isoformat()  # exactly 60 days: kept
    accts[4]["signup_date"] = (cut - dt.timedelta(days=59)).isoformat()  # 59 days: out
    ev = [
        event(1, 1, "2024-06-30"),                      # churn on the cut day: live, outcome 1
        event(2, 2, (cut + dt.timedelta(days=179)).isoformat()),  # in
        event(3, 3, (cut + dt.timedelta(days=180)).isoformat()),  # out of horizon
        event(4, 4, "2024-01-01"),                      # churned before the cut: not live
        event(7, 7, "2024-01-01"), event(8, 7, "2024-09-01", reactivation=True),  # back later: live (final state)
    ]
    ctx = context(spark, cfg, accounts=accts, churn_events=ev)
    co = {r["account_id"]: r["outcome"] for r in rk.backtest_cohort(ctx, cut).collect()}
    assert co == {1: 1, 2: 1, 3: 0, 6: 0, 7: 0}


def test_no_look_ahead_in_backtest_signals(spark, cfg):
    cut = cfg.cut_date
    base = dict(accounts=[account(1), account(2)], churn_events=[])
    before = context(spark, cfg, usage=[use(1, "2024-06-01"), use(2, "2024-06-02")], **base)
    after = context(spark, cfg, usage=[use(1, "2024-06-01"), use(2, "2024-06-02"), use(1, "2024-07-05", count=99),
                                       use(2, "2024-08-01", errors=9)], **base)
    a = sorted(tuple(r) for r in rk.backtest_scores(before, cut).collect())
    b = sorted(tuple(r) for r in rk.backtest_scores(after, cut).collect())
    assert a == b


def test_bands(spark, cfg):
    from pyspark.sql import functions as F

    seats = spark.createDataFrame([(s,) for s in (5, 6, 15, 16, 28, 29)], "seats int")
    got = [r[0] for r in seats.select(dg.seat_band(F.col("seats"), cfg.seat_cuts)).collect()]
    assert got == ["a. small", "b. medium", "b. medium", "c. large", "c. large", "d. very large"]
    days = spark.createDataFrame([(x,) for x in (30, 31, 90, 91, 180, 181, 365, 366)], "days int")
    got = [r[0] for r in days.select(dg.lifetime_band(F.col("days"), cfg.lifetime_cuts)).collect()]
    assert got == ["a. <=30 days", "b. 31-90 days", "b. 31-90 days", "c. 91-180 days", "c. 91-180 days",
                   "d. 181-365 days", "d. 181-365 days", "e. >365 days"]


def test_ticket_rollup_keeps_time_of_day_edges(spark, cfg):
    # ref 2024-06-30 -> window (2024-04-01 00:00, 2024-06-30 00:00]
    ctx = context(
        spark, cfg,
        accounts=[account(1)],
        churn_events=[event(1, 1, "2024-06-30")],
        tickets=[
            ticket("a", 1, "2024-04-01 00:00:00", hours=100.0),  # lower bound itself: out
            ticket("b", 1, "2024-04-01 08:00:00", hours=2.0),    # later on the lower-bound day: in
            ticket("c", 1, "2024-04-01 23:00:00", hours=4.0),    # same day, rolled into one row: in
            ticket("d", 1, "2024-06-30 00:00:00", hours=6.0),    # upper bound: in
            ticket("e", 1, "2024-06-30 00:00:01", hours=100.0),  # after the upper bound: out
        ],
    )
    s = by_id(dg.support_before_ref(ctx, ctx.refs, 90))
    assert s[1]["tickets"] == 3 and s[1]["hours"] == 4.0
    rolled = dg.tickets_rollup(ctx.roles.tickets).count()
    assert rolled == 4  # a | b+c | d | e


def test_window_at_date_prunes_month_partitions(spark, cfg, tmp_path):
    from churnlens.operators.windows import window_at_date
    from churnlens.sources import io
    from fixtures import frame
    from pyspark.sql import types as T

    accts = frame(spark, "accounts", [account(1)])
    subs = frame(spark, "subscriptions", [sub(1, 1, "2024-01-01")])
    usage = frame(spark, "usage", [use(1, "2024-01-15"), use(1, "2024-12-30", count=3), use(1, "2024-10-03", count=5), use(1, "2024-10-02", count=50)])
    io.write_roles({"accounts": accts, "subscriptions": subs, "usage": usage}, str(tmp_path), id_type=T.LongType())
    facts = io.read_roles_parquet(spark, str(tmp_path))["usage"]
    from pyspark.sql import functions as F

    out = window_at_date(accts, facts, "account_id", "usage_date", cfg.close_date, 90,
                         [F.count(F.lit(1)).alias("n"), F.sum("usage_count").alias("s")])
    r = out.collect()[0]
    assert (r["n"], r["s"]) == (2, 8)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month" in plan


def test_hot_account_is_bounded_by_days_and_exact(spark, cfg):
    """One account holds most of the usage: the per-account join sees one row per active day,
    and the window aggregates equal a brute-force computation over the raw rows."""
    import random

    rnd = random.Random(3)
    days = [(dt.date(2024, 12, 31) - dt.timedelta(days=d)).isoformat() for d in range(0, 120, 7)]
    hot = [use(1, rnd.choice(days), count=rnd.randint(0, 9), errors=rnd.randint(0, 2), uid=f"h{i}") for i in range(3000)]
    cold = [use(a, days[a % len(days)], count=a, uid=f"c{a}") for a in range(2, 40)]
    ctx = context(spark, cfg, accounts=[account(i) for i in range(1, 40)], usage=hot + cold)
    rolled = ctx.usage_daily.where("account_id = 1").count()
    assert rolled == len({u["usage_date"] for u in hot})
    got = by_id(dg.usage_before_ref(ctx, ctx.refs, 90))[1]
    inside = [u for u in hot if dt.date.fromisoformat(u["usage_date"]) > dt.date(2024, 10, 2)]
    assert got["events"] == len(inside)
    assert got["intensity"] == sum(u["usage_count"] for u in inside) / len(inside)
    assert got["errors"] == sum(u["error_count"] for u in inside) / len(inside)


def test_backtest_as_of_has_no_look_ahead(spark, cfg):
    cut = cfg.cut_date  # 2024-06-30
    accts = [account(i) for i in range(1, 6)]
    ev = [
        event(1, 1, "2024-01-01"), event(2, 1, "2024-09-01", reactivation=True),  # left before, back later: NOT live
        event(3, 2, "2024-07-15"),                                              # leaves inside the horizon: outcome 1
        event(4, 3, "2024-07-15"), event(5, 3, "2024-08-01", reactivation=True),  # left and came back inside: 0
        event(6, 4, "2024-06-29"),                                              # left the day before the cut: not live
    ]
    ctx = context(spark, cfg, accounts=accts, churn_events=ev)
    final = {r["account_id"]: r["outcome"] for r in rk.backtest_cohort(ctx, cut).collect()}
    as_of = {r["account_id"]: r["outcome"] for r in rk.backtest_cohort(ctx, cut, "as_of").collect()}
    assert final == {1: 0, 2: 1, 3: 0, 5: 0}
    assert as_of == {2: 1, 3: 0, 5: 0}
