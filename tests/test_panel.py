"""Many reference dates at once: running windows, as-of states, the back-test panel and its replicates, against plain Python."""

import datetime as dt
import hashlib
import math
import random
import statistics
from collections import defaultdict

import pytest
from fixtures import account, context, event, ticket, use
from pyspark.sql import functions as F

from churnlens.operators.bootstrap import poisson_weight, replicates
from churnlens.operators.latest import desc, state_before, state_intervals
from churnlens.operators.windows import running_windows
from churnlens.plans import panel as pn
from churnlens.plans import risk as rk

DAY0 = dt.date(2024, 1, 1)


def day(k):
    return DAY0 + dt.timedelta(days=k)


def test_running_windows_equal_plain_sums(spark):
    r = random.Random(4)
    rows = {(k, d): (r.randint(0, 9), r.choice([None, r.randint(1, 5)])) for k in range(6) for d in r.sample(range(200), r.choice([0, 1, 30, 150]))}
    other = {(k, d): r.randint(0, 3) for k in range(5) for d in r.sample(range(200), 12)}
    a = spark.createDataFrame([(k, day(d), *v) for (k, d), v in rows.items()] + [(None, day(5), 1, 1)], "k long, day date, a int, b int")
    b = spark.createDataFrame([(k, day(d), v) for (k, d), v in other.items()], "k long, day date, c int")
    points = [(k, d) for k in range(7) for d in r.sample(range(-5, 210), 9)]
    windows = {"recent": (30, 0), "before": (90, 30), "all": (400, 0)}
    out = running_windows(
        spark.createDataFrame([(k, day(d)) for k, d in points], "k long, at date"), [a, b], "k", "at", "day", ["a", "b", "c"], windows, {"last": "a"}
    )
    seen = 0
    for row in out.collect():
        k, at = row["k"], (row["at"] - DAY0).days
        for name, (far, near) in windows.items():
            inside = lambda d: at - far < d <= at - near  # noqa: B023, E731
            assert row[f"{name}_a"] == sum(v[0] for (x, d), v in rows.items() if x == k and inside(d))
            assert row[f"{name}_b"] == sum(v[1] or 0 for (x, d), v in rows.items() if x == k and inside(d))
            assert row[f"{name}_c"] == sum(v for (x, d), v in other.items() if x == k and inside(d))
        assert row["last"] == max((day(d) for (x, d) in rows if x == k and d <= at), default=None)
        seen += 1
    assert seen == len(points)


def test_states_before_every_day_equal_the_state_of_the_filtered_log(spark, cfg):
    r = random.Random(6)
    events = [event(i, r.randrange(8), day(r.randrange(60)).isoformat(), r.random() < 0.4, refund=i) for i in range(70)]
    ctx = context(spark, cfg, accounts=[account(i) for i in range(10)], churn_events=events)
    days = [day(k) for k in range(-2, 64, 3)]
    points = pn.at_dates(ctx.roles.accounts.select("account_id"), days, "at")
    got = {(x["account_id"], x["at"]): x for x in pn.states_before(ctx, points, "at").collect()}
    assert len(got) == 10 * len(days)
    for d in days:
        for x in ctx.state_before(d).collect():
            y = got[x["account_id"], d]
            for c in ("n_events", "n_reactivations", "is_churned", "churn_date", "churn_reason", "refund_amount"):
                assert x[c] == y[c], (d, x, y)


def test_a_hot_key_brings_its_days_to_the_sort(spark):
    log = spark.range(5000).select(F.lit(1).alias("k"), F.date_add(F.lit(DAY0), (F.col("id") % 20).cast("int")).alias("d"), F.col("id").alias("e"))
    per = state_intervals(log, "k", "d", [desc("e")], ["e"], [F.count(F.lit(1)).alias("n")])
    assert per.count() == 20
    point = spark.createDataFrame([(1, day(0)), (1, day(1)), (1, day(99)), (2, day(9))], "k int, at date")
    got = {(x["k"], x["at"]): (x["e"], x["n"]) for x in state_before(point, per, "k", "at").collect()}
    assert got == {(1, day(0)): (None, None), (1, day(1)): (4980, 250), (1, day(99)): (4999, 5000), (2, day(9)): (None, None)}


def small(spark, cfg, seed=2):
    r = random.Random(seed)
    some = lambda n: [day(r.randrange(365)).isoformat() for _ in range(n)]
    accounts = [account(i, signup=day(r.randrange(-300, 150)).isoformat()) for i in range(40)]
    events = [event(i, r.randrange(40), d, r.random() < 0.3) for i, d in enumerate(some(35))]
    usage = [use(r.randrange(40), d, count=r.randint(0, 9), errors=r.randint(0, 2), uid=f"u{i}") for i, d in enumerate(some(600))]
    tickets = [ticket(f"t{i}", r.randrange(40), f"{d} {r.choice(['00:00:00', '00:00:01', '13:00:00'])}", hours=r.randint(1, 60) / 4, sat=r.choice([None, 1, 2, 3, 4, 5]), esc=r.random() < 0.3) for i, d in enumerate(some(200))]
    return context(spark, cfg, accounts=accounts, churn_events=events, usage=usage, tickets=tickets)


CUTS = [day(90 + 21 * k) for k in range(8)]


def test_signals_at_many_cuts_equal_the_signals_at_each(spark, cfg):
    ctx = small(spark, cfg)
    points = pn.at_dates(ctx.roles.accounts.select("account_id"), CUTS, "cut_date")
    got = defaultdict(dict)
    for x in pn.signals_at(ctx, points, CUTS).collect():
        got[x["cut_date"]][x["account_id"]] = x
    for cut in CUTS:
        for x in rk.risk_signals(ctx, ctx.roles.accounts.select("account_id"), cut).collect():
            y = got[cut][x["account_id"]]
            assert all(y[c] == (x[c] if x[c] is None else pytest.approx(x[c], rel=1e-12)) for c in x.asDict() if c != "account_id")


@pytest.mark.parametrize("mode", ["final", "as_of"])
def test_sweep_equals_the_back_tests_one_by_one(spark, cfg, mode):
    ctx = small(spark, cfg)
    got = defaultdict(set)
    for x in rk.backtest_sweep(ctx, CUTS, mode).collect():
        got[x["cut_date"]].add((x["risk_level"], x["accounts"], x["churned"], x["churn_pct"], x["lift"]))
    for cut in CUTS:
        assert got[cut] == {tuple(x) for x in rk.backtest_lift(ctx, cut, mode).collect()}


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


def test_twelve_cuts_are_the_same_plan_and_writes_as_one(spark, cfg, tmp_path, monkeypatch):
    from churnlens.plans import context as ctx_mod

    written = []
    write = ctx_mod.materialize_at
    monkeypatch.setattr(ctx_mod, "materialize_at", lambda df: written.append(1) or write(df))
    ctx = small(spark, cfg.with_(materialize=True))
    usage = tmp_path / "usage"
    ctx.roles.usage.write.parquet(str(usage))
    ctx.roles = type(ctx.roles)(**{**ctx.roles.as_dict(), "usage": spark.read.parquet(str(usage))})
    _ = ctx.state
    plans, writes = [], []
    for n in (1, 8):
        written.clear()
        points = pn.at_dates(ctx.roles.accounts.select("account_id"), CUTS[:n], "cut_date")
        signals = pn.signals_at(ctx, points, CUTS[:n])
        plan = signals._jdf.queryExecution().executedPlan().toString()
        plans.append((exchanges(signals), plan.count("FileScan parquet")))
        rk.backtest_sweep(ctx, CUTS[:n]).collect()
        writes.append(len(written))
    assert plans[0] == plans[1] and plans[0][1] == 1 and writes[0] == writes[1]
    ctx.release(spark)


def plain_weight(seed, i):
    u = int(hashlib.md5(f"{seed}|{i}".encode()).hexdigest()[:7], 16) / 2**28
    return next(k for k in range(13) if k == 12 or u < sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)))


def test_poisson_weights(spark):
    rows = spark.range(4000).select("id", *[poisson_weight("id", F.lit(s)).alias(f"w{s}") for s in (1, 2)]).collect()
    for s in (1, 2):
        w = [r[f"w{s}"] for r in rows]
        assert w == [plain_weight(s, r["id"]) for r in rows]
        assert abs(statistics.mean(w) - 1) < 0.06 and abs(statistics.variance(w) - 1) < 0.12
    assert sum(r["w1"] != r["w2"] for r in rows) > 2000


def test_replicates_do_not_depend_on_partitions(spark):
    df = spark.range(200).withColumn("x", F.col("id") * 2)
    one = sorted(replicates(df.coalesce(1), "id", [5, 9]).collect())
    assert one == sorted(replicates(df.repartition(9), "id", [9, 5]).collect())
    assert {(r["seed"], r["id"]): r["weight"] for r in one} == {(s, i): plain_weight(s, i) for s in (5, 9) for i in range(200) if plain_weight(s, i)}


def test_lift_over_seeds_equals_plain_replicates(spark, cfg):
    ctx = small(spark, cfg)
    cuts, seeds = CUTS[:3], range(6)
    lifts = defaultdict(list)
    panel = rk.panel.backtest_panel(ctx, cuts).withColumn("level", rk.risk_level(F.col("total_points"), cfg)).collect()
    for cut in cuts:
        for s in seeds:
            n, gone = defaultdict(int), defaultdict(int)
            for x in panel:
                if x["cut_date"] == cut:
                    for key in (x["level"], None):
                        n[key] += plain_weight(s, x["account_id"])
                        gone[key] += plain_weight(s, x["account_id"]) * x["outcome"]
            for level in set(n) - {None}:
                if n[level] and gone[None]:
                    lifts[level].append((gone[level] / n[level]) / (gone[None] / n[None]))
    rows = {x["risk_level"]: x for x in rk.lift_over_seeds(ctx, cuts, seeds).collect()}
    assert set(rows) == set(lifts)
    for level, x in rows.items():
        assert x["replicates"] == len(lifts[level]) and x["mean_lift"] == pytest.approx(statistics.mean(lifts[level]), abs=1e-9)
        assert len(lifts[level]) < 2 or x["sd_lift"] == pytest.approx(statistics.stdev(lifts[level]), abs=1e-9)
    again = {x["risk_level"]: x for x in rk.lift_over_seeds(small(spark, cfg), cuts, seeds).collect()}
    assert again == rows
