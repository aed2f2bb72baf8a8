import random

import pytest
from pyspark.sql import functions as F

from fixtures import account, frame, sub, use

from churnlens.config import ChurnConfig
from churnlens.operators import quality as qa
from churnlens.plans import recommend as rc
from churnlens.sources.schemas import CONTRACTS


def _priority(spark, rows):
    return spark.createDataFrame(rows, "account_id long, risk_level string, arr decimal(12,2), action string")


def _brute_force(priority, used, gaps, k):
    """accounts x eligible features, minus used, top k by (gap desc, name)."""
    out = {}
    for acc, level, arr, action in priority:
        if action == "4. No action":
            continue
        cands = [(-g, f) for f, g in gaps.items() if (acc, f) not in used]
        out[acc] = [f for _, f in sorted(cands)[:k]]
    return out


def test_recommender_matches_brute_force(spark):
    rnd = random.Random(11)
    feats = [f"F{i:02d}" for i in range(12)]
    levels = ["High", "Medium", "Low"]
    actions = {"High": "1. Direct intervention", "Medium": "3. Automated campaign", "Low": "4. No action"}
    prio_rows, used = [], set()
    for acc in range(1, 61):
        lvl = rnd.choice(levels)
        prio_rows.append((acc, lvl, None, actions[lvl]))
        p = 0.8 if lvl == "Low" else 0.3
        for f in feats:
            if rnd.random() < p or (acc % 7 == 0):  # every 7th account used everything
                used.add((acc, f))
    priority = _priority(spark, prio_rows)
    used_df = spark.createDataFrame(sorted(used), "account_id long, feature_name string")
    cfg = ChurnConfig(gap_threshold=5.0, top_k=3, materialize=False)
    gaps_df = rc.adoption_gap(priority, used_df, cfg)
    gaps = {r["feature_name"]: r["_gap100"] for r in gaps_df.collect()}
    assert gaps, "fixture should leave some eligible features"
    recs = rc.recommend_features(priority, used_df, cfg).collect()
    got = {}
    for r in sorted(recs, key=lambda r: (r["account_id"], r["rank"])):
        got.setdefault(r["account_id"], []).append(r["feature_name"])
        assert (r["account_id"], r["feature_name"]) not in used
    expect = {a: v for a, v in _brute_force(prio_rows, used, gaps, 3).items() if v}
    assert got == expect
    assert all(len(v) <= 3 for v in got.values())


def test_gap_threshold_is_strict_and_rounded(spark):
    # healthy: 3 accounts, 2 use F1 -> 66.67 %; risk: 3 accounts, 1 uses F1 -> 33.33 %; gap 33.34
    priority = _priority(spark, [(1, "Low", None, "4. No action"), (2, "Low", None, "4. No action"),
                                 (3, "Low", None, "4. No action"), (4, "High", None, "x"), (5, "High", None, "x"),
                                 (6, "High", None, "x")])
    used = spark.createDataFrame([(1, "F1"), (2, "F1"), (4, "F1")], "account_id long, feature_name string")
    rows = rc.adoption_gap(priority, used, ChurnConfig(gap_threshold=33.34)).collect()
    assert rows == []  # equal to the threshold: out
    rows = rc.adoption_gap(priority, used, ChurnConfig(gap_threshold=33.33)).collect()
    assert [(r["feature_name"], r["adoption_healthy"], r["adoption_risk"]) for r in rows] == [("F1", 66.67, 33.33)]


def test_quality_operators_find_planted_defects(spark):
    usage = frame(spark, "usage", [use(1, "2024-01-01", uid="u1"), use(1, "2024-01-02", uid="u1"),
                                   use(2, "2024-01-03", uid="u1"), use(3, "2024-01-04", uid="u2", count=-1)])
    dups = qa.duplicate_rows(usage, ["usage_id"]).collect()
    assert len(dups) == 3 and {r["usage_id"] for r in dups} == {"u1"}
    subs = frame(spark, "subscriptions", [sub(1, 1, "2024-01-01"), sub(9, 99, "2024-01-01")])
    accts = frame(spark, "accounts", [account(1), {**account(2), "industry": "Retail", "seats": None}])
    orphans = qa.fk_orphans(subs, accts, "account_id", "account_id").collect()
    assert [r["subscription_id"] for r in orphans] == [9]
    v = {r["constraint_name"]: r["violations"] for r in qa.domain_violations(accts, CONTRACTS["accounts"]).collect()}
    assert v["domain:industry"] == 1 and v["not_null:seats"] == 1 and v["domain:plan_tier"] == 0
    u = {r["constraint_name"]: r["violations"] for r in qa.domain_violations(usage, CONTRACTS["usage"]).collect()}
    assert u["non_negative:usage_count"] == 1
    without = qa.parents_without_children(subs, usage, "subscription_id").collect()
    assert {r["subscription_id"] for r in without} == {9}
    ks = qa.key_set_compare(spark.createDataFrame([(1,), (2,)], "k long"), spark.createDataFrame([(2,), (3,), (4,)], "k long"), "k").collect()[0]
    assert (ks["only_a"], ks["only_b"], ks["both"]) == (1, 2, 1)


def test_profiles(spark):
    df = spark.createDataFrame([(1, "a", True), (2, "b", False), (2, "b", None), (None, "c", True)],
                               "x int, s string, f boolean")
    prof = {r["column_name"]: r for r in qa.profile_schema(df, "t").collect()}
    assert prof["x"]["nulls"] == 1 and prof["f"]["non_null"] == 3 and prof["s"]["rows"] == 4
    num = qa.profile_numeric(df, "t", ["x"]).collect()[0]
    assert (num["count"], num["min"], num["p50"], num["max"]) == (3, 1.0, 2.0, 2.0)
    txt = qa.profile_text(df, "t", ["s"]).collect()[0]
    assert (txt["unique"], txt["top"], txt["freq"]) == (3, "b", 2)
    flg = qa.profile_flags(df, "t", ["f"]).collect()[0]
    assert (flg["rows"], flg["n_true"]) == (3, 2)
    rec = qa.load_reconcile({"t": df}, {"t": 4}).collect()[0]
    assert rec["status"] == "OK"
    assert F is not None


def test_presentation_rounds_and_orders(spark):
    from churnlens.plans.presentation import present

    df = spark.createDataFrame([("Low", 10, 1, 1.005, 0.5), ("High", 3, 2, 66.666, 2.349), ("Medium", 5, 1, 20.0, 1.0)],
                               "risk_level string, accounts long, churned long, churn_pct double, lift double")
    rows = present("backtest_lift", df).collect()
    assert [r["risk_level"] for r in rows] == ["High", "Medium", "Low"]
    assert rows[0]["churn_pct"] == 66.67 and rows[0]["lift"] == 2.35 and rows[2]["churn_pct"] == 1.01


def test_text_profile_holds_every_id_column():
    from churnlens.plans.checks import TEXT
    from churnlens.sources.schemas import schema

    ids = {role: {c for c in schema(role).fieldNames() if c.endswith("_id")} for role in CONTRACTS}
    assert ids["usage"] == {"usage_id", "subscription_id", "account_id"}
    assert all(ids[role] <= set(TEXT[role]) for role in ids)


def test_text_profile_counts_ids(spark):
    from types import SimpleNamespace

    from churnlens.plans.checks import TEXT, profile_text

    tables = {role: spark.createDataFrame([tuple(v if c.endswith("_id") else "x" for c in cols) for v in ("1", "2", "2")], cols) for role, cols in TEXT.items()}
    ctx = SimpleNamespace(roles=SimpleNamespace(as_dict=lambda: tables))
    got = {(r["table_name"], r["column_name"]): (r["count"], r["unique"], r["top"], r["freq"]) for r in profile_text(ctx).collect()}
    assert got[("usage", "subscription_id")] == (3, 2, "2", 2)
    assert got[("tickets", "ticket_id")] == got[("churn_events", "churn_event_id")] == (3, 2, "2", 2)


def test_accounts_without_usage_and_usage_without_account(spark):
    priority = _priority(spark, [(1, "Low", None, "4. No action"), (2, "Low", None, "4. No action"), (3, "High", None, "x"), (4, "Medium", None, "y")])
    usage = spark.createDataFrame([(1, "F1"), (1, "F1"), (2, "F1"), (2, "F2"), (9, "F3"), (None, "F4"), (4, "F2")], "account_id long, feature_name string")
    used = rc.used_features(usage)
    rows = {r["feature_name"]: r for r in rc.feature_counts(rc.with_features(priority, used)).collect()}
    assert {f: (r["n_healthy"], r["n_risk"]) for f, r in rows.items()} == {None: (2, 2), "F1": (2, 0), "F2": (1, 1), "F3": (0, 0), "F4": (0, 0)}
    (t,) = rc.breadth_gap_threshold(priority, used).collect()
    assert (t["mean_breadth_healthy"], t["mean_breadth_risk"], t["n_features"], t["threshold"]) == (1.5, 0.5, 4, 25.0)
    cfg = ChurnConfig(gap_threshold=-1.0, top_k=2)
    got = {(r["account_id"], r["rank"]): (r["feature_name"], r["adoption_healthy"]) for r in rc.recommend_features(priority, used, cfg).collect()}
    assert got == {(3, 1): ("F1", 100.0), (3, 2): ("F2", 50.0), (4, 1): ("F1", 100.0)}
    assert rc.recommend_features(priority, used.where("false"), cfg).collect() == []


def test_recommender_reads_priority_and_usage_once(spark, tmp_path):
    priority = _priority(spark, [(i, ["Low", "High"][i % 2], None, ["4. No action", "x"][i % 2]) for i in range(20)])
    usage = spark.createDataFrame([(i % 20, f"F{i % 7}") for i in range(200) if i % 3], "account_id long, feature_name string")
    priority.write.parquet(str(tmp_path / "p"))
    usage.write.parquet(str(tmp_path / "u"))
    portfolio = rc.with_features(spark.read.parquet(str(tmp_path / "p")), rc.used_features(spark.read.parquet(str(tmp_path / "u"))))
    plan = rc.feature_counts(portfolio)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 2
    rec = rc.recommend(portfolio, rc.feature_counts(portfolio), ChurnConfig(gap_threshold=1.0))
    main = rec._jdf.queryExecution().executedPlan().toString().split("Subquery")[0]
    assert "Window" not in main and "LeftAnti" not in main


def test_two_proportion_test(spark):
    from math import sqrt

    from churnlens.plans.extras import proportion_difference

    rows = [(1, i < 30, None if i % 2 else True, None) for i in range(80)] + [(0, i < 20, i % 3 == 0, True) for i in range(120)]
    df = spark.createDataFrame(rows, "g int, a boolean, b boolean, c boolean")
    got = {r["metric"]: r for r in proportion_difference(df, "g", ["a", "b", "c"]).collect()}
    p = 50 / 200
    assert (got["a"]["n_1"], got["a"]["mean_1"], got["a"]["n_0"], got["a"]["significant"]) == (80, 0.375, 120, 1)
    assert abs(got["a"]["margin"] - 1.96 * sqrt(p * (1 - p) * (1 / 80 + 1 / 120))) < 1e-9
    assert (got["b"]["n_1"], got["b"]["mean_1"], got["b"]["n_0"]) == (40, 1.0, 120)
    assert (got["c"]["n_1"], got["c"]["mean_1"], got["c"]["margin"], got["c"]["significant"]) == (0, None, None, None)


@pytest.mark.parametrize("profile,value", [(qa.profile_numeric_many, "cast(id as double)"), (qa.profile_dates_many, "date_add(date'2024-01-01', cast(id as int))")])
def test_profiles_build_their_tables_once(spark, monkeypatch, profile, value):
    """Brackets are sketched again and again, but what a table is built from runs once."""
    monkeypatch.setattr(qa.bracketed_quantiles, "__defaults__", (500, 4000))
    built = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            built.add(b.num_rows)
            yield b

    df = spark.range(5000).select(F.expr(value).alias("a b"), F.expr(f"if(id = 7, null, {value})").alias("v"))
    df = df.mapInArrow(count, df.schema)
    got = {r["column_name"]: tuple(r)[2:] for r in profile([("t", df, ["a b", "v"])]).collect()}
    assert built.value == 5000
    assert got["a b"][0] == 5000 and got["v"][0] == 4999
    first, last = got["a b"][-5], got["a b"][-1]
    assert last - first == 4999 and got["a b"][-3] == first + 2499.5
    assert got["v"][-3] == first + 2500
