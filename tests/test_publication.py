"""Batches and marts are published whole or not at all; roles stored by account are grouped without an exchange."""

import os
import re

import pytest
from fixtures import account, context, event, frame, sub, ticket, use
from pyspark.sql import functions as F
from pyspark.sql import types as T

from churnlens.plans.catalog import QUERIES
from churnlens.plans.context import Context
from churnlens.sources import io
from churnlens.sources.manifest import CommitConflict, Store

IDS = T.LongType()


def batch(spark, n, first=0):
    accounts = frame(spark, "accounts", [account(first + i) for i in range(n)])
    return {"accounts": accounts, "subscriptions": frame(spark, "subscriptions", [sub(first + i, first + i, "2024-01-01") for i in range(n)])}


def counts(spark, folder):
    return {r: df.count() for r, df in io.read_roles_parquet(spark, folder).items()}


def test_a_failure_between_two_tables_shows_nothing_of_the_batch(spark, tmp_path, monkeypatch):
    out = str(tmp_path)
    io.write_roles(batch(spark, 3), out, "a", id_type=IDS)
    stage = Store.stage

    def fails(self, table, df, partition_by=()):
        if table == "subscriptions":
            raise OSError("lost")
        return stage(self, table, df, partition_by)

    monkeypatch.setattr(Store, "stage", fails)
    with pytest.raises(OSError):
        io.write_roles(batch(spark, 4, 10), out, "b", id_type=IDS)
    assert counts(spark, out) == {"accounts": 3, "subscriptions": 3}
    monkeypatch.setattr(Store, "stage", stage)
    io.write_roles(batch(spark, 4, 10), out, "b", id_type=IDS)
    assert counts(spark, out) == {"accounts": 7, "subscriptions": 7}
    io.write_roles(batch(spark, 2, 10), out, "b", id_type=IDS)  # a retry replaces its batch in all tables at once
    assert counts(spark, out) == {"accounts": 5, "subscriptions": 5}


def test_rows_that_did_not_arrive_stop_the_commit(spark, tmp_path, monkeypatch):
    stage = Store.stage
    monkeypatch.setattr(Store, "stage", lambda self, table, df, partition_by=(): stage(self, table, df.limit(1), partition_by))
    with pytest.raises(io.LoadCheckFailed, match="accounts"):
        io.write_roles(batch(spark, 3), str(tmp_path), id_type=IDS)
    assert counts(spark, str(tmp_path)) == {}


def test_two_writers_from_one_version(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    mine, theirs = store.current(), store.current()
    store.commit(theirs.with_parts({"t": {"": store.stage("t", spark.range(3))}}))
    with pytest.raises(CommitConflict):
        store.commit(mine.with_parts({"t": {"": store.stage("t", spark.range(5))}}))
    assert store.read("t").count() == 3 and store.current().number == 1
    assert [x for x in os.listdir(tmp_path / "_manifests") if not x.endswith((".json", ".crc"))] == []


def test_a_reader_during_a_rewrite_sees_one_version(spark, tmp_path):
    out = str(tmp_path)
    marts = lambda v: {"account_mart": spark.range(v * 10).withColumn("v", F.lit(v)), "monthly_flow": spark.range(v).withColumn("v", F.lit(v))}
    io.write_marts(marts(1), out)
    reader = io.read_marts(spark, out)
    assert io.mart_views(spark, out, "pub_") == ["pub_account_mart", "pub_monthly_flow"]
    store = Store(spark, out)
    half = store.stage("account_mart", marts(2)["account_mart"])  # a rewrite that is not done yet
    for seen in (reader, io.read_marts(spark, out)):
        assert {n: [r["v"] for r in df.select("v").distinct().collect()] for n, df in seen.items()} == {"account_mart": [1], "monthly_flow": [1]}
    store.commit(store.current().with_parts({"account_mart": {"": half}, "monthly_flow": {"": store.stage("monthly_flow", marts(2)["monthly_flow"])}}))
    assert {n: df.count() for n, df in io.read_marts(spark, out).items()} == {"account_mart": 20, "monthly_flow": 2}
    assert reader["account_mart"].count() == 10 and spark.sql("SELECT max(v) FROM pub_account_mart").first()[0] == 1
    io.write_marts({"account_mart": marts(3)["account_mart"]}, out)  # the other mart stays as it was
    assert {n: df.count() for n, df in io.read_marts(spark, out).items()} == {"account_mart": 30, "monthly_flow": 2}
    assert {n: df.count() for n, df in io.read_marts(spark, out, number=2).items()} == {"account_mart": 20, "monthly_flow": 2}
    assert len(os.listdir(tmp_path / "account_mart")) == 2  # the first version's files are gone
    io.mart_views(spark, out, "pub_")
    assert spark.sql("SELECT count(*) FROM pub_account_mart").first()[0] == 30


def test_published_marts_of_the_model(spark, cfg, tmp_path):
    ctx = context(spark, cfg.with_(gap_threshold=None), accounts=[account(i) for i in range(6)], churn_events=[event(1, 1, "2024-03-01")],
                  subscriptions=[sub(i, i, "2023-02-01", arr=100 * i) for i in range(6)], usage=[use(i, "2024-12-01", f"F{i}") for i in range(6)])
    marts = {n: QUERIES[n](ctx) for n in ("account_mart", "monthly_flow", "recommend_features")}
    io.write_marts(marts, str(tmp_path))
    for name, df in io.read_marts(spark, str(tmp_path)).items():
        assert sorted(map(str, df.collect())) == sorted(map(str, marts[name].select(df.columns).collect()))


def fact_exchanges(df, table):
    """Exchanges above the scan of ``table`` and below the first join, window or end of its branch."""
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = lambda s: len(re.match(r"[\s:|+*()\d-]*", s).group())
    found = []
    for k, line in enumerate(lines):
        if table in line and "Scan" in line:
            d, j = depth(line), k
            while j > 0 and not re.search("Join|Union", lines[j]):
                j -= 1
                if depth(lines[j]) < d:
                    d = depth(lines[j])
                    found.append(lines[j])
    return [x for x in found if "Exchange" in x]


def test_facts_stored_by_account_are_not_exchanged(spark, cfg, tmp_path):
    src = context(
        spark, cfg, accounts=[account(i) for i in range(12)], churn_events=[event(i, i, "2024-05-01") for i in range(4)],
        subscriptions=[sub(i, i, "2024-01-01") for i in range(12)],
        usage=[{**use(i % 12, f"2024-0{1 + i % 6}-1{i % 9}", f"F{i % 5}", uid=f"u{i}"), "account_id": None} for i in range(90)],
        tickets=[ticket(f"t{i}", i % 12, f"2024-04-1{i % 9} 10:00:00") for i in range(30)],
    )
    spark.sql(f"CREATE DATABASE buckets LOCATION '{tmp_path}/buckets'")
    io.write_by_account(src.roles.as_dict(), "buckets.", 4, id_type=IDS)
    try:
        usage = src.roles.usage.withColumn("account_id", F.col("subscription_id"))
        plain = Context(type(src.roles)(**{**src.roles.as_dict(), "usage": usage}), cfg)
        stored = Context.from_account_buckets(spark, "buckets.", cfg)
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        for name in ("trailing_usage", "own_baseline_trend", "usage_profile", "trailing_support"):
            out = QUERIES[name](stored)
            if name != "trailing_support":
                assert "buckets.usage" in out._jdf.queryExecution().executedPlan().toString()
                assert fact_exchanges(out, "buckets.usage") == [], name
            assert sorted(map(str, out.collect())) == sorted(map(str, QUERIES[name](plain).collect())), name
        spark.conf.set("spark.sql.sources.bucketing.enabled", "false")
        assert fact_exchanges(QUERIES["usage_profile"](Context.from_account_buckets(spark, "buckets.", cfg)), "buckets.usage") != []
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.sources.bucketing.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP DATABASE buckets CASCADE")
