import datetime as dt
import os
import tempfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fixtures import account, context, event, frame, sub

from churnlens.plans.state import churn_state
from churnlens.sources import io
from churnlens.sources.schemas import schema

SAMPLE_CSV = """churn_event_id,account_id,churn_date,reason_code,refund_amount_usd,preceding_upgrade_flag,preceding_downgrade_flag,is_reactivation,feedback_text
E-1,A-1,2024-01-05,pricing,10.5,False,True,False,too expensive
E-2,A-1,2024-03-01,support,0.0,False,False,True,
E-3,A-2,2024-02-10,features,0.0,True,False,False,missing features
"""


def test_csv_reader_with_declared_schema(spark):
    d = tempfile.mkdtemp(prefix="churnlens-csv-")
    with open(os.path.join(d, "churn_events.csv"), "w") as fh:
        fh.write(SAMPLE_CSV)
    df = io.read_role_csv(spark, os.path.join(d, "churn_events.csv"), "churn_events")
    # file sources report every column as nullable; names and types are the contract
    assert [(f.name, f.dataType) for f in df.schema] == [(f.name, f.dataType) for f in schema("churn_events")]
    rows = {r["churn_event_id"]: r for r in df.collect()}
    assert rows["E-2"]["is_reactivation"] is True and rows["E-2"]["feedback_text"] is None
    assert float(rows["E-1"]["refund_amount_usd"]) == 10.5
    audit = io.date_parse_audit(spark.createDataFrame([("2024-01-01",), ("31/01/2024",), ("",)], "d string"), ["d"])
    r = audit.collect()[0]
    assert (r["non_empty"], r["unparseable"]) == (2, 1)


def test_columns_are_found_by_name(spark):
    d = tempfile.mkdtemp(prefix="churnlens-csv-")
    head, *rows = SAMPLE_CSV.strip().split("\n")
    names = head.split(",")
    order = [1, 0, *range(2, len(names))]
    with open(os.path.join(d, "x.csv"), "w") as fh:
        fh.write("\n".join(",".join(r.split(",")[k] for k in order) for r in [head, *rows]))
    got = io.read_role_csv(spark, os.path.join(d, "x.csv"), "churn_events").collect()
    assert {(r["churn_event_id"], r["account_id"]) for r in got} == {("E-1", "A-1"), ("E-2", "A-1"), ("E-3", "A-2")}
    with open(os.path.join(d, "y.csv"), "w") as fh:
        fh.write(SAMPLE_CSV.replace("reason_code", "reason"))
    with pytest.raises(io.LoadCheckFailed, match="reason_code"):
        io.read_role_csv(spark, os.path.join(d, "y.csv"), "churn_events")


def test_unparseable_dates(spark):
    df = spark.createDataFrame([("2024-01-01",), ("31/01/2024",), (" ",)], "d string")
    assert [r[0] for r in df.select(io.parse_date(F.col("d"), strict=False)).collect()] == [dt.date(2024, 1, 1), None, None]
    with pytest.raises(Exception, match="31/01/2024"):
        df.select(io.parse_date(F.col("d"))).collect()


def test_usage_file_without_account(spark):
    d = tempfile.mkdtemp(prefix="churnlens-csv-")
    with open(os.path.join(d, "usage.csv"), "w") as fh:
        fh.write("usage_id,subscription_id,usage_date,feature_name,usage_count,usage_duration_secs,error_count,is_beta_feature\n"
                 "U-1,S-1,2024-01-05,F01,3,60,0,False\nU-2,S-9,2024-01-06,F02,1,10,1,True\n")
    usage = io.read_role_csv(spark, os.path.join(d, "usage.csv"), "usage")
    subs = spark.createDataFrame([("S-1", "A-1")], "subscription_id string, account_id string")
    got = {r["usage_id"]: r["account_id"] for r in io.denormalise_usage(usage, subs).collect()}
    assert got == {"U-1": "A-1", "U-2": None}


def test_golden_values_of_a_published_log_shape(spark):
    """Counts worked out by hand on a log with reactivations, two events on a day and equal dates."""

    log = [event(1, 1, "2024-01-05", reason="pricing"), event(2, 1, "2024-03-01", reactivation=True),
           event(3, 2, "2024-02-10", reason="features"), event(4, 3, "2024-02-10", reactivation=True),
           event(5, 3, "2024-02-10", reason="support"), event(6, 4, "2024-05-01", reason="budget"),
           event(7, 4, "2024-05-01", reason="unknown")]
    accounts = frame(spark, "accounts", [account(k) for k in range(1, 6)])
    st = {r["account_id"]: r for r in churn_state(accounts, frame(spark, "churn_events", log)).collect()}
    # a churn wins over a reactivation of the same day, and the later event id wins over the earlier
    assert {k: (r["is_churned"], r["churn_reason"], r["n_events"]) for k, r in st.items()} == {
        1: (0, None, 2), 2: (1, "features", 1), 3: (1, "support", 2), 4: (1, "unknown", 2), 5: (0, None, 0)}

def test_write_roles_gated_and_reconciled(spark):
    out = tempfile.mkdtemp(prefix="churnlens-load-")
    accts = frame(spark, "accounts", [account(1), account(2)])
    subs = frame(spark, "subscriptions", [sub(10, 1, "2024-01-01"), sub(11, 2, "2024-02-01")])
    tables = {"accounts": accts, "subscriptions": subs}
    report = {r["table_name"]: r["status"] for r in io.write_roles(tables, out, id_type=T.LongType()).collect()}
    assert report == {"accounts": "OK", "subscriptions": "OK"}
    bad = {"accounts": accts, "subscriptions": frame(spark, "subscriptions", [sub(12, 99, "2024-01-01")])}
    with pytest.raises(io.LoadCheckFailed):
        io.write_roles(bad, tempfile.mkdtemp(prefix="churnlens-load-"), id_type=T.LongType())


def test_batches_are_gated_against_what_is_stored(spark):
    out = tempfile.mkdtemp(prefix="churnlens-load-")
    ids = T.LongType()

    def load(batch, **roles):
        report = io.write_roles({r: frame(spark, r, rows) for r, rows in roles.items()}, out, batch, id_type=ids)
        return {r["table_name"]: (r["expected"], r["loaded"], r["status"]) for r in report.collect()}

    first = {"accounts": [account(1), account(2)], "subscriptions": [sub(10, 1, "2024-01-01")]}
    assert load("a", **first) == {"accounts": (2, 2, "OK"), "subscriptions": (1, 1, "OK")}
    # a second batch whose parents were stored before
    assert load("b", subscriptions=[sub(11, 2, "2024-02-01")]) == {"subscriptions": (1, 1, "OK")}
    # a retry replaces its batch
    assert load("b", subscriptions=[sub(11, 2, "2024-02-01")]) == {"subscriptions": (1, 1, "OK")}
    for bad in ({"accounts": [account(1)]}, {"subscriptions": [sub(12, 99, "2024-03-01")]}):
        with pytest.raises(io.LoadCheckFailed):
            load("c", **bad)
    stored = io.read_roles_parquet(spark, out)
    assert stored["accounts"].count() == 2 and stored["subscriptions"].count() == 2
    with pytest.raises(io.LoadCheckFailed):  # no parent anywhere
        io.write_roles({"subscriptions": frame(spark, "subscriptions", [sub(1, 1, "2024-01-01")])}, tempfile.mkdtemp(), id_type=ids)


def test_batches_hold_accounts_that_have_no_contract_yet(spark, cfg):
    from churnlens.plans.catalog import QUERIES

    accounts = [account(1), account(2), account(3, signup=None), account(4, signup=None)]
    roles = dict(accounts=accounts, subscriptions=[sub(10, 1, "2024-01-01"), sub(11, 2, "2024-02-01")], churn_events=[event(5, 2, "2024-03-01")])
    got = sorted(tuple(r) for r in QUERIES["batch_load"](context(spark, cfg, **roles)).collect())
    assert got == [("accounts", 4, 4), ("churn_events", 1, 1), ("subscriptions", 2, 2)]
    # every other check still refuses the load, and so does this one where it is not named
    for bad in (dict(roles, accounts=[*accounts, dict(account(5), industry=None)]), dict(roles, subscriptions=[sub(10, 9, "2024-01-01")])):
        with pytest.raises(io.LoadCheckFailed):
            QUERIES["batch_load"](context(spark, cfg, **bad))
    with pytest.raises(io.LoadCheckFailed, match="signup_date"):
        io.write_roles({"accounts": frame(spark, "accounts", accounts)}, tempfile.mkdtemp(), id_type=T.LongType())


def test_stored_roles_give_the_same_answers(spark):
    """Load the adapter's roles once (S4), read them back month-partitioned, and analyse from storage."""
    from churnlens.config import TESTDATA_CONFIG
    from churnlens.plans.catalog import QUERIES
    from churnlens.plans.context import Context

    sf = "/root/testdata/sf0.001"
    if not os.path.exists(f"{sf}/orders.parquet"):
        pytest.skip("test tables not present")
    cfg = TESTDATA_CONFIG.with_(materialize=False)
    src = Context.from_testdata(spark, sf, cfg)
    out = tempfile.mkdtemp(prefix="churnlens-roles-")
    # the usage id is not unique in the source (a known defect kept on purpose): no PK gate for it
    report = io.write_roles(src.roles.as_dict(), out, check=False, id_type=T.LongType())
    assert {r["status"] for r in report.collect()} == {"OK"}
    stored = Context.from_parquet_roles(spark, out, cfg)
    for name in ("churn_state", "behaviour_before_churn", "support_before_churn", "risk_scores", "channel_risk"):
        a = sorted(tuple(r) for r in QUERIES[name](src).collect())
        b = sorted(tuple(r) for r in QUERIES[name](stored).collect())
        assert a == b, name


def test_materialize_and_release(spark):
    import os as _os

    from churnlens.session import materialize, release_materialized

    df = materialize(spark.range(10).withColumnRenamed("id", "x"))
    assert df.count() == 10
    path = df.inputFiles()[0]
    folder = path.rsplit("/", 1)[0].replace("file:", "")
    assert _os.path.exists(folder)
    assert release_materialized(spark, [folder]) == 1
    assert not _os.path.exists(folder)


def test_context_release_keeps_roles(spark, cfg):
    from churnlens.plans.context import Context

    ctx = context(spark, cfg.with_(materialize=True), accounts=[account(1)], churn_events=[event(1, 1, "2024-01-01")])
    assert ctx.state.count() == 1
    assert ctx.release(spark) == 1
    assert "state" not in ctx.__dict__ and ctx.roles is not None
    assert ctx.state.count() == 1  # rebuilt on demand
    assert isinstance(ctx, Context)


def test_release_leaves_no_table(spark):
    """Queries that rank over many buckets write through their context; releasing it leaves nothing."""
    from churnlens.config import TESTDATA_CONFIG
    from churnlens.plans.catalog import QUERIES
    from churnlens.plans.context import Context
    from churnlens.session import ensure_checkpoint_dir

    if not os.path.exists("/root/testdata/sf0.001/orders.parquet"):
        pytest.skip("test tables not present")
    folder = ensure_checkpoint_dir(spark).replace("file:", "")
    before = {x for x in os.listdir(folder) if x.startswith("churnlens-")}
    ctx = Context.from_testdata(spark, "/root/testdata/sf0.001", TESTDATA_CONFIG.with_(ntile_buckets=6))
    for name in ("recommend_features", "value_concentration", "profile_numeric"):
        QUERIES[name](ctx).collect()
    ctx.release(spark)
    assert {x for x in os.listdir(folder) if x.startswith("churnlens-")} == before


def test_only_a_local_session_gets_a_scratch_folder():
    from churnlens.session import ensure_checkpoint_dir

    class Session:
        class sparkContext:
            master = "spark://host:7077"
            getCheckpointDir = staticmethod(lambda: None)
            getConf = staticmethod(lambda: {})

        class conf:
            get = staticmethod(lambda name, default=None: default)

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(Session)


def test_orphan_items_are_reported(spark, tmp_path):
    """With orders removed, every item of theirs stays and is an orphan."""
    from churnlens.plans.catalog import QUERIES
    from churnlens.plans.context import Context

    sf = "/root/testdata/sf0.001"
    if not os.path.exists(f"{sf}/orders.parquet"):
        pytest.skip("test tables not present")
    for name in ("customer", "lineitem"):
        spark.read.parquet(f"{sf}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    orders.where("o_orderkey % 10 <> 0").write.parquet(f"{tmp_path}/orders.parquet")
    lost = spark.read.parquet(f"{sf}/lineitem.parquet").join(orders.where("o_orderkey % 10 = 0"), F.expr("l_orderkey = o_orderkey")).count()
    report = {(r["child_table"], r["column_name"]): r["orphans"] for r in QUERIES["fk_orphans"](Context.from_testdata(spark, str(tmp_path))).collect()}
    assert lost > 0 and report[("usage", "subscription_id")] == lost


@pytest.mark.parametrize("values", [[1e-4, 2e-4, 3e-4], [1e-10, 2e-10, 3e-10], [1e9 + 0.1, 1e9 + 0.2, 1e9 + 0.3], [1e17, 2e17, 4e17]])
def test_profile_numeric_keeps_digits(spark, values):
    import statistics

    from churnlens.operators.quality import profile_numeric

    (r,) = profile_numeric(spark.createDataFrame([(v,) for v in values], "x double"), "t", ["x"]).collect()
    assert r["mean"] == pytest.approx(statistics.fmean(values), rel=1e-10)
    assert r["std"] == pytest.approx(statistics.stdev(values), rel=1e-6)


def test_profile_numeric_reports_nan(spark):
    import math

    from churnlens.operators.quality import profile_numeric

    (r,) = profile_numeric(spark.createDataFrame([(float("nan"),), (1.0,)], "x double"), "t", ["x"]).collect()
    assert math.isnan(r["mean"]) and r["count"] == 2


def test_views_can_be_created_again(spark):
    from churnlens.config import TESTDATA_CONFIG
    from churnlens.plans.catalog import create_views
    from churnlens.plans.context import Context
    from churnlens.plans.presentation import present

    if not os.path.exists("/root/testdata/sf0.001/orders.parquet"):
        pytest.skip("test tables not present")
    ctx = Context.from_testdata(spark, "/root/testdata/sf0.001", TESTDATA_CONFIG)
    for _ in range(2):
        names = create_views(ctx, "churn_view_")
    got = spark.sql("SELECT s.account_id FROM churn_view_churn_state s JOIN churn_view_account_mart m USING (account_id)").count()
    assert got == ctx.state.count() and len(names) == 8
    dup = spark.createDataFrame([("b", 1), ("a", 2), ("b", 0)], "usage_id string, usage_date int").withColumn("feature_name", F.lit("x"))
    assert [tuple(r)[:2] for r in present("duplicate_rows", dup).collect()] == [("a", 2), ("b", 0), ("b", 1)]
