"""Sources, sinks and presentation as queries over the roles: CSV round trip (S1), date audit (S3), batches
(S4), marts behind views (S6, S7), and the published orders as data (O1-O3, F10).

What they write goes to folders of the context below the shared checkpoint folder and is released with it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import RISK_LABELS
from ..functions.expr import field_order
from ..operators.quality import duplicate_rows
from ..operators.ranking import global_position
from ..session import scratch_folder
from ..sources import io
from .context import Context
from .diagnosis import reason_share
from .marts import account_mart, monthly_flow
from .risk import risk_level


def _as_text(df: DataFrame) -> list[Column]:
    """The columns as the source's files have them: flags as True / False, the rest as Spark writes it."""
    return [F.initcap(F.col(c).cast("string")).alias(c) if t == "boolean" else F.col(c) for c, t in df.dtypes]


def csv_round_trip(ctx: Context) -> DataFrame:
    """S1 - the churn events written as CSV files, columns in another order than declared, and read back by header name."""
    events = ctx.roles.churn_events
    folder = scratch_folder(events.sparkSession)
    events.select(*_as_text(events)[::-1]).write.option("header", True).csv(f"{folder}/churn_events.csv")
    ids = events.schema["churn_event_id"].dataType
    return io.read_roles_csv(events.sparkSession, folder, {"churn_events": "churn_events.csv"}, ids)["churn_events"]


def date_text_audit(ctx: Context) -> DataFrame:
    """S3 - contract dates as texts, some of them in another format, blank or missing: non-empty and unparseable per column."""
    s = ctx.roles.subscriptions
    k = F.col("subscription_id").cast("long")
    iso, local = F.date_format("start_date", "yyyy-MM-dd"), F.date_format("start_date", "dd/MM/yyyy")
    texts = s.select(
        F.when(k % 50 == 0, local).when(k % 50 == 1, F.lit(" ")).otherwise(iso).alias("start_text"),
        F.date_format("end_date", "yyyy-MM-dd").alias("end_text"),
    )
    return io.date_parse_audit(texts, ["start_text", "end_text"])


BATCH_ROLES = ("accounts", "subscriptions", "churn_events")
# An account signs up with its first contract, so one without contracts has no date yet; it is an account all the same.
KNOWN_VIOLATIONS = {("accounts", "not_null:signup_date")}


def batch_load(ctx: Context) -> DataFrame:
    """S4 - accounts, contracts and events loaded in two gated batches (odd accounts, then even ones, the second
    one twice), read through the manifest: rows and accounts per table."""
    roles = ctx.roles.as_dict()
    spark = roles["accounts"].sparkSession
    folder = scratch_folder(spark)
    ids = roles["accounts"].schema["account_id"].dataType
    for batch, rest in (("odd", 1), ("even", 0), ("even", 0)):
        part = {r: roles[r].where(F.col("account_id").cast("long") % 2 == rest) for r in BATCH_ROLES}
        io.write_roles(part, folder, batch, id_type=ids, known=KNOWN_VIOLATIONS)
    out = None
    for role, df in io.read_roles_parquet(spark, folder).items():
        row = df.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("account_id").alias("accounts")).select(F.lit(role).alias("table_name"), "rows", "accounts")
        out = row if out is None else out.unionByName(row)
    return out


def published_marts(ctx: Context) -> DataFrame:
    """S6, S7 - account mart and monthly flow published together, opened as views and read by SQL: accounts and value per status and month of leaving."""
    folder = scratch_folder(ctx.roles.accounts.sparkSession)
    marts = {
        "account_mart": account_mart(ctx.state, ctx.value, ctx.signals, ctx.scores, ctx.priority),
        "monthly_flow": monthly_flow(ctx.roles.accounts, ctx.state),
    }
    io.write_marts(marts, folder)
    spark = ctx.roles.accounts.sparkSession
    prefix = "published_" + folder.rsplit("-", 1)[1] + "_"
    io.mart_views(spark, folder, prefix)
    return spark.sql(f"""
        SELECT a.account_status, a.month, a.accounts, a.arr, f.churned
        FROM (SELECT account_status, date_format(churn_date, 'yyyy-MM-01') AS month, count(*) AS accounts, cast(sum(arr) AS double) AS arr
              FROM {prefix}account_mart GROUP BY 1, 2) a
        LEFT JOIN {prefix}monthly_flow f ON a.month = f.month""")


def duplicates_in_order(ctx: Context) -> DataFrame:
    """O3 - usage rows that share an id, numbered in the order of id, date and feature."""
    rows = duplicate_rows(ctx.roles.usage, ["usage_id"]).select("usage_id", "usage_date", "feature_name")
    return global_position(rows, ["usage_id", "usage_date", "feature_name"], n_buckets=ctx.cfg.ntile_buckets)


def risk_levels_in_order(ctx: Context) -> DataFrame:
    """O2, F10 - scored accounts per risk level, with the level's place in the order High, Medium, Low."""
    level = risk_level(F.col("total_points"), ctx.cfg)
    per = ctx.scores.groupBy(level.alias("risk_level")).agg(F.count(F.lit(1)).alias("accounts"))
    return per.select(field_order("risk_level", *RISK_LABELS).alias("position"), "risk_level", "accounts")


def reasons_in_order(ctx: Context) -> DataFrame:
    """O1 - churned accounts per reason, numbered by share, largest first (ties by reason)."""
    # a window over the reasons' rows, a handful
    order = Window.orderBy(F.col("churned").desc(), "churn_reason")
    return reason_share(ctx).withColumn("position", F.row_number().over(order))
