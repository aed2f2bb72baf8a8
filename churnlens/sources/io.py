"""Sources and sinks: CSV scan with declared schemas, text-date parsing audit, gated ordered load,
published marts.

* ``read_role_csv`` / ``read_roles_csv`` (S1, S2) - header CSV with the role's
  ``StructType`` (never ``inferSchema``); ``FAILFAST`` by default, so a
  malformed row stops the load instead of turning into NULLs.
* ``date_parse_audit`` (S3) - how many non-empty texts fail to parse.
* ``write_roles`` (S4) - parents before children, each table checked first
  (key uniqueness, foreign keys, constraints) and appended with its declared
  schema; facts partitioned by month so trailing windows prune partitions.  A
  batch is published by one manifest commit: readers see all of it or nothing.
* ``write_by_account`` - the roles as tables bucketed by account, so that the
  facts are grouped and joined by account without an exchange.
* ``write_marts`` (S7) - the account mart, the monthly flow and the
  recommendation list as parquet for the BI layer, all of one version;
  ``mart_views`` (S6) publishes a version as views.
"""

from __future__ import annotations

import uuid
from collections.abc import Collection
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import quality as qa
from .manifest import Store, Version
from .schemas import CONTRACTS, LOAD_ORDER, schema

# Month partition column per fact role.
MONTH_PARTITION = {"usage": "usage_date", "tickets": "submitted_at"}
DEFAULT_FILES = {r: f"{r}.csv" for r in LOAD_ORDER}


def read_role_csv(spark: SparkSession, path: str, role: str, id_type: T.DataType = T.StringType(),
                  strict: bool = True) -> DataFrame:
    """S1 - one role from a header CSV: columns are found by their header names, in any order, and cast
    to the declared types (dates ``yyyy-MM-dd``, timestamps ``yyyy-MM-dd HH:mm:ss``, booleans
    ``True``/``False``).

    A missing column is refused; other columns are ignored.  A usage file may lack ``account_id``,
    which :func:`denormalise_usage` fills.  ``strict=False`` turns values that do not parse into NULL
    (count them first with :func:`date_parse_audit`), else reading them fails.
    """
    raw = spark.read.option("header", True).option("emptyValue", None).csv(path)
    fields = schema(role, id_type).fields
    missing = [x.name for x in fields if x.name not in raw.columns and (role, x.name) != ("usage", "account_id")]
    if missing:
        raise LoadCheckFailed(f"{path}: no column {', '.join(missing)} in the header")
    out = []
    for x in fields:
        if x.name not in raw.columns:
            c = F.lit(None).cast(x.dataType)
        elif isinstance(x.dataType, T.DateType):
            c = parse_date(F.col(x.name), strict)
        else:
            c = F.col(x.name).cast(x.dataType) if strict else F.col(x.name).try_cast(x.dataType)
        out.append(c.alias(x.name))
    return raw.select(*out)


def denormalise_usage(usage: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Usage with the account of its subscription (NULL for an unknown one), column order kept."""
    owner = subscriptions.select("subscription_id", F.col("account_id").alias("_owner"))
    return usage.join(owner, "subscription_id", "left").select(
        *[F.coalesce("account_id", "_owner").alias(c) if c == "account_id" else F.col(c) for c in usage.columns]
    )


def read_roles_csv(spark: SparkSession, folder: str, files: dict[str, str] | None = None,
                   id_type: T.DataType = T.StringType()) -> dict[str, DataFrame]:
    """S1 fan-out: every role present in ``files`` (default ``<role>.csv``) read from ``folder``."""
    files = files or DEFAULT_FILES
    out = {role: read_role_csv(spark, f"{folder}/{name}", role, id_type) for role, name in files.items()}
    if "usage" in out and "subscriptions" in out:
        out["usage"] = denormalise_usage(out["usage"], out["subscriptions"])
    return out


def date_parse_audit(df: DataFrame, cols: list[str], fmt: str = "yyyy-MM-dd") -> DataFrame:
    """S3 - per text column: non-empty values and values that do not parse with ``fmt``."""
    aggs = []
    for c in cols:
        txt = F.col(c).cast("string")
        bad = txt.isNotNull() & (F.trim(txt) != "") & F.try_to_timestamp(txt, F.lit(fmt)).isNull()
        aggs += [F.count_if(txt.isNotNull() & (F.trim(txt) != "")).alias(f"_n_{c}"), F.count_if(bad).alias(f"_b_{c}")]
    agg = df.agg(*aggs)
    body = ", ".join(f"'{c}', _n_{c}, _b_{c}" for c in cols)
    return agg.select(F.expr(f"stack({len(cols)}, {body}) as (column_name, non_empty, unparseable)"))


def parse_date(c: Column, strict: bool = True, fmt: str = "yyyy-MM-dd") -> Column:
    """S3 - text to ``DateType``; unparseable text fails, or is NULL if not ``strict``."""
    text = F.nullif(F.trim(c), F.lit(""))
    return F.to_date(text, fmt) if strict else F.to_date(F.try_to_timestamp(text, F.lit(fmt)))


class LoadCheckFailed(RuntimeError):
    pass


def check_before_load(tables: dict[str, DataFrame], stored: dict[str, DataFrame] | None = None) -> DataFrame:
    """Violations that would have been rejected by the declared keys, foreign keys and constraints.

    Keys are checked over stored and new rows together, and a foreign key's parents are the stored
    and the new ones.  Returns (table_name, check, violations); the caller decides.
    """
    stored = stored or {}
    rows = []

    def everything(role: str, cols: list[str]) -> DataFrame | None:
        frames = [x[role].select(*cols) for x in (stored, tables) if role in x]
        return frames[0].unionByName(frames[1]) if len(frames) == 2 else frames[0] if frames else None

    for role, df in tables.items():
        c = CONTRACTS[role]
        if c.key:
            u = qa.key_uniqueness(everything(role, list(c.key)), role, list(c.key))
            rows.append(u.select("table_name", F.lit("primary_key").alias("check"),
                                 F.col("duplicated_keys").alias("violations")))
        v = qa.domain_violations(df, c)
        rows.append(v.select("table_name", F.col("constraint_name").alias("check"), "violations"))
        for col, parent, pcol in c.foreign_keys:
            parents = everything(parent, [pcol])
            orphans = qa.fk_orphans(df, parents, col, pcol) if parents is not None else df.where(F.col(col).isNotNull())
            n = orphans.agg(F.count(F.lit(1)).alias("violations"))
            rows.append(n.select(F.lit(role).alias("table_name"), F.lit(f"foreign_key:{col}").alias("check"), "violations"))
    return reduce(lambda a, b: a.unionByName(b), rows)


def write_roles(tables: dict[str, DataFrame], out_dir: str, batch: str | None = None, check: bool = True,
                id_type: T.DataType = T.StringType(), known: Collection[tuple[str, str]] = ()) -> DataFrame:
    """S4 - add one batch to the stored roles in dependency order (parents first), keeping the declared schema.

    With ``check=True`` the load is refused when any key, foreign-key or constraint violation is
    found (what the database would have rejected), over the stored and the new rows; ``known`` names the
    (table, check) pairs whose violations the source is known for, which are loaded.  Every table is written
    to a folder of its own and reconciled there; only then one manifest commit publishes them together
    (:mod:`churnlens.sources.manifest`).  Until then, and after a failure anywhere before, readers see the version
    before.  Writing a batch again (a retry) replaces it.  Fact roles are partitioned by month; the
    rebalance hint sizes their files, splitting large months and joining small ones.  Returns the
    reconciliation report: rows of the batch against rows added.
    """
    spark = next(iter(tables.values())).sparkSession
    batch = batch or uuid.uuid4().hex
    store = Store(spark, out_dir)
    version = store.current()
    others = Version(version.number, {r: {b: p for b, p in parts.items() if b != batch} for r, parts in version.tables.items()})
    if check:
        stored = {r: x for r in LOAD_ORDER if (x := store.read(r, others)) is not None}
        found = check_before_load(tables, stored).where(F.col("violations") > 0).collect()  # a few report rows
        bad = [r for r in found if (r["table_name"], r["check"]) not in known]
        if bad:
            raise LoadCheckFailed("; ".join(f"{r['table_name']} {r['check']}: {r['violations']}" for r in bad))
    staged = {}
    for role in [r for r in LOAD_ORDER if r in tables]:
        df = _declared(tables[role], role, id_type)
        if role in MONTH_PARTITION:
            df = df.withColumn("month", F.date_format(F.col(MONTH_PARTITION[role]), "yyyy-MM")).hint("rebalance", "month")
            staged[role] = store.stage(role, df, ["month"])
        else:
            staged[role] = store.stage(role, df)
    loaded = {r: spark.read.parquet(f"{store.folder}/{p}") for r, p in staged.items()}
    expected = {r: tables[r].agg(F.count(F.lit(1)).alias("n")).scalar() for r in staged}
    report = qa.load_reconcile(loaded, expected)
    short = [r["table_name"] for r in report.collect() if r["status"] != "OK"]
    if short:
        raise LoadCheckFailed(f"not all rows arrived: {', '.join(short)}")
    store.commit(version.with_parts({r: {batch: p} for r, p in staged.items()}))
    return report


def _declared(df: DataFrame, role: str, id_type: T.DataType) -> DataFrame:
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema(role, id_type).fields])


def read_roles_parquet(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The roles of the version published by :func:`write_roles`.  Fact roles keep their ``month`` partition
    column, which :func:`churnlens.operators.windows.window_at_date` uses for partition pruning."""
    store = Store(spark, folder)
    version = store.current()
    return {r: x for r in LOAD_ORDER if (x := store.read(r, version)) is not None}


def write_by_account(tables: dict[str, DataFrame], prefix: str, n_buckets: int, id_type: T.DataType = T.StringType()) -> None:
    """The roles as catalog tables ``{prefix}{role}``, hashed by account into ``n_buckets`` sorted buckets.

    Usage is stored with its account (joined from the contracts here, once, where it has none).  Grouping or
    joining a fact by account then reads each bucket in place: no exchange of the facts, whatever their
    size.  ``n_buckets`` fixes the tasks of such a stage, so take a bucket of a few hundred MB.
    """
    todo = dict(tables)
    if "usage" in todo and "subscriptions" in todo:
        todo["usage"] = denormalise_usage(todo["usage"], todo["subscriptions"])
    for role in [r for r in LOAD_ORDER if r in todo]:
        df = _declared(todo[role], role, id_type).repartition(n_buckets, "account_id")
        df.write.mode("overwrite").format("parquet").bucketBy(n_buckets, "account_id").sortBy("account_id").saveAsTable(f"{prefix}{role}")


def read_by_account(spark: SparkSession, prefix: str) -> dict[str, DataFrame]:
    """The roles stored by :func:`write_by_account`."""
    return {r: spark.table(f"{prefix}{r}") for r in LOAD_ORDER}


def write_marts(marts: dict[str, DataFrame], out_dir: str) -> Version:
    """S7 - publish the marts (e.g. account_mart, monthly_flow, recommendations) as parquet, together.

    Each goes to a new folder; one manifest commit makes them the published version.  Marts that are not given
    stay as the version before had them.  Files of versions before the last two are deleted.
    """
    store = Store(next(iter(marts.values())).sparkSession, out_dir)
    version = store.current()
    parts = {name: {"": store.stage(name, df)} for name, df in marts.items()}
    out = store.commit(version.with_parts(parts))
    store.vacuum()
    return out


def read_marts(spark: SparkSession, folder: str, number: int | None = None) -> dict[str, DataFrame]:
    """All marts of one version (the published one, or ``number`` while it is kept)."""
    store = Store(spark, folder)
    version = store.current() if number is None else store.version(number)
    return {name: store.read(name, version) for name in sorted(version.tables)}


def mart_views(spark: SparkSession, folder: str, prefix: str = "", number: int | None = None) -> list[str]:
    """S6 - the marts of one version as temporary views, replaced if they exist."""
    marts = read_marts(spark, folder, number)
    for name, df in marts.items():
        df.createOrReplaceTempView(prefix + name)
    return [prefix + name for name in marts]
