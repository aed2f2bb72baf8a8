"""Profiling and data-quality operators (schema/null profile, numeric/text/date/flag profiles,
duplicates, orphans, constraint violations, domains, parents without children, key-set
comparison, load reconciliation).

Each profile is one aggregation pass per table: per-column counts are
computed side by side in a single ``agg`` and unpivoted with ``stack``.
Exact quartiles take several passes, over columns that are written once.
Reports are small DataFrames (one row per column / constraint); nothing is
collected.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import significant
from ..session import materialize
from ..sources.schemas import Contract
from .ranking import bracketed_quantiles


def _union(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def profile_schema(df: DataFrame, table: str) -> DataFrame:
    """Q1/Q6 - per column: position, rows, non-null and null counts (one pass)."""
    cols = df.columns
    agg = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count(F.col(f"`{c}`")).alias(f"_nn{i}") for i, c in enumerate(cols)])
    kinds = dict(df.dtypes)
    body = ", ".join(f"'{c}', '{kinds[c]}', {i + 1}L, _nn{i}" for i, c in enumerate(cols))
    out = agg.select("_rows", F.expr(f"stack({len(cols)}, {body}) as (column_name, type, position, non_null)"))
    return out.select(
        F.lit(table).alias("table_name"), "column_name", "type", "position", F.col("_rows").alias("rows"), "non_null",
        (F.col("_rows") - F.col("non_null")).alias("nulls"),
    )


def _long_values(df: DataFrame, cols: Sequence[str], cast: str) -> DataFrame:
    body = ", ".join(f"'{c}', cast(`{c}` as {cast})" for c in cols)
    return df.select(F.expr(f"stack({len(cols)}, {body}) as (column_name, value)"))


def _long_many(tables, cast: str, day: bool = False) -> DataFrame:
    """(table_name, column_name, value) rows for several tables at once (one union, one pass later)."""
    frames = []
    for table, df, cols in tables:
        expr = "cast(unix_date(cast(`{c}` as date)) as double)" if day else f"cast(`{{c}}` as {cast})"
        body = ", ".join(f"'{c}', " + expr.format(c=c) for c in cols)
        frames.append(df.select(F.lit(table).alias("table_name"),
                                F.expr(f"stack({len(cols)}, {body}) as (column_name, value)")))
    return _union(frames)


def _written(tables, day: bool = False) -> list:
    """The tables with their profiled columns alone (dates as days), written once: moments, sketches and counts
    read these files, and what a table is built from (a join of two facts, say) runs once and not per pass."""
    out = []
    for table, df, cols in tables:
        values = [F.col(f"`{c}`").cast("date").alias(c) if day else F.col(f"`{c}`") for c in cols]
        out.append((table, materialize(df.select(*values)), cols))
    return out


def _quartiles(long: DataFrame, names: Sequence[str]) -> DataFrame:
    keyed = long.withColumn("_g", F.concat_ws("\u0001", "table_name", "column_name"))
    q = bracketed_quantiles(keyed, "_g", "value", [0.25, 0.5, 0.75])
    return q.groupBy("_g").agg(
        *[F.max(F.when(F.col("p") == p, F.col("quantile"))).alias(n) for p, n in zip((0.25, 0.5, 0.75), names)]
    )


def profile_numeric_many(tables) -> DataFrame:
    """Q2 for several (table, df, columns) at once: count, mean, sample std, min, exact quartiles
    (linear interpolation), max.  All columns of all tables share one quantile computation.

    The deviation comes from central moments (no difference of large squares), so tiny values and
    large offsets keep their digits; NaN and overflow come out as such.  Mean and deviation are
    reported to :data:`SIGNIFICANT` significant digits, since the last bits of a distributed sum of
    doubles depend on partitioning."""
    long = _long_many(_written(tables), "double")
    moments = long.groupBy("table_name", "column_name").agg(
        F.count("value").alias("count"), significant(F.avg("value")).alias("mean"),
        significant(F.stddev_samp("value")).alias("std"), F.min("value").alias("min"), F.max("value").alias("max"),
    ).withColumn("_g", F.concat_ws("\u0001", "table_name", "column_name"))
    qw = _quartiles(long, ("p25", "p50", "p75"))
    return moments.join(qw, "_g", "left").select(
        "table_name", "column_name", "count", "mean", "std", "min", "p25", "p50", "p75", "max"
    )


def profile_numeric(df: DataFrame, table: str, cols: Sequence[str]) -> DataFrame:
    """Q2 - numeric describe of one table."""
    return profile_numeric_many([(table, df, cols)])


def profile_dates_many(tables) -> DataFrame:
    """Q4 for several tables: count, min, exact quartiles and max of date/timestamp columns,
    as days since 1970-01-01."""
    long = _long_many(_written(tables, day=True), "double", day=True)
    base = long.groupBy("table_name", "column_name").agg(
        F.count("value").alias("count"), F.min("value").alias("min_day"), F.max("value").alias("max_day")
    ).withColumn("_g", F.concat_ws("\u0001", "table_name", "column_name"))
    qw = _quartiles(long, ("p25_day", "p50_day", "p75_day"))
    return base.join(qw, "_g", "left").select(
        "table_name", "column_name", "count", "min_day", "p25_day", "p50_day", "p75_day", "max_day"
    )


def profile_text(df: DataFrame, table: str, cols: Sequence[str]) -> DataFrame:
    """Q3 - count, distinct values, most frequent value (ties: smallest) and its frequency per text column."""
    vc = _long_values(df, cols, "string").where(F.col("value").isNotNull()).groupBy("column_name", "value").agg(
        F.count(F.lit(1)).alias("_c")
    )
    return vc.groupBy("column_name").agg(
        F.sum("_c").alias("count"),
        F.count(F.lit(1)).alias("unique"),
        F.min_by("value", F.struct((-F.col("_c")).alias("a"), F.col("value").alias("b"))).alias("top"),
        F.max("_c").alias("freq"),
    ).select(F.lit(table).alias("table_name"), "column_name", "count", "unique", "top", "freq")


def profile_flags(df: DataFrame, table: str, flags: Sequence[str]) -> DataFrame:
    """Q5 - rows, true count and true rate per boolean column."""
    body = ", ".join(f"'{c}', cast(`{c}` as int)" for c in flags)
    long = df.select(F.expr(f"stack({len(flags)}, {body}) as (column_name, value)"))
    return long.groupBy("column_name").agg(
        F.count("value").alias("rows"), F.sum("value").cast("long").alias("n_true"), F.avg("value").alias("rate")
    ).select(F.lit(table).alias("table_name"), "column_name", "rows", "n_true", "rate")


def duplicate_rows(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Q7 - every row whose key occurs more than once (pandas ``duplicated(keep=False)``).

    Key counts are partial-aggregated; the rows come back with a semi join
    (AQE splits a skewed key on the big side), never a window that would put
    a hot key's rows in one task.
    """
    dup_keys = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1).select(*keys)
    return df.join(dup_keys, list(keys), "left_semi")


def key_uniqueness(df: DataFrame, table: str, keys: Sequence[str]) -> DataFrame:
    """Rows, distinct keys and keys occurring more than once."""
    per = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return per.agg(
        F.sum("_n").cast("long").alias("rows"), F.count(F.lit(1)).alias("distinct_keys"),
        F.count(F.when(F.col("_n") > 1, 1)).alias("duplicated_keys"),
    ).select(F.lit(table).alias("table_name"), F.lit(",".join(keys)).alias("key"), "*")


def fk_orphans(child: DataFrame, parent: DataFrame, fk: str, pk: str) -> DataFrame:
    """Q8 - child rows whose foreign key has no parent (NULL keys are not orphans)."""
    parents = parent.select(F.col(pk).alias(fk)).distinct()
    return child.where(F.col(fk).isNotNull()).join(parents, fk, "left_anti")


def fk_orphan_report(tables: dict[str, DataFrame], contracts: dict[str, Contract]) -> DataFrame:
    """Q8 report - orphan count per declared foreign key."""
    rows = []
    for name, c in contracts.items():
        for col, parent, pcol in c.foreign_keys:
            n = fk_orphans(tables[name], tables[parent], col, pcol).agg(F.count(F.lit(1)).alias("orphans"))
            rows.append(n.select(F.lit(name).alias("child_table"), F.lit(col).alias("column_name"),
                                 F.lit(parent).alias("parent_table"), "orphans"))
    return _union(rows)


def constraint_predicates(c: Contract) -> list[tuple[str, object]]:
    """(constraint name, violation predicate) for a contract."""
    preds = []
    for col in c.not_null:
        preds.append((f"not_null:{col}", F.col(col).isNull()))
    for col, values in c.domains.items():
        preds.append((f"domain:{col}", F.col(col).isNotNull() & ~F.col(col).isin(*values)))
    for col in c.non_negative:
        preds.append((f"non_negative:{col}", F.col(col) < 0))
    for col, (lo, hi) in c.ranges.items():
        preds.append((f"range:{col}", (F.col(col) < lo) | (F.col(col) > hi)))
    return preds


def domain_violations(df: DataFrame, contract: Contract) -> DataFrame:
    """Q9 - violations per NOT NULL / domain / non-negative / range constraint, one pass over the table."""
    preds = constraint_predicates(contract)
    agg = df.agg(*[F.count_if(p).alias(f"_v{i}") for i, (_, p) in enumerate(preds)])
    body = ", ".join(f"'{name}', _v{i}" for i, (name, _) in enumerate(preds))
    return agg.select(F.expr(f"stack({len(preds)}, {body}) as (constraint_name, violations)")).select(
        F.lit(contract.role).alias("table_name"), "constraint_name", "violations"
    )


def distinct_values(df: DataFrame, table: str, cols: Sequence[str]) -> DataFrame:
    """Q10 - distinct values of each listed column (partial-aggregated)."""
    return _long_values(df, cols, "string").distinct().select(F.lit(table).alias("table_name"), "column_name", "value")


def parents_without_children(parent: DataFrame, child: DataFrame, key: str) -> DataFrame:
    """Q11 - parent rows with no child row."""
    return parent.join(child.select(key).distinct(), key, "left_anti")


def key_set_compare(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """J7 - sizes of A-B, B-A and A&B of two key sets, in one full outer join."""
    ka = a.select(key).distinct().withColumn("_a", F.lit(1))
    kb = b.select(key).distinct().withColumn("_b", F.lit(1))
    j = ka.join(kb, key, "full")
    return j.agg(
        F.count(F.when(F.col("_a").isNotNull() & F.col("_b").isNull(), 1)).alias("only_a"),
        F.count(F.when(F.col("_a").isNull() & F.col("_b").isNotNull(), 1)).alias("only_b"),
        F.count(F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), 1)).alias("both"),
    )


def load_reconcile(loaded: dict[str, DataFrame], expected: dict[str, object]) -> DataFrame:
    """S5 - rows per table against an expected manifest; status OK / BAD.

    ``expected`` values are ints or one-value Columns (e.g. a scalar count of
    the source the table was loaded from).
    """
    rows = []
    for name, df in loaded.items():
        exp = expected[name]
        exp_col = exp if not isinstance(exp, int) else F.lit(exp)
        rows.append(df.agg(F.count(F.lit(1)).alias("loaded")).select(
            F.lit(name).alias("table_name"), exp_col.cast("long").alias("expected"), "loaded"))
    out = _union(rows)
    return out.withColumn("status", F.when(F.col("expected") == F.col("loaded"), "OK").otherwise("BAD"))
