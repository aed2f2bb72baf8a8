"""Dense row numbers in a total order, without a window over all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from churnlens.session import materialize

#: monotonically_increasing_id() keeps the partition above these bits and the row's place below.
PLACE_BITS = 33


def row_numbers(df: DataFrame, order: list[Column], name: str = "row_no") -> DataFrame:
    """The columns of ``df`` and ``name``: 0-based places in ``order``, written once.

    Rows are dealt by range into the session's shuffle partitions, sorted there, and numbered by
    partition and place; the partitions' sizes (one row each) become offsets, so no row passes
    through one task.  Rows equal in ``order`` get neighbouring numbers in any order.  A read-order
    salt ends the range key, so that however many equal rows spread over partitions: the salt decides
    only among equals.  Column names beginning with ``_n_`` are the helper's own.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [f"_n_key{i}" for i in range(len(order))] + ["_n_salt"]
    keyed = df.select("*", *(c.alias(k) for c, k in zip(order, keys, strict=False)), F.monotonically_increasing_id().alias("_n_salt"))
    dealt = keyed.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).drop(*keys)
    placed = materialize(dealt.withColumn("_n_id", F.monotonically_increasing_id()))
    part, place = F.shiftright("_n_id", PLACE_BITS), F.col("_n_id").bitwiseAND((1 << PLACE_BITS) - 1)
    sizes = placed.groupBy(part.alias("_n_part")).agg(F.count("*").alias("_n_rows"))
    before = F.sum("_n_rows").over(Window.orderBy("_n_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("_n_part", F.coalesce(before, F.lit(0)).cast("long").alias("_n_start"))
    numbered = placed.withColumn("_n_part", part).join(F.broadcast(starts), "_n_part")
    return numbered.select(*(F.col(f"`{c}`") for c in df.columns), (F.col("_n_start") + place).alias(name))
