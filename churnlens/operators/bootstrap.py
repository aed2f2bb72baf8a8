"""Seeded Poisson bootstrap: replicates of an aggregate in the same single aggregate.

A bootstrap draws n of n rows with replacement.  Drawing each row a Poisson(1) number of times instead
needs no look at other rows, so all replicates are weights of the row, and one grouped sum gives every
replicate.  The weight is a function of (id, seed) alone: reruns, other partitionings and other engines give
the same replicates.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hash values are below this; the weight 12 has a chance of 10**-10, less than one value.
HASH_RANGE = 1 << 28
MOST_WEIGHT = 12


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the first 28 bits of the md5 of the parts as text, joined by '|'."""
    joined = F.concat_ws("|", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(joined.cast("binary")), 1, 7), 16, 10).cast("long") / HASH_RANGE


def poisson_weight(id_col: str, seed: Column) -> Column:
    """Poisson(1) weight of a row in the replicate ``seed``: how many values of the distribution function are at or below its hash."""
    steps = [sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) for k in range(MOST_WEIGHT)]
    u = uniform(seed, F.col(id_col))
    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0).cast("long"), lambda n, s: n + (u >= s).cast("long"))


def replicates(df: DataFrame, id_col: str, seeds: Sequence[int], seed_col: str = "seed", weight_col: str = "weight") -> DataFrame:
    """Each row once for every seed that draws it, with its weight there.  Grouped sums fold the copies before any shuffle."""
    out = df.withColumn(seed_col, F.explode(F.array(*[F.lit(int(s)).cast("long") for s in seeds])))
    return out.withColumn(weight_col, poisson_weight(id_col, F.col(seed_col))).where(F.col(weight_col) > 0)
