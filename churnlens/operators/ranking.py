"""Global ranking without a single-partition window.

``NTILE(k) OVER (ORDER BY x)`` with no ``PARTITION BY`` makes Spark move every
row into one task (``Exchange SinglePartition``).  ``distributed_ntile`` gives
the same answer with work spread over range buckets, for several orders at once
and, if asked, within each group of a column (``PARTITION BY g ORDER BY x``):

1. A total order: ``(group, null rank, value, id)`` - the id breaks ties, so a long
   run of equal values (zero sessions, say) still spreads over buckets.
2. The input is written once (or already is).  One hashed sample of it gives the
   split keys of all orders: B - 1 each, B being the session's number of shuffle
   partitions.  They become literals, and a row finds its bucket by binary search
   in an expression.  Any split keys give exact results; the sample only evens
   out the buckets.
3. One aggregate counts the rows of every bucket of every order (B rows an
   order, set by the session and not by the data); their running sums become
   literal offsets.
4. ``row_number`` inside each bucket + offset = global 0-based index ``i``; less the
   rows of the groups before, the index within the group.
5. Tile of ``i`` for ``n`` rows and ``k`` tiles, as SQL NTILE: the first
   ``n mod k`` tiles hold one extra row.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize


@dataclass(frozen=True)
class OrderSpec:
    """Order a numeric column ascending (NULLs first) or descending (NULLs last), ties by ``id_col``."""

    value: str
    descending: bool = False


def _order_fields(spec: OrderSpec, id_col: str) -> list[Column]:
    v = F.col(spec.value)
    if spec.descending:
        # NULLs last, larger values first.
        return [v.isNull().alias("_o0"), F.coalesce(-v, F.lit(0)).alias("_o1"), F.col(id_col).alias("_o2")]
    # NULLs first, smaller values first.
    return [v.isNotNull().alias("_o0"), F.coalesce(v, F.lit(0)).alias("_o1"), F.col(id_col).alias("_o2")]


def _range_buckets(df: DataFrame, order: Sequence[Column], n_buckets: int | None, bcol: str) -> DataFrame:
    """Add ``bcol`` = range bucket (0..B-1) of each row under ``order`` (all ascending, non-NULL).

    ``spark_partition_id`` after ``repartitionByRange`` is only stable within
    one execution, so the frame is written once with the bucket column; the
    counts, offsets and per-bucket windows then all read the same assignment.
    """
    n_buckets = n_buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = [f"_rk{i}" for i in range(len(order))]
    keyed = df.select("*", *[c.alias(n) for c, n in zip(order, names)])
    ranged = keyed.repartitionByRange(n_buckets, *names).withColumn(bcol, F.spark_partition_id())
    return materialize(ranged).drop(*names)


def _offsets(totals: DataFrame, bcol: str, weight: str) -> DataFrame:
    """Sum of the buckets before each bucket, and of all (a window over the B bucket totals)."""
    running = Window.orderBy(bcol).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(weight).over(running), F.lit(0))
    return totals.select(bcol, before.alias("_off"), F.sum(weight).over(Window.partitionBy()).alias("_all"))


#: Sampled rows per bucket; their number is set by the session's partitions, not by the data.
SAMPLE_PER_BUCKET = 40
#: Groups of a ranking by group are told apart by literals: at most so many.
MAX_GROUPS = 10_000


def _split_keys(df: DataFrame, keys: dict[str, Column], hash_of: Sequence[str], n_buckets: int) -> dict[str, list]:
    """At most ``n_buckets - 1`` ascending split keys for each order, from one hashed sample."""
    every = max(1, df.count() // (SAMPLE_PER_BUCKET * n_buckets))
    sample = df.where(F.pmod(F.xxhash64(*hash_of), F.lit(every)) == 0)
    row = sample.agg(*[F.sort_array(F.collect_list(key)).alias(name) for name, key in keys.items()]).first()
    out = {}
    for name in keys:
        found = row[name]
        out[name] = [found[i * len(found) // n_buckets] for i in range(1, n_buckets)] if found else []
    return out


def _bucket(key: Column, splits: list, types: Sequence) -> Column:
    """How many of the ascending ``splits`` are below ``key``: a binary search, in as many steps as they have bits."""
    if not splits:
        return F.lit(0)
    table = F.array(*[F.struct(*[F.lit(v).cast(t).alias(f"_o{i}") for i, (v, t) in enumerate(zip(s, types))]) for s in splits])
    span = lambda lo, hi: F.struct(lo.cast("int").alias("lo"), hi.cast("int").alias("hi"))

    def step(s: Column, _: Column) -> Column:
        mid = F.shiftright(s["lo"] + s["hi"], 1)
        below = F.get(table, mid) < key
        return F.when(s["lo"] >= s["hi"], s).when(below, span(mid + 1, s["hi"])).otherwise(span(s["lo"], mid))

    steps = F.array(*[F.lit(i) for i in range(len(splits).bit_length())])
    return F.aggregate(steps, span(F.lit(0), F.lit(len(splits))), step, lambda s: s["lo"])


def global_index(
    df: DataFrame,
    specs: dict[str, OrderSpec],
    id_col: str,
    n_buckets: int | None = None,
    group_col: str | None = None,
    stored: bool = False,
) -> DataFrame:
    """Add, for each ``name -> spec``, ``name`` = 0-based position in the total order (within ``group_col``,
    if given) and ``{name}_n`` = row count (of the group).

    ``stored``: ``df`` is a written table and is not written again.  The values of ``group_col`` are
    not null and at most ``MAX_GROUPS`` (a back-test's cut dates, say); more are refused.
    """
    n_buckets = n_buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    base = df if stored else materialize(df)
    first = [F.col(group_col).alias("_g")] if group_col else []
    orders = {name: first + _order_fields(spec, id_col) for name, spec in specs.items()}
    keys = {name: F.struct(*[c.alias(f"_o{i}") for i, c in enumerate(order)]) for name, order in orders.items()}
    splits = _split_keys(base, keys, [id_col, *([group_col] if group_col else [])], n_buckets)
    types = {name: [f.dataType for f in base.select(key.alias("k")).schema["k"].dataType.fields] for name, key in keys.items()}
    out = base.select("*", *[_bucket(keys[name], splits[name], types[name]).alias(f"_b_{name}") for name in specs])

    number = {name: i for i, name in enumerate(specs)}
    pairs = F.array(*[F.struct(F.lit(i).alias("o"), F.col(f"_b_{name}").alias("b")) for name, i in number.items()])
    counts = {(r["o"], r["b"]): r["n"] for r in out.select(F.explode(pairs).alias("p")).groupBy("p.o", "p.b").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(n for (o, _), n in counts.items() if o == 0)
    start, size = F.lit(0).cast("long"), F.lit(total).cast("long")
    if group_col:
        groups = base.groupBy(group_col).agg(F.count(F.lit(1)).alias("n")).orderBy(group_col).limit(MAX_GROUPS + 1).collect()
        if len(groups) > MAX_GROUPS:
            raise ValueError(f"more than {MAX_GROUPS} values of {group_col}")
        if groups:
            before = [0, *accumulate(g["n"] for g in groups)]
            table = F.create_map(*[x for g, b in zip(groups, before) for x in (F.lit(g[0]), F.struct(F.lit(b).cast("long").alias("start"), F.lit(g["n"]).cast("long").alias("n")))])
            start, size = F.try_element_at(table, F.col(group_col))["start"], F.try_element_at(table, F.col(group_col))["n"]
    for name, i in number.items():
        bcol = f"_b_{name}"
        offsets = [0, *accumulate(counts.get((i, b), 0) for b in range(len(splits[name]) + 1))]
        offset = F.get(F.array(*[F.lit(x).cast("long") for x in offsets]), F.col(bcol))
        w = Window.partitionBy(bcol).orderBy(*orders[name])
        out = out.withColumn(name, offset + F.row_number().over(w) - 1 - start).withColumn(f"{name}_n", size).drop(bcol)
    return out


def tile_of(index: Column, n: Column, k: int) -> Column:
    """SQL NTILE bucket (1..k) of a 0-based ``index`` among ``n`` rows."""
    q = F.floor(n / k).cast("long")
    r = (n % k).cast("long")
    big = r * (q + 1)
    return (
        F.when(q == 0, index + 1)
        .when(index < big, F.floor(index / (q + 1)) + 1)
        .otherwise(r + F.floor((index - big) / q) + 1)
    ).cast("long")


def distributed_ntile(
    df: DataFrame,
    k: int,
    specs: dict[str, OrderSpec],
    id_col: str,
    n_buckets: int | None = None,
    group_col: str | None = None,
    stored: bool = False,
) -> DataFrame:
    """Add ``NTILE(k) OVER ([PARTITION BY group_col] ORDER BY spec.value [DESC], id_col)`` for each
    ``name -> spec``; ``group_col`` and ``stored`` as in :func:`global_index`."""
    idx = global_index(df, {f"_i_{n}": s for n, s in specs.items()}, id_col, n_buckets, group_col, stored)
    for name in specs:
        idx = idx.withColumn(name, tile_of(F.col(f"_i_{name}"), F.col(f"_i_{name}_n"), k)).drop(
            f"_i_{name}", f"_i_{name}_n"
        )
    return idx


def top_k_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int, rank_col: str = "rank") -> DataFrame:
    """First ``k`` rows per group under ``order`` with their 1-based rank.

    ``row_number`` + filter: Catalyst plans a partial ``WindowGroupLimit``
    before the shuffle, so at most ``k`` rows per group and map task move.
    """
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) <= k)


def global_cumsum(df: DataFrame, key_cols: Sequence[str], weight_col: str, out: str = "cum_before", n_buckets: int | None = None) -> DataFrame:
    """Add ``out`` = sum of ``weight_col`` over all rows strictly before each row in the order of
    ``key_cols`` (ascending; the key must be unique and non-NULL).

    Same range-bucket scheme as :func:`global_index`: bucket totals are
    summed into offsets (B rows, broadcast), and a running sum inside each
    bucket completes the prefix.
    """
    b = _range_buckets(df, [F.col(c) for c in key_cols], n_buckets, "_b")
    totals = b.groupBy("_b").agg(F.sum(weight_col).alias("_w"))
    w = Window.partitionBy("_b").orderBy(*[F.col(c) for c in key_cols]).rowsBetween(Window.unboundedPreceding, -1)
    return (
        b.join(F.broadcast(_offsets(totals, "_b", "_w")), "_b")
        .withColumn(out, F.col("_off") + F.coalesce(F.sum(weight_col).over(w), F.lit(0)))
        .drop("_b", "_off", "_all")
    )


def global_position(df: DataFrame, keys: Sequence[str], name: str = "position", n_buckets: int | None = None) -> DataFrame:
    """Add ``name`` = 1-based place of each row in the ascending order of ``keys`` (NULLs first; rows with
    equal keys take neighbouring places): ORDER BY as data, without bringing all rows into one task."""
    flat = [x for k in keys for x in (F.col(k).isNotNull(), F.col(k))]
    b = _range_buckets(df, flat, n_buckets, "_b")
    totals = b.groupBy("_b").agg(F.count(F.lit(1)).alias("_w"))
    w = Window.partitionBy("_b").orderBy(*[F.col(k).asc_nulls_first() for k in keys])
    out = b.join(F.broadcast(_offsets(totals, "_b", "_w")), "_b")
    return out.withColumn(name, F.col("_off") + F.row_number().over(w)).drop("_b", "_off", "_all")


#: Relative rank error that the sketch is asked for: one in so many.
SKETCH_ACCURACY = 4_000
#: A bracket of so many rows (distinct values are fewer) is counted out; a larger one is sketched again.
BRACKET_ROWS = 200_000
#: Points of the grid that a sketch is read at.
SKETCH_STEPS = 1_000
ROUNDS = 8


def bracketed_quantiles(df: DataFrame, group_col: str, value_col: str, probs: Sequence[float], bracket_rows: int = BRACKET_ROWS, accuracy: int = SKETCH_ACCURACY) -> DataFrame:
    """Exact quantiles as :func:`exact_quantiles` gives them, without shuffling the values.

    1. A mergeable sketch per group brackets the value at each position p * (n - 1); how many rows lie below
       and inside a bracket is then counted exactly, by one aggregate with partial sums.
    2. A bracket that still holds more than ``bracket_rows`` is sketched again inside, which cuts it to some
       thousandths; 10**12 rows take three rounds.
    3. The values inside the brackets, with their counts, are the only ones shuffled; running counts find
       the two values of each position.

    The sketch only chooses where to look: a bracket that its counts show to miss a position (or that does not
    shrink) is replaced by the whole range it came from.  Groups are columns to profile, so there are few brackets.  NaN counts as the largest value.
    """
    rows = df.where(F.col(value_col).isNotNull()).select(F.col(group_col).alias("_g"), F.col(value_col).cast("double").alias("_v"))
    sizes = {r["_g"]: r["n"] for r in rows.groupBy("_g").agg(F.count(F.lit(1)).alias("n")).collect()}
    # (group, p) -> [from, to], rows below it, rows in it, whether it can shrink
    open_ = {(g, p): (float("-inf"), float("nan"), 0, n, True) for g, n in sizes.items() for p in probs}

    def position(g, p: float) -> tuple[int, int]:
        at = p * (sizes[g] - 1)
        return math.floor(at), math.ceil(at)

    def inside(brackets: dict, keep_below: bool = False) -> DataFrame:
        """Rows with each bracket of their group that holds them (or, with ``keep_below``, whose upper end they
        do not pass).  The brackets, one per group and position, are a broadcast table."""
        table = df.sparkSession.createDataFrame([(g, float(p), b[0], b[1]) for (g, p), b in brackets.items()], "_of string, p double, _from double, _to double")
        out = rows.join(F.broadcast(table), F.col("_g") == F.col("_of")).where(F.col("_v") <= F.col("_to"))
        return out if keep_below else out.where(F.col("_v") >= F.col("_from"))

    for _ in range(ROUNDS):
        wide = {k: b for k, b in open_.items() if b[4] and b[3] > bracket_rows}
        if not wide:
            break
        by = inside(wide).groupBy("_g", "p")
        steps = F.array(*[F.lit(i / SKETCH_STEPS) for i in range(SKETCH_STEPS + 1)])
        grids = {(r["_g"], r["p"]): r["q"] for r in by.agg(F.percentile_approx("_v", steps, accuracy).alias("q")).collect()}
        tried = {}
        for (g, p), (lo, hi, below, n, _) in wide.items():
            first, last = position(g, p)
            grid = grids[g, p]
            slack = 2 * SKETCH_STEPS / accuracy + 1e-9
            a = max(0, math.floor((first - below) / max(n - 1, 1) * SKETCH_STEPS - slack))
            b = min(SKETCH_STEPS, math.ceil((last - below) / max(n - 1, 1) * SKETCH_STEPS + slack))
            tried[g, p] = (lo if a == 0 else grid[a], hi if b == SKETCH_STEPS else grid[b], below, n, True)
        counted = {
            (r["_g"], r["p"]): (r["below"], r["n"])
            for r in inside(tried, keep_below=True).groupBy("_g", "p").agg(
                F.count(F.when(F.col("_v") < F.col("_from"), 1)).alias("below"), F.count(F.when(F.col("_v") >= F.col("_from"), 1)).alias("n")
            ).collect()
        }
        for (g, p), (lo, hi, old_below, old_n, _) in tried.items():
            first, last = position(g, p)
            below, n = counted.get((g, p), (0, 0))
            if below <= first and last < below + n and n < old_n:
                open_[g, p] = (lo, hi, below, n, lo != hi)
            else:
                open_[g, p] = (*open_[g, p][:4], False)
    if not open_:
        return df.sparkSession.createDataFrame([], f"{group_col} string, p double, quantile double").limit(0)

    values = inside(open_).groupBy("_g", "p", "_v").agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.partitionBy("_g", "p").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    spots = F.create_map(*[x for (g, p), b in open_.items() for x in (
        F.struct(F.lit(g).alias("g"), F.lit(float(p)).alias("p")),
        F.struct(F.lit(b[2]).cast("long").alias("below"), F.lit(position(g, p)[0]).cast("long").alias("first"), F.lit(position(g, p)[1]).cast("long").alias("last"), F.lit(p * (sizes[g] - 1)).alias("at")),
    )])
    spot = F.element_at(spots, F.struct(F.col("_g").alias("g"), F.col("p").alias("p")))
    ranked = values.withColumn("_s", spot).withColumn("_end", F.sum("_n").over(upto) + F.col("_s.below"))
    here = lambda c: (F.col("_end") - F.col("_n") <= F.col(c)) & (F.col(c) < F.col("_end"))
    found = ranked.groupBy("_g", "p").agg(
        F.max(F.when(here("_s.first"), F.col("_v"))).alias("_lo"), F.max(F.when(here("_s.last"), F.col("_v"))).alias("_hi"), F.max(F.col("_s.at") - F.col("_s.first")).alias("_d")
    )
    # lo * (1 - d) + hi * d: exact at both ends, same rounding as quantile_cont.
    between = F.col("_lo") * (1 - F.col("_d")) + F.col("_hi") * F.col("_d")
    return found.select(F.col("_g").alias(group_col), "p", F.when(F.col("_d") == 0, F.col("_lo")).otherwise(between).alias("quantile"))


#: Up to so many groups the table of their starts and quantile positions is broadcast.
BROADCAST_GROUPS = 10_000


def exact_quantiles(df: DataFrame, group_col: str, value_col: str, probs: Sequence[float], n_groups: int, n_buckets: int | None = None) -> DataFrame:
    """Exact quantiles with linear interpolation (``quantile_cont`` / pandas default) per group.

    Values are first reduced to (group, value, count) - a shuffle that shrinks
    with repeated values - then ranked with :func:`global_cumsum`.  Each
    quantile position ``p * (n - 1)`` is located by a join on the group with a
    range condition (one row per group and probability on the small side).
    No group is ever gathered into one task.  ``n_groups`` bounds the number of
    groups (profiled columns); beyond ``BROADCAST_GROUPS`` their positions are
    joined by a shuffle.  Output: (group, p, quantile).
    """
    few = F.broadcast if n_groups <= BROADCAST_GROUPS else (lambda frame: frame)
    vc = df.where(F.col(value_col).isNotNull()).groupBy(group_col, value_col).agg(F.count(F.lit(1)).alias("_w"))
    ranked = global_cumsum(vc, [group_col, value_col], "_w", "_before", n_buckets)
    ranked = ranked.join(
        few(ranked.groupBy(group_col).agg(F.min("_before").alias("_start"))), group_col
    ).select(group_col, value_col, (F.col("_before") - F.col("_start")).alias("_lo_idx"),
             (F.col("_before") - F.col("_start") + F.col("_w")).alias("_hi_idx"), "_w")
    sizes = ranked.groupBy(group_col).agg(F.sum("_w").alias("_n"))
    targets = sizes.select(group_col, "_n", F.explode(F.array(*[F.lit(float(p)) for p in probs])).alias("p")).select(
        group_col, "p", (F.col("p") * (F.col("_n") - 1)).alias("_pos")
    ).select(group_col, "p", "_pos", F.floor("_pos").alias("_flo"), F.ceil("_pos").alias("_cei"))
    hit_lo = (F.col("_lo_idx") <= F.col("_flo")) & (F.col("_flo") < F.col("_hi_idx"))
    hit_hi = (F.col("_lo_idx") <= F.col("_cei")) & (F.col("_cei") < F.col("_hi_idx"))
    v = F.col(value_col).cast("double")
    found = few(targets).join(ranked, group_col).where(hit_lo | hit_hi).groupBy(group_col, "p", "_pos", "_flo").agg(
        F.max(F.when(hit_lo, v)).alias("_vlo"), F.max(F.when(hit_hi, v)).alias("_vhi")
    )
    return found.select(
        group_col, "p",
        # lo * (1 - d) + hi * d: exact at both ends, same rounding as quantile_cont.
        (F.col("_vlo") * (1 - (F.col("_pos") - F.col("_flo"))) + F.col("_vhi") * (F.col("_pos") - F.col("_flo"))).alias("quantile"),
    )
