"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

1. Sizes (words) per row and per source; targets by weight, capped at ``max_repeat`` times the
   source's size, the excess shared again by weight (one pass over the sources in order of cap per
   weight gives the fixed point).
2. A source's rows are dealt by a seeded hash of id and text into shards of about ``shard_words`` words.  A
   shard's rows, in seeded order, form one line of words, cut into n equal blocks of about ``block_words``.
3. The house is as many blocks as all targets make.  Its seats go to the highest quotients w / (2k + 1) of
   all sources, w being a source's target in its own blocks; then each source's seats go to the highest
   quotients blocks / (2k + 1) of its shards.  Nobody gets more than ``max_repeat`` times its blocks;
   what it would get beyond goes to the next quotients.  Ties go to the first source or shard.
4. In a shard of n blocks with quota q, every block is taken q div n times, and q mod n blocks once
   more: those the seeded permutation (a * k + c) mod n sends below q mod n.  A row takes the words
   of its part of the line.

The quotients are not ranked one by one (there is one a block): a search by aggregates finds the least
quotient that still gets a seat to within a few thousand, and only the quotients about there are ranked.

Everything is native Spark.  Two passes read the rows' sizes, which are written once; the only
window over rows is inside a shard, so a source with a third of all rows is many shards, and rows with
null or equal ids spread like others.  Null or empty texts have size 0 and take 0; a null source is a
source of its own, last in order; repeated rows are rows like others.  With no words at all every target is 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from churnlens.llm import text as T
from churnlens.session import materialize

WORD = r"[^\x20\x09-\x0D]+"
BLOCK_WORDS = 64
SHARD_WORDS = 1 << 20
MAX_REPEAT = 3
SEED = "mix-1"
#: Quotients that are ranked at the end of a search, per house; divisors tried by one aggregate; aggregates at most.
RANKED = 5_000
TRIED = 16
STEPS = 24
#: Quotients nearer than this to a divisor, relatively, are compared one by one.
NEAR = 1e-12
#: Multipliers of the block permutation: primes above any shard's number of blocks.
PRIMES = (1000003, 1299709, 2000003, 2750159)
#: Up to so many sources their table is broadcast; beyond, it is joined by a shuffle.
BROADCAST_SOURCES = 50_000


def hash_number(*parts):
    """28 bits of the md5 of the parts as text (a null part is empty)."""
    joined = F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    return F.conv(F.substring(F.md5(joined.cast("binary")), 1, 7), 16, 10).cast("long")


def targets(sources: DataFrame, cycle: int = 3, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """Per source: its number in code point order (null last), weight and target.  One row per source."""
    every = Window.orderBy(F.col("source").asc_nulls_last())
    table = sources.withColumn("source_no", F.row_number().over(every).cast("long")).withColumn("weight", F.pmod(F.col("source_no") - 1, F.lit(cycle)) + 1)
    cap = F.col("source_size") * max_repeat
    by_cap = Window.orderBy((cap / F.col("weight")), "source_no")
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    table = (
        table.withColumn("_total", F.sum("source_size").over(whole))
        .withColumn("_gone", F.coalesce(F.sum(cap).over(before), F.lit(0)))
        .withColumn("_left", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("_capped", cap * F.col("_left") <= F.col("weight") * (F.col("_total") - F.col("_gone")))
    )
    free = F.min(F.when(~F.col("_capped"), F.struct("_gone", "_left"))).over(whole)
    table = table.withColumn("_free", free)
    share = (F.col("weight") * (F.col("_total") - F.col("_free._gone"))).cast("double") / F.col("_free._left")
    return table.select("source", "source_no", "source_size", "weight", F.when(F.col("_capped"), cap.cast("double")).otherwise(share).alias("target"))


def sized(docs: DataFrame, keep: list[str], text_col: str = "text", seed: str = SEED, id_col: str = "doc_id") -> DataFrame:
    """The columns of ``keep`` with the row's size and its place in the seeded order, written once.  The order is
    that of a hash of id and text: rows that share their id have a fixed order too."""
    text = F.coalesce(F.md5(F.col(text_col).cast("binary")), F.lit(""))
    order = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("")), text).cast("binary"))
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    return materialize(docs.select(*keep, size.alias("_size"), order.alias("_order")))


def _seats_from(weight, cap, divisor):
    """How many quotients weight / (2k + 1), k < cap, are ``divisor`` or more."""
    return F.least(cap.cast("double"), F.floor((weight / divisor + 1) / 2).cast("double")).cast("long")


def apportion(items: DataFrame, house: str, item: str) -> DataFrame:
    """Seats by highest quotients weight / (2k + 1), k < cap, within every ``house`` (a column, not null).

    ``items``: house, item (unique in its house, decides ties), weight, cap and ``seats`` to give, the same in
    a house's rows.  Adds ``quota``; quotas add up to the seats, or to the caps if those are fewer.
    """
    items = materialize(items)
    weight, cap = F.col("weight").cast("double"), F.col("cap")
    live = items.where((F.col("weight") > 0) & (F.col("cap") > 0))
    # below _lo every quotient is counted, above _hi none
    state = live.groupBy(house).agg(
        F.first("seats").alias("_seats"), (F.min(weight / (2 * cap + 1)) / 2).alias("_lo"), (F.max(weight) * 2).alias("_hi"), F.sum(cap).alias("_more"), F.lit(0).cast("long").alias("_less")
    )
    state = materialize(state)
    for _ in range(STEPS):
        wide = (F.col("_more") - F.col("_less") > RANKED) & (F.col("_seats") < F.col("_more")) & (F.col("_seats") > F.col("_less")) & (F.col("_hi") > F.col("_lo") * (1 + 4 * NEAR))
        if state.where(wide).limit(1).count() == 0:
            break
        at = F.transform(F.sequence(F.lit(1), F.lit(TRIED - 1)), lambda i: F.col("_lo") * F.pow(F.col("_hi") / F.col("_lo"), i / F.lit(TRIED)))
        tried = live.join(state.where(wide).select(house, F.posexplode(at).alias("_i", "_d")), house)
        counted = tried.groupBy(house, "_d").agg(F.sum(_seats_from(weight, cap, F.col("_d"))).alias("_n"))
        found = counted.join(state.select(house, F.col("_seats").alias("_s")), house).groupBy(house).agg(
            F.max(F.when(F.col("_n") >= F.col("_s"), F.struct("_d", "_n"))).alias("_below"), F.min(F.when(F.col("_n") <= F.col("_s"), F.struct("_d", "_n"))).alias("_above")
        )
        joined = state.join(found, house, "left")
        state = materialize(
            joined.select(
                house, "_seats",
                F.coalesce("_below._d", "_lo").alias("_lo"), F.coalesce("_above._d", "_hi").alias("_hi"),
                F.coalesce("_below._n", "_more").alias("_more"), F.coalesce("_above._n", "_less").alias("_less"),
            )
        )
    base = live.join(state.select(house, "_seats", "_lo", "_hi"), house)
    base = base.withColumn("_base", _seats_from(weight, cap, F.col("_hi") * (1 + NEAR))).withColumn("_top", _seats_from(weight, cap, F.col("_lo") * (1 - NEAR)))
    open_ = base.groupBy(house).agg((F.first("_seats") - F.sum("_base")).alias("_open"))
    near = base.where(F.col("_top") > F.col("_base")).withColumn("_k", F.explode(F.sequence(F.col("_base"), F.col("_top") - 1)))
    rank = F.row_number().over(Window.partitionBy(house).orderBy((weight / (2 * F.col("_k") + 1)).desc(), item))
    won = near.withColumn("_rank", rank).join(open_, house).where("_rank <= _open").groupBy(house, item).agg(F.count("*").alias("_won"))
    given = base.select(house, item, "_base").join(won, [house, item], "left").select(house, item, (F.col("_base") + F.coalesce("_won", F.lit(0))).alias("quota"))
    return items.join(given, [house, item], "left").withColumn("quota", F.coalesce("quota", F.lit(0)).cast("long"))


def mix(
    rows: DataFrame,
    block_words: int = BLOCK_WORDS,
    shard_words: int = SHARD_WORDS,
    max_repeat: int = MAX_REPEAT,
    cycle: int = 3,
    seed: str = SEED,
    broadcast_sources: int = BROADCAST_SOURCES,
) -> DataFrame:
    """Plan over :func:`sized` rows; adds source_size, target, taken, ``_whole`` (times the whole row
    is taken) and ``_parts`` (word ranges of the row taken once more)."""
    stats = materialize(targets(rows.groupBy("source").agg(F.sum("_size").alias("source_size")), cycle, max_repeat))
    small = stats.limit(broadcast_sources + 1).count() <= broadcast_sources
    numbers = stats.withColumn("_shards", F.greatest(F.lit(1).cast("long"), F.expr(f"(2 * source_size + {shard_words}) div {2 * shard_words}")))
    numbers = numbers.withColumnRenamed("source", "_source")
    numbers = F.broadcast(numbers) if small else numbers
    dealt = rows.join(numbers, F.col("source").eqNullSafe(F.col("_source"))).drop("_source", "weight")
    dealt = dealt.withColumn("shard", F.pmod(hash_number(F.lit(seed), F.col("_order")), F.col("_shards"))).drop("_shards")
    shards = dealt.groupBy("source_no", "shard").agg(F.sum("_size").alias("shard_size"), F.first("source_size").alias("source_size"), F.first("target").alias("target"))
    shards = shards.where("shard_size > 0").withColumn("blocks", F.greatest(F.lit(1).cast("long"), F.expr(f"(2 * shard_size + {block_words}) div {2 * block_words}")))
    sources = shards.groupBy("source_no").agg(F.sum("blocks").alias("source_blocks"), F.first("source_size").alias("source_size"), F.first("target").alias("target"))
    sources = sources.withColumn("weight", F.col("target") * F.col("source_blocks") / F.col("source_size")).withColumn("cap", F.col("source_blocks") * max_repeat)
    sources = materialize(sources)
    house = sources.agg(F.floor(F.round(F.sum("weight"), 6) + 0.5).cast("long").alias("n")).first()["n"] or 0
    seats = apportion(sources.select("source_no", "weight", "cap", F.lit(house).cast("long").alias("seats"), F.lit(0).alias("_house")), "_house", "source_no")
    shards = shards.join(seats.select("source_no", F.col("quota").alias("seats")), "source_no").withColumn("weight", F.col("blocks")).withColumn("cap", F.col("blocks") * max_repeat)
    salt = hash_number(F.lit(seed), F.col("source_no"), F.col("shard"))
    factor = F.element_at(F.array(*(F.lit(p).cast("long") for p in PRIMES)), (salt % len(PRIMES) + 1).cast("int"))
    quotas = apportion(shards.drop("target", "source_size"), "source_no", "shard").select(
        "source_no", "shard", "shard_size", "blocks", "quota", salt.alias("_salt"), factor.alias("_factor")
    )
    line = Window.partitionBy("source_no", "shard").orderBy("_order", "_size").rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("_at", F.coalesce(F.sum("_size").over(line), F.lit(0).cast("long")))
    placed = placed.join(quotas, ["source_no", "shard"], "left")
    low = F.expr("((_at + 1) * blocks - 1) div shard_size")
    high = F.expr("((_at + _size) * blocks - 1) div shard_size")
    parts = F.expr(
        """transform(
             filter(sequence(_low, _high), k -> (_factor * k + _salt) % blocks < quota % blocks),
             k -> named_struct('begin', greatest((k * shard_size) div blocks, _at) - _at,
                               'end', least(((k + 1) * shard_size) div blocks, _at + _size) - _at))"""
    )
    some = (F.col("_size") > 0) & F.col("quota").isNotNull()
    placed = placed.withColumn("_low", low).withColumn("_high", high).withColumn("_whole", F.when(some, F.expr("quota div blocks")).otherwise(F.lit(0).cast("long")))
    placed = placed.withColumn("_parts", F.when(some, parts))
    part = F.coalesce(F.expr("aggregate(_parts, 0L, (s, p) -> s + p.end - p.begin)"), F.lit(0).cast("long"))
    return placed.withColumn("_part", part).withColumn("taken", F.col("_whole") * F.col("_size") + F.col("_part"))


def mixed_documents(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """The mix itself, with the columns of ``docs``: every row as often as it is wholly taken, and
    one row with the words of the blocks taken once more (the whole text where they cover it)."""
    rows = docs.select("doc_id", "source", "text", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"))
    plan = mix(sized(rows, ["doc_id", "source", "_row"], seed=seed), seed=seed)
    copies = F.col("_whole") + F.when(F.col("_part") > 0, 1).otherwise(0)
    rows = plan.where(copies > 0).withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), copies)))
    # the array around the pieces binds them: they are cut once a row, not once a part
    pieces = F.array(F.regexp_extract_all(F.col("_row.text"), F.lit(rf"([\x20\x09-\x0D]*{WORD})"), F.lit(1)))
    taken = F.transform(pieces, lambda ws: F.flatten(F.transform("_parts", lambda p: F.slice(ws, (p["begin"] + 1).cast("int"), (p["end"] - p["begin"]).cast("int")))))
    cut = F.ltrim(F.concat_ws("", F.get(taken, 0)))
    text = F.when((F.col("_copy") <= F.col("_whole")) | (F.col("_part") == F.col("_size")), F.col("_row.text")).otherwise(cut)
    out = rows.select("_row", text.alias("_text"))
    new = {"text": F.col("_text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("_text").cast(docs.schema["n_chars"].dataType)
    return out.select(*(new.get(c, F.col(f"_row.`{c}`")).alias(c) for c in docs.columns))


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sized(T.read(spark, sf_dir, "documents"), ["doc_id", "source"])
    return mix(rows).select("doc_id", F.col("_size").alias("size"), "source_size", "target", "taken")


def _oracle() -> str:
    hexa = "cast('0x' || substr(md5({}), 1, 7) as bigint)"
    primes = "[" + ", ".join(map(str, PRIMES)) + "]"
    return f"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS size,
         md5('{SEED}|' || coalesce(cast(doc_id AS varchar), '') || '|' || coalesce(md5(text), '')) AS ord
  FROM documents),
s AS (SELECT source, cast(sum(size) AS bigint) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS no FROM d GROUP BY source),
w AS (SELECT *, (no - 1) % 3 + 1 AS weight FROM s),
c AS (SELECT *, cast(sum(source_size) OVER () AS bigint) AS total,
        cast(coalesce(sum(3 * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bigint) AS gone,
        cast(sum(weight) OVER () - coalesce(sum(weight) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bigint) AS remain
      FROM w WINDOW o AS (ORDER BY 3 * source_size / weight, no)),
f AS (SELECT *, 3 * source_size * remain <= weight * (total - gone) AS capped FROM c),
u AS (SELECT gone AS g, remain AS r FROM f WHERE NOT capped ORDER BY gone, remain LIMIT 1),
t AS (SELECT no, source, source_size,
        CASE WHEN capped THEN cast(3 * source_size AS double) ELSE cast(weight * (total - (SELECT g FROM u)) AS double) / (SELECT r FROM u) END AS target,
        greatest(1, (2 * source_size + {SHARD_WORDS}) // {2 * SHARD_WORDS}) AS n_shards FROM f),
x AS (SELECT d.doc_id, d.size, d.ord, t.no, t.source_size, t.target, {hexa.format(f"'{SEED}|' || d.ord")} % t.n_shards AS shard
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
sh AS (SELECT no, shard, cast(sum(size) AS bigint) AS shard_size, any_value(source_size) AS source_size, any_value(target) AS target
       FROM x GROUP BY no, shard HAVING sum(size) > 0),
b AS (SELECT *, greatest(1, (2 * shard_size + {BLOCK_WORDS}) // {2 * BLOCK_WORDS}) AS blocks FROM sh),
a AS (SELECT no, cast(sum(blocks) AS bigint) AS source_blocks, any_value(target) * sum(blocks) / any_value(source_size) AS weight FROM b GROUP BY no),
h AS (SELECT no, unnest(range(0, 3 * source_blocks)) AS k, weight, (SELECT floor(round(sum(weight), 6) + 0.5) FROM a) AS house FROM a),
i AS (SELECT no, house, row_number() OVER (ORDER BY weight / (2 * k + 1) DESC, no) AS place FROM h),
e AS (SELECT b.*, coalesce(seats, 0) AS seats FROM b LEFT JOIN (SELECT no, count(*) AS seats FROM i WHERE place <= house GROUP BY no) USING (no)),
q AS (SELECT no, shard, unnest(range(0, 3 * blocks)) AS k, blocks, seats FROM e),
r AS (SELECT no, shard, seats, row_number() OVER (PARTITION BY no ORDER BY cast(blocks AS double) / (2 * k + 1) DESC, shard) AS place FROM q),
won AS (SELECT no, shard, count(*) AS quota FROM r WHERE place <= seats GROUP BY no, shard),
z AS (SELECT e.no, e.shard, e.shard_size, e.blocks, coalesce(won.quota, 0) AS quota,
        {hexa.format(f"'{SEED}|' || e.no || '|' || e.shard")} AS salt
      FROM e LEFT JOIN won USING (no, shard)),
p AS (SELECT x.*, cast(coalesce(sum(size) OVER (PARTITION BY no, shard ORDER BY ord, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bigint) AS pos FROM x),
m AS (SELECT p.doc_id, p.size, p.source_size, p.target, p.pos, z.* EXCLUDE (no, shard), {primes}[salt % {len(PRIMES)} + 1] AS factor
      FROM p LEFT JOIN z USING (no, shard))
SELECT doc_id, cast(size AS bigint) AS size, source_size, target,
  cast(CASE WHEN size = 0 OR quota IS NULL THEN 0 ELSE quota // blocks * size + coalesce(list_sum(list_transform(
      list_filter(range(((pos + 1) * blocks - 1) // shard_size, ((pos + size) * blocks - 1) // shard_size + 1), lambda k: (factor * k + salt) % blocks < quota % blocks),
      lambda k: least((k + 1) * shard_size // blocks, pos + size) - greatest(k * shard_size // blocks, pos))), 0) END AS bigint) AS taken
FROM m"""


ORACLE = _oracle()
