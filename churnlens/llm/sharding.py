"""Sharding by a Feistel permutation with cycle walking over global row numbers.

1. Every row gets its number in the order of id (nulls last) and text digest: 0 to n - 1, whatever
   files or partitions the rows come from.
2. A Feistel network over pairs (l, r) of numbers below a, a the least with a * a >= n, permutes 0 to
   a * a - 1; a result of n or more is permuted again until it falls below n (cycle walking).  That
   is a permutation of the row numbers which a seed alone determines.
3. The permuted number p means shard p mod k and slot p div k.  Shards therefore differ by one row at
   most, slots have no gaps, and a row's shard and slot, or the row of a shard and slot
   (``Permutation.inverse``), follow from its number, n, k and the seed without looking at other rows.

Everything is native Spark; a round is integer arithmetic that stays below 2**62.  Equal rows, nulls
and hot sources are numbers like any others: no group is ever gathered.  A null text has no bytes (size
8, crc32 0); rows equal in id and text are interchangeable.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from churnlens.llm import text as T
from churnlens.llm.numbering import row_numbers
from churnlens.session import materialize

SHARDS = 24
ROUNDS = 6
SEED = "shard-1"
#: The round function works modulo this prime.
PRIME = (1 << 31) - 1
#: Walks of up to so many further steps are tried before the bound that no walk can pass.
SHORT_WALK = 16
MOST_ROWS = 1 << 58


class Permutation:
    """A seeded permutation of 0 .. n - 1 as column expressions."""

    def __init__(self, n: int, seed: str = SEED, rounds: int = ROUNDS):
        if not 0 <= n <= MOST_ROWS:
            raise ValueError(f"{n} rows are not within 0 to {MOST_ROWS}")
        self.n = n
        self.side = math.isqrt(max(n, 1) - 1) + 1
        self.keys = []
        for i in range(rounds):
            raw = hashlib.sha256(f"{seed}|{i}".encode()).digest()
            add, mul, again = (int.from_bytes(raw[j : j + 4], "big") % (PRIME - 1) + 1 for j in (0, 4, 8))
            self.keys.append((add, mul, again))

    def _round(self, r: Column, key: Column) -> Column:
        x = (r + key["add"]) % PRIME * key["mul"] % PRIME
        x = x.bitwiseXOR(F.shiftright(x, 16)) * key["again"] % PRIME
        return x.bitwiseXOR(F.shiftright(x, 15)) % self.side

    def _schedule(self, keys: list[tuple[int, int, int]]) -> Column:
        names = ("add", "mul", "again")
        return F.array(*(F.struct(*(F.lit(v).cast("long").alias(c) for v, c in zip(k, names, strict=True))) for k in keys))

    def _halves(self, x: Column) -> Column:
        right = x % self.side
        return F.struct(F.call_function("div", x - right, F.lit(self.side).cast("long")).alias("l"), right.alias("r"))

    def _once(self, x: Column) -> Column:
        def step(s: Column, key: Column) -> Column:
            return F.struct(s["r"].alias("l"), ((s["l"] + self._round(s["r"], key)) % self.side).alias("r"))

        return F.aggregate(self._schedule(self.keys), self._halves(x), step, lambda s: s["l"] * self.side + s["r"])

    def _once_back(self, x: Column) -> Column:
        def step(s: Column, key: Column) -> Column:
            return F.struct(((s["r"] - self._round(s["l"], key) + self.side) % self.side).alias("l"), s["l"].alias("r"))

        return F.aggregate(self._schedule(self.keys[::-1]), self._halves(x), step, lambda s: s["l"] * self.side + s["r"])

    def _walk(self, df: DataFrame, source: str, out: str, once) -> DataFrame:
        """A walk returns below n within side² - n + 1 steps; few rows need a second, so the long list
        of steps is built for none but those that also outlast ``SHORT_WALK``."""
        longest = self.side * self.side - self.n + 1
        more = lambda y, steps: F.aggregate(F.sequence(F.lit(1).cast("long"), y * 0 + steps), y, lambda s, _: F.when(s < self.n, s).otherwise(once(s)))
        df = df.withColumn("_p_y", once(F.col(source).cast("long")))
        for steps in (SHORT_WALK, longest):
            df = df.withColumn("_p_y", F.when(F.col("_p_y") < self.n, F.col("_p_y")).otherwise(more(F.col("_p_y"), steps)))
        return df.withColumnRenamed("_p_y", out)

    def forward(self, df: DataFrame, number: str, out: str) -> DataFrame:
        """Adds ``out``, the place that the permutation gives to ``number``."""
        return self._walk(df, number, out, self._once)

    def inverse(self, df: DataFrame, place: str, out: str) -> DataFrame:
        """Adds ``out``, the number whose place is ``place``."""
        return self._walk(df, place, out, self._once_back)


def place(rows: DataFrame, order: list[Column], n_shards: int = SHARDS, seed: str = SEED) -> DataFrame:
    """The columns of ``rows`` with row_no, shard and slot (columns of these names give way)."""
    mine = rows.drop("row_no", "shard", "slot")
    numbered = row_numbers(mine, order)
    permutation = Permutation(numbered.count(), seed)
    placed = permutation.forward(numbered, "row_no", "_place")
    return placed.select(*(F.col(f"`{c}`") for c in mine.columns), "row_no", (F.col("_place") % n_shards).cast("int").alias("shard"), F.expr(f"_place div {n_shards}").alias("slot"))


def text_order(id_col: str = "doc_id", digest: str = "_digest") -> list[Column]:
    """Id with nulls last, then the text's digest (empty for a null text)."""
    return [F.col(id_col).isNull(), F.col(id_col), F.coalesce(F.col(digest), F.lit(""))]


def write_shards(docs: DataFrame, path: str, n_shards: int = SHARDS, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The shuffled table itself: Parquet under ``path``, a folder a shard, rows in slot order as
    ``row`` (a struct, so columns of any names fit) and ``slot``.  Returns it read back."""
    spark = docs.sparkSession
    whole = docs.select(F.col(id_col).alias("_id"), F.md5(F.col(text_col).cast("binary")).alias("_digest"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    placed = place(whole, text_order("_id"), n_shards, seed)
    files = max(n_shards, int(spark.conf.get("spark.sql.shuffle.partitions")))
    placed.select("shard", "slot", "row").repartitionByRange(files, "shard", "slot").sortWithinPartitions("shard", "slot").write.mode("overwrite").partitionBy("shard").parquet(path)
    return spark.read.parquet(path)


def op12_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    sizes = T.read(spark, sf_dir, "documents").select("doc_id", (F.octet_length(raw) + 8).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), F.md5(F.col("text").cast("binary")).alias("_digest"))
    placed = place(materialize(sizes), text_order())
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _oracle() -> str:
    keys = Permutation(1).keys
    column = lambda j: "[" + ", ".join(str(k[j]) for k in keys) + "]"
    return f"""
WITH RECURSIVE
poly(c, i, k) AS (
  SELECT cast(range AS bigint), cast(range AS bigint), 0 FROM range(256)
  UNION ALL SELECT CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i, k + 1 FROM poly WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM poly WHERE k = 8),
d AS (SELECT doc_id, coalesce(text, '') AS body, md5(text) AS digest, row_number() OVER (ORDER BY doc_id NULLS LAST, coalesce(md5(text), '')) - 1 AS row_no FROM documents),
c AS (
  SELECT doc_id, row_no, strlen(body) + 8 AS size,
    xor(4294967295, list_reduce(list_transform(regexp_extract_all(hex(encode(body)), '..'), lambda h: cast('0x' || h AS bigint)),
      lambda x, b: xor(x >> 8, t[(xor(x, b) & 255) + 1]), cast(4294967295 AS bigint))) AS text_crc32
  FROM d, crc),
n AS (SELECT count(*) AS n, cast(ceil(sqrt(greatest(count(*), 1))) AS bigint) AS a FROM documents),
walk(row_no, l, r, k) AS (
  SELECT row_no, row_no // a, row_no % a, 0 FROM d, n
  UNION ALL
  SELECT row_no, r, (l + xor(y, y >> 15) % a) % a, k + 1 FROM (
    SELECT *, xor(x, x >> 16) * {column(2)}[k % {ROUNDS} + 1] % {PRIME} AS y FROM (
      SELECT row_no, l, r, k, a, (r + {column(0)}[k % {ROUNDS} + 1]) % {PRIME} * {column(1)}[k % {ROUNDS} + 1] % {PRIME} AS x
      FROM walk, n WHERE k = 0 OR k % {ROUNDS} > 0 OR l * a + r >= n))),
p AS (SELECT row_no, l * a + r AS place FROM walk, n WHERE k > 0 AND k % {ROUNDS} = 0 AND l * a + r < n)
SELECT doc_id, cast(size AS bigint) AS size, text_crc32, 'rows' AS law, cast(place % {SHARDS} AS integer) AS shard,
  cast(place // {SHARDS} AS bigint) AS slot, cast(NULL AS integer) AS grown_shard
FROM c JOIN p USING (row_no)"""


ORACLE = _oracle()
