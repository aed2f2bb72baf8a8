"""Feistel shards: the permutation itself, its inverse, and whole tables against plain Python."""

import zlib
from collections import Counter, defaultdict

import llm_fixtures as X
import pytest
from pyspark.sql import functions as F

from churnlens.llm import catalog, numbering, sharding
from churnlens.llm import text as T

ROWS = X.corpus()


def plain(n, number, seed=sharding.SEED):
    """The permutation written plainly: Feistel rounds modulo the side, again until below n."""
    keys, a, p = sharding.Permutation(n, seed).keys, sharding.Permutation(n, seed).side, sharding.PRIME
    while True:
        left, right = divmod(number, a)
        for add, mul, again in keys:
            x = (right + add) % p * mul % p
            x = (x ^ (x >> 16)) * again % p
            left, right = right, (left + (x ^ (x >> 15)) % a) % a
        number = left * a + right
        if number < n:
            return number


@pytest.mark.parametrize("n", [1, 2, 3, 7, 24, 25, 26, 100, 101, 1000, 4097])
def test_permutation_and_its_inverse(spark, n):
    there = sharding.Permutation(n).forward(spark.range(n), "id", "place")
    rows = sharding.Permutation(n).inverse(there, "place", "back").collect()
    assert sorted(r["place"] for r in rows) == list(range(n))
    assert all(r["back"] == r["id"] and r["place"] == plain(n, r["id"]) for r in rows)


def test_permutation_of_large_numbers(spark):
    n = 10**15 + 37
    numbers = spark.range(500).select((F.col("id") * 1_999_999_999_993).alias("id"))
    there = sharding.Permutation(n).forward(numbers, "id", "place")
    rows = sharding.Permutation(n).inverse(there, "place", "back").collect()
    assert all(r["back"] == r["id"] and r["place"] == plain(n, r["id"]) for r in rows)


def test_long_walks_come_to_an_end(spark, monkeypatch):
    monkeypatch.setattr(sharding, "SHORT_WALK", 1)
    places = [r["place"] for n in (2, 5, 10, 17, 26) for r in sharding.Permutation(n, "w", rounds=2).forward(spark.range(n), "id", "place").collect()]
    assert Counter(places) == Counter(x for n in (2, 5, 10, 17, 26) for x in range(n))


def test_seeds_give_other_orders_that_look_shuffled(spark):
    n = 4800
    got = {}
    for seed in ("a", "b"):
        rows = sharding.Permutation(n, seed).forward(spark.range(n), "id", "place").orderBy("id").collect()
        got[seed] = [r["place"] for r in rows]
        neighbours = sum(abs(x - y) == 1 for x, y in zip(got[seed], got[seed][1:]))
        assert neighbours < 20
        of_first = Counter(p % 24 for p in got[seed][: n // 2])
        assert max(of_first.values()) < 150 and min(of_first.values()) > 55
    assert sum(x == y for x, y in zip(got["a"], got["b"])) < 20


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    return X.folder(tmp_path_factory.mktemp("shards"), spark, ROWS)


def test_shards(spark, data):
    rows = catalog.QUERIES["op12_feistel_shards"](spark, data).collect()
    raw = lambda t: (t or "").encode()
    assert X.as_counter([(r["doc_id"], r["size"], r["text_crc32"]) for r in rows]) == X.as_counter((i, len(raw(t)) + 8, zlib.crc32(raw(t))) for i, t, *_ in ROWS)
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        assert r["law"] == "rows" and r["grown_shard"] is None
    assert set(slots) == set(range(24)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    ordered = sorted((i, t or "") for i, t, *_ in ROWS if i is not None)
    of = {i: plain(len(ROWS), k) for k, (i, _) in enumerate(ordered)}
    once = {i for i, c in Counter(i for i, _ in ordered).items() if c == 1}
    assert all((r["shard"], r["slot"]) == (of[r["doc_id"]] % 24, of[r["doc_id"]] // 24) for r in rows if r["doc_id"] in once)


def test_shards_do_not_depend_on_partitions(spark, data):
    docs = T.read(spark, data, "documents").select("doc_id", F.md5("text").alias("_digest"))
    one = sharding.place(docs.repartition(1), sharding.text_order()).collect()
    many = sharding.place(docs.repartition(17, "_digest"), sharding.text_order(), seed=sharding.SEED).collect()
    assert X.as_counter(one) == X.as_counter(many)


def test_equal_rows_spread_over_partitions_when_numbered(spark, monkeypatch):
    written, write = [], numbering.materialize
    monkeypatch.setattr(numbering, "materialize", lambda df: written.append(write(df)) or written[-1])
    hot = spark.range(0, 4000, 1, 4).select(F.lit(None).cast("long").alias("k"))
    numbered = numbering.row_numbers(hot, [F.col("k")])
    assert sorted(r["row_no"] for r in numbered.collect()) == list(range(4000))
    sizes = [r["n"] for r in written[0].groupBy(F.input_file_name()).agg(F.count("*").alias("n")).collect()]
    assert len(sizes) >= 6 and max(sizes) < 1500


def test_written_shards_hold_every_row_in_slot_order(spark, data, tmp_path):
    docs = T.read(spark, data, "documents").withColumns({"shard": F.lit(7), "slot": F.lit("x"), "a.b": F.lit(1)})
    out = sharding.write_shards(docs, str(tmp_path / "s"), n_shards=5)
    rows = out.select("shard", "slot", "row.doc_id", "row.text").collect()
    assert X.as_counter((r["doc_id"], r["text"]) for r in rows) == X.as_counter((i, t) for i, t, *_ in ROWS)
    assert sorted((r["shard"], r["slot"]) for r in rows) == sorted((k % 5, k // 5) for k in range(len(ROWS)))
    assert out.schema["row"].dataType.fieldNames()[-3:] == ["shard", "slot", "a.b"]
