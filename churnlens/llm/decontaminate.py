"""Benchmark decontamination by suffix arrays over the training words.

The test items' words are numbered; training words that no item has are 0 and end every match.  Each
shard (a chunk of whole texts) gets a suffix array of its word positions, sorted by the numbers of
the words that follow, as far as the longest window; a suffix that meets a 0 or the text's end before
the shortest window is left out, as no window can stand there.  Every window of the items (each start
of an item is a test suffix, cut at the window's length) is looked up by binary search; the range of
equal prefixes gives all its places.  Windows that follow one another in an item and in a text are
one longer verbatim match.

Test items are dealt by hash into as many blocks as keep a block's text at about ``block_bytes``;
each block is broadcast and is one pass over the documents.  Passes are brought together by the rows'
kept columns and text digest, so any number of items works.

Null or empty texts have no words and no hits; null items or items without words have no windows.
Items with equal ids count once, a null id as the empty string.  Rows of documents are judged one by
one, so repeated rows agree.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnlens.llm import text as T

WINDOW = 13
BLOCK_BYTES = 8 << 20
FILTER_BITS = 20


@dataclass
class TestSet:
    """Distinct windows of a block of items.  ``keys`` are their words' numbers as big-endian bytes."""

    word_hash: np.ndarray  # sorted; the word at place k has number k + 1
    seen: np.ndarray
    low: np.ndarray  # least and greatest key that starts with the window's words
    high: np.ndarray
    length: np.ndarray
    place_first: np.ndarray  # places of window k: place_first[k]..place_first[k + 1]
    place_item: np.ndarray  # class of items with equal words
    place_at: np.ndarray
    ids: list[list[str]]  # the ids of a class
    window: int
    kind: np.dtype


def prepare(items: list[tuple[str | None, str | None]], window: int = WINDOW) -> TestSet:
    """Number the items' words and gather their distinct windows; equal items form one class."""
    classes: dict[bytes, tuple[np.ndarray, set[str]]] = {}
    if items:
        for c in T.chunks(pa.array([t for _, t in items], pa.string())):
            w = T.words(c, T.ALNUM, True)
            for r in range(c.hi - c.lo):
                h = w.hash[w.first[r] : w.first[r + 1]]
                if len(h):
                    classes.setdefault(h.tobytes(), (h, set()))[1].add(items[c.lo + r][0] or "")
    rows = [h for h, _ in classes.values()]
    word_hash = np.unique(np.concatenate(rows)) if rows else np.zeros(0, T.U64)
    seen = np.zeros(1 << FILTER_BITS, bool)
    seen[(word_hash & T.U64(len(seen) - 1)).astype(np.int64)] = True
    kind = np.dtype(">u2") if len(word_hash) < (1 << 16) - 1 else np.dtype(">u4")
    places: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
    for k, h in enumerate(rows):
        number = (np.searchsorted(word_hash, h) + 1).astype(kind)
        for at in range(max(1, len(h) - window + 1)):
            places[number[at : at + window].tobytes()].append((k, at))
    width, size = window * kind.itemsize, kind.itemsize
    names = sorted(places)
    table = np.array([p for n in names for p in places[n]], np.int64).reshape(-1, 2)
    return TestSet(
        word_hash,
        seen,
        np.array([n.ljust(width, b"\0") for n in names], f"S{width}"),
        np.array([n.ljust(width, b"\xff") for n in names], f"S{width}"),
        np.array([len(n) // size for n in names], np.int64),
        np.concatenate([[0], np.cumsum([len(places[n]) for n in names])]).astype(np.int64),
        table[:, 0],
        table[:, 1],
        [sorted(ids) for _, ids in classes.values()],
        window,
        kind,
    )


def number_words(test: TestSet, hashes: np.ndarray) -> np.ndarray:
    out = np.zeros(len(hashes), np.int64)
    maybe = np.flatnonzero(test.seen[(hashes & T.U64(len(test.seen) - 1)).astype(np.int64)])
    at = np.minimum(np.searchsorted(test.word_hash, hashes[maybe]), len(test.word_hash) - 1)
    hit = test.word_hash[at] == hashes[maybe]
    out[maybe[hit]] = at[hit] + 1
    return out


def suffix_array(test: TestSet, number: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in the order of the numbers that follow them, and these numbers (0 from a match's end on)."""
    n = len(number)
    stop = np.flatnonzero((number == 0) | np.r_[row[1:] != row[:-1], True]) if n else np.zeros(0, np.int64)
    # a run ends before a 0, or after the last word of a text
    end_at = np.where(number[stop] == 0, stop, stop + 1)
    run_end = end_at[np.searchsorted(stop, np.arange(n))] if n else stop
    places = np.flatnonzero((number > 0) & (run_end - np.arange(n) >= test.length.min()))
    keys = np.zeros((len(places), test.window), test.kind)
    for k in range(test.window):
        live = places + k < run_end[places]
        keys[live, k] = number[places[live] + k]
    flat = np.ascontiguousarray(keys).view(f"S{test.window * test.kind.itemsize}").ravel()
    order = np.argsort(flat, kind="stable")
    return places[order], flat[order]


def occurrences(test: TestSet, suffixes: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every (window, place) pair, by binary search of each window in the suffix array."""
    lo, hi = np.searchsorted(keys, test.low, "left"), np.searchsorted(keys, test.high, "right")
    count = hi - lo
    window = np.repeat(np.arange(len(count)), count)
    at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo, count)
    return window, suffixes[at]


def longest_matches(test: TestSet, window: np.ndarray, place: np.ndarray, row: np.ndarray, n_rows: int) -> tuple[np.ndarray, list[set[int]]]:
    """Per row: words of the longest verbatim match with an item, and the classes of items that match."""
    count = test.place_first[window + 1] - test.place_first[window]
    at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(test.place_first[window], count)
    place, length, item = np.repeat(place, count), np.repeat(test.length[window], count), test.place_item[at]
    diagonal = place - test.place_at[at]
    order = np.lexsort((place, diagonal, item, row[place])) if len(place) else np.zeros(0, np.int64)
    place, length, item, diagonal = place[order], length[order], item[order], diagonal[order]
    of = row[place]
    longest, classes = np.zeros(n_rows, np.int64), [set() for _ in range(n_rows)]
    if len(place):
        fresh = np.r_[True, (of[1:] != of[:-1]) | (item[1:] != item[:-1]) | (diagonal[1:] != diagonal[:-1]) | (place[1:] != place[:-1] + 1)]
        begin = np.flatnonzero(fresh)
        last = np.r_[begin[1:], len(place)] - 1
        np.maximum.at(longest, of[begin], place[last] + length[last] - place[begin])
        for r, k in set(zip(of.tolist(), item.tolist(), strict=True)):
            classes[r].add(k)
    return longest, classes


def scan_chunk(test: TestSet, c: T.Chunk) -> dict[str, list]:
    """Per row of the chunk: words, covered spans of words, longest match, ids of the items found."""
    w = T.words(c, T.ALNUM, True)
    n_rows = c.hi - c.lo
    spans: list[list[dict]] = [[] for _ in range(n_rows)]
    longest, ids = np.zeros(n_rows, np.int64), [[] for _ in range(n_rows)]
    if len(test.length) and len(w.hash):
        suffixes, keys = suffix_array(test, number_words(test, w.hash), w.row)
        window, place = occurrences(test, suffixes, keys)
        if len(place):
            step = np.zeros(len(w.hash) + 1, np.int64)
            np.add.at(step, place, 1)
            np.add.at(step, place + test.length[window], -1)
            hit = np.cumsum(step[:-1]) > 0
            begin = np.flatnonzero(hit & np.r_[True, ~hit[:-1] | (w.row[1:] != w.row[:-1])])
            end = np.flatnonzero(hit & np.r_[~hit[1:] | (w.row[1:] != w.row[:-1]), True]) + 1
            for r, a, b in zip(w.row[begin].tolist(), (begin - w.first[w.row[begin]]).tolist(), (end - w.first[w.row[begin]]).tolist(), strict=True):
                spans[r].append({"begin": a, "end": b})
            longest, classes = longest_matches(test, window, place, w.row, n_rows)
            ids = [sorted({i for k in cl for i in test.ids[k]}) for cl in classes]
    return {"n_words": np.diff(w.first).tolist(), "spans": spans, "longest": longest.tolist(), "items": ids}


SPANS = "array<struct<begin: long, end: long>>"


#: How a span joins the ones before it, which are in order.
JOINED = (
    "if(size(done) > 0 and element_at(done, -1).end >= s.begin, "
    "concat(slice(done, 1, size(done) - 1), array(named_struct('begin', element_at(done, -1).begin, 'end', greatest(element_at(done, -1).end, s.end)))), "
    "concat(done, array(s)))"
)


def list_of_passes(items: DataFrame, id_col: str, text_col: str, block_bytes: int) -> list[tuple[int, int]]:
    """(number of passes, pass) pairs: as many hash classes of items as keep each one's text within ``block_bytes`` on average."""
    size = items.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    n = max(1, -(-size // block_bytes))
    return [(n, k) for k in range(n)]


def collect_block(items: DataFrame, id_col: str, text_col: str, part: tuple[int, int]) -> list[tuple[str | None, str | None]]:
    """The distinct items of one pass; items with equal texts are in the same one."""
    n, k = part
    mine = items.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).where(F.pmod(F.xxhash64("text"), F.lit(n)) == k)
    return sorted(((r["id"], r["text"]) for r in mine.distinct().toLocalIterator()), key=str)


def matches(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, keep: list[str] | None = None, item_id: str = "item_id", item_text: str = "text", text_col: str = "text") -> DataFrame:
    """Columns ``keep`` of every row with n_words, spans, longest and items, over all blocks of items."""
    keep = keep or ["doc_id"]
    spark = docs.sparkSession
    docs = docs.select(*keep, F.col(text_col).alias("_text"))

    blocks = list_of_passes(items, item_id, item_text, block_bytes)

    def one(block: list) -> DataFrame:
        held = spark.sparkContext.broadcast(prepare(block, window))

        def run(batch: pa.RecordBatch) -> dict:
            parts = [scan_chunk(held.value, c) for c in T.chunks(batch.column(batch.num_columns - 1))]
            out = {k: [x for p in parts for x in p[k]] for k in parts[0]}
            many = len(blocks) > 1
            out["digest"] = [hashlib.md5((t or "").encode()).hexdigest() if many else None for t in (batch.column(batch.num_columns - 1).to_pylist() if many else [None] * batch.num_rows)]
            span = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
            kinds = {"n_words": pa.int64(), "spans": span, "longest": pa.int64(), "items": pa.list_(pa.string()), "digest": pa.string()}
            return {k: batch.column(i) for i, k in enumerate(keep)} | {k: pa.array(v, kinds[k]) for k, v in out.items()}

        return T.per_batch(docs, run, T.with_fields(docs, keep, f"n_words long, spans {SPANS}, longest long, items array<string>, digest string"))

    if len(blocks) == 1:
        return one(collect_block(items, item_id, item_text, blocks[0])).drop("digest")
    base, found = None, None
    for ids in blocks:
        part = one(collect_block(items, item_id, item_text, ids))
        base = part.select(*keep, "digest", "n_words") if base is None else base
        hit = part.where(F.size("spans") > 0).dropDuplicates([*keep, "digest"])
        found = hit if found is None else found.unionByName(hit)
    merged = found.groupBy(*keep, "digest").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.max("longest").alias("longest"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    merged = merged.withColumn("spans", F.expr(f"aggregate(array_sort(spans), cast(array() as {SPANS}), (done, s) -> {JOINED})"))
    merged = merged.select(*(F.col(k).alias(f"_{k}") for k in [*keep, "digest"]), "spans", "longest", "items")
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in [*keep, "digest"]]
    on = same[0]
    for x in same[1:]:
        on = on & x
    none = F.expr(f"cast(array() as {SPANS})")
    out = base.join(merged, on, "left")
    return out.select(*keep, "n_words", F.coalesce("spans", none).alias("spans"), F.coalesce("longest", F.lit(0).cast("long")).alias("longest"), F.coalesce("items", F.expr("cast(array() as array<string>)")).alias("items"))


def report(found: DataFrame, keep: list[str], share: int = 20) -> DataFrame:
    """Counts per row; contaminated: a hit, and at least 1 / ``share`` of the words in hits."""
    n_hit = F.expr("aggregate(spans, 0L, (n, s) -> n + s.end - s.begin)")
    out = found.withColumn("n_hit", n_hit)
    return out.select(
        *keep,
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words"))).alias("contaminated"),
        "longest",
    )


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(matches(T.read(spark, sf_dir, "documents"), T.read(spark, sf_dir, "benchmark")), ["doc_id"]).drop("longest")


_WORDS = "regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
ORACLE = f"""
WITH i AS (SELECT coalesce(cast(item_id AS varchar), '') AS item, {_WORDS.format("text")} AS ws FROM benchmark WHERE text IS NOT NULL),
win AS (SELECT DISTINCT item, list_slice(ws, pos, pos + {WINDOW - 1}) AS win
        FROM (SELECT item, ws, unnest(range(1, greatest(1, len(ws) - {WINDOW - 1}) + 1)) AS pos FROM i WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT len(win) AS n FROM win),
d AS (SELECT doc_id, row_number() OVER () AS r, coalesce({_WORDS.format("text")}, []) AS ws FROM documents),
runs AS (SELECT r, unnest(range(1, len(ws) - n + 2)) AS pos, n, ws FROM d, sizes WHERE len(ws) >= n),
hits AS (SELECT r, pos, n, item FROM runs JOIN win ON list_slice(ws, pos, pos + n - 1) = win.win),
places AS (SELECT DISTINCT r, unnest(range(pos, pos + n)) AS p FROM (SELECT DISTINCT r, pos, n FROM hits)),
covered AS (SELECT r, count(*) AS n_hit FROM places GROUP BY r),
found AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
SELECT doc_id, cast(len(ws) AS bigint) AS n_words, cast(coalesce(n_hit, 0) AS bigint) AS n_hit, cast(coalesce(n_items, 0) AS bigint) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN covered USING (r) LEFT JOIN found USING (r)"""
