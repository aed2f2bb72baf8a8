"""N-gram Jaccard join with rare-first prefix filtering, and the components of its links.

Two documents link when the Jaccard similarity of their sets of word n-grams (64-bit fingerprints) is
at least ``percent`` / 100.

1. One pass counts fingerprints into a fixed-width table (``SKETCH`` counters, broadcast); fingerprints
   ordered by (counter, value) are one global order, rare ones first.
2. One pass gives every document its set's digest, size, prefix (the first n - ceil(t n) + 1 of the
   order) and a signature: the set's sizes in 64 ranges of fingerprints.  Documents with equal sets are
   one class; the class's smallest id stands for it from here on.
3. Prefix n-grams shared by several classes are joined: each class meets the hub of each of its n-grams,
   the class with most copies.  Candidates pass the length filter, the positional filter and the suffix
   filter (differences of the signatures' sizes bound how many n-grams the sets do not share).  Each
   pair is then verified once, on whole sets.
4. Linked classes are brought together.  Where the classes of an n-gram are still in several
   components, pairs across components are compared in the same way inside the n-gram's group (cut
   into blocks where it is large), nearest signatures first: ``NEAREST`` partners a class, then ever more, until
   no pair that passes the filters is left unverified.  So every link between components is found,
   while classes already together are not compared again.

Sets are empty for null or word-less texts, which link with nothing; texts of fewer words than n have
their whole sequence as the only element.  A null id takes part under its class's smallest id, and a
class without any id is its own component (null).  Rows that share an id are one node.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnlens.llm import text as T
from churnlens.llm.components import components, extend
from churnlens.session import materialize, materialize_at, release_materialized

SKETCH = 1 << 20
SEGMENT = 1 << 10
RANGES = 64
BLOCK = 2048
NEAREST, WIDEN = 2, 16
#: Up to so many candidate ids are broadcast to pick their texts; beyond, they are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def shingle_sets(c: T.Chunk, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct fingerprints of all rows of a chunk, ordered by (row, fingerprint), and their rows."""
    w = T.words(c, T.NOT_SPACE, True)
    at, h = T.ngram_hash(w, n)
    row = w.row[at]
    few = np.flatnonzero((np.diff(w.first) > 0) & (np.diff(w.first) < n))
    if len(few):
        short = []
        for r in few.tolist():
            x = np.uint64([len(w.hash[w.first[r] : w.first[r + 1]])])
            for v in w.hash[w.first[r] : w.first[r + 1]]:
                x = T.mix(x * T.U64(0xA24BAED4963EE407) + v)
            short.append(x[0])
        h, row = np.concatenate([h, np.array(short, T.U64)]), np.concatenate([row, few])
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    fresh = np.r_[True, (h[1:] != h[:-1]) | (row[1:] != row[:-1])][: len(h)]
    return h[fresh], row[fresh]


def counters(docs: DataFrame, n: int, text_col: str) -> np.ndarray:
    """How many documents' sets fall into each of the SKETCH counters, over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SKETCH, np.uint32)
        for batch in batches:
            for c in T.chunks(batch.column(0), T.SMALL_CHUNK_BYTES):
                h, _ = shingle_sets(c, n)
                total += np.bincount((h >> T.U64(44)).astype(np.int64), minlength=SKETCH).astype(np.uint32)
        used = np.flatnonzero(total.reshape(-1, SEGMENT).any(1))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array([total[s * SEGMENT : (s + 1) * SEGMENT].tobytes() for s in used.tolist()], pa.binary())], names=["segment", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for s, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = np.frombuffer(x, np.uint32).astype(np.uint64)
                total[s] = total[s] + part if s in total else part
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([np.minimum(x, 0xFFFFFFFF).astype(np.uint32).tobytes() for x in total.values()], pa.binary())], names=["segment", "counts"])

    parts = T.map_batches(docs.select(text_col), run, "segment long, counts binary")
    out = np.zeros(SKETCH, np.uint32)
    for r in T.map_batches(parts.repartition("segment"), add, "segment long, counts binary").toLocalIterator():
        out[r["segment"] * SEGMENT : (r["segment"] + 1) * SEGMENT] = np.frombuffer(r["counts"], np.uint32)
    return out


def signed(docs: DataFrame, n: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """Per row: id, set size, digest (null for the empty set), prefix in the global order, signature."""
    held = docs.sparkSession.sparkContext.broadcast(counters(docs, n, text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = held.value
        for batch in batches:
            if not batch.num_rows:
                continue
            size, digest, prefix, ranges = [], [], [], []
            for c in T.chunks(batch.column(1), T.SMALL_CHUNK_BYTES):
                h, row = shingle_sets(c, n)
                first = np.searchsorted(row, np.arange(c.hi - c.lo + 1))
                k = np.diff(first)
                size += k.tolist()
                # two independent 64-bit sums of the mixed elements name the set
                sums = [np.concatenate([[T.U64(0)], np.cumsum(T.mix(h ^ T.U64(salt)))]) for salt in (0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179)]
                names = np.stack([s[first[1:]] - s[first[:-1]] for s in sums], 1)
                digest += [x.tobytes() if m else None for x, m in zip(names, k.tolist(), strict=True)]
                rare = np.lexsort((h, count[(h >> T.U64(44)).astype(np.int64)], row))
                keep = k - (percent * k + 99) // 100 + 1
                place = np.arange(len(h)) - first[row]
                chosen = h[rare][place < keep[row]].view(np.int64)
                cuts = np.concatenate([[0], np.cumsum(np.where(k > 0, keep, 0))])
                prefix.append(pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(chosen)))
                table = np.bincount(row * RANGES + ((h >> T.U64(20)) & T.U64(RANGES - 1)).astype(np.int64), minlength=(c.hi - c.lo) * RANGES)
                table = np.minimum(table, 255).astype(np.uint8).reshape(-1, RANGES)
                ranges += [x.tobytes() for x in table]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size, pa.int64()), pa.array(digest, pa.binary()), pa.concat_arrays(prefix), pa.array(ranges, pa.binary())], names=["id", "n", "digest", "prefix", "ranges"]
            )

    kind = dict(docs.dtypes)[id_col]
    return T.map_batches(docs.select(id_col, text_col), run, f"id {kind}, n long, digest binary, prefix array<long>, ranges binary")


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The sorted batches of a partition as tables that end where a group of equal keys ends."""
    rest: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = table if rest is None else pa.concat_tables([rest, table])
        marks = [np.asarray(table[k]) for k in keys]
        differs = np.zeros(table.num_rows - 1, bool)
        for m in marks:
            differs |= m[1:] != m[:-1]
        cut = np.flatnonzero(differs)
        if len(cut):
            yield table.slice(0, int(cut[-1]) + 1)
            rest = table.slice(int(cut[-1]) + 1)
        else:
            rest = table
    if rest is not None and rest.num_rows:
        yield rest


def required(nx, ny, percent: int):
    """The least overlap of sets of these sizes that makes a link, for Spark columns (as SQL text) or numbers."""
    return f"((({percent}) * ({nx} + {ny}) + {99 + percent}) div {100 + percent})"


def filters(percent: int) -> str:
    """Length and positional filter of a candidate pair x, y that meets at places px, py of its prefixes."""
    need = required("nx", "ny", percent)
    return f"100 * least(nx, ny) >= {percent} * greatest(nx, ny) AND 1 + least(nx - px - 1, ny - py - 1) >= {need}"


def suffix_filter(x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Whether pairs of signatures can belong to linked sets, and the bound on what they do not share."""
    apart = np.abs(x.astype(np.int16) - y.astype(np.int16)).sum(-1, dtype=np.int64)
    need = (percent * (nx + ny) + 99 + percent) // (100 + percent)
    return apart <= nx + ny - 2 * need, apart


def verify(pairs: DataFrame, docs: DataFrame, n: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """The pairs (a, b) that link, on whole sets; every pair once."""
    ids = materialize(pairs.select(F.explode(F.array("a", "b")).alias("_id")).distinct())
    wanted = F.broadcast(ids) if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else ids
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(wanted, "_id", "left_semi")

    def sets(batch: pa.RecordBatch) -> dict:
        out = []
        for c in T.chunks(batch.column(1), T.SMALL_CHUNK_BYTES):
            h, row = shingle_sets(c, n)
            first = np.searchsorted(row, np.arange(c.hi - c.lo + 1)).tolist()
            out += [h[i:j].tobytes() for i, j in zip(first[:-1], first[1:], strict=True)]
        return {"id": batch.column(0), "elements": pa.array(out, pa.binary())}

    kind = dict(docs.dtypes)[id_col]
    held = T.per_batch(texts, sets, f"id {kind}, elements binary")
    both = pairs.join(held.select(F.col("id").alias("a"), F.col("elements").alias("x")), "a").join(held.select(F.col("id").alias("b"), F.col("elements").alias("y")), "b")

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                u, v = np.frombuffer(x.as_buffer(), T.U64), np.frombuffer(y.as_buffer(), T.U64)
                both_sorted = np.sort(np.concatenate([u, v]), kind="stable")
                shared = int((both_sorted[1:] == both_sorted[:-1]).sum())
                keep.append((100 + percent) * shared >= percent * (len(u) + len(v)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return T.map_batches(both.select("a", "b", "x", "y"), linked, f"a {kind}, b {kind}")


def inside_groups(percent: int, nearest: int, hub_checked: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Candidates across components among the rows of each (token, low, high) group: at most ``nearest``
    partners for each row, those with the closest signatures, and whether any were left for later."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["token", "low", "high"]):
            t, lo, hi, side, node, comp, size, at, hub = (np.asarray(table[k].combine_chunks()) for k in ("token", "low", "high", "block", "id", "component", "n", "pos", "hub"))
            ranges = np.frombuffer(b"".join(table["ranges"].to_pylist()), np.uint8).reshape(-1, RANGES)
            cut = np.flatnonzero(np.r_[True, (t[1:] != t[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1]), True])
            a, b, more = [], [], []
            for i, j in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                left = np.flatnonzero(side[i:j] == lo[i]) + i
                right = np.flatnonzero(side[i:j] == hi[i]) + i
                for part in range(0, len(left), 128):
                    l = left[part : part + 128]  # noqa: E741
                    nx, ny = size[l][:, None], size[right][None, :]
                    need = (percent * (nx + ny) + 99 + percent) // (100 + percent)
                    ok = comp[l][:, None] != comp[right][None, :]
                    ok &= 100 * np.minimum(nx, ny) >= percent * np.maximum(nx, ny)
                    ok &= 1 + np.minimum(nx - at[l][:, None] - 1, ny - at[right][None, :] - 1) >= need
                    if lo[i] == hi[i]:
                        ok &= node[l][:, None] < node[right][None, :]
                    if hub_checked:  # pairs with the hub were candidates before
                        ok &= (node[l] != hub[i])[:, None] & (node[right] != hub[i])[None, :]
                    p, q = np.nonzero(ok)
                    if not len(p):
                        continue
                    p, q = l[p], right[q]
                    near, apart = suffix_filter(ranges[p], ranges[q], size[p], size[q], percent)
                    p, q, apart = p[near], q[near], apart[near]
                    order = np.lexsort((node[q], apart, p))
                    p, q = p[order], q[order]
                    begin = np.flatnonzero(np.r_[True, p[1:] != p[:-1]][: len(p)])
                    rank = np.arange(len(p)) - np.repeat(begin, np.diff(np.r_[begin, len(p)]))
                    keep = rank < nearest
                    if len(p) and not keep.all():
                        more.append(len(a))
                    a += np.minimum(node[p], node[q])[keep].tolist()
                    b += np.maximum(node[p], node[q])[keep].tolist()
            flag = np.zeros(len(a), bool)
            flag[np.array(more, np.int64)] = True
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(flag)], names=["a", "b", "more"])

    return run


def join(docs: DataFrame, n: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text", nearest: int = NEAREST, block: int = BLOCK) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id, copies (rows with an equal set).  Ids are
    integers; number rows first whose ids are not (as the pipeline does)."""
    if docs.schema[id_col].dataType.typeName() not in ("long", "integer", "short", "byte"):
        raise TypeError(f"{id_col} is {docs.schema[id_col].dataType.simpleString()}; the join takes integer ids")
    with T.small_batches(docs.sparkSession):
        return _join(docs, n, percent, id_col, text_col, nearest, block)


def _join(docs: DataFrame, n: int, percent: int, id_col: str, text_col: str, nearest: int, block: int) -> DataFrame:
    spark = docs.sparkSession
    kept, scratch = [], []

    def hold(df: DataFrame, keep: bool = False) -> DataFrame:
        out, path = materialize_at(df)
        (kept if keep else scratch).append(path)
        return out

    rows = hold(signed(docs, n, percent, id_col, text_col), keep=True)
    classes = hold(rows.where("digest is not null").groupBy("digest").agg(F.min(F.struct("id", "n", "prefix", "ranges")).alias("r"), F.min("id").alias("id"), F.count("*").alias("copies")), keep=True)
    nodes = hold(classes.where("id is not null").select("id", "r.n", "r.prefix", "r.ranges", "copies"))
    prefix = nodes.select("id", "n", "copies", F.posexplode("prefix").alias("pos", "token"))
    hubs = prefix.groupBy("token").agg(F.count("*").alias("members"), F.max(F.struct("copies", F.expr("-id").alias("minus"), "n", "pos")).alias("h")).where("members > 1")
    hubs = hubs.select("token", "members", F.expr("-h.minus").alias("hub"), F.col("h.n").alias("hub_n"), F.col("h.pos").alias("hub_pos"))
    met = hold(prefix.drop("copies").join(hubs, "token"))
    star = met.where("id <> hub").withColumnsRenamed({"n": "nx", "hub_n": "ny", "pos": "px", "hub_pos": "py"}).where(filters(percent))
    star = star.select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct()
    sizes = nodes.select("id", "n", "ranges")
    star = star.join(sizes.withColumnsRenamed({"id": "a", "n": "na", "ranges": "ra"}), "a").join(sizes.withColumnsRenamed({"id": "b", "n": "nb", "ranges": "rb"}), "b")

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, RANGES) for k in (4, 5))
                ok, _ = suffix_filter(x, y, np.asarray(batch.column(2)), np.asarray(batch.column(3)), percent)
                yield batch.select([0, 1]).filter(pa.array(ok))

    pairs = hold(T.map_batches(star.select("a", "b", "na", "nb", "ra", "rb"), near, "a long, b long"))
    tested = pairs
    labels = hold(components(verify(pairs, docs, n, percent, id_col, text_col)))
    while True:
        several = met.where("members > 2").drop("hub_n", "hub_pos")
        named = several.join(labels.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
        mixed = named.groupBy("token").agg(F.min("component").alias("_lo"), F.max("component").alias("_hi")).where("_lo < _hi").select("token")
        open_rows = named.join(mixed, "token").join(sizes.select("id", "ranges"), "id")
        n_blocks = F.expr(f"(members + {block - 1}) div {block}")
        open_rows = open_rows.withColumn("block", F.pmod(F.xxhash64("id"), n_blocks)).withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), n_blocks - 1)))
        open_rows = open_rows.select("token", F.least("block", "_other").alias("low"), F.greatest("block", "_other").alias("high"), "block", "id", "component", "n", "pos", "hub", "ranges")
        dealt = open_rows.repartition("token", "low", "high").sortWithinPartitions("token", "low", "high", "id")
        found = hold(T.map_batches(dealt, inside_groups(percent, nearest, True), "a long, b long, more boolean"))
        fresh = hold(found.select("a", "b").distinct().join(tested, ["a", "b"], "left_anti"))
        more = not found.where("more").limit(1).isEmpty()
        if not fresh.isEmpty():
            new = hold(verify(fresh, docs, n, percent, id_col, text_col))
            tested = tested.unionByName(fresh)
            if not new.isEmpty():
                labels = hold(extend(labels, new))
        if not more:
            break
        nearest *= WIDEN
    labels, path = materialize_at(labels)
    release_materialized(spark, scratch)
    named = classes.select("digest", "copies", "id").join(labels.withColumnRenamed("node", "id"), "id", "left").select("digest", "copies", F.coalesce("component", "id").alias("component_id"))
    out = rows.select("id", "n", "digest").join(named, "digest", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"), F.coalesce("copies", F.lit(1).cast("long")).alias("copies"))


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(T.read(spark, sf_dir, "documents"))


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS r, doc_id,
         coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
sh AS (SELECT DISTINCT r, list_slice(ws, i, i + 3) AS s FROM (SELECT r, ws, unnest(range(1, greatest(1, len(ws) - 3) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT r, count(*) AS n FROM sh GROUP BY r),
pairs AS (SELECT a.r AS a, b.r AS b, count(*) AS k FROM sh a JOIN sh b ON a.s = b.s AND a.r <> b.r GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
reach AS (SELECT r, r AS m FROM w UNION SELECT links.b, m FROM reach JOIN links ON links.a = reach.r)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, copies FROM w LEFT JOIN n USING (r)
JOIN (SELECT reach.r, min(o.doc_id) AS component_id FROM reach JOIN w o ON o.r = reach.m GROUP BY reach.r) c USING (r)
JOIN (SELECT r, CASE WHEN len(s) = 0 THEN 1 ELSE count(*) OVER (PARTITION BY s) END AS copies
      FROM (SELECT w.r, coalesce(list_sort(list(sh.s) FILTER (sh.s IS NOT NULL)), []) AS s FROM w LEFT JOIN sh USING (r) GROUP BY w.r)) USING (r)
"""
