"""Repeated passages by blockwise suffix sorting with a difference cover.

Every byte position of every text starts a suffix; two suffixes tie when their first ``length`` bytes
are equal.  A byte goes if a tie with a suffix of a document with a smaller id covers it.

1. Documents are put in id order by one range shuffle and cut into blocks of whole documents, so that
   "smaller id" becomes "earlier block" between blocks.  Blocks are written once.
2. Cover sample: the positions p with p mod V in a difference cover D, 6 of 31.  For any two positions
   i, j there is a step below V that takes both into the sample, so suffixes that tie over ``length``
   bytes have sample suffixes that tie over length - V + 1 bytes at the same step.  Sample suffixes
   are dealt into buckets by their length - V + 1 bytes and each bucket is sorted by itself; a sample
   suffix's rank is unique, or shared with another document.
3. Suffixes without a shared sample rank within V positions cannot tie; their order is settled and they
   are dropped.  The rest, the long ties, are dealt into buckets by their ``length`` bytes; each bucket
   is sorted by itself, by the suffix's fingerprint over ``length`` bytes, and answers for every block
   whether an earlier block holds the same.
4. The answers go back to the blocks, which settle ties inside the block and remove the bytes.

Between blocks and buckets only fingerprints travel (8 bytes a distinct suffix and block), back comes
one bit for each.  Equal keys meet in one bucket and distinct keys spread over all of them, also those
that share a head such as an indentation, so a bucket's size is bounded by the number of buckets, which
follows the input; a passage that a third of all documents hold sends one fingerprint a block and
suffix.  Stages 2 and 3 run in as many passes over the buckets as keep what a pass shuffles below the
input's own size.

A fingerprint is 64 bits beside the bucket's number, which mixes it with the first bytes' fingerprint.
Null or empty texts have no suffixes and lose nothing.  Rows with equal ids are not smaller than one
another; null ids are larger than all others and equal to one another.
"""

from __future__ import annotations

import gc
import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnlens.llm import text as T
from churnlens.llm.jaccard import whole_groups
from churnlens.session import ensure_checkpoint_dir, materialize_at, release_materialized

U64 = T.U64
LENGTH = 50
#: A perfect difference set modulo 31; every residue is a difference of two of its members.
V, COVER = 31, (1, 5, 11, 24, 25, 27)
BLOCK_BYTES = 2 << 20
FILE_BYTES = 32 << 20
#: Suffixes that a bucket is meant to hold.
BUCKET_SUFFIXES = 2_000_000
#: Suffixes whose fingerprints are found at once, so that what is found on the way stays in the processor's cache.
PIECE = 1 << 14


def write_whole(df: DataFrame) -> tuple[DataFrame, str]:
    """Write a table whose files are one row group each, so that no reader cuts a file's rows apart."""
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/suffixes-{uuid.uuid4().hex}"
    df.write.option("parquet.block.size", (1 << 31) - 1).parquet(path)
    return df.sparkSession.read.parquet(path), path


def drop_shuffles(spark: SparkSession) -> None:
    """Let go of finished plans now: Spark deletes a shuffle's files when the driver collects what refers to it,
    which an idle driver may put off while passes pile up on the executors' disks."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def cut_blocks(rows: DataFrame, block_bytes: int) -> DataFrame:
    """Number the rows' blocks; rows are sorted by id in their partitions.  ``rank`` orders blocks, and
    is shared by blocks that hold rows of one id only, which is more than a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId() << 32
        block, rank, size, seq, last, alone = 0, 0, 0, 0, object(), True
        for batch in batches:
            ids, sizes = batch.column(0).to_pylist(), np.diff(T_offsets(batch.column(1))).tolist()
            blocks, ranks, seqs = [], [], []
            for i, n in zip(ids, sizes, strict=True):
                if size and size + n > block_bytes:
                    if i != last:
                        block, size = block + 1, 0
                        rank, alone = block, True
                    elif alone:  # more rows of the one id that the block holds
                        block, size = block + 1, 0
                elif i != last and size and rank != block:
                    block, size = block + 1, 0
                    rank, alone = block, True
                if size and i != last:
                    alone = False
                last, size = i, size + n
                blocks.append(part + block)
                ranks.append(part + rank)
                seqs.append(seq)
                seq += 1
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array(ranks, pa.int64()), pa.array(seqs, pa.int64()), batch.column(0), batch.column(1)], names=["block", "rank", "seq", "id", "text"])

    kind = dict(rows.dtypes)["id"]
    return rows.mapInArrow(run, f"block long, rank long, seq long, id {kind}, text string")


def T_offsets(texts: pa.Array) -> np.ndarray:
    texts = texts.cast(pa.large_string()).fill_null("")
    return np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]


class Block:
    """Bytes of a block's documents with the fingerprints' running sums."""

    def __init__(self, table: pa.Table):
        table = table.sort_by("seq")
        self.table = table
        texts = table["text"].combine_chunks().cast(pa.large_string()).fill_null("")
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = texts.buffers()[2]
        self.offsets = offsets - offsets[0]
        self.data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
        self.sums = T.prefix_sums(self.data)

    def starts(self, length: int) -> np.ndarray:
        """Marks of the positions with ``length`` bytes of their document before them."""
        out = np.zeros(len(self.data), bool)
        for a, b in zip(self.offsets[:-1].tolist(), self.offsets[1:].tolist(), strict=True):
            out[a : max(a, b - length + 1)] = True
        return out

    def document(self, at: np.ndarray) -> np.ndarray:
        return np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.offsets))[at]

    def samples(self, length: int) -> np.ndarray:
        """Positions of the cover sample with length - V + 1 bytes after them."""
        width = length - V + 1
        sizes = np.diff(self.offsets)
        pattern = np.resize(np.isin(np.arange(V), COVER), int(sizes.max(initial=0)))
        out = np.zeros(len(self.data), bool)
        for a, n in zip(self.offsets[:-1].tolist(), np.maximum(sizes - width + 1, 0).tolist(), strict=True):
            out[a : a + n] = pattern[:n]
        return np.flatnonzero(out)

    def keys(self, at: np.ndarray, length: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """Fingerprints of the first ``length`` bytes from each position, and buckets by all of them.

        The first bytes' running sum goes in too: keys whose fingerprints agree but whose heads differ
        mostly part by their buckets."""
        _, down = T.powers(len(self.sums))
        key, bucket = np.empty(len(at), U64), np.empty(len(at), np.int64)
        for i in range(0, len(at), PIECE):
            j = at[i : i + PIECE]
            begin, scale = self.sums[j], down[j]
            k = T.mix((self.sums[j + length] - begin) * scale + U64(length * 0x2545F4914F6CDD1D % (1 << 64)))
            spread = T.mix((self.sums[j + length * 2 // 5] - begin) * scale + k * U64(0xA24BAED4963EE407))
            key[i : i + PIECE] = k
            bucket[i : i + PIECE] = ((spread >> U64(32)) * U64(buckets)) >> U64(32)
        return key, bucket


def in_order(keys: np.ndarray, buckets: np.ndarray | None = None) -> np.ndarray:
    """The order of (bucket, key); equal pairs stand together in any order.

    One sort of plain numbers that hold the bucket, the key's upper bits and the entry's place gives the order,
    but for the few entries that agree in these bits and not in the key, which are ordered by themselves."""
    low = int(buckets.max()).bit_length() if buckets is not None and len(buckets) else 0
    place = len(keys).bit_length()
    if low + place >= 64:
        return np.lexsort((keys, buckets))
    packed = ((buckets.astype(U64) << U64(64 - low)) | (keys >> U64(low))) if low else keys.copy()
    packed &= ~U64((1 << place) - 1)
    packed |= np.arange(len(keys), dtype=U64)
    packed.sort()
    order = (packed & U64((1 << place) - 1)).astype(np.int64)
    packed >>= U64(place)
    alike = packed[1:] == packed[:-1]
    after = np.flatnonzero(alike) + 1
    after = after[keys[order[after]] != keys[order[after - 1]]]
    if len(after):
        group = np.cumsum(np.r_[False, ~alike])
        among = np.zeros(group[-1] + 1, bool)
        among[group[after]] = True
        where = np.flatnonzero(among[group])
        entry = order[where]
        order[where] = entry[np.lexsort((keys[entry], group[where]))]
    return order


def distinct(keys: np.ndarray, buckets: np.ndarray, n_buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The order of (bucket, key), which of the sorted entries are the first of their kind, and the keys and buckets
    of these first ones."""
    order = in_order(keys, buckets)
    k, ends = keys[order], np.cumsum(np.bincount(buckets, minlength=n_buckets))
    fresh = np.ones(len(k), bool)
    np.not_equal(k[1:], k[:-1], out=fresh[1:])
    fresh[ends[ends < len(k)]] = True
    kinds = np.cumsum(fresh)
    return order, fresh, k[fresh], np.repeat(np.arange(n_buckets), np.diff(np.r_[0, np.r_[0, kinds][ends]]))


def questions(blocks: DataFrame, pick: Callable[[Block], np.ndarray], length: int, buckets: int, part: int, parts: int) -> DataFrame:
    """Per block and bucket of this pass: the distinct fingerprints of the picked positions, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["block"]):
            marks = np.asarray(table["block"])
            cut = np.flatnonzero(np.r_[True, marks[1:] != marks[:-1], True]).tolist()
            for i, j in zip(cut[:-1], cut[1:], strict=True):
                block = Block(table.slice(i, j - i))
                at = pick(block)
                keys, bucket = block.keys(at, length, buckets)
                mine = (bucket >= part * (buckets // parts)) & (bucket < (part + 1) * (buckets // parts))
                _, _, k, b = distinct(keys[mine], bucket[mine], buckets)
                ends = np.flatnonzero(np.r_[b[1:] != b[:-1], True][: len(b)]) + 1
                begins = np.r_[0, ends[:-1]][: len(ends)]
                rank = table["rank"][i].as_py()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(b[begins]), pa.array(np.full(len(ends), marks[i])), pa.array(np.full(len(ends), rank)), pa.array([k[x:y].tobytes() for x, y in zip(begins.tolist(), ends.tolist(), strict=True)], pa.binary())],
                    names=["bucket", "block", "rank", "keys"],
                )

    return blocks.mapInArrow(run, "bucket long, block long, rank long, keys binary")


def sort_buckets(asked: DataFrame, earlier: bool) -> DataFrame:
    """Sort each bucket by itself.  Answers one bit a fingerprint: is it in another block (``earlier``:
    in one of smaller rank)?"""

    def run(table: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x.as_buffer(), T.U64) for x in table["keys"].combine_chunks()]
        sizes = np.array([len(p) for p in parts])
        keys, owner = np.concatenate(parts), np.repeat(np.arange(len(parts)), sizes)
        order = in_order(keys)
        k = keys[order]
        again = k[1:] == k[:-1]
        bit = np.zeros(len(keys), bool)
        # only keys that several blocks hold can be answered with a yes
        several = np.flatnonzero(np.r_[again, False] | np.r_[False, again])
        order = order[several]
        if earlier and len(several):
            k, rank = k[several], np.asarray(table["rank"])[owner[order]]
            fresh = np.r_[True, k[1:] != k[:-1]]
            least = np.minimum.reduceat(rank, np.flatnonzero(fresh))
            bit[order] = least[np.cumsum(fresh) - 1] < rank
        else:
            bit[order] = True
        ends = np.cumsum(sizes)
        bits = [np.packbits(bit[e - n : e]).tobytes() for n, e in zip(sizes.tolist(), ends.tolist(), strict=True)]
        return pa.table({"block": table["block"], "bucket": table["bucket"], "bits": pa.array(bits, pa.binary())})

    return asked.groupBy("bucket").applyInArrow(run, "block long, bucket long, bits binary")


def answered(keys: np.ndarray, bucket: np.ndarray, buckets: int, answers: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The answers' bit for every kind of key; also the keys' order and each sorted entry's kind."""
    order, fresh, _, b = distinct(keys, bucket, buckets)
    bits = np.zeros(len(b), bool)
    for name, raw in zip(answers["bucket"].to_pylist(), answers["bits"].to_pylist(), strict=True):
        lo, hi = np.searchsorted(b, name), np.searchsorted(b, name, "right")
        bits[lo:hi] = np.unpackbits(np.frombuffer(raw, np.uint8))[: hi - lo]
    return bits, order, np.cumsum(fresh) - 1


def long_ties(length: int, buckets: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Positions of a block's suffixes that may tie: one bit a byte, for each document."""

    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        block = Block(table)
        at = block.samples(length)
        keys, bucket = block.keys(at, length - V + 1, buckets)
        bits, order, kind = answered(keys, bucket, buckets, answers)
        if len(at):
            doc = block.document(at)[order]
            first = np.flatnonzero(np.r_[True, kind[1:] != kind[:-1]])
            bits |= np.minimum.reduceat(doc, first) < np.maximum.reduceat(doc, first)
        # shared samples up to each position, the positions before the block first
        seen = np.zeros(len(block.data) + V, np.int32)
        seen[at[order[bits[kind]]] + 1] = 1
        np.cumsum(seen, out=seen)
        ties = (seen[V:] > seen[:-V]) & block.starts(length)
        marks = [np.packbits(ties[a:b]).tobytes() for a, b in zip(block.offsets[:-1].tolist(), block.offsets[1:].tolist(), strict=True)]
        counts = [int(ties[a:b].sum()) for a, b in zip(block.offsets[:-1].tolist(), block.offsets[1:].tolist(), strict=True)]
        out = block.table
        return pa.table({k: out[k] for k in ("block", "rank", "seq", "id", "text")} | {"ties": pa.array(marks, pa.binary()), "n_ties": pa.array(counts, pa.int64())})

    return run


def tied(block: Block) -> np.ndarray:
    """The positions that :func:`long_ties` marked."""
    marks = [np.unpackbits(np.frombuffer(raw, np.uint8))[:n] for raw, n in zip(block.table["ties"].to_pylist(), np.diff(block.offsets).tolist(), strict=True)]
    return np.flatnonzero(np.concatenate(marks)) if marks else np.zeros(0, np.int64)


def settle(length: int, buckets: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Bytes, removed bytes, runs and digest of what is left, for each document of a block."""

    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        block = Block(table)
        at = tied(block)
        keys, bucket = block.keys(at, length, buckets)
        bits, order, kind = answered(keys, bucket, buckets, answers)
        gone = np.zeros(len(block.data) + 1, np.int64)
        if len(at):
            # ids in order of the block: equal ids get equal numbers, so a tie with an equal id does not count
            ids = block.table["id"].to_pylist()
            number = np.cumsum([0, *(x != y for x, y in zip(ids[1:], ids[:-1], strict=True))])
            mine = number[block.document(at)][order]
            first = np.flatnonzero(np.r_[True, kind[1:] != kind[:-1]])
            hit = at[order[bits[kind] | (np.minimum.reduceat(mine, first)[kind] < mine)]]
            gone[hit] += 1
            gone[hit + length] -= 1
        removed = np.cumsum(gone[:-1]) > 0
        begins = removed.copy()
        begins[1:] &= ~removed[:-1]
        heads = block.offsets[:-1][np.diff(block.offsets) > 0]  # a run ends with its document
        begins[heads] = removed[heads]
        n_removed, n_spans = (np.diff(np.searchsorted(np.flatnonzero(x), block.offsets)) for x in (removed, begins))
        digests = []
        for a, b, n in zip(block.offsets[:-1].tolist(), block.offsets[1:].tolist(), n_removed.tolist(), strict=True):
            kept = block.data[a:b][~removed[a:b]] if n else block.data[a:b]
            digests.append(hashlib.sha256(kept.tobytes()).hexdigest())
        return pa.table({"id": block.table["id"], "n_bytes": pa.array(np.diff(block.offsets), pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "n_spans": pa.array(n_spans, pa.int64()), "kept_sha256": pa.array(digests, pa.string())})

    return run


def repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, file_bytes: int = FILE_BYTES, bucket_suffixes: int = BUCKET_SUFFIXES) -> DataFrame:
    """One row per row of ``docs``: bytes, removed bytes, removed runs, digest of the rest."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = dict(rows.dtypes)["id"]
    n_bytes = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    files = max(1, -(-n_bytes // file_bytes))
    order = F.col("id").asc_nulls_last()
    blocks, blocks_path = write_whole(cut_blocks(rows.repartitionByRange(files, order).sortWithinPartitions(order, "text"), block_bytes))
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def ask(table: DataFrame, pick, width: int, n_suffixes: int, earlier: bool) -> tuple[DataFrame, list[str], int]:
        buckets = max(least, -(-n_suffixes // bucket_suffixes))
        passes = max(1, -(-8 * n_suffixes // max(1, n_bytes)))
        buckets = -(-buckets // passes) * passes
        out, paths = None, []
        for part in range(passes):
            answers, path = materialize_at(sort_buckets(questions(table, pick, width, buckets, part, passes), earlier))
            paths.append(path)
            drop_shuffles(spark)
            out = answers if out is None else out.unionByName(answers)
        return out, paths, buckets

    answers, paths, buckets = ask(blocks, lambda b: b.samples(length), length - V + 1, n_bytes * len(COVER) // V, False)
    grouped = blocks.groupBy("block").cogroup(answers.groupBy("block"))
    schema = f"block long, rank long, seq long, id {kind}, text string"
    ties, ties_path = write_whole(grouped.applyInArrow(long_ties(length, buckets), schema + ", ties binary, n_ties long"))
    release_materialized(spark, [*paths, blocks_path])
    drop_shuffles(spark)
    n_ties = ties.agg(F.sum("n_ties")).first()[0] or 0
    answers, paths, buckets = ask(ties, tied, length, n_ties, True)
    grouped = ties.groupBy("block").cogroup(answers.groupBy("block"))
    result, _ = materialize_at(grouped.applyInArrow(settle(length, buckets), f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"))
    release_materialized(spark, [*paths, ties_path])
    return result.withColumnRenamed("id", id_col)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(T.read(spark, sf_dir, "documents"))


ORACLE = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(hex(encode(text)), '') AS h FROM documents),
s AS (SELECT r, doc_id, p, substr(h, 2 * p + 1, 100) AS s FROM (SELECT *, unnest(range(0, len(h) // 2 - 49)) AS p FROM d)),
f AS (SELECT s, min(doc_id) AS least FROM s GROUP BY s),
hits AS (SELECT r, p, lag(p) OVER (PARTITION BY r ORDER BY p) AS before FROM s JOIN f USING (s) WHERE least < doc_id),
marks AS (SELECT r, p, sum(CASE WHEN before IS NULL OR p - before > 50 THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY p) AS run FROM hits),
runs AS (SELECT r, run, min(p) AS a, max(p) + 50 AS b FROM marks GROUP BY r, run),
ends AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS open, row_number() OVER (PARTITION BY r ORDER BY a DESC) AS last FROM runs),
cut AS (SELECT r, sum(b - a) AS n_removed, count(*) AS n_spans,
          string_agg(substr(h, 2 * open + 1, 2 * (a - open)) || CASE WHEN last = 1 THEN substr(h, 2 * b + 1) ELSE '' END, '' ORDER BY a) AS kept
        FROM ends JOIN d USING (r) GROUP BY r)
SELECT doc_id, cast(len(h) // 2 AS bigint) AS n_bytes, cast(coalesce(n_removed, 0) AS bigint) AS n_removed, cast(coalesce(n_spans, 0) AS bigint) AS n_spans,
       sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN cut USING (r)
"""
