"""Whole texts as numpy arrays: chunks of an Arrow batch, words with byte offsets and fingerprints.

A word is a maximal run of word bytes.  All word classes used here put every byte from 0x80 up in
words, so working on UTF-8 bytes gives the same words as working on code points.  A word's
fingerprint is a 64-bit polynomial over per-byte random values, finalised by a mixer.
"""

from __future__ import annotations

import contextlib
import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

U64 = np.uint64
CHUNK_BYTES = 1 << 20
#: Arrow batches of the steps that hold much else in memory, and the text that such a step takes at once.
BATCH_BYTES = 2 << 20
SMALL_CHUNK_BYTES = 1 << 18

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_b = np.arange(256)
#: [^\x20\x09-\x0D]+
NOT_SPACE = (_b != 0x20) & ~((_b >= 0x09) & (_b <= 0x0D))
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ : digits, a-z and everything that is not ASCII
ALNUM = ((_b >= 0x30) & (_b <= 0x39)) | ((_b >= 0x61) & (_b <= 0x7A)) | (_b >= 0x80)

_PRIME = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_PRIME, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values in which every input bit reaches every output bit."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U64(33))
    x = x * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


BYTE_VALUE = mix(np.arange(1, 257, dtype=U64) * U64(0xD6E8FEB86659FD93))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, U64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the odd multiplier and of its inverse modulo 2**64."""
    if len(_POWERS.get("up", ())) < n:
        size = max(n, min(2 * n, CHUNK_BYTES + 1))
        _POWERS["up"], _POWERS["down"] = _powers(_PRIME, size), _powers(_INVERSE, size)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Running polynomial sums S, S[0] = 0, of which :func:`span_hash` takes any span's fingerprint."""
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, U64)
    np.cumsum(BYTE_VALUE[data] * up[: len(data)], out=out[1:])
    return out


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Fingerprints of byte spans, equal for equal bytes wherever they stand."""
    _, down = powers(len(sums))
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U64) * U64(0x2545F4914F6CDD1D))


@dataclass
class Chunk:
    """Consecutive rows of a batch: rows lo..hi, their bytes, and len(rows) + 1 offsets into them."""

    lo: int
    hi: int
    data: np.ndarray
    offsets: np.ndarray


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Cut a text column into runs of whole rows of about ``limit`` bytes; null texts are empty.

    A row longer than the limit is a chunk of its own: texts are never cut.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    if len(texts) == 0:
        return
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(texts):
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1
        hi = min(max(hi, lo + 1), len(texts))
        yield Chunk(lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        lo = hi


@dataclass
class Words:
    """Words of a chunk in text order: byte spans, row in the chunk, fingerprint; first[r]..first[r+1] are row r's."""

    starts: np.ndarray
    ends: np.ndarray
    row: np.ndarray
    hash: np.ndarray
    first: np.ndarray


def words(chunk: Chunk, word_byte: np.ndarray, lower: bool) -> Words:
    data = LOWER[chunk.data] if lower else chunk.data
    n = len(data)
    inside = word_byte[data]
    edge = np.zeros(n + 1, bool)
    edge[chunk.offsets] = True
    before = np.empty(n, bool)
    before[:1] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty(n, bool)
    after[-1:] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    first = np.searchsorted(starts, chunk.offsets)
    row = np.repeat(np.arange(len(chunk.offsets) - 1), np.diff(first))
    return Words(starts, ends, row, span_hash(prefix_sums(data), starts, ends), first)


def ngram_hash(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and fingerprints of every run of ``n`` words that lies in one row."""
    m = len(w.hash) - n + 1
    if m <= 0:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    at = np.flatnonzero(w.row[:m] == w.row[n - 1 :])
    h = np.zeros(m, U64)
    for k in range(n):
        h = mix(h * U64(0xA24BAED4963EE407) + w.hash[k : k + m] + U64(k + 1))
    return at, h[at]


def span_text(chunk: Chunk, row: int) -> bytes:
    return chunk.data[chunk.offsets[row] : chunk.offsets[row + 1]].tobytes()


def deploy(spark: SparkSession) -> None:
    """Let Python workers find this package where the driver does, unless their path is already set."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    paths = spark.sparkContext.environment.setdefault("PYTHONPATH", root)
    if root not in paths.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([paths, root])


@contextlib.contextmanager
def small_batches(spark: SparkSession, most: int = BATCH_BYTES) -> Iterator[None]:
    """Jobs run inside get Arrow batches of at most ``most`` bytes; the session's setting comes back after."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(most))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    deploy(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: What a worker process keeps from task to task of one step; another step lets it go.
HELD: dict[str, object] = {}


def let_go() -> None:
    """Give memory back to the system that this process does not use: a worker serves one step after another, and
    would hold in each what the largest one before it took."""
    HELD.clear()
    for pool in (pa.default_memory_pool(), pa.system_memory_pool()):  # the system's is the C library's, so numpy's too
        pool.release_unused()


def map_batches(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """``mapInArrow`` whose tasks begin and leave their worker without the memory of others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        yield from function(batches)
        let_go()

    return df.mapInArrow(run, schema)


def per_batch(df: DataFrame, function: Callable[[pa.RecordBatch], dict[str, object]], schema: str | StructType) -> DataFrame:
    """Apply ``function`` to each Arrow batch; it returns the result's columns in the schema's order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = function(batch)
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in out.values()], names=list(out))

    return map_batches(df, run, schema)


def with_fields(docs: DataFrame, cols: list[str], more: str) -> StructType:
    """The schema of ``cols`` of ``docs``, whatever their types and names, and of the DDL fields ``more``."""
    return StructType([docs.schema[c] for c in cols] + StructType.fromDDL(more).fields)


def crc_mod(col: str, mod: int):
    """crc32 of a column's text modulo ``mod``; a null counts as the empty string."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % mod
