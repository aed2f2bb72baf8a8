"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased; everything that is not a letter becomes a space.  Every run of 1 to 3
characters, with two spaces before and after the text, is hashed into a fixed number of buckets.  Training counts buckets per language on a
bounded, seeded sample of rows per language, on the executors; the smoothed log probabilities form
one matrix (buckets x languages) that is broadcast.  Its size is the product of two parameters and
the number of languages, and is checked.  Scoring sums matrix rows per text, batch by batch.

A null text, or one without a letter, gets ``und`` and score 0; so does every text if nothing was
learned.  Null labels teach nothing; repeated rows get equal predictions; languages that tie go to
the first by code point.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnlens.llm import text as T
from churnlens.llm.tokens import strings

BUCKETS = 1 << 14
ORDERS = (1, 2, 3)
SAMPLE = 1200
MODEL_BYTES = 256 << 20
#: The winner's probability is taken as if the text had at most so many n-grams, else all are 1.
EVIDENCE = 200
UND = "und"


def letters() -> np.ndarray:
    """Which of the first 65536 code points are letters; those beyond are looked at one by one."""
    return np.array([chr(i).isalpha() for i in range(1 << 16)])


def code_points(texts: list[str], letter: np.ndarray, pad: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased code points, 32 for what is no letter; offsets; letters per text.  ``pad`` spaces stand before
    the first text and after each, so that no n-gram of up to pad + 1 characters spans two texts: what a
    text has is its own, whatever stands beside it."""
    low = [t.lower() for t in texts]
    gap = " " * pad
    flat = np.frombuffer((gap + "".join(t + gap for t in low)).encode("utf-32-le", "replace"), "<u4")
    offsets = pad + np.concatenate([[0], np.cumsum([len(t) + pad for t in low])])
    small = flat < len(letter)
    is_letter = letter[np.where(small, flat, 0)]
    if not small.all():
        far = np.flatnonzero(~small)
        is_letter[far] = [chr(c).isalpha() for c in flat[far].tolist()]
    sums = np.concatenate([[0], np.cumsum(is_letter)])
    return np.where(is_letter, flat, 32).astype(np.uint32), offsets, sums[offsets[1:]] - sums[offsets[:-1]]


def gap(orders: tuple[int, ...]) -> int:
    """Spaces around a text for n-grams of these orders."""
    return max(1, max(orders) - 1)


def ngram_buckets(points: np.ndarray, order: int, buckets: int) -> np.ndarray:
    """The bucket of the n-gram that ends at each position."""
    h = np.zeros(len(points), np.uint32)
    for back in range(order):
        h[back:] += points[: len(points) - back] * np.uint32((0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)[back])
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D + 2 * order)
    h ^= h >> np.uint32(13)
    return (h & np.uint32(buckets - 1)).astype(np.intp)


@dataclass
class Model:
    languages: list[str]
    prior: np.ndarray
    matrix: np.ndarray
    orders: tuple[int, ...]


def train(
    docs: DataFrame, limit: int = SAMPLE, buckets: int = BUCKETS, orders: tuple[int, ...] = ORDERS, smoothing: float = 0.5, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", seed: int = 11
) -> Model:
    """Learn from at most ``limit`` rows of each language of ``docs``, the first in a seeded order of the ids.

    The rows are chosen before any text is read, by one top-k scan a language: a task keeps at most ``limit``
    ids of it, so a language with most of the rows is never brought together.
    """
    letter, pad = letters(), gap(orders)
    known = docs.select(F.col(id_col).alias("_id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where(F.col("lang").isNotNull())
    prior = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(prior)
    if len(languages) * buckets * 4 > MODEL_BYTES:
        raise ValueError(f"{len(languages)} languages x {buckets} buckets exceed the model's {MODEL_BYTES} bytes; lower buckets or raise MODEL_BYTES")
    if not languages:
        return Model([], np.zeros(0), np.zeros((buckets, 0), np.float32), orders)
    first = [known.where((F.col("lang") == x) & F.col("_id").isNotNull()).select("_id", "lang").orderBy(F.xxhash64("_id", F.lit(seed)), "_id").limit(limit) for x in languages]
    chosen = known.join(F.broadcast(reduce(DataFrame.unionByName, first).distinct()), ["_id", "lang"], "left_semi")

    def count(batch: pa.RecordBatch) -> dict:
        names = batch.column(0).to_pylist()
        kinds = sorted(set(names))
        total = np.zeros((len(kinds), buckets), np.int64)
        for c in T.chunks(batch.column(1)):
            points, offsets, _ = code_points(strings(c), letter, pad)
            of = np.repeat(np.array([kinds.index(x) for x in names[c.lo : c.hi]]), np.diff(offsets))
            for order in orders:
                total += np.bincount(of * buckets + ngram_buckets(points, order, buckets)[pad:], minlength=total.size).reshape(total.shape)
        k, b = np.nonzero(total)
        return {"lang": pa.array([kinds[i] for i in k], pa.string()), "bucket": b.astype(np.int64), "n": total[k, b]}

    rows = T.per_batch(chosen.select("lang", "text"), count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    counts = np.zeros((buckets, len(languages)))
    for r in rows.toLocalIterator():
        counts[r["bucket"], languages.index(r["lang"])] = r["n"]
    logs = np.log(counts + smoothing) - np.log(counts.sum(0) + smoothing * buckets)
    share = np.array([prior[x] for x in languages], float)
    return Model(languages, np.log(share / share.sum()), logs.astype(np.float32), orders)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Language and score of every row of ``docs``; ``text_col`` may be a field of the column ``id_col``,
    which then travels once, text and all."""
    spark = docs.sparkSession
    field = text_col.removeprefix(f"{id_col}.") if text_col.startswith(f"{id_col}.") else None
    held = spark.sparkContext.broadcast(model)

    def run(batches):
        letter, m = letters(), held.value
        n_buckets, pad = len(m.matrix), gap(m.orders)
        columns = m.matrix.T.astype(np.float64)
        for batch in batches:
            if not batch.num_rows:
                continue
            names, score = np.full(batch.num_rows, UND, object), np.zeros(batch.num_rows)
            texts = batch.column(0).field(field) if field else batch.column(1)
            for c in T.chunks(texts) if m.languages else ():
                points, offsets, n_letters = code_points(strings(c), letter, pad)
                total = np.zeros((c.hi - c.lo, len(m.languages)))
                for order in m.orders:
                    at = ngram_buckets(points, order, n_buckets)
                    for j in range(len(m.languages)):
                        total[:, j] += np.add.reduceat(columns[j][at], offsets[:-1])
                full = total + m.prior
                best = full.argmax(1)
                scale = np.minimum(1.0, EVIDENCE / np.maximum(1, n_letters * len(m.orders)))
                part = (full - full.max(1, keepdims=True)) * scale[:, None]
                rows = np.flatnonzero(n_letters > 0)
                names[c.lo + rows] = np.array(m.languages, object)[best[rows]]
                score[c.lo + rows] = (1 / np.exp(part).sum(1))[rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(score)], names=[id_col, "lang_pred", "score"])

    return T.map_batches(docs.select(*([id_col] if field else [id_col, text_col])), run, T.with_fields(docs, [id_col], "lang_pred string, score double"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = T.read(spark, sf_dir, "documents")
    held_out = T.crc_mod("doc_id", 4) == 2
    out = predict(docs, train(docs.where(~held_out)))
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
