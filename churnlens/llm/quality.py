"""Quality classifier: a byte-level convolutional network in numpy.

A text's bytes are cut into blocks of ``STRIDE`` bytes, padded with a symbol of its own; each pair
of neighbouring blocks is a chunk, so chunks overlap by half and cover the whole text.  Every byte
has a learned vector; learned filters respond to each chunk (ReLU), each filter's largest response
over the text goes into one logistic unit.  Training is Adam on whole texts of a bounded, seeded
sample per label; only the chunk that wins a filter gets its gradient.

A null or empty text is one chunk of padding and gets the score that has.  Learned numbers are rounded to
multiples of 2**-12 after the fit, so every sum of a response is exact in 64 bits, whatever its order: a
text's score is its own, alone or in any batch, and long texts are pooled piece by piece.  Without labels of both kinds every score is the known label's, or 0.5.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnlens.llm import text as T
from churnlens.llm.rules import sample_labelled

STRIDE, DEPTH, FILTERS = 8, 6, 24
PAD = 256
#: Texts a label that the network is fitted on.
SAMPLE = 1500
THRESHOLD = 0.3
#: Learned numbers are multiples of 1 / GRAIN in scoring.
GRAIN = 1 << 12
#: Blocks whose responses are held at once.
PIECE = 1 << 14


def blocks(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(blocks x STRIDE) symbols, each text starting a block and having at least two; first block of each text."""
    size = np.diff(offsets)
    n = np.maximum(2, -(-size // STRIDE))
    first = np.concatenate([[0], np.cumsum(n)])
    out = np.full(first[-1] * STRIDE, PAD, np.uint16)
    out[np.arange(len(data)) + np.repeat(first[:-1] * STRIDE - offsets[:-1], size)] = data
    return out.reshape(-1, STRIDE), first


@dataclass
class Network:
    vectors: np.ndarray  # (257, DEPTH)
    filters: np.ndarray  # (2, STRIDE * DEPTH, FILTERS): the chunk's first and second block
    bias: np.ndarray
    weight: np.ndarray
    offset: np.ndarray

    def pooled(self, symbols: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each text's largest response of every filter, and all responses (a text's last block has none)."""
        x = self.vectors[symbols].reshape(len(symbols), -1)
        z = x @ self.filters[0]
        z[:-1] += (x @ self.filters[1])[1:]
        z += self.bias
        z[first[1:] - 1] = -np.inf
        return np.maximum(np.maximum.reduceat(z, first[:-1], axis=0), 0), z

    def rounded(self) -> "Network":
        """The network that scores: 64-bit multiples of 1 / ``GRAIN``."""
        grain = lambda x: np.round(x.astype(np.float64) * GRAIN) / GRAIN
        return Network(grain(self.vectors), grain(self.filters), grain(self.bias), grain(self.weight), grain(self.offset))

    def top(self, symbols: np.ndarray, first: np.ndarray) -> np.ndarray:
        """As :meth:`pooled`, the responses of ``PIECE`` blocks at a time."""
        out = np.zeros((len(first) - 1, FILTERS), self.filters.dtype)
        text = np.repeat(np.arange(len(first) - 1), np.diff(first))
        for lo in range(0, len(symbols) - 1, PIECE):
            hi = min(lo + PIECE, len(symbols) - 1)
            x = self.vectors[symbols[lo : hi + 1]].reshape(hi + 1 - lo, -1)
            z = x[:-1] @ self.filters[0] + x[1:] @ self.filters[1] + self.bias
            z[text[lo:hi] != text[lo + 1 : hi + 1]] = -np.inf
            begin = np.flatnonzero(np.r_[True, text[lo + 1 : hi] != text[lo : hi - 1]])
            here = text[lo + begin]
            out[here] = np.maximum(out[here], np.maximum.reduceat(z, begin, axis=0))
        return out

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.top(*blocks(data, offsets)) @ self.weight + self.offset[0]).astype(np.float64)))


def fit(texts: list[bytes], labels: np.ndarray, epochs: int = 8, batch: int = 24, rate: float = 0.01, decay: float = 1e-4, seed: int = 5) -> Network:
    rng = np.random.default_rng(seed)

    def start(*shape, by):
        return (rng.standard_normal(shape) * by).astype(np.float32)

    net = Network(start(PAD + 1, DEPTH, by=0.5), start(2, STRIDE * DEPTH, FILTERS, by=0.15), np.zeros(FILTERS, np.float32), start(FILTERS, by=0.2), np.zeros(1, np.float32))
    if len(set(labels.tolist())) < 2:
        net.weight[:] = 0
        net.offset[0] = 0 if not len(labels) else 4 if labels[0] else -4
        return net
    names = ["vectors", "filters", "bias", "weight", "offset"]
    moments = {k: (np.zeros_like(getattr(net, k)), np.zeros_like(getattr(net, k))) for k in names}
    weights = np.where(labels == 1, len(labels) / (2 * labels.sum()), len(labels) / (2 * (len(labels) - labels.sum())))
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(texts))
        pace = rate * (0.5 * (1 + np.cos(np.pi * epoch / epochs)) + 0.02)
        for lo in range(0, len(order), batch):
            rows = order[lo : lo + batch]
            data = np.frombuffer(b"".join(texts[r] for r in rows), np.uint8)
            symbols, first = blocks(data, np.concatenate([[0], np.cumsum([len(texts[r]) for r in rows])]))
            top, z = net.pooled(symbols, first)
            p = 1 / (1 + np.exp(-(top @ net.weight + net.offset[0])))
            d = ((p - labels[rows]) * weights[rows] / len(rows)).astype(np.float32)
            grads = {k: np.zeros_like(getattr(net, k)) for k in names}
            grads["weight"] = top.T @ d + decay * net.weight
            grads["offset"][0] = d.sum()
            back = np.where(top > 0, d[:, None] * net.weight, 0).astype(np.float32)
            for t in range(len(rows)):
                live = np.flatnonzero(back[t])
                if not len(live):
                    continue
                win = first[t] + z[first[t] : first[t + 1] - 1, live].argmax(0)
                g = back[t, live]
                grads["bias"][live] += g
                for half in (0, 1):
                    s = symbols[win + half]
                    grads["filters"][half][:, live] += net.vectors[s].reshape(len(live), -1).T * g
                    np.add.at(grads["vectors"], s.ravel(), (net.filters[half][:, live] * g).T.reshape(-1, DEPTH))
            step += 1
            for k in names:
                m, v = moments[k]
                m += 0.1 * (grads[k] - m)
                v += 0.01 * (grads[k] ** 2 - v)
                value = getattr(net, k)
                value -= (pace * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", limit: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Network:
    """Fit on at most ``limit`` labelled texts a label; only these reach the driver."""
    rows = sample_labelled(docs.select(id_col, text_col), labels, label, limit, id_col).collect()
    rows = sorted((r[id_col], r["_label"], (r[text_col] or "").encode()) for r in rows)
    return fit([r[2] for r in rows], np.array([r[1] for r in rows]))


def classify(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score of every row of ``docs``."""
    net = net.rounded()

    def run(batch: pa.RecordBatch) -> dict:
        parts = [net.score(c.data, c.offsets) for c in T.chunks(batch.column(1), 1 << 19)]
        return {id_col: batch.column(0), "score": np.concatenate(parts)}

    return T.per_batch(docs.select(id_col, text_col), run, f"`{id_col}` {dict(docs.dtypes)[id_col]}, score double")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = T.read(spark, sf_dir, "documents"), T.read(spark, sf_dir, "labels")
    held_out = T.crc_mod("doc_id", 5) == 0
    out = classify(docs, train(docs, labels.where(~held_out)))
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
