"""Quality rules: document statistics and gradient-boosted trees over them.

Statistics come from whole texts in one vectorised pass.  The trees (logistic loss, histogram
splits, numpy only) are fitted on a bounded sample of labelled rows and flattened into node arrays:
feature, threshold, left child, value.  Chosen features are monotone: a split that would order its
children's values the wrong way is refused and the children's value range is bounded by the mid
value, so that the score cannot fall (or rise) as the feature grows.

A null or empty text has no words and all statistics 0.  A text is judged by itself, so repeated
rows agree.  Without labels of both kinds the trees are empty and only the base rules decide.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnlens.llm import text as T

SYMBOLS = np.isin(np.arange(256), [ord(c) for c in "#*$%&|<>"])
UPPER = (np.arange(256) >= ord("A")) & (np.arange(256) <= ord("Z"))
FEATURES = ["log_words", "mean_word", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "digit_share", "bang_share", "space_share", "distinct_share", "line_words", "stop_end_share"]
#: A higher share of these may never raise the score.
FALLING = ("symbol_share", "dup_line_share", "repeat_share", "bang_share")


def covered(positions: np.ndarray, width: int, n: int) -> np.ndarray:
    """Marks of all places within ``width`` from one of ``positions``."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, positions, 1)
    np.add.at(step, np.minimum(positions + width, n), -1)
    return np.cumsum(step[:-1]) > 0


def again(row: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marks of the entries whose value occurs more than once in their row, and of all but the first such."""
    many, later = np.zeros(len(h), bool), np.zeros(len(h), bool)
    if len(h) > 1:
        order = np.lexsort((h, row))
        same = (h[order][1:] == h[order][:-1]) & (row[order][1:] == row[order][:-1])
        many[order[1:][same]] = True
        many[order[:-1][same]] = True
        later[order[1:][same]] = True
    return many, later


def statistics(chunk: T.Chunk) -> dict[str, np.ndarray]:
    """Counts per row of the chunk: words, code points in words, symbols, lines, repeats and others."""
    data, n_rows = chunk.data, chunk.hi - chunk.lo
    w = T.words(chunk, T.NOT_SPACE, False)

    def per_row(mark: np.ndarray) -> np.ndarray:
        s = np.zeros(len(mark) + 1, np.int64)
        np.cumsum(mark, out=s[1:])
        return s[chunk.offsets[1:]] - s[chunk.offsets[:-1]]

    out = {"n_words": np.diff(w.first)}
    point = (data & 0xC0) != 0x80
    out["word_chars"] = per_row(T.NOT_SPACE[data] & point)
    out["n_chars"] = per_row(point)
    out["n_symbols"] = per_row(SYMBOLS[data])
    out["n_upper"] = per_row(UPPER[data])
    out["n_digits"] = per_row((data >= 0x30) & (data <= 0x39))
    out["n_bang"] = per_row((data == ord("!")) | (data == ord("?")))
    at, h = T.ngram_hash(w, 5)
    many, _ = again(w.row[at], h)
    out["n_repeat_words"] = np.bincount(w.row[covered(at[many], 5, len(w.hash))], minlength=n_rows) if len(w.hash) else np.zeros(n_rows, np.int64)
    _, later = again(w.row, w.hash)
    out["n_distinct"] = out["n_words"] - np.bincount(w.row[later], minlength=n_rows)
    # Lines: split at \n and at the rows' edges; those with a word are compared as bytes.
    edge = np.zeros(len(data) + 1, bool)
    edge[chunk.offsets] = True
    edge[np.flatnonzero(data == 10) + 1] = True
    begin = np.flatnonzero(edge[:-1])
    row = np.searchsorted(chunk.offsets, begin, "right") - 1
    end = np.r_[begin[1:], len(data)][: len(begin)]
    end = end - ((end > begin) & (data[np.maximum(end, 1) - 1] == 10)) if len(begin) else end
    held = np.searchsorted(w.starts, end) > np.searchsorted(w.starts, begin)
    begin, end, row = begin[held], end[held], row[held]
    _, later = again(row, T.span_hash(T.prefix_sums(data), begin, end))
    out["n_dup_lines"] = np.bincount(row[later], minlength=n_rows)
    out["n_lines"] = np.bincount(row, minlength=n_rows)
    last = data[w.ends - 1] if len(w.ends) else np.zeros(0, np.uint8)
    out["n_stops"] = np.bincount(w.row[last == ord(".")], minlength=n_rows)
    return {k: np.asarray(v, np.int64) for k, v in out.items()}


def features(s: dict[str, np.ndarray]) -> np.ndarray:
    words, chars, lines = (np.maximum(1, s[k]) for k in ("n_words", "n_chars", "n_lines"))
    return np.stack(
        [
            np.log1p(s["n_words"]),
            s["word_chars"] / words,
            s["n_symbols"] / chars,
            s["n_dup_lines"] / lines,
            s["n_repeat_words"] / words,
            s["n_upper"] / chars,
            s["n_digits"] / chars,
            s["n_bang"] / chars,
            1 - s["word_chars"] / chars,
            s["n_distinct"] / words,
            s["n_words"] / lines,
            s["n_stops"] / words,
        ],
        1,
    )


@dataclass
class Trees:
    """All trees' nodes in flat arrays; a leaf is its own left child.  ``root`` has each tree's first node."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    value: np.ndarray
    root: np.ndarray
    base: float
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities; all rows go down one tree at a time, one level a step."""
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.root:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                child = self.left[node]
                node = np.where(child == node, node, child + (x[rows, self.feature[node]] > self.threshold[node]))
            total += self.value[node]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, n_trees: int = 40, depth: int = 3, rate: float = 0.25, bins: int = 48, l2: float = 2.0, least: int = 8, falling=FALLING) -> Trees:
    """Boosted trees on ``x`` (rows x features) against 0/1 labels ``y``."""
    falls = np.array([f in falling for f in FEATURES[: x.shape[1]]])
    share = np.clip(y.mean() if len(y) else 1.0, 0.01, 0.99)
    base = float(np.log(share / (1 - share)))
    nodes: list[list[float]] = []
    roots: list[int] = []
    if 0 < y.sum() < len(y):
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
        binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], 1)
        total = np.full(len(x), base)
        for _ in range(n_trees):
            p = 1 / (1 + np.exp(-total))
            g, h = y - p, p * (1 - p)
            step = np.zeros(len(x))
            roots.append(len(nodes))
            nodes.append([0, 0, len(nodes), 0])
            todo = [(roots[-1], np.arange(len(x)), 0, -4.0, 4.0)]
            while todo:
                me, rows, level, low, high = todo.pop()
                gs, hs = g[rows].sum(), h[rows].sum()
                value = float(np.clip(gs / (hs + l2), low, high))
                best = (1e-6, None)
                if level < depth and len(rows) >= 2 * least:
                    for j, e in enumerate(edges):
                        if not len(e):
                            continue
                        b = binned[rows, j]
                        gl = np.cumsum(np.bincount(b, g[rows], len(e) + 1))[:-1]
                        hl = np.cumsum(np.bincount(b, h[rows], len(e) + 1))[:-1]
                        nl = np.cumsum(np.bincount(b, minlength=len(e) + 1))[:-1]
                        vl, vr = gl / (hl + l2), (gs - gl) / (hs - hl + l2)
                        gain = gl**2 / (hl + l2) + (gs - gl) ** 2 / (hs - hl + l2) - gs**2 / (hs + l2)
                        gain[(nl < least) | (len(rows) - nl < least) | (falls[j] & (vr > vl))] = -1
                        k = int(np.argmax(gain))
                        if gain[k] > best[0]:
                            best = (float(gain[k]), (j, k, float(np.clip(vl[k], low, high)), float(np.clip(vr[k], low, high))))
                if best[1] is None:
                    nodes[me] = [0, 0, me, rate * value]
                    step[rows] = rate * value
                    continue
                j, k, vl, vr = best[1]
                child = len(nodes)
                nodes[me] = [j, float(edges[j][k]), child, 0]
                nodes += [[0, 0, child, 0], [0, 0, child + 1, 0]]
                right = binned[rows, j] > k
                mid = (vl + vr) / 2
                todo.append((child, rows[~right], level + 1, mid if falls[j] else low, high))
                todo.append((child + 1, rows[right], level + 1, low, mid if falls[j] else high))
            total += step
    table = np.array(nodes, float).reshape(-1, 4)
    return Trees(table[:, 0].astype(np.int64), table[:, 1], table[:, 2].astype(np.int64), table[:, 3], np.array(roots, np.int64), base, depth)


STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", trees: Trees | None = None) -> DataFrame:
    """Statistics of every row and, with ``trees``, the score; else the features."""

    def run(batch: pa.RecordBatch) -> dict:
        parts = [statistics(c) for c in T.chunks(batch.column(1))]
        s = {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}
        x = features(s)
        last = {"score": trees.score(x)} if trees else {"features": pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))}
        return {id_col: batch.column(0)} | {k: s[k] for k in STATS} | last

    kind = dict(docs.dtypes)[id_col]
    return T.per_batch(docs.select(id_col, text_col), run, f"`{id_col}` {kind}, " + ", ".join(f"{k} long" for k in STATS) + (", score double" if trees else ", features array<double>"))


def sample_labelled(docs: DataFrame, labels: DataFrame, label: str, limit: int, id_col: str = "doc_id", seed: int = 7) -> DataFrame:
    """At most ``limit`` labelled documents of each label, the first in a seeded order of the ids.

    Ids are chosen before any text is read.  A document labelled more than once counts by its
    smallest label.
    """
    ids = (
        labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull())
        .groupBy(id_col)
        .agg(F.min(label).cast("int").alias("_label"))
        .where(F.col("_label").isin(0, 1))
    )
    order = F.xxhash64(F.col(id_col), F.lit(seed))
    # limit is per label: two top-k scans, each of which keeps ``limit`` ids a task
    chosen = ids.where("_label = 0").orderBy(order, id_col).limit(limit).unionByName(ids.where("_label = 1").orderBy(order, id_col).limit(limit))
    return docs.join(F.broadcast(chosen), id_col)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", limit: int = 3000, id_col: str = "doc_id", text_col: str = "text") -> Trees:
    """Trees fitted on the statistics of at most ``limit`` rows a label (only statistics reach the driver)."""
    chosen = sample_labelled(docs.select(id_col, text_col), labels, label, limit, id_col)
    scored = measured(chosen.select(id_col, text_col), id_col, text_col).join(F.broadcast(chosen.select(id_col, "_label").distinct()), id_col)
    rows = sorted((r[id_col], r["_label"], tuple(r["features"])) for r in scored.select(id_col, "_label", "features").collect())
    x = np.array([r[2] for r in rows], float).reshape(-1, len(FEATURES))
    return fit(x, np.array([r[1] for r in rows], float))


def judge(docs: DataFrame, trees: Trees, threshold: float = 0.2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Base rules and the trees' verdict for every row of ``docs``."""
    out = measured(docs, id_col, text_col, trees)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return out.select(id_col, *STATS, failed.alias("base_failed"), (~failed & (F.col("score") >= threshold)).alias("kept"), "score")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = T.read(spark, sf_dir, "documents")
    return judge(docs, train(docs, T.read(spark, sf_dir, "labels")))
