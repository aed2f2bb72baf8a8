"""Merkle manifest of a dataset by time-forward processing.

Every row is a leaf, the digest of its fields.  Per tree (language) the leaves ascend by id; every
``ARITY`` consecutive nodes become their digest until one remains, and the trees' roots, in order,
become the root in the same way.

1. Nodes are labelled by (last leaf below, level), so a child's label is smaller than its parent's.
   Sweeping the labels upwards, a node takes its children's digests from a priority queue, in which
   they wait under its label, and sends its own digest to its parent's label.
2. Sweeping them downwards, a node takes its proof suffix (the siblings from itself to the root) from
   the queue and sends each child the child's siblings and that suffix.

The queue has two storeys.  Leaves are cut into blocks of ARITY ** LEVELS, in which the queue is a heap
in the task that holds no more than the pending messages of one path; what leaves a block is a
message to a label of the next block up (or down), and those are delivered by Spark's shuffle, which
sorts and spills.  Each storey takes LEVELS levels, so 10**11 rows need five rounds each way, and a
hot tree is many blocks.  Texts are digested where they are read and never shuffled.

Null fields are digested as ``-``.  Rows without a tree (language) are a tree of their own, first in order;
rows without an id come first in their tree; equal ids ascend by leaf, and rows that are equal in
everything have equal leaves.  A lone leaf is its tree's root with no siblings.  An empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
import heapq

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from churnlens.llm import text as T
from churnlens.llm.numbering import row_numbers
from churnlens.session import materialize

ARITY = 8
#: Levels of a block: 512 leaves.
LEVELS = 3
BLOCK = ARITY**LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Up to so many trees their table is broadcast; beyond, it is joined by a shuffle.
BROADCAST_TREES = 50_000
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
NODE = "tree long, idx long, n long, digest string"
STEP = "array<struct<place:int,siblings:string>>"
SUFFIX = f"tree long, idx long, subroot string, root string, path {STEP}"


def digest(parts: str) -> str:
    return hashlib.sha256(parts.encode()).hexdigest()


def depth(n: int) -> int:
    """Levels above the ``n`` leaves of a tree."""
    levels = 0
    while n > 1:
        n, levels = -(-n // ARITY), levels + 1
    return levels


def sweep_up(leaves: list[str], steps: int) -> list[list[str]]:
    """Digests of all nodes of a block by level, leaves first, ``steps`` levels above them."""
    nodes: list[list[str]] = [leaves, *([] for _ in range(steps))]
    queue: list[tuple[int, int, int, str]] = []

    def send(level: int, idx: int, value: str) -> None:
        if level < steps:
            last = min((idx // ARITY + 1) * ARITY ** (level + 1), len(leaves)) - 1
            heapq.heappush(queue, (last, level + 1, idx, value))

    for i, leaf in enumerate(leaves):
        send(0, i, leaf)
        while queue and queue[0][0] == i:
            level, inbox = queue[0][1], []
            while queue and queue[0][:2] == (i, level):
                inbox.append(heapq.heappop(queue)[3])
            nodes[level].append(digest("".join(inbox)))
            send(level, len(nodes[level]) - 1, nodes[level][-1])
    return nodes


def sweep_down(nodes: list[list[str]], suffix: tuple) -> list[tuple]:
    """Paths of a block's leaves, (place in the run, the run's other digests) from the leaf upwards;
    ``suffix`` is the path of the block's top node."""
    top, n = len(nodes) - 1, len(nodes[0])
    paths: list[tuple] = [()] * n
    queue: list[tuple[int, int, int, tuple]] = [(1 - n, -top, 0, suffix)]
    while queue:
        _, level, idx, path = heapq.heappop(queue)
        level = -level
        if level == 0:
            paths[idx] = path
            continue
        run = nodes[level - 1][idx * ARITY : (idx + 1) * ARITY]
        for k in range(len(run)):
            child = idx * ARITY + k
            last = min((child + 1) * ARITY ** (level - 1), n) - 1
            heapq.heappush(queue, (-last, 1 - level, child, ((k, "".join(run[:k] + run[k + 1 :])), *path)))
    return paths


def fold(leaf: str, path: tuple) -> str:
    """The root that a leaf and its path lead to."""
    for k, siblings in path:
        leaf = digest(siblings[: 64 * k] + leaf + siblings[64 * k :])
    return leaf


def _block(table: pa.Table) -> tuple[pa.Table, list[list[str]]]:
    table = table.sort_by("idx")
    n = table.column("n")[0].as_py()
    return table, sweep_up(table.column("digest").to_pylist(), min(LEVELS, depth(n)))


def _block_up(table: pa.Table) -> pa.Table:
    tree, block, n = (table.column(c)[0].as_py() for c in ("tree", "block", "n"))
    _, nodes = _block(table)
    for _ in range(len(nodes) - 1):
        n = -(-n // ARITY)
    return pa.table({"tree": [tree], "idx": [block], "n": [n], "digest": [nodes[-1][0]]})


def _suffix(table: pa.Table) -> tuple[str | None, str, tuple]:
    row = table.to_pylist()[0]
    return row["subroot"], row["root"], tuple((s["place"], s["siblings"]) for s in row["path"])


def _as_steps(paths: list[tuple]) -> list[list[dict]]:
    return [[{"place": k, "siblings": s} for k, s in p] for p in paths]


_STEPS = pa.list_(pa.struct([("place", pa.int32()), ("siblings", pa.string())]))


def _block_down(nodes: pa.Table, suffix: pa.Table) -> pa.Table:
    """Paths of the nodes of a block that is not of leaves; at the foot of the top tree a node is a tree's root."""
    subroot, root, path = _suffix(suffix)
    nodes, levels = _block(nodes)
    m = nodes.num_rows
    return pa.table(
        {
            "tree": nodes.column("tree"),
            "idx": nodes.column("idx"),
            "subroot": pa.array([subroot] * m, pa.string()),
            "root": pa.array([root] * m, pa.string()),
            "path": pa.array(_as_steps(sweep_down(levels, path)), _STEPS),
        }
    )


def _with_block(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("block", F.expr(f"idx div {BLOCK}"))


def _rounds(n: int) -> int:
    return max(1, -(-depth(n) // LEVELS))


def _up(nodes: DataFrame, most: int) -> list[DataFrame]:
    """Nodes of every storey, the given ones first; the last one holds one node a tree."""
    storeys = [nodes]
    for _ in range(_rounds(most)):
        storeys.append(materialize(_with_block(storeys[-1].select("tree", "idx", "n", "digest")).groupBy("tree", "block").applyInArrow(_block_up, NODE)))
    return storeys


def _down(nodes: DataFrame, suffixes: DataFrame, function, schema) -> DataFrame:
    return _with_block(nodes).groupBy("tree", "block").cogroup(suffixes.groupBy("tree", "idx")).applyInArrow(function, schema)


def leaf_digest(fields: dict[str, Column]) -> Column:
    """Digest of the fields, in order: ``-`` for null, else byte count, colon, value as text."""
    values = [c.cast("string") for c in fields.values()]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in values)).cast("binary"), 256)


def manifest(leaves: DataFrame, broadcast_trees: int = BROADCAST_TREES, paths: bool = False) -> DataFrame:
    """Rows (id, tree_key, digest, claimed) to: id, leaf, subroot, root, proof_sha256 (digest of all
    siblings from the leaf to the root), folded_root (where the leaf ``claimed`` leads with these
    siblings) and, with ``paths``, the siblings themselves."""
    numbered = row_numbers(leaves, [F.col("tree_key"), F.col("id"), F.col("digest")])
    trees = numbered.groupBy("tree_key").agg(F.min("row_no").alias("first"), F.count("*").alias("n"))
    trees = materialize(row_numbers(trees, [F.col("tree_key")], "tree")).withColumnRenamed("tree_key", "_key")
    found = trees.agg(F.count("*").alias("trees"), F.max("n").alias("most")).first()
    n_trees, most = found["trees"], found["most"] or 0
    trees = F.broadcast(trees) if n_trees <= broadcast_trees else trees
    base = numbered.join(trees, F.col("tree_key").eqNullSafe(F.col("_key")))
    base = base.select("tree", (F.col("row_no") - F.col("first")).alias("idx"), "n", "digest", "id", "claimed")
    storeys = _up(materialize(base), most)
    tops = storeys[-1].select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("idx"), F.lit(n_trees).cast("long").alias("n"), "digest")
    upper = _up(tops, n_trees)

    suffixes = upper[-1].select("tree", "idx", F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root"), F.array().cast(STEP).alias("path"))
    for storey in upper[-2::-1]:
        suffixes = _down(storey, suffixes, _block_down, SUFFIX)
    roots = storeys[-1].select("tree", F.col("digest").alias("_subroot"))
    suffixes = materialize(suffixes.select(F.col("idx").alias("tree"), "root", "path").join(roots, "tree").select("tree", F.lit(0).cast("long").alias("idx"), F.col("_subroot").alias("subroot"), "root", "path"))
    for storey in storeys[-2:0:-1]:
        suffixes = materialize(_down(storey, suffixes, _block_down, SUFFIX))

    def report(block: pa.Table, suffix: pa.Table) -> pa.Table:
        subroot, root, path = _suffix(suffix)
        block, levels = _block(block)
        found = sweep_down(levels, path)
        m = block.num_rows
        out = {
            "id": block.column("id"),
            "leaf": block.column("digest"),
            "subroot": pa.array([subroot] * m, pa.string()),
            "root": pa.array([root] * m, pa.string()),
            "proof_sha256": [digest("".join(s for _, s in p)) for p in found],
            "folded_root": [fold(x, p) for x, p in zip(block.column("claimed").to_pylist(), found, strict=True)],
        }
        return pa.table(out | ({"path": pa.array(_as_steps(found), _STEPS)} if paths else {}))

    more = "leaf string, subroot string, root string, proof_sha256 string, folded_root string" + (f", path {STEP}" if paths else "")
    return _down(storeys[0], suffixes, report, T.with_fields(leaves, ["id"], more))


def verify(rows: DataFrame, leaf: str = "leaf", path: str = "path") -> Column:
    """The root that the column ``leaf`` leads to with the siblings in ``path``, as a native expression."""
    return F.aggregate(path, F.col(leaf), lambda x, s: F.sha2(F.concat(F.substr(s["siblings"], F.lit(1), 64 * s["place"]), x, F.substr(s["siblings"], 64 * s["place"] + 1)).cast("binary"), 256))


def document_leaves(docs: DataFrame, fields: tuple[str, ...] = FIELDS, tree_col: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Leaves of ``docs``; where 3 divides the crc32 of the id as text (a null id: of no bytes), the
    claimed leaf is that of the text with A-Z lower-cased."""
    columns = {c: F.col(f"`{c}`") for c in fields}
    lowered = columns | {text_col: F.translate(columns[text_col], UPPER, UPPER.lower())}
    return docs.select(
        F.col(f"`{id_col}`").alias("id"),
        F.col(f"`{tree_col}`").alias("tree_key"),
        leaf_digest(columns).alias("digest"),
        F.when(T.crc_mod(id_col, 3) == 0, leaf_digest(lowered)).alias("_tampered"),
    ).select("id", "tree_key", "digest", F.coalesce("_tampered", "digest").alias("claimed"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = manifest(materialize(document_leaves(T.read(spark, sf_dir, "documents"))))
    return rows.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _oracle(levels: int = 8) -> str:
    """Levels are written out: enough for ARITY ** levels rows a tree; a tree that is done passes through."""
    enc = lambda c: f"coalesce(cast(strlen(cast({c} AS varchar)) AS varchar) || ':' || cast({c} AS varchar), '-')"
    leaf = " || ".join(enc(c) for c in FIELDS)
    lowered = " || ".join(enc(c if c != "text" else f"translate(text, '{UPPER}', '{UPPER.lower()}')") for c in FIELDS)
    parts = [
        "poly(c, i, k) AS (SELECT cast(range AS bigint), cast(range AS bigint), 0 FROM range(256) UNION ALL SELECT CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i, k + 1 FROM poly WHERE k < 8)",
        "crc AS (SELECT list(c ORDER BY i) AS t FROM poly WHERE k = 8)",
        f"""d AS (SELECT doc_id, coalesce('+' || lang, '') AS tree, sha256({leaf}) AS leaf, sha256({lowered}) AS low,
          xor(4294967295, list_reduce(list_transform(string_split(coalesce(cast(doc_id AS varchar), ''), ''), lambda h: cast(coalesce(ascii(h), 0) AS bigint)),
            lambda x, b: xor(x >> 8, t[(xor(x, b) & 255) + 1]), cast(4294967295 AS bigint))) % 3 = 0 AS tampered FROM documents, crc)""",
        "l0 AS (SELECT *, leaf AS h, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i0 FROM d)",
    ]
    parts.append("t0 AS (SELECT tree, i0 AS i, h FROM l0)")
    for k in range(1, levels + 1):
        parts.append(f"r{k} AS (SELECT tree, i // {ARITY} AS i, list(h ORDER BY i) AS run FROM t{k - 1} GROUP BY tree, i // {ARITY})")
        parts.append(f"t{k} AS (SELECT tree, i, CASE WHEN count(*) OVER (PARTITION BY tree) = 1 AND len(run) = 1 THEN run[1] ELSE sha256(array_to_string(run, '')) END AS h FROM r{k})")
    parts.append(f"u0 AS (SELECT tree, row_number() OVER (ORDER BY tree) - 1 AS i, h FROM t{levels})")
    for k in range(1, levels + 1):
        parts.append(f"v{k} AS (SELECT i // {ARITY} AS i, list(h ORDER BY i) AS run FROM u{k - 1} GROUP BY i // {ARITY})")
        parts.append(f"u{k} AS (SELECT i, CASE WHEN count(*) OVER () = 1 AND len(run) = 1 THEN run[1] ELSE sha256(array_to_string(run, '')) END AS h FROM v{k})")
    parts.append("f0 AS (SELECT l0.doc_id, l0.tree, l0.leaf, l0.i0, u0.i AS j0, u0.h AS subroot, CASE WHEN tampered THEN low ELSE leaf END AS cur, '' AS proof, l0.i0 AS i FROM l0 JOIN u0 USING (tree))")
    step = """{name} AS (SELECT f.* REPLACE (
        CASE WHEN solo THEN cur ELSE sha256(array_to_string(run[:f.i % {a}], '') || cur || array_to_string(run[f.i % {a} + 2:], '')) END AS cur,
        CASE WHEN solo THEN proof ELSE proof || array_to_string(run[:f.i % {a}], '') || array_to_string(run[f.i % {a} + 2:], '') END AS proof,
        f.i // {a} AS i) FROM {before} f JOIN (SELECT *, {solo} AS solo FROM {runs}) r ON {on})"""
    for k in range(1, levels + 1):
        parts.append(step.format(name=f"f{k}", a=ARITY, before=f"f{k - 1}", runs=f"r{k}", solo="count(*) OVER (PARTITION BY tree) = 1 AND len(run) = 1", on=f"r.tree = f.tree AND r.i = f.i // {ARITY}"))
    parts.append(f"g0 AS (SELECT f.* REPLACE (f.j0 AS i) FROM f{levels} f)")
    for k in range(1, levels + 1):
        parts.append(step.format(name=f"g{k}", a=ARITY, before=f"g{k - 1}", runs=f"v{k}", solo="count(*) OVER () = 1 AND len(run) = 1", on=f"r.i = f.i // {ARITY}"))
    return "WITH RECURSIVE\n" + ",\n".join(parts) + f"\nSELECT doc_id, leaf, subroot, u.h AS root, sha256(proof) AS proof_sha256, cur AS folded_root, cur = u.h AS verified FROM g{levels}, u{levels} u"


ORACLE = _oracle()
