"""Merkle manifest against a plain recursive version."""

import hashlib
import zlib

import llm_fixtures as X
import pytest
from pyspark.sql import functions as F

from churnlens.llm import catalog, merkle
from churnlens.llm import text as T

ROWS = X.corpus()


def h(s):
    return hashlib.sha256(s.encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(i, t, lang, source, n_chars=0):
    return h("".join(map(field, (i, source, lang, n_chars, t))))


def up(nodes):
    """Root of the nodes and each one's path, level by level."""
    paths, at, level = [[] for _ in nodes], list(range(len(nodes))), nodes
    while len(level) > 1:
        runs = [level[k : k + 8] for k in range(0, len(level), 8)]
        for x, p in enumerate(paths):
            run, k = runs[at[x] // 8], at[x] % 8
            p.append((k, run))
            at[x] //= 8
        level = [h("".join(r)) for r in runs]
    return level[0], paths


def brute(rows, n_chars=0):
    trees = {}
    for i, t, lang, source in rows:
        trees.setdefault(lang, []).append((i, t, lang, source))
    langs = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    leaves = {g: sorted(((r[0], leaf(*r, n_chars), r) for r in trees[g]), key=lambda x: (x[0] is not None, x[0] or 0, x[1])) for g in langs}
    built = {g: up([x[1] for x in leaves[g]]) for g in langs}
    root, tops = up([built[g][0] for g in langs])
    for g, top in zip(langs, tops, strict=True):
        for (i, digest, (_, t, lang, source)), path in zip(leaves[g], built[g][1], strict=True):
            whole = path + top
            x = digest
            if zlib.crc32(("" if i is None else str(i)).encode()) % 3 == 0:
                x = leaf(i, t if t is None else X.lower(t), lang, source, n_chars)
            for k, run in whole:
                x = h("".join(run[:k] + [x] + run[k + 1 :]))
            proof = h("".join("".join(run[:k] + run[k + 1 :]) for k, run in whole))
            yield (i, digest, built[g][0], root, proof, x, x == root)


COLS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def answer(spark, path):
    return X.as_counter(catalog.QUERIES["op13_merkle_manifest"](spark, path).select(*COLS).collect())


def test_manifest(spark, tmp_path):
    path = X.folder(tmp_path, spark, ROWS)
    assert answer(spark, path) == X.as_counter(brute(ROWS))
    assert {r[-1] for r in brute(ROWS)} == {True, False}


@pytest.mark.parametrize("n", [1, 8, 9, 64, 65, 512, 513, 1100])
def test_tails_of_every_kind(spark, tmp_path, n):
    rows = [(k, f"Text {k}", "en", None) for k in range(n)] + [(n, None, "fr", "s")] + ([(k, "x", f"l{k:03}", "s") for k in range(9)] if n == 65 else [])
    assert answer(spark, X.folder(tmp_path, spark, rows)) == X.as_counter(brute(rows))


def test_a_lone_leaf_is_the_root(spark, tmp_path):
    ((_, digest, subroot, root, proof, folded, ok),) = brute([(1, "only", "en", "s")])
    assert digest == subroot == root == folded and proof == h("") and ok
    assert answer(spark, X.folder(tmp_path, spark, [(1, "only", "en", "s")])) == X.as_counter(brute([(1, "only", "en", "s")]))


def test_many_trees_joined_by_a_shuffle(spark):
    rows = [(k, f"t{k}", f"l{k % 70:02}" if k % 70 else None, "s") for k in range(300)]
    docs = X.table(spark, rows, ["n_chars"])
    out = merkle.manifest(merkle.document_leaves(docs), broadcast_trees=3)
    want = X.as_counter(r[:6] for r in brute(rows))
    assert X.as_counter(out.select("id", *COLS[1:-1]).collect()) == want


def test_paths_lead_to_the_root_natively(spark, tmp_path):
    docs = T.read(spark, X.folder(tmp_path, spark, ROWS), "documents")
    out = merkle.manifest(merkle.document_leaves(docs), paths=True)
    rows = out.select("*", merkle.verify(out).alias("again"), F.sha2(F.concat_ws("", F.col("path.siblings")).cast("binary"), 256).alias("proof")).collect()
    assert len(rows) == len(ROWS)
    assert all(r["again"] == r["root"] and r["proof"] == r["proof_sha256"] for r in rows)


def test_the_queue_holds_one_path_only(monkeypatch):
    most, push = 0, merkle.heapq.heappush

    def watched(queue, item):
        nonlocal most
        push(queue, item)
        most = max(most, len(queue))

    monkeypatch.setattr(merkle.heapq, "heappush", watched)
    nodes = merkle.sweep_up([h(str(i)) for i in range(512)], 3)
    merkle.sweep_down(nodes, ())
    assert [len(x) for x in nodes] == [512, 64, 8, 1] and most <= 8 * 4
