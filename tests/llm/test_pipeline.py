"""The pipeline's stages, each against a brute-force version on its own input."""

import hashlib
import os
import re

import llm_fixtures as X
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from churnlens import session
from churnlens.llm import mixing, pipeline
from churnlens.llm import text as T
from churnlens.session import materialize

ROWS = X.corpus(seed=8)
ITEMS = [(1, ROWS[4][1]), (2, "plain words that no document has"), (3, " ".join(ROWS[11][1].split()[:14]))]


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    return X.folder(tmp_path_factory.mktemp("pipe"), spark, ROWS, [], ITEMS)


def quads(df):
    return [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in df.collect()]


def first_of_each(rows):
    """Of each group of linked documents the first by id (null last) and text; all without words."""
    groups = {}
    named = [(k, *r[1:]) for k, r in enumerate(rows)]
    for row, (k, n, c) in zip(rows, X.jaccard(named), strict=True):
        groups.setdefault(c if n else ("alone", k), []).append(row)
    return [min(g, key=lambda r: (r[0] is None, r[0] or 0, hashlib.md5((r[1] or "").encode()).hexdigest())) for g in groups.values()]


def test_one_of_each_without_ids_and_with_shared_ones(spark, data, monkeypatch):
    a, b = ("first text of some words and more " * 9).strip(), ("another one about quite other things " * 9).strip()
    rows = [(1, a, "en", "s"), (1, b, "en", "s"), (None, a + " tail", "en", "s"), (None, "none of them " * 8, "en", "s"), (None, "none of them " * 8, "en", "t"), (2, b, "fr", "s"), (None, None, "en", "s"), (None, "", "en", "s"), (7, "one two", "en", "s")]
    rows += [(None, " ".join(f"z{i}" for i in range(60)), "en", "s")] * 5
    docs = X.table(spark, rows)
    got = pipeline.one_of_each(spark, docs, data)
    assert got.columns == docs.columns
    assert sorted(((r[0], r[1]) for r in quads(got)), key=str) == sorted(((r[0], r[1]) for r in first_of_each(rows)), key=str)
    unique = [(k, *r[1:]) for k, r in enumerate(rows)]
    for few in (10**6, 0):
        monkeypatch.setattr(pipeline, "BROADCAST_IDS", few)
        assert sorted(quads(pipeline.one_of_each(spark, X.table(spark, unique), data)), key=str) == sorted(first_of_each(unique), key=str)


def test_columns_of_any_name_and_tables_left_behind(spark, data, tmp_path):
    docs = T.read(spark, data, "documents").withColumns({"a.b": F.lit(1), "_row": F.lit("x"), "_node": F.lit(2), "m": F.create_map(F.lit("k"), F.lit("v"))})
    folder = str(tmp_path)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{data}/benchmark.parquet").write.parquet(f"{folder}/benchmark.parquet")
    docs = T.read(spark, folder, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        columns, docs = docs.columns, materialize(stage(spark, docs, folder))
        assert docs.columns == columns
    before = set(session._MATERIALIZED[spark.sparkContext.applicationId])
    out = corpus_pipeline.run(spark, folder)
    assert out.count() > 0
    mine = set(session._MATERIALIZED[spark.sparkContext.applicationId]) - before
    assert len(mine) <= 3  # the result, the manifest and the token files
    session.release_materialized(spark, list(mine))
    assert not any(os.path.exists(p.removeprefix("file:")) for p in mine)


def test_stages(spark, data):
    docs = T.read(spark, data, "documents")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language ID", "n-gram Jaccard join", "benchmark decontamination", "mixing sources to target weights", "token-ID / binary output"]
    stage = [f for _, f in corpus_pipeline.STAGES]

    told = materialize(stage[0](spark, docs, data))
    assert told.columns == docs.columns
    has_letter = [r for r in ROWS if any(c.isalpha() for c in r[1] or "")]
    kept = quads(told)
    assert set(kept) <= set(has_letter) and len(kept) >= 0.9 * len(has_letter)

    once = materialize(stage[1](spark, told, data))
    assert once.columns == docs.columns
    want = sorted(first_of_each(kept), key=str)
    assert sorted(quads(once), key=str) == want

    clean = materialize(stage[2](spark, once, data))
    assert clean.columns == docs.columns
    dirty = [x[-1] for x in X.contamination(want, ITEMS)]
    assert any(dirty) and sorted(quads(clean), key=str) == [r for r, bad in zip(want, dirty, strict=True) if not bad]

    mixed = materialize(stage[3](spark, clean, data))
    assert mixed.columns == docs.columns
    plan = mixing.mix(mixing.sized(clean, ["doc_id", "source"])).collect()
    words = lambda rows: sum(len(re.findall(r"[^\x20\x09-\x0D]+", r[1])) for r in rows)
    assert words(quads(mixed)) == sum(r["taken"] for r in plan)
    assert {r[0] for r in quads(mixed)} == {r["doc_id"] for r in plan if r["taken"]}

    files = materialize(stage[4](spark, mixed, data))
    assert files.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and files.count() == mixed.count()
    rows = sorted(files.collect(), key=lambda r: r["start"])
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(rows, rows[1:], strict=False))
    assert sorted(map(tuple, corpus_pipeline.run(spark, data).collect()), key=str) == sorted(map(tuple, rows), key=str)


def test_empty(spark, tmp_path):
    path = X.folder(tmp_path, spark, [])
    assert corpus_pipeline.run(spark, path).collect() == []
    assert len(pipeline.STAGES) == 5


def test_stages_run_with_small_batches(spark, data):
    """Also what a stage returns unwritten, and only inside the run."""

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes], pa.int64())], names=["n"])

    def stage(spark, docs, sf_dir):
        return spark.range(0, 40, 1, 1).select(F.repeat(F.col("id").cast("string").substr(1, 1), 1 << 20).alias("text")).mapInArrow(sizes, "n long")

    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    got = [r["n"] for r in pipeline.run(spark, data, [("large rows", stage)]).collect()]
    assert sum(got) >= 40 << 20 and max(got) <= T.BATCH_BYTES + (2 << 20)
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == before


def test_verdicts_on_texts_leave_rows_in_place(spark, data, monkeypatch):
    """A stage taken by itself has done its Python work, in small batches, when it returns: none is left to whoever
    writes the result under the session's batches.  Copies, null texts and rows without an id are judged by their text."""
    found = [x[-1] for x in X.contamination(ROWS, ITEMS)]
    clean = [r for r, bad in zip(ROWS, found, strict=True) if r[1] and not bad][:5]
    dirty = [r for r, bad in zip(ROWS, found, strict=True) if bad]
    assert clean and dirty
    rows = clean + [(None, clean[0][1], "en", "s"), (clean[0][0], dirty[0][1], "en", "s")] + [(None, dirty[0][1], "en", "s")] * 2 + [(None, None, "en", "s"), (3, "", "en", "s"), (4, "12 34", "en", "s")]
    docs = X.table(spark, rows)
    for few in (10**6, 0):
        monkeypatch.setattr(pipeline, "BROADCAST_TEXTS", few)
        got = pipeline.without_benchmark(spark, docs, data)
        assert "MapInArrow" not in got._jdf.queryExecution().toString()
        assert sorted(quads(got), key=str) == sorted((r for r in rows if r[1] != dirty[0][1]), key=str)
        told = pipeline.keep_language(spark, docs, data)
        assert "MapInArrow" not in told._jdf.queryExecution().toString()
        kept = [r[1] for r in quads(told)]
        assert kept and set(kept) <= {r[1] for r in rows if any(c.isalpha() for c in r[1] or "")}
        assert all(kept.count(t) == [r[1] for r in rows].count(t) for t in kept)


def test_workers_keep_no_tokenizer_for_other_steps(spark, data):
    """Worker processes serve one step after another; the encoder of the token files' tasks goes with their step."""
    docs = spark.read.parquet(f"{data}/documents.parquet").repartition(4)
    pipeline.write_token_files(spark, docs, data).collect()

    def encoders(batch):
        import gc

        return {"n": pa.array([sum(type(x).__name__ == "WordEncoder" for x in gc.get_objects())] * batch.num_rows, pa.int64())}

    assert {r["n"] for r in T.per_batch(spark.range(0, 16, 1, 16), encoders, "n long").collect()} == {0}
