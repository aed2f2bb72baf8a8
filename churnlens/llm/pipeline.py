"""Stages of the corpus pipeline, in order: language ID, n-gram Jaccard join, benchmark
decontamination, mixing sources to target weights, token files.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns of
``docs``, whatever else those hold and however they are named.  Empty tables pass through; null texts go in
the first stage.  Rows are documents of their own, also where they have no id or share one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnlens.llm import binary, decontaminate, jaccard, language, mixing
from churnlens.llm import text as T
from churnlens.session import collecting, materialize, materialize_at, release_materialized

LEAST_SCORE = 0.5
#: Up to so many ids of copies are broadcast to drop them; beyond, they are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: The same for digests of texts, which take more room.
BROADCAST_TEXTS = 250_000


def whole_row(docs: DataFrame):
    """All columns of ``docs`` as one struct, so that names cannot clash with an operator's."""
    return F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")


def digest(docs: DataFrame):
    """The text's digest, null for a null text."""
    return F.unhex(F.md5(docs["text"].cast("binary")))


def without_texts(docs: DataFrame, judged: DataFrame) -> DataFrame:
    """``docs`` without the texts whose digests ``judged`` has in its column _id.  A verdict on a text is found here,
    in small batches and of texts alone; rows stay where they are.  Were they sent through Python with their verdict,
    that would run when the result is written, under the batches of whoever writes it."""
    gone = materialize(judged.select("_id").distinct())
    few = gone.limit(BROADCAST_TEXTS + 1).count() <= BROADCAST_TEXTS
    return docs.join(F.broadcast(gone) if few else gone, digest(docs) == gone["_id"], "left_anti")


def keep_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with a score of ``LEAST_SCORE`` or more; texts without a letter go."""
    T.deploy(spark)
    texts = docs.where(F.col("text").isNotNull())
    with T.small_batches(spark):
        model = language.train(docs.where(T.crc_mod("doc_id", 4) != 2))
        told = language.predict(texts.select(digest(texts).alias("_id"), "text"), model, id_col="_id")
        return without_texts(texts, told.where(~((F.col("lang_pred") != language.UND) & (F.col("score") >= LEAST_SCORE))))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component the first document by id (null last) and text; documents without words stay.

    Where every document has an id of its own, that is the join's node.  Otherwise the documents are written
    once with a number each, and the numbers are.
    """
    T.deploy(spark)
    ids = docs.groupBy("doc_id").agg(F.count("*").alias("_n")).where("_n > 1 OR doc_id IS NULL")
    if ids.limit(1).isEmpty():
        gone = materialize(jaccard.join(docs).where("component_id <> doc_id").select("doc_id"))
        few = gone.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
        return docs.join(F.broadcast(gone) if few else gone, "doc_id", "left_anti").select(*(f"`{c}`" for c in docs.columns))
    numbered = materialize(docs.select(F.monotonically_increasing_id().alias("_node"), "doc_id", "text", whole_row(docs)))
    found = materialize(jaccard.join(numbered, id_col="_node"))
    place = F.struct(F.col("doc_id").isNull(), "doc_id", F.md5(F.col("text").cast("binary")), "_node")
    order = numbered.select(F.col("_node"), place.alias("_place"))
    first = found.select("_node", "component_id").join(order, "_node").groupBy("component_id").agg(F.min("_place").alias("_first"))
    return numbered.join(first.select(F.col("_first._node").alias("_node")), "_node", "left_semi").select("_row.*")


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark's items."""
    T.deploy(spark)
    texts = docs.select(digest(docs).alias("_id"), "text").where(F.col("text").isNotNull())
    with T.small_batches(spark):
        found = decontaminate.matches(texts, T.read(spark, sf_dir, "benchmark"), keep=["_id"])
        return without_texts(docs, decontaminate.report(found, ["_id"]).where("contaminated"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes: rows whole, several times or cut to their taken blocks."""
    return mixing.mixed_documents(docs)


def write_token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row's place in the written token files, read back from them."""
    T.deploy(spark)
    with T.small_batches(spark):
        return binary.token_files(docs)


STAGES = [
    ("language ID", keep_language),
    ("n-gram Jaccard join", one_of_each),
    ("benchmark decontamination", without_benchmark),
    ("mixing sources to target weights", mix_sources),
    ("token-ID / binary output", write_token_files),
]


def run(spark: SparkSession, sf_dir: str, stages: list) -> DataFrame:
    """Each stage's result is written and read as the next one's documents; what a stage wrote on its way, and
    its input, is deleted when its result stands.  The last stage's tables and token files stay until
    ``release_materialized``."""
    docs, path = T.read(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(stages, 1):
        before, used = [path] if path else [], []
        # texts travel through Python in most stages: small batches of them, also where a result is written
        with collecting(used), T.small_batches(spark):
            docs, path = materialize_at(stage(spark, docs, sf_dir))
        on_the_way = [p for p in used if p != path] if k < len(stages) else []
        release_materialized(spark, before + on_the_way)
    return docs
