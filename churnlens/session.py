"""Session helpers: a local session for tests/bench and the shared checkpoint folder."""

from __future__ import annotations

import atexit
import contextlib
import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str | int = "*", shuffle_partitions: int = 8, app: str = "churnlens") -> SparkSession:
    """Session for local runs (tests, bench).  Cluster jobs bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("CHURNLENS_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the folder that ``spark.checkpoint.dir`` names; on a cluster it is shared storage.

    Where nothing is configured, a session in one JVM (``local[...]``, as in tests) gets a scratch
    folder that goes with the process; any other session is refused, because executors would each
    write to a disk of their own.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="churnlens-ckpt-")
        atexit.register(shutil.rmtree, configured, ignore_errors=True)
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


_SCOPES: list[list[str]] = []


@contextlib.contextmanager
def collecting(paths: list[str]) -> Iterator[None]:
    """Tables written inside are noted in ``paths``, so that their owner can release them."""
    _SCOPES.append(paths)
    try:
        yield
    finally:
        _SCOPES.pop()


def materialize(df: DataFrame) -> DataFrame:
    return materialize_at(df)[0]


def materialize_at(df: DataFrame) -> tuple[DataFrame, str]:
    """Write ``df`` once as a parquet table under the session's checkpoint folder and read it back.

    Cuts the lineage like ``checkpoint()`` but in a single pass (a reliable RDD
    checkpoint recomputes an unpersisted plan to write it), columnar, with
    column pruning and file statistics for the readers.  The folder is the
    shared one named by ``spark.checkpoint.dir`` on a cluster, so the table
    survives the loss of any executor.
    """
    spark = df.sparkSession
    path = scratch_folder(spark)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path), path


def scratch_folder(spark: SparkSession) -> str:
    """A new folder below the shared checkpoint folder, released like what :func:`materialize` writes."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/churnlens-{uuid.uuid4().hex}"
    _MATERIALIZED.setdefault(spark.sparkContext.applicationId, []).append(path)
    if _SCOPES:
        _SCOPES[-1].append(path)
    return path


_MATERIALIZED: dict[str, list[str]] = {}


def release_materialized(spark: SparkSession, paths: list[str] | None = None) -> int:
    """Delete tables written by :func:`materialize` (all of this application's, or ``paths``)
    through the Hadoop FileSystem of each path, so shared storage does not fill up.
    Returns the number of tables deleted."""
    app = spark.sparkContext.applicationId
    todo = list(paths) if paths is not None else list(_MATERIALIZED.get(app, []))
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    done = 0
    for p in todo:
        hp = jvm.org.apache.hadoop.fs.Path(p)
        fs = hp.getFileSystem(conf)
        if fs.exists(hp):
            fs.delete(hp, True)
            done += 1
        if p in _MATERIALIZED.get(app, []):
            _MATERIALIZED[app].remove(p)
    return done
