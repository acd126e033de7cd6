"""Lineage cuts that survive lost executors: tables in the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``.

    Where the setting is empty a local session gets a temporary folder; a cluster
    session is refused, as a machine-local folder would lose data with its machine.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if not d:
        known = sc._jsc.sc().getCheckpointDir()
        d = known.get() if known.isDefined() else None
    if not d:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        d = tempfile.mkdtemp(prefix="stanzaflow-")
        sc.setCheckpointDir(d)
    return d.rstrip("/")


def _path(spark: SparkSession, where: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(where)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


#: Folders of this session that are still there.
_kept: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed by ``discard_all`` or when the session's JVM ends."""
    where = f"{shared_dir(spark)}/stage-{uuid.uuid4().hex[:12]}"
    p, fs = _path(spark, where)
    fs.mkdirs(p)
    fs.deleteOnExit(p)  # takes only paths that exist
    _kept.append(where)
    return f"{where}/{name}"


def stage(df: DataFrame, name: str = "t") -> DataFrame:
    """Write ``df`` once as a table in the shared folder and read it back.

    The result has no lineage, can be read again after executors are lost, and gives
    the planner true sizes. The table is removed when the session's JVM ends.
    """
    spark = df.sparkSession
    where = scratch(spark, name)
    df.write.parquet(where)
    out = spark.read.schema(df.schema).parquet(where)
    out._stanzaflow_stage = where
    return out


def discard(df: DataFrame | None) -> None:
    """Remove a staged table that nothing reads any more."""
    where = getattr(df, "_stanzaflow_stage", None)
    if where:
        p, fs = _path(df.sparkSession, where)
        fs.delete(p.getParent(), True)
        folder = where.rsplit("/", 1)[0]
        if folder in _kept:
            _kept.remove(folder)


def discard_all(spark: SparkSession) -> int:
    """Remove all tables staged so far; to be called once results are written, as they are read lazily. Gives their number."""
    n = len(_kept)
    while _kept:
        p, fs = _path(spark, _kept.pop())
        fs.delete(p, True)
    return n
