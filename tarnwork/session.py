"""Session settings and the shared folder that every executor can reach."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings that suit every layer job; AQE does the coalescing and the skew handling of joins.
BASE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.parquet.compression.codec": "snappy",
}


def build(app: str = "tarnwork", master: str | None = None, **conf: str) -> SparkSession:
    """A session with BASE_CONF; ``conf`` wins over it."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    return b.config(map={**BASE_CONF, **conf}).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder the cluster names. Only where it names none and all runs in this one process (local master, as in
    tests) a local folder is set, which goes when the process ends; elsewhere executors would not see each other's files."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        at = spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="tarnwork-")
        atexit.register(shutil.rmtree, at, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(at)
    elif spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(at)
    return at


#: Folders written by ``cut`` in this process, by application; ``release`` empties it.
_WRITTEN: dict[str, list[str]] = {}


def new_dir(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses; it is remembered for ``release``."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back: lineage ends there, and a lost executor costs nothing.
    The folder stays until ``release``, as the result is read lazily. A folder that executors do not share is an error, not an
    empty table."""
    spark = df.sparkSession
    path = new_dir(spark, name)
    df.write.parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/part-*")
    if not len(at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at)):
        raise RuntimeError(f"executors wrote nothing the driver can see to {path}: is the folder shared?")
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Delete what this application has cut so far, once the results that read it are written; the number of folders."""
    paths = _WRITTEN.pop(spark.sparkContext.applicationId, [])
    for p in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(p)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    return len(paths)


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of ``df``; runs no job."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
