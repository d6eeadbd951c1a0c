"""Session settings and the shared scratch folder for intermediate tables."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings the jobs are planned for. A caller's own session works as well; these
# only make skewed joins and small shuffles cheaper.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def build_session(app_name: str = "wardflow", master: str | None = None, **extra: str) -> SparkSession:
    """Session with the recommended settings; ``extra`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {**SETTINGS, **{k.replace("__", "."): v for k, v in extra.items()}}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession) -> str:
    """Folder all executors can reach, as named by ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder of its own.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    local = tempfile.mkdtemp(prefix="wardflow-")
    context.setCheckpointDir(local)
    return local


def scratch_path(spark: SparkSession, label: str) -> str:
    path = f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _handed_out.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


# Scratch paths handed out, per application.
_handed_out: dict[str, list[str]] = {}


def clear_scratch(spark: SparkSession) -> int:
    """Delete the intermediate tables written so far; returns how many.

    To be called once the results of the jobs are stored: until then they may still
    read from the scratch folder.
    """
    context = spark.sparkContext
    paths = _handed_out.pop(context.applicationId, [])
    hadoop = context._jvm.org.apache.hadoop.fs
    for path in paths:
        target = hadoop.Path(path)
        target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)
    return len(paths)


def materialize(df: DataFrame, label: str, *folders: str) -> DataFrame:
    """Write ``df`` once as Parquet in the scratch folder and read it back.

    Later branches share the written rows, read only the columns they need and
    do not depend on the lineage (or the executors) that produced them. Filters on
    columns named in ``folders`` read only the matching files.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.partitionBy(*folders).parquet(path)
    return spark.read.schema(df.schema).parquet(path).select(*df.columns)


def bench_cpus(default: int = 8) -> int:
    return int(os.environ.get("BENCH_CPUS", default))
