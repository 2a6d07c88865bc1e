"""Session construction, table access and lineage cutting."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def session(cores: int = 8, partitions: int | None = None) -> SparkSession:
    """A local session with the settings the engine expects: UTC, AQE, Arrow."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(partitions or cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    reachable(spark)
    return spark


def reachable(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it; on a cluster it lies there on every node, or is sent with --py-files."""
    own = str(Path(__file__).resolve().parent.parent)
    environment = spark.sparkContext.environment
    known = environment.get("PYTHONPATH", "")
    if own not in known.split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(x for x in (own, known) if x)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reachable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder. A local session without one gets a temporary folder; on a cluster the setting is needed, as executors would write to disks of their own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = os.path.join(tempfile.gettempdir(), "weblens-checkpoint")
        spark.conf.set("spark.checkpoint.dir", named)
    return named


def file_system(spark: SparkSession, path: str):
    """(file system, path) as Hadoop has them, whatever the scheme."""
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    return own.getFileSystem(spark._jsc.hadoopConfiguration()), own


def shared_path(spark: SparkSession, name: str = "table") -> str:
    """A new path in the shared folder, deleted when the application ends."""
    path = f"{shared_dir(spark).rstrip('/')}/weblens-{name}-{uuid.uuid4().hex}"
    fs, own = file_system(spark, path)
    fs.deleteOnExit(own)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared folder."""
    spark = df.sparkSession
    named = shared_dir(spark)
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(named)
        fs, own = file_system(spark, context._jsc.sc().getCheckpointDir().get())
        fs.deleteOnExit(own)
    return df.checkpoint(eager=True)


def write_shared(df: DataFrame) -> DataFrame:
    """Write df once as Parquet in the shared folder and read it back, so several uses share one computation."""
    path = shared_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
