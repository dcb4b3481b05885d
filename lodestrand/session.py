"""Sessions, shared scratch space and table reading."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_type


def local_session(app: str = "lodestrand", cores: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benches; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``.

    Only a local master, as in tests, gets a folder of its own when the setting is missing;
    on a cluster a folder of one machine would be lost with it, so that is refused.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not shared:
        jvm_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        shared = jvm_dir.get() if jvm_dir.isDefined() else None
    if not shared:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir is unset: name a folder that all executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="lodestrand-")
        spark.sparkContext.setCheckpointDir(shared)
    return shared


def stored(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """``df`` written to the shared folder and read back: lineage is cut, a lost executor costs nothing."""
    spark = df.sparkSession
    path = os.path.join(scratch_dir(spark), f"{name}-{uuid.uuid4().hex}")
    writer = df.write.mode("errorifexists")
    if not partition_by:
        writer.parquet(path)
        return spark.read.schema(df.schema).parquet(path)
    # a file open for each of a few partition values saves sorting the rows
    setting = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "16")
    try:
        writer.partitionBy(*partition_by).parquet(path)
    finally:
        spark.conf.set(setting, before)
    return spark.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once per context, for clusters where it isn't installed."""
    sc = spark.sparkContext
    if not getattr(sc, "_lodestrand_shipped", False):
        root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        target = os.path.join(tempfile.mkdtemp(), "lodestrand.zip")
        with zipfile.ZipFile(target, "w") as z:
            for folder, _, files in os.walk(os.path.join(root, "lodestrand")):
                for f in files:
                    if f.endswith(".py"):
                        z.write(os.path.join(folder, f), os.path.relpath(os.path.join(folder, f), root))
        sc.addPyFile(target)
        sc._lodestrand_shipped = True


def arrow_type(df: DataFrame, column: str) -> pa.DataType:
    return to_arrow_type(df.schema[column].dataType)


def spread(df: DataFrame) -> DataFrame:
    """A scan of fewer splits than cores dealt out over the cores, for work in Python; a larger scan stays as it is."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
