"""Cutting lineage through the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where it is unset: a folder of the machine if Spark runs on this one alone,
    else an error, as executors elsewhere would not see it."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-groundweave-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def written(df: DataFrame, tag: str) -> DataFrame:
    """Writes df once to the shared folder and reads it back: later jobs neither recompute it nor see other row orders."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/groundweave/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)  # hex digests and ids halve
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt to all tasks (by keys), for small tables whose rows take long: a shuffle without a number would be put together again."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), *keys)


def discard(*tables: DataFrame) -> None:
    """Removes tables that written() returned, once nothing that is still to run reads them; others are left alone."""
    for df in tables:
        path = vars(df).pop("written_to", None)
        if path:
            spark = df.sparkSession
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
