"""Tables that cut lineage, in the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """What spark.checkpoint.dir names. Where it is unset, a temporary folder of this process on a local master, else an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not held.isDefined():
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        own = tempfile.mkdtemp(prefix="lodestone-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(own)
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
    return held.get().rstrip("/")


def new_path(spark: SparkSession) -> str:
    return f"{folder(spark)}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def settled(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: lineage ends there, and a lost executor costs nothing.

    The tables stay until `release` is called or the folder is emptied.
    """
    path = new_path(df.sparkSession)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str) -> DataFrame:
    """As settled, dealt into as many buckets by key as there are shuffle partitions: joins and groups by the key read it without a shuffle."""
    spark = df.sparkSession
    name, path = f"lodestone_{uuid.uuid4().hex}", new_path(spark)
    number = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    df.write.bucketBy(number, key).option("path", path).option("compression", "zstd").saveAsTable(name)
    named.setdefault(spark.sparkContext.applicationId, []).append(name)
    return spark.table(name)


#: Names of the tables that `bucketed` has put into the catalogue, by application.
named: dict[str, list[str]] = {}


def release(spark: SparkSession) -> None:
    """Removes every table that this application settled; results that still read them end."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder(spark)}/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    for name in named.pop(spark.sparkContext.applicationId, []):
        spark.sql(f"DROP TABLE IF EXISTS {name}")
