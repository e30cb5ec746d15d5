"""Tables written once and read again: they cut lineage and survive lost executors."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a local session, as in tests, may leave it unset and gets a folder beside the warehouse."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "-shared"


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used yet."""
    return f"{shared_folder(spark)}/boardmill/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` computed once, written to the shared folder and read from there, and where that is."""
    path = fresh_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def staged(df: DataFrame, name: str) -> DataFrame:
    """The same without the place; the files stay until the folder's owner clears it."""
    return stage(df, name)[0]


def forget(spark: SparkSession, path: str) -> None:
    """Removes a staged table that nothing reads any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
