"""Tables that cut lineage, in the folder that the cluster shares, and graph components over them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a local session, as in tests, may leave it unset and gets a folder beside the warehouse."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "-shared"


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` computed once, written as Parquet to the shared folder and read from there, and where that is.

    Survives lost executors: what they wrote is in the shared folder.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/boardmill/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def written(df: DataFrame, name: str) -> DataFrame:
    """The same without the place; the files stay until the folder's owner clears it, as with reliable checkpoints."""
    return stored(df, name)[0]


def forget(spark: SparkSession, path: str) -> None:
    """Removes a stored table that nothing reads any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def _with_low(pairs: DataFrame, lows: DataFrame) -> DataFrame:
    """``pairs`` with the low of their u; the further key makes both sides shuffle anew, so that Spark can split a hub."""
    key = F.xxhash64("u").alias("key")
    return pairs.select("u", "v", key).join(lows.select("u", "low", key), ["u", "key"]).drop("key")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (a, b): component is the smallest node reachable.

    Alternates large and small stars, each a map-side combined minimum joined back to the edges,
    until the edges are stars; the number of rounds is logarithmic in the longest path.  Each
    round's table replaces the one before.
    """
    pairs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct()
    (pairs, path), seen = stored(pairs, "edges"), None
    while True:
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lows = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("low", "u").alias("low"))
        large = _with_low(both, lows).where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()
        lows = large.groupBy("u").agg(F.min("v").alias("low"))
        small = _with_low(large, lows).select(F.when(F.col("v") == F.col("low"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("low").alias("v"))
        before = path
        pairs, path = stored(small.where("u > v").distinct(), "edges")
        forget(pairs.sparkSession, before)
        mark = tuple(pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if mark == seen or not mark[0]:
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).union(pairs.select("v", "v").distinct())
        seen = mark
