"""Tables that operators write between rounds, in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Used only where a session on one machine names no spark.checkpoint.dir.
FALLBACK_DIR = "/tmp/checkpoints"
#: Rows of a written table that Spark may broadcast by its own choice, at most.
MOST_ROWS = 100_000


def shared_dir(spark: SparkSession) -> str:
    named = spark.conf.get("spark.checkpoint.dir", None)
    master = spark.sparkContext.master
    if not named and master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (named or FALLBACK_DIR).rstrip("/")


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` as Parquet, read again: it is worked out once and its lineage ends. The table goes when the session's JVM ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/netloom/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def planned(df: DataFrame, rows: int) -> DataFrame:
    """``df`` of so many rows, which aren't broadcast if they are many. Spark goes by the bytes of files, and compressed ids are a small part of what they take in memory."""
    return df.hint("merge") if rows > MOST_ROWS else df


def sized(df: DataFrame, name: str) -> DataFrame:
    """:func:`saved`, never broadcast where it has more than ``MOST_ROWS`` rows. The hint holds through filters, projections and groups, not through unions and joins."""
    seen = Observation()
    made = saved(df.observe(seen, F.count(F.lit(1)).alias("n")), name)
    return planned(made, seen.get["n"])
