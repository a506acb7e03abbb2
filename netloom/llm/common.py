"""Shared pieces of the text operators: saved tables, column clashes, components."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Used only where a session on one machine names no spark.checkpoint.dir (tests, notebooks).
FALLBACK_DIR = "/tmp/checkpoints"
#: Nodes that a task holds while it joins links (some 200 bytes each).
HELD = 500_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (named or FALLBACK_DIR).rstrip("/")


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Cuts the lineage like checkpoint(), but keeps columns compressed and prunable.
    The table is removed when the session's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/netloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 1000, size: str = "4m") -> None:
    """Bound an Arrow batch by rows and bytes; texts here may be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def fresh(df: DataFrame, *names: str) -> DataFrame:
    """Drop columns of ``df`` that an operator is about to add (its result wins a clash)."""
    mine = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in mine])


def widened(df: DataFrame, **kinds: str) -> StructType:
    """The schema of ``df`` with further columns (name and simple type)."""
    more = ", ".join(f"{name} {kind}" for name, kind in kinds.items())
    return StructType([*df.schema.fields, *StructType.fromDDL(more).fields])


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(u, v): of the links of a partition, every node with the least node that they reach."""
    head: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while head[root] != root:
            root = head[root]
        while head[x] != root:
            head[x], x = root, head[x]
        return root

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            head.setdefault(a, a)
            head.setdefault(b, b)
            p, q = find(a), find(b)
            if p != q:
                head[max(p, q)] = min(p, q)
        if len(head) > HELD:
            yield _forest(head, find)
            head.clear()
    yield _forest(head, find)


def _forest(head: dict[int, int], find: Callable[[int], int]) -> pa.RecordBatch:
    rows = [(x, find(x)) for x in head if find(x) != x]
    return pa.RecordBatch.from_arrays([pa.array([x for x, _ in rows], pa.int64()), pa.array([x for _, x in rows], pa.int64())], ["u", "v"])


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable over undirected ``links`` (a, b).

    Tasks first join what their own links connect, which shortens chains and leaves a link a node. Then alternating large-star and
    small-star rounds: every round is two aggregations with map-side combining and two joins of long pairs; the links
    are saved between rounds, and the number of rounds grows with the logarithm of the longest chain.
    """
    edges = saved(links.where("a <> b").select("a", "b").mapInArrow(_joined, "u long, v long"), "links")
    before = None
    for _ in range(rounds):
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        edges = saved(small.unionAll(low.select("u", F.col("m").alias("v"))).distinct(), "links")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
