"""A synthetic design of any size from ``spark.range``: a tree of instances with nets at its leaves and a clock star."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def design(spark: SparkSession, nodes: int, fanout: int = 8) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a ``fanout``-ary tree: node k's parent is (k - 1) div fanout; every net reads the clock, node 1."""
    ids = spark.range(nodes).withColumn("parent", F.when(F.col("id") > 0, F.expr(f"(id - 1) div {fanout}")))
    leaf = F.col("id") * fanout + 1 >= nodes
    kind = F.when(F.col("id") == 1, "Net").when(leaf, "Net").otherwise("Instance")
    table = ids.select("id", kind.alias("kind"), F.concat(F.lit("n"), "id").alias("name"), "parent")
    nets = table.where("kind = 'Net' AND id <> 1")
    edges = nets.select(F.col("id").alias("port"), F.lit(1).cast("long").alias("endpoint"), F.lit("in").alias("dir"), F.lit(None).cast("string").alias("sel"))
    edges = edges.withColumn("edge", F.concat_ws(">", "port", "endpoint"))
    return table, edges
