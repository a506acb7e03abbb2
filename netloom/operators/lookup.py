"""Lookups over nodes (id, kind, name, path, parent) and edges (edge, port, endpoint, dir, sel), for all keys at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIGNALS = ("Var", "Memory", "Net", "Port")


def rank_of_kind(kind: Column) -> Column:
    """Preference among nodes of one path: Var and Memory, then Net, then Port."""
    return F.when(kind.isin("Var", "Memory"), 0).when(kind == "Net", 1).when(kind == "Port", 2)


def best_kind(kind: Column) -> Column:
    """Preference of a cross-probe: Var, Net, Port, Instance, GenBlock, others."""
    order = {"Var": 0, "Net": 1, "Port": 2, "Instance": 3, "GenBlock": 4}
    return F.coalesce(*[F.when(kind == k, v) for k, v in order.items()], F.lit(5))


def equivalence_sets(nodes: DataFrame) -> DataFrame:
    """Per path: its nodes in order of ids, and the representative."""
    return nodes.groupBy("path").agg(
        F.min_by("id", F.struct(best_kind(F.col("kind")), "id")).alias("anchor"),
        F.count("*").alias("n"),
        F.array_join(F.array_sort(F.collect_list("id")).cast("array<string>"), ",").alias("ids"),
    )


def pick_node(nodes: DataFrame) -> DataFrame:
    """Per path the best signal; paths without a signal are left out."""
    signals = nodes.where(F.col("kind").isin(*SIGNALS))
    return signals.groupBy("path").agg(F.min_by("id", F.struct(rank_of_kind(F.col("kind")), "id")).alias("id"))


def incident(edges: DataFrame) -> DataFrame:
    """(node, edge, other, is_port, dir, sel): every edge at both ends, a self-loop once."""
    near = edges.select(F.col("port").alias("node"), "edge", F.col("endpoint").alias("other"), F.lit(True).alias("is_port"), "dir", "sel")
    far = edges.where("port <> endpoint").select(F.col("endpoint").alias("node"), "edge", F.col("port").alias("other"), F.lit(False).alias("is_port"), "dir", "sel")
    return near.unionByName(far)


def degrees(edges: DataFrame) -> DataFrame:
    return incident(edges).groupBy("node").agg(F.count("*").alias("degree"))


def hot_nets(edges: DataFrame, most: int = 20) -> DataFrame:
    """The report of nodes with most edges; ties by id."""
    return degrees(edges).orderBy(F.desc("degree"), "node").limit(most)


def summary(nodes: DataFrame) -> DataFrame:
    """Nodes and distinct paths of each kind."""
    return nodes.groupBy("kind").agg(F.count("*").alias("nodes"), F.countDistinct("path").alias("paths"))


def derived_path(nodes: DataFrame, members: DataFrame) -> DataFrame:
    """members (parent_id, member): nodes at the parent's path followed by a dot and the member."""
    at = members.join(nodes.select(F.col("id").alias("parent_id"), F.col("path").alias("base")), "parent_id")
    at = at.withColumn("path", F.concat("base", F.lit("."), "member"))
    return at.join(nodes.select("path", "id", "kind"), "path").select("parent_id", "member", "id", "kind")
