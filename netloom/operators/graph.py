"""Schematic graph: nets joined driver to load, ties, dangling pins, caps that say what they dropped, and bounded cones."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netloom.operators.lookup import degrees, incident
from netloom.operators.store import saved

ORDER = ("port", "endpoint", "dir", "sel")


@dataclass(frozen=True)
class Limits:
    """Hops, edges followed from a node, and nodes altogether."""

    depth: int = 4
    fanout: int = 32
    boxes: int = 500


def drives(is_port: Column, direction: Column, forward: bool) -> Column:
    """Whether a step from this end of an edge follows the wanted direction; a direction is relative to the port.

    Forwards: an output from its port, and from the other end whatever reads, inout included. Backwards: the reverse.
    """
    out = direction == "out"
    return (is_port & out) | (~is_port & ~out) if forward else (is_port & ~out) | (~is_port & out)


def box_drives(is_port: Column, direction: Column) -> Column:
    """Whether the far end of an edge drives the node at this end rather than reading it."""
    return drives(is_port, direction, False)


def signal_groups(nodes: DataFrame) -> DataFrame:
    """(id, group): the least id among the signals of a path; other nodes stand alone."""
    signals = nodes.where(F.col("kind").isin("Port", "Net", "Var"))
    least = signals.groupBy("path").agg(F.min("id").alias("group"))
    grouped = signals.join(least, "path").select("id", "group")
    return grouped.unionAll(nodes.where(~F.col("kind").isin("Port", "Net", "Var")).select("id", F.col("id").alias("group")))


def signal_join(edges: DataFrame) -> DataFrame:
    """(net, driver, load): drivers times loads on each net, without pairs whose selects are both given and differ.

    The rows are the wires of a net; use fanout_cap where nets are too wide to draw.
    """
    drives, reads = F.col("dir").isin("out", "inout"), F.col("dir").isin("in", "inout")
    # a port's own edges on a net come first: what it drives and reads there; so a pair is met once, from its lesser port, and nothing is left to be grouped
    sels = lambda when: F.collect_set(F.when(when & F.col("sel").isNotNull(), F.col("sel")))
    ports = edges.where("endpoint IS NOT NULL AND port IS NOT NULL").where(drives | reads).groupBy(F.col("endpoint").alias("net"), "port").agg(
        F.bool_or(drives & F.col("sel").isNull()).alias("d"), sels(drives).alias("ds"), F.bool_or(reads & F.col("sel").isNull()).alias("l"), sels(reads).alias("ls")
    )
    a = ports.select("net", F.col("port").alias("a"), F.struct("d", "ds", "l", "ls").alias("x"))
    b = ports.select("net", F.col("port").alias("b"), F.struct("d", "ds", "l", "ls").alias("y"))

    def meets(p: str, q: str) -> Column:
        d, l, ds, ls = F.col(f"{p}.d"), F.col(f"{q}.l"), F.col(f"{p}.ds"), F.col(f"{q}.ls")
        return (d & (l | (F.size(ls) > 0))) | (l & (F.size(ds) > 0)) | F.arrays_overlap(ds, ls)

    return a.join(b, "net").where(F.col("a") < F.col("b")).where(meets("x", "y") | meets("y", "x")).select("net", "a", "b")


def net_ties(nodes: DataFrame, edges: DataFrame, constants: DataFrame) -> DataFrame:
    """(group, constant): path groups with exactly one driver, that without a select and an Assign or Comb with a constant.

    ``constants`` (id, constant). Edges inside a group are no drivers.
    """
    groups = signal_groups(nodes).withColumnRenamed("id", "node")
    near = incident(edges).hint("merge").join(groups, "node").join(groups.select(F.col("node").alias("other"), F.col("group").alias("og")), "other")
    near = near.where((F.col("group") != F.col("og")) & box_drives(F.col("is_port"), F.col("dir")))
    one = near.groupBy("group").agg(F.count("*").alias("n"), F.count("sel").alias("selects"), F.min("other").alias("id")).where("n = 1 AND selects = 0")
    logic = nodes.where("kind IN ('Assign', 'Comb')").select("id").join(constants.where("constant IS NOT NULL"), "id")
    return one.join(logic, "id").select("group", "constant")


def tied_nodes(nodes: DataFrame, driven: DataFrame) -> DataFrame:
    """(id, constant): nodes of the groups that :func:`net_ties` gives, from driven (node, other, sel, constant): ``other`` drives ``node``, with its constant if it is a block that has one.

    Only groups that a constant drives are looked at, so most nodes and edges stay out of the joins by path.
    """
    tied = saved(driven.where("constant IS NOT NULL").select(F.col("node").alias("id")).distinct(), "tied")
    at = saved(nodes.select("id", "kind", "path").join(tied, "id", "left_semi"), "tied")
    signal = F.col("kind").isin("Port", "Net", "Var")
    mates = nodes.where(signal).select("id", "path").join(at.where(signal).select("path").distinct(), "path", "left_semi")
    least = mates.groupBy("path").agg(F.min("id").alias("group"))
    groups = saved(mates.join(least, "path").select("id", "group").unionAll(at.where(~signal).select("id", F.col("id").alias("group"))), "tied")
    near = driven.join(groups.withColumnRenamed("id", "node"), "node").join(groups.select(F.col("id").alias("other"), F.col("group").alias("og")), "other", "left").where("og IS NULL OR og <> group")
    one = near.groupBy("group").agg(F.count("*").alias("n"), F.count("sel").alias("selects"), F.max("constant").alias("constant")).where("n = 1 AND selects = 0 AND constant IS NOT NULL")
    return groups.join(one.select("group", "constant"), "group").select("id", "constant")


def csr(edges: DataFrame, bits: int = 16) -> DataFrame:
    """(node, start, n): where each node's incident edges start in an index ordered by node, and how many there are.

    Prefix sums in two steps: over blocks of 2**bits node numbers that have edges, whose totals alone meet in one task, then inside each block.
    """
    counts = degrees(edges).withColumn("block", F.shiftright("node", bits))
    totals = counts.groupBy("block").agg(F.sum("degree").alias("total"))
    before = totals.select("block", F.coalesce(F.sum("total").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = Window.partitionBy("block").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
    rows = counts.withColumn("here", F.coalesce(F.sum("degree").over(inside), F.lit(0))).join(before, "block")
    return rows.select("node", (F.col("before") + F.col("here")).alias("start"), F.col("degree").alias("n"))


def fanout_cap(edges: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped): the first ``most`` edges of each endpoint in canonical order, and per endpoint how many were left out."""
    order = Window.partitionBy("endpoint").orderBy("port", "dir", F.coalesce("sel", F.lit("")))
    ranked = edges.withColumn("rank", F.row_number().over(order))
    kept = ranked.where(F.col("rank") <= most).drop("rank")
    dropped = edges.groupBy("endpoint").agg(F.count("*").alias("n")).select("endpoint", F.least("n", F.lit(most)).alias("kept"), F.greatest(F.col("n") - most, F.lit(0)).alias("more"))
    return kept, dropped


def trunks(edges: DataFrame, parents: DataFrame) -> DataFrame:
    """(endpoint, box, n, ports): edges from one endpoint to ports of one box, where there is more than one."""
    rows = edges.join(parents.select(F.col("id").alias("port"), F.col("parent").alias("box")), "port")
    return rows.groupBy("endpoint", "box").agg(F.count("*").alias("n"), F.min("port").alias("first")).where("n > 1")


def cone(edges: DataFrame, seeds: DataFrame, limits: Limits = Limits(), forward: bool | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, cut): nodes (seed, node, hop) within the limits of each seed; cut (seed, more): what was left out, for every seed.

    A breadth-first frontier for all seeds at once. From a node the first ``fanout`` edges in canonical order are followed, and a
    seed takes new nodes, nearest hop and least id first, until it has ``boxes``. Every hop is written to the shared
    folder, so plans stay short and a lost executor costs one hop. ``forward`` None follows both directions.
    """
    near = incident(edges)
    if forward is not None:
        near = near.where(drives(F.col("is_port"), F.col("dir"), forward))
    order = Window.partitionBy("node").orderBy("other", "edge")
    steps = near.withColumn("r", F.row_number().over(order))
    over = steps.groupBy("node").agg(F.greatest(F.count("*") - limits.fanout, F.lit(0)).alias("over"))
    steps = steps.where(F.col("r") <= limits.fanout).select("node", "other")

    def kept(df: DataFrame) -> DataFrame:
        return saved(df, "cone")

    seen = kept(seeds.select("seed", F.col("seed").alias("node"), F.lit(0).alias("hop")).distinct())
    cuts = seen.select("seed", F.lit(0).cast("long").alias("more")).limit(0)
    for hop in range(1, limits.depth + 1):
        front = seen.where(F.col("hop") == hop - 1)
        cuts = cuts.unionAll(front.join(over, "node").groupBy("seed").agg(F.sum("over").alias("more")))
        new = front.join(steps, "node").select("seed", F.col("other").alias("node")).distinct().join(seen, ["seed", "node"], "left_anti")
        room = seen.groupBy("seed").agg((F.lit(limits.boxes) - F.count("*")).alias("room"))
        new = new.withColumn("r", F.row_number().over(Window.partitionBy("seed").orderBy("node"))).join(room, "seed")
        new = kept(new)
        cuts = cuts.unionAll(new.where("r > room").groupBy("seed").agg(F.count("*").alias("more")))
        added = new.where("r <= room").select("seed", "node", F.lit(hop).alias("hop"))
        if added.isEmpty():
            break
        seen = kept(seen.unionAll(added))
    cut = seeds.select("seed").distinct().join(cuts.groupBy("seed").agg(F.sum("more").alias("more")), "seed", "left")
    return seen, cut.select("seed", F.coalesce("more", F.lit(0)).alias("more"), (F.coalesce("more", F.lit(0)) > 0).alias("truncated"))


def cone_legacy(edges: DataFrame, seeds: DataFrame, owners: DataFrame, direction: str = "inout", depth: int = 4) -> tuple[DataFrame, DataFrame]:
    """(boxes, wires) of every seed: (seed, box, hop), the instances reached, and (seed, edge, hop), the edges on the way.

    owners (id, ancestor) names the nearest instance of a node. A direction is compared with the edge's alone, whichever end it is met from.
    A box is walked on from the first node that reaches it: nodes in the order found, then edges by name. For all seeds at once, a hop a round.
    """
    near = incident(edges)
    if direction != "inout":
        near = near.where(F.col("dir") == direction)
    near = near.select("node", "edge", "other")
    homes = owners.where("ancestor IS NOT NULL").select(F.col("id").alias("other"), F.col("ancestor").alias("box"))
    front = seeds.select("seed", F.col("seed").alias("node"), F.lit(0).alias("rank")).distinct()
    wires = saved(front.join(near, "node").select("seed", "edge", F.lit(0).alias("hop")).limit(0), "wires")
    boxes = saved(front.join(homes, F.col("node") == F.col("other")).select("seed", "box", F.lit(0).alias("hop")).limit(0), "boxes")
    for hop in range(1, max(depth, 1) + 1):
        met = front.join(near, "node").groupBy("seed", "edge").agg(F.min(F.struct("rank", "other")).alias("m")).join(wires, ["seed", "edge"], "left_anti")
        met = saved(met.select("seed", "edge", "m.rank", "m.other"), "met")
        if met.isEmpty():
            break
        wires = wires.unionAll(met.select("seed", "edge", F.lit(hop).alias("hop")))
        first = met.join(homes, "other").groupBy("seed", "box").agg(F.min(F.struct("rank", "edge", "other")).alias("m")).join(boxes, ["seed", "box"], "left_anti")
        order = Window.partitionBy("seed").orderBy("m.rank", "m.edge")
        first = saved(first.select("seed", "box", F.col("m.other").alias("node"), F.row_number().over(order).alias("rank")), "front")
        boxes = boxes.unionAll(first.select("seed", "box", F.lit(hop).alias("hop")))
        front = first.select("seed", "node", "rank")
    return boxes, wires


def seed_signals(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, kinds: tuple[str, ...], forward: bool | None = None) -> DataFrame:
    """(seed, node): where a walk from a seed starts: a box of one of ``kinds`` at its neighbours on the wanted side, others at every node of their path."""
    at = seeds.select(F.col("seed").alias("id")).distinct().join(nodes.select("id", "kind", "path"), "id")
    near = incident(edges)
    if forward is not None:
        near = near.where(drives(F.col("is_port"), F.col("dir"), forward))
    boxed = at.where(F.col("kind").isin(*kinds)).join(near, F.col("id") == F.col("node")).select(F.col("id").alias("seed"), F.col("other").alias("node"))
    plain = at.where(~F.col("kind").isin(*kinds)).select(F.col("id").alias("seed"), "path").join(nodes.select("path", F.col("id").alias("node")), "path").select("seed", "node")
    return boxed.distinct().unionAll(plain)
