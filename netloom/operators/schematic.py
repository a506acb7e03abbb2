"""Scope graphs for all scopes at once: boxes, structural wires, ties of constants, folded inverters, pin widths and roles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.operators.store import saved


def wires(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(a, b, n): pairs of boxes (the parents of an edge's ends, or the ends themselves under the top) that edges join, unordered."""
    at = nodes.select("id", F.coalesce("parent", "id").alias("box"))
    ends = edges.join(at.select(F.col("id").alias("port"), F.col("box").alias("x")), "port").join(at.select(F.col("id").alias("endpoint"), F.col("box").alias("y")), "endpoint")
    ends = ends.where("x <> y")
    return ends.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.count("*").alias("n"))


#: Kinds of logic boxes and of gates.
LOGIC = ("FF", "Comb", "Latch", "Assign", "Memory")
GATES = ("And", "Or", "Xor", "Xnor", "Nand", "Nor", "Not", "Buf", "Add", "Sub", "Mul", "Cmp", "Shift", "Mux", "Concat")


def bare_interfaces(nodes: DataFrame) -> DataFrame:
    """(id): interfaces that hold a modport and aren't one's view themselves."""
    views = nodes.where("kind = 'Modport'").select(F.col("parent").alias("id")).distinct()
    return nodes.where("kind = 'Interface'").select("id").join(views, "id", "left_semi")


def navigable(nodes: DataFrame) -> DataFrame:
    """(id): instances, bare interfaces, and GenBlocks that hold one of them under GenBlocks only, however deep."""
    scopes = nodes.where("kind = 'Instance'").select("id").unionAll(bare_interfaces(nodes))
    out = scopes
    level = nodes.join(scopes, "id", "left_semi").select(F.col("parent").alias("id"))
    blocks = saved(nodes.where("kind = 'GenBlock'").select("id", "parent"), "blocks")
    # GenBlocks whose chain of GenBlocks a scope hangs under: upwards from the scopes' parents, new ones only
    level = saved(blocks.join(level.distinct(), "id", "left_semi"), "level")
    seen = level
    while not level.isEmpty():
        up = blocks.join(level.select(F.col("parent").alias("id")).distinct(), "id", "left_semi")
        level = saved(up.join(seen.select("id"), "id", "left_anti"), "level")
        seen = saved(seen.unionAll(level), "seen")
    return out.unionAll(seen.select("id"))


def predicates(nodes: DataFrame) -> DataFrame:
    """(id, navigable, logic, signal): kinds by their use."""
    rows = nodes.join(navigable(nodes).withColumn("reached", F.lit(True)), "id", "left")
    kind = F.col("kind")
    return rows.select("id", F.coalesce("reached", F.lit(False)).alias("navigable"), kind.isin(*LOGIC).alias("logic"), kind.isin("Port", "Net", "Var", "Memory").alias("signal"))


def hoisted(nodes: DataFrame) -> DataFrame:
    """(parent, child): tree children, which are navigable scopes; a named GenBlock that holds unnamed ones gives way to its navigable children."""
    scopes = saved(nodes.join(navigable(nodes), "id", "left_semi").select("id", "parent"), "scopes")
    runs = nodes.where("kind = 'GenBlock' AND name = ''").select(F.col("parent").alias("id")).distinct()
    arrays = nodes.where("kind = 'GenBlock' AND name <> ''").join(runs, "id", "left_semi").select("id")
    direct = scopes.where("parent IS NOT NULL").join(arrays, "id", "left_anti").select("parent", F.col("id").alias("child"))
    # as children of an array they show one level higher too
    lifted = scopes.join(arrays, "id", "left_semi").select(F.col("id").alias("array"), F.col("parent").alias("above"))
    inner = scopes.join(lifted, F.col("parent") == F.col("array")).select(F.col("above").alias("parent"), F.col("id").alias("child"))
    return direct.unionAll(inner)


def width(type_: Column, enum_width: Column) -> Column:
    """The first bracketed range of a type, else one made of its enum's width."""
    found = F.regexp_extract(type_, r"(\[[^\]]*\])", 1)
    return F.when(found != "", found).when(enum_width.isNotNull(), F.concat(F.lit("["), (enum_width - 1).cast("string"), F.lit(":0]")))


def ff_role(role: Column, name: Column, side: Column, kind: Column) -> Column:
    """A pin's role: q in the east, then the model's, then by name; clock and reset only at flip-flops."""
    low, ff = F.lower(name), kind == "FF"
    # fixed values: the patterns of conventional names
    clock, reset, enable = r"(^|_)(clk|clock)", r"(^|_)(rst|reset)", r"(^|_)(en|ce|enable)($|_)"
    known = F.when(role.isin("clk", "reset", "enable"), role)
    named = F.when(ff & low.rlike(clock), "clk").when(ff & low.rlike(reset), "reset").when(low.rlike(enable), "enable").otherwise("data")
    return F.when(side == "east", "q").otherwise(F.coalesce(known, named))


def fold_inverters(gates: DataFrame, edges: DataFrame) -> DataFrame:
    """(inverter, reader, operand): inverters drawn as a bubble on the one gate that reads them.

    gates (id, kind), edges (port, endpoint, dir): an inverter that drives a net by an output stays, as does one with other readers or without an operand.
    """
    inverters = gates.where("kind = 'Not'").select(F.col("id").alias("inverter"))
    roots = edges.where("dir = 'out'").select(F.col("port").alias("inverter")).distinct()
    reads = edges.where("dir = 'in'").groupBy(F.col("endpoint").alias("inverter")).agg(F.count("*").alias("readers"), F.min("port").alias("reader")).where("readers = 1")
    operand = edges.where("dir <> 'out'").groupBy(F.col("port").alias("inverter")).agg(F.min("endpoint").alias("operand"))
    found = inverters.join(roots, "inverter", "left_anti").join(reads, "inverter").join(operand, "inverter")
    return found.join(gates.where(F.col("kind").isin(*GATES)).select(F.col("id").alias("reader")), "reader", "left_semi").select("inverter", "reader", "operand")


def gate_children(gates: DataFrame, edges: DataFrame) -> DataFrame:
    """(block, gate): gates (id, kind, parent) of a block, folded inverters left out."""
    folded = fold_inverters(gates, edges).select(F.col("inverter").alias("id"))
    return gates.where(F.col("kind").isin(*GATES)).join(folded, "id", "left_anti").select(F.col("parent").alias("block"), F.col("id").alias("gate"))


def associative_roots(gates: DataFrame, links: DataFrame) -> DataFrame:
    """gates (id, op), links (child, parent): for every gate the topmost gate it reaches through parents of its own operator.

    Pointers jump twice as far each round, until none moves: chains of any length take a logarithmic number of joins. Gates on a ring of one operator, and
    those that lead into one, reach no topmost gate and stay their own root.
    """
    same = links.join(gates.select(F.col("id").alias("child"), F.col("op").alias("co")), "child").join(gates.select(F.col("id").alias("parent"), F.col("op").alias("po")), "parent")
    step = saved(gates.select("id").join(same.where("co = po").select(F.col("child").alias("id"), F.col("parent").alias("up")), "id", "left").select("id", F.coalesce("up", "id").alias("up")), "step")
    last = step.count().bit_length() + 1
    for k in range(last + 1):
        hop = step.select(F.col("id").alias("up"), F.col("up").alias("next"))
        step = saved(step.join(hop, "up").select("id", F.col("next").alias("up"), (F.col("next") != F.col("up")).alias("moved")), "step")
        if k == last or step.where("moved").isEmpty():
            break
        step = step.select("id", "up")
    return step.select("id", F.when(F.col("moved"), F.col("id")).otherwise(F.col("up")).alias("root"))


def pruned(nodes: DataFrame, dropped: DataFrame) -> DataFrame:
    """Nodes that aren't at or under a dropped path; every prefix of what nodes lie directly under is tried, once for all that lie there."""
    from netloom.operators.hierarchy import scope_frames

    frames = dropped.select(F.col("path").alias("frame")).distinct()
    above = F.when(F.contains("path", F.lit(".")), F.expr("left(path, length(path) - length(substring_index(path, '.', -1)) - 1)"))
    gone = scope_frames(nodes.select(above.alias("path")).where("path IS NOT NULL")).join(frames, "frame", "left_semi").select(F.col("path").alias("above")).distinct()
    kept = nodes.join(frames.withColumnRenamed("frame", "path"), "path", "left_anti")
    return kept.withColumn("above", above).join(gone, "above", "left_anti").select(*nodes.columns)


def unambiguous_select(edges: DataFrame) -> DataFrame:
    """(port, sel): the select that a port's edges agree on; a port whose edges differ, or have none, is left out."""
    return edges.where("sel IS NOT NULL").groupBy("port").agg(F.countDistinct("sel").alias("n"), F.min("sel").alias("sel")).where("n = 1").select("port", "sel")


def side_of(direction: Column) -> Column:
    """Outputs stand in the east."""
    return F.when(direction == "out", "east").otherwise("west")


def mirrored(side: Column) -> Column:
    """The side of a pin that faces the design: a scope's own boundary, or a modport's member."""
    return F.when(side == "east", "west").otherwise("east")
