"""The relational part of lowering: edges of logic blocks and memories from what their statements read and write.

Statements come as tables of paths: which block reads, assigns or is clocked by a path. A path means its preferred signal (a Net, else a
Var, else a Port, least id); paths of anything else draw no edge. Null paths and empty tables give nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PREFERRED = ("Net", "Var", "Port")


def signals(nodes: DataFrame) -> DataFrame:
    """(path, id): the node that an expression's path means."""
    rank = F.coalesce(*[F.when(F.col("kind") == k, i) for i, k in enumerate(PREFERRED)])
    return nodes.where(F.col("kind").isin(*PREFERRED)).groupBy("path").agg(F.min_by("id", F.struct(rank, "id")).alias("id"))


def logic_edges(nodes: DataFrame, reads: DataFrame, assigned: DataFrame, clocks: DataFrame, selects: DataFrame) -> DataFrame:
    """(block, endpoint, dir, sel): clocks and what a block reads but neither assigns nor is clocked by go in, what it assigns goes out.

    reads, assigned and clocks (block, path), selects (block, path, sel); a select counts where all uses in the block agree on it.
    """
    key = ["block", "path"]
    a, c = assigned.select(*key).distinct(), clocks.select(*key).distinct()
    data = reads.select(*key).distinct().join(a, key, "left_anti").join(c, key, "left_anti")
    rows = data.unionAll(c).withColumn("dir", F.lit("in")).unionAll(a.withColumn("dir", F.lit("out")))
    one = selects.groupBy(*key).agg(F.count_distinct("sel").alias("n"), F.min("sel").alias("sel")).where("n = 1").select(*key, "sel")
    rows = rows.join(signals(nodes), "path").where("id <> block").join(one, key, "left")
    return rows.select("block", F.col("id").alias("endpoint"), "dir", "sel").distinct()


def stated_constants(reads: DataFrame, assigned: DataFrame, statements: DataFrame) -> DataFrame:
    """(block, constant): blocks that state one literal: a single assignment (block, role, literal), by an assign or comb block that reads nothing else."""
    data = reads.select("block", "path").distinct().join(assigned.select("block", "path").distinct(), ["block", "path"], "left_anti").select("block").distinct()
    one = statements.where("role IN ('assign', 'comb')").groupBy("block").agg(F.count("*").alias("n"), F.min("literal").alias("constant")).where("n = 1 AND constant IS NOT NULL")
    return one.join(data, "block", "left_anti").select("block", "constant")


def memory_edges(nodes: DataFrame, accesses: DataFrame) -> DataFrame:
    """(memory, endpoint, dir, mem_port): accesses (memory, path, use): index paths are addresses, written values din, targets of reads dout."""
    port = F.when(F.col("use") == "index", "addr").when(F.col("use") == "value", "din").when(F.col("use") == "target", "dout")
    rows = accesses.select("memory", "path", port.alias("mem_port")).where("mem_port IS NOT NULL").join(signals(nodes), "path").where("id <> memory")
    return rows.select("memory", F.col("id").alias("endpoint"), F.when(F.col("mem_port") == "dout", "out").otherwise("in").alias("dir"), "mem_port").distinct()


def resolved_sources(refs: DataFrame, roots: list[dict], declared: DataFrame, existing: DataFrame) -> DataFrame:
    """(ref, dir, source): refs (ref, dir) to C sources: an absolute one that exists, else the first root (pos, root) under which it does,
    else the only declared source (source) of its base name, else the ref in the generated file's folder. existing (source) are known files."""
    base = F.regexp_extract("ref", r"([^/]*)$", 1)
    refs = refs.select("ref", "dir").distinct()
    absolute = F.startswith(F.col("ref"), F.lit("/"))
    have = existing.select("source").distinct()
    exact = refs.where(absolute).join(have, refs["ref"] == have["source"]).select("ref", "dir", F.lit(0).alias("rung"), F.lit(0).alias("pos"), "source")
    # the roots are the few that a run declares: an array of them on each ref's row
    listed = [F.struct(F.lit(r["pos"]).alias("pos"), F.lit(r["root"]).alias("root")) for r in roots]
    tried = F.explode(F.array(*listed)) if listed else F.explode(F.expr("CAST(array() AS ARRAY<STRUCT<pos: INT, root: STRING>>)"))
    under = refs.where(~absolute).select("ref", "dir", tried.alias("r")).select("ref", "dir", "r.pos", F.concat("r.root", F.lit("/"), "ref").alias("source"))
    under = under.join(have, "source", "left_semi").select("ref", "dir", F.lit(1).alias("rung"), "pos", "source")
    only = declared.select("source").distinct().groupBy(F.regexp_extract("source", r"([^/]*)$", 1).alias("base")).agg(F.count("*").alias("n"), F.min("source").alias("source")).where("n = 1")
    named = refs.withColumn("base", base).join(only, "base").select("ref", "dir", F.lit(2).alias("rung"), F.lit(0).alias("pos"), "source")
    last = refs.select("ref", "dir", F.lit(3).alias("rung"), F.lit(0).alias("pos"), F.when(absolute, F.col("ref")).otherwise(F.concat("dir", F.lit("/"), "ref")).alias("source"))
    rows = exact.unionAll(under).unionAll(named).unionAll(last)
    return rows.groupBy("ref", "dir").agg(F.min_by("source", F.struct("rung", "pos")).alias("source"))
