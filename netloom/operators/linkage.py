"""Trace names to design paths: normalisation, anchor detection, the match cascade and its report."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netloom.operators.lookup import SIGNALS, rank_of_kind
from netloom.operators.store import saved

ELEMENT, GENBLOCK = r"^\[[0-9]+\]$", r"^genblk[0-9]+$"
#: Beginnings of paths (two segments) that are broadcast, at most.
MOST_HEADS = 100_000


@dataclass(frozen=True)
class Options:
    top: str = "top"
    excluded: tuple[str, ...] = ("TOP", "tb", "soc_pkg")
    anchor: tuple[str, ...] | None = None
    samples: int = 100
    deepest: int = 6


def _rest(anchor: tuple[str, ...]) -> Column:
    """The segments of ``full_name`` after the anchor's."""
    segs, n = F.split("full_name", r"\."), len(anchor)
    return F.slice(segs, F.lit(n + 1), F.greatest(F.size(segs) - n, F.lit(0)))


def _trail(anchor: tuple[str, ...]) -> Column:
    """The distinct rules of a name inside the anchor, in the order in which they first apply along the path."""
    rule = lambda s: F.when(s.rlike(ELEMENT), "ArrayElement").when(s.rlike(GENBLOCK), "GenBlockFlatten").otherwise("")
    return F.filter(F.array_distinct(F.concat(F.array(F.lit("AnchorRebase")), F.transform(_rest(anchor), rule))), lambda r: r != "")


def classified(names: DataFrame, anchor: tuple[str, ...], opts: Options) -> DataFrame:
    """Adds ``class`` (in, excluded, out), ``target`` path and ``rules`` (the distinct rules used, in order)."""
    segs = F.split("full_name", r"\.")
    n = len(anchor)
    inside = (F.slice(segs, 1, n) == F.array(*map(F.lit, anchor))) if n else F.lit(True)
    inside = inside & (F.size(segs) > n)
    kept = F.filter(_rest(anchor), lambda s: ~s.rlike(ELEMENT) & ~s.rlike(GENBLOCK))
    barred = F.arrays_overlap(segs, F.array(*map(F.lit, opts.excluded))) if opts.excluded else F.lit(False)
    return names.select(
        "*",
        F.when(inside, "in").when(barred, "excluded").otherwise("out").alias("class"),
        F.when(inside, F.array_join(F.concat(F.array(F.lit(opts.top)), kept), ".")).alias("target"),
        F.when(inside, _trail(anchor)).otherwise(F.array().cast("array<string>")).alias("rules"),
    )


def _tries(names: DataFrame, opts: Options) -> DataFrame:
    """(var_ref, is_parameter, prefix, depth, path): every name cut at every depth; here any bracketed segment goes and genblk ones stay."""
    # bracketed segments as nulls, which a joined array leaves out; told once a name, not once a cut
    segs = names.select("var_ref", "is_parameter", F.split("full_name", r"\.").alias("segs"))
    segs = segs.withColumn("plain", F.transform("segs", lambda s: F.when(~(F.startswith(s, F.lit("[")) & F.endswith(s, F.lit("]"))), s)))
    cut = F.expr(f"explode(sequence(0, least(size(segs) - 1, {opts.deepest})))")
    tries = segs.select("var_ref", "is_parameter", "segs", "plain", cut.alias("depth"))
    rest = F.slice("plain", F.col("depth") + 1, F.size("plain"))
    return tries.select(
        "var_ref", "is_parameter", F.array_join(F.slice("segs", F.lit(1), F.col("depth")), ".").alias("prefix"), "depth", F.array_join(F.concat(F.array(F.lit(opts.top)), rest), ".").alias("path")
    )


def _scores(tries: DataFrame, nodes: DataFrame) -> DataFrame:
    """(prefix, depth, score): signals whose rebased name is a path.

    A cut of more than two segments is looked up only if some such path begins with its first two; those beginnings are broadcast if they are few.
    """
    head = F.substring_index("path", ".", 2)
    heads = saved(nodes.where(head != F.col("path")).select(head.alias("head")).distinct(), "heads")
    tries = tries.where("NOT is_parameter").select("prefix", "depth", "path")
    if heads.count() <= MOST_HEADS:
        known = F.broadcast(heads.withColumn("known", F.lit(True)))
        tries = tries.withColumn("head", head).join(known, "head", "left").where("known OR head = path").select("prefix", "depth", "path")
    return tries.join(nodes.select("path"), "path", "left_semi").groupBy("prefix", "depth").agg(F.count("*").alias("score"))


def _firsts(tries: DataFrame, prefixes: DataFrame) -> DataFrame:
    """(prefix, first): the least var_ref of all names, parameters too, that have one of ``prefixes`` (prefix)."""
    return tries.select("prefix", "var_ref").join(prefixes, "prefix", "left_semi").groupBy("prefix").agg(F.min("var_ref").alias("first"))


def anchor_scores(names: DataFrame, nodes: DataFrame, opts: Options) -> DataFrame:
    """(prefix, depth, score, first): signals whose rebased name is a path, and the first name in the trace that has the prefix."""
    tries = _tries(names, opts)
    scores = saved(_scores(tries, nodes), "scores")
    return scores.join(_firsts(tries, scores.select("prefix")), "prefix")


def detected_anchor(names: DataFrame, nodes: DataFrame, opts: Options) -> tuple[str, ...]:
    """Best score, then the longer prefix, then the one that the trace names first; none if nothing matches."""
    tries = _tries(names, opts)
    scores = saved(_scores(tries, nodes), "scores")
    two = scores.orderBy(F.desc("score"), F.desc("depth")).take(2)
    best = two[0] if two else None
    if len(two) == 2 and (two[1].score, two[1].depth) == (best.score, best.depth):
        tied = scores.where((F.col("score") == best.score) & (F.col("depth") == best.depth)).select("prefix")
        best = _firsts(tries, tied).orderBy("first", "prefix").first()
    return tuple(best.prefix.split(".")) if best and best.prefix else ()


def alias_variants(targets: DataFrame) -> DataFrame:
    """(target, path): the target with one interior segment left out, a row for each place."""
    segs = F.split("target", r"\.")
    places = F.expr("sequence(2, size(split(target, '\\\\.')) - 1)")
    return targets.where(F.size(segs) >= 3).select("target", F.explode(places).alias("k")).select(
        "target", F.array_join(F.concat(F.slice(segs, F.lit(1), F.col("k") - 1), F.slice(segs, F.col("k") + 1, F.size(segs))), ".").alias("path")
    )


def matched(names: DataFrame, nodes: DataFrame, opts: Options = Options()) -> DataFrame:
    """(var_ref, full_name, status, node, target, rules): direct, alias, parameter, unmatched, excluded or mystery.

    An alias counts only if exactly one place of omission gives a path; otherwise the name is refused.
    """
    # what a path means, worked out once for the anchor, for names and for their variants
    paths = saved(meanings(nodes), "paths")
    anchor = opts.anchor if opts.anchor is not None else detected_anchor(names, paths, opts)
    rows = classified(names, anchor, opts)
    # names elsewhere have no target; in a join they would all meet in the task of the null key
    away = rows.where("class <> 'in'").select("var_ref", "full_name", F.when(F.col("class") == "excluded", "excluded").otherwise("mystery").alias("status"), F.lit(None).cast("long").alias("node"), "target", "rules")
    inside = rows.where("class = 'in'").select("var_ref", "full_name", "is_parameter", "target")
    inside = saved(inside.join(paths.select(F.col("path").alias("target"), F.col("id").alias("direct"), F.col("params").alias("only_param")), "target", "left"), "names")
    # only names without a direct hit need their variants
    open_ = inside.where("direct IS NULL")
    alias = alias_variants(open_.select("target").distinct()).join(paths, "path").groupBy("target").agg(F.count("*").alias("ways"), F.max("id").alias("alias"), F.max("params").alias("alias_param")).where("ways = 1").drop("ways")
    parameter = F.col("is_parameter") | F.coalesce("only_param", F.lit(False)) | F.coalesce("alias_param", F.lit(False))
    status = F.when(F.col("alias").isNotNull(), "alias").when(parameter, "parameter").otherwise("unmatched")
    rules = F.when(F.col("alias").isNotNull(), F.concat(_trail(anchor), F.array(F.lit("InterfaceAlias")))).otherwise(_trail(anchor))
    rest = open_.join(alias, "target", "left").select("var_ref", "full_name", status.alias("status"), F.col("alias").alias("node"), "target", rules.alias("rules"))
    direct = inside.where("direct IS NOT NULL").select("var_ref", "full_name", F.lit("direct").alias("status"), F.col("direct").alias("node"), "target", _trail(anchor).alias("rules"))
    return direct.unionAll(rest).unionAll(away)


def meanings(nodes: DataFrame) -> DataFrame:
    """(path, id, params): the best signal of each path, null if it has none, and whether all of its nodes are parameters."""
    rank = F.when(F.col("kind").isin(*SIGNALS), F.struct(rank_of_kind(F.col("kind")).alias("rank"), "id"))
    return nodes.groupBy("path").agg(F.min(rank).alias("best"), F.every(F.col("kind") == "Param").alias("params")).select("path", F.col("best.id").alias("id"), "params")


def report(found: DataFrame) -> DataFrame:
    """One row: counts by status, denominator, hit rate (1 if there is nothing to match) and the gate's verdict."""
    count = lambda s: F.count_if(F.col("status") == s)
    hits, misses = count("direct") + count("alias"), count("unmatched")
    rate = F.when(hits + misses == 0, 1.0).otherwise(hits / (hits + misses))
    return found.agg(
        *[count(s).alias(s) for s in ("direct", "alias", "parameter", "unmatched", "excluded", "mystery")],
        (hits + misses).alias("denominator"), F.round(rate, 6).alias("hit_rate"), gate(rate, count("mystery")).alias("passes"),
    )


def gate(rate: Column, mystery: Column, threshold: float = 0.95) -> Column:
    return (rate >= threshold) & (mystery == 0)


def rule_counts(found: DataFrame) -> DataFrame:
    """How many matched names used each rule."""
    return found.where("node IS NOT NULL").select(F.explode("rules").alias("rule")).groupBy("rule").agg(F.count("*").alias("n"))


def wave_index(found: DataFrame) -> DataFrame:
    """(node, var_ref): a node's last direct name, else its last alias; order is that of var_ref."""
    rows = found.where("node IS NOT NULL")
    return rows.groupBy("node").agg(F.max_by("var_ref", F.struct(F.col("status") == "direct", "var_ref")).alias("var_ref"))


def samples(found: DataFrame, status: str, most: int) -> DataFrame:
    """(nth, full_name): the first ``most`` names of a status in the order of the trace."""
    first = found.where(F.col("status") == status).select("var_ref", "full_name").orderBy("var_ref").limit(most)
    return first.select((F.row_number().over(Window.orderBy("var_ref")) - 1).alias("nth"), "full_name")
