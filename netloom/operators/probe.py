"""Cross-probing between source positions, design nodes and trace signals, and what a probe answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netloom.operators import spans
from netloom.operators.lookup import best_kind
from netloom.operators.store import saved


def candidates(hits: DataFrame, nodes: DataFrame, key: tuple[str, ...], context: str | None = None) -> DataFrame:
    """hits (*key, id): per probe the anchor, and how many paths and nodes it covers.

    Hits are folded by path; a path is represented by its preferred node. The anchor is the first path at or under ``context`` if one
    is, else the first path, in byte order. ``others`` counts the paths besides it, ``nodes`` all nodes of the hit paths.
    """
    by_path = hits.join(nodes, "id").groupBy(*key, "path").agg(F.min_by("id", F.struct(best_kind(F.col("kind")), "id")).alias("rep"))
    sizes = nodes.groupBy("path").agg(F.count("*").alias("size"))
    by_path = by_path.join(sizes, "path")
    away = F.lit(False) if context is None else ~((F.col("path") == context) | F.col("path").startswith(context + "."))
    return by_path.groupBy(*key).agg(
        F.min_by("rep", F.struct(away, "path")).alias("anchor"), (F.count("*") - 1).alias("others"), F.sum("size").alias("nodes")
    )


def described(nodes: DataFrame) -> DataFrame:
    """(id, path, kind, size): nodes with the number of all nodes of their path; without those that have none."""
    return nodes.where("path IS NOT NULL").select("id", "path", "kind", F.count("*").over(Window.partitionBy("path")).alias("size"))


def _folded(hits: DataFrame, key: tuple[str, ...], carry: tuple[str, ...] = ()) -> DataFrame:
    """:func:`candidates` of hits (*key, id, path, kind, size) that are described already, with the anchor's kind and what is the same on all hits of a probe: one exchange, by the probe."""
    rep = F.min(F.struct(best_kind(F.col("kind")).alias("rank"), "id", "kind")).alias("rep")
    by_path = hits.repartition(*key).groupBy(*key, "path").agg(rep, F.max("size").alias("size"), *[F.max(c).alias(c) for c in carry])
    found = by_path.groupBy(*key).agg(F.min(F.struct("path", "rep")).alias("best"), (F.count("*") - 1).alias("others"), F.sum("size").alias("nodes"), *[F.max(c).alias(c) for c in carry])
    return found.select(*key, F.col("best.rep.id").alias("anchor"), F.col("best.rep.kind").alias("kind"), "others", "nodes", *carry)


def to_wave(anchors: DataFrame, nodes: DataFrame, index: DataFrame, key: str) -> DataFrame:
    """anchors (key, anchor): the trace variable of the anchor, else of the first linked node of its path; null if none is in the trace.

    Anchors that are linked themselves need no path; of the others' only the first linked node is looked up.
    """
    paths = nodes.where("path IS NOT NULL").select("id", "path")
    linked = index.where("var_ref IS NOT NULL").select(F.col("node").alias("id"), "var_ref")
    first = linked.join(paths, "id").groupBy("path").agg(F.min(F.struct("id", "var_ref")).alias("first"))
    at = anchors.withColumnRenamed("anchor", "id").join(paths, "id").join(linked, "id", "left")
    own = at.where("var_ref IS NOT NULL").select(key, "var_ref", F.struct(F.lit(False).alias("away"), "id").alias("at"))
    rest = at.where("var_ref IS NULL").select(key, "path").join(first, "path", "left").select(key, "first.var_ref", F.when(F.col("first").isNotNull(), F.struct(F.lit(True).alias("away"), "first.id")))
    return own.unionAll(rest).groupBy(key).agg(F.min_by("var_ref", "at").alias("var_ref"))


def references(refs: DataFrame, scopes: DataFrame, nodes: DataFrame, wanted: tuple[str, ...] = ("id",)) -> DataFrame:
    """refs (ref, rel) with scopes (ref, scope): nodes named by a reference, absolute (a leading slash) or inside each covering scope; ``wanted`` of their columns."""
    absolute = refs.where("startswith(rel, '/')").select("ref", F.expr("substring(rel, 2)").alias("path"))
    inside = refs.where("NOT startswith(rel, '/')").join(scopes, "ref").select("ref", F.concat("scope", F.lit("."), "rel").alias("path"))
    return absolute.unionAll(inside).distinct().join(nodes.select("path", *[c for c in wanted if c != "path"]), "path").select("ref", *wanted)


def from_node_path(probes: DataFrame, nodes: DataFrame) -> DataFrame:
    """probes (path): the preferred node of each path as anchor, and all nodes of the path; paths without a node are left out."""
    hits = probes.select(F.col("path").alias("probe")).distinct().join(nodes.select(F.col("path").alias("probe"), "id"), "probe")
    return candidates(hits, nodes, ("probe",)).select("probe", "anchor", "nodes")


def to_source(anchors: DataFrame, nodes: DataFrame, ranges: DataFrame) -> DataFrame:
    """anchors (probe, anchor): (probe, path, file, def, inst): where the source view goes for an anchor.

    ranges (id, role, file, lo, hi), of the roles def and inst, one each (the least counts). ``file`` is that of the definition, else of the instance; a node without
    ranges keeps its path alone, and an anchor that is no node an empty one.
    """
    span = lambda role: F.min(F.when(F.col("role") == role, F.struct("file", "lo", "hi"))).alias(role)
    places = ranges.where("role IN ('def', 'inst')").groupBy(F.col("id").alias("anchor")).agg(span("def"), span("inst"))
    rows = anchors.select("probe", "anchor").join(nodes.select(F.col("id").alias("anchor"), "path"), "anchor", "left").join(places, "anchor", "left")
    return rows.select("probe", F.coalesce("path", F.lit("")).alias("path"), F.coalesce("def.file", "inst.file").alias("file"), "def", "inst")


def responses(anchors: DataFrame, nodes: DataFrame, ranges: DataFrame, index: DataFrame, names: DataFrame) -> DataFrame:
    """What a probe answers: (probe, anchor, kind, path, file, lo, hi, var_ref, full_name) of anchors (probe, anchor).

    The place is the definition, else the instance, the link the trace variable as in :func:`to_wave` with its name, names (var_ref, full_name); both null if there is none.
    """
    at = anchors.select("probe", "anchor").join(nodes.select(F.col("id").alias("anchor"), "kind"), "anchor", "left")
    place = to_source(anchors, nodes, ranges).select("probe", "path", "file", F.coalesce("def", "inst").alias("span"))
    link = to_wave(anchors, nodes, index, "probe").join(names.select("var_ref", "full_name"), "var_ref", "left")
    return at.join(place, "probe").join(link, "probe", "left").select("probe", "anchor", "kind", "path", "file", "span.lo", "span.hi", "var_ref", "full_name")


def from_source(probes: DataFrame, nodes: DataFrame, ranges: DataFrame, maps: DataFrame, refs: DataFrame) -> DataFrame:
    """(file, offset, via, anchor, others, nodes): what a source position (file, offset) means; positions that mean nothing are left out.

    Where provenance maps (file, lo, hi, gen_file, gen_lo, gen_hi) cover it, the narrowest one's generated range takes its place, without a
    further fallback. Else the narrowest nodes over it, ranges (file, id, lo, hi, body), if their anchor is a declared signal; else what
    the narrowest reference (file, offset, len, rel) over it names in each instance whose body covers it; else those nodes after all.
    """
    probes = saved(probes.select("file", "offset").distinct(), "probes")
    entries = maps.select("file", "lo", "hi", F.struct("gen_lo", "gen_hi", "gen_file").alias("id"))
    mapped = spans.narrowest(spans.stabbed(entries, probes), ties=False).select("file", "offset", "id.gen_file", "id.gen_lo", "id.gen_hi")
    at = probes.join(mapped, ["file", "offset"], "left")
    at = saved(at.select("file", "offset", F.col("gen_file").isNotNull().alias("mapped"), F.coalesce("gen_file", "file").alias("f"), F.coalesce("gen_lo", "offset").alias("lo"), F.coalesce("gen_hi", F.col("offset") + 1).alias("hi")), "places")
    key = ("file", "offset")
    nodes = saved(described(nodes), "nodes")
    inner = spans.innermost(ranges, at.select(F.col("f").alias("file"), "lo", "hi")).withColumnRenamed("file", "f")
    hits = at.join(inner, ["f", "lo", "hi"]).select(*key, "mapped", "id")
    by_span = saved(_folded(hits.join(nodes, "id"), key, ("mapped",)), "span")
    settled = F.col("mapped") | F.col("kind").isin("Var", "Net", "Port")
    # references count where neither a map nor a declaration has settled the position
    open_ = saved(at.where("NOT mapped").select(*key).join(by_span.where(settled).select(*key), list(key), "left_anti"), "open")
    words = refs.select("file", F.col("rel").alias("id"), F.col("offset").alias("lo"), (F.col("offset") + F.col("len")).alias("hi"))
    named = spans.narrowest(spans.stabbed(words, open_), ties=False).select(F.struct(*key).alias("ref"), F.col("id").alias("rel"))
    named = saved(named, "named")
    # only where something is named do the bodies around it count
    asked = named.where("NOT startswith(rel, '/')").select("ref.*")
    bodies = ranges.where("body").join(nodes.where("kind IN ('Instance', 'Interface')").select("id", F.col("path").alias("scope")), "id").select("file", F.col("scope").alias("id"), "lo", "hi")
    scopes = spans.stabbed(bodies, asked).select(F.struct(*key).alias("ref"), F.col("id").alias("scope")).distinct()
    hits = references(named, scopes, nodes, ("id", "kind", "size", "path")).select("ref.*", "id", "kind", "size", "path").distinct()
    by_name = saved(_folded(hits, key), "name")
    rest = by_span.join(by_name.select(*key), list(key), "left_anti")
    rest = rest.select(*key, F.when(F.col("mapped"), "map").otherwise("span").alias("via"), "anchor", "others", "nodes")
    return rest.unionAll(by_name.select(*key, F.lit("name").alias("via"), "anchor", "others", "nodes"))
