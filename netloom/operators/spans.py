"""Text positions and source ranges: line offsets, interval stabbing on a grid, narrowest range, provenance comments."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def lines(texts: DataFrame) -> DataFrame:
    """(file, line, start, bytes, text) of (file, text): byte offsets of lines, line feeds counted, per file."""
    rows = texts.where("text IS NOT NULL").select("file", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    size = F.octet_length("text")
    before = Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    return rows.select("file", "line", F.coalesce(F.sum(size + 1).over(before), F.lit(0)).cast("long").alias("start"), size.cast("long").alias("bytes"), "text")


def line_at(starts: DataFrame, probes: DataFrame) -> DataFrame:
    """(file, offset, line): the last line that starts at or before an offset, the first line for offsets before it."""
    both = starts.select("file", F.col("start").alias("at"), F.lit(0).alias("side"), "line").unionAll(probes.select("file", F.col("offset").alias("at"), F.lit(1).alias("side"), F.lit(None).cast("int")))
    last = F.last("line", ignorenulls=True).over(Window.partitionBy("file").orderBy("at", "side").rowsBetween(Window.unboundedPreceding, 0))
    return both.withColumn("last", last).where("side = 1").select("file", F.col("at").alias("offset"), F.coalesce("last", F.lit(0)).alias("line"))


def line_range(starts: DataFrame, spans: DataFrame) -> DataFrame:
    """(file, lo, hi, first, last): inclusive lines of half-open byte spans; a point stays on one line."""
    ends = spans.select("file", F.col("lo").alias("offset")).unionAll(spans.select("file", F.greatest(F.col("lo"), F.col("hi") - 1).alias("offset"))).distinct()
    at = line_at(starts, ends)
    a = at.select("file", F.col("offset").alias("lo"), F.col("line").alias("first"))
    b = at.select("file", F.col("offset").alias("end"), F.col("line").alias("last"))
    return spans.withColumn("end", F.greatest(F.col("lo"), F.col("hi") - 1)).join(a, ["file", "lo"]).join(b, ["file", "end"]).select("file", "lo", "hi", "first", F.greatest("first", "last").alias("last"))


def stabbed(ranges: DataFrame, probes: DataFrame, cell: int = 4096) -> DataFrame:
    """(file, offset, id, width): every range (file, id, lo, hi) over a probe (file, offset).

    Ranges are dealt over grid cells of ``cell`` bytes, so the join has equal keys and a residual test; a probe is in one cell, so
    nothing is found twice. An empty range covers the byte it starts at and has the greatest width, so anything else is narrower.
    """
    end = F.greatest(F.col("hi"), F.col("lo") + 1)
    cells = ranges.select("file", "id", "lo", "hi", end.alias("end"), F.explode(F.sequence(F.floor(F.col("lo") / cell), F.floor((end - 1) / cell))).alias("cell"))
    at = probes.withColumn("cell", F.floor(F.col("offset") / cell))
    return at.join(cells, ["file", "cell"]).where("lo <= offset AND offset < end").select("file", "offset", "id", F.when(F.col("hi") > F.col("lo"), F.col("hi") - F.col("lo")).otherwise(F.lit((1 << 63) - 1)).alias("width"))


def overlapping(ranges: DataFrame, probes: DataFrame, cell: int = 4096) -> DataFrame:
    """(file, lo, hi, id, width): every node (id) with a range (file, id, lo, hi) that meets a probe (file, lo, hi), and the least width of those.

    Both sides are dealt over grid cells; an empty range is one byte that comes last, as in ``stabbed``.
    """
    end = F.greatest(F.col("hi"), F.col("lo") + 1)
    dealt = F.explode(F.sequence(F.floor(F.col("lo") / cell), F.floor((end - 1) / cell)))
    wide = F.when(F.col("hi") > F.col("lo"), F.col("hi") - F.col("lo")).otherwise(F.lit((1 << 63) - 1))
    a = ranges.select("file", "id", F.col("lo").alias("a"), end.alias("b"), wide.alias("width"), dealt.alias("cell"))
    p = probes.select("file", "lo", "hi").distinct().select("file", "lo", "hi", dealt.alias("cell"))
    return p.join(a, ["file", "cell"]).where("a < greatest(hi, lo + 1) AND lo < b").groupBy("file", "lo", "hi", "id").agg(F.min("width").alias("width"))


def innermost(ranges: DataFrame, probes: DataFrame, cell: int = 4096) -> DataFrame:
    """(file, lo, hi, id): of the nodes that :func:`overlapping` finds those of least width. Wider ones go before anything leaves its grid cell."""
    end = F.greatest(F.col("hi"), F.col("lo") + 1)
    dealt = F.explode(F.sequence(F.floor(F.col("lo") / cell), F.floor((end - 1) / cell)))
    wide = F.when(F.col("hi") > F.col("lo"), F.col("hi") - F.col("lo")).otherwise(F.lit((1 << 63) - 1))
    a = ranges.select("file", "id", F.col("lo").alias("a"), end.alias("b"), wide.alias("width"), dealt.alias("cell"))
    p = probes.select("file", "lo", "hi").distinct().select("file", "lo", "hi", dealt.alias("cell"))
    rows = p.join(a, ["file", "cell"]).where("a < greatest(hi, lo + 1) AND lo < b").select("file", "cell", "lo", "hi", "id", "width")
    for place in (("file", "cell", "lo", "hi"), ("file", "lo", "hi")):
        rows = rows.withColumn("least", F.min("width").over(Window.partitionBy(*place))).where("width = least").drop("least")
    return rows.select("file", "lo", "hi", "id").distinct()


def narrowest(hits: DataFrame, ties: bool = True) -> DataFrame:
    """The narrowest range over each probe: all of equal width, or with ``ties`` off the one of least id."""
    if ties:
        least = hits.groupBy("file", "offset").agg(F.min("width").alias("width"))
        return hits.join(least, ["file", "offset", "width"]).select("file", "offset", "id", "width")
    return hits.groupBy("file", "offset").agg(F.min(F.struct("width", "id")).alias("best")).select("file", "offset", "best.id", "best.width")


def identifiers(rows: DataFrame) -> DataFrame:
    """(file, line, word, n): identifier-like words of lines (file, line, text) and how often they occur."""
    words = F.regexp_extract_all("text", F.lit(r"([A-Za-z_][A-Za-z0-9_]*)"), F.lit(1))
    return rows.select("file", "line", F.explode(words).alias("word")).groupBy("file", "line", "word").agg(F.count("*").alias("n"))


#: Fixed value: a C or C++ file and a line somewhere after two slashes. A tool of another form has a pattern of its own, with the same two groups.
PROVENANCE = r"//.*?([\w./\\-]+\.(?:c|cc|cpp|cxx|h|hpp)):(\d+)"


def provenance(rows: DataFrame, pattern: str = PROVENANCE) -> DataFrame:
    """(file, line, source, source_line): comments that name a source line in lines (file, line, text), the first of each; a line number beyond 63 bits is null."""
    found = rows.where(F.col("text").rlike(pattern))
    return found.select("file", "line", F.regexp_extract("text", pattern, 1).alias("source"), F.regexp_extract("text", pattern, 2).try_cast("long").alias("source_line"))


def best_references(refs: DataFrame) -> DataFrame:
    """refs (file, offset, rel, class_rank): one a place, the shortest rel, then the least class."""
    order = Window.partitionBy("file", "offset").orderBy(F.length("rel"), "class_rank", "rel")
    return refs.withColumn("r", F.row_number().over(order)).where("r = 1").drop("r")
