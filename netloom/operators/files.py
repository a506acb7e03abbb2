"""Source files by name and position, provenance, and small text rules of the model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netloom.operators import spans

#: C and C++ extensions and their languages, scopes left out by default, seconds' powers of ten of time units.
LANGUAGES = {"c": "c", "h": "c", "cc": "cpp", "cpp": "cpp", "cxx": "cpp", "hpp": "cpp"}
EXCLUDED = ("TOP", "tb", "soc_pkg")


def by_name(files: DataFrame, names: DataFrame, order: str = "id") -> DataFrame:
    """(name, id): the first file (id, path) whose path is a name, ends in it after a slash, or has it as its last part.

    ``order``: the column that gives the files' order in the model. Every tail of a path is a key, so this is a join of equal keys.
    """
    parts = F.split("path", "/")
    tails = files.select("id", F.col(order).alias("place"), F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "/"))).alias("name"))
    return names.select("name").distinct().join(tails, "name").groupBy("name").agg(F.min_by("id", F.struct("place", "id")).alias("id"))


def offset_of(starts: DataFrame, places: DataFrame) -> DataFrame:
    """(file, line, column, offset): byte offsets of places (file, line and column from 1); places behind the last line are left out."""
    rows = starts.select("file", (F.col("line") + 1).alias("line"), "start")
    return places.join(rows, ["file", "line"]).select("file", "line", "column", (F.col("start") + F.col("column") - 1).alias("offset"))


def parse_offset(spec: Column) -> tuple[Column, Column]:
    """(file, offset) of FILE:OFFSET, split at the last colon; null if the offset is no number of up to 63 bits."""
    offset = F.regexp_extract(spec, r"^(?s:.*):([0-9]+)$", 1).try_cast("long")
    return F.when(offset.isNotNull(), F.regexp_extract(spec, r"^((?s:.*)):[0-9]+$", 1)), offset


def resolved_offsets(files: DataFrame, specs: DataFrame, order: str = "id") -> DataFrame:
    """(spec, file, offset) of specs FILE:OFFSET: FILE is a file's number, else a name as in :func:`by_name`; specs of neither kind, or without an offset, are left out."""
    name, offset = parse_offset(F.col("spec"))
    rows = specs.select("spec").distinct().select("spec", name.alias("name"), offset.alias("offset")).where("offset IS NOT NULL")
    number = F.when(F.col("name").rlike("^[0-9]+$"), F.col("name").try_cast("int")).cast("long")
    rows = rows.withColumn("number", number)
    named = by_name(files, rows.where("number IS NULL"), order).withColumnRenamed("id", "file")
    return rows.where("number IS NOT NULL").select("spec", F.col("number").alias("file"), "offset").unionByName(rows.where("number IS NULL").join(named, "name").select("spec", F.col("file").cast("long").alias("file"), "offset"))


def language_of(path: Column) -> Column:
    """A C source's language by its extension; C++ for others."""
    ext = F.lower(F.regexp_extract(path, r"\.([^./\\]*)$", 1))
    return F.coalesce(*[F.when(ext == k, v) for k, v in LANGUAGES.items()], F.lit("cpp"))


def module_of(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """(id, module): base name, without its extension, of the file that defines an instance or interface; nodes (id, kind, file)."""
    base = F.regexp_extract("path", r"([^/\\]*)$", 1)
    named = files.select(F.col("id").alias("file"), F.regexp_replace(base, r"^(.*)\.[^.]*$", "$1").alias("module"))
    return nodes.where("kind IN ('Instance', 'Interface')").join(named, "file").select("id", "module")


def excluded_lines(text: Column) -> Column:
    """Scope names of a file's text: what stands before # and // on its lines, white space cut off at both ends, without blank ones."""
    return F.filter(F.transform(F.split(text, r"\r?\n"), lambda x: F.regexp_replace(F.regexp_replace(x, r"(?s)(#|//).*$", ""), r"^\s+|\s+$", "")), lambda x: x != "")


def coerce_excluded(text: Column) -> Column:
    """Names split at blanks and commas, joined again by a comma; the default names where nothing is left."""
    names = F.filter(F.split(text, r"[\s,]+"), lambda x: x != "")
    return F.array_join(F.when(F.size(names) > 0, names).otherwise(F.array(*map(F.lit, EXCLUDED))), ",")


def const_bit(text: Column) -> Column:
    """A constant select bound without its size and base."""
    return F.regexp_replace(text, r"^[0-9]+'s?d", "")


def with_select(name: Column, select: Column) -> Column:
    return F.concat(name, F.coalesce(select, F.lit("")))


def provenance_ranges(texts: DataFrame, pattern: str = spans.PROVENANCE) -> DataFrame:
    """(file, lo, hi, source, source_line): byte ranges of generated lines whose comment names a source line; the first one of a line counts."""
    rows = spans.lines(texts)
    named = spans.provenance(rows, pattern)
    return rows.join(named, ["file", "line"]).select("file", F.col("start").alias("lo"), (F.col("start") + F.col("bytes")).alias("hi"), "source", "source_line")


def narrowest_first(ranges: DataFrame, probes: DataFrame) -> DataFrame:
    """(file, offset, id): the narrowest range over each probe, of equal ones the first."""
    return spans.narrowest(spans.stabbed(ranges, probes), ties=False).select("file", "offset", "id")


def references(refs: DataFrame) -> DataFrame:
    """Adds ``nth``: the order of references inside their file, by offset and then name."""
    return refs.withColumn("nth", F.row_number().over(Window.partitionBy("file").orderBy("offset", "rel")) - 1)


def token_columns(tokens: DataFrame) -> DataFrame:
    """(file, line, token, column): where tokens (file, line, token, text) of a line start, in characters."""
    before = Window.partitionBy("file", "line").orderBy("token").rowsBetween(Window.unboundedPreceding, -1)
    return tokens.select("file", "line", "token", F.coalesce(F.sum(F.length("text")).over(before), F.lit(0)).cast("long").alias("column"))
