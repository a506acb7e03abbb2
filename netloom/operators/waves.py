"""Time series of value changes (sig, t, v): segments, values at times, edges, markers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from netloom.functions import bits

def _by_time() -> WindowSpec:
    return Window.partitionBy("sig").orderBy("t", "v")


def segments(changes: DataFrame, t_max: int | None = None) -> DataFrame:
    """(sig, t0, t1, v): a value holds until the next change, the last one until t_max or its own time."""
    end = F.greatest(F.col("t"), F.lit(t_max)) if t_max is not None else F.col("t")
    return changes.select("sig", F.col("t").alias("t0"), F.coalesce(F.lead("t").over(_by_time()), end).alias("t1"), "v")


def max_time(changes: DataFrame) -> DataFrame:
    """The greatest last sample, at least 1."""
    return changes.agg(F.greatest(F.lit(1), F.coalesce(F.max("t"), F.lit(1))).cast("long").alias("max_time"))


def value_at(changes: DataFrame, probes: DataFrame) -> DataFrame:
    """probes (sig, at): the last value at or before each time, empty before the first.

    Changes and probes are merged by time and the last value is carried forward: one shuffle by signal, no join.
    """
    both = changes.select("sig", "t", F.lit(0).alias("side"), "v").unionAll(probes.select("sig", F.col("at").alias("t"), F.lit(1).alias("side"), F.lit(None).cast("string")))
    last = F.last("v", ignorenulls=True).over(Window.partitionBy("sig").orderBy("t", "side", "v").rowsBetween(Window.unboundedPreceding, 0))
    return both.withColumn("last", last).where("side = 1").select("sig", F.col("t").alias("at"), F.coalesce("last", F.lit("")).alias("value"))


def nearest_edge(changes: DataFrame, probes: DataFrame) -> DataFrame:
    """(sig, at, edge): the change nearest in time, the earlier one in a tie; null for a signal without changes."""
    both = changes.select("sig", "t", F.lit(0).alias("side")).unionAll(probes.select("sig", F.col("at").alias("t"), F.lit(1).alias("side")))
    change = F.when(F.col("side") == 0, F.col("t"))
    before = F.last(change, ignorenulls=True).over(Window.partitionBy("sig").orderBy("t", "side").rowsBetween(Window.unboundedPreceding, 0))
    # backwards rather than over the rows that follow: Spark works such a frame out anew for every row
    after = F.last(change, ignorenulls=True).over(Window.partitionBy("sig").orderBy(F.desc("t"), F.desc("side")).rowsBetween(Window.unboundedPreceding, 0))
    both = both.withColumn("before", before).withColumn("after", after).where("side = 1")
    near = F.when(F.col("after").isNull() | (F.col("t") - F.col("before") <= F.col("after") - F.col("t")), F.col("before")).otherwise(F.col("after"))
    return both.select("sig", F.col("t").alias("at"), F.when(F.col("before").isNull(), F.col("after")).otherwise(near).alias("edge"))


def at_edges(changes: DataFrame, radix: str = "hex") -> DataFrame:
    """(sig, t, shown): what a marker on each change shows, ``previous -> current``, or one value if both look alike."""
    now = bits.format_value(F.col("v"), radix)
    rows = changes.select("sig", "t", "v", now.alias("now"))
    rows = rows.withColumn("was", F.lag("now").over(_by_time()))
    return rows.select("sig", "t", F.when(F.col("was").isNull() | (F.col("was") == F.col("now")), F.col("now")).otherwise(F.concat("was", F.lit(" -> "), "now")).alias("shown"))


def summary(changes: DataFrame) -> DataFrame:
    """Per signal: changes, first and last time, whether it is one bit wide, how often it is unknown."""
    return changes.groupBy("sig").agg(
        F.count("*").alias("n"), F.min("t").alias("first"), F.max("t").alias("last"),
        bits.is_digital(F.max(F.length("v"))).alias("digital"), F.count_if(~bits.is_known(F.col("v"))).alias("unknown"),
    )


def enum_decoded(changes: DataFrame, enums: DataFrame, width: int) -> DataFrame:
    """enums (member, value): the member of each value's low bits; unknown bits and unlisted values give null."""
    low = bits.slice_bits(F.col("v"), width - 1, 0)
    rows = changes.withColumn("code", F.when(bits.is_known(low), F.conv(low, 2, 10).cast("long")))
    return rows.join(F.broadcast(enums.select(F.col("value").alias("code"), "member")), "code", "left").select("sig", "t", "member")  # as many rows as enum members


def ticks(windows: DataFrame, target: int = 8) -> DataFrame:
    """windows (key, t0, t1): round times inside each window, at steps of 1, 2 or 5 times a power of ten."""
    step = bits.nice_step((F.col("t1") - F.col("t0")).cast("double"), target)
    rows = windows.where("t1 > t0").withColumn("step", F.greatest(step, F.lit(1.0)).cast("long"))
    first = F.ceil(F.col("t0") / F.col("step")).cast("long") * F.col("step")
    rows = rows.withColumn("first", first).where("first <= t1")
    return rows.select("key", "step", F.explode(F.expr("sequence(first, t1, step)")).alias("tick"))


def time_to_x(t: Column, start: Column, end: Column, width: float) -> Column:
    """Where a time lies in a window of ``width`` pixels; an empty window is one tick wide."""
    return (t - start) * F.lit(width) / F.greatest(end - start, F.lit(1))


def visible_lanes(groups: DataFrame, lanes: DataFrame) -> DataFrame:
    """(pane, lane, slot): lanes (pane, group, pos, lane) of groups (pane, group, collapsed) that aren't collapsed, numbered from 0 in order."""
    shown = lanes.join(groups.where("NOT collapsed").select("pane", "group"), ["pane", "group"], "left_semi")
    return shown.select("pane", "lane", (F.row_number().over(Window.partitionBy("pane").orderBy("group", "pos", "lane")) - 1).alias("slot"))


def working_group(groups: DataFrame, lanes: DataFrame) -> DataFrame:
    """(pane, group): where a new lane goes: the last group that has a lane, else the last group."""
    used = lanes.select("pane", "group").distinct().withColumn("used", F.lit(True))
    return groups.join(used, ["pane", "group"], "left").groupBy("pane").agg(F.coalesce(F.max(F.when(F.col("used"), F.col("group"))), F.max("group")).alias("group"))
