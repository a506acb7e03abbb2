"""Integrity rules, lint, and the relational part of lowering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netloom.functions import bits

SIGNALS = ("Port", "Net", "Var")
#: Rows that a task groups by name, on average.
TASK_ROWS = 100_000


def violations(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(rule, id): parents and edge ends that no node has, and ids that repeat."""
    ids = nodes.select("id")
    parent = nodes.where("parent IS NOT NULL").join(ids.withColumnRenamed("id", "parent"), "parent", "left_anti").select(F.lit("parent").alias("rule"), "id")
    port = edges.join(ids.withColumnRenamed("id", "port"), "port", "left_anti").select(F.lit("port"), "port")
    endpoint = edges.join(ids.withColumnRenamed("id", "endpoint"), "endpoint", "left_anti").select(F.lit("endpoint"), "endpoint")
    twice = nodes.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("id"), "id")
    return parent.unionAll(port).unionAll(endpoint).unionAll(twice)


def name_collisions(nodes: DataFrame) -> DataFrame:
    """(parent, name, n): a scope's name given to several nodes, unless they are signals of one path."""
    rows = nodes.where("name <> '' AND parent IS NOT NULL").select("parent", "name", "path", F.col("kind").isin(*SIGNALS).alias("signal"))
    # dealt once, to as many tasks as the rows need, so that the table of a task that tells paths apart stays small however many rows there are
    rows = rows.repartition(rows.count() // TASK_ROWS + 1, "parent", "name")
    named = rows.groupBy("parent", "name").agg(F.count("*").alias("n"), F.countDistinct("path").alias("paths"), F.every("signal").alias("signals"))
    return named.where("n > 1 AND NOT (paths = 1 AND signals)").select("parent", "name", "n")


def multi_driver(writes: DataFrame) -> DataFrame:
    """writes (symbol, process, kind): symbols that a clocked process and any other process write."""
    found = writes.distinct().groupBy("symbol").agg(F.countDistinct("process").alias("writers"), F.array_sort(F.collect_set("kind")).alias("kinds"))
    return found.where(F.array_contains("kinds", "ff") & (F.col("writers") > 1)).select("symbol", "writers", F.array_join("kinds", ",").alias("kinds"))


def logic_role(keyword: Column, clocked: Column) -> Column:
    """ff, latch, comb or assign; a plain always block is judged by its sensitivity."""
    return (
        F.when(keyword == "always_ff", "ff").when(keyword == "always_latch", "latch").when(keyword == "always_comb", "comb")
        .when(keyword == "assign", "assign").when((keyword == "always") & clocked, "ff").when(keyword == "always", "comb")
    )


def parse_int(literal: Column) -> Column:
    """Value of a sized or plain integer literal of any width, as decimal digits, underscores left out; null if a digit is unknown."""
    return bits.once(F.lower(F.regexp_replace(literal, "_", "")), _parsed)


def _parsed(clean: Column) -> Column:
    short = lambda number: F.regexp_replace(number, "^0+(?=.)", "")
    number = lambda letter, digits: F.regexp_extract(clean, rf"^[0-9]*'s?{letter}([{digits}]+)$", 1)
    # each digit of a power-of-two base as its bits
    spelt = lambda text, base, size: F.array_join(F.transform(F.split(text, ""), lambda d: F.lpad(F.conv(d, base, 2), size, "0")), "")
    plain, dec, hex_, bin_, oct_ = F.regexp_extract(clean, "^([0-9]+)$", 1), number("d", "0-9"), number("h", "0-9a-f"), number("b", "01"), number("o", "0-7")
    return (
        F.when(plain != "", short(plain)).when(dec != "", short(dec)).when(hex_ != "", bits.decimal(spelt(hex_, 16, 4)))
        .when(bin_ != "", bits.decimal(bin_)).when(oct_ != "", bits.decimal(spelt(oct_, 8, 3)))
    )


def enum_values(members: DataFrame) -> DataFrame:
    """members (type, pos, name, literal): values as decimal digits, a missing literal being one more than the member before; an
    unreadable literal drops its whole type."""
    given = F.when(F.col("literal").isNotNull(), parse_int(F.col("literal")))
    rows = members.withColumn("given", given).withColumn("bad", F.col("literal").isNotNull() & F.col("given").isNull())
    by = Window.partitionBy("type").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("base", F.last(F.when(F.col("given").isNotNull(), F.struct("given", "pos")), ignorenulls=True).over(by))
    rows = rows.withColumn("drop", F.max("bad").over(Window.partitionBy("type")))
    value = F.coalesce(bits.plus(F.col("base.given"), F.col("pos") - F.col("base.pos")), F.col("pos").cast("string"))
    return rows.where("NOT drop").select("type", "name", value.alias("value"))


def mux_chain(branches: DataFrame) -> DataFrame:
    """branches (target, priority, condition, value): a chain of two-way multiplexers, each falling through to the next; the
    last falls through to the target itself."""
    after = Window.partitionBy("target").orderBy("priority")
    return branches.select("target", "priority", "condition", F.col("value").alias("d1"), F.coalesce(F.lead(F.concat(F.lit("mux"), F.col("priority").cast("string"))).over(after), F.col("target").cast("string")).alias("d0"))


def percentiles(values: DataFrame, key: str, value: str) -> DataFrame:
    """Per key: mean, nearest-rank p50 and p95 (rank round((n - 1) p)), and max."""
    order = Window.partitionBy(key).orderBy(value)
    rows = values.where(F.col(value).isNotNull()).withColumn("r", F.row_number().over(order) - 1).withColumn("n", F.count("*").over(Window.partitionBy(key)))
    at = lambda p: F.max(F.when(F.col("r") == F.floor((F.col("n") - 1) * p + 0.5), F.col(value)))
    return rows.groupBy(key).agg(F.round(F.avg(value), 6).alias("mean"), at(0.5).alias("p50"), at(0.95).alias("p95"), F.max(value).alias("max"))


def stamp(seconds: Column) -> Column:
    """Seconds since 1970 as date and time in UTC, whatever the session's zone; years after 9999 without a sign."""
    since = F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'")
    # in days, since seconds have to fit a decimal of twelve digits
    at = since + F.make_dt_interval(F.floor(seconds / 86400).cast("int"), secs=F.pmod(seconds, F.lit(86400)))
    return F.ltrim(F.date_format(at, "yyyy-MM-dd HH:mm:ss"), F.lit("+"))
