"""Contiguous shards of near-equal bytes (operator 8), DataFrame functions only.

Rows are range-partitioned by id; per-partition totals give every partition its offset in the
global byte order, a running sum inside the partition gives every row its own, and the byte
axis is cut at equal targets. A text never leaves its first stage: only its size and checksum do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netloom.llm.common import saved

#: Range partitions: rows of each, and how many at most (their totals meet in one task).
PART_ROWS, MOST_PARTS = 20_000, 8192


def byte_shards(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every row.

    Size is the UTF-8 bytes of the text plus 8. A row goes to the shard in which its middle byte falls when
    all rows, in id order, are laid end to end and cut at ``shards`` equal targets; so a shard's bytes differ from the
    target by less than the largest row. Null texts count as empty (checksum 0), null ids come first; rows that repeat an
    id stand side by side in order of size and checksum, and are alike if those are equal too. An empty table gives no row. ``slot`` counts
    from 0 in every shard that has rows; ``grown_shard`` is null, since under this law a further shard moves rows.
    Other columns are ignored.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    rows = saved(rows, "sizes")
    parts = min(MOST_PARTS, max(1, rows.count() // PART_ROWS))
    key = ["doc_id", "size", "text_crc32", "tie"]
    ranged = rows.withColumn("tie", F.rand(8)).repartitionByRange(parts, *key).withColumn("part", F.spark_partition_id())
    ranged = saved(ranged, "ranged")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("part").agg(F.sum("size").alias("b"), F.count("*").alias("n"))
    totals = totals.select(
        "part",
        F.coalesce(F.sum("b").over(before), F.lit(0)).alias("byte0"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("row0"),
        F.sum("b").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("total"),
    )
    inside = Window.partitionBy("part").orderBy(*key)
    placed = (
        ranged.join(F.broadcast(totals), "part")  # one row for each of at most MOST_PARTS partitions
        .withColumn("end", F.col("byte0") + F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("row", F.col("row0") + F.row_number().over(inside) - 1)
        .withColumn("shard", F.expr(f"CAST(least({shards - 1}, ((2 * end - size) * {shards}) div (2 * total)) AS INT)"))
    )
    first = placed.groupBy("shard").agg(F.min("row").alias("row1"))
    return placed.join(F.broadcast(first), "shard").select(  # one row a shard
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("row") - F.col("row1")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
