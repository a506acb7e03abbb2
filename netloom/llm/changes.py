"""Sequenced change applier (operator 12): numbered changes of clients, applied in order by two chained stateful stages.

Batches of changes are written to the shared folder and fed in order to a Structured Streaming query that is started anew for each of them on
one checkpoint, as a job by the clock would be.

1. Key (client, n): the first arrival of a number goes on, repeats are rejected. Many keys a client, so that a hot client is spread.
2. Key client: unique rows are held until their number is next. A row whose number was passed is rejected. Where a client waits for a number longer
   than ``patience`` days of all clients' time, its earliest held number becomes next. A timer a waiting client wakes it in every batch, also in one
   that has no row of it. Rejected repeats pass beside in ``LANES`` lanes of all clients, so that they don't meet in a hot client's task.

A task holds ``CHUNK`` rows of a client and 8 bytes for each number that a jump passes; what waits is in the state store, on disk: up to ``FEW`` rows
beside the client's own state, which is read in any case, and the others in a map by number.
A restarted task reads its batch again from the files and its state from the checkpoint, so the rows come out the same.
"""

from __future__ import annotations

import uuid
from array import array
from collections.abc import Iterator
from itertools import chain

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType
from pyspark.sql.window import Window

from netloom.llm.common import saved, shared_dir

#: Groups to which rejected repeats are dealt.
LANES = 1024
#: Rows of a client that a task sorts at a time.
CHUNK = 10_000
#: Waiting rows of a client that its own state holds.
FEW = 50
#: Stores on disk, whose memory is bounded a process and whose commits write what changed. A start reads its stores once, so a task closes its own
#: at its end, and no room is taken in advance.
STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


class FirstArrivals(StatefulProcessor):
    """Of the rows of a key, the first by (day, change_id) of the first batch goes to lane 0, the others to further lanes."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "seen boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:  # noqa: N802
        known, best = self.seen.exists(), None
        for row in rows:
            if not known and (best is None or _place(row) < _place(best)):
                row, best = best, row
            if row is not None:
                yield _dealt(row, 1 + (row.change_id or 0) % LANES)
        if best is not None:
            self.seen.update((True,))
            yield _dealt(best, 0)

    def close(self) -> None:
        pass


def _place(row: Row) -> tuple:
    return tuple((x is not None, x) for x in (row.day, row.change_id, *(row[k] for k in range(4, len(row)))))


def _dealt(row: Row, lane: int) -> Row:
    return Row(*row.__fields__, "lane", "owner")(*row, lane, None if lane else row.client_id)


class Sequence(StatefulProcessor):
    """Applies a client's unique rows in the order of their numbers.

    ``batch``: the number of this start. ``latest``: the largest day of earlier batches, None before there is one. ``last``: whether all that waits is
    applied now.
    """

    def __init__(self, values: StructType, batch: int, latest: int | None, patience: int, last: bool) -> None:
        self.values, self.batch, self.latest, self.patience, self.last = values, batch, latest, patience, last

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.made = Row("client_id", "n", "day", "change_id", "op", *self.values.names, "status", "batch", "missed")
        number = StructField("n", LongType())
        held = StructType([StructField("change_id", LongType()), StructField("day", IntegerType()), StructField("op", StringType()), *self.values])
        few = StructField("few", ArrayType(StructType([number, *held])))
        own = [StructField("next", LongType()), StructField("batch", IntegerType()), StructField("more", LongType()), StructField("earliest", IntegerType())]
        self.client = handle.getValueState("client", StructType([*own, few, *self.values]))
        self.held = handle.getMapState("held", StructType([number]), held)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:  # noqa: N802
        if key[1]:
            for row in rows:
                yield self._rejected(row)
            return
        self._load()
        yield from self._start(key[0])
        chunk: list[Row] = []
        for row in rows:
            if row.n < self.next:
                yield self._rejected(row)
                continue
            chunk.append(row)
            if len(chunk) == CHUNK:
                yield from self._taken(key[0], chunk)
                chunk = []
        yield from self._taken(key[0], chunk)
        self._store(timerValues)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[Row]:  # noqa: N802
        self._load()
        if self.done < self.batch:
            yield from self._start(key[0])
            self._store(timerValues)

    def close(self) -> None:
        pass

    def _load(self) -> None:
        found = self.client.get() or (1, 0, 0, None, [], *[None] * len(self.values))
        self.next, self.done, self.more, self.earliest = found[:4]
        self.few = {x[0]: tuple(x[1:]) for x in found[4]}
        self.now = list(found[5:])

    def _store(self, timers: object) -> None:
        self.client.update((self.next, self.batch, self.more, self.earliest, [(n, *x) for n, x in self.few.items()], *self.now))
        if self.few or self.more:
            self.handle.registerTimer(timers.getCurrentProcessingTimeInMs() + 1)

    def _start(self, client: object) -> Iterator[Row]:
        """The jumps at the start of a batch: up to the largest number that has waited too long, all that is held is applied."""
        if not (self.few or self.more) or not (self.last or (self.latest is not None and self.earliest + self.patience <= self.latest)):
            return
        late, numbers, rest = None, array("q"), None
        for n, value in chain(self.few.items(), ((k[0], v) for k, v in self.held.iterator()) if self.more else ()):
            numbers.append(n)
            if self.last or value[1] + self.patience <= self.latest:
                late = n if late is None else max(late, n)
            else:
                rest = value[1] if rest is None else min(rest, value[1])
        self.earliest = rest
        if late is None:
            return
        for n in sorted(x for x in numbers if x <= late):
            yield self._applied(client, n, *self._taken_out(n))
        yield from self._drained(client)

    def _taken(self, client: object, chunk: list[Row]) -> Iterator[Row]:
        """Applies what is next of ``chunk`` and of what is held; the rest of the chunk is held."""
        for row in sorted(chunk, key=lambda r: r.n):
            if row.n > self.next:
                yield from self._drained(client)
            value = (row.change_id, row.day, row.op, *row[5 : 5 + len(self.values)])
            if row.n == self.next:
                yield self._applied(client, row.n, *value)
                continue
            if len(self.few) < FEW:
                self.few[row.n] = value
            else:
                self.held.updateValue((row.n,), value)
                self.more += 1
            self.earliest = row.day if self.earliest is None else min(self.earliest, row.day)
        yield from self._drained(client)

    def _drained(self, client: object) -> Iterator[Row]:
        while self.next in self.few or (self.more and self.held.containsKey((self.next,))):
            yield self._applied(client, self.next, *self._taken_out(self.next))

    def _taken_out(self, n: int) -> tuple:
        if n in self.few:
            return self.few.pop(n)
        value = self.held.getValue((n,))
        self.held.removeKey((n,))
        self.more -= 1
        return tuple(value)

    def _applied(self, client: object, n: int, change: int, day: int, op: str, *new: object) -> Row:
        missed, self.next = n - self.next, n + 1
        if op == "D":
            self.now = [None] * len(new)
        elif op == "I":
            self.now = list(new)
        elif op == "U":
            self.now = [old if x is None else x for old, x in zip(self.now, new)]
        return self.made(client, n, day, change, op, *self.now, "applied", self.batch, missed)

    def _rejected(self, row: Row) -> Row:
        return self.made(row.client_id, row.n, row.day, row.change_id, row.op, *[None] * len(self.values), "rejected", self.batch, 0)


def numbered(rows: DataFrame, client: str = "client_id", seq: str = "seq", name: str = "n") -> DataFrame:
    """``rows`` with the dense rank of ``seq`` among the client's values, a null being the least and a null client a client.

    Distinct pairs are sorted in ranges, so a hot client is spread; what a range has to add is the number of the client's pairs in earlier ranges. Only a
    client that lies in several ranges has such a row, so there are fewer than two a range.
    """
    pairs = rows.select(F.col(client).alias("__client"), F.col(seq).alias("__seq")).distinct()
    pairs = saved(pairs.repartitionByRange("__client", "__seq").withColumn("__range", F.spark_partition_id()), "pairs")
    ends = pairs.groupBy("__range").agg(F.min(F.struct("__client")).alias("low"), F.max(F.struct("__client")).alias("high"))
    edges = ends.select(F.col("__range"), F.explode(F.array_distinct(F.array("low.__client", "high.__client"))).alias("__client"))
    same = F.col("p.__client").eqNullSafe(F.col("e.__client")) & (F.col("p.__range") == F.col("e.__range"))
    sizes = pairs.alias("p").join(F.broadcast(edges).alias("e"), same).groupBy(F.col("p.__range").alias("__range"), F.col("p.__client").alias("__client")).agg(F.count("*").alias("__size"))
    before = F.sum("__size").over(Window.partitionBy("__client").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    carried = sizes.select(F.col("__range").alias("__at"), F.col("__client").alias("__who"), before.alias("__before")).where("__before IS NOT NULL")
    own = F.row_number().over(Window.partitionBy("__range", "__client").orderBy(F.col("__seq").asc_nulls_first()))
    ranked = pairs.withColumn("__own", own).join(F.broadcast(carried), F.expr("__range = __at AND __client <=> __who"), "left")
    ranked = ranked.select("__client", "__seq", (F.col("__own") + F.coalesce("__before", F.lit(0))).cast("long").alias(name))
    return rows.join(ranked, F.col(client).eqNullSafe(F.col("__client")) & F.col(seq).eqNullSafe(F.col("__seq"))).drop("__client", "__seq")


def applied(changes: DataFrame, batches: int, values: tuple[str, ...], patience: int = 5) -> DataFrame:
    """(client_id, n, day, change_id, op, status, batch, missed, and the values afterwards) for every row of ``changes``.

    ``changes`` (client_id, n long from 1, day int, change_id, op, batch int from 1, and the columns ``values``): rows of a batch arrive in the order of day
    and change_id (then of op and values). ``op``: I sets all values, U those that aren't null, D makes them null, anything else changes nothing.
    At the start of a batch, while a client's earliest held day + ``patience`` is at most the largest day of all earlier batches, its next number becomes the
    smallest held one; ``missed`` has how many numbers that passes. What is held after the last batch is applied as batch ``batches`` + 1.

    Days and numbers are never null; null clients are one client; a batch may be empty, as may the table. Rows that repeat a number are rejected, exact copies
    too. Other columns are left out. Every call streams through a new folder under spark.checkpoint.dir, which goes when the session's JVM ends.
    """
    spark = changes.sparkSession
    home = f"{shared_dir(spark)}/netloom/changes-{uuid.uuid4().hex}"
    columns = [F.col("client_id").cast("long"), F.col("n").cast("long"), F.col("day").cast("int"), F.col("change_id").cast("long"), F.col("op").cast("string"), *[F.col(f"`{c}`") for c in values]]
    rows = changes.select(*columns, F.col("batch").cast("int"))
    # a row without a number gives every batch a file, so that an empty one starts as well
    ticks = spark.range(1, batches + 2).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema.fields[:-1]], F.col("id").cast("int").alias("batch"))
    rows.unionByName(ticks).write.partitionBy("batch").parquet(f"{home}/staged")
    schema = rows.drop("batch").schema
    days = {r[0]: r[1] for r in spark.read.schema(rows.schema).parquet(f"{home}/staged").groupBy("batch").agg(F.max("day")).collect() if r[1] is not None}
    kept = StructType([f for f in schema.fields if f.name in values])
    out = StructType([*schema.fields, *StructType.fromDDL("status string, batch int, missed long").fields])
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(home).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.deleteOnExit(path(home))
    fs.mkdirs(path(f"{home}/fed"))
    before = {k: spark.conf.get(k, None) for k in STORE}
    try:
        for k, v in STORE.items():
            spark.conf.set(k, v)
        for batch in range(1, batches + 2):
            if not fs.rename(path(f"{home}/staged/batch={batch}"), path(f"{home}/fed/{batch}")):
                raise OSError(f"batch {batch} can't be fed")
            latest = max((d for b, d in days.items() if b < batch), default=None)
            fed = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1 << 30).parquet(f"{home}/fed/*").where("n IS NOT NULL")
            firsts = fed.groupBy("client_id", "n").transformWithState(FirstArrivals(), StructType([*schema.fields, StructField("lane", LongType()), StructField("owner", LongType())]), "append", "none")
            done = firsts.groupBy("owner", "lane").transformWithState(Sequence(kept, batch, latest, patience, batch > batches), out, "append", "processingTime")
            done.writeStream.format("parquet").option("path", f"{home}/out").option("checkpointLocation", f"{home}/checkpoint").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    return spark.read.schema(out).parquet(f"{home}/out")


def current(done: DataFrame) -> Column:
    """Whether a row of :func:`with_last` is the client's final applied one and no deletion."""
    return F.coalesce(F.col("status").eqNullSafe("applied") & F.col("__last") & ~F.col("op").eqNullSafe("D"), F.lit(False))


def with_last(done: DataFrame) -> DataFrame:
    """``done`` with __last: whether the row is the last that was applied to its client.

    The largest number of a client is summed up map-side and joined by client and number, so that a hot client's rows are spread.
    """
    last = done.where("status = 'applied'").groupBy("client_id").agg(F.max("n").alias("__n")).select(F.col("client_id").alias("__client"), "__n", F.lit(True).alias("__last"))
    return done.join(last, done["client_id"].eqNullSafe(last["__client"]) & (done["n"] == last["__n"]), "left").drop("__client", "__n").withColumn("__last", F.coalesce("__last", F.lit(False)))


def shop_changes(rows: DataFrame, batches: int = 8, first_day: int = 19_723, days: int = 160) -> DataFrame:
    """The shop's client_changes as :func:`applied` takes them: distinct, numbered, some late, some lost, dealt to batches by day."""
    rows = rows.distinct()
    h = F.crc32(F.col("change_id").cast("string"))
    rows = numbered(rows).withColumn("h", h).where("valid_at IS NOT NULL AND h IS NOT NULL AND h % 11 <> 0")
    rows = rows.withColumn("day", (F.unix_date(F.to_date("valid_at")) + 2 * (F.col("h") % 4)).cast("int"))
    batch = F.least(F.lit(batches), 1 + F.floor((F.col("day") - first_day) * batches / days))
    return rows.withColumn("batch", F.greatest(F.lit(1), batch).cast("int"))


def digest(done: DataFrame) -> DataFrame:
    """Every row's outcome as the query returns it."""
    done = with_last(done)
    cents = F.when(~F.isnan("balance") & (F.abs("balance") < 9e16), F.floor(100 * F.col("balance") + 0.5).cast("long"))
    return done.select("change_id", "client_id", "status", "batch", "missed", "city", cents.alias("cents"), current(done).alias("current"))


def shop_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = spark.read.parquet(f"{sf_dir}/client_changes.parquet").select("change_id", "client_id", "seq", "op", "valid_at", "source", "segment", "city", "balance")
    return digest(applied(shop_changes(changes), 8, ("city", "balance")))
