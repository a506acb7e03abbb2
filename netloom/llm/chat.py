"""Chat transcripts: roles by a hidden Markov model, then canonical turns (operator 6).

A transcript comes as rows of raw text in order. Every line is an observation: its speaker marker, its length and
whether it ends as a question. States are (role, first line or later line of a turn). Viterbi finds the most likely roles.

A transcript may be long: it is cut into blocks, each block gives its best scores from any entry state to any exit state,
the blocks' entry and exit states follow from these small matrices, and each block is then decoded between its
two states. The result is that of one pass over the whole transcript.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netloom.llm.common import saved, small_batches

ROLES = ("system", "user", "assistant")
#: Rows in a block, and transcripts (in expectation) from which the model is learned.
BLOCK_ROWS, FIT_TRANSCRIPTS = 512, 20_000

# Speaker markers, by role.
MARKERS = {
    "system": ("system", "sys", "instructions", "context"),
    "user": ("user", "human", "customer", "question", "q", "me"),
    "assistant": ("assistant", "ai", "bot", "agent", "answer", "a", "model"),
}
MARKER = re.compile(r"\s*(?:<\|)?(?:#{1,6}\s*)?[\[(*_]{0,2}([A-Za-z]{1,12})[\])*_]{0,2}\s*(?:\|>|:|>)[*_]{0,2}\s?")
_ROLE_OF = {w: r for r, words in MARKERS.items() for w in words}
#: Observation: marker (4) x place in the row (2) x length class (8) x question (2).
KINDS = 4 * 2 * 8 * 2
FIRST, LATER = 0, 1
STATES = 2 * len(ROLES)


def marker(line: str) -> tuple[int, int]:
    """(1 + number of the role that the line's marker names or 0, end of the marker)."""
    m = MARKER.match(line)
    role = _ROLE_OF.get(m[1].lower()) if m else None
    return (ROLES.index(role) + 1, m.end()) if role else (0, 0)


def observe(text: str | None) -> tuple[list[str], list[int]]:
    """Lines of a row and what is seen of each. The first line's length class is that of the row up to its next marker."""
    lines = (text or "").split("\n")
    marks = [marker(x)[0] for x in lines]
    seen = []
    for k, line in enumerate(lines):
        if k == 0 or marks[k]:
            end = next((j for j in range(k + 1, len(lines)) if marks[j]), len(lines))
            size = sum(len(x) for x in lines[k:end])
        else:
            size = len(line)
        length = min(7, max(0, int(size).bit_length() - 4))
        question = line.rstrip().endswith("?")
        seen.append(((marks[k] * 2 + (k == 0)) * 8 + length) * 2 + question)
    return lines, seen


class Model:
    """Log probabilities: of the first state, of a state after a state, of an observation in a state."""

    def __init__(self, start: np.ndarray, step: np.ndarray, emit: np.ndarray) -> None:
        self.start, self.step, self.emit = start, step, emit

    @classmethod
    def counted(cls, start: np.ndarray, step: np.ndarray, emit: np.ndarray) -> Model:
        """From counts, smoothed; a marker that names a role speaks for it even where none was counted."""
        emit = emit + 0.05
        for kind in range(KINDS):
            mark = kind // 32
            for state in range(STATES):
                if mark:
                    emit[state, kind] += 2.0 if (state // 2 == mark - 1 and state % 2 == FIRST) else 0.0
        norm = lambda x: np.log((x + 1e-3) / (x + 1e-3).sum(axis=-1, keepdims=True))
        start, step = start + 0.1, step + 0.1
        start[1::2] = 0  # a transcript can't begin in the middle of a turn
        for a in range(STATES):
            for b in range(STATES):
                if b % 2 == LATER and a // 2 != b // 2:
                    step[a, b] = 0  # a turn's later lines keep its role
        with np.errstate(divide="ignore"):
            start, step = np.log(start / start.sum()), np.log(step / step.sum(axis=1, keepdims=True))
        return cls(start, step, norm(emit))

    def spans(self, seen: list[int]) -> np.ndarray:
        """[entry, exit]: best score of a block, the entry state being the one before it."""
        best = np.where(np.eye(STATES, dtype=bool), 0.0, -np.inf)
        for o in seen:
            best = (best[:, :, None] + self.step[None]).max(axis=1) + self.emit[None, :, o]
        return best

    def path(self, seen: list[int], entry: int | None, exit_: int | None) -> list[int]:
        """The best states of a block between an entry state (none at a transcript's start) and an exit state."""
        if not seen:
            return []
        best = (self.start if entry is None else self.step[entry]) + self.emit[:, seen[0]]
        back = []
        for o in seen[1:]:
            ways = best[:, None] + self.step
            back.append(ways.argmax(axis=0))
            best = ways.max(axis=0) + self.emit[:, o]
        state = int(best.argmax()) if exit_ is None else exit_
        states = [state]
        for b in reversed(back):
            state = int(b[state])
            states.append(state)
        return states[::-1]


def _grouped(rows: Callable[[list[dict]], Iterator[dict]], key: tuple[str, ...], schema: pa.Schema) -> Callable:
    """Runs ``rows`` on each run of rows with equal ``key`` in a sorted partition; runs may cross batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        last = None
        for batch in batches:
            out: list[dict] = []
            for row in batch.to_pylist():
                now = tuple(row[k] for k in key)
                if held and now != last:
                    out += rows(held)
                    held = []
                held.append(row)
                last = now
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)
        if held:
            yield pa.RecordBatch.from_pylist(list(rows(held)), schema)

    return run


def held_out(column: str) -> Column:
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def fit(rows: DataFrame, id_col: str = "conv_id", order_col: str = "turn", role_col: str = "role", text_col: str = "text", transcripts: int = FIT_TRANSCRIPTS) -> Model:
    """Counts states of rows with known roles (a row is a turn), of a bounded sample of transcripts outside the held-out quarter."""
    small_batches(rows.sparkSession)
    known = rows.select(
        F.col(f"`{id_col}`").alias("c"), F.col(f"`{order_col}`").cast("long").alias("t"), F.col(f"`{role_col}`").alias("role"), F.col(f"`{text_col}`").alias("text")
    ).where(F.col("role").isin(*ROLES) & F.col("c").isNotNull() & ~held_out("c"))
    many = known.select("c").distinct().count()
    cut = min(1 << 24, int(transcripts / max(1, many) * (1 << 24)) + 1)
    known = known.where(F.pmod(F.xxhash64("c", F.lit(6)), F.lit(1 << 24)) < cut)
    before = F.lag("role").over(Window.partitionBy("c", F.floor(F.col("t") / BLOCK_ROWS)).orderBy("t", "text"))
    known = known.withColumn("before", before).withColumn("head", F.col("before").isNull() & (F.floor(F.col("t") / BLOCK_ROWS) == 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, step, emit = np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros((STATES, KINDS))
        for batch in batches:
            for row in batch.to_pylist():
                state = 2 * ROLES.index(row["role"])
                _, seen = observe(row["text"])
                emit[state, seen[0]] += 1
                for o in seen[1:]:
                    emit[state + LATER, o] += 1
                if row["head"]:
                    start[state] += 1
                if row["before"]:  # the turn before ended on its first or a later line; both lead on alike
                    for kind in (FIRST, LATER):
                        step[2 * ROLES.index(row["before"]) + kind, state] += 1
                if len(seen) > 1:
                    step[state, state + LATER] += 1
                    step[state + LATER, state + LATER] += len(seen) - 2
        flat = np.concatenate([start, step.ravel(), emit.ravel()])
        where = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(where, pa.int32()), pa.array(flat[where])], ["k", "n"])

    counted = known.select("role", "before", "head", "text").mapInArrow(run, "k int, n double").groupBy("k").agg(F.sum("n").alias("n")).collect()
    flat = np.zeros(STATES + STATES * STATES + STATES * KINDS)
    for r in counted:
        flat[r.k] = r.n
    a, b = STATES, STATES + STATES * STATES
    return Model.counted(flat[:a], flat[a:b].reshape(STATES, STATES), flat[b:].reshape(STATES, KINDS))


def parsed(rows: DataFrame, model: Model, id_col: str = "conv_id", order_col: str = "turn", text_col: str = "text") -> DataFrame:
    """(conv_id, turn, part, role, content, rendered): the turns that each row's lines make up.

    ``part`` numbers the turns of a row from 0; a turn that runs on into the next row goes on there as a part with the same role. A speaker
    marker that the model followed is left out of ``content``. ``rendered`` is ``<|role|>``, a line feed, the content, a line feed and
    ``<|end|>``. Null texts count as empty, and every row gives at least one turn. Rows of a transcript with equal order follow their texts' order; repeated rows stay.
    A null id is a transcript like others, a null order comes first. Roles of the input are never read. An empty table gives no row.
    """
    small_batches(rows.sparkSession)
    shared = rows.sparkSession.sparkContext.broadcast(model)
    source = rows.select(F.col(f"`{id_col}`").cast("long").alias("conv_id"), F.col(f"`{order_col}`").cast("long").alias("turn"), F.col(f"`{text_col}`").alias("text"))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = [observe(t)[1] for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(seen, pa.list_(pa.int32()))], ["conv_id", "turn", "text", "seen"])

    looked = source.mapInArrow(look, "conv_id long, turn long, text string, seen array<int>")
    looked = looked.withColumn("block", F.coalesce(F.floor(F.col("turn") / BLOCK_ROWS), F.lit(-(1 << 60))).cast("long"))
    looked = saved(looked, "lines")
    key = ("conv_id", "block")

    def ordered(df: DataFrame) -> DataFrame:
        return df.repartition(*key).sortWithinPartitions(*key, "turn", "text")

    # entry and exit states of the blocks of transcripts that have more than one
    count = looked.select(*key).distinct().groupBy("conv_id").agg(F.count("*").alias("blocks"))
    many = count.where("blocks > 1").select(F.col("conv_id").alias("c"))
    long_ = looked.join(many, looked["conv_id"].eqNullSafe(many["c"]), "left_semi").select(*key, "turn", "text", "seen")

    def spans(held: list[dict]) -> Iterator[dict]:
        seen = [o for row in held for o in row["seen"]]
        yield {"conv_id": held[0]["conv_id"], "block": held[0]["block"], "spans": shared.value.spans(seen).ravel().tolist()}

    matrix = pa.schema([("conv_id", pa.int64()), ("block", pa.int64()), ("spans", pa.list_(pa.float64()))])
    matrices = ordered(long_).mapInArrow(_grouped(spans, key, matrix), "conv_id long, block long, spans array<double>")

    def first_spans(held: list[dict]) -> Iterator[dict]:
        m = shared.value
        seen = [o for row in held for o in row["seen"]]
        best = m.start + m.emit[:, seen[0]]
        for o in seen[1:]:
            best = (best[:, None] + m.step).max(axis=0) + m.emit[:, o]
        yield {"conv_id": held[0]["conv_id"], "block": held[0]["block"], "spans": best.tolist()}

    lowest = long_.groupBy("conv_id").agg(F.min("block").alias("low")).withColumnRenamed("conv_id", "c")
    at_start = long_.join(lowest, long_["conv_id"].eqNullSafe(lowest["c"]) & (F.col("block") == F.col("low")), "left_semi")
    starts = ordered(at_start).mapInArrow(_grouped(first_spans, key, matrix), "conv_id long, block long, spans array<double>")
    inner = matrices.join(lowest, matrices["conv_id"].eqNullSafe(lowest["c"]) & (F.col("block") == F.col("low")), "left_anti")

    def chained(held: list[dict]) -> Iterator[dict]:
        best = np.array(held[0]["spans"])
        back = []
        for row in held[1:]:
            ways = best[:, None] + np.array(row["spans"]).reshape(STATES, STATES)
            back.append(ways.argmax(axis=0))
            best = ways.max(axis=0)
        state = int(best.argmax())
        for k in range(len(held) - 1, -1, -1):
            entry = int(back[k - 1][state]) if k else None
            yield {"conv_id": held[k]["conv_id"], "block": held[k]["block"], "entry": entry, "exit": state}
            state = entry if k else state

    edge = pa.schema([("conv_id", pa.int64()), ("block", pa.int64()), ("entry", pa.int32()), ("exit", pa.int32())])
    edges = (
        starts.unionAll(inner).repartition("conv_id").sortWithinPartitions("conv_id", "block")
        .mapInArrow(_grouped(chained, ("conv_id",), edge), "conv_id long, block long, entry int, exit int")
    )
    e = edges.select(F.col("conv_id").alias("ec"), F.col("block").alias("eb"), "entry", "exit")
    framed = looked.join(e, looked["conv_id"].eqNullSafe(e["ec"]) & (looked["block"] == e["eb"]), "left").drop("ec", "eb")

    def turns(held: list[dict]) -> Iterator[dict]:
        seen = [o for row in held for o in row["seen"]]
        states = shared.value.path(seen, held[0]["entry"], held[0]["exit"])
        at = 0
        for row in held:
            lines = (row["text"] or "").split("\n")
            mine = states[at : at + len(lines)]
            at += len(lines)
            begin = [k for k, s in enumerate(mine) if k == 0 or s % 2 == FIRST]
            for part, (a, b) in enumerate(zip(begin, [*begin[1:], len(lines)])):
                role = ROLES[mine[a] // 2]
                mark, end = marker(lines[a])
                first = lines[a][end:] if mark and ROLES[mark - 1] == role else lines[a]
                content = "\n".join([first, *lines[a + 1 : b]])
                yield {
                    "conv_id": row["conv_id"], "turn": row["turn"], "part": part, "role": role, "content": content,
                    "rendered": f"<|{role}|>\n{content}\n<|end|>",
                }

    out = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("part", pa.int32()), *[(c, pa.string()) for c in ("role", "content", "rendered")]])
    return ordered(framed).mapInArrow(_grouped(turns, key, out), "conv_id long, turn long, part int, role string, content string, rendered string")
