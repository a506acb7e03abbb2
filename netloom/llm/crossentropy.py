"""Cross-entropy difference of two n-gram models (operator 2).

The target model counts documents of a target set (label quality 1), the background model counts all documents, scaled to the
target's number of words. Both are bigram models over one vocabulary of V words with a prior of PRIOR words spread evenly:

    P(word | before) = (c(before, word) + PRIOR / V) / (c(before) + PRIOR)

A document's own counts are left out of both models when it is scored. The score is the mean difference of losses over a
document's tokens (nats); lower means closer to the target.

Logarithms of counts of pairs and of words before add up, so a text is a bag of events (pairs and heads), each a hash. Counting and scoring share
one exchange: every event of every document goes, packed, to the task that counts that event, which sends back what the document's losses gain
over those of events that nobody else has. What is gathered grows with the corpus: no event is merged, cut or sampled. Events with a large
share of all are few, whatever the corpus; they are counted first, broadcast, and scored where the texts are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.llm.common import saved, small_batches
from netloom.llm.words import LOWER, chunks, mix, span_hashes, word_spans

#: Words that the prior is worth, spread evenly over the vocabulary.
PRIOR = 100.0
#: Events that a task holds before it sends them on, and that a counting group gets on average.
HELD, GROUP = 1 << 20, 1 << 20
#: Share of all events from which an event is broadcast; there are at most 2 / SHARE such events (32 bytes each).
SHARE = 1 / 20_000
#: Ids of target documents that may be broadcast (8 bytes each).
BROADCAST_ROWS = 2_000_000
#: Word hashes of the sketch that estimates the vocabulary's size (standard error 1 / sqrt).
SKETCH = 4096
#: Bits of an event's number: a hash, and the lowest one tells a head (1) from a pair (0).
BITS = 48
_TARGET = np.uint16(1 << 15)


@dataclass
class Bag:
    """Distinct events of some documents: ``event`` occurs ``n`` times in document ``doc`` (0, 1, ...)."""

    ids: pa.Array
    target: np.ndarray
    tokens: np.ndarray
    doc: np.ndarray
    event: np.ndarray
    n: np.ndarray
    words: np.ndarray


def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[Bag]:
    """Of (doc_id, text, t), about HELD events at a time, fewer than 2**15 documents."""
    held: list[tuple] = []
    size = 0
    for batch in batches:
        first = 0
        target = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
        for _, _, data, at in chunks(batch.column(1)):
            with np.errstate(over="ignore"):
                data = LOWER[data]
                starts, ends, bounds = word_spans(data, at)
                words = span_hashes(data, starts, ends)
                before = np.concatenate([np.zeros(1, np.uint64), words[:-1]]) if len(words) else words
                before[bounds[:-1][np.diff(bounds) > 0]] = 0
                low = np.uint64((1 << BITS) - 2)
                events = np.concatenate([mix(before * np.uint64(0xD6E8FEB86659FD93) + words, 3) & low, (mix(before, 4) & low) | np.uint64(1)])
            docs = np.tile(np.repeat(np.arange(len(at) - 1), np.diff(bounds)), 2)
            key = (docs.astype(np.uint64) << np.uint64(BITS)) | events  # a batch has far fewer than 2**16 texts
            key, n = np.unique(key, return_counts=True)
            rows = len(at) - 1
            held.append((batch.column(0).slice(first, rows), target[first : first + rows], np.diff(bounds), (key >> np.uint64(BITS)).astype(np.int64), key & np.uint64((1 << BITS) - 1), n, np.unique(words)[:SKETCH]))
            first += rows
            size += len(key)
            if size > HELD or sum(len(h[1]) for h in held) > 1 << 14:
                yield _merged(held)
                held, size = [], 0
    if held:
        yield _merged(held)


def _merged(held: list[tuple]) -> Bag:
    base = np.cumsum([0] + [len(h[1]) for h in held])
    parts = list(zip(*held))
    return Bag(
        pa.chunked_array(parts[0]).combine_chunks(), np.concatenate(parts[1]), np.concatenate(parts[2]), np.concatenate([d + b for d, b in zip(parts[3], base)]),
        np.concatenate(parts[4]), np.concatenate(parts[5]), np.unique(np.concatenate(parts[6]))[:SKETCH],
    )


def _sums(events: np.ndarray, *counts: np.ndarray) -> list[np.ndarray]:
    found, where = np.unique(events, return_inverse=True)
    return [found, *(np.bincount(where, c, minlength=len(found)).astype(np.int64) for c in counts)]


def _batch(**columns: np.ndarray | list) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({k: pa.array(v) for k, v in columns.items()})


@dataclass
class Model:
    """Frequent events with their counts in target (t) and background (b), the words of both, the vocabulary's size, all distinct events of documents."""

    events: np.ndarray
    t: np.ndarray
    b: np.ndarray
    total: tuple[int, int]
    vocabulary: float
    entries: int

    def gains(self, event: np.ndarray, n: np.ndarray, target: np.ndarray, t: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What n occurrences of an event with counts t and b, its document's own included, add to its losses beyond events that are new to both models."""
        scale = self.total[0] / self.total[1] if self.total[1] else 0.0
        head = (event & np.uint64(1)).astype(bool)
        floor = np.where(head, PRIOR, PRIOR / max(self.vocabulary, 1.0))
        sign = np.where(head, n, -n)
        return sign * np.log1p((t - n * target) / floor), sign * np.log1p(scale * (b - n) / floor)


def _source(docs: DataFrame, target: DataFrame, id_col: str, text_col: str) -> DataFrame:
    small_batches(docs.sparkSession)
    chosen = target.select(F.col("doc_id").cast("long").alias("__target")).where("__target IS NOT NULL").distinct()
    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("i"), F.col(f"`{text_col}`").alias("text"))
    # Ids only are broadcast, and only so many; texts are shuffled beyond that.
    few = chosen.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    joined = source.join(F.broadcast(chosen) if few else chosen, F.col("i") == F.col("__target"), "left")
    return joined.select("i", "text", F.col("__target").isNotNull().alias("t"))


def fit(source: DataFrame) -> Model:
    """Totals, the vocabulary's size and the frequent events of (i, text, t). Two passes over the texts; what reaches the driver is bounded."""

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """kind 0: frequent events; 1: sketch of words; 2: words of the target; 3: words; 4: entries; 5: events."""
        words, sums = np.zeros(0, np.uint64), np.zeros(4, np.int64)
        for bag in bags(batches):
            event, n = _sums(bag.event, bag.n)
            some = n >= max(8, SHARE * n.sum())
            yield _batch(kind=np.zeros(some.sum(), np.int32), x=event[some].view(np.int64), n=n[some])
            words = np.unique(np.concatenate([words, bag.words]))[:SKETCH]
            sums += [bag.tokens[bag.target].sum(), bag.tokens.sum(), len(bag.n), n.sum()]
        yield _batch(kind=np.ones(len(words), np.int32), x=(words >> np.uint64(1)).view(np.int64), n=np.zeros(len(words), np.int64))
        yield _batch(kind=np.arange(2, 6, dtype=np.int32), x=np.zeros(4, np.int64), n=sums)

    found = saved(source.mapInArrow(frequent, "kind int, x long, n long").groupBy("kind", "x").agg(F.sum("n").alias("n")), "frequent")
    sums = {r.kind: r.n for r in found.where("kind > 1").collect()}
    words = [r.x for r in found.where("kind = 1").orderBy("x").limit(SKETCH).collect()]
    vocabulary = float(len(words)) if len(words) < SKETCH else (SKETCH - 1) * 2.0**63 / max(words[-1], 1)
    least = SHARE / 2 * sums.get(5, 0)
    hot = np.sort(np.array([r.x for r in found.where((F.col("kind") == 0) & (F.col("n") >= least)).select("x").collect()], np.int64).view(np.uint64))

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, b = np.zeros(len(hot), np.int64), np.zeros(len(hot), np.int64)
        for bag in bags(batches):
            at, some = _found(hot, bag.event)
            b += np.bincount(at, bag.n[some], minlength=len(hot)).astype(np.int64)
            t += np.bincount(at, bag.n[some] * bag.target[bag.doc[some]], minlength=len(hot)).astype(np.int64)
        yield _batch(k=np.arange(len(hot), dtype=np.int32), t=t, b=b)

    t, b = np.zeros(len(hot), np.int64), np.zeros(len(hot), np.int64)
    if len(hot):
        for r in source.mapInArrow(counts, "k int, t long, b long").groupBy("k").agg(F.sum("t").alias("t"), F.sum("b").alias("b")).collect():
            t[r.k], b[r.k] = r.t, r.b
    return Model(hot, t, b, (sums.get(2, 0), sums.get(3, 0)), vocabulary, sums.get(4, 0))


def _found(hot: np.ndarray, events: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in ``hot``, which) of the events that are in it."""
    if not len(hot):
        return np.zeros(0, np.int64), np.zeros(len(events), bool)
    at = np.minimum(np.searchsorted(hot, events), len(hot) - 1)
    some = hot[at] == events
    return at[some], some


def _packed(*columns: np.ndarray) -> bytes:
    return b"".join(np.ascontiguousarray(c).tobytes() for c in columns)


def _unpacked(blob: bytes, *kinds: str) -> list[np.ndarray]:
    n, at, out = len(blob) // sum(np.dtype(k).itemsize for k in kinds), 0, []
    for k in kinds:
        out.append(np.frombuffer(blob, k, n, at))
        at += n * np.dtype(k).itemsize
    return out


def scored(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, target_loss, background_loss, score) for every row of ``docs``, losses as means over tokens.

    ``target`` (doc_id): documents of the target model. Null and empty texts have 0 tokens and null losses. Rows with a null id are scored like
    others and aren't of the target; rows that repeat an id or a text are documents of their own. Without a target document the target model is
    uniform. An empty table gives no row. Other columns are ignored.
    """
    source = _source(docs, target, id_col, text_col)
    model = fit(source)
    groups = max(1, -(-model.entries // GROUP))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    new = -np.log(PRIOR / max(model.vocabulary, 1.0)), np.log(PRIOR)  # of a pair and of a head that no one else has

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for k, bag in enumerate(bags(batches)):
            base = (task << 33) | k
            hot = shared.value
            at, some = _found(hot.events, bag.event)
            t, b = hot.gains(bag.event[some], bag.n[some], bag.target[bag.doc[some]], hot.t[at], hot.b[at])
            docs = len(bag.tokens)
            t, b = np.bincount(bag.doc[some], t, minlength=docs), np.bincount(bag.doc[some], b, minlength=docs)
            known = ~bag.ids.is_null().to_numpy(zero_copy_only=False)
            ids = bag.ids.fill_null(0).to_numpy()
            yield _batch(p=[-1 - base % 1_000_003], base=[base], blob=[_packed(known, ids, bag.tokens.astype(np.int64), t, b)])
            doc, event, n = bag.doc[~some], bag.event[~some], bag.n[~some]
            p = (mix(event, 5) % np.uint64(groups)).astype(np.int64)
            order = np.argsort(p, kind="stable")
            p, doc, event, n = p[order], doc[order], event[order], n[order]
            cuts = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]])) if len(p) else p
            doc = doc.astype(np.uint16) | np.where(bag.target[doc], _TARGET, np.uint16(0))
            high, low, n = (event >> np.uint64(16)).astype(np.uint32), event.astype(np.uint16), n.astype(np.uint32)
            blobs = [_packed(high[x:y], low[x:y], doc[x:y], n[x:y]) for x, y in zip(cuts.tolist(), [*cuts[1:].tolist(), len(p)])]
            yield _batch(p=p[cuts], base=np.full(len(cuts), base), blob=pa.array(blobs, pa.binary()))

    def counted(table: pa.Table) -> pa.Table:
        """Of a group of events: to every batch of documents what their losses gain. Rows about documents pass."""
        bases, blobs = table.column("base").to_numpy(), table.column("blob").to_pylist()
        if table.column("p")[0].as_py() < 0:
            return pa.table({"base": bases, "about": np.ones(len(bases), bool), "blob": pa.array(blobs, pa.binary())})
        parts = [_unpacked(x, "u4", "u2", "u2", "u4") for x in blobs]
        high, low, doc, n = (np.concatenate(x) for x in zip(*parts))
        which = np.repeat(np.arange(len(parts)), [len(x[0]) for x in parts])
        event = (high.astype(np.uint64) << np.uint64(16)) | low
        of_target, doc, n = (doc & _TARGET) > 0, doc & ~_TARGET, n.astype(np.float64)
        _, where = np.unique(event, return_inverse=True)
        t, b = np.bincount(where, n * of_target)[where], np.bincount(where, n)[where]
        some = np.flatnonzero(b > n)  # others have no one else's count
        t, b = shared.value.gains(event[some], n[some], of_target[some], t[some], b[some])
        key, where = np.unique(which[some] * (1 << 15) + doc[some].astype(np.int64), return_inverse=True)
        t, b = np.bincount(where, t, minlength=len(key)), np.bincount(where, b, minlength=len(key))
        owner = key >> 15
        cuts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if len(owner) else owner
        out = [_packed((key[x:y] & 0x7FFF).astype(np.uint16), t[x:y].astype(np.float32), b[x:y].astype(np.float32)) for x, y in zip(cuts.tolist(), [*cuts[1:].tolist(), len(key)])]
        return pa.table({"base": bases[owner[cuts]], "about": np.zeros(len(cuts), bool), "blob": pa.array(out, pa.binary())})

    def summed(table: pa.Table) -> pa.Table:
        about, blobs = table.column("about").to_pylist(), table.column("blob").to_pylist()
        known, ids, tokens, t, b = _unpacked(blobs[about.index(True)], "?", "i8", "i8", "f8", "f8")
        t, b = t + tokens * sum(new), b + tokens * sum(new)
        for mine, blob in zip(about, blobs):
            if not mine:
                doc, more, less = _unpacked(blob, "u2", "f4", "f4")
                t[doc] += more
                b[doc] += less
        with np.errstate(invalid="ignore", divide="ignore"):
            t, b = t / tokens, b / tokens
        none = tokens == 0
        return pa.table({"doc_id": pa.array(ids, mask=~known), "n_tokens": tokens, "target_loss": pa.array(t, mask=none), "background_loss": pa.array(b, mask=none), "score": pa.array(t - b, mask=none)})

    entries = source.mapInArrow(sent, "p long, base long, blob binary")
    gained = entries.groupBy("p").applyInArrow(counted, "base long, about boolean, blob binary")
    return gained.groupBy("base").applyInArrow(summed, "doc_id long, n_tokens long, target_loss double, background_loss double, score double")
