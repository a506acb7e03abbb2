"""Benchmark decontamination by latent semantic retrieval (operator 9).

1. Benchmark items are cut into passages; their words are the features. Document frequencies come from all documents.
2. A randomised SVD of the TF-IDF matrix of passages gives the latent space: the matrix times a random test matrix, twice through
   its transpose, is summed over partitions; only matrices of features times rank meet on the driver.
3. Every window of every document goes into that space, and cosines with all passages give candidates, block by block. Where items are
   shorter than a window, shorter windows are searched too. A window that holds fewer of the benchmark's words than the shortest item needs is left out, and
   so is one whose surroundings hold too few of any item's words for the last step.
4. The longest common subsequence of the item's and the region's words, and of the item's answer (its last sentence), confirm.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.llm.common import fresh, small_batches, widened
from netloom.llm.pieces import Keys
from netloom.llm.words import chunks, span_hashes, word_spans

#: Words of a passage or window, words between the starts of two passages, windows that start within a window's length, words of the shortest window.
WINDOW, ITEM_STEP, TEXT_STEPS, SHORTEST = 16, 8, 4, 4
RANK, OVERSAMPLED, TURNS = 256, 16, 2
#: Least share of known words in a window, least cosine, least share of an item's words in order, the same for its answer.
KNOWN, COSINE, COMMON, ANSWER = 0.5, 0.45, 0.6, 0.5
#: Least part of a passage's weight that a window has. A cosine alone is high for a window that knows one or two words.
COVER = 0.25
#: Different words of a benchmark, whose vectors meet on the driver and are broadcast (some 5 and 1 kB each), and its bytes; a larger one is refused.
MOST_WORDS, MOST_BYTES = 60_000, 8_000_000
#: Windows and passages that are compared at once.
BLOCK = 2048
#: Words whose windows share a look at what their surroundings hold, and entries (words times items) of the table for it; a benchmark beyond has every window searched.
SHARED, MOST_COUNTS = 64, 16_000_000

# Bytes that belong to no word: ASCII but letters and digits.
_OTHER = np.zeros(256, bool)
_OTHER[:128] = True
_OTHER[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False


def hashed(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes, row bounds) of texts in lower case; a word is letters, digits and characters beyond ASCII."""
    raw = [t.lower().encode("utf-8", "replace") for t in texts]
    at = np.zeros(len(raw) + 1, np.int64)
    np.cumsum([len(r) for r in raw], out=at[1:])
    data = np.frombuffer(b"".join(raw), np.uint8)
    with np.errstate(over="ignore"):
        starts, ends, bounds = word_spans(data, at, _OTHER)
        return span_hashes(data, starts, ends), bounds


def common_length(x: list[int], y: list[int]) -> int:
    """Length of the longest common subsequence, a bit for each word of ``x``."""
    where: dict[int, int] = {}
    for k, w in enumerate(x):
        where[w] = where.get(w, 0) | (1 << k)
    full = (1 << len(x)) - 1
    row = full
    for w in y:
        hit = row & where.get(w, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(x) - bin(row).count("1")


@dataclass
class Index:
    """Items (word hashes, answer's words), features, and passages in the latent space."""

    ids: list[int]
    items: list[list[int]]
    answers: list[list[int]]
    keys: Keys | None
    idf: np.ndarray
    basis: np.ndarray  # features x rank, rows weighted by idf
    passages: np.ndarray  # rank x passages, of length 1
    weights: np.ndarray  # lengths that passages had
    owner: np.ndarray
    counts: np.ndarray | None = None  # features x items: how often an item has a word

    def reach(self) -> int:
        """Words beside a window that the last step looks at, at most."""
        return max((len(x) + min(WINDOW, len(x)) for x in self.items), default=0)

    def widths(self) -> list[int]:
        """Words of a window: WINDOW, and halves of it down to the shortest item."""
        shortest, out = min((len(x) for x in self.items if x), default=WINDOW), [WINDOW]
        while out[-1] > SHORTEST and out[-1] > 1.5 * shortest:
            out.append(out[-1] // 2)
        return out

    def least(self) -> float:
        """Words in common without which no item passes the last step."""
        return max(1.0, COMMON * min((len(x) for x in self.items if x), default=WINDOW) - 1e-9)


def _passages(items: list[list[int]]) -> tuple[list[list[int]], np.ndarray]:
    out, owner = [], []
    for k, words in enumerate(items):
        starts = range(0, max(1, len(words) - WINDOW + ITEM_STEP), ITEM_STEP)
        for a in starts:
            if words[a : a + WINDOW]:
                out.append(words[a : a + WINDOW])
                owner.append(k)
    return out, np.array(owner, np.int64)


def fit(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", rank: int = RANK) -> Index:
    """Statistics over all of ``docs``; the space of the benchmark's passages."""
    small_batches(docs.sparkSession)
    spark = docs.sparkSession
    wanted = benchmark.select(F.col("item_id").cast("long").alias("i"), F.col("text")).where("text IS NOT NULL").distinct()
    held = wanted.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if held > MOST_BYTES:
        raise ValueError(f"the benchmark has {held} bytes; split it into parts of at most {MOST_BYTES}")
    rows = wanted.orderBy("i", "text").collect()
    texts = [r.text for r in rows]
    flat, bounds = hashed(texts)
    items = [flat[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])]
    # the answer: the last sentence that isn't the whole item
    tails = [re.split(r"[.\n!?]+\s*", t.strip(" .\n!?"))[-1] for t in texts]
    flat_tails, tail_bounds = hashed(tails)
    answers = [flat_tails[a:b].tolist() for a, b in zip(tail_bounds[:-1], tail_bounds[1:])]
    answers = [a if len(a) < len(w) else [] for a, w in zip(answers, items)]
    features = np.unique(flat)
    if len(features) > MOST_WORDS:
        raise ValueError(f"the benchmark has {len(features)} words; split it into parts of at most {MOST_WORDS}")
    ids = [r.i for r in rows]
    if not len(features):
        return Index(ids, items, answers, None, np.zeros(0), np.zeros((0, 1)), np.zeros((1, 0)), np.zeros(0), np.zeros(0, np.int64))
    keys = Keys(features, np.arange(len(features), dtype=np.int32))
    shared = spark.sparkContext.broadcast(keys)

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, n = np.zeros(len(features) + 1, np.int64), len(features)
        for batch in batches:
            for _, where, rows, count in _features(batch.column(0), shared.value):
                pairs = np.unique(rows * n + where)
                found[:n] += np.bincount(pairs % n, minlength=n)
                found[n] += count
        some = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(found[some])], ["f", "n"])

    counted = docs.select(F.col(f"`{text_col}`").alias("t")).mapInArrow(frequencies, "f int, n long").groupBy("f").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros(len(features) + 1)
    df[counted["f"].to_numpy()] = counted["n"].to_numpy()
    idf = np.log((df[-1] + 1) / (df[:-1] + 1)) + 0.1

    passages, owner = _passages(items)
    at = [np.searchsorted(features, np.array(p, np.uint64)) for p in passages]
    matrix = spark.createDataFrame([(x.tolist(),) for x in at], "f array<int>")
    basis = _singular(matrix, idf, min(rank, len(passages), len(features)))
    weighted = (basis * idf[:, None]).astype(np.float32)
    latent = np.stack([weighted[x].sum(axis=0) for x in at])
    weights = np.maximum(np.linalg.norm(latent, axis=1), 1e-9)
    latent /= weights[:, None]
    return Index(ids, items, answers, keys, idf, weighted, np.ascontiguousarray(latent.T), weights, owner, _counts(items, features))


def _counts(items: list[list[int]], features: np.ndarray) -> np.ndarray | None:
    if len(features) * len(items) > MOST_COUNTS:
        return None
    counts = np.zeros((len(features), len(items)), np.float32)
    for k, words in enumerate(items):
        np.add.at(counts[:, k], np.searchsorted(features, np.array(words, np.uint64)), 1)
    return counts


def _able(index: Index, found: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For each word whether what the last step looks at around a window that starts there may hold enough words of some item.

    ``SHARED`` words of a row are looked at together. An item's longest common subsequence has at most those of its words that occur.
    """
    if index.counts is None:
        return np.ones(len(found), bool)
    able, sizes, reach = np.zeros(len(found), bool), np.diff(bounds), index.reach()
    n = (sizes + SHARED - 1) // SHARED
    row = np.repeat(np.arange(len(sizes)), n)
    start = bounds[:-1][row] + (np.arange(len(row)) - (np.cumsum(n) - n)[row]) * SHARED
    end = np.minimum(start + SHARED, bounds[1:][row])
    low, high = np.maximum(start - reach, bounds[:-1][row]), np.minimum(end + WINDOW + reach, bounds[1:][row])
    least = COMMON * np.array([max(len(x), 1) for x in index.items]) - 1e-6
    width, part = len(index.counts), max(1, 4_000_000 // (len(index.counts) + 1))
    for k in range(0, len(row), part):
        a, size = low[k : k + part], (high - low)[k : k + part]
        at = np.arange(size.sum()) + np.repeat(a - (np.cumsum(size) - size), size)
        held = np.zeros((len(a), width + 1), bool)
        held[np.repeat(np.arange(len(a)), size), found[at]] = True  # -1: the last column
        which, words = np.nonzero(held[:, :width])
        first = np.searchsorted(which, np.arange(len(a) + 1))
        for j in range(len(a)):
            some = words[first[j] : first[j + 1]]
            if len(some) and (index.counts[some].sum(axis=0) >= least).any():
                able[start[k + j] : end[k + j]] = True
    return able


def _singular(matrix: DataFrame, idf: np.ndarray, rank: int) -> np.ndarray:
    """Right singular vectors of the passages' matrix (rows of unit length), features x rank."""
    n = len(idf)
    y = np.random.default_rng(9).standard_normal((n, min(n, rank + OVERSAMPLED)))
    matrix = matrix.repartition(max(1, min(64, matrix.sparkSession.sparkContext.defaultParallelism)))

    def turned(y: np.ndarray) -> np.ndarray:
        shared = matrix.sparkSession.sparkContext.broadcast(y)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[int, np.ndarray] = {}
            for batch in batches:
                for x in batch.column(0):
                    where, tf = np.unique(np.asarray(x.values), return_counts=True)
                    w = tf * idf[where]
                    w = w / max(float(np.linalg.norm(w)), 1e-9)
                    out = w[:, None] * (w @ shared.value[where])[None]
                    for f, row in zip(where.tolist(), out):
                        total[f] = total[f] + row if f in total else row
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([r.tolist() for r in total.values()], pa.list_(pa.float64()))], ["f", "v"])

        out = np.zeros_like(y)
        for r in matrix.mapInArrow(run, "f int, v array<double>").toLocalIterator():
            out[r.f] += r.v
        return out

    for _ in range(TURNS):
        y = np.linalg.qr(turned(y))[0]
    values, vectors = np.linalg.eigh(y.T @ turned(y))
    return y @ vectors[:, np.argsort(-values)[:rank]]


def _features(column: pa.Array, keys: Keys) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """(word hashes, features that occur, their row, rows) for some rows at a time."""
    for _, _, data, at in chunks(column):
        raw = data.tobytes()
        words, bounds = hashed([raw[a:b].decode() for a, b in zip(at[:-1].tolist(), at[1:].tolist())])
        found = keys.get(words)
        rows = np.repeat(np.arange(len(at) - 1), np.diff(bounds))
        some = found >= 0
        yield words, found[some].astype(np.int64), rows[some], len(at) - 1


def _windows(near: set[tuple[int, int, int, int]], index: Index, found: np.ndarray, bounds: np.ndarray, able: np.ndarray, space: np.ndarray, width: int) -> None:
    """Adds (row, item, first word, width) of windows of ``width`` words, of those that start at ``able`` words, close to a passage of the item."""
    known = np.concatenate([[0], np.cumsum(found >= 0)])
    # windows: every few words, and the last one; a short text is one window
    step, counts = width // TEXT_STEPS, np.diff(bounds)
    made = np.where(counts > width, (counts - width + step - 1) // step + 1, np.minimum(counts, 1))
    rows = np.repeat(np.arange(len(counts)), made)
    first = np.cumsum(made) - made
    start = (np.arange(len(rows)) - first[rows]) * step
    start = bounds[:-1][rows] + np.minimum(start, np.maximum(counts[rows] - width, 0))
    end = np.minimum(start + width, bounds[1:][rows])
    some = np.flatnonzero(able[start] & (known[end] - known[start] >= np.minimum(KNOWN * (end - start), index.least()))) if len(start) else start
    padded = np.concatenate([found, np.full(width, -1, found.dtype)])
    for k in range(0, len(some), BLOCK):
        part = some[k : k + BLOCK]
        # windows that start a step apart share steps: each is summed once
        steps, of = np.unique(start[part][:, None] + step * np.arange(TEXT_STEPS), return_inverse=True)
        of = of.reshape(len(part), TEXT_STEPS)
        sums = space[padded[steps]]
        for j in range(1, step):
            sums += space[padded[steps + j]]
        latent = sums[of[:, 0]]
        for j in range(1, TEXT_STEPS):
            latent += sums[of[:, j]]
        for i in np.flatnonzero((end - start)[part] < width):  # a text shorter than a window
            latent[i] = space[padded[start[part[i]] : end[part[i]]]].sum(axis=0)
        # both lengths are taken in the latent space: what lies outside it (unknown words, dimensions beyond the rank) is the last step's to refuse
        length = np.sqrt(np.einsum("ij,ij->i", latent, latent))
        long = np.flatnonzero(length > 1e-6)
        if not len(long):
            continue
        latent, length = latent[long], length[long]
        for j in range(0, index.passages.shape[1], BLOCK):
            near_by = latent @ index.passages[:, j : j + BLOCK]
            i, p = np.nonzero(near_by >= np.maximum(COSINE * length[:, None], COVER * index.weights[j : j + BLOCK][None]))
            near.update(zip(rows[part[long[i]]].tolist(), index.owner[j + p].tolist(), start[part[long[i]]].tolist(), [width] * len(i)))


def _searched(texts: list[str], index: Index) -> list[dict[int, float]]:
    """For each text its items with their share of common words."""
    hits: list[dict[int, float]] = [{} for _ in texts]
    words, bounds = hashed(texts)
    if index.keys is None or not len(words):
        return hits
    found = index.keys.get(words)
    space = np.vstack([index.basis, np.zeros((1, index.basis.shape[1]), np.float32)])  # -1: no feature
    near: set[tuple[int, int, int, int]] = set()
    able = _able(index, found, bounds)
    for width in index.widths():
        _windows(near, index, found, bounds, able, space, width)
    vocabulary: dict[int, set[int]] = {}
    for row, item, at, width in sorted(near):
        wanted = index.items[item]
        margin = len(wanted) + min(WINDOW, len(wanted))
        a, b = max(int(bounds[row]), at - margin), min(int(bounds[row + 1]), at + width + margin)
        # words that the item doesn't have add nothing to a common subsequence
        wordy = vocabulary.setdefault(item, set(wanted))
        region = [w for w in words[a:b].tolist() if w in wordy]
        held = set(region)
        if sum(w in held for w in wanted) < COMMON * len(wanted):
            continue
        share = common_length(wanted, region) / len(wanted)
        answer = index.answers[item]
        if share >= COMMON and (not answer or share >= 0.8 or common_length(answer, region) >= ANSWER * len(answer)):
            hits[row][item] = max(share, hits[row].get(item, 0.0))
    return hits


def searched(docs: DataFrame, index: Index, text_col: str = "text") -> DataFrame:
    """``docs`` with ``contaminated`` boolean, ``item_ids`` array<long> in order and ``common`` double, the best share.

    Null and empty texts are clean, with no items and a share of 0. A benchmark's null texts and texts without a word match nothing; equal
    items are each reported. Columns of these names in ``docs`` are replaced. Whole texts are searched; repeated rows give repeated results, an empty table none.
    """
    small_batches(docs.sparkSession)
    docs = fresh(docs, "contaminated", "item_ids", "common")
    names = docs.columns
    where = names.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits: list[dict[int, float]] = []
            for _, _, data, at in chunks(batch.column(where)):
                raw = data.tobytes()
                hits += _searched([raw[a:b].decode() for a, b in zip(at[:-1].tolist(), at[1:].tolist())], shared.value)
            ids = [sorted({shared.value.ids[k] for k in h if shared.value.ids[k] is not None}) for h in hits]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([bool(h) for h in hits], pa.bool_()), pa.array(ids, pa.list_(pa.int64())), pa.array([max(h.values(), default=0.0) for h in hits], pa.float64())],
                [*names, "contaminated", "item_ids", "common"],
            )

    return docs.mapInArrow(run, widened(docs, contaminated="boolean", item_ids="array<long>", common="double"))
