"""SimHash near-duplicate detection over an inverted index of byte positions (operator 11).

1. A 64-bit fingerprint a text: a bit is set if it is set in over half of the hashes of its shingles, repeats included. Texts of one fingerprint
   are one node.
2. Two fingerprints that differ in at most ``bits`` bits differ in at most so many of their 8 bytes: they share at least ``8 - bits`` of them in place.
   Lists of single bytes would hold a 256th of all nodes each, so a list's key is three bytes at their positions. The position triples are a Turán
   system: every choice of four positions holds one of them, so no pair that shares four bytes is missed, with 20 lists a node.
3. Count filtering: within a list the bytes that a pair shares are tallied over all positions; pairs that reach the guaranteed minimum are kept,
   and verified by their differing bits.
4. A list gives a spanning forest of its links, fewer rows than it has members. A search from a node compares it with what no search has reached, so that a
   group of near copies costs little more than its size. Lists beyond ``PART`` members are dealt to parts, each two of which meet in a group of their own.
5. Components by alternating stars.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.llm.common import components, saved, small_batches
from netloom.llm.words import LOWER, chunks

#: Members of a list that one group compares; a pair of parts has twice as many, 16 bytes each.
PART = 65_536
#: Lists up to this size are compared all together, by their distance in the list.
SHORT = 8
#: Shingles hashed at a time.
PIECE = 1 << 16
_LOWER = LOWER.tobytes()
_LOW7, _HIGH = np.uint64(0x7F7F7F7F7F7F7F7F), np.uint64(0x8080808080808080)


def shingle_hashes(text: bytes, width: int, seed: int) -> Iterator[np.ndarray]:
    """XXH64 of each ``width``-word shingle of a text, words joined by a blank; of the whole sequence if it is shorter."""
    words = text.translate(_LOWER).split()
    joined = b" ".join(words)
    if 0 < len(words) < width:
        yield np.array([xxhash.xxh64_intdigest(joined, seed)], np.uint64)
        return
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    starts, ends = (ends - size)[: len(words) - width + 1], ends[width - 1 :]
    digest = xxhash.xxh64_intdigest
    for k in range(0, len(ends), PIECE):
        yield np.array([digest(joined[a:b], seed) for a, b in zip(starts[k : k + PIECE].tolist(), ends[k : k + PIECE].tolist())], np.uint64)


def fingerprint(text: bytes, width: int = 4, seed: int = 42) -> int:
    """The 64-bit fingerprint of a text, as a signed number; 0 without a word."""
    counts, n = np.zeros(64, np.int64), 0
    for hashes in shingle_hashes(text, width, seed):
        counts += np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(hashes)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, width: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fp) of each row of (doc_id, text); a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for _, _, data, at in chunks(batch.column(1)):
                whole = data.tobytes()
                made += [fingerprint(whole[a:b], width, seed) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.int64())], ["doc_id", "fp"])

    return docs.mapInArrow(run, "doc_id long, fp long")


def covers(least: int) -> list[tuple[int, ...]]:
    """Position sets, one of which lies in every choice of ``least`` of the 8 positions.

    From four on the triples of Turán's construction over three groups: those inside a group, and those with two in a group and one in the next.
    """
    if least < 4:
        return list(combinations(range(8), least))
    group = [0, 0, 0, 1, 1, 1, 2, 2]
    return [t for t in combinations(range(8), 3) if any(sorted((group[p] - g) % 3 for p in t) in ([0, 0, 0], [0, 0, 1]) for g in range(3))]


def shared_bytes(x: np.ndarray) -> np.ndarray:
    """How many bytes of a pair are equal in place, from the pair's exclusive or."""
    return 8 - np.bitwise_count((((x & _LOW7) + _LOW7) | x) & _HIGH).astype(np.int64)


def near(x: np.ndarray, bits: int) -> np.ndarray:
    """Where pairs, given by their exclusive or, share enough bytes in place and differ in few enough bits."""
    kept = np.flatnonzero(shared_bytes(x) >= 8 - bits)
    return kept[np.bitwise_count(x[kept]) <= bits]


def forest(nodes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among ``nodes``: a node is compared with those that no search has reached yet."""
    rest, a, b = nodes, [], []
    while len(rest):
        queue, rest = [rest[:1]], rest[1:]
        while queue and len(rest):
            front = queue.pop()
            for k in range(len(front)):
                found = near(rest ^ front[k], bits)
                if len(found):
                    a.append(np.repeat(front[k], len(found)))
                    b.append(rest[found])
                    queue.append(rest[found])
                    rest = np.delete(rest, found)
                    if not len(rest):
                        break
    none = np.zeros(0, np.uint64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def list_links(keys: np.ndarray, nodes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(a, b): links of lists, which stand one after the other by key."""
    cuts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]]))
    size = np.repeat(np.diff(cuts), np.diff(cuts))
    a, b = [], []
    short = (size > 1) & (size <= SHORT)
    for lag in range(1, SHORT):
        at = np.flatnonzero(short[:-lag] & (keys[:-lag] == keys[lag:])) if lag < len(keys) else np.zeros(0, np.int64)
        at = at[near(nodes[at] ^ nodes[at + lag], bits)]
        a.append(nodes[at])
        b.append(nodes[at + lag])
    for k in np.flatnonzero(np.diff(cuts) > SHORT):
        x, y = forest(nodes[cuts[k] : cuts[k + 1]], bits)
        a.append(x)
        b.append(y)
    return np.concatenate(a), np.concatenate(b)


def _sorted_lists(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """Links of (key, fp) sorted by key; a list that a batch cuts is carried to the next."""
    keys, nodes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]

    def made(end: int | None) -> pa.RecordBatch:
        k, n = np.concatenate(keys), np.concatenate(nodes)
        end = len(k) if end is None else end
        keys[:], nodes[:] = [k[end:]], [n[end:]]
        a, b = list_links(k[:end], n[:end], bits) if end else (n[:0], n[:0])
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        k = batch.column(0).to_numpy()
        first = int(np.searchsorted(k, k[-1]))
        held = sum(map(len, keys))
        cut = first if first or not held else (0 if keys[-1][-1] == k[-1] else None)
        keys.append(k)
        nodes.append(batch.column(1).to_numpy().view(np.uint64))
        if cut is None:
            yield made(held)
        elif first:
            yield made(held + first)
    yield made(None)


def links(nodes: DataFrame, bits: int) -> DataFrame:
    """(a, b): links of (fp) that connect what is connected at ``bits`` differing bits or fewer."""
    made = []
    for k, positions in enumerate(covers(8 - bits)):
        key = F.lit(k).cast("long")
        for p in positions:
            key = F.shiftleft(key, 8).bitwiseOR(F.shiftrightunsigned("fp", 8 * p).bitwiseAND(255))
        made.append(key)
    index = nodes.select("fp", F.explode(F.array(*made)).alias("key"))
    parts = F.expr(f"(size + {PART - 1}) div {PART}")
    long = saved(index.groupBy("key").agg(F.count("*").alias("size")).where(f"size > {PART}").select("key", parts.alias("parts")), "long-lists")
    if not long.isEmpty():
        index = index.join(long, "key", "left").withColumn("part", F.pmod(F.xxhash64("fp"), "parts"))
        others = F.expr("CASE WHEN parts IS NULL THEN array(NULL) ELSE filter(sequence(0L, parts - 1), o -> o <> part) END")
        index = index.withColumn("other", F.explode(others))
        cell = F.when(F.col("other").isNull(), F.xxhash64("key")).otherwise(F.xxhash64("key", F.least("part", "other"), F.greatest("part", "other")))
        index = index.select("fp", cell.alias("key"))
    rows = index.select("key", "fp").repartition("key").sortWithinPartitions("key")
    return rows.mapInArrow(lambda it: _sorted_lists(it, bits), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, bits: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs``.

    Words are lower-cased in A-Z; a text of fewer than ``width`` words is one shingle, one without words (null, empty, white space) has the fingerprint
    zero, which is linked like any other. ``fingerprint`` has 16 lowercase hex digits. ``component_id`` is the smallest id reachable. A row with a null id has
    no component and links nothing. Rows that repeat an id are one document: each row is returned with its own fingerprint, their links are united.
    Other columns of ``docs`` are ignored, whatever they are called. An empty table gives no row.
    """
    if not 0 <= bits <= 7:
        raise ValueError("bits must be 0 to 7: beyond that two fingerprints need not share a byte")
    small_batches(docs.sparkSession)
    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    made = saved(fingerprints(source, width, seed), "fingerprints")
    usable = made.where("doc_id IS NOT NULL")
    nodes = saved(usable.groupBy("fp").agg(F.min("doc_id").alias("low")), "nodes")
    found = links(nodes.select("fp"), bits)
    repeats = usable.groupBy("doc_id").agg(F.min("fp").alias("a"), F.max("fp").alias("b")).where("a <> b").select("doc_id", "a")
    found = found.unionAll(usable.join(repeats, "doc_id").select("a", F.col("fp").alias("b")).where("a <> b"))
    found = components(saved(found.distinct(), "links"))
    heads = found.select(F.col("component").alias("node"), "component").distinct()
    roots = found.select("node", "component").unionAll(heads).join(nodes.select(F.col("fp").alias("node"), "low"), "node")
    roots = roots.join(roots.groupBy("component").agg(F.min("low").alias("least")), "component").select("node", "least")
    reached = nodes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("least", "low").alias("least"))
    component = F.when(F.col("doc_id").isNotNull(), F.col("least"))
    return made.join(reached, "fp", "left").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), component.alias("component_id"))
