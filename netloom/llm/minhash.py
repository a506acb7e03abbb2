"""MinHash near-duplicate detection by bottom-k sketches (operator 1).

One hash function orders the shingles of every document; its k smallest values are kept.

1. Documents with the same shingle set (copies) collapse to one node by a 128-bit fingerprint of the set, aggregated map-side.
2. Inverted lists of retained values generate overlaps. Two sets at or over the threshold share at least s of their ``listed``
   smallest values, so they share at least ``shared`` of the listed - s + shared values that are rarest in the corpus (prefix
   filter on sketches); only those enter the lists, and a passage that many documents share mostly stays out of them.
3. Stars: every member of a list meets the list's representative, the member with the fewest values of its own. Their number grows with the
   lists, and their links join most of a group of near copies.
4. All lists again, but only pairs whose ends are still in different components: a pair inside a component can't change it. Lists of at most
   ``list_limit`` documents give their pairs by a join. Longer ones are dealt into cells of a bounded number of shingles, a task compares
   the whole sets of two parts and returns a spanning forest of its links, so that its output grows with the documents. Both ways
   are complete: the limit decides where pairs are compared, not which.
5. The smallest values of the union of two sketches estimate the similarity; pairs far below the threshold go.
6. Exact Jaccard on the full shingle sets of the whole texts confirms every link. Components by alternating stars.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.llm.common import components, saved, small_batches
from netloom.llm.words import shingle_sets

#: Standard deviations by which a pair's overlap may fall short of its expectation.
SLACK = 4.5
#: Shingles of a part of a long list (8 bytes each); two parts meet in a task. A longer document is a part of its own.
CELL = 150_000
#: Documents of a side that are compared at a time (some 30 bytes a pair): short texts make many documents of few shingles.
SIDE = 1_000
#: Nodes whose ids may be broadcast (40 bytes each); more are joined by a shuffle.
BROADCAST_ROWS = 250_000
#: Representatives that a document is compared with first.
STARS = 3
#: Bits of a node's number; it comes from monotonically_increasing_id.
_BITS = 57


def least_overlap(n: int, k: int, threshold: float) -> int:
    """Retained values that a sketch of n values shares with any partner over the threshold."""
    if n < threshold * k:
        return max(1, math.ceil(threshold * n - 1e-9))
    return max(1, math.floor(threshold * n - SLACK * math.sqrt(threshold * (1 - threshold) * n)))


def _hashed(batches: Iterator[pa.RecordBatch], width: int, lower: bool, k: int | None) -> Iterator[pa.RecordBatch]:
    """(doc_id, n_shingles, set_key, values) of (doc_id, text): the k smallest hashes, or all."""
    for batch in batches:
        n, keys, flat, at = [], [], [], [0]
        for found in shingle_sets(batch.column(1), width, lower):
            n.append(len(found))
            keys.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None)
            flat.append(found[:k].view(np.int64))
            at.append(at[-1] + len(flat[-1]))
        values = pa.array(np.concatenate(flat) if flat else np.zeros(0, np.int64))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.ListArray.from_arrays(pa.array(at, pa.int32()), values)],
            ["doc_id", "n_shingles", "set_key", "sketch"],
        )


def sketches(docs: DataFrame, width: int, k: int | None, lower: bool = True) -> DataFrame:
    """(doc_id, n_shingles, set_key, sketch) of each row of (doc_id, text); without ``k`` the sketch is the whole set."""
    return docs.mapInArrow(lambda it: _hashed(it, width, lower, k), "doc_id long, n_shingles long, set_key binary, sketch array<long>")


def _table(column: str, most: int, value: Callable[[int], int]) -> Column:
    """``value`` of a number from 1 to ``most``."""
    return F.element_at(F.array(*[F.lit(value(n)) for n in range(1, most + 1)]), F.col(column))


def inverted(sets: DataFrame, listed: int, percent: int, shared: int) -> DataFrame:
    """(v, node, n, least, core): the rarest values of every node that another retains too.

    ``least``: how many of them a partner shares at least; ``core``: how many of its values others retain.
    """
    values = sets.select("node", F.explode(F.slice("sketch", 1, listed)).alias("v"))
    seen = values.groupBy("v").agg(F.count("*").alias("df")).where("df > 1")
    ranked = values.join(seen, "v").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("df", "v"))).alias("common"))
    # Values that one document alone retains are its rarest: they use up places but list nothing.
    held = sets.select("node", "n", F.least(F.size("sketch"), F.lit(listed)).alias("size"))
    places = _table("size", listed, lambda n: min(n, n - least_overlap(n, listed, percent / 100) + shared))
    return (
        ranked.join(held, "node")
        .withColumn("take", places - F.col("size") + F.size("common"))
        .withColumn("least", _table("size", listed, lambda n: min(shared, least_overlap(n, listed, percent / 100))))
        .where("take > 0")
        .select("node", "n", "least", F.size("common").alias("core"), F.explode(F.slice("common", F.lit(1), F.col("take"))).alias("c"))
        .select(F.col("c.v").alias("v"), "node", "n", "least", "core")
    )


def stars(lists: DataFrame) -> DataFrame:
    """(a, b): every node with the representatives of its lists that it meets most often."""
    low = (1 << _BITS) - 1
    # the largest core, then the least node, in one number
    key = F.shiftleft(F.least(F.col("core"), F.lit(63)).cast("long"), _BITS) + (F.lit(low) - F.col("node"))
    heads = lists.groupBy("v").agg(F.max(key).alias("key"), F.count("*").alias("size")).where("size > 1")
    heads = heads.select("v", (F.lit(low) - F.col("key").bitwiseAND(low)).alias("head"))
    met = lists.join(heads, "v").where("node <> head").groupBy("node").agg(F.collect_list("head").alias("heads"))
    best = F.expr(f"slice(array_sort(transform(array_distinct(heads), h -> struct(-size(filter(heads, x -> x = h)) AS c, h AS head))), 1, {STARS})")
    return met.select(F.col("node").alias("a"), F.explode(best).alias("m")).select("a", F.col("m.head").alias("b"))


def still_open(lists: DataFrame, found: DataFrame) -> DataFrame:
    """``lists`` with component c and the list's size and shingles, where a list has nodes of several components."""
    rows = lists.join(found.select("node", F.col("component").alias("c")), "node", "left").withColumn("c", F.coalesce("c", "node"))
    stats = rows.groupBy("v").agg(F.count("*").alias("size"), F.sum("n").alias("shingles"), F.min("c").alias("low"), F.max("c").alias("high")).where("low < high")
    return rows.join(stats.select("v", "size", "shingles"), "v")


def short_pairs(rows: DataFrame, percent: int, list_limit: int) -> DataFrame:
    """(a, b): pairs of different components that share enough values of short lists; one is enough if both stand in long lists too."""
    hot = rows.where(f"size > {list_limit}").select("node", F.lit(True).alias("hot")).distinct()
    rows = rows.where(f"size <= {list_limit}").join(hot, "node", "left")
    pairs = rows.alias("x").join(rows.alias("y"), "v").where(f"x.node < y.node AND x.c <> y.c AND 100 * least(x.n, y.n) >= {percent} * greatest(x.n, y.n)")
    wanted = F.when(F.col("x.hot") & F.col("y.hot"), 1).otherwise(F.least("x.least", "y.least"))
    return pairs.groupBy(F.col("x.node").alias("a"), F.col("y.node").alias("b")).agg(F.count("*").alias("c"), F.min(wanted).alias("wanted")).where("c >= wanted").select("a", "b")


def estimated(pairs: DataFrame, sets: DataFrame, k: int, percent: int) -> DataFrame:
    """(a, b, near): pairs whose union sketch doesn't rule the threshold out, with its estimate."""
    one = sets.select(F.col("node").alias("a"), F.col("n").alias("an"), F.col("sketch").alias("x"))
    other = sets.select(F.col("node").alias("b"), F.col("n").alias("bn"), F.col("sketch").alias("y"))
    # the order of retained values is unsigned: flip the sign bit to sort
    least = F.expr(f"slice(array_sort(transform(array_union(x, y), v -> v ^ shiftleft(1L, 63))), 1, {k})")
    both = F.expr("transform(array_intersect(x, y), v -> v ^ shiftleft(1L, 63))")
    threshold = percent / 100
    margin = threshold - SLACK * math.sqrt(threshold * (1 - threshold) / k)
    return (
        pairs.join(one, "a").join(other, "b").where(f"100 * least(an, bn) >= {percent} * greatest(an, bn)")
        .select("a", "b", least.alias("least"), both.alias("both"))
        .select("a", "b", (F.size(F.array_intersect("least", "both")) / F.size("least")).alias("near"))
        .where(F.col("near") >= margin)
    )


def confirmed(pairs: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose exact Jaccard similarity, in hundredths, is ``percent`` or more; ``full`` (node, shingles)."""
    both = pairs.join(full.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a").join(full.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
    both = both.select("a", "b", F.size("x").alias("an"), F.size("y").alias("bn"), F.size(F.array_intersect("x", "y")).alias("c"))
    return both.where(f"c > 0 AND 100L * c >= {percent}L * (an + bn - c)").select("a", "b")


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of sets of distinct values, left x right.

    Values in many sets are counted by matrix products, block by block, the others pair by pair.
    """
    n, m = len(left), len(right)
    out = np.zeros(n * m, np.float32)
    sizes = [len(s) for s in left], [len(s) for s in right]
    a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right))
    values = np.intersect1d(a, b)
    if not len(values):
        return out.reshape(n, m)
    at, df = [], []
    for flat, size in zip((a, b), sizes):
        where = np.minimum(np.searchsorted(values, flat), len(values) - 1)
        keep = values[where] == flat
        column, row = where[keep], np.repeat(np.arange(len(size)), size)[keep]
        order = np.argsort(column, kind="stable")
        at.append((column[order], row[order]))
        df.append(np.bincount(column, minlength=len(values)))
    work = df[0] * df[1]
    dense = work > n * m // 100
    starts = [np.concatenate([[0], np.cumsum(d)]) for d in df]
    # pair by pair: each occurrence on the left meets those on the right
    column, row = at[0]
    some = ~dense[column]
    column, row = column[some], row[some]
    total = np.concatenate([[0], np.cumsum(df[1][column])])
    first = 0
    while first < len(column):
        end = max(first + 1, int(np.searchsorted(total, total[first] + (1 << 21), "right")) - 1)
        many = df[1][column[first:end]]
        where = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(starts[1][column[first:end]], many)
        out += np.bincount(np.repeat(row[first:end], many) * m + at[1][1][where], minlength=n * m).astype(np.float32)
        first = end
    out = out.reshape(n, m)
    columns = np.flatnonzero(dense)
    for k in range(0, len(columns), 1024):
        part = columns[k : k + 1024]
        place = np.full(len(values), -1)
        place[part] = np.arange(len(part))
        sides = []
        for (column, row), size in zip(at, (n, m)):
            here = place[column] >= 0
            x = np.zeros((size, len(part)), np.float32)
            x[row[here], place[column[here]]] = 1
            sides.append(x)
        out += sides[0] @ sides[1].T
    return out


def _upto(sets: list[np.ndarray], bounds: np.ndarray) -> np.ndarray:
    """How many values of each set are within each bound."""
    return np.stack([np.searchsorted(s, bounds, "right") for s in sets])


def cell_links(nodes: np.ndarray, groups: np.ndarray, parts: np.ndarray, sets: list[np.ndarray], k: int, percent: int) -> list[tuple[int, int]]:
    """Links of two parts of a list (or inside one) that join their components: a spanning forest of them.

    ``sets``: sorted hashes (unsigned) of whole shingle sets. Their k smallest estimate a pair's similarity, as for other pairs.
    """
    low, high = parts.min(), parts.max()
    i, j = np.flatnonzero(parts == low), np.flatnonzero(parts == high)
    able = groups[i][:, None] != groups[j][None]
    if low == high:
        able &= np.arange(len(i))[:, None] < np.arange(len(j))[None]
    x, y = [sets[r] for r in i], [sets[r] for r in j]
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    small = [[s[:k] for s in side] for side in (x, y)]
    ends = [np.array([s[k - 1] if len(s) > k else top for s in side], np.uint64) for side in (x, y)]
    common = overlaps(*small)
    union = np.where(ends[0][:, None] <= ends[1][None], np.array([len(s) for s in small[0]])[:, None], _upto(small[0], ends[1]))
    union = union + np.where(ends[1][None] <= ends[0][:, None], np.array([len(s) for s in small[1]])[None], _upto(small[1], ends[0]).T) - common
    t = percent / 100
    margin = np.where((ends[0] == top)[:, None] & (ends[1] == top)[None], 0, SLACK * np.sqrt(t * (1 - t) / np.maximum(union, 1)))
    able &= common >= (t - margin - 1e-6) * union
    rows, columns = np.flatnonzero(able.any(axis=1)), np.flatnonzero(able.any(axis=0))
    if not len(rows):
        return []
    x, y = [x[r] for r in rows], [y[c] for c in columns]
    common = overlaps(x, y).astype(np.int64)
    both = np.array([len(s) for s in x])[:, None] + np.array([len(s) for s in y])[None] - common
    linked = able[np.ix_(rows, columns)] & (common > 0) & (100 * common >= percent * both)
    a, b = np.nonzero(linked)
    a, b = i[rows[a]], j[columns[b]]
    # one link for each two components is enough
    _, once = np.unique(np.stack([np.minimum(groups[a], groups[b]), np.maximum(groups[a], groups[b])]), axis=1, return_index=True)
    head: dict[int, int] = {}

    def find(g: int) -> int:
        while head.get(g, g) != g:
            head[g] = head.get(head[g], head[g])
            g = head[g]
        return g

    out = []
    for r, s in zip(a[once].tolist(), b[once].tolist()):
        p, q = find(int(groups[r])), find(int(groups[s]))
        if p != q:
            head[p] = q
            out.append((int(nodes[r]), int(nodes[s])))
    return out


def tiled_links(nodes: np.ndarray, groups: np.ndarray, parts: np.ndarray, sets: list[np.ndarray], k: int, percent: int) -> list[tuple[int, int]]:
    """``cell_links`` tile by tile, each of at most ``SIDE`` documents a side. What a tile has joined is one component for the next ones."""
    sides = [np.flatnonzero(parts == p) for p in np.unique(parts)]
    left, right = ([side[s : s + SIDE] for s in range(0, len(side), SIDE)] for side in (sides[0], sides[-1]))
    groups, out, head = groups.copy(), [], {}

    def find(g: int) -> int:
        while head.get(g, g) != g:
            g = head[g]
        return g

    where = dict(zip(nodes.tolist(), range(len(nodes))))
    for a, x in enumerate(left):
        for y in right[a if len(sides) == 1 else 0 :]:
            same = len(sides) == 1 and x[0] == y[0]
            rows = x if same else np.concatenate([x, y])
            made = cell_links(nodes[rows], groups[rows], np.zeros(len(rows), int) if same else np.repeat([0, 1], [len(x), len(y)]), [sets[r] for r in rows], k, percent)
            if made:
                out += made
                for p, q in made:
                    p, q = find(int(groups[where[p]])), find(int(groups[where[q]]))
                    if p != q:
                        head[p] = q
                names, at = np.unique(groups, return_inverse=True)
                groups = np.array([find(g) for g in names.tolist()], groups.dtype)[at]
    return out


def long_links(rows: DataFrame, full: DataFrame, k: int, percent: int, list_limit: int) -> DataFrame:
    """(a, b): exact links between components inside the long lists; each two parts of a list are a group of their own."""
    rows = rows.where(f"size > {list_limit}").withColumn("parts", F.expr(f"(shingles + {CELL - 1}) div {CELL}"))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("node"), "parts")).select("v", "node", "c", "part", F.explode(F.expr("sequence(0L, parts - 1)")).alias("other"))
    rows = rows.select(F.xxhash64("v", F.least("part", "other"), F.greatest("part", "other")).alias("cell"), "v", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"), "node", "c", "part")

    def run(table: pa.Table) -> pa.Table:
        column = table.column("shingles").combine_chunks()
        at, flat = column.offsets.to_numpy(), column.values.to_numpy().view(np.uint64)
        sets = [flat[a:b] for a, b in zip(at[:-1], at[1:])]
        nodes, groups, parts = (table.column(x).to_numpy() for x in ("node", "c", "part"))
        p, q = table.column("p")[0].as_py(), table.column("q")[0].as_py()
        out = tiled_links(nodes, groups, parts, sets, k, percent) if p == q or len(np.unique(parts)) == 2 else []
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([x for _, x in out], pa.int64())})

    return rows.join(full, "node").groupBy("cell", "v", "p", "q").applyInArrow(run, "a long, b long")


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 4,
    percent: int = 80,
    k: int = 64,
    listed: int = 32,
    shared: int = 3,
    list_limit: int = 48,
    lower: bool = True,
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``.

    A document's set holds its distinct ``width``-word shingles; a shorter text is one shingle. Null or empty
    texts, and texts of white space, have an empty set and are linked with nothing. Sets are linked at a Jaccard
    similarity of ``percent`` hundredths or more. ``component_id`` is the smallest id reachable, ``kept`` says
    that it is the row's own. A row with a null id gets its ``n_shingles``, no component and ``kept`` false.
    Rows that repeat an id are one document: each row is returned, and their links are united.
    Other columns of ``docs`` are ignored, whatever they are called. An empty table gives no row.
    """
    small_batches(docs.sparkSession)
    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    made = saved(sketches(source, width, k, lower).withColumn("row", F.monotonically_increasing_id()), "sketches")
    usable = made.where("doc_id IS NOT NULL AND n_shingles > 0")
    # a node is a shingle set: its number is that of a row, its texts are found by the least id
    nodes = saved(usable.groupBy("set_key").agg(F.min("row").alias("node"), F.min("doc_id").alias("low")), "nodes")
    sets = usable.join(nodes.select("node"), F.col("row") == F.col("node")).select("node", F.col("n_shingles").alias("n"), "sketch")
    lists = saved(inverted(sets, min(k, listed), percent, shared), "lists")

    def whole(needed: DataFrame) -> DataFrame:
        """(node, shingles): whole sets of the nodes, read from the texts again."""
        needed = saved(needed.distinct().join(nodes, "node"), "needed")
        few = needed.count() <= BROADCAST_ROWS
        ids = needed.select(F.col("low").alias("doc_id"))
        rows = source.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")
        rows = sketches(rows, width, None, lower).withColumnsRenamed({"sketch": "shingles", "doc_id": "low"})
        rows = rows.join(F.broadcast(needed) if few else needed, ["low", "set_key"]).select("node", "shingles")
        return saved(rows if unique else rows.dropDuplicates(["node"]), "whole")

    # Ids that repeat with different sets unite those sets, as do links.
    repeats = usable.groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1").select("doc_id")
    unique = repeats.isEmpty()
    links = None
    if not unique:
        same = usable.join(repeats, "doc_id").join(nodes, "set_key").select("doc_id", "node").distinct()
        links = same.join(same.groupBy("doc_id").agg(F.min("node").alias("b")), "doc_id").select(F.col("node").alias("a"), "b").where("a <> b")

    pairs = estimated(stars(lists), sets, k, percent)
    pairs = saved(pairs.groupBy("a").agg(F.max_by("b", "near").alias("b")), "pairs")
    first = saved(confirmed(pairs, whole(pairs.select(F.explode(F.array("a", "b")).alias("node"))), percent), "links")
    links = first if links is None else links.unionAll(first)
    found = components(links)

    rows = saved(still_open(lists, found), "open")
    pairs = saved(estimated(short_pairs(rows, percent, list_limit), sets, k, percent).select("a", "b"), "pairs")
    full = whole(pairs.select(F.explode(F.array("a", "b")).alias("node")).unionAll(rows.where(f"size > {list_limit}").select("node")))
    more = saved(confirmed(pairs, full, percent).unionAll(long_links(rows, full, k, percent, list_limit)), "links")
    if not more.isEmpty():
        found = components(links.unionAll(more))

    heads = found.select(F.col("component").alias("node"), "component").distinct()
    roots = found.select("node", "component").unionAll(heads).join(nodes.select("node", "low"), "node")
    roots = roots.join(roots.groupBy("component").agg(F.min("low").alias("least")), "component").select("node", "least")
    return (
        made.select("doc_id", "n_shingles", "set_key").join(nodes.join(roots, "node", "left").select("set_key", F.coalesce("least", "low").alias("least")), "set_key", "left")
        .withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id")))
        .select("doc_id", "n_shingles", "component_id", F.coalesce(F.expr("doc_id = component_id"), F.lit(False)).alias("kept"))
    )


def deduplicated(docs: DataFrame, **options: object) -> DataFrame:
    """``docs`` without the rows of each group but one, columns as they were.

    Of rows that repeat an id one stays. A row with a null id is compared under a number from its text, above ordinary ids, so a row with an id
    stays before it; of null-id rows with equal texts one stays, and those without a word are linked with nothing and all stay.
    """
    id_col, text_col = (str(options.pop(name, default)) for name, default in (("id_col", "doc_id"), ("text_col", "text")))
    given, text = F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`")
    wordy = F.coalesce(text.rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    own = F.coalesce(given, F.xxhash64(text).bitwiseAND((1 << 62) - 1).bitwiseOR(1 << 62))
    found = near_duplicates(docs.select(own.alias("doc_id"), text.alias("text")), **options)
    found = saved(found.groupBy("doc_id").agg(F.bool_or("kept").alias("kept"), F.count("*").alias("__copies")).withColumnRenamed("doc_id", "__kept_id"), "kept")

    def few(ids: DataFrame) -> DataFrame:
        return F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids

    # few rows go or repeat, so their ids are what texts are joined with
    mine = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.withColumn("__own_id", own).join(few(found.where("NOT kept").select(F.col("__kept_id").alias("__own_id"))), "__own_id", "left_anti")
    repeated = found.where("kept AND __copies > 1").select(F.col("__kept_id").alias("__own_id"), F.lit(True).alias("__repeated"))
    if repeated.isEmpty():
        return rows.select(*mine)
    rows = rows.join(few(repeated), "__own_id", "left")
    # rows that stand alone, and those without a word or id, aren't compared further
    alone = F.col("__repeated").isNull() | (given.isNull() & ~wordy)
    # texts are compared too where there is no id, so that no two texts are taken for one by their number
    return rows.where(alone).select(*mine).unionAll(rows.where(~alone).withColumn("__text", F.when(given.isNull(), text)).dropDuplicates(["__own_id", "__text"]).select(*mine))
