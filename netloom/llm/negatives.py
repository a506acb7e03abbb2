"""Hard-negative mining by ball trees (operator 13).

Rows are dealt to blocks, and each block gets a ball tree: nodes with a centre, a radius and the range of their labels. Anchors are dealt to blocks
too, and a task takes one block of either side, so the anchors are a stated query set that meets all rows block by block.
Branch and bound: the inner product of an anchor with any point of a ball lies between q.c - |q| r and q.c + |q| r. A node goes if all of that is outside
the score window, if it is strictly beneath the anchor's current k-th score (an equal score may still win by its id), or if no label in it counts.
Leaves are visited by falling upper bounds, their scores worked out exactly. Each block returns the first k of an anchor, and the first k of those are the result.

Two passes over the same trees: the anchors' positives, then the negatives inside the window that each positive's score gives.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from netloom.llm.common import saved

#: Most rows of a block (8 bytes a component), and fewest where there are cores for more blocks.
BLOCK, SMALL = 65_536, 2_048
#: Anchors of a block.
ANCHORS = 16_384
#: Points of a leaf, and queries searched at a time.
LEAF, QUERIES = 64, 1_024
#: Components beyond this magnitude, after rounding, could let hundredfold scores of 2,048 components leave a long.
LARGEST = 1 << 22
_LOWEST = -(1 << 62)


def build(points: np.ndarray, labels: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """(order of the points, nodes by number): a node holds order[start:end] and, unless it is a leaf, has children ``left`` and left + 1."""
    x = points.astype(float)
    order = np.arange(len(x))
    start, end, left, center, radius, low, high = [0], [len(x)], [], [], [], [], []
    at = 0
    while at < len(start):
        s, e = start[at], end[at]
        mine = order[s:e]
        p = x[mine]
        c = p.mean(axis=0) if len(p) else np.zeros(x.shape[1])
        far = ((p - c) ** 2).sum(axis=1)
        center.append(c)
        radius.append(math.sqrt(far.max()) if len(p) else 0.0)
        low.append(labels[mine].min() if len(p) else 0)
        high.append(labels[mine].max() if len(p) else -1)
        if e - s <= leaf:
            left.append(-1)
        else:
            a = p[far.argmax()]
            b = p[((p - a) ** 2).sum(axis=1).argmax()]
            middle = (e - s) // 2
            order[s:e] = mine[np.argpartition(p @ (b - a), middle)]
            left.append(len(start))
            start += [s, s + middle]
            end += [s + middle, e]
        at += 1
    kinds = (("start", start, np.int64), ("end", end, np.int64), ("left", left, np.int64), ("radius", radius, float), ("low", low, np.int64), ("high", high, np.int64))
    return order, {name: np.array(v, kind) for name, v, kind in kinds} | {"center": np.array(center, float).reshape(len(start), -1)}


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of integer rows: by floats where they are exact, else by integers."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(a.shape[1], 1)
    return np.rint(a.astype(float) @ b.astype(float).T).astype(np.int64) if most < 2**53 else a @ b.T


def search(tree: dict[str, np.ndarray], points: np.ndarray, ids: np.ndarray, labels: np.ndarray, queries: dict[str, np.ndarray], k: int, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, score): the first ``k`` of each query's rows by falling score, then id; ``points``, ``ids``, ``labels`` in the tree's order.

    ``queries``: point, id, label, lo and hi, the window of scores. With ``same`` rows of the query's label but not of its id count, else those of other labels.
    """
    q, lo, hi, mine = queries["point"], queries["lo"], queries["hi"], queries["label"]
    norm = np.sqrt((q.astype(float) ** 2).sum(axis=1))
    best = np.full((len(q), k), _LOWEST, np.int64)
    best_id = np.full((len(q), k), np.iinfo(np.int64).max, np.int64)
    floor = lo.copy()  # the least score that can still enter

    def bounds(rows: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        middle = q[rows].astype(float) @ tree["center"][nodes].T
        size = np.sqrt((tree["center"][nodes] ** 2).sum(axis=1)) + tree["radius"][nodes]
        slack = norm[rows][:, None] * (tree["radius"][nodes] + 1e-9 * size)[None] + 1e-6
        return middle - slack, middle + slack

    def able(rows: np.ndarray, nodes: np.ndarray, least: np.ndarray, most: np.ndarray) -> np.ndarray:
        low, high, label = tree["low"][nodes][None], tree["high"][nodes][None], mine[rows][:, None]
        counts = (low <= label) & (label <= high) if same else (low != label) | (high != label)
        return counts & (most >= floor[rows][:, None]) & (least <= hi[rows][:, None])

    rows = np.arange(len(q))
    level, alive = np.zeros(1, np.int64), np.ones((len(q), 1), bool)
    leaves, reach = [], []
    while len(level) and len(q):
        least, most = bounds(rows, level)
        alive &= able(rows, level, least, most)
        ends = tree["left"][level] < 0
        leaves.append(level[ends])
        reach.append(np.where(alive, most, -np.inf)[:, ends])
        inner = np.flatnonzero(~ends & alive.any(axis=0))
        level = np.stack([tree["left"][level[inner]], tree["left"][level[inner]] + 1], axis=1).ravel()
        alive = np.repeat(alive[:, inner], 2, axis=1)
    if leaves:
        nodes, most = np.concatenate(leaves), np.concatenate(reach, axis=1)
        # every query's most promising leaf first, then leaf by leaf, so that most are beneath the k-th score when their turn comes
        visits = [(int(n), np.flatnonzero(most.argmax(axis=1) == n)) for n in np.unique(most.argmax(axis=1))] if most.shape[1] else []
        visits += [(int(n), None) for n in np.argsort(-most.max(axis=0, initial=-np.inf), kind="stable")]
        for n, some in visits:
            some = np.flatnonzero((most[:, n] >= floor) & np.isfinite(most[:, n])) if some is None else some[np.isfinite(most[some, n])]
            if not len(some):
                continue
            most[some, n] = -np.inf
            s, e = tree["start"][nodes[n]], tree["end"][nodes[n]]
            score = exact(q[some], points[s:e])
            fits = (labels[s:e][None] == mine[some][:, None]) == same
            if same:
                fits &= ids[s:e][None] != queries["id"][some][:, None]
            fits &= (score >= floor[some][:, None]) & (score <= hi[some][:, None])
            hit = np.flatnonzero(fits.any(axis=1))
            if not len(hit):
                continue
            at = some[hit]
            scores = np.concatenate([best[at], np.where(fits[hit], score[hit], _LOWEST)], axis=1)
            names = np.concatenate([best_id[at], np.where(fits[hit], ids[s:e][None], np.iinfo(np.int64).max)], axis=1)
            first = np.lexsort((names, -scores), axis=-1)[:, :k]
            best[at], best_id[at] = np.take_along_axis(scores, first, 1), np.take_along_axis(names, first, 1)
            floor[at] = np.maximum(lo[at], best[at, k - 1])
    query, place = np.nonzero(best > _LOWEST)
    return query, best_id[query, place], best[query, place]


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of a list column, filled up with zeros to ``width``."""
    lists = column.combine_chunks()
    at = lists.offsets.to_numpy().astype(np.int64)
    flat = lists.values.to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(lists), width), np.int64)
    size = np.diff(at)
    row = np.repeat(np.arange(len(lists)), size)
    out[row, np.arange(len(row)) - np.repeat(at[:-1] - at[0], size)] = flat[at[0] : at[-1]]
    return out


def trees(rows: DataFrame, blocks: int) -> DataFrame:
    """(block, width, and a tree's arrays) for the rows (vec_id, label, point), a row a block."""
    names = ("start", "end", "left", "low", "high")

    def run(table: pa.Table) -> pa.Table:
        width = max((len(p) for p in table.column("point")), default=0)
        points, labels = _matrix(table.column("point"), width), table.column("label").to_numpy()
        order, tree = build(points, labels)
        ints = {"vec_id": table.column("vec_id").to_numpy()[order], "label": labels[order], "point": points[order].ravel(), **{n: tree[n] for n in names}}
        floats = {"radius": tree["radius"], "center": tree["center"].ravel()}
        made = {"block": pa.array([table.column("block")[0].as_py()], pa.int32()), "width": pa.array([width], pa.int32())}
        made |= {n: pa.array([v], pa.list_(pa.int64())) for n, v in ints.items()} | {n: pa.array([v], pa.list_(pa.float64())) for n, v in floats.items()}
        return pa.table(made)

    fields = [f"{n} array<long>" for n in ("vec_id", "label", "point", *names)] + ["radius array<double>", "center array<double>"]
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
    return dealt.groupBy("block").applyInArrow(run, "block int, width int, " + ", ".join(fields))


def first_rows(made: DataFrame, asked: DataFrame, blocks: int, parts: int, k: int, same: bool) -> DataFrame:
    """(query, vec_id, score): candidates of each block, at most ``k`` a query.

    ``asked`` (query, vec_id, label, point, lo, hi), dealt by ``query`` to ``parts``. A cell, a tree and a part of the queries, is a group of its own.
    """
    left = made.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    right = asked.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def run(table: pa.Table, rows: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64),) * 3]
        if table.num_rows and rows.num_rows:
            one = {c: table.column(c)[0] for c in table.column_names}
            array = {c: v.values.to_numpy() for c, v in one.items() if pa.types.is_list(v.type)}
            most = max(one["width"].as_py(), max(len(p) for p in rows.column("point")))
            widen = lambda flat, n: np.pad(flat.reshape(n, one["width"].as_py()), ((0, 0), (0, most - one["width"].as_py())))
            points, tree = widen(array["point"], len(array["vec_id"])), {**array, "center": widen(array["center"], len(array["start"]))}
            for s in range(0, rows.num_rows, QUERIES):
                some = rows.slice(s, QUERIES)
                asks = {"point": _matrix(some.column("point"), most)} | {c: some.column(n).to_numpy() for c, n in (("id", "vec_id"), ("label", "label"), ("lo", "lo"), ("hi", "hi"))}
                query, ids, scores = search(tree, points, array["vec_id"], array["label"], asks, k, same)
                out.append((some.column("query").to_numpy()[query], ids, scores))
        return pa.table({n: pa.array(np.concatenate(v)) for n, v in zip(("query", "vec_id", "score"), zip(*out))})

    return left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInArrow(run, "query long, vec_id long, score long")


def usable(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = 256) -> DataFrame:
    """(vec_id, label, point): rows that take part, each component x as floor(scale * x).

    Rows with a null id, label or vector, or with a null, non-finite or huge component (``LARGEST``) are left out. Of rows that repeat an id one takes part, that of
    the least label, then point. Vectors of different lengths count as filled up with zeros. Other columns are ignored.
    """
    v = F.col(f"`{vector_col}`")
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) * scale <= LARGEST))
    made = rows.where(v.isNotNull() & F.col(f"`{label_col}`").isNotNull() & F.col(f"`{id_col}`").isNotNull() & whole)
    made = made.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{label_col}`").cast("long").alias("label"), F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("point"))
    return made.groupBy("vec_id").agg(F.min(F.struct("label", "point")).alias("m")).select("vec_id", "m.label", "m.point")


def hard_negatives(rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of the rows (vec_id, label, point) of :func:`usable`.

    A row's score is its inner product with the anchor's; higher scores come first, ties by smaller id. For every row that meets ``anchor`` and each of its first
    ``positives`` other rows of the same label: the first ``negatives`` rows of another label with low * positive_score <= 100 * negative_score <= high *
    positive_score, fewer if there are no more. A pair without any has no row; an empty table has none.
    """
    spark = rows.sparkSession
    rows = saved(rows, "points")
    n, asked = rows.agg(F.count("*"), F.count(F.when(anchor, 1))).first()
    blocks = max(1, -(-n // BLOCK), min(spark.sparkContext.defaultParallelism, -(-n // SMALL)))
    made = saved(trees(rows, blocks), "trees")

    def ranked(found: DataFrame, k: int) -> DataFrame:
        order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    anchors = rows.where(anchor)
    every = anchors.select(F.col("vec_id").alias("query"), "vec_id", "label", "point", F.lit(_LOWEST + 1).alias("lo"), F.lit(-_LOWEST).alias("hi"))
    near = ranked(first_rows(made, every, blocks, max(1, -(-asked // ANCHORS)), positives, True), positives)
    near = saved(near.select(F.col("query").alias("anchor_id"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")).withColumn("query", F.monotonically_increasing_id()), "positives")
    # the window in whole numbers; no score lies in that of a negative one
    window = near.where("positive_score >= 0").select("query", "anchor_id", F.expr(f"(positive_score * {low} + 99) div 100").alias("lo"), F.expr(f"(positive_score * {high}) div 100").alias("hi"))
    asks = window.join(anchors, window["anchor_id"] == anchors["vec_id"]).select("query", "vec_id", "label", "point", "lo", "hi")
    found = ranked(first_rows(made, asks, blocks, max(1, -(-asked * positives // ANCHORS)), negatives, False), negatives)
    found = found.select("query", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return near.join(found, "query").select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def labelled(rows: DataFrame) -> DataFrame:
    """The embeddings with the labels that the query searches: those of ids divisible by 7 go one on."""
    return rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))


def table_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labelled(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label"))
    return hard_negatives(usable(rows), F.col("vec_id") % 100 == 0)
