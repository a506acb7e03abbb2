"""Trees: ancestors come from path prefixes (one explode) or from parent ids, never from a recursive query."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from netloom.operators.lookup import best_kind
from netloom.operators.store import planned, saved

#: Levels after which a walk upwards looks for pairs that it has met before.
DEEP = 32
#: Ids that share all but their last bits (2**BLOCK of them) are followed inside one task before any join.
BLOCK = 16
#: Rows that a task follows at once, and a block more.
CHUNK = 200_000


def _by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by ``block`` in chunks that no block is cut by."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) < CHUNK:
            continue
        rows = pa.Table.from_batches(held)
        block = rows["block"].to_numpy()
        cut = int(np.searchsorted(block, block[-1]))
        if cut:
            yield rows.slice(0, cut).combine_chunks()
            held = rows.slice(cut).combine_chunks().to_batches()
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _flat(column: pa.ChunkedArray | pa.Array) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def _ends(to: np.ndarray) -> np.ndarray:
    """Where each row's way ends if a row leads on to row ``to``, -1 for the last; somewhere on the way if that is a cycle."""
    at = np.where(to < 0, np.arange(len(to)), to)
    for _ in range(len(to).bit_length()):
        further = at[at]
        if np.array_equal(further, at):
            break
        at = further
    return at


def _shortened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (block, up, next, mark, hit, ...) as far as they lead inside a chunk: (up, next, done, hit, ...); rows with ``mark`` only name ids that are hits."""
    for rows in _by_block(batches):
        marks = _flat(rows.filter(rows["mark"])["up"])
        rows = rows.filter(pc.invert(rows["mark"]))
        up, hit = _flat(rows["up"]), _flat(rows["hit"])
        hit = pc.or_(hit, pc.is_in(up, value_set=marks))
        following = pc.if_else(hit, up, _flat(rows["next"]))
        done = pc.or_(hit, pc.is_null(following))
        to = pc.index_in(following, value_set=up).fill_null(-1).to_numpy(zero_copy_only=False)
        at = pa.array(_ends(np.where(done.to_numpy(zero_copy_only=False), -1, to)))
        more = {c: rows[c] for c in rows.column_names if c not in ("block", "up", "next", "mark", "hit")}
        yield from pa.table({"up": up, "next": following.take(at), "done": done.take(at), "hit": hit.take(at), **more}).to_batches(max_chunksize=10_000)


def _climbed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Boxes (block, box, ancestor) with all that they lie under inside a chunk, themselves included, as (box, ancestor, onwards); ``onwards``: that ancestor's own way lies elsewhere."""
    for rows in _by_block(batches):
        box, up = _flat(rows["box"]), _flat(rows["ancestor"])
        to = pc.index_in(up, value_set=box).fill_null(-1).to_numpy(zero_copy_only=False)
        to = np.where(to[_ends(to)] < 0, to, -1)  # a cycle, and what leads into one, is left to the joins
        out = up.is_valid().to_numpy(zero_copy_only=False) & (to < 0)
        who = at = np.arange(len(to))
        while len(who):
            gone = out[at]
            for mine, above, onwards in ((box.take(pa.array(who)), box.take(pa.array(at)), False), (box.take(pa.array(who[gone])), up.take(pa.array(at[gone])), True)):
                yield from pa.table({"box": mine, "ancestor": above, "onwards": pa.array(np.full(len(mine), onwards))}).to_batches(max_chunksize=10_000)
            more = to[at] >= 0
            who, at = who[more], to[at[more]]


def _astride(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids of nodes (block, id, parent, mark) whose tree leads out of the chunk, has a node that is marked, or is a cycle."""
    for rows in _by_block(batches):
        marks = _flat(rows.filter(rows["mark"])["id"])
        rows = rows.filter(pc.invert(rows["mark"]))
        ids, up = _flat(rows["id"]), _flat(rows["parent"])
        to = pc.index_in(up, value_set=ids).fill_null(-1).to_numpy(zero_copy_only=False)
        top = _ends(to)
        far = np.zeros(len(to), bool)
        far[top[(up.is_valid().to_numpy(zero_copy_only=False) & (to < 0)) | pc.is_in(ids, value_set=marks).to_numpy(zero_copy_only=False)]] = True
        yield from pa.table({"id": ids.filter(pa.array(far[top] | (to[top] >= 0)))}).to_batches(max_chunksize=10_000)


def block_of(column: str) -> Column:
    return F.shiftright(column, BLOCK).cast("long")


def by_blocks(nodes: DataFrame, boxes: DataFrame) -> DataFrame:
    """nodes (id, parent, ...) and marks of boxes (id), in one exchange: (block, id, parent, mark, ...), the rows of a block together, for a function over :func:`_by_block`."""
    rows = nodes.select(block_of("id").alias("block"), "id", "parent", F.lit(False).alias("mark"), *[c for c in nodes.columns if c not in ("id", "parent")])
    marks = boxes.select(block_of("id").alias("block"), "id", F.lit(True).alias("mark"))
    return rows.unionByName(marks, allowMissingColumns=True).repartition("block").sortWithinPartitions("block")


def astride(nodes: DataFrame) -> DataFrame | None:
    """(id): nodes (id, parent) of trees that don't lie in one block of neighbouring ids; none if there are no such trees. All of a tree is in it, or nothing."""
    over = nodes.where(block_of("id") != block_of("parent"))
    if over.isEmpty():
        return None
    return saved(by_blocks(nodes.select("id", "parent"), over.select(F.col("parent").alias("id"))).mapInArrow(_astride, "id long"), "astride")


def upwards(to: np.ndarray, box: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(near, up): the row of the nearest box that a row is or lies under, and for a box that of the next one above it; -1 for none. ``to``: the row of the parent."""
    end = _ends(np.where(box, -1, to))
    near = np.where(box[end], end, -1) if len(to) else end
    return near, np.where(box & (to >= 0), near[to], -1)


def climbed(up: np.ndarray, at: np.ndarray, what: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(box, what), each once: pairs of a box's row and a number with all boxes above, from the lowest boxes to the top, so that pairs that meet on the way go on as one."""
    ring = up[_ends(up)] >= 0
    if ring.any():
        # on a cycle, and below one, each pair goes on until it meets another's way
        met = set()
        for box, value in zip(at[ring[at]].tolist(), what[ring[at]].tolist()):
            while box >= 0 and (box, value) not in met:
                met.add((box, value))
                box = int(up[box])
        yield tuple(np.array(sorted(met), np.int64).reshape(-1, 2).T)
        at, what, up = at[~ring[at]], what[~ring[at]], np.where(ring, -1, up)
    depth, over = (up >= 0).astype(np.int64), up
    while (over >= 0).any():
        depth, over = depth + np.where(over >= 0, depth[over], 0), np.where(over >= 0, over[over], -1)
    order = np.argsort(-depth[at], kind="stable")
    at, what = at[order], what[order]
    levels = depth[at]
    width, here = (int(what.max()) + 1 if len(what) else 1), np.zeros(0, np.int64)
    for level in range(int(levels[0]) if len(levels) else -1, -1, -1):
        a, b = np.searchsorted(-levels, (-level, -level + 1))
        here = np.unique(np.concatenate([here, at[a:b].astype(np.int64) * width + what[a:b]]))
        box, value = here // width, here % width
        yield box, value
        here = up[box[up[box] >= 0]].astype(np.int64) * width + value[up[box] >= 0]


def scope_frames(nodes: DataFrame) -> DataFrame:
    """(path, depth, frame): the cumulative prefixes of every distinct path."""
    parts = F.split("path", r"\.")
    frames = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(parts, F.lit(1), k), ".").alias("frame")))
    return nodes.select("path").distinct().select("path", F.explode(frames).alias("f")).select("path", "f.depth", "f.frame")


def nearest(nodes: DataFrame, wanted: DataFrame | Column, proper: bool = False, carry: tuple[str, ...] = (), block: Column | None = None) -> DataFrame:
    """(id, ancestor): for every node the nearest of ``wanted`` (id, or a condition on nodes) on its way to the root over parents; null if there is none.

    The node itself counts unless ``proper``; ``carry`` names columns of nodes to keep. Nodes of one ``block`` (neighbouring ids) are followed inside a task, in one exchange of all
    nodes. Only what leads out of its block is joined, and pointers jump twice as far each round, so a tree of any depth takes a logarithmic number of joins. Nodes
    whose way ends in a cycle of parents without a wanted node have none: their pointers still move when every path must have ended.
    """
    keep = () if proper else carry
    block = F.shiftright("id", BLOCK) if block is None else block
    given = F.coalesce(wanted, F.lit(False)) if isinstance(wanted, Column) else F.lit(False)
    rows = nodes.select(block.cast("long").alias("block"), F.col("id").alias("up"), F.col("parent").alias("next"), F.lit(False).alias("mark"), given.alias("hit"), *keep)
    if not isinstance(wanted, Column):
        marks = wanted.select(block.cast("long").alias("block"), F.col("id").alias("up"), F.lit(True).alias("mark"))
        rows = rows.unionByName(marks, allowMissingColumns=True)
    kind = rows.schema["up"].dataType.simpleString()
    schema = ", ".join([f"up {kind}", f"next {kind}", "done boolean", "hit boolean", *(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)])
    links, seen = rows.repartition("block").sortWithinPartitions("block").mapInArrow(_shortened, schema), Observation()
    base = saved(links.observe(seen, F.count(F.lit(1)).alias("n")), "links")
    size = seen.get["n"]
    parts, active, rounds = [base.where("done")], base.where("NOT done"), 0
    while not active.isEmpty():
        # (up, next, done, hit): done once up is wanted or there is nothing above
        if rounds == size.bit_length() + 1:
            break
        hop = reduce(DataFrame.unionAll, [p.select("up", "next", "done", "hit") for p in (*parts, active)])
        hop = planned(hop, size).select(F.col("up").alias("next"), F.col("next").alias("beyond"), F.col("done").alias("end"), F.col("hit").alias("found"))
        move = active.join(hop, "next", "left").select("up", F.col("beyond").alias("next"), F.coalesce("end", F.lit(True)).alias("done"), F.coalesce("found", F.lit(False)).alias("hit"), *keep)
        move, rounds = saved(move, "links"), rounds + 1
        parts.append(move.where("done"))
        active = move.where("NOT done")
    found = reduce(DataFrame.unionAll, parts).unionAll(active.withColumn("hit", F.lit(False)))
    found = planned(found, size).select(F.col("up").alias("id"), F.when(F.col("hit"), F.col("next")).alias("ancestor"), *keep)
    if not proper:
        return found
    return nodes.select("id", "parent").join(found.withColumnRenamed("id", "parent"), "parent", "left").select("id", "ancestor")


def nearest_ancestor(nodes: DataFrame, kind: str = "Instance") -> DataFrame:
    """(id, ancestor): the nearest node of a kind, itself included."""
    return nearest(nodes, nodes.where(F.col("kind") == kind))


def containing_instance(nodes: DataFrame) -> DataFrame:
    """(id, ancestor): the nearest instance above a node; none if that is a top-level instance, which is the design itself."""
    found = nearest(nodes, nodes.where("kind = 'Instance'"), proper=True)
    tops = nodes.where("parent IS NULL").select(F.col("id").alias("ancestor"), F.lit(True).alias("is_top"))
    return found.join(tops, "ancestor", "left").select("id", F.when(F.col("is_top").isNull(), F.col("ancestor")).alias("ancestor"))


def cone_root(nodes: DataFrame, navigable: DataFrame) -> DataFrame:
    """(id, root): path of the nearest navigable scope, itself included; the node's own path if there is none."""
    found = nearest(nodes, navigable).withColumnRenamed("ancestor", "up")
    paths = nodes.select(F.col("id").alias("up"), F.col("path").alias("root"))
    return nodes.select("id", "path").join(found, "id").join(paths, "up", "left").select("id", F.coalesce("root", "path").alias("root"))


def tree(nodes: DataFrame, depth: int, root: str = "top") -> DataFrame:
    """(path, parent_path, level, expandable) of scopes down to a depth; one join for each level, every level written once."""
    scopes = saved(nodes.where(F.col("kind").isin("Instance", "GenBlock")).select("id", "path", "parent"), "scopes")
    kids = scopes.where("parent IS NOT NULL").groupBy("parent").agg(F.count("*").alias("kids"))
    level = scopes.where(F.col("path") == root).select("id", "path", F.lit(None).cast("string").alias("parent_path"), F.lit(0).alias("level"))
    out = level
    for k in range(1, depth + 1):
        level = saved(scopes.alias("s").join(level.alias("p"), F.col("s.parent") == F.col("p.id")).select("s.id", "s.path", F.col("p.path").alias("parent_path"), F.lit(k).alias("level")), "level")
        out = out.unionAll(level)
    return out.join(kids, out["id"] == kids["parent"], "left").select("path", "parent_path", "level", (F.coalesce("kids", F.lit(0)) > 0).alias("expandable"))


def child_boxes(nodes: DataFrame) -> DataFrame:
    """(scope, box): children of instances that aren't GenBlocks; GenBlocks dissolve, however deep they nest."""
    blocks = nodes.where("kind = 'GenBlock'").select("id")
    boxes = nodes.where("kind <> 'GenBlock' AND parent IS NOT NULL").select(F.col("id").alias("box"), F.col("parent").alias("id"))
    # the nearest ancestor of a box that is no GenBlock
    above = nearest(nodes, nodes.join(blocks, "id", "left_anti"))
    scopes = nodes.where("kind = 'Instance'").select(F.col("id").alias("ancestor"))
    return boxes.join(above, "id").join(scopes, "ancestor", "left_semi").select(F.col("ancestor").alias("scope"), "box")


def scope_signals(nodes: DataFrame) -> DataFrame:
    """(scope, path, id, kind): signals declared in a scope, one row a path, shown by the preferred node."""
    signals = nodes.where(F.col("kind").isin("Port", "Net", "Var", "Memory")).alias("s")
    at = signals.join(nodes.alias("p"), F.col("s.parent") == F.col("p.id")).select(F.col("p.path").alias("scope"), "s.path", "s.id", "s.kind")
    order = Window.partitionBy("scope", "path").orderBy(best_kind(F.col("kind")), "id")
    return at.withColumn("r", F.row_number().over(order)).where("r = 1").drop("r")


def relative_path(rows: DataFrame, scope: str = "scope", path: str = "path") -> DataFrame:
    """Adds ``rel``: the path inside its scope, else its last segment."""
    inside = F.expr(f"startswith({path}, concat({scope}, '.'))")
    return rows.withColumn("rel", F.when(inside, F.expr(f"substring({path}, length({scope}) + 2)")).otherwise(F.element_at(F.split(path, r"\."), -1)))


def within(nodes: DataFrame, boxes: DataFrame) -> DataFrame:
    """(id, box): every box (id) that a node is or lies under. The nearest box of each node, and from box to box upwards.

    On a cycle of parents a node lies under each box of it once.
    """
    near, above = enclosing(nodes, boxes)
    return near.join(above, "box").select("id", F.col("ancestor").alias("box"))


def enclosing(nodes: DataFrame, boxes: DataFrame, carry: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(near, above): near (id, box), the nearest of ``boxes`` (id) that a node is or lies under, with what is to be carried; above (box, ancestor), all boxes that a box is or lies under."""
    mine = boxes.select("id").distinct()
    found = nearest(nodes, mine, carry=carry)
    near = found.where("ancestor IS NOT NULL").select("id", F.col("ancestor").alias("box"), *carry)
    return near, chains(nodes, mine, near)


def chains(nodes: DataFrame, mine: DataFrame, near: DataFrame) -> DataFrame:
    """(box, ancestor): all of the boxes ``mine`` (id) that a box is or lies under, from the nearest box of each node, near (id, box)."""
    kept = nodes.select("id", "parent").join(mine, "id", "left_semi")
    up = kept.join(near.select(F.col("id").alias("parent"), F.col("box").alias("ancestor")), "parent", "left").select(F.shiftright("id", BLOCK).cast("long").alias("block"), F.col("id").alias("box"), "ancestor")
    pairs = saved(up.repartition("block").sortWithinPartitions("block").mapInArrow(_climbed, "box long, ancestor long, onwards boolean"), "above")
    out, onwards, rounds = pairs.where("NOT onwards").select("box", "ancestor"), pairs.where("onwards").select("box", "ancestor"), 0
    inside, level = out.select(F.col("box").alias("up"), F.col("ancestor").alias("next")), onwards
    while not level.isEmpty():
        out = out.unionAll(saved(level.join(inside, F.col("ancestor") == F.col("up")).select("box", F.col("next").alias("ancestor")), "above"))
        level = level.join(onwards.select(F.col("box").alias("up"), F.col("ancestor").alias("next")), F.col("ancestor") == F.col("up")).select("box", F.col("next").alias("ancestor"))
        # a tree never meets a pair twice; a cycle does, at the latest by then
        rounds += 1
        level = saved(level.distinct().join(out, ["box", "ancestor"], "left_anti") if rounds % DEEP == 0 else level, "level")
    return out if rounds < DEEP else out.distinct()
