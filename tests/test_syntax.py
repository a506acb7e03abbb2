"""Read and write sets and lowered branches against recursions over the same trees."""

import random

from pyspark.sql import functions as F

from netloom.operators import hierarchy, syntax

TREE = "id long, parent long, slot string, kind string, path string"
STATEMENTS = "id long, parent long, slot string, pos int, kind string, cond string"


def expressions(seed, trees, depth):
    rng, rows = random.Random(seed), []

    def grow(parent, slot, left):
        i = len(rows)
        kind = rng.choice(("NamedValue", "HierarchicalValue", "Literal")) if not left else rng.choice(("ElementSelect", "RangeSelect", "MemberAccess", "Concatenation", "Concatenation", "StreamingConcatenation", "BinaryOp", "NamedValue"))
        rows.append((i, parent, slot, kind, rng.choice((None, *(f"top.s{k}" for k in range(9)))) if kind in syntax.VALUES else None))
        if kind in syntax.SELECTS:
            grow(i, "value", left - 1)
            grow(i, "selector", max(left - 2, 0))
        elif "Concatenation" in kind or kind == "BinaryOp":
            for _ in range(rng.randrange(3)):
                grow(i, "operand", left - 1)

    for _ in range(trees):
        grow(None, None, depth)
    return rows


def test_reads_and_writes(spark):
    rows = expressions(4, 60, 9)
    kids = {}
    for r in rows:
        kids.setdefault(r[1], []).append(r)

    def refs(r):
        own = {r[4]} if r[3] in syntax.VALUES and r[4] else set()
        return own.union(*(refs(k) for k in kids.get(r[0], [])))

    def bases(r):
        if r[3] in syntax.VALUES:
            return {r[4]} - {None}
        if r[3] in syntax.SELECTS:
            return set().union(*(bases(k) for k in kids.get(r[0], []) if k[2] == "value"))
        if r[3] == "Concatenation":
            return set().union(*(bases(k) for k in kids.get(r[0], [])))
        return refs(r)

    tree = spark.createDataFrame(rows, TREE)
    roots = tree.where("id % 3 = 0 OR parent IS NULL").select("id")
    asked = [r for r in rows if r[0] % 3 == 0 or r[1] is None]
    assert {tuple(r) for r in syntax.value_refs(tree, roots).collect()} == {(r[0], p) for r in asked for p in refs(r)}
    got = {tuple(r) for r in syntax.lvalue_bases(tree, roots).collect()}
    assert got == {(r[0], p) for r in asked for p in bases(r)} and len(got) > 100


def programs(seed, n):
    """Sequences with assignments of one or two signals, blocks in blocks, and ifs with elses and else-ifs, in source order."""
    rng, rows, writes = random.Random(seed), [], []

    def add(parent, slot, kind):
        rows.append((len(rows), parent, slot, len(rows) * 10, kind, f"c{len(rows)}" if kind == "If" else None))
        return len(rows) - 1

    def statement(parent, slot, depth):
        kind = rng.choice(("Assign", "Assign", "If", "If", "Block")) if depth else "Assign"
        i = add(parent, slot, kind)
        if kind == "Assign":
            writes.extend((i, p) for p in rng.sample("xyz", rng.choice((1, 1, 2))))
        elif kind == "Block":
            for _ in range(rng.randrange(4)):
                statement(i, "body", depth - 1)
        else:
            statement(i, "true", depth - 1)
            if rng.random() < 0.6:
                statement(i, "false", depth - 1)

    for _ in range(n):
        top = add(None, None, "Block")
        for _ in range(4):
            statement(top, "body", 5)
    return rows, writes


def by_rules(rows, writes):
    """The fold over sequences that the tables stand for."""
    kids, muxes, roots = {}, set(), set()
    for r in rows:
        kids.setdefault(r[1], []).append(r)
    stores = {}
    for i, p in writes:
        stores.setdefault(i, []).append(p)

    def flat(r):
        return [x for k in kids.get(r[0], []) for x in flat(k)] if r[4] == "Block" else [r]

    def assigned(r):
        return set(stores.get(r[0], ())).union(*(assigned(k) for k in kids.get(r[0], [])))

    def run(body, values):
        for r in body:
            if r[4] == "Assign":
                for p in stores[r[0]]:
                    values[p] = f"assign {r[0]}"
                continue
            chain, last = [], r
            while last is not None and last[4] == "If":
                true = [k for k in kids.get(last[0], []) if k[2] == "true"]
                chain.append((last[5], true))
                last = next((k for k in kids.get(last[0], []) if k[2] == "false"), None)
            came = dict(values)
            ends = [run([x for k in body for x in flat(k)], dict(came)) for _, body in chain]
            other = run(flat(last), dict(came)) if last is not None else came
            for p in assigned(r):
                acc = other.get(p)
                for k in reversed(range(len(chain))):
                    muxes.add((r[0], k, p, chain[k][0], ends[k].get(p), acc))
                    acc = f"mux {r[0]} {k}"
                values[p] = acc
        return values

    for r in rows:
        if r[1] is None:
            for p, v in run(flat(r), {}).items():
                if v.startswith("mux"):
                    roots.add((p, r[0], v))
    return muxes, roots


def test_lowered_branches(spark):
    rows, writes = programs(6, 40)
    muxes, roots = syntax.lowered_branches(spark.createDataFrame(rows, STATEMENTS), spark.createDataFrame(writes, "id long, path string"))
    want = by_rules(rows, writes)
    assert {tuple(r) for r in muxes.collect()} == want[0] and len(want[0]) > 200
    assert {tuple(r) for r in roots.collect()} == want[1]


def test_nothing(spark):
    tree = spark.createDataFrame([], TREE)
    assert syntax.value_refs(tree, tree.select("id")).count() == syntax.lvalue_bases(tree, tree.select("id")).count() == 0
    muxes, roots = syntax.lowered_branches(spark.createDataFrame([], STATEMENTS), spark.createDataFrame([], "id long, path string"))
    assert muxes.count() == roots.count() == 0


def test_walks_cross_blocks_and_cycles(spark):
    rng = random.Random(5)
    # ids far apart and close together, some on cycles, some whose parent is no node
    ids = [rng.randrange(1 << 20) for _ in range(150)] + list(range(1 << 21, (1 << 21) + 60))
    ids = sorted(set(ids))
    parent = {i: rng.choice([None, -7, *ids[:k]]) if rng.random() < 0.9 else rng.choice(ids) for k, i in enumerate(ids)}
    wanted = set(rng.sample(ids, 60))

    def way(i):
        seen = []
        while i in parent and i not in seen:
            seen.append(i)
            i = parent[i]
        return seen

    nodes = spark.createDataFrame(list(parent.items()), "id long, parent long")
    boxes = spark.createDataFrame([(i,) for i in wanted], "id long")
    near = {r.id: r.ancestor for r in hierarchy.nearest(nodes, boxes).collect()}
    assert near == {i: next((a for a in way(i) if a in wanted), None) for i in ids}
    rows = [(r.id, r.box) for r in hierarchy.within(nodes, boxes).collect()]
    assert sorted(rows) == sorted((i, a) for i in ids for a in way(i) if a in wanted)


def test_nearest_exchanges_neighbours_once(spark):
    tree = spark.range(4096).select("id", F.when(F.col("id") > 0, F.col("id") - 1).alias("parent"))
    counted = []
    keep = hierarchy.saved
    hierarchy.saved = lambda df, name: counted.append(name) or keep(df, name)
    try:
        found = hierarchy.nearest(tree, F.col("id") == 0)
    finally:
        hierarchy.saved = keep
    assert found.where("ancestor = 0").count() == 4096
    # a chain of 4,096 took 13 rounds of writing all nodes
    assert counted == ["links"]


def test_trees_inside_blocks_take_one_exchange(spark, monkeypatch):
    """Reads and stores of trees that lie in a block of ids are worked out there; trees across blocks and cycles of parents give the same either way."""
    rows = expressions(7, 60, 8)
    n = len(rows)
    rows += [(n + k, n + (k + 1) % 5, "value", ("MemberAccess", "NamedValue", "BinaryOp")[k % 3], f"top.c{k}" if k % 3 == 1 else None) for k in range(5)] + [(n + 5, n + 2, "operand", "NamedValue", "top.c9")]
    tree = spark.createDataFrame(rows, TREE)
    roots = tree.where(f"id % 3 = 0 OR parent IS NULL OR id = {n + 1}").select("id")
    joined = {tuple(r) for r in syntax._joined_refs(tree.select("id", "parent", F.when(F.col("kind").isin(*syntax.VALUES), F.col("path")).alias("path")), roots).collect()}, {tuple(r) for r in syntax._joined_bases(tree, roots).collect()}
    assert any(p == "top.c9" for _, p in joined[0])
    for block in (16, 4):
        monkeypatch.setattr(hierarchy, "BLOCK", block)
        for made, want in zip((syntax.value_refs, syntax.lvalue_bases), joined):
            df = made(tree, roots)
            plan = df._jdf.queryExecution().executedPlan().toString()
            got = [tuple(r) for r in df.collect()]
            assert len(got) == len(set(got)) and set(got) == want
            if block == 16:
                assert plan.count("Exchange hashpartitioning") == 1
