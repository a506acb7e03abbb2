"""Traces against a walk that takes one connection after the other."""

import random
from collections import defaultdict

import pytest

from netloom.operators import store, trace
from netloom.operators.graph import Limits

NODES = "id long, kind string, name string, path string, parent long, dir string, modport string, const string"
EDGES = "edge string, port long, endpoint long, dir string, sel string"
BOXES, LOGIC, SIGNALS = trace.BOXES, trace.LOGIC, trace.SIGNALS


class Plain:
    """One trace, walked in order."""

    def __init__(self, nodes, edges, limits):
        self.n = {r[0]: dict(zip(("id", "kind", "name", "path", "parent", "dir", "modport", "const"), r)) for r in nodes}
        self.e = sorted(edges)
        self.limits = limits
        self.near = defaultdict(list)
        for e in self.e:
            for x in {e[1], e[2]}:
                self.near[x].append(e)
        self.paths = defaultdict(list)
        for i in sorted(self.n):
            self.paths[self.n[i]["path"]].append(i)
        self.canvas, self.visited, self.seeds, self.wires, self.more, self.cut = {}, set(), {}, {}, defaultdict(int), False

    def kind(self, i):
        return self.n[i]["kind"]

    def is_box(self, i):
        return self.kind(i) in BOXES and self.n[i]["parent"] is not None

    def up(self, i):
        while i is not None:
            yield i
            i = self.n[i]["parent"]

    def home(self, i):
        return next((x for x in self.up(i) if self.is_box(x)), None)

    def group(self, i):
        return [x for x in self.paths[self.n[i]["path"]] if self.kind(x) in SIGNALS] if self.kind(i) in SIGNALS else [i]

    def raw(self, b):
        """Whether a connection from outside reaches the interface without a view."""
        inside = {b} | {i for i in self.n if self.n[i]["parent"] == b}
        for e in self.e:
            if e[2] in inside and e[1] not in inside:
                p = self.n[e[1]]
                above = self.n.get(p["parent"], {"kind": None})
                view = p["modport"] if p["kind"] == "Interface" else above["modport"] if above["kind"] == "Interface" else None
                if view is None:
                    return True
        return False

    def shown(self, i, b):
        """The pin of box b that node i is drawn on."""
        box = self.n[b]
        if box["kind"] not in ("Instance", "Interface"):
            return None
        n = self.n[i]
        if n["kind"] == "Port" and n["parent"] == b:
            return str(i)
        if box["kind"] == "Interface" and box["modport"] is None and (i == b or (n["parent"] == b and n["kind"] != "Port")):
            if self.raw(b):
                return f"raw/{b}"
        for x in (i, n["parent"] if n["kind"] == "Port" else None):
            if x is not None and self.kind(x) == "Interface" and self.n[x]["modport"] and self.n[x]["parent"] == b and any(e[1] == x for e in self.e):
                return str(x)
        return None

    def pin(self, b, inner, e):
        if self.kind(b) in LOGIC:
            return f"{b}/{e[2]}" if any(x[1] == b and x[2] == e[2] for x in self.e) else None
        other = e[2] if inner == e[1] else e[1]
        return next((p for x in (inner, other, *self.paths[self.n[inner]["path"]]) if (p := self.shown(x, b))), None)

    def wire(self, drivers, loads, rep):
        for d, ds in drivers:
            for l, ls in loads:
                if d != l and (ds is None or ls is None or ds == ls):
                    self.wires.setdefault((min(d, l), max(d, l)), (d, l, rep, ds or ls))

    def walk(self, seed, way, depth, fanout):
        if seed not in self.n:
            return
        front = [seed] if self.is_box(seed) else list(self.paths[self.n[seed]["path"]])
        if self.is_box(seed):
            self.canvas.setdefault(seed, True)
        for x in front:
            rep = self.group(x)[0]
            self.seeds[rep] = self.seeds.get(rep, False) or self.is_box(seed)
        self.visited |= set(front)
        for _ in range(max(depth, 1)):
            before, came, nxt, done = dict(self.canvas), set(), [], set()
            for node in front:
                members = self.group(node)
                rep = members[0]
                if rep in done:
                    continue
                done.add(rep)
                self.visited |= set(members)
                nxt += self.signal(rep, members, way, max(1, fanout or self.limits.fanout), before, came)
            front = nxt
            if not front:
                break

    def push(self, members, out, x):
        if x not in members and x not in self.visited:
            self.visited.add(x)
            out.append(x)

    def signal(self, rep, members, way, most, before, came):
        """``came``: what followed connections of the hop have put on the canvas."""
        drivers, loads, pins, out, kept, dropped = [], [], [], [], 0, 0
        for e in sorted({e for m in members for e in self.near[m]}):
            near = e[1] if e[1] in members else e[2]
            other = e[2] if near == e[1] else e[1]
            outwards = (e[3] == "out") == (near == e[1])
            followed = way == "inout" or outwards == (way == "out")
            if followed and kept >= most:
                dropped += 1
                continue
            b, free = self.home(other), self.group(other)[0] if self.kind(other) in SIGNALS else None
            if not followed:
                drawn = (before.get(b) is True or b in came) if b is not None else (before.get(free) is False or free in came)
                if not drawn:
                    continue
            if b is not None and self.canvas.get(b) is not True and len(self.canvas) >= self.limits.boxes:
                dropped += 1
                continue
            pin = self.pin(b, other, e) if b is not None else None
            if pin is None and free is None:
                if b is None:
                    self.push(members, out, other)
                continue
            if pin is not None:
                if b not in self.canvas:
                    self.canvas[b] = True
                    came.add(b)
            else:
                if free not in self.canvas:
                    self.canvas[free] = False
                    if followed:
                        came.add(free)
            kept += followed
            far = pin or str(free)
            pins.append(far)
            (drivers if not outwards else loads).append((far, e[4]))
            if self.seeds.get(rep):
                own = self.pin(rep, near, e) if near == rep else None
                if own:
                    self.wire([(far, e[4])], [(own, e[4])], rep) if not outwards else self.wire([(own, e[4])], [(far, e[4])], rep)
            if not followed:
                continue
            if pin is None:
                self.push(members, out, other)
                continue
            if other != b and self.kind(b) in ("Instance", "Interface") and self.group(other)[0] != rep:
                for m in self.group(other):
                    self.push(members, out, m)
            for x in self.near[b]:
                y = x[2] if x[1] == b else x[1]
                if y != b and self.kind(y) != "Const":
                    self.push(members, out, y)
        one, stub = bool(drivers) != bool(loads), None
        if (one or len(members) > 1 or rep in self.seeds) and self.canvas.get(rep) is not True and self.kind(rep) != "Const":
            self.canvas.setdefault(rep, False)
            stub = str(rep)
        both = drivers and loads
        if stub and one:
            (loads if drivers else drivers).append((stub, None))
        if dropped:
            self.cut = True
            for p in [stub] if stub else pins:
                self.more[p] += dropped
        if not self.seeds.get(rep):
            if stub and both:
                self.wire(drivers, [(stub, None)], rep)
                self.wire([(stub, None)], loads, rep)
            else:
                self.wire(drivers, loads, rep)
        return out

    def within(self, i):
        a = next((x for x in self.up(self.n[i]["parent"]) if self.kind(x) == "Instance"), None)
        return None if a is None or self.n[a]["parent"] is None else a

    def drawn(self):
        around = set()
        for i in self.canvas:
            while (i := self.within(i)) is not None:
                around.add(i)
        holders = around - set(self.canvas)
        boxes = {i for i, b in self.canvas.items() if b} | holders
        owner = defaultdict(set)
        for b in boxes:
            for i in self.n:
                if p := self.shown(i, b):
                    owner[p].add(b)
            if self.kind(b) in LOGIC:
                for e in self.e:
                    if e[1] == b:
                        owner[f"{b}/{e[2]}"].add(b)
        stubs = {i for i, b in self.canvas.items() if not b and str(i) not in owner}
        for s in stubs:
            owner[str(s)].add(s)
        live = {p for w in self.wires.values() for p in w[:2]} | set(self.more)
        alive = {b for p in live for b in owner[p]} | set(self.seeds)
        left = {i for i in boxes | stubs if i in alive or i in holders}
        while gone := {i for i in left if i in holders and i not in alive and not any(self.within(x) == i for x in left)}:
            left -= gone
        nodes = sorted((i, self.kind(i), i in boxes, w if (w := self.within(i)) in left else -1) for i in left)
        pins = sorted((i, p, self.more.get(p, 0)) for p, own in owner.items() for i in own if i in left and p in live)
        return nodes, pins, sorted(w[:2] + (w[3] or "",) for w in self.wires.values())


def design(seed):
    """Instances in instances and GenBlocks, ports with backing nets, logic, memories, interfaces with and without views, nets with many ends."""
    rng = random.Random(seed)
    nodes, edges = [(0, "Instance", "top", "top", None, None, None, None)], []

    def add(kind, name, parent, path=None, **more):
        i = len(nodes)
        nodes.append((i, kind, name, path or f"{nodes[parent][3]}.{name}", parent, more.get("dir"), more.get("modport"), more.get("const")))
        return i

    def link(port, endpoint, way, sel=None):
        edges.append((f"e{rng.randrange(10**6):06}{len(edges)}", port, endpoint, way, sel))

    def fill(scope, depth):
        nets = [add("Net", f"n{k}", scope) for k in range(4)]
        bus = add("Interface", "bus", scope)
        member = add("Var", "valid", bus)
        add("Modport", "m", bus)
        if rng.random() < 0.3:
            nets.append(add("Memory", "mem", scope))
        for k in range(3):
            b = add(rng.choice(("FF", "Assign", "Comb", "Latch")), f"l{k}", scope, const=rng.choice((None, "1'b0")))
            for _ in range(rng.randrange(1, 4)):
                link(b, rng.choice(nets + [member]), rng.choice(("in", "in", "out")), rng.choice((None, None, "[0]", "[1]")))
            if rng.random() < 0.3:
                link(b, add("Const", "k", scope), "in")
        inner = []
        for k in range(2 if depth else 0):
            at = add("GenBlock", f"g{k}", scope) if rng.random() < 0.5 else scope
            u = add("Instance", f"u{k}", at)
            own = fill(u, depth - 1)
            for name, way in (("i", "in"), ("o", "out"), ("io", "inout")):
                p = add("Port", name, u, dir=way)
                for _ in range(rng.randrange(1, 3)):
                    link(p, rng.choice(nets), way, rng.choice((None, None, "[0]")))
                if rng.random() < 0.8:
                    back = add("Net", name, u)
                    link(rng.choice([x for x in own if nodes[x][1] in LOGIC] or [p]), back, "in" if way == "in" else "out")
            if rng.random() < 0.6:
                bundle = add("Interface", "b", u, modport="m")
                q = add("Port", "valid", bundle, nodes[member][3], dir="out")
                link(q, member, "out")
                link(bundle, bus, "inout")
            inner += own
        return nets + [x for x in range(nets[0], len(nodes)) if nodes[x][4] == scope] + inner

    fill(0, 2)
    return nodes, edges


@pytest.mark.parametrize("seed, boxes, fanout", [(1, 500, 32), (3, 7, 2)])
def test_traces_equal_a_walk(spark, seed, boxes, fanout):
    nodes, edges = design(seed)
    rng, limits = random.Random(seed), Limits(boxes=boxes, fanout=fanout)
    steps = []
    for t in range(40):
        for s in range(1, rng.choice((1, 1, 2, 2)) + 1):
            steps.append((t, s, rng.randrange(len(nodes) + 1), rng.choice(("in", "out", "inout")), rng.choice((0, 1, 2, 3)), rng.choice((None, None, 1, 50))))
    drawn, pins, wires, cut = trace.trace_graph(spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES), spark.createDataFrame(steps, trace.STEPS), limits)
    got = defaultdict(lambda: ([], [], []))
    for r in drawn.collect():
        got[r.trace][0].append((r.node, r.kind, r.boxed, -1 if r.within is None else r.within))
    for r in pins.collect():
        got[r.trace][1].append((r.node, r.pin, r.more))
    for r in wires.collect():
        sel = r.net[r.net.index("[") :] if "[" in r.net else ""
        got[r.trace][2].append((r.source, r.target, sel))
    ended = {r.trace: r.truncated for r in cut.collect()}
    full = 0
    for t in range(40):
        plain = Plain(nodes, edges, limits)
        for _, _, x, way, depth, fan in (s for s in steps if s[0] == t):
            plain.walk(x, way, depth, fan)
        assert tuple(map(sorted, got[t])) == plain.drawn(), t
        assert ended.get(t, False) == plain.cut
        full += plain.cut
    assert sum(len(g[2]) for g in got.values()) > 60 and (full > 3 or boxes == 500)


def test_nothing(spark):
    made = trace.trace_graph(spark.createDataFrame([], NODES), spark.createDataFrame([], EDGES), spark.createDataFrame([(1, 1, 5, "out", 2, None)], trace.STEPS))
    assert [t.count() for t in made] == [0, 0, 0, 1]


def test_only_what_lies_around_a_trace_is_written(spark, monkeypatch):
    """A net with two readers beside 300 boxes that no trace comes near."""
    nodes = [(0, "Instance", "top", "top", None, None, None, None), (1, "Net", "w", "top.w", 0, None, None, None)]
    edges = []
    for k in range(2, 304):
        nodes += [(10 * k, "Instance", f"b{k}", f"top.b{k}", 0, None, None, None), (10 * k + 1, "Port", "i", f"top.b{k}.i", 10 * k, "in", None, None), (10 * k + 2, "Net", "i", f"top.b{k}.i", 10 * k, None, None, None)]
        nodes += [(10 * k + 3, "FF", "f", f"top.b{k}.f", 10 * k, None, None, None)]
        edges += [(f"a{k}", 10 * k + 3, 10 * k + 2, "in", None)] + ([(f"b{k}", 10 * k + 1, 1, "in", None)] if k < 4 else [])
    written = {}

    def counted(df, name):
        out = saved(df, name)
        written[name] = max(written.get(name, 0), out.count())
        return out

    saved = trace.saved
    for module in (trace, trace.hierarchy):
        monkeypatch.setattr(module, "saved", counted)
    steps = spark.createDataFrame([(7, 1, 1, "out", 1, None)], trace.STEPS)
    drawn, _, wires, _ = trace.trace_graph(spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES), steps)
    assert sorted((r.node, r.kind, r.boxed) for r in drawn.collect()) == [(1, "Net", False), (20, "Instance", True), (30, "Instance", True)]
    assert sorted((r.source, r.target, r.net) for r in wires.collect()) == [("1", "21", "w"), ("1", "31", "w")]
    assert written.pop("twins") == 604
    assert max(written.values()) < 20, written


def test_many_rows_are_not_broadcast(spark, monkeypatch):
    """Of many rows on both sides none is broadcast, whatever their files' size; ids that are shuffled are first told apart by their blocks."""
    monkeypatch.setattr(store, "MOST_ROWS", 2)
    few, many = store.sized(spark.range(2), "few"), store.sized(spark.range(3), "many")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan(many.join(many.where("id > 0").groupBy("id").count(), "id")) and "BroadcastHashJoin" in plan(few.join(few.select("id"), "id"))
    monkeypatch.setattr(trace, "MOST_IDS", 2)
    rows = store.sized(spark.range(0, 3_000).selectExpr("id", "id AS x"), "rows")
    found = trace._among(rows, store.sized(spark.createDataFrame([(5,), (6,), (300,), (9_000,)], "k long"), "ids"), "id")
    assert sorted(r.id for r in found.collect()) == [5, 6, 300]
    monkeypatch.setattr(trace, "MOST_IDS", 3)
    found = trace._among(rows, store.sized(spark.createDataFrame([(5,), (6,), (300,), (2_999,)], "k long"), "ids"), "id")
    assert sorted(found.collect()) == [(5, 5), (6, 6), (300, 300), (2_999, 2_999)] and found.columns == ["id", "x"] and "BroadcastHashJoin" in plan(found)
