"""The graph of every scope at once, at the level of processes or of gates: boxes, anchors, wires between them, constants and dangling pins.

Nodes are (id, kind, name, path, parent, dir, modport, const), edges (edge, port, endpoint, dir, sel). Each row of a result names its
scope, so one plan of equal-key joins draws the whole design. A pin is a string: a node's id, ``box/signal`` for a pin made for a logic
box or a gate (a gate's result is ``gate/gate``), ``raw/box`` for what reaches an interface without a view, ``const/port`` for a literal's source.
Null rules: a node without a parent is in no scope; an edge whose ends aren't nodes draws nothing. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.operators import graph, hierarchy
from netloom.operators.schematic import GATES, LOGIC, bare_interfaces, fold_inverters, navigable
from netloom.operators.store import saved

BOXES = ("Instance", "Interface", *LOGIC)


def scopes_of(nodes: DataFrame) -> DataFrame:
    """(scope): navigable scopes; an interface shows its views instead, and has a graph of its own."""
    return saved(navigable(nodes).join(bare_interfaces(nodes), "id", "left_anti").select(F.col("id").alias("scope")), "scopes")


def scope_boxes(nodes: DataFrame, scopes: DataFrame) -> DataFrame:
    """(scope, box, kind): what each navigable scope draws. Boxes under GenBlocks show in every scope up to the first that is none, once on a cycle of them."""
    level = saved(nodes.where(F.col("kind").isin(*BOXES) & F.col("parent").isNotNull()).select(F.col("parent").alias("scope"), F.col("id").alias("box"), "kind"), "boxes")
    blocks = saved(nodes.where("kind = 'GenBlock' AND parent IS NOT NULL").select(F.col("id").alias("scope"), F.col("parent").alias("up")), "blocks")
    out, rounds = level, 0
    while not level.isEmpty():
        level, rounds = level.join(blocks, "scope").select(F.col("up").alias("scope"), "box", "kind"), rounds + 1
        level = saved(level.distinct().join(out, ["scope", "box"], "left_anti") if rounds % hierarchy.DEEP == 0 else level, "boxes")
        out = out.unionAll(level)
    out = out if rounds < hierarchy.DEEP else out.distinct()
    return saved(out.join(scopes, "scope", "left_semi"), "boxes")


def dissolved(nodes: DataFrame, folds: DataFrame, boxes: DataFrame) -> DataFrame:
    """``boxes`` at the gate level: combinational blocks give way to their gates, folded inverters (inverter) left out; a block without gates stays, as do registers."""
    inner = nodes.where(F.col("kind").isin(*GATES)).select(F.col("id").alias("gate"), F.col("kind").alias("gate_kind"), F.col("parent").alias("box")).join(folds.select(F.col("inverter").alias("gate")), "gate", "left_anti")
    rows = boxes.join(inner, (boxes["box"] == inner["box"]) & boxes["kind"].isin("Comb", "Latch", "Assign"), "left")
    return rows.select("scope", F.coalesce("gate", boxes["box"]).alias("box"), F.coalesce("gate_kind", boxes["kind"]).alias("kind"))


def operands(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(edge, gate, endpoint, inverted): what a gate's inputs read, through inverters that are drawn as a bubble on the pin."""
    folds = fold_inverters(nodes.select("id", "kind"), edges).select(F.col("inverter").alias("endpoint"), "operand")
    reads = edges.where("dir <> 'out'").join(nodes.where(F.col("kind").isin(*GATES)).select(F.col("id").alias("port")), "port", "left_semi")
    rows = reads.select("edge", F.col("port").alias("gate"), "endpoint").join(folds, "endpoint", "left")
    return rows.select("edge", "gate", F.coalesce("operand", "endpoint").alias("endpoint"), F.col("operand").isNotNull().alias("inverted"))


def gate_pins(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(gate, pin, name, side, role, constant): a pin for each operand of a gate, and one for its result, which has no name.

    ``role`` is inv on a bubble; a literal or a parameter as operand shows its value on the pin. Operands that several edges read are one pin.
    """
    text = lambda c: F.col(c).cast("string")
    at = nodes.select(F.col("id").alias("endpoint"), "name", "kind", F.col("const").alias("value"))
    reads = operands(nodes, edges).groupBy("gate", "endpoint").agg(F.bool_or("inverted").alias("inverted")).join(at, "endpoint")
    reads = reads.select("gate", F.concat(text("gate"), F.lit("/"), text("endpoint")).alias("pin"), "name", F.lit("west").alias("side"), F.when(F.col("inverted"), "inv").alias("role"), F.when(F.col("kind").isin("Const", "Param"), F.col("value")).alias("constant"))
    folded = fold_inverters(nodes.select("id", "kind"), edges).select(F.col("inverter").alias("gate"))
    gates = nodes.where(F.col("kind").isin(*GATES)).select(F.col("id").alias("gate"))
    none = F.lit(None).cast("string")
    results = gates.select("gate", F.concat(text("gate"), F.lit("/"), text("gate")).alias("pin"), F.lit("").alias("name"), F.lit("east").alias("side"), none.alias("role"), none.alias("constant"))
    return reads.unionAll(results).join(folded, "gate", "left_anti")


def own_pins(nodes: DataFrame, scopes: DataFrame) -> DataFrame:
    """(scope, node, pin): a scope's ports, and nodes of the scope at a port's path, which draw on the port (the last of several)."""
    inside = nodes.where("parent IS NOT NULL").select(F.col("parent").alias("scope"), F.col("id").alias("node"), "kind", "path").join(scopes, "scope", "left_semi")
    ports = inside.where("kind = 'Port'").groupBy("scope", "path").agg(F.max("node").alias("pin"))
    return inside.join(ports, ["scope", "path"]).select("scope", "node", "pin")


def member_pins(nodes: DataFrame, edges: DataFrame, boxes: DataFrame) -> DataFrame:
    """(scope, node, box, pin): members that a bundle's pins stand for; the members themselves lie outside the scope."""
    bundles = nodes.where("kind = 'Interface' AND modport IS NOT NULL").select(F.col("id").alias("box"))
    pins = nodes.where("kind = 'Port'").select(F.col("id").alias("pin"), F.col("parent").alias("box")).join(bundles, "box", "left_semi")
    seen = pins.join(edges.select(F.col("port").alias("pin"), F.col("endpoint").alias("node")), "pin")
    return boxes.select("scope", "box").join(seen, "box").select("scope", "node", "box", "pin")


def access_ports(nodes: DataFrame, edges: DataFrame, members: DataFrame) -> DataFrame:
    """(box, view, side): the ports of a bare interface, one a view in use and one (view null) for connections without a view.

    members (modport_id, dir). A view stands west if more than half of its members are outputs; the raw port if at least as
    many connections drive it as read it. Connections from inside, and gates' taps, don't count.
    """
    bare = nodes.where("kind = 'Interface' AND modport IS NULL").select(F.col("id").alias("box"))
    inside = bare.select("box", F.col("box").alias("node")).unionAll(nodes.select(F.col("parent").alias("box"), F.col("id").alias("node")).join(bare, "box", "left_semi")).hint("merge")
    at = nodes.select(F.col("id").alias("port"), F.col("kind").alias("pk"), F.col("modport").alias("pm"), F.col("parent").alias("pp"))
    above = nodes.where("kind = 'Interface'").select(F.col("id").alias("pp"), F.col("modport").alias("am"))
    view = F.when(F.col("pk") == "Interface", F.col("pm")).otherwise(F.col("am"))
    taps = edges.join(inside.withColumnRenamed("node", "endpoint"), "endpoint").join(at.where(~F.col("pk").isin(*GATES)), "port").join(above, "pp", "left")
    taps = taps.join(inside.withColumnRenamed("node", "port"), ["box", "port"], "left_anti").select("box", view.alias("view"), "dir")
    outs, n = F.count_if(F.col("dir") == "out"), F.count("*")
    raw = taps.where("view IS NULL").groupBy("box").agg(F.when(outs * 2 >= n, "west").otherwise("east").alias("side")).select("box", F.lit(None).cast("string").alias("view"), "side")
    views = nodes.where("kind = 'Modport'").select(F.col("parent").alias("box"), F.col("name").alias("view"), F.col("id").alias("modport_id"))
    sides = views.join(taps.select("box", "view").distinct(), ["box", "view"], "left_semi").join(members, "modport_id", "left")
    named = sides.groupBy("box", "view").agg(F.when(outs * 2 > F.count("dir"), "west").otherwise("east").alias("side"))
    return named.unionByName(raw)


#: How a pin is written: a node's id, ``a/b``, ``raw/a``.
_PLAIN, _OF_BOX, _RAW = 0, 1, 2


def _pin(a: Column, b: Column | None = None, way: int = _PLAIN) -> Column:
    return F.struct(F.lit(way).cast("byte").alias("way"), a.cast("long").alias("a"), (F.lit(0) if b is None else b).cast("long").alias("b"))


def _written(pin: str) -> Column:
    a, b = F.col(f"{pin}.a").cast("string"), F.col(f"{pin}.b").cast("string")
    return F.when(F.col(f"{pin}.way") == _OF_BOX, F.concat(a, F.lit("/"), b)).when(F.col(f"{pin}.way") == _RAW, F.concat(F.lit("raw/"), a)).otherwise(a)


def _order(fold: Column, rank: Column, name: Column | None = None) -> Column:
    """The lower fold comes first, inside it the edge of lower rank, or the lesser name."""
    return F.struct(fold.cast("byte").alias("fold"), rank.cast("long").alias("rank"), (F.lit(None) if name is None else name).cast("string").alias("name"))


def _anchor(p: str, x: str, own: str, node: str) -> tuple[Column, Column, Column]:
    """(box, pin, view): where a node of places ``p`` is drawn in a scope that has the box ``x`` above it; ``view``: its pin may be an interface's that is a view."""
    col = lambda name: F.col(f"{p}.{name}")
    box, mine = F.col(f"{x}.box"), F.col(own)
    under = (
        F.when((col("kind") == "Port") & (col("parent") == box), _pin(F.col(node)))
        .when(col("home").isNotNull() & col("home.raw"), _pin(col("home.owner"), way=_RAW)).when(col("home").isNotNull(), _pin(col("home.owner")))
        .when(col("bundle") & (col("parent") == box), _pin(F.col(node))).when((col("kind") == "Port") & (col("grand") == box), _pin(col("parent"))).otherwise(_pin(box))
    )
    view = mine.isNull() & F.coalesce(col("bundle") | col("grand").isNotNull() | F.col(f"{x}.iface"), F.lit(False))
    return F.coalesce(mine, box), F.when(mine.isNotNull(), _pin(mine)).when(F.col(x).isNotNull(), under), view


class Scopes:
    """Anchors of a design; each result is a DataFrame over all scopes. With ``gates`` combinational blocks are drawn as their gates.

    What places a node (the boxes above it and the scopes that show them, its port, its interface) meets an edge in two joins, by id; which scopes draw the edge and on
    what pins is then decided on its row. Pins are numbers until the result, and so are the edges' names, by their place among all.
    """

    def __init__(self, nodes: DataFrame, edges: DataFrame, gates: bool = False) -> None:
        self.nodes, self.edges, self.gates = nodes, edges, gates
        self._tables: dict[str, DataFrame] = {}
        self.scopes = scopes_of(nodes)
        self.boxes = scope_boxes(nodes, self.scopes)
        if gates:
            self.boxes = saved(dissolved(nodes, self.folds, self.boxes), "boxes")

    def _once(self, name: str, made: Callable[[], DataFrame]) -> DataFrame:
        if name not in self._tables:
            self._tables[name] = saved(made(), name)
        return self._tables[name]

    @property
    def folds(self) -> DataFrame:
        """(inverter, operand), found once."""
        return self._once("folds", lambda: fold_inverters(self.nodes.select("id", "kind"), self.edges).select("inverter", "operand"))

    @property
    def own(self) -> DataFrame:
        return self._once("own", lambda: own_pins(self.nodes, self.scopes))

    @property
    def members(self) -> DataFrame:
        return self._once("members", lambda: member_pins(self.nodes, self.edges, self.boxes))

    @property
    def owners(self) -> DataFrame:
        """(node, owner, raw): an interface and its interior; raw says whether anything reaches it without a view."""
        return self._once("owners", self._owners)

    def _owners(self) -> DataFrame:
        bare = self.nodes.where("kind = 'Interface' AND modport IS NULL").select(F.col("id").alias("owner"))
        kids = self.nodes.where("kind <> 'Port'").select(F.col("id").alias("node"), F.col("parent").alias("owner")).join(bare, "owner", "left_semi").select("node", "owner")
        raw = access_ports(self.nodes, self.edges, self.nodes.select(F.col("parent").alias("modport_id"), "dir")).where("view IS NULL").select(F.col("box").alias("owner"), F.lit(True).alias("raw"))
        return bare.select(F.col("owner").alias("node"), "owner").unionAll(kids).join(raw, "owner", "left").select("node", "owner", F.coalesce("raw", F.lit(False)).alias("raw"))

    def places(self) -> DataFrame:
        """(id, place): kind, parent, whether it is a bundle, its literal if it is a block, the boxes above it with the scopes that show them, and what few nodes have.

        Those are the scope's port at its path, the box of the bundle above a port, the interface around it, bundles that stand for it, the operand of a folded inverter.
        """
        mine = self.boxes.select(F.col("box").alias("id")).distinct()
        nodes = self.nodes.withColumn("bundle", (F.col("kind") == "Interface") & F.col("modport").isNotNull()).withColumn("tie", F.when(F.col("kind").isin("Assign", "Comb"), F.col("const")))
        found = hierarchy.nearest(nodes, mine, carry=("kind", "parent", "bundle", "tie"))
        above = hierarchy.chains(self.nodes, mine, found.where("ancestor IS NOT NULL").select("id", F.col("ancestor").alias("box")))
        shown = self.boxes.select("scope", F.col("box").alias("ancestor"), (F.col("kind") == "Instance").alias("inst"), (F.col("kind") == "Interface").alias("iface"))
        at = above.join(shown, "ancestor").groupBy(F.col("box").alias("ancestor")).agg(F.collect_list(F.struct("scope", F.col("ancestor").alias("box"), "inst", "iface")).alias("at"))
        none = {"own": "long", "grand": "long", "home": "struct<self: boolean, owner: bigint, raw: boolean>", "member": "boolean", "operand": "long"}

        def few(rows: DataFrame, node: str, name: str, value: Column) -> DataFrame:
            return rows.select(F.col(node).alias("id"), *[(value if c == name else F.lit(None)).cast(t).alias(c) for c, t in none.items()])

        bundles = nodes.where("bundle").select(F.col("id").alias("parent"), F.col("parent").alias("grand"))
        rows = few(self.own, "node", "own", F.col("pin")).unionAll(few(nodes.where("kind = 'Port'").select("id", "parent").join(bundles, "parent"), "id", "grand", F.col("grand")))
        rows = rows.unionAll(few(self.owners, "node", "home", F.struct((F.col("node") == F.col("owner")).alias("self"), "owner", "raw"))).unionAll(few(self.members, "node", "member", F.lit(True)))
        if self.gates:
            rows = rows.unionAll(few(self.folds, "inverter", "operand", F.col("operand")))
        rows = rows.groupBy("id").agg(*[F.max(c).alias(c) for c in none])
        place = F.struct("id", "kind", "parent", "bundle", "tie", *none, F.coalesce("at", F.array().cast("array<struct<scope: bigint, box: bigint, inst: boolean, iface: boolean>>")).alias("at"))
        return found.join(at, "ancestor", "left").join(rows, "id", "left").select("id", place.alias("place"))

    def placed(self, edges: DataFrame) -> DataFrame:
        """edges (port, endpoint, ...) with ``p`` and ``q``, the places of both ends; of a port that is a box of logic only the scopes that show it or its parent."""
        places = self.places()
        near = lambda c: F.filter(c["at"], lambda x: (x["box"] == c["id"]) | (x["box"] == c["parent"]))
        logic = F.coalesce(F.col("place.kind").isin(*LOGIC, *GATES), F.lit(False))
        p = F.col("place").withField("at", F.when(logic, near(F.col("place"))).otherwise(F.col("place.at")))
        rows = edges.join(places.select(F.col("id").alias("port"), p.alias("p")), "port", "left")
        rows = rows.join(places.select(F.col("id").alias("endpoint"), F.col("place").alias("q")), "endpoint", "left")
        return rows

    def candidates(self, placed: DataFrame) -> DataFrame:
        """(scope, ..., px, qx, po, qo): placed edges in each scope in which they touch a box, a box's child, or the scope's own pins; the box above either end there, and its own pin."""

        def scopes(p: str) -> list[Column]:
            near = F.filter(f"{p}.at", lambda x: (x["box"] == F.col(f"{p}.id")) | (x["box"] == F.col(f"{p}.parent")))
            mine = F.when(F.col(f"{p}.own").isNotNull(), F.array(f"{p}.parent"))
            return [F.coalesce(c, F.array().cast("array<long>")) for c in (F.transform(near, lambda x: x["scope"]), mine)]

        rows = placed.withColumn("scope", F.explode(F.array_distinct(F.concat(*scopes("p"), *scopes("q")))))
        for p in ("p", "q"):
            rows = rows.withColumn(f"{p}x", F.get(F.filter(f"{p}.at", lambda x: x["scope"] == F.col("scope")), F.lit(0)))
            rows = rows.withColumn(f"{p}o", F.when(F.col(f"{p}.parent") == F.col("scope"), F.col(f"{p}.own")))
            rows = rows.withColumn(p, F.col(p).dropFields("at"))
        return rows

    def pin_candidates(self, edges: DataFrame) -> DataFrame:
        """edges (port, endpoint, dir, sel) as :meth:`candidates` gives them, as far as :meth:`net_pins` looks at them: in the scopes that show the port's box, which is a block of logic or a gate itself, else its parent.

        So nothing above a box is worked out, and of the endpoint only its own row, its scope's pin and the operand behind it are.
        """
        shown = self.boxes.groupBy(F.col("box").alias("of")).agg(F.collect_list(F.struct("scope", "box", (F.col("kind") == "Instance").alias("inst"))).alias("at"))
        logic = F.col("kind").isin(*LOGIC, *GATES)
        ports = self.nodes.where(logic | (F.col("kind") == "Port")).select(F.col("id").alias("port"), F.struct("id", "kind", "parent").alias("p"), F.when(logic, F.col("id")).otherwise(F.col("parent")).alias("of"))
        none = F.lit(None).cast("long")
        few = self.own.select(F.col("node").alias("endpoint"), F.col("pin").alias("own"), none.alias("operand"))
        if self.gates:
            few = few.unionAll(self.folds.select("inverter", none, "operand"))
        few = few.groupBy("endpoint").agg(F.max("own").alias("own"), F.max("operand").alias("operand"))
        far = self.nodes.select(F.col("id").alias("endpoint"), "id", "kind", "parent").join(few, "endpoint", "left").select("endpoint", F.struct("id", "kind", "parent", "own", "operand").alias("q"))
        rows = edges.join(ports.join(shown, "of").drop("of"), "port").join(far, "endpoint", "left")
        rows = rows.withColumn("px", F.explode("at")).drop("at").withColumn("scope", F.col("px.scope"))
        return rows.withColumn("qo", F.when(F.col("q.parent") == F.col("scope"), F.col("q.own"))).withColumn("rank", F.lit(0))

    def _bundled(self) -> DataFrame:
        """(scope, node, box, pin): members that exactly one bundle stands for."""
        return self.members.groupBy("scope", "node").agg(F.count("*").alias("n"), F.min("box").alias("mbox"), F.min("pin").alias("mpin")).where("n = 1").drop("n")

    def anchors(self) -> DataFrame:
        """(scope, node, box, pin): the box and the pin on which each end of an edge is drawn in a scope, edges of logic boxes aside; nodes outside it are left out.

        The scope's own pins come first, then a member that exactly one bundle stands for, then the box above the node.
        """
        rows = self.candidates(self.placed(self.edges.select("port", "endpoint"))).where(~F.coalesce(F.col("p.kind").isin(*self._logic()), F.lit(False)))
        ends = []
        for p, node in (("p", "port"), ("q", "endpoint")):
            box, pin, _ = _anchor(p, f"{p}x", f"{p}o", node)
            ends.append(F.struct(F.col(node).alias("node"), box.alias("box"), pin.alias("pin"), (F.col(f"{p}o").isNull() & F.coalesce(F.col(f"{p}.member"), F.lit(False))).alias("member")))
        rows = rows.select("scope", F.explode(F.array(*ends)).alias("e")).select("scope", "e.node", "e.box", "e.pin.way", "e.pin.a", "e.pin.b", "e.member")
        # an end is the same on each of its edges
        rows = rows.groupBy("scope", "node").agg(*[F.max(c).alias(c) for c in ("box", "way", "a", "b", "member")]).join(self._bundled(), ["scope", "node"], "left")
        bundled = F.col("member") & F.col("mbox").isNotNull()
        rows = rows.select("scope", "node", F.when(bundled, F.col("mbox")).otherwise(F.col("box")).alias("box"), F.when(bundled, _pin(F.col("mpin"))).otherwise(F.struct("way", "a", "b")).alias("pin"))
        return rows.where("box IS NOT NULL").select("scope", "node", "box", _written("pin").alias("pin"))

    def _logic(self) -> tuple[str, ...]:
        return (*LOGIC, *GATES) if self.gates else LOGIC

    def structural(self, cand: DataFrame) -> DataFrame:
        """(scope, rank, source, target, key, sel): edges whose ends are drawn on different boxes, logic boxes' own edges aside."""
        rows = cand.where(~F.coalesce(F.col("p.kind").isin(*LOGIC, *GATES), F.lit(False)))
        (sb, src, sv), (tb, tgt, tv) = _anchor("p", "px", "po", "port"), _anchor("q", "qx", "qo", "endpoint")
        member = lambda p: F.col(f"{p}o").isNull() & F.coalesce(F.col(f"{p}.member"), F.lit(False))
        rows = rows.select("scope", "rank", "port", "endpoint", "sel", sb.alias("sb"), src.alias("src"), tb.alias("tb"), tgt.alias("tgt"), member("p").alias("pm"), member("q").alias("qm"), (sv | tv).alias("view"))
        # ends that bundles stand for, and pins that may meet the port of a view, are few
        few = saved(rows.where("pm OR qm OR view"), "views")
        for node, box, pin, flag in (("port", "sb", "src", "pm"), ("endpoint", "tb", "tgt", "qm")):
            few = few.join(self._bundled().withColumnRenamed("node", node), ["scope", node], "left")
            taken = F.col(flag) & F.col("mbox").isNotNull()
            few = few.withColumn(box, F.when(taken, F.col("mbox")).otherwise(F.col(box))).withColumn(pin, F.when(taken, _pin(F.col("mpin"))).otherwise(F.col(pin))).drop("mbox", "mpin")
        few = few.where("sb <> tb")
        # a bundle's view meets the port of that view on the interface
        views = self.nodes.where("kind = 'Modport'").groupBy("parent", "name").agg(F.min("id").alias("view"))
        far = self.nodes.where("kind = 'Interface' AND modport IS NOT NULL").select(F.col("id").alias("far"), "modport")
        for box, pin, new in (("sb", "tgt", "new_src"), ("tb", "src", "new_tgt")):
            few = few.withColumn("far", F.when(F.col(f"{pin}.way") == _PLAIN, F.col(f"{pin}.a"))).join(far.withColumnRenamed("modport", "m"), "far", "left")
            few = few.join(views.select(F.col("parent").alias(box), F.col("name").alias("m"), F.col("view").alias(new)), [box, "m"], "left").drop("m", "far")
        pick = lambda new, old: F.when(F.col(new).isNotNull(), _pin(F.col(new))).otherwise(F.col(old))
        few = few.select("scope", "rank", pick("new_src", "src").alias("source"), pick("new_tgt", "tgt").alias("target"), F.col("endpoint").alias("key"), "sel")
        plain = rows.where("NOT (pm OR qm OR view) AND sb <> tb").select("scope", "rank", F.col("src").alias("source"), F.col("tgt").alias("target"), F.col("endpoint").alias("key"), "sel")
        return plain.unionAll(few)

    def net_pins(self, cand: DataFrame) -> DataFrame:
        """(scope, key, pin, sel, drives, ord, known): pins on each signal of a scope, and whether a pin drives it or reads it; an inout does both. ``known``: the signal is a node.

        Logic boxes by their edges, gates by their operands and their result (which other gates read under the gate's own id), ports of instances by theirs, the scope's own ports and bundles' pins by their direction from
        inside, raw ports both ways, and a memory drives its own array where that is read. cand has ``rank`` for the order of edges.
        """
        text = lambda c: F.col(c).cast("string")
        kind, none, zero = F.col("p.kind"), F.lit(None).cast("string"), F.lit(0)
        here, out = F.col("px.box") == F.col("port"), F.col("dir") == "out"
        logic, gate = here & kind.isin(*LOGIC), here & kind.isin(*GATES) if self.gates else F.lit(False)
        inst = (kind == "Port") & (F.col("px.box") == F.col("p.parent")) & F.col("px.inst")
        read = gate & F.col("q.operand").isNotNull() & (F.col("dir") != "out") if self.gates else F.lit(False)
        node = F.when(read, F.col("q.operand")).otherwise(F.col("endpoint"))
        pin = F.when(inst, _pin(F.col("port"))).when(gate & out, _pin(F.col("port"), F.col("port"), _OF_BOX)).otherwise(_pin(F.col("port"), node, _OF_BOX))
        way = F.when(inst, F.col("dir")).when(out, "out").otherwise("in")
        rows = cand.where(logic | inst | (gate & F.col("dir").isNotNull())).select("scope", F.when(read, node).otherwise(F.coalesce("qo", "endpoint")).alias("key"), pin.alias("pin"), F.when(~(gate & out), F.col("sel")).alias("sel"), way.alias("way"),
            _order(F.lit(1), F.col("rank")).alias("ord"), F.coalesce(F.col("q.id").isNotNull(), F.lit(False)).alias("known"), F.coalesce((F.col("q.kind") == "Memory") & F.col("qo").isNull(), F.lit(False)).alias("array"), F.coalesce(read, F.lit(False)).alias("read"))
        rows = saved(rows, "pins")
        ports = rows.where("NOT read").drop("read")
        if self.gates:
            # operands behind folded inverters, under the scope's own pin if they have one
            own = self.own.select("scope", F.col("node").alias("key"), F.col("pin").alias("own"))
            ports = ports.unionAll(rows.where("read").join(own, ["scope", "key"], "left").withColumn("key", F.coalesce("own", "key")).select(ports.columns))

        def more(made: DataFrame, key: str, pin: Column, way: Column, fold: int, name: Column) -> DataFrame:
            return made.select("scope", F.col(key).alias("key"), pin.alias("pin"), none.alias("sel"), way.alias("way"), _order(F.lit(fold), zero, name).alias("ord"), F.lit(True).alias("known"), F.lit(fold in (3, 4)).alias("array"))

        def mirrored(made: DataFrame, fold: int) -> DataFrame:
            """(scope, key, id): a pin seen from inside: an input drives."""
            way = F.when(F.col("dir") == "in", "out").when(F.col("dir") == "out", "in").otherwise("inout")
            return more(made.join(self.nodes.select("id", "dir"), "id"), "key", _pin(F.col("id")), way, fold, text("id"))

        mine = self.own.join(self.nodes.where("kind = 'Port'").select(F.col("id").alias("node")), "node", "left_semi")
        bundles = self.members.select("scope", F.col("node").alias("key"), F.col("pin").alias("id")).distinct()
        inner = self.owners.where("raw AND node <> owner").select("node", F.col("owner").alias("box")).join(self.boxes.select("scope", "box"), "box")
        pins = ports.unionAll(mirrored(mine.select("scope", F.col("node").alias("key"), F.col("node").alias("id")), 2)).unionAll(mirrored(bundles, 3))
        pins = pins.unionAll(more(inner, "node", _pin(F.col("box"), way=_RAW), F.lit("inout"), 4, F.concat(F.lit("raw/"), text("box"))))
        itself, name = _pin(F.col("box"), F.col("box"), _OF_BOX), F.concat(text("box"), F.lit("/"), text("box"))
        if self.gates:
            pins = pins.unionAll(more(self.boxes.where(F.col("kind").isin(*GATES)), "box", itself, F.lit("out"), 5, name))
        loads = pins.where("array AND way <> 'out'").select("scope", F.col("key").alias("box")).distinct()
        memory = self.boxes.where("kind = 'Memory'").join(loads, ["scope", "box"], "left_semi")
        pins = pins.unionAll(more(memory, "box", itself, F.lit("out"), 6, name))
        drives = F.when(F.col("way") == "out", F.array(F.lit(True))).when(F.col("way") == "in", F.array(F.lit(False))).otherwise(F.array(F.lit(True), F.lit(False)))
        return pins.select("scope", "key", "pin", "sel", F.explode(drives).alias("drives"), "ord", "known")

    def pins(self) -> DataFrame:
        """(scope, key, pin, sel, drives): the nets of every scope as pins and membership."""
        return self.net_pins(self.pin_candidates(self.edges.select("port", "endpoint", "dir", "sel"))).select("scope", "key", _written("pin").alias("pin"), "sel", "drives")

    def wires(self) -> DataFrame:
        """(scope, source, target, net, constant): every wire of every scope once for its two pins.

        Structural edges come before wires over a signal; among the rest the least edge, signal, driver and load name the wire. A
        driver and a load with different selects don't meet. ``net`` is the signal's path inside the scope with the select, ``constant``
        the literal of a whole net that nothing else drives; constants of boxes' ports are wires without a net.
        """
        ranked = self.edges.repartitionByRange("edge").sortWithinPartitions("edge").select(F.monotonically_increasing_id().alias("rank"), "port", "endpoint", "dir", "sel")
        placed = self._once("placed", lambda: self.placed(saved(ranked, "ranked")))
        cand = self.candidates(placed)
        zero = F.lit(0)
        # what decides between wires of two pins, then what the wire carries
        claim = lambda step, key, d, r: F.struct(F.lit(step).cast("byte").alias("step"), key.cast("long").alias("first"), d.alias("d"), r.alias("l"), (F.col("source") > F.col("target")).alias("turned"), "key", "sel")
        first = self.structural(cand).withColumn("claim", claim(0, zero, _order(zero, F.col("rank")), _order(zero, zero)))
        pins = saved(self.net_pins(cand).where("known").drop("known"), "pins")
        d = pins.where("drives").select("scope", "key", F.col("pin").alias("source"), F.col("sel").alias("ds"), F.col("ord").alias("d"))
        r = pins.where("NOT drives").select("scope", "key", F.col("pin").alias("target"), F.col("sel").alias("ls"), F.col("ord").alias("l"))
        met = d.join(r, ["scope", "key"]).where("source <> target AND (ds IS NULL OR ls IS NULL OR ds = ls)").withColumn("sel", F.coalesce("ds", "ls"))
        met = met.withColumn("claim", claim(1, F.col("key"), F.col("d"), F.col("l")))
        rows = first.select("scope", "source", "target", "claim").unionAll(met.select("scope", "source", "target", "claim"))
        best = rows.groupBy("scope", F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).agg(F.min("claim").alias("w"))
        turned = F.col("w.turned")
        best = best.select("scope", F.when(turned, F.col("b")).otherwise(F.col("a")).alias("source"), F.when(turned, F.col("a")).otherwise(F.col("b")).alias("target"), "w.key", "w.sel")
        driven = placed.where("port <> endpoint AND dir IS NOT NULL AND p IS NOT NULL AND q IS NOT NULL")
        out = F.col("dir") == "out"
        driven = driven.select(F.when(out, F.col("endpoint")).otherwise(F.col("port")).alias("node"), F.when(out, F.col("port")).otherwise(F.col("endpoint")).alias("other"), "sel", F.when(out, F.col("p.tie")).otherwise(F.col("q.tie")).alias("constant"))
        paths = self.nodes.select(F.col("id").alias("key"), "path").join(graph.tied_nodes(self.nodes, driven).withColumnRenamed("id", "key"), "key", "left")
        roots = self.nodes.join(self.scopes, F.col("id") == F.col("scope"), "left_semi").select(F.col("id").alias("scope"), F.col("path").alias("root"))
        best = hierarchy.relative_path(best.join(paths, "key").join(roots, "scope"), "root", "path")
        out = best.select("scope", _written("source").alias("source"), _written("target").alias("target"), F.concat("rel", F.coalesce("sel", F.lit(""))).alias("net"), F.when(F.col("sel").isNull(), F.col("constant")).alias("constant"))
        fixed = self.constants().select("scope", "source", "target", F.lit(None).cast("string").alias("net"), F.lit(None).cast("string").alias("constant"))
        return out.unionAll(fixed)

    def constants(self) -> DataFrame:
        """(scope, source, target, literal): sources of the literals that ports of boxes are tied to."""
        tied = self.nodes.where("kind = 'Port' AND const IS NOT NULL").select(F.col("parent").alias("box"), F.col("id").cast("string").alias("target"), F.col("const").alias("literal"))
        return self.boxes.select("scope", "box").join(tied, "box").select("scope", F.concat(F.lit("const/"), "target").alias("source"), "target", "literal")

    def dangling(self, wires: DataFrame | None = None) -> DataFrame:
        """(scope, box, signal): outputs of logic boxes and gates that no wire of the scope meets; a gate's by the net it drives, null if it drives none.

        No wire is drawn for it, so ``wires`` isn't needed; callers may still give it. What a pin meets on a signal are pins of the other side whose select is none, its own, or any if it has none; the least and the
        greatest of those say whether there is another pin among them. A signal has one row with those of either side, and one a side and select where there are selects.
        """
        pins = saved(self.net_pins(self.pin_candidates(self.edges.select("port", "endpoint", "dir", "sel"))).select("scope", "key", "pin", "sel", "drives", "ord.fold", "known"), "pins")
        drives, bare = F.col("drives"), F.col("sel").isNull()
        ends = lambda name, when: F.when(F.count_if(when) > 0, F.struct(F.min(F.when(when, F.col("pin"))).alias("least"), F.max(F.when(when, F.col("pin"))).alias("most"))).alias(name)
        seen = pins.where("known").groupBy("scope", "key").agg(ends("loads", ~drives), ends("bare_loads", ~drives & bare), ends("drivers", drives), ends("bare_drivers", drives & bare))
        another = lambda c: F.coalesce(F.col("known") & ((c["least"] != F.col("pin")) | (c["most"] != F.col("pin"))), F.lit(False)).alias("wired")
        mine = pins.where(F.col("pin.way") == _OF_BOX)
        far = F.when(drives, F.when(bare, F.col("loads")).otherwise(F.col("bare_loads"))).otherwise(F.when(bare, F.col("drivers")).otherwise(F.col("bare_drivers")))
        met = mine.join(seen, ["scope", "key"], "left").select("scope", F.col("pin.a").alias("box"), F.col("pin.b").alias("signal"), another(far), ((F.col("fold") == 1) & drives).alias("out"), (F.col("fold") == 5).alias("gate"))
        same = pins.where("known AND sel IS NOT NULL").groupBy("scope", "key", (~drives).alias("drives"), "sel").agg(F.struct(F.min("pin").alias("least"), F.max("pin").alias("most")).alias("far"))
        chosen = mine.where("sel IS NOT NULL").join(same, ["scope", "key", "drives", "sel"]).select("scope", F.col("pin.a"), F.col("pin.b"), another(F.col("far")), F.lit(False), F.lit(False))
        met = met.unionAll(chosen).groupBy("scope", "box", "signal").agg(*[F.max(c).alias(c) for c in ("wired", "out", "gate")]).where("NOT wired AND (out OR gate)")
        found = met.where("NOT gate").select("scope", "box", "signal")
        if not self.gates:
            return found
        nets = self.edges.where("dir = 'out'").groupBy(F.col("port").alias("box")).agg(F.min_by("endpoint", "edge").alias("signal"))
        return found.unionAll(met.where("gate").select("scope", "box").join(nets, "box", "left").select("scope", "box", "signal"))


def box_ports(nodes: DataFrame, edges: DataFrame, members: DataFrame) -> DataFrame:
    """(box, pin, name, side, bundle, dangling): pins of instances and interfaces, logic boxes aside.

    A port by its own direction, else its first edge's, mirrored on a bundle, west if there is none; it dangles without an edge of its own and a
    literal. An interface shows its access ports (members as in ``access_ports``), a box also the bundles under it that are connected,
    east if more of their pins are outputs than not.
    """
    text = lambda c: F.col(c).cast("string")
    boxes = nodes.where("kind IN ('Instance', 'Interface')").select(F.col("id").alias("box"), ((F.col("kind") == "Interface") & F.col("modport").isNotNull()).alias("bundled"))
    used = edges.groupBy(F.col("port").alias("id")).agg(F.min_by("dir", "edge").alias("first"))
    kids = nodes.withColumnRenamed("parent", "box").join(used, "id", "left")
    way = F.coalesce("dir", "first")
    side = F.when(way.isNull() | ((way == "out") == F.col("bundled")), "west").otherwise("east")
    ports = kids.where("kind = 'Port'").join(boxes, "box").select("box", text("id").alias("pin"), "name", side.alias("side"), F.lit(False).alias("bundle"), (F.col("first").isNull() & F.col("const").isNull()).alias("dangling"))
    found = access_ports(nodes, edges, members)
    views = nodes.where("kind = 'Modport'").select(F.col("parent").alias("box"), F.col("name").alias("view"), text("id").alias("pin"))
    views = found.join(views, ["box", "view"]).select("box", "pin", F.col("view").alias("name"), "side", F.lit(True).alias("bundle"), F.lit(False).alias("dangling"))
    names = nodes.select(F.col("id").alias("box"), "name")
    raw = found.where("view IS NULL").join(names, "box").select("box", F.concat(F.lit("raw/"), text("box")).alias("pin"), "name", "side", F.lit(True).alias("bundle"), F.lit(False).alias("dangling"))
    pins = nodes.where("kind = 'Port'").groupBy(F.col("parent").alias("id")).agg((F.count_if(F.col("dir") == "out") * 2 > F.count("dir")).alias("outs"))
    bundles = kids.where("kind = 'Interface' AND modport IS NOT NULL AND first IS NOT NULL").join(boxes.select("box"), "box", "left_semi").join(pins, "id", "left")
    label = F.concat("name", F.lit(" ("), "modport", F.lit(")"))
    bundles = bundles.select("box", text("id").alias("pin"), label.alias("name"), F.when(F.col("outs"), "east").otherwise("west").alias("side"), F.lit(True).alias("bundle"), F.lit(False).alias("dangling"))
    return ports.unionAll(views).unionAll(raw).unionAll(bundles)


def interface_interiors(nodes: DataFrame, edges: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pins, wires) inside every interface that has views: pins (iface, box, pin, name, side, bundle), wires (iface, source, target, net, constant).

    members (modport_id, pos, member, dir). A view is a box with a pin ``view/signal`` a member, whose signal is the first node at the interface's path and the
    member's name; a member without one is left out. The interface's own ports stand on its frame, as does a pin ``frame/view`` a view. What one pin drives and
    another reads of a signal is wired once, inouts both ways; the frame of a view leads to its pins, except for signals that an own port carries.
    Constants are those that tie a signal. A view's frame pin stands east if more than half of its members are outputs. No views, no rows.
    """
    text = lambda c: F.col(c).cast("string")
    first = nodes.groupBy("path").agg(F.min("id").alias("key"))
    ifaces = nodes.join(bare_interfaces(nodes), "id", "left_semi").select(F.col("id").alias("iface"), F.col("path").alias("root"))
    views = nodes.where("kind = 'Modport'").select(F.col("id").alias("modport_id"), F.col("parent").alias("iface"), F.col("name").alias("view")).join(ifaces, "iface")
    listed = views.join(members, "modport_id").withColumn("path", F.concat("root", F.lit("."), "member")).join(first, "path")
    listed = listed.select("iface", F.col("modport_id").alias("box"), F.concat(text("modport_id"), F.lit("/"), text("key")).alias("pin"), F.col("member").alias("name"), "dir", "key", "pos", "root", "path")
    own = nodes.where("kind = 'Port'").select(F.col("id").alias("box"), F.col("parent").alias("iface"), "name", "dir", "path").join(ifaces, "iface").join(first, "path")
    side = lambda c: F.when(c == "out", "east").otherwise("west")
    inner = F.when(F.col("dir") == "out", "west").otherwise("east")
    # more than half of all listed members, found or not
    frames = views.join(members.groupBy("modport_id").agg((F.count_if(F.col("dir") == "out") * 2 > F.count("*")).alias("outs")), "modport_id", "left")
    frame = F.concat(F.lit("frame/"), text("modport_id"))
    pins = (
        listed.select("iface", "box", "pin", "name", side(F.col("dir")).alias("side"), F.lit(False).alias("bundle")).distinct()
        .unionAll(own.select("iface", "box", text("box").alias("pin"), "name", inner.alias("side"), F.lit(False)))
        .unionAll(frames.select("iface", F.col("modport_id").alias("box"), frame.alias("pin"), F.col("view").alias("name"), F.when(F.col("outs"), "east").otherwise("west").alias("side"), F.lit(True)))
    )
    # a port of the frame is seen from inside: an input drives
    way = F.when(F.col("dir").isin("in", "out"), F.col("dir")).otherwise("inout")
    turned = F.when(F.col("dir") == "in", "out").when(F.col("dir") == "out", "in").otherwise("inout")
    ends = listed.select("iface", "key", "pin", way.alias("way"), F.struct(F.lit(0).alias("kind"), "box", "pos").alias("at"))
    ends = ends.unionAll(own.select("iface", "key", text("box").alias("pin"), turned.alias("way"), F.struct(F.lit(1).alias("kind"), "box", F.lit(0).alias("pos")).alias("at")))
    d = ends.where("way <> 'in'").select("iface", "key", F.col("pin").alias("source"), F.col("at").alias("da"))
    r = ends.where("way <> 'out'").select("iface", "key", F.col("pin").alias("target"), F.col("at").alias("la"))
    met = d.join(r, ["iface", "key"]).where("source <> target")
    met = met.groupBy("iface", "key", F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).agg(F.min_by(F.struct("source", "target"), F.struct("da", "la")).alias("w")).select("iface", "key", "w.source", "w.target")
    fans = listed.join(own.select("iface", "key"), ["iface", "key"], "left_anti").select("iface", "key", F.concat(F.lit("frame/"), text("box")).alias("source"), F.col("pin").alias("target"))
    groups = graph.signal_groups(nodes)
    ties = groups.join(graph.net_ties(nodes, edges, nodes.select("id", F.col("const").alias("constant"))), "group").select(F.col("id").alias("key"), "constant")
    wires = met.unionAll(fans).join(nodes.select(F.col("id").alias("key"), "path"), "key").join(ifaces, "iface").join(ties, "key", "left")
    wires = hierarchy.relative_path(wires, "root", "path").select("iface", "source", "target", F.col("rel").alias("net"), "constant")
    return pins, wires
