"""Traces: ordered expansions of signals and boxes on boxes and pins, for many traces at once.

A trace is a list of steps, each a walk of some hops from a seed. Its state is kept in tables: the canvas (boxes, and stubs for signals that no box
shows), visited nodes, wires, what was left out. A hop is one round of joins over all traces. What a walk decides in order (the first ``fanout``
connections of a signal, the ``boxes`` that fit on the canvas, which of two wires between two pins stays) is decided by comparing
order keys: the place of the signal in the frontier, then the name of the edge. So a hop costs the same plan however wide it is. A hop reads the
design, but joins and writes only what lies around its signals. Tables of more than ``store.MOST_ROWS`` rows aren't broadcast, unions of them neither; ids are, up to ``MOST_IDS``.

Nodes are (id, kind, name, path, parent, dir, modport, const), edges (edge, port, endpoint, dir, sel). A pin is a string: a node's id, ``box/signal`` for a
pin made for a logic box, ``raw/box`` for what reaches an interface without a view; a stub's pin is its signal's id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netloom.operators import graph, hierarchy
from netloom.operators.graph import Limits
from netloom.operators.schematic import LOGIC, navigable
from netloom.operators.scopegraph import BOXES, access_ports
from netloom.operators.store import sized as saved

SIGNALS = ("Port", "Net", "Var")
_SIGNAL = f"kind IN {SIGNALS}"
#: Ids of what a hop looks at that are broadcast, at most; more are shuffled.
MOST_IDS = 500_000
#: Ids of one block, by which rows are sorted out before a shuffle.
NEAR = 256
STEPS = "trace long, step int, seed long, dir string, depth int, fanout int"


def _text(column: str) -> Column:
    return F.col(column).cast("string")


def homes(nodes: DataFrame) -> DataFrame:
    """(id, home): the nearest box that a node is or lies under; a box is one of ``BOXES`` with a parent. Null for nodes under none, such as top-level nets."""
    boxes = nodes.where(F.col("kind").isin(*BOXES) & F.col("parent").isNotNull()).select("id")
    return hierarchy.nearest(nodes, boxes).withColumnRenamed("ancestor", "home")


def shown_pins(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, box, pin): the pin that a node is drawn on, where a box shows it.

    Instances and interfaces show their ports and the connected bundles under them, whose members share the bundle's pin; an interface without
    a view its inside on one raw pin, if anything reaches it without a view.
    """
    boxes = nodes.where("kind IN ('Instance', 'Interface') AND parent IS NOT NULL").select(F.col("id").alias("box"), "kind", "modport")
    kids = nodes.select(F.col("id").alias("node"), F.col("parent").alias("box"), F.col("kind").alias("nk"), F.col("modport").alias("nm"))
    ports = kids.where("nk = 'Port'").join(boxes.select("box"), "box").select("node", "box", _text("node").alias("pin"))
    used = edges.select(F.col("port").alias("node")).distinct()
    bundles = kids.where("nk = 'Interface' AND nm IS NOT NULL").join(boxes.select("box"), "box").join(used, "node", "left_semi").select("node", "box", _text("node").alias("pin"))
    members = kids.where("nk = 'Port'").select(F.col("node").alias("member"), F.col("box").alias("bundle"))
    members = members.join(bundles.withColumnRenamed("node", "bundle"), "bundle").select(F.col("member").alias("node"), F.col("box").alias("box"), "pin")
    raw = access_ports(nodes, edges, nodes.select(F.col("parent").alias("modport_id"), "dir").limit(0)).where("view IS NULL").select("box")
    bare = boxes.where("kind = 'Interface' AND modport IS NULL").join(raw, "box", "left_semi").select("box", F.concat(F.lit("raw/"), _text("box")).alias("pin"))
    inside = kids.where("nk <> 'Port'").join(bare, "box").select("node", "box", "pin").unionAll(bare.select(F.col("box").alias("node"), "box", "pin"))
    return ports.unionAll(bundles).unionAll(members).unionAll(inside)


def _among(rows: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """Rows whose ``column`` is one of ``ids`` (one column of a written table, each id once), which are broadcast if they are few.

    Of many ids the blocks of ``NEAR`` neighbours are broadcast first, if those are few: only rows of such a block are shuffled.
    """
    wanted, names = ids.select(F.col(ids.columns[0]).alias(column)), rows.columns
    if ids.count() <= MOST_IDS:
        return rows.join(F.broadcast(wanted), column, "left_semi").select(names)
    blocks = saved(wanted.select(F.floor(F.col(column) / NEAR).alias("block")).distinct(), "blocks")
    if blocks.count() <= MOST_IDS:
        rows = rows.join(F.broadcast(blocks), F.floor(F.col(column) / NEAR) == F.col("block"), "left_semi")
    return rows.join(wanted, column, "left_semi").select(names)


class Design:
    """What traces ask of a design. Only twins, nodes that share a path, are worked out for all of it; the rest for what a hop looks at."""

    def __init__(self, nodes: DataFrame, edges: DataFrame) -> None:
        self.nodes, self.edges = nodes, edges
        path = Window.partitionBy("path")
        named = nodes.where("path IS NOT NULL").select("id", "path", F.col("kind").isin(*SIGNALS).alias("signal"))
        named = named.select("id", "signal", F.min("id").over(path).alias("first"), F.count("*").over(path).alias("n"), F.min(F.when(F.col("signal"), F.col("id"))).over(path).alias("least"), F.count_if("signal").over(path).alias("size"))
        # (id, first, group, size): first: the least id of the path; group: that of its signals, a node that is none stands alone
        self.twins = saved(named.where("n > 1").select("id", "first", F.when(F.col("signal"), F.col("least")).otherwise(F.col("id")).alias("group"), F.when(F.col("signal"), F.col("size")).otherwise(1).alias("size")), "twins")

    def grouped(self, rows: DataFrame, column: str, name: str = "group") -> DataFrame:
        """``rows`` with the group of the node in ``column``."""
        twins = self.twins.select(F.col("id").alias(column), F.col("group").alias("__group"))
        return rows.join(twins, column, "left").withColumn(name, F.coalesce("__group", column)).drop("__group")

    def members(self, rows: DataFrame) -> DataFrame:
        """``rows`` (rep, ...) with every node of the group as ``node``."""
        others = self.twins.where("id <> group").select(F.col("group").alias("rep"), F.col("id").alias("node"))
        return rows.withColumn("node", F.col("rep")).unionByName(rows.join(others, "rep"))

    def named(self, rows: DataFrame) -> DataFrame:
        """``rows`` (id, ...) with every node of the id's path, itself included, as ``node``."""
        at = rows.join(self.twins.select("id", "first"), "id", "left")
        others = self.twins.select("first", F.col("id").alias("node"))
        return at.where("first IS NULL").drop("first").withColumn("node", F.col("id")).unionByName(at.join(others, "first").drop("first"))

    def touching(self, ids: DataFrame) -> DataFrame:
        """Edges with an end among ``ids``."""
        ends = _among(self.edges, ids, "port").unionAll(_among(self.edges, ids, "endpoint").join(ids.select(F.col(ids.columns[0]).alias("port")), "port", "left_anti").select(self.edges.columns))
        return saved(ends, "touching")

    def above(self, ids: DataFrame) -> DataFrame:
        """The nodes of ``ids`` and all that they lie under, a round a level."""
        found = level = saved(_among(self.nodes, ids, "id"), "found")
        while True:
            up = level.where("parent IS NOT NULL").select(F.col("parent").alias("id")).distinct().join(found.select("id"), "id", "left_anti")
            up = saved(up, "up")
            if up.isEmpty():
                return found
            level = saved(_among(self.nodes, up, "id"), "found")
            found = saved(found.unionAll(level), "found")

    def beyond(self, boxes: DataFrame) -> DataFrame:
        """(box, edge, next, next_rep): what a walk goes on to from ``boxes`` (box); literals are drawn inline."""
        boxes = saved(boxes.select("box").distinct(), "boxes")
        edges = self.touching(boxes)
        rows = edges.select(F.col("port").alias("box"), "edge", F.col("endpoint").alias("next")).unionAll(edges.where("port <> endpoint").select(F.col("endpoint"), "edge", F.col("port")))
        rows = saved(rows.join(boxes, "box", "left_semi"), "beyond")
        ids = saved(rows.select(F.col("next").alias("id")).distinct(), "ids")
        there = _among(self.nodes.where("path IS NOT NULL OR NOT " + _SIGNAL), ids, "id").where("kind <> 'Const'").select(F.col("id").alias("next"))
        return self.grouped(rows.join(there, "next"), "next", "next_rep")

    def tied(self, keys: DataFrame) -> DataFrame:
        """(key, constant): groups of ``keys`` (key) that one constant drives."""
        near = saved(self.members(keys.select(F.col("key").alias("rep")).distinct()).select(F.col("node").alias("id")).distinct(), "ids")
        edges = self.touching(near)
        ids = near.unionAll(edges.select("port")).unionAll(edges.select("endpoint")).distinct()
        nodes = saved(_among(self.nodes, saved(ids, "ids"), "id"), "nodes")
        ties = graph.net_ties(nodes, edges, nodes.select("id", F.col("const").alias("constant"))).withColumnRenamed("group", "key")
        return ties.join(keys.select("key").distinct(), "key", "left_semi")

    def roots(self, seeds: DataFrame) -> DataFrame:
        """(id, root) of ``seeds`` (id). Blocks above them lead anywhere only if a scope hangs under them."""
        found = self.above(saved(seeds.select("id").distinct(), "ids"))
        under, level = found, found.where("kind = 'GenBlock'").select("id")
        while not level.isEmpty():
            kids = _among(self.nodes, saved(level, "ids"), "parent").join(under.select("id"), "id", "left_anti").select(under.columns)
            kids = saved(kids, "under")
            under, level = saved(under.unionAll(kids), "under"), kids.where("kind = 'GenBlock'").select("id")
        return hierarchy.cone_root(found, navigable(under))


class Around:
    """The edges of some signals (rep) from both of their ends, with the pins that they meet."""

    def __init__(self, design: Design, reps: DataFrame) -> None:
        near = saved(design.members(reps.select("rep").distinct()).select(F.col("node").alias("id")).distinct(), "near")
        walked = design.touching(near)
        ids = saved(near.unionAll(walked.select("port")).unionAll(walked.select("endpoint")).distinct(), "ids")
        # a pin may be that of another node of the path
        found = design.above(saved(design.named(ids).select(F.col("node").alias("id")).distinct(), "ids"))
        nodes, edges = self._with_taps(design, found)
        edges = saved(edges.unionAll(walked), "edges")
        home = saved(homes(found), "homes")
        #: (id, kind): nodes that the hop may meet
        self.kinds = found.select("id", "kind")
        shown = saved(shown_pins(nodes, edges), "pins")
        logic = found.where(F.col("kind").isin(*LOGIC)).select(F.col("id").alias("box"))
        made = edges.select(F.col("port").alias("box"), "endpoint").distinct().join(logic, "box", "left_semi")
        made = made.select("box", "endpoint", F.concat(_text("box"), F.lit("/"), _text("endpoint")).alias("pin"))
        #: (pin, box): pins of boxes
        self.pins = saved(shown.select("pin", "box").unionAll(made.select("pin", "box")).distinct(), "pins")
        at = design.grouped(found.where("path IS NOT NULL OR NOT " + _SIGNAL).select("id", "kind", "path").join(home, "id"), "id")
        at = at.select(F.col("id").alias("node"), "home", F.col("group").alias("rep"), F.when(F.col("kind").isin(*SIGNALS), F.col("group")).alias("free"), F.col("kind").alias("node_kind"), "path")
        both = walked.select("edge", F.col("port").alias("node"), F.col("endpoint").alias("other"), F.lit(True).alias("is_port"), "dir", "sel", "endpoint")
        both = both.unionAll(walked.select("edge", F.col("endpoint"), F.col("port"), F.lit(False), "dir", "sel", "endpoint").where("port <> endpoint")).hint("merge")
        ends = saved(self._anchored(both.join(at, "node"), shown, made, found), "ends")
        far = ends.select("edge", F.col("node").alias("other"), F.col("rep").alias("other_rep"), F.col("home").alias("box"), "pin", "free", F.col("node_kind").alias("other_kind")).distinct()
        own = ends.select("edge", "node", "other", "rep", "is_port", "dir", "sel", F.when(F.col("home") == F.col("node"), F.col("pin")).alias("own_pin")).join(near.select(F.col("id").alias("node")), "node", "left_semi")
        out = graph.drives(F.col("is_port"), F.col("dir"), True)
        rows = own.join(far, ["edge", "other"]).where("is_port OR rep <> other_rep")
        # (rep, edge): the edges of a signal; drives: whether the far end drives it
        self.reach = saved(rows.select("rep", "edge", "node", "other", "other_rep", "other_kind", "sel", "own_pin", "box", "pin", "free", out.alias("out"), (~out).alias("drives")), "reach")
        self.box_kinds = self.kinds.where(F.col("kind").isin(*BOXES)).select(F.col("id").alias("box"), F.col("kind").alias("box_kind"))

    def _with_taps(self, design: Design, found: DataFrame) -> tuple[DataFrame, DataFrame]:
        """``found`` with what decides on the pins of its boxes: what reaches interfaces without a view, and edges of bundles and logic."""
        ports = saved(found.where(F.col("kind").isin(*LOGIC) | ((F.col("kind") == "Interface") & F.col("modport").isNotNull())).select("id"), "ids")
        edges = saved(_among(design.edges, ports, "port"), "edges")
        bare = saved(found.where("kind = 'Interface' AND modport IS NULL").select("id"), "bare")
        if bare.isEmpty():
            return found, edges
        kids = saved(_among(design.nodes, bare, "parent"), "kids")
        taps = saved(_among(design.edges, saved(bare.unionAll(kids.select("id")).distinct(), "ids"), "endpoint"), "taps")
        tapping = saved(_among(design.nodes, saved(taps.select("port").distinct(), "ids"), "id"), "nodes")
        parents = _among(design.nodes, saved(tapping.select("parent").distinct(), "ids"), "id")
        more = kids.unionAll(tapping).unionAll(parents).distinct().join(found.select("id"), "id", "left_anti").select(found.columns)
        return saved(found.unionAll(more), "nodes"), edges.unionAll(taps)

    def _anchored(self, ends: DataFrame, shown: DataFrame, made: DataFrame, nodes: DataFrame) -> DataFrame:
        """Ends of edges with the pin of their box: the node's own, else the far node's inside the box, else that of the node's path; made pins for logic boxes."""
        own = shown.groupBy("node", "box").agg(F.min("pin").alias("pin"))
        mine = own.select("node", F.col("box").alias("home"), F.col("pin").alias("p1"))
        far = own.select(F.col("node").alias("other"), F.col("box").alias("home"), F.col("pin").alias("p2"))
        paths = nodes.select(F.col("id").alias("node"), "path").join(own, "node").groupBy("path", F.col("box").alias("home")).agg(F.min_by("pin", "node").alias("p3"))
        logic = made.select(F.col("box").alias("home"), "endpoint", F.col("pin").alias("p4"))
        rows = ends.join(mine, ["node", "home"], "left").join(far, ["other", "home"], "left").join(paths, ["path", "home"], "left").join(logic, ["home", "endpoint"], "left")
        return rows.withColumn("pin", F.coalesce("p4", "p1", "p2", "p3")).drop("p1", "p2", "p3", "p4", "path", "endpoint")


class Traces:
    """The state of all traces while they walk."""

    def __init__(self, design: Design, steps: DataFrame, limits: Limits) -> None:
        self.design, self.limits, self.round = design, limits, 0
        self.steps = saved(steps, "steps")
        spark = steps.sparkSession
        empty = lambda schema: spark.createDataFrame([], schema)
        # when: order of arrival; a stub is no box
        self.canvas = empty("trace long, id long, boxed boolean, round int")
        self.visited = empty("trace long, node long")
        self.seeds = empty("trace long, rep long, boxed boolean")
        self.wires = empty("trace long, source string, target string, key long, sel string, a string, b string")
        self.more = empty("trace long, pin string, more long")
        self.pins = empty("pin string, box long")

    def walk(self) -> None:
        depths = {r[0]: r[1] for r in self.steps.groupBy("step").agg(F.max(F.greatest("depth", F.lit(1)))).collect()}
        final = max(depths, default=None)
        for step in sorted(depths):
            front = self._started(self.steps.where(F.col("step") == step))
            for hop in range(1, depths[step] + 1):
                asks = self.steps.where((F.col("step") == step) & (F.greatest("depth", F.lit(1)) >= hop))
                front = self._hop(front, asks.select("trace", F.col("dir").alias("way"), F.greatest(F.coalesce("fanout", F.lit(self.limits.fanout)), F.lit(1)).alias("most")), step == final and hop == depths[step])
                if front is None or front.isEmpty():
                    break

    def _started(self, steps: DataFrame) -> DataFrame:
        """The frontier of a step: a box as itself, which comes onto the canvas; a signal with all nodes of its path."""
        d = self.design
        seeds = saved(steps.where("seed IS NOT NULL").select(F.col("seed").alias("id")).distinct(), "ids")
        at = steps.select("trace", F.col("seed").alias("id")).join(_among(d.nodes.select("id", "kind", "path", "parent"), seeds, "id"), "id")
        boxed = F.col("kind").isin(*BOXES) & F.col("parent").isNotNull()
        boxes = at.where(boxed).select("trace", F.col("id").alias("node"))
        plain = d.named(at.where(~boxed).where("path IS NOT NULL").select("trace", "id")).select("trace", "node")
        front = boxes.withColumn("boxed", F.lit(True)).unionAll(plain.withColumn("boxed", F.lit(False)))
        front = saved(front.withColumn("rank", F.row_number().over(Window.partitionBy("trace").orderBy("node"))), "front")
        fresh = front.where("boxed").select("trace", F.col("node").alias("id")).join(self.canvas, ["trace", "id"], "left_anti")
        self.canvas = saved(self.canvas.unionAll(fresh.select("trace", "id", F.lit(True), F.lit(self.round))), "canvas")
        seeds = d.grouped(front, "node", "rep").select("trace", "rep", "boxed")
        self.seeds = saved(self.seeds.unionAll(seeds).groupBy("trace", "rep").agg(F.bool_or("boxed").alias("boxed")), "seeds")
        self.visited = saved(self.visited.unionAll(front.select("trace", "node")).distinct(), "visited")
        return front.select("trace", "node", "rank")

    def _hop(self, front: DataFrame, asks: DataFrame, final: bool) -> DataFrame | None:
        """The next frontier; none after the ``final`` hop, which nothing follows."""
        d, most = self.design, self.limits.boxes
        self.round += 1
        groups = d.grouped(front.join(asks, "trace"), "node", "rep").groupBy("trace", "rep").agg(F.min("rank").alias("rank"), F.first("way").alias("way"), F.first("most").alias("most"))
        groups = saved(groups.join(self.seeds.withColumn("seeded", F.lit(True)), ["trace", "rep"], "left"), "groups")
        near = Around(d, groups)
        self.pins = self.pins.unionAll(near.pins)
        on_boxes = self.canvas.where("boxed").select("trace", F.col("id").alias("box"), F.lit(True).alias("box_on"))
        on_stubs = self.canvas.where("NOT boxed").select("trace", F.col("id").alias("free"), F.lit(True).alias("stub_on"))
        key = F.struct(F.col("rank"), F.lit(0).alias("last"), F.col("edge"))
        rows = groups.join(near.reach, "rep").join(on_boxes, ["trace", "box"], "left").join(on_stubs, ["trace", "free"], "left")
        rows = rows.withColumn("followed", (F.col("way") == "inout") | F.when(F.col("way") == "out", F.col("out")).otherwise(~F.col("out"))).withColumn("key", key)
        rows = rows.withColumns({"ok": F.col("pin").isNotNull() | F.col("free").isNotNull(), "box_on": F.coalesce("box_on", F.lit(False)), "stub_on": F.coalesce("stub_on", F.lit(False))})
        asked, others = rows.where("followed"), rows.where("NOT followed")
        order = Window.partitionBy("trace", "rep").orderBy("edge")

        def first(kept: DataFrame) -> tuple[DataFrame, DataFrame]:
            """(trace, box, at), (trace, free, at): what the kept connections bring onto the canvas, and when."""
            boxes = kept.where("pin IS NOT NULL AND NOT box_on").groupBy("trace", "box").agg(F.min("key").alias("at"))
            return boxes, kept.where("pin IS NULL AND NOT stub_on").groupBy("trace", "free").agg(F.min("key").alias("at"))

        def met(kept: DataFrame) -> DataFrame:
            """Connections against the direction: drawn if the far end was there before the hop, or came by an earlier connection of it."""
            boxes, stubs = first(kept)
            seen = others.where("ok").join(boxes.withColumnRenamed("at", "box_at"), ["trace", "box"], "left").join(stubs.withColumnRenamed("at", "stub_at"), ["trace", "free"], "left")
            drawn = F.when(F.col("box").isNotNull(), F.col("box_on") | (F.col("box_at") < F.col("key"))).otherwise(F.col("stub_on") | (F.col("stub_at") < F.col("key")))
            return seen.where(drawn).drop("box_at", "stub_at")

        sizes = d.twins.where("id = group").select(F.col("id").alias("rep"), "size")

        def own_stubs(kept: DataFrame) -> DataFrame:
            """Groups with a stub of their own: seeds, ports with a backing net, and signals with one side only; ``one``: the side that the stub takes."""
            sides = kept.groupBy("trace", "rep").agg(F.bool_or("drives").alias("d"), F.bool_or(~F.col("drives")).alias("l"))
            at = groups.join(sides, ["trace", "rep"], "left").join(sizes, "rep", "left").join(near.kinds.select(F.col("id").alias("rep"), "kind"), "rep")
            boxed = self.canvas.where("boxed").unionByName(first(kept)[0].select("trace", F.col("box").alias("id"), F.lit(True).alias("boxed"), F.lit(0).alias("round"))).hint("merge")
            at = at.join(boxed.select("trace", F.col("id").alias("rep")).distinct(), ["trace", "rep"], "left_anti")
            has_d, has_l = F.coalesce("d", F.lit(False)), F.coalesce("l", F.lit(False))
            at = at.withColumn("one", F.when(has_d != has_l, F.when(has_d, "load").otherwise("driver")))
            return at.where("kind <> 'Const' AND (one IS NOT NULL OR size > 1 OR seeded)").select("trace", "rep", "rank", "one", (has_d & has_l).alias("both"))

        def items(kept: DataFrame, stubs: DataFrame) -> DataFrame:
            boxes, frees = first(kept)
            last = F.struct(F.col("rank"), F.lit(1).alias("last"), F.lit("").alias("edge"))
            made = boxes.select("trace", F.col("box").alias("id"), F.lit(True).alias("boxed"), "at").unionAll(frees.select("trace", F.col("free").alias("id"), F.lit(False), "at"))
            made = made.unionAll(stubs.select("trace", F.col("rep").alias("id"), F.lit(False), last)).groupBy("trace", "id").agg(F.min_by("boxed", "at").alias("boxed"), F.min("at").alias("at"))
            return made.join(self.canvas.select("trace", "id"), ["trace", "id"], "left_anti")

        fans = asked.where("ok").withColumn("n", F.row_number().over(order)).where("n <= most")
        tried = saved(fans, "tried")
        kept = tried.drop("n").unionByName(met(tried.drop("n")))
        # where the canvas is full: with the last item that it holds, or from the start
        held = self.canvas.groupBy("trace").agg(F.count("*").alias("held"))
        room = groups.select("trace").distinct().join(held, "trace", "left").select("trace", (F.lit(most) - F.coalesce("held", F.lit(0))).alias("room"))
        placed = items(kept, own_stubs(kept)).withColumn("place", F.row_number().over(Window.partitionBy("trace").orderBy("at"))).join(room, "trace")
        start = F.struct(F.lit(-1).alias("rank"), F.lit(0).alias("last"), F.lit("").alias("edge"))
        full = saved(placed.where("place = room").select("trace", F.col("at").alias("full")).unionAll(room.where("room <= 0").select("trace", start.alias("full"))), "full")
        late = (F.col("key") > F.col("full")) & F.col("box").isNotNull() & ~F.col("box_on")
        if full.isEmpty():
            asked = asked.withColumn("refused", F.lit(False))
        else:
            # beyond that only what is on the canvas is met
            came = first(tried)[0].withColumnRenamed("at", "box_at")
            asked = asked.join(full, "trace", "left").join(came, ["trace", "box"], "left")
            asked = asked.withColumn("refused", F.coalesce(late & ~F.coalesce(F.col("box_at") <= F.col("full"), F.lit(False)), F.lit(False))).drop("full", "box_at")
            tried = saved(asked.where("ok AND NOT refused").drop("refused").withColumn("n", F.row_number().over(order)).where("n <= most"), "tried")
        # how many connections of a signal were left out: all after its last one if it has its fill, else what found no room
        ends = tried.where("n = most").select("trace", "rep", F.col("edge").alias("upto"))
        cut = asked.join(ends, ["trace", "rep"], "left").groupBy("trace", "rep").agg(F.count_if((F.col("edge") > F.col("upto")) | (F.col("refused") & (F.col("upto").isNull() | (F.col("edge") < F.col("upto"))))).alias("dropped")).where("dropped > 0")
        kept = tried.drop("n")
        kept = saved(kept.unionByName(met(kept)), "kept")
        stubs = saved(own_stubs(kept), "stubs")
        new = saved(items(kept, stubs), "items")
        self.canvas = saved(self.canvas.unionAll(new.select("trace", "id", "boxed", F.lit(self.round).alias("round"))), "canvas")
        self._wired(groups, kept, stubs, cut)
        if final:
            return None
        lost = asked.where("NOT ok AND box IS NULL").join(ends, ["trace", "rep"], "left").where("upto IS NULL OR edge < upto")
        return self._onwards(near, groups, kept, lost)

    def _wired(self, groups: DataFrame, kept: DataFrame, stubs: DataFrame, cut: DataFrame) -> None:
        """Drivers to loads of each signal, through its stub where both sides are there; a seed box pin to pin. The first wire of two pins stays."""
        ends = kept.select("trace", "rep", "rank", "drives", F.coalesce("pin", F.col("free").cast("string")).alias("pin"), "sel", "edge")
        whole = F.lit(None).cast("string").alias("sel")
        single = stubs.where("one IS NOT NULL").select("trace", "rep", "rank", (F.col("one") == "driver").alias("drives"), _text("rep").alias("pin"), whole, F.lit("~").alias("edge"))
        boxes = groups.where("boxed").select("trace", "rep")
        routed = stubs.where("both").select("trace", "rep", _text("rep").alias("stub"))
        join = ends.unionAll(single).join(boxes, ["trace", "rep"], "left_anti").join(routed, ["trace", "rep"], "left")
        side = lambda way, pin, sel, edge: join.where(("" if way else "NOT ") + "drives").select("trace", "rep", "rank", "stub", F.col("pin").alias(pin), F.col("sel").alias(sel), F.col("edge").alias(edge))
        drivers, loads = side(True, "source", "ds", "de"), side(False, "target", "ls", "le")
        direct = drivers.where("stub IS NULL").drop("stub").join(loads.where("stub IS NULL").drop("stub", "rank"), ["trace", "rep"])
        direct = direct.where("ds IS NULL OR ls IS NULL OR ds = ls").select("trace", "rep", "source", "target", F.coalesce("ds", "ls").alias("sel"), F.struct("rank", F.lit(0).alias("part"), "de", "le").alias("at"))
        inwards = drivers.where("stub IS NOT NULL").select("trace", "rep", "source", F.col("stub").alias("target"), F.col("ds").alias("sel"), F.struct("rank", F.lit(0).alias("part"), "de", F.lit("").alias("le")).alias("at"))
        outwards = loads.where("stub IS NOT NULL").select("trace", "rep", F.col("stub").alias("source"), "target", F.col("ls").alias("sel"), F.struct("rank", F.lit(1).alias("part"), F.lit("").alias("de"), "le").alias("at"))
        near = kept.join(boxes, ["trace", "rep"]).where("own_pin IS NOT NULL")
        far = F.coalesce("pin", F.col("free").cast("string"))
        straight = near.select("trace", "rep", F.when(F.col("drives"), far).otherwise(F.col("own_pin")).alias("source"), F.when(F.col("drives"), F.col("own_pin")).otherwise(far).alias("target"), "sel", F.struct("rank", F.lit(0).alias("part"), F.col("edge").alias("de"), F.lit("").alias("le")).alias("at"))
        wires = direct.unionAll(inwards).unionAll(outwards).unionAll(straight).where("source <> target").withColumns({"a": F.least("source", "target"), "b": F.greatest("source", "target")})
        wires = wires.groupBy("trace", "a", "b").agg(F.min_by(F.struct("source", "target", F.col("rep").alias("key"), "sel"), "at").alias("w")).join(self.wires.select("trace", "a", "b"), ["trace", "a", "b"], "left_anti")
        self.wires = saved(self.wires.unionAll(wires.select("trace", "w.source", "w.target", "w.key", "w.sel", "a", "b")), "wires")
        pins = stubs.select("trace", "rep", _text("rep").alias("pin")).unionAll(ends.select("trace", "rep", "pin").join(stubs, ["trace", "rep"], "left_anti")).hint("merge")
        self.more = saved(self.more.unionAll(cut.join(pins, ["trace", "rep"], "left").groupBy("trace", "pin").agg(F.sum("dropped").alias("more"))), "more")

    def _onwards(self, near: Around, groups: DataFrame, kept: DataFrame, lost: DataFrame) -> DataFrame:
        """The next frontier: signals behind ports that were met, other signals of the boxes, and what a signal without a box leads to."""
        d = self.design
        followed = kept.where("followed")
        at = lambda part, which: F.struct("rank", "edge", F.lit(part).alias("part"), which)
        none = F.lit("").alias("which")
        free = followed.where("pin IS NULL").unionByName(lost.select(*followed.columns)).where("other_rep <> rep")
        free = free.select("trace", F.col("other").alias("node"), F.col("other_rep").alias("group"), at(0, none).alias("at"))
        boxes = followed.where("pin IS NOT NULL")
        walls = boxes.where("other <> box AND other_rep <> rep").drop("node", "rep").join(near.box_kinds.where("box_kind IN ('Instance', 'Interface')"), "box")
        walls = d.members(walls.select("trace", "rank", "edge", F.col("other_rep").alias("rep"))).select("trace", "node", F.col("rep").alias("group"), at(0, F.lpad(_text("node"), 20, "0").alias("which")).alias("at"))
        further = boxes.select("trace", "rep", "rank", "edge", "box").join(d.beyond(boxes).withColumnRenamed("edge", "beyond"), "box").where("next_rep <> rep")
        further = further.select("trace", F.col("next").alias("node"), F.col("next_rep").alias("group"), at(1, F.col("beyond").alias("which")).alias("at"))
        pushed = free.unionAll(walls).unionAll(further).groupBy("trace", "node").agg(F.min("at").alias("at"), F.first("group").alias("group"))
        pushed = pushed.join(self.visited, ["trace", "node"], "left_anti").join(groups.select("trace", F.col("rep").alias("group"), F.col("rank").alias("walked")), ["trace", "group"], "left")
        # a signal that the hop walked before is known by then
        pushed = pushed.where("walked IS NULL OR walked > at.rank").select("trace", "node", F.row_number().over(Window.partitionBy("trace").orderBy("at")).alias("rank"))
        pushed = saved(pushed, "front")
        walked = d.members(groups.select("trace", "rep")).select("trace", "node")
        self.visited = saved(self.visited.unionAll(walked).unionAll(pushed.select("trace", "node")).distinct(), "visited")
        return pushed

    def drawn(self) -> tuple[DataFrame, DataFrame]:
        """(nodes, pins): what stays on the canvas, and how much was left out at which pin.

        Every instance around something on the canvas is a container. A stub that is a port of a box on the canvas gives way to it. What has neither a wire nor
        something left out goes, seeds aside; then containers that hold nothing, from the inside out.
        """
        d = self.design
        found = d.above(saved(self.canvas.select("id").distinct(), "ids"))
        inside = saved(hierarchy.containing_instance(found).where("ancestor IS NOT NULL"), "inside")
        pins = saved(self.pins.distinct(), "pins")
        level, around = self.canvas.select("trace", "id"), None
        while True:
            up = level.join(inside, "id").select("trace", F.col("ancestor").alias("id")).distinct()
            level = saved(up if around is None else up.join(around.hint("merge"), ["trace", "id"], "left_anti"), "around")
            if level.isEmpty():
                break
            around = level if around is None else around.unionAll(level)
        containers = self.canvas.select("trace", "id").limit(0) if around is None else around.join(self.canvas.select("trace", "id"), ["trace", "id"], "left_anti")
        containers = saved(containers, "containers")
        boxes = self.canvas.where("boxed").select("trace", "id", F.lit(False).alias("container")).unionAll(containers.select("trace", "id", F.lit(True)))
        taken = boxes.join(pins, F.col("id") == F.col("box")).select("trace", "pin", "box")
        stubs = self.canvas.where("NOT boxed").select("trace", "id").withColumn("pin", _text("id")).join(taken.select("trace", "pin").distinct(), ["trace", "pin"], "left_anti")
        live = self.wires.select("trace", F.col("source").alias("pin")).unionAll(self.wires.select("trace", F.col("target").alias("pin"))).unionAll(self.more.where("pin IS NOT NULL").select("trace", "pin")).distinct().hint("merge")
        alive = taken.join(live, ["trace", "pin"]).select("trace", F.col("box").alias("id")).unionAll(stubs.join(live, ["trace", "pin"], "left_semi").select("trace", "id"))
        alive = saved(alive.unionAll(self.seeds.select("trace", F.col("rep").alias("id"))).distinct().withColumn("alive", F.lit(True)), "alive")
        nodes = boxes.withColumn("boxed", F.lit(True)).unionByName(stubs.select("trace", "id", F.lit(False).alias("container"), F.lit(False).alias("boxed")))
        nodes = nodes.join(alive, ["trace", "id"], "left").where("alive OR container").join(inside.withColumnRenamed("ancestor", "within"), "id", "left")
        nodes = saved(nodes.select("trace", "id", "boxed", "container", F.coalesce("alive", F.lit(False)).alias("alive"), "within"), "nodes")
        while True:
            holds = nodes.select("trace", F.col("within").alias("id")).distinct()
            gone = saved(nodes.where("container AND NOT alive").select("trace", "id").join(holds, ["trace", "id"], "left_anti"), "gone")
            if gone.isEmpty():
                break
            nodes = saved(nodes.join(gone, ["trace", "id"], "left_anti"), "nodes")
        left = self.more.where("pin IS NOT NULL").groupBy("trace", "pin").agg(F.sum("more").alias("more"))
        kept = nodes.select("trace", "id")
        on = kept.join(pins, F.col("id") == F.col("box")).select("trace", "id", "pin").unionAll(nodes.where("NOT boxed").select("trace", "id", _text("id")))
        shown = on.join(live, ["trace", "pin"]).join(left, ["trace", "pin"], "left").select("trace", F.col("id").alias("node"), "pin", F.coalesce("more", F.lit(0)).alias("more"))
        parents = kept.withColumnsRenamed({"id": "within"}).withColumn("there", F.lit(True))
        nodes = nodes.join(parents, ["trace", "within"], "left").join(found.select("id", "kind"), "id").select("trace", F.col("id").alias("node"), "kind", "boxed", F.when(F.col("there"), F.col("within")).alias("within"))
        return nodes, shown


def trace_graph(nodes: DataFrame, edges: DataFrame, steps: DataFrame, limits: Limits = Limits()) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(nodes, pins, wires, cut) of every trace of ``steps`` (trace, step, seed, dir, depth, fanout).

    nodes (trace, node, kind, boxed, within): boxes, and stubs of signals that no box shows; ``within`` is the instance around one that is drawn as well.
    pins (trace, node, pin, more): pins with a wire or with connections that were left out. wires (trace, source, target, net, constant): ``net`` relative to the scope of
    the trace's first seed, ``constant`` the literal that ties a whole net. cut (trace, root, truncated).

    ``dir``: out follows what reads a signal, in what drives it, inout both; connections against it are drawn to what is on the canvas already. Steps share the
    canvas: ``boxes`` bounds it for the whole trace, except for stubs, seeds and containers; ``fanout`` of a step, if given, stands for that of ``limits``. At least one
    hop and one connection are followed. A seed that isn't a node draws nothing (as the first one, it leaves the root empty), nor does an empty table; edges are taken by name, nodes by id.
    """
    made = Traces(Design(nodes, edges), steps, limits)
    made.walk()
    drawn, pins = made.drawn()
    first = made.steps.groupBy("trace").agg(F.min_by("seed", "step").alias("id"))
    roots = saved(first.join(made.design.roots(first), "id", "left").select("trace", F.coalesce("root", F.lit("")).alias("root")), "roots")
    keys = saved(made.wires.select("key").distinct(), "keys")
    ties = made.design.tied(saved(made.wires.where("sel IS NULL").select("key").distinct(), "keys"))
    wires = made.wires.join(_among(nodes.select(F.col("id").alias("key"), "path"), keys, "key"), "key").join(roots, "trace").join(ties, "key", "left")
    wires = hierarchy.relative_path(wires, "root", "path")
    wires = wires.select("trace", "source", "target", F.concat("rel", F.coalesce("sel", F.lit(""))).alias("net"), F.when(F.col("sel").isNull(), F.col("constant")).alias("constant"))
    cut = roots.join(made.more.groupBy("trace").agg(F.sum("more").alias("more")), "trace", "left").select("trace", "root", F.coalesce(F.col("more") > 0, F.lit(False)).alias("truncated"))
    return drawn, pins, wires, cut


def cone(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, direction: str, limits: Limits = Limits()) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """:func:`trace_graph` of one step from each of ``seeds`` (seed), under the seed's id."""
    steps = seeds.select(F.col("seed").alias("trace"), F.lit(1).alias("step"), "seed", F.lit(direction).alias("dir"), F.lit(limits.depth).alias("depth"), F.lit(None).cast("int").alias("fanout"))
    return trace_graph(nodes, edges, steps, limits)
