"""Scope graphs, tokens and lowering on small inputs, empty tables included."""

from pyspark.sql import functions as F

from netloom.operators import lowering, scopegraph, tokens

NODES = "id long, kind string, name string, path string, parent long, dir string, modport string, const string"
EDGES = "edge string, port long, endpoint long, dir string, sel string"


def test_scope_graph(spark):
    rows = [
        (0, "Instance", "top", "top", None, None, None, None),
        (1, "Port", "a", "top.a", 0, "in", None, None), (2, "Net", "a", "top.a", 0, None, None, None), (3, "Net", "n", "top.n", 0, None, None, None),
        (4, "GenBlock", "g", "top.g", 0, None, None, None), (5, "Instance", "u", "top.g.u", 4, None, None, None),
        (6, "Port", "i", "top.g.u.i", 5, "in", None, None), (7, "Port", "o", "top.g.u.o", 5, "out", None, None), (8, "Port", "t", "top.g.u.t", 5, "in", None, "1'b1"),
        (9, "FF", "f", "top.f", 0, None, None, None), (10, "Net", "q", "top.q", 0, None, None, None),
    ]
    edges = [("a", 6, 2, "in", None), ("b", 7, 3, "out", "[1]"), ("c", 9, 3, "in", "[1]"), ("d", 9, 10, "out", None), ("e", 9, 3, "in", "[0]")]
    made = scopegraph.Scopes(spark.createDataFrame(rows, NODES), spark.createDataFrame(edges, EDGES))
    assert sorted((r.scope, r.box) for r in made.boxes.collect()) == [(0, 5), (0, 9), (4, 5)]
    wires = made.wires()
    got = {(r.scope, r.source, r.target, r.net) for r in wires.collect()}
    assert {w for w in got if w[0] == 0} == {(0, "6", "1", "a"), (0, "7", "9/3", "n[1]"), (0, "const/8", "8", None)}
    assert sorted((r.scope, r.box, r.signal) for r in made.dangling(wires).collect()) == [(0, 9, 10)]


def test_dangling_without_wires(spark):
    """No pair of pins is needed: a block that reads what it alone drives dangles, as does one whose select nobody reads."""
    rows = [(0, "Instance", "top", "top", None, None, None, None), (1, "Net", "n", "top.n", 0, None, None, None), (2, "Net", "m", "top.m", 0, None, None, None), (3, "Net", "k", "top.k", 0, None, None, None)]
    rows += [(i, "FF", f"f{i}", f"top.f{i}", 0, None, None, None) for i in range(10, 16)]
    edges = [("a", 10, 1, "out", None), ("b", 10, 1, "in", None), ("c", 11, 2, "out", "[0]"), ("d", 12, 2, "in", "[1]"), ("e", 13, 2, "out", "[1]"), ("f", 14, 3, "out", "[2]"), ("g", 15, 3, "in", None), ("h", 15, 9, "out", None)]
    made = scopegraph.Scopes(spark.createDataFrame(rows, NODES), spark.createDataFrame(edges, EDGES))
    assert sorted(tuple(r) for r in made.dangling().collect()) == [(0, 10, 1), (0, 11, 2), (0, 15, 9)]


def test_scope_graph_of_nothing(spark):
    made = scopegraph.Scopes(spark.createDataFrame([], NODES), spark.createDataFrame([], EDGES))
    assert made.wires().isEmpty()


def classed(spark, text, language=None):
    rows = tokens.tokenize(spark.createDataFrame([(1, text, language)], "file long, text string, language string")).orderBy("line", "token").collect()
    return [(r.line, r.cls, r.text) for r in rows]


def test_tokens(spark):
    assert classed(spark, "assign x=//c\n`a /* b\n*/ 4'hF'z", "v") == [
        (0, "keyword", "assign"), (0, "plain", " x"), (0, "operator", "=//"), (0, "plain", "c"),
        (1, "directive", "`a"), (1, "plain", " "), (1, "comment", "/* b"), (2, "comment", "*/"), (2, "plain", " "), (2, "number", "4'hF"), (2, "plain", "'z"),
    ]
    assert classed(spark, 'if(x) "open\nint8_t y; // z', "C") == [
        (0, "keyword", "if"), (0, "plain", "(x) "), (0, "string", '"open'), (1, "type", "int8_t"), (1, "plain", " y; "), (1, "comment", "// z"),
    ]
    assert classed(spark, None) == [] and classed(spark, "") == [] and classed(spark, "if", "lisp") == [(0, "plain", "if")]


def test_tokens_of_long_texts(spark):
    for text in ("a " * 300_000, '"' + "x" * 500_000, "/*" + "\ty" * 250_000):
        assert "".join(t for _, _, t in classed(spark, text)) == text


def test_overlay(spark):
    made = spark.createDataFrame([(1, 0, 0, "ab cd", "plain"), (1, 0, 1, "// ab", "comment")], "file long, line int, token int, text string, cls string")
    refs = spark.createDataFrame([(1, 0, 4, 2, "port"), (1, 0, 5, 1, "net"), (1, 0, 5, 3, "far"), (1, 0, 9, 2, "none")], "file long, line int, col int, len int, name string")
    got = [(r.text, r.cls) for r in tokens.overlay(made, refs).orderBy("piece").collect()]
    assert got == [("ab ", "plain"), ("cd", "name-port"), ("// ab", "comment")]
    assert tokens.overlay(made.limit(0), refs).isEmpty() and tokens.overlay(made, refs.limit(0)).count() == 2


def test_lowering(spark):
    nodes = spark.createDataFrame([(1, "Net", "p.q"), (2, "Var", "p.c"), (3, "Port", "p.d"), (4, "Memory", "p.m")], "id long, kind string, path string")
    uses = lambda *paths: spark.createDataFrame([(9, p) for p in paths], "block long, path string")
    selects = spark.createDataFrame([(9, "p.d", "[0]"), (9, "p.q", "[0]"), (9, "p.q", "[1]")], "block long, path string, sel string")
    got = lowering.logic_edges(nodes, uses("p.q", "p.c", "p.d", "p.m", "p.z"), uses("p.q"), uses("p.c"), selects)
    assert sorted((r.endpoint, r.dir, r.sel) for r in got.collect()) == [(1, "out", None), (2, "in", None), (3, "in", "[0]")]
    names = spark.createDataFrame([("x.c", "rtl"), ("/gone/y.c", "rtl")], "ref string, dir string")
    none = spark.createDataFrame([], "source string")
    got = lowering.resolved_sources(names, [], none.unionAll(spark.createDataFrame([("s/y.c",)], "source string")), none)
    assert {r.ref: r.source for r in got.collect()} == {"x.c": "rtl/x.c", "/gone/y.c": "s/y.c"}
    assert lowering.resolved_sources(names.where(F.lit(False)), [], none, none).isEmpty()


def test_gates(spark):
    """~b & a into q inside an assign: the inverter is a bubble; a block without gates and a register stay."""
    rows = [
        (0, "Instance", "top", "top", None, None, None, None), (1, "Net", "a", "top.a", 0, None, None, None), (2, "Net", "b", "top.b", 0, None, None, None), (3, "Net", "q", "top.q", 0, None, None, None),
        (4, "Assign", "", "top.$4", 0, None, None, None), (5, "And", "and", "top.$4.$5", 4, None, None, None), (6, "Not", "not", "top.$4.$6", 4, None, None, None), (7, "Const", "", "top.$4.$7", 4, None, None, "1'b1"),
        (8, "FF", "f", "top.f", 0, None, None, None), (9, "Comb", "", "top.$9", 0, None, None, None), (10, "Not", "not", "top.$9.$10", 9, None, None, None), (11, "Assign", "", "top.$11", 0, None, None, None), (12, "Net", "z", "top.z", 0, None, None, None),
    ]
    edges = [("a", 5, 1, "in", "[0]"), ("b", 5, 6, "in", None), ("c", 6, 2, "in", None), ("d", 5, 3, "out", None), ("e", 5, 7, "in", None), ("f", 8, 1, "out", "[0]"), ("g", 8, 3, "in", None), ("h", 8, 2, "out", None), ("i", 10, 2, "in", None), ("j", 10, 12, "out", None), ("k", 11, 1, "in", "[1]"), ("l", 4, 3, "out", None)]
    nodes, links = spark.createDataFrame(rows, NODES), spark.createDataFrame(edges, EDGES)
    made = scopegraph.Scopes(nodes, links, gates=True)
    assert sorted((r.box, r.kind) for r in made.boxes.collect()) == [(5, "And"), (8, "FF"), (10, "Not"), (11, "Assign")]
    wires = made.wires()
    assert {(r.source, r.target, r.net) for r in wires.collect()} == {("8/1", "5/1", "a[0]"), ("8/2", "5/2", "b"), ("5/5", "8/3", "q"), ("8/2", "10/2", "b")}
    assert [tuple(r) for r in made.dangling(wires).collect()] == [(0, 10, 12)]
    pins = {(r.gate, r.pin): (r.name, r.side, r.role, r.constant) for r in scopegraph.gate_pins(nodes, links).collect()}
    assert pins == {(5, "5/1"): ("a", "west", None, None), (5, "5/2"): ("b", "west", "inv", None), (5, "5/7"): ("", "west", None, "1'b1"), (5, "5/5"): ("", "east", None, None), (10, "10/2"): ("b", "west", None, None), (10, "10/10"): ("", "east", None, None)}
    plain = scopegraph.Scopes(nodes, links)
    assert sorted(r.box for r in plain.boxes.collect()) == [4, 8, 9, 11]


def test_interface_interior(spark):
    rows = [
        (0, "Instance", "top", "top", None, None, None, None), (1, "Interface", "i", "top.i", 0, None, None, None), (2, "Port", "clk", "top.i.clk", 1, "in", None, None), (3, "Net", "v", "top.i.v", 1, None, None, None),
        (4, "Net", "d", "top.i.d", 1, None, None, None), (5, "Modport", "m", "top.i.m", 1, None, None, None), (6, "Modport", "s", "top.i.s", 1, None, None, None), (7, "Interface", "j", "top.j", 0, None, None, None),
    ]
    members = [(5, 0, "clk", "in"), (5, 1, "v", "out"), (5, 2, "d", "inout"), (6, 0, "v", "in"), (6, 1, "d", "inout"), (6, 2, "none", "in")]
    nodes, links = spark.createDataFrame(rows, NODES), spark.createDataFrame([], EDGES)
    pins, wires = scopegraph.interface_interiors(nodes, links, spark.createDataFrame(members, "modport_id long, pos int, member string, dir string"))
    assert {(r.source, r.target, r.net) for r in wires.collect()} == {("2", "5/2", "clk"), ("5/3", "6/3", "v"), ("5/4", "6/4", "d"), ("frame/5", "5/3", "v"), ("frame/5", "5/4", "d"), ("frame/6", "6/3", "v"), ("frame/6", "6/4", "d")}
    assert {(r.box, r.pin, r.side, r.bundle) for r in pins.collect()} == {(2, "2", "east", False), (5, "5/2", "west", False), (5, "5/3", "east", False), (5, "5/4", "west", False), (6, "6/3", "west", False), (6, "6/4", "west", False), (5, "frame/5", "west", True), (6, "frame/6", "west", True)}


def test_boxes_need_no_pins(spark):
    """What only pins and wires need isn't worked out for the boxes of the gate level."""
    nodes = spark.createDataFrame([(0, "Instance", "top", "top", None, None, None, None), (1, "Assign", "a", "top.a", 0, None, None, None), (2, "And", "g", "top.a.g", 1, None, None, None)], NODES)
    made = scopegraph.Scopes(nodes, spark.createDataFrame([], EDGES), gates=True)
    assert [tuple(r) for r in made.boxes.collect()] == [(0, 2, "And")] and not made._tables


def test_pins_need_nothing_above_a_box(spark, monkeypatch):
    """Pins on nets and what dangles are told by a port's own box; a select meets its own and none, a pin without one meets any."""
    nodes = [(0, "Instance", "top", "top", None)] + [(k, "Net", f"n{k}", f"top.n{k}", 0) for k in (1, 2)] + [(k, "Assign", f"a{k}", f"top.a{k}", 0) for k in (10, 11, 12, 13)]
    edges = [("e1", 10, 1, "out", "[0]"), ("e2", 11, 1, "in", "[1]"), ("e3", 12, 2, "out", "[0]"), ("e4", 13, 2, "in", "[0]"), ("e5", 13, 1, "out", None)]
    made = scopegraph.Scopes(spark.createDataFrame([n + (None, None, None) for n in nodes], "id long, kind string, name string, path string, parent long, dir string, modport string, const string"), spark.createDataFrame(edges, "edge string, port long, endpoint long, dir string, sel string"))

    def none(*args, **more):
        raise AssertionError("nothing above a box is asked for")

    for name in ("nearest", "chains"):
        monkeypatch.setattr(scopegraph.hierarchy, name, none)
    assert sorted(tuple(r) for r in made.dangling().collect()) == [(0, 10, 1)]
    assert {(r.pin, r.drives) for r in made.pins().collect()} == {("10/1", True), ("11/1", False), ("12/2", True), ("13/2", False), ("13/1", True)}
