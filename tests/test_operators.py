"""Expected values on small inputs."""

import json
import random

import pytest
from pyspark.sql import functions as F

from netloom.functions import bits
from netloom.operators import files, graph, hierarchy, linkage, lookup, quality, schematic, scopegraph, spans, waves
from netloom.sources import model, synthetic, vcd
from netloom.streaming import last_value


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, (str, type(None))) else 'long'}" for k, v in values.items()))
    return row.select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("value", "radix", "shown"),
    [("11000", "hex", "18"), ("1010", "hex", "a"), ("0000", "hex", "0"), ("1010", "oct", "12"), ("11000", "dec", "24"), ("00011000", "bin", "11000"), ("1x00", "hex", "x"), ("1x00", "dec", "x"), ("", "hex", ""), ("1" * 64, "dec", str(2**64 - 1)), ("1" * 70, "hex", "3" + "f" * 17)],
)
def test_format_value(spark, value, radix, shown):
    assert one(spark, bits.format_value(F.col("v"), radix), v=value) == shown


@pytest.mark.parametrize(("value", "high", "low", "part"), [("00011000", 4, 2, "110"), ("1010", 3, 3, "1"), ("1010", 99, 0, "1010"), ("1010", 2, -5, "010"), ("1010", 0, 3, "")])
def test_slice_bits(spark, value, high, low, part):
    assert one(spark, bits.slice_bits(F.col("v"), high, low), v=value) == part


@pytest.mark.parametrize(("value", "shown"), [("00000018", "18"), ("00000000", "0"), ("0001x0", "1x0"), ("", "")])
def test_trim_bus(spark, value, shown):
    assert one(spark, bits.trim_bus(F.col("v")), v=value) == shown


def test_windows_and_scales(spark):
    assert bits.display_scale("ns", "us") == pytest.approx(1e-3) and bits.display_scale("ns", "ps") == pytest.approx(1e3)
    assert bits.display_scale("ps", "ns", 10) == pytest.approx(0.01) and bits.display_scale("?", "ns") == 1
    for a, b, by, want in ((100, 300, 50, (150, 350)), (100, 300, -500, (0, 200)), (800, 1000, 500, (800, 1000))):
        c = bits.pan_window(F.lit(a), F.lit(b), F.lit(by), F.lit(0), F.lit(1000))
        assert tuple(spark.range(1).select(c[0].alias("a"), c[1].alias("b")).first()) == want
    c = bits.zoom_window(F.lit(0), F.lit(1000), 0.5, F.lit(500), F.lit(0), F.lit(1000))
    assert tuple(spark.range(1).select(c[0].alias("a"), c[1].alias("b")).first()) == (250.0, 750.0)


def test_waves(spark):
    changes = spark.createDataFrame([(1, 0, "0"), (1, 10, "1"), (1, 20, "0")], "sig long, t long, v string")
    probes = spark.createDataFrame([(1, t) for t in (5, 10, 15, 99, -1, 7, 4, 100)] + [(2, 5)], "sig long, at long")
    got = {(r.sig, r["at"]): r.value for r in waves.value_at(changes, probes).collect()}
    assert [got[1, t] for t in (5, 10, 15, 99, -1)] == ["0", "1", "1", "0", ""] and got[2, 5] == ""
    near = {(r.sig, r["at"]): r.edge for r in waves.nearest_edge(changes, probes).collect()}
    assert [near[1, t] for t in (7, 4, 100, 5)] == [10, 0, 20, 0] and near[2, 5] is None
    shown = {r.t: r.shown for r in waves.at_edges(changes).collect()}
    assert shown == {0: "0", 10: "0 -> 1", 20: "1 -> 0"}
    two = changes.where("t < 20")
    assert sorted((r.t0, r.t1, r.v) for r in waves.segments(two, 25).collect()) == [(0, 10, "0"), (10, 25, "1")]
    late = spark.createDataFrame([(1, 40, "1")], "sig long, t long, v string")
    assert [(r.t0, r.t1) for r in waves.segments(late, 25).collect()] == [(40, 40)]
    assert waves.max_time(changes.limit(0)).first().max_time == 1


NODES = "id long, kind string, name string, path string, parent long"


def test_names(spark):
    opts = linkage.Options(top="soc", excluded=("TOP", "tb", "soc_pkg"))
    names = ["TOP.tb.dut.g_lane[0].bus.valid", "TOP.tb.dut.core.cpuregs.[5]", "TOP.tb.dut.core.genblk1.foo", "TOP.tb.N_CORES", "TOP.soc_pkg.XLEN", "OTHER.weird.sig"]
    rows = spark.createDataFrame([(k, n, False) for k, n in enumerate(names)], "var_ref long, full_name string, is_parameter boolean")
    got = {r.var_ref: (r["class"], r.target, r.rules) for r in linkage.classified(rows, ("TOP", "tb", "dut"), opts).collect()}
    assert got[0] == ("in", "soc.g_lane[0].bus.valid", ["AnchorRebase"])
    assert got[1] == ("in", "soc.core.cpuregs", ["AnchorRebase", "ArrayElement"])
    assert got[2] == ("in", "soc.core.foo", ["AnchorRebase", "GenBlockFlatten"])
    assert got[3][0] == got[4][0] == "excluded" and got[5][0] == "out"


def test_aliases_are_refused_when_ambiguous(spark):
    nodes = spark.createDataFrame([(1, "Net", "x", "top.a.x", None), (2, "Net", "x", "top.b.x", None), (3, "Net", "y", "top.c.y", None), (4, "Param", "P", "top.P", None)], NODES)
    names = ["TB.a.b.x", "TB.h.c.y", "TB.P", "TB.a.x", "TB.a.z"]
    rows = spark.createDataFrame([(k, n, False) for k, n in enumerate(names)], "var_ref long, full_name string, is_parameter boolean")
    found = linkage.matched(rows, nodes, linkage.Options(excluded=(), anchor=("TB",)))
    assert {r.var_ref: (r.status, r.node) for r in found.collect()} == {0: ("unmatched", None), 1: ("alias", 3), 2: ("parameter", None), 3: ("direct", 1), 4: ("unmatched", None)}
    report = linkage.report(found.where("status = 'parameter'")).first()
    assert report.hit_rate == 1.0 and report.passes


def test_incidence_has_a_loop_once(spark):
    edges = spark.createDataFrame([("0", 1, 2, "in", None), ("1", 1, 0, "out", None), ("2", 2, 2, "in", None), ("3", 0, 1, "in", None)], "edge string, port long, endpoint long, dir string, sel string")
    rows = lookup.incident(edges).collect()
    assert sorted(r.edge for r in rows if r.node == 2) == ["0", "2"] and not [r for r in rows if r.node == 3]


def test_cone_reports_what_it_drops(spark):
    edges = spark.createDataFrame([(f"{k}", 0, k, "out", None) for k in range(1, 11)] + [("x", 1, 20, "out", None)], "edge string, port long, endpoint long, dir string, sel string")
    seeds = spark.createDataFrame([(0,)], "seed long")
    seen, cut = graph.cone(edges, seeds, graph.Limits(depth=3, fanout=4, boxes=100))
    assert {r.node for r in seen.collect()} == {0, 1, 2, 3, 4, 20} and cut.first().more == 6 and cut.first().truncated
    seen, cut = graph.cone(edges, seeds, graph.Limits(depth=3, fanout=100, boxes=5))
    assert seen.count() == 5 and cut.first().more >= 6
    seen, cut = graph.cone(edges, seeds)
    assert seen.count() == 12 and not cut.first().truncated
    assert graph.cone(edges, seeds, forward=False)[0].count() == 1


def test_spans(spark):
    files = spark.createDataFrame([("f", "abcd\nef\n" + "x" * 6 + "\nq")], "file string, text string")
    starts = spans.lines(files)
    assert [(r.line, r.start, r.bytes) for r in starts.orderBy("line").collect()] == [(0, 0, 4), (1, 5, 2), (2, 8, 6), (3, 15, 1)]
    want = {(5, 14): (1, 2), (0, 5): (0, 0), (8, 8): (2, 2), (0, 16): (0, 3), (99, 120): (3, 3), (-4, 6): (0, 1)}
    rows = spark.createDataFrame([("f", a, b) for a, b in want], "file string, lo long, hi long")
    assert {(r.lo, r.hi): (r.first, r.last) for r in spans.line_range(starts, rows).collect()} == want
    ranges = spark.createDataFrame([("f", 1, 0, 10), ("f", 2, 4, 8), ("f", 3, 20, 20)], "file string, id long, lo long, hi long")
    probes = spark.createDataFrame([("f", k) for k in (5, 9, 20, 30)], "file string, offset long")
    hits = spans.stabbed(ranges, probes, cell=4)
    assert sorted((r.offset, r.id) for r in hits.collect()) == [(5, 1), (5, 2), (9, 1), (20, 3)]
    assert sorted((r.offset, r.id) for r in spans.narrowest(hits).collect()) == [(5, 2), (9, 1), (20, 3)]
    notes = spark.createDataFrame([("f", k, t) for k, t in enumerate(("assign x = y; // foo.cpp:12", "nothing", "// see top.v:12", "// host.com:80", r"// src\k.hpp:7 a.c:1", "// a.c:123456789012345678901"))], "file string, line int, text string")
    assert [(r.line, r.source, r.source_line) for r in spans.provenance(notes).orderBy("line").collect()] == [(0, "foo.cpp", 12), (4, r"src\k.hpp", 7), (5, "a.c", None)]
    assert [(r.line, r.source) for r in spans.provenance(notes, r"// see (\w+\.v):(\d+)").collect()] == [(2, "top.v")]


def test_files(spark):
    table = spark.createDataFrame([(1, "b/x.sv", 9), (2, "a/x.sv", 3), (3, "x.sv/y", 1)], "id long, path string, place int")
    names = spark.createDataFrame([("x.sv",), ("b/x.sv",), ("y",), ("z",)], "name string")
    assert {(r.name, r.id) for r in files.by_name(table, names, "place").collect()} == {("x.sv", 2), ("b/x.sv", 1), ("y", 3)}
    specs = spark.createDataFrame([(s,) for s in ("x.sv:5", "7:12", "a/x.sv:0", "z:1", "y:99999999999999999999", "y:-1", "y", "1:2:3")], "spec string")
    assert {tuple(r) for r in files.resolved_offsets(table, specs).collect()} == {("x.sv:5", 1, 5), ("7:12", 7, 12), ("a/x.sv:0", 2, 0)}
    text = "# all\r\n\tb\t# x\r\na\r\n  c d //e\n\n\t\r\n"
    assert one(spark, F.array_join(files.excluded_lines(F.col("v")), "|"), v=text) == "b|a|c d"


def test_cycles(spark):
    """Parents in a ring, and a tree under it: walks upwards end."""
    rows = [(1, "Instance", 2), (2, "Net", 3), (3, "Net", 1), (4, "Net", 1), (5, "GenBlock", 6), (6, "GenBlock", 5), (7, "FF", 5), (8, "Instance", None), (9, "Net", 8)]
    nodes = spark.createDataFrame([(i, k, f"n{i}", f"p{i}", p) for i, k, p in rows], "id long, kind string, name string, path string, parent long")
    found = {r.id: r.ancestor for r in hierarchy.nearest_ancestor(nodes).collect()}
    assert found == {1: 1, 2: 1, 3: 1, 4: 1, 5: None, 6: None, 7: None, 8: 8, 9: 8}
    assert {r.id: r.ancestor for r in hierarchy.containing_instance(nodes).collect()}[1] == 1
    inside = hierarchy.within(nodes, nodes.where("kind IN ('Instance', 'GenBlock')").select("id"))
    assert sorted((r.id, r.box) for r in inside.collect()) == [(1, 1), (2, 1), (3, 1), (4, 1), (5, 5), (5, 6), (6, 5), (6, 6), (7, 5), (7, 6), (8, 8), (9, 8)]
    boxes = scopegraph.scope_boxes(nodes, nodes.select(F.col("id").alias("scope")))
    assert sorted((r.scope, r.box) for r in boxes.collect()) == [(2, 1), (5, 7), (6, 7)]
    gates = spark.createDataFrame([(1, "+"), (2, "+"), (3, "+"), (4, "+"), (5, "*"), (6, "*"), (7, "+")], "id long, op string")
    links = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 1), (5, 6), (7, 6)], "child long, parent long")
    assert {r.id: r.root for r in schematic.associative_roots(gates, links).collect()} == {1: 1, 2: 2, 3: 3, 4: 4, 5: 6, 6: 6, 7: 7}


def test_literals_and_enums(spark):
    rng = random.Random(1)
    wide = [rng.getrandbits(n) | 1 << (n - 1) for n in (63, 64, 65, 127, 128, 4096)]
    cases = [("2'd2", 2), ("4'hA", 10), ("3'b001", 1), ("8'b1010_1010", 170), ("12", 12), ("8'so17", 15), ("4'd0", 0), ("4'b1x", None), ("W+1", None), ("8'h", None)]
    cases += [(f"{base}{n:{form}}", n) for n in wide for base, form in (("4096'h", "x"), ("'o", "o"), ("4096'sb", "b"), ("4096'd", "d"), ("", "d"))]
    rows = spark.createDataFrame([(k, v) for k, (v, _) in enumerate(cases)], "k int, v string").select("k", quality.parse_int(F.col("v")).alias("n")).collect()
    assert {r.k: r.n for r in rows} == {k: None if n is None else str(n) for k, (_, n) in enumerate(cases)}
    for n in (*wide, 0, 1, 999_999_999, 10**18 - 1):
        assert one(spark, bits.plus(F.col("v"), F.lit(7)), v=str(n)) == str(n + 7)
        assert one(spark, bits.format_value(F.col("v"), "dec"), v=f"000{n:b}") == str(n)
        assert one(spark, bits.format_value(F.col("v"), "hex"), v=f"000{n:b}") == f"{n:x}" and one(spark, bits.format_value(F.col("v"), "oct"), v=f"{n:b}") == f"{n:o}"
    rows = [("a", 0, "A", None), ("a", 1, "B", "3'd5"), ("a", 2, "C", None), ("b", 0, "X", "1'bx"), ("b", 1, "Y", None), ("c", 0, "P", f"'h{2**70:x}"), ("c", 1, "Q", None), ("c", 2, "R", None)]
    got = quality.enum_values(spark.createDataFrame(rows, "type string, pos int, name string, literal string"))
    assert {r.name: r.value for r in got.collect()} == {"A": "0", "B": "5", "C": "6", "P": str(2**70), "Q": str(2**70 + 1), "R": str(2**70 + 2)}


def test_vcd(spark, tmp_path):
    path = tmp_path / "t.vcd"
    path.write_text("$timescale 10 ps $end\n$scope module top $end\n$var wire 1 ! clk $end\n$scope module u $end\n$var reg 4 # q [3:0] $end\n$var parameter 4 # P [3:0] $end\n$upscope $end\n$upscope $end\n$enddefinitions $end\n$dumpvars\n0!\nb0000 #\n$end\n#10\n1!\nb10x1 #\n")
    vcd.register(spark)
    load = lambda t: spark.read.format("vcd").option("table", t).load(str(path)).drop("file").collect()
    assert [tuple(r) for r in load("vars")] == [(0, 0, "top.clk", False), (1, 1, "top.u.q", False), (2, 1, "top.u.P", True)]
    assert [(r.signal_ref, r.time, r.value) for r in load("changes")] == [(0, 0, "0"), (1, 0, "0000"), (0, 10, "1"), (1, 10, "10x1")]
    assert tuple(load("timescale")[0]) == (10, "ps")


def _document(child):
    node = lambda i, kind, path, parent, kids: {"id": i, "kind": kind, "name": path.split(".")[-1], "path": path, "parent": parent, "children": kids, "drivers": [], "loads": []}
    return {"schema_version": 1, "design": "d", "files": [{"id": 0, "path": "a.sv"}], "nodes": [node(0, "Instance", "top", None, [child]), node(1, "Net", "top.x", 0, [])], "edges": [{"id": 0, "port": 1, "endpoint": 1, "dir": "in"}], "enums": {"e": {"width": 2, "members": [{"name": "A", "value": 0}]}}}


def test_model_documents(spark, tmp_path):
    good, bad = tmp_path / "good.json", tmp_path / "bad.json"
    good.write_text(json.dumps(_document(1)))
    bad.write_text(json.dumps(_document(99)))
    m = model.read(spark, str(good))
    assert m.nodes.count() == 2 and m.enums.first().name == "A" and m.name_refs.count() == 0
    with pytest.raises(model.ModelError, match="child 99"):
        model.read(spark, str(bad))
    for _ in range(2):
        assert model.read_cached(spark, str(good), str(tmp_path / "cache")).edges.count() == 1


def test_synthetic_design(spark):
    nodes, edges = synthetic.design(spark, 1000)
    assert nodes.count() == 1000 and lookup.hot_nets(edges, 1).first().node == 1
    assert nodes.where("parent IS NOT NULL").join(nodes.selectExpr("id AS parent"), "parent", "left_anti").count() == 0


def test_stream_equals_batch(spark, tmp_path):
    rows = [(s, t, str(t % 2)) for s in range(3) for t in range(20)]
    frame = spark.createDataFrame(rows, "sig long, t long, v string")
    frame.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run = last_value.last_values(stream).writeStream.outputMode("complete").format("memory").queryName("last_values").trigger(availableNow=True).start()
    run.awaitTermination()
    assert sorted(map(tuple, spark.table("last_values").collect())) == sorted(map(tuple, last_value.last_values(frame).collect()))


def test_nearest_edge_never_looks_ahead_row_by_row(spark):
    changes = spark.createDataFrame([(1, 10, "0"), (1, 10, "1"), (1, 20, "0"), (2, 5, "1")], "sig long, t long, v string")
    probes = spark.createDataFrame([(1, 10), (1, 15), (1, 16), (1, 99), (2, 1), (3, 7)], "sig long, at long")
    near = waves.nearest_edge(changes, probes)
    assert {(r.sig, r["at"]): r.edge for r in near.collect()} == {(1, 10): 10, (1, 15): 10, (1, 16): 20, (1, 99): 20, (2, 1): 5, (3, 7): None}
    # a frame that ends with the partition takes the square of a signal's rows
    assert "unboundedfollowing" not in near._jdf.queryExecution().toString().lower()


@pytest.mark.parametrize(("seconds", "shown"), [(0, "1970-01-01 00:00:00"), (-1, "1969-12-31 23:59:59"), (253402300800, "10000-01-01 00:00:00"), (8999999 * 86399, "26610-11-16 20:00:01"), (53999999 * 86399, "149815-04-08 00:00:01")])
def test_stamp_of_far_years(spark, seconds, shown):
    got = one(spark, quality.stamp(F.col("s")), s=seconds)
    assert got == shown


def test_pruned_tries_shared_parents_once(spark, monkeypatch):
    nodes = spark.createDataFrame([("a",), ("a.b",), ("a.b.c",), ("a.b.d",), ("a.bb",), ("e.f.g",), ("e.f",), (None,)], "path string")
    tried, frames = [], hierarchy.scope_frames
    monkeypatch.setattr(hierarchy, "scope_frames", lambda df: tried.append({r.path for r in df.collect()}) or frames(df))
    kept = schematic.pruned(nodes, spark.createDataFrame([("a.b",), ("e.f.g",), ("e.f.g",), ("none",)], "path string"))
    assert sorted(r.path or "" for r in kept.collect()) == ["", "a", "a.bb", "e.f"]
    # leaves aren't split into prefixes themselves
    assert tried == [{"a", "a.b", "e", "e.f"}]


def test_names_elsewhere_stay_apart(spark):
    """Names outside the anchor have no target; they don't meet in the task of a null key, nor do cuts that no path begins with get looked up."""
    names = spark.range(0, 400, 1, 4).selectExpr("id AS var_ref", "CASE WHEN id % 100 = 0 THEN 'T.d.u.a' WHEN id % 2 = 0 THEN concat('X.', id) ELSE concat('T.y', id) END AS full_name", "false AS is_parameter")
    nodes = spark.createDataFrame([(1, "Net", "a", "top.u.a", 0), (2, "Net", "z", "top.z", 0)], "id long, kind string, name string, path string, parent long")
    opts = linkage.Options(excluded=("T",))
    assert linkage.detected_anchor(names, nodes, opts) == ("T", "d")
    tries = linkage._tries(names, opts)
    assert {(r.prefix, r.score) for r in linkage._scores(tries, nodes).collect()} == {("T.d", 4)}
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = linkage.matched(names, nodes, opts)
        rows = found.withColumn("part", F.spark_partition_id()).groupBy("status", "part").count().collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sum(r["count"] for r in rows) == 400
    assert max(r["count"] for r in rows if r.status == "mystery") == 49 and max(r["count"] for r in rows if r.status == "excluded") == 50


def test_signal_join_groups_nothing_after_the_join(spark):
    rows = [(1, 9, "out", "[0]"), (1, 9, "in", "[1]"), (2, 9, "in", "[0]"), (3, 9, "inout", None), (4, 9, "in", "[2]"), (5, 9, "in", "[1]"), (6, None, "inout", None), (3, 9, "inout", None)]
    made = graph.signal_join(spark.createDataFrame(rows, "port long, endpoint long, dir string, sel string"))
    assert sorted(tuple(r) for r in made.collect()) == [(9, 1, 2), (9, 1, 3), (9, 2, 3), (9, 3, 4), (9, 3, 5)]
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan[: plan.index("Join")]


def test_literals_are_cleaned_once(spark):
    wide = "".join(random.Random(5).choice("0123456789abcdef") for _ in range(600))
    rows = spark.createDataFrame([(f"2400'h{wide}",), ("8'b1x0",), ("12'o7_7",), ("'d007",), ("0",), (None,)], "t string").select("t", quality.parse_int(F.col("t")).alias("n"))
    assert {r.t: r.n for r in rows.collect()} == {f"2400'h{wide}": str(int(wide, 16)), "8'b1x0": None, "12'o7_7": "63", "'d007": "7", "0": "0", None: None}
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(t") == 1


def test_name_collisions_deal_rows_once(spark):
    nodes = spark.createDataFrame([("Net", "a", "p.a", 1), ("Port", "a", "p.a", 1), ("Net", "b", "p.b", 1), ("Net", "b", "p.c", 1), ("FF", "d", "p.d", 1), ("FF", "d", "p.d", 1), ("Net", "e", None, 1), ("Net", "e", None, 1)], "kind string, name string, path string, parent long")
    made = quality.name_collisions(nodes)
    assert sorted((r.name, r.n) for r in made.collect()) == [("b", 2), ("d", 2), ("e", 2)]
    assert made._jdf.queryExecution().sparkPlan().toString().count("RepartitionByExpression") + made._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange") == 1


def test_to_wave_takes_the_anchor_then_its_path(spark):
    """An anchor's own link, else that of the least linked node of its path; linked anchors aren't looked up by path, so theirs may be wide."""
    from netloom.operators import probe

    nodes = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a"), (4, "b"), (5, None), (6, "c"), (7, "c")], "id long, path string")
    index = spark.createDataFrame([(2, 20), (3, 30), (6, None), (7, 70)], "node long, var_ref long")
    anchors = spark.createDataFrame([(100, 1), (101, 3), (102, 4), (103, 5), (104, 6), (105, 9), (106, 1), (106, 7)], "probe long, anchor long")
    got = {tuple(r) for r in probe.to_wave(anchors, nodes, index, "probe").collect()}
    assert got == {(100, 20), (101, 30), (102, None), (104, 70), (106, 70)}


def test_innermost_are_the_narrowest_that_overlap(spark):
    import random

    from netloom.operators import spans

    rng = random.Random(5)
    spot = lambda: (lambda lo: (rng.randrange(3), lo, lo + rng.choice((0, 1, 5, 40, 300))))(rng.randrange(200))
    ranges = [(f, k % 40, lo, hi) for k in range(120) for f, lo, hi in [spot()]]
    probes = [spot() for _ in range(80)]
    made = spans.innermost(spark.createDataFrame(ranges, "file long, id long, lo long, hi long"), spark.createDataFrame(probes + probes, "file long, lo long, hi long"), cell=16)
    got, want = sorted(tuple(r) for r in made.collect()), set()
    for f, lo, hi in probes:
        over = [(b - a if b > a else 1 << 62, i) for g, i, a, b in ranges if g == f and a < max(hi, lo + 1) and lo < max(b, a + 1)]
        want |= {(f, lo, hi, i) for w, i in over if w == min(over)[0]}
    assert got == sorted(want) and len(got) > 80


def test_a_probe_leaves_its_cell_with_the_narrowest(spark):
    """A position under many nested ranges: only the narrowest of a grid cell is shuffled on."""
    from netloom.operators import spans

    ranges = spark.range(500).selectExpr("1L AS file", "id", "id AS lo", "2000 - id AS hi")
    plan = spans.innermost(ranges, spark.createDataFrame([(1, 900, 901)], "file long, lo long, hi long"), cell=4096)
    assert [r.id for r in plan.collect()] == [499]
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("Window") == 2 and "Aggregate [file" in text.splitlines()[0]
