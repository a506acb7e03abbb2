"""Further queries: files and positions, provenance, gates, values and small rules, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.functions import bits
from netloom.operators import files, graph, hierarchy, quality, schematic, spans, waves
from netloom.plans.queries import _LINES, Data, _files, query

# Files of a design, by rule from the suppliers: a path, its language by extension.
_PATHS = "f AS (SELECT s_suppkey AS id, concat('src/n', s_nationkey, '/', CASE s_suppkey % 3 WHEN 0 THEN 'core' ELSE concat('u', s_suppkey) END, CASE s_suppkey % 4 WHEN 0 THEN '.c' WHEN 1 THEN '.hpp' WHEN 2 THEN '.sv' ELSE '' END) AS path FROM supplier)"


@query("file_lookup", f"""WITH {_PATHS}, q AS (SELECT DISTINCT name FROM (SELECT path AS name FROM f UNION ALL SELECT split_part(path, '/', 3) FROM f UNION ALL SELECT substr(path, 5) FROM f UNION ALL SELECT 'none.sv') n)
  SELECT name, arg_min(id, (s % 7) * 10000000 + s) AS id FROM q JOIN (SELECT *, id AS s FROM f) f ON path = name OR ends_with(path, concat('/', name)) OR split_part(path, '/', -1) = name GROUP BY name""")
def file_lookup(d: Data) -> DataFrame:
    names = d.sql(f"WITH {_PATHS} SELECT path AS name FROM f UNION ALL SELECT split_part(path, '/', 3) FROM f UNION ALL SELECT substr(path, 5) FROM f UNION ALL SELECT 'none.sv'")
    return files.by_name(d.sql(f"WITH {_PATHS} SELECT *, id % 7 AS place FROM f"), names, "place")


@query("resolved_offsets", f"""WITH {_PATHS}, q AS (SELECT s_suppkey AS k, CASE s_suppkey % 3 WHEN 0 THEN concat(s_suppkey, '') WHEN 1 THEN concat('u', s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN '.c' WHEN 1 THEN '.hpp' WHEN 2 THEN '.sv' ELSE '' END) ELSE 'none' END AS name FROM supplier),
  n AS (SELECT k, min(f.id) AS id FROM q JOIN f ON split_part(path, '/', -1) = name GROUP BY k)
  SELECT concat(name, ':', k) AS spec, CAST(CASE WHEN k % 3 = 0 THEN k ELSE n.id END AS BIGINT) AS file, CAST(k AS BIGINT) AS "offset" FROM q LEFT JOIN n USING (k) WHERE k % 3 = 0 OR n.id IS NOT NULL""")
def resolved_offsets(d: Data) -> DataFrame:
    """FILE:OFFSET where FILE is a number, a name, or unknown, and once more with an offset that is no number."""
    found = d.sql(f"WITH {_PATHS} SELECT id, path FROM f")
    name = F.when(F.col("id") % 3 == 0, F.col("id").cast("string")).when(F.col("id") % 3 == 1, F.element_at(F.split("path", "/"), -1)).otherwise("none")
    specs = found.select(F.concat(name, F.lit(":"), "id").alias("spec")).unionAll(found.select(F.concat(name, F.lit(":x"), "id")))
    return files.resolved_offsets(found, specs)


@query("source_languages", f"WITH {_PATHS} SELECT id, CASE WHEN ends_with(path, '.c') THEN 'c' ELSE 'cpp' END AS language FROM f")
def source_languages(d: Data) -> DataFrame:
    return d.sql(f"WITH {_PATHS} SELECT * FROM f").select("id", files.language_of(F.col("path")).alias("language"))


@query("module_of", f"""WITH {_PATHS} SELECT c_custkey AS id, split_part(split_part(path, '/', -1), '.', 1) AS module FROM customer JOIN f ON f.id = c_custkey % 10 + 1 WHERE c_custkey % 3 < 2""")
def module_of(d: Data) -> DataFrame:
    nodes = d.sql("SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN 'Instance' WHEN 1 THEN 'Interface' ELSE 'Port' END AS kind, c_custkey % 10 + 1 AS file FROM customer")
    return files.module_of(nodes, d.sql(f"WITH {_PATHS} SELECT * FROM f"))


@query("line_col_to_offset", f'WITH {_LINES} SELECT file, CAST(line + 1 AS INTEGER) AS line, CAST(1 + file % 5 AS INTEGER) AS "column", start + file % 5 AS "offset" FROM o WHERE line % 3 = 1')
def line_col_to_offset(d: Data) -> DataFrame:
    starts = spans.lines(_files(d))
    places = starts.where("line % 3 = 1").select("file", (F.col("line") + 1).alias("line"), (F.col("file") % 5 + 1).cast("int").alias("column"))
    return files.offset_of(starts, places)


@query("parse_offset", "SELECT o_orderkey, concat('a:', o_custkey) AS file, CASE WHEN o_orderkey % 5 > 0 THEN o_orderkey END AS \"offset\" FROM orders WHERE o_orderkey % 5 > 0 UNION ALL SELECT o_orderkey, NULL, NULL FROM orders WHERE o_orderkey % 5 = 0")
def parse_offset(d: Data) -> DataFrame:
    file, offset = files.parse_offset(F.col("spec"))
    rows = d.sql("SELECT o_orderkey, concat('a:', o_custkey, ':', CASE WHEN o_orderkey % 5 > 0 THEN concat(o_orderkey, '') WHEN o_orderkey % 2 = 0 THEN concat('9', o_orderkey, '00000000000000000000') ELSE 'x' END) AS spec FROM orders")
    return rows.select("o_orderkey", file.alias("file"), offset.alias("offset"))


@query("name_refs_in_file", """SELECT l_orderkey AS file, l_partkey AS "offset", concat('r', l_suppkey) AS rel, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, concat('r', l_suppkey)) - 1 AS nth
  FROM (SELECT DISTINCT l_orderkey, l_partkey, l_suppkey FROM lineitem) x""")
def name_refs_in_file(d: Data) -> DataFrame:
    return files.references(d.sql("SELECT DISTINCT l_orderkey AS file, l_partkey AS `offset`, concat('r', l_suppkey) AS rel FROM lineitem"))


@query("dedupe_name_refs", """SELECT file, "offset", rel, class_rank FROM (SELECT *, row_number() OVER (PARTITION BY file, "offset" ORDER BY length(rel), class_rank, rel) AS k FROM (
    SELECT DISTINCT l_suppkey AS file, l_linenumber AS "offset", concat('r', l_partkey) AS rel, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'R' THEN 1 ELSE 2 END AS class_rank FROM lineitem) x) y WHERE k = 1""")
def dedupe_name_refs(d: Data) -> DataFrame:
    refs = d.sql("SELECT DISTINCT l_suppkey AS file, l_linenumber AS `offset`, concat('r', l_partkey) AS rel, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'R' THEN 1 ELSE 2 END AS class_rank FROM lineitem")
    return spans.best_references(refs)


@query("token_offsets", """WITH w AS (SELECT p_partkey AS file, 0 AS line, unnest(string_split(p_name, ' ')) AS text, generate_subscripts(string_split(p_name, ' '), 1) - 1 AS token FROM part)
  SELECT file, line, CAST(token AS INTEGER) AS token, CAST(coalesce(sum(length(text)) OVER (PARTITION BY file, line ORDER BY token ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "column" FROM w""")
def token_offsets(d: Data) -> DataFrame:
    return files.token_columns(d.part.select(F.col("p_partkey").alias("file"), F.lit(0).alias("line"), F.posexplode(F.split("p_name", " ")).alias("token", "text")))


# Generated text: a line for each lineitem of an order, some with a comment that names a source line.
_MADE = """l_line AS (SELECT l_orderkey, l_linenumber, concat('x = ', min(l_partkey), CASE WHEN l_linenumber % 6 = 0 THEN '; // see top.v:12, host.com:80' WHEN l_linenumber % 3 = 0 THEN '; // plain' ELSE concat('; // [src/k', l_linenumber % 2, '.cpp:', min(l_suppkey), '] t') END) AS t FROM lineitem GROUP BY 1, 2)"""
_MADE_SQL = _MADE + """, g AS (SELECT l_orderkey AS file, l_linenumber, t, coalesce(sum(strlen(t) + 1) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lo FROM l_line),
  r AS (SELECT file, CAST(lo AS BIGINT) AS lo, CAST(lo + strlen(t) AS BIGINT) AS hi, regexp_extract(t, '(src/k[01].cpp):', 1) AS source, CAST(regexp_extract(t, 'cpp:([0-9]+)', 1) AS BIGINT) AS source_line FROM g WHERE contains(t, 'cpp:'))"""


def _generated(d: Data) -> DataFrame:
    return d.sql(f"WITH {_MADE} SELECT l_orderkey AS file, array_join(transform(array_sort(collect_list(struct(l_linenumber, t))), x -> x.t), chr(10)) AS text FROM l_line GROUP BY l_orderkey")


@query("provenance_scan", f"WITH {_MADE_SQL} SELECT file, lo, hi, source, source_line FROM r")
def provenance_scan(d: Data) -> DataFrame:
    return files.provenance_ranges(_generated(d))


@query("provenance_lookup", f"""WITH {_MADE_SQL}, q AS (SELECT DISTINCT l_orderkey AS file, l_quantity * 3 AS "offset" FROM lineitem)
  SELECT q.file, CAST(q."offset" AS BIGINT) AS "offset", min(r.lo) AS id FROM q JOIN r ON r.file = q.file AND r.lo <= q."offset" AND q."offset" < r.hi GROUP BY 1, 2""")
def provenance_lookup(d: Data) -> DataFrame:
    ranges = files.provenance_ranges(_generated(d)).select("file", F.col("lo").alias("id"), "lo", "hi")
    return files.narrowest_first(ranges, d.sql("SELECT DISTINCT l_orderkey AS file, CAST(l_quantity * 3 AS BIGINT) AS `offset` FROM lineitem"))


@query("read_excluded", "SELECT p_partkey, concat('a', p_size, CASE WHEN p_partkey % 2 = 0 THEN concat(',b', p_partkey) ELSE '' END) AS names FROM part")
def read_excluded(d: Data) -> DataFrame:
    text = F.concat(F.lit("# head\r\n \t a"), "p_size", F.lit("\t// note # more\r\n\t\r\n"), F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("\tb"), "p_partkey", F.lit(" \t#x"))).otherwise("//none"))
    return d.part.select("p_partkey", F.array_join(files.excluded_lines(text), ",").alias("names"))


@query("coerce_excluded", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN concat('x', p_size, ',y') ELSE 'TOP,tb,soc_pkg' END AS names FROM part")
def coerce_excluded(d: Data) -> DataFrame:
    return d.part.select("p_partkey", files.coerce_excluded(F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("x"), "p_size", F.lit(" ,\n y "))).otherwise(" , ")).alias("names"))


@query("const_select", "SELECT l_orderkey, l_linenumber, l_partkey, concat('n', l_suppkey, CASE WHEN l_linestatus = 'F' THEN concat('[', l_linenumber, ']') ELSE '' END) AS label FROM lineitem")
def const_select(d: Data) -> DataFrame:
    bound = files.const_bit(F.when(F.col("l_partkey") % 2 == 0, F.concat(F.lit("32'd"), "l_linenumber")).otherwise(F.col("l_linenumber").cast("string")))
    select = F.when(F.col("l_linestatus") == "F", F.concat(F.lit("["), bound, F.lit("]")))
    return d.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", files.with_select(F.concat(F.lit("n"), "l_suppkey"), select).alias("label"))


_GATE = "('And', 'Or', 'Xor', 'Xnor', 'Nand', 'Nor', 'Not', 'Buf', 'Mux')"
_FOLD = f"""rd AS (SELECT endpoint AS id, count(*) AS n, min(port) AS reader FROM gate_edges WHERE dir = 'in' GROUP BY 1), op AS (SELECT port AS id, min(endpoint) AS operand FROM gate_edges WHERE dir <> 'out' GROUP BY 1),
  fold AS (SELECT g.id AS inverter, reader, operand FROM gates g JOIN rd USING (id) JOIN op USING (id) JOIN gates r ON r.id = rd.reader WHERE g.kind = 'Not' AND rd.n = 1 AND r.kind IN {_GATE}
    AND NOT EXISTS (SELECT 1 FROM gate_edges o WHERE o.port = g.id AND o.dir = 'out'))"""


@query("fold_inverters", f"WITH {_FOLD} SELECT inverter, reader, operand FROM fold")
def fold_inverters(d: Data) -> DataFrame:
    return schematic.fold_inverters(d.gates, d.gate_edges)


@query("gate_children", f"WITH {_FOLD} SELECT parent AS block, id AS gate FROM gates WHERE kind IN {_GATE} AND id NOT IN (SELECT inverter FROM fold)")
def gate_children(d: Data) -> DataFrame:
    return schematic.gate_children(d.gates, d.gate_edges)


@query("flatten_assoc", """WITH RECURSIVE l AS (SELECT e.endpoint AS child, min(e.port) AS parent FROM gate_edges e JOIN gates c ON c.id = e.endpoint JOIN gates p ON p.id = e.port AND p.kind = c.kind WHERE e.dir = 'in' AND e.port = e.endpoint + 1 GROUP BY 1),
  w AS (SELECT id, id AS root FROM gates UNION ALL SELECT w.id, l.parent FROM w JOIN l ON l.child = w.root) SELECT id, max(root) AS root FROM w GROUP BY id""")
def flatten_assoc(d: Data) -> DataFrame:
    links = d.gate_edges.where("dir = 'in' AND port = endpoint + 1").select(F.col("endpoint").alias("child"), F.col("port").alias("parent"))
    return schematic.associative_roots(d.gates.select("id", F.col("kind").alias("op")), links)


@query("pin_roles", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_returnflag = 'R' THEN 'q' WHEN l_linenumber = 7 THEN 'enable' WHEN kind = 'FF' AND name IN ('clk_a', 'b_CLOCK') THEN 'clk'
    WHEN kind = 'FF' AND name = 'rst_n' THEN 'reset' WHEN name IN ('en', 'x_ce_y') THEN 'enable' ELSE 'data' END AS role
  FROM (SELECT *, CASE WHEN l_linestatus = 'F' THEN 'FF' ELSE 'Latch' END AS kind, CASE l_partkey % 7 WHEN 0 THEN 'clk_a' WHEN 1 THEN 'b_CLOCK' WHEN 2 THEN 'rst_n' WHEN 3 THEN 'en' WHEN 4 THEN 'x_ce_y' WHEN 5 THEN 'back' ELSE 'check' END AS name FROM lineitem) x""")
def pin_roles(d: Data) -> DataFrame:
    names = ("clk_a", "b_CLOCK", "rst_n", "en", "x_ce_y", "back", "check")
    name = F.element_at(F.array(*map(F.lit, names)), (F.col("l_partkey") % 7 + 1).cast("int"))
    side = F.when(F.col("l_returnflag") == "R", "east").otherwise("west")
    role = schematic.ff_role(F.when(F.col("l_linenumber") == 7, "enable"), name, side, F.when(F.col("l_linestatus") == "F", "FF").otherwise("Latch"))
    return d.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", role.alias("role"))


@query("pin_sides", "SELECT edge, CASE WHEN dir = 'out' THEN 'east' ELSE 'west' END AS side, CASE WHEN dir = 'out' THEN 'west' ELSE 'east' END AS boundary FROM edges")
def pin_sides(d: Data) -> DataFrame:
    side = schematic.side_of(F.col("dir"))
    return d.edges.select("edge", side.alias("side"), schematic.mirrored(side).alias("boundary"))


@query("csr_index", """WITH n AS (SELECT port AS node FROM edges UNION ALL SELECT endpoint FROM edges WHERE port <> endpoint), c AS (SELECT node, count(*) AS n FROM n GROUP BY 1)
  SELECT node, CAST(coalesce(sum(n) OVER (ORDER BY node ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start, n FROM c""")
def csr_index(d: Data) -> DataFrame:
    return graph.csr(d.edges)


@query("is_digital", "SELECT sig, max(length(CASE WHEN sig % 3 = 0 THEN v ELSE substr(v, 20, 1) END)) <= 1 AS digital FROM changes GROUP BY sig")
def is_digital(d: Data) -> DataFrame:
    value = F.when(F.col("sig") % 3 == 0, F.col("v")).otherwise(F.substring("v", 20, 1))
    return d.changes.groupBy("sig").agg(bits.is_digital(F.max(F.length(value))).alias("digital"))


@query("display_scale", "SELECT sig, max(t) * 1e-3 AS ns, max(t) * 1e-6 AS us, CAST(max(t) AS DOUBLE) AS odd FROM changes GROUP BY sig")
def display_scale(d: Data) -> DataFrame:
    last = F.max("t")
    scaled = [(last * F.lit(bits.display_scale(a, b))).cast("double").alias(n) for a, b, n in (("ps", "ns", "ns"), ("ps", "us", "us"), ("ps", "parsec", "odd"))]
    return d.changes.groupBy("sig").agg(*scaled)


@query("time_to_x", """WITH w AS (SELECT min(t) AS a, max(t) AS b FROM changes) SELECT sig, t, round((t - a) * 1000.0 / (b - a), 3) AS x FROM changes, w""")
def time_to_x(d: Data) -> DataFrame:
    window = d.changes.agg(F.min("t").alias("a"), F.max("t").alias("b"))
    return d.changes.join(F.broadcast(window)).select("sig", "t", F.round(waves.time_to_x(F.col("t"), F.col("a"), F.col("b"), 1000.0), 3).alias("x"))


@query("enum_values", """WITH m AS (SELECT p_brand AS type, p_partkey AS pos, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS k, p_size FROM part),
  g AS (SELECT type, pos, k, CASE WHEN p_size % 3 = 0 THEN p_size END AS given, p_size = 50 AS bad FROM m),
  b AS (SELECT *, max(CASE WHEN given IS NOT NULL THEN k END) OVER (PARTITION BY type ORDER BY k) AS at, bool_or(bad) OVER (PARTITION BY type) AS gone FROM g)
  SELECT b.type, concat('M', b.pos) AS name, CAST(coalesce(h.given + b.k - h.k, b.k) AS VARCHAR) AS value FROM b LEFT JOIN b h ON h.type = b.type AND h.k = b.at WHERE NOT b.gone""")
def enum_values(d: Data) -> DataFrame:
    rows = d.sql("SELECT p_brand AS type, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS pos, concat('M', p_partkey) AS name, CASE WHEN p_size = 50 THEN 'W+1' WHEN p_size % 3 = 0 THEN concat(\"32'd\", p_size) END AS literal FROM part")
    return quality.enum_values(rows)


@query("run_stamps", "SELECT o_orderkey, strftime(make_timestamp(o_orderkey * 86399 * 1000000), '%Y-%m-%d %H:%M:%S') AS stamp FROM orders")
def run_stamps(d: Data) -> DataFrame:
    return d.orders.select("o_orderkey", quality.stamp(F.col("o_orderkey") * 86399).alias("stamp"))


@query("thousands", "SELECT o_orderkey, format('{{:,}}', o_orderkey * 1234567) AS shown FROM orders")
def thousands(d: Data) -> DataFrame:
    return d.orders.select("o_orderkey", F.format_number(F.col("o_orderkey") * 1234567, 0).alias("shown"))


@query("unmatched_samples", "SELECT nth, full_name FROM (SELECT row_number() OVER (ORDER BY id) - 1 AS nth, concat('TOP.tb.dut.', substr(path, 5), '_x') AS full_name FROM nodes WHERE kind = 'Net' AND name = 'l5') x WHERE nth < 100")
def unmatched_samples(d: Data) -> DataFrame:
    """The report's first 100 unmatched names in the order of the trace."""
    from netloom.operators import linkage
    from netloom.plans.queries import OPTS, _match

    return linkage.samples(_match(d), "unmatched", OPTS.samples)


@query("within_box", "WITH RECURSIVE w AS (SELECT id, id AS anc, parent FROM scopes UNION ALL SELECT w.id, n.id, n.parent FROM w JOIN scopes n ON n.id = w.parent) SELECT w.id, w.anc AS box FROM w JOIN scopes b ON b.id = w.anc WHERE b.kind = 'Interface' OR (b.kind = 'Instance' AND b.name LIKE 'c%')")
def within_box(d: Data) -> DataFrame:
    return hierarchy.within(d.scopes, d.scopes.where("kind = 'Interface' OR (kind = 'Instance' AND name LIKE 'c%')"))
