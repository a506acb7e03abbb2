"""Queries over source text and over what statements read and write, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.operators import lowering, probe, tokens, waves
from netloom.operators.store import saved
from netloom.plans.queries import Data, query

# What the three lexical rules make of one made text, piece by piece: s SystemVerilog, c C++, p any other language.
_PIECES = """pc AS (SELECT * FROM (VALUES
    ('s', 0, 0, '  ', '', '', 'plain'), ('s', 0, 1, 'wire', '', '', 'type'), ('s', 0, 2, ' [', '', '', 'plain'), ('s', 0, 3, '7', '', '', 'number'), ('s', 0, 4, ':', '', '', 'operator'), ('s', 0, 5, '0', '', '', 'number'),
    ('s', 0, 6, '] n', 'k', ' ', 'plain'), ('s', 0, 7, '=', '', '', 'operator'), ('s', 0, 8, ' ', '', '', 'plain'), ('s', 0, 9, '', 'z', '''d3', 'number'), ('s', 0, 10, '; ', '', '', 'plain'), ('s', 0, 11, '// ', 'n', '', 'comment'),
    ('s', 1, 0, '/* a', '', '', 'comment'), ('s', 3, 0, 'b', 'k', ' */', 'comment'), ('s', 3, 1, ' ', '', '', 'plain'), ('s', 3, 2, '"s\\"', 'k', '"', 'string'), ('s', 3, 3, ' ', '', '', 'plain'), ('s', 3, 4, '`def', '', '', 'directive'),
    ('s', 3, 5, ' ', '', '', 'plain'), ('s', 3, 6, '$x', '', '', 'systask'), ('s', 3, 7, ' ', '', '', 'plain'), ('s', 3, 8, '0', '', '', 'number'), ('s', 3, 9, 'x1F ''a''', '', '', 'plain'),
    ('c', 0, 0, '  wire [', '', '', 'plain'), ('c', 0, 1, '7', '', '', 'number'), ('c', 0, 2, ':', '', '', 'operator'), ('c', 0, 3, '0', '', '', 'number'), ('c', 0, 4, '] n', 'k', ' ', 'plain'), ('c', 0, 5, '=', '', '', 'operator'),
    ('c', 0, 6, ' ', '', '', 'plain'), ('c', 0, 7, '', 'z', '', 'number'), ('c', 0, 8, '''d3; // ', 'n', '', 'string'), ('c', 1, 0, '/* a', '', '', 'comment'), ('c', 3, 0, 'b', 'k', ' */', 'comment'), ('c', 3, 1, ' ', '', '', 'plain'),
    ('c', 3, 2, '"s\\"', 'k', '"', 'string'), ('c', 3, 3, ' `def $x ', '', '', 'plain'), ('c', 3, 4, '0x1F', '', '', 'number'), ('c', 3, 5, ' ', '', '', 'plain'), ('c', 3, 6, '''a''', '', '', 'string'),
    ('p', 0, 0, '  wire [', '', '', 'plain'), ('p', 0, 1, '7', '', '', 'number'), ('p', 0, 2, ':', '', '', 'operator'), ('p', 0, 3, '0', '', '', 'number'), ('p', 0, 4, '] n', 'k', ' ', 'plain'), ('p', 0, 5, '=', '', '', 'operator'),
    ('p', 0, 6, ' ', '', '', 'plain'), ('p', 0, 7, '', 'z', '', 'number'), ('p', 0, 8, '''d3; ', '', '', 'plain'), ('p', 0, 9, '// ', 'n', '', 'comment'), ('p', 1, 0, '/* a', '', '', 'comment'), ('p', 3, 0, 'b', 'k', ' */', 'comment'),
    ('p', 3, 1, ' ', '', '', 'plain'), ('p', 3, 2, '"s\\"', 'k', '"', 'string'), ('p', 3, 3, ' `def $x ', '', '', 'plain'), ('p', 3, 4, '0x1F', '', '', 'number'), ('p', 3, 5, ' ''a''', '', '', 'plain')) AS v(g, line, token, a, m, b, cls)),
  tk AS (SELECT p_partkey AS file, line, token, concat(a, CASE m WHEN 'k' THEN concat(p_partkey, '') WHEN 'z' THEN concat(p_size, '') WHEN 'n' THEN p_name ELSE '' END, b) AS text, cls
    FROM part JOIN pc ON g = CASE p_partkey % 4 WHEN 0 THEN 's' WHEN 1 THEN 's' WHEN 2 THEN 'c' ELSE 'p' END)"""


def _sources(d: Data) -> DataFrame:
    key = F.col("p_partkey").cast("string")
    text = F.concat(F.lit("  wire [7:0] n"), key, F.lit(" = "), F.col("p_size").cast("string"), F.lit("'d3; // "), "p_name", F.lit("\r\n/* a\n\nb"), key, F.lit(' */ "s\\"'), key, F.lit("\" `def $x 0x1F 'a'"))
    language = F.when(F.col("p_partkey") % 4 == 1, "SV").when(F.col("p_partkey") % 4 == 2, "cpp").when(F.col("p_partkey") % 4 == 3, "perl")
    return d.part.select(F.col("p_partkey").alias("file"), text.alias("text"), language.alias("language"))


@query("tokenize", f"WITH {_PIECES} SELECT file, line, token, text, cls FROM tk")
def tokenize(d: Data) -> DataFrame:
    return tokens.tokenize(_sources(d))


@query("overlay_spans", f"""WITH {_PIECES}, cut AS (SELECT *, starts_with(text, '] n') AS hit FROM tk), off AS (SELECT *, token + 2 * CAST(coalesce(bool_or(hit) OVER (PARTITION BY file, line ORDER BY token ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS INTEGER) AS piece FROM cut)
  SELECT file, line, CAST(piece AS INTEGER) AS piece, text, cls FROM off WHERE NOT hit UNION ALL SELECT file, line, CAST(piece AS INTEGER), '] ', 'plain' FROM off WHERE hit
  UNION ALL SELECT file, line, CAST(piece + 1 AS INTEGER), concat('n', file), 'name-signal' FROM off WHERE hit UNION ALL SELECT file, line, CAST(piece + 2 AS INTEGER), ' ', 'plain' FROM off WHERE hit""")
def overlay_spans(d: Data) -> DataFrame:
    """A name in plain text, one that overlaps it, and one inside a comment."""
    refs = d.sql("SELECT p_partkey AS file, 0 AS line, 14 AS col, length(concat('n', p_partkey)) AS len, 'signal' AS name FROM part UNION ALL SELECT p_partkey, 0, 15, 2, 'port' FROM part UNION ALL SELECT p_partkey, 1, 4, 1, 'net' FROM part")
    return tokens.overlay(tokens.tokenize(_sources(d)), refs)


# Signals at the paths of parts: a Net and a Port, a Var, a Port, or only a memory; statements of orders over them.
_SIGNALS = """sg AS (SELECT p_partkey * 4 AS id, CASE p_partkey % 5 WHEN 0 THEN 'Memory' WHEN 1 THEN 'Var' WHEN 2 THEN 'Port' ELSE 'Net' END AS kind, concat('top.p', p_partkey) AS path FROM part
    UNION ALL SELECT p_partkey * 4 - 1, 'Port', concat('top.p', p_partkey) FROM part WHERE p_partkey % 5 = 3)"""
_USES = "us AS (SELECT -l_orderkey AS block, concat('top.p', l_partkey) AS path, l_returnflag AS f, l_linenumber AS n, concat('[', l_suppkey % 2, ']') AS sel FROM lineitem)"


@query("logic_edges", f"""WITH {_SIGNALS}, {_USES}, asg AS (SELECT DISTINCT block, path FROM us WHERE f = 'R'), ck AS (SELECT DISTINCT block, path FROM us WHERE f = 'N' AND n = 1),
  e AS (SELECT DISTINCT block, path, 'in' AS dir FROM us WHERE (block, path) NOT IN (SELECT block, path FROM asg) OR (block, path) IN (SELECT block, path FROM ck) UNION ALL SELECT block, path, 'out' FROM asg),
  s AS (SELECT block, path, min(sel) AS sel FROM us WHERE n % 2 = 0 GROUP BY 1, 2 HAVING min(sel) = max(sel))
  SELECT e.block, sg.id AS endpoint, e.dir, s.sel FROM e JOIN sg ON sg.path = e.path AND sg.kind <> 'Memory' AND (sg.kind <> 'Port' OR sg.id % 4 = 0) LEFT JOIN s ON s.block = e.block AND s.path = e.path""")
def logic_edges(d: Data) -> DataFrame:
    uses = d.sql(f"WITH {_USES} SELECT * FROM us")
    return lowering.logic_edges(d.sql(f"WITH {_SIGNALS} SELECT * FROM sg"), uses, uses.where("f = 'R'"), uses.where("f = 'N' AND n = 1"), uses.where("n % 2 = 0"))


@query("stated_constants", f"""WITH {_USES}, st AS (SELECT block, min(path) AS path, count(*) AS n, min(f) AS f FROM us GROUP BY block)
  SELECT block, path AS constant FROM st WHERE n = 1 AND f <> 'A' """)
def stated_constants(d: Data) -> DataFrame:
    """Blocks of one line; those flagged A read a signal too."""
    uses = d.sql(f"WITH {_USES} SELECT * FROM us")
    reads = uses.where("f = 'A'").select("block", F.concat("path", F.lit("r")).alias("path"))
    return lowering.stated_constants(reads, uses, uses.select("block", F.lit("assign").alias("role"), F.col("path").alias("literal")))


@query("memory_edges", f"""WITH {_SIGNALS}, {_USES} SELECT DISTINCT us.block AS memory, sg.id AS endpoint, CASE WHEN f = 'R' THEN 'out' ELSE 'in' END AS dir, CASE f WHEN 'R' THEN 'dout' WHEN 'A' THEN 'addr' ELSE 'din' END AS mem_port
  FROM us JOIN sg ON sg.path = us.path AND sg.kind <> 'Memory' AND (sg.kind <> 'Port' OR sg.id % 4 = 0)""")
def memory_edges(d: Data) -> DataFrame:
    uses = d.sql(f"WITH {_USES} SELECT block AS memory, path, CASE f WHEN 'R' THEN 'target' WHEN 'A' THEN 'index' ELSE 'value' END AS use FROM us")
    return lowering.memory_edges(d.sql(f"WITH {_SIGNALS} SELECT * FROM sg"), uses)


@query("resolve_ref", """SELECT concat(CASE p_partkey % 5 WHEN 0 THEN '/abs/' ELSE '' END, 'k', p_partkey, '.cpp') AS ref, concat('rtl', p_size) AS dir,
    CASE p_partkey % 5 WHEN 0 THEN concat('/abs/k', p_partkey, '.cpp') WHEN 1 THEN concat('b/k', p_partkey, '.cpp') WHEN 2 THEN concat('a/k', p_partkey, '.cpp') WHEN 3 THEN concat('decl/k', p_partkey, '.cpp') ELSE concat('rtl', p_size, '/k', p_partkey, '.cpp') END AS source FROM part""")
def resolve_ref(d: Data) -> DataFrame:
    """Absolute, under the second root, under both roots, declared once, and declared twice."""
    refs = d.sql("SELECT concat(CASE p_partkey % 5 WHEN 0 THEN '/abs/' ELSE '' END, 'k', p_partkey, '.cpp') AS ref, concat('rtl', p_size) AS dir FROM part")
    have = d.sql("""SELECT concat('/abs/k', p_partkey, '.cpp') AS source FROM part WHERE p_partkey % 10 = 0 UNION ALL SELECT concat('b/k', p_partkey, '.cpp') FROM part WHERE p_partkey % 5 IN (1, 2)
      UNION ALL SELECT concat('a/k', p_partkey, '.cpp') FROM part WHERE p_partkey % 5 = 2""")
    declared = d.sql("SELECT concat('decl/k', p_partkey, '.cpp') AS source FROM part WHERE p_partkey % 5 > 2 UNION ALL SELECT concat('more/k', p_partkey, '.cpp') FROM part WHERE p_partkey % 5 = 4")
    return lowering.resolved_sources(refs, [{"pos": 0, "root": "a"}, {"pos": 1, "root": "b"}], declared, have)


# Sources of customers: one body for one or two instances, blocks and declarations of its orders, references inside the blocks, and maps from C files.
_BODY = """od AS (SELECT o_orderkey AS o, o_custkey AS c, CAST((o_orderkey % 100) * 100 AS BIGINT) AS a FROM orders),
  sn AS (SELECT c_custkey AS id, 'Instance' AS kind, concat('top.c', c_custkey) AS path FROM customer UNION ALL SELECT 1000000000 + c_custkey, 'Instance', concat('top.x', c_custkey) FROM customer WHERE c_custkey % 2 = 1
    UNION ALL SELECT 2000000000000 + o, 'Comb', concat('top.c', c, '.p', o) FROM od UNION ALL SELECT 3000000000000 + o, 'Net', concat('top.c', c, '.n', o) FROM od UNION ALL SELECT 4000000000000 + o, 'Net', concat('top.x', c, '.n', o) FROM od WHERE c % 2 = 1),
  rg AS (SELECT c_custkey AS file, c_custkey AS id, CAST(0 AS BIGINT) AS lo, CAST(9950 AS BIGINT) AS hi, true AS body FROM customer UNION ALL SELECT c_custkey, 1000000000 + c_custkey, CAST(0 AS BIGINT), CAST(9950 AS BIGINT), true FROM customer WHERE c_custkey % 2 = 1
    UNION ALL SELECT c, 2000000000000 + o, a, a + 50, true FROM od UNION ALL SELECT c, 3000000000000 + o, a + 60, a + 60 + o % 3, true FROM od),
  rf AS (SELECT c AS file, a + 10 AS spot, 4 AS len, CASE WHEN o % 5 = 0 THEN concat('/top.c', c, '.n', o) WHEN o % 5 = 1 THEN concat('gone', o) ELSE concat('n', o) END AS rel FROM od),
  mp AS (SELECT -c AS file, CAST((o % 50) * 10 AS BIGINT) AS lo, CAST((o % 50) * 10 + 10 + o % 3 AS BIGINT) AS hi, c AS gen_file, a AS gen_lo, a + 50 AS gen_hi FROM od WHERE o % 4 > 0),
  pr AS (SELECT c AS file, a + 12 AS spot FROM od UNION SELECT c, a + 60 FROM od UNION SELECT c, a + 30 FROM od UNION SELECT c, a + 90 FROM od UNION SELECT -c, CAST((o % 50) * 10 + 3 AS BIGINT) FROM od)"""


@query("probe_cascade", f"""WITH {_BODY}, mb AS (SELECT pr.file, pr.spot, mp.gen_file, mp.gen_lo, mp.gen_hi FROM pr JOIN mp ON mp.file = pr.file AND mp.lo <= pr.spot AND pr.spot < mp.hi QUALIFY row_number() OVER (PARTITION BY pr.file, pr.spot ORDER BY mp.hi - mp.lo, gen_lo, gen_hi) = 1),
  pl AS (SELECT pr.file, pr.spot, mb.gen_file IS NOT NULL AS mapped, coalesce(mb.gen_file, pr.file) AS f, coalesce(gen_lo, pr.spot) AS lo, coalesce(gen_hi, pr.spot + 1) AS hi FROM pr LEFT JOIN mb ON mb.file = pr.file AND mb.spot = pr.spot),
  hw AS (SELECT pl.file, pl.spot, pl.mapped, rg.id, CASE WHEN rg.hi > rg.lo THEN rg.hi - rg.lo ELSE 1000000000 END AS w FROM pl JOIN rg ON rg.file = pl.f AND rg.lo < pl.hi AND pl.lo < greatest(rg.hi, rg.lo + 1)),
  sp AS (SELECT file, spot, mapped, id FROM hw QUALIFY w = min(w) OVER (PARTITION BY file, spot)),
  leaf AS (SELECT file, spot FROM (SELECT file, spot, mapped, arg_min(kind, path) AS kind FROM sp JOIN sn USING (id) GROUP BY 1, 2, 3) x WHERE mapped OR kind = 'Net'),
  nr AS (SELECT pr.file, pr.spot, min(rel) AS rel FROM pr JOIN rf ON rf.file = pr.file AND rf.spot <= pr.spot AND pr.spot < rf.spot + rf.len WHERE (pr.file, pr.spot) NOT IN (SELECT file, spot FROM leaf) GROUP BY 1, 2),
  nh AS (SELECT file, nr.spot, sn.id FROM nr JOIN sn ON starts_with(rel, '/') AND sn.path = substr(rel, 2) UNION SELECT nr.file, nr.spot, sn.id FROM nr JOIN rg ON rg.file = nr.file AND rg.lo <= nr.spot AND nr.spot < rg.hi JOIN sn i ON i.id = rg.id AND i.kind = 'Instance' JOIN sn ON sn.path = concat(i.path, '.', rel)),
  fin AS (SELECT file, spot, 'name' AS via, id FROM nh UNION ALL SELECT file, spot, CASE WHEN mapped THEN 'map' ELSE 'span' END, id FROM sp WHERE (file, spot) NOT IN (SELECT file, spot FROM nh))
  SELECT file, spot AS "offset", via, arg_min(id, path) AS anchor, count(*) - 1 AS others, CAST(count(*) AS BIGINT) AS nodes FROM fin JOIN sn USING (id) GROUP BY 1, 2, 3""")
def probe_cascade(d: Data) -> DataFrame:
    made = {name: d.sql(f"WITH {_BODY} SELECT * FROM {name}") for name in ("sn", "rg", "rf", "mp", "pr")}
    return probe.from_source(made["pr"].withColumnRenamed("spot", "offset"), made["sn"], made["rg"], made["mp"], made["rf"].withColumnRenamed("spot", "offset"))


_PANES = "gr AS (SELECT DISTINCT o_custkey AS pane, o_orderkey % 7 AS g FROM orders), la AS (SELECT o_custkey AS pane, o_orderkey % 7 AS g, o_orderkey AS lane FROM orders WHERE o_orderkey % 7 < 5)"


@query("visible_lanes", f"WITH {_PANES} SELECT pane, lane, row_number() OVER (PARTITION BY pane ORDER BY g, lane) - 1 AS slot FROM la WHERE (g + pane) % 3 > 0")
def visible_lanes(d: Data) -> DataFrame:
    groups = d.sql(f"WITH {_PANES} SELECT pane, g AS `group`, (g + pane) % 3 = 0 AS collapsed FROM gr")
    return waves.visible_lanes(groups, d.sql(f"WITH {_PANES} SELECT pane, g AS `group`, lane AS pos, lane FROM la"))


@query("working_group", f"""WITH {_PANES}, h AS (SELECT pane, max(g) AS g FROM la GROUP BY pane) SELECT gr.pane, coalesce(min(h.g), max(gr.g)) AS "group" FROM gr LEFT JOIN h ON h.pane = gr.pane GROUP BY gr.pane""")
def working_group(d: Data) -> DataFrame:
    return waves.working_group(d.sql(f"WITH {_PANES} SELECT pane, g AS `group` FROM gr"), d.sql(f"WITH {_PANES} SELECT pane, g AS `group`, lane FROM la"))


# Ranges of nodes by rule: a definition for two of three, an instance for every second.
_PLACES = """pl AS (SELECT id, 'def' AS role, id % 10 AS file, id % 1000 AS lo, id % 1000 + id % 50 AS hi FROM nodes WHERE id % 3 < 2 UNION ALL SELECT id, 'inst', 10 + id % 10, id % 900, id % 900 + 7 FROM nodes WHERE id % 2 = 0)"""
_ASKED = """ask AS (SELECT DISTINCT path FROM nodes WHERE id % 5 = 1), anc AS (SELECT path AS probe, arg_min(id, (CASE kind WHEN 'Var' THEN 0 WHEN 'Net' THEN 1 WHEN 'Port' THEN 2 WHEN 'Instance' THEN 3 WHEN 'GenBlock' THEN 4 ELSE 5 END) * 100000000000000 + id) AS anchor, count(*) AS nodes FROM nodes JOIN ask USING (path) GROUP BY path)"""


def _asked(d: Data) -> DataFrame:
    return d.nodes.where("id % 5 = 1").select("path").unionAll(d.nodes.select(F.concat("path", F.lit("?"))))


@query("probe_node_path", f"WITH {_ASKED} SELECT * FROM anc")
def probe_node_path(d: Data) -> DataFrame:
    """Paths of a fifth of the nodes, and paths that no node has."""
    d.settled()
    return probe.from_node_path(_asked(d), d.nodes)


@query("to_source", f"""WITH {_PLACES}, p AS (SELECT id, min(path) AS path FROM nodes GROUP BY id), f AS (SELECT * FROM pl WHERE role = 'def'), i AS (SELECT * FROM pl WHERE role = 'inst')
  SELECT p.id AS probe, path, coalesce(f.file, i.file) AS file, f.lo AS def_lo, f.hi AS def_hi, i.lo AS inst_lo, i.hi AS inst_hi FROM p LEFT JOIN f USING (id) LEFT JOIN i USING (id) UNION ALL SELECT -1, '', NULL, NULL, NULL, NULL, NULL""")
def to_source(d: Data) -> DataFrame:
    """From every node, and from one that isn't there."""
    d.settled()
    anchors = d.nodes.select(F.col("id").alias("probe"), F.col("id").alias("anchor")).unionAll(d.sql("SELECT -1L, -1L"))
    made = probe.to_source(anchors, d.nodes, d.sql(f"WITH {_PLACES} SELECT * FROM pl"))
    return made.select("probe", "path", "file", F.col("def.lo").alias("def_lo"), F.col("def.hi").alias("def_hi"), F.col("inst.lo").alias("inst_lo"), F.col("inst.hi").alias("inst_hi"))


@query("probe_response", f"""WITH {_ASKED}, {_PLACES}, ix AS (SELECT id AS node, id AS var_ref, concat('w.', name) AS full_name FROM nodes WHERE kind = 'Port' OR (kind = 'Net' AND id % 4 = 1)),
  lk AS (SELECT a.probe, arg_min(x.var_ref, CASE WHEN n.id = a.anchor THEN 0 ELSE n.id END) AS var_ref FROM anc a JOIN nodes n ON n.path = a.probe JOIN ix x ON x.node = n.id GROUP BY a.probe)
  SELECT a.probe, a.anchor, n.kind, a.probe AS path, coalesce(f.file, i.file) AS file, CASE WHEN f.id IS NOT NULL THEN f.lo ELSE i.lo END AS lo, CASE WHEN f.id IS NOT NULL THEN f.hi ELSE i.hi END AS hi, lk.var_ref, ix.full_name
  FROM anc a JOIN nodes n ON n.id = a.anchor LEFT JOIN pl f ON f.id = a.anchor AND f.role = 'def' LEFT JOIN pl i ON i.id = a.anchor AND i.role = 'inst' LEFT JOIN lk ON lk.probe = a.probe LEFT JOIN ix ON ix.var_ref = lk.var_ref""")
def probe_response(d: Data) -> DataFrame:
    """What paths of nodes answer: place and link into a trace of ports and of some nets."""
    d.settled()
    index = d.nodes.where("kind = 'Port' OR (kind = 'Net' AND id % 4 = 1)").select(F.col("id").alias("node"), F.col("id").alias("var_ref"), F.concat(F.lit("w."), "name").alias("full_name"))
    anchors = saved(probe.from_node_path(_asked(d), d.nodes).select("probe", "anchor"), "anchors")
    return probe.responses(anchors, d.nodes, d.sql(f"WITH {_PLACES} SELECT * FROM pl"), index.select("node", "var_ref"), index.select("var_ref", "full_name"))
