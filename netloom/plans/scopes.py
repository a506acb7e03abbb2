"""Queries over the graphs of all scopes of a design, each beside its SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.operators import graph, hierarchy, scopegraph
from netloom.operators.store import saved
from netloom.plans.queries import Data, query

_LOGIC = "('FF', 'Comb', 'Latch', 'Assign', 'Memory')"
_BOXES = f"""scp AS (SELECT id AS scope, path AS root FROM chip n WHERE kind = 'Instance' OR (kind = 'GenBlock' AND EXISTS (SELECT 1 FROM chip x WHERE x.parent = n.id AND x.kind = 'Instance'))),
  bx AS (SELECT scope, x.id AS box, x.kind FROM scp JOIN chip x ON x.parent = scope WHERE x.kind IN ('Instance', 'Interface') OR x.kind IN {_LOGIC}
    UNION ALL SELECT scope, x.id, x.kind FROM scp JOIN chip g ON g.parent = scope AND g.kind = 'GenBlock' JOIN chip x ON x.parent = g.id WHERE x.kind IN ('Instance', 'Interface') OR x.kind IN {_LOGIC})"""
_ACCESS = """bare AS (SELECT id AS box FROM chip WHERE kind = 'Interface' AND modport IS NULL),
  ins AS (SELECT box, box AS node FROM bare UNION ALL SELECT box, id FROM bare JOIN chip ON parent = box),
  tap AS (SELECT i.box, CASE WHEN p.kind = 'Interface' THEN p.modport ELSE q.modport END AS view, e.dir FROM chip_edges e JOIN ins i ON i.node = e.endpoint JOIN chip p ON p.id = e.port LEFT JOIN chip q ON q.id = p.parent AND q.kind = 'Interface'
    WHERE (i.box, e.port) NOT IN (SELECT box, node FROM ins)),
  raw AS (SELECT box, CASE WHEN count(*) FILTER (dir = 'out') * 2 >= count(*) THEN 'west' ELSE 'east' END AS side FROM tap WHERE view IS NULL GROUP BY box)"""
_CAND = """pt AS (SELECT parent AS scope, path, max(id) AS pin FROM chip WHERE kind = 'Port' AND parent IN (SELECT scope FROM scp) GROUP BY 1, 2),
  own AS (SELECT scope, n.id AS node, pin FROM pt JOIN chip n ON n.parent = scope AND n.path = pt.path),
  mem AS (SELECT scope, e.endpoint AS node, b.id AS box, p.id AS pin FROM bx JOIN chip b ON b.id = box AND b.kind = 'Interface' AND b.modport IS NOT NULL JOIN chip p ON p.parent = b.id AND p.kind = 'Port' JOIN chip_edges e ON e.port = p.id),
  ner AS (SELECT scope, box AS node FROM bx UNION SELECT scope, x.id FROM bx JOIN chip x ON x.parent = box UNION SELECT scope, node FROM own),
  cand AS (SELECT DISTINCT scope, e.* FROM ner JOIN chip_edges e ON e.port = node OR e.endpoint = node)"""
_CAND = _CAND.replace("JOIN chip_edges e ON e.port = node OR e.endpoint = node", "JOIN (SELECT port AS near, * FROM chip_edges UNION ALL SELECT endpoint, * FROM chip_edges) e ON e.near = node").replace("DISTINCT scope, e.*", "DISTINCT scope, edge, port, endpoint, dir, sel")
_PINS = f"""ky AS (SELECT c.*, coalesce(o.pin, c.endpoint) AS key FROM cand c LEFT JOIN own o ON o.scope = c.scope AND o.node = c.endpoint),
  p1 AS (SELECT ky.scope, key, concat(port, '/', endpoint) AS pin, sel, CASE WHEN dir = 'out' THEN 'out' ELSE 'in' END AS way, 1 AS fold, edge FROM ky JOIN bx ON bx.scope = ky.scope AND bx.box = port WHERE bx.kind IN {_LOGIC}
    UNION ALL SELECT ky.scope, key, concat(port, ''), sel, ky.dir, 1, edge FROM ky JOIN chip p ON p.id = port AND p.kind = 'Port' JOIN bx ON bx.scope = ky.scope AND bx.box = p.parent AND bx.kind = 'Instance'
    UNION ALL SELECT scope, id, concat(id, ''), NULL, CASE dir WHEN 'in' THEN 'out' WHEN 'out' THEN 'in' ELSE 'inout' END, 2, concat(id, '') FROM own JOIN chip ON id = node AND kind = 'Port'
    UNION ALL SELECT DISTINCT scope, node, concat(pin, ''), NULL, CASE dir WHEN 'in' THEN 'out' WHEN 'out' THEN 'in' ELSE 'inout' END, 3, concat(pin, '') FROM mem JOIN chip ON id = pin
    UNION ALL SELECT scope, n.id, concat('raw/', bx.box), NULL, 'inout', 4, concat('raw/', bx.box) FROM bx JOIN raw ON raw.box = bx.box JOIN chip n ON n.parent = bx.box AND n.kind <> 'Port'),
  p2 AS (SELECT * FROM p1 UNION ALL SELECT scope, box, concat(box, '/', box), NULL, 'out', 5, concat(box, '/', box) FROM bx WHERE kind = 'Memory' AND (scope, box) IN (SELECT scope, key FROM p1 WHERE way <> 'out'))"""
_WIRES = f"""up AS (SELECT id, id AS a FROM chip UNION ALL SELECT up.id, n.parent FROM up JOIN chip n ON n.id = up.a WHERE n.parent IS NOT NULL),
  {_BOXES}, {_ACCESS}, {_CAND}, {_PINS},
  st AS (SELECT c.* FROM cand c JOIN chip n ON n.id = c.port WHERE n.kind NOT IN {_LOGIC}),
  en AS (SELECT DISTINCT scope, port AS node FROM st UNION SELECT DISTINCT scope, endpoint FROM st),
  one AS (SELECT scope, node, min(box) AS box, min(pin) AS pin FROM mem GROUP BY 1, 2 HAVING count(*) = 1),
  und AS (SELECT en.scope, en.node, bx.box, CASE WHEN n.kind = 'Port' AND n.parent = bx.box THEN concat(n.id, '')
      WHEN n.id IN (SELECT box FROM bare) THEN CASE WHEN n.id IN (SELECT box FROM raw) THEN concat('raw/', n.id) ELSE concat(n.id, '') END
      WHEN n.kind <> 'Port' AND n.parent IN (SELECT box FROM bare) THEN CASE WHEN n.parent IN (SELECT box FROM raw) THEN concat('raw/', n.parent) ELSE concat(n.parent, '') END
      WHEN n.kind = 'Interface' AND n.modport IS NOT NULL AND n.parent = bx.box THEN concat(n.id, '')
      WHEN n.kind = 'Port' AND q.kind = 'Interface' AND q.modport IS NOT NULL AND q.parent = bx.box THEN concat(q.id, '') ELSE concat(bx.box, '') END AS pin
    FROM en JOIN up ON up.id = en.node JOIN bx ON bx.scope = en.scope AND bx.box = up.a JOIN chip n ON n.id = en.node LEFT JOIN chip q ON q.id = n.parent),
  an AS (SELECT en.scope, en.node, CASE WHEN o.pin IS NOT NULL THEN o.pin WHEN one.pin IS NOT NULL THEN one.box ELSE und.box END AS box, CASE WHEN o.pin IS NOT NULL THEN concat(o.pin, '') WHEN one.pin IS NOT NULL THEN concat(one.pin, '') ELSE und.pin END AS pin
    FROM en LEFT JOIN own o ON o.scope = en.scope AND o.node = en.node LEFT JOIN one ON one.scope = en.scope AND one.node = en.node LEFT JOIN und ON und.scope = en.scope AND und.node = en.node),
  fi AS MATERIALIZED (SELECT CAST(id AS VARCHAR) AS pin, modport FROM chip WHERE kind = 'Interface' AND modport IS NOT NULL), md AS MATERIALIZED (SELECT id, parent, name FROM chip WHERE kind = 'Modport'),
  s1 AS MATERIALIZED (SELECT st.scope, st.edge, st.endpoint AS key, st.sel, coalesce(CAST(v.id AS VARCHAR), a.pin) AS src, coalesce(CAST(x.id AS VARCHAR), b.pin) AS tgt
    FROM st JOIN an a ON a.scope = st.scope AND a.node = st.port JOIN an b ON b.scope = st.scope AND b.node = st.endpoint
    LEFT JOIN fi fb ON fb.pin = b.pin LEFT JOIN md v ON v.parent = a.box AND v.name = fb.modport
    LEFT JOIN fi fa ON fa.pin = a.pin LEFT JOIN md x ON x.parent = b.box AND x.name = fa.modport WHERE a.box <> b.box),
  al AS (SELECT scope, src, tgt, key, sel, 0 AS pass, CAST(0 AS BIGINT) AS k, 0 AS f1, edge AS e1, 0 AS f2, '' AS e2 FROM s1
    UNION ALL SELECT d.scope, d.pin, l.pin, d.key, coalesce(d.sel, l.sel), 1, d.key, d.fold, d.edge, l.fold, l.edge FROM p2 d JOIN p2 l ON l.scope = d.scope AND l.key = d.key AND d.way <> 'in' AND l.way <> 'out' WHERE d.pin <> l.pin AND (d.sel IS NULL OR l.sel IS NULL OR d.sel = l.sel)),
  bst AS (SELECT * FROM al QUALIFY row_number() OVER (PARTITION BY scope, least(src, tgt), greatest(src, tgt) ORDER BY pass, k, f1, e1, f2, e2) = 1),
  grp AS MATERIALIZED (SELECT id, coalesce(m.g, id) AS g FROM chip LEFT JOIN (SELECT path AS p, min(id) AS g FROM chip WHERE kind IN ('Port', 'Net', 'Var') GROUP BY path) m ON m.p = chip.path AND chip.kind IN ('Port', 'Net', 'Var')),
  drv AS MATERIALIZED (SELECT a.g, e.port AS other, e.sel, b.g AS og FROM chip_edges e JOIN grp a ON a.id = e.endpoint JOIN grp b ON b.id = e.port WHERE e.dir = 'out' UNION ALL SELECT a.g, e.endpoint, e.sel, b.g FROM chip_edges e JOIN grp a ON a.id = e.port JOIN grp b ON b.id = e.endpoint WHERE e.dir <> 'out' AND e.port <> e.endpoint),
  ct AS MATERIALIZED (SELECT id, const FROM chip WHERE kind IN ('Assign', 'Comb') AND const IS NOT NULL), od AS MATERIALIZED (SELECT g, min(other) AS other FROM drv WHERE g <> og GROUP BY g HAVING count(*) = 1 AND count(sel) = 0),
  tie AS MATERIALIZED (SELECT grp.id, ct.const FROM od JOIN ct ON ct.id = od.other JOIN grp USING (g)),
  wire AS (SELECT bst.scope, src AS source, tgt AS target, concat(CASE WHEN starts_with(n.path, concat(scp.root, '.')) THEN substr(n.path, length(scp.root) + 2) ELSE split_part(n.path, '.', -1) END, coalesce(sel, '')) AS net, CASE WHEN sel IS NULL THEN tie.const END AS constant
    FROM bst JOIN chip n ON n.id = bst.key JOIN scp ON scp.scope = bst.scope LEFT JOIN tie ON tie.id = bst.key
    UNION ALL SELECT scope, concat('const/', id), concat(id, ''), NULL, NULL FROM bx JOIN chip ON parent = box AND chip.kind = 'Port' AND const IS NOT NULL)"""


def _scopes(d: Data) -> scopegraph.Scopes:
    return scopegraph.Scopes(saved(d.chip, "chip"), saved(d.chip_edges, "chip_edges"))


def _view_members(nodes: DataFrame) -> DataFrame:
    """Two members a view: both outputs for every third."""
    views = nodes.where("kind = 'Modport'").select(F.col("id").alias("modport_id"))
    return views.select("modport_id", F.lit("out").alias("dir")).unionAll(views.select("modport_id", F.when(F.col("modport_id") % 3 == 0, "out").otherwise("in")))


@query("scope_graph_nodes", f"WITH {_BOXES} SELECT scope, box, kind FROM bx")
def scope_graph_nodes(d: Data) -> DataFrame:
    nodes = saved(d.chip, "chip")
    return scopegraph.scope_boxes(nodes, scopegraph.scopes_of(nodes))


@query("access_ports", f"""WITH {_ACCESS} SELECT box, CAST(NULL AS VARCHAR) AS view, side FROM raw
  UNION ALL SELECT v.parent, v.name, CASE WHEN v.id % 3 = 0 THEN 'west' ELSE 'east' END FROM chip v WHERE v.kind = 'Modport' AND (v.parent, v.name) IN (SELECT box, view FROM tap)""")
def access_ports(d: Data) -> DataFrame:
    # two members a view: both outputs for every third
    nodes = saved(d.chip, "chip")
    views = nodes.where("kind = 'Modport'").select(F.col("id").alias("modport_id"))
    members = views.select("modport_id", F.lit("out").alias("dir")).unionAll(views.select("modport_id", F.when(F.col("modport_id") % 3 == 0, "out").otherwise("in")))
    return scopegraph.access_ports(nodes, saved(d.chip_edges, "chip_edges"), members)


@query("scope_anchors", f"WITH RECURSIVE {_WIRES} SELECT scope, node, box, pin FROM an WHERE box IS NOT NULL")
def scope_anchors(d: Data) -> DataFrame:
    """Every end of an edge that isn't a logic box's, in every scope that draws it."""
    return _scopes(d).anchors()


@query("scope_graph_pins", f"WITH RECURSIVE {_WIRES} SELECT scope, key, pin, sel, true AS drives FROM p2 WHERE way <> 'in' UNION ALL SELECT scope, key, pin, sel, false FROM p2 WHERE way <> 'out'")
def scope_graph_pins(d: Data) -> DataFrame:
    """The nets of every scope as pins and membership, without the wires that pair them."""
    return _scopes(d).pins()


@query("scope_graph_edges", f"WITH RECURSIVE {_WIRES} SELECT scope, source, target, net, constant FROM wire")
def scope_graph_edges(d: Data) -> DataFrame:
    return _scopes(d).wires()


@query("const_ties", f"WITH {_BOXES} SELECT scope, concat('const/', id) AS source, concat(id, '') AS target, const AS literal FROM bx JOIN chip ON parent = box AND chip.kind = 'Port' AND const IS NOT NULL")
def const_ties(d: Data) -> DataFrame:
    return _scopes(d).constants()


@query("dangling_pins", f"""WITH RECURSIVE {_WIRES}, wd AS (SELECT scope, source AS pin FROM wire UNION SELECT scope, target FROM wire)
  SELECT DISTINCT bx.scope, bx.box, e.endpoint AS signal FROM bx JOIN chip_edges e ON e.port = bx.box AND e.dir = 'out' WHERE bx.kind IN {_LOGIC} AND (bx.scope, concat(bx.box, '/', e.endpoint)) NOT IN (SELECT scope, pin FROM wd)""")
def dangling_pins(d: Data) -> DataFrame:
    return _scopes(d).dangling()


@query("box_ports", f"""WITH {_ACCESS}, fe AS (SELECT port, arg_min(dir, edge) AS dir FROM chip_edges GROUP BY port)
  SELECT b.id AS box, concat(p.id, '') AS pin, p.name, CASE WHEN coalesce(p.dir, fe.dir) IS NULL THEN 'west' WHEN b.modport IS NULL AND coalesce(p.dir, fe.dir) = 'out' THEN 'east' WHEN b.modport IS NOT NULL AND coalesce(p.dir, fe.dir) <> 'out' THEN 'east' ELSE 'west' END AS side,
    false AS bundle, fe.port IS NULL AND p.const IS NULL AS dangling FROM chip b JOIN chip p ON p.parent = b.id AND p.kind = 'Port' LEFT JOIN fe ON fe.port = p.id WHERE b.kind IN ('Instance', 'Interface')
  UNION ALL SELECT v.parent, concat(v.id, ''), v.name, CASE WHEN v.id % 3 = 0 THEN 'west' ELSE 'east' END, true, false FROM chip v WHERE v.kind = 'Modport' AND (v.parent, v.name) IN (SELECT box, view FROM tap)
  UNION ALL SELECT raw.box, concat('raw/', raw.box), n.name, side, true, false FROM raw JOIN chip n ON n.id = raw.box
  UNION ALL SELECT n.parent, concat(n.id, ''), concat(n.name, ' (', n.modport, ')'), 'east', true, false FROM chip n WHERE n.kind = 'Interface' AND n.modport IS NOT NULL AND n.id IN (SELECT port FROM chip_edges)""")
def box_ports(d: Data) -> DataFrame:
    nodes = saved(d.chip, "chip")
    return scopegraph.box_ports(nodes, saved(d.chip_edges, "chip_edges"), _view_members(nodes))


@query("seed_signals", f"""SELECT n.id AS seed, CASE WHEN e.port = n.id THEN e.endpoint ELSE e.port END AS node FROM chip n JOIN chip_edges e ON (e.port = n.id AND e.dir = 'out') OR (e.endpoint = n.id AND e.dir <> 'out') WHERE n.kind IN {_LOGIC} GROUP BY 1, 2
  UNION ALL SELECT n.id, m.id FROM chip n JOIN chip m ON m.path = n.path WHERE n.kind NOT IN {_LOGIC}""".replace("ON (e.port = n.id AND e.dir = 'out') OR (e.endpoint = n.id AND e.dir <> 'out')", "ON e.near = n.id").replace("JOIN chip_edges e", "JOIN (SELECT port AS near, * FROM chip_edges WHERE dir = 'out' UNION ALL SELECT endpoint, * FROM chip_edges WHERE dir <> 'out') e"))
def seed_signals(d: Data) -> DataFrame:
    """Forwards from every node."""
    nodes = saved(d.chip, "chip")
    return graph.seed_signals(nodes, saved(d.chip_edges, "chip_edges"), nodes.select(F.col("id").alias("seed")), scopegraph.LOGIC, True)


# At the gate level: blocks give way to their gates, folded inverters to their operands.
_GATES = "('And', 'Or', 'Xor', 'Xnor', 'Nand', 'Nor', 'Not', 'Buf', 'Add', 'Sub', 'Mul', 'Cmp', 'Shift', 'Mux', 'Concat')"
_INV = f"""gat AS (SELECT id, kind, parent FROM chip WHERE kind IN {_GATES}),
  inv AS (SELECT n.id AS inverter, r.reader, o.operand FROM gat n JOIN (SELECT endpoint, min(port) AS reader FROM chip_edges WHERE dir = 'in' GROUP BY endpoint HAVING count(*) = 1) r ON r.endpoint = n.id
    JOIN gat q ON q.id = r.reader JOIN (SELECT port, min(endpoint) AS operand FROM chip_edges WHERE dir <> 'out' GROUP BY port) o ON o.port = n.id WHERE n.kind = 'Not' AND n.id NOT IN (SELECT port FROM chip_edges WHERE dir = 'out')),
  opd AS (SELECT e.edge, e.port AS gate, coalesce(inv.operand, e.endpoint) AS endpoint, inv.operand IS NOT NULL AS inverted FROM chip_edges e JOIN gat ON gat.id = e.port LEFT JOIN inv ON inv.inverter = e.endpoint WHERE e.dir <> 'out')"""
_GATED = _WIRES.replace("bx AS (", f"{_INV}, bx0 AS (", 1).replace(", bare AS (", f""", bx AS (SELECT scope, coalesce(g.id, box) AS box, coalesce(g.kind, b.kind) AS kind FROM bx0 b LEFT JOIN (SELECT * FROM gat WHERE id NOT IN (SELECT inverter FROM inv)) g ON g.parent = b.box AND b.kind IN ('Comb', 'Latch', 'Assign')), bare AS (""", 1)
_GATED = _GATED.replace(f"WHERE n.kind NOT IN {_LOGIC}),\n  en AS", f"WHERE n.kind NOT IN {_LOGIC} AND n.kind NOT IN {_GATES}),\n  en AS").replace("n.kind <> 'Port'),\n  p2 AS", f"""n.kind <> 'Port'
    UNION ALL SELECT ky.scope, key, concat(port, '/', port), NULL, 'out', 1, edge FROM ky JOIN bx ON bx.scope = ky.scope AND bx.box = port WHERE bx.kind IN {_GATES} AND ky.dir = 'out'
    UNION ALL SELECT ky.scope, coalesce(o.pin, q.endpoint), concat(port, '/', q.endpoint), sel, 'in', 1, ky.edge FROM ky JOIN bx ON bx.scope = ky.scope AND bx.box = port JOIN opd q ON q.edge = ky.edge LEFT JOIN own o ON o.scope = ky.scope AND o.node = q.endpoint WHERE bx.kind IN {_GATES} AND ky.dir <> 'out'
    UNION ALL SELECT scope, box, concat(box, '/', box), NULL, 'out', 5, concat(box, '/', box) FROM bx WHERE kind IN {_GATES}),
  p2 AS""").replace("NULL, 'out', 5, concat(box, '/', box) FROM bx WHERE kind = 'Memory'", "NULL, 'out', 6, concat(box, '/', box) FROM bx WHERE kind = 'Memory'")
_ON_GATES = lambda sql: re.sub(r"\bchip\b", "gated", sql.replace("chip_edges", "gated_edges"))


def _gated(d: Data) -> tuple[DataFrame, DataFrame]:
    return saved(d.gated, "gated"), saved(d.gated_edges, "gated_edges")


@query("scope_graph_gates", _ON_GATES(f"WITH RECURSIVE {_GATED} SELECT scope, box, kind FROM bx"))
def scope_graph_gates(d: Data) -> DataFrame:
    return scopegraph.Scopes(*_gated(d), gates=True).boxes


@query("gate_pins", _ON_GATES(f"""WITH {_INV} SELECT gate, concat(gate, '/', q.endpoint) AS pin, n.name, 'west' AS side, CASE WHEN bool_or(inverted) THEN 'inv' END AS role, CASE WHEN n.kind IN ('Const', 'Param') THEN n.const END AS constant
    FROM opd q JOIN chip n ON n.id = q.endpoint WHERE gate NOT IN (SELECT inverter FROM inv) GROUP BY gate, q.endpoint, n.name, n.kind, n.const
  UNION ALL SELECT id, concat(id, '/', id), '', 'east', NULL, NULL FROM gat WHERE id NOT IN (SELECT inverter FROM inv)"""))
def gate_pins(d: Data) -> DataFrame:
    return scopegraph.gate_pins(*_gated(d))


@query("gate_graph_edges", _ON_GATES(f"WITH RECURSIVE {_GATED} SELECT scope, source, target, net, constant FROM wire"))
def gate_graph_edges(d: Data) -> DataFrame:
    return scopegraph.Scopes(*_gated(d), gates=True).wires()


@query("gate_dangling", _ON_GATES(f"""WITH RECURSIVE {_GATED}, wd AS (SELECT scope, source AS pin FROM wire UNION SELECT scope, target FROM wire)
  SELECT DISTINCT bx.scope, bx.box, e.endpoint AS signal FROM bx JOIN chip_edges e ON e.port = bx.box AND e.dir = 'out' WHERE bx.kind IN {_LOGIC} AND (bx.scope, concat(bx.box, '/', e.endpoint)) NOT IN (SELECT scope, pin FROM wd)
  UNION ALL SELECT bx.scope, bx.box, e.endpoint FROM bx LEFT JOIN (SELECT port, arg_min(endpoint, edge) AS endpoint FROM chip_edges WHERE dir = 'out' GROUP BY port) e ON e.port = bx.box WHERE bx.kind IN {_GATES} AND (bx.scope, concat(bx.box, '/', bx.box)) NOT IN (SELECT scope, pin FROM wd)"""))
def gate_dangling(d: Data) -> DataFrame:
    return scopegraph.Scopes(*_gated(d), gates=True).dangling()


_INSIDE = """vw AS (SELECT m.id AS mp, i.id AS iface, m.name AS view, i.path AS root FROM buses m JOIN buses i ON i.id = m.parent AND i.kind = 'Interface' WHERE m.kind = 'Modport'),
  fst AS (SELECT path, min(id) AS key FROM buses GROUP BY path),
  lst AS (SELECT iface, mp AS box, concat(mp, '/', key) AS pin, member AS name, dir, key, pos FROM vw JOIN bus_members ON modport_id = mp JOIN fst ON fst.path = concat(root, '.', member)),
  own AS (SELECT p.id AS box, p.parent AS iface, p.name, p.dir, key FROM buses p JOIN fst USING (path) WHERE p.kind = 'Port' AND p.parent IN (SELECT iface FROM vw)),
  en AS (SELECT iface, key, pin, dir AS way, 0 AS k, box, pos FROM lst UNION ALL SELECT iface, key, concat(box, ''), CASE dir WHEN 'in' THEN 'out' WHEN 'out' THEN 'in' ELSE 'inout' END, 1, box, 0 FROM own),
  met AS (SELECT d.iface, d.key, d.pin AS source, r.pin AS target FROM en d JOIN en r ON r.iface = d.iface AND r.key = d.key AND d.way <> 'in' AND r.way <> 'out' AND d.pin <> r.pin
    QUALIFY row_number() OVER (PARTITION BY d.iface, d.key, least(d.pin, r.pin), greatest(d.pin, r.pin) ORDER BY d.k, d.box, d.pos, r.k, r.box, r.pos) = 1),
  fan AS (SELECT iface, key, concat('frame/', box) AS source, pin AS target FROM lst WHERE (iface, key) NOT IN (SELECT iface, key FROM own))"""


def _interiors(d: Data) -> tuple[DataFrame, DataFrame]:
    return scopegraph.interface_interiors(saved(d.buses, "buses"), saved(d.bus_edges, "bus_edges"), saved(d.bus_members, "bus_members"))


@query("interface_pins", f"""WITH {_INSIDE} SELECT DISTINCT iface, box, pin, name, CASE dir WHEN 'out' THEN 'east' ELSE 'west' END AS side, false AS bundle FROM lst
  UNION ALL SELECT iface, box, concat(box, ''), name, CASE dir WHEN 'out' THEN 'west' ELSE 'east' END, false FROM own
  UNION ALL SELECT iface, mp, concat('frame/', mp), view, CASE WHEN (SELECT count(*) FILTER (dir = 'out') * 2 > count(*) FROM bus_members WHERE modport_id = mp) THEN 'east' ELSE 'west' END, true FROM vw""")
def interface_pins(d: Data) -> DataFrame:
    """The graph inside each interface: views as boxes, frame pins of its own ports and of its views."""
    return _interiors(d)[0]


@query("interface_wires", f"""WITH {_INSIDE}, tie AS (SELECT endpoint AS key, const FROM bus_edges e JOIN buses a ON a.id = e.port WHERE const IS NOT NULL)
  SELECT iface, source, target, substr(n.path, strlen(i.path) + 2) AS net, tie.const AS constant FROM (SELECT * FROM met UNION ALL SELECT * FROM fan) w JOIN buses n ON n.id = w.key JOIN buses i ON i.id = iface LEFT JOIN tie ON tie.key = w.key""")
def interface_wires(d: Data) -> DataFrame:
    return _interiors(d)[1]


_LEGACY = """inst AS (SELECT up.id, up.anc AS box FROM (WITH RECURSIVE up AS (SELECT id, id AS anc, kind, parent FROM nodes UNION ALL SELECT up.id, n.id, n.kind, n.parent FROM up JOIN nodes n ON n.id = up.parent WHERE up.kind <> 'Instance') SELECT * FROM up) up WHERE kind = 'Instance'),
  near AS (SELECT port AS node, endpoint AS other, edge FROM edges WHERE dir = 'out' UNION ALL SELECT endpoint, port, edge FROM edges WHERE dir = 'out' AND port <> endpoint),
  e1 AS (SELECT n.id AS seed, near.other, edge FROM nodes n JOIN near ON near.node = n.id WHERE n.kind = 'Param'),
  f1 AS (SELECT seed, box, arg_min(other, edge) AS node, min(edge) AS k FROM e1 JOIN inst ON inst.id = other GROUP BY 1, 2),
  r1 AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY k) AS rank FROM f1),
  e2 AS (SELECT r1.seed, edge, min(rank) AS rank, arg_min(near.other, rank) AS other FROM r1 JOIN near ON near.node = r1.node WHERE (r1.seed, edge) NOT IN (SELECT seed, edge FROM e1) GROUP BY 1, 2),
  f2 AS (SELECT DISTINCT seed, box FROM e2 JOIN inst ON inst.id = e2.other WHERE (seed, box) NOT IN (SELECT seed, box FROM f1))"""


@query("cone_legacy", f"WITH {_LEGACY} SELECT seed, concat('box ', box) AS item, 1 AS hop FROM f1 UNION ALL SELECT seed, concat('box ', box), 2 FROM f2 UNION ALL SELECT DISTINCT seed, concat('edge ', edge), 1 FROM e1 UNION ALL SELECT seed, concat('edge ', edge), 2 FROM e2")
def cone_legacy(d: Data) -> DataFrame:
    """Two hops along outputs from every parameter."""
    nodes, edges = saved(d.nodes, "nodes"), saved(d.edges, "edges")
    seeds = nodes.where("kind = 'Param'").select(F.col("id").alias("seed"))
    boxes, wires = graph.cone_legacy(edges, seeds, hierarchy.nearest_ancestor(nodes), "out", 2)
    boxes = boxes.select("seed", F.concat(F.lit("box "), F.col("box").cast("string")).alias("item"), "hop")
    return boxes.unionAll(wires.select("seed", F.concat(F.lit("edge "), "edge").alias("item"), "hop"))
