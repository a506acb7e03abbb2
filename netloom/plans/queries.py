"""Queries over whole tables for every operator, each beside DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.functions import bits
from netloom.operators import graph, hierarchy, linkage, lookup, probe, quality, schematic, spans, waves
from netloom.operators.store import saved
from netloom.plans import views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


class Data:
    """The tables and views of one folder."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        views.register(spark, sf_dir)
        self._spark, self._dir = spark, sf_dir
        self._seen: dict[str, DataFrame] = {}

    def settled(self) -> tuple[DataFrame, DataFrame]:
        """Nodes and trace names, the nodes worked out once and written."""
        nodes = saved(self.nodes, "nodes")
        nodes.createOrReplaceTempView("nodes")
        self._seen["nodes"] = nodes
        return nodes, self._spark.sql(views.text(views.VARS, views.SPARK))

    def sql(self, text: str) -> DataFrame:
        return self._spark.sql(text)

    def __getattr__(self, name: str) -> DataFrame:
        if name not in self._seen:
            self._seen[name] = self._spark.table(name)
        return self._seen[name]


def query(name: str, sql: str | None = None) -> Callable[[Callable[[Data], DataFrame]], Callable]:
    """Registers a function of the data under ``name``, with the SQL it must agree with."""

    def add(f: Callable[[Data], DataFrame]) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: f(Data(spark, sf_dir))
        if sql:
            ORACLE_SQL[name] = views.with_views(sql)
        return f

    return add


OPTS = linkage.Options()
# What Spark and DuckDB share for the cascade, spelled out for the latter.
_CLASS = """
  seg AS (SELECT var_ref, full_name, is_parameter, string_split(full_name, '.') AS s FROM vars),
  cls AS (SELECT *, CASE WHEN full_name LIKE 'TOP.tb.dut.%' THEN 'in' WHEN list_has_any(s, ['TOP', 'tb', 'soc_pkg']) THEN 'excluded' ELSE 'out' END AS class,
      CASE WHEN full_name LIKE 'TOP.tb.dut.%' THEN array_to_string(list_prepend('top', list_filter(s[4:], lambda x: NOT regexp_matches(x, '^\\[[0-9]+\\]$') AND NOT regexp_matches(x, '^genblk[0-9]+$'))), '.') END AS target
    FROM seg),
  pick AS (SELECT path, arg_min(id, (CASE kind WHEN 'Net' THEN 1 WHEN 'Port' THEN 2 ELSE 0 END) * 100000000000000 + id) AS id FROM nodes WHERE kind IN ('Var', 'Memory', 'Net', 'Port') GROUP BY path),
  par AS (SELECT path, bool_and(kind = 'Param') AS p FROM nodes GROUP BY path),
  alt AS (SELECT DISTINCT target, string_split(target, '.') AS s FROM cls WHERE class = 'in'),
  var_ AS (SELECT target, array_to_string(s[:k - 1] || s[k + 1:], '.') AS path FROM (SELECT target, s, unnest(range(2, CAST(len(s) AS BIGINT))) AS k FROM alt WHERE len(s) >= 3)),
  one AS (SELECT target, max(pick.id) AS id, max(CAST(par.p AS INTEGER)) = 1 AS p FROM var_ JOIN par USING (path) LEFT JOIN pick USING (path) GROUP BY target HAVING count(*) = 1),
  fin AS (SELECT cls.*, pick.id AS direct, CASE WHEN pick.id IS NULL THEN one.id END AS alias,
      CASE WHEN class = 'excluded' THEN 'excluded' WHEN class = 'out' THEN 'mystery' WHEN pick.id IS NOT NULL THEN 'direct' WHEN one.id IS NOT NULL THEN 'alias'
        WHEN is_parameter OR coalesce(par.p, false) OR coalesce(one.p, false) THEN 'parameter' ELSE 'unmatched' END AS status
    FROM cls LEFT JOIN pick ON pick.path = cls.target LEFT JOIN par ON par.path = cls.target LEFT JOIN one ON one.target = cls.target)
"""
_CLASS = _CLASS.replace("{", "{{").replace("}", "}}")


def _match(d: Data) -> DataFrame:
    nodes, names = d.settled()
    return linkage.matched(names, nodes, OPTS)


@query("match_report", f"""WITH {_CLASS} SELECT direct, alias, parameter, unmatched, excluded, mystery, direct + alias + unmatched AS denominator,
    round(CASE WHEN direct + alias + unmatched = 0 THEN 1.0 ELSE (direct + alias) / (direct + alias + unmatched) END, 6) AS hit_rate,
    (direct + alias) / (direct + alias + unmatched) >= 0.95 AND mystery = 0 AS passes
  FROM (SELECT count(*) FILTER (status = 'direct') AS direct, count(*) FILTER (status = 'alias') AS alias, count(*) FILTER (status = 'parameter') AS parameter,
    count(*) FILTER (status = 'unmatched') AS unmatched, count(*) FILTER (status = 'excluded') AS excluded, count(*) FILTER (status = 'mystery') AS mystery FROM fin)""")
def match_report(d: Data) -> DataFrame:
    return linkage.report(_match(d))


@query("match_status", f"WITH {_CLASS} SELECT var_ref, status, coalesce(direct, alias) AS node FROM fin WHERE class = 'in' UNION ALL SELECT var_ref, status, NULL FROM fin WHERE class <> 'in'")
def match_status(d: Data) -> DataFrame:
    return _match(d).select("var_ref", "status", "node")


@query("rule_counts", f"""WITH {_CLASS} SELECT rule, count(*) AS n FROM (
    SELECT 'AnchorRebase' AS rule FROM fin WHERE status IN ('direct', 'alias')
    UNION ALL SELECT 'InterfaceAlias' FROM fin WHERE status = 'alias'
    UNION ALL SELECT 'ArrayElement' FROM fin WHERE status IN ('direct', 'alias') AND len(list_filter(s[4:], lambda x: regexp_matches(x, '^\\[[0-9]+\\]$'))) > 0
    UNION ALL SELECT 'GenBlockFlatten' FROM fin WHERE status IN ('direct', 'alias') AND len(list_filter(s[4:], lambda x: regexp_matches(x, '^genblk[0-9]+$'))) > 0) r GROUP BY rule""")
def rule_counts(d: Data) -> DataFrame:
    return linkage.rule_counts(_match(d))


@query("wave_index", f"WITH {_CLASS} SELECT coalesce(direct, alias) AS node, arg_max(var_ref, CASE status WHEN 'direct' THEN 100000000000000 ELSE 0 END + var_ref) AS var_ref FROM fin WHERE status IN ('direct', 'alias') GROUP BY 1")
def wave_index(d: Data) -> DataFrame:
    return linkage.wave_index(_match(d))


@query("alias_match", f"WITH {_CLASS} SELECT var_ref, target, alias AS node FROM fin WHERE status = 'alias'")
def alias_match(d: Data) -> DataFrame:
    return _match(d).where("status = 'alias'").select("var_ref", "target", "node")


@query("normalize_names", f"WITH {_CLASS} SELECT var_ref, class, target FROM cls")
def normalize_names(d: Data) -> DataFrame:
    return linkage.classified(d.vars, ("TOP", "tb", "dut"), OPTS).select("var_ref", "class", "target")


@query("detect_anchor", """WITH seg AS (SELECT var_ref, is_parameter, string_split(full_name, '.') AS s FROM vars),
  cut AS (SELECT var_ref, is_parameter, s, unnest(range(0, least(len(s) - 1, 6) + 1)) AS k FROM seg),
  try AS (SELECT var_ref, is_parameter, array_to_string(s[:k], '.') AS prefix, k, array_to_string(list_prepend('top', list_filter(s[k + 1:], lambda x: NOT regexp_matches(x, '^\\[.*\\]$'))), '.') AS path FROM cut)
  SELECT prefix, CAST(k AS INTEGER) AS depth, count(*) FILTER (NOT is_parameter AND n.path IS NOT NULL) AS score, min(var_ref) AS first FROM try LEFT JOIN (SELECT DISTINCT path FROM nodes) n USING (path) GROUP BY 1, 2 HAVING count(*) FILTER (NOT is_parameter AND n.path IS NOT NULL) > 0""")
def detect_anchor(d: Data) -> DataFrame:
    nodes, names = d.settled()
    return linkage.anchor_scores(names, nodes, OPTS)


@query("ingest_summary", "SELECT kind, count(*) AS nodes, count(DISTINCT path) AS paths FROM nodes GROUP BY kind")
def ingest_summary(d: Data) -> DataFrame:
    return lookup.summary(d.nodes)


@query("equivalence_sets", """SELECT path, arg_min(id, (CASE kind WHEN 'Var' THEN 0 WHEN 'Net' THEN 1 WHEN 'Port' THEN 2 WHEN 'Instance' THEN 3 WHEN 'GenBlock' THEN 4 ELSE 5 END) * 100000000000000 + id) AS anchor,
  count(*) AS n, string_agg(id, ',' ORDER BY id) AS ids FROM nodes GROUP BY path""")
def equivalence_sets(d: Data) -> DataFrame:
    return lookup.equivalence_sets(d.nodes)


@query("pick_node", """SELECT path, arg_min(id, (CASE kind WHEN 'Net' THEN 1 WHEN 'Port' THEN 2 ELSE 0 END) * 100000000000000 + id) AS id
  FROM nodes WHERE kind IN ('Var', 'Memory', 'Net', 'Port') GROUP BY path""")
def pick_node(d: Data) -> DataFrame:
    return lookup.pick_node(d.nodes)


@query("nodes_at_path", "SELECT v.var_ref, n.id, n.kind FROM vars v JOIN nodes n ON n.path = concat('top.', substr(v.full_name, 12)) WHERE v.full_name LIKE 'TOP.tb.dut.%'")
def nodes_at_path(d: Data) -> DataFrame:
    names = d.vars.where("full_name LIKE 'TOP.tb.dut.%'").select("var_ref", F.concat(F.lit("top."), F.expr("substr(full_name, 12)")).alias("path"))
    return names.join(d.nodes, "path").select("var_ref", "id", "kind")


@query("node_by_id", "SELECT e.edge, n.kind, n.path FROM edges e JOIN nodes n ON n.id = e.port")
def node_by_id(d: Data) -> DataFrame:
    return d.edges.join(d.nodes, F.col("port") == F.col("id")).select("edge", "kind", "path")


@query("incident_edges", "SELECT port AS node, edge, endpoint AS other, true AS is_port FROM edges UNION ALL SELECT endpoint, edge, port, false FROM edges WHERE port <> endpoint")
def incident_edges(d: Data) -> DataFrame:
    return lookup.incident(d.edges).select("node", "edge", "other", "is_port")


@query("hot_nets", "SELECT node, count(*) AS degree FROM (SELECT port AS node FROM edges UNION ALL SELECT endpoint FROM edges WHERE port <> endpoint) x GROUP BY node ORDER BY degree DESC, node LIMIT 20")
def hot_nets(d: Data) -> DataFrame:
    return lookup.hot_nets(d.edges)


@query("derived_path_lookup", """WITH p AS MATERIALIZED (SELECT id AS parent_id, path AS base FROM nodes WHERE kind = 'GenBlock'), c AS MATERIALIZED (SELECT parent AS parent_id, name AS member FROM nodes WHERE kind = 'Net'),
  w AS MATERIALIZED (SELECT parent_id, member, concat(base, '.', member) AS path FROM c JOIN p USING (parent_id)), x AS MATERIALIZED (SELECT path, id, kind FROM nodes WHERE kind IN ('Net', 'Port', 'Instance', 'GenBlock'))
  SELECT parent_id, member, id, kind FROM w JOIN x USING (path)""")
def derived_path_lookup(d: Data) -> DataFrame:
    return lookup.derived_path(d.nodes, d.nodes.where("kind = 'Net'").select(F.col("parent").alias("parent_id"), F.col("name").alias("member")))


@query("scope_frames", """WITH p AS (SELECT DISTINCT path, string_split(path, '.') AS s FROM nodes)
  SELECT path, CAST(k AS INTEGER) AS depth, array_to_string(s[:k], '.') AS frame FROM (SELECT path, s, unnest(range(1, CAST(len(s) AS BIGINT) + 1)) AS k FROM p)""")
def scope_frames(d: Data) -> DataFrame:
    return hierarchy.scope_frames(d.nodes)


_UP = """WITH RECURSIVE up AS (SELECT id, id AS anc, kind, parent FROM nodes UNION ALL SELECT up.id, n.id, n.kind, n.parent FROM up JOIN nodes n ON n.id = up.parent WHERE {})
  SELECT nodes.id, h.anc AS ancestor FROM nodes LEFT JOIN (SELECT id, anc FROM up WHERE kind = 'Instance'{}) h ON h.id = nodes.id"""


@query("nearest_ancestor", _UP.format("up.kind <> 'Instance'", "").replace("{", "{{"))
def nearest_ancestor(d: Data) -> DataFrame:
    return hierarchy.nearest_ancestor(d.nodes)


_NAV = """bare AS (SELECT id FROM scopes i WHERE kind = 'Interface' AND EXISTS (SELECT 1 FROM scopes m WHERE m.parent = i.id AND m.kind = 'Modport')),
  up AS (SELECT s.parent AS id FROM scopes s WHERE s.parent IS NOT NULL AND (s.kind = 'Instance' OR s.id IN (SELECT id FROM bare))
    UNION SELECT g.parent FROM up JOIN scopes g ON g.id = up.id WHERE g.kind = 'GenBlock' AND g.parent IS NOT NULL),
  nav AS (SELECT id, parent, name, kind FROM scopes WHERE kind = 'Instance' OR id IN (SELECT id FROM bare) OR (kind = 'GenBlock' AND id IN (SELECT id FROM up)))"""


@query("containing_instance", """WITH RECURSIVE up AS (SELECT id, parent AS anc FROM scopes UNION ALL SELECT up.id, n.parent FROM up JOIN scopes n ON n.id = up.anc WHERE n.kind <> 'Instance')
  SELECT scopes.id, CASE WHEN h.above IS NOT NULL THEN h.anc END AS ancestor FROM scopes LEFT JOIN (SELECT up.id, up.anc, n.parent AS above FROM up JOIN scopes n ON n.id = up.anc WHERE n.kind = 'Instance') h ON h.id = scopes.id""")
def containing_instance(d: Data) -> DataFrame:
    return hierarchy.containing_instance(d.scopes)


@query("cone_root", f"""WITH RECURSIVE {_NAV}, w AS (SELECT id, id AS anc FROM scopes UNION ALL SELECT w.id, n.parent FROM w JOIN scopes n ON n.id = w.anc WHERE n.parent IS NOT NULL AND w.anc NOT IN (SELECT id FROM nav))
  SELECT scopes.id, coalesce(r.path, scopes.path) AS root FROM scopes LEFT JOIN (SELECT w.id, n.path FROM w JOIN scopes n ON n.id = w.anc WHERE w.anc IN (SELECT id FROM nav)) r ON r.id = scopes.id""")
def cone_root(d: Data) -> DataFrame:
    return hierarchy.cone_root(d.scopes, schematic.navigable(d.scopes))


@query("hierarchy_tree", """WITH RECURSIVE t AS (SELECT id, path, CAST(NULL AS VARCHAR) AS parent_path, 0 AS level FROM nodes WHERE path = 'top'
  UNION ALL SELECT n.id, n.path, t.path, t.level + 1 FROM nodes n JOIN t ON n.parent = t.id WHERE n.kind IN ('Instance', 'GenBlock') AND t.level < 4)
  SELECT path, parent_path, level, id IN (SELECT parent FROM nodes WHERE kind IN ('Instance', 'GenBlock') AND parent IS NOT NULL) AS expandable FROM t""")
def hierarchy_tree(d: Data) -> DataFrame:
    return hierarchy.tree(d.nodes, 4)


@query("child_boxes", """SELECT p.id AS scope, c.id AS box FROM nodes p JOIN nodes c ON c.parent = p.id WHERE p.kind = 'Instance' AND c.kind <> 'GenBlock'
  UNION ALL SELECT p.id, c.id FROM nodes p JOIN nodes g ON g.parent = p.id JOIN nodes c ON c.parent = g.id WHERE p.kind = 'Instance' AND g.kind = 'GenBlock'""")
def child_boxes(d: Data) -> DataFrame:
    return hierarchy.child_boxes(d.nodes)


@query("scope_signals", """SELECT p.path AS scope, s.path, arg_min(s.id, r) AS id, arg_min(s.kind, r) AS kind FROM (
    SELECT *, (CASE kind WHEN 'Var' THEN 0 WHEN 'Net' THEN 1 WHEN 'Port' THEN 2 ELSE 5 END) * 100000000000000 + id AS r FROM nodes WHERE kind IN ('Port', 'Net', 'Var', 'Memory')) s
  JOIN nodes p ON s.parent = p.id GROUP BY 1, 2""")
def scope_signals(d: Data) -> DataFrame:
    return hierarchy.scope_signals(d.nodes)


@query("relative_path", """WITH p AS MATERIALIZED (SELECT id AS parent, path AS base FROM nodes WHERE kind IN ('Instance', 'GenBlock')), s AS MATERIALIZED (SELECT id, parent, path FROM nodes WHERE parent IS NOT NULL)
  SELECT id, CASE WHEN starts_with(path, concat(base, '.')) THEN substr(path, strlen(base) + 2) ELSE split_part(path, '.', -1) END AS rel FROM s JOIN p USING (parent)""")
def relative_path(d: Data) -> DataFrame:
    rows = d.nodes.alias("s").join(d.nodes.alias("p"), F.col("s.parent") == F.col("p.id")).select("s.id", "s.path", F.col("p.path").alias("scope"))
    return hierarchy.relative_path(rows).select("id", "rel")


@query("filter_signals", "SELECT id, path FROM nodes WHERE kind IN ('Port', 'Net', 'Var', 'Memory') AND contains(lower(path), lower(trim(' O[1 ')))")
def filter_signals(d: Data) -> DataFrame:
    return d.nodes.where(F.col("kind").isin(*lookup.SIGNALS) & F.contains(F.lower("path"), F.lower(F.trim(F.lit(" O[1 "))))).select("id", "path")


# The design with faults: second instances of a name, ports at a net's path (which is none), lost parents, repeated ids, edges into nothing.
_FAULTS = """bad AS (SELECT id, kind, name, path, parent FROM nodes
    UNION ALL SELECT 20000000000000 + id, 'Instance', name, path, parent FROM nodes WHERE kind = 'Instance' AND id % 7 = 3 AND parent IS NOT NULL
    UNION ALL SELECT 30000000000000 + id, 'Port', name, path, parent FROM nodes WHERE kind = 'Net' AND id % 11 = 4
    UNION ALL SELECT 40000000000000 + id, 'Net', name, concat(path, '_'), parent FROM nodes WHERE kind = 'Net' AND id % 13 = 5
    UNION ALL SELECT id, kind, name, path, -id - 1 FROM nodes WHERE kind = 'Var' AND id % 5 = 2),
  bad_edges AS (SELECT edge, port, endpoint, dir, sel FROM edges UNION ALL SELECT concat('x', edge), port, -endpoint, dir, sel FROM edges WHERE port % 9 = 1 UNION ALL SELECT concat('y', edge), -port, endpoint, dir, sel FROM edges WHERE port % 9 = 2)"""


@query("name_collisions", f"""WITH {_FAULTS} SELECT parent, name, count(*) AS n FROM bad WHERE name <> '' AND parent IS NOT NULL GROUP BY 1, 2
  HAVING count(*) > 1 AND NOT (count(DISTINCT path) = 1 AND bool_and(kind IN ('Port', 'Net', 'Var')))""")
def name_collisions(d: Data) -> DataFrame:
    d.settled()
    return quality.name_collisions(d.sql(f"WITH {_FAULTS} SELECT * FROM bad"))


@query("integrity_violations", f"""WITH {_FAULTS} SELECT 'parent' AS rule, id FROM bad WHERE parent IS NOT NULL AND parent NOT IN (SELECT id FROM bad)
  UNION ALL SELECT 'port', port FROM bad_edges WHERE port NOT IN (SELECT id FROM bad) UNION ALL SELECT 'endpoint', endpoint FROM bad_edges WHERE endpoint NOT IN (SELECT id FROM bad)
  UNION ALL SELECT 'id', id FROM bad GROUP BY id HAVING count(*) > 1""")
def integrity_violations(d: Data) -> DataFrame:
    return quality.violations(saved(d.sql(f"WITH {_FAULTS} SELECT * FROM bad"), "nodes"), d.sql(f"WITH {_FAULTS} SELECT * FROM bad_edges"))


@query("signal_groups", """SELECT id, CASE WHEN kind IN ('Port', 'Net', 'Var') THEN min(CASE WHEN kind IN ('Port', 'Net', 'Var') THEN id END) OVER (PARTITION BY path) ELSE id END AS "group" FROM nodes""")
def signal_groups(d: Data) -> DataFrame:
    return graph.signal_groups(d.nodes)


@query("signal_join", """SELECT d.endpoint AS net, least(d.port, l.port) AS a, greatest(d.port, l.port) AS b FROM edges d JOIN edges l ON d.endpoint = l.endpoint
  WHERE d.dir IN ('out', 'inout') AND l.dir IN ('in', 'inout') AND d.port <> l.port AND (d.sel IS NULL OR l.sel IS NULL OR d.sel = l.sel) GROUP BY 1, 2, 3""")
def signal_join(d: Data) -> DataFrame:
    return graph.signal_join(d.edges)


#: Constants of logic nodes, and edges that drive nets from them: one driver a net for two parts in three.
_TIES = """c AS (SELECT 20000000000000 + p_partkey AS id, CASE p_partkey % 2 WHEN 0 THEN 'Assign' ELSE 'FF' END AS kind, CASE WHEN p_partkey % 5 > 0 THEN concat(p_size, '') END AS k, p_partkey FROM part),
  a AS (SELECT id, kind, concat('top.a', p_partkey) AS path, k FROM c UNION ALL SELECT 30000000000000 + p_partkey, 'Net', concat('top.t', p_partkey), NULL FROM c
    UNION ALL SELECT 31000000000000 + p_partkey, 'Port', concat('top.t', p_partkey), NULL FROM c),
  e AS (SELECT id AS port, 30000000000000 + p_partkey AS endpoint, 'out' AS dir, CASE WHEN p_partkey % 7 = 0 THEN '[0]' END AS sel FROM c UNION ALL SELECT 31000000000000 + p_partkey, 30000000000000 + p_partkey, 'out', NULL FROM c
    UNION ALL SELECT id, 31000000000000 + p_partkey + 1, 'out', NULL FROM c WHERE p_partkey % 3 = 0 UNION ALL SELECT id, 30000000000000 + p_partkey, 'in', NULL FROM c WHERE p_partkey % 4 = 0)"""


@query("net_ties", f"""WITH {_TIES}, g AS (SELECT path, min(id) AS g FROM a WHERE kind IN ('Net', 'Port') GROUP BY path), m AS (SELECT a.id, coalesce(g.g, a.id) AS g FROM a LEFT JOIN g ON g.path = a.path AND a.kind IN ('Net', 'Port')),
  n AS (SELECT m.g, e.port AS other, e.sel, o.g AS og FROM e JOIN m ON m.id = e.endpoint JOIN m o ON o.id = e.port WHERE dir = 'out' UNION ALL SELECT m.g, e.endpoint, e.sel, o.g FROM e JOIN m ON m.id = e.port JOIN m o ON o.id = e.endpoint WHERE dir <> 'out'),
  one AS (SELECT g, min(other) AS other FROM n WHERE g <> og GROUP BY g HAVING count(*) = 1 AND count(sel) = 0)
  SELECT g AS "group", k AS constant FROM one JOIN a ON a.id = other WHERE kind IN ('Assign', 'Comb') AND k IS NOT NULL""")
def net_ties(d: Data) -> DataFrame:
    made = {name: d.sql(f"WITH {_TIES} SELECT * FROM {name}") for name in ("a", "e")}
    edges = made["e"].withColumn("edge", F.concat_ws(">", "port", "endpoint", "dir"))
    return graph.net_ties(made["a"].select("id", "kind", "path"), edges, made["a"].select("id", F.col("k").alias("constant")))


@query("fanout_cap", "SELECT edge FROM (SELECT edge, row_number() OVER (PARTITION BY endpoint ORDER BY port, dir, coalesce(sel, '')) AS r FROM edges) x WHERE r <= 5")
def fanout_cap(d: Data) -> DataFrame:
    return graph.fanout_cap(d.edges, 5)[0].select("edge")


@query("fanout_dropped", "SELECT endpoint, least(count(*), 5) AS kept, greatest(count(*) - 5, 0) AS more FROM edges GROUP BY endpoint")
def fanout_dropped(d: Data) -> DataFrame:
    return graph.fanout_cap(d.edges, 5)[1]


@query("trunk_groups", "SELECT endpoint, parent AS box, count(*) AS n, min(port) AS first FROM edges JOIN nodes ON nodes.id = port GROUP BY 1, 2 HAVING count(*) > 1")
def trunk_groups(d: Data) -> DataFrame:
    return graph.trunks(d.edges, d.nodes)


@query("edge_direction", """SELECT edge, is_port, CASE WHEN is_port THEN dir = 'out' ELSE dir <> 'out' END AS forward, CASE WHEN is_port THEN dir <> 'out' ELSE dir = 'out' END AS backward
  FROM (SELECT edge, true AS is_port, dir FROM edges UNION ALL SELECT edge, false, dir FROM edges WHERE port <> endpoint) x""")
def edge_direction(d: Data) -> DataFrame:
    is_port, direction = F.col("is_port"), F.col("dir")
    return lookup.incident(d.edges).select("edge", "is_port", graph.drives(is_port, direction, True).alias("forward"), graph.drives(is_port, direction, False).alias("backward"))


_NEAR = "near AS (SELECT port AS node, endpoint AS other, edge FROM edges UNION ALL SELECT endpoint, port, edge FROM edges WHERE port <> endpoint)"


@query("cone_wide", f"""WITH {_NEAR}, seeds AS (SELECT id AS seed FROM nodes WHERE kind = 'Param'),
  one AS (SELECT DISTINCT seed, other AS node FROM seeds JOIN near ON near.node = seed WHERE other <> seed),
  two AS (SELECT DISTINCT seed, near.other AS node FROM one JOIN near ON near.node = one.node WHERE near.other <> seed)
  SELECT seed, node, min(hop) AS hop FROM (SELECT seed, seed AS node, 0 AS hop FROM seeds UNION ALL SELECT seed, node, 1 FROM one UNION ALL SELECT seed, node, 2 FROM two) x GROUP BY 1, 2""")
def cone_wide(d: Data) -> DataFrame:
    seeds = d.nodes.where("kind = 'Param'").select(F.col("id").alias("seed"))
    return graph.cone(d.edges, seeds, graph.Limits(2, 1 << 30, 1 << 30))[0]


@query("cone_capped", f"""WITH {_NEAR}, r AS (SELECT node, other, row_number() OVER (PARTITION BY node ORDER BY other, edge) AS r FROM near), seeds AS (SELECT id AS seed FROM nodes WHERE kind = 'Param'),
  one AS (SELECT seed, node FROM (SELECT seed, node, row_number() OVER (PARTITION BY seed ORDER BY node) AS k FROM (SELECT DISTINCT seed, other AS node FROM seeds JOIN r ON r.node = seed WHERE r.r <= 4) x) y WHERE k <= 5),
  zero_one AS (SELECT seed, seed AS node, 0 AS hop FROM seeds UNION ALL SELECT seed, node, 1 FROM one),
  room AS (SELECT seed, 6 - count(*) AS room FROM zero_one GROUP BY seed),
  two AS (SELECT seed, node FROM (SELECT seed, node, row_number() OVER (PARTITION BY seed ORDER BY node) AS k FROM (
      SELECT DISTINCT one.seed, r.other AS node FROM one JOIN r ON r.node = one.node WHERE r.r <= 4 AND (one.seed, r.other) NOT IN (SELECT seed, node FROM zero_one)) x) y JOIN room USING (seed) WHERE k <= room)
  SELECT * FROM zero_one UNION ALL SELECT seed, node, 2 FROM two""")
def cone_capped(d: Data) -> DataFrame:
    seeds = d.nodes.where("kind = 'Param'").select(F.col("id").alias("seed"))
    return graph.cone(d.edges, seeds, graph.Limits(2, 4, 6))[0]


@query("segments", "SELECT sig, t AS t0, coalesce(lead(t) OVER (PARTITION BY sig ORDER BY t, v), t) AS t1, v FROM changes")
def segments(d: Data) -> DataFrame:
    return waves.segments(d.changes)


@query("max_time", "SELECT greatest(1, coalesce(max(t), 1)) AS max_time FROM changes")
def max_time(d: Data) -> DataFrame:
    return waves.max_time(d.changes)


@query("wave_summary", "SELECT sig, count(*) AS n, min(t) AS first, max(t) AS last, max(length(v)) <= 1 AS digital, count(*) FILTER (NOT regexp_matches(v, '^[01]+$')) AS unknown FROM changes GROUP BY sig")
def wave_summary(d: Data) -> DataFrame:
    return waves.summary(d.changes)


def _probes(d: Data) -> DataFrame:
    """Every order, at its date, of the signal of its customer."""
    return d.orders.select((F.col("o_custkey") % 200).alias("sig"), F.expr("unix_micros(CAST(o_orderdate AS TIMESTAMP)) + 900000000000 * (o_orderkey % 3000)").alias("at")).distinct()


_AT = "p AS (SELECT DISTINCT o_custkey % 200 AS sig, epoch_us(o_orderdate) + 900000000000 * (o_orderkey % 3000) AS at FROM orders)"


@query("value_at", f"WITH {_AT} SELECT p.sig, p.at, coalesce((SELECT arg_max(v, t) FROM changes c WHERE c.sig = p.sig AND c.t <= p.at), '') AS value FROM p")
def value_at(d: Data) -> DataFrame:
    return waves.value_at(d.changes, _probes(d))


@query("nearest_edge", f"WITH {_AT} SELECT p.sig, p.at, (SELECT arg_min(t, abs(t - p.at) * 2 + CASE WHEN t > p.at THEN 1 ELSE 0 END) FROM changes c WHERE c.sig = p.sig) AS edge FROM p")
def nearest_edge(d: Data) -> DataFrame:
    return waves.nearest_edge(d.changes, _probes(d))


_HEX = "CASE WHEN e = 'error' THEN CASE WHEN lower(hex(q)) = '0' THEN 'x' ELSE concat(lower(hex(q)), 'x') END ELSE lower(hex(b)) END"
_BITS = "(SELECT sig, t, v, e, CAST(list_reduce(string_split(replace(v, 'x', '0'), ''), lambda a, c: CAST(CAST(a AS BIGINT) * 2 + CAST(c AS BIGINT) AS VARCHAR), '0') AS BIGINT) AS b FROM changes) z0"


@query("value_at_marker", f"""WITH z AS (SELECT *, b // 16 AS q FROM {_BITS}), f AS (SELECT sig, t, v, {_HEX} AS now FROM z), g AS (SELECT *, lag(now) OVER (PARTITION BY sig ORDER BY t, v) AS was FROM f)
  SELECT sig, t, CASE WHEN was IS NULL OR was = now THEN now ELSE concat(was, ' -> ', now) END AS shown FROM g""")
def value_at_marker(d: Data) -> DataFrame:
    return waves.at_edges(d.changes)


@query("format_value", f"""WITH z AS (SELECT *, b // 16 AS q FROM {_BITS}) SELECT sig, t, {_HEX} AS hex, CASE WHEN e = 'error' THEN 'x' ELSE CAST(b AS VARCHAR) END AS dec,
  CASE WHEN ltrim(v, '0') = '' THEN '0' ELSE ltrim(v, '0') END AS bin FROM z""")
def format_value(d: Data) -> DataFrame:
    return d.changes.select("sig", "t", *[bits.format_value(F.col("v"), r).alias(r) for r in ("hex", "dec", "bin")])


@query("format_wide", f"""WITH z AS (SELECT sig, t, e, CAST(b AS HUGEINT) * 1267650600228229401496703205376 AS b FROM {_BITS})
  SELECT sig, t, CASE WHEN e = 'error' THEN 'x' ELSE CAST(b AS VARCHAR) END AS dec FROM z""")
def format_wide(d: Data) -> DataFrame:
    """Values of 120 bits."""
    return d.changes.select("sig", "t", bits.format_value(F.concat("v", F.lit("0" * 100)), "dec").alias("dec"))


@query("slice_bits", "SELECT sig, t, substr(v, 14, 5) AS part, substr(v, 17, 4) AS low, '' AS none FROM changes")
def slice_bits(d: Data) -> DataFrame:
    v = F.col("v")
    return d.changes.select("sig", "t", bits.slice_bits(v, 6, 2).alias("part"), bits.slice_bits(v, 3, -5).alias("low"), bits.slice_bits(v, 0, 3).alias("none"))


@query("trim_bus", "SELECT sig, t, CASE WHEN ltrim(v, '0') = '' THEN '0' ELSE ltrim(v, '0') END AS shown FROM changes")
def trim_bus(d: Data) -> DataFrame:
    return d.changes.select("sig", "t", bits.trim_bus(F.col("v")).alias("shown"))


@query("sub_bus", "SELECT sig, t AS t0, coalesce(lead(t) OVER (PARTITION BY sig ORDER BY t, substr(v, 17, 4)), t) AS t1, substr(v, 17, 4) AS v FROM changes")
def sub_bus(d: Data) -> DataFrame:
    return waves.segments(d.changes.withColumn("v", bits.slice_bits(F.col("v"), 3, 0)))


@query("enum_decode", """SELECT c.sig, c.t, m.member FROM changes c LEFT JOIN enums m ON CASE WHEN contains(c.v, 'x') THEN NULL ELSE (CASE substr(c.v, 18, 1) WHEN '1' THEN 4 ELSE 0 END) + (CASE substr(c.v, 19, 1) WHEN '1' THEN 2 ELSE 0 END) + (CASE substr(c.v, 20, 1) WHEN '1' THEN 1 ELSE 0 END) END = m.value""")
def enum_decode(d: Data) -> DataFrame:
    return waves.enum_decoded(d.changes, d.enums, 3)


@query("tick_marks", """WITH w AS (SELECT sig, min(t) AS t0, max(t) AS t1 FROM changes GROUP BY sig HAVING max(t) > min(t)), r AS (SELECT *, (t1 - t0) / 8.0 AS raw, pow(10, floor(log10((t1 - t0) / 8.0))) AS base FROM w),
  s AS (SELECT *, CAST(greatest(1, base * CASE WHEN raw / base <= 1 THEN 1 WHEN raw / base <= 2 THEN 2 WHEN raw / base <= 5 THEN 5 ELSE 10 END) AS BIGINT) AS step FROM r)
  SELECT sig AS key, step, unnest(range(CAST(ceil(t0 / step) AS BIGINT) * step, t1 + 1, step)) AS tick FROM s""")
def tick_marks(d: Data) -> DataFrame:
    return waves.ticks(d.changes.groupBy(F.col("sig").alias("key")).agg(F.min("t").alias("t0"), F.max("t").alias("t1")))


@query("line_offsets", """WITH l AS (SELECT doc_id AS file, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents)
  SELECT file, CAST(line AS INTEGER) AS line, CAST(coalesce(sum(strlen(text) + 1) OVER (PARTITION BY file ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start, strlen(text) AS bytes FROM l""")
def line_offsets(d: Data) -> DataFrame:
    return spans.lines(_files(d)).select("file", "line", "start", "bytes")


def _files(d: Data) -> DataFrame:
    return d.documents.select(F.col("doc_id").alias("file"), "text")


_LINES = """l AS (SELECT doc_id AS file, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents),
  o AS (SELECT file, line, CAST(coalesce(sum(strlen(text) + 1) OVER (PARTITION BY file ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start, strlen(text) AS bytes FROM l),
  q AS (SELECT doc_id AS file, (doc_id * 7919) % greatest(1, strlen(text)) AS "offset" FROM documents)"""


def _offsets(d: Data) -> DataFrame:
    return d.documents.select(F.col("doc_id").alias("file"), F.expr("(doc_id * 7919) % greatest(1, octet_length(text))").alias("offset"))


@query("line_for_offset", f'WITH {_LINES} SELECT q.file, q."offset", CAST(coalesce(max(o.line), 0) AS INTEGER) AS line FROM q LEFT JOIN o ON o.file = q.file AND o.start <= q."offset" GROUP BY 1, 2')
def line_for_offset(d: Data) -> DataFrame:
    return spans.line_at(spans.lines(_files(d)), _offsets(d))


@query("line_range_for_span", f"""WITH {_LINES}, s AS (SELECT file, "offset" AS lo, "offset" + 200 AS hi FROM q)
  SELECT s.file, lo, hi, CAST(max(o.line) FILTER (o.start <= lo) AS INTEGER) AS first, CAST(max(o.line) FILTER (o.start <= hi - 1) AS INTEGER) AS last FROM s JOIN o ON o.file = s.file GROUP BY 1, 2, 3""")
def line_range_for_span(d: Data) -> DataFrame:
    return spans.line_range(spans.lines(_files(d)), _offsets(d).select("file", F.col("offset").alias("lo"), (F.col("offset") + 200).alias("hi")))


def _ranges(d: Data) -> DataFrame:
    """Lines (id: their number) and whole files (id -1)."""
    rows = spans.lines(_files(d)).select("file", F.col("line").cast("long").alias("id"), F.col("start").alias("lo"), (F.col("start") + F.col("bytes")).alias("hi"))
    return rows.unionAll(d.documents.select("doc_id", F.lit(-1).cast("long"), F.lit(0).cast("long"), F.octet_length("text").cast("long")))


_HITS = """r AS (SELECT file, line AS id, start AS lo, start + bytes AS hi FROM o UNION ALL SELECT doc_id, -1, 0, strlen(text) FROM documents),
  h AS (SELECT q.file, q."offset", r.id, CASE WHEN r.hi > r.lo THEN r.hi - r.lo ELSE 9223372036854775807 END AS width FROM q JOIN r ON r.file = q.file AND r.lo <= q."offset" AND q."offset" < greatest(r.hi, r.lo + 1))"""


@query("probe_source", f'WITH {_LINES}, {_HITS} SELECT file, "offset", id, width FROM h')
def probe_source(d: Data) -> DataFrame:
    return spans.stabbed(_ranges(d), _offsets(d))


@query("narrowest_range", f'WITH {_LINES}, {_HITS} SELECT file, "offset", id, width FROM (SELECT *, rank() OVER (PARTITION BY file, "offset" ORDER BY width) AS k FROM h) x WHERE k = 1')
def narrowest_range(d: Data) -> DataFrame:
    return spans.narrowest(spans.stabbed(_ranges(d), _offsets(d)))


@query("name_refs", r"""WITH l AS (SELECT doc_id AS file, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents)
  SELECT file, CAST(line AS INTEGER) AS line, word, count(*) AS n FROM (SELECT file, line, unnest(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*')) AS word FROM l) w GROUP BY 1, 2, 3""")
def name_refs(d: Data) -> DataFrame:
    return spans.identifiers(spans.lines(_files(d)))


@query("lint_multi_driver", """SELECT symbol, count(DISTINCT process) AS writers, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds FROM (
    SELECT DISTINCT l_partkey AS symbol, l_suppkey AS process, CASE l_returnflag WHEN 'A' THEN 'ff' WHEN 'R' THEN 'comb' ELSE 'assign' END AS kind FROM lineitem) w
  GROUP BY symbol HAVING count(DISTINCT process) > 1 AND bool_or(kind = 'ff')""")
def lint_multi_driver(d: Data) -> DataFrame:
    kind = F.when(F.col("l_returnflag") == "A", "ff").when(F.col("l_returnflag") == "R", "comb").otherwise("assign")
    return quality.multi_driver(d.lineitem.select(F.col("l_partkey").alias("symbol"), F.col("l_suppkey").alias("process"), kind.alias("kind")))


@query("mux_chain", """SELECT l_orderkey AS target, p AS priority, concat('s', l_suppkey) AS condition, concat('p', l_partkey) AS d1,
    coalesce('mux' || lead(p) OVER (PARTITION BY l_orderkey ORDER BY p), CAST(l_orderkey AS VARCHAR)) AS d0
  FROM (SELECT l_orderkey, l_linenumber AS p, min(l_suppkey) AS l_suppkey, min(l_partkey) AS l_partkey FROM lineitem GROUP BY 1, 2) x""")
def mux_chain(d: Data) -> DataFrame:
    rows = d.lineitem.groupBy(F.col("l_orderkey").alias("target"), F.col("l_linenumber").alias("priority")).agg(F.min("l_suppkey").alias("s"), F.min("l_partkey").alias("p"))
    return quality.mux_chain(rows.select(F.col("target"), "priority", F.concat(F.lit("s"), "s").alias("condition"), F.concat(F.lit("p"), "p").alias("value")))


@query("latency_summary", """SELECT event_type, round(avg(value), 6) AS mean, max(CASE WHEN r = floor((n - 1) * 0.5 + 0.5) THEN value END) AS p50, max(CASE WHEN r = floor((n - 1) * 0.95 + 0.5) THEN value END) AS p95, max(value) AS max
  FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL) x GROUP BY 1""")
def latency_summary(d: Data) -> DataFrame:
    return quality.percentiles(d.events, "event_type", "value")


@query("match_gate", f"""WITH {_CLASS}, g AS (SELECT 'all' AS names, * FROM fin UNION ALL SELECT 'known', * FROM fin WHERE status <> 'mystery' UNION ALL SELECT 'direct', * FROM fin WHERE status IN ('direct', 'excluded') UNION ALL SELECT 'none', * FROM fin WHERE status = 'excluded'),
  c AS (SELECT names, count(*) FILTER (status IN ('direct', 'alias')) AS hits, count(*) FILTER (status = 'unmatched') AS misses, count(*) FILTER (status = 'mystery') AS mystery FROM g GROUP BY names)
  SELECT names, round(CASE WHEN hits + misses = 0 THEN 1.0 ELSE hits / (hits + misses) END, 6) AS hit_rate, CASE WHEN hits + misses = 0 THEN 1.0 ELSE hits / (hits + misses) END >= 0.95 AND mystery = 0 AS passes FROM c""")
def match_gate(d: Data) -> DataFrame:
    """The gate over all names, and over those that it lets pass: without mysteries, direct ones only, none to match at all."""
    found = saved(_match(d).select("status"), "statuses")
    parts = {"all": "true", "known": "status <> 'mystery'", "direct": "status IN ('direct', 'excluded')", "none": "status = 'excluded'"}
    out = None
    for name, rows in parts.items():
        part = linkage.report(found.where(rows)).select(F.lit(name).alias("names"), "hit_rate", "passes")
        out = part if out is None else out.unionAll(part)
    return out


_SWAPPED = "v2 AS (SELECT var_ref, CASE WHEN var_ref % 3 = 0 THEN replace(full_name, 'TOP.tb.dut.', 'SIM.') ELSE full_name END AS full_name, is_parameter FROM vars)"


@query("rematch", f"""WITH {_SWAPPED}, s AS (SELECT var_ref, is_parameter, string_split(full_name, '.') AS s FROM v2 WHERE full_name LIKE 'SIM.%'),
  t AS (SELECT var_ref, array_to_string(list_prepend('top', list_filter(s[2:], lambda x: NOT regexp_matches(x, '^\\[[0-9]+\\]$') AND NOT regexp_matches(x, '^genblk[0-9]+$'))), '.') AS target FROM s),
  p AS (SELECT path, arg_min(id, (CASE kind WHEN 'Net' THEN 1 WHEN 'Port' THEN 2 ELSE 0 END) * 100000000000000 + id) AS id FROM nodes WHERE kind IN ('Var', 'Memory', 'Net', 'Port') GROUP BY path)
  SELECT var_ref, p.id AS node FROM t JOIN p ON p.path = t.target""".replace("{1", "{{1"))
def rematch(d: Data) -> DataFrame:
    """The design against another trace, a third of whose names stand under another anchor: the names that are found there directly."""
    nodes, names = d.settled()
    names.createOrReplaceTempView("vars")
    names = d.sql(f"WITH {_SWAPPED} SELECT * FROM v2")
    return linkage.matched(names, nodes, linkage.Options(anchor=("SIM",))).where("status = 'direct'").select("var_ref", "node")


@query("signal_values", "SELECT sig, t, v FROM changes WHERE sig = (SELECT min(sig) FROM changes)")
def signal_values(d: Data) -> DataFrame:
    return d.changes.join(F.broadcast(d.changes.agg(F.min("sig").alias("sig"))), "sig", "left_semi").select("sig", "t", "v")  # one row


@query("source_files", "SELECT doc_id AS file, strlen(text) AS bytes, len(string_split(text, chr(10))) AS lines FROM documents")
def source_files(d: Data) -> DataFrame:
    return d.documents.select(F.col("doc_id").alias("file"), F.octet_length("text").alias("bytes"), F.size(F.split("text", "\n")).alias("lines"))


@query("parse_excluded", r"SELECT p_partkey, array_to_string(list_filter(regexp_split_to_array(p_name, '[\s,]+'), lambda x: x <> ''), ',') AS scopes FROM part")
def parse_excluded(d: Data) -> DataFrame:
    return d.part.select("p_partkey", F.array_join(F.filter(F.split("p_name", r"[\s,]+"), lambda x: x != ""), ",").alias("scopes"))


@query("canonical_edges", "SELECT port, endpoint, dir, coalesce(sel, '') AS sel, row_number() OVER (PARTITION BY port ORDER BY endpoint, dir, coalesce(sel, '')) AS pos FROM edges")
def canonical_edges(d: Data) -> DataFrame:
    from pyspark.sql import Window

    rows = d.edges.select("port", "endpoint", "dir", F.coalesce("sel", F.lit("")).alias("sel"))
    return rows.withColumn("pos", F.row_number().over(Window.partitionBy("port").orderBy("endpoint", "dir", "sel")))


@query("structural_wires", """SELECT least(x, y) AS a, greatest(x, y) AS b, count(*) AS n FROM (
    SELECT coalesce(p.parent, p.id) AS x, coalesce(q.parent, q.id) AS y FROM edges JOIN nodes p ON p.id = port JOIN nodes q ON q.id = endpoint) w WHERE x <> y GROUP BY 1, 2""")
def structural_wires(d: Data) -> DataFrame:
    return schematic.wires(d.nodes, d.edges)


@query("scope_predicates", f"""WITH RECURSIVE {_NAV} SELECT id, id IN (SELECT id FROM nav) AS navigable, kind IN ('FF', 'Comb', 'Latch', 'Assign', 'Memory') AS logic, kind IN ('Port', 'Net', 'Var', 'Memory') AS signal FROM scopes""")
def scope_predicates(d: Data) -> DataFrame:
    return schematic.predicates(d.scopes)


@query("tree_hoist", f"""WITH RECURSIVE {_NAV}, arr AS (SELECT id, parent FROM scopes a WHERE kind = 'GenBlock' AND name <> '' AND EXISTS (SELECT 1 FROM scopes k WHERE k.parent = a.id AND k.kind = 'GenBlock' AND k.name = ''))
  SELECT parent, id AS child FROM nav WHERE parent IS NOT NULL AND id NOT IN (SELECT id FROM arr)
  UNION ALL SELECT arr.parent, nav.id FROM nav JOIN arr ON nav.parent = arr.id WHERE arr.id IN (SELECT id FROM nav)""")
def tree_hoist(d: Data) -> DataFrame:
    return schematic.hoisted(d.scopes)


@query("prune_subtree", """SELECT id FROM nodes WHERE NOT EXISTS (SELECT 1 FROM nation WHERE n_nationkey % 2 = 1 AND (nodes.path = concat('top.r', n_regionkey, '.n', n_nationkey) OR nodes.path LIKE concat('top.r', n_regionkey, '.n', n_nationkey, '.%')))""")
def prune_subtree(d: Data) -> DataFrame:
    """Without the subtrees of every second nation (branches that weren't instantiated)."""
    gone = d.nation.where("n_nationkey % 2 = 1").select(F.concat(F.lit("top.r"), "n_regionkey", F.lit(".n"), "n_nationkey").alias("path"))
    return schematic.pruned(d.nodes, gone).select("id")


@query("unambiguous_select", "SELECT port, min(sel) AS sel FROM edges WHERE sel IS NOT NULL GROUP BY port HAVING count(DISTINCT sel) = 1")
def unambiguous_select(d: Data) -> DataFrame:
    return schematic.unambiguous_select(d.edges)


@query("resolve_candidates", """WITH h AS (SELECT e.endpoint AS probe, n.path, arg_min(n.id, (CASE n.kind WHEN 'Var' THEN 0 WHEN 'Net' THEN 1 WHEN 'Port' THEN 2 ELSE 5 END) * 100000000000000 + n.id) AS rep
    FROM edges e JOIN nodes n ON n.id = e.port GROUP BY 1, 2), s AS (SELECT path, count(*) AS size FROM nodes GROUP BY path)
  SELECT probe, arg_min(rep, concat(CASE WHEN h.path LIKE 'top.r1.%' THEN '0' ELSE '1' END, h.path)) AS anchor, count(*) - 1 AS others, CAST(sum(size) AS BIGINT) AS nodes FROM h JOIN s ON s.path = h.path GROUP BY probe""")
def resolve_candidates(d: Data) -> DataFrame:
    hits = d.edges.select(F.col("endpoint").alias("probe"), F.col("port").alias("id"))
    return probe.candidates(hits, d.nodes, ("probe",), context="top.r1")


@query("to_wave", f"""WITH {_CLASS}, ix AS (SELECT coalesce(direct, alias) AS node, arg_max(var_ref, CASE status WHEN 'direct' THEN 100000000000000 ELSE 0 END + var_ref) AS var_ref FROM fin WHERE status IN ('direct', 'alias') GROUP BY 1)
  SELECT a.id AS probe, arg_min(ix.var_ref, CASE WHEN b.id = a.id THEN 0 ELSE 100000000000000 END + b.id) FILTER (ix.var_ref IS NOT NULL) AS var_ref
  FROM nodes a JOIN nodes b ON b.path = a.path LEFT JOIN ix ON ix.node = b.id WHERE a.kind IN ('Port', 'Net') GROUP BY a.id""")
def to_wave(d: Data) -> DataFrame:
    index = saved(linkage.wave_index(_match(d)), "index")
    anchors = d.nodes.where("kind IN ('Port', 'Net')").select(F.col("id").alias("probe"), F.col("id").alias("anchor"))
    return probe.to_wave(anchors, d.nodes, index, "probe")


@query("probe_signal", f"""WITH {_CLASS} SELECT var_ref, coalesce(direct, alias) AS node, n.path, n.kind FROM fin JOIN nodes n ON n.id = coalesce(direct, alias) WHERE status IN ('direct', 'alias')""")
def probe_signal(d: Data) -> DataFrame:
    return _match(d).where("node IS NOT NULL").select("var_ref", "node").join(d.nodes.select(F.col("id").alias("node"), "path", "kind"), "node")


@query("probe_name_ref", """SELECT concat(c.id, '') AS ref, n.id FROM nodes c JOIN nodes p ON p.id = c.parent JOIN nodes n ON n.path = concat(p.path, '.', c.name) WHERE c.kind IN ('Net', 'Port') UNION
  SELECT concat('p', c.id), n.id FROM nodes c JOIN nodes n ON n.path = c.path WHERE c.kind = 'Var'""")
def probe_name_ref(d: Data) -> DataFrame:
    """Signals by name inside their scope, and variables by absolute path."""
    inside = d.nodes.where("kind IN ('Net', 'Port')")
    refs = inside.select(F.col("id").cast("string").alias("ref"), F.col("name").alias("rel"))
    refs = refs.unionAll(d.nodes.where("kind = 'Var'").select(F.concat(F.lit("p"), "id"), F.concat(F.lit("/"), "path")))
    scopes = inside.alias("c").join(d.nodes.alias("p"), F.col("c.parent") == F.col("p.id")).select(F.col("c.id").cast("string").alias("ref"), F.col("p.path").alias("scope"))
    return probe.references(refs, scopes, d.nodes)


@query("parse_sv_int", "SELECT p_partkey, concat(p_size, '') AS hex, concat(p_size, '') AS dec, CAST(NULL AS VARCHAR) AS bad, CAST(CAST(p_size AS HUGEINT) * 79228162514264337593543950336 AS VARCHAR) AS wide, concat('1', p_partkey, repeat('7', 1200)) AS long FROM part")
def parse_sv_int(d: Data) -> DataFrame:
    size = F.col("p_size")
    literal = F.concat(F.lit("32'h0_"), F.hex(size))
    bad = F.concat(F.lit("8'b1x"), size.cast("string"))
    # the table is small in bytes, so a file is one task; its literals are not small work
    part = d.part.select("p_partkey", "p_size")
    part = part.repartition(part.count() // 5_000 + 1)
    return part.select("p_partkey", quality.parse_int(literal).alias("hex"), quality.parse_int(F.concat(F.lit("32'd"), size.cast("string"))).alias("dec"), quality.parse_int(bad).alias("bad"), quality.parse_int(F.concat(F.lit("128'sh"), F.hex(size), F.lit("_0" * 24))).alias("wide"), quality.parse_int(F.concat(F.lit("4096'd01"), F.col("p_partkey").cast("string"), F.lit("7" * 1200))).alias("long"))


@query("logic_role", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE l_returnflag WHEN 'A' THEN CASE WHEN l_linestatus = 'F' THEN 'ff' ELSE 'comb' END WHEN 'R' THEN 'latch' ELSE 'assign' END AS role FROM lineitem")
def logic_role(d: Data) -> DataFrame:
    keyword = F.when(F.col("l_returnflag") == "A", "always").when(F.col("l_returnflag") == "R", "always_latch").otherwise("assign")
    return d.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", quality.logic_role(keyword, F.col("l_linestatus") == "F").alias("role"))


@query("zoom_window", "SELECT sig, (max(t) - min(t)) * CAST(0.25 AS DOUBLE) AS a, (max(t) - min(t)) * CAST(0.75 AS DOUBLE) AS b FROM changes GROUP BY sig HAVING max(t) - min(t) >= 2")
def zoom_window(d: Data) -> DataFrame:
    """Half of each signal's time, counted from its first change, about its middle."""
    rows = d.changes.groupBy("sig").agg((F.max("t") - F.min("t")).alias("t1")).where("t1 >= 2").withColumn("t0", F.lit(0).cast("long"))
    a, b = bits.zoom_window(F.col("t0"), F.col("t1"), 0.5, (F.col("t0") + F.col("t1")) / 2, F.col("t0"), F.col("t1"))
    return rows.select("sig", a.alias("a"), b.alias("b"))


@query("pin_width", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN concat('[', p_size, ':0]') ELSE concat('[', p_size - 1, ':0]') END AS width FROM part")
def pin_width(d: Data) -> DataFrame:
    size = F.col("p_size")
    kind = F.when(size % 2 == 0, F.concat(F.lit("logic["), size.cast("string"), F.lit(":0][7:0]"))).otherwise("state_e")
    return d.part.select("p_partkey", schematic.width(kind, F.when(size % 2 == 1, size)).alias("width"))


@query("nav_targets", "SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY parent ORDER BY id) - 1 AS r, greatest(1, count(*) OVER (PARTITION BY parent) // 4) AS step FROM nodes) x WHERE r % step = 0 AND r // step < 4")
def nav_targets(d: Data) -> DataFrame:
    """Four strided samples of each scope's children: a sampling operator."""
    from pyspark.sql import Window

    rows = d.nodes.withColumn("r", F.row_number().over(Window.partitionBy("parent").orderBy("id")) - 1)
    rows = rows.withColumn("step", F.greatest(F.lit(1).cast("long"), F.expr("count(*) OVER (PARTITION BY parent) div 4")))
    return rows.where("r % step = 0 AND r div step < 4").select("id")


from netloom.plans import more, scopes, texts, traces, trees  # noqa: E402, F401  register further queries
