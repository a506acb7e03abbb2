"""Queries of traces over boxes and pins, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.operators import trace
from netloom.operators.graph import Limits
from netloom.operators.store import sized
from netloom.plans.queries import Data, query

# w: nets of the top; d, q: a customer's port that reads its net, and the one that drives it; hop: the two readers of a net that are followed first.
_HOP = """w AS (SELECT id AS trace, name FROM chip WHERE kind = 'Net' AND parent = 0),
  d AS (SELECT trace, w.name, p.parent AS c, p.id AS b, row_number() OVER (PARTITION BY trace ORDER BY edge) AS r FROM w JOIN chip_edges e ON e.endpoint = trace AND e.dir = 'in' JOIN chip p ON p.id = e.port),
  hop AS (SELECT * FROM d WHERE r <= 2),
  q AS (SELECT trace, w.name, p.parent AS c, p.id AS o, e.sel FROM w JOIN chip_edges e ON e.endpoint = trace AND e.dir = 'out' JOIN chip p ON p.id = e.port),
  cut AS (SELECT trace, CAST(trace AS VARCHAR) AS pin, count(*) - 2 AS more FROM d GROUP BY trace HAVING count(*) > 2)"""


def _items(made: tuple[DataFrame, DataFrame, DataFrame, DataFrame]) -> DataFrame:
    """(trace, item, more): a row for each node with what is around it, each pin with what was left out, each wire with its net, and each trace that was cut."""
    nodes, pins, wires, cut = made
    text = lambda *parts: F.concat_ws(" ", *parts)
    none = F.lit(0).cast("long").alias("more")
    rows = nodes.select("trace", text(F.when(F.col("boxed"), "box").otherwise("stub"), "kind", "node", "within").alias("item"), none)
    rows = rows.unionAll(pins.select("trace", text(F.lit("pin"), "node", "pin").alias("item"), "more"))
    rows = rows.unionAll(wires.select("trace", text(F.lit("wire"), "source", "target", "net", "constant").alias("item"), none))
    return rows.unionAll(cut.where("truncated").select("trace", text(F.lit("cut"), "root").alias("item"), none))


def _traced(d: Data, *steps: tuple[str, str, int, int | None]) -> DataFrame:
    """One trace a net of the top; a step's seed is the net, or the first port that drives it."""
    nodes, edges = sized(d.chip, "chip"), sized(d.chip_edges, "chip_edges")
    nets = nodes.where("kind = 'Net' AND parent = 0").select(F.col("id").alias("net"))
    first = edges.where("dir = 'out'").join(nets, F.col("endpoint") == F.col("net")).groupBy("net").agg(F.min("port").alias("port"))
    at = nets.join(first, "net", "left")
    made = None
    for k, (seed, way, depth, fanout) in enumerate(steps):
        step = at.select(F.col("net").alias("trace"), F.lit(k + 1).alias("step"), F.col(seed).alias("seed"), F.lit(way).alias("dir"), F.lit(depth).alias("depth"), F.lit(fanout).cast("int").alias("fanout"))
        made = step if made is None else made.unionAll(step)
    return _items(trace.trace_graph(nodes, edges, made, Limits(fanout=2)))


@query("cone_pins", f"""WITH {_HOP}
  SELECT trace, concat('box Instance ', c) AS item, CAST(0 AS BIGINT) AS more FROM hop
  UNION ALL SELECT trace, concat('stub Net ', trace), 0 FROM w
  UNION ALL SELECT trace, concat('pin ', c, ' ', b), 0 FROM hop UNION ALL SELECT trace, concat('pin ', q.c, ' ', o), 0 FROM q JOIN hop USING (trace, c)
  UNION ALL SELECT trace, concat('pin ', trace, ' ', trace), coalesce(more, 0) FROM w LEFT JOIN cut USING (trace)
  UNION ALL SELECT trace, concat('wire ', trace, ' ', b, ' ', name), 0 FROM hop
  UNION ALL SELECT trace, concat('wire ', o, ' ', trace, ' ', q.name, coalesce(sel, '')), 0 FROM q JOIN hop USING (trace, c)
  UNION ALL SELECT trace, 'cut top', 0 FROM cut""")
def cone_pins(d: Data) -> DataFrame:
    """What reads each net of the top, two connections at most: boxes, pins with what was left out, wires; what drives it from a box that is drawn is met as well."""
    return _traced(d, ("net", "out", 1, None))


@query("trace_graph", f"""WITH {_HOP},
  mem AS (SELECT id AS m, parent AS c, name, path FROM chip),
  n2 AS (SELECT trace, h.c, h.b, e.port, e.endpoint, x.kind, x.parent, e.sel, row_number() OVER (PARTITION BY trace, h.c ORDER BY e.edge) AS r FROM hop h JOIN chip_edges e ON e.endpoint IN (h.b, h.b + 1) AND e.dir <> 'out' JOIN chip x ON x.id = e.port),
  s2 AS (SELECT trace, c, b, CASE kind WHEN 'Port' THEN parent ELSE port END AS u, CASE kind WHEN 'Port' THEN concat(port, '') ELSE concat(port, '/', endpoint) END AS pin, sel FROM n2 WHERE r <= 2),
  f3 AS (SELECT trace, min(o) AS o FROM q GROUP BY trace),
  n3 AS (SELECT f3.trace, q.c, f3.o, e.port AS u, e.sel, row_number() OVER (PARTITION BY f3.trace ORDER BY e.edge) AS r FROM f3 JOIN q ON q.trace = f3.trace AND q.o = f3.o JOIN chip_edges e ON e.endpoint = f3.o AND e.dir = 'out'),
  s3 AS (SELECT trace, c, o, u, concat(u, '/', o) AS pin, sel FROM n3 WHERE r <= 2),
  left_out AS (SELECT * FROM cut UNION ALL SELECT trace, CAST(b AS VARCHAR), count(*) - 2 FROM n2 GROUP BY trace, b HAVING count(*) > 2 UNION ALL SELECT trace, CAST(o AS VARCHAR), count(*) - 2 FROM n3 GROUP BY trace, o HAVING count(*) > 2),
  pins AS (SELECT trace, c AS node, CAST(b AS VARCHAR) AS pin FROM hop UNION SELECT trace, c, CAST(o AS VARCHAR) FROM q UNION SELECT trace, trace, CAST(trace AS VARCHAR) FROM w UNION SELECT trace, u, pin FROM s2 UNION SELECT trace, u, pin FROM s3),
  one AS (SELECT endpoint AS o, min(port) AS u FROM chip_edges WHERE dir = 'out' GROUP BY endpoint HAVING count(*) = 1 AND count(sel) = 0),
  tie AS (SELECT o, const FROM one JOIN chip x ON x.id = u AND x.kind IN ('Assign', 'Comb') AND x.const IS NOT NULL)
  SELECT DISTINCT trace, concat('box ', kind, ' ', id) AS item, CAST(0 AS BIGINT) AS more FROM (SELECT trace, c FROM hop UNION SELECT trace, c FROM q) k JOIN chip ON id = c
  UNION ALL SELECT DISTINCT trace, concat('box ', kind, ' ', id, ' ', c), 0 FROM (SELECT trace, u, c FROM s2 UNION SELECT trace, u, c FROM s3) k JOIN chip ON id = u
  UNION ALL SELECT trace, concat('stub Net ', trace), 0 FROM w
  UNION ALL SELECT p.trace, concat('pin ', node, ' ', p.pin), coalesce(more, 0) FROM pins p LEFT JOIN left_out l ON l.trace = p.trace AND l.pin = p.pin
  UNION ALL SELECT trace, concat('wire ', trace, ' ', b, ' ', name), 0 FROM hop
  UNION ALL SELECT trace, concat('wire ', o, ' ', trace, ' ', name, coalesce(sel, '')), 0 FROM q
  UNION ALL SELECT trace, concat('wire ', b, ' ', pin, ' ', substr(path, 5), coalesce(sel, '')), 0 FROM s2 JOIN mem ON m = b
  UNION ALL SELECT trace, concat('wire ', pin, ' ', s3.o, ' ', substr(path, 5), coalesce(sel, ''), CASE WHEN sel IS NULL THEN coalesce(' ' || tie.const, '') ELSE '' END), 0 FROM s3 JOIN mem ON m = s3.o LEFT JOIN tie ON tie.o = s3.o
  UNION ALL SELECT DISTINCT trace, 'cut top', 0 FROM left_out""")
def trace_graph(d: Data) -> DataFrame:
    """Three steps from each net of the top: two hops to what reads it, one to all that drives it, one to what drives the first port that does."""
    return _traced(d, ("net", "out", 2, None), ("net", "in", 1, 50), ("port", "in", 1, None))
