"""The design graph and the waveform as views over the driver's tables.

Each view is one SQL text that Spark and DuckDB both read; only the few functions that differ are filled in. Ids are
given by rule (a base for each kind plus the table's key), never by row order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "benchmark")

#: Functions by another name: microseconds of a timestamp, strings of an array, bytes of a string, elements of an array as rows.
SPARK = {"us": "unix_micros(CAST({} AS TIMESTAMP))", "bytes": "octet_length({})", "any": "bool_or"}
DUCK = {"us": "epoch_us({})", "bytes": "strlen({})", "any": "bool_or"}

NODES = """
  SELECT CAST(0 AS BIGINT) AS id, 'Instance' AS kind, 'top' AS name, 'top' AS path, CAST(NULL AS BIGINT) AS parent
  UNION ALL SELECT CAST(1000 + r_regionkey AS BIGINT), 'Instance', concat('r', r_regionkey), concat('top.r', r_regionkey), CAST(0 AS BIGINT) FROM region
  UNION ALL SELECT CAST(2000 + n_nationkey AS BIGINT), 'Instance', concat('n', n_nationkey), concat('top.r', n_regionkey, '.n', n_nationkey), CAST(1000 + n_regionkey AS BIGINT) FROM nation
  UNION ALL SELECT 1000000000000 + c_custkey, 'Instance', concat('c', c_custkey), concat('top.r', n_regionkey, '.n', n_nationkey, '.c', c_custkey), CAST(2000 + n_nationkey AS BIGINT)
    FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT 3000000000000 + o_orderkey, 'GenBlock', '', concat('top.r', n_regionkey, '.n', n_nationkey, '.c', c_custkey, '.o[', o_orderkey, ']'), 1000000000000 + c_custkey
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT 4000000000000 + o_orderkey * 8 + l_linenumber, 'Net', concat('l', l_linenumber), concat('top.r', n_regionkey, '.n', n_nationkey, '.c', c_custkey, '.o[', o_orderkey, '].l', l_linenumber), 3000000000000 + o_orderkey
    FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) l JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT 6000000000000 + o_orderkey * 8 + l_linenumber, 'Port', concat('l', l_linenumber), concat('top.r', n_regionkey, '.n', n_nationkey, '.c', c_custkey, '.o[', o_orderkey, '].l', l_linenumber), 3000000000000 + o_orderkey
    FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R') l JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT 5000000000000 + p_partkey, CASE WHEN p_type LIKE 'PROMO%' THEN 'Memory' WHEN p_type LIKE 'SMALL%' THEN 'Param' ELSE 'Var' END, concat('p', p_partkey), concat('top.p', p_partkey), CAST(0 AS BIGINT)
    FROM part
"""

EDGES = """
  SELECT concat(port, '>', endpoint, dir, coalesce(sel, '')) AS edge, port, endpoint, dir, sel FROM (
    SELECT DISTINCT 4000000000000 + l_orderkey * 8 + l_linenumber AS port, 5000000000000 + l_partkey AS endpoint,
      CASE l_returnflag WHEN 'A' THEN 'in' WHEN 'R' THEN 'out' ELSE 'inout' END AS dir, CASE WHEN l_linestatus = 'F' THEN '[0]' END AS sel
    FROM lineitem) e
"""

CHANGES = """
  SELECT sig, t, CASE WHEN e = 'error' THEN concat(substr(v, 1, 19), 'x') ELSE v END AS v, e FROM (
    SELECT user_id AS sig, {us[ts]} AS t, lpad(bin(CAST(round(value * 100) AS BIGINT)), 20, '0') AS v, event_type AS e FROM events) c
"""

VARS = """
  SELECT id AS var_ref, CASE substr(name, 2)
      WHEN '2' THEN concat('TOP.tb.dut.', replace(substr(path, 5), '.o[', '.genblk1.o['))
      WHEN '3' THEN concat('TOP.tb.dut.', substr(path, 5), '.[7]')
      WHEN '4' THEN concat('TOP.tb.dut.', replace(substr(path, 5), '.o[', '.hold.o['))
      WHEN '5' THEN concat('TOP.tb.dut.', substr(path, 5), '_x')
      WHEN '6' THEN concat('TOP.tb.sig', id) WHEN '7' THEN concat('OTHER.x', id)
      ELSE concat('TOP.tb.dut.', substr(path, 5)) END AS full_name, false AS is_parameter
  FROM nodes WHERE kind = 'Net'
  UNION ALL SELECT id, concat('TOP.tb.dut.', substr(path, 5)), id % 2 = 0 FROM nodes WHERE kind = 'Param'
"""

ENUMS = """
  SELECT event_type AS member, row_number() OVER (ORDER BY event_type) - 1 AS value FROM (SELECT DISTINCT event_type FROM events) e
"""

#: A smaller design whose generate arrays have names and hold blocks with and without instances, and whose interfaces have views.
SCOPES = """
  SELECT CAST(0 AS BIGINT) AS id, 'Instance' AS kind, 'top' AS name, 'top' AS path, CAST(NULL AS BIGINT) AS parent
  UNION ALL SELECT 1000000000000 + c_custkey, 'Instance', concat('c', c_custkey), concat('top.c', c_custkey), CAST(0 AS BIGINT) FROM customer
  UNION ALL SELECT DISTINCT 7000000000000 + o_custkey, 'GenBlock', 'lane', concat('top.c', o_custkey, '.lane'), 1000000000000 + o_custkey FROM orders
  UNION ALL SELECT 3000000000000 + o_orderkey, 'GenBlock', '', concat('top.c', o_custkey, '.lane[', o_orderkey, ']'), 7000000000000 + o_custkey FROM orders
  UNION ALL SELECT 8000000000000 + o_orderkey, 'GenBlock', 'g', concat('top.c', o_custkey, '.lane[', o_orderkey, '].g'), 3000000000000 + o_orderkey FROM orders WHERE o_orderkey % 2 = 0
  UNION ALL SELECT 9000000000000 + o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'Net' ELSE 'Instance' END, 'u', concat('top.c', o_custkey, '.lane[', o_orderkey, '].g.u'), 8000000000000 + o_orderkey FROM orders WHERE o_orderkey % 2 = 0
  UNION ALL SELECT 10000000000000 + s_suppkey, 'Interface', concat('i', s_suppkey), concat('top.i', s_suppkey), CAST(0 AS BIGINT) FROM supplier
  UNION ALL SELECT 11000000000000 + s_suppkey, 'Modport', 'm', concat('top.i', s_suppkey, '.m'), 10000000000000 + s_suppkey FROM supplier WHERE s_suppkey % 2 = 0
"""

#: Gates of orders as blocks: a chain of expressions, whose last gate drives the order's net.
GATES = """
  SELECT o_orderkey * 8 + l_linenumber AS id, CASE WHEN l_linenumber % 3 = 2 THEN 'Not' WHEN l_partkey % 2 = 0 THEN 'And' ELSE 'Or' END AS kind, o_orderkey AS parent
  FROM (SELECT l_orderkey AS o_orderkey, l_linenumber, min(l_partkey) AS l_partkey FROM lineitem GROUP BY 1, 2) l
"""

GATE_EDGES = """
  SELECT g.id + 1 AS port, g.id AS endpoint, 'in' AS dir FROM gates g JOIN gates h ON h.id = g.id + 1
  UNION ALL SELECT id, -parent, 'out' FROM (SELECT max(id) AS id, parent FROM gates GROUP BY parent) l
  UNION ALL SELECT id, -100000000000 - id % 97, 'in' FROM gates WHERE id % 5 > 0
  UNION ALL SELECT g.id + 2, g.id, 'in' FROM gates g JOIN gates h ON h.id = g.id + 2 WHERE g.kind = 'Not' AND g.parent % 4 = 0
"""

#: A design with everything a scope graph draws: ports with backing nets, instances and logic in and out of GenBlocks, memories, literals, interfaces with a view.
CHIP = """
  WITH c AS (SELECT c_custkey AS c, 1000000000000 + c_custkey AS id, concat('top.c', c_custkey) AS path, 2000000000000 + c_custkey * 8 AS b FROM customer),
  u AS (SELECT o_orderkey AS o, c.id AS cust, c.path AS cp, CASE WHEN o_orderkey % 4 = 0 THEN 5000000000000 + o_orderkey ELSE c.id END AS parent, 6000000000000 + o_orderkey * 8 AS id,
    concat(c.path, CASE WHEN o_orderkey % 4 = 0 THEN concat('.g[', o_orderkey, ']') ELSE '' END, '.u', o_orderkey) AS path FROM orders JOIN c ON c.c = o_custkey),
  k AS (SELECT * FROM (VALUES (0, 'Port', 'd', 'in'), (1, 'Net', 'd', NULL), (2, 'Port', 'q', 'out'), (3, 'Net', 'n0', NULL), (4, 'Net', 'n1', NULL), (5, 'Net', 'n2', NULL), (6, 'Interface', 'bus', NULL)) AS v(i, kind, name, dir))
  SELECT CAST(0 AS BIGINT) AS id, 'Instance' AS kind, 'top' AS name, 'top' AS path, CAST(NULL AS BIGINT) AS parent, CAST(NULL AS STRING) AS dir, CAST(NULL AS STRING) AS modport, CAST(NULL AS STRING) AS const
  UNION ALL SELECT id, 'Instance', concat('c', c), path, CAST(0 AS BIGINT), NULL, NULL, NULL FROM c
  UNION ALL SELECT b + i, CASE WHEN i = 5 AND c % 4 = 0 THEN 'Memory' ELSE kind END, name, concat(path, '.', name), id, dir, NULL, NULL FROM c CROSS JOIN k
  UNION ALL SELECT b + 7, 'Net', 'valid', concat(path, '.bus.valid'), b + 6, NULL, NULL, NULL FROM c
  UNION ALL SELECT 4000000000000 + c, 'Modport', 'm', concat(path, '.bus.m'), b + 6, NULL, NULL, NULL FROM c
  UNION ALL SELECT DISTINCT 7000000000000 + c % 1000000 - c % 4, 'Net', concat('w', c - c % 4), concat('top.w', c - c % 4), CAST(0 AS BIGINT), NULL, NULL, NULL FROM c
  UNION ALL SELECT parent, 'GenBlock', '', concat(cp, '.g[', o, ']'), cust, NULL, NULL, NULL FROM u WHERE o % 4 = 0
  UNION ALL SELECT id, CASE o % 3 WHEN 0 THEN 'Instance' WHEN 1 THEN 'FF' ELSE 'Assign' END, concat('u', o), path, parent, NULL, NULL, CASE WHEN o % 3 = 2 AND o % 7 = 0 THEN concat(o % 10, '') END FROM u
  UNION ALL SELECT id + 1, 'Port', 'i', concat(path, '.i'), id, 'in', NULL, CASE WHEN o % 5 = 0 THEN '1' END FROM u WHERE o % 3 = 0
  UNION ALL SELECT id + 2, 'Port', 'o', concat(path, '.o'), id, 'out', NULL, NULL FROM u WHERE o % 3 = 0
  UNION ALL SELECT id + 3, 'Interface', 'b', concat(path, '.b'), id, NULL, 'm', NULL FROM u WHERE o % 6 = 0
  UNION ALL SELECT id + 4, 'Port', 'valid', concat(cp, '.bus.valid'), id + 3, 'out', NULL, NULL FROM u WHERE o % 6 = 0
  UNION ALL SELECT id + 5, 'FF', 'f', concat(path, '.f'), id, NULL, NULL, NULL FROM u WHERE o % 3 = 0
"""

CHIP_EDGES = """
  WITH u AS (SELECT o_orderkey AS o, 6000000000000 + o_orderkey * 8 AS id, 2000000000000 + o_custkey * 8 AS b FROM orders),
  w AS (SELECT 2000000000000 + c_custkey * 8 AS b, 7000000000000 + c_custkey % 1000000 - c_custkey % 4 AS net FROM customer)
  SELECT concat(port, '>', endpoint, dir, coalesce(sel, '')) AS edge, port, endpoint, dir, sel FROM (
    SELECT id + 1 AS port, CASE WHEN o % 7 = 3 THEN b ELSE b + 3 + o % 3 END AS endpoint, 'in' AS dir, CASE WHEN o % 4 = 1 THEN '[0]' END AS sel FROM u WHERE o % 3 = 0
    UNION ALL SELECT id + 2, b + 3 + o % 2, 'out', CASE WHEN o % 5 = 1 THEN '[1]' END FROM u WHERE o % 3 = 0
    UNION ALL SELECT id, b + 3 + o % 3, 'in', CASE WHEN o % 4 = 2 THEN '[0]' END FROM u WHERE o % 3 > 0
    UNION ALL SELECT id, b + 1, 'in', NULL FROM u WHERE o % 3 = 1 AND o % 2 = 0
    UNION ALL SELECT id, b + 7, 'in', NULL FROM u WHERE o % 9 = 1
    UNION ALL SELECT id, CASE WHEN o % 5 = 2 THEN b + 2 ELSE b + 4 + o % 2 END, 'out', NULL FROM u WHERE o % 3 > 0
    UNION ALL SELECT id + 4, b + 7, 'out', NULL FROM u WHERE o % 6 = 0
    UNION ALL SELECT id + 3, b + 6, 'inout', NULL FROM u WHERE o % 6 = 0
    UNION ALL SELECT id + 5, id + 1, 'in', NULL FROM u WHERE o % 3 = 0
    UNION ALL SELECT id + 5, CASE WHEN o % 6 = 0 THEN b + 7 ELSE id + 2 END, 'out', NULL FROM u WHERE o % 3 = 0
    UNION ALL SELECT b, net, 'in', NULL FROM w UNION ALL SELECT b + 2, net, 'out', CASE WHEN b % 32 = 8 THEN '[0]' END FROM w) e
"""

#: The same design with gates in its assignments: a chain of expressions that read nets and literals, with an inverter in it.
GATED = """
  WITH g AS (SELECT DISTINCT l_orderkey AS o, l_linenumber AS l FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_orderkey % 3 = 2)
  SELECT id, kind, name, path, parent, dir, modport, const FROM chip
  UNION ALL SELECT 8000000000000 + o * 64 + l * 8, CASE l % 4 WHEN 0 THEN 'Not' WHEN 1 THEN 'And' WHEN 2 THEN 'Mux' ELSE 'Cmp' END, concat('$g', l), concat(chip.path, '.$g', l), chip.id, NULL, NULL, NULL FROM g JOIN chip ON chip.id = 6000000000000 + o * 8
  UNION ALL SELECT 8000000000000 + o * 64 + l * 8 + 1, 'Const', '', concat(chip.path, '.$k', l), chip.id, NULL, NULL, concat(l, '') FROM g JOIN chip ON chip.id = 6000000000000 + o * 8 WHERE l % 3 = 0
"""

GATED_EDGES = """
  WITH g AS (SELECT DISTINCT l_orderkey AS o, l_linenumber AS l, 2000000000000 + o_custkey * 8 AS b FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_orderkey % 3 = 2),
  t AS (SELECT o, b, max(l) AS l FROM g GROUP BY 1, 2)
  SELECT edge, port, endpoint, dir, sel FROM chip_edges
  UNION ALL SELECT concat(port, '>', endpoint, dir, coalesce(sel, '')), port, endpoint, dir, sel FROM (
    SELECT 8000000000000 + g.o * 64 + g.l * 8 AS port, 8000000000000 + h.o * 64 + h.l * 8 AS endpoint, 'in' AS dir, CAST(NULL AS STRING) AS sel FROM g JOIN g h ON h.o = g.o AND h.l = g.l - 1
    UNION ALL SELECT 8000000000000 + o * 64 + l * 8, b + 3 + l % 3, 'in', CASE WHEN o % 2 = 0 THEN '[1]' END FROM g WHERE l % 4 > 0
    UNION ALL SELECT 8000000000000 + o * 64 + l * 8, 8000000000000 + o * 64 + l * 8 + 1, 'in', NULL FROM g WHERE l % 3 = 0
    UNION ALL SELECT 8000000000000 + o * 64 + l * 8, CASE WHEN o % 5 = 2 THEN b + 2 ELSE b + 4 + o % 2 END, 'out', NULL FROM t) e
"""

#: Interfaces with two or three views that share members, a clock of their own, and signals that some block ties.
BUSES = """
  WITH s AS (SELECT s_suppkey AS s, 1000000000000 + s_suppkey * 16 AS b, concat('top.i', s_suppkey) AS path FROM supplier),
  k AS (SELECT * FROM (VALUES (1, 'Port', 'clk', 'in'), (2, 'Net', 'valid', NULL), (3, 'Net', 'ready', NULL), (4, 'Var', 'data', NULL), (5, 'Modport', 'core', NULL), (6, 'Modport', 'mem', NULL), (7, 'Modport', 'mon', NULL)) AS v(i, kind, name, dir))
  SELECT CAST(0 AS BIGINT) AS id, 'Instance' AS kind, 'top' AS name, 'top' AS path, CAST(NULL AS BIGINT) AS parent, CAST(NULL AS STRING) AS dir, CAST(NULL AS STRING) AS modport, CAST(NULL AS STRING) AS const
  UNION ALL SELECT b, 'Interface', concat('i', s), path, CAST(0 AS BIGINT), NULL, NULL, NULL FROM s
  UNION ALL SELECT b + i, kind, name, concat(path, '.', name), b, dir, NULL, NULL FROM s CROSS JOIN k WHERE i < 7 OR s % 3 = 0
  UNION ALL SELECT b + 8, 'Assign', 'a', concat(path, '.$a'), CAST(0 AS BIGINT), NULL, NULL, CASE WHEN s % 2 = 0 THEN concat(s, '') END FROM s
"""

BUS_EDGES = """
  SELECT concat(port, '>', endpoint, dir) AS edge, port, endpoint, dir, CAST(NULL AS STRING) AS sel FROM (
    SELECT 1000000000000 + s_suppkey * 16 + 8 AS port, 1000000000000 + s_suppkey * 16 + 3 AS endpoint, 'out' AS dir FROM supplier WHERE s_suppkey % 5 > 0) e
"""

BUS_MEMBERS = """
  SELECT b + i AS modport_id, pos, member, CASE WHEN i = 7 THEN 'in' ELSE dir END AS dir FROM (SELECT 1000000000000 + s_suppkey * 16 AS b, s_suppkey AS s FROM supplier) s
  CROSS JOIN (SELECT * FROM (VALUES (5, 0, 'clk', 'in'), (5, 1, 'valid', 'out'), (5, 2, 'ready', 'in'), (5, 3, 'data', 'inout'), (5, 4, 'lost', 'out'), (6, 0, 'clk', 'in'), (6, 1, 'data', 'inout'), (6, 2, 'valid', 'in'), (6, 3, 'ready', 'out'),
    (7, 0, 'valid', 'in'), (7, 1, 'ready', 'in'), (7, 2, 'data', 'in')) AS v(i, pos, member, dir)) m WHERE (i < 7 OR s % 3 = 0) AND (i + pos <> 8 OR s % 7 > 0)
"""

VIEWS = {"chip": CHIP, "chip_edges": CHIP_EDGES, "gated": GATED, "gated_edges": GATED_EDGES, "buses": BUSES, "bus_edges": BUS_EDGES, "bus_members": BUS_MEMBERS, "scopes": SCOPES, "gates": GATES, "gate_edges": GATE_EDGES, "nodes": NODES, "edges": EDGES, "changes": CHANGES, "vars": VARS, "enums": ENUMS}
_NEEDS = {"vars": ("nodes",), "gated": ("chip",), "gated_edges": ("chip_edges",), "gate_edges": ("gates",)}


class _Calls(dict):
    """``{us[x]}`` in a text becomes the dialect's call on x."""

    def __init__(self, pattern: str) -> None:
        self.pattern = pattern

    def __missing__(self, key: str) -> str:
        return self.pattern.format(key)


def text(sql: str, dialect: dict[str, str]) -> str:
    return sql.format(**{k: _Calls(v) for k, v in dialect.items()})


def register(spark: SparkSession, sf_dir: str, only: tuple[str, ...] | None = None) -> None:
    """Temp views of the tables and of the derived views; plans that used earlier ones keep what they resolved."""
    for name in TABLES:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)
    for name, sql in VIEWS.items():
        if only is None or name in only:
            spark.sql(text(sql, SPARK)).createOrReplaceTempView(name)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    register(spark, sf_dir)
    return spark.table(name)


def with_views(sql: str, dialect: dict[str, str] = DUCK) -> str:
    """DuckDB text: the views that ``sql`` names as common table expressions in front."""
    import re

    wanted: list[str] = []

    def want(name: str) -> None:
        for need in _NEEDS.get(name, ()):
            want(need)
        if name not in wanted:
            wanted.append(name)

    for name in VIEWS:
        if re.search(rf"\b{name}\b", sql):
            want(name)
    head = ", ".join(f"{n} AS MATERIALIZED ({text(VIEWS[n], dialect)})" for n in wanted)
    body = text(sql, dialect).strip()
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {head}, {body[14:]}" if head else body
    if body.upper().startswith("WITH "):
        return f"WITH {head}, {body[5:]}" if head else body
    return f"WITH {head} {body}" if head else body
