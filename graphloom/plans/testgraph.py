"""A property graph derived from the relational tables, as SQL that Spark and DuckDB both run.

Parts are files, suppliers external modules, customers functions, regions and
nations classes, suppliers methods too. Orders give calls, references and
commits, their lines imports.

There are two sets of edges. ``ALL_EDGES`` has every import, module and call:
a part imports each part that ever follows it in an order, and a customer calls
each that orders next; ``FILE_IMPORTS`` is those between files. ``EDGES`` has the main ones: what a part is followed by
most, and a customer likewise, from smaller sizes (of parts) and nations (of
customers) to larger ones, and both ways where each follows the other. So there
some files are tested and some are not, and there are many components of few
members beside a large one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from graphloom.functions.keep import dealt_by, once

PART = """
SELECT p_partkey AS k, p_name AS name,
  CASE WHEN p_size <= 5 THEN 'tests/p' || CAST(p_partkey AS STRING) || '.py'
       WHEN p_size = 50 THEN 'src/index.p' || CAST(p_partkey AS STRING) || '.py'
       ELSE 'src/p' || CAST(p_partkey AS STRING) || '.py' END AS path, p_size AS layer,
  lower(split_part(p_type, ' ', 1)) AS language
FROM {part}"""

FUNCTION = """
SELECT c_custkey AS k, c_name AS name, p.path, p.language, c_custkey % 3 = 0 AS exported,
  CAST(c_custkey % 100 + 1 AS INT) AS start_line, CAST(c_custkey % 100 + 1 + c_nationkey AS INT) AS end_line,
  'fn:' || p.path || '#' || c_name AS id
FROM (SELECT c.*, c_custkey % n AS part_k FROM {customer} c CROSS JOIN (SELECT count(*) AS n FROM {part}) t) JOIN ({PART}) p ON p.k = part_k"""

NODES = """
SELECT 'f:' || path AS id, 'file' AS type, path AS name, path, CAST(NULL AS INT) AS start_line, CAST(NULL AS INT) AS end_line, false AS external, false AS exported, language FROM ({PART})
UNION ALL SELECT 'f:src/geo.py', 'file', 'src/geo.py', 'src/geo.py', NULL, NULL, false, false, 'python'
UNION ALL SELECT 'xm:' || s_name, 'module', s_name, NULL, NULL, NULL, true, false, NULL FROM {supplier}
UNION ALL SELECT id, 'function', name, path, start_line, end_line, false, exported, language FROM ({FUNCTION})
UNION ALL SELECT 'cls:src/geo.py#' || r_name, 'class', r_name, 'src/geo.py', r_regionkey + 1, r_regionkey + 10, false, r_regionkey = 0, 'python' FROM {region}
UNION ALL SELECT 'cls:src/geo.py#' || n_name, 'class', n_name, 'src/geo.py', n_nationkey + 20, n_nationkey + 40, false, n_nationkey % 5 = 0, 'python' FROM {nation}
UNION ALL SELECT 'm:src/geo.py#' || n_name || '.' || s_name, 'method', s_name, 'src/geo.py', CAST(s_suppkey + 100 AS INT), CAST(s_suppkey + 110 AS INT), false, false, 'python' FROM {supplier} JOIN {nation} ON n_nationkey = s_nationkey"""

# the next line of the same order; its order has no ties
LINES = """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_linestatus,
  lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS next_part
FROM {lineitem}"""

# a call goes from an order's customer to the next order's
CALLS = """
SELECT DISTINCT a.o_custkey AS caller, b.o_custkey AS callee, a.o_orderstatus = 'P' AS ambiguous, CAST(a.o_orderkey % 500 + 1 AS INT) AS line
FROM {orders} a JOIN {orders} b ON b.o_orderkey = a.o_orderkey + 1"""

PAIRS = """
SELECT l_partkey AS a, next_part AS b, l_linestatus AS status, count(*) AS n, CAST(min(l_linenumber) AS INT) AS line
FROM ({LINES}) WHERE next_part <> l_partkey GROUP BY l_partkey, next_part, l_linestatus"""

IMPORTS = """
SELECT src, dst, min(line) AS line FROM (
  SELECT src, dst, line FROM (SELECT src, dst, line, row_number() OVER (PARTITION BY src, kind ORDER BY n DESC, dst) AS place FROM (
    SELECT CASE WHEN x.layer <= y.layer THEN a ELSE b END AS src, CASE WHEN x.layer <= y.layer THEN b ELSE a END AS dst, CASE WHEN x.layer = y.layer THEN 'same' ELSE status END AS kind, sum(n) AS n, min(line) AS line
    FROM ({PAIRS}) p JOIN ({PART}) x ON x.k = a JOIN ({PART}) y ON y.k = b GROUP BY 1, 2, 3) g) r WHERE place = 1
  UNION ALL SELECT p.a, p.b, p.line FROM ({PAIRS}) p JOIN ({PAIRS}) q ON p.a = q.b AND p.b = q.a) e GROUP BY src, dst"""

CALLED = """
SELECT caller, callee, ambiguous, min(line) AS line FROM (
  SELECT caller, callee, ambiguous, line FROM (SELECT caller, callee, ambiguous, line, row_number() OVER (PARTITION BY caller, ambiguous, same ORDER BY n DESC, callee) AS place FROM (
    SELECT CASE WHEN ambiguous OR x.c_nationkey <= y.c_nationkey THEN caller ELSE callee END AS caller, CASE WHEN ambiguous OR x.c_nationkey <= y.c_nationkey THEN callee ELSE caller END AS callee,
      ambiguous, ambiguous OR x.c_nationkey = y.c_nationkey AS same, count(*) AS n, min(line) AS line
    FROM ({CALLS}) c JOIN {customer} x ON x.c_custkey = caller JOIN {customer} y ON y.c_custkey = callee WHERE caller <> callee GROUP BY 1, 2, 3, 4) g) r WHERE place = 1
  UNION ALL SELECT c.caller, c.callee, false, c.line FROM ({CALLS}) c JOIN ({CALLS}) b ON c.caller = b.callee AND c.callee = b.caller WHERE NOT c.ambiguous AND NOT b.ambiguous) e
GROUP BY caller, callee, ambiguous"""

_OTHER_EDGES = """UNION ALL SELECT 'f:' || path, id, 'defines', start_line, NULL, 'resolved' FROM ({FUNCTION})
UNION ALL SELECT 'f:src/geo.py', 'cls:src/geo.py#' || n_name, 'defines', n_nationkey + 20, NULL, 'resolved' FROM {nation}
UNION ALL SELECT 'f:src/geo.py', 'cls:src/geo.py#' || r_name, 'defines', r_regionkey + 1, NULL, 'resolved' FROM {region}
UNION ALL SELECT 'cls:src/geo.py#' || n_name, 'm:src/geo.py#' || n_name || '.' || s_name, 'defines', CAST(s_suppkey + 100 AS INT), NULL, 'resolved' FROM {supplier} JOIN {nation} ON n_nationkey = s_nationkey
UNION ALL SELECT 'cls:src/geo.py#' || n_name, 'cls:src/geo.py#' || r_name, 'inherits', n_nationkey + 20, NULL, 'resolved' FROM {nation} JOIN {region} ON r_regionkey = n_regionkey
UNION ALL SELECT DISTINCT 'f:' || f.path, g.id, 'references', CAST(o_custkey % 90 + 1 AS INT), NULL, 'resolved'
FROM {orders} JOIN ({FUNCTION}) f ON f.k = o_custkey JOIN ({FUNCTION}) g ON g.k = o_custkey WHERE g.exported = false"""

EDGES = """
SELECT 'f:' || a.path AS src, 'f:' || b.path AS dst, 'imports' AS type, i.line, CAST(NULL AS STRING) AS callee_text, 'resolved' AS confidence
FROM ({IMPORTS}) i JOIN ({PART}) a ON a.k = i.src JOIN ({PART}) b ON b.k = i.dst
UNION ALL SELECT 'f:' || a.path, 'xm:' || s_name, 'imports', CAST(1 AS INT), NULL, 'resolved'
FROM (SELECT l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_partkey ORDER BY count(*) DESC, l_suppkey) AS place FROM {lineitem} GROUP BY l_partkey, l_suppkey) u JOIN ({PART}) a ON a.k = l_partkey JOIN {supplier} ON s_suppkey = l_suppkey WHERE place = 1
UNION ALL SELECT f.id, CASE WHEN ambiguous THEN NULL ELSE g.id END, 'calls', c.line, CASE WHEN ambiguous THEN 'obj.' || g.name END, CASE WHEN ambiguous THEN 'ambiguous' ELSE 'resolved' END
FROM ({CALLED}) c JOIN ({FUNCTION}) f ON f.k = caller JOIN ({FUNCTION}) g ON g.k = callee
""" + _OTHER_EDGES

FILE_IMPORTS = """
SELECT 'f:' || a.path AS src, 'f:' || b.path AS dst, 'imports' AS type, min(CAST(l_linenumber AS INT)) AS line, CAST(NULL AS STRING) AS callee_text, 'resolved' AS confidence
FROM ({LINES}) JOIN ({PART}) a ON a.k = l_partkey JOIN ({PART}) b ON b.k = next_part GROUP BY a.path, b.path"""

ALL_EDGES = """{FILE_IMPORTS}
UNION ALL SELECT DISTINCT 'f:' || a.path, 'xm:' || s_name, 'imports', CAST(1 AS INT), NULL, 'resolved'
FROM ({LINES}) JOIN ({PART}) a ON a.k = l_partkey JOIN {supplier} ON s_suppkey = l_suppkey
UNION ALL SELECT f.id, CASE WHEN ambiguous THEN NULL ELSE g.id END, 'calls', c.line, CASE WHEN ambiguous THEN 'obj.' || g.name END, CASE WHEN ambiguous THEN 'ambiguous' ELSE 'resolved' END
FROM ({CALLS}) c JOIN ({FUNCTION}) f ON f.k = caller JOIN ({FUNCTION}) g ON g.k = callee
""" + _OTHER_EDGES

COMMITS = """
SELECT DISTINCT o_orderkey AS seq, o_orderdate AS ts, p.path
FROM {lineitem} JOIN {orders} ON o_orderkey = l_orderkey JOIN ({PART}) p ON p.k = l_partkey"""

COMPLEXITY = """
SELECT p.path, 'fn' || CAST(l_linenumber AS STRING) AS name, CAST(l_linenumber * 10 AS INT) AS start_line, CAST(max(l_quantity) AS INT) AS complexity
FROM {lineitem} JOIN ({PART}) p ON p.k = l_partkey GROUP BY p.path, l_linenumber"""

BASE = ("part", "customer", "supplier", "orders", "lineitem", "nation", "region", "events")
VIEWS = {"PART": PART, "FUNCTION": FUNCTION, "LINES": LINES, "CALLS": CALLS, "PAIRS": PAIRS, "IMPORTS": IMPORTS, "CALLED": CALLED, "NODES": NODES, "EDGES": EDGES, "FILE_IMPORTS": FILE_IMPORTS, "ALL_EDGES": ALL_EDGES, "COMMITS": COMMITS, "COMPLEXITY": COMPLEXITY}


SHARED = {"EDGES": ("PAIRS", "CALLS"), "ALL_EDGES": ("FILE_IMPORTS",)}  # views that another uses several times, which are written too


def expand(text: str, base: dict[str, str], given: dict[str, str] | None = None) -> str:
    """``text`` with the views, or what is ``given`` for them, put in place of their names, and ``base`` for the tables'."""
    for name in ("ALL_EDGES", "FILE_IMPORTS", "EDGES", "NODES", "COMMITS", "COMPLEXITY", "IMPORTS", "CALLED", "PAIRS", "CALLS", "LINES", "FUNCTION", "PART"):
        text = text.replace(f"{{{name}}}", (given or {}).get(name, VIEWS[name]))
    for name, what in base.items():
        text = text.replace(f"{{{name}}}", what)
    return text


def _frame(spark: SparkSession, sf_dir: str, view: str) -> DataFrame:
    """The view, made and written once an application: nearly every query reads it."""

    def make() -> DataFrame:
        given = {}
        for name in SHARED.get(view, ()):
            named = f"graphloom_{name.lower()}_{uuid.uuid4().hex}"
            _frame(spark, sf_dir, name).createOrReplaceTempView(named)
            given[name] = f"SELECT * FROM {named}"
        return spark.sql(expand(VIEWS[view], {t: f"parquet.`{sf_dir}/{t}.parquet`" for t in BASE}, given))

    with dealt_by(spark, spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()):
        return once(spark, (sf_dir, view), make)


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _frame(spark, sf_dir, "NODES")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _frame(spark, sf_dir, "EDGES")


def all_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _frame(spark, sf_dir, "ALL_EDGES")


def file_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The imports between files of ``all_edges``, for what asks of files only: no import leads on from a module."""
    return _frame(spark, sf_dir, "FILE_IMPORTS")


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _frame(spark, sf_dir, "COMMITS")


def complexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _frame(spark, sf_dir, "COMPLEXITY")


def oracle(sql: str, whole: bool = False) -> str:
    """DuckDB SQL over nodes, edges (the main ones, or with ``whole`` all), commits and complexity."""
    plain = {t: t for t in BASE}
    views = VIEWS | {"EDGES": ALL_EDGES} if whole else VIEWS
    views = ", ".join(f"{name} AS ({expand(views[name.upper()], plain)})" for name in ("nodes", "edges", "commits", "complexity") if name in sql)
    sql = sql.strip()
    if not views:
        return sql
    if sql.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {views}, {sql[14:]}"
    if sql.upper().startswith("WITH"):
        return f"WITH {views}, {sql[4:]}"
    return f"WITH {views} {sql}"
