"""Every query of the engine by name, with the SQL that states the same result.

The queries run the operators over the test graph; ``QUERIES`` and
``ORACLE_SQL`` have the same keys but where SQL can't state the result.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.functions import paths
from graphloom.functions import questions as Q
from graphloom.functions.keep import dealt_by, keep, once
from graphloom.functions.ship import ship
from graphloom.operators import analysis as A
from graphloom.operators import coverage as V
from graphloom.operators import cycles as C
from graphloom.operators import guard as U
from graphloom.operators import reach as R
from graphloom.operators import resolve
from graphloom.operators import symbols as S
from graphloom.plans import testgraph as G
from graphloom.schema import broken, guarded
from graphloom.sources import facts

QUERIES: dict = {}
ORACLE_SQL: dict = {}


WHOLE = set("""graph_edges edge_counts_by_type edge_counts_by_confidence ambiguous_hotspots dependent_counts blast_radius blast_radius_confirmed blast_radius_ambiguous
blast_radius_summary call_cycles_scc import_cycles_scc test_coverage_pairs test_coverage_summary uncovered_files risk_scores risk_with_complexity riskiest_files_top5
untested_churning_files derived_grants""".split())  # over every edge; the others are over the main edges


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = G.oracle(sql, name in WHOLE)
        return f

    return put


def _table(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


BUSIEST = "SELECT dst AS root FROM edges WHERE type = 'calls' AND dst IS NOT NULL GROUP BY dst ORDER BY count(*) DESC, dst LIMIT 3"
TEST = "path LIKE 'tests/%'"
AS_OF = "(SELECT max(ts) FROM commits)"


def busiest(edges):
    """The three functions that are called most."""
    into = edges.filter("type = 'calls' and dst is not null").groupBy("dst").agg(F.count("*").alias("n"))
    return into.orderBy(F.col("n").desc(), "dst").limit(3).select(F.col("dst").alias("root"))


query("graph_nodes", "SELECT * FROM nodes")(lambda s, d: G.nodes(s, d))
query("graph_edges", "SELECT * FROM edges")(lambda s, d: guarded(G.all_edges(s, d)))
query("node_counts_by_type", "SELECT type, count(*) AS n FROM nodes GROUP BY type")(lambda s, d: G.nodes(s, d).groupBy("type").agg(F.count("*").alias("n")))
query("edge_counts_by_type", "SELECT type, count(*) AS n FROM edges GROUP BY type")(lambda s, d: G.all_edges(s, d).groupBy("type").agg(F.count("*").alias("n")))
query("edge_counts_by_confidence", "SELECT confidence, count(*) AS n FROM edges GROUP BY confidence")(lambda s, d: G.all_edges(s, d).groupBy("confidence").agg(F.count("*").alias("n")))
query("edge_guard_violations", "SELECT count(*) AS violations FROM edges WHERE (confidence = 'resolved') <> (dst IS NOT NULL)")(lambda s, d: broken(G.edges(s, d)).agg(F.count("*").alias("violations")))
query("files_by_language", "SELECT language, count(*) AS n FROM nodes WHERE type = 'file' GROUP BY language")(lambda s, d: G.nodes(s, d).filter("type = 'file'").groupBy("language").agg(F.count("*").alias("n")))
query("external_modules", "SELECT name FROM nodes WHERE type = 'module' AND external ORDER BY name")(lambda s, d: G.nodes(s, d).filter("type = 'module' and external").select("name").orderBy("name"))
query("ambiguous_hotspots", "SELECT callee_text, count(*) AS n FROM edges WHERE confidence = 'ambiguous' AND callee_text IS NOT NULL GROUP BY 1 ORDER BY n DESC, callee_text LIMIT 6")(lambda s, d: A.ambiguous_hotspots(G.all_edges(s, d)))
query("most_imported_files", "SELECT substr(dst, 3) AS path, count(*) AS n FROM edges WHERE type = 'imports' AND dst LIKE 'f:%' GROUP BY dst ORDER BY n DESC, dst LIMIT 5")(lambda s, d: A.most_imported(G.edges(s, d)))
query("dependent_counts", "SELECT dst AS id, count(*) AS dependents FROM edges WHERE type IN ('calls', 'imports', 'inherits') AND confidence = 'resolved' GROUP BY dst")(lambda s, d: A.dependent_counts(G.all_edges(s, d)))
query("inbound_reference_count", "SELECT id, (SELECT count(*) FROM edges WHERE dst = id AND type IN ('calls', 'imports', 'inherits', 'references') AND confidence = 'resolved') AS n FROM nodes")(
    lambda s, d: A.inbound_counts(G.nodes(s, d), G.edges(s, d))
)

_WALK = """WITH RECURSIVE roots AS ({roots}),
dep AS (SELECT DISTINCT dst, src FROM edges WHERE type IN ('calls', 'imports', 'inherits') AND confidence = 'resolved'),
walk AS (SELECT root, src AS node, 1 AS depth FROM roots JOIN dep ON dst = root
  UNION SELECT root, src, depth + 1 FROM walk JOIN dep ON dst = node WHERE depth < 60),
sure AS (SELECT root, node, CAST(min(depth) AS INT) AS depth FROM walk GROUP BY root, node),
loose AS (SELECT DISTINCT root, src AS node FROM edges JOIN nodes n ON split_part(callee_text, '.', -1) = n.name JOIN roots ON n.id = root
  WHERE confidence = 'ambiguous'),
every AS (SELECT root, node, depth, 'resolved' AS via FROM sure
  UNION ALL SELECT root, node, CAST(1 AS INT), 'ambiguous' FROM loose WHERE NOT EXISTS (SELECT 1 FROM sure WHERE sure.root = loose.root AND sure.node = loose.node))
"""
_ALL = _WALK.format(roots="SELECT id AS root FROM nodes WHERE type = 'function'")
# each node once, when it is first come to, so that no depth ends the walk
_WALK = _WALK.format(roots=BUSIEST).replace("""walk AS (SELECT root, src AS node, 1 AS depth FROM roots JOIN dep ON dst = root
  UNION SELECT root, src, depth + 1 FROM walk JOIN dep ON dst = node WHERE depth < 60)""", """walk (root, node, depth) USING KEY (root, node) AS (SELECT DISTINCT root, src, 1 FROM roots JOIN dep ON dst = root
  UNION SELECT DISTINCT w.root, d.src, w.depth + 1 FROM walk w JOIN dep d ON d.dst = w.node WHERE NOT EXISTS (SELECT 1 FROM recurring.walk o WHERE o.root = w.root AND o.node = d.src))""")


def _blast(s, d):
    edges = G.all_edges(s, d)
    return R.blast_radius(G.nodes(s, d), edges, busiest(edges))


query("blast_radius", _WALK + "SELECT * FROM every")(lambda s, d: _blast(s, d).select("root", "node", "depth", "via"))
query("blast_radius_confirmed", _WALK + "SELECT root, node, depth FROM sure")(lambda s, d: (lambda e: R.confirmed(e, busiest(e)).select("root", "node", "depth"))(G.all_edges(s, d)))
query("blast_radius_ambiguous", _WALK + "SELECT root, node FROM every WHERE via = 'ambiguous'")(lambda s, d: _blast(s, d).filter("via = 'ambiguous'").select("root", "node"))
query("blast_radius_all", _ALL + "SELECT * FROM every")(lambda s, d: R.blast_radius(G.nodes(s, d), G.edges(s, d), G.nodes(s, d).filter("type = 'function'").select(F.col("id").alias("root"))).select("root", "node", "depth", "via"))
query("blast_radius_summary", _WALK + "SELECT root, depth, via, count(*) AS n FROM every GROUP BY root, depth, via")(lambda s, d: _blast(s, d).groupBy("root", "depth", "via").agg(F.count("*").alias("n")))

_DEAD = f"""WITH used AS (SELECT DISTINCT dst FROM edges WHERE type IN ('calls', 'inherits') AND confidence = 'resolved'),
loose AS (SELECT DISTINCT split_part(callee_text, '.', -1) AS name FROM edges WHERE confidence = 'ambiguous'),
ref AS (SELECT DISTINCT dst FROM edges WHERE type = 'references' AND confidence = 'resolved'),
dead AS (SELECT id, type, name, path, CASE WHEN name IN (SELECT name FROM loose) THEN 'no-resolved-references'
    WHEN id IN (SELECT dst FROM ref) THEN 'referenced-but-uncalled' ELSE 'confirmed-unreferenced' END AS tier
  FROM nodes WHERE NOT external AND NOT exported AND type IN ('function', 'class') AND NOT {TEST} AND path NOT LIKE 'src/index.%'
    AND id NOT IN (SELECT dst FROM used))
"""
query("dead_code", _DEAD + "SELECT * FROM dead")(lambda s, d: A.dead_code(G.nodes(s, d), G.edges(s, d)))
query("dead_code_by_tier", _DEAD + "SELECT tier, count(*) AS n FROM dead GROUP BY tier")(lambda s, d: A.dead_code(G.nodes(s, d), G.edges(s, d)).groupBy("tier").agg(F.count("*").alias("n")))
query("dead_methods", _DEAD + """SELECT m.id, m.name, m.path, e.src AS owner, CASE WHEN m.name IN (SELECT name FROM loose) THEN 'no-resolved-references' ELSE 'confirmed-unreferenced' END AS tier
  FROM nodes m JOIN edges e ON e.dst = m.id AND e.type = 'defines' JOIN dead ON dead.id = e.src AND dead.type = 'class' AND dead.tier = 'confirmed-unreferenced'
  WHERE m.type = 'method' AND m.id NOT IN (SELECT dst FROM used)""")(lambda s, d: A.dead_methods(G.nodes(s, d), G.edges(s, d), A.dead_code(G.nodes(s, d), G.edges(s, d))))  # fmt: skip

query("dead_code_verdicts", _DEAD + """, gone AS (SELECT id, tier FROM dead UNION ALL SELECT m.id, CASE WHEN m.name IN (SELECT name FROM loose) THEN 'no-resolved-references' ELSE 'confirmed-unreferenced' END
  FROM nodes m JOIN edges e ON e.dst = m.id AND e.type = 'defines' JOIN dead ON dead.id = e.src AND dead.type = 'class' AND dead.tier = 'confirmed-unreferenced' WHERE m.type = 'method' AND m.id NOT IN (SELECT dst FROM used)),
calls_in AS (SELECT dst, count(*) AS k FROM edges WHERE type IN ('calls', 'inherits') AND confidence = 'resolved' GROUP BY dst)
SELECT n.id, CASE WHEN n.type NOT IN ('function', 'class', 'method') THEN 'not-a-candidate' WHEN g.id IS NOT NULL THEN 'dead-candidate' ELSE 'referenced' END AS verdict, g.tier, coalesce(k, 0) AS inbound
FROM nodes n LEFT JOIN gone g ON g.id = n.id LEFT JOIN calls_in c ON c.dst = n.id WHERE NOT n.external""")(lambda s, d: _verdicts(s, d))  # fmt: skip


def _verdicts(s, d):
    dead = A.dead_code(G.nodes(s, d), G.edges(s, d))
    methods = A.dead_methods(G.nodes(s, d), G.edges(s, d), dead)
    return A.verdicts(G.nodes(s, d), G.edges(s, d), dead.select("id", "tier").unionByName(methods.select("id", "tier")))


def _scc(kind: str, where: str) -> str:
    return f"""WITH RECURSIVE e AS (SELECT DISTINCT src, dst FROM edges WHERE type = '{kind}' AND confidence = 'resolved' AND {where} AND src <> dst),
r AS (SELECT src AS a, dst AS b FROM e UNION SELECT a, dst FROM r JOIN e ON b = src)
SELECT min(q.b) AS component, p.a AS id FROM r p JOIN r q ON q.a = p.b AND q.b = p.a WHERE p.a <> p.b GROUP BY p.a"""


# the smallest member: of those that each reaches and is reached by, itself included
def _scc_named(kind: str, where: str) -> str:
    return f"""WITH RECURSIVE e AS (SELECT DISTINCT src, dst FROM edges WHERE type = '{kind}' AND confidence = 'resolved' AND {where} AND src <> dst),
r AS (SELECT src AS a, dst AS b FROM e UNION SELECT a, dst FROM r JOIN e ON b = src),
m AS (SELECT p.a, p.b FROM r p JOIN r q ON q.a = p.b AND q.b = p.a WHERE p.a <> p.b)
SELECT least(a, min(b)) AS component, a AS id FROM m GROUP BY a"""


def _components(s, d, kind, graph=G.all_edges):
    return once(s, (d, "components", kind, graph.__name__), lambda: C.components(C.cycle_edges(graph(s, d), kind)))


query("call_cycles_scc", _scc_named("calls", "dst NOT LIKE 'x%'"))(lambda s, d: _components(s, d, "calls"))
query("import_cycles_scc", _scc_named("imports", "dst LIKE 'f:%'"))(lambda s, d: _components(s, d, "imports", G.file_imports))


def _ranked(s, d, kind):
    ship(s)
    found = C.representative_cycles(C.cycle_edges(G.edges(s, d), kind), _components(s, d, kind, G.edges))
    return found.withColumn("path", F.array_join("path", " > "))


# every simple path from the smallest member, in order; the first that closes is the walk's
_FIRST = _scc_named("calls", "dst NOT LIKE 'x%'").replace("SELECT least(a, min(b)) AS component, a AS id FROM m GROUP BY a", """, c AS (SELECT least(a, min(b)) AS component, a AS id FROM m GROUP BY a),
inside AS (SELECT x.component, e.src, e.dst FROM e JOIN c x ON x.id = e.src JOIN c y ON y.id = e.dst AND y.component = x.component),
p AS (SELECT component, [component] AS path, component AS at, 0 AS closed FROM (SELECT DISTINCT component FROM c) s
  UNION ALL SELECT p.component, CASE WHEN i.dst = p.component THEN path ELSE list_append(path, i.dst) END, i.dst, CASE WHEN i.dst = p.component THEN 1 ELSE 0 END
  FROM p JOIN inside i ON i.component = p.component AND i.src = p.at WHERE closed = 0 AND (i.dst = p.component OR NOT list_contains(path, i.dst)))
SELECT component, (SELECT count(*) FROM c WHERE c.component = p.component) AS size, len(min(path)) AS length, array_to_string(min(path), ' > ') AS path FROM p WHERE closed = 1 GROUP BY component""")
query("representative_cycles", _FIRST)(lambda s, d: _ranked(s, d, "calls"))
query("representative_import_cycles")(lambda s, d: _ranked(s, d, "imports"))


_COVER = f"""WITH RECURSIVE imp AS (SELECT DISTINCT src, dst FROM edges WHERE type = 'imports' AND confidence = 'resolved'),
tests AS (SELECT id FROM nodes WHERE type = 'file' AND {TEST}),
r AS (SELECT id AS test, dst AS node FROM tests JOIN imp ON src = id UNION SELECT test, dst FROM r JOIN imp ON src = node),
pairs AS (SELECT substr(r.test, 3) AS test, path FROM r JOIN nodes ON id = node WHERE type = 'file' AND NOT {TEST})
"""


def _pairs(s, d):
    return V.coverage_pairs(G.nodes(s, d), G.file_imports(s, d), paths.is_test, _components(s, d, "imports", G.file_imports))


def _covered(s, d, graph=G.file_imports):
    return V.covered_files(G.nodes(s, d), graph(s, d), paths.is_test)


query("test_coverage_pairs", _COVER + "SELECT * FROM pairs")(_pairs)
query("test_coverage_summary", _COVER + f"""SELECT test_files, source_files, covered_files, round(covered_files / source_files, 4) AS ratio FROM (
  SELECT count(*) FILTER ({TEST}) AS test_files, count(*) FILTER (NOT {TEST}) AS source_files, (SELECT count(DISTINCT path) FROM pairs) AS covered_files FROM nodes WHERE type = 'file')""")(lambda s, d: A.coverage_summary(G.nodes(s, d), _covered(s, d)))  # fmt: skip
query("uncovered_files", _COVER + f"SELECT path FROM nodes WHERE type = 'file' AND NOT {TEST} AND path NOT IN (SELECT path FROM pairs)")(lambda s, d: A.uncovered(G.nodes(s, d), _covered(s, d)))


def _history(s, d):
    commits = G.commits(s, d).withColumn("date_iso", F.date_format("ts", "yyyy-MM-dd"))
    as_of = commits.agg(F.max("ts")).first()[0]
    return A.churn(commits, F.lit(as_of))


def _facts(s, d):
    return G.complexity(s, d)


_CHURN = f"""SELECT path, count(*) AS commits_total, count(*) FILTER (ts >= {AS_OF} - INTERVAL 90 DAY) AS commits_in_window,
  strftime(max(ts), '%Y-%m-%d') AS last_modified FROM commits GROUP BY path"""
query("file_churn", _CHURN)(_history)


def _risk_sql(measured: str) -> str:
    return _COVER + f""", h AS ({_CHURN}), t AS (SELECT path, list_sort(list(DISTINCT test)) AS tests FROM pairs GROUP BY path), m AS ({measured}),
scores AS (SELECT n.path, CAST(round(least(coalesce(commits_in_window, 0), 10) / 10 * 70) + CASE WHEN t.path IS NULL THEN 30 ELSE 0 END
    + round(least(coalesce(c, 0), 15) / 15 * 30) AS BIGINT) AS score, coalesce(commits_in_window, 0) AS commits_in_window, h.path IS NULL AS untracked, t.path IS NOT NULL AS tested,
    coalesce(array_to_string(tests, ','), '') AS tests, CAST(coalesce(c, 0) AS INT) AS max_complexity
  FROM nodes n LEFT JOIN h ON h.path = n.path LEFT JOIN t ON t.path = n.path LEFT JOIN m ON m.path = n.path WHERE n.type = 'file' AND NOT n.{TEST})
"""


_PLAIN = "SELECT NULL::VARCHAR AS path, NULL::INT AS c"
_MEASURED = "SELECT path, max(complexity) AS c FROM complexity GROUP BY path"


def _risk(s, d, measured=False, named=True, graph=G.file_imports):
    """With ``named``, the tests of each file; else only whether there are any."""
    if named:
        pairs, sets = V.coverage_sets(G.nodes(s, d), graph(s, d), paths.is_test, _components(s, d, "imports", graph))
        sets = keep(sets.withColumn("tests", F.array_join("tests", ",")))  # a list is joined once, not for each of its files
    else:
        pairs, sets = _covered(s, d, graph).withColumn("test", F.lit(None).cast("string")), None
    scores = A.risk(G.nodes(s, d), _history(s, d), pairs, A.complexity_by_file(_facts(s, d)) if measured else None, sets)
    return scores if named else scores.withColumn("tests", F.array_join("tests", ","))


query("risk_scores", _risk_sql(_PLAIN) + "SELECT * FROM scores")(lambda s, d: _risk(s, d))
query("risk_with_complexity", _risk_sql(_MEASURED) + "SELECT * FROM scores")(lambda s, d: _risk(s, d, True))
query("riskiest_files_top5", _risk_sql(_MEASURED) + "SELECT path, score FROM scores ORDER BY score DESC, path LIMIT 5")(lambda s, d: A.riskiest(_risk(s, d, True, False), 5).select("path", "score"))
query("untested_churning_files", _risk_sql(_PLAIN) + "SELECT path, commits_in_window FROM scores WHERE NOT tested AND commits_in_window > 0")(lambda s, d: _risk(s, d, named=False).filter("not tested and commits_in_window > 0").select("path", "commits_in_window"))
query("complexity_file_max", "SELECT path, max(complexity) AS max_complexity, count(*) AS functions FROM complexity GROUP BY path")(lambda s, d: A.complexity_by_file(_facts(s, d)))
query("security_signals", _risk_sql(_PLAIN) + """SELECT (SELECT coalesce(sum(n), 0)::BIGINT FROM (SELECT count(*) AS n FROM edges WHERE confidence = 'ambiguous' AND callee_text IS NOT NULL GROUP BY callee_text ORDER BY n DESC LIMIT 6)) AS unresolved_top,
  (SELECT count(*) FROM edges WHERE confidence = 'ambiguous') AS unresolved, (SELECT count(*) FROM nodes WHERE external AND type = 'module') AS external_modules,
  (SELECT count(*) FROM scores WHERE NOT tested AND commits_in_window > 0) AS untested_changing""")(lambda s, d: A.signals(G.nodes(s, d), G.edges(s, d), _risk(s, d, named=False, graph=G.edges)))
query("complexity_totals", "SELECT count(DISTINCT path) AS files, count(*) AS functions, coalesce(max(complexity), 0)::INT AS max_complexity FROM complexity")(lambda s, d: A.complexity_totals(_facts(s, d)))
query("complexity_top_functions", "SELECT path, name, complexity FROM complexity ORDER BY complexity DESC, path, name LIMIT 10")(lambda s, d: _facts(s, d).orderBy(F.col("complexity").desc(), "path", "name").limit(10).select("path", "name", "complexity"))

query("find_symbol_exact", "SELECT id, type, name, path FROM nodes WHERE lower(name) = lower('CUSTOMER#000000007') OR lower(name) = 'europe' ORDER BY id LIMIT 20")(lambda s, d: S.find_exact(G.nodes(s, d), ["CUSTOMER#000000007", "europe"]))
query("find_symbol_substring", "SELECT id, type, name, path FROM nodes WHERE contains(lower(name), 'er#00000001') ORDER BY id LIMIT 20")(lambda s, d: S.find_symbol(G.nodes(s, d), "ER#00000001"))
# what is asked for: every file by its end, whole path and id, every function and class by name in other letters, external ids, and names that nothing has
_TARGETS = """SELECT DISTINCT target FROM (SELECT regexp_replace(path, '^.*/', '') AS target FROM nodes WHERE type = 'file' UNION ALL SELECT 'SRC/' || regexp_replace(path, '^.*/', '') FROM nodes WHERE type = 'file'
  UNION ALL SELECT regexp_replace(id, '^f:', '') FROM nodes WHERE type = 'file' UNION ALL SELECT id FROM nodes UNION ALL SELECT upper(name) FROM nodes WHERE type <> 'file' UNION ALL SELECT 'no' || name FROM nodes WHERE type = 'function'
  UNION ALL SELECT regexp_replace(regexp_replace(path, '^.*/', ''), '[.][^.]*$', '') FROM nodes WHERE type = 'file') t"""
_HITS = f"""WITH asked AS ({_TARGETS}), own AS (SELECT * FROM nodes WHERE NOT external),
kinds AS (SELECT target, CASE WHEN regexp_matches(target, '^(f|fn|cls|m|xm|xf|xc):') THEN 'id' WHEN regexp_matches(lower(target), '/|[.](js|jsx|mjs|cjs|ts|tsx|mts|cts|py)$') THEN 'path' ELSE 'name' END AS kind FROM asked),
ends AS (SELECT id, path, lower(regexp_replace(path, '^[^/]*/', '')) AS tail, regexp_replace(path, '^.*/', '') AS base FROM own WHERE type = 'file'),
hits AS (SELECT target, 1 AS rank, id FROM kinds JOIN own ON id = target WHERE kind = 'id' UNION ALL SELECT target, 2, id FROM kinds JOIN ends ON path = target WHERE kind = 'path'
  UNION ALL SELECT target, 3, id FROM kinds JOIN ends ON tail = lower(target) WHERE kind = 'path' AND path LIKE '%/%'
  UNION ALL SELECT target, 4, id FROM kinds JOIN own ON lower(name) = lower(target) WHERE kind = 'name' AND type IN ('function', 'class', 'method') UNION ALL SELECT target, 5, id FROM kinds JOIN ends ON base = target WHERE kind = 'name'),"""
query("resolve_target", _HITS + """
best AS (SELECT target, rank, count(DISTINCT id) AS n, min(id) AS id FROM hits GROUP BY target, rank QUALIFY row_number() OVER (PARTITION BY target ORDER BY rank) = 1)
SELECT a.target, CASE WHEN n IS NULL THEN 'not-found' WHEN n = 1 THEN 'found' ELSE 'multiple' END AS status, best.id FROM asked a LEFT JOIN best ON best.target = a.target""")(
    lambda s, d: (lambda n: S.resolve_targets(n, s.sql(_TARGETS.replace("FROM nodes", "FROM {nodes}"), nodes=n)))(G.nodes(s, d))
)
query("target_candidates", _HITS.rstrip(",") + """ SELECT DISTINCT h.target, h.id, o.type, o.path FROM (SELECT *, min(rank) OVER (PARTITION BY target) AS first FROM hits) h JOIN own o ON o.id = h.id WHERE rank = first""")(
    lambda s, d: (lambda n: S.candidates(n, s.sql(_TARGETS.replace("FROM nodes", "FROM {nodes}"), nodes=n)))(G.nodes(s, d)))
query("enclosing_symbol", """WITH places AS (SELECT DISTINCT path, start_line + 1 AS line FROM nodes WHERE type = 'function')
  SELECT p.path, p.line, arg_min(id, struct_pack(w := end_line - start_line, i := id)) AS id FROM places p JOIN nodes n ON n.path = p.path AND start_line <= line AND end_line >= line GROUP BY p.path, p.line""")(
    lambda s, d: (lambda n: A.enclosing_symbol(n, n.filter("type = 'function'").select("path", (F.col("start_line") + 1).alias("line")).distinct()))(G.nodes(s, d))
)

_NOW = "SELECT path, CASE WHEN hash_key % 7 = 0 THEN 'new' ELSE 'same' END AS content_hash FROM (SELECT path, TRY_CAST(regexp_extract(path, '([0-9]+)', 1) AS BIGINT) AS hash_key FROM nodes WHERE type = 'file' AND path <> 'src/geo.py') x WHERE hash_key % 11 <> 0"
_OLD = "SELECT path, 'same' AS content_hash FROM (SELECT path, TRY_CAST(regexp_extract(path, '([0-9]+)', 1) AS BIGINT) AS hash_key FROM nodes WHERE type = 'file' AND path <> 'src/geo.py') x WHERE hash_key % 13 <> 0"
_DIFF = f"""WITH o AS ({_OLD}), n AS ({_NOW}), diff AS (SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'removed'
  WHEN o.content_hash = n.content_hash THEN 'unchanged' ELSE 'changed' END AS change FROM o FULL JOIN n ON o.path = n.path)
"""


def _diff(s, d):
    nodes = G.nodes(s, d)
    return A.incremental_diff(s.sql(_OLD.replace("FROM nodes", "FROM {nodes}"), nodes=nodes), s.sql(_NOW.replace("FROM nodes", "FROM {nodes}"), nodes=nodes))


query("incremental_diff", _DIFF + "SELECT * FROM diff")(_diff)
query("reverse_dependents", _DIFF + """SELECT DISTINCT substr(src, 3) AS path FROM edges JOIN diff t ON dst = 'f:' || t.path AND t.change IN ('changed', 'removed')
  JOIN diff u ON src = 'f:' || u.path AND u.change = 'unchanged' WHERE type = 'imports'""")(lambda s, d: A.reverse_dependents(G.edges(s, d), _diff(s, d)))  # fmt: skip
query("change_debounce_sessions", """WITH marked AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 1 HOUR THEN 0 ELSE 1 END AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
  numbered AS (SELECT user_id, ts, sum(opens) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM marked)
  SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS changes FROM numbered GROUP BY user_id, k""")(lambda s, d: A.debounced(_table(s, d, "events"), "user_id", "1 hour"))  # fmt: skip
query("page_link_imports", """SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS specifier FROM pages""")(
    lambda s, d: _table(s, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("specifier"))
)

_SCOPES = "SELECT 'f:src/geo.py' AS scope UNION ALL SELECT 'cls:src/geo.py#FRANCE'"
_SEEDS = f"""WITH RECURSIVE scopes AS ({_SCOPES}), seeds AS (SELECT scope, scope AS id FROM scopes UNION SELECT scope, dst FROM seeds JOIN edges ON src = id AND type = 'defines')
"""


def _scopes(s):
    return s.createDataFrame([("f:src/geo.py",), ("cls:src/geo.py#FRANCE",)], "scope string")


query("scope_seeds", _SEEDS + "SELECT * FROM seeds")(lambda s, d: R.scope_seeds(G.edges(s, d), _scopes(s)))
_USED = _SEEDS + """, used AS (SELECT scope, e.* FROM edges e JOIN seeds ON src = id)
"""
query("allowlist_symbols", _USED + """SELECT scope, id, arg_max(via, r) AS via FROM (SELECT scope, dst AS id, type AS via, CASE type WHEN 'calls' THEN 1 WHEN 'imports' THEN 2 ELSE 3 END AS r
  FROM used WHERE confidence = 'resolved' AND type IN ('calls', 'imports', 'inherits') UNION ALL SELECT scope, id, 'defines', 0 FROM seeds WHERE id <> scope) GROUP BY scope, id""")(lambda s, d: U.allowlist(G.edges(s, d), _scopes(s))[0])  # fmt: skip


def _callers(s, edges):
    """Scopes with unresolved calls."""
    return edges.filter("confidence = 'ambiguous'").select(F.col("src").alias("scope")).distinct()


query("allowlist_unresolved", "WITH scopes AS (SELECT DISTINCT src AS scope FROM edges WHERE confidence = 'ambiguous') SELECT DISTINCT scope, src, callee_text, line FROM edges JOIN scopes ON scope = src WHERE confidence = 'ambiguous'")(
    lambda s, d: (lambda e: U.allowlist(e, _callers(s, e))[2])(G.edges(s, d))
)

_MODULES = "SELECT DISTINCT src, CASE k % 4 WHEN 0 THEN 'node:fs' WHEN 1 THEN 'https' WHEN 2 THEN 'child_process' ELSE 'left-pad' END AS module FROM (SELECT src, CAST(regexp_extract(dst, '([0-9]+)', 1) AS BIGINT) AS k FROM edges WHERE type = 'imports' AND dst LIKE 'xm:%') x"


def _module_edges(s, d):
    """Imports of the test graph's modules, under names of real ones."""
    edges = G.all_edges(s, d)
    return s.sql(f"SELECT src, 'xm:' || module AS dst, 'imports' AS type, 1 AS line, CAST(NULL AS STRING) AS callee_text, 'resolved' AS confidence FROM ({_MODULES.replace('FROM edges', 'FROM {edges}')}) y", edges=edges)


query("derived_grants", f"SELECT src AS scope, CASE module WHEN 'node:fs' THEN 'filesystem' WHEN 'https' THEN 'network' ELSE 'subprocess' END AS category, module FROM ({_MODULES}) WHERE module <> 'left-pad'")(
    lambda s, d: (lambda e: U.derived_grants(e, e.select(F.col("src").alias("scope")).distinct()))(_module_edges(s, d))
)

# every file asks for the files it imports by a path beside it, for one above it, for modules of the runtime and for its packages
_WANTED = """SELECT DISTINCT './' || regexp_replace(dst, '^f:.*/', '') AS specifier, CAST(line AS BIGINT) AS line FROM edges WHERE type = 'imports' AND dst LIKE 'f:%'
UNION SELECT DISTINCT './no' || regexp_replace(dst, '^f:.*/', ''), CAST(line AS BIGINT) FROM edges WHERE type = 'imports' AND dst LIKE 'f:%' UNION SELECT DISTINCT '../' || regexp_replace(dst, '^f:.*/', ''), CAST(line AS BIGINT) FROM edges WHERE type = 'imports' AND dst LIKE 'f:%'
UNION SELECT DISTINCT module, CAST(k AS BIGINT) FROM ({NAMED}) m UNION SELECT DISTINCT regexp_replace(dst, '^xm:', ''), 1 FROM edges WHERE dst LIKE 'xm:%'"""
_RUNTIME = "SELECT CASE k % 5 WHEN 0 THEN 'fs' WHEN 1 THEN 'node:https' WHEN 2 THEN 'os' WHEN 3 THEN 'left-pad' ELSE 'chalk' END AS module, k FROM (SELECT CAST(regexp_extract(dst, '([0-9]+)', 1) AS BIGINT) AS k FROM edges WHERE dst LIKE 'xm:%') x"
_WANTED = _WANTED.replace("{NAMED}", _RUNTIME)
# allowed: the files below src, the file system, and packages of even numbers
_EVEN = "SELECT DISTINCT regexp_replace(dst, '^xm:', '') AS module FROM edges WHERE dst LIKE 'xm:%' AND CAST(regexp_extract(dst, '([0-9]+)', 1) AS BIGINT) % 2 = 0"


def _breaches(s, d):
    edges = G.edges(s, d)
    sql = lambda text: s.sql(text.replace("FROM edges", "FROM {edges}"), edges=edges)
    return U.module_breaches(sql(_WANTED), G.nodes(s, d).filter("type = 'file' and path like 'src/%'").select("path"), s.createDataFrame([("filesystem",)], "category string"), sql(_EVEN))


query("module_access_breaches", f"""WITH w AS ({_WANTED}), base AS (SELECT regexp_replace(path, '^.*/', '') AS name FROM nodes WHERE type = 'file' AND path LIKE 'src/%'), even AS ({_EVEN}),
t AS (SELECT w.*, CASE WHEN specifier LIKE '../%' THEN 'unverifiable-import' WHEN specifier LIKE './%' AND substr(specifier, 3) NOT IN (SELECT name FROM base) THEN 'disallowed-import' WHEN specifier LIKE './%' THEN NULL
  WHEN specifier = 'node:https' THEN 'ungranted-resource' WHEN specifier = 'os' THEN 'disallowed-import' WHEN specifier = 'fs' THEN NULL WHEN specifier NOT IN (SELECT module FROM even) THEN 'disallowed-import' END AS kind FROM w)
SELECT specifier, line, kind, CASE WHEN specifier LIKE './%' OR specifier LIKE '../%' THEN 'files' WHEN specifier = 'node:https' THEN 'resources.network' WHEN specifier <> 'os' THEN 'symbols' END AS area FROM t WHERE kind IS NOT NULL""")(_breaches)  # fmt: skip

# questions about what the tables name, in several phrasings, some of which fit no intent
_PHRASES = (("What depends on {0}?", "path", "blast-radius", True), ("Is {0} dead code?", "name", "dead-code-check", True), ("what's the riskiest file in {0}", "folder", "riskiest-file", False), ("What is untested in {0}?", "folder", "untested", False), ("tell me of {0}", "name", None, None))
_TOPICS = "SELECT path, name, regexp_replace(path, '/[^/]*$', '') AS folder FROM nodes WHERE type = 'function'"


def _asked(s, d):
    topics = s.sql(_TOPICS.replace("FROM nodes", "FROM {nodes}"), nodes=G.nodes(s, d))
    parts = lambda text: [F.lit(t) for t in text.split("{0}")]
    each = F.array(*[F.concat(parts(text)[0], F.col(c), parts(text)[1]) for text, c, _, _ in _PHRASES])
    return topics.select(F.explode(each).alias("question")).distinct()


def _asked_sql() -> str:
    one = lambda text, c, intent, to: f"SELECT {' || '.join(repr(p).replace(chr(34), chr(39)) if chr(39) not in p else chr(39) + p.replace(chr(39), chr(39) * 2) + chr(39) for p in [text.split('{0}')[0]])} || {c} || '{text.split('{0}')[1]}' AS question, {f'{chr(39)}{intent}{chr(39)}' if intent else 'NULL'} AS intent, {c if to else 'NULL'} AS target, {c if to is False else 'NULL'} AS scope FROM t"
    return f"WITH t AS ({_TOPICS}) SELECT DISTINCT * FROM (" + " UNION ALL ".join(one(*p) for p in _PHRASES) + ") q"


query("question_intents", _asked_sql())(lambda s, d: _asked(s, d).withColumn("i", Q.intent(F.col("question"))).select("question", "i.intent", "i.target", "i.scope"))
query("import_candidates_first_match", """WITH c AS (SELECT k, 'src/p' || k || '.py' AS candidate, 0 AS ordinal FROM (SELECT p_partkey AS k FROM part) UNION ALL SELECT k, 'tests/p' || k || '.py', 1 FROM (SELECT p_partkey AS k FROM part)
  UNION ALL SELECT k, 'src/geo.py', 2 FROM (SELECT p_partkey AS k FROM part)) SELECT k, arg_min(candidate, ordinal) AS target FROM c WHERE candidate IN (SELECT path FROM nodes WHERE type = 'file') GROUP BY k""")(
    lambda s, d: A.first_match(
        _table(s, d, "part").select(F.col("p_partkey").alias("k"), F.posexplode(F.array(F.concat(F.lit("src/p"), "p_partkey", F.lit(".py")), F.concat(F.lit("tests/p"), "p_partkey", F.lit(".py")), F.lit("src/geo.py"))).alias("ordinal", "candidate")),
        G.nodes(s, d).filter("type = 'file'").select("path"), ["k"],
    )
)

# Python sources written from the tables: a module for each region, with its nations as classes, and their suppliers as methods that call each other and a helper
_MODULES_OF = """SELECT r_name, r_regionkey, n_name, s_suppkey, lead(s_suppkey) OVER (PARTITION BY n_name ORDER BY s_suppkey) AS then
FROM {region} JOIN {nation} ON n_regionkey = r_regionkey JOIN {supplier} ON s_nationkey = n_nationkey"""


def _ident(c: str) -> str:
    return f"regexp_replace(lower({c}), '[^a-z0-9]+', '_')"


def _records(s, d):
    ship(s)
    rows = s.sql(G.expand(_MODULES_OF, {t: f"parquet.`{d}/{t}.parquet`" for t in G.BASE}))
    method = F.concat(F.format_string("    def m%d(self):\n        helper()\n        return ", "s_suppkey"), F.when(F.col("then").isNotNull(), F.format_string("self.m%d()", "then")).otherwise("unknown_name()"), F.lit("\n\n"))
    classes = rows.groupBy("r_name", "r_regionkey", "n_name").agg(F.array_join(F.array_sort(F.collect_list(F.struct("s_suppkey", method.alias("text"))))["text"], "").alias("body"))
    named = classes.withColumn("text", F.concat(F.lit("class "), F.expr(_ident("n_name")), F.lit(":\n"), "body"))
    files = named.groupBy("r_name").agg(F.array_join(F.array_sort(F.collect_list("text")), "\n").alias("text"))
    text = F.concat(F.lit("import os\nfrom lib.base import helper\n\n\n"), "text")
    base = s.sql("SELECT 'lib/base.py' AS path, 'def helper():\n    return os.getcwd()\n' AS text")
    files = files.select(F.concat(F.lit("app/"), F.expr(_ident("r_name")), F.lit(".py")).alias("path"), text.alias("text")).unionByName(base)
    return facts.extract(files.select("path", F.lit("python").alias("language"), F.encode("text", "utf-8").alias("content"), F.sha2("text", 256).alias("content_hash")))


_SOURCE_VIEW = f"WITH src AS ({G.expand(_MODULES_OF, {t: t for t in G.BASE})}), named AS (SELECT 'app/' || {_ident('r_name').replace(chr(39) + '_' + chr(39) + ')', chr(39) + '_' + chr(39) + ', ' + chr(39) + 'g' + chr(39) + ')')} || '.py' AS path, {_ident('n_name').replace(chr(39) + '_' + chr(39) + ')', chr(39) + '_' + chr(39) + ', ' + chr(39) + 'g' + chr(39) + ')')} AS cls, 'm' || s_suppkey AS m, 'm' || \"then\" AS next FROM src)\n".replace('\\"', '"')
query("extract_python_symbols", _SOURCE_VIEW + """SELECT DISTINCT path, cls AS name, 1 AS kind, 'cls:' || path || '#' || cls AS id FROM named UNION ALL SELECT path, m, 2, 'm:' || path || '#' || cls || '.' || m FROM named
  UNION ALL SELECT 'lib/base.py', 'helper', 0, 'fn:lib/base.py#helper'""")(lambda s, d: resolve.local_names(_records(s, d)).drop("order"))
query("resolved_source_edges", _SOURCE_VIEW + """SELECT 'calls' AS type, 'm:' || path || '#' || cls || '.' || m AS src, 'fn:lib/base.py#helper' AS dst, NULL AS callee_text FROM named
  UNION ALL SELECT 'calls', 'm:' || path || '#' || cls || '.' || m, CASE WHEN next IS NOT NULL THEN 'm:' || path || '#' || cls || '.' || next END, CASE WHEN next IS NULL THEN 'unknown_name' END FROM named
  UNION ALL SELECT DISTINCT 'imports', 'f:' || path, 'xm:os', NULL FROM named UNION ALL SELECT DISTINCT 'imports', 'f:' || path, 'f:lib/base.py', NULL FROM named
  UNION ALL SELECT DISTINCT 'defines', 'f:' || path, 'cls:' || path || '#' || cls, NULL FROM named UNION ALL SELECT 'defines', 'cls:' || path || '#' || cls, 'm:' || path || '#' || cls || '.' || m, NULL FROM named
  UNION ALL SELECT 'defines', 'f:lib/base.py', 'fn:lib/base.py#helper', NULL UNION ALL SELECT 'calls', 'fn:lib/base.py#helper', NULL, 'os.getcwd'""")(lambda s, d: resolve.build_graph(_records(s, d))[1].select("type", "src", "dst", "callee_text"))


# File records made from the tables: parts are files, their customers functions, lines imports, orders calls and references.
_FUNCTIONS = "SELECT path, name, start_line, end_line, exported FROM ({FUNCTION}) f"
_IMPORTED = "SELECT DISTINCT a.path, b.path AS target, replace(replace(b.path, '.py', ''), '/', '.') AS specifier FROM ({LINES}) l JOIN ({PART}) a ON a.k = l_partkey JOIN ({PART}) b ON b.k = next_part WHERE a.path <> b.path"
_SITES = "SELECT f.path, f.name AS container, g.name, c.line FROM ({CALLS}) c JOIN ({FUNCTION}) f ON f.k = caller JOIN ({FUNCTION}) g ON g.k = callee"
_NAMED = "SELECT f.path, g.name, CAST(o_custkey % 90 + 1 AS INT) AS line FROM {orders} JOIN ({FUNCTION}) f ON f.k = o_custkey JOIN ({FUNCTION}) g ON g.path = f.path"
_PLAIN_TABLES = {t: t for t in G.BASE}


def _dealt(s, d):
    return dealt_by(s, _table(s, d, "lineitem").count())


def _table_records(s, d):
    """The records, made and written once an application: what resolves names reads them many times."""
    with _dealt(s, d):
        return once(s, (d, "records"), lambda: _made_records(s, d))


def _made_records(s, d, only=("functions", "imports", "calls", "references", "classes")):
    """The records as a frame, with the lists of ``only``; lists are in order of their fields, so that order is the same everywhere."""
    sql = lambda text: s.sql(G.expand(text, {t: f"parquet.`{d}/{t}.parquet`" for t in G.BASE}))
    listed = lambda df, name, fields: df.groupBy("path").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias(name))
    own = sql(_FUNCTIONS)
    functions = listed(own, "functions", ["name", "start_line", "end_line", "exported"])
    names = own.groupBy(F.col("path").alias("target")).agg(F.sort_array(F.collect_list("name")).alias("named_imports"))
    bound = sql(_IMPORTED).join(names, "target", "left")
    none = F.lit(None).cast("string")
    imports = listed(bound, "imports", ["specifier", none.alias("default_import"), none.alias("namespace_import"), F.coalesce("named_imports", F.array().cast("array<string>")).alias("named_imports"), F.lit(1).alias("line")])
    calls = listed(sql(_SITES), "calls", [F.lit("plain").alias("kind"), none.alias("object"), "name", "line", "container"])
    references = listed(sql(_NAMED), "references", ["name", "line", F.lit("<file>").alias("container")])
    empty = {
        "functions": "array<struct<name:string,start_line:int,end_line:int,exported:boolean>>", "imports": "array<struct<specifier:string,default_import:string,namespace_import:string,named_imports:array<string>,line:int>>",
        "calls": "array<struct<kind:string,object:string,name:string,line:int,container:string>>", "references": "array<struct<name:string,line:int,container:string>>",
    }
    own_class = F.struct("first.name", "first.start_line", "first.end_line", F.lit(False).alias("exported"), F.array(F.struct(F.col("last.name").alias("name"), F.col("last.start_line").alias("start_line"), F.col("last.end_line").alias("end_line"))).alias("methods"), F.array().cast("array<string>").alias("extends"))
    classes = own.groupBy("path").agg(F.min(F.struct("name", "start_line", "end_line")).alias("first"), F.max(F.struct("name", "start_line", "end_line")).alias("last")).select("path", F.array(own_class).alias("classes"))
    empty["classes"] = "array<struct<name:string,start_line:int,end_line:int,exported:boolean,methods:array<struct<name:string,start_line:int,end_line:int>>,extends:array<string>>>"
    none_of = {"exports": "array<struct<kind:string,names:array<string>,line:int>>"}
    rows = sql("SELECT path, 'python' AS language FROM ({PART}) p")
    for name, lists in {"functions": functions, "imports": imports, "calls": calls, "references": references, "classes": classes}.items():
        if name in only:
            rows = rows.join(lists, "path", "left")
    filled = {k: F.coalesce(F.col(k).cast(kind), F.array().cast(kind)) for k, kind in empty.items() if k in only} | {k: F.array().cast(kind) for k, kind in none_of.items()}
    return rows.withColumns(filled)


def _records_oracle(sql: str) -> str:
    views = {"fns": "SELECT path, name, exported FROM ({FUNCTION}) f", "imported": _IMPORTED, "sites": _SITES, "named": _NAMED, "parts": "SELECT path FROM ({PART}) p"}
    return "WITH " + ", ".join(f"{k} AS ({G.expand(v, _PLAIN_TABLES)})" for k, v in views.items()) + " " + sql


def _table_calls(s, d):
    files = _table_records(s, d)
    with _dealt(s, d):
        bound, exported = keep(resolve.bindings(files, keep(resolve.resolve_imports(files)))), resolve.exported_symbols(files)
        return keep(resolve.call_edges(files, bound, exported, resolve.inherit_edges(files, bound, exported)))


def _table_imports(s, d):
    with _dealt(s, d):
        return keep(resolve.resolve_imports(_made_records(s, d, ("imports",))))


QUERIES["import_resolution"] = _table_imports
ORACLE_SQL["import_resolution"] = _records_oracle("SELECT i.path, specifier, p.path AS target FROM imported i LEFT JOIN parts p ON p.path = replace(specifier, '.', '/') || '.py'")
QUERIES["call_resolution_plain"] = lambda s, d: _table_calls(s, d).select("src", "dst", "line", "callee_text", "confidence")
ORACLE_SQL["call_resolution_plain"] = _records_oracle("""
, hits AS (SELECT i.path, g.name, min_by(CASE WHEN p.path IS NULL THEN 'xf:' || specifier || '#' || g.name ELSE 'fn:' || p.path || '#' || g.name END, specifier) AS hit
  FROM imported i JOIN fns g ON g.path = i.target LEFT JOIN parts p ON p.path = replace(specifier, '.', '/') || '.py' WHERE p.path IS NULL OR g.exported GROUP BY i.path, g.name),
done AS (SELECT s.*, coalesce('fn:' || f.path || '#' || f.name, hit) AS dst FROM sites s LEFT JOIN fns f ON f.path = s.path AND f.name = s.name LEFT JOIN hits h ON h.path = s.path AND h.name = s.name)
SELECT 'fn:' || path || '#' || container AS src, dst, line, CASE WHEN dst IS NULL THEN name END AS callee_text, CASE WHEN dst IS NULL THEN 'ambiguous' ELSE 'resolved' END AS confidence FROM done""")
QUERIES["reference_edges"] = lambda s, d: resolve.reference_edges(_table_records(s, d)).select("src", "dst", "line")
ORACLE_SQL["reference_edges"] = _records_oracle("""
, ends AS (SELECT path, min(name) AS a, max(name) AS b FROM fns GROUP BY path)
SELECT 'f:' || n.path AS src, CASE WHEN n.name = b THEN 'm:' || n.path || '#' || a || '.' || b WHEN n.name = a THEN 'cls:' || n.path || '#' || a ELSE 'fn:' || n.path || '#' || n.name END AS dst, min(line) AS line
FROM named n JOIN fns f ON f.path = n.path AND f.name = n.name JOIN ends e ON e.path = n.path GROUP BY n.path, n.name, a, b""")

_CLASSES = """SELECT 'src/c' || CAST(n_nationkey % 7 AS STRING) || '.py' AS path, n_name AS name, r_name AS base, n_nationkey + 1 AS line FROM {nation} JOIN {region} ON r_regionkey = n_regionkey
UNION ALL SELECT 'src/c' || CAST(r_regionkey AS STRING) || '.py', r_name, NULL, r_regionkey + 100 FROM {region} UNION ALL SELECT 'src/c6.py', r_name, NULL, r_regionkey + 200 FROM {region} WHERE r_regionkey < 2"""


def _class_records(s, d):
    rows = s.sql(G.expand(_CLASSES, {t: f"parquet.`{d}/{t}.parquet`" for t in G.BASE}))
    methods = F.array(F.struct(F.concat(F.lit("of_"), "name").alias("name"), "line", "line"))
    kinds = "struct<name:string,start_line:int,end_line:int,exported:boolean,methods:array<struct<name:string,start_line:int,end_line:int>>,extends:array<string>>"
    one = F.struct("name", F.col("line").alias("start_line"), F.col("line").alias("end_line"), F.lit(True).alias("exported"), methods.alias("methods"), F.array_compact(F.array("base")).alias("extends")).cast(kinds)
    # each nation's method calls its own, its base's, and one that nobody has
    sites = F.flatten(F.transform(F.collect_list(F.when(F.col("base").isNotNull(), F.struct("name", "base", "line"))), lambda x: F.transform(F.array(x["name"], x["base"], F.lit("NOBODY")), lambda m: F.struct(F.lit("self").alias("kind"), F.lit("self").alias("object"), F.concat(F.lit("of_"), m).alias("name"), x["line"].alias("line"), F.concat(x["name"], F.lit(".of_"), x["name"]).alias("container")))))
    files = rows.groupBy("path").agg(F.collect_list(one).alias("classes"), sites.alias("calls"))
    empty = {"functions": "array<struct<name:string,start_line:int,end_line:int,exported:boolean>>", "imports": "array<struct<specifier:string,default_import:string,namespace_import:string,named_imports:array<string>,line:int>>", "exports": "array<struct<kind:string,names:array<string>,line:int>>"}
    return files.withColumn("language", F.lit("python")).withColumns({k: F.array().cast(v) for k, v in empty.items()})


def _class_edges(s, d):
    files = _class_records(s, d)
    resolved = resolve.resolve_imports(files)
    bound, exported = resolve.bindings(files, resolved), resolve.exported_symbols(files)
    return files, bound, exported, resolve.inherit_edges(files, bound, exported)


_CLASS_VIEWS = f"""WITH c AS ({G.expand(_CLASSES, _PLAIN_TABLES)}), single AS (SELECT name, min('cls:' || path || '#' || name) AS id FROM c GROUP BY name HAVING count(*) = 1),
inh AS (SELECT c.path, c.name, c.base, c.line, coalesce('cls:' || o.path || '#' || o.name, s.id) AS dst FROM c LEFT JOIN c o ON o.path = c.path AND o.name = c.base LEFT JOIN single s ON s.name = c.base WHERE c.base IS NOT NULL)
"""
QUERIES["inherits_resolution"] = lambda s, d: _class_edges(s, d)[3].select("src", "dst", "line", "callee_text", "confidence")
ORACLE_SQL["inherits_resolution"] = _CLASS_VIEWS + "SELECT 'cls:' || path || '#' || name AS src, dst, line, CASE WHEN dst IS NULL THEN base END AS callee_text, CASE WHEN dst IS NULL THEN 'ambiguous' ELSE 'resolved' END AS confidence FROM inh"
QUERIES["call_resolution_chain"] = lambda s, d: resolve.call_edges(*_class_edges(s, d)).select("src", "dst", "line", "callee_text")
ORACLE_SQL["call_resolution_chain"] = _CLASS_VIEWS + """, asked AS (SELECT path, name, line, dst AS up, unnest([name, base, 'NOBODY']) AS m, base FROM inh)
SELECT 'm:' || path || '#' || name || '.of_' || name AS src, CASE WHEN m = name THEN 'm:' || path || '#' || name || '.of_' || name WHEN m = base AND up IS NOT NULL THEN 'm:' || substr(up, 5) || '.of_' || base END AS dst, line,
  CASE WHEN m = 'NOBODY' OR m = base AND up IS NULL THEN 'self.of_' || m END AS callee_text FROM asked"""

# Diamonds: a nation extends its own region and the one after, a region the customers' segments from its own on, segments nothing.
_SEGMENTS = "SELECT c_mktsegment AS name, row_number() OVER (ORDER BY c_mktsegment) - 1 AS k, count(*) AS n, min(c_custkey) AS first FROM {customer} GROUP BY c_mktsegment"
_DIAMONDS = """SELECT n_name AS name, 1 AS kind, n_nationkey AS k, array_r AS bases FROM (SELECT n_name, n_nationkey, {list}(a.r_name, b.r_name) AS array_r FROM {nation} JOIN {region} a ON a.r_regionkey = n_regionkey JOIN {region} b ON b.r_regionkey = (n_regionkey + 1) % 5) t
UNION ALL SELECT r_name, 2, r_regionkey, {list}(a.name, b.name) FROM {region} JOIN ({SEGMENTS}) a ON a.k = (r_regionkey + 2) % 5 JOIN ({SEGMENTS}) b ON b.k = (r_regionkey + 4) % 5
UNION ALL SELECT name, 3, CAST(k AS INT), {none} FROM ({SEGMENTS}) s"""


def _diamonds(tables, many, none):
    return G.expand(_DIAMONDS.replace("{SEGMENTS}", _SEGMENTS).replace("{list}", many).replace("{none}", none), tables)


def _diamond_records(s, d):
    """One file; all segments have ``deep``, those that begin with a customer of an odd key ``odd`` too, regions and segments ``both``."""
    rows = s.sql(_diamonds({t: f"parquet.`{d}/{t}.parquet`" for t in G.BASE}, "array", "CAST(array() AS ARRAY<STRING>)"))
    segments = s.sql(G.expand(_SEGMENTS, {t: f"parquet.`{d}/{t}.parquet`" for t in G.BASE})).select("name", (F.col("first") % 2 == 1).alias("odd"))
    rows = rows.join(segments, "name", "left")
    line = (F.col("kind") * 100 + F.col("k")).cast("int")
    method = lambda n: F.struct(F.lit(n).alias("name"), line.alias("start_line"), line.alias("end_line"))
    methods = F.array_compact(F.array(F.when(F.col("kind") == 1, method("go")), F.when(F.col("kind") > 1, method("both")), F.when(F.col("kind") == 3, method("deep")), F.when(F.coalesce("odd", F.lit(False)), method("odd"))))
    one = F.struct("name", line.alias("start_line"), line.alias("end_line"), F.lit(True).alias("exported"), methods.alias("methods"), F.col("bases").alias("extends"))
    calls = F.transform(F.array(*map(F.lit, ("both", "deep", "odd", "nobody"))), lambda m: F.struct(F.lit("self").alias("kind"), F.lit("self").alias("object"), m.alias("name"), line.alias("line"), F.concat("name", F.lit(".go")).alias("container")))
    files = rows.groupBy(F.lit("src/all.py").alias("path")).agg(F.array_sort(F.collect_list(one)).alias("classes"), F.flatten(F.collect_list(F.when(F.col("kind") == 1, calls))).alias("calls"))
    empty = {"functions": "array<struct<name:string,start_line:int,end_line:int,exported:boolean>>", "imports": "array<struct<specifier:string,default_import:string,namespace_import:string,named_imports:array<string>,line:int>>", "exports": "array<struct<kind:string,names:array<string>,line:int>>"}
    return files.withColumn("language", F.lit("python")).withColumns({k: F.array().cast(v) for k, v in empty.items()})


def _diamond_edges(s, d):
    files = _diamond_records(s, d)
    bound, exported = resolve.bindings(files, resolve.resolve_imports(files)), resolve.exported_symbols(files)
    return files, bound, exported, resolve.inherit_edges(files, bound, exported)


_WAYS = f"""WITH c AS ({_diamonds(_PLAIN_TABLES, "list_value", "CAST([] AS VARCHAR[])")}), seg AS ({G.expand(_SEGMENTS, _PLAIN_TABLES)}),
up AS (SELECT c.name, c.kind, c.k, generate_subscripts(bases, 1) - 1 AS place, unnest(bases) AS base FROM c),
ways AS (SELECT name, base AS ancestor, [place] AS way FROM up UNION ALL SELECT u.name, v.base, [u.place, v.place] FROM up u JOIN up v ON v.name = u.base),
best AS (SELECT name, ancestor, min(way) AS way FROM ways GROUP BY name, ancestor)
"""
QUERIES["ancestor_order"] = lambda s, d: resolve.ancestors(_diamond_edges(s, d)[3]).select("src", "ancestor", F.array_join(F.col("way").cast("array<string>"), "-").alias("way"))
ORACLE_SQL["ancestor_order"] = _WAYS + "SELECT 'cls:src/all.py#' || name AS src, 'cls:src/all.py#' || ancestor AS ancestor, array_to_string(way, '-') AS way FROM best"
QUERIES["call_resolution_diamond"] = lambda s, d: resolve.call_edges(*_diamond_edges(s, d)).select("src", "dst", "line", "callee_text")
ORACLE_SQL["call_resolution_diamond"] = _WAYS + """, has AS (SELECT name, 'both' AS m FROM c WHERE kind > 1 UNION ALL SELECT name, 'deep' FROM c WHERE kind = 3 UNION ALL SELECT name, 'odd' FROM seg WHERE first % 2 = 1),
asked AS (SELECT name, CAST(100 + k AS INT) AS line, unnest(['both', 'deep', 'odd', 'nobody']) AS m FROM c WHERE kind = 1),
hit AS (SELECT a.name, a.m, arg_min(b.ancestor, struct_pack(n := len(way), w := way)) AS owner FROM asked a JOIN best b ON b.name = a.name JOIN has h ON h.name = b.ancestor AND h.m = a.m GROUP BY a.name, a.m)
SELECT 'm:src/all.py#' || a.name || '.go' AS src, 'm:src/all.py#' || owner || '.' || a.m AS dst, line, CASE WHEN owner IS NULL THEN 'self.' || a.m END AS callee_text FROM asked a LEFT JOIN hit ON hit.name = a.name AND hit.m = a.m"""
