"""Queries against their own SQL, on the smallest tables."""

import os

import duckdb
import pytest

from graphloom.plans import catalogue

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no tables")
TABLES = "region nation customer supplier part orders lineitem events pages".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", ["node_counts_by_type", "edge_guard_violations", "ambiguous_hotspots", "dependent_counts", "file_churn", "enclosing_symbol", "incremental_diff", "question_intents", "module_access_breaches", "reference_edges", "resolve_target", "target_candidates", "dead_code_verdicts", "security_signals", "complexity_totals", "ancestor_order", "call_resolution_diamond", "representative_cycles", "test_coverage_pairs", "extract_python_symbols", "resolved_source_edges"])
def test_query_equals_sql(spark, duck, name):
    found = catalogue.QUERIES[name](spark, SMALL)
    wanted = duck.sql(catalogue.ORACLE_SQL[name])
    columns = sorted(found.columns)
    assert columns == sorted(wanted.columns)
    text = lambda rows: sorted(tuple(map(str, r)) for r in rows)
    assert text(found.select(*columns).collect()) == text(wanted.select(*[f'"{c}"' for c in columns]).fetchall())


def test_every_query_has_a_name_in_both_or_is_beyond_sql():
    beyond = set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)
    assert beyond == {"representative_import_cycles"}


def test_no_depth_ends_the_walk_of_the_blast_radius():
    con = duckdb.connect()
    con.execute("CREATE TABLE nodes AS SELECT 'fn:' || i AS id, '' || i AS name FROM range(101) t(i)")
    con.execute("CREATE TABLE edges AS SELECT 'fn:' || (i + 1) AS src, 'fn:' || i AS dst, 'calls' AS type, 'resolved' AS confidence, NULL::VARCHAR AS callee_text FROM range(100) t(i)")
    con.execute("INSERT INTO edges VALUES ('fn:0', 'fn:99', 'calls', 'resolved', NULL), ('fn:98', 'fn:0', 'calls', 'resolved', NULL)")
    assert con.execute(catalogue._WALK + "SELECT max(depth), count(*) FROM sure WHERE root = 'fn:0'").fetchone() == (97, 101)


@pytest.mark.parametrize("name", sorted(catalogue.WHOLE - {"derived_grants"}))
def test_whole_queries_take_every_import_and_call(name):
    """Their SQL ranks no edges to leave some out."""
    sql = catalogue.ORACLE_SQL[name]
    assert "place = 1" not in sql and "JOIN (" in sql and "next_part GROUP BY a.path, b.path" in sql
