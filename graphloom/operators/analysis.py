"""Counts, dead code, coverage, churn, risk and architecture figures over the graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import paths
from graphloom.operators import coverage
from graphloom.schema import AMBIGUOUS, DEPENDENCY, RESOLVED

MAIN_NAMES = ("main", "__main__")
WINDOW_DAYS = 90
# Fixed weights of the risk score.
CHURN_MOST, CHURN_WEIGHT = 10, 70
NO_TEST_WEIGHT = 30
COMPLEXITY_MOST, COMPLEXITY_WEIGHT = 15, 30


def ambiguous_hotspots(edges: DataFrame, top: int = 6) -> DataFrame:
    """The texts that most unresolved edges keep; ties by text."""
    loose = edges.filter((F.col("confidence") == AMBIGUOUS) & F.col("callee_text").isNotNull())
    return loose.groupBy("callee_text").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "callee_text").limit(top)


def most_imported(edges: DataFrame, top: int = 5) -> DataFrame:
    """Files with most import edges into them; ties by id."""
    into = edges.filter((F.col("type") == "imports") & F.col("dst").startswith("f:")).groupBy("dst").agg(F.count("*").alias("n"))
    return into.orderBy(F.col("n").desc(), "dst").limit(top).select(F.expr("substring(dst, 3)").alias("path"), "n")


def dependent_counts(edges: DataFrame) -> DataFrame:
    used = edges.filter(F.col("type").isin(*DEPENDENCY) & (F.col("confidence") == RESOLVED))
    return used.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("dependents"))


def inbound_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, n) of every node: resolved calls, imports, inherits and references into it."""
    used = edges.filter(F.col("type").isin(*DEPENDENCY, "references") & (F.col("confidence") == RESOLVED)).groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("k"))
    return nodes.select("id").join(used, "id", "left").select("id", F.coalesce("k", F.lit(0)).cast("long").alias("n"))


def _used(edges: DataFrame) -> DataFrame:
    """Targets of resolved calls and inherits."""
    return edges.filter(F.col("type").isin("calls", "inherits") & (F.col("confidence") == RESOLVED) & F.col("dst").isNotNull()).select(F.col("dst").alias("id")).distinct()


def _loose_names(edges: DataFrame) -> DataFrame:
    loose = edges.filter((F.col("confidence") == AMBIGUOUS) & F.col("callee_text").isNotNull())
    return loose.select(paths.last_segment(F.col("callee_text")).alias("name")).distinct().withColumn("loose", F.lit(True))


def dead_code(nodes: DataFrame, edges: DataFrame, main_names: tuple[str, ...] = MAIN_NAMES) -> DataFrame:
    """(id, type, name, path, tier): unexported functions and classes that no resolved call or inherit reaches.

    Entry files, tests and main functions are left out. A name that an
    unresolved edge ends in is only ``no-resolved-references``; one that is
    passed around is ``referenced-but-uncalled``; the rest is
    ``confirmed-unreferenced``.
    """
    own = nodes.filter("not external and not exported and path is not null and type in ('function', 'class')")
    own = own.filter(~F.col("name").isin(*main_names) & ~paths.is_entry(F.col("path")) & ~paths.is_test(F.col("path")))
    referenced = edges.filter((F.col("type") == "references") & (F.col("confidence") == RESOLVED)).select(F.col("dst").alias("id")).distinct().withColumn("referenced", F.lit(True))
    left = own.join(_used(edges), "id", "left_anti").join(referenced, "id", "left").join(_loose_names(edges), "name", "left")
    tier = F.when(F.col("loose"), "no-resolved-references").when(F.col("referenced"), "referenced-but-uncalled").otherwise("confirmed-unreferenced")
    return left.select("id", "type", "name", "path", tier.alias("tier"))


def dead_methods(nodes: DataFrame, edges: DataFrame, dead: DataFrame) -> DataFrame:
    """(id, name, path, owner, tier): methods, without callers, of classes that are certainly dead."""
    owners = dead.filter("type = 'class' and tier = 'confirmed-unreferenced'").select(F.col("id").alias("owner"))
    defines = edges.filter("type = 'defines'").select(F.col("src").alias("owner"), F.col("dst").alias("id")).distinct()
    methods = nodes.filter("type = 'method'").select("id", "name", "path")
    found = methods.join(defines.join(owners, "owner"), "id").join(_used(edges), "id", "left_anti").join(_loose_names(edges), "name", "left")
    return found.select("id", "name", "path", "owner", F.when(F.col("loose"), "no-resolved-references").otherwise("confirmed-unreferenced").alias("tier"))


def verdicts(nodes: DataFrame, edges: DataFrame, dead: DataFrame) -> DataFrame:
    """(id, verdict, tier, inbound) of every node of the repository itself; ``dead`` (id, tier) may hold methods too.

    Files are no candidates. Others are dead candidates with a tier, or
    referenced; inbound counts resolved calls and inherits.
    """
    into = edges.filter(F.col("type").isin("calls", "inherits") & (F.col("confidence") == RESOLVED)).groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("k"))
    rows = nodes.filter("not external").select("id", "type").join(dead.select("id", "tier"), "id", "left").join(into, "id", "left")
    verdict = F.when(~F.col("type").isin("function", "class", "method"), "not-a-candidate").when(F.col("tier").isNotNull(), "dead-candidate").otherwise("referenced")
    return rows.select("id", verdict.alias("verdict"), "tier", F.coalesce("k", F.lit(0)).cast("long").alias("inbound"))


def coverage_summary(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row: test files, source files, covered ones (``path`` of ``pairs``, or of covered files), and their share to 4 places."""
    files = nodes.filter("type = 'file' and path is not null").select("path", paths.is_test(F.col("path")).alias("test"))
    covered = pairs.select("path").distinct().withColumn("covered", F.lit(1))
    totals = files.join(covered, "path", "left").agg(
        F.sum(F.col("test").cast("long")).alias("test_files"), F.sum((~F.col("test")).cast("long")).alias("source_files"), F.coalesce(F.sum(F.when(~F.col("test"), F.col("covered"))), F.lit(0)).cast("long").alias("covered_files")
    )
    return totals.withColumn("ratio", F.when(F.col("source_files") > 0, F.round(F.col("covered_files") / F.col("source_files"), 4)).otherwise(F.lit(0.0)))


def uncovered(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Source files that no test reaches."""
    files = nodes.filter("type = 'file' and path is not null").filter(~paths.is_test(F.col("path"))).select("path")
    return files.join(pairs.select("path").distinct(), "path", "left_anti")


def churn(commits: DataFrame, as_of: Column, window_days: int = WINDOW_DAYS) -> DataFrame:
    """(path, commits_total, commits_in_window, last_modified): the window ends at ``as_of`` and its edge counts.

    last_modified is the newest commit's own text; of equal times that listed first.
    """
    inside = F.col("ts") >= as_of - F.make_dt_interval(F.lit(window_days))
    newest = F.max_by("date_iso", F.struct("ts", -F.col("seq")))
    return commits.groupBy("path").agg(F.count("*").alias("commits_total"), F.count_if(inside).alias("commits_in_window"), newest.alias("last_modified"))


def complexity_by_file(facts: DataFrame) -> DataFrame:
    return facts.groupBy("path").agg(F.max("complexity").alias("max_complexity"), F.count("*").alias("functions"))


def complexity_totals(facts: DataFrame) -> DataFrame:
    """One row: files with functions, functions, the largest complexity (0 without functions)."""
    return facts.agg(F.count_distinct("path").alias("files"), F.count("*").alias("functions"), F.coalesce(F.max("complexity"), F.lit(0)).cast("int").alias("max_complexity"))


def most_complex(facts: DataFrame, top: int = 10) -> DataFrame:
    return facts.orderBy(F.col("complexity").desc(), "path", "name").limit(top)


def signals(nodes: DataFrame, edges: DataFrame, scores: DataFrame) -> DataFrame:
    """One row: unresolved edges of the six commonest texts and of all, outside modules, files that change without tests."""
    top = ambiguous_hotspots(edges).agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("unresolved_top"))
    loose = edges.filter(F.col("confidence") == AMBIGUOUS).agg(F.count("*").alias("unresolved"))
    outside = nodes.filter("external and type = 'module'").agg(F.count("*").alias("external_modules"))
    changing = scores.filter("not tested and commits_in_window > 0").agg(F.count("*").alias("untested_changing"))
    return top.crossJoin(loose).crossJoin(outside).crossJoin(changing)  # one row each


def risk(nodes: DataFrame, history: DataFrame, pairs: DataFrame, complexity: DataFrame | None = None, sets: DataFrame | None = None) -> DataFrame:
    """(path, score, commits_in_window, untracked, tested, tests, max_complexity) of each source file.

    ``pairs`` is (test, path), or with ``sets`` (of, tests, names) it is (path, of);
    the lists, or the texts made of them, are then joined last, so that they are
    not shuffled with the files.
    """
    files = nodes.filter("type = 'file' and path is not null").filter(~paths.is_test(F.col("path"))).select("path").distinct()
    tests = pairs.select("path", "of") if sets is not None else pairs.groupBy("path").agg(F.sort_array(F.collect_set("test")).alias("tests"))
    of = F.col("of" if sets is not None else "tests")
    rows = files.join(history, "path", "left").join(tests, "path", "left")
    rows = rows.join(complexity.select("path", "max_complexity"), "path", "left") if complexity is not None else rows.withColumn("max_complexity", F.lit(None).cast("int"))
    recent = F.coalesce("commits_in_window", F.lit(0))
    measured = F.coalesce("max_complexity", F.lit(0))
    score = (
        F.round(F.least(recent, F.lit(CHURN_MOST)) / CHURN_MOST * CHURN_WEIGHT)
        + F.when(of.isNull(), NO_TEST_WEIGHT).otherwise(0)
        + F.when(measured > 0, F.round(F.least(measured, F.lit(COMPLEXITY_MOST)) / COMPLEXITY_MOST * COMPLEXITY_WEIGHT)).otherwise(0)
    )
    rows = rows.select("path", score.cast("long").alias("score"), recent.alias("commits_in_window"), F.col("commits_total").isNull().alias("untracked"), of.isNotNull().alias("tested"), of, measured.alias("max_complexity"))
    rows = coverage.with_tests(rows, sets, pairs, "left") if sets is not None else rows
    none = F.lit("") if dict(rows.dtypes)["tests"] == "string" else F.array().cast("array<string>")
    return rows.select("path", "score", "commits_in_window", "untracked", "tested", F.coalesce("tests", none).alias("tests"), "max_complexity")


def riskiest(scores: DataFrame, top: int = 10) -> DataFrame:
    return scores.orderBy(F.col("score").desc(), "path").limit(top)


def incremental_diff(before: DataFrame, now: DataFrame) -> DataFrame:
    """(path, change) of two states (path, content_hash): added, changed, removed or unchanged."""
    both = before.select("path", F.col("content_hash").alias("old")).join(now.select("path", F.col("content_hash").alias("new")), "path", "full_outer")
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") == F.col("new"), "unchanged").otherwise("changed")
    return both.select("path", change.alias("change"))


def reverse_dependents(edges: DataFrame, changes: DataFrame) -> DataFrame:
    """Unchanged files that import a changed or removed one: they must be read again."""
    dirty = changes.filter("change in ('changed', 'removed')").select(F.concat(F.lit("f:"), F.col("path")).alias("dst"))
    importers = edges.filter("type = 'imports'").join(dirty, "dst", "left_semi").select(F.expr("substring(src, 3)").alias("path")).distinct()
    return importers.join(changes.filter("change = 'unchanged'"), "path", "left_semi")


def enclosing_symbol(nodes: DataFrame, places: DataFrame) -> DataFrame:
    """(path, line, id) of the innermost symbol that spans each (path, line)."""
    spans = nodes.filter("start_line is not null and path is not null").select("path", "id", "start_line", "end_line")
    inside = places.join(spans, (places["path"] == spans["path"]) & (places["line"] >= spans["start_line"]) & (places["line"] <= spans["end_line"]))
    return inside.groupBy(places["path"], places["line"]).agg(F.min_by("id", F.struct(F.col("end_line") - F.col("start_line"), "id")).alias("id"))


def first_match(candidates: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """Of each key's (candidate, ordinal) the first that exists: the pattern of every import and call lookup."""
    return candidates.join(existing, candidates["candidate"] == existing["path"], "left_semi").groupBy(*keys).agg(F.min_by("candidate", "ordinal").alias("target"))


def debounced(changes: DataFrame, key: str, gap: str) -> DataFrame:
    """Sessions of changes of a key that follow within ``gap``: one rebuild each."""
    span = F.session_window("ts", gap)
    found = changes.groupBy(key, span.alias("w")).agg(F.count("*").alias("changes"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    return found.select(key, "first_ts", "last_ts", "changes")


def latest_by(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key: an upsert's result."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_place", place).filter("_place = 1").drop("_place")
