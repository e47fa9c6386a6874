"""Reports, answers and tools over one graph."""

from __future__ import annotations

import json
import math
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions import paths, questions
from graphloom.operators import analysis, coverage, cycles, reach, symbols
from graphloom.schema import AMBIGUOUS


class Engine:
    """One graph with its history; what several answers share is planned once. Only bounded reports are collected."""

    def __init__(self, nodes: DataFrame, edges: DataFrame, commits: DataFrame, as_of: Column, complexity: DataFrame | None = None, files: DataFrame | None = None):
        self.nodes, self.edges, self.commits, self.as_of, self.complexity, self.files = nodes.cache(), edges.cache(), commits, as_of, complexity, files

    @cached_property
    def covered(self) -> DataFrame:
        return coverage.covered_files(self.nodes, self.edges, paths.is_test)

    @cached_property
    def dead(self) -> DataFrame:
        return analysis.dead_code(self.nodes, self.edges)

    @cached_property
    def verdicts(self) -> DataFrame:
        methods = analysis.dead_methods(self.nodes, self.edges, self.dead)
        return analysis.verdicts(self.nodes, self.edges, self.dead.select("id", "tier").unionByName(methods.select("id", "tier")))

    @cached_property
    def history(self) -> DataFrame:
        return analysis.churn(self.commits, self.as_of)

    @cached_property
    def risks(self) -> DataFrame:
        """Scores of the report, with complexity where it was measured."""
        measured = analysis.complexity_by_file(self.complexity) if self.complexity is not None else None
        covered, sets = coverage.coverage_sets(self.nodes, self.edges, paths.is_test)
        return analysis.risk(self.nodes, self.history, covered, measured, sets)

    @cached_property
    def plain_risks(self) -> DataFrame:
        """Scores of answers and tools, which leave complexity out; whether a file has tests needs no pairs."""
        covered = self.covered.select("path", F.lit(None).cast("string").alias("test"))
        return analysis.risk(self.nodes, self.history, covered)

    def report(self, top: int = 10) -> dict:
        """Figures of the repository. Unresolved edges are counted in all and over the six texts with most."""
        count = lambda df, key: {r[key]: r["count"] for r in df.groupBy(key).count().collect()}
        hot = [r.asDict() for r in analysis.ambiguous_hotspots(self.edges).collect()]
        by_kind = self.edges.groupBy("type", "confidence").count().collect()
        rings = {k: cycles.cycle_edges(self.edges, k) for k in ("imports", "calls")}
        members = {k: cycles.components(e) for k, e in rings.items()}
        shown = {k: cycles.representative_cycles(e, members[k]).orderBy(F.desc("size"), "component").limit(top).collect() for k, e in rings.items()}
        by_tier = self.verdicts.filter("tier is not null").join(self.nodes.select("id", "type"), "id").groupBy("type", "tier").count().collect()
        told = {
            "external_modules": [r["name"] for r in self.nodes.filter("type = 'module' and external").orderBy("name").select("name").collect()],
            "cycle_paths": {k: [r.asDict() for r in rows] for k, rows in shown.items()},
            "dead_by_type": {(r["type"], r["tier"]): r["count"] for r in by_tier},
            "untested_and_changing_first": [r["path"] for r in self.risks.filter("not tested and commits_in_window > 0").orderBy(F.desc("score"), "path").limit(top).collect()],
        }
        if self.complexity is not None:
            told["complexity"] = analysis.complexity_totals(self.complexity).first().asDict() | {"top": [r.asDict() for r in analysis.most_complex(self.complexity, top).collect()]}
        if self.files is not None:
            told["parse_errors"] = self.files.filter("has_parse_errors").count()
        return told | {
            "nodes": count(self.nodes, "type"),
            "edges": count(self.edges, "type"),
            "confidence": count(self.edges, "confidence"),
            "resolved_calls": sum(r["count"] for r in by_kind if r["type"] == "calls" and r["confidence"] != AMBIGUOUS),
            "languages": count(self.nodes.filter("type = 'file'"), "language"),
            "dead_code": count(self.dead, "tier"),
            "cycles": {k: m.select("component").distinct().count() for k, m in members.items()},
            "coverage": analysis.coverage_summary(self.nodes, self.covered).first().asDict(),
            "risks": [r.asDict() for r in analysis.riskiest(self.risks, top).collect()],
            "most_imported": [r.asDict() for r in analysis.most_imported(self.edges).collect()],
            "hotspots": hot,
            "unresolved_top": sum(h["n"] for h in hot),
            "unresolved": self.edges.filter(F.col("confidence") == AMBIGUOUS).count(),
            "untested_and_changing": self.risks.filter("not tested and commits_in_window > 0").count(),
        }

    def ask(self, question: str) -> dict:
        """An answer in fields; ``refused`` where the question fits no intent, ``status`` where its target is not one node."""
        asked = questions.parse(question)
        if asked is None:
            return {"refused": True, "supported": sorted({name for _, name, _ in questions.RULES})}
        kind = asked["intent"]
        if "target" in asked:
            hit = symbols.resolve_targets(self.nodes, [asked["target"]]).first()
            if hit["status"] != "found":
                maybe = symbols.candidates(self.nodes, [asked["target"]]).orderBy("id").limit(10).drop("target").collect() if hit["status"] == "multiple" else []
                return asked | {"status": hit["status"], "candidates": [r.asDict() for r in maybe]}
            return asked | (self.blast_radius(hit["id"]) if kind == "blast-radius" else self.is_dead(hit["id"]))
        scope = asked["scope"] or ""
        if kind == "riskiest-file":
            rows = self.riskiest(1, scope)
            return asked | {"file": rows[0] if rows else None}
        rows = analysis.uncovered(self.nodes, self.covered).filter(F.startswith("path", F.lit(scope))).orderBy("path")
        return asked | {"untested": [r["path"] for r in rows.limit(10).collect()], "count": rows.count()}

    def blast_radius(self, node_id: str) -> dict:
        rows = reach.blast_radius(self.nodes, self.edges, node_id).orderBy("depth", F.expr("node collate UNICODE"))
        return {"node": node_id, "dependents": [r.asDict() for r in rows.drop("root").collect()]}

    def is_dead(self, node_id: str) -> dict:
        hit = self.verdicts.filter(F.col("id") == node_id).first()
        if hit is None:
            return {"node": node_id, "found": False, "verdict": "not-found", "dead": False, "tier": None, "inbound": 0}
        return {"node": node_id, "found": True, "verdict": hit["verdict"], "dead": hit["tier"] is not None, "tier": hit["tier"], "inbound": hit["inbound"]}

    def riskiest(self, limit: int, scope: str = "") -> list[dict]:
        top = analysis.riskiest(self.plain_risks.filter(F.startswith("path", F.lit(scope))), limit).drop("tests", "max_complexity")
        rows = top.join(self.history.select("path", "last_modified"), "path", "left")
        return [r.asDict() for r in rows.orderBy(F.desc("score"), "path").collect()]

    #: Name, what it tells, and arguments: type, and whether a call must have it.
    TOOLS = {
        "blast-radius": ("All that depends on a node, by depth: by proven edges, or by name alone.", {"node_id": ("string", True)}),
        "is-dead-code": ("Whether a node is a candidate for removal and how sure that is: dead-candidate, referenced, not-a-candidate or not-found.", {"node_id": ("string", True)}),
        "riskiest-files": ("Files by risk, from recent commits and missing tests, highest first; five unless told.", {"limit": ("number", False)}),
        "whats-not-tested": ("Source files that no test reaches by imports, below a path if told.", {"scope": ("string", False)}),
        "find-symbol": ("Functions, classes and methods of a name in any case, else those whose name holds it.", {"name": ("string", True)}),
    }

    @classmethod
    def schemas(cls) -> list[dict]:
        """What ``tools/list`` tells: name, description and the schema of the arguments."""
        return [
            {"name": name, "description": text, "inputSchema": {"type": "object", "properties": {a: {"type": kind} for a, (kind, _) in args.items()}, "required": [a for a, (_, must) in args.items() if must]}}
            for name, (text, args) in cls.TOOLS.items()
        ]

    def tool(self, name: str, args: dict) -> dict:
        """A tool's answer. Arguments that must be there are texts, not empty; others of a wrong kind count as not told."""
        for wanted, (_, must) in self.TOOLS[name][1].items():
            if must and not (isinstance(args.get(wanted), str) and args[wanted]):
                raise ValueError(f"argument {wanted} must be a text that is not empty")
        if name == "blast-radius":
            if self.nodes.filter(F.col("id") == args["node_id"]).isEmpty():
                raise ValueError(f"no node {args['node_id']}")
            told = self.blast_radius(args["node_id"])
            sure = sum(d["via"] == "resolved" for d in told["dependents"])
            return told | {"confirmed": sure, "by_name_only": len(told["dependents"]) - sure}
        if name == "is-dead-code":
            return self.is_dead(args["node_id"])
        if name == "riskiest-files":
            limit = args.get("limit")
            usable = isinstance(limit, int | float) and not isinstance(limit, bool) and math.isfinite(limit) and limit > 0
            return {"files": self.riskiest(int(limit) if usable else 5), "window_days": analysis.WINDOW_DAYS}
        if name == "whats-not-tested":
            scope = args.get("scope") if isinstance(args.get("scope"), str) else ""
            left = analysis.uncovered(self.nodes, self.covered)
            rows = left.filter(F.startswith("path", F.lit(scope))).orderBy("path").collect()
            sources = analysis.coverage_summary(self.nodes, self.covered).first()
            return {"scope": scope or None, "files": [r["path"] for r in rows], "untested": sources["source_files"] - sources["covered_files"], "source_files": sources["source_files"]}
        own = self.nodes.filter("not external and type in ('function', 'class', 'method')")
        found = symbols.find_symbol(own, args["name"]).join(own.select("id", "exported"), "id").orderBy("id").collect()
        exact = any(r["name"].lower() == args["name"].lower() for r in found)
        return {"query": args["name"], "mode": "exact" if exact else "substring", "count": len(found), "matches": [r.asDict() for r in found]}


def handle(engine: Engine, line: str) -> str | None:
    """The reply to one line of JSON-RPC; None to a notification. A malformed line gets an error and harms no other."""
    fail = lambda number, code, text: json.dumps({"jsonrpc": "2.0", "id": number, "error": {"code": code, "message": text}})
    try:
        message = json.loads(line)
    except ValueError:
        return fail(None, -32700, "not JSON")
    if not isinstance(message, dict) or not isinstance(message.get("method"), str):
        return fail(None, -32600, "not a request")
    number, method, params = message.get("id"), message["method"], message.get("params") or {}
    if "id" not in message:
        return None
    if method == "initialize":
        result = {"protocolVersion": params.get("protocolVersion", "2024-11-05"), "capabilities": {"tools": {}}, "serverInfo": {"name": "graphloom", "version": "0.1"}}
    elif method == "ping":
        result = {}
    elif method == "tools/list":
        result = {"tools": engine.schemas()}
    elif method == "tools/call":
        if params.get("name") not in engine.TOOLS:
            return fail(number, -32602, "no such tool")
        try:
            told = engine.tool(params["name"], params.get("arguments") or {})
        except ValueError as wrong:
            return fail(number, -32602, str(wrong))
        except Exception as broken:  # noqa: BLE001  the server goes on
            return fail(number, -32603, type(broken).__name__)
        result = {"content": [{"type": "text", "text": json.dumps(told, default=str)}]}
    else:
        return fail(number, -32601, "no such method")
    return json.dumps({"jsonrpc": "2.0", "id": number, "result": result})
