"""Reports and answers as text."""

from __future__ import annotations

SURE, UNSURE = "✓", "?"


def blast_flat(result: dict) -> str:
    """One line a dependent, nearest first."""
    lines = [f"dependents of {result['node']}: {len(result['dependents'])}"]
    for d in result["dependents"]:
        lines.append(f"  {SURE if d['via'] == 'resolved' else UNSURE} {d['depth']} {d['node']} ({d['relation']})")
    return "\n".join(lines)


def blast_tree(result: dict) -> str:
    """Dependents below what they were found from; each is shown once, so cycles end. Those without a parent come last."""
    below: dict[str | None, list[dict]] = {}
    for d in result["dependents"]:
        below.setdefault(d["parent"], []).append(d)
    lines, seen = [result["node"]], set()

    def show(node: str, indent: int) -> None:
        for d in below.get(node, ()):
            if d["node"] not in seen:
                seen.add(d["node"])
                lines.append(f"{'  ' * indent}{SURE if d['via'] == 'resolved' else UNSURE} {d['node']}")
                show(d["node"], indent + 1)

    show(result["node"], 1)
    left = [d for d in result["dependents"] if d["node"] not in seen]
    if left:
        lines += ["found by name only:", *(f"  {UNSURE} {d['node']}" for d in left)]
    return "\n".join(lines)


def report(figures: dict) -> str:
    """The figures of ``Engine.report`` as lines."""
    pairs = lambda d: ", ".join(f"{k} {v}" for k, v in sorted(d.items(), key=lambda x: str(x[0]))) or "none"
    c = figures["coverage"]
    lines = [
        f"nodes: {pairs(figures['nodes'])}",
        f"edges: {pairs(figures['edges'])}",
        f"calls resolved: {figures['resolved_calls']}; edges unresolved: {figures['unresolved']} ({figures['unresolved_top']} of them in the six commonest texts)",
        f"languages: {pairs(figures['languages'])}",
        f"dead code: {pairs(figures['dead_code'])}",
        f"cycles: {pairs(figures['cycles'])}",
        f"covered by imports of tests: {c['covered_files']} of {c['source_files']} files ({100 * c['ratio']:.1f} %)",
        f"changing without tests: {figures['untested_and_changing']}",
        *(f"  {p}" for p in figures.get("untested_and_changing_first", ())),
        *(f"{kind} cycle of {c['size']}: {' > '.join(c['path'])}" for kind, found in figures.get("cycle_paths", {}).items() for c in found),
        *([f"functions: {m['functions']} in {m['files']} files, complexity up to {m['max_complexity']}"] if (m := figures.get("complexity")) else []),
        *([f"files with syntax errors: {figures['parse_errors']}"] if "parse_errors" in figures else []),
        "riskiest:",
        *(f"  {r['score']:3d} {r['path']}" for r in figures["risks"]),
    ]
    return "\n".join(lines)


def answer(told: dict) -> str:
    """An answer of ``Engine.ask`` in a sentence or a list."""
    if told.get("refused"):
        return f"That is no question I can answer; I know about: {', '.join(told['supported'])}."
    if told.get("status"):
        first = f"{told['target']} is not one thing here ({told['status']})."
        return "\n".join([first, *(f"  {c['id']}" for c in told.get("candidates", ()))])
    kind = told["intent"]
    if kind == "blast-radius":
        return blast_flat(told)
    if kind == "dead-code-check":
        if told.get("verdict") == "not-a-candidate":
            return f"{told['node']} is no function, class or method, so it is not judged."
        texts = {
            "confirmed-unreferenced": "is dead: nothing refers to it.",
            "referenced-but-uncalled": "is passed around but never called as far as can be proven.",
            "no-resolved-references": "has no proven use, but an unresolved reference has its name.",
        }
        return f"{told['node']} " + texts.get(told["tier"], f"is in use ({told['inbound']} proven references).")
    if kind == "riskiest-file":
        return f"The riskiest file is {told['file']['path']} (score {told['file']['score']})." if told["file"] else "There is no file in that scope."
    more = told["count"] - len(told["untested"])
    return "\n".join([f"{told['count']} files are reached by no test:", *(f"  {p}" for p in told["untested"]), *([f"  and {more} more"] if more > 0 else [])])
