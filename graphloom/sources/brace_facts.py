"""Facts of JavaScript, TypeScript, Go and Rust files from their tokens.

No grammar is needed for these facts: declarations have fixed beginnings,
bodies are brace pairs, and a call is a name before an opening parenthesis.
Decisions count for the innermost function around them.
"""

from __future__ import annotations

from graphloom.sources.python_facts import EMPTY, FILE
from graphloom.sources.tokens import Token, partners, tokens

_JS = frozenset("if for while switch catch function return typeof await void delete in of do else with yield case throw new instanceof export import super".split())
_KEYWORDS = {"go": frozenset("if for switch return else case func go defer select range type map chan struct interface".split()), "rust": frozenset("if for while match loop return else in fn impl where as let mut ref move unsafe dyn pub".split())}
_WORDS = _JS | _KEYWORDS["go"] | _KEYWORDS["rust"] | frozenset("const let var class extends default from async static this self Self null undefined true false nil try finally break continue package type struct interface map chan pub use mod trait enum crate public private protected readonly abstract override declare get set implements namespace keyof infer is satisfies unknown any never string number boolean object symbol bigint".split())
_MODIFIERS = frozenset("static async get set public private protected readonly abstract override declare accessor *".split())


class Source:
    """Tokens of one file, and what the readers share."""

    def __init__(self, text: str, language: str):
        self.t, self.language = tokens(text, language), language
        self.pair = partners(self.t)
        self.facts = {k: [] for k in EMPTY}
        self.inside: list[tuple[int, int, str]] = []  # bodies with their container
        self.bodies: list[tuple[int, int, str]] = []  # bodies with the function's name, for complexity
        self.bound: set[int] = set()  # places of declared names
        self.skip: list[tuple[int, int]] = []  # imports and the like

    def at(self, i: int) -> Token:
        return self.t[i] if 0 <= i < len(self.t) else Token("mark", "", self.t[-1].line if self.t else 1)

    def text(self, i: int) -> str:
        return self.at(i).text if self.at(i).kind != "string" else ""

    def after(self, i: int) -> int:
        return self.pair.get(i, len(self.t) - 1)

    def body(self, i: int, stop: tuple[str, ...] = (";",)) -> int | None:
        """The next brace that opens a body from place i on, over parentheses and brackets."""
        while i < len(self.t):
            x = self.text(i)
            if x == "{":
                return i
            if x in stop or x in ("}", ")"):
                return None
            i = self.after(i) + 1 if x in ("(", "[") else i + 1
        return None

    def symbol(self, i: int, start: int, end: int, **more) -> dict:
        self.bound.add(i)
        return {"name": self.text(i), "start_line": self.at(start).line, "end_line": self.at(end).line} | more

    def function(self, name: int, start: int, body: int | None, container: str, exported: bool) -> int:
        end = self.after(body) if body is not None else name
        self.facts["functions"].append(self.symbol(name, start, end, exported=exported))
        if body is not None:
            self.inside.append((body, end, container))
            self.bodies.append((body, end, self.text(name)))
        return end

    def chain(self, i: int) -> tuple[str | None, bool]:
        """(object text before the dot at i, whether it is whole): names joined by dots or colons."""
        parts: list[str] = []
        while self.text(i) in (".", "?.", "::"):
            if self.at(i - 1).kind != "name":
                return None, False
            parts.append(self.text(i - 1))
            joint, i = self.text(i), i - 2
            if self.text(i) in (".", "?.", "::"):
                parts.append("::" if self.text(i) == "::" else ".")
            del joint
        return "".join(reversed(parts)), True

    def collect(self, receiver: dict[int, str] | None = None) -> dict:
        """Calls of all bodies, references and complexity, then the record."""
        t, rust = self.t, self.language == "rust"
        keywords = _KEYWORDS.get(self.language, _JS)
        called: set[int] = set()
        for low, high, container in self.inside:
            own = (receiver or {}).get(low)
            for i in range(low + 1, high):
                if t[i].kind != "name" or i in self.bound:
                    continue
                j = i + 1
                if self.text(j) == "::" and rust and self.text(j + 1) == "<":  # turbofish
                    while j < high and self.text(j) != ">":
                        j += 1
                    j += 1
                if self.text(j) != "(" or t[i].text in keywords and self.text(i - 1) not in (".", "?.", "::"):
                    continue
                if self.language not in ("rust", "go") and self.text(self.after(j) + 1) == "{" and self.text(i - 1) in ("{", "}", ",", ";", "async", "get", "set", "*"):
                    continue  # a method of an object literal
                called.add(i)
                before = self.text(i - 1)
                if before not in (".", "?.", "::"):
                    site = ("plain", None)
                else:
                    owner, whole = self.chain(i - 1)
                    if not whole:
                        site = ("member", None)
                    elif owner in ("this", "self", "Self") or own and owner == own:
                        site = ("this" if owner == "this" else "self", owner)
                    elif owner == "super":
                        site = ("super", None)
                    else:
                        site = ("member", owner)
                self.facts["calls"].append({"kind": site[0], "object": site[1], "name": t[i].text, "line": t[i].line, "container": container})
        hidden = [False] * len(t)
        for low, high in self.skip:
            hidden[low : high + 1] = [True] * (high + 1 - low)
        for i, x in enumerate(t):
            if x.kind == "name" and not hidden[i] and i not in called and i not in self.bound and x.text not in _WORDS and self.text(i - 1) not in (".", "?.", "::", "const", "let", "var", "fn", "func", "class", "function") and self.text(i + 1) not in (":", "=>", ":=", "!", "("):
                self.facts["references"].append({"name": x.text, "line": x.line, "container": FILE})
        self.facts["calls"].sort(key=lambda c: c["line"])
        return self._complexity()

    def _complexity(self) -> dict:
        spans = sorted({(low, high): name for low, high, name in self.bodies}.items(), key=lambda s: s[0][1] - s[0][0])
        total = {span: 1 for span, _ in spans}
        count = {"if", "for", "while", "catch", "case", "&&", "||", "loop"} if self.language != "rust" else {"if", "for", "while", "loop", "&&", "||", "=>"}
        for i, x in enumerate(self.t):
            ternary = x.text == "?" and self.language not in ("rust", "go") and self.text(i + 1) not in (":", ")", ",", ".")
            if x.kind != "string" and (x.text in count or ternary) and not (x.text == "=>" and self.text(i - 1) == "_"):
                if x.text in ("||", "&&") and self.language == "rust" and self.text(i - 1) in ("(", ",", "=", "{", "&"):
                    continue  # a closure without parameters, or a reference twice
                span = next((s for s, _ in spans if s[0] < i < s[1]), None)
                if span:
                    total[span] += 1
        for span, name in spans:
            self.facts["complexity"].append({"name": name, "start_line": self.at(span[0]).line, "end_line": self.at(span[1]).line, "complexity": total[span]})
        return self.facts | {"has_parse_errors": False}


def _import(specifier: str, line: int, default: str | None = None, namespace: str | None = None, named: list[str] | None = None) -> dict:
    return {"specifier": specifier, "default_import": default, "namespace_import": namespace, "named_imports": named or [], "line": line}


def _listed(s: Source, low: int, high: int) -> list[str]:
    """Names of a clause in braces, each by its alias."""
    names, i = [], low + 1
    while i < high:
        if s.at(i).kind == "name":
            if s.text(i) == "type" and s.at(i + 1).kind == "name" and s.text(i + 1) != "as":
                i += 1
            if s.text(i + 1) in ("as", ":"):
                i += 2
            names.append(s.text(i))
        i += 1
    return names


def javascript(text: str, language: str) -> dict:
    s = Source(text, language)
    i, n = 0, len(s.t)
    while i < n:
        start, exported, default = i, False, False
        if s.text(i) == "import" and s.text(i + 1) not in ("(", "."):
            i = _js_import(s, i)
            continue
        if s.text(i) == "export":
            exported, i = True, i + 1
            if s.text(i) == "type" and s.text(i + 1) in ("{", "*"):
                i += 1
            if s.text(i) == "default":
                default, i = True, i + 1
            elif s.text(i) in ("{", "*"):
                i = _js_export_list(s, start, i)
                continue
        while s.text(i) in ("async", "declare", "abstract") and s.at(i + 1).kind == "name":
            i += 1
        word = s.text(i)
        if word == "function":
            name = i + 1 + (s.text(i + 1) == "*")
            body = s.body(name)
            if s.at(name).kind == "name":
                i = s.function(name, start, body, s.text(name), exported) + 1
            else:
                i = (s.after(body) if body is not None else name) + 1
            _js_exported(s, start, exported, default, s.text(name) if s.at(name).kind == "name" else "default")
        elif word == "class":
            i = _js_class(s, i, start, exported) + 1
            _js_exported(s, start, exported, default, s.facts["classes"][-1]["name"])
        elif word in ("const", "let", "var") and s.at(i + 1).kind == "name" and s.text(i + 1) != "enum":
            i = _js_variable(s, i, start, exported) + 1
        elif exported and word in ("interface", "type", "enum", "namespace", "const"):
            name = i + 1 + (word == "const")
            s.facts["exports"].append({"kind": "named", "names": [s.text(name)], "line": s.at(start).line})
            body = s.body(name)
            i = (s.after(body) if body is not None else name) + 1
        else:
            if default:
                s.facts["exports"].append({"kind": "default", "names": ["default"], "line": s.at(start).line})
            if word == "require" and s.text(i + 1) == "(" and s.at(i + 2).kind == "string":
                s.facts["imports"].append(_import(s.at(i + 2).text, s.at(i).line))
            i = s.after(i) + 1 if i in s.pair else i + 1
    _nested(s)
    return s.collect()


def _js_exported(s: Source, start: int, exported: bool, default: bool, name: str) -> None:
    if exported:
        s.facts["exports"].append({"kind": "default" if default else "named", "names": [name], "line": s.at(start).line})


def _js_import(s: Source, i: int) -> int:
    start, default, namespace, named = i, None, None, []
    i += 1
    if s.text(i) == "type" and s.text(i + 1) != "from":
        i += 1
    while i < len(s.t) and s.at(i).kind != "string" and s.text(i) != ";":
        if s.text(i) == "{":
            named, i = _listed(s, i, s.after(i)), s.after(i)
        elif s.text(i) == "*":
            namespace, i = s.text(i + 2), i + 2
        elif s.at(i).kind == "name" and s.text(i) != "from":
            default = s.text(i)
        i += 1
    if s.at(i).kind == "string":
        s.facts["imports"].append(_import(s.at(i).text, s.at(start).line, default, namespace, named))
    s.skip.append((start, i))
    return i + 1


def _js_export_list(s: Source, start: int, i: int) -> int:
    if s.text(i) == "*":
        names = [s.text(i + 2)] if s.text(i + 1) == "as" else []
        kind, end = "all", i
    else:
        names, kind, end = _listed(s, i, s.after(i)), "named", s.after(i)
    s.facts["exports"].append({"kind": kind, "names": names, "line": s.at(start).line})
    while end + 1 < len(s.t) and (s.text(end + 1) in ("from", "as", "*") or s.text(end) == "as"):
        end += 1
    end += s.at(end + 1).kind == "string" and s.text(end) == "from"
    s.skip.append((start, end))
    return end + 1


def _js_function_value(s: Source, i: int) -> int | None | bool:
    """The body's place if a function value begins at i; None if it has no braces; False if there is none."""
    i += s.text(i) == "async"
    if s.text(i) == "function":
        return s.body(i)
    j = s.after(i) + 1 if s.text(i) == "(" else i + 1 if s.at(i).kind == "name" else -1
    if j > 0 and s.text(j) == ":" and s.text(i) == "(":  # a return type
        while j < len(s.t) and s.text(j) not in ("=>", ";", "}"):
            j = s.after(j) + 1 if s.text(j) in ("(", "[", "{") else j + 1
    if j > 0 and s.text(j) == "=>":
        return j + 1 if s.text(j + 1) == "{" else None
    return False


def _js_variable(s: Source, i: int, start: int, exported: bool) -> int:
    name = i + 1
    s.bound.add(name)
    j = name + 1
    while j < len(s.t) and s.text(j) not in ("=", ";", ",") and s.at(j).line <= s.at(name).line + 1:
        j = s.after(j) + 1 if s.text(j) in ("(", "[", "{") else j + 1
    if exported:
        s.facts["exports"].append({"kind": "named", "names": [s.text(name)], "line": s.at(start).line})
    if s.text(j) != "=":
        return name
    value = _js_function_value(s, j + 1)
    if value is not False:
        if value is not None:
            return s.function(name, start, value, s.text(name), exported)
        end = j + 1  # an expression for a body: up to the statement's end
        while end + 1 < len(s.t) and s.text(end + 1) != ";" and not (s.at(end + 1).line > s.at(end).line and s.text(end) not in ("=>", "(", ",", ".", "?", ":", "+", "&&", "||") and s.text(end + 1) not in (".", "?", ":", "+", "&&", "||")):
            end = s.after(end + 1) if s.text(end + 1) in ("(", "[", "{") else end + 1
        s.facts["functions"].append(s.symbol(name, start, end, exported=exported))
        s.inside.append((j, end + 1, s.text(name)))
        s.bodies.append((j, end + 1, s.text(name)))
        return end
    if s.text(j + 1) == "require" and s.at(j + 3).kind == "string":
        s.facts["imports"].append(_import(s.at(j + 3).text, s.at(start).line, default=s.text(name)))
        s.skip.append((start, j + 4))
        return j + 4
    return j


def _js_class(s: Source, i: int, start: int, exported: bool) -> int:
    named = s.at(i + 1).kind == "name" and s.text(i + 1) not in ("extends", "implements")
    name = s.text(i + 1) if named else "<anonymous>"
    if named:
        s.bound.add(i + 1)
    body, bases, j = None, [], i + 1
    while j < len(s.t):
        x = s.text(j)
        if x == "extends":
            k, parts = j + 1, []
            while s.at(k).kind == "name" or s.text(k) == ".":
                parts.append(s.text(k))
                k += 1
            bases = ["".join(parts)] if parts else []
            j = k
            continue
        if x == "{":
            body = j
            break
        j += 1
    if body is None:
        return i
    end, methods, j = s.after(body), [], body + 1
    while j < end:
        first = j
        while s.text(j) in _MODIFIERS and s.text(j + 1) not in ("(", "=", ";"):
            j += 1
        if s.at(j).kind == "name":
            member, k = j, j + 1
            if s.text(k) == "<":
                while k < end and s.text(k) != "(":
                    k += 1
            if s.text(k) == "(":
                close = s.after(k)
                inner = s.body(close + 1, (";",)) if s.text(close + 1) in ("{", ":") else None
                last = s.after(inner) if inner is not None else close
                constructor = s.text(member) == "constructor"
                if not constructor:
                    methods.append(s.symbol(member, first, last))
                s.bound.add(member)
                if inner is not None:
                    s.inside.append((inner, last, name if constructor else f"{name}.{s.text(member)}"))
                    s.bodies.append((inner, last, s.text(member)))
                j = last + 1
                continue
            while k < end and s.text(k) not in ("=", ";", "}") and s.at(k).line == s.at(member).line:
                k = s.after(k) + 1 if s.text(k) in ("(", "[", "{") else k + 1
            value = _js_function_value(s, k + 1) if s.text(k) == "=" else False
            if value:
                last = s.after(value)
                methods.append(s.symbol(member, first, last))
                s.inside.append((value, last, f"{name}.{s.text(member)}"))
                s.bodies.append((value, last, s.text(member)))
                j = last + 1
                continue
            s.bound.add(member)
            j = k
        j = s.after(j) + 1 if j in s.pair else j + 1
    s.facts["classes"].append({"name": name, "start_line": s.at(start).line, "end_line": s.at(end).line, "exported": exported, "methods": methods, "extends": bases})
    return end


def _nested(s: Source) -> None:
    """Functions inside others, for complexity: by name, or by line."""
    known = {low for low, _, _ in s.bodies}
    for i, x in enumerate(s.t):
        if x.kind != "name" and x.text == "=>" and s.text(i + 1) == "{" and i + 1 not in known:
            s.bodies.append((i + 1, s.after(i + 1), f"@{x.line}"))
        elif x.text == "function" and x.kind == "name":
            body = s.body(i)
            if body is not None and body not in known:
                name = s.text(i + 1) if s.at(i + 1).kind == "name" else f"@{x.line}"
                s.bodies.append((body, s.after(body), name))


def go(text: str, language: str = "go") -> dict:
    s = Source(text, "go")
    i, n, receiver, owners = 0, len(s.t), {}, []
    while i < n:
        word = s.text(i)
        if word == "import":
            low, high = (i + 1, s.after(i + 1)) if s.text(i + 1) == "(" else (i, i + 3)
            for k in range(low, min(high + 1, n)):
                if s.at(k).kind == "string":
                    alias = s.text(k - 1) if s.at(k).line == s.at(k - 1).line and (s.at(k - 1).kind == "name" and s.text(k - 1) != "import" or s.text(k - 1) in (".", "_")) else s.at(k).text.rsplit("/", 1)[-1]
                    s.facts["imports"].append(_import(s.at(k).text, s.at(k).line, default=None if alias in ("_", ".") else alias))
                    if s.text(i + 1) != "(":
                        high = k
                        break
            s.skip.append((i, high))
            i = high + 1
        elif word == "func":
            name, method = i + 1, None
            if s.text(name) == "(":
                close = s.after(name)
                names = [s.text(k) for k in range(name + 1, close) if s.at(k).kind == "name"]
                method, name = names, close + 1
            body = s.body(name)
            end = s.after(body) if body is not None else name
            if method is None:
                i = s.function(name, i, body, s.text(name), s.text(name)[:1].isupper()) + 1
            else:
                owners.append((method[-1] if len(method) < 3 else method[1], name, i, body, end, method[0] if len(method) > 1 else None))
                i = end + 1
        elif word == "type":
            low, high = (i + 2, s.after(i + 1)) if s.text(i + 1) == "(" else (i + 1, i + 2)
            k = low
            while k < high or k == low:
                if s.at(k).kind == "name" and s.text(k + 1) in ("struct", "interface"):
                    body = s.body(k + 1)
                    close = s.after(body) if body is not None else k
                    bases, j = [], (body or k) + 1
                    while j < close:
                        first, parts = j, []
                        while j < close and s.at(j).line == s.at(first).line:
                            if s.text(j) == ";":
                                break
                            parts.append(s.text(j) if s.at(j).kind != "string" else "")
                            j = s.after(j) + 1 if s.text(j) in ("(", "{", "[") else j + 1
                        whole = "".join(parts).lstrip("*")
                        if whole and "(" not in whole and len([p for p in parts if p not in ("*", ".", "")]) == (2 if "." in parts else 1):
                            bases.append(whole)
                        j = max(j, first + 1)
                    s.facts["classes"].append(s.symbol(k, i, close, exported=s.text(k)[:1].isupper(), methods=[], extends=bases))
                    k = close
                k += 1
            i = max(k, high)
        else:
            i = s.after(i) + 1 if i in s.pair else i + 1
    classes = {c["name"]: c for c in s.facts["classes"]}
    for owner, name, start, body, end, own in owners:
        if owner in classes:
            classes[owner]["methods"].append(s.symbol(name, start, end))
            if body is not None:
                s.inside.append((body, end, f"{owner}.{s.text(name)}"))
                s.bodies.append((body, end, s.text(name)))
                if own:
                    receiver[body] = own
    return s.collect(receiver)


def rust(text: str, language: str = "rust") -> dict:
    s = Source(text, "rust")
    i, n, impls = 0, len(s.t), []
    while i < n:
        start, public = i, False
        if s.text(i) == "#" and s.text(i + 1) in ("[", "!"):
            i = s.after(i + 1 + (s.text(i + 1) == "!")) + 1
            continue
        if s.text(i) == "pub":
            public, i = True, i + 1
            if s.text(i) == "(":
                i = s.after(i) + 1
        while s.text(i) in ("async", "unsafe", "const", "extern", "default") and (s.text(i + 1) in ("fn", "async", "unsafe", "impl", "trait") or s.at(i + 1).kind == "string"):
            i += 1 + (s.at(i + 1).kind == "string")
        word = s.text(i)
        if word == "fn":
            i = s.function(i + 1, start, s.body(i + 1), s.text(i + 1), public) + 1
        elif word in ("struct", "enum", "trait", "union") and s.at(i + 1).kind == "name" or word == "type" and s.at(i + 1).kind == "name":
            body = s.body(i + 2) if word != "type" else None
            end = s.after(body) if body is not None else i + 1
            methods = []
            if word == "trait" and body is not None:
                for k in range(body + 1, end):
                    if s.text(k) == "fn" and s.at(k + 1).kind == "name":
                        methods.append(s.symbol(k + 1, k, k + 1))
            s.facts["classes"].append(s.symbol(i + 1, start, end, exported=public, methods=methods, extends=[]))
            i = end + 1
        elif word == "use":
            end = i
            while end < n and s.text(end) != ";":
                end += 1
            _rust_use(s, i + 1, end)
            s.skip.append((i, end))
            i = end + 1
        elif word == "impl":
            body = s.body(i + 1)
            if body is None:
                i += 1
                continue
            impls.append((i + 1, body))
            i = s.after(body) + 1
        else:
            i = s.after(i) + 1 if i in s.pair and word != "{" or word == "{" else i + 1
    classes = {c["name"]: c for c in s.facts["classes"]}
    for low, body in impls:
        names, depth = [], 0
        for k in range(low, body):
            depth += (s.text(k) == "<") - (s.text(k) == ">")
            if depth == 0 and (s.at(k).kind == "name" or s.text(k) == "for"):
                if s.text(k) == "where":
                    break
                names.append(s.text(k))
        traits, owner = (names[: names.index("for")], names[-1]) if "for" in names else ([], names[-1] if names else "")
        if owner not in classes:
            continue
        if traits and traits[-1] not in classes[owner]["extends"]:
            classes[owner]["extends"].append(traits[-1])
        k = body + 1
        while k < s.after(body):
            if s.text(k) == "fn" and s.at(k + 1).kind == "name":
                inner = s.body(k + 1)
                end = s.after(inner) if inner is not None else k + 1
                classes[owner]["methods"].append(s.symbol(k + 1, k, end))
                if inner is not None:
                    s.inside.append((inner, end, f"{owner}.{s.text(k + 1)}"))
                    s.bodies.append((inner, end, s.text(k + 1)))
                k = end
            k += 1
    return s.collect()


def _rust_use(s: Source, low: int, high: int) -> None:
    path = []
    for k in range(low, high):
        if s.text(k) == "{":
            parent = "::".join(p for p in path if p)
            s.facts["imports"].append(_import(parent, s.at(low).line, named=_listed(s, k, s.after(k))))
            return
        if s.text(k) in ("as", "*"):
            return  # neither an alias nor a glob of a plain path binds anything
        if s.at(k).kind == "name":
            path.append(s.text(k))
    if path:
        s.facts["imports"].append(_import("::".join(path), s.at(low).line, named=[path[-1]]))


def reader(language: str):
    read = {"go": go, "rust": rust}.get(language, javascript)

    def run(content: bytes | None) -> dict:
        try:
            return read((content or b"").decode("utf-8", "replace"), language)
        except (IndexError, RecursionError):
            return EMPTY | {"has_parse_errors": True}

    return run
