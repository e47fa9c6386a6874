"""Facts of brace languages, on sources of our own."""

from graphloom.sources import brace_facts as B
from graphloom.sources.tokens import tokens

JS = r'''
import def, { one as uno, two } from "./lib.js";
import * as ns from "pkg";
const fs = require("fs");
// call() in a comment
export function outer(a, b) {
  const s = `text ${inner(a)} call()`;
  const rx = /call\(\)/g;
  if (a && b) { helper(s); }
  return a ? ns.go() : new Thing(rx);
}
const arrow = async (x) => { await two(x); };
export default class Kid extends ns.Base {
  constructor() { super(); setup(); }
  get size() { return this.count(); }
  run = () => { super.stop(); };
}
export { arrow as shaft };
export * from "./more.js";
pass(arrow);
'''


def names(rows):
    return [r["name"] for r in rows]


def test_javascript():
    f = B.javascript(JS, "javascript")
    assert names(f["functions"]) == ["outer", "arrow"] and f["functions"][0]["exported"] and not f["functions"][1]["exported"]
    (c,) = f["classes"]
    assert (c["name"], c["extends"], names(c["methods"])) == ("Kid", ["ns.Base"], ["size", "run"])
    imports = {i["specifier"]: (i["default_import"], i["namespace_import"], i["named_imports"]) for i in f["imports"]}
    assert imports == {"./lib.js": ("def", None, ["uno", "two"]), "pkg": (None, "ns", []), "fs": ("fs", None, [])}
    calls = {(x["kind"], x["object"], x["name"], x["container"]) for x in f["calls"]}
    assert {("plain", None, "inner", "outer"), ("plain", None, "helper", "outer"), ("member", "ns", "go", "outer"), ("plain", None, "Thing", "outer"), ("plain", None, "two", "arrow")} <= calls
    assert {("this", "this", "count", "Kid.size"), ("super", None, "stop", "Kid.run"), ("plain", None, "setup", "Kid")} <= calls
    assert "call" not in {x[2] for x in calls}
    assert {(e["kind"], tuple(e["names"])) for e in f["exports"]} == {("named", ("outer",)), ("default", ("Kid",)), ("named", ("shaft",)), ("all", ())}
    assert {c["name"]: c["complexity"] for c in f["complexity"]}["outer"] == 4
    assert "arrow" in names(f["references"])


def test_typescript():
    f = B.javascript("export interface A { x: number }\nexport const f = (a: string): number => { return g(a); };\nexport abstract class B<T> extends C { abstract m(): void; private n(x?: string): void { this.m(); } }\n", "typescript")
    assert names(f["functions"]) == ["f"]
    assert names(f["classes"][0]["methods"]) == ["m", "n"] and f["classes"][0]["extends"] == ["C"]
    assert ["A"] in [e["names"] for e in f["exports"]]
    assert ("this", "m") in {(c["kind"], c["name"]) for c in f["calls"]}


def test_go():
    f = B.go('package a\nimport (\n  "fmt"\n  u "m/util"\n)\ntype Base struct { id int }\ntype Kid struct {\n  Base\n  *u.Other\n  name string\n}\nfunc (k *Kid) Run(n int) error {\n  if n > 0 && n < 9 { k.stop() }\n  fmt.Println(`raw call()`)\n  return nil\n}\nfunc (x Gone) Lost() { y() }\nfunc helper() { u.Do() }\n')
    assert [(i["specifier"], i["default_import"]) for i in f["imports"]] == [("fmt", "fmt"), ("m/util", "u")]
    kid = next(c for c in f["classes"] if c["name"] == "Kid")
    assert kid["extends"] == ["Base", "u.Other"] and names(kid["methods"]) == ["Run"]
    assert {(c["kind"], c["object"], c["name"], c["container"]) for c in f["calls"]} == {("self", "k", "stop", "Kid.Run"), ("member", "fmt", "Println", "Kid.Run"), ("member", "u", "Do", "helper")}
    assert {c["name"]: c["complexity"] for c in f["complexity"]} == {"Run": 3, "helper": 1}


def test_rust():
    f = B.rust('use crate::util::go;\nuse std::{fs, io as sys};\nuse a::b as c;\npub struct S<\'a> { x: &\'a str }\npub trait T { fn t(&self); }\nimpl<\'a> T for S<\'a> {\n  fn t(&self) { self.u(); println!("x {}", call()); }\n}\nimpl S<\'_> { pub fn u(&self) -> i32 { match 1 { 1 => go(), _ => util::two() } } }\n/* a /* nested */ call() */\nfn main() { let s = r#"call()"#; S::make(s); }\n')
    assert [(i["specifier"], i["named_imports"]) for i in f["imports"]] == [("crate::util::go", ["go"]), ("std", ["fs", "sys"])]
    s = next(c for c in f["classes"] if c["name"] == "S")
    assert s["extends"] == ["T"] and names(s["methods"]) == ["t", "u"]
    calls = {(c["kind"], c["object"], c["name"], c["container"]) for c in f["calls"]}
    assert {("self", "self", "u", "S.t"), ("plain", None, "go", "S.u"), ("member", "util", "two", "S.u"), ("member", "S", "make", "main")} <= calls
    assert {c["name"]: c["complexity"] for c in f["complexity"]}["u"] == 2


def test_any_text_gives_a_record():
    for text in ("", "}{", "`${", "/*", "'", 'r#"', "class", "export", "import", "func (", "impl", "use {", "(" * 50, "const x =", "type ("):
        for language in ("javascript", "typescript", "tsx", "go", "rust"):
            assert set(B.reader(language)(text.encode())) >= {"functions", "has_parse_errors"}
            tokens(text, language)
