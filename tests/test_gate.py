"""The static gate on snippets of our own, allowed and not."""

import json

import pytest

from graphloom.operators import guard
from graphloom.sources import resources, snippet_facts

GOOD = "import { add as plus } from './lib/math.js';\nimport pad from 'left-pad';\nconst fs = require('node:fs');\nfunction go(list, { deep, other: inner }) {\n  const [a, b] = list;\n  return list.map((x) => plus(x, a) + JSON.stringify({ key: deep, inner })).filter(y => y > b);\n}\ntry { go([1, 2], {}); } catch (e) { console.log(e.message, process.env.HOME, granted()); }\nfetch('https://api.example/v1');\n"


@pytest.fixture(scope="module")
def allowed(spark):
    grants = resources.load(spark, json.dumps({"scopes": {"s": {"network": [{"host": "api.example"}], "environment": [{"name": "HOME", "access": "read"}]}}}))
    files = spark.createDataFrame([("src/lib/math.ts",), ("lib/math.js",)], "path string")
    symbols = spark.createDataFrame([("granted", None), ("pad", "left-pad")], "name string, module string")
    return files, symbols, grants, spark.createDataFrame([("filesystem",)], "category string")


def test_what_is_granted_passes(spark, allowed):
    assert guard.static_gate(spark, GOOD, *allowed).collect() == []


@pytest.mark.parametrize("code, kind", [
    ("import x from '../up.js';", "unverifiable-import"), ("require(name);\nvar name = 1;", "unverifiable-import"), ("import h from 'http';", "ungranted-resource"), ("import o from 'os';", "disallowed-import"),
    ("import c from 'chalk';", "disallowed-import"), ("import m from './other.js';", "disallowed-import"), ("process.env.HOME = 1;", "ungranted-resource"), ("process.env['PATH'];", "ungranted-resource"),
    ("process.env[k()];\nfunction k() {}", "ungranted-resource"), ("fetch('http://evil.example');", "ungranted-resource"), ("fetch(`https://${1}`);", "ungranted-resource"), ("secret();", "unknown-reference"),
    ("const f = () => eval;", "unknown-reference"), ("function (", "parse-failure"), ("a = [1, 2);", "parse-failure"),
])
def test_what_is_not_is_named(spark, allowed, code, kind):
    assert kind in {r["kind"] for r in guard.static_gate(spark, code, *allowed).collect()}


def test_scan_dedupes_names_by_line():
    assert snippet_facts.scan("a(a, a);\na;")["names"] == [{"name": "a", "line": 1}, {"name": "a", "line": 2}]
