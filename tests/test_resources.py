"""Grants and texts."""

import json

import pytest

from graphloom.plans import render
from graphloom.sources import resources


def config(**areas):
    return json.dumps({"scopes": {"f:a.js": areas}})


def test_grants_cover_what_they_say(spark):
    text = config(network=[{"host": "api.example", "protocols": ["https", "https"]}, {"host": "local", "port": 8080}], environment=[{"name": "HOME", "access": "read"}], filesystem=[{"path": "/tmp", "access": ["write", "read"]}])
    grants = resources.load(spark, text)
    assert {tuple(r["access"]) for r in grants.filter("area = 'filesystem'").collect()} == {("read", "write")}
    urls = spark.createDataFrame([("https://api.example/x", 1), ("http://api.example/x", 2), ("http://local:8080", 3), ("http://local", 4), ("no url", 5)], "url string, line int")
    assert {r["line"] for r in resources.ungranted_urls(urls, grants).collect()} == {2, 4, 5}
    env = spark.createDataFrame([("HOME", "read", 1), ("HOME", "write", 2), ("PATH", "read", 3)], "name string, mode string, line int")
    assert {r["line"] for r in resources.ungranted_env(env, grants).collect()} == {2, 3}
    given = resources.load(spark, config(categoryLevel=[{"category": "network", "viaModule": "http"}]))
    derived = spark.createDataFrame([("f:a.js", "network", "http"), ("f:a.js", "filesystem", "fs")], "scope string, category string, module string")
    assert {(r["module"], r["origin"]) for r in resources.merged(given, derived).collect()} == {("http", "config"), ("fs", "graph-import")}


def test_grants_come_in_one_of_two_ways(spark):
    inline, text = {"environment": [{"name": "HOME", "access": "read"}]}, config(network=[{"host": "h"}])
    assert [r["area"] for r in resources.given(spark, "f:a.js", inline=inline).collect()] == ["environment"]
    assert [r["host"] for r in resources.given(spark, "f:a.js", config=text).collect()] == ["h"]
    assert resources.given(spark, "f:other.js", config=text).isEmpty() and resources.given(spark, "f:a.js").isEmpty()
    with pytest.raises(ValueError):
        resources.given(spark, "f:a.js", inline=inline, config=text)


@pytest.mark.parametrize("areas", [
    {"disk": []}, {"network": [{"host": ""}]}, {"network": [{"host": "a", "port": 0}]}, {"network": [{"host": "a", "port": True}]}, {"subprocess": [{"commands": []}]},
    {"environment": [{"name": "A", "access": "own"}]}, {"filesystem": [{"path": "a", "access": []}]}, {"filesystem": {"path": "a"}}, {"network": [{"host": "a", "extra": 1}]},
])
def test_wrong_grants_are_refused(areas):
    with pytest.raises(ValueError):
        resources.validate(areas)


def test_texts():
    told = {"node": "a", "dependents": [{"node": "b", "depth": 1, "parent": "a", "relation": "calls", "via": "resolved"}, {"node": "a", "depth": 2, "parent": "b", "relation": "calls", "via": "resolved"}, {"node": "c", "depth": 1, "parent": None, "relation": "ambiguous-reference", "via": "ambiguous"}]}
    assert render.blast_tree(told).splitlines() == ["a", "  ✓ b", "    ✓ a", "found by name only:", "  ? c"]
    assert render.blast_flat(told).splitlines()[-1] == "  ? 1 c (ambiguous-reference)"
    assert render.answer({"refused": True, "supported": ["untested"]}).startswith("That is no question")
    assert "and 2 more" in render.answer({"intent": "untested", "untested": ["x"], "count": 3})
