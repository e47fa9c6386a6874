"""Whitening, graph dedup and turn repair against brute force, and on nulls, ties, repeats, empty tables and clashing columns."""

import functools
import hashlib
import math
import random
import zlib

import numpy as np
import pytest

from graphloom.functions.ship import ship
from graphloom.llm import components, graph_dedup, turn_repair, whitening

VECTORS = "vec_id long, embedding array<float>, label int, n long, x string, node long, dims int"


@pytest.fixture(scope="module")
def vectors(spark):
    ship(spark)
    r = np.random.default_rng(3)
    base = r.normal(size=(160, 6)).astype("float32")
    near = base[:40] + r.normal(size=(40, 6)).astype("float32") * 0.08
    odd = [None, [], [1.0, None, 0.0, 0.0, 0.0, 0.0], [float("nan")] * 6, [float("inf"), 1.0, 1.0, 1.0, 1.0, 1.0], [0.0] * 6, [1.0, 2.0], [-0.0] * 6]
    listed = [v.tolist() for v in [*base, *near, *base[:5], *base[:5], *np.repeat(base[:1], 30, 0)]] + odd
    rows = [(i, v, i % 3 if i % 17 else None) for i, v in enumerate(listed)] + [(4, listed[9], 0), (None, listed[12], 0), (None, None, None)]
    return rows, spark.createDataFrame([(i, v, label, 1, "x", 2, 3) for i, v, label in rows], VECTORS).repartition(5)


def finite(v):
    return v is not None and len(v) and all(c is not None and math.isfinite(c) for c in v)


def test_whitening_equals_brute_force(vectors):
    rows, frame = vectors
    kept = [(i, v) for i, v, _ in rows if finite(v) and len(v) == 6]
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in v] for _, v in kept])
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(0)
    centred = fit - sums / n
    values, vecs = np.linalg.eigh(centred.T @ centred / n)
    values, vecs = values[::-1], vecs[:, ::-1]
    got = whitening.whiten(frame).toPandas()
    assert len(got) == 6 * len(kept) and set(got["n"]) == {n}
    wanted = sorted((str(i), int(((n * row - sums) ** 2).sum())) for (i, _), row in zip(kept, x, strict=True))
    first = got[got["component"] == 1]
    assert sorted((str(i) if i == i else "None", d) for i, d in zip([None if i != i else int(i) for i in first["vec_id"]], first["deviation"], strict=True)) == wanted
    z = (x - sums / n) @ (vecs / np.sqrt(values))
    for c in range(6):
        part = got[got["component"] == c + 1]
        assert np.allclose(np.sort(np.abs(part["whitened"])), np.sort(np.abs(z[:, c])), atol=1e-7)
        assert np.allclose(part["explained"], values[c] / values.sum(), rtol=1e-9)
    assert got["identity_error"].nunique() == 1 and got["identity_error"][0] < 1e-9


def test_whitening_tiles_and_top(vectors, monkeypatch):
    _, frame = vectors
    key = ["vec_id", "deviation", "component"]
    whole = whitening.whiten(frame).toPandas().sort_values(key)
    monkeypatch.setattr(whitening, "BLOCK_BYTES", 8 * 4 * 10)
    fit = whitening.whole(frame, "vec_id", "embedding").select("x").distinct()
    fit = whitening.materialize(fit.selectExpr("x", "size(x) as dims"), "fit")
    model = whitening.fit_model(fit, 16, width=4)
    assert np.array_equal(model.explained, whole["explained"].to_numpy()[:6]) or np.allclose(model.explained, sorted(set(whole["explained"]), reverse=True))
    top = whitening.whiten(frame, top=2).toPandas().sort_values(key)
    assert top["component"].max() == 2 and np.allclose(top["whitened"], whole[whole["component"] <= 2]["whitened"])


def test_whitening_of_few_rows(spark):
    ship(spark)
    none = spark.createDataFrame([], VECTORS)
    assert whitening.whiten(none).count() == 0
    one = spark.createDataFrame([(7, [0.5, 1.0], 1)] * 3, "vec_id long, embedding array<float>, label int")
    got = whitening.whiten(one).collect()
    assert len(got) == 6 and all(r["whitened"] is None and r["explained"] == 0 and r["deviation"] == 0 and r["n"] == 1 for r in got)
    huge = spark.createDataFrame([("a", [1e300, 1.0]), ("b", [3e12, 1.0]), ("c", [-3e12, 2.0])], "vec_id string, embedding array<double>")
    got = whitening.whiten(huge).collect()
    assert sorted({r["vec_id"] for r in got}) == ["b", "c"] and all(r["deviation"] is None for r in got)


def brute_links(rows, at=0.93):
    usable = [finite(v) and label is not None and any(v) for _, v, label in rows]
    n = len(rows)
    link = np.zeros((n, n), bool)
    for a in range(n):
        for b in range(n):
            if a != b and usable[a] and usable[b] and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
                x, y = np.array(rows[a][1], "float32").astype(float), np.array(rows[b][1], "float32").astype(float)
                link[a, b] = np.array_equal(x, y) or x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= at
    out = []
    for a in range(n):
        seen, stack = {a}, [a]
        while stack:
            for b in np.flatnonzero(link[stack.pop()]):
                if b not in seen:
                    seen.add(b)
                    stack.append(b)
        ids = [rows[b][0] for b in seen if rows[b][0] is not None]
        least = min(ids) if ids else None
        out.append((str(rows[a][0]), int(link[a].sum()), least, rows[a][0] == least))
    return sorted(out, key=str)


@pytest.mark.parametrize(("cap", "shard"), [(4096, 1000), (4096, 15), (20, 25)])
def test_graph_dedup_equals_brute_force(vectors, cap, shard):
    rows, frame = vectors
    got = sorted(((str(r["vec_id"]), r["n_links"], r["component_id"], r["kept"]) for r in graph_dedup.near_duplicates(frame, cap=cap, shard=shard, overlap=3).collect()), key=str)
    assert got == brute_links(rows)


def test_graph_dedup_of_few_rows(spark):
    ship(spark)
    kinds = "vec_id long, embedding array<float>, label int"
    assert graph_dedup.near_duplicates(spark.createDataFrame([], kinds)).count() == 0
    got = graph_dedup.near_duplicates(spark.createDataFrame([(3, None, 1), (5, [1.0, 0.0], 1)], kinds)).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in got) == [(3, 0, 3, True), (5, 0, 5, True)]


def test_search_and_audit():
    r = np.random.default_rng(1)
    base = graph_dedup.unit(r.normal(size=(900, 32)))
    family = graph_dedup.unit(base[:1] + 0.02 * r.normal(size=(300, 32)))
    x = np.concatenate([base, family, graph_dedup.unit(base[100:200] + 0.02 * r.normal(size=(100, 32)))])
    near = graph_dedup.build(x)
    true = set(zip(*np.nonzero(np.triu(x @ x.T >= 0.93, 1)), strict=True))
    i, j = graph_dedup.search(x, np.arange(len(x)), x, near)
    found = {(min(a, b), max(a, b)) for a, b in zip(i, j, strict=True) if a != b and x[a] @ x[b] >= 0.93}
    assert found <= true and len(found) >= 0.99 * len(true)
    # from the medoids alone, as a question from another chunk has to
    i, j = graph_dedup.search(x, np.full(len(x), -1), x, near)
    found = {(min(a, b), max(a, b)) for a, b in zip(i, j, strict=True) if a != b and x[a] @ x[b] >= 0.93}
    assert len(found) >= 0.9 * len(true)


def test_audit_measures_recall(vectors):
    _, frame = vectors
    spark = frame.sparkSession
    nodes = frame.filter("vec_id < 200 and label is not null").selectExpr("vec_id as node", "label", "cast(embedding as array<double>) as v", "1L as copies")
    links = graph_dedup.find_links(nodes, {}, 2)
    assert graph_dedup.audit(nodes, links) == 1.0
    assert graph_dedup.audit(nodes, links.limit(links.count() // 2)) < 0.7
    assert graph_dedup.audit(nodes, spark.createDataFrame([], "a long, b long")) == 0.0


def test_components_of_a_rising_path(spark):
    path = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1000), (2000, 2001)], "a long, b long")
    got = {r["node"]: r["root"] for r in components.components(path).collect()}
    assert got == {i: 0 for i in range(301)} | {2000: 2000, 2001: 2000}


# conversations


def brute_repair(turns):
    """The least (cost, letters) by search over all edits, and the lines; ``turns`` are (turn, role, text) after damage."""
    space = "\x20\t\n\x0b\x0c\r"
    turns = sorted(turns, key=lambda t: (t[0] is not None, t[0] or 0, t[1], t[2]))
    faults, seen = [], set()
    for _, role, text in turns:
        left = text.rstrip(space)
        faults.append("blank" if not left else "duplicate" if (role, text) in seen else "truncated" if left[-1] not in ".!?" else None)
        seen.add((role, text))
    n = len(turns)

    def accepts(s):
        s = s[1:] if s[:1] == "s" else s
        return s == "" or len(s) % 2 == 0 and s == "ua" * (len(s) // 2)

    @functools.cache
    def best(i, state, puts):
        """state: what the roles so far come to: '', 's', 'u' or 'a'."""
        out = []
        if i == n and state in ("", "a"):
            out.append((0, "", ()))
        follow = lambda r: {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}.get((state, r))
        if puts < 3:
            for role in ("user", "assistant"):
                if (to := follow(role[0])) and (rest := best(i, to, puts + 1)):
                    out.append((5 + rest[0], "I" + rest[1], (f"{role}:", *rest[2])))
        if i < n:
            _, role, text = turns[i]
            if rest := best(i + 1, state, 0):
                out.append((2 + rest[0], "D" + rest[1], rest[2]))
            if faults[i] in (None, "truncated"):
                extra = 5 if faults[i] else 0
                if (to := follow(role[:1])) and (rest := best(i + 1, to, 0)):
                    out.append((extra + rest[0], "K" + rest[1], (f"{role}:{text}", *rest[2])))
                for new in ("user", "assistant"):
                    if (to := follow(new[0])) and (rest := best(i + 1, to, 0)):
                        out.append((1 + extra + rest[0], "R" + rest[1], (f"{new}:{text}", *rest[2])))
        return min(out, key=lambda o: o[:2]) if out else None

    cost, letters, lines = best(0, "", 0)
    initials = [t[1][:1] for t in turns]
    numbers = sorted({t[0] for t in turns if t[0] is not None})
    gaps = numbers[-1] - numbers[0] + 1 - len(numbers) if numbers else 0
    assert accepts("".join(line[0] for line in lines))
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, letters, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def brute_damage(rows):
    out = {}
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        own = out.setdefault(conv, [])
        if kind == 0:
            continue
        text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
        own += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


@pytest.fixture(scope="module")
def turns():
    r = random.Random(11)
    said = ["Yes.", "No!", "cut short", " ", "", "Why? \n", "é.", None, "a\tb"]
    rows = [(c, t, r.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "usurper"]), r.choice(said)) for c in range(150) for t in r.sample(range(12), r.randint(1, 8))]
    rows += [(500, t, ("user", "assistant")[t % 2], f"turn {t}.") for t in range(400)] + [(500, t, "user", "again.") for t in range(400, 700)]
    rows += [(None, 1, "user", "q."), (None, 2, None, None), (600, None, "assistant", "x."), (600, None, None, "y."), (600, 3, "user", "z"), (601, None, None, None)]
    rows += [(700, 5, "user", "same.")] * 40 + [(701, t, "system", "s.") for t in range(60)] + [(702, 1, "user", "word " * 40000 + ".")]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("parts", [1, 4, 60])
def test_repair_equals_brute_force(spark, turns, parts):
    ship(spark)
    frame = spark.createDataFrame([(*row, 1, "x") for row in turns], "conv_id long, turn long, role string, text string, fault int, conv string")
    import sys

    sys.setrecursionlimit(20000)
    wanted = {conv: brute_repair(own) for conv, own in brute_damage(turns).items()}
    got = {r["conv_id"]: tuple(r)[1:] for r in turn_repair.repair(frame, parts=parts).collect()}
    assert got.keys() == wanted.keys()
    for conv in wanted:
        assert got[conv] == wanted[conv], conv
    if parts == 60:
        assert turn_repair.repair(frame, parts=parts).count() == len(wanted)


def test_repair_of_nothing(spark):
    ship(spark)
    kinds = "conv_id long, turn long, role string, text string"
    assert turn_repair.repair(spark.createDataFrame([], kinds)).count() == 0
    gone = next(t for t in range(1000) if zlib.crc32(f"9:{t}".encode()) % 20 == 0)
    row = turn_repair.repair(spark.createDataFrame([(9, gone, "user", "x.")], kinds)).collect()
    assert [tuple(r) for r in row] == [(9, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_overlap_is_chosen_before_the_search(spark):
    true = spark.createDataFrame([(0, i, 1 if i <= 90 else 3) for i in range(1, 101)], "a long, b long, need long")
    assert graph_dedup.wanted_overlap(true, 2, 8) == 4 and graph_dedup.wanted_overlap(true, 4, 8) == 4 and graph_dedup.wanted_overlap(true, 2, 2) == 2
    assert graph_dedup.wanted_overlap(true.limit(0), 2, 8) == 2


def test_ways_back_lead_to_what_no_list_has():
    near = np.array([[1, 2], [0, 2], [0, 1], [0, -1]])  # no list has 3
    wide = graph_dedup.both_ways(near)
    assert 3 in wide[0] and (wide[:, :2] == near).all() and wide.shape == (4, 2 + graph_dedup.BACK)
    many = np.zeros((graph_dedup.BACK + 10, 1), int)
    many[0], many[-1] = -1, 0
    many[1:-1] = np.where(np.arange(1, len(many) - 1)[:, None] % 2, 0, 1)
    assert (graph_dedup.both_ways(many)[0] >= 0).sum() <= graph_dedup.BACK
