"""Each operator against brute force, and on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from graphloom.functions.ship import ship
from graphloom.llm import exact_dedup, lm_scoring, ngram_join, packing, pieces, quality_model, quality_rules, sharding, suffix_dedup, toxicity
from graphloom.llm import textkit as tk

WORD = re.compile("[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, sig string, node long, score double, key long, label int, h long"


def lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text)


def words(text):
    return WORD.findall(lower(text or ""))


@pytest.fixture(scope="module")
def texts():
    r = random.Random(5)
    vocabulary = ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 6))) for _ in range(300)]
    make = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    base = make(120)
    near = base.split()
    near[60] = "other"
    passage = make(40)
    out = [base, base, " ".join(near), base.upper(), f"{make(60)} {passage} {make(30)}", f"{make(20)} {passage}", passage * 3, "", None, "  \n", "one two", "one two", "a", make(20000), "x" * 5000, "é" * 300, make(130)]
    return [(i, t) for i, t in enumerate(out)] + [(3, out[4]), (None, out[0]), (None, None)]


@pytest.fixture(scope="module")
def docs(spark, texts):
    ship(spark)
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", 1, 0.5, 2, 1, 3) for i, t in texts], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def unique(docs):
    """One row an id, none null: where brute force goes by id."""
    return docs.filter("doc_id is not null").dropDuplicates(["doc_id", "text"]).filter("not (doc_id = 3 and length(text) < 800)").dropDuplicates(["doc_id"])


def operators(spark):
    labels = spark.createDataFrame([(i, i % 2, (i + 1) % 2) for i in range(17)] + [(None, 1, 1), (2, None, None)], "doc_id long, quality int, toxic int")
    return {
        "exact_dedup": exact_dedup.exact_dedup,
        "ngram_join": ngram_join.similar_groups,
        "suffix_dedup": suffix_dedup.remove_repeats,
        "quality_rules": quality_rules.apply_rules,
        "packing": packing.pack_documents,
        "pieces": pieces.segment_documents,
        "sharding": sharding.shard_documents,
        "lm_scoring": lambda d: lm_scoring.score(d, *lm_scoring.train(d.select("doc_id", "text"), "doc_id", rounds=2)),
        "quality_model": lambda d: quality_model.score(d, quality_model.train(d, labels)),
        "toxicity": lambda d: toxicity.score(d, toxicity.train(d, labels)),
    }


@pytest.mark.parametrize("name", ["exact_dedup", "ngram_join", "suffix_dedup", "quality_rules", "packing", "pieces", "sharding", "lm_scoring", "quality_model", "toxicity"])
def test_every_row_has_a_result_and_empty_tables_give_none(spark, docs, texts, name):
    run = operators(spark)[name]
    rows = run(docs).select("doc_id").collect()
    got = collections.Counter(r["doc_id"] for r in rows)
    if name == "packing":  # long texts have several pieces
        assert set(got) == {i for i, _ in texts}
    else:
        assert got == collections.Counter(i for i, _ in texts)
    assert run(docs.limit(0)).count() == 0


def test_words_and_shingles_as_by_regular_expression(texts):
    column = pa.array([t for _, t in texts])
    for i, j, data, offs in tk.blocks(column, 4000):
        data = tk.lower(data)
        starts, ends, ptr = tk.words(data, offs)
        for d in range(j - i):
            own = [bytes(data[starts[k] : ends[k]]).decode() for k in range(ptr[d], ptr[d + 1])]
            assert own == words(texts[i + d][1])
        h, at = tk.shingles(tk.span_hashes(data, starts, ends), ptr)
        for d in range(j - i):
            w = words(texts[i + d][1])
            expected = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
            assert len(set(h[at == d].tolist())) == len(expected)


def test_exact_dedup(docs, texts):
    groups = collections.defaultdict(list)
    for i, t in texts:
        groups[t or ""].append(i)
    for bits in (1 << 28, 1 << 14):
        for r in exact_dedup.exact_dedup(docs, max_bits=bits).collect():
            members = next(m for t, m in groups.items() if hashlib.sha256(t.encode()).hexdigest() == r["text_sha256"])
            best = max((m for m in members if m is not None), default=None)
            assert (r["keep_id"], r["group_size"], r["kept"]) == (best, len(members), r["doc_id"] == best)


def test_ngram_join_is_brute_force(unique):
    data = {r["doc_id"]: r["text"] for r in unique.select("doc_id", "text").collect()}
    sets = {i: ({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := words(t)) else set()) for i, t in data.items()}
    root = {i: i for i in sets}
    for _ in range(len(sets)):
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.similar_groups(unique).collect()}
    assert got == {i: (len(sets[i]), root[i]) for i in sets}


def test_similar_sets_share_a_signature_at_every_size():
    r = np.random.default_rng(1)
    slots = {k: min(m, ngram_join.SLOTS) for k, m in enumerate(ngram_join.SEGMENTS) if k > 1}
    for s in [1, 2, 3, 4, 5, 6, 7, 9, 11, 12, 13, 17, 23, 24, 30, 47, 48, 64, 95, 96, 130, 191, 192, 260, 400, 500, 9000]:
        for turn in range(30 if s < 1000 else 3):
            a = np.unique(r.integers(1 << 62, size=s)).astype(np.uint64)
            drop = int(r.integers(0, s // 4 + 1))
            add = max(0, min(s // 3, (4 * (s - drop) - 3 * s) // 3))
            b = np.unique(np.concatenate([a[drop:], r.integers(1 << 62, size=int(r.integers(0, add + 1))).astype(np.uint64)]))
            common = len(np.intersect1d(a, b))
            if 100 * common < 75 * (len(a) + len(b) - common) or not len(b):
                continue
            levels = {k: r.integers(0, 3, n) for k, n in slots.items()} if turn else {}  # whatever is allocated
            n = np.array([len(a), len(b)])
            sig, of, slack = ngram_join.signatures(np.concatenate([a, b]), n, levels)
            shared = set(sig[of == 0].tolist()) & set(sig[of == 1].tolist())
            assert shared, (len(a), len(b), common)
            # and more than either may drop of those with the same bit
            assert any(sum(x & 1 == bit for x in shared) > max(slack[0, bit], slack[1, bit]) for bit in (0, 1)), (len(a), len(b), common)


def test_common_segments_are_left_out_and_others_cover_for_them():
    r = np.random.default_rng(2)
    k = 8
    lo, hi = ngram_join.BANDS[k]
    line = r.integers(1 << 62, size=30).astype(np.uint64)  # in every set
    costs = ngram_join.Costs()
    for _ in range(300):
        own = np.concatenate([line, r.integers(1 << 62, size=hi - 60).astype(np.uint64)])
        for cells in ngram_join.bands(own, np.array([len(own)])):
            costs.add(cells)
    level = costs.levels()[k]
    with np.errstate(over="ignore"):
        base = tk.mix(np.array([k + 1], np.uint64))
        hot = np.unique(tk.mix(line ^ base) % np.uint64(ngram_join.SEGMENTS[k])).astype(int)
    cold = np.setdiff1d(np.arange(len(level)), hot)
    assert level[hot].mean() < 0.7 < level[cold].mean()
    s = costs.sums[k]
    assert s[0][level > 0].sum() + s[1][level > 1].sum() >= ngram_join.ROOM * s[-1, 0]


def test_parity_bits_never_part_similar_sets():
    r = np.random.default_rng(4)
    for s in (3, 20, 255, 257, 511, 513, 1500, 4000):
        for _ in range(20):
            a = r.integers(1 << 62, size=s).astype(np.uint64)
            b = np.concatenate([a[int(r.integers(0, s // 4 + 1)) :], r.integers(1 << 62, size=int(r.integers(0, s // 4 + 1))).astype(np.uint64)])
            x, y = (np.frombuffer(ngram_join._parities(v), np.uint64)[None] for v in (a, b))
            common = len(np.intersect1d(a, b))
            if 100 * common >= 75 * (len(a) + len(b) - common):
                assert ngram_join._may_be_similar(x, np.array([len(a)]), y, np.array([len(b)])).all()
        other = r.integers(1 << 62, size=s).astype(np.uint64)
        assert not ngram_join._may_be_similar(x, np.array([len(b)]), np.frombuffer(ngram_join._parities(other), np.uint64)[None], np.array([s])).any()


def test_ngram_join_is_brute_force_on_families(spark):
    """Families of near copies around the threshold, a line that all share, tiny sets, copies with other case."""
    ship(spark)
    r = random.Random(11)
    word = lambda: f"v{r.randint(0, 5000)}"
    line = " ".join(word() for _ in range(12))
    texts = []
    for size in (3, 6, 9, 14, 25, 60, 150):
        for _ in range(6):
            base = [word() for _ in range(size)]
            for _ in range(7):
                w = list(base)
                for _ in range(r.randint(0, max(1, size // 18))):
                    w[r.randrange(size)] = word()
                if r.random() < 0.3:
                    w = w[r.randint(0, size // 6) :]
                texts.append(" ".join(w) + (" " + line if r.random() < 0.4 else ""))
    texts += [t.upper() for t in texts[::9]]
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in map(words, texts)]
    root = list(range(len(sets)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(sets)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in ngram_join.similar_groups(docs).collect()}
    assert got == {i: (len(s), top(i)) for i, s in enumerate(sets)}


def test_hot_signatures_go_apart_and_come_back(monkeypatch):
    monkeypatch.setattr(ngram_join, "HOT", 3)
    r = np.random.default_rng(5)
    sig, node = r.integers(40, size=600).astype(np.uint64) * np.uint64(1 << 58), r.integers(200, size=600).astype(np.uint64)
    sig[:300] = np.uint64(7 << 57)
    sig[300:350] += np.arange(50, dtype=np.uint64)
    batches = [b for half in (slice(0, 400), slice(400, 600)) for b in ngram_join._sent(sig[half], node[half], 8, np.array([[5, 9]]))]
    rows = sorted((row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True)), key=lambda row: row[0])
    batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], batches[0].schema.names)
    got = [row for out in ngram_join._gathered([batch]) for row in zip(*(c.to_pylist() for c in out.columns), strict=True)]
    assert [x for x in got if x[2] < 0] == [(9, 5, -1)] * 2
    pairs = set(zip(sig.view(np.int64).tolist(), node.view(np.int64).tolist(), strict=True))
    counts = collections.Counter(s for s, _ in pairs)
    assert {p for p in pairs if counts[p[0]] > 1} <= {x[:2] for x in got if x[2] > 0} <= pairs
    assert all(len({x[2] for x in got if x[0] == s and x[2] > 0}) == 1 for s in counts if counts[s] > 1)


@pytest.mark.parametrize("most", [4000, 1])
def test_suffix_dedup_is_brute_force(unique, most):
    seen, expected = set(), {}
    for r in sorted(unique.select("doc_id", "text").collect()):
        data = (r["text"] or "").encode()
        covered = bytearray(len(data))
        for i in range(len(data) - 99):
            if (s := data[i : i + 100]) in seen:
                covered[i : i + 100] = b"\x01" * 100
            seen.add(s)
        kept = bytes(b for b, c in zip(data, covered) if not c)
        expected[r["doc_id"]] = (len(data), sum(covered), len(re.findall(b"\x01+", bytes(covered))), hashlib.sha256(kept).hexdigest())
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], len(r["spans"]), r["kept_sha256"]) for r in suffix_dedup.remove_repeats(unique, most=most).collect()}
    assert got == expected


def test_longest_previous_factors():
    r = random.Random(2)
    for _ in range(30):
        texts = [bytes(r.choice(b"ab") for _ in range(r.randint(0, 30))) for _ in range(4)]
        marks = suffix_dedup.lpf_marks(texts, np.arange(4), 5)
        seen = set()
        for t, m in zip(texts, marks):
            for i in range(len(t)):
                s = t[i : i + 5]
                assert bool(m[i]) == (len(s) == 5 and s in seen)
                if len(s) == 5:
                    seen.add(s)


def test_quality_rules_count_as_stated(docs, texts):
    got = collections.defaultdict(list)
    for r in quality_rules.apply_rules(docs).collect():
        got[r["doc_id"]].append(r)
    for i, t in texts:
        if i is None or i == 3:
            continue
        (r,), t = got[i], t or ""
        w = WORD.findall(t)
        windows = collections.Counter(zip(w, w[1:], w[2:]))
        marked = {k + j for k in range(len(w) - 2) for j in range(3) if windows[tuple(w[k : k + 3])] > 1}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        assert (r["n_words"], r["word_chars"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(lines) - len(set(lines)), len(marked))
        assert r["base_failed"] == (len(w) < 50 or 100 * len(marked) > 50 * len(w))


def test_cascade_order_changes_no_verdict():
    data = pa.array(["a b c " * 40, "A B " * 60, "x | y " * 40, "good words are here . " * 20] * 3)
    verdicts = set()
    for order in (list(quality_rules.CASCADE), list(quality_rules.CASCADE)[::-1]):
        for _, _, raw, offs in tk.blocks(data):
            b = quality_rules.Block(raw, offs)
            verdicts.add(tuple((quality_rules.cascade(b, quality_rules.CASCADE, order, np.ones(b.n, bool)) < 0).tolist()))
    assert len(verdicts) == 1


def test_packing_places_every_piece_once(docs, texts):
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(packing.vocabulary())
    rows = packing.pack_documents(docs).collect()
    sequences = collections.defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in sequences.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 4096
    expected = collections.Counter()
    for i, t in texts:
        ids = coder.encode(t or "", add_special_tokens=False).ids + [1]
        for k in range(0, len(ids), 4096):
            part = np.array(ids[k : k + 4096], "<u4")
            expected[(i, k // 4096, k, len(part), zlib.crc32(part.tobytes()))] += 1
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == expected


@pytest.mark.parametrize("rule", ["dot", "norm"])
def test_best_fit_keeps_every_capacity(rule):
    length = np.random.default_rng(4).integers(1, 100, 400)
    s, at = packing.best_fit(length, 100, 4, 5000.0, rule)
    for k in range(s.max() + 1):
        own = length[s == k]
        assert own.sum() <= 100 and len(own) <= 4 and (len(own) == 1 or (own.astype(float) ** 2).sum() <= 5000)


def test_n_best_is_brute_force():
    lattice = pieces.Lattice(pieces.vocabulary())
    r = random.Random(3)
    for _ in range(60):
        text = "".join(r.choice("the an. é中\n|") for _ in range(r.randint(1, 9)))
        marked = pieces.SPACE + text.replace(" ", pieces.SPACE)
        into, ways = lattice.edges(marked), []

        def walk(j, score, ids):
            if j == 0:
                ways.append(score)
            for i, s, own in into[j] if j else ():
                walk(i, score + s, own + ids)

        walk(len(marked), 0.0, ())
        got = lattice.encode(text, 4)
        assert [g[0] for g in got] == sorted(ways, reverse=True)[:4]
        assert all(lattice.decode(g[1]) == text for g in got)


def test_segmentations_decode_to_the_texts(spark):
    r = random.Random(5)
    texts = ["", None, " ", "a", "  two  spaces ", "tab\tand\nline", "é中🙂 mixed", "x" * 3000, *("".join(r.choice("the an. é中\n|Z9") for _ in range(r.randint(20, 2000))) for _ in range(20))]
    docs = spark.createDataFrame([*enumerate(texts), (None, "no id"), (3, "a")], "doc_id long, text string").withColumn("ids", F.lit("other"))
    coded = pieces.segment_documents(docs)
    back = pieces.decode_documents(coded.withColumn("text", F.lit(0)))
    want = sorted((str(i), t or "") for i, t in [*enumerate(texts), (None, "no id"), (3, "a")])
    assert sorted((str(x["doc_id"]), x["text"]) for x in back.collect()) == want
    assert coded.filter("octet_length(ids) <> 4 * n_pieces").isEmpty()
    odd = spark.createDataFrame([(1, None), (2, bytearray())], "doc_id long, ids binary")
    assert {(x["doc_id"], x["text"]) for x in pieces.decode_documents(odd).collect()} == {(1, None), (2, "")}
    assert pieces.decode_documents(odd.limit(0)).isEmpty()


def test_shards_are_even_and_keep_equal_texts(docs, texts):
    rows = sharding.shard_documents(docs, shards=4).collect()
    counts = collections.Counter(r["shard"] for r in rows)
    assert max(counts.values()) - min(counts.get(s, 0) for s in range(4)) <= 1
    for s in range(4):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(counts[s]))
    assert collections.Counter((r["size"], r["text_crc32"]) for r in rows) == collections.Counter((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t in texts)
    homes = collections.defaultdict(set)
    for r in rows:
        homes[r["size"], r["text_crc32"]].add(r["shard"])
    assert all(len(v) == 1 for v in homes.values())  # no group here is larger than a shard


@pytest.mark.parametrize("placed", [sharding.PLACED, 0])  # 0: all groups go by running sums
def test_only_groups_without_room_are_parted(spark, monkeypatch, placed):
    monkeypatch.setattr(sharding, "PLACED", placed)
    texts = ["hot"] * 40 + [f"pair {i // 2}" for i in range(30)] + [f"five {i // 5}" for i in range(20)] + [f"one {i}" for i in range(31)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = sharding.shard_documents(docs, shards=6).collect()  # quotas of 20 and 21
    counts = collections.Counter(r["shard"] for r in rows)
    assert sorted(counts.values()) == [20] * 5 + [21]
    for s in range(6):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(counts[s]))
    homes = collections.defaultdict(set)
    for r in rows:
        homes[texts[r["doc_id"]]].add(r["shard"])
    pieces_of_hot = len(homes.pop("hot"))
    assert pieces_of_hot == 2 if placed else pieces_of_hot >= 2  # what goes by running sums fills the rooms that are left, however many
    assert all(len(v) == 1 for v in homes.values())


def test_seats_are_whole_where_they_fit_else_in_few_pieces():
    room = [10, 10, 10]
    whole, runs = sharding.seat([(b"a", 12, 0), (b"b", 7, 1), (b"c", 6, 1), (b"d", 5, 2)], room)
    assert whole == {b"b": 1, b"c": 2} and runs == [(b"a", 0, 10), (b"a", 1, 2), (b"d", 2, 4), (b"d", 1, 1)] and sum(room) == 0


def test_language_model_base_and_sums(docs, texts):
    model, counts, totals = lm_scoring.train(docs.select("doc_id", "text"), "doc_id", rounds=2)
    c = collections.Counter(w for _, t in texts for w in [*words(t), "\n"])
    n, v = sum(c.values()), len(c)
    for known in (1 << 20, 5):  # 5: nearly all words go the way of the rare ones
        rows = lm_scoring.score(docs, model, counts, totals, known=known).collect()
        got = collections.Counter((r["n_tokens"], r["n_known"], round(r["base_score"], 4)) for r in rows)
        expected = collections.Counter((len(w) + 1, len(w) + 1, round(sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in [*w, "\n"]), 4)) for _, t in texts for w in [words(t)])
        assert got == expected
    # classes and words in a class share out one
    h, shape, ptr = lm_scoring.tokens(*tk.buffers(pa.array(["the end of it"])))
    group, word, f, wf = model.encode(h, shape, ptr)
    logits, odds, total = model._softmax(model.weights, f, model.prior)
    assert np.allclose(odds.sum(1), total) and np.allclose(np.exp(logits), odds, rtol=1e-4)
    # the model is the same however the texts are split
    scores = []
    for parts in (1, 8):
        model, counts, totals = lm_scoring.train(docs.select("doc_id", "text").repartition(parts), "doc_id", rounds=2)
        scores.append(sorted(r["score"] for r in lm_scoring.score(docs, model, counts, totals).collect()))
    assert np.allclose(*scores, rtol=1e-3)


def test_classifiers_learn(spark):
    ship(spark)
    r = random.Random(6)
    plain = ["w" + chr(97 + k // 26) + chr(97 + k % 26) for k in range(400)]  # toxicity takes runs of letters as words
    rows, labels = [], []
    for i in range(400):
        bad = i % 3 == 0
        w = [r.choice(plain) for _ in range(80)]
        if bad:
            for k in range(0, 80, 20):
                w[k] = r.choice(["vile", "nasty"])
            w = [x + "%%%" if k % 2 else x for k, x in enumerate(w)]
        rows.append((i, " ".join(w)))
        labels.append((i, int(not bad), int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    for module, label in ((toxicity, 2), (quality_model, 1)):
        got = {x["doc_id"]: x["predicted"] for x in module.score(docs, module.train(docs, known)).collect()}
        held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 3 == 1]
        assert sum(got[i] == labels[i][label] for i in held) >= 0.95 * len(held)


def test_special_markers_are_as_by_a_plain_call():
    from tokenizers import Tokenizer

    texts = ["one <|endoftext|> two", "<|startoftext|>one", "a<|endoftext|>b <|ENDOFTEXT|> c", "x  <|endoftext|><|startoftext|>\n y!", "<|endoftext|>'s it's <|endoftext"]
    plain = Tokenizer.from_file(packing.vocabulary())
    coded = packing.WordTokens(packing.vocabulary()).encode([t.encode() for t in texts])
    assert [np.frombuffer(c, "<u4").tolist() for c in coded] == [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert np.frombuffer(coded[0], "<u4").tolist() == [637, 49407, 1237]


def test_language_model_knows_the_words_before_beyond_the_top_ones(spark):
    r = random.Random(3)
    vocabulary = [f"w{i}x{i * 7919 % 1000}" for i in range(3000)]
    follows = dict(zip(vocabulary, r.sample(vocabulary, len(vocabulary)), strict=True))
    rows = [(i, " ".join(x for w in r.choices(vocabulary, k=60) for x in (w, follows[w]))) for i in range(3000)]
    model, counts, totals = lm_scoring.train(spark.createDataFrame(rows, "doc_id long, text string").repartition(2), "doc_id")
    told = [w for w in vocabulary if not model.index.find(lm_scoring.tokens(*tk.buffers(pa.array([w])))[0])[1][0] and not model.index.find(lm_scoring.tokens(*tk.buffers(pa.array([follows[w]])))[0])[1][0]][:200]
    pairs = [(0, f"{w} {follows[w]}") for w in told] + [(1, f"{w} {follows[v]}") for w, v in zip(told, told[1:] + told[:1], strict=True)]
    scored = lm_scoring.score(spark.createDataFrame(pairs, "doc_id long, text string"), model, counts, totals)
    mean = {x["doc_id"]: x["s"] for x in scored.groupBy("doc_id").agg(F.avg("score").alias("s")).collect()}
    assert mean[0] > mean[1] + 0.3  # the same words, in pairs as in training and not
    # the places of a shape that have words share out one
    inside = np.arange(1 << model.depth) + (5 << model.depth)
    inside = inside[model.leaf_room[inside] > 0]
    one, two = (np.full(len(inside), x, np.uint64) for x in (12345, 678))
    assert np.isclose(np.exp(model.tail_log(inside, one, two) + np.log(model.leaf_room[inside])).sum(), 1, atol=1e-3)
    # and so do all words, with one unseen in each shape, after the same two words
    known = counts.toPandas()
    after = lm_scoring.tokens(*tk.buffers(pa.array([f"{told[0]} {told[1]}"])))
    h = np.concatenate([known["h"].to_numpy(np.int64).view(np.uint64), np.arange(1, lm_scoring.SHAPES + 1, dtype=np.uint64)])
    shape = np.concatenate([known["shape"].to_numpy(np.int64), np.arange(lm_scoring.SHAPES)])
    last, room = np.arange(len(h)) * 3 + 2, np.concatenate([known["n"].to_numpy(float) + 0.5, np.full(lm_scoring.SHAPES, 0.5)])
    every = [np.tile(np.append(x[:2], x[:1]), len(h)) for x in after[:2]]
    for x, w in zip(every, (h, shape), strict=True):
        x[last] = w
    unseen = np.zeros(len(every[0]), bool)
    unseen[last[len(known) :]] = True
    logs, own, _ = model.log_probability(*every, np.arange(len(h) + 1) * 3, unseen, np.zeros(len(unseen), bool))
    assert np.isclose(np.exp(logs[last] + np.where(own[last], 0, np.log(room))).sum(), 1, atol=1e-3)


def test_toxicity_is_kneser_ney_by_hand(spark):
    """Log-likelihoods of both models against a plain Python count, and each model against one."""
    ship(spark)
    r = random.Random(8)
    letters = lambda n: "".join(r.choice("abcdefgh") for _ in range(n))
    plain = [letters(4) for _ in range(600)]
    rows, labels = [], []
    for i in range(400):
        toxic = i % 2
        w = [r.choice(plain) for _ in range(40)]
        if toxic:
            for k in r.sample(range(40), 6):
                w[k] = r.choice(["vile", "nasty", "awful"])
        rows.append((i, " ".join(w)))
        labels.append((i, toxic))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(docs, known)
    used = {x["label_id"]: x["label"] for x in toxicity.labelled_sample(known, "doc_id", "toxic", toxicity.MAX_DOCS).collect() if not x["curve"]}
    n, contexts = [collections.Counter(), collections.Counter()], [collections.defaultdict(set), collections.defaultdict(set)]
    for i, t in rows:
        if i in used:
            w = t.split()
            pairs = list(zip([""] + w, w))
            n[used[i]].update(pairs)
            for v, x in pairs:
                contexts[used[i]][x].add(v)

    def differs(x, t):
        p, both = (x[0] / t[0], x[1] / t[1]), sum(x) / sum(t)
        return abs(p[1] - p[0]) > toxicity.MARKED * math.sqrt(both * (1 - both) * (1 / t[0] + 1 / t[1])) and max(p) > toxicity.FACTOR * min(p)

    vocabulary = sorted(set(contexts[0]) | set(contexts[1]))
    total = [sum(map(len, contexts[c].values())) for c in (0, 1)]
    own_word = {x for x in vocabulary if differs([len(contexts[c][x]) for c in (0, 1)], total)}
    assert {"vile", "nasty", "awful"} <= own_word
    cont = {x: len(contexts[0][x] | contexts[1][x]) for x in vocabulary}
    room = sum(cont.values()) + 0.5 * (len(vocabulary) + 1)

    def probability(c, v, x):
        share = lambda y: (len(contexts[c][y]) - toxicity.DISCOUNT if len(contexts[c][y]) and y in own_word else 0) / total[c]
        uni = share(x) + (1 - sum(map(share, vocabulary))) * (cont.get(x, 0) + 0.5) / room
        after = sum(k for (a, _), k in n[c].items() if a == v) or 1
        seen = {b: k for (a, b), k in n[c].items() if a == v and b in own_word}
        kept = {b: max(k - toxicity.DISCOUNT, 0) / after for b, k in seen.items()}
        return kept.get(x, 0) + (1 - sum(kept.values())) * uni

    for c in (0, 1):
        assert math.isclose(sum(probability(c, "vile", x) for x in [*vocabulary, "new"]), 1, abs_tol=1e-9)
    for text in ["vile " + plain[0] + " nasty unseen", plain[1] + " " + plain[2], rows[1][1], ""]:
        w = text.split()
        expected = sum(math.log(probability(1, v, x) / probability(0, v, x)) for v, x in zip([""] + w, w)) / max(1, len(w))
        (_, _, data, offs), = tk.blocks(pa.array([text]))
        assert math.isclose(model.evidence(data, offs)[0], expected, abs_tol=1e-6)


def test_long_toxic_texts_are_caught(spark):
    """What words that tell nothing leave is no evidence, however many they are."""
    r = random.Random(9)
    plain = ["".join(r.choice("abcdefgh") for _ in range(4)) for _ in range(600)]
    rows = []
    for i in range(800):
        w = [r.choice(plain) for _ in range(r.choice([30, 30, 30, 1200]))]
        if i % 4 == 0:
            for k in r.sample(range(len(w)), 4 if len(w) == 30 else 60):
                w[k] = r.choice(["vile", "nasty", "awful"])
        rows.append((i, " ".join(w), int(i % 4 == 0)))
    docs, known = (spark.createDataFrame(rows, "doc_id long, text string, toxic int").select("doc_id", c) for c in ("text", "toxic"))
    got = {x["doc_id"]: x["predicted"] for x in toxicity.score(docs, toxicity.train(docs, known)).collect()}
    long = [i for i, t, y in rows if y and len(t) > 1000]
    assert len(long) > 30 and sum(got[i] for i in long) >= 0.8 * len(long)
    assert not any(got[i] for i, _, y in rows if not y)


def test_toxicity_counts_every_labelled_text(spark):
    """Only the texts of the curve are bounded: what words say is counted in all the others, however many there are."""
    r = random.Random(10)
    plain = ["".join(r.choice("abcdefgh") for _ in range(4)) for _ in range(300)]
    rows = []
    for i in range(600):
        w = [r.choice(plain) for _ in range(40)]
        if i % 2:
            for k in r.sample(range(40), 5):
                w[k] = r.choice(["vile", "nasty", "awful"])
        rows.append((i, " ".join(w), i % 2))
    docs, known = (spark.createDataFrame(rows, "doc_id long, text string, toxic int").select("doc_id", c) for c in ("text", "toxic"))
    model = toxicity.train(docs, known, max_docs=8)
    curve = {x["label_id"] for x in toxicity.labelled_sample(known, "doc_id", "toxic", 8).filter("curve").collect()}
    assert len(curve) == 4
    fold = {x["doc_id"] for x in docs.filter(toxicity.fold(F.col("doc_id"), 3) != 1).select("doc_id").collect()}
    contexts = collections.defaultdict(set)
    for i, t, y in rows:
        if y and i in fold - curve:
            for v, x in zip([""] + t.split(), t.split()):
                contexts[x].add(v)
    (_, _, data, offs), = tk.blocks(pa.array(["vile nasty awful"]))
    at, found = model.words.find(toxicity._pairs(data, offs)[1])
    assert found.all()
    total = sum(map(len, contexts.values()))
    own = model.uni[1][at] - model.left[1] * model.shared[at]
    assert np.allclose(own, [(len(contexts[x]) - toxicity.DISCOUNT) / total for x in ("vile", "nasty", "awful")], atol=1e-9)


def test_rules_are_ordered_by_what_they_add(monkeypatch):
    clock = iter(range(10**6))
    monkeypatch.setattr(quality_rules.time, "perf_counter", lambda: float(next(clock)))
    good = " ".join(f"word{i}" for i in range(60))
    texts = pa.array([good + " #" * 40, good + " #" * 30, good + " !" * 200, "short", "#" * 5] + [good] * 5)
    asked = []
    rules = {"symbols": quality_rules.CASCADE["symbols"], "never": lambda b: np.zeros(b.n, bool), "seen": lambda b: asked.append(b.n) or 4 * b.n_symbols < 0}
    order = quality_rules.order_rules(texts, rules)
    assert order[0] == "symbols"
    assert 0 < sum(asked) <= 8  # the two short texts are rejected by the base and not asked about


def test_no_evidence_is_never_rather_toxic():
    y = np.repeat([0.0, 1.0], [30, 30])
    apart = np.append(np.linspace(-3, -2, 30), np.linspace(-0.5, 0.5, 30))  # the best threshold lies below 0
    slope, offset = toxicity._logistic(apart, y)
    assert offset == 0 and slope > 0
    grid = np.linspace(0, 50, 20001)[:, None] * apart / apart.std()
    loss = np.logaddexp(0, grid).sum(1) - (grid * y).sum(1) + np.linspace(0, 50, 20001) ** 2 / 2
    assert abs(slope * apart.std() - np.linspace(0, 50, 20001)[loss.argmin()]) < 0.005
    assert toxicity._logistic(apart + 3, y)[1] < 0
