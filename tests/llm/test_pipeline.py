"""Stages of the pipeline, each against plain Python on a small table."""

import random
import re

import pytest
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
# columns that the operators use names of
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, key string, grp string, n long, h string, kept boolean, rest string, row string, root string"


@pytest.fixture(scope="module")
def stages():
    import corpus_pipeline

    return dict(corpus_pipeline.STAGES)


def frame(spark, rows):
    full = [(i, t, "en", "s", None if t is None else len(t), "k", "g", 1, "h", True, "r", "w", "o") for i, t in rows]
    return spark.createDataFrame(full, COLUMNS)


def state(found):
    return sorted((str(r["doc_id"]), r["text"] or "") for r in found.select("doc_id", "text").collect())


def told(rows):
    return sorted((str(i), t or "") for i, t in rows)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Labels of 300 documents, every third of them toxic, and those documents."""
    r = random.Random(7)
    letters = lambda n: "".join(r.choice("abcdefghijklmnop") for _ in range(n))  # noqa: E731  words are runs of letters
    plain, bad = [letters(6) for _ in range(200)], ["vile" + letters(4) for _ in range(6)]
    rows = []
    for i in range(300):
        text = [r.choice(plain) for _ in range(40)]
        if i % 3 == 0:
            for k in range(0, 40, 4):
                text[k] = r.choice(bad)
        rows.append((i, " ".join(text)))
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i, _ in rows], "doc_id long, quality int, toxic int").write.parquet(str(path / "labels.parquet"))
    return str(path), rows


def test_toxic_documents_go_and_clean_ones_stay(spark, stages, folder):
    path, rows = folder
    docs = frame(spark, [*rows, (None, rows[1][1]), (7, rows[2][1]), (900, None), (901, "")])
    found = stages["toxicity"](spark, docs, path)
    assert found.columns == docs.columns
    assert state(found) == told([*((i, t) for i, t in rows if i % 3), (None, rows[1][1]), (7, rows[2][1]), (900, None), (901, "")])


def test_one_of_equal_texts_stays(spark, stages, folder):
    r = random.Random(1)
    rows = [(r.choice([None, *range(30)]), r.choice([None, "", "a", "A", "a ", "long " * 5000, "é"])) for _ in range(80)]
    last = {}
    for i, t in rows:
        last[t or ""] = max(last.get(t or "", -1), -1 if i is None else i)
    found = stages["exact_dedup"](spark, frame(spark, rows), folder[0])
    assert state(found) == told([(None if i < 0 else i, t) for t, i in last.items()])


def shingles(text):
    words = WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_one_of_near_duplicates_stays(spark, stages, folder):
    r = random.Random(2)
    rows = []
    for family in range(12):
        base = [f"f{family}w{k}" for k in range(r.choice([3, 30, 80]))]
        for _ in range(r.randint(1, 6)):
            text = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 3])):
                text[r.randrange(len(text))] = f"x{r.random()}"
            rows.append((len(rows), " ".join(text)))
    rows += [(3, "an id that is there twice with another text"), (None, rows[0][1].upper()), (500, None), (501, " \n"), (502, "")]
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(i)
    first = lambda i: (rows[i][0] is None, rows[i][0] or 0)
    kept = [min(g, key=first) for g in groups.values()]
    found = stages["ngram_jaccard_join"](spark, frame(spark, rows), folder[0])
    assert state(found) == told([rows[i] for i in kept])


def test_later_repeats_are_cut(spark, stages, folder):
    r = random.Random(3)
    shared = ["".join(r.choice("abcdefgh ijé") for _ in range(n)) for n in (99, 130, 400)]
    rows = []
    for i in range(25):
        parts = [r.choice(shared) if r.random() < 0.5 else "".join(r.choice("klmnop qrs") for _ in range(r.choice([5, 60, 150]))) for _ in range(r.randint(0, 5))]
        rows.append((i, "".join(parts)))
    rows += [(25, "ha" * 400), (26, None), (27, "")]
    seen, wanted = set(), []
    for i, text in rows:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for k in range(len(raw) - 99):
            piece = raw[k : k + 100]
            if piece in seen:
                gone[k : k + 100] = b"\1" * 100
            seen.add(piece)
        wanted.append((i, bytes(b for b, g in zip(raw, gone, strict=True) if not g).decode(errors="ignore")))
    docs = frame(spark, rows)
    found = stages["suffix_array_dedup"](spark, docs, folder[0])
    assert found.columns == docs.columns and state(found) == told(wanted)
    assert found.filter("text <> '' and n_chars <> length(text)").isEmpty()


def test_packing_holds_every_token_once(spark, stages, folder):
    import public_tokenizers
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    r = random.Random(4)
    rows = [(i, " ".join(r.choice(["word", "other", "é中", "x1"]) for _ in range(r.choice([0, 3, 700, 9000])))) for i in range(20)] + [(5, "an id twice"), (None, None)]
    pieces = stages["best_fit_packing"](spark, frame(spark, rows), folder[0]).collect()
    lengths = sorted(len(coder.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in rows)
    assert sum(p["length"] for p in pieces) == sum(lengths)
    assert sorted(p["length"] + p["start"] for p in pieces if p["length"] < 4096 or (p["start"] + 4096) in lengths) == lengths
    places = {}
    for p in pieces:
        places.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for runs in places.values():
        at = 0
        for offset, length in sorted(runs):
            assert offset == at
            at += length
        assert at <= 4096


@pytest.mark.parametrize("name", ["toxicity", "exact_dedup", "ngram_jaccard_join", "suffix_array_dedup", "best_fit_packing"])
def test_an_empty_table_gives_an_empty_one(spark, stages, folder, name):
    docs = frame(spark, [])
    found = stages[name](spark, docs, folder[0])
    assert found.isEmpty() and (name == "best_fit_packing" or found.columns == docs.columns)


def test_the_whole_pipeline(spark, folder, tmp_path):
    import corpus_pipeline

    path, rows = folder
    twice = [*rows, *((1000 + i, t) for i, t in rows if i < 50)]
    table = tmp_path / "all"
    table.mkdir()
    frame(spark, twice).write.parquet(str(table / "documents.parquet"))
    spark.read.parquet(path + "/labels.parquet").write.parquet(str(table / "labels.parquet"))
    found = corpus_pipeline.run(spark, str(table))
    # toxic ones go, of copies the later id stays, all others are there
    assert {r["doc_id"] for r in found.select("doc_id").collect()} == {1000 + i if i < 50 else i for i, _ in rows if i % 3}
    assert found.filter(F.col("length") > 4096).isEmpty()
