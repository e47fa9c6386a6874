"""Best-fit packing of token pieces into sequences with several capacities.

A sequence has room for so many tokens, pieces (document count) and so much
attention cost (the sum of squared piece lengths). A piece goes to the open
sequence that has room under every one of them and fits best: by the weighted
dot product of what the piece needs and what the sequence has left ("dot"), or
by the weighted norm of what would be left over ("norm"). Pieces come longest
first, which is what makes best fit good.

Pieces are dealt at random into independent groups of about ``GROUP``
sequences, each packed in one task, so a group wastes less than one sequence in
``GROUP`` and no task grows with the corpus. Full pieces are sequences of their
own and take no part.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm import textkit as tk
from graphloom.llm.common import materialize, table, tidy

CAPACITY = 4096
GROUP = 4096
END = 1
CACHE = 1 << 26  # bytes of words and ids that a worker remembers, with ENTRY for each
ENTRY = 200
#: a run of letters and a run of ASCII marks without the apostrophe, which may begin a token with letters
_CORE = re.compile(rb"([A-Za-z\x80-\xff]+)([!-&(-/:-@\[-`{-~]*)")
LOOK = 8  # levels of room that are compared; a sequence beyond them fits worse


class WordTokens:
    """Token ids of texts, word by word: with this vocabulary no token and no merge crosses a white space."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        pieces = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(pieces.values()) + 1, bool)
        self.ends[[i for piece, i in pieces.items() if piece.endswith("</w>")]] = True
        self.known: dict[bytes, bytes] = {}
        self.cores: dict[bytes, bytes] = {}
        self.held = 0

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Little-endian 32-bit ids of UTF-8 texts, parted at their ASCII white space."""
        words = [text.split() for text in texts]
        known = self.learn(set().union(*words))
        return [b"".join(map(known.__getitem__, x)) for x in words]

    def learn(self, words: set[bytes]) -> dict[bytes, bytes]:
        """A dictionary that has all of ``words``; a word of letters and marks is two tokens' worth, whatever its ASCII case."""
        if self.held > CACHE:
            # new dictionaries, so that a text at work keeps those it has
            self.known, self.cores, self.held = {}, {}, 0
        known, cores = self.known, self.cores
        parted = {}
        for word in words.difference(known):
            found = _CORE.fullmatch(word)
            parted[word] = (found[1].lower(), found[2]) if found and (word.isascii() or found[1].decode().lower().isalpha()) else (word,)
        plain = list({parts[0] for parts in parted.values() if len(parts) > 1}.difference(cores))
        # letter runs are one unit each to the tokenizer, so many of them can be one text, parted after ends of words
        texts = [b" ".join(plain[i : i + 256]).decode() for i in range(0, len(plain), 256)]
        ids = np.concatenate([np.zeros(0, "<u4"), *(np.array(found.ids, "<u4") for found in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False))])
        ends, raw = np.flatnonzero(self.ends[ids]) + 1, ids.tobytes()
        if len(ends) == len(plain):
            stops = [0, *(4 * ends).tolist()]
            cores.update(zip(plain, (raw[i:j] for i, j in zip(stops, stops[1:], strict=False)), strict=True))
        new = list({part for parts in parted.values() for part in parts}.difference(cores))
        for part, found in zip(new, self.tokenizer.encode_batch_fast([w.decode() for w in new], add_special_tokens=False), strict=True):
            cores[part] = np.array(found.ids, "<u4").tobytes()
        for word, parts in parted.items():
            known[word] = b"".join(map(cores.__getitem__, parts))
            self.held += 2 * (len(word) + len(known[word]) + ENTRY)
        return known


_CODERS: dict[str, WordTokens] = {}  # a worker serves many tasks


def coder_of(path: str) -> WordTokens:
    if path not in _CODERS:
        _CODERS[path] = WordTokens(path)
    return _CODERS[path]


def vocabulary() -> str:
    """The file of the public word-end BPE."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """row_key, doc_id, piece, start, length, ids_crc32: texts as ids and END, cut only where longer than ``capacity``."""

    def cut(batches):
        coder = coder_of(path)
        end = np.array([END], "<u4").tobytes()
        for batch in batches:
            out = []
            # the new words of a block of texts go to the tokenizer together
            for i, j, _, _ in tk.blocks(batch.column(2), 4 * tk.BLOCK):
                keys, ids, texts = (batch.column(c).slice(i, j - i).to_pylist() for c in range(3))
                for key, doc, coded in zip(keys, ids, coder.encode([t or b"" for t in texts]), strict=True):
                    coded += end
                    for k in range(0, len(coded) // 4, capacity):
                        part = coded[4 * k : 4 * (k + capacity)]
                        out.append((key, doc, k // capacity, k, len(part) // 4, zlib.crc32(part)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["row_key", "doc_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.monotonically_increasing_id().alias("row_key"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(tidy(cut), "row_key long, doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(length: np.ndarray, capacity: int, max_pieces: int, max_cost: float, rule: str = "dot", weights: tuple[float, float, float] = (1.0, 0.1, 0.1)) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each piece, in any order given; a piece alone always fits."""
    sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
    room: list[list[int]] = [[] for _ in range(capacity + 1)]  # sequences by tokens left
    filled = np.zeros(capacity + 2, bool)  # which of them are not empty
    used: list[list[float]] = []  # tokens, pieces, cost of each sequence
    scale = (capacity, max_pieces, max_cost)
    w = [x / s for x, s in zip(weights, scale, strict=True)]
    for i in np.argsort(-length, kind="stable"):
        n = int(length[i])
        need = (n, 1, float(n) * n)
        best, value, looked, left = -1, 0.0, 0, n
        while looked < LOOK:
            step = int(filled[left:].argmax())
            left += step
            if not filled[left]:
                break
            for s in reversed(room[left][-LOOK:]):
                u = used[s]
                rest = (capacity - u[0], max_pieces - u[1], max_cost - u[2])
                if rest[1] < 1 or rest[2] < need[2]:
                    continue
                if rule == "dot":  # the tightest sequence has the smallest product with the need
                    v = -sum(a * a * r * q for a, r, q in zip(w, rest, need, strict=True))
                else:
                    v = -sum((a * (r - q)) ** 2 for a, r, q in zip(w, rest, need, strict=True))
                if best < 0 or v > value:
                    best, value = s, v
            looked += 1
            left += 1
            if left > capacity:
                break
        if best < 0 and looked:  # room in tokens, but the sequences seen are at another limit: look at all of them
            best = next((s for level in room[n:] for s in level if used[s][1] < max_pieces and used[s][2] + need[2] <= max_cost), -1)
        if best < 0:
            best = len(used)
            used.append([0, 0, 0.0])
        else:
            level = int(capacity - used[best][0])
            room[level].remove(best)
            filled[level] = bool(room[level])
        u = used[best]
        sequence[i], offset[i] = best, u[0]
        u[0], u[1], u[2] = u[0] + n, u[1] + 1, u[2] + need[2]
        level = int(capacity - u[0])
        if u[1] < max_pieces and level:
            room[level].append(best)
            filled[level] = True
    return sequence, offset


def pack(parts: DataFrame, capacity: int = CAPACITY, max_pieces: int | None = None, max_cost: float | None = None, rule: str = "dot", group: int = GROUP) -> DataFrame:
    """``parts`` with sequence_id and offset. Without limits of their own, pieces and cost are bound by the tokens alone."""
    max_pieces, max_cost = max_pieces or capacity, max_cost or float(capacity) ** 2
    whole = F.col("length") >= capacity
    tokens = parts.filter(~whole).agg(F.sum("length")).first()[0] or 0
    groups = max(1, round(tokens / capacity / group))

    def packed(key, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", "doc_id", "row_key", "piece"], ascending=[False, True, True, True])
        s, at = best_fit(frame["length"].to_numpy(), capacity, max_pieces, max_cost, rule)
        return frame.drop(columns="dealt").assign(sequence_id=(np.int64(key[0]) << np.int64(36)) + s, offset=at)

    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in parts.schema)}, sequence_id long, offset long"
    small = parts.filter(~whole).withColumn("dealt", F.pmod(F.xxhash64("row_key", "piece"), F.lit(groups)))
    alone = parts.filter(whole).withColumns({"sequence_id": F.lit(-1) - F.col("row_key") * F.lit(1 << 20) - F.col("piece"), "offset": F.lit(0).cast("long")})
    return small.groupBy("dealt").applyInPandas(packed, schema).unionByName(alone)


def pack_documents(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is its end token alone. Repeated rows and ids have
    pieces of their own, null ids too; other columns are not read, whatever
    their names. An empty table gives an empty table.
    """
    parts = materialize(pieces(docs, path or vocabulary(), id_col, text_col), "packing-pieces")
    return pack(parts, **limits).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def query(spark, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
