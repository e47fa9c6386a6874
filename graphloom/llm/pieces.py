"""SentencePiece n-best encoding, and decoding.

The pieces and scores of a model file span a lattice over a text. A forward
Viterbi pass gives every place the best score from the start; those scores are
exact heuristics for an A* search from the end, which takes the next best
segmentation out of the queue each time. The text is the model's: a space
before it, spaces as U+2581. A character that no piece holds costs ``UNKNOWN``
more than the worst piece and is coded by its byte pieces, so decoding gives
back every text. Scores are used as the file has them (a merge rank for a BPE
file), and a segmentation's score is their sum; of equal ones that with the longer last
piece counts as best.

Two places keep this fast without changing a result. No piece spans certain
pairs of characters, so the lattice falls apart there, and its parts are
remembered. And of a text's parts only the n - 1 whose second best loses least
can differ from their best in any of the n best segmentations.
"""

from __future__ import annotations

import heapq
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm import textkit as tk
from graphloom.llm.common import table, tidy

N_BEST = 3
UNKNOWN = 10.0
CACHE = 1 << 27  # bytes of words and ids that a worker remembers, with ENTRY for each
ENTRY = 250
SPACE = "▁"


class Lattice:
    """A model file's pieces, and the searches over them."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        self.bytes_of, self.raw = {}, []
        normal = {}
        for i, piece in enumerate(model.pieces):
            raw = piece.piece.replace(SPACE, " ").encode()
            if piece.type == 6:
                raw = bytes([int(piece.piece[3:5], 16)])
                self.bytes_of[raw[0]] = i
            elif piece.type in (1, 4):
                normal[piece.piece] = (piece.score, i)
            else:
                raw = b""
            self.raw.append(raw)
        self.pieces = normal
        self.longest = max(map(len, normal))
        self.worst = min(score for score, _ in normal.values()) - UNKNOWN
        # pieces, and False for what only begins one
        self.starts = {p[:k]: False for p in normal for k in range(1, len(p))} | normal
        self.pairs = {p[k : k + 2] for p in normal for k in range(len(p) - 1)}
        self.parts: dict[str, tuple] = {}  # part -> (score, ids, loss of the second best)
        self.words: dict[str, tuple] = {}
        self.held = 0

    def edges(self, part: str) -> list[list[tuple[int, float, tuple]]]:
        """For each place the pieces that end there: (start, score, ids)."""
        n, into = len(part), [[] for _ in range(len(part) + 1)]
        get = self.pieces.get
        for i in range(n):
            for j in range(i + 1, min(n, i + self.longest) + 1):
                found = get(part[i:j])
                if found:
                    into[j].append((i, found[0], (found[1],)))
                elif j == i + 1:
                    into[j].append((i, self.worst, tuple(self.bytes_of[b] for b in part[i].encode())))
        return into

    def n_best(self, part: str, n: int) -> list[tuple[float, bytes]]:
        """The n best (score, ids), best first: forward Viterbi, then A* from the end.

        No place is left more than n times, for the n best ways to the end pass
        it at most so often; with equal scores the queue prefers what is nearer
        to the start.
        """
        into = self.edges(part)
        ahead = [0.0] * len(into)
        for j in range(1, len(into)):
            ahead[j] = max(ahead[i] + score for i, score, _ in into[j])
        queue, made = [(-ahead[-1], len(part), 0, 0.0, None)], 0
        left = [0] * len(into)
        found: list[tuple[float, bytes]] = []
        while queue and len(found) < n:
            _, j, _, done, way = heapq.heappop(queue)
            if j == 0:
                ids: list[int] = []
                while way:
                    ids += way[0]
                    way = way[1]
                found.append((done, array("I", ids).tobytes()))
                continue
            if left[j] == n:
                continue
            left[j] += 1
            for i, score, own in into[j]:
                made += 1
                heapq.heappush(queue, (-(done + score + ahead[i]), i, made, done + score, (own, way)))
        return found

    def _part(self, part: str) -> tuple:
        """(score, ids, loss of the second best or None): the two best scores of every place, and the way of the best."""
        found = self.parts.get(part)
        if found is not None:
            return found
        get, longest, none, n = self.starts.get, self.longest, -1e300, len(part)
        best, second, way = [none] * (n + 1), [none] * (n + 1), [(0, None)] * (n + 1)
        best[0] = 0.0
        for i in range(n):
            first, other = best[i], second[i]
            for j in range(i + 1, (i + longest if i + longest < n else n) + 1):
                piece = get(part[i:j])
                if not piece:
                    if j > i + 1:
                        if piece is None:
                            break
                        continue
                    piece = (self.worst, None)
                value = first + piece[0]
                if value > best[j]:
                    second[j], best[j], way[j] = best[j], value, (i, piece[1])
                elif value > second[j]:
                    second[j] = value
                value = other + piece[0]
                if value > second[j]:
                    second[j] = value
        ids: list[int] = []
        j = len(part)
        while j:
            i, piece = way[j]
            if piece is None:
                ids.extend(self.bytes_of[b] for b in reversed(part[i].encode()))
            else:
                ids.append(piece)
            j = i
        ids.reverse()
        found = self.parts[part] = (best[-1], array("I", ids).tobytes(), best[-1] - second[-1] if second[-1] > -1e290 else None)
        return found

    def _word(self, word: str) -> tuple:
        """As ``_part``, of a word, in two parts where no piece spans its last letter and the marks after it."""
        core = word.rstrip(_MARKS)
        k = len(core)
        if not core or k == len(word) or word[k - 1 : k + 1] in self.pairs:
            return self._part(word)
        parts = self._part(core), self._part(word[k:])
        losses = [p[2] for p in parts if p[2] is not None]
        return sum(p[0] for p in parts), b"".join(p[1] for p in parts), min(losses) if losses else None

    def encode(self, text: str, n: int) -> list[tuple[float, bytes]]:
        """The n best segmentations of a text, best first: (score, ids as little-endian 32-bit numbers)."""
        if not text:
            return [(0.0, b"")]
        words = _WORD.findall(SPACE + text.replace(" ", SPACE))
        known = self.words
        try:
            coded = list(map(known.__getitem__, words))
        except KeyError:
            if self.held > CACHE:
                self.parts, self.words, self.held = {}, {}, 0
                known = self.words
            for word in set(words):
                if word not in known:
                    known[word] = self._word(word)
                    self.held += 2 * (4 * len(word) + len(known[word][1]) + ENTRY)
            coded = list(map(known.__getitem__, words))
        score = sum(c[0] for c in coded)
        loose = heapq.nsmallest(n - 1, ((c[2], k) for k, c in enumerate(coded) if c[2] is not None))
        loose.sort(key=lambda x: x[1])
        choices = []
        for _, k in loose:  # the best as remembered, and then others
            others = [c for c in self.n_best(words[k], n) if c[1] != coded[k][1]]
            choices.append([(coded[k][0], coded[k][1]), *others][:n])
        # A* over the loose words from the last one: what is ahead is their best
        ahead = [0.0]
        for c in choices:
            ahead.append(ahead[-1] + c[0][0])
        queue, picks = [(-ahead[-1], (), 0.0)], []
        while queue and len(picks) < n:
            _, chosen, done = heapq.heappop(queue)
            i = len(choices) - len(chosen)
            if i == 0:
                picks.append((done - ahead[-1], chosen))
                continue
            for k, (s, _) in enumerate(choices[i - 1]):
                heapq.heappush(queue, (-(done + s + ahead[i - 1]), (k, *chosen), done + s))
        out = []
        for loss, chosen in picks:
            ids, at = [], 0
            for (_, k), choice, options in zip(loose, chosen, choices, strict=True):
                ids += [*(c[1] for c in coded[at:k]), options[choice][1]]
                at = k + 1
            out.append((score + loss, b"".join([*ids, *(c[1] for c in coded[at:])])))
        return out

    def decode(self, ids: bytes) -> str:
        """The text that a segmentation came from."""
        raw = b"".join(map(self.raw.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        return raw[1:].decode(errors="replace") if ids else ""


#: spaces and what follows them: pieces with a space inside are all spaces
_WORD = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~\n\r\t"
_LATTICES: dict[str, Lattice] = {}


def lattice_of(path: str) -> Lattice:
    if path not in _LATTICES:
        _LATTICES[path] = Lattice(path)
    return _LATTICES[path]


def vocabulary() -> str:
    """The file of the public piece BPE with byte fallback."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def segment_documents(docs: DataFrame, n: int = N_BEST, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_pieces, score, ids (best), and scores, ids_crc32 of the n best, round_trip of every row.

    A null or empty text has one segmentation, without pieces. A text holding
    U+2581 itself is coded as if that were a space, as the model does, and its
    round_trip compares with spaces in its place. Repeated rows and ids keep a
    row each, a null id stays null, and other columns, whatever their names,
    are not read.
    """
    path = path or vocabulary()

    def coded(batches):
        lattice = lattice_of(path)
        for batch in batches:
            for i, j, _, _ in tk.blocks(batch.column(1)):
                out = []
                for text in batch.column(1).slice(i, j - i).to_pylist():
                    text = text or ""
                    best = lattice.encode(text, n)
                    back = all(lattice.decode(ids) == text.replace(SPACE, " ") for _, ids in best[:1])
                    out.append((len(best[0][1]) // 4, best[0][0], best[0][1], [s for s, _ in best], [zlib.crc32(ids) for _, ids in best], back))
                kinds = (pa.int64(), pa.float64(), pa.binary(), pa.list_(pa.float64()), pa.list_(pa.int64()), pa.bool_())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *(pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True))], ["doc_id", "n_pieces", "score", "ids", "scores", "ids_crc32", "round_trip"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(tidy(coded), "doc_id long, n_pieces long, score double, ids binary, scores array<double>, ids_crc32 array<long>, round_trip boolean")


def decode_documents(coded: DataFrame, path: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and text of every row of ids (unsigned little-endian 32-bit numbers of pieces), as ``segment_documents`` gives them.

    Null ids give a null text, no ids an empty one. Ids that aren't whole
    numbers of 32 bits or that no piece has fail the job, and bytes that are
    not UTF-8, which no text's own ids give, become U+FFFD. Rows of any length
    are decoded whole; repeated rows and null ids of documents keep a row each,
    an empty table gives an empty table, and other columns are not read.
    """
    path = path or vocabulary()

    def decoded(batches):
        lattice = lattice_of(path)
        for batch in batches:
            texts = [None if ids is None else lattice.decode(ids) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    rows = coded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("binary").alias("ids"))
    return rows.mapInArrow(tidy(decoded), "doc_id long, text string")


def query(spark, sf_dir: str) -> DataFrame:
    return segment_documents(table(spark, sf_dir, "documents")).drop("ids")
