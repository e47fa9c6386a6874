"""Quality rules as a short-circuit cascade.

A rule looks at a block of texts and tells which of the texts it is asked about
it rejects. On a bounded sample (``SAMPLE`` texts, the smallest by hash of the
id) every rule is run alone: its cost is the time it takes for a byte, its
selectivity the share of texts that it rejects. Rules then run in descending
order of rejection per cost, each only on texts that no earlier rule rejected.
A text is kept if no rule rejects it, so the order changes the work and never
the verdict. The sample only orders the rules; all rows are judged, whole.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm import textkit as tk
from graphloom.llm.common import table, tidy

SAMPLE = 2000
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True


def _per(of: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(of, minlength=n).astype(np.int64)


NUMBERS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


class Block:
    """A few texts; what rules share is worked out when first asked for."""

    def __init__(self, data: np.ndarray, offs: np.ndarray):
        self.data, self.offs, self.n = data, offs, len(offs) - 1

    def pick(self, rows: np.ndarray) -> Block:
        """Only the texts numbered ``rows``."""
        size = np.diff(self.offs)[rows]
        out = Block(np.concatenate([self.data[self.offs[i] : self.offs[i + 1]] for i in rows]) if len(rows) else self.data[:0], np.concatenate([[0], np.cumsum(size)]))
        out.__dict__.update({k: self.__dict__[k][rows] for k in NUMBERS if k in self.__dict__})
        return out

    def counted(self) -> list[np.ndarray]:
        """The numbers of each text that every result has, rejected or not."""
        return [getattr(self, k) for k in NUMBERS]

    def count(self, table: np.ndarray) -> np.ndarray:
        """Bytes of each text that are in ``table``."""
        total = np.concatenate([[0], np.cumsum(table[self.data], dtype=np.int64)])
        return total[self.offs[1:]] - total[self.offs[:-1]]

    @cached_property
    def spans(self):
        return tk.words(self.data, self.offs)

    @cached_property
    def of(self) -> np.ndarray:
        return np.repeat(np.arange(self.n), self.n_words)

    @cached_property
    def hashes(self) -> np.ndarray:
        return tk.span_hashes(self.data, *self.spans[:2])

    @cached_property
    def n_words(self) -> np.ndarray:
        return np.diff(self.spans[2])

    @cached_property
    def word_chars(self) -> np.ndarray:
        points = np.concatenate([[0], np.cumsum((self.data & 0xC0) != 0x80, dtype=np.int64)])
        starts, ends, _ = self.spans
        return np.bincount(self.of, points[ends] - points[starts], self.n).astype(np.int64)

    @cached_property
    def n_symbols(self) -> np.ndarray:
        return self.count(_SYMBOL)

    @cached_property
    def lines(self):
        """(line hashes, text numbers) of lines that hold a word."""
        feed = np.zeros(256, bool)
        feed[10] = True
        starts, ends, ptr = tk.words(self.data, self.offs, ~feed)
        of = np.repeat(np.arange(self.n), np.diff(ptr))
        inked = np.searchsorted(self.spans[0], ends) > np.searchsorted(self.spans[0], starts)
        starts, ends, of = starts[inked], ends[inked], of[inked]
        return tk.span_hashes(self.data, starts, ends), of

    @cached_property
    def n_dup_lines(self) -> np.ndarray:
        h, of = self.lines
        _, at, n = tk.unique_in_group(h, of)
        return np.bincount(at, n - 1, self.n).astype(np.int64)

    @cached_property
    def n_repeat_words(self) -> np.ndarray:
        h, of = self.hashes, self.of
        if len(h) < 3:
            return np.zeros(self.n, np.int64)
        whole = np.flatnonzero(of[2:] == of[:-2])
        window = tk.chain(h[whole], h[whole + 1], h[whole + 2])
        order = np.lexsort((window, of[whole]))
        w, o = window[order], of[whole][order]
        same = (w[1:] == w[:-1]) & (o[1:] == o[:-1])
        twice = np.append(False, same) | np.append(same, False)
        marked = np.zeros(len(h), bool)
        at = whole[order[twice]]
        for k in range(3):
            marked[at + k] = True
        return _per(of[marked], self.n)


#: A rule gives the texts of a block that it rejects.
Rule = Callable[[Block], np.ndarray]

BASE: dict[str, Rule] = {
    "few_words": lambda b: b.n_words < 50,
    "repeated_words": lambda b: 100 * b.n_repeat_words > 50 * b.n_words,
}
CASCADE: dict[str, Rule] = {
    "symbols": lambda b: 4 * b.n_symbols > b.n_words,
    "word_length": lambda b: (b.word_chars < 2 * b.n_words) | (b.word_chars > 15 * b.n_words),
    "duplicate_lines": lambda b: 2 * b.n_dup_lines > _per(b.lines[1], b.n),
    "letters": lambda b: 2 * b.count(tk.LETTERS) < np.diff(b.offs),
    "capitals": lambda b: 2 * b.count(_UPPER) > b.count(tk.LETTERS),
    "exclamations": lambda b: 2 * b.count(_one("!")) > b.n_words,
}


def _one(mark: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[ord(mark)] = True
    return out


def order_rules(texts: pa.Array, rules: dict[str, Rule]) -> list[str]:
    """Names of ``rules`` by rejections per second on those of ``texts`` that the base rules pass, best first.

    A rule's cost is what it adds: the numbers that every result has are paid
    for anyway, so they are worked out before the clock starts.
    """
    rejected, spent = dict.fromkeys(rules, 0), dict.fromkeys(rules, 1e-9)
    for _, _, data, offs in tk.blocks(texts):
        whole = Block(data, offs)
        whole.counted()
        asked = np.flatnonzero(~np.any([rule(whole) for rule in BASE.values()], axis=0))
        for name, rule in rules.items():
            block, began = whole.pick(asked), time.perf_counter()
            rejected[name] += int(rule(block).sum())
            spent[name] += time.perf_counter() - began
    return sorted(rules, key=lambda name: rejected[name] / spent[name], reverse=True)


def cascade(block: Block, rules: dict[str, Rule], order: list[str], asked: np.ndarray) -> np.ndarray:
    """Of each text the place in ``order`` of the rule that rejects it; -1: none did, or it was not asked about."""
    out = np.full(block.n, -1)
    left = np.flatnonzero(asked)
    part = block if len(left) == block.n else None
    for i, name in enumerate(order):
        if not len(left):
            break
        if part is None or len(left) < part.n // 2:
            part, within = block.pick(left), np.arange(len(left))
        elif part is block:
            within = left
        no = rules[name](part)[within]
        out[left[no]] = i
        left, within = left[~no], within[~no]
    return out


def apply_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: dict[str, Rule] | None = None) -> DataFrame:
    """doc_id, the counts, base_failed, kept and rejected_by of every row.

    A null or empty text has no words and fails the base rules. Repeated rows
    keep a row each; ids may be null; other columns are not read, whatever
    their names. An empty table gives an empty table.
    """
    rules = rules or CASCADE
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # ids alone are sorted; the texts of those picked come by a broadcast of at most SAMPLE ids
    picked = rows.select("doc_id").filter("doc_id is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE).collect()
    ids = docs.sparkSession.createDataFrame([(r["doc_id"],) for r in picked], "doc_id long")
    sample = rows.join(F.broadcast(ids), "doc_id", "left_semi").limit(SAMPLE).select(F.coalesce("text", F.lit("")).alias("text")).toArrow()["text"]
    order = order_rules(sample.combine_chunks(), rules)

    def judged(batches):
        for batch in batches:
            for i, j, data, offs in tk.blocks(batch.column(1)):
                b = Block(data, offs)
                counted = b.counted()
                failed = np.any([rule(b) for rule in BASE.values()], axis=0)
                by = cascade(b, rules, order, ~failed)
                names = pa.array(["base" if f else order[k] if k >= 0 else None for f, k in zip(failed, by, strict=True)], pa.string())
                numbers = [pa.array(x.astype(np.int64)) for x in counted]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), *numbers, pa.array(failed), pa.array(~failed & (by < 0)), names],
                    ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rejected_by"],
                )

    return rows.mapInArrow(tidy(judged), "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, rejected_by string")


def query(spark, sf_dir: str) -> DataFrame:
    return apply_rules(table(spark, sf_dir, "documents")).drop("rejected_by")


SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
c AS (
  SELECT *, row_number() OVER () AS r, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, len(l) AS n_lines,
         length(regexp_replace(text, '[^A-Z]', '', 'g')) AS capitals,
         strlen(regexp_replace(text, '[\x00-\x40\x5B-\x60\x7B-\x7F]', '', 'g')) AS letters,
         length(regexp_replace(text, '[^!]', '', 'g')) AS marks, strlen(text) AS n_bytes
  FROM d),
p AS (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM c WHERE len(w) >= 3),
g AS (SELECT r, i, count(*) OVER (PARTITION BY r, w[i], w[i + 1], w[i + 2]) AS n FROM p),
m AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM g WHERE n >= 2) GROUP BY r),
f AS (
  SELECT c.*, coalesce(m.n, 0)::BIGINT AS n_repeat_words,
         n_words < 50 OR 100 * coalesce(m.n, 0) > 50 * n_words AS base_failed
  FROM c LEFT JOIN m USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 4 * n_symbols > n_words OR word_chars < 2 * n_words OR word_chars > 15 * n_words
            OR 2 * n_dup_lines > n_lines OR 2 * letters < n_bytes OR 2 * capitals > letters OR 2 * marks > n_words) AS kept
FROM f
"""
