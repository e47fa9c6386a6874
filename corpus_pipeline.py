"""Corpus pipeline: toxicity, exact dedup, n-gram Jaccard join, suffix-array dedup, best-fit packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next stage's docs. All but the last
return the columns of documents. Rows are matched by id and, where that
matters, by text, so rows with a null id or a repeated one are not lost.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import toxicity
from graphloom.llm.common import materialize, prepared, table
from graphloom.llm.exact_dedup import keep_last
from graphloom.llm.ngram_join import keep_first
from graphloom.llm.packing import pack_documents
from graphloom.llm.suffix_dedup import remove_repeats


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity models score 0.7 or more go.

    A text is scored whole, a null one as empty; rows that repeat an id or a
    text are judged alike, each for itself. Labels of one class, or none, let
    all rows stay, and an empty table gives an empty one. Other columns are
    carried, whatever their names.
    """
    return toxicity.keep_ordinary(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def keep_one_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays, and one of those that share it.

    A null text counts as empty and a null id as the smallest. An id with two
    texts keeps both. An empty table gives an empty one; other columns are
    carried, whatever their names.
    """
    return keep_last(docs)


def keep_one_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the row with the smallest doc_id stays; texts without words, null ones too, all stay.

    A null id counts as the largest. Rows are told apart by id and text, so of
    an id with two texts each is judged for itself. An empty table gives an
    empty one; other columns are carried, whatever their names.
    """
    return keep_first(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of strings of 100 bytes are cut out of the texts; bytes of a character cut in two go with it.

    All rows stay, those whose text is cut away with an empty one, and null
    texts become empty. Earlier is the smaller doc_id, null first; rows of one
    id are in an order of their own. ``n_chars`` tells the new length where
    something was cut. An empty table gives an empty one; other columns are
    carried, whatever their names.
    """
    cut = remove_repeats(docs)
    # a cut within a character leaves bytes that try_validate_utf8 refuses; make_valid_utf8 marks them, and the mark is taken out
    text = F.when(F.col("n_removed") == 0, F.col("kept").cast("string")).otherwise(
        F.coalesce(F.try_validate_utf8(F.col("kept").cast("string")), F.replace(F.make_valid_utf8(F.col("kept").cast("string")), F.lit("\ufffd"), F.lit("")))
    )
    rest = cut.schema["rest"].dataType.names
    columns = {"doc_id": F.col("doc_id"), "text": text, **{c: F.col(f"rest.`{c}`") for c in rest}}
    if "n_chars" in columns:
        columns["n_chars"] = F.when(F.col("n_removed") == 0, F.col("rest.n_chars")).otherwise(F.length(text)).cast(docs.schema["n_chars"].dataType)
    return cut.select(*(columns[c].alias(c) for c in docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens and their places in sequences: the last stage, so documents' columns end here.

    A null or empty text is one piece of one token; rows that repeat an id or
    a text, or have no id, have pieces of their own. An empty table gives an
    empty one.
    """
    return pack_documents(docs)


STAGES = [
    (name, prepared(stage))
    for name, stage in (
        ("toxicity", drop_toxic),
        ("exact_dedup", keep_one_exact),
        ("ngram_jaccard_join", keep_one_similar),
        ("suffix_array_dedup", cut_repeats),
        ("best_fit_packing", pack),
    )
]

#: Class-conditional models can't be stated in SQL. tests/llm/test_pipeline.py holds exact dedup, near duplicates and cuts against
#: brute force, packing against the tokens there are, and toxicity against labels that a plain rule gave.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
