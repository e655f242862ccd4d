"""The stages of the corpus pipeline: (spark, docs, sf_dir) -> DataFrame.

Each works on all rows it is given; all but the last return the columns of
``documents``, further columns of any name included, and give an empty table for
an empty one. Null texts are empty texts, and whole texts are read, whatever
their length. No stage needs unique ids: repeated rows and null ids are rows like
others, except where a stage says otherwise.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def fresh(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` does not have."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the classifier, trained on the labelled rows among these, scores under 0.3.

    Equal texts are dropped or kept alike. Without labels, or with one class of
    them, all scores are alike: 0.5, or the share of ones.
    """
    from . import quality as op

    machine = op.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = fresh(docs, "score")
    return op.scored(docs, machine, out=score).filter(F.col(score) >= 0.3).select(*(F.col(f"`{c}`") for c in docs.columns))


def simhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near-duplicates: that of the smallest id, null ids last, then of the smallest hash of its columns.

    Texts without words, null ones included, are one group.
    """
    from . import simhash as op

    return op.firsts(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts repeated passages from the texts; every document stays, and null texts stay null.

    Every place of a passage is cut, so copies of a text lose all of it.
    """
    from . import repeats as op

    return op.cleaned(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes the mix of sources: a row for each pass over a document, with the words taken; documents without words have none.

    The null source is a source like others; equal ids lie next to each other in
    the order of their sizes.
    """
    from . import mixing as op

    return op.texts(docs)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes what is left with the byte-level vocabulary: the id, the number of tokens and digests of each row; other columns end here."""
    import public_tokenizers

    from . import bpe as op

    return op.encode_column(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, digests=True)
