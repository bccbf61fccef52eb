"""A corpus from raw documents to packed windows, in five stages.

Each stage takes (spark, docs, sf_dir), works on every row that its predecessor kept, and returns a DataFrame; all but the last
return the columns of documents, whatever these are. SQL can express neither the ranking, the flow nor the packing, so there is no ORACLE_SQL.

In every stage a null text counts as empty, a null doc_id is kept as it is, a text of any length is read whole, and an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from deskdb.llm.common import documents, saved
from deskdb.llm.exact_dedup import without_copies
from deskdb.llm.mixing import mixed
from deskdb.llm.packing import pack_documents
from deskdb.llm.quality import CUT, train, with_scores
from deskdb.llm.simhash import one_of_similar


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; it learns from labelled documents of this input.

    Repeated rows get one score, so all stay or all go; so do rows of equal texts. Without labels of both kinds all rows stay.
    """
    ranking = train(docs, documents(spark, sf_dir, "labels"))
    return with_scores(docs, ranking, "__dd_score").filter(F.col("__dd_score") >= CUT).drop("__dd_score")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts (white space aside): the longest, then the smallest doc_id, null last; of rows repeated in full, one."""
    return without_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates (sets of 5-word shingles with a similarity of 0.8 or more, found by fingerprints): the smallest doc_id,
    null last, then the first row. Rows without words are near-duplicates of each other.
    """
    return one_of_similar(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it: not at all, once or twice.

    A null source is one of its own. Repeated rows count as documents of their own. Ties go by a seeded hash, then size and row. Documents without words go.
    """
    return mixed(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, each with its ids (2 bytes each where the vocabulary allows it) and its place in a window of 2048 tokens; in order of offset they make the window.

    Rows that the mix repeats are packed each by itself; pieces of one length are in order of doc_id (null first), start and row. A document without text is its end id.
    """
    return pack_documents(docs, with_ids=True)


STAGES = [("quality", quality), ("exact dedup", exact), ("near dedup", near), ("mixing", mixing), ("packing", packing)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
