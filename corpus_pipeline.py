"""Documents to packed sequences: quality rules, line dedup, n-gram Jaccard join, substring dedup, packing.

Each stage takes (spark, docs, sf_dir); all but the last return the columns of docs. Texts that a stage shortens get a new
n_chars, and documents that had words and are left without one go. Null texts are kept until the packing, which gives them
the end id alone; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docspring.llm import common, jaccard_join, line_dedup, packing, quality, substring_dedup
from docspring.llm.queries import vocabulary


#: Near copies share 80 % of their runs of five words.
SHINGLE, PERCENT = 5, 80
#: Repeats of more words than this go whatever the number of their lines.
LINE_WORDS = 50


def counted(docs: DataFrame, columns: list[str]) -> DataFrame:
    """With these columns alone, n_chars (if it is one of them) counting the text as it is now."""
    return docs.select(*(F.length("text").cast(docs.schema["n_chars"].dataType).alias(c) if c == "n_chars" else F.col(c) for c in columns))


def has_word() -> Column:
    return F.col("text").rlike(common.WORD)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines above their host's limits are taken out, and documents that fail the base rules or are depleted go: null and
    empty texts among them. Rows of one host and text are judged alike; a null source is a host of its own."""
    return counted(quality.without_limited(docs), docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeats of three lines, of shorter runs of more than LINE_WORDS words and of whole shorter documents are deleted;
    documents that had words and keep none go. Null texts stay; equal rows of one id are one document and stay alike; a null
    id comes last."""
    found = line_dedup.line_dedup(docs, words=LINE_WORDS)
    return counted(found.where((F.col("__gone") == 0) | has_word()), docs.columns)


def join_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies the documents of the least id stay; repeated rows of that id all do. Texts without a
    word, and rows without an id, stay."""
    return jaccard_join.one_of_each(docs, PERCENT, SHINGLE)


def dedup_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words that a repeated window of 35 covers go, at all its places; documents that are left without a word go, while null
    texts and those without words before stay. Repeated rows repeat each other's windows."""
    found = substring_dedup.substring_dedup(docs)
    return counted(found.where((F.col("__removed") == 0) | (F.col("__removed") < F.col("__words"))), docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all rows, repeated ones each; a null or empty text is its end id alone."""
    return packing.pack_documents(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", dedup_lines),
    ("n-gram jaccard join", join_near_copies),
    ("substring dedup", dedup_substrings),
    ("packing", pack),
]

#: Tokenising and packing have no SQL; tests/llm/test_queries.py holds the whole run against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of what the stages before the packing leave of documents; each stage's table goes when the next is written, and
    the tables of its operator when its own is."""
    docs, before = common.documents(spark, sf_dir), None
    for name, stage in STAGES[:-1]:
        scratch = common.Scratch(spark)
        with common.collected() as used:
            docs = scratch.stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        for held in used:
            held.drop()
        if before is not None:
            before.drop()
        before = scratch
    return STAGES[-1][1](spark, docs, sf_dir)
