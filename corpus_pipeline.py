"""From documents to token ids: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

import public_tokenizers as vocab
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.bpe import bpe_encode
from strandline.llm.langid import fit, keep_identified, learning_rows
from strandline.llm.lines import drop_boilerplate
from strandline.llm.mixing import mixed_rows
from strandline.llm.neardup import one_of_each
from strandline.llm.staging import Staging

VOCABULARY = "byte_bpe_50k.tiktoken"


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is determined, with all their columns.

    Rows with a null text, an empty one or one without letters go, whatever
    their other columns; repeated rows stay repeated. Labels of the table
    itself are learnt from; without any only rows without letters go. An empty
    table gives an empty one; very long texts are read whole.
    """
    return keep_identified(docs, fit(docs, learning_rows()))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their source's boilerplate lines; ``n_chars``, if there, follows the text where it changed.

    All rows stay. Null sources are one source; a null text stays null; a page
    of nothing but boilerplate is left whole; repeated rows are pages of their
    own. An empty table gives an empty one.
    """
    if "n_chars" not in docs.columns:
        return drop_boilerplate(docs)
    before = "__before"
    while before in docs.columns:
        before += "_"
    cleaned = drop_boilerplate(docs.withColumn(before, F.length("text")))
    same = F.col(before).eqNullSafe(F.length("text"))
    n_chars = F.when(same, F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType)
    return cleaned.withColumn("n_chars", n_chars).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest id: five-word shingles, similarity 0.8.

    Rows without id, and texts without words, stay. Of rows that repeat an id
    and a text one stays. An empty table gives an empty one.
    """
    return one_of_each(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, with all their columns.

    Null sources are one source; rows without id are drawn by their text, and
    rows that repeat both are taken alike. An empty table gives an empty one.
    """
    return mixed_rows(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with the bytes that they decode to, beside ``doc_id`` and ``source``.

    A null text is encoded as the empty one. Rows stay as often as they are;
    an empty table gives an empty one.
    """
    return bpe_encode(docs, vocab.path(VOCABULARY), vocab.PATTERN, keep=["doc_id", "source"])


STAGES = [
    ("language ID", language_id),
    ("line dedup", line_dedup),
    ("near-dedup", near_dedup),
    ("mixing", mixing),
    ("byte-level BPE", encode),
]

#: Learnt models and token ids have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    staging = Staging(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = staging.save(stage(spark, docs, sf_dir))
    return docs
