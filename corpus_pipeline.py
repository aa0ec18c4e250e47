"""Corpus pipeline: language, exact and near duplicates, benchmark passages, packing.

Each stage reads all that the one before it kept. All but the last return the columns of
``documents``; the last returns the pieces of packed sequences. All stages take whole texts
of any length, empty tables and tables with more columns, whatever their names; the stages
before the last pass those on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trapline.llm import decontaminate, exact_dedup, language, packing, simhash
from trapline.llm.common import shared_dir, table
from trapline.llm.queries import MIXTURE, word_bpe

#: Documents of a lower score are in no language that the filters know.
LEAST_SCORE = 0.25


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without letters or in no known language.

    A null or empty text has no letters and goes. Rows are judged one by one by their text,
    so repeated rows and null doc_ids share its fate; a row without a doc_id may be learnt from.
    Of languages that tie, the first by name counts. If no row has a language to learn, none
    is known and all go.
    """
    model = language.fit(docs.where(~language.held_out("doc_id")))
    return language.keep_known(docs, model, LEAST_SCORE)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of equal texts: the one with most code points, then the smallest doc_id, nulls last.

    Null texts equal the empty one. Of rows that agree in all this the first stays. Rows are
    told apart by number, so another text under the same doc_id is left alone.
    """
    return exact_dedup.keep_first(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each SimHash component: the smallest doc_id, nulls last, then the first.

    Texts that are null or have no words have one fingerprint and so are one component. Rows
    are told apart by number, as in the stage before.
    """
    return simhash.keep_first(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that hold a benchmark item.

    Null and empty texts hold none. All rows of a doc_id go if one of them holds an item;
    rows without one are judged each by its own text. An empty benchmark rejects nothing.
    """
    return decontaminate.without_passages(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 4,096 tokens, at the target mixture of the sources.

    A null text is empty and packs as the end id. Repeated rows, and rows of one doc_id or of
    none, are packed each for itself. A null source is a source.
    """
    return packing.pack(docs, word_bpe(), mixture=MIXTURE)


STAGES = [
    ("language_id", language_id),
    ("exact_duplicates", exact_duplicates),
    ("near_duplicates", near_duplicates),
    ("benchmark_passages", benchmark_passages),
    ("pack", pack),
]

#: Packing needs the tokenizer, which SQL lacks; tests/llm holds a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again as the next input."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
