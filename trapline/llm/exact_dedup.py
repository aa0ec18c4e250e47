"""Exact duplicates by a tree merge of digest runs (built-in functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: The characters of ``[\x20\x09-\x0D]``.
BLANKS = " \t\n\x0b\x0c\r"
_KEY = ["text_sha256", "_check", "_size"]


def _best():
    """Most code points, then the smallest identifier (nulls last), then the row's number."""
    return F.struct(
        (-F.col("_points")).alias("p"), F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"), F.col("_row").alias("r")
    )


def digests(docs: DataFrame, row: Column | None = None) -> DataFrame:
    """doc_id, text_sha256 of the text without blanks, a second hash and the length that verify it; and the row's number."""
    text = F.coalesce(F.col("text"), F.lit(""))
    bare = F.translate(text, BLANKS, "")
    return docs.select(
        F.col("doc_id"),
        F.sha2(bare, 256).alias("text_sha256"),
        F.xxhash64(bare).alias("_check"),
        F.octet_length(bare).alias("_size"),
        F.char_length(text).alias("_points"),
        (F.monotonically_increasing_id() if row is None else row).alias("_row"),
    )


def merged(coded: DataFrame, fan_in: int) -> DataFrame:
    """The written ``digests`` with ``_n`` (rows of the text) and ``_best`` (the row that stays).

    A row's number holds its partition, whose digests are its run. Rounds merge ``fan_in``
    neighbouring runs at a time, until one is left: as many rounds as the partitions need.
    Only digests of more than one row go down the tree again; the others are told apart by
    having no verdict.
    """
    rows = coded.withColumn("_run0", F.shiftright("_row", 33))
    levels, left = 0, rows.agg(F.max("_run0")).first()[0] or 0
    while left:
        levels, left = levels + 1, left // fan_in
    runs = [rows.groupBy("_run0", *_KEY).agg(F.count("*").alias("_n"), F.min(_best()).alias("_best"))]
    for level in range(1, levels + 1):
        below = runs[-1].withColumn(f"_run{level}", F.expr(f"_run{level - 1} div {fan_in}"))
        runs.append(
            below.groupBy(f"_run{level}", *_KEY).agg(F.sum("_n").alias("_n"), F.min("_best").alias("_best"))
        )
    verdict = runs[-1].where("_n > 1")
    for level in range(levels, 0, -1):
        up = f"_run{level}"
        below = runs[level - 1].select(f"_run{level - 1}", *_KEY, F.expr(f"_run{level - 1} div {fan_in}").alias(up))
        verdict = below.join(verdict, [up, *_KEY]).select(f"_run{level - 1}", *_KEY, "_n", "_best")
    told = rows.join(verdict, ["_run0", *_KEY], "left")
    return told.withColumns({"_n": F.coalesce("_n", F.expr("1L")), "_best": F.coalesce("_best", _best())})


def exact_dedup(docs: DataFrame, fan_in: int = 16) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Each partition's digests are a run with one entry a digest: count and best row so far.
    Rounds merge ``fan_in`` runs at a time, as many rounds as the partitions need; digests
    count as equal only if a second 64-bit hash and the length agree, at each level. The
    verdict on digests of more than one row then goes back down the same tree, so no join
    meets more than ``fan_in`` entries of one digest and a text that fills a third of the
    corpus is dealt over all the runs.

    Null texts equal the empty text. Of repeated rows one is kept. A null doc_id loses
    against any other. Other columns of ``docs`` are ignored. Empty in, empty out. Whole
    texts are hashed, however long.
    """
    return merged(written(digests(docs)), fan_in).select(
        "doc_id",
        F.col("_best.d").alias("keep_id"),
        F.col("_n").alias("group_size"),
        (F.col("_row") == F.col("_best.r")).alias("kept"),
        "text_sha256",
    )


def keep_first(docs: DataFrame, fan_in: int = 16) -> DataFrame:
    """The rows of ``docs`` that :func:`exact_dedup` keeps, with all their columns.

    Rows are numbered in a written copy, so rows repeated under one doc_id are told apart
    and of equal ones the first stays; only numbers of rows that go are joined with it.
    """
    name = "_number"
    while name in docs.columns:
        name = f"_{name}"
    numbered = written(docs.withColumn(name, F.monotonically_increasing_id()))
    verdict = merged(written(digests(numbered, F.col(name))), fan_in)
    gone = verdict.where(F.col("_row") != F.col("_best.r")).select(F.col("_row").alias(name))
    return numbered.join(gone, name, "left_anti").select(*docs.columns)


ORACLE = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS pts,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents),
w AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY pts DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM w
"""
