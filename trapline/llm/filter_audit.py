"""What each of several filters removes, in every order they could run in."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import salted_join, written

#: The characters of ``[\x20\x09-\x0D]``.
BLANKS = " \t\n\x0b\x0c\r"
MARKS = r"[#$%&*|]"
#: One letter a filter, in the order of the bits of a mask.
LETTERS = "ABCDE"
LEAST_WORDS = 50
#: Percent of words that differ at least, and of code points that are capitals at most.
DISTINCT, CAPITALS = 65, 5
_COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]


def own_failures(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` with ``own``, the mask of the filters that need the column ``text`` only: A to D.

    Steps are columns of their own, so each is evaluated once. An empty text has one word
    here, which is empty: it fails A and not B, as with none.
    """
    split = docs.withColumn("_words", F.split(F.btrim(F.col(text), F.lit(BLANKS)), r"[\x20\x09-\x0D]+"))
    sized = split.withColumn("_n", F.size("_words")).withColumn("_distinct", F.size(F.array_distinct("_words"))).drop("_words")
    capitals = F.char_length(F.regexp_replace(text, "[^A-Z]+", ""))
    fails = [F.col("_n") < LEAST_WORDS, 100 * F.col("_distinct") < DISTINCT * F.col("_n"), 100 * capitals > CAPITALS * F.char_length(text), F.col(text).rlike(MARKS)]
    mask = sum((F.when(x, 1 << i).otherwise(0) for i, x in enumerate(fails)), F.lit(0))
    return sized.withColumn("own", mask).drop("_n", "_distinct")


def flagged(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, part, mask. Bit i of the mask tells that the filter of letter i fails.

    E fails a document whose text is that of any document with a smaller doc_id, removed or
    not. Texts are compared by their SHA-256; the smallest doc_id of each text is found by
    a grouping with partial sums and joined back over salts, so a text with a third of all
    rows is in no task alone. Rows of one doc_id are no copies of each other. A row without
    a doc_id comes neither before nor after another, so it does not fail E, nor do others
    because of it. A null text is empty (no words, so it fails A and no other but E).
    """
    texts = docs.select(docs["doc_id"].alias("doc_id"), F.coalesce(docs["source"], F.lit("")).alias("part"), F.coalesce(docs["text"], F.lit("")).alias("text"))
    rows = written(own_failures(texts, "text").select("doc_id", "part", "own", F.unhex(F.sha2("text", 256)).alias("digest")))
    known = rows.where("doc_id is not null")
    texts = written(known.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")))
    told = salted_join(known, texts.select("digest", "first"), ["digest"], texts.select("digest", "n"), ["doc_id"])
    told = told.select("doc_id", "part", (F.col("own") + F.when(F.col("doc_id") > F.col("first"), 1 << 4).otherwise(0)).alias("mask"))
    return told.unionByName(rows.where("doc_id is null").select("doc_id", "part", F.col("own").alias("mask")))


def cells(flags: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents of each part and mask, and those labelled so.

    Of several labels of a document one is enough. Documents without a doc_id have none.
    """
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic")
    )
    some = flags.where("doc_id is not null").join(marks, "doc_id", "left")
    none = flags.where("doc_id is null").select("*", F.lit(0).alias("good"), F.lit(0).alias("toxic"))
    count = lambda c: F.sum(F.coalesce(F.col(c), F.lit(0)).cast("long")).alias(c)
    return some.unionByName(none).groupBy("part", "mask").agg(F.count("*").alias("n"), count("good"), count("toxic"))


def _folded(cell: str, orders: str) -> str:
    """SQL: structs of ``_COUNTS`` and the filter ``f``, weighted by the cell, for each step of each order."""
    fails = f"(shiftright({cell}.mask, f) & 1) = 1"
    step = f"""named_struct('f', f,
        'kept', if(acc.alive and not {fails}, {cell}.n, 0L),
        'removed', if(acc.alive and {fails}, {cell}.n, 0L),
        'redundant', if(not acc.alive and {fails}, {cell}.n, 0L),
        'unique_fails', if({cell}.mask = shiftleft(1, f), {cell}.n, 0L),
        'good_lost', if(acc.alive and {fails}, {cell}.good, 0L),
        'toxic_lost', if(acc.alive and {fails}, {cell}.toxic, 0L))"""
    kind = f"array<struct<f: int, {', '.join(f'{c}: bigint' for c in _COUNTS)}>>"
    return f"""flatten(transform({orders}, o -> aggregate(o,
        named_struct('alive', true, 'steps', cast(array() as {kind})),
        (acc, f) -> named_struct('alive', acc.alive and not {fails}, 'steps', array_append(acc.steps, {step})),
        acc -> acc.steps)))"""


def audit(counted: DataFrame, letters: str = LETTERS) -> DataFrame:
    """One row per part, order of the filters and step, from the ``cells`` of any filters.

    Each cell folds across the array of all orders, a constant that is broadcast with the
    plan: a flag tells whether documents of its mask are still there, and each step adds
    a struct of counts weighted by the cell's. A part has at most 2 to the number of filters
    cells; their arrays are merged by elementwise sums. ``shapley`` is what the step's
    filter removes in all orders together. Parts of no documents have no rows.
    """
    names = ["".join(p) for p in permutations(letters)]
    orders = f"array({', '.join('array(' + ', '.join(str(letters.index(c)) for c in name) + ')' for name in names)})"
    zero = f"array_repeat(named_struct('f', 0, {', '.join(f"'{c}', 0L" for c in _COUNTS)}), {len(names) * len(letters)})"
    added = ", ".join(f"'{c}', x.{c} + y.{c}" for c in _COUNTS)
    merged = f"aggregate(cells, {zero}, (all, cell) -> zip_with(all, {_folded('cell', orders)}, (x, y) -> named_struct('f', y.f, {added})))"
    by_filter = f"transform(sequence(0, {len(letters) - 1}), k -> aggregate(steps, 0L, (total, x) -> total + if(x.f = k, x.removed, 0L)))"
    parts = counted.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    told = parts.select("part", F.expr(merged).alias("steps")).select("part", "steps", F.expr(by_filter).alias("shapley"))
    each = told.select("part", "shapley", F.posexplode("steps").alias("at", "s"))
    order = F.element_at(F.array(*(F.lit(n) for n in names)), F.expr(f"int(at div {len(letters)})") + 1)
    return each.select(
        "part", order.alias("filter_order"), (F.col("at") % len(letters) + 1).alias("step"), *(F.col(f"s.{c}").alias(c) for c in _COUNTS),
        F.get("shapley", F.col("s.f")).alias("shapley"),
    )


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of filters A to E over ``docs``, a part for each source (null: empty).

    Nulls, repeated rows and labels: see :func:`flagged` and :func:`cells`. Texts are whole,
    of any length. An empty table has no parts and so no rows. Other columns are ignored,
    whatever their names.
    """
    return audit(cells(flagged(docs), labels))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (
  SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
         min(doc_id) OVER (PARTITION BY t) AS first_id FROM d),
f AS (
  SELECT doc_id, part,
         [len(ws) < 50, 100 * len(list_distinct(ws)) < 65 * len(ws),
          100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 5 * length(t),
          regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > first_id, false)] AS fails
  FROM w),
l AS (
  SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY 1),
c AS (
  SELECT part, fails, count(*) AS n, count(*) FILTER (l.good) AS good, count(*) FILTER (l.toxic) AS toxic
  FROM f LEFT JOIN l USING (doc_id) GROUP BY 1, 2),
x AS (SELECT unnest([1, 2, 3, 4, 5]) AS i),
o AS (
  SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM x a, x b, x c, x d, x e
  WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
s AS (
  SELECT part, o, x.i AS step, o[x.i] AS fi, fails, n, good, toxic,
         coalesce(list_position(list_transform(o, lambda k: fails[k]), true), 6) AS gone,
         len(list_filter(fails, lambda y: y)) AS many
  FROM c, o, x),
r AS (
  SELECT part, list_aggregate(list_transform(o, lambda k: substr('ABCDE', k::INT, 1)), 'string_agg', '') AS filter_order, step::INT AS step, fi,
         coalesce(sum(n) FILTER (gone > step), 0)::BIGINT AS kept,
         coalesce(sum(n) FILTER (gone = step), 0)::BIGINT AS removed,
         coalesce(sum(n) FILTER (fails[fi] AND gone < step), 0)::BIGINT AS redundant,
         coalesce(sum(n) FILTER (fails[fi] AND many = 1), 0)::BIGINT AS unique_fails,
         coalesce(sum(good) FILTER (gone = step), 0)::BIGINT AS good_lost,
         coalesce(sum(toxic) FILTER (gone = step), 0)::BIGINT AS toxic_lost
  FROM s GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, fi))::BIGINT AS shapley FROM r
"""
