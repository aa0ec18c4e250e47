"""Benchmark passages in documents, found by SimHash windows (built-in functions only)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Words of a shingle; an item of fewer words is one shingle of all its words.
SHINGLE = 5
SIMILARITY = 0.8
#: Differing bits up to which the Hamming blocks find every pair. A pair of similarity 0.8
#: has a cosine of 0.89 and so about 10 of 64 bits (standard deviation 3).
RADIUS = 23
#: Benchmark shingles that are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def words(text: Column) -> Column:
    """Runs of letters and digits, lower-cased."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingles(w: str, size: int = SHINGLE) -> Column:
    """Hashes of the shingles of ``size`` words of an array column; none where there are fewer words."""
    each = F.transform(
        F.sequence(F.lit(0), F.size(w) - size), lambda i: F.xxhash64(*(F.get(F.col(w), i + k) for k in range(size)))
    )
    return F.when(F.size(w) >= size, each).otherwise(F.array().cast("array<bigint>"))


def _sized(w: str, k: str, sizes: list[int]) -> Column:
    """The shingles of the size that the column ``k`` names, one of ``sizes``."""
    return reduce(lambda rest, n: F.when(F.col(k) == n, shingles(w, n)).otherwise(rest), sizes, shingles(w))


def _simhash(hashes: str) -> Column:
    """64 bits: 1 where over half the hashes have it."""
    return F.expr(
        f"aggregate(sequence(0, 63), 0L, (acc, b) -> acc | "
        f"if(size(filter({hashes}, h -> getbit(h, b) = 1)) * 2 > size({hashes}), shiftleft(1L, b), 0L))"
    )


def _blocks(fp: str, radius: int) -> Column:
    """The fingerprint's bits in ``radius + 1`` blocks: within the radius, one block at least is equal."""
    cuts = [64 * k // (radius + 1) for k in range(radius + 2)]
    return F.array(
        *(F.shiftrightunsigned(F.col(fp), x).bitwiseAND(F.lit((1 << y - x) - 1)) for x, y in zip(cuts, cuts[1:], strict=False))
    )


def _bag(hashes: str) -> Column:
    """A set that stands for the bag: each repeat of a hash gets a hash of its own."""
    repeats = f"transform({hashes}, (h, i) -> xxhash64(h, size(filter(slice({hashes}, 1, i), y -> y = h))))"
    once = f"transform({hashes}, h -> xxhash64(h, 0))"
    return F.expr(f"if(size(array_distinct({hashes})) = size({hashes}), {once}, {repeats})")


def _starts(similarity: float) -> Column:
    """Starts of an item's windows that begin at a matched shingle and match often enough.

    ``ps`` has the sorted places of the document's shingles that the item has too. A window
    moved right to its first matched shingle, or to the document's end, loses no match, so
    one of these has the highest similarity of all. Of c matches in bags of x and y shingles
    the similarity is c / (x + y - c) at most, which gives the matches a window needs; the
    k-th place and the one that many places on tell whether it has them.
    """
    m, n = F.col("n_words") - F.col("k") + 1, F.col("n") - F.col("k") + 1
    last = F.greatest(F.lit(0), n - m)
    least = F.greatest(F.lit(1), F.ceil((m + F.least(m, n)) * (similarity / (1 + similarity)) - 1e-6).cast("int"))
    begun = F.filter("ps", lambda p, i: (p <= last) & (F.get("ps", i + least - 1) <= p + m - 1))
    at_end = F.when(F.get("ps", F.size("ps") - least) >= last, F.array(last)).otherwise(F.array().cast("array<int>"))
    return F.array_union(begun, at_end)


def fingerprinted(benchmark: DataFrame) -> DataFrame:
    """item_id, n_words, k (words of a shingle), ih (shingle hashes), ifp (SimHash) of the items with words."""
    split = benchmark.where("text is not null").select("item_id", words(F.col("text")).alias("w")).withColumn("n_words", F.size("w")).where("n_words > 0")
    sized = split.withColumn("k", F.least(F.col("n_words"), F.lit(SHINGLE))).withColumn("ih", _sized("w", "k", list(range(1, SHINGLE))))
    return sized.select("item_id", "n_words", "k", "ih", _simhash("ih").alias("ifp"))


def near_items(windows: DataFrame, items: DataFrame, radius: int = RADIUS, hint=lambda df: df) -> DataFrame:
    """``windows`` (n_words, k, wh, wfp and more) joined with each item of their size within the radius.

    The index is on (size, block number, block value) alone: within ``radius`` differing
    bits, one of ``radius + 1`` blocks at least is equal. All bits are then compared, and a
    pair that agrees on several blocks is kept at the first of them.
    """
    left = windows.select("*", F.posexplode_outer(_blocks("wfp", radius)).alias("b", "v"))
    right = items.select("item_id", "n_words", "ih", "ifp", _blocks("ifp", radius).alias("iv"), F.posexplode_outer(_blocks("ifp", radius)).alias("b", "v"))
    return (
        left.join(hint(right), ["n_words", "b", "v"])
        .withColumn("hamming", F.bit_count(F.col("wfp").bitwiseXOR(F.col("ifp"))))
        .where(F.col("hamming") <= radius)
        .withColumn("dv", _blocks("wfp", radius))
        .where(F.expr("b = array_position(zip_with(dv, iv, (d, i) -> d = i), true) - 1"))
        .drop("dv", "iv", "b", "v")
    )


def _matches(docs: DataFrame, benchmark: DataFrame, similarity: float, radius: int) -> DataFrame:
    """(doc_id, copy, item_id, similarity, hamming, start_word) of each window that counts."""
    items = written(fingerprinted(benchmark))
    sizes = [r["k"] for r in items.select("k").distinct().collect()]  # five values at most
    short = sorted(k for k in sizes if k < SHINGLE)
    probe = items.select("item_id", "n_words", "k", F.explode_outer(F.array_distinct("ih")).alias("h"))
    hint = F.broadcast if probe.count() <= BROADCAST_ROWS else (lambda x: x)

    coded = docs.select("doc_id", F.xxhash64("text").alias("copy"), words(F.col("text")).alias("w"))
    hits = [
        coded.select("doc_id", "copy", F.size("w").alias("n"), F.posexplode_outer(shingles("w", k)).alias("p", "h"))
        .join(hint(probe.where(F.col("k") == k)), "h")
        .select("doc_id", "copy", "item_id", "k", "n", "n_words", "p")
        for k in short + [SHINGLE]
    ]
    placed = reduce(DataFrame.unionByName, hits).groupBy("doc_id", "copy", "item_id", "k", "n", "n_words").agg(F.array_sort(F.collect_set("p")).alias("ps"))
    windows = written(placed.select("doc_id", "copy", "k", "n_words", F.explode(_starts(similarity)).alias("s")).distinct())
    wanted = windows.groupBy("doc_id", "copy").agg(F.collect_list(F.struct("k", "n_words", "s")).alias("windows"))
    same = F.col("l.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("l.copy") == F.col("r.copy"))
    again = docs.select("doc_id", F.xxhash64("text").alias("copy"), "text").alias("l").join(wanted.alias("r"), same)
    again = again.select("l.doc_id", "l.copy", "windows", words(F.col("text")).alias("w"))
    # each size's shingles are made once a document, its windows are cut from them
    by_size = F.array(*(F.struct(F.lit(k).alias("k"), shingles("w", k).alias("h")) for k in short + [SHINGLE]))
    found = again.select("doc_id", "copy", by_size.alias("dh"), "windows").select("doc_id", "copy", "dh", F.explode("windows").alias("x"))
    own = F.get(F.filter("dh", lambda x: x["k"] == F.col("x.k")), F.lit(0))["h"]
    cut = found.select("doc_id", "copy", "x.n_words", "x.s", own.alias("h"), F.col("x.k").alias("k")).select(
        "doc_id", "copy", "n_words", "s", F.expr("slice(h, s + 1, n_words - k + 1)").alias("wh")
    )
    fp = written(cut.withColumn("wfp", _simhash("wh")))
    scored = near_items(fp, items, radius, hint).withColumn("x", _bag("wh")).withColumn("y", _bag("ih"))
    common = F.size(F.array_intersect("x", "y"))
    return scored.select(
        "doc_id", "copy", "item_id", (common / (F.size("x") + F.size("y") - common)).alias("similarity"), "hamming", F.col("s").alias("start_word")
    ).where(F.col("similarity") >= similarity)


def contamination(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """Rows (doc_id, item_id, similarity, hamming, start_word), one for each document and item it holds.

    A window has as many words as an item. Windows stand where a shingle of the benchmark
    begins and enough others of its item follow; no other window can reach the similarity,
    so this leaves none out. Each window's SimHash meets the items of its size through an
    index of Hamming blocks, which finds all within ``radius`` differing bits; those count
    if the weighted Jaccard similarity of the shingles, each weighted by how often it
    occurs, is ``similarity`` or more. The best window is reported, of equals the first.

    Shingles have five words. An item of fewer words is one shingle, found wherever those
    words stand in a row. Null or empty texts and items match nothing; empty tables give no
    rows. Of rows repeated under one doc_id, and of repeated items, the best counts.
    Documents without a doc_id are told apart by their text and reported together, as one
    row an item with a null doc_id. Texts are used whole; a document's windows are listed
    in one row, as its words are, so a very long one needs memory for its own words only.
    Other columns are ignored.
    """
    scored = _matches(docs, benchmark, similarity, radius)
    best = F.max(F.struct("similarity", (-F.col("hamming")).alias("h"), (-F.col("start_word")).alias("s"))).alias("b")
    return scored.groupBy("doc_id", "item_id").agg(best).select(
        "doc_id", "item_id", F.round("b.similarity", 6).alias("similarity"), (-F.col("b.h")).alias("hamming"), (-F.col("b.s")).alias("start_word")
    )


def without_passages(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item.

    All rows of a doc_id go if one holds an item; of rows without a doc_id, those that do.
    """
    found = _matches(docs, benchmark, similarity, radius)
    held = written(found.select("doc_id", _own(F.col("doc_id"), F.col("copy")).alias("copy")).distinct())
    same = F.col("l.doc_id").eqNullSafe(F.col("r.doc_id")) & (_own(F.col("l.doc_id"), F.xxhash64("l.text")) == F.col("r.copy"))
    return docs.alias("l").join(held.alias("r"), same, "left_anti").select(docs.columns)


def _own(doc_id: Column, copy: Column) -> Column:
    """What tells rows without a doc_id apart."""
    return F.when(doc_id.isNull(), copy).otherwise(0)
