"""Near duplicates: SimHash fingerprints linked through vantage-point trees with overlapping shards."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import connected_components, in_arrow, salted_join, written

RADIUS = 3
#: A shard of more rows than this is split by another level of trees.
LEAF = 32_768
#: Bits not measured yet that a further split needs: with fewer, points that share a shard are few.
SPLIT_BITS = 16
_MASK64 = (1 << 64) - 1
#: Vantage points, arbitrary but fixed (multiples of the 64-bit golden ratio); one a level of a tree.
VANTAGE = [(k * 0x9E3779B97F4A7C15) & _MASK64 for k in range(1, 5)]
_STEP = 1 << 16


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of a UTF-8 text's word shingles, each as often as it occurs."""
    words = text.lower().split()  # bytes: A-Z and [\x20\x09-\x0D] only
    if not words:
        return 0
    if len(words) < shingle:
        return xxh64_intdigest(b" ".join(words), seed)
    total = len(words) - shingle + 1
    votes = np.zeros(64, dtype=np.int64)
    for at in range(0, total, _STEP):
        part = words[at : at + _STEP + shingle - 1]
        grams = map(b" ".join, zip(*(part[k:] for k in range(shingle)), strict=False))
        codes = np.fromiter(map(xxh64_intdigest, grams, repeat(seed)), dtype="<u8")
        bits = np.unpackbits(codes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * votes > total, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1).cast(pa.binary()).to_pylist()
        codes = np.fromiter((fingerprint(t or b"") for t in texts), dtype=np.uint64, count=len(texts))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(codes.view(np.int64))], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp: the fingerprint as a signed 64-bit integer. Null text: zero."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").transform(in_arrow, _fingerprints, f"doc_id {kind}, fp long")


def halves(bits: int) -> tuple[int, int]:
    """The set bits of a mask in two runs of nearly equal size."""
    each = [b for b in range(64) if bits >> b & 1]
    cut = len(each) // 2
    return sum(1 << b for b in each[:cut]), sum(1 << b for b in each[cut:])


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def shards(points: DataFrame) -> DataFrame:
    """(leaf, rest, fp, home): the shards of vantage-point trees that each point is in or asks.

    ``points`` has (leaf, region, rest, fp): a shard so far, the bits to measure next and
    those not measured yet. Of two halves of the bits, one has at most one of a pair's 3
    differing bits, so each half has a tree of its own with radius 1. A node sends a point
    to the child of its distance to the level's vantage point over the half's bits. By the
    triangle inequality a partner's distance differs by at most 1, and by exactly 1 where
    the half differs (one bit more or less), so a point is at home in one shard and asks
    just those one ring away at every level; all other branches are pruned. Each pair meets
    once: the point nearer to the first vantage point asks.
    """
    path = F.lit(0).cast("long")
    for vantage in VANTAGE:
        ring = F.bit_count(F.col("fp").bitwiseXOR(F.lit(_signed(vantage))).bitwiseAND(F.col("region")))
        path = path * 128 + ring + 1
    aside = [128**3 + a * 128**2 + b * 128 + c for a in (-1, 1) for b in (-1, 1) for c in (-1, 1)]
    steps = F.array(*(F.lit(x).cast("long") for x in (0, *aside)))
    each = points.withColumn("path", path).withColumn("step", F.explode(steps))
    leaf = F.xxhash64("leaf", "region", F.col("path") + F.col("step"))
    return each.select(leaf.alias("leaf"), "rest", "fp", (F.col("step") == 0).alias("home"))


def stars(points: np.ndarray) -> Iterator[tuple[int, int]]:
    """Links (smallest, other) that join the points within the radius of each other.

    Breadth first from the smallest point not reached; points whose distance to the
    root differs from the frontier's range by more than the radius are not compared.
    """
    rest = np.sort(points)
    while rest.size > 1:
        root, rest = rest[0], rest[1:]
        frontier = np.array([root], dtype=np.uint64)
        ring = np.bitwise_count(rest ^ root).astype(np.int16)
        reach = np.zeros(1, dtype=np.int16)
        while frontier.size and rest.size:
            near = (ring >= reach.min() - RADIUS) & (ring <= reach.max() + RADIUS)
            at = np.flatnonzero(near)
            hit = np.zeros(at.size, dtype=bool)
            for k in range(0, frontier.size, 256):
                hit |= (np.bitwise_count(frontier[k : k + 256, None] ^ rest[at][None, :]) <= RADIUS).any(axis=0)
            at = at[hit]
            frontier, reach = rest[at], ring[at]
            yield from zip(repeat(int(root)), frontier.tolist())
            keep = np.ones(rest.size, dtype=bool)
            keep[at] = False
            rest, ring = rest[keep], ring[keep]


def near(homes: np.ndarray, others: np.ndarray) -> Iterator[tuple[int, int]]:
    """Links that join the points of a shard: homes within the radius of each other or of others.

    At most four times as many links as points; where there are more, stars take their place.
    """
    points = np.concatenate([homes, others])
    hit = np.zeros(points.size, dtype=bool)
    few: list[tuple[np.ndarray, np.ndarray]] = []
    many = 0
    for k in range(0, homes.size, 64):
        own = homes[k : k + 64, None]
        apart = np.bitwise_count(own ^ points[None, :])
        x, y = np.nonzero((apart <= RADIUS) & (apart > 0))
        hit[k + x] = hit[y] = True
        many += x.size
        if many <= 4 * points.size:
            few.append((homes[k + x], points[y]))
    if many > 4 * points.size:
        return stars(np.unique(points[hit]))
    return (pair for a, b in few for pair in zip(a.tolist(), b.tolist(), strict=True))


_OUT = ["todo", "a", "b", "region", "rest"]
_LINKS = "todo boolean, a long, b long, region long, rest long"


def _link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(leaf, rest, fp, home), sorted by leaf, to links, or to points of a next level where a shard is too large."""

    def out(rows: list) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [[]] * 5
        kinds = [pa.bool_(), *[pa.int64()] * 4]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=_OUT)

    def close(parts: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple]:
        fp, home = (np.concatenate(x) for x in zip(*parts, strict=True))
        if home.any() and fp.size > 1:
            yield from ((False, _signed(x), _signed(y), 0, 0) for x, y in near(fp[home], fp[~home]))

    def split(fp: np.ndarray, leaf: int, rest: int) -> Iterator[tuple]:
        one, two = halves(rest & _MASK64)
        for region, left in ((one, two), (two, one)):
            yield from zip(repeat(True), repeat(leaf), fp.view(np.int64).tolist(), repeat(_signed(region)), repeat(_signed(left)))

    held: tuple[int, int] | None = None
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    count, large = 0, False
    for batch in batches:
        leaf, rest, fp = (batch.column(k).to_numpy() for k in range(3))
        home = batch.column(3).to_numpy(zero_copy_only=False)
        fp = fp.view(np.uint64)
        edge = np.flatnonzero(leaf[1:] != leaf[:-1]) + 1
        starts, ends = np.r_[0, edge], np.r_[edge, leaf.size]
        rows: list = []
        for x, y in zip(starts.tolist(), ends.tolist(), strict=True):
            now = (int(leaf[x]), int(rest[x]))
            if now != held:
                if parts:
                    rows += close(parts)
                held, parts, count, large = now, [], 0, False
            if large:
                rows += split(fp[x:y], *now)
                continue
            parts.append((fp[x:y], home[x:y]))
            count += y - x
            if count > LEAF and (now[1] & _MASK64).bit_count() >= SPLIT_BITS:
                large = True
                rows += split(np.concatenate([p for p, _ in parts]), *now)
                parts = []
        if rows:
            yield out(rows)
    if parts:
        rows = list(close(parts))
        if rows:
            yield out(rows)


def fingerprint_links(points: DataFrame) -> DataFrame:
    """(a, b) pairs of distinct fingerprints within the radius that connect all that are.

    A chain of links, not all pairs: what the radius joins, the links join.
    """
    one, two = (F.lit(_signed(x)) for x in halves(_MASK64))
    first = F.array(F.struct(one.alias("region"), two.alias("rest")), F.struct(two.alias("region"), one.alias("rest")))
    todo = points.select(F.lit(0).cast("long").alias("leaf"), "fp", F.explode(first).alias("h")).select("leaf", "h.region", "h.rest", "fp")
    found = None
    while True:
        placed = shards(todo).repartition("leaf").sortWithinPartitions("leaf", "rest")
        step = written(in_arrow(placed, _link, _LINKS))
        links = step.where("not todo").select("a", "b")
        found = links if found is None else found.unionByName(links)
        todo = step.where("todo").select(F.col("a").alias("leaf"), "region", "rest", F.col("b").alias("fp")).distinct()
        if todo.isEmpty():
            return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _components(coded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(fp, low) and (fp, n) of the written ``coded``: the least doc_id of all rows reachable, and the rows of each fingerprint."""
    points = written(coded.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count("*").alias("n")))
    roots = written(connected_components(fingerprint_links(points.select("fp"))).withColumnRenamed("node", "fp"))
    linked = points.join(roots, "fp")
    names = linked.groupBy("root").agg(F.min("low").alias("name"))
    sizes = linked.groupBy("root").agg(F.count("*").alias("n"))
    named = salted_join(linked.select("fp", "root"), names, ["root"], sizes, ["fp"]).select("fp", "name")
    return points.join(named, "fp", "left").select("fp", F.coalesce("name", "low").alias("low")), points.select("fp", "n")


def simhash_groups(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id.

    component_id is the smallest doc_id reachable over links of at most 3 differing bits.
    A null text or one without words has fingerprint zero and links like any other. Null
    doc_ids are ignored when a component is named; a component of none but those has a null
    name. Repeated rows give repeated rows, empty in gives empty out. Whole texts count,
    very long ones piece by piece. Other columns are ignored.

    Work after the fingerprints is on distinct fingerprints, so exact copies cost nothing,
    and names are told back with the rows of a common fingerprint dealt over many tasks.
    """
    coded = written(fingerprints(docs))
    told, counts = _components(coded)
    return salted_join(coded, told, ["fp"], counts, ["doc_id"]).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("low").alias("component_id")
    )


def keep_first(docs: DataFrame) -> DataFrame:
    """One row of each component of :func:`simhash_groups`, with all columns of ``docs``.

    The row with the smallest doc_id stays, of equal ids and of null ones, which come last,
    the row met first. Rows are numbered in a written copy and only numbers of rows that
    go are joined with it, so a row is never lost because another has its doc_id.
    """
    name = "_number"
    while name in docs.columns:
        name = f"_{name}"
    numbered = written(docs.withColumn(name, F.monotonically_increasing_id()))
    place = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"), F.col(name).alias("r"))
    coded = written(fingerprints(numbered.select(place.alias("doc_id"), "text")))
    told, counts = _components(coded)
    verdict = salted_join(coded, told, ["fp"], counts, ["doc_id"])
    gone = verdict.where(F.col("doc_id.r") != F.col("low.r")).select(F.col("doc_id.r").alias(name))
    return numbered.join(gone, name, "left_anti").select(*docs.columns)
