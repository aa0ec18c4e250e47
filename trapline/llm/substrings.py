"""Repeated substrings by two-stage suffix sorting of text around shared anchors."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, salted_join, written

#: Bytes of a string that counts as repeated.
LENGTH = 400
GRAM = 32
#: Text that is sorted at once; whole anchor groups are gathered until it is reached.
BLOCK_BYTES = 1 << 18
#: A larger group is dealt over smaller ones by more of the bytes around its anchor.
GROUP_BYTES = 1 << 21
#: Ranges of places of an anchor within a string that a large group is split into, level by level.
RANGES = [1, 8, 64, 512]
_STEP = 1 << 22
_P1, _P2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def rolling(data: np.ndarray, size: int, base: np.uint64 = _P1) -> np.ndarray:
    """A 64-bit polynomial hash of each ``size`` bytes in a row."""
    with np.errstate(over="ignore"):
        total, done, power, unit, width = None, 0, base, data.astype(np.uint64) + np.uint64(1), 1
        rest = size
        while rest:
            if rest & 1:
                n = data.size - done - width + 1
                total = unit[:n] if total is None else total[:n] * power + unit[done : done + n]
                done += width
            rest >>= 1
            if rest:
                unit = unit[:-width] * power + unit[width:]
                power, width = power * power, width * 2
        return (total ^ (total >> np.uint64(29))) * _P2


def anchors(data: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, position, first start) of each anchor.

    A string of ``length`` bytes is anchored at the leftmost of its 32-grams with the least
    hash, so equal strings have equal anchors at the same place within them. An anchor
    serves the strings from its first start up to the next anchor's.
    """
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    n, width = len(data), length - gram + 1
    for at in range(0, max(0, n - length + 1), _STEP):
        part = np.frombuffer(data, dtype=np.uint8, count=min(n - at, _STEP + length - 1), offset=at)
        code = rolling(part, gram)
        least = (code & ~np.uint64((1 << 24) - 1)) | np.arange(code.size, dtype=np.uint64)
        span = 1
        while 2 * span <= width:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        rest = width - span
        least = np.minimum(least[: least.size - rest], least[rest:]) if rest else least
        place = (least & np.uint64((1 << 24) - 1)).astype(np.int64)
        first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        found.append((code[place[first]], place[first] + at, first + at))
    if not found:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))  # type: ignore[return-value]


def suffix_order(text: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """Suffixes of ``text`` in the order of their first ``depth`` bytes at least.

    Two stages: only suffixes smaller than their successor are sorted. Buckets of a first
    byte are then scanned in order; each entry puts the suffix before it, where that is
    greater than its successor, behind what its bucket already has.
    """
    n = text.size
    differs = np.flatnonzero(text[:-1] != text[1:])
    following = np.append(differs, n - 1)[np.searchsorted(differs, np.arange(n))]
    smaller = np.zeros(n, dtype=bool)
    inside = following < n - 1
    smaller[inside] = text[following[inside]] < text[following[inside] + 1]
    padded = np.concatenate([text, np.zeros(depth, dtype=np.uint8)])
    direct = np.flatnonzero(smaller)
    windows = np.lib.stride_tricks.sliding_window_view(padded, depth)
    direct = direct[np.argsort(text[direct], kind="stable")]
    bounds = np.searchsorted(text[direct], np.arange(257))
    for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if high - low > 1:  # one first byte at a time, for the copies of the strings
            own = direct[low:high]
            direct[low:high] = own[np.argsort(np.ascontiguousarray(windows[own]).view(f"S{depth}").ravel(), kind="stable")]
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    greater = ~smaller

    def put(entries: np.ndarray, bucket: int) -> np.ndarray:
        """Files the predecessors of entries; returns those of this bucket itself."""
        before = entries[entries > 0] - 1
        before = before[greater[before]]
        letter = text[before]
        own = before[letter == bucket]
        before, letter = before[letter > bucket], letter[letter > bucket]
        order = np.argsort(letter, kind="stable")
        before, letter = before[order], letter[order]
        cut = np.flatnonzero(letter[1:] != letter[:-1]) + 1
        for part in np.split(before, cut) if before.size else ():
            waiting[text[part[0]]].append(part)
        return own

    if n and greater[n - 1]:
        waiting[text[n - 1]].append(np.array([n - 1]))
    out = []
    for bucket in range(256):
        now = np.concatenate(waiting[bucket]) if waiting[bucket] else np.empty(0, np.int64)
        while now.size:
            out.append(now)
            now = put(now, bucket)
        own = direct[bounds[bucket] : bounds[bucket + 1]]
        if own.size:
            out.append(own)
            put(own, bucket)
    return np.concatenate(out) if out else np.empty(0, np.int64)


def same_prefix(text: np.ndarray, x: np.ndarray, y: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """Whether the suffixes at x and y have a common prefix of ``depth`` bytes or more."""
    same = np.ones(x.size, dtype=bool)
    words = np.lib.stride_tricks.sliding_window_view(text, 8)
    alive = np.arange(x.size)
    for at in [0, depth - 8, *range(8, depth - 8, 8)]:
        a = np.ascontiguousarray(words[x[alive] + at]).view(np.uint64).ravel()
        b = np.ascontiguousarray(words[y[alive] + at]).view(np.uint64).ravel()
        equal = a == b
        same[alive[~equal]] = False
        alive = alive[equal]
    return same


def repeated_starts(segments: list[bytes], length: int = LENGTH) -> np.ndarray:
    """For the segments end to end (one byte 0xFF after each): whether the string at each place repeats."""
    text = np.frombuffer(b"\xff".join([*segments, b""]), dtype=np.uint8)
    valid = np.zeros(text.size, dtype=bool)
    at = 0
    for s in segments:
        valid[at : at + len(s) - length + 1] = True
        at += len(s) + 1
    order = suffix_order(text, length)
    order = order[valid[order]]
    out = np.zeros(text.size, dtype=bool)
    if order.size > 1:
        same = same_prefix(text, order[:-1], order[1:], length)
        out[order[:-1][same]] = True
        out[order[1:][same]] = True
    return out


def spans(starts: np.ndarray, length: int = LENGTH) -> list[tuple[int, int]]:
    """Runs covered by strings of ``length`` at ascending starts."""
    if not starts.size:
        return []
    cut = np.flatnonzero(np.diff(starts) > length) + 1
    return [(int(p[0]), int(p[-1]) + length) for p in np.split(starts, cut)]


def _anchored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        code, first, place = [], [], []
        for data in batch.column("data"):
            c, p, f = anchors(data.as_py())
            code.append(c.view(np.int64))
            first.append(f)
            place.append(p)
        lists = [pa.array(x, pa.list_(pa.int64())) for x in (code, first, place)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("text"), batch.column("n_bytes"), *lists], names=["doc_id", "text", "n_bytes", "code", "first", "place"]
        )


#: Pieces of text around an anchor: its bytes start ``at`` these places of ``parent``, the anchor is ``mid`` bytes on.
_PIECES = "code long, pid binary, mid int, size int, parent binary, at array<long>, piece binary"


def _pieces(rows: list[tuple]) -> pa.RecordBatch:
    """Rows (code, piece, mid, parent, at) as _PIECES."""
    code, piece, mid, parent, at = list(zip(*rows, strict=True)) or [[]] * 5
    pid = [hashlib.sha256(p).digest() for p in piece]
    columns = [(code, pa.int64()), (pid, pa.binary()), (mid, pa.int32()), ([len(p) for p in piece], pa.int32()), (parent, pa.binary()), (at, pa.list_(pa.int64())), (piece, pa.binary())]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in columns], names=[x.split()[0] for x in _PIECES.split(", ")])


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text's strings around its repeated anchors, equal ones once with all their places."""
    for batch in batches:
        rows = []
        for key, data, code, low, high, place in zip(*(batch.column(c) for c in ("key", "data", "code", "low", "high", "place")), strict=True):
            data, places = data.as_py(), {}
            for c, x, y, p in zip(code.as_py(), low.as_py(), high.as_py(), place.as_py(), strict=True):
                places.setdefault((c, data[x : y + LENGTH], p - x), []).append(x)
            rows += [(c, piece, mid, key.as_py(), at) for (c, piece, mid), at in places.items()]
        yield _pieces(rows)


def narrower(piece: bytes, mid: int, ranges: int) -> Iterator[tuple[int, bytes, int, int]]:
    """(code, piece, mid, at) of the parts of a piece, its strings split by the anchor's place in them.

    All strings of a range share the bytes around the anchor that the range's first and last
    string both have; the code is their hash, so strings of different codes differ.
    """
    last, width = len(piece) - LENGTH, -(-LENGTH // ranges)
    start = 0
    while start <= last:
        number = (mid - start) // width  # the anchor is mid - start bytes into the string
        end = min(last, mid - number * width)
        left, right = mid - number * width, mid - (number + 1) * width + 1 + LENGTH
        core = piece[left:right]
        code = int.from_bytes(hashlib.blake2b(core, digest_size=8, salt=f"{ranges}-{number}".encode()).digest(), "little", signed=True)
        yield code, piece[start : end + LENGTH], mid - start, start
        start = end + 1


_FOUND = "pid binary, low long, high long"


def _sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct pieces, sorted by code, to the runs of each that repeat; whole groups are sorted at once."""

    def settle(block: dict[bytes, tuple[bytes, bool]]) -> pa.RecordBatch:
        rows: list[tuple] = []
        flags = repeated_starts([piece for piece, _ in block.values()])
        at = 0
        for pid, (piece, many) in block.items():
            size = len(piece) - LENGTH + 1
            starts = np.arange(size) if many else np.flatnonzero(flags[at : at + size])
            at += len(piece) + 1
            rows += [(pid, low, high) for low, high in spans(starts)]
        columns = list(zip(*rows, strict=True)) or [[]] * 3
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.binary(), pa.int64(), pa.int64()), strict=True)], names=["pid", "low", "high"])

    block: dict[bytes, tuple[bytes, bool]] = {}
    held, size = None, 0
    for batch in batches:
        for code, pid, piece, many in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            if code != held and size >= BLOCK_BYTES:
                yield settle(block)
                block, size = {}, 0
            held = code
            block[pid] = (piece, many)
            size += len(piece) + 1
    if block:
        yield settle(block)


def _runs(pieces: DataFrame, level: int = 0) -> DataFrame:
    """(parent, low, high): runs of the parents' bytes that repeat, found in ``pieces`` (a written table of _PIECES).

    Equal pieces are sorted once. A code's distinct pieces are one group of a suffix array;
    groups of over GROUP_BYTES are split by more bytes around the anchor and settled alike,
    at the last level by whole strings, of which a group has one.
    """
    named = pieces.groupBy("code", "pid").agg(F.min("parent").alias("parent"), F.sum(F.size("at")).alias("places"), F.count("*").alias("n"), F.max("size").alias("size"))
    named = written(named)
    large = written(named.groupBy("code").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).where((F.col("bytes") > GROUP_BYTES) & (F.col("n") > 1)).select("code"))
    once = pieces.join(named.select("pid", "parent", "places"), ["pid", "parent"]).select("code", "pid", "piece", (F.col("places") > 1).alias("many"), "mid")
    some = not large.isEmpty() and level + 1 < len(RANGES)
    ready = once.join(large, "code", "left_anti") if some else once
    runs = written(in_arrow(ready.select("code", "pid", "piece", "many").repartition("code").sortWithinPartitions("code"), _sort, _FOUND))
    if some:

        def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = []
                for pid, piece, many, mid in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                    # a piece of several places stands for itself and another
                    rows += [(code, part, m, pid, [at, at] if many else [at]) for code, part, m, at in narrower(piece, mid, RANGES[level + 1])]
                yield _pieces(rows)

        parts = written(in_arrow(once.join(large, "code", "left_semi").select("pid", "piece", "many", "mid"), split, _PIECES))
        runs = runs.unionByName(_runs(parts, level + 1).withColumnRenamed("parent", "pid"))
    listed = written(runs.groupBy("pid").agg(F.collect_set(F.struct("low", "high")).alias("runs")))
    told = salted_join(pieces.select("pid", "parent", "at"), listed, ["pid"], named.select("pid", "n"), ["parent"])
    placed = told.select("parent", F.explode(F.array_distinct("at")).alias("x"), "runs").select("parent", "x", F.explode("runs").alias("r"))
    return placed.select("parent", (F.col("x") + F.col("r.low")).alias("low"), (F.col("x") + F.col("r.high")).alias("high"))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        removed, runs, kept = [], [], []
        for data, each in zip(batch.column("data"), batch.column("runs"), strict=True):
            data, end, parts, gone, n = data.as_py(), 0, [], 0, 0
            low = high = None
            merged: list[list[int]] = []
            for run in sorted((r["low"], r["high"]) for r in each.as_py()):
                low, high = run
                if merged and low <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], high)
                else:
                    merged.append([low, high])
            for low, high in merged:
                parts.append(data[end:low])
                gone, n, end = gone + high - low, n + 1, high
            parts.append(data[end:])
            removed.append(gone)
            runs.append(n)
            kept.append(b"".join(parts))
        digest = [hashlib.sha256(k).hexdigest() for k in kept]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(k) for k in ("doc_id", "text_key")), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(digest), pa.array(kept, pa.binary())],
            names=["doc_id", "text_key", "n_removed", "n_spans", "kept_sha256", "kept"],
        )


def _rows(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", text.cast("binary").alias("data"), F.sha2(text, 256).alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))


def _same_row(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """``left`` (as l) and ``right`` (as r) joined by doc_id, null or not, and the text's digest."""
    same = F.col("l.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("l.text") == F.col("r.text"))
    return left.alias("l").join(right.alias("r"), same, how)


def repeated_spans(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, runs): per document its text's digest, copies and key; per key its repeated runs.

    A run is bytes [low, high) covered by strings of 400 bytes that start elsewhere too.
    Equal texts are one key: they are sorted once. Texts are cut at anchors, which depend on
    400 bytes alone, so that strings that repeat meet in one group; anchors that occur
    once end there. Groups are sorted in blocks, each by a two-stage suffix array, and
    strings of at least 400 common bytes are neighbours in it.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = written(
        in_arrow(_rows(docs), _anchored, f"doc_id {kind}, text string, n_bytes long, code array<long>, first array<long>, place array<long>")
        .withColumn("row", F.monotonically_increasing_id())
    )
    texts = written(found.groupBy("text").agg(F.min("row").alias("row"), F.count("*").alias("copies")))
    single = found.join(texts.select("row"), "row", "left_semi").where(F.col("n_bytes") >= LENGTH)
    each = single.select(
        "row", F.posexplode_outer("code").alias("k", "code"), "first", "place", "n_bytes"
    ).select(
        "row", "code", F.get("first", F.col("k")).alias("low"), F.get("place", F.col("k")).alias("place"),
        F.coalesce(F.get("first", F.col("k") + 1) - 1, F.col("n_bytes") - LENGTH).alias("high"),
    )
    each = written(each)
    shared = each.groupBy("code").agg(F.count("*").alias("n")).where("n > 1")
    shared = written(shared)
    repeated = salted_join(each, shared.select("code"), ["code"], shared, ["row"])
    wanted = repeated.groupBy("row").agg(F.collect_list(F.struct("low", "high", "code", "place")).alias("a"))
    key = F.concat(F.lit(b"k"), F.col("row").cast("string").cast("binary"))
    wanted = wanted.join(found.select("row", "doc_id", "text"), "row").select(
        "doc_id", "text", key.alias("key"), *(F.col(f"a.{c}").alias(c) for c in ("code", "low", "high", "place"))
    )
    source = _same_row(_rows(docs), wanted, "inner").select("key", "data", "code", "low", "high", "place")
    runs = _runs(written(in_arrow(source, _segments, _PIECES)))
    rows = salted_join(found.select("doc_id", "text", "n_bytes", "row"), texts.withColumnRenamed("row", "first"), ["text"], texts.select("text", F.col("copies").alias("n")), ["row"])
    rows = rows.select("doc_id", "text", "n_bytes", "copies", F.concat(F.lit(b"k"), F.col("first").cast("string").cast("binary")).alias("key"))
    return rows, runs.withColumnRenamed("parent", "key")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept.

    Removes each byte of a text's UTF-8 that a 400-byte string covers which also starts
    anywhere else in the corpus or the text. ``kept`` is what remains, null where nothing
    was removed. Null texts are empty. Repeated rows count as copies of each other. A row
    without a doc_id is a document like any other. Empty in, empty out; other columns are
    ignored. Texts are whole; one task holds a text and, of a very long one, hashes of 4 MB
    at a time.
    """
    rows, runs = repeated_spans(docs)
    runs = written(runs.groupBy("key").agg(F.collect_list(F.struct("low", "high")).alias("runs")))
    copied = (F.col("copies") > 1) & (F.col("n_bytes") >= LENGTH)
    some = rows.where(~copied).join(runs, "key")
    kind = docs.schema["doc_id"].dataType.simpleString()
    cut = (
        _same_row(_rows(docs), some.select("doc_id", "text", "runs"), "inner").select("l.doc_id", F.col("l.text").alias("text_key"), "data", "runs")
        .transform(in_arrow, _cut, f"doc_id {kind}, text_key string, n_removed long, n_spans long, kept_sha256 string, kept binary")
    )
    empty = F.sha2(F.lit(""), 256)
    joined = _same_row(rows, cut.withColumnRenamed("text_key", "text"), "left")
    return joined.select(
        "l.doc_id", "n_bytes",
        F.when(copied, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.expr("0L"))).alias("n_removed"),
        F.when(copied, F.expr("1L")).otherwise(F.coalesce("n_spans", F.expr("0L"))).alias("n_spans"),
        F.when(copied, empty).otherwise(F.coalesce("kept_sha256", F.col("l.text"))).alias("kept_sha256"),
        F.when(copied, F.expr("X''")).otherwise(F.col("kept")).alias("kept"),
    )
