"""Word windows that an earlier document has too, found by super-k-mers."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, salted_join, written

#: Words of a window, and of the grams of which the least in a window is its minimiser.
WINDOW, GRAM = 13, 4
#: Texts of a bucket that is sorted by one task; the windows of larger buckets are dealt one by one.
BUCKET = 2000
#: Bytes of strings that are sorted at once, if their buckets allow.
BLOCK_BYTES = 1 << 21
#: Bytes of text that are cut into words at once; a longer text is cut whole.
_SLICE = 1 << 21
_STEP = 1 << 20
_LONG_WORD = 256
_P1, _P2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
with np.errstate(over="ignore"):
    _POWERS = np.cumprod(np.r_[np.uint64(1), np.full(_LONG_WORD, _P1)], dtype=np.uint64)
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[32, *range(9, 14)]] = True
_NONE = np.iinfo(np.int64).max


def _mixed(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(31))) * _P2
        return h ^ (h >> np.uint64(29))


def words(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first byte, end, text) of each word of texts that lie end to end and end at ``ends``."""
    blank = _BLANK[data]
    begin = np.r_[0, ends[:-1]]
    edge = np.zeros(data.size + 1, dtype=bool)
    edge[begin] = edge[ends] = True
    start = np.flatnonzero(~blank & (np.r_[True, blank][:-1] | edge[:-1]))
    end = np.flatnonzero(~blank & (np.r_[blank, True][1:] | edge[1:])) + 1
    return start, end, np.searchsorted(ends, start, side="right")


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, a function of its bytes alone."""
    out = np.zeros(start.size, dtype=np.uint64)
    at = 0
    with np.errstate(over="ignore"):
        while at < start.size:
            to = max(at + 1, int(np.searchsorted(start, start[at] + _STEP)))
            s, e = start[at:to], np.minimum(end[at:to], start[at:to] + _LONG_WORD)
            size = e - s
            place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            value = (data[np.repeat(s, size) + place].astype(np.uint64) + np.uint64(1)) * _POWERS[place]
            out[at:to] = np.add.reduceat(value, np.cumsum(size) - size)
            at = to
    for i in np.flatnonzero(end - start > _LONG_WORD).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    return _mixed(out)


def super_kmers(code: np.ndarray, text: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, first, last): runs of windows, by their first words, that share a minimiser.

    ``code`` and ``text`` are each word's hash and text. A window's minimiser is the leftmost
    of its grams with the least hash, so equal windows have equal minimisers at the same
    place within them; the key is that gram's hash. Windows do not cross texts.
    """
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    n, grams = code.size, window - gram + 1
    low = np.uint64((1 << 24) - 1)
    for at in range(0, max(0, n - window + 1), _STEP):
        h, t = code[at : at + _STEP + window - 1], text[at : at + _STEP + window - 1]
        key = np.zeros(h.size - gram + 1, dtype=np.uint64)
        with np.errstate(over="ignore"):
            for k in range(gram):
                key = key * _P1 + h[k : h.size - gram + 1 + k]
        key = _mixed(key)
        least = (key & ~low) | np.arange(key.size, dtype=np.uint64)
        span = 1
        while 2 * span <= grams:
            least, span = np.minimum(least[:-span], least[span:]), 2 * span
        if grams > span:
            least = np.minimum(least[: least.size - (grams - span)], least[grams - span :])
        place = (least & low).astype(np.int64)
        inside = t[: place.size] == t[window - 1 :]
        new = np.r_[True, (place[1:] != place[:-1]) | (t[1 : place.size] != t[: place.size - 1])] & inside
        first = np.flatnonzero(new)
        # a run ends before the next one begins, or with the last window of its text
        stop = np.append(first[1:], place.size)
        counted = np.r_[0, np.cumsum(inside)]
        found.append((key[place[first]], first + at, first + at + counted[stop] - counted[first] - 1))
    if not found:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))  # type: ignore[return-value]


def _slices(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from, to, bytes, ends) of texts in a row that are about _SLICE bytes together."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + _SLICE, side="right")) - 1)
        yield at, to, data[ends[at] : ends[to]], ends[at + 1 : to + 1] - ends[at]
        at = to


def _cut_slice(data: np.ndarray, ends: np.ndarray):
    """(words' first bytes, ends, texts; keys, first and last windows, texts of the super-k-mers)."""
    start, end, text = words(data, ends)
    key, first, last = super_kmers(word_hashes(data, start, end), text)
    return start, end, text, key.view(np.int64), first, last, text[first] if first.size else first


def _grouped(values: np.ndarray, group: np.ndarray, groups: int, kind: pa.DataType) -> pa.Array:
    """Lists of ``values`` for the ascending group numbers."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(group, np.arange(groups + 1)), pa.int32()), pa.array(values, kind))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text's words, digests and the different keys of its super-k-mers."""
    for batch in batches:
        for at, to, data, ends in _slices(batch.column("data")):
            _, _, text, key, _, _, own = _cut_slice(data, ends)
            order = np.lexsort((key, own))
            key, own = key[order], own[order]
            new = np.r_[True, (key[1:] != key[:-1]) | (own[1:] != own[:-1])][: key.size]
            raw = [data[x:y].tobytes() for x, y in zip(np.r_[0, ends[:-1]], ends, strict=True)]
            columns = [
                batch.column("doc_id").slice(at, to - at), pa.array([hashlib.sha256(x).digest() for x in raw], pa.binary()),
                pa.array(np.bincount(text, minlength=to - at)[: to - at], pa.int64()),
                pa.array([hashlib.sha256(b" ".join(x.split())).hexdigest() for x in raw]), _grouped(key[new], own[new], to - at, pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text", "n_words", "whole", "keys"])


#: A super-k-mer's words joined by spaces, with the text's number, its smallest doc_id and the places where it has them.
_PIECES = "key long, hot boolean, row long, first {kind}, at array<int>, piece binary"


def _travel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The super-k-mers of the keys that are asked for, as packed strings; equal ones of a text once."""
    for batch in batches:
        asked = batch.column("asked")
        for at, to, data, ends in _slices(batch.column("data")):
            start, end, _, key, first, last, own = _cut_slice(data, ends)
            rows: list[list] = [[], [], [], [], []]
            low = np.searchsorted(own, np.arange(to - at + 1))
            for k in range(to - at):
                wanted = asked[at + k].values
                keys, hot = wanted.field("key").to_numpy(), wanted.field("hot").to_numpy(zero_copy_only=False)
                hots = dict(zip(keys.tolist(), hot.tolist(), strict=True))
                mine = slice(low[k], low[k + 1])
                places: dict[tuple[int, bytes], list[int]] = {}
                base = int(np.searchsorted(start, ends[k - 1] if k else 0))
                take = np.isin(key[mine], keys)
                for code, x, y in zip(key[mine][take].tolist(), first[mine][take].tolist(), last[mine][take].tolist(), strict=True):
                    piece = b" ".join(data[start[x] : end[y + WINDOW - 1]].tobytes().split())
                    places.setdefault((code, piece), []).append(x - base)
                for (code, piece), where in places.items():
                    for column, value in zip(rows, (code, hots[code], at + k, where, piece), strict=True):
                        column.append(value)
            of = pa.array(rows[2], pa.int64())
            columns = [pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.bool_()), batch.column("row").take(of), batch.column("first").take(of), pa.array(rows[3], pa.list_(pa.int32())), pa.array(rows[4], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "hot", "row", "first", "at", "piece"])


def ranked(pieces: list[bytes], window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(number, piece) of each window of the pieces; windows have one number if their words are equal.

    Words are numbered, and runs of 2, 4, 8 words, then of ``window``, by sorting pairs of
    numbers, so windows are compared by all their words.
    """
    split = [p.split(b" ") for p in pieces]
    size = np.array([len(s) for s in split])
    flat = [w for s in split for w in s]
    number = {w: i for i, w in enumerate(dict.fromkeys(flat))}
    ids = np.fromiter((number[w] for w in flat), np.int64, len(flat))
    piece = np.repeat(np.arange(len(pieces)), size)

    def paired(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.unique(x * (int(y.max(initial=0)) + 1) + y, return_inverse=True)[1].ravel()

    span = 1
    while 2 * span <= window:
        ids, span = paired(ids[:-span], ids[span:]), 2 * span
    if window > span:
        ids = paired(ids[: ids.size - (window - span)], ids[window - span :])
    inside = piece[: ids.size] == piece[window - 1 :]
    return ids[inside], piece[: ids.size][inside]


def removed_windows(pieces: list[tuple[bytes, int]]) -> list[np.ndarray]:
    """For (string, smallest doc_id of its text): the places of its windows that begin in a smaller doc_id too."""
    strings = {p: i for i, p in enumerate(dict.fromkeys(p for p, _ in pieces))}
    own = np.array([strings[p] for p, _ in pieces])
    doc = np.array([d for _, d in pieces])
    least = np.full(len(strings), _NONE)
    np.minimum.at(least, own, doc)
    ids, piece = ranked(list(strings))
    order = np.argsort(ids, kind="stable")
    cut = np.flatnonzero(np.r_[True, np.diff(ids[order]) != 0])
    first = np.empty(ids.size, np.int64)
    first[order] = np.repeat(np.minimum.reduceat(least[piece[order]], cut), np.diff(np.append(cut, ids.size)))
    low = np.searchsorted(piece, np.arange(len(strings) + 1))
    return [np.flatnonzero(first[low[i] : low[i + 1]] < d) for i, d in zip(own.tolist(), doc.tolist(), strict=True)]


def runs(starts: np.ndarray, length: int = WINDOW) -> list[tuple[int, int]]:
    """Runs covered by windows at ascending starts."""
    if not starts.size:
        return []
    cut = np.flatnonzero(np.diff(starts) > length) + 1
    return [(int(p[0]), int(p[-1]) + length) for p in np.split(starts, cut)]


def _sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces in the order of their keys to the runs of words of each text that go; whole buckets are sorted at once."""

    def settle(block: list[tuple[int, int, list[int], bytes]]) -> pa.RecordBatch:
        rows: list[tuple[int, int, int]] = []
        for (row, _, at, _), starts in zip(block, removed_windows([(p, d) for _, d, _, p in block]), strict=True):
            spans = runs(starts)
            rows += [(row, x + low, x + high) for x in at for low, high in spans]
        columns = list(zip(*rows, strict=True)) or [[]] * 3
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["row", "low", "high"])

    block: list[tuple[int, int, list[int], bytes]] = []
    held, size = None, 0
    for batch in batches:
        first = batch.column("first").cast(pa.int64()).fill_null(_NONE).to_pylist()
        for key, row, doc, at, piece in zip(batch.column("key").to_pylist(), batch.column("row").to_pylist(), first, batch.column("at").to_pylist(), batch.column("piece").to_pylist(), strict=True):
            if key != held and size >= BLOCK_BYTES:
                yield settle(block)
                block, size = [], 0
            held = key
            block.append((row, doc, at, piece))
            size += len(piece) + 1
    if block:
        yield settle(block)


def _of_hot(pieces: DataFrame) -> DataFrame:
    """(row, low, high) of pieces whose buckets are large: their windows are dealt one by one.

    Equal strings are first made one; then the smallest doc_id of each window is a grouping
    with partial sums, joined back over salts to the strings and to the texts that have them.
    """
    own = pieces.select("row", "first", "at", F.col("piece").cast("string").alias("piece"))
    strings = written(own.groupBy("piece").agg(F.min("first").alias("first"), F.count("*").alias("n")))
    w = F.split("piece", " ")
    cut = F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.array_join(F.slice(w, i + 1, WINDOW), " "))
    each = written(strings.select("piece", "first", F.posexplode(cut).alias("i", "w")))
    least = written(each.groupBy("w").agg(F.min("first").alias("least"), F.count("*").alias("n")))
    told = salted_join(each.select("piece", "i", "w"), least.select("w", "least"), ["w"], least.select("w", "n"), ["piece", "i"])
    verdict = told.groupBy("piece").agg(F.array_sort(F.collect_list(F.struct("i", "least"))).alias("windows"))
    back = salted_join(own, verdict, ["piece"], strings.select("piece", "n"), ["row"])
    gone = F.filter("windows", lambda x: x["least"].isNotNull() & (F.col("first").isNull() | (x["least"] < F.col("first"))))
    back = back.select("row", F.explode("at").alias("x"), gone.alias("gone"), F.size("windows").alias("all")).where(F.size("gone") > 0)
    whole = F.array(F.struct(F.lit(0).alias("l"), (F.col("all") + WINDOW - 1).alias("h")))
    parts = F.transform("gone", lambda g: F.struct(g["i"].alias("l"), (g["i"] + WINDOW).alias("h")))
    spans = back.select("row", "x", F.explode(F.when(F.size("gone") == F.col("all"), whole).otherwise(parts)).alias("s"))
    return spans.select("row", (F.col("x") + F.col("s.l")).alias("low"), (F.col("x") + F.col("s.h")).alias("high"))


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        gone, digest, kept = [], [], []
        for data, each in zip(batch.column("data"), batch.column("runs"), strict=True):
            w = data.as_py().split()
            keep = np.ones(len(w), dtype=bool)
            for r in each.as_py():
                keep[r["low"] : r["high"]] = False
            gone.append(int((~keep).sum()))
            kept.append(b" ".join(w[i] for i in np.flatnonzero(keep).tolist()))
            digest.append(hashlib.sha256(kept[-1]).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("text"), pa.array(gone, pa.int64()), pa.array(digest), pa.array(kept, pa.binary())], names=["text", "n_removed", "kept_sha256", "kept"])


def repeated_runs(docs: DataFrame, bucket: int = BUCKET) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, texts, runs): each row's text and words; each text's number and smallest doc_id; runs of words that go.

    Equal texts are one, numbered by the row of their smallest doc_id. Keys of super-k-mers
    are counted first; one that a single text has ends there, as its windows are in no other
    text. The others travel as packed strings to the bucket of their key.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    data = F.coalesce(docs["text"], F.lit("")).cast("binary")
    source = docs.select(docs["doc_id"].alias("doc_id"), data.alias("data"))
    rows = written(in_arrow(source, _read, f"doc_id {kind}, text binary, n_words long, whole string, keys array<long>").withColumn("row", F.monotonically_increasing_id()))
    one = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("one")
    texts = written(rows.groupBy("text").agg(one, F.count("*").alias("n")).select("text", "one.row", F.col("one.doc_id").alias("first"), "n"))
    each = rows.join(texts.select("row"), "row", "left_semi").select("row", F.explode("keys").alias("key"))
    counts = written(each.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    asked = salted_join(each, counts.select("key", (F.col("n") > bucket).alias("hot")), ["key"], counts, ["row"])
    asked = asked.groupBy("row").agg(F.collect_list(F.struct("key", "hot")).alias("asked")).join(texts, "row")
    pieces = written(in_arrow(_with_text(source, asked).select("data", "row", "first", "asked"), _travel, _PIECES.format(kind=kind)))
    cold = pieces.where("not hot").select("key", "row", "first", "at", "piece")
    found = in_arrow(cold.repartition("key").sortWithinPartitions("key"), _sort, "row long, low int, high int")
    if not counts.where(F.col("n") > bucket).isEmpty():
        found = found.unionByName(_of_hot(pieces.where("hot")))
    return rows.drop("keys", "row"), texts, found


def _with_text(source: DataFrame, texts: DataFrame) -> DataFrame:
    """``texts`` (text, first) with ``data`` from the rows of ``source`` that have them under their smallest doc_id."""
    left = source.withColumn("text", F.unhex(F.sha2("data", 256))).alias("l")
    same = (F.col("l.text") == F.col("r.text")) & F.col("l.doc_id").eqNullSafe(F.col("r.first"))
    return left.join(texts.alias("r"), same).select("l.data", "r.*")


def remove_windows(docs: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256, kept.

    Removes each word that a window of 13 words covers which also begins in a document with
    a smaller doc_id. Words are what lies between the characters ``[\\x20\\x09-\\x0D]``; windows
    are judged on the input. ``kept`` has the words that remain, joined by spaces; it is
    null where none goes.

    A null text has no words. Rows of one doc_id are equally small: nothing goes from one
    because of the other. A row without a doc_id comes after all that have one, and removes
    nothing. An empty table gives no rows; other columns are ignored. Texts are whole: one
    task holds a text, its words and their hashes.
    """
    rows, texts, found = repeated_runs(docs, bucket)
    merged = found.groupBy("row").agg(F.collect_list(F.struct("low", "high")).alias("runs"))
    data = F.coalesce(docs["text"], F.lit("")).cast("binary")
    source = docs.select(docs["doc_id"].alias("doc_id"), data.alias("data"))
    cut = in_arrow(_with_text(source, merged.join(texts, "row")).select("text", "data", "runs"), _removed, "text binary, n_removed long, kept_sha256 string, kept binary")
    told = texts.select("text", "first").join(written(cut.dropDuplicates(["text"])), "text", "left")
    joined = salted_join(rows, told, ["text"], texts.select("text", "n"), ["doc_id"])
    copied = F.col("first").isNotNull() & (F.col("doc_id").isNull() | (F.col("doc_id") > F.col("first"))) & (F.col("n_words") >= WINDOW)
    return joined.select(
        "doc_id", "n_words",
        F.when(copied, F.col("n_words")).otherwise(F.coalesce("n_removed", F.expr("0L"))).alias("n_removed"),
        F.when(copied, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "whole")).alias("kept_sha256"),
        F.when(copied, F.expr("X''")).otherwise(F.col("kept")).alias("kept"),
    )
