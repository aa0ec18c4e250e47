"""Mixture-controlled packing of token streams into fixed windows."""

from __future__ import annotations

import json
import re
import zlib
from array import array
from bisect import bisect_right
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import in_arrow, salted_join, ship, written

#: Groups of the sources that the mixture does not name, by a hash; each is a queue of its own sources' queues.
GROUPS = 1024
#: Parts of a source whose lengths are summed on their own, at least, and documents in one of them.
PARTS = 4096
PART_ROWS = 1000
#: Words one worker keeps; the table is emptied when it is full.
_WORDS = 600_000
_SLOW = re.compile("[^\x00-\x1b\x20-\xff]|<\\|")


def _byte_letters() -> list[str]:
    """The letter that a byte-level vocabulary writes for each byte: itself if it prints."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in prints]
    return [chr(b) if b in prints else chr(256 + others.index(b)) for b in range(256)]


class WordIds(dict):
    """Word to the bytes of its ids (little-endian, 16 bits), filled as words come up.

    White space always ends a token of this tokenizer, so a text's ids are those of its
    words in a row, and a word's are those of the pieces that the tokenizer's own pattern
    cuts it into. That holds for Latin-1 texts, where folding and composing work letter by
    letter; others, and texts with a special token's first characters, are encoded whole.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids of over 16 bits")
        with open(path, encoding="utf-8") as file:
            splits = json.load(file)["pre_tokenizer"]["pretokenizers"]
        self.pattern = regex.compile(next(x["pattern"]["Regex"] for x in splits if x["type"] == "Split"))
        self.letters = _byte_letters()
        self.pieces: dict[str, bytes] = {}
        self.model = self.tokenizer.model

    def piece(self, piece: str) -> bytes:
        if (ids := self.pieces.get(piece)) is None:
            text = piece if piece.isascii() and piece.isprintable() else "".join(map(self.letters.__getitem__, piece.encode()))
            ids = self.pieces[piece] = array("H", [t.id for t in self.model.tokenize(text)]).tobytes()
        return ids

    def __missing__(self, word: str) -> bytes:
        ids = self[word] = b"".join(map(self.piece, self.pattern.findall(word)))
        return ids

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u2").tobytes()

    def ids(self, text: str) -> bytes:
        if _SLOW.search(text):
            return self.whole(text)
        if len(self) > _WORDS:
            self.clear()
        if len(self.pieces) > _WORDS:
            self.pieces.clear()
        return b"".join(map(self.__getitem__, text.lower().split()))


@cache
def _words(path: str) -> WordIds:
    return WordIds(path)


def tokenize(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """doc_id, source, tokens, ids: each text's ids and ``end_id``, 16 bits little-endian."""
    end = np.array([end_id], dtype="<u2").tobytes()
    kind = docs.schema["doc_id"].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _words(tokenizer)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ids = [words.ids(t or "") + end for t in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array([len(x) // 2 for x in ids], pa.int64()), pa.array(ids, pa.binary())],
                    names=["doc_id", "source", "tokens", "ids"],
                )

    return docs.select("doc_id", F.coalesce("source", F.lit("")).alias("source"), "text").transform(
        in_arrow,
        encode, f"doc_id {kind}, source string, tokens long, ids binary"
    )


class Deficits:
    """How many of the first ``g`` tokens each queue gives: deficit round-robin in closed form.

    Queues hang on a balanced tree. A node hands ``g * left // all`` of ``g`` tokens to
    its left half and the others to the right one; what the division leaves is the deficit
    that the next window pays. Each count is within one token a level of the exact share,
    never falls, and reaches the queue's length at the end, so any window can be cut
    without those before it: the deficits carried into it are known.
    """

    def __init__(self, lengths: list[int]) -> None:
        self.lengths, self.total = lengths, sum(lengths)
        sums = np.concatenate([[0], np.cumsum(np.array(lengths, dtype=object))]).tolist()
        self.paths: list[list[tuple[int, int, bool]]] = [[] for _ in lengths]
        stack = [(0, len(lengths))]
        while stack:
            lo, hi = stack.pop()
            if hi - lo < 2:
                continue
            mid = (lo + hi) // 2
            left, both = sums[mid] - sums[lo], sums[hi] - sums[lo]
            for k in range(lo, hi):
                self.paths[k].append((left, both, k < mid))
            stack += [(lo, mid), (mid, hi)]

    def given(self, queue: int, g: int) -> int:
        return given(self.paths[queue], g)

    def before(self, queue: int, g: int, h: int) -> int:
        return before(self.paths[queue], g, h)


def given(path: list[tuple[int, int, bool]], g: int) -> int:
    """Tokens that the queue at the end of a tree's path gives of the first ``g``."""
    for left, both, first in path:
        part = g * left // both if both else 0
        g = part if first else g - part
    return g


def before(path: list[tuple[int, int, bool]], g: int, h: int) -> int:
    """Tokens of the queues before this one between ``g`` and ``h``."""
    sum_ = 0
    for left, both, first in path:
        x, y = (g * left // both, h * left // both) if both else (0, 0)
        if first:
            g, h = x, y
        else:
            sum_ += y - x
            g, h = g - x, h - y
    return sum_


def phases(lengths: list[int], weights: list[float] | None, window: int) -> list[list[int]]:
    """What each queue gives in each phase; a phase ends where a queue runs dry.

    Without weights there is one phase at the queues' own proportions. All phases but the
    last fill whole windows. Queues of weight 0 wait until the others are used up.
    """
    left = list(lengths)
    plan: list[list[int]] = []
    while any(left):
        shares = [w if n else 0.0 for w, n in zip(weights, left, strict=True)] if weights else [float(n) for n in left]
        scale = sum(shares)
        size = min(int(n * scale / s) for n, s in zip(left, shares, strict=True) if s > 0) // window * window if scale and weights else 0
        if not weights or not size:
            if weights and scale:  # the driest queue gives its rest, others follow in proportion
                size = min(sum(left), window)
            else:
                plan.append(left)
                break
        give = [min(n, int(size * s / scale)) for n, s in zip(left, shares, strict=True)]
        for k in sorted(range(len(left)), key=lambda k: give[k] - left[k]):
            give[k] += min(left[k] - give[k], size - sum(give))
        plan.append(give)
        left = [n - g for n, g in zip(left, give, strict=True)]
    return plan


class Schedule:
    """Which window and offset each token of a source has.

    The named sources and the groups of the others are the queues of each phase; a group's
    tokens are dealt to its sources by a tree of its own, over all phases.
    """

    def __init__(self, plan: list[list[int]], window: int) -> None:
        self.plan, self.window, self.queues = plan, window, len(plan[0]) if plan else 1
        self.tables = [Deficits(p) for p in plan]
        sums = np.cumsum(np.array(plan, dtype=object).reshape(-1, self.queues), axis=0)
        self.firsts = np.concatenate([np.zeros((1, self.queues), dtype=object), sums]).tolist()
        self.begins = [sum(f) for f in self.firsts]

    def queue_given(self, queue: int, w: int) -> int:
        """Tokens that a queue gives in the first ``w`` windows."""
        g = min(w * self.window, self.begins[-1])
        phase = min(bisect_right(self.begins, g), len(self.plan)) - 1
        return self.firsts[phase][queue] + self.tables[phase].given(queue, g - self.begins[phase])

    def source_given(self, queue: int, path: list, w: int) -> int:
        return given(path, self.queue_given(queue, w))

    def find(self, queue: int, path: list, at: int, size: int) -> int:
        """The window of token ``at`` of a source of ``size`` tokens: a guess in proportion, then doubling steps."""
        whole = self.firsts[-1][queue]
        far = at * whole // size
        phase = min(bisect_right([f[queue] for f in self.firsts], far), len(self.plan)) - 1
        part = self.plan[phase][queue]
        low = (self.begins[phase] + ((far - self.firsts[phase][queue]) * self.tables[phase].total // part if part else 0)) // self.window
        step = 1
        while low and self.source_given(queue, path, low) > at:
            low, step = max(0, low - step), 2 * step
        high, step = low + 1, 1
        while self.source_given(queue, path, high) <= at:
            low, high, step = high, high + step, 2 * step
        while high - low > 1:
            mid = (low + high) // 2
            low, high = (mid, high) if self.source_given(queue, path, mid) <= at else (low, mid)
        return low

    def pieces(self, queue: int, path: list, at: int, count: int, size: int) -> Iterator[tuple[int, int, int, int, float]]:
        """(start in document, length, window, offset, deficit) of ``count`` tokens at ``at`` of a source of ``size``."""
        start, w = 0, self.find(queue, path, at, size) if count else 0
        while start < count:
            end = self.source_given(queue, path, w + 1)
            if end <= at:
                w = w + 1 if self.source_given(queue, path, w + 2) > at else self.find(queue, path, at, size)
                continue
            low, high = w * self.window, min(self.begins[-1], (w + 1) * self.window)
            phase = bisect_right(self.begins, low) - 1
            table, since = self.tables[phase], self.begins[phase]
            x, y = self.queue_given(queue, w), self.queue_given(queue, w + 1)
            first = given(path, x)
            offset = table.before(queue, low - since, high - since) + before(path, x, y) + at - first
            share = (low - since) * self.plan[phase][queue] / table.total + self.firsts[phase][queue]
            owed = share * size / self.firsts[-1][queue] - first
            take = min(count - start, end - at)
            yield start, take, w, offset, round(owed, 6)
            start, at, w = start + take, at + take, w + 1


def targets(lengths: list[int], shares: list[float], named: int) -> list[float] | None:
    """Weights of the queues: the named ones' shares, what is left of 1 in proportion to the others' lengths."""
    if not named:
        return None
    rest, others = max(0.0, 1 - sum(shares)), sum(lengths[named:])
    return [*shares, *(rest * n / others if others else 0.0 for n in lengths[named:])]


_PATH = "array<struct<left:long,both:long,first:boolean>>"


def pack(docs: DataFrame, tokenizer: str, window: int = 4096, mixture: dict[str, float] | None = None, end_id: int = 2) -> DataFrame:
    """One row per piece: doc_id, source, start, length, ids_crc32, doc_tokens, sequence_id, offset, deficit.

    Every window takes tokens of all source queues at the target proportions while they
    last: a source that ``mixture`` names has that share of each window, the others have
    what is left of 1 in proportion to their tokens. When a queue is used up, the others
    keep their proportions to each other. What a window owes a source (``deficit``, the
    exact share so far less the tokens given) is paid by the windows that follow, across
    partitions. A source orders documents by a hash of doc_id. Only the last window is
    shorter. A document may be cut anywhere; each of its ids is in one piece.

    Positions are sums over (source, part) groups and then within a part, so a source of a
    third of all rows is dealt over thousands of groups. The sources may be any number: the
    driver knows the totals of the named ones and of 1,024 groups of the others; the
    sources of a group are dealt within it.

    Null texts are empty (one id, ``end_id``); null sources are the source ''. Repeated
    rows are packed as often as they occur, null ids like others. Whole texts are encoded,
    each in one task. Other columns are ignored. Empty in, empty out.
    """
    tokens = written(tokenize(docs, tokenizer, end_id).withColumn("place", F.xxhash64("doc_id")))
    parts = max(PARTS, tokens.count() // PART_ROWS)
    names = sorted(mixture or {})
    shares = [float(mixture[s]) for s in names]
    if names and (min(shares) < 0 or not sum(shares)):
        raise ValueError("shares of the mixture are not negative, and one at least is positive")
    number = F.create_map(*(F.lit(x) for k, s in enumerate(names) for x in (s, k))) if names else None
    own = F.try_element_at(number, "source") if names else F.lit(None).cast("int")
    parted = tokens.withColumn("part", F.pmod(F.col("place"), F.lit(parts)).cast("int"))
    sizes = written(parted.groupBy("source", "part").agg(F.sum("tokens").alias("n")))
    group = F.lit(len(names)) + F.pmod(F.xxhash64("source"), F.lit(GROUPS)).cast("int")
    sources = sizes.groupBy("source").agg(F.sum("n").alias("size"), F.count("*").alias("n")).withColumn("queue", F.coalesce(own, group))
    totals = {r["queue"]: r["size"] for r in sources.groupBy("queue").agg(F.sum("size").alias("size")).collect()}
    # only queues that hold something: groups follow the named sources
    queues = [k for k in sorted(totals) if totals[k]]
    lengths = [totals[k] for k in queues]
    kept = [s for k, s in enumerate(shares) if k in totals]
    schedule = Schedule(phases(lengths, targets(lengths, kept, len(kept)), window), window)
    order = {k: n for n, k in enumerate(queues)}

    def tree(rows: pa.Table) -> pa.Table:
        """The sources of a queue, each with its path in the queue's tree."""
        rows = rows.sort_by("source")
        paths = Deficits(rows.column("size").to_pylist()).paths
        kind = pa.list_(pa.struct([("left", pa.int64()), ("both", pa.int64()), ("first", pa.bool_())]))
        told = [[dict(zip(("left", "both", "first"), step, strict=True)) for step in p] for p in paths]
        return pa.table({"source": rows.column("source"), "queue": rows.column("queue"), "size": rows.column("size"), "n": rows.column("n"), "path": pa.array(told, kind)})

    ship(docs.sparkSession)
    dealt = written(sources.groupBy("queue").applyInArrow(tree, f"source string, queue int, size long, n long, path {_PATH}"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (b.slice(at, 256) for b in batches for at in range(0, b.num_rows, 256)):
            doc, source = part.column(0), part.column(1)
            row, rest = [], []
            columns = (part.column(k).to_pylist() for k in range(2, 8))
            for k, (q, path, length, a, n, b) in enumerate(zip(*columns, strict=True)):
                wide = np.frombuffer(b, dtype="<u2").astype("<u4").tobytes()
                steps = [(p["left"], p["both"], p["first"]) for p in path]
                for s, take, w, o, d in schedule.pieces(order[q], steps, a, n, length):
                    row.append(k)
                    rest.append((s, take, zlib.crc32(wide[4 * s : 4 * (s + take)]), n, w, o, d))
            found = list(zip(*rest, strict=True)) or [[]] * 7
            taken = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [doc.take(taken), source.take(taken), *(pa.array(c, pa.int64()) for c in found[:6]), pa.array(found[6], pa.float64())],
                names=["doc_id", "source", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "deficit"],
            )

    running = lambda *keys: Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, 0)
    base = sizes.select("source", "part", (F.sum("n").over(running("source").orderBy("part")) - F.col("n")).alias("base"))
    # a part is told all of its source, so that the ids are shuffled once, by part
    told = salted_join(base, dealt.drop("n"), ["source"], dealt.select("source", "n"), ["part"])
    within = F.sum("tokens").over(running("source", "part").orderBy("doc_id", "ids")) - F.col("tokens")
    placed = parted.withColumn("within", within).join(told, ["source", "part"]).withColumn("at", F.col("base") + F.col("within"))
    return in_arrow(
        placed.select("doc_id", "source", "queue", "path", "size", "at", "tokens", "ids"),
        cut,
        f"doc_id {kind}, source string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, deficit double",
    )
