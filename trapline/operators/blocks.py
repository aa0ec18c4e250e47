"""Comparisons of all fingerprints with all others: Spark pairs blocks of rows, a task scores a pair of blocks in arrays.

What a caller needs of the scores (all rows, the best of a row, sums) is taken from a pair's
matrices before rows are made, so only that travels.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trapline.config import DEFAULT, DIMENSIONS, Config
from trapline.functions import allpairs as A
from trapline.sources.store import in_arrow, saved

#: Rows of a block at most; small tables have smaller ones on the left side, so that every core has some.
ROWS = 512
#: Blocks of the right side that a task keeps decoded.
KEPT = 16


def flat(fingerprints: DataFrame, id_: str, **more: Column) -> DataFrame:
    """What a comparison reads of fingerprints (five structs), as columns of lists; ``more`` are kept beside it."""
    texts = lambda c: F.col(c).cast("array<string>")
    values = lambda c: F.transform(c, lambda e: e["value"]).cast("array<string>")
    numbers = lambda d, names: F.when(F.col(d).isNotNull(), F.array(*(F.col(f"{d}.{c}").cast("double") for c in names)))
    return fingerprints.select(
        F.col(id_).alias("id"), *(F.col(d).isNotNull().alias(f"has_{d}") for d in DIMENSIONS), numbers("timing", (*A.STATS, "burst_cv")).alias("timing"),
        F.col("timing.tod_histogram").alias("tod"), F.col("timing.dow_histogram").alias("dow"), texts("sequence.port_sequence").alias("ports"),
        texts("sequence.event_type_sequence").alias("types"), texts("sequence.credential_sequence").alias("creds"),
        values("protocol.service_distribution").alias("services"), texts("protocol.ssh_kex").alias("kex"), texts("protocol.tls_ciphers").alias("tls"),
        values("credential.username_class_dist").alias("classes"), numbers("credential", A.RATIOS).alias("ratios"),
        F.when(F.col("credential").isNull(), texts("sequence.credential_sequence")).otherwise(texts("credential.credential_sequence")).alias("own_creds"),
        texts("target.top_dst_ports").alias("top"), *(c.alias(name) for name, c in more.items()),
    )


def _pack(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    number = TaskContext.get().partitionId() << 32
    rest: list[pa.RecordBatch] = []

    def block(table: pa.Table) -> pa.RecordBatch:
        nonlocal number
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as writer:
            writer.write_table(table)
        number += 1
        return pa.RecordBatch.from_pydict({"number": pa.array([number], pa.int64()), "n": pa.array([table.num_rows], pa.int64()), "block": pa.array([sink.getvalue().to_pybytes()], pa.binary())})

    for batch in batches:
        rest.append(batch)
        while sum(b.num_rows for b in rest) >= size:
            table = pa.Table.from_batches(rest)
            yield block(table.slice(0, size).combine_chunks())
            rest = table.slice(size).to_batches()
    if sum(b.num_rows for b in rest):
        yield block(pa.Table.from_batches(rest).combine_chunks())


def packed(rows: DataFrame, dealt: bool = True) -> DataFrame:
    """(number, n, block): rows of :func:`flat` in blocks, written.

    Rows of equal sequences share a block, as what is equal within a block is worked out once.
    A side whose blocks are ``dealt`` over tasks has some for each core.
    """
    rows = saved(rows)
    n, cores = rows.count(), rows.sparkSession.sparkContext.defaultParallelism
    size = min(ROWS, max(32, -(-n // (4 * cores)))) if dealt else ROWS
    order = [F.xxhash64("types", "creds"), F.col("id")]
    near = rows.repartitionByRange(max(1, -(-n // (8 * size))), *order).sortWithinPartitions(*order)
    return saved(in_arrow(near, partial(_pack, size=size), "number long, n long, block binary"))


def _job(batches: Iterator[pa.RecordBatch], take: Callable, weights: list[float]) -> Iterator[pa.RecordBatch]:
    kept: OrderedDict[int, A.Block] = OrderedDict()
    held: tuple[int, A.Block] | None = None
    for batch in batches:
        for k in range(batch.num_rows):
            a, b = batch["left"][k].as_py(), batch["right"][k].as_py()
            if held is None or held[0] != a:
                held = (a, A.Block(batch["x"][k].as_py()))
            if b not in kept:
                kept[b] = A.Block(batch["y"][k].as_py())
            kept.move_to_end(b)
            if len(kept) > KEPT:
                kept.popitem(last=False)
            out = take(held[1], kept[b], weights, a == b)
            if out is not None and out.num_rows:
                yield out


def compared(left: DataFrame, right: DataFrame, take: Callable, schema: str, cfg: Config = DEFAULT, broadcast: bool = True, once: bool = False) -> DataFrame:
    """What ``take`` returns for each pair of a left and a right block.

    ``take(left, right, weights, same)`` gets two :class:`allpairs.Block` and returns a batch
    of ``schema``, or None. With ``once`` both sides are the same blocks and a pair of two
    blocks is taken once. Left blocks are dealt over tasks; right ones are broadcast if
    ``broadcast``, else Spark pairs partitions with partitions.
    """
    x = left.select(F.col("number").alias("left"), F.col("block").alias("x")).repartition(max(1, left.count()))
    y = right.select(F.col("number").alias("right"), F.col("block").alias("y"))
    y = F.broadcast(y) if broadcast else y
    pairs = x.join(y, F.col("left") <= F.col("right")) if once else x.crossJoin(y)
    return in_arrow(pairs, partial(_job, take=take, weights=[cfg.weights[d] for d in DIMENSIONS]), schema)


def _batch(columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(columns)


def _some(x: np.ndarray) -> pa.Array:
    """Numbers, null where NaN."""
    return pa.array(x, pa.float64(), from_pandas=True)


def every(left: A.Block, right: A.Block, weights: list[float], same: bool, columns: tuple[str, ...] = ()) -> pa.RecordBatch:
    """All pairs, with the named columns."""
    sims, score, used = A.scores(left, right, weights)
    n, k = len(left), len(right)
    found = {f"{d}_similarity": x for d, x in zip(DIMENSIONS, sims, strict=True)}
    out = {"src_ip": left.id.take(pa.array(np.tile(np.arange(n), k))), "campaign_id": right.id.take(pa.array(np.repeat(np.arange(k), n)))}
    for c in columns:
        out[c] = pa.array(score.ravel()) if c == "score" else pa.array(used.ravel()) if c == "dimensions_used" else _some(found[c].ravel())
    return _batch(out)


def best(left: A.Block, right: A.Block, weights: list[float], same: bool, least: float = 0.0) -> pa.RecordBatch:
    """Of each left row the right one of the highest score, ties by the smaller id, if that is ``least`` or more."""
    sims, score, used = A.scores(left, right, weights)
    by_id = np.argsort(right.ranks)
    row = by_id[score[by_id].argmax(axis=0)]
    column = np.arange(len(left))
    good = score[row, column] >= least
    row, column = row[good], column[good]
    out = {"src_ip": left.id.take(pa.array(column)), "campaign_id": right.id.take(pa.array(row))}
    out |= {f"{d}_similarity": _some(x[row, column]) for d, x in zip(DIMENSIONS, sims, strict=True)}
    return _batch(out | {"score": pa.array(score[row, column]), "dimensions_used": pa.array(used[row, column])})


def sums(left: A.Block, right: A.Block, weights: list[float], same: bool) -> pa.RecordBatch:
    """Of each right row and dimension: the sum of its similarities in millionths, and how many there are."""
    out = {"campaign_id": right.id}
    for d, x in zip(DIMENSIONS, A.similarities(left, right), strict=True):
        hole = np.isnan(x)
        out[f"{d}_sum"] = pa.array(np.rint(np.where(hole, 0.0, x) * 1e6).astype(np.int64).sum(axis=1))
        out[f"{d}_n"] = pa.array((~hole).sum(axis=1))
    return _batch(out)


HINTS = ("primary_campaign", "infrastructure_reuse", "tactic_match", "temporal_overlap")


def hints_of(sims: list[np.ndarray]) -> np.ndarray:
    """Places in HINTS, as :func:`similarity.relationship_hint` names them."""
    t, s, p = (np.where(np.isnan(x), 0.0, x) for x in sims[:3])
    return np.where((s >= 0.85) & (t >= 0.80), 0, np.where((t >= 0.80) & (s < 0.70), 1, np.where(p >= 0.80, 2, 3)))


def hints(left: A.Block, right: A.Block, weights: list[float], same: bool) -> pa.RecordBatch:
    """How many pairs have each hint."""
    n = np.bincount(hints_of(A.similarities(left, right)).ravel(), minlength=len(HINTS))
    return _batch({"hint": pa.array(list(HINTS)), "n": pa.array(n)}).filter(pa.array(n > 0))


def _ranked(left: A.Block, right: A.Block) -> tuple[np.ndarray, np.ndarray]:
    """Places of both sides' rows in the order of ``first`` and id."""
    keys = [(f, i.encode()) for x in (left, right) for f, i in zip(x.data["first"].to_pylist(), x.id.to_pylist(), strict=True)]
    place = np.empty(len(keys), dtype=np.int64)
    place[sorted(range(len(keys)), key=keys.__getitem__)] = np.arange(len(keys))
    return place[: len(left)], place[len(left) :]


def best_leader(left: A.Block, right: A.Block, weights: list[float], same: bool, least: float = 0.0) -> pa.RecordBatch | None:
    """Of each left row the best right one that comes earlier, ties by the smaller id."""
    mine, theirs = _ranked(left, right)
    earlier = theirs[:, None] < mine[None, :]
    if not earlier.any():
        return None
    _, score, _ = A.scores(left, right, weights)
    score = np.where(earlier, score, -1.0)
    by_id = np.argsort(right.ranks)
    row = by_id[score[by_id].argmax(axis=0)]
    column = np.arange(len(left))
    good = score[row, column] >= max(least, 0.0)
    row, column = row[good], column[good]
    return _batch({"src_ip": left.id.take(pa.array(column)), "leader": right.id.take(pa.array(row)), "score": pa.array(score[row, column])})


def led(left: A.Block, right: A.Block, weights: list[float], same: bool, least: float = 0.0) -> pa.RecordBatch:
    """The left rows that have a right one at ``least`` or more."""
    _, score, _ = A.scores(left, right, weights)
    return _batch({"src_ip": left.id.take(pa.array(np.flatnonzero((score >= least).any(axis=0))))})


def first_leaders(batches: Iterator[pa.RecordBatch], least: float, weights: list[float], step: int = 128) -> Iterator[pa.RecordBatch]:
    """Of a few rows of :func:`flat`, in one task: those that no earlier one of them leads.

    A row leads if no earlier leader is near. Scores are worked out for some possible leaders
    at a time, against the rows after them.
    """
    found = [b for b in batches if b.num_rows]
    if not found:
        return
    table = pa.Table.from_batches(found)
    ids, first = table["id"].to_pylist(), table["first"].to_pylist()
    table = table.take(pa.array(sorted(range(len(ids)), key=lambda k: (first[k], ids[k].encode()))))
    near = np.zeros(table.num_rows, dtype=bool)
    leads: list[int] = []
    for begin in range(0, table.num_rows, step):
        some = begin + np.flatnonzero(~near[begin : begin + step])
        if not len(some):
            continue
        after = np.flatnonzero(~near)
        after = after[after >= begin]
        _, score, _ = A.scores(A.Block(table.take(pa.array(after))), A.Block(table.take(pa.array(some))), weights)
        for k, row in enumerate(some):
            if not near[row]:
                leads.append(int(row))
                near[after[(score[k] >= least) & (after > row)]] = True
    yield from table.take(pa.array(leads)).combine_chunks().to_batches()


def top(left: A.Block, right: A.Block, weights: list[float], same: bool, least: float = 0.0, limit: int = 20) -> pa.RecordBatch:
    """The best ``limit`` pairs of different rows that share no actor, by score and ids; a row without ids tells how many were compared."""
    ids = [x.encode() for b in (left, right) for x in b.id.to_pylist()]
    place = np.empty(len(ids), dtype=np.int64)
    place[sorted(range(len(ids)), key=ids.__getitem__)] = np.arange(len(ids))
    x, y = place[: len(left)], place[len(left) :]
    linked = A.shared(*(b.lists("actors") for b in (left, right)))[0] > 0
    valid = ~A._wide(linked, right.lists("actors").kind, left.lists("actors").kind)
    if same:
        valid &= left.ranks[None, :] < right.ranks[:, None]
    sims, score, _ = A.scores(left, right, weights)
    row, column = np.nonzero(valid & (score >= least))
    if len(row) > limit:
        reached = score[row, column]
        bar = np.partition(reached, len(reached) - limit)[len(reached) - limit]
        row, column = row[reached >= bar], column[reached >= bar]
    small, great = np.minimum(x[column], y[row]), np.maximum(x[column], y[row])
    order = np.lexsort((great, small, -score[row, column]))[:limit]
    row, column = row[order], column[order]
    hint = hints_of([s[row, column] for s in sims])
    ranked = sorted(ids)
    a = [ranked[k].decode() for k in small[order]] + [None]
    b = [ranked[k].decode() for k in great[order]] + [None]
    return _batch({
        "a": pa.array(a, pa.string()), "b": pa.array(b, pa.string()), "score": pa.array([*score[row, column].tolist(), None], pa.float64()),
        "hint": pa.array([*(HINTS[k] for k in hint), None], pa.string()), "n": pa.array([0] * len(row) + [int(valid.sum())], pa.int64()),
    })
