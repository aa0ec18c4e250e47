"""Product codes of vectors: Lloyd rounds over integers, with exact matrix products."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, salted_join, written

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Labels whose sums are broadcast at most; more are joined by a shuffle.
BROADCAST_LABELS = 100_000
#: Vectors of a block whose distances are held at once.
_BLOCK = 8192
_LONG = (1 << 63) - 1


def limbs(x: np.ndarray, bits: int) -> list[np.ndarray]:
    """float64 arrays with x = sum of limb i times 2 ** (bits * i); all are below 2 ** bits, the last has the sign."""
    out = []
    while x.size and max(int(x.max()), -int(x.min())) >> bits:
        out.append((x & ((1 << bits) - 1)).astype(np.float64))
        x = x >> bits
    return [*out, x.astype(np.float64)]


def exact_products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """``x @ y.T`` of int64 matrices, exact where the result fits in int64.

    Limbs are so short that a float64 product of two of their rows stays below 2 ** 53,
    whatever order BLAS adds in; products of limbs are shifted and added as int64.
    """
    bits = (53 - max(1, x.shape[1]).bit_length()) // 2
    right = limbs(y, bits)
    out = np.zeros((x.shape[0], y.shape[0]), dtype=np.int64)
    for i, a in enumerate(limbs(x, bits)):
        for j, b in enumerate(right):
            if bits * (i + j) < 64:
                out += (a @ b.T).astype(np.int64) << (bits * (i + j))
    return out


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first nearest entry, its squared distance) of each row."""
    far = (x * x).sum(1)[:, None] - 2 * exact_products(x, book) + (book * book).sum(1)[None, :]
    best = far.argmin(1)
    return best, far[np.arange(len(x)), best]


def _integers(batches: Iterator[pa.RecordBatch], scale: int) -> Iterator[pa.RecordBatch]:
    """Rows whose vector has neither nulls nor components that are not finite, as floor(scale * x)."""
    for batch in batches:
        vectors = batch.column("vector")
        keep = pc.is_valid(vectors)
        batch = batch.filter(keep)
        vectors = batch.column("vector")
        flat = vectors.flatten()
        ends = np.cumsum(np.r_[0, pc.list_value_length(vectors).to_numpy(zero_copy_only=False)]).astype(np.int64)
        values = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)  # nulls become NaN
        bad = np.r_[0, np.cumsum(~np.isfinite(values))]
        good = bad[ends[1:]] == bad[ends[:-1]]
        size = np.diff(ends)
        whole = np.floor(values[np.repeat(good, size)] * scale)
        # the distances of a vector, summed over its parts, must fit in a long
        most = np.repeat(size[good], size[good])
        if (over := np.abs(whole) > np.sqrt(_LONG / 4 / np.maximum(most, 1)) - 1).any():
            raise ValueError(f"a component of {whole[over][0] / scale:g} makes squared distances that do not fit in a long")
        lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size[good])], pa.int32()), pa.array(whole.astype(np.int32)))
        kept = batch.filter(pa.array(good))
        yield pa.RecordBatch.from_arrays([kept.column("vec_id"), kept.column("label"), lists], names=["vec_id", "label", "q"])


def integers(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, label, q (array of int) of the vectors that are kept."""
    rows = vectors.select(vectors["vec_id"].alias("vec_id"), vectors["label"].alias("label"), vectors["embedding"].alias("vector"))
    kind = {c: rows.schema[c].dataType.simpleString() for c in ("vec_id", "label")}
    return in_arrow(rows, lambda it: _integers(it, scale), f"vec_id {kind['vec_id']}, label {kind['label']}, q array<int>")


def _blocks(batch: pa.RecordBatch, dim: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for at in range(0, batch.num_rows, _BLOCK):
        part = batch.slice(at, _BLOCK)
        flat = part.column("q").flatten().to_numpy(zero_copy_only=False)
        if (pc.list_value_length(part.column("q")).to_numpy(zero_copy_only=False) != dim).any():
            raise ValueError(f"all vectors must have as many components as the first: {dim}")
        yield part, flat.astype(np.int64).reshape(part.num_rows, dim)


def _sums(batches: Iterator[pa.RecordBatch], books: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One row for each part, entry and place that a task's vectors are nearest to: their number and sum."""
    parts, entries, width = books.shape
    n, total = np.zeros((parts, entries), np.int64), np.zeros(books.shape, np.int64)
    for batch in batches:
        for _, x in _blocks(batch, parts * width):
            for p in range(parts):
                own = x[:, p * width : (p + 1) * width]
                best, _ = nearest(own, books[p])
                n[p] += np.bincount(best, minlength=entries)
                order = np.argsort(best, kind="stable")
                used, first = np.unique(best[order], return_index=True)
                total[p, used] += np.add.reduceat(own[order], first, axis=0)
    p, e, w = (a.ravel() for a in np.indices(books.shape))
    some = np.repeat(n.ravel() > 0, width)
    columns = [p.astype(np.int32), e.astype(np.int32), w.astype(np.int32), np.repeat(n.ravel(), width), total.ravel()]
    yield pa.RecordBatch.from_arrays([pa.array(c[some]) for c in columns], names=["part", "entry", "place", "n", "total"])


def fit(whole: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (part, entry, place) after ``rounds`` rounds over the table that ``integers`` made.

    They start as the parts of the smallest vec_ids (nulls last; of equal ones the smaller
    vector). Tasks send sums of what they assign, which Spark adds as decimals; the driver
    gets one number for each place of each entry.
    """
    first = whole.orderBy(F.col("vec_id").asc_nulls_last(), "q").limit(entries).select("q").collect()
    dim = len(first[0]["q"]) if first else 0
    if dim % parts or any(len(r["q"]) != dim for r in first):
        raise ValueError(f"vectors of {dim} components cannot be cut into {parts} equal parts")
    books = np.array([r["q"] for r in first], dtype=np.int64).reshape(len(first), parts, -1 if dim else 0).transpose(1, 0, 2).copy()
    for _ in range(rounds if first else 0):
        now = books.copy()
        found = in_arrow(whole.select("q"), lambda it, b=now: _sums(it, b), "part int, entry int, place int, n long, total long")
        for r in found.groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect():
            books[r["part"], r["entry"], r["place"]] = int(r["total"]) // r["n"]
    return books


def _coded(batches: Iterator[pa.RecordBatch], books: np.ndarray) -> Iterator[pa.RecordBatch]:
    parts, _, width = books.shape
    for batch in batches:
        for part, x in _blocks(batch, parts * width):
            each = [nearest(x[:, p * width : (p + 1) * width], books[p]) for p in range(parts)]
            code = np.stack([b for b, _ in each], 1).astype(np.uint8)
            error = np.sum([d for _, d in each], axis=0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [part.column("vec_id"), part.column("label"), pa.array([c.tobytes().hex() for c in code], pa.string()), pa.array(error, pa.int64())], names=["vec_id", "label", "code", "error"]
            )


def encode(whole: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, label, code, error of the vectors that ``integers`` kept."""
    kind = {c: whole.schema[c].dataType.simpleString() for c in ("vec_id", "label")}
    return in_arrow(whole, lambda it: _coded(it, books), f"vec_id {kind['vec_id']}, label {kind['label']}, code string, error long")


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def _with_label_error(coded: DataFrame) -> DataFrame:
    """``coded`` with the error of all rows of its label; null is a label like any other."""
    label: Column = F.col("label").cast("string")
    keyed = coded.select("*", label.isNull().alias("_none"), F.coalesce(label, F.lit("")).alias("_label"))
    sums = written(keyed.groupBy("_none", "_label").agg(F.sum("error").alias("label_error"), F.count("*").alias("n")))
    if sums.count() <= BROADCAST_LABELS:
        return keyed.join(F.broadcast(sums.drop("n")), ["_none", "_label"])
    return salted_join(keyed, sums.drop("n"), ["_none", "_label"], sums.drop("label_error"), ["vec_id", "code"])


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """One row per vector kept: vec_id, code, error, label_error, codebooks_sha256.

    A null vector, or one with components that are null or not finite, is dropped. The
    others become integers floor(scale * x), cut into ``parts`` equal parts, each with a
    codebook of ``entries`` (fewer if there are fewer vectors) refined in ``rounds`` rounds.
    Integers are multiplied in limbs whose float64 products are exact, so codes and errors
    do not depend on how Spark deals out the rows. Ties go to the lower index.

    Repeated rows and vec_ids each count and are returned. Null vec_ids come after all
    others. Null labels are one label. An empty table gives no rows. Vectors must have as
    many components as the first, a multiple of ``parts``, and components so small that the
    distances fit in a long (about 46,000 at 64 components); else the job fails and says
    so. Other columns are ignored.
    """
    whole = written(integers(vectors, scale))
    books = fit(whole, parts, entries, rounds)
    coded = written(encode(whole, books))
    return _with_label_error(coded).select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def oracle() -> str:
    """DuckDB SQL: each round assigns, then takes floors of means."""
    book = "SELECT part, (row_number() OVER (PARTITION BY part, place ORDER BY vec_id) - 1)::INT AS entry, place, x FROM q WHERE vec_id IN (SELECT DISTINCT vec_id FROM q ORDER BY 1 LIMIT 16)"
    steps = [f"b0 AS MATERIALIZED ({book})"]
    for r in range(7):
        steps.append(
            f"d{r} AS (SELECT vec_id, part, entry, sum((q.x - b.x) * (q.x - b.x))::BIGINT AS far FROM q JOIN b{r} b USING (part, place) GROUP BY 1, 2, 3),\n"
            f"a{r} AS MATERIALIZED (SELECT vec_id, part, entry, far FROM d{r} QUALIFY row_number() OVER (PARTITION BY vec_id, part ORDER BY far, entry) = 1)"
        )
        if r < 6:
            steps.append(
                f"b{r + 1} AS MATERIALIZED (SELECT part, entry, place, coalesce(m.x, b.x) AS x FROM b{r} b LEFT JOIN "
                f"(SELECT part, entry, place, (sum(x) // count(*) - (sum(x) % count(*) < 0)::INT)::BIGINT AS x FROM q JOIN a{r} USING (vec_id, part) GROUP BY 1, 2, 3) m USING (part, entry, place))"
            )
    rounds = ",\n".join(steps)
    return f"""
WITH k AS (
  SELECT vec_id, label, embedding AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
u AS (SELECT vec_id, len(v) // 8 AS w, generate_subscripts(v, 1) - 1 AS i, unnest(v) AS y FROM k),
q AS MATERIALIZED (SELECT vec_id, (i // w)::INT AS part, (i % w)::INT AS place, floor(4096 * y::DOUBLE)::BIGINT AS x FROM u),
{rounds},
c AS (
  SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(far)::BIGINT AS error FROM a6 GROUP BY 1),
h AS (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY part, entry, place)) AS codebooks_sha256 FROM b6)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM c JOIN k USING (vec_id), h
"""
