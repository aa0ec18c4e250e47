"""Similarities of all pairs of two blocks of fingerprints, in arrays.

The twin of :mod:`similarity` for jobs that compare everything with everything: what it
says of a pair, this says of a few hundred thousand at once, to the same 6 digits. Edit
distances are bit-parallel (Myers, Hyyrö), one machine word a pair; sets meet in matrix
products; the divergence of two histograms is a difference of entropies, whose terms are
worked out once for each two values that differ. Matrices are (right rows, left rows).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from trapline.config import DIMENSIONS

STATS = ("interval_mean", "interval_stddev", "interval_p25", "interval_p75", "interval_p95")
RATIOS = ("has_upper_ratio", "has_lower_ratio", "has_digit_ratio", "has_special_ratio")
#: Elements of a matrix that a step works on, so that it stays in the cache; bytes of a table of bit masks.
STEP = 1 << 14
MASKS = 16 << 20


def _kinds(keys: list) -> tuple[np.ndarray, np.ndarray]:
    """(a row of each kind, the kind of each row): rows with equal keys are of one kind."""
    seen: dict = {}
    kind = np.fromiter((seen.setdefault(key, len(seen)) for key in keys), dtype=np.int64, count=len(keys))
    return np.unique(kind, return_index=True)[1], kind


def _wide(small: np.ndarray, right: np.ndarray, left: np.ndarray) -> np.ndarray:
    """A matrix of kinds as one of rows; where all rows differ it is that already."""
    if small.shape[0] != len(right):
        small = small.take(right, axis=0)
    return small if small.shape[1] == len(left) else small.take(left, axis=1)


class Lists:
    """Arrays of text, one a row: codes of their elements, row after row, and what the codes stand for.

    ``size`` has the elements of a row, nulls too, -1 where the row is null; nulls have no
    code. ``rows`` has a row of each kind of list, ``kind`` the kind of each row.
    """

    def __init__(self, column: pa.Array):
        self.size = np.asarray(pc.fill_null(pc.list_value_length(column), -1), dtype=np.int64)
        flat, parent = pc.list_flatten(column), np.asarray(pc.list_parent_indices(column), dtype=np.int64)
        coded = flat.cast(pa.string()).dictionary_encode()
        self.words = coded.dictionary
        codes = np.asarray(pc.fill_null(coded.indices, -1), dtype=np.int64)
        self.codes, self.parent = codes[codes >= 0], parent[codes >= 0]
        self.length = np.bincount(self.parent, minlength=len(self.size)).astype(np.int64)
        self.start = np.cumsum(self.length) - self.length
        raw, ends = self.codes.tobytes(), 8 * (self.start + self.length)
        self.rows, self.kind = _kinds([(n, raw[8 * a : b]) for n, a, b in zip(self.size.tolist(), self.start.tolist(), ends.tolist(), strict=True)])

    def into(self, words: pa.Array) -> np.ndarray:
        """The codes as places in ``words``; -1 for what is not among them."""
        return np.asarray(pc.fill_null(pc.index_in(self.words, words), -1), dtype=np.int64)[self.codes]

    def padded(self, codes: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """(rows, longest): the codes of some rows, -1 after their end."""
        length = self.length[rows]
        places = np.arange(int(length.max(initial=0)))[None, :]
        inside = places < length[:, None]
        out = np.full(inside.shape, -1, dtype=np.int64)
        out[inside] = codes[(self.start[rows][:, None] + places)[inside]]
        return out


def _bits(left: Lists, lrows: np.ndarray, right: Lists, rrows: np.ndarray) -> np.ndarray:
    """Edit distances where no left row has more than 64 elements."""
    if not len(lrows) or not len(rrows):
        return np.zeros((len(rrows), len(lrows)))
    longest = int(left.length[lrows].max(initial=0))
    word = np.uint16 if longest <= 16 else np.uint32 if longest <= 32 else np.uint64
    pattern, texts = left.padded(left.codes, lrows), right.padded(right.into(left.words), rrows)
    # only symbols of both sides need a mask; 0 stands for all others
    both = np.intersect1d(pattern, texts)
    both = both[both >= 0]
    if (len(both) + 1) * len(lrows) * word().nbytes > MASKS and len(lrows) > 1:
        half = len(lrows) // 2
        return np.concatenate([_bits(left, part, right, rrows) for part in (lrows[:half], lrows[half:])], axis=1)
    place = np.zeros(len(left.words) + 1, dtype=np.int64)
    place[both] = np.arange(1, len(both) + 1)
    masks = np.zeros((len(both) + 1, len(lrows)), dtype=word)
    for k in range(pattern.shape[1]):
        masks[place[pattern[:, k]], np.arange(len(lrows))] |= word(1) << word(k)
    masks[0] = 0
    texts = place[texts]
    length = right.length[rrows]
    order = np.argsort(-length, kind="stable")
    full = word(np.iinfo(word).max)
    ends = left.length[lrows]
    last = np.where(ends > 0, full >> (word(8 * word().nbytes) - np.maximum(ends, 1).astype(word)), word(0)).astype(word)
    out = np.empty((len(rrows), len(lrows)))
    step = max(1, STEP // len(lrows))
    for begin in range(0, len(order), step):
        some = order[begin : begin + step]
        mine = texts[some]
        vp, vn = np.full((len(some), len(lrows)), full), np.zeros((len(some), len(lrows)), dtype=word)
        x, d, h = np.empty_like(vp), np.empty_like(vp), np.empty_like(vp)
        for k in range(int(length[some[0]])):
            n = int((length[some] > k).sum())
            p, m, a, b, c = vp[:n], vn[:n], x[:n], d[:n], h[:n]
            masks.take(mine[:n, k], axis=0, out=a, mode="clip")
            np.bitwise_or(a, m, out=a)
            np.bitwise_and(a, p, out=b)
            np.add(b, p, out=b)
            np.bitwise_xor(b, p, out=b)
            np.bitwise_or(b, a, out=b)
            # a: symbol or vn, b: d0; then c: hp, p: hn, both one place up
            np.bitwise_or(p, b, out=c)
            np.invert(c, out=c)
            np.bitwise_or(c, m, out=c)
            np.add(c, c, out=c)
            np.bitwise_or(c, word(1), out=c)
            np.bitwise_and(p, b, out=p)
            np.add(p, p, out=p)
            np.bitwise_and(c, b, out=m)
            np.bitwise_or(c, b, out=c)
            np.invert(c, out=c)
            np.bitwise_or(p, c, out=p)
        up = np.bitwise_count(vp & last[None, :]).astype(np.float64)
        out[some] = length[some][:, None] + up - np.bitwise_count(vn & last[None, :])
    return out


def _table(left: Lists, lrows: np.ndarray, right: Lists, rrows: np.ndarray) -> np.ndarray:
    """Edit distances of lists of any length: the table of one left row and all right rows, row by row."""
    texts, ends = right.padded(right.into(left.words), rrows), right.length[rrows]
    places = np.arange(texts.shape[1] + 1)
    out = np.empty((len(rrows), len(lrows)))
    for n, row in enumerate(lrows):
        now = np.broadcast_to(places, (len(rrows), len(places))).copy()
        for symbol in left.codes[left.start[row] : left.start[row] + left.length[row]]:
            after = now + 1
            np.minimum(after[:, 1:], now[:, :-1] + (texts != symbol), out=after[:, 1:])
            now = np.minimum.accumulate(after - places, axis=1) + places
        out[:, n] = now[np.arange(len(rrows)), ends]
    return out


def edit_distances(left: Lists, right: Lists) -> np.ndarray:
    """Edit distances of all kinds of lists."""
    short = lambda x: x.length[x.rows] <= 64
    a, b = short(left), short(right)
    if a.all():
        return _bits(left, left.rows, right, right.rows)
    out = np.empty((len(right.rows), len(left.rows)))
    out[:, a] = _bits(left, left.rows[a], right, right.rows)
    out[np.ix_(b, ~a)] = _bits(right, right.rows[b], left, left.rows[~a]).T
    step = max(1, (1 << 22) // max(1, int(right.length.max(initial=0))))
    long = np.flatnonzero(~b)
    for begin in range(0, len(long), step):
        some = long[begin : begin + step]
        out[np.ix_(some, ~a)] = _table(left, left.rows[~a], right, right.rows[some])
    return out


def edit_sims(left: Lists, right: Lists) -> np.ndarray:
    """1 - distance / longer length of all rows; 1 if both are empty. A null row is an empty one."""
    longest = np.maximum(right.size[right.rows][:, None], left.size[left.rows][None, :])
    return _wide(np.where(longest <= 0, 1.0, 1 - edit_distances(left, right) / np.maximum(longest, 1)), right.kind, left.kind)


def shared(left: Lists, right: Lists) -> tuple[np.ndarray, np.ndarray]:
    """(elements of both, elements of either) of all kinds, as sets."""
    theirs = right.into(left.words)
    both = np.intersect1d(left.codes, theirs)
    both = both[both >= 0]
    place = np.full(len(left.words) + 1, -1, dtype=np.int64)
    place[both] = np.arange(len(both))

    def sides(x: Lists, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        # the number of different elements comes from the codes of the side itself
        different = np.unique(x.parent * (len(x.words) + 1) + x.codes)
        count = np.bincount(different // (len(x.words) + 1), minlength=len(x.size))[x.rows]
        kinds = np.full(len(x.size), -1, dtype=np.int64)
        kinds[x.rows] = np.arange(len(x.rows))
        row, column = kinds[x.parent], place[own]
        known = (row >= 0) & (column >= 0)
        out = np.zeros((len(x.rows), len(both)), dtype=np.float32)
        out[row[known], column[known]] = 1
        return count.astype(np.float64), out

    n, a = sides(left, left.codes)
    k, b = sides(right, theirs)
    common = (b @ a.T).astype(np.float64)
    return common, k[:, None] + n[None, :] - common


def jaccards(left: Lists, right: Lists) -> np.ndarray:
    """Of all rows, read as sets; 1 if both are empty, NaN where one is null."""
    common, either = shared(left, right)
    out = np.where(either == 0, 1.0, common / np.maximum(either, 1))
    out[right.size[right.rows] < 0, :] = np.nan
    out[:, left.size[left.rows] < 0] = np.nan
    return _wide(out, right.kind, left.kind)


def _entropy(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, x * np.log2(np.where(x > 0, x, 1.0)), 0.0)


def histogram_sims(left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """1 - Jensen-Shannon divergence to base 2; 0 for empty histograms, NaN for different lengths or null.

    A side is (rows of shares, lengths). The divergence of p and q is the mean of their sums
    of x * log2(x), less that of their mean.
    """
    (p, n), (q, k) = left, right
    wide = max(p.shape[1], q.shape[1])
    p, q = (np.pad(x, ((0, 0), (0, wide - x.shape[1]))) for x in (p, q))
    total = np.zeros((len(q), len(p)))
    for b in range(wide):
        (u, x), (v, y) = (np.unique(side[:, b], return_inverse=True) for side in (p, q))
        # distinct values come sorted, so they are dealt to rows even where all differ
        total += _entropy((v[:, None] + u[None, :]) / 2).take(y, axis=0).take(x, axis=1) if 4 * len(u) * len(v) < 3 * total.size else _entropy((q[:, b][:, None] + p[:, b][None, :]) / 2)
    out = 1 - ((_entropy(q).sum(axis=1)[:, None] + _entropy(p).sum(axis=1)[None, :]) / 2 - total)
    out[(k == 0)[:, None] & (n == 0)[None, :]] = 0.0
    out[k[:, None] != n[None, :]] = np.nan
    out[k < 0, :] = np.nan
    return out


def stat_sims(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    a, b = left[None, :], right[:, None]
    return 1 - np.abs(a - b) / (np.maximum(a, b) + 1)


def round6(x: np.ndarray) -> np.ndarray:
    """To 6 digits, as :func:`similarity.round6`."""
    return np.floor((x + 1e-9) * 1e6 + 0.5) / 1e6


def _mean(*parts: np.ndarray) -> np.ndarray:
    """The mean of the scores that are not NaN, to 6 digits; 0 if all are."""
    holes = [np.isnan(x) for x in parts]
    if not any(h.any() for h in holes):
        return round6(sum(parts[1:], parts[0]) / len(parts))
    total = sum((np.where(h, 0.0, x) for x, h in zip(parts, holes, strict=True)), np.zeros(parts[0].shape))
    n = sum((~h).astype(np.int64) for h in holes)
    return np.where(n == 0, 0.0, round6(total / np.maximum(n, 1)))


class Block:
    """Some fingerprints, as :func:`trapline.operators.blocks.flat` lays them out."""

    def __init__(self, data: bytes | pa.Table):
        self.data = (data if isinstance(data, pa.Table) else pa.ipc.open_stream(data).read_all()).combine_chunks()
        self.id = self._column("id")
        self._lists: dict[str, Lists] = {}
        self._timing = None

    def __len__(self) -> int:
        return self.data.num_rows

    def _column(self, name: str) -> pa.Array:
        column = self.data[name]
        return column.chunk(0) if column.num_chunks else pa.array([], column.type)

    def has(self, name: str) -> np.ndarray:
        return np.asarray(self._column(f"has_{name}").to_numpy(zero_copy_only=False), dtype=bool)

    def lists(self, name: str, first: int | None = None) -> Lists:
        """A column of lists, or their first elements."""
        key = f"{name}:{first}"
        if key not in self._lists:
            column = self._column(name)
            self._lists[key] = Lists(column if first is None else pc.list_slice(column, 0, first))
        return self._lists[key]

    def numbers(self, name: str) -> tuple[np.ndarray, np.ndarray]:
        """A column of lists of numbers: (rows, longest), zero after their end and NaN for null elements, and the lengths, -1 for null."""
        column = self._column(name)
        size = np.asarray(pc.fill_null(pc.list_value_length(column), -1), dtype=np.int64)
        out = np.zeros((len(size), int(size.max(initial=0))))
        out[np.arange(out.shape[1])[None, :] < size[:, None]] = np.asarray(pc.fill_null(pc.list_flatten(column), float("nan")))
        return out, size

    def fixed(self, name: str, n: int) -> np.ndarray:
        """A column of lists of n numbers; NaN where null."""
        out, size = self.numbers(name)
        out = np.pad(out, ((0, 0), (0, n - out.shape[1])))
        out[size < 0] = np.nan
        return out

    @property
    def timing(self):
        """(stats and burst variation, hour shares, weekday shares) of each kind of timing, and the kind of each row."""
        if self._timing is None:
            stats, tod, dow = self.fixed("timing", 6), self.numbers("tod"), self.numbers("dow")
            rows, kind = _kinds([(a.tobytes(), b.tobytes(), c.tobytes(), m, n) for a, b, c, m, n in zip(stats, tod[0], dow[0], tod[1].tolist(), dow[1].tolist(), strict=True)])
            self._timing = stats[rows], (tod[0][rows], tod[1][rows]), (dow[0][rows], dow[1][rows]), kind
        return self._timing

    @property
    def ranks(self) -> np.ndarray:
        """The order of the ids, by their bytes."""
        ids = [x.encode() for x in self.id.to_pylist()]
        out = np.empty(len(ids), dtype=np.int64)
        out[sorted(range(len(ids)), key=ids.__getitem__)] = np.arange(len(ids))
        return out


def _timing(left: Block, right: Block) -> np.ndarray:
    (a, h, d, x), (b, i, e, y) = left.timing, right.timing
    stats = [stat_sims(a[:, k], b[:, k]) for k in range(len(STATS))]
    varied = 1 - np.minimum(np.abs(a[:, 5][None, :] - b[:, 5][:, None]), 1.0)
    return _wide(_mean(sum(stats[1:], stats[0]) / len(stats), histogram_sims(h, i), histogram_sims(d, e), varied), y, x)


def _unless_empty(score: np.ndarray, left: Lists, right: Lists) -> np.ndarray:
    """NaN where both sides are empty."""
    a, b = left.size <= 0, right.size <= 0
    if a.any() and b.any():
        score[np.ix_(b, a)] = np.nan
    return score


def _where_both(score: np.ndarray, left: Lists, right: Lists) -> np.ndarray:
    """NaN where a side is null."""
    score[right.size < 0, :] = np.nan
    score[:, left.size < 0] = np.nan
    return score


def similarities(left: Block, right: Block) -> list[np.ndarray]:
    """The five similarities, in the order of DIMENSIONS; NaN where a side has no such group."""
    each = lambda name, first=None: (left.lists(name, first), right.lists(name, first))
    edit = lambda name: _unless_empty(edit_sims(*each(name)), *each(name))
    order = lambda name: _where_both(edit_sims(*each(name)), *each(name))
    # as sets, unless the whole lists are empty
    sets = lambda name, first=None: _unless_empty(jaccards(*each(name, first)), *each(name))
    patterns = edit("creds")
    ratios = [stat_sims(x, y) for x, y in zip(left.fixed("ratios", 4).T, right.fixed("ratios", 4).T, strict=True)]
    # the patterns of a credential group are those of the sequence group, where there is one
    alike = all(x._column("creds").equals(x._column("own_creds")) for x in (left, right))
    found = {
        "timing": _timing(left, right),
        "sequence": _mean(edit("ports"), edit("types"), patterns),
        "protocol": _mean(sets("services"), order("kex"), order("tls")),
        "credential": _mean(sets("classes"), sum(ratios[1:], ratios[0]) / len(ratios), patterns if alike else edit("own_creds")),
        "target": _mean(sets("top", 10), edit("top")),
    }
    for d, x in found.items():
        x[~right.has(d), :] = np.nan
        x[:, ~left.has(d)] = np.nan
    return [found[d] for d in DIMENSIONS]


def weighted(sims: list[np.ndarray], weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(total to 6 digits, dimensions used); ``weights`` has five for each right row. NaN counts nowhere."""
    top, bottom, used = np.zeros(sims[0].shape), np.zeros(sims[0].shape), np.zeros(sims[0].shape, dtype=np.int32)
    for k, x in enumerate(sims):
        hole, w = np.isnan(x), weights[:, k][:, None]
        if hole.any():
            top += np.where(hole, 0.0, w * x)
            bottom += np.where(hole, 0.0, w)
            used += ~hole
        else:
            top += w * x
            bottom += w
            used += 1
    return np.where(bottom > 0, round6(top / np.where(bottom > 0, bottom, 1.0)), 0.0), used


def scores(left: Block, right: Block, weights: list[float]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """(five similarities, total, dimensions used) of all pairs; a right row may have weights of its own."""
    sims = similarities(left, right)
    own = np.tile(np.asarray(weights, dtype=np.float64), (len(right), 1))
    if "weights" in right.data.column_names:
        given = right.fixed("weights", len(DIMENSIONS))
        own = np.where(np.isnan(given), own, given)
    return (sims, *weighted(sims, own))
