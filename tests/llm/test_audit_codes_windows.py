"""Filter audit, vector codes and word windows against plain Python, with nulls, ties, repeated rows and empty tables."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from trapline.llm import filter_audit, vector_codes, windows

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows):
    """Rows (doc_id, text, source) with columns whose names the operators use themselves."""
    return spark.createDataFrame([(d, t, None, s, None) for d, t, s in rows], DOC).withColumns(
        {c: F.lit("x") for c in ("row", "mask", "part", "first", "key", "digest", "own", "n", "label", "data", "runs")}
    )


# --- filter audit -----------------------------------------------------------------------------


def audited(rows, labels):
    def fails(d, t):
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        return (
            len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
            bool(re.search(r"[#$%&*|]", t)), d is not None and any(e is not None and e < d and (x or "") == t for e, x, _ in rows),
        )

    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    out, totals = {}, Counter()
    for part in {s or "" for *_, s in rows}:
        own = [(d, fails(d, t)) for d, t, s in rows if (s or "") == part]
        for order in permutations("ABCDE"):
            alive = own
            for step, letter in enumerate(order):
                i = "ABCDE".index(letter)
                gone = [x for x in alive if x[1][i]]
                redundant = sum(f[i] for _, f in own) - len(gone)
                alive = [x for x in alive if not x[1][i]]
                totals[part, letter] += len(gone)
                out[part, "".join(order), step + 1] = [
                    len(alive), len(gone), redundant, sum(f[i] and sum(f) == 1 for _, f in own), sum(d in good for d, _ in gone), sum(d in toxic for d, _ in gone)
                ]
    return {k: (*v, totals[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_audit_matches_every_order(spark):
    pick = random.Random(5)
    vocabulary = [f"w{i}" for i in range(200)] + ["Loud", "NOISE"]
    texts = [" ".join(pick.choices(vocabulary[: pick.choice([20, 202])], k=pick.choice([3, 49, 50, 80]))) + pick.choice(["", " #1", "\t\n", " ÄÖ"]) for _ in range(25)]
    rows = [(i, pick.choice(texts), pick.choice(["a", "b", None, ""])) for i in range(60)]
    rows += [(None, texts[0], "a"), (None, texts[0], "a"), (3, texts[1], "b"), (3, texts[1], "b"), (100, None, "a"), (101, "", "b"), (102, " \n", None), (103, "ABC " * 30_000, "c")]
    labels = [(i, pick.choice([0, 1, None]), pick.choice([0, 1, None])) for i in range(0, 60, 2)] + [(0, 1, 1), (0, 0, 0), (None, 1, 1), (999, 1, 1), (3, 1, None)]
    found = filter_audit.filter_audit(documents(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("mask", F.lit(9)))
    got = {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in found.collect()}
    assert got == audited(rows, labels)
    assert len(got) == found.count() == 4 * 600


def test_audit_splits_a_common_text_over_salts(spark, monkeypatch):
    from trapline.llm import common

    monkeypatch.setattr(common, "HOT_ROWS", 5)
    rows = [(i, "same text", "a") for i in range(40)] + [(50 + i, f"other {i}", "b") for i in range(10)]
    found = filter_audit.filter_audit(documents(spark, rows), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in found.collect()} == audited(rows, [])


def test_audit_of_other_filters_and_of_nothing(spark):
    cells = spark.createDataFrame([("p", 1, 5, 2, 1), ("p", 3, 4, 0, 0), ("p", 0, 1, 1, 1)], "part string, mask int, n long, good long, toxic long")
    got = {(r["filter_order"], r["step"]): (r["kept"], r["removed"], r["redundant"], r["shapley"]) for r in filter_audit.audit(cells, "XY").collect()}
    assert got == {("XY", 1): (1, 9, 0, 14), ("XY", 2): (1, 0, 4, 4), ("YX", 1): (6, 4, 0, 4), ("YX", 2): (1, 5, 4, 14)}
    assert filter_audit.filter_audit(documents(spark, []), spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


# --- vector codes -----------------------------------------------------------------------------


def coded(rows, parts=8, rounds=6):
    kept = [(i, [math.floor(4096 * x) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:16]
    books = [[cut(v, p) for _, v, _ in first] for p in range(parts)]

    def assign(v, p):
        far = [sum((a - b) ** 2 for a, b in zip(cut(v, p), e, strict=True)) for e in books[p]]
        return far.index(min(far)), min(far)

    for _ in range(rounds):
        each = [[assign(v, p)[0] for _, v, _ in kept] for p in range(parts)]
        for p in range(parts):
            for e in range(len(first)):
                own = [cut(v, p) for (_, v, _), b in zip(kept, each[p], strict=True) if b == e]
                if own:
                    books[p][e] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    told = [(i, lab, [assign(v, p) for p in range(parts)]) for i, v, lab in kept]
    errors = Counter()
    for _, lab, a in told:
        errors[lab] += sum(d for _, d in a)
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, "".join(f"{b:02x}" for b, _ in a), sum(d for _, d in a), errors[lab], digest) for i, lab, a in told), key=str)


def vectors(spark, rows, kind="float"):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int").withColumns({c: F.lit("x") for c in ("q", "n", "code", "error", "vector")})


@pytest.mark.parametrize("kind", ["float", "double"])
def test_codes_match_plain_python(spark, kind):
    pick = random.Random(7)
    point = lambda size=1.0: [float(np.float32(pick.gauss(0, size))) for _ in range(16)]
    rows = [(i, point(pick.choice([0.1, 1, 9000])), pick.choice([1, 2, None])) for i in range(80)]
    rows += [(100 + i, rows[3][1], 5) for i in range(20)]  # ties
    rows += [(0, rows[5][1], 1), (0, rows[5][1], 1), (None, point(), None), (None, point(), 1), (7, None, 1), (8, [*point()[:15], None], 1), (9, [*point()[:15], math.nan], 1), (10, [*point()[:15], -math.inf], 1)]
    pick.shuffle(rows)
    got = vector_codes.compress(vectors(spark, rows, kind).repartition(5))
    assert sorted((tuple(r) for r in got.collect()), key=str) == coded(rows)


def test_fewer_vectors_than_entries_and_none(spark, monkeypatch):
    rows = [(i, [float(i % 3)] * 8, i % 2) for i in range(5)]
    assert sorted((tuple(r) for r in vector_codes.compress(vectors(spark, rows)).collect()), key=str) == coded(rows)
    assert vector_codes.compress(vectors(spark, [])).count() == 0
    assert vector_codes.compress(vectors(spark, [(1, None, 1), (2, [None], 2)])).count() == 0
    monkeypatch.setattr(vector_codes, "BROADCAST_LABELS", 0)
    assert sorted((tuple(r) for r in vector_codes.compress(vectors(spark, rows)).collect()), key=str) == coded(rows)


def test_vectors_that_cannot_be_coded_are_told(spark):
    with pytest.raises(Exception, match="cannot be cut"):
        vector_codes.compress(vectors(spark, [(1, [1.0] * 9, 1)]))
    with pytest.raises(Exception, match="as many components"):
        vector_codes.compress(vectors(spark, [(i, [1.0] * (8 if i < 20 else 16), 1) for i in range(30)]))
    with pytest.raises(Exception, match="do not fit"):
        vector_codes.compress(vectors(spark, [(1, [1e30] * 8, 1)]))


@pytest.mark.parametrize("size", [1, 1 << 12, 1 << 24, 1 << 25, 1 << 27, 1 << 28])
def test_limbs_make_products_exact(size):
    random_ints = np.random.default_rng(size)
    x, y = (random_ints.integers(-size, size + 1, (50, 32)) for _ in range(2))
    x[0], y[0] = size, -size
    assert (vector_codes.exact_products(x, y) == np.array([[sum(int(a) * int(b) for a, b in zip(r, s, strict=True)) for s in y] for r in x])).all()
    bits = (53 - 6) // 2
    for limb in vector_codes.limbs(x, bits):
        assert np.abs(limb).max() <= 1 << bits


# --- word windows -----------------------------------------------------------------------------


def cleaned(rows):
    first: dict[tuple, int] = {}
    split = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t, _ in rows]
    for d, w in split:
        for i in range(len(w) - 12):
            if d is not None:
                first[tuple(w[i : i + 13])] = min(d, first.get(tuple(w[i : i + 13]), d))
    out = []
    for d, w in split:
        keep = [True] * len(w)
        for i in range(len(w) - 12):
            least = first.get(tuple(w[i : i + 13]))
            if least is not None and (d is None or least < d):
                keep[i : i + 13] = [False] * 13
        kept = " ".join(x for x, k in zip(w, keep, strict=True) if k)
        out.append((d, len(w), keep.count(False), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def passages(seed):
    pick = random.Random(seed)
    words = [f"w{i}" for i in range(400)] + ["é", "日本", "x" * 300, "y" * 299 + "z", "a\x85b", "c d"]
    new = lambda n: pick.choices(words, k=n)
    shared = [new(pick.choice([12, 13, 14, 30, 60])) for _ in range(8)]
    rows = []
    for i in range(150):
        w = [x for _ in range(pick.randint(0, 4)) for x in (new(pick.randint(0, 30)) if pick.random() < 0.5 else pick.choice(shared))]
        rows.append((i, "".join(x + pick.choice([" ", " ", " ", "\n", " \t "]) for x in w), "s"))
    text = " ".join(new(40))
    rows += [(200 + i, text, "s") for i in range(12)] + [(220 + i, f"{text} {i} {text}", "s") for i in range(12)]
    rows += [(200, text, "s"), (200, "other " + text, "s"), (None, text, "s"), (None, " ".join(new(20)) + " " + text, "s"), (None, text, "s"), (300, None, "s"), (301, "", "s"), (302, " \n ", "s")]
    rows += [(400, " ".join(new(20)), "s"), (400, " ".join(new(20)), "s"), (401, " ".join(["same"] * 3000), "s"), (402, " ".join(["same"] * 50), "s"), (403, " ".join(new(30_000)), "s")]
    lonely = " ".join(new(30))
    return rows + [(None, lonely, "s"), (None, lonely + " more", "s")]


@pytest.mark.parametrize("bucket", [windows.BUCKET, 3, 1])
def test_windows_match_plain_python(spark, bucket):
    rows = passages(3)
    got = windows.remove_windows(documents(spark, rows).repartition(7), bucket)
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got.collect()), key=str) == cleaned(rows)
    for r in got.where("kept is not null").collect():
        assert hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"]


def test_windows_of_slices_and_blocks(spark, monkeypatch):
    """Texts larger than what is cut at once, and blocks that end with each bucket; in the tasks' own process."""
    monkeypatch.setattr(windows, "_STEP", 50)
    pick = random.Random(1)
    w = pick.choices([f"v{i}" for i in range(30)], k=600)
    text = " ".join(w).encode()
    data = np.frombuffer(text, np.uint8)
    start, end, own = windows.words(data, np.array([len(text)]))
    code = windows.word_hashes(data, start, end)
    assert [text[a:b].decode() for a, b in zip(start, end, strict=True)] == w
    key, first, last = windows.super_kmers(code, own)
    assert [i for a, b in zip(first, last, strict=True) for i in range(a, b + 1)] == list(range(588))
    seen: dict[tuple, int] = {}
    for k, a, b in zip(key.tolist(), first, last, strict=True):
        for i in range(a, b + 1):
            assert seen.setdefault(tuple(w[i : i + 13]), k) == k
    assert windows.words(np.empty(0, np.uint8), np.zeros(3, np.int64))[0].size == 0


def test_windows_of_nothing(spark):
    assert windows.remove_windows(documents(spark, [])).count() == 0
    assert windows.remove_windows(documents(spark, [(1, None, None)])).collect()[0]["n_removed"] == 0
