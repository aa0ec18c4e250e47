"""Exact, near and line duplicates and repeated substrings against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from xxhash import xxh64_intdigest

from trapline.llm import common, exact_dedup, lines, simhash, substrings

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = DOCS + ", row string, `key` string, _n long, fp string, text_sha256 string"


def frame(spark, rows, extra=False):
    full = [(i, t, "en", "s", 0) + (("x", "y", 1, "z", "q") if extra else ()) for i, t in rows]
    return spark.createDataFrame(full, EXTRA if extra else DOCS)


def components(n, linked):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    return [find(x) for x in range(n)]


ROWS = [(1, "a b"), (2, "ab"), (3, "a\tb \n"), (4, None), (5, ""), (6, " \x0b"), (7, "x"), (8, "a b"), (8, "a b"), (None, "x y z longer"), (9, "\xa0")]


def brute_exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i is None, i or 0, i))
    out = []
    for text, each in groups.items():
        keep = min(each)[3]
        digest = hashlib.sha256(text.encode()).hexdigest()
        out += [(i, keep, len(each), digest) for *_, i in each]
    return Counter(out)


@pytest.mark.parametrize("extra", [False, True])
def test_exact_matches_brute_force(spark, extra):
    found = exact_dedup.exact_dedup(frame(spark, ROWS, extra).repartition(7), fan_in=2).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found) == brute_exact(ROWS)
    assert sum(r.kept for r in found) == len({r.text_sha256 for r in found})


def test_exact_of_nothing(spark):
    assert exact_dedup.exact_dedup(frame(spark, [])).count() == 0


def test_keep_first_keeps_each_text_once(spark):
    docs = frame(spark, [*ROWS, (8, "a b"), (8, "ab"), (20, "é" * 300_000), (21, "é " * 300_000)]).withColumnRenamed("lang", "_number")
    kept = exact_dedup.keep_first(docs)
    assert kept.columns == ["doc_id", "text", "_number", "source", "n_chars"]
    assert sorted((str(r.doc_id), len(r.text or "")) for r in kept.collect()) == sorted([("3", 5), ("6", 2), ("7", 1), ("None", 12), ("9", 1), ("21", 600_000)])
    assert exact_dedup.keep_first(docs.limit(0)).count() == 0


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    codes = [xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(c >> b & 1 for c in codes) > len(codes))


def near_rows():
    rng = random.Random(3)
    vocabulary = [f"w{k}" for k in range(300)] + ["Éa", "UP"]
    rows = []
    for _ in range(25):
        words = rng.choices(vocabulary, k=rng.choice([1, 2, 3, 40, 400]))
        rows.append(" ".join(words))
        for _ in range(3):
            again = list(words)
            again[rng.randrange(len(again))] = rng.choice(vocabulary)
            rows.append("\n".join(again))
    return list(enumerate([*rows, None, "", " \t", rows[0], "one", "ONE"]))


def test_simhash_matches_brute_force(spark):
    rows = near_rows()
    codes = [brute_fingerprint(t) for _, t in rows]
    n = len(rows)
    want = components(n, [(a, b) for a in range(n) for b in range(a) if (codes[a] ^ codes[b]).bit_count() <= 3])
    found = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.simhash_groups(frame(spark, rows, True)).collect()}
    assert found == {i: (f"{codes[i]:016x}", want[i]) for i in range(n)}


def dense_points(seed):
    """Five clouds of fingerprints a few bits from their centre, and scattered ones."""
    rng = random.Random(seed)
    base = [rng.getrandbits(64) for _ in range(5)]
    close = {b ^ sum(1 << k for k in rng.sample(range(64), rng.randrange(6))) for b in base for _ in range(120)}
    return sorted(close | {rng.getrandbits(64) for _ in range(200)})


@pytest.mark.parametrize("leaf", [40, 1 << 20])
def test_shards_that_are_split_lose_no_link(spark, monkeypatch, leaf):
    """Small shards are split by further trees, in the tasks as well as in this process."""
    points = dense_points(leaf)
    number = {simhash._signed(p): k for k, p in enumerate(points)}
    want = components(len(points), [(a, b) for a in range(len(points)) for b in range(a) if (points[a] ^ points[b]).bit_count() <= 3])
    one, two = simhash.halves(simhash._MASK64)
    todo = [(0, simhash._signed(r), simhash._signed(s), p) for r, s in ((one, two), (two, one)) for p in number]
    monkeypatch.setattr(simhash, "LEAF", leaf)
    links, rounds = [], 0
    while todo:
        frame_ = spark.createDataFrame(todo, "leaf long, region long, rest long, fp long")
        batch = simhash.shards(frame_).sort("leaf", "rest").toArrow().combine_chunks().to_batches()
        assert {x for b in batch for x in b.column(2).to_pylist()} == {p for *_, p in todo}
        out = [r for b in simhash._link(iter(batch)) for r in b.to_pylist()]
        links += [(r["a"], r["b"]) for r in out if not r["todo"]]
        todo = sorted({(r["a"], r["region"], r["rest"], r["b"]) for r in out if r["todo"]})
        rounds += 1
    assert components(len(points), [(number[a], number[b]) for a, b in links]) == want
    assert (rounds > 1) == (leaf < 100)


def test_stars_join_what_many_links_join():
    rng = random.Random(8)
    base = rng.getrandbits(64)
    points = np.array(sorted({base ^ (1 << rng.randrange(64)) for _ in range(60)} | {base, base ^ 7, base ^ 63}), np.uint64)
    links = list(simhash.near(points, points[:0]))
    number = {int(p): k for k, p in enumerate(points)}
    want = [(a, b) for a in range(len(points)) for b in range(a) if int(points[a] ^ points[b]).bit_count() <= 3]
    assert components(len(points), [(number[a], number[b]) for a, b in links]) == components(len(points), want)


def test_fingerprint_of_a_very_long_text(monkeypatch):
    """Counts of pieces add up, also where the text's last words fill a piece."""
    rng = random.Random(14)
    monkeypatch.setattr(simhash, "_STEP", 64)
    for n in (63, 64, 65, 66, 67, 128, 130, 1000):
        text = " ".join(rng.choices(["one", "TWO", "three", "é"], k=n))
        assert simhash.fingerprint(text.encode()) == brute_fingerprint(text)


def test_simhash_of_rows_without_an_id_and_common_texts(spark, monkeypatch):
    """A text of many rows is dealt over salts; null ids name no component unless alone."""
    monkeypatch.setattr(common, "HOT_ROWS", 3)
    rows = [(i, "the same words here") for i in range(40)] + [(None, "the same words here"), (None, "all alone in this text"), (7, "the same words here")]
    rows += [(100 + i, f"other {i} words {i * 7} and {i * 13}") for i in range(20)]
    found = Counter((r.doc_id, r.component_id) for r in simhash.simhash_groups(frame(spark, rows)).collect())
    codes = [brute_fingerprint(t) for _, t in rows]
    root = components(len(rows), [(a, b) for a in range(len(rows)) for b in range(a) if (codes[a] ^ codes[b]).bit_count() <= 3])
    low = {r: min((rows[k][0] for k in range(len(rows)) if root[k] == r and rows[k][0] is not None), default=None) for r in set(root)}
    assert found == Counter((i, low[root[k]]) for k, (i, _) in enumerate(rows))


def test_simhash_of_nothing(spark):
    assert simhash.simhash_groups(frame(spark, [])).count() == 0


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def line_rows():
    rng = random.Random(7)
    pool = ["".join(rng.choices("abcé ", k=rng.choice([6, 8, 9, 10, 14, *range(17, 24), 40]))) for _ in range(24)]
    rows = []
    for i in range(30):
        each = []
        for _ in range(rng.randrange(1, 4)):
            line = list(rng.choice(pool))
            for _ in range(rng.randrange(4)):
                at = rng.randrange(len(line))
                line[at : at + rng.randrange(2)] = rng.choice(["", "x", "yz"])
            each.append("".join(line))
        rows.append((i, "\n".join(each)))
    return [*rows, (30, None), (31, ""), (32, "short\nshort\n\n"), (33, "shorty")]


@pytest.mark.parametrize("crowded", [0, 32])
def test_lines_match_brute_force(spark, monkeypatch, crowded):
    monkeypatch.setattr(lines, "CROWDED", crowded)
    monkeypatch.setattr(common, "HOT_ROWS", 3)
    rows = line_rows()
    flat = [(i, k, x) for i, t in rows for k, x in enumerate((t or "").split("\n")) if x]
    n = len(flat)
    near = [
        (a, b) for a in range(n) for b in range(a)
        if flat[a][2] == flat[b][2] or edit_distance(flat[a][2], flat[b][2]) <= min(2, max(len(flat[a][2]), len(flat[b][2])) // 10)
    ]
    root = components(n, near)
    texts = defaultdict(set)
    for a, b in near:
        if flat[a][2] != flat[b][2]:
            texts[flat[a][2]].add(flat[b][2])
            texts[flat[b][2]].add(flat[a][2])
    want = {(i, k): (root[x] != x, flat[root[x]][:2], len(texts[t])) for x, (i, k, t) in enumerate(flat)}
    found = {(r.doc_id, r.line_no): (r.dropped, (r.class_doc, r.class_line), r.links) for r in lines.line_classes(frame(spark, rows, True)).collect()}
    assert found == want
    per = {r.doc_id: (r.n_lines, r.n_dropped) for r in lines.line_dedup(frame(spark, rows)).collect()}
    assert per[30] == (0, 0) and per[32] == (2, 1) and len(per) == len(rows)
    cleaned = {r.doc_id: r.text for r in lines.without_duplicates(frame(spark, rows)).collect()}
    assert cleaned[32] == "short\n\n"


def test_lines_of_nothing(spark):
    assert lines.line_dedup(frame(spark, [])).count() == 0


def substring_rows():
    rng = random.Random(11)
    word = lambda n: "".join(rng.choices("abcdefgh é", k=n))
    shared, period = word(700), word(13)
    texts = [word(300) + shared[a:b] + word(200) for a, b in [(0, 700), (100, 560), (50, 449), (300, 700), (0, 401)]]
    texts += [period * 60, period * 40, word(1500), "a" * 401, "a" * 400, None, "", shared, shared, word(90)]
    return list(enumerate(texts))


def brute_substrings(rows):
    data = [(t or "").encode() for _, t in rows]
    count = Counter(d[k : k + 400] for d in data for k in range(len(d) - 399))
    out = {}
    for (i, _), d in zip(rows, data):
        gone = np.zeros(len(d), dtype=bool)
        for k in range(len(d) - 399):
            if count[d[k : k + 400]] > 1:
                gone[k : k + 400] = True
        runs = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        kept = bytes(b for b, g in zip(d, gone) if not g)
        out[i] = (len(d), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest())
    return out


def test_substrings_match_brute_force(spark):
    rows = substring_rows()
    found = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substrings.remove_repeats(frame(spark, rows, True)).collect()}
    assert found == brute_substrings(rows)


def test_substrings_of_rows_without_an_id(spark):
    """Rows with a null doc_id are cut and counted like all others."""
    rows = substring_rows()
    lost = {1, 4, 7, 11}
    want = brute_substrings(rows)
    given = [(None if i in lost else i, t) for i, t in rows]
    found = substrings.remove_repeats(frame(spark, given)).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found) == Counter((None if i in lost else i, *w) for i, w in want.items())
    assert sum(r.n_removed > 0 for r in found if r.doc_id is None) == 2


def test_a_passage_goes_from_400_bytes_on(spark):
    """By its bytes, not its words: one of over 50 words that is a byte too short stays; n_bytes is the whole text's size either way."""
    rng = random.Random(31)
    word = lambda n: "".join(rng.choices("abcdefgh", k=n))
    passage = " ".join([*(word(5) for _ in range(65)), word(10)])
    assert len(passage) == 400 and len(passage[:-1].split()) > 50
    for size, gone in [(399, 0), (400, 400)]:
        rows = [(k, f"{k}{word(300)}{k}{passage[:size]}{k}{word(200)}") for k in range(2)]
        found = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substrings.remove_repeats(frame(spark, rows)).collect()}
        assert found == brute_substrings(rows)
        assert [found[k][:2] for k in range(2)] == [(503 + size, gone)] * 2


@pytest.mark.parametrize("size", [500, 900])
def test_large_groups_are_split_and_settled_alike(spark, monkeypatch, size):
    """Groups over the limit are split by the bytes around their anchor, level by level."""
    monkeypatch.setattr(substrings, "GROUP_BYTES", size)
    monkeypatch.setattr(common, "HOT_ROWS", 3)
    rows = substring_rows()
    rows += [(100 + k, t + t[:450]) for k, (_, t) in enumerate(rows[:6])]
    found = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substrings.remove_repeats(frame(spark, rows)).collect()}
    assert found == brute_substrings(rows)


def test_parts_of_a_piece_have_its_strings_once_and_equal_ones_the_same_code():
    rng = random.Random(21)
    shared = bytes(rng.choices(b"abcdef", k=700))
    codes = {}
    for _ in range(12):
        left, right = bytes(rng.choices(b"xyz", k=rng.randrange(60))), bytes(rng.choices(b"xyz", k=rng.randrange(60)))
        piece = left + shared[:500] + right
        mid = len(left) + 240
        while len(piece) > mid + 400:
            piece = piece[:-1]
        cut = max(0, mid - 368)
        for ranges in substrings.RANGES[1:]:
            got = []
            for code, part, m, at in substrings.narrower(piece[cut:], mid - cut, ranges):
                assert part == piece[cut + at : cut + at + len(part)] and m == mid - cut - at
                got += range(at, at + len(part) - 399)
                for k in range(len(part) - 399):
                    assert codes.setdefault((ranges, part[k : k + 400]), code) == code
            assert got == list(range(len(piece) - cut - 399))


def test_anchors_of_a_very_long_text(monkeypatch):
    """Pieces of a long text are searched apart; strings over their seams keep their anchor."""
    rng = random.Random(5)
    data = bytes(rng.choices(b"abcdefghij ", k=6000))
    data += data[500:2000] + data[100:1000]
    whole = substrings.anchors(data)
    monkeypatch.setattr(substrings, "_STEP", 700)
    code, place, first = substrings.anchors(data)

    def of(c, p, f):
        owner = np.searchsorted(f, np.arange(len(data) - 399), side="right") - 1
        return c[owner].tolist(), p[owner].tolist()

    assert of(code, place, first) == of(*whole)


def test_suffix_order(spark):
    rng = random.Random(1)
    text = bytes(rng.choices(b"ab\xff", k=1500))
    text += text[100:900] + b"a" * 500
    order = substrings.suffix_order(np.frombuffer(text, np.uint8))
    assert sorted(order) == list(range(len(text)))
    assert [text[k : k + 400] for k in order] == sorted(text[k : k + 400] for k in range(len(text)))


def test_substrings_of_nothing(spark):
    assert substrings.remove_repeats(frame(spark, [])).count() == 0
