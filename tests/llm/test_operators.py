"""Quality, URLs, decontamination, packing, language and archives on small frames."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from trapline.llm import common, decontaminate, language, packing, quality, queries, url_filter, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, 0) for i, t, lang, s in rows], DOCS)


# packing


@pytest.fixture(scope="module")
def word_ids():
    return packing.WordIds(queries.word_bpe())


@pytest.mark.parametrize(
    "text",
    ["", "  \n", "it's I'LL naïve ÉCOLE, don't''s 12³ x_1", "a\x1cb c\x85d\xa0e", "<|endoftext|> x", "Σ ß İ ǆ", "ab\x00c", "日本 語", "e\u0301 a", "x" * 500 + "!?.%%%"],
)
def test_word_table_equals_the_tokenizer(word_ids, text):
    assert word_ids.ids(text) == word_ids.whole(text)


def pack_rows():
    rng = random.Random(2)
    return [(i, " ".join(rng.choices(["alpha", "beta's", "gamma,", "Δ", "12"], k=rng.choice([0, 1, 30, 400]))), "en", rng.choice(["a", "a", "a", "b", None])) for i in range(60)] + [
        (60, None, "en", "c"), (60, "again", "en", "c"), (60, "again", "en", "c"), (None, "no id", None, "c")
    ]


def expected_ids(word_ids, rows):
    return Counter((i, np.append(np.frombuffer(word_ids.whole(t or ""), "<u2"), 2).astype("<u4").tobytes()) for i, t, *_ in rows)


@pytest.mark.parametrize("mixture", [None, {"a": 0.25, "b": 0.75}, {"a": 0.05, "none": 0.5}])
def test_pack_round_trip(spark, word_ids, monkeypatch, mixture):
    monkeypatch.setattr(packing, "GROUPS", 2)
    monkeypatch.setattr(common, "HOT_ROWS", 3)
    monkeypatch.setattr(packing, "PARTS", 3)
    rows = pack_rows() + [(200 + k, "beta " * (k % 9) * 7, "en", f"s{k % 30}") for k in range(90)]
    pieces = [r for r in packing.pack(docs_frame(spark, rows), queries.word_bpe(), window=64, mixture=mixture).collect()]
    # windows are full and without gaps, but for the last
    windows = defaultdict(list)
    for r in pieces:
        windows[r.sequence_id].append((r.offset, r.length))
    total = 0
    for w in sorted(windows):
        at = 0
        for offset, length in sorted(windows[w]):
            assert offset == at and length > 0
            at += length
        assert at == 64 or w == max(windows)
        total += at
    assert sorted(windows) == list(range(len(windows)))
    # pieces give back each document
    want = expected_ids(word_ids, rows)
    assert total == sum(len(b) // 4 * n for (_, b), n in want.items())
    spans = Counter((r.doc_id, r.doc_tokens, r.start, r.length, r.ids_crc32) for r in pieces)
    for (i, n, start, length, crc), many in spans.items():
        assert sum(c for (j, b), c in want.items() if j == i and len(b) == 4 * n and zlib.crc32(b[4 * start : 4 * (start + length)]) == crc) >= 1, (i, many)


def shares_of(pieces, source):
    share = defaultdict(int)
    for r in pieces:
        if r.source == source:
            share[r.sequence_id] += r.length
    return share


def test_windows_follow_the_proportions(spark):
    rows = [(i, "word " * 500, "en", "a" if i % 4 else "b") for i in range(40)]
    pieces = packing.pack(docs_frame(spark, rows), queries.word_bpe(), window=400).collect()
    share = shares_of(pieces, "b")
    full = [share[w] for w in range(max(r.sequence_id for r in pieces))]
    assert min(full) >= 99 and max(full) <= 101
    assert all(abs(r.deficit) <= 1 for r in pieces)


def test_windows_follow_the_mixture_until_a_source_is_used_up(spark, monkeypatch):
    """Named sources have their share of each window, all others theirs of the rest, however many share a group."""
    monkeypatch.setattr(packing, "GROUPS", 2)
    rows = [(i, "word " * 199, "en", "a") for i in range(20)] + [(100 + i, "word " * 199, "en", f"s{i % 10}") for i in range(60)]
    pieces = packing.pack(docs_frame(spark, rows), queries.word_bpe(), window=400, mixture={"a": 0.5}).collect()
    assert sum(r.length for r in pieces) == 80 * 200
    a, rest = shares_of(pieces, "a"), [shares_of(pieces, f"s{k}") for k in range(10)]
    assert all(199 <= a[w] <= 201 for w in range(20)) and not any(a[w] for w in range(21, 40))
    # 1,200 tokens each: a tenth of the half that a leaves, and of whole windows after
    assert all(16 <= s[w] <= 24 for s in rest for w in range(20)) and all(35 <= s[w] <= 45 for s in rest for w in range(21, 39))
    assert max(abs(r.deficit) for r in pieces) <= 12


def test_each_text_is_one_word_of_many_windows(spark):
    """A very long text is cut over many windows without a gap."""
    rows = [(1, "word " * 60_000, "en", "a"), (2, "x", "en", "b")]
    pieces = packing.pack(docs_frame(spark, rows), queries.word_bpe()).collect()
    long_ = sorted((r.start, r.length) for r in pieces if r.doc_id == 1)
    assert long_[0][0] == 0 and all(x + n == y for (x, n), (y, _) in zip(long_, long_[1:])) and sum(n for _, n in long_) == 60_001


def test_ids_are_shuffled_once(spark, monkeypatch):
    """Also where the sources' trees are too large to be broadcast."""
    monkeypatch.setattr(common, "HOT_ROWS", 3)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        packed = packing.pack(docs_frame(spark, pack_rows()), queries.word_bpe(), window=64)
        plan = packed._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        moved = re.findall(r"\) Exchange\nInput \[\d+\]: \[([^\n]*)\]", plan)
        assert len(moved) > 2 and sum(bool(re.search(r"\bids#", columns)) for columns in moved) == 1
        assert sum(r.length for r in packed.collect()) == sum(len(x) // 4 * n for (_, x), n in expected_ids(packing.WordIds(queries.word_bpe()), pack_rows()).items())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_deficits_are_monotone_and_complete():
    for lengths in ([5, 0, 1, 1000, 3], [7], [1] * 33):
        d = packing.Deficits(lengths)
        last = [0] * len(lengths)
        for g in range(d.total + 1):
            now = [d.given(q, g) for q in range(len(lengths))]
            assert sum(now) == g and all(a <= b <= a + 1 for a, b in zip(last, now))
            last = now
        assert last == lengths


def test_pack_of_nothing(spark):
    assert packing.pack(docs_frame(spark, []), queries.word_bpe()).count() == 0


# language


def test_language_learns_and_marks_what_has_no_letters(spark):
    rng = random.Random(4)
    words = {"de": ["schön", "und", "nicht", "keit"], "en": ["the", "with", "ough", "thing"], "fr": ["être", "eaux", "que", "ment"]}
    rows = [(k, " ".join(rng.choices(words[lang], k=40)), lang, "s") for k, lang in enumerate(["de", "en", "fr"] * 30)]
    odd = [(1000, None, "en", "s"), (1001, "12 34 ###", "en", "s"), (1002, "être", None, "s"), (1003, "", None, "s"), (1004, "a\x00b", None, "s")]
    docs = docs_frame(spark, rows + odd)
    model = language.fit(docs.where(~language.held_out("doc_id")))
    found = {r.doc_id: r for r in language.identify(docs, model).collect()}
    assert all(found[i].lang_pred == lang for i, _, lang, _ in rows)
    assert [found[i].lang_pred for i in (1000, 1001, 1003)] == ["und"] * 3 and found[1000].score == 0
    assert found[1002].lang_pred == "fr" and all(0 <= r.score <= 1 for r in found.values()) and found[1004].lang_pred in model.languages
    kept = {r.doc_id for r in language.keep_known(docs, model, 0.25).collect()}
    assert {i for i, *_ in rows} <= kept and not kept & {1000, 1001, 1003}


def brute_language(rows, train, size=3, share=0.5):
    """The same rule with sets in place of filters, letter by letter."""

    def grams(text):
        words = "".join(c if c.isalpha() else " " for c in (text or "").lower().replace("\0", " ")).split(" ")
        padded = [f" {w} " for w in words if w]
        return [w[k : k + size] for w in padded for k in range(len(w) - size + 1)]

    counts = defaultdict(Counter)
    for i, t, lang, _ in rows:
        if i in train and lang is not None and t is not None:
            counts[lang].update(grams(t))
    rate = {lang: {g: n / sum(c.values()) for g, n in c.items()} for lang, c in counts.items()}
    top = Counter()
    for each in rate.values():
        for g, r in each.items():
            top[g] = max(top[g], r)
    known = {lang: {g for g, r in each.items() if r >= share * top[g]} for lang, each in rate.items()}
    out = {}
    for i, t, *_ in rows:
        found = grams(t)
        scores = {lang: sum(g in known[lang] for g in found) / len(found) for lang in known} if found else {}
        out[i] = scores
    return out


def test_language_matches_sets(spark):
    rng = random.Random(17)
    alphabets = {"a1": "abcdeé", "b2": "cdefgh", "c3": "xyzabc", "d4": "mnopab"}
    word = lambda lang: "".join(rng.choices(alphabets[lang], k=rng.randrange(1, 7)))
    rows = [(k, " ".join(word(lang) for _ in range(rng.choice([1, 5, 60]))) + rng.choice(["", "!", " 12"]), lang, "s") for k, lang in enumerate(list(alphabets) * 40)]
    rows += [(900, None, None, "s"), (901, "ABC déf", None, "s"), (902, "x" * 300_000, None, "s"), (903, "77", None, "s")]
    train = {i for i, *_ in rows if zlib.crc32(str(i).encode()) % 4 != 2}
    docs = docs_frame(spark, rows)
    found = {r.doc_id: r for r in language.identify(docs, language.fit(docs.where(~language.held_out("doc_id")))).collect()}
    want = brute_language(rows, train)
    assert len(found) == len(rows)
    for i, scores in want.items():
        if not scores:
            assert (found[i].lang_pred, found[i].score) == ("und", 0.0)
            continue
        best = max(scores.values())
        assert abs(found[i].score - best) < 0.02 and scores[found[i].lang_pred] > best - 0.02


def test_many_languages_ties_and_repeated_rows(spark):
    """Over 64 languages take a second word of the masks; of equals the first by name wins."""
    letters = [chr(0x4E00 + k) for k in range(210)]
    rows = [(k, " ".join(letters[3 * k : 3 * k + 3]) * 3, f"l{k:02}", "s") for k in range(70)]
    rows += [(70, "same words", "zz", "s"), (71, "same words", "yy", "s"), (5, rows[5][1], "l05", "s"), (5, rows[5][1], "l05", "s"), (None, rows[6][1], None, "s")]
    frame = spark.createDataFrame([(*r, 1, "clash") for r in rows], "doc_id long, text string, lang string, source string, score long, lang_pred string")
    model = language.fit(frame)
    found = Counter((r.doc_id, r.lang_pred) for r in language.identify(frame, model).collect())
    assert found == Counter((i, "l06" if i is None else "yy" if i in (70, 71) else f"l{i:02}") for i, *_ in rows)
    assert [r.h for r in frame.where("doc_id is null").select(language.held_out("doc_id").alias("h")).collect()] == [False]


def test_each_letter_is_the_middle_of_one_gram():
    number, code = language.grams(["ab c", "", "Ünï 1x"], 3)
    assert number.tolist() == [0, 0, 0, 2, 2, 2, 2] and len(set(code.tolist())) == 7


def test_held_out_is_crc32(spark):
    rows = spark.range(50).select("id", language.held_out("id").alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 4 == 2) for r in rows)


def test_language_of_nothing(spark):
    docs = docs_frame(spark, [])
    assert language.identify(docs, language.fit(docs)).count() == 0


# decontamination


def brute_contamination(rows, items):
    words = lambda t: [w for w in re.split(r"[^\w]+|_", (t or "").lower()) if w]

    def bag(w, size):
        return Counter(tuple(w[k : k + size]) for k in range(len(w) - size + 1))

    out = set()
    for i, t in rows:
        w = words(t)
        for j, s in items:
            v = words(s)
            if not v or not w:
                continue
            size = min(5, len(v))
            a = bag(v, size)
            for k in range(max(1, len(w) - len(v) + 1)):
                b = bag(w[k : k + len(v)], size)
                if sum((a & b).values()) / sum((a | b).values()) >= 0.8:
                    out.add((i, j))
    return out


def test_contamination_matches_brute_force(spark):
    rng = random.Random(9)
    vocabulary = [f"v{k}" for k in range(400)] + ["È", "x"]
    items = [(j, " ".join(rng.choices(vocabulary, k=rng.choice([3, 6, 20, 45])))) for j in range(12)] + [(90, None), (91, "..."), (92, "rep rep rep rep rep rep rep rep")]
    rows = []
    for i in range(60):
        body = rng.choices(vocabulary, k=60)
        if i % 2:
            passage = rng.choice(items[:12])[1].upper().split()
            if i % 3 == 0 and len(passage) > 20:
                passage[rng.choice([0, 1, -1])] = "changed"
            if i % 5 == 0:
                passage = passage[: len(passage) // 2]
            at = rng.randrange(len(body))
            body[at:at] = [*passage[:-1], passage[-1] + "."]
        rows.append((i, "  ".join(body)))
    rows += [(100, None), (101, ""), (102, items[3][1]), (103, "rep, " * 30), (104, items[0][1])]
    items += [(93, "alpha beta gamma delta"), (94, "solo"), (95, items[0][1]), (95, items[1][1])]
    rows += [(105, "one two alpha beta gamma delta three four"), (106, "alpha beta gamma"), (107, "a b solo c d e f"), (108, "solo"), (104, "again"), (104, "again")]
    docs = docs_frame(spark, [(i, t, "en", "s") for i, t in rows])
    bench = spark.createDataFrame([(j, s, "z") for j, s in items], "item_id long, text string, copy string")
    found = {(r.doc_id, r.item_id) for r in decontaminate.contamination(docs, bench).collect()}
    assert found == brute_contamination(rows, items)
    assert decontaminate.contamination(docs.limit(0), bench).count() == 0


def test_the_radius_loses_no_pair(spark):
    """Windows at and just above the threshold, of all sizes: the block index against all pairs."""
    rng = random.Random(12)
    items, rows = [], []
    for n in range(5, 65):
        words = [f"i{n}w{k}" for k in range(n)]
        items.append((n, " ".join(words)))
        for v in range(12):
            again, many = list(words), n - 4
            for _ in range(max(1, many // 45 + 1)):
                again[rng.choice([0, n - 1, rng.randrange(n)])] = f"x{v}y{rng.randrange(9)}"
            rows.append((100 * n + v, " ".join([f"a{k}" for k in range(v)] + again + [f"b{k}" for k in range(5)])))
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.contamination(docs_frame(spark, [(i, t, "en", "s") for i, t in rows]), bench).collect()
    want = brute_contamination(rows, items)
    assert {(r.doc_id, r.item_id) for r in found} == want and len(want) > 200
    assert max(r.hamming for r in found) < decontaminate.RADIUS


def test_contamination_of_a_passage_altered_at_both_ends(spark):
    """Words inserted between: the best window begins at a common shingle, not where one is aligned."""
    item = [f"b{k}" for k in range(59)]
    passage = ["changed", *item[1:30], "two", "more", *item[30:58], "altered"]
    body = [f"d{k}" for k in range(200)]
    rows = [(1, " ".join(body[:80] + passage + body[80:])), (2, " ".join(body[:80] + passage)), (3, " ".join(passage)), (4, " ".join(passage[1:-1])), (5, " ".join(body[:80] + passage[:-1]))]
    items = [(7, " ".join(item)), (8, "rep " * 30)]
    rows.append((6, "rep " * 28 + "end " + "rep " * 400))
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.contamination(docs_frame(spark, [(i, t, "en", "s") for i, t in rows]), bench).collect()
    assert {(r.doc_id, r.item_id) for r in found} == brute_contamination(rows, items) >= {(1, 7)}
    assert {(r.similarity, r.start_word) for r in found if r.doc_id == 1} == {(0.803279, 81)}


def test_contamination_of_rows_without_an_id(spark):
    items = [(1, " ".join(f"b{k}" for k in range(20))), (2, " ".join(f"c{k}" for k in range(15)))]
    body = " ".join(f"d{k}" for k in range(50))
    rows = [(None, body), (None, f"{body} {items[0][1]}"), (None, f"{items[1][1]} {body}"), (5, items[0][1]), (6, body), (7, body), (7, items[1][1]), (None, None)]
    docs = docs_frame(spark, [(i, t, "en", "s") for i, t in rows])
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = [(r.doc_id, r.item_id) for r in decontaminate.contamination(docs, bench).collect()]
    assert sorted(found, key=str) == sorted(brute_contamination(rows, items), key=str) and len(found) == 4
    kept = decontaminate.without_passages(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(None, body), (6, body), (None, None)], key=str)


# URLs


def test_rules_and_parts(spark):
    urls = [
        (1, "https://www.Example.COM/en/7x?q=1#f"), (2, "http://example.net/de/81"), (3, "http://a.example.net/de/9"), (4, "ftp://x.org/es/"),
        (5, "http://notexample.com/en/"), (6, None), (7, "no scheme/en/"), (8, "http://com/en/"), (9, "http://x.com"), (10, "http://x.com?/en/"), (11, "a://b://c/d"),
    ]
    pages = spark.createDataFrame([(i, u, "", "h") for i, u in urls], "page_id long, url string, html string, host string")
    labelled = spark.createDataFrame([("http://bad.spam/x", 1), ("http://good.site/y", 0)] * 20 + [(None, 1)], "url string, label int")
    model = url_filter.fit(labelled)
    found = {r.page_id: (r.host, r.path, r.rule) for r in url_filter.judge(pages, queries.URL_RULES, model).collect()}
    assert found == {
        1: ("www.example.com", "/en/7x", "example.com/en/7"), 2: ("example.net", "/de/81", "example.net/de/8"), 3: ("a.example.net", "/de/9", "net/de/"),
        4: ("x.org", "/es/", "org/es/"), 5: ("notexample.com", "/en/", "com/en/"), 6: ("", "", None), 7: ("", "", None), 8: ("com", "/en/", "com/en/"),
        9: ("x.com", "", None), 10: ("x.com", "", None), 11: ("b:", "//c/d", None),
    }
    judged = url_filter.judge(spark.createDataFrame([(1, "http://bad.spam/z"), (2, "http://good.site/w")], "page_id long, url string"), [], model)
    assert [r.verdict for r in judged.orderBy("page_id").collect()] == ["block", "allow"]


def brute_url_model(rows, urls):
    """Ridge logistic regression on the n-grams as text, by Newton steps."""

    def found(url):
        host, slash, rest = url.partition("://")[2].partition("/")
        path = (slash + rest).split("?")[0].split("#")[0]
        out = set()
        for mark, x in (("h", host), ("p", path)):
            padded = "^" + re.sub("[0-9]+", "0", x) + "$"
            out |= {mark + padded[k : k + n] for n in (3, 4) for k in range(len(padded) - n + 1)}
        return out

    names = sorted(set().union(*(found(u) for u, _ in rows), *(found(u) for u in urls)))
    design = lambda us: np.array([[1.0] + [float(g in f) for g in names] for f in map(found, us)])
    a, y = design([u for u, _ in rows]), np.array([float(v) for _, v in rows])
    w, penalty = np.zeros(a.shape[1]), np.r_[1e-9, np.full(len(names), 0.01)]
    for _ in range(50):
        p = 1 / (1 + np.exp(-a @ w))
        w += np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a / len(y) + np.diag(penalty), a.T @ (y - p) / len(y) - penalty * w)
    return 1 / (1 + np.exp(-design(urls) @ w))


def test_url_scores_match_a_plain_regression(spark):
    rng = random.Random(3)
    rows = [(f"http://{rng.choice(['shop', 'news'])}.{rng.choice(['a', 'bb'])}.com/{w}/{rng.randrange(99)}?x=1", int(w == "win" or rng.random() < 0.1)) for w in rng.choices(["win", "art", "docs"], k=120)]
    urls = ["http://shop.a.com/win/7", "http://news.bb.com/docs/3#y", "http://other.org/art/win", "http://news.a.com/"]
    model = url_filter.fit(spark.createDataFrame(rows, "url string, label int"))
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    score = [r.score for r in url_filter.judge(pages, [], model).orderBy("page_id").collect()]
    assert np.abs(np.array(score) - brute_url_model(rows, urls)).max() < 0.05  # a collision or two


def test_many_rules_judge_like_few(spark, monkeypatch):
    urls = [f"http://{h}{p}" for h in ("a.com", "x.a.com", "b.a.com", "com", "a.org", "") for p in ("", "/", "/en/", "/en/7?q", "/de/en/")] + [None, "x", "http://" + "y" * 100_000 + ".a.com/en/"]
    rules = [("com/", "block"), ("a.com/en/", "allow"), ("b.a.com/en", "block"), ("a.org/de", "allow"), ("a.com/en/", "block"), ("x.a.com/", "allow")]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)] + [(0, urls[0]), (None, urls[3])], "page_id long, url string")
    few = Counter((r.page_id, r.rule, r.verdict) for r in url_filter.judge(pages, rules, None).collect())
    monkeypatch.setattr(url_filter, "RULE_COLUMNS", 1)
    assert Counter((r.page_id, r.rule, r.verdict) for r in url_filter.judge(pages, rules, None).collect()) == few
    assert sum(few.values()) == len(urls) + 2 and (3, "a.com/en/", "block") in few


def test_urls_without_labels_or_rows(spark):
    none = spark.createDataFrame([], "url string, label int")
    pages = spark.createDataFrame([(1, "http://a.com/en/"), (None, None)], "page_id long, url string")
    assert url_filter.fit(none) is None
    assert {(r.page_id, r.verdict, r.score) for r in url_filter.judge(pages, [("com/en/", "block")], None).collect()} == {(1, "block", None), (None, "allow", None)}
    assert url_filter.judge(pages.limit(0), [("com/en/", "block")], None).count() == 0
    one = url_filter.fit(spark.createDataFrame([("http://a.com/", 1)], "url string, label int"))
    assert url_filter.judge(pages, [], one).count() == 2


# quality


def test_quality_shrinks_sites_and_tells_junk(spark):
    rng = random.Random(6)
    good = lambda: " ".join(rng.choices(["plain", "words", "here", "now", "again"], k=60)) + "."
    junk = lambda: "%%% ".join(rng.choices(["BUY", "NOW", "###"], k=60))
    rows = [(i, junk() if i % 5 == 0 else good(), "en", f"s{i % 7}") for i in range(200)] + [(900, None, None, None), (901, good(), "en", "new")]
    labels = spark.createDataFrame([(i, int(i % 5 != 0), 0) for i in range(0, 200, 2)] + [(5000, None, None), (0, 0, 1)], "doc_id long, quality int, toxic int")
    found = {r.doc_id: r for r in quality.classify(docs_frame(spark, rows), labels).collect()}
    assert len(found) == 202 and all(found[i].keep == (i % 5 != 0) for i in range(200))
    assert all(0 < r.host_quality < 1 and 0 < r.path_quality < 1 for r in found.values())
    none = quality.classify(docs_frame(spark, []), labels)
    assert none.count() == 0


def test_site_posteriors_pull_sparse_sites_to_the_prior(spark):
    rows = [("a", "x", 1.0)] * 400 + [("b", "x", 0.0)] * 400 + [("c", "x", 1.0), ("a", "y", 0.0)]
    found = {(r.host, r.path): r for r in quality.site_posteriors(spark.createDataFrame(rows, "host string, path string, quality double")).collect()}
    assert found["a", "x"].path_quality > 0.9 > found["c", "x"].path_quality > 0.5 > found["b", "x"].path_quality
    assert found["a", "y"].path_quality < found["a", "y"].host_quality


def brute_sites(rows):
    """(host, path) to (host quality, path quality), from the sums of squares in plain Python."""
    paths, hosts = defaultdict(list), defaultdict(list)
    for h, p, q in rows:
        paths[h, p].append(q)
        hosts[h].append(q)
    n, k = len(rows), sum(q for *_, q in rows)
    prior = (k + 0.5) / (n + 1)
    part = lambda each: sum(sum(v) ** 2 / len(v) for v in each.values())
    spread = (part(hosts) - k * k / n - (len(hosts) - 1) * prior * (1 - prior)) / (n - sum(len(v) ** 2 for v in hosts.values()) / n)
    clip = lambda x: min(1e4, max(1.0, x))
    host_k = clip(prior * (1 - prior) / spread - 1) if spread > 0 else 1e4
    inner = sum(sum(v) * (1 - sum(v) / len(v)) for v in hosts.values()) / n
    spread = (part(paths) - part(hosts) - (len(paths) - len(hosts)) * inner) / max(1e-9, n - sum(len(v) ** 2 / len(hosts[h]) for (h, _), v in paths.items()))
    path_k = clip(inner / spread - 1) if spread > 0 else 1e4
    quality = {h: (sum(v) + host_k * prior) / (len(v) + host_k) for h, v in hosts.items()}
    return {(h, p): (quality[h], (sum(v) + path_k * quality[h]) / (len(v) + path_k)) for (h, p), v in paths.items()}, prior


def test_quality_matches_plain_python(spark):
    rng = random.Random(31)
    text = lambda good: " ".join(rng.choices(["fine", "words", "here.", "now"] if good else ["BUY!!", "###", "NOW", "fine"], k=rng.randrange(1, 50)))
    rows = []
    for i in range(240):
        host, path = rng.choice(["h1", "h2", "h3", None]), rng.choice(["p1", "p2", None])
        rows.append((i, text(rng.random() < {"h1": 0.9, "h2": 0.2}.get(host, 0.5)), path, host))
    rows += [(500, None, None, None), (501, "ü" * 200_000, "p1", "h1"), (502, "", "new", "h1"), (503, "x", "new", "new"), (3, rows[3][1], rows[3][2], rows[3][3]), (None, "fine", "p1", "h1")]
    known = {i: float(rng.random() < 0.5 + (0.4 if "fine" in t.split() else -0.4)) for i, t, *_ in rows[:200]}
    labels = [(i, int(q), 0) for i, q in known.items()] + [(4, 1 - int(known[4]), 0), (9999, 1, 0), (6, None, 1), (None, 1, 0)]
    known[4] = 0.5
    frame = spark.createDataFrame([(i, t, lang, s, 0, 9.0, "no") for i, t, lang, s in rows], DOCS + ", quality double, host string")
    found = quality.classify(frame, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    labelled = [(s or "", lang or "", known[i]) for i, _, lang, s in rows if i in known]
    sites, prior = brute_sites(labelled)
    hosts = {h: q for (h, _), (q, _) in sites.items()}
    x = np.array([quality.describe(t or "") for _, t, *_ in rows])
    at = [k for k, r in enumerate(rows) if r[0] in known]
    logits = quality.TextModel.fit(x[at], np.array([known[rows[k][0]] for k in at])).logits(x)
    odds = lambda q: np.log(q / (1 - q))
    want = Counter()
    for (i, _, lang, s), z in zip(rows, logits):
        host_q = hosts.get(s or "", prior)
        path_q = sites.get((s or "", lang or ""), (0, host_q))[1]
        want[i, round(float(1 / (1 + np.exp(-(z + odds(path_q) - odds(prior))))), 4), round(path_q, 4)] += 1
    assert Counter((r.doc_id, round(r.quality, 4), round(r.path_quality, 4)) for r in found) == want


# archives


def test_archive_round_trip_and_lookup(spark, tmp_path):
    pages = [(3, "http://b.example.com/x?y#z", "<p>é\r\n\r\nWARC/1.1\r\n"), (1, "http://a.example.com/", "<p>é\r\n\r\nWARC/1.1\r\n"), (2, None, None), (5, "", ""), (4, "http://a.example.com/\r\nX: y", "z"), (9, "http://b.example.com/x?y", "q")]
    frame = spark.createDataFrame([(*p, "clash") for p in pages], "page_id long, url string, html string, payload string")
    index = warc.archive_pages(frame, str(tmp_path / "warc"))
    found = {r.page_id: r for r in index.captures().collect()}
    first = {}
    for i, _, html in sorted(pages):
        first.setdefault(html or "", i)
    for i, _, html in pages:
        data = (html or "").encode()
        r = found[i]
        assert r.payload_bytes == len(data) and r.payload_digest == base64.b32encode(hashlib.sha1(data).digest()).decode()
        assert (r.record_type, r.refers_to) == (("response", None) if first[html or ""] == i else ("revisit", first[html or ""]))
    asked = spark.createDataFrame([("http://B.example.com/x?y",), ("http://nowhere/",), ("http://a.example.com/\r\nX: y",), (None,), (None,)], "url string")
    hits = warc.fetch(index.lookup(asked)).collect()
    assert sorted((r.page_id, bytes(r.payload)) for r in hits) == [(2, b""), (3, b""), (4, b"z"), (9, b"q")]
    whole = warc.fetch(index.captures().where("record_type = 'response'")).collect()
    assert {r.page_id: bytes(r.payload).decode() for r in whole} == {i: next(h or "" for j, _, h in pages if j == i) for i in first.values()}


@pytest.mark.parametrize("block", [1, 3, 3000])
def test_lookup_of_many_pages_finds_each_once(spark, tmp_path, monkeypatch, block):
    """Blocks and shards that begin within a key's captures, urls of many pages, very long pages, null and repeated rows."""
    monkeypatch.setattr(warc, "BLOCK", block)
    monkeypatch.setattr(warc, "FILE_RECORDS", [(20, 5), (1000, 2), (1 << 40, 1)])
    rng = random.Random(block)
    pages = [(k, rng.choice([None, "", "x y", "http://a.b/ c", *(f"http://h{j % 3}.com/{j}" for j in range(12))]), "p" * rng.choice([0, 3, 21, 1000, 1001, 70_000])) for k in range(60)]
    pages += [(60, "http://h0.com/0", None), (7, *pages[7][1:]), (None, "http://h0.com/0", "null id"), (61, "http://h0.com/0", "é" * 3_000_000)]
    frame = spark.createDataFrame([(*p, 5) for p in pages], "page_id long, url string, html string, offset int").repartition(3)
    index = warc.archive_pages(frame, str(tmp_path / "warc"))
    found = warc.fetch(index.lookup(frame)).collect()
    assert Counter(str(r.page_id) for r in found) == Counter(str(i) for i, *_ in pages)
    text = {i: (h or "").encode() for i, _, h in pages}
    first = {}
    for i, data in sorted((x for x in text.items() if x[0] is not None)):
        first.setdefault(data, i)
    for r in found:
        data = text[r.page_id]
        assert r.payload_digest == base64.b32encode(hashlib.sha1(data).digest()).decode() and r.payload_bytes == len(data)
        low = first.get(data)
        assert (r.record_type, r.refers_to) == (("response", None) if low in (r.page_id, None) else ("revisit", low))
        assert bytes(r.payload) == (data if r.record_type == "response" else b"")
    some = index.lookup(spark.createDataFrame([("http://h1.com/4",), ("http://zzz/",), ("http://!/",)], "url string")).collect()
    assert Counter(r.page_id for r in some) == Counter(i for i, u, _ in pages if u == "http://h1.com/4")


def test_archive_of_nothing(spark, tmp_path):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.archive_pages(none, str(tmp_path / "warc")).captures().count() == 0
