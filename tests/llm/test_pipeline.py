"""The whole pipeline against brute force, first runs of a session, and empty tables."""

import os
import random
import subprocess
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
import regex

from test_dedup import brute_exact, brute_fingerprint, components
from test_operators import brute_contamination, brute_language

import corpus_pipeline
from trapline.llm import packing, queries
from trapline.llm.common import table

REPO = str(Path(__file__).parents[2])
DOCS = "doc_id long, text string, lang string, source string, n_chars long, row string, _number int, fp long"


def corpus():
    rng = random.Random(41)
    alphabet = {"en": "abcdefgh", "fr": "éèàmnopq"}
    word = lambda lang: "".join(rng.choices(alphabet[lang], k=rng.randrange(3, 8)))
    text = lambda lang, n: " ".join(word(lang) for _ in range(n))
    items = [(k, text("en", rng.choice([4, 20, 40]))) for k in range(8)]
    rows = [(k, text(lang, rng.choice([30, 80, 300])), lang, rng.choice(["src0", "a", "b", None])) for k, lang in enumerate(["en", "fr"] * 40)]
    for k in range(10):  # exact copies but for blanks, near copies, passages
        i, t, lang, s = rows[k]
        words = t.split(" ")
        rows.append((200 + k, "\n".join(words) + "  ", lang, s))
        rows.append((300 + k, " ".join([*words[:-1], "changed"]), lang, s))
        rows.append((400 + k, text("en", 30) + " " + items[k % 8][1].upper() + ". " + text("en", 25), "en", "a"))
    rows += [(500, None, "en", "a"), (501, "", None, "a"), (502, "12 34 -- 56", "en", "b"), (503, "日本語の文章です", None, "b"), (None, text("en", 50), "en", "a"), (504, text("en", 20_000), "en", "src0")]
    return rows + [rows[3], rows[3]], items


def bare(text):
    return regex.sub(r"[\x20\x09-\x0D]", "", text or "")


def test_pipeline_matches_brute_force(spark, tmp_path):
    rows, items = corpus()
    spark.createDataFrame([(*r, 0, "x", 1, 2) for r in rows], DOCS).repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    left = list(rows)
    docs, kept = table(spark, str(tmp_path), "documents"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == [x.split()[0] for x in DOCS.split(", ")]
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept.append(Counter((r.doc_id, r.text) for r in docs.collect()))

    train = {i for i, *_ in rows if i is None or zlib.crc32(str(i).encode()) % 4 != 2}
    scores = brute_language(rows, train)
    left = [r for r in left if scores[r[0]] and max(scores[r[0]].values()) >= corpus_pipeline.LEAST_SCORE]
    assert kept[0] == Counter(r[:2] for r in left)
    assert {500, 501, 502, 503} & {r[0] for r in left} == set()

    groups = defaultdict(list)
    for r in left:
        groups[bare(r[1])].append(r)
    left = [min(g, key=lambda r: (-len(r[1]), r[0] is None, r[0] or 0)) for g in groups.values()]
    assert kept[1] == Counter(r[:2] for r in left) and len(left) == len(brute_exact([r[:2] for r in left]))

    codes = [brute_fingerprint(r[1]) for r in left]
    root = components(len(left), [(a, b) for a in range(len(left)) for b in range(a) if (codes[a] ^ codes[b]).bit_count() <= 3])
    first = {}
    for k in range(len(left)):
        first[root[k]] = min(first.get(root[k], k), k, key=lambda j: (left[j][0] is None, left[j][0] or 0))
    left = [r for k, r in enumerate(left) if first[root[k]] == k]
    assert kept[2] == Counter(r[:2] for r in left) and len(left) < len(codes)

    held = {i for i, _ in brute_contamination([(k, r[1]) for k, r in enumerate(left)], items)}
    left = [r for k, r in enumerate(left) if k not in held]
    assert kept[3] == Counter(r[:2] for r in left) and len(held) >= 8

    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    encode = packing.WordIds(queries.word_bpe()).whole
    want = {i: np.append(np.frombuffer(encode(t), "<u2"), 2).astype("<u4").tobytes() for i, t, *_ in left}
    got = defaultdict(list)
    for r in pieces:
        got[r.doc_id].append((r.start, r.length, r.ids_crc32))
    assert set(got) == set(want)
    for i, parts in got.items():
        at = 0
        for start, length, crc in sorted(parts):
            assert start == at and crc == zlib.crc32(want[i][4 * at : 4 * (at + length)])
            at += length
        assert 4 * at == len(want[i])


def test_stages_tell_rows_apart_by_number(spark, tmp_path):
    """Rows that share a doc_id, or have none, are judged each by its own text; only a benchmark passage takes all rows of its doc_id along."""
    rng = random.Random(2)
    text = lambda n: " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(n))
    base, far, item, other = text(2000), text(60), text(30), text(60)
    near = base[:-5] + "zzzzz"
    assert base != near and (brute_fingerprint(base) ^ brute_fingerprint(near)).bit_count() <= 3
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    def left(stage, rows):
        docs = spark.createDataFrame([(*r, "en", "s", 0, "x", 1, 2) for r in rows], DOCS).repartition(3)
        return Counter((r.doc_id, r.text) for r in stage(spark, docs, str(tmp_path)).collect())

    blanks = base.replace(" ", "  ")
    assert left(corpus_pipeline.near_duplicates, [(1, base), (5, near), (5, far), (None, near), (None, far), (None, other)]) == Counter([(1, base), (5, far), (None, other)])
    assert left(corpus_pipeline.near_duplicates, [(None, base), (None, near), (None, near)]).total() == 1
    assert left(corpus_pipeline.near_duplicates, [(7, base), (7, base), (7, far), (8, None), (9, "")]) == Counter([(7, base), (7, far), (8, None)])
    assert left(corpus_pipeline.exact_duplicates, [(1, base), (5, blanks), (5, far), (None, base), (None, other), (1, base)]) == Counter([(5, blanks), (5, far), (None, other)])
    held = f"{far} {item} {far}"
    assert left(corpus_pipeline.benchmark_passages, [(3, held), (3, base), (3, held), (2, base), (None, held), (None, other), (4, None)]) == Counter([(2, base), (None, other), (4, None)])
    assert left(corpus_pipeline.language_id, [(3, base), (3, base), (3, "12"), (None, base), (None, None), (16, far)]) == Counter([(3, base), (3, base), (None, base), (16, far)])
    packed = corpus_pipeline.pack(spark, spark.createDataFrame([(*r, "en", None, 0, "x", 1, 2) for r in [(3, base), (3, base), (3, far), (None, base), (None, None)]], DOCS), "")
    sums = Counter()
    for r in packed.collect():
        sums[r.doc_id] += r.length
    encode = packing.WordIds(queries.word_bpe()).whole
    size = lambda t: len(encode(t)) // 2 + 1
    assert sums == Counter({3: 2 * size(base) + size(far), None: size(base) + 1})


FRESH = """
import sys, tempfile
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
import __spark_entry__ as entry
spark = SparkSession.builder.master("local-cluster[1,2,1024]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").config(
    "spark.checkpoint.dir", "file://" + tempfile.mkdtemp()).getOrCreate()
print("rows", entry.queries()[{name!r}](spark, "/root/testdata/sf0.001").count(), flush=True)
spark.stop()
"""


@pytest.mark.parametrize("name", ["op5_pack", "op6_substrings", "op8_language", "op9_simhash", "op10_warc", "op12_vector_codes", "op13_windows"])
def test_each_is_the_first_query_of_a_session(tmp_path, name):
    """On executors that do not find the package by themselves; each query has a process and a small JVM of its own."""
    env = {k: v for k, v in os.environ.items() if k == "SPARK_HOME" or not k.startswith(("PYTHONPATH", "PYSPARK_", "SPARK_"))}
    env |= {"PYSPARK_SUBMIT_ARGS": "--driver-memory 768m pyspark-shell", "SPARK_LOCAL_IP": "127.0.0.1"}
    log = tmp_path / "log"
    with log.open("w") as out:
        subprocess.run([sys.executable, "-c", FRESH.format(repo=REPO, name=name)], cwd=tmp_path, env=env, stdout=out, stderr=out, timeout=600)
    said = log.read_text(errors="replace")
    found = regex.search(r"^rows ([1-9]\d*)$", said, regex.MULTILINE)
    assert found, said[-6000:]


def test_all_run_on_empty_tables(spark, tmp_path):
    for name in ("documents", "pages", "benchmark", "labels", "embeddings"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    for query in [*queries.queries().values(), corpus_pipeline.run]:
        assert query(spark, str(tmp_path)).count() == 0
