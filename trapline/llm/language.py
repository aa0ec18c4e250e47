"""Language identification with bit-sliced Bloom filters of character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import in_arrow

#: Documents of a language that a fit reads at most, chosen by a hash of doc_id.
DOCS_PER_LANGUAGE = 3000
#: Languages in one word of the masks; more take several words.
WORD = 64
#: Text that is handled at once.
PART_BYTES = 1 << 21
#: Groups that a language's documents are ranked in before the whole language is.
SALTS = 64
_PRIMES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
_HELD_OUT = 2


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def grams(texts: list[str], size: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, n-gram code) of every n-gram of lower-cased words padded with a blank.

    All texts are handled as one array of code points. n-grams do not cross a text's
    ends; what is not a letter separates words. With ``size`` 3 each letter is the middle of
    exactly one.
    """
    joined = "\0".join(["", *(t.replace("\0", " ").lower() for t in texts), ""])
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int32)
    letter = _letters()[points]
    keep = letter | (points == 0)
    keep[1:] |= letter[:-1]  # one blank after each word
    number = (np.cumsum(points == 0, dtype=np.int32) - 1)[keep]
    letter = letter[keep]
    # neighbouring texts share the separator, which serves both as their blank
    codes = np.where(letter, points[keep], 32).astype(np.uint64)
    n = max(0, codes.size - size + 1)
    code = np.zeros(n, dtype=np.uint64)
    for k in range(size):
        code = (code << np.uint64(21)) ^ codes[k : k + n]
    # the second place is a letter, and so are all between the first and the last
    fine = np.ones(n, dtype=bool)
    for k in range(1, max(2, size - 1)):
        fine &= letter[k : k + n]
    return number[1 : n + 1][fine], code[fine]


def slots(code: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    for prime in _PRIMES:
        yield ((code * np.uint64(prime)) >> np.uint64(64 - bits)).astype(np.int64)


@dataclass
class LanguageModel:
    """masks[w][slot] has bit l set if some n-gram of language ``64 * w + l`` hashes there."""

    languages: list[str]
    masks: list[np.ndarray]
    size: int
    false_positive: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        fill = [float(((self.masks[k // WORD] >> np.uint64(k % WORD)) & np.uint64(1)).mean()) for k in range(len(self.languages))]
        self.false_positive = np.array(fill, dtype=float) ** len(_PRIMES)
        small = np.uint8 if len(self.languages) <= 8 else np.uint64
        self.masks = [m.astype(small) for m in self.masks]

    @property
    def bits(self) -> int:
        return int(self.masks[0].size).bit_length() - 1

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        """Per text the language and a score in 0..1; ``und`` and 0 without letters."""
        number, code = grams(texts, self.size)
        found: list[np.ndarray] = []
        for slot in slots(code, self.bits):
            found = [m[slot] & f for m, f in zip(self.masks, found, strict=True)] if found else [m[slot] for m in self.masks]
        total = np.bincount(number, minlength=len(texts)).astype(float)
        rates = np.zeros((len(self.languages), len(texts)))
        for k, p in enumerate(self.false_positive):
            word = found[k // WORD]
            hits = np.bincount(number, weights=(word >> word.dtype.type(k % WORD)) & word.dtype.type(1), minlength=len(texts))
            rate = hits / np.maximum(total, 1)
            rates[k] = (rate - p) / max(1e-9, 1 - p)
        if not self.languages:
            return ["und"] * len(texts), [0.0] * len(texts)
        best = rates.argmax(axis=0)
        score = np.clip(rates[best, np.arange(len(texts))], 0, 1)
        known = total > 0
        return (
            [self.languages[b] if k else "und" for b, k in zip(best.tolist(), known.tolist(), strict=True)],
            np.where(known, score, 0.0).tolist(),
        )


def fit(labelled: DataFrame, size: int = 3, bits: int = 20, per_language: int = DOCS_PER_LANGUAGE, share: float = 0.5) -> LanguageModel:
    """Filters from (doc_id, text, lang) rows.

    A bounded sample: ``per_language`` whole texts of each language, those whose doc_id
    hashes lowest. An n-gram is in a language's filter if its frequency there is at least
    ``share`` of its highest in any language. Null languages and texts are left out; of
    documents without a doc_id none is chosen before others. Repeated rows count as often
    as they occur. Counts are grouped in Spark; the filter has ``2 ** bits`` slots whatever
    the input, each a bit for every language.
    """
    rows = labelled.where("lang is not null and text is not null").select("doc_id", "lang", "text")
    languages = sorted(r[0] for r in rows.select("lang").distinct().collect())
    lowest = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy("_h", "doc_id"))
    hashed = rows.select("doc_id", "lang", F.xxhash64("doc_id").alias("_h")).withColumn("_salt", F.pmod("_h", F.lit(SALTS)))
    few = hashed.withColumn("_n", lowest("lang", "_salt")).where(F.col("_n") <= per_language)
    chosen = few.withColumn("_n", lowest("lang")).where(F.col("_n") <= per_language)
    sample = rows.join(F.broadcast(chosen.select("doc_id", "lang").distinct()), ["doc_id", "lang"], "left_semi")
    code = {name: k for k, name in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang = np.array([code[x] for x in batch.column(0).to_pylist()], dtype=np.int32)
            number, gram = grams(batch.column(1).to_pylist(), size)
            for k in np.unique(lang).tolist():
                found, n = np.unique(gram[lang[number] == k], return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found.view(np.int64)), pa.array(np.full(found.size, k, np.int32)), pa.array(n.astype(np.int64))],
                    names=["gram", "lang", "n"],
                )

    counts = sample.select("lang", "text").transform(in_arrow, count, "gram long, lang int, n long").groupBy("gram", "lang").agg(F.sum("n").alias("n"))
    per_lang = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    rate = counts.join(F.broadcast(per_lang), "lang").select("gram", "lang", (F.col("n") / F.col("total")).alias("rate"))
    rated = rate.groupBy("gram").agg(F.max("rate").alias("top"), F.collect_list(F.struct("lang", "rate")).alias("each"))
    kept = rated.select("gram", F.explode("each").alias("e"), "top").where(F.col("e.rate") >= share * F.col("top"))
    gram_mask = kept.groupBy("gram", F.expr(f"e.lang div {WORD}").cast("int").alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, e.lang % {WORD})")).alias("mask"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gram = batch.column(0).to_numpy().view(np.uint64)
            for slot in slots(gram, bits):
                yield pa.RecordBatch.from_arrays([pa.array(slot), batch.column(1), batch.column(2)], names=["slot", "word", "mask"])

    filled = gram_mask.transform(in_arrow, place, "slot long, word int, mask long").groupBy("slot", "word").agg(F.bit_or("mask").alias("mask")).toArrow()
    slot, word, mask = (filled.column(c).to_numpy() for c in ("slot", "word", "mask"))
    masks = [np.zeros(1 << bits, dtype=np.uint64) for _ in range(max(1, -(-len(languages) // WORD)))]
    for k, words in enumerate(masks):
        words[slot[word == k]] = mask[word == k].view(np.uint64)
    return LanguageModel(languages, masks, size)


def held_out(doc_id: str) -> Column:
    """True for the documents no fit may see: crc32 of the id as text, modulo 4, is 2. False for a null id."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(4)) == _HELD_OUT, F.lit(False))


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """One row per document: doc_id, lang_pred, score. Whole texts, only text is read.

    A null text or one without letters is ``und`` with score 0. The score is the share of
    the text's n-grams in the language's filter, less the share that false positives give.
    Of languages that tie, the first by name is taken. Repeated rows and null ids come out
    as they went in, empty in gives empty out, other columns are ignored. Very long texts
    are handled on their own.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            lang, score = shared.value.predict([t or "" for t in part.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"]
            )

    return docs.select("doc_id", "text").transform(in_arrow, predict, f"doc_id {kind}, lang_pred string, score double")


def keep_known(docs: DataFrame, model: LanguageModel, least: float) -> DataFrame:
    """The rows of ``docs``, all columns, whose text has a language with a score of ``least`` or more."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            lang, score = shared.value.predict([t or "" for t in part.column("text").to_pylist()])
            yield part.filter(pa.array([x != "und" and s >= least for x, s in zip(lang, score, strict=True)], pa.bool_()))

    return docs.transform(in_arrow, choose, docs.schema)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Few texts at a time, for the arrays of code points: 128, or fewer that are long."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index("text"))), 0).to_pylist()
        at = total = 0
        for k, size in enumerate(sizes):
            if k > at and (k - at == 128 or total + size > PART_BYTES):
                yield batch.slice(at, k - at)
                at, total = k, 0
            total += size
        if at < len(sizes):
            yield batch.slice(at)
