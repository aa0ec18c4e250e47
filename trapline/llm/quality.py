"""Document quality: a text classifier combined with host and path posteriors."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, written

#: Labelled documents that the text classifier reads at most, by a hash of doc_id.
MAX_LABELLED = 20_000
#: Sites that are broadcast at most; more are joined by a shuffle.
BROADCAST_SITES = 200_000
NAMES = [
    "upper", "digit", "blank", "line", "bang", "symbol", "bar", "stop", "other", "high",
    "word_length", "distinct_words", "distinct_lines", "log_size",
]
_CLASSES = [
    range(0x41, 0x5B), range(0x30, 0x3A), [0x20, 0x09], [0x0A], [0x21, 0x3F], [*b"#%&$*@^~=<>{}[]\\/_"],
    [0x7C], [*b".,;:"], [*b"'\"()-+"], range(0x80, 0x100),
]


def describe(text: str) -> list[float]:
    """Shares of byte classes and of distinct words and lines, all between 0 and about 1."""
    data = text.encode("utf-8", "surrogatepass")
    counts = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256)
    size = max(1, len(data))
    words, lines = text.split(), text.split("\n")
    return [
        *(float(counts[list(c)].sum()) / size for c in _CLASSES),
        min(1.0, size / max(1, len(words)) / 20),
        len(set(words)) / max(1, len(words)),
        len(set(lines)) / len(lines),
        float(np.log1p(len(data))) / 12,
    ]


def described(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns ``keep`` and ``x``, the text's features. A null text is the empty one."""
    source = docs.select(*keep, F.coalesce("text", F.lit("")).alias("text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema[:-1])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = pa.array([describe(t) for t in batch.column(len(keep)).to_pylist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], x], names=[*keep, "x"])

    return source.transform(in_arrow, each, f"{schema}, x array<double>")


@dataclass
class TextModel:
    """Logistic regression over squares and values of the features."""

    weights: list[float]

    @staticmethod
    def design(x: np.ndarray) -> np.ndarray:
        return np.hstack([np.ones((len(x), 1)), x, x * x, np.sqrt(x)])

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> TextModel:
        a = cls.design(x)
        w = np.zeros(a.shape[1])
        penalty = np.full(a.shape[1], ridge)
        penalty[0] = 1e-6
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
            step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(penalty), a.T @ (y - p) - penalty * w)
            w = w + step
            if np.abs(step).max() < 1e-6:
                break
        return cls(w.tolist())

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.design(x) @ np.array(self.weights), -30, 30)


def fit_text(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_LABELLED) -> TextModel:
    """From a bounded sample: the ``max_rows`` labelled documents whose doc_id hashes lowest."""
    known = labels.where("quality is not null").groupBy("doc_id").agg(F.avg("quality").alias("y"))
    chosen = known.orderBy(F.xxhash64("doc_id")).limit(max_rows)
    rows = described(docs.join(F.broadcast(chosen), "doc_id"), "y").toArrow()
    if rows.num_rows == 0:
        return TextModel([0.0] * (3 * len(NAMES) + 1))
    x = np.array(rows.column("x").to_pylist(), dtype=float)
    return TextModel.fit(x, rows.column("y").to_numpy().astype(float))


def _strength(rate: float, spread: float) -> float:
    """Pseudo-counts of a prior whose rates vary by ``spread``."""
    return float(np.clip(rate * (1 - rate) / spread - 1, 1.0, 1e4)) if spread > 0 else 1e4


def site_posteriors(sites: DataFrame) -> DataFrame:
    """host, path, host_quality, path_quality from rows (host, path, quality 0 or 1).

    Empirical Bayes on two levels: a path's rate is shrunk towards its host's, which is
    shrunk towards the global rate, each by as many pseudo-counts as the spread calls for
    (method of moments): that of hosts around the global rate, and that of paths around
    the rate of their own host. Sums are grouped by (host, path) first, so a host of a
    third of all rows is added up on every task.
    """
    paths = written(sites.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("quality").alias("k")))
    square = lambda a, b: F.sum(F.col(a) * F.col(a) / F.col(b))
    hosts = written(
        paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("k").alias("hk"), F.count("*").alias("g"), square("k", "n").alias("s"), F.sum(F.col("n") * F.col("n")).alias("n2"))
    )
    host_rate = F.col("hk") / F.col("hn")
    total = hosts.agg(
        F.sum("hn").alias("n"), F.sum("hk").alias("k"), F.count("*").alias("hosts"), F.sum("g").alias("paths"), square("hk", "hn").alias("hs"),
        F.sum(F.col("hn") * F.col("hn")).alias("hn2"), F.sum("s").alias("ps"), F.sum(F.col("n2") / F.col("hn")).alias("pn2"), F.sum(F.col("hn") * host_rate * (1 - host_rate)).alias("v"),
    ).first()
    p, host_k, path_k = 0.5, 1.0, 1.0
    if total["n"]:
        n, p = float(total["n"]), (float(total["k"]) + 0.5) / (float(total["n"]) + 1)
        between = float(total["hs"]) - float(total["k"]) ** 2 / n
        host_k = _strength(p, (between - (total["hosts"] - 1) * p * (1 - p)) / max(1e-9, n - float(total["hn2"]) / n))
        inner = float(total["v"]) / n  # what varies within hosts
        within = float(total["ps"]) - float(total["hs"])
        spread = (within - (total["paths"] - total["hosts"]) * inner) / max(1e-9, n - float(total["pn2"]))
        path_k = float(np.clip(inner / spread - 1, 1.0, 1e4)) if spread > 0 else 1e4
    host_q = (F.col("hk") + host_k * p) / (F.col("hn") + host_k)
    return (
        paths.join(hosts.select("host", "hn", "hk"), "host")
        .withColumn("host_quality", host_q)
        .select("host", "path", "host_quality", ((F.col("k") + path_k * F.col("host_quality")) / (F.col("n") + path_k)).alias("path_quality"), F.lit(p).alias("prior"))
    )


def classify(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", threshold: float = 0.5) -> DataFrame:
    """One row per document: doc_id, text_score, host_quality, path_quality, quality, keep.

    The text's log-odds plus what its site's posterior adds over the global prior. A site
    without labelled documents has its host's posterior, a host without any the prior.
    Null texts are empty, null hosts and paths are the empty name, labels of one document
    are averaged, labels without a document are left out. Every document and every label
    counts; only the text classifier fits on a bounded sample. Repeated rows come out as
    they went in and count twice for their site; a null doc_id has no label. No rows give
    none, no labels give 0.5 throughout. Whole texts are described, however long. Columns
    other than those named are ignored.
    """
    model = fit_text(docs, labels)
    site = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    placed = docs.select("doc_id", site(host).alias("host"), site(path).alias("path"), "text")
    known = labels.where("quality is not null").groupBy("doc_id").agg(F.avg("quality").alias("quality"))
    posterior = written(site_posteriors(placed.select("doc_id", "host", "path").join(known, "doc_id")))
    first = posterior.first()
    prior = first["prior"] if first else 0.5
    hosts = posterior.groupBy("host").agg(F.max("host_quality").alias("host_quality"))
    hint = F.broadcast if posterior.count() <= BROADCAST_SITES else (lambda x: x)
    schema = placed.schema

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column(3).to_pylist(), dtype=float).reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(model.logits(x))], names=["doc_id", "host", "path", "logit"])

    kind = schema["doc_id"].dataType.simpleString()
    scored = described(placed, "doc_id", "host", "path").transform(in_arrow, score, f"doc_id {kind}, host string, path string, logit double")
    joined = scored.join(hint(posterior.select("host", "path", "path_quality")), ["host", "path"], "left").join(hint(hosts), "host", "left")
    host_q = F.coalesce("host_quality", F.lit(prior))
    path_q = F.coalesce("path_quality", host_q)
    odds = lambda q: F.log(q / (1 - q))
    total = F.col("logit") + odds(path_q) - odds(F.lit(prior))
    quality = F.round(1 / (1 + F.exp(-total)), 6)
    return joined.select(
        "doc_id", F.round(1 / (1 + F.exp(-F.col("logit"))), 6).alias("text_score"), F.round(host_q, 6).alias("host_quality"),
        F.round(path_q, 6).alias("path_quality"), quality.alias("quality"), (quality >= threshold).alias("keep"),
    )
