"""URL verdicts: host and path rules, and a logistic model of hashed character n-grams."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written
from .warc import after_host, host

#: Rows a fit reads at most; of larger tables those whose url hashes lowest.
MAX_LABELLED = 20_000
#: Rules that become columns of the plan; a longer list is a table that is joined.
RULE_COLUMNS = 100
FEATURES = 1 << 14


def path(url: Column) -> Column:
    """From the host's end up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(after_host(url), r"^[^?#]*", 0), F.lit(""))


def rule_for(rules: list[tuple[str, str]], host_: Column, path_: Column) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, nulls where none does.

    A rule is ``host/path``. It fits its host and all subdomains if the path starts with
    the rule's. Of equally long rules the last by name counts, of equal ones the last given.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, decision in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        name, _, rest = text.partition("/")
        fits = ((host_ == name) | host_.endswith(f".{name}")) & path_.startswith(f"/{rest}")
        rule = F.when(fits, F.lit(text)).otherwise(rule)
        verdict = F.when(fits, F.lit(decision)).otherwise(verdict)
    return rule, verdict


def rules_joined(urls: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """``urls`` (host, path and more) with the same rule and ruling, for long lists of rules.

    Hosts and their parent domains meet the rules' hosts in an equality join over the
    distinct (host, path) pairs, so its size follows the rules that name a page's domain.
    """
    table = urls.sparkSession.createDataFrame(
        [(text.partition("/")[0], "/" + text.partition("/")[2], k, text, decision) for k, (text, decision) in enumerate(sorted(rules, key=lambda r: (len(r[0]), r[0])))],
        "domain string, prefix string, rank int, rule string, ruling string",
    )
    pairs = urls.select("host", "path").distinct()
    parts = F.split("host", r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "."))
    hit = pairs.select("host", "path", F.explode(domains).alias("domain")).join(table, "domain").where(F.col("path").startswith(F.col("prefix")))
    best = hit.groupBy("host", "path").agg(F.max_by(F.struct("rule", "ruling"), "rank").alias("_r"))
    return urls.join(best, ["host", "path"], "left").select(*urls.columns, F.col("_r.rule").alias("rule"), F.col("_r.ruling").alias("_ruling"))


def grams(text: Column, sizes: tuple[int, ...] = (3, 4)) -> Column:
    """Character n-grams of a text between ``^`` and ``$``; runs of digits count as one ``0``."""
    padded = F.concat(F.lit("^"), F.regexp_replace(text, "[0-9]+", "0"), F.lit("$"))

    def of(n: int) -> Column:
        places = F.sequence(F.lit(1), F.length(padded) - n + 1)
        each = F.transform(places, lambda i: F.substring(padded, i, F.lit(n)))
        return F.when(F.length(padded) >= n, each).otherwise(F.array().cast("array<string>"))

    return F.concat(*map(of, sizes))


def counted(split: DataFrame) -> DataFrame:
    """Adds the hashed n-grams of ``host`` and ``path``; the two are told apart by a mark."""
    marked = F.concat(
        F.transform(grams(F.col("host")), lambda g: F.concat(F.lit("h"), g)), F.transform(grams(F.col("path")), lambda g: F.concat(F.lit("p"), g))
    )
    return HashingTF(numFeatures=FEATURES, binary=True, inputCol="_grams", outputCol="_features").transform(split.withColumn("_grams", marked))


def features(urls: DataFrame) -> DataFrame:
    """Adds host, path and their hashed n-grams."""
    return counted(urls.withColumn("host", F.coalesce(host(F.col("url")), F.lit(""))).withColumn("path", path(F.col("url"))))


def fit(labelled: DataFrame, max_rows: int = MAX_LABELLED, regularization: float = 0.01) -> LogisticRegressionModel | None:
    """A logistic model from (url, label) rows, label 1 for urls to block; None without any row.

    A bounded sample: the ``max_rows`` rows whose url hashes lowest. Rows with a null url
    or label are left out; repeated rows count as often as they occur.
    """
    rows = labelled.where("url is not null and label is not null").select("url", F.col("label").cast("double").alias("label"))
    chosen = written(rows.orderBy(F.xxhash64("url"), "url", "label").limit(max_rows).repartition(8, "url"))
    if chosen.isEmpty():
        return None
    return LogisticRegression(featuresCol="_features", maxIter=30, regParam=regularization, standardization=False).fit(
        features(chosen).select("_features", "label")
    )


def judge(pages: DataFrame, rules: list[tuple[str, str]], model: LogisticRegressionModel | None, threshold: float = 0.5) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, score.

    The rule's verdict where one fits, else ``block`` if the model's score is
    ``threshold`` or more. Without a model the score is null and what no rule blocks is
    allowed. A null url or one without ``://`` has an empty host and path and is judged by
    the model alone. Each row is judged where it is read, so repeated rows and null ids
    come out as they went in, very long urls are used whole, and no row gives none. Other
    columns are ignored. Only a list of over ``RULE_COLUMNS`` rules needs a join.
    """
    urls = pages.select("page_id", F.coalesce(host(F.col("url")), F.lit("")).alias("host"), path(F.col("url")).alias("path"))
    if len(rules) <= RULE_COLUMNS:
        rule, ruling = rule_for(rules, F.col("host"), F.col("path"))
        ruled = urls.withColumns({"rule": rule, "_ruling": ruling})
    else:
        ruled = rules_joined(urls, rules)
    if model is None:
        scored = ruled.withColumn("score", F.lit(None).cast("double"))
    else:
        scored = model.transform(counted(ruled)).withColumn("score", vector_to_array("probability")[1])
    own = F.when(F.col("score") >= threshold, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("_ruling", own).alias("verdict"), "score")
