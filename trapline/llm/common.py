"""Shared helpers of the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trapline.sources.store import in_arrow, ship  # noqa: F401

#: Rows of one key that a task may have; of large tables a share of all rows, so that hot keys stay few.
HOT_ROWS = 2000
HOT_KEYS = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new path below the folder that driver and executors share.

    The session's ``spark.checkpoint.dir`` decides. Only where it is unset and the master is
    local, as in tests, a temporary folder is used; elsewhere executors would not share it.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='spark-shared-')}"
        context.setCheckpointDir(base)
    return f"{base.rstrip('/')}/trapline-{uuid.uuid4().hex}"


def written(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts lineage, survives lost executors."""
    path = shared_dir(df.sparkSession)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], counts: DataFrame, spread: list[str]) -> DataFrame:
    """``left`` joined with ``right``, which has one row a key, so that no key's rows meet in one task.

    ``counts`` (keys, n) has the left rows of each key. Rows of a key with many are dealt by
    a hash of ``spread`` over as many salts as it needs; the right row is copied to each.
    Keys with more than a 500,000th of all rows are fewer than that, so they are broadcast.
    """
    total = counts.agg(F.sum("n")).first()[0] or 0
    limit = max(HOT_ROWS, total // HOT_KEYS + 1)
    hot = written(counts.where(F.col("n") > limit).select(*keys, F.ceil(F.col("n") / limit).cast("int").alias("_salts")).repartition(1))
    if hot.isEmpty():
        return left.join(right, keys)
    salts = F.coalesce("_salts", F.lit(1))
    each = left.join(F.broadcast(hot), keys, "left").withColumn("_salt", F.pmod(F.xxhash64(*spread), salts).cast("int")).drop("_salts")
    copied = right.join(F.broadcast(hot), keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_salts")
    return each.join(copied, [*keys, "_salt"]).drop("_salt")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node with an edge; root is the smallest node reachable.

    Alternating large-star and small-star rounds: each hangs a node's neighbours under
    the smallest of them, so paths shorten by a constant factor a round. Links stay in
    Spark; one (count, checksum) pair a round tells when nothing moves any more.
    """
    now = written(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    )
    before = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = (
            joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low.select("u", F.col("m").alias("v")))
            .where("u <> v")
            .distinct()
        )
        now = written(small)
        seen = now.agg(
            F.count("*"),
            F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")),
            F.count_distinct("u"),
        ).first()
        if tuple(seen) == before:
            break
        before = tuple(seen)
    roots = now.groupBy("u").agg(F.min("v").alias("root"))
    return roots.select(F.col("u").alias("node"), "root").unionByName(
        roots.select(F.col("root").alias("node"), "root").distinct()
    )
