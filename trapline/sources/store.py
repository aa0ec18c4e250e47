"""Tables that jobs write for themselves: intermediate results and versioned snapshots."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def new_path(spark: SparkSession) -> str:
    """A new path below ``spark.checkpoint.dir``; a temporary folder only on a local master where it is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='spark-shared-')}"
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/sensors-{uuid.uuid4().hex}"


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, whose Python may not find it otherwise. Once a session."""
    context = spark.sparkContext
    if any("trapline-" in f for f in context.listFiles):
        return
    root = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp()) / f"trapline-{uuid.uuid4().hex}.zip"
    with zipfile.ZipFile(target, "w") as archive:
        for file in sorted(root.rglob("*.py")):
            archive.write(file, str(file.relative_to(root.parent)))
    context.addPyFile(str(target))


def in_arrow(df: DataFrame, job: Callable, schema: str | StructType) -> DataFrame:
    """``df.mapInArrow``, once the package is on its way: a plan keeps the files known when it is made."""
    ship(df.sparkSession)
    return df.mapInArrow(job, schema)


def saved(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder, for results that are read more than once."""
    path = new_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _files(spark: SparkSession, path: str):
    """The file system of a path and the path, as Spark's own."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def versions(spark: SparkSession, path: str) -> dict[str, list[int]]:
    """The finished versions at ``path``, by kind (base or delta), from the names of its folders alone."""
    fs, where = _files(spark, path)
    found: dict[str, list[int]] = {"base": [], "delta": []}
    if fs.exists(where):
        for each in fs.listStatus(where):
            name = re.fullmatch(r"(base|delta)=(\d+)", each.getPath().getName())
            if name and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(each.getPath(), "_SUCCESS")):
                found[name[1]].append(int(name[2]))
    return {kind: sorted(numbers) for kind, numbers in found.items()}


def latest(spark: SparkSession, path: str, before: int | None = None) -> tuple[DataFrame | None, int]:
    """(rows of the newest version, its number), or of the newest below ``before``; (None, 0) where there is none.

    The newest base is merged with the deltas after it: of each key the row of the last
    version counts. Spark keeps one row a key before it shuffles.
    """
    found = {kind: [n for n in numbers if before is None or n < before] for kind, numbers in versions(spark, path).items()}
    base = max(found["base"], default=0)
    deltas = [n for n in found["delta"] if n > base]
    if not base and not deltas:
        return None, 0
    parts = [(f"{path}/base={base}", base)] * bool(base) + [(f"{path}/delta={n}", n) for n in deltas]
    frames = [spark.read.parquet(p).withColumn("_version", F.lit(n)) for p, n in parts]
    every = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), frames)
    if len(frames) > 1:
        newest = Window.partitionBy("_key").orderBy(F.desc("_version"))
        every = every.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")
    return every.drop("_key", "_version"), max(n for _, n in parts)


def write_snapshot(rows: DataFrame, path: str, keys: list[str], version: int | None = None, deltas: int = 16) -> int:
    """Upserts rows by their keys, each of which they have once; returns the number of the new version.

    Only the rows are written, as a delta beside what is there, so an upsert costs what it
    changes and readers of earlier versions are not disturbed. After ``deltas`` of them the
    version is compacted. A caller that may run again names the ``version``: it is then
    written anew. A run that fails leaves an unfinished folder, which nobody reads.
    """
    spark = rows.sparkSession
    if version is None:
        version = max([0, *(n for numbers in versions(spark, path).values() for n in numbers)]) + 1
    keyed = rows.withColumn("_key", F.to_json(F.struct(*keys)))
    keyed.write.mode("overwrite").parquet(f"{path}/delta={version}")
    found = versions(spark, path)
    if len([n for n in found["delta"] if n > max(found["base"], default=0)]) > deltas:
        compact(spark, path, keys)
    return version


def compact(spark: SparkSession, path: str, keys: list[str], retain: int | None = None) -> int:
    """Writes the version before the newest as a base, so that readers merge less; returns its number.

    The newest stays a delta, as a run that is repeated may write it again. With ``retain``,
    versions older than that many bases are deleted; else all of them stay readable.
    """
    found = versions(spark, path)
    newest = max([0, *found["base"], *found["delta"]])
    rows, number = latest(spark, path, before=newest)
    if rows is None:
        return 0
    if number not in found["base"]:
        rows.withColumn("_key", F.to_json(F.struct(*keys))).write.mode("overwrite").parquet(f"{path}/base={number}")
        found["base"].append(number)
    if retain is not None and len(found["base"]) > retain:
        fs, _ = _files(spark, path)
        oldest = sorted(found["base"])[-retain]
        for kind, numbers in found.items():
            for n in numbers:
                if n < oldest or kind == "delta" and n == oldest:
                    fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{kind}={n}"), True)
    return number
