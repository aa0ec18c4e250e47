"""Snapshots over time: caps, stability, drift alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trapline.config import DEFAULT, DIMENSIONS, Config
from trapline.functions import similarity as S
from trapline.operators.clustering import compare


def with_membership(snapshots: DataFrame, versions: DataFrame) -> DataFrame:
    """Snapshots with the campaign_id that their source had at the time; null if it was in none.

    ``versions`` (source_ip, campaign_id, added_at) tells when a source came to a campaign, or
    left with a null campaign_id. As-of join: both are put in one order of time for each
    source, and a snapshot takes the last version before it. One of the same moment is not
    before it, as a source joins a campaign after its snapshot is taken.
    """
    fields = [c for c in snapshots.columns if c != "campaign_id"]
    taken = snapshots.select(F.col("src_ip").alias("_ip"), F.col("computed_at").alias("_t"), F.lit(0).alias("_k"), F.struct(*fields).alias("_row"))
    held = versions.select(F.col("source_ip").alias("_ip"), F.col("added_at").alias("_t"), F.lit(1).alias("_k"), F.struct("campaign_id").alias("_member"))
    # of versions of one moment the greatest campaign is the last
    order = Window.partitionBy("_ip").orderBy("_t", "_k", F.col("_member.campaign_id").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = taken.unionByName(held, allowMissingColumns=True).withColumn("_now", F.last("_member", ignorenulls=True).over(order))
    return both.where("_k = 0").select("_row.*", F.col("_now.campaign_id").alias("campaign_id"))


def oldest(history: DataFrame, key: str, limit: int | None) -> DataFrame:
    """The oldest ``limit`` snapshots of each key (all if None), numbered; Spark cuts them before it shuffles."""
    order = Window.partitionBy(key).orderBy("computed_at", "src_ip")
    numbered = history.where(F.col(key).isNotNull()).withColumn("n", F.row_number().over(order))
    return numbered if limit is None else numbered.where(F.col("n") <= limit)


def counted(numbered: DataFrame, history: DataFrame, key: str) -> DataFrame:
    """``numbered`` with ``snapshots``, how many each key has in all."""
    return numbered.join(history.groupBy(key).agg(F.count("*").alias("snapshots")), key)


def _neighbours(history: DataFrame, cfg: Config, limit: int | None) -> DataFrame:
    """The oldest snapshots of each campaign, each compared with the one before it (the first with none)."""
    order = Window.partitionBy("campaign_id").orderBy("computed_at", "src_ip")
    rows = S.coded(oldest(history, "campaign_id", limit)).withColumn("b", F.struct(*DIMENSIONS)).drop(*DIMENSIONS)
    return compare(rows.withColumn("a", F.lag("b").over(order)), "a", "b", cfg)


def consecutive(history: DataFrame, cfg: Config = DEFAULT, limit: int | None = 200) -> DataFrame:
    """Each snapshot of a campaign against the one before it, over its oldest ``limit`` (all if None)."""
    return _neighbours(history, cfg, limit).where("n > 1")


def stability(history: DataFrame, cfg: Config = DEFAULT, limit: int | None = 200) -> DataFrame:
    """Per campaign the mean similarity of neighbouring snapshots and the weighted composite.

    Fewer than two snapshots: insufficient_data, composite 0. All dimensions null over two
    or more: ok with composite 0.
    """
    means = [S.round6(F.avg(f"{d}_similarity")).alias(f"{d}_stability") for d in DIMENSIONS]
    out = _neighbours(history, cfg, limit).groupBy("campaign_id").agg(
        F.count("*").alias("sample_count"), (F.count("*") - 1).alias("pair_count"), *means
    )
    score, used = S.weighted({d: F.col(f"{d}_stability") for d in DIMENSIONS}, cfg)
    return out.withColumns({"composite_score": score, "dimensions_used": used}).withColumn(
        "status", F.when(F.col("sample_count") < 2, "insufficient_data").otherwise("ok")
    )


def drift_alerts(stabilities: DataFrame, open_alerts: DataFrame | None = None, cfg: Config = DEFAULT) -> DataFrame:
    """Scores strictly under their threshold that have no unacknowledged alert yet.

    dimension is null for the composite. ``stability_snapshot`` has the scores and counts of
    the campaign that the alert was raised on, as they were then.
    """
    entries = [F.struct(F.lit("composite_drift").alias("alert_type"), F.lit(None).cast("string").alias("dimension"), F.lit(cfg.drift_composite).alias("threshold"), F.col("composite_score").alias("observed"))]
    entries += [
        F.struct(F.lit("dimension_drift").alias("alert_type"), F.lit(d).alias("dimension"), F.lit(cfg.drift[d]).alias("threshold"), F.col(f"{d}_stability").alias("observed"))
        for d in DIMENSIONS
    ]
    snapshot = F.struct(*(c for c in stabilities.columns if c != "campaign_id")).alias("stability_snapshot")
    found = stabilities.where("status <> 'insufficient_data'").select("campaign_id", F.explode(F.array(*entries)).alias("e"), snapshot).select("campaign_id", "e.*", "stability_snapshot").where("observed < threshold")
    if open_alerts is None:
        return found
    held = open_alerts.where("acknowledged_at is null").select(F.col("campaign_id").alias("c"), F.col("dimension").alias("d"))
    return found.join(held, (F.col("campaign_id") == F.col("c")) & F.col("dimension").eqNullSafe(F.col("d")), "left_anti")


def acknowledge(alerts: DataFrame, acks: DataFrame) -> DataFrame:
    """Alerts with the first acknowledgement each has (columns id, acknowledged_at)."""
    first = acks.groupBy("id").agg(F.min("acknowledged_at").alias("_at"))
    return alerts.join(first, "id", "left").withColumn("acknowledged_at", F.coalesce("acknowledged_at", "_at")).drop("_at")


def open_alerts(alerts: DataFrame, campaign_id: str | None = None, include_acknowledged: bool = False, limit: int = 50) -> DataFrame:
    """Newest first."""
    out = alerts if include_acknowledged else alerts.where("acknowledged_at is null")
    out = out if campaign_id is None else out.where(F.col("campaign_id") == campaign_id)
    return out.orderBy(F.desc("triggered_at"), "id").limit(limit)
