"""Analyst reviews: queue, last decision, and the weights they teach."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trapline.config import DEFAULT, DIMENSIONS, Config


def review_queue(observations: DataFrame, campaign_id: str | None = None, include_reviewed: bool = False, limit: int = 200) -> DataFrame:
    """Uncertain decisions, oldest first."""
    out = observations.where("decision = 'uncertain_association'")
    out = out if include_reviewed else out.where("review is null")
    out = out if campaign_id is None else out.where(F.col("campaign_id") == campaign_id)
    return out.orderBy("observed_at", "id").limit(limit)


def latest_reviews(observations: DataFrame, reviews: DataFrame) -> DataFrame:
    """Observations with the newest decision of each (columns id, review, reviewed_at)."""
    last = reviews.groupBy("id").agg(F.max_by(F.struct("review", "reviewed_at"), F.struct("reviewed_at", "review")).alias("r"))
    out = observations.join(last, "id", "left")
    return out.withColumns({"review": F.coalesce("r.review", "review"), "reviewed_at": F.coalesce("r.reviewed_at", "reviewed_at")}).drop("r")


def weight_profiles(observations: DataFrame, cfg: Config = DEFAULT, limit: int | None = 200, existing: DataFrame | None = None) -> DataFrame:
    """campaign_id, five weights, counts and the log, from reviewed uncertain decisions in their order.

    Each review moves the dimensions that scored over the gate up or down by the nudge;
    weights are then clamped and brought back to a sum of 1. ``log`` has a step for each
    review: the decision, the nudges and the weights after it. With ``existing`` profiles
    the fold goes on from their weights and leaves out what their log has, so a repeated
    run changes nothing. Fewer than three reviews leave no profile. Only the oldest
    ``limit`` uncertain observations count (all if None), so a campaign's list is bounded.
    """
    order = Window.partitionBy("campaign_id").orderBy("observed_at", "id")
    rows = observations.where("decision = 'uncertain_association'").withColumn("_n", F.row_number().over(order))
    rows = rows if limit is None else rows.where(F.col("_n") <= limit)
    rows = rows.where(F.col("review").isin("analyst_confirmed", "analyst_denied"))
    start = F.struct(*(F.lit(cfg.weights[d]).alias(d) for d in DIMENSIONS))
    if existing is not None:
        logged = existing.select("campaign_id", F.explode("log").alias("e")).select("campaign_id", F.col("e.observation_id").alias("id"))
        rows = rows.join(logged, ["campaign_id", "id"], "left_anti")
    step = F.when(F.col("review") == "analyst_confirmed", cfg.nudge).otherwise(-cfg.nudge)
    moves = [F.when(F.col(d) > cfg.review_gate, step).otherwise(0.0).alias(d) for d in DIMENSIONS]
    entry = F.struct("_n", F.col("id").alias("observation_id"), F.col("review").alias("review_decision"), "reviewed_at", F.struct(*moves).alias("adjustments"))
    lists = rows.groupBy("campaign_id").agg(
        F.array_sort(F.collect_list(entry)).alias("steps"), F.count("*").alias("_new"), F.count_if(F.col("review") == "analyst_confirmed").alias("_yes")
    )
    begun, counts = start, {"review_count": F.col("_new"), "confirmed_count": F.col("_yes")}
    log_type = "array<struct<observation_id:string,review_decision:string,reviewed_at:timestamp_ntz,adjustments:struct<{0}>,weights_after:struct<{0}>>>".format(",".join(f"{d}:double" for d in DIMENSIONS))
    before = F.array().cast(log_type)
    if existing is not None:
        old = existing.select("campaign_id", F.struct(*(F.col(f"w_{d}").alias(d) for d in DIMENSIONS)).alias("_w"), F.col("log").alias("_log"), F.col("review_count").alias("_count"), F.col("confirmed_count").alias("_sure"))
        lists = lists.join(old, "campaign_id", "full")
        begun, before = F.coalesce("_w", start), F.coalesce("_log", before)
        zero = lambda c: F.coalesce(F.col(c), F.expr("0L"))
        counts = {"review_count": zero("_new") + zero("_count"), "confirmed_count": zero("_yes") + zero("_sure")}

    def move(w: Column, s: Column) -> Column:
        """The weights after one review."""
        to = {d: F.greatest(F.lit(cfg.weight_floor), F.least(F.lit(cfg.weight_ceiling), w[d] + s["adjustments"][d])) for d in DIMENSIONS}
        total = sum((to[d] for d in DIMENSIONS[1:]), to[DIMENSIONS[0]])
        # totals like 1.04 often leave exact ties; the small addend settles them alike however the quotient was formed
        return F.struct(*(F.round(to[d] / total + 1e-12, 8).alias(d) for d in DIMENSIONS))

    def fold(acc: Column, s: Column) -> Column:
        after = move(acc["w"], s)
        line = F.struct(s["observation_id"].alias("observation_id"), s["review_decision"].alias("review_decision"), s["reviewed_at"].alias("reviewed_at"), s["adjustments"].alias("adjustments"), after.alias("weights_after"))
        return F.struct(after.alias("w"), F.concat(acc["log"], F.array(line)).alias("log"))

    first = F.struct(begun.alias("w"), before.alias("log"))
    done = lists.withColumns(counts).where(F.col("review_count") >= cfg.min_reviews).withColumn("f", F.when(F.col("steps").isNull(), first).otherwise(F.aggregate("steps", first, fold)))
    return done.select(
        "campaign_id", *(F.col(f"f.w.{d}").alias(f"w_{d}") for d in DIMENSIONS), "review_count", "confirmed_count",
        (F.col("review_count") - F.col("confirmed_count")).alias("denied_count"), F.col("f.log").alias("log"),
    )
