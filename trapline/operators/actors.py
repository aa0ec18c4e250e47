"""Actors and the campaigns linked to them."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trapline.config import DEFAULT, DIMENSIONS, Config
from trapline.functions.similarity import round6
from trapline.operators import blocks as P
from trapline.operators.clustering import as_struct, fits
from trapline.sources.store import saved

RELATIONSHIPS = ("primary_campaign", "infrastructure_reuse", "tactic_match", "temporal_overlap")


def actor_campaigns(lineage: DataFrame, campaigns: DataFrame) -> DataFrame:
    """Links with their campaign's status and times; those without a campaign keep nulls."""
    info = campaigns.select(F.col("id").alias("campaign_id"), "status", "last_seen")
    return lineage.join(info, "campaign_id", "left").orderBy(F.desc("created_at"), "id")


def list_actors(actors: DataFrame, status: str | None = None, limit: int = 50) -> DataFrame:
    out = actors if status is None else actors.where(F.col("status") == status)
    return out.orderBy(F.desc("created_at"), "id").limit(limit)


def list_lineage(lineage: DataFrame, actor: str | None = None, campaign: str | None = None, limit: int = 100) -> DataFrame:
    out = lineage if actor is None else lineage.where(F.col("actor_id") == actor)
    out = out if campaign is None else out.where(F.col("campaign_id") == campaign)
    return out.orderBy(F.desc("created_at"), "id").limit(limit)


def validate_lineage(links: DataFrame, actors: DataFrame, campaigns: DataFrame, existing: DataFrame) -> DataFrame:
    """Links with ``reason``: null if one may be made, else the first rule that it breaks."""
    mark = lambda df, key, name: df.select(F.col("id").alias(key)).distinct().withColumn(name, F.lit(True))
    held = existing.select("actor_id", "campaign_id").distinct().withColumn("_held", F.lit(True))
    out = links.join(mark(actors, "actor_id", "_actor"), "actor_id", "left").join(mark(campaigns, "campaign_id", "_campaign"), "campaign_id", "left").join(held, ["actor_id", "campaign_id"], "left")
    first = Window.partitionBy("actor_id", "campaign_id").orderBy("created_at", "id")
    reason = (
        F.when(F.col("_actor").isNull(), "unknown_actor").when(F.col("_campaign").isNull(), "unknown_campaign")
        .when(F.col("_held") | (F.row_number().over(first) > 1), "already_linked")
        .when(~F.coalesce(F.col("relationship_type").isin(*RELATIONSHIPS), F.lit(False)), "bad_relationship")
        .when(~F.coalesce(F.col("confidence").between(0, 1), F.lit(False)), "bad_confidence")
    )
    return out.withColumn("reason", reason).drop("_actor", "_campaign", "_held")


def linked_pairs(lineage: DataFrame) -> DataFrame:
    """(a, b), a < b: campaigns under a common actor."""
    x = lineage.select("actor_id", F.col("campaign_id").alias("a")).distinct()
    return x.join(x.withColumnRenamed("a", "b"), "actor_id").where("a < b").select("a", "b").distinct()


def campaign_pairs(campaigns: DataFrame, lineage: DataFrame) -> DataFrame:
    """(a, b, x, y): pairs of campaigns (campaign_id and five structs) not yet under one actor."""
    x = as_struct(campaigns, "x", F.col("campaign_id").alias("a"))
    y = as_struct(campaigns, "y", F.col("campaign_id").alias("b"))
    return x.join(y, F.col("a") < F.col("b")).join(linked_pairs(lineage), ["a", "b"], "left_anti")


def suggestions(campaigns: DataFrame, lineage: DataFrame, cfg: Config = DEFAULT, min_score: float | None = None, limit: int | None = None) -> DataFrame:
    """The most similar pairs not yet under one actor, with a hint and how many pairs were compared; global weights always.

    Of two blocks of campaigns only the best pairs and their number leave a task. A campaign
    has its actors with it, so that pairs under one need no list of their own.
    """
    least = cfg.suggestion_score if min_score is None else min_score
    limit = cfg.suggestion_limit if limit is None else limit
    own = lineage.groupBy("campaign_id").agg(F.collect_set("actor_id").cast("array<string>").alias("actors"))
    all_ = P.packed(P.flat(campaigns.join(own, "campaign_id", "left"), "campaign_id", actors=F.col("actors")))
    found = saved(P.compared(all_, all_, partial(P.top, least=least, limit=limit), "a string, b string, score double, hint string, n long", cfg, broadcast=fits(all_), once=True))
    n = found.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    return found.where("a is not null").select("a", "b", "score", "hint", F.lit(n).cast("long").alias("pairs_evaluated")).orderBy(F.desc("score"), "a", "b").limit(limit)


def actor_stability(actors: DataFrame, lineage: DataFrame, stabilities: DataFrame) -> DataFrame:
    """Per actor: campaigns linked and without data, a status, and least, greatest and mean of the composite and each dimension.

    ``contributors`` lists the linked campaigns: id, relationship, status, samples and composite,
    null where there is no data. An actor's links are few, as analysts make them.
    """
    data = stabilities.select("campaign_id", "status", "sample_count", "composite_score", *(f"{d}_stability" for d in DIMENSIONS))
    rows = actors.select(F.col("id").alias("actor_id")).join(lineage.select("actor_id", "campaign_id", "relationship_type"), "actor_id", "left").join(data, "campaign_id", "left")
    known = F.coalesce(F.col("status") != "insufficient_data", F.lit(False))
    rows = rows.withColumns({c: F.when(known, F.col(c)) for c in ("composite_score", *(f"{d}_stability" for d in DIMENSIONS))}).withColumn("_known", known)
    spread = [
        round6(f(c)).alias(f"{name}_{how}")
        for name, c in (("composite", "composite_score"), *((d, f"{d}_stability") for d in DIMENSIONS))
        for how, f in (("min", F.min), ("max", F.max), ("mean", F.avg))
    ]
    each = F.when(
        F.col("campaign_id").isNotNull(),
        F.struct("campaign_id", "relationship_type", F.coalesce("status", F.lit("no_data")).alias("status"), F.coalesce("sample_count", F.lit(0)).cast("long").alias("sample_count"), "composite_score"),
    )
    out = rows.groupBy("actor_id").agg(
        F.count("campaign_id").alias("linked"), F.count_if(F.col("campaign_id").isNotNull() & ~F.col("_known")).alias("missing"), *spread,
        F.array_sort(F.collect_list(each)).alias("contributors"),
    )
    status = F.when(F.col("linked") == 0, "no_campaigns").when(F.col("missing") == F.col("linked"), "no_data").when(F.col("missing") > 0, "partial").otherwise("ok")
    return out.withColumn("status", status)
