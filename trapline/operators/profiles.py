"""Source profiles, tags, scores, rankings and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: event type to tag, tag to score
TAGS = {
    "auth_failed": "brute-force", "auth_success": "auth-success", "port_scan": "scanner",
    "http_probe": "scanner", "command_exec": "command-exec", "malware_upload": "malware",
}
TAG_SCORES = {"brute-force": 0.3, "scanner": 0.2, "command-exec": 0.3, "malware": 0.3}


def tag_of(event_type: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, tag in TAGS.items():
        out = F.when(event_type == name, tag).otherwise(out)
    return out


def tags(events: DataFrame) -> DataFrame:
    """src_ip and its sorted tags, from the types as sensors sent them."""
    return events.where("src_ip is not null").groupBy("src_ip").agg(F.sort_array(F.collect_set(tag_of(F.col("norm_type")))).alias("tags"))


def reputation(tags_: Column, count: Column) -> Column:
    """0..1: how many events, and which tags."""
    score = F.when(count >= 100, 0.3).when(count >= 10, 0.1).otherwise(0.0)
    for tag, add in TAG_SCORES.items():
        score = score + F.when(F.array_contains(tags_, tag), add).otherwise(0.0)
    return F.round(F.least(score, F.lit(1.0)), 6)


def source_profiles(events: DataFrame) -> DataFrame:
    """One scored row per public source: times, count, geo of its first event, tags, score."""
    order = F.struct("ts", "id")
    geo = ["country_code", "country_name", "asn", "asn_org"]
    out = events.where("src_ip is not null").groupBy("src_ip").agg(
        F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.count("*").alias("event_count"),
        F.min_by(F.struct(*geo), order).alias("g"), F.sort_array(F.collect_set(tag_of(F.col("norm_type")))).alias("tags"),
    )
    return out.select(
        F.col("src_ip").alias("ip"), "first_seen", "last_seen", "event_count", "g.*", "tags",
        reputation(F.col("tags"), F.col("event_count")).alias("reputation_score"),
    )


def event_stats(events: DataFrame, as_of: str, approximate: bool = False) -> DataFrame:
    """One row: all events, distinct sources, events of the last 24 hours."""
    distinct = F.approx_count_distinct("src_ip") if approximate else F.count_distinct("src_ip")
    now = F.lit(as_of).cast("timestamp_ntz")
    return events.agg(
        F.count("*").alias("total_events"), distinct.alias("unique_sources"),
        F.count_if(F.col("ts") >= now - F.expr("INTERVAL '24' HOUR")).alias("events_24h"),
    )


def breakdown(events: DataFrame) -> DataFrame:
    return events.where("src_ip is not null").groupBy("src_ip", "event_type").agg(F.count("*").alias("n"))


def source_profile(events: DataFrame) -> DataFrame:
    """Profiles with ``breakdown``: entries type=count in order of type."""
    each = breakdown(events).withColumn("e", F.concat_ws("=", "event_type", F.col("n").cast("string")))
    flat = each.groupBy(F.col("src_ip").alias("ip")).agg(F.array_join(F.sort_array(F.collect_list("e")), ",").alias("breakdown"))
    return source_profiles(events).join(flat, "ip")


def _top(profiles: DataFrame, keys: list[str], limit: int) -> DataFrame:
    return (
        profiles.where(F.col(keys[0]).isNotNull())
        .groupBy(*keys)
        .agg(F.sum("event_count").alias("events"), F.count("*").alias("unique_ips"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))
        .orderBy(F.desc("events"), *keys)
        .limit(limit)
    )


def top_countries(profiles: DataFrame, limit: int = 10) -> DataFrame:
    return _top(profiles, ["country_code", "country_name"], limit)


def top_asns(profiles: DataFrame, limit: int = 10) -> DataFrame:
    return _top(profiles, ["asn", "asn_org"], limit)


def ranked_sources(profiles: DataFrame, limit: int = 50, min_event_count: int = 0) -> DataFrame:
    """Highest score first, nulls last, then most events, then the address."""
    return (
        profiles.where(F.col("event_count") >= min_event_count)
        .orderBy(F.desc_nulls_last("reputation_score"), F.desc("event_count"), "ip")
        .limit(limit)
    )


def recent_events(events: DataFrame, limit: int = 100, offset: int = 0) -> DataFrame:
    return events.orderBy(F.desc("ts"), F.desc("id")).offset(offset).limit(limit)
