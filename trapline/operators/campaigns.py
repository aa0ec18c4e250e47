"""Campaign analytics: members' events, tactics, ports, density, lifecycle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trapline.config import DEFAULT, Config
from trapline.functions.normalize import event_types


def technique_counts(events: DataFrame) -> DataFrame:
    """Events of each technique; types without one are left out."""
    types = F.broadcast(event_types(events.sparkSession).where("attack_technique is not null").withColumnRenamed("id", "event_type"))
    return events.join(types, "event_type").groupBy("attack_technique", "attack_tactic", "label").agg(F.count("*").alias("event_count"))


def campaign_events(events: DataFrame, members: DataFrame) -> DataFrame:
    """Events of campaign members with label, tactic and technique."""
    types = F.broadcast(event_types(events.sparkSession).withColumnRenamed("id", "event_type"))
    own = members.select("campaign_id", F.col("source_ip").alias("src_ip"))
    return events.where("src_ip is not null").join(own, "src_ip").join(types, "event_type")


def tactic_distribution(events: DataFrame, members: DataFrame) -> DataFrame:
    found = campaign_events(events, members).where("attack_tactic is not null")
    return found.groupBy("campaign_id", "attack_tactic").agg(F.count("*").alias("n"))


def top_target_ports(events: DataFrame, members: DataFrame, n: int = 5) -> DataFrame:
    counts = campaign_events(events, members).where("dst_port is not null").groupBy("campaign_id", "dst_port").agg(F.count("*").alias("n"))
    order = Window.partitionBy("campaign_id").orderBy(F.desc("n"), "dst_port")
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def observation_counts(campaigns: DataFrame, observations: DataFrame) -> DataFrame:
    """id, observation_count, review_count; zero where there are none."""
    counts = observations.groupBy(F.col("campaign_id").alias("id")).agg(F.count("*").alias("o"), F.count("review").alias("r"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    return campaigns.select("id").join(counts, "id", "left").select("id", zero("o").alias("observation_count"), zero("r").alias("review_count"))


def age_hours(first: str, last: str) -> Column:
    seconds = (F.unix_micros(F.col(last).cast("timestamp")) - F.unix_micros(F.col(first).cast("timestamp"))) / 1e6
    return F.coalesce(F.round(F.greatest(F.lit(0.0), seconds / 3600), 4), F.lit(0.0))


def density(campaigns: DataFrame, observations: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Evidence per campaign: four capped parts weighted .35, .25, .30 and .10, and a class."""
    joined = campaigns.join(observation_counts(campaigns, observations), "id").withColumn("age_hours", age_hours("first_seen", "last_seen"))
    cap = lambda c, full: F.least(F.lit(1.0), F.col(c) / F.lit(float(full)))
    score = F.round(
        0.35 * cap("observation_count", cfg.density_observations) + 0.25 * cap("member_ip_count", cfg.density_ips)
        + 0.30 * cap("age_hours", cfg.density_hours) + 0.10 * cap("review_count", 5), 4,
    )
    out = joined.withColumn("density_score", F.when(F.col("has_fingerprint"), score).otherwise(0.0))
    kind = F.when(~F.col("has_fingerprint"), "sparse").when(F.col("density_score") >= 0.70, "mature").when(F.col("density_score") >= 0.35, "established").otherwise("emerging")
    return out.select("id", "observation_count", "review_count", "age_hours", "density_score", kind.alias("classification"))


def lifecycle(campaigns: DataFrame, now: str, cfg: Config = DEFAULT) -> DataFrame:
    """Campaigns with their status as of ``now``: quiet ones dormant, long dormant ones historical.

    One that falls dormant in this run cannot be historical in it.
    """
    at = F.lit(now).cast("timestamp_ntz")
    quiet = F.col("status").isin("active", "reactivated") & (F.col("last_seen") < at - F.expr(f"INTERVAL '{cfg.active_days}' DAY"))
    gone = (F.col("status") == "dormant") & (F.col("dormant_since") < at - F.expr(f"INTERVAL '{cfg.dormant_days}' DAY"))
    return campaigns.withColumns(
        {"status": F.when(quiet, "dormant").when(gone, "historical").otherwise(F.col("status")), "dormant_since": F.when(quiet, at).otherwise(F.col("dormant_since"))}
    )


def transitions(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row, (to_dormant, to_historical): how many campaigns a run of :func:`lifecycle` has moved."""
    moved = before.select("id", F.col("status").alias("_from")).join(after.select("id", "status"), "id").where("status <> _from")
    return moved.agg(F.count_if(F.col("status") == "dormant").alias("to_dormant"), F.count_if(F.col("status") == "historical").alias("to_historical"))


def gap_days(last_seen: Column, now: Column) -> Column:
    """Whole days between, rounded down."""
    return F.floor((F.unix_micros(now.cast("timestamp")) - F.unix_micros(last_seen.cast("timestamp"))) / 86_400_000_000)


def effective_threshold(last_seen: Column, now: Column, cfg: Config = DEFAULT) -> Column:
    days = gap_days(last_seen, now)
    return F.when(days > 365, cfg.twelve_month_threshold).when(days > 182, cfg.six_month_threshold).otherwise(cfg.auto_threshold)


def select_brief(campaigns: DataFrame, n: int, start: str, end: str) -> DataFrame:
    """Of the newest 4n campaigns the first n live ones last seen within the window, ends included."""
    newest = campaigns.orderBy(F.desc("last_seen"), "id").limit(4 * n)
    inside = F.col("last_seen").between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz"))
    return newest.where(F.col("status").isin("active", "reactivated") & inside).orderBy(F.desc("last_seen"), "id").limit(n)


def member_campaigns(members: DataFrame, campaigns: DataFrame) -> DataFrame:
    """source_ip and campaign of members of campaigns that are not historical."""
    live = campaigns.where("status <> 'historical'").select(F.col("id").alias("campaign_id"))
    return members.join(live, "campaign_id", "left_semi").select("source_ip", "campaign_id")


def data_quality(campaigns: DataFrame, observations: DataFrame) -> DataFrame:
    """id and 0..1: confidence .4, observations up to ten .3, share of feature groups .2, any observation .1."""
    joined = campaigns.join(observation_counts(campaigns, observations), "id")
    n = F.col("observation_count")
    score = F.col("confidence") * 0.4 + F.least(n, F.lit(10)) / 10 * 0.3 + F.col("groups") / 5 * 0.2 + F.when(n > 0, 0.1).otherwise(0.0)
    return joined.select("id", F.round(score, 3).alias("quality"))


def recent(campaigns: DataFrame, observations: DataFrame, limit: int = 50) -> DataFrame:
    """Newest campaigns with their density."""
    return campaigns.join(density(campaigns, observations), "id").orderBy(F.desc("last_seen"), "id").limit(limit)


def detail(campaigns: DataFrame, members: DataFrame, observations: DataFrame, page_size: int = 100) -> DataFrame:
    """Campaigns in pages, from 0: their members, most recently active first, and observations by time.

    A page has at most ``page_size`` of each, so no row holds all of a large campaign; its last
    pages have null where one of the two has ended. A campaign without either has one page.
    """

    def paged(rows: DataFrame, value: str, name: str, *order: Column) -> DataFrame:
        numbered = rows.withColumn("_n", F.row_number().over(Window.partitionBy("campaign_id").orderBy(*order, value)) - 1)
        listed = F.transform(F.array_sort(F.collect_list(F.struct("_n", value))), lambda x: x[value])
        return numbered.groupBy(F.col("campaign_id").alias("id"), F.floor(F.col("_n") / page_size).alias("page")).agg(listed.alias(name))

    own = paged(members, "source_ip", "members", F.desc("last_active"))
    pages = own.join(paged(observations, "id", "observations", F.col("observed_at")), ["id", "page"], "full")
    return campaigns.join(pages, "id", "left").withColumn("page", F.coalesce("page", F.expr("0L")))


def digest(representatives: DataFrame, campaigns: DataFrame | None = None, tactics: DataFrame | None = None) -> DataFrame:
    """campaign_id, what its representative does, its tactics and reactivations, and a text that says so.

    ``campaigns`` (id, reactivation_count) and ``tactics`` (campaign_id, attack_tactic, n) may
    be left out. No address is in it.
    """
    tod = F.col("timing.tod_histogram")

    def top(entries: str, n: int) -> Column:
        ranked = F.reverse(F.array_sort(F.transform(entries, lambda e: F.struct(e["share"], e["value"]))))
        return F.array_join(F.slice(F.transform(ranked, lambda e: e["value"]), 1, n), ", ")

    out = representatives.select(
        "campaign_id", (F.array_position(tod, F.array_max(tod)) - 1).alias("peak_hour"), (F.col("timing.burst_cv") > 0.5).alias("bursts"),
        F.size("sequence.port_sequence").alias("steps"), F.size(F.array_distinct("sequence.event_type_sequence")).alias("event_types"),
        top("protocol.service_distribution", 3).alias("services"), top("credential.username_class_dist", 3).alias("username_classes"),
        F.array_join(F.transform(F.slice("target.top_dst_ports", 1, 5), lambda p: p.cast("string")), ", ").alias("ports"), F.col("timing.interval_mean").alias("_mean"),
    )
    if tactics is None:
        out = out.withColumn("tactics", F.lit(None).cast("string"))
    else:
        each = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "attack_tactic", "n")))
        first = F.transform(F.slice(each, 1, 5), lambda t: F.concat(t["attack_tactic"], F.lit(" ("), t["n"].cast("string"), F.lit(")")))
        out = out.join(tactics.groupBy("campaign_id").agg(F.array_join(first, "; ").alias("tactics")), "campaign_id", "left")
    if campaigns is None:
        out = out.withColumn("reactivations", F.lit(None).cast("int"))
    else:
        out = out.join(campaigns.select(F.col("id").alias("campaign_id"), F.col("reactivation_count").alias("reactivations")), "campaign_id", "left")
    some = lambda name, c: F.when(F.col(c) != "", F.concat(F.lit(name), c))
    line = F.concat_ws(
        "; ", F.concat(F.lit("interval ~"), F.round("_mean", 1).cast("string"), F.lit(" ms avg")), F.when(F.col("bursts"), "burst activity present"),
        F.concat(F.lit("peak hour "), F.lpad(F.col("peak_hour").cast("string"), 2, "0"), F.lit(":00 UTC")),
        F.when(F.col("steps") > 0, F.concat("steps", F.lit("-step port sequence"))),
        F.when(F.col("event_types") > 0, F.concat("event_types", F.when(F.col("event_types") == 1, " event type").otherwise(" event types"))),
        some("primary services: ", "services"), some("username class patterns: ", "username_classes"), some("primary ports: ", "ports"), some("tactics: ", "tactics"),
        F.concat(F.lit("reactivations: "), "reactivations"),
    )
    return out.withColumn("text", line).drop("_mean")
