"""Windows and stream jobs; the window functions take batch or streaming frames alike."""

from __future__ import annotations

import zlib
from collections.abc import Callable
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import IntegerType, StringType, StructType

from trapline.config import DEFAULT, DIMENSIONS, Config
from trapline.operators import clustering, features, history, ingest, profiles, reviews
from trapline.operators.campaigns import lifecycle, transitions
from trapline.sources import store


def per_minute(events: DataFrame) -> DataFrame:
    """(minute, n) in tumbling UTC minutes."""
    return events.groupBy(F.window("ts", "1 minute").alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("minute"), "n")


def sliding_day(events: DataFrame) -> DataFrame:
    """(started, n): 24 hours from each hour."""
    return events.groupBy(F.window("ts", "24 hours", "1 hour").alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("started"), "n")


def session_windows(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """(src_ip, started, n): sessions end after a gap of more than ``gap``."""
    own = events.where("src_ip is not null")
    # a window ends a gap after its last event; one microsecond more keeps a gap of exactly that length
    window = F.session_window("ts", gap)
    return own.groupBy("src_ip", window.alias("w")).agg(F.count("*").alias("n")).select("src_ip", F.col("w.start").alias("started"), "n")


def new_events(stream: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """Each id once among events that are at most ``lateness`` apart."""
    return stream.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["id"])


def each_batch(stream: DataFrame, job: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Runs a batch job on each micro-batch of all that is there, then stops."""
    return stream.writeStream.foreachBatch(job).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def split_late(batch: DataFrame, newest: str, lateness: str = "1 hour") -> tuple[DataFrame, DataFrame]:
    """(in time, late): late rows are for a side table and a batch run, not lost."""
    bound = F.lit(newest).cast("timestamp_ntz") - F.expr(f"INTERVAL {lateness}")
    return batch.where(F.col("ts") >= bound), batch.where(F.col("ts") < bound)


def merge_profiles(snapshot: DataFrame | None, batch: DataFrame) -> DataFrame:
    """The next rows of the sources that a batch of new events touches; ``snapshot`` has what was known of them.

    Counts add up, times widen, tags unite, and the geo columns stay those of the first
    event by (ts, id), whose id the rows keep; the score follows from tags and count. So
    batch by batch this gives what :func:`profiles.source_profiles` gives over all events,
    ties included.
    """
    first = batch.where("src_ip is not null").groupBy(F.col("src_ip").alias("ip")).agg(F.min(F.struct("ts", "id")).getField("id").alias("first_id"))
    fresh = profiles.source_profiles(batch).join(first, "ip")
    if snapshot is None:
        return fresh
    geo = ["country_code", "country_name", "asn", "asn_org", "first_id"]
    both = snapshot.join(first.select("ip"), "ip", "left_semi").select(fresh.columns).unionByName(fresh)
    merged = both.groupBy("ip").agg(
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.sum("event_count").alias("event_count"),
        F.min_by(F.struct(*geo), F.struct("first_seen", "first_id")).alias("g"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("tags")))).alias("tags"),
    )
    score = profiles.reputation(F.col("tags"), F.col("event_count")).alias("reputation_score")
    return merged.select("ip", "first_seen", "last_seen", "event_count", "g.*", "tags", score).select(fresh.columns)


def refingerprint(events: DataFrame, batch: DataFrame) -> DataFrame:
    """New fingerprints of the sources that a batch touched, once each, over all their events."""
    touched = batch.where("src_ip is not null").select("src_ip").distinct()
    return features.fingerprints(events.join(touched, "src_ip", "left_semi"))


def stored(spark: SparkSession, path: str, schema: StructType | None) -> DataFrame | None:
    """The table at ``path``, None before anything is written."""
    try:
        return (spark.read if schema is None else spark.read.schema(schema)).parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


#: Buckets of the stored ids. A batch reads those that its own ids fall into.
ID_BUCKETS = 256


def known_ids(batch: DataFrame, path: str, key: str) -> DataFrame | None:
    """The ids stored by other batches in the buckets that this batch's ids fall into; None before anything is stored."""
    hit = [r["bucket"] for r in batch.where("id is not null").select(_bucket()).distinct().collect()]  # ID_BUCKETS at most
    found = stored(batch.sparkSession, f"{path}_ids", StructType([batch.schema["id"]]).add("batch", StringType()).add("bucket", IntegerType()))
    return None if found is None else found.where(F.col("bucket").isin(hit) & (F.col("batch") != key)).select("id")


def _bucket() -> Column:
    return F.pmod(F.xxhash64("id"), F.lit(ID_BUCKETS)).cast("int").alias("bucket")


def write_new(events: DataFrame, path: str, key: str) -> DataFrame:
    """Writes new events as the batch ``key``, by day, then their ids; returns the written rows.

    Both are told apart by batch, so a batch that is run again replaces its events and does
    not take its own ids for known ones.
    """
    target = f"{path}/batch={key}"
    events.withColumn("event_date", F.to_date("ts")).write.mode("overwrite").partitionBy("event_date").parquet(target)
    found = stored(events.sparkSession, target, events.schema)
    # a batch without new events leaves an empty folder
    found = events.limit(0) if found is None else found
    ids = found.where("id is not null").select("id", F.lit(key).alias("batch"), _bucket())
    ids.write.mode("append").partitionBy("bucket").parquet(f"{path}_ids")
    return found


def _key(checkpoint: str, number: int) -> str:
    """Names a batch of the stream that has this checkpoint."""
    return f"{zlib.crc32(checkpoint.encode()):08x}-{number}"


def new_of(batch: DataFrame, path: str, key: str) -> DataFrame:
    """The first events of ids that no other batch has stored, and all events without an id."""
    named = ingest.first_occurrences(batch.where("id is not null"), known_ids(batch, path, key), F.col("ts").asc_nulls_last())
    return named.unionByName(batch.where("id is null"))


def stream_ingest(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes each new event once and stops when all that is there is read.

    A batch is compared with the stored ids of the buckets that it hits (``path`` + ``_ids``),
    so an id never returns, events of any age are written, and no state grows in memory. A
    batch that is run again, as after a lost driver, replaces what it wrote: events without
    an id are all kept, but once.
    """
    return each_batch(stream, lambda batch, n: write_new(new_of(batch, path, _key(checkpoint, n)), path, _key(checkpoint, n)), checkpoint)


def ingest_lines(lines: DataFrame, path: str, key: str) -> dict[str, int]:
    """One batch of sensor lines (column ``value``): events, what could not be used with its reason, and the receipt.

    They go to ``path``, ``path`` + ``_rejects`` and ``path`` + ``_receipts``, each under the
    batch's key. Lines are parsed once and the receipt's counts come with the writes.
    """
    receipt = ingest.Receipt()
    parsed = store.saved(receipt.reads(ingest.parse_lines(lines)))
    good = parsed.where("reason is null")
    write_new(receipt.keeps(ingest.accepted(parsed, known_ids(good, path, key))), path, key)
    parsed.where("reason is not null").select("raw_json", "reason").write.mode("overwrite").parquet(f"{path}_rejects/batch={key}")
    counts = receipt.counts()
    row = lines.sparkSession.createDataFrame([tuple(counts.values())], ", ".join(f"{c} long" for c in counts))
    row.write.mode("overwrite").parquet(f"{path}_receipts/batch={key}")
    return counts


def stream_lines(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """:func:`ingest_lines` for each micro-batch of text lines; a batch that is run again leaves the same."""
    return each_batch(stream, lambda batch, n: ingest_lines(batch, path, _key(checkpoint, n)), checkpoint)


def follow_profiles(batch: DataFrame, number: int, path: str) -> None:
    """Upserts the profiles of the sources that a batch of new events touches, as version ``number`` + 1 of the table at ``path``.

    The batch is merged with the version before, so one that is run again leaves the same.
    """
    known, _ = store.latest(batch.sparkSession, path, before=number + 1)
    store.write_snapshot(merge_profiles(known, batch), path, ["ip"], number + 1)


def stream_profiles(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Running source profiles of a stream of new events."""
    return each_batch(stream, lambda batch, number: follow_profiles(batch, number, path), checkpoint)


def _observations(spark: SparkSession, root: str, number: int) -> DataFrame | None:
    """What was decided up to a batch, with the five similarities as columns and the analysts' reviews, if there are any."""
    found = stored(spark, f"{root}/observations", None)
    if found is None:
        return None
    flat = found.where(F.col("batch") <= number).select(
        "id", "campaign_id", "source_ip", "observed_at", *(F.col(f"explanation.{d}_similarity").alias(d) for d in DIMENSIONS), F.col("explanation.decision").alias("decision"),
        F.lit(None).cast("string").alias("review"), F.lit(None).cast("timestamp_ntz").alias("reviewed_at"),
    )
    given = stored(spark, f"{root}/reviews", StructType.fromDDL("id string, review string, reviewed_at timestamp_ntz"))
    return flat if given is None else reviews.latest_reviews(flat, given)


def follow_batch(batch: DataFrame, number: int, root: str, now: str, cfg: Config = DEFAULT) -> None:
    """One batch from events to campaigns, stability, alerts and weights, all tables below ``root``.

    Stores the new events; fingerprints the sources that the batch touched once each over
    all their events and adds those to the history, with the campaign each source was in
    before; scores the sources that are in no campaign against the live ones, with the
    weights that reviews taught so far, and applies the decisions; what fits none opens
    campaigns. Then the stability of the campaigns that got a snapshot, alerts for what
    drifts, weights from the reviews (``root`` + ``/reviews``: id, review, reviewed_at), and the
    life cycle with its counts.

    Events, history, observations and transitions are folders of the batch's number; the
    other tables are versions numbered by batch, read as they were before it. So a batch
    that is run again, whole or from the middle, leaves the same.
    """
    spark, step = batch.sparkSession, number + 1
    table = lambda name: store.latest(spark, f"{root}/{name}", before=step)[0]
    keep = lambda rows, name: rows.write.mode("overwrite").parquet(f"{root}/{name}/batch={number}")
    fresh = new_of(batch, f"{root}/events", str(number))
    write_new(fresh, f"{root}/events", str(number))
    events = spark.read.parquet(f"{root}/events").where(F.col("batch") <= number).drop("event_date", "batch")
    fps = store.saved(refingerprint(events, batch))
    campaigns, members, reps, weights, alerts = (table(n) for n in ("campaigns", "members", "representatives", "weights", "alerts"))

    none = F.lit(None).cast("string").alias("campaign_id")
    snaps = fps.withColumn("computed_at", F.lit(now).cast("timestamp_ntz"))
    if members is None:
        keep(snaps.select("*", none), "history")
    else:
        own = members.groupBy(F.col("source_ip").alias("src_ip")).agg(F.max_by("campaign_id", F.struct("last_active", "campaign_id")).alias("campaign_id"))
        keep(snaps.join(own, "src_ip", "left"), "history")

    current, joined, shown = [], [], []
    unmatched = fps.where(F.col("confidence") >= cfg.min_confidence)
    if campaigns is not None:
        live = campaigns.where("status <> 'historical'").select(F.col("id").alias("campaign_id"))
        scored = clustering.best_candidates(clustering.unassigned(fps, members), reps.join(live, "campaign_id", "left_semi"), cfg, weights)
        decided = store.saved(clustering.assign(fps, scored, campaigns, members, now, cfg))
        seen = clustering.new_observations(decided, now)
        keep(seen.withColumn("id", F.sha2(F.concat_ws("/", "campaign_id", "source_ip", F.lit(number)), 256)), "observations")
        current.append(clustering.apply_associations(campaigns, decided, now))
        met = decided.where("campaign_id is not null").select("campaign_id", F.col("src_ip").alias("source_ip"))
        joined.append(clustering.next_members(members, decided, now).join(met, ["campaign_id", "source_ip"], "left_semi"))
        shown.append(clustering.new_representatives(reps, decided, fps).join(decided.select("campaign_id"), "campaign_id", "left_semi"))
        unmatched = unmatched.join(decided.where("decision = 'new_campaign'").select("src_ip"), "src_ip", "left_semi")
    first = events.where("src_ip is not null").groupBy("src_ip").agg(F.min("ts").alias("first_seen"))
    seeds = store.saved(clustering.seed_campaigns(unmatched.select("src_ip", *DIMENSIONS).join(first, "src_ip"), cfg))
    if not seeds.isEmpty():
        for rows, opened in zip((current, joined, shown), clustering.open_campaigns(seeds, fps, now), strict=True):
            rows.append(opened)
    if not current:
        return
    whole = lambda rows: reduce(DataFrame.unionByName, rows)
    before = store.saved(whole(current))
    after = lifecycle(before, now, cfg)
    keep(transitions(before, after), "transitions")
    changed = after if campaigns is None else after.select(campaigns.columns).subtract(campaigns)
    store.write_snapshot(store.saved(changed), f"{root}/campaigns", ["id"], step)
    store.write_snapshot(store.saved(whole(joined)), f"{root}/members", ["campaign_id", "source_ip"], step)
    store.write_snapshot(store.saved(whole(shown)), f"{root}/representatives", ["campaign_id"], step)

    past = spark.read.parquet(f"{root}/history").where(F.col("batch") <= number)
    touched = past.where((F.col("batch") == number) & F.col("campaign_id").isNotNull()).select("campaign_id").distinct()
    stable = store.saved(history.stability(past.join(touched, "campaign_id", "left_semi"), cfg))
    if not stable.isEmpty():
        store.write_snapshot(stable, f"{root}/stability", ["campaign_id"], step)
        raised = history.drift_alerts(stable, alerts, cfg).withColumns(
            {
                "id": F.sha2(F.concat_ws("/", "campaign_id", F.coalesce("dimension", F.lit("-")), F.lit(number)), 256),
                "triggered_at": F.lit(now).cast("timestamp_ntz"), "acknowledged_at": F.lit(None).cast("timestamp_ntz"),
            }
        )
        store.write_snapshot(raised, f"{root}/alerts", ["id"], step)
    observed = _observations(spark, root, number)
    if observed is not None:
        store.write_snapshot(reviews.weight_profiles(observed, cfg, existing=weights), f"{root}/weights", ["campaign_id"], step)


def follow(stream: DataFrame, root: str, checkpoint: str, now: str, cfg: Config = DEFAULT) -> StreamingQuery:
    """:func:`follow_batch` for each micro-batch of all that is there."""
    return each_batch(stream, lambda batch, number: follow_batch(batch, number, root, now, cfg), checkpoint)
