"""Ingest: receipts, de-duplication, enrichment, retention."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from trapline.functions import normalize as N
from trapline.operators.features import handshakes


def first_occurrences(batch: DataFrame, known: DataFrame | None = None, order: str | Column = "ts") -> DataFrame:
    """The first row of each id, by ``order``, that ``known`` does not have already."""
    first = Window.partitionBy("id").orderBy(order)
    out = batch.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    return out if known is None else out.join(known.select("id"), "id", "left_anti")


def receipt(batch: DataFrame, known: DataFrame) -> DataFrame:
    """(status, n): rejected without a time, duplicate of the batch or of history, else accepted."""
    first = Window.partitionBy("id").orderBy(F.col("ts").isNull(), "ts")
    seen = batch.withColumn("_n", F.when(F.col("ts").isNotNull(), F.row_number().over(first)))
    seen = seen.join(known.select("id").distinct().withColumn("_known", F.lit(True)), "id", "left")
    status = F.when(F.col("ts").isNull(), "rejected").when(F.col("_known") | (F.col("_n") > 1), "duplicate").otherwise("accepted")
    return seen.groupBy(status.alias("status")).agg(F.count("*").alias("n"))


#: Where an event may have its source address, the first public one counts.
ADDRESSES = ["data.ip", "data.src_ip", "src_ip", "ip", "client_ip", "source_ip"]
REQUIRED = ["id", "ts", "source", "type"]


def _field(path: str, kind: str = "string", event: str = "_v") -> Column:
    return F.try_variant_get(event, f"$.{path}", kind)


def _text(path: str) -> Column:
    """A field that holds text; null if it holds anything else."""
    return F.when(F.schema_of_variant(_field(path, "variant")) == "STRING", _field(path))


def _given(path: str) -> Column:
    """Whether a field is there and neither empty, zero, false nor null."""
    empty = F.when(F.schema_of_variant(_field(path, "variant")) == "STRING", _field(path) == "").otherwise(_field(path).isin("0", "0.0", "false", "{}", "[]", "null"))
    return F.coalesce(~empty, F.lit(False))


def parse_lines(lines: DataFrame) -> DataFrame:
    """Sensor lines (column ``value``, one JSON object each) as events with a ``reason`` where they cannot be used.

    Each line is parsed once, to a VARIANT from which typed fields are taken. Blank lines are
    skipped. ``reason`` is ``malformed`` for what is no JSON object, ``missing field`` without
    id, ts, source or type, ``unparseable timestamp``, else null. ``data`` that is not an
    object counts as ``{}``. ``dst_port``, ``protocol``, ``service``, ``username`` and ``password``
    come from ``data``, else from the event; without a service its port names one. A port that
    is no number from 0 to 65535 is null, as is an address that is not public. The line
    stays as ``raw_json``.
    """
    parsed = lines.where(F.trim("value") != "").select(F.col("value").alias("raw_json"), F.try_parse_json("value").alias("_v"))
    shape = F.schema_of_variant("_v")
    port = F.coalesce(*(_field(p, "int") for p in ("data.dst_port", "dst_port")))
    either = lambda name: F.coalesce(_text(f"data.{name}"), _text(name)).alias(name)
    reason = F.when(~F.coalesce(shape.startswith("OBJECT"), F.lit(False)), "malformed").when(~reduce(lambda x, y: x & y, map(_given, REQUIRED)), "missing field")
    data = F.when(F.coalesce(F.schema_of_variant(_field("data", "variant")).startswith("OBJECT"), F.lit(False)), _field("data")).otherwise("{}")
    public = F.get(F.filter(F.array(*map(_text, ADDRESSES)), N.is_public_ipv4), F.lit(0))
    fields = F.struct(
        "raw_json", *(_field(n).alias(n) for n in ("id", "source", "type")), _field("ts").alias("raw_ts"), data.alias("data"), reason.alias("_reason"),
        public.alias("src_ip"), F.when(port.between(0, 65535), port).alias("dst_port"),
        F.lower(either("protocol")).alias("protocol"), either("service").alias("_service"), either("username"), either("password"),
    )
    # a generator, or Spark would take the fields anew for each filter on what follows from them
    taken = parsed.select(F.inline(F.array(fields))).withColumn("ts", N.parse_event_ts(F.col("raw_ts")).cast("timestamp_ntz"))
    norm = N.normalize_event_type(F.col("type"), F.col("source"))
    return taken.select(
        "id", "ts", "source", "type", norm.alias("norm_type"), N.coerce_event_type(norm).alias("event_type"), "src_ip", "dst_port", "protocol",
        F.coalesce("_service", N.service_of_port(F.col("dst_port"))).alias("service"), "username", "password", *(c.alias(n) for n, c in handshakes(F.col("data")).items()),
        "data", "raw_ts", "raw_json", F.coalesce("_reason", F.when(F.col("ts").isNull(), "unparseable timestamp")).alias("reason"),
    )


def accepted(parsed: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """The events of :func:`parse_lines` that are stored: usable, the first of their id, and not in ``known``.

    The first is the earliest, of equal times the smaller line. Spark keeps one row an id
    before it shuffles, so an id that comes again and again is no burden.
    """
    good = parsed.where("reason is null").drop("reason")
    return first_occurrences(good, known, F.struct("ts", "raw_json"))


class Receipt:
    """Counts of a batch of lines that two observations gather while it is written; no scan of their own."""

    def __init__(self) -> None:
        self._read, self._kept = Observation(), Observation()

    def reads(self, parsed: DataFrame) -> DataFrame:
        return parsed.observe(
            self._read, F.count(F.lit(1)).alias("n"), F.count_if(F.col("reason").isNull()).alias("good"), F.count_if(F.col("reason") == "unparseable timestamp").alias("late")
        )

    def keeps(self, events: DataFrame) -> DataFrame:
        return events.observe(self._kept, F.count(F.lit(1)).alias("n"))

    def counts(self) -> dict[str, int]:
        """accepted, duplicate, rejected (without a usable time) and failed lines; waits for the events to be written."""
        n, kept = self._read.get, self._kept.get["n"]
        return {"accepted": kept, "duplicate": n["good"] - kept, "rejected": n["late"], "failed": n["n"] - n["good"] - n["late"]}


def ingest_batch(lines: DataFrame, known: DataFrame | None = None) -> tuple[DataFrame, Receipt]:
    """(events, receipt) of sensor lines; ``known`` has the ids stored before. The receipt is filled when the events are written."""
    receipt = Receipt()
    return receipt.keeps(accepted(receipt.reads(parse_lines(lines)), known)), receipt


def receipt_rows(lines: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(status, n): the receipt as rows, for a batch that is only counted."""
    parsed = parse_lines(lines)
    status = F.when(F.col("reason") == "unparseable timestamp", "rejected").when(F.col("reason").isNotNull(), "failed").otherwise("good")
    counts = parsed.groupBy(status.alias("status")).agg(F.count("*").alias("n"))
    kept = accepted(parsed.select("id", "ts", "raw_json", "reason"), known).agg(F.lit("accepted").alias("status"), F.count("*").alias("n"))
    # what is usable and not accepted was there before
    each = counts.unionByName(kept).agg(*(F.sum(F.when(F.col("status") == s, F.col("n")).otherwise(0)).alias(s) for s in ("good", "accepted", "rejected", "failed")))
    return each.withColumn("duplicate", F.col("good") - F.col("accepted")).drop("good").unpivot([], ["accepted", "duplicate", "rejected", "failed"], "status", "n")


def read_sensor_jsonl(spark: SparkSession, paths: str) -> tuple[DataFrame, DataFrame]:
    """(good, bad) lines of files, as :func:`parse_lines` has them: bad ones are malformed or lack a field, with the reason."""
    parsed = parse_lines(spark.read.text(paths))
    failed = F.coalesce(F.col("reason").isin("malformed", "missing field"), F.lit(False))
    return parsed.where(~failed), parsed.where(failed).select("raw_json", "reason")


def write_events(events: DataFrame, path: str, mode: str = "append") -> None:
    """Events, raw JSON included, partitioned by day."""
    events.withColumn("event_date", F.to_date("ts")).write.mode(mode).partitionBy("event_date").parquet(path)


def prune(events: DataFrame, raw: DataFrame, cutoff: str) -> tuple[DataFrame, DataFrame]:
    """Events not older than the cutoff; raw rows that are not older or still have an event."""
    keep = events.where(F.col("ts") >= F.lit(cutoff).cast("timestamp_ntz"))
    old = raw.where(F.col("ts") < F.lit(cutoff).cast("timestamp_ntz")).join(keep.select("id"), "id", "left_anti").select("id")
    return keep, raw.join(old, "id", "left_anti")


def enrich_by_network(ips: DataFrame, networks: DataFrame) -> DataFrame:
    """ips (column ``src_ip``) with the columns of the longest network that holds each.

    networks: ``low`` and ``high`` addresses as numbers, ``bits``, and what to add. Distinct
    addresses are looked up. Networks are laid over /16 buckets, so the range join is an
    equality join on the bucket and then a comparison. No network: nulls.
    """
    single = ips.select("src_ip").distinct().withColumn("_n", N.ipv4_number(F.col("src_ip")))
    extra = [c for c in networks.columns if c not in ("low", "high", "bits")]
    spread = networks.withColumn("_b", F.explode(F.sequence(F.expr("low div 65536"), F.expr("high div 65536"))))
    hit = single.withColumn("_b", F.expr("_n div 65536")).join(spread, "_b").where("_n between low and high")
    best = hit.groupBy("src_ip").agg(F.max_by(F.struct(*extra), F.struct("bits", F.lit(0) - F.col("low"))).alias("_x"))
    return ips.join(best.select("src_ip", *(F.col(f"_x.{c}").alias(c) for c in extra)), "src_ip", "left")
