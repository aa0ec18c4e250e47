"""Registered queries of the sensor jobs by inventory id, each with its DuckDB twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trapline.functions import normalize as N
from trapline.operators import features as X
from trapline.operators import ingest as I
from trapline.operators import profiles as P
from trapline.plans import oracle as O
from trapline.sources import adapter as A
from trapline.sources.store import saved

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
B = O.BASE


def register(key: str, sql: str | None = None):
    def add(f):
        QUERIES[key] = f
        if sql is not None:
            ORACLES[key] = sql
        return f

    return add


CUTOFF = "2024-01-20 00:00:00"
AS_OF = "2024-01-25 00:00:00"


def _clean(spark: SparkSession, d: str) -> DataFrame:
    return A.events(spark, d)


def _stored(spark: SparkSession, d: str) -> DataFrame:
    """The events of public sources, cleaned and written once, for jobs that read them several times."""
    return saved(A.events(spark, d).where("src_ip is not null"))


def _join(column: str, sep: str = ",") -> F.Column:
    return F.array_join(F.transform(column, lambda x: x.cast("string")), sep)


@register("A2", B + """
, batch AS (SELECT id, CASE WHEN u % 17 = 0 THEN NULL ELSE ts END AS ts FROM feed UNION ALL SELECT id, ts FROM feed WHERE k < 5),
known AS (SELECT id FROM feed WHERE u % 10 = 0),
s AS (SELECT id, CASE WHEN ts IS NOT NULL THEN row_number() OVER (PARTITION BY id ORDER BY ts IS NULL, ts) END AS n FROM batch)
SELECT CASE WHEN n IS NULL THEN 'rejected' WHEN id IN (SELECT id FROM known) OR n > 1 THEN 'duplicate' ELSE 'accepted' END AS status, count(*) AS n
FROM s GROUP BY 1""")
def receipts(spark, d):
    feed = A.sensor_feed(spark, d)
    batch = feed.select("id", F.when(F.col("u") % 17 != 0, F.col("ts")).alias("ts")).unionByName(feed.where("k < 5").select("id", "ts"))
    return I.receipt(batch, feed.where("u % 10 = 0"))


_LINES = """
, sent AS (SELECT *, CAST(id AS BIGINT) % 23 AS m FROM norm),
lines AS (SELECT * FROM sent UNION ALL SELECT * FROM sent WHERE k < 5),
good AS (SELECT * FROM sent WHERE m NOT IN (0, 1, 2, 5) AND u % 10 <> 0)
"""


@register("A2_lines", B + _LINES + """
SELECT 'accepted' AS status, (SELECT count(*) FROM good) AS n
UNION ALL SELECT 'duplicate', (SELECT count(*) FROM lines WHERE m NOT IN (0, 1, 2, 5)) - (SELECT count(*) FROM good)
UNION ALL SELECT 'rejected', (SELECT count(*) FROM lines WHERE m = 2) UNION ALL SELECT 'failed', (SELECT count(*) FROM lines WHERE m < 2)""")
def line_receipts(spark, d):
    """Lines as sensors send them, with what is malformed, incomplete or sent again."""
    return I.receipt_rows(A.sensor_lines(spark, d), A.sensor_feed(spark, d).where("u % 10 = 0"))


@register("A2_events", B + _LINES + f"""
, taken AS (SELECT *, CASE WHEN m <> 4 THEN dst_port END AS port FROM good)
SELECT id, CASE WHEN m = 3 THEN date_trunc('second', ts) ELSE ts END AS ts, source, norm_type, CASE WHEN norm_type IN (SELECT id FROM et) THEN norm_type ELSE 'unknown' END AS event_type,
  CASE WHEN {O.public('ip')} THEN ip END AS src_ip, port AS dst_port, CASE WHEN m <> 4 THEN CASE k % 3 WHEN 0 THEN 'tcp' WHEN 1 THEN 'udp' END END AS protocol,
  CASE WHEN m <> 4 AND k % 10 = 9 THEN 'trap' ELSE {O.service('port')} END AS service, CASE WHEN m <> 4 THEN username END AS username, CASE WHEN m <> 4 THEN password END AS password FROM taken""")
def line_events(spark, d):
    """The clean events of those lines."""
    found, _ = I.ingest_batch(A.sensor_lines(spark, d), A.sensor_feed(spark, d).where("u % 10 = 0"))
    return found.select("id", "ts", "source", "norm_type", "event_type", "src_ip", "dst_port", "protocol", "service", "username", "password")


@register("A5", B + """
SELECT 'deny from ' || 'ip-' || substr(sha256('salt::' || src_ip), 1, 12) AS line FROM (SELECT DISTINCT src_ip FROM pub)""")
def ufw(spark, d):
    from trapline.operators.exports import ufw_lines

    return ufw_lines(_clean(spark, d), salt="salt")


@register("A6", B + """
SELECT 'table <blocked_ips> persist { ' || string_agg(src_ip, ', ' ORDER BY src_ip) || ' }' AS line FROM (SELECT DISTINCT src_ip FROM pub)
UNION ALL SELECT 'block drop from <blocked_ips> to any'""")
def pf(spark, d):
    from trapline.operators.exports import pf_lines

    return pf_lines(_clean(spark, d))


@register("A7", B + """
SELECT attack_technique AS "techniqueID", replace(lower(attack_tactic), ' ', '-') AS tactic, count(*) AS score,
  count(*) || CASE WHEN count(*) = 1 THEN ' event' ELSE ' events' END || ' observed' AS comment
FROM ev JOIN et ON et.id = ev.event_type WHERE attack_technique IS NOT NULL GROUP BY attack_technique, attack_tactic, label""")
def attack_layer(spark, d):
    from trapline.operators.exports import attack_techniques

    return attack_techniques(_clean(spark, d))


def _uuid(kind: str, key: str) -> str:
    """SQL: the identifier of a kind of object by its key."""
    from trapline.operators.exports import NAMESPACE

    h = f"sha1(unhex('{NAMESPACE.hex}') || encode('{kind}:' || {key}))"
    return (
        f"('{kind}--' || substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-5' || substr({h}, 14, 3) || '-' || "
        f"substr('89ab', (('0x' || substr({h}, 17, 1))::INT % 4) + 1, 1) || substr({h}, 18, 3) || '-' || substr({h}, 21, 12))"
    )


_STIX_TIME = "strftime({}, '%Y-%m-%dT%H:%M:%S') || '.000Z'"
_NONE = "NULL::VARCHAR"


@register("A8", B + O.PROFILES + O.MEMBERS + f"""
, chosen AS (SELECT *, {_uuid("indicator", "ip")} AS ind FROM profiles WHERE event_count >= 5),
live AS (SELECT *, {_uuid("campaign", "id")} AS cid FROM campaigns WHERE status <> 'historical'),
links AS (SELECT ind, cid FROM chosen JOIN members ON source_ip = ip JOIN live ON id = campaign_id)
SELECT 'ipv4-addr' AS type, {_uuid("ipv4-addr", "ip")} AS id, ip AS value, {_NONE} AS created, {_NONE} AS modified, {_NONE} AS name, {_NONE} AS description, {_NONE} AS pattern, {_NONE} AS labels, {_NONE} AS tags,
  NULL::INT AS confidence, NULL::BIGINT AS event_count, NULL::DOUBLE AS reputation_score, {_NONE} AS valid_until, {_NONE} AS status, NULL::BIGINT AS member_ip_count, {_NONE} AS source_ref, {_NONE} AS target_ref FROM chosen
UNION ALL SELECT 'indicator', ind, NULL, {_STIX_TIME.format("first_seen")}, {_STIX_TIME.format("last_seen")}, 'Malicious IP: ' || ip, 'Observed ' || event_count || ' event' || CASE WHEN event_count = 1 THEN '' ELSE 's' END || ' from this source on these sensors.',
  '[ipv4-addr:value = ' || chr(39) || ip || chr(39) || ']', CASE WHEN len(tags) = 0 THEN 'malicious-activity' ELSE array_to_string(list_sort(list_distinct(list_transform(tags, lambda t: CASE WHEN t = 'scanner' THEN 'anomalous-activity' ELSE 'malicious-activity' END))), ',') END,
  array_to_string(tags, ','), CAST(coalesce(round_even(reputation_score * 100, 0), 50) AS INT), event_count, reputation_score, {_STIX_TIME.format("last_seen")}, NULL, NULL, NULL, NULL FROM chosen
UNION ALL SELECT 'campaign', cid, NULL, {_STIX_TIME.format("first_seen")}, {_STIX_TIME.format("last_seen")}, 'campaign ' || id, NULL, NULL, NULL, NULL, CAST(round_even(confidence * 100, 0) AS INT), NULL, NULL, NULL, status, member_ip_count, NULL, NULL FROM live
UNION ALL SELECT 'relationship', {_uuid("relationship", "'indicates:' || ind || ':' || cid")}, NULL, '2024-02-03T12:00:00.000Z', '2024-02-03T12:00:00.000Z', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, ind, cid FROM links""")
def stix(spark, d):
    from trapline.operators.exports import stix_objects

    ev = _clean(spark, d)
    campaigns = A.campaigns(spark, d).withColumn("name", F.concat(F.lit("campaign "), "id"))
    found = stix_objects(P.source_profiles(ev), campaigns, A.members(spark, d, ev), "2024-02-03 12:00:00", min_event_count=5)
    return found.select(
        "type", "id", "value", "created", "modified", "name", "description", "pattern", F.array_join("labels", ",").alias("labels"), F.array_join("tags", ",").alias("tags"),
        "confidence", "event_count", "reputation_score", "valid_until", "status", "member_ip_count", "source_ref", "target_ref",
    )


@register("A9", B + f"""
SELECT 'events' AS kept, count(*) AS n FROM ev WHERE ts >= TIMESTAMP '{CUTOFF}'
UNION ALL SELECT 'raw', count(*) FROM feed WHERE ts >= TIMESTAMP '{CUTOFF}'""")
def pruned(spark, d):
    keep, raw = I.prune(_clean(spark, d), A.sensor_feed(spark, d), CUTOFF)
    count = lambda df, name: df.agg(F.lit(name).alias("kept"), F.count("*").alias("n"))
    return count(keep, "events").unionByName(count(raw, "raw"))


@register("B1", B + "SELECT source, type, norm_type, count(*) AS n FROM norm GROUP BY ALL")
def types_normalized(spark, d):
    feed = A.sensor_feed(spark, d)
    return feed.groupBy("source", "type", N.normalize_event_type(F.col("type"), F.col("source")).alias("norm_type")).agg(F.count("*").alias("n"))


@register("B2", B + "SELECT norm_type, event_type, count(*) AS n FROM ev GROUP BY ALL")
def types_coerced(spark, d):
    return _clean(spark, d).groupBy("norm_type", "event_type").agg(F.count("*").alias("n"))


@register("B3", B + """
SELECT id, CASE CAST(id AS BIGINT) % 5 WHEN 4 THEN NULL WHEN 3 THEN date_trunc('second', ts) ELSE ts END AS ts FROM feed""")
def times_parsed(spark, d):
    iso = "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS\")"
    raw = F.expr(
        f"CASE cast(id as bigint) % 5 WHEN 0 THEN {iso} WHEN 1 THEN {iso} || 'Z' WHEN 2 THEN {iso} || '+00:00' "
        "WHEN 3 THEN cast(unix_seconds(cast(ts as timestamp)) as string) ELSE 'soon' END"
    )
    return A.sensor_feed(spark, d).select("id", N.parse_event_ts(raw).cast("timestamp_ntz").alias("ts"))


@register("B4", B + f"SELECT id, CASE WHEN u % 5 = 0 THEN '8.8.8.' || (u % 200) WHEN {O.public('ip')} THEN ip END AS src_ip FROM feed")
def first_address(spark, d):
    feed = A.sensor_feed(spark, d)
    first = F.expr("CASE u % 5 WHEN 0 THEN '8.8.8.' || cast(u % 200 as string) WHEN 1 THEN '192.168.1.1' WHEN 2 THEN 'x' WHEN 3 THEN '1.2.3.04' END")
    return feed.select("id", N.first_public_ipv4(first, F.col("ip")).alias("src_ip"))


@register("B5", B + f"""
, ips AS (SELECT DISTINCT (k * 3 % 256) || '.' || (u % 256) || '.' || (k % 4) || '.1' AS ip FROM feed)
SELECT ip, {O.public("ip")} AS is_public FROM ips""")
def public_addresses(spark, d):
    ips = A.sensor_feed(spark, d).select(F.expr("concat_ws('.', k * 3 % 256, u % 256, k % 4, 1)").alias("ip")).distinct()
    return ips.select("ip", N.is_public_ipv4(F.col("ip")).alias("is_public"))


@register("B10", B + _LINES + f"""
, taken AS (SELECT *, CASE WHEN m <> 4 THEN dst_port END AS port FROM lines WHERE m NOT IN (0, 1, 2, 5))
SELECT port AS dst_port, CASE WHEN m <> 4 THEN CASE k % 3 WHEN 0 THEN 'tcp' WHEN 1 THEN 'udp' END END AS protocol,
  CASE WHEN m <> 4 AND k % 10 = 9 THEN 'trap' ELSE {O.service('port')} END AS service, count(*) AS n FROM taken GROUP BY ALL""")
def service_fields(spark, d):
    """Port, protocol and service as the lines' payloads have them."""
    found = I.parse_lines(A.sensor_lines(spark, d)).where("reason is null")
    return found.groupBy("dst_port", "protocol", "service").agg(F.count("*").alias("n"))


@register("C1", B + "SELECT ev.id, ev.src_ip, feed.type AS raw_type FROM ev JOIN feed USING (id) WHERE src_ip IS NOT NULL")
def events_with_payload(spark, d):
    raw = A.sensor_feed(spark, d).select("id", F.col("type").alias("raw_type"))
    return _clean(spark, d).where("src_ip is not null").join(raw, "id").select("id", "src_ip", "raw_type")


@register("C2", B + "SELECT id, ts FROM feed WHERE u % 10 <> 0")
def deduplicated(spark, d):
    feed = A.sensor_feed(spark, d)
    later = feed.where("k < 30").withColumn("ts", F.expr("ts + INTERVAL '1' DAY"))
    return I.first_occurrences(feed.unionByName(later), feed.where("u % 10 = 0")).select("id", "ts")


@register("C3", B + """
, nets AS (SELECT 755302400 + x * 64 AS low, 755302400 + x * 64 + 63 AS high, 26 AS bits, 'net' || x AS name FROM range(20) t(x)
  UNION ALL SELECT 754974720, 755306495, 8, 'wide'),
ips AS (SELECT DISTINCT src_ip, split_part(src_ip, '.', 1)::BIGINT * 16777216 + split_part(src_ip, '.', 2)::BIGINT * 65536
  + split_part(src_ip, '.', 3)::BIGINT * 256 + split_part(src_ip, '.', 4)::BIGINT AS n FROM pub)
SELECT src_ip, arg_max(name, bits) AS name FROM ips LEFT JOIN nets ON n BETWEEN low AND high GROUP BY 1""")
def enriched(spark, d):
    small = spark.range(20).selectExpr("755302400 + id * 64 as low", "755302400 + id * 64 + 63 as high", "26 as bits", "'net' || cast(id as string) as name")
    wide = spark.range(1).selectExpr("754974720L as low", "755302399L + 4096 as high", "8 as bits", "'wide' as name")
    ips = _clean(spark, d).where("src_ip is not null").select("src_ip").distinct()
    return I.enrich_by_network(ips, small.unionByName(wide))


@register("C4", B + O.MEMBERS + """
SELECT campaign_id, attack_tactic, count(*) AS n FROM pub JOIN members ON source_ip = src_ip JOIN et ON et.id = event_type GROUP BY ALL""")
def campaign_events(spark, d):
    from trapline.operators.campaigns import campaign_events

    ev = _clean(spark, d)
    return campaign_events(ev, A.members(spark, d, ev)).groupBy("campaign_id", "attack_tactic").agg(F.count("*").alias("n"))


@register("C5", B + """
SELECT attack_technique, attack_tactic, label, count(*) AS event_count FROM ev JOIN et ON et.id = event_type WHERE attack_technique IS NOT NULL GROUP BY ALL""")
def technique_counts(spark, d):
    from trapline.operators.campaigns import technique_counts

    return technique_counts(_clean(spark, d))


@register("D1", B + f"""
SELECT count(*) AS total_events, count(DISTINCT src_ip) AS unique_sources,
  count(*) FILTER (ts >= TIMESTAMP '{AS_OF}' - INTERVAL 24 HOUR) AS events_24h FROM ev""")
def event_stats(spark, d):
    return P.event_stats(_clean(spark, d), AS_OF)


@register("D2", B + O.PROFILES + "SELECT ip, first_seen, last_seen, event_count, country_code, country_name, asn, asn_org FROM profiles")
def source_profiles(spark, d):
    return P.source_profiles(_clean(spark, d)).drop("tags", "reputation_score")


@register("D3", B + O.PROFILES + "SELECT ip AS src_ip, array_to_string(tags, ',') AS tags FROM profiles")
def source_tags(spark, d):
    return P.tags(_clean(spark, d)).select("src_ip", _join("tags").alias("tags"))


@register("D4", B + O.PROFILES + "SELECT ip, event_count, reputation_score FROM profiles")
def reputation(spark, d):
    return P.source_profiles(_clean(spark, d)).select("ip", "event_count", "reputation_score")


@register("D5", B + "SELECT src_ip, event_type, count(*) AS n FROM pub GROUP BY ALL")
def type_breakdown(spark, d):
    return P.breakdown(_clean(spark, d))


@register("D6", B + O.PROFILES + """
, b AS (SELECT src_ip AS ip, event_type || '=' || count(*) AS e FROM pub GROUP BY src_ip, event_type),
f AS (SELECT ip, string_agg(e, ',' ORDER BY e) AS breakdown FROM b GROUP BY ip)
SELECT ip, event_count, reputation_score, breakdown FROM profiles JOIN f USING (ip)""")
def profile_with_breakdown(spark, d):
    return P.source_profile(_clean(spark, d)).select("ip", "event_count", "reputation_score", "breakdown")


def _top(keys: str, limit: int) -> str:
    first = keys.split(",")[0]
    return B + O.PROFILES + f"""SELECT {keys}, sum(event_count)::BIGINT AS events, count(*) AS unique_ips, min(first_seen) AS first_seen, max(last_seen) AS last_seen
FROM profiles WHERE {first} IS NOT NULL GROUP BY {keys} ORDER BY events DESC, {keys} LIMIT {limit}"""


@register("D7", _top("country_code, country_name", 10))
def top_countries(spark, d):
    return P.top_countries(P.source_profiles(_clean(spark, d)))


@register("D8", _top("asn, asn_org", 5))
def top_asns(spark, d):
    return P.top_asns(P.source_profiles(_clean(spark, d)), 5)


@register("E1", B + O.sessions() + "SELECT id, src_ip, session FROM marked")
def sessionized(spark, d):
    return X.sessionize(_clean(spark, d)).select("id", "src_ip", "session")


@register("E2", B + O.sessions() + """
SELECT src_ip, session, count(*) AS n, round(sum(gap_ms), 3) AS gaps_ms, round((max(epoch_us(ts)) - min(epoch_us(ts))) / 1e6, 3) AS duration_s
FROM marked GROUP BY src_ip, session HAVING count(*) > 1""")
def gaps(spark, d):
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    return (
        X.sessionize(_clean(spark, d)).groupBy("src_ip", "session")
        .agg(F.count("*").alias("n"), F.round(F.sum("gap_ms"), 3).alias("gaps_ms"), F.round((F.max(micros) - F.min(micros)) / 1e6, 3).alias("duration_s"))
        .where("n > 1")
    )


@register("E4", B + O.features() + "SELECT src_ip, value AS dst_port, n, r AS rank FROM rprt WHERE r <= 5")
def top_ports(spark, d):
    from pyspark.sql import Window

    each = X.shares(_clean(spark, d), "dst_port")
    order = Window.partitionBy("src_ip").orderBy(F.desc("n"), "first")
    ranked = each.withColumn("rank", F.row_number().over(order)).where("rank <= 5")
    return ranked.select("src_ip", F.col("value").alias("dst_port"), "n", F.col("rank").cast("long").alias("rank"))


@register("F1", B + "SELECT id, ts, src_ip, event_type FROM ev ORDER BY ts DESC, id DESC LIMIT 50 OFFSET 20")
def recent(spark, d):
    return P.recent_events(_clean(spark, d), 50, 20).select("id", "ts", "src_ip", "event_type")


@register("F2", B + O.PROFILES + "SELECT ip, reputation_score, event_count FROM profiles ORDER BY reputation_score DESC NULLS LAST, event_count DESC, ip LIMIT 50")
def ranked(spark, d):
    return P.ranked_sources(P.source_profiles(_clean(spark, d))).select("ip", "reputation_score", "event_count")


@register("F3", B + O.PROFILES + "SELECT ip, reputation_score, event_count FROM profiles WHERE event_count >= 60 ORDER BY reputation_score DESC NULLS LAST, event_count DESC, ip LIMIT 20")
def stix_candidates(spark, d):
    return P.ranked_sources(P.source_profiles(_clean(spark, d)), 20, 60).select("ip", "reputation_score", "event_count")


@register("H1", B + O.features() + """
SELECT src_ip, interval_mean, interval_stddev, interval_p25, interval_p75, interval_p95, session_mean, session_stddev, burst_cv,
  array_to_string(list_transform(tod_histogram, lambda x: round(x * 1000000)::BIGINT), ',') AS tod,
  array_to_string(list_transform(dow_histogram, lambda x: round(x * 1000000)::BIGINT), ',') AS dow FROM f_timing""")
def timing_features(spark, d):
    whole = lambda c: F.array_join(F.transform(c, lambda x: F.round(x * 1000000).cast("long").cast("string")), ",")
    t = X.timing(_clean(spark, d))
    return t.select(*(c for c in t.columns if "histogram" not in c), whole("tod_histogram").alias("tod"), whole("dow_histogram").alias("dow"))


@register("H2", B + O.features() + """
SELECT src_ip, array_to_string(port_sequence, ',') AS ports, array_to_string(event_type_sequence, ',') AS types, array_to_string(credential_sequence, ',') AS creds FROM f_sequence""")
def sequence_features(spark, d):
    return X.sequence(_clean(spark, d)).select("src_ip", _join("port_sequence").alias("ports"), _join("event_type_sequence").alias("types"), _join("credential_sequence").alias("creds"))


@register("H3", B + O.features() + """
SELECT src_ip, s.value AS service, n, share, array_to_string(ssh_kex, ',') AS kex, array_to_string(tls_ciphers, ',') AS ciphers FROM f_protocol LEFT JOIN ssvc s USING (src_ip)""")
def protocol_features(spark, d):
    ev = _clean(spark, d)
    lists = X.protocol(ev).select("src_ip", F.array_join("ssh_kex", ",").alias("kex"), F.array_join("tls_ciphers", ",").alias("ciphers"))
    return lists.join(X.shares(ev, "service"), "src_ip", "left").select("src_ip", F.col("value").alias("service"), "n", "share", "kex", "ciphers")


@register("H4", B + f"SELECT username, password, {O.user_class('username')} AS username_class, {O.pass_class('password')} AS password_class, count(*) AS n FROM ev WHERE username IS NOT NULL GROUP BY ALL")
def credential_classes(spark, d):
    ev = _clean(spark, d).where("username is not null")
    return ev.groupBy("username", "password", N.username_class(F.col("username")).alias("username_class"), N.password_class(F.col("password")).alias("password_class")).agg(F.count("*").alias("n"))


@register("H5", B + O.features() + """
SELECT src_ip, credential_count, password_length_mean, has_upper_ratio::DOUBLE AS has_upper_ratio, has_lower_ratio::DOUBLE AS has_lower_ratio,
  has_digit_ratio::DOUBLE AS has_digit_ratio, has_special_ratio::DOUBLE AS has_special_ratio,
  array_to_string(list_transform(username_class_dist, lambda x: x.value || '=' || round(x.share * 1000000)::BIGINT), ',') AS username_classes FROM f_credential""")
def credential_features(spark, d):
    flat = F.array_join(F.transform("username_class_dist", lambda x: F.concat_ws("=", x["value"], F.round(x["share"] * 1000000).cast("long").cast("string"))), ",")
    return X.credential(_clean(spark, d)).withColumn("username_classes", flat).drop("username_class_dist")


@register("H6", B + O.features() + "SELECT src_ip, unique_port_count, array_to_string(top_dst_ports, ',') AS ports, round(list_sum(port_shares), 4) AS top_share FROM f_target")
def target_features(spark, d):
    total = F.round(F.aggregate("port_shares", F.lit(0.0), lambda s, x: s + x), 4)
    return X.target(_clean(spark, d)).select("src_ip", "unique_port_count", _join("top_dst_ports").alias("ports"), total.alias("top_share"))


@register("H7", B + """
, s AS (SELECT src_ip, round(count(*) FILTER (source = 'cowrie') / count(*)::DOUBLE, 6) AS cowrie_share,
  round(count(*) FILTER (event_type = 'auth_failed') / count(*)::DOUBLE, 6) AS a, round(count(*) FILTER (event_type = 'port_scan') / count(*)::DOUBLE, 6) AS p,
  round(count(*) FILTER (event_type = 'http_probe') / count(*)::DOUBLE, 6) AS h FROM pub GROUP BY src_ip)
SELECT src_ip, cowrie_share, a AS auth_failed_share, CASE WHEN cowrie_share >= 0.5 AND a >= 0.5 THEN round(least(1.0, (cowrie_share + a) / 2), 3) END AS ssh_brute_force,
  CASE WHEN p >= 0.5 THEN round(p, 3) END AS port_scanner, CASE WHEN h >= 0.4 THEN round(h, 3) END AS web_scanner FROM s""")
def tool_signals(spark, d):
    return X.tool_signals(_clean(spark, d)).select("src_ip", "cowrie_share", "auth_failed_share", "ssh_brute_force", "port_scanner", "web_scanner")


@register("H13", B + O.features() + "SELECT src_ip, event_count, populated, confidence::DOUBLE AS confidence FROM fps")
def confidences(spark, d):
    return X.fingerprints(_stored(spark, d)).select("src_ip", "event_count", "populated", "confidence")


@register("H14", B + O.features() + """
SELECT src_ip, event_count, computed_at, timing.interval_mean AS interval_mean, timing.burst_cv AS burst_cv, len(sequence.port_sequence)::INT AS ports,
  len(protocol.service_distribution)::INT AS services, credential.credential_count AS credentials, target.unique_port_count AS unique_ports,
  auth_failed_share, populated FROM fps JOIN (SELECT src_ip, round(count(*) FILTER (event_type = 'auth_failed') / count(*)::DOUBLE, 6) AS auth_failed_share FROM pub GROUP BY 1) USING (src_ip)""")
def fingerprints(spark, d):
    return X.fingerprints(_stored(spark, d)).select(
        "src_ip", "event_count", "computed_at", "timing.interval_mean", "timing.burst_cv", F.size("sequence.port_sequence").alias("ports"),
        F.size("protocol.service_distribution").alias("services"), F.col("credential.credential_count").alias("credentials"), F.col("target.unique_port_count").alias("unique_ports"),
        "tool_signals.auth_failed_share", "populated",
    )


@register("H15", B + "SELECT DISTINCT src_ip, 'ip-' || substr(sha256('pepper' || '::' || src_ip), 1, 12) AS token FROM pub")
def anonymized(spark, d):
    from trapline.operators.exports import anonymize_ip

    return _clean(spark, d).where("src_ip is not null").select("src_ip", anonymize_ip(F.col("src_ip"), "pepper").alias("token")).distinct()


@register("I2", B + "SELECT date_trunc('minute', ts) AS minute, count(*) AS n FROM ev GROUP BY 1")
def per_minute(spark, d):
    from trapline.streaming.jobs import per_minute

    return per_minute(_clean(spark, d)).select(F.col("minute").cast("timestamp_ntz").alias("minute"), "n")


@register("I3", B + """
SELECT date_trunc('hour', ts) - to_hours(h) AS started, count(*) AS n FROM ev, range(24) t(h) GROUP BY 1""")
def sliding_day(spark, d):
    from trapline.streaming.jobs import sliding_day

    return sliding_day(_clean(spark, d)).select(F.col("started").cast("timestamp_ntz").alias("started"), "n")


@register("I4", B + O.sessions() + "SELECT src_ip, min(ts) AS started, count(*) AS n FROM marked GROUP BY src_ip, session")
def session_windows(spark, d):
    from trapline.streaming.jobs import session_windows

    return session_windows(_clean(spark, d)).select("src_ip", F.col("started").cast("timestamp_ntz").alias("started"), "n")
