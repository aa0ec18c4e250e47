"""The test tables read as sensor feeds: pure expressions over events, nation and texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trapline.functions import normalize as N
from trapline.operators.features import handshakes

PORTS = [22, 23, 80, 443, 445, 3306, 2222, 8080, 21, 25, 3389, 5900]
USERNAMES = ["root", "admin", "user1", "12345", "a@b.com", "", "test!", "oracle"]
_KEX = ['["curve25519-sha256", "ecdh-sha2-nistp256"]', '["ecdh-sha2-nistp256", "curve25519-sha256", "diffie-hellman-group14-sha1"]', '["diffie-hellman-group14-sha1"]']
_TLS = ['["c02f", "c030", "009e"]', '["1301", "1302"]', '["c030", "c02f", "1301", "009e"]']
#: What sensors add to their events, some of it not as it should be.
PAYLOADS = [
    *(f'{{"kex_algs": {x}}}' for x in _KEX), f'{{"kex_algs": [], "kex_algorithms": {_KEX[1]}}}', '{"kex_algs": ["x", 1]}', '{"kex_algs": [null]}',
    *(f'{{"tls_cipher_suites": {x}}}' for x in _TLS), f'{{"ja3_ciphers": {_TLS[2]}, "tls_cipher_suites": ""}}', '{"ja3_ciphers": "none"}', "{}",
    f'{{"kex_algs": {_KEX[0]}, "ja3_ciphers": {_TLS[0]}}}',
]
PASSWORDS = ["123456", "password", "Pass1", "", "p@ss!", "abc", "QWErty9"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: list, index: str) -> F.Column:
    return F.get(F.array(*(F.lit(v) for v in values)), F.expr(index))


def sensor_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What sensors send: id, ts, source, type, ip and payload fields, before any cleaning."""
    e = table(spark, sf_dir, "events").select(
        "event_id", "ts", F.col("user_id").alias("u"), "event_type", F.get_json_object("props", "$.k").cast("int").alias("k")
    )
    kind = F.expr(
        "CASE event_type WHEN 'click' THEN 'auth_failed' WHEN 'view' THEN 'port_scan' WHEN 'error' THEN 'http_probe' "
        "WHEN 'purchase' THEN 'auth_success' ELSE 'command_exec' END"
    )
    raw = F.expr(
        "CASE WHEN u % 3 = 0 THEN CASE kind WHEN 'auth_failed' THEN 'cowrie.login.failed' WHEN 'auth_success' THEN 'cowrie.login.success' "
        "WHEN 'command_exec' THEN 'cowrie.command.input' WHEN 'port_scan' THEN 'Port.Scan' ELSE 'HTTP.Probe' END "
        "WHEN u % 3 = 1 THEN CASE kind WHEN 'port_scan' THEN 'dionaea.connection.free' ELSE replace(upper(kind), '_', '.') END "
        "ELSE CASE WHEN k % 50 = 0 THEN 'Odd.Thing' ELSE kind END END"
    )
    ip = F.expr(
        "CASE WHEN u % 11 = 0 THEN '10.' ELSE '45.' END || cast(u div 65536 % 256 as string) || '.' || "
        "cast(u div 256 % 256 as string) || '.' || cast(u % 256 as string)"
    )
    return (
        e.withColumn("kind", kind)
        .select(
            F.col("event_id").cast("string").alias("id"), "ts", "u", "k",
            F.expr("CASE u % 3 WHEN 0 THEN 'cowrie' WHEN 1 THEN 'dionaea' ELSE 'custom' END").alias("source"),
            raw.alias("type"), ip.alias("ip"), _pick(PORTS, "k % 12").alias("dst_port"),
            F.when(F.col("kind") != "port_scan", _pick(USERNAMES, "k % 8")).alias("username"),
            F.when(F.col("kind") != "port_scan", _pick(PASSWORDS, "k % 7")).alias("password"),
            F.when(F.expr("k % 4 < 2"), _pick(PAYLOADS, f"cast((u + k div 9) % {len(PAYLOADS)} as int)")).alias("payload"),
        )
    )


def sensor_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feed as JSON lines, column ``value``, some of them not as they should be, and some sent twice.

    By the id modulo 23: 0 is cut off, 1 has no type, 2 no time, 3 epoch seconds, 4 a list for
    ``data`` and the address beside it, 5 is blank, 6 has a private address first; of the others
    odd ones have the port beside ``data``, as a number, and even ones in it, as text.
    """
    feed = sensor_feed(spark, sf_dir).withColumn("m", F.expr("cast(cast(id as bigint) % 23 as int)"))
    data = F.to_json(
        F.struct(
            F.when(F.col("m") == 6, F.expr("'192.168.0.' || cast(u % 200 as string)")).otherwise(F.col("ip")).alias("ip"),
            F.when(F.col("m") % 2 == 0, F.col("dst_port").cast("string")).alias("dst_port"), F.expr("CASE k % 3 WHEN 0 THEN 'tcp' WHEN 1 THEN 'UDP' END").alias("protocol"),
            F.when(F.expr("k % 10 = 9"), F.lit("trap")).alias("service"), "username", "password",
        )
    )
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    ts = F.when(F.col("m") == 2, F.lit('"soon"')).when(F.col("m") == 3, F.unix_seconds(F.col("ts").cast("timestamp")).cast("string")).otherwise(F.concat(F.lit('"'), iso, F.lit('Z"')))
    beside = F.when(F.col("m") == 4, F.format_string(', "source_ip": "%s"', "ip")).when(F.col("m") == 6, F.format_string(', "client_ip": "%s"', "ip"))
    beside = F.coalesce(beside, F.when(F.col("m") % 2 == 1, F.format_string(', "dst_port": %d', "dst_port")), F.lit(""))
    kind = F.when(F.col("m") != 1, F.format_string(', "type": "%s"', "type")).otherwise("")
    line = F.concat(
        F.format_string('{"id": "%s", "ts": ', "id"), ts, F.format_string(', "source": "%s"', "source"), kind, F.lit(', "data": '),
        F.when(F.col("m") == 4, "[1, 2]").otherwise(data), beside, F.lit("}"),
    )
    value = F.when(F.col("m") == 0, F.expr("substr(line, 1, 30)")).when(F.col("m") == 5, "  ").otherwise(F.col("line"))
    said = feed.withColumn("line", line).select("k", value.alias("value"))
    return said.select("value").unionByName(said.where("k < 5").select("value"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean events with geo and ASN columns; src_ip is null where the address is not public."""
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nk"), F.col("n_name").alias("country_name"))
    feed = sensor_feed(spark, sf_dir)
    norm = N.normalize_event_type(F.col("type"), F.col("source"))
    known = F.col("u") % 13 != 0
    return (
        feed.withColumns({"norm_type": norm, **handshakes(F.col("payload"))})
        .withColumn("nk", F.when(known, (F.col("u") % 25).cast("int")))
        .join(F.broadcast(nation), "nk", "left")  # 25 nations in every size
        .select(
            "id", "ts", "u", "k", "source", N.public_ipv4(F.col("ip")).alias("src_ip"), "norm_type",
            N.coerce_event_type(F.col("norm_type")).alias("event_type"), "dst_port",
            N.service_of_port(F.col("dst_port")).alias("service"), "username", "password", "ssh_kex", "tls_ciphers",
            F.when(known, F.expr("lpad(cast(nk as string), 2, '0')")).alias("country_code"), "country_name",
            F.when(known, (F.col("u") % 10 + 64500).cast("int")).alias("asn"),
            F.when(known, F.expr("'ORG-' || cast(u % 10 as string)")).alias("asn_org"),
        )
    )


def members(spark: SparkSession, sf_dir: str, ev: DataFrame | None = None) -> DataFrame:
    """campaign_id, source_ip, confidence, added_at, last_active: ten sources a campaign, a seventh unassigned."""
    ev = ev if ev is not None else events(spark, sf_dir)
    return (
        ev.where("src_ip is not null and u % 7 <> 3")
        .groupBy(F.expr("'c' || cast(u div 10 as string)").alias("campaign_id"), F.col("src_ip").alias("source_ip"))
        .agg(F.min("ts").alias("added_at"), F.max("ts").alias("last_active"), F.lit(0.8).alias("confidence"))
    )


def member_versions(spark: SparkSession, sf_dir: str, ev: DataFrame | None = None) -> DataFrame:
    """(source_ip, campaign_id, added_at): when sources came to a campaign, moved to another, or left it (null).

    A source joins its campaign three days after its first event; every fourth moves to the
    next campaign twelve days later, and every ninth leaves a week after that.
    """
    ev = ev if ev is not None else events(spark, sf_dir)
    first = ev.where("src_ip is not null and u % 7 <> 3").groupBy("u", F.col("src_ip").alias("source_ip")).agg(F.min("ts").alias("t"))
    step = lambda when, campaign, days: F.when(F.expr(when), F.struct(F.expr(campaign).alias("campaign_id"), F.expr(f"t + INTERVAL '{days}' DAY").alias("added_at")))
    steps = F.array_compact(
        F.array(step("true", "'c' || cast(u div 10 as string)", 3), step("u % 4 = 0", "'c' || cast(u div 10 + 1 as string)", 15), step("u % 9 = 0", "cast(null as string)", 22))
    )
    return first.select("source_ip", F.inline(steps))


def campaigns(spark: SparkSession, sf_dir: str, m: DataFrame | None = None) -> DataFrame:
    """One campaign for ten sources: id, status, first/last seen, dormant_since, counts, has_fingerprint; ``m`` are their members, if at hand."""
    m = m if m is not None else members(spark, sf_dir)
    number = F.substring("campaign_id", 2, 9).cast("int")
    return (
        m.groupBy("campaign_id")
        .agg(F.min("added_at").alias("first_seen"), F.max("last_active").alias("last_seen"), F.count("*").alias("member_ip_count"))
        .withColumn("n", number)
        .select(
            F.col("campaign_id").alias("id"), "n",
            F.expr("CASE WHEN n % 10 IN (4, 5) THEN 'dormant' WHEN n % 10 = 6 THEN 'reactivated' WHEN n % 10 = 7 THEN 'historical' ELSE 'active' END").alias("status"),
            F.expr("0.5 + n % 10 * 0.05D").alias("confidence"), "first_seen", "last_seen",
            F.expr("CASE WHEN n % 10 IN (4, 5) THEN last_seen + INTERVAL '1' DAY END").alias("dormant_since"),
            F.expr("n % 3").alias("reactivation_count"), "member_ip_count", (F.col("n") % 10 != 9).alias("has_fingerprint"),
        )
    )


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decision log: one row for each event of a member, with five similarities and some reviews."""
    ev = events(spark, sf_dir).where("src_ip is not null and u % 7 <> 3")
    part = lambda a, b: F.expr(f"round(((k * {a} + u * {b}) % 100) / 100.0D, 2)")
    return ev.select(
        F.expr("'o' || id").alias("id"), F.expr("'c' || cast(u div 10 as string)").alias("campaign_id"), F.col("src_ip").alias("source_ip"),
        F.col("ts").alias("observed_at"), part(7, 3).alias("timing"), part(3, 7).alias("sequence"), part(11, 1).alias("protocol"),
        part(1, 13).alias("credential"), part(17, 5).alias("target"),
        F.expr("CASE WHEN u % 2 = 0 THEN 'uncertain_association' ELSE 'automatic_association' END").alias("decision"),
        F.expr("CASE u % 3 WHEN 0 THEN 'analyst_confirmed' WHEN 1 THEN 'analyst_denied' END").alias("review"),
        F.expr("CASE WHEN u % 3 < 2 THEN ts + INTERVAL '1' HOUR END").alias("reviewed_at"),
    )


def actors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actor profiles from suppliers: id, display_name, confidence, status, created_at."""
    s = table(spark, sf_dir, "supplier")
    return s.select(
        F.expr("'a' || cast(s_suppkey as string)").alias("id"), F.col("s_name").alias("display_name"),
        F.expr("round((s_suppkey % 10) / 10.0D, 1)").alias("confidence"),
        F.expr("CASE WHEN s_suppkey % 4 = 0 THEN 'archived' ELSE 'active' END").alias("status"),
        F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(cast(s_suppkey % 17 as int))").alias("created_at"),
    )


def lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actor to campaign links from suppliers, three an actor, some of them twice; some actors and campaigns do not exist."""
    s = table(spark, sf_dir, "supplier")
    kinds = ["primary_campaign", "infrastructure_reuse", "tactic_match", "temporal_overlap"]
    return s.select(
        F.expr("'l' || cast(s_suppkey as string)").alias("id"), F.expr("'a' || cast(s_suppkey div 3 as string)").alias("actor_id"),
        F.expr("'c' || cast(s_suppkey div 6 + s_suppkey % 2 as string)").alias("campaign_id"), _pick(kinds, "cast(s_suppkey % 4 as int)").alias("relationship_type"),
        F.expr("round((s_suppkey % 13) / 10.0D, 1)").alias("confidence"),
        F.expr("TIMESTAMP_NTZ '2024-02-01 00:00:00' + make_dt_interval(cast(s_suppkey % 23 as int))").alias("created_at"),
    )
