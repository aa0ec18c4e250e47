"""Firewall lists, ATT&CK techniques and STIX objects."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: name space of the identifiers, and the label of each tag
NAMESPACE = uuid.UUID("a7f3d4e5-1b2c-4d3e-8bdb-9a1f1e6b4c0f")
LABELS = {
    "brute-force": "malicious-activity", "malware": "malicious-activity", "command-exec": "malicious-activity",
    "auth-success": "malicious-activity", "scanner": "anomalous-activity",
}


def anonymize_ip(ip: Column, salt: str) -> Column:
    return F.concat(F.lit("ip-"), F.substring(F.sha2(F.concat(F.lit(f"{salt}::"), ip), 256), 1, 12))


def _addresses(events: DataFrame, salt: str | None) -> DataFrame:
    ip = F.col("src_ip") if salt is None else anonymize_ip(F.col("src_ip"), salt)
    return events.where("src_ip is not null").select("src_ip").distinct().select(ip.alias("ip"))


def ufw_lines(events: DataFrame, salt: str | None = None) -> DataFrame:
    """``deny from <ip>`` lines in the order of the addresses; the one for 1.2.3.4 if there is none.

    The order is by ranges, so the files that ``write.text`` makes hold one sorted list and no
    task has all of it.
    """
    found = _addresses(events, salt)
    none = events.sparkSession.range(1).select(F.lit("1.2.3.4").alias("ip")).join(found.limit(1).select(F.lit(0).cast("long").alias("id")), F.lit(True), "left_anti")
    return found.unionByName(none).orderBy("ip").select(F.concat(F.lit("deny from "), "ip").alias("line"))


def pf_lines(events: DataFrame, salt: str | None = None) -> DataFrame:
    """A table line with all addresses, sorted after they are made anonymous, and the rule.

    The line is one value, made in one task; :func:`write_pf` writes lists of any length.
    """
    table = _addresses(events, salt).agg(F.array_join(F.sort_array(F.collect_set("ip")), ", ").alias("all"))
    lines = F.array(F.concat(F.lit("table <blocked_ips> persist { "), "all", F.lit(" }")), F.lit("block drop from <blocked_ips> to any"))
    return table.select(F.explode(lines).alias("line"))


def write_pf(events: DataFrame, path: str, salt: str | None = None) -> None:
    """The list of :func:`pf_lines` as files below ``path``, to be read one after another.

    The format lets a table go over many lines: each address is one, sorted by ranges, with
    the table's head before them and its end and the rule after them. No task has all.
    """
    ips = _addresses(events, salt).select(F.lit(1).alias("k"), "ip", F.concat(F.lit("  "), "ip").alias("line"))
    ends = events.sparkSession.createDataFrame([(0, "", "table <blocked_ips> persist {"), (2, "", "}"), (3, "", "block drop from <blocked_ips> to any")], "k int, ip string, line string")
    ips.unionByName(ends).orderBy("k", "ip").select("line").write.text(path)


def attack_techniques(events: DataFrame) -> DataFrame:
    """techniqueID, tactic, score, comment for each technique seen."""
    from trapline.operators.campaigns import technique_counts

    n = F.col("event_count")
    return technique_counts(events).select(
        F.col("attack_technique").alias("techniqueID"), F.replace(F.lower("attack_tactic"), F.lit(" "), F.lit("-")).alias("tactic"), n.alias("score"),
        F.concat(n.cast("string"), F.when(n == 1, " event").otherwise(" events"), F.lit(" observed")).alias("comment"),
    )


def attack_layer(events: DataFrame, name: str = "observed techniques") -> DataFrame:
    """One row, one JSON document with all techniques and the gradient up to the highest count."""
    rows = attack_techniques(events)
    return rows.agg(
        F.to_json(
            F.struct(
                F.lit(name).alias("name"), F.lit("enterprise-attack").alias("domain"),
                F.array_sort(F.collect_list(F.struct("techniqueID", "tactic", "score", "comment"))).alias("techniques"),
                F.struct(F.lit(0).alias("minValue"), F.coalesce(F.max("score"), F.lit(1)).alias("maxValue")).alias("gradient"),
            )
        ).alias("layer")
    )


def uuid5(name: Column, namespace: uuid.UUID = NAMESPACE) -> Column:
    """The name-based (SHA-1) uuid of a text."""
    h = F.sha1(F.concat(F.lit(bytearray(namespace.bytes)), F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab"), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1), F.lit(1))
    return F.concat_ws(
        "-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)),
        F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12),
    )


def stix_time(ts: str) -> Column:
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.lit(".000Z"))


def stix_id(kind: str, key: Column) -> Column:
    """The same object has the same identifier in every export."""
    return F.concat(F.lit(f"{kind}--"), uuid5(F.concat(F.lit(f"{kind}:"), key)))


def stix_confidence(score: Column) -> Column:
    """0..100 of a score of 0..1, halves to even; 50 without one."""
    return F.when(score.isNull(), 50).otherwise(F.least(F.lit(100), F.greatest(F.lit(0), F.bround(score * 100).cast("int"))))


def stix_labels(tags: Column) -> Column:
    """Sorted labels of the tags; what touches a sensor is malicious at the least."""
    known = F.create_map(*(F.lit(x) for pair in LABELS.items() for x in pair))
    mapped = F.transform(tags, lambda t: F.coalesce(F.try_element_at(known, t), F.lit("malicious-activity")))
    return F.when(F.coalesce(F.size(tags), F.lit(0)) > 0, F.array_sort(F.array_distinct(mapped))).otherwise(F.array(F.lit("malicious-activity")))


def stix_objects(
    profiles: DataFrame, campaigns: DataFrame, members: DataFrame, now: str, limit: int | None = None, min_event_count: int = 1, private: bool = False, place: str = "these sensors"
) -> DataFrame:
    """One row an object: addresses and their indicators, live campaigns, and which indicator indicates which campaign.

    The highest scores first if there is a ``limit``. Campaigns need a ``name``. Fields that a
    kind does not have are null. Refused in privacy mode, as the values are addresses.
    """
    if private:
        raise PermissionError("addresses are not exported in privacy mode")
    chosen = profiles.where((F.col("event_count") >= min_event_count) & F.col("ip").isNotNull())
    if limit is not None:
        chosen = chosen.orderBy(F.desc_nulls_last("reputation_score"), F.desc("event_count"), "ip").limit(limit)
    at = F.concat(F.date_format(F.lit(now).cast("timestamp_ntz"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit(".000Z"))
    first, last, n = F.coalesce(stix_time("first_seen"), at), stix_time("last_seen"), F.col("event_count")
    indicator = stix_id("indicator", F.col("ip"))
    common = {"spec_version": F.lit("2.1")}
    addresses = chosen.select(F.lit("ipv4-addr").alias("type"), stix_id("ipv4-addr", F.col("ip")).alias("id"), F.col("ip").alias("value"))
    indicators = chosen.select(
        F.lit("indicator").alias("type"), indicator.alias("id"), first.alias("created"), F.coalesce(last, first).alias("modified"),
        F.concat(F.lit("Malicious IP: "), "ip").alias("name"),
        F.concat(F.lit("Observed "), n.cast("string"), F.when(n == 1, " event").otherwise(" events"), F.lit(f" from this source on {place}.")).alias("description"),
        F.concat(F.lit("[ipv4-addr:value = '"), "ip", F.lit("']")).alias("pattern"), F.lit("stix").alias("pattern_type"), first.alias("valid_from"), last.alias("valid_until"),
        stix_labels(F.col("tags")).alias("labels"), stix_confidence(F.col("reputation_score")).alias("confidence"), n.alias("event_count"), "tags", "reputation_score",
    )
    live = campaigns.where("status <> 'historical'")
    told = live.select(
        F.lit("campaign").alias("type"), stix_id("campaign", F.col("id")).alias("id"), first.alias("created"), F.coalesce(last, first).alias("modified"), "name",
        first.alias("first_seen"), last.alias("last_seen"), stix_confidence(F.col("confidence")).alias("confidence"), "status", "reactivation_count", "member_ip_count",
    )
    links = chosen.select("ip", indicator.alias("source_ref")).join(members.select(F.col("source_ip").alias("ip"), "campaign_id"), "ip").join(
        live.select(F.col("id").alias("campaign_id"), stix_id("campaign", F.col("id")).alias("target_ref")), "campaign_id"
    )
    key = F.concat(F.lit("indicates:"), "source_ref", F.lit(":"), "target_ref")
    relations = links.select(
        F.lit("relationship").alias("type"), stix_id("relationship", key).alias("id"), at.alias("created"), at.alias("modified"),
        F.lit("indicates").alias("relationship_type"), "source_ref", "target_ref",
    )
    parts = [indicators, addresses, told, relations]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out.withColumns(common)
