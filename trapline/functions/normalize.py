"""Column functions that clean sensor fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: sensor spellings of event types
SENSOR_TYPES = {
    ("cowrie", "cowrie.login.failed"): "auth_failed",
    ("cowrie", "cowrie.login.success"): "auth_success",
    ("cowrie", "cowrie.command.input"): "command_exec",
    ("cowrie", "cowrie.session.file_upload"): "malware_upload",
    ("dionaea", "dionaea.connection.free"): "port_scan",
}

# fixed values: id, label, ATT&CK tactic and technique
EVENT_TYPES = [
    ("auth_failed", "SSH Authentication Failure", "Credential Access", "T1110.001"),
    ("auth_success", "SSH Authentication Success", "Initial Access", "T1078"),
    ("port_scan", "Port Scan Probe", "Discovery", "T1046"),
    ("http_probe", "HTTP Endpoint Probe", "Discovery", "T1595.002"),
    ("malware_upload", "Malware Upload Attempt", "Execution", "T1204"),
    ("command_exec", "Remote Command Execution", "Execution", "T1059"),
    ("unknown", "Unknown Event Type", None, None),
]

# fixed values: networks that are not public, as first address and prefix length
NOT_PUBLIC = [
    ("0.0.0.0", 8), ("10.0.0.0", 8), ("127.0.0.0", 8), ("169.254.0.0", 16), ("172.16.0.0", 12), ("192.0.0.0", 24),
    ("192.0.2.0", 24), ("192.168.0.0", 16), ("198.18.0.0", 15), ("198.51.100.0", 24), ("203.0.113.0", 24),
    ("224.0.0.0", 4), ("240.0.0.0", 4),
]

SERVICES = {22: "ssh", 2222: "ssh", 23: "telnet", 80: "http", 8080: "http", 443: "https", 445: "smb", 3306: "mysql", 21: "ftp", 25: "smtp", 3389: "rdp"}

_OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_IPV4 = rf"^{_OCTET}(\.{_OCTET}){{3}}$"


def normalize_event_type(raw: Column, source: Column) -> Column:
    """The canonical name of a sensor's event type, else lower case with ``_`` for ``.``."""
    out = F.replace(F.lower(raw), F.lit("."), F.lit("_"))
    for (name, spelling), canonical in SENSOR_TYPES.items():
        out = F.when((source == name) & (raw == spelling), canonical).otherwise(out)
    return out


def coerce_event_type(name: Column) -> Column:
    """``unknown`` for a type that the lookup does not have."""
    return F.when(name.isin([t[0] for t in EVENT_TYPES]), name).otherwise("unknown")


def event_types(spark):
    """The lookup as a table."""
    return spark.createDataFrame(EVENT_TYPES, "id string, label string, attack_tactic string, attack_technique string")


def ipv4_number(ip: Column) -> Column:
    """The address as a number; null unless it is four octets of 0..255 without leading zeros."""
    parts = F.split(ip, r"\.")
    number = F.aggregate(parts, F.lit(0).cast("long"), lambda n, part: n * 256 + part.cast("long"))
    return F.when(ip.rlike(_IPV4), number)


def is_public_ipv4(ip: Column) -> Column:
    """True for a valid IPv4 address outside the private and reserved networks; null is false."""

    def public(number: Column) -> Column:
        out = number.isNotNull()
        for first, bits in NOT_PUBLIC:
            a, b, c, d = (int(x) for x in first.split("."))
            low = ((a * 256 + b) * 256 + c) * 256 + d
            out = out & ~number.between(low, low + 2 ** (32 - bits) - 1)
        return out

    # the lambda has the number computed once
    return F.coalesce(F.get(F.transform(F.array(ipv4_number(ip)), public), F.lit(0)), F.lit(False))


def public_ipv4(ip: Column) -> Column:
    return F.when(is_public_ipv4(ip), ip)


def first_public_ipv4(*candidates: Column) -> Column:
    """The first candidate that is a public address."""
    return F.coalesce(*(public_ipv4(c) for c in candidates))


def parse_event_ts(raw: Column) -> Column:
    """ISO-8601 with or without zone, or epoch seconds; null if neither. No zone is UTC."""
    number = F.when(raw.rlike(r"^-?[0-9]+(\.[0-9]+)?$"), F.timestamp_seconds(raw.cast("double")))
    iso = F.when(raw.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}"), F.try_to_timestamp(raw))
    return F.coalesce(number, iso)


def service_of_port(port: Column) -> Column:
    out = F.lit(None).cast("string")
    for number, name in SERVICES.items():
        out = F.when(port == number, name).otherwise(out)
    return out


def username_class(name: Column) -> Column:
    """empty, email, numeric, alpha, alphanum or special."""
    return F.when(name.contains("@"), F.lit("email")).otherwise(password_class(name))


def password_class(word: Column) -> Column:
    return (
        F.when(F.coalesce(word, F.lit("")) == "", "empty")
        .when(word.rlike(r"^\p{Nd}+$"), "numeric")
        .when(word.rlike(r"^\p{L}+$"), "alpha")
        .when(word.rlike(r"^[\p{L}\p{N}]+$"), "alphanum")
        .otherwise("special")
    )
