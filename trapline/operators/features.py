"""Sessions and the six feature groups of a behavioural fingerprint.

All functions take clean events and the key columns of a fingerprint, by default the
source; every aggregation is keyed by them, so one shuffle serves a group.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trapline.config import DEFAULT, Config
from trapline.functions import normalize as N
from trapline.sources.store import saved

KEY = ["src_ip"]
#: Events of a key whose percentiles are found by rank; of very many events, a share of all, so that the list of such keys is short.
LARGE = 1_000_000
LARGE_KEYS = 100_000
_ORDER = ["ts", "id"]


def _seconds(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp")) / 1e6


def _micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def _ms(micros: Column) -> Column:
    """Milliseconds to three digits; the small addend settles ties alike however a sum was formed."""
    return F.floor(micros + 0.500001) / 1000


def sessionize(events: DataFrame, keys: list[str] = KEY, cfg: Config = DEFAULT, part_seconds: int = 86_400) -> DataFrame:
    """Adds ``session`` (from 1) and ``gap_ms``, null at a session's first event.

    A session ends where the gap is greater than the limit. A key's events are ordered in
    parts of a day each, so a source of most events is dealt over many tasks. Parts are then
    stitched by their edges: what a part begins with follows from the last event of the
    part before it, and its sessions are numbered on from those of all earlier parts. Only
    edges, one row a part, are ordered over a key's whole time.
    """
    part = [*keys, "_part"]
    limit = cfg.session_gap_seconds * 1_000_000
    own = events.where(F.col(keys[0]).isNotNull()).withColumn("_t", _micros("ts")).withColumn("_part", F.coalesce(F.floor(F.col("_t") / (part_seconds * 1_000_000)), F.lit(-(1 << 40))))
    new = lambda gap: F.when(gap.isNull() | (gap > limit), 1).otherwise(0)

    inside = Window.partitionBy(*part).orderBy(*_ORDER)
    each = own.withColumns({"_first": F.row_number().over(inside) == 1, "_gap": F.col("_t") - F.lag("_t").over(inside)})
    # nulls first, as in the order of events: a part without times has no edge to compare with
    edges = each.groupBy(*part).agg(F.min("_t").alias("_low"), F.max("_t").alias("_high"), F.sum(F.when(F.col("_first"), 0).otherwise(new(F.col("_gap")))).alias("_inner"))
    over = Window.partitionBy(*keys).orderBy("_part")
    edges = edges.withColumn("_seam", F.col("_low") - F.lag("_high").over(over)).withColumn("_all", F.col("_inner") + new(F.col("_seam")))
    before = F.coalesce(F.sum("_all").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    edges = edges.select(*keys, "_part", "_seam", before.alias("_before"))

    # keys may be null beyond the first
    same = reduce(lambda x, y: x & y, (F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in part))
    told = each.alias("l").join(edges.alias("r"), same).select("l.*", "r._seam", "r._before")
    gap = F.when(F.col("_first"), F.col("_seam")).otherwise(F.col("_gap"))
    told = told.withColumn("_gap", gap)
    running = F.sum(new(F.col("_gap"))).over(inside.rowsBetween(Window.unboundedPreceding, 0))
    return (
        told.withColumn("session", F.col("_before") + running)
        .withColumn("gap_ms", F.when(F.col("_gap") <= limit, F.col("_gap") / 1000.0))
        .drop("_gap", "_t", "_part", "_first", "_seam", "_before")
    )


def sessions(events: DataFrame, keys: list[str] = KEY, cfg: Config = DEFAULT) -> DataFrame:
    """One row per session: events, start, end, duration in seconds."""
    return (
        sessionize(events, keys, cfg)
        .groupBy(*keys, "session")
        .agg(F.count("*").alias("n"), F.min("ts").alias("started"), F.max("ts").alias("ended"), (F.max(_seconds("ts")) - F.min(_seconds("ts"))).alias("duration_s"))
    )


def large_keys(events: DataFrame, keys: list[str] = KEY, large: int = LARGE) -> DataFrame | None:
    """The keys with more than ``large`` events, None if there is none; of very many events, a share of them, so that such keys are few."""
    counts = events.where(F.col(keys[0]).isNotNull()).groupBy(*keys).agg(F.count("*").alias("_n"))
    total, most = counts.agg(F.sum("_n"), F.max("_n")).first()
    limit = max(large, (total or 0) // LARGE_KEYS)
    return None if (most or 0) <= limit else saved(counts.where(F.col("_n") > limit).select(*keys))


def ranked_percentiles(values: DataFrame, keys: list[str], shares: list[float], width: int = 1 << 21) -> DataFrame:
    """(keys, q): exact percentiles of ``value`` (whole numbers), interpolated, of keys with any number of rows.

    Counts in bins of ``width`` tell which bin has each of the values between which a
    percentile lies; only the rows of those bins are then counted by value and ranked. So
    no task holds more of a key than its bins or one bin's different values.
    """
    binned = values.withColumn("_bin", F.floor(F.col("value") / width))
    over, inside = Window.partitionBy(*keys), Window.partitionBy(*keys, "_bin")
    upto = lambda w: w.rowsBetween(Window.unboundedPreceding, 0)
    bins = binned.groupBy(*keys, "_bin").agg(F.count("*").alias("_c")).withColumns({"_n": F.sum("_c").over(over), "_end": F.sum("_c").over(upto(over.orderBy("_bin")))})
    places = F.array(*(F.struct(F.lit(k).alias("k"), (F.lit(p) * (F.col("_n") - 1)).alias("at")) for k, p in enumerate(shares)))
    ranks = F.flatten(F.transform(places, lambda x: F.array(F.struct(x["k"].alias("k"), x["at"].alias("at"), F.floor(x["at"]).alias("r")), F.struct(x["k"].alias("k"), x["at"].alias("at"), F.ceil(x["at"]).alias("r")))))
    begin = F.col("_end") - F.col("_c")
    wanted = bins.select(*keys, "_bin", begin.alias("_begin"), F.filter(ranks, lambda x: (x["r"] >= begin) & (x["r"] < F.col("_end"))).alias("_ranks")).where(F.size("_ranks") > 0)
    hit = binned.join(wanted, [*keys, "_bin"]).groupBy(*keys, "_bin", "_begin", "_ranks", "value").agg(F.count("*").alias("_c"))
    last = F.col("_begin") + F.sum("_c").over(upto(inside.orderBy("value")))
    found = hit.withColumn("_last", last).select(*keys, "value", "_last", "_c", F.explode("_ranks").alias("x")).where((F.col("x.r") < F.col("_last")) & (F.col("x.r") >= F.col("_last") - F.col("_c")))
    # the smaller and the greater neighbour, which are one where the place is whole
    each = found.groupBy(*keys, F.col("x.k").alias("_k"), F.col("x.at").alias("_at")).agg(F.min("value").alias("_low"), F.max("value").alias("_high"))
    value = F.col("_low") + (F.col("_high") - F.col("_low")) * (F.col("_at") - F.floor("_at"))
    return each.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_k", value.alias("v")))), lambda x: x["v"]).alias("q"))


def timing(events: DataFrame, keys: list[str] = KEY, cfg: Config = DEFAULT, large: int = LARGE) -> DataFrame:
    """Gaps within sessions (ms), session durations (s), hour and weekday shares, burst variation.

    Keys without a gap within a session have no row. Percentiles are exact; those of keys
    with more than ``large`` events are found by rank, dealt over many tasks.
    """
    marked = sessionize(events, keys, cfg)
    per = marked.groupBy(*keys, "session").agg(
        F.count("*").alias("n"), (F.max(_micros("ts")) - F.min(_micros("ts"))).alias("d")
    )
    durations = per.where("n > 1").groupBy(*keys).agg(
        F.round(F.avg(F.col("d") / 1e6), 3).alias("session_mean"), F.round(F.stddev_pop(F.col("d") / 1e6), 3).alias("session_stddev")
    )
    gap, shares = F.col("gap_ms") * 1000, [0.25, 0.75, 0.95]
    hot = large_keys(events, keys, large)
    if hot is not None:
        marked = marked.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), keys, "left")
    single = gap if hot is None else F.when(F.col("_hot").isNull(), gap)
    out = marked.groupBy(*keys).agg(
        F.avg(gap).alias("m"), F.stddev_pop(gap).alias("s"), F.percentile(single, shares).alias("q"), F.count("*").alias("n"),
        F.array(*(F.count_if(F.hour("ts") == h) for h in range(24))).alias("tod"),
        F.array(*(F.count_if(F.weekday("ts") == d) for d in range(7))).alias("dow"),
    )
    if hot is not None:
        gaps = marked.where("_hot and gap_ms is not null").select(*keys, F.round(gap).cast("long").alias("value"))
        own = ranked_percentiles(gaps, keys, shares).withColumnRenamed("q", "_q")
        out = out.join(own, keys, "left").withColumn("q", F.coalesce("_q", "q")).drop("_q")
    share = lambda c: F.transform(c, lambda x: F.round(x / F.col("n"), 6))
    return out.where("m is not null").join(durations, keys).select(
        *keys, _ms(F.col("m")).alias("interval_mean"), _ms(F.col("s")).alias("interval_stddev"),
        *(_ms(F.get("q", k)).alias(name) for k, name in enumerate(("interval_p25", "interval_p75", "interval_p95"))),
        "session_mean", "session_stddev", share("tod").alias("tod_histogram"), share("dow").alias("dow_histogram"),
        F.round(F.when(F.col("m") > 0, F.col("s") / F.col("m")).otherwise(0.0), 6).alias("burst_cv"),
    )


def _first(events: DataFrame, keys: list[str], n: int) -> DataFrame:
    """The first n events of each key; Spark keeps only those before it shuffles."""
    order = Window.partitionBy(*keys).orderBy(*_ORDER)
    return events.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= n)


def _credential_events(events: DataFrame) -> DataFrame:
    return events.where("username is not null or password is not null").withColumn(
        "pattern", F.concat_ws("/", N.username_class(F.coalesce("username", F.lit(""))), N.password_class(F.coalesce("password", F.lit(""))))
    )


def sequence(events: DataFrame, keys: list[str] = KEY, cfg: Config = DEFAULT) -> DataFrame:
    """Ports by first use, event types in order, credential patterns in order; each at most 50."""
    own = events.where(F.col(keys[0]).isNotNull())
    in_order = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("_n", c))), lambda x: x[c])
    firsts = own.where("dst_port is not null").groupBy(*keys, "dst_port").agg(F.min("ts").alias("ts"), F.min(F.struct("ts", "id")).getField("id").alias("id"))
    ports = _first(firsts, keys, cfg.port_sequence).groupBy(*keys).agg(in_order("dst_port").alias("port_sequence"))
    types = _first(own, keys, cfg.event_types).groupBy(*keys).agg(in_order("event_type").alias("event_type_sequence"))
    creds = _first(_credential_events(own), keys, cfg.credentials).groupBy(*keys).agg(in_order("pattern").alias("credential_sequence"))
    none = lambda c, kind: F.coalesce(F.col(c), F.array().cast(f"array<{kind}>")).alias(c)
    return (
        types.join(ports, keys, "left").join(creds, keys, "left")
        .where("port_sequence is not null or credential_sequence is not null")
        .select(*keys, none("port_sequence", "int"), "event_type_sequence", none("credential_sequence", "string"))
    )


def shares(events: DataFrame, column: str, keys: list[str] = KEY) -> DataFrame:
    """keys, value, n and share of each value of a column; nulls are left out."""
    counts = events.where(F.col(keys[0]).isNotNull() & F.col(column).isNotNull()).groupBy(*keys, F.col(column).alias("value")).agg(
        F.count("*").alias("n"), F.min(F.struct("ts", "id")).alias("first")
    )
    total = F.sum("n").over(Window.partitionBy(*keys))
    return counts.withColumn("share", F.round(F.col("n") / total, 6))


def payload_list(payload: Column, *names: str) -> Column:
    """The list of texts that the first of the fields which is not empty holds; null if it holds anything else."""
    *others, last = (F.get_json_object(payload, f"$.{name}") for name in names)
    text = last
    for field in reversed(others):
        empty = field.isNull() | field.isin("", "[]", "{}", "0", "false", "null")
        text = F.when(empty, text).otherwise(field)
    parsed = F.from_json(text, "array<string>")
    kind = F.schema_of_variant(F.try_parse_json(text))
    return F.when(kind.isin("ARRAY<STRING>", "ARRAY<VOID>") & ~F.exists(parsed, lambda x: x.isNull()), parsed)


def handshakes(payload: Column) -> dict[str, Column]:
    """Columns with the key exchanges and ciphers that a sensor's payload lists, in their order."""
    return {"ssh_kex": payload_list(payload, "kex_algs", "kex_algorithms"), "tls_ciphers": payload_list(payload, "tls_cipher_suites", "ja3_ciphers")}


def protocol(events: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """service_distribution as sorted (value, share) entries, and the first key-exchange and cipher lists seen.

    A key with events always has a row; the lists are null where no event has one.
    """
    own = events.where(F.col(keys[0]).isNotNull())
    base = own.groupBy(*keys).agg(*_handshake_lists(own))
    return base.join(_distribution(own, "service", keys, "service_distribution"), keys, "left").withColumn("service_distribution", _or_none("service_distribution"))


def _handshake_lists(events: DataFrame) -> list[Column]:
    """Aggregates: the first key-exchange and cipher lists."""
    seen = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.struct("ts", "id"))) if c in events.columns else F.first(F.lit(None).cast("array<string>"))
    return [seen(c).alias(c) for c in ("ssh_kex", "tls_ciphers")]


def _distribution(events: DataFrame, column: str, keys: list[str], name: str) -> DataFrame:
    """The values of a column as sorted (value, share) entries."""
    return shares(events, column, keys).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("value", "share"))).alias(name))


def _or_none(distribution: str) -> Column:
    return F.coalesce(distribution, F.array().cast("array<struct<value:string,share:double>>"))


def credential(events: DataFrame, keys: list[str] = KEY, cfg: Config = DEFAULT) -> DataFrame:
    """Counts, username classes, password length and character shares; raw values stay here."""
    own = _credential_events(events.where(F.col(keys[0]).isNotNull()))
    out = own.groupBy(*keys).agg(*_credential_numbers())
    return out.join(_class_distribution(own, keys), keys, "left").withColumn("username_class_dist", _or_none("username_class_dist"))


def _credential_numbers() -> list[Column]:
    """Aggregates over events; those without credentials count nowhere."""
    has = lambda pattern: F.round(F.avg(F.col("password").rlike(pattern).cast("int")), 6)
    return [
        F.count_if(F.col("username").isNotNull() | F.col("password").isNotNull()).alias("credential_count"), F.round(F.avg(F.char_length("password")), 3).alias("password_length_mean"),
        has(r"\p{Lu}").alias("has_upper_ratio"), has(r"\p{Ll}").alias("has_lower_ratio"), has(r"\p{Nd}").alias("has_digit_ratio"),
        has(r"[^\p{L}\p{N}]").alias("has_special_ratio"),
    ]


def _class_distribution(events: DataFrame, keys: list[str]) -> DataFrame:
    return _distribution(events.where("username is not null").withColumn("class", N.username_class(F.col("username"))), "class", keys, "username_class_dist")


def target(events: DataFrame, keys: list[str] = KEY, cfg: Config = DEFAULT) -> DataFrame:
    """The 20 commonest ports with shares of all, ties by first use, and how many there are."""
    each = shares(events, "dst_port", keys)
    order = Window.partitionBy(*keys).orderBy(F.desc("n"), "first")
    ranked = each.withColumn("_n", F.row_number().over(order))
    top = F.when(F.col("_n") <= cfg.port_freq, F.struct("_n", "value", "share"))
    out = ranked.groupBy(*keys).agg(F.count("*").alias("unique_port_count"), F.array_sort(F.collect_list(top)).alias("top"))
    return out.select(
        *keys, "unique_port_count", F.transform("top", lambda x: x["value"]).alias("top_dst_ports"), F.transform("top", lambda x: x["share"]).alias("port_shares")
    )


def tool_signals(events: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """Shares of sensors and types, and tools they point to."""
    return events.where(F.col(keys[0]).isNotNull()).groupBy(*keys).agg(*_tool_shares()).withColumns(_tools())


def _tool_shares() -> list[Column]:
    """Aggregates: the share of each sensor and type."""
    share = lambda test: F.round(F.count_if(test) / F.count("*"), 6)
    sensors = [share(F.col("source") == s).alias(f"{s}_share") for s in ("cowrie", "dionaea", "custom")]
    return sensors + [share(F.col("event_type") == t[0]).alias(f"{t[0]}_share") for t in N.EVENT_TYPES]


def _tools() -> dict[str, Column]:
    """What the shares point to."""
    ssh = F.when((F.col("cowrie_share") >= 0.5) & (F.col("auth_failed_share") >= 0.5), F.round(F.least(F.lit(1.0), (F.col("cowrie_share") + F.col("auth_failed_share")) / 2), 3))
    return {
        "ssh_brute_force": ssh,
        "port_scanner": F.when(F.col("port_scan_share") >= 0.5, F.round("port_scan_share", 3)),
        "web_scanner": F.when(F.col("http_probe_share") >= 0.4, F.round("http_probe_share", 3)),
    }


def confidence(count: Column, groups: Column, cfg: Config = DEFAULT) -> Column:
    """0..0.95; under the least count of events always below 0.2."""
    many = F.lit(0.3) * groups / 6 + F.lit(0.5) * F.least(F.lit(1.0), count / 500) + F.lit(0.2)
    few = F.round(count * F.lit(0.19 / cfg.min_events), 4)
    return F.when(count <= 0, 0.0).when(count < cfg.min_events, few).otherwise(F.round(F.least(F.lit(0.95), many), 4))


def fingerprints(events: DataFrame, keys: list[str] = KEY, cfg: Config = DEFAULT) -> DataFrame:
    """One row per key: event_count, six feature structs (null if not computable) and confidence.

    All numbers that need no order or values of their own (counts, handshake lists,
    credentials, shares of sensors and types) are one aggregation, so one shuffle.
    ``events`` are read several times: pass a stored table.
    """
    own = events.where(F.col(keys[0]).isNotNull())
    each = [*_handshake_lists(own), *_credential_numbers(), *_tool_shares()]
    whole = own.groupBy(*keys).agg(F.count("*").alias("event_count"), F.max("ts").alias("computed_at"), *each).withColumns(_tools())
    pack = lambda df, name: df.select(*keys, F.struct(*[c for c in df.columns if c not in keys]).alias(name))
    parts = [
        _distribution(own, "service", keys, "service_distribution"), _class_distribution(own, keys),
        pack(sequence(own, keys, cfg), "sequence"), pack(timing(own, keys, cfg), "timing"), pack(target(own, keys, cfg), "target"),
    ]
    out = reduce(lambda a, b: a.join(b, keys, "left"), parts, whole)
    count = ["credential_count", "password_length_mean", "has_upper_ratio", "has_lower_ratio", "has_digit_ratio", "has_special_ratio"]
    signals = [c for c in whole.columns if c not in keys and (c.endswith("_share") or c in _tools())]
    out = out.select(
        *keys, "event_count", "computed_at", "timing", "sequence",
        F.struct("ssh_kex", "tls_ciphers", _or_none("service_distribution").alias("service_distribution")).alias("protocol"),
        F.when(F.col("credential_count") > 0, F.struct(*count, _or_none("username_class_dist").alias("username_class_dist"), F.col("sequence.credential_sequence").alias("credential_sequence"))).alias("credential"),
        "target", F.struct(*signals).alias("tool_signals"),
    )
    names = ("timing", "sequence", "protocol", "credential", "target", "tool_signals")
    populated = sum((F.when(F.col(c).isNotNull(), 1).otherwise(0) for c in names), F.lit(0))
    return out.withColumn("populated", populated).withColumn("confidence", confidence(F.col("event_count"), F.col("populated"), cfg))
