"""DuckDB SQL: the adapter as common table expressions, and what queries build on them."""

from __future__ import annotations

from trapline.functions.normalize import EVENT_TYPES, NOT_PUBLIC, SERVICES
from trapline.sources.adapter import PASSWORDS, PAYLOADS, PORTS, USERNAMES


def _list(values: list) -> str:
    return "[" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in values) + "]"


def _number(address: str) -> int:
    a, b, c, d = (int(x) for x in address.split("."))
    return ((a * 256 + b) * 256 + c) * 256 + d


def public(ip: str) -> str:
    """SQL: whether a well-formed address is public."""
    n = " + ".join(f"split_part({ip}, '.', {k + 1})::BIGINT * {256 ** (3 - k)}" for k in range(4))
    ranges = " OR ".join(f"({n}) BETWEEN {_number(a)} AND {_number(a) + 2 ** (32 - b) - 1}" for a, b in NOT_PUBLIC)
    return f"NOT ({ranges})"


def user_class(c: str) -> str:
    return f"CASE WHEN contains({c}, '@') THEN 'email' ELSE {pass_class(c)} END"


def pass_class(c: str) -> str:
    full = lambda p: f"regexp_full_match({c}, '{p}')"
    return f"CASE WHEN coalesce({c}, '') = '' THEN 'empty' WHEN {full('[0-9]+')} THEN 'numeric' WHEN {full('[A-Za-z]+')} THEN 'alpha' WHEN {full('[A-Za-z0-9]+')} THEN 'alphanum' ELSE 'special' END"


def payload_list(one: str, two: str) -> str:
    """SQL: the list of texts in the first field that is not empty, null if it is no such list."""
    a, b = (f"json_extract(payload, '$.{x}')" for x in (one, two))
    empty = f"({a} IS NULL OR CAST({a} AS VARCHAR) IN ('null', '[]', '\"\"', '0', 'false', '{{}}'))"
    pick = f"CASE WHEN {empty} THEN {b} ELSE {a} END"
    texts = f"json_extract({pick}, '$[*]')"
    fine = f"json_type({pick}) = 'ARRAY' AND len(list_filter({texts}, lambda x: json_type(x) <> 'VARCHAR')) = 0"
    return f"CASE WHEN {fine} THEN list_transform({texts}, lambda x: json_extract_string(x, '$')) END"


_TYPES = ", ".join(f"('{i}', '{label}', {repr(t) if t else 'NULL'}, {repr(k) if k else 'NULL'})" for i, label, t, k in EVENT_TYPES)
def service(port: str) -> str:
    """SQL: the service that a port stands for."""
    return f"CASE {port} " + " ".join(f"WHEN {p} THEN '{s}'" for p, s in SERVICES.items()) + " END"


_SERVICE = service("dst_port")

BASE = f"""
WITH et(id, label, attack_tactic, attack_technique) AS (VALUES {_TYPES}),
src AS (
  SELECT event_id, ts, user_id AS u, CAST(json_extract_string(props, '$.k') AS INT) AS k,
    CASE event_type WHEN 'click' THEN 'auth_failed' WHEN 'view' THEN 'port_scan' WHEN 'error' THEN 'http_probe'
      WHEN 'purchase' THEN 'auth_success' ELSE 'command_exec' END AS kind
  FROM events),
feed AS (
  SELECT CAST(event_id AS VARCHAR) AS id, ts, u, k,
    CASE u % 3 WHEN 0 THEN 'cowrie' WHEN 1 THEN 'dionaea' ELSE 'custom' END AS source,
    CASE WHEN u % 3 = 0 THEN CASE kind WHEN 'auth_failed' THEN 'cowrie.login.failed' WHEN 'auth_success' THEN 'cowrie.login.success'
        WHEN 'command_exec' THEN 'cowrie.command.input' WHEN 'port_scan' THEN 'Port.Scan' ELSE 'HTTP.Probe' END
      WHEN u % 3 = 1 THEN CASE kind WHEN 'port_scan' THEN 'dionaea.connection.free' ELSE replace(upper(kind), '_', '.') END
      ELSE CASE WHEN k % 50 = 0 THEN 'Odd.Thing' ELSE kind END END AS type,
    CASE WHEN u % 11 = 0 THEN '10.' ELSE '45.' END || (u // 65536 % 256) || '.' || (u // 256 % 256) || '.' || (u % 256) AS ip,
    {_list(PORTS)}[k % 12 + 1] AS dst_port,
    CASE WHEN kind <> 'port_scan' THEN {_list(USERNAMES)}[k % 8 + 1] END AS username,
    CASE WHEN kind <> 'port_scan' THEN {_list(PASSWORDS)}[k % 7 + 1] END AS password,
    CASE WHEN k % 4 < 2 THEN {_list(PAYLOADS)}[(u + k // 9) % {len(PAYLOADS)} + 1] END AS payload
  FROM src),
norm AS (
  SELECT *, CASE type WHEN 'cowrie.login.failed' THEN 'auth_failed' WHEN 'cowrie.login.success' THEN 'auth_success'
      WHEN 'cowrie.command.input' THEN 'command_exec' WHEN 'dionaea.connection.free' THEN 'port_scan'
      ELSE replace(lower(type), '.', '_') END AS norm_type
  FROM feed),
ev AS (
  SELECT n.id, ts, u, k, source, CASE WHEN {public("ip")} THEN ip END AS src_ip, norm_type,
    CASE WHEN norm_type IN (SELECT id FROM et) THEN norm_type ELSE 'unknown' END AS event_type,
    dst_port, {_SERVICE} AS service, username, password, {payload_list('kex_algs', 'kex_algorithms')} AS ssh_kex, {payload_list('tls_cipher_suites', 'ja3_ciphers')} AS tls_ciphers,
    CASE WHEN u % 13 <> 0 THEN lpad(CAST(u % 25 AS VARCHAR), 2, '0') END AS country_code,
    CASE WHEN u % 13 <> 0 THEN n_name END AS country_name,
    CASE WHEN u % 13 <> 0 THEN CAST(u % 10 + 64500 AS INT) END AS asn,
    CASE WHEN u % 13 <> 0 THEN 'ORG-' || (u % 10) END AS asn_org
  FROM norm n LEFT JOIN nation ON n_nationkey = u % 25),
pub AS (SELECT * FROM ev WHERE src_ip IS NOT NULL)
"""

TAG = "CASE norm_type WHEN 'auth_failed' THEN 'brute-force' WHEN 'auth_success' THEN 'auth-success' WHEN 'port_scan' THEN 'scanner' WHEN 'http_probe' THEN 'scanner' WHEN 'command_exec' THEN 'command-exec' WHEN 'malware_upload' THEN 'malware' END"

PROFILES = f"""
, prof AS (
  SELECT src_ip AS ip, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS event_count,
    arg_min(coalesce(country_code, '~'), (ts, id)) AS cc, arg_min(coalesce(country_name, '~'), (ts, id)) AS cn,
    arg_min(coalesce(asn, -1), (ts, id)) AS an, arg_min(coalesce(asn_org, '~'), (ts, id)) AS ao,
    list_sort(list(DISTINCT {TAG}) FILTER ({TAG} IS NOT NULL)) AS tags
  FROM pub GROUP BY src_ip),
profiles AS (
  SELECT ip, first_seen, last_seen, event_count, nullif(cc, '~') AS country_code, nullif(cn, '~') AS country_name,
    nullif(an, -1) AS asn, nullif(ao, '~') AS asn_org, tags,
    round(least(1.0, CASE WHEN event_count >= 100 THEN 0.3 WHEN event_count >= 10 THEN 0.1 ELSE 0.0 END
      + CASE WHEN list_contains(tags, 'brute-force') THEN 0.3 ELSE 0 END + CASE WHEN list_contains(tags, 'scanner') THEN 0.2 ELSE 0 END
      + CASE WHEN list_contains(tags, 'command-exec') THEN 0.3 ELSE 0 END + CASE WHEN list_contains(tags, 'malware') THEN 0.3 ELSE 0 END)::DOUBLE, 6) AS reputation_score
  FROM prof)
"""

MEMBERS = """
, members AS (
  SELECT 'c' || (u // 10) AS campaign_id, src_ip AS source_ip, min(ts) AS added_at, max(ts) AS last_active, 0.8::DOUBLE AS confidence
  FROM pub WHERE u % 7 <> 3 GROUP BY 1, 2),
camp0 AS (
  SELECT campaign_id AS id, CAST(substr(campaign_id, 2) AS INT) AS n, min(added_at) AS first_seen, max(last_active) AS last_seen, count(*) AS member_ip_count
  FROM members GROUP BY 1),
campaigns AS (
  SELECT id, n, CASE WHEN n % 10 IN (4, 5) THEN 'dormant' WHEN n % 10 = 6 THEN 'reactivated' WHEN n % 10 = 7 THEN 'historical' ELSE 'active' END AS status,
    0.5 + n % 10 * 0.05::DOUBLE AS confidence, first_seen, last_seen,
    CASE WHEN n % 10 IN (4, 5) THEN last_seen + INTERVAL 1 DAY END AS dormant_since, n % 3 AS reactivation_count, member_ip_count, n % 10 <> 9 AS has_fingerprint
  FROM camp0),
observations AS (
  SELECT 'o' || id AS id, 'c' || (u // 10) AS campaign_id, src_ip AS source_ip, ts AS observed_at,
    round(((k * 7 + u * 3) % 100) / 100.0::DOUBLE, 2) AS timing, round(((k * 3 + u * 7) % 100) / 100.0::DOUBLE, 2) AS sequence,
    round(((k * 11 + u) % 100) / 100.0::DOUBLE, 2) AS protocol, round(((k + u * 13) % 100) / 100.0::DOUBLE, 2) AS credential,
    round(((k * 17 + u * 5) % 100) / 100.0::DOUBLE, 2) AS target,
    CASE WHEN u % 2 = 0 THEN 'uncertain_association' ELSE 'automatic_association' END AS decision,
    CASE u % 3 WHEN 0 THEN 'analyst_confirmed' WHEN 1 THEN 'analyst_denied' END AS review,
    CASE WHEN u % 3 < 2 THEN ts + INTERVAL 1 HOUR END AS reviewed_at
  FROM pub WHERE u % 7 <> 3)
"""

ACTORS = """
, actors AS (
  SELECT 'a' || s_suppkey AS id, s_name AS display_name, round((s_suppkey % 10) / 10.0::DOUBLE, 1) AS confidence,
    CASE WHEN s_suppkey % 4 = 0 THEN 'archived' ELSE 'active' END AS status,
    TIMESTAMP '2024-01-01' + to_days(CAST(s_suppkey % 17 AS INT)) AS created_at
  FROM supplier),
lineage AS (
  SELECT 'l' || s_suppkey AS id, 'a' || (s_suppkey // 3) AS actor_id, 'c' || (s_suppkey // 6 + s_suppkey % 2) AS campaign_id,
    ['primary_campaign', 'infrastructure_reuse', 'tactic_match', 'temporal_overlap'][s_suppkey % 4 + 1] AS relationship_type,
    round((s_suppkey % 13) / 10.0::DOUBLE, 1) AS confidence, TIMESTAMP '2024-02-01' + to_days(CAST(s_suppkey % 23 AS INT)) AS created_at
  FROM supplier)
"""


def sessions(keys: str = "src_ip", source: str = "pub") -> str:
    """CTE ``marked``: events with session number and gap within it."""
    return f"""
, gaps AS (SELECT *, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY {keys} ORDER BY ts, id) AS g FROM {source}),
marked AS (
  SELECT *, sum(CASE WHEN g IS NULL OR g > 1800000000 THEN 1 ELSE 0 END) OVER (PARTITION BY {keys} ORDER BY ts, id ROWS UNBOUNDED PRECEDING)::BIGINT AS session,
    CASE WHEN g <= 1800000000 THEN g / 1000.0::DOUBLE END AS gap_ms
  FROM gaps)
"""


def features(keys: str = "src_ip", source: str = "pub") -> str:
    """CTEs f_timing, f_sequence, f_protocol, f_credential, f_target and fps."""
    hours = ", ".join(f"count(*) FILTER (hour(ts) = {h})" for h in range(24))
    days = ", ".join(f"count(*) FILTER (isodow(ts) = {d + 1})" for d in range(7))
    empty = "coalesce({}, '')"
    pattern = f"{user_class(empty.format('username'))} || '/' || {pass_class(empty.format('password'))}"
    has = lambda p: f"round(avg(CASE WHEN regexp_matches(password, '{p}') THEN 1.0 WHEN password IS NOT NULL THEN 0.0 END), 6)"

    def share(name: str, column: str, where: str = "true") -> str:
        return f"""
{name}0 AS (SELECT {keys}, {column} AS value, count(*) AS n, min((ts, id)) AS first FROM {source} WHERE {column} IS NOT NULL AND {where} GROUP BY ALL),
{name} AS (SELECT *, round(n / sum(n) OVER (PARTITION BY {keys})::DOUBLE, 6) AS share FROM {name}0)"""

    using = f"USING ({keys})"
    ms = lambda c: f"floor({c} + 0.500001) / 1000"
    return (
        sessions(keys, source)
        + f"""
, per AS (SELECT {keys}, session, count(*) AS n, (max(epoch_us(ts)) - min(epoch_us(ts))) / 1e6 AS d FROM marked GROUP BY ALL),
dur AS (SELECT {keys}, round(avg(d), 3) AS session_mean, round(stddev_pop(d), 3) AS session_stddev FROM per WHERE n > 1 GROUP BY ALL),
tim AS (
  SELECT {keys}, avg(gap_ms * 1000) AS m, stddev_pop(gap_ms * 1000) AS s, quantile_cont(gap_ms * 1000, [0.25, 0.75, 0.95]) AS q, count(*) AS n,
    [{hours}] AS tod, [{days}] AS dow FROM marked GROUP BY {keys}),
f_timing AS (
  SELECT {keys}, {ms('m')} AS interval_mean, {ms('s')} AS interval_stddev, {ms('q[1]')} AS interval_p25, {ms('q[2]')} AS interval_p75,
    {ms('q[3]')} AS interval_p95, session_mean, session_stddev, list_transform(tod, lambda x: round(x / n::DOUBLE, 6)) AS tod_histogram,
    list_transform(dow, lambda x: round(x / n::DOUBLE, 6)) AS dow_histogram, round(CASE WHEN m > 0 THEN s / m ELSE 0 END, 6) AS burst_cv
  FROM tim JOIN dur {using} WHERE m IS NOT NULL),
fp0 AS (SELECT {keys}, dst_port, min((ts, id)) AS first FROM {source} WHERE dst_port IS NOT NULL GROUP BY ALL),
fp1 AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY first) AS r FROM fp0),
fports AS (SELECT {keys}, list(dst_port ORDER BY r) AS port_sequence FROM fp1 WHERE r <= 50 GROUP BY {keys}),
ft0 AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY ts, id) AS r FROM {source}),
ftypes AS (SELECT {keys}, list(event_type ORDER BY r) AS event_type_sequence FROM ft0 WHERE r <= 50 GROUP BY {keys}),
fc0 AS (
  SELECT *, {pattern} AS pattern, row_number() OVER (PARTITION BY {keys} ORDER BY ts, id) AS r
  FROM {source} WHERE username IS NOT NULL OR password IS NOT NULL),
fcreds AS (SELECT {keys}, list(pattern ORDER BY r) AS credential_sequence FROM fc0 WHERE r <= 50 GROUP BY {keys}),
f_sequence AS (
  SELECT {keys}, coalesce(port_sequence, []) AS port_sequence, event_type_sequence, coalesce(credential_sequence, []) AS credential_sequence
  FROM ftypes LEFT JOIN fports {using} LEFT JOIN fcreds {using} WHERE port_sequence IS NOT NULL OR credential_sequence IS NOT NULL),
{share("ssvc", "service")},
dsvc AS (SELECT {keys}, list({{'value': value, 'share': share}} ORDER BY value) AS service_distribution FROM ssvc GROUP BY {keys}),
f_protocol AS (
  SELECT {keys}, coalesce(service_distribution, []) AS service_distribution, ssh_kex, tls_ciphers
  FROM (SELECT {keys}, arg_min(ssh_kex, (ts, id)) FILTER (ssh_kex IS NOT NULL) AS ssh_kex, arg_min(tls_ciphers, (ts, id)) FILTER (tls_ciphers IS NOT NULL) AS tls_ciphers
    FROM {source} GROUP BY {keys}) LEFT JOIN dsvc {using}),
{share("susr", user_class("username"), "username IS NOT NULL")},
dusr AS (SELECT {keys}, list({{'value': value, 'share': share}} ORDER BY value) AS username_class_dist FROM susr GROUP BY {keys}),
cr AS (
  SELECT {keys}, count(*) AS credential_count, round(avg(length(password)), 3) AS password_length_mean,
    {has("[A-Z]")} AS has_upper_ratio, {has("[a-z]")} AS has_lower_ratio, {has("[0-9]")} AS has_digit_ratio, {has("[^A-Za-z0-9]")} AS has_special_ratio
  FROM fc0 GROUP BY {keys}),
f_credential AS (
  SELECT cr.*, coalesce(username_class_dist, []) AS username_class_dist, credential_sequence
  FROM cr LEFT JOIN dusr {using} LEFT JOIN f_sequence {using}),
{share("sprt", "dst_port")},
rprt AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY n DESC, first) AS r FROM sprt),
f_target AS (
  SELECT {keys}, count(*) AS unique_port_count, list(value ORDER BY r) FILTER (r <= 20) AS top_dst_ports, list(share ORDER BY r) FILTER (r <= 20) AS port_shares
  FROM rprt GROUP BY {keys}),
fps0 AS (SELECT {keys}, count(*) AS event_count, max(ts) AS computed_at FROM {source} GROUP BY {keys}),
fps1 AS (
  SELECT fps0.*, CASE WHEN t.tod_histogram IS NOT NULL THEN t END AS timing, CASE WHEN s.event_type_sequence IS NOT NULL THEN s END AS sequence,
    CASE WHEN p.service_distribution IS NOT NULL THEN p END AS protocol, CASE WHEN c.credential_count IS NOT NULL THEN c END AS credential,
    CASE WHEN g.unique_port_count IS NOT NULL THEN g END AS target,
    1 + (t.tod_histogram IS NOT NULL)::INT + (s.event_type_sequence IS NOT NULL)::INT + (p.service_distribution IS NOT NULL)::INT
      + (c.credential_count IS NOT NULL)::INT + (g.unique_port_count IS NOT NULL)::INT AS populated
  FROM fps0 LEFT JOIN f_timing t {using} LEFT JOIN f_sequence s {using} LEFT JOIN f_protocol p {using} LEFT JOIN f_credential c {using} LEFT JOIN f_target g {using}),
fps AS (
  SELECT *, CASE WHEN event_count < 10 THEN round(event_count * (0.19 / 10)::DOUBLE, 4)
    ELSE round(least(0.95, 0.3::DOUBLE * populated / 6 + 0.5::DOUBLE * least(1.0, event_count / 500.0::DOUBLE) + 0.2::DOUBLE), 4) END AS confidence
  FROM fps1)
"""
    )


def _edit(a: str, b: str) -> str:
    d = f"list_distinct(list_concat({a}, {b}))"
    w = lambda x: f"array_to_string(list_transform({x}, lambda e: chr((32 + list_position({d}, e))::INT)), '')"
    return f"(CASE WHEN len({a}) = 0 AND len({b}) = 0 THEN 1.0 ELSE 1 - levenshtein({w(a)}, {w(b)}) / greatest(len({a}), len({b}))::DOUBLE END)"


def _jaccard(a: str, b: str) -> str:
    return f"(CASE WHEN len({a}) = 0 AND len({b}) = 0 THEN 1.0 ELSE len(list_intersect({a}, {b})) / len(list_distinct(list_concat({a}, {b})))::DOUBLE END)"


def _hist(p: str, q: str) -> str:
    half = lambda x, y: f"CASE WHEN {x} > 0 THEN {x} * log2({x} / (({x} + {y}) / 2)) ELSE 0 END"
    return f"(1 - list_sum(list_transform(list_zip({p}, {q}), lambda z: ({half('z[1]', 'z[2]')} + {half('z[2]', 'z[1]')}) / 2)))"


def _stat(a: str, b: str) -> str:
    return f"(1 - abs({a} - {b}) / (greatest({a}, {b}) + 1))"


def _mean(*parts: str) -> str:
    return f"coalesce(round(list_avg(list_filter([{', '.join(p + '::DOUBLE' for p in parts)}], lambda v: v IS NOT NULL)) + 1e-9, 6), 0)"


def _any(x: str, y: str, score: str) -> str:
    return f"(CASE WHEN len({x}) > 0 OR len({y}) > 0 THEN {score} END)"


def similarities(a: str, b: str) -> str:
    """SQL: five similarity columns of the structs a and b, which have a field per dimension."""
    out = []
    t = [f"{x}.timing" for x in (a, b)]
    stats = " + ".join(_stat(f"{t[0]}.interval_{k}", f"{t[1]}.interval_{k}") for k in ("mean", "stddev", "p25", "p75", "p95"))
    timing = _mean(f"(({stats}) / 5)", _hist(f"{t[0]}.tod_histogram", f"{t[1]}.tod_histogram"), _hist(f"{t[0]}.dow_histogram", f"{t[1]}.dow_histogram"), f"(1 - least(abs({t[0]}.burst_cv - {t[1]}.burst_cv), 1.0))")
    s = [f"{x}.sequence" for x in (a, b)]
    seq = _mean(*(_any(f"{s[0]}.{c}", f"{s[1]}.{c}", _edit(f"{s[0]}.{c}", f"{s[1]}.{c}")) for c in ("port_sequence", "event_type_sequence", "credential_sequence")))
    vals = lambda x, d, c: f"list_transform({x}.{d}.{c}, lambda e: e.value)"
    p = [vals(x, "protocol", "service_distribution") for x in (a, b)]
    order = lambda c: f"CASE WHEN {a}.protocol.{c} IS NOT NULL AND {b}.protocol.{c} IS NOT NULL THEN {_edit(f'{a}.protocol.{c}', f'{b}.protocol.{c}')} END"
    proto = _mean(_any(*p, _jaccard(*p)), order("ssh_kex"), order("tls_ciphers"))
    u = [vals(x, "credential", "username_class_dist") for x in (a, b)]
    c = [f"coalesce({x}.credential.credential_sequence, [])" for x in (a, b)]
    ratios = " + ".join(_stat(f"{a}.credential.{k}::DOUBLE", f"{b}.credential.{k}::DOUBLE") for k in ("has_upper_ratio", "has_lower_ratio", "has_digit_ratio", "has_special_ratio"))
    cred = _mean(_any(*u, _jaccard(*u)), f"(({ratios}) / 4)", _any(*c, _edit(*c)))
    g = [f"{x}.target.top_dst_ports" for x in (a, b)]
    top = [f"{x}[1:10]" for x in g]
    targ = _mean(_any(*g, _jaccard(*top)), _any(*g, _edit(*g)))
    for name, expr in zip(("timing", "sequence", "protocol", "credential", "target"), (timing, seq, proto, cred, targ), strict=True):
        out.append(f"CASE WHEN {a}.{name} IS NOT NULL AND {b}.{name} IS NOT NULL THEN {expr} END AS {name}_similarity")
    return ",\n  ".join(out)


def weighted(suffix: str = "_similarity", weights: dict[str, str] | None = None) -> str:
    """SQL: the weighted total of five columns."""
    w = weights or {"timing": "0.20", "sequence": "0.35", "protocol": "0.25", "credential": "0.10", "target": "0.10"}
    top = " + ".join(f"coalesce({v}::DOUBLE * {d}{suffix}, 0)" for d, v in w.items())
    bottom = " + ".join(f"CASE WHEN {d}{suffix} IS NOT NULL THEN {v}::DOUBLE ELSE 0 END" for d, v in w.items())
    return f"CASE WHEN ({bottom}) > 0 THEN round(({top}) / ({bottom}) + 1e-9, 6) ELSE 0 END"


_FIVE = "{'timing': timing, 'sequence': sequence, 'protocol': protocol, 'credential': credential, 'target': target}"

#: fps, members, campaigns; rep (campaign_id, b) of campaigns with a fingerprint; scored pairs.
SCORED = (
    features()
    + MEMBERS
    + f"""
, last AS (SELECT campaign_id, arg_max(source_ip, (last_active, source_ip)) AS src_ip FROM members GROUP BY 1),
rep AS (
  SELECT campaign_id, {_FIVE} AS b FROM last JOIN fps USING (src_ip)
  WHERE campaign_id IN (SELECT id FROM campaigns WHERE has_fingerprint AND status <> 'historical')),
cand AS (SELECT src_ip, {_FIVE} AS a, campaign_id, b FROM fps, rep WHERE confidence >= 0.2),
sims AS (SELECT src_ip, campaign_id, {similarities("a", "b")} FROM cand),
scored AS (SELECT *, {weighted()} AS score FROM sims)
"""
)

#: Weekly snapshots with the campaign of their source; neighbours; stability.
STABLE = (
    ", pubw AS (SELECT *, date_trunc('week', ts) AS week FROM pub)"
    + features("src_ip, week", "pubw")
    + MEMBERS
    + f"""
, firsts AS (SELECT u, src_ip, min(ts) AS t FROM pub WHERE u % 7 <> 3 GROUP BY 1, 2),
versions AS (
  SELECT src_ip AS source_ip, 'c' || (u // 10) AS member_of, t + INTERVAL 3 DAY AS since FROM firsts
  UNION ALL SELECT src_ip, 'c' || (u // 10 + 1), t + INTERVAL 15 DAY FROM firsts WHERE u % 4 = 0
  UNION ALL SELECT src_ip, NULL, t + INTERVAL 22 DAY FROM firsts WHERE u % 9 = 0),
hist AS (
  SELECT member_of AS campaign_id, src_ip, computed_at, {_FIVE} AS b FROM fps ASOF JOIN versions ON source_ip = src_ip AND computed_at > since WHERE member_of IS NOT NULL),
numbered AS (SELECT *, row_number() OVER (PARTITION BY campaign_id ORDER BY computed_at, src_ip) AS n FROM hist),
pairs AS (SELECT *, lag(b) OVER (PARTITION BY campaign_id ORDER BY n) AS a FROM numbered WHERE n <= 200),
psims AS (SELECT campaign_id, n, {similarities("a", "b")} FROM pairs WHERE n > 1),
samples AS (SELECT campaign_id, count(*) AS sample_count FROM numbered WHERE n <= 200 GROUP BY 1),
means AS (
  SELECT campaign_id, count(*) AS pair_count, {", ".join(f"round(avg({d}_similarity) + 1e-9, 6) AS {d}_stability" for d in ("timing", "sequence", "protocol", "credential", "target"))}
  FROM psims GROUP BY 1),
stab AS (
  SELECT campaign_id, sample_count, coalesce(pair_count, 0) AS pair_count, timing_stability, sequence_stability, protocol_stability, credential_stability, target_stability,
    {weighted("_stability")} AS composite_score, CASE WHEN sample_count < 2 THEN 'insufficient_data' ELSE 'ok' END AS status
  FROM samples LEFT JOIN means USING (campaign_id))
"""
)
