"""Registered queries on campaigns, actors, reviews and texts, each with its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from trapline.config import DEFAULT, DIMENSIONS
from trapline.functions import similarity as S
from trapline.functions import text as T
from trapline.operators import actors as R
from trapline.operators import campaigns as C
from trapline.operators import clustering as K
from trapline.operators import features as X
from trapline.operators import history as H
from trapline.operators import reviews as V
from trapline.plans import oracle as O
from trapline.plans.catalog import B, _stored, register
from trapline.sources import adapter as A
from trapline.sources.store import saved

NOW = "2024-02-03 12:00:00"
LATER = "2024-09-15 12:00:00"
M = B + O.MEMBERS


def _fps(spark, d):
    """All fingerprints, written once as each is read by both sides of a comparison."""
    return saved(X.fingerprints(_stored(spark, d)))


def _live(spark, d, campaigns=None):
    return (A.campaigns(spark, d) if campaigns is None else campaigns).where("has_fingerprint and status <> 'historical'").select(F.col("id").alias("campaign_id"))


def _reps(spark, d, fps):
    return K.representatives(A.members(spark, d), fps).join(_live(spark, d), "campaign_id", "left_semi")


def _only_reps(spark, d):
    """The same, where no other source's fingerprint is needed: only events of those that represent a campaign are read on."""
    ev = saved(A.events(spark, d).where("src_ip is not null"))
    last = saved(K.newest_members(A.members(spark, d, ev)).join(_live(spark, d), "campaign_id", "left_semi"))
    own = saved(ev.join(last.select("src_ip"), "src_ip", "left_semi"))
    return last.join(X.fingerprints(own).select("src_ip", *DIMENSIONS), "src_ip").drop("src_ip")


def _sides(spark, d):
    """(fingerprints, representatives of live campaigns): what is compared."""
    fps = _fps(spark, d)
    return fps, _reps(spark, d, fps)


def _history(spark, d):
    """Weekly snapshots with the campaign that their source was in at the time."""
    versions = A.member_versions(spark, d)
    # a source that is in no campaign ever has no snapshot that counts
    ev = saved(A.events(spark, d).join(versions.select(F.col("source_ip").alias("src_ip")), "src_ip", "left_semi"))
    snaps = X.fingerprints(ev.withColumn("week", F.date_trunc("week", "ts").cast("timestamp_ntz")), ["src_ip", "week"])
    return H.with_membership(snaps, versions)


def _stability(spark, d):
    return H.stability(_history(spark, d))


@register("B6", M + "SELECT id, campaign_id, source_ip, observed_at FROM observations WHERE decision = 'uncertain_association' AND review IS NULL ORDER BY observed_at, id LIMIT 50")
def review_queue(spark, d):
    return V.review_queue(A.observations(spark, d), limit=50).select("id", "campaign_id", "source_ip", "observed_at")


_ALERTS = O.STABLE + """
, alerts0 AS (
  SELECT campaign_id, 'composite_drift' AS alert_type, NULL AS dimension, 0.65::DOUBLE AS threshold, composite_score AS observed FROM stab WHERE status <> 'insufficient_data'
""" + "".join(f"  UNION ALL SELECT campaign_id, 'dimension_drift', '{x}', {t}::DOUBLE, {x}_stability FROM stab WHERE status <> 'insufficient_data'\n" for x, t in DEFAULT.drift.items()) + """),
alerts AS (SELECT * FROM alerts0 WHERE observed < threshold)
"""  # fmt: skip


@register("B7", B + _ALERTS + """
SELECT campaign_id, coalesce(dimension, '-') AS dimension, observed FROM alerts ORDER BY campaign_id DESC, coalesce(dimension, '-') LIMIT 5""")
def open_alerts(spark, d):
    found = H.drift_alerts(_stability(spark, d)).withColumns({"acknowledged_at": F.lit(None).cast("timestamp_ntz"), "triggered_at": F.col("campaign_id"), "id": F.coalesce("dimension", F.lit("-"))})
    return H.open_alerts(found, limit=5).select("campaign_id", F.col("id").alias("dimension"), "observed")


_DENSITY = """
, counts AS (
  SELECT id, (SELECT count(*) FROM observations o WHERE o.campaign_id = c.id) AS observation_count, (SELECT count(review) FROM observations o WHERE o.campaign_id = c.id) AS review_count,
    round(greatest(0.0, (epoch_us(last_seen) - epoch_us(first_seen)) / 1e6 / 3600), 4) AS age_hours, has_fingerprint, member_ip_count FROM campaigns c),
dens AS (
  SELECT *, CASE WHEN has_fingerprint THEN round(0.35::DOUBLE * least(1.0, observation_count / 20.0::DOUBLE) + 0.25::DOUBLE * least(1.0, member_ip_count / 5.0::DOUBLE)
    + 0.30::DOUBLE * least(1.0, age_hours / 168.0::DOUBLE) + 0.10::DOUBLE * least(1.0, review_count / 5.0::DOUBLE), 4) ELSE 0 END AS density_score FROM counts),
density AS (
  SELECT id, observation_count, review_count, age_hours, density_score,
    CASE WHEN NOT has_fingerprint THEN 'sparse' WHEN density_score >= 0.7 THEN 'mature' WHEN density_score >= 0.35 THEN 'established' ELSE 'emerging' END AS classification FROM dens)
"""


@register("B8", M + _DENSITY + "SELECT id, density_score, classification FROM density JOIN campaigns USING (id) WHERE NOT campaigns.has_fingerprint ORDER BY last_seen DESC, id LIMIT 20")
def sparse_campaigns(spark, d):
    c = A.campaigns(spark, d)
    found = C.density(c, A.observations(spark, d)).join(c.where("not has_fingerprint").select("id", "last_seen"), "id")
    return found.orderBy(F.desc("last_seen"), "id").limit(20).select("id", "density_score", "classification")


@register("B9", M + """
SELECT id, status, last_seen FROM (SELECT * FROM campaigns ORDER BY last_seen DESC, id LIMIT 8) WHERE status IN ('active', 'reactivated')
  AND last_seen BETWEEN TIMESTAMP '2024-01-02' AND TIMESTAMP '2024-02-02' ORDER BY last_seen DESC, id LIMIT 2""")
def brief_campaigns(spark, d):
    return C.select_brief(A.campaigns(spark, d), 2, "2024-01-02 00:00:00", "2024-02-02 00:00:00").select("id", "status", "last_seen")


@register("C6", M + O.ACTORS + """
SELECT l.id, actor_id, campaign_id, relationship_type, status FROM lineage l LEFT JOIN campaigns c ON c.id = campaign_id""")
def actor_campaigns(spark, d):
    return R.actor_campaigns(A.lineage(spark, d), A.campaigns(spark, d)).select("id", "actor_id", "campaign_id", "relationship_type", "status")


@register("C7", B + O.SCORED + "SELECT src_ip, campaign_id, timing_similarity, sequence_similarity, protocol_similarity, credential_similarity, target_similarity, score FROM scored")
def score_candidates(spark, d):
    return K.score_candidates(*_sides(spark, d), columns=K.SCORES[:-1])


_PAIRS = """
, linked AS (SELECT DISTINCT x.campaign_id AS a, y.campaign_id AS b FROM lineage x JOIN lineage y USING (actor_id) WHERE x.campaign_id < y.campaign_id),
cpairs AS (SELECT r.campaign_id AS a, q.campaign_id AS b, r.b AS x, q.b AS y FROM rep r JOIN rep q ON r.campaign_id < q.campaign_id
  WHERE NOT EXISTS (SELECT 1 FROM linked l WHERE l.a = r.campaign_id AND l.b = q.campaign_id))
"""


@register("C8", B + O.SCORED + O.ACTORS + _PAIRS + "SELECT a, b FROM cpairs")
def campaign_pairs(spark, d):
    return R.campaign_pairs(_reps(spark, d, _fps(spark, d)), A.lineage(spark, d)).select("a", "b")


@register("C9", M + "SELECT source_ip, campaign_id FROM members JOIN campaigns ON id = campaign_id WHERE status <> 'historical'")
def member_campaigns(spark, d):
    return C.member_campaigns(A.members(spark, d), A.campaigns(spark, d))


@register("C10", M + "SELECT campaign_id, arg_max(source_ip, (last_active, source_ip)) AS src_ip FROM members GROUP BY 1")
def representative_members(spark, d):
    fps = _fps(spark, d)
    reps = K.representatives(A.members(spark, d), fps.withColumns({x: F.struct(F.col("src_ip").alias("i")) for x in DIMENSIONS}))
    return reps.select("campaign_id", F.col("timing.i").alias("src_ip"))


@register("C11", M + O.ACTORS + """
SELECT l.id, CASE WHEN actor_id NOT IN (SELECT id FROM actors) THEN 'unknown_actor' WHEN campaign_id NOT IN (SELECT id FROM campaigns) THEN 'unknown_campaign'
  WHEN EXISTS (SELECT 1 FROM lineage e WHERE e.actor_id = l.actor_id AND e.campaign_id = l.campaign_id AND CAST(substr(e.id, 2) AS INT) % 5 = 0)
    OR row_number() OVER (PARTITION BY actor_id, campaign_id ORDER BY created_at, id) > 1 THEN 'already_linked'
  WHEN confidence NOT BETWEEN 0 AND 1 THEN 'bad_confidence' END AS reason FROM lineage l""")
def validated_lineage(spark, d):
    links = A.lineage(spark, d)
    held = links.where("cast(substring(id, 2) as int) % 5 = 0")
    return R.validate_lineage(links, A.actors(spark, d), A.campaigns(spark, d), held).select("id", "reason")


@register("D9", M + "SELECT campaign_id, attack_tactic, count(*) AS n FROM pub JOIN members ON source_ip = src_ip JOIN et ON et.id = event_type WHERE attack_tactic IS NOT NULL GROUP BY ALL")
def tactics(spark, d):
    ev = A.events(spark, d)
    return C.tactic_distribution(ev, A.members(spark, d, ev))


@register("D10", M + _DENSITY + "SELECT id, observation_count, review_count FROM counts")
def observation_counts(spark, d):
    return C.observation_counts(A.campaigns(spark, d), A.observations(spark, d))


@register("D11", M + _DENSITY + "SELECT * FROM density")
def density(spark, d):
    return C.density(A.campaigns(spark, d), A.observations(spark, d))


_SPREAD = ", ".join(f"round({f}({c}) + 1e-9, 6) AS {x}_{how}" for x, c in (("composite", "composite_score"), *((x, f"{x}_stability") for x in DIMENSIONS)) for how, f in (("min", "min"), ("max", "max"), ("mean", "avg")))


@register("D12", B + O.STABLE + O.ACTORS + f"""
, j AS (SELECT a.id AS actor_id, l.campaign_id, l.relationship_type, s.sample_count, s.status AS st, s.campaign_id IS NOT NULL AND s.status <> 'insufficient_data' AS known,
  {", ".join(f"CASE WHEN s.status <> 'insufficient_data' THEN s.{c} END AS {c}" for c in ("composite_score", *(f"{x}_stability" for x in DIMENSIONS)))}
  FROM actors a LEFT JOIN lineage l ON l.actor_id = a.id LEFT JOIN stab s ON s.campaign_id = l.campaign_id),
g AS (SELECT actor_id, count(campaign_id) AS linked, count(*) FILTER (campaign_id IS NOT NULL AND NOT known) AS missing, {_SPREAD},
  coalesce(string_agg(campaign_id || ':' || relationship_type || ':' || coalesce(st, 'no_data') || ':' || coalesce(sample_count, 0) || ':' || coalesce((round(composite_score * 1000000)::BIGINT)::VARCHAR, '-'), ','
    ORDER BY campaign_id, relationship_type) FILTER (campaign_id IS NOT NULL), '') AS contributors FROM j GROUP BY 1)
SELECT *, CASE WHEN linked = 0 THEN 'no_campaigns' WHEN missing = linked THEN 'no_data' WHEN missing > 0 THEN 'partial' ELSE 'ok' END AS status FROM g""")
def actor_stability(spark, d):
    found = R.actor_stability(A.actors(spark, d), A.lineage(spark, d), _stability(spark, d))
    whole = lambda x: F.coalesce(F.round(x * 1000000).cast("long").cast("string"), F.lit("-"))
    line = lambda c: F.concat_ws(":", c["campaign_id"], c["relationship_type"], c["status"], c["sample_count"].cast("string"), whole(c["composite_score"]))
    return found.withColumn("contributors", F.array_join(F.transform("contributors", line), ","))


@register("D13", B + _ALERTS + "SELECT campaign_id, alert_type, dimension, threshold, observed FROM alerts WHERE (campaign_id, coalesce(dimension, '-')) NOT IN (('c1', '-'), ('c2', 'sequence'))")
def drift_alerts(spark, d):
    held = spark.createDataFrame([("c1", None, None), ("c2", "sequence", None), ("c3", "target", "2024-01-01")], "campaign_id string, dimension string, acknowledged_at string")
    return H.drift_alerts(_stability(spark, d), held).drop("stability_snapshot")


@register("D13_snapshot", B + _ALERTS + """
SELECT a.campaign_id, dimension, composite_score, timing_stability, sequence_stability, protocol_stability, credential_stability, target_stability, sample_count, pair_count, status
FROM alerts a JOIN stab USING (campaign_id)""")
def alert_snapshots(spark, d):
    """What each alert was raised on."""
    found = H.drift_alerts(_stability(spark, d))
    return found.select("campaign_id", "dimension", *(f"stability_snapshot.{c}" for c in ("composite_score", *(f"{x}_stability" for x in DIMENSIONS), "sample_count", "pair_count", "status")))


@register("D14", M + _DENSITY + """
SELECT id, round(confidence * 0.4::DOUBLE + least(observation_count, 10) / 10.0::DOUBLE * 0.3::DOUBLE + CASE WHEN c.has_fingerprint THEN 0.2 ELSE 0 END::DOUBLE
  + CASE WHEN observation_count > 0 THEN 0.1 ELSE 0 END::DOUBLE, 3) AS quality FROM campaigns c JOIN counts USING (id)""")
def data_quality(spark, d):
    c = A.campaigns(spark, d).withColumn("groups", F.when(F.col("has_fingerprint"), 5).otherwise(0))
    return C.data_quality(c, A.observations(spark, d))


@register("E3", B + O.STABLE + "SELECT campaign_id, n, timing_similarity, sequence_similarity, protocol_similarity, credential_similarity, target_similarity FROM psims")
def consecutive(spark, d):
    return H.consecutive(_history(spark, d)).select("campaign_id", F.col("n").cast("long").alias("n"), *(f"{x}_similarity" for x in DIMENSIONS))


@register("F4", M + _DENSITY + "SELECT id, last_seen, campaigns.has_fingerprint, density_score FROM density JOIN campaigns USING (id) ORDER BY last_seen DESC, id LIMIT 5")
def recent_campaigns(spark, d):
    c = A.campaigns(spark, d)
    return C.recent(c, A.observations(spark, d), 5).select("id", "last_seen", "has_fingerprint", "density_score")


@register("F5", M + """
, n AS (SELECT campaign_id, dst_port, count(*) AS n FROM pub JOIN members ON source_ip = src_ip GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY campaign_id ORDER BY n DESC, dst_port) AS rank FROM n)
SELECT campaign_id, dst_port, n, rank FROM r WHERE rank <= 5""")
def top_target_ports(spark, d):
    ev = A.events(spark, d)
    return C.top_target_ports(ev, A.members(spark, d, ev)).withColumn("rank", F.col("rank").cast("long"))


@register("F6", B + O.SCORED + O.ACTORS + _PAIRS + f"""
, s AS (SELECT a, b, {O.similarities('x', 'y')} FROM cpairs), w AS (SELECT *, {O.weighted()} AS score FROM s)
SELECT a, b, score, CASE WHEN coalesce(sequence_similarity, 0) >= 0.85 AND coalesce(timing_similarity, 0) >= 0.8 THEN 'primary_campaign'
  WHEN coalesce(timing_similarity, 0) >= 0.8 AND coalesce(sequence_similarity, 0) < 0.7 THEN 'infrastructure_reuse'
  WHEN coalesce(protocol_similarity, 0) >= 0.8 THEN 'tactic_match' ELSE 'temporal_overlap' END AS hint, (SELECT count(*) FROM w) AS pairs_evaluated
FROM w WHERE score >= 0.5 ORDER BY score DESC, a, b LIMIT 20""")
def actor_suggestions(spark, d):
    return R.suggestions(_only_reps(spark, d), A.lineage(spark, d), min_score=0.5)


@register("F7", "SELECT conv_id, max(turn) AS turn, arg_max(role, turn) AS role FROM conversations GROUP BY conv_id")
def latest_per_resource(spark, d):
    t = A.table(spark, d, "conversations")
    return t.groupBy("conv_id").agg(F.max("turn").alias("turn"), F.max_by("role", "turn").alias("role"))


@register("F8", B + O.STABLE + """
, c AS (SELECT src_ip, computed_at, row_number() OVER (PARTITION BY src_ip ORDER BY computed_at) AS n, count(*) OVER (PARTITION BY src_ip) AS snapshots FROM fps)
SELECT * FROM c WHERE n <= 3""")
def ip_history(spark, d):
    ev = _stored(spark, d).withColumn("week", F.date_trunc("week", "ts").cast("timestamp_ntz"))
    snaps = X.fingerprints(ev, ["src_ip", "week"])
    found = H.counted(H.oldest(snaps, "src_ip", 3), snaps, "src_ip")
    return found.select("src_ip", "computed_at", F.col("n").cast("long").alias("n"), "snapshots")


@register("F9", M + """
, ms AS (SELECT id, page, string_agg(source_ip, ',' ORDER BY n) AS members FROM (
  SELECT campaign_id AS id, source_ip, row_number() OVER w AS n, (row_number() OVER w - 1) // 100 AS page FROM members WINDOW w AS (PARTITION BY campaign_id ORDER BY last_active DESC, source_ip)) GROUP BY ALL),
ob AS (SELECT campaign_id AS id, page, string_agg(o, ',' ORDER BY n) AS observations FROM (
  SELECT campaign_id, id AS o, row_number() OVER w AS n, (row_number() OVER w - 1) // 100 AS page FROM observations WINDOW w AS (PARTITION BY campaign_id ORDER BY observed_at, id)) GROUP BY ALL)
SELECT id, coalesce(page, 0) AS page, members, observations FROM campaigns LEFT JOIN (SELECT * FROM ms FULL JOIN ob USING (id, page)) USING (id)""")
def campaign_detail(spark, d):
    return C.detail(A.campaigns(spark, d), A.members(spark, d), A.observations(spark, d)).select(
        "id", "page", F.array_join("members", ",").alias("members"), F.array_join("observations", ",").alias("observations")
    )


@register("F10", B + O.ACTORS + "SELECT id, display_name, created_at FROM actors WHERE status = 'active' ORDER BY created_at DESC, id LIMIT 10")
def list_actors(spark, d):
    return R.list_actors(A.actors(spark, d), "active", 10).select("id", "display_name", "created_at")


_HIST = B + O.features() + """
, h AS (SELECT src_ip, tod_histogram AS p, lead(tod_histogram) OVER (ORDER BY src_ip) AS q, burst_cv AS a, lead(burst_cv) OVER (ORDER BY src_ip) AS b FROM f_timing)
"""  # fmt: skip


@register("H8", B + O.features() + f"""
, x AS (SELECT * FROM f_timing WHERE src_ip IN (SELECT min(src_ip) FROM f_timing))
SELECT f.src_ip, round({O._stat('f.interval_mean', 'x.interval_mean')}, 6) AS stat_sim, round(1 - least(abs(f.burst_cv - x.burst_cv), 1.0), 6) AS cv_sim,
  round({O._hist('f.tod_histogram', 'x.tod_histogram')}, 6) AS hist_sim FROM f_timing f, x""")
def scalar_similarities(spark, d):
    t = X.timing(A.events(spark, d))
    x = t.orderBy("src_ip").limit(1).select(*(F.col(c).alias(f"x_{c}") for c in ("interval_mean", "burst_cv", "tod_histogram")))
    j = t.join(F.broadcast(x))  # one row
    return j.select(
        "src_ip", F.round(S.stat_sim(F.col("interval_mean"), F.col("x_interval_mean")), 6).alias("stat_sim"), F.round(S.cv_sim(F.col("burst_cv"), F.col("x_burst_cv")), 6).alias("cv_sim"),
        F.round(S.histogram_sim(F.col("tod_histogram"), F.col("x_tod_histogram")), 6).alias("hist_sim"),
    )


@register("H9", B + O.features() + f"""
, x AS (SELECT * FROM f_sequence WHERE src_ip IN (SELECT min(src_ip) FROM f_sequence))
SELECT f.src_ip, round({O._edit('f.port_sequence', 'x.port_sequence')}, 6) AS ports, round({O._edit('f.event_type_sequence', 'x.event_type_sequence')}, 6) AS types FROM f_sequence f, x""")
def edit_similarity(spark, d):
    t = X.sequence(A.events(spark, d))
    x = t.orderBy("src_ip").limit(1).select(F.col("port_sequence").alias("xp"), F.col("event_type_sequence").alias("xt"))
    j = t.join(F.broadcast(x))  # one row
    return j.select("src_ip", F.round(S.edit_sim(F.col("port_sequence"), F.col("xp")), 6).alias("ports"), F.round(S.edit_sim(F.col("event_type_sequence"), F.col("xt")), 6).alias("types"))


@register("H10", B + O.SCORED + "SELECT campaign_id, round(avg(timing_similarity), 5) AS t, round(avg(sequence_similarity), 5) AS s, round(avg(protocol_similarity), 5) AS p, round(avg(credential_similarity), 5) AS c, round(avg(target_similarity), 5) AS g FROM scored GROUP BY 1")
def dimension_similarities(spark, d):
    names = zip("tspcg", DIMENSIONS, strict=True)
    return K.mean_similarities(*_sides(spark, d), 5).select("campaign_id", *(F.col(f"{x}_similarity").alias(k) for k, x in names))


@register("H11", B + O.SCORED + "SELECT src_ip, campaign_id, score FROM scored")
def weighted_similarity(spark, d):
    return K.score_candidates(*_sides(spark, d), columns=["score"])


@register("H12", B + O.SCORED + """
SELECT CASE WHEN coalesce(sequence_similarity, 0) >= 0.85 AND coalesce(timing_similarity, 0) >= 0.8 THEN 'primary_campaign'
  WHEN coalesce(timing_similarity, 0) >= 0.8 AND coalesce(sequence_similarity, 0) < 0.7 THEN 'infrastructure_reuse'
  WHEN coalesce(protocol_similarity, 0) >= 0.8 THEN 'tactic_match' ELSE 'temporal_overlap' END AS hint, count(*) AS n FROM scored GROUP BY 1""")
def relationship_hints(spark, d):
    return K.hint_counts(*_sides(spark, d))


_HEX = "('0x' || substr(h, {}, {}))::UBIGINT"


@register("H16", M + f"""
, d AS (SELECT DISTINCT src_ip AS id FROM pub), x AS (SELECT id, sha256(id) AS h FROM d),
n AS (SELECT id, list_transform(split(h, ''), lambda c: instr('0123456789abcdef', c) - 1) AS ds FROM x),
m AS (SELECT id, list_reduce(ds, lambda a, b: (a * 16 + b) % 30) AS i, list_reduce(ds[1:62], lambda a, b: (a * 16 + b) % 30) AS j, list_reduce(ds[1:60], lambda a, b: (a * 16 + b) % 90) AS k FROM n)
SELECT id, upper({T.ADJECTIVES!r}[i % 30 + 1]) || '-' || upper({T.ANIMALS!r}[j % 30 + 1]) || '-' || (k % 90 + 1) AS name FROM m""")
def campaign_names(spark, d):
    ids = A.events(spark, d).where("src_ip is not null").select(F.col("src_ip").alias("id")).distinct()
    return ids.select("id", T.campaign_name(F.col("id")).alias("name"))


def _weights_ctes() -> str:
    """CTEs q (reviews in order), cnt, f (the weights after each) and wp (the last), to follow the adapter's with RECURSIVE."""
    dims = list(DIMENSIONS)
    moved = {x: f"greatest(0.05::DOUBLE, least(0.60::DOUBLE, f.w_{x} + CASE WHEN r.{x} > 0.70 THEN r.step ELSE 0 END))" for x in dims}
    total = "(" + " + ".join(moved.values()) + ")"
    step = ", ".join(f"round({moved[x]} / {total} + 1e-12, 8) AS w_{x}" for x in dims)
    start = ", ".join(f"{DEFAULT.weights[x]}::DOUBLE AS w_{x}" for x in dims)
    return f"""
, q0 AS (SELECT *, row_number() OVER (PARTITION BY campaign_id ORDER BY observed_at, id) AS n FROM observations WHERE decision = 'uncertain_association'),
q AS (SELECT *, CASE WHEN review = 'analyst_confirmed' THEN 0.02 ELSE -0.02 END::DOUBLE AS step, row_number() OVER (PARTITION BY campaign_id ORDER BY n) AS i FROM q0 WHERE n <= 200 AND review IS NOT NULL),
cnt AS (SELECT campaign_id, count(*) AS review_count, count(*) FILTER (review = 'analyst_confirmed') AS confirmed_count FROM q GROUP BY 1),
f AS (SELECT campaign_id, 0::BIGINT AS i, {start} FROM cnt UNION ALL SELECT r.campaign_id, r.i, {step} FROM f JOIN q r ON r.campaign_id = f.campaign_id AND r.i = f.i + 1),
wp AS (SELECT f.* FROM f JOIN cnt USING (campaign_id) WHERE i = review_count AND review_count >= 3)
"""


def _recursive(sql: str) -> str:
    return sql.replace("WITH et", "WITH RECURSIVE et", 1)


_SIMILARITIES = ", ".join(f"{x}_similarity" for x in DIMENSIONS)
_ASSIGN = O.SCORED + _weights_ctes() + f"""
, own AS (SELECT source_ip AS src_ip, arg_max(campaign_id, (last_active, campaign_id)) AS own FROM members GROUP BY 1),
rescored AS (SELECT sims.*, {O.weighted(weights={x: f"coalesce(w_{x}, {DEFAULT.weights[x]})" for x in DIMENSIONS})} AS score,
  {" + ".join(f"({x}_similarity IS NOT NULL)::INT" for x in DIMENSIONS)} AS dimensions_used FROM sims LEFT JOIN wp USING (campaign_id)),
o AS (SELECT *, row_number() OVER (PARTITION BY src_ip ORDER BY score DESC, campaign_id) AS r FROM rescored WHERE score >= 0.6 AND src_ip NOT IN (SELECT source_ip FROM members)),
d0 AS (SELECT fps.src_ip, fps.confidence, fps.event_count, own, o.* EXCLUDE (src_ip, r), status, floor((epoch_us(TIMESTAMP '{LATER}') - epoch_us(last_seen)) / 86400000000)::BIGINT AS gap
  FROM fps LEFT JOIN own USING (src_ip) LEFT JOIN (SELECT * FROM o WHERE r = 1) o USING (src_ip) LEFT JOIN campaigns ON id = o.campaign_id),
d1 AS (SELECT *, CASE WHEN gap > 365 THEN 0.9 WHEN gap > 182 THEN 0.85 ELSE 0.8 END::DOUBLE AS bar, confidence < 0.2 AS sparse, campaign_id IS NOT NULL AS hit FROM d0),
assigned AS (SELECT src_ip, CASE WHEN sparse THEN 'skipped_sparse' WHEN own IS NOT NULL THEN 'existing_member' WHEN NOT hit THEN 'new_campaign' WHEN score >= bar THEN 'automatic_association' ELSE 'uncertain_association' END AS decision,
  CASE WHEN NOT sparse THEN coalesce(own, campaign_id) END AS campaign_id, CASE WHEN NOT sparse AND own IS NULL THEN score END AS score,
  CASE WHEN sparse THEN 0.2 WHEN own IS NOT NULL THEN 0 WHEN NOT hit THEN 0.6 ELSE bar END::DOUBLE AS threshold, coalesce(NOT sparse AND own IS NULL AND status = 'dormant', false) AS is_reactivation,
  CASE WHEN NOT sparse AND own IS NULL AND status = 'dormant' THEN gap END AS gap_days, event_count, {_SIMILARITIES}, dimensions_used FROM d1)
"""


def _decided(spark, d):
    """(decisions, fingerprints, members, campaigns, representatives): all sources against the campaigns, with the weights that reviews taught.

    Members, campaigns and decisions are written once, as each is read several times.
    """
    fps, members = _fps(spark, d), saved(A.members(spark, d))
    campaigns = saved(A.campaigns(spark, d, members))
    reps = saved(K.representatives(members, fps).join(_live(spark, d, campaigns), "campaign_id", "left_semi"))
    scored = K.best_candidates(K.unassigned(fps, members), reps, profiles=V.weight_profiles(A.observations(spark, d)))
    return saved(K.assign(fps, scored, campaigns, members, LATER)), fps, members, campaigns, reps


_EXPLAINED = [*(f"{x}_similarity" for x in DIMENSIONS), "dimensions_used"]


@register("H17", _recursive(B + _ASSIGN) + "SELECT * FROM assigned")
def assign_campaigns(spark, d):
    found = _decided(spark, d)[0]
    return found.select("src_ip", "decision", "campaign_id", "score", F.col("threshold").cast("double").alias("threshold"), "is_reactivation", "gap_days", "event_count", *(f"explanation.{c}" for c in _EXPLAINED))


_LINKED = "decision IN ('automatic_association', 'uncertain_association')"


@register("H19", _recursive(B + _ASSIGN) + f"""
, dl AS (SELECT campaign_id AS id, count(*) FILTER ({_LINKED}) AS n, bool_or(is_reactivation) AS re, max(src_ip) FILTER ({_LINKED}) AS representative_ip FROM assigned WHERE campaign_id IS NOT NULL GROUP BY 1)
SELECT id, CASE WHEN coalesce(re, false) THEN 'reactivated' ELSE status END AS status, CASE WHEN dl.n IS NOT NULL THEN TIMESTAMP '{LATER}' ELSE last_seen END AS last_seen,
  CASE WHEN NOT coalesce(re, false) THEN dormant_since END AS dormant_since, reactivation_count + coalesce(re, false)::INT AS reactivation_count,
  member_ip_count + coalesce(dl.n, 0) AS member_ip_count, representative_ip FROM campaigns c LEFT JOIN dl USING (id)""")
def apply_associations(spark, d):
    found, _, _, campaigns, _ = _decided(spark, d)
    return K.apply_associations(campaigns, found, LATER)


@register("H19_members", _recursive(B + _ASSIGN) + f"""
SELECT campaign_id, source_ip, added_at, CASE WHEN (campaign_id, source_ip) IN (SELECT (campaign_id, src_ip) FROM assigned WHERE decision = 'existing_member') THEN TIMESTAMP '{LATER}' ELSE last_active END AS last_active, confidence FROM members
UNION ALL SELECT campaign_id, src_ip, TIMESTAMP '{LATER}', TIMESTAMP '{LATER}', score FROM assigned WHERE {_LINKED}""")
def next_members(spark, d):
    found, _, members, _, _ = _decided(spark, d)
    return K.next_members(members, found, LATER)


@register("H19_observations", _recursive(B + _ASSIGN) + f"""
SELECT campaign_id, src_ip AS source_ip, TIMESTAMP '{LATER}' AS observed_at, event_count, is_reactivation, gap_days AS dormancy_gap_days, score AS weighted_total FROM assigned WHERE campaign_id IS NOT NULL""")
def new_observations(spark, d):
    return K.new_observations(_decided(spark, d)[0], LATER).withColumn("weighted_total", F.col("explanation.weighted_total")).drop("explanation")


@register("H19_representatives", _recursive(B + _ASSIGN) + f"""
, newest AS (SELECT campaign_id, max(src_ip) AS src_ip FROM assigned WHERE {_LINKED} GROUP BY 1),
all_ AS (SELECT campaign_id, b FROM rep WHERE campaign_id NOT IN (SELECT campaign_id FROM newest)
  UNION ALL SELECT n.campaign_id, {O._FIVE} FROM newest n JOIN fps USING (src_ip))
SELECT campaign_id, b.timing.interval_mean AS interval_mean, array_to_string(b.sequence.port_sequence, ',') AS ports FROM all_""")
def new_representatives(spark, d):
    found, fps, _, _, reps = _decided(spark, d)
    new = K.new_representatives(reps, found, fps)
    return new.select("campaign_id", "timing.interval_mean", F.array_join(F.transform("sequence.port_sequence", lambda p: p.cast("string")), ",").alias("ports"))


@register("H20", B + O.STABLE + "SELECT * FROM stab")
def stability(spark, d):
    return _stability(spark, d).drop("dimensions_used")


@register("H21", _recursive(M + _weights_ctes()) + f"""
SELECT campaign_id, {", ".join(f"w_{x}" for x in DIMENSIONS)}, review_count, confirmed_count, review_count - confirmed_count AS denied_count FROM wp JOIN cnt USING (campaign_id)""")
def weight_profiles(spark, d):
    """In two runs: the second goes on from the profiles of the first weeks and leaves out what those have logged."""
    o = A.observations(spark, d)
    begun = V.weight_profiles(o.where("observed_at < TIMESTAMP_NTZ '2024-01-15 00:00:00'"))
    return V.weight_profiles(o, existing=begun).drop("log")


@register("H21_log", _recursive(M + _weights_ctes()) + f"""
SELECT campaign_id, f.i AS step, id AS observation_id, review AS review_decision, reviewed_at, {", ".join(f"CASE WHEN q.{x} > 0.70 THEN q.step ELSE 0 END AS a_{x}, w_{x}" for x in DIMENSIONS)}
FROM f JOIN q USING (campaign_id, i) JOIN cnt USING (campaign_id) WHERE review_count >= 3""")
def weight_log(spark, d):
    steps = V.weight_profiles(A.observations(spark, d)).select("campaign_id", F.posexplode("log").alias("k", "e"))
    moved = [c for x in DIMENSIONS for c in (F.col(f"e.adjustments.{x}").alias(f"a_{x}"), F.col(f"e.weights_after.{x}").alias(f"w_{x}"))]
    return steps.select("campaign_id", (F.col("k") + 1).cast("long").alias("step"), "e.observation_id", "e.review_decision", "e.reviewed_at", *moved)


@register("H22", M + f"""
SELECT id, CASE WHEN status IN ('active', 'reactivated') AND last_seen < TIMESTAMP '{LATER}' - INTERVAL 7 DAY THEN 'dormant'
  WHEN status = 'dormant' AND dormant_since < TIMESTAMP '{LATER}' - INTERVAL 90 DAY THEN 'historical' ELSE status END AS status,
  CASE WHEN status IN ('active', 'reactivated') AND last_seen < TIMESTAMP '{LATER}' - INTERVAL 7 DAY THEN TIMESTAMP '{LATER}' ELSE dormant_since END AS dormant_since FROM campaigns""")
def lifecycle(spark, d):
    return C.lifecycle(A.campaigns(spark, d), LATER).select("id", "status", "dormant_since")


@register("H22_counts", M + f"""
SELECT count(*) FILTER (status IN ('active', 'reactivated') AND last_seen < TIMESTAMP '{LATER}' - INTERVAL 7 DAY) AS to_dormant,
  count(*) FILTER (status = 'dormant' AND dormant_since < TIMESTAMP '{LATER}' - INTERVAL 90 DAY) AS to_historical FROM campaigns""")
def lifecycle_counts(spark, d):
    campaigns = A.campaigns(spark, d)
    return C.transitions(campaigns, C.lifecycle(campaigns, LATER))


@register("H24", "SELECT doc_id, sha256(CASE WHEN regexp_matches(substr(text, 1, 200), '" + T.INJECTION.replace("'", "''") + "') THEN '[REDACTED]' ELSE substr(text, 1, 200) END) AS h FROM documents")
def sanitized(spark, d):
    return A.table(spark, d, "documents").select("doc_id", F.sha2(T.sanitize_text(F.col("text")), 256).alias("h"))


@register("H25", f"SELECT doc_id, regexp_matches(text, '{T.IPV4}') AS has_ip, sha256(regexp_replace(text, '{T.IPV4}', '[IP REDACTED]', 'g')) AS h FROM documents WHERE NOT contains(text, '::') AND NOT regexp_matches(text, '[0-9a-fA-F]:[0-9a-fA-F]')")
def redacted(spark, d):
    return A.table(spark, d, "documents").select("doc_id", T.contains_ip(F.col("text")).alias("has_ip"), F.sha2(T.redact_ips(F.col("text")), 256).alias("h"))


@register("H26", f"SELECT doc_id, CASE WHEN trim(text) = '' THEN 'empty_response' WHEN regexp_matches(text, '{T.IPV4}') OR regexp_matches(text, '{T.IPV6}') THEN 'ip_detected' WHEN length(text) > 1000 THEN 'truncated' ELSE 'ok' END AS verdict, strlen(text)::INT AS bytes FROM documents")
def validated_texts(spark, d):
    return A.table(spark, d, "documents").select("doc_id", T.validate_text(F.col("text")).alias("verdict"), F.octet_length("text").alias("bytes"))


@register("H27", M + f"""
, g AS (SELECT id, floor((epoch_us(TIMESTAMP '{LATER}') - epoch_us(last_seen - to_days(n * 30))) / 86400000000)::BIGINT AS gap_days FROM campaigns)
SELECT id, gap_days, CASE WHEN gap_days > 365 THEN 0.9 WHEN gap_days > 182 THEN 0.85 ELSE 0.8 END::DOUBLE AS threshold FROM g""")
def thresholds(spark, d):
    c = A.campaigns(spark, d).withColumn("seen", F.expr("last_seen - make_dt_interval(n * 30)"))
    now = F.lit(LATER).cast("timestamp_ntz")
    return c.select("id", C.gap_days(F.col("seen"), now).alias("gap_days"), C.effective_threshold(F.col("seen"), now).cast("double").alias("threshold"))


@register("H28", M + """
, r AS (SELECT id, review, reviewed_at FROM observations WHERE review IS NOT NULL
  UNION ALL SELECT id, 'analyst_denied', observed_at + INTERVAL 2 HOUR FROM observations WHERE decision = 'uncertain_association'),
l AS (SELECT id, arg_max(review, (reviewed_at, review)) AS review FROM r GROUP BY 1)
SELECT o.id, coalesce(l.review, o.review) AS review FROM observations o LEFT JOIN l USING (id)""")
def latest_reviews(spark, d):
    o = A.observations(spark, d)
    again = o.where("decision = 'uncertain_association'").select("id", F.lit("analyst_denied").alias("review"), F.expr("observed_at + INTERVAL '2' HOUR").alias("reviewed_at"))
    return V.latest_reviews(o, o.where("review is not null").select("id", "review", "reviewed_at").unionByName(again)).select("id", "review")


@register("H29", M + """
SELECT id, CASE WHEN review IS NOT NULL THEN reviewed_at END AS acknowledged_at FROM observations""")
def acknowledged(spark, d):
    o = A.observations(spark, d)
    alerts = o.select("id", F.lit(None).cast("timestamp_ntz").alias("acknowledged_at"))
    return H.acknowledge(alerts, o.where("review is not null").select("id", F.col("reviewed_at").alias("acknowledged_at")))


def _top(entries: str, n: int) -> str:
    """SQL: the values with the greatest shares, as text."""
    pairs = f"list_transform({entries}, lambda e: {{'s': e.share, 'v': e.value}})"
    return f"array_to_string(list_transform(list_sort({pairs}, 'DESC')[1:{n}], lambda e: e.v), ', ')"


@register("H23", B + O.SCORED + f"""
, tac AS (SELECT campaign_id, attack_tactic, count(*) AS n FROM pub JOIN members ON source_ip = src_ip JOIN et ON et.id = event_type WHERE attack_tactic IS NOT NULL GROUP BY ALL),
tac5 AS (SELECT *, row_number() OVER (PARTITION BY campaign_id ORDER BY n DESC, attack_tactic) AS r FROM tac),
tacs AS (SELECT campaign_id, string_agg(attack_tactic || ' (' || n || ')', '; ' ORDER BY r) AS tactics FROM tac5 WHERE r <= 5 GROUP BY 1),
f AS (SELECT campaign_id, b.timing AS t, b.sequence AS s, b.protocol AS p, b.credential AS c, b.target AS g FROM rep),
h AS (SELECT campaign_id, CASE WHEN t IS NOT NULL THEN list_position(t.tod_histogram, list_max(t.tod_histogram)) - 1 END AS peak_hour, t.burst_cv > 0.5 AS bursts,
  len(s.port_sequence) AS steps, len(list_distinct(s.event_type_sequence)) AS event_types, {_top("p.service_distribution", 3)} AS services, {_top("c.username_class_dist", 3)} AS username_classes,
  array_to_string(g.top_dst_ports[1:5], ', ') AS ports, tactics, reactivation_count AS reactivations FROM f JOIN campaigns ON id = campaign_id LEFT JOIN tacs USING (campaign_id))
SELECT *, concat_ws('; ', CASE WHEN bursts THEN 'burst activity present' END, 'peak hour ' || lpad(peak_hour::VARCHAR, 2, '0') || ':00 UTC', steps || '-step port sequence',
  event_types || CASE WHEN event_types = 1 THEN ' event type' ELSE ' event types' END, 'primary services: ' || services, 'username class patterns: ' || username_classes,
  'primary ports: ' || ports, 'tactics: ' || tactics, 'reactivations: ' || reactivations) AS text FROM h""")
def campaign_digest(spark, d):
    ev = A.events(spark, d)
    found = C.digest(_reps(spark, d, _fps(spark, d)), A.campaigns(spark, d), C.tactic_distribution(ev, A.members(spark, d, ev)))
    # the mean's decimals are written differently by other engines
    text = F.regexp_replace("text", r"^interval ~[^;]*; ", "")
    return found.withColumns({"peak_hour": F.col("peak_hour").cast("int"), "steps": F.col("steps").cast("long"), "event_types": F.col("event_types").cast("long"), "text": text})


@register("H18")
def seed_campaigns(spark, d):
    """All sources with enough events, as if no campaign existed yet; tests/test_jobs.py has a twin in plain Python."""
    ev = _stored(spark, d)
    first = ev.where("src_ip is not null").groupBy("src_ip").agg(F.min("ts").alias("first_seen"))
    return K.seed_campaigns(X.fingerprints(ev).join(first, "src_ip").where(F.col("confidence") >= DEFAULT.min_confidence))
