"""Scoring fingerprints against campaigns, assignment and new campaigns."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import partial, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trapline.config import DEFAULT, DIMENSIONS, Config
from trapline.functions import similarity as S
from trapline.operators import blocks as P
from trapline.operators.campaigns import effective_threshold, gap_days
from trapline.sources.store import in_arrow, saved

#: Bytes of candidates, as JSON, that are broadcast at most; for more Spark chooses how the sides are paired.
BROADCAST_BYTES = 64 << 20
#: What is told of a pair.
SCORES = (*(f"{d}_similarity" for d in DIMENSIONS), "score", "dimensions_used")


def fits(rows: DataFrame) -> bool:
    """Whether rows may be broadcast: measured in bytes, as key-exchange lists have any length."""
    return (rows.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0] or 0) <= BROADCAST_BYTES


def newest_members(members: DataFrame) -> DataFrame:
    """campaign_id, src_ip: the most recently active member of each campaign."""
    return members.groupBy("campaign_id").agg(F.max_by("source_ip", F.struct("last_active", "source_ip")).alias("src_ip"))


def representatives(members: DataFrame, fingerprints: DataFrame, cached: DataFrame | None = None) -> DataFrame:
    """campaign_id and five structs: the cached ones, else the most recently active member's."""
    own = newest_members(members).join(fingerprints.select("src_ip", *DIMENSIONS), "src_ip").drop("src_ip")
    if cached is None:
        return own
    return cached.unionByName(own.join(cached.select("campaign_id"), "campaign_id", "left_anti"))


def compare(pairs: DataFrame, a: str, b: str, cfg: Config = DEFAULT, weights: dict[str, Column] | None = None) -> DataFrame:
    """Adds five similarities, ``score`` and ``dimensions_used`` to rows with coded structs a and b of five groups.

    The similarities come out of a generator, through which no filter on the score is
    pushed; as plain columns they would be worked out in the filter and again after it.
    """
    five = F.struct(*(S.SIMILARITIES[d](F.col(f"{a}.{d}"), F.col(f"{b}.{d}")).alias(f"{d}_similarity") for d in DIMENSIONS))
    scored = pairs.select("*", F.inline(F.array(five)))
    score, used = S.weighted({d: F.col(f"{d}_similarity") for d in DIMENSIONS}, cfg, weights)
    return scored.withColumns({"score": score, "dimensions_used": used})


def as_struct(df: DataFrame, name: str, *keep: Column) -> DataFrame:
    """The five groups, coded for comparison, as one struct."""
    return S.coded(df).select(*keep, F.struct(*DIMENSIONS).alias(name))


def against(fingerprints: DataFrame, campaigns: DataFrame, take: Callable, schema: str, cfg: Config = DEFAULT, profiles: DataFrame | None = None) -> DataFrame:
    """What ``take`` makes of every eligible fingerprint against every live campaign, block by block (:mod:`blocks`).

    ``campaigns`` has campaign_id and the five structs. ``profiles`` (campaign_id,
    w_timing, ...) replaces the weights of the campaigns it names. Candidates are
    written once and broadcast up to a checked size.
    """
    more = {}
    if profiles is not None:
        names = [f"w_{d}" for d in DIMENSIONS]
        campaigns = campaigns.join(profiles.select("campaign_id", *names), "campaign_id", "left")
        more["weights"] = F.array(*names)
    right = P.packed(P.flat(campaigns, "campaign_id", **more), dealt=False)
    left = P.packed(P.flat(fingerprints.where(F.col("confidence") >= cfg.min_confidence), "src_ip"))
    return P.compared(left, right, take, schema, cfg, broadcast=fits(right))


def score_candidates(fingerprints: DataFrame, campaigns: DataFrame, cfg: Config = DEFAULT, profiles: DataFrame | None = None, columns: Sequence[str] = SCORES) -> DataFrame:
    """Every eligible fingerprint against every live campaign: src_ip, campaign_id and ``columns``, as :func:`against`."""
    kind = lambda c: "int" if c == "dimensions_used" else "double"
    schema = ", ".join(("src_ip string", "campaign_id string", *(f"{c} {kind(c)}" for c in columns)))
    return against(fingerprints, campaigns, partial(P.every, columns=tuple(columns)), schema, cfg, profiles)


def best_candidates(fingerprints: DataFrame, campaigns: DataFrame, cfg: Config = DEFAULT, profiles: DataFrame | None = None) -> DataFrame:
    """The rows of :func:`score_candidates` among which :func:`assign` finds the best of each source: one for each block of campaigns."""
    schema = "src_ip string, campaign_id string, " + ", ".join(f"{d}_similarity double" for d in DIMENSIONS) + ", score double, dimensions_used int"
    return saved(against(fingerprints, campaigns, partial(P.best, least=cfg.uncertain_threshold), schema, cfg, profiles))


def mean_similarities(fingerprints: DataFrame, campaigns: DataFrame, digits: int, cfg: Config = DEFAULT) -> DataFrame:
    """campaign_id and the mean of each similarity, halves up.

    Tasks send sums of millionths, so a mean of exactly a half is one in whatever order rows are added.
    """
    schema = "campaign_id string, " + ", ".join(f"{d}_sum long, {d}_n long" for d in DIMENSIONS)
    mean = lambda d: F.expr(f"cast(round(cast(sum({d}_sum) as decimal(22, 0)) / nullif(sum({d}_n) * 1000000, 0), {digits}) as double)")
    return against(fingerprints, campaigns, P.sums, schema, cfg).groupBy("campaign_id").agg(*(mean(d).alias(f"{d}_similarity") for d in DIMENSIONS))


def hint_counts(fingerprints: DataFrame, campaigns: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """hint, n: how many pairs of a fingerprint and a campaign have each hint."""
    return against(fingerprints, campaigns, P.hints, "hint string, n long", cfg).groupBy("hint").agg(F.sum("n").alias("n"))


def unassigned(fingerprints: DataFrame, members: DataFrame) -> DataFrame:
    """The fingerprints that are scored: of sources that are in no campaign yet."""
    return fingerprints.join(members.select(F.col("source_ip").alias("src_ip")).distinct(), "src_ip", "left_anti")


def assign(fingerprints: DataFrame, scored: DataFrame, campaigns: DataFrame, members: DataFrame, now: str, cfg: Config = DEFAULT) -> DataFrame:
    """One decision a fingerprint: src_ip, decision, campaign_id, score, threshold, is_reactivation, gap_days, event_count, explanation.

    Sparse fingerprints are skipped, members keep their campaign, of the others the best
    score of .60 or more wins, ties by the smaller id; the winner's own threshold makes it
    automatic or uncertain. Without a candidate a new campaign is due. The explanation has
    the five similarities, their total, the dimensions used, the threshold and the decision.
    """
    own = members.groupBy(F.col("source_ip").alias("src_ip")).agg(F.max_by("campaign_id", F.struct("last_active", "campaign_id")).alias("_own"))
    first = Window.partitionBy("src_ip").orderBy(F.desc("score"), "campaign_id")
    best = scored.where(F.col("score") >= cfg.uncertain_threshold).withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    at = F.lit(now).cast("timestamp_ntz")
    best = best.join(campaigns.select(F.col("id").alias("campaign_id"), "status", "last_seen"), "campaign_id")
    all_ = fingerprints.select("src_ip", "event_count", F.col("confidence").alias("_confidence")).join(own, "src_ip", "left").join(best, "src_ip", "left")
    sparse, member, matched = F.col("_confidence") < cfg.min_confidence, F.col("_own").isNotNull(), F.col("campaign_id").isNotNull()
    bar = effective_threshold(F.col("last_seen"), at, cfg)
    decision = (
        F.when(sparse, "skipped_sparse").when(member, "existing_member").when(~matched, "new_campaign")
        .when(F.col("score") >= bar, "automatic_association").otherwise("uncertain_association")
    )
    threshold = F.when(sparse, cfg.min_confidence).when(member, 0.0).when(~matched, cfg.uncertain_threshold).otherwise(bar)
    new = ~sparse & ~member & matched
    again = F.coalesce(new & (F.col("status") == "dormant"), F.lit(False))
    told = all_.withColumns({"decision": decision, "threshold": threshold, "_new": new, "is_reactivation": again})
    names = [f"{d}_similarity" for d in DIMENSIONS]
    why = F.struct(*names, F.col("score").alias("weighted_total"), "dimensions_used", F.col("threshold").alias("threshold_applied"), "decision")
    return told.select(
        "src_ip", "decision", F.when(~sparse, F.when(member, F.col("_own")).otherwise(F.col("campaign_id"))).alias("campaign_id"),
        F.when(F.col("_new"), F.col("score")).alias("score"), "threshold", "is_reactivation",
        F.when(F.col("is_reactivation"), gap_days(F.col("last_seen"), at)).alias("gap_days"), "event_count", F.when(F.col("_new"), why).alias("explanation"),
    )


_ASSOCIATED = "decision IN ('automatic_association', 'uncertain_association')"


def apply_associations(campaigns: DataFrame, decisions: DataFrame, now: str) -> DataFrame:
    """The campaigns' next snapshot: counts, last_seen, reactivation of dormant ones, and the source that represents each.

    Members that were seen again move last_seen too. The newest assignee represents its
    campaign; of several at once, the last address.
    """
    touched = decisions.where("campaign_id is not null").groupBy(F.col("campaign_id").alias("id")).agg(
        F.count_if(F.expr(_ASSOCIATED)).alias("_new"), F.max("is_reactivation").alias("_re"), F.max(F.when(F.expr(_ASSOCIATED), F.col("src_ip"))).alias("representative_ip")
    )
    at = F.lit(now).cast("timestamp_ntz")
    again = F.coalesce("_re", F.lit(False))
    old = campaigns.withColumn("_by", F.col("representative_ip") if "representative_ip" in campaigns.columns else F.lit(None).cast("string")).drop("representative_ip")
    return old.join(touched, "id", "left").select(
        "id", F.when(again, "reactivated").otherwise(F.col("status")).alias("status"),
        F.when(F.col("_new").isNotNull(), at).otherwise(F.col("last_seen")).alias("last_seen"),
        F.when(~again, F.col("dormant_since")).alias("dormant_since"),
        (F.col("reactivation_count") + again.cast("int")).alias("reactivation_count"),
        (F.col("member_ip_count") + F.coalesce("_new", F.lit(0))).alias("member_ip_count"), F.coalesce("representative_ip", "_by").alias("representative_ip"),
    )


def next_members(members: DataFrame, decisions: DataFrame, now: str) -> DataFrame:
    """The members' next snapshot: new ones with their score, and those seen again active now."""
    at = F.lit(now).cast("timestamp_ntz")
    seen = decisions.where("decision = 'existing_member'").select("campaign_id", F.col("src_ip").alias("source_ip"), F.lit(True).alias("_seen"))
    kept = members.join(seen, ["campaign_id", "source_ip"], "left").withColumn("last_active", F.when(F.col("_seen"), at).otherwise(F.col("last_active"))).drop("_seen")
    new = decisions.where(_ASSOCIATED).select("campaign_id", F.col("src_ip").alias("source_ip"), at.alias("added_at"), at.alias("last_active"), F.col("score").alias("confidence"))
    return kept.select("campaign_id", "source_ip", "added_at", "last_active", "confidence").unionByName(new)


def new_observations(decisions: DataFrame, now: str) -> DataFrame:
    """One row for each decision about a campaign; members seen again have no explanation."""
    return decisions.where("campaign_id is not null").select(
        "campaign_id", F.col("src_ip").alias("source_ip"), F.lit(now).cast("timestamp_ntz").alias("observed_at"), "event_count", "is_reactivation",
        F.col("gap_days").alias("dormancy_gap_days"), "explanation",
    )


def new_representatives(representatives: DataFrame, decisions: DataFrame, fingerprints: DataFrame) -> DataFrame:
    """campaign_id and five structs: overwritten by the newest assignee of each campaign."""
    newest = decisions.where(_ASSOCIATED).groupBy("campaign_id").agg(F.max("src_ip").alias("src_ip"))
    fresh = newest.join(fingerprints.select("src_ip", *DIMENSIONS), "src_ip").drop("src_ip")
    return representatives.select("campaign_id", *DIMENSIONS).join(newest.select("campaign_id"), "campaign_id", "left_anti").unionByName(fresh.select("campaign_id", *DIMENSIONS))


def seed_campaigns(residue: DataFrame, cfg: Config = DEFAULT, chunk: int = 2048) -> DataFrame:
    """src_ip, leader, score: unmatched fingerprints open campaigns and join earlier ones.

    In order of (first_seen, src_ip), one without an earlier leader at a score of .60 or
    more leads itself; the others join their best leader, ties by the smaller address. A
    round settles the first ``chunk`` that are left: one task finds the leaders among them,
    and those that they lead leave with them, wherever they are in the order. So sources
    meet leaders, not each other. Each round is written, so a lost executor costs a task.
    Needs columns first_seen and the five structs.
    """
    order = [F.col("first"), F.col("id")]
    base = saved(P.flat(residue, "src_ip", first=F.col("first_seen")))
    weights = [cfg.weights[d] for d in DIMENSIONS]
    leads, open_ = [], base
    while True:
        some = saved(open_.orderBy(*order).limit(chunk))
        if some.isEmpty():
            break
        fresh = saved(in_arrow(some.coalesce(1), partial(P.first_leaders, least=cfg.uncertain_threshold, weights=weights), base.schema))
        leads.append(fresh)
        rest = saved(open_.join(some.select("id"), "id", "left_anti"))
        if rest.isEmpty():
            break
        led = _meet(rest, fresh, partial(P.led, least=cfg.uncertain_threshold), "src_ip string", cfg)
        open_ = saved(rest.join(led.select(F.col("src_ip").alias("id")), "id", "left_anti"))
    if not leads:
        return base.select(F.col("id").alias("src_ip"), F.col("id").alias("leader"), F.lit(1.0).alias("score"))
    leaders = saved(reduce(DataFrame.unionByName, leads))
    followers = base.join(leaders.select("id"), "id", "left_anti")
    near = _meet(followers, leaders, partial(P.best_leader, least=cfg.uncertain_threshold), "src_ip string, leader string, score double", cfg)
    joined = near.groupBy("src_ip").agg(F.min_by(F.struct("leader", "score"), F.struct(-F.col("score"), F.col("leader"))).alias("m")).select("src_ip", "m.*")
    return leaders.select(F.col("id").alias("src_ip"), F.col("id").alias("leader"), F.lit(1.0).alias("score")).unionByName(joined)


def _meet(rows: DataFrame, leaders: DataFrame, take: Callable, schema: str, cfg: Config) -> DataFrame:
    """What ``take`` makes of rows of :func:`blocks.flat` against leaders."""
    right = P.packed(leaders, dealt=False)
    return P.compared(P.packed(rows), right, take, schema, cfg, broadcast=fits(right))


def open_campaigns(seeds: DataFrame, fingerprints: DataFrame, now: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(campaigns, members, representatives) of what :func:`seed_campaigns` found: one campaign a leader.

    Its id is a digest of the leader's address, so a run that is repeated makes the same.
    """
    at = F.lit(now).cast("timestamp_ntz")
    told = seeds.select(F.concat(F.lit("c-"), F.substring(F.sha2("leader", 256), 1, 16)).alias("campaign_id"), "src_ip", "leader", "score")
    members = told.select("campaign_id", F.col("src_ip").alias("source_ip"), at.alias("added_at"), at.alias("last_active"), F.col("score").alias("confidence"))
    first = told.where("src_ip = leader").join(fingerprints, "src_ip")
    sizes = told.groupBy("campaign_id").agg(F.count("*").alias("member_ip_count"))
    campaigns = first.join(sizes, "campaign_id").select(
        F.col("campaign_id").alias("id"), F.lit("active").alias("status"), at.alias("last_seen"), F.lit(None).cast("timestamp_ntz").alias("dormant_since"),
        F.lit(0).alias("reactivation_count"), "member_ip_count", F.col("src_ip").alias("representative_ip"),
    )
    return campaigns, members, first.select("campaign_id", *DIMENSIONS)
