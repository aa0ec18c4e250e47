"""Similarities between two fingerprints as column expressions; ``a`` and ``b`` name structs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trapline.config import DEFAULT, DIMENSIONS, Config
from trapline.functions.normalize import EVENT_TYPES


def stat_sim(a: Column, b: Column) -> Column:
    return 1 - F.abs(a - b) / (F.greatest(a, b) + 1)


def cv_sim(a: Column, b: Column) -> Column:
    return 1 - F.least(F.abs(a - b), F.lit(1.0))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays read as sets; 1 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def jsd(p: Column, q: Column) -> Column:
    """Jensen-Shannon divergence to base 2; 1 for empty histograms or different lengths."""
    half = lambda x, y: F.when((x > 0), x * F.log2(x / ((x + y) / 2))).otherwise(0.0)
    total = F.aggregate(F.zip_with(p, q, lambda x, y: (half(x, y) + half(y, x)) / 2), F.lit(0.0), lambda s, x: s + x)
    return F.when((F.size(p) != F.size(q)) | (F.size(p) == 0), 1.0).otherwise(total)


def histogram_sim(p: Column, q: Column) -> Column:
    return F.when(F.size(p) == F.size(q), 1 - jsd(p, q))


def _wide(n: Column) -> Column:
    """The character with code point 0x20000 + n, from its UTF-8 bytes; n is below 131,072."""
    six = lambda k: F.shiftright(n, k).bitwiseAND(F.lit(63))
    utf8 = F.lit(0xF0A08080) + F.shiftleft(six(12).cast("long"), 16) + F.shiftleft(six(6).cast("long"), 8) + six(0)
    return F.decode(F.unhex(F.hex(utf8)), "UTF-8")


def edit_sim(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length of two arrays; 1 if both are empty.

    Each element becomes the character of its place in the pair's own dictionary, so the
    built-in distance does the work. The first 200 are Latin characters, as ``char`` knows
    256 only; the others stand from 0x20000 on.
    """
    longest = F.greatest(F.size(a), F.size(b))

    def distance(symbols: Column) -> Column:
        word = lambda x: F.array_join(F.transform(F.transform(x, lambda e: F.array_position(symbols, e).cast("int")), lambda n: F.when(n <= 200, F.char(n + 32)).otherwise(_wide(n))), "")
        return F.levenshtein(word(a), word(b))

    # the lambda has the dictionary made once
    edits = F.get(F.transform(F.array(F.array_distinct(F.concat(a, b))), distance), F.lit(0))
    return F.when((longest == 0) | (a == b), 1.0).otherwise(1 - edits / longest)


def _string(codes: Column) -> Column:
    """Characters joined; null if one of them is."""
    return F.when(~F.exists(codes, lambda c: c.isNull()), F.array_join(codes, ""))


def known_symbols(words: Column, vocabulary: list[str]) -> Column:
    """One character for each element, its place in ``vocabulary``; null if an element is not in it."""
    places = F.create_map(*(x for k, w in enumerate(vocabulary) for x in (F.lit(w), F.lit(chr(33 + k)))))
    return _string(F.transform(words, lambda w: F.try_element_at(places, w)))


def port_symbols(ports: Column) -> Column:
    """One character for each port: code points from 0x20000 on."""
    return _string(F.transform(ports, lambda p: F.when(p.between(0, 65535), _wide(p))))


#: Types of events, and classes of user names and passwords as the features join them.
TYPE_NAMES = [t[0] for t in EVENT_TYPES]
PATTERNS = [f"{u}/{p}" for u in ("empty", "email", "numeric", "alpha", "alphanum", "special") for p in ("empty", "numeric", "alpha", "alphanum", "special")]


def coded(fingerprints: DataFrame) -> DataFrame:
    """Fingerprints whose sequences also stand as strings, made once so that a pair only needs their distance."""
    seq, cred, target = F.col("sequence"), F.col("credential"), F.col("target")
    patterns = lambda s: known_symbols(F.coalesce(s["credential_sequence"], F.array().cast("array<string>")), PATTERNS)
    return fingerprints.withColumns(
        {
            "sequence": seq.withField("ports", port_symbols(seq["port_sequence"])).withField("types", known_symbols(seq["event_type_sequence"], TYPE_NAMES)).withField("patterns", patterns(seq)),
            "credential": cred.withField("patterns", patterns(cred)),
            "target": target.withField("ports", port_symbols(target["top_dst_ports"])),
        }
    )


def coded_sim(a: Column, b: Column, elements: str, code: str) -> Column:
    """:func:`edit_sim` of the arrays ``elements`` of two coded structs, from their strings where both have one."""
    x, y = a[code], b[code]
    longest = F.greatest(F.char_length(x), F.char_length(y))
    quick = F.when(x.isNotNull() & y.isNotNull(), F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(x, y) / longest))
    none = F.array().cast("array<string>")
    return F.coalesce(quick, edit_sim(F.coalesce(a[elements].cast("array<string>"), none), F.coalesce(b[elements].cast("array<string>"), none)))


def round6(x: Column) -> Column:
    """To 6 digits; the small addend settles ties alike however the sum was formed."""
    return F.round(x + 1e-9, 6)


def exact_mean(x: Column, digits: int) -> Column:
    """Aggregate: the mean of scores of 6 digits, halves up.

    The sum is one of decimals, so a mean of exactly a half is one in whatever order rows are added.
    """
    return F.round(F.sum(F.round(x, 6).cast("decimal(18,6)")) / F.count(x), digits).cast("double")


def mean_of(*scores: Column) -> Column:
    """The mean of the scores that are not null, to 6 digits; 0 if all are.

    A fold over their array, so that each is worked out once.
    """
    start = F.struct(F.lit(0.0).alias("total"), F.lit(0).alias("n"))
    add = lambda s, x: F.struct((s["total"] + F.coalesce(x, F.lit(0.0))).alias("total"), (s["n"] + F.when(x.isNotNull(), 1).otherwise(0)).alias("n"))
    return F.aggregate(F.array(*scores), start, add, lambda s: F.when(s["n"] == 0, 0.0).otherwise(round6(s["total"] / s["n"])))


def _both(a: Column, b: Column, score: Column) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), score)


def _any(x: Column, y: Column, score: Column) -> Column:
    """A score that counts unless both sides are empty."""
    return F.when((F.size(x) > 0) | (F.size(y) > 0), score)


def timing_similarity(a: Column, b: Column) -> Column:
    stats = [stat_sim(a[f"interval_{k}"], b[f"interval_{k}"]) for k in ("mean", "stddev", "p25", "p75", "p95")]
    parts = [sum(stats[1:], stats[0]) / 5, histogram_sim(a["tod_histogram"], b["tod_histogram"]), histogram_sim(a["dow_histogram"], b["dow_histogram"]), cv_sim(a["burst_cv"], b["burst_cv"])]
    return _both(a, b, mean_of(*parts))


def sequence_similarity(a: Column, b: Column) -> Column:
    names = (("port_sequence", "ports"), ("event_type_sequence", "types"), ("credential_sequence", "patterns"))
    return _both(a, b, mean_of(*(_any(a[c], b[c], coded_sim(a, b, c, code)) for c, code in names)))


def _values(x: Column) -> Column:
    return F.transform(x, lambda e: e["value"])


def protocol_similarity(a: Column, b: Column) -> Column:
    """Services as sets, and the order of key exchanges and of ciphers where both sides have them."""
    x, y = _values(a["service_distribution"]), _values(b["service_distribution"])
    orders = [_both(a[c], b[c], edit_sim(a[c], b[c])) for c in ("ssh_kex", "tls_ciphers")]
    return _both(a, b, mean_of(_any(x, y, jaccard(x, y)), *orders))


def credential_similarity(a: Column, b: Column) -> Column:
    x, y = _values(a["username_class_dist"]), _values(b["username_class_dist"])
    ratios = [stat_sim(a[c], b[c]) for c in ("has_upper_ratio", "has_lower_ratio", "has_digit_ratio", "has_special_ratio")]
    none = F.array().cast("array<string>")
    p, q = F.coalesce(a["credential_sequence"], none), F.coalesce(b["credential_sequence"], none)
    return _both(a, b, mean_of(_any(x, y, jaccard(x, y)), sum(ratios[1:], ratios[0]) / 4, _any(p, q, coded_sim(a, b, "credential_sequence", "patterns"))))


def target_similarity(a: Column, b: Column) -> Column:
    x, y = a["top_dst_ports"], b["top_dst_ports"]
    top = lambda p: F.slice(p, 1, 10)
    return _both(a, b, mean_of(_any(x, y, jaccard(top(x), top(y))), _any(x, y, coded_sim(a, b, "top_dst_ports", "ports"))))


SIMILARITIES = {
    "timing": timing_similarity, "sequence": sequence_similarity, "protocol": protocol_similarity,
    "credential": credential_similarity, "target": target_similarity,
}


def weighted(scores: dict[str, Column], cfg: Config = DEFAULT, weights: dict[str, Column] | None = None) -> tuple[Column, Column]:
    """(weighted total to 6 digits, dimensions used); null dimensions count nowhere."""
    w = weights or {d: F.lit(cfg.weights[d]) for d in DIMENSIONS}
    top = sum((F.coalesce(w[d] * scores[d], F.lit(0.0)) for d in DIMENSIONS), F.lit(0.0))
    bottom = sum((F.when(scores[d].isNotNull(), w[d]).otherwise(0.0) for d in DIMENSIONS), F.lit(0.0))
    used = sum((F.when(scores[d].isNotNull(), 1).otherwise(0) for d in DIMENSIONS), F.lit(0))
    return F.when(bottom > 0, round6(top / bottom)).otherwise(0.0), used


def relationship_hint(timing: Column, sequence: Column, protocol: Column) -> Column:
    t, s, p = (F.coalesce(c, F.lit(0.0)) for c in (timing, sequence, protocol))
    return (
        F.when((s >= 0.85) & (t >= 0.80), "primary_campaign")
        .when((t >= 0.80) & (s < 0.70), "infrastructure_reuse")
        .when(p >= 0.80, "tactic_match")
        .otherwise("temporal_overlap")
    )
