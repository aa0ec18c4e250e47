"""Column functions for text that goes to or comes from a language model, and for names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: spellings of instructions that do not belong in data
INJECTIONS = [
    r"ignore\s+(previous|prior|above|all)", r"disregard\s+(previous|prior|above|all|the\s+(above|previous|prior))", r"system\s*:",
    r"<\|", r"\|\s*>", r"prompt\s*injection", r"jailbreak", r"act\s+as\s+", r"you\s+are\s+now\s+",
    r"forget\s+(your|all|previous|everything)", r"override\s+(your|previous|prior)", r"new\s+(instructions?|rules?|directives?)",
    r"from\s+now\s+on\s+", r"\[INST\]", r"###\s*instructions?",
]
INJECTION = "(?i)(" + "|".join(INJECTIONS) + ")"
# fixed values: patterns of addresses
IPV4 = r"\b(?:\d{1,3}\.){3}\d{1,3}\b"
IPV6 = r"\b(?:[0-9a-fA-F]{1,4}:){2,7}[0-9a-fA-F]{0,4}\b|\b::(?:[0-9a-fA-F]{1,4}:){0,6}[0-9a-fA-F]{1,4}\b"
IP = f"(?:{IPV4}|{IPV6})"

# fixed values: words of campaign names
ADJECTIVES = [
    "shadow", "crimson", "silent", "amber", "frozen", "cobalt", "phantom", "scarlet", "hollow", "iron",
    "lunar", "obsidian", "silver", "dark", "hidden", "ancient", "midnight", "rapid", "steel", "veiled",
    "volatile", "carbon", "prism", "static", "titan", "nova", "void", "apex", "cipher", "delta",
]
ANIMALS = [
    "crane", "wolf", "raven", "fox", "hawk", "bear", "lynx", "viper", "eagle", "cobra", "mantis",
    "shark", "python", "falcon", "jaguar", "tiger", "osprey", "scorpion", "otter", "manta", "hornet",
    "panther", "kestrel", "beetle", "crow", "mongoose", "ferret", "wyvern", "hydra", "asp",
]


def sanitize_text(text: Column, max_len: int = 200, redacted: str = "[REDACTED]") -> Column:
    """Cut to ``max_len`` characters; all of it redacted if that reads like an instruction."""
    cut = F.substring(text, 1, max_len)
    return F.when(cut.rlike(INJECTION), redacted).otherwise(cut)


def contains_ip(text: Column) -> Column:
    return text.rlike(IP)


def redact_ips(text: Column) -> Column:
    return F.regexp_replace(text, IP, "[IP REDACTED]")


def validate_text(text: Column, max_len: int = 1000) -> Column:
    """empty_response, ip_detected, truncated or ok."""
    return (
        F.when(F.trim(F.coalesce(text, F.lit(""))) == "", "empty_response").when(contains_ip(text), "ip_detected")
        .when(F.char_length(text) > max_len, "truncated").otherwise("ok")
    )


def _mod(digits: Column, n: int) -> Column:
    """A hexadecimal number of any length modulo n."""
    each = F.transform(F.split(digits, ""), lambda c: F.instr(F.lit("0123456789abcdef"), c) - 1)
    return F.aggregate(each, F.lit(0), lambda acc, d: (acc * 16 + d) % n)


def campaign_name(campaign_id: Column) -> Column:
    """ADJECTIVE-ANIMAL-number from the SHA-256 of the id."""
    h = F.sha2(campaign_id, 256)
    word = lambda words, k: F.get(F.array(*(F.lit(w.upper()) for w in words)), k)
    return F.concat_ws(
        "-", word(ADJECTIVES, _mod(h, 30)), word(ANIMALS, _mod(F.substring(h, 1, 62), 30)), (_mod(F.substring(h, 1, 60), 90) + 1).cast("string")
    )
