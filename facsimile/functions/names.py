"""Column-name rules: normalisation and the word lists that decide column roles."""

from __future__ import annotations

import re

# ---- Fixed values (must equal the published rules) -------------------------------------------
STRONG_ID_NAMES = [
    "id", "uuid", "uid", "guid", "row_id", "record_id", "identifier", "ssn", "social_security",
]
STRONG_ID_SUFFIXES = [
    r"(^|_)id$",
    r"(^|_)uuid$",
    r"(^|_)uid$",
    r"(^|_)guid$",
    r"(^|_)ssn$",
]
GUID_SUFFIX = r"(^|_)guid$"
KNOWN_ID_PATTERNS = [
    r"^(account|policy|badge|serial|license|customer|client|user|employee|student|patient|member"
    r"|order|tracking|transaction|sensor|device|card|phone|mobile|invoice|receipt|ticket|passport"
    r"|vehicle|driver)_(no|num|number|id|code|token|key)$",
    r"^(row|record|item|unit|case|sample)_(id|uuid|uid|guid|key|code)$",
]
MEASUREMENT_PATTERNS = [
    r"(^|_)(distance|weight|amount|price|cost|fee|rate|percentage|pct|ratio|score|count|total|sum"
    r"|avg|mean|median|min|max|days|hours|minutes|seconds|duration|temperature|voltage|current"
    r"|power|energy|latitude|longitude|lat|lon|measurement|sensor|reading|value|qty|quantity)($|_)",
    r"(^|_)(km|kg|liters|litres|meters|metres|miles|grams|lbs|volts|hz|celsius|fahrenheit)($|_)",
]
STRONG_TARGET_WORDS = [
    "target", "label", "outcome", "fraud", "is_fraud", "anomaly", "is_anomaly", "churn",
    "attrition", "delayed", "delay", "returned", "liked", "default", "default_status", "diagnosis",
    "placement_status", "attack_type", "survived", "converted", "readmitted", "failure",
    "risk_level", "risk",
]
MODERATE_TARGET_WORDS = [
    "status", "result", "prediction", "response", "decision", "approved", "completed",
]
FLAG_PREFIXES = [
    "is_", "has_", "requires_", "can_", "should_", "use_", "allow_", "was_", "did_",
]
SENSITIVE_WORDS = [
    "name", "email", "phone", "mobile", "address", "dob", "date_of_birth", "birth_date", "gender",
    "sex", "race", "ethnicity", "income", "salary", "credit", "account", "password", "secret",
    "token", "ssn", "social_security",
]
REDACTED_WORDS = ["encryption_key", "secret", "password", "token", "key", "auth", "raw_data"]
# ----------------------------------------------------------------------------------------------


def normalize_name(name: str) -> str:
    """Lower case, every run of other characters one underscore, none at the ends."""
    return re.sub(r"[^a-z0-9]+", "_", str(name).lower()).strip("_")


def _any_match(patterns: list[str], name: str) -> bool:
    return any(re.search(pattern, name) for pattern in patterns)


def is_strong_id_name(name: str) -> bool:
    return name in STRONG_ID_NAMES


def is_explicit_id_name(name: str) -> bool:
    return is_strong_id_name(name) or _any_match([p for p in STRONG_ID_SUFFIXES if p != GUID_SUFFIX], name)


def is_known_id_name(name: str) -> bool:
    return _any_match(KNOWN_ID_PATTERNS, name)


def is_guid_name(name: str) -> bool:
    return _any_match([GUID_SUFFIX], name)


def is_measurement_name(name: str) -> bool:
    return _any_match(MEASUREMENT_PATTERNS, name)


def _carries(words: list[str], name: str) -> bool:
    return any(name == w or name.startswith(w + "_") or name.endswith("_" + w) for w in words)


def target_strength(name: str) -> str | None:
    """``strong``, ``moderate`` or None, by outcome words in the normalised name."""
    if _carries(STRONG_TARGET_WORDS, name):
        return "strong"
    return "moderate" if _carries(MODERATE_TARGET_WORDS, name) else None


def has_flag_prefix(name: str) -> bool:
    return name.startswith(tuple(FLAG_PREFIXES))


def is_sensitive_name(name: str) -> bool:
    return any(word in name for word in SENSITIVE_WORDS)


def is_redacted_name(name: str) -> bool:
    return any(word in name.lower() for word in REDACTED_WORDS)
