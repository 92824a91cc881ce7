"""Similarity of values and paths for false-positive learning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Threshold and weights.
MIN_SIMILARITY, PATH_WEIGHT, VALUE_WEIGHT = 0.85, 0.3, 0.7
SAME_FIELD, SAME_PATTERN = 0.9, 0.95


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def similarity(a, b) -> Column:
    """1 - edit distance / longer length, case folded."""
    a, b = _col(a), _col(b)
    longest = F.greatest(F.length(a), F.length(b))
    return F.when((a == b) | (longest == 0), 1.0).otherwise(1.0 - F.levenshtein(F.lower(a), F.lower(b)) / longest)


def value_pattern(value, pii_type) -> Column:
    """Generalized form of a value: mail ending, digit count, last digits, type letter or character counts."""
    v, t = F.trim(_col(value)), F.lower(_col(pii_type))
    digits = F.regexp_replace(v, "[^0-9]", "")
    at = F.split(v, "@")
    domain = F.get(at, F.lit(1))
    mail = F.when((F.size(at) == 2) & F.contains(domain, F.lit(".")),
                  F.concat(F.lit("email:*@*."), F.substring_index(domain, ".", -1))).otherwise("email:invalid")
    phone = F.concat(F.lit("phone:"), F.length(digits).cast("string"), F.lit("digits"))
    aadhaar = F.when(F.length(digits) == 12, F.concat(F.lit("aadhaar:****-****-"), F.right(digits, F.lit(4)))
                     ).otherwise("aadhaar:invalid")
    pan = F.when(F.length(v) == 10, F.concat(F.lit("pan:"), F.upper(F.substring(v, 4, 1)), F.lit("-type"))
                 ).otherwise("pan:invalid")
    letters = F.length(F.regexp_replace(v, r"[^\p{L}]", ""))
    numbers = F.length(F.regexp_replace(v, r"[^\p{Nd}]", ""))
    others = F.length(F.regexp_replace(v, r"[\p{L}\p{Nd}\s]", ""))

    def last(n, kind):
        return F.concat((n % 10).cast("string"), F.lit(kind))

    generic = F.concat(F.lit("generic:"), F.concat_ws("-", last(letters, "a"), last(numbers, "d"), last(others, "s")))
    return (
        F.when(t.isin("email", "email_address"), mail).when(t.isin("phone", "phone_number"), phone)
        .when(t == "aadhaar", aadhaar).when(t == "pan", pan).otherwise(generic)
    )


def normal_path(path) -> Column:
    return F.lower(F.regexp_replace(_col(path), r"\[[0-9]+\]", "[]"))


def path_similarity(a, b) -> Column:
    """1 for equal paths, 0.9 for the same last part, else edit similarity."""
    a, b = normal_path(a), normal_path(b)
    return (
        F.when(a == b, 1.0)
        .when(F.substring_index(a, ".", -1) == F.substring_index(b, ".", -1), SAME_FIELD)
        .otherwise(similarity(a, b))
    )


def overall(path_a, path_b, value_a, value_b) -> Column:
    return path_similarity(path_a, path_b) * PATH_WEIGHT + similarity(value_a, value_b) * VALUE_WEIGHT
