"""Normalization, hashing and character statistics of values and paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[ \t\n\x0B\f\r\u0085 ]"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, use) -> Column:
    """use(value), where value is computed once however often use names it, inside other lambdas too."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def norm_dedup(c) -> Column:
    """White space, `-`, `_` and `.` dropped, lower case."""
    return F.lower(F.regexp_replace(_col(c), r"[ \t\n\x0B\f\r\u0085 \-_.]", ""))


def norm_space(c) -> Column:
    return F.regexp_replace(F.regexp_replace(_col(c), SPACE + "+", " "), r"^ | \z", "")


def digits(c) -> Column:
    return F.regexp_replace(_col(c), r"[^0-9]", "")


def norm_email(c) -> Column:
    """Dots leave the local part when there is exactly one `@`; lower case."""
    c = _col(c)
    parts = F.split(c, "@")
    joined = F.concat(F.replace(F.get(parts, F.lit(0)), F.lit("."), F.lit("")), F.lit("@"), F.get(parts, F.lit(1)))
    return F.lower(F.when(F.size(parts) == 2, joined).otherwise(c))


def value_hash(c) -> Column:
    return F.sha2(_col(c), 256)


def finding_key(c) -> Column:
    """Key of a value within a scan: lower case, no blank or `-`, hashed."""
    return F.sha2(F.lower(F.translate(_col(c), " -", "")), 256)


def strip_nul(c) -> Column:
    return F.replace(_col(c), F.lit("\x00"), F.lit(""))


def norm_severity(c) -> Column:
    c = _col(c)
    low = F.lower(F.trim(c))
    return (
        F.when(low.isin("highest", "critical"), "Critical")
        .when(low == "high", "High")
        .when(low.isin("medium", "moderate"), "Medium")
        .when(low == "low", "Low")
        .otherwise(c)
    )


def shannon_entropy(c) -> Column:
    """Bits per character over the character length (equal to the byte length for ASCII values).

    The characters are sorted, so that each run is one character and its length the count; entropy is then
    log2(n) - sum(count * log2(count)) / n, rounded so that a value of exactly 3 bits is not nudged above it.
    """
    c = _col(c)
    n = F.length(c).cast("double")
    runs = F.regexp_extract_all(F.array_join(F.sort_array(F.split(c, "")), ""), F.lit(r"(?s)(.)\1*"), F.lit(0))
    counted = F.aggregate(runs, F.lit(0.0), lambda acc, r: acc + F.length(r) * F.log2(F.length(r).cast("double")))
    return F.when(n == 0, 0.0).otherwise(F.abs(F.round(F.log2(n) - counted / n, 12)))


def charset_diversity(c) -> Column:
    """Quarter per class present: lower, upper, digit, anything else."""
    c = _col(c)
    classes = ["[a-z]", "[A-Z]", "[0-9]", "[^a-zA-Z0-9]"]
    return sum((c.rlike(k).cast("int") for k in classes), F.lit(0)) / F.lit(4.0)


def token_shape(c) -> Column:
    """`l`, `L` and `d` per character, other characters kept, cut at 50 with dots."""
    c = _col(c)
    shape = F.translate(
        F.substring(c, 1, 50),
        "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789",
        "l" * 26 + "L" * 26 + "d" * 10,
    )
    return F.when(F.length(c) > 50, F.concat(shape, F.lit("..."))).otherwise(shape)


def has_word(c, words) -> Column:
    """True where one of the words occurs with no ASCII letter next to it."""
    return _col(c).rlike(r"(?<![a-zA-Z])(?:" + "|".join(words) + r")(?![a-zA-Z])")


def file_name(path) -> Column:
    return F.substring_index(_col(path), "/", -1)


def stable_id(data_source, host, path) -> Column:
    """Asset key: databases by source, host and path, everything else by path; case does not count."""
    source = _col(data_source)
    locator = F.when(
        source.isin("postgresql", "mysql"), F.concat(source, F.lit("::"), _col(host), F.lit("::"), _col(path))
    ).otherwise(_col(path))
    return F.sha2(F.lower(locator), 256)


def clean_host(host) -> Column:
    """`host:port` out of a key=value connection string, anything else unchanged."""
    host = _col(host)
    name = F.regexp_extract(host, r"host=([^ \t\n\f\r]+)", 1)
    port = F.regexp_extract(host, r"port=([0-9]+)", 1)
    return F.when(name == "", host).when(port == "", name).otherwise(F.concat(name, F.lit(":"), port))


def display_name(data_source, host) -> Column:
    """Readable asset name: database with its name, document store without the shard part."""
    source, raw = _col(data_source), _col(host)
    shown = clean_host(raw)
    db = F.regexp_extract(raw, r"dbname=([^ \t\n\f\r]+)", 1)
    return (
        F.when(source.isin("postgresql", "mysql") & (db != ""), F.concat(shown, F.lit("/"), db))
        .when((source == "mongodb") & F.contains(shown, F.lit(".")), F.regexp_replace(shown, r"^[^.]*\.", ""))
        .otherwise(shown)
    )


def table_of(path) -> Column:
    """Last but one dotted part of a path, or the whole path."""
    path = _col(path)
    parts = F.split(path, r"\.")
    return F.when(F.size(parts) >= 2, F.get(parts, F.size(parts) - 2)).otherwise(path)


def excerpt(value, match, width: int = 50) -> Column:
    """The first occurrence with `width` characters on each side; the first 200 characters if it is absent."""
    value, match = _col(value), _col(match)
    at = F.instr(value, match)
    start = F.greatest(at - width, F.lit(1))
    stop = at + F.length(match) + width
    return F.when(at > 0, F.substring(value, start, stop - start)).otherwise(F.substring(value, 1, 200))


def redact(context, value) -> Column:
    return F.replace(_col(context), _col(value), F.lit("[REDACTED]"))
