"""Masks, tokens and text scrubbing as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from datavigil.functions.text import SPACE, let

# Scrubbing patterns in the order they are applied | replacement. Switch names are the keys of `scrub`.
SCRUB_RULES = [
    ("email", r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}", "[EMAIL_REDACTED]"),
    ("phone", r"(?:\+?[91][-\s]?)?[6-9][0-9]{9}", "[PHONE_REDACTED]"),
    ("aadhaar", r"[2-9]{1}[0-9]{3}[0-9]{4}[0-9]{4}", "[AADHAAR_REDACTED]"),
    ("pan", r"[A-Z]{5}[0-9]{4}[A-Z]", "[PAN_REDACTED]"),
    ("credit_card", r"[0-9]{4}[-\s]?[0-9]{4}[-\s]?[0-9]{4}[-\s]?[0-9]{4}", "[CREDIT_CARD_REDACTED]"),
    ("upi", r"[a-zA-Z0-9._-]+@[a-zA-Z0-9._-]+", "[UPI_REDACTED]"),
    ("ifsc", r"[A-Z]{4}0[A-Z0-9]{6}", "[IFSC_REDACTED]"),
    ("ip", r"(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)",
     "[IP_REDACTED]"),
    ("passwords",
     r"""(?i)(password|passwd|pwd|secret|token|apikey|api_key|access_key|accesskey)["']?\s*[:=]\s*["']?([^\s"'\}]+)""",
     "$1: [REDACTED]"),
]

# Keys whose values are dropped from JSON, the depth and size limits and the texts that stand for them.
SENSITIVE_KEYS = [
    "password", "token", "secret", "key",
    "credential", "api_key", "aadhaar", "pan",
    "normalized_match", "authorization", "jwt",
    "refresh_token", "access_token", "encryption_key",
]
JSON_INVALID = "[invalid json]"

# The local part of an address is entered once per run, as in the detection patterns.
_LINEAR = {
    "email": r"(?:\G|(?<![a-zA-Z0-9._%+-]))[a-zA-Z0-9._%+-]++@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}",
    "upi": r"(?:\G|(?<![a-zA-Z0-9._-]))[a-zA-Z0-9._-]++@[a-zA-Z0-9._-]+",
}


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _stars(n) -> Column:
    return F.repeat(F.lit("*"), F.greatest(n, F.lit(0)))


def keep_last(c, n: int = 4) -> Column:
    """All but the last `n` characters starred; a value of at most `n` is starred whole."""
    c = _col(c)
    return F.when(F.length(c) <= n, _stars(F.length(c))).otherwise(
        F.concat(_stars(F.length(c) - n), F.right(c, F.lit(n))))


def token(c) -> Column:
    return F.concat(F.lit("TOKEN_"), F.upper(F.substring(F.sha2(_col(c), 256), 1, 16)))


def partial(c, pii_type) -> Column:
    """First and last characters kept by type; at most four characters are redacted whole."""
    c, t = _col(c), F.upper(_col(pii_type))
    clean = F.translate(c, " -", "")
    n = F.length(clean)
    last4 = F.right(clean, F.lit(4))
    parts = F.split(c, "@")
    local = F.get(parts, F.lit(0))
    pan = F.when(n >= 10, F.concat(F.left(clean, F.lit(3)), F.lit("****"), last4)).otherwise(
        F.concat(F.left(clean, F.lit(2)), F.lit("****"), F.right(clean, F.lit(2))))
    mail = F.when((F.size(parts) == 2) & (F.length(local) > 2),
                  F.concat(F.left(local, F.lit(2)), F.lit("****@"), F.get(parts, F.lit(1)))).otherwise(
        F.concat(F.lit("****@"), F.substring_index(c, "@", -1)))
    plain = F.when(n > 6, F.concat(F.left(clean, F.lit(2)), F.repeat(F.lit("X"), n - 6), last4)).otherwise(
        F.concat(F.left(clean, F.lit(1)), F.repeat(F.lit("X"), n - 2), F.right(clean, F.lit(1))))
    return (
        F.when(n <= 4, "[REDACTED]")
        .when(F.contains(t, F.lit("AADHAAR")), F.concat(F.lit("XXXX-XXXX-"), last4))
        .when(F.contains(t, F.lit("PAN")), pan)
        .when(F.contains(t, F.lit("PHONE")),
              F.concat(F.when(n >= 10, "******").otherwise("****"), last4))
        .when(F.contains(t, F.lit("EMAIL")), mail)
        .otherwise(plain)
    )


def mask(c, pii_type, strategy: str = "REDACT") -> Column:
    """REDACT, PARTIAL or TOKENIZE; anything else redacts."""
    if strategy == "PARTIAL":
        return partial(c, pii_type)
    if strategy == "TOKENIZE":
        return token(c)
    return F.lit("[REDACTED]")


def mask_email(c) -> Column:
    """Two characters of the local part kept; a value without exactly one `@` is hashed."""
    c = _col(c)
    parts = F.split(c, "@")
    local = F.get(parts, F.lit(0))
    shown = F.when(F.length(local) <= 2, _stars(F.length(local))).otherwise(
        F.concat(F.left(local, F.lit(2)), _stars(F.length(local) - 2)))
    return F.when(F.size(parts) == 2, F.concat(shown, F.lit("@"), F.get(parts, F.lit(1)))).otherwise(F.sha2(c, 256))


def mask_aadhaar(c) -> Column:
    c = _col(c)
    return F.when(F.length(c) == 12, F.concat(F.lit("XXXX-XXXX-"), F.right(c, F.lit(4)))).otherwise(c)


def mask_pan(c) -> Column:
    c = _col(c)
    return F.when(F.length(c) == 10, F.upper(F.concat(F.left(c, F.lit(5)), F.lit("XXXX"), F.right(c, F.lit(1))))
                  ).otherwise(c)


def mask_credit_card(c) -> Column:
    d = F.regexp_replace(_col(c), "[^0-9]", "")
    return F.when(F.length(d) < 4, _stars(F.length(d))).otherwise(
        F.concat(F.lit("****-****-****-"), F.right(d, F.lit(4))))


def mask_ifsc(c) -> Column:
    c = _col(c)
    return F.when(F.length(c) == 11, F.concat(F.left(c, F.lit(4)), F.lit("XXXXXXX"))).otherwise(c)


def mask_ip(c) -> Column:
    c = _col(c)
    return F.when(F.size(F.split(c, r"\.")) == 4, F.concat(F.substring_index(c, ".", 3), F.lit(".*"))).otherwise(c)


def mask_name(c) -> Column:
    """First letter of every word of more than two characters; words are set one blank apart."""
    words = F.filter(F.split(_col(c), SPACE + "+"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.when(F.length(w) <= 2, w).otherwise(
        F.concat(F.left(w, F.lit(1)), _stars(F.length(w) - 1)))), " ")


def mask_birth_date(c) -> Column:
    return F.when(_col(c).isNotNull(), "****-**-**")


def mask_ssn(c) -> Column:
    c = _col(c)
    return F.when(F.length(c) == 9, F.concat(F.lit("***-**-"), F.right(c, F.lit(4)))).otherwise(c)


TYPED = {
    "EMAIL_ADDRESS": mask_email,
    "IN_PHONE": keep_last,
    "IN_AADHAAR": mask_aadhaar,
    "IN_PAN": mask_pan,
    "CREDIT_CARD": mask_credit_card,
    "IN_UPI": mask_email,
    "IN_IFSC": mask_ifsc,
    "IP_ADDRESS": mask_ip,
    "PERSON_NAME": mask_name,
    "DATE_OF_BIRTH": mask_birth_date,
    "US_SSN": mask_ssn,
    "IN_PASSPORT": keep_last,
    "IN_DRIVING_LICENSE": keep_last,
    "IN_VOTER_ID": keep_last,
    "IN_BANK_ACCOUNT": keep_last,
}


def mask_typed(c, pii_type) -> Column:
    """Mask by type; a type without its own mask keeps its last four characters."""
    c, t = _col(c), _col(pii_type)
    out = keep_last(c)
    for name, fn in TYPED.items():
        out = F.when(t == name, fn(c)).otherwise(out)
    return out


def scrub(c, off: list[str] = ()) -> Column:
    """Replace identifiers and password assignments in free text, in a fixed order; `off` switches rules off."""
    from datavigil.functions.patterns import java_regex

    out = _col(c)
    for name, regex, replacement in SCRUB_RULES:
        if name not in off:
            out = F.regexp_replace(out, _LINEAR.get(name) or java_regex(regex), replacement)
    return out


# A string of JSON, and any other run without structure in it.
_JSON_STRING = r'"(?:[^"\\]++|\\.)*+"'


def scrub_json(c) -> Column:
    """Values of sensitive keys replaced at any depth, keys in sorted order; a note for texts that are no JSON.

    The text is written anew from a variant, compact and with sorted keys. There a key stands behind "{" or "," and no string
    holds a bare quote, so keys are told by the text around them. Simple values are replaced by pattern. For objects and
    arrays the text is cut at their keys, and a count of open brackets over each piece finds where they end.
    """
    keys = "|".join(SENSITIVE_KEYS)
    plain = rf"""(?i)(?<=[{{,])("(?:{keys})":)(?:{_JSON_STRING}|[^"{{\[,}}\]]++)"""
    marked = rf"""(?i)(?<=[{{,])"(?:{keys})":(?=[{{\[])"""

    def step(state: Column, token: Column) -> Column:
        """Open brackets and characters passed until all are closed."""
        depth = state["depth"] + F.when(token.isin("{", "["), 1).when(token.isin("}", "]"), -1).otherwise(0)
        return F.when(state["depth"] == 0, state).otherwise(
            F.struct(depth.alias("depth"), (state["passed"] + F.length(token)).alias("passed")))

    def add(out: Column, part: Column) -> Column:
        # inside a value that is dropped already, the pieces that begin in it only count on
        opens = out["depth"] == 0
        piece, name = part["piece"], part["name"]

        def closed(tokens: Column) -> Column:
            first = F.when(F.size(tokens) > 0, 1).otherwise(0)
            begin = F.when(opens, F.struct(first.alias("depth"), first.alias("passed"))).otherwise(
                F.struct(out["depth"].alias("depth"), F.lit(0).alias("passed")))
            rest = F.when(opens, F.slice(tokens, 2, F.greatest(F.size(tokens) - 1, F.lit(0)))).otherwise(tokens)
            return F.aggregate(rest, begin, step)

        def kept(end: Column) -> Column:
            rest = F.when(end["depth"] == 0, F.substr(piece, end["passed"] + 1)).otherwise("")
            return F.struct(F.concat(out["text"], F.when(opens, F.concat(name, F.lit('"[REDACTED]"'))).otherwise(""), rest).alias("text"),
                            end["depth"].alias("depth"))

        tokens = F.regexp_extract_all(piece, F.lit(rf"""{_JSON_STRING}|[{{}}\[\]]|[^"{{}}\[\]]++"""), F.lit(0))
        return let(let(tokens, closed), kept)

    def without_nested(simple: Column, names: Column) -> Column:
        def joined(pieces: Column) -> Column:
            parts = F.transform(F.slice(pieces, 2, F.size(pieces)), lambda p, i: F.struct(p.alias("piece"), F.get(names, i).alias("name")))
            start = F.struct(F.get(pieces, F.lit(0)).alias("text"), F.lit(0).alias("depth"))
            return F.aggregate(parts, start, add, lambda out: out["text"])

        return F.when(F.size(names) > 0, let(F.split(simple, marked, -1), joined)).otherwise(simple)

    def scrubbed(text: Column) -> Column:
        simple = F.regexp_replace(text, plain, '$1"[REDACTED]"')
        return let(simple, lambda s: let(F.regexp_extract_all(s, F.lit(marked), F.lit(0)), lambda names: without_nested(s, names)))

    nested = let(F.to_json(F.try_parse_json(_col(c))), lambda text: F.when(text.isNull(), JSON_INVALID).otherwise(scrubbed(text)))
    return F.when(_col(c).isNull(), None).otherwise(nested)


def preview(c, pii_type) -> Column:
    """Masked text of one finding for display."""
    c, t = _col(c), _col(pii_type)
    return (
        F.when(t == "EMAIL", F.replace(c, F.lit("@"), F.lit("[AT]")))
        .when(t == "CREDIT_CARD", keep_last(c))
        .otherwise(_stars(F.length(c)))
    )


def store_mode(matches, mode: str) -> Column:
    """Stored matches: `full` as they are, `mask` as card masks, `none` as hashes."""
    matches = _col(matches)
    if mode == "mask":
        return F.transform(matches, mask_credit_card)
    if mode == "none":
        return F.transform(matches, lambda m: F.sha2(m, 256))
    return matches


def store_sample(sample, mode: str) -> Column:
    sample = _col(sample)
    if mode == "mask":
        return F.when(sample != "", "[MASKED]").otherwise(sample)
    return F.when(sample.isNotNull(), "") if mode == "none" else sample


def encrypt(c, key: str | None) -> Column:
    """AES-GCM with a random nonce, base64; a note instead of the value when there is no key."""
    if not key:
        return F.lit("[ENCRYPTION_UNAVAILABLE]")
    return F.base64(F.aes_encrypt(_col(c), F.lit(key), F.lit("GCM")))


def decrypt(c, key: str) -> Column:
    return F.aes_decrypt(F.unbase64(_col(c)), F.lit(key), F.lit("GCM")).cast("string")
