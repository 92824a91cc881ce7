"""Validators as column expressions: `strict` is the scanner's rule set, `lenient` the ingest re-check."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Verhoeff multiplication and permutation tables, one row per line.
_VERHOEFF_D = [
    [0, 1, 2, 3, 4, 5, 6, 7, 8, 9],
    [1, 2, 3, 4, 0, 6, 7, 8, 9, 5],
    [2, 3, 4, 0, 1, 7, 8, 9, 5, 6],
    [3, 4, 0, 1, 2, 8, 9, 5, 6, 7],
    [4, 0, 1, 2, 3, 9, 5, 6, 7, 8],
    [5, 9, 8, 7, 6, 0, 4, 3, 2, 1],
    [6, 5, 9, 8, 7, 1, 0, 4, 3, 2],
    [7, 6, 5, 9, 8, 2, 1, 0, 4, 3],
    [8, 7, 6, 5, 9, 3, 2, 1, 0, 4],
    [9, 8, 7, 6, 5, 4, 3, 2, 1, 0],
]
_VERHOEFF_P = [
    [0, 1, 2, 3, 4, 5, 6, 7, 8, 9],
    [1, 5, 7, 6, 2, 8, 3, 0, 9, 4],
    [5, 8, 0, 3, 7, 9, 6, 1, 4, 2],
    [8, 9, 1, 6, 0, 4, 3, 5, 2, 7],
    [9, 4, 5, 3, 1, 2, 6, 8, 7, 0],
    [4, 2, 8, 6, 5, 7, 3, 9, 0, 1],
    [2, 7, 9, 3, 8, 0, 6, 4, 1, 5],
    [7, 0, 4, 6, 9, 1, 3, 2, 5, 8],
]

# PAN entity letters, test mail words, UPI handles, licence state codes.
PAN_ENTITIES = list("PCHFATBLJG")
TEST_DOMAINS = ["example.com", "test.com", "sample.com", "dummy.com", "placeholder.com"]
TEST_LOCAL_PARTS = ["test", "example", "sample", "dummy", "placeholder"]
UPI_HANDLES = [
    "okaxis", "okhdfcbank", "okicici", "oksbi", "paytm", "ybl", "ibl",
    "apl", "upi", "axl", "hdfcbank", "sbi", "icici", "kotak",
]
LICENCE_STATES = [
    "AP", "AR", "AS", "BR", "CG", "GA", "GJ", "HR", "HP", "JH", "KA", "KL",
    "MP", "MH", "MN", "ML", "MZ", "NL", "OD", "PB", "RJ", "SK", "TN", "TS",
    "TR", "UP", "UK", "WB", "AN", "CH", "DD", "DL", "JK", "LA", "LD", "PY",
]

# Types accepted on ingest.
ACCEPTED_TYPES = [
    "IN_PAN", "IN_PASSPORT", "IN_AADHAAR", "CREDIT_CARD", "IN_UPI", "IN_IFSC", "IN_BANK_ACCOUNT", "IN_PHONE",
    "EMAIL_ADDRESS", "IN_VOTER_ID", "IN_DRIVING_LICENSE", "IN_GST",
]


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _digits_of(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _table(rows: list[list[int]]) -> Column:
    return F.array(*[F.lit(d) for row in rows for d in row])


def verhoeff(digits: Column, length: int = 12) -> Column:
    """Checksum of a fixed-length digit string, unrolled: each step is two array look-ups, with no lambda."""
    d, p = _table(_VERHOEFF_D), _table(_VERHOEFF_P)
    check = F.lit(0)
    for pos in range(length):
        digit = F.substring(digits, length - pos, 1).try_cast("int")
        check = F.get(d, check * 10 + F.get(p, digit + (pos % 8) * 10))
    return check == 0


def aadhaar(c, d: Column | None = None) -> Column:
    d = _digits_of(_col(c)) if d is None else d
    return F.when((F.length(d) == 12) & (d >= "2"), F.coalesce(verhoeff(d), F.lit(False))).otherwise(False)


def pan(c) -> Column:
    c = _col(c)
    return c.rlike(r"^[A-Z]{5}[0-9]{4}[A-Z]\z") & F.substring(c, 4, 1).isin(PAN_ENTITIES)


def credit_card(c, d: Column | None = None) -> Column:
    d = _digits_of(_col(c)) if d is None else d
    return F.length(d).between(13, 19) & F.call_function("luhn_check", d)


def email(c) -> Column:
    c = _col(c)
    low = F.lower(c)
    test_domain = F.lit(False)
    for domain in TEST_DOMAINS:
        test_domain = test_domain | low.endswith("@" + domain)
    return (
        c.rlike(r"^[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}\z")
        & ~test_domain
        & ~F.substring_index(low, "@", 1).isin(TEST_LOCAL_PARTS)
    )


def phone(c) -> Column:
    return F.regexp_replace(_col(c), "[^0-9+]", "").rlike(r"^\+?(?:91)?[6-9][0-9]{9}\z")


def gst(c) -> Column:
    c = _col(c)
    return c.rlike(r"^[0-3][0-9][A-Z]{5}[0-9]{4}[A-Z][0-9A-Z]Z[0-9A-Z]\z") & F.substring(c, 1, 2).between("01", "38")


def upi(c) -> Column:
    c = _col(c)
    provider = F.lower(F.substring_index(c, "@", -1))
    known = provider.rlike("|".join(UPI_HANDLES))
    return c.rlike(r"^[a-zA-Z0-9.\-_]{3,256}@[a-zA-Z0-9.\-_]+\z") & (known | F.length(provider).between(3, 20))


def ifsc(c) -> Column:
    return _col(c).rlike(r"^[A-Z]{4}0[A-Z0-9]{6}\z")


def passport(c) -> Column:
    return _col(c).rlike(r"^[A-Z][0-9]{7}\z")


def voter_id(c) -> Column:
    return _col(c).rlike(r"^[A-Z]{3}[0-9]{7}\z")


def driving_license(c) -> Column:
    c = _col(c)
    return c.rlike(r"^[A-Z]{2}[- ]?[0-9]{2}[- ]?[0-9]{4,7}\z") & F.substring(c, 1, 2).isin(LICENCE_STATES)


def bank_account(c, d: Column | None = None) -> Column:
    d = _digits_of(_col(c)) if d is None else d
    return F.length(d).between(9, 18) & (F.replace(d, F.substring(d, 1, 1), F.lit("")) != "")


STRICT = {
    "IN_AADHAAR": aadhaar,
    "IN_PAN": pan,
    "CREDIT_CARD": credit_card,
    "EMAIL_ADDRESS": email,
    "IN_PHONE": phone,
    "IN_PASSPORT": passport,
    "IN_VOTER_ID": voter_id,
    "IN_DRIVING_LICENSE": driving_license,
    "IN_BANK_ACCOUNT": bank_account,
    "IN_IFSC": ifsc,
    "IN_GST": gst,
    "IN_UPI": upi,
}
# Strict rules that look at the digits of a value several times; they take them as a second argument.
OF_DIGITS = ("IN_AADHAAR", "CREDIT_CARD", "IN_BANK_ACCOUNT")


def lenient_pan(v: Column) -> Column:
    return F.upper(F.trim(v)).rlike(r"^[A-Z]{5}[0-9]{4}[A-Z]\z")


def lenient_email(v: Column) -> Column:
    v = F.trim(v)
    local, domain = F.regexp_extract(v, r"(?s)^(.*)@", 1), F.substring_index(v, "@", -1)
    return (
        F.contains(v, F.lit("@"))
        & F.length(local).between(1, 64)
        & (F.length(domain) >= 3)
        & F.contains(domain, F.lit("."))
        & ~domain.rlike(r"^[.-]|[.-]\z")
    )


def lenient_phone(v: Column) -> Column:
    return _digits_of(v).rlike(r"^(?:91)?[6-9][0-9]{9}\z")


def lenient_upi(v: Column) -> Column:
    return F.trim(v).rlike(r"^[a-zA-Z0-9._-]+@[a-zA-Z][a-zA-Z0-9]*\z")


def lenient_ifsc(v: Column) -> Column:
    return ifsc(F.upper(F.trim(v)))


def lenient_passport(v: Column) -> Column:
    return passport(F.upper(F.trim(v)))


def lenient_voter_id(v: Column) -> Column:
    return voter_id(F.upper(F.trim(v)))


def lenient_driving_license(v: Column) -> Column:
    v = F.upper(F.trim(v))
    short = F.length(F.translate(v, "- ", ""))
    return short.between(13, 16) & v.rlike(
        r"^[A-Z]{2}[ \t\n\f\r-]?[0-9]{2}[ \t\n\f\r-]?[0-9]{4}[ \t\n\f\r-]?[0-9]{7}\z"
    )


def lenient_bank_account(v: Column) -> Column:
    return F.length(_digits_of(v)).between(9, 18)


LENIENT = {
    "CREDIT_CARD": credit_card,
    "IN_AADHAAR": aadhaar,
    "IN_PAN": lenient_pan,
    "EMAIL_ADDRESS": lenient_email,
    "IN_PHONE": lenient_phone,
    "IN_UPI": lenient_upi,
    "IN_IFSC": lenient_ifsc,
    "IN_PASSPORT": lenient_passport,
    "IN_VOTER_ID": lenient_voter_id,
    "IN_DRIVING_LICENSE": lenient_driving_license,
    "IN_BANK_ACCOUNT": lenient_bank_account,
}


def validate_strict(pii_type, value, types=None, digits: Column | None = None) -> Column:
    """True or false for the twelve types with a strict rule, null for every other type.

    `types` names the types that can occur, so that the expression holds only their rules. `digits` is a column with the
    digits of the value, where the caller has computed them in a step of its own.
    """
    t, v = _col(pii_type), _col(value)
    out = F.lit(None).cast("boolean")
    for name, rule in reversed(STRICT.items()):
        if types is None or name in types:
            out = F.when(t == name, rule(v, digits) if name in OF_DIGITS else rule(v)).otherwise(out)
    return out


def digits_of_strict(pii_type, value) -> Column:
    """The digits of values whose rule needs them, null for every other type."""
    return F.when(_col(pii_type).isin(list(OF_DIGITS)), _digits_of(_col(value)))


def validate_lenient(pii_type, value) -> Column:
    """Format re-check on ingest: a blank value fails, a type without a rule passes."""
    t, v = _col(pii_type), F.trim(_col(value))
    out = F.lit(True)
    for name, rule in reversed(LENIENT.items()):
        out = F.when(t == name, rule(v)).otherwise(out)
    return F.when(v == "", False).otherwise(out)


# Words tested in order | type
_NAME_WORDS = [
    (("aadhaar", "aadhar"), "IN_AADHAAR"),
    (("pan",), "IN_PAN"),
    (("credit",), "CREDIT_CARD"),
    (("email",), "EMAIL_ADDRESS"),
    (("phone",), "IN_PHONE"),
    (("passport",), "IN_PASSPORT"),
    (("upi",), "IN_UPI"),
    (("ifsc",), "IN_IFSC"),
    (("voter",), "IN_VOTER_ID"),
    (("driving", "license", "licence"), "IN_DRIVING_LICENSE"),
    (("bank", "account"), "IN_BANK_ACCOUNT"),
]


def pattern_to_type(pattern_name) -> Column:
    """Type named by a pattern name; empty when no word fits."""
    low = F.lower(_col(pattern_name))
    out = F.lit("")
    for words, pii_type in reversed(_NAME_WORDS):
        out = F.when(low.rlike("|".join(words)), pii_type).otherwise(out)
    return out


def accepted_type(pii_type) -> Column:
    """Fixed scope, or a user type: CUSTOM_ / USR_ and a suffix without blanks."""
    t = F.upper(F.trim(_col(pii_type)))
    return t.isin(ACCEPTED_TYPES) | t.rlike(r"^(?:CUSTOM_(?!USR_\z)|USR_)[^ \t\n]+\z")
