"""Enrichment, classification and risk scores as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from datavigil.functions import text as T

# Words of enrichment.
HIGH_RISK_WORDS = [
    "user", "users", "customer", "customers",
    "auth", "authentication", "login", "password",
    "billing", "payment", "credit", "card",
    "personal", "private", "sensitive", "confidential",
    "prod", "production", "live",
]
LOW_RISK_WORDS = [
    "test", "tests", "testing", "spec", "specs",
    "mock", "mocks", "fixture", "fixtures",
    "example", "examples", "sample", "demo",
    "tmp", "temp", "cache",
]

# Environment | path words, in the order they are tested | score of the environment.
ENVIRONMENTS = [
    ("production", ["prod", "production", "live"], 1.0),
    ("staging", ["staging", "stage"], 0.7),
    ("development", ["dev", "development"], 0.3),
    ("test", ["test", "testing"], 0.1),
]
UNKNOWN_ENVIRONMENT_SCORE = 0.5

# Weights and thresholds.
WEIGHT_RULES, WEIGHT_CONTEXT, WEIGHT_ENTROPY = 0.40, 0.30, 0.10
TIERS = [(0.85, "CONFIRMED"), (0.65, "HIGH_CONFIDENCE"), (0.45, "VALIDATED")]
MIN_CLASSIFIED = 0.45

# Rule signal. Pattern words | column words | score | explanation
RULES = [
    (["aws_key", "aws_secret", "api_key", "auth_token", "private_key", "secret_key", "password", "aws access key",
      "access key"],
     ["password", "secret", "apikey", "token"], 0.95, "Strong pattern match for credentials/secrets"),
    (["email", "e-mail", "mail"], ["email", "e-mail"], 0.95, "Email address pattern detected"),
    (["pan", "pancard", "permanent_account_number"], ["pan", "pancard"], 0.99, "PAN Card pattern detected"),
    (["aadhaar", "uidai", "adhaar", "aadhar"], [], 0.99, "Aadhaar pattern detected"),
    (["phone", "mobile", "cellphone"], ["phone", "mobile"], 0.90, "Phone number pattern detected"),
    (["credit_card", "debit_card", "cvv", "card_number", "credit card", "card"], [], 0.95,
     "Financial data pattern detected"),
]
NO_RULE = (0.30, "No strong PII pattern matched")
RISKY_PATH = ["user", "users", "customer", "customers", "billing", "auth", "login", "account"]
TEST_PATH = ["test", "tests", "fixture", "mock", "example", "spec"]
SECRET_WORDS = ["aws_key", "api_key", "auth_token", "private_key", "secret_key", "password", "token", "access_key"]

# Class named by the words of a pattern name, in the order they are tested.
CLASS_WORDS = [
    (["aadhaar", "aadhar", "pan", "pancard", "passport", "ssn", "social_security"], "Sensitive Personal Data"),
    (["credit_card", "card", "debit_card"], "Sensitive Personal Data"),
    (["email", "e-mail", "mail"], "Personal Data"),
    (["phone", "mobile", "cellphone"], "Personal Data"),
    (["gst", "gstin", "tax_id", "vat"], "Sensitive Personal Data"),
    (["aws_key", "api_key", "auth_token", "private_key", "secret_key", "password", "token"], "Secrets"),
]
SUB_CATEGORIES = {
    "Secrets": "API Keys & Secrets",
    "Sensitive Personal Data": "Government ID / Financial Data",
    "Personal Data": "Contact Information",
}

# Single-pass rules. Pattern words | column words | class | sub-category | score | consent | text
SIMPLE_RULES = [
    (["aws_key", "aws_secret", "api_key", "auth_token", "private_key", "secret_key", "password"],
     ["password", "secret", "apikey", "token"], "Secrets", "API Keys & Secrets", 0.95, False,
     "Strong pattern match for credentials"),
    (["email", "e-mail", "mail"], ["email", "e-mail"], "Personal Data", "Email Address", 0.95, True,
     "Pattern/Column indicates Email Address"),
    (["pan", "pancard", "permanent_account_number"], ["pan", "pancard"], "Sensitive Personal Data", "Government ID",
     0.99, True, "Pattern/Column indicates PAN Card"),
    (["aadhaar", "uidai", "adhaar"], [], "Sensitive Personal Data", "Government ID", 0.99, False,
     "Pattern indicates Aadhaar"),
    (["phone", "mobile", "cellphone"], ["phone", "mobile"], "Personal Data", "Phone Number", 0.90, True,
     "Pattern/Column indicates Phone Number"),
    (["credit_card", "debit_card", "cvv", "card_number"], [], "Sensitive Personal Data", "Financial Data", 0.95, True,
     "Pattern indicates Financial Data"),
]

# Type | class | regulation category | consent | severity. Consent also sets the retention period.
TYPE_MAP = [
    ("IN_AADHAAR", "Sensitive Personal Data", "Sensitive Personal Data", True, "Critical"),
    ("IN_PAN", "Sensitive Personal Data", "Financial Identifier", True, "Critical"),
    ("IN_PASSPORT", "Sensitive Personal Data", "Government Identifier", True, "Critical"),
    ("CREDIT_CARD", "Financial Data", "Financial Data", True, "Critical"),
    ("IN_UPI", "Financial Data", "Financial Identifier", False, "High"),
    ("IN_IFSC", "Financial Data", "Financial Identifier", False, "High"),
    ("IN_BANK_ACCOUNT", "Financial Data", "Financial Data", False, "High"),
    ("IN_PHONE", "Personal Data", "Contact Information", False, "High"),
    ("EMAIL_ADDRESS", "Personal Data", "Contact Information", False, "High"),
    ("IN_VOTER_ID", "Government Identifier", "Government Identifier", False, "High"),
    ("IN_DRIVING_LICENSE", "Government Identifier", "Government Identifier", True, "High"),
]
TYPE_DEFAULT = ("Personal Data", "General Personal Data", False, "High")
RETENTION = {True: "7 years (financial/tax compliance)", False: "3 years (general data retention)"}

# Confidence given to old rows by pattern words, in the order they are tested.
BACKFILL = [
    (["aadhaar", "aadhar", "pan", "passport", "ssn", "social_security"], 0.99),
    (["credit_card", "debit_card", "card_number", "cvv"], 0.95),
    (["email", "e-mail"], 0.95),
    (["phone", "mobile", "cellphone"], 0.90),
    (["gst", "gstin", "tax_id", "vat"], 0.88),
    (["aws_key", "api_key", "secret", "password", "token"], 0.93),
]
BACKFILL_DEFAULT = 0.75

# Path parts and endings of test files, and texts of test data.
TEST_FOLDERS = ["test", "tests", "mock", "mocks", "fixture", "fixtures", "spec", "specs"]
TEST_ENDINGS = ["_test.go", ".test.ts", ".spec.ts", ".test.js", ".spec.js", ".mock.json", ".test.json"]
TEST_TEXTS = ["john doe", "example", "test@"]


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _first_match(branches, default) -> Column:
    out = default
    for condition, value in reversed(branches):
        out = F.when(condition, value).otherwise(out)
    return out


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


# --- enrichment -----------------------------------------------------------------------------------------------------

def asset_semantics(path, column) -> Column:
    """+0.15 per high-risk word and -0.25 per low-risk word in path and column, within 0 to 1."""
    place = F.lower(F.concat_ws(" ", _col(path), _col(column)))

    def points(words: Column) -> Column:
        high, low = (F.size(F.array_intersect(words, F.array(*map(F.lit, names)))) for names in (HIGH_RISK_WORDS, LOW_RISK_WORDS))
        return clamp((high * 15 - low * 25) / F.lit(100.0))

    # the words are whole runs of letters, so the runs are found once and not each word by itself
    return T.let(F.split(place, "[^a-zA-Z]+"), points)


def environment(path) -> Column:
    low = F.lower(_col(path))
    return _first_match([(T.has_word(low, words), F.lit(name)) for name, words, _ in ENVIRONMENTS], F.lit("unknown"))


def environment_score(env) -> Column:
    env = _col(env)
    return _first_match([(env == n, F.lit(s)) for n, _, s in ENVIRONMENTS], F.lit(UNKNOWN_ENVIRONMENT_SCORE))


def enrichment_score(semantics, env, entropy, diversity) -> Column:
    return clamp(_col(semantics) * 0.4 + environment_score(env) * 0.3
                 + F.least(_col(entropy) / 5.0, F.lit(1.0)) * 0.2 + _col(diversity) * 0.1)


def is_test_path(path) -> Column:
    low = F.lower(_col(path))
    endings = "|".join(e.replace(".", r"\.") for e in TEST_ENDINGS)
    return low.rlike("/(?:" + "|".join(TEST_FOLDERS) + ")/") | low.rlike(f"(?:{endings})" + r"\z")


def is_test_text(sample) -> Column:
    sample = _col(sample)
    return F.lower(sample).rlike("|".join(TEST_TEXTS)) | F.contains(sample, F.lit("1234567890"))


def is_production(metadata) -> Column:
    """False when the environment or database of the metadata map names a test system; unknown counts as production."""
    metadata = _col(metadata)
    env, db = F.lower(metadata["environment"]), F.lower(metadata["database"])
    return ~(F.coalesce(env.rlike("test|dev|staging|qa|sandbox"), F.lit(False))
             | F.coalesce(db.rlike("test|dev"), F.lit(False)))


def pattern_category(name) -> Column:
    low = F.lower(_col(name))
    return (
        F.when(low.rlike("email|phone|ssn|passport|license|aadhaar|aadhar|pan"), "pii")
        .when(low.rlike("key|token|secret|password|api|aws"), "secret")
        .when(low.rlike("credit|card|account|bank"), "financial")
        .otherwise("other")
    )


# --- classification -------------------------------------------------------------------------------------------------

def _rule_hits(pattern, column, rules):
    low_p, low_c = F.lower(_col(pattern)), F.lower(F.coalesce(_col(column), F.lit("")))
    return [T.has_word(low_p, r[0]) | (T.has_word(low_c, r[1]) if r[1] else F.lit(False)) for r in rules]


def rule_signal(pattern, path, column) -> Column:
    """Score of the first rule that fits, x 1.05 on a risky path, x 0.8 on a test path, at most 1."""
    low = F.lower(_col(path))
    hits = _rule_hits(pattern, column, RULES)
    base = _first_match([(h, F.lit(r[2])) for h, r in zip(hits, RULES)], F.lit(NO_RULE[0]))
    boosted = base * F.when(T.has_word(low, RISKY_PATH), 1.05).otherwise(1.0)
    return F.least(boosted * F.when(T.has_word(low, TEST_PATH), 0.8).otherwise(1.0), F.lit(1.0))


def rule_explanation(pattern, path, column) -> Column:
    low = F.lower(_col(path))
    hits = _rule_hits(pattern, column, RULES)
    return F.concat(
        F.lit("Rules: "), _first_match([(h, F.lit(r[3])) for h, r in zip(hits, RULES)], F.lit(NO_RULE[1])),
        F.when(T.has_word(low, RISKY_PATH), " + high-risk path context").otherwise(""),
        F.when(T.has_word(low, TEST_PATH), " (reduced: test data)").otherwise(""))


def is_secret_pattern(pattern) -> Column:
    return F.lower(_col(pattern)).rlike("|".join(SECRET_WORDS))


def entropy_signal(pattern, entropy, diversity) -> Column:
    raw = F.least(_col(entropy) / 5.0, F.lit(1.0)) * 0.7 + _col(diversity) * 0.3
    return F.when(is_secret_pattern(pattern), raw).otherwise(0.0)


def final_score(rule, context, entropy, pattern) -> Column:
    """Weighted mean of the signals; entropy takes part for secrets only."""
    rule, context, entropy = _col(rule), _col(context), _col(entropy)
    weighted = rule * WEIGHT_RULES + context * WEIGHT_CONTEXT
    secret = (weighted + entropy * WEIGHT_ENTROPY) / (WEIGHT_RULES + WEIGHT_CONTEXT + WEIGHT_ENTROPY)
    return clamp(F.when(is_secret_pattern(pattern), secret).otherwise(weighted / (WEIGHT_RULES + WEIGHT_CONTEXT)))


def confidence_tier(score) -> Column:
    score = _col(score)
    return _first_match([(score >= at, F.lit(name)) for at, name in TIERS], F.lit("NEEDS_REVIEW"))


def class_of_pattern(pattern) -> Column:
    low = F.lower(_col(pattern))
    return _first_match([(T.has_word(low, words), F.lit(name)) for words, name in CLASS_WORDS], F.lit("Non-PII"))


def sub_category(classification) -> Column:
    c = _col(classification)
    return _first_match([(c == k, F.lit(v)) for k, v in SUB_CATEGORIES.items()], F.lit("Other"))


def regulation_category(classification) -> Column:
    c = _col(classification)
    return F.when(c.isin("Sensitive Personal Data", "Personal Data"), c).otherwise("N/A")


def class_needs_consent(classification) -> Column:
    return _col(classification).isin("Sensitive Personal Data", "Personal Data")


def classify_simple(pattern, path, column) -> Column:
    """Single-pass classification: the first rule that fits, +0.05 on a risky path, x 0.9 on a test path."""
    low = F.lower(_col(path))
    hits = _rule_hits(pattern, column, SIMPLE_RULES)

    def pick(i, default):
        return _first_match([(h, F.lit(r[i])) for h, r in zip(hits, SIMPLE_RULES)], F.lit(default))

    risky, test = T.has_word(low, RISKY_PATH), T.has_word(low, TEST_PATH)
    score = pick(4, 0.5) + F.when(risky, 0.05).otherwise(0.0)
    category = pick(2, "Non-PII")
    return F.struct(
        category.alias("classification"), pick(3, "Other").alias("sub_category"),
        F.when(category == "Non-PII", "").when(category == "Secrets", "N/A").otherwise(category).alias("category"),
        F.least(score * F.when(test, 0.9).otherwise(1.0), F.lit(1.0)).alias("score"),
        pick(5, False).alias("requires_consent"),
        F.concat(pick(6, ""), F.when(risky, " + Found in high-risk context").otherwise(""),
                 F.when(test, " (Reduced: Test Data)").otherwise("")).alias("justification"),
        risky.alias("context_match"), test.alias("is_test_data"),
    )


# --- type maps and verified findings --------------------------------------------------------------------------------

def type_attributes(pii_type) -> Column:
    """Class, regulation category, consent, severity and retention period of a type."""
    t = _col(pii_type)

    def pick(i):
        return _first_match([(t == r[0], F.lit(r[i])) for r in TYPE_MAP], F.lit(TYPE_DEFAULT[i - 1]))

    consent = pick(3)
    return F.struct(
        pick(1).alias("classification"), pick(2).alias("category"), consent.alias("requires_consent"),
        pick(4).alias("severity"), F.when(consent, RETENTION[True]).otherwise(RETENTION[False]).alias("retention"))


def verified_score(confidence, validator_count, keyword_count) -> Column:
    """0.6 confidence (at least 0.85 once validated) + 0.25 context + 0.15."""
    confidence = _col(confidence)
    sure = F.when(_col(validator_count) > 0, F.greatest(confidence, F.lit(0.85))).otherwise(confidence)
    return sure * 0.6 + F.least(_col(keyword_count) * 0.1, F.lit(1.0)) * 0.25 + F.lit(0.15)


# --- severity and risk ----------------------------------------------------------------------------------------------

def dynamic_severity(classification, tier, production) -> Column:
    c, tier, prod = _col(classification), _col(tier), _col(production)
    sure = tier == "CONFIRMED"
    sensitive = F.when(sure & prod, "Critical").when(sure | prod, "High").otherwise("Medium")
    personal = F.when(sure & prod, "Medium").otherwise("Low")
    secret = F.when(sure & prod, "Critical").when(prod, "High").otherwise("Medium")
    return (
        F.when(c == "Sensitive Personal Data", sensitive).when(c == "Personal Data", personal)
        .when(c == "Secrets", secret).otherwise("Info")
    )


def class_weight(classification) -> Column:
    """Sensitivity of a class; "Financial Data" and "Government Identifier" count as sensitive."""
    c = _col(classification)
    return (
        F.when(c.isin("Sensitive Personal Data", "Financial Data", "Government Identifier"), 1.0)
        .when(c == "Secrets", 0.9).when(c == "Personal Data", 0.5).otherwise(0.1)
    )


def risk_score(classification, confidence, density, access) -> Column:
    """0.4 class + 0.2 confidence + 0.2 density + 0.2 access, in points of 100."""
    raw = (class_weight(classification) * 0.40 + clamp(_col(confidence)) * 0.20 + clamp(_col(density)) * 0.20
           + clamp(_col(access)) * 0.20)
    return clamp(F.floor(F.round(raw * 100, 6) + 0.5).cast("double"), 0.0, 100.0)


def risk_tier(score) -> Column:
    score = _col(score)
    return F.when(score >= 80, "Critical").when(score >= 60, "High").when(score >= 40, "Medium").otherwise("Low")


def comprehensive_risk(classification, tier, production) -> Column:
    """Class weight x 60 + confidence x 20 + context x 20, truncated."""
    tier = _col(tier)
    certainty = (F.when(tier == "CONFIRMED", 1.0).when(tier == "HIGH_CONFIDENCE", 0.75)
                 .when(tier == "VALIDATED", 0.5).otherwise(0.3))
    context = F.when(_col(production), 1.0).otherwise(0.3)
    total = class_weight(classification) * 100 * 0.6 + certainty * 100 * 0.2 + context * 100 * 0.2
    return F.least(F.greatest(F.floor(F.round(total, 6)), F.lit(0)), F.lit(100)).cast("int")


def severity_score(severity) -> Column:
    s = _col(severity)
    return (F.when(s == "Critical", 95).when(s == "High", 80).when(s == "Medium", 60).when(s == "Low", 30)
            .otherwise(10))


def severity_sensitivity(severity) -> Column:
    """Sensitivity points of the inventory; case does not count."""
    s = F.lower(_col(severity))
    return F.when(s == "critical", 100).when(s == "high", 80).when(s == "medium", 50).otherwise(20)


def severity_rank(severity) -> Column:
    s = _col(severity)
    return F.when(s.isin("Critical", "Highest"), 4).when(s == "High", 3).when(s == "Medium", 2).otherwise(1)


def severity_of_rank(rank) -> Column:
    r = _col(rank)
    return F.when(r >= 4, "Critical").when(r == 3, "High").when(r == 2, "Medium").otherwise("Low")


def backfilled_confidence(pattern) -> Column:
    low = F.lower(_col(pattern))
    return _first_match([(low.rlike("|".join(words)), F.lit(v)) for words, v in BACKFILL], F.lit(BACKFILL_DEFAULT))
