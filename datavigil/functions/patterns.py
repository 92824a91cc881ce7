"""Detection patterns and the rewriting that makes a pattern mean the same to `java.util.regex`."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Pattern:
    """One detection rule.

    `group` 0 keeps the whole match, 1 the first capture group. `base_score` is set only by recognizers.
    `context_keywords` gate a built-in and raise the score of a custom pattern.
    """

    name: str
    pii_type: str
    regex: str
    context_keywords: tuple[str, ...] = ()
    negative_keywords: tuple[str, ...] = ()
    custom: bool = False
    base_score: float | None = None
    group: int = 0
    guard: str | None = None
    fast_regex: str | None = None
    fast_group: int | None = None

    def spark_regex(self) -> str:
        return self.fast_regex or java_regex(self.regex)

    def spark_group(self) -> int:
        return self.group if self.fast_group is None else self.fast_group

    @property
    def word(self) -> str | None:
        """The body of a pattern that matches whole runs of word characters of fixed shape only, else None.

        Such patterns share one scan of a text: it finds the runs, and the body tells on a run of a few characters whether it
        is a match. Two matches of one pattern are never in the same run, so nothing is told apart wrongly.
        """
        body = self.regex.removeprefix(r"\b").removesuffix(r"\b")
        if self.group or self.custom or len(body) != len(self.regex) - 4 or not _WHOLE_WORD.fullmatch(body):
            return None
        return body


# A body of capitals, digits, counts and groups: nothing in it matches a character that is not a word character.
_WHOLE_WORD = re.compile(r"(?:\[A-Z\]|\[0-9\]|\[0-9A-Z\]|\[A-Z0-9\]|\[[0-9]+-[0-9]+\]|\[[0-9]+\]|\\d|[0-9A-Z]|\{[0-9]+(?:,[0-9]+)?\}|\(\?:|[)?|])+")


def words_regex(bodies: list[str]) -> str:
    """All runs of word characters that one of the bodies matches."""
    return listed(f"(?=[0-9A-Z]){_STARTS}(?:{'|'.join(dict.fromkeys(bodies))}){_ENDS}")


def listed(regex: str) -> str:
    """The same regex with the ranges of its classes written out, for the regexes of this module (no quoting, no class in a class).

    `java.util.regex` looks listed characters up in one table; ranges it tests one after the other, many times slower where
    a class of several is negated or tried at every position of a text.
    """
    def chars(m):
        return "".join(map(chr, range(ord(m[1]), ord(m[2]) + 1)))

    return _CLASS.sub(lambda c: _RANGE.sub(chars, c[0]), regex)


# An escaped character outside of classes is matched by itself, so that no class starts at its bracket.
_CLASS = re.compile(r"\\.|\[(?:\\.|[^\]\\])+\]")
_RANGE = re.compile(r"(?<!\\)([0-9A-Za-z])-([0-9A-Za-z])")


# Cheap tests that decide whether a text is worth a pattern's full regex. Each is computed once per text and shared
# by all patterns that name it. `v` is the text, `low` its lower case; tests named in NEED_DIGIT are asked only of texts
# that hold a digit.
GUARDS = {
    "at": lambda v, low: F.contains(v, F.lit("@")),
    "groups_of_4": lambda v, low: v.rlike(r"[2-9][0-9]{3}[ \t\n\f\r-]?[0-9]{4}[ \t\n\f\r-]?[0-9]{4}"),
    "digits9": lambda v, low: v.rlike("[0-9]{9}"),
    "upper_digit": lambda v, low: v.rlike("[A-Z][- ]?[0-9]"),
    "dotted": lambda v, low: v.rlike(r"[0-9]\.[0-9]"),
    "colon": lambda v, low: F.contains(v, F.lit(":")),
    "akia": lambda v, low: F.contains(v, F.lit("AKIA")),
    "begin": lambda v, low: F.contains(v, F.lit("-----BEGIN ")),
    "eyj": lambda v, low: F.contains(v, F.lit("eyJ")),
    "api": lambda v, low: F.contains(low, F.lit("api")),
    "secret": lambda v, low: F.contains(low, F.lit("secret")),
    "bearer": lambda v, low: F.contains(low, F.lit("bearer")),
    "health": lambda v, low: reduce(lambda a, w: a | F.contains(low, F.lit(w)),
                               ["blood", "diagnosis", "prescription", "icd", "uhid", "abha"], F.lit(False)),
    "year": lambda v, low: v.rlike(r"[/\-.](?:19|20)[0-9]{2}"),
}
NEED_DIGIT = {"groups_of_4", "digits9", "upper_digit", "dotted", "year"}


_WORD = "[0-9A-Za-z_]"
_STARTS = rf"(?<!{_WORD})"
_ENDS = rf"(?!{_WORD})"
_BOUNDARY = rf"(?:(?<!{_WORD})(?={_WORD})|(?<={_WORD})(?!{_WORD}))"


def java_regex(regex: str) -> str:
    r"""Give `\b` and `\s` their ASCII meaning, which Java's `\b` does not have next to a letter such as é."""
    out, in_class, i = [], False, 0
    while i < len(regex):
        ch = regex[i]
        if ch == "\\" and i + 1 < len(regex):
            nxt = regex[i + 1]
            if nxt == "b" and not in_class:
                out.append(_BOUNDARY)
            elif nxt == "s":
                out.append(r" \t\n\f\r" if in_class else r"[ \t\n\f\r]")
            else:
                out.append(ch + nxt)
            i += 2
            continue
        if ch == "[" and not in_class:
            in_class = True
        elif ch == "]" and in_class:
            in_class = False
        out.append(ch)
        i += 1
    return "".join(out)


def _edged(regex: str) -> str:
    r"""For a pattern whose matches start and end with a word character, one lookaround per `\b` is enough.

    The built-ins of this kind start with a digit or a capital; that is tested first, as it fails faster.
    """
    body = regex
    if body.startswith(r"\b"):
        first = "[A-Z]" if body.startswith(r"\b[A-Z]") else "[0-9]"
        body = f"(?={first})" + _STARTS + body[2:]
    if body.endswith(r"\b"):
        body = body[:-2] + _ENDS
    return java_regex(body)


# Detection patterns. name | type | pattern | context keywords
_FIXED_PATTERNS = [
    ("Aadhaar", "IN_AADHAAR", r"(?:^|[^0-9A-Za-z])([2-9]\d{3}[\s-]?\d{4}[\s-]?\d{4})(?:[^0-9A-Za-z]|$)", ()),
    ("PAN", "IN_PAN", r"\b[A-Z]{5}[0-9]{4}[A-Z]\b", ()),
    ("Credit Card Visa", "CREDIT_CARD", r"\b4[0-9]{12}(?:[0-9]{3})?\b", ()),
    ("Credit Card MC", "CREDIT_CARD", r"\b5[1-5][0-9]{14}\b", ()),
    ("Credit Card Amex", "CREDIT_CARD", r"\b3[47][0-9]{13}\b", ()),
    ("Credit Card Discover", "CREDIT_CARD", r"\b6(?:011|5[0-9]{2})[0-9]{12}\b", ()),
    ("Email", "EMAIL_ADDRESS", r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}", ()),
    ("Phone India", "IN_PHONE", r"\b(?:91|0)?[6-9]\d{9}\b", ()),
    ("Phone India +91", "IN_PHONE", r"\+91[\s-]?[6-9]\d{9}\b", ()),
    ("GST", "IN_GST", r"[0-3][0-9][A-Z]{5}[0-9]{4}[A-Z][0-9A-Z]Z[0-9A-Z]", ()),
    ("UPI", "IN_UPI", r"[a-zA-Z0-9.\-_]{3,}@[a-zA-Z0-9.\-_]+", ()),
    ("IFSC", "IN_IFSC", r"[A-Z]{4}0[A-Z0-9]{6}", ()),
    ("Passport India", "IN_PASSPORT", r"\b[A-Z][0-9]{7}\b", ()),
    ("Voter ID", "IN_VOTER_ID", r"\b[A-Z]{3}[0-9]{7}\b", ()),
    ("Driving License", "IN_DRIVING_LICENSE", r"[A-Z]{2}[- ]?\d{2}[- ]?\d{4,7}", ()),
    ("Bank Account", "IN_BANK_ACCOUNT", r"\b[0-9]{9,18}\b",
     ("account", "acct", "bank", "ifsc", "savings", "current", "routing")),
    ("AWS Access Key", "AWS_ACCESS_KEY", r"AKIA[0-9A-Z]{16}", ()),
    ("Private Key", "PRIVATE_KEY", r"-----BEGIN [A-Z ]+ PRIVATE KEY-----", ()),
    ("Generic API Key", "GENERIC_API_KEY", r"""(?i)api[_-]?key["':\s]+[A-Za-z0-9_\-]{20,}""", ()),
    ("Generic Secret", "GENERIC_SECRET", r"""(?i)secret["':\s]+[A-Za-z0-9_\-]{16,}""", ()),
    ("JWT Token", "JWT_TOKEN", r"eyJ[A-Za-z0-9\-_]+\.eyJ[A-Za-z0-9\-_]+\.[A-Za-z0-9\-_]+", ()),
    ("Bearer Token", "BEARER_TOKEN", r"(?i)Bearer\s+[A-Za-z0-9\-_.~+/]+=*", ()),
    ("IP Address", "IP_ADDRESS",
     r"\b(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\b", ()),
    ("MAC Address", "MAC_ADDRESS",
     r"[0-9A-Fa-f]{2}:[0-9A-Fa-f]{2}:[0-9A-Fa-f]{2}:[0-9A-Fa-f]{2}:[0-9A-Fa-f]{2}:[0-9A-Fa-f]{2}", ()),
    ("Date of Birth", "DATE_OF_BIRTH",
     r"\b(?:0[1-9]|[12][0-9]|3[01])[/\-.](?:0[1-9]|1[012])[/\-.](?:19|20)\d{2}\b", ()),
    ("EPF UAN", "IN_EPF_UAN", r"\b\d{12}\b", ()),
    ("ESIC", "IN_ESIC", r"\b\d{17}\b", ()),
    ("Health Record", "HEALTH_RECORD",
     r"(?i)(?:blood\s*group|diagnosis|prescription|icd[-\s]?10|uhid|abha)\s*:?\s*[A-Z0-9\-+]+", ()),
]

# Type name a user selects | pattern names it switches on
TYPE_PATTERNS = {
    "PAN": ["PAN"],
    "AADHAAR": ["Aadhaar"],
    "EMAIL": ["Email"],
    "PHONE": ["Phone India"],
    "CREDIT_CARD": ["Credit Card Visa", "Credit Card MC", "Credit Card Amex", "Credit Card Discover"],
    "PASSPORT": ["Passport India"],
    "UPI_ID": ["UPI"],
    "UPI": ["UPI"],
    "IFSC": ["IFSC"],
    "BANK_ACCOUNT": ["Bank Account"],
    "GST": ["GST"],
    "VOTER_ID": ["Voter ID"],
    "DRIVING_LICENSE": ["Driving License"],
    "AWS_ACCESS_KEY": ["AWS Access Key"],
    "PRIVATE_KEY": ["Private Key"],
    "GENERIC_API_KEY": ["Generic API Key"],
    "GENERIC_SECRET": ["Generic Secret"],
    "JWT_TOKEN": ["JWT Token"],
    "BEARER_TOKEN": ["Bearer Token"],
    "IP_ADDRESS": ["IP Address"],
    "MAC_ADDRESS": ["MAC Address"],
    "DATE_OF_BIRTH": ["Date of Birth"],
    "EPF_UAN": ["EPF UAN"],
    "ESIC": ["ESIC"],
    "HEALTH_RECORD": ["Health Record"],
}

# Recognizer entity | pattern | score | context words
_FIXED_RECOGNIZERS = [
    ("IN_PAN", r"\b[A-Z]{5}[0-9]{4}[A-Z]\b", 0.85, ("pan", "permanent", "account", "card", "tax", "income")),
    ("IN_AADHAAR", r"\b[2-9]\d{3}[\s-]?\d{4}[\s-]?\d{4}\b", 0.6,
     ("aadhaar", "aadhar", "uid", "unique", "identification")),
    ("IN_GST", r"\b[0-3][0-9][A-Z]{5}[0-9]{4}[A-Z][0-9A-Z]Z[0-9A-Z]\b", 0.9,
     ("gst", "gstin", "goods", "services", "tax")),
    ("IN_VOTER_ID", r"\b[A-Z]{3}[0-9]{7}\b", 0.7, ("voter", "epic", "election", "commission")),
    ("IN_IFSC", r"\b[A-Z]{4}0[A-Z0-9]{6}\b", 0.9, ("ifsc", "bank", "branch", "code", "rtgs", "neft")),
    ("IN_DRIVING_LICENSE", r"\b[A-Z]{2}[- ]?\d{2}[- ]?\d{4,7}\b", 0.6, ("driving", "license", "licence", "dl", "rto")),
    ("IN_PASSPORT", r"\b[A-Z][0-9]{7}\b", 0.7, ("passport", "travel", "document")),
    ("IN_UPI", r"\b[a-zA-Z0-9.\-_]{3,}@[a-zA-Z0-9.\-_]+\b", 0.5,
     ("upi", "vpa", "handle", "phonepe", "gpay", "paytm")),
    ("IN_BANK_ACCOUNT", r"\b[0-9]{9,18}\b", 0.4, ("account", "bank", "savings", "current", "accnt", "a/c")),
    ("IN_PHONE", r"(?:\+91|91|0)?[6-9]\d{9}", 0.7, ("phone", "mobile", "contact", "cell", "tel")),
]

_PATTERN_GUARDS = {
    "Aadhaar": "groups_of_4", "PAN": "upper_digit", "Credit Card Visa": "digits9", "Credit Card MC": "digits9",
    "Credit Card Amex": "digits9", "Credit Card Discover": "digits9", "Email": "at", "Phone India": "digits9",
    "Phone India +91": "digits9", "GST": "upper_digit", "UPI": "at", "IFSC": "upper_digit",
    "Passport India": "upper_digit", "Voter ID": "upper_digit", "Driving License": "upper_digit",
    "Bank Account": "digits9", "AWS Access Key": "akia", "Private Key": "begin", "Generic API Key": "api",
    "Generic Secret": "secret", "JWT Token": "eyj", "Bearer Token": "bearer", "IP Address": "dotted",
    "MAC Address": "colon", "Date of Birth": "year", "EPF UAN": "digits9", "ESIC": "digits9",
    "Health Record": "health",
}

# A run of local-part characters is entered once, at its start or where the last match ended (\G), and never given
# back, so a long run without "@" costs its length instead of its length squared. The matches are the same.
_LINEAR = {
    "Email": r"(?:\G|(?<![a-zA-Z0-9._%+\-]))[a-zA-Z0-9._%+\-]++@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}",
    "UPI": r"(?:\G|(?<![a-zA-Z0-9.\-_]))[a-zA-Z0-9.\-_]{3,}+@[a-zA-Z0-9.\-_]+",
}

# The characters that a match can start with, tested before its alternatives.
_FIRST = {"Health Record": "(?i)(?=[abdipu])"}

BUILTIN = [
    Pattern(n, t, r, context_keywords=kw, guard=_PATTERN_GUARDS[n], fast_regex=listed(_LINEAR.get(n) or _FIRST.get(n, "") + _edged(r)))
    for n, t, r, kw in _FIXED_PATTERNS
]

_RECOGNIZER_GUARDS = {
    "IN_PAN": "upper_digit", "IN_AADHAAR": "groups_of_4", "IN_GST": "upper_digit", "IN_VOTER_ID": "upper_digit",
    "IN_IFSC": "upper_digit", "IN_DRIVING_LICENSE": "upper_digit", "IN_PASSPORT": "upper_digit", "IN_UPI": "at",
    "IN_BANK_ACCOUNT": "digits9", "IN_PHONE": "digits9",
}

# The same for a run that must begin at a word character: dots and hyphens before it are passed over, group 1 is the match.
_LINEAR_RECOGNIZERS = {
    "IN_UPI": rf"(?:\G|(?<![a-zA-Z0-9.\-_]))[.\-]*+((?={_WORD})[a-zA-Z0-9.\-_]{{3,}}+@[a-zA-Z0-9.\-_]+{_BOUNDARY})",
}

RECOGNIZERS = [
    Pattern(f"recognizer_{e}", e, r, context_keywords=kw, base_score=s, guard=_RECOGNIZER_GUARDS[e],
            fast_regex=listed(_LINEAR_RECOGNIZERS.get(e) or java_regex(r)), fast_group=1 if e in _LINEAR_RECOGNIZERS else None)
    for e, r, s, kw in _FIXED_RECOGNIZERS
]


def select_patterns(pii_types: list[str] | None = None) -> list[Pattern]:
    """Built-ins for the selected types. None means all, an empty list means none."""
    if pii_types is None:
        return list(BUILTIN)
    names = {n for t in pii_types for n in TYPE_PATTERNS.get(t, [])}
    return [p for p in BUILTIN if p.name in names]


def select_recognizers(entities: list[str] | None = None, custom: list[Pattern] = ()) -> list[Pattern]:
    """Recognizers of the chosen entities; custom patterns join in at score 0.85."""
    chosen = [r for r in RECOGNIZERS if entities is None or r.pii_type in entities]
    return chosen + [
        Pattern(f"custom_{c.name}", c.pii_type, c.regex, c.context_keywords, base_score=0.85)
        for c in custom if c.pii_type and c.regex
    ]


def custom_pattern(name, pii_type, regex, context_keywords=(), negative_keywords=()) -> Pattern:
    return Pattern(name, pii_type, regex, tuple(context_keywords), tuple(negative_keywords), custom=True)


def regex_status(regex: Column) -> Column:
    """Acceptance of a user regex: ok, too_long, nested_quantifier, unbounded_alternation or invalid."""
    return (
        F.when(F.length(regex) > 500, "too_long")
        .when(~_balanced(regex), "invalid")
        .when(regex.rlike(r"\([^)]*[+*][^)]*\)[+*{]"), "nested_quantifier")
        .when(regex.rlike(r"\([^)]*\|[^)]*\)[+*]"), "unbounded_alternation")
        .otherwise("ok")
    )


def _balanced(regex: Column) -> Column:
    """Brackets match up once escapes and character classes are taken out; a cheap stand-in for compiling."""
    bare = F.regexp_replace(F.regexp_replace(regex, r"\\.", ""), r"\[\^?\]?[^\]]*\]", "")
    opened = F.length(bare) - F.length(F.replace(bare, F.lit("("), F.lit("")))
    closed = F.length(bare) - F.length(F.replace(bare, F.lit(")"), F.lit("")))
    return (opened == closed) & ~F.contains(bare, F.lit("[")) & ~bare.rlike(r"^[*+?]")
