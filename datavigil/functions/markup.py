"""Text out of markup and mail encodings, as column expressions."""

from __future__ import annotations

import html.entities
import json
import zlib

from pyspark.sql import Column
from pyspark.sql import functions as F

from datavigil.functions.text import let

# Elements whose text is dropped, and elements whose content is text up to their end tag, tags in it included.
SILENT_TAGS = ["script", "style"]
RAW_TAGS = ["title", "textarea", "noscript", "iframe", "noembed", "noframes", "xmp"]

_ATTRIBUTES = r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+"""
_SILENT, _RAW = "|".join(SILENT_TAGS), "|".join(RAW_TAGS)
# One pass from left to right, as a tokenizer reads: comments (to the end if they are not closed), elements without text
# (likewise), elements of raw text (kept as group 2), tags with quotes that may hold ">", markup declarations, and a tag
# that the text ends in. A "<" that no name follows is text. `.` is never inside a group that repeats, so nothing recurses.
_TOKENS = (
    r"(?is)<!--(?:-?>|.*?(?:--!?>|\z))"
    rf"|<({_SILENT})(?=[\s/>]){_ATTRIBUTES}>.*?(?:</\1(?=[\s/>])[^>]*+>|\z)"
    rf"|<({_RAW})(?=[\s/>]){_ATTRIBUTES}>(.*?)(?:</\2(?=[\s/>])[^>]*+>|\z)"
    rf"|</?+[a-z]{_ATTRIBUTES}>"
    r"|<[!?/][^>]*+>"
    r"|</?+[a-z][^>]*+\z"
)

# The names of characters are those of the standard; Python has them as a table.
_NAMED = {name.removesuffix(";"): text for name, text in html.entities.html5.items() if name.endswith(";")}
_LEGACY = sorted((name for name in html.entities.html5 if not name.endswith(";")), key=len, reverse=True)
# Numbers of the C1 range stand for the characters of Windows-1252, where it has one.
_C1 = {n: bytes([n]).decode("cp1252") for n in range(0x80, 0xA0) if bytes([n]).decode("cp1252", "ignore")}
_LATIN = ["�", *(_C1.get(n, chr(n)) for n in range(1, 0x100))]
# References by what stands before the ";": the names, and the numbers of Latin characters as they are mostly written. A map is
# searched entry by entry, so they are dealt to small maps by a checksum.
_CLOSED = _NAMED | {form.format(n): text for n, text in enumerate(_LATIN) for form in ("#{}", "#x{:x}", "#x{:X}", "#X{:x}", "#X{:X}")}
_BUCKETS = 4096
_BY_SUM = [{} for _ in range(_BUCKETS)]
for _name, _text in _CLOSED.items():
    _BY_SUM[zlib.crc32(_name.encode()) % _BUCKETS][_name] = _text


def markup_text(c: Column) -> Column:
    """Text of a page, a line end for every tag; entities are still in it."""
    return F.regexp_replace(c, _TOKENS, "\n$3\n")


def _constant(value: list, kind: str) -> Column:
    """A list as one literal of the plan."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def _closed(name: Column) -> Column:
    """The text a reference stands for, by what is before its ";"; null for any that the table has not."""
    bucket = F.get(_constant(_BY_SUM, "array<map<string,string>>"), (F.crc32(name) % _BUCKETS).cast("int"))
    return F.element_at(bucket, name)


def _character(number: Column) -> Column:
    """The character of a code point; the replacement character for none."""
    text = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
    bad = number.isNull() | (number <= 0) | (number > 0x10FFFF) | number.between(0xD800, 0xDFFF)
    latin = F.get(_constant(_LATIN, "array<string>"), number.cast("int"))
    return F.when(bad, "�").when(number < len(_LATIN), latin).otherwise(text)


def _code_point(reference: Column) -> Column:
    """The number in a reference as `#65;` or `#x41`; -1 for one of more digits than any character has."""
    def number(digits: Column, value) -> Column:
        return let(F.rtrim(digits, F.lit(";")), lambda d: F.when(F.length(F.ltrim(d, F.lit("0"))) < 8, value(d).cast("bigint")).otherwise(-1))

    return F.when(F.substring(reference, 2, 1).isin("x", "X"), number(F.substr(reference, F.lit(3)), lambda d: F.conv(d, 16, 10))).otherwise(
        number(F.substr(reference, F.lit(2)), lambda d: d))


def decode_entities(c: Column) -> Column:
    """Named and numeric character references replaced, each once, from left to right.

    Names without a semicolon count where the standard knows them so. What is no reference stays. Each step of a reference is
    bound, so that it is computed once, whatever names its result.
    """
    def numeric(part: Column) -> Column:
        return let(F.regexp_extract(part, "^#(?:[0-9]++|[xX][0-9a-fA-F]++);?", 0), lambda reference: F.when(
            reference != "", F.concat(let(_code_point(reference), _character), F.substr(part, F.length(reference) + 1))).otherwise(
            F.concat(F.lit("&"), part)))

    def unclosed(part: Column) -> Column:
        return let(F.regexp_extract(part, f"^({'|'.join(_LEGACY)})", 1), lambda name: F.when(
            name != "", F.concat(_closed(name), F.substr(part, F.length(name) + 1))).otherwise(F.concat(F.lit("&"), part)))

    def one(part: Column) -> Column:
        return let(F.substring_index(part, ";", 1), lambda name: let(F.when(name != part, _closed(name)), lambda text: F.when(
            text.isNotNull(), F.concat(text, F.substr(part, F.length(name) + 2))).when(
            part.startswith("#"), numeric(part)).otherwise(unclosed(part))))

    def decoded(parts: Column) -> Column:
        return F.concat(F.get(parts, F.lit(0)), F.array_join(F.transform(F.slice(parts, 2, F.size(parts)), one), ""))

    return F.when(F.contains(c, F.lit("&")), let(F.split(c, "&", -1), decoded)).otherwise(c)


def text_in_charset(data: Column, charset: Column) -> Column:
    """Bytes as text: the single-byte sets of Western mail, everything else as UTF-8 with replacement characters."""
    charset = F.lower(charset)
    latin = F.decode(data, "ISO-8859-1")
    c1 = F.translate(latin, "".join(map(chr, _C1)), "".join(_C1.values()))
    ninth = "¤¦¨´¸¼½¾"  # what ISO 8859-15 has changed in ISO 8859-1
    return (F.when(charset.isin("windows-1252", "cp1252"), c1).when(charset.isin("iso-8859-1", "latin1"), latin)
            .when(charset == "iso-8859-15", F.translate(latin, ninth, "".join(bytes([ord(ch)]).decode("iso-8859-15") for ch in ninth)))
            .otherwise(F.make_valid_utf8(data.cast("string"))))


def quoted_printable(c: Column) -> Column:
    """Bytes of quoted-printable text; a "=" that no two hexadecimal digits follow stays."""
    soft = F.regexp_replace(c, r"=[ \t]*\n|[ \t]++(?=\n)|=\z", "")

    def joined(parts: Column) -> Column:
        pieces = F.transform(F.slice(parts, 2, F.size(parts)), lambda p: F.when(
            p.rlike("^[0-9a-fA-F]{2}"), F.concat(F.substr(p, F.lit(1), F.lit(2)), F.hex(F.substr(p, F.lit(3))))).otherwise(F.concat(F.lit("3D"), F.hex(p))))
        return F.unhex(F.concat(F.hex(F.get(parts, F.lit(0))), F.array_join(pieces, "")))

    return let(F.split(soft, "=", -1), joined)


def transfer_decoded(body: Column, encoding: Column, charset: Column) -> Column:
    """Body of a mail part by its transfer encoding and charset; one that cannot be decoded stays as it is."""
    encoding = F.lower(F.trim(encoding))
    packed = F.try_to_binary(F.regexp_replace(body, r"[ \t\n]", ""), F.lit("base64"))
    return (F.when(encoding == "quoted-printable", text_in_charset(quoted_printable(body), charset))
            .when(encoding == "base64", F.coalesce(text_in_charset(packed, charset), body)).otherwise(body))
