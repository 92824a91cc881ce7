"""Operator 8: derived WARC records. Each response record gives a metadata record and a plain-text conversion record that
refer to it and keep its target URI, HTTP header and payload digest. Built-in functions only, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CRLF = "\r\n"
SPACE = "[ \\t\\r\\n\\f]"
#: Elements whose content is no text of the page.
HIDDEN = ("script", "style", "noscript", "template")
#: Elements that begin a new line.
BLOCKS = ("address|article|aside|blockquote|body|br|caption|dd|div|dl|dt|fieldset|figure|footer|form|h1|h2|h3|h4|h5|h6|head|header|hr|"
          "html|li|main|nav|ol|option|p|pre|section|select|table|tbody|td|tfoot|th|thead|title|tr|ul")
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&"))

#: (pattern, replacement) from HTML to text, in this order; the same in Java's and RE2's syntax.
TEXT_RULES = (
    ("(?s)<!--.*?(?:-->|\\z)", " "),
    *((f"(?is)<{tag}[ \\t\\r\\n\\f/>].*?(?:</{tag}{SPACE}*>|\\z)", " ") for tag in HIDDEN),
    (f"{SPACE}+", " "),
    (f"(?i)</?(?:{BLOCKS})(?: [^>]*|/)?>", "\n"),
    ("<[a-zA-Z/!?][^>]*>", ""),
)
TRIM_RULES = (("[ \u00a0]+", " "), (" ?\n[ \n]*", "\n"), ("\\A[ \n]+", ""), ("[ \n]+\\z", ""))
TITLE = "(?is)<title(?:[ \\t\\r\\n\\f][^>]*)?>(.*?)</title"
LINK = "(?i)<a[ \\t\\r\\n\\f][^>]*?href=\"([^\"]*)\""


def plain_text(html: Column) -> Column:
    for pattern, new in TEXT_RULES:
        html = F.regexp_replace(html, pattern, new)
    for entity, char in ENTITIES:
        html = F.replace(html, F.lit(entity), F.lit(char))
    for pattern, new in TRIM_RULES:
        html = F.regexp_replace(html, pattern, new)
    return html


def _record_id(kind: Column | str, *of: Column) -> Column:
    """A UUID that follows from the record; the same input gives the same id."""
    h = F.md5(F.concat_ws("|", F.lit(kind) if isinstance(kind, str) else kind, *of))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _digest(block: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(block.cast("binary"), 256))


def responses(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Pages as response records: pages' other columns, record_id, target_uri, http_headers, payload, payload_digest."""
    url, html = F.coalesce(F.col(f"`{url_col}`"), F.lit("")), F.coalesce(F.col(f"`{html_col}`"), F.lit(""))
    digest = _digest(html)
    headers = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
                       F.octet_length(html).cast("string"), F.lit(CRLF + CRLF))
    return pages.drop("record_id", "target_uri", "http_headers", "payload", "payload_digest").withColumns({
        "record_id": _record_id("response", url, digest), "target_uri": url, "http_headers": headers, "payload": html,
        "payload_digest": digest}).drop(*({url_col, html_col} - {"payload"}))


def derivatives(found: DataFrame) -> DataFrame:
    """Two records for each response: warc_type metadata and conversion, with the columns of the response except payload.

    Columns added: warc_type, warc_record_id, refers_to (the response's record_id), content_type, block, content_length (bytes)
    and block_digest. http_headers and payload_digest stay those of the response. An empty payload gives an empty conversion
    block and a metadata block without title and links; null columns count as empty. Equal rows give equal records with the
    same ids. Text of any length is converted whole.
    """
    html = F.coalesce(F.col("payload"), F.lit(""))
    title = F.trim(F.regexp_replace(F.regexp_extract(html, TITLE, 1), f"{SPACE}+", " "))
    links = F.regexp_extract_all(html, F.lit(LINK), F.lit(1))
    lines = F.transform(links, lambda x: F.concat(F.lit("outlink: "), F.regexp_replace(x, "[\\r\\n]", ""), F.lit(CRLF)))
    facts = F.concat(F.lit("title: "), title, F.lit(f"{CRLF}links: "), F.size(links).cast("string"), F.lit(CRLF),
                     F.array_join(lines, ""))
    kinds = F.array(F.struct(F.lit("metadata").alias("warc_type"), F.lit("application/warc-fields").alias("content_type"),
                             facts.alias("block")),
                    F.struct(F.lit("conversion").alias("warc_type"), F.lit("text/plain; charset=utf-8").alias("content_type"),
                             plain_text(html).alias("block")))
    names = [c for c in found.columns if c not in ("payload", "warc_type", "content_type", "block")]
    out = found.select(*[F.col(f"`{c}`") for c in names], F.inline(kinds))
    digest = _digest(F.col("block"))
    return out.withColumns({
        "refers_to": F.col("record_id"), "warc_record_id": _record_id(F.col("warc_type"), F.col("record_id"), digest),
        "content_length": F.octet_length("block").cast("long"), "block_digest": digest}).drop("record_id")


def record_text(records: DataFrame, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """One column `value`: each derivative as a WARC 1.0 record without its closing empty lines."""
    def line(name, value):
        return F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))

    return records.select(F.concat(
        F.lit(f"WARC/1.0{CRLF}"), line("WARC-Type", F.col("warc_type")), line("WARC-Record-ID", F.col("warc_record_id")),
        line("WARC-Refers-To", F.col("refers_to")), line("WARC-Target-URI", F.regexp_replace("target_uri", "[\\r\\n]", "")),
        line("WARC-Date", F.lit(date)), line("WARC-Block-Digest", F.col("block_digest")),
        line("WARC-Payload-Digest", F.col("payload_digest")), line("Content-Type", F.col("content_type")),
        line("Content-Length", F.col("content_length").cast("string")), F.lit(CRLF), F.col("block")).alias("value"))


def write_warc(records: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z") -> None:
    """Files of WARC records, one per task, in a folder that all executors reach."""
    record_text(records, date).write.option("lineSep", CRLF + CRLF).text(folder)


def derivatives_sql() -> str:
    """The records' digests over the table pages for a SQL engine with RE2 patterns."""
    def quoted(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    text = "html"
    for pattern, new in TEXT_RULES:
        text = f"regexp_replace({text}, {quoted(pattern)}, {quoted(new)}, 'g')"
    for entity, char in ENTITIES:
        text = f"replace({text}, {quoted(entity)}, {quoted(char)})"
    for pattern, new in TRIM_RULES:
        text = f"regexp_replace({text}, {quoted(pattern)}, {quoted(new)}, 'g')"
    crlf = "chr(13) || chr(10)"

    def uuid(h: str) -> str:
        cuts = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
        return "'<urn:uuid:' || " + " || '-' || ".join(f"substr({h}, {a}, {n})" for a, n in cuts) + " || '>'"

    return f"""
    WITH p AS (
      SELECT page_id, coalesce(url, '') AS target_uri, coalesce(html, '') AS html,
             'sha256:' || sha256(coalesce(html, '')) AS payload_digest
      FROM pages
    ), r AS (
      SELECT *, md5('response|' || target_uri || '|' || payload_digest) AS h,
             regexp_extract_all(html, {quoted(LINK)}, 1) AS links,
             trim(regexp_replace(regexp_extract(html, {quoted(TITLE)}, 1), {quoted(SPACE + '+')}, ' ', 'g'), ' ') AS title
      FROM p
    ), d AS (
      SELECT page_id, target_uri, payload_digest, {uuid('h')} AS refers_to, octet_length(encode(html)) AS n_bytes,
             unnest(['metadata', 'conversion']) AS warc_type,
             unnest(['title: ' || title || {crlf} || 'links: ' || len(links) || {crlf} ||
                     coalesce(list_aggregate([ 'outlink: ' || regexp_replace(x, '[\\r\\n]', '', 'g') || {crlf} for x in links ],
                              'string_agg', ''), ''), {text}]) AS block
      FROM r
    ), e AS (SELECT *, 'sha256:' || sha256(block) AS block_digest FROM d),
    f AS (SELECT *, md5(warc_type || '|' || refers_to || '|' || block_digest) AS h2 FROM e)
    SELECT page_id, warc_type, {uuid('h2')} AS warc_record_id, refers_to, target_uri, payload_digest, block_digest,
           octet_length(encode(block)) AS content_length,
           'HTTP/1.1 200 OK' || {crlf} || 'Content-Type: text/html; charset=utf-8' || {crlf} || 'Content-Length: ' || n_bytes ||
             {crlf} || {crlf} AS http_headers
    FROM f"""
