"""Readers, JSON scrubbing, scans of failing sources and versioned tables against plain Python."""

from __future__ import annotations

import html
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from datavigil.functions import markup as K
from datavigil.functions import masking as M
from datavigil.sources import records as X
from datavigil.sources.scan import Source, scan_each
from datavigil.sources.versions import VersionedTable


@pytest.fixture
def small_splits(spark):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
    spark.conf.set("spark.sql.files.openCostInBytes", old[1])


def test_line_numbers_over_splits(spark, small_splits, tmp_path):
    rnd, wanted = random.Random(1), set()
    for name, n in (("a.txt", 400), ("b.log", 3), ("c.bin", 5), ("sub/d.md", 90), ("e.txt", 0)):
        os.makedirs(tmp_path / "x/sub", exist_ok=True)
        lines = [rnd.choice(["", "é" * rnd.randint(1, 40), "x\ty", "w" * 900 if rnd.random() < 0.02 else "short"]) for _ in range(n)]
        with open(tmp_path / "x" / name, "w", newline="") as f:
            f.write(rnd.choice(["\n", "\r\n"]).join(lines))
        if name != "c.bin":
            wanted |= {(name.split("/")[-1], i, line) for i, line in enumerate(lines, 1) if line}
    found = X.scan_files(spark, str(tmp_path / "x"), extensions=[".txt", ".log", ".md"])
    assert found.rdd.getNumPartitions() > 4
    rows = [(r["field_name"], int(r["source_path"].rsplit("_", 1)[1]), r["value"]) for r in found.collect()]
    assert len(rows) == len(wanted) and set(rows) == wanted
    listed = {os.path.basename(r["source_path"]): r["status"] for r in X.listed_files(spark, str(tmp_path / "x"), 5000, [".txt", ".log", ".md"]).collect()}
    assert listed["a.txt"] == "too_large" and listed["c.bin"] == "no_text" and listed["b.log"] == "read"
    few = X.scan_files(spark, str(tmp_path / "x"), 5000, [".txt", ".log", ".md"])
    assert {r["field_name"] for r in few.collect()} == {"b.log", "d.md"}


@pytest.mark.parametrize(("page", "lines"), [
    ("<p>john&#64;corp.in</p>tom&#x40;corp.in", ["john@corp.in", "tom@corp.in"]),
    ("a<script>var x = '</p>'", ["a"]), ("a<SCRIPT type=x>1</script >b", ["a", "b"]), ("<scripty>a</scripty>", ["a"]),
    ("<style>p{}</style>a<!-- x > y --><b title='>'>c</b>", ["a", "c"]), ("a<!-- open", ["a"]), ("a<!-->b", ["a", "b"]),
    ("1 < 2 and 3 > 2", ["1 < 2 and 3 > 2"]), ("<a href=\"x>y\" b='>'>z</a>", ["z"]), ("x <b", ["x"]),
    ("<title>a <b> c</title>d", ["a <b> c", "d"]), ("<textarea>a", ["a"]), ("<!DOCTYPE html><?x y?>a", ["a"]),
    ("&amp;lt; &notit; &nosuch; &copy &AMP;&#0;&#x80;&#xD800;&#99999999999;", ["&lt; ¬it; &nosuch; © &�€��"]),
    ("a &CounterClockwiseContourIntegral; &NotEqualTilde; b", ["a ∳ ≂̸ b"]), ("&nbsp;x&nbsp;", ["x"]), ("", []), ("&", ["&"]), (None, []),
])
def test_html_lines(spark, page, lines):
    df = spark.createDataFrame([(page,)], "html string")
    assert [r["value"] for r in X.html_text(df, "html", F.lit("p")).collect()] == lines


def test_entities_as_the_library_reads_them(spark):
    rnd = random.Random(2)
    names = sorted(html.entities.html5)
    # numbers of control characters and non-characters are left out: the library drops what the standard keeps
    texts = ["".join(rnd.choice(["&", "a", ";", " ", "&" + rnd.choice(names), f"&#{rnd.randint(160, 0x2FFF)};", f"&#x{rnd.randint(0x10000, 0x1F64F):X};"])
                     for _ in range(12)) for _ in range(300)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", K.decode_entities(F.col("t")).alias("d")).collect()
    assert [r["d"] for r in rows] == [html.unescape(r["t"]) for r in rows]


def test_long_and_odd_markup(spark):
    page = "<p>" + "x &amp; <i a='" + "q" * 200_000 + "'>y</i> " * 3 + "<!--" + "z" * 300_000
    assert [r["value"] for r in X.html_text(spark.createDataFrame([(page,)], "html string"), "html", F.lit("p")).collect()][:2] == ["x &", "y"]


def mail(spark, raw, **kw):
    rows = X.email_fields(spark.createDataFrame([(raw,)], "raw string"), "raw", F.lit("m"), **kw).collect()
    return [(r["field_name"], r["value"]) for r in rows]


def test_mail_parts(spark):
    long = "\n".join(f"line {i}" for i in range(20_000))
    assert mail(spark, f"From: a@b\nContent-Type: multipart/mixed; boundary=X\n\n--X\n{long}\n--X--\n") == [("from", "a@b"), ("body_part", long)]
    assert mail(spark, "Subject: a\n b\n\nhello\n") == [("subject", "a b"), ("body", "hello\n")]
    assert mail(spark, "To: x\nContent-Type: image/png\n\nAAAA") == [("to", "x")]
    assert mail(spark, "To: x\nContent-Type: text/plain; charset=iso-8859-1\nContent-Transfer-Encoding: quoted-printable\n\nM=FCller =3D 5=\n6 =XY") == [
        ("to", "x"), ("body", "Müller = 56 =XY")]
    assert mail(spark, "To: x\nContent-Type: text/plain; charset=windows-1252\nContent-Transfer-Encoding: base64\n\ngDUw\n") == [("to", "x"), ("body", "€50")]
    assert mail(spark, "no header here") == [("body", "no header here")]
    nested = "inner text"
    for level in range(5):
        nested = f"Content-Type: multipart/mixed; boundary=\"b {level}\"\n\npreamble\n--b {level}\n{nested}\n--b {level}\nContent-Type: text/html\n\n<{level}>\n--b {level}--\nepilogue"
    got = mail(spark, f"Cc: c\n{nested}\n")
    assert got[0] == ("cc", "c") and sorted(v for _, v in got[1:]) == sorted(["inner text", *[f"<{k}>" for k in range(5)]])
    assert any("inner text" in v and "--b 2" in v for _, v in mail(spark, f"Cc: c\n{nested}\n", levels=2))  # deeper parts come undivided


def plain_scrub(text):
    def walk(v):
        if isinstance(v, dict):
            return {k: "[REDACTED]" if k.lower() in M.SENSITIVE_KEYS else walk(x) for k, x in v.items()}
        return [walk(x) for x in v] if isinstance(v, list) else v

    try:
        return json.dumps(walk(json.loads(text)), sort_keys=True, ensure_ascii=False, separators=(",", ":"))
    except ValueError:
        return "[invalid json]"


def test_scrub_json_against_plain_recursion(spark):
    rnd = random.Random(3)

    def value(depth):
        kind = rnd.random()
        if depth < 6 and kind < 0.4:
            keys = rnd.sample(["token", "Password", "a", "b", "pan", "x\"y", "k{e", "API_KEY", "é"], rnd.randint(0, 5))
            return {k: value(depth + 1) for k in keys}
        if depth < 6 and kind < 0.6:
            return [value(depth + 1) for _ in range(rnd.randint(0, 4))]
        return rnd.choice([1, -20, True, None, "s", "", '"token":{', "\\", "a\"]}", ',"pan":[1', "é\n"])

    texts = [json.dumps(value(0), ensure_ascii=rnd.random() < 0.5) for _ in range(400)] + ["{", "", "nope", '{"a":1'] + ['"token"', "7"]
    deep = '{"a":' * 60 + '{"token":[[{"pan":{}}]]}' + "}" * 60
    large = json.dumps({"token": ["x" * 1000] * 400, "z": ["y" * 1000] * 400})
    rows = spark.createDataFrame([(t,) for t in [*texts, deep, large, None]], "t string").select("t", M.scrub_json(F.col("t")).alias("s")).collect()
    for r in rows:
        assert r["s"] == (None if r["t"] is None else plain_scrub(r["t"])), r["t"][:300]


def test_sources_fail_alone_and_are_taken_over(spark, tmp_path):
    good = spark.createDataFrame([("PAN ABCPE1234F", "f", "t.1")], "value string, field_name string, source_path string")
    reads = []

    def broken(s):
        reads.append("broken")
        return good.union(good.select(F.raise_error(F.lit("torn file")).cast("string"), "field_name", "source_path"))

    sources = [Source("a", "h", lambda s: reads.append("a") or good, ["PAN"]), Source("b", "h", broken, ["PAN"])]
    found, status = scan_each(spark, sources, folder=str(tmp_path / "s"))
    rows = {r["source_type"]: r for r in status.collect()}
    assert rows["a"]["status"] == "ok" and rows["a"]["findings"] == 1 and rows["b"]["status"] == "failed" and "torn file" in rows["b"]["error"]
    assert {r["data_source"] for r in found.collect()} == {"a"}
    sources[1] = Source("b", "h", lambda s: good, ["PAN"])
    found, status = scan_each(spark, sources, folder=str(tmp_path / "s"))
    assert reads.count("a") == 1 and {r["data_source"] for r in found.collect()} and status.filter("status = 'ok'").count() == 2


def test_upsert_writes_touched_buckets_only(spark, tmp_path, monkeypatch):
    rows = spark.range(20_000).selectExpr("id", "id * 2 AS v", "1 AS version")
    table = VersionedTable(spark, str(tmp_path), ["id"], buckets=512)
    table.create(rows)
    before = table._places(0)
    touched = table.upsert(spark.createDataFrame([(i, -1, 2) for i in (5, 6, 7, 30_000)] + [(8, -1, 0)], rows.schema), "version")
    after = table._places(1)
    assert len(touched) <= 5 and {b for b in after if after[b] != before.get(b)} == set(touched)
    new = {r["id"]: r["v"] for r in table.read(rows.schema).collect()}
    assert len(new) == 20_001 and all(new[i] == -1 for i in (5, 6, 7, 30_000)) and new[8] == 16
    # a write that is killed before it commits leaves the last version as it is
    monkeypatch.setattr(VersionedTable, "_commit", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
    with pytest.raises(RuntimeError):
        table.upsert(spark.createDataFrame([(5, -9, 9)], rows.schema), "version")
    assert {r["id"]: r["v"] for r in table.read(rows.schema).collect()} == new
    assert table.read(rows.schema, 0).filter("id = 5").first()["v"] == 10
