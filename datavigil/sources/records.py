"""Field records: the shape every source is brought into before detection.

A record is `value`, `field_name`, `source_path`, `row_context`, `is_structured` and `metadata`, one per non-empty cell,
line, message or file.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from datavigil.functions import markup as M
from datavigil.functions.text import let

COLUMNS = ["value", "field_name", "source_path", "row_context", "is_structured", "metadata"]

# Extensions read as text in object stores, and in directories.
TEXT_EXTENSIONS = [".txt", ".csv", ".json", ".xml", ".log", ".md", ".yaml", ".yml", ".html", ".htm", ".tsv"]

# E-mail headers kept.
MAIL_HEADERS = ["From", "To", "Cc", "Subject", "Reply-To"]

# Schemas that hold no user tables.
SYSTEM_SCHEMAS = {
    "postgresql": ["pg_catalog", "information_schema"],
    "mysql": ["information_schema", "mysql", "performance_schema", "sys"],
    "sqlserver": ["sys", "INFORMATION_SCHEMA"],
}


SPREAD_BELOW = 1 << 30


def spread_small(df: DataFrame) -> DataFrame:
    """Even out an input that the optimizer sizes below one GiB, which may be one file with a single row group.

    Detection costs far more than reading, so small inputs gain from a round of shuffling; larger ones already come in
    many splits and are left where they are.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if size < SPREAD_BELOW else df


def spread_few(df: DataFrame) -> DataFrame:
    """Even out an input whose rows come in fewer splits than there are cores: a file with one row group is read by one task,
    whatever its size. The splits are counted without reading a column."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    splits = df.groupBy(F.spark_partition_id()).count().count()
    return df if splits >= cores else df.repartition(4 * cores)


def _as_record(df: DataFrame, keep, value, field, path, structured: bool, context=None, metadata=None) -> DataFrame:
    none_map = F.lit(None).cast("map<string,string>")
    return df.select(
        *keep, value.alias("value"), field.alias("field_name"), path.alias("source_path"),
        (F.lit(None).cast("string") if context is None else context).alias("row_context"),
        F.lit(structured).alias("is_structured"), (none_map if metadata is None else metadata).alias("metadata"),
    ).filter(F.col("value").isNotNull() & (F.col("value") != ""))


def field_records(
    df: DataFrame, source: str, columns: list[str] | None = None, id_cols: list[str] = (), path: Column | None = None
) -> DataFrame:
    """Unpivot a table: one record per non-empty cell, path `source.column`, the sibling cells as row context."""
    columns = columns or [f.name for f in df.schema.fields if f.name not in id_cols]
    cells = df.select(
        *id_cols, *([path.alias("_path")] if path is not None else []),
        F.concat_ws(" ", *[F.col(c).cast("string") for c in columns]).alias("_row"),
        F.inline(F.array(*[
            F.struct(F.lit(c).alias("_name"), F.col(c).cast("string").alias("_cell")) for c in columns])),
    )
    prefix = F.col("_path") if path is not None else F.lit(source)
    return _as_record(cells, list(id_cols), F.col("_cell"), F.col("_name"),
                      F.concat(prefix, F.lit("."), F.col("_name")), True, F.col("_row"))


def scan_parquet(spark: SparkSession, path: str, row_key: str | None = None) -> DataFrame:
    return _file_rows(spark.read.parquet(path), row_key)


def scan_orc(spark: SparkSession, path: str, row_key: str | None = None) -> DataFrame:
    return _file_rows(spark.read.orc(path), row_key)


def scan_avro(spark: SparkSession, path: str, row_key: str | None = None) -> DataFrame:
    """Needs the spark-avro package on the session's class path."""
    return _file_rows(spark.read.format("avro").load(path), row_key)


def scan_csv(spark: SparkSession, path: str, row_key: str | None = None, sep: str = ",", lines: bool = False) -> DataFrame:
    """Cells may hold line breaks in quotes, so a file is read by one task; with `lines`, files whose rows are lines are split."""
    df = spark.read.csv(path, header=True, sep=sep, ignoreLeadingWhiteSpace=True, mode="PERMISSIVE", multiLine=not lines,
                        escape='"')
    return _file_rows(df, row_key)


def _file_rows(df: DataFrame, row_key: str | None) -> DataFrame:
    """Path `file:row_key.column`; without a key column the row is named by a hash of its cells, which is repeatable."""
    key = F.col(row_key).cast("string") if row_key else F.hex(F.xxhash64(*df.columns))
    path = F.concat(F.col("_metadata.file_path"), F.lit(":row_"), key)
    return field_records(df, "", columns=df.columns, path=path)


def scan_text(spark: SparkSession, path: str, extensions: list[str] | None = None, max_bytes: int | None = None) -> DataFrame:
    """One record per non-empty line, path `file:line_n`. Files of any size are read in splits.

    A first pass counts the lines of each split, their sums over a file's earlier splits are where a split's numbers begin,
    and inside a split the rows come in order. Only the numbers of splits are summed, one row for each.
    """
    raw = spark.read.option("recursiveFileLookup", "true").text(path, lineSep="\n")
    rows = raw.select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"),
                      F.col("_metadata.file_size").alias("_size"), F.monotonically_increasing_id().alias("_id"))
    if extensions is not None:
        rows = rows.filter(_has_extension(F.col("_file"), extensions))
    if max_bytes is not None:
        rows = rows.filter(F.col("_size") <= max_bytes)
    splits = rows.groupBy("_file", "_start").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy("_file").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    lines = rows.join(splits.drop("_n"), ["_file", "_start"])
    number = F.col("_before") + F.col("_id") - F.col("_first") + 1
    return _as_record(lines, [], F.regexp_replace("value", r"\r\z", ""), F.lit("line"),
                      F.concat(F.col("_file"), F.lit(":line_"), number.cast("string")), False)


def listed_files(spark: SparkSession, folder: str, max_bytes: int | None = None, extensions: list[str] = TEXT_EXTENSIONS) -> DataFrame:
    """(source_path, size, status) of every file under a folder: `read`, `too_large` or `no_text`. Contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length")
    status = F.when(~_has_extension(F.col("path"), extensions), "no_text")
    if max_bytes is not None:
        status = status.when(F.col("length") > max_bytes, "too_large")
    return files.select(F.col("path").alias("source_path"), F.col("length").alias("size"), status.otherwise("read").alias("status"))


def scan_files(spark: SparkSession, folder: str, max_bytes: int | None = None, extensions: list[str] = TEXT_EXTENSIONS,
               by: str = "line") -> DataFrame:
    """Records of the text files under a folder, named by the file: one per line, as in scan_text and for files of any size,
    or one per `file`, whose whole text is then in one row.

    Files above max_bytes are skipped by their listed size, unread; without it none is. listed_files has a row for each.
    """
    if by == "file":
        files = spark.read.text(folder, wholetext=True, recursiveFileLookup=True).select(
            "value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_size").alias("_size"))
        kept = files.filter(_has_extension(F.col("_file"), extensions))
        if max_bytes is not None:
            kept = kept.filter(F.col("_size") <= max_bytes)
        return _as_record(kept, [], F.col("value"), F.substring_index("_file", "/", -1), F.col("_file"), False)
    lines = scan_text(spark, folder, extensions, max_bytes=max_bytes)
    return lines.withColumn("field_name", F.regexp_extract("source_path", r"([^/]*):line_[0-9]+\z", 1))


def scan_objects(spark: SparkSession, uri: str, extensions: list[str] = TEXT_EXTENSIONS, max_bytes: int | None = None,
                 by: str = "line") -> DataFrame:
    """Text-like objects under an object-store prefix (`s3a://`, `gs://`, or any Hadoop path), as scan_files reads them."""
    return scan_files(spark, uri, max_bytes, extensions, by)


def _has_extension(path: Column, extensions) -> Column:
    return F.lower(path).rlike("(?:" + "|".join(e.replace(".", r"\.") for e in extensions) + r")\z")


# White space of the standard, at the ends of a line of text.
_BLANK = " \t\n\x0b\x0c\r\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def html_text(df: DataFrame, html_col: str, source_path: Column, keep: list[str] = ()) -> DataFrame:
    """Text lines of a page: comments, scripts and styles dropped, closed or not, tags become line ends, also those with ">" in
    quotes, and all named and numeric character references are decoded. A line is generated when it is decoded, so that it is
    decoded once, whatever names it."""
    parts = F.array_remove(F.split(M.markup_text(F.col(html_col)), "\n"), "")
    lines = df.select(*keep, source_path.alias("_path"), F.explode(parts).alias("_line"))
    bare = F.btrim(M.decode_entities(F.col("_line")), F.lit(_BLANK))
    cells = lines.select(*keep, "_path", F.explode(F.array(bare)).alias("_text"))
    return _as_record(cells, list(keep), F.col("_text"), F.lit("text"), F.col("_path"), False)


def _mail_header(head: Column, name: str) -> Column:
    """Value of a header field in unfolded header lines; empty if it is not there."""
    return F.trim(F.regexp_extract(head, rf"(?im)^{name}:([^\n]*+)$", 1))


def _headed(text: Column, name: str) -> Column:
    """Header and body of a message or part: the part up to the first empty line, if it begins with a header field. Folded
    header lines are joined. The line end before a boundary is none of the body's."""
    def fields(head: Column, body: Column, kind: Column) -> Column:
        boundary = r"""(?i);\s*boundary=(?:"([^"]*+)"|([^;\s]*+))"""
        return F.struct(
            F.lit(name).alias("name"), F.lit(":body").alias("suffix"), head.alias("head"), F.regexp_replace(body, r"\n\z", "").alias("body"),
            F.lower(F.regexp_extract(kind, r"^([^;\s]*+)", 1)).alias("kind"),
            F.coalesce(F.nullif(F.regexp_extract(kind, boundary, 1), F.lit("")), F.regexp_extract(kind, boundary, 2)).alias("boundary"),
            F.regexp_extract(kind, r"""(?i);\s*charset="?([^";\s]*+)""", 1).alias("charset"),
            _mail_header(head, "content-transfer-encoding").alias("encoding"))

    def divided(cut: Column) -> Column:
        head = F.regexp_replace(F.get(cut, F.lit(0)), r"\n[ \t]+", " ")
        return let(head, lambda h: let(_mail_header(h, "content-type"), lambda kind: fields(
            h, F.coalesce(F.get(cut, F.lit(1)), F.lit("")), kind)))

    bare = fields(F.lit(""), F.regexp_replace(text, r"\A\n", ""), F.lit(""))
    return F.when(text.rlike(r"\A[!-9;-~]++[ \t]*+:"), let(F.split(text, r"(?<=\n)\n", 2), divided)).otherwise(bare)


def email_fields(df: DataFrame, raw_col: str, source_path: Column, keep: list[str] = (), levels: int = 8) -> DataFrame:
    """Header fields and text bodies of raw messages.

    Multipart bodies are split at their boundary, level by level, what stands before the first and behind the closing boundary
    dropped; of the parts those of text, or without a content type, are records, decoded by their transfer encoding and
    charset. A single body counts if it is text or names no type. Parts nested deeper than `levels` come undivided.

    One pass: a level turns each divided part into its parts and hands on the others. Every step is generated, so that it is
    computed once, whatever names its results.
    """
    raw = F.concat(F.regexp_replace(F.col(raw_col), r"\r\n", "\n"), F.lit("\n"))
    whole = df.select(*keep, source_path.alias("_path"), F.explode(F.array(_headed(raw, "body"))).alias("_part"))
    headers = [F.struct(
        F.lit(h.lower()).alias("name"), F.lit(f":header.{h}").alias("suffix"), F.lit("").alias("head"),
        _mail_header(F.col("_part.head"), h).alias("body"), *[F.lit("").alias(f) for f in ("kind", "boundary", "charset", "encoding")])
        for h in MAIL_HEADERS]
    rows = whole.select(*keep, "_path", F.explode(F.array(*headers, F.col("_part"))).alias("_part")).filter("_part.body <> ''")
    kind, boundary = F.col("_part.kind"), F.col("_part.boundary")
    divided = kind.startswith("multipart/") & (boundary != "")
    mark = F.concat(F.lit(r"\n--\Q"), boundary, F.lit(r"\E"))
    open_ = F.get(F.split(F.concat(F.lit("\n"), F.col("_part.body"), F.lit("\n")), F.concat(mark, F.lit(r"--[ \t]*\n")), 2), F.lit(0))
    pieces = F.split(F.concat(open_, F.lit("\n")), F.concat(mark, F.lit(r"[ \t]*(?=\n)")))
    inner = let(pieces, lambda p: F.transform(F.slice(p, 2, F.size(p)), lambda t: let(
        F.regexp_replace(t, r"\A\n", ""), lambda piece: _headed(piece, "body_part"))))
    for _ in range(levels):
        rows = rows.select(*keep, "_path", F.explode(F.when(divided, inner).otherwise(F.array("_part"))).alias("_part"))
    text = (kind == "") | kind.startswith("text/") | kind.startswith("multipart/")
    body = M.transfer_decoded(F.col("_part.body"), F.col("_part.encoding"), F.col("_part.charset"))
    cells = rows.filter(text).select(*keep, F.concat("_path", "_part.suffix").alias("_path"), "_part.name", F.explode(F.array(body)).alias("_text"))
    return _as_record(cells, list(keep), F.col("_text"), F.col("name"), F.col("_path"), False)


def scan_jdbc(
    spark: SparkSession, url: str, tables: list[str] | None = None, fraction: float | None = None,
    partition: dict[str, dict[str, str]] | None = None, **options: str,
) -> dict[str, DataFrame]:
    """Readers of relational tables, listed from the catalog if not named; sampling runs in the database when given.

    `partition` names per table the `partitionColumn`, `lowerBound`, `upperBound` and `numPartitions` of a parallel read.
    """
    kind = url.split(":")[1]

    def reader(table, **extra):
        return spark.read.format("jdbc").options(url=url, dbtable=table, **options, **extra)

    if tables is None:
        hidden = ", ".join(f"'{s}'" for s in SYSTEM_SCHEMAS.get(kind, []))
        listing = "(SELECT table_schema, table_name FROM information_schema.tables" + (
            f" WHERE table_schema NOT IN ({hidden})" if hidden else "") + ") t"
        tables = [f"{r[0]}.{r[1]}" for r in reader(listing).load().collect()]
    sample = {"postgresql": "(SELECT * FROM {t} TABLESAMPLE BERNOULLI ({p})) s",
              "mysql": "(SELECT * FROM {t} WHERE RAND() < {f}) s",
              "sqlserver": "(SELECT * FROM {t} TABLESAMPLE ({p} PERCENT)) s"}
    out = {}
    for t in tables:
        target = t
        if fraction is not None and kind in sample:
            target = sample[kind].format(t=t, p=fraction * 100, f=fraction)
        out[t] = field_records(reader(target, **(partition or {}).get(t, {})).load(), t)
    return out


def flatten_json(
    df: DataFrame, json_col: str, schema: T.StructType | str, source: Column, keep: list[str] = ()
) -> DataFrame:
    """Leaves of a JSON document as records, nested keys dotted. Array elements share the key of the array."""
    if isinstance(schema, str):
        schema = T._parse_datatype_string(schema)
    parsed = df.select(*keep, source.alias("_path"), F.from_json(json_col, schema).alias("_doc"))
    leaves = F.flatten(F.array(*_leaves(F.col("_doc"), schema, "")))
    cells = parsed.select(*keep, "_path", F.inline(leaves))
    return _as_record(cells, list(keep), F.col("_cell"), F.col("_name"), F.concat_ws(".", "_path", "_name"), True)


def _leaves(c: Column, dtype, name: str) -> list[Column]:
    if isinstance(dtype, T.StructType):
        return [leaf for f in dtype.fields
                for leaf in _leaves(c[f.name], f.dataType, f"{name}.{f.name}" if name else f.name)]
    if isinstance(dtype, T.ArrayType):
        if isinstance(dtype.elementType, (T.StructType, T.ArrayType)):
            return [F.flatten(F.coalesce(F.transform(c, lambda e: F.flatten(F.array(
                *_leaves(e, dtype.elementType, name)))), F.array()))]
        return [F.coalesce(F.transform(c, lambda e: _leaf(e, name)), F.array())]
    if isinstance(dtype, T.MapType):
        return [F.coalesce(F.transform(F.map_entries(c), lambda e: F.struct(
            F.concat(F.lit(f"{name}." if name else ""), e["key"]).alias("_name"),
            e["value"].cast("string").alias("_cell"))), F.array())]
    return [F.array(_leaf(c, name))]


def _leaf(c: Column, name: str) -> Column:
    return F.struct(F.lit(name).alias("_name"), c.cast("string").alias("_cell"))


def flatten_open_json(df: DataFrame, json_col: str, source: Column, keep: list[str] = ()) -> DataFrame:
    """Leaves of documents without a known schema, at any depth, nested keys dotted; array elements share the key of the array.

    Documents are variants, opened level by level until no object or array is left; texts that are no JSON give no rows.
    """
    spark = df.sparkSession
    rows = df.select(*keep, source.alias("_path"), F.lit("").alias("_name"), F.try_parse_json(json_col).alias("_open"))
    parts = []
    while True:
        inner = rows.lateralJoin(spark.tvf.variant_explode(F.col("_open").outer()))
        name = F.when(F.col("key").isNull(), F.col("_name")).when(F.col("_name") == "", F.col("key")).otherwise(
            F.concat("_name", F.lit("."), "key"))
        inner = inner.select(*keep, "_path", name.alias("_name"), F.col("value").alias("_open"),
                             F.schema_of_variant("value").rlike("^(?:OBJECT|ARRAY)<").alias("_more"))
        leaf = F.try_variant_get("_open", "$", "string")
        parts.append(_as_record(inner.filter("NOT _more"), list(keep), leaf, F.col("_name"), F.concat_ws(".", "_path", "_name"), True))
        rows = inner.filter("_more").drop("_more")
        if rows.isEmpty():
            return reduce(DataFrame.unionByName, parts)


def scan_kv(df: DataFrame, key_col: str, value_col: str, scheme: str = "redis") -> DataFrame:
    key = F.col(key_col).cast("string")
    return _as_record(df, [], F.col(value_col).cast("string"), key, F.concat(F.lit(f"{scheme}:"), key), False)


def scan_records(
    df: DataFrame, scheme: str, id_cols: list[str], text_cols: dict[str, str], keep: list[str] = ()
) -> DataFrame:
    """Messages, tickets and CRM objects landed as tables: a record per text attribute, path `scheme://id/id`.

    `text_cols` maps a column to the field name it is reported under.
    """
    path = F.concat(F.lit(f"{scheme}://"), F.concat_ws("/", *[F.col(c).cast("string") for c in id_cols]))
    cells = df.select(*keep, path.alias("_path"), F.inline(F.array(*[
        F.struct(F.lit(name).alias("_name"), F.col(c).cast("string").alias("_cell")) for c, name in text_cols.items()])))
    return _as_record(cells, list(keep), F.col("_cell"), F.col("_name"), F.col("_path"), False)
