"""Manifest operators: classification, ordering, de-duplication, rollups, checks."""

from __future__ import annotations

import mimetypes

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Types by the start of the mime type, then by extension.
MIME_TYPES = (
    ("application/pdf", "pdf"),
    ("application/vnd.openxmlformats-officedocument.wordprocessing", "docx"),
    ("application/msword", "doc"),
    ("text/", "text"),
    ("image/", "image"),
    ("message/", "email"),
)
EXTENSION_TYPES = {
    ".pdf": "pdf", ".docx": "docx", ".doc": "doc", ".txt": "text", ".md": "text", ".ocr": "text", ".png": "image", ".jpg": "image",
    ".jpeg": "image", ".tiff": "image", ".msg": "email", ".eml": "email", ".pst": "email_archive",
}
#: The standard library's table of types by name, with those for notes that older versions lack.
EXTENSION_MIMES = {".md": "text/markdown", ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document"} | mimetypes.MimeTypes().types_map[True]
# What is searched for findings.
DETECTABLE_EXTENSIONS = (
    ".txt", ".csv", ".xml", ".html", ".htm", ".pdf", ".doc", ".docx", ".xls", ".xlsx", ".json", ".yaml", ".yml", ".log", ".md", ".markdown", ".ocr", ".eml", ".msg",
)
DETECTABLE_MIMES = (
    "text/plain", "text/csv", "text/xml", "text/html", "application/pdf", "application/msword", "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "application/vnd.ms-excel", "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", "application/json", "application/x-yaml", "text/x-log",
)
MB = 1024 * 1024


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def mime_of(extension: Column) -> Column:
    return _lookup(EXTENSION_MIMES, F.lower(extension))


def doctype_of(mime: Column, extension: Column) -> Column:
    out = None
    for start, kind in MIME_TYPES:
        c = mime.startswith(start)
        out = F.when(c, kind) if out is None else out.when(c, kind)
    return out.otherwise(_lookup(EXTENSION_TYPES, F.lower(extension)))


def custodian_of(path: Column) -> Column:
    """The path component behind the first one that names custodians or users; null without one."""
    m = F.regexp_extract(path, r"(?i)(?:^|/)(?:custodians|users|custodian|user)/([^/]+)", 1)
    return F.nullif(m, F.lit(""))


def extension_of(path: Column) -> Column:
    """The suffix of the last component; a name that merely begins with dots has none."""
    return F.regexp_extract(path, r"(?:^|/)\.*[^./][^/]*(\.[^./]+)$", 1)


def distinct_records(manifest: DataFrame) -> DataFrame:
    """Rows that merely repeat a row count once (maps do not compare, so their entries are sorted)."""
    if "metadata" not in manifest.columns or manifest.schema["metadata"].dataType.typeName() != "map":
        return manifest.dropDuplicates()
    m = manifest.withColumn("_m", F.array_sort(F.map_entries("metadata")))
    return m.dropDuplicates([c for c in m.columns if c != "metadata"]).drop("_m")


def first_by_hash(records: DataFrame) -> DataFrame:
    """The first record of each hash, by path; null hashes are kept apart and left out."""
    w = Window.partitionBy(F.lower("sha256")).orderBy("path")
    return records.where("sha256 is not null").withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def duplicate_groups(records: DataFrame) -> DataFrame:
    """Hashes of more than one path: sha256, n, first_path."""
    return (
        records.where("sha256 is not null")
        .groupBy(F.lower("sha256").alias("sha256"))
        .agg(F.countDistinct("path").alias("n"), F.min("path").alias("first_path"))
        .where("n > 1")
    )


def named(c: str, other: str) -> Column:
    return F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(other))


def rollup(records: DataFrame) -> DataFrame:
    """All rollups in one pass: by custodian, custodian and doctype, doctype, extension, and in all.

    Columns: level, custodian, doctype, extension, n, bytes.
    """
    r = records.select(
        named("custodian", "unknown").alias("custodian"), named("doctype", "other").alias("doctype"), F.lower("extension").alias("extension"), "size"
    )
    g = r.groupingSets(
        [["custodian"], ["custodian", "doctype"], ["doctype"], ["extension"], []], "custodian", "doctype", "extension"
    ).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.grouping_id().alias("level"))
    return g.select("level", "custodian", "doctype", "extension", "n", "bytes")


def size_bucket(size: Column) -> Column:
    return F.when(size < MB, "under_1mb").when(size <= 10 * MB, "1mb_to_10mb").otherwise("over_10mb")


def detectable(mime: Column, extension: Column, size: Column, most: int = 100 * MB) -> Column:
    """Why a document is not searched for findings; null where it is.  Extension, type, size, in this order."""
    e, m = F.lower(extension), F.lower(mime)
    return (
        F.when(~F.coalesce(e.isin(*DETECTABLE_EXTENSIONS), F.lit(False)), F.concat(F.lit("extension_not_detectable:"), F.coalesce(e, F.lit(""))))
        .when(~F.coalesce(m.isin(*DETECTABLE_MIMES), F.lit(False)), F.concat(F.lit("mime_not_detectable:"), F.coalesce(m, F.lit(""))))
        .when(size > most, F.concat(F.lit("exceeds_max_size:"), F.floor(size / MB).cast("string"), F.lit("MB")))
    )


def violations(manifest: DataFrame) -> DataFrame:
    """path, rule of every broken rule of a manifest record."""
    rules = {
        "path_missing": F.col("path").isNull() | (F.col("path") == ""),
        "path_relative": ~F.col("path").startswith("/"),
        "sha256_malformed": ~F.col("sha256").rlike("^[0-9a-f]{64}$"),
        "sha256_missing": F.col("sha256").isNull(),
        "size_negative": F.col("size") < 0,
        "extension_case": F.col("extension") != F.lower("extension"),
        "doctype_missing": F.col("doctype").isNull(),
        "custodian_missing": F.col("custodian").isNull(),
    }
    each = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in rules.items()]))
    return manifest.select("path", F.explode(each).alias("rule"))


def safe(records: DataFrame) -> DataFrame:
    """What may leave the house: hashes, sizes and types; no path, custodian masked, addresses masked."""
    from casework.functions.text import mask_emails

    return records.select(
        "sha256", "size", "mime_type", "extension", mask_emails(F.col("doctype")).alias("doctype"), F.lit("REDACTED").alias("custodian")
    )


def hash_check(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """path, state of manifest paths that are missing in ``files`` (path, sha256) or whose hash differs."""
    m = manifest.groupBy("path").agg(F.min(F.lower("sha256")).alias("want"))
    f = files.groupBy("path").agg(F.min(F.lower("sha256")).alias("have"))
    state = F.when(F.col("have").isNull(), "missing").when(F.col("have") != F.col("want"), "hash_mismatch")
    return m.join(f, "path", "left").select("path", state.alias("state")).where("state is not null")


def csv_rows(records: DataFrame) -> DataFrame:
    """The twelve columns of the CSV report; '' for what is missing."""
    blank = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    meta = lambda k: blank(F.element_at("metadata", k))
    return records.select(
        F.substring("sha256", 1, 16).alias("DOCID"), blank(F.col("path")).alias("PATH"), blank(F.col("sha256")).alias("SHA256"),
        blank(F.col("size")).alias("SIZE_BYTES"), blank(F.col("mime_type")).alias("MIME_TYPE"), blank(F.col("doctype")).alias("DOCTYPE"),
        blank(F.col("custodian")).alias("CUSTODIAN"), meta("pages").alias("PAGES"), meta("createdate").alias("CREATEDATE"),
        meta("modifydate").alias("MODIFYDATE"), blank(F.col("produced_at")).alias("PRODUCED_AT"), blank(F.col("producer")).alias("PRODUCER"),
    )


DAT_FIELDS = ("sha256", "sha256", "sha256", "custodian", "doctype", "path", "extension", "size", "mtime", "sha256")


def dat_lines(records: DataFrame) -> DataFrame:
    """path, line: the pipe-delimited load file lines of the records, pipes escaped."""
    value = lambda c: F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|"))
    return records.select("path", F.concat_ws("|", *[value(c) for c in DAT_FIELDS]).alias("line"))
