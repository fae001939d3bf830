"""Manifest queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casework.functions.text import input_hash
from casework.operators import manifest as m
from casework.operators.search import facets
from casework.shared import ranked, table


def _records(spark: SparkSession, d: str) -> DataFrame:
    return m.distinct_records(table(spark, d, "manifest"))


def manifest_build(spark, d):
    ext = m.extension_of(F.col("path"))
    return _records(spark, d).select(
        "path", "sha256", "size", ext.alias("extension"), m.mime_of(ext).alias("mime_type"), m.doctype_of(m.mime_of(ext), ext).alias("doctype"), m.custodian_of(F.col("path")).alias("custodian")
    ).dropDuplicates()


def doctype_classify(spark, d):
    return _records(spark, d).groupBy(m.doctype_of(F.col("mime_type"), F.col("extension")).alias("classified"), "doctype").agg(F.count(F.lit(1)).alias("n"))


def custodian_extract(spark, d):
    return _records(spark, d).groupBy(m.custodian_of(F.col("path")).alias("from_path")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("custodian").alias("spellings"))


def dedupe_first_by_hash(spark, d):
    return m.first_by_hash(_records(spark, d)).select(F.lower("sha256").alias("sha256"), "path", "size")


def duplicate_hash_groups(spark, d):
    return m.duplicate_groups(_records(spark, d))


def deterministic_order(spark, d):
    r = _records(spark, d).select("sha256", "path").dropDuplicates()
    return ranked(r, ["sha256", "path"]).select("rank", "sha256", "path")


def input_set_hash(spark, d):
    return table(spark, d, "attorney_list").select("list_id", input_hash(F.array_distinct("attorneys")).alias("input_hash")).dropDuplicates()


def impact_summary(spark, d):
    r = _records(spark, d)
    n, u = F.count(F.lit(1)), F.countDistinct(F.lower("sha256"))
    return r.agg(n.alias("discovered"), u.alias("unique_files"), (n - u).alias("duplicates"), F.sum("size").alias("bytes"))


def _by(spark, d, *cols):
    """One level of the rollup alone."""
    r = _records(spark, d).select(
        m.named("custodian", "unknown").alias("custodian"), m.named("doctype", "other").alias("doctype"), F.lower("extension").alias("extension"), "size"
    )
    return r.groupBy(*cols).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def impact_by_custodian(spark, d):
    return _by(spark, d, "custodian")


def impact_by_custodian_doctype(spark, d):
    return _by(spark, d, "custodian", "doctype")


def impact_by_doctype(spark, d):
    return _by(spark, d, "doctype")


def impact_by_extension(spark, d):
    return _by(spark, d, "extension")


def impact_grouping_sets(spark, d):
    return m.rollup(_records(spark, d))


def date_range_span(spark, d):
    r = _records(spark, d).agg(F.min("mtime").alias("earliest"), F.max("mtime").alias("latest"))
    return r.select("earliest", "latest", F.datediff(F.substring("latest", 1, 10).cast("date"), F.substring("earliest", 1, 10).cast("date")).cast("long").alias("days"))


def size_distribution(spark, d):
    return _records(spark, d).groupBy(m.size_bucket(F.col("size")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def facets_distinct(spark, d):
    return facets(_records(spark, d))


def csv_report_rows(spark, d):
    return m.csv_rows(_records(spark, d))


def dat_loadfile_lines(spark, d):
    return m.dat_lines(_records(spark, d))


def safe_manifest(spark, d):
    return m.safe(_records(spark, d))


def detection_gate(spark, d):
    r = _records(spark, d)
    return r.groupBy(F.coalesce(m.detectable(F.col("mime_type"), F.col("extension"), F.col("size")), F.lit("detect")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def schema_violations(spark, d):
    return m.violations(_records(spark, d)).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


def hash_check(spark, d):
    """The manifest held against the files after a sixteenth of them went and another changed."""
    h = F.substring(F.sha2("path", 256), 1, 1)
    files = table(spark, d, "payloads").select("path", "sha256").unionAll(table(spark, d, "dense_docs").select("path", "sha256"))
    files = files.where(h != "0").withColumn("sha256", F.when(h == "1", F.reverse("sha256")).otherwise(F.col("sha256")))
    return m.hash_check(table(spark, d, "manifest"), files)


def latest_record(spark, d):
    """Late and repeated manifest rows settled: the last one produced of each path."""
    from pyspark.sql import Window

    r = table(spark, d, "manifest").select("path", "sha256", "size", "produced_at").dropDuplicates()
    w = Window.partitionBy("path").orderBy(F.desc("produced_at"), "sha256")
    return r.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def ocr_preflight(spark, d):
    p = table(spark, d, "page_analysis").dropDuplicates()
    return p.groupBy("path").agg(
        F.count(F.lit(1)).alias("pages"), F.count_if("needs_ocr").alias("ocr_pages"), F.sum("text_length").alias("chars"), F.count_if(F.col("text_length") <= 10).alias("short_pages")
    )


def ocr_quality(spark, d):
    """How the rule 'no text layer' meets needs_ocr: the confusion counts with their rates."""
    p = table(spark, d, "page_analysis").dropDuplicates().select(F.expr("not has_text_layer").alias("said"), F.col("needs_ocr").alias("truth"))
    c = p.agg(*[F.count_if(F.expr(e)).alias(n) for n, e in (("tp", "said and truth"), ("fp", "said and not truth"), ("fn", "not said and truth"), ("tn", "not said and not truth"))])
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    p_, r_ = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return c.select("tp", "fp", "fn", "tn", p_.alias("prec"), r_.alias("rec"), ratio(2 * p_ * r_, p_ + r_).alias("f1"))


QUERIES = {
    f.__name__: f
    for f in (
        manifest_build, doctype_classify, custodian_extract, dedupe_first_by_hash, duplicate_hash_groups, deterministic_order, input_set_hash,
        impact_summary, impact_by_custodian, impact_by_custodian_doctype, impact_by_doctype, impact_by_extension, impact_grouping_sets,
        date_range_span, size_distribution, facets_distinct, csv_report_rows, dat_loadfile_lines, safe_manifest, detection_gate,
        schema_violations, hash_check, latest_record, ocr_preflight, ocr_quality,
    )
}

_R = "WITH r AS (SELECT DISTINCT * FROM manifest) "
_EXT = "regexp_extract(path, '(?:^|/)\\.*[^./][^/]*(\\.[^./]+)$', 1)"
_MAP = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in m.EXTENSION_TYPES.items()) + "}"
_MIME = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in m.EXTENSION_MIMES.items()) + "}"
_CUST = "nullif(regexp_extract(path, '(?i)(?:^|/)(?:custodians|users|custodian|user)/([^/]+)', 1), '')"


def _type(mime: str, ext: str) -> str:
    whens = " ".join(f"WHEN starts_with({mime}, '{k}') THEN '{v}'" for k, v in m.MIME_TYPES)
    return f"CASE {whens} ELSE {_MAP}[lower({ext})] END"


def _names(c: str) -> str:
    return "(" + ", ".join(f"'{x}'" for x in c) + ")"


_C, _T = "coalesce(nullif(custodian, ''), 'unknown')", "coalesce(nullif(doctype, ''), 'other')"
_AGG = "count(*) AS n, CAST(coalesce(sum(size), 0) AS BIGINT) AS bytes"
_BLANK = lambda c: f"coalesce(CAST({c} AS VARCHAR), '')"
SQL = {
    "manifest_build": f"{_R}SELECT DISTINCT path, sha256, size, {_EXT} AS extension, {_MIME}[lower({_EXT})] AS mime_type, {_type(f'{_MIME}[lower({_EXT})]', _EXT)} AS doctype, {_CUST} AS custodian FROM r",
    "doctype_classify": f"{_R}SELECT {_type('mime_type', 'extension')} AS classified, doctype, count(*) AS n FROM r GROUP BY 1, 2",
    "custodian_extract": f"{_R}SELECT {_CUST} AS from_path, count(*) AS n, count(DISTINCT custodian) AS spellings FROM r GROUP BY 1",
    "dedupe_first_by_hash": f"{_R}SELECT sha256, path, size FROM (SELECT lower(sha256) AS sha256, path, size, row_number() OVER (PARTITION BY lower(sha256) ORDER BY path) AS k FROM r WHERE sha256 IS NOT NULL) WHERE k = 1",
    "duplicate_hash_groups": f"{_R}SELECT lower(sha256) AS sha256, count(DISTINCT path) AS n, min(path) AS first_path FROM r WHERE sha256 IS NOT NULL GROUP BY 1 HAVING count(DISTINCT path) > 1",
    "deterministic_order": "SELECT row_number() OVER (ORDER BY sha256, path) AS rank, sha256, path FROM (SELECT DISTINCT sha256, path FROM manifest)",
    "input_set_hash": "SELECT DISTINCT list_id, sha256(array_to_string(list_sort(list_distinct(attorneys)), chr(10))) AS input_hash FROM attorney_list",
    "impact_summary": f"{_R}SELECT count(*) AS discovered, count(DISTINCT lower(sha256)) AS unique_files, count(*) - count(DISTINCT lower(sha256)) AS duplicates, CAST(sum(size) AS BIGINT) AS bytes FROM r",
    "impact_by_custodian": f"{_R}SELECT {_C} AS custodian, {_AGG} FROM r GROUP BY 1",
    "impact_by_custodian_doctype": f"{_R}SELECT {_C} AS custodian, {_T} AS doctype, {_AGG} FROM r GROUP BY 1, 2",
    "impact_by_doctype": f"{_R}SELECT {_T} AS doctype, {_AGG} FROM r GROUP BY 1",
    "impact_by_extension": f"{_R}SELECT lower(extension) AS extension, {_AGG} FROM r GROUP BY 1",
    "impact_grouping_sets": f"""{_R}, s AS (SELECT {_C} AS custodian, {_T} AS doctype, lower(extension) AS extension, size FROM r)
SELECT 3 AS level, custodian, NULL AS doctype, NULL AS extension, {_AGG} FROM s GROUP BY custodian
UNION ALL SELECT 1, custodian, doctype, NULL, {_AGG} FROM s GROUP BY custodian, doctype
UNION ALL SELECT 5, NULL, doctype, NULL, {_AGG} FROM s GROUP BY doctype
UNION ALL SELECT 6, NULL, NULL, extension, {_AGG} FROM s GROUP BY extension
UNION ALL SELECT 7, NULL, NULL, NULL, {_AGG} FROM s""",
    "date_range_span": f"{_R}SELECT min(mtime) AS earliest, max(mtime) AS latest, date_diff('day', CAST(substr(min(mtime), 1, 10) AS DATE), CAST(substr(max(mtime), 1, 10) AS DATE)) AS days FROM r",
    "size_distribution": f"{_R}SELECT CASE WHEN size < 1048576 THEN 'under_1mb' WHEN size <= 10485760 THEN '1mb_to_10mb' ELSE 'over_10mb' END AS bucket, count(*) AS n FROM r GROUP BY 1",
    "facets_distinct": f"{_R}SELECT 'custodian' AS facet, custodian AS value, count(*) AS n FROM r WHERE custodian IS NOT NULL AND custodian NOT IN ('', 'unknown') GROUP BY 2 UNION ALL SELECT 'doctype', doctype, count(*) FROM r WHERE doctype IS NOT NULL AND doctype NOT IN ('', 'unknown') GROUP BY 2",
    "csv_report_rows": f"{_R}SELECT substr(sha256, 1, 16) AS DOCID, " + ", ".join(f"{_BLANK(c)} AS {a}" for c, a in (("path", "PATH"), ("sha256", "SHA256"), ("size", "SIZE_BYTES"), ("mime_type", "MIME_TYPE"), ("doctype", "DOCTYPE"), ("custodian", "CUSTODIAN"), ("metadata['pages']", "PAGES"), ("metadata['createdate']", "CREATEDATE"), ("metadata['modifydate']", "MODIFYDATE"), ("produced_at", "PRODUCED_AT"), ("producer", "PRODUCER"))) + " FROM r",
    "dat_loadfile_lines": f"{_R}SELECT path, " + " || '|' || ".join(f"replace({_BLANK(c)}, '|', '\\|')" for c in m.DAT_FIELDS) + " AS line FROM r",
    "safe_manifest": f"{_R}SELECT sha256, size, mime_type, extension, doctype, 'REDACTED' AS custodian FROM r",
    "detection_gate": f"""{_R}SELECT CASE WHEN NOT coalesce(lower(extension) IN {_names(m.DETECTABLE_EXTENSIONS)}, false) THEN 'extension_not_detectable:' || coalesce(lower(extension), '')
WHEN NOT coalesce(lower(mime_type) IN {_names(m.DETECTABLE_MIMES)}, false) THEN 'mime_not_detectable:' || coalesce(lower(mime_type), '')
WHEN size > 104857600 THEN 'exceeds_max_size:' || (size // 1048576) || 'MB' ELSE 'detect' END AS reason, count(*) AS n FROM r GROUP BY 1""",
    "schema_violations": f"""{_R}, v AS (
SELECT 'path_missing' AS rule FROM r WHERE path IS NULL OR path = ''
UNION ALL SELECT 'path_relative' FROM r WHERE NOT starts_with(path, '/')
UNION ALL SELECT 'sha256_malformed' FROM r WHERE NOT regexp_matches(sha256, '^[0-9a-f]{{64}}$')
UNION ALL SELECT 'sha256_missing' FROM r WHERE sha256 IS NULL
UNION ALL SELECT 'size_negative' FROM r WHERE size < 0
UNION ALL SELECT 'extension_case' FROM r WHERE extension <> lower(extension)
UNION ALL SELECT 'doctype_missing' FROM r WHERE doctype IS NULL
UNION ALL SELECT 'custodian_missing' FROM r WHERE custodian IS NULL) SELECT rule, count(*) AS n FROM v GROUP BY 1""",
    "hash_check": """WITH f AS (SELECT path, min(lower(sha256)) AS have FROM (SELECT path, CASE WHEN sha256(path)[1] = '1' THEN reverse(sha256) ELSE sha256 END AS sha256 FROM (SELECT path, sha256 FROM payloads UNION ALL SELECT path, sha256 FROM dense_docs) WHERE sha256(path)[1] <> '0') GROUP BY 1),
w AS (SELECT path, min(lower(sha256)) AS want FROM manifest GROUP BY 1)
SELECT path, CASE WHEN have IS NULL THEN 'missing' ELSE 'hash_mismatch' END AS state FROM w LEFT JOIN f USING (path) WHERE have IS NULL OR have <> want""",
    "latest_record": "SELECT path, sha256, size, produced_at FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY produced_at DESC, sha256) AS k FROM (SELECT DISTINCT path, sha256, size, produced_at FROM manifest)) WHERE k = 1",
    "ocr_preflight": "SELECT path, count(*) AS pages, count(*) FILTER (needs_ocr) AS ocr_pages, CAST(sum(text_length) AS BIGINT) AS chars, count(*) FILTER (text_length <= 10) AS short_pages FROM (SELECT DISTINCT * FROM page_analysis) GROUP BY 1",
    "ocr_quality": """WITH c AS (SELECT count(*) FILTER (NOT has_text_layer AND needs_ocr) AS tp, count(*) FILTER (NOT has_text_layer AND NOT needs_ocr) AS fp, count(*) FILTER (has_text_layer AND needs_ocr) AS fn, count(*) FILTER (has_text_layer AND NOT needs_ocr) AS tn FROM (SELECT DISTINCT * FROM page_analysis)),
p AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS prec, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS rec FROM c)
SELECT tp, fp, fn, tn, prec, rec, CASE WHEN prec + rec > 0 THEN 2 * prec * rec / (prec + rec) ELSE 0.0 END AS f1 FROM p""",
}
