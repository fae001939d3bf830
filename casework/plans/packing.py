"""Reports, packs and dataset checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casework.operators import manifest as m
from casework.operators import package as k
from casework.operators.detect import PII
from casework.plans.findings import _P, spans_sql
from casework.shared import table


def _records(spark, d) -> DataFrame:
    return m.distinct_records(table(spark, d, "manifest"))


def manifest_hash(spark, d):
    return k.manifest_hash(_records(spark, d))


def dataset_hash(spark, d):
    """An order-free hash of the pages, to compare two runs."""
    return k.dataset_hash(table(spark, d, "page_analysis").select("path", "page", "sha256", "text_length").dropDuplicates())


def schema_counts(spark, d):
    return k.schema_counts(_records(spark, d))


def report_totals(spark, d):
    return k.totals(_records(spark, d))


def production_totals(spark, d):
    """Totals with the range of labels and the number of redaction plans of a production of all records."""
    from casework.operators import produce
    from casework.plans.reviewing import _redactions

    r = _records(spark, d)
    return k.production_totals(r, produce.number(r, prefix="ABC", width=9), _redactions(spark, d)).select("documents", "bates_range", "redactions")


def impact_ratios(spark, d):
    """The share of copies in per cent and the size in MB, both to two places."""
    r = _records(spark, d)
    n, u = F.count(F.lit(1)), F.countDistinct(F.lower("sha256"))
    share = F.when(n > 0, F.round((n - u) * 100.0 / n, 2)).otherwise(0.0)
    return r.agg(n.alias("discovered"), share.alias("dedupe_percent"), F.round(F.sum("size") / F.lit(float(m.MB)), 2).alias("mb"))


def impact_json(spark, d):
    """The impact report's custodians as one line of JSON each, their doctypes by name."""
    r = _records(spark, d).select(m.named("custodian", "unknown").alias("custodian"), m.named("doctype", "other").alias("doctype"), "size")
    g = r.groupBy("custodian", "doctype").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))
    c = g.groupBy("custodian").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), F.array_sort(F.collect_list(F.struct("doctype", "n"))).alias("doctypes"))
    return c.select("custodian", F.to_json(F.struct(F.col("bytes"), F.col("custodian"), F.col("doctypes"), F.col("n"))).alias("line"))


def csv_lines(spark, d):
    """The CSV report's lines, quoted where a field needs it."""
    rows = m.csv_rows(_records(spark, d)).withColumn("NOTE", F.concat(F.lit('of "'), F.col("DOCTYPE"), F.lit('", '), F.col("CUSTODIAN")))
    return rows.select("PATH", k.csv_line(["DOCID", "DOCTYPE", "CUSTODIAN", "NOTE", "SIZE_BYTES"]).alias("line"))


def text_sidecars(spark, d):
    """Records beside which a text with the same name stands (here: the paths of the mails, as .txt)."""
    p = table(spark, d, "payloads").select(F.regexp_replace("path", r"\.[^./]+$", ".txt").alias("path")).dropDuplicates()
    return k.sidecars(_records(spark, d).select("path", "sha256").dropDuplicates(), p, ".txt")


def sample_by_pages(spark, d):
    """Fifty files of three to nine pages, drawn by hash."""
    p = table(spark, d, "page_analysis").groupBy("path").agg(F.countDistinct("page").alias("pages"))
    return k.sample_by_hash(p, "path", 50, seed=7, pages=(3, 9)).agg(F.count(F.lit(1)).alias("n"), F.min("pages").alias("least"), F.max("pages").alias("most"))


def pdf_only(spark, d):
    return _records(spark, d).where(F.lower("extension") == ".pdf").select("path", "extension").dropDuplicates()


def content_hashes(spark, d):
    r = table(spark, d, "attorney_list").select("list_id", "party", "served_on").dropDuplicates()
    return r.select("list_id", k.content_hash(r).alias("hash"))


def command_json(spark, d):
    """What a command prints for each list: its data with their schema."""
    r = table(spark, d, "attorney_list").select("list_id", "party").dropDuplicates()
    return r.select("list_id", k.wrapped(F.struct("list_id", "party"), "attorney_list", 1).alias("line"))


def migrated_records(spark, d):
    """The manifest's records two versions on: paths without the volume, then sizes in KB."""
    steps = k.Migrations()
    steps.add("manifest", 1, lambda df: df.withColumn("path", F.regexp_replace("path", "^/data/vol[0-9]+", "")))
    steps.add("manifest", 2, lambda df: df.withColumn("size", F.floor(F.col("size") / 1024)))
    return steps.apply(_records(spark, d).select("path", "size", "schema_version").dropDuplicates(), "manifest", 1, 3)


def benchmark_compare(spark, d):
    """Each model's latencies against the older half of its batches, with the words that go with the change."""
    e = table(spark, d, "embedding_results").select("batch_id", "model", "latency_ms").where("latency_ms is not null").dropDuplicates()
    mid = e.groupBy("model").agg(F.floor(F.avg("batch_id")).alias("mid"))
    b = e.join(F.broadcast(mid), "model").groupBy("model").agg(F.avg(F.when(F.col("batch_id") <= F.col("mid"), F.col("latency_ms"))).alias("base"), F.avg(F.when(F.col("batch_id") > F.col("mid"), F.col("latency_ms"))).alias("now"))
    change = F.when(F.col("base") != 0, (F.col("now") - F.col("base")) / F.col("base") * 100)
    size = F.format_string("%.1f", F.abs(F.round(change, 1)))
    words = F.when(F.abs(change) < 0.01, "no measurable change").when(change < 0, F.concat(size, F.lit("% faster"))).when(change > 0, F.concat(size, F.lit("% slower")))
    return b.select("model", F.round(change, 4).alias("change"), words.alias("label"))


QUERIES = {
    f.__name__: f
    for f in (
        manifest_hash, dataset_hash, schema_counts, report_totals, production_totals, impact_ratios, impact_json, csv_lines, text_sidecars, sample_by_pages, pdf_only,
        content_hashes, command_json, migrated_records, benchmark_compare,
    )
}

_R = "WITH r AS (SELECT DISTINCT * FROM manifest)"
_C, _T = "coalesce(nullif(custodian, ''), 'unknown')", "coalesce(nullif(doctype, ''), 'other')"


def _field(c: str) -> str:
    return f"""CASE WHEN regexp_matches({c}, '[",' || chr(13) || chr(10) || ']') THEN '"' || replace({c}, '"', '""') || '"' ELSE {c} END"""


_DT, _CU = "coalesce(doctype, '')", "coalesce(custodian, '')"
_NOTE = f"""'of "' || {_DT} || '", ' || {_CU}"""
SQL = {
    "manifest_hash": f"""{_R}, i AS (SELECT DISTINCT coalesce(nullif(lower(sha256), ''), path) AS x FROM r), p AS (SELECT substr(sha256(x), 1, 2) AS p, sha256(array_to_string(list_sort(list(x)), chr(10))) AS h FROM i WHERE x IS NOT NULL GROUP BY 1)
SELECT sha256(array_to_string(list_sort(list(h)), chr(10))) AS manifest_hash FROM p""",
    "dataset_hash": """WITH p AS (SELECT DISTINCT path, page, sha256, text_length FROM page_analysis)
SELECT count(*) AS n, CAST(sum(CAST(('0x' || substr(sha256(page || '|' || path || '|' || sha256 || '|' || text_length), 1, 12)) AS HUGEINT)) AS VARCHAR) AS sum FROM p""",
    "schema_counts": f"""{_R}, b AS (SELECT *, coalesce(path = '' OR NOT starts_with(path, '/') OR NOT regexp_matches(sha256, '^[0-9a-f]{{64}}$') OR size < 0 OR extension <> lower(extension), false) OR path IS NULL OR sha256 IS NULL OR doctype IS NULL OR custodian IS NULL AS bad FROM r),
q AS (SELECT *, bool_or(bad) OVER (PARTITION BY path) AS wrong FROM b) SELECT schema_id, count(*) FILTER (NOT wrong) AS valid, count(*) FILTER (wrong) AS invalid FROM q GROUP BY 1""",
    "report_totals": f"{_R} SELECT count(*) AS documents, CAST(coalesce(sum(TRY_CAST(metadata['pages'] AS BIGINT)), 0) AS BIGINT) AS pages, CAST(sum(size) AS BIGINT) AS bytes, substr(min(mtime), 1, 10) || ' to ' || substr(max(mtime), 1, 10) AS date_range FROM r",
    "production_totals": f"""{_R}, n AS (SELECT count(*) AS k FROM (SELECT DISTINCT sha256, path FROM manifest)), {_P.replace("p AS", "pp AS", 1)}, {spans_sql('pp', 'path', PII)}
SELECT count(*) AS documents, 'ABC-000000001 - ABC-' || lpad(CAST((SELECT k FROM n) AS VARCHAR), 9, '0') AS bates_range, (SELECT count(DISTINCT path) FROM f) AS redactions FROM r""",
    "impact_ratios": f"{_R} SELECT count(*) AS discovered, round((count(*) - count(DISTINCT lower(sha256))) * 100.0::DOUBLE / count(*), 2) AS dedupe_percent, round(sum(size) / 1048576.0::DOUBLE, 2) AS mb FROM r",
    "impact_json": f"""{_R}, g AS (SELECT {_C} AS custodian, {_T} AS doctype, count(*) AS n, sum(size) AS b FROM r GROUP BY 1, 2)
SELECT custodian, '{{"bytes":' || sum(b) || ',"custodian":' || to_json(custodian) || ',"doctypes":[' || string_agg('{{"doctype":"' || doctype || '","n":' || n || '}}', ',' ORDER BY doctype) || '],"n":' || sum(n) || '}}' AS line FROM g GROUP BY custodian""",
    "csv_lines": f"{_R}, q AS (SELECT coalesce(path, '') AS path, substr(sha256, 1, 16) AS a, {_DT} AS b, {_CU} AS c, {_NOTE} AS n, CAST(size AS VARCHAR) AS s FROM r) SELECT path AS \"PATH\", {_field('a')} || ',' || {_field('b')} || ',' || {_field('c')} || ',' || {_field('n')} || ',' || s AS line FROM q",
    "text_sidecars": r"WITH s AS (SELECT DISTINCT regexp_replace(path, '\.[^./]+$', '') AS stem FROM payloads WHERE regexp_matches(path, '\.[^./]+$')) SELECT DISTINCT path, sha256 FROM manifest WHERE regexp_replace(path, '\.[^./]+$', '') IN (SELECT stem FROM s)",
    "pdf_only": "SELECT DISTINCT path, extension FROM manifest WHERE lower(extension) = '.pdf'",
    "content_hashes": """SELECT DISTINCT list_id, sha256('{"list_id":' || list_id || ',"party":' || coalesce(to_json(party), 'null') || ',"served_on":' || coalesce(to_json(served_on), 'null') || '}') AS hash FROM attorney_list""",
    "command_json": """SELECT DISTINCT list_id, '{"data":{"list_id":' || list_id || ',"party":' || to_json(party) || '},"schema_id":"attorney_list","schema_version":1}' AS line FROM attorney_list""",
    "migrated_records": "SELECT regexp_replace(path, '^/data/vol[0-9]+', '') AS path, CAST(size // 1024 AS BIGINT) AS size, 3 AS schema_version FROM (SELECT DISTINCT path, size, schema_version FROM manifest)",
    "benchmark_compare": """WITH e AS (SELECT DISTINCT batch_id, model, latency_ms FROM embedding_results WHERE latency_ms IS NOT NULL), m AS (SELECT model, floor(avg(batch_id)) AS mid FROM e GROUP BY 1),
b AS (SELECT model, avg(latency_ms) FILTER (batch_id <= mid) AS base, avg(latency_ms) FILTER (batch_id > mid) AS now FROM e JOIN m USING (model) GROUP BY 1), c AS (SELECT model, CASE WHEN base <> 0 THEN (now - base) / base * 100 END AS ch FROM b)
SELECT model, round(ch, 4) AS change, CASE WHEN abs(ch) < 0.01 THEN 'no measurable change' WHEN ch < 0 THEN printf('%.1f', abs(round(ch, 1))) || '% faster' WHEN ch > 0 THEN printf('%.1f', abs(round(ch, 1))) || '% slower' END AS label FROM c""",
}
