"""Numbering, load files, the privilege log, ledgers, streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casework.operators import ledger as lg
from casework.operators import produce as p
from casework.operators.manifest import distinct_records
from casework.shared import cut, table
from casework.streaming import activity


def _records(spark, d) -> DataFrame:
    return distinct_records(table(spark, d, "manifest"))


def _pages(spark, d) -> DataFrame:
    a = table(spark, d, "page_analysis").groupBy("path").agg(F.min("sha256").alias("sha256"), F.countDistinct("page").alias("pages"))
    return p.number_pages(a)


def bates_sequential(spark, d):
    return p.number(_records(spark, d))


def bates_family(spark, d):
    meta = F.when(F.col("metadata").startswith("{"), F.col("metadata"))
    f = table(spark, d, "payloads").select("path", "sha256", F.get_json_object(meta, "$.family_id").alias("family_id")).dropDuplicates()
    return p.number_families(f)


def bates_page_ranges(spark, d):
    return _pages(spark, d)


def production_dat_lines(spark, d):
    return p.production_dat(_pages(spark, d))


def opticon_lines(spark, d):
    return p.opticon(_pages(spark, d))


def load_file_opticon(spark, d):
    """The opticon file as a whole, its lines numbered through."""
    return p.load_file(_pages(spark, d), "opticon")


def bates_plan_errors(spark, d):
    """What keeps the records from being numbered, held against the mails' and letters' files."""
    return p.check_plan(_records(spark, d), table(spark, d, "payloads").select("path", "sha256")).groupBy("error").agg(F.count(F.lit(1)).alias("n"))


def bates_prefix_errors(spark, d):
    log = table(spark, d, "privilege_log").select("privlog_id", "prodbeg_doc_num").dropDuplicates()
    return p.prefix_errors(log, "RXL-0000000", "prodbeg_doc_num")


def stamp_boxes(spark, d):
    """Where the first label of each file is stamped on a letter page, in each place, with a colour as three shares."""
    pages = _pages(spark, d).select("path", F.col("start_label").alias("label"), F.lit(612.0).alias("width"), F.lit(792.0).alias("height"), F.lit("#FF8000").alias("hex"))
    out = None
    for place in p.STAMP_PLACES:
        b = p.stamp_boxes(pages, place).select("path", F.lit(place).alias("place"), *[F.round(c, 4).alias(c) for c in ("x0", "y0", "x1", "y1")], F.round(p.rgb(F.col("hex"))[1], 6).alias("green"))
        out = b if out is None else out.unionByName(b)
    return out


def bates_registry_violations(spark, d):
    """Numbers of the logged mails, held against the files."""
    meta = F.when(F.col("metadata").startswith("{"), F.col("metadata"))
    reg = table(spark, d, "payloads").select(F.col("path").alias("document"), "sha256", F.get_json_object(meta, "$.bates").alias("bates_id"))
    return p.registry_violations(reg, table(spark, d, "manifest").select("path", "sha256"))


def bates_overlaps(spark, d):
    """The files' ranges with some twice and one that holds all."""
    r = _pages(spark, d).select("start_label", "end_label")
    whole = r.agg(F.min("start_label").alias("start_label"), F.max("end_label").alias("end_label"))
    return p.overlaps(r.unionAll(r.where(F.col("start_label").endswith("1"))).unionAll(whole))


def privilege_log_join(spark, d):
    """Log entries with the file their number stands for."""
    meta = F.when(F.col("metadata").startswith("{"), F.col("metadata"))
    files = table(spark, d, "payloads").select("path", F.get_json_object(meta, "$.bates").alias("prodbeg_doc_num")).where("prodbeg_doc_num is not null").dropDuplicates()
    log = table(spark, d, "privilege_log").select("privlog_id", "family_id", "prodbeg_doc_num").dropDuplicates()
    return log.join(files, "prodbeg_doc_num", "left").select("privlog_id", "family_id", "prodbeg_doc_num", "path")


def privilege_log_families(spark, d):
    log = table(spark, d, "privilege_log").select("privlog_id", "family_id", "parent_or_attachment").dropDuplicates()
    return (
        log.where("length(trim(family_id)) > 0")
        .groupBy("family_id")
        .agg(F.countDistinct("privlog_id").alias("entries"), F.count_if(F.col("parent_or_attachment") == "Parent").alias("parents"), F.min("privlog_id").alias("first"))
    )


def privilege_log_violations(spark, d):
    log = table(spark, d, "privilege_log").dropDuplicates()
    w = Window.partitionBy("privlog_id")
    r = log.withColumn("_n", F.count(F.lit(1)).over(w))
    rules = F.array_compact(
        F.array(
            F.when(~F.col("privlog_id").rlike("^PRIVID-[0-9]+$"), "id_format"), F.when(F.col("_n") > 1, "id_repeated"),
            F.when(F.coalesce(F.trim("family_id"), F.lit("")) == "", "family_missing"), F.when(F.coalesce(F.trim("basis_for_claim"), F.lit("")) == "", "basis_missing"),
            F.when(F.coalesce(F.size("to_names"), F.lit(0)) <= 0, "recipients_missing"), F.when(~F.col("doc_date").rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), "date_form"),
        )
    )
    return r.select(F.explode(rules).alias("rule")).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


def privilege_log_basis(spark, d):
    """Spellings of the basis brought to one key."""
    log = table(spark, d, "privilege_log").select("privlog_id", "basis_for_claim").dropDuplicates()
    key = F.trim(F.regexp_replace(F.lower("basis_for_claim"), "[^a-z]+", " "))
    return log.groupBy(key.alias("basis")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("basis_for_claim").alias("spellings"))


def attorney_distinct(spark, d):
    return table(spark, d, "attorney_list").select("list_id", F.explode(F.array_distinct("attorneys")).alias("attorney")).dropDuplicates()


def _ledger(spark, d) -> DataFrame:
    """Every user's events as a chain."""
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", "ts")
    return lg.chain(e, "user_id", ["ts", "event_id"], F.concat_ws("|", F.col("event_id").cast("string"), "event_type", F.col("user_id").cast("string")))


KEY = b"a key for tests"


def ledger_chain(spark, d):
    return _ledger(spark, d).select("user_id", "sequence", "event_id", "previous_hash", "entry_hash")


def ledger_heads(spark, d):
    return lg.heads(_ledger(spark, d), "user_id").select("user_id", "segment", "entries", "tip", "head")


def ledger_chain_verify(spark, d):
    """Entries, and what is wrong with them after they were written, signed and read again."""
    e = cut(lg.sign(_ledger(spark, d), KEY))
    wrong = lg.verify(e, "user_id", KEY, lg.heads(e, "user_id")).agg(F.count(F.lit(1)).alias("errors"))
    return e.agg(F.count(F.lit(1)).alias("entries")).crossJoin(F.broadcast(wrong))  # one row each


def ledger_tamper_detect(spark, d):
    """Errors that were made views, cleared hashes and left-out entries: each shows by its own rule."""
    e = cut(lg.sign(_ledger(spark, d), KEY))
    last = F.col("event_id") % 10
    t = e.withColumn("content", F.when(F.col("event_type") == "error", F.replace("content", F.lit("error"), F.lit("view"))).otherwise(F.col("content")))
    t = t.withColumn("entry_hash", F.when((F.col("event_type") == "click") & (last == 3), F.lit(None)).otherwise(F.col("entry_hash")))
    t = t.withColumn("signature", F.when((F.col("event_type") == "click") & (last == 5), F.reverse("signature")).otherwise(F.col("signature")))
    return lg.verify(t.where(~((F.col("event_type") == "click") & (last == 7))), "user_id", KEY).groupBy("error").agg(F.count(F.lit(1)).alias("n"))


def ledger_tail(spark, d):
    """The last five entries of one user."""
    return lg.tail(_ledger(spark, d).where("user_id = 7"), 5).select("sequence", "event_id", "event_type")


def ledger_activity(spark, d):
    e = table(spark, d, "events")
    return e.groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users"))


def latency_compare(spark, d):
    """Mean latency of each model's first and second half of batches, and the change in per cent."""
    e = table(spark, d, "embedding_results").select("batch_id", "model", "latency_ms").dropDuplicates()
    b = e.groupBy("model").agg(F.avg(F.when(F.col("batch_id") % 2 == 0, F.col("latency_ms"))).alias("base"), F.avg(F.when(F.col("batch_id") % 2 == 1, F.col("latency_ms"))).alias("now"))
    change = F.when(F.col("base") > 0, F.round((F.col("now") - F.col("base")) / F.col("base") * 100, 4))
    return b.select("model", F.round("base", 6).alias("base"), F.round("now", 6).alias("now"), change.alias("change"))


def _events(spark, d) -> DataFrame:
    return activity.read(spark, f"{d}/events*.parquet", table(spark, d, "events").schema)


def stream_tumbling_counts(spark, d):
    return activity.run(activity.tumbling(_events(spark, d)))


def stream_dedupe(spark, d):
    return activity.run(activity.first_seen(_events(spark, d), ["user_id", "event_type"]), mode="append")


def stream_sessions(spark, d):
    return activity.run(activity.sessions(_events(spark, d)))


def batch_sessions(spark, d):
    return activity.sessions(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), watermark=None)


QUERIES = {
    f.__name__: f
    for f in (
        bates_sequential, bates_family, bates_page_ranges, production_dat_lines, opticon_lines, bates_registry_violations, bates_overlaps,
        privilege_log_join, privilege_log_families, privilege_log_violations, privilege_log_basis, attorney_distinct, ledger_chain, ledger_heads,
        load_file_opticon, bates_plan_errors, bates_prefix_errors, stamp_boxes, ledger_chain_verify, ledger_tamper_detect, ledger_tail, ledger_activity, latency_compare, stream_tumbling_counts, stream_dedupe,
        stream_sessions, batch_sessions,
    )
}

_FAM = "CASE WHEN starts_with(metadata, '{') THEN json_extract_string(metadata, '$.family_id') END"
_BATES = "CASE WHEN starts_with(metadata, '{') THEN json_extract_string(metadata, '$.bates') END"
_NUM = "lpad(CAST({n} AS VARCHAR), CAST(greatest({w}, length(CAST({n} AS VARCHAR))) AS INTEGER), '0')"
_SEQ = "'DOC-' || " + _NUM.format(n="k", w=6)
_PG = f"""pg AS (SELECT path, min(sha256) AS sha256, count(DISTINCT page) AS pages FROM page_analysis GROUP BY 1),
rn AS (SELECT *, CAST(sum(pages) OVER (ORDER BY sha256, path) AS BIGINT) AS e FROM pg),
pr AS (SELECT sha256, path, pages, 'ABC' || {_NUM.format(n='(e - pages + 1)', w=7)} AS start_label, 'ABC' || {_NUM.format(n='e', w=7)} AS end_label FROM rn)"""
_CH = """e AS (SELECT *, event_id || '|' || event_type || '|' || user_id AS content, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sequence FROM events),
c AS (SELECT user_id, sequence, event_id, event_type, content, list(content) OVER (PARTITION BY user_id ORDER BY sequence ROWS UNBOUNDED PRECEDING) AS upto FROM e),
l AS (SELECT user_id, sequence, event_id, event_type, content, list_reduce(list_prepend(repeat('0', 64), upto), lambda a, x: sha256(a || '|' || x)) AS entry_hash FROM c),
h AS (SELECT *, coalesce(lag(entry_hash) OVER (PARTITION BY user_id ORDER BY sequence), repeat('0', 64)) AS previous_hash FROM l)"""
_NAME = "list_last(string_split(path, '/'))"
_SESS = """s AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR date_diff('microsecond', lag(ts) OVER w, ts) >= 1800000000 THEN 1 ELSE 0 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
g AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS sid FROM s)
SELECT user_id, epoch_us(min(ts)) AS began_us, count(*) AS n FROM g GROUP BY user_id, sid"""
SQL = {
    "bates_sequential": f"SELECT sha256, path, {_SEQ} AS label FROM (SELECT *, row_number() OVER (ORDER BY sha256, path) AS k FROM (SELECT DISTINCT sha256, path FROM manifest))",
    "bates_family": f"SELECT family_id, sha256, path, {_SEQ} AS label FROM (SELECT *, row_number() OVER (ORDER BY family_id, sha256, path) AS k FROM (SELECT DISTINCT coalesce(nullif(trim({_FAM}), ''), sha256) AS family_id, sha256, path FROM payloads))",
    "bates_page_ranges": f"WITH {_PG} SELECT * FROM pr",
    "production_dat_lines": f"WITH {_PG} SELECT CAST(0 AS BIGINT) AS line_no, 'DOCID|BEGDOC|ENDDOC|PAGECOUNT|FILEPATH|SHA256' AS line UNION ALL SELECT row_number() OVER (ORDER BY start_label), start_label || '|' || start_label || '|' || end_label || '|' || pages || '|' || replace({_NAME}, '|', '\\|') || '|' || sha256 FROM pr",
    "opticon_lines": f"WITH {_PG} SELECT start_label, CAST(i AS INTEGER) AS line_no, (['IMAGE', start_label, {_NAME}, 'Y', CAST(pages AS VARCHAR), ''])[i + 1] AS line FROM pr, unnest(range(0, 6)) AS u(i)",
    "bates_registry_violations": f"""WITH r AS (SELECT path AS document, sha256, {_BATES} AS bates_id FROM payloads),
n AS (SELECT *, count(*) OVER (PARTITION BY bates_id) AS ids, count(*) OVER (PARTITION BY sha256) AS hashes FROM r),
f AS (SELECT path AS document, min(lower(sha256)) AS have FROM manifest GROUP BY 1), j AS (SELECT * FROM n LEFT JOIN f USING (document))
SELECT document, bates_id, 'missing_field' AS rule FROM j WHERE coalesce(bates_id, '') = '' OR coalesce(sha256, '') = '' OR coalesce(document, '') = ''
UNION ALL SELECT document, bates_id, 'duplicate_id' FROM j WHERE coalesce(bates_id, '') <> '' AND ids > 1
UNION ALL SELECT document, bates_id, 'duplicate_hash' FROM j WHERE coalesce(sha256, '') <> '' AND hashes > 1
UNION ALL SELECT document, bates_id, 'missing_file' FROM j WHERE coalesce(document, '') <> '' AND have IS NULL
UNION ALL SELECT document, bates_id, 'hash_mismatch' FROM j WHERE have <> lower(sha256)""",
    "bates_overlaps": f"""WITH {_PG}, u AS (SELECT start_label, end_label FROM pr UNION ALL SELECT start_label, end_label FROM pr WHERE suffix(start_label, '1') UNION ALL SELECT min(start_label), max(end_label) FROM pr),
q AS (SELECT *, max(end_label) OVER (ORDER BY start_label, end_label ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM u) SELECT * FROM q WHERE start_label <= before""",
    "privilege_log_join": f"SELECT l.privlog_id, l.family_id, l.prodbeg_doc_num, f.path FROM (SELECT DISTINCT privlog_id, family_id, prodbeg_doc_num FROM privilege_log) l LEFT JOIN (SELECT DISTINCT path, {_BATES} AS b FROM payloads) f ON f.b = l.prodbeg_doc_num",
    "privilege_log_families": "SELECT family_id, count(DISTINCT privlog_id) AS entries, count(*) FILTER (parent_or_attachment = 'Parent') AS parents, min(privlog_id) AS first FROM (SELECT DISTINCT privlog_id, family_id, parent_or_attachment FROM privilege_log) WHERE length(trim(family_id)) > 0 GROUP BY 1",
    "privilege_log_violations": """WITH r AS (SELECT *, count(*) OVER (PARTITION BY privlog_id) AS k FROM (SELECT DISTINCT * FROM privilege_log)), v AS (
SELECT 'id_format' AS rule FROM r WHERE NOT regexp_matches(privlog_id, '^PRIVID-[0-9]+$') UNION ALL SELECT 'id_repeated' FROM r WHERE k > 1
UNION ALL SELECT 'family_missing' FROM r WHERE coalesce(trim(family_id), '') = '' UNION ALL SELECT 'basis_missing' FROM r WHERE coalesce(trim(basis_for_claim), '') = ''
UNION ALL SELECT 'recipients_missing' FROM r WHERE coalesce(len(to_names), 0) = 0 UNION ALL SELECT 'date_form' FROM r WHERE NOT regexp_matches(doc_date, '^[0-9]{4}-[0-9]{2}-[0-9]{2}$'))
SELECT rule, count(*) AS n FROM v GROUP BY 1""",
    "privilege_log_basis": "SELECT trim(regexp_replace(lower(basis_for_claim), '[^a-z]+', ' ', 'g')) AS basis, count(*) AS n, count(DISTINCT basis_for_claim) AS spellings FROM (SELECT DISTINCT privlog_id, basis_for_claim FROM privilege_log) GROUP BY 1",
    "attorney_distinct": "SELECT DISTINCT list_id, unnest(attorneys) AS attorney FROM attorney_list",
    "load_file_opticon": f"WITH {_PG}, o AS (SELECT *, row_number() OVER (ORDER BY start_label) AS k FROM pr) SELECT CAST(6 * (k - 1) + i AS BIGINT) AS line_no, (['IMAGE', start_label, {_NAME}, 'Y', CAST(pages AS VARCHAR), ''])[i + 1] AS line FROM o, unnest(range(0, 6)) AS u(i)",
    "bates_plan_errors": """WITH r AS (SELECT path, lower(sha256) AS sha256 FROM (SELECT DISTINCT * FROM manifest)), f AS (SELECT path, min(lower(sha256)) AS have FROM payloads GROUP BY 1),
j AS (SELECT r.*, have, count(*) OVER (PARTITION BY r.path) AS np, count(*) OVER (PARTITION BY r.sha256) AS nh FROM r LEFT JOIN f ON f.path = r.path)
SELECT error, count(*) AS n FROM (SELECT 'duplicate_path' AS error FROM j WHERE np > 1 UNION ALL SELECT 'duplicate_hash' FROM j WHERE nh > 1 UNION ALL SELECT 'missing_file' FROM j WHERE have IS NULL UNION ALL SELECT 'hash_mismatch' FROM j WHERE have <> sha256) GROUP BY 1""",
    "bates_prefix_errors": "SELECT DISTINCT privlog_id, prodbeg_doc_num FROM privilege_log WHERE NOT coalesce(starts_with(prodbeg_doc_num, 'RXL-0000000'), false)",
    "stamp_boxes": f"""WITH {_PG}, b AS (SELECT path, place, px, py, greatest(5.0 * length(start_label), 20.0)::DOUBLE AS w, 12.0::DOUBLE AS h FROM pr, (VALUES ('bottom-right', 0.85, 0.85), ('bottom-center', 0.5, 0.85), ('top-right', 0.85, 0.15)) AS v(place, px, py)),
o AS (SELECT *, greatest(36, least(612 * px - w / 2, 612 - 36 - w)) AS x0, greatest(36, least(792 * py - h / 2, 792 - 36 - h)) AS y0 FROM b)
SELECT path, place, round(x0, 4) AS x0, round(y0, 4) AS y0, round(x0 + w, 4) AS x1, round(y0 + h, 4) AS y1, round(128 / 255.0::DOUBLE, 6) AS green FROM o""",
    "ledger_chain": f"WITH {_CH} SELECT user_id, sequence, event_id, previous_hash, entry_hash FROM h",
    "ledger_heads": f"WITH {_CH} SELECT user_id, 0 AS segment, count(*) AS entries, max_by(entry_hash, sequence) AS tip, sha256(repeat('0', 64) || '|' || max_by(entry_hash, sequence)) AS head FROM h GROUP BY 1",
    "ledger_chain_verify": f"WITH {_CH} SELECT count(*) AS entries, count(*) FILTER (sha256(previous_hash || '|' || content) <> entry_hash) AS errors FROM h",
    "ledger_tamper_detect": f"""WITH {_CH}, k AS (SELECT *, event_type = 'click' AND event_id % 10 = 7 AS gone, event_type = 'click' AND event_id % 10 = 3 AS cleared, event_type = 'click' AND event_id % 10 = 5 AS forged,
lag(event_type = 'click' AND event_id % 10 IN (3, 7)) OVER (PARTITION BY user_id ORDER BY sequence) AS after FROM h),
w AS (SELECT CASE WHEN cleared THEN 'hash_null' WHEN event_type = 'error' THEN 'hash_invalid' WHEN after THEN 'chain_broken' WHEN forged THEN 'signature_invalid' END AS error FROM k WHERE NOT gone)
SELECT error, count(*) AS n FROM w WHERE error IS NOT NULL GROUP BY 1""",
    "ledger_tail": f"WITH {_CH} SELECT sequence, event_id, event_type FROM h WHERE user_id = 7 ORDER BY sequence DESC LIMIT 5",
    "ledger_activity": "SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1, 2",
    "latency_compare": "SELECT model, round(base, 6) AS base, round(now, 6) AS now, CASE WHEN base > 0 THEN round((now - base) / base * 100, 4) END AS change FROM (SELECT model, avg(latency_ms) FILTER (batch_id % 2 = 0) AS base, avg(latency_ms) FILTER (batch_id % 2 = 1) AS now FROM (SELECT DISTINCT batch_id, model, latency_ms FROM embedding_results) GROUP BY 1)",
    "stream_tumbling_counts": "SELECT epoch_us(time_bucket(INTERVAL '1 hour', ts)) AS began_us, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "stream_dedupe": "SELECT DISTINCT user_id, event_type FROM events",
    "stream_sessions": f"WITH {_SESS}",
    "batch_sessions": f"WITH {_SESS}",
}
