"""Detection queries over the texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casework.functions import text as t
from casework.operators import detect as x
from casework.operators import produce
from casework.shared import table

PAGE = 1800


def _docs(spark, d) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text")


def _payloads(spark, d) -> DataFrame:
    return table(spark, d, "payloads").where("text is not null").select("path", "text").dropDuplicates()


def pii_spans(spark, d):
    return x.pattern_findings(_payloads(spark, d), "path", x.PII).select("path", "entity", "start", "end")


def pii_counts_by_type(spark, d):
    f = x.pattern_findings(_payloads(spark, d), "path", x.PII)
    return f.groupBy("entity").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("path").alias("files"))


def pii_email_domain_filter(spark, d):
    f = x.pattern_findings(_payloads(spark, d), "path", {"EMAIL": t.EMAIL})
    domain = F.element_at(F.split("match", "@"), -1)
    return f.where(~domain.isin("brackwell.test", "tessendor.example")).groupBy(domain.alias("domain")).agg(F.count(F.lit(1)).alias("n"))


def pii_masked_text(spark, d):
    return _payloads(spark, d).select("path", t.mask_emails(F.col("text")).alias("masked"))


def pii_page_attach(spark, d):
    p = _payloads(spark, d)
    n = F.greatest(F.lit(1), F.ceil(F.length("text") / PAGE)).cast("int")
    pages = p.select("path", F.explode(F.sequence(F.lit(0), n - 1)).alias("page"))
    pages = pages.select("path", "page", (F.col("page") * PAGE).alias("page_start"), ((F.col("page") + 1) * PAGE).alias("page_end"))
    f = x.pattern_findings(p, "path", {"EMAIL": t.EMAIL}).select("path", "start", "end")
    return x.page_of(f, pages, "path").groupBy("path", "page").agg(F.count(F.lit(1)).alias("n"))


def keyword_findings(spark, d):
    return x.keyword_findings(_payloads(spark, d), "path", keywords=("work product", "legal advice", "outside counsel", "privilege log"))


def concept_findings(spark, d):
    pats = {k: v[2] for k, v in x.CONCEPTS.items()}
    return x.pattern_findings(_docs(spark, d), "doc_id", pats).groupBy("doc_id", "entity").agg(F.count(F.lit(1)).alias("n"), F.min("start").alias("first"))


def concept_multifactor_score(spark, d):
    return x.concept_scores(_docs(spark, d), "doc_id")


def concept_escalation_stats(spark, d):
    s = x.concept_scores(_docs(spark, d), "doc_id")
    return s.groupBy("concept").agg(F.count(F.lit(1)).alias("n"), F.count_if("needs_refinement").alias("escalated"), F.count_if(F.col("confidence") >= 0.85).alias("high"))


def heatmap_by_page(spark, d):
    s = x.concept_scores(_docs(spark, d), "doc_id").withColumn("page", F.floor(F.col("start") / PAGE).cast("int") + 1)
    return x.heatmap(s, "doc_id")


def highlight_annotations(spark, d):
    return x.annotations(x.concept_scores(_docs(spark, d), "doc_id"), "doc_id")


def redaction_applied(spark, d):
    p = _payloads(spark, d)
    found = F.coalesce(t.spans(F.col("text"), t.EMAIL), F.expr("cast(array() as array<struct<start:int,end:int,match:string>>)"))
    named = F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit("EMAIL").alias("entity")))
    return p.select("path", produce.apply_spans(F.col("text"), named).alias("redacted"))


def redaction_plan_id(spark, d):
    f = x.pattern_findings(_payloads(spark, d), "path", {"EMAIL": t.EMAIL})
    item = F.concat_ws(":", F.lit("EMAIL"), F.lpad(F.col("start").cast("string"), 9, "0"), F.lpad(F.col("end").cast("string"), 9, "0"))
    return f.groupBy("path").agg(t.input_hash(F.collect_list(item)).alias("plan_id"), F.count(F.lit(1)).alias("actions"))


QUERIES = {
    f.__name__: f
    for f in (
        pii_spans, pii_counts_by_type, pii_email_domain_filter, pii_masked_text, pii_page_attach, keyword_findings, concept_findings,
        concept_multifactor_score, concept_escalation_stats, heatmap_by_page, highlight_annotations, redaction_applied, redaction_plan_id,
    )
}


def _q(s: str) -> str:
    return s.replace("'", "''")


def spans_sql(source: str, key: str, patterns: dict[str, str], cte: str = "f", text: str = "text", flag: str = "(?i)") -> str:
    """CTE of (key, entity, start, end, match): offsets summed from the text's parts and its matches."""
    parts = []
    for k, p in patterns.items():
        p = _q(flag + p)
        parts.append(
            f"""SELECT {key}, '{k}' AS entity, i, length(g[i]) AS gl, length(m[i]) AS ml, m[i] AS match FROM (
SELECT {key}, string_split_regex({text}, '{p}') AS g, regexp_extract_all({text}, '{p}') AS m FROM {source}), unnest(range(1, len(m) + 1)) AS u(i)"""
        )
    return f"""{cte} AS (SELECT {key}, entity, CAST(sum(gl + ml) OVER w - ml AS INTEGER) AS start, CAST(sum(gl + ml) OVER w AS INTEGER) AS "end", match FROM (
{' UNION ALL '.join(parts)}) WINDOW w AS (PARTITION BY {key}, entity ORDER BY i ROWS UNBOUNDED PRECEDING))"""


_P = "p AS (SELECT DISTINCT path, text FROM payloads WHERE text IS NOT NULL)"
_E = spans_sql("p", "path", {"EMAIL": t.EMAIL})
_CONCEPTS = {k: v[2] for k, v in x.CONCEPTS.items()}
_BASE = "CASE entity " + " ".join(f"WHEN '{k}' THEN {max(0.5, v[1])}" for k, v in x.CONCEPTS.items()) + " END"
_CAT = "CASE entity " + " ".join(f"WHEN '{k}' THEN '{v[0]}'" for k, v in x.CONCEPTS.items()) + " END"
_CON = "CASE WHEN entity IN ('EMAIL_HEADER', 'EMAIL_ADDRESS') THEN 'EMAIL_COMMUNICATION' ELSE entity END"
_SCORE = f"""WITH {spans_sql('documents', 'doc_id', _CONCEPTS)},
{spans_sql('documents', 'doc_id', {'law': x.ATTORNEY, 'legal': x.LEGAL, 'quoted': x.QUOTED}, 's', flag='')},
n AS (SELECT row_number() OVER () AS id, * FROM f),
k AS (SELECT a.id, count(DISTINCT {_CON.replace("entity", "b.entity")}) AS kinds FROM n a JOIN n b ON a.doc_id = b.doc_id AND a.id <> b.id
  AND b.start >= greatest(0, a.start - 500) - 500 AND b.start <= a."end" + 500 AND b."end" >= greatest(0, a.start - 500) GROUP BY 1),
g AS (SELECT n.id, coalesce(bool_or(s.entity = 'law' AND s.start <= n."end" + 300 AND s."end" >= n.start - 300), false) AS law,
  coalesce(bool_or(s.entity = 'legal' AND s.start <= n."end" + 200 AND s."end" >= n.start - 200), false) AS legal,
  coalesce(bool_or(s.entity = 'quoted' AND s.start <= n."end" + 100 AND s."end" >= n.start - 100), false) AS quoted
  FROM n LEFT JOIN s ON s.doc_id = n.doc_id GROUP BY 1),
z AS (SELECT doc_id, entity AS rule, {_CON} AS concept, {_CAT} AS category, start, "end", round(greatest(0.5, least(1.0, CAST({_BASE} AS DOUBLE) + CAST(CASE WHEN law THEN 0.10 ELSE 0.0 END AS DOUBLE)
  + CAST(CASE WHEN legal THEN 0.05 ELSE 0.0 END AS DOUBLE) + 0.05::DOUBLE * least(coalesce(kinds, 0), 3) + CAST(CASE WHEN quoted THEN -0.15 ELSE 0.0 END AS DOUBLE))), 6) AS confidence
  FROM n JOIN g USING (id) LEFT JOIN k USING (id))
"""
SQL = {
    "pii_spans": f'WITH {_P}, {spans_sql("p", "path", x.PII)} SELECT path, entity, start, "end" FROM f',
    "pii_counts_by_type": f'WITH {_P}, {spans_sql("p", "path", x.PII)} SELECT entity, count(*) AS n, count(DISTINCT path) AS files FROM f GROUP BY 1',
    "pii_email_domain_filter": f"WITH {_P}, {_E} SELECT * FROM (SELECT split_part(match, '@', 2) AS domain, count(*) AS n FROM f GROUP BY 1) WHERE domain NOT IN ('brackwell.test', 'tessendor.example')",
    "pii_masked_text": f"WITH {_P} SELECT path, regexp_replace(text, '{_q(t.EMAIL)}', '[REDACTED_EMAIL]', 'g') AS masked FROM p",
    "pii_page_attach": f"WITH {_P}, {_E} SELECT path, CAST(start // {PAGE} AS INTEGER) AS page, count(*) AS n FROM f GROUP BY 1, 2",
    "keyword_findings": f'WITH {_P}, {spans_sql("p", "path", {k: k for k in ("work product", "legal advice", "outside counsel", "privilege log")}, text="lower(text)", flag="")} SELECT path, entity AS keyword, start, "end" FROM f',
    "concept_findings": f"WITH {spans_sql('documents', 'doc_id', _CONCEPTS)} SELECT doc_id, entity, count(*) AS n, min(start) AS first FROM f GROUP BY 1, 2",
    "concept_multifactor_score": f'{_SCORE} SELECT *, confidence >= 0.5 AND confidence < 0.85 AS needs_refinement FROM z',
    "concept_escalation_stats": f"{_SCORE} SELECT concept, count(*) AS n, count(*) FILTER (confidence >= 0.5 AND confidence < 0.85) AS escalated, count(*) FILTER (confidence >= 0.85) AS high FROM z GROUP BY 1",
    "heatmap_by_page": f"{_SCORE} SELECT doc_id, CAST(start // {PAGE} AS INTEGER) + 1 AS page, round(max(CASE WHEN confidence < 0.5 THEN 0.3 ELSE least(1.0, 0.3 + (confidence - 0.5) * 1.4) END), 6) AS temperature, count(*) AS n FROM z GROUP BY 1, 2",
    "highlight_annotations": f"{_SCORE} SELECT doc_id, array_to_string(list_sort(list(DISTINCT concept)), ',') AS concepts, count(*) AS n, min(confidence) AS least, max(confidence) AS most FROM z GROUP BY 1",
    "redaction_applied": f"WITH {_P} SELECT path, regexp_replace(text, '{_q(t.EMAIL)}', '[EMAIL]', 'g') AS redacted FROM p",
    "redaction_plan_id": f"""WITH {_P}, {_E} SELECT path, sha256(array_to_string(list_sort(list('EMAIL:' || lpad(CAST(start AS VARCHAR), 9, '0') || ':' || lpad(CAST("end" AS VARCHAR), 9, '0'))), chr(10))) AS plan_id, count(*) AS actions FROM f GROUP BY 1""",
}
