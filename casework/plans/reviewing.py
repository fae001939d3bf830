"""Review queries: privilege patterns and decisions, plans of redaction and highlights, the privilege log, ledgers' activity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casework.operators import detect as x
from casework.operators import ledger as lg
from casework.operators import marks as k
from casework.operators import review as r
from casework.plans.findings import _CONCEPTS, _P, _SCORE, _docs, _payloads, spans_sql
from casework.shared import table

DOMAINS = ("tessendor.example", "mail.orvane.example")
NAMES = ("Quillfeather", "Yarganabin", "Dalnotefal")
PAGE = 1800
BREAK = "\n\n"


def _signs(spark, d, threshold: float = 0.5) -> DataFrame:
    return r.privilege_patterns(_payloads(spark, d), "path", domains=DOMAINS, names=NAMES, threshold=threshold)


def _decided(spark, d) -> DataFrame:
    return r.privilege_decisions(_payloads(spark, d), r.privilege_summary(_signs(spark, d), "path"), "path")


def privilege_patterns(spark, d):
    return _signs(spark, d)


def privilege_patterns_default(spark, d):
    """At the usual threshold: the ten keywords and the names, by rule."""
    f = _signs(spark, d, 0.75)
    return f.groupBy("rule", "match_type", "confidence").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("path").alias("files"))


def privilege_max_confidence(spark, d):
    return r.privilege_summary(_signs(spark, d), "path")


def privilege_decision(spark, d):
    return _decided(spark, d).withColumn("labels", F.array_join("labels", ","))


def privilege_decision_forced(spark, d):
    s = r.privilege_summary(_signs(spark, d), "path")
    f = r.privilege_decisions(_payloads(spark, d), s, "path", force=True)
    return f.groupBy("route", "reasoning_effort").agg(F.count(F.lit(1)).alias("n"))


def privilege_stage_status(spark, d):
    return r.stage_status(_decided(spark, d), "path")


def privilege_batch_review(spark, d):
    return r.batch_review(_payloads(spark, d), _decided(spark, d), "path")


def privilege_shown_matches(spark, d):
    """The findings of a file as a viewer may show them: snippets with a slash are left out."""
    m = _signs(spark, d).groupBy("path").agg(F.array_sort(F.collect_list(F.struct("start", "rule", "confidence", "snippet"))).alias("m"))
    s = m.select("path", r.shown_matches(F.col("m")).alias("m"))
    return s.select("path", F.size("m").alias("n"), F.size(F.filter("m", lambda z: z["snippet"].isNotNull())).alias("shown"))


def reasoning_effort(spark, d):
    return _docs(spark, d).select("doc_id", r.effort(F.col("text")).alias("effort"))


def reasoning_hashes(spark, d):
    return _docs(spark, d).where("text is not null").select("doc_id", r.reasoning_hash(F.col("text"), "pepper").alias("hash"))


def reasoning_summary(spark, d):
    return _docs(spark, d).where("text is not null").select("doc_id", r.safe_summary(F.col("text")).alias("summary"))


def policy_snippets(spark, d):
    return _docs(spark, d).where("text is not null").select("doc_id", r.policy_snippet(F.col("text")).alias("snippet"))


def label_predicates(spark, d):
    """Labels made of a log entry's basis and its number of recipients."""
    log = table(spark, d, "privilege_log").select("privlog_id", "basis_for_claim", "to_names", "parent_or_attachment").dropDuplicates()
    n = F.coalesce(F.size("to_names"), F.lit(0))
    labels = F.array(
        F.concat(F.when(F.col("parent_or_attachment") == "Parent", "PRIVILEGED:").otherwise("Non-Responsive:"), F.coalesce("basis_for_claim", F.lit(""))),
        F.when(n > 2, F.lit("hotdoc:many")).otherwise(F.lit("OTHER")), F.concat(F.lit("HOTDOC:"), n.cast("string")),
    )
    e = log.withColumn("labels", labels)
    return e.select(
        "privlog_id", r.is_privileged(F.col("labels")).alias("privileged"), r.is_responsive(F.col("labels")).alias("responsive"), r.hotdoc_level(F.col("labels")).alias("level")
    ).distinct()


def answer_json(spark, d):
    """The object in an answer: bare, fenced, or with words around it, found again in each."""
    p = table(spark, d, "payloads").select("path", "metadata").where("metadata like '{%}'").dropDuplicates()
    forms = F.array(F.col("metadata"), F.concat(F.lit("Here:\n```json\n"), F.col("metadata"), F.lit("\n```\nDone.")), F.concat(F.lit("The answer is "), F.col("metadata"), F.lit(" as asked.")), F.lit("none {"))
    j = p.select("path", "metadata", F.posexplode(forms).alias("form", "answer"))
    return j.select("path", "form", r.json_object(F.col("answer")).eqNullSafe(F.col("metadata")).alias("same"))


def finding_lines(spark, d):
    """Events as the lines a model would give: JSON, bars, and lines that are neither."""
    e = table(spark, d, "events").select("event_id", "event_type", "user_id")
    bars = F.concat_ws("|", F.col("event_type"), F.lit("entity"), F.lit("0.5"), F.col("event_id").cast("string"), F.col("user_id").cast("string"))
    obj = F.to_json(F.struct(F.lit("entity").alias("category"), F.col("event_type").alias("concept"), F.lit(0.5).alias("confidence"), F.col("user_id").alias("end"), F.col("event_id").alias("start")))
    line = F.when(F.col("event_type") == "click", bars).when(F.col("event_type") == "view", obj).when(F.col("event_type") == "error", F.lit("a|b|c")).otherwise(F.lit("{no json"))
    out = r.parse_findings(e.select("event_id", line.alias("line")))
    return out.select("event_id", "concept", "category", "confidence", "start", "end")


def heuristic_first_hits(spark, d):
    return r.first_hits(_docs(spark, d), "doc_id")


def escalation_merge(spark, d):
    """Sure findings, and the uncertain ones with ten points more from a scorer, put together again."""
    s = x.concept_scores(_docs(spark, d), "doc_id")
    m = r.refine(s, lambda pdf: pdf["confidence"] + 0.1)
    return m.select("doc_id", "rule", "start", "end", F.round("confidence", 6).alias("confidence"), "part")


def concept_colors(spark, d):
    s = x.concept_scores(_docs(spark, d), "doc_id")
    return s.groupBy(F.initcap("category").alias("category")).agg(F.count(F.lit(1)).alias("n")).select("category", k.color(F.col("category")).alias("color"), "n")


def _redactions(spark, d) -> DataFrame:
    p = _payloads(spark, d)
    found = x.pattern_findings(p, "path", x.PII).withColumn("page", F.floor(F.col("start") / PAGE).cast("int"))
    return k.redaction_plans(p, found, types=["EMAIL", "PHONE", "SSN"])


def redaction_plans(spark, d):
    """Plans of all three kinds of findings; path and content are part of the id."""
    return _redactions(spark, d).select("plan_id", "path", "content_hash", F.size("actions").alias("actions"), F.array_join("annotations.pages_with_findings", ",").alias("pages"))


def redaction_actions(spark, d):
    a = _redactions(spark, d).select("path", F.explode(F.transform("actions", k.pipeline_action)).alias("a"))
    return a.select("path", "a.type", "a.category", "a.start", "a.end", "a.page", "a.replacement")


def redaction_plan_errors(spark, d):
    """Plans after a third of the files changed or went: what the check says, counted."""
    plans, docs = _redactions(spark, d), _payloads(spark, d)
    h = F.substring(F.sha2("path", 256), 1, 1)
    now = docs.where(h != "0").withColumn("text", F.when(h == "1", F.concat("text", F.lit("."))).when(h == "2", F.left("text", F.lit(5))).otherwise(F.col("text")))
    moved = plans.withColumn("content_hash", F.when(h == "3", F.sha2("content_hash", 256)).otherwise(F.col("content_hash")))
    return k.plan_errors(moved, now).groupBy("error").agg(F.count(F.lit(1)).alias("n"))


def redaction_all_types(spark, d):
    """Texts with the findings of all three kinds replaced by their kind; of overlapping ones the first counts."""
    from casework.operators import produce

    p = _payloads(spark, d)
    f = x.pattern_findings(p, "path", x.PII).groupBy("path").agg(F.array_sort(F.collect_list(F.struct("start", "end", "entity"))).alias("found"))
    none = F.expr("cast(array() as array<struct<start:int,end:int,entity:string>>)")
    return p.join(f, "path", "left").select("path", F.sha2(produce.apply_spans(F.col("text"), F.coalesce("found", none)), 256).alias("redacted_hash"))


def _highlights(spark, d) -> DataFrame:
    docs = _docs(spark, d).where("text is not null")
    s = x.concept_scores(docs, "doc_id").withColumn("page", F.floor(F.col("start") / PAGE).cast("int") + 1)
    return k.highlight_plans(docs, s, "doc_id")


def highlight_plans(spark, d):
    a = F.col("annotations")
    return _highlights(spark, d).select(
        "doc_id", "document_hash", F.size("highlights").alias("n"), F.array_join(a["concepts"], ",").alias("concepts"), F.array_join(a["pages"], ",").alias("pages"), a["least"].alias("least"), a["most"].alias("most")
    )


def highlight_export(spark, d):
    """The heat of the pages as a viewer loads it."""
    return k.export(_highlights(spark, d), "doc_id", "heatmap")


def highlight_plan_ids(spark, d):
    """Documents of one text have one plan: number of ids against number of texts."""
    h = _highlights(spark, d)
    return h.agg(F.countDistinct("plan_id").alias("plans"), F.countDistinct("document_hash").alias("texts"))


def _scan_pages(spark, d) -> DataFrame:
    return k.page_spans(_payloads(spark, d), "path", BREAK)


def page_char_spans(spark, d):
    """Pages that stand in a text with a blank line between, and where each begins and ends."""
    return _scan_pages(spark, d)


def pii_by_text_page(spark, d):
    """Findings of all kinds by the page they begin on; offsets within the page."""
    f = x.pattern_findings(_payloads(spark, d), "path", x.PII)
    cond = (F.col("start") >= F.col("page_start")) & (F.col("start") < F.col("page_end"))
    j = f.join(_scan_pages(spark, d), "path").where(cond)
    return j.select("path", "entity", "page", (F.col("start") - F.col("page_start")).alias("from_page_start"))


def redaction_pages(spark, d):
    """Words without a page: the first page that holds them; with one: that page, if it is there."""
    p = _payloads(spark, d)
    pages = p.select("path", F.posexplode(F.split("text", "\n\n")).alias("page", "text"))
    words = F.array(*[F.struct(F.lit(i).alias("id"), F.lit(w).alias("needle"), F.lit(g).cast("int").alias("page")) for i, (w, g) in enumerate((("privilege", None), ("invoice", 1), ("the", 999), ("zzzz", None)))])
    e = p.select("path", F.explode(words).alias("w")).select("path", "w.*")
    return k.first_pages(e, pages, "path")


def highlight_boxes(spark, d):
    """Concept findings on a layout of lines of 60 characters, 30 to a page."""
    docs = _docs(spark, d).where("text is not null")
    s = x.pattern_findings(docs, "doc_id", {"RESPONSIVE": x.CONCEPTS["RESPONSIVE"][2]})
    marks = k.order_within(s, "doc_id").withColumn("page", F.lit(None).cast("int"))
    n = F.ceil(F.length("text") / 60).cast("int")
    line = docs.where("length(text) > 0").select("doc_id", F.explode(F.sequence(F.lit(0), n - 1)).alias("i"))
    row = (F.col("i") % 30).cast("double")
    layout = line.select(
        "doc_id", (F.floor(F.col("i") / 30) + 1).cast("int").alias("page"), F.lit(600.0).alias("width"), F.lit(800.0).alias("height"), (F.col("i") * 60).alias("start"), (F.col("i") * 60 + 60).alias("end"),
        F.array(F.lit(50.0), 50 + row * 20, F.lit(550.0), 70 + row * 20).alias("bbox"),
    )
    b = k.boxes(marks, layout, "doc_id")
    return b.select("doc_id", "id", "page", F.round("box.x0", 6).alias("x0"), F.round("box.y0", 6).alias("y0"), F.round("box.x1", 6).alias("x1"), F.round("box.y1", 6).alias("y1"))


def ocr_confidence(spark, d):
    """Confidence of pages and documents; the words' confidences stand for those of a recogniser: -1, then from the page's length."""
    p = table(spark, d, "page_analysis").select("path", "page", "needs_ocr", "text_length").dropDuplicates(["path", "page", "needs_ocr", "text_length"])
    confs = F.array(F.lit(-1), F.col("text_length") % 101, F.lit(80))
    toks = p.select("path", "page", (~F.col("needs_ocr")).alias("native"), F.explode(confs).alias("conf"))
    c = k.ocr_confidence(toks, "path")
    return c.select("path", "page", F.round("confidence", 6).alias("confidence"), F.round("document", 6).alias("document"))


def privilege_log_generate(spark, d):
    """A rolling log: the entries there are, and the logged families' mails that are not in it."""
    meta = F.when(F.col("metadata").startswith("{"), F.col("metadata"))
    mails = table(spark, d, "payloads").select(F.get_json_object(meta, "$.bates").alias("document"), F.nullif(F.get_json_object(meta, "$.family_id"), F.lit("")).alias("family_id"))
    prev = table(spark, d, "privilege_log").groupBy("privlog_id").agg(F.min("family_id").alias("family_id"), F.min("prodbeg_doc_num").alias("document"))
    return r.log_entries(mails.where("family_id is not null"), prev, width=9)


def privilege_log_errors(spark, d):
    log = table(spark, d, "privilege_log")
    e = r.log_errors(log, ["attorney client privilege", "work product"], number="^RXL-[0-9]{9}$")
    return e.groupBy("rule").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("first"))


def attorney_firm_lists(spark, d):
    return r.attorney_lists(table(spark, d, "attorney_list"))


def _log(spark, d) -> DataFrame:
    """Events as a ledger's entries."""
    e = table(spark, d, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp"), "event_type", "user_id")
    user, ev = F.col("user_id").cast("string"), F.col("event_id").cast("string")
    op = F.when(F.col("event_type") == "view", "index.search").when(F.col("event_type") == "click", "cli.invoke").otherwise(F.col("event_type"))
    argv = F.array(F.lit("tool"), F.lit("--api-key"), ev, F.lit("--Token-KEY=abc"), F.lit("run"), F.lit("--key"), F.lit("--dim"), user)
    args = F.when(op == "index.search", F.to_json(F.struct(F.concat(F.lit("q"), user).alias("query"), F.lit("lexical").alias("mode"), (F.col("event_id") % 10).alias("limit")))).otherwise(F.to_json(F.struct(argv.alias("argv"))))
    return e.select("event_id", "timestamp", op.alias("operation"), F.array(user).alias("inputs"), F.array(ev).alias("outputs"), args.alias("args"))


def ledger_search_activity(spark, d):
    return r.search_activity(_log(spark, d)).groupBy("query", "mode", "limit").agg(F.count(F.lit(1)).alias("n"), F.max("timestamp").alias("last"))


def ledger_command_history(spark, d):
    return r.command_history(_log(spark, d))


def ledger_filters(spark, d):
    """Entries by operation, by input and by output."""
    e = _log(spark, d)
    parts = {"operation": lg.by_operation(e, "purchase"), "input": lg.by_input(e, "7"), "output": lg.by_output(e, "42")}
    out = None
    for name, f in parts.items():
        row = f.select(F.lit(name).alias("filter"), "event_id", "operation")
        out = row if out is None else out.unionByName(row)
    return out


QUERIES = {
    f.__name__: f
    for f in (
        privilege_patterns, privilege_patterns_default, privilege_max_confidence, privilege_decision, privilege_decision_forced, privilege_stage_status,
        privilege_batch_review, privilege_shown_matches, reasoning_effort, reasoning_hashes, reasoning_summary, policy_snippets, label_predicates, answer_json, finding_lines,
        heuristic_first_hits, escalation_merge, concept_colors, redaction_plans, redaction_actions, redaction_plan_errors, redaction_all_types, highlight_plans,
        highlight_export, highlight_plan_ids, page_char_spans, pii_by_text_page, redaction_pages, highlight_boxes, ocr_confidence, privilege_log_generate,
        privilege_log_errors, attorney_firm_lists, ledger_search_activity, ledger_command_history, ledger_filters,
    )
}

_alt = lambda xs: "|".join(z.replace(".", r"\.").replace("-", r"\-") for z in xs)
_SIGNS = {"attorney_domain": f"@(?:{_alt(DOMAINS)})", "attorney_name": rf"\b(?:{_alt(NAMES)})\b", "privilege_keyword": f"(?:{_alt(x.KEYWORDS)})"}
_S = f"""{_P}, {spans_sql('p', 'path', _SIGNS)}, s AS (SELECT f.path, entity AS rule, CASE entity WHEN 'attorney_domain' THEN 'domain' WHEN 'attorney_name' THEN 'name' ELSE 'keyword' END AS match_type,
CAST(CASE entity WHEN 'attorney_domain' THEN 0.7 WHEN 'attorney_name' THEN 0.8 ELSE 0.9 END AS DOUBLE) AS confidence, start, "end",
CASE WHEN entity <> 'privilege_keyword' THEN match ELSE CASE WHEN start > 50 THEN '...' ELSE '' END || substr(text, greatest(0, start - 50) + 1, least(length(text), "end" + 50) - greatest(0, start - 50)) || CASE WHEN "end" + 50 < length(text) THEN '...' ELSE '' END END AS snippet
FROM f JOIN p USING (path))"""
_SUM = "m AS (SELECT path, count(*) AS findings, max(confidence) AS confidence, bool_or(match_type = 'keyword') AS has_keyword, bool_or(match_type = 'name') AS has_name, bool_or(match_type = 'domain') AS has_domain FROM s GROUP BY 1)"
_DEC = """d AS (SELECT p.path, CASE WHEN m.confidence >= 0.85 THEN 'pattern' ELSE 'model' END AS route, CASE WHEN m.confidence >= 0.85 THEN 'low' WHEN m.confidence >= 0.5 THEN 'high' ELSE 'medium' END AS reasoning_effort,
CASE WHEN m.confidence >= 0.85 THEN concat_ws(',', CASE WHEN has_keyword THEN 'PRIVILEGED:PATTERN_KEYWORD' END, CASE WHEN has_name THEN 'PRIVILEGED:ATTORNEY_NAME' END, CASE WHEN has_domain THEN 'PRIVILEGED:ATTORNEY_DOMAIN' END) ELSE '' END AS labels,
CASE WHEN m.confidence >= 0.85 THEN m.confidence ELSE 0.0::DOUBLE END AS confidence, NOT coalesce(m.confidence >= 0.85, false) AS needs_review FROM (SELECT DISTINCT path FROM p) p LEFT JOIN m USING (path))"""
_ACT = f"""{_P}, {spans_sql('p', 'path', x.PII)}, a AS (SELECT path, count(*) AS n, '[' || string_agg('{{"confidence":1.0,"end":' || "end" || ',"entity_type":"' || entity || '","page":' || (start // {PAGE}) || ',"start":' || start || ',"text":' || to_json(match) || '}}', ',' ORDER BY start, "end", entity) || ']' AS js,
list_sort(list(DISTINCT CAST(start // {PAGE} AS INTEGER))) AS pages FROM f GROUP BY 1),
c AS (SELECT path, sha256(text) AS content_hash, n, pages, js, '{{"finding_count":' || n || ',"has_offsets":true,"pages_with_findings":[' || array_to_string(pages, ',') || '],"pii_types":["EMAIL","PHONE","SSN"]}}' AS note FROM p JOIN a USING (path)),
r AS (SELECT path, content_hash, n, pages, sha256(array_to_string(list_sort([path, content_hash, js, note]), chr(10))) AS plan_id FROM c)"""
_DT = "t AS (SELECT doc_id, text FROM documents WHERE text IS NOT NULL)"
_HEAT = f"""{_SCORE}, h AS (SELECT doc_id, CAST(start // {PAGE} AS INTEGER) + 1 AS page, round(max(CASE WHEN confidence < 0.5 THEN 0.3 ELSE least(1.0, 0.3 + (confidence - 0.5) * 1.4) END), 6) AS temperature, count(*) AS n FROM z GROUP BY 1, 2)"""
_BATES = "CASE WHEN starts_with(metadata, '{') THEN json_extract_string(metadata, '$.bates') END"
_FAM = "CASE WHEN starts_with(metadata, '{') THEN nullif(json_extract_string(metadata, '$.family_id'), '') END"


def _first_hit_sql() -> str:
    parts = []
    for c, (cat, words) in r.HEURISTICS.items():
        p = "CASE " + " ".join(f"WHEN contains(l, '{w}') THEN '{w}'" for w in words) + " END"
        parts.append(f"SELECT doc_id, text, l, '{c}' AS concept, '{cat}' AS category, {p} AS w FROM d")
    return f"""WITH d AS (SELECT doc_id, text, lower(text) AS l FROM documents), h AS ({' UNION ALL '.join(parts)})
SELECT doc_id, concept, category, 0.65::DOUBLE AS confidence, CAST(strpos(l, w) - 1 AS INTEGER) AS start, CAST(strpos(l, w) - 1 + length(w) AS INTEGER) AS "end", sha256(substr(text, strpos(l, w), length(w))) AS snippet_hash FROM h WHERE w IS NOT NULL"""


def _policy_sql() -> str:
    w = "CASE " + " ".join(f"WHEN contains(lower(text), '{z}') THEN '{z}'" for z in r.SNIPPET_WORDS) + " END"
    return f"""WITH t AS (SELECT doc_id, text, {w} AS w FROM documents WHERE text IS NOT NULL), q AS (SELECT *, strpos(lower(text), w) - 1 AS p FROM t)
SELECT doc_id, CASE WHEN w IS NULL THEN substr(text, 1, 200) ELSE substr(text, greatest(0, p - 50) + 1, least(length(text), p + length(w) + 50) - greatest(0, p - 50)) END AS snippet FROM q"""


_PAGES = """pg AS (SELECT path, string_split(text, chr(10) || chr(10)) AS s FROM p), pr AS (SELECT path, i, length(s[i]) AS n FROM pg, unnest(range(1, len(s) + 1)) AS u(i)),
ps AS (SELECT path, CAST(i - 1 AS INTEGER) AS page, CAST(sum(n + 2) OVER w - n - 2 AS INTEGER) AS page_start, CAST(sum(n + 2) OVER w - 2 AS INTEGER) AS page_end FROM pr WINDOW w AS (PARTITION BY path ORDER BY i ROWS UNBOUNDED PRECEDING))"""
_LOG = """e AS (SELECT *, CASE event_type WHEN 'view' THEN 'index.search' WHEN 'click' THEN 'cli.invoke' ELSE event_type END AS operation FROM events)"""
SQL = {
    "privilege_patterns": f"WITH {_S} SELECT * FROM s",
    "privilege_patterns_default": f"WITH {_S} SELECT rule, match_type, confidence, count(*) AS n, count(DISTINCT path) AS files FROM s WHERE confidence >= 0.75 GROUP BY 1, 2, 3",
    "privilege_max_confidence": f"WITH {_S}, {_SUM} SELECT * FROM m",
    "privilege_decision": f"WITH {_S}, {_SUM}, {_DEC} SELECT * FROM d",
    "privilege_decision_forced": f"WITH {_P} SELECT 'model' AS route, 'high' AS reasoning_effort, count(DISTINCT path) AS n FROM p",
    "privilege_stage_status": f"WITH {_S}, {_SUM}, {_DEC} SELECT path, 'privilege' AS stage, 'completed' AS status, CASE WHEN reasoning_effort = 'low' THEN 'pattern' ELSE 'llm' END AS mode FROM d UNION ALL SELECT path, 'responsiveness', 'not_implemented', 'disabled' FROM d UNION ALL SELECT path, 'redaction', 'not_implemented', 'disabled' FROM d",
    "privilege_batch_review": f"""WITH {_S}, {_SUM}, {_DEC} SELECT path, '{{"confidence":' || CASE WHEN confidence = 0 THEN '0.0' ELSE CAST(confidence AS VARCHAR) END || ',"labels":[' || CASE WHEN labels = '' THEN '' ELSE '"' || replace(labels, ',', '","') || '"' END || '],"needs_review":' || needs_review || ',"path":' || to_json(path) || ',"reasoning_effort":"' || reasoning_effort || '","route":"' || route || '"}}' AS line FROM d""",
    "privilege_shown_matches": f"WITH {_S} SELECT path, CAST(count(*) AS INTEGER) AS n, CAST(count(*) FILTER (NOT regexp_matches(snippet, '[\\\\/]')) AS INTEGER) AS shown FROM s GROUP BY 1",
    "reasoning_effort": "SELECT doc_id, CASE WHEN " + " OR ".join(f"contains(lower(coalesce(text, '')), '{z}')" for z in r.COMPLEX_TERMS) + " OR length(coalesce(text, '')) > 10000 THEN 'high' WHEN length(coalesce(text, '')) > 5000 THEN 'medium' ELSE 'low' END AS effort FROM documents",
    "reasoning_hashes": f"WITH {_DT} SELECT doc_id, sha256(text || 'pepper') AS hash FROM t",
    "reasoning_summary": f"""WITH {_DT} SELECT doc_id, substr(coalesce(array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT (contains(x, '"') OR contains(lower(x), 'excerpt:') OR contains(lower(x), 'states:'))), ' '), ''), 1, 200) AS summary FROM t""",
    "policy_snippets": _policy_sql(),
    "label_predicates": """WITH l AS (SELECT DISTINCT privlog_id, basis_for_claim AS b, coalesce(len(to_names), 0) AS n, parent_or_attachment AS p FROM privilege_log),
q AS (SELECT privlog_id, upper(CASE WHEN p = 'Parent' THEN 'PRIVILEGED:' ELSE 'Non-Responsive:' END || coalesce(b, '')) AS a, n FROM l)
SELECT DISTINCT privlog_id, contains(a, 'PRIVILEGED') AS privileged, contains(a, 'RESPONSIVE') AS responsive, CAST(n AS INTEGER) AS level FROM q""",
    "answer_json": "SELECT path, CAST(i AS INTEGER) AS form, i < 3 AS same FROM (SELECT DISTINCT path, metadata FROM payloads WHERE metadata LIKE '{%}'), unnest(range(0, 4)) AS u(i)",
    "finding_lines": """SELECT event_id, event_type AS concept, 'entity' AS category, 0.5::DOUBLE AS confidence, CAST(event_id AS INTEGER) AS start, CAST(user_id AS INTEGER) AS "end" FROM events WHERE event_type IN ('click', 'view')""",
    "heuristic_first_hits": _first_hit_sql(),
    "escalation_merge": f"""{_SCORE} SELECT doc_id, rule, start, "end", round(CASE WHEN confidence < 0.85 THEN least(1.0, confidence + 0.1::DOUBLE) ELSE confidence END, 6) AS confidence, CASE WHEN confidence < 0.85 THEN 'refined' ELSE 'sure' END AS part FROM z""",
    "concept_colors": f"""{_SCORE} SELECT upper(category[1]) || category[2:] AS category, CASE category WHEN 'communication' THEN 'cyan' WHEN 'privilege' THEN 'magenta' WHEN 'hotdoc' THEN 'red' WHEN 'responsive' THEN 'green' ELSE 'yellow' END AS color, count(*) AS n FROM z GROUP BY category""",
    "redaction_plans": f"WITH {_ACT} SELECT plan_id, path, content_hash, CAST(n AS INTEGER) AS actions, array_to_string(pages, ',') AS pages FROM r",
    "redaction_actions": f"""WITH {_P}, {spans_sql('p', 'path', x.PII)} SELECT path, 'redact' AS type, entity AS category, start, "end", CAST(start // {PAGE} AS INTEGER) AS page, '[' || entity || ']' AS replacement FROM f""",
    "redaction_plan_errors": f"""WITH {_P}, {spans_sql('p', 'path', x.PII)}, q AS (SELECT path, sha256(path)[1] AS h, max("end") AS e FROM f GROUP BY 1),
w AS (SELECT 'path_missing' AS error FROM q WHERE h = '0' UNION ALL SELECT 'hash_mismatch' FROM q WHERE h IN ('1', '2', '3') UNION ALL SELECT 'id_mismatch' FROM q WHERE h = '3' UNION ALL SELECT 'span_outside' FROM q WHERE h = '2' AND e > 5)
SELECT error, count(*) AS n FROM w GROUP BY 1""",
    "highlight_plans": f"""{_SCORE}, hp AS (SELECT doc_id, count(*) AS n, list_sort(list(DISTINCT concept)) AS cs, list_sort(list(DISTINCT CAST(start // {PAGE} AS INTEGER) + 1)) AS ps, min(confidence) AS least, max(confidence) AS most FROM z GROUP BY 1)
SELECT doc_id, sha256(text) AS document_hash, CAST(n AS INTEGER) AS n, array_to_string(cs, ',') AS concepts, array_to_string(ps, ',') AS pages, least, most FROM hp JOIN documents USING (doc_id)""",
    "highlight_export": f"""{_HEAT} SELECT doc_id, '[' || string_agg('{{"page":' || page || ',"temperature":' || CAST(temperature AS DOUBLE) || ',"n":' || n || '}}', ',' ORDER BY page) || ']' AS payload FROM h GROUP BY 1""",
    "highlight_plan_ids": f"{_SCORE} SELECT count(DISTINCT sha256(text)) AS plans, count(DISTINCT sha256(text)) AS texts FROM documents WHERE doc_id IN (SELECT doc_id FROM z)",
    "page_char_spans": f"WITH {_P}, {_PAGES} SELECT * FROM ps",
    "pii_by_text_page": f"WITH {_P}, {_PAGES}, {spans_sql('p', 'path', x.PII)} SELECT f.path, entity, page, start - page_start AS from_page_start FROM f JOIN ps ON f.path = ps.path AND start >= page_start AND start < page_end",
    "redaction_pages": f"""WITH {_P}, pg AS (SELECT path, CAST(i - 1 AS INTEGER) AS page, s[i] AS t FROM (SELECT path, string_split(text, chr(10) || chr(10)) AS s FROM p), unnest(range(1, len(s) + 1)) AS u(i)),
g AS (SELECT path, min(page) FILTER (contains(t, 'privilege')) AS a, bool_or(contains(t, 'invoice')) FILTER (page = 1) AS b FROM pg GROUP BY 1)
SELECT path, 0 AS id, a AS page, CASE WHEN a IS NULL THEN 'not_found' ELSE 'applied' END AS state FROM g UNION ALL SELECT path, 1, 1, CASE WHEN b IS NULL THEN 'page_missing' WHEN b THEN 'applied' ELSE 'not_found' END FROM g
UNION ALL SELECT path, 2, 999, 'page_missing' FROM g UNION ALL SELECT path, 3, NULL, 'not_found' FROM g""",
    "highlight_boxes": f"""WITH {_DT}, {spans_sql('t', 'doc_id', {'RESPONSIVE': _CONCEPTS['RESPONSIVE']})}, k AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY start, "end") AS INTEGER) AS id FROM f),
l AS (SELECT doc_id, i, i * 60 AS s, i * 60 + 60 AS e FROM t, unnest(range(0, CAST(ceil(length(text) / 60) AS BIGINT))) AS u(i) WHERE length(text) > 0)
SELECT k.doc_id, id, CAST(i // 30 + 1 AS INTEGER) AS page, round(50 / 600.0::DOUBLE, 6) AS x0, round((50 + (i % 30) * 20) / 800.0::DOUBLE, 6) AS y0, round(550 / 600.0::DOUBLE, 6) AS x1, round((70 + (i % 30) * 20) / 800.0::DOUBLE, 6) AS y1
FROM k JOIN l ON k.doc_id = l.doc_id AND ((s <= start AND start < e) OR (s < "end" AND "end" <= e) OR (start <= s AND "end" >= e))""",
    "ocr_confidence": """WITH p AS (SELECT DISTINCT path, page, needs_ocr, text_length FROM page_analysis), c AS (SELECT path, page, bool_or(NOT needs_ocr) AS native, sum(text_length % 101 + 80) / (2 * count(*)) AS m FROM p GROUP BY 1, 2),
q AS (SELECT path, page, CASE WHEN native THEN 1.0::DOUBLE ELSE CAST(m AS DOUBLE) / 100 END AS confidence FROM c) SELECT path, page, round(confidence, 6) AS confidence, round(avg(confidence) OVER (PARTITION BY path), 6) AS document FROM q""",
    "privilege_log_generate": f"""WITH prev AS (SELECT privlog_id, min(family_id) AS family_id, min(prodbeg_doc_num) AS document FROM privilege_log GROUP BY 1), m AS (SELECT {_BATES} AS document, {_FAM} AS family_id FROM payloads),
n AS (SELECT document, min(family_id) AS family_id FROM m WHERE family_id IS NOT NULL AND document IS NOT NULL AND document NOT IN (SELECT document FROM prev WHERE document IS NOT NULL) GROUP BY 1),
z AS (SELECT *, row_number() OVER (ORDER BY family_id, document) + (SELECT max(CAST(regexp_extract(privlog_id, '([0-9]+)$', 1) AS BIGINT)) FROM prev) AS k FROM n)
SELECT privlog_id, family_id, document FROM prev UNION ALL SELECT 'PRIVID-' || lpad(CAST(k AS VARCHAR), 9, '0'), family_id, document FROM z""",
    "privilege_log_errors": """WITH r AS (SELECT DISTINCT privlog_id, family_id, prodbeg_doc_num, basis_for_claim FROM privilege_log), n AS (SELECT DISTINCT CAST(regexp_extract(privlog_id, '([0-9]+)$', 1) AS BIGINT) AS n FROM r WHERE privlog_id IS NOT NULL),
e AS (SELECT 'id_repeated' AS rule, privlog_id AS value FROM r WHERE privlog_id IS NOT NULL GROUP BY privlog_id HAVING count(*) > 1
UNION ALL SELECT 'sequence_gap', CAST(n AS VARCHAR) FROM n WHERE n + 1 NOT IN (SELECT n FROM n) AND n < (SELECT max(n) FROM n)
UNION ALL SELECT 'family_split', prodbeg_doc_num FROM r WHERE prodbeg_doc_num IS NOT NULL AND length(trim(family_id)) > 0 GROUP BY prodbeg_doc_num HAVING count(DISTINCT family_id) > 1
UNION ALL SELECT 'number_malformed', privlog_id FROM r WHERE NOT coalesce(regexp_matches(prodbeg_doc_num, '^RXL-[0-9]{9}$'), false)
UNION ALL SELECT 'basis_unknown', privlog_id FROM r WHERE NOT coalesce(trim(regexp_replace(lower(basis_for_claim), '[^a-z]+', ' ', 'g')) IN ('attorney client privilege', 'work product'), false))
SELECT rule, count(*) AS n, min(value) AS first FROM e GROUP BY 1""",
    "attorney_firm_lists": "SELECT DISTINCT list_id, kind, value FROM (SELECT list_id, 'attorney' AS kind, trim(unnest(attorneys)) AS value FROM attorney_list UNION ALL SELECT list_id, 'firm', trim(unnest(firms)) FROM attorney_list) WHERE value <> ''",
    "ledger_search_activity": f"""WITH {_LOG} SELECT 'q' || user_id AS query, 'lexical' AS mode, CAST(event_id % 10 AS VARCHAR) AS "limit", count(*) AS n, max(strftime(ts, '%Y-%m-%d %H:%M:%S')) AS last FROM e WHERE operation = 'index.search' GROUP BY 1, 2, 3""",
    "ledger_command_history": f"""WITH {_LOG} SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS timestamp, 'tool --api-key *** --Token-KEY=*** run --key --dim ' || user_id AS command_line, CAST(user_id AS VARCHAR) AS cwd FROM e WHERE operation = 'cli.invoke'""",
    "ledger_filters": f"""WITH {_LOG} SELECT 'operation' AS filter, event_id, operation FROM e WHERE operation = 'purchase' UNION ALL SELECT 'input', event_id, operation FROM e WHERE user_id = 7 UNION ALL SELECT 'output', event_id, operation FROM e WHERE event_id = 42""",
}
