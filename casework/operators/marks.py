"""Redaction and highlight plans: ids, actions, annotations, checks, pages and boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casework.functions.text import input_hash
from casework.operators.detect import COLORS, heatmap, shade


def actions(findings: DataFrame, key: str) -> DataFrame:
    """``key``, actions: the findings (entity, start, end, match, page) of a document as the actions of a plan, by place."""
    a = F.struct(
        F.col("start"), F.col("end"), F.col("entity").alias("entity_type"), F.lit(1.0).alias("confidence"), F.col("page"), F.col("match").alias("text"),
    )
    return findings.groupBy(key).agg(F.array_sort(F.collect_list(a)).alias("actions"))


def pipeline_action(action: Column) -> Column:
    """The short form of an action, with what the text is replaced by."""
    return F.struct(
        F.lit("redact").alias("type"), action["entity_type"].alias("category"), action["start"].alias("start"), action["end"].alias("end"), action["page"].alias("page"),
        action["confidence"].alias("confidence"), F.concat(F.lit("["), action["entity_type"], F.lit("]")).alias("replacement"),
    )


def redaction_annotations(acts: Column, types: list[str]) -> Column:
    """What a plan says of its actions: kinds asked for, their number, the pages, and whether places are known."""
    pages = F.array_sort(F.array_distinct(F.filter(F.transform(acts, lambda a: a["page"]), lambda p: p.isNotNull())))
    return F.struct(
        F.size(acts).alias("finding_count"), F.exists(acts, lambda a: a["start"].isNotNull()).alias("has_offsets"), pages.alias("pages_with_findings"),
        F.array(*[F.lit(x) for x in sorted(types)]).alias("pii_types"),
    )


def _json(value: Column) -> Column:
    """JSON with the fields of each object in order (structs are built so)."""
    return F.to_json(value, {"ignoreNullFields": "false"})


def _ordered(acts: Column) -> Column:
    return F.transform(acts, lambda a: F.struct(*[a[c].alias(c) for c in ("confidence", "end", "entity_type", "page", "start", "text")]))


def plan_id(content_hash: Column, acts: Column, annotations: Column, path: Column | None = None) -> Column:
    """The id of a plan: over the content hash, the actions and annotations as JSON, and for redactions the path.

    Two plans have one id only if all of these are the same; empty actions take no part.
    """
    parts = [content_hash, F.when(F.size(acts) > 0, _json(acts)), _json(annotations)]
    return input_hash(F.array_compact(F.array(*([path] if path is not None else []), *parts)))


def redaction_plans(docs: DataFrame, findings: DataFrame, *, types: list[str]) -> DataFrame:
    """plan_id, path, content_hash, actions, annotations of every document (path, text) with findings of the ``types``."""
    a = actions(findings.where(F.col("entity").isin(types)), "path").withColumn("actions", _ordered(F.col("actions")))
    d = docs.select("path", F.sha2("text", 256).alias("content_hash")).join(a, "path")
    d = d.withColumn("annotations", redaction_annotations(F.col("actions"), types))
    return d.select(plan_id(F.col("content_hash"), F.col("actions"), F.col("annotations"), F.col("path")).alias("plan_id"), "path", "content_hash", "actions", "annotations")


def plan_errors(plans: DataFrame, docs: DataFrame) -> DataFrame:
    """path, error of plans that do not belong to the documents as they are: path_missing, hash_mismatch, id_mismatch, span_outside.

    ``docs``: path, text.  The id is computed again from what the plan says.
    """
    d = docs.select("path", F.sha2("text", 256).alias("have"), F.length("text").alias("n"))
    j = plans.join(d, "path", "left")
    error = F.array_compact(F.array(
        F.when(F.col("have").isNull(), "path_missing"), F.when(F.col("have") != F.col("content_hash"), "hash_mismatch"),
        F.when(F.col("plan_id") != plan_id(F.col("content_hash"), F.col("actions"), F.col("annotations"), F.col("path")), "id_mismatch"),
        F.when(F.exists("actions", lambda a: (a["end"] > F.col("n")) | (a["start"] < 0) | (a["end"] <= a["start"])), "span_outside"),
    ))
    return j.select("path", F.explode(error).alias("error"))


def color(category: Column) -> Column:
    """The colour of a category, whatever its case; yellow for one that has none."""
    table = F.create_map(*[F.lit(x) for kv in COLORS.items() for x in kv])
    return F.coalesce(F.element_at(table, F.lower(category)), F.lit("yellow"))


def highlights(findings: DataFrame, key: str) -> DataFrame:
    """``key``, highlights of a document by place: concept, category, start, end, page, confidence, color, shade."""
    h = F.struct(
        F.col("start"), F.col("end"), F.col("concept"), F.col("category"), F.col("confidence"), F.col("page"), color(F.col("category")).alias("color"), F.round(shade(F.col("confidence")), 6).alias("shade"),
    )
    return findings.groupBy(key).agg(F.array_sort(F.collect_list(h)).alias("highlights"))


def highlight_plans(docs: DataFrame, findings: DataFrame, key: str) -> DataFrame:
    """plan_id, ``key``, document_hash, highlights, annotations; the id leaves the path out, so a moved file keeps its plan."""
    h = highlights(findings, key).withColumn(
        "highlights", F.transform("highlights", lambda a: F.struct(*[a[c].alias(c) for c in ("category", "color", "concept", "confidence", "end", "page", "shade", "start")]))
    )
    d = docs.select(key, F.sha2("text", 256).alias("document_hash")).join(h, key)
    hs = F.col("highlights")
    each = lambda name: F.transform(hs, lambda a: a[name])
    note = F.struct(
        F.array_sort(F.array_distinct(each("concept"))).alias("concepts"), F.size(hs).alias("highlight_count"), F.array_max(each("confidence")).alias("most"),
        F.array_min(each("confidence")).alias("least"), F.array_sort(F.array_distinct(F.filter(each("page"), lambda p: p.isNotNull()))).alias("pages"),
    )
    d = d.withColumn("annotations", note)
    return d.select(plan_id(F.col("document_hash"), hs, F.col("annotations")).alias("plan_id"), key, "document_hash", "highlights", "annotations")


def export(plans: DataFrame, key: str, kind: str = "json") -> DataFrame:
    """``key``, payload: what a viewer loads, as JSON; kind ``heatmap`` has the pages' heat alone."""
    if kind not in ("json", "heatmap"):
        raise ValueError("an export is json or heatmap")
    e = plans.select(key, F.explode("highlights").alias("h")).select(key, "h.page", "h.confidence")
    heat = heatmap(e, key).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("page", "temperature", "n"))).alias("heatmap"))
    j = plans.join(heat, key, "left").withColumn("heatmap", F.coalesce("heatmap", F.expr("cast(array() as array<struct<page:int,temperature:double,n:bigint>>)")))
    if kind == "heatmap":
        return j.select(key, _json(F.col("heatmap")).alias("payload"))
    legend = F.create_map(*[F.lit(x) for kv in sorted(COLORS.items()) for x in kv])
    return j.select(key, _json(F.struct(legend.alias("color_legend"), "document_hash", "heatmap", "highlights")).alias("payload"))


def page_spans(texts: DataFrame, key: str, separator: str = "\n\n", text: str = "text") -> DataFrame:
    """``key``, page (from 0), page_start, page_end of the pages that stand in a text one after the other, with ``separator`` between."""
    width = len(separator)
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<page_start:int,page_end:int>>)").alias("out"))

    def step(acc: Column, p: Column) -> Column:
        end = acc["at"] + F.length(p)
        return F.struct((end + width).alias("at"), F.concat(acc["out"], F.array(F.struct(acc["at"].alias("page_start"), end.alias("page_end")))).alias("out"))

    pages = F.aggregate(F.split(F.col(text), _quoted(separator), -1), start, step, lambda acc: acc["out"])
    return texts.select(key, F.posexplode(pages).alias("page", "p")).select(key, "page", "p.*")


def _quoted(s: str) -> str:
    return "\\Q" + s + "\\E"


def first_pages(entries: DataFrame, pages: DataFrame, key: str) -> DataFrame:
    """``entries`` (id, needle, page) with the page each is applied to: its own if it is there and holds the needle, or, without
    one, the first page with a hit; state: applied, page_missing, not_found.

    ``pages``: ``key``, page, text.
    """
    own = entries.where("page is not null").join(pages.select(key, "page", F.col("text").alias("_t")), [key, "page"], "left")
    state = F.when(F.col("_t").isNull(), "page_missing").when(F.col("_t").contains(F.col("needle")), "applied").otherwise("not_found")
    own = own.select(key, "id", "page", state.alias("state"))
    free = entries.where("page is null").drop("page")
    hit = free.join(pages.select(key, "page", F.col("text").alias("_t")), key).where(F.col("_t").contains(F.col("needle"))).groupBy(key, "id").agg(F.min("page").alias("page"))
    rest = free.select(key, "id").join(hit, [key, "id"], "left")
    return own.unionByName(rest.select(key, "id", "page", F.when(F.col("page").isNull(), "not_found").otherwise("applied").alias("state")))


def unit_box(box: Column, width: Column, height: Column) -> Column:
    """A box (array of x0, y0, x1, y1) in shares of the page; 0 where the page has no size."""
    part = lambda i, n: F.when(F.coalesce(n, F.lit(0.0)) != 0, box[i] / n).otherwise(0.0)
    return F.struct(part(0, width).alias("x0"), part(1, height).alias("y0"), part(2, width).alias("x1"), part(3, height).alias("y1"))


def boxes(marks: DataFrame, layout: DataFrame, key: str) -> DataFrame:
    """``key``, id, page, box of the layout spans that a mark (id, start, end, page) touches.

    ``layout``: ``key``, page, width, height, start, end, bbox.  A span is touched if the mark begins in it, ends in it, or holds it;
    a mark with a page keeps to that page.  An equi join on the document, then the range.
    """
    m = marks.select(key, "id", F.col("start").alias("_a"), F.col("end").alias("_b"), F.col("page").alias("_p"))
    a, b, s, e = F.col("_a"), F.col("_b"), F.col("start"), F.col("end")
    touch = ((s <= a) & (a < e)) | ((s < b) & (b <= e)) | ((a <= s) & (b >= e))
    j = m.join(layout.where("bbox is not null"), key).where(touch & (F.col("_p").isNull() | (F.col("_p") == F.col("page"))))
    return j.select(key, "id", "page", unit_box(F.col("bbox"), F.col("width"), F.col("height")).alias("box"))


def ocr_confidence(tokens: DataFrame, key: str) -> DataFrame:
    """``key``, page, confidence of each page, and the document's mean, from recognised words (``key``, page, native, conf).

    A page with a text layer counts 1; of the others the words' mean, without those at -1, over 100; 0 where none is left.
    """
    p = tokens.groupBy(key, "page").agg(F.bool_or("native").alias("native"), F.avg(F.when(F.col("conf") != -1, F.col("conf"))).alias("m"))
    p = p.select(key, "page", F.when(F.col("native"), 1.0).otherwise(F.coalesce(F.col("m") / 100, F.lit(0.0))).alias("confidence"))
    d = p.groupBy(key).agg(F.avg("confidence").alias("document"))
    return p.join(d, key)


def needs_ocr(text: Column) -> Column:
    """A page with ten characters or fewer needs recognition."""
    return F.length(F.trim(F.coalesce(text, F.lit("")))) <= 10


def order_within(findings: DataFrame, key: str) -> DataFrame:
    """``findings`` with their number in the document, by place."""
    return findings.withColumn("id", F.row_number().over(Window.partitionBy(key).orderBy("start", "end", "entity")))
