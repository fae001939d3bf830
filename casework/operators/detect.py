"""Detectors: pattern spans, keyword findings, concepts and their scoring from context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casework.functions.text import EMAIL, PHONE, SSN, spans

# Keywords and patterns whose findings must be the same everywhere.
PII = {"EMAIL": EMAIL, "PHONE": PHONE, "SSN": SSN}
KEYWORDS = (
    "attorney-client privilege", "attorney client privilege", "work product", "privileged communication", "confidential legal advice",
    "attorney work product", "lawyer client privilege", "legal advice", "protected by privilege", "subject to privilege",
)
CONCEPTS = {
    "EMAIL_HEADER": ("communication", 0.80, r"\b(from|to|cc|bcc):\s+\S+@\S+"),
    "EMAIL_ADDRESS": ("communication", 0.65, r"\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b"),
    "LEGAL_ADVICE": ("privilege", 0.70, r"\b(privileged|attorney[\-\s]client|work[\-\s]product|legal advice|counsel advises|confidential communication|protected by privilege|litigation hold)\b"),
    "KEY_PARTY": ("entity", 0.60, r"\b(plaintiff|defendant|respondent|claimant|petitioner|appellee|appellant|patent\s*(?:#|no\.?|number)?\s*\d+|contract\s*(?:#|no\.?)?\s*\d+)\b"),
    "HOTDOC": ("hotdoc", 0.75, r"\b(violat(?:e|ed|es|ing)|smoking gun|destroy(?:ed|ing)?|shred(?:ded|ding)?|cover(?:ed|ing)?\s+up|i knew this was wrong|don'?t tell anyone|delete(?:d|ing)?\s+(?:all\s+)?(?:the\s+)?(?:files?|emails?|documents?)|off the record|between us|keep(?:ing)?\s+this\s+quiet|nobody needs to know|hide(?:s|ing)?(?:\s+(?:this|the|from))|never happened|forget(?:\s+(?:this|about|we))|shouldn'?t have|illegal|fraud(?:ulent)?|bribe|kickback|falsif(?:y|ied|ying))\b"),
    "RESPONSIVE": ("responsive", 0.55, r"\b(claim(?:s|ed|ing)?|alleg(?:e|ed|es|ations?)|damages?|breach(?:ed|ing)?|infring(?:e|ed|es|ement)|liabl(?:e|ility)|negligen(?:t|ce)|malpractice|misrepresent(?:ed|ation)?|material(?:ly)?\s+false|settlement|arbitrat(?:e|ion)|mediat(?:e|ion)|injunction|discovery request|interrogator(?:y|ies)|subpoena|deposition|demand letter|cease and desist|cause of action)\b"),
}
ATTORNEY = r"(?i)@(?:[\w-]+\.)*(?:law|legal|attorney|counsel|lawfirm|esq)\b|\b(?:esquire|esq\.?|attorney at law|counsel)\b"
LEGAL = r"(?i)\b(?:hereby|pursuant to|in accordance with|notwithstanding|whereas|stipulate|enjoin|adjudicate|memorandum of law|motion to|brief in support|declaration of)\b"
QUOTED = r"(?im)^[>\|]{1,}\s*|(?:^|\n)-{3,}[^\n]*?(?:forwarded|original)[^\n]*?-{3,}|(?:^|\n)on\s+[^\n]{1,50}?\s+wrote:\s*$|(?:^|\n)from:[^\n]*\nsent:[^\n]*\nto:|\[cid:|<image\d+\."
#: Patterns of one concept; a pattern that is not listed is a concept of its own.
CONCEPT_OF = {"EMAIL_HEADER": "EMAIL_COMMUNICATION", "EMAIL_ADDRESS": "EMAIL_COMMUNICATION"}
COLORS = {"communication": "cyan", "privilege": "magenta", "entity": "yellow", "hotdoc": "red", "responsive": "green"}


_NONE = "cast(array() as array<struct<start:int,end:int,match:string>>)"


def _tagged(text: Column, pattern: str, **tags: Column) -> Column:
    """The spans of a pattern with constant columns in front."""
    found = F.coalesce(spans(text, pattern), F.expr(_NONE))
    return F.transform(found, lambda s: F.struct(*[v.alias(k) for k, v in tags.items()], s["start"].alias("start"), s["end"].alias("end"), s["match"].alias("match")))


def pattern_findings(docs: DataFrame, key: str, patterns: dict[str, str], text: str = "text") -> DataFrame:
    """``key``, entity, start, end, match of every match, each pattern in one pass over the text."""
    each = [_tagged(F.col(text), f"(?i){p}", entity=F.lit(k)) for k, p in patterns.items()]
    return docs.select(key, F.explode(F.concat(*each)).alias("f")).select(key, "f.*")


def keyword_findings(docs: DataFrame, key: str, text: str = "text", keywords=KEYWORDS) -> DataFrame:
    """``key``, keyword, start, end: every place of every keyword, whatever its case, also inside words."""
    each = [_tagged(F.lower(F.col(text)), k, keyword=F.lit(k)) for k in keywords]  # no keyword holds a sign of a pattern
    return docs.select(key, F.explode(F.concat(*each)).alias("f")).select(key, "f.keyword", "f.start", "f.end")


def page_of(findings: DataFrame, pages: DataFrame, key: str) -> DataFrame:
    """Findings with the page (page_start <= start < page_end) they begin on: an equi join on the document, then the range."""
    cond = (F.col("start") >= F.col("page_start")) & (F.col("start") < F.col("page_end"))
    return findings.join(pages, key).where(cond).drop("page_start", "page_end")


def _near(signals: Column, start: Column, end: Column, window: int) -> Column:
    return F.exists(signals, lambda m: (m["start"] <= end + window) & (m["end"] >= start - window))


def concept_scores(docs: DataFrame, key: str, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """``key``, rule, concept, category, start, end, confidence, needs_refinement of every concept finding.

    The base of the concept, +0.10 for a lawyer within 300 characters, +0.05 for legal phrases within 200, +0.05
    for each (at most 3) kind of other finding within reach of 500, -0.15 for quoted text within 100; at most
    1, at least ``threshold``, which is a floor and drops nothing.  All per document, without a join.
    """
    each = [
        _tagged(F.col(text), f"(?i){p}", rule=F.lit(k), concept=F.lit(CONCEPT_OF.get(k, k)), category=F.lit(cat), base=F.greatest(F.lit(threshold), F.lit(base)))
        for k, (cat, base, p) in CONCEPTS.items()
    ]
    signal = {n: F.coalesce(spans(F.col(text), p), F.expr(_NONE)) for n, p in (("_law", ATTORNEY), ("_legal", LEGAL), ("_quoted", QUOTED))}
    d = docs.select(key, F.concat(*each).alias("_all"), *[v.alias(n) for n, v in signal.items()])
    f = d.select(key, "_all", *signal, F.posexplode("_all").alias("_i", "f"))
    s, e = F.col("f.start"), F.col("f.end")
    lo = F.greatest(F.lit(0), s - 500)
    others = F.filter(
        F.transform("_all", lambda x, i: F.struct(i.alias("i"), x.alias("x"))),
        lambda z: (z["i"] != F.col("_i")) & (z["x"]["start"] >= lo - 500) & (z["x"]["start"] <= e + 500) & (z["x"]["end"] >= lo),
    )
    kinds = F.size(F.array_distinct(F.transform(others, lambda z: z["x"]["concept"])))
    total = (
        F.col("f.base")
        + F.when(_near(F.col("_law"), s, e, 300), 0.10).otherwise(0.0)
        + F.when(_near(F.col("_legal"), s, e, 200), 0.05).otherwise(0.0)
        + F.lit(0.05) * F.least(kinds, F.lit(3))
        + F.when(_near(F.col("_quoted"), s, e, 100), -0.15).otherwise(0.0)
    )
    conf = F.greatest(F.lit(threshold), F.least(F.lit(1.0), total))
    out = f.select(key, "f.rule", "f.concept", "f.category", "f.start", "f.end", F.round(conf, 6).alias("confidence"))
    return out.withColumn("needs_refinement", (F.col("confidence") >= 0.5) & (F.col("confidence") < 0.85))


def shade(confidence: Column) -> Column:
    return F.when(confidence < 0.5, 0.3).otherwise(F.least(F.lit(1.0), 0.3 + (confidence - 0.5) * 1.4))


def heatmap(findings: DataFrame, key: str) -> DataFrame:
    """``key``, page, temperature (largest shade), n per page; findings without a page are left out."""
    return (
        findings.where("page is not null").groupBy(key, "page").agg(F.round(F.max(shade(F.col("confidence"))), 6).alias("temperature"), F.count(F.lit(1)).alias("n"))
    )


def annotations(findings: DataFrame, key: str) -> DataFrame:
    """Per document: concepts (sorted, joined by a comma), n, least and largest confidence."""
    return findings.groupBy(key).agg(
        F.array_join(F.array_sort(F.collect_set("concept")), ",").alias("concepts"), F.count(F.lit(1)).alias("n"),
        F.min("confidence").alias("least"), F.max("confidence").alias("most"),
    )
