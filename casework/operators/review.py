"""Review of documents: privilege patterns, staged decisions, findings from models, labels, the privilege log."""

from __future__ import annotations

import re
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casework.functions.text import hmac_sha256, label
from casework.operators.detect import KEYWORDS, _tagged
from casework.shared import ranked

# Confidences, bounds, and word lists whose results must be the same everywhere.
PATTERN_CONFIDENCE = {"attorney_domain": ("domain", 0.7), "attorney_name": ("name", 0.8), "privilege_keyword": ("keyword", 0.9)}
DOMAIN_LIMIT, NAME_LIMIT, KEYWORD_LIMIT = 0.5, 0.8, 0.9
SKIP_AT, ESCALATE_AT = 0.85, 0.50
COMPLEX_TERMS = ("attorney-client privilege", "work product", "common interest", "legal opinion", "confidential communication")
SNIPPET_WORDS = ("attorney-client", "privileged", "work product", "confidential legal", "legal advice")
HEURISTICS = {
    "EMAIL_COMMUNICATION": ("communication", ("from:", "subject:", "@")),
    "LEGAL_ADVICE": ("privilege", ("counsel", "attorney", "legal advice", "privileged")),
    "KEY_PARTY": ("entity", ("plaintiff", "defendant", "party", "claim")),
    "HOTDOC": ("hotdoc", ("violate", "knew this was", "smoking gun", "destroy", "shred")),
    "RESPONSIVE": ("responsive", ("damages", "breach", "liable", "negligent", "settlement")),
}
FINDING = "concept string, category string, start int, end int, confidence double"


def context(text: Column, start: Column, end: Column, around: int = 50) -> Column:
    """The match with ``around`` characters on each side, dots where the text goes on."""
    a, b = F.greatest(F.lit(0), start - around), F.least(F.length(text), end + around)
    return F.concat(F.when(a > 0, "...").otherwise(""), F.substring(text, a + 1, b - a), F.when(b < F.length(text), "...").otherwise(""))


def privilege_patterns(docs: DataFrame, key: str, *, domains=(), names=(), keywords=KEYWORDS, threshold: float = 0.75, text: str = "text") -> DataFrame:
    """``key``, rule, match_type, confidence, start, end, snippet of every sign of privilege at or above ``threshold``.

    Addresses at a lawyer's domain count 0.7 and are looked for only with a threshold of 0.5 or less; lawyers' names, as
    whole words, 0.8; keywords, also inside words, 0.9.  Case does not matter.  Null texts give no rows.
    """
    alike = lambda xs: "|".join(re.escape(x) for x in xs)
    each = []
    if domains and threshold <= DOMAIN_LIMIT:
        each.append(_tagged(F.col(text), f"(?i)@(?:{alike(domains)})", rule=F.lit("attorney_domain")))
    if names and threshold <= NAME_LIMIT:
        each.append(_tagged(F.col(text), rf"(?i)\b(?:{alike(names)})\b", rule=F.lit("attorney_name")))
    if keywords and threshold <= KEYWORD_LIMIT:
        each.append(_tagged(F.col(text), f"(?i)(?:{alike(keywords)})", rule=F.lit("privilege_keyword")))
    kind = lambda i: F.element_at(F.create_map(*[F.lit(x) for k, v in PATTERN_CONFIDENCE.items() for x in (k, v[i])]), F.col("f.rule"))
    none = F.expr("cast(array() as array<struct<rule:string,start:int,end:int,match:string>>)")
    d = docs.select(key, F.col(text).alias("_t"), F.explode(F.concat(none, *each)).alias("f"))
    snippet = F.when(F.col("f.rule") == "privilege_keyword", context(F.col("_t"), F.col("f.start"), F.col("f.end"))).otherwise(F.col("f.match"))
    out = d.select(key, "f.rule", kind(0).alias("match_type"), kind(1).alias("confidence"), "f.start", "f.end", snippet.alias("snippet"))
    return out.where(F.col("confidence") >= threshold)


def privilege_summary(findings: DataFrame, key: str) -> DataFrame:
    """``key``, findings, confidence (the largest), and whether a keyword, name, domain was met."""
    has = lambda k: F.bool_or(F.col("match_type") == k).alias(f"has_{k}")
    return findings.groupBy(key).agg(F.count(F.lit(1)).alias("findings"), F.max("confidence").alias("confidence"), has("keyword"), has("name"), has("domain"))


def privilege_decisions(docs: DataFrame, summary: DataFrame, key: str, *, force: bool = False) -> DataFrame:
    """``key``, route, reasoning_effort, labels, confidence, needs_review of every document: the first stage.

    Route ``pattern``: signs of 0.85 or more decide alone; ``model`` otherwise, with high effort for signs from 0.5 or where
    ``force`` is set, with medium effort without signs.  What goes to a model needs review until a model has answered.
    """
    d = docs.select(key).distinct().join(summary, key, "left")
    sure = F.coalesce(F.col("confidence") >= SKIP_AT, F.lit(False)) & F.lit(not force)
    some = F.coalesce(F.col("confidence") >= ESCALATE_AT, F.lit(False)) | F.lit(force)
    labels = F.array_compact(
        F.array(F.when(F.col("has_keyword"), "PRIVILEGED:PATTERN_KEYWORD"), F.when(F.col("has_name"), "PRIVILEGED:ATTORNEY_NAME"), F.when(F.col("has_domain"), "PRIVILEGED:ATTORNEY_DOMAIN"))
    )
    return d.select(
        key, F.when(sure, "pattern").otherwise("model").alias("route"), F.when(sure, "low").when(some, "high").otherwise("medium").alias("reasoning_effort"),
        F.when(sure, labels).otherwise(F.expr("cast(array() as array<string>)")).alias("labels"),
        F.when(sure, F.col("confidence")).otherwise(F.lit(0.0)).alias("confidence"), (~sure).alias("needs_review"),
    )


def stage_status(decisions: DataFrame, key: str) -> DataFrame:
    """``key``, stage, status, mode: three rows per decision; the second and third stage are not there."""
    mode = F.when(F.col("reasoning_effort") == "low", "pattern").otherwise("llm")
    row = lambda s, st, m: F.struct(F.lit(s).alias("stage"), F.lit(st).alias("status"), m.alias("mode"))
    rows = F.array(row("privilege", "completed", mode), row("responsiveness", "not_implemented", F.lit("disabled")), row("redaction", "not_implemented", F.lit("disabled")))
    return decisions.select(key, F.explode(rows).alias("s")).select(key, "s.*")


def shown_matches(matches: Column) -> Column:
    """Findings as they may be shown: rule, confidence, and the snippet only where it holds no slash."""
    snippet = lambda m: F.when(~m["snippet"].rlike(r"[\\/]"), m["snippet"])
    return F.transform(matches, lambda m: F.struct(m["rule"].alias("rule"), m["confidence"].alias("confidence"), snippet(m).alias("snippet")))


def effort(text: Column) -> Column:
    """How hard a model should think: high for telling terms or more than 10,000 characters, medium above 5,000, else low."""
    low = F.lower(F.coalesce(text, F.lit("")))
    telling = F.lit(False)
    for t in COMPLEX_TERMS:
        telling = telling | low.contains(t)
    n = F.length(low)
    return F.when(telling | (n > 10000), "high").when(n > 5000, "medium").otherwise("low")


def policy_snippet(text: Column) -> Column:
    """The surroundings of the first keyword in the list that occurs; without one, the first 200 characters; null for null."""
    low = F.lower(text)
    out = F.substring(text, 1, 200)
    for w in reversed(SNIPPET_WORDS):
        p = F.locate(w, low)
        a = F.greatest(F.lit(0), p - 1 - 50)
        out = F.when(p > 0, F.substring(text, a + 1, F.least(F.length(text), p - 1 + len(w) + 50) - a)).otherwise(out)
    return out


def reasoning_hash(reasoning: Column, salt: str) -> Column:
    return F.sha2(F.concat(reasoning, F.lit(salt)), 256)


def safe_summary(reasoning: Column) -> Column:
    """What may be kept of a reasoning: no line with a quotation or excerpt, 200 characters at most."""
    fine = F.filter(F.split(reasoning, "\n"), lambda x: ~(x.contains('"') | F.lower(x).contains("excerpt:") | F.lower(x).contains("states:")))
    return F.left(F.array_join(fine, " "), F.lit(200))


def is_privileged(labels: Column) -> Column:
    """Any label that has the word in it, be it NON-PRIVILEGED."""
    return F.exists(labels, lambda x: F.upper(x).contains("PRIVILEGED"))


def is_responsive(labels: Column) -> Column:
    return F.exists(labels, lambda x: F.upper(x).contains("RESPONSIVE"))


def hotdoc_level(labels: Column) -> Column:
    """The number of the first HOTDOC label that has one; null without."""
    levels = F.transform(F.filter(labels, lambda x: F.upper(x).startswith("HOTDOC:")), lambda x: F.get(F.split(x, ":"), F.lit(1)).try_cast("int"))
    return F.get(F.filter(levels, lambda x: x.isNotNull()), F.lit(0))


def json_object(text: Column) -> Column:
    """The JSON object in a model's answer, as a string: the whole, a fenced block, or the first to the last brace; null without."""
    whole = F.regexp_extract(text, r"(?s)^\s*(.*?)\s*$", 1)
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)\s*```", 1)
    braces = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    valid = lambda c: F.when(F.try_parse_json(c).isNotNull() & c.startswith("{"), c)
    return F.coalesce(valid(whole), valid(fenced), valid(braces))


def parse_findings(lines: DataFrame, column: str = "line") -> DataFrame:
    """``lines`` with concept, category, confidence, start, end from a JSON object or five parts between bars; what is neither is left out."""
    line = F.trim(column)
    j = F.from_json(line, "concept string, category string, confidence string, start string, end string")
    p = F.transform(F.split(line, r"\|"), lambda x: F.trim(x))
    is_json, whole = line.startswith("{"), F.size(p) == 5
    part = lambda name, i: F.trim(F.when(is_json, j[name]).when(whole, F.get(p, F.lit(i))))
    out = lines.withColumns(
        {
            "concept": part("concept", 0), "category": part("category", 1), "confidence": part("confidence", 2).try_cast("double"),
            "start": part("start", 3).try_cast("int"), "end": part("end", 4).try_cast("int"),
        }
    )
    return out.where("concept <> '' and category <> '' and confidence is not null and start is not null and end is not null")


def first_hits(docs: DataFrame, key: str, *, concepts=None, threshold: float = 0.5, text: str = "text") -> DataFrame:
    """``key``, concept, category, confidence, start, end, snippet_hash: for each concept, its first keyword (in the list's order) that occurs."""
    low = F.lower(text)
    found = []
    for concept, (category, words) in HEURISTICS.items():
        if concepts and concept not in concepts:
            continue
        hits = F.filter(F.array(*[F.struct(F.locate(w, low).alias("p"), F.lit(len(w)).alias("n")) for w in words]), lambda h: h["p"] > 0)
        h = F.get(hits, F.lit(0))
        piece = F.substring(F.col(text), h["p"], h["n"])
        found.append(F.when(h.isNotNull(), F.struct(
            F.lit(concept).alias("concept"), F.lit(category).alias("category"), F.lit(max(threshold, 0.65)).alias("confidence"),
            (h["p"] - 1).alias("start"), (h["p"] - 1 + h["n"]).alias("end"), F.sha2(piece, 256).alias("snippet_hash"),
        )))
    return docs.select(key, F.explode(F.array_compact(F.array(*found))).alias("f")).select(key, "f.*")


def no_findings(docs: DataFrame, key: str) -> DataFrame:
    """The detector that finds nothing."""
    return docs.select(key, *[F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in FINDING.split(", ")]).limit(0)


def enabled_entities(requested: list[str], enabled: list[str]) -> list[str]:
    """What was asked for and is enabled, in the order of asking; all that is enabled where nothing was asked for."""
    return [x for x in dict.fromkeys(requested) if x in set(enabled)] if requested else list(dict.fromkeys(enabled))


def refine(findings: DataFrame, scorer: Callable | None = None, *, threshold: float = 0.5) -> DataFrame:
    """The sure findings and the uncertain ones (0.5 to 0.85, or marked so) as a scorer sees them, with ``part``: sure, refined, or kept.

    ``scorer``: function of a pandas frame of findings to new confidences, called batch by batch; a batch it fails on is kept
    as it is.  Scores are brought into [threshold, 1].  Without a scorer the uncertain ones are kept.
    """
    doubt = F.coalesce(F.col("needs_refinement"), F.lit(False)) | ((F.col("confidence") >= ESCALATE_AT) & (F.col("confidence") < SKIP_AT))
    sure = findings.where(~doubt).withColumn("part", F.lit("sure"))
    rest = findings.where(doubt).withColumn("part", F.lit("kept"))
    if scorer is None:
        return sure.unionByName(rest)

    def run(batches):
        for pdf in batches:
            try:
                score = [min(1.0, max(threshold, float(x))) for x in scorer(pdf)]
                yield pdf.assign(confidence=score, part="refined")
            except Exception:
                yield pdf

    return sure.unionByName(rest.mapInPandas(run, rest.schema))


class Breaker:
    """Guards calls of a service: after ``failures`` in a row it is open and refuses calls for ``seconds``, then lets one try."""

    def __init__(self, failures: int = 5, seconds: float = 60.0, clock=time.monotonic):
        self.most, self.seconds, self.clock = failures, seconds, clock
        self.failed, self.opened = 0, None

    @property
    def state(self) -> str:
        if self.opened is None:
            return "closed"
        return "half_open" if self.clock() - self.opened >= self.seconds else "open"

    def call(self, f, *args):
        if self.state == "open":
            raise RuntimeError("the service is not called: it failed too often")
        try:
            out = f(*args)
        except Exception:
            self.failed += 1
            if self.failed >= self.most or self.opened is not None:
                self.opened = self.clock()
            raise
        self.failed, self.opened = 0, None
        return out


def log_entries(withheld: DataFrame, previous: DataFrame, *, prefix: str = "PRIVID", width: int = 4) -> DataFrame:
    """The privilege log with the entries of ``withheld`` (family_id, document) that ``previous`` has not, by family, then document.

    ``previous``: privlog_id, family_id, document.  New numbers go on from its largest; its own entries stay as they are.
    Documents are taken once; a null document is left out.
    """
    last = previous.agg(F.coalesce(F.max(F.regexp_extract("privlog_id", r"([0-9]+)$", 1).try_cast("long")), F.lit(0)).alias("last"))
    new = withheld.where("document is not null").groupBy("document").agg(F.min("family_id").alias("family_id"))
    new = new.join(previous.select("document").distinct(), "document", "left_anti").withColumn("_f", F.coalesce("family_id", "document"))
    r = ranked(new, ["_f", "document"]).crossJoin(F.broadcast(last))  # one row
    r = r.select(label(prefix, F.col("rank") + F.col("last"), width, "-").alias("privlog_id"), "family_id", "document")
    return previous.select("privlog_id", "family_id", "document").unionByName(r)


def log_errors(log: DataFrame, bases: list[str], *, number: str = r"^[A-Z]+-?[0-9]+$") -> DataFrame:
    """rule, value of what is wrong in a log (privlog_id, family_id, prodbeg_doc_num, basis_for_claim), repeated rows aside.

    Rules: id_repeated, sequence_gap (a number whose next one is missing before the last), family_split (one document
    number in several families), number_malformed, basis_unknown (compared by its letters).
    """
    r = log.select("privlog_id", "family_id", "prodbeg_doc_num", "basis_for_claim").dropDuplicates()
    n = F.regexp_extract("privlog_id", r"([0-9]+)$", 1).try_cast("long")
    ids = r.where("privlog_id is not null").groupBy("privlog_id").agg(F.count(F.lit(1)).alias("k"))
    nums = r.select(n.alias("n")).where("n is not null").distinct()
    last = nums.agg(F.max("n").alias("most"))
    gap = nums.join(nums.select((F.col("n") - 1).alias("n")), "n", "left_anti").crossJoin(F.broadcast(last)).where("n < most")  # one row
    fam = r.where("prodbeg_doc_num is not null and length(trim(family_id)) > 0").groupBy("prodbeg_doc_num").agg(F.countDistinct("family_id").alias("k")).where("k > 1")
    basis = F.trim(F.regexp_replace(F.lower("basis_for_claim"), "[^a-z]+", " "))
    row = lambda df, rule, value: df.select(F.lit(rule).alias("rule"), value.cast("string").alias("value"))
    return (
        row(ids.where("k > 1"), "id_repeated", F.col("privlog_id"))
        .unionByName(row(gap, "sequence_gap", F.col("n")))
        .unionByName(row(fam, "family_split", F.col("prodbeg_doc_num")))
        .unionByName(row(r.where(~F.coalesce(F.col("prodbeg_doc_num").rlike(number), F.lit(False))), "number_malformed", F.col("privlog_id")))
        .unionByName(row(r.where(~F.coalesce(basis.isin(bases), F.lit(False))), "basis_unknown", F.col("privlog_id")))
    )


def attorney_lists(lists: DataFrame) -> DataFrame:
    """list_id, kind, value: attorneys and firms, each once, without blanks around and nulls."""
    one = lambda c, k: lists.select("list_id", F.lit(k).alias("kind"), F.explode(c).alias("value"))
    both = one("attorneys", "attorney").unionByName(one("firms", "firm"))
    return both.withColumn("value", F.trim("value")).where("value <> ''").distinct()


def argv(tokens: Column) -> Column:
    """A command line with the values of all flags that end in ``key`` masked, inline or in the next token if that is no flag."""
    secret = lambda x: F.split(F.lower(x), "=")[0].startswith("--") & F.split(F.lower(x), "=")[0].endswith("key")
    start = F.struct(F.lit("").alias("last"), F.expr("cast(array() as array<string>)").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        value = (acc["last"] != "") & ~x.startswith("-")
        shown = F.when(value, F.lit("***")).when(secret(x) & x.contains("="), F.concat(F.split(x, "=")[0], F.lit("=***"))).otherwise(x)
        asks = ~value & secret(x) & ~x.contains("=")
        return F.struct(F.when(asks, "1").otherwise("").alias("last"), F.concat(acc["out"], F.array(shown)).alias("out"))

    return F.array_join(F.aggregate(tokens, start, step, lambda acc: acc["out"]), " ")


def search_activity(ledger: DataFrame) -> DataFrame:
    """timestamp, query, mode, limit, dim of the searches in a ledger (args as JSON)."""
    arg = lambda k: F.get_json_object("args", f"$.{k}").alias(k)
    return ledger.where("operation = 'index.search'").select("timestamp", arg("query"), arg("mode"), arg("limit"), arg("dim"))


def command_history(ledger: DataFrame) -> DataFrame:
    """timestamp, command_line (masked), cwd of the commands in a ledger; a line that was kept as text stays as it is."""
    raw = F.coalesce(F.get_json_object("args", "$.command_line"), F.get_json_object("args", "$.argv"))
    toks = F.from_json(raw, "array<string>")
    line = F.when(raw.startswith("["), argv(toks)).otherwise(F.coalesce(raw, F.lit("")))
    return ledger.where("operation = 'cli.invoke'").select("timestamp", line.alias("command_line"), F.get("inputs", F.lit(0)).alias("cwd"))


def entry_signature(key: bytes, sequence: Column, previous: Column, entry: Column, last_signature: Column) -> Column:
    """The long form of an entry's signature: over its number, both hashes and the signature before it."""
    return hmac_sha256(key, F.concat_ws("|", sequence.cast("string"), previous, entry, F.coalesce(last_signature, F.lit(""))))


def batch_review(docs: DataFrame, decisions: DataFrame, key: str) -> DataFrame:
    """``key``, line: one JSON line per document with its decision, for a file written in the order of the key."""
    r = docs.select(key).distinct().join(decisions, key, "left")
    return r.select(key, F.to_json(F.struct(*sorted(r.columns))).alias("line"))
