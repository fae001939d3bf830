"""The pipeline from a folder to a production, packs and their checks, stores of plans, reports, guards."""

from __future__ import annotations

import html
import json
import time
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casework.functions.text import input_hash
from casework.operators import manifest as m
from casework.operators import produce
from casework.sources import files

STAGES = ("discover", "dedupe", "redaction_plan", "bates_plan", "manifest", "pack")


class Offline(RuntimeError):
    """A feature needs the network and may not use it."""


def require_online(feature: str, online: bool) -> None:
    if not online:
        raise Offline(f"{feature} needs the network, which is off")


def run(spark: SparkSession, root: str, out: str, *, skip: tuple[str, ...] = (), prefix: str = "DOC", width: int = 6) -> list[dict]:
    """Discovers, de-duplicates, plans redactions, numbers, writes the manifest and the pack of a folder.

    Gives a row per stage: name, status (completed, skipped, failed), seconds, rows, detail.  Stages in ``skip`` are
    left out; after a failure the rest is skipped.  What a stage made is written below ``out`` before the next one reads it.
    """
    report, state = [], {}
    unknown = set(skip) - set(STAGES)
    if unknown:
        raise ValueError(f"no such stages: {sorted(unknown)}")

    def put(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{out}/{name}")
        return spark.read.parquet(f"{out}/{name}")

    def discover():
        state["all"] = state["docs"] = put(files.discover(spark, root), "discovered")
        return state["docs"].count()

    def dedupe():
        state["docs"] = put(m.first_by_hash(state["docs"]), "unique")
        return state["docs"].count()

    def redaction_plan():
        from casework.operators import detect, marks

        texts = files.extract(spark, root).where("text is not null").select("path", "text").join(state["docs"].select("path"), "path", "left_semi")
        found = detect.pattern_findings(texts, "path", detect.PII).withColumn("page", F.lit(None).cast("int"))
        state["plans"] = put(marks.redaction_plans(texts, found, types=list(detect.PII)), "redaction_plans")
        return state["plans"].count()

    def bates_plan():
        state["labels"] = put(produce.number(state["docs"], prefix=prefix, width=width), "bates_plan")
        return state["labels"].count()

    def manifest():
        files.write_jsonl(state["docs"], f"{out}/manifest")
        return state["docs"].count()

    def pack():
        return write_pack(state["docs"], f"{out}/pack")["documents"]

    steps = dict(zip(STAGES, (discover, dedupe, redaction_plan, bates_plan, manifest, pack)))
    failed = False
    for name in STAGES:
        if name in skip or failed:
            report.append({"name": name, "status": "skipped", "seconds": 0.0, "rows": 0, "detail": "" if name in skip else "an earlier stage failed"})
            continue
        began = time.monotonic()
        try:
            n, status, detail = steps[name](), "completed", ""
        except Exception as e:
            n, status, detail, failed = 0, "failed", f"{type(e).__name__}: {e}"[:300], True
        report.append({"name": name, "status": status, "seconds": round(time.monotonic() - began, 3), "rows": n, "detail": detail})
    if "dedupe" in skip and not failed and state.get("docs") is not None:
        n = m.duplicate_groups(state["docs"]).count()
        if n:
            report.append({"name": "dedupe", "status": "failed", "seconds": 0.0, "rows": n, "detail": f"{n} hashes stand for several files"})
    return report


def failed_stages(report: DataFrame) -> DataFrame:
    return report.agg(F.count_if(F.col("status") == "failed").alias("failed"))


def write_pack(records: DataFrame, out: str, *, natives: bool = True) -> dict:
    """A pack: natives by content (one row per hash, with the bytes), metadata as JSON lines, and a manifest of the artifacts.

    The files are read and written by the executors.  ``records``: manifest records with paths that they can read.
    """
    spark = records.sparkSession
    files.write_jsonl(records, f"{out}/metadata")
    artifacts = ["metadata"]
    if natives:
        want = records.select("path", "sha256", "extension")
        paths = [r["path"] for r in records.select(F.regexp_replace("path", "/[^/]*$", "").alias("path")).distinct().limit(10_000).collect()]
        if paths:
            raw = spark.read.format("binaryFile").load(sorted(paths)).select(F.regexp_replace("path", "^file:/+", "/").alias("path"), "content")
            raw.join(want, "path").select(F.concat("sha256", "extension").alias("name"), "content").dropDuplicates(["name"]).write.mode("overwrite").parquet(f"{out}/natives")
            artifacts.append("natives")
    body = totals(records).first().asDict() | {"artifacts": sorted(artifacts)}
    spark.createDataFrame([(json.dumps(body, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{out}/manifest")
    return body


def check_pack(spark: SparkSession, out: str) -> list[str]:
    """What is wrong with a pack: no manifest, an artifact that can't be read, natives that are missing or whose bytes have another hash."""
    try:
        body = json.loads(spark.read.text(f"{out}/manifest").first()[0])
    except Exception:
        return ["manifest cannot be read"]
    errors = []
    for a in body["artifacts"]:
        try:
            (spark.read.json(f"{out}/{a}") if a == "metadata" else spark.read.parquet(f"{out}/{a}")).limit(1).count()
        except Exception:
            errors.append(f"{a} cannot be read")
    if not errors and "natives" in body["artifacts"]:
        have = spark.read.parquet(f"{out}/natives").select(F.split("name", r"\.")[0].alias("sha256"), F.sha2("content", 256).alias("now"))
        want = spark.read.json(f"{out}/metadata").select(F.lower("sha256").alias("sha256")).distinct()
        missing = want.join(have, "sha256", "left_anti").count()
        torn = have.where("sha256 <> now").count()
        errors += [f"{missing} natives are missing"] * (missing > 0) + [f"{torn} natives have another hash"] * (torn > 0)
    return errors


def totals(records: DataFrame) -> DataFrame:
    """One row: documents, pages (of the metadata), bytes, the earliest and latest day."""
    pages = F.element_at("metadata", "pages").try_cast("long") if "metadata" in records.columns else F.lit(0).cast("long")
    return records.agg(
        F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum(pages), F.lit(0)).alias("pages"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"),
        F.concat_ws(" to ", F.left(F.min("mtime"), F.lit(10)), F.left(F.max("mtime"), F.lit(10))).alias("date_range"),
    )


def production_totals(records: DataFrame, labels: DataFrame, plans: DataFrame) -> DataFrame:
    """One row: the totals, the first and last label (by document order) of ``labels`` (sha256, path, label), and the number of redaction plans.

    ``bates_range`` is null without labels.
    """
    order = F.struct("sha256", "path")
    ends = labels.agg(F.min_by("label", order).alias("a"), F.max_by("label", order).alias("b"))
    n = plans.agg(F.count(F.lit(1)).alias("redactions"))
    one = totals(records).crossJoin(F.broadcast(ends)).crossJoin(F.broadcast(n))  # a row each
    return one.withColumn("bates_range", F.when(F.col("a").isNotNull(), F.concat_ws(" - ", "a", "b"))).drop("a", "b")


def methods_appendix(records: DataFrame, ledger: DataFrame, out: str | None = None, *, most: int = 10_000) -> dict:
    """How a collection was handled: its size and hash, the searches and commands of a ledger (the last ``most`` of each), masked.

    With ``out`` it is also written as JSON.
    """
    from casework.operators import review

    last = lambda df: [r.asDict() for r in df.orderBy(F.desc("timestamp")).limit(most).collect()][::-1]
    body = {
        "documents": records.count(), "manifest_hash": manifest_hash(records).first()[0],
        "searches": last(review.search_activity(ledger)), "commands": last(review.command_history(ledger)),
    }
    if out is not None:
        write_report(body, out)
    return body


def sidecars(records: DataFrame, files_: DataFrame, suffix: str) -> DataFrame:
    """The records beside which a file with the same stem and ``suffix`` stands; a semi join on the stem."""
    stem = lambda c: F.regexp_replace(F.col(c), r"\.[^./]+$", "")
    have = files_.where(F.col("path").endswith(suffix)).select(F.left("path", F.length("path") - len(suffix)).alias("_stem"))
    return records.withColumn("_stem", stem("path")).join(have, "_stem", "left_semi").drop("_stem")


def csv_line(columns: list[str]) -> Column:
    """A line of CSV: a field is quoted only where it holds a quote, comma or line end; quotes are doubled."""
    def field(c: str) -> Column:
        v = F.coalesce(F.col(c).cast("string"), F.lit(""))
        return F.when(v.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(v)

    return F.concat_ws(",", *[field(c) for c in columns])


def html_report(records: DataFrame, title: str, out: str | None = None) -> str:
    """A page with the totals and the custodians' and doctypes' counts; values are escaped.  Only rollups reach the driver."""
    t = totals(records).first()
    part = {}
    for c in ("custodian", "doctype"):
        part[c] = records.groupBy(m.named(c, "unknown").alias("k")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "k").limit(1000).collect()
    rows = lambda c: "".join(f"<tr><td>{html.escape(str(r['k']))}</td><td>{r['n']}</td></tr>" for r in part[c])
    page = f"<!doctype html><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1><p>{t['documents']} documents, {t['pages']} pages, {t['date_range']}</p>"
    page += "".join(f"<h2>{c}</h2><table>{rows(c)}</table>" for c in part)
    if out is not None:
        _put(Path(out), page)
    return page


def _put(path: Path, text: str) -> None:
    """Writes a small file whole or not at all."""
    tmp = path.with_suffix(path.suffix + ".tmp")
    tmp.write_text(text, encoding="utf-8")
    tmp.replace(path)


def write_report(row: dict, out: str) -> None:
    """One row (an impact report, a methods appendix) as JSON with its keys in order."""
    _put(Path(out), json.dumps(row, sort_keys=True, indent=2, default=str) + "\n")


def dataset_hash(df: DataFrame) -> DataFrame:
    """One row: n and an order-free hash over all rows, the sum of the first twelve digits of each row's SHA-256."""
    line = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in sorted(df.columns)])
    part = F.conv(F.substring(F.sha2(line, 256), 1, 12), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(part), F.lit(0)).cast("string").alias("sum"))


def deterministic(make: Callable[[], DataFrame], times: int = 2) -> bool:
    """Whether ``make`` gives the same rows each time."""
    return len({tuple(dataset_hash(make()).first()) for _ in range(times)}) == 1


def manifest_hash(records: DataFrame) -> DataFrame:
    """One row: the hash over the set of records, each by its SHA-256 or, without one, its path, in parts of the first two digits.

    The hash of a set is the hash of its parts' hashes, so no task holds all of it.
    """
    item = F.coalesce(F.nullif(F.lower("sha256"), F.lit("")), F.col("path"))
    part = records.select(item.alias("x"), F.substring(F.sha2(item, 256), 1, 2).alias("p")).where("x is not null").distinct()
    return part.groupBy("p").agg(input_hash(F.collect_list("x")).alias("h")).agg(input_hash(F.collect_list("h")).alias("manifest_hash"))


def schema_counts(records: DataFrame) -> DataFrame:
    """schema_id, valid, invalid: records without and with a broken rule of a manifest record."""
    bad = m.violations(records).select("path").distinct().withColumn("_bad", F.lit(True))
    j = records.join(bad, "path", "left")
    wrong = F.coalesce("_bad", F.lit(False)) | F.col("path").isNull()
    return j.groupBy("schema_id").agg(F.count_if(~wrong).alias("valid"), F.count_if(wrong).alias("invalid"))


class Migrations:
    """Steps from one version of a schema to the next, each a function of a frame; no step back, none left out."""

    def __init__(self):
        self.steps: dict[tuple[str, int], Callable[[DataFrame], DataFrame]] = {}

    def add(self, schema_id: str, version: int, step: Callable[[DataFrame], DataFrame]) -> None:
        self.steps[schema_id, version] = step

    def apply(self, df: DataFrame, schema_id: str, have: int, want: int) -> DataFrame:
        if want < have:
            raise ValueError(f"{schema_id} cannot go back from {have} to {want}")
        missing = [v for v in range(have, want) if (schema_id, v) not in self.steps]
        if missing:
            raise ValueError(f"{schema_id} has no step from {missing[0]}")
        for v in range(have, want):
            df = self.steps[schema_id, v](df)
        return df.withColumn("schema_version", F.lit(want))


def content_hash(df: DataFrame) -> Column:
    """SHA-256 of a row as JSON with its keys in order, without what a stamp adds."""
    cols = sorted(c for c in df.columns if c not in ("producer", "produced_at", "schema_id", "schema_version"))
    return F.sha2(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}), 256)


def sample_by_hash(df: DataFrame, key: str, n: int, seed: int = 0, *, pages: tuple[int | None, int | None] = (None, None), column: str = "pages") -> DataFrame:
    """A sample of ``n`` rows, the same for the same seed, of those whose page count lies in ``pages`` (either end may be open)."""
    low, high = pages
    if low is not None:
        df = df.where(F.col(column) >= low)
    if high is not None:
        df = df.where(F.col(column) <= high)
    return df.orderBy(F.xxhash64(F.lit(seed), key), key).limit(n)


def wrapped(row: Column, schema_id: str, version: int) -> Column:
    """A row as the JSON a command prints: data with its schema."""
    return F.to_json(F.struct(row.alias("data"), F.lit(schema_id).alias("schema_id"), F.lit(version).alias("schema_version")))


def check_inputs(*, query: str | None = None, threshold: float | None = None, effort: str | None = None, stage: int | None = None) -> None:
    """Raises for a query without words, a threshold outside of [0, 1], an unknown effort or stage."""
    if query is not None and not query.strip():
        raise ValueError("the query is empty")
    if threshold is not None and not 0 <= threshold <= 1:
        raise ValueError("the threshold must lie between 0 and 1")
    if effort is not None and effort not in ("low", "medium", "high"):
        raise ValueError("the effort must be low, medium or high")
    if stage is not None and stage not in (1, 2, 3):
        raise ValueError("the stage must be 1, 2 or 3")


def load_profile(path: str) -> dict:
    """A detection profile from YAML or JSON; an empty one where the file is missing or empty."""
    p = Path(path)
    if not p.exists():
        return {}
    text = p.read_text(encoding="utf-8")
    try:
        import yaml
    except ImportError:
        return json.loads(text) if text.strip() else {}
    return yaml.safe_load(text) or {}


def health(spark: SparkSession) -> list[tuple[str, bool, str]]:
    """name, fine, detail of what the library needs: a session, the shared folder, and the optional libraries."""
    from importlib.util import find_spec

    from casework.shared import work_dir

    out = [("spark", True, spark.version)]
    try:
        out.append(("shared folder", True, work_dir(spark)))
    except Exception as e:
        out.append(("shared folder", False, str(e)))
    return out + [(lib, find_spec(lib) is not None, "optional") for lib in ("pypdf", "yaml")]
