"""Numbering and production: sequential and family labels, page ranges, load files, registry checks, redaction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casework.functions.text import label
from casework.shared import cut, ranked


def number(records: DataFrame, *, prefix: str = "DOC", width: int = 6, sep: str = "-") -> DataFrame:
    """sha256, path, label: sequential labels in the order (sha256, path), numbered range by range."""
    r = ranked(records.select("sha256", "path").dropDuplicates(), ["sha256", "path"])
    return r.select("sha256", "path", label(prefix, F.col("rank"), width, sep).alias("label"))


def number_families(records: DataFrame, *, prefix: str = "DOC", width: int = 6, sep: str = "-") -> DataFrame:
    """family_id, sha256, path, label: families in order, members by (sha256, path); no family: the hash."""
    r = records.withColumn("family_id", F.coalesce(F.nullif(F.trim("family_id"), F.lit("")), F.col("sha256")))
    r = ranked(r.select("family_id", "sha256", "path").dropDuplicates(), ["family_id", "sha256", "path"])
    return r.select("family_id", "sha256", "path", label(prefix, F.col("rank"), width, sep).alias("label"))


def number_pages(records: DataFrame, *, prefix: str = "ABC", width: int = 7) -> DataFrame:
    """sha256, path, pages, start_label, end_label: labels per page, by a running sum over (sha256, path)."""
    r = ranked(records.select("sha256", "path", "pages"), ["sha256", "path"], total=F.col("pages"))
    return r.select(
        "sha256", "path", "pages",
        label(prefix, F.col("running") + 1, width).alias("start_label"), label(prefix, F.col("running") + F.col("pages"), width).alias("end_label"),
    )


# The header of the production load file.
PRODUCTION_HEADER = "DOCID|BEGDOC|ENDDOC|PAGECOUNT|FILEPATH|SHA256"


def production_dat(pages: DataFrame) -> DataFrame:
    """line_no, line of the load file: the header is line 0, then the documents in the order of their first label."""
    name = F.replace(F.element_at(F.split("path", "/"), -1), F.lit("|"), F.lit("\\|"))
    r = ranked(pages.select("start_label", "end_label", "pages", "path", "sha256"), ["start_label", "sha256", "path"])
    lines = r.select(F.col("rank").cast("long").alias("line_no"), F.concat_ws("|", "start_label", "start_label", "end_label", F.col("pages").cast("string"), name, "sha256").alias("line"))
    head = pages.sparkSession.createDataFrame([(0, PRODUCTION_HEADER)], "line_no long, line string")
    return head.unionByName(lines)


def load_file(pages: DataFrame, kind: str) -> DataFrame:
    """line_no, line of a load file of this kind: dat or opticon; others are not there."""
    if kind == "dat":
        return production_dat(pages)
    if kind == "opticon":
        r = ranked(pages, ["start_label", "sha256", "path"])
        o = opticon(r.drop("rank")).join(r.select("start_label", "rank"), "start_label")
        return o.select((6 * (F.col("rank") - 1) + F.col("line_no")).cast("long").alias("line_no"), "line")
    raise NotImplementedError(f"no load file of kind {kind!r}")


def opticon(pages: DataFrame) -> DataFrame:
    """start_label, line_no, line: six lines per document."""
    name = F.element_at(F.split("path", "/"), -1)
    lines = F.array(F.lit("IMAGE"), F.col("start_label"), name, F.lit("Y"), F.col("pages").cast("string"), F.lit(""))
    return pages.select("start_label", F.posexplode(lines).alias("line_no", "line"))


def registry_violations(registry: DataFrame, files: DataFrame) -> DataFrame:
    """document, bates_id, rule of a label registry (document, sha256, bates_id) held against files (path, sha256).

    Rules: missing_field, duplicate_id, duplicate_hash, missing_file, hash_mismatch.
    """
    f = files.groupBy(F.col("path").alias("document")).agg(F.min(F.lower("sha256")).alias("have"))
    count = lambda c, n: registry.where(F.col(c).isNotNull() & (F.col(c) != "")).groupBy(c).agg(F.count(F.lit(1)).alias(n))
    r = registry.join(count("bates_id", "_ids"), "bates_id", "left").join(count("sha256", "_hashes"), "sha256", "left")
    r = r.join(f, "document", "left")
    empty = lambda c: F.col(c).isNull() | (F.col(c) == "")
    rules = F.array_compact(
        F.array(
            F.when(empty("bates_id") | empty("sha256") | empty("document"), "missing_field"),
            F.when(~empty("bates_id") & (F.col("_ids") > 1), "duplicate_id"),
            F.when(~empty("sha256") & (F.col("_hashes") > 1), "duplicate_hash"),
            F.when(~empty("document") & F.col("have").isNull(), "missing_file"),
            F.when(F.col("have") != F.lower("sha256"), "hash_mismatch"),
        )
    )
    return r.select("document", "bates_id", F.explode(rules).alias("rule"))


def label_number(label_: Column) -> Column:
    """The number at the end of a label; labels wider than their padding sort by it, not by their letters."""
    return F.regexp_extract(label_, r"([0-9]+)$", 1).try_cast("long")


def label_prefix(label_: Column) -> Column:
    return F.regexp_replace(label_, r"[0-9]+$", "")


def overlaps(ranges: DataFrame) -> DataFrame:
    """Label ranges that begin before an earlier one of their prefix has ended: start_label, end_label, before.

    ``before`` is the largest end of all earlier ranges, so a range nested in another hides none.  The order is by first,
    then last number; ranges without numbers are left out; of equal ranges all but one overlap.
    """
    r = ranges.select("start_label", "end_label", label_prefix(F.col("start_label")).alias("prefix"), label_number(F.col("start_label")).alias("a"), label_number(F.col("end_label")).alias("b"))
    r = ranked(r.where("a is not null and b is not null"), ["prefix", "a", "b", "start_label", "end_label"])
    # the largest end before a row: within its block of numbers, and over the blocks before, one row per block
    size = 4096
    r = cut(r.withColumn("block", F.floor((F.col("rank") - 1) / size)))
    end = F.struct("b", "end_label")
    inner = Window.partitionBy("prefix", "block").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy("prefix").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = r.groupBy("prefix", "block").agg(F.max(end).alias("m")).withColumn("carried", F.max("m").over(outer)).drop("m")
    r = r.withColumn("inside", F.max(end).over(inner)).join(carried, ["prefix", "block"])
    most = F.greatest("inside", "carried")
    return r.select("start_label", "end_label", "a", most.alias("m")).where("m.b >= a").select("start_label", "end_label", F.col("m.end_label").alias("before"))


def check_plan(records: DataFrame, files: DataFrame) -> DataFrame:
    """path, error of records (path, sha256) that can't be numbered: duplicate_path, duplicate_hash, missing_file, hash_mismatch."""
    r = records.select("path", F.lower("sha256").alias("sha256"))
    paths = r.groupBy("path").agg(F.count(F.lit(1)).alias("np"))
    hashes = r.where("sha256 is not null").groupBy("sha256").agg(F.count(F.lit(1)).alias("nh"))
    f = files.groupBy("path").agg(F.min(F.lower("sha256")).alias("have"))
    j = r.join(paths, "path", "left").join(hashes, "sha256", "left").join(f, "path", "left")
    error = F.array_compact(F.array(
        F.when(F.col("np") > 1, "duplicate_path"), F.when(F.col("nh") > 1, "duplicate_hash"), F.when(F.col("have").isNull(), "missing_file"),
        F.when(F.col("have") != F.col("sha256"), "hash_mismatch"),
    ))
    return j.select("path", F.explode(error).alias("error"))


def prefix_errors(labels: DataFrame, prefix: str, column: str = "label") -> DataFrame:
    """The labels that don't begin with ``prefix``."""
    return labels.where(~F.coalesce(F.col(column).startswith(prefix), F.lit(False)))


def wrong_prefix(labels: DataFrame, prefix: str, column: str = "label") -> None:
    """Raises where a label has another prefix, with the number of such labels."""
    n = prefix_errors(labels, prefix, column).count()
    if n:
        raise ValueError(f"{n} labels do not begin with {prefix!r}")


# Places of a stamp as shares of the page's width and height, margins and metrics in points.
STAMP_PLACES = {"bottom-right": (0.85, 0.85), "bottom-center": (0.5, 0.85), "top-right": (0.85, 0.15)}
MARGIN = 36.0


def stamp_boxes(pages: DataFrame, place: str = "bottom-right", size: float = 10.0) -> DataFrame:
    """``pages`` (width, height, label) with the box of the label (x0, y0, x1, y1), kept within the margins.

    The box is half the letter size wide for each letter (at least twice the size) and 1.2 sizes high, around the place.
    """
    px, py = STAMP_PLACES[place]
    w = F.greatest(F.lit(size * 0.5) * F.length("label"), F.lit(size * 2))
    h = F.lit(size * 1.2)
    x = F.greatest(F.lit(MARGIN), F.least(F.col("width") * px - w / 2, F.col("width") - MARGIN - w))
    y = F.greatest(F.lit(MARGIN), F.least(F.col("height") * py - h / 2, F.col("height") - MARGIN - h))
    return pages.withColumns({"x0": x, "y0": y, "x1": x + w, "y1": y + h})


def rgb(color: Column) -> Column:
    """#RRGGBB as an array of three numbers from 0 to 1; null for anything else."""
    c = F.regexp_extract(F.coalesce(color, F.lit("")), "^#?([0-9A-Fa-f]{6})$", 1)
    part = lambda i: F.conv(F.substring(c, i, 2), 16, 10).cast("int") / 255.0
    return F.when(F.length(c) == 6, F.array(part(1), part(3), part(5)))


def apply_spans(text, found, by=lambda s: F.concat(F.lit("["), s["entity"], F.lit("]"))):
    """``text`` with the spans of the sorted array ``found`` (start, end, entity) replaced; overlaps are skipped."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc, s):
        piece = F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), by(s))
        return F.when(s["start"] >= acc["at"], F.struct(s["end"].alias("at"), piece.alias("out"))).otherwise(acc)

    done = F.aggregate(found, start, step)
    return F.coalesce(F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text))), text)
