"""Mixing sources to target weights (problem 9).

Method: every document gets a hash-random key; the documents of a source are range-sorted by it, a
distributed prefix sum of their token counts gives each its place, and each source is cut where its budget
is met.  A source smaller than its budget is repeated, at most ``max_repeats`` times in all.
"""

from __future__ import annotations

import base64
import importlib.util

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from casework.llm.common import cut, read

TOKENIZERS = "/opt/tokenizers"
_ENC: dict[int, object] = {}


def encoder(ranks: bytes, pattern: str):
    """A tiktoken encoding of the bytes of a rank file; one per process."""
    name = hash((ranks, pattern))
    if name not in _ENC:
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        _ENC[name] = tiktoken.Encoding("public", pat_str=pattern, mergeable_ranks=table, special_tokens={})
    return _ENC[name]


def pattern_of(folder: str) -> str:
    """The split pattern published with the vocabulary files in ``folder``."""
    spec = importlib.util.spec_from_file_location("_public_tokenizers", f"{folder}/__init__.py")
    mod = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(mod)
    return mod.PATTERN


def token_counts(docs: DataFrame, *, text: str, tokenizers: str, vocabulary: str) -> DataFrame:
    """``docs`` (any columns) with ``text`` replaced by ``tokens``.  The rank file is read by the driver and broadcast, about 1 MB."""
    with open(f"{tokenizers}/{vocabulary}", "rb") as f:
        ranks = docs.sparkSession.sparkContext.broadcast(f.read())
    pattern = pattern_of(tokenizers)
    rest = [c for c in docs.columns if c != text]
    schema = docs.select(*rest).schema.add("tokens", "long")

    def run(batches):
        enc = encoder(ranks.value, pattern)
        for pdf in batches:
            out = pdf[rest].copy()
            out["tokens"] = [0 if t is None else len(enc.encode_ordinary(t)) for t in pdf[text]]
            yield out

    return docs.mapInPandas(run, schema)


def mix(
    documents: DataFrame,
    targets: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    seed: int = 42,
    bucket_rows: int = 50_000,
    total_tokens: int | None = None,
    tokenizers: str = TOKENIZERS,
    vocabulary: str = "byte_bpe_50k.tiktoken",
) -> DataFrame:
    """The mixture: doc_id, source, tokens, copies (times used, at least 1), share (actual, of the source).

    The total is the largest that every listed source with documents can fill at its share within
    ``max_repeats``, unless ``total_tokens`` sets it.  Listed sources without documents give no rows and
    their share is spread over the rest in proportion; sources not listed take no part.  A source is
    cut at the document whose middle token lies beyond its budget, so it misses it by half a document at most.

    Rows with a null id, source or text, and empty texts, take no part; repeated rows count once; ties of
    the random key are broken by id; of two texts under one id the one with fewer tokens counts.  Targets that repeat a source: the first by (share, repeats) holds;
    null or non-positive shares or repeats exclude it.  Empty tables give an empty mixture.

    A hot source does not meet one task: keys are cut in ranges of at most some ``bucket_rows`` documents, sums per range
    are added up first (a row per source and range), and only inside a range a window runs.  The order is by key alone, so
    the ranges do not change the result.
    """
    t = (
        targets.where("target_share > 0 and max_repeats > 0 and source is not null")
        .groupBy("source")
        .agg(F.min(F.struct("target_share", "max_repeats")).alias("t"))
        .select(F.col("source").alias("_s"), "t.*")
    )
    d = documents.select(
        F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.col(text).alias("_text")
    ).where("doc_id is not null and source is not null and length(_text) > 0")
    d = d.join(t.select(F.col("_s").alias("source")), "source", "left_semi").select("doc_id", "source", "_text")
    counted = cut(
        token_counts(d, text="_text", tokenizers=tokenizers, vocabulary=vocabulary)
        .where("tokens > 0")
        .groupBy("doc_id", "source")
        .agg(F.min("tokens").alias("tokens"))
    )
    bits = max(4, (counted.count() // bucket_rows).bit_length())  # as if one source held all
    key = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("source")), 1)
    keyed = counted.withColumn("_k", key).withColumn("_b", F.shiftrightunsigned("_k", 63 - bits))
    ranges = keyed.groupBy("source", "_b").agg(F.sum("tokens").alias("n"))
    w = Window.partitionBy("source").orderBy("_b")
    before = ranges.select(
        "source", "_b", (F.sum("n").over(w) - F.col("n")).alias("_before")
    )
    # a row per listed source, however large the corpus: the budgets are set on the driver
    have = ranges.groupBy("source").agg(F.sum("n").alias("have")).join(t.withColumnRenamed("_s", "source"), "source").collect()
    weight = sum(r["target_share"] for r in have)
    total = total_tokens
    if total is None:
        total = min((r["have"] * r["max_repeats"] * weight / r["target_share"] for r in have), default=0)
    rows = [
        (r["source"], r["have"], min(int(total * r["target_share"] / weight + 1e-6), r["have"] * r["max_repeats"])) for r in have
    ]
    plan = documents.sparkSession.createDataFrame(rows, "source string, have long, budget long")
    inside = Window.partitionBy("source", "_b").orderBy("_k", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = keyed.join(before, ["source", "_b"]).join(plan, "source")
    placed = placed.withColumn("_at", F.col("_before") + F.coalesce(F.sum("tokens").over(inside), F.lit(0)))
    full = F.floor(F.col("budget") / F.col("have"))
    rest = F.col("budget") - full * F.col("have")
    copies = full + F.when(F.col("_at") + F.col("tokens") / 2 <= rest, 1).otherwise(0)
    used = placed.withColumn("copies", copies.cast("int")).where("copies > 0").select("doc_id", "source", "tokens", "copies")
    n = F.sum(F.col("tokens") * F.col("copies"))
    share = used.groupBy("source").agg(n.alias("_n")).withColumn(
        "share", F.col("_n") / F.sum("_n").over(Window.partitionBy(F.lit(1)))
    ).select("source", "share")  # a row per source
    return used.join(share, "source").select("doc_id", "source", "tokens", "copies", "share")


def shares(mixture: DataFrame, targets: DataFrame) -> DataFrame:
    """Per listed source: target_share, actual_share, tokens, documents, most_copies; zeros where none."""
    m = mixture.groupBy("source").agg(
        F.sum(F.col("tokens") * F.col("copies")).alias("tokens"),
        F.count(F.lit(1)).alias("documents"),
        F.max("copies").alias("most_copies"),
        F.max("share").alias("actual_share"),
    )
    return (
        targets.select("source", "target_share", "max_repeats")
        .join(m, "source", "left")
        .fillna(0, ["tokens", "documents", "most_copies"])
        .fillna(0.0, ["actual_share"])
    )


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mix(read(spark, d, "documents"), read(spark, d, "mix_targets"))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return shares(p9_mixture(spark, d), read(spark, d, "mix_targets"))


QUERIES = {"p9_mixture": p9_mixture, "p9_shares": p9_shares}
SQL: dict[str, str] = {}
