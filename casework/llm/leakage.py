"""Evaluation texts leaking into training text (problem 8).

Method: greedy string tiling.  Runs of ``min_tile`` consecutive words are the seeds; corpus and items are
joined on the seeds' Karp-Rabin hashes, and in each (document, item) pair that shares a seed the longest
common runs are marked as tiles, longest first and never overlapping.  The share of the item's words
under tiles is its coverage, so passages in another order still add up.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casework.llm.common import read, rolling, word_hashes, words

SCHEMA = "doc_id long, item_id long, longest int, tiled int, item_words int, coverage double"


def tiles(doc: np.ndarray, item: np.ndarray, min_tile: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling of two word-hash arrays: (start in doc, start in item, length), longest first.

    Ties go to the earliest place in the document, then in the item.
    """
    if len(doc) < min_tile or len(item) < min_tile:
        return []
    hd, hi = rolling(doc, min_tile), rolling(item, min_tile)
    order = np.argsort(hi, kind="stable")
    s = hi[order]
    lo, hi_ = np.searchsorted(s, hd, "left"), np.searchsorted(s, hd, "right")
    seeds: set[tuple[int, int]] = set()
    for d in np.flatnonzero(hi_ > lo).tolist():
        for k in range(lo[d], hi_[d]):
            seeds.add((d, int(order[k])))
    # maximal runs on each diagonal
    runs = []
    for d, i in seeds:
        if (d - 1, i - 1) in seeds:
            continue
        n = 0
        while (d + n, i + n) in seeds:
            n += 1
        runs.append((n + min_tile - 1, d, i))
    used_d, used_i = np.zeros(len(doc), bool), np.zeros(len(item), bool)
    out = []
    import heapq

    heap = [(-n, d, i) for n, d, i in runs]
    heapq.heapify(heap)
    while heap:
        n, d, i = heapq.heappop(heap)
        n = -n
        free = ~(used_d[d : d + n] | used_i[i : i + n])
        if free.all():
            used_d[d : d + n] = True
            used_i[i : i + n] = True
            out.append((d, i, n))
            continue
        # what is left of the run between the tiles already set goes back
        edges = np.flatnonzero(np.diff(np.concatenate(([0], free.astype(np.int8), [0]))))
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if b - a >= min_tile:
                heapq.heappush(heap, (-(b - a), d + a, i + a))
    return out


def _row(doc_id, item_id, dh, ih, min_tile):
    t = tiles(dh, ih, min_tile)
    if not t:
        return None
    tiled = sum(x[2] for x in t)
    return doc_id, item_id, max(x[2] for x in t), tiled, len(ih), tiled / len(ih)


def leaks(
    documents: DataFrame,
    items: DataFrame,
    *,
    doc_id: str = "doc_id",
    doc_text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    min_tile: int = 13,
    min_coverage: float = 0.0,
    broadcast_seeds: int = 2_000_000,
) -> DataFrame:
    """One row per (document, item) that share a run of at least ``min_tile`` words.

    Columns: doc_id, item_id, longest (words of the longest tile), tiled (item words under tiles),
    item_words, coverage = tiled / item_words; rows under ``min_coverage`` are left out.

    Null or short texts match nothing; repeated rows count once; other columns are ignored whatever their
    names; empty tables give no rows.  The items' seeds are broadcast when there are at most
    ``broadcast_seeds`` of them (8 bytes each; counted first).  More are joined by shuffle; the result is
    the same.
    """
    spark = documents.sparkSession
    docs = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(doc_text).alias("text")).where(
        "doc_id is not null and text is not null"
    )
    its = (
        items.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).alias("item_text"))
        .where("item_id is not null and item_text is not null")
        .distinct()
    )
    # a word takes two characters with its blank, so this bounds the seeds from above without a word count
    bound = its.select(F.coalesce(F.sum(F.length("item_text")), F.lit(0))).first()[0] // 2
    if bound <= broadcast_seeds:
        found = _broadcast(spark, docs, its, min_tile)
    else:
        found = _shuffled(docs, its, min_tile)
    return found.where(F.col("coverage") >= min_coverage).distinct() if min_coverage else found.distinct()


def _broadcast(spark: SparkSession, docs: DataFrame, its: DataFrame, min_tile: int) -> DataFrame:
    texts = [(r[0], word_hashes(words(r[1]))) for r in its.collect()]  # bounded by broadcast_seeds
    seeds = [(h, k) for k, (_, wh) in enumerate(texts) for h in np.unique(rolling(wh, min_tile)).tolist()]
    hashes = np.array([h for h, _ in seeds], dtype=np.uint64)
    owner = np.array([k for _, k in seeds], dtype=np.int64)
    order = np.argsort(hashes, kind="stable")
    shared = spark.sparkContext.broadcast((texts, hashes[order], owner[order]))

    def find(batches):
        texts, hashes, owner = shared.value
        for pdf in batches:
            out = []
            tokens = [words(t) for t in pdf["text"]]
            sizes = np.array([len(t) for t in tokens], dtype=np.int64)
            flat = word_hashes([w for t in tokens for w in t])
            ends = np.cumsum(sizes)
            starts = ends - sizes
            if len(hashes) and len(flat) >= min_tile:
                r = rolling(flat, min_tile)
                at = np.searchsorted(hashes, r)
                hit = np.flatnonzero((at < len(hashes)) & (hashes[np.minimum(at, len(hashes) - 1)] == r))
                doc = np.searchsorted(ends, hit, "right")
                inside = hit + min_tile <= ends[doc]
                hit, doc = hit[inside], doc[inside]
                for d in np.unique(doc).tolist():
                    h = np.unique(r[hit[doc == d]])
                    a, b = np.searchsorted(hashes, h, "left"), np.searchsorted(hashes, h, "right")
                    own = {int(k) for x, y in zip(a, b) for k in owner[x:y]}
                    for k in sorted(own):
                        row = _row(int(pdf["doc_id"].iloc[d]), texts[k][0], flat[starts[d] : ends[d]], texts[k][1], min_tile)
                        if row:
                            out.append(row)
            yield pd.DataFrame(out, columns=[c.split()[0] for c in SCHEMA.split(", ")])

    return docs.mapInPandas(find, SCHEMA)


def _shuffled(docs: DataFrame, its: DataFrame, min_tile: int) -> DataFrame:
    def seeds(key, text):
        def run(batches):
            for pdf in batches:
                for i, t in zip(pdf[key], pdf[text]):
                    h = np.unique(rolling(word_hashes(words(t)), min_tile)).view(np.int64)
                    if len(h):
                        yield pd.DataFrame({key: i, "seed": h})

        return run

    a = docs.mapInPandas(seeds("doc_id", "text"), "doc_id long, seed long")
    b = its.mapInPandas(seeds("item_id", "item_text"), "item_id long, seed long")
    pairs = a.join(b, "seed").select("doc_id", "item_id").distinct()

    def tile(batches):
        for pdf in batches:
            out = []
            for d, i, t, u in zip(pdf["doc_id"], pdf["item_id"], pdf["text"], pdf["item_text"]):
                row = _row(d, i, word_hashes(words(t)), word_hashes(words(u)), min_tile)
                if row:
                    out.append(row)
            yield pd.DataFrame(out, columns=[c.split()[0] for c in SCHEMA.split(", ")])

    return pairs.join(docs, "doc_id").join(its, "item_id").mapInPandas(tile, SCHEMA)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks(read(spark, d, "documents"), read(spark, d, "eval_items")).select("doc_id", "item_id").distinct()


def p8_items(spark: SparkSession, d: str) -> DataFrame:
    """Per test item: how many documents hold part of it, and the largest coverage."""
    found = leaks(read(spark, d, "documents"), read(spark, d, "eval_items"))
    return found.groupBy("item_id").agg(
        F.countDistinct("doc_id").alias("n_docs"), F.max("longest").alias("longest"), F.max("coverage").alias("coverage")
    )


QUERIES = {"p8_found": p8_found, "p8_items": p8_items}
_GRAMS = r"""
WITH d AS (SELECT DISTINCT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
t AS (SELECT DISTINCT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM eval_items WHERE text IS NOT NULL),
dg AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 12], ' ') AS s FROM d, unnest(range(1, len(w) - 11)) AS u(i)),
tg AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 12], ' ') AS s FROM t, unnest(range(1, len(w) - 11)) AS u(i))
"""
SQL = {"p8_found": f"{_GRAMS} SELECT DISTINCT doc_id, item_id FROM dg JOIN tg USING (s)"}
