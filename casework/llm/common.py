"""Helpers shared by the training-data operators.

A *word* is a longest run of letters or digits, lower-cased.  Hashes are 64-bit xxHash values kept as
numpy ``uint64``; n-gram hashes are Karp-Rabin polynomials over them (mod 2**64).
"""

from __future__ import annotations

import re

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from casework.shared import cut, spread

WORD = re.compile(r"[^\W_]+")
BASE = np.uint64(0x9E3779B97F4A7C15)
_CACHE: dict[str, int] = {}
_CACHE_MAX = 500_000

def words(text: str | None) -> list[str]:
    """The words of a text; none for null."""
    return WORD.findall(text.lower()) if text else []

def word_hashes(tokens: list[str]) -> np.ndarray:
    """64-bit hashes of words.  The per-process cache is emptied when it is full, so memory stays bounded."""
    get = _CACHE.get
    out = [get(w) for w in tokens]
    if None in out:
        if len(_CACHE) > _CACHE_MAX:
            _CACHE.clear()
        for i, h in enumerate(out):
            if h is None:
                w = tokens[i]
                h = _CACHE.get(w)
                if h is None:
                    h = _CACHE[w] = xxhash.xxh64_intdigest(w)
                out[i] = h
    return np.array(out, dtype=np.uint64)

def rolling(h: np.ndarray, n: int) -> np.ndarray:
    """Karp-Rabin hashes of every run of ``n`` consecutive hashes; empty when there are fewer."""
    m = len(h) - n + 1
    if m <= 0:
        return np.empty(0, dtype=np.uint64)
    out = h[:m].copy()
    for j in range(1, n):
        out *= BASE
        out += h[j : j + m]
    return out

def shingles(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``n`` consecutive words, as ``int64``."""
    return np.unique(rolling(word_hashes(words(text)), n)).view(np.int64)

def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table; texts are spread over all cores where their files give fewer parts than there are cores."""
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return spread(df) if table in ("documents", "payloads", "dense_docs") else df

def connected(pairs: DataFrame, a: str, b: str, rounds: int = 40) -> DataFrame:
    """Connected components of the undirected edges (``a``, ``b``): columns ``node``, ``component``.

    Alternates large-star and small-star passes, whose edge lists shrink to stars in a logarithmic number
    of passes; every pass is a group-by on a node, and the edges are written to the shared folder between
    passes.  Nothing is collected but the count of changed edges.  A component is named by its least node.
    Empty edges give no rows.
    """
    spark = pairs.sparkSession
    e = pairs.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).where("u <> v").distinct()
    e = cut(e)
    last = None
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("m").alias("u"), "v").where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("k"), F.least("u", "v").alias("v"))
        least = down.groupBy("k").agg(F.min("v").alias("m"))
        small = (
            down.join(least, "k")
            .select(F.col("m").alias("u"), F.explode(F.array("v", "k")).alias("v"))
            .where("u <> v")
            .distinct()
        )
        e = cut(small)
        sign = e.select(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if sign == last:
            break
        last = sign
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return e.select(F.col("v").alias("node"), F.col("u").alias("component")).unionByName(
        e.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct()
    )

def attach(df: DataFrame, table: DataFrame, asked, keys: list[str], text: str, *, most: int):
    """``df`` with what ``table`` (k long, v double) holds of the keys that each row asks for, and a broadcast of the table or None.

    ``asked``: function of a text to its int64 keys.  Up to ``most`` rows the table is broadcast, as sorted arrays of 16 bytes a row,
    and the columns ``known_k`` and ``known_v`` are null; beyond that it is joined, and they hold the row's share of it, sorted by key.
    ``keys``: columns that tell rows apart.
    """
    table = cut(table)
    if table.count() <= most:
        got = table.toPandas().sort_values("k")
        shared = df.sparkSession.sparkContext.broadcast((got["k"].to_numpy(np.int64), got["v"].to_numpy(float)))
        return df.withColumns({"known_k": F.lit(None).cast("array<long>"), "known_v": F.lit(None).cast("array<double>")}), shared
    schema = df.select(*keys).schema.add("k", ArrayType(LongType()))

    def run(batches):
        for pdf in batches:
            out = pdf[keys].copy()
            out["k"] = [np.unique(asked(t)) for t in pdf[text]]
            yield out

    each = df.mapInPandas(run, schema).select(*keys, F.explode("k").alias("k")).join(table, "k")
    mine = each.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("k", "v"))).alias("m"))
    mine = mine.select(*keys, F.col("m.k").alias("known_k"), F.col("m.v").alias("known_v"))
    return df.join(mine, keys, "left"), None


def values_of(keys: np.ndarray, known: tuple[np.ndarray, np.ndarray], default: float = 0.0) -> np.ndarray:
    """The values of int64 keys in sorted arrays of keys and values."""
    k, v = known
    if not len(k) or not len(keys):
        return np.full(len(keys), default)
    at = np.minimum(np.searchsorted(k, keys), len(k) - 1)
    return np.where(k[at] == keys, v[at], default)
