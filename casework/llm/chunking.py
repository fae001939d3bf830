"""Splitting oversized items at natural boundaries (problem 4).

Method: agglomerative merging.  A text is cut into atomic segments at its paragraph, line, sentence, clause
and blank boundaries (an atom without any is cut at the limit).  Adjacent pairs wait in a heap by the
strength of the boundary between them; the weakest is merged first, as long as the merged piece with the
overlap taken from the piece before still fits the limit.
"""

from __future__ import annotations

import heapq
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casework.llm.common import read

#: A boundary is the end of a match; the group tells its strength.
_EDGE = re.compile(
    r"(?P<p>[^\S\n]*\n[^\S\n]*\n\s*)|(?P<l>[^\S\n]*\n[^\S\n]*)|(?P<s>[.!?…][\"'”’)]*[^\S\n]+)|(?P<c>[,;:)\]][^\S\n]+)|(?P<b>[^\S\n]+)"
)
STRENGTH = {"p": 5, "l": 4, "s": 3, "c": 2, "b": 1}
SCHEMA = "piece_no int, char_from int, char_to int, overlap int, piece string"


def pieces(text: str, max_chars: int, overlap: int) -> list[tuple[int, int, int]]:
    """(first new character, end, characters repeated from before) of each piece.

    The pieces' new characters partition the text.  Every piece, with its overlap, has at most ``max_chars``
    characters.  Each piece but the first repeats exactly ``overlap`` characters, or all that come before.
    """
    n = len(text)
    if n <= max_chars:
        return [(0, n, 0)]
    overlap = max(0, min(overlap, max_chars - 1))
    room = max_chars - overlap  # new characters in a piece after the first
    # atoms: [start, end) with the strength of the boundary at their end; no atom may exceed ``room``
    starts, strength = [0], []
    for m in _EDGE.finditer(text):
        e = m.end()
        if e >= n:
            break
        _atoms(starts, strength, e, STRENGTH[m.lastgroup], room)
    _atoms(starts, strength, n, 9, room)
    k = len(strength)
    end = starts[1 : k + 1]
    start = starts[:k]
    # linked list of live segments
    nxt = list(range(1, k)) + [-1]
    prv = [-1] + list(range(k - 1))
    alive = [True] * k

    def fits(i: int, j: int) -> bool:
        s = start[i]
        return end[j] - s + (min(overlap, s) if s else 0) <= max_chars

    # equal boundaries: the shorter pair first, so pieces grow evenly; then the earlier
    heap = [(strength[i], end[i + 1] - start[i], i, i + 1, end[i], end[i + 1]) for i in range(k - 1)]
    heapq.heapify(heap)
    while heap:
        _, _, i, j, ei, ej = heapq.heappop(heap)
        if not (alive[i] and alive[j]) or nxt[i] != j or end[i] != ei or end[j] != ej or not fits(i, j):
            continue
        end[i], strength[i] = end[j], strength[j]
        alive[j] = False
        nxt[i] = nxt[j]
        if nxt[j] >= 0:
            prv[nxt[j]] = i
            q = nxt[i]
            heapq.heappush(heap, (strength[i], end[q] - start[i], i, q, end[i], end[q]))
        if prv[i] >= 0:
            p = prv[i]
            heapq.heappush(heap, (strength[p], end[i] - start[p], p, i, end[p], end[i]))
    out, i = [], 0
    while i >= 0:
        out.append((start[i], end[i], min(overlap, start[i])))
        i = nxt[i]
    return out


def _atoms(starts: list[int], strength: list[int], e: int, power: int, room: int) -> None:
    while e - starts[-1] > room:  # no boundary in reach: cut inside
        starts.append(starts[-1] + room)
        strength.append(0)
    starts.append(e)
    strength.append(power)


def chunk(
    docs: DataFrame,
    limits: DataFrame,
    *,
    key: str = "identifier",
    text: str = "text",
    doctype: str = "doctype",
    default: str = "other",
) -> DataFrame:
    """Pieces of every text: ``key``, piece_no (from 0), char_from, char_to, overlap, piece.

    ``piece`` is text[char_from - overlap : char_to].  ``limits`` holds doctype, max_chars, overlap_chars, one
    row per doctype; a null doctype and one that is not listed take the row ``default``.  Repeated rows count
    once; rows with a null text or key give none; an empty text gives one empty piece.  A text that meets no
    limit row stays whole.  Limits with a null max_chars or one below 1 are ignored; of several rows for a
    doctype the smallest max_chars holds.  ``limits`` has a row per doctype, so it is left to the optimizer's
    size check whether it is broadcast.  Other columns, whatever their names, are ignored.
    """
    lim = (
        limits.where("max_chars >= 1")
        .groupBy(F.col("doctype").alias("_t"))
        .agg(F.min(F.struct("max_chars", F.coalesce("overlap_chars", F.lit(0)).alias("overlap_chars"))).alias("_l"))
    )
    d = docs.select(F.col(key).alias(key), F.col(text).alias("_text"), F.col(doctype).alias("_dt")).where(
        F.col(key).isNotNull() & F.col("_text").isNotNull()
    )
    d = d.dropDuplicates([key, "_text", "_dt"])
    own = lim.select(F.col("_t").alias("_dt"), F.col("_l").alias("_own"))
    spare = lim.where(F.col("_t") == default).select("_l.*").first()  # one row
    most, over = (F.lit(x).cast("int") for x in (spare or (None, None)))
    j = d.join(own, "_dt", "left").select(
        F.col(key).cast("string").alias("_key"),
        "_text",
        F.coalesce("_own.max_chars", most).alias("_max"),
        F.when(F.col("_own").isNull(), over).otherwise(F.col("_own.overlap_chars")).alias("_ov"),
    )

    def run(batches):
        for pdf in batches:
            rows = []
            for k, t, m, o in zip(pdf["_key"], pdf["_text"], pdf["_max"], pdf["_ov"]):
                m = len(t) or 1 if pd.isna(m) else int(m)
                for i, (a, b, v) in enumerate(pieces(t, m, 0 if pd.isna(o) else int(o))):
                    rows.append((k, i, a, b, v, t[a - v : b]))
            yield pd.DataFrame(rows, columns=["_key", "piece_no", "char_from", "char_to", "overlap", "piece"])

    return j.mapInPandas(run, f"_key string, {SCHEMA}").withColumnRenamed("_key", key)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """The texts that the operator had to cut."""
    c = chunk(read(spark, d, "dense_docs"), read(spark, d, "chunk_limits"))
    return c.where("piece_no = 1").select("identifier").distinct()


def p4_pieces(spark: SparkSession, d: str) -> DataFrame:
    return chunk(read(spark, d, "dense_docs"), read(spark, d, "chunk_limits"))


QUERIES = {"p4_found": p4_found, "p4_pieces": p4_pieces}
SQL = {
    "p4_found": """
SELECT DISTINCT d.identifier
FROM dense_docs d
LEFT JOIN chunk_limits l ON l.doctype = d.doctype
CROSS JOIN (SELECT max_chars AS other_max FROM chunk_limits WHERE doctype = 'other') o
WHERE length(d.text) > coalesce(l.max_chars, o.other_max)
""",
}
