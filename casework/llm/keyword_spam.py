"""Keyword-stuffed and link-list pages (problem 10).

Method: each text is cut into units (lines, sentences, blocks of one-word lines).  For every word the gap to its nearest recurrence is
taken, and for lag windows of 1 to ``LAGS`` words the positional autocorrelation.  A unit whose words nearly
all recur at short, regular gaps, or that is hardly more than links or tags, is unnatural.  From those units
and from all others the corpus's own word odds are learned, so that lists of distinct promotional nouns are
found too, where nothing recurs.  A document is flagged when more than half of its words are in such units.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casework.llm.common import BASE, WORD, attach, cut, read, values_of

LAGS = 32
NEAR = 24
BLOCK = 6  # one-word lines in a row that are read as one unit

# Frequent function words of English, French, German and Spanish.
FUNCTION_WORDS = (
    "the of and to in a is that it for was on with as are be this by at from or an not have has had which but "
    "were could would will before after who its their since only because each both when "
    "le la les l de des du et en un une est pour que qui dans sur au aux pas a été ont se d n par sans "
    "der die das und von zu mit den des ist wurde nicht für auf am dem im wegen nach hat ein eine "
    "el los las del que por con una para y su sobre según se no nunca"
).split()

_UNIT = re.compile(r"[\n.!?](?:(?<=\n)\n*|\s+(?=[\"“(¿¡]?[A-ZÀ-Þ]))")
_LINK = re.compile(r"(?:https?://|www\.)[^\s\"'<>]+|#\w+|</?[aA]\b[^>]*>")
_TOKEN = re.compile(r"[^\W_]+|\0")
_IDS: dict[str, int] = {"\0": 0}


def _id(w: str) -> int:
    """Hash of a word; its lowest bit tells whether the word holds a digit."""
    if len(_IDS) > 500_000:
        _IDS.clear()
        _IDS["\0"] = 0
    if w == "\0":
        return 0
    h = _IDS[w] = (xxhash.xxh64_intdigest(w) & ~1) | (not w.isalpha() and any(c.isdigit() for c in w))
    return h


_FUNCTION = np.array(sorted(_id(w) for w in FUNCTION_WORDS), dtype=np.uint64)


class Units:
    """Words and features of all units of a batch of texts."""

    def __init__(self, texts: list[str | None]):
        # one flat list of word ids, with a 0 after each unit
        flat: list[int] = []
        doc_len, spans, links = [], [], []
        get = _IDS.get
        for t in texts:
            began = len(flat)
            if t:
                marked = _UNIT.sub("\0", t)
                if "://" not in t and "#" not in t and "www." not in t and "<" not in t:
                    flat.extend([get(w) or _id(w) for w in _TOKEN.findall(marked.lower())])
                    flat.append(0)
                else:
                    for s in marked.split("\0"):
                        at, n, first = 0, 0, len(flat)
                        for m in _LINK.finditer(s):
                            flat.extend([get(w) or _id(w) for w in WORD.findall(s[at : m.start()].lower())])
                            a = len(flat)
                            flat.extend([get(w) or _id(w) for w in WORD.findall(m.group().lower())])
                            spans.append((a, len(flat)))
                            at = m.end()
                            n += m.group()[:2] != "</"
                        flat.extend([get(w) or _id(w) for w in WORD.findall(s[at:].lower())])
                        if n and len(flat) > first:
                            links.append((first, n))
                        flat.append(0)
            doc_len.append(len(flat) - began)
        ids = np.array(flat, dtype=np.uint64)
        keep = ids != 0
        linked = np.zeros(len(ids) + 1, np.int32)
        for a, b in spans:
            linked[a] += 1
            linked[b] -= 1
        raw = np.cumsum(~keep)[keep]
        doc = np.repeat(np.arange(len(texts)), doc_len)[keep]
        found, self.unit_of = np.unique(self._blocks(raw, doc), return_inverse=True)
        self.ids = ids[keep]
        self.size = np.bincount(self.unit_of, minlength=len(found))
        self.doc_of = np.zeros(len(found), np.int64)
        self.doc_of[self.unit_of] = doc
        self.in_link = np.cumsum(linked)[:-1][keep] > 0
        self.n_links = np.zeros(len(found), np.int64)
        where = np.cumsum(keep) - 1  # place among the kept
        for first, n in links:
            self.n_links[self.unit_of[where[first]]] = n

    @staticmethod
    def _blocks(raw: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Unit numbers in which ``BLOCK`` or more one-word units in a row (keywords set one to a line) are one unit."""
        if not len(raw):
            return raw
        found, first, size = np.unique(raw, return_index=True, return_counts=True)
        lone = size == 1
        # a run goes on while units have one word and lie in one document; blank lines do not end it
        start = ~lone | np.concatenate(([True], ~lone[:-1] | (doc[first][1:] != doc[first][:-1])))
        run = np.cumsum(start)
        long = lone & (np.bincount(run, minlength=run[-1] + 1)[run] >= BLOCK)
        head = found[np.flatnonzero(start)][run - 1]
        return np.repeat(np.where(long, head, found), size)

    def per_unit(self, x: np.ndarray) -> np.ndarray:
        return np.bincount(self.unit_of, weights=x, minlength=len(self.size))

    def unnatural(self) -> np.ndarray:
        """Per unit: its words recur at short regular gaps, or it is hardly more than links."""
        n = len(self.ids)
        if not n:
            return np.zeros(0, bool)
        # gaps to the nearest recurrence in the same unit: form sentences repeat from unit to unit
        order = np.argsort(self.ids + self.unit_of.astype(np.uint64) * BASE, kind="stable")
        ids, unit = self.ids[order], self.unit_of[order]
        same = (ids[1:] == ids[:-1]) & (unit[1:] == unit[:-1])
        step = np.where(same, np.diff(order), n + NEAR)
        gap = np.full(n, n + NEAR)
        gap[order[1:]] = step
        gap[order[:-1]] = np.minimum(gap[order[:-1]], step)
        numeric = (self.ids & np.uint64(1)).astype(bool)
        recurs = gap <= NEAR
        lone = numeric & (gap > n) & ~self.in_link
        rec = self.per_unit(recurs) / self.size
        # autocorrelation by lag, where enough words recur at all
        at = np.flatnonzero((rec >= 0.5)[self.unit_of])
        ids, unit = self.ids[at], self.unit_of[at]
        best = np.zeros(len(self.size))
        for lag in range(1, min(LAGS, len(at) - 1) + 1):
            m = (ids[:-lag] == ids[lag:]) & (unit[:-lag] == unit[lag:])
            if m.any():
                best = np.maximum(best, np.bincount(unit[:-lag][m], minlength=len(self.size)))
        own = self.size - self.per_unit(self.in_link)
        fw = self.per_unit(np.isin(self.ids, _FUNCTION) & ~self.in_link)
        links = (self.n_links > 0) & (own <= 6 * self.n_links) & (fw <= 2 * self.n_links)
        stuffed = (rec >= 0.5) & (best / self.size >= 0.12) & (self.per_unit(lone) <= 0.05 * self.size) & (own >= 6)
        return links & (self.size >= 2) | stuffed


def _count(batches):
    """Words of unnatural and of other units, counted per batch."""
    for pdf in batches:
        u = Units(pdf["text"].tolist())
        bad = u.unnatural()
        if not len(u.ids):
            continue
        keep = ~u.in_link
        ids, n = u.ids[keep].view(np.int64), bad[u.unit_of[keep]]
        words, inv = np.unique(ids, return_inverse=True)
        yield pd.DataFrame({"word": words, "bad": np.bincount(inv, weights=n).astype(np.int64), "n": np.bincount(inv)})


def word_odds(docs: DataFrame, *, min_count: int) -> DataFrame:
    """k (hash), v (log odds, unnatural against other units) of the words with at least ``min_count`` places in all documents."""
    counts = docs.mapInPandas(_count, "word long, bad long, n long").groupBy("word").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n"))
    counts = cut(counts.where(F.col("n") >= min_count))
    total = F.broadcast(counts.agg(F.coalesce(F.sum("bad"), F.lit(0)).alias("tb"), F.coalesce(F.sum(F.col("n") - F.col("bad")), F.lit(0)).alias("to")))  # one row
    odds = F.log((F.col("bad") + 0.5) / (F.col("tb") + 1)) - F.log((F.col("n") - F.col("bad") + 0.5) / (F.col("to") + 1))
    return counts.crossJoin(total).select(F.col("word").alias("k"), F.greatest(F.lit(-4.0), F.least(F.lit(4.0), odds)).alias("v"))


def _asked(text: str | None) -> np.ndarray:
    u = Units([text])
    return u.ids[~u.in_link].view(np.int64)


def spam_share(
    documents: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    min_count: int = 5,
    broadcast_words: int = 1_000_000,
) -> DataFrame:
    """Per document: doc_id, n_words, spam_words, share.

    Null, empty and wordless texts have no words and share 0; repeated rows count once; rows with a null id are
    left out; other columns are ignored whatever their names; an empty table gives no rows.  The words' odds are
    broadcast (16 bytes each) up to ``broadcast_words`` of them, and joined to the documents beyond that; the
    result is the same.
    """
    docs = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null")
    keyed, shared = attach(docs.withColumn("h", F.xxhash64("text")), word_odds(docs, min_count=min_count), _asked, ["doc_id", "h"], "text", most=broadcast_words)

    def score(batches):
        for pdf in batches:
            u = Units(pdf["text"].tolist())
            bad = u.unnatural()
            if len(u.ids):
                ids = u.ids.view(np.int64)
                if shared is not None:
                    o = values_of(ids, shared.value)
                else:
                    ends = np.cumsum(np.bincount(u.doc_of[u.unit_of], minlength=len(pdf)))
                    parts = [(ids[a:b], (np.asarray(k, np.int64), np.asarray(v, float)) if k is not None else (ids[:0], ids[:0])) for a, b, k, v in zip(np.concatenate(([0], ends)), ends, pdf["known_k"], pdf["known_v"])]
                    o = np.concatenate([values_of(x, known) for x, known in parts])
                own = ~u.in_link & (u.ids & np.uint64(1) == 0)
                n = np.maximum(u.per_unit(own), 1)
                bad = bad | (u.per_unit(o * own) / n > 0.5) & (u.per_unit(own) >= 2)
            total = np.bincount(u.doc_of, weights=u.size, minlength=len(pdf)).astype(np.int64)
            spam = np.bincount(u.doc_of, weights=u.size * bad, minlength=len(pdf)).astype(np.int64)
            yield pd.DataFrame(
                {"doc_id": pdf["doc_id"], "n_words": total, "spam_words": spam, "share": spam / np.maximum(total, 1)}
            )

    scored = keyed.mapInPandas(score, "doc_id long, n_words long, spam_words long, share double")
    return scored.groupBy("doc_id").agg(F.max(F.struct("share", "n_words", "spam_words")).alias("s")).select(
        "doc_id", "s.n_words", "s.spam_words", "s.share"
    )


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return spam_share(read(spark, d, "documents")).where("share > 0.5").select("doc_id")


def p10_share(spark: SparkSession, d: str) -> DataFrame:
    return spam_share(read(spark, d, "documents"))


QUERIES = {"p10_found": p10_found, "p10_share": p10_share}
SQL: dict[str, str] = {}
