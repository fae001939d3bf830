"""Column functions over text: tokens, spans with offsets, snippets, masks, hashes, labels."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Detector patterns whose matches must be the same everywhere.
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
PHONE = r"\b(?:\+?1[-.\s]?)?\(?[0-9]{3}\)?[-.\s]?[0-9]{3}[-.\s]?[0-9]{4}\b"
SSN = r"\b\d{3}-\d{2}-\d{4}\b"
TOKEN = r"[\p{L}\p{N}]+"


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits; none for null."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


_FROM, _TO = "\u0001", "\u0002"  # signs that no text needs; where one stands, it is read as another


def spans(text: Column, pattern: str) -> Column:
    """array<struct<start, end, match>> of all matches, in code points from 0.  The pattern must not match ''.

    One pass of the pattern puts a sign before and behind every match; the offsets add up from the lengths of what
    stands between the signs, so nothing leaves the JVM and the pattern runs once over a text.
    """
    plain = F.translate(text, _FROM + _TO, "\ufffd\ufffd")
    parts = F.split(F.regexp_replace(plain, pattern, f"{_FROM}$0{_TO}"), _FROM, -1)
    start = F.struct(F.lit(-1).alias("at"), F.expr("cast(array() as array<struct<start:int,end:int,match:string>>)").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        n = F.locate(_TO, x) - 1
        found = F.struct(acc["at"].alias("start"), (acc["at"] + n).alias("end"), F.substring(text, acc["at"] + 1, n).alias("match"))
        later = F.struct((acc["at"] + F.length(x) - 1).alias("at"), F.concat(acc["out"], F.array(found)).alias("out"))
        return F.when(acc["at"] < 0, F.struct(F.length(x).alias("at"), acc["out"].alias("out"))).otherwise(later)

    return F.aggregate(parts, start, step, lambda acc: acc["out"])


def mask_emails(text: Column, by: str = "[REDACTED_EMAIL]") -> Column:
    return F.regexp_replace(text, EMAIL, by)


#: A field's name with its colon, or a run without blanks and signs of the query language.
_PIECE = re.compile(r"""\w+:|([^\s"()\[\]{}:*?~^\\|&!+-]+)""")


def query_terms(query: str) -> list[str]:
    """The words of a search query that can stand in a text: no fields, operators or single characters."""
    runs = (m[1] for m in _PIECE.finditer(query) if m[1])
    return [r for r in runs if len(r) > 1 and r.upper() not in ("AND", "OR", "NOT")]


def snippet(text: Column, query: str, most: int = 200, around: int = 80) -> Column:
    """The first hit of any query term with its surroundings; the text's start where there is none; '' for no text."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    n = F.length(flat)
    head = F.when(n <= most, flat).otherwise(F.concat(F.substring(flat, 1, most), F.lit("...")))
    if not query:
        return F.lit("")
    terms = query_terms(query)
    if not terms:
        return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, F.lit("")).otherwise(head)
    low = F.lower(flat)
    hits = [F.struct(F.locate(t.lower(), low).alias("p"), F.lit(i).alias("i"), F.lit(len(t)).alias("l")) for i, t in enumerate(terms)]
    best = F.array_min(F.filter(F.array(*hits), lambda h: h["p"] > 0))
    a = F.greatest(F.lit(0), best["p"] - 1 - around)
    b0 = F.least(n, best["p"] - 1 + best["l"] + around)
    b = F.when(b0 - a > most, a + most).otherwise(b0)
    cut = F.trim(F.concat(F.when(a > 0, "...").otherwise(""), F.substring(flat, a + 1, b - a), F.when(b < n, "...").otherwise("")))
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, F.lit("")).when(best.isNull(), head).otherwise(cut)


def input_hash(items: Column) -> Column:
    """SHA-256 of the sorted items joined by line ends."""
    return F.sha2(F.array_join(F.array_sort(items), "\n"), 256)


def label(prefix: str, number: Column, width: int, sep: str = "") -> Column:
    """``prefix`` and the zero-padded number; a longer number is never cut."""
    digits = number.cast("string")
    return F.concat(F.lit(prefix + sep), F.when(F.length(digits) >= width, digits).otherwise(F.lpad(digits, width, "0")))


def hmac_sha256(key: bytes, message: Column) -> Column:
    """HMAC-SHA256 in hex, composed of two hashes over padded keys."""
    import hashlib

    k = hashlib.sha256(key).digest() if len(key) > 64 else key
    k = k.ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in k), bytes(b ^ 0x5C for b in k)
    first = F.sha2(F.concat(F.lit(inner), F.encode(message, "UTF-8")), 256)
    return F.sha2(F.concat(F.lit(outer), F.unhex(first)), 256)
