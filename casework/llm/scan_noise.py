"""Noise in text from scanned pages (problem 3).

Method: skip-gram vectors are learned from the scanned texts.  Words that are rare there are linked to frequent
words with the same glyph key, which takes the usual misreadings for one (0/o, 1/l/i, rn/m, cl/d and so on),
if they never stand in a clean text in the same case, or more seldom, against the linked word, than in scanned
ones; where several fit, the link is weak, or the word has clean places, the vectors of the words around decide.
Then furniture (running headers and footers, stamps, page numbers) is removed, words cut at line ends are
joined, and the lines are set as paragraphs.

The vectors maximise the skip-gram objective with negative sampling over every place of the scanned texts.
The places are counted per pair of words first, so a place costs a count and not a gradient step; then
the two sets of vectors are solved for in turns, each word by Newton steps on its own counts, which every task
can do for its words alone.  Nothing depends on how the rows are dealt to tasks.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casework.llm.common import cut, read, spread

HYPHENS = "-­¬‐‑"
_MIDDLE = ",;:" + HYPHENS
_ADDRESS = re.compile(r"\S+@\S+\.\S+|https?://\S+|www\.\S+")
_TOKEN = re.compile(r"(?:@(?=[^\W_]))?[^\W_]+(?:[@|!$'’](?=[^\W_])[^\W_]+)*[@$]?")
_COMPOUND = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)+")
_CUT = re.compile(rf"([^\W\d_][^\W_@]*|[^\W_@]*[^\W\d_])[{HYPHENS}]\s*$")
_NUMBER = r"(?:[\dOoIlSsBZ]{1,4}|[ivxlcIVXLC]{1,7})"
_PAGE = re.compile(
    rf"^\s*[-–—\[(|]*\s*(?:(?:p[a@][gq][eoc]|p[aá@]g[il1]n[a@]|s[ec]{{1,2}}[il1]t[ec]|p[gq]?\.|s\.|bl[a@]tt|fol[il1]o)\s*)?{_NUMBER}"
    rf"(?:\s*(?:/|of|ot|0f|von|sur|de)\s*{_NUMBER})?\s*[-–—\])|]*\s*$",
    re.I,
)
_HEADING = re.compile(r"^\s*(?:(?:[il1]tem|sect[il1][o0]n|art[il1]c[lI1]e|cl[a@]use|[a-z]*graph|ch[a@]pter|no\.?|§+|annex|anlage|anexo|annexe|exh[il1]b[il1]t)\s*[\dOlIS]+\.?|[\dOlIS]+(?:\.[\dOlIS]+)*\.)\s*$", re.I)
_STAMP = re.compile(r"^\s*[A-Z0-9]{2,6}[- ]?[\dOlISBZ]{5,10}\s*$")
_OPEN = re.compile(r"\b(?:to|of|the|and|on|for|a|an|in|by|with|from|at|or|that|is|was|der|die|das|und|von|zu|für|de|la|le|les|des|du|et|el|los|y|à|au|en|que)$", re.I)
_FOLD = str.maketrans({"0": "o", "1": "l", "i": "l", "|": "l", "!": "l", "5": "s", "$": "s", "@": "a", "8": "b", "6": "b", "h": "b", "9": "g", "q": "g", "c": "e", "f": "t", "v": "y"})
_PAIRS = (("rl", "n"), ("rn", "m"), ("el", "d"), ("yy", "w"), ("ll", "u"), ("lu", "ul"))
_ORDINAL = re.compile(r"\d+(?:st|nd|rd|th|er|e|ème|º|ª|h|k|m|x)|[a-z]\d{6,}|\d+(?![ols])[a-z]?|\d[ols]|(?![ols]\d\d)[a-z]\d{1,3}", re.I)
_DIGITS = re.compile(r"[\dOoIlSsBZ]+$")


@lru_cache(maxsize=200_000)
def glyph_key(word: str) -> str:
    """The same for words that a recogniser may take for one another."""
    w = unicodedata.normalize("NFKC", word).lower().translate(_FOLD)
    for a, b in _PAIRS:
        w = w.replace(a, b)
    return w


def lines_of(text: str) -> list[str]:
    return [x.rstrip("\r") for x in text.split("\n")]


@lru_cache(maxsize=100_000)
def odd(word: str) -> bool:
    """A word with a digit or sign between letters, which no spelling has."""
    if word.isalpha() or _ORDINAL.fullmatch(word) or not re.search(r"[^\W\d_]", word):
        return False
    if re.search(r"[@|!$]", word):
        return True
    letters = sum(c.isalpha() for c in word)
    digits = sum(c.isdigit() for c in word)
    if digits and letters:
        if _DIGITS.match(word) and digits >= letters:
            return True  # letters read in a number
        return letters > digits and not re.search(r"\d{3}", word)
    return False


def _tokens(line: str):
    """(start, token) outside of addresses."""
    if "@" in line or "://" in line or "www." in line:
        line = _ADDRESS.sub(lambda m: " " * len(m.group()), line)
    return [(m.start(), m.group()) for m in _TOKEN.finditer(line)]


class _Lazy(dict):
    """The tokens of the lines that are asked for."""

    def __init__(self, lines: list[str]):
        self.lines = lines

    def __missing__(self, i: int):
        self[i] = out = _tokens(self.lines[i])
        return out


@lru_cache(maxsize=200_000)
def _lowered(chunk: str) -> tuple[str, ...]:
    """The tokens of what stands between two blanks, in lower case."""
    return tuple(w.lower() for w in _TOKEN.findall(chunk))


@lru_cache(maxsize=200_000)
def _odd_inside(chunk: str) -> bool:
    return any(odd(w) for w in _lowered(chunk))


def _ends_cut(line: str) -> bool:
    s = line.rstrip()
    return bool(s) and s[-1] in HYPHENS and bool(_CUT.search(s))


_SPLIT = re.compile(rf"[{HYPHENS}][^\S\n]*\n")
WINDOW = 4
NOISE = 256  # words drawn for the negative side
NEGATIVES = 5


def _without_ends(t: str) -> str:
    """The text without the words that are cut at line ends."""
    parts = _SPLIT.split(t)
    for i, part in enumerate(parts):
        if i and (m := _TOKEN.search(part)):
            part = part[: m.start()] + part[m.end() :]
        if i + 1 < len(parts) and part:
            at = max(part.rfind(" "), part.rfind("\n"), part.rfind("\t")) + 1
            last = None
            for last in _TOKEN.finditer(part, at):
                pass
            part = part[: last.start()] if last else part
        parts[i] = part
    return " ".join(parts)


def _count(batches):
    """word, clean, scanned, lower, clean_lower: places of each word; words cut at a line end are left out."""
    for pdf in batches:
        chunks = (Counter(), Counter())  # between blanks; no token goes beyond one
        for t, scanned in zip(pdf["text"], pdf["scanned"]):
            chunks[scanned].update(_without_ends(t).split())
        seen = (Counter(), Counter())
        for k, counted in enumerate(chunks):
            add = seen[k]
            for x, c in counted.items():
                if "@" in x or "://" in x or "www." in x:
                    x = _ADDRESS.sub(" ", x)
                if x.isalpha():
                    add[x] += c
                    continue
                for w in _TOKEN.findall(x):
                    add[w] += c
                if "-" in x:
                    for w in _COMPOUND.findall(x):
                        add[w] += c
        n: dict[str, list[int]] = {}
        for k, counted in enumerate(seen):
            for w, c in counted.items():
                e = n.setdefault(w.lower(), [0, 0, 0, 0])
                e[k] += c
                if w[0].islower():
                    e[2] += c
                    e[3] += c * (k == 0)
        yield pd.DataFrame([(k, *v) for k, v in n.items()], columns=["word", "clean", "scanned", "lower", "clean_lower"])


BITS = 1 << 20


def _bit(word: str) -> int:
    return xxhash.xxh32_intdigest(word) & (BITS - 1)


def _pairs(index: dict[str, int], wanted: np.ndarray):
    """word, c, n: how often the context word ``c`` stands within ``WINDOW`` places of ``word``, over every place of a batch.

    ``wanted``: bits of the words whose vectors are used; others need no rows (some get them, as bits coincide).
    """
    word = re.compile(r"[^\W\d_]+")
    width = max(1, len(index))
    most = 200_000  # tokens at once

    def coded(at: list[int]):
        """Pairs of words within the window, the lesser first, and their counts."""
        a = np.array(at, np.int64)
        codes = []
        for o in range(1, min(WINDOW + 1, len(a))):
            x, y = a[o:], a[:-o]
            k = (x >= 0) & (y >= 0)
            codes.append((np.minimum(x, y)[k] << 32) + np.maximum(x, y)[k])
        return np.unique(np.concatenate(codes) if codes else np.zeros(0, np.int64), return_counts=True)

    def run(batches):
        for pdf in batches:
            ids: dict[str, int] = {}
            at, parts = [], []
            for t in pdf["text"]:
                w = word.findall(t.lower())
                at += [ids.setdefault(x, len(ids)) for x in w] + [-1] * WINDOW  # no window reaches into the next text
                if len(at) > most:
                    parts.append(coded(at))
                    at = []
            parts.append(coded(at))
            pair, inv = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
            n = np.bincount(inv, weights=np.concatenate([k for _, k in parts]), minlength=len(pair)).astype(np.int64)
            known = np.array([index.get(x, -1) for x in ids], np.int64)
            x, y = pair >> 32, pair & 0xFFFFFFFF
            x, y, n = np.concatenate((x, y)), np.concatenate((y, x)), np.concatenate((n, n))  # each is the other's context
            k = known[y] >= 0 if len(y) else np.zeros(0, bool)
            code, n = x[k] * width + known[y[k]], n[k]
            code, inv = np.unique(code, return_inverse=True)  # a word beside itself comes twice
            n = np.bincount(inv, weights=n, minlength=len(code)).astype(np.int64)
            names = np.array(list(ids), dtype=object)
            use = np.array([wanted[_bit(x)] for x in ids], bool)[code // width] if len(code) else np.zeros(0, bool)
            code, n = code[use], n[use]
            yield pd.DataFrame({"word": names[code // width] if len(code) else [], "c": code % width, "n": n})

    return run


def _solve(cs: list, ns: list, to: np.ndarray, noise: np.ndarray, steps: int = 2) -> np.ndarray:
    """The vectors of words whose contexts are the rows ``cs`` of ``to``, ``ns`` times each: Newton steps on the skip-gram objective."""
    size = to.shape[1]
    out = np.zeros((len(cs), size))
    ends = np.cumsum([len(c) for c in cs])
    first = 0
    while first < len(cs):  # as many words at once as have some 100,000 pairs
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + 100_000)))
        c, n = np.concatenate(cs[first:last]), np.concatenate(ns[first:last]).astype(np.float64)
        lengths = np.array([len(x) for x in cs[first:last]])
        cut_at = np.concatenate(([0], np.cumsum(lengths)))
        total = np.add.reduceat(n, cut_at[:-1])
        scale = np.minimum(1.0, 200 / total)
        owner = np.repeat(np.arange(len(lengths)), lengths)
        x, weight = to[c], n * scale[owner]
        against = (NEGATIVES * total * scale / len(noise))[:, None]
        w = np.zeros((len(lengths), size))
        hess = np.empty((len(lengths), size, size))
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(np.einsum("ed,ed->e", x, w[owner]), -20, 20)))
            q = 1 / (1 + np.exp(-np.clip(w @ noise.T, -20, 20)))
            grad = np.add.reduceat(x * (weight * (1 - p))[:, None], cut_at[:-1]) - (against * q) @ noise - w
            bent = x * (weight * p * (1 - p))[:, None]
            for i, (a, b) in enumerate(zip(cut_at, cut_at[1:])):
                hess[i] = bent[a:b].T @ x[a:b]
            outer = (noise[:, :, None] * noise[:, None, :]).reshape(len(noise), -1)
            hess += ((against * q * (1 - q)) @ outer).reshape(-1, size, size) + np.eye(size)
            w = w + np.linalg.solve(hess, grad[:, :, None])[:, :, 0]
        out[first:last] = w
        first = last
    return out


class Vectors:
    """Skip-gram vectors of words in ``files`` (column text).

    ``index``: the context words and their places; ``self.top``: word -> unit vector of those; ``of``: the vectors of
    the ``others`` (column word).  At the driver are two matrices of one row per context word.
    """

    def __init__(self, files: DataFrame, index: dict[str, int], size: int, others: DataFrame, *, rounds: int = 2, seed: int = 5):
        spark = files.sparkSession
        shared = spark.sparkContext.broadcast(index)
        wanted = np.zeros(BITS, bool)
        wanted[[_bit(w) for w in index]] = True
        wanted[others.select(F.udf(_bit, "int", useArrow=True)("word").alias("b")).distinct().toPandas()["b"].to_numpy(int)] = True
        rows = files.mapInPandas(_pairs(index, wanted), "word string, c int, n long").groupBy("word", "c").agg(F.sum("n").alias("n"))
        rows = rows.groupBy("word").agg(F.array_sort(F.collect_list(F.struct("c", "n"))).alias("p"), F.sum("n").alias("total"))
        place = F.udf(lambda w: shared.value.get(w), "int", useArrow=True)
        self.rows = cut(rows.select(place("word").alias("i"), "word", F.col("p.c").alias("c"), F.col("p.n").alias("n"), "total"))
        mine = self.rows.where("i is not null")
        self.to = np.random.default_rng(seed).normal(0, 0.3, (len(index), size))
        self.top: dict[str, np.ndarray] = {}
        share = np.zeros(len(index))
        for r in mine.select("i", "total").toPandas().itertuples():
            share[r.i] = r.total**0.75
        self.draw = np.random.default_rng(seed).choice(len(index), NOISE, p=share / share.sum()) if share.any() else None
        if self.draw is None:
            return
        for _ in range(rounds):
            into = self._turn(mine, self.to)
            self.to = self._turn(mine, into)
        w = self._turn(mine, self.to)
        w /= np.maximum(np.linalg.norm(w, axis=1, keepdims=True), 1e-9)
        self.top = {x: w[i].astype(np.float32) for x, i in index.items() if share[i]}

    def _turn(self, mine: DataFrame, to: np.ndarray) -> np.ndarray:
        """One set of vectors of the context words, solved against the other."""
        out = np.zeros_like(to)
        for r in self._solved(mine, to, "i", "int").toPandas().itertuples():
            out[r.i] = r.vec
        return out

    def of(self, words: DataFrame) -> DataFrame:
        """word, vec (unit length) of those of the ``others`` that have places in the files."""
        if self.draw is None:
            return words.select("word", F.lit(None).cast("array<float>").alias("vec")).limit(0)
        rows = self.rows.join(words, "word")
        unit = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)) + F.lit(1e-9)
        return self._solved(rows, self.to, "word", "string").withColumn("norm", unit).select("word", F.expr("transform(vec, x -> float(x / norm))").alias("vec"))

    def _solved(self, rows: DataFrame, to: np.ndarray, key: str, kind: str) -> DataFrame:
        shared = rows.sparkSession.sparkContext.broadcast((to, self.draw))

        def run(batches):
            to, draw = shared.value
            for pdf in batches:
                if len(pdf):
                    yield pd.DataFrame({key: pdf[key], "vec": list(_solve(pdf["c"].tolist(), pdf["n"].tolist(), to, to[draw]))})

        return rows.select(key, "c", "n").mapInPandas(run, f"{key} {kind}, vec array<double>")


_PART = re.compile(r"[^\W_]+(?:@[^\W_]+)*|/|,")
_NUMERIC = re.compile(r"(?=\D*\d)[\dOlIS]+$")


class Skeletons:
    """Shapes of furniture lines: frequent words by their glyph key, other words and numbers as a sign."""

    def __init__(self, keys: frozenset[str]):
        self.keys = keys
        self.signs: dict[str, str] = {}  # of the words met so far; emptied when it is full

    def _sign(self, w: str) -> str:
        if w[0] in "0123456789OlIS" and _NUMERIC.match(w):
            s = "#"
        else:
            k = glyph_key(w)
            s = k if k in self.keys or w in "/," else "W"
        if len(self.signs) > 200_000:
            self.signs.clear()
        self.signs[w] = s
        return s

    def of(self, line: str) -> str:
        out: list[str] = []
        get = self.signs.get
        for w in _PART.findall(line):
            s = get(w) or self._sign(w)
            if s != "W" or not out or out[-1] != "W":
                out.append(s)
        return " ".join(out)


_FIRM = re.compile(r"\b(?:S\.?A|Co|Inc|Ltd|Corp|L\.?L\.?P)\.$")


@lru_cache(maxsize=4_096)
def _shape(line: str) -> bool:
    """Could be furniture by its looks: not a sentence nor the middle of one."""
    s = line.strip()
    if not s or len(s) > 90:
        return False
    c = s[0]
    if not (c.isupper() or c.isdigit() or line[:2] == "  " or not c.isalnum()):
        return False
    if s[-1] in _MIDDLE or (s[-1] == "." and not _FIRM.search(s)):
        return False
    return not _HEADING.match(s)


@lru_cache(maxsize=4_096)
def split_number(line: str) -> tuple[str, bool]:
    """The line without a page number that stands apart in it; whether there was one."""
    s = line.strip()
    if "  " not in s and " |" not in s and "\t" not in s and s.isprintable():
        return s, False  # nothing stands apart
    m = re.match(r"^(.*\S)(?:\s{2,}|\s+\|\s+)(\S.*)$", s)
    if m and _PAGE.match(m[2]) and re.search(r"[^\W\d_]{3}", m[1]):
        return m[1], True
    m = re.match(r"^(\S.*?)(?:\s{2,}|\s+\|\s+)(.*\S)$", s)
    if m and _PAGE.match(m[1]) and re.search(r"[^\W\d_]{3}", m[2]):
        return m[2], True
    return s, False


@lru_cache(maxsize=4_096)
def _is_page(line: str) -> bool:
    s = line.strip()
    if len(s) > 20 and len(s.split()) > 8 or not _PAGE.match(s) or _HEADING.match(s):
        return False
    return bool(re.search(r"\d", s)) or bool(re.fullmatch(r"[-–—\[(|\s]*[ivxl]+[-–—\])|\s]*", s)) or bool(re.match(r"\s*[-–\[]\s*[OlISB]\s*[-–\]]|p", s, re.I) and len(s) < 14 and not s.isalpha())


@lru_cache(maxsize=4_096)
def _own_key(s: str) -> str:
    return re.sub(r"[\W\d_]+", " ", glyph_key(s)).strip()


def recurring(lines: list[str]) -> set[int]:
    """Lines that look like furniture and stand more than once in the text, their numbers aside."""
    seen: dict[str, list[int]] = {}
    for i, x in enumerate(lines):
        if _shape(x) and not _is_page(x):
            s, _ = split_number(x)
            k = _own_key(s)
            if len(k) > 4:
                seen.setdefault(k, []).append(i)
    return {i for v in seen.values() if len(v) > 1 for i in v}


def marked(lines: list[str], skeletons: Skeletons) -> tuple[dict[str, list[int]], list[int]]:
    """Shapes of the lines, with whether they recur and cut; and what each line is as far as the text alone tells.

    0: no furniture, 1: a page number, 2: a header, 3 and more: a header if the shape with this place (from 3) is known.
    """
    again = recurring(lines)
    apart = {i for i in again if Repair._apart(lines, i)}
    cutting = {_own_key(split_number(lines[i])[0]) for i in apart}
    shapes: dict[str, list[int]] = {}  # recurs, cuts, place
    codes = [0] * len(lines)
    for i, x in enumerate(lines):
        if not x.strip():
            continue
        if shape := _shape(x):
            s, numbered = split_number(x)
            seen = shapes.setdefault(skeletons.of(s), [0, 0, len(shapes) + 3])
            if i in again:
                seen[0] = 1
                seen[1] |= i in apart
        if _is_page(x):
            codes[i] = 1
        elif _STAMP.match(x):
            codes[i] = 2
        elif shape:
            if numbered or (i in again and _own_key(s) in cutting):
                codes[i] = 2
            elif not _OPEN.search(s[-6:]):  # none of its words is longer than four letters
                codes[i] = seen[2]
    return shapes, codes


class Repair:
    """What the corpus has taught, and the repair of a text by it.  Small enough to be broadcast."""

    def __init__(self, skeletons: Skeletons, known: set[str], vectors: dict[str, np.ndarray], mean: np.ndarray | None = None, floor: float = -0.2):
        """``mean``: what stands around an average place.  ``known``: shapes of furniture, for texts that come without their own."""
        self.skeletons, self.known, self.vectors, self.mean, self.floor = skeletons, known, vectors, mean, floor

    def furniture(self, lines: list[str], known: set[str] | None = None) -> list[str]:
        known = self.known if known is None else known
        shapes, codes = marked(lines, self.skeletons)
        return self.kinds(codes, list(shapes), known)

    @staticmethod
    def kinds(codes, shapes: list[str], known: set[str]) -> list[str]:
        told = ["", "page_no", "header", *["header" if x in known else "" for x in shapes]]
        return [told[c] for c in codes]

    @staticmethod
    def _apart(lines: list[str], i: int) -> bool:
        """Stands in the middle of a sentence that it is no part of: a capital after a line without an end."""
        s = lines[i].strip()
        if not s[0].isupper():
            return False
        j = i - 1
        while j >= 0 and (not lines[j].strip() or _is_page(lines[j]) or _STAMP.match(lines[j])):
            j -= 1
        return j >= 0 and not re.search(r"[.?!:;][\"'”)]*\s*$", lines[j]) and not _HEADING.match(lines[j])

    def accepts(self, word: str, options: list[tuple], around: list[str]) -> str | None:
        """The word meant by a rare one, in its context; an option that isn't sure needs a context nearer to it than the mean.

        An option is (word, places, sure) with, where it is none of the context words, its vector.
        """
        if not options:
            return None
        ctx = [self.vectors[w] for w in around if w in self.vectors]
        best, score = None, -9.0
        for cand, n, sure, *own in options:
            v = own[0] if own and own[0] is not None else self.vectors.get(cand)
            if not sure and not (ctx and v is not None and self.mean is not None and v @ np.mean(ctx, 0) > v @ self.mean):
                continue
            s = 0.12 * np.log(n)
            if ctx and v is not None:
                sim = float(v @ np.mean(ctx, 0))
                if sim < self.floor and len(ctx) >= 4 and len(word) < 5 and word.isalpha():
                    continue
                s += sim
            if s > score:
                best, score = cand, s
        return best

    def read(self, text: str, fixes: dict[str, list[tuple]], compounds: dict[str, bool], known: set[str] | None = None, furniture: list[str] | None = None):
        """lines, kinds per line (a set), replacements per line [(start, end, word)], joins {line: next line}."""
        lines = lines_of(text)
        kinds: list[set[str]] = [set() for _ in lines]
        for i, k in enumerate(self.furniture(lines, known) if furniture is None else furniture):
            if k:
                kinds[i].add(k)
        body = [i for i, x in enumerate(lines) if x.strip() and not kinds[i]]
        toks = _Lazy(lines)
        strange = {x for x in set(text.split()) if (x.lower() in fixes if x.isalpha() else _odd_inside(x) or not fixes.keys().isdisjoint(_lowered(x)))}
        edits: dict[int, list[tuple[int, int, str]]] = {}
        joins: dict[int, int] = {}
        flat: list[tuple[int, int, str, str]] = []  # line, start, as printed, whole word
        skip: set[tuple[int, int]] = set()
        for k, i in enumerate(body):
            s0 = lines[i].rstrip()
            if s0[-1] not in HYPHENS or not toks[i]:
                continue
            if _ends_cut(lines[i]) and k + 1 < len(body) and toks[body[k + 1]]:
                j = body[k + 1]
                (a, w), (b, v) = toks[i][-1], toks[j][0]
                if a + len(w) >= len(s0) - 1 and v[:1].isalpha() and (v[:1].islower() or w.isupper()) and not lines[j][:b].strip():
                    if compounds.get((w + "-" + v).lower(), True):
                        kinds[i].add("hyphen")
                        joins[i] = j
                        whole = (w + v).lower()
                        m = self._meant(whole, w[0].islower(), fixes, toks, body, k)
                        if m:
                            same = next((x for x, (c, e) in enumerate(zip(whole, m)) if c != e), len(whole))
                            kinds[i if same < len(w) else j].add("misread")
                            edits.setdefault(i, []).append((a, a + len(w), m))
                            edits.setdefault(j, []).append((b, b + len(v), ""))
                        skip |= {(i, a), (j, b)}
        for k, i in enumerate(body):
            if strange.isdisjoint(lines[i].split()):
                continue
            for a, w in toks[i]:
                if (w.isalpha() and w.lower() not in fixes) or (i, a) in skip:
                    continue
                m = self._meant(w.lower(), w[0].islower(), fixes, toks, body, k)
                if m is not None:
                    kinds[i].add("misread")
                    edits.setdefault(i, []).append((a, a + len(w), _like(w, m)))
        return lines, kinds, edits, joins

    def _meant(self, w, lower, fixes, toks, body, k) -> str | None:
        opts = fixes.get(w)
        if opts is None:
            if not odd(w):
                return None
            return _digits(w) if _DIGITS.match(w) and sum(c.isdigit() for c in w) * 2 >= len(w) else w
        opts = [(m, n, sure, *own) for m, n, lo, up, *own in opts if (sure := lo if lower else up) is not None]
        if odd(w) and not opts:
            return w
        around = [x.lower() for i in body[max(0, k - 1) : k + 2] for _, x in toks[i] if x.lower() != w]
        m = self.accepts(w, opts, around)
        return m if m is not None else (w if odd(w) else None)


def _digits(w: str) -> str:
    return w.upper().translate(str.maketrans("OISBZL", "015821"))


def _like(w: str, m: str) -> str:
    if w.isupper() and len(w) > 1:
        return m.upper()
    return m[:1].upper() + m[1:] if w[:1].isupper() else m


def paragraphs(lines, kinds, edits, joins) -> str:
    """The repaired text: one line per paragraph, blank lines between."""
    out: list[str] = []
    cur = ""
    gap = False
    glue = False
    for i, x in enumerate(lines):
        if kinds[i] & {"header", "page_no"}:
            continue
        if not x.strip():
            gap = True
            continue
        s = x
        for a, b, w in sorted(edits.get(i, []), reverse=True):
            s = s[:a] + w + s[b:]
        s = s.strip()
        if i in joins:
            s = s.rstrip().rstrip(HYPHENS)
        begins = not cur or _HEADING.match(x) or (gap and not glue and re.search(r"[.!?:]['\"”)]*$", cur) is not None) or _HEADING.match(cur)
        if begins and cur:
            out.append(cur)
            cur = s
        else:
            cur = cur + ("" if glue or not cur or cur[-1:] == "-" else " ") + s
        glue = i in joins
        gap = False
    if cur:
        out.append(cur)
    return "\n\n".join(out)


def _told(lines) -> tuple[dict, dict, set]:
    """Links by word (the most frequent first), compounds, and shapes of furniture from the lines that a file is told."""
    fixes: dict[str, list[tuple]] = {}
    comp: dict[str, bool] = {}
    shapes: set[str] = set()
    flag = {"1": True, "0": False, "": None}
    for e in lines if lines is not None else ():
        kind, word, *rest = e.split("\t")
        if kind == "L":
            meant, n, lo, up, vec = rest
            fixes.setdefault(word, []).append((meant, int(n), flag[lo], flag[up], np.array(vec.split(","), np.float32) if vec else None))
        elif kind == "C":
            comp[word] = bool(flag[rest[0]])
        else:
            shapes.add(word)
    for opts in fixes.values():
        opts.sort(key=lambda o: (o[1], o[0]), reverse=True)
    return fixes, comp, shapes


class Scans:
    """The scanned files of ``payloads`` (those with a page in ``pages`` that needs_ocr), with what is learned.

    Rows with a null path or text take no part; repeated rows count once; a path with two texts has the lines
    of both; other columns are ignored whatever their names; empty tables give no rows.  The word counts, the
    vectors, the candidate links and the shapes of furniture cover all texts; words and shapes reach the
    files by joins.  Only the ``frequent`` most frequent words serve as contexts (vectors of ``size`` numbers) and
    in shapes, and are broadcast.
    """

    def __init__(self, payloads: DataFrame, pages: DataFrame, *, frequent: int = 30_000, size: int = 32, ratio: int = 8):
        spark = payloads.sparkSession
        need = pages.where("needs_ocr and path is not null").select("path").distinct().withColumn("s", F.lit(1))
        # once by path: repeated rows meet there, and so do a file and its pages
        p = payloads.where("path is not null and length(text) > 0").select("path", "text").repartition("path").dropDuplicates(["path", "text"])
        t = spread(cut(p.join(need, "path", "left").select("path", "text", F.coalesce("s", F.lit(0)).alias("scanned"))))
        self.files = t.where("scanned = 1").select("path", "text")
        words = cut(
            t.mapInPandas(_count, "word string, clean long, scanned long, lower long, clean_lower long")
            .groupBy("word")
            .agg(F.sum("clean").alias("clean"), F.sum("scanned").alias("scanned"), F.sum("lower").alias("lower"), F.sum("clean_lower").alias("clean_lower"))
        )
        top = words.where("lower > 4 and not contains(word, '-')").orderBy(F.desc("lower"), "word").limit(frequent).select("word", "scanned").toPandas()
        usual = dict(zip(top["word"], top["scanned"]))
        keys = Skeletons(frozenset(glyph_key(w) for w in usual if w.isalpha()))
        # rare words of scanned texts, and the frequent ones with the same key
        key, strange = F.udf(glyph_key, "string", useArrow=True), F.udf(odd, "boolean", useArrow=True)
        alpha = words.where("not contains(word, '-')").withColumn("n", F.col("clean") + F.col("scanned"))
        by_case = [F.col("clean_lower").alias("cl"), (F.col("lower") - F.col("clean_lower")).alias("sl"), (F.col("clean") - F.col("clean_lower")).alias("cu"), (F.col("scanned") - F.col("lower") + F.col("clean_lower")).alias("su")]
        rare = alpha.where("scanned > 0 and length(word) > 1").select("word", "clean", F.col("scanned").alias("m"), *by_case, key("word").alias("k"))
        often = alpha.where(F.col("n").between(4, 1 << 60) & F.col("word").rlike(r"^[\p{L}'’]+$")).where(~strange("word")).select(
            F.col("word").alias("meant"), "n", *[c.alias(f"of_{x}") for c, x in zip(by_case, ("cl", "sl", "cu", "su"))], key("word").alias("k")
        )
        link = rare.join(often, "k").where((F.col("word") != F.col("meant")) & (F.col("n") >= ratio * F.col("m")))
        # true: the word has no clean place in this case; false: fewer than the linked word's rate lets expect; null: no candidate
        for x, kind in (("l", "lo"), ("u", "up")):
            link = link.withColumn(kind, F.expr(f"case when clean = 0 then true when s{x} = 0 or of_c{x} + of_s{x} < {ratio} * s{x} then null when c{x} = 0 then true when c{x} * of_s{x} < s{x} * of_c{x} then false end"))
        link = link.where("lo is not null or up is not null").select("word", "meant", "n", "lo", "up")
        link = cut(link)
        index = {w: i for i, w in enumerate(x for x in usual if x.isalpha())}
        contexts = spark.sparkContext.broadcast(frozenset(index))
        other = F.udf(lambda w: w not in contexts.value, "boolean", useArrow=True)
        meant = cut(link.select(F.col("meant").alias("word")).distinct().where(other("word")))  # the others' vectors are at hand everywhere
        vectors = Vectors(self.files, index, size, meant)
        link = cut(link.join(vectors.of(meant).withColumnRenamed("word", "meant"), "meant", "left"))
        linked = link.select("word").distinct()
        sure = words.where("lower > 4 and clean > 0 and not contains(word, '-')").join(linked, "word", "left_anti").orderBy(F.desc("lower"), "word").limit(frequent).select("word").toPandas()["word"]
        safe = spark.sparkContext.broadcast(frozenset(sure))  # words that need no lookup; all others are looked up
        # compounds written with a hyphen, against the same letters written without
        whole = words.where("contains(word, '-')").select(F.col("word").alias("c"), (F.col("clean") + F.col("scanned")).alias("with"), F.regexp_replace("word", "-", "").alias("j"))
        comp = whole.join(alpha.select(F.col("word").alias("j"), F.col("n").alias("without")), "j", "left").select(
            F.col("c").alias("word"), (F.coalesce("without", F.lit(0)) > F.col("with")).alias("plain")
        )
        shared_keys = spark.sparkContext.broadcast(keys)

        def used(batches):
            """Per file: its words with the compounds its line ends could be, and the shapes of its lines, whether they recur and cut."""
            for pdf in batches:
                rows = []
                for path, text in zip(pdf["path"], pdf["text"]):
                    lines = lines_of(text)
                    found = set()
                    for x in set(text.split()):
                        if x.isalpha():
                            found.add(x.lower())
                        else:
                            found.update(_lowered(x))
                    found -= safe.value
                    shapes, codes = marked(lines, shared_keys.value)
                    for i, x in enumerate(lines):
                        if not x.strip():
                            continue
                        tok = _tokens(x) if x.rstrip()[-1] in HYPHENS else ()
                        if tok and _ends_cut(x):
                            for y in lines[i + 1 :]:  # furniture may stand between
                                nxt = _tokens(y)
                                if nxt:
                                    found.add((tok[-1][1] + nxt[0][1]).lower())
                                    found.add((tok[-1][1] + "-" + nxt[0][1]).lower())
                                if y.strip() and not (_shape(y) or _is_page(y) or _STAMP.match(y)):
                                    break
                    rows.append((path, text, list(found), list(shapes), [x for x, *_ in shapes.values()], [x for _, x, _ in shapes.values()], np.array(codes, "<i4").tobytes()))
                yield pd.DataFrame(rows, columns=["path", "text", "words", "shapes", "again", "cuts", "codes"])

        schema = "path string, text string, words array<string>, shapes array<string>, again array<int>, cuts array<int>, codes binary"
        asked = cut(self.files.mapInPandas(used, schema))
        shapes = asked.select("path", F.explode(F.arrays_zip("shapes", "again", "cuts")).alias("s"))
        shapes = shapes.select("path", F.col("s.shapes").alias("word"), F.col("s.again").alias("again"), F.col("s.cuts").alias("cuts")).where("word not in ('W', 'W #')")
        usual_shapes = (
            shapes.where("again = 1").groupBy(F.col("word").alias("shape")).agg(F.countDistinct("path").alias("n"), F.avg("cuts").alias("cuts")).where("n >= 3 and cuts >= 0.2").select("shape")
        )
        # what a file is told, a line each: kind, word, and of links the word meant, its places, sure in lower case and else, vector
        flag = lambda c: F.when(F.col(c), "1").when(~F.col(c), "0").otherwise("")
        vec = F.coalesce(F.array_join(F.transform("vec", lambda x: x.cast("string")), ","), F.lit(""))
        told = link.select("word", F.concat_ws("\t", F.lit("L"), "word", "meant", F.col("n").cast("string"), flag("lo"), flag("up"), vec).alias("e"))
        told = told.unionByName(comp.select("word", F.concat_ws("\t", F.lit("C"), "word", flag("plain")).alias("e")))
        mine = asked.select("path", F.explode("words").alias("word")).join(told, "word").select("path", "e")
        mine = mine.unionByName(shapes.join(usual_shapes, F.col("word") == F.col("shape")).select("path", F.concat_ws("\t", F.lit("S"), "word").alias("e")))
        mine = mine.distinct().groupBy("path").agg(F.array_sort(F.collect_list("e")).alias("known"))
        self.work = spread(cut(asked.select("path", "text", F.col("shapes").alias("own"), "codes").join(mine, "path", "left")))
        v = vectors.top
        mean = np.sum([usual[w] * x for w, x in v.items()], 0) / max(1, sum(usual[w] for w in v)) if v else None
        self.vectors = vectors
        self.repair = spark.sparkContext.broadcast(Repair(keys, set(), v, mean))

    def _apply(self, row, schema: str) -> DataFrame:
        names = [c.split()[0] for c in schema.split(", ")]
        shared = self.repair

        def run(batches):
            rep = shared.value
            for pdf in batches:
                rows = []
                for path, text, own, codes, mine in zip(pdf["path"], pdf["text"], pdf["own"], pdf["codes"], pdf["known"]):
                    fixes, comp, shapes = _told(mine)
                    rows += row(path, *rep.read(text, fixes, comp, shapes, rep.kinds(np.frombuffer(codes, "<i4").tolist(), own, shapes)))
                yield pd.DataFrame(rows, columns=names)

        return self.work.mapInPandas(run, schema)

    def marks(self) -> DataFrame:
        """path, line_no (from 1), kind."""
        return self._apply(lambda p, lines, kinds, *_: [(p, i + 1, k) for i, ks in enumerate(kinds) for k in sorted(ks)], "path string, line_no int, kind string")

    def text(self) -> DataFrame:
        """path, text: the repaired texts."""
        return self._apply(lambda p, *a: [(p, paragraphs(*a))], "path string, text string")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return Scans(read(spark, d, "payloads"), read(spark, d, "page_analysis")).marks().distinct()


def p3_text(spark: SparkSession, d: str) -> DataFrame:
    return Scans(read(spark, d, "payloads"), read(spark, d, "page_analysis")).text()


QUERIES = {"p3_found": p3_found, "p3_text": p3_text}
SQL: dict[str, str] = {}
