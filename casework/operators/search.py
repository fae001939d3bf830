"""Search: query language, BM25, phrases, dense neighbours, fusion, snippets, facets."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casework.functions.text import tokens

K1, B = 1.2, 0.75


def words_of(s: str) -> list[str]:
    return re.findall(r"[^\W_]+", s.lower())


@dataclass(frozen=True)
class Leaf:
    """A term or phrase (``plain``), with the beginning of a word in ``prefix``, in a field."""

    field: str
    plain: tuple[str, ...]
    prefix: str = ""

    def words(self) -> list[tuple[str, str]]:
        return [(self.field, w) for w in self.plain]


_LEX = re.compile(r'\(|\)|(?:\w+:)?"[^"]*"|[^\s()"]+')


def parse(query: str, fields: list[str]):
    """The tree of a query: terms, "phrases", prefix*, field:value, AND, OR, NOT, brackets; OR where nothing stands.

    A tree is a ``Leaf``, None (a word of signs alone, which nothing holds), or ("and" | "or" | "not", trees).  The
    first of ``fields`` is the default; an unknown field is part of the text.
    """
    toks = _LEX.findall(query)[::-1]

    def peek() -> str:
        return toks[-1] if toks else ""

    def either():
        out = [both()]
        while peek() and peek() != ")":
            if peek().upper() == "OR":
                toks.pop()
            out.append(both())
        return ("or", out) if len(out) > 1 else out[0]

    def both():
        out = [one()]
        while peek().upper() == "AND":
            toks.pop()
            out.append(one())
        return ("and", out) if len(out) > 1 else out[0]

    def one():
        if not peek() or peek() == ")":
            raise ValueError("a term is missing")
        t = toks.pop()
        if t.upper() == "NOT":
            return ("not", [one()])
        if t == "(":
            out = either()
            if peek() != ")":
                raise ValueError("a bracket is not closed")
            toks.pop()
            return out
        name, colon, value = t.partition(":")
        field, t = (name, value) if colon and name in fields else (fields[0], t)
        ws = words_of(t)
        if not ws:
            return None
        if t.endswith("*") and not t.startswith('"'):
            return Leaf(field, tuple(ws[:-1]), ws[-1])
        return Leaf(field, tuple(ws))

    if not toks:
        return None
    tree = either()
    if toks:
        raise ValueError(f"unbalanced query at {peek()!r}")
    return tree


def leaves(tree) -> list[Leaf]:
    """The leaves from left to right."""
    if tree is None or isinstance(tree, Leaf):
        return [tree] if tree else []
    return [x for t in tree[1] for x in leaves(t)]


def prefixes(tree) -> set[tuple[str, str]]:
    return {(x.field, x.prefix) for x in leaves(tree) if x.prefix}


def holds(tree, leaf) -> bool:
    """Whether the tree is true where ``leaf`` says which leaves are."""
    if tree is None or isinstance(tree, Leaf):
        return tree is not None and leaf(tree)
    each = [holds(t, leaf) for t in tree[1]]
    return not each[0] if tree[0] == "not" else all(each) if tree[0] == "and" else any(each)


def condition(tree, cols: dict[int, Column]) -> Column:
    """The tree over a boolean column for each leaf, by its number from the left; null counts as false."""
    number = iter(range(len(cols)))

    def go(t) -> Column:
        if t is None:
            return F.lit(False)
        if isinstance(t, Leaf):
            return F.coalesce(cols[next(number)], F.lit(False))
        each = [go(x) for x in t[1]]
        out = each[0]
        for x in each[1:]:
            out = out & x if t[0] == "and" else out | x
        return ~out if t[0] == "not" else out

    return go(tree)


def matching(query: str, fields: dict[str, Column]) -> Column:
    """A query as a condition over token arrays, for texts that have no index."""

    def test(x: Leaf) -> Column:
        toks = fields[x.field]
        hit = F.exists(toks, lambda w: w.startswith(x.prefix)) if x.prefix else F.lit(True)
        if len(x.plain) == 1:
            return hit & F.array_contains(toks, x.plain[0])
        return hit & phrase(toks, list(x.plain)) if x.plain else hit

    tree = parse(query, list(fields))
    return condition(tree, {i: test(x) for i, x in enumerate(leaves(tree))})


def phrase(toks: Column, ws: list[str]) -> Column:
    """The words stand next to each other, in this order."""
    return F.concat(F.lit(" "), F.array_join(toks, " "), F.lit(" ")).contains(" " + " ".join(ws) + " ")


def _count(toks: str, word: str) -> Column:
    return F.size(F.filter(toks, lambda x: x == F.lit(word)))


def bm25(docs: DataFrame, terms: list[str], *, key: str, text: str = "text") -> DataFrame:
    """``key``, score of every document that holds a term.

    One pass for the statistics (document count, mean length, document frequencies: one row), one for the scores;
    nothing is shuffled but that row.  Ties are for the caller to break by key.
    """
    ws = sorted({w for t in terms for w in words_of(t)})
    d = docs.select(key, tokens(F.col(text)).alias("_t"))
    tf = {w: _count("_t", w) for w in ws}
    d = d.select(key, F.size("_t").alias("_n"), *[c.alias(f"_f{i}") for i, c in enumerate(tf.values())])
    stats = d.agg(F.count(F.lit(1)).alias("n"), F.avg("_n").alias("a"), *[F.count_if(F.col(f"_f{i}") > 0).alias(f"d{i}") for i in range(len(ws))]).first()
    n, mean = stats["n"], stats["a"] or 1.0
    score = F.lit(0.0)
    for i in range(len(ws)):
        idf = math.log(1 + (n - stats[f"d{i}"] + 0.5) / (stats[f"d{i}"] + 0.5))
        f = F.col(f"_f{i}")
        score = score + F.lit(idf) * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("_n") / F.lit(float(mean))))
    hit = F.greatest(*[F.col(f"_f{i}") for i in range(len(ws))], F.lit(0)) > 0
    return d.where(hit).select(key, score.alias("score"))


def top(scored: DataFrame, key: str, k: int, offset: int = 0) -> DataFrame:
    """The best ``k`` after ``offset``: ``key``, score, rank; ties by key."""
    best = scored.orderBy(F.desc("score"), key).limit(k + offset)
    w = Window.orderBy(F.desc("score"), key)  # over k + offset rows
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") > offset)


def dense(vecs: DataFrame, query: list[float], *, key: str = "id", vec: str = "vec", dim: int | None = None) -> DataFrame:
    """``key``, score: cosine of each vector (its first ``dim`` numbers) to the query; zero vectors score 0."""
    d = dim or len(query)
    q = [float(x) for x in query[:d]]
    qn = math.sqrt(sum(x * x for x in q))
    v = F.transform(F.slice(vec, 1, d), lambda x: x.cast("double"))
    dot = F.aggregate(F.zip_with(v, F.array(*[F.lit(x) for x in q]), lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return vecs.select(key, F.when((norm > 0) & F.lit(qn > 0), dot / (norm * F.lit(qn or 1.0))).otherwise(0.0).alias("score"))


def rrf(lexical: DataFrame, dense_: DataFrame, key: str, k: int = 60) -> DataFrame:
    """``key``, score of two ranked lists (``key``, rank) fused by reciprocal ranks; a full outer join."""
    a = lexical.select(key, F.col("rank").alias("lexical_rank"))
    b = dense_.select(key, F.col("rank").alias("dense_rank"))
    part = lambda c: F.coalesce(F.lit(1.0) / (k + F.col(c)), F.lit(0.0))
    return a.join(b, key, "full_outer").select(key, "lexical_rank", "dense_rank", (part("lexical_rank") + part("dense_rank")).alias("score"))


def facets(records: DataFrame, columns: tuple[str, ...] = ("custodian", "doctype")) -> DataFrame:
    """facet, value, n of the distinct values, without '' and 'unknown'."""
    pairs = F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).alias("value")) for c in columns])
    e = records.select(F.explode(pairs).alias("f")).select("f.*")
    return e.where("value is not null and value not in ('', 'unknown')").groupBy("facet", "value").agg(F.count(F.lit(1)).alias("n"))
