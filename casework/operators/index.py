"""A search index that is written once and read by many queries: postings, documents, vectors, statistics.

Layout below one folder, all Parquet:

- ``postings``: term, field, doc, tf, dl (length of the field), places; one folder per bucket of term hashes, rows
  sorted by term, so a query opens the files of its terms' buckets and skips the row groups of other terms;
- ``terms``: term, field, df: the dictionary, which prefixes are looked up in;
- ``docs``: doc, segment, the stored columns and the length of each field;
- ``vectors``: doc, vec (with ``build_dense``);
- ``gone``: doc, segment of documents that a later segment replaces.

Every build or update writes a segment; a document belongs to the last segment that has it.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from casework.functions.text import tokens
from casework.operators import search as s

BUCKETS = 64


def _bucket(term: Column) -> Column:
    return (F.crc32(term.cast("binary")) % BUCKETS).cast("int")


def _shifted(places: Column, by: int) -> Column:
    return F.transform(places, lambda x: x - by)


def _write_segment(docs: DataFrame, path: str, segment: int, key: str, fields: dict[str, str], stored: list[str]) -> None:
    """``fields``: name -> column.  A document without a key is left out; of one key, the first row in the order of its columns counts."""
    cols = sorted({*fields.values(), *stored})
    one = docs.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("doc")).agg(F.min(F.struct(*cols)).alias("r"))
    toks = {f: tokens(F.col(f"r.{c}")) for f, c in fields.items()}
    one.select("doc", F.lit(segment).alias("segment"), *[F.col(f"r.{c}").alias(c) for c in stored], *[F.size(t).alias(f"n_{f}") for f, t in toks.items()]).write.mode("append").parquet(f"{path}/docs")
    each = F.array(*[F.struct(F.lit(f).alias("field"), F.size(t).alias("dl"), t.alias("t")) for f, t in toks.items()])
    t = one.select("doc", F.explode(each).alias("f")).select("doc", "f.field", "f.dl", F.posexplode("f.t").alias("place", "term"))
    p = t.groupBy("term", "field", "doc").agg(F.count(F.lit(1)).cast("int").alias("tf"), F.first("dl").alias("dl"), F.array_sort(F.collect_list("place")).alias("places"))
    p = p.withColumn("segment", F.lit(segment)).withColumn("bucket", _bucket(F.col("term")))
    # one range of (bucket, term) per task: a term that a third of the documents hold is split over tasks by doc
    p.repartitionByRange(F.col("bucket"), F.col("term"), F.col("doc")).sortWithinPartitions("bucket", "term", "doc").write.mode("append").partitionBy("bucket").parquet(f"{path}/postings")


def _count_terms(spark: SparkSession, path: str) -> None:
    live = _live(spark.read.parquet(f"{path}/postings"), spark, path)
    live.groupBy("term", "field").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf")).repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/terms")


def _live(df: DataFrame, spark: SparkSession, path: str) -> DataFrame:
    gone = spark.read.parquet(f"{path}/gone")
    return df.join(gone, ["doc", "segment"], "left_anti") if gone.take(1) else df


def build_index(docs: DataFrame, path: str, *, key: str, fields: dict[str, str], stored: list[str] = ()) -> "Index":
    """Writes the index of ``docs`` afresh."""
    spark = docs.sparkSession
    for part in ("postings", "docs", "terms", "gone"):
        _drop(spark, f"{path}/{part}")
    kind = docs.schema[key].dataType.simpleString()
    _write_segment(docs, path, 0, key, fields, list(stored))
    spark.createDataFrame([], f"doc {kind}, segment int").write.mode("overwrite").parquet(f"{path}/gone")
    _count_terms(spark, path)
    return open_index(spark, path)


def update(docs: DataFrame, path: str, *, key: str, fields: dict[str, str], stored: list[str] = ()) -> "Index":
    """Adds ``docs``; a document that is there already is replaced."""
    spark = docs.sparkSession
    have = spark.read.parquet(f"{path}/docs")
    segment = have.agg(F.max("segment")).first()[0]
    segment = 0 if segment is None else segment + 1
    again = have.select("doc", "segment").join(docs.select(F.col(key).alias("doc")).distinct(), "doc", "left_semi").distinct()
    gone = spark.read.parquet(f"{path}/gone")
    again.join(gone, ["doc", "segment"], "left_anti").write.mode("append").parquet(f"{path}/gone")
    _write_segment(docs, path, segment, key, fields, list(stored))
    _count_terms(spark, path)
    return open_index(spark, path)


def build_dense(vecs: DataFrame, path: str, *, key: str = "id", vec: str = "vec") -> int:
    """Stores the vectors of documents; those that are null or empty are left out.  The number that was stored."""
    v = vecs.where(F.size(vec) > 0).groupBy(F.col(key).alias("doc")).agg(F.min(vec).alias("vec"))
    v.write.mode("overwrite").parquet(f"{path}/vectors")
    return v.sparkSession.read.parquet(f"{path}/vectors").count()


def _drop(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(p):
        fs.delete(p, True)


def open_index(spark: SparkSession, path: str) -> "Index":
    """Reads what a query needs before it starts: one row of statistics, and whether documents were replaced."""
    postings, docs = spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/docs")
    replaced = bool(spark.read.parquet(f"{path}/gone").take(1))
    names = [c.removeprefix("n_") for c in docs.columns if c.startswith("n_")]
    live = _live(docs, spark, path)
    row = live.agg(F.count(F.lit(1)).alias("n"), *[F.avg(f"n_{f}").alias(f) for f in names]).first()
    terms = spark.read.parquet(f"{path}/terms")
    return Index(spark, path, postings, docs, terms, row["n"], {f: row[f] or 1.0 for f in names}, replaced)


@dataclass
class Index:
    """An open index.  ``n``: documents; ``mean``: mean length of each field."""

    spark: SparkSession
    path: str
    postings: DataFrame
    docs: DataFrame
    terms: DataFrame
    n: int
    mean: dict[str, float] = field(default_factory=dict)
    replaced: bool = False

    def live(self, df: DataFrame) -> DataFrame:
        return df.join(self.spark.read.parquet(f"{self.path}/gone"), ["doc", "segment"], "left_anti") if self.replaced else df

    def stats(self) -> DataFrame:
        """One row: documents, distinct terms, postings, mean length of the first field."""
        t = self.terms.agg(F.countDistinct("term").alias("terms"), F.coalesce(F.sum("df"), F.lit(0)).alias("postings"))
        return t.select(F.lit(self.n).cast("long").alias("documents"), "terms", "postings")

    def of(self, words: set[tuple[str, str]]) -> DataFrame:
        """The postings of (field, term) pairs: only their buckets are opened, only their row groups read."""
        if not words:
            return self.postings.limit(0)
        names = sorted({w for _, w in words})
        buckets = sorted({zlib.crc32(w.encode()) % BUCKETS for w in names})
        p = self.postings.where(F.col("bucket").isin(buckets) & F.col("term").isin(names))
        which = F.concat_ws(":", "field", "term").isin([f"{f}:{w}" for f, w in sorted(words)])
        return self.live(p.where(which))

    def expand(self, fld: str, prefix: str) -> list[str]:
        """The terms of a field that begin with ``prefix``, from the dictionary."""
        t = self.terms.where((F.col("field") == fld) & F.col("term").startswith(prefix)).select("term")
        return [r["term"] for r in t.collect()]

    def matches(self, query: str) -> DataFrame:
        """doc of every document that the query holds for, from the postings of its words alone."""
        tree = s.parse(query, list(self.mean))
        if tree is None:
            return self.docs.select("doc").limit(0)
        heads = {(f, w): self.expand(f, w) for f, w in s.prefixes(tree)}
        words = {(f, w) for leaf in s.leaves(tree) for f, w in leaf.words()} | {(f, w) for (f, _), ws in heads.items() for w in ws}
        p = self.of(words)
        cols, aggs = {}, []
        for i, leaf in enumerate(s.leaves(tree)):
            at = lambda w, f=leaf.field: F.max(F.when((F.col("field") == f) & (F.col("term") == w), F.col("places")))
            if leaf.prefix:
                hs = heads[leaf.field, leaf.prefix]
                aggs.append(F.flatten(F.collect_list(F.when((F.col("field") == leaf.field) & F.col("term").isin(hs), F.col("places")))).alias(f"h{i}") if hs else F.lit(None).cast("array<int>").alias(f"h{i}"))
            aggs += [at(w).alias(f"p{i}_{k}") for k, w in enumerate(leaf.plain)]
            starts = [_shifted(F.col(f"p{i}_{k}"), k) for k in range(len(leaf.plain))]
            hit = F.size(F.col(f"h{i}")) > 0 if leaf.prefix else F.lit(True)
            if starts:  # the words stand next to each other, in this order
                common = starts[0]
                for x in starts[1:]:
                    common = F.array_intersect(common, x)
                hit = hit & (F.size(common) > 0)
            cols[i] = F.coalesce(hit, F.lit(False))
        g = p.groupBy("doc").agg(*aggs) if aggs else p.select("doc").distinct()
        if s.holds(tree, lambda _: False):  # also of documents that hold none of the words
            g = self.live(self.docs).select("doc").distinct().join(g, "doc", "left")
        return g.where(s.condition(tree, cols)).select("doc")

    def score(self, query_terms: list[str], fld: str) -> DataFrame:
        """doc, score: BM25 of every document that holds a term; document frequencies come with the same postings."""
        words = {(fld, w) for t in query_terms for w in s.words_of(t)}
        p = self.of(words)
        df = F.broadcast(p.groupBy("term").agg(F.count(F.lit(1)).alias("df")))  # a row per term of the query
        idf = F.log(1 + (self.n - F.col("df") + 0.5) / (F.col("df") + 0.5))
        f = F.col("tf")
        part = idf * f * (s.K1 + 1) / (f + s.K1 * (1 - s.B + s.B * F.col("dl") / F.lit(float(self.mean[fld]))))
        return p.join(df, "term").groupBy("doc").agg(F.sum(part).alias("score"))

    def lexical(self, query: str, fld: str, limit: int = 10, offset: int = 0, where: Column | None = None) -> DataFrame:
        """doc, score, rank of the best documents; ``where``: a condition on the stored columns."""
        scored = self.score([query], fld)
        if where is not None:
            scored = scored.join(self.live(self.docs).where(where).select("doc"), "doc", "left_semi")
        return s.top(scored, "doc", limit, offset)

    def dense(self, vec: list[float], limit: int = 10, offset: int = 0, dim: int | None = None) -> DataFrame:
        """doc, score, rank of the nearest stored vectors."""
        v = self.spark.read.parquet(f"{self.path}/vectors")
        wide = v.select(F.max(F.size("vec"))).first()[0]
        if wide is not None and len(vec) != wide:
            raise ValueError(f"the query has {len(vec)} numbers, the index {wide}")
        return s.top(s.dense(v, vec, key="doc", dim=dim), "doc", limit, offset)

    def hybrid(self, query: str, fld: str, vec: list[float], limit: int = 10, budget: int | None = None, dim: int | None = None) -> DataFrame:
        """doc, lexical_rank, dense_rank, score, rank: both lists, ``budget`` or at least 20 long, fused by reciprocal ranks."""
        b = budget or max(limit, 20)
        fused = s.rrf(self.lexical(query, fld, b), self.dense(vec, b, dim=dim), "doc")
        w = Window.orderBy(F.desc("score"), F.asc_nulls_last("dense_rank"), F.asc_nulls_last("lexical_rank"))  # over 2 b rows
        return fused.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)

    def search(self, query: str, mode: str = "lexical", *, fld: str = "body", vec: list[float] | None = None, limit: int = 10, offset: int = 0, where: Column | None = None, dim: int | None = None) -> DataFrame:
        """One entrance to all of them: lexical (BM25), dense, hybrid; the result has the stored columns."""
        if mode in ("dense", "hybrid") and vec is None:
            raise ValueError(f"{mode} search needs a vector")
        if mode in ("lexical", "bm25"):
            hits = self.lexical(query, fld, limit, offset, where)
        elif mode == "dense":
            hits = self.dense(vec, limit, offset, dim)
        elif mode == "hybrid":
            hits = self.hybrid(query, fld, vec, limit, dim=dim)
        else:
            raise ValueError(f"unknown mode {mode!r}")
        return self.with_metadata(hits)

    def with_metadata(self, hits: DataFrame) -> DataFrame:
        """The hits (few) with the stored columns of their documents; null where a document has none."""
        kept = [c for c in self.docs.columns if c not in ("segment",) and not c.startswith("n_")]
        return hits.join(self.live(self.docs).select(*kept), "doc", "left")
