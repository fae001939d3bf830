"""Search queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casework.functions.text import snippet
from casework.operators import index as ix
from casework.operators import search as s
from casework.shared import fresh, table

TERMS = ("privilege", "custodian", "invoice")
DIM = 96
_OPEN: dict[tuple[str, str, str], ix.Index] = {}
_FIELDS = {"body": "text", "custodian": "custodian", "source": "source"}
_STORED = ["custodian", "doctype", "source"]


def _docs(spark, d) -> DataFrame:
    return table(spark, d, "documents")


def _index(spark, d, name: str = "documents") -> ix.Index:
    """The index of a table: written by the session's first query of it, read by all."""
    at = (spark.sparkContext.applicationId, d, name)
    if at not in _OPEN:
        path = fresh(spark, "index")
        if name == "documents":
            _OPEN[at] = ix.build_index(_docs(spark, d), path, key="doc_id", fields=_FIELDS, stored=_STORED)
        else:
            docs = table(spark, d, "dense_docs").where("text is not null").groupBy("identifier").agg(
                F.min("text").alias("text"), F.min("custodian").alias("custodian"), F.min("doctype").alias("doctype")
            )
            _OPEN[at] = ix.build_index(docs, path, key="identifier", fields={"body": "text"}, stored=["custodian", "doctype"])
            ix.build_dense(_vectors(spark, d), path)
    return _OPEN[at]


def _hits(spark, d, query: str) -> DataFrame:
    return _index(spark, d).matches(query).select(F.col("doc").alias("doc_id"))


def bm25_topk(spark, d):
    top = _index(spark, d).lexical("retention policy", "body", 20)
    return top.select(F.col("doc").alias("doc_id"), "rank", F.round("score", 6).alias("score"))


def bm25_scores(spark, d):
    return _index(spark, d).score(list(TERMS), "body").select(F.col("doc").alias("doc_id"), F.round("score", 6).alias("score"))


def lexical_offset(spark, d):
    """The third page of ten hits."""
    top = _index(spark, d).lexical("chain custody", "body", 10, 20)
    return top.select(F.col("doc").alias("doc_id"), "rank", F.round("score", 6).alias("score"))


def search_by_doctype(spark, d):
    """The best hundred of one kind of document, with their stored columns."""
    i = _index(spark, d)
    hits = i.search("counsel privilege", limit=100, where=F.col("doctype") == "email")
    return hits.select(F.col("doc").alias("doc_id"), "rank", F.round("score", 6).alias("score"), "custodian", "doctype")


def search_by_custodian(spark, d):
    """The best hundred of the custodian with the most documents (the first of them by name)."""
    c = _docs(spark, d).where("custodian is not null").groupBy("custodian").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "custodian").limit(1).collect()
    i = _index(spark, d)
    hits = i.search("counsel privilege", limit=100, where=F.col("custodian") == (c[0][0] if c else ""))
    return hits.select(F.col("doc").alias("doc_id"), "rank", F.round("score", 6).alias("score"), "custodian")


def index_stats(spark, d):
    return _index(spark, d).stats()


def index_update(spark, d):
    """An index of the English texts, updated with all: what is replaced counts once."""
    path = fresh(spark, "index")
    docs = _docs(spark, d)
    ix.build_index(docs.where("lang = 'en'"), path, key="doc_id", fields=_FIELDS, stored=_STORED)
    i = ix.update(docs, path, key="doc_id", fields=_FIELDS, stored=_STORED)
    body = i.terms.where("field = 'body'").agg(F.count(F.lit(1)).alias("terms"), F.sum("df").alias("postings"), F.sum("cf").alias("places"))
    return body.select(F.lit(i.n).cast("long").alias("documents"), "terms", "postings", "places")


def boolean_and_not(spark, d):
    return _hits(spark, d, "privilege AND log AND NOT invoice")


def boolean_not_only(spark, d):
    return _hits(spark, d, "NOT (invoice OR counsel OR the)")


def boolean_default_or(spark, d):
    return _hits(spark, d, "(subpoena deposition) AND counsel")


def phrase_search(spark, d):
    return _hits(spark, d, '"chain of custody form" OR "scope of the hold"')


def prefix_search(spark, d):
    return _hits(spark, d, "custod*")


def field_filter_search(spark, d):
    return _hits(spark, d, "source:deposition AND witness")


def hash_lookup(spark, d):
    from casework.operators.manifest import distinct_records

    m = distinct_records(table(spark, d, "manifest"))
    one = m.agg(F.min(F.lower("sha256")).alias("h"))
    return m.withColumn("h", F.lower("sha256")).join(F.broadcast(one), "h", "left_semi").select("path", "size")


def snippet_extract(spark, d):
    return _docs(spark, d).select("doc_id", snippet(F.col("text"), "custodian AND invoice").alias("snippet"))


def posting_stats(spark, d):
    return _index(spark, d).terms.where("field = 'body'").select("term", "df", "cf")


def _vectors(spark, d) -> DataFrame:
    z = table(spark, d, "embedding_results").select(F.explode(F.arrays_zip("identifiers", "embeddings")).alias("z"))
    v = z.select(F.col("z.identifiers").alias("id"), F.col("z.embeddings").alias("vec")).where(F.size("vec") == DIM)
    return v.groupBy("id").agg(F.min("vec").alias("vec"))


def _query(dim: int = DIM) -> list[float]:
    return [((i * 37) % 19 - 9) / 10 for i in range(dim)]


def _nearest(spark, d, dim: int | None = None) -> DataFrame:
    v = spark.read.parquet(f"{_index(spark, d, 'dense_docs').path}/vectors")
    return s.dense(v, _query(), key="doc", dim=dim).select(F.col("doc").alias("id"), F.round("score", 6).alias("score"))


def dense_topk(spark, d):
    return s.top(_nearest(spark, d), "id", 20).select("id", "rank", "score")


def matryoshka_topk(spark, d):
    return s.top(_nearest(spark, d, 32), "id", 20).select("id", "rank", "score")


def dense_metadata(spark, d):
    """The nearest twenty with the stored columns of their documents."""
    hits = s.top(_nearest(spark, d), "id", 20).withColumnRenamed("id", "doc")
    return _index(spark, d, "dense_docs").with_metadata(hits).select(F.col("doc").alias("id"), "rank", "score", "custodian", "doctype")


def hybrid_rrf(spark, d):
    i = _index(spark, d, "dense_docs")
    lex = s.top(i.score(["retention policy"], "body").select(F.col("doc").alias("id"), F.round("score", 6).alias("score")), "id", 50)
    return s.rrf(lex, s.top(_nearest(spark, d), "id", 50), "id").select("id", F.round("score", 9).alias("score"))


def embedding_telemetry(spark, d):
    """Tokens and latency in all, and the least, largest and mean size of a batch, per model."""
    e = table(spark, d, "embedding_results").select("batch_id", "model", "token_count", "latency_ms", F.size("identifiers").alias("k")).dropDuplicates()
    return e.groupBy("model").agg(
        F.count(F.lit(1)).alias("batches"), F.sum("token_count").alias("tokens"), F.round(F.sum("latency_ms"), 3).alias("latency"),
        F.min("k").alias("least"), F.max("k").alias("most"), F.round(F.avg("k"), 6).alias("mean"),
    )


def latency_p95_by_index(spark, d):
    """Mean, median and the value at place int(n * 0.95) - 1 (the last one's, if negative) of the sorted latencies."""
    e = table(spark, d, "embedding_results").select("batch_id", "model", "latency_ms").where("latency_ms is not null").dropDuplicates()
    g = e.groupBy("model").agg(F.array_sort(F.collect_list("latency_ms")).alias("l"), F.avg("latency_ms").alias("a"), F.percentile("latency_ms", F.lit(0.5)).alias("m"))
    k = F.floor(F.size("l") * 0.95).cast("int")
    return g.select("model", F.round("a", 6).alias("mean"), F.round("m", 6).alias("median"), F.round(F.when(k > 0, F.element_at("l", k)).otherwise(F.element_at("l", -1)), 6).alias("p95"))


def embedding_percentiles(spark, d):
    e = table(spark, d, "embedding_results").select("batch_id", "model", "token_count", "latency_ms").dropDuplicates()
    q = [F.round(F.percentile("latency_ms", F.lit(p)), 6).alias(f"p{round(p * 100)}") for p in (0.5, 0.95, 0.99)]
    return e.groupBy("model").agg(F.count(F.lit(1)).alias("batches"), F.sum("token_count").alias("tokens"), *q)


QUERIES = {
    f.__name__: f
    for f in (
        bm25_topk, bm25_scores, lexical_offset, search_by_doctype, search_by_custodian, index_stats, index_update, boolean_and_not, boolean_not_only,
        boolean_default_or, phrase_search, prefix_search, field_filter_search, hash_lookup, snippet_extract, posting_stats, dense_topk, matryoshka_topk,
        dense_metadata, hybrid_rrf, embedding_percentiles, embedding_telemetry, latency_p95_by_index,
    )
}

_TOK = r"regexp_extract_all(lower(coalesce({c}, '')), '[\p{{L}}\p{{N}}]+')"
_D = f"d AS (SELECT doc_id, {_TOK.format(c='text')} AS t, {_TOK.format(c='source')} AS src FROM documents)"


def _bm25(source: str, key: str, terms: tuple[str, ...]) -> str:
    ts = ", ".join(f"'{x}'" for x in sorted(terms))
    return f"""tk AS (SELECT {key}, {_TOK.format(c='text')} AS t FROM {source}),
st AS (SELECT count(*) AS n, avg(len(t)) AS a FROM tk),
tf AS (SELECT {key}, len(t) AS dl, q, len(list_filter(t, lambda x: x = q)) AS f FROM tk, (SELECT unnest([{ts}]) AS q)),
df AS (SELECT q, count(*) FILTER (f > 0) AS df FROM tf GROUP BY 1),
bm AS (SELECT {key}, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / a))) AS raw FROM tf JOIN df USING (q), st WHERE f > 0 GROUP BY 1)"""


def _has(w: str) -> str:
    return f"list_contains(t, '{w}')"


def _phrase(p: str) -> str:
    return f"contains(' ' || array_to_string(t, ' ') || ' ', ' {p} ')"


_VEC = f"v AS (SELECT id, min(vec) AS vec FROM (SELECT unnest(identifiers) AS id, unnest(embeddings) AS vec FROM embedding_results) WHERE len(vec) = {DIM} GROUP BY 1)"


def _dense(dim: int) -> str:
    q = "[" + ", ".join(f"{x}::DOUBLE" for x in _query(dim)) + "]"
    return f"""{_VEC}, w AS (SELECT id, CAST(vec[1:{dim}] AS DOUBLE[]) AS x, {q} AS y FROM v),
cs AS (SELECT id, round(CASE WHEN list_dot_product(x, x) > 0 THEN list_dot_product(x, y) / (sqrt(list_dot_product(x, x)) * sqrt(list_dot_product(y, y))) ELSE 0.0 END, 6) AS score FROM w)"""


_FLAT = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"
SQL = {
    "bm25_topk": f"WITH {_bm25('documents', 'doc_id', ('retention', 'policy'))} SELECT doc_id, rank, round(raw, 6) AS score FROM (SELECT *, row_number() OVER (ORDER BY raw DESC, doc_id) AS rank FROM bm) WHERE rank <= 20",
    "bm25_scores": f"WITH {_bm25('documents', 'doc_id', TERMS)} SELECT doc_id, round(raw, 6) AS score FROM bm",
    "lexical_offset": f"WITH {_bm25('documents', 'doc_id', ('chain', 'custody'))} SELECT doc_id, rank, round(raw, 6) AS score FROM (SELECT *, row_number() OVER (ORDER BY raw DESC, doc_id) AS rank FROM bm) WHERE rank BETWEEN 21 AND 30",
    "search_by_doctype": f"WITH {_bm25('documents', 'doc_id', ('counsel', 'privilege'))}, h AS (SELECT doc_id, raw, custodian, doctype FROM bm JOIN documents USING (doc_id) WHERE doctype = 'email') SELECT doc_id, rank, round(raw, 6) AS score, custodian, doctype FROM (SELECT *, row_number() OVER (ORDER BY raw DESC, doc_id) AS rank FROM h) WHERE rank <= 100",
    "search_by_custodian": f"WITH {_bm25('documents', 'doc_id', ('counsel', 'privilege'))}, c AS (SELECT custodian FROM documents WHERE custodian IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, custodian LIMIT 1), h AS (SELECT doc_id, raw, custodian FROM bm JOIN documents USING (doc_id) JOIN c USING (custodian)) SELECT doc_id, rank, round(raw, 6) AS score, custodian FROM (SELECT *, row_number() OVER (ORDER BY raw DESC, doc_id) AS rank FROM h) WHERE rank <= 100",
    "index_stats": f"""WITH t AS (SELECT doc_id, 'body' AS f, unnest({_TOK.format(c='text')}) AS term FROM documents UNION SELECT doc_id, 'custodian', unnest({_TOK.format(c='custodian')}) FROM documents
UNION SELECT doc_id, 'source', unnest({_TOK.format(c='source')}) FROM documents) SELECT (SELECT count(*) FROM documents) AS documents, count(DISTINCT term) AS terms, count(*) AS postings FROM t""",
    "index_update": f"WITH {_D}, p AS (SELECT doc_id, unnest(t) AS term FROM d) SELECT (SELECT count(*) FROM documents) AS documents, count(DISTINCT term) AS terms, count(DISTINCT (doc_id, term)) AS postings, count(*) AS places FROM p",
    "boolean_not_only": f"WITH {_D} SELECT doc_id FROM d WHERE NOT ({_has('invoice')} OR {_has('counsel')} OR {_has('the')})",
    "boolean_and_not": f"WITH {_D} SELECT doc_id FROM d WHERE {_has('privilege')} AND {_has('log')} AND NOT {_has('invoice')}",
    "boolean_default_or": f"WITH {_D} SELECT doc_id FROM d WHERE ({_has('subpoena')} OR {_has('deposition')}) AND {_has('counsel')}",
    "phrase_search": f"WITH {_D} SELECT doc_id FROM d WHERE {_phrase('chain of custody form')} OR {_phrase('scope of the hold')}",
    "prefix_search": f"WITH {_D} SELECT doc_id FROM d WHERE len(list_filter(t, lambda x: starts_with(x, 'custod'))) > 0",
    "field_filter_search": f"WITH {_D} SELECT doc_id FROM d WHERE list_contains(src, 'deposition') AND {_has('witness')}",
    "hash_lookup": "WITH r AS (SELECT DISTINCT * FROM manifest) SELECT path, size FROM r WHERE lower(sha256) = (SELECT min(lower(sha256)) FROM r)",
    "snippet_extract": f"""WITH x AS (SELECT doc_id, text, {_FLAT} AS f, strpos(lower({_FLAT}), 'custodian') AS p1, strpos(lower({_FLAT}), 'invoice') AS p2 FROM documents),
y AS (SELECT *, CASE WHEN p1 > 0 AND (p2 = 0 OR p1 < p2) THEN p1 - 1 ELSE p2 - 1 END AS p, CASE WHEN p1 > 0 AND (p2 = 0 OR p1 < p2) THEN 9 ELSE 7 END AS l FROM x),
z AS (SELECT *, greatest(0, p - 80) AS a, least(length(f), p + l + 80) AS b0 FROM y), zz AS (SELECT *, CASE WHEN b0 - a > 200 THEN a + 200 ELSE b0 END AS b FROM z)
SELECT doc_id, CASE WHEN coalesce(length(text), 0) = 0 THEN '' WHEN p1 = 0 AND p2 = 0 THEN CASE WHEN length(f) <= 200 THEN f ELSE substr(f, 1, 200) || '...' END
ELSE trim(CASE WHEN a > 0 THEN '...' ELSE '' END || substr(f, CAST(a + 1 AS BIGINT), CAST(b - a AS BIGINT)) || CASE WHEN b < length(f) THEN '...' ELSE '' END) END AS snippet FROM zz""",
    "posting_stats": f"WITH {_D} SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM (SELECT doc_id, unnest(t) AS term FROM d) GROUP BY 1",
    "dense_topk": f"WITH {_dense(DIM)} SELECT id, rank, score FROM (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS rank FROM cs) WHERE rank <= 20",
    "matryoshka_topk": f"WITH {_dense(32)} SELECT id, rank, score FROM (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS rank FROM cs) WHERE rank <= 20",
    "dense_metadata": f"WITH {_dense(DIM)}, h AS (SELECT id, rank, score FROM (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS rank FROM cs) WHERE rank <= 20) SELECT id, rank, score, custodian, doctype FROM h LEFT JOIN (SELECT identifier AS id, min(custodian) AS custodian, min(doctype) AS doctype FROM dense_docs WHERE text IS NOT NULL GROUP BY 1) USING (id)",
    "embedding_telemetry": "SELECT model, count(*) AS batches, CAST(sum(token_count) AS BIGINT) AS tokens, round(sum(latency_ms), 3) AS latency, CAST(min(k) AS INTEGER) AS least, CAST(max(k) AS INTEGER) AS most, round(avg(k), 6) AS mean FROM (SELECT DISTINCT batch_id, model, token_count, latency_ms, len(identifiers) AS k FROM embedding_results) GROUP BY 1",
    "latency_p95_by_index": "WITH g AS (SELECT model, list_sort(list(latency_ms)) AS l, avg(latency_ms) AS a, median(latency_ms) AS m FROM (SELECT DISTINCT batch_id, model, latency_ms FROM embedding_results WHERE latency_ms IS NOT NULL) GROUP BY 1) SELECT model, round(a, 6) AS mean, round(m, 6) AS median, round(CASE WHEN floor(len(l) * 0.95) > 0 THEN l[CAST(floor(len(l) * 0.95) AS INTEGER)] ELSE l[-1] END, 6) AS p95 FROM g",
    "hybrid_rrf": f"""WITH dd AS (SELECT identifier AS id, min(text) AS text FROM dense_docs WHERE text IS NOT NULL GROUP BY 1), {_bm25('dd', 'id', ('retention', 'policy'))}, {_dense(DIM)},
lx AS (SELECT id, row_number() OVER (ORDER BY round(raw, 6) DESC, id) AS r FROM bm), de AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS r FROM cs)
SELECT coalesce(a.id, b.id) AS id, round(coalesce(1.0::DOUBLE / (60 + a.r), 0.0) + coalesce(1.0::DOUBLE / (60 + b.r), 0.0), 9) AS score FROM (SELECT * FROM lx WHERE r <= 50) a FULL OUTER JOIN (SELECT * FROM de WHERE r <= 50) b ON a.id = b.id""",
    "embedding_percentiles": "SELECT model, count(*) AS batches, CAST(sum(token_count) AS BIGINT) AS tokens, round(quantile_cont(latency_ms, 0.5), 6) AS p50, round(quantile_cont(latency_ms, 0.95), 6) AS p95, round(quantile_cont(latency_ms, 0.99), 6) AS p99 FROM (SELECT DISTINCT batch_id, model, token_count, latency_ms FROM embedding_results) GROUP BY 1",
}
