"""Core operators on small fixtures, held against plain Python."""

from __future__ import annotations

import hashlib
import hmac
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from casework.functions import text as t
from casework.operators import detect, index, ledger, manifest, marks, package, produce, review, search
from casework.shared import ranked
from casework.sources import files
from casework.streaming import activity


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols or df.columns) for r in df.collect())


def test_spans_equal_finditer(spark):
    texts = ["", "a@b.co", "x a@b.co, c.d@e.org!", "déjà 😀 a@b.co é", None, "no", "a@b.co a@b.co", "z" * 5000 + " q@w.er"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "id int, text string")
    got = {r["id"]: [(s["start"], s["end"]) for s in r["s"] or []] for r in df.select("id", t.spans(F.col("text"), t.EMAIL).alias("s")).collect()}
    for i, x in enumerate(texts):
        assert got[i] == [m.span() for m in re.finditer(t.EMAIL, x or "")]


def test_label_never_cuts(spark):
    df = spark.createDataFrame([(1,), (123456789,)], "n long")
    assert rows(df.select(t.label("DOC", F.col("n"), 6, "-").alias("l"))) == [("DOC-000001",), ("DOC-123456789",)]


def test_input_hash_and_hmac(spark):
    df = spark.createDataFrame([(["b", "a"], "hé")], "a array<string>, m string")
    r = df.select(t.input_hash(F.col("a")).alias("h"), t.hmac_sha256(b"key" * 40, F.col("m")).alias("s")).first()
    assert r["h"] == "7e18f737311b2dc3b2f269dd78396b0351f14fb66efa879f768cb23181883c78"
    assert r["s"] == hmac.new(b"key" * 40, "hé".encode(), hashlib.sha256).hexdigest()


@pytest.mark.parametrize(("query", "want"), [("contract", "...long text about contracts and more."), ("missing", None), ("", "")])
def test_snippet(spark, query, want):
    text = "word " * 30 + "long text about contracts and more."
    got = spark.createDataFrame([(text,)], "x string").select(t.snippet(F.col("x"), query, around=16).alias("s")).first()["s"]
    if want is None:
        assert got == text.strip()
    else:
        assert got.endswith(want[3:]) if want else got == ""


@pytest.mark.parametrize(
    ("mime", "ext", "want"), [(None, ".ocr", "text"), ("message/rfc822", ".eml", "email"), (None, ".PST", "email_archive"), (None, ".xyz", None), ("text/html", ".pdf", "text")]
)
def test_doctype(spark, mime, ext, want):
    df = spark.createDataFrame([(mime, ext)], "m string, e string")
    assert df.select(manifest.doctype_of(F.col("m"), F.col("e"))).first()[0] == want


def test_custodian(spark):
    df = spark.createDataFrame([("/data/custodians/john_doe/a.txt",), ("/home/Users/x.txt",), ("/a/b.txt",)], "p string")
    assert [r[0] for r in df.select(manifest.custodian_of(F.col("p"))).collect()] == ["john_doe", "x.txt", None]


def test_rollup_equals_plain_groups(spark):
    data = [("a", "pdf", ".pdf", 1), ("a", None, ".PDF", 2), ("", "pdf", ".txt", 3), (None, "", ".txt", 4)]
    r = manifest.rollup(spark.createDataFrame(data, "custodian string, doctype string, extension string, size long"))
    assert rows(r.where("level = 3"), "custodian", "n", "bytes") == [("a", 2, 3), ("unknown", 2, 7)]
    assert rows(r.where("level = 5"), "doctype", "n") == [("other", 2), ("pdf", 2)]
    assert rows(r.where("level = 7"), "n", "bytes") == [(4, 10)]


def test_ranked_equals_window(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"), (F.col("id") % 5).alias("v"))
    got = {r["k"]: (r["rank"], r["running"]) for r in ranked(df, ["k"], total=F.col("v")).collect()}
    run = 0
    for i, (k, v) in enumerate(sorted((r["k"], r["v"]) for r in df.collect())):
        assert got[k] == (i + 1, run)
        run += v


def test_ranked_empty(spark):
    assert ranked(spark.createDataFrame([], "k long"), ["k"]).count() == 0


def test_page_ranges(spark):
    df = spark.createDataFrame([("a", "/x", 3), ("b", "/y", 2)], "sha256 string, path string, pages int")
    assert rows(produce.number_pages(df), "start_label", "end_label") == [("ABC0000001", "ABC0000003"), ("ABC0000004", "ABC0000005")]


def test_registry(spark):
    reg = spark.createDataFrame([("/a", "h1", "N1"), ("/b", "h1", "N1"), ("/c", "h3", None), ("/d", "h4", "N4")], "document string, sha256 string, bates_id string")
    have = spark.createDataFrame([("/a", "H1"), ("/b", "h2"), ("/c", "h3")], "path string, sha256 string")
    got = rows(produce.registry_violations(reg, have), "document", "rule")
    assert got == sorted(
        [("/a", "duplicate_id"), ("/b", "duplicate_id"), ("/a", "duplicate_hash"), ("/b", "duplicate_hash"), ("/b", "hash_mismatch"), ("/c", "missing_field"), ("/d", "missing_file")]
    )


def test_rrf(spark):
    lex = spark.createDataFrame([("A", 1), ("B", 2), ("C", 3)], "id string, rank int")
    den = spark.createDataFrame([("B", 1), ("C", 2), ("A", 3)], "id string, rank int")
    got = {r["id"]: r["score"] for r in search.rrf(lex, den, "id").collect()}
    assert got["B"] == pytest.approx(0.032522475) and got["A"] == pytest.approx(0.032266458) and got["C"] == pytest.approx(0.032002048)


@pytest.mark.parametrize(
    ("query", "want"),
    [("privilege", [1, 2]), ("privilege AND NOT log", [2]), ('"log the"', [3]), ("prot*", [3]), ("who:smith", [2]), ("(log OR missing) AND privilege", [1]), ("log privilege", [1, 2, 3])],
)
def test_query_language(spark, query, want):
    data = [(1, "The Privilege log", "doe"), (2, "privilege", "smith"), (3, "log the protocol", None), (4, None, None)]
    df = spark.createDataFrame(data, "id int, text string, who string")
    fields = {"body": t.tokens(F.col("text")), "who": t.tokens(F.col("who"))}
    assert [r[0] for r in rows(df.where(search.matching(query, fields)), "id")] == want


@pytest.mark.parametrize("query", ["(a", "a AND", "a )"])
def test_query_errors(spark, query):
    with pytest.raises(ValueError):
        search.matching(query, {"body": F.array(F.lit("a"))})


def test_concept_scores(spark):
    text = "From: counsel@lawfirm.com\nThis is privileged legal advice."
    r = detect.concept_scores(spark.createDataFrame([(1, text), (2, None), (3, "")], "id int, text string"), "id")
    got = {(x["rule"], x["start"]): x["confidence"] for x in r.collect()}
    assert got[("EMAIL_HEADER", 0)] == 1.0 and got[("EMAIL_ADDRESS", 6)] == 0.85
    assert got[("LEGAL_ADVICE", 34)] == pytest.approx(0.9) and ("LEGAL_ADVICE", 45) in got and len(got) == 4


def test_concept_threshold_is_a_floor(spark):
    r = detect.concept_scores(spark.createDataFrame([(1, "the plaintiff")], "id int, text string"), "id", threshold=0.95)
    assert [x["confidence"] for x in r.collect()] == [0.95]


def test_redaction(spark):
    df = spark.createDataFrame([("a b c", [(0, 1, "X"), (4, 5, "Y")]), ("a", [])], "x string, s array<struct<start:int,end:int,entity:string>>")
    assert [r[0] for r in df.select(produce.apply_spans(F.col("x"), F.col("s"))).collect()] == ["[X] b [Y]", "a"]


def test_ledger(spark, tmp_path):
    e = spark.createDataFrame([(i, f"op{i}", i % 2) for i in range(50)] + [(50, "x", None)], "id int, op string, who int")
    c = ledger.sign(ledger.chain(e, "who", ["id"], F.col("op"), segment=10), b"k").cache()
    h = ledger.heads(c, "who").cache()
    want, last = {}, {}
    for i in range(50):
        n = i // 2
        p = last.get(i % 2) if n % 10 else ledger.GENESIS if n < 10 else hashlib.sha256(f"{i % 2}:{n // 10}".encode()).hexdigest()
        last[i % 2] = want[i] = hashlib.sha256(f"{p}|op{i}".encode()).hexdigest()
    got = {r["id"]: r["entry_hash"] for r in c.collect()}
    assert {i: got[i] for i in want} == want and ledger.verify(c, "who", b"k", h).count() == 0
    seen = lambda bad, **kw: rows(ledger.verify(bad, "who", b"k", **kw), "who", "sequence", "error")
    at = (F.col("who") == 1) & (F.col("sequence") == 15)
    assert seen(c.withColumn("content", F.when(at, F.lit("y")).otherwise(F.col("content")))) == [(1, 15, "hash_invalid")]
    assert seen(c.where(~at)) == [(1, 16, "chain_broken")]
    assert seen(c.withColumn("signature", F.when(at, F.lit("y")).otherwise(F.col("signature")))) == [(1, 15, "signature_invalid")]
    # an entry rewritten with its hash and signature breaks the next; with all of its segment redone, the heads show it
    redone = ledger.sign(ledger.chain(e.withColumn("op", F.when(F.col("id") == 29, F.lit("y")).otherwise(F.col("op"))), "who", ["id"], F.col("op"), segment=10), b"k")
    assert rows(ledger.verify(redone, "who", b"k"), "error") == [] and set(rows(ledger.verify(redone, "who", b"k", h), "who", "error")) == {(1, "tip_mismatch")}
    w = ledger.Writer(str(tmp_path / "l.jsonl"), b"k")
    w.log("a")
    w.log("b", args={"x": 1})
    assert ledger.verify_file(str(tmp_path / "l.jsonl"), b"k") == (True, None)
    assert ledger.verify_file(str(tmp_path / "l.jsonl"), b"other")[0] is False
    assert [r["operation"] for r in ledger.read(spark, str(tmp_path / "l.jsonl")).collect()] == ["a", "b"]
    whole = (tmp_path / "l.jsonl").read_text()
    (tmp_path / "l.jsonl").write_text(whole.splitlines()[0] + "\n")
    assert ledger.verify_file(str(tmp_path / "l.jsonl"), b"k") == (False, "the seal names another tip")
    (tmp_path / "l.jsonl").write_text(whole)
    lines = (tmp_path / "l.jsonl").read_text().replace('"b"', '"c"')
    (tmp_path / "l.jsonl").write_text(lines)
    assert ledger.verify_file(str(tmp_path / "l.jsonl"), b"k") == (False, "line 2: hash invalid")


def test_discovery_and_extraction(spark, tmp_path):
    d = tmp_path / "custodians" / "doe"
    d.mkdir(parents=True)
    (d / "a.txt").write_bytes("héllo \xff".encode("latin-1"))
    (d / "b.PNG").write_bytes(b"\x89PNG\r\n\x1a\n" + b"\0" * 8 + (3).to_bytes(4, "big") + (5).to_bytes(4, "big"))
    with zipfile.ZipFile(d / "c.docx", "w") as z:
        w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body><w:p><w:r><w:t>One</w:t></w:r></w:p><w:p/><w:tbl><w:tr><w:tc><w:p><w:r><w:t>x</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>y</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>')
    (d / "e.docx").write_bytes(b"broken")
    (d / "f.xyz").write_text("?")
    r = {x["path"].rsplit("/", 1)[1]: x for x in files.discover(spark, str(tmp_path)).collect()}
    assert len(r) == 5 and r["a.txt"]["custodian"] == "doe" and r["a.txt"]["sha256"] == hashlib.sha256((d / "a.txt").read_bytes()).hexdigest()
    assert files.discover(spark, str(tmp_path), include=[".TXT"]).count() == 1
    x = {y["path"].rsplit("/", 1)[1]: y for y in files.extract(spark, str(tmp_path)).collect()}
    assert x["c.docx"]["text"] == "One\nx | y" and x["b.PNG"]["format"] == "PNG 3x5" and "�" in x["a.txt"]["text"]
    assert x["e.docx"]["error"] and x["f.xyz"]["error"].startswith("unsupported")


def test_encrypted_lines(spark):
    df = spark.createDataFrame([("a", 1)], "x string, n int")
    key = b"0" * 16
    lines = files.encrypt_lines(df, key).unionAll(spark.createDataFrame([('{"x":"p","n":2}',)], "value string"))
    assert rows(files.decrypt_lines(lines, key, "x string, n int")) == [("a", 1), ("p", 2)]


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("b",), ("a",)], "line string")
    assert files.write_lines(df.coalesce(1), str(tmp_path / "x.dat"), "H") == 2
    assert (tmp_path / "x.dat").read_text() == "H\nb\na\n"
    files.write_jsonl(spark.createDataFrame([(1, "x")], "b int, a string"), str(tmp_path / "j"))
    assert files.read_jsonl(spark, str(tmp_path / "j"), "a string, b int").collect()[0]["a"] == "x"
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "f").write_text("1")
    a, b = files.archive(str(tmp_path / "in"), str(tmp_path / "a.zip")), files.archive(str(tmp_path / "in"), str(tmp_path / "b.zip"))
    assert open(a, "rb").read() == open(b, "rb").read()


@pytest.mark.parametrize("text", ['{"a": 1}', 'x ```json\n{"a": 1}\n``` y', 'so {"a": 1} it is'])
def test_json_in_text(text):
    assert files.json_in_text(text) == {"a": 1}


def test_stream_equals_batch(spark, tmp_path):
    df = spark.createDataFrame([(i % 3, f"2024-01-01 0{i % 4}:00:00", "e") for i in range(20)], "user_id int, ts string, event_type string")
    df.withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(str(tmp_path / "ev"))
    schema = spark.read.parquet(str(tmp_path / "ev")).schema
    got = rows(activity.run(activity.tumbling(activity.read(spark, str(tmp_path / "ev"), schema))))
    want = rows(df.groupBy(F.unix_micros(F.col("ts").cast("timestamp")).alias("b"), "event_type").agg(F.count(F.lit(1))))
    assert got == want


def test_index_equals_scan(spark, tmp_path):
    data = [(1, "The Privilege log", "doe"), (2, "privilege", "smith"), (3, "log the protocol log", None), (4, None, None), (5, "", "doe"), (None, "log", "doe"), (1, "The Privilege log", "doe")]
    df = spark.createDataFrame([(*x, x[1], 9) for x in data], "id int, text string, who string, term string, segment int")
    i = index.build_index(df, str(tmp_path / "i"), key="id", fields={"body": "text", "who": "who"}, stored=["who"])
    fields = {"body": t.tokens(F.col("text")), "who": t.tokens(F.col("who"))}
    scan = df.where("id is not null").dropDuplicates()
    for q in ("privilege", "privilege AND NOT log", '"log the"', '"the log"', "prot*", "who:smith OR prot*", "NOT log", "(log OR missing) AND privilege", "!!", '"log the pro" OR who:doe'):
        assert rows(i.matches(q), "doc") == rows(scan.where(search.matching(q, fields)), "id"), q
    assert i.n == 5 and rows(i.stats()) == [(5, 6, 10)]
    want = {r["id"]: r["score"] for r in search.bm25(scan, ["log"], key="id").collect()}
    assert {r["doc"]: r["score"] for r in i.score(["log"], "body").collect()} == pytest.approx(want)
    assert [[r["doc"] for r in i.search("log", limit=1, offset=k).collect()] for k in range(3)] == [[3], [1], []]
    # a document that comes again is replaced, one that is new is added
    j = index.update(spark.createDataFrame([(3, "nothing", "doe"), (6, "log book", "smith")], "id int, text string, who string"), str(tmp_path / "i"), key="id", fields={"body": "text", "who": "who"}, stored=["who"])
    assert j.n == 6 and rows(j.matches("log"), "doc") == [(1,), (6,)] and rows(j.matches("protocol")) == [] and rows(j.matches("nothing"), "doc") == [(3,)]
    assert index.build_dense(spark.createDataFrame([(1, [1.0, 0.0]), (6, [0.0, 1.0]), (3, None)], "id int, vec array<double>"), str(tmp_path / "i")) == 2
    h = j.search("log", "hybrid", vec=[0.0, 1.0], limit=2).orderBy("rank").collect()
    assert [r["doc"] for r in h] == [6, 1] and h[0]["who"] == "smith"
    with pytest.raises(ValueError):
        j.dense([1.0])


def test_overlaps_by_running_end(spark):
    r = [("A001", "A100"), ("A010", "A020"), ("A050", "A060"), ("A101", "A105"), ("A999", "A1000"), ("A1000", "A1001"), ("B001", "B001"), (None, "B2")]
    got = rows(produce.overlaps(spark.createDataFrame(r, "start_label string, end_label string")))
    assert got == [("A010", "A020", "A100"), ("A050", "A060", "A100"), ("A1000", "A1001", "A1000")]


def test_paths(spark):
    df = spark.createDataFrame([("custodians/doe/a.txt",), ("/x/.bashrc",), ("/x/a.tar.GZ",), ("/Users/b",), ("plain",)], "p string")
    got = rows(df.select("p", manifest.custodian_of(F.col("p")).alias("c"), manifest.extension_of(F.col("p")).alias("e")))
    assert got == [("/Users/b", "b", ""), ("/x/.bashrc", None, ""), ("/x/a.tar.GZ", None, ".GZ"), ("custodians/doe/a.txt", "doe", ".txt"), ("plain", None, "")]


def test_privilege_patterns(spark):
    text = "x" * 60 + " Work Product of ann@lawfirm.com, Bob Lee" + "y" * 60
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "id int, text string")
    at = lambda th: rows(review.privilege_patterns(df, "id", domains=("lawfirm.com",), names=("Bob Lee",), threshold=th), "rule", "confidence")
    assert at(0.5) == [("attorney_domain", 0.7), ("privilege_keyword", 0.9)] and at(0.95) == []
    df = spark.createDataFrame([(1, "Bob Lee gave legal advice")], "id int, text string")
    f = review.privilege_patterns(df, "id", names=("bob lee",))
    assert rows(f, "rule", "start", "end", "snippet") == [("attorney_name", 0, 7, "Bob Lee"), ("privilege_keyword", 13, 25, "Bob Lee gave legal advice")]
    d = review.privilege_decisions(df, review.privilege_summary(f, "id"), "id").first()
    assert (d["route"], d["labels"], d["needs_review"]) == ("pattern", ["PRIVILEGED:PATTERN_KEYWORD", "PRIVILEGED:ATTORNEY_NAME"], False)


@pytest.mark.parametrize(
    ("tokens", "want"),
    [(["a", "--api-key", "s", "x"], "a --api-key *** x"), (["--KEY=s"], "--KEY=***"), (["--key", "--dim", "3"], "--key --dim 3"), (["--key"], "--key"), ([], "")],
)
def test_argv(spark, tokens, want):
    df = spark.createDataFrame([(tokens,)], "t array<string>")
    assert df.select(review.argv(F.col("t"))).first()[0] == want


def test_finding_lines_and_refine(spark):
    lines = [('{"concept":"A","category":"b","confidence":"0.6","start":1,"end":2}',), ("A | b | 0.7 | 3 | 4",), ("A|b|x|3|4",), ("{bad",), ("|b|1|1|1",), (None,)]
    got = review.parse_findings(spark.createDataFrame(lines, "line string"))
    assert rows(got, "confidence", "start", "end") == [(0.6, 1, 2), (0.7, 3, 4)]
    f = spark.createDataFrame([(1, 0.9, False), (2, 0.6, True), (3, 0.3, None)], "id int, confidence double, needs_refinement boolean")
    assert rows(review.refine(f, lambda p: p["confidence"] + 1), "id", "confidence", "part") == [(1, 0.9, "sure"), (2, 1.0, "refined"), (3, 0.3, "sure")]
    assert rows(review.refine(f, lambda p: 1 / 0), "id", "part") == [(1, "sure"), (2, "kept"), (3, "sure")]


def test_breaker():
    now = [0.0]
    b = review.Breaker(2, 10, lambda: now[0])
    for _ in range(2):
        with pytest.raises(ZeroDivisionError):
            b.call(lambda: 1 / 0)
    with pytest.raises(RuntimeError):
        b.call(lambda: 1)
    now[0] = 11
    assert b.state == "half_open" and b.call(lambda: 1) == 1 and b.state == "closed"


def test_plan_ids(spark):
    docs = spark.createDataFrame([("/a", "mail x@y.zz"), ("/b", "mail x@y.zz")], "path string, text string")
    found = detect.pattern_findings(docs, "path", {"EMAIL": t.EMAIL}).withColumn("page", F.lit(None).cast("int"))
    plans = marks.redaction_plans(docs, found, types=["EMAIL"])
    assert len(set(rows(plans, "plan_id"))) == 2 and marks.plan_errors(plans, docs).count() == 0
    now = spark.createDataFrame([("/a", "mail")], "path string, text string")
    assert rows(marks.plan_errors(plans, now), "path", "error") == [("/a", "hash_mismatch"), ("/a", "span_outside"), ("/b", "path_missing")]


def test_privilege_log(spark):
    prev = spark.createDataFrame([("PRIVID-0007", "F1", "D1")], "privlog_id string, family_id string, document string")
    new = spark.createDataFrame([("F2", "D9"), ("F1", "D1"), ("F1", "D2"), ("F1", "D2"), (None, None)], "family_id string, document string")
    assert rows(review.log_entries(new, prev)) == [("PRIVID-0007", "F1", "D1"), ("PRIVID-0008", "F1", "D2"), ("PRIVID-0009", "F2", "D9")]


def test_pipeline_and_pack(spark, tmp_path):
    src = tmp_path / "in" / "custodians" / "doe"
    src.mkdir(parents=True)
    (src / "a.txt").write_text("write to x@y.zz")
    (src / "b.txt").write_text("write to x@y.zz")
    (src / "c.md").write_text("nothing")
    out = str(tmp_path / "out")
    r = {x["name"]: x for x in package.run(spark, str(tmp_path / "in"), out)}
    assert [x["status"] for x in r.values()] == ["completed"] * 6 and r["discover"]["rows"] == 3 and r["dedupe"]["rows"] == 2 and r["redaction_plan"]["rows"] == 1
    assert package.check_pack(spark, f"{out}/pack") == []
    skipped = package.run(spark, str(tmp_path / "in"), str(tmp_path / "o2"), skip=("dedupe", "redaction_plan", "pack"))
    assert [x["status"] for x in skipped].count("skipped") == 3 and skipped[-1]["status"] == "failed"
    assert package.check_pack(spark, str(tmp_path / "none")) == ["manifest cannot be read"]
    assert package.deterministic(lambda: spark.range(5))
    with pytest.raises(ValueError):
        package.Migrations().apply(spark.range(1), "x", 2, 1)
    with pytest.raises(package.Offline):
        package.require_online("search", False)
    page = package.html_report(files.discover(spark, str(src)).withColumn("custodian", F.lit("<doe>")), "t & t")
    assert "&lt;doe&gt;" in page and "t &amp; t" in page


def test_store_and_text(spark, tmp_path):
    key = b"1" * 16
    for p in ("/a", "/b"):
        files.append_encrypted(spark.createDataFrame([(p, 1)], "path string, n int"), str(tmp_path / "s"), key)
    assert rows(files.read_store(spark, str(tmp_path / "s"), key, "path string, n int", "/b")) == [("/b", 1)]
    files.write_text(spark.createDataFrame([(i, f"l{i}") for i in range(20)], "line_no long, line string"), str(tmp_path / "t"))
    got = [x for f in sorted((tmp_path / "t").glob("part-*")) for x in f.read_text().splitlines()]
    assert got == [f"l{i}" for i in range(20)]


def test_first_pages_and_boxes(spark):
    pages = spark.createDataFrame([("d", 0, "aa"), ("d", 1, "bb aa")], "k string, page int, text string")
    e = spark.createDataFrame([("d", 1, "bb", None), ("d", 2, "aa", 1), ("d", 3, "aa", 7), ("d", 4, "zz", None)], "k string, id int, needle string, page int")
    got = {r["id"]: (r["page"], r["state"]) for r in marks.first_pages(e, pages, "k").collect()}
    assert got == {1: (1, "applied"), 2: (1, "applied"), 3: (7, "page_missing"), 4: (None, "not_found")}


def test_resumed_stream(spark, tmp_path):
    src, state = str(tmp_path / "ev"), str(tmp_path / "st")
    make = lambda n: spark.createDataFrame([(n, "2024-01-01 00:00:00", "e")], "user_id int, ts string, event_type string").withColumn("ts", F.col("ts").cast("timestamp"))
    make(1).write.mode("append").parquet(src)
    schema = spark.read.parquet(src).schema
    once = lambda: rows(activity.run(activity.first_seen(activity.read(spark, src, schema), ["user_id"]), "append", state))
    assert once() == [(1,)]
    make(2).write.mode("append").parquet(src)
    assert once() == [(1,), (2,)]


def test_methods_and_ocr(spark, tmp_path):
    rec = spark.createDataFrame([("/a", "h1"), ("/b", None), ("/c", "H1")], "path string, sha256 string")
    log = spark.createDataFrame(
        [("1", "index.search", '{"query":"x","mode":"lexical"}', ["/"]), ("2", "cli.invoke", '{"argv":["t","--api-key","s"]}', ["/cwd"]), ("3", "cli.invoke", '{"command_line":"plain line"}', None), ("4", "other", None, None)],
        "timestamp string, operation string, args string, inputs array<string>",
    )
    m = package.methods_appendix(rec, log, str(tmp_path / "m.json"))
    assert m["documents"] == 3 and [s["query"] for s in m["searches"]] == ["x"] and [(c["command_line"], c["cwd"]) for c in m["commands"]] == [("t --api-key ***", "/cwd"), ("plain line", None)]
    assert (tmp_path / "m.json").exists()
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "a.PNG").write_bytes(b"x")
    (tmp_path / "p" / "b.txt").write_bytes(b"x")
    got = files.ocr_folder(spark, str(tmp_path / "p"), lambda b: ("read", [90, -1, 70])).collect()
    assert [(r["text"], r["native"], r["conf"]) for r in got] == [("read", False, 0.8)]


def test_image_and_document_details(tmp_path):
    tiff = b"II*\0" + (8).to_bytes(4, "little") + (2).to_bytes(2, "little") + b"\x00\x01\x03\0\x01\0\0\0\x07\0\0\0" + b"\x01\x01\x04\0\x01\0\0\0\x09\0\0\0"
    assert files.image_size(tiff) == ("TIFF", 7, 9)
    with zipfile.ZipFile(tmp_path / "d.docx", "w") as z:
        z.writestr("docProps/core.xml", '<c xmlns:dc="u"><dc:Title>T</dc:Title><dc:creator/></c>')
    assert files.docx_properties((tmp_path / "d.docx").read_bytes()) == {"title": "T"}
    with pytest.raises(FileNotFoundError):
        files.discover_one(None, str(tmp_path / "none"))


@pytest.mark.parametrize("bad", [{"query": " "}, {"threshold": 1.2}, {"effort": "max"}, {"stage": 4}])
def test_inputs_are_checked(bad):
    with pytest.raises(ValueError):
        package.check_inputs(**bad)


def test_profiles(tmp_path):
    assert package.load_profile(str(tmp_path / "none")) == {}
    (tmp_path / "p.json").write_text('{"pii": {"enabled": true}}')
    assert package.load_profile(str(tmp_path / "p.json")) == {"pii": {"enabled": True}}
    assert review.enabled_entities(["EMAIL", "X"], ["EMAIL", "SSN"]) == ["EMAIL"] and review.enabled_entities([], ["SSN"]) == ["SSN"]


def test_unknown_load_file(spark):
    with pytest.raises(NotImplementedError):
        produce.load_file(spark.range(1), "lfp")


def test_query_terms():
    assert t.query_terms('body:"smoking gun" AND NOT (custodian:doe OR a) priv*') == ["smoking", "gun", "doe", "priv"]
