"""The training-data operators on small fixtures: brute force, round trips, and the odd cases."""

from __future__ import annotations

import itertools
import random
import re
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from casework import shared
from casework.llm import chunking, common, email_text, keyword_spam, leakage, mixing, name_variants, near_dup, neighbours, personal_data, scan_noise

WORDS = "the quick brown fox jumps over a lazy dog while seven old wizards brew bitter coffee near their quiet river".split()
MESS = "text long, {key} string, path string, note string"


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols or df.columns) for r in df.collect())


# near duplicates


def brute_pairs(docs, n, t):
    sets = {}
    for i, x in docs:
        w = common.words(x)
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
    return sorted(
        (a, b) for a, b in itertools.combinations(sorted(sets), 2) if sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= t - 1e-12
    )


def edited(rng, base):
    w = list(base)
    for _ in range(rng.randrange(4)):
        k = rng.randrange(len(w))
        w[k : k + rng.randrange(2)] = [rng.choice(WORDS)]
    return " ".join(w)


@pytest.mark.parametrize(("n", "t"), [(3, 0.6), (5, 0.8), (2, 0.3)])
def test_near_dup_equals_brute_force(spark, n, t):
    rng = random.Random(n)
    bases = [[rng.choice(WORDS) for _ in range(rng.randrange(8, 40))] for _ in range(15)]
    docs = [(f"d{i:03}", edited(rng, rng.choice(bases))) for i in range(120)]
    docs += [("e1", ""), ("e2", "one two"), ("e3", None), docs[0], ("e4", docs[0][1])]
    df = spark.createDataFrame([(i, x, 1, "p") for i, x in docs], "id string, text string, tokens long, set_id string")
    got = near_dup.NearDuplicates(df, key="id", shingle=n, threshold=t)
    assert rows(got.pairs()) == brute_pairs([(i, x) for i, x in docs if x], n, t)
    parent = {i: i for i, x in docs if x}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    pairs = brute_pairs([(i, x) for i, x in docs if x], n, t)
    for a, b in pairs:
        parent[root(a)] = root(b)
    classes = {r["id"]: r["class_id"] for r in got.classes().collect()}
    for a, b in itertools.combinations(sorted(classes), 2):
        assert (classes[a] == classes[b]) == (root(a) == root(b))


def test_near_dup_one_text_many_times(spark):
    """A third of all rows are edits of one text: the groups are split, no link is lost."""
    rng = random.Random(1)
    base = [rng.choice(WORDS) + str(k % 7) for k in range(60)]
    docs = [(f"h{i:03}", edited(rng, base)) for i in range(150)] + [(f"x{i:03}", " ".join(rng.choice(WORDS) + str(rng.randrange(99)) for _ in range(30))) for i in range(50)]
    df = spark.createDataFrame(docs, "id string, text string")
    assert rows(near_dup.NearDuplicates(df, key="id", shingle=3, threshold=0.6).pairs()) == brute_pairs(docs, 3, 0.6)


@pytest.mark.parametrize("part", [150, 1 << 24])
def test_near_dup_parts_of_the_matrix(spark, monkeypatch, part):
    """With more parts than the tokens asked of two prefixes, and with few, no pair is lost."""
    rng = random.Random(5)
    bases = [[rng.choice(WORDS) + str(rng.randrange(5)) for _ in range(rng.randrange(6, 90))] for _ in range(20)]
    docs = [(f"d{i:03}", edited(rng, rng.choice(bases))) for i in range(150)]
    docs += [(docs[0][0], docs[1][1]), ("copy", docs[2][1]), docs[3]]
    monkeypatch.setattr(near_dup, "PART", part)
    got = near_dup.NearDuplicates(spark.createDataFrame(docs, "id string, text string"), key="id", shingle=3, threshold=0.6)
    sets = [(i, set(common.shingles(x, 3).tolist())) for i, x in docs]
    want = {tuple(sorted((a, b))) for (a, x), (b, y) in itertools.combinations(sets, 2) if a != b and len(x & y) / len(x | y) >= 0.6}
    assert set(rows(got.pairs())) == want


def test_near_dup_leaves_less_than_the_texts(spark):
    """No table of tokens, nor of texts, is written: they took several times the room of the texts."""
    rng = random.Random(2)
    docs = [(f"d{i:04}", " ".join(f"{rng.getrandbits(28):x}" for _ in range(120))) for i in range(1500)]
    docs += [(f"e{i}", x + " end") for i, (_, x) in enumerate(docs[:200])]
    folder = Path(shared.work_dir(spark).removeprefix("file:"))
    held = lambda: sum(p.stat().st_size for p in folder.rglob("*.parquet") if p.is_file())
    before = held()
    assert near_dup.NearDuplicates(spark.createDataFrame(docs, "id string, text string"), key="id", shingle=3, threshold=0.6).pairs().count() == 200
    assert held() - before < sum(len(x) for _, x in docs) / 2


def test_near_dup_empty(spark):
    nd = near_dup.NearDuplicates(spark.createDataFrame([], "id string, text string"), key="id")
    assert nd.pairs().count() == 0 and nd.classes().count() == 0


def test_connected_long_chain(spark):
    df = spark.createDataFrame([(f"{i:04}", f"{i + 1:04}") for i in range(100)] + [("z1", "z2"), ("q", "q")], "a string, b string")
    got = dict(rows(common.connected(df, "a", "b")))
    assert {got[f"{i:04}"] for i in range(101)} == {"0000"} and got["z2"] == "z1" and "q" not in got


# nearest vectors


def clustered(n, dim=16, seed=0):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(max(2, n // 20), dim))
    x = np.vstack((c[rng.integers(len(c), size=n - n // 10)] + 0.35 * rng.normal(size=(n - n // 10, dim)), rng.normal(size=(n // 10, dim))))
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


@pytest.mark.parametrize(("floor", "shard"), [(None, 150), (0.8, 150), (None, 10_000)])
def test_nearest_recall(spark, floor, shard):
    x = clustered(600)
    df = spark.createDataFrame([(f"v{i:04}", v.tolist()) for i, v in enumerate(x)], "id string, vec array<float>")
    got = {(r["id"], r["other"]) for r in neighbours.nearest(df, k=5, floor=floor, shard_size=shard, sample=300).collect()}
    s = x.astype(float) @ x.T.astype(float)
    np.fill_diagonal(s, -2)
    top = np.argsort(-s, 1)[:, :5]
    want = {(f"v{i:04}", f"v{j:04}") for i in range(len(x)) for j in top[i] if floor is None or s[i, j] >= floor}
    assert len(got & want) >= 0.95 * len(want)
    assert floor is None or len(got - want) <= 0.05 * len(want)


@pytest.mark.parametrize("block", [300, 16_000])
def test_nearest_writes_no_routed_vectors(spark, block):
    """Graphs and routed queries are not written, in how many tasks a shard may be searched; they took several times the vectors."""
    x = clustered(3000, dim=96)
    df = spark.createDataFrame([(f"v{i:04}", v.tolist()) for i, v in enumerate(x)], "id string, vec array<float>")
    folder = Path(shared.work_dir(spark).removeprefix("file:"))
    held = lambda: sum(p.stat().st_size for p in folder.rglob("*.parquet") if p.is_file())
    before = held()
    got = {(r["id"], r["other"]) for r in neighbours.nearest(df, k=3, floor=0.8, shard_size=700, sample=500, block=block).collect()}
    assert held() - before < 1.3 * x.nbytes
    s = x.astype(float) @ x.T.astype(float)
    np.fill_diagonal(s, -2)
    want = {(f"v{i:04}", f"v{j:04}") for i in range(len(x)) for j in np.argsort(-s[i])[:3] if s[i, j] >= 0.8}
    assert len(got & want) >= 0.95 * len(want)


@pytest.mark.parametrize("most", [0, 200_000])
def test_repeated_identifiers_broadcast_or_not(spark, monkeypatch, most):
    """The vector of the least batch counts, however many identifiers are repeated."""
    monkeypatch.setattr(neighbours, "AGAIN", most)
    data = [(2, ["a", "b"], [[0.0, 2.0], [3.0, 0.0]]), (1, ["a", "c"], [[5.0, 0.0], [0.0, 1.0]]), (1, ["a", "c"], [[5.0, 0.0], [0.0, 1.0]])]
    df = spark.createDataFrame(data, "batch_id long, identifiers array<string>, embeddings array<array<float>>")
    assert rows(neighbours.vectors(df, dim=2)) == [("a", [1.0, 0.0]), ("b", [1.0, 0.0]), ("c", [0.0, 1.0])]


def test_graph_blob_round_trip():
    import pandas as pd

    x = clustered(300)
    cen = neighbours.leaders(x, 64)
    cell = (x @ cen.T).argmax(1)
    pdf = pd.DataFrame({"id": [f"{i:03}" for i in range(300)], "vec": list(x), "cell": cell, "shard": 0, "part": 0})
    g = neighbours._load(neighbours._store(pdf, cen).iloc[0], cen)
    i, s = g.search(x[:50], 1, 64)
    assert (i[:, 0] == np.arange(50)).mean() > 0.97 and s.shape == (50, 1)


def test_vectors_dirt(spark):
    z = [0.0] * 4
    data = [
        (1, ["a", "b", "c", "d", "e"], [[1.0, 0.0, 0.0, 0.0], z, None, [1.0, 2.0], [float("nan"), 1.0, 1.0, 1.0]]),
        (1, ["a", "b", "c", "d", "e"], [[1.0, 0.0, 0.0, 0.0], z, None, [1.0, 2.0], [float("nan"), 1.0, 1.0, 1.0]]),
        (2, ["a", "f", None], [[0.0, 1.0, 0.0, 0.0], [0.0, 3.0, 0.0, 4.0], [1.0, 1.0, 1.0, 1.0]]),
        (3, None, None),
    ]
    df = spark.createDataFrame(data, "batch_id long, identifiers array<string>, embeddings array<array<float>>")
    got = {r["id"]: list(r["vec"]) for r in neighbours.vectors(df, dim=4).collect()}
    assert set(got) == {"a", "f"} and got["a"] == [1, 0, 0, 0] and got["f"] == pytest.approx([0, 0.6, 0, 0.8])
    assert neighbours.nearest(neighbours.vectors(df.limit(0), dim=4)).count() == 0


# scans


SCAN = "Deposition of the clerk, volume 3\nThe parties agree that the vendor invoice was catalogued with long-\nstanding care by the re-\ncords custodian. The supplier sent the\n\n- 2 -\n\nDeposition of the clerk, volume 3\nvend0r invoice to thc office and the clerk\nsigned.\n\nSection 7\nThe clerk agreed.\n\nRXL-1234567\n\npage 3\n"
CLEAN = " ".join(["The parties agree that the vendor invoice was catalogued with long-standing care by the records custodian of the office."] * 30)


def scans(spark, payloads):
    p = spark.createDataFrame([(*x, "m") for x in payloads], "path string, text string, word string")
    g = spark.createDataFrame([(path, 0, path.startswith("s")) for path, _ in payloads if path], "path string, page int, needs_ocr boolean")
    return scan_noise.Scans(p, g)


def test_scan_marks_and_text(spark):
    files = [(f"s{k}", SCAN.replace("volume 3", f"volume {k}")) for k in range(5)] + [(f"c{k}", CLEAN) for k in range(3)]
    s = scans(spark, files + [files[0], ("n", None), (None, "x"), ("s-empty", ""), ("s-long", "a" * 60_000)])
    got = {(r["line_no"], r["kind"]) for r in s.marks().where("path = 's1'").collect()}
    assert {(1, "header"), (6, "page_no"), (8, "header"), (15, "header"), (17, "page_no"), (3, "hyphen")} <= got
    assert (2, "hyphen") not in got and (9, "misread") in got and not any(n == 12 for n, _ in got)
    text = {r["path"]: r["text"] for r in s.text().collect()}
    assert "records custodian. The supplier sent the vendor invoice to the office" in text["s1"] and "Deposition" not in text["s1"] and "long-standing" in text["s1"]


def test_scan_lines_are_marked_once(spark, monkeypatch):
    """What a text alone tells of its lines travels with it: the last pass does not look for furniture again."""
    page = "Ledger of Deeds\n\nThe clerk wrote that the river had risen over the\n{}\nstone bridge and that nobody was able to cross it."
    docs = [(f"f{i}", page.format(f"Northern Assize   {i + 1}") + f"\n\nPage {i + 2}") for i in range(6)]
    made = scan_noise.Scans(spark.createDataFrame(docs, "path string, text string"), spark.createDataFrame([(p, True) for p, _ in docs], "path string, needs_ocr boolean"))
    assert {"own", "codes"} <= set(made.work.columns)
    got = {(r["path"], r["line_no"], r["kind"]) for r in made.marks().collect()}
    want = set()
    for r in made.work.collect():
        told = scan_noise._told(r["known"])[2]
        for i, k in enumerate(made.repair.value.furniture(scan_noise.lines_of(r["text"]), told)):
            want |= {(r["path"], i + 1, k)} if k else set()
    assert want and want == {x for x in got if x[2] in ("header", "page_no")} and {("f0", 4, "header"), ("f0", 7, "page_no")} <= want


def test_scan_empty(spark):
    assert scans(spark, [("c", "x")]).marks().count() == 0
    e = spark.createDataFrame([], "path string, text string")
    assert scan_noise.Scans(e, spark.createDataFrame([], "path string, needs_ocr boolean")).text().count() == 0


def test_scan_vectors_use_all_places(spark):
    text = " ".join(["the vendor sent the invoice to the clerk"] * 40)
    files = [(f"s{k}", text) for k in range(3)] + [("s-short", "the clerk signed")]
    s = scans(spark, files)
    n = {}
    for _, t in files:
        w = t.split()
        for i, x in enumerate(w):
            for y in w[max(0, i - 4) : i] + w[i + 1 : i + 5]:
                n[x, y] = n.get((x, y), 0) + 1
    index = {w: i for i, w in enumerate(sorted({"the", "vendor", "sent", "invoice", "to", "clerk"}))}
    others = spark.createDataFrame([("signed",), ("absent",)], "word string")
    v = scan_noise.Vectors(s.files, index, 32, others)
    got = {(r["word"], c): k for r in v.rows.collect() for c, k in zip(r["c"], r["n"])}
    assert got == {(x, index[y]): k for (x, y), k in n.items() if y in index and (x in index or x == "signed")}
    assert set(s.vectors.top) == set(index) and all(len(x) == 32 for x in s.vectors.top.values())
    # the same vectors however the rows are dealt to tasks
    again = scan_noise.Vectors(s.files.repartition(5), index, 32, others)
    assert all((again.top[w] == v.top[w]).all() for w in index)
    other = v.of(others).collect()
    assert [r["word"] for r in other] == ["signed"] and abs(sum(x * x for x in other[0]["vec"]) - 1) < 1e-6


def test_scan_hyphen_across_much_furniture(spark):
    head = "\n".join(["ORION CASE FILE", "Volume Two", "Exhibit Room", "Sealed Copy", "Held Apart", "Page 12", "Vendor Papers"])
    text = f"the clerk sent the in-\n{head}\nvoice to the office. The clerk may\n{head}\nsend the vendor the bill."
    files = [(f"s{k}", text) for k in range(6)] + [("c0", "the clerk sent the invoice to the office. " * 9)]
    got = scans(spark, files).marks().where("kind = 'hyphen' and line_no = 1").count()
    assert got == 6


def test_scan_word_with_clean_places(spark):
    body = "\n".join(["the clerk supports the claim of the vendor raised by the office", "please hold the device until the manager agrees to it"] * 10)
    bad = "the clerk supports the daim of the vendor raised by the office"
    files = [(f"s{k}", body + "\n" + bad + "\nplease hold Daim 788 until the manager agrees") for k in range(4)]
    clean = [(f"c{k}", body) for k in range(4)]
    # another case: the lower-case word is repaired, the name is not
    got = scans(spark, files + clean + [("c-odd", "please hold Daim 788 until the manager agrees")])
    assert {(r["path"], r["line_no"]) for r in got.marks().where("kind = 'misread'").collect()} == {(f"s{k}", 21) for k in range(4)}
    # one clean place against the rate of 'claim': still a candidate, for the context to decide
    known = scans(spark, files + clean + [("c-odd", "daim")]).work.where("path = 's1'").first()["known"]
    assert [(x[0], x[2]) for x in scan_noise._told(known)[0]["daim"]] == [("claim", False)]


def test_scan_context_decides():
    v = {"claim": np.array([1.0, 0.0]), "raised": np.array([0.9, 0.1]), "device": np.array([-0.5, 0.8])}
    rep = scan_noise.Repair(scan_noise.Skeletons(frozenset()), set(), v, np.array([0.3, 0.3]))
    assert rep.accepts("daim", [("claim", 80, False)], ["raised"]) == "claim"
    assert rep.accepts("daim", [("claim", 80, False)], ["device"]) is None and rep.accepts("daim", [("claim", 80, False)], []) is None
    assert rep.accepts("daim", [("claim", 80, True)], ["device"]) == "claim"


@pytest.mark.parametrize(("a", "b"), [("vendor", "veridor"), ("clerk", "c1erk"), ("modern", "modem"), ("draft", "clraft"), ("file", "ﬁle"), ("seal", "se@l"), ("was", "vvas"), ("could", "coiild")])
def test_glyph_key(a, b):
    assert scan_noise.glyph_key(a) == scan_noise.glyph_key(b)


# chunks


@pytest.mark.parametrize("seed", range(5))
def test_chunks_round_trip(seed):
    rng = random.Random(seed)
    text = "".join(rng.choice([w + " " for w in WORDS] + [". ", ".\n", "\n\n", ", ", "x" * rng.randrange(1, 90)]) for _ in range(300))
    most, over = rng.choice([(50, 0), (60, 20), (200, 50), (30, 29), (10, 40)])
    p = chunking.pieces(text, most, over)
    assert p[0][0] == 0 and p[-1][1] == len(text) and all(a[1] == b[0] for a, b in itertools.pairwise(p))
    assert "".join(text[a:b] for a, b, _ in p) == text
    o = max(0, min(over, most - 1))
    assert all(b - a + v <= most and b > a for a, b, v in p) and all(v == min(o, a) for a, _, v in p)


def test_chunks_prefer_paragraphs():
    text = "A sentence here. Another one.\n\nThe second paragraph is here. It ends."
    assert [text[a:b] for a, b, _ in chunking.pieces(text, 45, 0)] == [text[:31], text[31:]]


def test_chunk_dirt(spark):
    docs = [("a", "x" * 100, "pdf"), ("a", "x" * 100, "pdf"), ("b", "", None), ("c", None, "pdf"), (None, "x", "pdf"), ("d", "y " * 30, None), ("e", "z" * 40, "new")]
    df = spark.createDataFrame([(*x, 1, "z") for x in docs], "identifier string, text string, doctype string, piece_no int, max_chars string")
    lim = spark.createDataFrame([("pdf", 30, 5), ("other", 20, None), ("pdf", 40, 5), (None, 1, 1), ("odd", 0, 0)], "doctype string, max_chars int, overlap_chars int")
    got = chunking.chunk(df, lim).collect()
    n = {k: sum(r["identifier"] == k for r in got) for k in "abcde"}
    assert n == {"a": 4, "b": 1, "c": 0, "d": 4, "e": 2}
    assert chunking.chunk(df, lim.limit(0)).count() == 4 and chunking.chunk(df.limit(0), lim).count() == 0


# names


@pytest.mark.parametrize("seed", range(3))
def test_trie_equals_distance(seed):
    rng = random.Random(seed)
    toks = sorted({"".join(rng.choice("abc") for _ in range(rng.randrange(1, 6))) for _ in range(80)})

    def dist(a, b):
        d = np.add.outer(np.arange(len(a) + 1), np.arange(len(b) + 1))
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
        return int(d[-1, -1])

    trie = name_variants.Trie(toks)
    for q in toks[:30]:
        assert trie.within_one(q) == {t: dist(q, t) for t in toks if dist(q, t) <= 1}


def test_shards_meet():
    """Names one edit apart share a shard."""
    rng = random.Random(2)
    for _ in range(2000):
        t = "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(5, 14)))
        k = rng.randrange(len(t) - 1)
        u = rng.choice([t[:k] + t[k + 1 :], t[:k] + "z" + t[k:], t[:k] + "z" + t[k + 1 :], t[:k] + t[k + 1] + t[k] + t[k + 2 :]])
        assert set(name_variants._keys(t)) & set(name_variants._keys(u)), (t, u)


def test_short_shards_meet():
    """All pairs of up to five letters that are one edit apart share a shard."""
    every = ["".join(x) for n in range(1, 6) for x in itertools.product("abc", repeat=n)]
    trie, keys = name_variants.Trie(every), {t: set(name_variants._keys(t)) for t in every}
    assert not [(t, o) for t in every for o in trie.within_one(t) if not keys[t] & keys[o]]
    for a, b in (("lee", "lie"), ("abcd", "acbd"), ("ab", "ba")):
        assert set(name_variants._keys(a)) & set(name_variants._keys(b))


def test_names_linked(spark):
    same = ["Robert Kranpikakin", "Kranpikakin, Robert", "bob_kranpikakin", "R. Kranpikakin", "KRANPIKAKIN ROBERT", "Robert B. Kranpikaikn", "kranpikakinr", "Kranpikakin, Robert (IP group)", '"Kranpikakin, Robert" <r@x.test>']
    other = ["Ines Kranpikakin", "Valtakerin, Ines", "Robert Valtakerin"]
    firm = ["Garko & Nalni LLP", "Law Offices of Garko & Nalni", "GARKO NALNI LLP", "Garko, Nalni & Assoc."]
    junk = ["", None, "N/A", "(none)", "Unknown", "Distribution List - All Site Staff", " "]
    df = spark.createDataFrame([(x, 1) for x in same + other + firm + junk + same], "who string, entity int")
    got = dict(rows(name_variants.link_names(df)))
    assert len({got[x] for x in same}) == 1 and len({got[x] for x in firm}) == 1
    assert len({got[x] for x in [same[0], firm[0], *other]}) == 5 and not set(junk) & set(got)
    assert name_variants.link_names(df.limit(0)).count() == 0


# emails


MAIL = "Hello Bob,\nPlease see the draft.\nOn Monday the clerk wrote: see the annex. So I did.\n\nBest regards,\nAnn\nAnn Example\nDirector\nT: 555-0100\n\nCONFIDENTIALITY NOTICE: This is private.\nIf you received it, delete it.\n\n-----Original Message-----\nFrom: Bob B\nSent: 1/2/2020\nTo: Ann\n\nHi Ann,\nCall me.\n"


def test_email_labels():
    k = email_text.label(MAIL)
    assert [i + 1 for i, x in enumerate(k) if x == "new"] == [1, 2, 3, 5, 6]
    assert {k[6], k[7], k[8]} == {"signature"} and k[10] == k[11] == "notice" and set(k[13:17]) == {"quote"}


def test_interleaved_answers_are_new():
    k = email_text.label("On Jan 1, 2020 at 10:00, Bob <b@x.test> wrote:\n> one\nMy answer.\n> two\n\nThanks,\nAnn\n-- \nAnn Example\n")
    assert [i + 1 for i, x in enumerate(k) if x == "new"] == [3, 6, 7]


@pytest.mark.parametrize("seed", range(3))
def test_automaton_equals_brute_force(seed):
    rng = random.Random(seed)
    msgs = [[rng.randrange(3) for _ in range(rng.randrange(0, 40))] for _ in range(6)]
    a = email_text.Automaton()
    for i in rng.sample(range(6), 6):
        a.add(msgs[i], i)
    for i, m in enumerate(msgs):
        want = np.zeros(len(m), bool)
        for s in range(len(m) - 4):
            w = m[s : s + 5]
            if any(w == x[k : k + 5] for x in msgs[:i] for k in range(len(x) - 4)):
                want[s : s + 5] = True
        assert (a.inherited(m, i, 5) == want).all()


def test_unmarked_quotation_is_inherited(spark, monkeypatch):
    monkeypatch.setattr(email_text, "BLOCK", 4)
    old = "\n".join(f"The {w} auditor asked about item {i} of the shipping ledger in the annex." for i, w in enumerate(WORDS[:6]))
    meta = '{"family_id": "F1", "sent": "2020-01-%02dT00:00:00"}'
    data = [("a/1.eml", old, meta % 1), ("a/2.MSG", "I agree with this.\n" + old.replace("ledger in", "ledger\nin"), meta % 2)]
    data += [(f"a/{k}.eml", f"Short note {k} about lunch.", meta % k) for k in range(3, 15)] + [("a/x.eml", None, None), ("a/y.eml", "", "{}"), ("a/z.pdf", old, meta % 5), ("a/q.eml", "Hi Bob,", "broken")]
    df = spark.createDataFrame([(*x, 1) for x in data + data[:1]], "path string, text string, metadata string, block int")
    got = email_text.labelled(df)
    assert got.where("path = 'a/1.eml' and label <> 'new'").count() == 0
    two = {r["line_no"]: r["label"] for r in got.where("path = 'a/2.MSG'").collect()}
    assert two[1] == "new" and list(two.values()).count("quote") >= 6
    # every line of the rewrapped history, also those that end inside a sentence
    assert [n for n, k in sorted(two.items()) if k == "new"] == [1]
    assert got.where("path in ('a/z.pdf', 'a/x.eml', 'a/y.eml')").count() == 0 and email_text.labelled(df.limit(0)).count() == 0
    # a mail without a family that holds the same words joins the thread; without the automaton all of it would be new
    alone = spark.createDataFrame(data[:1] + [("a/n.eml", "So do I.\n" + old.replace("auditor asked", "auditor\nasked"), '{"sent": "2020-02-01T00:00:00"}')], "path string, text string, metadata string")
    seen = {r["line_no"]: r["label"] for r in email_text.labelled(alone).where("path = 'a/n.eml'").collect()}
    assert [n for n, k in sorted(seen.items()) if k == "new"] == [1]
    assert set(email_text.label(data[1][1])) == {"new"}
    # the lexicon of endings gives the same lines broadcast and joined
    ended = [(f"e/{k}.eml", f"Note {k} is done.\n\nThanks,\nAnn\nAnn Example\nHead of Freight\n", "{}") for k in range(5)] + [("e/9.eml", "Note 9 is done.\n\nHead of Freight\n", "{}")]
    ed = spark.createDataFrame(ended, "path string, text string, metadata string")
    assert rows(email_text.labelled(ed)) == rows(email_text.labelled(ed, broadcast=0))


def test_history_leaves_greeting_in_front():
    said = [f"word{i}" for i in range(30)]
    lines = ["Thanks,", "Ann", " ".join(said[:15]), " ".join(said[15:]), "So I did it."]
    flags = np.array([True] * 32 + [False] * 4)
    assert email_text.label("\n".join(lines), flags)[:2] == ["new", "new"]
    assert email_text.label("\n".join(lines), flags)[2:] == ["quote", "quote", "new"]
    assert set(email_text.label("\n".join(lines), np.array([True] * 20 + [False] * 16))) == {"new"}


# personal data


def test_personal_data(spark):
    line = "Please call Robert Kranpikakin at (425) 555-0167 or mail bob@x.test, SSN 123-45-6789, residing at 12 Oak Street, Apt 3, Wion, FL 15245. Tracking 9400 16604 555833 and Control number 8427-22-5803 stay."
    fill = [(f"f{i}", f"Ms. Ines Kransulek{c}in met Edward Valturegan at {i} Pine Road, Voux, TX 77001. Tel. (212) 555-01{i:02} and id {i}.") for i, c in enumerate("abcdefghij" * 4)]
    df = spark.createDataFrame([("p", line, 1), ("e", "", 1), ("n", None, 1), (None, "x", 1), ("p", line, 1)] + [(*x, 1) for x in fill], "path string, text string, entity int")
    got = {(r["entity"], r["text"]) for r in personal_data.find(df).where("path = 'p'").collect()}
    want = {("NAME", "Robert Kranpikakin"), ("PHONE", "425) 555-0167"), ("EMAIL", "bob@x.test"), ("ID", "123-45-6789"), ("ADDRESS", "12 Oak Street, Apt 3, Wion, FL 15245")}
    assert got == want
    text = {r["path"]: r["text"] for r in personal_data.redact(df).collect()}["p"]
    assert text == "Please call [NAME] at ([PHONE] or mail [EMAIL], SSN [ID], residing at [ADDRESS]. Tracking 9400 16604 555833 and Control number 8427-22-5803 stay."
    assert personal_data.find(df.limit(0)).count() == 0


def test_spans_do_not_overlap():
    d = personal_data.Detector({}, None, {})
    s = d.spans("a@b.test " * 50 + "x" * 20_000 + " (212) 555-0100")
    assert len(s) == 51 and all(a[2] <= b[1] for a, b in itertools.pairwise(s))


def test_boosting_learns():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 5))
    y = ((x[:, 0] > 0) & (x[:, 1] > 0.3)).astype(float)
    m = personal_data.Boosted(rounds=30).fit(x[:1500], y[:1500]).calibrate(x[1500:1750], y[1500:1750])
    assert ((m.prob(x[1750:]) > 0.5) == y[1750:]).mean() > 0.96


# leaks


def brute_longest(a, b):
    best, prev = 0, [0] * (len(b) + 1)
    for x in a:
        cur = [0] * (len(b) + 1)
        for j, y in enumerate(b):
            if x == y:
                cur[j + 1] = prev[j] + 1
                best = max(best, cur[j + 1])
        prev = cur
    return best


@pytest.mark.parametrize("limit", [2_000_000, 0])
def test_leaks_equal_brute_force(spark, limit):
    rng = random.Random(4)
    items = [(i, " ".join(rng.choice(WORDS) for _ in range(30))) for i in range(8)]
    docs = []
    for d in range(40):
        w = [rng.choice(WORDS) for _ in range(rng.randrange(0, 60))]
        if d % 2:
            x, k = rng.choice(items)[1].split(), rng.randrange(10, 18)
            a = rng.randrange(30 - k)
            at = rng.randrange(len(w) + 1)
            w[at:at] = x[a : a + k]
        docs.append((d, ", ".join(w).upper()))
    docs += [(90, None), (91, ""), (None, "x"), docs[1]]
    df = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, item_id long")
    it = spark.createDataFrame([(*x, 1) for x in items] + [(None, "x", 1), (50, None, 1)], "item_id long, text string, doc_id long")
    got = {(r["doc_id"], r["item_id"]): r["longest"] for r in leakage.leaks(df, it, broadcast_seeds=limit).collect()}
    want = {}
    for d, t in docs:
        for i, s in items:
            if d is not None and t and (n := brute_longest(common.words(t), common.words(s))) >= 13:
                want[(d, i)] = n
    assert got == want and want
    assert leakage.leaks(df.limit(0), it).count() == 0 and leakage.leaks(df, it.limit(0)).count() == 0


def test_tiles_add_up_reordered():
    a = common.word_hashes([f"w{i}" for i in range(40)])
    b = np.concatenate((a[20:], a[:20]))
    t = leakage.tiles(b, a, 13)
    assert sorted(x[2] for x in t) == [20, 20]


# mixing


def test_mix(spark):
    docs = [(i, "word " * (5 + i % 7), s, 0) for s, k in (("a", 300), ("b", 60), ("c", 5), ("d", 40)) for i in range(1000 * ord(s), 1000 * ord(s) + k)]
    docs += [docs[0], (1, None, "a", 0), (2, "", "a", 0), (None, "x", "a", 0), (3, "x", None, 0)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, tokens int")
    t = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.1, 6), ("none", 0.1, 2), ("bad", None, 1)], "source string, target_share double, max_repeats int")
    m = common.cut(mixing.mix(df, t))
    s = {r["source"]: r for r in mixing.shares(m, t).collect()}
    assert s["none"]["tokens"] == 0 and "d" not in {r["source"] for r in m.select("source").collect()}
    for k, w in (("a", 0.5), ("b", 0.3), ("c", 0.1)):
        assert s[k]["actual_share"] == pytest.approx(w / 0.9, abs=0.03) and s[k]["most_copies"] <= {"a": 1, "b": 2, "c": 6}[k]
    assert m.groupBy("doc_id").count().where("count > 1").count() == 0
    assert rows(mixing.mix(df, t)) == rows(m)
    assert mixing.mix(df.limit(0), t).count() == 0 and mixing.mix(df, t.limit(0)).count() == 0


# spam


def test_spam(spark):
    prose = "The witness recalled the shipment only after the second review of the ledger. Nobody could say who had signed the retention policy in the office."
    listing = "\n".join(f"Box {i * 37}; Firm{i} Labs; {i * 91} pages; unsigned" for i in range(3, 15))
    kw = ", ".join(f"cheap toner rental {c}ville" for c in "ABCDEFGHIJKLMN")
    links = "\n".join(f"best toner kit https://x{i}.example/{i}" for i in range(20))
    tags = " ".join(f"#TonerKit{i % 4}" for i in range(40))
    docs = [(1, prose), (2, listing), (3, kw), (4, links), (5, tags), (6, None), (7, ""), (8, prose + "\n" + kw), (9, " ".join([prose] * 4) + "\n" + kw), (10, "!!! ..."), (11, "a" * 50_000)]
    docs += [(100 + i, prose.replace("witness", f"witness{i}") + "\n" + listing) for i in range(10)]
    df = spark.createDataFrame([(*x, "s") for x in docs + docs[:1]], "doc_id long, text string, share string")
    got = {r["doc_id"]: r["share"] for r in keyword_spam.spam_share(df).collect()}
    assert {k for k, v in got.items() if v > 0.5} == {3, 4, 5, 8} and got[6] == got[7] == got[10] == 0 and len(got) == len({d for d, _ in docs})
    assert keyword_spam.spam_share(df.limit(0)).count() == 0


def test_word_is_letters_or_digits():
    assert common.words("Don't_stop É1 — x²") == re.findall(r"[^\W_]+", "don't_stop é1 — x²") and common.words(None) == []


def test_rolling_matches_direct():
    h = common.word_hashes(WORDS)
    r = common.rolling(h, 4)
    assert len(r) == len(h) - 3 and (common.rolling(h[3:9], 4) == r[3:6]).all() and len(common.rolling(h[:2], 4)) == 0


def test_nothing_else_imports_the_package():
    from pathlib import Path

    root = Path(common.__file__).resolve().parent.parent
    for p in root.rglob("*.py"):
        if p.parent.name != "llm":
            assert "casework.llm" not in p.read_text() and "import llm" not in p.read_text(), p


def test_frames_ignore_clashing_columns(spark):
    df = spark.createDataFrame([(1, "one two three four five six", "x", 2)], "doc_id long, text string, n_words string, bad long")
    assert keyword_spam.spam_share(df).columns == ["doc_id", "n_words", "spam_words", "share"]
    assert df.select(F.col("text")).count() == 1


@pytest.mark.parametrize(
    ("text", "name"),
    [
        ("We met David Johnson today.", "David Johnson"), ("Ask Maria Fernandez about it.", "Maria Fernandez"), ("Then Mohammed Al-Sayed left.", "Mohammed Al-Sayed"),
        ("I wrote to Susan Whitaker.", "Susan Whitaker"), ("It was Jennifer Okafor who called.", "Jennifer Okafor"), ("Nguyen, Linh signed.", "Nguyen, Linh"),
        ("Zyx Q. Robertson signed.", "Q. Robertson"), ("He saw Vashti de Montfort there.", "Vashti de Montfort"),
    ],
)
def test_name_candidates_by_shape(text, name):
    assert name in {text[a:b] for k, a, b, _, _ in personal_data.candidates(text, {}) if k == "NAME"}


def test_given_names_are_learned(spark):
    families = ["Robinson", "Peterson", "Anderson", "Harrison", "Jackson"]
    usual = [f"I met {g} {f} there." for g in ("Robert", "Thomas", "Susan") for f in families]
    new = [f"I met Vashti {f} there." for f in families] + ["The Annex Cabinet stood in the Outer Office of the Second Tower."] * 3
    df = spark.createDataFrame([(x,) for x in usual + new], "text string")
    endings, given, firsts = personal_data.learn(df)
    share = {r["k"]: r["v"] for r in firsts.collect()}
    assert share[personal_data._key("vashti")] == 1.0
    assert endings["son"] > 0.5 and "vashti" in given and "annex" not in given and "outer" not in given
    assert personal_data.learn(df.limit(0))[:2] == ({}, personal_data.GIVEN)


def test_uncertain_candidates_are_left_out_without_a_model():
    d = personal_data.Detector({}, None, {})
    assert d.spans("call Annex Cabinet 12") == []


def test_spam_lexicon_joined_or_broadcast(spark):
    docs = [(k, "cheap toner ink cheap toner ink cheap toner ink cheap toner ink.\nThe clerk sent the letter to the office on Monday.") for k in range(8)]
    docs += [(20, "toner ink kit"), (21, None), (22, ""), (20, "toner ink kit"), (23, "\n".join(["toner"] * 20)), (24, "\n".join(f"Exhibit {i}" for i in range(20)))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    a = rows(keyword_spam.spam_share(df))
    assert a == rows(keyword_spam.spam_share(df, broadcast_words=0))
    share = {r[0]: r[3] for r in a}
    assert share[20] == 1.0 and share[21] == share[22] == 0 and share[23] == 1.0 and share[24] == 0


def test_spam_keywords_one_to_a_line(spark):
    df = spark.createDataFrame([(1, "\n\n".join(["alpha", "beta"] * 10)), (2, "\n".join(WORDS))], "doc_id long, text string")
    assert {r["doc_id"]: r["share"] for r in keyword_spam.spam_share(df).collect()} == {1: 1.0, 2: 0.0}


def test_name_shards_are_split(spark, monkeypatch):
    rng = random.Random(3)
    toks = sorted({"mac" + "".join(rng.choice("abc") for _ in range(rng.randrange(1, 6))) for _ in range(150)} | {"a", "ab", "lee", "lie"})
    df = spark.createDataFrame([(x, True) for x in toks], "token string, indexed boolean")
    want = rows(name_variants.trie_join(df))
    trie = name_variants.Trie(toks)
    assert want == sorted((x, o, d) for x in toks for o, d in trie.within_one(x).items())
    monkeypatch.setattr(name_variants, "PART", 7)
    monkeypatch.setattr(name_variants, "ASKING", 9)
    assert rows(name_variants.trie_join(df)) == want


def test_mixture_does_not_depend_on_ranges(spark):
    docs = spark.createDataFrame([(k, "word " * (1 + k % 7), "s" if k % 3 else "t") for k in range(90)] + [(5, "another text", "s")], "doc_id long, text string, source string")
    targets = spark.createDataFrame([("s", 0.7, 2), ("t", 0.3, 2)], "source string, target_share double, max_repeats int")
    a = rows(mixing.mix(docs, targets, total_tokens=200))
    assert a and a == rows(mixing.mix(docs, targets, total_tokens=200, bucket_rows=1)) and len({r[0] for r in a}) == len(a)


def test_loose_vectors_are_found(spark):
    rng = np.random.default_rng(2)
    c = rng.normal(size=(60, 16))
    x = np.repeat(c, 6, 0) + rng.normal(size=(360, 16)) * 0.2
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(f"v{i:03}", [float(z) for z in v]) for i, v in enumerate(x)], "id string, vec array<float>")
    s = x @ x.T - 3 * np.eye(360)
    want = {(f"v{i:03}", f"v{j:03}") for i in range(360) for j in np.argsort(-s[i])[:3]}
    got = {(r["id"], r["other"]) for r in neighbours.nearest(df, k=3, sample=40, cells=8, shard_size=50, probes=6).collect()}
    assert len(got & want) >= 0.9 * len(want)
