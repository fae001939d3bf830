"""Quoted history and signatures in emails (problem 6).

Method: a generalised suffix automaton per thread holds the words of its messages, each state with the
earliest message that contains its strings.  A message is read through it; runs of at least ``MIN_RUN`` words
that an earlier message holds are inherited, however their lines are wrapped or prefixed.  A stretch of ``LONG_RUN``
inherited words or more is quoted history, marked or not; what no automaton holds (messages that are not in the
collection, introducing lines and headers) is told by the marks of quoting.  From what is left the sender's ending
(device footer, notice, signature) is stripped: lines without a sentence, found at the end, or recurring as endings.

A message without a family joins the family with which it shares most runs that no other family has.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casework.llm.common import WORD, cut, read, rolling, spread, word_hashes

MIN_RUN = 12
LONG_RUN = 24  # inherited words in a row that are quoted without any mark
WINNOW = 8  # of so many neighbouring runs one is a fingerprint
BLOCK = 64  # messages in an automaton

_QUOTE = re.compile(r"^\s*(?:[A-Z]{1,3}>|>|\|(?=\s|$))")
_HEAD = r"From|Sent|Date|To|Cc|Bcc|Subject|Von|Gesendet|Datum|An|Betreff|De|Envoyé|À|Objet|Enviado|Fecha|Para|Asunto|Enviado el|Envoyé le"
_HEADER = re.compile(rf"^\s*\*?({_HEAD})\s?:\*?(\s|$)", re.I)
_FROM = re.compile(r"^\s*\*?(From|Von|De|Expéditeur)\s?:\*?\s", re.I)
_ORIGINAL = re.compile(
    r"^\s*[-_*=]{2,}\s*(original message|forwarded message|forwarded by.*|original appointment|ursprüngliche nachricht|"
    r"weitergeleitete nachricht|message d'origine|message original|message transféré|mensaje original|mensaje reenviado)\s*[-_*=]{2,}\s*$|"
    r"^\s*(begin forwarded message|anfang der weitergeleiteten nachricht|début du message (réexpédié|transféré)|inicio del mensaje reenviado)\s*:\s*$",
    re.I,
)
_RULE = re.compile(r"^\s*[-_=]{5,}\s*$")
_WROTE = re.compile(
    r"^\s*((on|at)\b.*\d.*\b(wrote|said)|.*\bwrote on\b.*\d.*|am\b.*\d.*\bschrieb\b.*|le\b.*\d.*\ba écrit|el\b.*\d.*\bescribió)\s*:\s*$|^\s*>{3}\s*\S.*\d.*>{3}\s*$", re.I
)
_WROTE_HEAD = re.compile(r"^\s*(on|at|am|le|el)\b.*\d", re.I)
_BANNER = re.compile(
    r"^\W*(caution\W+(outside|external)|external\b.{0,30}(sender|e?-?mail|message)|\[ext(ernal)?\]|scanned by|this (e-?mail|message) (came|originated) from outside|"
    r"warning\W+(outside|external)|achtung\W+extern|attention\W+(exp[ée]diteur|message) externe|atenci[óo]n\W+remitente externo|"
    r"virus.?(free|checked)|checked by)",
    re.I,
)
_DEVICE = re.compile(
    r"^\W*(sent (from|via|with|on|using) |get (the|my)?.{0,20}\b(mail|app)\b|get outlook|typed on|please excuse (typos|brevity)|"
    r"(von|aus) mein\w+ .{0,30}gesendet|gesendet (von|mit)|envoy[ée] (de|depuis|avec) |enviado (desde|con) )",
    re.I,
)
_NOTICE = re.compile(
    r"^\W*(important: the contents? of this|any tax advice in this|unauthori[sz]ed (review|use|disclosure)|thank you for your cooperation\b|"
    r"(please )?consider (the environment|whether you need to print)|please consider (the environment|whether)|"
    r"registered (office|in .{2,40} under (no|number))|no waiver is intended|"
    r"(confidentiality|privacy|legal|security|important|privileged) (notice|note|warning)|notice( to recipients?)?\s*:|disclaimer|"
    r"note: what is written above|privileged and confidential\b|this (e-?mail|message|communication|mail|transmission)( and any attachments?)? "
    r"(is|are|may|does|do|contains?|and|has|was)\b|the (information|contents?) (in|of|contained in) this (transmission|e-?mail|message|communication|mail)|"
    r"the sender'?s firm|if you (are not|received|have received)\b.{0,60}(recipient|person|error|addressee)|"
    r"diese (e-?mail|nachricht)\b|vertraulichkeitshinweis|der inhalt dieser|ce (message|courriel)\b|le contenu de ce|avis de confidentialit|"
    r"este (mensaje|correo)\b|aviso (legal|de confidencialidad)|el contenido de este)",
    re.I,
)
_CLOSING = re.compile(
    r"^\s*(many thanks|thanks( again| very much| a lot)?|thank you( very much)?|(kind|best|warm|with kind) ?(regards|wishes)?|regards|best|cheers|sincerely( yours)?|"
    r"yours( sincerely| faithfully| truly)?|talk soon|speak soon|respectfully|cordially|all the best|"
    r"viele grüße|mit freundlichen grüßen|freundliche grüße|beste grüße|danke( im voraus)?|vielen dank( im voraus)?|grüße|liebe grüße|"
    r"cordialement|bien cordialement|merci( beaucoup| d['’]avance)?|bien à vous|salutations|sincères salutations|"
    r"gracias|muchas gracias|saludos|un saludo|saludos cordiales|atentamente|cordialmente)\s*[,.!]*\s*$",
    re.I,
)
_GREETING = re.compile(
    r"^\s*((hello|hi|hey|dear|good (morning|afternoon|evening)|hallo|guten (tag|morgen|abend)|liebe[r]?|sehr geehrte[r]?|bonjour|bonsoir|ch[eè]re?|salut|"
    r"hola|estimad[oa]|querid[oa]|buen[oa]s? (d[ií]as|tardes))\b.{0,60}|[^\W\d_][\w'’.-]*( [^\W\d_][\w'’.-]*)?)\s*[,:]\s*$",
    re.I,
)
_CONTACT = re.compile(
    r"^\s*(mailto:\S+|(e|e-?mail)\s*:?\s*\S+@\S+|\S+@\S+\.\S+|www\.\S+|https?://\S+|"
    r"((t|tel|phone|direct|m|mobile|cell|fax|f|o|p|office|tél|téléphone|telefon|mobil|teléfono|móvil|portable)\b[.:]?\s*)?[+(]?\d[\d\s().\-/]{6,}(\s*(x|ext\.?)\s*\d+)?)\s*$",
    re.I,
)
_DIVIDER = re.compile(r"^\s*(--\s?|__+|-{2,}|\*( ?\*)+|={2,}|~{2,})\s*$")
_SENTENCE = re.compile(r"[.?!]\s*[\"”')]?\s*$")
_ABBREVIATED = re.compile(r"\b(Inc|Co|Corp|Ltd|S\.A|L\.L\.P|Esq|St|Ave|Blvd|Rd|Jr|Sr|Dr|Mr|Ms|Mrs|Bros)\.\s*$")


class Automaton:
    """Generalised suffix automaton over word ids; every state knows the least order of the messages in it."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.first = [-1], [0], [1 << 60]

    def _state(self, nxt, length, link, first) -> int:
        self.next.append(nxt)
        self.length.append(length)
        self.link.append(link)
        self.first.append(first)
        return len(self.link) - 1

    def _split(self, p: int, q: int, c: int) -> int:
        clone = self._state(dict(self.next[q]), self.length[p] + 1, self.link[q], self.first[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def add(self, words: list[int], order: int) -> None:
        last = 0
        for c in words:
            q = self.next[last].get(c)
            if q is not None:
                last = q if self.length[q] == self.length[last] + 1 else self._split(last, q, c)
            else:
                cur = self._state({}, self.length[last] + 1, 0, 1 << 60)
                p = last
                while p >= 0 and c not in self.next[p]:
                    self.next[p][c] = cur
                    p = self.link[p]
                if p >= 0:
                    q = self.next[p][c]
                    self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, c)
                last = cur
            s = last  # the strings that end here occur in this message
            while s > 0 and self.first[s] > order:
                self.first[s] = order
                s = self.link[s]

    def inherited(self, words: list[int], order: int, least: int) -> np.ndarray:
        """Which words lie in runs of ``least`` words or more that a message before ``order`` holds."""
        out = np.zeros(len(words), bool)
        s = n = 0
        for i, c in enumerate(words):
            while s and (c not in self.next[s] or self.first[self.next[s][c]] >= order):
                s = self.link[s]
                n = self.length[s]
            t = self.next[s].get(c)
            if t is not None and self.first[t] < order:
                s, n = t, n + 1
            else:
                s = n = 0
            if n >= least:
                out[i - n + 1 : i + 1] = True
        return out


def _line_words(lines: list[str]) -> list[list[str]]:
    return [WORD.findall(x.lower()) for x in lines]


def label(text: str, inherited: np.ndarray | None = None, endings: set[int] | None = None) -> list[str]:
    """A label for every line of an email: '' blank, 'new', 'quote', 'notice', 'device', 'banner', 'signature'."""
    lines = [x.rstrip("\r") for x in text.split("\n")]
    n = len(lines)
    blank = [not x.strip() for x in lines]
    out = [""] * n
    words = _line_words(lines)
    held = [0.0] * n
    if inherited is not None and len(inherited):
        at = 0
        for i, w in enumerate(words):
            if w:
                held[i] = float(inherited[at : at + len(w)].mean())
            at += len(w)

    def after(i: int) -> int:
        while i < n and blank[i]:
            i += 1
        return i

    i, rest, introduced = 0, False, False
    indent = None  # inside an indented quotation
    while i < n:
        x = lines[i]
        if blank[i]:
            i += 1
            continue
        if rest:
            out[i] = "quote"
        elif indent and x[:1] in " \t" and (x.startswith("\t") or x.startswith("  ")):
            out[i] = "quote"
        elif _QUOTE.match(x) and not _WROTE.match(x):
            # one marked line alone, that nothing introduced and no earlier message holds, is a sign the sender typed
            alone = not introduced and not any(0 <= j < n and _QUOTE.match(lines[j]) for j in (i - 1, i + 1))
            out[i] = "" if alone and held[i] < 0.5 else "quote"
            indent = None
        elif _ORIGINAL.match(x):
            rest = True
            out[i] = "quote"
        elif _RULE.match(x) and (j := after(i + 1)) < n and _FROM.match(lines[j]) and _is_head(lines, j):
            rest = True
            out[i] = "quote"
        elif _FROM.match(x) and _is_head(lines, i):
            rest = True
            out[i] = "quote"
        elif (k := _wrote(lines, i)) > 0:
            introduced = True
            for j in range(i, i + k):
                out[j] = "quote"
            j = after(i + k)
            indent = None
            if j < n and not _QUOTE.match(lines[j]):
                if lines[j][:1] in " \t":
                    indent = True
                else:
                    rest = True  # quoted without any mark
            i += k
            continue
        else:
            indent = None
        i += 1
    _notices(lines, blank, out)
    if inherited is not None and len(inherited):
        _history(lines, blank, out, words, inherited)
    _ending(lines, blank, out, words, endings or set())
    return [("" if blank[i] else out[i] or "new") for i in range(n)]


def _history(lines, blank, out, words, inherited) -> None:
    """Marks the lines of every long inherited stretch as quoted, however they are wrapped.

    A line belongs to the stretch that holds four fifths of its words.  In front of a stretch a greeting, closing phrase or
    lone name is left: a sender's own closing and signature recur too, and begin with these.
    """
    edges = np.flatnonzero(np.diff(np.concatenate(([0], np.asarray(inherited, np.int8), [0]))))
    ends = np.cumsum([len(w) for w in words])
    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
        if b - a < LONG_RUN:
            continue
        front = True
        for i in range(int(np.searchsorted(ends, a, "right")), len(lines)):
            first = int(ends[i]) - len(words[i])
            if first >= b:
                break
            if not words[i] or blank[i] or min(b, int(ends[i])) - max(a, first) < 0.8 * len(words[i]):
                continue
            front = front and not out[i] and bool(_CLOSING.match(lines[i]) or _GREETING.match(lines[i]) or _LONE.match(lines[i]))
            if not front and not out[i]:
                out[i] = "quote"


_LONE = re.compile(r"^\s*[^\W\d_][\w'’.-]*\s*$")


def _is_head(lines: list[str], i: int) -> bool:
    """A From line with another header line within the next two."""
    return any(_HEADER.match(x) and not _FROM.match(x) for x in lines[i + 1 : i + 3])


def _wrote(lines: list[str], i: int) -> int:
    """Number of lines of the line that introduces a quotation; 0 if there is none."""
    x = lines[i]
    if _WROTE.match(x):
        return 1
    if _WROTE_HEAD.match(x) and i + 1 < len(lines) and len(x) < 120 and not _SENTENCE.search(x):
        y = x + " " + lines[i + 1].strip()
        if _WROTE.match(y) and not _QUOTE.match(lines[i + 1]):
            return 2
    return 0


def _notices(lines, blank, out) -> None:
    n = len(lines)
    i = 0
    while i < n:
        if out[i] or blank[i]:
            i += 1
        elif _BANNER.match(lines[i]):
            out[i] = "banner"
            i += 1
        elif _DEVICE.match(lines[i]) and len(lines[i]) < 90:
            out[i] = "device"
            i += 1
        elif _NOTICE.match(lines[i]):
            while i < n and not blank[i] and not out[i]:
                out[i] = "notice"
                i += 1
        else:
            i += 1


def _plain(x: str) -> bool:
    """A line without a sentence: a name, title, firm, street, contact or divider."""
    if re.match(r"^\s*[-=>*]{2,}\s*\w.*\w\s*[-=<*]{2,}\s*$", x):
        return False  # words set off by signs
    if _CONTACT.match(x) or _DIVIDER.match(x):
        return True
    return not (_SENTENCE.search(x) and not _ABBREVIATED.search(x)) and not x.rstrip().endswith((":", ";", ",")) and len(x) <= 140


def _ending(lines, blank, out, words, endings) -> None:
    """Marks the signature: the last lines of the sender's own text that hold no sentence."""
    own = [i for i in range(len(lines)) if not blank[i] and not out[i]]
    k = len(own)
    while k:
        x = lines[own[k - 1]]
        if _CLOSING.match(x) or _GREETING.match(x) and not _CONTACT.match(x):
            break
        known = bool(endings) and _line_key(words[own[k - 1]]) in endings
        if not (_plain(x) or known):
            break
        k -= 1
    tail = own[k:]
    if not tail:
        return
    closed = k > 0 and bool(_CLOSING.match(lines[own[k - 1]]))
    start = 0
    # the given name under the closing is still the sender's text
    if closed and re.fullmatch(r"\s*[^\W\d_][\w'’.-]*\s*", lines[tail[0]]) and not _DIVIDER.match(lines[tail[0]]):
        start = 1
    rest = tail[start:]
    if not rest:
        return
    # without a closing, a contact, a divider, a name or a known ending must show that it is a signature
    if not closed and not any(
        _CONTACT.match(lines[i]) or _DIVIDER.match(lines[i]) or _line_key(words[i]) in endings or _name_line(lines[i]) for i in rest
    ):
        return
    for i in rest:
        out[i] = "signature"


_NAME = re.compile(r"^\s*(?:Dr\.?\s+)?[A-ZÀ-Þ][\w'’-]*\.?( [A-ZÀ-Þ][\w'’.-]*){1,3}(, Esq\.?)?\s*([|/,–-].*)?$")


def _name_line(x: str) -> bool:
    return bool(_NAME.match(x))


def _line_key(words: list[str]) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(" ".join(words)) >> 1


def emails(payloads: DataFrame) -> DataFrame:
    """path, text, thread, sent of the distinct email rows; thread and sent are null where not known."""
    p = payloads.where(F.lower("path").rlike(r"\.(eml|msg)$") & F.col("text").isNotNull())
    meta = F.when(F.col("metadata").startswith("{"), F.col("metadata"))
    return p.select(
        "path",
        "text",
        F.nullif(F.trim(F.get_json_object(meta, "$.family_id")), F.lit("")).alias("thread"),
        F.get_json_object(meta, "$.sent").alias("sent"),
    ).dropDuplicates(["path", "text"])


def fingerprints(x: str) -> np.ndarray:
    """Distinct hashes of runs of ``MIN_RUN`` words: the least of every ``WINNOW`` neighbouring ones, so that any shared
    stretch of ``MIN_RUN + WINNOW - 1`` words has one in common."""
    h = rolling(word_hashes(WORD.findall(x.lower())), MIN_RUN).view(np.int64)
    if len(h) > WINNOW:
        h = np.lib.stride_tricks.sliding_window_view(h, WINNOW).min(1)
    return np.unique(h)


def threaded(mails: DataFrame) -> DataFrame:
    """``mails`` with a thread for those without one that share runs with a family: the one that has most of them.

    A run that several families hold (notices, signatures) tells nothing and is left out; ties go to the lesser thread.
    """

    def prints(batches):
        for pdf in batches:
            marks = [fingerprints(x) for x in pdf["text"]]
            yield pd.DataFrame({"path": pdf["path"], "thread": pdf["thread"], "seed": marks})

    made = mails.where("thread is not null or sent is not null").mapInPandas(prints, "path string, thread string, seed array<long>")
    made = cut(made).select("path", "thread", F.explode("seed").alias("seed"))
    held = made.where("thread is not null").groupBy("seed").agg(F.min("thread").alias("a"), F.max("thread").alias("b")).where("a = b")
    found = made.where("thread is null").select("path", "seed").distinct().join(held, "seed").groupBy("path", "a").agg(F.count(F.lit(1)).alias("n"))
    first = found.groupBy("path").agg(F.min(F.struct((-F.col("n")).alias("m"), "a")).alias("f")).select("path", F.col("f.a").alias("found"))
    return mails.join(first, "path", "left").withColumn("thread", F.coalesce("thread", "found")).drop("found")


def inherited_runs(mails: DataFrame) -> DataFrame:
    """path, runs: flat array of word places [from, to, from, to ...] that an earlier message of the thread holds.

    A thread larger than ``BLOCK`` messages is dealt by hash to several automata.  A message then visits only the
    blocks that hold the earliest place of one of its runs, and a block that many visit is copied to
    several tasks, so that no thread is gathered in one task.
    """
    m = mails.where("thread is not null and sent is not null")
    size = m.groupBy("thread").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts"), F.count(F.lit(1)).alias("n"))
    m = m.join(size.where("n > 1"), "thread").withColumn("block", F.pmod(F.xxhash64("path"), F.col("parts")).cast("int"))
    m = cut(m.select("thread", "block", "parts", "path", "sent", "text"))

    def seeds(batches):
        for pdf in batches:
            for t, b, p, s, x in zip(pdf["thread"], pdf["block"], pdf["path"], pdf["sent"], pdf["text"]):
                h = np.unique(rolling(word_hashes(WORD.findall(x.lower())), MIN_RUN)).view(np.int64)
                if len(h):
                    yield pd.DataFrame({"thread": t, "block": b, "path": p, "sent": s, "seed": h})

    large = m.where("parts > 1").mapInPandas(seeds, "thread string, block int, path string, sent string, seed long")
    first = large.groupBy("thread", "seed").agg(F.min(F.struct("sent", "block")).alias("f"))
    visits = (
        large.select("thread", "path", "sent", "seed")
        .join(first, ["thread", "seed"])
        .where("f.sent < sent")
        .select("thread", "path", F.col("f.block").alias("block"))
    )
    visits = visits.unionByName(m.select("thread", "path", "block")).distinct()
    heat = visits.groupBy("thread", "block").agg(F.ceil(F.count(F.lit(1)) / (4 * BLOCK)).cast("int").alias("shares"))
    cols = ["thread", "block", "share", "path", "sent", "text", "kind"]
    members = m.join(heat, ["thread", "block"]).withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).withColumn("kind", F.lit(1))
    asking = (
        visits.join(heat, ["thread", "block"])
        .withColumn("share", F.pmod(F.xxhash64("path"), F.col("shares")).cast("int"))
        .join(m.select("thread", "path", "sent", "text"), ["thread", "path"])
        .withColumn("kind", F.lit(0))
    )
    work = members.select(*cols).unionByName(asking.select(*cols))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        order = {s: k for k, s in enumerate(sorted(pdf["sent"].unique()))}
        ids: dict[str, int] = {}
        aut = Automaton()

        def coded(x):
            return [ids.setdefault(w, len(ids)) for w in WORD.findall(x.lower())]

        for s, x in zip(pdf.loc[pdf["kind"] == 1, "sent"], pdf.loc[pdf["kind"] == 1, "text"]):
            aut.add(coded(x), order[s])
        rows = []
        ask = pdf[pdf["kind"] == 0]
        for p, s, x in zip(ask["path"], ask["sent"], ask["text"]):
            flags = aut.inherited(coded(x), order[s], MIN_RUN)
            edges = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
            if len(edges):
                rows.append((p, x, edges.tolist()))
        return pd.DataFrame(rows, columns=["path", "text", "runs"])

    found = work.groupBy("thread", "block", "share").applyInPandas(run, "path string, text string, runs array<int>")
    return found.groupBy("path", F.xxhash64("text").alias("h")).agg(F.flatten(F.collect_list("runs")).alias("runs"))


def labelled(payloads: DataFrame, *, recurring: int = 3, broadcast: int = 200_000) -> DataFrame:
    """path, line_no (from 1), label, line of every non-blank line of every email.

    Labels: new, quote, notice, device, banner, signature.  Rows without text or that are no email (by the
    ending of the path) take no part; repeated rows count once; a file with two texts gets the lines of
    both; mails without a time, and those whose runs tell no thread, are read by their marks alone; empty tables give
    no rows.  Ending lines that recur in ``recurring`` files or more are known as such: they are broadcast (8 bytes
    each) up to ``broadcast`` of them, and joined to the mails beyond that, with the same result.
    """
    spark = payloads.sparkSession
    mails = cut(emails(payloads))
    runs = inherited_runs(threaded(mails))
    both = spread(cut(mails.withColumn("h", F.xxhash64("text")).join(runs, ["path", "h"], "left").select("path", "h", "text", "runs")))

    def flags_of(text, runs):
        if runs is None:
            return None
        f = np.zeros(len(WORD.findall(text.lower())), bool)
        for a, b in zip(runs[::2], runs[1::2]):
            f[a:b] = True
        return f

    def ends(batches):
        for pdf in batches:
            rows = []
            for p, t, r in zip(pdf["path"], pdf["text"], pdf["runs"]):
                lines = t.split("\n")
                ws = _line_words(lines)
                rows += [(p, _line_key(ws[i])) for i, k in enumerate(label(t, flags_of(t, r))) if k == "signature" and ws[i]]
            yield pd.DataFrame(rows, columns=["path", "line"])

    common = cut(both.mapInPandas(ends, "path string, line long").groupBy("line").agg(F.countDistinct("path").alias("n")).where(F.col("n") >= recurring).select("line"))
    shared = None
    if common.count() <= broadcast:
        shared = spark.sparkContext.broadcast(set(common.toPandas()["line"].tolist()))
        both = both.withColumn("known", F.lit(None).cast("array<long>"))
    else:

        def asked(batches):
            for pdf in batches:
                keys = [sorted({_line_key(w) for w in _line_words(t.split("\n")) if w}) for t in pdf["text"]]
                yield pd.DataFrame({"path": pdf["path"], "h": pdf["h"], "line": keys})

        mine = both.mapInPandas(asked, "path string, h long, line array<long>").select("path", "h", F.explode("line").alias("line")).join(common, "line")
        both = both.join(mine.groupBy("path", "h").agg(F.collect_set("line").alias("known")), ["path", "h"], "left")

    def final(batches):
        for pdf in batches:
            rows = []
            for p, t, r, k in zip(pdf["path"], pdf["text"], pdf["runs"], pdf["known"]):
                lines = t.split("\n")
                known = shared.value if shared is not None else set(k) if k is not None else set()
                rows += [(p, i + 1, x, lines[i]) for i, x in enumerate(label(t, flags_of(t, r), known)) if x]
            yield pd.DataFrame(rows, columns=["path", "line_no", "label", "line"])

    return both.mapInPandas(final, "path string, line_no int, label string, line string")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return labelled(read(spark, d, "payloads")).where("label <> 'new'").select("path", "line_no").distinct()


def p6_new_text(spark: SparkSession, d: str) -> DataFrame:
    """Every email reduced to what its sender newly wrote; '' where that is nothing."""
    lines = labelled(read(spark, d, "payloads"))
    kept = F.sort_array(F.collect_list(F.when(F.col("label") == "new", F.struct("line_no", "line"))))
    return lines.groupBy("path").agg(F.array_join(F.transform(kept, lambda x: F.rtrim(x["line"])), "\n").alias("new_text"))


QUERIES = {"p6_found": p6_found, "p6_new_text": p6_new_text}
SQL: dict[str, str] = {}
