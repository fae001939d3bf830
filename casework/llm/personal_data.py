"""Personal information inside free text (problem 7).

Method: candidate gradient boosting.  High-recall generators propose overlapping spans of five types; boosted
trees score each by its format and context; spans are kept above a threshold calibrated on held-out
candidates, the more probable and longer one first where spans overlap.

The trees are fitted at run time on a bounded sample of candidates whose label is certain from their
surroundings (a telltale word before them, or a form that nothing else has); all others are left to the
model.  A pair of capitalised words, with initials or particles between, or set apart by a comma, is a candidate for a name
whatever the words; it is certain where the family name stands in an address of the same text (a name), or where its
words are used in lower case there or a firm's form follows (none).  How family names end, and which words stand as given
names in front of many of them, is counted over the whole corpus, beside a table of usual given names.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casework.llm.common import attach, cut, read, spread, values_of
from casework.llm.name_variants import NICKNAMES, TITLES, fold

GIVEN = frozenset(NICKNAMES) | {n for v in NICKNAMES.values() for n in v.split()}
TYPES = ("EMAIL", "PHONE", "ID", "ADDRESS", "NAME")

_DOT = r"\s?[\[(]\s?dot\s?[\])]\s?|\s+dot\s+"
_EMAIL = re.compile(
    r"[\w.+-]*\w@\w[\w-]*(?:\.\w[\w-]*)+|"
    rf"\w[\w.+-]*(?:\s?[\[(]\s?at\s?[\])]\s?|\s+at\s+)\w[\w-]*(?:(?:\.|{_DOT})\w[\w-]*)*(?:\.|{_DOT})(?:[a-z]{{2,8}})\b",
    re.I,
)
#: Every address holds one of these; only their lines are searched.
_EMAIL_SIGN = re.compile(r"@|[\[(]\s?at\s?[\])]|\sat\s+\w[\w-]*(?:\.\w|\s?[\[(]?\s?dot\b)", re.I)
_PHONE = re.compile(
    r"(?<![\w.+$-])(?:"
    r"(?:\+?1[-. ])?(?:\(\d{3}\) ?|\d{3}[-. ])\d{3}[-. ]\d{4}|"
    r"(?:\+|00)[2-9]\d[ .-]?\(?\d[\d().\- ]{5,13}\d|"
    r"0\d(?:[ .]\d{2}){4}|"
    r"\(0\d{2,4}\) ?\d{4,6}[- ]\d{2,4}|0\d{2,4}[ /-]\d{4,8}(?:[ -]\d{2,4})?|"
    r"[6-9]\d{2} \d{3} \d{3}|[6-9]\d{2} \d{2} \d{2} \d{2}|"
    r"\+?1?[2-9]\d{9}"
    r")(?![\w-]*\d)(?!-\w)"
)
_ID = re.compile(
    r"(?<![\w$#-])(?:\d{3}[- ]\d{2}[- ]\d{4}|\d{9}|[A-Z]{1,2}\d{7,8}|[A-Z]\d{3}-\d{4}-\d{4}|[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D]|[A-Z]\d{12})(?![\w-])",
    re.I,
)
_UP = r"[A-ZÀ-Þ][\w'’-]*"
_CITY = rf"{_UP}(?: (?:Falls|City|Springs|Heights|Beach))?"
_SEP = r",?(?:[^\S\n]+|[^\S\n]*\n[>|\s]*(?:[A-Z]{2}>\s?)?)"  # between the parts, also over lines
_COMMA = r",(?:[^\S\n]*|[^\S\n]*\n[>|\s]*(?:[A-Z]{2}>\s?)?)|[^\S\n]*\n[>|\s]*(?:[A-Z]{2}>\s?)?"
_WAY = r"Street|St\b\.?|Road|Rd\b\.?|Lane|Ln\b\.?|Avenue|Ave\b\.?|Boulevard|Blvd\b\.?|Court|Ct\b\.?|Drive|Dr\b\.?|Way|Place|Pl\b\.?|Terrace|Parkway|Square"
_UNIT = r"(?:Apt|Suite|Unit|Ste|Floor|Room|No)\b\.? ?\d+\w?|# ?\d+\w?"
# Postal codes of the states.
_STATE = (
    "(?:A[KLRZ]|C[AOT]|D[CE]|FL|GA|HI|I[ADLN]|K[SY]|LA|M[ADEINOST]|N[CDEHJMVY]|O[HKR]|PA|RI|S[CD]|T[NX]|UT|V[AT]|W[AIVY])\\b"
)
_ZIP = rf"(?:{_COMMA}| ){_STATE}(?:\s+\d{{5}}(?:-\d{{4}})?)?"
_US_TAIL = rf"(?:,[^\S\n]*{_CITY}(?:{_ZIP})?|(?:{_COMMA}){_CITY}(?:{_ZIP}|(?=[^\S\n]*\r?(?:\n|$))))?"
_ADDRESS = re.compile(
    rf"(?<![\w.$/-])(?:"
    rf"\d{{1,5}}\s+(?:(?:[NSEW]\.|North|South|East|West)\s+)?{_UP}(?:\s+{_UP})?\s+(?:{_WAY})(?:{_SEP}(?:{_UNIT}))?{_US_TAIL}|"
    rf"(?:P\.\s?O\.|PO|Post Office)\s+Box\s+\d+{_US_TAIL}|"
    rf"\d{{1,4}}(?: [Bb]is| [Tt]er)?,? (?:[Rr]ue|[Aa]venue|[Bb]oulevard|[Pp]lace|[Cc]hemin|[Aa]llée|[Ii]mpasse|[Qq]uai|[Rr]oute|[Cc]ours|[Ss]quare)\s+(?:(?:[Dd]e|[Dd]u|[Dd]es|[Ll]a|[Ll]e) )*{_UP}(?:(?:{_COMMA})\d{{5}}\s+{_CITY})?|"
    rf"(?:Calle|Avenida|Plaza|Paseo|Camino|Carrer|Ronda)\s+(?:(?:[Dd]e|[Dd]el|[Ll]a|[Ee]l|[Ll]os) )*{_UP},? \d{{1,4}}(?:(?:{_COMMA})(?:[Bb]ajo|[Áá]tico|\d{{1,2}}\.?[ºª](?: ?[A-Z]\b)?))?(?:(?:{_COMMA})\d{{5}}\s+{_CITY})?|"
    rf"[A-ZÄÖÜ]\w*(?:straße|strasse|weg|gasse|platz|allee|ring|damm|ufer)\s+\d{{1,4}}\w?(?:(?:{_COMMA})\d{{5}}\s+{_CITY})?"
    r")"
)
_LOWER = re.compile(r"^(?=[^\n]*[a-z])(?=[^\n]*\d)[^\nA-ZÀ-Þ]{12,}$", re.M)
_WORD = re.compile(r"[^\W\d_]+(?:[-'’][^\W\d_]+)*\.?")
_PARTICLE = {"de", "von", "van", "di", "da", "del", "la", "der", "den", "du"}

_PHONE_WORD = re.compile(
    r"\b(tel|telephone|phone|mobile|cell|fax|call|direct|t|m|p|number is|message on|ring|dial|appeler?|téléphon\w*|telefon\w*|llame|móvil|mobil|anruf\w*|unter|au|al)\b\W*$", re.I
)
_ID_WORD = re.compile(
    r"\b(ssn|soc(ial)?(\W+sec(urity)?)?|tax(payer)?\W+id\w*|tin|passport|pass\w*|licen[cs]e|dl|insurance|nino|ni|identity|ausweis|steuer\w*|dni|nif)\b\W*(no|number|nr|num|n[º°o])?\W*$", re.I
)
_OTHER_WORD = re.compile(
    r"\b(tracking|control|version|part|order|docket|case|serial|invoice|account|section|ref\w*|item|batch|lot|model|page|exhibit|sku|hash|isbn|file|box)\b[\s#:]*(no|number|nr|id)?\W*$", re.I
)
_TITLE = re.compile(r"\b(Dr|Mr|Mrs|Ms|Miss|Prof|Mme|M|Mlle|Frau|Herrn?|Sra?|señora?|Don|Doña)\.?\s+$", re.I)
_PERSON_WORD = re.compile(
    r"\b(from|to|cc|attention|statement of|spoke with|name as|served|originals to|bill to|lists|contact|copie an|con copia a|file of|akte von|"
    r"expediente de|pour|call|llame a|appeler|herrn?|frau|and|by|von|de|an|para)\W*$",
    re.I,
)
SCHEMA = "path string, entity string, char_from int, char_to int, text string"


def _clip(t: str, a: int, b: int) -> tuple[int, int]:
    while a < b and not t[a].isalnum():
        a += 1
    while b > a and not t[b - 1].isalnum():
        b -= 1
    return a, b


def _raised(t: str) -> str:
    """The text with the words of its all-lower-case lines capitalised (two letters: all), of the same length."""
    if not _LOWER.search(t):
        return t
    one = lambda c: c.upper() if len(c.upper()) == 1 else c

    def word(m: re.Match) -> str:
        w = m.group()
        return "".join(map(one, w)) if len(w) == 2 and w not in _PARTICLE | {"st", "rd", "dr", "ln", "ct", "pl", "no"} else one(w[0]) + w[1:]

    return _LOWER.sub(lambda m: re.sub(r"[^\W\d_]+", word, m.group()), t)


_TITLES = {"Mister", "Miss", "Frau", "Herr", "Herrn", "Fräulein", "Madame", "Mademoiselle", "Monsieur", "Señor", "Señora", "Señorita", "Doña", "Professor", "Doctor", "Doktor", "Judge"}
_FIRM = re.compile(r"^,? (?:GmbH|Inc|LLC|LLP|L\.L\.P|Ltd|Corp|Co|S\.A|AG|plc|Company|Partners|Group|Labs|Systems)\b")


def _names(t: str, given: frozenset[str] = GIVEN) -> list[tuple[int, int, dict]]:
    """Candidate names with their features: (from, to, {given, family, initials, comma, broken, lower, first}); given 0 without a known given name."""
    words = [(m.start(), m.end(), m.group()) for m in _WORD.finditer(t)]
    n = len(words)
    folded: list[str] = []
    kind: list[str] = []  # g given, c capitalised, i initial, p particle, l lower
    for a, b, w in words:
        bare = w.rstrip(".")
        f = fold(bare) if bare[:1].isupper() or bare in given or len(bare) > 2 and not bare.isascii() else bare
        folded.append(f)
        if len(bare) == 1 and bare.isupper():
            kind.append("i")
        elif f in given and (bare[:1].isupper()):
            kind.append("g")
        elif f in given:
            kind.append("h")
        elif bare.lower() in _PARTICLE:
            kind.append("p")
        elif re.match(r"(?:al|el|d|l|o)[-'’][A-ZÀ-Þ]", bare):
            kind.append("c")
        elif bare[:1].isupper() and len(bare) > 3:
            kind.append("c")
        else:
            kind.append("l")
    out = []

    def gap(i: int) -> str:
        return t[words[i][1] : words[i + 1][0]]

    def joined(i: int) -> int:
        """0 not adjacent, 1 by a blank, 2 by a line break."""
        if i + 1 >= n:
            return 0
        g = gap(i)
        if g and not g.strip() and "\n" not in g and len(g) < 3:
            return 1
        if g.count("\n") == 1 and re.fullmatch(r"[^\S\n]*\r?\n[>|\s]*", g):
            s = t.rfind("\n", 0, words[i][0]) + 1
            if len(_WORD.findall(t[s : words[i][0]])) >= 2:
                return 2
        return 0

    def tail(w: str) -> str:
        return re.sub(r"['’]s$", "", w.rstrip("."))

    def shaped(i: int) -> int:
        """The word that closes a run: a capitalised one, then initials or particles, three at most, then another; 0 without."""
        j = i
        while joined(j) == 1 and kind[j + 1] in "ip" and j - i < 3:
            j += 1
        return j + 1 if joined(j) == 1 and kind[j + 1] == "c" else 0

    def behind(i: int) -> bool:
        """The word stands right behind a given name, initial or particle, and belongs to it."""
        return i > 0 and kind[i - 1] in "gip" and joined(i - 1) > 0

    for i in range(n):
        k = kind[i]
        if k in "gh":
            # Given [I.] [de] Family
            j, broken, initials = i, 0, 0
            while (s := joined(j)) and kind[j + 1] == "i" and initials < 3:
                broken = max(broken, s)
                j += 1
                initials += 1
            for _ in range(2):
                if (s := joined(j)) and kind[j + 1] == "p":
                    broken = max(broken, s)
                    j += 1
            if s := joined(j):
                broken = max(broken, s)
                x = words[j + 1][2]
                ok = kind[j + 1] == "c" if k == "g" else kind[j + 1] == "l" and len(x.rstrip(".")) > 5
                heads = broken == 2 and t[words[j + 1][1] : words[j + 1][1] + 4].lstrip(" *").startswith(":")  # the next line is a header
                if ok and not heads and not (words[i][2].endswith(".") and len(words[i][2]) > 4):
                    fam = tail(x)
                    out.append((words[i][0], words[j + 1][0] + len(fam), {"given": 1, "fam": fam, "initials": initials, "comma": 0, "broken": broken == 2, "lower": k == "h"}))
        elif k == "i" and (i == 0 or kind[i - 1] != "i" or joined(i - 1) != 1):
            j, initials = i, 1
            while joined(j) == 1 and kind[j + 1] == "i" and initials < 3:
                j += 1
                initials += 1
            for _ in range(2):
                if joined(j) and kind[j + 1] == "p":
                    j += 1
            if (s := joined(j)) and kind[j + 1] == "c" and words[i][2].endswith("."):
                if i and kind[i - 1] in "g" and joined(i - 1) == 1:
                    continue
                fam = tail(words[j + 1][2])
                out.append((words[i][0], words[j + 1][0] + len(fam), {"given": 0, "fam": fam, "initials": initials, "comma": 0, "broken": s == 2, "lower": False}))
        elif (k == "c" or k == "l" and len(words[i][2]) > 5) and i + 1 < n:
            fam = words[i][2]
            lower = k == "l"
            g = gap(i)
            first = i  # particles in front belong to the family: two, or one that begins its line
            while first and kind[first - 1] == "p" and joined(first - 1) == 1 and i - first < 2:
                first -= 1
            if i - first == 1 and t[: words[first][0]].rstrip(" \t>|")[-1:] not in ("", "\n"):
                first = i
            if re.fullmatch(r",[^\S\n]{0,2}|,[^\S\n]*\n[>|\s]*", g) and not fam.endswith("."):
                if kind[i + 1] == ("h" if lower else "g"):
                    j = i + 1
                    while joined(j) == 1 and kind[j + 1] == "i" and j < i + 3:
                        j += 1
                    follows = joined(j) == 1 and kind[j + 1] == "c"
                    out.append((words[first][0], words[j][1], {"given": 1, "fam": fam, "initials": j - i - 1, "comma": 1, "broken": "\n" in g, "lower": lower, "follows": tail(words[j + 1][2]) if follows else ""}))
                elif kind[i + 1] == "i" and words[i + 1][2].endswith(".") and not lower:
                    j = i + 1
                    while joined(j) == 1 and kind[j + 1] == "i" and j < i + 3:
                        j += 1
                    out.append((words[first][0], words[j][1], {"given": 0, "fam": fam, "initials": j - i, "comma": 1, "broken": "\n" in g, "lower": lower}))
                elif kind[i + 1] == "c" and not lower and "\n" not in g and fam not in _TITLES and not behind(i):
                    out.append((words[first][0], words[i + 1][0] + len(tail(words[i + 1][2])), {"given": 0, "fam": fam, "initials": 0, "comma": 1, "broken": False, "lower": False, "first": tail(words[i + 1][2])}))
            elif not lower and joined(i) == 1 and not fam.endswith(".") and fam not in _TITLES and not behind(i) and (z := shaped(i)):
                out.append((words[i][0], words[z][0] + len(tail(words[z][2])), {"given": 0, "fam": tail(words[z][2]), "initials": z - i - 1, "comma": 0, "broken": False, "lower": False, "first": fam}))
            elif not lower and joined(i) == 1 and kind[i + 1] == "g" and not fam.endswith("."):
                follows = joined(i + 1) == 1 and kind[i + 2] in "ci"
                out.append((words[i][0], words[i + 1][1], {"given": 1, "fam": fam, "initials": 0, "comma": 0, "broken": False, "lower": False, "turned": 1, "follows": tail(words[i + 2][2]) if follows else ""}))
    return out


def _emails(t: str):
    done = 0
    for sign in _EMAIL_SIGN.finditer(t):
        if sign.start() < done:
            continue
        a, b = t.rfind("\n", 0, sign.start()) + 1, t.find("\n", sign.end())
        done = len(t) if b < 0 else b
        yield from _EMAIL.finditer(t, max(a, sign.start() - 400), done)


_NONE = (np.zeros(0, np.int64), np.zeros(0))


def _key(word: str) -> int:
    return xxhash.xxh64_intdigest(word) - (1 << 63)


def _asked(text: str) -> np.ndarray:
    """Keys of the capitalised words of a text."""
    return np.array([_key(w) for w in {fold(x) for x in re.findall(r"[A-ZÀ-Þ][^\W\d_]+", text)}], np.int64)


def candidates(t: str, endings: dict[str, float], given: frozenset[str] = GIVEN, firsts=_NONE) -> list[tuple[str, int, int, list[float], int]]:
    """(type, from, to, features, label) of all proposed spans; label 1 or 0 where certain, else -1.

    ``firsts``: sorted keys of words, and of the words that stand behind each the share that are family names.
    """
    found = []
    seen: list[str] = []  # the addresses' names
    plain: set[str] = set()  # the words in lower case

    def context(a: int, b: int):
        before = t[max(0, a - 40) : a]
        before = before[before.rfind("\n") + 1 :] if before.strip() and before[-1:] != "\n" else before
        return before, t[b : b + 12]

    def add(kind, a, b, label, special):
        a, b = _clip(t, a, b)
        if a >= b:
            return
        s = t[a:b]
        before, after = context(a, b)
        digits = sum(c.isdigit() for c in s)
        x = [
            float(TYPES.index(kind)), len(s), digits, s.count("-"), s.count(" "), s.count("."), s.count("/") + s.count(","), "\n" in s,
            t[a - 1 : a] in ("+", "("), t[a - 1 : a] in ("$", "#", "€", "£"), bool(_PHONE_WORD.search(before)), bool(_ID_WORD.search(before)),
            bool(_OTHER_WORD.search(before)), bool(_TITLE.search(before)), bool(_PERSON_WORD.search(before)), after[:1] in ("%", "/"), s.isupper(),
        ]
        x = [float(v) for v in x] + special
        found.append((kind, a, b, x, label(before, s, x) if callable(label) else label))

    none = [0.0] * 10
    for m in _emails(t):
        spelled = "@" not in m.group()
        last = re.split(r"[^\w]+", m.group())[-1].lower()
        blank = bool(re.search(r"\sat\s", m.group(), re.I)) and spelled
        dotted = bool(re.search(r"\bdot\b", m.group(), re.I)) or not blank
        local = re.split(r"\W", m.group())[0]
        seen.append(fold(re.split(r"@|\s|[\[(]", m.group())[0]))
        add("EMAIL", m.start(), m.end(), (1 if not spelled or not blank else 1 if dotted and re.search(r"\bdot\b", m.group(), re.I) else -1 if "." in m.group() and re.search(r"[\d_.+]", local) else 0), [float(spelled), float(blank), float(dotted), float(len(last) > 1)] + none[4:])
    for m in _PHONE.finditer(t):
        a, s = m.start(), m.group()
        while t[a - 1 : a] == "(" and s.count(")") > s.count("("):
            a -= 1

        def lab(before, s, x, raw=m.group()):
            if _OTHER_WORD.search(before) or _ID_WORD.search(before):
                return 0
            if raw.isdigit() and len(raw) in (9, 10, 11):
                return 1 if _PHONE_WORD.search(before) or raw[-7:-4] == "555" else -1
            return 1

        add("PHONE", a, m.end(), lab, [float(s.isdigit()), float(s.startswith("+")), float(s.startswith("0")), float(bool(re.match(r"\(?\d{3}\)?[-. ]\d{3}[-. ]\d{4}$", s)))] + none[4:])
    for m in _ID.finditer(t):
        s = m.group()

        def lab(before, s, x, raw=s):
            if _OTHER_WORD.search(before):
                return 0
            if _ID_WORD.search(before):
                return 1
            if re.fullmatch(r"\d{9}", raw) or re.match(r"[A-Za-z]{1,2}\d{7,8}$|[A-Za-z]\d{12}$", raw):
                return 0
            return -1 if re.match(r"\d", raw) else 1

        shape = [re.match(r"\d{3}-\d\d-\d{4}$", s), re.match(r"\d{3} \d\d \d{4}$", s), re.match(r"\d{9}$", s), re.match(r"[A-Za-z]+\d{7,8}$", s), re.match(r"[A-Za-z]\d{3}-", s), re.match(r"[A-Za-z]{2} ?\d\d ?\d", s)]
        add("ID", m.start(), m.end(), lab, [float(bool(v)) for v in shape] + none[6:])
    for m in _ADDRESS.finditer(_raised(t)):
        add("ADDRESS", m.start(), m.end(), 1, none)
    logins = " ".join(seen)
    for a, b, f in _names(t, given):
        end = endings.get(fold(f["fam"])[-3:], -4.0)
        nxt = endings.get(fold(f["follows"])[-3:], -4.0) if f.get("follows") else -6.0
        fam = max(re.split(r"[-'’]", f["fam"]), key=len)
        turned = float(f.get("turned", 0))
        label = -1
        known = len(fam) > 4 and fold(fam) in logins
        share = 0.5
        if "first" in f:  # by shape alone
            share = float(values_of(np.array([_key(fold(f["first"]))]), firsts, 0.5)[0])
            if not plain and t:
                plain = {x.strip(".,;:()!?\"'") for x in t.split() if x[:1].islower() or x[:1] in "(\"'"}
            if f["first"].lower() in plain or f["fam"].lower() in plain or share < 0.1 or _FIRM.match(t[b : b + 16]):
                label = 0
            elif known:
                label = 1
        elif f["given"] and not f["comma"] and not turned:
            label = 1 if known or end > 0.5 else 0 if end < -2 else -1
        elif f["given"]:
            label = 1 if end > 0.5 and nxt < 0 else 0 if end < -1 or nxt > end else -1
        elif end < -0.5 or len(fam) < 5:
            label = 0
        elif known or end > 1:
            label = 1
        add("NAME", a, b, label, [float(f["given"]), float(f["initials"]), float(f["comma"]), float(f["broken"]), float(f["lower"]), end, nxt, float(len(fam)), share, turned - float("first" in f)])
    return found


class Boosted:
    """Gradient-boosted trees of depth two for the log loss, on quantile bins."""

    def __init__(self, rounds: int = 60, rate: float = 0.3, depth: int = 2, bins: int = 16):
        self.rounds, self.rate, self.depth, self.bins = rounds, rate, depth, bins
        self.trees: list = []
        self.bias, self.a, self.b = 0.0, 1.0, 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> "Boosted":
        self.bias = float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        f = np.full(len(y), self.bias)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-f))
            tree = self._grow(x, y - p, p * (1 - p), cuts, self.depth)
            self.trees.append(tree)
            f += self.rate * self._apply(tree, x)
        return self

    def _grow(self, x, g, h, cuts, depth):
        value = float(g.sum() / (h.sum() + 1.0))
        if depth == 0 or len(g) < 20:
            return value
        base, best = g.sum() ** 2 / (h.sum() + 1.0), (1e-6, None, None)
        for j, cs in enumerate(cuts):
            if not len(cs):
                continue
            k = np.searchsorted(cs, x[:, j], "left")
            gs, hs = (np.cumsum(np.bincount(k, weights=w, minlength=len(cs) + 1))[:-1] for w in (g, h))
            gain = gs**2 / (hs + 1.0) + (g.sum() - gs) ** 2 / (h.sum() - hs + 1.0) - base
            c = int(gain.argmax())
            if gain[c] > best[0]:
                best = (float(gain[c]), j, float(cs[c]))
        if best[1] is None:
            return value
        left = x[:, best[1]] <= best[2]
        if left.all() or not left.any():
            return value
        return (best[1], best[2], self._grow(x[left], g[left], h[left], cuts, depth - 1), self._grow(x[~left], g[~left], h[~left], cuts, depth - 1))

    def _apply(self, tree, x):
        if not isinstance(tree, tuple):
            return np.full(len(x), tree)
        out, left = np.empty(len(x)), x[:, tree[0]] <= tree[1]
        out[left], out[~left] = self._apply(tree[2], x[left]), self._apply(tree[3], x[~left])
        return out

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.bias + self.rate * sum((self._apply(t, x) for t in self.trees), np.zeros(len(x)))

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> "Boosted":
        """Platt scaling on held-out rows."""
        s = self.raw(x)
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(self.a * s + self.b, -30, 30)))
            w = p * (1 - p) + 1e-6
            ga, gb = (s * (p - y)).mean() + 1e-3 * (self.a - 1), (p - y).mean() + 1e-3 * self.b
            haa, hab, hbb = (s * s * w).mean() + 1e-3, (s * w).mean(), w.mean() + 1e-3
            det = haa * hbb - hab * hab
            self.a -= (hbb * ga - hab * gb) / det
            self.b -= (haa * gb - hab * ga) / det
        return self

    def prob(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.a * self.raw(x) + self.b, -30, 30)))


def learn(texts: DataFrame, *, families: int = 3) -> tuple[dict[str, float], frozenset[str], DataFrame]:
    """How family names end, the given names, and what stands behind any capitalised word, counted over all texts.

    Endings: log odds of the last three letters of words that stand behind given names against those of other capitalised
    words; every distinct word weighs one, by the share of its places behind a given name.  There are at most as many as
    endings of three letters.  Given names: the usual ones, and words that stand in front of at least ``families`` words
    that also stand behind usual given names, and hardly of others; both are bounded by the languages, not by the rows.  Last a table (k, v): of the different words behind
    a word, if there are ``families`` or more, the share that are families.
    """

    def count(batches):
        pair = re.compile(r"\b([A-ZÀ-Þ][^\W\d_]+)(?=\s(?:[A-ZÀ-Þ]\.?\s)?([A-ZÀ-Þ][^\W\d_]{4,}))")
        both = re.compile(r"\b([A-ZÀ-Þ][^\W\d_]{2,})(?= (?:[A-ZÀ-Þ]\.? )?([A-ZÀ-Þ][^\W\d_]{4,}))")
        cap = re.compile(r"\b[A-ZÀ-Þ][^\W\d_]{4,}")
        for pdf in batches:
            seen: dict[str, list[int]] = {}
            pairs: set[tuple[str, str]] = set()
            for t in pdf["text"]:
                for w in cap.findall(t):
                    seen.setdefault(w, [0, 0])[1] += 1
                for g, w in pair.findall(t):
                    if fold(g) in GIVEN and fold(w) not in GIVEN and w in seen:
                        seen[w][0] += 1
                pairs.update(both.findall(t))
            yield pd.DataFrame([("", k, *v) for k, v in seen.items()] + [(fold(g), w, 0, 0) for g, w in pairs], columns=["first", "word", "after", "n"])

    ending = F.udf(lambda w: fold(w)[-3:], "string", useArrow=True)
    counted = cut(texts.mapInPandas(count, "first string, word string, after long, n long").groupBy("first", "word").agg(F.sum("after").alias("after"), F.sum("n").alias("n")))
    by_word = counted.where("first = ''").select("word", (F.col("after") / F.col("n")).alias("p"))
    c = by_word.groupBy(ending("word").alias("ending")).agg(F.sum("p").alias("a"), F.sum(1 - F.col("p")).alias("o")).orderBy("ending").toPandas()
    if not len(c):
        return {}, GIVEN, texts.sparkSession.createDataFrame([], "k long, v double")
    a, o = c["a"].to_numpy(float), c["o"].to_numpy(float)
    odds = np.log((a + 0.3) / (a.sum() + 1)) - np.log((o + 0.3) / (o.sum() + 1))
    endings = dict(zip(c["ending"], np.clip(odds, -4, 4)))
    # the words that also stand behind a usual given name are families
    given = cut(counted.where("first <> ''").select("first", "word").join(by_word, "word").groupBy("first").agg(F.count_if(F.col("p") > 0).alias("k"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= families))
    firsts = given.select(F.udf(_key, "long", useArrow=True)("first").alias("k"), (F.col("k") / F.col("n")).alias("v"))
    family = by_word.where("p > 0").select(F.udf(fold, "string", useArrow=True)("word").alias("first")).distinct()  # these are no given names
    found = given.where((F.col("k") >= families) & (F.col("k") >= 0.5 * F.col("n"))).select("first").join(family, "first", "left_anti").toPandas()["first"]
    titles = {fold(x) for x in _TITLES} | TITLES
    return endings, GIVEN | {x for x in found if x not in _PARTICLE and x not in titles}, firsts


def _group(c) -> str:
    """Candidates that share a threshold: those of a kind, names by shape alone apart."""
    return "SHAPE" if c[0] == "NAME" and c[3][-1] < 0 else c[0]


class Detector:
    """The fitted model with what it needs; small enough to be broadcast."""

    def __init__(self, endings: dict[str, float], model: Boosted | None, cut_at: dict[str, float], given: frozenset[str] = GIVEN):
        self.endings, self.model, self.cut_at, self.given = endings, model, cut_at, given

    def spans(self, t: str) -> list[tuple[str, int, int]]:
        return self.all_spans([t], [_NONE])[0]

    def all_spans(self, texts: list[str], firsts: list) -> list[list[tuple[str, int, int]]]:
        """The spans of each text, with what it is told of first words; the trees see all candidates at once."""
        each = [candidates(t, self.endings, self.given, f) for t, f in zip(texts, firsts)]
        flat = [x[3] for c in each for x in c]
        if not flat:
            return [[] for _ in texts]
        if self.model is None:
            p = np.array([1.0 if x[4] == 1 else 0.0 for c in each for x in c])
        else:
            p = self.model.prob(np.array(flat))
        ends = np.cumsum([len(c) for c in each])
        return [self._pick(c, p[e - len(c) : e]) for c, e in zip(each, ends)]

    def _pick(self, c, p) -> list[tuple[str, int, int]]:
        kept: list[tuple[str, int, int]] = []
        order = sorted(range(len(c)), key=lambda i: (-round(float(p[i]), 1), -(c[i][2] - c[i][1]), c[i][1], c[i][0]))
        for i in order:
            kind, a, b = c[i][:3]
            if p[i] >= self.cut_at.get(_group(c[i]), 0.5) and all(b <= y or a >= z for _, y, z in kept):
                kept.append((kind, a, b))
        return sorted(kept, key=lambda s: s[1])


def _firsts(pdf: pd.DataFrame, shared) -> list:
    """What each row is told of first words: the broadcast table, or its own share of it."""
    if shared is not None:
        return [shared.value] * len(pdf)
    return [_NONE if k is None else (np.asarray(k, np.int64), np.asarray(v, float)) for k, v in zip(pdf["known_k"], pdf["known_v"])]


def fit(texts: DataFrame, *, sample: int = 4_000, most: int = 200_000, seed: int = 11, broadcast_words: int = 1_000_000):
    """``texts`` with what they are told of first words, its broadcast or None, and the fitted detector.

    At most ``sample`` texts, drawn by hash, give at most ``most`` training candidates.  The table of first words is broadcast
    (16 bytes each) up to ``broadcast_words`` of them and joined to the texts beyond that, with the same result.
    """
    endings, given, firsts = learn(texts)
    texts, shared = attach(texts.withColumn("h", F.xxhash64("text")), firsts, _asked, ["path", "h"], "text", most=broadcast_words)

    def label(batches):
        for pdf in batches:
            rows = [(c[3], c[4] == 1, _group(c)) for s, f in zip(pdf["text"], _firsts(pdf, shared)) for c in candidates(s, endings, given, f) if c[4] >= 0]
            yield pd.DataFrame(rows, columns=["x", "y", "kind"])

    cores = texts.sparkSession.sparkContext.defaultParallelism
    drawn = texts.orderBy(F.xxhash64(F.lit(seed), "text"), "text", "path").limit(sample).repartition(cores)
    rows = drawn.mapInPandas(label, "x array<double>, y boolean, kind string").orderBy(F.xxhash64("x", "kind"), "kind", "y").limit(most).toPandas()
    return texts, shared, _fitted(rows, endings, given, seed)


def _fitted(rows: pd.DataFrame, endings, given, seed: int) -> Detector:
    if len(rows) < 50 or rows["y"].nunique() < 2:
        return Detector(endings, None, {}, given)
    x, y = np.stack(rows["x"].to_numpy()), rows["y"].to_numpy(float)
    held = np.random.default_rng(seed).random(len(y)) < 0.3
    if held.all() or not held.any() or len(set(y[~held])) < 2:
        return Detector(endings, None, {}, given)
    model = Boosted().fit(x[~held], y[~held]).calibrate(x[held], y[held])
    p, cut_at = model.prob(x[held]), {"SHAPE": 0.95}
    for kind in (*TYPES, "SHAPE"):  # the threshold with the best F1 on held-out candidates, nearest to one half
        m = (rows["kind"].to_numpy() == kind)[held]
        if m.any():
            grid = sorted(np.linspace(0.2, 0.8, 13) if kind != "SHAPE" else np.linspace(0.5, 0.95, 10), key=lambda c: abs(c - 0.5))
            score = [2 * ((p[m] >= c) & (y[held][m] > 0)).sum() / max(1, (p[m] >= c).sum() + y[held][m].sum()) for c in grid]
            cut_at[kind] = float(grid[int(np.argmax(np.round(score, 4)))])
    return Detector(endings, model, cut_at, given)


def _texts(payloads: DataFrame) -> DataFrame:
    return payloads.where("path is not null and length(text) > 0").select("path", "text").dropDuplicates(["path", "text"])


def find(payloads: DataFrame, *, sample: int = 4_000) -> DataFrame:
    """path, entity, char_from, char_to, text of every item found, in code points from 0.

    Rows with a null path or text and empty texts give none; repeated rows count once; a path with two texts
    gives the items of both; other columns are ignored whatever their names; an empty table gives no rows.
    Where there are too few certain candidates to fit trees, the certain ones alone are kept.
    """
    t, firsts, detector = fit(spread(cut(_texts(payloads))), sample=sample)
    shared = payloads.sparkSession.sparkContext.broadcast(detector)

    def run(batches):
        det = shared.value
        for pdf in batches:
            found = det.all_spans(pdf["text"].tolist(), _firsts(pdf, firsts))
            rows = [(p, k, a, b, s[a:b]) for p, s, f in zip(pdf["path"], pdf["text"], found) for k, a, b in f]
            yield pd.DataFrame(rows, columns=["path", "entity", "char_from", "char_to", "text"])

    return t.mapInPandas(run, SCHEMA)


def redact(payloads: DataFrame, *, sample: int = 4_000) -> DataFrame:
    """path, text with each item replaced by its type in brackets; everything else is kept as it is."""
    t, firsts, detector = fit(spread(cut(_texts(payloads))), sample=sample)
    shared = payloads.sparkSession.sparkContext.broadcast(detector)

    def run(batches):
        det = shared.value
        for pdf in batches:
            out = []
            for s, found in zip(pdf["text"], det.all_spans(pdf["text"].tolist(), _firsts(pdf, firsts))):
                parts, at = [], 0
                for k, a, b in found:
                    parts += [s[at:a], f"[{k}]"]
                    at = b
                out.append("".join(parts) + s[at:])
            yield pd.DataFrame({"path": pdf["path"], "text": out})

    return t.mapInPandas(run, "path string, text string")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return find(read(spark, d, "payloads")).select("path", "entity", "char_from", "char_to").distinct()


def p7_redacted(spark: SparkSession, d: str) -> DataFrame:
    return redact(read(spark, d, "payloads"))


QUERIES = {"p7_found": p7_found, "p7_redacted": p7_redacted}
SQL: dict[str, str] = {}
