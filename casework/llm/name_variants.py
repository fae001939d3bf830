"""Variant spellings of names typed by people (problem 5).

Method: trie join.  Every distinct string is read as an organisation or as a person's family name with a
given name, initials or an abbreviation, in any token order.  The family names (and firms) are sharded by
their first and by their last letters, each shard becomes a trie, and a Levenshtein automaton walks it with
every name of the shard, so all neighbours within one edit (insertion, deletion, substitution or swap of
adjacent letters) are enumerated without comparing pairs.  Neighbours are then linked where their given
names agree: the same, a nickname, an abbreviation, initials, or one edit apart.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from casework.llm.common import connected, cut, read

# Common given names of several languages and their usual short forms.
NICKNAMES = {
    "abigail": "abby gail", "abraham": "abe", "adelaide": "addie", "agnes": "aggie nessa", "albert": "al bert bertie", "alejandro": "alex ale jandro", "alexander": "alex al sandy sasha xander lex",
    "alexandra": "alex sandra sasha lexi", "alfred": "alf alfie fred", "alice": "ali allie", "alicia": "ali licia", "allison": "allie ali", "amanda": "mandy manda", "amelia": "amy millie", "andrea": "andi", "andrew": "andy drew",
    "angela": "angie", "anna": "annie nan", "anthony": "tony", "antonio": "tonio toni", "archibald": "archie", "arnold": "arnie", "arthur": "art artie", "barbara": "barb barbie babs", "bartholomew": "bart",
    "beatrice": "bea trixie", "benjamin": "ben benny benji", "bernard": "bernie", "bradley": "brad", "bridget": "biddy bridie", "calvin": "cal", "cameron": "cam", "carlos": "charly carlitos", "caroline": "carrie caro lina",
    "cassandra": "cassie sandra", "catherine": "cathy cate cat kitty", "cecilia": "cece celia cissy", "charles": "charlie chuck charley chas", "charlotte": "lottie charlie", "christina": "chris tina chrissy",
    "christine": "chris tina chrissy", "christopher": "chris kit", "clarence": "clare", "clifford": "cliff", "clinton": "clint", "constance": "connie", "cornelius": "neil corny", "curtis": "curt", "cynthia": "cindy",
    "daniel": "dan danny", "daniela": "dani", "david": "dave davey", "deborah": "deb debbie", "dennis": "denny", "dolores": "lola dolly lolita", "dominic": "dom nick", "donald": "don donny", "dorothy": "dot dottie dotty dolly dora", "douglas": "doug",
    "edmund": "ed ned", "eduardo": "edu lalo", "edward": "ed eddie ned ted teddy", "edwin": "ed", "eleanor": "ellie nell nora", "elizabeth": "liz beth betty eliza lizzie libby betsy bess", "ellen": "nell nellie", "emily": "em emmy",
    "enrique": "quique kike", "ernest": "ernie", "esther": "essie", "eugene": "gene", "evelyn": "evie", "ferdinand": "ferdi", "fernando": "nando", "florence": "flo florrie", "frances": "fran frannie", "francisco": "paco pancho", "francis": "frank", "francoise": "fran fanchon fanfan",
    "franklin": "frank", "franziska": "franzi", "frederick": "fred freddy freddie", "friedrich": "fritz", "gabriel": "gabe", "gabriela": "gabi", "geoffrey": "geoff jeff", "george": "georgie", "gerald": "gerry jerry", "gertrude": "gertie trudy", "gilbert": "gil", "giovanni": "gianni", "gregory": "greg",
    "guadalupe": "lupe", "guillaume": "gui", "guillermo": "memo guille", "hans": "hansi", "harold": "harry hal", "heinrich": "heinz heiner", "helen": "nell nellie", "helene": "lena helen nell", "henrietta": "etta hattie hetty", "henry": "hank harry", "herbert": "herb", "howard": "howie",
    "ignacio": "nacho iggy", "ines": "", "irene": "rena", "isaac": "ike", "isabella": "bella izzy isa belle", "jacob": "jake", "jacqueline": "jackie", "james": "jim jimmy jamie", "janet": "jan", "jeffrey": "jeff", "jennifer": "jen jenny", "jeremy": "jerry", "jerome": "jerry", "jessica": "jess jessie",
    "joan": "joanie", "johannes": "hannes", "john": "jack johnny", "jonathan": "jon jonny", "jose": "pepe", "joseph": "joe joey", "josephine": "jo josie josy", "joshua": "josh", "judith": "judy", "julia": "jules", "jurgen": "jorg jogi", "katherine": "kate kathy katie kat kitty kit kay", "kenneth": "ken kenny",
    "kimberly": "kim", "lawrence": "larry laurie", "leonard": "len leo lenny", "leopold": "leo poldi", "lillian": "lily", "louis": "lou louie", "lucille": "lucy", "manuel": "manny manolo", "margaret": "maggie meg peg peggy marge greta", "maria": "marie mari", "martin": "marty", "martha": "marty mattie",
    "matthew": "matt", "maximilian": "max", "michael": "mike mick mickey", "michelle": "shelly", "mohammed": "mo", "nancy": "nan", "nathaniel": "nate nat nathan", "nicholas": "nick nicky", "oliver": "ollie", "oluwaseun": "seun", "pamela": "pam", "patricia": "pat patty trish tricia", "patrick": "paddy rick",
    "peter": "pete", "philip": "phil pip", "priyanka": "priya", "quentin": "quin quen", "rachel": "rach", "raymond": "ray", "rebecca": "becky becca", "richard": "rich rick dick", "robert": "bob bobby rob robbie bert", "roberto": "beto", "ronald": "ron ronnie", "samantha": "sam", "samuel": "sam sammy",
    "sebastian": "seb basti", "stephen": "steve", "steven": "steve", "susan": "sue susie suzy", "theodore": "theo ted teddy", "theresa": "terry tess", "thomas": "tom tommy", "timothy": "tim timmy", "ulrike": "uli ulli rike", "valerie": "val", "victor": "vic", "victoria": "vicky vic tori vickie", "vincent": "vince vinny",
    "walter": "walt wally", "wei": "", "wilhelm": "willi", "william": "bill billy will liam willie", "yevgenia": "zhenya genia jenya", "zachary": "zach zack zac",
}
PLACEHOLDER = re.compile(
    r"^\W*(none|n\W?a|nil|null|unknown|unassigned|tbd|blank|anonymous|undisclosed( recipients)?|illegible|redacted|various|not available|"
    r"no author|author unknown|see attached)\W*$|\b(distribution list|all (site )?staff|mailing list|scanner|copier|printer|mailbox|"
    r"system account|administrator|no.?reply|help ?desk|shared drive|do not reply)\b",
    re.I,
)
ORG = re.compile(
    r"[&+]|\b(llp|llc|l\.\s?l\.\s?p|l\.\s?l\.\s?c|ltd|plc|inc|incorporated|corp|corporation|company|gmbh|s\.a|int'?l|intl|international|"
    r"law offices?|assoc|associates|holdings|group|partners|solicitors|attorneys at law)\b",
    re.I,
)
ORG_WORDS = set(
    "llp llc l p c ltd plc inc incorporated corp corporation company co gmbh s a int intl international law office offices of the and "
    "assoc associates holdings group partners solicitors attorneys at".split()
)
TITLES = set("dr mr mrs ms miss prof professor hon judge sir esq esquire jr sr ii iii phd md atty".split())
_SHORT: dict[str, list[str]] = {}
for _full, _nicks in NICKNAMES.items():
    _SHORT.setdefault(_full, []).append(_full)
    for _n in _nicks.split():
        _SHORT.setdefault(_n, []).append(_full)


def fold(s: str) -> str:
    """Lower case without accents."""
    return "".join(c for c in unicodedata.normalize("NFKD", s.lower()) if not unicodedata.combining(c)).replace("ß", "ss").replace("ø", "o")


def sound(t: str) -> str:
    """A family name with its usual confusions taken out: ph/f, ck/k, y/i, w/v, doubled letters."""
    t = t.replace("ph", "f").replace("ck", "k").replace("y", "i").replace("w", "v")
    return re.sub(r"(.)\1+", r"\1", t)


class Trie:
    """A trie with a Levenshtein automaton over it."""

    def __init__(self, tokens):
        self.root: dict = {}
        for t in tokens:
            node = self.root
            for c in t:
                node = node.setdefault(c, {})
            node[""] = t

    def within_one(self, q: str) -> dict[str, int]:
        """Tokens within one edit (with adjacent swaps) of ``q``, with the distance.

        A state is (node, letters of q read, edits made); every step follows the trie, so the work depends on
        the branches near ``q`` and not on the number of tokens.
        """
        found: dict[str, int] = {}
        n = len(q)
        stack = [(self.root, 0, 0)]
        while stack:
            node, i, e = stack.pop()
            if i == n and "" in node:
                t = node[""]
                found[t] = min(e, found.get(t, 9))
            if i < n and q[i] in node:
                stack.append((node[q[i]], i + 1, e))
            if e == 0:
                if i < n:
                    stack.append((node, i + 1, 1))
                for c, child in node.items():
                    if c:
                        stack.append((child, i, 1))
                        if i < n and c != q[i]:
                            stack.append((child, i + 1, 1))
                if i + 1 < n and q[i] != q[i + 1] and q[i + 1] in node and q[i] in node[q[i + 1]]:
                    stack.append((node[q[i + 1]][q[i]], i + 2, 1))
        return found


def strip(s: str) -> tuple[str, bool]:
    """The name without address, affiliation, title; and whether it is typed like a folder or login."""
    t = re.sub(r"<[^>]*>|\([^)]*\)|\[[^\]]*\]", " ", s).replace('"', " ").strip()
    t = re.sub(r"\s+-\s+.*$", " ", t)
    t = re.sub(r"(?i),?\s*\b(esq|esquire|ph\.?d|jr|sr)\b\.?", " ", t).strip(" ,;")
    login = bool(re.fullmatch(r"\S+", t)) and not re.search(r"[A-Z][a-z]", t) or "_" in t or bool(re.fullmatch(r"[a-z]+[.-][a-z]+", t))
    t = re.sub(r"(?i)_(old|new|bak|archive|\d+)$", "", t)
    return t, login


def bare(s: str) -> str:
    """The name without addresses and affiliations."""
    return re.sub(r"<[^>]*>|\([^)]*\)|\s-\s.*$", " ", s)


def roots(s: str) -> list[str]:
    """The words that make an organisation's name."""
    return [x for x in tokens_of(bare(s)) if x not in ORG_WORDS and len(x) > 1]


def tokens_of(t: str) -> list[str]:
    return re.findall(r"[^\W\d_]+", re.sub(r"(?<=\w)['’](?=\w)", "", fold(t)))


def family_first(t: str) -> tuple[list[str], list[str]] | None:
    """(family, given) tokens of ``Family, Given``."""
    m = re.fullmatch(r"([^,]+?)\s*,\s*([^,]+)", t.strip())
    return (tokens_of(m[1]), tokens_of(m[2])) if m else None


def given_evidence(s: str) -> tuple[str, str] | None:
    """(given, family) where the form tells which is which: ``Family, Given``, one word each."""
    if PLACEHOLDER.search(s) or ORG.search(bare(s)):
        return None
    t, _ = strip(s)
    fg = family_first(t)
    if not fg or len(fg[0]) != 1:
        return None
    g = [x for x in fg[1] if len(x) > 1 and x not in TITLES]
    return (g[0], sound(fg[0][0])) if len(g) == 1 and len(fg[0][0]) > 2 else None


def parse(s: str, known: Trie) -> list[tuple[str, str, str, bool]]:
    """Readings of a string: (kind, family key, given, partial).

    ``given`` is a full given name, or, where ``partial``, the options separated by blanks: beginnings of a
    given name.  A login of one word has two readings, with the initial in front and at the end.
    """
    if s is None or PLACEHOLDER.search(s):
        return []
    if ORG.search(bare(s)):
        t = roots(s)
        return [("org", "".join(t), "", False)] if t else []
    t, login = strip(s)
    toks = [x for x in tokens_of(t) if x not in TITLES]
    long_ = [x for x in toks if len(x) > 1]
    initials = [x for x in toks if len(x) == 1]
    if not long_:
        return []
    short = {fold(x) for x in re.findall(r"\b([^\W\d_]{2,4})\.", t)}  # abbreviations carry their dot

    def full(x: str) -> list[str]:
        if x in _SHORT:
            return _SHORT[x]
        near = known.within_one(x) if len(x) > 3 else ({x: 0} if x in known.within_one(x) else {})
        if x in near:
            return _SHORT.get(x, [x])
        return sorted({f for n in near for f in _SHORT.get(n, [n])}) if near else []

    def reading(family: list[str], given: str | None, initial: str | None):
        key = "".join(family)
        if given is None:
            return ("person", key, initial or "", True)
        if given in short:  # an abbreviation of any name that begins so, or a short form with a dot behind it
            return ("person", key, " ".join(dict.fromkeys([given, *_SHORT.get(given, [])])), True)
        f = full(given)
        if len(f) == 1:
            return ("person", key, f[0], False)
        return ("person", key, " ".join(f), True) if f else ("person", key, given, False)

    if len(long_) == 1:
        fam = long_[0]
        if initials:
            return [reading([fam], None, initials[0])]
        # letters typed together after a comma: "Borpagohim, I.T." gives initials above; a login is left
        if login and len(fam) > 5:
            return [("person", fam[1:], fam[0], True), ("person", fam[:-1], fam[-1], True)]
        return []
    fg = family_first(t)
    if fg and fg[0]:
        g = [x for x in fg[1] if len(x) > 1]
        i = [x for x in fg[1] if len(x) == 1]
        fam = [x for x in fg[0] if len(x) > 1]
        if fam and (g or i):
            # "  Family ,Given" and "Family, Given" alike; a known given name in front turns it round
            if g and len(fam) == 1 and fam[0] in _SHORT and not full(g[0]):
                return [reading(g, fam[0], None)]
            return [reading(fam, g[0] if g else None, i[0] if i else None)]
    sure = [x for x in long_ if x in short or x in _SHORT or x in known.within_one(x)]
    given = sure[0] if sure else next((x for x in long_ if full(x)), None)
    if given is None:
        given = long_[-1] if "_" in s else long_[0]
    rest = list(long_)
    rest.remove(given)
    return [reading(rest, given, None)]


PART = 2_000  # indexed tokens in a trie at most
ASKING = 20_000  # tokens that ask it in one task, about


def _keys(t: str) -> list[str]:
    """Shards of a token, by its first and its last ``k`` letters, where 2 k < length.

    One edit, be it a swap, lies outside of the first or of the last ``k`` letters.  Two tokens one edit apart are of one length
    or of neighbouring ones, so each is filed with the ``k`` of its own length and of the one below.  Tokens of up to three
    letters also share a shard.
    """
    n = len(t)
    ks = {(n - 1) // 2, (n - 2) // 2} - {0, -1}
    return sorted({f"{k}<{t[:k]}" for k in ks} | {f"{k}>{t[-k:]}" for k in ks} | ({"short"} if n <= 3 else set()))


def _walk_shard(pdf: pd.DataFrame) -> pd.DataFrame:
    rows = set()
    for _, part in pdf.groupby(["shard", "part"], sort=False):
        mine = part[part["role"] == 1]["token"]
        if len(mine):
            trie = Trie(mine)
            rows.update((t, o, d) for t in part[part["role"] == 0]["token"] for o, d in trie.within_one(t).items())
    return pd.DataFrame(sorted(rows), columns=["token", "other", "dist"])


def trie_join(tokens: DataFrame) -> DataFrame:
    """token, other, dist (0 or 1): the indexed tokens within one edit of each token.

    ``tokens``: token string (distinct), indexed boolean.  A shard of more than ``PART`` indexed tokens is split by hash into
    tries that all its tokens ask, and these are dealt to several tasks; small shards share a task.
    """
    keys = F.udf(_keys, "array<string>", useArrow=True)
    sharded = cut(tokens.select("token", "indexed", F.explode(keys("token")).alias("shard")))
    load = sharded.groupBy("shard").agg(F.count_if("indexed").alias("held"), F.count(F.lit(1)).alias("n")).where("held > 0 and n > 1")
    load = load.select("shard", F.ceil(F.col("held") / PART).cast("int").alias("parts"), F.ceil(F.col("n") / ASKING).cast("int").alias("shares"))
    s = sharded.join(load, "shard")
    numbers = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    held = s.where("indexed").withColumn("part", F.pmod(F.xxhash64("token"), F.col("parts")).cast("int"))
    held = held.select("shard", "part", numbers("shares").alias("share"), F.lit(1).alias("role"), "token")
    asking = s.withColumn("share", F.pmod(F.xxhash64("token", F.lit(1)), F.col("shares")).cast("int"))
    asking = asking.select("shard", numbers("parts").alias("part"), "share", F.lit(0).alias("role"), "token")
    both = held.unionByName(asking)
    calls = max(1, sharded.count() // ASKING) * 8
    both = both.withColumn("call", F.pmod(F.xxhash64("shard", "part", "share"), F.lit(calls)))
    near = both.groupBy("call").applyInPandas(_walk_shard, "token string, other string, dist int")
    own = tokens.where("indexed").select("token", F.col("token").alias("other"), F.lit(0).alias("dist"))  # also of shards with one token
    return near.unionByName(own).groupBy("token", "other").agg(F.min("dist").alias("dist"))


def neighbours(tokens: DataFrame) -> DataFrame:
    """As ``trie_join``, as spelled and as sounded: a pair counts with its least distance, 1 if the spelling differs."""
    heard = F.udf(sound, "string", useArrow=True)
    said = cut(tokens.withColumn("s", heard("token")))
    by_sound = trie_join(said.groupBy(F.col("s").alias("token")).agg(F.max("indexed").alias("indexed")))
    alike = (
        said.select("token", "s")
        .join(by_sound.select(F.col("token").alias("s"), F.col("other").alias("t")), "s")
        .join(said.where("indexed").select(F.col("token").alias("other"), F.col("s").alias("t")), "t")
        .select("token", "other", F.when(F.col("token") == F.col("other"), 0).otherwise(1).alias("dist"))
    )
    return trie_join(tokens).unionByName(alike).groupBy("token", "other").agg(F.min("dist").alias("dist"))


def given_names(strings: DataFrame, *, least: int = 3) -> DataFrame:
    """given: what stands as a given name in ``Family, Given`` forms (column name) with ``least`` families or more."""

    def evidence(batches):
        for pdf in batches:
            rows = [e for e in map(given_evidence, pdf["name"]) if e]
            yield pd.DataFrame(rows, columns=["given", "family"])

    return strings.mapInPandas(evidence, "given string, family string").groupBy("given").agg(F.countDistinct("family").alias("n")).where(F.col("n") >= least).select("given")


def link_names(names: DataFrame, *, strong: int = 3) -> DataFrame:
    """name, entity: the distinct strings of ``names`` (one string column) that name somebody.

    ``entity`` is the least string of the class.  Null and empty strings and placeholders are left out; repeated
    rows count once; an empty table gives no rows.  Given names are learned from ``Family, Given`` forms:
    those met with three families or more, besides the usual ones; they are at the driver and broadcast, and
    as a language has only so many given names, their number is bounded by the languages and not by the rows.  Two family names one edit apart are taken for one unless each is spelled so in ``strong``
    strings with that given name.
    """
    spark = names.sparkSession
    col = names.columns[0]
    strings = cut(names.select(F.col(col).cast("string").alias("name")).where("length(trim(name)) > 0").distinct())

    learned = given_names(strings)
    known = sorted({r["given"] for r in learned.collect()} | set(_SHORT))

    def read_names(batches):
        trie = Trie(known)
        for pdf in batches:
            rows = [(s, *r) for s in pdf["name"] for r in parse(s, trie)]
            yield pd.DataFrame(rows, columns=["name", "kind", "family", "given", "partial"])

    parsed = cut(strings.mapInPandas(read_names, "name string, kind string, family string, given string, partial boolean").where("family <> ''"))
    full = parsed.where("not partial")
    nodes = cut(full.groupBy("kind", "family", "given").agg(F.count(F.lit(1)).alias("n"), F.min("name").alias("least")))
    spelled = full.select(F.concat_ws(":", "kind", "family").alias("token"), F.lit(True).alias("indexed"))
    asked = parsed.select(F.concat_ws(":", "kind", "family").alias("token"), F.lit(False).alias("indexed"))
    # a family that is only known with an initial is indexed too, unless it comes from a login's two readings
    twice = Window.partitionBy("name")
    sole = parsed.withColumn("r", F.count(F.lit(1)).over(twice)).where("partial and r = 1")
    spelled = spelled.unionByName(sole.select(F.concat_ws(":", "kind", "family").alias("token"), F.lit(True).alias("indexed")))
    tokens = spelled.unionByName(asked).groupBy("token").agg(F.max("indexed").alias("indexed"))
    fam = F.split_part("token", F.lit(":"), F.lit(2))
    near = cut(neighbours(tokens.select(fam.alias("token"), "indexed").groupBy("token").agg(F.max("indexed").alias("indexed"))))
    # spellings of one full name
    a = nodes.select("kind", F.col("family").alias("fa"), "given", F.col("n").alias("na"), F.col("least").alias("a"))
    b = nodes.select("kind", F.col("family").alias("fb"), "given", F.col("n").alias("nb"), F.col("least").alias("b"))
    same = (
        a.join(near.where("dist = 1").select(F.col("token").alias("fa"), F.col("other").alias("fb")), "fa")
        .join(b, ["kind", "given", "fb"])
        .where(F.least("na", "nb") < strong)
        .select("a", "b")
    )
    # firms of two names: each within one edit, in either order
    pair = F.udf(lambda n: roots(n) if len(roots(n)) == 2 else None, "array<string>", useArrow=True)
    firms = cut(full.where("kind = 'org'").groupBy("family").agg(F.min("name").alias("least")).withColumn("r", pair("least")).where("r is not null"))
    ends = cut(neighbours(firms.select(F.explode("r").alias("token")).distinct().withColumn("indexed", F.lit(True))).select("token", "other"))
    x = firms.select(F.col("least").alias("a"), F.col("r")[0].alias("a0"), F.col("r")[1].alias("a1"))
    turned = [firms.select(F.col("least").alias("b"), F.col("r")[i].alias("b0"), F.col("r")[1 - i].alias("b1")) for i in (0, 1)]
    y = turned[0].unionByName(turned[1])
    alike = (
        x.join(ends.select(F.col("token").alias("a0"), F.col("other").alias("b0")), "a0")
        .join(y, "b0")
        .join(ends.select(F.col("token").alias("a1"), F.col("other").alias("b1")), ["a1", "b1"])
        .where("a <> b")
        .select("a", "b")
    )
    same = same.unionByName(alike)
    own = full.join(nodes.select("kind", "family", "given", "least"), ["kind", "family", "given"])
    edges = own.select(F.col("name").alias("a"), F.col("least").alias("b")).unionByName(same)
    # initials and short forms: the full name with the nearest family, then the one with most spellings
    part = parsed.where("partial").select("name", "kind", "family", F.explode(F.split("given", " ")).alias("p"))
    hit = (
        part.join(near.select(F.col("token").alias("family"), F.col("other").alias("fb"), "dist"), "family")
        .join(nodes.select("kind", F.col("family").alias("fb"), F.col("given").alias("g"), "n", "least"), ["kind", "fb"])
        .where(F.expr("startswith(g, p)"))
    )
    first = hit.groupBy("name").agg(F.min(F.struct("dist", (-F.col("n")).alias("m"), "least")).alias("h")).select("name", "h.least")
    first = cut(first)
    edges = edges.unionByName(first.select(F.col("name").alias("a"), F.col("least").alias("b")))
    # what has no full name: the same family and first letter
    left = sole.join(first.select("name"), "name", "left_anti").select("name", "kind", "family", F.substring("given", 1, 1).alias("i"))
    lead = left.groupBy("kind", "family", "i").agg(F.min("name").alias("least"))
    lone = left.join(lead, ["kind", "family", "i"]).select(F.col("name").alias("a"), F.col("least").alias("b"))
    x = lead.select("kind", F.col("family").alias("fa"), "i", F.col("least").alias("a"))
    y = lead.select("kind", F.col("family").alias("fb"), "i", F.col("least").alias("b"))
    akin = x.join(near.where("dist = 1").select(F.col("token").alias("fa"), F.col("other").alias("fb")), "fa").join(y, ["kind", "i", "fb"]).select("a", "b")
    # logins that met none of the full names: those that are only known with the initial
    bare = parsed.withColumn("r", F.count(F.lit(1)).over(twice)).where("partial and r = 2").join(first.select("name"), "name", "left_anti")
    bare = (
        bare.join(near.select(F.col("token").alias("family"), F.col("other").alias("fb"), "dist"), "family")
        .join(lead.select("kind", F.col("family").alias("fb"), F.col("i").alias("given"), "least"), ["kind", "fb", "given"])
        .groupBy("name")
        .agg(F.min(F.struct("dist", "least")).alias("h"))
        .select(F.col("name").alias("a"), F.col("h.least").alias("b"))
    )
    edges = cut(edges.unionByName(lone).unionByName(akin).unionByName(bare))
    comp = connected(edges, "a", "b").withColumnRenamed("node", "name")
    some = parsed.select("name").distinct()
    return some.join(comp, "name", "left").select("name", F.coalesce("component", "name").alias("entity"))


def names_of(spark: SparkSession, d: str) -> DataFrame:
    """All strings of the four fields."""
    log, lists, manifest = (read(spark, d, t) for t in ("privilege_log", "attorney_list", "manifest"))
    return (
        log.select(F.col("from_author").alias("name"))
        .unionAll(log.select(F.explode("to_names")))
        .unionAll(lists.select(F.explode("attorneys")))
        .unionAll(manifest.select("custodian"))
        .distinct()
    )


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    e = cut(link_names(names_of(spark, d)))
    a = e.select(F.col("name").alias("name_a"), "entity")
    b = e.select(F.col("name").alias("name_b"), "entity")
    return a.join(b, "entity").where("name_a < name_b").select("name_a", "name_b")


def p5_entities(spark: SparkSession, d: str) -> DataFrame:
    return link_names(names_of(spark, d))


QUERIES = {"p5_found": p5_found, "p5_entities": p5_entities}
SQL: dict[str, str] = {}
