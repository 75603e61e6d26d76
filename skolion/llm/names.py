"""Variant spellings of people and organisations: which spellings mean the same one.

Every spelling is read into given name, initials and surname (or words and place), with case, accents, titles and
order undone; spellings that read the same are one node, and nothing else is put together by a key. Nodes become
candidates where MinHash bands over padded q-grams of one part of the name collide under another part as salt; a
candidate pair is kept if its Monge-Elkan similarity is high, its letters differ by one slip at most, and the two
forms aren't both names of their own; and star clustering assigns each node to the best of the names that it may
be a form of.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from types import SimpleNamespace
from typing import TYPE_CHECKING

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise, spread

if TYPE_CHECKING:
    import pandas as pd

# Nicknames and the names they stand for.
NICKNAMES = {
    "alexander": "alex al sasha sascha xander sandy", "benjamin": "ben benny benji", "christopher": "chris kit topher", "daniel": "dan danny", "dmitri": "dima mitya dmitry",
    "edward": "ed eddie ned ted teddy", "ekaterina": "katya katia", "elizabeth": "liz beth betty lizzie eliza bess libby", "francisco": "paco pancho kiko curro", "frederik": "fred freddy fritz rik",
    "giuseppe": "beppe peppe pino peppino", "gregory": "greg", "jennifer": "jen jenny jenn", "johannes": "hannes hans jan joh", "josephine": "josie jo fifi", "katherine": "kate kathy katie kat kay",
    "lorenzo": "renzo enzo", "margaret": "maggie peggy meg marge greta", "michael": "mike mick mickey", "mikhail": "misha", "nadia": "nadya", "nicholas": "nick nicky klaus", "oluwaseun": "seun", "patricia": "pat patty trish tricia",
    "priyanka": "pri", "rebecca": "becky becca", "richard": "dick rick rich richie ricky", "robert": "bob rob bobby robbie bert", "samuel": "sam sammy", "susanna": "sue susie sanna susan", "tadeusz": "tadek",
    "theodore": "theo ted teddy", "thomas": "tom tommy", "timothy": "tim timmy", "ulrike": "uli ulli rike", "victoria": "vicky vicki tori", "wilhelmina": "mina willa minnie", "william": "will bill billy willy liam", "zuzana": "zuzka zuza",
    "james": "jim jimmy jamie", "john": "jack johnny", "joseph": "joe joey", "charles": "charlie chuck", "henry": "harry hank", "andrew": "andy drew", "anthony": "tony", "matthew": "matt", "stephen": "steve", "david": "dave", "maria": "masha", "ivan": "vanya",
    "vladimir": "volodya vova", "natalia": "natasha", "tatiana": "tanya", "sergei": "seryozha", "jose": "pepe", "ignacio": "nacho", "guadalupe": "lupe", "giovanni": "gianni vanni", "luigi": "gigi", "deborah": "debbie", "barbara": "barb", "dorothy": "dot dolly", "helen": "nell",
    "eleanor": "nora ellie", "abigail": "abby", "gabriel": "gabe", "lawrence": "larry", "leonard": "leo len", "philip": "phil", "raymond": "ray", "ronald": "ron", "donald": "don", "kenneth": "ken", "jacob": "jake", "joshua": "josh", "zachary": "zach",
}
# Kinds of organisations with their abbreviations, and words between.
TYPES = {
    "university": "univ uni", "institute": "inst institut", "centre": "center ctr cent", "academy": "acad", "laboratory": "lab labs", "consortium": "cons consort", "college": "coll", "school": "sch",
    "department": "dept", "society": "soc", "association": "assoc", "foundation": "found", "agency": "", "council": "", "company": "co corp inc ltd gmbh", "ministry": "min", "faculty": "fac",
}
BETWEEN = frozenset("the of for and de la le der die das und et y".split())
TITLES = re.compile(r"^(?:(?:dr|prof|professor|mr|mrs|ms|miss|sir)\b\.?\s+)+", re.IGNORECASE)

_TYPE = {a: t for t, short in TYPES.items() for a in [t, *short.split()]}
_LETTERS = str.maketrans({"ø": "o", "ł": "l", "ß": "ss", "æ": "ae", "œ": "oe", "đ": "d", "ð": "d", "þ": "th", "ı": "i"})
_SPELLED = str.maketrans({"ä": "ae", "ö": "oe", "ü": "ue", "å": "aa", "ø": "oe"})
_INITIALS = re.compile(r"^(?:[^\W\d_]\.-?){1,4}$|^[^\W\d_]\.?$")


def met(df: DataFrame) -> DataFrame:
    """df as the right side of a join with a table that grows with the names: by sorting, never sent through the
    driver. Sizes are estimated from compressed names, and what is banded or paired is many times as large."""
    return df.hint("merge")


def fold(s: str) -> str:
    """Lower case without accents."""
    s = unicodedata.normalize("NFKD", s.lower().translate(_LETTERS))
    return "".join(c for c in s if not unicodedata.combining(c))


def forms(s: str) -> list[str]:
    """A word folded to plain letters; and, where it has an umlaut, also with the letters that stand for umlauts."""
    low = s.lower()
    return list(dict.fromkeys(plain(fold(x)) for x in (low, unicodedata.normalize("NFC", low).translate(_SPELLED))))


_NICK: dict[str, list[str]] = {}
for _name, _nicks in NICKNAMES.items():
    for _n in _nicks.split():
        _NICK.setdefault(fold(_n), []).append(fold(_name))


def plain(s: str) -> str:
    return re.sub(r"[^a-z0-9]", "", s)


@lru_cache(maxsize=100_000)
def slips(a: str, b: str, most: int = 3) -> int:
    """Letters inserted, dropped, replaced or swapped with their neighbour between a and b; most + 1 if more."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            v = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y))
            if before and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, before[j - 2] + 1)
            new.append(v)
        before, row = row, new
        if min(row) > most:
            return most + 1
    return min(row[-1], most + 1)


def token_similarity(a: str, b: str) -> float:
    """1 for equal words and for an initial or a shortening of the other; else the share of letters without a slip."""
    if a == b or (min(len(a), len(b)) in (1, *range(3, 9)) and (a.startswith(b) or b.startswith(a))):
        return 1.0
    return 1 - slips(a, b) / max(len(a), len(b)) if a and b else 0.0


def monge_elkan(a: list[str], b: list[str]) -> float:
    """The mean over the words of the shorter name of their best similarity in the other; symmetric by that choice."""
    if not a or not b:
        return 0.0
    if (len(a), a) > (len(b), b):
        a, b = b, a
    return sum(max(token_similarity(x, y) for y in b) for x in a) / len(a)


@dataclass(frozen=True)
class Read:
    """kind p: given names that the first word may stand for (itself first, with an umlaut's other notation, then the
    names it is a nickname of), initials, and notations of the surname. Kind o: the words of the name, their
    initials, and notations of the place."""

    kind: str
    givens: tuple[str, ...]
    initials: str
    surnames: tuple[str, ...]
    nick: bool = False

    @property
    def node(self) -> str:
        return "|".join([self.kind, " ".join(self.givens), self.initials, *self.surnames])


def _organisation(raw: str) -> Read | None:
    head, _, tail = raw.partition(",")
    words = [w for w in re.split(r"[\s.]+", head) if w]
    low = [fold(w) for w in words]
    typed = any(w in _TYPE for w in low)
    short = len(words) == 2 and not tail and re.fullmatch(r"[A-Z]{3,5}", words[1]) and not words[0].isupper() and len(words[0]) > 2
    if not (typed or short or any(w in ("of", "for") for w in low[1:])):
        return None
    if short and not typed:
        return Read("o", (), words[1].lower(), tuple(forms(words[0])))
    rest = [w for w in words if fold(w) not in BETWEEN]
    place = tail if tail.strip() else (rest.pop(0) if rest and fold(rest[0]) not in _TYPE else "")
    names = tuple(_TYPE.get(fold(w), plain(fold(w))) for w in rest)
    names = tuple(w for w in names if w)
    return Read("o", names, "".join(w[0] for w in names), tuple(forms(place))) if names else None


def _person(given: list[str], initials: list[str], surname: list[str]) -> Read:
    letters = "".join(c for i in initials for c in fold(i) if c.isalpha())
    first = forms(given[0]) if given else []
    nicks = [n for f in first for n in _NICK.get(f, [])]
    return Read("p", tuple(dict.fromkeys([*first, *nicks])), letters, tuple(forms("".join(surname))), bool(nicks))


def read(spelling: str) -> tuple[Read, Read | None, str, str]:
    """The reading of a spelling; a second one with the surname first where the order is open, and the first and
    last words that decide it."""
    raw = TITLES.sub("", re.sub(r"\s+", " ", spelling.strip().strip('"')))
    if org := _organisation(raw):
        return org, None, "", ""
    if "," in raw:
        last, _, first = raw.partition(",")
        tokens = first.split()
        small = [bool(_INITIALS.match(t) or re.fullmatch(r"[A-Z]{2}", t)) for t in tokens]
        full, initials, surname = [t.strip(".") for t, s in zip(tokens, small) if not s], [t for t, s in zip(tokens, small) if s], last.split()
        return _person(full, initials, surname), None, fold(full[0]) if full else "", fold(surname[-1]) if surname else ""
    tokens = raw.split()
    small = [bool(_INITIALS.match(t) or re.fullmatch(r"[A-Z]{2}", t)) for t in tokens]
    full, initials = [t.strip(".") for t, s in zip(tokens, small) if not s], [t for t, s in zip(tokens, small) if s]
    if len(full) < 2:
        return _person([], initials, full), None, "", fold(full[0]) if full else ""
    if small[0]:  # J. M. First Last or J. Double Surname: initials come first, all words are the surname
        return _person([], initials, full), None, "", fold(full[-1])
    ahead = _person(full[:1], initials, full[1:])
    if small[1]:  # First M. Last
        return ahead, None, fold(full[0]), fold(full[-1])
    return ahead, _person(full[-1:], initials, full[:-1]), fold(full[0]), fold(full[-1])


def bands_for(similarity: float, recall: float, rows: int) -> int:
    """Bands of `rows` minima so that sets of the given similarity collide with the given probability."""
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))


@dataclass(frozen=True)
class Banding:
    """Similarity of padded q-grams that must still be found, with which probability; rows a band. Two letters
    swapped in a word of six leave 0.4 of its padded pairs of letters, one replaced leaves 0.56."""

    similarity: float = 0.4
    recall: float = 0.98
    rows: int = 3
    q: int = 2

    @property
    def bands(self) -> int:
        return bands_for(self.similarity, self.recall, self.rows)


def qgrams(s: str, q: int) -> list[str]:
    padded = "^" * (q - 1) + s + "$" * (q - 1)
    return [padded[i : i + q] for i in range(len(padded) - q + 1)]


@lru_cache(maxsize=4)
def _mixers(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(1, 1 << 61, n, dtype=np.uint64) | np.uint64(1), rng.integers(0, 1 << 61, n, dtype=np.uint64)


def band_keys(text: str, salt: str, b: Banding, seed: int = 3) -> np.ndarray:
    """One 64-bit key a band; equal for equal salts where the texts' minima in the band are equal."""
    import xxhash

    a, c = _mixers(b.bands * b.rows, seed)
    h = np.array([xxhash.xxh3_64_intdigest(g) for g in sorted(set(qgrams(text, b.q)))], dtype=np.uint64)
    with np.errstate(over="ignore"):
        mixed = h[:, None] * a[None, :] + c[None, :]
        mixed ^= mixed >> np.uint64(31)
        low = mixed.min(axis=0).reshape(b.bands, b.rows)
        out = np.full(b.bands, xxhash.xxh3_64_intdigest(salt), np.uint64) + np.arange(b.bands, dtype=np.uint64)
        for r in range(b.rows):
            out = (out ^ low[:, r]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
    return out.view(np.int64)


_READ = "kind string, givens array<string>, initials string, surnames array<string>, nick boolean, node string"


def readings(spellings: DataFrame) -> DataFrame:
    """(name, weight, kind, givens, initials, surnames, nick, node): one reading of every spelling.

    Where the order of two names is open, the one whose words stand more often in these places over all
    spellings is taken; if none does, the given name comes first.
    """

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pandas as pd

        for b in batches:
            out = []
            for name, weight in zip(b["name"], b["weight"]):
                one, two, first, last = read(name)
                out += [(name, weight, first, last, ahead, two is not None, r.kind, list(r.givens), r.initials, list(r.surnames), r.nick, r.node) for ahead, r in ((True, one), (False, two)) if r]
            yield pd.DataFrame(out, columns=["name", "weight", "first", "last", "ahead", "open", "kind", "givens", "initials", "surnames", "nick", "node"])

    parsed = materialise(spread(spellings).mapInPandas(parse, f"name string, weight bigint, first string, last string, ahead boolean, open boolean, {_READ}"))
    each = F.explode(F.array(F.struct(F.col("first").alias("t"), F.lit(1).alias("f"), F.lit(0).alias("l")), F.struct(F.col("last").alias("t"), F.lit(0).alias("f"), F.lit(1).alias("l"))))
    places = parsed.where("ahead").select(each.alias("x")).select("x.*").where("t <> ''").groupBy("t").agg(F.sum("f").alias("f"), F.sum("l").alias("l"))
    odds = places.select("t", F.log((F.col("f") + 0.5) / (F.col("l") + 0.5)).alias("odds"))
    of = lambda c: met(odds.select(F.col("t").alias(c), F.col("odds").alias(f"of_{c}")))
    open_ = parsed.where("open").join(of("first"), "first").join(of("last"), "last").where(F.col("ahead") == (F.col("of_first") >= F.col("of_last")))
    wanted = ["name", "weight", *[c.split()[0] for c in _READ.split(", ")]]
    # 64 bits of the whole reading stand for it in what follows
    return parsed.where("NOT open").select(*wanted).unionByName(open_.select(*wanted)).withColumn("node", F.xxhash64("node"))


#: Of two forms of a slip, the rarer has so few spellings and stands with so few other parts, or a third of the
#: other's at most; else both are names of their own.
RARE = 3


def summaries(rows: DataFrame) -> DataFrame:
    """A row a node: its reading, how many spellings and rows it has, and in how many spellings and with how many other parts its parts stand."""
    nodes = materialise(rows.groupBy("node").agg(F.count("*").alias("spelled"), F.sum("weight").alias("seen"), *[F.first(c).alias(c) for c in ("kind", "givens", "initials", "surnames", "nick")]))
    given, surname = F.element_at("givens", 1), F.element_at("surnames", 1)
    parts = nodes.where("kind = 'p'").select("spelled", F.when(F.size("givens") > 0, given).alias("g"), surname.alias("s"))
    pairs = parts.groupBy("g", "s").agg(F.sum("spelled").alias("ways"))
    by_given = pairs.where("g IS NOT NULL").groupBy("g").agg(F.count("*").alias("g_with"))
    by_surname = pairs.groupBy("s").agg(F.count("g").alias("s_with"), F.sum("ways").alias("s_ways"))
    both = nodes.withColumn("g", F.when((F.col("kind") == "p") & (F.size("givens") > 0), given)).withColumn("s", surname)
    out = both.join(met(by_given), "g", "left").join(met(by_surname), "s", "left").join(met(pairs.where("g IS NOT NULL").withColumnRenamed("ways", "g_ways")), ["g", "s"], "left")
    return out.drop("g", "s").fillna(0, ["g_with", "s_with", "s_ways", "g_ways"])


def _keys(summary: DataFrame) -> DataFrame:
    """(node, salt, text, solo): the parts of a node that are banded, each under another part that must agree.

    At most one slip is allowed, so of two given names and surnames one pair agrees: surnames are banded under the
    given name's first letters (3, so that shortenings meet), given names under the surname; a name with initials
    only (solo) has its surname banded under the first, and meets those of all names. For organisations, the place
    is banded under the initials and the words under the place.
    """

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pandas as pd

        for b in batches:
            out = []
            for node, kind, givens, initials, surnames in zip(b["node"], b["kind"], b["givens"], b["initials"], b["surnames"]):
                givens, found = list(givens), set()
                for s in surnames:
                    if kind == "o":
                        found |= {(f"o{initials}", s, False)} | ({(f"w{s}", "_".join(givens), False)} if givens else set())
                        continue
                    found |= {(f"g{g[:3]}", s, False) for g in givens} | {(f"s{s}", g, False) for g in givens}
                    found |= {(f"i{c}", s, not givens) for c in ({g[0] for g in givens} or {initials[:1]})}
                out += [(node, *f) for f in found]
            yield pd.DataFrame(out, columns=["node", "salt", "text", "solo"])

    return summary.select("node", "kind", "givens", "initials", "surnames").mapInPandas(emit, "node bigint, salt string, text string, solo boolean")


def candidates(summary: DataFrame, banding: Banding = Banding()) -> DataFrame:
    """(a, b), once: pairs of nodes of which a part collides in a band.

    Equal parts are banded once, whoever bears them, and colliding parts are expanded to nodes. Names with initials
    only are few by surname and initial, and only pairs with one of them are formed there, so that no group of
    names that share an initial and a surname meets itself. Skewed keys of the joins are left to be split.
    """
    keys = materialise(_keys(spread(summary)).withColumn("part", F.xxhash64("salt", "text")))

    def band(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pandas as pd

        for b in batches:
            if len(b):  # an empty frame has no types
                found = [band_keys(text, salt, banding) for salt, text in zip(b["salt"], b["text"])]
                lengths = np.array([0 if salt[0] == "w" else len(text) for salt, text in zip(b["salt"], b["text"])], np.int32)  # words may be abbreviated
                yield pd.DataFrame({"part": np.repeat(b["part"].to_numpy(), banding.bands), "band": np.concatenate(found), "len": np.repeat(lengths, banding.bands)})

    parts = keys.select("part", "salt", "text", F.xxhash64("salt").alias("under")).distinct()
    shared = parts.groupBy("under").count().where("count > 1").select("under")  # a part alone under its salt meets none
    parts = spread(parts.join(met(shared), "under", "left_semi").select("part", "salt", "text"))
    banded = materialise(parts.mapInPandas(band, "part bigint, band bigint, len int"))
    one, other = (banded.select(F.col("part").alias(c), "band", F.col("len").alias(f"len_{c}")) for c in "pq")
    near = one.join(met(other), "band").where("p < q AND abs(len_p - len_q) <= 1").select("p", "q").distinct()
    near = materialise(near)
    both = near.unionByName(near.select(F.col("q").alias("p"), F.col("p").alias("q"))).unionByName(keys.select(F.col("part").alias("p"), F.col("part").alias("q")).distinct())
    side = lambda n, p: keys.select(F.col("node").alias(n), F.col("part").alias(p), F.col("solo").alias(f"solo_{n}"), F.substring("salt", 1, 1).alias(f"of_{n}"))
    first, second = side("a", "p"), side("b", "q")
    sets = first.where("of_a <> 'i'").join(met(both), "p").join(met(second), "q").where("a < b")
    solo = first.where("solo_a").join(met(both), "p").join(met(second), "q").where("a <> b")
    return sets.select("a", "b").unionByName(solo.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))).distinct()


def _slip(xs: list[str], ys: list[str]) -> int:
    return min(slips(x, y) for x in xs for y in ys)


def _own(*counts: tuple[int, int]) -> bool:
    """Whether two forms are names of their own rather than one a slip of the other, by counts of both."""
    return any(min(c) > RARE and 3 * min(c) > max(c) for c in counts)


def similarity(a, b) -> float:  # noqa: ANN001
    """Monge-Elkan similarity of two nodes, 0 if they can't be forms of one name."""
    if a.kind != b.kind:
        return 0.0
    ga, gb, sa, sb = list(a.givens), list(b.givens), list(a.surnames), list(b.surnames)
    n = _slip(sa, sb)
    if n > 1 or (n and min(len(sa[0]), len(sb[0])) < 4):
        return 0.0
    place = max(1 - slips(x, y) / max(len(x), len(y), 1) for x in sa for y in sb)
    if a.kind == "o":
        if not ga or not gb:
            return (1 + place) / 2 if a.initials == b.initials else 0.0
        short, long = sorted((ga, gb), key=lambda w: (len(w), w))
        if len(short) != len(long):
            return 0.0
        if sum(slips(x, y) for x, y in zip(short, long) if token_similarity(x, y) < 1) + n > 1:
            return 0.0
        return (monge_elkan(short, long) + place) / 2
    ia, ib = a.initials if ga else a.initials[1:], b.initials if gb else b.initials[1:]
    if ia and ib and ia[0] != ib[0]:
        return 0.0
    if ga and gb:
        given = max(token_similarity(x, y) for x in ga for y in gb)
        if given < 1:
            n += _slip(ga[:1], gb[:1])
            if _own((a.g_with, b.g_with), (a.g_ways, b.g_ways)):
                return 0.0
        elif n and _own((a.s_with, b.s_with), (a.s_ways, b.s_ways)):
            return 0.0
    else:
        given = float(bool({g[0] for g in ga or [a.initials[:1] or "?"]} & {g[0] for g in gb or [b.initials[:1] or "!"]}))
        if n and _own((a.s_with, b.s_with), (a.s_ways, b.s_ways)):
            return 0.0
    return (given + place) / 2 if n <= 1 and given else 0.0


def linked(summary: DataFrame, least: float) -> DataFrame:
    """(a, b, similarity): candidate pairs that may be forms of the same name."""
    wanted = ("kind", "givens", "initials", "surnames", "g_with", "s_with", "g_ways", "s_ways")
    facts = lambda s: met(summary.select(F.col("node").alias(s), F.struct(*wanted).alias(f"f{s}")))

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pandas as pd

        for p in batches:
            sides = [[SimpleNamespace(**(f if isinstance(f, dict) else f.asDict())) for f in p[c]] for c in ("fa", "fb")]
            s = np.array([similarity(x, y) for x, y in zip(*sides)], dtype=float)
            yield pd.DataFrame({"a": p["a"], "b": p["b"], "similarity": s})[s >= least]

    return spread(candidates(summary).join(facts("a"), "a").join(facts("b"), "b")).mapInPandas(verify, "a bigint, b bigint, similarity double")


def stars(weights: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, centre) by star clustering: the heaviest node among its open neighbours becomes a centre and takes
    them; a node between several centres goes to the most similar, then the heaviest, then the first. One that is
    wholly similar to several (an initial that fits several people) stays by itself. Rounds go on until no open
    edge is left; each closes one at least, and lineage is cut in each. Nodes without edges aren't listed.

    weights: node and weight, of any type with an order.
    """
    w = weights.select("node", "weight")
    both = edges.select("a", "b", "similarity").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "similarity"))
    heavy = both.join(met(w.select(F.col("node").alias("a"), F.col("weight").alias("wa"))), "a").join(met(w.select(F.col("node").alias("b"), F.col("weight").alias("wb"))), "b")
    open_ = materialise(heavy.select("a", "b", "similarity", "wb", ((F.col("wb") > F.col("wa")) | ((F.col("wb") == F.col("wa")) & (F.col("b") < F.col("a")))).alias("up")))
    done = None
    while not open_.isEmpty():
        centres = open_.groupBy("a").agg(F.max("up").alias("up")).where("NOT up").select(F.col("a").alias("centre"))
        best = F.max_by("b", F.struct("similarity", "wb", "b"))
        taken = open_.join(met(centres), F.col("b") == F.col("centre")).groupBy("a").agg(best.alias("centre"), F.count_if(F.col("similarity") >= 1).alias("whole"))
        taken = taken.select(F.col("a").alias("node"), F.when(F.col("whole") > 1, F.col("a")).otherwise(F.col("centre")).alias("centre"))
        one = materialise(taken.unionByName(centres.select(F.col("centre").alias("node"), "centre")))
        done = one if done is None else done.unionByName(one)
        gone = one.select("node")
        open_ = materialise(open_.join(met(gone.withColumnRenamed("node", "a")), "a", "left_anti").join(met(gone.withColumnRenamed("node", "b")), "b", "left_anti"))
    return done if done is not None else w.select("node", F.col("node").alias("centre")).limit(0)


def entities(spellings: DataFrame, least: float = 0.88) -> DataFrame:
    """(name, entity): the entity of every distinct spelling.

    spellings: a column name, any number of rows of each; nulls and blanks take no part. Spellings that can't be
    read as a name are entities of their own. least: the Monge-Elkan similarity of a link.
    """
    counted = spellings.where(F.trim("name") != "").groupBy("name").agg(F.count("*").alias("weight"))
    rows = materialise(readings(counted))
    named = F.element_at("surnames", 1) != ""
    summary = materialise(summaries(rows.where(named)))
    links = materialise(linked(summary, least))
    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))
    # whole names before nicknames before initials; then what is spelled in more ways, linked more, and seen more
    rank = F.when(F.size("givens") == 0, 0).when(F.col("nick"), 1).otherwise(2)
    weight = F.struct(rank.alias("rank"), "spelled", F.coalesce("degree", F.lit(0)).alias("degree"), "seen")
    homes = stars(summary.join(met(degree), "node", "left").select("node", weight.alias("weight")), links)
    return rows.join(met(homes), "node", "left").select("name", F.when(named, F.hex(F.coalesce("centre", "node"))).otherwise(F.concat(F.lit("?|"), "name")).alias("entity"))


def variant_pairs(found: DataFrame) -> DataFrame:
    """(name_a, name_b), a before b: every pair of different spellings of one entity, once."""
    a, b = found.select(F.col("name").alias("name_a"), "entity"), found.select(F.col("name").alias("name_b"), "entity")
    return a.join(met(b), "entity").where("name_a < name_b").select("name_a", "name_b")
