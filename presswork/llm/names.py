"""Spelling variants of one person, organisation or product.

Distinct spellings are cut into tokens. A symmetric-delete index (every token under all its
spellings with one letter left out) finds tokens at edit distance one without comparing
tokens pairwise; the rarer spelling then stands for the commoner one. The token of a name
that meets the fewest different partners is its root (a surname, a company's own word);
names meet under their root. Names of one root are compared where their other tokens have
the same first letters, by an optimal assignment that permits typing errors, nicknames,
initials, abbreviations and acronyms. Links become entities by connected components, so
neither a root nor an entity with very many spellings is gathered in one task. What could
mean two entities (a bare surname of two people) is linked to neither.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import combinations

import pandas as pd
from presswork.llm.groups import components
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presswork.session import cut, fan_out, forget

# Fixed values ---------------------------------------------------------------------------
#: Words that carry no identity inside a name.
STOP = frozenset("the of for by and a an de la le der die das und et y del du des in at to".split())
HONORIFIC = frozenset("dr prof mr mrs ms miss sir dame professor doctor herr frau".split())
LEGAL = frozenset("inc ltd gmbh llc plc corp co ag sa limited incorporated corporation kg srl bv nv oy ab".split())
#: Generic words taken for names.
GENERIC = frozenset(
    "they them we he she it you people officials official company companies government users researchers experts "
    "analysts critics regulators lawmakers customers investors students police ministry agency university study report "
    "technology internet artificial intelligence machine learning software ai ml llm llms".split()
)
#: Usual short forms of first names.
NICKNAMES = {
    "bill": "william", "will": "william", "billy": "william", "dick": "richard", "rick": "richard", "rich": "richard",
    "bob": "robert", "rob": "robert", "bobby": "robert", "bert": "robert", "kate": "katherine", "kathy": "katherine",
    "katie": "katherine", "kat": "katherine", "liz": "elizabeth", "beth": "elizabeth", "betty": "elizabeth",
    "lizzie": "elizabeth", "eliza": "elizabeth", "peggy": "margaret", "maggie": "margaret", "meg": "margaret",
    "greta": "margaret", "tom": "thomas", "tommy": "thomas", "mike": "michael", "mick": "michael", "mickey": "michael",
    "sue": "susanna", "susie": "susanna", "susan": "susanna", "ed": "edward", "ted": "edward", "eddie": "edward",
    "ned": "edward", "teddy": "edward", "alex": "alexandra", "sandra": "alexandra", "sasha": "alexandra", "lexi": "alexandra",
    "theo": "theodora", "dora": "theodora", "marty": "martin", "jim": "james", "jimmy": "james", "jack": "john",
    "johnny": "john", "tony": "anthony", "dan": "daniel", "danny": "daniel", "ben": "benjamin", "sam": "samuel",
    "joe": "joseph", "chris": "christopher", "matt": "matthew", "nick": "nicholas", "dave": "david", "steve": "stephen",
    "andy": "andrew", "pat": "patricia", "jenny": "jennifer", "becky": "rebecca", "vicky": "victoria", "tina": "christina",
    "charlie": "charles", "chuck": "charles", "hank": "henry", "harry": "henry", "larry": "lawrence", "fred": "frederick",
    "greg": "gregory", "jeff": "jeffrey", "ken": "kenneth", "ron": "ronald", "tim": "timothy", "josh": "joshua",
}
FAMILY = {
    "person": "person", "per": "person", "people": "person",
    "technology": "product", "product": "product", "ai model": "product", "model": "product", "software": "product",
    "company": "org", "org": "org", "organization": "org", "organisation": "org", "government institution": "org",
    "government": "org", "institution": "org", "agency": "org",
}
# -----------------------------------------------------------------------------------------

#: Two similar spellings that each stand in so many different names, the rarer at least a
#: RATIO-th as often as the other, are two words and no typing error.
ESTABLISHED, RATIO = 5, 6
#: Shortest token the delete index holds; shorter ones, and those with digits, must be equal.
MIN_INDEXED = 4
#: Longest acronym, and longest token that can't be a root for being an abbreviation.
ABBREVIATION = 6
#: A word of more later consonants has no contraction.
CONSONANTS = 24
#: Up to so many tuples of one block are compared without an index of their tokens.
FEW = 16

_MARKS = re.compile("[™®©]")
_POSSESSIVE = re.compile(r"['’ʼ]s\b", re.I)
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z][a-z])")
_SPLIT = re.compile(r"[^\w]+|_+")
_TICKER = re.compile(r"[BCDFGHJKLMNPQRSTVWXZ]{3,6}")
_DIGIT = re.compile(r"\d")


def initial(token: str) -> bool:
    """Whether a token is a single letter (of a script that has capitals)."""
    return len(token) == 1 and token.islower()


def tokens(name: str | None) -> list[str]:
    """Identity-bearing tokens of a name, in order and lower case; numbers are tokens.

    A name of single letters only ("I.B.M.") is one token.
    """
    if not name:
        return []
    t = _MARKS.sub("", unicodedata.normalize("NFKC", name).replace("™", ""))
    if t.endswith("TM") and not t.isupper():
        t = t[:-2]
    t = _CAMEL.sub(" ", _POSSESSIVE.sub("", t))
    out = [w for w in _SPLIT.split(t.lower()) if w]
    out = [w for w in out if w not in HONORIFIC and w not in LEGAL and (w not in STOP or (len(w) == 1))]
    return ["".join(out)] if len(out) > 1 and all(map(initial, out)) else out


def root_places(toks: list[str]) -> list[bool]:
    """Which tokens may be a name's root: words of four letters, else all its words, else its letters."""
    for least in (MIN_INDEXED, 2, 1):
        ok = [len(t) >= least and any(map(str.isalpha, t)) for t in toks]
        if any(ok):
            return ok
    return [False] * len(toks)


def skeleton(word: str) -> str:
    return re.sub("[aeiou]", "", word)


@lru_cache(maxsize=200_000)
def one_edit(a: str, b: str) -> bool:
    """Whether a and b differ by one letter left out, put in, replaced, or two neighbours swapped."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    n = min(len(a), len(b))
    while i < n and a[i] == b[i]:
        i += 1
    ra, rb = a[i:], b[i:]
    if len(a) == len(b):
        return ra[1:] == rb[1:] or (len(ra) > 1 and ra[0] == rb[1] and ra[1] == rb[0] and ra[2:] == rb[2:])
    return ra[1:] == rb if len(a) > len(b) else ra == rb[1:]


def contraction_key(word: str) -> str:
    """The first letter and all later consonants."""
    return word[0] + skeleton(word[1:])


def contraction_keys(full: str) -> set[str]:
    """Keys of all contractions a word can have: at most two of its consonants left out, or at most three left in."""
    k = contraction_key(full)
    n = len(k) - 1
    if n > CONSONANTS:
        return set()
    sizes = {m for m in range(n + 1) if m >= n - 2 or m <= 3}
    return {k[0] + "".join(c) for m in sizes for c in combinations(k[1:], m)}


@lru_cache(maxsize=200_000)
def abbreviates(short: str, full: str) -> bool:
    """Whether ``short`` is an initial, a cut-off (plural s allowed) or a contraction of ``full``.

    A contraction has letters of the word in their order, the first one among them, and of
    the later consonants all but two ("anlytcs") or at most three ("intl").
    """
    if len(short) >= len(full) or short[0] != full[0] or _DIGIT.search(short) or _DIGIT.search(full):
        return False
    if full.startswith(short) or (len(short) >= 4 and short[-1] == "s" and full.startswith(short[:-1])):
        return True
    it = iter(full)
    if not all(c in it for c in short):
        return False
    k, n = len(contraction_key(short)) - 1, len(contraction_key(full)) - 1
    return n <= CONSONANTS and (k >= n - 2 or k <= 3)


def formal(token: str) -> str:
    """The full first name behind a nickname, else the token."""
    return NICKNAMES.get(token, token)


def token_cost(x: str, y: str, distinct: Callable[[str, str], bool]) -> int | None:
    """What it costs that ``x`` stands for ``y``; 100 or more for an abbreviation, None if it can't."""
    if x == y or formal(x) == formal(y):
        return 0
    if _DIGIT.search(x) or _DIGIT.search(y):
        return None
    if min(len(x), len(y)) >= MIN_INDEXED and one_edit(x, y) and not distinct(x, y):
        return 1
    nx, ny = formal(x), formal(y)
    if len(nx) > MIN_INDEXED and len(ny) > MIN_INDEXED and one_edit(nx, ny) and not distinct(nx, ny):
        return 1
    return 100 if abbreviates(x, ny) else None


def assignment(cost: list[list[float]]) -> float:
    """Least total of a one-to-one assignment of a square matrix (Hungarian method, cubic time)."""
    n = len(cost)
    u, v, match = [0.0] * (n + 1), [0.0] * (n + 1), [0] * (n + 1)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        least, used, way = [float("inf")] * (n + 1), [False] * (n + 1), [0] * (n + 1)
        while True:
            used[j0] = True
            i0, delta, j1 = match[j0], float("inf"), 0
            for j in range(1, n + 1):
                if not used[j]:
                    x = cost[i0 - 1][j - 1] - u[i0] - v[j]
                    if x < least[j]:
                        least[j], way[j] = x, j0
                    if least[j] < delta:
                        delta, j1 = least[j], j
            for j in range(n + 1):
                if used[j]:
                    u[match[j]] += delta
                    v[j] -= delta
                else:
                    least[j] -= delta
            j0 = j1
            if match[j0] == 0:
                break
        while j0:
            match[j0] = match[way[j0]]
            j0 = way[j0]
    return sum(cost[match[j] - 1][j - 1] for j in range(1, n + 1))


#: No such match; above any sum of possible ones.
_NEVER = 1e9
#: A left-over initial: more than any typing errors, less than an abbreviation.
_LEFT = 20


def _assign(a: tuple[str, ...], b: tuple[str, ...], distinct: Callable[[str, str], bool]) -> float:
    both = Counter(a) & Counter(b)
    if both:  # equal tokens belong together
        a, b = tuple((Counter(a) - both).elements()), tuple((Counter(b) - both).elements())
    if not a or not b:
        rest = a or b
        return _LEFT * len(rest) if len(rest) <= 2 and all(map(initial, rest)) else _NEVER
    each = [[token_cost(x, y, distinct) for y in b] for x in a]
    if any(not initial(x) and all(c is None for c in row) for x, row in zip(a, each)):
        return _NEVER
    if any(not initial(y) and all(row[j] is None for row in each) for j, y in enumerate(b)):
        return _NEVER
    if len(a) == len(b) == 1 and each[0][0] is not None:
        return each[0][0]
    m = [[_NEVER if c is None else float(c) for c in row] + [float(_LEFT) if initial(x) else _NEVER] * len(a) for x, row in zip(a, each)]
    m += [[float(_LEFT) if initial(y) else _NEVER for y in b] + [0.0] * len(a) for _ in b]
    total = assignment(m)
    return total if total < _NEVER and (total % 100) < 3 * _LEFT else _NEVER


def _acronyms(a: tuple[str, ...], b: tuple[str, ...]) -> list[tuple[int, int, int]]:
    """(place in a, first place in b, words) of every token that spells the first letters of words in a row."""
    out = []
    for i, x in enumerate(a):
        if 2 <= len(x) <= ABBREVIATION and x.isalpha():
            out += [(i, k, len(x)) for k in range(len(b) - len(x) + 1) if all(len(w) > 1 and w[0] == ch for w, ch in zip(b[k:], x))]
    return out


def align(a: tuple[str, ...], b: tuple[str, ...], distinct: Callable[[str, str], bool]) -> str | None:
    """How two lists of tokens mean the same: ``same``, ``abbr`` (a short, b full) or None.

    Equal tokens stand for each other, the others by the best assignment; one token of ``a``, or two, may also stand
    for several following tokens of ``b`` as their acronym. Up to two left-over single
    letters are middle initials; any other left-over token means another entity.
    ``distinct(x, y)`` tells whether two similar words are known to be two words. Names may
    have any number of tokens.
    """
    if all(map(initial, b)):
        return None
    best = _assign(a, b, distinct)
    if best >= 100:
        runs = _acronyms(a, b)
        for chosen in [(r,) for r in runs] + [(r, s) for r, s in combinations(runs, 2) if r[0] != s[0] and (r[1] + r[2] <= s[1] or s[1] + s[2] <= r[1])]:
            gone = {k for _, first, n in chosen for k in range(first, first + n)}
            rest = tuple(x for i, x in enumerate(a) if i not in {r[0] for r in chosen})
            best = min(best, 100 + _assign(rest, tuple(y for j, y in enumerate(b) if j not in gone), distinct))
    return None if best >= _NEVER else "abbr" if best >= 100 else "same"


def _letter(token: str, canon: str) -> str:
    return f"#{token}" if _DIGIT.search(token) else formal(canon)[0]


def signature(letters: list[str]) -> str:
    return " ".join(sorted(letters))


def signatures(toks: list[str], canons: list[str]) -> list[tuple[str, bool]]:
    """(signature, own) of every block a list of tokens has to be compared in.

    Its own block has the first letters of its words; as a short form it also visits the
    blocks where its initials stand for words (all but two left-over ones), a nickname for
    itself, or one or two tokens are acronyms.
    """
    words = [(t, c) for t, c in zip(toks, canons) if not initial(t)]
    own = signature([_letter(t, c) for t, c in words])
    out = {own: True} if words else {}
    choices = []
    for t, c in words:
        opts = [[_letter(t, c)]]
        if formal(c) != t and not _DIGIT.search(t) and t[0] != opts[0][0]:
            opts.append([t[0]])
        if 2 <= len(t) <= ABBREVIATION and t.isalpha():
            opts.append(list(t))
        choices.append(opts)
    plain = [o[0] for o in choices]
    other = [(i, x) for i, o in enumerate(choices) for x in o[1:]]
    sets = [()] + [(x,) for x in other] + [(x, y) for x, y in combinations(other, 2) if x[0] != y[0]]
    letters = [t for t in toks if initial(t)]
    for chosen in sets:
        base = [c for i, o in enumerate(plain) for c in dict(chosen).get(i, o)]
        for n in range(max(0, len(letters) - 2), len(letters) + 1):
            for kept in combinations(letters, n):
                if base or kept:
                    out.setdefault(signature([*base, *kept]), False)
    return list(out.items())


class _Union:
    def __init__(self) -> None:
        self.up: dict = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x, y) -> None:
        x, y = self.find(x), self.find(y)
        self.up[max(x, y)] = min(x, y)


class _Near:
    """Which tuples of a block have a token that a given token could stand for."""

    def __init__(self, homes: list[tuple[str, ...]]) -> None:
        self.at: dict[str, set[int]] = defaultdict(set)
        self.runs: dict[str, set[int]] = defaultdict(set)
        for i, d in enumerate(homes):
            for t in d:
                self.at[t].add(i)
            first = "".join(t[0] for t in d)
            for n in range(2, ABBREVIATION + 1):
                for k in range(len(d) - n + 1):
                    self.runs[first[k:k + n]].add(i)
        self.equal, self.edits, self.contracted = defaultdict(set), defaultdict(set), defaultdict(set)
        for t in self.at:
            f = formal(t)
            self.equal[f].add(t)
            if _DIGIT.search(t):
                continue
            for w in {t, f}:
                for e in _deletes(w):
                    self.edits[e].add(t)
            for k in contraction_keys(f):
                self.contracted[k].add(t)
        self.sorted = sorted({(formal(t), t) for t in self.at})
        self.cache: dict[str, set[int]] = {}

    def _starting(self, p: str) -> Iterator[str]:
        k = bisect_left(self.sorted, (p,))
        while k < len(self.sorted) and self.sorted[k][0].startswith(p):
            yield self.sorted[k][1]
            k += 1

    def of(self, x: str) -> set[int]:
        got = self.cache.get(x)
        if got is None:
            words = set(self.equal.get(formal(x), ()))
            if not _DIGIT.search(x):
                for w in {x, formal(x)}:
                    for e in _deletes(w):
                        words |= self.edits.get(e, set())
                words.update(self._starting(x))
                if len(x) >= 4 and x[-1] == "s":
                    words.update(self._starting(x[:-1]))
                words |= self.contracted.get(contraction_key(x), set())
            got = self.cache[x] = set().union(*(self.at[w] for w in words), self.runs.get(x, ()))
        return got


def _deletes(w: str) -> set[str]:
    return {w, *(w[:i] + w[i + 1:] for i in range(len(w)))} if len(w) >= MIN_INDEXED else {w}


def link_block(tuples: dict[tuple[str, ...], tuple[bool, tuple[str, ...]]], distinct: Callable[[str, str], bool], few: int = FEW) -> list[tuple[tuple, tuple, bool]]:
    """(tuple, stands for, short) within one block: tuples with the same first letters under one root.

    ``tuples``: whether this is the tuple's own block, and its words' common spellings.
    Tuples of the own block are always linked to the first of their class; a short form
    gives one row for the only class it can mean here, or two rows that show it is open.
    """
    homes = sorted(t for t, (own, _) in tuples.items() if own)
    if not homes:
        return []
    u = _Union()
    by_words: dict[tuple, tuple] = {}
    for d in homes:
        u.join(by_words.setdefault(tuple(sorted(tuples[d][1])), d), d)
    near = _Near(homes) if len(homes) > few else None
    short: dict[tuple, set] = {}
    for d in sorted(tuples):
        words = [t for t in d if not initial(t)]
        if not words:
            continue
        if near is None:
            others = homes
        else:
            others = [homes[i] for i in sorted(min((near.of(t) for t in words), key=len))]
        for b in others:
            if b == d:
                continue
            kind = align(d, b, distinct)
            if kind == "same":
                if tuples[d][0]:
                    u.join(d, b)
                else:
                    short.setdefault(d, set()).add(b)
            elif kind == "abbr":
                short.setdefault(d, set()).add(b)
    out = [(d, u.find(d), False) for d in homes]
    for d, bs in short.items():
        full = {u.find(b) for b in bs if b not in short} or {u.find(b) for b in bs}
        out += [(d, r, True) for r in sorted(full)[:2]]
    classes = sorted({u.find(d) for d in homes if d not in short} or {u.find(d) for d in homes})
    out += [(d, r, True) for d in sorted(tuples) if all(map(initial, d)) for r in classes[:2]]
    return out


def _spellings(mentions: DataFrame) -> DataFrame:
    """Distinct spellings with their mention count and family; the commonest known label decides."""
    label = F.regexp_replace(F.lower(F.trim("raw_label")), "[-_ ]+", " ")
    fam = F.create_map(*[F.lit(x) for kv in FAMILY.items() for x in kv])[label]
    counts = mentions.where(F.col("entity_surface").isNotNull()).groupBy(
        F.col("entity_surface").alias("name"), fam.alias("family")).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("name").agg(
        F.sum("n").alias("n"),
        F.max(F.when(F.col("family").isNotNull(), F.struct("n", "family")))["family"].alias("family"))


def _tokenised(names: DataFrame) -> DataFrame:
    """Names of a known family with at least one word that is no generic one, and their tokens."""

    def cutter(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["tokens"] = [tokens(x) for x in b["name"]]
            b["rootable"] = [root_places(t) for t in b["tokens"]]
            b["ticker"] = [bool(_TICKER.fullmatch(x.strip())) for x in b["name"]]
            b["proper"] = [any(r and t not in GENERIC for t, r in zip(ts, rs)) for ts, rs in zip(b["tokens"], b["rootable"])]
            yield b

    shape = "name string, n long, family string, tokens array<string>, rootable array<boolean>, ticker boolean, proper boolean"
    return fan_out(names.where("family is not null"), "name").mapInPandas(cutter, shape).where("proper or ticker").drop("proper")


def token_canon(named: DataFrame) -> DataFrame:
    """(token, canon, names): every indexed token, the commoner spelling it stands for, and its names.

    Index entries are (token with one letter left out, token); two tokens that share an
    entry are checked for one edit. A token of length L has at most L + 1 entries, and an
    entry can be shared only by tokens that differ in one letter of a place, so entries
    stay short however large the table.
    """
    tok = (
        named.select("n", F.explode(F.array_distinct("tokens")).alias("token"))
        .where((F.length("token") >= MIN_INDEXED) & ~F.col("token").rlike("[0-9]"))
        .groupBy("token").agg(F.count(F.lit(1)).alias("names"), F.sum("n").alias("n")))
    tok = cut(tok, "tokens")
    entries = tok.select(
        "token", "names", "n",
        F.explode(F.array_distinct(F.concat(
            F.array("token"),
            F.transform(F.sequence(F.lit(1), F.length("token")),
                        lambda i: F.concat(F.substring("token", F.lit(1), i - 1), F.substring("token", i + 1, F.lit(1000))))))).alias("entry"))
    a, b = entries.alias("a"), entries.alias("b")
    commoner = F.struct(F.col("b.names"), F.col("b.n"), F.col("b.token")) > F.struct(F.col("a.names"), F.col("a.n"), F.col("a.token"))
    pairs = a.join(b, F.col("a.entry") == F.col("b.entry")).where(
        commoner & ((F.col("a.names") < ESTABLISHED) | (F.col("a.names") * RATIO <= F.col("b.names")))).select(
        F.col("a.token").alias("token"), F.col("b.token").alias("other"), F.col("b.names").alias("names"), F.col("b.n").alias("n")).distinct()

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            yield p[[one_edit(x, y) for x, y in zip(p["token"], p["other"])]]

    best = pairs.mapInPandas(check, pairs.schema).groupBy("token").agg(
        F.max(F.struct("names", "n", "other"))["other"].alias("canon"))
    out = cut(tok.join(best, "token", "left").select("token", F.coalesce("canon", "token").alias("canon"), "names"), "canon")
    forget(tok)
    return out


def _cut_forms(words: DataFrame, briefs: DataFrame) -> DataFrame:
    """(canon) of every brief token that abbreviates a word: equal keys meet, then the rule decides."""

    def full_keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for w in b["canon"]:
                n = min(ABBREVIATION, len(w) - 1)
                rows += [("p" + w[:k], w) for k in range(1, n + 1)] + [("p" + w[:k] + "s", w) for k in range(3, min(n, ABBREVIATION - 1) + 1)]
                rows += [("c" + k, w) for k in contraction_keys(w)]
            yield pd.DataFrame(rows, columns=["key", "word"])

    def brief_keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([x for w in b["canon"] for x in (("p" + w, w), ("c" + contraction_key(w), w))], columns=["key", "canon"])

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            yield p.loc[[abbreviates(x, y) for x, y in zip(p["canon"], p["word"])], ["canon"]]

    met = briefs.mapInPandas(brief_keys, "key string, canon string").join(words.mapInPandas(full_keys, "key string, word string"), "key")
    return met.select("canon", "word").distinct().mapInPandas(check, "canon string").distinct()


def _placed(named: DataFrame) -> DataFrame:
    """Every name under its roots, with its other tokens and the blocks they are compared in."""
    canon = token_canon(named)
    each = named.select("name", "ticker", F.posexplode(F.arrays_zip("tokens", "rootable")).alias("pos", "t")).select(
        "name", "ticker", "pos", F.col("t.tokens").alias("token"), F.col("t.rootable").alias("rootable"))
    each = each.join(canon, "token", "left").select(
        "name", "ticker", "pos", "token", "rootable", F.coalesce("canon", "token").alias("canon"), F.coalesce("names", F.lit(0)).alias("names"))
    # a second step joins chains of typing errors (a rare spelling of a rare spelling)
    again = canon.select(F.col("token").alias("canon"), F.col("canon").alias("canon2"))
    full_name = F.create_map(*[F.lit(x) for kv in NICKNAMES.items() for x in kv])
    twice = F.coalesce("canon2", "canon")
    # a ticker is a spelling by itself: one letter more or less is another body
    each = cut(each.join(again, "canon", "left").select(
        "name", "pos", "token", "rootable", F.when(F.col("ticker"), F.col("token")).otherwise(F.coalesce(full_name[twice], twice)).alias("canon"), "names"),
        "name_tokens")
    long = each.where("rootable")
    other = each.select("name", F.col("canon").alias("partner"))
    partners = (
        long.select("name", "canon").join(other, "name").where(F.col("canon") != F.col("partner"))
        .select("canon", "partner").distinct().groupBy("canon").agg(F.count(F.lit(1)).alias("partners")))
    partners = cut(partners, "partners")
    # a short token that abbreviates a word met in many names is such a word too, and no root
    letters = ~F.col("canon").rlike("[0-9]")
    short = _cut_forms(
        partners.where((F.col("partners") >= ESTABLISHED) & letters).select("canon"),
        partners.where((F.length("canon") <= ABBREVIATION) & (F.col("partners") < ESTABLISHED) & letters).select("canon")).withColumn("short", F.lit(True))
    weight = F.when(F.col("short"), F.lit(1 << 40)).otherwise(F.coalesce("partners", F.lit(0)))
    ranked = long.join(partners, "canon", "left").join(short, "canon", "left").withColumn("partners", weight)
    least = ranked.groupBy("name").agg(F.min("partners").alias("least"))
    roots = ranked.join(least, "name").where(F.col("partners") == F.col("least")).select("name", F.col("canon").alias("root")).distinct()
    # a list of one name's own tokens
    rest = each.groupBy("name").agg(F.sort_array(F.collect_list(F.struct("pos", "token", "canon", "names"))).alias("toks"))
    rooted = roots.join(rest, "name").join(named.select("name", "family", "ticker"), "name").select("root", "name", "family", "ticker", "toks")
    out = cut(_with_blocks(rooted), "placed")
    for t in (canon, each, partners):
        forget(t)
    return out


def _tickers(named: DataFrame, placed: DataFrame) -> DataFrame:
    """(name, family, root): tickers whose letters open the consonants of just one organisation's root."""
    skel = F.upper(F.regexp_replace("root", "[aeiou]", ""))
    firsts = placed.where("family = 'org' and not ticker").select("root").distinct().select(
        "root", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(4), F.lit(6)), lambda k: F.substring(skel, F.lit(1), k)))).alias("t"))
    ticks = named.where("ticker").select("name", F.trim("name").alias("t"))
    one = ticks.join(firsts, "t").groupBy("name").agg(F.min("root").alias("root"), F.max("root").alias("other")).where("root = other")
    return one.select("name", F.lit("org").alias("family"), "root")


def _with_blocks(rooted: DataFrame) -> DataFrame:
    """(root, family, name, ticker, rest, words, ns, sigs, owns): a name's tokens besides its root, and their blocks."""

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples():
                used, d, c, n = False, [], [], []
                for t in r.toks:
                    if t["canon"] == r.root and not used:
                        used = True
                    else:
                        d.append(t["token"])
                        c.append(t["canon"])
                        n.append(int(t["names"]))
                sigs = signatures(d, c) if d else []
                words = [x for t, x in zip(d, c) if not initial(t)]
                out.append((r.root, r.family, r.name, r.ticker, " ".join(d), words, n, [s for s, _ in sigs], [o for _, o in sigs]))
            yield pd.DataFrame(out, columns=["root", "family", "name", "ticker", "rest", "words", "ns", "sigs", "owns"])

    return rooted.mapInPandas(
        place, "root string, family string, name string, ticker boolean, rest string, words array<string>, ns array<long>, sigs array<string>, owns array<boolean>")


def _block_links(nodes: DataFrame) -> DataFrame:
    """(root, family, a, b, short): links found inside the blocks, streamed block after block."""

    def judge(key: tuple, rows: dict, known: dict[str, int]) -> list:
        def distinct(x: str, y: str) -> bool:
            lo, hi = sorted((known.get(x, 0), known.get(y, 0)))
            return lo >= ESTABLISHED and lo * RATIO > hi and sorted(x) != sorted(y)

        return [(key[0], key[1], " ".join(a), " ".join(b), s) for a, b, s in link_block(rows, distinct)]

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, rows, known, out = None, {}, {}, []
        for b in batches:
            for root, family, sig, rest, words, ns, own in zip(b["root"], b["family"], b["sig"], b["rest"], b["words"], b["ns"], b["own"]):
                key = (root, family, sig)
                if key != at:
                    out += judge(at, rows, known) if rows else []
                    at, rows, known = key, {}, {}
                d = tuple(rest.split(" "))
                rows[d] = (bool(own), tuple(words))
                for t, n in zip(d, ns):
                    known[t] = max(known.get(t, 0), int(n))
            yield pd.DataFrame(out, columns=["root", "family", "a", "b", "short"])
            out = []
        yield pd.DataFrame(judge(at, rows, known) if rows else [], columns=["root", "family", "a", "b", "short"])

    keys = ["root", "family", "sig"]
    placed = fan_out(nodes, *keys).sortWithinPartitions(*keys, "rest")
    return placed.mapInPandas(scan, "root string, family string, a string, b string, short boolean")


def name_groups(mentions: DataFrame) -> DataFrame:
    """(group_id, root, name): every spelling that is linked to another one, once for each of its entities.

    A spelling whose root is open (two equally rare tokens) may stand in two groups. Null
    names, numbers, generic words and labels that name no entity belong to no group;
    repeated mentions count once; an empty table gives no rows.
    """
    named = cut(_tokenised(_spellings(mentions)), "spellings")
    placed = _placed(named)
    of = ["root", "family"]
    nodes = placed.where("rest <> ''").select(
        *of, "rest", "words", "ns", F.explode(F.arrays_zip("sigs", "owns")).alias("s")).select(
        *of, F.col("s.sigs").alias("sig"), "rest", "words", "ns", F.col("s.owns").alias("own")).dropDuplicates([*of, "sig", "rest"])
    links = cut(_block_links(nodes), "links")
    # a short form that could mean two entities is linked to neither
    home = links.where("not short").select(*of, "a", F.col("b").alias("rep"))
    means = links.where("short").groupBy(*of, "a").agg(F.min("b").alias("b"), F.max("b").alias("other"))
    node = lambda c: F.concat_ws("\u0001", *of, c)
    rep = F.coalesce("rep", "a")
    between = means.where("b = other").join(home, [*of, "a"], "left").select(node(rep).alias("u"), node(F.col("b")).alias("v")).where("u <> v")
    merged = components(between)
    comp = merged.withColumnsRenamed({"node": "class", "root": "least"})
    initials = F.expr("forall(split(rest, ' '), t -> length(t) = 1 and lower(t) <> upper(t))")
    open_ = means.where("b <> other").select(*of, F.col("a").alias("rest"), F.lit(True).alias("open"))
    own = placed.where("rest <> ''").select(*of, "name", "rest").join(open_, [*of, "rest"], "left").where(F.col("open").isNull() | ~initials)
    own = own.join(home.withColumnRenamed("a", "rest"), [*of, "rest"], "left").withColumn("class", node(F.coalesce("rep", "rest")))
    own = own.join(comp, "class", "left").select(*of, "name", F.coalesce("least", "class").alias("entity"))
    own = cut(own, "entities")
    # a bare root, or a ticker, means the only entity under it
    bare = placed.where("rest = ''").select(*of, "name").unionByName(_tickers(named, placed).select(*of, "name")).distinct()
    under = own.groupBy(*of).agg(F.min("entity").alias("entity"), F.max("entity").alias("other"))
    bare = bare.join(under, of, "left").where("entity is null or entity = other").select(
        *of, "name", F.coalesce("entity", F.concat_ws("\u0001", *of)).alias("entity"))
    each = own.unionByName(bare).select("root", "name", F.md5("entity").alias("group_id")).distinct()
    each = cut(each, "members")
    for t in (named, placed, links, merged, own):
        forget(t)
    linked = each.groupBy("group_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("group_id")
    return each.join(linked, "group_id", "left_semi").select("group_id", "root", "name")


def name_pairs(groups: DataFrame) -> DataFrame:
    """(name_a, name_b): the pairs of different spellings of every group, name_a first by code point."""
    a = groups.select("group_id", F.col("name").alias("name_a"))
    b = groups.select("group_id", F.col("name").alias("name_b"))
    return a.join(b, "group_id").where("name_a < name_b").select("name_a", "name_b").distinct()


def membership(groups: DataFrame) -> DataFrame:
    """(group_id, root, entity_surface): every linked spelling with each group it belongs to."""
    return groups.select("group_id", "root", F.col("name").alias("entity_surface"))
