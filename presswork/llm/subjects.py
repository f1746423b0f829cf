"""Subject areas of documents.

Paragraphs are weighted by term frequency and inverse document frequency, per language, and
projected on the leading singular subspace of the document-term matrix. The subspace is
found by randomised subspace iteration: each pass adds up ``A^T (A Q)`` over the documents
in blocks of terms, so no task and not the driver ever holds more than terms x rank
numbers. Subjects are centroids in that space, seeded by their names, glosses and the hand
labels and refined over all paragraphs; a document has the subjects a third of its own
paragraphs lie nearest. A text in none of the known languages, or without their frequent
words, goes to a space of its own.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presswork.llm.blocks import classifier
from presswork.session import cut, forget, spread

#: Terms are hashed to so many places per language; this bounds every model table.
TERMS = 1 << 16
#: Rank of the subspace per language, subspace iterations, refinements of the centroids.
RANK, PASSES, REFINE = 32, 2, 3
#: A term counts if it is in at least MIN_DOCS and MIN_SHARE and at most MAX_SHARE of a language's documents.
MIN_DOCS, MIN_SHARE, MAX_SHARE = 3, 0.0005, 0.50
#: Share of a document's paragraphs that makes a subject, least cosine, least lead over the next subject.
SHARE, COSINE, LEAD = 1 / 3, 0.15, 0.02
#: Terms summed in one block.
BLOCK = 2048
#: Fewest words of a paragraph, and of a text without paragraphs.
WORDS, LOOSE_WORDS = 8, 20
#: Least share of frequent words by which a text is taken for a language.
SURE = 0.12
#: Parts added up in one task.
FAN = 64
#: Subjects supported; names, glosses and centroids are held on the driver.
MAX_SUBJECTS = 10_000

# Frequent words by which the four languages are told apart.
STOP = {
    "en": "the of and to in a is that for on was with as by at from it an be are this has have had were which or not but its his her their "
          "they he she who will would could after before than more been about into over out up so said says also may there when what",
    "fr": "le la les de des du et un une en est que qui dans pour par sur au aux avec ne pas plus ce cette ces son sa ses leur il elle ils "
          "ont a été être se sont ou mais comme selon sans après avant depuis dit tout deux",
    "de": "der die das und in den von zu mit ist im des dem nicht ein eine auf für als auch es an werden aus er hat dass sie nach wird bei "
          "einer um am sind noch wie einem über so zum war haben nur oder aber vor zur bis mehr durch man sagte seit sich",
    "es": "el la los las de del y un una en que es por para con no se su sus al lo como más o pero ha han fue son este esta estos sin "
          "sobre entre desde hasta según dos también muy ya cuando todo",
}
LANGS = (*STOP, "other")
OTHER = len(STOP)
_STOP_OF: dict[str, list[int]] = {}
for _i, _l in enumerate(STOP):
    for _w in STOP[_l].split():
        _STOP_OF.setdefault(_w, []).append(_i)
_WORD = re.compile(r"[^\W\d_]{2,}")
_ENDS = re.compile(r"[.!?…][\"'”’»)\s]*$")


def term(word: str) -> int:
    return zlib.crc32(word.encode()) % TERMS


def paragraphs(text: str) -> tuple[list[list[str]], list[list[str]]]:
    """Words of a text's own paragraphs, lines that are long enough and end as sentences do, and of its other lines."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    out, loose = [], []
    for line in text.split("\n"):
        w = _WORD.findall(line.lower())
        if len(w) >= WORDS and len(line) >= 40 and _ENDS.search(line[-8:]):
            out.append(w)
        elif w:
            loose.append(w)
    return out, loose


def language(votes: list[int], words: int, lang: str | None) -> int:
    """The language whose frequent words stand out; else the one the table names; else ``other``."""
    best = int(np.argmax(votes))
    if words and votes[best] >= SURE * words:
        return best
    code = (lang or "").strip().lower()[:2]
    return LANGS.index(code) if code in STOP else OTHER


def tokenised(documents: DataFrame) -> DataFrame:
    """(doc_id, lang, ends, terms): hashed terms of every paragraph, one array, with its paragraphs' ends.

    Lines that read like page furniture by the word odds of the labelled blocks are no
    paragraphs of the document's own. A text without paragraphs (code, tables, lists,
    headlines) counts as one paragraph of all its other lines, if they have ``LOOSE_WORDS``
    words. Stubs, null and empty texts have no paragraphs and are left out.
    """

    odds = documents.sparkSession.sparkContext.broadcast(classifier().odds.of)

    def cutter(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache: dict[str, tuple[int, float]] = {}
        stop_of, furniture = _STOP_OF, odds.value

        def look(lines: list[list[str]]) -> tuple[list[int], int, list[list[int]]]:
            """Votes of frequent words, words, and the terms of every line that is no furniture."""
            votes, n, out = [0] * OTHER, 0, []
            for p in lines:
                own, score = [], 0.0
                for w in p:
                    t = cache.get(w)
                    if t is None:
                        t = cache[w] = (-1 if w in stop_of else term(w), furniture.get(w, 0.0))
                    score += t[1]
                    if t[0] >= 0:
                        own.append(t[0])
                    else:
                        for i in stop_of[w]:
                            votes[i] += 1
                n += len(p)
                if score <= 0:  # its words are not those of page furniture
                    out.append(own)
            return votes, n, out

        for b in batches:
            rows = []
            for doc, text, lang in zip(b["doc_id"], b["text"], b["lang"]):
                own, loose = paragraphs(text)
                votes, n, units = look(own)
                if not own and sum(map(len, loose)) >= LOOSE_WORDS:
                    votes, n, units = look(loose)
                    units = [[t for u in units for t in u]] if units else []
                if units:
                    ends = np.cumsum([len(u) for u in units]).tolist()
                    rows.append((doc, language(votes, n, lang), ends, [t for u in units for t in u]))
                if len(cache) > 2_000_000:
                    cache.clear()
            yield pd.DataFrame({
                "doc_id": pd.Series([r[0] for r in rows], dtype="int64"), "lang": pd.Series([r[1] for r in rows], dtype="int32"),
                "ends": pd.Series([r[2] for r in rows], dtype=object), "terms": pd.Series([r[3] for r in rows], dtype=object)})

    src = documents.where("doc_id is not null and text is not null and length(text) >= 40").select("doc_id", "text", "lang")
    return spread(src).mapInPandas(cutter, "doc_id long, lang int, ends array<int>, terms array<int>")


def _units(b: pd.DataFrame, lang: int, weight: np.ndarray, by_paragraph: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows of a batch in one language: (row, term, value) plus the rows' documents and row count.

    Rows are documents or paragraphs, values 1 + log tf times idf, each row of length 1.
    """
    own = b[b["lang"] == lang]
    if not len(own):
        z = np.zeros(0, dtype=np.int64)
        return z, z, np.zeros(0, dtype=np.float32), z, z
    lens = np.array([len(t) for t in own["terms"]])
    flat = np.concatenate([np.asarray(t, dtype=np.int64) for t in own["terms"]]) if lens.sum() else np.zeros(0, dtype=np.int64)
    if by_paragraph:
        n_par = np.array([len(e) for e in own["ends"]])
        ends = np.concatenate([np.asarray(e, dtype=np.int64) for e in own["ends"]])
        first = np.cumsum(lens) - lens
        ends = ends + np.repeat(first, n_par)
        sizes = np.diff(np.concatenate([[0], ends]))
        rows = np.repeat(np.arange(len(ends)), sizes)
        docs = np.repeat(np.arange(len(own)), n_par)
        count = len(ends)
    else:
        rows = np.repeat(np.arange(len(own)), lens)
        docs = np.arange(len(own))
        count = len(own)
    keep = weight[flat] > 0
    key, tf = np.unique(rows[keep] * TERMS + flat[keep], return_counts=True)
    row, col = key // TERMS, key % TERMS
    val = ((1 + np.log(tf)) * weight[col]).astype(np.float32)
    norm = np.sqrt(np.bincount(row, val * val, minlength=count))
    val = val / np.maximum(norm[row], 1e-12).astype(np.float32)
    return row, col, val, docs, np.arange(count)


def _project(row: np.ndarray, col: np.ndarray, val: np.ndarray, n: int, place: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Rows times ``q``; ``place`` maps terms to rows of ``q``. Entries come sorted by row."""
    out = np.zeros((n, q.shape[1]), dtype=np.float32)
    if len(row):
        starts = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        out[row[starts]] = np.add.reduceat(q[place[col]] * val[:, None], starts, axis=0)
    return out


def _sum_blocks(parts: DataFrame, tasks: int) -> dict[tuple[int, int], np.ndarray]:
    """Adds the tasks' partial blocks on the executors; the driver gets one block each.

    At most ``FAN`` parts meet in one group, level by level.
    """

    def add(g: pd.DataFrame) -> pd.DataFrame:
        total = None
        for p in g["part"]:
            x = np.frombuffer(p, dtype=np.float32)
            total = x.astype(np.float64) if total is None else total + x
        return pd.DataFrame({"lang": [g["lang"].iloc[0]], "block": [g["block"].iloc[0]], "part": [total.astype(np.float32).tobytes()]})

    s = "lang int, block int, part binary"
    parts = parts.withColumn("g", F.spark_partition_id())
    while tasks > FAN:
        tasks = -(-tasks // FAN)

        def level(g: pd.DataFrame) -> pd.DataFrame:
            return add(g).assign(g=g["g"].iloc[0])

        parts = parts.withColumn("g", F.col("g") % tasks).groupBy("lang", "block", "g").applyInPandas(level, s + ", g int")
    return {(r["lang"], r["block"]): np.frombuffer(r["part"], dtype=np.float32)
            for r in parts.groupBy("lang", "block").applyInPandas(add, s).toLocalIterator()}


def _tasks(df: DataFrame) -> int:
    return df.rdd.getNumPartitions()


class Space:
    """Term weights and subspace of every language: at most languages x TERMS x RANK numbers."""

    def __init__(self, weight: list[np.ndarray]) -> None:
        self.weight = weight
        self.terms = [np.flatnonzero(w > 0) for w in weight]
        self.place = []
        for t in self.terms:
            p = np.zeros(TERMS, dtype=np.int64)
            p[t] = np.arange(len(t))
            self.place.append(p)
        rng = np.random.default_rng(42)
        self.q = [np.linalg.qr(rng.standard_normal((len(t), min(RANK, len(t)))))[0].astype(np.float32) if len(t) else np.zeros((0, RANK), np.float32)
                  for t in self.terms]

    def embed(self, b: pd.DataFrame, lang: int) -> tuple[np.ndarray, np.ndarray]:
        """Unit vectors of a batch's paragraphs in one language, and their documents' places among its rows."""
        row, col, val, docs, n = _units(b, lang, self.weight[lang], True)
        e = _project(row, col, val, len(n), self.place[lang], self.q[lang])
        return e / np.maximum(np.linalg.norm(e, axis=1, keepdims=True), 1e-9), docs


def fit_space(tokens: DataFrame) -> Space:
    """Inverse document frequencies and leading subspace over all documents."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df = np.zeros((len(LANGS), TERMS), dtype=np.int64)
        n = np.zeros(len(LANGS), dtype=np.int64)
        for b in batches:
            for lang, t in zip(b["lang"], b["terms"]):
                df[lang, np.unique(np.asarray(t, dtype=np.int64))] += 1
                n[lang] += 1
        for lang in range(len(LANGS)):
            at = np.flatnonzero(df[lang])
            yield pd.DataFrame({"lang": np.int32(lang), "term": np.append(at, -1).astype("int32"), "n": np.append(df[lang, at], n[lang])})

    # at most languages x (TERMS + 1) rows come back
    rows = tokens.mapInPandas(count, "lang int, term int, n long").groupBy("lang", "term").agg(F.sum("n").alias("n")).toPandas()
    weight = []
    for lang in range(len(LANGS)):
        r = rows[rows["lang"] == lang]
        n = int(r.loc[r["term"] == -1, "n"].sum())
        w = np.zeros(TERMS, dtype=np.float32)
        r = r[(r["term"] >= 0) & (r["n"] >= max(MIN_DOCS, MIN_SHARE * n)) & (r["n"] <= max(MAX_SHARE * n, MIN_DOCS))]
        w[r["term"].to_numpy()] = np.log(max(n, 2) / r["n"].to_numpy()) + 0.1
        weight.append(w)
    space = Space(weight)
    sc = tokens.sparkSession.sparkContext
    for _ in range(PASSES):
        shipped = sc.broadcast(space)

        def gram(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            s = shipped.value
            y = [np.zeros(q.shape, dtype=np.float32) for q in s.q]
            for b in batches:
                for lang in range(len(LANGS)):
                    row, col, val, _, n = _units(b, lang, s.weight[lang], False)
                    if not len(row):
                        continue
                    p = _project(row, col, val, len(n), s.place[lang], s.q[lang])
                    o = np.argsort(col, kind="stable")
                    c = col[o]
                    starts = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
                    y[lang][s.place[lang][c[starts]]] += np.add.reduceat(p[row[o]] * val[o][:, None], starts, axis=0)
            for lang, m in enumerate(y):
                for k in range(0, len(m), BLOCK):
                    yield pd.DataFrame({"lang": [np.int32(lang)], "block": [np.int32(k)], "part": [m[k:k + BLOCK].tobytes()]})

        sums = _sum_blocks(tokens.mapInPandas(gram, "lang int, block int, part binary"), _tasks(tokens))
        for lang, q in enumerate(space.q):
            y = np.zeros(q.shape, dtype=np.float32)
            for (g, k), part in sums.items():
                if g == lang:
                    y[k:k + BLOCK] = part.reshape(-1, q.shape[1])
            if y.size and np.abs(y).max() > 0:
                space.q[lang] = np.linalg.qr(y.astype(np.float64))[0].astype(np.float32)
        shipped.unpersist()
    return space


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=-1, keepdims=True), 1e-9)


def _lead(sim: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Largest similarity of each row and its lead over the next; a single subject leads by itself."""
    if sim.shape[1] < 2:
        return sim[:, 0], sim[:, 0]
    two = np.partition(sim, -2, axis=1)
    return two[:, -1], two[:, -1] - two[:, -2]


def seed_centroids(space: Space, names: list[str], gloss: dict[str, str], tokens: DataFrame, labels: DataFrame, rounds: int = 2) -> list[np.ndarray]:
    """Per language subjects x rank: names, glosses and the paragraphs of hand-labelled documents.

    A document may treat more than its label, and some labels are wrong: in the first round
    a labelled document's paragraphs count as far as they fit the gloss, in the next ones
    those that lie nearest to their label by the round before count most.
    """
    cents = []
    for lang in range(len(LANGS)):
        m = np.zeros((len(names), space.q[lang].shape[1]), dtype=np.float32)
        for i, s in enumerate(names):
            words = _WORD.findall(f"{s} {gloss.get(s, '')}".lower())
            at = np.array(sorted({t for t in map(term, words) if space.weight[lang][t] > 0}), dtype=np.int64)
            if len(at):
                m[i] = space.weight[lang][at] @ space.q[lang][space.place[lang][at]]
        cents.append(_unit(m))
    gloss_cents = cents
    place = {s: i for i, s in enumerate(names)}
    clean = labels.select("doc_id", F.lower(F.trim("subject")).alias("subject")).na.drop().distinct().where(F.col("subject").isin(names))
    marked = cut(tokens.join(clean, "doc_id"), "marked")
    sc = tokens.sparkSession.sparkContext
    for turn in range(rounds):
        shipped = sc.broadcast((space, cents, turn))

        def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            s, c, turn = shipped.value
            sums = [np.zeros((len(names), q.shape[1]), dtype=np.float32) for q in s.q]
            for b in batches:
                for lang in range(len(LANGS)):
                    own = b[b["lang"] == lang]
                    if not len(own):
                        continue
                    e, docs = s.embed(b, lang)
                    subj = np.array([place[x] for x in own["subject"]])[docs]
                    sim = e @ c[lang].T
                    fit = sim[np.arange(len(e)), subj]
                    weight = np.clip(fit + 0.3, 0.1, 1.0) if turn == 0 else np.where(fit >= sim.max(axis=1) - 1e-6, 1.0, 0.05)
                    np.add.at(sums[lang], subj, e * weight[:, None])
            for lang, m in enumerate(sums):
                yield pd.DataFrame({"lang": [np.int32(lang)], "block": [np.int32(0)], "part": [m.tobytes()]})

        got = _sum_blocks(marked.mapInPandas(add, "lang int, block int, part binary"), _tasks(marked))
        cents = [c.copy() for c in gloss_cents]
        for (lang, _), part in got.items():
            m = part.reshape(len(names), -1)
            has = np.linalg.norm(m, axis=1) > 0
            cents[lang][has] = _unit(gloss_cents[lang][has] * (1.0 if turn == 0 else 0.5) + _unit(m[has]))
        shipped.unpersist()
    forget(marked)
    return cents


def refine(space: Space, cents: list[np.ndarray], tokens: DataFrame, rounds: int = REFINE) -> list[np.ndarray]:
    """Centroids moved to the mean of the paragraphs nearest to them, over all documents."""
    sc = tokens.sparkSession.sparkContext
    for _ in range(rounds):
        shipped = sc.broadcast((space, cents))

        def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            s, c = shipped.value
            sums = [np.zeros(m.shape, dtype=np.float32) for m in c]
            for b in batches:
                for lang in range(len(LANGS)):
                    e, _ = s.embed(b, lang)
                    if not len(e):
                        continue
                    sim = e @ c[lang].T
                    best = sim.argmax(axis=1)
                    top, lead = _lead(sim)
                    sure = (top >= COSINE) & (lead >= 0.1)
                    np.add.at(sums[lang], best[sure], e[sure])
            for lang, m in enumerate(sums):
                yield pd.DataFrame({"lang": [np.int32(lang)], "block": [np.int32(0)], "part": [m.tobytes()]})

        got = _sum_blocks(tokens.mapInPandas(add, "lang int, block int, part binary"), _tasks(tokens))
        new = []
        for lang, c in enumerate(cents):
            m = got[(lang, 0)].reshape(c.shape) if (lang, 0) in got else np.zeros_like(c)
            has = np.linalg.norm(m, axis=1) > 0
            n = c.copy()
            n[has] = _unit(0.2 * c[has] + _unit(m[has]))
            new.append(n)
        cents = new
        shipped.unpersist()
    return cents


def assign(space: Space, cents: list[np.ndarray], names: list[str], tokens: DataFrame) -> DataFrame:
    """(doc_id, subject, share): subjects nearest to at least a third of a document's paragraphs."""
    shipped = tokens.sparkSession.sparkContext.broadcast((space, cents))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s, c = shipped.value
        for b in batches:
            out = []
            for lang in range(len(LANGS)):
                own = b[b["lang"] == lang]
                if not len(own):
                    continue
                e, docs = s.embed(b, lang)
                sim = e @ c[lang].T
                best = sim.argmax(axis=1)
                top, lead = _lead(sim)
                ok = (top >= COSINE) & (lead >= LEAD)
                tally = np.zeros((len(own), len(names)))
                np.add.at(tally, (docs[ok], best[ok]), 1)
                n = np.bincount(docs, minlength=len(own))
                i, j = np.nonzero(tally >= SHARE * n[:, None] - 1e-9)
                good = tally[i, j] > 0
                ids = own["doc_id"].to_numpy()
                out += [(ids[x], names[y], tally[x, y] / n[x]) for x, y in zip(i[good], j[good])]
            yield pd.DataFrame(out, columns=["doc_id", "subject", "share"])

    return tokens.mapInPandas(scan, "doc_id long, subject string, share double")


def document_subjects(documents: DataFrame, subjects: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, subject, share) of every document with a subject.

    Subject names are read trimmed and lower-case, labels likewise; labels for unknown
    subjects or documents and repeated ones do not matter. A subject that has in a language
    neither a known word of its name and gloss nor a labelled document is not assigned
    there. Stubs, empty and null texts have no subject; an empty corpus gives no rows.
    """
    rows = subjects.select(F.lower(F.trim("subject")).alias("s"), "gloss").where("s is not null").orderBy("s").limit(MAX_SUBJECTS + 1).collect()
    if len(rows) > MAX_SUBJECTS:
        raise ValueError(f"more than {MAX_SUBJECTS} subjects")
    names = sorted({r["s"] for r in rows})
    gloss = {r["s"]: r["gloss"] or "" for r in rows}
    if not names:
        return documents.sparkSession.createDataFrame([], "doc_id long, subject string, share double")
    tokens = cut(tokenised(documents), "terms")
    space = fit_space(tokens)
    cents = refine(space, seed_centroids(space, names, gloss, tokens, labels), tokens)
    return assign(space, cents, names, tokens)
