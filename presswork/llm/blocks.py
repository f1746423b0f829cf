"""The main body of pages: flat text blocks classified by a decision tree.

A page is cut into its lines. Every block is described by its words, its link density (how
much of it are short separated pieces, as menus and tag lists have once the links are gone)
and those of its neighbours, by where the paragraphs lie around it, and, unless left
out, by how its words spread over the classes of a small labelled table
(``blocks_labelled.tsv``). A decision tree grown on that table separates main body from furniture. Pages are independent of each
other, so one pass without shuffle does it; only sentences, which arrive as rows, are first
brought together by document.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from importlib import resources

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presswork.llm.lines import site_of
from presswork.session import spread

_HIDDEN = re.compile("[\u00ad\u200b\u200c\u200d\u2060\ufeff\u180e\u200e\u200f]")
_PIECE = re.compile(r"\s*[|·•/>»]\s*|\s{2,}|,\s+")
_SEPARATOR = re.compile(r"[|·•/>»,\t]|\s{2}")
_DIGIT = re.compile(r"\d")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*|\d+")
_CLOCK = re.compile(r"\d{1,2}[:h.]\d{2}\b|\d{4}-\d{2}-\d{2}|\d{1,2}[./]\d{1,2}[./]\d{2,4}")
_BULLET = re.compile(r"\s*(?:[-–—*•‣▪◦]|\d{1,2}[.)])\s+")
_ENDS = re.compile(r"[.!?…][\"'”’»)]*$")
_LABEL = re.compile(r"^[^\s:>—–]{1,20}(?:\s[^\s:>—–]{1,20}){0,3}\s?[:>—–]\s")
#: Words that speak to the reader, in the four languages of the corpus (fixed values).
READER = frozenset(
    "you your yours our us we join subscribe click sign enter ihr ihre ihren ihrem sie wir unser unsere jetzt vous votre vos nous notre nos "
    "abonnez recevez saisissez tu tus te su nuestro nuestra nos recibe suscríbete escribe".split()
)
FEATURES = (
    "words", "link", "sentence_end", "bullet", "clock", "digits", "capitals", "label", "copyright", "reader", "site", "title",
    "odds", "odds_first", "odds_last", "prev_words", "next_words", "prev_link", "next_link", "paragraphs_before",
    "paragraphs_after", "gap_before", "gap_after", "depth",
)
_AT = {f: i for i, f in enumerate(FEATURES)}
#: Further block features where the word odds are left out: neighbours' ends, neighbours at
#: distance two, length against the page's median, places from both ends, runs of short blocks.
WIDE = 14


def clean(line: str) -> str:
    if line.isascii():
        return " ".join(line.split())
    return " ".join(_HIDDEN.sub("", unicodedata.normalize("NFKC", line)).split())


def _mask(words: list[str]) -> list[str]:
    return ["0" if w.isdigit() else w.lower() for w in words]


class Odds:
    """Log odds of a word being furniture, from counts of blocks per class."""

    def __init__(self, furniture: Counter, body: Counter, least: int = 3, wide: bool = False) -> None:
        self.wide = wide
        nf, nb = max(1, sum(furniture.values())), max(1, sum(body.values()))
        self.lines: dict[str, tuple] = {}
        self.of = {
            w: float(np.log((furniture[w] + 0.5) / (nf + 1)) - np.log((body[w] + 0.5) / (nb + 1)))
            for w in furniture.keys() | body.keys() if furniture[w] + body[w] >= least
        }

    def three(self, words: list[str]) -> tuple[float, float, float]:
        if not words:
            return 0.0, 0.0, 0.0
        get = self.of.get
        known = [x for x in map(get, words) if x]
        first = get("^" + " ".join(words[:2]), get(words[0], 0.0))
        last = get(words[-1] + "$", get(words[-1], 0.0))
        return (sum(known) / len(known) if known else 0.0), first, last

    @staticmethod
    def keys(words: list[str]) -> set[str]:
        return {*words, "^" + " ".join(words[:2]), words[-1] + "$"} if words else set()


def line_features(raw: str, odds: Odds) -> tuple:
    """What a line says by itself: its numbers, its words and its letters without spaces."""
    y = clean(raw)
    words = _WORD.findall(y)
    low = " ".join(words).lower().split(" ") if words else []
    k = len(words)
    digits = 0
    if _DIGIT.search(y):
        for i, w in enumerate(words):
            if w.isdigit():
                low[i] = "0"
                digits += 1
    link = 0.0
    marks = len(_SEPARATOR.findall(raw))
    if marks >= 2 and k <= 8 * (marks + 1):  # pieces of more words on average are prose
        pieces = [p for p in _PIECE.split(raw.strip()) if p]
        if len(pieces) >= 3:
            link = sum(1 for p in pieces if p.count(" ") <= 2) / len(pieces)
    kinds = set(low)
    reader = 0 if READER.isdisjoint(kinds) else sum(w in READER for w in low)
    numbers = (
        k, link, bool(_ENDS.search(y[-8:])), bool(_BULLET.match(raw)), digits > 1 and bool(_CLOCK.search(y)),
        digits / k if k else 0, sum(map(str.istitle, words)) / k if k else 0,
        bool(_LABEL.match(y)), "©" in raw, reader, *odds.three(low))
    return numbers, kinds, y.lower().replace(" ", "")


def wide_features(x: np.ndarray) -> np.ndarray:
    """``WIDE`` more columns for the blocks of one page."""
    w, link, end = (x[:, _AT[f]] for f in ("words", "link", "sentence_end"))
    n = len(x)

    def shifted(a: np.ndarray, d: int) -> np.ndarray:
        out = np.zeros(n, dtype=np.float32)
        if abs(d) < n:
            out[max(0, -d):n - max(0, d)] = a[max(0, d):n + min(0, d)]
        return out

    cols = [shifted(a, d) for d in (-2, 2) for a in (w, link, end)] + [shifted(end, d) for d in (-1, 1)]
    short = (w < 9) | (end == 0)
    at = np.arange(n)
    # a run's blocks share the number of long blocks before them
    group = np.cumsum(~short)
    run = np.bincount(group, short, minlength=n + 1)[group] * short
    prose = w * end
    cols += [w / max(float(np.median(w)) if n else 1.0, 1.0), at, n - 1 - at, run, np.full(n, n), shifted(prose, -1) + shifted(prose, 1)]
    return np.stack(cols, axis=1).astype(np.float32) if n else np.zeros((0, WIDE), dtype=np.float32)


def page_features(lines: list[str], title: str | None, site: str | None, odds: Odds) -> np.ndarray:
    """One row of ``FEATURES`` for every non-blank line of a page; without word odds, the wide ones too."""
    n = len(lines)
    x = np.zeros((n, len(FEATURES)), dtype=np.float32)
    t = set(_mask(_WORD.findall(clean(title)))) if title else set()
    host = re.split(r"[.\-_]", site) if site else []
    host = [h for h in host if len(h) >= 5 and h not in ("example", "https")]
    name = max(host, key=len)[:6] if host else None
    kept = odds.lines
    rows = []
    for raw in lines:
        f = kept.get(raw)
        if f is None:
            f = line_features(raw, odds)
            if len(raw) <= 160:  # furniture repeats; a full memory starts anew and changes no result
                if len(kept) >= 50_000:
                    kept.clear()
                kept[raw] = f
        v, kinds, joined = f
        rows.append((*v[:10], name is not None and name in joined, len(t & kinds) / max(len(t), len(kinds)) if t and kinds else 0, *v[10:]))
    own = _AT["odds_last"] + 1
    x[:, :own] = rows if rows else np.zeros((0, own))
    col = {f: x[:, i] for f, i in _AT.items()}
    for f in ("words", "link"):
        col["prev_" + f][1:], col["next_" + f][:-1] = col[f][:-1], col[f][1:]
    para = (col["words"] >= 9) & (col["sentence_end"] > 0) & (col["odds"] < 0.5)
    before = np.cumsum(para) - para
    col["paragraphs_before"][:], col["paragraphs_after"][:] = before, para.sum() - before - para
    at = np.flatnonzero(para)
    if len(at):
        i = np.arange(n)
        j = np.searchsorted(at, i, side="left")
        col["gap_before"][:] = np.where(j > 0, i - at[np.maximum(j - 1, 0)], 99)
        col["gap_after"][:] = np.where(j < len(at), at[np.minimum(j, len(at) - 1)] - i, 99)
    else:
        col["gap_before"][:] = col["gap_after"][:] = 99
    col["depth"][:] = np.arange(n) / max(1, n - 1)
    return np.hstack([x, wide_features(x)]) if odds.wide else x


class Tree:
    """A binary decision tree grown by Gini impurity; deterministic for a given table."""

    def __init__(self, depth: int = 12, leaf: int = 8) -> None:
        self.depth, self.leaf = depth, leaf
        self.feature: list[int] = []
        self.cut: list[float] = []
        self.left: list[int] = []
        self.right: list[int] = []
        self.share: list[float] = []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Tree:
        self._grow(x, y.astype(float), 0)
        self.arrays = tuple(np.array(v) for v in (self.feature, self.cut, self.left, self.right, self.share))
        return self

    def _grow(self, x: np.ndarray, y: np.ndarray, d: int) -> int:
        me = len(self.feature)
        for v, z in ((self.feature, -1), (self.cut, 0.0), (self.left, -1), (self.right, -1), (self.share, float(y.mean()) if len(y) else 0.0)):
            v.append(z)
        if d >= self.depth or len(y) < 2 * self.leaf or y.min() == y.max():
            return me
        best = (0.0, -1, 0.0)
        base = y.mean() * (1 - y.mean()) * len(y)
        for f in range(x.shape[1]):
            o = np.argsort(x[:, f], kind="stable")
            v, s = x[o, f], np.cumsum(y[o])
            k = np.arange(1, len(y))
            ok = (v[1:] > v[:-1]) & (k >= self.leaf) & (len(y) - k >= self.leaf)
            if not ok.any():
                continue
            l, r = s[:-1], s[-1] - s[:-1]
            gain = base - (l * (1 - l / k) + r * (1 - r / (len(y) - k)))
            gain = np.where(ok, gain, -1)
            j = int(np.argmax(gain))
            if gain[j] > best[0] + 1e-9:
                best = (float(gain[j]), f, float((v[j] + v[j + 1]) / 2))
        if best[1] < 0:
            return me
        m = x[:, best[1]] <= best[2]
        self.feature[me], self.cut[me] = best[1], best[2]
        self.left[me] = self._grow(x[m], y[m], d + 1)
        self.right[me] = self._grow(x[~m], y[~m], d + 1)
        return me

    def predict(self, x: np.ndarray) -> np.ndarray:
        feature, cut, left, right, share = self.arrays
        at = np.zeros(len(x), dtype=np.int64)
        for _ in range(self.depth + 1):
            f = feature[at]
            inner = f >= 0
            if not inner.any():
                break
            go = x[np.arange(len(x)), np.maximum(f, 0)] <= cut[at]
            at = np.where(inner, np.where(go, left[at], right[at]), at)
        return share[at] >= 0.5


def labelled_pages() -> list[tuple[str, str, list[str], list[int]]]:
    """(title, site, blocks, 1 for furniture) of every page of the labelled table."""
    pages: list = []
    text = resources.files("presswork.llm").joinpath("blocks_labelled.tsv").read_text(encoding="utf-8")
    for row in text.split("\n"):
        kind, _, rest = row.partition("\t")
        if kind == "#":
            title, _, site = rest.partition("\t")
            pages.append((title, site, [], []))
        elif kind in ("B", "F"):
            pages[-1][2].append(rest)
            pages[-1][3].append(int(kind == "F"))
    return pages


class Classifier:
    """Tree over block features, fitted on labelled pages; ``words`` adds the word odds to them.

    Without the odds nothing of the labelled table's vocabulary is used.
    """

    def __init__(self, pages: list[tuple[str, str, list[str], list[int]]], words: bool = True) -> None:
        each = []
        total = (Counter(), Counter())
        for _, _, blocks, y in pages:
            own = (Counter(), Counter())
            for b, k in zip(blocks, y) if words else ():
                own[k].update(Odds.keys(_mask(_WORD.findall(clean(b)))))
            each.append(own)
            total[0].update(own[0])
            total[1].update(own[1])
        xs, ys = [], []
        for (title, site, blocks, y), own in zip(pages, each):
            if blocks:
                # a page's own words must not vouch for it while the tree is grown
                odds = Odds(total[1] - own[1], total[0] - own[0], wide=not words)
                xs.append(page_features(blocks, title, site, odds))
                ys.append(np.array(y))
        self.odds = Odds(total[1], total[0], wide=not words)
        self.tree = Tree().fit(np.concatenate(xs), np.concatenate(ys))

    def furniture(self, pages: list[tuple[list[str], str | None, str | None]]) -> list[np.ndarray]:
        """For every page (non-blank lines, title, site) which lines are furniture."""
        xs = [page_features(lines, title, site, self.odds) for lines, title, site in pages]
        if not xs:
            return []
        flags = self.tree.predict(np.concatenate(xs))
        ends = np.cumsum([len(x) for x in xs])[:-1]
        return np.split(flags, ends)


@lru_cache(maxsize=2)
def classifier(words: bool = True) -> Classifier:
    """The classifier of the shipped table; a few seconds' work, done once on the driver."""
    return Classifier(labelled_pages(), words)


def _blank(line: str) -> bool:
    return not _HIDDEN.sub("", line).strip()


def _ship(df: DataFrame, words: bool):
    """The fitted classifier, a few kilobytes of tree and word odds, for every task."""
    return df.sparkSession.sparkContext.broadcast(classifier(words))


def page_furniture(news: DataFrame, words: bool = True) -> DataFrame:
    """(doc_id, line_no) of every non-blank line outside the main body of its page.

    ``line_no`` counts from 0 over the text split at line ends. Whole texts are read;
    null and empty texts and null ids have no lines. Title and url may be null.
    """

    model = _ship(news, words)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = model.value
        for b in batches:
            pages, numbers = [], []
            for text, title, site in zip(b["text"], b["title"], b["site"]):
                kept = [(k, x) for k, x in enumerate(text.split("\n")) if not _blank(x)]
                numbers.append([k for k, _ in kept])
                pages.append(([x for _, x in kept], title, site))
            flags = c.furniture(pages)
            yield pd.DataFrame(
                [(d, k) for d, ks, fs in zip(b["doc_id"], numbers, flags) for k, f in zip(ks, fs) if f],
                columns=["doc_id", "line_no"])

    src = news.where("doc_id is not null and text is not null and length(text) > 0").select(
        "doc_id", "title", site_of(F.col("url")).alias("site"), "text")
    return spread(src).mapInPandas(scan, "doc_id long, line_no long")


def sentence_furniture(sentences: DataFrame, words: bool = True) -> DataFrame:
    """sent_uid of every sentence outside the main body, judged by its block within the kept blocks.

    Rows are brought together by document; repeated rows count once, a block is its
    sentences in order. Rows with a null id or text are left out.
    """

    model = _ship(sentences, words)

    def judge(c: Classifier, docs: list[tuple[str | None, str | None, dict]]) -> pd.DataFrame:
        """Furniture among the sentences of whole documents, all classified at once."""
        flags = c.furniture([([" ".join(v.values()) for v in blocks.values()], title, domain) for title, domain, blocks in docs])
        out = [u for (_, _, blocks), fs in zip(docs, flags) for v, f in zip(blocks.values(), fs) if f for u in v]
        return pd.DataFrame({"sent_uid": pd.Series(out, dtype=object)})

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = model.value
        docs: list[tuple[str | None, str | None, dict]] = []
        at = object()  # rows come by document; its last one may go on in the next batch
        for b in batches:
            for d, block, uid, title, domain, t in zip(b["doc_id"], b["block_id"], b["sent_uid"], b["title"], b["domain"], b["sentence_text"]):
                if d != at:
                    at = d
                    docs.append((title, domain, {}))
                if not _blank(t):
                    docs[-1][2].setdefault(block, {}).setdefault(uid, t)
            if len(docs) > 1:
                yield judge(c, docs[:-1])
                docs = docs[-1:]
        yield judge(c, docs)

    src = sentences.where("doc_id is not null and sent_uid is not null and sentence_text is not null").select(
        "doc_id", "block_id", "sent_id", "sent_uid", "title", "domain", "sentence_text")
    placed = src.repartition("doc_id").sortWithinPartitions("doc_id", "block_id", "sent_id")
    return placed.mapInPandas(scan, "sent_uid string")


def found(news: DataFrame, sentences: DataFrame, words: bool = True) -> DataFrame:
    """(origin, unit_key) of every line or sentence outside the main body; ``words`` as in :class:`Classifier`."""
    a = page_furniture(news, words).select(
        F.lit("news_final_project").alias("origin"), F.concat_ws(":", "doc_id", "line_no").alias("unit_key"))
    b = sentence_furniture(sentences, words).select(F.lit("sentences").alias("origin"), F.col("sent_uid").alias("unit_key"))
    return a.unionByName(b)


def main_bodies(news: DataFrame, words: bool = True) -> DataFrame:
    """Every document with its main body, lines in order, and the number of lines left out.

    A null or empty text gives an empty body.
    """

    model = _ship(news, words)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = model.value
        for b in batches:
            pages = [([x for x in (t or "").split("\n") if not _blank(x)], ti, s) for t, ti, s in zip(b["text"], b["title"], b["site"])]
            flags = c.furniture(pages)
            yield pd.DataFrame({
                "doc_id": b["doc_id"],
                "body": ["\n".join(x for x, f in zip(p[0], fs) if not f) for p, fs in zip(pages, flags)],
                "n_removed": [int(f.sum()) for f in flags]})

    src = news.select("doc_id", "title", site_of(F.col("url")).alias("site"), "text")
    return spread(src).mapInPandas(scan, "doc_id long, body string, n_removed long")
