"""Held-out items whose passages appear in a corpus.

Texts become word sequences (case, punctuation, spacing, markup and invisible characters
gone). Every window of ``WINDOW`` words of an item is a test string. A Wu-Manber search
over words finds them: a shift table on two-word blocks skips the positions where no test
string can end, a bucket table on the last block selects the test strings that can, and
comparison of the numbered words confirms. Confirmed windows of one item that lie on
neighbouring diagonals form passages, and the item has leaked when the union of one or two
passages holds at least a third of its words.

One pass over the corpus, no shuffle: the search tables are built once on the driver and
sent to the tasks, the corpus stays where it is. Items of more than ``MAX_WORDS`` words
together are searched in several passes, so their number has no bound.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presswork.session import spread

#: Words of held-out items whose tables go to the tasks in one pass over the corpus.
MAX_WORDS = 2_000_000
#: Words of a test string: two blocks of two.
WINDOW = 4
#: Share of an item's words that must be found, and in how many passages.
SHARE, PASSAGES = 1 / 3, 2
#: Words that may stand between two confirmed stretches of one passage, on either side, and
#: by how many words the two sides may differ there.
GAP, DRIFT = 6, 3
#: A passage must have at least so many of the item's words, or all of a shorter item.
MIN_PASSAGE = 12
#: Windows of more items than this are no reason by themselves to look at an item.
COMMON = 3

#: Texts searched at a time.
TEXTS = 200

#: Tags and links of any length; no part can be read twice, so the time is linear.
_TAG = re.compile(r"</?[a-zA-Z!?][^<>]*>|!?\[([^\[\]\n]*)\]\([^()\s]*\)")
_WORD = re.compile(r"[^\W_]+")
_ASCII_WORD = re.compile(r"[a-z0-9]+")
_HIDDEN = re.compile("[\u00ad\u200b\u200c\u200d\u2060\ufeff\u200e\u200f'\u2019\u2018\u02bc`\u00b4]")


def words(text: str | None) -> list[str]:
    """The words of a text, lower case, without markup, marks and apostrophes."""
    if not text:
        return []
    if "<" in text or "](" in text:
        text = _TAG.sub(lambda m: f" {m.group(1) or ''} ", text)
    if "&" in text:
        text = html.unescape(text)
    if text.isascii():
        return _ASCII_WORD.findall(text.lower().replace("'", "").replace("-\n", ""))
    text = unicodedata.normalize("NFKC", _HIDDEN.sub("", text))
    return _WORD.findall(text.lower().replace("-\n", ""))


class WuManber:
    """Multi-pattern search over numbered words; patterns are distinct windows of two two-word blocks.

    The search runs over whole batches of texts at once. The shift table says for every
    block how far from its end the nearest test string could end; only positions with
    shift 0 are looked at further. Their suffix block selects the bucket, and the first
    block must then be that of a test string of the bucket. Blocks are numbered from a
    sorted table of all blocks, so equal numbers mean equal words: no hash decides.
    """

    TABLE = 1 << 22

    def __init__(self, patterns: list[tuple[str, ...]]) -> None:
        m = WINDOW
        self.number = {w: i for i, w in enumerate(sorted({w for p in patterns for w in p}), 1)}
        self.base = np.int64(len(self.number) + 1)  # two words stay far below 2^63
        ids = np.array([[self.number[w] for w in p] for p in patterns], dtype=np.int64).reshape(len(patterns), m)
        self.shift = np.full(self.TABLE, m - 1, dtype=np.int8)
        for q in range(1, m):
            # a shared table place keeps the smaller shift: nothing is skipped wrongly
            np.minimum.at(self.shift, self._place(self._block(ids[:, q - 1], ids[:, q])), np.int8(m - 1 - q))
        prefix, suffix = self._block(ids[:, 0], ids[:, 1]), self._block(ids[:, 2], ids[:, 3])
        self.prefixes, self.suffixes = np.unique(prefix), np.unique(suffix)
        codes = np.searchsorted(self.suffixes, suffix) * np.int64(len(self.prefixes) + 1) + np.searchsorted(self.prefixes, prefix)
        self.order = np.argsort(codes, kind="stable")
        self.codes = codes[self.order]

    def _block(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return a * self.base + b

    def _place(self, block: np.ndarray) -> np.ndarray:
        return block % np.int64(self.TABLE)

    @staticmethod
    def _find(table: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(table, x), len(table) - 1)
        return at, table[at] == x

    def search(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, pattern) of every occurrence in the numbered words; 0 is a word of no pattern."""
        none = np.zeros(0, dtype=np.int64)
        if len(ids) < WINDOW or not len(self.codes):
            return none, none
        block = self._block(ids[:-1], ids[1:])
        start = np.flatnonzero(self.shift[self._place(block[2:])] == 0)
        bucket, ok = self._find(self.suffixes, block[start + 2])
        start, bucket = start[ok], bucket[ok]
        first, ok = self._find(self.prefixes, block[start])
        start, bucket, first = start[ok], bucket[ok], first[ok]
        at, ok = self._find(self.codes, bucket * np.int64(len(self.prefixes) + 1) + first)
        return start[ok], self.order[at[ok]]


def _reach(ks: np.ndarray, floor: int) -> int:
    """Most words that two passages made of windows at ``ks`` (rising) can hold.

    Within a passage the windows' places in the item go on by at most ``WINDOW + GAP``, so
    a passage lies inside one run of such places.
    """
    if not len(ks):
        return 0
    d = np.diff(ks)
    words = np.append(np.minimum(d, WINDOW), WINDOW)
    ends = np.flatnonzero(np.append(d > WINDOW + GAP, True))
    runs = np.diff(np.concatenate([[0], np.cumsum(words)[ends]]))
    return int(np.sort(runs[runs >= floor])[-PASSAGES:].sum())


class Index:
    """The test strings of items, and which of them make an item worth a comparison.

    Windows that many items share (instructions, stock phrases) stand in many texts. They
    lead to an item only if they alone could make up its passages; any other item that has
    leaked shows at least one rarer window. An item so met is then judged by all its
    windows, common ones included, so nothing is lost.
    """

    def __init__(self, items: Iterable[tuple[int, str]]) -> None:
        seqs = {item: w for item, text in items if len(w := words(text)) >= WINDOW}
        self.items = list(seqs)
        self.length = np.array([len(w) for w in seqs.values()], dtype=np.int64)
        self.need = SHARE * self.length
        self.floor = np.minimum(MIN_PASSAGE, self.length)
        number: dict[tuple[str, ...], int] = {}
        own = [np.array([number.setdefault(g, len(number)) for g in zip(*[w[i:] for i in range(WINDOW)])], dtype=np.int64)
               for w in seqs.values()]
        self.search = WuManber(list(number))
        self.size = np.array([len(p) for p in own], dtype=np.int64)
        self.begin = np.cumsum(self.size) - self.size
        self.flat = np.concatenate(own) if own else np.zeros(0, dtype=np.int64)  # pattern of every window of every item
        shared = np.zeros(len(number), dtype=np.int64)
        for p in own:
            shared[np.unique(p)] += 1
        leads = [[], []]  # pattern, item
        for i, p in enumerate(own):
            common = np.flatnonzero(shared[p] > COMMON)
            alone = _reach(common, self.floor[i]) >= self.need[i] - 1e-9
            lead = np.unique(p if alone else np.delete(p, common))
            leads[0].append(lead)
            leads[1].append(np.full(len(lead), i, dtype=np.int64))
        pattern, item = (np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in leads)
        self.lead = item[np.argsort(pattern, kind="stable")]
        self.many = np.bincount(pattern, minlength=len(number))
        self.first = np.cumsum(self.many) - self.many
        self.present = np.zeros(len(number), dtype=bool)

    def _pairs(self, pattern: np.ndarray) -> np.ndarray:
        """Items that the patterns of one text lead to and that enough of their windows stand in it."""
        p = np.unique(pattern)
        n = self.many[p]
        near = np.unique(self.lead[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.first[p], n)])
        if not len(near):
            return near
        self.present[p] = True
        size = self.size[near]
        row = np.repeat(np.arange(len(near)), size)
        k = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        hit = self.present[self.flat[k + np.repeat(self.begin[near], size)]]
        self.present[p] = False
        row, k = row[hit], k[hit]
        enough = np.flatnonzero(np.bincount(row, minlength=len(near)) * WINDOW >= self.need[near] - 1e-9)
        lo, hi = np.searchsorted(row, enough), np.searchsorted(row, enough, side="right")
        return np.array([near[e] for e, a, b in zip(enough, lo, hi) if _reach(k[a:b], self.floor[near[e]]) >= self.need[near[e]] - 1e-9], dtype=np.int64)

    def _hits(self, i: int, at: np.ndarray, pattern: np.ndarray) -> list[tuple[int, int]]:
        """(text position, item position) of every window of item ``i`` in a text, by text position."""
        own: dict[int, list[int]] = defaultdict(list)
        for k, p in enumerate(self.flat[self.begin[i]:self.begin[i] + self.size[i]].tolist()):
            own[p].append(k)
        return [(t, k) for t, p in zip(at.tolist(), pattern.tolist()) for k in own.get(p, ())]

    def leaked(self, texts: list[str | None]) -> list[list[tuple[int, float]]]:
        """For every text the (item, share of its words found in its best passages) that leaked."""
        number = self.search.number.get
        gap = [0] * WINDOW  # between texts, so that no window reaches over their border
        ids: list[int] = []
        begins = []
        for t in texts:
            begins.append(len(ids))
            ids += [number(x, 0) for x in words(t)]
            ids += gap
        at, pattern = self.search.search(np.array(ids, dtype=np.int64))
        edge = np.searchsorted(at, [*begins, len(ids)])
        out: list[list[tuple[int, float]]] = []
        for a, b in zip(edge[:-1], edge[1:]):
            found = []
            for i in self._pairs(pattern[a:b]) if b > a else ():
                n = best_passages(passages(self._hits(i, at[a:b], pattern[a:b]), int(self.floor[i])))
                if n >= self.need[i] - 1e-9:
                    found.append((self.items[i], n / int(self.length[i])))
            out.append(found)
        return out


def passages(hits: list[tuple[int, int]], floor: int) -> list[list[tuple[int, int]]]:
    """Stretches [first, last) of the item's words in each passage of at least ``floor`` words.

    ``hits`` are windows (text position, item position) by text position. A window goes on
    a passage whose last window lies before it by at most ``WINDOW + GAP`` on both sides
    and on a diagonal at most ``DRIFT`` away, nearest first: an odd word more, less or other
    does not break a passage. Windows at one text position never follow each other.
    """
    live: dict[int, list] = {}  # diagonal: [item position, text position, words, stretches]
    done = []
    order = sorted(range(-DRIFT, DRIFT + 1), key=abs)
    far = WINDOW + GAP
    for t, k in hits:
        g = t - k
        c = None
        for o in order:
            x = live.get(g + o)
            if x is not None and 0 < k - x[0] <= far and 0 < t - x[1] <= far:
                c = x
                del live[g + o]
                break
        if c is None:
            c = [k, t, WINDOW, [[k, k + WINDOW]]]
            done.append(c)
        else:
            c[2] += min(k - c[0], WINDOW)
            if k <= c[3][-1][1]:
                c[3][-1][1] = k + WINDOW
            else:
                c[3].append([k, k + WINDOW])
            c[0], c[1] = k, t
        live[g] = c
    return [[tuple(s) for s in c[3]] for c in done if c[2] >= floor]


def best_passages(found: list[list[tuple[int, int]]]) -> int:
    """Most of the item's words in the union of at most ``PASSAGES`` = 2 passages."""
    masks = sorted({sum(((1 << (b - a)) - 1) << a for a, b in p) for p in found}, key=int.bit_count, reverse=True)
    sizes = [m.bit_count() for m in masks]
    best = sizes[0] if sizes else 0
    for i, m in enumerate(masks):
        for j in range(i + 1, len(masks)):
            if sizes[i] + sizes[j] <= best:
                break
            best = max(best, (m | masks[j]).bit_count())
    return best


def _in_parts(items: Iterator, max_words: int) -> Iterator[list[tuple[int, str]]]:
    part, n = [], 0
    for item, text in items:
        part.append((item, text))
        n += len(text) // 4 + 1
        if n >= max_words:
            yield part
            part, n = [], 0
    if part:
        yield part


def find_leaks(documents: DataFrame, items: DataFrame, max_words: int = MAX_WORDS) -> DataFrame:
    """(doc_id, item_id, share): every document that holds at least a third of an item's words.

    Whole texts are searched. Null or empty texts hold nothing, items shorter than a test
    string (four words) are not looked for, a repeated item_id keeps its longest text, and
    documents repeated under other ids are all reported. Other columns do not matter. Items
    come to the driver part by part, about ``max_words`` words at a time, and each part is
    searched in a pass of its own.
    """
    own = items.where("item_id is not null and text is not null").groupBy("item_id").agg(
        F.max(F.struct(F.length("text"), "text"))["text"].alias("text")).orderBy("item_id")
    src = documents.where("doc_id is not null and text is not null").select("doc_id", "text")
    sc = documents.sparkSession.sparkContext
    schema = "doc_id long, item_id long, share double"

    def search(index: Index) -> DataFrame:
        shipped = sc.broadcast(index)

        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            index = shipped.value  # kept by the worker for all its tasks
            for b in batches:
                found = [index.leaked(list(b["text"].iloc[i:i + TEXTS])) for i in range(0, len(b), TEXTS)]
                rows = [(d, i, s) for d, hits in zip(b["doc_id"], (x for part in found for x in part)) for i, s in hits]
                yield pd.DataFrame(rows, columns=["doc_id", "item_id", "share"])

        return spread(src).mapInPandas(scan, schema)

    passes = [search(Index(p)) for p in _in_parts(((r["item_id"], r["text"]) for r in own.toLocalIterator()), max_words)]
    return reduce(DataFrame.unionByName, passes) if passes else documents.sparkSession.createDataFrame([], schema)
