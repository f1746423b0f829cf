"""Models and label services behind small interfaces, with deterministic offline defaults.

A provider works on whole Arrow batches; rows that fail get a status, never an exception,
and rows already done are left out by key before any is sent.
"""

from __future__ import annotations

import json
import re
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from presswork.session import spread
from presswork.sources.files import append_json_lines, done_keys

#: Names sent to the tasks in one pass.
NAMES = 500_000
#: How replies write truth values (fixed values).
TRUE_WORDS, FALSE_WORDS = ("true", "1", "1.0", "yes", "y"), ("false", "0", "0.0", "no", "n", "")


class Labeler:
    """Labels one text; raises ``Retry`` for passing trouble."""

    labels: tuple[str, ...] = ("0", "1")

    def __call__(self, text: str) -> tuple[str, float, str]:
        raise NotImplementedError


class Retry(Exception):
    """Worth another try after a pause."""


class KeywordLabeler(Labeler):
    """1 where a keyword occurs, with a fixed confidence: the offline default."""

    def __init__(self, pattern: str, confidence: float = 0.9) -> None:
        self.pattern, self.confidence = pattern, confidence

    def __call__(self, text: str) -> tuple[str, float, str]:
        hit = re.search(self.pattern, text)
        return ("1", self.confidence, "keyword") if hit else ("0", self.confidence, "no keyword")


def with_retry(call: Callable, tries: int = 5, cap: float = 20.0, sleep: Callable[[float], None] = time.sleep):
    """Repeats ``call`` while it raises ``Retry``, pausing min(2^attempt, cap) seconds."""
    for attempt in range(tries):
        try:
            return call()
        except Retry:
            if attempt == tries - 1:
                raise
            sleep(min(2.0**attempt, cap))
    return None


def label_rows(df: DataFrame, key: str, text: str, labeler: Labeler, done: DataFrame | None = None, workers: int = 8) -> DataFrame:
    """(key, label, confidence, reason, label_status): ok, parse_error for an unknown label, error for a failure.

    Requests of a batch run in a bounded pool of threads; results keep the rows' order.
    """
    todo = df.join(done.select(key), key, "left_anti") if done is not None else df
    kind = dict(df.dtypes)[key]

    def one(t: str | None) -> tuple:
        try:
            label, conf, reason = with_retry(lambda: labeler(t or ""))
        except Exception as e:  # one row's trouble is that row's status
            return None, None, str(e)[:200], "error"
        if label not in labeler.labels:
            return None, None, str(label)[:200], "parse_error"
        return label, min(1.0, max(0.0, float(conf))), reason[:200], "ok"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(workers) as pool:
            for b in batches:
                got = pd.DataFrame(list(pool.map(one, b[text])), columns=["label", "confidence", "reason", "label_status"])
                yield pd.concat([b[[key]].reset_index(drop=True), got], axis=1)

    return todo.select(key, text).mapInPandas(run, f"{key} {kind}, label string, confidence double, reason string, label_status string")


def label_run(df: DataFrame, key: str, text: str, labeler: Labeler, log: str, workers: int = 8) -> DataFrame:
    """Labels the rows whose key the log lacks and appends them to it; one row of progress figures.

    The log is JSON lines, one writer a task file, so a broken run resumes where it ended.
    Columns: n_done_before, n_labelled, n_ok, n_failed, seconds, rows_per_second.
    """
    spark = df.sparkSession
    shape = StructType.fromDDL(f"{key} {dict(df.dtypes)[key]}, label string, confidence double, reason string, label_status string")
    done = done_keys(spark, log, shape, [key])
    before = done.count()
    counts = [spark.sparkContext.accumulator(0) for _ in range(2)]
    began = time.time()

    def tally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ok = int((b["label_status"] == "ok").sum())
            counts[0].add(ok)
            counts[1].add(len(b) - ok)
            yield b

    append_json_lines(label_rows(df, key, text, labeler, done, workers).mapInPandas(tally, shape), log)
    took, (ok, failed) = time.time() - began, (c.value for c in counts)
    return spark.createDataFrame(
        [(before, ok + failed, ok, failed, took, (ok + failed) / max(took, 1e-9))],
        "n_done_before long, n_labelled long, n_ok long, n_failed long, seconds double, rows_per_second double")


class HttpLabeler(Labeler):
    """Posts each text to a chat-completion service and reads the JSON object in its reply.

    429 and 5xx answers, and broken connections, are worth another try (:func:`with_retry`
    pauses between them); any other status is the row's error.
    """

    PASSING = (429, 500, 502, 503, 504)

    def __init__(self, url: str, model: str, instruction: str, labels: tuple[str, ...], headers: dict[str, str] | None = None, timeout: float = 90.0) -> None:
        self.url, self.model, self.instruction, self.labels, self.timeout = url, model, instruction, labels, timeout
        self.headers = {"Content-Type": "application/json", **(headers or {})}

    def __call__(self, text: str) -> tuple[str, float, str]:
        body = {"model": self.model, "temperature": 0, "messages": [{"role": "system", "content": self.instruction}, {"role": "user", "content": text}]}
        request = urllib.request.Request(self.url, json.dumps(body).encode(), self.headers)
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as answer:
                content = json.loads(answer.read())["choices"][0]["message"]["content"]
        except urllib.error.HTTPError as e:
            raise (Retry if e.code in self.PASSING else ValueError)(f"http_{e.code}") from e
        except (urllib.error.URLError, TimeoutError, ConnectionError) as e:
            raise Retry(str(e)) from e
        found = re.search(r"(?s)\{.*\}", content)
        try:
            reply = json.loads(found.group(0)) if found else {}
        except ValueError:
            reply = {}
        return str(reply.get("label", content[:200])), float(reply.get("confidence", 0.0)), str(reply.get("reason", ""))


class Recogniser:
    """Finds names in a text: (start, end, label, score) each; a model plugs in here."""

    def __call__(self, text: str) -> list[tuple[int, int, str, float]]:
        raise NotImplementedError


class Gazetteer(Recogniser):
    """Listed names where their words stand in a row, with word edges on both sides.

    The text is cut into words once and walked down a tree of the names' words, so the cost
    does not grow with the number of names. All names found are given, also inside others.
    """

    WORD = r"[\p{L}\p{N}_]+"

    def __init__(self, names: list[tuple[str, str]]) -> None:
        word = regex.compile(self.WORD)
        self.tree: dict = {}
        for name, label in names:
            node = self.tree
            for w in word.findall(name):
                node = node.setdefault(w, {})
            if node is not self.tree:
                node.setdefault("", []).append(label)

    def __call__(self, text: str) -> list[tuple[int, int, str, float]]:
        at = [(m.group(), m.start(), m.end()) for m in regex.finditer(self.WORD, text)]
        out = []
        for i, (_, start, _) in enumerate(at):
            node = self.tree
            for w, _, end in at[i:]:
                node = node.get(w)
                if node is None:
                    break
                out += [(start, end, label, 1.0) for label in node.get("", ())]
        return out


def recognise(df: DataFrame, body: str, recogniser: Recogniser, keys: list[str], least: float = 0.45) -> DataFrame:
    """Keys and entity_surface, raw_label, raw_score, char_start, char_end of every mention scored ``least`` or more.

    Whole texts are read; null and empty texts have no mentions.
    """
    kinds = dict(df.dtypes)
    shape = ", ".join([*[f"{k} {kinds[k]}" for k in keys], "entity_surface string, raw_label string, raw_score double, char_start long, char_end long"])
    shipped = df.sparkSession.sparkContext.broadcast(recogniser)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        find = shipped.value
        for b in batches:
            rows = [(*ks, t[s:e], label, score, s, e) for t, *ks in zip(b[body], *[b[k] for k in keys]) for s, e, label, score in find(t) if score >= least]
            yield pd.DataFrame(rows, columns=[*keys, "entity_surface", "raw_label", "raw_score", "char_start", "char_end"])

    return spread(df.where(F.col(body).isNotNull()).select(*keys, body)).mapInPandas(scan, shape)


def gazetteer_mentions(df: DataFrame, body: str, names: DataFrame | dict[str, str], keys: list[str], part: int = NAMES) -> DataFrame:
    """Mentions of the names of a table (name, label), or of a dictionary.

    Names go to the tasks in parts of at most ``part``, each searched in a pass of its own,
    so the table may have any size.
    """
    if isinstance(names, dict):
        rows: Iterable = sorted(names.items())
    else:
        rows = ((r["name"], r["label"]) for r in names.where("name is not null").select("name", "label").distinct().orderBy("name", "label").toLocalIterator())
    passes, own = [], []
    for r in rows:
        own.append(r)
        if len(own) == part:
            passes.append(own)
            own = []
    passes += [own] if own or not passes else []
    return reduce(DataFrame.unionByName, [recognise(df, body, Gazetteer(p), keys) for p in passes])


def packed(df: DataFrame, body: str, edges: tuple[int, ...] = (80, 200, 400, 800, 1600)) -> DataFrame:
    """The rows with ``len_range``, sorted by length inside their partitions: texts of like length share a batch.

    No shuffle; a model that pads a batch to its longest text wastes little on such batches.
    """
    n = F.length(F.coalesce(F.col(body), F.lit("")))
    out = F.lit(len(edges))
    for i, e in reversed(list(enumerate(edges))):
        out = F.when(n <= e, i).otherwise(out)
    return df.withColumns({"len_range": out, "_n": n}).sortWithinPartitions("_n").drop("_n")


def as_bool(c: Column) -> Column:
    """A reply's truth value however it is written; null where it is none."""
    t = F.lower(F.trim(c.cast("string")))
    return F.when(t.isin(*TRUE_WORDS), True).when(t.isin(*FALSE_WORDS), False)


def parse_reply(df: DataFrame, reply: str, schema: StructType | str) -> DataFrame:
    """A JSON reply, whole or the first braces in it; what cannot be read gives null fields."""
    inner = F.regexp_extract(F.coalesce(F.col(reply), F.lit("")), r"(?s)\{.*\}", 0)
    return df.withColumn("parsed", F.from_json(F.nullif(inner, F.lit("")), schema))
