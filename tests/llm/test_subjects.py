import random

import numpy as np

from presswork.llm import subjects as T

D = "doc_id long, text string, lang string, subject string, terms string"
WORDS = {
    "law": "court judge lawsuit contract verdict attorney appeal statute deposition plaintiff subpoena injunction".split(),
    "sport": "match league coach goalkeeper stadium season penalty referee marathon transfer championship team".split(),
    "energy": "power grid solar wind battery emission pipeline turbine electricity carbon reactor dam".split(),
}
GLUE = "the of and to in a was that for on with as by it from".split()


def sentence(r, subject):
    return " ".join(x for _ in range(9) for x in (r.choice(GLUE), r.choice(WORDS[subject]))).capitalize() + "."


def corpus(n=240):
    r = random.Random(7)
    docs, truth = [], {}
    for i in range(n):
        own = r.sample(sorted(WORDS), 1 + (i % 3 == 0))
        lines = [sentence(r, own[k % len(own)]) for k in range(6)]
        docs.append((i, "Home | Sport | Weather\n" + "\n".join(lines), None, "x", "y"))
        truth[i] = set(own)
    docs += [(1000, None, "en", None, None), (1001, "", "en", None, None), (1002, "Loading", "en", None, None), (1003, "Court.", "en", None, None)]
    return docs, truth


def run(spark, docs, labels):
    return T.document_subjects(
        spark.createDataFrame(docs, D), spark.createDataFrame([(1, " Law", "court and lawsuit"), (2, "sport", "league and stadium"), (3, "energy", "power"), (4, None, "x")], "subject_id long, subject string, gloss string"),
        spark.createDataFrame(labels, "doc_id long, subject string, annotator string, labelled_at string"))


def test_accuracy_on_documents_without_labels(spark):
    docs, truth = corpus()
    labels = [(i, " LAW " if next(iter(truth[i])) == "law" else next(iter(truth[i])), "a", "t") for i in range(1, 25) if len(truth[i]) == 1]
    labels += [labels[0], (5, "cooking", "a", "t"), (99999, "law", "a", "t"), (None, "law", "a", "t"), (6, None, "a", "t")]
    got = {}
    for d, s, share in run(spark, docs, labels).collect():
        assert 1 / 3 - 1e-6 <= share <= 1
        got.setdefault(d, set()).add(s)
    held = [i for i in truth if i >= 25]
    assert np.mean([got.get(i) == truth[i] for i in held]) > 0.95
    assert not {1000, 1001, 1002, 1003} & set(got)


def test_without_labels_or_subjects_or_documents(spark):
    docs, truth = corpus(90)
    got = {}
    for d, s, _ in run(spark, docs, [(None, None, None, None)]).collect():
        got.setdefault(d, set()).add(s)
    assert np.mean([got.get(i) == truth[i] for i in truth]) > 0.9
    none = spark.createDataFrame([], "subject_id long, subject string, gloss string")
    lab = spark.createDataFrame([], "doc_id long, subject string")
    assert T.document_subjects(spark.createDataFrame(docs, D), none, lab).count() == 0
    one = spark.createDataFrame([(1, "law", "court")], "subject_id long, subject string, gloss string")
    assert T.document_subjects(spark.createDataFrame(docs, D), one, lab).count() > 0
    assert T.document_subjects(spark.createDataFrame([], D), one, lab).count() == 0


def test_subspace_matches_a_full_decomposition(spark):
    docs, _ = corpus(150)
    tokens = T.cut(T.tokenised(spark.createDataFrame(docs, D)))
    space = T.fit_space(tokens)
    b = tokens.toPandas()
    row, col, val, _, n = T._units(b, 0, space.weight[0], False)
    a = np.zeros((len(n), len(space.terms[0])))
    a[row, space.place[0][col]] = val
    s = np.linalg.svd(a, compute_uv=False)
    kept = np.linalg.norm(a @ space.q[0]) ** 2
    assert kept > 0.97 * (s[:space.q[0].shape[1]] ** 2).sum()


def test_long_documents_repeated_texts_and_ties(spark):
    r = random.Random(3)
    docs, truth = corpus(90)
    docs.append((2000, "\n".join(sentence(r, "energy") for _ in range(5000)), "xx", None, None))
    tie = "\n".join(sentence(r, s) for s in ("law", "sport", "energy"))  # a third each: all three count
    docs += [(2001, tie, None, None, None), (2002, tie, None, None, None)]
    got = {}
    for d, s, _ in run(spark, docs, [(1, "law", "a", "t")]).collect():
        got.setdefault(d, set()).add(s)
    assert got[2000] == {"energy"} and got[2001] == got[2002] == {"law", "sport", "energy"}


def test_texts_without_paragraphs_and_without_a_language(spark):
    r = random.Random(5)
    docs, truth = corpus(120)
    listing = "\n".join("- " + " ".join(r.choice(WORDS["law"]) for _ in range(4)) for _ in range(12))  # no line is a sentence
    table = "\n".join(f"{a} | {b} | {i}" for i, (a, b) in enumerate(zip(WORDS["sport"] * 3, WORDS["sport"][::-1] * 3)))
    docs += [(3000, listing, "en", None, None), (3001, table, "en", None, None), (3002, "Court judge\nappeal", "en", None, None)]
    # a fifth language: its own words only, no frequent words of the four
    own = {s: ["q" + "".join(r.choice("bdgkvz") + r.choice("ou") for _ in range(3)) for _ in range(12)] for s in ("law", "sport")}
    for i in range(60):
        s = ("law", "sport")[i % 2]
        docs.append((4000 + i, "\n".join(" ".join(r.choice(own[s]) for _ in range(12)).capitalize() + "." for _ in range(4)), "xx", None, None))
    got = {}
    for d, s, _ in run(spark, docs, [(4000 + i, ("law", "sport")[i % 2], "a", "t") for i in range(12)]).collect():
        got.setdefault(d, set()).add(s)
    assert got[3000] == {"law"} and got[3001] == {"sport"} and 3002 not in got
    assert np.mean([got.get(4000 + i) == {("law", "sport")[i % 2]} for i in range(12, 60)]) > 0.9


def test_language():
    assert T.LANGS[T.language([9, 0, 0, 1], 30, "de")] == "en"
    assert T.LANGS[T.language([1, 0, 0, 0], 30, "de-XX")] == "de"
    assert T.LANGS[T.language([0, 0, 0, 0], 30, "it")] == T.LANGS[T.language([0, 0, 0, 0], 0, None)] == "other"


def test_sums_by_levels(spark, monkeypatch):
    import pandas as pd

    def parts(batches):
        for b in batches:
            for i in b["id"]:
                yield pd.DataFrame({"lang": [np.int32(i % 2)], "block": [np.int32(0)], "part": [np.full(3, i, dtype=np.float32).tobytes()]})

    df = spark.range(0, 40, 1, 20).mapInPandas(parts, "lang int, block int, part binary")
    monkeypatch.setattr(T, "FAN", 2)
    got = T._sum_blocks(df, 20)
    assert {k: v[0] for k, v in got.items()} == {(0, 0): sum(range(0, 40, 2)), (1, 0): sum(range(1, 40, 2))}
