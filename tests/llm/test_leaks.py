import random

import numpy as np

from presswork.llm import leaks as K

WORDS = [f"w{c}{d}{e}" for c in "abcdefgh" for d in "ijklmnop" for e in "qrst"]


def passage(r, n):
    return [r.choice(WORDS) for _ in range(n)]


def corpus():
    r = random.Random(5)
    shared = passage(r, 60)
    items = [(i, "Read the passage and answer the question that follows.\n" + " ".join(passage(r, 120))) for i in range(30)]
    items += [(100, " ".join(shared + passage(r, 40))), (101, " ".join(shared + passage(r, 50))), (102, "too short"), (103, None), (None, "x y z " * 20)]
    text = dict((i, t.split() if t else []) for i, t in items if i is not None)
    noise = lambda n: " ".join(passage(r, n))
    odd = [w if k % 9 else "odd" for k, w in enumerate(text[3])]
    docs = [
        (1, noise(300)), (2, noise(50) + " " + " ".join(text[0][:60]).upper().replace(" ", ", ") + " " + noise(80)),
        (3, noise(40) + " <b>" + "</b> <i>".join(text[1][9:80]) + "</i> " + noise(20)),
        (4, " ".join(text[2][9:36]) + " " + noise(200) + " " + " ".join(text[2][60:90])),
        (5, noise(30) + " " + " ".join(odd)), (6, "Read the passage and answer the question that follows. " + noise(100)),
        (7, noise(100) + " " + " ".join(text[4][20:40]) + " " + noise(10)), (8, noise(20) + " " + " ".join(shared) + " " + noise(20)),
        (9, None), (10, ""), (11, " ".join(text[5]) + " " + noise(200_000)), (12, " ".join(text[0])), (12, " ".join(text[0]))]
    return docs, items


def test_finds_what_is_there_and_nothing_else(spark):
    docs, items = corpus()
    d = spark.createDataFrame([(a, b, 0, "z") for a, b in docs], "doc_id long, text string, item_id long, share string")
    i = spark.createDataFrame([(a, b, 1) for a, b in items], "item_id long, text string, doc_id long")
    got = {(r["doc_id"], r["item_id"]) for r in K.find_leaks(d, i).collect()}
    assert got == {(2, 0), (3, 1), (4, 2), (5, 3), (8, 100), (8, 101), (11, 5), (12, 0)}


def test_search_equals_brute_force():
    r = random.Random(2)
    pats = [tuple(passage(r, K.WINDOW)) for _ in range(200)]
    wm = K.WuManber(pats)
    seq = [r.choice(WORDS[:40]) for _ in range(3000)]
    for p in pats[:50]:
        k = r.randrange(2900)
        seq[k:k + K.WINDOW] = p
    at, which = wm.search(np.array([wm.number.get(w, 0) for w in seq], dtype=np.int64))
    got = sorted(zip(at.tolist(), (pats[k] for k in which)))
    want = sorted((k, p) for k in range(len(seq) - K.WINDOW + 1) for p in set(pats) if tuple(seq[k:k + K.WINDOW]) == p)
    assert sorted(set(got)) == want


def brute(docs, items):
    """Every item compared with every document over all windows."""
    want = set()
    for d, t in docs:
        seq = K.words(t)
        for i, text in items:
            w = K.words(text)
            hits = [(p, k) for p in range(len(seq) - K.WINDOW + 1) for k in range(len(w) - K.WINDOW + 1) if seq[p:p + K.WINDOW] == w[k:k + K.WINDOW]]
            if len(w) >= K.WINDOW and hits and K.best_passages(K.passages(hits, min(K.MIN_PASSAGE, len(w)))) >= K.SHARE * len(w) - 1e-9:
                want.add((d, i))
    return want


def fast(docs, items):
    ix = K.Index(items)
    return {(d, i) for (d, _), hits in zip(docs, ix.leaked([t for _, t in docs])) for i, _ in hits}


def test_candidates_equal_all_windows():
    docs, items = corpus()
    items = [(i, t) for i, t in items if i is not None and t]
    assert fast(docs[:10], items) == brute(docs[:10], items)


def test_equals_brute_force_on_texts_of_few_words():
    for seed in range(12):
        r = random.Random(seed)
        few = [f"w{c}" for c in "abcdefgh"[:3 + seed % 5]]
        base = [passage(r, r.choice((5, 12, 20, 40))) for _ in range(4)]
        items, docs = [], []
        for i in range(30):
            w = [x for b in r.sample(base, r.randint(1, 3)) for x in b] + [r.choice(few) for _ in range(r.randint(0, 12))]
            items.append((i, " ".join(x if r.random() > 0.06 else "odd" for x in w)))
        for d in range(25):
            w = []
            for _ in range(r.randint(1, 4)):
                src = items[r.randrange(30)][1].split()
                a = r.randrange(len(src) + 1)
                w += src[a:a + r.randint(3, 30)] + [r.choice(few + WORDS) for _ in range(r.randint(0, 9))]
            docs.append((d, " ".join(w)))
        assert fast(docs, items) == brute(docs, items)


def test_short_items_and_short_passages():
    r = random.Random(1)
    ten, sixty = passage(r, 10), passage(r, 60)
    # 24 of 60 words in two passages of three windows each
    two = sixty[:4] + ["odd"] + sixty[4:8] + ["odd"] + sixty[8:12] + passage(r, 30) + sixty[40:44] + ["odd"] + sixty[44:48] + ["odd"] + sixty[48:52]
    docs = [(1, " ".join(ten)), (2, " ".join(two)), (3, " ".join(ten[:8])), (4, " ".join(two[:14]))]
    items = [(10, " ".join(ten)), (60, " ".join(sixty)), (3, "one two three")]
    assert fast(docs, items) == {(1, 10), (2, 60)}


def test_variants_of_a_widely_shared_passage():
    r = random.Random(3)
    base = passage(r, 96)
    items = [(i, " ".join(w if k % 12 != i % 12 else f"odd{i}" for k, w in enumerate(base))) for i in range(8)]
    assert fast([(1, " ".join(base))], items) == {(1, i) for i in range(8)}


def test_the_same_passage_twice_counts_once():
    r = random.Random(4)
    w = passage(r, 90)
    twice = w[:20] + passage(r, 40) + w[:20]
    assert fast([(1, " ".join(twice)), (2, " ".join(w[:20] + passage(r, 40) + w[40:52]))], [(5, " ".join(w))]) == {(2, 5)}


def test_many_words_have_numbers_of_their_own():
    pats = [(f"a{i}", f"b{i}", f"c{i}", f"d{i}") for i in range(40_000)]
    wm = K.WuManber(pats)
    seq = [x for i in (0, 17, 39_999) for x in pats[i]] + [*pats[5][:3], pats[6][3]]
    at, which = wm.search(np.array([wm.number[w] for w in seq]))
    assert dict(zip(at.tolist(), (pats[k] for k in which))) == {0: pats[0], 4: pats[17], 8: pats[39_999]}


def test_markup_of_any_length():
    w = "alpha beta gamma delta".split()
    assert K.words(f'alpha <a href="{"x" * 4000} y">beta</a> [gamma]({"u" * 3000}) a < b <br/>delta') == [*w[:3], "a", "b", "delta"]
    assert len(K.words("<a " * 100_000)) == 100_000 and len(K.words("[a](b" * 50_000)) == 100_000


def test_repetition_is_no_trap():
    zeros = " ".join(["0"] * 3000)
    assert fast([(1, zeros), (2, "0 0 0 0")], [(1, " ".join(["0"] * 120))]) == {(1, 1)}


def test_items_in_several_passes(spark):
    docs, items = corpus()
    d = spark.createDataFrame([(a, b) for a, b in docs if a != 11], "doc_id long, text string")
    i = spark.createDataFrame([(a, b) for a, b in items], "item_id long, text string")
    one, many = (sorted(K.find_leaks(d, i, max_words=m).select("doc_id", "item_id").distinct().collect()) for m in (K.MAX_WORDS, 500))
    assert one == many and len(one) == 7


def test_empty(spark):
    d = spark.createDataFrame([(1, "some text of a document")], "doc_id long, text string")
    i = spark.createDataFrame([], "item_id long, text string")
    assert K.find_leaks(d, i).count() == 0 and K.find_leaks(d.limit(0), i).count() == 0
