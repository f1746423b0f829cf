from presswork.llm import lines as L
from pyspark.sql import functions as F

from presswork.session import cut

S = "doc_id long, url string, text string, site string, _gone string, word long"


def news(spark, extra=()):
    rows = [(i, f"https://www.A.example/{i}", f"Body text number {'abcdefghij'[i % 10]}{i // 10}\nShare  this STORY {i} times\n\nend {'x' * i}", "q", "q", 1) for i in range(40)]
    rows += [(100 + i, "http://b.example/x", f"Only here {'abcdef'[i]}\nTwice\nTwice", None, None, None) for i in range(6)]
    return spark.createDataFrame([*rows, *extra], S)


def brute(rows, min_docs=5, share=0.05):
    import re
    from collections import defaultdict

    site = lambda u: (re.sub(r"^www\.", "", m.group(1).lower()) if (m := re.match(r"(?i)https?://([^/?#:]+)", (u or "").strip())) else None)
    key = lambda x: re.sub("[0-9]+", "0", " ".join(re.sub("[​­﻿]", "", x).split()).lower())
    n, docs = defaultdict(int), defaultdict(set)
    for d, u, t, *_ in rows:
        if s := site(u):
            n[s] += 1
            for x in (t or "").split("\n"):
                if key(x):
                    docs[s, key(x)].add(d)
    return sorted((d, i) for d, u, t, *_ in rows if (s := site(u)) for i, x in enumerate((t or "").split("\n"))
                  if key(x) and len(docs[s, key(x)]) >= max(min_docs, share * n[s]))


def test_against_brute_force_with_dirt(spark, rows):
    extra = [(200, None, "share this story 1 times", None, None, None), (201, "https://a.example", None, None, None, None),
             (202, "https://a.example/", "", None, None, None), (203, "ftp://a.example/", "Twice", None, None, None),
             (204, "HTTPS://WWW.a.EXAMPLE:80/", "share​ this story 77 TIMES\n" + "long " * 50_000, None, None, None)]
    df = news(spark, extra)
    want = brute([tuple(r) for r in df.collect()])
    assert rows(L.boilerplate_lines(df)) == sorted(want, key=repr) and len(want) > 40


def test_clean_texts_takes_out_only_repeated_lines(spark):
    got = {r["doc_id"]: r for r in L.clean_texts(news(spark, [(300, None, None, None, None, None)])).collect()}
    assert "STORY" not in got[3]["text"] and got[3]["text"].startswith("Body text") and got[3]["n_removed"] == 1
    assert got[100]["text"] == "Only here a" and got[100]["n_removed"] == 2
    assert got[300]["text"] is None and got[300]["n_removed"] == 0 and len(got) == 47


def test_variants_share_one_bitmap(spark):
    m = L.line_bitmaps(L.lines_of(news(spark))).where("n_variants > 1")
    assert m.count() > 0


def test_threshold_is_inclusive(spark):
    five = spark.createDataFrame([(i, "https://c.example", "Same line", None, None, 0) for i in range(5)], S)
    assert L.boilerplate_lines(five).count() == 5
    assert L.boilerplate_lines(five.where("doc_id < 4")).count() == 0


def test_empty(spark):
    e = spark.createDataFrame([], S)
    assert L.boilerplate_lines(e).count() == 0 and L.clean_texts(e).count() == 0


def test_words_fill_where_a_site_has_many_documents(spark):
    rows = [(i, f"http://{'ab'[i % 2]}.org/{i}", "Share this page\n" + f"text {chr(97 + i % 26)} of {i}") for i in range(2000)]
    d = spark.createDataFrame(rows, "doc_id long, url string, text string").repartition(4)
    maps = L.line_bitmaps(cut(L.lines_of(d), "lines"))
    hot = maps.groupBy("site", "k1").agg(F.sum(F.bit_count("bits")).alias("docs"), F.count("word").alias("words")).where("docs = 1000").collect()
    assert len(hot) == 2 and all(r["words"] <= 60 for r in hot)
