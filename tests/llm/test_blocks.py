import numpy as np

from presswork.llm import blocks as B

NEWS = "doc_id long, url string, title string, text string, site string, line_no long"
SENT = "doc_id long, block_id long, sent_id long, sent_uid string, title string, domain string, sentence_text string, body string"
PAGE = """Home  Business  Sport  Culture  Tech

By Amara Tokfotdon, Tilsorrim Ledger staff
Eastmere bets on computer vision for its degree programme
In December, parents and the exam board disagreed over who supervised the seminar room. In February, neither the scholarship fund nor the reading list was examined on time.
Share this story on your favourite network
• Doubts about the reading list
Tasfembor Robotics trained machine learning on an old campus library from Eastmere, and more may follow.
Our free newsletter reaches 327 readers every day. Join them.
Despite the delay, a new homework portal let first-year students drop a chatbot for good.
© 2024 Tilsorrim Ledger. All rights reserved.
Also read: Lisdulnet Foods and the settlement draft that changed Lower Ashby"""
TITLE = "Eastmere bets on computer vision for its degree programme"


def test_lines_outside_the_body(spark):
    df = spark.createDataFrame([
        (1, "https://www.tilsorrim-ledger.example/x", TITLE, PAGE, "s", 1), (2, None, None, PAGE, "s", 1), (3, "u", None, None, "s", 1), (4, "u", None, "", "s", 1),
        (5, None, None, "\n \n​\n", None, None), (None, None, None, PAGE, None, None)], NEWS)
    got = {}
    for r in B.page_furniture(df).collect():
        got.setdefault(r["doc_id"], set()).add(r["line_no"])
    assert got[1] == {0, 2, 5, 8, 10, 11}
    assert set(got) == {1, 2} and {0, 5, 8, 10, 11} <= got[2]
    body = {r["doc_id"]: r for r in B.main_bodies(df.where("doc_id is not null")).collect()}
    assert body[1]["body"].count("\n") == 4 and body[1]["n_removed"] == 6 and body[3]["body"] == ""


def test_sentences_are_judged_by_block(spark):
    rows = []
    for d in range(1, 40):
        for b, line in enumerate(x for x in PAGE.split("\n") if x):
            for s, t in enumerate(line.split(". ") if len(line) > 90 else [line]):
                rows.append((d, b, s, f"{d}:{b}:{s}", TITLE, "tilsorrim-ledger.example", t, None))
    rows += [rows[0], (None, 1, 1, "n", None, None, "text", None), (50, 0, 0, "50:0:0", None, None, None, None), (51, 0, 0, "51:0:0", None, "NA", "Share | Print | Email", None)]
    got = {r["sent_uid"] for r in B.sentence_furniture(spark.createDataFrame(rows, SENT)).collect()}
    for d in range(1, 40):
        blocks = {int(u.split(":")[1]) for u in got if u.startswith(f"{d}:")}
        assert blocks == {0, 1, 4, 7, 9, 10}
    assert "51:0:0" in got and "n" not in got


def test_held_out_accuracy():
    pages = B.labelled_pages()
    held = pages[::5]
    c = B.Classifier([p for i, p in enumerate(pages) if i % 5])
    flags = c.furniture([(p[2], p[0] or None, p[1] or None) for p in held])
    y = np.concatenate([np.array(p[3]) for p in held])
    f = np.concatenate(flags).astype(int)
    assert (y == f).mean() > 0.97


def test_accuracy_on_sites_never_seen():
    pages = B.labelled_pages()
    sites = sorted({p[1] for p in pages})
    for words, least in ((True, 0.97), (False, 0.95)):
        right = total = 0
        for fold in range(5):
            out = set(sites[fold::5])
            c = B.Classifier([p for p in pages if p[1] not in out], words)
            held = [p for p in pages if p[1] in out]
            assert words or not c.odds.of
            y = np.concatenate([np.array(p[3]) for p in held])
            f = np.concatenate(c.furniture([(p[2], p[0] or None, p[1] or None) for p in held])).astype(int)
            right, total = right + (y == f).sum(), total + len(y)
        print("held out by site", words, right / total)
        assert right / total > least


def test_tree_splits_what_can_be_split():
    x = np.array([[0, 1], [0, 2], [1, 1], [1, 2]] * 5, dtype=float)
    y = (x[:, 0] > 0) & (x[:, 1] > 1)
    t = B.Tree(leaf=1).fit(x, y)
    assert (t.predict(x) == y).all()


def test_remembering_lines_changes_nothing():
    c = B.classifier()
    lines = [x for x in PAGE.split("\n") if x.strip()]
    a = B.page_features(lines, TITLE, None, c.odds)
    c.odds.lines.clear()
    assert (a == B.page_features(lines, TITLE, None, c.odds)).all()


def test_empty(spark):
    e = spark.createDataFrame([], NEWS)
    assert B.page_furniture(e).count() == 0 and B.found(e, spark.createDataFrame([], SENT)).count() == 0


def test_a_very_long_page_and_repeated_rows(spark):
    long = "\n".join(["Tasfembor Robotics trained machine learning on an old campus library from Eastmere, and more may follow."] * 20_000 + ["© 2024 Paper. All rights reserved."])
    df = spark.createDataFrame([(1, None, None, long, None, None)] * 2, NEWS)
    got = B.page_furniture(df).collect()
    assert {(r["doc_id"], r["line_no"]) for r in got} == {(1, 20_000)} and len(got) == 2
