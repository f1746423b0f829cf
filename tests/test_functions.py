import math

import pytest
from pyspark.sql import functions as F

from presswork.functions import entity, text, web
from presswork.operators import segment
from presswork.operators.sentiment import hard_mode


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(column(F.col("c")).alias("r")).first()["r"]


@pytest.mark.parametrize("url, want", [
    ("https://WWW.Site.com:80/x", "site.com:80"), ("site.com/x", "NA"), (None, "NA"), ("", "NA"), ("http://u@a.b/c", "u@a.b"), ("https:///x", "NA")])
def test_domain(spark, url, want):
    assert one(spark, web.domain, url) == want


@pytest.mark.parametrize("date, want", [
    ("2023-05-02", "2023Q2"), ("2023", "NA"), ("2023-xx", "NA"), ("2023-13-01", "2023Q5"), (None, "NA"), ("2023-00-01", "2023Q0")])
def test_quarter_bucket(spark, date, want):
    assert one(spark, web.quarter_bucket, date) == want


def test_month_of_no_time_is_a_text(spark):
    assert one(spark, lambda c: web.month(web.day(c)), "soon") == "NaT"


@pytest.mark.parametrize("name, want", [
    ("open ai", "OpenAI"), ("NASA", "NASA"), ("the white house", "White House"), ("  OpenAI's ", "OpenAI"), ("ai model", "Ai Model"), (None, ""),
    ("JamesBond", "James Bond"), ("IBM’s", "IBM")])
def test_canonical_name(spark, name, want):
    assert one(spark, entity.canonical_name, name) == want


@pytest.mark.parametrize("name, want", [("$5,000", True), ("A", True), ("OpenAI", False), ("", True), ("No. 7", True), ("Booth 12A", True), ("3M", True)])
def test_numeric_junk(spark, name, want):
    assert one(spark, entity.numeric_junk, name) is want


@pytest.mark.parametrize("n, want", [(300, "head"), (299, "mid"), (80, "mid"), (79, "tail"), (20, "tail"), (19, "below_tail"), (None, "below_tail")])
def test_tier(spark, n, want):
    assert one(spark, entity.tier, n, "long") == want


@pytest.mark.parametrize("n, want", [(39, "short"), (40, "medium"), (119, "medium"), (120, "long")])
def test_length_bucket(spark, n, want):
    assert one(spark, text.length_bucket, n, "int") == want


@pytest.mark.parametrize("t, want", [
    ("x" * 24, 1), ("The committee met on Monday and agreed on a plan.", 0), ("Please subscribe to read more about this today.", 1),
    ("Follow the company on facebook for news of the day.", 1), ("Read it at https://a.b/c before the meeting starts.", 1),
    ("--------------------------------", 1), (None, 1)])
def test_suspect(spark, t, want):
    assert one(spark, text.suspect, t) == want


def test_compact_is_longer_by_its_mark_only(spark):
    assert one(spark, lambda c: text.compact(c, 5), "abcde") == "abcde"
    assert one(spark, lambda c: text.compact(c, 5), "abcd  f g") == "abcd ..."


def test_blocks(spark):
    b = lambda t: one(spark, segment.blocks_array, t)
    line = "This is a line with more than thirty characters."
    assert b(None) == [] and b("   \n ") == []
    assert b(f"{line}\r\n{line} two") == [line, f"{line} two"]  # two blocks or fewer: every line end splits
    assert len(b("\n\n".join([line] * 401))) == 400
    assert b("\n\n".join([line, "x" * 29, line + " b", line + "\nsame block"])) == [line, line + " b", line + " same block"]


def test_sentences_keep_their_gaps(spark):
    t = "A first sentence that is long. Short. " + "b" * 900 + ". The last sentence is here."
    s = segment.sentences(spark.createDataFrame([("1:0", t)], "block_uid string, block_text string")).orderBy("sent_id").collect()
    assert [r["sent_id"] for r in s] == [0, 2, 3] and s[1]["sent_len"] == 800 and s[2]["sent_uid"] == "1:0:3"


def test_ordered_concat_ignores_input_order(spark):
    df = spark.createDataFrame([(1, 2, "c"), (1, 0, " a "), (1, 1, "  "), (None, 0, "n"), (None, 1, None)], "k int, o int, t string")
    assert {r["k"]: r["joined"] for r in segment.ordered_concat(df, ["k"], ["o"], "t", " ").collect()} == {1: "a c", None: "n"}


def test_hard_mode_ties_go_to_the_first(spark):
    df = spark.createDataFrame([(2, 2, 2), (1, 2, 2), (0, 0, 1)], "negative int, mixed_or_unclear int, positive int")
    m = hard_mode({c: F.col(c) for c in df.columns})
    assert [r[0] for r in df.select(m).collect()] == ["negative", "mixed_or_unclear", "positive"]


def test_impact_score_by_hand():
    assert abs((0.6 - 0.2) * (1 - 0.2) * math.log(10) - 0.736827) < 1e-6
