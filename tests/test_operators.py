import random
from collections import Counter, defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from presswork.operators import metrics, profile, sampling, skew, tables
from presswork.operators.sentiment import rolling_mean

CTX = ("canonical_entity string, final_type string, domain string, title string, date string, clean_block_text string, confidence double, "
       "doc_id long, block_id long, url string, clean_block_len long, _n long, key_field string, _salt int")


def contexts(spark, n=4000, seed=1):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        e = "Hot" if r.random() < 0.4 else None if r.random() < 0.03 else f"e{r.randrange(300)}"
        rows.append((e, "t", r.choice(["a", "a", "b", None]), None, None, f"text {r.randrange(50)}", r.choice([None, 0.5, 0.9]), r.choice([None, *range(300)]), r.randrange(3), None, r.choice([None, 5, 9]), 1, "q", 0))
    return spark.createDataFrame([*rows, *rows[:50]], CTX)


def test_salted_results_equal_plain_ones(spark):
    df = contexts(spark)
    want = {}
    rows = df.collect()
    for field in ("canonical_entity", "domain"):
        g = defaultdict(list)
        for r in rows:
            g[r[field]].append(r)
        for k, v in g.items():
            low = lambda x: (x is not None, x if x is not None else 0)
            neg = lambda x: (x is not None, -x if x is not None else 0)
            best = max(v, key=lambda r: (low(r["confidence"]), low(r["clean_block_len"]), neg(r["doc_id"]), neg(r["block_id"]), r["clean_block_text"]))
            want[field, k] = (len(v), len({r["doc_id"] for r in v if r["doc_id"] is not None}), best["confidence"], best["doc_id"], best["block_id"], best["clean_block_text"])
    got = {(r["key_field"], r["key_value"]): tuple(r)[2:] for r in skew.key_results(df).collect()}
    assert got == want
    n = df.count()
    assert {tuple(r) for r in skew.dominant_keys(skew.key_results(df)).collect()} == {k for k, v in want.items() if k[1] is not None and v[0] >= 0.03 * n}


def test_salted_results_of_nothing(spark):
    e = spark.createDataFrame([], CTX)
    assert skew.key_results(e).count() == 0 and skew.dominant_keys(skew.key_results(e)).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 1000), min_size=1, max_size=12), st.integers(1, 400))
def test_allocations_add_up(sizes, total):
    w = [s / sum(sizes) for s in sizes]
    a = sampling.largest_remainder(w, total)
    assert min(a) >= 1 and sum(a) == max(total, len(w)) and a == sampling.largest_remainder(w, total)
    c = sampling.nearest_fraction(w, total)
    assert min(c) >= 1 and sum(c) == max(total, len(w))
    b = sampling.rounded_with_floor(w, total, 2)
    assert min(b) >= 2 and sum(b) >= total


def test_dense_ids(spark):
    df = spark.createDataFrame([(x, "p") for x in random.Random(3).sample(range(10_000), 500)], "k long, _p string")
    got = tables.dense_ids(df.select("k"), ["k"]).orderBy("k").collect()
    assert [r["row_id"] for r in got] == list(range(500))
    assert tables.dense_ids(df.select("k").limit(0), ["k"]).count() == 0


def test_null_keys_meet_only_where_asked(spark):
    a = spark.createDataFrame([(None, 1), ("x", 2)], "k string, a int")
    b = spark.createDataFrame([(None, 3), ("x", 4)], "k string, b int")
    assert tables.null_safe_join(a, b, ["k"]).count() == 2
    assert tables.left_default(a, b, ["k"], {"b": 0}).where("k is null").first()["b"] == 0


def test_last_row_wins(spark):
    log = spark.createDataFrame([("a", 1, "x"), ("a", 3, "z"), ("a", None, "n"), ("b", 1, "q")], "k string, seq int, v string")
    assert {r["k"]: r["v"] for r in tables.compact_log(log, ["k"], ["seq"]).collect()} == {"a": "z", "b": "q"}


def test_columns(spark):
    df = spark.range(2)
    assert tables.ensure_column(df, "x", "d", "string").first()["x"] == "d"
    assert tables.select_present(df, ["id", "nope"]).columns == ["id"]
    assert tables.first_present(df, ["nope", "id"]) == "id"
    for f in (lambda: tables.require_columns(df, ["nope"]), lambda: tables.first_present(df, ["nope"])):
        try:
            f()
            raise AssertionError
        except ValueError:
            pass


def test_rolling_mean(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 2.0), (6, 6.0), (7, 7.0)], "o int, v double")
    assert [r["v_smoothed"] for r in rolling_mean(df, [], "o", "v").orderBy("o").collect()] == [1.0, 1.5, 3.0, 5.0]


def test_threshold_audit_by_brute_force(spark):
    r = random.Random(2)
    rows = [(r.randrange(2), round(r.random(), 3)) for _ in range(400)]
    got = metrics.threshold_audit(spark.createDataFrame(rows, "y int, p double"), "y", "p", 0.2, 0.9, 0.05).collect()
    assert len(got) == 15
    for x in got:
        c = Counter((y, p >= x["threshold"]) for y, p in rows)
        assert (x["tp"], x["fp"], x["fn"], x["tn"]) == (c[1, True], c[0, True], c[1, False], c[0, False])
    best = metrics.best_threshold(spark.createDataFrame([(0.2, 0.5), (0.4, 0.7), (0.6, 0.7)], "threshold double, f1 double")).first()
    assert best["threshold"] == 0.4


def test_profiles_of_nothing(spark):
    e = spark.createDataFrame([], "a string, n int")
    assert [tuple(r) for r in profile.null_profile(e, ["a"]).collect()] == [("a", 0, 0.0)]
    assert profile.duplicate_profile(e, "a").first()["n_rows"] == 0
    assert profile.histogram(e, "n", 5).count() == 0
    same = spark.createDataFrame([(3,), (3,)], "n int")
    assert [tuple(r) for r in profile.histogram(same, "n", 5).collect()] == [(0, 2)]


def test_samples_repeat_and_keep_their_sizes(spark):
    df = spark.range(500).select(F.col("id").cast("string").alias("k"), (F.col("id") % 7).cast("string").alias("s"), (F.col("id") % 50).alias("e"))
    t = sampling.allocation(df, ["s"], 70)
    a = sampling.stratified_sample(df, ["s"], "k", t)
    assert a.count() == 70 and sorted(map(tuple, a.collect())) == sorted(map(tuple, sampling.stratified_sample(df, ["s"], "k", t).collect()))
    c = sampling.capped_sample(df, ["e"], "k", 2, 60)
    assert c.count() == 60 and c.groupBy("e").count().agg(F.max("count")).first()[0] <= 2


def test_group_split_leaks_nothing(spark):
    df = spark.range(900).select((F.col("id") % 90).cast("string").alias("g"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("l"))
    s = sampling.group_split(df, "g", "l", 0.18)
    assert s.count() == 90 and s.groupBy("g").agg(F.count_distinct("split").alias("n")).where("n > 1").count() == 0
    assert 10 <= s.where("split = 'valid'").count() <= 22


def test_ranks_and_two_step_samples_equal_plain_windows(spark):
    from pyspark.sql import Window

    df = spark.range(2000).select(F.col("id").cast("string").alias("k"), F.when(F.col("id") % 10 < 7, "hot").when(F.col("id") % 10 < 9, None).otherwise("c").alias("s"))
    w = Window.partitionBy("s").orderBy(sampling.draw_key("k"), "k")
    want = {r["k"]: r["n"] for r in df.withColumn("n", F.row_number().over(w)).collect()}
    assert {r["k"]: r["n"] for r in sampling.ranked(df, ["s"], [sampling.draw_key("k"), F.col("k")], "n").collect()} == want
    t = spark.createDataFrame([("hot", 33), ("c", 500)], "s string, target long")
    got = {r["k"] for r in sampling.stratified_sample(df, ["s"], "k", t).collect()}
    assert got == {r["k"] for r in df.where("s is not null").collect() if want[r["k"]] <= (33 if r["s"] == "hot" else 500)}


def test_group_split_tops_up_whole_groups(spark):
    df = spark.range(600).select(
        (F.col("id") % 60).cast("string").alias("g"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("l"), F.lit("t").alias("k"), F.col("id").alias("d"))
    s = sampling.group_split(df, "g", "l", 0.1, kind="k", docs="d", least_rows=200)
    assert s.where("split = 'valid'").agg(F.sum("n_rows")).first()[0] == 200
    assert sampling.group_split(df, "g", "l", 0.1, kind="k", docs="d").where("split = 'valid'").count() == 6
    assert sampling.group_split(df, "g", "l", 0.1, least_rows=10**6).where("split = 'train'").count() == 0
    assert sampling.group_split(df.limit(0), "g", "l", 0.1, least_rows=5).count() == 0


def test_allocation_rules():
    assert sampling.first_gives([0.98, 0.01, 0.01], 10) == [8, 1, 1] == sampling.nearest_fraction([0.98, 0.01, 0.01], 10)
    assert sampling.first_gives([0.5, 0.5], 1) == [1, 1] and sampling.first_gives([], 5) == []
    assert sum(sampling.first_gives([0.3, 0.3, 0.4], 101)) == 101


def test_typed_pools_keep_to_their_kind(spark):
    df = spark.range(400).select(
        F.col("id").cast("string").alias("k"), (F.col("id") % 50).alias("e"), F.when(F.col("id") % 4 == 0, "p").otherwise("c").alias("t"), F.lit("head").alias("tier"))
    got = sampling.typed_pools(df, "t", {"p": 30, "c": 40}, "tier", ["e"], "k", {"head": 1.0}, {"head": {"p": 2, "c": 2}})
    assert {r["t"]: r["count"] for r in got.groupBy("t").count().collect()} == {"p": 30, "c": 40}


def test_quantiles_by_rank_and_running_totals(spark):
    from presswork.operators import profile, tables

    df = spark.range(1001).select((F.col("id") * 3.5).alias("x")).unionByName(spark.createDataFrame([(None,)], "x double"))
    got = {round(r["quantile"], 2): r["value"] for r in profile.ranked_quantiles(df, "x").collect()}
    want = profile.describe(df, "x").first()
    assert got == {0.01: want["p01"], 0.05: want["p05"], 0.25: want["p25"], 0.5: want["p50"], 0.75: want["p75"], 0.95: want["p95"], 0.99: want["p99"]}
    t = tables.running_total(spark.range(500).select("id", (F.col("id") + 1).alias("n")), ["id"], "n", "total").collect()
    assert all(r["total"] == (r["id"] + 1) * (r["id"] + 2) // 2 for r in t)


def test_no_limits_where_none_are_asked(spark):
    from presswork.operators import segment

    long = "\n\n".join(f"Block number {i} with enough letters to be kept. {'word ' * 300}end." for i in range(450))
    d = spark.createDataFrame([(1, long)], "doc_id long, text string")
    assert segment.blocks(d).count() == 400 and segment.blocks(d, most=None).count() == 450
    s = segment.sentences(segment.blocks(d, most=None), most=None, a_block=None)
    assert s.agg(F.max("sent_len")).first()[0] > 800 and segment.sentences(segment.blocks(d)).agg(F.max("sent_len")).first()[0] == 800
