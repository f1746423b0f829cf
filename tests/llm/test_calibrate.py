import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from presswork.llm import calibrate as C

POOL = "sample_id string, final_type string, entity_doc_bucket string, prob double, blocks long"
PLAN = "plan_id long, sample_size long, final_type string, entity_doc_bucket string, target_share double, min_rows long"


def pool(spark, n=60):
    rows = [(f"s{i:03d}", "Company " if i % 2 else "company", "Below-Tail" if i % 3 else "head", 0.5, 1) for i in range(n)]
    rows += [rows[0], ("x", None, "head", None, None), ("y", "company", None, None, None), (None, "company", "head", None, None)]
    return spark.createDataFrame(rows, POOL)


def plan(spark):
    return spark.createDataFrame([
        (1, 20, "company", "head", 0.5, 2), (1, 20, "company", "below_tail", 0.4, 0), (1, 20, "person", "head", 0.1, 3),
        (2, 200, "company", "head", 1.0, None), (None, 5, "company", "head", 1.0, 1), (3, None, "company", "head", 1.0, 1)], PLAN)


def test_report_meets_targets_or_says_short(spark):
    r = {(x["plan_id"], x["final_type"], x["entity_doc_bucket"]): x for x in C.report(pool(spark), plan(spark)).collect()}
    assert set(r) == {(1, "company", "head"), (1, "company", "below_tail"), (1, "person", "head"), (2, "company", "head")}
    assert (r[1, "company", "head"]["drawn"], r[1, "company", "head"]["short"]) == (10, 0)
    assert r[1, "company", "below_tail"]["drawn"] == 8
    assert (r[1, "person", "head"]["available"], r[1, "person", "head"]["short"]) == (0, 3)
    assert (r[2, "company", "head"]["drawn"], r[2, "company", "head"]["short"]) == (20, 180)
    assert abs(sum(x["actual_share"] for k, x in r.items() if k[0] == 1) - 1) < 1e-9


def test_draw_in_small_blocks_keeps_the_size_and_repeats(spark):
    d = C.draw(pool(spark, 300), plan(spark), block=16)
    got = [tuple(x) for x in d.collect()]
    assert len(got) == len({(x[0], x[1]) for x in got})
    n = {}
    for x in got:
        n[x[0], x[3]] = n.get((x[0], x[3]), 0) + 1
    assert n[1, "head"] == 10 and n[1, "below_tail"] == 8 and n[2, "head"] == 100
    assert sorted(got) == sorted(tuple(x) for x in C.draw(pool(spark, 300), plan(spark), block=16).collect())


def test_empty_tables(spark):
    no_pool, no_plan = spark.createDataFrame([], POOL), spark.createDataFrame([], PLAN)
    assert C.draw(no_pool, plan(spark)).count() == 0
    assert all(x["drawn"] == 0 for x in C.report(no_pool, plan(spark)).collect())
    assert C.report(pool(spark), no_plan).count() == 0


def test_tilt_meets_margins_by_newton():
    counts = np.array([100, 50, 30, 20])
    design = np.array([[1, 0, 1, 0], [1, 0, 0, 1], [0, 1, 1, 0], [0, 1, 0, 1]])  # two margins of two
    target = np.array([40, 20, 35, 25])
    p = C.tilt(counts, design, target)
    assert np.allclose(design.T @ (counts * p), target, atol=1e-4) and (p <= 1).all()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.floats(0.01, 0.99), min_size=1, max_size=60), st.integers(0, 10**6))
def test_pivotal_keeps_the_sum(p, seed):
    out = C.pivotal(np.array(p), np.random.default_rng(seed).random(len(p)))
    assert abs(out.sum() - sum(p)) < 1e-6
    assert ((out > 1e-9) & (out < 1 - 1e-9)).sum() <= 1


def test_pivotal_is_unbiased():
    p = np.array([0.2, 0.5, 0.7, 0.6])
    rng = np.random.default_rng(1)
    mean = np.mean([C.pivotal(p, rng.random(4)) for _ in range(20000)], axis=0)
    assert np.allclose(mean, p, atol=0.02)


def test_too_many_plan_rows_are_refused(spark, monkeypatch):
    monkeypatch.setattr(C, "MAX_PLAN_ROWS", 1)
    with pytest.raises(ValueError):
        C.cell_report(pool(spark), plan(spark))


def test_floors_take_from_the_other_cells_and_margins_hold():
    available = np.array([500, 400, 300, 40, 5])
    share = np.array([0.4, 0.3, 0.2, 0.05, 0.05])
    kind, bucket = np.array(list("aabbb")), np.array(list("xyxyz"))
    n = C.calibrated(available, share, np.array([0, 0, 0, 30, 8]), [kind, bucket], 200)
    assert n[3] == 30 and n[4] == 5  # a floor, and all of a small cell
    assert abs(n.sum() - 195) < 1e-4
    assert abs(n[kind == "a"].sum() - 140) < 1e-4 and abs(n[bucket == "x"].sum() - 120) < 1e-4 and abs(n[bucket == "y"].sum() - 70) < 1e-4
    free = C.calibrated(available * 10, share, np.zeros(5), [kind, bucket], 200)
    for v, w in (("a", 140), ("b", 60)):
        assert abs(free[kind == v].sum() - w) < 1e-4


def test_two_margins_are_met_where_cells_run_out():
    # the (a, x) cell is full at 10 of its 40; (a, y) has to make up for type a
    n = C.calibrated(np.array([10, 900, 900, 900]), np.array([0.4, 0.1, 0.1, 0.4]), np.zeros(4), [np.array(list("aabb")), np.array(list("xyxy"))], 100)
    assert n[0] == 10 and abs(n[1:].sum() - 60) < 1e-4


def test_cells_above_their_floor_stay_above_it():
    r = np.random.default_rng(3)
    for _ in range(100):
        k = 12
        available, share = r.integers(0, 60, k), r.dirichlet(np.ones(k))
        floor, size = r.integers(0, 12, k), int(r.integers(5, 300))
        kinds = [r.choice(list("abc"), k), r.choice(list("xyz"), k)]
        n = C.calibrated(available, share, floor, kinds, size)
        assert (n >= np.minimum(floor, available) - 1e-6).all() and (n <= available + 1e-9).all()
        assert n.sum() <= max(size, np.minimum(floor, available).sum()) + 1e-3 or (n <= np.maximum(share * size, floor) + 1e-6).all()
        need = np.maximum(np.floor(share * size + 0.5), floor)
        assert (n[available < need] == available[available < need]).all()


def test_audit_and_found_come_from_the_draw(spark, monkeypatch):
    from presswork.llm import queries as Q

    monkeypatch.setattr(Q, "read", lambda s, d, name: pool(spark, 300) if name == "sentiment_label_pool" else plan(spark).where("plan_id in (1, 2) and sample_size is not null"))
    q = Q.R.builders
    assert {tuple(x) for x in q["p1_audit"](spark, "").collect()} == {(1, 0, 0, 0), (2, 0, 0, 0)}
    want = {(1, "person", "head"), (2, "company", "head")}
    assert {tuple(x) for x in q["p1_found"](spark, "").collect()} == want
    monkeypatch.setattr(C, "pivotal", lambda p, u: p * 0)
    monkeypatch.setattr(C, "calibrated", lambda a, *_: a * 0.5)
    assert {tuple(x) for x in q["p1_found"](spark, "").collect()} != want
