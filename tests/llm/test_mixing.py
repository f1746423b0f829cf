import numpy as np
import pytest

from presswork.llm import mixing as M

D = "doc_id long, source string, text string, tokens long, frac double"
X = "mix_id long, budget_ratio double, source string, target_share double, max_repeats long"


def docs(spark, n=200):
    rows = [(i, "big" if i % 4 else "small", "word " * (5 + i % 37), 7, 0.5) for i in range(n)]
    return spark.createDataFrame([*rows, (900, None, "no source", 1, 0.1), (901, "big", None, 1, 0.1), (902, "small", "", 1, 0.1)], D)


def mixes(spark):
    return spark.createDataFrame([
        (1, 0.5, "big", 0.6, 1), (1, 0.5, "small", 0.4, 3), (2, 1.0, "small", 0.9, 2), (2, 1.0, "absent", 0.1, 5),
        (3, 1.0, "small", 0.1, None), (None, 1.0, "big", 1.0, 1), (4, None, "big", 1.0, 1)], X)


@pytest.fixture(scope="module")
def counts(spark):
    return M.token_counts(docs(spark))


def test_token_counts_round_trip(spark, counts):
    enc = M._encoding(M.VOCABULARY)
    got = {r["doc_id"]: r["tokens"] for r in counts.collect()}
    for d, _, t, *_ in docs(spark).limit(5).collect():
        ids = enc.encode_ordinary(t)
        assert enc.decode(ids) == t and got[d] == len(ids)
    assert got[901] == 0 and got[902] == 0


def test_shares_caps_and_shortfalls(spark, counts):
    r = {(x["mix_id"], x["source"]): x for x in M.mix_report(counts, mixes(spark)).collect()}
    assert set(r) == {(1, "big"), (1, "small"), (2, "small"), (2, "absent"), (3, "small")}
    assert not r[1, "big"]["short"] and abs(r[1, "big"]["drawn_tokens"] / r[1, "big"]["target_tokens"] - 1) < 0.03
    assert not r[1, "small"]["short"] and abs(r[1, "small"]["drawn_tokens"] / r[1, "small"]["target_tokens"] - 1) < 0.05
    assert r[2, "small"]["short"] and r[2, "small"]["drawn_tokens"] == r[2, "small"]["reachable_tokens"]
    assert r[2, "absent"]["short"] and r[2, "absent"]["drawn_tokens"] == 0
    assert r[3, "small"]["short"] and r[3, "small"]["drawn_tokens"] == 0


def test_no_document_above_its_cap_and_blocks_agree(spark, counts):
    for block in (20_000, 16):
        got = M.mix(counts, mixes(spark), block=block).collect()
        assert len({(x["mix_id"], x["doc_id"]) for x in got}) == len(got)
        assert max(x["copies"] for x in got if x["mix_id"] == 1 and x["source"] == "big") == 1
        total = sum(x["tokens"] * x["copies"] for x in got if x["mix_id"] == 1 and x["source"] == "big")
        want = 0.6 * 0.5 * sum(x["tokens"] for x in counts.collect())
        assert abs(total / want - 1) < 0.05


def test_flight_keeps_both_totals():
    rng = np.random.default_rng(4)
    p, t = rng.random(500), rng.integers(1, 900, 500)
    out = M.flight(p, t)
    assert abs(out.sum() - p.sum()) < 1e-6 and abs((out * t).sum() - (p * t).sum()) < 1e-3
    assert ((out > 0) & (out < 1)).sum() <= 2
    same = M.flight(np.full(9, 0.5), np.full(9, 7))
    assert ((same > 0) & (same < 1)).sum() <= 1


def test_landing_decides_all():
    for u in ([0.1, 0.9], [0.9, 0.1], [0.5, 0.5]):
        out = M.landing(np.array([0.3, 0.6]), np.array(u))
        assert set(out) <= {0.0, 1.0}


def test_empty(spark, counts):
    e = M.token_counts(spark.createDataFrame([], D))
    assert M.mix(e, mixes(spark)).count() == 0
    assert all(x["drawn_tokens"] == 0 for x in M.mix_report(e, mixes(spark)).collect())
    assert M.mix_report(counts, spark.createDataFrame([], X)).count() == 0


def test_found_and_audit_come_from_the_draw(spark, counts, monkeypatch):
    r = {(x["mix_id"], x["source"]): x for x in M.mix_report(counts, mixes(spark)).collect()}
    assert {k for k, x in r.items() if x["short"]} == {k for k, x in r.items() if x["reachable_tokens"] < x["target_tokens"]} != set()
    assert all(tuple(x)[1:] == (0, 0, 0) for x in M.mix_audit(counts, mixes(spark)).collect())
    drawn = M.mix
    monkeypatch.setattr(M, "mix", lambda *a: drawn(*a).where("source <> 'small'"))
    assert {k for k, x in r.items() if x["short"]} != {(x["mix_id"], x["source"]) for x in M.mix_report(counts, mixes(spark)).collect() if x["short"]}
    assert any(x["sources_off"] for x in M.mix_audit(counts, mixes(spark)).collect())
