"""Every core query with an oracle gives the same rows in DuckDB; plans are what they should be."""

import importlib
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
REG = {k: r for m in entry.CORE for r in [importlib.import_module(m).R] for k in r.builders}
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for f in os.listdir(SF):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return c


def plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, (list, tuple)):
        return str([plain(y) for y in x])
    try:
        return repr(round(float(x), 5) + 0.0)
    except (TypeError, ValueError):
        return str(x)


@pytest.mark.parametrize("name", sorted(k for k in REG if k in REG[k].oracles))
def test_against_oracle(spark, con, name):
    df = REG[name].builders[name](spark, SF)
    cur = con.execute(REG[name].oracles[name])
    cols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(cols)
    order = sorted(cols)
    got = sorted(
        (tuple(plain(r[c]) for c in order) for r in df.collect()), key=repr)
    at = [cols.index(c) for c in order]
    want = sorted((tuple(plain(r[i]) for i in at) for r in cur.fetchall()), key=repr)
    assert got == want


@pytest.mark.parametrize("name", sorted(k for k in REG if k not in REG[k].oracles))
def test_runs(spark, name):
    assert REG[name].builders[name](spark, SF).count() > 0


def plan(df):
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize("name", ["block_relevance_by_source", "sentence_split_suspect", "entity_contexts", "sentiment_cube_entity", "doc_topic_distribution", "p4_found"])
def test_relational_plans_stay_in_the_jvm(spark, name):
    p = plan(REG[name].builders[name](spark, SF))
    assert "Python" not in p and "Pandas" not in p


def test_scans_read_only_what_is_asked(spark):
    p = plan(REG["sentence_flags_by_bucket"].builders["sentence_flags_by_bucket"](spark, SF))
    assert "sentence_text" not in p.split("Physical Plan")[1]
    p = plan(REG["block_relevance_by_source"].builders["block_relevance_by_source"](spark, SF))
    assert "PushedFilters: [IsNotNull(lang), EqualTo(lang,en)" in p or "EqualTo(lang,en)" in p


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_llm_is_an_addition_only():
    here = os.path.join(os.path.dirname(entry.__file__), "presswork")
    for base, _, names in os.walk(here):
        if os.path.basename(base) != "llm" and f"{os.sep}llm{os.sep}" not in base + os.sep:
            for n in names:
                if n.endswith(".py"):
                    assert "presswork.llm" not in open(os.path.join(base, n)).read(), n
