"""Queries keep everything the method keeps, on tables larger than the small cuts they once had."""

import __spark_entry__ as entry


def run(spark, name, tmp_path, **tables):
    for t, df in tables.items():
        df.write.parquet(str(tmp_path / f"{t}.parquet"))
    return entry.queries()[name](spark, str(tmp_path))


def test_entity_candidates_keeps_more_than_150(spark, tmp_path):
    m = spark.range(600).selectExpr(
        "concat('Firm ', translate(cast(id div 3 as string), '0123456789', 'abcdefghij')) AS canonical_entity", "'company' AS final_type", "id AS doc_id",
        "'a.com' AS domain", "0.9D AS confidence", "false AS is_news_source", "false AS is_numeric_junk")
    assert run(spark, "entity_candidates", tmp_path, entity_mentions_final=m).count() == 200


def test_top_k_tier_folds_only_beyond_40(spark, tmp_path):
    d = spark.range(50 * 51 // 2).selectExpr("concat('s', cast(floor((sqrt(8D * id + 1) - 1) / 2) as int)) AS source")
    got = {r["domain_tier"]: r["n"] for r in run(spark, "top_k_tier", tmp_path, documents=d).collect()}
    assert got == {f"s{k}": k + 1 for k in range(10, 50)} | {"other": 55}
