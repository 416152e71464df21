"""Forbidden phrases against brute force, and a large case in work that does not grow with the pairs."""

import random

import pytest
from pyspark.sql import functions as F

from quillspan.operators import integrity

REPORT, PHRASE = "id long, case_id string, text string", "case_id string, phrase string"


@pytest.mark.parametrize("part, shard", [(2_000, 20_000), (3, 4), (1, 1)])
def test_phrases_are_found_anywhere(spark, part, shard):
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("ab é。", k=rng.randint(1, 4)))
    reports = [(k % 40, rng.choice("xyz"), "".join(word() for _ in range(rng.randint(0, 9)))) for k in range(60)] + [(100, "x", None), (101, "x", ""), (102, None, "ab"), (103, "lone", "ab")]
    phrases = [(rng.choice("xyz"), word()) for _ in range(40)] + [("x", None), ("x", ""), (None, "ab"), ("other", "ab"), ("x", "ab"), ("x", "ab")]
    want = sorted((i, p) for i, c, t in reports for p in {p for d, p in phrases if c is not None and c == d and p} if t and p in t)
    got = integrity.forbidden_phrases(spark.createDataFrame(reports, REPORT).withColumn("phrase", F.lit("clash")), spark.createDataFrame(phrases, PHRASE), part=part, shard=shard)
    assert sorted((r.id, r.phrase) for r in got.collect()) == want and len(want) > 50


def test_a_case_of_many_phrases_and_reports(spark):
    reports = spark.range(20_000).selectExpr("id", "'c' as case_id", "concat('report ', id, ' says phrase-', id * 7 % 200000, '.') as text")
    phrases = spark.range(100_000).selectExpr("'c' as case_id", "concat('phrase-', id, '.') as phrase")
    found = integrity.forbidden_phrases(reports, phrases)
    assert found.count() == sum(k * 7 % 200_000 < 100_000 for k in range(20_000))
    assert found.filter("not endswith(phrase, concat(id * 7 % 200000, '.'))").count() == 0
