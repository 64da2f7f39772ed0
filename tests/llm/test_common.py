"""Samples keep their bound whatever the keys."""

import pytest
from pyspark.sql import functions as F

from lintel.llm.common import bounded_sample


@pytest.mark.parametrize(("n", "limit"), [(100, 200), (5000, 1000), (20_000, 7), (3000, 1)])
def test_bound_holds(spark, n, limit):
    df = spark.range(n).withColumn("part", F.lit("clash"))
    found = sorted(r["id"] for r in bounded_sample(df, "id", limit).collect())
    assert len(found) == n if n <= limit else 0.5 * limit <= len(found) <= limit
    assert found == sorted(r["id"] for r in bounded_sample(df.repartition(7), "id", limit).collect())


def test_hot_and_missing_keys(spark):
    df = spark.range(9000).select(F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id")).alias("id"))
    assert 400 <= bounded_sample(df, "id", 500).count() <= 500
    one = spark.range(300).select(F.lit(None).cast("long").alias("id"))
    assert bounded_sample(one, "id", 20).count() == 20
    assert bounded_sample(one.limit(0), "id", 20).count() == 0
