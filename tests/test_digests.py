"""Multiset digests against plain counts."""

from __future__ import annotations

import collections
import random
import re

from pyspark.sql import functions as F

from gridpulse.operators import digests, quality
from gridpulse.plans import catalog
from conftest import SMALL

SCHEMA = "a int, b double, c string"


def rows(seed):
    rng = random.Random(seed)
    return [(rng.choice([None, 1, 2, 3]), rng.choice([0.0, -0.0, 1.5, None, float("inf")]), rng.choice(["x", "y", None, ""])) for _ in range(400)]


def test_digest_is_of_the_rows_in_any_order(spark):
    data = rows(1)
    df = spark.createDataFrame(data, SCHEMA)
    assert digests.same_rows(df, df.repartition(7).orderBy("c").select("c", "a", "b"))
    assert not digests.same_rows(df, spark.createDataFrame(data[1:] + [data[5]], SCHEMA))
    assert not digests.same_rows(df, spark.createDataFrame(data + data[:1] + data[:1], SCHEMA))
    assert not digests.same_rows(df, df.withColumnRenamed("a", "z"))
    assert digests.same_rows(df.limit(0), df.limit(0)) and not digests.same_rows(df, df.limit(0))


def test_nulls_in_different_columns_differ(spark):
    one, two = (spark.createDataFrame([r], "a int, b int") for r in ((None, 1), (1, None)))
    assert not digests.same_rows(one, two)


def test_repeated_rows_against_a_counter(spark):
    data = rows(2) + [(9, 9.0, "once")]
    got = {tuple(r)[:3]: r["n"] for r in digests.repeated_rows(spark.createDataFrame(data, SCHEMA)).collect()}
    want = {k: n for k, n in collections.Counter((a, b, c) for a, b, c in data).items() if n > 1}
    assert got == want
    assert quality.exact_duplicates(spark.createDataFrame(data, SCHEMA)).first()[0] == sum(n - 1 for n in want.values())
    assert quality.exact_duplicates(spark.createDataFrame([], SCHEMA)).first()[0] == 0


def test_duplicates_exchange_digests_first(spark):
    df = quality.exact_duplicates(catalog.activity(spark, SMALL))
    keys = re.findall(r"Exchange hashpartitioning\(([^)]*)", df._jdf.queryExecution().executedPlan().toString())
    assert keys and all("_digest" in k or "timestamp" in k for k in keys)


def test_round_trip_notices_changed_contents(spark, hours_frame):
    df = hours_frame([(1, h, h) for h in range(30)]).withColumn("date", F.to_date("timestamp"))
    keys = ["date", "timestamp", "grid_id"]
    assert quality.roundtrip_checks(df.repartition(3), df, keys).filter("not passed").count() == 0
    other = df.withColumn("total_activity", F.when(F.hour("timestamp") == 3, 99.0).otherwise(F.col("total_activity")))
    failed = quality.roundtrip_checks(other, df, keys).filter("not passed")
    assert [r["check"] for r in failed.collect()] == ["contents_differ"]
