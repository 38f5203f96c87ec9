"""Row numbers and neighbours equal the window functions, with and without buckets."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from evalgrid.operators.sequence import previous_within, row_number_within


@pytest.fixture
def rows(spark):
    # key 0 holds a third of the rows, some have no key
    data = [(None if i % 10 == 9 else 0 if i % 3 == 0 else i % 17, i, (i * 7919) % 1000) for i in range(3000)]
    return spark.createDataFrame(data, "k int, id int, v int")


@pytest.mark.parametrize("bucket", [None, "v div 100"])
def test_row_number_matches_window_with_hot_and_null_keys(rows, bucket):
    got = row_number_within(rows, ["k"], ["v", "id"], out="rn", bucket=bucket and F.expr(bucket)).select("id", "rn")
    w = Window.partitionBy("k").orderBy("v", "id")
    want = rows.withColumn("rn", F.row_number().over(w)).select("id", "rn")
    assert sorted(got.collect()) == sorted(want.collect())


@pytest.mark.parametrize("bucket", [None, "v div 100"])
def test_previous_matches_lag(rows, bucket):
    got = previous_within(rows, ["k"], ["v", "id"], {"id": "before"}, bucket and F.expr(bucket)).select("id", "before")
    want = rows.withColumn("before", F.lag("id").over(Window.partitionBy("k").orderBy("v", "id"))).select("id", "before")
    key = lambda r: (r[0], r[1] is not None, r[1] or 0)
    assert sorted(got.collect(), key=key) == sorted(want.collect(), key=key)


def test_global_numbering_descending(spark):
    df = spark.createDataFrame([(i, float(i % 10), i) for i in range(500)], "id int, s double, t int")
    got = row_number_within(df, [], [F.col("s").desc(), F.col("id").asc()], out="rn")
    want = df.withColumn("rn", F.row_number().over(Window.orderBy(F.col("s").desc(), F.col("id").asc())))
    assert sorted(got.select("id", "rn").collect()) == sorted(want.select("id", "rn").collect())


def test_building_queries_runs_no_job(spark):
    import __spark_entry__ as entry

    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("building", "building plans")
    try:
        for name in ("attempts", "attempt_ordinal", "max_tasks", "invalid_transitions", "join_responses", "resume_missing_attempts"):
            entry.queries()[name](spark, "/root/testdata/sf0.001")
        assert not tracker.getJobIdsForGroup("building") or all(
            tracker.getJobInfo(j) is None or len(tracker.getJobInfo(j).stageIds) <= 1 for j in tracker.getJobIdsForGroup("building")
        )
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
