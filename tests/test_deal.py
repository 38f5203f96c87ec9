"""Costly rows of an input with few splits are dealt to all cores of a cluster."""

from pyspark.sql import functions as F

from evalgrid import session
from evalgrid.plans import fixtures as fx

SF_SMALL = "/root/testdata/sf0.001"


def test_costly_views_leave_no_core_waiting(spark, monkeypatch, tmp_path):
    rows = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    odd = rows.limit(50).withColumn("event_id", F.lit(None).cast("long"))
    rows.unionByName(odd).unionByName(rows.limit(50)).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    views = (fx.attempt_input, fx.json_texts, fx.valued_tasks, fx.call_log)
    plain = [sorted(map(str, v(spark, str(tmp_path)).drop("task").collect())) for v in views]
    monkeypatch.setattr(session, "_one_machine", lambda sc: False)
    least = session.TASKS_A_CORE * spark.sparkContext.defaultParallelism
    for view, expected in zip(views, plain):
        df = view(spark, str(tmp_path)).drop("task")
        busy = df.groupBy(F.spark_partition_id()).count().count()
        assert busy > 0.9 * least and sorted(map(str, df.collect())) == expected
