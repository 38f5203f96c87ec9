import zlib

from pyspark.sql import functions as F

from evalgrid.llm import sharding

SCHEMA = "doc_id long, text string, row_number string, position string"


def test_places_match_the_computed_ones(spark):
    rows = [(i, "t" * (i % 7), "x", "y") for i in range(501)] + [(None, None, None, None), (None, "", "a", "b"), (3, "ttt", "x", "y")]
    got = sharding.shard(spark.createDataFrame(rows, SCHEMA), n_shards=24).collect()
    n = len(rows)
    assert len(got) == n
    assert sorted(r.row_number for r in got) == list(range(n))
    for r in got:
        assert (r.shard, r.slot) == sharding.locate(r.row_number, n)
        assert sharding.row_number_at(r.shard, r.slot, n) == r.row_number
    for s in range(24):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots))) and n // 24 <= len(slots) <= n // 24 + 1
    null_text = [r for r in got if r.doc_id is None]
    assert {(r.size, r.text_crc32) for r in null_text} == {(8, 0)}
    assert all(r.text_crc32 == zlib.crc32(b"t" * (r.doc_id % 7)) for r in got if r.doc_id is not None)


def test_same_rows_in_another_order_give_the_same_places(spark):
    df = spark.createDataFrame([(i, f"text {i}") for i in range(100)], "doc_id long, text string")
    a = {r.doc_id: (r.shard, r.slot) for r in sharding.shard(df).collect()}
    b = {r.doc_id: (r.shard, r.slot) for r in sharding.shard(df.orderBy(F.desc("doc_id")).repartition(5)).collect()}
    assert a == b


def test_small_and_empty_tables(spark):
    for n in (0, 1, 2, 3, 5, 26):
        df = spark.createDataFrame([(i, "é") for i in range(n)], "doc_id long, text string")
        got = sharding.shard(df, n_shards=4).collect()
        assert sorted(r.position for r in got) == list(range(n))
