import os

import pytest

from voxtable.plans.storage import FILE_FACTOR, LEAST_FACTOR, arrow_batches, scratch, staged, staged_rows


def test_scratch_deletes_all_but_kept_tables(spark):
    with scratch(spark) as keep:
        gone, kept = staged(spark.range(3)), keep(staged(spark.range(5)))
        with scratch(spark) as keep_inner:
            inner = keep_inner(staged(spark.range(2)))
        assert inner.count() == 2
    outside = staged(spark.range(4))
    there = [os.path.exists(x._staged_path.removeprefix("file:")) for x in (gone, kept, inner, outside)]
    assert there == [False, True, False, True]
    assert kept.count() == 5


def test_scratch_deletes_after_an_error(spark):
    with pytest.raises(ValueError), scratch(spark):
        lost = staged(spark.range(3))
        raise ValueError
    assert not os.path.exists(lost._staged_path.removeprefix("file:"))


def test_arrow_batches_restores_the_session(spark):
    keys = ["spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"]
    before = [spark.conf.get(k) for k in keys]
    with arrow_batches(spark, 10, "1m"):
        assert [spark.conf.get(k) for k in keys] != before
    assert [spark.conf.get(k) for k in keys] == before


def test_many_rows_in_small_files_are_not_broadcast(spark):
    """A million rows of voxels in a few kB of Parquet would fill a small driver as a hash table."""
    rows = spark.range(1_000_000).selectExpr("id div 1000 as scan_id", "cast(id % 1000 as int) as i", "1 as inst")
    one, two = staged_rows(rows), staged_rows(rows.withColumnRenamed("inst", "other"))
    assert sum(os.path.getsize(f"{x[0]}/{f}") for x in os.walk(one._staged_path.removeprefix("file:")) for f in x[2]) < 10 << 20
    met = one.filter("inst > 0").join(two, ["scan_id", "i"])
    assert met.count() == 1_000_000
    assert "BroadcastHashJoin" not in met._jdf.queryExecution().executedPlan().toString()


def test_few_rows_may_be_broadcast(spark):
    one, two = staged_rows(spark.range(3)), staged_rows(spark.range(5).filter("id > 9"))
    assert "BroadcastHashJoin" in staged_rows(spark.range(9)).join(one, "id")._jdf.queryExecution().executedPlan().toString()
    assert two.count() == 0


def test_a_higher_factor_of_the_user_stays(spark):
    before = spark.conf.get(FILE_FACTOR)
    try:
        for factor, want in (("1.0", LEAST_FACTOR), ("100", 100)):
            spark.conf.set(FILE_FACTOR, factor)
            staged_rows(spark.range(3))
            assert float(spark.conf.get(FILE_FACTOR)) == want
    finally:
        spark.conf.set(FILE_FACTOR, before)
