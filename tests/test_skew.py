"""A key that holds a third of all rows: the work is split and the rows stay whole."""

import contextlib
import io

import pytest
from pyspark.sql import functions as F

from slicesync.operators.slices import drop_slices, keep_slices
from slicesync.sources.versions import VersionedTable

ROWS = 300_000
SETTINGS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
}


@pytest.fixture
def small_partitions(spark):
    before = {key: spark.conf.get(key, None) for key in SETTINGS}
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    yield
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


@pytest.fixture
def hot(spark):
    key = F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 1000)
    return spark.range(ROWS).repartition(8).select(
        key.cast("int").alias("k"), F.md5(F.col("id").cast("string")).alias("v"))


def final_plan(df):
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        df.explain()
    return text.getvalue()


@pytest.mark.parametrize("join", [keep_slices, drop_slices])
def test_slice_joins_split_the_hot_key(spark, small_partitions, hot, join):
    slices = spark.range(0, 500).select(F.col("id").cast("int").alias("k"))
    joined = join(hot, slices, ["k"])
    rows = joined.collect()
    assert "skew=true" in final_plan(joined)
    expected = hot.where("k < 500" if join is keep_slices else "k >= 500").count()
    assert len(rows) == expected


def test_a_hot_part_is_written_by_several_tasks(spark, small_partitions, hot, folder):
    table = VersionedTable(spark, folder, partition_by="k")
    few = hot.withColumn("k", F.when(F.col("k") == 0, 0).otherwise(1 + F.col("k") % 2))
    table.overwrite(few)
    files = table.read().where("k = 0").select(F.input_file_name()).distinct().count()
    assert files > 4
    assert table.read().count() == ROWS
