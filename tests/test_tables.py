from datetime import datetime

import pytest
from pyspark.sql import functions as F

from slicesync.operators import slices
from slicesync.plans.tags import TagRegistry
from slicesync.sources import tables as S
from slicesync.sources.unify import concat_parts
from slicesync.sources.versions import VersionedTable, change_feed


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), "k int, part string, v string")


def rows_of(df):
    return sorted(map(tuple, df.select("k", "part", "v").collect()), key=repr)


@pytest.fixture
def table(spark, folder):
    return VersionedTable(spark, f"{folder}/t", partition_by="part")


def test_parts_are_replaced_added_and_removed(spark, table):
    table.overwrite(frame(spark, (1, "a", "x"), (2, "b", "x"), (3, None, "x")))
    table.replace_parts(frame(spark, (1, "a", "y"), (9, "c", "y")), ["a", "b"])
    assert rows_of(table.read()) == [(1, "a", "y"), (3, None, "x"), (9, "c", "y")]
    table.append(frame(spark, (10, "c", "z")))
    assert rows_of(table.read(parts=["c"])) == [(10, "c", "z"), (9, "c", "y")]
    assert rows_of(table.read(version=1)) == [(1, "a", "x"), (2, "b", "x"), (3, None, "x")]
    assert len(rows_of(table.read())) == 4
    table.overwrite(frame(spark).limit(0))
    assert rows_of(table.read()) == []
    assert [r["operation"] for r in table.history().orderBy("version").collect()] == [
        "overwrite", "replace", "append", "overwrite"]


def test_odd_partition_values_survive(spark, table):
    values = ["a b", "x/y", "50%", "k=v", "ä", "#1", "2024", "007"]
    table.overwrite(frame(spark, *[(i, value, "x") for i, value in enumerate(values)]))
    table.replace_parts(frame(spark, (2, "50%", "new")), ["50%"])
    found = {row["part"]: row["v"] for row in table.read().collect()}
    assert found == {value: "new" if value == "50%" else "x" for value in values}


def test_empty_text_is_refused_as_a_part(spark, table):
    with pytest.raises(Exception, match="empty text"):
        table.overwrite(frame(spark, (1, "", "x")))


def test_a_directory_of_a_failed_commit_is_not_seen(spark, table):
    table.overwrite(frame(spark, (1, "a", "x")))
    frame(spark, (5, "a", "lost")).write.parquet(f"{table.path}/data/_version=2/part=a")
    assert rows_of(table.read()) == [(1, "a", "x")]
    table.append(frame(spark, (2, "a", "y")))
    assert rows_of(table.read()) == [(1, "a", "x"), (2, "a", "y")]


def test_versions_by_moment(spark, table):
    table.overwrite(frame(spark, (1, "a", "x")), committed_at=datetime(2024, 1, 1))
    table.overwrite(frame(spark, (2, "a", "y")), committed_at=datetime(2024, 1, 3))
    assert rows_of(table.read_at(datetime(2024, 1, 2))) == [(1, "a", "x")]
    with pytest.raises(LookupError):
        table.read_at(datetime(2023, 1, 1))


def test_append_matches_columns_by_name(spark, folder):
    table = VersionedTable(spark, f"{folder}/u")
    table.append(spark.createDataFrame([(1, "x")], "A int, B string"))
    table.append(spark.createDataFrame([("y", 2)], "b string, a int"))
    assert sorted(map(tuple, table.read().collect())) == [(1, "x"), (2, "y")]
    with pytest.raises(ValueError):
        table.append(spark.createDataFrame([(3,)], "a int"))
    with pytest.raises(ValueError, match="differ only in case"):
        table.overwrite(spark.createDataFrame([(1, 2)], "a int, B int").toDF("a", "A"))


def test_change_feed(spark, table):
    table.overwrite(frame(spark, (1, "a", "x"), (2, "a", None), (3, "b", "x"), (4, "c", "x")))
    table.replace_parts(frame(spark, (1, "a", "x"), (2, "a", "now"), (5, "b", "x")), ["a", "b"])
    feed = {(r["k"], r["change_type"]) for r in change_feed(table, 1, 2, ["k"]).collect()}
    assert feed == {(2, "update"), (3, "delete"), (5, "insert")}


def test_tags(spark, table, folder):
    tags = TagRegistry(spark, f"{folder}/tags")
    with pytest.raises(LookupError):
        tags.create("t", table, "none")
    table.overwrite(frame(spark, (1, "a", "x")))
    assert tags.create("t", table, "one") == 1
    with pytest.raises(ValueError, match="already exists"):
        tags.create("t", table, "one")
    assert tags.delete("t", "one") and not tags.delete("t", "one")
    assert tags.list().count() == 0


def test_override_and_find(spark):
    common = spark.createDataFrame([(1, "c"), (None, "c"), (3, "c")], "k int, v string")
    tenant = spark.createDataFrame([(None, "t"), (1, "t"), (9, "t")], "k int, v string")
    merged = {row["k"]: row["v"] for row in S.override_rows(common, tenant, ["k"]).collect()}
    assert merged == {1: "t", None: "t", 9: "t", 3: "c"}
    assert S.find_entry(common, tenant, {"k": 3}).first()["v"] == "c"
    with pytest.raises(LookupError):
        S.find_entry(common, tenant, {"k": 77})


def test_unify_counts_lost_values(spark):
    first = spark.createDataFrame([(1, None)], "a int, b void")
    second = spark.createDataFrame([("7", 2.5), ("x", 1.0)], "a string, b double")
    third = spark.createDataFrame([(True,)], "c boolean")
    combined = concat_parts([first, second, third], failures="lost")
    rows = sorted(map(tuple, combined.select("a", "b", "c", "lost").collect()), key=repr)
    assert rows == sorted(
        [(1, None, None, 0), (7, 2.5, None, 0), (None, 1.0, None, 1), (None, None, True, 0)],
        key=repr)


def test_union_servers_with_different_columns(spark):
    readers = {"s1": lambda: spark.range(1), "s2": lambda: spark.range(2).withColumn("x", F.lit(1))}
    rows = sorted(map(tuple, S.union_servers(readers).select("server", "id", "x").collect()))
    assert rows == [("s1", 0, None), ("s2", 0, 1), ("s2", 1, 1)]


def test_missing_three_part_name(spark):
    databases = S.DatabaseMap({"a": lambda schema, name: spark.range(1)})
    assert databases.scan("a.dbo.t").count() == 1
    with pytest.raises(LookupError):
        databases.scan("b.dbo.t")
    with pytest.raises(ValueError):
        databases.scan("dbo.t")


def test_row_cap(spark):
    assert S.row_cap(spark.range(9), None).count() == 9
    assert [r[0] for r in S.row_cap(spark.range(9), 2, F.desc("id")).collect()] == [8, 7]
    with pytest.raises(ValueError):
        S.row_cap(spark.range(9), 0)


def test_restrict_by_range_and_join(spark):
    df = spark.createDataFrame([(1,), (2,), (None,), (4,)], "k int")
    kept = slices.restrict(df, "k", ["1", None, "9"]).collect()
    assert sorted([r[0] for r in kept], key=repr) == [1, None]
    assert slices.restrict(df, "k", []).isEmpty()


def test_chunks_cover_every_row(spark):
    df = spark.range(5, 1005).withColumnRenamed("id", "k")
    chunks = S.chunk_counts(df, "k", 300).orderBy("chunk").collect()
    assert [tuple(r) for r in chunks] == [
        (0, 250, 5, 254), (1, 250, 255, 504), (2, 250, 505, 754), (3, 250, 755, 1004)]
    assert S.chunk_counts(df.limit(0), "k", 300).isEmpty()


# --- buckets ----------------------------------------------------------------

@pytest.fixture
def bucketed(spark, folder):
    return VersionedTable(spark, f"{folder}/t", partition_by="part", bucket_by="k", buckets=4)


def units_of(table, df):
    return {tuple(r) for r in df.select("part", table.bucket_of("k")).distinct().collect()}


def test_a_bucket_is_replaced_alone(spark, bucketed):
    rows = [(k, part, "x") for k in range(40) for part in ("a", "b", None)]
    bucketed.overwrite(frame(spark, *rows, (None, "a", "x")))
    changed = frame(spark, (3, "a", "y"), (5, None, "y"), (None, "a", "y"))
    units = units_of(bucketed, changed)
    old = bucketed.read(parts=units)
    assert old.count() < 40 and units_of(bucketed, old) == units
    kept = old.join(changed.select("k", F.col("part").alias("p")), old["k"].eqNullSafe(changed["k"]) & old["part"].eqNullSafe(F.col("p")), "left_anti")
    version = bucketed.replace_parts(kept.unionByName(changed), units)
    touched = {(3, "a"), (5, None), (None, "a")}
    assert rows_of(bucketed.read()) == sorted(
        [(k, p, "y" if (k, p) in touched else v) for k, p, v in [*rows, (None, "a", "x")]], key=repr)
    # The commit wrote the buckets it touched, and the others are still the first commit's.
    assert bucketed.rows_written(version) == old.count()
    live = {(r["part"], r["bucket"]): r["version"] for r in bucketed.live_parts().collect()}
    assert {unit for unit, number in live.items() if number == version} == units
    assert rows_of(bucketed.read(version=1)) == sorted([*rows, (None, "a", "x")], key=repr)
    assert len(changed_parts(bucketed)) == len(units)


def changed_parts(table):
    old, new = table.live_parts(1), table.live_parts(2)
    return {(r["part"], r["bucket"]) for r in old.exceptAll(new).unionAll(new.exceptAll(old)).collect()}


def test_a_partition_stands_for_all_its_buckets(spark, bucketed):
    bucketed.overwrite(frame(spark, *[(k, p, "x") for k in range(20) for p in "ab"]))
    bucketed.replace_parts(frame(spark, (1, "a", "y"), (99, "c", "y")), ["a"])
    got = rows_of(bucketed.read())
    assert [r for r in got if r[1] != "b"] == [(1, "a", "y"), (99, "c", "y")] and len(got) == 22
    bucketed.append(frame(spark, (2, "a", "z")))
    assert [r for r in rows_of(bucketed.read(parts=["a"]))] == [(1, "a", "y"), (2, "a", "z")]


def test_a_failed_bucket_commit_is_not_seen(spark, bucketed):
    bucketed.overwrite(frame(spark, (1, "a", "x")))
    broken = frame(spark, (1, "a", "y")).withColumn("v", F.raise_error(F.lit("stop")).cast("string"))
    with pytest.raises(Exception, match="stop"):
        bucketed.replace_parts(broken, ["a"])
    assert rows_of(bucketed.read()) == [(1, "a", "x")]
    bucketed.replace_parts(frame(spark, (1, "a", "z")), ["a"])
    assert rows_of(bucketed.read()) == [(1, "a", "z")]


def test_buckets_need_partitions(spark, folder):
    with pytest.raises(ValueError):
        VersionedTable(spark, folder, bucket_by="k")
