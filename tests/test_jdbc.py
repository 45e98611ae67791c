"""Options and statements for databases. Nothing here connects to one."""

import pytest

from slicesync.plans.slice_source import DatabaseSource
from slicesync.sources import jdbc as J

DB = J.Database("jdbc:example://host/db", driver="com.example.Driver", options={"user": "u"})


def test_query_options():
    options = J.query_options(DB, "select * from t where p >= {start_period}", {"start_period": 202401})
    assert options == {
        "url": "jdbc:example://host/db", "driver": "com.example.Driver", "user": "u",
        "fetchsize": "100000", "query": "select * from t where p >= 202401"}


def test_chunk_options():
    options = J.chunk_options(DB, "t", "id", 1, 1000, 100, 950)
    assert (options["partitionColumn"], options["lowerBound"], options["upperBound"],
            options["numPartitions"]) == ("id", "1", "1001", "10")
    with pytest.raises(ValueError):
        J.chunk_options(DB, "t", "id", 5, 4, 100, 1)
    with pytest.raises(ValueError):
        J.chunk_options(DB, "t", "id", 1, 4, 0, 1)


def test_slice_predicates_are_disjoint_and_whole(spark):
    rows = [(a, b) for a in (1, 2, None) for b in ("x", "y'", None, "z")]
    spark.createDataFrame(rows, "a int, b string").createOrReplaceTempView("slice_rows")
    slices = {1: ["x", "y'", None], 2: None, None: ["z", None]}
    predicates = J.slice_predicates("a", "b", slices, per_predicate=1)
    found = [tuple(r) for p in predicates
             for r in spark.sql("SELECT * FROM slice_rows WHERE " + p.replace("'y'''", '"y\'"')).collect()]
    expected = [(a, b) for a, b in rows if a in slices and (slices[a] is None or b in slices[a])]
    assert sorted(found, key=repr) == sorted(expected, key=repr)


def test_fingerprint_query():
    text = J.fingerprint_query("t", [("p", "level1_value")], "CHECKSUM(*)", "CHECKSUM_AGG",
                               "SUM(CAST(CHECKSUM(*) AS BIGINT))", "p = 1")
    assert text == (
        "SELECT p AS level1_value, COUNT(*) AS row_count, CHECKSUM_AGG(CHECKSUM(*)) AS checksum_xor, "
        "SUM(CAST(CHECKSUM(*) AS BIGINT)) AS checksum_sum FROM t WHERE p = 1 GROUP BY p")


@pytest.mark.parametrize("slices", [1, 11])
def test_changed_slices_are_read_in_buckets_and_picked_by_a_join(spark, slices):
    rows = spark.createDataFrame([(p, q) for p in (1, 2, 3) for q in range(12)], "p int, q int")
    asked = []

    def read(predicates):
        asked.extend(predicates)
        return rows.where(" OR ".join(f"({p})" for p in predicates))

    source = DatabaseSource("t", "p", "q", run=None, read=read, read_all=None,
                            bucket_hash="abs(hash({}))", buckets=4)
    wanted = [("1", str(q)) for q in range(slices)] + [("3", "2")]
    chosen = spark.createDataFrame(wanted, "level1_value string, level2_value string")
    got = source.slice_rows(chosen, ["1", "3"]).collect()
    assert sorted((str(a), str(b)) for a, b in got) == sorted(wanted)
    assert len(asked) == 8  # two values in four buckets, however many slices


@pytest.mark.parametrize("values", [None, ["1", None]])
def test_slice_prints_come_in_buckets(spark, values):
    rows = [(p, q) for p in (1, 2, None) for q in [None, *range(9)] for _ in range(2)]
    spark.createDataFrame(rows, "p int, q int").createOrReplaceTempView("bucketed_prints")
    asked = []

    def run(text):
        asked.append(text)
        return spark.sql(text)

    source = DatabaseSource(
        "bucketed_prints", "p", "q", run=run, read=None, read_all=None, row_hash="xxhash64(*)", xor="bit_xor",
        hash_sum="sum(cast(xxhash64(*) AS decimal(20,0)))", bucket_hash="abs(cast(hash({}) AS bigint))", buckets=3)
    got = [tuple(r)[:3] for r in source.level2_prints(values).collect()]
    wanted = {(None if p is None else str(p), None if q is None else str(q), 2) for p, q in rows
              if values is None or (None if p is None else str(p)) in values}
    assert len(got) == len(set(got)) and set(got) == wanted and len(asked) == 3


def test_a_parallel_engine_is_asked_once(spark):
    rows = [(p, q) for p in (1, 2, None) for q in [None, *range(9)]]
    spark.createDataFrame(rows, "p int, q int").createOrReplaceTempView("parallel_prints")
    asked, read = [], []

    def run(text):
        asked.append(text)
        return spark.sql(text)

    def rows_of(predicates):
        read.extend(predicates)
        return spark.table("parallel_prints").where(" OR ".join(f"({p})" for p in predicates))

    def source(**engine):
        return DatabaseSource(
            "parallel_prints", "p", "q", run=run, read=rows_of, read_all=None, row_hash="xxhash64(*)", xor="bit_xor",
            hash_sum="sum(cast(xxhash64(*) AS decimal(20,0)))", bucket_hash="abs(cast(hash({}) AS bigint))", **engine)

    for values in (None, ["1", None]):
        whole, dealt = ([tuple(r) for r in source(**engine).level2_prints(values).collect()]
                        for engine in ({"parallel": True}, {}))
        assert len(whole) == (30 if values is None else 20) and set(whole) == set(dealt)
    assert len(asked) == 2 * (1 + 8)
    chosen = spark.createDataFrame([("1", "2"), (None, None)], "level1_value string, level2_value string")
    got = source(parallel=True).slice_rows(chosen, ["1", None]).collect()
    assert {tuple(r) for r in got} == {(1, 2), (None, None)} and len(got) == 2 == len(read)
