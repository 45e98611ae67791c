import pytest
from pyspark.sql import functions as F

from slicesync.functions.hashing import row_hash
from slicesync.operators import fingerprint as G
from slicesync.operators.fingerprint import fingerprint
from slicesync.operators.print_changes import WrongBase, change_prints, wrong_slices
from slicesync.plans.fingerprints import FingerprintStore
from slicesync.plans.slice_source import keyed

ROWS = "p int, s string, v double"


def one(df, **options):
    return tuple(G.window_fingerprint(df, **options).first())


@pytest.mark.parametrize("method", ["xxhash64", "md5"])
def test_order_and_partitioning_do_not_matter(spark, method):
    rows = [(i % 7, f"s{i}", i / 4) for i in range(500)]
    a = spark.createDataFrame(rows, ROWS)
    b = spark.createDataFrame(rows[::-1], ROWS).repartition(5)
    assert one(a, method=method, scale=6) == one(b, method=method, scale=6)


@pytest.mark.parametrize("method", ["xxhash64", "md5"])
def test_null_position_matters(spark, method):
    a = spark.createDataFrame([(1, None, 1.0)], ROWS)
    b = spark.createDataFrame([(None, "1", 1.0)], ROWS)
    c = spark.createDataFrame([(None, None, 1.0)], ROWS)
    assert len({one(x, method=method, scale=6) for x in (a, b, c)}) == 3


def test_sum_sees_a_swap_of_duplicated_rows_that_xor_does_not(spark):
    a = spark.createDataFrame([(1, "x", 1.0)] * 2 + [(1, "z", 3.0)], ROWS)
    b = spark.createDataFrame([(1, "y", 2.0)] * 2 + [(1, "z", 3.0)], ROWS)
    (count_a, xor_a, sum_a), (count_b, xor_b, sum_b) = one(a), one(b)
    assert count_a == count_b and xor_a == xor_b and sum_a != sum_b


def test_sum_is_the_exact_unsigned_total(spark):
    df = spark.range(1000).withColumn("h", F.xxhash64("id"))
    expected = sum(row["h"] % 2**64 for row in df.collect())
    prints = G.fingerprint(df.select("id"), columns=["id"], method="xxhash64")
    nullable_free = df.select("id").withColumn("x", row_hash(df.select("id")))
    total = sum(row["x"] % 2**64 for row in nullable_free.collect())
    assert int(prints.first()["checksum_sum"]) == total
    assert expected == total  # id is not nullable, so it carries no flag


def test_level1_is_the_roll_up_of_level2(spark):
    rows = [(i % 5 if i % 11 else None, f"s{i % 3}", float(i)) for i in range(300)]
    df = spark.createDataFrame(rows, ROWS)
    direct = G.level1_fingerprint(df, "p")
    rolled = G.roll_up(G.level2_fingerprint(df, "p", "s"))
    assert sorted(map(tuple, direct.collect()), key=repr) == sorted(
        map(tuple, rolled.select(*direct.columns).collect()), key=repr
    )


def test_empty_window(spark):
    assert one(spark.createDataFrame([], ROWS)) == (0, 0, 0)


def test_classify_treats_null_as_a_slice(spark):
    before = G.level1_fingerprint(
        spark.createDataFrame([(None, "a", 1.0), (1, "b", 1.0), (2, "c", 1.0)], ROWS), "p")
    now = G.level1_fingerprint(
        spark.createDataFrame([(None, "a", 2.0), (1, "b", 1.0), (3, "c", 1.0)], ROWS), "p")
    found = {row["level1_value"]: row["status"]
             for row in G.classify(now, before, ["level1_value"]).collect()}
    assert found == {None: "changed", 1: "unchanged", 2: "deleted", 3: "new"}


def test_window_keeps_values_that_are_no_numbers(spark):
    df = spark.createDataFrame([("202401",), ("202306",), ("north",), (None,)], "level1_value string")
    flags = {r["level1_value"]: r["in_window"] for r in G.in_mutable_window(df, 202401).collect()}
    assert flags == {"202401": True, "202306": False, "north": True, None: True}


def test_unknown_method(spark):
    with pytest.raises(ValueError):
        row_hash(spark.range(1), method="crc")


@pytest.mark.parametrize("method", ["xxhash64", "md5"])
@pytest.mark.parametrize("a,b", [
    (("a|b", "c"), ("a", "b|c")), ((None, "x"), ("<null>", "x")), (("1:a", ""), ("", "1:a")), (("N", None), (None, "N"))])
def test_values_are_framed(spark, method, a, b):
    prints = {one(spark.createDataFrame([row], "x string, y string"), method=method) for row in (a, b)}
    assert len(prints) == 2


@pytest.mark.parametrize("method", ["xxhash64", "md5"])
@pytest.mark.parametrize("kind,a,b", [
    ("array<int>", [1, None], [1]), ("array<int>", [None, 1], [1, None]),
    ("struct<p: int, q: int>", (1, None), (None, 1)), ("array<struct<p: int, q: int>>", [(1, None)], [(None, 1)])])
def test_nested_nulls_count(spark, method, kind, a, b):
    prints = {one(spark.createDataFrame([(x,)], f"v {kind}"), method=method) for x in (a, b)}
    assert len(prints) == 2


def test_small_changes_of_doubles_count(spark):
    prints = {one(spark.createDataFrame([(v,)], "v double")) for v in (1.0, 1.0 + 2e-7, 1e23)}
    assert len(prints) == 3
    with pytest.raises(ValueError):
        row_hash(spark.createDataFrame([(1.0,)], "v double"), method="md5")


# --- fingerprints by differences ---------------------------------------------

def test_prints_move_on_with_a_change(spark, folder):
    """Stored prints after a change are those of a recount; nothing but the change is read."""
    schema, keys = "a string, b int, v double", ["level1_value", "level2_value"]
    rows = [("x", 1, 1.0), ("x", 1, 1.0), ("x", 2, None), ("y", 1, 3.0), (None, None, 4.0)]
    gone = [("x", 1, 1.0), ("y", 1, 3.0), (None, None, 4.0)]
    came = [("x", 2, 7.0), ("z", 9, 0.0), (None, 3, 1.0)]
    after = [("x", 1, 1.0), ("x", 2, None), *came]

    def sliced(values):
        return keyed(spark.createDataFrame(values, schema), "a", "b")

    def prints(values):
        return fingerprint(sliced(values), keys, ["a", "b", "v"])

    def known(df):
        return sorted(map(tuple, df.select(*keys, "row_count", "checksum_xor", "checksum_sum").collect()), key=repr)

    store = FingerprintStore(spark, folder)
    change = change_prints(sliced(gone), sliced(came), keys, ["a", "b", "v"])
    assert store.move_on(change, "c", "t", "product", "m") is None  # nothing known, nothing made up
    store.save(prints(rows), "c", "t", "product", made_by="m")
    store.move_on(change, "c", "t", "product", "m")
    assert known(store.load("c", "t", "product", made_by="m")) == known(prints(after))
    back = change_prints(sliced(came), sliced(gone), keys, ["a", "b", "v"])
    store.move_on(back, "c", "t", "product", "m")
    assert known(store.load("c", "t", "product")) == known(prints(rows))
    assert store.move_on(back, "c", "t", "product", "another way") is None


def test_a_wrong_base_is_found(spark, folder):
    keys, schema = ["level1_value", "level2_value"], "a string, b int, v double"
    held = keyed(spark.createDataFrame([("x", 1, 1.0), ("x", 2, 2.0)], schema), "a", "b")
    others = keyed(spark.createDataFrame([("x", 1, 9.0), ("y", 1, 9.0)], schema), "a", "b")
    none, columns, store = held.limit(0), ["a", "b", "v"], FingerprintStore(spark, folder)
    store.save(fingerprint(held, keys, columns), "c", "t", "product", made_by="m")
    for removed in (others.where("a = 'x'"), others.where("a = 'y'"), held.unionByName(held)):
        with pytest.raises(WrongBase):  # rows that the base cannot have had
            store.move_on(change_prints(removed, none, keys, columns), "c", "t", "product", "m")
    prints = store.load("c", "t", "product").withColumn("checksum_xor", F.col("checksum_xor") + (F.col("level2_value") == "2").cast("int"))
    assert [r["level2_value"] for r in wrong_slices(prints, held, keys, columns).collect()] == ["2"]
    one = held.where("b = 1").select(*keys)
    assert wrong_slices(prints, held, keys, columns, of=one).isEmpty()
