"""Hash trees, covers, balanced chunks, late rows, bitmaps and deep pages against plain ways."""

import random
from datetime import datetime

import pytest
from test_plans import plan_of

from slicesync.operators import chunks as C
from slicesync.operators import hash_tree as H
from slicesync.operators.distinct_bitmaps import distinct_counts, key_bitmaps
from slicesync.operators.intervals import cover, keep_keys
from slicesync.operators.paging import page_after, page_at
from slicesync.plans.fingerprints import FingerprintStore
from slicesync.plans.incremental import run_incremental_sync
from slicesync.queries import QUERIES
from slicesync.sources.versions import VersionedTable

# --- covers ------------------------------------------------------------------


@pytest.mark.parametrize("at_most", [1, 3, 50])
@pytest.mark.parametrize("cells", [5, 4096])
def test_a_cover_holds_every_key(spark, at_most, cells):
    values = [-(2**63), -7, 0, 1, 2, 500, 501, 90_000, 2**63 - 1]
    keys = spark.createDataFrame([(v,) for v in [*values, None, 2]], "k long")
    found = cover(keys, "k", at_most, cells)
    assert len(found) <= at_most and all(any(a <= v <= b for a, b in found) for v in values)
    assert all(first[1] < second[0] for first, second in zip(found, found[1:]))


def test_a_cover_leaves_out_the_widest_gaps(spark):
    keys = spark.createDataFrame([(v,) for v in (1, 2, 3, 1000, 1001, 5000)], "k int")
    assert cover(keys, "k", 3) == [(1, 3), (1000, 1001), (5000, 5000)]
    assert cover(keys, "k", 2) == [(1, 1001), (5000, 5000)]
    assert cover(keys.where("k < 0"), "k") == []


def test_covers_of_dates_and_moments(spark):
    days = spark.sql("SELECT timestamp_ntz'2024-01-01' + make_interval(0,0,0,id * 9) AS t, "
                     "date_add(date'2024-01-01', cast(id AS int)) AS d FROM range(4)")
    assert cover(days, "t", 1) == [(datetime(2024, 1, 1), datetime(2024, 1, 28))]
    assert len(cover(days, "d", 2)) == 2
    assert keep_keys(days, "t", days.limit(2), at_most=1).count() == 2
    with pytest.raises(ValueError):
        cover(days.selectExpr("cast(t AS string) AS t"), "t")


def test_intervals_reach_the_scan_and_nulls_are_keys(spark, folder):
    rows = spark.range(100_000).selectExpr("nullif(id, 17) AS id", "id % 7 AS v")
    rows.write.option("parquet.block.size", 16_384).parquet(folder)
    stored = spark.read.parquet(folder)
    keys = spark.createDataFrame([(5,), (6,), (50_000,), (None,)], "k long")
    got = keep_keys(stored, "id", keys, "k", at_most=2)
    plan = plan_of(got)
    assert "GreaterThanOrEqual(id,5)" in plan and "LessThanOrEqual(id,50000)" in plan
    assert sorted(r[0] or 0 for r in got.collect()) == [0, 5, 6, 50_000]


# --- hash tree ----------------------------------------------------------------

ROWS = "slice string, id long, v string"


def _tree(spark, rows, folder, depth):
    placed = H.by_place(spark.createDataFrame(rows, ROWS), f"{folder}/rows", ["slice"], ["id"], depth)
    return placed, H.HashTree.build(placed, f"{folder}/tree", ["slice"], ["id"], depth)


def test_a_tree_of_placed_rows_takes_their_leaves(spark, folder, monkeypatch):
    rows = [(s, i, "a") for s, n in (("hot", 300), ("b", 40), (None, 40)) for i in [None, *range(n)]] * 2
    placed, tree = _tree(spark, rows, folder, 2)
    monkeypatch.setattr(H, "place", None)  # not computed again
    again = H.HashTree.build(placed, f"{folder}/again", ["slice"], ["id"], 2, placed=True)
    for level in (1, 2):
        a, b = (sorted(map(str, t.nodes(level).collect())) for t in (tree, again))
        assert a == b and a


@pytest.mark.parametrize("depth", [1, 3])
def test_the_tree_finds_the_rows_that_differ(spark, folder, depth):
    draw = random.Random(depth)
    before = [(s, i, "a") for s, n in (("hot", 3000), ("b", 40), (None, 40)) for i in [None, *range(n)]]
    now = list(before)
    now[draw.randrange(3000)] = ("hot", 77, "changed")
    now.remove((None, 5, "a"))
    now += [("b", 1, "a"), ("b", 1, "a"), ("new", 1, "n"), ("hot", 10**9, "n")]
    (new_rows, new_tree), (old_rows, old_tree) = (
        _tree(spark, rows, f"{folder}/{label}", depth) for label, rows in (("n", now), ("o", before)))
    leaves = H.differing_leaves(new_tree, old_tree)
    sides = [H.rows_of_leaves(rows, ["slice"], leaves) for rows in (new_rows, old_rows)]
    got = {tuple(r)[:3]: r["change"] for r in H.differing_rows(*sides, ["slice", "id", "v"]).collect()}
    counts = {row: now.count(row) - before.count(row) for row in {*now, *before}}
    assert got == {row: n for row, n in counts.items() if n}
    if depth == 3:
        assert sides[0].where("slice = 'hot'").count() < 0.05 * 3000
    hot = spark.createDataFrame([("hot",)], "slice string")
    only = H.differing_leaves(new_tree, old_tree, hot)
    assert {r["slice"] for r in only.collect()} == {"hot"}


def test_equal_trees_have_no_leaves(spark, folder):
    rows = [("a", i, "x") for i in range(50)]
    trees = [_tree(spark, rows, f"{folder}/{i}", 2)[1] for i in range(2)]
    assert H.differing_leaves(*trees).isEmpty()
    assert trees[0].nodes(1).agg({"row_count": "sum"}).first()[0] == 50
    with pytest.raises(ValueError):
        H.differing_leaves(trees[0], H.HashTree(spark, f"{folder}/x", ["slice"], 3))


def test_depth_grows_with_the_slice():
    assert [H.depth_for(n, 100) for n in (0, 1600, 1601, 10**9, 10**30)] == [1, 1, 2, 6, H.DEEPEST]


# --- chunks ---------------------------------------------------------------------

def _skewed(spark, seed):
    draw = random.Random(seed)
    rows = []
    for i in range(6000):
        share = draw.random()
        key = 500 if share < 0.3 else None if share < 0.4 else 777 if share < 0.5 else draw.randrange(1000)
        rows.append((key, None if draw.random() < 0.01 else draw.randrange(10**6)))
    return spark.createDataFrame(rows, "k int, s long").coalesce(3)


@pytest.mark.parametrize("by", ["frame", "statements"])
@pytest.mark.parametrize("chunk_rows", [100, 250, 1000, 10_000])
def test_chunks_are_disjoint_whole_and_even(spark, by, chunk_rows):
    rows = _skewed(spark, chunk_rows)
    if by == "frame":
        stats = C.frame_statistics(rows, "k", "s", chunk_rows)
    else:
        rows.createOrReplaceTempView("skewed_keys")
        stats = C.database_statistics(spark.sql, "skewed_keys", "k", "s", chunk_rows)
    predicates = C.chunk_predicates(stats, "k", "s", chunk_rows)
    sizes = [rows.where(p).count() for p in predicates] if len(predicates) < 12 else None
    total, found = rows.count(), C.chunk_of(rows, predicates)
    hits = " + ".join(f"coalesce(cast(({p}) AS int), 0)" for p in predicates)
    assert rows.where(f"({hits}) = 1").count() == total
    counts = [r["count"] for r in found.groupBy("chunk").count().collect()]
    assert sum(counts) == total and max(counts) <= 2 * total / len(predicates)
    assert sizes is None or sorted(sizes) == sorted(counts)


def test_chunks_of_nothing_of_one_value_and_of_nulls(spark):
    for rows, expected in (([], 1), ([(1, None)] * 50, 1), ([(None, i) for i in range(50)], 5),
                           ([(1, i) for i in range(50)], 5)):
        frame = spark.createDataFrame(rows, "k int, s int")
        predicates = C.chunk_predicates(C.frame_statistics(frame, "k", "s", 10), "k", "s", 10)
        assert len(predicates) == pytest.approx(expected, abs=1)
        assert sum(frame.where(p).count() for p in predicates) == len(rows)
    with pytest.raises(ValueError):
        C.chunk_predicates(C.Statistics(1, 0, [1], {}, {}), "k", "s", 0)


def test_chunks_by_moments(spark):
    frame = spark.sql("SELECT timestamp_ntz'2024-01-01' + make_interval(0,0,0,0,id div 3) AS t, id FROM range(300)")
    predicates = C.chunk_predicates(C.frame_statistics(frame, "t", "id", 30), "t", "id", 30)
    counts = [frame.where(p).count() for p in predicates]
    assert sum(counts) == 300 and max(counts) <= 2 * 300 / len(counts)


# --- late rows ---------------------------------------------------------------------

EVENTS = "id long, day timestamp_ntz, v string"


def _dated(ids, day=(2024, 5, 1), v="a"):
    return [(i, datetime(*day), v) for i in ids]


@pytest.mark.parametrize("partition_by", [None, "v"])
@pytest.mark.parametrize("window", [{}, {"date_column": "day", "mutable_months": 1}])
def test_late_rows_are_appended_from_the_ranges_that_grew(spark, folder, partition_by, window):
    target = VersionedTable(spark, f"{folder}/t", partition_by=partition_by)
    store = FingerprintStore(spark, f"{folder}/f")

    def sync(rows):
        stats = run_incremental_sync(
            spark.createDataFrame(rows, EVENTS), target, store, country="x", table_name="t", key="id",
            as_of=datetime(2024, 7, 31), range_keys=10, **window)
        assert sorted(map(tuple, target.read().select("id", "day", "v").collect())) == sorted(rows)
        return stats

    rows = _dated(range(-20, 100, 2)) + _dated([200], (2024, 7, 20))
    sync(rows)
    stats = sync(rows)
    assert (stats.mode, stats.ranges_read, stats.rows_late) == ("nothing", 0, 0)
    rows += _dated([-11, 31, 33, 171], v="late") + _dated([300])
    stats = sync(rows)
    assert (stats.ranges_read, stats.rows_late) == (3, 4)
    if window:
        rows += _dated([55], v="late") + _dated([57], (2024, 7, 21), "late, in window")
        stats = sync(rows)
        assert (stats.mode, stats.ranges_read, stats.rows_late) == ("window", 1, 1)
    assert sync(rows).mode == "nothing"


def test_a_deleted_or_uncounted_row_brings_nothing_back(spark, folder):
    target, store = VersionedTable(spark, f"{folder}/t"), FingerprintStore(spark, f"{folder}/f")

    def sync(ids, **options):
        return run_incremental_sync(spark.createDataFrame(_dated(ids), EVENTS), target, store, country="x",
                                    table_name="t", key="id", **options)

    sync(range(30))
    stats = sync([*range(20), 25, 31], range_keys=10)  # never counted: looked at whole, once
    assert (stats.ranges_read, stats.rows_late, stats.rows_new) == (3, 0, 1)
    stats = sync([*range(15), 25, 31], range_keys=10)  # gone from the source: stays
    assert (stats.mode, stats.ranges_read, stats.rows_late) == ("nothing", 1, 0)
    assert target.read().count() == 31


# --- bitmaps -------------------------------------------------------------------------

def test_bitmaps_add_up_to_exact_counts(spark):
    draw = random.Random(1)
    rows = [(draw.randrange(6), draw.choice([None, draw.randrange(-70_000, 10**6), 3])) for _ in range(3000)]
    months = key_bitmaps(spark.createDataFrame(rows, "m int, k long"), ["m"], "k")
    got = {r["h"]: r["n"] for r in distinct_counts(months.selectExpr("m div 3 AS h", "*"), ["h"], "n").collect()}
    assert got == {h: len({k for m, k in rows if m // 3 == h and k is not None}) for h in (0, 1)}
    with pytest.raises(ValueError):
        key_bitmaps(spark.createDataFrame([("a",)], "k string"), [], "k")


def test_a_profile_copies_no_rows(spark, sf_dir):
    assert "Expand" not in plan_of(QUERIES["agg7_table_profile"](spark, sf_dir))
    assert "Expand" not in plan_of(QUERIES["agg8_profile_with_flags"](spark, sf_dir))


# --- pages ---------------------------------------------------------------------------

@pytest.mark.parametrize("descending", [(), ("a",), ("a", "b")])
@pytest.mark.parametrize("range_rows", [1, 30])
def test_pages_at_any_depth(spark, folder, descending, range_rows):
    draw = random.Random(range_rows)
    rows = [(None if draw.random() < 0.1 else 5 if draw.random() < 0.4 else draw.randrange(-50, 50),
             draw.choice([None, 1, 2, 3]), i) for i in range(400)]
    spark.createDataFrame(rows, "a int, b int, c long").write.parquet(folder)
    frame = spark.read.parquet(folder)

    def place(row):
        nulls_first = [(0, 0) if v is None else (1, v) for v in row]
        return [(-n, -v) if name in descending else (n, v) for name, (n, v) in zip("abc", nulls_first)]

    expected = sorted(rows, key=place)
    for offset in (37, 180, 395, 400):
        got = page_at(frame, ["a", "b", "c"], 25, offset, descending, range_rows, cells=8)
        assert [tuple(r) for r in got.collect()] == expected[offset:offset + 25]


def test_a_deep_page_sorts_one_range(spark, sf_dir, folder):
    spark.range(50_000).selectExpr("id AS a").write.parquet(folder)
    found = page_at(spark.read.parquet(folder), ["a"], 10, 40_000, range_rows=100)
    plan = plan_of(found)
    low, high = (
        choose(int(text.split(")")[0]) for text in plan.split(f"{bound}ThanOrEqual(a,")[1:])
        for choose, bound in ((min, "Greater"), (max, "Less")))
    assert low <= 40_000 and high >= 40_009 and high - low < 150
    assert [r[0] for r in found.collect()] == list(range(40_000, 40_010))
    text = spark.createDataFrame([("b",), ("a",), ("c",)], "a string")
    assert [r[0] for r in page_at(text, ["a"], 1, 1).collect()] == ["b"]
    with pytest.raises(ValueError):
        page_at(text, ["a"], 0)


def test_pages_one_after_the_other(spark):
    rows = [(i // 7, i) for i in range(50)]
    frame, order, seen, last = spark.createDataFrame(rows, "a int, b int"), ["a", "b"], [], None
    while True:
        found = (page_after(frame, order, last, 8, ("a",)) if last
                 else page_at(frame, order, 8, 0, ("a",))).collect()
        if not found:
            break
        seen += map(tuple, found)
        last = tuple(found[-1])
    assert seen == sorted(rows, key=lambda r: (-r[0], r[1]))
    with pytest.raises(ValueError):
        page_after(frame, order, (1, None), 8)
