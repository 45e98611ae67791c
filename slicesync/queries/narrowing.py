"""Reading less: hash trees, covers of keys, balanced chunks, pages at any depth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slicesync.operators import chunks as C
from slicesync.operators import hash_tree as H
from slicesync.operators.intervals import keep_keys
from slicesync.queries.registry import query
from slicesync.queries.shared import PURCHASE_COLUMNS, SCALE, prints_sql, purchases, table
from slicesync.session import run_dir, stage

# --- one large slice, few changed rows --------------------------------------

DEPTH, KEY, HOT = 3, ["l_orderkey", "l_linenumber"], 0
PORTABLE = {"method": "md5", "scale": SCALE}


def _with_hot_slice(spark, sf_dir) -> DataFrame:
    """Purchases of which about 30 % lie in one slice that has no level below it."""
    hot = F.col("l_suppkey") % 10 < 3
    return purchases(spark, sf_dir).withColumn(
        "slice", F.when(hot, F.lit(HOT)).otherwise(F.col("l_suppkey")).cast("long"))


def _before(now: DataFrame) -> DataFrame:
    """As it was when the hot slice's newest order had one piece less."""
    newest = now.where(F.col("slice") == HOT).agg(F.max("l_orderkey")).scalar()
    corrected = (F.col("slice") == HOT) & (F.col("l_orderkey") == newest)
    return now.withColumn(
        "l_quantity", F.when(corrected, F.col("l_quantity") - 1).otherwise(F.col("l_quantity")))


def _narrowed(spark, sf_dir):
    """Both states laid out by place, and the leaves in which they differ."""
    now = _with_hot_slice(spark, sf_dir)
    states, trees = [], []
    for label, rows in (("now", now), ("before", _before(now))):
        placed = H.by_place(rows, run_dir(spark, f"placed-{label}"), ["slice"], KEY, DEPTH, **PORTABLE)
        states.append(placed)
        trees.append(H.HashTree.build(
            placed, run_dir(spark, f"tree-{label}"), ["slice"], KEY, DEPTH, columns=now.columns, placed=True,
            **PORTABLE))
    return states, H.differing_leaves(*trees)


_KEY_TEXT = " || ".join(f"length({name}::VARCHAR) || ':' || {name}::VARCHAR" for name in KEY)
TREE_CTE = f"""
now AS (
  SELECT *, (year(l_shipdate) * 100 + month(l_shipdate))::INT AS period,
         CASE WHEN l_suppkey % 10 < 3 THEN {HOT} ELSE l_suppkey END::BIGINT AS slice,
         ('0x' || substr(md5({_KEY_TEXT}), 1, {DEPTH}))::BIGINT AS node FROM lineitem
),
before AS (
  SELECT * REPLACE (CASE WHEN slice = {HOT} AND l_orderkey = (SELECT max(l_orderkey) FROM now WHERE slice = {HOT})
                         THEN l_quantity - 1 ELSE l_quantity END AS l_quantity) FROM now
)"""


@query(
    "dif_tree_leaves",
    f"""
    WITH {TREE_CTE},
    n AS ({prints_sql('now', 'slice, node', PURCHASE_COLUMNS + ', slice')}),
    b AS ({prints_sql('before', 'slice, node', PURCHASE_COLUMNS + ', slice')})
    SELECT slice, node, 'changed' AS status, n.row_count, b.row_count AS stored_row_count,
           (SELECT count(*) FROM now WHERE slice = {HOT}) AS slice_rows
    FROM n JOIN b USING (slice, node) WHERE n.checksum_sum <> b.checksum_sum
    """,
)
def dif_tree_leaves(spark, sf_dir):
    """Which leaves of a slice of 30 % of all rows differ."""
    (now, _), leaves = _narrowed(spark, sf_dir)
    size = now.where(F.col("slice") == HOT).agg(F.count(F.lit(1))).scalar()
    return leaves.withColumn("slice_rows", size)


@query(
    "dif_tree_rows",
    f"""
    WITH {TREE_CTE},
    n AS (SELECT {PURCHASE_COLUMNS}, slice, count(*) AS c FROM now GROUP BY ALL),
    b AS (SELECT {PURCHASE_COLUMNS}, slice, count(*) AS c FROM before GROUP BY ALL)
    SELECT {PURCHASE_COLUMNS}, slice, sum(c)::BIGINT AS change
    FROM (SELECT * FROM n UNION ALL SELECT * REPLACE (-c AS c) FROM b)
    GROUP BY ALL HAVING sum(c) <> 0
    """,
)
def dif_tree_rows(spark, sf_dir):
    """The rows that differ; of the slice only the leaves that differ are read."""
    states, leaves = _narrowed(spark, sf_dir)
    columns = [name for name in states[0].columns if name != H.PLACE]
    return H.differing_rows(*[H.rows_of_leaves(rows, ["slice"], leaves) for rows in states], columns)


# --- slice keys that prune the scan ------------------------------------------

@query(
    "join_keys_by_ranges",
    """
    SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem
    WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_totalprice >= 499000 OR o_custkey <= 3)
    """,
)
def join_keys_by_ranges(spark, sf_dir):
    """Lines of some orders: intervals of their keys for the scan, then the keys themselves."""
    wanted = (F.col("o_totalprice") >= 499_000) | (F.col("o_custkey") <= 3)
    keys = stage(table(spark, sf_dir, "orders").where(wanted).select("o_orderkey"), "keys")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    return keep_keys(lines, "l_orderkey", keys, "o_orderkey")


# --- chunks of a skewed key ----------------------------------------------------

@query(
    "src7_balanced_chunks",
    f"""
    WITH k AS (SELECT CASE WHEN l_suppkey % 10 < 3 THEN {HOT} WHEN l_suppkey % 10 = 9 THEN NULL
                      ELSE l_suppkey END AS code FROM lineitem)
    SELECT code, count(*) AS row_count, count(*) AS rows_in_one_chunk,
           true AS none_over_twice_the_mean FROM k GROUP BY 1
    """,
)
def src7_balanced(spark, sf_dir):
    """A scan in 24 chunks of a key of which one value holds 30 % of all rows, and NULL 10 %."""
    code = F.col("l_suppkey") % 10
    lines = table(spark, sf_dir, "lineitem").select(
        F.when(code < 3, F.lit(HOT)).when(code < 9, F.col("l_suppkey")).cast("long").alias("code"),
        "l_orderkey")
    chunk_rows = -(-lines.count() // 24)
    predicates = C.chunk_predicates(
        C.frame_statistics(lines, "code", "l_orderkey", chunk_rows), "code", "l_orderkey", chunk_rows)
    hits = sum((F.coalesce(F.expr(p), F.lit(False)).cast("int") for p in predicates), F.lit(0))
    counted = stage(C.chunk_of(lines.withColumn("hits", hits), predicates).groupBy("code", "chunk").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("hits") == 1).alias("once")), "chunks")
    sizes = counted.groupBy("chunk").agg(F.sum("n").alias("n"))
    even = sizes.agg((F.max("n") <= 2 * F.avg("n")).alias("even")).scalar()
    return counted.groupBy("code").agg(
        F.sum("n").alias("row_count"), F.sum("once").alias("rows_in_one_chunk"),
    ).withColumn("none_over_twice_the_mean", even)
