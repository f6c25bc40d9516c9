"""Relational breadth over the star schema: joins, grouping sets, set operations, windows, near-copies of statements."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from memoria.operators.similar import similar_statements
from memoria.plans.registry import Tables, query


@query("""
SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS mean_discount, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus
""")
def pricing_summary(t: Tables) -> DataFrame:
    """One pass of partial aggregates over line items."""
    x = t.lineitem.filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return x.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"),
        F.round(F.avg("l_discount"), 6).alias("mean_discount"), F.count(F.lit(1)).alias("n"),
    )


@query("""
SELECT o_orderkey, o_orderdate, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
WHERE c_mktsegment = 'BUILDING' GROUP BY o_orderkey, o_orderdate ORDER BY revenue DESC, o_orderkey LIMIT 10
""")
def shipping_priority(t: Tables) -> DataFrame:
    """The ten open orders of most worth in a segment."""
    c = t.customer.filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    o = t.orders.join(c, "o_custkey").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    x = t.lineitem.join(o, "l_orderkey").groupBy(F.col("l_orderkey").alias("o_orderkey"), "o_orderdate").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))
    return x.orderBy(F.desc("revenue"), "o_orderkey").limit(10)


@query("""
SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM region JOIN nation ON n_regionkey = r_regionkey JOIN supplier ON s_nationkey = n_nationkey
JOIN lineitem ON l_suppkey = s_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey AND c_nationkey = s_nationkey GROUP BY n_name
""")
def local_suppliers(t: Tables) -> DataFrame:
    """Revenue of each nation's suppliers with customers of the same nation."""
    n = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name")
    s = t.supplier.join(n, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "s_nationkey", "n_name")
    co = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_nationkey")
    x = t.lineitem.join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(co, (F.col("l_orderkey") == F.col("o_orderkey")) & (F.col("c_nationkey") == F.col("s_nationkey")))
    return x.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("SELECT c_mktsegment, c_nationkey, grouping(c_mktsegment)::INT AS g1, grouping(c_nationkey)::INT AS g2, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer GROUP BY ROLLUP (c_mktsegment, c_nationkey)")
def balance_rollup(t: Tables) -> DataFrame:
    """Balances by segment and nation with all subtotals."""
    x = t.customer.rollup("c_mktsegment", "c_nationkey").agg(F.grouping("c_mktsegment").cast("int").alias("g1"), F.grouping("c_nationkey").cast("int").alias("g2"), F.count(F.lit(1)).alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"))
    return x


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def flag_cube(t: Tables) -> DataFrame:
    """Every combination of two flags."""
    return t.lineitem.cube("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("l_suppkey").alias("suppliers"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")
def order_grouping_sets(t: Tables) -> DataFrame:
    """Two one-way totals and the grand total in one scan."""
    return t.orders.groupingSets([["o_orderstatus"], ["o_orderpriority"], []], "o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_custkey, c_name, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 100000")
def outer_orders(t: Tables) -> DataFrame:
    """All customers with their large orders."""
    big = t.orders.filter("o_totalprice > 100000").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    return t.customer.select("c_custkey", "c_name").join(big, "c_custkey", "left")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def semi_and_anti(t: Tables) -> DataFrame:
    """Customers with orders of one status and none of another."""
    of = lambda status: t.orders.filter(F.col("o_orderstatus") == status).select(F.col("o_custkey").alias("c_custkey"))
    return t.customer.select("c_custkey").join(of("F"), "c_custkey", "left_semi").join(of("P"), "c_custkey", "left_anti")


@query("""
WITH b AS (SELECT i AS band, i * 500 AS low, (i + 1) * 500 AS high FROM range(0, 10) AS r(i))
SELECT band, count(*) AS parts, round(avg(p_size), 4) AS mean_size FROM part JOIN b ON p_retailprice >= low AND p_retailprice < high GROUP BY band
""")
def price_bands(t: Tables) -> DataFrame:
    """A range join over even bands is arithmetic on the band's number."""
    band = F.floor(F.col("p_retailprice") / 500)
    x = t.part.select(band.alias("band"), "p_size").filter(F.col("band").between(0, 9))
    return x.groupBy("band").agg(F.count(F.lit(1)).alias("parts"), F.round(F.avg("p_size"), 4).alias("mean_size"))


@query("""
SELECT s_suppkey, s_nationkey, rank() OVER w::BIGINT AS r, dense_rank() OVER w::BIGINT AS d, round(percent_rank() OVER w, 6) AS p, round(cume_dist() OVER w, 6) AS c, ntile(4) OVER w::BIGINT AS quarter,
  nth_value(s_suppkey, 2) OVER (PARTITION BY s_nationkey ORDER BY s_acctbal, s_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second
FROM supplier WINDOW w AS (PARTITION BY s_nationkey ORDER BY s_acctbal, s_suppkey)
""".replace("rank() OVER w::BIGINT", "(rank() OVER w)::BIGINT").replace("dense_(rank() OVER w)::BIGINT", "(dense_rank() OVER w)::BIGINT").replace("ntile(4) OVER w::BIGINT", "(ntile(4) OVER w)::BIGINT"))
def ranking_windows(t: Tables) -> DataFrame:
    """All ranking functions over one sort."""
    w = Window.partitionBy("s_nationkey").orderBy("s_acctbal", "s_suppkey")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return t.supplier.select(
        "s_suppkey", "s_nationkey", F.rank().over(w).cast("bigint").alias("r"), F.dense_rank().over(w).cast("bigint").alias("d"), F.round(F.percent_rank().over(w), 6).alias("p"),
        F.round(F.cume_dist().over(w), 6).alias("c"), F.ntile(4).over(w).cast("bigint").alias("quarter"), F.nth_value("s_suppkey", 2).over(whole).alias("second"),
    )


@query("""
SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS running,
  round(avg(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 4) AS around FROM orders
""")
def frame_windows(t: Tables) -> DataFrame:
    """Running total and centred mean of each customer's orders."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return t.orders.select("o_orderkey", F.round(F.sum("o_totalprice").over(w.rowsBetween(Window.unboundedPreceding, 0)), 2).alias("running"), F.round(F.avg("o_totalprice").over(w.rowsBetween(-1, 1)), 4).alias("around"))


@query("""
SELECT event_id, json_extract_string(props, '$.k') AS k, (try_cast(json_extract_string(props, '$.k') AS BIGINT) * 2) AS doubled, props IS NOT NULL AND json_valid(props) AS valid FROM events
""")
def json_functions(t: Tables) -> DataFrame:
    """Fields of JSON payloads, null where they can't be read."""
    k = F.get_json_object("props", "$.k")
    return t.events.select("event_id", k.alias("k"), (k.try_cast("bigint") * 2).alias("doubled"), F.try_parse_json("props").isNotNull().alias("valid"))


@query("SELECT md5(text) AS text_md5, count(*) AS copies, min(doc_id) AS first_doc FROM documents GROUP BY 1 HAVING count(*) > 1")
def near_dup_exact(t: Tables) -> DataFrame:
    """Texts that occur more than once."""
    return t.documents.groupBy(F.md5(F.col("text").cast("binary")).alias("text_md5")).agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_doc")).filter("copies > 1")


@query("""
WITH t AS (SELECT text FROM conversations UNION ALL SELECT regexp_replace(text, '\\s+\\S+$', '') FROM conversations WHERE turn = 0),
s AS (SELECT md5(text) AS k, any_value(text) AS text FROM t GROUP BY 1),
w AS (SELECT k, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS words FROM s),
g AS (SELECT DISTINCT k, array_to_string(list_slice(words, i, i + 4), ' ') AS shingle FROM w, unnest(range(1, len(words) - 3)) AS r(i)),
n AS (SELECT k, count(*) AS n FROM g GROUP BY k),
p AS (SELECT a.k AS a, b.k AS b, count(*) AS both_n FROM g a JOIN g b ON a.shingle = b.shingle AND a.k < b.k GROUP BY 1, 2)
SELECT a, b, round(both_n / (x.n + y.n - both_n)::DOUBLE, 6) AS similarity FROM p JOIN n x ON x.k = a JOIN n y ON y.k = b WHERE both_n >= 0.8 * (x.n + y.n - both_n)
""")
def near_dup_statements(t: Tables) -> DataFrame:
    """Pairs of different statements that share four fifths of their five-word shingles; each first turn comes without its last word as well."""
    shorter = t.conversations.filter("turn = 0").select(F.regexp_replace("text", r"\s+\S+$", "").alias("text"))
    return similar_statements(t.conversations.select("text").unionByName(shorter), "text")
