"""The warehouse questions users ask: filters, star joins, aggregates, top-k, anti joins, series.

Dates are compared as ranges so they reach the Parquet scan, sums are taken on decimals so the result does
not depend on partition order, and top-k reports aggregate first and join names last.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkassay.operators.relational import not_in, years
from sparkassay.plans.registry import query

AS_OF = dt.datetime(2001, 8, 1)


def ts(y: int, m: int = 1, d: int = 1) -> Column:
    return F.lit(dt.datetime(y, m, d)).cast("timestamp_ntz")


def revenue() -> Column:
    return (F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("decimal(18,4)")


def money(c: Column) -> Column:
    return F.round(c, 2).cast("double")


# Lines that one task of a join by order holds, on average.
LINES_PER_TASK = 1 << 18

REV = "CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4))"
MONEY_REV = f"CAST(round(sum({REV}), 2) AS DOUBLE)"


def done_orders(wh, *cols: str) -> DataFrame:
    return wh.orders.filter(F.col("o_orderstatus") == "F").select("o_orderkey", *cols)


def done_lines(wh, *cols: str) -> DataFrame:
    """Lines of completed orders."""
    return wh.lineitem.join(done_orders(wh, *cols), F.col("l_orderkey") == F.col("o_orderkey"))


@query("q_count", "SELECT count(*) AS total_customers FROM customer")
def q_count(wh):
    return wh.customer.agg(F.count("*").alias("total_customers"))


@query("q_distinct", "SELECT DISTINCT p_brand FROM part ORDER BY p_brand")
def q_distinct(wh):
    return wh.part.select("p_brand").distinct().orderBy("p_brand")


@query("q_top1", "SELECT p_partkey, p_name, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 1")
def q_top1(wh):
    return (wh.part.select("p_partkey", "p_name", "p_retailprice")
            .orderBy(F.desc("p_retailprice"), "p_partkey").limit(1))


@query("q_filter_count", "SELECT count(*) AS cancelled_orders FROM orders WHERE o_orderstatus = 'P'")
def q_filter_count(wh):
    return wh.orders.filter(F.col("o_orderstatus") == "P").agg(F.count("*").alias("cancelled_orders"))


@query("q_filter_sort", """
SELECT c_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_name = 'NATION_3' ORDER BY c_name""")
def q_filter_sort(wh):
    nation = wh.nation.filter(F.col("n_name") == "NATION_3").select("n_nationkey")
    return (wh.customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
            .select("c_name").orderBy("c_name"))


@query("q_join_agg", f"""
SELECT {MONEY_REV} AS total_revenue FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F'""")
def q_join_agg(wh):
    return done_lines(wh).agg(money(F.sum(revenue())).alias("total_revenue"))


@query("q_group_count", """
SELECT c_name, count(o_orderkey) AS order_count FROM customer JOIN orders ON o_custkey = c_custkey
GROUP BY c_name ORDER BY order_count DESC, c_name""")
def q_group_count(wh):
    counts = wh.orders.groupBy("o_custkey").agg(F.count("*").alias("order_count"))
    return (wh.customer.join(counts, F.col("c_custkey") == F.col("o_custkey"))
            .groupBy("c_name").agg(F.sum("order_count").alias("order_count"))
            .orderBy(F.desc("order_count"), "c_name"))


@query("q_nested_avg", f"""
SELECT CAST(round(CAST(sum(t) AS DOUBLE) / count(*), 2) AS DOUBLE) AS avg_order_value
FROM (SELECT o_orderkey, sum({REV}) AS t FROM orders JOIN lineitem ON l_orderkey = o_orderkey
      WHERE o_orderstatus = 'F' GROUP BY o_orderkey)""")
def q_nested_avg(wh):
    per_order = done_lines(wh).groupBy("l_orderkey").agg(F.sum(revenue()).alias("t"))
    return (per_order.agg(F.round(F.sum("t").cast("double") / F.count("*"), 2).alias("avg_order_value")))


@query("q_join3_top", f"""
SELECT p_brand, {MONEY_REV} AS revenue
FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey
WHERE o_orderstatus = 'F' GROUP BY p_brand ORDER BY revenue DESC, p_brand LIMIT 1""")
def q_join3_top(wh):
    by_part = done_lines(wh).groupBy("l_partkey").agg(F.sum(revenue()).alias("r"))
    return (by_part.join(wh.part.select("p_partkey", "p_brand"), F.col("p_partkey") == F.col("l_partkey"))
            .groupBy("p_brand").agg(money(F.sum("r")).alias("revenue"))
            .orderBy(F.desc("revenue"), "p_brand").limit(1))


FIRST_ORDER = "SELECT o_custkey, min(o_orderdate) AS signup FROM orders GROUP BY o_custkey"


@query("q_year_filter", f"""
SELECT c_name, strftime(signup, '%Y-%m-%d') AS signup_date FROM customer JOIN ({FIRST_ORDER}) ON o_custkey = c_custkey
WHERE year(signup) = 1996 ORDER BY signup, c_name""")
def q_year_filter(wh):
    first = wh.orders.groupBy("o_custkey").agg(F.min("o_orderdate").alias("signup")).filter(years("signup", 1996))
    return (wh.customer.join(first, F.col("c_custkey") == F.col("o_custkey"))
            .orderBy("signup", "c_name")
            .select("c_name", F.date_format("signup", "yyyy-MM-dd").alias("signup_date")))


@query("q_topk_spend", f"""
SELECT c_name, {MONEY_REV} AS total_spend FROM customer JOIN orders ON o_custkey = c_custkey
JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F'
GROUP BY c_custkey, c_name ORDER BY total_spend DESC, c_custkey LIMIT 3""")
def q_topk_spend(wh):
    top = (done_lines(wh, "o_custkey").groupBy("o_custkey").agg(money(F.sum(revenue())).alias("total_spend"))
           .orderBy(F.desc("total_spend"), "o_custkey").limit(3))
    return (wh.customer.select("c_custkey", "c_name")
            .join(F.broadcast(top), F.col("c_custkey") == F.col("o_custkey"))  # three rows by construction
            .orderBy(F.desc("total_spend"), "c_custkey").select("c_name", "total_spend"))


@query("q_anti_not_in", """
SELECT c_name FROM customer
WHERE c_custkey NOT IN (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'F') ORDER BY c_name""")
def q_anti_not_in(wh):
    done = wh.orders.filter(F.col("o_orderstatus") == "F")
    return not_in(wh.customer, "c_custkey", done, "o_custkey").select("c_name").orderBy("c_name")


@query("q_month_series", f"""
SELECT CAST(month(o_orderdate) AS BIGINT) AS month, {MONEY_REV} AS revenue
FROM orders JOIN lineitem ON l_orderkey = o_orderkey
WHERE o_orderstatus = 'F' AND year(o_orderdate) = 1998 GROUP BY 1 ORDER BY 1""")
def q_month_series(wh):
    orders = done_orders(wh, "o_orderdate").filter(years("o_orderdate", 1998))
    return (wh.lineitem.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
            .groupBy(F.month("o_orderdate").cast("long").alias("month"))
            .agg(money(F.sum(revenue())).alias("revenue")).orderBy("month"))


@query("q_left_join_on_filter", """
SELECT n_name, count(DISTINCT c_custkey) AS customer_count, count(o_orderkey) AS completed_orders
FROM customer JOIN nation ON n_nationkey = c_nationkey
LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'F' AND o_totalprice > 480000
GROUP BY n_name ORDER BY completed_orders DESC, n_name""")
def q_left_join_on_filter(wh):
    per_customer = (wh.orders.filter((F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 480000))
                    .groupBy("o_custkey").agg(F.count("*").alias("n")))
    return (wh.customer.join(per_customer, F.col("c_custkey") == F.col("o_custkey"), "left")
            .groupBy("c_nationkey")
            .agg(F.count_distinct("c_custkey").alias("customer_count"),
                 F.coalesce(F.sum("n"), F.lit(0)).alias("completed_orders"))
            .join(wh.nation, F.col("n_nationkey") == F.col("c_nationkey"))
            .groupBy("n_name").agg(F.sum("customer_count").alias("customer_count"),
                                   F.sum("completed_orders").alias("completed_orders"))
            .orderBy(F.desc("completed_orders"), "n_name"))


@query("q_having", f"""
SELECT c_name, count(o_orderkey) AS order_count,
       round(CAST(sum(t) AS DOUBLE) / count(*), 2) AS avg_order_value
FROM customer JOIN orders ON o_custkey = c_custkey
JOIN (SELECT l_orderkey, sum({REV}) AS t FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey
GROUP BY c_name HAVING count(o_orderkey) > 12 ORDER BY order_count DESC, c_name""")
def q_having(wh):
    totals = wh.lineitem.groupBy("l_orderkey").agg(F.sum(revenue()).alias("t"))
    per_customer = (totals.join(wh.orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
                    .groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum("t").alias("t")))
    return (per_customer.join(wh.customer.select("c_custkey", "c_name"), F.col("c_custkey") == F.col("o_custkey"))
            .groupBy("c_name").agg(F.sum("n").alias("order_count"),
                                   F.round(F.sum("t").cast("double") / F.sum("n"), 2).alias("avg_order_value"))
            .filter(F.col("order_count") > 12).orderBy(F.desc("order_count"), "c_name"))


@query("q_left_is_null", """
SELECT c_custkey, c_name FROM customer
LEFT JOIN orders ON o_custkey = c_custkey AND o_orderdate >= TIMESTAMP '2000-06-01' WHERE o_orderkey IS NULL""")
def q_left_is_null(wh):
    recent = wh.orders.filter(F.col("o_orderdate") >= ts(2000, 6))
    return (wh.customer.select("c_custkey", "c_name")
            .join(recent, F.col("c_custkey") == F.col("o_custkey"), "left_anti"))


@query("q_date_window", """
SELECT c_custkey, c_name,
  strftime(date_trunc('year', TIMESTAMP '2001-08-01') - INTERVAL 1 YEAR, '%Y-%m-%d') AS since
FROM customer LEFT JOIN orders
  ON o_custkey = c_custkey AND o_orderdate >= date_trunc('year', TIMESTAMP '2001-08-01') - INTERVAL 1 YEAR
WHERE o_orderkey IS NULL""")
def q_date_window(wh, as_of: dt.datetime = AS_OF):
    since = F.date_trunc("year", F.lit(as_of)).cast("timestamp_ntz") - F.expr("INTERVAL 1 YEAR")
    recent = wh.orders.filter(F.col("o_orderdate") >= since)
    return (wh.customer.join(recent, F.col("c_custkey") == F.col("o_custkey"), "left_anti")
            .select("c_custkey", "c_name", F.date_format(since, "yyyy-MM-dd").alias("since")))


@query("q_quarter_avg", f"""
SELECT round(CAST(sum({REV}) AS DOUBLE) / count(*), 2) AS avg_order_value
FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F'
AND o_orderdate >= date_trunc('quarter', TIMESTAMP '2001-08-01') - INTERVAL 3 MONTH""")
def q_quarter_avg(wh, as_of: dt.datetime = AS_OF):
    since = F.date_trunc("quarter", F.lit(as_of)).cast("timestamp_ntz") - F.expr("INTERVAL 3 MONTH")
    recent = done_orders(wh, "o_orderdate").filter(F.col("o_orderdate") >= since)
    return (wh.lineitem.join(recent, F.col("l_orderkey") == F.col("o_orderkey"))
            .agg(F.round(F.sum(revenue()).cast("double") / F.count("*"), 2).alias("avg_order_value")))


@query("q_between", f"""
SELECT {MONEY_REV} AS total_spent FROM orders JOIN customer ON o_custkey = c_custkey
JOIN nation ON n_nationkey = c_nationkey JOIN lineitem ON l_orderkey = o_orderkey
WHERE n_name = 'NATION_7' AND o_orderstatus = 'F'
AND o_orderdate BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1997-12-31'""")
def q_between(wh):
    nation = wh.nation.filter(F.col("n_name") == "NATION_7").select("n_nationkey")
    buyers = wh.customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey")
    orders = (done_orders(wh, "o_custkey", "o_orderdate")
              .filter(F.col("o_orderdate").between(ts(1997), ts(1997, 12, 31)))
              .join(buyers, F.col("o_custkey") == F.col("c_custkey"), "left_semi"))
    return (wh.lineitem.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
            .agg(money(F.sum(revenue())).alias("total_spent")))


@query("q_4way_category", f"""
SELECT p_type, {MONEY_REV} AS total_revenue FROM customer JOIN nation ON n_nationkey = c_nationkey
JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey
WHERE n_name = 'NATION_1' AND o_orderstatus = 'F' GROUP BY p_type""")
def q_4way_category(wh):
    nation = wh.nation.filter(F.col("n_name") == "NATION_1").select("n_nationkey")
    buyers = wh.customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey")
    orders = done_orders(wh, "o_custkey").join(buyers, F.col("o_custkey") == F.col("c_custkey"), "left_semi")
    by_part = (wh.lineitem.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
               .groupBy("l_partkey").agg(F.sum(revenue()).alias("r")))
    return (by_part.join(wh.part.select("p_partkey", "p_type"), F.col("p_partkey") == F.col("l_partkey"))
            .groupBy("p_type").agg(money(F.sum("r")).alias("total_revenue")))


@query("q_multi_agg", f"""
SELECT p_brand, {MONEY_REV} AS total_sales, count(DISTINCT o_orderkey) AS total_orders
FROM part JOIN lineitem ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey GROUP BY p_brand""")
def q_multi_agg(wh):
    # An order's lines meet in one task, so its brands are told apart there and their distinct orders are a plain count.
    # The number of parts follows the lines, so that the lines of a task do not grow with the table.
    parts = max(1, -(-wh.lineitem.count() // LINES_PER_TASK))
    orders = wh.orders.select("o_orderkey").repartition(parts, "o_orderkey").groupBy("o_orderkey").agg(F.count("*").alias("n"))
    lines = wh.lineitem.join(wh.part.select("p_partkey", "p_brand"), F.col("p_partkey") == F.col("l_partkey"))
    lines = lines.select("l_orderkey", "p_brand", revenue().alias("r")).repartition(parts, "l_orderkey")
    per_order = lines.groupBy("l_orderkey", "p_brand").agg(F.sum("r").alias("r"))
    # Each row of an order that repeats its key meets every line again.
    return (per_order.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
            .groupBy("p_brand").agg(money(F.sum(F.col("r") * F.col("n"))).alias("total_sales"), F.count("*").alias("total_orders")))


@query("q_two_left_or_null", """
SELECT DISTINCT p_partkey, p_name FROM part LEFT JOIN lineitem ON p_partkey = l_partkey
LEFT JOIN orders ON l_orderkey = o_orderkey AND o_orderstatus = 'F'
WHERE o_orderdate < TIMESTAMP '1995-03-01' OR o_orderkey IS NULL""")
def q_two_left_or_null(wh):
    # Only "some line qualifies" matters per part, so each join is reduced to one flag before parts are read.
    lines = wh.lineitem.select("l_partkey", "l_orderkey")
    orders = done_orders(wh, "o_orderdate")
    per_part = (lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "left")
                .groupBy("l_partkey")
                .agg(F.bool_or((F.col("o_orderdate") < ts(1995, 3)) | F.col("o_orderkey").isNull()).alias("hit")))
    return (wh.part.select("p_partkey", "p_name")
            .join(per_part, F.col("p_partkey") == F.col("l_partkey"), "left")
            .filter(F.coalesce("hit", F.lit(True))).select("p_partkey", "p_name").distinct())


@query("q_scalar_subquery", """
SELECT p_partkey, p_name, p_retailprice FROM part WHERE p_retailprice = (SELECT max(p_retailprice) FROM part)""")
def q_scalar_subquery(wh):
    best = wh.part.agg(F.max("p_retailprice")).scalar()
    return wh.part.filter(F.col("p_retailprice") == best).select("p_partkey", "p_name", "p_retailprice")


@query("q_cte", f"""
WITH revenue AS (SELECT l_orderkey, sum({REV}) AS total FROM lineitem GROUP BY l_orderkey)
SELECT o_orderpriority, count(*) AS n_orders, CAST(round(sum(total), 2) AS DOUBLE) AS total
FROM revenue JOIN orders ON o_orderkey = l_orderkey GROUP BY o_orderpriority""")
def q_cte(wh):
    per_order = wh.lineitem.groupBy("l_orderkey").agg(F.sum(revenue()).alias("total"))
    return (per_order.join(wh.orders.select("o_orderkey", "o_orderpriority"), F.col("l_orderkey") == F.col("o_orderkey"))
            .groupBy("o_orderpriority").agg(F.count("*").alias("n_orders"), money(F.sum("total")).alias("total")))


@query("q_in_subquery", """
SELECT c_custkey, c_name FROM customer
WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 490000)""")
def q_in_subquery(wh):
    big = wh.orders.filter(F.col("o_totalprice") > 490000)
    return (wh.customer.select("c_custkey", "c_name")
            .join(big, F.col("c_custkey") == F.col("o_custkey"), "left_semi"))


@query("q_union", """
SELECT c_nationkey AS nationkey FROM customer UNION SELECT s_nationkey AS nationkey FROM supplier""")
def q_union(wh):
    return (wh.customer.select(F.col("c_nationkey").alias("nationkey"))
            .union(wh.supplier.select("s_nationkey")).distinct())


@query("q_qty_rank", f"""
SELECT p_partkey, p_name, CAST(sum(CAST(l_quantity AS DECIMAL(12,2))) AS DOUBLE) AS total_quantity,
  {MONEY_REV} AS total_revenue
FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY p_partkey, p_name
ORDER BY total_quantity DESC, p_partkey LIMIT 10""")
def q_qty_rank(wh):
    top = (wh.lineitem.groupBy("l_partkey")
           .agg(F.sum(F.col("l_quantity").cast("decimal(12,2)")).cast("double").alias("total_quantity"),
                money(F.sum(revenue())).alias("total_revenue"))
           .orderBy(F.desc("total_quantity"), "l_partkey").limit(10))
    return (wh.part.select("p_partkey", "p_name")
            .join(F.broadcast(top), F.col("p_partkey") == F.col("l_partkey"))  # ten rows by construction
            .select("p_partkey", "p_name", "total_quantity", "total_revenue"))


@query("q_avg_line", f"""
SELECT n_name, round(CAST(sum({REV}) AS DOUBLE) / count(*), 2) AS avg_order_value FROM customer
JOIN nation ON n_nationkey = c_nationkey JOIN orders ON o_custkey = c_custkey
JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F' GROUP BY n_name""")
def q_avg_line(wh):
    per_customer = (done_lines(wh, "o_custkey").groupBy("o_custkey")
                    .agg(F.sum(revenue()).alias("r"), F.count("*").alias("n")))
    return (per_customer.join(wh.customer.select("c_custkey", "c_nationkey"), F.col("c_custkey") == F.col("o_custkey"))
            .join(wh.nation, F.col("n_nationkey") == F.col("c_nationkey")).groupBy("n_name")
            .agg(F.round(F.sum("r").cast("double") / F.sum("n"), 2).alias("avg_order_value")))


@query("q_status_distribution", """
SELECT o_orderstatus, count(o_orderkey) AS status_count FROM orders JOIN customer ON o_custkey = c_custkey
JOIN nation ON n_nationkey = c_nationkey WHERE n_name = 'NATION_5' GROUP BY o_orderstatus""")
def q_status_distribution(wh):
    nation = wh.nation.filter(F.col("n_name") == "NATION_5").select("n_nationkey")
    buyers = wh.customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey")
    return (wh.orders.join(buyers, F.col("o_custkey") == F.col("c_custkey"), "left_semi")
            .groupBy("o_orderstatus").agg(F.count("*").alias("status_count")))
