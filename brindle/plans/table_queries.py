"""Joins, aggregates and mutations over the relational tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from brindle.operators import mutations, ranking
from brindle.plans.base import query, table


@query("c_filters", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus IN ('O', 'F') AND o_orderpriority ILIKE '%high%' AND o_totalprice >= 250000.0 AND o_custkey IS NOT NULL")
def c_filters(spark, sf_dir):
    """Predicates that all reach the scan but the pattern."""
    o = table(spark, sf_dir, "orders")
    return o.filter(F.col("o_orderstatus").isin("O", "F") & F.col("o_orderpriority").ilike("%high%") & (F.col("o_totalprice") >= 250000.0) & F.col("o_custkey").isNotNull()).select("o_orderkey", "o_totalprice")


@query("c20_rejected_rows", "SELECT p_partkey, CASE WHEN NOT regexp_matches(p_name, '^[a-z]+ [a-z]+$') THEN 'bad_name' WHEN NOT p_size >= 5 THEN 'too_small' WHEN NOT p_retailprice < 1000.0 THEN 'too_dear' END AS reason FROM part WHERE NOT (regexp_matches(p_name, '^[a-z]+ [a-z]+$') AND p_size >= 5 AND p_retailprice < 1000.0)")
def c20_rejected_rows(spark, sf_dir):
    rules = {"bad_name": F.col("p_name").rlike("^[a-z]+ [a-z]+$"), "too_small": F.col("p_size") >= 5, "too_dear": F.col("p_retailprice") < 1000.0}
    return mutations.rejected(table(spark, sf_dir, "part"), rules).select("p_partkey", "reason")


@query("d1_inner_join", "SELECT n_name, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def d1_inner_join(spark, sf_dir):
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    return c.join(n, c.c_nationkey == n.n_nationkey).groupBy("n_name").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query("d2_nested_children", "SELECT c_custkey, count(o_orderkey) AS n_orders, coalesce(string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey), '') AS orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def d2_nested_children(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    joined = ranking.nested(table(spark, sf_dir, "customer").select("c_custkey"), o, "c_custkey", ["o_orderkey"], "children")
    return joined.select("c_custkey", F.size("children").cast("long").alias("n_orders"), F.array_join(F.transform("children", lambda x: x.o_orderkey.cast("string")), ",").alias("orders"))


@query("d3_bridge_join", "SELECT DISTINCT p_partkey, s_name FROM part JOIN lineitem ON l_partkey = p_partkey JOIN supplier ON s_suppkey = l_suppkey")
def d3_bridge_join(spark, sf_dir):
    """m:n through the line items; the pairs are made distinct before the names come in."""
    pairs = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").distinct()
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name")
    return pairs.join(p, "l_partkey").join(s, "l_suppkey").select(F.col("l_partkey").alias("p_partkey"), "s_name").distinct()


@query("d4_lookup_required", "SELECT o_orderpriority, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1")
def d4_lookup_required(spark, sf_dir):
    """Every line item must have its order: a missing one ends the query."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    found = mutations.required(li, o, ["o_orderkey"], "o_orderkey")
    return found.filter(F.col("o_orderkey").isNotNull()).groupBy("o_orderpriority").agg(F.count("*").alias("n"))


@query("d6_anti_join", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_totalprice > 300000.0)")
def d6_anti_join(spark, sf_dir):
    """Customers without a large order."""
    large = table(spark, sf_dir, "orders").filter("o_totalprice > 300000.0").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(large, "c_custkey", "left_anti")


@query("d7_semi_filter", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')")
def d7_semi_filter(spark, sf_dir):
    c = table(spark, sf_dir, "customer").filter("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, sf_dir, "orders").join(c, "o_custkey", "left_semi").select("o_orderkey")


@query("d14_mismatches", "SELECT l_orderkey, l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE NOT ((o_orderstatus = 'F' AND l_linestatus = 'F') OR (o_orderstatus = 'O' AND l_linestatus = 'O') OR o_orderstatus = 'P')")
def d14_mismatches(spark, sf_dir):
    """Rows whose value is not among those their parent expects."""
    expected = F.when(F.col("o_orderstatus") == "P", F.array(F.lit("O"), F.lit("F"))).otherwise(F.array("o_orderstatus"))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), expected.alias("expected"))
    return table(spark, sf_dir, "lineitem").join(o, "l_orderkey").filter(~F.array_contains("expected", F.col("l_linestatus"))).select("l_orderkey", "l_linenumber")


BATCH = "SELECT c_custkey, c_name || ' (moved)' AS c_name, c_nationkey, 0.0::DOUBLE AS c_acctbal, c_mktsegment FROM customer WHERE c_mktsegment = 'FURNITURE' UNION ALL SELECT s_suppkey + 100000000, s_name, s_nationkey, s_acctbal, 'SUPPLIER' FROM supplier"


def _batch(spark, sf_dir):
    moved = table(spark, sf_dir, "customer").filter("c_mktsegment = 'FURNITURE'").withColumns({"c_name": F.concat("c_name", F.lit(" (moved)")), "c_acctbal": F.lit(0.0)})
    s = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") + 100_000_000).alias("c_custkey"), F.col("s_name").alias("c_name"), F.col("s_nationkey").alias("c_nationkey"), F.col("s_acctbal").alias("c_acctbal"), F.lit("SUPPLIER").alias("c_mktsegment"))
    return moved.unionByName(s)


@query("b5_upsert_snapshot", f"SELECT * FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM ({BATCH})) UNION ALL SELECT * FROM ({BATCH})")
def b5_upsert_snapshot(spark, sf_dir):
    return mutations.upsert(table(spark, sf_dir, "customer"), _batch(spark, sf_dir), ["c_custkey"])


@query("b5_last_writer_wins", "SELECT l_orderkey, max_by(l_partkey, l_linenumber) AS l_partkey, max(l_linenumber) AS l_linenumber FROM lineitem GROUP BY l_orderkey HAVING count(*) = count(DISTINCT l_linenumber)")
def b5_last_writer_wins(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    clear = li.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.count_distinct("l_linenumber").alias("m")).filter("n = m").select("l_orderkey")
    return mutations.last_of(li, ["l_orderkey"], "l_linenumber").join(clear, "l_orderkey", "left_semi")


@query("b6_insert_if_absent", f"SELECT count_if(c.c_custkey IS NULL) AS inserted, count_if(c.c_custkey IS NOT NULL) AS skipped FROM ({BATCH}) b LEFT JOIN customer c USING (c_custkey)")
def b6_insert_if_absent(spark, sf_dir):
    return mutations.insert_if_absent(table(spark, sf_dir, "customer"), _batch(spark, sf_dir), ["c_custkey"])[1]


@query("b6_inserted_snapshot", f"SELECT * FROM customer UNION ALL SELECT * FROM ({BATCH}) WHERE c_custkey NOT IN (SELECT c_custkey FROM customer)")
def b6_inserted_snapshot(spark, sf_dir):
    return mutations.insert_if_absent(table(spark, sf_dir, "customer"), _batch(spark, sf_dir), ["c_custkey"])[0]


@query("b8_update_where", "SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN 0.0 ELSE s_acctbal END AS s_acctbal FROM supplier")
def b8_update_where(spark, sf_dir):
    return mutations.update_where(table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal"), F.col("s_acctbal") < 0, {"s_acctbal": F.lit(0.0)})


@query("b9_delete_where", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE NOT (l_returnflag = 'R' AND l_linestatus = 'O')")
def b9_delete_where(spark, sf_dir):
    return mutations.delete_where(table(spark, sf_dir, "lineitem"), (F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "O")).select("l_orderkey", "l_linenumber")


GONE = "SELECT c_custkey FROM customer WHERE c_mktsegment = 'HOUSEHOLD'"


@query("b10_cascade", f"SELECT (SELECT count(*) FROM orders WHERE o_custkey NOT IN ({GONE})) AS orders, (SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey IN ({GONE}))) AS lines")
def b10_cascade(spark, sf_dir):
    gone = table(spark, sf_dir, "customer").filter("c_mktsegment = 'HOUSEHOLD'")
    o = table(spark, sf_dir, "orders")
    kept = mutations.cascade(o, gone, "o_custkey", "c_custkey")
    lost = o.join(gone.select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left_semi")
    lines = mutations.cascade(table(spark, sf_dir, "lineitem"), lost, "l_orderkey", "o_orderkey")
    return kept.agg(F.count("*").alias("orders")).crossJoin(lines.agg(F.count("*").alias("lines")))


@query("b10_set_null", f"SELECT o_orderkey, CASE WHEN o_custkey IN ({GONE}) THEN NULL ELSE o_custkey END AS o_custkey FROM orders")
def b10_set_null(spark, sf_dir):
    gone = table(spark, sf_dir, "customer").filter("c_mktsegment = 'HOUSEHOLD'")
    return mutations.set_null(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), gone, "o_custkey", "c_custkey")


@query("b11_stack_quantity", "SELECT l_orderkey, l_partkey, sum(l_quantity) AS l_quantity FROM (SELECT l_orderkey, l_partkey, l_quantity FROM lineitem UNION ALL SELECT l_orderkey, l_partkey, 1.0 FROM lineitem WHERE l_returnflag = 'A') GROUP BY 1, 2")
def b11_stack_quantity(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_returnflag")
    return mutations.stack(li, li.filter("l_returnflag = 'A'").withColumn("l_quantity", F.lit(1.0)), ["l_orderkey", "l_partkey"], "l_quantity")


@query("b12_decrement_delete", "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity - 1 AS l_quantity FROM lineitem WHERE l_quantity - 1 > 0")
def b12_decrement_delete(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    return mutations.use_one(li, F.lit(True), "l_quantity")


@query("e1_scalar_counts", "SELECT (SELECT count(*) FROM customer) AS customers, (SELECT count(*) FROM orders) AS orders, (SELECT count(*) FROM part) AS parts, (SELECT count(*) FROM supplier) AS suppliers, (SELECT count(*) FROM nation) AS nations")
def e1_scalar_counts(spark, sf_dir):
    out = None
    for name, label in (("customer", "customers"), ("orders", "orders"), ("part", "parts"), ("supplier", "suppliers"), ("nation", "nations")):
        one = table(spark, sf_dir, name).agg(F.count("*").alias(label))
        out = one if out is None else out.crossJoin(one)
    return out


@query("e4_count_by_key", "SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand ORDER BY n DESC, p_brand")
def e4_count_by_key(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "p_brand")


@query("e6_distinct_sets", "SELECT l_orderkey, array_to_string(list_sort(list_distinct(list(l_returnflag))), ',') AS flags FROM lineitem GROUP BY l_orderkey")
def e6_distinct_sets(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.sort_array(F.collect_set("l_returnflag")), ",").alias("flags"))


@query("e12_single_side", "SELECT l_orderkey, count(DISTINCT l_returnflag) = 1 AS single, bool_or(l_returnflag = 'R') AS any_r, bool_and(l_linestatus = 'O') AS all_open FROM lineitem GROUP BY 1")
def e12_single_side(spark, sf_dir):
    flag = F.col("l_returnflag")
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg((F.min(flag) == F.max(flag)).alias("single"), F.bool_or(flag == "R").alias("any_r"), F.bool_and(F.col("l_linestatus") == "O").alias("all_open"))


@query("e14_first_per_group", "SELECT o_custkey, min_by(o_orderkey, (o_orderdate, o_orderkey)) AS first_order FROM orders GROUP BY o_custkey")
def e14_first_per_group(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("first_order"))


@query("f9_parts", "SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS part, count(*) OVER (PARTITION BY l_orderkey) AS n_parts FROM lineitem")
def f9_parts(spark, sf_dir):
    found = ranking.parts(table(spark, sf_dir, "lineitem"), "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"])
    return found.select("l_orderkey", "l_linenumber", "l_partkey", F.col("part").cast("long").alias("part"), "n_parts")


@query("f10_top_and_overflow", "SELECT c_nationkey, count(*) FILTER (WHERE r <= 5) AS shown, count(*) FILTER (WHERE r > 5) AS hidden, sum(CASE WHEN r <= 5 THEN c_custkey END)::BIGINT AS shown_keys FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS r FROM customer) GROUP BY 1")
def f10_top_and_overflow(spark, sf_dir):
    r = F.row_number().over(W.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey"))
    return table(spark, sf_dir, "customer").withColumn("r", r).groupBy("c_nationkey").agg(F.count_if(F.col("r") <= 5).alias("shown"), F.count_if(F.col("r") > 5).alias("hidden"), F.sum(F.when(F.col("r") <= 5, F.col("c_custkey"))).alias("shown_keys"))


@query("g7_sorted", "SELECT p_partkey, p_name FROM part ORDER BY p_partkey")
def g7_sorted(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", "p_name").orderBy("p_partkey")


@query("h1_set_union", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def h1_set_union(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")).union(table(spark, sf_dir, "supplier").select("s_nationkey")).distinct()


@query("h2_set_difference", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 100000.0")
def h2_set_difference(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")).subtract(table(spark, sf_dir, "orders").filter("o_totalprice > 100000.0").select("o_custkey"))


@query("h3_set_intersection", "SELECT o_custkey AS k FROM orders WHERE o_orderpriority = '5-LOW' INTERSECT SELECT o_custkey FROM orders WHERE o_orderpriority = '2-HIGH'")
def h3_set_intersection(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.filter("o_orderpriority = '5-LOW'").select(F.col("o_custkey").alias("k")).intersect(o.filter("o_orderpriority = '2-HIGH'").select("o_custkey"))
