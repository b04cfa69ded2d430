"""Queries over whole databases and over many patterns."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.operators import patterns
from strandline.operators.merging import merge_database
from strandline.plans.registry import query, table


def _databases(spark, sf_dir):
    """Customers with a boss among them and a first order, and their orders: a self-reference and a ring."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    first = orders.groupBy(F.col("o_custkey").alias("_c")).agg(F.min("o_orderkey").alias("first_order"))
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", F.when(F.col("c_custkey") >= 2, F.expr("c_custkey div 2")).alias("boss"))
    customer = customer.join(first, F.col("c_custkey") == F.col("_c"), "left").drop("_c")
    of = lambda some: {"customer": some, "orders": orders.join(some.select(F.col("c_custkey").alias("_c")), F.col("o_custkey") == F.col("_c"), "left_semi")}
    return of(customer.filter("c_nationkey < 13")), of(customer.filter("c_nationkey >= 10"))


@query("""WITH fo AS (SELECT o_custkey, min(o_orderkey) AS first_order FROM orders GROUP BY 1),
    c AS (SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_custkey >= 2 THEN c_custkey // 2 END AS boss, first_order FROM customer LEFT JOIN fo ON o_custkey = c_custkey),
    t AS (SELECT * FROM c WHERE c_nationkey < 13), s AS (SELECT c_custkey, upper(c_name) AS c_name, boss, first_order FROM c WHERE c_nationkey >= 10 AND c_custkey % 7 <> 0),
    ot AS (SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM t)), os AS (SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM c WHERE c_nationkey >= 10)),
    ck AS (SELECT c_custkey AS old, row_number() OVER (ORDER BY c_custkey) + (SELECT max(c_custkey) FROM t) AS new FROM s),
    ok AS (SELECT o_orderkey AS old, row_number() OVER (ORDER BY o_orderkey) + (SELECT max(o_orderkey) FROM ot) AS new FROM os)
    SELECT 'customer' AS name, c_custkey AS key, c_name AS text, boss AS one, first_order AS other FROM t UNION ALL SELECT 'orders', o_orderkey, NULL, o_custkey, NULL FROM ot
    UNION ALL SELECT 'customer', ck.new, s.c_name, b.new, f.new FROM s JOIN ck ON s.c_custkey = ck.old LEFT JOIN ck b ON s.boss = b.old LEFT JOIN ok f ON s.first_order = f.old
    UNION ALL SELECT 'orders', ok.new, NULL, c.new, NULL FROM os JOIN ok ON os.o_orderkey = ok.old LEFT JOIN ck c ON os.o_custkey = c.old""")
def merge_database_ring(spark, sf_dir):
    """Two databases that share customers; some of the second are left out, the others' names are changed on the way."""
    target, source = _databases(spark, sf_dir)

    def changed(name, rows):
        return rows.filter("c_custkey % 7 <> 0").withColumn("c_name", F.upper("c_name")) if name == "customer" else rows

    references = {("customer", "boss"): "customer", ("customer", "first_order"): "orders", ("orders", "o_custkey"): "customer"}
    merged, _ = merge_database(target, source, {"customer": "c_custkey", "orders": "o_orderkey"}, references, changed)
    rows = merged["customer"].select(F.lit("customer").alias("name"), F.col("c_custkey").alias("key"), F.col("c_name").alias("text"), F.col("boss").alias("one"), F.col("first_order").alias("other"))
    return rows.union(merged["orders"].select(F.lit("orders"), "o_orderkey", F.lit(None).cast("string"), "o_custkey", F.lit(None).cast("bigint")))


@query("""SELECT c_custkey, 'g' || (list_min([CAST(substr(c_name, i, 3) AS INTEGER) for i in range(10, length(c_name) - 1)]) % 17) AS label FROM customer""")
def thousand_patterns(spark, sf_dir):
    """A rule for each three digits a name may hold; the first rule wins."""
    rules = [(rf"customer#\d*{k:03d}", f"g{k % 17}") for k in range(1000)]
    return patterns.classify(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_name", rules).drop("c_name")
