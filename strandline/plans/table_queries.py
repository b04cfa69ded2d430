"""Lookups, joins, SQL helpers, vocabulary walks, duplicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.operators import columns, lookup, sqlops, vocab
from strandline.operators.duplicates import exact_duplicates
from strandline.plans.registry import query, table


@query("SELECT count(*) AS n FROM orders WHERE o_totalprice > 100000 AND o_orderstatus = 'O'")
def count_star(spark, sf_dir):
    return sqlops.count_and_max(table(spark, sf_dir, "orders"), "o_orderkey", F.col("o_totalprice") > 100000, F.col("o_orderstatus") == "O").select("n")


@query("SELECT count(*) AS n, max(o_orderkey) AS largest FROM orders WHERE o_orderstatus = 'F'")
def count_star_max(spark, sf_dir):
    return sqlops.count_and_max(table(spark, sf_dir, "orders"), "o_orderkey", F.col("o_orderstatus") == "F")


@query("SELECT CASE WHEN EXISTS (SELECT 1 FROM orders WHERE o_totalprice < 0) THEN 1 ELSE 0 END AS found UNION ALL SELECT CASE WHEN EXISTS (SELECT 1 FROM orders WHERE o_totalprice > 0) THEN 1 ELSE 0 END")
def exists_flag(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return sqlops.exists_flag(orders, F.col("o_totalprice") < 0).union(sqlops.exists_flag(orders, F.col("o_totalprice") > 0))


@query("SELECT DISTINCT o_orderpriority AS value FROM orders")
def first_values(spark, sf_dir):
    return sqlops.first_column(table(spark, sf_dir, "orders").select("o_orderpriority")).distinct()


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, count(DISTINCT l_suppkey) AS suppliers, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS quantity FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def group_rollup(spark, sf_dir):
    amount = F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("decimal(28,2)").alias("quantity")
    return table(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("l_suppkey").alias("suppliers"), amount)


@query("SELECT o_custkey, count(DISTINCT o_orderpriority) AS kinds FROM orders GROUP BY o_custkey HAVING count(DISTINCT o_orderpriority) >= 4")
def having_distinct(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count_distinct("o_orderpriority").alias("kinds")).filter("kinds >= 4")


@query("SELECT o_custkey AS key FROM orders WHERE o_orderstatus = 'O' UNION SELECT c_custkey FROM customer WHERE c_acctbal < 0")
def set_union(spark, sf_dir):
    a = table(spark, sf_dir, "orders").filter("o_orderstatus = 'O'").select(F.col("o_custkey").alias("key"))
    return sqlops.union_checked(a, table(spark, sf_dir, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("key"))).distinct()


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 10")
def limit_offset(spark, sf_dir):
    return table(spark, sf_dir, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(10).limit(20).select("o_orderkey", "o_totalprice")


_CHANGED = "SELECT CASE WHEN c_custkey % 10 = 0 THEN c_custkey + 1000000 ELSE c_custkey END AS c_custkey, c_name, c_acctbal + 1 AS c_acctbal FROM customer WHERE c_custkey % 5 = 0"


def _changed(spark, sf_dir):
    key = F.when(F.col("c_custkey") % 10 == 0, F.col("c_custkey") + 1000000).otherwise(F.col("c_custkey"))
    return table(spark, sf_dir, "customer").filter("c_custkey % 5 = 0").select(key.alias("c_custkey"), "c_name", (F.col("c_acctbal") + 1).alias("c_acctbal"))


@query(f"""WITH n AS ({_CHANGED}) SELECT coalesce(c.c_custkey, n.c_custkey) AS c_custkey, CASE WHEN n.c_custkey IS NOT NULL THEN n.c_name ELSE c.c_name END AS c_name, c.c_nationkey,
    CASE WHEN n.c_custkey IS NOT NULL THEN n.c_acctbal ELSE c.c_acctbal END AS c_acctbal, c.c_mktsegment FROM customer c FULL JOIN n ON c.c_custkey = n.c_custkey""")
def upsert_merge(spark, sf_dir):
    return sqlops.upsert(table(spark, sf_dir, "customer"), _changed(spark, sf_dir), ["c_custkey"])


@query("""WITH w AS (SELECT DISTINCT n_nationkey * 2 AS n_nationkey FROM nation)
    SELECT n.n_nationkey, n.n_name, n.n_regionkey, false AS created FROM nation n JOIN w USING (n_nationkey)
    UNION ALL SELECT w.n_nationkey, 'unknown', 0, true FROM w WHERE NOT EXISTS (SELECT 1 FROM nation n WHERE n.n_nationkey = w.n_nationkey)""")
def get_or_create(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    return sqlops.get_or_create(nation, nation.select((F.col("n_nationkey") * 2).alias("n_nationkey")), ["n_nationkey"], {"n_name": "unknown", "n_regionkey": 0})


@query("""WITH k AS (SELECT c_custkey AS old_key, row_number() OVER (ORDER BY c_custkey) + (SELECT max(c_custkey) FROM customer) AS new_key FROM customer WHERE c_nationkey < 5),
    o AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) + (SELECT max(o_orderkey) FROM orders) AS new_order, o_custkey, o_totalprice FROM orders WHERE o_custkey IN (SELECT old_key FROM k))
    SELECT o_orderkey, o_custkey, o_totalprice FROM orders UNION ALL SELECT new_order, new_key, o_totalprice FROM o JOIN k ON o.o_custkey = k.old_key""")
def merge_tables_remap(spark, sf_dir):
    customer, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    source = customer.filter("c_nationkey < 5")
    _, keys = sqlops.merge_tables(customer, source, "c_custkey")
    theirs = orders.join(source.select(F.col("c_custkey").alias("_c")), F.col("o_custkey") == F.col("_c"), "left_semi")
    return sqlops.merge_tables(orders, theirs, "o_orderkey", {"o_custkey": keys})[0]


@query("""WITH r(ordinal, low, high, label) AS (VALUES (0, 1, 10, 'small'), (1, 10, 25, 'medium'), (2, 25, 45, 'large'))
    SELECT p_partkey, p_size, label FROM part LEFT JOIN r ON p_size >= low AND p_size < high""")
def range_lookup(spark, sf_dir):
    ranges = spark.createDataFrame([(0, 1, 10, "small"), (1, 10, 25, "medium"), (2, 25, 45, "large")], "ordinal int, low int, high int, label string")
    return lookup.range_lookup(table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_size", ranges)


@query("""WITH r(ordinal, low, high, label) AS (VALUES (1, 1, 30, 'wide'), (0, 10, 20, 'first'), (2, 25, 60, 'late'))
    SELECT p_partkey, p_size, label FROM (SELECT p_partkey, p_size, label, row_number() OVER (PARTITION BY p_partkey ORDER BY ordinal) AS k FROM part LEFT JOIN r ON p_size >= low AND p_size < high) WHERE k = 1""")
def range_lookup_overlapping(spark, sf_dir):
    ranges = spark.createDataFrame([(1, 1, 30, "wide"), (0, 10, 20, "first"), (2, 25, 60, "late")], "ordinal int, low int, high int, label string")
    return lookup.range_lookup(table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_size", ranges)


@query("SELECT o_orderkey, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'soon' WHEN o_orderpriority IN ('3-MEDIUM') THEN 'later' ELSE 'whenever' END AS pace FROM orders")
def map_value_case(spark, sf_dir):
    pace = lookup.map_value(F.col("o_orderpriority"), [(["1-URGENT", "2-HIGH"], "soon"), (["3-MEDIUM"], "later")], default="whenever")
    return table(spark, sf_dir, "orders").select("o_orderkey", pace.alias("pace"))


@query("""WITH d AS (SELECT lower(n_name) AS name, n_nationkey AS code FROM nation WHERE n_nationkey % 2 = 0)
    SELECT n.n_name, d.code AS value, d.name IS NOT NULL AS found FROM nation n LEFT JOIN d ON lower(n.n_name) = d.name""")
def ci_lookup(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    names = nation.filter("n_nationkey % 2 = 0").select(F.lower("n_name").alias("name"), F.col("n_nationkey").alias("code"))
    return lookup.ci_lookup(nation.select("n_name"), "n_name", names, "name", "code")


@query("SELECT c.c_custkey, c.c_nationkey, coalesce(CASE WHEN n.n_nationkey % 2 = 0 THEN n.n_name END, 'elsewhere') AS value FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey AND n.n_nationkey % 2 = 0")
def map_keys_to_values(spark, sf_dir):
    known = table(spark, sf_dir, "nation").filter("n_nationkey % 2 = 0")
    return lookup.map_keys(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), "c_nationkey", known, "n_nationkey", "n_name", default="elsewhere")


@query("""WITH b AS (SELECT CASE WHEN s_suppkey % 7 = 0 THEN s_suppkey + 1000000 ELSE s_suppkey END AS s_suppkey, s_name, CASE WHEN s_suppkey % 3 = 0 THEN s_acctbal + 1 ELSE s_acctbal END AS s_acctbal FROM supplier)
    SELECT coalesce(a.s_suppkey, b.s_suppkey) AS s_suppkey, CASE WHEN a.s_suppkey IS NULL THEN 'added' WHEN b.s_suppkey IS NULL THEN 'deleted' ELSE 'changed' END AS change, b.s_name, b.s_acctbal
    FROM supplier a FULL JOIN b ON a.s_suppkey = b.s_suppkey WHERE a.s_suppkey IS NULL OR b.s_suppkey IS NULL OR a.s_name IS DISTINCT FROM b.s_name OR a.s_acctbal IS DISTINCT FROM b.s_acctbal""")
def dict_diff(spark, sf_dir):
    old = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    key = F.when(F.col("s_suppkey") % 7 == 0, F.col("s_suppkey") + 1000000).otherwise(F.col("s_suppkey"))
    new = old.select(key.alias("s_suppkey"), "s_name", F.when(F.col("s_suppkey") % 3 == 0, F.col("s_acctbal") + 1).otherwise(F.col("s_acctbal")).alias("s_acctbal"))
    return lookup.table_diff(old, new, "s_suppkey")


@query("""SELECT p_partkey, CASE WHEN regexp_matches(lower(p_name), '^(?:.*gear|.*bolt)') THEN 'part' WHEN regexp_matches(lower(p_name), '^(?:red|blue)') THEN 'coloured' WHEN regexp_matches(lower(p_name), '^(?:small .*)') THEN 'small' ELSE 'other' END AS label FROM part""")
def regex_classify(spark, sf_dir):
    return lookup.regex_classify(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_name", [(".*GEAR|.*bolt", "part"), ("red|blue", "coloured"), ("small .*", "small")], "other").drop("p_name")


@query("SELECT p_partkey FROM part WHERE p_type LIKE '%SMALL%' OR p_name LIKE '%red%' OR p_name LIKE '%rod%'")
def sql_like_any(spark, sf_dir):
    test = lookup.like_any(F.col("p_type"), ["%SMALL%"]) | lookup.like_any(F.col("p_name"), lookup.regex_to_like("r[eo]d"))
    return table(spark, sf_dir, "part").filter(test).select("p_partkey")


@query("""SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000 AND o_custkey IS NOT NULL)""")
def semi_anti_filters(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    keep, drop = orders.filter("o_orderstatus = 'F'").select("o_custkey"), orders.filter("o_totalprice > 400000").select("o_custkey")
    return vocab.semi_anti(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", keep, drop)


@query("SELECT concept_id, concept_name FROM (SELECT p_partkey AS concept_id, p_name AS concept_name, p_brand AS vocabulary_id, p_type AS code FROM part) WHERE vocabulary_id IN ('Brand#11', 'Brand#12', 'Brand#1', 'Brand#2') AND concept_id NOT IN (1, 2, 3)")
def concept_filter(spark, sf_dir):
    concepts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("concept_id"), F.col("p_name").alias("concept_name"), F.col("p_brand").alias("vocabulary_id"))
    return vocab.filtered(concepts, {"vocabulary_id": ["Brand#11", "Brand#12", "Brand#1", "Brand#2"]}, {"concept_id": [1, 2, 3]}).select("concept_id", "concept_name")


_EDGES = """e AS (SELECT 's' || s_suppkey AS child, 'n' || s_nationkey AS parent FROM supplier UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION ALL SELECT 'r' || r_regionkey, 'world' FROM region)"""


def _edges(spark, sf_dir):
    edge = lambda t, a, x, b, y: table(spark, sf_dir, t).select(F.concat(F.lit(a), x).alias("child"), F.concat(F.lit(b), y).alias("parent"))
    top = table(spark, sf_dir, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("child"), F.lit("world").alias("parent"))
    return edge("supplier", "s", "s_suppkey", "n", "s_nationkey").union(edge("nation", "n", "n_nationkey", "r", "n_regionkey")).union(top)


@query(f"""WITH RECURSIVE {_EDGES}, a AS (SELECT child AS start, parent AS ancestor, 1 AS generation FROM e WHERE child LIKE 's%' UNION ALL SELECT a.start, e.parent, a.generation + 1 FROM a JOIN e ON a.ancestor = e.child)
    SELECT start, ancestor, generation FROM a""")
def recursive_ancestors(spark, sf_dir):
    edges = _edges(spark, sf_dir)
    return vocab.ancestors(edges, edges.filter(F.col("child").startswith("s")).select("child"))


@query(f"""WITH {_EDGES} SELECT s.child AS entity, CASE WHEN r.parent IN ('r1', 'r2') THEN upper(r.parent) ELSE 'WORLD' END AS category FROM e s JOIN e r ON s.parent = r.child WHERE s.child LIKE 's%'""")
def category_by_ancestor(spark, sf_dir):
    edges = _edges(spark, sf_dir)
    categories = spark.createDataFrame([("R1", 0), ("R2", 1), ("WORLD", 2)], "category string, ordinal int")
    return vocab.category(edges.filter(F.col("child").startswith("s")).select("child"), edges, categories)


@query("""WITH h AS (SELECT doc_id, md5(text) AS digest FROM documents WHERE text IS NOT NULL), g AS (SELECT digest, min(doc_id) AS original, count(*) AS copies FROM h GROUP BY digest HAVING count(*) > 1)
    SELECT doc_id, digest, original, copies FROM h JOIN g USING (digest)""")
def dedup_exact(spark, sf_dir):
    return exact_duplicates(table(spark, sf_dir, "documents"), "doc_id", "text")


@query("SELECT r_name, n_name FROM region CROSS JOIN nation")
def cross_product(spark, sf_dir):
    return lookup.cross_product(table(spark, sf_dir, "region").select("r_name"), table(spark, sf_dir, "nation").select("n_name"))


@query("SELECT * FROM (VALUES (0, 1, 10, 0.5), (1, 2, 10, 0.5), (2, 3, 10, 0.5), (3, 2, 5, 0.5), (4, 2, 20, 0.5), (5, 2, 10, 0.1), (6, 2, 10, 0.9)) t(setting, a, b, c)".replace("0.5)", "CAST(0.5 AS DOUBLE))").replace("0.1)", "CAST(0.1 AS DOUBLE))").replace("0.9)", "CAST(0.9 AS DOUBLE))"))
def params_around_centre(spark, sf_dir):
    return lookup.params_around_centre(spark, a=[1, 2, 3], b=[5, 10, 20], c=[0.1, 0.5, 0.9])


@query("SELECT p_partkey, p_name, row_number() OVER (ORDER BY array_to_string([CASE WHEN regexp_matches(x, '^[0-9]') THEN lpad(CAST(length(regexp_replace(x, '^0+([0-9])', '\\1')) AS VARCHAR), 9, '0') || regexp_replace(x, '^0+([0-9])', '\\1') ELSE x END for x in regexp_extract_all(p_name, '[0-9]+|[^0-9]+')], ''), p_partkey) AS place FROM part")
def natural_sort_rank(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", lookup.natural_key(F.col("p_name")).alias("k"))
    ranked = sqlops.new_keys(parts.select(F.struct("k", "p_partkey").alias("k")), "k", 0)
    return ranked.select(F.col("old_key.p_partkey").alias("p_partkey"), F.col("new_key").alias("place")).join(parts.drop("k"), "p_partkey").select("p_partkey", "p_name", "place")


@query("SELECT 'INSERT INTO `nation` (`n_nationkey`, `n_name`, `n_regionkey`) VALUES (' || n_nationkey || ', ''' || replace(n_name, '''', '''''') || ''', ' || n_regionkey || ');' AS statement FROM nation")
def dump_inserts(spark, sf_dir):
    return sqlops.insert_statements(table(spark, sf_dir, "nation"), "nation")


@query("SELECT o_custkey, 'o_orderstatus' AS \"column\", array_to_string(list_sort(list(DISTINCT o_orderstatus)), ',') AS found FROM orders GROUP BY o_custkey HAVING count(DISTINCT o_orderstatus) > 1")
def inconsistent_attributes(spark, sf_dir):
    return sqlops.require_same(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderstatus"]).withColumn("found", F.array_join("found", ","))


@query("SELECT j.o_orderkey FROM orders j WHERE j.o_orderstatus = 'O' AND NOT EXISTS (SELECT 1 FROM lineitem a WHERE a.l_orderkey = j.o_orderkey AND a.l_returnflag = 'R')")
def pending_jobs(spark, sf_dir):
    jobs = table(spark, sf_dir, "orders").filter("o_orderstatus = 'O'").select("o_orderkey")
    return vocab.semi_anti(jobs, "o_orderkey", drop=table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select("l_orderkey"))


@query("SELECT * FROM (VALUES (0, 'c_custkey', 'bigint', true), (1, 'c_name', 'string', true), (2, 'c_nationkey', 'int', true), (3, 'c_acctbal', 'double', true), (4, 'c_mktsegment', 'string', true)) t(place, name, type, nullable)")
def column_list(spark, sf_dir):
    return columns.described(table(spark, sf_dir, "customer"))


@query("""SELECT * FROM (VALUES ('region', true, 'CREATE TABLE `region` (`r_regionkey` INT, `r_name` STRING)'), ('nation', false, 'CREATE TABLE `nation` (`n_nationkey` INT, `n_name` STRING, `n_regionkey` INT)')) t(name, same, statement)""")
def create_statements(spark, sf_dir):
    region, nation = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    same = lambda t: columns.same_columns(t, region.withColumnRenamed("r_name", "R_NAME"))
    rows = [(name, same(t), columns.create_statement(t, name)) for name, t in (("region", region), ("nation", nation))]
    return spark.createDataFrame(rows, "name string, same boolean, statement string")


@query("SELECT * FROM (VALUES (0, 'nation'), (0, 'part'), (1, 'customer'), (1, 'supplier'), (2, 'orders'), (3, 'lineitem')) t(layer, name)")
def table_layers(spark, sf_dir):
    layers = sqlops.table_order({"lineitem": ["orders", "part", "supplier"], "orders": ["customer", "orders"], "customer": ["nation"], "supplier": ["nation"], "nation": [], "part": []})
    return spark.createDataFrame([(k, name) for k, layer in enumerate(layers) for name in layer], "layer int, name string")


@query("SELECT p_partkey FROM part WHERE p_size > 20 AND NOT contains(p_type, 'SMALL')")
def attribute_criteria(spark, sf_dir):
    drugs = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") > 20).alias("large"), F.col("p_type").contains("SMALL").alias("small"))
    return columns.where_all(drugs, large=True, small=False).select("p_partkey")


@query("""SELECT CAST(n_nationkey AS INTEGER) AS key, CASE WHEN n_nationkey % 3 = 0 THEN upper(n_name) || '!' ELSE n_name END AS value FROM nation UNION ALL SELECT 100, 'new'""")
def merged_maps(spark, sf_dir):
    old = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("value"))
    new = old.filter("key % 3 = 0").select("key", F.concat(F.upper("value"), F.lit("!")).alias("value"))
    return columns.merged_maps("key", "value", old, new, spark.createDataFrame([(100, "new")], "key int, value string"))


@query("SELECT n_regionkey AS key, max(n_nationkey) AS value FROM nation GROUP BY n_regionkey")
def reversed_map(spark, sf_dir):
    return columns.reversed_map(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_regionkey").alias("value")), "key", "value")


@query("""SELECT DISTINCT 'b' || a.p_partkey AS source_code, 'c' || b.p_partkey AS target_code, b.p_name AS target_name FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1 AND b.p_partkey % 2 = 1 WHERE a.p_partkey % 2 = 0 AND a.p_partkey IN (2, 4, 6, 8, 50)""")
def equivalent_codes(spark, sf_dir):
    key = F.col("p_partkey").cast("int")
    vocabulary = F.when(key % 2 == 0, "old").otherwise("new")
    concepts = table(spark, sf_dir, "part").select(key.alias("concept_id"), F.col("p_name").alias("concept_name"), vocabulary.alias("vocabulary_id"), F.concat(F.when(key % 2 == 0, "b").otherwise("c"), key.cast("string")).alias("concept_code"))
    relationships = concepts.select(F.col("concept_id").alias("concept_id_1"), (F.col("concept_id") + 1).alias("concept_id_2"), F.lit(vocab.MAPS_TO).alias("relationship_id"))
    return vocab.equivalents(concepts, relationships, "old", ["b2", "b4", "b6", "b8", "b50"], "new")


@query("""WITH w AS (SELECT conv_id, turn, string_split(text, ' ') AS a FROM conversations WHERE text IS NOT NULL)
    SELECT conv_id, array_to_string(list_sort(list_distinct(flatten(list(a)))), ' ') AS words, CAST(len(flatten(list(a))) AS INTEGER) AS n FROM w GROUP BY conv_id""")
def flattened_lists(spark, sf_dir):
    words = table(spark, sf_dir, "conversations").filter("text is not null").select("conv_id", F.explode(F.split("text", " ")).alias("word"))
    return words.groupBy("conv_id").agg(F.array_join(F.array_sort(F.collect_set("word")), " ").alias("words"), F.count(F.lit(1)).cast("int").alias("n"))


@query("""SELECT count(*) AS n, min(c_custkey) AS least, max(c_name) AS last FROM customer WHERE c_nationkey = 3""")
def raw_statement(spark, sf_dir):
    rows, names = sqlops.rows_and_names(spark, "SELECT count(*) AS n, min(c_custkey) AS least, max(c_name) AS last FROM parquet.`" + f"{sf_dir}/customer.parquet" + "` WHERE c_nationkey = :nation", nation=3)
    return spark.createDataFrame(rows, "n bigint, least bigint, last string").toDF(*names)


@query("""SELECT c_custkey, c_name, c_acctbal * 2 AS twice FROM customer WHERE c_nationkey = 3 AND c_acctbal > 10.5""")
def statement_rows(spark, sf_dir):
    """A statement with values and a table put in; its rows stay a table."""
    return sqlops.statement(spark, "SELECT c_custkey, c_name, c_acctbal * 2 AS twice FROM {people} WHERE c_nationkey = :nation AND c_acctbal > :least", {"people": table(spark, sf_dir, "customer")}, nation=3, least=10.5)


@query("""SELECT 0 AS place, 'o_orderkey' AS name, 'bigint' AS type, count(*) AS n, count(*) FILTER (o_orderkey IS NULL) AS nulls, count(DISTINCT o_orderkey) AS "values" FROM orders
    UNION ALL SELECT 1, 'o_orderpriority', 'string', count(*), count(*) FILTER (o_orderpriority IS NULL), count(DISTINCT o_orderpriority) FROM orders
    UNION ALL SELECT 2, 'late', 'date', count(*), count(*) FILTER (o_custkey % 3 <> 0), count(DISTINCT CASE WHEN o_custkey % 3 = 0 THEN CAST(o_orderdate AS DATE) END) FROM orders""")
def column_profile(spark, sf_dir):
    """Columns with their types, nulls and values."""
    orders = table(spark, sf_dir, "orders")
    return columns.profiled(orders.select("o_orderkey", "o_orderpriority", F.when(F.col("o_custkey") % 3 == 0, F.to_date("o_orderdate")).alias("late")))


@query("""SELECT 0 AS place, 'CREATE TABLE `people` (`c_custkey` BIGINT, `c_name` STRING, `c_nationkey` INT);' AS statement UNION ALL
    SELECT row_number() OVER (ORDER BY c_custkey), 'INSERT INTO `people` (`c_custkey`, `c_name`, `c_nationkey`) VALUES (' || c_custkey || ', ''' || replace(c_name, '''', '''''') || ''', ' || coalesce(CAST(c_nationkey AS VARCHAR), 'NULL') || ');' FROM customer""")
def dumped_script(spark, sf_dir):
    """A script that makes a table and all its rows, in order."""
    return sqlops.dump_script(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey"), "people", ["c_custkey"])


@query("""WITH RECURSIVE e(child, parent) AS (SELECT DISTINCT 'orders' || o_orderkey % 5, 'customer' || o_custkey % 4 FROM orders UNION SELECT DISTINCT 'customer' || c_custkey % 4, 'nation' || c_nationkey % 3 FROM customer),
    d AS (SELECT child AS name, 0 AS depth FROM e UNION SELECT parent, 0 FROM e UNION SELECT e.child, d.depth + 1 FROM d JOIN e ON d.name = e.parent) SELECT name, max(depth) AS layer FROM d GROUP BY name""")
def dependency_layers(spark, sf_dir):
    """Names that depend on each other as rows of tables do, in layers."""
    child = lambda t, c, n: F.concat(F.lit(t), (F.col(c) % n).cast("string"))
    pairs = table(spark, sf_dir, "orders").select(child("orders", "o_orderkey", 5), child("customer", "o_custkey", 4)).union(table(spark, sf_dir, "customer").select(child("customer", "c_custkey", 4), child("nation", "c_nationkey", 3)))
    return vocab.dependencies_in_layers(pairs.toDF("child", "parent"))
