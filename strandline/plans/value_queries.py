"""Conversions of values: SQL types and literals, numbers in texts, codes of bytes, cells of spreadsheets, whole columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.functions import convert, rounding, strings
from strandline.operators import columns
from strandline.plans.registry import query, table
from strandline.sources.delimited import cell

#: SQL type, name, length, date, text, text of 1000, binary, numeric, whole number, known, Spark type.
_TYPES = [
    ("BIGINT", "BIGINT", None, False, False, False, False, True, True, True, "bigint"),
    ("NVARCHAR(32)", "NVARCHAR", 32, False, True, False, False, False, False, True, "string"),
    ("NVARCHAR(MAX)", "NVARCHAR", None, False, True, True, False, False, False, True, "string"),
    ('NVARCHAR(1600) COLLATE "Latin1_General_CI_AS"', "NVARCHAR", 1600, False, True, True, False, False, False, True, "string"),
    ("LONGTEXT", "LONGTEXT", None, False, True, True, False, False, False, True, "string"),
    ("ENUM('red','green','blue')", "ENUM", None, False, False, False, False, False, False, False, "string"),
    ("DATETIME", "DATETIME", None, True, False, False, False, False, False, True, "timestamp_ntz"),
    ("DATE", "DATE", None, True, False, False, False, False, False, True, "date"),
    ("VARBINARY(10)", "VARBINARY", 10, False, False, False, True, False, False, True, "binary"),
    ("DECIMAL(10, 2)", "DECIMAL", None, False, False, False, False, True, False, True, "decimal(10,2)"),
    ("DOUBLE", "DOUBLE", None, False, False, False, False, True, False, True, "double"),
    ("BIT", "BIT", None, False, False, False, False, True, True, True, "boolean"),
    ("int", "int", None, False, False, False, False, False, False, False, "int"),
]
_sql = lambda v: "NULL" if v is None else repr(v).upper() if isinstance(v, bool) else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"


@query("SELECT * FROM (VALUES " + ", ".join(f"({', '.join(map(_sql, [*r, r[0].split(' COLLATE')[0]]))})" for r in _TYPES) + ") t(sql_type, name, length, is_date, is_text, is_long_text, is_binary, is_numeric, is_integer, is_known, spark_type, bare)")
def sql_types(spark, sf_dir):
    return _read_types(spark.createDataFrame([(r[0], convert.spark_type(r[0])) for r in _TYPES], "sql_type string, spark_type string"))


def _read_types(kinds, *keys):
    t = F.col("sql_type")
    own, within = convert.split_sql_type(t), convert.sql_type_is
    return kinds.select(
        *keys, t, own["name"].alias("name"), own["length"].alias("length"), within(t, convert.SQL_DATE).alias("is_date"), within(t, convert.SQL_TEXT).alias("is_text"), convert.merits_fulltext(t).alias("is_long_text"), within(t, convert.SQL_BINARY).alias("is_binary"),
        within(t, convert.SQL_NUMBER).alias("is_numeric"), within(t, convert.SQL_INTEGER).alias("is_integer"), convert.is_sql_type(t).alias("is_known"), "spark_type", convert.without_collation(t).alias("bare"),
    )


#: Families of types as SQL lists.
_in = lambda family: "(" + ", ".join(f"'{x}'" for x in family) + ")"


@query(rf"""WITH n AS (SELECT c_custkey, ['CHAR(' || n || ')', 'VARCHAR(' || n || ')', 'TEXT', 'DECIMAL(' || (1 + n % 38) || ', 2)', 'BIGINT', 'DATE', 'VARBINARY(' || n || ')', 'unknown', 'NVARCHAR(' || n || ') COLLATE x', 'DOUBLE'][1 + c_custkey % 10] AS sql_type
        FROM (SELECT c_custkey, c_custkey * 7 % 3000 + 1 AS n FROM customer)),
    s AS (SELECT *, trim(split_part(sql_type, '(', 1)) AS name, TRY_CAST(regexp_extract(sql_type, '^[^(]*\((\d+)\)', 1) AS INTEGER) AS length FROM n)
    SELECT c_custkey, sql_type, name, length, name IN {_in(convert.SQL_DATE)} AS is_date, name IN {_in(convert.SQL_TEXT)} AS is_text, name IN {_in(convert.SQL_TEXT)} AND (length IS NULL OR length >= 1000) AS is_long_text,
        name IN {_in(convert.SQL_BINARY)} AS is_binary, name IN {_in(convert.SQL_NUMBER)} AS is_numeric, name IN {_in(convert.SQL_INTEGER)} AS is_integer, name <> 'unknown' AS is_known,
        CASE name WHEN 'DECIMAL' THEN 'decimal(' || regexp_extract(sql_type, '\((\d+), 2', 1) || ',2)' WHEN 'BIGINT' THEN 'bigint' WHEN 'DATE' THEN 'date' WHEN 'VARBINARY' THEN 'binary' WHEN 'DOUBLE' THEN 'double' ELSE 'string' END AS spark_type,
        split_part(sql_type, ' COLLATE', 1) AS bare FROM s""")
def sql_types_by_row(spark, sf_dir):
    """A type of each customer's own, with lengths and digits that vary."""
    n = F.expr("CAST(c_custkey * 7 % 3000 + 1 AS STRING)")
    with_n = lambda name, rest=")": F.concat(F.lit(f"{name}("), n, F.lit(rest))
    digits = F.concat(F.lit("DECIMAL("), F.expr("CAST(1 + (c_custkey * 7 % 3000 + 1) % 38 AS STRING)"), F.lit(", 2)"))
    forms = F.array(with_n("CHAR"), with_n("VARCHAR"), F.lit("TEXT"), digits, F.lit("BIGINT"), F.lit("DATE"), with_n("VARBINARY"), F.lit("unknown"), with_n("NVARCHAR", ") COLLATE x"), F.lit("DOUBLE"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.get(forms, (F.col("c_custkey") % 10).cast("int")).alias("sql_type"))
    return _read_types(rows.withColumn("spark_type", convert.spark_types(F.col("sql_type"))), "c_custkey")


@query("""SELECT o_orderkey, '''' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || '''' AS at, '-- ' || o_orderpriority AS note, o_orderpriority AS plain, '`' || replace(o_orderstatus || '`', '`', '``') || '`' AS identifier,
    true AS is_name, [o_orderpriority, o_orderstatus || ',x'] AS items FROM orders""")
def sql_texts(spark, sf_dir):
    p, quoted = F.col("o_orderpriority"), lambda x: convert.sql_string(x)
    line = F.concat(quoted(p), F.lit(" , "), quoted(F.concat("o_orderstatus", F.lit(",x"))))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", convert.sql_datetime(F.col("o_orderdate")).alias("at"), convert.sql_comment(p).alias("note"), convert.sql_dequoted(quoted(p)).alias("plain"),
        convert.quoted_identifier(F.concat("o_orderstatus", F.lit("`"))).alias("identifier"), convert.is_field_name(p).alias("is_name"), F.transform(convert.sql_csv_items(line), convert.sql_dequoted).alias("items"),
    )


@query("""WITH n AS (SELECT c_custkey, CAST((CASE WHEN c_custkey % 3 = 0 THEN 999000000 ELSE 100000000 END) + (c_custkey * 7919) % 900000 AS VARCHAR) AS s, CAST(c_custkey % 10 AS VARCHAR) AS d FROM customer),
    k AS (SELECT *, 11 - list_sum([CAST(substr(s, CAST(i + 1 AS BIGINT), 1) AS INTEGER) * (10 - i) for i in range(9)]) % 11 AS k FROM n), v AS (SELECT *, CASE WHEN k = 11 THEN 0 ELSE k END = CAST(d AS INTEGER) AS good FROM k)
    SELECT c_custkey, good AS valid, good AND c_custkey % 3 = 0 AS is_test, CASE WHEN good THEN CAST(s || d AS BIGINT) END AS number FROM v""")
def nhs_numbers(spark, sf_dir):
    start = F.when(F.col("c_custkey") % 3 == 0, 999000000).otherwise(100000000)
    number = F.concat((start + (F.col("c_custkey") * 7919) % 900000).cast("string"), (F.col("c_custkey") % 10).cast("string"))
    spaced = F.concat(F.substring(number, 1, 3), F.lit(" "), F.substring(number, 4, 3), F.lit(" "), F.substring(number, 7, 4))
    return table(spark, sf_dir, "customer").select("c_custkey", convert.is_valid_nhs(number).alias("valid"), convert.is_test_nhs(number.cast("bigint")).alias("is_test"), convert.nhs_from_text(spaced).alias("number"))


@query("SELECT c_custkey, true AS valid, true AS is_test, true AS other_valid FROM customer")
def random_nhs_numbers(spark, sf_dir):
    drawn = table(spark, sf_dir, "customer").select("c_custkey", convert.random_nhs(F.col("c_custkey")).alias("drawn"), convert.random_nhs(F.col("c_custkey"), test_range=False, seed=5).alias("other"))
    return drawn.select("c_custkey", convert.is_valid_nhs(F.col("drawn")).alias("valid"), convert.is_test_nhs(F.col("drawn")).alias("is_test"), convert.is_valid_nhs(F.col("other")).alias("other_valid"))


@query("SELECT c_custkey, 'X''' || lower(hex(encode(c_name))) || '''' AS hexed, '64''' || to_base64(encode(c_name)) || '''' AS coded, c_name AS from_hexed, c_name AS from_coded FROM customer")
def byte_codes(spark, sf_dir):
    hexed, coded = convert.hex_text(F.col("c_name").cast("binary")), convert.base64_text(F.col("c_name").cast("binary"))
    return table(spark, sf_dir, "customer").select("c_custkey", hexed.alias("hexed"), coded.alias("coded"), convert.from_hex_text(hexed).cast("string").alias("from_hexed"), convert.from_base64_text(coded).cast("string").alias("from_coded"))


@query("""SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN '–' ELSE '' END || printf('%.1f', abs(CAST(trunc(c_acctbal) AS BIGINT)) + 0.75) AS fixed, c_custkey % 2 = 0 AS is_whole, CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment END AS filled,
    CASE WHEN c_nationkey NOT IN (1, 2) THEN c_nationkey END AS nation, c_mktsegment AS required, c_custkey = 7 AS is_seven FROM customer""")
def small_conversions(spark, sf_dir):
    x = F.col("c_acctbal").cast("bigint")
    fixed = convert.number_to_dp(F.when(F.col("c_acctbal") < 0, -(F.abs(x) + 0.75)).otherwise(x + 0.75), 1)
    text = F.when(F.col("c_custkey") % 2 == 0, F.col("c_custkey").cast("string")).otherwise("x1")
    filled = convert.blank_to_null(F.when(F.col("c_custkey") % 3 != 0, F.concat(F.lit(" "), "c_mktsegment", F.lit(" "))).otherwise("  "))
    return table(spark, sf_dir, "customer").select(
        "c_custkey", fixed.alias("fixed"), convert.is_integer(text).alias("is_whole"), filled.alias("filled"), convert.nulls(F.col("c_nationkey"), [1, 2]).alias("nation"), convert.required(F.col("c_mktsegment")).alias("required"), (F.col("c_custkey") == 7).alias("is_seven")
    )


@query("""SELECT c_custkey AS x_key, upper(c_name) AS x_c_name, lower(c_mktsegment) AS x_c_mktsegment, CASE WHEN c_nationkey <> 3 THEN CASE WHEN c_nationkey = 4 THEN 40 ELSE c_nationkey END END AS x_c_nationkey, CAST(NULL AS DOUBLE) AS x_wiped,
    CAST(CAST(c_custkey AS VARCHAR) AS DOUBLE) AS x_number, CAST(TIMESTAMP '2024-01-05 10:00:00' AS TIMESTAMP) AS x_at FROM customer""")
def column_conversions(spark, sf_dir):
    df = table(spark, sf_dir, "customer").withColumns({"wiped": F.col("c_acctbal"), "number": F.col("c_custkey").cast("string"), "at": F.lit("2024-01-05 10:00")})
    df = columns.converted(columns.converted(df, ["c_name"], F.upper), ["c_mktsegment"], F.lower)
    df = columns.converted(columns.converted(df, ["number"], lambda c: c.cast("double")), ["at"], lambda c: F.try_to_timestamp(c).cast("timestamp_ntz"))
    df = columns.wiped(columns.replaced(columns.null_values(df, [3]).withColumn("c_custkey", F.col("number").cast("bigint")), "c_nationkey", 4, 40), "wiped")
    return columns.prefixed(columns.renamed(df, {"c_custkey": "key", "c_acctbal": None}), "x_")


@query("""SELECT o_orderkey, o_orderpriority AS text, o_orderkey AS whole, o_totalprice AS number, o_orderkey % 2 = 0 AS truth, CAST(o_orderdate AS DATE) AS day, date_trunc('day', o_orderdate) AS at, DATE '1899-12-30' + CAST(40000 + o_orderkey % 1000 AS INTEGER) AS from_serial,
    CAST(NULL AS BIGINT) AS none, CAST(o_orderkey + 0.25 AS DECIMAL(38,10)) AS exact FROM orders""")
def spreadsheet_cells(spark, sf_dir):
    c = F.col
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", cell(F.concat(F.lit(" "), c("o_orderpriority")), "str").alias("text"), cell(F.concat(c("o_orderkey").cast("string"), F.lit(".0")), "int").alias("whole"), cell(c("o_totalprice").cast("string"), "float").alias("number"),
        cell(F.when(c("o_orderkey") % 2 == 0, "Yes").otherwise("n"), "bool").alias("truth"), cell(F.date_format("o_orderdate", "yyyy-MM-dd"), "date").alias("day"), cell(F.date_format("o_orderdate", "yyyy-MM-dd"), "datetime").alias("at"),
        cell((40000 + c("o_orderkey") % 1000).cast("string"), "date").alias("from_serial"), cell(F.lit("N/A"), "int", null_values=["N/A"]).alias("none"), cell(F.concat(c("o_orderkey").cast("string"), F.lit(".25")), "decimal").alias("exact"),
    )


@query("""SELECT c_custkey, '"' || c_name || '","a ""b"",c"' AS line, [c_name, 'a "b",c'] AS items, c_custkey || ',' || c_nationkey AS numbers, [c_custkey, CAST(c_nationkey AS BIGINT)] AS back, CAST([] AS BIGINT[]) AS bad,
    1 AS major, CAST(c_nationkey AS INTEGER) AS minor, CAST(c_custkey % 2 AS INTEGER) AS patch, c_custkey % 3 <> 0 AS released, CASE WHEN c_custkey % 3 = 0 THEN 'rc.1' ELSE '' END AS label FROM customer""")
def list_and_version_codecs(spark, sf_dir):
    items, numbers = F.array(F.col("c_name"), F.lit('a "b",c')), F.array(F.col("c_custkey"), F.col("c_nationkey").cast("bigint"))
    v = convert.version(F.concat(F.lit("1."), F.col("c_nationkey").cast("string"), F.lit("."), (F.col("c_custkey") % 2).cast("string"), F.when(F.col("c_custkey") % 3 == 0, "-rc.1+b7").otherwise("")))
    return table(spark, sf_dir, "customer").select(
        "c_custkey", convert.strings_to_csv(items).alias("line"), convert.strings_from_csv(convert.strings_to_csv(items)).alias("items"), convert.ints_to_csv(numbers).alias("numbers"), convert.ints_from_csv(convert.ints_to_csv(numbers)).alias("back"),
        convert.ints_from_csv(F.lit("1,x")).alias("bad"), v["major"].alias("major"), v["minor"].alias("minor"), v["patch"].alias("patch"), v["released"].alias("released"), v["label"].alias("label"),
    )


_UNITS = ["", "Ki", "Mi", "Gi", "Ti"]


def _ladder(form, symbols):
    return "CASE " + " ".join(f"WHEN n < {1024 ** (k + 1)} THEN printf('{form}', n / CAST({1024**k} AS DOUBLE), '{s}')" for k, s in enumerate(symbols)) + " END"


@query(f"""WITH s AS (SELECT c_custkey, c_custkey * c_custkey * 1000 AS n FROM customer) SELECT c_custkey, {_ladder('%.1f%sB', _UNITS)} AS size, {_ladder('%.1f %s', ['B', 'K', 'M', 'G', 'T'])} AS customary, {_ladder('%.1f %s', ['byte', 'kibi', 'mebi', 'gibi', 'tebi'])} AS iec,
    CAST(c_custkey * 1024 AS BIGINT) AS back, CAST(c_custkey * 1048576 AS BIGINT) AS mega, 'part' || c_custkey || '.txt' AS named, ['p' || c_custkey, 'p7'] AS several, CASE WHEN c_custkey % 5 <= 3 THEN ['v' || i for i in range(c_custkey % 5, 4)] ELSE CAST([] AS VARCHAR[]) END AS span,
    CASE WHEN c_custkey % 2 = 0 THEN CAST(c_custkey // 2 AS VARCHAR) ELSE CAST(c_custkey / 2.0 AS VARCHAR) END AS half FROM s""")
def sizes_and_numbered_names(spark, sf_dir):
    n, k = F.col("c_custkey") * F.col("c_custkey") * 1000, F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        "c_custkey", F.trim(strings.size_text(n)).alias("size"), strings.bytes_text(n).alias("customary"), strings.bytes_text(n, "iec_ext").alias("iec"), strings.bytes_from_text(strings.numbered("", k, " k")).alias("back"), strings.bytes_from_text(strings.numbered("", k, "mebi")).alias("mega"),
        strings.numbered("part", k, ".txt").alias("named"), strings.numbered_all("p", F.array(k, F.lit(7).cast("bigint"))).alias("several"), strings.numbered_range("v", k % 5, F.lit(3).cast("bigint")).alias("span"), strings.whole_as_integer(k / 2).alias("half"),
    )


@query("""SELECT n_nationkey, n_nationkey || chr(9) || n_name || chr(9) || '' || chr(9) || 'a\\tb' AS row, n_name AS name, translate(n_name, 'AE', 'EA') AS swapped, n_name = '' AS empty FROM nation""")
def tab_separated(spark, sf_dir):
    row = strings.tsv_row(F.col("n_nationkey"), F.col("n_name"), F.lit(None), F.lit("a\tb"))
    pairs = strings.tsv_pairs(F.concat_ws("\t", F.lit("NAME"), F.lit("old"), F.lit("Key"), F.col("n_nationkey").cast("string"), F.lit("name"), "n_name", F.lit("odd")))
    return table(spark, sf_dir, "nation").select("n_nationkey", row.alias("row"), pairs["name"].alias("name"), strings.multiple_replace({"A": "E", "E": "A"})(F.col("n_name")).alias("swapped"), (F.length("n_name") == 0).alias("empty"))


@query("""SELECT c_custkey, c_custkey % 6 = 0 AS good, CASE WHEN c_custkey % 6 < 4 THEN split_part(CASE c_custkey % 6 WHEN 0 THEN 'a' || c_custkey || '@x.org' WHEN 1 THEN 'a@b' WHEN 2 THEN 'a@b.c,d' ELSE 'a@b.c.' END, '@', 2) WHEN c_custkey % 6 = 4 THEN 'b' ELSE '' END AS domain FROM customer""")
def email_checks(spark, sf_dir):
    k = F.col("c_custkey") % 6
    address = F.when(k == 0, F.concat(F.lit("a"), F.col("c_custkey").cast("string"), F.lit("@x.org"))).when(k == 1, "a@b").when(k == 2, "a@b.c,d").when(k == 3, "a@b.c.").when(k == 4, "a@b@c.d").otherwise("nobody")
    return table(spark, sf_dir, "customer").select("c_custkey", strings.is_email(address).alias("good"), strings.email_domain(address).alias("domain"))


@query("SELECT l_orderkey, l_linenumber, CAST(length(split_part(CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR), '.', 2)) AS INTEGER) AS places, regexp_replace(regexp_replace(CAST(CAST(l_discount * 100 AS DECIMAL(18,4)) AS VARCHAR), '0+$', ''), '\\.$', '') AS plain, round(l_quantity - 0.05, 6) AS low, round(l_quantity + 0.05, 6) AS high, l_quantity AS cut_low, l_quantity + 0.1 AS cut_high FROM lineitem")
def digits_and_ranges(spark, sf_dir):
    q = F.col("l_quantity")
    near, cut = rounding.roundable_to(q, 1), rounding.truncatable_to(q, 1)
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", rounding.decimal_places(F.col("l_extendedprice").cast("decimal(18,2)").cast("string")).alias("places"), rounding.plain_decimal((F.col("l_discount") * 100).cast("decimal(18,4)")).alias("plain"),
        F.round(near["low"], 6).alias("low"), F.round(near["high"], 6).alias("high"), cut["low"].alias("cut_low"), cut["high"].alias("cut_high"),
    )
