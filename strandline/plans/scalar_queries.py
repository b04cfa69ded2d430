"""Scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.functions import convert, dates, dsp, hashing, probability, rounding, rpm, strings
from strandline.plans.registry import query, table


@query("SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d FROM orders")
def extract_year_month_day(spark, sf_dir):
    d = F.col("o_orderdate")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.year(d).alias("y"), F.month(d).alias("m"), F.dayofmonth(d).alias("d"))


@query("SELECT o_orderkey, o_orderdate - CAST(day(o_orderdate) - 1 AS INTEGER) * interval 1 day AS first_day FROM orders")
def truncate_month(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", dates.first_of_month(F.col("o_orderdate")).alias("first_day"))


@query("SELECT o_orderkey, 2024 - year(o_orderdate) - CASE WHEN month(o_orderdate) > 6 OR (month(o_orderdate) = 6 AND day(o_orderdate) > 15) THEN 1 ELSE 0 END AS age FROM orders")
def age_years(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", dates.age_years(F.col("o_orderdate"), F.lit("2024-06-15").cast("date")).alias("age"))


@query("SELECT o_orderkey, printf('%02dd %02dh %02dm %02ds', s // 86400, (s // 3600) % 24, (s // 60) % 60, s % 60) AS length FROM (SELECT o_orderkey, o_orderkey * 37 AS s FROM orders)")
def duration_parts(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", dates.duration_text(F.col("o_orderkey") * 37).alias("length"))


_D = "CAST(x AS DECIMAL(28,9))"


@query(f"SELECT l_orderkey, l_linenumber, CAST(floor({_D} * 10 + 0.5) / 10 AS DECIMAL(28,9)) AS up, sign(x) * floor(abs(x) * 10.0 + 0.5) / CAST(10 AS DOUBLE) AS away, (CASE WHEN x >= 0 THEN floor(x * 10.0) ELSE ceil(x * 10.0) END) / CAST(10 AS DOUBLE) AS cut FROM (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN -l_extendedprice ELSE l_extendedprice END AS x FROM lineitem)".replace("* 10.0", "* CAST(10 AS DOUBLE)").replace(f"CAST(floor({_D} * 10 + 0.5) / 10 AS DECIMAL(28,9))", f"CAST(CAST(floor({_D} * 10 + 0.5) AS DECIMAL(28,0)) * 0.1 AS DECIMAL(28,9))"))
def rounding_rules(spark, sf_dir):
    x = F.when(F.col("l_linenumber") % 2 == 0, -F.col("l_extendedprice")).otherwise(F.col("l_extendedprice"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", rounding.round_half_up(x, 1).alias("up"), rounding.normal_round(x, 1).alias("away"), rounding.truncate(x, 1).alias("cut"))


@query("""WITH e AS (SELECT event_id, event_type, value / 100 AS x FROM events), p AS (SELECT event_id, exp(x - avg(x) OVER (PARTITION BY event_type)) AS p, event_type FROM e)
    SELECT event_id, round(p / sum(p) OVER (PARTITION BY event_type), 9) AS softmax FROM p""")
def softmax_by_group(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "event_type", (F.col("value") / 100).alias("x"))
    return probability.softmax(events, ["event_type"], "x").select("event_id", rounding.round_scaled(F.col("softmax"), 9).alias("softmax"))


@query("SELECT event_id, round(1 / (1 + exp(-0.05 * (value - 50))), 9) AS y, CASE WHEN value < 0 OR value > 100 THEN NULL WHEN value = 0 THEN CAST('-inf' AS DOUBLE) WHEN value = 100 THEN CAST('inf' AS DOUBLE) ELSE round(ln(value / 100 / (1 - value / 100)), 6) END AS logit FROM events")
def logistic(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return events.select("event_id", rounding.round_scaled(probability.logistic(F.col("value"), 0.05, 50.0), 9).alias("y"), rounding.round_scaled(probability.safe_logit(F.col("value") / 100), 6).alias("logit"))


@query("SELECT doc_id, round(sum(CASE WHEN toxic = 1 THEN ln(CAST(0.8 AS DOUBLE)) - ln(CAST(0.1 AS DOUBLE)) ELSE ln(CAST(0.2 AS DOUBLE)) - ln(CAST(0.9 AS DOUBLE)) END) OVER (ORDER BY doc_id), 6) AS log_odds FROM labels WHERE toxic IS NOT NULL")
def log_odds_update(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").filter("toxic is not null").select("doc_id", "toxic")
    out = probability.running_log_odds(labels, [], ["doc_id"], F.col("toxic") == 1, 0.8, 0.1)
    return out.select("doc_id", rounding.round_scaled(F.col("log_odds"), 6).alias("log_odds"))


@query("SELECT event_type, round(avg(CASE WHEN value > 10 THEN value END), 6) AS mean, count(*) FILTER (value > 50) AS n_true, count(*) > count(DISTINCT user_id) AS repeats FROM events GROUP BY event_type")
def mean_count_repeats(spark, sf_dir):
    v = F.col("value")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(rounding.round_scaled(F.avg(F.when(v > 10, v)), 6).alias("mean"), F.count_if(v > 50).alias("n_true"), (F.count(F.lit(1)) > F.count_distinct("user_id")).alias("repeats"))


@query("""WITH w AS (SELECT conv_id, turn, string_split(text, ' ') AS a FROM conversations WHERE text IS NOT NULL)
    SELECT conv_id, turn, CAST(len(list_distinct(a)) AS INTEGER) AS kinds, CAST(ceil(len(a) / 5) AS INTEGER) AS chunks, array_to_string(a[1:5], ' ') AS first_chunk, array_to_string([a[i] for i in range(1, len(a) + 1) if i <> 1 and i <> 3], ' ') AS rest FROM w""")
def list_ops(spark, sf_dir):
    a = F.split("text", " ")
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / 5).cast("int")), lambda i: F.slice(a, 5 * i + 1, 5))
    return table(spark, sf_dir, "conversations").filter("text is not null").select(
        "conv_id", "turn", F.size(F.array_distinct(a)).alias("kinds"), F.size(chunks).alias("chunks"), F.array_join(F.get(chunks, F.lit(0)), " ").alias("first_chunk"), F.array_join(F.filter(a, lambda x, i: ~i.isin(0, 2)), " ").alias("rest")
    )


@query("""WITH s AS (SELECT doc_id, string_split(text, 'the') AS p, text FROM documents WHERE text IS NOT NULL)
    SELECT doc_id, CAST(CASE WHEN len(p) > 3 THEN length(array_to_string(p[1:3], 'the')) ELSE -1 END AS INTEGER) AS third, CAST(len(regexp_extract_all(text, '(?s).{1,100}')) AS INTEGER) AS pieces, replace(replace(text, chr(9), '\\t'), chr(10), '\\n') AS escaped FROM s""")
def find_nth_chunks_escape(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", strings.find_nth(t, "the", 2).alias("third"), F.size(strings.split_chunks(t, 100)).alias("pieces"), strings.tsv_escape(t).alias("escaped"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents WHERE text IS NOT NULL),
    m AS (SELECT doc_id, trim(substr(line, 5)) AS found, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS z FROM l WHERE line LIKE 'The %') SELECT doc_id, found FROM m WHERE z = 1""")
def what_follows(spark, sf_dir):
    lines = strings.lines_of(table(spark, sf_dir, "documents").filter("text is not null"), "doc_id", "text")
    return strings.first_following(lines, "doc_id", "The ")


@query("""WITH n AS (SELECT c_custkey, 100000000 + (c_custkey * 7919) % 899999999 AS s FROM customer), d AS (SELECT c_custkey, CAST(s AS VARCHAR) AS s, 11 - list_sum([CAST(substr(CAST(s AS VARCHAR), CAST(i + 1 AS BIGINT), 1) AS INTEGER) * (10 - i) for i in range(9)]) % 11 AS k FROM n)
    SELECT c_custkey, CAST(CASE WHEN k = 11 THEN 0 ELSE k END AS INTEGER) AS digit, CASE WHEN k <> 10 THEN CAST(s || CASE WHEN k = 11 THEN 0 ELSE k END AS BIGINT) END AS number FROM d""")
def nhs_checksum(spark, sf_dir):
    nine = (F.lit(100000000) + (F.col("c_custkey") * 7919) % 899999999).cast("string")
    return table(spark, sf_dir, "customer").select("c_custkey", convert.nhs_check_digit(nine).cast("int").alias("digit"), convert.nhs_from_first_nine(nine).alias("number"))


@query("SELECT c_custkey, md5('pepper' || c_name) AS m, sha256('pepper' || c_name) AS s FROM customer")
def salted_hash(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", hashing.salted(F.col("c_name"), "pepper", "md5").alias("m"), hashing.salted(F.col("c_name"), "pepper").alias("s"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, CAST(json_extract_string(props, '$.k') AS BIGINT) % 7 AS week FROM events")
def json_props(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), (convert.to_int(F.get_json_object("props", "$.k")) % 7).alias("week"))


_LETTERS = " || ".join(f"CASE WHEN c_custkey >= {sum(26**j for j in range(1, k + 1))} THEN chr(CAST(65 + (c_custkey - {sum(26**j for j in range(1, k + 1))}) // {26**k} % 26 AS INTEGER)) ELSE '' END" for k in range(6, 0, -1))


@query(f"SELECT c_custkey, {_LETTERS} || chr(CAST(65 + c_custkey % 26 AS INTEGER)) AS letters, c_custkey AS back FROM (SELECT c_custkey * 1009 AS c_custkey FROM customer)")
def spreadsheet_columns(spark, sf_dir):
    letters = strings.column_letters(F.col("c_custkey"))
    return table(spark, sf_dir, "customer").select((F.col("c_custkey") * 1009).alias("c_custkey")).select("c_custkey", letters.alias("letters"), strings.column_number(letters).alias("back"))


@query("SELECT o_orderkey, '''' || replace(o_orderpriority, '''', '''''') || '''' AS text, '''' || strftime(o_orderdate, '%Y-%m-%d') || '''' AS day FROM orders")
def sql_literals(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", convert.sql_string(F.col("o_orderpriority")).alias("text"), convert.sql_date(F.col("o_orderdate")).alias("day"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN true WHEN c_custkey % 4 = 1 THEN false WHEN c_custkey % 4 = 2 THEN NULL ELSE c_acctbal <> 0 END AS flag, CAST(trunc(c_acctbal) AS BIGINT) AS whole FROM customer")
def conversions(spark, sf_dir):
    word = F.when(F.col("c_custkey") % 4 == 0, "yes").when(F.col("c_custkey") % 4 == 1, "F").when(F.col("c_custkey") % 4 == 2, "").otherwise(F.col("c_acctbal").cast("string"))
    return table(spark, sf_dir, "customer").select("c_custkey", convert.to_bool(word).alias("flag"), convert.to_int(F.col("c_acctbal")).alias("whole"))


_TAPS = dsp.lowpass(9, 0.1, 1.0)


@query("SELECT event_id, round(" + " + ".join(f"CAST({c!r} AS DOUBLE) * coalesce(lag(value, {k}) OVER w, 0)" for k, c in enumerate(_TAPS)) + ", 6) AS filtered FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def fir_lowpass(spark, sf_dir):
    out = dsp.filtered(table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value"), ["user_id"], ["ts", "event_id"], "value", _TAPS)
    return out.select("event_id", rounding.round_scaled(F.col("filtered"), 6).alias("filtered"))


@query()
def rpm_two_choice(spark, sf_dir):
    won = F.count_if(F.col("value") > 50)
    counts = table(spark, sf_dir, "events").filter("user_id is not null").groupBy(F.pmod("user_id", F.lit(10)).alias("arm_set"), F.pmod("user_id", F.lit(2)).alias("arm"))
    counts = counts.agg(won.alias("won"), F.count(F.lit(1)).alias("n")).withColumn("arm_set", F.floor(F.col("arm_set") / 2)).groupBy("arm_set", "arm").agg(F.sum("won").alias("won"), F.sum(F.col("n") - F.col("won")).alias("lost"))
    return rpm.choice_probabilities(counts, "arm_set", "arm", "won", "lost")


def _hmac_sql(digest: str) -> str:
    """HMAC of c_name under the key of the query, by its definition."""
    blob = lambda mask: "".join(f"\\x{b ^ mask:02X}" for b in b"secret".ljust(64, b"\0"))
    return f"{digest}('{blob(0x5C)}'::BLOB || unhex({digest}('{blob(0x36)}'::BLOB || encode(c_name))))"


@query(f"SELECT c_custkey, {_hmac_sql('sha256')} AS by_sha256, {_hmac_sql('md5')} AS by_md5 FROM customer")
def keyed_hashes(spark, sf_dir):
    name = F.col("c_name")
    return table(spark, sf_dir, "customer").select("c_custkey", hashing.make_hasher("HMAC_SHA256", "secret")(name).alias("by_sha256"), hashing.make_hasher("HMAC_MD5", "secret")(name).alias("by_md5"))


@query()
def long_murmur_hashes(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", hashing.murmur64()(F.col("c_name")).alias("murmur"))


@query()
def keyed_and_murmur_hashes(spark, sf_dir):
    name = F.col("c_name")
    return table(spark, sf_dir, "customer").select("c_custkey", hashing.keyed("secret")(name).alias("hmac"), hashing.murmur32()(name).alias("murmur"), strings.ascii_mangle()(name).alias("plain"))
