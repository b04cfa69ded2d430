"""Queries on raw documents: HTML to text, delimited blocks and labelled lines in texts, e-mail addresses, escapes."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.functions import convert, strings
from strandline.plans.registry import query, table
from strandline.sources.documents import html_to_text as _html_to_text


@query()
def html_to_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", _html_to_text()(F.col("html")).alias("text"))


@query("""SELECT doc_id, CAST(len(regexp_extract_all(text, '[A-Za-z0-9._]+@[A-Za-z0-9.]+[A-Za-z0-9]')) AS INTEGER) AS addresses,
    regexp_extract(text, '[A-Za-z0-9._]+@([A-Za-z0-9.]+[A-Za-z0-9])', 1) AS first_domain FROM documents WHERE text LIKE '%@%'""")
def email_addresses(spark, sf_dir):
    found = F.regexp_extract_all("text", F.lit(r"[A-Za-z0-9._]+@[A-Za-z0-9.]+[A-Za-z0-9]"), F.lit(0))
    first = F.coalesce(strings.email_domain(F.get(found, F.lit(0))), F.lit(""))
    return table(spark, sf_dir, "documents").filter(F.col("text").contains("@")).select("doc_id", F.size(found).alias("addresses"), first.alias("first_domain"))


@query("SELECT doc_id, len(regexp_extract_all(text, '(?m)[ \\t]+$')) > 0 AS had_trailing, regexp_replace(text, '(?m)[ \\t]+$', '', 'g') AS text FROM documents WHERE doc_id IS NOT NULL")
def rstrip_lines(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").filter("doc_id is not null").select("doc_id", (F.regexp_count(t, F.lit(r"(?m)[ \t]+$")) > 0).alias("had_trailing"), F.regexp_replace(t, r"(?m)[ \t]+$", "").alias("text"))


@query("SELECT page_id, replace(replace(replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;') AS url FROM pages")
def webified_urls(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", strings.webify(F.col("url")).alias("url"))


_NAME = "replace(c_name, '#', '-')"


def _records(spark, sf_dir):
    """A text for each customer with labelled lines and a block of comma-separated ones."""
    c, line = F.col, lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y.cast("string") for y in x])
    lines = [line("Name: ", F.replace(c("c_name"), F.lit("#"), F.lit("-"))), line("  Balance: ", c("c_acctbal")), line("Key: ", c("c_custkey")), line("Good: ", F.when(c("c_acctbal") > 0, "yes").otherwise("no")),
             F.lit("Block"), F.lit("first,second"), line(c("c_custkey"), ',"', c("c_mktsegment"), ', ""x"""'), line("q,", c("c_nationkey")), F.lit(""), F.lit("after,this")]
    return strings.lines_of(table(spark, sf_dir, "customer").select("c_custkey", F.concat_ws("\n", *lines).alias("text")), "c_custkey", "text")


@query(f"SELECT c_custkey, {_NAME} AS name, c_custkey AS key, c_acctbal > 0 AS good, CAST(c_custkey AS VARCHAR) AS after_balance, 4 AS n_between FROM customer")
def labelled_lines(spark, sf_dir):
    """Several things found in each text by one pass over its lines."""
    lines = strings.between_lines(_records(spark, sf_dir), "c_custkey", "inside", "Name:", ["Block"])
    lines = lines.withColumn("next", strings.shifted_line("c_custkey", 1))
    out = lines.groupBy("c_custkey").agg(
        strings.following("Name:").alias("name"), strings.following("Key:").alias("key"), strings.following("Good:").alias("good"),
        strings.following("  Balance:", other="Key:", there="next").alias("after_balance"), F.count_if("inside").cast("int").alias("n_between"),
    )
    out = out.filter("name IS NOT NULL AND key IS NOT NULL AND good IS NOT NULL AND after_balance IS NOT NULL AND n_between > 0")
    return out.withColumns({"key": convert.to_int(F.col("key")), "good": convert.to_bool(F.col("good"))})


@query("""SELECT c_custkey, CAST(c_custkey AS VARCHAR) AS first, c_mktsegment || ', "x"' AS second FROM customer UNION ALL SELECT c_custkey, 'q', CAST(c_nationkey AS VARCHAR) FROM customer""")
def csv_blocks(spark, sf_dir):
    return strings.csv_block(_records(spark, sf_dir), "c_custkey", "first,second").select("c_custkey", "row.first", "row.second")


@query(r"""SELECT doc_id, replace(replace(replace(text, '\', '\\'), chr(10), '\n'), chr(13), '\r') AS lines, replace(replace(replace(replace(text, '\', '\\'), chr(10), '\n'), chr(13), '\r'), chr(9), '\t') AS tabs,
    text AS back, replace(text, chr(10), chr(13) || chr(10)) AS windows, text AS unix, regexp_replace(text, '[^\p{Lu}]', '', 'g') AS capitals FROM documents WHERE text IS NOT NULL""")
def escapes_and_line_ends(spark, sf_dir):
    t = F.col("text")
    tabs, windows = strings.escape_tabs_newlines(t), strings.line_endings(t, windows=True)
    return table(spark, sf_dir, "documents").filter("text is not null").select(
        "doc_id", strings.escape_newlines(t).alias("lines"), tabs.alias("tabs"), strings.unescape(tabs).alias("back"), windows.alias("windows"), strings.line_endings(windows).alias("unix"), strings.characters_of(t, "Lu").alias("capitals")
    )


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS k FROM documents WHERE text IS NOT NULL)
    SELECT doc_id, CAST(min(CASE WHEN starts_with(line, 'The') THEN k END) AS INTEGER) AS beginning, CAST(min(CASE WHEN contains(line, 'the ') THEN k END) AS INTEGER) AS containing, count(*) FILTER (trim(line) <> '' AND NOT starts_with(trim(line), '#')) AS code_lines, count(*) FILTER (trim(line) = '') AS blank FROM l GROUP BY doc_id""")
def line_searches(spark, sf_dir):
    lines = strings.lines_of(table(spark, sf_dir, "documents").filter("text is not null"), "doc_id", "text")
    line = F.col("line")
    first = lambda test: F.min(F.when(test, F.col("line_no")))
    return lines.groupBy("doc_id").agg(
        first(line.startswith("The")).alias("beginning"), first(line.contains("the ")).alias("containing"), F.count(strings.without_comment(line, at_start_only=True)).alias("code_lines"), F.count_if(convert.blank_to_null(line).isNull()).alias("blank")
    )
