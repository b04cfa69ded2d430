"""Queries over files that are first written from a given table to the shared folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.operators.storage import new_folder
from strandline.plans.registry import query, table
from strandline.sources import archives, delimited, documents, encodings


@query("SELECT page_id, strlen(html) AS size, md5(html) AS digest FROM pages WHERE html IS NOT NULL AND page_id IS NOT NULL")
def zipped_pages(spark, sf_dir):
    """Pages written as members of zips, and read back a member at a time."""
    folder = new_folder(spark, "zips")
    pages = table(spark, sf_dir, "pages").filter("html IS NOT NULL AND page_id IS NOT NULL")
    archives.write_zips(pages.select(archives.inner_name(F.col("page_id"), ".html").alias("name"), "html").repartition(4, "name"), folder, "name", "html")
    found = archives.members(spark, folder, "pages/*.html", ("member", "size", "content"))
    return found.select(F.regexp_extract("member", r"(\d+)\.html$", 1).cast("bigint").alias("page_id"), "size", F.md5("content").alias("digest"))


@query("SELECT page_id, count(*) OVER () AS members FROM pages WHERE html IS NOT NULL AND page_id IS NOT NULL")
def zip_listing(spark, sf_dir):
    """Only names are asked for, so no member is unpacked."""
    folder = new_folder(spark, "zips")
    pages = table(spark, sf_dir, "pages").filter("html IS NOT NULL AND page_id IS NOT NULL")
    archives.write_zips(pages.select(archives.inner_name(F.col("page_id"), ".txt").alias("name"), "html").repartition(3, "name"), folder, "name", "html")
    names = archives.members(spark, folder, columns=("member",))
    n = names.agg(F.count(F.lit(1))).scalar()
    return names.select(F.regexp_extract("member", r"(\d+)\.txt$", 1).cast("bigint").alias("page_id"), n.alias("members"))


_PLAIN = "'Line <1> & ' || c_name || chr(10) || 'of ' || c_mktsegment"


@query(f"""SELECT kind, c_custkey, CASE kind WHEN 'xml' THEN replace({_PLAIN}, chr(10), ' ') WHEN 'eml' THEN {_PLAIN} || chr(10) ELSE {_PLAIN} END AS text
    FROM customer, (VALUES ('txt'), ('html'), ('xml'), ('eml'), ('docx'), ('odt'), ('bin')) k(kind) WHERE c_nationkey = 7""")
def documents_of_all_kinds(spark, sf_dir):
    """One customer's text as a plain, HTML, XML, e-mail, DOCX, ODT and unknown file each, in zips, read by extension."""
    folder = new_folder(spark, "documents")
    people = table(spark, sf_dir, "customer").filter("c_nationkey = 7")
    text = F.concat(F.lit("Line <1> & "), "c_name", F.lit("\nof "), "c_mktsegment")
    kinds = F.explode(F.array(*map(F.lit, ("txt", "html", "xml", "eml", "docx", "odt", "bin")))).alias("kind")
    rows = people.select("c_custkey", text.alias("text"), kinds)
    rows = rows.select(F.concat(F.col("c_custkey").cast("string"), F.lit("."), "kind").alias("name"), documents.written(F.col("text"), F.col("kind")).alias("content"))
    archives.write_zips(rows, folder, "name", "content")
    found = archives.member_texts(archives.members(spark, folder, columns=("path", "member", "content")))
    return found.select(F.substring_index("member", ".", -1).alias("kind"), F.substring_index("member", ".", 1).cast("bigint").alias("c_custkey"), "text")


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation UNION ALL SELECT n_nationkey + 100, n_name, n_regionkey FROM nation")
def merged_delimited_files(spark, sf_dir):
    """Two delimited files of the same header, one behind the other."""
    nation, folders = table(spark, sf_dir, "nation"), [new_folder(spark, "csv") for _ in range(2)]
    nation.write.csv(folders[0], header=True)
    nation.withColumn("n_nationkey", F.col("n_nationkey") + 100).write.csv(folders[1], header=True)
    merged = delimited.merge_csv(spark, folders)
    return merged.select(*[F.col(c).cast(t).alias(c) for c, t in nation.dtypes])


@query("""SELECT c_custkey, 'code ' || c_custkey AS line FROM customer WHERE c_custkey % 3 <> 0""")
def lines_without_comments(spark, sf_dir):
    """Text files with comments and blank lines, read without them."""
    folder = new_folder(spark, "lines")
    customer = table(spark, sf_dir, "customer")
    text = F.when(F.col("c_custkey") % 3 == 0, F.lit("# only a comment")).otherwise(F.concat(F.lit("code "), F.col("c_custkey").cast("string"), F.lit(" # and why")))
    customer.select(F.concat(text, F.lit("\n")).alias("value")).write.text(folder)
    lines = delimited.read_code_lines(spark, folder)
    return lines.select(F.regexp_extract("line", r"(\d+)", 1).cast("bigint").alias("c_custkey"), F.trim("line").alias("line"))


@query("SELECT c_custkey, c_name, c_mktsegment || chr(9) || 'x' || chr(10) || 'y' AS note FROM customer")
def tab_separated_files(spark, sf_dir):
    """Values with tabs and line feeds, written escaped and read back."""
    folder = new_folder(spark, "tsv")
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.concat("c_mktsegment", F.lit("\tx\ny")).alias("note"))
    delimited.write_tsv(rows, folder)
    back = spark.read.csv(folder, sep="\t", header=True, quote="")
    return back.select(F.col("c_custkey").cast("bigint").alias("c_custkey"), "c_name", F.replace(F.replace("note", F.lit("\\t"), F.lit("\t")), F.lit("\\n"), F.lit("\n")).alias("note"))


@query("SELECT DISTINCT c_mktsegment AS line, true AS found FROM customer UNION ALL SELECT 'none of these', false")
def compressed_text_files(spark, sf_dir):
    """Compressed text files, and which lines stand in them."""
    folder = new_folder(spark, "gzip")
    segments = table(spark, sf_dir, "customer").select("c_mktsegment").distinct()
    delimited.write_gzipped_text(segments, folder)
    asked = segments.withColumnRenamed("c_mktsegment", "line").union(spark.range(1).select(F.lit("none of these")))
    there = delimited.read_lines(spark, folder).select(F.col("line").alias("_l")).distinct()
    return asked.join(there, F.col("line") == F.col("_l"), "left").select("line", F.col("_l").isNotNull().alias("found"))


@query("SELECT c_mktsegment AS segment, count(*) AS n, '.csv' AS extension FROM customer GROUP BY 1")
def listed_files(spark, sf_dir):
    """A file for each segment: names and extensions of the files, and their rows."""
    folder = new_folder(spark, "listed")
    customer = table(spark, sf_dir, "customer").select("c_mktsegment", "c_custkey")
    customer.repartition(1, "c_mktsegment").write.partitionBy("c_mktsegment").csv(folder)
    files = delimited.list_files(spark, folder, "*.csv").select(F.regexp_extract("path", "c_mktsegment=([^/]*)/", 1).alias("segment"), documents.extension(F.col("path")).alias("extension")).distinct()
    rows = spark.read.csv(folder).groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count(F.lit(1)).alias("n"))
    return files.join(rows, "segment").select("segment", "n", "extension")


_CHARSETS = ("utf-8", "utf-16-le", "cp1252", "mac-roman", "cp850")


@query(f"""SELECT page_id, charset, md5(html) AS digest FROM pages, (VALUES {", ".join(f"('{c}')" for c in _CHARSETS)}) c(charset) WHERE html IS NOT NULL""")
def pages_of_unknown_encoding(spark, sf_dir):
    """Pages as bytes of five encodings, decoded again without being told which; pairs are counted in another table."""
    bits = encodings.pair_bits(F.col("text"), table(spark, sf_dir, "documents"))
    pages = table(spark, sf_dir, "pages").filter("html IS NOT NULL").select("page_id", "html", F.explode(F.array(*map(F.lit, _CHARSETS))).alias("charset"))
    raw = pages.select("page_id", "charset", encodings.encoded(F.col("html"), F.col("charset")).alias("content"))
    return raw.select("page_id", "charset", F.md5(encodings.texts(F.col("content"), bits).cast("binary")).alias("digest"))
