"""Strings: searching, chunks, escapes, sizes, names of spreadsheet columns, e-mail addresses, lines of a text."""

from __future__ import annotations

import gzip
import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Symbols of powers of 1024.
SIZES = ["", "Ki", "Mi", "Gi", "Ti", "Pi", "Ei", "Zi"]


def find_nth(text: Column, part: str, n: int = 0) -> Column:
    """Place (from 0) of occurrence n (from 0, not overlapping), or -1."""
    pieces = F.split(text, F.lit(f"\\Q{part}\\E"), -1)
    before = F.array_join(F.slice(pieces, 1, n + 1), part)
    return F.when(F.size(pieces) > n + 1, F.length(before)).otherwise(-1)


def split_chunks(text: Column, n: int) -> Column:
    """Consecutive pieces of n characters; the last may be shorter."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(.{{1,{n}}})"), F.lit(1))


def escape_newlines(text: Column) -> Column:
    r"""Backslash, line feed and return as ``\\``, ``\n`` and ``\r``."""
    for a, b in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def escape_tabs_newlines(text: Column) -> Column:
    return F.replace(escape_newlines(text), F.lit("\t"), F.lit("\\t"))


def unescape(text: Column) -> Column:
    """Inverse of both: a character after a backslash is taken as one."""
    pieces = F.regexp_extract_all(text, F.lit(r"(?s)(\\.|[^\\]+|\\$)"), F.lit(1))
    plain = lambda p: F.when(p == "\\n", "\n").when(p == "\\r", "\r").when(p == "\\t", "\t").when(p.startswith("\\") & (F.length(p) == 2), F.substring(p, 2, 1)).otherwise(p)
    return F.array_join(F.transform(pieces, plain), "")


def tsv_escape(x: Column) -> Column:
    r"""Null as nothing, tab and line feed as ``\t`` and ``\n``."""
    text = F.coalesce(x.cast("string"), F.lit(""))
    return F.replace(F.replace(text, F.lit("\t"), F.lit("\\t")), F.lit("\n"), F.lit("\\n"))


def tsv_row(*columns: Column) -> Column:
    return F.concat_ws("\t", *map(tsv_escape, columns))


def tsv_pairs(line: Column, lower: bool = True) -> Column:
    """A line of key, tab, value, tab, ... as a map; an odd last piece is left out, and of equal keys the last wins."""
    cells = F.split(line, "\t", -1)
    count = F.floor(F.size(cells) / 2).cast("int")
    pairs = F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.struct((F.lower(F.get(cells, 2 * i)) if lower else F.get(cells, 2 * i)).alias("k"), F.get(cells, 2 * i + 1).alias("v"))))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["k"] == p["k"]))
    return F.map_from_entries(last)


def webify(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def without_comment(line: Column, at_start_only: bool = False) -> Column:
    """A line without what follows a hash sign, trimmed; null if nothing is left."""
    text = F.when(F.trim(line).startswith("#"), "").otherwise(F.trim(line)) if at_start_only else F.trim(F.split_part(line, F.lit("#"), F.lit(1)))
    return F.nullif(text, F.lit(""))


def size_text(n: Column, suffix: str = "B") -> Column:
    """A number of bytes with one decimal and a binary prefix."""
    out = F.format_string(f"%.1fYi{suffix}", n / 1024.0**8)
    for k, symbol in reversed(list(enumerate(SIZES))):
        out = F.when(F.abs(n) < 1024.0 ** (k + 1), F.format_string(f"%3.1f{symbol}{suffix}", n / 1024.0**k)).otherwise(out)
    return out


#: Symbols of powers of 1024 in several styles.
SYMBOLS = {
    "customary": ["B", "K", "M", "G", "T", "P", "E", "Z", "Y"],
    "customary_ext": ["byte", "kilo", "mega", "giga", "tera", "peta", "exa", "zetta", "iotta"],
    "iec": ["Bi", "Ki", "Mi", "Gi", "Ti", "Pi", "Ei", "Zi", "Yi"],
    "iec_ext": ["byte", "kibi", "mebi", "gibi", "tebi", "pebi", "exbi", "zebi", "yobi"],
}


def bytes_text(n: Column, symbols: str = "customary", form: str = "%.1f %s") -> Column:
    """A number of bytes, rounded down, with the symbol of the largest power of 1024 in it; negative numbers are an error."""
    whole = F.floor(n).cast("double")
    out = F.format_string(form, whole, F.lit(SYMBOLS[symbols][0]))
    for k, symbol in enumerate(SYMBOLS[symbols][1:], 1):
        out = F.when(whole >= 1024.0**k, F.format_string(form, whole / 1024.0**k, F.lit(symbol))).otherwise(out)
    return F.when(n < 0, F.raise_error("a negative number of bytes").cast("string")).otherwise(out)


def bytes_from_text(text: Column) -> Column:
    """Inverse of ``bytes_text`` in any style, ``k`` standing for ``K``; null if it is none of them."""
    number, symbol = F.regexp_extract(text, r"^\s*([0-9.]+)", 1).try_cast("double"), F.trim(F.regexp_replace(text, r"^\s*[0-9.]+", ""))
    power = F.lit(None).cast("double")
    for own in SYMBOLS.values():
        for k, s in enumerate(own):
            power = F.when(symbol == s, F.lit(1024.0**k)).otherwise(power)
    power = F.when(symbol == "k", F.lit(1024.0)).otherwise(power)
    return F.floor(number * power).cast("bigint")


def numbered(prefix: str, number: Column, suffix: str = "") -> Column:
    """Prefix, number and suffix as one text."""
    return F.concat(F.lit(prefix), number.cast("string"), F.lit(suffix))


def numbered_all(prefix: str, numbers: Column, suffix: str = "") -> Column:
    """``numbered`` for each number of an array."""
    return F.transform(numbers, lambda n: numbered(prefix, n, suffix))


def numbered_range(prefix: str, first: Column, last: Column, suffix: str = "") -> Column:
    """``numbered`` for the numbers from first to last; none if last is before first."""
    return F.when(first <= last, numbered_all(prefix, F.sequence(first, last), suffix)).otherwise(F.array().cast("array<string>"))


def whole_as_integer(x: Column) -> Column:
    """A number as text, without a fraction where that is nought."""
    return F.when(x == F.floor(x), F.floor(x).cast("string")).otherwise(x.cast("string"))


def line_endings(text: Column, windows: bool = False) -> Column:
    """All ends of lines as LF, or as CR and LF."""
    return F.regexp_replace(text, r"\r\n|\r|\n", "\r\n" if windows else "\n")


def characters_of(text: Column, category: str) -> Column:
    """The characters of a Unicode category (such as L, Lu or Nd), in order."""
    return F.array_join(F.regexp_extract_all(text, F.lit(rf"(\p{{{category}}})"), F.lit(1)), "")


def wrapped(width: int):
    """Arrow UDF: text as one line, broken between words to lines of at most ``width`` characters (0: as it is)."""
    import textwrap

    def work(texts: pd.Series) -> pd.Series:
        return texts.map(lambda s: s if s is None or not width else "\n".join(textwrap.wrap(" ".join(s.split("\n")), width, break_long_words=False, break_on_hyphens=False)))

    return F.pandas_udf(work, "string")


def csv_block(lines: DataFrame, key: str, header: str, quote: str = '"') -> DataFrame:
    """Rows (key, line_no, row) of a block of comma-separated lines inside a text: from the line that is the header (its
    fields name the struct's) to the next blank line."""
    text = Window.partitionBy(key)
    met = lines.withColumn("_from", F.min(F.when(F.col("line").startswith(header), F.col("line_no"))).over(text)).filter("line_no > _from")
    met = met.withColumn("_to", F.min(F.when(F.trim("line") == "", F.col("line_no"))).over(text))
    inside = met.filter((F.col("_to").isNull() | (F.col("line_no") < F.col("_to"))) & F.col(key).isNotNull())
    schema = ", ".join(f"`{name}` string" for name in header.split(","))
    return inside.select(key, "line_no", F.from_csv("line", schema, {"quote": quote, "escape": quote}).alias("row"))


def column_letters(number: Column) -> Column:
    """0 as A, 25 as Z, 26 as AA, and so on for any number of letters; null for negative numbers."""
    none = F.struct((number.cast("bigint") + 1).alias("left"), F.lit("").alias("text"))
    step = lambda s, _: F.when(
        s["left"] > 0, F.struct(F.floor((s["left"] - 1) / 26).cast("bigint").alias("left"), F.concat(F.char(F.lit(65) + F.pmod(s["left"] - 1, F.lit(26))), s["text"]).alias("text"))
    ).otherwise(s)
    return F.when(number >= 0, F.aggregate(F.sequence(F.lit(1), F.lit(14)), none, step, lambda s: s["text"]))


def column_number(letters: Column) -> Column:
    """Inverse of ``column_letters``."""
    return F.aggregate(F.split(F.upper(letters), ""), F.lit(0).cast("bigint"), lambda s, c: s * 26 + F.ascii(c) - 64) - 1


def is_email(address: Column) -> Column:
    """Something, one @, a domain with a dot, no comma, no stop at the end."""
    one = F.length(address) - F.length(F.replace(address, F.lit("@"), F.lit(""))) == 1
    return F.coalesce(address.rlike(r"^[^@]+@[^@]+\.[^@]+") & one & ~address.contains(",") & ~address.endswith("."), F.lit(False))


def email_domain(address: Column) -> Column:
    return F.split_part(address, F.lit("@"), F.lit(2))


def what_follows(text: Column, prefix: str) -> Column:
    """What follows a prefix at the start, trimmed; null if it isn't there."""
    return F.when(text.startswith(prefix), F.trim(F.substring(text, len(prefix) + 1, 1 << 30)))


def lines_of(df: DataFrame, key: str, text: str) -> DataFrame:
    """Rows (key, line_no from 0, line) of a text column."""
    return df.select(key, F.posexplode(F.split(text, "\n", -1)).alias("line_no", "line"))


def following(prefix: str, line: str = "line", other: str | None = None, there: str | None = None) -> Column:
    """Aggregate over a key's lines: what follows the prefix in its first line that starts with it; with ``other``, what follows
    that in column ``there`` of the first line where both start so. Null if there is none."""
    met = F.col(line).startswith(prefix)
    if other is not None:
        met = met & F.col(there).startswith(other)
    return F.min_by(what_follows(F.col(there or line), other or prefix), F.when(met, F.col("line_no")))


def shifted_line(key: str, delta: int) -> Column:
    """The line ``delta`` lines after each, within its key."""
    there = F.lead("line", delta) if delta >= 0 else F.lag("line", -delta)
    return there.over(Window.partitionBy(key).orderBy("line_no"))


def first_following(lines: DataFrame, key: str, prefix: str, preceding: str | None = None) -> DataFrame:
    """Of each key what follows the prefix in its first line that starts with it (after a line starting with ``preceding``)."""
    if preceding is not None:
        lines = lines.withColumn("_before", F.lag("line").over(Window.partitionBy(key).orderBy("line_no"))).filter(F.col("_before").startswith(preceding))
    return lines.groupBy(key).agg(following(prefix).alias("found")).filter("found IS NOT NULL")


def relative_line(lines: DataFrame, key: str, prefix: str, delta: int, other: str) -> DataFrame:
    """What follows ``other`` in the line ``delta`` lines after the first that starts with the prefix, where it does."""
    met = lines.withColumn("_there", shifted_line(key, delta))
    return met.groupBy(key).agg(following(prefix, other=other, there="_there").alias("found")).filter("found IS NOT NULL")


def between_lines(lines: DataFrame, key: str, name: str, first: str, last: Sequence[str]) -> DataFrame:
    """``lines`` with a column that says whether each stands from the key's first that starts with ``first`` up to, without it,
    the next that starts with one of ``last``. A key's lines are one window: no table is joined, whatever the plan takes it for."""
    text = Window.partitionBy(key)
    ends = F.lit(False)
    for x in last:
        ends = ends | F.col("line").startswith(x)
    met = lines.withColumn("_from", F.min(F.when(F.col("line").startswith(first), F.col("line_no"))).over(text))
    met = met.withColumn("_to", F.min(F.when(ends & (F.col("line_no") > F.col("_from")), F.col("line_no"))).over(text))
    inside = F.coalesce(F.col("line_no") >= F.col("_from"), F.lit(False)) & (F.col("_to").isNull() | (F.col("line_no") < F.col("_to")))
    return met.withColumn(name, inside).drop("_from", "_to")


def lines_between(lines: DataFrame, key: str, first: str, last: Sequence[str]) -> DataFrame:
    """Lines from the first that starts with ``first`` up to, without it, the next that starts with one of ``last``."""
    return between_lines(lines, key, "_inside", first, last).filter(F.col("_inside") & F.col(key).isNotNull()).select(key, "line_no", "line")


def ascii_mangle():
    """Arrow UDF: text without accents and other characters beyond ASCII; null as nothing."""

    def work(texts: pd.Series) -> pd.Series:
        return texts.map(lambda s: "" if s is None else unicodedata.normalize("NFKD", s).encode("ascii", "ignore").decode())

    return F.pandas_udf(work, "string")


def multiple_replace(replacements: dict[str, str]):
    """Arrow UDF: all replacements in one pass, the first that fits at each place, in the order given."""
    import re

    pattern = "|".join(map(re.escape, replacements))

    def work(texts: pd.Series) -> pd.Series:
        return texts.str.replace(pattern, lambda m: replacements[m.group()], regex=True)

    return F.pandas_udf(work, "string")


def line_added(text: Column, line: str) -> Column:
    """The text with a line at its end, unless it has that line already; null counts as empty."""
    own = F.coalesce(text, F.lit(""))
    gap = F.when((own == "") | own.endswith("\n"), "").otherwise("\n")
    return F.when(F.array_contains(F.split(own, "\n"), line), own).otherwise(F.concat(own, gap, F.lit(line + "\n")))


def concatenated(df: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """Rows (key, text): each key's texts one behind the other, in order (of equal ones the smaller first)."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t")))), lambda x: x["t"])
    return df.groupBy(key).agg(F.array_join(parts, "").alias(text))


def random_text(length: int, *key: Column, characters: str = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", seed: int = 0) -> Column:
    """Characters drawn by a hash of the key: the same for the same key and seed."""
    letters = F.array(*map(F.lit, characters))
    draw = lambda k: F.get(letters, F.pmod(F.xxhash64(*key, F.lit(seed), k), F.lit(len(characters))).cast("int"))
    return F.array_join(F.transform(F.sequence(F.lit(1), F.lit(length)), draw), "") if length else F.lit("")


def gzipped():
    """Arrow UDF: the text in UTF-8, compressed; equal texts give equal bytes."""
    return F.pandas_udf(lambda s: s.map(lambda x: None if x is None else gzip.compress(x.encode(), mtime=0)), "binary")


def gunzipped():
    """Arrow UDF: the text that was compressed."""
    return F.pandas_udf(lambda s: s.map(lambda x: None if x is None else gzip.decompress(x).decode()), "string")
