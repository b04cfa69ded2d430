"""Conversions and checks of single values; health-service numbers; SQL literals and types; codes of bytes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

TRUE_WORDS, FALSE_WORDS = ["Y", "YES", "T", "TRUE"], ["N", "NO", "F", "FALSE"]


def to_bool(x: Column, default: bool | None = None) -> Column:
    """Yes and no in several spellings, numbers by whether they are zero; blank is the default, all else an error."""
    word = F.upper(F.trim(x.cast("string")))
    number = word.try_cast("double")
    wrong = F.raise_error(F.concat(F.lit("not a truth value: "), x.cast("string"))).cast("boolean")
    return F.when(F.coalesce(word, F.lit("")) == "", F.lit(default)).when(word.isin(TRUE_WORDS), True).when(word.isin(FALSE_WORDS), False).when(number.isNotNull(), number != 0).otherwise(wrong)


def to_int(x: Column, default: int | None = None) -> Column:
    """An integer (towards zero), or the default."""
    return F.coalesce(x.try_cast("bigint"), F.lit(default).cast("bigint"))


def is_integer(x: Column) -> Column:
    return x.try_cast("bigint").isNotNull()


def blank_to_null(x: Column) -> Column:
    return F.nullif(F.trim(x.cast("string")), F.lit(""))


def nulls(x: Column, values: Sequence) -> Column:
    """Null for the values that stand for it."""
    return F.when(~x.isin(list(values)), x)


def required(x: Column, message: str = "value missing") -> Column:
    return F.when(x.isNull() | (F.trim(x.cast("string")) == ""), F.raise_error(message).cast("string")).otherwise(x.cast("string"))


def number_to_dp(x: Column, dp: int, default: str = "", en_dash: bool = True) -> Column:
    """Fixed decimals, with a sign for infinity and a dash for minus."""
    text = F.when(x.isNull(), default).when(x == float("inf"), "∞").when(x == float("-inf"), "-∞").otherwise(F.format_string(f"%.{dp}f", x))
    return F.when(text.startswith("-"), F.concat(F.lit("–"), F.substring(text, 2, 1 << 30))).otherwise(text) if en_dash else text


def _once(x: Column, use) -> Column:
    """``use`` of a value that is worked out once, however often ``use`` names it."""
    return F.get(F.transform(F.array(x), use), F.lit(0))


def nhs_check_digit(nine: Column) -> Column:
    """Check digit of the nine digits of a health-service number; 10 means there is none."""

    def of(text: Column) -> Column:
        total = F.lit(0)
        for k in range(9):
            total = total + F.substring(text, k + 1, 1).cast("int") * (10 - k)
        return F.pmod(11 - F.pmod(total, F.lit(11)), F.lit(11))  # 11 stands for 0

    return _once(nine, of)


def is_valid_nhs(number: Column) -> Column:
    """Ten digits, the last of which checks the others."""

    def of(text: Column) -> Column:
        right = F.when(text.rlike(r"^[1-9]\d{9}$"), nhs_check_digit(text) == F.substring(text, 10, 1).cast("int"))
        return F.coalesce(right, F.lit(False))

    return _once(F.regexp_replace(number.cast("string"), r"\s", ""), of)


def nhs_from_first_nine(nine: Column) -> Column:
    return _once(nine, lambda text: _once(nhs_check_digit(text), lambda digit: F.when(digit < 10, F.concat(text, digit.cast("string")).cast("bigint"))))


def is_test_nhs(number: Column) -> Column:
    """Valid, and of the range that is kept for tests."""
    return _once(number, lambda n: is_valid_nhs(n) & n.cast("string").startswith("999"))


def random_nhs(*key: Column, test_range: bool = True, seed: int = 0) -> Column:
    """A valid number drawn by a hash of the key, of the range kept for tests or of any: the first of 40 draws that has a check
    digit. Draws after that aren't made."""
    low, many = (999 * 10**6, 10**6) if test_range else (10**8, 9 * 10**8)
    draw = lambda k: (F.pmod(F.xxhash64(*key, F.lit(seed), k), F.lit(many)) + F.lit(low)).cast("string")
    return F.aggregate(F.sequence(F.lit(0), F.lit(39)), F.lit(None).cast("bigint"), lambda met, k: F.when(met.isNotNull(), met).otherwise(nhs_from_first_nine(draw(k))))


def nhs_from_text(text: Column) -> Column:
    bare = F.regexp_replace(text, r"\s", "")
    return F.when(is_valid_nhs(bare), bare.try_cast("bigint"))


def hex_text(b: Column) -> Column:
    return F.concat(F.lit("X'"), F.lower(F.hex(b)), F.lit("'"))


def from_hex_text(text: Column) -> Column:
    inside = F.regexp_extract(text, r"^X'((?:[0-9a-fA-F]{2})*)'$", 1)
    return F.when(text.rlike(r"^X'([0-9a-fA-F]{2})*'$"), F.unhex(inside))


def base64_text(b: Column) -> Column:
    return F.concat(F.lit("64'"), F.base64(b), F.lit("'"))


def from_base64_text(text: Column) -> Column:
    return F.when(text.rlike(r"^64'[A-Za-z0-9+/=]*'$"), F.unbase64(F.regexp_extract(text, r"^64'(.*)'$", 1)))


def sql_string(text: Column) -> Column:
    return F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("''")), F.lit("'"))


def sql_date(d: Column) -> Column:
    return F.concat(F.lit("'"), F.date_format(d, "yyyy-MM-dd"), F.lit("'"))


def sql_datetime(t: Column, fraction: bool = False) -> Column:
    return F.concat(F.lit("'"), F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss" + (".SSSSSS" if fraction else "")), F.lit("'"))


def sql_comment(text: Column) -> Column:
    return F.regexp_replace(text, "(?m)^", "-- ")


def sql_dequoted(text: Column) -> Column:
    bad = F.raise_error("not a quoted string").cast("string")
    return F.when(text.rlike("(?s)^'.*'$"), F.replace(F.substring(text, 2, F.length(text) - 2), F.lit("''"), F.lit("'"))).otherwise(bad)


def quoted_identifier(name: Column, mark: str = "`") -> Column:
    """A name between quotation marks, those inside it doubled."""
    return F.concat(F.lit(mark), F.replace(name, F.lit(mark), F.lit(mark * 2)), F.lit(mark))


def is_field_name(name: Column) -> Column:
    """Not empty, and printable ASCII only."""
    return F.coalesce(name.rlike("^[ -~]+$"), F.lit(False))


def strings_to_csv(items: Column) -> Column:
    """An array of texts as one line of quoted cells; null and none are both the empty text."""
    quoted = F.transform(items, lambda x: F.concat(F.lit('"'), F.replace(F.coalesce(x, F.lit("")), F.lit('"'), F.lit('""')), F.lit('"')))
    return F.coalesce(F.array_join(quoted, ","), F.lit(""))


def strings_from_csv(line: Column) -> Column:
    """Inverse of ``strings_to_csv``; a line that isn't of that form gives no items."""
    good = line.rlike(r'(?s)^"([^"]|"")*"(,"([^"]|"")*")*$')
    cells = F.regexp_extract_all(line, F.lit(r'(?s)"((?:[^"]|"")*)"'), F.lit(1))
    return F.when(good, F.transform(cells, lambda c: F.replace(c, F.lit('""'), F.lit('"')))).otherwise(F.array().cast("array<string>"))


def ints_to_csv(items: Column) -> Column:
    return F.coalesce(F.array_join(items.cast("array<string>"), ","), F.lit(""))


def ints_from_csv(line: Column) -> Column:
    """Whole numbers between commas; none if any of them isn't one."""
    items = F.transform(F.split(line, ","), lambda x: x.try_cast("bigint"))
    return F.when(line.isNotNull() & ~F.exists(items, lambda x: x.isNull()), items).otherwise(F.array().cast("array<bigint>"))


def version(text: Column) -> Column:
    """A semantic version as a struct that sorts as versions do, ``label`` apart: of equal numbers one without is the last. Null is 0.0.0."""
    shape = r"^(\d+)\.(\d+)\.(\d+)(?:-([0-9A-Za-z.-]+))?(?:\+[0-9A-Za-z.-]+)?$"
    own = F.coalesce(text, F.lit("0.0.0"))
    number = lambda k: F.regexp_extract(own, shape, k).try_cast("int")
    label = F.regexp_extract(own, shape, 4)
    return F.when(own.rlike(shape), F.struct(number(1).alias("major"), number(2).alias("minor"), number(3).alias("patch"), (label == "").alias("released"), label.alias("label")))


def sql_csv_items(text: Column) -> Column:
    """Pieces between commas, where commas inside quotes don't divide."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"((?:[^,']|'(?:[^']|'')*')+)"), F.lit(1)), lambda x: F.trim(x))


def split_sql_type(text: Column) -> Column:
    """``VARCHAR(10)`` as name and length; other arguments give no length."""
    return F.struct(F.trim(F.split_part(text, F.lit("("), F.lit(1))).alias("name"), F.regexp_extract(text, r"^[^(]*\((\d+)\)", 1).try_cast("int").alias("length"))


#: SQL type names by family.
SQL_DATE = ["DATE", "DATETIME", "TIME", "TIMESTAMP"]
SQL_TEXT = ["CHAR", "VARCHAR", "NVARCHAR", "TINYTEXT", "TEXT", "NTEXT", "MEDIUMTEXT", "LONGTEXT"]
SQL_BINARY = ["BINARY", "BLOB", "IMAGE", "LONGBLOB", "VARBINARY"]
SQL_INTEGER = ["INT", "INTEGER", "TINYINT", "SMALLINT", "MEDIUMINT", "BIGINT", "BIT", "BOOL", "BOOLEAN"]
SQL_NUMBER = [*SQL_INTEGER, "DOUBLE", "FLOAT", "DEC", "DECIMAL", "NUMERIC", "REAL"]


def is_sql_type(text: Column) -> Column:
    """Among the known names, in capitals."""
    return sql_type_is(text, sorted({*SQL_DATE, *SQL_TEXT, *SQL_BINARY, *SQL_NUMBER}))


def merits_fulltext(text: Column, length: int = 1000) -> Column:
    """Text types long enough for an index of words."""
    return sql_text_at_least(text, length)


def without_collation(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?i)\s+COLLATE\s+\S+", ""))


def sql_type_is(text: Column, family: Sequence[str]) -> Column:
    return split_sql_type(text)["name"].isin(list(family))


def sql_text_at_least(text: Column, length: int) -> Column:
    """Text types without a length, or with one that is long enough."""
    found = split_sql_type(text)
    return found["name"].isin(SQL_TEXT) & (found["length"].isNull() | (found["length"] >= length))


#: Spark types of SQL type names.
_SPARK_TYPES = {
    "BIT": "boolean", "BOOL": "boolean", "BOOLEAN": "boolean", "TINYINT": "tinyint", "SMALLINT": "smallint", "MEDIUMINT": "int", "INT": "int",
    "INTEGER": "int", "BIGINT": "bigint", "FLOAT": "double", "DOUBLE": "double", "REAL": "float", "DATE": "date", "DATETIME": "timestamp_ntz",
    "DATETIME2": "timestamp_ntz", "TIMESTAMP": "timestamp", "BINARY": "binary", "VARBINARY": "binary", "BLOB": "binary", "LONGBLOB": "binary", "IMAGE": "binary",
}


def spark_type(sql_type: str) -> str:
    """The Spark type of a SQL type's text; collations are left out, enumerations and texts are strings."""
    import re

    bare = re.sub(r"\s+COLLATE\s+\S+", "", sql_type, flags=re.I).strip()
    name, _, rest = bare.partition("(")
    name = name.strip().upper()
    if name in ("DECIMAL", "NUMERIC", "DEC"):
        return f"decimal({rest.rstrip(')').replace(' ', '') or '10,0'})"
    return _SPARK_TYPES.get(name, "string")


def spark_types(text: Column) -> Column:
    """``spark_type`` of a column of SQL types."""
    name = F.upper(split_sql_type(without_collation(text))["name"])
    known = F.create_map(*(F.lit(x) for pair in _SPARK_TYPES.items() for x in pair))
    digits = F.regexp_replace(F.regexp_extract(text, r"\(([^)]*)\)", 1), " ", "")
    exact = F.concat(F.lit("decimal("), F.when(digits == "", "10,0").otherwise(digits), F.lit(")"))
    return F.when(name.isin("DECIMAL", "NUMERIC", "DEC"), exact).otherwise(F.coalesce(F.try_element_at(known, name), F.lit("string")))
