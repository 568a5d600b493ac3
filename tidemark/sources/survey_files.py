"""Survey files: numbered records, header check, fields, and what a file's encoding and delimiter look like.

A file is one text file or a folder of parts in the order of their names; its first record is the header. Files are read in
splits by any number of tasks, and neither rows nor their numbers depend on where the splits are.

A quoted field may hold line breaks, so whether a line begins inside a field depends on all that stands before it. A line either
ends outside of a quoted field or inside one, for each of the two ways in which it may begin: it is a function on two states. Such
functions compose, so each split is summed up alone, a prefix over splits tells how each begins, and a second pass cuts the records.
"""

from __future__ import annotations

import codecs
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.schemas import SURVEY_COLUMNS
from tidemark.sources.byte_ranges import beginnings
from tidemark.storage import leaves

# Letters of the survey's language and what they are without their marks.
MARKED, PLAIN = "áàâãäéèêëíìîïóòôõöúùûüçñ", "aaaaaeeeeiiiiooooouuuucn"
#: Bytes of a file that are looked at to tell its encoding and delimiter.
SNIFF_BYTES = 1 << 20
DELIMITERS = (";", ",", "\t")
#: Lines that a record may have: more means that a quote is never closed.
MOST_LINES = 10_000
_BROKEN = "broken_record"


def column_name(header: Column) -> Column:
    """A header cell as a column name: lower case, marks off, one underscore for whatever else stands between."""
    words = F.regexp_replace(F.translate(F.lower(F.trim(header)), MARKED, PLAIN), "[^a-z0-9]+", "_")
    return F.btrim(words, F.lit("_"))


def charset(encoding: str) -> str:
    """The JVM's name of an encoding."""
    return {"utf-8-sig": "UTF-8", "latin-1": "ISO-8859-1"}.get(encoding.lower(), encoding)


def _placed_lines(spark: SparkSession, path: str, encoding: str) -> DataFrame:
    """(value, file, block, place): place ascends with the lines of a split, file and block with the splits."""
    lines = spark.read.text(path)
    if charset(encoding).upper() not in ("UTF-8", "US-ASCII"):
        lines = lines.withColumn("value", F.decode(F.col("value").cast("binary"), charset(encoding)))
    return lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"))


def _before(value: str) -> Column:
    """The sum over the splits before: a row a split."""
    return F.coalesce(F.sum(value).over(Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def _unmarked(number: Column, line: Column) -> Column:
    """A line without the byte order mark, which only the first one may have."""
    return F.when((number == 1) & F.startswith(line, F.lit("﻿")), F.substring(line, 2, 1 << 30)).otherwise(line)


def numbered_lines(spark: SparkSession, path: str, encoding: str = "utf-8") -> DataFrame:
    """(line_number, line) of a file, from 1. A byte order mark at its beginning is taken off.

    Lines are cut as bytes and decoded then, so an encoding must have the line break of ASCII."""
    at = _placed_lines(spark, path, encoding)
    splits = at.groupBy("file", "block").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("lines")).withColumn("before", _before("lines"))
    number = (F.col("place") - F.col("first") + F.col("before") + 1).cast("int")
    numbered = at.join(splits, ["file", "block"]).select(number.alias("line_number"), "value")
    return numbered.select("line_number", _unmarked(F.col("line_number"), F.col("value")).alias("line"))


def _field(delimiter: str) -> str:
    """A field that ends on its line, as a pattern that never looks back: quoted, with whatever follows its last quote, or plain. A quote that
    doesn't begin a field is a letter like others."""
    other = f"[^{delimiter}]*+"
    return f'(?:"[^"]*+(?:""[^"]*+)*+"(?!"){other}|(?!"){other})'


def _ends_outside(line: Column, delimiter: str) -> tuple[Column, Column]:
    """Whether a line ends outside of a quoted field, if it begins outside of one, and if it begins inside."""
    d, field = "\\t" if delimiter == "\t" else f"\\Q{delimiter}\\E", _field("\\t" if delimiter == "\t" else delimiter)
    more = f"(?:{d}{field})*+$"
    plain = ~F.contains(line, F.lit('"'))
    return plain | line.rlike(f"^{field}{more}"), ~plain & line.rlike(f'^[^"]*+(?:""[^"]*+)*+"(?!")[^{"\\t" if delimiter == "\t" else delimiter}]*+{more}')


def numbered_records(spark: SparkSession, path: str, encoding: str = "utf-8", delimiter: str = ";") -> DataFrame:
    """(record_number, record, lines) of a file, from 1; line breaks inside quoted fields are kept as \\n.

    Files without such a field are told by one pass over their lines, and need no second. A quote that is never closed raises once its
    record has MOST_LINES lines."""
    at = _placed_lines(spark, path, encoding)
    outside, inside = _ends_outside(F.col("value"), delimiter)
    known = at.select("*", outside.alias("outside"), inside.alias("inside"))
    if known.where("not outside").isEmpty():
        lines = numbered_lines(spark, path, encoding)
        return lines.select(F.col("line_number").alias("record_number"), F.col("line").alias("record"), F.lit(1).alias("lines"))
    # Lines that end alike however they begin fix the state; between them, lines that keep it and lines that turn it are counted.
    order = Window.partitionBy("file", "block").orderBy("place")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    fixes, turns = F.col("outside") == F.col("inside"), ~F.col("outside") & F.col("inside")
    turned = F.sum(turns.cast("int"))
    marked = known.select("value", "file", "block", "place", "outside", "inside", F.coalesce(turned.over(earlier), F.lit(0)).alias("turned"))
    fixed = F.last(F.when(fixes, F.struct("outside", "turned")), ignorenulls=True).over(earlier)
    seen = marked.withColumn("fixed", fixed)
    odd = lambda n: F.pmod(n, F.lit(2)) == 1
    # Whether a line begins outside, if its split does and if it does not.
    after = F.col("fixed.outside") != odd(F.col("turned") - F.col("fixed.turned"))
    if_outside, if_inside = F.coalesce(after, ~odd(F.col("turned"))), F.coalesce(after, odd(F.col("turned")))
    cut = seen.select("value", "file", "block", "place", "outside", "inside", if_outside.alias("if_outside"), if_inside.alias("if_inside"))
    ends = lambda begins: F.when(F.col(begins), F.col("outside")).otherwise(F.col("inside"))
    splits = cut.groupBy("file", "block").agg(
        F.count_if("if_outside").alias("n_outside"), F.count_if("if_inside").alias("n_inside"),
        F.max_by(ends("if_outside"), "place").alias("to_outside"), F.max_by(ends("if_inside"), "place").alias("to_inside"))
    # The same over splits, a row each: how each begins, and how many records have begun before it.
    row = Window.orderBy("file", "block")
    before = row.rowsBetween(Window.unboundedPreceding, -1)
    fix, turn = F.col("to_outside") == F.col("to_inside"), ~F.col("to_outside") & F.col("to_inside")
    splits = splits.withColumn("turned", F.coalesce(F.sum(turn.cast("int")).over(before), F.lit(0)))
    splits = splits.withColumn("fixed", F.last(F.when(fix, F.struct("to_outside", "turned")), ignorenulls=True).over(before))
    begins = F.coalesce(F.col("fixed.to_outside") != odd(F.col("turned") - F.col("fixed.turned")), ~odd(F.col("turned")))
    splits = splits.withColumn("begins", begins).withColumn("records", F.when(F.col("begins"), F.col("n_outside")).otherwise(F.col("n_inside")))
    splits = splits.select("file", "block", "begins", _before("records").alias("records_before"))
    told = cut.join(splits, ["file", "block"]).withColumn("new", F.when(F.col("begins"), F.col("if_outside")).otherwise(F.col("if_inside")))
    number = (F.col("records_before") + F.sum(F.col("new").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))).cast("int")
    numbered = told.select(number.alias("record_number"), "file", "block", "place", "value")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("file", "block", "place", "value"))), lambda p: p["value"])
    crowded = F.count(F.lit(1)) > MOST_LINES
    records = numbered.groupBy("record_number").agg(
        F.when(crowded, F.raise_error(F.concat(F.lit("a quote is not closed in record "), F.first("record_number").cast("string")))).otherwise(F.array_join(parts, "\n")).alias("record"), F.count(F.lit(1)).cast("int").alias("lines"))
    return records.select("record_number", _unmarked(F.col("record_number"), F.col("record")).alias("record"), "lines")


def header_of(lines: DataFrame, delimiter: str) -> list[str]:
    """The column names of a file, from its first line or record."""
    number, line = lines.columns[:2]
    cells = F.transform(F.split(line, f"\\Q{delimiter}\\E"), lambda c: column_name(F.replace(c, F.lit('"'), F.lit(""))))
    first = lines.where(F.col(number) == 1).select(cells.alias("names")).first()
    return first["names"] if first else []


def check_header(found: Sequence[str], expected: Sequence[str], name: str) -> None:
    """Raise unless the columns are the expected ones in their order; says what lacks and what is too much."""
    if list(found) == list(expected):
        return
    lacking, surplus = [c for c in expected if c not in found], [c for c in found if c not in expected]
    raise ValueError(f"{name}: header differs; lacking {lacking}, unexpected {surplus}" + ("" if lacking or surplus else "; same columns in another order"))


def read_survey(spark: SparkSession, path: str, source_file_id: int, encoding: str = "utf-8-sig", delimiter: str = ";", expected: Sequence[str] = SURVEY_COLUMNS) -> DataFrame:
    """Raw rows of a survey file: source_file_id, line_number, the survey's columns as text, is_malformed and raw_line.

    Records are numbered from the header, so rows begin at 2. Empty fields are null. A record of another number of fields, a blank
    line included, is malformed and its fields are null. A header that differs from ``expected`` raises. Quoted fields may hold
    the delimiter, line breaks, and quotes as two of them.
    """
    records = numbered_records(spark, path, encoding, delimiter)
    check_header(header_of(records, delimiter), expected, path)
    parsed, broken = _parsed(records, delimiter, expected)
    return parsed.select(
        F.lit(source_file_id).cast("int").alias("source_file_id"), F.col("record_number").alias("line_number"),
        *[F.when(~broken, F.nullif(F.col(f"row.{c}"), F.lit(""))).alias(c) for c in expected], broken.alias("is_malformed"), F.col("record").alias("raw_line"))


def _parsed(records: DataFrame, delimiter: str, columns: Sequence[str]) -> tuple[DataFrame, Column]:
    """Records after the header with their fields as ``row``, and whether one has another number of fields or is blank."""
    schema = ", ".join([*(f"`{c}` string" for c in columns), f"{_BROKEN} string"])
    options = {"sep": delimiter, "escape": '"', "columnNameOfCorruptRecord": _BROKEN, "mode": "PERMISSIVE", "emptyValue": ""}
    parsed = records.where("record_number > 1").withColumn("row", F.from_csv("record", schema, options))
    return parsed, F.col(f"row.{_BROKEN}").isNotNull() | F.col("row").isNull() | (F.trim("record") == "")


def read_tolerant(spark: SparkSession, path: str, delimiter: str = ";", encoding: str = "utf-8", columns: Sequence[str] = SURVEY_COLUMNS) -> DataFrame:
    """Rows of a file for profiling: those of a wrong number of fields are left out."""
    parsed, broken = _parsed(numbered_records(spark, path, encoding, delimiter), delimiter, columns)
    return parsed.where(~broken).select(*[F.col(f"row.`{c}`").alias(c) for c in columns])


def sniff(spark: SparkSession, path: str, size: int = SNIFF_BYTES) -> tuple[str, str]:
    """(encoding, delimiter) by the first ``size`` bytes of a file, of which nothing more is read: UTF-8 if they are, but for a character that is cut
    at their end, else Latin-1; the delimiter that stands on most lines as often as on the first, of several the one that stands there oftenest."""
    head = b"".join(bytes(r["content"]) for r in beginnings(spark, leaves(spark, path)[0][0], size).orderBy("start").collect())  # at most ``size`` bytes
    encoding = "utf-8-sig" if head.startswith(codecs.BOM_UTF8) else "utf-8"
    try:
        text = codecs.getincrementaldecoder("utf-8")().decode(head)
    except UnicodeDecodeError:
        encoding, text = "latin-1", head.decode("latin-1")
    whole = text.splitlines()
    lines = [line for line in (whole[:-1] if len(whole) > 1 and len(head) >= size else whole) if line.strip()] or [""]

    def fits(delimiter: str) -> tuple[float, int]:
        often = lines[0].count(delimiter)
        return (sum(line.count(delimiter) == often for line in lines) / len(lines) if often else 0.0), often

    return encoding, max(DELIMITERS, key=fits)


def best_column(columns: Sequence[str], wanted: str) -> str | None:
    """The column whose name has most of its words in common with the wanted one, the first of several; None if none has any."""
    words = lambda name: set(name.split("_"))
    alike = lambda c: len(words(c) & words(wanted)) / len(words(c) | words(wanted))
    best = max(columns, key=alike, default=None)
    return best if best is not None and alike(best) else None
