"""Text sources: delimited files, numbered lines, pattern search, census sheets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_CORRUPT = "_corrupt_record"


def _schema(spec) -> T.StructType:
    return spec if isinstance(spec, T.StructType) else T._parse_datatype_string(spec)


def read_delimited(
    spark: SparkSession, path: str, schema, sep: str = ",", header: bool = True,
    keep_corrupt: bool = False,
) -> DataFrame:
    """CSV/TSV files of a path or glob with a declared schema.

    The header row is skipped and columns are taken by position, so a file whose
    header names differ is read with the declared names.  ``keep_corrupt`` adds
    ``_corrupt_record`` for lines that do not fit instead of losing them.
    """
    declared = _schema(schema)
    if keep_corrupt:
        declared = T.StructType(declared.fields + [T.StructField(_CORRUPT, T.StringType())])
    reader = spark.read.schema(declared).option("sep", sep).option("header", header)
    reader = reader.option("enforceSchema", True).option("mode", "PERMISSIVE").option("escape", '"')
    if keep_corrupt:
        reader = reader.option("columnNameOfCorruptRecord", _CORRUPT)
    return reader.csv(path)


def numbered_lines(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """``(file, line_no, line)`` of text files, numbered from 0 within each file.

    Files stay splittable and no line is shuffled for its number: a scan counts its rows
    in order, so a line's place in its block is its count less the block's first, and
    each block is shifted by the number of lines in the blocks before it.  With a
    ``pattern`` only lines that contain it are numbered.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("seen"),
        F.col("value").alias("line"),
    )
    sizes = lines.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"), F.min("seen").alias("first"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "file", "block", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift")
    )
    wanted = lines if pattern is None else lines.filter(F.col("line").rlike(pattern))
    return wanted.join(offsets, ["file", "block"]).select(
        "file", (F.col("shift") + F.col("seen")).alias("line_no"), "line"
    )


def grep_files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """Numbered lines that contain the pattern; no rows when nothing matches."""
    return numbered_lines(spark, path, pattern)


def text_lines(text) -> Column:
    """Lines of a text column."""
    return F.split(F.col(text) if isinstance(text, str) else text, "\n")


def grep_column(df: DataFrame, text: str, pattern: str) -> DataFrame:
    """Numbered matching lines of a text column, filtered before rows are made."""
    numbered = F.transform(
        text_lines(text), lambda line, at: F.struct(at.alias("line_no"), line.alias("line"))
    )
    hits = F.filter(numbered, lambda item: item["line"].rlike(pattern))
    return df.select(
        *[c for c in df.columns if c != text], F.inline_outer(hits)
    ).filter(F.col("line_no").isNotNull())


def first_line_capture(text, pattern: str, group: int = 1) -> Column:
    """Group of the first line that contains the pattern; NULL without one."""
    hit = F.try_element_at(F.filter(text_lines(text), lambda line: line.rlike(pattern)), F.lit(1))
    return F.when(hit.isNotNull(), F.regexp_extract(hit, pattern, group))


def text_capture(text, pattern: str, group: int = 1) -> Column:
    """Group of the first match in the whole text; NULL without one."""
    whole = F.col(text) if isinstance(text, str) else text
    return F.when(whole.rlike(pattern), F.regexp_extract(whole, pattern, group))


def header_columns(text, header_pattern: str, sep: str) -> tuple[Column, Column]:
    """Number of the header line, and the trimmed names in it."""
    lines = text_lines(text)
    flags = F.transform(lines, lambda line: line.rlike(header_pattern))
    at = F.array_position(flags, True)
    header = F.try_element_at(F.filter(lines, lambda line: line.rlike(header_pattern)), F.lit(1))
    names = F.filter(
        F.transform(F.split(header, sep), lambda name: F.trim(name)), lambda name: name != ""
    )
    return F.when(at > 0, at - 1).cast("int"), names


def listed_names(text, begin: str, end: str) -> Column:
    """Names from a prose listing of ``name : description`` lines between two marks, in order.

    ``begin`` and ``end`` are patterns of the lines around the listing; lines without a
    colon, such as rules and continued descriptions, name nothing.  NULL without a listing.
    """
    whole = F.col(text) if isinstance(text, str) else text
    block = F.regexp_extract(whole, f"(?m)(?:{begin})[^\\n]*\\n((?:.|\\n)*?)(?:{end})", 1)
    names = F.regexp_extract_all(block, F.lit(r"(?m)^[ \t]*([A-Za-z][\w ]*?)[ \t]*:(?=[ \t]|$)"), F.lit(1))
    return F.when(block != "", names)


def read_by_listing(
    spark: SparkSession, readme: str, path: str, begin: str, end: str, types: dict[str, str] | None = None, sep: str = "\t"
) -> DataFrame:
    """Headerless files whose columns a readme lists: names by position, text unless ``types`` says more."""
    whole = spark.read.text(readme, wholetext=True).select(listed_names("value", begin, end).alias("names"))
    found = [row["names"] for row in whole.filter("names IS NOT NULL").collect()]  # the readme's few names
    if len(found) != 1 or len(set(found[0])) != len(found[0]):
        raise ValueError(f"{readme}: one listing of distinct names is needed, found {found}")
    types = types or {}
    fields = [f"`{name}` {types.get(name, 'string')}" for name in found[0]]
    return read_delimited(spark, path, ", ".join(fields), sep=sep, header=False)


def census_number(value) -> Column:
    """``1,234`` to 1234; ``-`` is zero; ``(X)`` and notes are NULL."""
    text = F.trim(F.col(value) if isinstance(value, str) else value)
    return F.when(text == "-", F.lit(0.0)).otherwise(
        F.regexp_replace(text, ",", "").try_cast("double")
    )


def read_census(spark: SparkSession, path: str, measures: list[str], value_name: str = "value") -> DataFrame:
    """Census sheet to long ``(area, measure, value)`` rows.

    Titles, headers spread over rows, and footnotes are the rows without a number
    in the first measure; dots that indent an area name are dropped.
    """
    schema = ", ".join(["area string"] + [f"`{name}` string" for name in measures])
    sheet = (
        spark.read.schema(schema).option("multiLine", True).option("header", False)
        .option("escape", '"').csv(path)
    )
    numbers = [census_number(f"`{name}`").alias(name) for name in measures]
    data = sheet.select(F.regexp_replace(F.trim("area"), r"^\.+", "").alias("area"), *numbers)
    data = data.filter((F.col("area") != "") & F.col(f"`{measures[0]}`").isNotNull())
    return data.unpivot("area", [f"`{m}`" for m in measures], "measure", value_name)
