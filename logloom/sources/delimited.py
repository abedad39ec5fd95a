"""Reading delimited log files with stable row numbers."""

from __future__ import annotations

import csv
from collections.abc import Collection

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logloom.operators.validate import normalize_header
from logloom.session import staged
from logloom.sources import ranges

DELIMITERS = ",\t;|"
SAMPLE_CHARACTERS = 4096


def sniff_delimiter(sample: str) -> str:
    """The delimiter of a short sample, a comma when it cannot be told."""
    try:
        return csv.Sniffer().sniff(sample[:SAMPLE_CHARACTERS], delimiters=DELIMITERS).delimiter
    except csv.Error:
        return ","


def _first_record(spark: SparkSession, file: str, line: str) -> str:
    """A file's first record, whole: more lines are read while a quote is open."""
    count = 64
    while line.count('"') % 2:
        lines = [row.value or "" for row in spark.read.text(file).take(count)]
        for end in range(1, len(lines) + 1):
            line = "\n".join(lines[:end])
            if line.count('"') % 2 == 0:
                return line
        if len(lines) < count:
            break
        count *= 4
    return line


def _files(spark: SparkSession, path: str) -> list[tuple[str, str, bool]]:
    """Each file, its first record, and whether line breaks stand inside quotes; from one scan of the lines."""
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("seq")).alias("place"),
        "value",
    )
    open_quote = (F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))) % 2 == 1
    rows = lines.groupBy("file").agg(F.min_by("value", "place").alias("line"), F.max(open_quote).alias("breaks")).collect()
    return [(r.file, _first_record(spark, r.file, (r.line or "").lstrip("\ufeff")), bool(r.breaks)) for r in sorted(rows)]


def read_delimited(
    spark: SparkSession, path: str, sep: str | None = None, multi_line: bool | None = None, wanted: Collection[str] | None = None,
) -> DataFrame | None:
    """All rows of the files at ``path`` as text, with normalised names and ``row_no``.

    Every file is read by its own header, which may be of any length and order;
    columns are matched by name, and one that a file lacks is null there. Files
    are split by range. Where a line holds an odd number of quotes, records are put
    together from lines first, see ``ranges``; ``multi_line`` sets it for all.
    ``wanted`` names the columns to keep of those there are, None keeps all.
    Returns None when there is no header.
    """
    groups: dict[tuple, list[str]] = {}
    for file, record, breaks in _files(spark, path):
        mark = sep or sniff_delimiter(record)
        first = next(csv.reader(record.splitlines(keepends=True), delimiter=mark), [])
        if any(cell.strip() for cell in first):
            groups.setdefault((tuple(first), mark, breaks if multi_line is None else multi_line), []).append(file)
    rows = None
    for (first, mark, lines), files in groups.items():
        # Of columns with the same normalised name the last one counts.
        columns = {normalize_header(name): f"c{place}" for place, name in enumerate(first) if name.strip()}
        columns = {name: c for name, c in columns.items() if wanted is None or name in wanted}
        read = _in_quotes if lines else _by_lines
        part = read(spark, files, ", ".join(f"c{place} string" for place in range(len(first))), mark)
        part = part.select(*[F.col(c).alias(name) for name, c in columns.items()], "_file", "_block", "_seq")
        rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
    return None if rows is None else number_rows(rows)


def _by_lines(spark: SparkSession, files: list[str], kind: str, sep: str) -> DataFrame:
    """Files whose records are lines."""
    read = spark.read.schema(kind).option("header", True).option("sep", sep).option("quote", '"').option("escape", '"').csv(files)
    return read.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block")).withColumn("_seq", F.monotonically_increasing_id())


def _in_quotes(spark: SparkSession, files: list[str], kind: str, sep: str) -> DataFrame:
    """Files with line breaks inside quotes; the first record is the header."""
    found = staged(ranges.delimited_records(ranges.lines_of(spark.read.text(files)), sep))
    header = found.groupBy("_file").agg(F.min(F.struct("_block", "_seq")).alias("_head"))
    rows = found.join(F.broadcast(header), "_file").filter(F.struct("_block", "_seq") > F.col("_head"))
    cells = F.from_csv("text", kind, {"sep": sep, "quote": '"', "escape": '"'})
    return rows.select(cells.alias("_cells"), "_file", "_block", "_seq").select("_cells.*", "_file", "_block", "_seq")


def number_rows(rows: DataFrame) -> DataFrame:
    """Replace the origin columns by ``row_no``: 1, 2, ... over files and splits in order.

    The rows are staged first, so that each position is read once and stored:
    it cannot change when a lost executor's split is read again. Only one row
    per split takes part in the running total.
    """
    kept = staged(rows)
    splits = kept.groupBy("_file", "_block").agg(F.count(F.lit(1)).alias("n"), F.min("_seq").alias("first"))
    before = F.sum("n").over(Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1))
    offsets = splits.select("_file", "_block", (F.coalesce(before, F.lit(0)) - F.col("first") + 1).alias("_shift"))
    return (
        kept.join(F.broadcast(offsets), ["_file", "_block"])  # one row per split; the records are not shuffled
        .withColumn("row_no", F.col("_seq") + F.col("_shift"))
        .drop("_file", "_block", "_seq", "_shift")
    )
