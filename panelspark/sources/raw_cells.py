"""Delimited sheets as a raw-cell table: (path, row_idx, cells)."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.sources.files import SHEETS
from panelspark.sources.records import read_pieces, read_records


def split_cells(record: Column) -> Column:
    """Cells of a comma-separated record; quoted cells may hold commas, line breaks and doubled quotes."""
    # Most records need no pattern: without any quote, or with all cells quoted and no quote within one.
    inner = F.replace(F.substr(record, F.lit(2), F.length(record) - 2), F.lit('","'), F.lit("\0"))
    quoted = record.startswith('"') & record.endswith('"') & (F.length(record) > 1) & ~record.contains("\0") & ~inner.contains('"')
    # Possessive, so that a cell of any length costs no stack.
    parts = F.regexp_extract_all(F.concat(F.lit(","), record), F.lit(r',("[^"]*+(?:""[^"]*+)*+"|[^,]*+)'), F.lit(1))

    def unquote(c: Column) -> Column:
        inner = F.replace(F.substr(c, F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"'))
        return F.when(c.startswith('"') & c.endswith('"') & (F.length(c) > 1), inner).otherwise(c)

    return (
        F.when(~record.contains('"'), F.split(record, ",", -1))
        .when(quoted, F.split(inner, "\0", -1))
        .otherwise(F.transform(parts, unquote))
    )


def read_raw_cells(
    spark: SparkSession,
    root: str,
    pattern: str = SHEETS,
    line_breaks: bool | None = None,
    faults: DataFrame | None = None,
    named: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """Every record of every file under ``root`` with its 0-based row number in the file.

    Files are split as usual, also those whose quoted cells hold line breaks (``records.cut_records``). ``line_breaks`` False spares
    the look for such cells. With ``faults`` (``files.file_faults``) the files it lists
    are left out whole and end no job; without, a file that cannot be read does. ``named`` makes the path that is shown
    out of a file's, once a file's split rather than once a row.
    """
    options = {} if faults is None else {"ignoreCorruptFiles": True, "ignoreMissingFiles": True}
    lines = read_pieces(spark, root, pattern=pattern, recursive=True, **options)
    return read_records(lines, line_breaks, faults, named).select("path", "row_idx", split_cells(F.col("value")).alias("cells"))
