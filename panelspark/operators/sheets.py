"""Extraction of one section out of many multi-section sheets, as one Spark job.

Input is a raw-cell table ``(path, row_idx, cells array<string>)``; see
``sources.raw_cells`` for reading one.
"""

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark import presets
from panelspark.functions.labels import is_aggregate_name, map_value
from panelspark.functions.numeric import strip, to_number


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def file_type(name: Column, words: Sequence = presets.FILE_WORDS) -> Column:
    """Type of the first rule whose words all occur among the letters of the name."""
    letters = F.regexp_replace(F.lower(name), "[^a-z]", "")
    out = None
    for needed, kind in words:
        hit = F.lit(True)
        for word in needed:
            variants = [letters.contains(v) for v in word.split("|")]
            hit = hit & reduce(lambda a, b: a | b, variants)
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out


def path_period(path: Column, pattern: str = presets.YEAR_PATTERN) -> Column:
    """First year in the path, NULL when there is none."""
    return F.nullif(F.regexp_extract(path, pattern, 1), F.lit("")).try_cast("int")


def classify_files(
    paths: DataFrame,
    rules: Mapping[str, tuple[str, int]] = presets.FILE_RULES,
    words: Sequence = presets.FILE_WORDS,
    path: str = "path",
) -> DataFrame:
    """Add file_name, period, file_type, category and value column to a table of paths."""
    labels = {kind: label for kind, (label, _) in rules.items()}
    columns = [F.lit(x) for kind, (_, index) in rules.items() for x in (kind, index)]
    return (
        paths.withColumn("file_name", file_name(F.col(path)))
        .withColumns({"period": path_period(F.col(path)), "file_type": file_type(F.col("file_name"), words)})
        .withColumns(
            {
                "category": map_value(F.col("file_type"), labels),
                "value_col": F.try_element_at(F.create_map(*columns), "file_type"),
            }
        )
    )


def _cell(i: int) -> Column:
    return F.coalesce(strip(F.try_element_at("cells", F.lit(i))), F.lit(""))


def is_section_header(cell: Column, section: str) -> Column:
    """For a trimmed, lower-cased cell: the section's name alone, or after ``state:`` with the usual spacings."""
    name, word = section.lower(), presets.SECTION_WORD
    closed = F.replace(F.replace(cell, F.lit(" : "), F.lit(":")), F.lit(" :"), F.lit(":"))
    return F.coalesce(
        (closed == f"{word}:{name}") | cell.isin(name, f"{word}: {name}", f"{word} : {name}"), F.lit(False)
    )


def is_next_header(cell: Column, marks: Sequence[str] = presets.SECTION_MARKS) -> Column:
    v = F.lower(strip(cell))
    marked = F.lit(False)
    for m in marks:
        marked = marked | v.contains(m)
    return F.coalesce(v.contains(presets.SECTION_WORD) & marked, F.lit(False))


# Rows of a block: how many rows of one file share a join key.
BLOCK_ROWS = 128
# Rows of a part of a file, whose headers meet in one group.
PART_ROWS = 1 << 17
# Rows of a strip, whose headers are the bits of one number.
STRIP_ROWS = 64


def section_bounds(raw_cells: DataFrame, section: str, max_rows: int | None = None) -> DataFrame:
    """Per file with the section: ``start`` and ``stop`` rows, ``width`` of the sheet, ``rows_cut``.

    The strict header is looked for in the first two cells; only a file without
    one falls back to the name anywhere in the first three. The section ends at the
    next header or with the file. ``max_rows`` may end it earlier; ``rows_cut``
    counts the rows that this leaves out.
    """
    name = section.lower()
    # Only rows that name the section can be headers; for all others the test ends here.
    loose = reduce(
        lambda a, b: a | b, [F.coalesce(F.lower(F.get("cells", F.lit(i))).contains(name), F.lit(False)) for i in range(3)]
    )
    strict = F.exists(F.slice("cells", 1, 2), lambda c: is_section_header(F.lower(strip(c)), section))
    bit = F.expr(f"shiftleft(1L, cast(row_idx % {STRIP_ROWS} as int))")
    marked = raw_cells.select("path", "row_idx", F.size("cells").alias("_size"), loose.alias("_named"), is_next_header(_cell(1)).alias("_heads"), "cells").select(
        "path",
        F.expr(f"row_idx div {STRIP_ROWS}").alias("_strip"),
        "_size",
        "row_idx",
        F.when(F.col("_named"), F.col("row_idx")).alias("_loose"),
        F.when(F.col("_named") & strict, F.col("row_idx")).alias("_strict"),
        F.when(F.col("_heads"), bit).alias("_bit"),
    )
    # One pass: the rows go to numbers per strip, which tasks sum up before the shuffle and without a sort.
    strips = marked.groupBy("path", "_strip").agg(
        F.min("_strict").alias("_strict"),
        F.min("_loose").alias("_loose"),
        F.max("_size").alias("_size"),
        F.max("row_idx").alias("_last"),
        F.bit_or("_bit").alias("_bits"),
    )
    places = F.filter(F.sequence(F.lit(0), F.lit(STRIP_ROWS - 1)), lambda i: F.getbit("_bits", i) == 1)
    listed = F.when(F.col("_bits").isNotNull(), F.transform(places, lambda i: F.col("_strip") * STRIP_ROWS + i))
    # A part of a file keeps its headers, which are as many as it has rows at most.
    parts = strips.groupBy("path", F.expr(f"_strip div {PART_ROWS // STRIP_ROWS}").alias("_part")).agg(
        F.min("_strict").alias("_strict"),
        F.min("_loose").alias("_loose"),
        F.max("_size").alias("_size"),
        F.max("_last").alias("_last"),
        F.array_sort(F.flatten(F.collect_list(listed))).alias("_heads"),
    )

    def heads_beside(found: str) -> Column:
        """The headers of the first part in which the section's header was found."""
        return F.min_by(F.when(F.col(found).isNotNull(), F.col("_heads")), F.when(F.col(found).isNotNull(), F.col("_part")))

    files = parts.groupBy("path").agg(
        F.min("_strict").alias("_strict"),
        F.min("_loose").alias("_loose"),
        F.max("_size").alias("width"),
        F.max("_last").alias("_last"),
        heads_beside("_strict").alias("_by_strict"),
        heads_beside("_loose").alias("_by_loose"),
        # Of all other parts the first header is enough.
        F.collect_list(F.get("_heads", F.lit(0))).alias("_firsts"),
    )
    start = F.coalesce("_strict", "_loose")
    near = F.when(F.col("_strict").isNotNull(), F.col("_by_strict")).otherwise(F.col("_by_loose"))
    found = files.select("path", start.alias("start"), "width", "_last", F.concat(near, "_firsts").alias("_heads")).filter("start is not null")
    bounds = found.withColumn("_next", F.array_min(F.filter("_heads", lambda h: h > F.col("start"))))
    end = F.coalesce("_next", F.col("_last") + 1)
    stop = end if max_rows is None else F.least(end, F.col("start") + 1 + max_rows)
    return bounds.select("path", "start", "width", stop.alias("stop"), (end - stop).alias("rows_cut"))


def section_rows(raw_cells: DataFrame, bounds: DataFrame) -> DataFrame:
    """Rows of each file's section: after ``start`` and before ``stop``.

    Row numbers are cut into blocks and a section is listed once per block that it
    touches, so its rows are found by an equi-join on (file, block): one file holding
    a large part of all rows spreads over as many keys as it has blocks. The other columns of ``bounds`` are carried along.
    """

    def block(row):
        return F.floor(row / BLOCK_ROWS)

    filled = bounds.filter(F.col("stop") > F.col("start") + 1)
    blocks = F.sequence(block(F.col("start") + 1), block(F.col("stop") - 1))
    return (
        raw_cells.select("path", "row_idx", "cells", block(F.col("row_idx")).alias("_block"))
        .join(filled.withColumn("_block", F.explode(blocks)), ["path", "_block"])
        .filter((F.col("row_idx") > F.col("start")) & (F.col("row_idx") < F.col("stop")))
        # As cells of a section, so that no filter on them is moved before the join, to all rows of the files.
        .withColumn("cells", F.when(F.col("row_idx") > F.col("start"), F.col("cells")))
        .drop("_block", "start", "stop")
    )


def is_entity_row(skip: Sequence[str] = presets.SKIP_NAMES) -> Column:
    """A serial number in the first cell and a name that is no total in the second."""
    name = F.lower(_cell(2))
    serial = strip(F.replace(_cell(1), F.lit("."), F.lit("")))
    return ~name.isin(*skip) & ~name.contains("total") & serial.rlike(r"^\d+$")


def value_cell() -> Column:
    """The value column's text; -1 is the sheet's last column, which shorter rows lack."""
    last = F.when(F.size("cells") == F.col("width"), F.try_element_at("cells", F.col("width")))
    return F.when(F.col("value_col") == -1, last).otherwise(F.try_element_at("cells", F.col("value_col") + 1))


def extract_sections(
    raw_cells: DataFrame,
    section: str,
    rules: Mapping[str, tuple[str, int]] = presets.FILE_RULES,
    words: Sequence = presets.FILE_WORDS,
    max_rows: int | None = None,
    source: str = "sheets",
    bounds: DataFrame | None = None,
) -> DataFrame:
    """Panel rows of one section out of every classified file, with the file's path.

    Files are classified once each, after their headers were found, and those
    without a year or a known type are left out. Values must be finite numbers
    not below zero and are truncated. Sections have no limit unless ``max_rows`` sets one.
    ``bounds`` are the sections' (:func:`section_bounds`), where they are known. Kept as a table, Spark knows their size,
    and if they are few no row of the files is shuffled.
    """
    # Classifying a copy of the path that depends on the found start keeps this at one
    # evaluation per file; on the path itself, the filter would be pushed below the
    # grouping and across the join, and run on every raw row.
    bounds = section_bounds(raw_cells, section, max_rows) if bounds is None else bounds
    found = bounds.withColumn("_file", F.when(F.col("start") >= 0, F.col("path")))
    starts = classify_files(found, rules, words, path="_file").filter(
        F.col("period").isNotNull() & F.col("category").isNotNull()
    )
    wanted = starts.select("path", "start", "stop", "width", "period", "category", "value_col")
    rows = section_rows(raw_cells, wanted).filter(is_entity_row())
    valued = rows.withColumn("_value", to_number(value_cell()))
    return valued.filter((F.col("_value") >= 0) & (F.col("_value") < F.lit(9.2e18))).select(
        "path",
        _cell(2).alias("entity"),
        "period",
        "category",
        F.col("_value").cast("bigint").alias("total"),
        F.lit(source).alias("source"),
    )


def drop_aggregate_names(df: DataFrame, entity: str = "entity") -> DataFrame:
    """Last safety: rows of aggregate names that slipped through."""
    return df.filter(~is_aggregate_name(F.col(entity)))


def load_audit(
    files: DataFrame,
    rows: DataFrame,
    rules: Mapping = presets.FILE_RULES,
    words: Sequence = presets.FILE_WORDS,
    bounds: DataFrame | None = None,
    faults: DataFrame | None = None,
) -> DataFrame:
    """Per file: OK with its row count, CUT, SKIP or FAIL with the reason.

    ``bounds`` (:func:`section_bounds` with the limit that the extraction had) says how many rows a limit left out.
    ``faults`` (``sources.files.file_faults``) are the files that could not be read, with what was wrong.
    """
    counts = rows.groupBy("path").agg(F.count(F.lit(1)).alias("_n"))
    known = classify_files(files.select("path").distinct(), rules, words).join(counts, "path", "left")
    if bounds is None:
        known = known.withColumn("rows_cut", F.lit(0).cast("bigint"))
    else:
        known = known.join(bounds.select("path", "rows_cut"), "path", "left")
    if faults is None:
        known = known.withColumn("fault", F.lit(None).cast("string"))
    else:
        known = known.join(faults.select("path", "fault"), "path", "left")
    n, cut = F.coalesce("_n", F.lit(0)), F.coalesce("rows_cut", F.lit(0)).cast("bigint")
    return known.select(
        "path",
        "period",
        "category",
        F.when(F.col("period").isNull() | F.col("category").isNull(), "SKIP")
        .when(F.col("fault").isNotNull(), "FAIL")
        .when(cut > 0, "CUT")
        .when(n > 0, "OK")
        .otherwise("FAIL")
        .alias("status"),
        F.when(F.col("period").isNull(), "no year in name")
        .when(F.col("category").isNull(), "unknown type")
        .when(F.col("fault").isNotNull(), F.concat(F.lit("cannot be read: "), "fault"))
        .when(cut > 0, F.concat(cut.cast("string"), F.lit(" rows of the section left out")))
        .when(n == 0, "no rows in section")
        .alias("reason"),
        n.alias("rows"),
        cut.alias("rows_cut"),
    )
