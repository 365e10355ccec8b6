"""Readers: panels from CSV or parquet, optional inputs, file listings, GeoJSON."""

from collections.abc import Mapping
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, IntegralType, StructType

from panelspark import schema as S
from panelspark.functions.numeric import strip, to_count, to_number
from panelspark.sources.files import as_path, file_heads, first_file, list_files, listing, not_opened
from panelspark.sources.raw_cells import split_cells
from panelspark.sources.records import cut_records, has_line_breaks, read_collection, read_pieces

__all__ = ["first_file", "list_files", "read_csv", "read_geojson", "read_optional", "read_source", "read_tolerant"]


_QUOTES = {"escape": '"'}  # quotes within quoted cells are doubled


def _header_groups(spark: SparkSession, path: str) -> list[tuple[str, list[str]]]:
    """The distinct headers of a folder's files, each with its files, or the folder itself where all agree.

    Of each file the first record is read, by tasks that share the files; from a store that only Spark's readers open, the
    lines of the files' first splits. What reaches the driver are the distinct headers, and the names of files
    (which listing them needs anyway) if there is more than one.
    """
    heads = file_heads(listing(spark, path))
    if heads.filter(not_opened(F.col("fault"))).limit(1).count():
        lines = read_pieces(spark, path)
        heads = lines.filter("start = 0").groupBy("path").agg(F.min_by("value", "id").alias("head"))
    else:
        heads = heads.withColumn("head", F.when(F.col("fault").isNotNull(), F.raise_error(F.concat_ws(": ", "path", "fault"))).otherwise(F.col("head")))
    heads = heads.filter(F.trim("head") != "")
    headers = [r["head"] for r in heads.select("head").distinct().orderBy("head").collect()]
    if len(headers) < 2:
        return [(h, [path]) for h in headers]
    files = heads.groupBy("head").agg(F.sort_array(F.collect_list("path")).alias("files")).collect()
    return [(r["head"], [as_path(f) for f in r["files"]]) for r in sorted(files, key=lambda r: r["head"])]


def _header_names(spark: SparkSession, header: str) -> list[str]:
    """The column names of a header; a name that repeats gets its place, so that the first keeps it."""
    names = spark.range(1).select(split_cells(F.lit(header))).first()[0]
    return [n if n and n not in names[:i] else f"{n}_c{i}" for i, n in enumerate(names)]


def _csv(spark: SparkSession, header: str, paths: list[str], line_breaks: bool | None) -> DataFrame:
    """Delimited text with a header as strings. Cells may hold line breaks; files are split all the same."""
    schema = ", ".join(f"`{n.replace('`', '``')}` string" for n in _header_names(spark, header))
    lines = read_pieces(spark, paths)
    if not (has_line_breaks(lines) if line_breaks is None else line_breaks):
        return spark.read.options(header=True, **_QUOTES).schema(schema).csv(paths)
    records = cut_records(lines).filter((F.col("row_idx") > 0) & F.col("value").rlike(r"[^\x00-\x20]"))
    return records.select(F.from_csv("value", schema, _QUOTES).alias("r")).select("r.*")


def _cast(column: Column, kind: DataType) -> Column:
    """A text as the type; whole numbers may be written with a decimal part of zeros (``12.0``)."""
    direct = column.try_cast(kind)
    if not isinstance(kind, IntegralType):
        return direct
    number = to_number(column)
    return F.coalesce(strip(column).try_cast(kind), F.when(number == F.rint(number), number.try_cast(kind)))


def read_text_columns(spark: SparkSession, path: str, line_breaks: bool | None = None) -> DataFrame:
    """CSV with a header as strings, by the name of the column; a column that a file lacks is NULL in its rows."""
    parts = [_csv(spark, header, paths, line_breaks) for header, paths in _header_groups(spark, path)]
    if not parts:
        return spark.createDataFrame([], StructType([]))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def read_csv(spark: SparkSession, path: str, columns: StructType = S.PANEL, line_breaks: bool | None = None) -> DataFrame:
    """CSV with a header, columns matched by name and cast to the schema; values that do not parse become NULL.

    A file begins with its header. Files of one folder may have their columns in different orders; a column that a file lacks is NULL.
    Quoted cells may hold line breaks, and files are split all the same (``records.cut_records``);
    ``line_breaks`` False spares the look for such cells. Files without a line, and folders of them, have no rows.
    """
    text = read_text_columns(spark, path, line_breaks)
    null = F.lit(None).cast("string")
    return text.select(*[_cast(F.col(f.name) if f.name in text.columns else null, f.dataType).alias(f.name) for f in columns])


def read_source(
    spark: SparkSession,
    path: str,
    rename: Mapping[str, str],
    source: str,
    where: Mapping[str, str] | None = None,
) -> DataFrame:
    """A CSV of other column names as panel rows: filtered, renamed, tagged with its source."""
    df = read_text_columns(spark, path)
    for column, value in (where or {}).items():
        df = df.filter(F.col(column) == value)
    return df.withColumnsRenamed(dict(rename)).select("entity", "period", "category", "total", F.lit(source).alias("source"))


def read_tolerant(spark: SparkSession, path: str) -> DataFrame:
    """Panel rows out of a CSV with bad rows: numbers are truncated, keys trimmed, rows that do not parse skipped."""
    text = read_csv(spark, path, S.all_strings(S.PANEL))
    period = F.when(strip(F.col("period")).rlike(r"^[+-]?\d+$"), strip(F.col("period")).try_cast("int"))
    return text.select(
        strip(F.col("entity")).alias("entity"),
        period.alias("period"),
        strip(F.col("category")).alias("category"),
        to_count(F.col("total")).alias("total"),
    ).dropna()


def read_optional(
    spark: SparkSession, path: str, columns: StructType = S.PANEL, fmt: str = "csv"
) -> DataFrame:
    """The file, or an empty table of its schema when it does not exist."""
    try:
        if fmt == "csv":
            return read_csv(spark, path, columns)
        return spark.read.schema(columns).format(fmt).load(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], columns)


def read_geojson(spark: SparkSession, path: str, one_per_line: bool = False) -> DataFrame:
    """Features (properties, geometry) of FeatureCollection documents, or of files with a feature per line.

    Both forms split: a document, on one line or many, is cut into its features by as many tasks as it has
    splits (``records.cut_features``). A NULL type counts as that of a feature.
    """
    if one_per_line:
        return spark.read.schema(S.GEO_FEATURE).json(path)
    return read_collection(spark, path)
