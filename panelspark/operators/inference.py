"""Column types inferred from text, by a lattice whose states merge."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DataType, DoubleType, LongType, StringType, StructField, StructType

from panelspark.functions.numeric import NUMBER_PATTERN, strip
from panelspark.sources.readers import read_text_columns

# A value's kind is a bit; a column's state is the bits of its values, so states of parts merge by "or".
MISSING, WHOLE, DECIMAL, LOGICAL, OVERSIZED, TEXT = (1 << i for i in range(6))

# Texts that stand for a missing value, and for the two logical ones.
MISSING_TEXTS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN",
    "None", "n/a", "nan", "null",
)
LOGICAL_TEXTS = ("True", "TRUE", "true", "False", "FALSE", "false")
_INFINITE = r"(?i)^[+-]?inf(inity)?$"


def value_kind(column: Column) -> Column:
    """The bit of a text's kind; numbers may have blanks around them."""
    number = strip(column)
    whole = number.rlike(r"^[+-]?\d+$")
    return (
        F.when(column.isNull() | column.isin(*MISSING_TEXTS), MISSING)
        .when(whole & number.try_cast("bigint").isNotNull(), WHOLE)
        .when(whole, OVERSIZED)
        .when(number.rlike(NUMBER_PATTERN) | number.rlike(_INFINITE), DECIMAL)
        .when(column.isin(*LOGICAL_TEXTS), LOGICAL)
        .otherwise(TEXT)
    )


def kind_type(state: Column) -> Column:
    """The type that a column's state asks for.

    Whole numbers are ``bigint`` and, with gaps, ``double``, as are numbers with decimals and columns of gaps alone; logical values
    without gaps are ``boolean``. All else is ``string``: text, mixtures, whole numbers beyond 64 bits, columns without a row.
    """
    found = state.bitwiseAND(F.lit(~MISSING))
    gaps = state.bitwiseAND(F.lit(MISSING)) != 0
    return (
        F.when(state.isNull(), "string")
        .when(found == 0, "double")
        .when(found == WHOLE, F.when(gaps, "double").otherwise("bigint"))
        .when(found.bitwiseAND(F.lit(~(WHOLE | DECIMAL))) == 0, "double")
        .when((found == LOGICAL) & ~gaps, "boolean")
        .otherwise("string")
    )


def column_states(text: DataFrame) -> DataFrame:
    """``column, rows, missing, state`` of every column of a table of strings, in one aggregate.

    States of parts of a table, such as one per file or day, merge by :func:`merge_states`.
    """
    figures = [
        F.struct(
            F.lit(name).alias("column"),
            F.count(F.lit(1)).alias("rows"),
            F.count_if(value_kind(F.col(f"`{name}`")) == MISSING).alias("missing"),
            F.bit_or(value_kind(F.col(f"`{name}`"))).alias("state"),
        )
        for name in text.columns
    ]
    if not figures:
        return text.sparkSession.createDataFrame([], "column string, rows bigint, missing bigint, state int")
    return text.agg(F.array(*figures).alias("c")).select(F.explode("c").alias("c")).select("c.*")


def merge_states(states: DataFrame) -> DataFrame:
    """The states of several parts as those of the whole; a column that a part lacks is missing in none of its rows."""
    return states.groupBy("column").agg(F.sum("rows").alias("rows"), F.sum("missing").alias("missing"), F.bit_or("state").alias("state"))


def inferred_types(text: DataFrame) -> DataFrame:
    """``column, rows, missing, type`` of every column of a table of strings."""
    return column_states(text).select("column", "rows", "missing", kind_type(F.col("state")).alias("type"))


_TYPES: dict[str, DataType] = {"bigint": LongType(), "double": DoubleType(), "boolean": BooleanType(), "string": StringType()}


def read_inferred(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header, every column of the type that its values have; texts that stand for missing values are NULL.

    The values are looked through in one pass; of it the driver sees a row per column.
    """
    text = read_text_columns(spark, path)
    kinds = {r["column"]: r["type"] for r in inferred_types(text).collect()}
    schema = StructType([StructField(c, _TYPES[kinds[c]]) for c in text.columns])
    plain = [F.when(~F.col(f"`{c}`").isin(*MISSING_TEXTS), F.col(f"`{c}`")).alias(c) for c in text.columns]
    typed = []
    for f in schema:
        column = F.col(f"`{f.name}`")
        typed.append((column if f.dataType == StringType() else strip(column).try_cast(f.dataType)).alias(f.name))
    return text.select(*plain).select(*typed)
