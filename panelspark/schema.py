"""Explicit schemas. CSV is read as text by header and cast to one of these; other sources are read with one."""

from pyspark.sql import types as T

PANEL = T.StructType(
    [
        T.StructField("entity", T.StringType()),
        T.StructField("period", T.IntegerType()),
        T.StructField("category", T.StringType()),
        T.StructField("total", T.LongType()),
        T.StructField("source", T.StringType()),
    ]
)

RAW_CELLS = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("row_idx", T.LongType()),
        T.StructField("cells", T.ArrayType(T.StringType())),
    ]
)

LOOKUP = T.StructType(
    [
        T.StructField("group", T.StringType()),
        T.StructField("member", T.StringType()),
    ]
)

PREDICTIONS = T.StructType(
    [
        T.StructField("entity", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("actual", T.LongType()),
        T.StructField("predicted", T.LongType()),
        T.StructField("change", T.LongType()),
        T.StructField("change_pct", T.DoubleType()),
    ]
)

# GeoJSON: coordinates stay text here because their nesting depth depends on
# the geometry type; operators.geometry parses them with the right schema.
GEO_FEATURE = T.StructType(
    [
        T.StructField("properties", T.MapType(T.StringType(), T.StringType())),
        T.StructField(
            "geometry",
            T.StructType(
                [
                    T.StructField("type", T.StringType()),
                    T.StructField("coordinates", T.StringType()),
                ]
            ),
        ),
    ]
)
GEO_COLLECTION = T.StructType([T.StructField("features", T.ArrayType(GEO_FEATURE))])


def all_strings(schema: T.StructType) -> T.StructType:
    """The same columns, every one a string: for tolerant scans."""
    return T.StructType([T.StructField(f.name, T.StringType()) for f in schema])
