"""Panels, sheets and shapes over the star-schema tables: what the registered queries run on.

Facts are summed on their own keys before each dimension join. A customer or
supplier holding a large part of all rows is then one row per period when it
meets the join. Only lines meet their orders unsummed: nearly every line is its
own (order, supplier), so a sum would shuffle the largest table for nothing; an
order with very many lines is split by the adaptive skew join.
"""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelspark.operators.groups import lookup_from_arrays
from panelspark.operators.panel import union_sources
from panelspark.sources import sinks

SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
PERIODS = [1995, 1996, 1997, 1998, 1999, 2000, 2001]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def order_panel(spark: SparkSession, folder: str) -> DataFrame:
    """nation x market segment x order year, number of orders."""
    by_customer = (
        table(spark, folder, "orders")
        .groupBy("o_custkey", F.year("o_orderdate").alias("period"))
        .agg(F.count(F.lit(1)).alias("total"))
    )
    customers = table(spark, folder, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    by_nation = (
        by_customer.join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy("c_nationkey", F.col("c_mktsegment").alias("category"), "period")
        .agg(F.sum("total").alias("total"))
    )
    nations = table(spark, folder, "nation").select("n_nationkey", F.col("n_name").alias("entity"))
    return by_nation.join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select(
        "entity", "category", "period", "total", F.lit("orders").alias("source")
    )


def supplier_sums(spark: SparkSession, folder: str) -> DataFrame:
    """supplier key x order priority x order year, quantity."""
    orders = table(spark, folder, "orders").select(
        "o_orderkey", "o_orderpriority", F.year("o_orderdate").alias("period")
    )
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity")
    return (
        lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy("l_suppkey", F.col("o_orderpriority").alias("category"), "period")
        .agg(F.sum(F.col("l_quantity").cast("bigint")).alias("total"))
    )


def supplier_panel(spark: SparkSession, folder: str) -> DataFrame:
    """supplier x order priority x order year, quantity: the panel whose entities grow with the data."""
    return supplier_sums(spark, folder).select(
        F.col("l_suppkey").cast("string").alias("entity"),
        "category",
        "period",
        "total",
        F.lit("lines").alias("source"),
    )


def line_panel(spark: SparkSession, folder: str) -> DataFrame:
    """nation x order priority x order year, quantity."""
    suppliers = table(spark, folder, "supplier").select("s_suppkey", "s_nationkey")
    nations = table(spark, folder, "nation").select("n_nationkey", F.col("n_name").alias("entity"))
    return (
        supplier_sums(spark, folder)
        .join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
        .groupBy("s_nationkey", "category", "period")
        .agg(F.sum("total").alias("total"))
        .join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
        .select("entity", "category", "period", "total", F.lit("lines").alias("source"))
    )


def gapped_line_panel(spark: SparkSession, folder: str) -> DataFrame:
    """line_panel with a coverage gap, for what bridges gaps: 1998 is missing."""
    return line_panel(spark, folder).filter(F.col("period") != 1998)


def master_panel(spark: SparkSession, folder: str) -> DataFrame:
    """Both sources; their categories are disjoint."""
    return union_sources(order_panel(spark, folder), line_panel(spark, folder))


def dirty_orders(spark: SparkSession, folder: str) -> DataFrame:
    """order_panel as a careless source would hold it: padded names, totals as text, gaps, total rows."""
    clean = order_panel(spark, folder)
    rows = clean.select(
        F.concat(F.lit("  "), "entity", F.lit("\t")).alias("entity"),
        F.nullif(F.col("category"), F.lit("FURNITURE")).alias("category"),
        F.col("period").cast("string").alias("period"),
        F.when(F.col("category") == "BUILDING", F.concat("entity", F.lit(" n/a")))
        .otherwise(F.concat(F.col("total").cast("string"), F.lit(".7")))
        .alias("total"),
        "source",
    )
    totals = clean.groupBy("category", "period").agg(F.sum("total").cast("string").alias("total"))
    total_rows = totals.select(
        F.concat(F.lit("Total District(s) "), "category").alias("entity"),
        "category",
        F.col("period").cast("string").alias("period"),
        "total",
    )
    return union_sources(rows, total_rows)


def region_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """region -> its nations, upper-cased, for regions 0 to 3; nations of region 4 stay unmatched."""
    nations = table(spark, folder, "nation")
    regions = table(spark, folder, "region").filter(F.col("r_regionkey") < 4)
    nested = (
        nations.join(regions, F.col("n_regionkey") == F.col("r_regionkey"))
        .groupBy(F.col("r_name").alias("group"))
        .agg(F.collect_list(F.upper("n_name")).alias("members"))
    )
    return lookup_from_arrays(nested)


def supplier_sheets(spark: SparkSession, folder: str) -> DataFrame:
    """A raw sheet per supplier and order year, with a section per order priority.

    A section is a header row, a numbered row per nation of the customers and a
    total row. Sheets are of bounded size; their number grows with the data.
    Paths name a file type by the supplier's region; one region has an unknown
    type, and one lacks the year.
    """
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity")
    orders = table(spark, folder, "orders").select(
        "o_orderkey", "o_custkey", "o_orderpriority", F.year("o_orderdate").alias("year")
    )
    customers = table(spark, folder, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"))
    suppliers = table(spark, folder, "supplier").select("s_suppkey", "s_nationkey")
    nations = table(spark, folder, "nation").select("n_nationkey", "n_name", "n_regionkey")
    sums = (
        lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy("l_suppkey", "year", "o_orderpriority", "nation")
        .agg(F.sum(F.col("l_quantity").cast("bigint")).alias("qty"), F.count(F.lit(1)).alias("n"))
    )
    # A section has at most one row per nation, so it is put together as one array.
    sections = (
        sums.join(nations.drop("n_regionkey"), F.col("nation") == F.col("n_nationkey"))
        .groupBy("l_suppkey", "year", "o_orderpriority")
        .agg(F.sum("qty").alias("qty"), F.collect_list(F.struct("nation", "n_name", "qty", "n")).alias("nations"))
        .join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(nations.select("n_nationkey", "n_regionkey"), F.col("s_nationkey") == F.col("n_nationkey"))
    )
    kinds = F.array(*[F.lit(k) for k in ("Jeveniles_IPC", "Crime_Women", "Cyber", "Unsorted", "Missing")])
    # Years of the tables lie before the pattern's 2010-2029; the keys in file
    # names are spelled in letters so that they never look like a year.
    undated = F.col("n_regionkey") == 2
    folder_name = F.when(undated, "undated").otherwise((F.col("year") + 20).cast("string"))
    stem = F.concat(F.when(undated, F.col("year").cast("string")).otherwise(""), F.col("l_suppkey").cast("string"))
    path = F.concat(
        F.lit("sheets/"), folder_name, F.lit("/"), F.element_at(kinds, F.col("n_regionkey") + 1),
        F.lit("_"), F.translate(stem, "0123456789", "abcdefghij"), F.lit(".csv"),
    )
    first = (F.substring("o_orderpriority", 1, 1).cast("bigint") - 1) * 27
    blank = F.array_repeat(F.lit("0"), 18)

    def sheet_row(offset, *cells):
        return F.struct((F.col("first") + offset).alias("row_idx"), F.concat(*cells).alias("cells"))

    header = sheet_row(F.lit(0), F.array(F.concat(F.lit("State : "), "o_orderpriority")))
    total = sheet_row(
        F.lit(26), F.array(F.lit("26"), F.lit("Total District(s)")), blank, F.array(F.col("qty").cast("string"))
    )
    body = F.transform(
        "nations",
        lambda r: sheet_row(
            r["nation"] + 1,
            F.array(F.concat((r["nation"] + 1).cast("string"), F.lit(".")), r["n_name"]),
            blank,
            # A nation with a single line has no usable value.
            F.array(F.when(r["n"] == 1, "NA").otherwise(F.concat(r["qty"].cast("string"), F.lit(".0")))),
        ),
    )
    placed = sections.select(path.alias("path"), first.alias("first"), "o_orderpriority", "qty", "nations")
    rows = placed.select("path", F.explode(F.concat(F.array(header), body, F.array(total))).alias("r"))
    return rows.select("path", "r.row_idx", "r.cells")


# How long sheets spell the header of the section that is looked for, by supplier.
HEADERS = (("State : {}",), ("", "state:{}"), ("STATE :{}",), ("{}",), ("", "", "rows of {} follow"))


def long_sheets(spark: SparkSession, folder: str, section: str) -> DataFrame:
    """A sheet per supplier with a row per nation of the customers and order month, longer than a page.

    Sections follow one another by priority, the wanted one second; its header is
    spelled in one of five ways, one of them found only by the fallback. Names hold commas.
    """
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity")
    orders = table(spark, folder, "orders").select(
        "o_orderkey", "o_custkey", "o_orderpriority", F.date_format("o_orderdate", "yyyy-MM").alias("month")
    )
    customers = table(spark, folder, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"))
    nations = table(spark, folder, "nation").select("n_nationkey", "n_name")
    sums = (
        lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy("l_suppkey", "o_orderpriority", "nation", "month")
        .agg(F.sum(F.col("l_quantity").cast("bigint")).alias("qty"))
        .join(nations, F.col("nation") == F.col("n_nationkey"))
        # A sheet's rows meet in one task once, for the numbers of their lines and for their file.
        .repartition("l_suppkey")
    )
    place = F.when(F.col("o_orderpriority") == section, 1.5).otherwise(F.substring("o_orderpriority", 1, 1).cast("double"))
    place = F.when(F.col("o_orderpriority") == "2-HIGH", 1.0).otherwise(place)
    # A section has at most one row per nation and month, and a sheet one per section.
    series = Window.partitionBy("l_suppkey", "o_orderpriority").orderBy("n_name", "month")
    numbered = sums.withColumn("_line", F.row_number().over(series))
    # A section's first row is preceded by its header, which is line 0.
    own = F.when(F.col("_line") == 1, F.array(F.lit(0), "_line")).otherwise(F.array("_line"))
    body = F.array(
        F.concat(F.col("line").cast("string"), F.lit(".")),
        F.concat("n_name", F.lit(", "), "month"),
        F.lit("x"),
        F.concat(F.col("qty").cast("string"), F.lit(".0")),
    )
    spelled = F.element_at(
        F.array(*[F.array(*[F.lit(c.format(section)) for c in cells]) for cells in HEADERS]),
        (F.col("l_suppkey") % len(HEADERS) + 1).cast("int"),
    )
    header = F.when(F.col("o_orderpriority") == section, spelled).otherwise(F.array(F.concat(F.lit("State: "), "o_orderpriority")))
    return numbered.withColumn("line", F.explode(own)).select(
        "l_suppkey", place.alias("section"), "line", F.when(F.col("line") == 0, header).otherwise(body).alias("cells")
    )


def csv_line(cells: Column) -> Column:
    """A delimited line; every cell is quoted."""
    joined = F.array_join(cells, '","')
    # Cells without quotes are joined at once; a single empty cell looks like none.
    plain = (joined != "") & ~F.array_join(cells, "").contains('"')
    quoted = F.transform(cells, lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"')))
    return F.when(plain, F.concat(F.lit('"'), joined, F.lit('"'))).otherwise(F.array_join(quoted, ","))


def write_sheets(rows: DataFrame, path: str) -> None:
    """One text file per supplier, in order, in folders named by year and supplier.

    A supplier's rows are in one task, as :func:`long_sheets` leaves them.
    """
    year = (F.lit(2015) + F.col("l_suppkey") % 5).alias("year")
    key = F.translate(F.col("l_suppkey").cast("string"), "0123456789", "abcdefghij").alias("key")
    named = rows.select(year, key, "l_suppkey", "section", "line", csv_line(F.col("cells")).alias("value"))
    sinks.write_texts(named, path, partition_by=("year", "key"), order=("l_suppkey", "section", "line"))


def embedding_shapes(spark: SparkSession, folder: str) -> DataFrame:
    """embeddings as shapes: each vector's 64 numbers are one ring of 32 points, row by row."""
    ring = F.expr(
        "transform(sequence(0, size(embedding) div 2 - 1), i -> "
        "struct(cast(embedding[2 * i] as double) as x, cast(embedding[2 * i + 1] as double) as y))"
    )
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").cast("string").alias("name"),
        F.concat(F.lit("NATION_"), F.col("label").cast("string")).alias("entity"),
        F.array(ring).alias("rings"),
    )


def holed_features(spark: SparkSession, folder: str) -> DataFrame:
    """embeddings as GeoJSON features ``(name, kind, coordinates text)`` of every geometry that occurs.

    By ``vec_id div 2 % 4``: a Polygon of 16 points with a hole of 16; a MultiPolygon of a part with a hole
    and a part without; a Point; a Polygon without rings.
    """
    points = F.expr(
        "transform(sequence(0, size(embedding) div 2 - 1), i -> "
        "array(cast(embedding[2 * i] as double), cast(embedding[2 * i + 1] as double)))"
    )
    kind = F.expr("cast(vec_id div 2 % 4 as int)")
    p = table(spark, folder, "embeddings").select("vec_id", kind.alias("k"), points.alias("p"))

    def ring(first: int, count: int) -> Column:
        return F.slice("p", first, count)

    polygon = F.to_json(F.array(ring(1, 16), ring(17, 16)))
    multi = F.to_json(F.array(F.array(ring(1, 16), ring(17, 8)), F.array(ring(25, 8))))
    return p.select(
        "vec_id",
        F.element_at(F.array(*map(F.lit, ("Polygon", "MultiPolygon", "Point", "Polygon"))), F.col("k") + 1).alias("kind"),
        F.when(F.col("k") == 0, polygon).when(F.col("k") == 1, multi).when(F.col("k") == 2, F.to_json(ring(1, 1)[0])).otherwise("[]").alias("coordinates"),
    )


def feature_text(name: Column, kind: Column, coordinates: Column) -> Column:
    """A feature as JSON text."""
    head = F.concat(F.lit('{"type":"Feature","properties":{"Dist_Name":"'), name, F.lit('"},"geometry":{"type":"'), kind)
    return F.concat(head, F.lit('","coordinates":'), coordinates, F.lit("}}"))
