"""Registered queries and the equivalent SQL they are checked against.

``queries()`` runs the library over the star-schema tables (see
``panelspark.plans.warehouse``); ``oracle_sql()`` states the same results in
plain SQL, written independently of how the library computes them.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark import presets
from panelspark.functions import labels
from panelspark.operators import (
    changes,
    distinct,
    forecast,
    geometry,
    groups,
    inference,
    intensity,
    marts,
    panel,
    rankings,
    report_cards,
    sheets,
    trends,
)
from panelspark.plans import pipeline
from panelspark.plans import warehouse as wh
from panelspark.plans.lineage import materialise, shared_folder
from panelspark.plans.store import TableStore
from panelspark.schema import PANEL
from panelspark.sources import files, readers, sinks
from panelspark.sources.raw_cells import read_raw_cells

try:
    from panelspark.llm import registry as llm
except ModuleNotFoundError as error:  # the subpackage may be left out
    if not (error.name or "").startswith("panelspark.llm"):
        raise
    llm = None
try:
    import corpus_pipeline
except ModuleNotFoundError as error:
    if error.name != "corpus_pipeline" and not (error.name or "").startswith("panelspark.llm"):
        raise
    corpus_pipeline = None

SECTION = "1-URGENT"


def entry(spark: SparkSession) -> DataFrame:
    """Ranking of nations over both sources."""
    return rankings.entity_ranking(wh.master_panel(spark, "/root/testdata/sf0.001"))


# --------------------------------------------------------------------------
# Queries
# --------------------------------------------------------------------------


def _lagged(spark: SparkSession, d: str) -> DataFrame:
    return forecast.lag_features(pipeline.panel_cells(wh.supplier_panel(spark, d)), cells=True)


def _features(spark: SparkSession, d: str) -> DataFrame:
    """The feature rows, computed once and kept for as long as the tables are the same ones."""
    store = TableStore(spark)
    cells = store.load(panel.cube(wh.supplier_panel(spark, d), ["entity", "category", "period"]))
    return store.load(forecast.lag_features(cells, cells=True))


def _stored_features(spark: SparkSession, d: str) -> DataFrame:
    """The feature rows as the second of two loads gives them."""
    _features(spark, d)
    return _features(spark, d)


def _naive(spark: SparkSession, d: str) -> DataFrame:
    """Next-period rows scored with their latest total plus half the last change."""
    nf = forecast.next_period_features(_features(spark, d))
    return forecast.score_next(nf.withColumn("prediction", (F.col("lag1") * 3 - F.col("lag2")) / 2))


def _ols(spark: SparkSession, d: str) -> DataFrame:
    features = _features(spark, d)
    train, _ = forecast.temporal_split(features)
    model = forecast.fit_models(train, {"linear_regression": {}})["linear_regression"]
    return forecast.forecast(model, forecast.next_period_features(features))


def _ols_metrics(spark: SparkSession, d: str) -> DataFrame:
    train, test = forecast.temporal_split(_features(spark, d))
    return forecast.evaluate(forecast.fit_models(train, {"linear_regression": {}}), test).drop("rmse_exact")


def _model_card(spark: SparkSession, d: str) -> DataFrame:
    """The record of a run with all three models, as JSON."""
    return marts.to_json_rows(pipeline.run_forecast(wh.supplier_panel(spark, d))["model_card"], key="best_model")


def _linear_card(spark: SparkSession, d: str) -> DataFrame:
    """The record of a run with the linear model, field by field."""
    card = pipeline.run_forecast(wh.supplier_panel(spark, d), {"linear_regression": {}})["model_card"]
    return card.select(
        "best_model", "mae", "rmse", "r2", "entities", F.array_join("categories", "|").alias("categories"),
        F.array_join("periods_trained", "|").alias("periods"), "prediction_period", "train_rows", "test_rows",
    )


def _importance(spark: SparkSession, d: str) -> DataFrame:
    only = {"random_forest": forecast.DEFAULT_PARAMS["random_forest"]}
    return pipeline.run_forecast(wh.supplier_panel(spark, d), only)["importance"]


def _model_checks(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of every fitted model, a row each."""
    features = _features(spark, d)
    train, test = forecast.temporal_split(features)
    models = forecast.fit_models(train)
    metrics = materialise(forecast.evaluate(models, test))
    chosen, _ = forecast.select_best(models, metrics)
    weights = [
        forecast.feature_importance(m, features).agg(
            F.lit(n).alias("model"),
            F.countDistinct("feature").alias("features"),
            F.coalesce(F.round(F.sum("importance"), 6), F.lit(0.0)).alias("importance"),
        )
        for n, m in models.items()
    ]
    weights = weights[0].union(weights[1]).union(weights[2])
    ends = train.agg(F.struct(F.min("total").alias("lo"), F.max("total").alias("hi"))).scalar()
    forest = models["random_forest"].transform(test).withColumn("_e", ends)
    inside = forest.agg(F.min(F.col("prediction").between(F.col("_e.lo"), F.col("_e.hi"))).alias("ok")).scalar()
    smallest = metrics.agg(F.min("rmse_exact")).scalar()
    checked = metrics.withColumn("_ok", inside).withColumn("_least", smallest)
    return checked.join(F.broadcast(weights), "model").select(
        "model",
        "rows",
        (F.col("mae") <= F.col("rmse")).alias("mae_in_rmse"),
        F.when(F.col("model") == "random_forest", F.col("_ok")).otherwise(F.lit(True)).alias("within_training"),
        ((F.col("rmse_exact") == F.col("_least")) == (F.col("model") == chosen)).alias("best_is_chosen"),
        "features",
        "importance",
    )


def _published_forecast(spark: SparkSession, d: str) -> DataFrame:
    """A forecast written under its published names and found again by them."""
    last = max(wh.PERIODS)
    named = pipeline.published("predictions", _naive(spark, d), latest=last, next=last + 1)
    return marts.read_published_forecast(named)


def _published_names(spark: SparkSession, d: str) -> DataFrame:
    panel_ = wh.master_panel(spark, d)
    trend = pipeline.published("category_trend", trends.category_trend(panel_), first=1995, last=2001)
    both = pipeline.published("compare_periods", changes.compare_periods(panel_, 1999, 2000), before=1999, after=2000)
    return trend.select("Crime_Type", "1995_count", "2001_count").join(
        both.select("Crime_Type", "Pre_COVID_1999", "During_COVID_2000"), "Crime_Type"
    )


def _careless_csv(spark: SparkSession, d: str, missing: str) -> DataFrame:
    """Orders as files of two column orders, with ``12.0``, gaps, unreadable totals and quotes, read and cleaned."""
    path = _scratch(spark, "careless")
    rows = wh.order_panel(spark, d).select(
        F.concat(F.lit(' "'), "entity", F.lit('", '), "category", F.lit("  ")).alias("entity"),
        F.concat(F.col("period").cast("string"), F.lit(".0")).alias("period"),
        F.when(F.col("category") != "FURNITURE", F.col("category")).alias("category"),
        F.when(F.col("category") == "BUILDING", "abc")
        .when(F.col("category") != "MACHINERY", F.concat(F.col("total").cast("string"), F.lit(".0")))
        .alias("total"),
        "source",
    )
    sinks.write_csv(rows.filter("period < '1998'"), f"{path}/a")
    sinks.write_csv(rows.filter("period >= '1998'").select("source", "total", "entity", "category", "period"), f"{path}/b")
    return panel.clean_panel(readers.read_csv(spark, f"{path}/*"), missing=missing)


def _geojson_paths(spark: SparkSession, d: str) -> DataFrame:
    """Every kind of geometry, half in line form and half in documents of 50 features: box, path and centre."""
    path = _scratch(spark, "holes")
    rows = wh.holed_features(spark, d)
    text = wh.feature_text(F.col("vec_id").cast("string"), F.col("kind"), F.col("coordinates"))
    rows.filter("vec_id % 2 = 0").select(text).write.text(f"{path}/lines")
    features = F.array_join(F.collect_list(text), ",")
    documents = rows.filter("vec_id % 2 = 1").groupBy(F.expr("vec_id div 100")).agg(
        F.concat(F.lit('{"type":"FeatureCollection","features":['), features, F.lit("]}")).alias("value")
    )
    # One file per document.
    documents.select("value").write.option("maxRecordsPerFile", 1).text(f"{path}/documents")
    read = readers.read_geojson(spark, f"{path}/lines", one_per_line=True).unionByName(
        readers.read_geojson(spark, f"{path}/documents")
    )
    projected = geometry.project(geometry.shapes(read))
    drawn = geometry.centroids(geometry.feature_paths(projected))
    return drawn.select("name", "path", F.round("center_x", 8).alias("center_x"), F.round("center_y", 8).alias("center_y"))


def _first_file(spark: SparkSession, d: str) -> DataFrame:
    """The panel's first period, in the first by name of several files written in parallel, one for each period."""
    path = _scratch(spark, "first")
    whole = wh.order_panel(spark, d).withColumn("named", F.col("period"))
    whole.repartition("named").write.partitionBy("named").options(header=True).csv(f"{path}/parts")
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = root.getFileSystem(spark._jsc.hadoopConfiguration())
    listed = files.list_files(spark, path, "*.csv").collect()
    for r in listed:  # one file of each period
        year = r["path"].split("named=")[1][:4]
        store.rename(spark._jvm.org.apache.hadoop.fs.Path(r["path"]), spark._jvm.org.apache.hadoop.fs.Path(f"{path}/panel {year}.csv"))
    return readers.read_csv(spark, files.first_file(spark, path))


def _broken_lines(spark: SparkSession, d: str) -> DataFrame:
    """Order lines with a note of one to four lines, that holds commas and quotes."""
    note = F.concat(
        F.lit("line "), "l_linenumber", F.when(F.col("l_quantity") % 3 == 0, F.concat(F.lit('\nof "order"\n, '), "l_orderkey")).otherwise(", plain"),
        F.when(F.col("l_quantity") % 7 == 0, '\n\n"').otherwise(""),
    )
    return wh.table(spark, d, "lineitem").select(
        F.concat("l_orderkey", F.lit("-"), "l_linenumber").alias("entity"),
        F.year("l_shipdate").alias("period"),
        note.alias("category"),
        F.col("l_quantity").cast("bigint").alias("total"),
        F.lit("lines").alias("source"),
    )


def _csv_line_breaks(spark: SparkSession, d: str) -> DataFrame:
    """CSV files whose quoted cells hold line breaks, written and read by many tasks."""
    path = _scratch(spark, "breaks")
    sinks.write_csv(_broken_lines(spark, d), path)
    return readers.read_csv(spark, path)


def _raw_line_breaks(spark: SparkSession, d: str) -> DataFrame:
    """The same files as raw cells: the cells of every record but the headers, and the numbers that are missing in each file."""
    path = _scratch(spark, "breaks")
    sinks.write_csv(_broken_lines(spark, d), path)
    rows = read_raw_cells(spark, path)
    per_file = rows.groupBy("path").agg((F.max("row_idx") + 1 - F.count_distinct("row_idx")).alias("gaps"))
    cells = [F.element_at("cells", i + 1).alias(c) for i, c in enumerate(("entity", "period", "category"))]
    return rows.filter("row_idx > 0").join(per_file, "path").select(*cells, "gaps")


def _faulty_files(spark: SparkSession, d: str) -> DataFrame:
    """The audit of a load of sheets of which one year's are damaged: named as compressed files, they are none."""
    path = _scratch(spark, "faulty")
    wh.write_sheets(wh.long_sheets(spark, d, SECTION), path)
    store_path = spark._jvm.org.apache.hadoop.fs.Path
    store = store_path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for r in files.list_files(spark, path).filter(F.col("path").contains("year=2016")).collect():
        store.rename(store_path(r["path"]), store_path(r["path"][: -len(".txt")] + ".csv.gz"))
    found = files.listing(spark, path, files.SHEETS, recursive=True)  # serves the faults and the audit
    faults = materialise(files.file_faults(spark, path, found=found))  # read three times
    rows = sheets.extract_sections(read_raw_cells(spark, path, faults=faults), SECTION, words=_ANY_NAME)
    audit = sheets.load_audit(found, rows, words=_ANY_NAME, faults=faults)
    below = F.regexp_extract("path", "(year=[^/]*/key=[^/]*)/[^/]*$", 1)
    return audit.select(below.alias("path"), "period", "status", F.substring("reason", 1, 14).alias("reason"), "rows")


def _inferred_types(spark: SparkSession, d: str) -> DataFrame:
    """The type of every column of a file of orders with gaps, logical values, mixtures and numbers of all kinds."""
    path = _scratch(spark, "types")
    o = wh.table(spark, d, "orders")
    key = F.col("o_orderkey")
    sinks.write_csv(
        o.select(
            key.alias("whole"),
            F.when(key % 5 > 0, key).alias("gaps"),
            F.when(key % 2 == 0, "true").otherwise("False").alias("logical"),
            F.when(key % 9 == 0, "n/a").otherwise("TRUE").alias("logical_gaps"),
            F.concat(F.lit(" "), "o_totalprice", F.lit(" ")).alias("decimal"),
            F.when(key % 50 == 0, "-inf").otherwise(F.concat(key, F.lit("e-3"))).alias("scientific"),
            F.concat(F.lit("9223372036854775"), F.lpad(F.pmod(key, F.lit(1000)).cast("string"), 3, "0"), F.lit("9")).alias("large"),
            F.when(key % 100 == 0, "12,5").otherwise(key.cast("string")).alias("mixed"),
            F.lit(None).cast("string").alias("nothing"),
            F.col("o_orderpriority").alias("text"),
        ),
        path,
    )
    return inference.inferred_types(readers.read_text_columns(spark, path))


def _read_inferred(spark: SparkSession, d: str) -> DataFrame:
    """Orders written as text and read with inferred types."""
    path = _scratch(spark, "inferred")
    o = wh.table(spark, d, "orders")
    odd = F.when(F.col("o_custkey") % 4 == 0, "NA").otherwise(F.col("o_custkey").cast("string"))
    sinks.write_csv(o.select("o_orderkey", odd.alias("o_custkey"), (F.col("o_orderstatus") == "F").alias("is_f"), "o_orderpriority"), path)
    return inference.read_inferred(spark, path)


def _distinct_bitmaps(spark: SparkSession, d: str, running: bool) -> DataFrame:
    """Distinct keys of each period, or of all periods up to it, from one set of bitmaps."""
    keys = ["entity", "category"]
    bitmaps = distinct.distinct_bitmaps(wh.master_panel(spark, d), keys, by=["period"])
    return distinct.running_distinct(bitmaps, keys, "period") if running else distinct.count_distinct(bitmaps, keys, by=["period"])


def _trend_arrows(spark: SparkSession, d: str) -> DataFrame:
    rows = changes.yoy_changes(wh.supplier_panel(spark, d))
    return rows.select("entity", "category", "period", labels.arrow(F.col("change")).alias("arrow"), F.abs("change").alias("size"))


def _with_folder(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """The query in a session that has a shared folder: a local one without ``spark.checkpoint.dir``, as in a smoke test, gets one."""

    @wraps(query)
    def run(spark: SparkSession, d: str) -> DataFrame:
        context = spark.sparkContext
        if not (spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()) and context.master.split("[")[0] == "local":
            context.setCheckpointDir(tempfile.mkdtemp(prefix="panelspark-"))
        return query(spark, d)

    return run


def _scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/panelspark-{name}-{uuid.uuid4().hex}"


def _csv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    path = _scratch(spark, "csv")
    sinks.write_csv(wh.order_panel(spark, d), path)
    return readers.read_csv(spark, path)


def _json_round_trip(spark: SparkSession, d: str) -> DataFrame:
    path = _scratch(spark, "json")
    sinks.write_json_rows(wh.order_panel(spark, d), path)
    return spark.read.schema(PANEL).json(path)


def _partitioned_panel(spark: SparkSession, d: str) -> DataFrame:
    """Written by source and period, read back for one source: other folders are not read."""
    path = _scratch(spark, "panel")
    sinks.write_panel(wh.master_panel(spark, d), path)
    back = spark.read.parquet(path).filter((F.col("source") == "lines") & (F.col("period") >= 1999))
    return panel.cube(back, ["entity", "period"])


def _tolerant_scan(spark: SparkSession, d: str) -> DataFrame:
    path = _scratch(spark, "dirty")
    sinks.write_csv(wh.dirty_orders(spark, d), path)
    return readers.read_tolerant(spark, path)


def _optional_input(spark: SparkSession, d: str) -> DataFrame:
    missing = readers.read_optional(spark, f"{d}/no_such_table.parquet", fmt="parquet")
    return panel.union_sources(wh.order_panel(spark, d), missing)


def _second_source(spark: SparkSession, d: str) -> DataFrame:
    """A source under other names, of which one section is taken."""
    path = _scratch(spark, "second")
    regions = wh.table(spark, d, "nation").join(
        wh.table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    named = wh.order_panel(spark, d).join(regions, F.col("entity") == F.col("n_name"))
    foreign = {"entity": "District", "period": "Year", "category": "Crime_Type", "total": "Cases_Reported"}
    sinks.write_csv(named.select("r_name", *foreign, "source").withColumnsRenamed({**foreign, "r_name": "State"}), path)
    source = readers.read_source(spark, path, presets.SECOND_SOURCE_COLUMNS, "second", where={"State": "ASIA"})
    return panel.clean_panel(source)


def _raw_text_cells(spark: SparkSession, d: str) -> DataFrame:
    """Delimited text read back as numbered rows of cells."""
    path = _scratch(spark, "text")
    line = F.concat("entity", F.lit(',"'), "category", F.lit(', ""quoted""",'), "period", F.lit(","), "total")
    wh.supplier_panel(spark, d).select(line).write.text(path)
    rows = read_raw_cells(spark, path)
    per_file = rows.groupBy("path").agg((F.max("row_idx") + 1 - F.count_distinct("row_idx")).alias("gaps"))
    return rows.join(per_file, "path").select(
        *[F.element_at("cells", i + 1).alias(c) for i, c in enumerate(("entity", "category", "period", "total"))], "gaps"
    )


def _geojson_vertices(spark: SparkSession, d: str) -> DataFrame:
    """Shapes written as GeoJSON features, one per line, and read back."""
    path = _scratch(spark, "geo")
    points = F.transform("rings", lambda r: F.transform(r, lambda p: F.array(p["x"], p["y"])))
    wh.embedding_shapes(spark, d).select(
        F.lit("Feature").alias("type"),
        F.struct(F.col("name").alias("Dist_Name")).alias("properties"),
        F.struct(F.lit("Polygon").alias("type"), points.alias("coordinates")).alias("geometry"),
    ).write.json(path)
    return geometry.vertices(geometry.shapes(readers.read_geojson(spark, path, one_per_line=True)))


def _temporal_split(spark: SparkSession, d: str) -> DataFrame:
    train, test = forecast.temporal_split(_features(spark, d))
    both = train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))
    return both.groupBy("part", "period").agg(
        F.count(F.lit(1)).alias("n"), F.sum("total").alias("total"), F.sum("lag1").cast("bigint").alias("lag1_sum")
    )


def _extracted(spark: SparkSession, d: str) -> DataFrame:
    return sheets.extract_sections(wh.supplier_sheets(spark, d), SECTION)


def _load_audit(spark: SparkSession, d: str) -> DataFrame:
    raw = wh.supplier_sheets(spark, d)
    return sheets.load_audit(raw, sheets.extract_sections(raw, SECTION))


_ANY_NAME = ((("part",), "ipc"),)


def _sheet_name(path: Column) -> Column:
    """A sheet's path below its folder; the names of written files differ from run to run."""
    return F.concat(F.regexp_extract(path, "(year=[^/]*/key=[^/]*)/[^/]*$", 1), F.lit("/part"))


def _long_sheets(spark: SparkSession, d: str) -> tuple[DataFrame, str]:
    """Sheets written as text files and read back: their raw cells, kept as a table that is read several times, and their folder."""
    path = _scratch(spark, "sheets")
    wh.write_sheets(wh.long_sheets(spark, d, SECTION), path)
    raw = read_raw_cells(spark, path, named=_sheet_name)
    # Tasks that read a few small files each would write as many small tables; a task takes several.
    tasks = max(4 * spark.sparkContext.defaultParallelism, raw.rdd.getNumPartitions() // 16)
    return materialise(raw.coalesce(tasks)), path


def _sheet_files_panel(spark: SparkSession, d: str) -> DataFrame:
    """Text files -> raw cells -> sections -> panel rows."""
    raw, _ = _long_sheets(spark, d)
    bounds = materialise(sheets.section_bounds(raw, SECTION))
    rows = sheets.drop_aggregate_names(sheets.extract_sections(raw, SECTION, words=_ANY_NAME, bounds=bounds))
    return rows.withColumn("path", F.regexp_replace("path", "/part$", ""))


def _sheet_files_audit(spark: SparkSession, d: str) -> DataFrame:
    """The audit of an extraction with an explicit limit of 150 rows."""
    raw, path = _long_sheets(spark, d)
    bounds = materialise(sheets.section_bounds(raw, SECTION, max_rows=150))
    rows = sheets.extract_sections(raw, SECTION, words=_ANY_NAME, bounds=bounds)
    found = readers.list_files(spark, path).withColumn("path", _sheet_name(F.col("path")))
    audit = sheets.load_audit(found, rows, words=_ANY_NAME, bounds=bounds)
    return audit.withColumn("path", F.regexp_replace("path", "/part$", ""))


def _projected(spark: SparkSession, d: str) -> DataFrame:
    return geometry.project(wh.embedding_shapes(spark, d))


def _levels(spark: SparkSession, d: str) -> DataFrame:
    return intensity.risk_levels(intensity.intensity_scores(wh.supplier_panel(spark, d)))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    all_ = panel_queries() | (llm.queries() if llm else {}) | (
        {"pipeline": corpus_pipeline.run} if llm and corpus_pipeline else {}
    )
    return {name: _with_folder(query) for name, query in all_.items()}


def panel_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """The queries of the panel library, without those of its ``llm`` subpackage."""
    master, supplier = wh.master_panel, wh.supplier_panel
    return {
        # panel building
        "clean_panel": lambda s, d: panel.clean_panel(wh.dirty_orders(s, d), wh.line_panel(s, d)),
        "panel_overview": lambda s, d: panel.panel_overview(master(s, d)),
        "distinct_categories": lambda s, d: panel.distinct_values(master(s, d), "category"),
        "category_value_counts": lambda s, d: panel.value_counts(supplier(s, d), "category"),
        "rename_entities": lambda s, d: panel.cube(
            panel.rename_entities(master(s, d), {"NATION_1": "NATION_2", "NATION_7": "Seventh"}), ["entity"]
        ),
        # sources and sinks
        "csv_round_trip": _csv_round_trip,
        "careless_csv_merged": lambda s, d: _careless_csv(s, d, "drop"),
        "careless_csv_loaded": lambda s, d: _careless_csv(s, d, "zero"),
        "first_file": _first_file,
        "json_round_trip": _json_round_trip,
        "partitioned_panel": _partitioned_panel,
        "tolerant_scan": _tolerant_scan,
        "optional_input": _optional_input,
        "second_source": _second_source,
        "raw_text_cells": _raw_text_cells,
        "csv_line_breaks": _csv_line_breaks,
        "raw_line_breaks": _raw_line_breaks,
        "faulty_files_audit": _faulty_files,
        "inferred_types": _inferred_types,
        "read_inferred": _read_inferred,
        "distinct_by_period": lambda s, d: _distinct_bitmaps(s, d, running=False),
        "distinct_so_far": lambda s, d: _distinct_bitmaps(s, d, running=True),
        "stored_features": _stored_features,
        "geojson_vertices": _geojson_vertices,
        # trends
        "period_trend": lambda s, d: trends.period_trend(master(s, d)),
        "period_trend_by_source": lambda s, d: trends.period_trend(master(s, d), by=["source"]),
        "overall_change": lambda s, d: trends.overall_change(master(s, d)),
        "category_trend": lambda s, d: trends.category_trend(master(s, d)),
        "period_category_matrix": lambda s, d: trends.period_category_matrix(
            master(s, d), wh.SEGMENTS + wh.PRIORITIES
        ),
        "entity_period_matrix": lambda s, d: trends.entity_period_matrix(supplier(s, d), wh.PERIODS),
        "entity_trend": lambda s, d: trends.entity_trend(supplier(s, d)),
        "entity_trend_wide": lambda s, d: trends.spread_first_last(
            trends.entity_trend(wh.line_panel(s, d)), wh.PERIODS
        ),
        "category_middle": lambda s, d: trends.middle_value(master(s, d)),
        # rankings
        "entity_ranking": lambda s, d: rankings.entity_ranking(master(s, d)),
        "supplier_ranking": lambda s, d: rankings.entity_ranking(supplier(s, d)),
        "ranking_bars": lambda s, d: rankings.ranking_bars(rankings.entity_ranking(master(s, d))),
        "signature_top5": lambda s, d: rankings.signature_categories(master(s, d)),
        "supplier_signature": lambda s, d: rankings.signature_categories(supplier(s, d), k=3),
        "signature_summary": lambda s, d: rankings.signature_summary(rankings.top_categories(master(s, d))),
        "concentration": lambda s, d: rankings.concentration(supplier(s, d)),
        "worst_entity": lambda s, d: rankings.worst_entity(master(s, d)),
        "peak_best_period": lambda s, d: rankings.peak_best(supplier(s, d)),
        # intensity
        "intensity_by_period": lambda s, d: intensity.intensity_scores(supplier(s, d)),
        "risk_level": _levels,
        "risk_distribution": lambda s, d: intensity.risk_distribution(_levels(s, d)),
        "top_intensity": lambda s, d: marts.top_intensity(_levels(s, d)),
        # report cards
        "report_card": lambda s, d: report_cards.report_cards(supplier(s, d)),
        "grade_distribution": lambda s, d: report_cards.grade_distribution(report_cards.report_cards(supplier(s, d))),
        "grade_filter": lambda s, d: report_cards.filter_grades(
            report_cards.report_cards(supplier(s, d)), ["A", "B", "F"]
        ),
        # changes
        "yoy_changes": lambda s, d: changes.yoy_changes(supplier(s, d)),
        "yoy_gap_bridged": lambda s, d: changes.yoy_changes(wh.gapped_line_panel(s, d)),
        "top_spikes": lambda s, d: changes.top_spikes(changes.yoy_changes(supplier(s, d))),
        "top_drops": lambda s, d: changes.top_drops(changes.yoy_changes(supplier(s, d))),
        "two_period_compare": lambda s, d: changes.compare_periods(master(s, d), 1999, 2000),
        "compare_dropped": lambda s, d: changes.dropped(changes.compare_periods(master(s, d), 1999, 2000)),
        "compare_rose": lambda s, d: changes.rose(changes.compare_periods(master(s, d), 1999, 2000)),
        "regime_mean": lambda s, d: changes.regime_means(master(s, d), 1997),
        "regime_mean_by_source": lambda s, d: changes.regime_means(master(s, d), 1997, by=["source"]),
        # groups
        "division_by_period": lambda s, d: groups.group_rollup(master(s, d), wh.region_lookup(s, d)),
        "division_totals": lambda s, d: groups.group_totals(master(s, d), wh.region_lookup(s, d)),
        # sheets
        "file_rules": lambda s, d: sheets.classify_files(wh.supplier_sheets(s, d).select("path").distinct()),
        "sheet_extract": _extracted,
        "load_audit": _load_audit,
        "sheet_files_panel": _sheet_files_panel,
        "sheet_files_audit": _sheet_files_audit,
        # marts
        "kpi_row": lambda s, d: marts.kpis(master(s, d)),
        "latest_top10": lambda s, d: marts.latest_top(master(s, d)),
        "category_heatmap": lambda s, d: marts.heatmap(master(s, d), wh.PERIODS),
        "entity_heatmap": lambda s, d: marts.heatmap(master(s, d), wh.PERIODS, only_entity="NATION_3"),
        "category_series": lambda s, d: marts.category_series(supplier(s, d), "2-HIGH"),
        "category_top_entities": lambda s, d: marts.category_top_entities(supplier(s, d), "2-HIGH"),
        "top10_semi_series": lambda s, d: marts.category_top_series(supplier(s, d), "2-HIGH"),
        "compare_entities": lambda s, d: marts.compare_entities(
            master(s, d), ["NATION_3", "NATION_8", "NATION_21"], "5-LOW"
        ),
        "category_share": lambda s, d: marts.category_share(master(s, d)),
        "lowest10": lambda s, d: marts.lowest_entities(supplier(s, d)),
        "entity_profile_json": lambda s, d: marts.to_json_rows(marts.entity_profile(supplier(s, d))),
        "period_maps_json": lambda s, d: marts.to_json_rows(marts.period_maps(supplier(s, d))),
        "choropleth": lambda s, d: marts.choropleth(master(s, d), "5-LOW", wh.embedding_shapes(s, d)),
        # forecast
        "lag_features": _lagged,
        "temporal_split": _temporal_split,
        "forecast_features": lambda s, d: forecast.next_period_features(_features(s, d)),
        "naive_metrics": lambda s, d: forecast.regression_metrics(
            _lagged(s, d).withColumn("prediction", F.col("lag1"))
        ),
        "naive_forecast": _naive,
        "forecast_by_entity": lambda s, d: marts.forecast_by_entity(_naive(s, d)),
        "forecast_compare": lambda s, d: marts.forecast_compare(_naive(s, d)),
        "forecast_by_category": lambda s, d: marts.forecast_by_category(_naive(s, d)),
        "ols_forecast": _ols,
        "ols_metrics": _ols_metrics,
        "model_card": _model_card,
        "feature_importance": _importance,
        "model_compare": lambda s, d: pipeline.run_forecast(supplier(s, d))["metrics"],
        "model_checks": _model_checks,
        "linear_card": _linear_card,
        "published_forecast": _published_forecast,
        "published_names": _published_names,
        # shapes
        "vertices": lambda s, d: geometry.vertices(wh.embedding_shapes(s, d)),
        "vertex_bbox": lambda s, d: geometry.bbox(wh.embedding_shapes(s, d)),
        "project_vertices": lambda s, d: geometry.vertices(_projected(s, d)),
        "feature_centroid": lambda s, d: geometry.centroids(_projected(s, d)).select(
            "name", F.round("center_x", 8).alias("center_x"), F.round("center_y", 8).alias("center_y")
        ),
        "feature_path": lambda s, d: geometry.feature_paths(_projected(s, d)).select(
            "name", "path", labels.shorten(F.col("entity"), 7, 5).alias("label")
        ),
        "geojson_paths": _geojson_paths,
        "trend_arrows": _trend_arrows,
        "assign_colors": lambda s, d: geometry.assign_colors(wh.embedding_shapes(s, d)),
    }


# --------------------------------------------------------------------------
# Oracle SQL
# --------------------------------------------------------------------------

ORDERS = """
  SELECT n_name AS entity, c_mktsegment AS category, year(o_orderdate)::INTEGER AS period,
         count(*)::BIGINT AS total, 'orders' AS source
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  GROUP BY ALL"""
LINES = """
  SELECT n_name AS entity, o_orderpriority AS category, year(o_orderdate)::INTEGER AS period,
         sum(l_quantity)::BIGINT AS total, 'lines' AS source
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
       JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
  GROUP BY ALL"""
MASTER = f"WITH p AS ({ORDERS} UNION ALL {LINES})"
ONLY_LINES = f"WITH p AS ({LINES})"
GAPPED_LINES = f"WITH p AS (SELECT * FROM ({LINES}) WHERE period <> 1998)"
SUPPLIER = """WITH p AS (
  SELECT l_suppkey::VARCHAR AS entity, o_orderpriority AS category, year(o_orderdate)::INTEGER AS period,
         sum(l_quantity)::BIGINT AS total, 'lines' AS source
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL)"""


def _near(x: str, digits: int) -> str:
    """Half-even rounding of the scaled value."""
    return f"round_even(({x})::DOUBLE, {digits})"


def _exact(x: str, digits: int) -> str:
    """Half-even rounding of the exact value: on an apparent tie the product's error decides."""
    m = f"{10 ** digits}.0::DOUBLE"
    hi = "(v * 134217729.0::DOUBLE - (v * 134217729.0::DOUBLE - v))"
    err = f"(({hi} * {m} - v * {m}) + (v - {hi}) * {m})"
    return (
        f"list_transform([({x})::DOUBLE], lambda v: (CASE WHEN abs(v * {m} - round_even(v * {m}, 0)) = 0.5 "
        f"AND {err} > 0 THEN ceil(v * {m}) WHEN abs(v * {m} - round_even(v * {m}, 0)) = 0.5 AND {err} < 0 "
        f"THEN floor(v * {m}) ELSE round_even(v * {m}, 0) END) / {m})[1]"
    )


def _guarded(old: str, new: str, rounding=_exact) -> str:
    return (
        f"CASE WHEN {old} > 0 THEN "
        + rounding(f"({new} - {old})::DOUBLE / nullif({old}, 0)::DOUBLE * 100.0::DOUBLE", 1)
        + " ELSE 0.0 END"
    )


def _nullable(old: str, new: str, digits: int = 1) -> str:
    return _near(f"({new} - {old})::DOUBLE / nullif({old}, 0)::DOUBLE * 100.0::DOUBLE", digits)


def _share(part: str, whole: str, rounding=_exact) -> str:
    return (
        f"CASE WHEN {whole} > 0 THEN "
        + rounding(f"{part}::DOUBLE / nullif({whole}, 0)::DOUBLE * 100.0::DOUBLE", 1)
        + " ELSE 0.0 END"
    )


def _class(pct: str, band: float) -> str:
    return f"CASE WHEN {pct} > {band} THEN 'RISING' WHEN {pct} < -{band} THEN 'FALLING' ELSE 'STABLE' END"


EP = "ep AS (SELECT entity, period, sum(total)::BIGINT AS total FROM p GROUP BY ALL)"
EC = "ec AS (SELECT entity, category, sum(total)::BIGINT AS total FROM p GROUP BY ALL)"
CP = "cp AS (SELECT category, period, sum(total)::BIGINT AS total FROM p GROUP BY ALL)"
CELLS = "cells AS (SELECT entity, category, period, sum(total)::BIGINT AS total FROM p GROUP BY ALL)"
RANKED = """ranked AS (
  SELECT entity, sum(total)::BIGINT AS total,
         row_number() OVER (ORDER BY sum(total) DESC, entity)::BIGINT AS rank FROM p GROUP BY entity)"""

TREND = f"""tr AS (
  SELECT entity, min(period) AS first_period, arg_min(total, period) AS first_total,
         max(period) AS last_period, arg_max(total, period) AS last_total,
         count(*) FILTER (WHERE step > 0)::BIGINT AS rises, count(*) FILTER (WHERE step < 0)::BIGINT AS falls,
         {_guarded('arg_min(total, period)', 'arg_max(total, period)')} AS change_pct
  FROM (SELECT *, total - lag(total) OVER (PARTITION BY entity ORDER BY period) AS step FROM ep)
  GROUP BY entity HAVING count(*) >= 2)"""

SIGNATURE = """sig AS (
  SELECT *, row_number() OVER (PARTITION BY entity ORDER BY total DESC, category)::INTEGER AS rank,
         sum(total) OVER (PARTITION BY entity) AS whole FROM ec)"""

SCORES = f"""scores AS (
  SELECT period, entity, total,
         {_near('(total - min(total) OVER w)::DOUBLE / nullif(max(total) OVER w - min(total) OVER w, 0)::DOUBLE * 100.0::DOUBLE', 1)} AS intensity
  FROM ep WINDOW w AS (PARTITION BY period))"""
LEVELS = f"""lev AS (
  SELECT entity, avg_intensity,
         CASE WHEN avg_intensity > 0 AND avg_intensity <= 25 THEN 'LOW'
              WHEN avg_intensity > 25 AND avg_intensity <= 50 THEN 'MEDIUM'
              WHEN avg_intensity > 50 AND avg_intensity <= 75 THEN 'HIGH'
              WHEN avg_intensity > 75 AND avg_intensity <= 100 THEN 'CRITICAL' END AS risk_level
  FROM (SELECT entity, {_near("(sum(round_even(intensity * 10, 0)::BIGINT)::DOUBLE / 10.0::DOUBLE) / count(intensity)", 1)}
               AS avg_intensity FROM scores GROUP BY entity))"""

CARDS = f"""runs AS (
  SELECT *, row_number() OVER (PARTITION BY entity ORDER BY period) AS i,
         row_number() OVER (PARTITION BY entity ORDER BY period DESC) AS j FROM ep),
means AS (
  SELECT entity, sum(total)::BIGINT AS total,
         sum(total) FILTER (WHERE i <= 3)::DOUBLE / 3.0::DOUBLE AS f,
         sum(total) FILTER (WHERE j <= 3)::DOUBLE / 3.0::DOUBLE AS l
  FROM runs GROUP BY entity HAVING count(*) >= 3),
pcts AS (SELECT means.*, ranked.rank AS overall_rank, {_guarded('f', 'l', _near)} AS trend_pct
         FROM means JOIN ranked USING (entity)),
cards AS (
  SELECT entity, overall_rank, total, trend_pct,
         CASE WHEN trend_pct < -20 THEN 'A  (Improving fast)' WHEN trend_pct < -5 THEN 'B  (Improving)'
              WHEN trend_pct < 5 THEN 'C  (Stable)' WHEN trend_pct < 20 THEN 'D  (Worsening)'
              ELSE 'F  (Critical rise)' END AS grade,
         round_even(f, 0) AS first_mean, round_even(l, 0) AS last_mean
  FROM pcts)"""

YOY = f"""yoy AS (
  SELECT entity, category, period, total, prev_total, period_gap, total - prev_total AS change,
         {_nullable('prev_total', 'total')} AS change_pct, prev_total = 0 AND total > 0 AS is_new_from_zero
  FROM (SELECT *, lag(total) OVER w AS prev_total, (period - lag(period) OVER w)::INTEGER AS period_gap
        FROM cells WINDOW w AS (PARTITION BY entity, category ORDER BY period))
  WHERE prev_total IS NOT NULL)"""

COMPARED = f"""cmp AS (
  SELECT *, {_nullable('before_total', 'after_total')} AS change_pct
  FROM (SELECT category, coalesce(sum(total) FILTER (WHERE period = 1999), 0)::BIGINT AS before_total,
               coalesce(sum(total) FILTER (WHERE period = 2000), 0)::BIGINT AS after_total
        FROM p WHERE period IN (1999, 2000) GROUP BY category))"""

GROUPED = """g AS (
  SELECT coalesce(r_name, 'Other') AS "group", period, total
  FROM p LEFT JOIN (SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey
                    WHERE r_regionkey < 4) ON lower(entity) = lower(n_name))"""

# Codes are positions among all values; the first period of a pair is left out.
FEATURE_ROWS = """fe AS (
  SELECT *, coalesce(lag2_raw, lag1) AS lag2
  FROM (SELECT entity, category, period, total,
               (dense_rank() OVER (ORDER BY entity) - 1)::DOUBLE AS entity_code,
               (dense_rank() OVER (ORDER BY category) - 1)::DOUBLE AS category_code,
               (period - min(period) OVER ())::DOUBLE AS period_norm,
               lag(total) OVER w::DOUBLE AS lag1, lag(total, 2) OVER w::DOUBLE AS lag2_raw,
               sum(total) OVER t::DOUBLE / nullif(count(total) OVER t, 0) AS roll_mean
        FROM cells WINDOW w AS (PARTITION BY entity, category ORDER BY period),
          t AS (PARTITION BY entity, category ORDER BY period ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING))
  WHERE lag1 IS NOT NULL)"""
NEXT_ROWS = """nf AS (
  SELECT entity, category, entity_code, category_code,
         (hi - lo + 1)::DOUBLE AS period_norm, (hi + 1)::INTEGER AS period,
         lag1, coalesce(lag2, lag1) AS lag2, roll_mean
  FROM (SELECT entity, category, any_value(entity_code) AS entity_code, any_value(category_code) AS category_code,
               any_value(hi) AS hi, any_value(lo) AS lo,
               max(total) FILTER (WHERE period = hi)::DOUBLE AS lag1,
               max(total) FILTER (WHERE period = hi - 1)::DOUBLE AS lag2,
               sum(total) FILTER (WHERE i <= 3)::DOUBLE / count(*) FILTER (WHERE i <= 3) AS roll_mean
        FROM (SELECT *, max(period) OVER () AS hi, min(period) OVER () AS lo,
                     row_number() OVER (PARTITION BY entity, category ORDER BY period DESC) AS i FROM fe)
        GROUP BY entity, category)
  WHERE lag1 IS NOT NULL)"""


def _scored(prediction: str, source: str) -> str:
    return f"""pred AS (
  SELECT *, predicted - actual AS change, {_guarded('actual', 'predicted')} AS change_pct
  FROM (SELECT entity, category, period, lag1::BIGINT AS actual,
               greatest(0, round_even({prediction}, 0)::BIGINT)::BIGINT AS predicted FROM {source}))"""


NAIVE = f"{SUPPLIER}, {CELLS}, {FEATURE_ROWS}, {NEXT_ROWS}, {_scored('(lag1 * 3 - lag2) / 2', 'nf')}"


def _least_squares(scored: str, actual: str) -> str:
    """Least squares by orthogonalising one feature after the other on the training rows.

    Each feature loses its projections on the earlier ones; the target's
    projection on what is left gives that feature's part of every prediction.
    """
    names = list(forecast.FEATURES)
    qs = ", ".join(f"{n} AS q{i}" for i, n in enumerate(names))
    keep = "fit, y, actual, entity, category, period, prev"
    parts = [
        "train AS (SELECT * FROM fe WHERE period <= (SELECT max(period) FROM fe) - 2)",
        "test AS (SELECT * FROM fe WHERE period > (SELECT max(period) FROM fe) - 2)",
        f"""s0 AS (SELECT true AS fit, total::DOUBLE AS y, total AS actual, entity, category, period, lag1 AS prev, {qs} FROM train
            UNION ALL SELECT false, NULL, {actual}, entity, category, period, lag1, {qs} FROM {scored})""",
        "m AS (SELECT avg(y) AS y, " + ", ".join(f"avg(q{i}) AS q{i}" for i in range(len(names))) + " FROM s0 WHERE fit)",
        "t0 AS (SELECT fit, s0.y - m.y AS y, actual, entity, category, period, prev, "
        + ", ".join(f"s0.q{i} - m.q{i} AS q{i}" for i in range(len(names)))
        + ", m.y AS yhat FROM s0, m)",
    ]
    for i in range(len(names)):
        later = range(i + 1, len(names))
        parts.append(
            f"c{i} AS (SELECT sum(y * q{i}) / sum(q{i} * q{i}) AS b"
            + "".join(f", sum(q{j} * q{i}) / sum(q{i} * q{i}) AS r{j}" for j in later)
            + f" FROM t{i} WHERE fit)"
        )
        parts.append(
            f"t{i + 1} AS (SELECT {keep}, yhat + b * q{i} AS yhat"
            + "".join(f", q{j} - r{j} * q{i} AS q{j}" for j in later)
            + f" FROM t{i}, c{i})"
        )
    parts.append(f"fitted AS (SELECT *, prev AS lag1 FROM t{len(names)} WHERE NOT fit)")
    return ", ".join(parts)


# A nation row of a sheet: supplier, order year, section, nation of the customer.
SHEET = """WITH sheet AS (
  SELECT l_suppkey, year(o_orderdate)::INTEGER AS y, o_orderpriority AS section, cn.n_name AS nation,
         sn.n_regionkey AS kind, sum(l_quantity)::BIGINT AS qty, count(*) AS n,
         'sheets/' || CASE WHEN sn.n_regionkey = 2 THEN 'undated' ELSE (year(o_orderdate) + 20)::VARCHAR END || '/'
         || ['Jeveniles_IPC', 'Crime_Women', 'Cyber', 'Unsorted', 'Missing'][sn.n_regionkey + 1] || '_'
         || translate(CASE WHEN sn.n_regionkey = 2 THEN year(o_orderdate)::VARCHAR ELSE '' END || l_suppkey::VARCHAR,
                      '0123456789', 'abcdefghij') || '.csv' AS path
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
       JOIN nation cn ON c_nationkey = cn.n_nationkey JOIN supplier ON l_suppkey = s_suppkey
       JOIN nation sn ON s_nationkey = sn.n_nationkey
  GROUP BY ALL)"""
SHEET_CATEGORY = (
    "CASE kind WHEN 0 THEN 'Juvenile IPC' WHEN 1 THEN 'Crimes Against Women' "
    "WHEN 2 THEN 'Cyber Crimes' WHEN 4 THEN 'Missing Persons' END"
)
SHEET_PERIOD = "CASE WHEN kind = 2 THEN NULL ELSE y + 20 END::INTEGER"

# A row of the wanted section of a long sheet; ``every`` has a row without entity for a sheet that lacks the section.
BROKEN_LINES = """
  SELECT l_orderkey || '-' || l_linenumber AS entity, year(l_shipdate)::INTEGER AS period, l_quantity::BIGINT AS total,
         'line ' || l_linenumber || CASE WHEN l_quantity % 3 = 0 THEN chr(10) || 'of "order"' || chr(10) || ', ' || l_orderkey ELSE ', plain' END
         || CASE WHEN l_quantity % 7 = 0 THEN chr(10) || chr(10) || '"' ELSE '' END AS category
  FROM lineitem"""
LONG_SHEETS = f"""WITH every AS (
  SELECT 'year=' || (2015 + l_suppkey % 5) || '/key=' || translate(l_suppkey::VARCHAR, '0123456789', 'abcdefghij') AS path,
         CASE WHEN section = '{SECTION}' THEN nation || ', ' || ym END AS entity, (2015 + l_suppkey % 5)::INTEGER AS period,
         'IPC Crimes' AS category, qty AS total
  FROM (SELECT l_suppkey, o_orderpriority AS section, n_name AS nation, strftime(o_orderdate, '%Y-%m') AS ym,
               sum(l_quantity)::BIGINT AS qty
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
             JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL)),
named AS (SELECT * FROM every WHERE entity IS NOT NULL)"""

SHAPES = """WITH sh AS (
  SELECT vec_id::VARCHAR AS name, 'NATION_' || label AS entity,
         unnest(range(0, len(embedding) // 2)) AS seq, embedding FROM embeddings),
v AS (SELECT name, entity, 0 AS ring, seq::INTEGER AS seq, embedding[2 * seq + 1]::DOUBLE AS x,
             embedding[2 * seq + 2]::DOUBLE AS y FROM sh),
bb AS (SELECT min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y FROM v)"""
PROJECTED = f"""{SHAPES},
k AS (SELECT *, least(820.0::DOUBLE / (max_x - min_x), 540.0::DOUBLE / (max_y - min_y)) AS s FROM bb),
pr AS (SELECT name, entity, ring, seq,
              {_exact('20.0::DOUBLE + (x - min_x) * s + (820.0::DOUBLE - (max_x - min_x) * s) / 2.0::DOUBLE', 2)} AS x,
              {_exact('20.0::DOUBLE + (max_y - y) * s + (540.0::DOUBLE - (max_y - min_y) * s) / 2.0::DOUBLE', 2)} AS y
       FROM v, k)"""

_COLOR_CASE = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in presets.GRADE_COLORS.items())
_RISK_CASE = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in presets.RISK_COLORS.items())
_PIVOT = ", ".join(f"coalesce(sum(total) FILTER (WHERE period = {y}), 0)::BIGINT AS \"{y}\"" for y in wh.PERIODS)
_PIVOT_CATEGORIES = ", ".join(
    f"coalesce(sum(total) FILTER (WHERE category = '{c}'), 0)::BIGINT AS \"{c}\"" for c in wh.SEGMENTS + wh.PRIORITIES
)
_METRICS = """count(*)::BIGINT AS rows, round_even(avg(abs(total - prediction)), 2) AS mae,
       round_even(sqrt(avg((total - prediction) * (total - prediction))), 2) AS rmse,
       round_even(1.0 - sum((total - prediction) * (total - prediction)) / (var_pop(total) * count(*)), 4) AS r2"""
_YEARLY_JSON = "'{' || string_agg('\"' || period || '\":' || total, ',' ORDER BY period) || '}'"


def oracle_sql() -> dict[str, str]:
    sql = panel_oracle_sql() | (llm.oracle_sql() if llm else {})
    if llm and corpus_pipeline and corpus_pipeline.ORACLE_SQL:
        sql["pipeline"] = corpus_pipeline.ORACLE_SQL
    return sql


def panel_oracle_sql() -> dict[str, str]:
    return {
        "clean_panel": f"""
            SELECT entity, category, period, CASE WHEN category = 'BUILDING' THEN 0 ELSE total END::BIGINT AS total, source
            FROM ({ORDERS}) WHERE category <> 'FURNITURE' UNION ALL SELECT * FROM ({LINES})""",
        "panel_overview": f"""{MASTER} SELECT count(*)::BIGINT AS rows, count(DISTINCT entity)::BIGINT AS entities,
            count(DISTINCT category)::BIGINT AS categories, count(DISTINCT period)::BIGINT AS periods,
            min(period) AS first_period, max(period) AS last_period, sum(total)::BIGINT AS total FROM p""",
        "distinct_categories": f"{MASTER} SELECT DISTINCT category FROM p ORDER BY 1",
        "category_value_counts": f'{SUPPLIER} SELECT category, count(*)::BIGINT AS "count" FROM p GROUP BY 1',
        "rename_entities": f"""{MASTER} SELECT CASE entity WHEN 'NATION_1' THEN 'NATION_2' WHEN 'NATION_7' THEN 'Seventh'
            ELSE entity END AS entity, sum(total)::BIGINT AS total FROM p GROUP BY 1""",
        "csv_round_trip": ORDERS,
        "first_file": f"SELECT * FROM ({ORDERS}) WHERE period = (SELECT min(year(o_orderdate)) FROM orders)",
        "csv_line_breaks": f"SELECT entity, period, category, total, 'lines' AS source FROM ({BROKEN_LINES})",
        "raw_line_breaks": f"SELECT entity, period::VARCHAR AS period, category, 0::BIGINT AS gaps FROM ({BROKEN_LINES})",
        "inferred_types": """SELECT unnest(['whole', 'gaps', 'logical', 'logical_gaps', 'decimal', 'scientific', 'large', 'mixed', 'nothing', 'text']) AS "column",
            count(*) AS rows,
            unnest([0, count(*) FILTER (WHERE o_orderkey % 5 = 0), 0, count(*) FILTER (WHERE o_orderkey % 9 = 0), 0, 0, 0, 0, count(*), 0]) AS missing,
            unnest(['bigint', CASE WHEN bool_or(o_orderkey % 5 = 0) THEN 'double' ELSE 'bigint' END, 'boolean',
                    CASE WHEN bool_or(o_orderkey % 9 = 0) THEN 'string' ELSE 'boolean' END, 'double', 'double', 'string',
                    CASE WHEN bool_or(o_orderkey % 100 = 0) THEN 'string' ELSE 'bigint' END, 'double', 'string']) AS type FROM orders""",
        "read_inferred": """SELECT o_orderkey, CASE WHEN o_custkey % 4 > 0 THEN o_custkey END::DOUBLE AS o_custkey,
            o_orderstatus = 'F' AS is_f, o_orderpriority FROM orders""",
        "distinct_by_period": f"{MASTER} SELECT period, count(DISTINCT entity) AS entity, count(DISTINCT category) AS category FROM p GROUP BY period",
        "distinct_so_far": f"""{MASTER} SELECT a.period, count(DISTINCT p.entity) AS entity, count(DISTINCT p.category) AS category
            FROM (SELECT DISTINCT period FROM p) a JOIN p ON p.period <= a.period GROUP BY a.period""",
        "faulty_files_audit": f"""{LONG_SHEETS} SELECT path, period, CASE WHEN period <> 2016 AND n > 0 THEN 'OK' ELSE 'FAIL' END AS status,
            CASE WHEN period = 2016 THEN 'cannot be read' WHEN n = 0 THEN 'no rows in sec' END AS reason,
            CASE WHEN period = 2016 THEN 0 ELSE n END::BIGINT AS rows
            FROM (SELECT path, any_value(period) AS period, count(entity) AS n FROM every GROUP BY path)""",
        "stored_features": f"""{SUPPLIER}, {CELLS}, {FEATURE_ROWS} SELECT entity, category, period, total, entity_code,
            category_code, period_norm, lag1, lag2, roll_mean FROM fe""",
        "careless_csv_merged": f"""SELECT '"' || entity || '", ' || category AS entity, category, period, total, source FROM ({ORDERS})
            WHERE category NOT IN ('FURNITURE', 'MACHINERY', 'BUILDING')""",
        "careless_csv_loaded": f"""SELECT '"' || entity || '", ' || category AS entity, nullif(category, 'FURNITURE') AS category, period,
            CASE WHEN category IN ('MACHINERY', 'BUILDING') THEN 0 ELSE total END::BIGINT AS total, source FROM ({ORDERS})""",
        "json_round_trip": ORDERS,
        "optional_input": ORDERS,
        "partitioned_panel": f"""{ONLY_LINES} SELECT entity, period, sum(total)::BIGINT AS total FROM p
            WHERE period >= 1999 GROUP BY 1, 2""",
        "tolerant_scan": f"""SELECT entity, period, category, total FROM ({ORDERS})
            WHERE category NOT IN ('BUILDING', 'FURNITURE')
            UNION ALL SELECT 'Total District(s) ' || category, period, category, sum(total)::BIGINT FROM ({ORDERS})
            GROUP BY category, period""",
        "second_source": f"""SELECT entity, category, period, total, 'second' AS source FROM ({ORDERS})
            WHERE entity IN (SELECT n_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA')""",
        "raw_text_cells": f"""{SUPPLIER} SELECT entity, category || ', "quoted"' AS category, period::VARCHAR AS period,
            total::VARCHAR AS total, 0::BIGINT AS gaps FROM p""",
        "geojson_vertices": f"{SHAPES} SELECT name, ring, seq, x, y FROM v",
        "period_trend": f"""{MASTER}, y AS (SELECT period, sum(total)::BIGINT AS total FROM p GROUP BY 1)
            SELECT period, total, total - lag(total) OVER (ORDER BY period) AS change,
                   {_nullable('lag(total) OVER (ORDER BY period)', 'total', 2)} AS change_pct FROM y""",
        "period_trend_by_source": f"""{MASTER}, y AS (SELECT source, period, sum(total)::BIGINT AS total FROM p GROUP BY 1, 2)
            SELECT source, period, total, total - lag(total) OVER w AS change,
                   {_nullable('lag(total) OVER w', 'total', 2)} AS change_pct
            FROM y WINDOW w AS (PARTITION BY source ORDER BY period)""",
        "overall_change": f"""{MASTER}, y AS (SELECT period, sum(total)::BIGINT AS total FROM p GROUP BY 1),
            o AS (SELECT min(period) AS first_period, max(period) AS last_period,
                  arg_min(total, period) AS first_total, arg_max(total, period) AS last_total FROM y)
            SELECT *, {_exact('(last_total - first_total)::DOUBLE / nullif(first_total, 0)::DOUBLE * 100.0::DOUBLE', 1)} AS change_pct
            FROM o""",
        "category_trend": f"""{MASTER}, {CP}, c AS (
              SELECT category, coalesce(sum(total) FILTER (WHERE period = (SELECT min(period) FROM cp)), 0)::BIGINT AS first_total,
                     coalesce(sum(total) FILTER (WHERE period = (SELECT max(period) FROM cp)), 0)::BIGINT AS last_total
              FROM cp GROUP BY 1),
            k AS (SELECT category, period AS peak_period, total AS peak_total FROM cp
                  QUALIFY row_number() OVER (PARTITION BY category ORDER BY total DESC, period) = 1),
            x AS (SELECT *, {_guarded('first_total', 'last_total')} AS change_pct FROM c JOIN k USING (category))
            SELECT category, {_class('change_pct', 10)} AS direction, first_total, last_total, change_pct,
                   peak_period, peak_total FROM x""",
        "period_category_matrix": f"{MASTER} SELECT period, {_PIVOT_CATEGORIES} FROM p GROUP BY period",
        "entity_period_matrix": f"{SUPPLIER} SELECT entity, {_PIVOT} FROM p GROUP BY entity",
        "entity_trend": f"{SUPPLIER}, {EP}, {TREND} SELECT *, {_class('change_pct', 15)} AS trend FROM tr",
        "entity_trend_wide": f"""{ONLY_LINES}, {EP}, {TREND}
            SELECT entity, change_pct, rises, falls, {_class('change_pct', 15)} AS trend, """
        + ", ".join(
            f'CASE WHEN last_period = {y} THEN last_total WHEN first_period = {y} THEN first_total END AS "{y}_total"'
            for y in wh.PERIODS
        )
        + " FROM tr",
        "category_middle": f"""{MASTER}, {CP} SELECT category, period AS middle_period, total AS middle_total FROM cp
            QUALIFY row_number() OVER (PARTITION BY category ORDER BY period) - 1
                    = count(*) OVER (PARTITION BY category) // 2""",
        "entity_ranking": f"{MASTER}, {RANKED} SELECT * FROM ranked",
        "supplier_ranking": f"{SUPPLIER}, {RANKED} SELECT * FROM ranked",
        "ranking_bars": f"""{MASTER}, {RANKED} SELECT *,
            repeat('█', floor(total::DOUBLE / (SELECT max(total) FROM ranked)::DOUBLE * 25)::INTEGER) AS bar FROM ranked""",
        "signature_top5": f"""{MASTER}, {EC}, {SIGNATURE}
            SELECT entity, rank, category, total, {_share('total', 'whole')} AS share_pct FROM sig WHERE rank <= 5""",
        "supplier_signature": f"""{SUPPLIER}, {EC}, {SIGNATURE}
            SELECT entity, rank, category, total, {_share('total', 'whole')} AS share_pct FROM sig WHERE rank <= 3""",
        "signature_summary": f"""{MASTER}, {EC}, {SIGNATURE}
            SELECT entity, string_agg(category || ' (' || format('{{:,}}', total) || ')', ' | ' ORDER BY rank) AS summary
            FROM sig WHERE rank <= 5 GROUP BY entity""",
        "concentration": f"""{SUPPLIER}, {EC}, r AS (
              SELECT *, row_number() OVER (PARTITION BY category ORDER BY total DESC, entity) AS i,
                     sum(total) OVER (PARTITION BY category) AS whole FROM ec),
            c AS (SELECT category, any_value(whole) AS whole, sum(total) FILTER (WHERE i <= 5) AS t5,
                         sum(total) FILTER (WHERE i <= 10) AS t10, max(entity) FILTER (WHERE i = 1) AS worst_entity,
                         max(total) FILTER (WHERE i = 1) AS t1 FROM r GROUP BY category)
            SELECT category, {_share('t5', 'whole', _near)} AS top5_pct, {_share('t10', 'whole', _near)} AS top10_pct,
                   worst_entity, {_share('t1', 'whole', _near)} AS worst_entity_pct FROM c WHERE whole <> 0""",
        "worst_entity": f"""{MASTER}, {EC} SELECT category, entity, total FROM ec
            QUALIFY row_number() OVER (PARTITION BY category ORDER BY total DESC, entity) = 1""",
        "peak_best_period": f"""{SUPPLIER}, {EP},
            a AS (SELECT entity, period AS peak_period, total AS peak_total FROM ep
                  QUALIFY row_number() OVER (PARTITION BY entity ORDER BY total DESC, period) = 1),
            b AS (SELECT entity, period AS best_period, total AS best_total FROM ep
                  QUALIFY row_number() OVER (PARTITION BY entity ORDER BY total, period) = 1)
            SELECT *, CASE WHEN best_total > 0 THEN
                {_exact('peak_total::DOUBLE / nullif(best_total, 0)::DOUBLE', 2)} ELSE 0.0 END AS peak_best_ratio
            FROM a JOIN b USING (entity)""",
        "intensity_by_period": f"{SUPPLIER}, {EP}, {SCORES} SELECT * FROM scores",
        "risk_level": f"{SUPPLIER}, {EP}, {SCORES}, {LEVELS} SELECT * FROM lev",
        "risk_distribution": f"""{SUPPLIER}, {EP}, {SCORES}, {LEVELS}
            SELECT l.risk_level, count(entity)::BIGINT AS entities
            FROM (VALUES ('LOW'), ('MEDIUM'), ('HIGH'), ('CRITICAL')) l(risk_level) LEFT JOIN lev USING (risk_level) GROUP BY 1""",
        "top_intensity": f"""{SUPPLIER}, {EP}, {SCORES}, {LEVELS}
            SELECT *, CASE risk_level {_RISK_CASE} END AS color FROM lev
            ORDER BY avg_intensity DESC NULLS LAST, entity LIMIT 40""",
        "report_card": f"{SUPPLIER}, {EP}, {RANKED}, {CARDS} SELECT * FROM cards",
        "grade_distribution": f"""{SUPPLIER}, {EP}, {RANKED}, {CARDS}
            SELECT l AS grade_letter, count(entity)::BIGINT AS entities
            FROM (VALUES ('A'), ('B'), ('C'), ('D'), ('F')) v(l) LEFT JOIN cards ON grade[1] = l GROUP BY 1""",
        "grade_filter": f"""{SUPPLIER}, {EP}, {RANKED}, {CARDS}
            SELECT *, grade[1] AS grade_letter, regexp_extract(grade, '\\((.*)\\)', 1) AS grade_text,
                   CASE grade[1] {_COLOR_CASE} END AS color FROM cards WHERE grade[1] IN ('A', 'B', 'F')""",
        "yoy_changes": f"{SUPPLIER}, {CELLS}, {YOY} SELECT * FROM yoy",
        "yoy_gap_bridged": f"{GAPPED_LINES}, {CELLS}, {YOY} SELECT * FROM yoy",
        "top_spikes": f"""{SUPPLIER}, {CELLS}, {YOY} SELECT * FROM yoy
            ORDER BY is_new_from_zero DESC, change_pct DESC NULLS LAST, entity, category, period LIMIT 10""",
        "top_drops": f"""{SUPPLIER}, {CELLS}, {YOY} SELECT * FROM yoy
            ORDER BY change_pct ASC NULLS LAST, is_new_from_zero DESC, entity, category, period LIMIT 10""",
        "two_period_compare": f"{MASTER}, {COMPARED} SELECT * FROM cmp",
        "compare_dropped": f"{MASTER}, {COMPARED} SELECT * FROM cmp WHERE change_pct < 0",
        "compare_rose": f"{MASTER}, {COMPARED} SELECT * FROM cmp WHERE change_pct > 0",
        "regime_mean": f"""{MASTER} SELECT CASE WHEN period <= 1997 THEN 'before' ELSE 'after' END AS regime,
            count(*)::BIGINT AS rows, sum(total)::DOUBLE / count(*) AS mean_total FROM p GROUP BY 1""",
        "regime_mean_by_source": f"""{MASTER} SELECT source, CASE WHEN period <= 1997 THEN 'before' ELSE 'after' END AS regime,
            count(*)::BIGINT AS rows, sum(total)::DOUBLE / count(*) AS mean_total FROM p GROUP BY 1, 2""",
        "division_by_period": f"""{MASTER}, {GROUPED}
            SELECT "group", period, sum(total)::BIGINT AS total FROM g GROUP BY 1, 2""",
        "division_totals": f'{MASTER}, {GROUPED} SELECT "group", sum(total)::BIGINT AS total FROM g GROUP BY 1',
        "file_rules": f"""{SHEET} SELECT DISTINCT path, split_part(path, '/', -1) AS file_name, {SHEET_PERIOD} AS period,
            CASE kind WHEN 0 THEN 'ipcjuvenile' WHEN 1 THEN 'women' WHEN 2 THEN 'cyber' WHEN 4 THEN 'missing' END AS file_type,
            {SHEET_CATEGORY} AS category,
            CASE kind WHEN 3 THEN NULL WHEN 4 THEN 20 ELSE -1 END::INTEGER AS value_col FROM sheet""",
        "sheet_extract": f"""{SHEET} SELECT path, nation AS entity, {SHEET_PERIOD} AS period, {SHEET_CATEGORY} AS category,
            qty AS total, 'sheets' AS source FROM sheet WHERE section = '{SECTION}' AND n > 1 AND kind NOT IN (2, 3)""",
        "load_audit": f"""{SHEET}, f AS (
              SELECT path, any_value({SHEET_PERIOD}) AS period, any_value({SHEET_CATEGORY}) AS category, any_value(kind) AS kind,
                     count(*) FILTER (WHERE section = '{SECTION}' AND n > 1 AND kind NOT IN (2, 3))::BIGINT AS rows
              FROM sheet GROUP BY path)
            SELECT path, period, category,
                   CASE WHEN kind IN (2, 3) THEN 'SKIP' WHEN rows > 0 THEN 'OK' ELSE 'FAIL' END AS status,
                   CASE WHEN kind = 2 THEN 'no year in name' WHEN kind = 3 THEN 'unknown type'
                        WHEN rows = 0 THEN 'no rows in section' END AS reason, rows, 0::BIGINT AS rows_cut FROM f""",
        "sheet_files_panel": f"""{LONG_SHEETS} SELECT path, entity, period, category, total, 'sheets' AS source FROM named""",
        "sheet_files_audit": f"""{LONG_SHEETS} SELECT path, period, category,
            CASE WHEN cut > 0 THEN 'CUT' WHEN rows > 0 THEN 'OK' ELSE 'FAIL' END AS status,
            CASE WHEN cut > 0 THEN cut || ' rows of the section left out' WHEN rows = 0 THEN 'no rows in section' END AS reason,
            rows, cut AS rows_cut
            FROM (SELECT path, any_value(period) AS period, any_value(category) AS category, least(count(entity), 150)::BIGINT AS rows,
                         greatest(count(entity) - 150, 0)::BIGINT AS cut FROM every GROUP BY path)""",
        "kpi_row": f"""{MASTER} SELECT sum(total)::BIGINT AS total,
            (SELECT entity FROM p GROUP BY entity ORDER BY sum(total) DESC, entity LIMIT 1) AS worst_entity,
            (SELECT sum(total) FROM p GROUP BY entity ORDER BY sum(total) DESC LIMIT 1)::BIGINT AS worst_entity_total,
            (SELECT category FROM p GROUP BY category ORDER BY sum(total) DESC, category LIMIT 1) AS top_category,
            max(period) AS latest_period,
            (SELECT sum(total) FROM p WHERE period = (SELECT max(period) FROM p))::BIGINT AS latest_total FROM p""",
        "latest_top10": f"""{MASTER} SELECT category, sum(total)::BIGINT AS total FROM p
            WHERE period = (SELECT max(period) FROM p) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""",
        "category_heatmap": f"{MASTER} SELECT category, {_PIVOT} FROM p GROUP BY category",
        "entity_heatmap": f"{MASTER} SELECT category, {_PIVOT} FROM p WHERE entity = 'NATION_3' GROUP BY category",
        "category_series": f"""{SUPPLIER} SELECT period, sum(total)::BIGINT AS total FROM p
            WHERE category = '2-HIGH' GROUP BY 1""",
        "category_top_entities": f"""{SUPPLIER} SELECT entity, sum(total)::BIGINT AS total FROM p
            WHERE category = '2-HIGH' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15""",
        "top10_semi_series": f"""{SUPPLIER} SELECT period, entity, sum(total)::BIGINT AS total FROM p
            WHERE category = '2-HIGH' AND entity IN (SELECT entity FROM p WHERE category = '2-HIGH'
              GROUP BY 1 ORDER BY sum(total) DESC, entity LIMIT 10) GROUP BY 1, 2""",
        "compare_entities": f"""{MASTER} SELECT period, entity, sum(total)::BIGINT AS total FROM p
            WHERE category = '5-LOW' AND entity IN ('NATION_3', 'NATION_8', 'NATION_21') GROUP BY 1, 2""",
        "category_share": f"""{MASTER} SELECT category, sum(total)::BIGINT AS total FROM p
            GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8""",
        "lowest10": f"{SUPPLIER} SELECT entity, sum(total)::BIGINT AS total FROM p GROUP BY 1 ORDER BY 2, 1 LIMIT 10",
        "entity_profile_json": f"""{SUPPLIER}, {EP}, {EC}, {CELLS}, {YOY}, {RANKED}, {CARDS}, {SIGNATURE},
            yj AS (SELECT entity, string_agg('{{"period":' || period || ',"category":"' || category || '","change_pct":'
              || coalesce(change_pct::VARCHAR, 'null') || '}}', ',' ORDER BY period, category) AS yoy FROM yoy GROUP BY entity),
            y AS (SELECT entity, sum(total)::BIGINT AS total, {_YEARLY_JSON} AS yearly FROM ep GROUP BY entity),
            t AS (SELECT entity, string_agg('{{"category":"' || category || '","total":' || total || '}}', ',' ORDER BY rank)
                         FILTER (WHERE rank <= 10) AS tops,
                         string_agg('{{"category":"' || category || '","total":' || total || '}}', ',' ORDER BY rank)
                         FILTER (WHERE rank <= 5) AS five FROM sig GROUP BY entity)
            SELECT entity, '{{"total":' || y.total || ',"yearly":' || yearly || ',"top_categories":[' || tops || '],"card":'
              || coalesce('{{"overall_rank":' || overall_rank || ',"trend_pct":' || trend_pct || ',"grade":"' || grade
              || '","first_mean":' || first_mean || ',"last_mean":' || last_mean || '}}', 'null')
              || ',"yoy":[' || coalesce(yoy, '') || '],"signature":[' || five || ']}}' AS payload
            FROM y JOIN t USING (entity) LEFT JOIN cards USING (entity) LEFT JOIN yj USING (entity)""",
        "period_maps_json": f"""{SUPPLIER}, {EP} SELECT entity,
            '{{"total":' || sum(total)::BIGINT || ',"yearly":' || {_YEARLY_JSON} || '}}' AS payload FROM ep GROUP BY entity""",
        "choropleth": f"""{MASTER}, t AS (SELECT entity, sum(total)::BIGINT AS total FROM p WHERE category = '5-LOW' GROUP BY 1),
            s AS (SELECT vec_id::VARCHAR AS name, 'NATION_' || label AS entity FROM embeddings)
            SELECT name, s.entity, coalesce(total, 0)::BIGINT AS total, total IS NOT NULL AS matched
            FROM s LEFT JOIN t USING (entity)""",
        "lag_features": f"""{SUPPLIER}, {CELLS}, {FEATURE_ROWS} SELECT entity, category, period, total, entity_code,
            category_code, period_norm, lag1, lag2, roll_mean FROM fe""",
        "temporal_split": f"""{SUPPLIER}, {CELLS}, {FEATURE_ROWS}
            SELECT CASE WHEN period < (SELECT max(period) FROM fe) - 1 THEN 'train' ELSE 'test' END AS part, period,
                   count(*)::BIGINT AS n, sum(total)::BIGINT AS total, sum(lag1)::BIGINT AS lag1_sum FROM fe GROUP BY 1, 2""",
        "forecast_features": f"""{SUPPLIER}, {CELLS}, {FEATURE_ROWS}, {NEXT_ROWS} SELECT * FROM nf""",
        "naive_metrics": f"""{SUPPLIER}, {CELLS}, {FEATURE_ROWS}
            SELECT {_METRICS} FROM (SELECT total, lag1 AS prediction FROM fe)""",
        "naive_forecast": f"{NAIVE} SELECT * FROM pred",
        "forecast_by_entity": f"""{NAIVE} SELECT entity, sum(predicted)::BIGINT AS predicted FROM pred
            GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20""",
        "forecast_compare": f"""{NAIVE} SELECT entity, sum(actual)::BIGINT AS actual, sum(predicted)::BIGINT AS predicted
            FROM pred GROUP BY 1 ORDER BY 3 DESC, 1 LIMIT 15""",
        "forecast_by_category": f"""{NAIVE} SELECT category, sum(actual)::BIGINT AS actual, sum(predicted)::BIGINT AS predicted,
            {_near('sum(round_even(change_pct * 10, 0)::BIGINT)::DOUBLE / 10.0::DOUBLE / count(change_pct)', 1)} AS avg_change
            FROM pred GROUP BY 1""",
        "ols_forecast": f"""{SUPPLIER}, {CELLS}, {FEATURE_ROWS}, {NEXT_ROWS}, {_least_squares('nf', 'NULL')},
            {_scored('yhat', 'fitted')} SELECT * FROM pred""",
        "ols_metrics": f"""{SUPPLIER}, {CELLS}, {FEATURE_ROWS}, {NEXT_ROWS}, {_least_squares('test', 'total')}
            SELECT 'linear_regression' AS model, {_METRICS}
            FROM (SELECT actual AS total, greatest(yhat, 0) AS prediction FROM fitted)""",
        "model_checks": f"""{SUPPLIER}, {CELLS}, {FEATURE_ROWS}
            SELECT model, (SELECT count(*) FROM fe WHERE period > (SELECT max(period) FROM fe) - 2)::BIGINT AS rows,
                   true AS mae_in_rmse, true AS within_training, true AS best_is_chosen,
                   CASE model WHEN 'linear_regression' THEN 0 ELSE 6 END::BIGINT AS features,
                   CASE model WHEN 'linear_regression' THEN 0 ELSE 1 END::DOUBLE AS importance
            FROM (VALUES ('gradient_boosting'), ('random_forest'), ('linear_regression')) m(model)""",
        "linear_card": f"""{SUPPLIER}, {CELLS}, {FEATURE_ROWS}, {NEXT_ROWS}, {_least_squares('test', 'total')}
            SELECT 'linear_regression' AS best_model, x.mae, x.rmse, x.r2, f.*,
                   (SELECT count(*) FROM train)::BIGINT AS train_rows, (SELECT count(*) FROM test)::BIGINT AS test_rows
            FROM (SELECT {_METRICS} FROM (SELECT actual AS total, greatest(yhat, 0) AS prediction FROM fitted)) x,
                 (SELECT count(DISTINCT entity)::BIGINT AS entities, string_agg(DISTINCT category, '|' ORDER BY category) AS categories,
                         string_agg(DISTINCT period::VARCHAR, '|' ORDER BY period::VARCHAR) AS periods,
                         (max(period) + 1)::INTEGER AS prediction_period FROM fe) f""",
        "published_forecast": f"{NAIVE} SELECT * FROM pred",
        "published_names": f"""{MASTER}, {CP}, {COMPARED}, c AS (
              SELECT category, coalesce(sum(total) FILTER (WHERE period = 1995), 0)::BIGINT AS a,
                     coalesce(sum(total) FILTER (WHERE period = 2001), 0)::BIGINT AS b FROM cp GROUP BY 1)
            SELECT category AS "Crime_Type", a AS "1995_count", b AS "2001_count", before_total AS "Pre_COVID_1999",
                   after_total AS "During_COVID_2000" FROM c JOIN cmp USING (category)""",
        "trend_arrows": f"""{SUPPLIER}, {CELLS}, {YOY} SELECT entity, category, period,
            CASE WHEN change > 0 THEN '▲' WHEN change < 0 THEN '▼' ELSE '→' END AS arrow, abs(change)::BIGINT AS size FROM yoy""",
        "geojson_paths": f"""WITH e AS (
              SELECT vec_id, vec_id // 2 % 4 AS k, unnest(range(0, 32)) AS seq, embedding FROM embeddings),
            v AS (SELECT vec_id::VARCHAR AS name, seq, embedding[2 * seq + 1]::DOUBLE AS x, embedding[2 * seq + 2]::DOUBLE AS y,
                         seq < 16 OR (k = 1 AND seq >= 24) AS is_outer, k = 0 OR seq < 16 OR seq >= 24 AS is_drawn,
                         CASE WHEN seq < 16 THEN 0 WHEN k = 0 OR seq < 24 THEN 1 ELSE 2 END AS ring
                  FROM e WHERE k < 2),
            bb AS (SELECT min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y FROM v WHERE is_outer),
            s AS (SELECT *, least(820.0::DOUBLE / (max_x - min_x), 540.0::DOUBLE / (max_y - min_y)) AS s FROM bb),
            pr AS (SELECT name, seq, ring, is_outer, is_drawn,
              {_exact('20.0::DOUBLE + (x - min_x) * s + (820.0::DOUBLE - (max_x - min_x) * s) / 2.0::DOUBLE', 2)} AS x,
              {_exact('20.0::DOUBLE + (max_y - y) * s + (540.0::DOUBLE - (max_y - min_y) * s) / 2.0::DOUBLE', 2)} AS y FROM v, s),
            rings AS (SELECT name, ring, 'M' || string_agg(x::VARCHAR || ',' || y::VARCHAR, ' L' ORDER BY seq) || 'Z' AS path
                      FROM pr WHERE is_drawn GROUP BY ALL),
            mid AS (SELECT name, round(avg(x), 8) AS center_x, round(avg(y), 8) AS center_y FROM pr WHERE is_outer GROUP BY name)
            SELECT name, string_agg(path, ' ' ORDER BY ring) AS path, any_value(center_x) AS center_x, any_value(center_y) AS center_y
            FROM rings JOIN mid USING (name) GROUP BY name""",
        "vertices": f"{SHAPES} SELECT name, ring, seq, x, y FROM v",
        "vertex_bbox": f"{SHAPES} SELECT * FROM bb",
        "project_vertices": f"{PROJECTED} SELECT name, ring, seq, x, y FROM pr",
        "feature_centroid": f"""{PROJECTED} SELECT name, round(avg(x), 8) AS center_x, round(avg(y), 8) AS center_y
            FROM pr GROUP BY name""",
        "feature_path": f"""{PROJECTED} SELECT name,
            'M' || string_agg(x::VARCHAR || ',' || y::VARCHAR, ' L' ORDER BY seq) || 'Z' AS path,
            CASE WHEN length(entity) > 7 THEN entity[1:5] || '..' ELSE entity END AS label FROM pr GROUP BY name, entity""",
        "assign_colors": f"""SELECT vec_id::VARCHAR AS name,
            {list(presets.MAP_PALETTE)!r}[(row_number() OVER (ORDER BY vec_id::VARCHAR) - 1) % 9 + 1] AS color FROM embeddings""",
    }
