"""Command line job: sheets and a second source to a panel, its analyses and its forecast.

    spark-submit panelspark/plans/job.py --sheets DIR --section NAME --second FILE --out DIR
"""

import argparse
from collections.abc import Sequence

from pyspark.sql import SparkSession

from panelspark import presets
from panelspark.operators import sheets
from panelspark.operators.panel import clean_panel
from panelspark.plans import pipeline
from panelspark.plans.lineage import RunFolder, materialise
from panelspark.sources.files import file_faults, list_files
from panelspark.sources.raw_cells import read_raw_cells
from panelspark.sources.readers import read_source
from panelspark.sources.sinks import write_csv, write_panel


def parse(argv: Sequence[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--sheets", required=True, help="folder of delimited sheets, any depth")
    p.add_argument("--section", required=True, help="section to extract, and value of the second source's column")
    p.add_argument("--second", help="CSV of the second source")
    p.add_argument("--out", required=True)
    p.add_argument("--trees", type=int, default=200, help="trees of both tree models")
    return p.parse_args(argv)


def run(spark: SparkSession, args: argparse.Namespace) -> None:
    """The whole run; what it materialised on the way is removed at the end."""
    with RunFolder(spark) as folder:
        _run(spark, args, folder)


def _run(spark: SparkSession, args: argparse.Namespace, folder: RunFolder) -> None:
    out = args.out.rstrip("/")
    faults = materialise(file_faults(spark, args.sheets), folder)
    rows = materialise(sheets.extract_sections(read_raw_cells(spark, args.sheets, faults=faults), args.section), folder)
    audit = sheets.load_audit(list_files(spark, args.sheets), rows, faults=faults)
    write_csv(audit, f"{out}/audit", ["path"])

    sources = [sheets.drop_aggregate_names(rows.drop("path"))]
    if args.second:
        where = {presets.SECOND_SOURCE_SECTION_COLUMN: args.section}
        sources.append(read_source(spark, args.second, presets.SECOND_SOURCE_COLUMNS, "second", where))
    write_panel(clean_panel(*sources), f"{out}/panel")
    panel = spark.read.parquet(f"{out}/panel")

    cells = pipeline.panel_cells(panel, folder)
    lookup = pipeline.default_lookup(spark)
    before, after = presets.COMPARED_PERIODS
    results = pipeline.analyses(panel, lookup, (before, after), presets.REGIME_CUTOFF, cells=cells)
    periods = pipeline.panel_periods(cells)
    ends = {"first": periods[0], "last": periods[-1]} if periods else {"first": 0, "last": 0}
    pipeline.write_analyses(results, f"{out}/analysis", before=before, after=after, **ends)
    pipeline.write_dashboard(cells, f"{out}/dashboard")

    params = {
        "gradient_boosting": {"maxIter": args.trees},
        "random_forest": {"numTrees": args.trees},
        "linear_regression": {},
    }
    pipeline.write_forecast(pipeline.run_forecast(panel, params, cells=cells, folder=folder), f"{out}/model")


if __name__ == "__main__":
    run(SparkSession.builder.appName("panelspark").getOrCreate(), parse())
