"""The three end-to-end runs: build the panel, analyse it, forecast it."""

from collections.abc import Mapping, Sequence
from functools import partial

from pyspark.sql import DataFrame

from panelspark import presets
from panelspark.operators import changes, forecast, groups, intensity, marts, rankings, report_cards, sheets, trends
from panelspark.operators.ordered import sort_nulls_last
from panelspark.operators.panel import clean_panel, cube
from panelspark.plans.concurrent import run_together
from panelspark.plans.lineage import RunFolder, materialise
from panelspark.sources.sinks import write_csv, write_json_rows


def build_panel(raw_cells: DataFrame, section: str, *others: DataFrame, **sheet_options) -> DataFrame:
    """Panel of one section of the sheets merged with other sources."""
    rows = sheets.extract_sections(raw_cells, section, **sheet_options).drop("path")
    return clean_panel(sheets.drop_aggregate_names(rows), *others)


def panel_cells(panel: DataFrame, folder: RunFolder | None = None) -> DataFrame:
    """The panel at its grain, materialised once: all analyses below read this small table."""
    return materialise(cube(panel, ["entity", "category", "period"]), folder)


def analyses(
    panel: DataFrame,
    lookup: DataFrame,
    compare: tuple[int, int],
    cutoff: int,
    regime_labels: Sequence[str] = ("before", "after"),
    cells: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """All descriptive analyses by name, lazily. Only the regime mean reads panel rows.

    ``cells`` is the materialised grain (:func:`panel_cells`); without it the
    panel itself is read by every analysis.
    """
    grain = panel if cells is None else cells
    scores = intensity.intensity_scores(grain)
    yoy = changes.yoy_changes(grain, cells=cells is not None)
    cards = report_cards.report_cards(grain)
    return {
        "period_trend": trends.period_trend(grain),
        "overall_change": trends.overall_change(grain),
        "category_trend": trends.category_trend(grain),
        "period_category_matrix": trends.period_category_matrix(grain),
        "entity_ranking": rankings.entity_ranking(grain),
        "entity_period_matrix": trends.entity_period_matrix(grain),
        "entity_trend": trends.entity_trend(grain),
        "signature_categories": rankings.signature_categories(grain),
        "intensity_scores": scores,
        "risk_levels": intensity.risk_levels(scores),
        "yoy_changes": yoy,
        "top_spikes": changes.top_spikes(yoy),
        "top_drops": changes.top_drops(yoy),
        "report_cards": cards,
        "grade_distribution": report_cards.grade_distribution(cards),
        "concentration": rankings.concentration(grain),
        "compare_periods": changes.compare_periods(grain, *compare),
        "group_rollup": groups.group_rollup(grain, lookup),
        "group_totals": groups.group_totals(grain, lookup),
        "peak_best": rankings.peak_best(grain),
        "regime_means": changes.regime_means(panel, cutoff, regime_labels),
        "worst_entity": rankings.worst_entity(grain),
        "kpis": marts.kpis(grain),
    }


# Order of the rows in each written table.
OUTPUT_ORDER: Mapping[str, Sequence[str]] = {
    "period_trend": ("period",),
    "category_trend": ("-change_pct", "category"),
    "period_category_matrix": ("period",),
    "entity_ranking": ("rank",),
    "entity_period_matrix": ("entity",),
    "entity_trend": ("-change_pct", "entity"),
    "signature_categories": ("entity", "rank"),
    "intensity_scores": ("period", "entity"),
    "risk_levels": ("-avg_intensity", "entity"),
    "yoy_changes": ("entity", "category", "period"),
    "report_cards": ("overall_rank",),
    "grade_distribution": ("grade_letter",),
    "concentration": ("category",),
    "compare_periods": ("change_pct", "category"),
    "group_rollup": ("group", "period"),
    "group_totals": ("-total", "group"),
    "peak_best": ("-peak_best_ratio", "entity"),
    "worst_entity": ("category",),
}


def panel_periods(cells: DataFrame) -> list[int]:
    """The periods of a panel, an axis of its published tables."""
    return [r["period"] for r in cells.select("period").distinct().orderBy("period").collect()]


def published(name: str, df: DataFrame, **periods: int) -> DataFrame:
    """A result under its published column names; columns that have none keep theirs.

    Names that carry a period need it as ``first``, ``last``, ``before``, ``after``, ``latest`` or ``next``.
    """
    return marts.label_columns(df, presets.OUTPUT_COLUMNS.get(name, {}), **periods)


# Tables that are written at a time: each is a job of few tasks.
AT_ONCE = 4


def write_tables(tables: Mapping[str, DataFrame], root: str, at_once: int = AT_ONCE) -> None:
    """Tables as CSV folders under ``root``, ``at_once`` at a time; if one fails the others are cancelled."""
    jobs = {name: partial(write_csv, df, f"{root.rstrip('/')}/{name}") for name, df in tables.items()}
    for df in list(tables.values())[:1]:
        run_together(df.sparkSession, jobs, at_once)


def write_analyses(results: Mapping[str, DataFrame], root: str, rename: bool = True, at_once: int = AT_ONCE, **periods: int) -> None:
    """Every analysis as a CSV folder under ``root``, sorted for reading; several are written at once."""
    tables = {}
    for name, df in results.items():
        keys = OUTPUT_ORDER.get(name)
        ordered = sort_nulls_last(df, *keys) if keys else df
        tables[name] = published(name, ordered, **periods) if rename else ordered
    write_tables(tables, root, at_once)


def dashboard(cells: DataFrame, periods: Sequence[int]) -> dict[str, DataFrame]:
    """The tables behind dashboard pages, by name, lazily."""
    levels = intensity.risk_levels(intensity.intensity_scores(cells))
    return {
        "kpis": marts.kpis(cells),
        "latest_top": marts.latest_top(cells),
        "heatmap": marts.heatmap(cells, periods),
        "category_share": marts.category_share(cells),
        "lowest_entities": marts.lowest_entities(cells),
        "top_intensity": marts.top_intensity(levels),
        "risk_distribution": intensity.risk_distribution(levels),
        "ranking_bars": rankings.ranking_bars(rankings.entity_ranking(cells)),
    }


def write_dashboard(cells: DataFrame, root: str) -> None:
    """Dashboard tables as CSV, the profiles and period maps of the entities as JSON rows."""
    root = root.rstrip("/")
    write_tables(dashboard(cells, panel_periods(cells)), root)
    write_json_rows(marts.entity_profile(cells), f"{root}/entity_profiles")
    write_json_rows(marts.period_maps(cells), f"{root}/period_maps")


def run_forecast(
    panel: DataFrame,
    params: Mapping[str, Mapping] | None = None,
    cells: DataFrame | None = None,
    folder: RunFolder | None = None,
) -> dict[str, DataFrame]:
    """Features, fit, comparison, choice, forecast, roll-ups and model record.

    Cells, features and metrics are materialised, in the run's folder if one is given: the codes and the
    fits read them many times. Models and their metrics (one row each) are all the driver sees.
    """
    grain = panel_cells(panel, folder) if cells is None else cells
    features = materialise(forecast.lag_features(grain, cells=True), folder)
    train, test = forecast.temporal_split(features)
    models = forecast.fit_models(train, params)
    metrics = materialise(forecast.evaluate(models, test), folder)
    name, model = forecast.select_best(models, metrics)
    predicted = forecast.forecast(model, forecast.next_period_features(features))
    return {
        "metrics": metrics.drop("rmse_exact"),
        "importance": forecast.feature_importance(model, features),
        "predictions": predicted,
        "by_entity": marts.forecast_by_entity(predicted),
        "compare": marts.forecast_compare(predicted),
        "by_category": marts.forecast_by_category(predicted),
        "model_card": forecast.model_card(name, metrics, features, train, test),
    }


def write_forecast(results: Mapping[str, DataFrame], root: str) -> None:
    """All results of a forecast: tables as CSV, the model record as JSON."""
    root = root.rstrip("/")
    predictions = results["predictions"]
    period = predictions.agg({"period": "max"}).first()[0]
    periods = {} if period is None else {"latest": period - 1, "next": period}
    named = published("predictions", predictions.orderBy("entity", "category"), **periods)
    write_tables({"predictions": named} | {n: results[n] for n in ("metrics", "importance", "by_entity", "compare", "by_category")}, root)
    write_json_rows(results["model_card"], f"{root}/model_card")


def default_lookup(spark) -> DataFrame:
    return groups.lookup_from_dict(spark, presets.DIVISIONS)
