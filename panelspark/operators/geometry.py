"""Shapes: outer rings, bounding box, projection to a canvas, paths, centroids.

A feature is one row with its rings nested, as it comes out of its file, so all
steps but the bounding box are row-local: no explode, no shuffle, no gathering
of a shape's points. ``rings`` is array<array<struct<x,y>>>.
"""

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark import presets
from panelspark.functions.labels import first_filled, map_value
from panelspark.functions.numeric import round_exact
from panelspark.operators.ordered import ordered_index


def _points(rings: Column) -> Column:
    """array<array<array<double>>> -> array<array<struct<x,y>>>."""
    return F.transform(rings, lambda r: F.transform(r, lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))))


_NO_RINGS = "array<array<struct<x:double,y:double>>>"


def outer_rings(kind: Column, coordinates: Column) -> Column:
    """Outer ring of a Polygon, or of every part of a MultiPolygon; none for other types."""
    return _rings(kind, coordinates, lambda polygon: F.slice(polygon, 1, 1))


def path_rings(kind: Column, coordinates: Column) -> Column:
    """All rings of a Polygon, holes included; the outer ring of every part of a MultiPolygon."""
    return _rings(kind, coordinates, lambda polygon: polygon)


def _rings(kind: Column, coordinates: Column, of_polygon) -> Column:
    polygon = F.from_json(coordinates, "array<array<array<double>>>")
    multi = F.from_json(coordinates, "array<array<array<array<double>>>>")
    outer = F.transform(F.filter(multi, lambda p: F.size(p) > 0), lambda p: p[0])
    return (
        F.when(kind == "Polygon", _points(of_polygon(polygon)))
        .when(kind == "MultiPolygon", _points(outer))
        .otherwise(F.array().cast(_NO_RINGS))
    )


def shapes(
    features: DataFrame,
    aliases: Mapping[str, str] = presets.SHAPE_ALIASES,
    name_keys: Sequence[str] = presets.SHAPE_NAME_KEYS,
) -> DataFrame:
    """(name, entity, rings, path_rings) of GeoJSON features; shapes without points are left out.

    ``rings`` are the outer ones, for bounds, vertices and centroids; ``path_rings`` those that are drawn.
    """
    names = [F.try_element_at("properties", F.lit(k)) for k in name_keys]
    return (
        features.select(
            first_filled(*names, default=presets.SHAPE_UNKNOWN).alias("name"),
            outer_rings(F.col("geometry.type"), F.col("geometry.coordinates")).alias("rings"),
            path_rings(F.col("geometry.type"), F.col("geometry.coordinates")).alias("path_rings"),
        )
        .filter(F.size(F.flatten("rings")) > 0)
        .select("name", map_value(F.col("name"), aliases, keep_unmatched=True).alias("entity"), "rings", "path_rings")
    )


def vertices(shape_rows: DataFrame) -> DataFrame:
    """One row per point: (name, ring, seq, x, y)."""
    return shape_rows.select("name", F.posexplode("rings").alias("ring", "_points")).select(
        "name", "ring", F.posexplode("_points").alias("seq", "_p")
    ).select("name", "ring", "seq", "_p.x", "_p.y")


def bbox(shape_rows: DataFrame) -> DataFrame:
    """One row: bounds of all points. Each row reduces itself first."""
    xs = F.transform(F.flatten("rings"), lambda p: p["x"])
    ys = F.transform(F.flatten("rings"), lambda p: p["y"])
    return shape_rows.agg(
        F.min(F.array_min(xs)).alias("min_x"),
        F.max(F.array_max(xs)).alias("max_x"),
        F.min(F.array_min(ys)).alias("min_y"),
        F.max(F.array_max(ys)).alias("max_y"),
    )


def project(shape_rows: DataFrame, width: float = 860, height: float = 580, pad: float = 20) -> DataFrame:
    """Fit all shapes to a canvas: one scale for both axes, centred, y downwards, 2 decimals.

    The bounds enter as a scalar subquery of one row.
    """
    inner_w, inner_h = float(width - 2 * pad), float(height - 2 * pad)
    b = F.col("_b")
    span_x, span_y = b["max_x"] - b["min_x"], b["max_y"] - b["min_y"]
    scale = F.least(F.try_divide(F.lit(inner_w), span_x), F.try_divide(F.lit(inner_h), span_y))
    with_scale = (
        shape_rows.withColumn("_b", bbox(shape_rows).select(F.struct("min_x", "max_x", "min_y", "max_y")).scalar())
        .withColumn("_s", scale)
        .withColumns(
            {
                "_off_x": (F.lit(inner_w) - span_x * F.col("_s")) / 2,
                "_off_y": (F.lit(inner_h) - span_y * F.col("_s")) / 2,
            }
        )
    )

    def placed(p: Column) -> Column:
        x = F.lit(float(pad)) + (p["x"] - b["min_x"]) * F.col("_s") + F.col("_off_x")
        y = F.lit(float(pad)) + (b["max_y"] - p["y"]) * F.col("_s") + F.col("_off_y")
        return F.struct(x.alias("x"), y.alias("y"))

    def rounded(p: Column) -> Column:
        return F.struct(round_exact(p["x"], 2).alias("x"), round_exact(p["y"], 2).alias("y"))

    for rings in ("rings", "path_rings"):
        if rings in shape_rows.columns:
            with_scale = with_scale.withColumn(rings, F.transform(rings, lambda r: F.transform(r, placed)))
            with_scale = with_scale.withColumn(rings, F.transform(rings, lambda r: F.transform(r, rounded)))
    return with_scale.drop("_b", "_s", "_off_x", "_off_y")


def feature_paths(projected: DataFrame) -> DataFrame:
    """Add ``path``: ``Mx,y Lx,y ...Z`` per ring that is drawn, rings joined by a blank."""
    drawn = "path_rings" if "path_rings" in projected.columns else "rings"

    def point(p: Column) -> Column:
        return F.concat(p["x"].cast("string"), F.lit(","), p["y"].cast("string"))

    def ring(r: Column) -> Column:
        return F.concat(F.lit("M"), F.array_join(F.transform(r, point), " L"), F.lit("Z"))

    return projected.withColumn("path", F.array_join(F.transform(drawn, ring), " "))


def centroids(projected: DataFrame) -> DataFrame:
    """Add the mean of all points (not the area's centroid; a closing point counts again)."""
    points = F.flatten("rings")

    def mean(axis: str) -> Column:
        total = F.aggregate(points, F.lit(0.0), lambda acc, p: acc + p[axis])
        return F.try_divide(total, F.size(points))

    return projected.withColumns({"center_x": mean("x"), "center_y": mean("y")})


def assign_colors(
    names: DataFrame, palette: Sequence[str] = presets.MAP_PALETTE, name: str = "name"
) -> DataFrame:
    """Distinct names with palette colours handed out in sorted order, over and over."""
    colors = F.array(*[F.lit(c) for c in palette])
    return ordered_index(names.select(name).distinct(), asc=[name], name="_i").select(
        name, F.element_at(colors, ((F.col("_i") - 1) % len(palette) + 1).cast("int")).alias("color")
    )
