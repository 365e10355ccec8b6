"""Classification and text helpers."""

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from panelspark import presets


def direction(pct: Column, band: float, names: Sequence[str] = presets.TREND_NAMES) -> Column:
    """Rising above the band, falling below its negative, stable between."""
    up, down, flat = names
    return F.when(pct > band, up).when(pct < -band, down).otherwise(flat)


def grade(
    pct: Column,
    cuts: Sequence[float] = presets.GRADE_CUTS,
    labels: Sequence[str] = presets.GRADE_LABELS,
) -> Column:
    """First label whose cut the value lies below; the last label otherwise."""
    out = F.when(pct < cuts[0], labels[0])
    for cut, label in zip(cuts[1:], labels[1:]):
        out = out.when(pct < cut, label)
    return out.otherwise(labels[-1])


def right_closed_bin(
    x: Column,
    edges: Sequence[float] = presets.RISK_EDGES,
    labels: Sequence[str] = presets.RISK_LABELS,
) -> Column:
    """Label of the interval (lo, hi] holding the value; NULL outside, so NULL at the lowest edge."""
    out = F.when((x > edges[0]) & (x <= edges[1]), labels[0])
    for lo, hi, label in zip(edges[1:], edges[2:], labels[1:]):
        out = out.when((x > lo) & (x <= hi), label)
    return out


def label_letter(c: Column) -> Column:
    """``"F  (Critical rise)"`` -> ``"F"``."""
    return F.substring(c, 1, 1)


def label_text(c: Column) -> Column:
    """``"F  (Critical rise)"`` -> ``"Critical rise"``; empty when there is none."""
    return F.regexp_extract(c, r"\(([^(]*?)\)*$", 1)


def map_value(c: Column, mapping: Mapping[str, str], keep_unmatched: bool = False) -> Column:
    """Literal lookup; unmatched values become NULL, or stay as they are."""
    entries = [F.lit(v) for pair in mapping.items() for v in pair]
    found = F.try_element_at(F.create_map(*entries), c) if entries else F.lit(None).cast("string")
    return F.coalesce(found, c) if keep_unmatched else found


def first_filled(*columns: Column, default: str) -> Column:
    """First value that is neither NULL nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns], F.lit(default))


def shorten(c: Column, longest: int = 9, keep: int = 7) -> Column:
    """Labels longer than ``longest`` are cut to ``keep`` characters and marked ``..``."""
    return F.when(F.length(c) > longest, F.concat(F.substring(c, 1, keep), F.lit(".."))).otherwise(c)


def arrow(pct: Column) -> Column:
    return F.when(pct > 0, "▲").when(pct < 0, "▼").otherwise("→")


def bar(value: Column, top: Column, width: int, at_least: int = 0) -> Column:
    """Text bar of a length proportional to ``value / top``."""
    n = F.floor(F.coalesce(F.try_divide(value, top), F.lit(0.0)) * width).cast("int")
    return F.repeat(F.lit("█"), F.greatest(F.lit(at_least), n))


def matches_any_prefix(c: Column, prefixes: Sequence[str]) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | c.startswith(p)
    return out


def is_aggregate_name(c: Column, pattern: str = presets.AGGREGATE_PATTERN) -> Column:
    """Names of total rows, any case; NULL names are not total rows."""
    return F.coalesce(F.lower(c).rlike(pattern), F.lit(False))
