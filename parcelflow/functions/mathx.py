"""Scores, waterfalls and rates as column expressions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def clamp(x: Column, low: float = 0.0, high: float = 100.0) -> Column:
    return F.least(F.greatest(x, F.lit(float(low))), F.lit(float(high)))


def pct(num: Column, den: Column, digits: int = 1) -> Column:
    """Share in per cent; null when a part is missing or the denominator is 0."""
    return F.bround(F.try_divide(num * 100.0, den.cast("double")), digits)


def minmax(x: Column, invert: bool = False) -> Column:
    """0 to 100 over all rows; null and constant columns give 50."""
    all_rows = W.partitionBy()
    low, high = F.min(x).over(all_rows), F.max(x).over(all_rows)
    scaled = F.bround((x - low) / (high - low) * 100.0, 1)
    return F.when(x.isNull() | (high == low), 50.0).otherwise(100.0 - scaled if invert else scaled)


def composite(a: Column, b_inverse: Column, c: Column) -> Column:
    """W06."""
    return F.bround(a * 0.5 + b_inverse * 0.3 + c * 0.2, 1)


def weighted_score(parts: Mapping[str, Column], weights: Mapping[str, float], existing: Column, potential: Column, digits: int = 1) -> Column:
    """Weighted sum of 0-100 inputs, canopy doubled and capped, headroom (potential / existing - 1) * 50, clamped."""
    headroom = clamp(F.coalesce((F.try_divide(potential, existing) - 1) * 50.0, F.lit(0.0)))
    inputs = {**parts, "canopy": F.least(parts["canopy"] * 2, F.lit(100.0)), "headroom": headroom}
    total = sum(weights.values())
    score = F.lit(0.0)
    for k, w in weights.items():
        score = score + inputs[k] * (w / total)
    return F.bround(clamp(score), digits)


def units_waterfall(zoned: Column, residential: Column, explicit: Column, fsi: Column, lot: Column, default: Column) -> Column:
    """Struct (units, basis): 0 unzoned or not residential, explicit units, FSI * lot / 85, else the class default."""
    s = lambda u, b: F.struct(u.cast("long").alias("units"), F.lit(b).alias("basis"))
    return (
        F.when(~zoned, s(F.lit(0), "unzoned")).when(~residential, s(F.lit(0), "not residential"))
        .when(explicit > 0, s(explicit, "explicit")).when(fsi > 0, s(F.greatest(F.floor(fsi * lot / 85.0), F.lit(1)), "fsi")).otherwise(s(default, "class default"))
    )


def structure_waterfall(sources: list[tuple[str, Column]], demotions: list[tuple[Column, str]]) -> Column:
    """Struct (type, source) from the first source that knows, then the last demotion that applies."""
    first = F.coalesce(*[F.when(c.isNotNull(), F.struct(c.alias("type"), F.lit(n).alias("source"))) for n, c in sources], F.struct(F.lit("unknown").alias("type"), F.lit("none").alias("source")))
    out = first
    for test, kind in demotions:
        out = F.when(test, F.struct(F.lit(kind).alias("type"), out["source"].alias("source"))).otherwise(out)
    return out


def existing_units(vacant: Column, permits: Column, height: Column, footprint: Column) -> Column:
    """Struct (units, basis): 0 vacant, permits, floors (at most 20) * footprint / 90, else a band by height."""
    s = lambda u, b: F.struct(u.cast("long").alias("units"), F.lit(b).alias("basis"))
    floors = F.least(F.greatest(F.bround(height / 3.0), F.lit(1.0)), F.lit(20.0))
    return (
        F.when(vacant, s(F.lit(0), "vacant")).when(permits > 0, s(permits, "permits"))
        .when((height > 0) & (footprint > 0), s(F.greatest(F.floor(floors * footprint / 90.0), F.lit(1)), "height"))
        .otherwise(s(F.when(height >= 12, 8).when(height >= 9, 3).otherwise(1), "band"))
    )


def solar_score(kwh: Column, p95: Column, unshaded: Column, digits: int = 1) -> Column:
    """100 * kWh / P95, clamped, times the unshaded share; null when that is unknown."""
    return F.bround(clamp(F.try_divide(kwh * 100.0, p95)) * unshaded, digits)


def resolve_height(highest: Column, average: Column) -> Column:
    """The highest if positive, else the average if positive."""
    return F.coalesce(F.when(highest > 0, highest), F.when(average > 0, average))


def token_cost(tokens_in: Column, tokens_out: Column, searches: Column, rate_in: float, rate_out: float, rate_search: float, batch: bool, digits: int = 6) -> Column:
    """Cost of a call, half of it for batches, six decimals."""
    cost = tokens_in * (rate_in / 1e6) + tokens_out * (rate_out / 1e6) + searches * rate_search
    return F.bround(cost * (0.5 if batch else 1.0), digits)


def parcel_flags(year: Column, residential: Column, zoned: Column, depth: Column, footprint: Column, years: tuple[int, int] = (1945, 1960), least_depth: float = 15) -> dict[str, Column]:
    """Built in the post-war years and residential; deep enough for a second house at the back; floor area of two storeys."""
    return {"postwar": year.between(*years) & residential, "back_lot": zoned & (depth >= least_depth), "bonus": F.lit(2) * footprint}
