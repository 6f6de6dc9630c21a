"""Gates and tiers of land parcels; inputs are columns, thresholds are parameters."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def eligible(residential: Column, heritage: Column, transit: Column, lot: Column, reach: float = 1500, least: float = 100) -> Column:
    """P16."""
    return residential & (F.coalesce(heritage, F.lit("")) != "part_iv") & (transit < reach) & (lot >= least)


def implied_fsi_too_high(footprint: Column, height: Column, lot: Column, fsi: Column, times: float = 3, above: float = 5) -> Column:
    """Footprint times storeys over the lot is more than ``times`` the zoned ratio."""
    return (height > above) & (footprint * F.greatest(F.bround(height / 3), F.lit(1.0)) / lot > times * fsi)


def positive_residential(lot: Column, vacant: Column, coverage: Column, height: Column) -> Column:
    """Not too large; vacant lots only small ones; else coverage and height agree on a building."""
    return (lot <= 5000) & F.when(vacant, lot <= 2000).otherwise((coverage > 0.05) == (height > 0))


def wealth_gate(lots: DataFrame, listed: DataFrame, enclaves: Sequence[int], estate_lot: float = 2000, mansion_floor: float = 1200, mansion_value: float = 1_000_000, max_value: float = 2_000_000) -> DataFrame:
    """P20: drops enclaves, estate shapes, mansions, dear dwellings and listed (street, nb) pairs; a missing value passes."""
    estate = (F.col("lot_m2") > estate_lot) & (F.col("coverage") < 0.15) & (F.col("height_m") > 0)
    mansion = (F.col("lot_m2") * F.col("coverage") >= mansion_floor) & (F.col("nb") * 100000 >= mansion_value)
    dear = F.coalesce(F.col("value"), F.lit(0.0)) > max_value
    return lots.where(~(F.col("nb").isin(*enclaves) | estate | mansion | dear)).join(F.broadcast(listed), ["street", "nb"], "left_anti")  # listed: a fixed list of a few dozen pairs


def shared_gate(excluded: Sequence[str] = ("LARGE",)) -> Column:
    """P21 without the wealth gate."""
    f = F.col("footprint")
    return F.col("heritage").isNull() & ~F.col("regulated") & ~F.col("kind").isin(*excluded) & (f < 500) & ~((f > 0) & (f < 30)) & (F.col("number") > 0)


def apartment_like(height: Column, coverage: Column, units: Column, address_points: Column) -> Column:
    """Tall on much ground with many more units than addresses."""
    return (height >= 14) & (coverage >= 0.25) & (units >= 10) & (units - address_points >= 5)


def trusted_structure(kind: Column, source: Column, address_points: Column, kinds: Sequence[str] = ("vacant", "detached"), sources: Sequence[str] = ("permit", "osm", "address_points")) -> Column:
    """A structure type that may be elite and, unless vacant, comes from a trusted source; the classifier's 'detached' is
    trusted where exactly one address point confirms it."""
    confirmed = source.isin(*sources) | ((source == "classifier") & (kind == "detached") & (address_points == 1))
    return F.coalesce(kind.isin(*kinds) & ((kind == "vacant") | F.coalesce(confirmed, F.lit(False))), F.lit(False))


def elite_gate(lot: float = 250, units: int = 4, reach: float = 500, back_lot: float = 15, storeys: int = 4) -> Column:
    """On lots with residential, abuts_lane, to_street_m, suspect, recent_permits, drift, address_points, units_approx,
    structure_type and structure_source; missing flags and counts are no and 0."""
    no = lambda c: ~F.coalesce(F.col(c), F.lit(False))
    count = lambda c: F.coalesce(F.col(c), F.lit(0))
    built = (F.col("structure_type") != "vacant") & (F.col("height_m") > 0)
    too_high = built & (F.greatest(F.bround(F.col("height_m") / 3), F.lit(1.0)) >= storeys)
    return (
        (F.col("lot_m2") >= lot) & (F.col("units") >= units) & (F.col("transit_m") <= reach) & F.coalesce("residential", F.lit(False))
        & ~(F.coalesce("abuts_lane", F.lit(False)) & (count("to_street_m") >= back_lot)) & no("suspect") & (count("recent_permits") < 1) & no("drift")
        & ~apartment_like(count("height_m"), count("coverage"), count("units_approx"), count("address_points")) & ~F.coalesce(too_high, F.lit(False))
        & trusted_structure(F.col("structure_type"), F.col("structure_source"), count("address_points"))
    )


def broader_gate(kinds: Sequence[str], lot: float = 200, units: int = 3, reach: float = 1500) -> Column:
    """P23."""
    return (F.col("lot_m2") >= lot) & (F.col("units") >= units) & (F.col("transit_m") <= reach) & F.col("kind").isin(*kinds)


def flatten(df: DataFrame, paths: Mapping[str, str], defaults: Mapping[str, object]) -> DataFrame:
    """Nested properties as flat columns, with defaults for missing ones."""
    return df.select(*[(F.coalesce(F.col(p), F.lit(defaults[n])) if n in defaults else F.col(p)).alias(n) for n, p in paths.items()])


def search(cols: Sequence[str], text: str) -> Column:
    """P25: the text stands in one of the columns, whatever the case."""
    out = F.lit(False)
    for c in cols:
        out = out | F.contains(F.lower(F.col(c)), F.lit(text.lower()))
    return out


def suspect(height: Column, coverage: Column, around: Column, tall: float = 30, low: float = 0.1) -> Column:
    """Tall on little ground, or a height that is a neighbouring quadrant's (within 0.1) on little ground."""
    return ((height > tall) & (coverage < low)) | ((height >= 9) & (coverage < 0.25) & F.exists(around, lambda a: F.abs(height - a) <= 0.1))
