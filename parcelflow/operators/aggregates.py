"""Area roll-ups, indexes and densities; columns and thresholds are parameters."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def first_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each key in the given order."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def keep_first(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """One row for each key, the first in the given order."""
    return first_n(df, keys, order, 1)


def sample_text(df: DataFrame, key: str, item: str, order: str, n: int = 5) -> DataFrame:
    """The first ``n`` items of each key in order, comma-joined; only those are gathered."""
    top = first_n(df.select(key, item, order), [key], [F.col(order)], n)
    each = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(item).cast("string").alias("i"))))
    return top.groupBy(key).agg(F.array_join(F.transform(each, lambda x: x["i"]), ",").alias("sample"))


def area_totals(df: DataFrame, key: str, sums: dict[str, str], flag: Column, item: str, order: str) -> DataFrame:
    """Count, sums, count of flagged rows and the first five items of each area."""
    agg = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(a) for a, c in sums.items()], F.count_if(flag).alias("n_flagged"))
    return agg.join(sample_text(df, key, item, order), key)


def with_zero_rows(areas: DataFrame, counts: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """Every area, with zeros where nothing was counted."""
    return areas.select(key).join(counts, key, "left").fillna(0, list(cols))


def category_map(df: DataFrame, key: str, category: str, out: str = "by_category") -> DataFrame:
    """Category -> count as a map for each key, in two grouped steps."""
    n = df.groupBy(key, category).agg(F.count(F.lit(1)).alias("_n"))
    return n.groupBy(key).agg(F.sum("_n").alias("n"), F.map_from_entries(F.array_sort(F.collect_list(F.struct(category, "_n")))).alias(out))


def map_text(m: str) -> Column:
    return F.array_join(F.transform(F.map_entries(m), lambda e: F.concat_ws("=", e["key"].cast("string"), e["value"].cast("string"))), ",")


def nearest_rank(df: DataFrame, col: str, p: float, keys: Sequence[str] = (), out: str = "p") -> DataFrame:
    """sorted[int(p * (n - 1))] of the non-null values, for each key or overall.

    Overall, values are counted and summed up by value first, so the running total goes over distinct values per range
    bucket; with keys, by a window for each key."""
    df = df.where(F.col(col).isNotNull())
    if keys:
        w = W.partitionBy(*keys)
        at = F.floor(F.lit(p) * (F.count(F.lit(1)).over(w) - 1)) + 1
        ranked = df.select(*keys, col, F.row_number().over(w.orderBy(col)).alias("_rn"), at.alias("_at"))
        return ranked.where("_rn = _at").select(*keys, F.col(col).alias(out))
    n = df.groupBy(F.col(col).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    edges = df.select(F.approx_percentile(col, F.array(*[F.lit(i / 64) for i in range(1, 64)]), F.lit(10_000)).alias("e"))
    part = n.join(F.broadcast(edges)).withColumn("_b", F.size(F.filter("e", lambda x: F.col("_v") > x))).drop("e")  # edges: one row
    total = part.groupBy("_b").agg(F.sum("_c").alias("_t"))
    before = total.select("_b", F.coalesce(F.sum("_t").over(W.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("_t").over(W.partitionBy()).alias("_all"))
    run = F.sum("_c").over(W.partitionBy("_b").orderBy("_v").rowsBetween(W.unboundedPreceding, 0)) + F.col("_before")
    hit = part.join(F.broadcast(before), "_b").withColumn("_run", run).where(F.col("_run") >= F.floor(F.lit(p) * (F.col("_all") - 1)) + 1)
    return hit.agg(F.min("_v").alias(out))


def share_above(points: DataFrame, key: str, col: str, threshold: DataFrame, default: float = 50.0, areas: DataFrame | None = None) -> DataFrame:
    """Per cent of an area's points at or above the one value of ``threshold``; areas without points get the default."""
    s = points.join(F.broadcast(threshold.select(F.col("p").alias("_p")))).groupBy(key).agg((F.avg((F.col(col) >= F.col("_p")).cast("double")) * 100).alias("share"))  # threshold: one row
    return s if areas is None else areas.select(key).join(s, key, "left").fillna(default, ["share"])


def density_score(counts: DataFrame, key: str, density: str) -> DataFrame:
    """Density by its 95th nearest-rank percentile over the areas, 0 to 100."""
    p = nearest_rank(counts.where(F.col(density) > 0), density, 0.95)
    return counts.join(F.broadcast(p)).select(key, F.least(F.greatest(F.bround(F.try_divide(F.col(density) * 100.0, F.col("p")), 1), F.lit(0.0)), F.lit(100.0)).alias("score"))  # p: one row


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], cols: Sequence[str]) -> DataFrame:
    """The columns of the newest row of each key, and how many more rows it has."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("_l"), (F.count(F.lit(1)) - 1).alias("extra")).select(*keys, *[F.col(f"_l.{c}").alias(c) for c in cols], "extra")


def median_if(df: DataFrame, key: str, col: str, least: int) -> DataFrame:
    """Exact median of each key with at least ``least`` rows, else null."""
    return df.groupBy(key).agg(F.when(F.count(col) >= least, F.median(col)).alias("median"), F.count(col).alias("n"))


def median_bracket(brackets: DataFrame, key: str, order: str, mid: str, count: str) -> DataFrame:
    """Middle of the bracket where the running share first reaches one half."""
    w = W.partitionBy(key)
    run = F.sum(count).over(w.orderBy(order).rowsBetween(W.unboundedPreceding, 0)) / F.sum(count).over(w)
    return brackets.withColumn("_s", run).where("_s >= 0.5").groupBy(key).agg(F.min_by(mid, order).alias("median_mid"))


#: Distinct values below which a column is few-valued, and the share from which a boolean is near-constant.
FEW, NEAR = 15, 0.995


def profile(df: DataFrame, cols: Sequence[str], expected: Mapping[str, object] | None = None) -> DataFrame:
    """(column, rows, nulls, distinct, finding, severity), one row for each column.

    One scan takes nulls, least and largest value, true values of booleans and a mergeable sketch of the distinct values, so no
    row is copied for any column.  Only columns whose sketch says that they have few values are then counted exactly, as small
    sets; ``distinct`` is null for the others.  Findings: 'null' (HIGH), 'constant' (HIGH, MEDIUM beside nulls), 'near_constant'
    (a boolean of which at least NEAR is one value: MEDIUM), 'few' (fewer than FEW values: MEDIUM), else none.  Null and
    constant columns with the expected value (``expected``: column -> value) are LOW.  An empty table has no findings."""
    kind = {f.name: f.dataType.typeName() for f in df.schema}
    per = lambda c: [
        F.count_if(F.col(c).isNull()).alias(f"{c}__nulls"), F.approx_count_distinct(c, 0.02).alias(f"{c}__about"), F.min(F.col(c).cast("string") if kind[c] == "boolean" else c).alias(f"{c}__least"),
        F.max(F.col(c).cast("string") if kind[c] == "boolean" else c).alias(f"{c}__most"), (F.count_if(F.col(c)) if kind[c] == "boolean" else F.lit(None).cast("long")).alias(f"{c}__true"),
    ]
    one = df.agg(F.count(F.lit(1)).alias("rows"), *[x for c in cols for x in per(c)]).first()
    few = [c for c in cols if one[f"{c}__about"] <= 2 * FEW]
    sizes = df.agg(*[F.size(F.collect_set(c)).alias(c) for c in few]).first() if few else {}
    out = []
    for c in cols:
        n, nulls, distinct = one.rows, one[f"{c}__nulls"], sizes[c] if c in few else None
        seen, true = n - nulls, one[f"{c}__true"]
        finding = severity = None
        if n and not seen:
            finding, severity, value = "null", "HIGH", None
        elif n and one[f"{c}__least"] == one[f"{c}__most"]:
            finding, severity, value = "constant", "MEDIUM" if nulls else "HIGH", one[f"{c}__least"]
        elif seen and true is not None and max(true, seen - true) >= NEAR * seen:
            finding, severity = "near_constant", "MEDIUM"
        elif seen and true is None and distinct is not None and distinct < FEW:
            finding, severity = "few", "MEDIUM"
        if finding in ("null", "constant") and expected and c in expected:
            want = expected[c]
            if want == value or (isinstance(want, bool) and str(want).lower() == value):
                severity = "LOW"
        out.append((c, n, nulls, distinct if distinct is not None and distinct < FEW else None, finding, severity))
    return df.sparkSession.createDataFrame(out, "column string, rows long, nulls long, distinct long, finding string, severity string")


def mixed_types(df: DataFrame, col: str) -> DataFrame:
    """(kind, n) of a column of JSON texts by the type of their value: boolean, number, text, array, object; more than one
    kind is a finding.  Nulls, JSON nulls and texts that are no JSON are left out."""
    v = F.trim(F.col(col))
    number = v.rlike(r"^-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?$")
    kind = (
        F.when(v.isin("true", "false"), "boolean").when(number, "number").when(v.rlike(r'^"(?s:.*)"$'), "text").when(v.startswith("["), "array").when(v.startswith("{"), "object")
    )
    return df.select(kind.alias("kind")).where("kind IS NOT NULL").groupBy("kind").agg(F.count("*").alias("n"))


def category_ages(df: DataFrame, key: str, category: str, since: str, as_of: dt.date) -> DataFrame:
    """Per key the rows, those at least 10 and 20 years old, and the counts of each category, of all and of those of 20 years.

    Years are days / 365.25.  Two grouped steps; a key without old rows has an empty second map."""
    years = F.datediff(F.lit(as_of), F.col(since).cast("date")) / 365.25
    n = df.groupBy(key, category).agg(F.count("*").alias("_n"), F.count_if(years >= 10).alias("_n10"), F.count_if(years >= 20).alias("_n20"))
    entries = lambda c: F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col(c) > 0, F.struct(category, c)))))
    return n.groupBy(key).agg(F.sum("_n").alias("n"), F.sum("_n10").alias("n_10y"), F.sum("_n20").alias("n_20y"), entries("_n").alias("by_category"), entries("_n20").alias("by_category_20y"))


def recall(truth: DataFrame, tiers: DataFrame, key: str, group: str) -> DataFrame:
    """How many true rows reach a tier, by group and overall (null group)."""
    j = truth.join(tiers, key, "left")
    out = j.rollup(group).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("tier") == "elite").alias("elite"), F.count_if(F.col("tier").isNotNull()).alias("any_tier"))
    return out.withColumn("recall", F.bround(F.col("any_tier") * 100.0 / F.col("n"), 2))


def storeys(height: Column, floor_m: float = 3.0) -> Column:
    return F.bround(height / floor_m)


#: Floor height in metres, dollars for a square metre of floor, kilograms of CO2 for one a year.
FLOOR_M, VALUE_M2, CO2_M2 = 3.0, 4000.0, 25.0


def envelope_measures(lots: DataFrame, key: str, ratio: float = 0.6, value_m2: float = VALUE_M2, co2_m2: float = CO2_M2, cost: str | None = None) -> DataFrame:
    """Per area storeys, existing floor area and its ratio to the land, unused ratio and floor area, and the value and CO2 of
    the unused area; ``cost``: a column to sum beside them.  lots: lot_m2, coverage, height_m."""
    floors = F.greatest(storeys(F.col("height_m"), FLOOR_M), F.lit(1.0))
    d = lots.withColumn("_gfa", F.col("lot_m2") * F.col("coverage") * floors)
    d = d.withColumn("_unused", F.greatest(F.col("lot_m2") * ratio - F.col("_gfa"), F.lit(0.0)))
    sums = {"storeys": storeys(F.col("height_m"), FLOOR_M), "existing_gfa": F.col("_gfa"), "unused_gfa": F.col("_unused"), "land": F.col("lot_m2"), "cost": F.col(cost) if cost else F.lit(0.0)}
    g = d.groupBy(key).agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    return g.select(
        key, F.col("storeys").cast("long").alias("storeys"), "existing_gfa", F.try_divide("existing_gfa", "land").alias("existing_fsi"), "unused_gfa", F.try_divide("unused_gfa", "land").alias("unused_fsi"),
        (F.col("unused_gfa") * value_m2).alias("value"), (F.col("unused_gfa") * co2_m2).alias("co2_kg"), "cost")


def unused_envelope(lots: DataFrame, key: str, ratio: float = 0.6) -> DataFrame:
    """Unused floor area under a floor-area ratio, and storeys, of each area; lots: lot_m2, coverage, height_m."""
    allowed = F.col("lot_m2") * ratio
    built = F.col("lot_m2") * F.col("coverage") * F.greatest(storeys(F.col("height_m")), F.lit(1.0))
    return lots.groupBy(key).agg(F.sum(F.floor(allowed - F.least(built, allowed))).cast("long").alias("unused_gfa"), F.sum(storeys(F.col("height_m"))).cast("long").alias("storeys"))


def with_grand_total(df: DataFrame, key: str, **aggregates: Column) -> DataFrame:
    """The aggregates of each key and, with a null key, of all rows, in one pass."""
    return df.rollup(key).agg(*[c.alias(n) for n, c in aggregates.items()])


def closure_index(df: DataFrame, label: str, closed: str, as_of: dt.date, least: int = 20) -> DataFrame:
    """Active, closed in 90 and 365 days, and the yearly rate per 100 active where at least ``least`` are active."""
    day, until = F.col(closed), F.lit(as_of)
    within = lambda d: F.count_if((day > F.date_sub(until, d)) & (day <= until))
    n = df.groupBy(label).agg(F.count_if(day.isNull()).alias("active"), within(90).alias("closed90"), within(365).alias("closed365"))
    return n.withColumn("rate", F.when(F.col("active") >= least, F.bround(F.col("closed365") * 100.0 / F.col("active"), 6)))


def openings_index(df: DataFrame, labels: Column, opened: str, as_of: dt.date) -> DataFrame:
    """Openings of each label in the last 365 and 30 days, and the newest; a row counts once for each of its labels."""
    d = df.select(F.explode(F.array_distinct(labels)).alias("label"), F.col(opened).cast("date").alias("_d")).where(F.col("_d").between(F.date_sub(F.lit(as_of), 365), F.lit(as_of)))
    return d.groupBy("label").agg(F.count(F.lit(1)).alias("n365"), F.count_if(F.col("_d") >= F.date_sub(F.lit(as_of), 30)).alias("n30"), F.max("_d").alias("newest"))


def two_level_rollup(df: DataFrame, unit: Column, area: Column, value: str, digits: int = 3) -> DataFrame:
    """A10: unit counts and means rolled up to areas: sum of counts, mean of the units' means.  ``area`` reads column ``unit``."""
    u = df.groupBy(unit.alias("unit")).agg(F.count(F.lit(1)).alias("n"), F.bround(F.avg(value), 4).alias("mean"))
    return u.groupBy(area.alias("area")).agg(F.sum("n").alias("n"), F.round(F.avg("mean"), digits).alias("mean_of_means"))


def long_form(wide: DataFrame, ids: Sequence[str], values: Sequence[str], names: str = "variable", value: str = "v") -> DataFrame:
    """One row for each id and value column."""
    return wide.unpivot(list(ids), list(values), names, value)


def permit_rollup(entities: DataFrame, permits: DataFrame, key: str, value: str, issued: str, as_of: dt.date, days: int = 730) -> DataFrame:
    """Entities with the count, value and newest day of their permits of the last ``days`` days; none: 0, 0.0 and null."""
    recent = permits.where(F.col(issued).cast("date") >= F.date_sub(F.lit(as_of), days))
    n = recent.groupBy(key).agg(F.count(F.lit(1)).alias("permits"), F.round(F.sum(value), 2).alias("value"), F.max(F.col(issued).cast("date")).alias("latest"))
    return entities.join(n, key, "left").fillna(0, ["permits"]).fillna(0.0, ["value"])


def builder_activity(rows: DataFrame, key: str) -> DataFrame:
    """Rows of each builder and their bucket (1, 2-3, 4+)."""
    n = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("bucket", F.when(F.col("n") == 1, "1").when(F.col("n") <= 3, "2-3").otherwise("4+"))


def signal_stats(signals: DataFrame, parcels: DataFrame, signal: str, key: str) -> DataFrame:
    """Of each signal: total, matched and unmatched rows and distinct parcels."""
    j = signals.join(parcels.select(key, F.col(key).alias("_hit")).distinct(), key, "left")
    return j.groupBy(signal).agg(F.count(F.lit(1)).alias("total"), F.count("_hit").alias("matched"), (F.count(F.lit(1)) - F.count("_hit")).alias("unmatched"), F.countDistinct("_hit").alias("parcels"))


def weighted_share(df: DataFrame, key: str, weight: str, test: Column, default: float = 30.0, digits: int = 6) -> DataFrame:
    """Per cent of the weight that passes the test; areas where nothing passes get the default."""
    return df.groupBy(key).agg(F.round(F.coalesce(F.sum(F.when(test, F.col(weight))) * 100 / F.sum(weight), F.lit(default)), digits).alias("share"))


def capacity(df: DataFrame, key: str, kind: str, per_lot: DataFrame, units: str, default: int) -> DataFrame:
    """Units that the zoning of an area allows (per_lot: kind, per_lot), the default where none, at least those there are."""
    z = df.join(per_lot.select(F.col("kind").alias(kind), "per_lot"), kind, "left")
    allowed = F.coalesce(F.nullif(F.sum(F.coalesce("per_lot", F.lit(0))), F.lit(0)), F.lit(default))
    return z.groupBy(key).agg(F.greatest(allowed, F.sum(units)).cast("long").alias("capacity"))


def rate_per(entities: DataFrame, events: DataFrame, key: str, area: str, per: float, out: str, digits: int = 6) -> DataFrame:
    """Events of an area's entities for every ``per`` entities."""
    n = events.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    return entities.join(n, key, "left").groupBy(area).agg(F.round(F.coalesce(F.sum("_n"), F.lit(0)) * per / F.count(F.lit(1)), digits).alias(out))


def repeated_names(df: DataFrame, name: Column, item: str, least: int = 2) -> DataFrame:
    """Names of at least ``least`` rows, with their count and first item."""
    return df.groupBy(name.alias("brand")).agg(F.count(F.lit(1)).alias("n"), F.min(item).alias("first_id")).where(F.col("n") >= least)


def ledger_rollup(df: DataFrame, provider: str, sku: str, day: str, cost: str) -> DataFrame:
    """Cost and calls by provider, by provider and sku, by day and in all, from one scan (absent keys are null)."""
    sets = [[F.col(provider)], [F.col(provider), F.col(sku)], [F.col(day)], []]
    return df.groupingSets(sets, F.col(provider), F.col(sku), F.col(day)).agg(F.round(F.sum(cost), 4).alias("cost"), F.count(F.lit(1)).alias("calls"))


def strictest(df: DataFrame, key: str, flag: str, order: Sequence[str]) -> DataFrame:
    """The strictest flag of each key; ``order`` goes from lenient to strict, other flags are the most lenient."""
    rank = F.coalesce(F.array_position(F.array(*[F.lit(x) for x in order]), F.col(flag)), F.lit(0))
    return df.groupBy(key).agg(F.max_by(flag, rank).alias(flag))


def attached_kind(df: DataFrame, key: str, address: str) -> DataFrame:
    """Kind by the number of distinct addresses: 2 semi, more row, one null."""
    n = df.groupBy(key).agg(F.countDistinct(address).alias("_n"))
    return n.select(key, F.when(F.col("_n") == 2, "semi").when(F.col("_n") > 2, "row").alias("kind"))


def unjoined(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row with the number of rows whose key the other side lacks."""
    return left.join(right.select(key), key, "left_anti").agg(F.count(F.lit(1)).alias("unjoined"))


def concentration(df: DataFrame, name: str, top: int = 5) -> DataFrame:
    """Share of the ``top`` largest groups, number of groups and of repeated ones; ties by name."""
    n = df.groupBy(name).agg(F.count(F.lit(1)).alias("_n"))
    first = n.orderBy(F.desc("_n"), name).limit(top).agg(F.sum("_n").alias("_t"))
    every = n.agg(F.sum("_n").alias("_a"), F.count(F.lit(1)).alias("groups"), F.count_if(F.col("_n") > 1).alias("repeated"))
    return every.join(F.broadcast(first)).select(F.round(F.col("_t") * 100.0 / F.col("_a"), 6).alias(f"top{top}_share"), "groups", "repeated")  # both: one row


def agreement(df: DataFrame, truth: str, guess: str, family: Callable[[Column], Column]) -> DataFrame:
    """Rows that agree exactly, within a family, not at all, or whose guess is missing."""
    same = F.when(F.col(truth) == F.col(guess), "exact").when(F.col(guess).isNull(), "abstain")
    return df.groupBy(same.when(family(F.col(truth)) == family(F.col(guess)), "family").otherwise("wrong").alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def drift(df: DataFrame, code: str, known: DataFrame, most: int = 10) -> DataFrame:
    """The ``most`` frequent codes that the table lacks; ties by code."""
    return df.join(known.select(code), code, "left_anti").groupBy(code).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), code).limit(most)


def per_hundred(df: DataFrame, key: str, test: Column, digits: int = 6) -> DataFrame:
    """Rows that pass for every 100 rows of a key."""
    return df.groupBy(key).agg(F.bround(F.count_if(test) * 100.0 / F.greatest(F.count(F.lit(1)), F.lit(1)), digits).alias("per_100"))


def cross_counts(df: DataFrame, *axes: str) -> DataFrame:
    """Counts by every subset of the axes (absent ones are null)."""
    return df.cube(*axes).agg(F.count(F.lit(1)).alias("n"))


def distribution(df: DataFrame, label: str, digits: int = 6) -> DataFrame:
    """Count and share of each label."""
    n = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return n.join(F.broadcast(n.agg(F.sum("n").alias("_t")))).select(label, "n", F.round(F.col("n") / F.col("_t"), digits).alias("share"))  # total: one row


def transitions(state: DataFrame, verdicts: DataFrame, key: str, old: str, new: str) -> DataFrame:
    """Rows whose label stayed, was split, is unknown now, or has no verdict (error)."""
    j = state.select(key, old).join(verdicts.select(key, new), key, "left")
    kind = F.when(F.col(new).isNull(), "error").when(F.col(new) == "unknown", "unknown").when(F.col(old) == F.col(new), "stayed").otherwise("split")
    return j.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def paired(df: DataFrame, key: str, name: str, pair: tuple[str, str], value: str, digits: int = 2) -> DataFrame:
    """Sum of the two named values of a key, 0 where one is missing."""
    wide = df.groupBy(key).pivot(name, list(pair)).agg(F.max(value))
    return wide.select(key, F.round(F.coalesce(F.col(pair[0]) + F.col(pair[1]), F.lit(0.0)), digits).alias("paired"))


def cumulative_share(df: DataFrame, key: str, order: str, value: Column, digits: int = 8) -> DataFrame:
    """Running share of a value within a key, in order."""
    w = W.partitionBy(key)
    run = F.sum(value).over(w.orderBy(order).rowsBetween(W.unboundedPreceding, 0)) / F.sum(value).over(w)
    return df.withColumn("share", F.round(run, digits))
