"""Operators on empty tables, nulls, ties and repeated rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from parcelflow.functions import geo
from parcelflow.operators import aggregates as agg
from parcelflow.operators import feeds, resolve, spatial

DAY = dt.date(2024, 3, 1)
ROWS = [(1, "a", 5.0, dt.date(2024, 2, 20)), (2, "a", None, None), (3, None, 7.0, dt.date(2023, 1, 1)), (4, "b", 7.0, dt.date(2024, 2, 20)), (4, "b", 7.0, dt.date(2024, 2, 20)), (None, "b", -1.0, dt.date(2024, 1, 1))]
SCHEMA = "k int, g string, v double, d date"


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def values(out, *cols):
    return sorted([tuple(r[c] for c in cols) for r in out.collect()], key=str)


CALLS = {
    "newest": (lambda d: feeds.newest(d, "d", "k", 2), ("k",), [(1,), (4,)]),
    "largest": (lambda d: feeds.largest(d, F.col("v"), "k", 3), ("k",), [(3,), (4,), (4,)]),
    "sorted_up": (lambda d: feeds.sorted_either(d, F.col("v"), "k", 2, False), ("v",), [(-1.0,), (5.0,)]),
    "sorted_down": (lambda d: feeds.sorted_either(d, F.col("v"), "k", 6, True).where("v IS NULL"), ("k",), [(2,)]),
    "lead": (lambda d: feeds.lead(d, d.where("g = 'b'"), "g", [F.desc("v"), F.col("k")]), ("k",), [(4,)]),
    "announce": (lambda d: feeds.announce_queue(d, d.where("k = 1"), "k", "d", "k", DAY), ("k",), [(4,), (4,)]),
    "broken": (lambda d: feeds.broken_links(d, F.col("v") > 5, "k", 2), ("k",), [(1,), (2,)]),
    "any_filter": (lambda d: feeds.any_filter(d, "k", F.col("v") > 6, F.col("g") == "a"), ("k",), [(1,), (2,), (3,), (4,)]),
    "union": (lambda d: feeds.target_union([d, d.where("k = 1")], "k", d.where("k = 4")), ("k", "known"), [(1, False), (2, False), (3, False), (4, True), (None, False)]),
    "urls": (lambda d: feeds.url_inventory(d.select(F.col("g").alias("url")), d.select(F.lit("").alias("url"))), ("url",), [("a",), ("b",)]),
    "suffix": (lambda d: d.where(resolve.has_suffix(F.col("g"), "a")), ("k",), [(1,), (2,)]),
    "type_since": (lambda d: d.where(resolve.type_since(F.col("g"), "b", F.col("d"), dt.date(2024, 2, 1))), ("k",), [(4,), (4,)]),
    "amenity": (lambda d: d.select("k", resolve.amenity(F.col("g"), ["a"], F.when(F.col("v") > 6, F.lit("food"))).alias("x")).distinct(), ("k", "x"), [(1, "a"), (2, "a"), (3, "shop_food"), (4, "shop_food"), (None, None)]),
    "targets": (lambda d: resolve.select_targets(d, d.where("k = 1"), "k", d.where("v = 7"), "g", F.col("v").isNotNull()), ("k",), [(4,), (4,), (None,)]),
    "not_done": (lambda d: resolve.not_done(d, d.where("g = 'b'"), "k"), ("k",), [(1,), (2,), (3,), (None,)]),
    "regressions": (lambda d: resolve.regressions(d, d.where("k = 3"), "k", d.where("k = 1"), "g"), ("k",), [(1,), (2,), (3,)]),
    "annotate": (lambda d: resolve.annotate_counts(d, d.where("v = 7"), "g", "n").distinct(), ("k", "n"), [(1, 0), (2, 0), (3, 0), (4, 2), (None, 2)]),
    "rollup": (lambda d: agg.with_grand_total(d, "g", n=F.count(F.lit(1))), ("g", "n"), [("a", 2), ("b", 3), (None, 1), (None, 6)]),
    "closure": (lambda d: agg.closure_index(d, "g", "d", DAY, 1), ("g", "active", "closed90", "rate"), [("a", 1, 1, 100.0), ("b", 0, 3, None), (None, 0, 0, None)]),
    "openings": (lambda d: agg.openings_index(d, F.array("g", "g"), "d", DAY), ("label", "n365", "n30"), [("a", 1, 1), ("b", 3, 2)]),
    "permits": (lambda d: agg.permit_rollup(d.select("k").distinct(), d, "k", "v", "d", DAY, 40), ("k", "permits", "value"), [(1, 1, 5.0), (2, 0, 0.0), (3, 0, 0.0), (4, 2, 14.0), (None, 0, 0.0)]),
    "signals": (lambda d: agg.signal_stats(d, d.where("k < 4"), "g", "k"), ("g", "total", "matched", "parcels"), [("a", 2, 2, 2), ("b", 3, 0, 0), (None, 1, 1, 1)]),
    "share": (lambda d: agg.weighted_share(d, "g", "v", F.col("k") == 4), ("g", "share"), [("a", 30.0), ("b", 107.692308), (None, 30.0)]),
    "names": (lambda d: agg.repeated_names(d, F.upper("g"), "k"), ("brand", "n", "first_id"), [("A", 2, 1), ("B", 3, 4)]),
    "strictest": (lambda d: agg.strictest(d, "k", "g", ["b", "a"]).where("k IN (1, 4)"), ("k", "g"), [(1, "a"), (4, "b")]),
    "attached": (lambda d: agg.attached_kind(d, "g", "k"), ("g", "kind"), [("a", "semi"), ("b", None), (None, None)]),
    "drift": (lambda d: agg.drift(d.where("g IS NOT NULL"), "g", d.where("g = 'b'"), 5), ("g", "n"), [("a", 2)]),
    "per_hundred": (lambda d: agg.per_hundred(d, "g", F.col("v") > 6), ("g", "per_100"), [("a", 0.0), ("b", 66.666667), (None, 100.0)]),
    "distribution": (lambda d: agg.distribution(d, "g"), ("g", "n", "share"), [("a", 2, 0.333333), ("b", 3, 0.5), (None, 1, 0.166667)]),
    "paired": (lambda d: agg.paired(d, "k", "g", ("a", "b"), "v").where("k = 4"), ("k", "paired"), [(4, 0.0)]),
    "builders": (lambda d: agg.builder_activity(d, "g"), ("g", "bucket"), [("a", "2-3"), ("b", "2-3"), (None, "1")]),
    "ledger": (lambda d: agg.ledger_rollup(d, "g", "k", "d", "v").where("g IS NULL AND k IS NULL AND d IS NULL"), ("cost", "calls"), [(25.0, 6), (7.0, 1), (None, 1)]),
    "cumulative": (lambda d: agg.cumulative_share(d.where("g = 'a'"), "g", "k", F.coalesce("v", F.lit(0.0))), ("k", "share"), [(1, 1.0), (2, 1.0)]),
}


@pytest.mark.parametrize("name", sorted(CALLS))
def test_operator(df, name):
    call, cols, want = CALLS[name]
    assert values(call(df), *cols) == sorted(want, key=str)
    empty = call(df.limit(0)).collect()
    assert len(empty) <= 1  # a grand total may stand alone


def test_verification_merge_and_aliases(spark):
    df = spark.createDataFrame([("a",), ("b",), ("c",), ("d",), (None,)], "k string")
    places = spark.createDataFrame([("a", "OPERATIONAL", "s1"), ("b", "CLOSED", "s2"), ("c", "OPERATIONAL", "bad"), ("d", None, "s4")], "k string, status string, site string")
    web = spark.createDataFrame([("a", "w1"), ("d", "w4")], "k string, site string")
    bad = spark.createDataFrame([("bad",), ("bad",), (None,)], "site string")
    got = values(resolve.verification_merge(df, places, web, bad, "k"), "k", "via", "site")
    assert got == sorted([("a", "places", "s1"), ("c", "places", None), ("d", "web", "w4"), (None, None, None)], key=str)
    alias = spark.createDataFrame([("old", "a")], "name string, canon string")
    table = spark.createDataFrame([("a", 1), ("b", 2)], "name string, x int")
    named = spark.createDataFrame([(1, "old"), (2, "b"), (3, "zz"), (4, None)], "i int, n string")
    assert values(resolve.by_alias(named, "n", alias, table, "x"), "i", "x") == [(1, 1), (2, 2), (3, None), (4, None)]


def test_weak_match_and_crosscheck(spark):
    flags = spark.createDataFrame([(1, True, True, True, "w"), (2, True, False, False, "w"), (3, None, None, None, "x"), (4, False, True, True, "w")], "k int, a boolean, b boolean, c boolean, t string")
    weak = flags.where(resolve.weak_match(F.col("a"), F.col("b"), F.col("c"), F.col("t"), "w"))
    assert values(weak, "k") == [(1,), (3,)]
    claims = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 3.0), (4, None)], "k int, claim double")
    fresh = spark.createDataFrame([(1, 1.0), (2, 2.5), (4, 4.0)], "k int, value double")
    assert values(resolve.crosscheck(claims, fresh, "k", 0.01), "checked", "wrong", "missing") == [(3, 2, 1)]
    assert resolve.crosscheck(claims, fresh, "k", 0.01, sample=2, seed="s").first().asDict() == resolve.crosscheck(claims, fresh, "k", 0.01, sample=2, seed="s").first().asDict()


def test_first_unused_pick(spark):
    a = spark.createDataFrame([(1, 9.0), (2, 9.0), (None, 10.0)], "k int, v double")
    assert feeds.first_unused([a, a, a], "k", [F.desc("v"), F.col("k")]) == [1, 2, None]


def test_clipped_length_with_holes_and_bent_lines(spark):
    square = lambda a, b: geo.points([(a, a), (b, a), (b, b), (a, b)])
    areas = spark.range(1).select(F.lit(1).alias("area"), F.array(square(0.0, 0.03), square(0.01, 0.02)).alias("shape"))
    areas = areas.unionByName(spark.range(1).select(F.lit(2).alias("area"), F.array(square(5.0, 6.0)).alias("shape")))
    lines = spark.range(1).select(F.array(geo.points([(-0.01, 0.015), (0.04, 0.015)]), geo.points([(0.005, 0.001), (0.005, 0.002), (0.005, 0.004)]), geo.points([(0.001, 0.001)])).alias("parts"))
    got = {r.area: r.length_m for r in spatial.clipped_length(lines, areas, "parts", "area", "shape").collect()}
    degree = geo.EARTH_M * 3.141592653589793 / 180
    assert got[2] == 0.0 and got[1] == pytest.approx(0.02 * degree + 0.003 * degree, rel=1e-5)
    assert spatial.clipped_length(lines.limit(0), areas, "parts", "area", "shape").agg(F.sum("length_m")).first()[0] == 0.0


def test_intersection_clusters_count_distinct_lines(spark):
    end = lambda x, y: geo.points([(x, y), (x + 1, y + 1)])
    lines = spark.range(3).select("id", F.array(end(0.001, 0.001), end(0.0015, 0.0012)).alias("parts")).unionByName(spark.range(1).select(F.lit(9).cast("long").alias("id"), F.array(F.array().cast("array<struct<x: double, y: double>>")).alias("parts")))
    got = values(spatial.intersection_clusters(lines, "id", "parts", 0.01), "lines")
    assert got == [(3,), (3,)]


def test_pairs_of_large_and_small_boxes_and_points_near_the_pole(spark):
    small = spark.createDataFrame([(i, 0.001 * i) for i in range(50)], "k int, x double").select("k", geo.box_polygon(F.col("x"), F.lit(0.0), 0.0005, 0.0005).alias("a"))
    large = spark.range(1).select(F.lit(1).alias("n"), geo.box_polygon(F.lit(-20.0), F.lit(-20.0), 40.0, 40.0).alias("b"))
    assert spatial.polygon_pairs(small, large, "a", "b").count() == 50
    assert spatial.polygon_pairs(large, small, "b", "a").count() == 50
    pole = spark.createDataFrame([(1, 10.0, 84.0), (2, 10.08, 84.0), (3, 10.0, 84.009), (4, 10.2, 84.0)], "k int, x double, y double")
    other = pole.select(F.col("k").alias("o"), F.col("x").alias("ox"), F.col("y").alias("oy"))
    got = {(r.k, r.o) for r in spatial.within_radius(pole, other, "x", "y", "ox", "oy", 1100.0).collect()}
    brute = {(a.k, b.o) for a in pole.collect() for b in other.collect() if spark.range(1).select(geo.haversine(*map(F.lit, (a.x, a.y, b.ox, b.oy))).alias("d")).first().d <= 1100.0}
    assert got == brute and len(got) > 4


def test_profile_counts_exactly_only_columns_with_few_values(spark):
    rows = [(i, "a", None, i % 400 != 0, i % 14, i % 15, True if i % 2 else None) for i in range(2000)]
    df = spark.createDataFrame(rows, "many int, same string, nothing int, usual boolean, few int, enough int, flag boolean")
    got = {r.column: (r.nulls, r.distinct, r.finding, r.severity) for r in agg.profile(df, df.columns, {"same": "a", "flag": True}).collect()}
    assert got == {
        "many": (0, None, None, None), "same": (0, 1, "constant", "LOW"), "nothing": (2000, 0, "null", "HIGH"), "usual": (0, 2, "near_constant", "MEDIUM"),
        "few": (0, 14, "few", "MEDIUM"), "enough": (0, None, None, None), "flag": (1000, 1, "constant", "LOW"),
    }
    assert [r.finding for r in agg.profile(df.where("false"), ["many", "usual"]).collect()] == [None, None]


def test_mixed_types(spark):
    df = spark.createDataFrame([("true",), (" 1.5e3",), ("-2",), ('"x"',), ("[1]",), ('{"a": 1}',), ("null",), (None,), ("x",), ("01",)], "v string")
    assert values(agg.mixed_types(df, "v"), "kind", "n") == [("array", 1), ("boolean", 1), ("number", 2), ("object", 1), ("text", 1)]


def test_category_ages_and_envelopes(spark):
    df = spark.createDataFrame([("x", "a", dt.date(2000, 1, 1)), ("x", "a", dt.date(2020, 1, 1)), ("x", "b", dt.date(2012, 1, 1)), ("y", "b", None)], "g string, c string, d date")
    got = {r.g: (r.n, r.n_10y, r.n_20y, r.by_category, r.by_category_20y) for r in agg.category_ages(df, "g", "c", "d", dt.date(2024, 1, 1)).collect()}
    assert got == {"x": (3, 2, 1, {"a": 2, "b": 1}, {"a": 1}), "y": (1, 0, 0, {"b": 1}, {})}
    lots = spark.createDataFrame([("x", 100.0, 0.5, 6.0, 9.0), ("x", 100.0, 0.1, 0.0, 1.0)], "g string, lot_m2 double, coverage double, height_m double, v double")
    r = agg.envelope_measures(lots, "g", cost="v").first()
    assert (r.storeys, r.existing_gfa, r.existing_fsi, r.unused_gfa, r.unused_fsi, r.value, r.co2_kg, r.cost) == (2, 110.0, 0.55, 50.0, 0.25, 200_000.0, 1250.0, 10.0)


def test_floor_and_invariants_fail_loudly(spark):
    from parcelflow.operators import quality

    n = spark.createDataFrame([("x", 3), ("y", None)], "g string, n int")
    assert quality.require_floor(n.where("g = 'x'"), "g", "n", 3).count() == 1
    with pytest.raises(quality.ContractError, match="y"):
        quality.require_floor(n, "g", "n", 3)
    with pytest.raises(quality.ContractError, match="invariant"):
        quality.require_floor(n.where("g = 'x'"), "g", "n", 3, n)


def test_publishing_with_observed_metrics_reads_the_rows_once(spark, tmp_path):
    from parcelflow.operators import quality
    from parcelflow.sources import sinks

    path = str(tmp_path / "t")
    rules = {"missing": ("CRITICAL", F.col("v").isNull()), "low": ("LOW", F.col("v") < 2)}
    metrics, check = quality.observed(rules, least=2)
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    good = spark.createDataFrame([(i,) for i in range(5)], "v int").mapInArrow(count, "v int")
    assert sinks.publish_observed(good, path, metrics, check) == [("missing", "CRITICAL", 0), ("low", "LOW", 2)]
    assert seen.value == 5 and spark.read.parquet(path).count() == 5
    for bad in ([(1,), (None,)], [(1,)]):
        with pytest.raises(quality.ContractError):
            sinks.publish_observed(spark.createDataFrame(bad, "v int"), path, metrics, check)
    assert spark.read.parquet(path).count() == 5


def test_elite_gate_takes_every_condition(spark):
    from parcelflow.operators import parcels

    good = {
        "lot_m2": 300.0, "units": 4, "transit_m": 400.0, "residential": True, "abuts_lane": False, "to_street_m": 20.0, "suspect": False, "recent_permits": 0, "drift": None, "address_points": 1,
        "units_approx": 2, "structure_type": "detached", "structure_source": "classifier", "height_m": 8.0, "coverage": 0.3,
    }
    bad = [
        {"lot_m2": 249.0}, {"units": 3}, {"transit_m": 501.0}, {"residential": None}, {"abuts_lane": True}, {"suspect": True}, {"recent_permits": 1}, {"drift": True},
        {"address_points": 2}, {"structure_type": "semi"}, {"structure_source": None}, {"height_m": 12.0}, {"structure_type": None},
        {"height_m": 14.0, "units_approx": 10, "structure_type": "vacant"},
    ]
    fine = [{}, {"abuts_lane": True, "to_street_m": 14.0}, {"structure_type": "vacant", "structure_source": None, "height_m": 12.0}, {"structure_source": "osm", "address_points": 3}]
    schema = "lot_m2 double, units int, transit_m double, residential boolean, abuts_lane boolean, to_street_m double, suspect boolean, recent_permits int, drift boolean, address_points int, units_approx int, structure_type string, structure_source string, height_m double, coverage double, at int"
    df = spark.createDataFrame([tuple({**good, **x}.values()) + (i,) for i, x in enumerate(bad + fine)], schema)
    assert [r.at for r in df.where(parcels.elite_gate()).orderBy("at").collect()] == list(range(len(bad), len(bad) + len(fine)))


def test_places_of_one_name_and_address_are_compared_as_one(spark):
    from parcelflow.operators import matching

    names = ["red blue", "red", "green", "green blue red"]
    rows = [(i, names[i % 4].split(), "S", 1, 10.0, 50.0) for i in range(400)] + [(400, ["grey"], "S", 1, 10.0, 50.0), (401, ["red"], None, 1, 30.0, 10.0)]
    p = spark.createDataFrame(rows, "k long, w array<string>, st string, no int, x double, y double")
    asked, words = p.select("k", F.col("w").alias("_aw"), F.col("st").alias("_st"), F.col("no").alias("_no")), p.select(F.col("k").alias("_cand"), F.col("w").alias("_bw"), F.col("st").alias("_st"), F.col("no").alias("_no"))
    best = {r.k: r["_cand"] for r in matching._best_by_class(asked, words, "k", 0.25, True).collect()}
    assert best == {i: (i % 4 if i >= 4 else i + 4) for i in range(400)}
    got = {r.k: (r.c, r.via) for r in matching.match_places(p, p.withColumnRenamed("k", "c"), "k", "w", "st", "no", "x", "y", "c", other=True).collect()}
    assert got == {k: (c, "address") for k, c in best.items()}
