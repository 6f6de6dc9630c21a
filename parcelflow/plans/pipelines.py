"""Composed pipelines: openings feed and index, area dataset, closures, parcel features and tiers, signals, scores."""

from __future__ import annotations

import datetime as dt
import math
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import dates, geo, keys, mathx, text
from ..operators import aggregates as agg
from ..operators import feeds, parcels, quality, resolve, spatial
from ..streaming import ledger, state


def openings_feed(licences: DataFrame, categories: Sequence[str], as_of: dt.date, rules, brands: DataFrame, verdicts: DataFrame, places: DataFrame, web: DataFrame, bad_links: DataFrame) -> DataFrame:
    """Licences (id, name, category, issued, cancelled, address, postal, website) of the last year in the categories, still
    active (P01-P03), no chain brand (J26), the earliest of each name and address (F03, W02), labelled by web verdict or name
    (J30), merged with what places and the web say of them (J31), without weak matches (P26).

    verdicts: (key, labels, status, operating); places: (key, status, site); web: (key, site); bad_links: (site)."""
    df = licences.where(resolve.in_category("category", categories) & resolve.active_with_grace(F.col("cancelled"), as_of) & resolve.trailing("issued", as_of, 365) & (F.col("issued") <= F.lit(as_of)))
    df = resolve.anti_brands(df, "name", brands).withColumn("key", keys.entity_key(F.col("name"), F.col("address")))
    df = agg.keep_first(df, ["key"], F.col("issued"), F.col("id"))
    named = df.select("key", F.array_compact(F.array(keys.keyword_label(F.col("name"), rules))).alias("labels"))
    df = resolve.resolve_labels(df, verdicts, named, [label for label, _ in rules], "key")
    df = resolve.verification_merge(df, places, web, bad_links, "key")
    no_site = F.coalesce("site", "website").isNull()
    df = df.where(~resolve.weak_match(F.col("via").isNull(), F.col("website").isNull(), no_site, F.col("label_source"), "name"))
    return df.select(
        "id", "key", F.element_at("labels", 1).alias("label"), "labels", "label_source", "via", F.coalesce("site", "website").alias("site"), "issued", keys.district(F.col("postal")).alias("district"),
        keys.slug(F.col("name"), F.col("address")).alias("slug"), dates.days_open(F.col("issued"), as_of).alias("days_open"), keys.website_tier(F.coalesce("site", "website")).alias("tier"))


def openings_tables(feed: DataFrame, known: DataFrame, newest: int = 20) -> DataFrame:
    """(part, label, district, n, n30): counts of every label and district and all of them (A43; absent axes are null), the
    ``newest`` openings in order (T01: n is their place), the labels that stay in the dimension (U05: n30 tells whether
    seeded) and labels of openings that the known ones lack (Q10).

    known: (key, seeded)."""
    none = F.lit(None).cast("string")
    n30 = F.count_if(F.col("days_open") <= 30)
    cube = feed.cube("label", "district").agg(F.count(F.lit(1)).alias("n"), n30.alias("n30")).select(F.lit("count").alias("part"), "label", "district", "n", "n30")
    top = feeds.newest(feed, "issued", "id", newest)
    place = F.row_number().over(W.partitionBy().orderBy(F.desc("issued"), "id"))  # after the limit
    top = top.select(F.lit("newest").alias("part"), "label", "district", place.cast("long").alias("n"), F.lit(0).cast("long").alias("n30"))
    used = feed.select(F.explode("labels").alias("key"))
    kept = feeds.prune(known, used, "key", "seeded").select(F.lit("dimension").alias("part"), F.col("key").alias("label"), none.alias("district"), F.lit(0).cast("long").alias("n"), F.col("seeded").cast("long").alias("n30"))
    gaps = used.join(known.select("key"), "key", "left_anti").groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    gaps = gaps.select(F.lit("gap").alias("part"), F.col("key").alias("label"), none.alias("district"), "n", F.lit(0).cast("long").alias("n30"))
    return cube.unionByName(top).unionByName(kept).unionByName(gaps)


def openings_index(feed: DataFrame, as_of: dt.date, newest: int = 3) -> DataFrame:
    """Per label the openings of the year and of the last 30 days, the newest date and the newest few ids."""
    n = feed.groupBy("label").agg(F.count(F.lit(1)).alias("n365"), F.count_if(F.col("days_open") <= 30).alias("n30"), F.max("issued").alias("newest"))
    order = feed.withColumn("_o", F.struct((-F.unix_date("issued")).alias("d"), "id"))
    top = agg.first_n(order, ["label"], [F.col("_o")], newest).groupBy("label").agg(F.array_join(F.transform(F.array_sort(F.collect_list("_o")), lambda x: x["id"].cast("string")), ",").alias("newest_ids"))
    return n.join(top, "label")


def area_dataset(areas: DataFrame, points: DataFrame, shape: str) -> DataFrame:
    """Per area the points inside, their total and mean value, a 0-100 risk index and its rank.

    areas: (area, shape); points: (k, x, y, v).  A point counts in every area that contains it."""
    inside = spatial.points_in_polygons(points, areas.select("area", shape), "x", "y", shape)
    n = inside.groupBy("area").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("total"), F.count_if(F.col("v") < 0).alias("low"))
    n = agg.with_zero_rows(areas, n, "area", ["n", "total", "low"])
    n = n.withColumns({"low_rate": mathx.pct(F.col("low"), F.greatest("n", F.lit(1)), 4), "mean": F.try_divide("total", "n")})
    n = n.withColumns({"a": mathx.minmax(F.col("low_rate")), "b": mathx.minmax(F.col("n").cast("double"), invert=True), "c": mathx.minmax(F.col("mean"))})
    n = n.withColumn("risk", mathx.composite(F.col("a"), F.col("b"), F.col("c")))
    return feeds.ranked(n, {"risk": True}, "area").select("area", "n", "total", "low_rate", "risk", "rank_risk")


def closures(licences: DataFrame, rules, as_of: dt.date, least: int = 20, longest: int = 10) -> DataFrame:
    """(part, label, id, active, closed90, closed365, rate): the closing index of every label (F16, A07) and the licences of
    the longest running businesses, one for each name (W03, T02: active is their days).

    licences: id, name, issued, cancelled."""
    df = licences.withColumn("label", keys.keyword_label(F.col("name"), rules)).where("label IS NOT NULL")
    none = F.lit(None).cast("long")
    index = agg.closure_index(df, "label", "cancelled", as_of, least).select(F.lit("index").alias("part"), "label", none.alias("id"), "active", "closed90", "closed365", "rate")
    oldest = agg.keep_first(df.where(resolve.active_with_grace(F.col("cancelled"), as_of)), ["name"], F.col("issued"), F.col("id")).withColumn("days", dates.days_open(F.col("issued"), as_of).cast("long"))
    feed = feeds.largest(oldest, F.col("days"), "id", longest)
    return index.unionByName(feed.select(F.lit("longest").alias("part"), "label", F.col("id").cast("long").alias("id"), F.col("days").alias("active"), none.alias("closed90"), none.alias("closed365"), F.lit(None).cast("double").alias("rate")))


def parcel_features(lots: DataFrame, hoods: DataFrame, stops: DataFrame, permits: DataFrame) -> DataFrame:
    """Lots (lot_id, x, y, lot_m2, ...) with their area, the nearest stop, permits within 250 m, and the first gate they fail."""
    hood = spatial.first_polygon(lots, hoods.withColumn("_o", F.col("area")), "lot_id", "x", "y", "shape", "area", "_o")
    stop = spatial.nearest(lots, stops, "lot_id", "x", "y", "stop_id", "sx", "sy", 5000.0, label="stop_id").withColumnRenamed("dist_m", "stop_m")
    near = spatial.within_radius(lots.select("lot_id", "x", "y"), permits, "x", "y", "px", "py", 250.0)
    near = near.groupBy("lot_id").agg(F.count(F.lit(1)).alias("near_permits"))
    df = lots.join(hood, "lot_id", "left").join(stop, "lot_id", "left").join(near, "lot_id", "left").fillna(0, ["near_permits"])
    ok = parcels.eligible(F.col("kind") != "PROMO", F.col("heritage"), F.col("stop_m"), F.col("lot_m2"))
    gates = [("no_area", F.col("area").isNull()), ("tall", F.col("height_m") > 14), ("not_eligible", ~ok), ("non_buildable", F.col("units") == 0)]
    return df.withColumn("skip_reason", resolve.waterfall(gates))


def parcel_surroundings(lots: DataFrame, streets: DataFrame, buildings: DataFrame, addresses: DataFrame, reach: float, size: float = spatial.CELL) -> DataFrame:
    """(lot_id, corner, lane, street_m, aspect, coverage, bare, points, addresses) of lots as polygons.

    corner: two named streets within ``reach`` of the boundary (J13), lane: a lane is (J14), street_m: distance of the lot's
    point to the nearest street (J16), aspect: long over short side of the smallest rectangle (G07), coverage and bare: shares of
    the lot under the union of all footprints and outside it (J12), points and addresses: address points inside and their
    distinct addresses (J06, A33).

    lots: lot_id, shape, x, y; streets: line, name, is_lane; buildings: footprint; addresses: x, y, address."""
    is_lane = F.coalesce("is_lane", F.lit(False))
    named = streets.withColumn("_name", F.when(is_lane, "lane").otherwise(F.concat(F.lit("street "), F.col("name").cast("string"))))
    touched = spatial.names_touched(lots, named, "lot_id", "shape", "line", "_name", reach)
    ways = touched.groupBy("lot_id").agg((F.count_if(F.col("_name") != "lane") >= 2).alias("corner"), F.max(F.col("_name") == "lane").alias("lane"))
    street = spatial.nearest_line(lots, named.where("_name <> 'lane'"), "lot_id", "x", "y", "line").withColumnRenamed("dist_m", "street_m")
    out = spatial._dealt_evenly(lots.select("lot_id", "shape"), "lot_id").select("lot_id", geo.min_rotated_rect(F.col("shape")[0])["aspect"].alias("aspect"), spatial.polygon_area(F.col("shape")).alias("_whole"))
    built = spatial.union_coverage(lots, buildings, "lot_id", "shape", "footprint", size)
    # cells as wide as a lot: in wider ones every address of a block would meet every lot of it
    wide = min(spatial._mean_box(lots, "shape")[1] / 2, spatial.CELL) or spatial.CELL
    inside = spatial.points_in_polygons(addresses.select(F.col("x").alias("_px"), F.col("y").alias("_py"), "address"), lots.select("lot_id", "shape"), "_px", "_py", "shape", wide)
    inside = inside.groupBy("lot_id").agg(F.count("*").alias("points"), F.countDistinct("address").alias("addresses"))
    for part in (ways, street, built, inside):
        out = out.join(spatial._many(part), "lot_id", "left")
    out = out.fillna(False, ["corner", "lane"])
    share = lambda c: F.least(F.coalesce(F.try_divide(c, F.col("_whole")), F.lit(0.0)), F.lit(1.0)).alias(c)
    return out.select("lot_id", "corner", "lane", "street_m", "aspect", share("covered"), share("bare"), F.coalesce("points", F.lit(0)).alias("points"), F.coalesce("addresses", F.lit(0)).alias("addresses")).withColumnRenamed("covered", "coverage")


def parcel_stats(features: DataFrame, permits: DataFrame, least: int = 5, largest: int = 10) -> DataFrame:
    """(part, name, n, value): the funnel by first failed gate with its median value (A34), median value of a square metre by
    kind where enough lots have one (A15), lots without a permit (A35) and the largest lots (T03).

    features: lot_id, kind, lot_m2, value, skip_reason; permits: lot_id."""
    none = F.lit(None).cast("double")
    funnel = features.groupBy(F.coalesce("skip_reason", F.lit("kept")).alias("name")).agg(F.count(F.lit(1)).alias("n"), F.median("value").alias("value"))
    cost = agg.median_if(features.withColumn("cost", F.try_divide("value", "lot_m2")), "kind", "cost", least)
    alone = agg.unjoined(features, permits, "lot_id")
    top = feeds.largest(features, F.col("lot_m2"), "lot_id", largest)
    parts = [
        funnel.select(F.lit("funnel").alias("part"), "name", "n", "value"), cost.select(F.lit("cost").alias("part"), F.col("kind").alias("name"), "n", F.col("median").alias("value")),
        alone.select(F.lit("unjoined").alias("part"), F.lit("permits").alias("name"), F.col("unjoined").alias("n"), none.alias("value")),
        top.select(F.lit("largest").alias("part"), F.col("lot_id").cast("string").alias("name"), F.lit(1).cast("long").alias("n"), F.col("lot_m2").alias("value")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def tiers(lots: DataFrame, listed: DataFrame) -> DataFrame:
    """Elite and broader tier of the lots that pass the shared gates."""
    df = lots.withColumn("footprint", F.col("lot_m2") * F.col("coverage"))
    df = parcels.wealth_gate(df.where(parcels.shared_gate()), listed, enclaves=[4, 9], estate_lot=700, mansion_floor=400, max_value=1850)
    tier = F.when(parcels.elite_gate(), "elite").when(parcels.broader_gate(["SMALL", "MEDIUM", "STANDARD"]), "broader")
    return df.withColumn("tier", tier).where("tier IS NOT NULL")


def signals(parcels_: DataFrame, events: DataFrame, kinds: Sequence[str], since: dt.date) -> tuple[DataFrame, DataFrame]:
    """(the newest event of each parcel and kind with the number of further ones and how busy its builder is; total,
    matched and unmatched events of each kind).

    Events are of the wanted kinds since a day (P14, U02), each once; they find parcels by address (J01) and builders are
    counted over all of them (A19, A20, A21).  parcels_: parcel_id, addr_norm; events: event_id, kind, at, builder, addr_norm."""
    # every wanted kind is a filter of its own
    wanted = feeds.any_filter(events, "event_id", *[resolve.type_since(F.col("kind"), k, F.col("at"), since) for k in kinds])
    chosen = events.join(wanted, "event_id", "left_semi").dropDuplicates(["event_id"])
    busy = agg.builder_activity(chosen, "builder").select("builder", "bucket")
    joined = resolve.join_key(chosen, parcels_.select("parcel_id", "addr_norm"), "addr_norm").join(busy, "builder")
    latest = agg.latest_per_key(joined, ["parcel_id", "kind"], [F.col("at"), F.col("event_id")], ["event_id", "bucket"])
    return latest, agg.signal_stats(chosen, parcels_, "kind", "addr_norm")


def overlay_signals(parcels_: DataFrame, appeals: DataFrame, orders: DataFrame, suffix: str, statuses: Mapping[str, int], not_in: str) -> DataFrame:
    """(parcel_id, appeal_id, order_id, severity) of the parcels with an appeal or an order.

    Appeals are those whose number ends in ``suffix`` (P12), the first one of each address (J02).  Orders are of one of the
    ``statuses`` and their text does not hold what ``not_in`` matches (P13); of an address the gravest, then the first.

    parcels_: parcel_id, addr_norm; appeals: appeal_id, number, addr_norm; orders: order_id, status, text, addr_norm."""
    some = F.col("addr_norm").isNotNull() & (F.col("addr_norm") != "")
    a = resolve.first_per_key(appeals.where(resolve.has_suffix(F.col("number"), suffix) & some), "addr_norm", "appeal_id", "appeal_id")
    grave = orders.where(F.col("status").isin(*statuses) & ~F.coalesce(F.lower("text").rlike(not_in), F.lit(False)) & some)
    grave = grave.withColumn("severity", keys.lookup({k: str(v) for k, v in statuses.items()}, F.col("status")).cast("int"))
    o = grave.groupBy("addr_norm").agg(F.max_by(F.struct("order_id", "severity"), F.struct("severity", -F.col("order_id"))).alias("_o"))
    out = parcels_.select("parcel_id", "addr_norm").join(a, "addr_norm", "left").join(o, "addr_norm", "left").where("appeal_id IS NOT NULL OR _o IS NOT NULL")
    return out.select("parcel_id", "appeal_id", "_o.order_id", "_o.severity")


def usage_rollup(ledger_path: str, spark, prices: DataFrame, read) -> DataFrame:
    """Cost and calls by provider, by provider and sku, by day and in all (A31), of a ledger of JSON lines that may be
    broken (S07); skus without a price cost nothing.

    prices: (sku, price); read(spark, path, schema) reads the lines."""
    lines = read(spark, ledger_path, "event_id long, provider long, sku string, at timestamp, units double").where("event_id IS NOT NULL")
    priced = lines.join(F.broadcast(prices), "sku", "left").withColumn("cost", F.col("units") * F.coalesce("price", F.lit(0.0)))  # a price table of a few dozen rows
    return agg.ledger_rollup(priced.withColumn("day", F.to_date("at")), "provider", "sku", "day", "cost")


def usage_stream(lines: DataFrame, prices: DataFrame, late: str) -> DataFrame:
    """C10, as a stream: cost and calls by day and sku (X01) of a stream of ledger lines (value), tolerant of broken ones.

    A line counts if it is an object with an event_id and a time; skus without a price cost nothing.  Days are final when the
    watermark, ``late`` behind the newest line, has passed them.  prices: (sku, price), a static table of a few dozen rows."""
    entry = F.from_json("value", "event_id long, sku string, at timestamp, units double")
    rows = lines.select(entry.alias("e")).select("e.*").where("event_id IS NOT NULL AND at IS NOT NULL")
    priced = rows.join(F.broadcast(prices), "sku", "left").withColumn("cost", F.coalesce("units", F.lit(0.0)) * F.coalesce("price", F.lit(0.0)))
    return ledger.daily_costs(priced, "at", "sku", "cost", late=late)


def neighbourhood_scores(areas: DataFrame, points: DataFrame, streets: DataFrame, stops: DataFrame, lots: DataFrame, per_lot: DataFrame, brackets: DataFrame, households: DataFrame, permits: DataFrame, weights: dict[str, float]) -> DataFrame:
    """The inputs and the weighted score (M05) of every area.

    solar: share of points at or above the 75th percentile (A22); canopy: weighted share of one kind of lot (A23); walk:
    street corners inside by area (A26, J05, A24); bike: metres of street inside (A27, A24); transit: stops inside by area
    (J06, A24); existing and potential units (A28); built year: median bracket (A13); permits for 1000 households (A29).
    areas: (area, shape, km2); points: (area, v); streets: (line, parts); stops: (x, y); lots: (area, kind, lot_m2, units);
    brackets: (area, year, mid, c); households: (household, area); permits: (household).  Areas without data get 0, 50 for
    solar and 30 for canopy."""
    all_ = areas.select("area")

    def by_density(counts: DataFrame) -> DataFrame:
        n = areas.select("area", "km2").join(counts, "area", "left").fillna(0, ["n"])
        return agg.density_score(n.withColumn("density", F.col("n") / F.col("km2")), "area", "density")

    def inside(p: DataFrame) -> DataFrame:
        return spatial.points_in_polygons(p, areas.select("area", "shape"), "x", "y", "shape").groupBy("area").agg(F.count(F.lit(1)).alias("n"))

    solar = agg.share_above(points, "area", "v", agg.nearest_rank(points, "v", 0.75), areas=all_).withColumnRenamed("share", "solar")
    canopy = agg.weighted_share(lots, "area", "lot_m2", F.col("kind") == "SMALL").withColumnRenamed("share", "canopy")
    walk = by_density(inside(spatial.intersection_clusters(streets, "line", "parts", 0.02).select("x", "y"))).withColumnRenamed("score", "walk")
    bike = agg.density_score(spatial.clipped_length(streets, areas, "parts", "area", "shape"), "area", "length_m").withColumnRenamed("score", "bike")
    transit = by_density(inside(stops)).withColumnRenamed("score", "transit")
    units = agg.capacity(lots, "area", "kind", per_lot, "units", 7).withColumnRenamed("capacity", "potential").join(lots.groupBy("area").agg(F.sum("units").alias("existing")), "area")
    built = agg.median_bracket(brackets, "area", "year", "mid", "c").withColumnRenamed("median_mid", "built_year")
    rate = agg.rate_per(households, permits, "household", "area", 1000.0, "permits_per_1000")
    out = all_
    for part in (solar, canopy, walk, bike, transit, units, built, rate):
        out = out.join(part, "area", "left")
    out = out.fillna(30.0, ["canopy"]).fillna(0.0, ["walk", "bike", "transit", "permits_per_1000"]).fillna(0, ["existing", "potential"])
    score = mathx.weighted_score({k: F.col(k) for k in ("solar", "canopy", "walk", "transit", "bike")}, weights, F.col("existing").cast("double"), F.col("potential").cast("double"), 4)
    return out.withColumn("score", score)


def audits(lots: DataFrame, claims: DataFrame, fresh: DataFrame, reference: DataFrame, bad_ids: DataFrame, bad_groups: DataFrame, truth: DataFrame, tiers_: DataFrame) -> DataFrame:
    """C11: one table (rule, severity, n, severity_rank) of what the audits find, by severity (Q08).

    Row rules over the lots (Q04-Q07), lots that hold one value only in a column (A36), a name that more than a tenth of
    the lots share (A37), claims that a recomputation contradicts (J34), ids on one side only (J35), rows that were wrong
    before (J36), and true rows that reach no tier (A38).  All inputs have lot_id; claims: claim, fresh: value, truth: grp."""
    rules = {
        "coverage": ("CRITICAL", F.col("coverage") > 0.8), "units_need_height": ("HIGH", (F.col("units") > 6) & (F.col("height_m") == 0)),
        "height_range": ("MEDIUM", ~F.col("height_m").between(0.0, 14.0)), "kind_coupling": ("LOW", (F.col("kind") == "PROMO") & (F.col("units") > 0)),
    }
    found = quality.violations(lots, rules)
    row = lambda df, rule, severity, n: df.select(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), n.cast("long").alias("n"))
    constant = agg.profile(lots, ["kind", "heritage", "regulated", "units"]).agg(F.count_if(F.col("finding") == "constant").alias("n"))
    shared = agg.concentration(lots, "street", 1)
    compared = resolve.full_compare(lots, reference, "lot_id")
    again = resolve.regressions(lots, bad_ids, "lot_id", bad_groups, "street").agg(F.count(F.lit(1)).alias("n"))
    reach = agg.recall(truth, tiers_, "lot_id", "grp").where("grp IS NULL")
    parts = [
        row(constant, "constant_column", "MEDIUM", F.col("n")), row(shared, "concentration", "LOW", (F.col("top1_share") > 10).cast("int")),
        row(resolve.crosscheck(claims, fresh, "lot_id", 0.01), "crosscheck", "CRITICAL", F.col("wrong") + F.col("missing")),
        row(compared, "only_here", "HIGH", F.col("only_a")), row(compared, "only_there", "HIGH", F.col("only_b")),
        row(again, "regression", "CRITICAL", F.col("n")), row(reach, "missed_truth", "MEDIUM", F.col("n") - F.col("any_tier")),
    ]
    for p in parts:
        found = found.unionByName(p)
    return quality.report(found)


#: Fields that a verdict text may hold, and their types.
VERDICT_FIELDS = "operating string, labels array<string>, website_ok boolean, match_ok boolean, drop boolean"


def verdict_cycle(state_: DataFrame, answers: DataFrame, done: DataFrame, groups: DataFrame, now: dt.datetime) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(keys to ask about, the next state, the keys due a day later).

    The queue of keys that are due (X04), without those that are asked already and only of wanted groups (P30), meets the answer
    texts; each is read as JSON between its first and last brace (F27), unknown fields are left out, and a text that cannot be read
    is an error, which embargoes its key.  Verdicts are applied to the state (X03).

    state_: the verdict state; answers: (key, text); done: (key); groups: (operating)."""
    due = state.due_queue(state_, now).join(state_.select("key", "operating"), "key")
    asked = resolve.select_targets(due, done, "key", groups, "operating", F.lit(True)).select("key", "why")
    told = F.from_json(text.first_object(F.col("text")), VERDICT_FIELDS)
    verdicts = answers.join(asked.select("key"), "key", "left_semi").withColumn("_v", told)
    verdicts = verdicts.select("key", "_v.*", (F.col("_v").isNull() | (F.col("_v.operating").isNull() & F.col("_v.labels").isNull())).alias("error"))
    after = state.apply_verdicts(state_, verdicts, now)
    return asked, after, state.due_queue(after, now + dt.timedelta(days=1))


def insight_rows(areas: DataFrame, metrics: dict[str, tuple[str, bool]], lead: DataFrame, total: str) -> DataFrame:
    """For each metric in turn the best area that no earlier metric took (W08), the lead story (T06: area, value) and the
    grand total (A03).  areas: (area, metrics, total); a metric is (column, descending)."""
    lists = [areas.select("area", (F.col(c) * (-1 if down else 1)).cast("double").alias("_o")) for c, down in metrics.values()]
    picked = feeds.first_unused(lists, "area", [F.col("_o"), F.col("area")])
    out = lead.select(F.lit("lead").alias("finding"), "area", F.col("value").cast("double").alias("value"))
    for (name, (column, _)), area in zip(metrics.items(), picked):
        out = out.unionByName(areas.where(F.col("area") == area).select(F.lit(name).alias("finding"), "area", F.col(column).cast("double").alias("value")))
    grand = agg.with_grand_total(areas, "area", value=F.sum(total)).where("area IS NULL")
    return out.unionByName(grand.select(F.lit("total").alias("finding"), "area", F.col("value").cast("double").alias("value")))


def unshaded_share(lots: DataFrame, buildings: DataFrame, lot: str, building: str, height: str, suns: Sequence[tuple[float, float]], around: float = 75.0, most: int | None = None, swept: bool = True) -> DataFrame:
    """(lot_id, share, quality): share of the lot's area outside all shadows, meaned over sun positions (azimuth, elevation).

    Coordinates are metres.  Of the buildings ``around`` a lot's box (W12: the ``most`` nearest by centre, if given) those with a
    height shade their footprint swept along the shadow (or, not swept, the footprint and its copy at the shadow's end); the
    areas of the union are exact.  A footprint without area shades a disc and makes the share 'estimated'.  Lots beside
    buildings of which none has a height have a null share and are 'unavailable'; lots without a building are 1.0 and 'measured'.
    Footprints without a height or one above 0 shade nothing."""
    ring = F.col("_f")[0]
    middle = [F.aggregate(ring, F.lit(0.0), lambda t, p: t + p[c]) / F.size(ring) for c in "xy"]
    b = buildings.select(F.col(building).alias("_f"), F.col(height).cast("double").alias("_h")).where(F.size(ring) > 0)
    b = b.withColumns({"_mx": middle[0], "_my": middle[1], "_flat": F.abs(geo.signed_area(ring)) <= 0})
    near = spatial.polygon_pairs(lots.select("lot_id", F.col(lot).alias("_lot")), b, "_lot", "_f", size=max(100.0, around), pad=around)
    if most is not None:
        c = geo.centroid(F.col("_lot")[0])
        near = near.withColumn("_d", F.hypot(c["x"] - F.col("_mx"), c["y"] - F.col("_my"))).withColumn("_o", F.struct("_mx", "_my", "_h"))
        near = spatial.nearest_capped(near, "lot_id", "_d", "_o", most)
    tall = near.where("_h > 0")
    quality = near.groupBy("lot_id").agg(F.max(F.col("_h").isNotNull()).alias("_known"), F.max(F.col("_flat") & F.col("_h").isNotNull()).alias("_disc"))
    out = lots.select("lot_id", spatial.polygon_area(F.col(lot)).alias("_whole")).join(quality, "lot_id", "left")
    for i, (azimuth, elevation) in enumerate(suns):
        if elevation <= 0:
            raise ValueError("the sun is not above the horizon")
        reach = F.col("_h") / math.tan(math.radians(elevation))
        dx, dy = reach * -math.sin(math.radians(azimuth)), reach * -math.cos(math.radians(azimuth))  # the shadow points away from the sun
        pieces = F.when(F.col("_flat"), F.array(spatial.disc(F.col("_mx"), F.col("_my"), reach))).otherwise(spatial.shadow_pieces(F.col("_f"), dx, dy, swept))
        dark = spatial.covered_area(tall.select("lot_id", "_lot", F.explode(pieces).alias("_b")), "lot_id", "_lot", "_b", 1000.0)
        out = out.join(dark.withColumnRenamed("covered", f"_d{i}"), "lot_id", "left")
    free = [F.least(F.greatest(1 - F.coalesce(f"_d{i}", F.lit(0.0)) / F.col("_whole"), F.lit(0.0)), F.lit(1.0)) for i in range(len(suns))]
    mean = F.when(F.col("_whole") > 0, sum(free, F.lit(0.0)) / len(suns)).otherwise(1.0)
    lost = F.col("_known").isNotNull() & ~F.col("_known")
    return out.select("lot_id", F.when(lost, None).otherwise(mean).alias("share"), F.when(lost, "unavailable").when(F.col("_disc"), "estimated").otherwise("measured").alias("quality"))
