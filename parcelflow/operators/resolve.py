"""Entity resolution joins, label resolution and record filters; every column is a parameter."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import keys


def register_labels(known: DataFrame, seen: DataFrame) -> DataFrame:
    """known (key, label) and, for labels seen whose key is new, one row each; seeded tells them apart."""
    new = seen.select(keys.label_slug(F.col("label")).alias("key"), "label").where("key NOT IN ('', 'unknown')")
    new = new.join(known.select("key"), "key", "left_anti").groupBy("key").agg(F.min("label").alias("label"))
    return known.select("key", "label", F.lit(True).alias("seeded")).unionByName(new.select("key", "label", F.lit(False).alias("seeded")))


def in_category(col: str, values: Sequence[str]) -> Column:
    """P01."""
    return F.trim(F.col(col)).isin(*values)


def trailing(col: str, as_of: dt.date, days: int) -> Column:
    """Within the window; a null date is out."""
    return F.coalesce(F.col(col).cast("date") >= F.date_sub(F.lit(as_of), days), F.lit(False))


def active_with_grace(cancel: Column, as_of: dt.date, grace: int = 10) -> Column:
    """Not cancelled, or not more than ``grace`` days ago."""
    return cancel.isNull() | (F.datediff(F.lit(as_of), cancel) <= grace)


def never_cancelled(text: Column) -> Column:
    """The cancel text is blank."""
    return F.coalesce(F.trim(text), F.lit("")) == ""


def null_if_placeholder(c: Column) -> Column:
    """Blank and 'none' become null."""
    return F.when(~F.lower(F.trim(c)).isin("", "none"), F.trim(c))


def null_if_nonpositive(c: Column, kind: str = "double") -> Column:
    """Text that is no positive number becomes null."""
    x = c.try_cast(kind)
    return F.when(x > 0, x)


def map_closed_set(df: DataFrame, col: str, table: Mapping[str, str], out: str, unknown: str | None = None) -> DataFrame:
    """Value of a closed table for the trimmed upper-case text; unknown ones become ``unknown``."""
    return df.withColumn(out, F.coalesce(keys.lookup(table, F.upper(F.trim(F.col(col)))), F.lit(unknown)))


def rule_label(rules: Sequence[tuple[str, Column]]) -> Column:
    """The label of the first rule that holds, else null."""
    return F.coalesce(*[F.when(test, F.lit(label)) for label, test in rules])


def waterfall(reasons: Sequence[tuple[str, Column]]) -> Column:
    """The name of the first test that fires, else null."""
    return F.coalesce(*[F.when(F.coalesce(test, F.lit(False)), F.lit(name)) for name, test in reasons])


def rewrite_labels(labels: Column, table: Mapping[str, str], drop: str = "drop") -> Column:
    """Rewritten labels in order, each once, without those that the table drops."""
    return F.array_distinct(F.filter(F.transform(labels, lambda x: F.coalesce(keys.lookup(table, x), x)), lambda x: x != drop))


def join_key(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Equi-join on a key column that both sides have; blank keys never match."""
    right = right.where((F.col(key).isNotNull()) & (F.col(key) != ""))
    return left.join(right, key, how)


def first_per_key(df: DataFrame, key: str, value: str, ordinal: str, last: bool = False) -> DataFrame:
    """One value for each key, the first (or last) by ordinal."""
    pick = F.max_by if last else F.min_by
    return df.groupBy(key).agg(pick(value, ordinal).alias(value))


def chain_semi(*steps: tuple[DataFrame, str]) -> DataFrame:
    """Each table kept where its key is among those of the kept rows before it; steps are (table, key shared with the
    next table)."""
    kept, key = steps[0]
    for table, next_key in steps[1:]:
        kept = table.join(kept.select(key).distinct(), key, "left_semi")
        key = next_key
    return kept


def resolve_labels(entities: DataFrame, verdicts: DataFrame, names: DataFrame, valid: Sequence[str], key: str) -> DataFrame:
    """Labels of an operating web verdict, else of the name, each limited to the valid ones; unresolved rows go."""
    allowed = F.array(*[F.lit(v) for v in valid])
    v = verdicts.where("status = 'ok' AND operating = 'yes'").select(key, F.array_intersect("labels", allowed).alias("_v"))
    n = names.select(key, F.array_intersect("labels", allowed).alias("_n"))
    df = entities.join(v, key, "left").join(n, key, "left")
    full = lambda c: F.coalesce(F.size(c) > 0, F.lit(False))
    df = df.withColumn("labels", F.when(full(F.col("_v")), F.col("_v")).when(full(F.col("_n")), F.col("_n")))
    df = df.withColumn("label_source", F.when(full(F.col("_v")), "web").when(full(F.col("_n")), "name"))
    return df.where("labels IS NOT NULL").drop("_v", "_n")


def lookup_with_fallback(df: DataFrame, state: DataFrame, key: str, fallback: str, value: str) -> DataFrame:
    """The state's value by full key, else by the fallback key."""
    a = state.select(F.col("key").alias(key), F.col(value).alias("_a"))
    b = state.select(F.col("key").alias(fallback), F.col(value).alias("_b"))
    return df.join(a, key, "left").join(b, fallback, "left").withColumn(value, F.coalesce("_a", "_b")).drop("_a", "_b")


def anti_brands(df: DataFrame, name: str, brands: DataFrame) -> DataFrame:
    """Rows whose name, as it is or cleaned, is no brand."""
    b = brands.select(F.col("brand").alias("_b")).distinct()
    df = df.join(b, F.upper(F.trim(F.col(name))) == F.col("_b"), "left_anti")
    return df.join(b, keys.clean_brand(F.col(name)) == F.col("_b"), "left_anti")


def denied_start(name: Column, words: Sequence[str]) -> Column:
    """Whether the name starts with a word group of the list."""
    import re

    return F.upper(name).rlike("^(" + "|".join(re.escape(w) for w in words) + r")\b")


def full_compare(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Counts of ids only in a, only in b and in both, and what that makes of the two sets."""
    a, b = a.select(F.col(key)).distinct().withColumn("_a", F.lit(1)), b.select(F.col(key)).distinct().withColumn("_b", F.lit(1))
    n = a.join(b, key, "full").agg(
        F.count_if(F.col("_b").isNull()).alias("only_a"), F.count_if(F.col("_a").isNull()).alias("only_b"), F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("both"))
    return n.withColumn("verdict", F.when(F.col("both") == 0, "disjoint").when(F.col("only_a") == 0, "a in b").when(F.col("only_b") == 0, "b in a").otherwise("partial"))


def range_match(left: DataFrame, right: DataFrame, street: str, number: str, reach: int) -> DataFrame:
    """Rows of left with a row of right on the same street at most ``reach`` numbers away, exact matches included.

    Numbers are put in buckets of ``reach``; each right row goes to its own and both neighbouring ones, so that the join is
    an equi-join on street and bucket."""
    r = right.select(F.col(street).alias("_street"), F.col(number).alias("_number")).distinct()
    r = r.withColumn("_bucket", F.explode(F.transform(F.array(*[F.lit(i) for i in (-1, 0, 1)]), lambda i: F.floor(F.col("_number") / reach) + i)))
    return left.withColumn("_b", F.floor(F.col(number) / reach)).join(
        r, (F.col(street) == F.col("_street")) & (F.col("_b") == F.col("_bucket")) & F.col("_number").between(F.col(number) - reach, F.col(number) + reach), "left_semi"
    ).drop("_b")


def best_candidate(pairs: DataFrame, key: str, a_tokens: str, b_tokens: str, candidate: str, least: float) -> DataFrame:
    """Of the candidates of a key the one with the largest name overlap of at least ``least``; ties to the smallest id."""
    scored = pairs.withColumn("overlap", keys.name_overlap(F.col(a_tokens), F.col(b_tokens))).where(F.col("overlap") >= least)
    w = W.partitionBy(key).orderBy(F.desc("overlap"), candidate)
    return scored.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def amenity(kind: Column, kinds: Sequence[str], shop: Column) -> Column:
    """P10: the lower-case kind where it is one of ``kinds``, else ``shop_`` and the shop's type, else null."""
    return F.when(kind.isin(*kinds), F.lower(kind)).when(shop.isNotNull() & (shop != ""), F.concat(F.lit("shop_"), shop))


def has_suffix(col: Column, suffix: str) -> Column:
    """The text ends in ``suffix``; null is out."""
    return F.coalesce(F.endswith(F.trim(col), F.lit(suffix)), F.lit(False))


def type_since(kind: Column, value: str, date: Column, since: dt.date) -> Column:
    """Of one kind and not before a day; nulls are out."""
    return F.coalesce((kind == value) & (date.cast("date") >= F.lit(since)), F.lit(False))


def weak_match(unmatched: Column, unlinked: Column, no_site: Column, kind: Column, weak_kind: str) -> Column:
    """Nothing speaks for the row: no match and no site, or none of the three and of the weak kind."""
    none = lambda c: F.coalesce(c, F.lit(True))
    return (none(unmatched) & none(no_site)) | (none(unmatched) & none(unlinked) & none(no_site) & F.coalesce(kind == weak_kind, F.lit(False)))


def generic_and_conflict(df: DataFrame, others: DataFrame, key: str, name: Column, label: Column, generic: Sequence[str], generic_label: Column) -> DataFrame:
    """Flags ``generic`` (a generic word in a name of such a label) and ``conflict`` (another source's label differs).

    others: (key, other), at most one row for each key; keys without a row do not conflict."""
    word = name.rlike(r"\b(" + "|".join(generic) + r")\b") & generic_label
    out = df.join(others.select(key, F.col("other").alias("_other")), key, "left")
    return out.withColumns({"generic": F.coalesce(word, F.lit(False)), "conflict": F.coalesce(label != F.col("_other"), F.lit(False))}).drop("_other")


def select_targets(df: DataFrame, done: DataFrame, id_key: str, among: DataFrame, group_key: str, kinds: Column) -> DataFrame:
    """Rows of the wanted kinds that are not done yet, of groups that are in ``among``."""
    return df.where(kinds).join(done.select(id_key), id_key, "left_anti").join(among.select(group_key).distinct(), group_key, "left_semi")


def verification_merge(df: DataFrame, places: DataFrame, web: DataFrame, bad_links: DataFrame, key: str) -> DataFrame:
    """Df with ``via`` and ``site``; rows that a source calls closed go.

    places: (key, status, site), web: (key, site), bad_links: (site).  An operational place wins over a web hit; a place's
    site that is among the bad links is left out.  Keys are unique in both sources."""
    p = places.select(key, F.col("status").alias("_status"), F.col("site").alias("_p"))
    w = web.select(key, F.lit(True).alias("_web"), F.col("site").alias("_w"))
    b = bad_links.select(F.col("site").alias("_p")).distinct().withColumn("_bad", F.lit(True))
    m = df.join(p, key, "left").join(w, key, "left").join(b, "_p", "left").where("_status IS NULL OR _status != 'CLOSED'")
    open_place = F.coalesce(F.col("_status") == "OPERATIONAL", F.lit(False))
    return m.withColumns({
        "via": F.when(open_place, "places").when(F.col("_web"), "web"),
        "site": F.when(open_place, F.when(F.col("_bad").isNull(), F.col("_p"))).when(F.col("_web"), F.col("_w")),
    }).drop("_status", "_p", "_w", "_web", "_bad")


#: Fields that a matched place brings whatever says that the business is open.
PLACE_FIELDS = ("maps_url", "rating", "x", "y")


def verified_fields(df: DataFrame, places: DataFrame, web: DataFrame, bad_links: DataFrame, coords: DataFrame, key: str, fallback: str) -> DataFrame:
    """Df with via, site, maps_url, rating, x and y of what verifies each row, in the order of these sources.

    An operational place brings its fields; its site gives way, if missing or among the bad links, to the web's.  A place that is
    closed in any way ends it: nothing is told.  Else a web verdict of 'yes' brings its site, with the fields of a matched
    place of unknown status.  Coordinates that are still missing come from ``coords`` by ``key``, else by ``fallback``.

    places: (key, status, site, maps_url, rating, x, y), status null where unknown; web: (key, operating, site); bad_links:
    (site); coords: (key, x, y).  Keys are unique in each; rows without any source have nulls."""
    p = places.select(key, F.lit(True).alias("_match"), F.col("status").alias("_status"), F.col("site").alias("_psite"), *[F.col(c).alias(f"_{c}") for c in PLACE_FIELDS])
    w = web.where("operating = 'yes'").select(key, F.lit(True).alias("_yes"), F.col("site").alias("_wsite"))
    bad = bad_links.select("site").where("site IS NOT NULL").distinct()
    dead = lambda c: bad.select(F.col("site").alias(c), F.lit(True).alias(f"{c}_dead"))
    own = coords.select(F.col(key), F.col("x").alias("_cx"), F.col("y").alias("_cy"))
    other = coords.select(F.col(key).alias(fallback), F.col("x").alias("_fx"), F.col("y").alias("_fy"))
    m = df.join(p, key, "left").join(w, key, "left").join(dead("_psite"), "_psite", "left").join(dead("_wsite"), "_wsite", "left").join(own, key, "left").join(other, fallback, "left")
    open_place, closed = F.coalesce(F.col("_status") == "OPERATIONAL", F.lit(False)), F.coalesce(F.startswith("_status", F.lit("CLOSED")), F.lit(False))
    via = F.when(open_place, "places").when(F.col("_yes") & ~closed, "web")
    place_site, web_site = F.when(F.col("_psite_dead").isNull(), F.col("_psite")), F.when(F.col("_wsite_dead").isNull(), F.col("_wsite"))
    told = via.isNotNull()
    has = F.col("_cx").isNotNull() & F.col("_cy").isNotNull()  # coordinates are taken as pairs
    at = lambda c: F.when(F.col("_x").isNotNull(), F.col(f"_{c}")).when(has, F.col(f"_c{c}")).otherwise(F.col(f"_f{c}"))
    return m.select(
        *[F.col(c) for c in df.columns], via.alias("via"), F.when(open_place, F.coalesce(place_site, web_site)).when(told, web_site).alias("site"),
        *[F.when(told, F.col(f"_{c}")).alias(c) for c in ("maps_url", "rating")], *[F.when(told, at(c)).alias(c) for c in ("x", "y")])


def by_alias(df: DataFrame, name: str, aliases: DataFrame, table: DataFrame, value: str) -> DataFrame:
    """The value of table (name, value) for the name or for what aliases (name, canon) call it; null if neither is known."""
    a = aliases.select(F.col("name").alias(name), F.col("canon").alias("_canon"))
    j = df.join(a, name, "left").withColumn("_canon", F.coalesce("_canon", name))
    return j.join(table.select(F.col("name").alias("_canon"), value), "_canon", "left").drop("_canon")


def crosscheck(claims: DataFrame, fresh: DataFrame, key: str, tolerance: float, sample: int | None = None, seed: str = "") -> DataFrame:
    """(checked, wrong, missing) of claims (key, claim) against recomputed values (key, value).

    With ``sample``, that many claims are taken in an order fixed by the seed; a claim without a value counts as missing."""
    if sample is not None:
        claims = claims.orderBy(F.md5(F.concat_ws("|", F.lit(seed), F.col(key).cast("string")).cast("binary")), key).limit(sample)
    j = claims.join(fresh.select(key, "value", F.lit(True).alias("_seen")), key, "left")
    seen = F.coalesce("_seen", F.lit(False))
    return j.agg(F.count_if(seen).alias("checked"), F.count_if(seen & ~F.coalesce(F.abs(F.col("claim") - F.col("value")) <= tolerance, F.lit(False))).alias("wrong"), F.count_if(~seen).alias("missing"))


def regressions(df: DataFrame, bad_ids: DataFrame, id_key: str, bad_groups: DataFrame, group_key: str) -> DataFrame:
    """Rows whose id or whose group is in one of two lists, each once."""
    hit = lambda bad, key: bad.select(key).where(F.col(key).isNotNull()).distinct()
    i = hit(bad_ids, id_key).withColumn("_i", F.lit(True))
    g = hit(bad_groups, group_key).withColumn("_g", F.lit(True))
    return df.join(i, id_key, "left").join(g, group_key, "left").where("_i OR _g").drop("_i", "_g")


def not_done(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not among those done; a null key is never done."""
    return df.join(done.select(key).distinct(), key, "left_anti")


def annotate_counts(df: DataFrame, facts: DataFrame, key: str, out: str) -> DataFrame:
    """Df with the number of facts of its key, 0 where there are none."""
    n = facts.groupBy(key).agg(F.count(F.lit(1)).alias(out))
    return df.join(n, key, "left").fillna(0, [out])
