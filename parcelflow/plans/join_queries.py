"""Entity, lookup, state and set joins over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import keys
from ..operators import matching, resolve
from . import standins as s
from .registry import query

E = F.expr

# Two feeds that share normalised addresses: customers, and orders by the address of their customer.
ADDR_SQL = f"upper(regexp_replace({s.ADDRESS}, '\\s+', ' ', 'g'))"
FEED_CTE = f"WITH c AS (SELECT c_custkey AS k, c_name AS name, c_acctbal AS v, {s.ADDRESS} AS a FROM customer), o AS (SELECT o_orderkey AS ok, o_custkey AS ck, o_orderdate::DATE AS d, o_totalprice AS p, o_orderstatus AS st, o_orderpriority AS pr FROM orders) "


def cust(t):
    return t.customer.select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("v"), keys.normalize_address(E(s.ADDRESS)).alias("addr_norm"))


def feed(t):
    o = t.orders.select(F.col("o_orderkey").alias("ok"), F.col("o_custkey").alias("c_custkey"), F.col("o_orderdate").cast("date").alias("d"), F.col("o_totalprice").alias("p"), F.col("o_orderstatus").alias("st"), F.col("o_orderpriority").alias("pr"))
    seg = t.customer.select("c_custkey", "c_mktsegment")
    o = o.join(seg, "c_custkey", "left")
    return o.withColumn("addr_norm", keys.normalize_address(E(s.ADDRESS)))


@query("J01_join_address", FEED_CTE + "SELECT ok, k FROM o JOIN c ON ck = k")
def _(t):
    return resolve.join_key(feed(t), cust(t), "addr_norm").select("ok", "k")


@query("J02_join_address_first_wins", FEED_CTE + "SELECT ck AS k, min(ok) AS ok FROM o JOIN c ON ck = k GROUP BY ck")
def _(t):
    first = resolve.first_per_key(feed(t).where("addr_norm IS NOT NULL"), "addr_norm", "ok", "ok")
    return cust(t).join(first, "addr_norm").select("k", "ok")


@query("J03_join_address_then_claims", FEED_CTE + "SELECT k, CASE WHEN k % 3 = 0 THEN 'address' WHEN k % 7 = 1 THEN 'fallback' END AS via, CASE WHEN k % 3 = 0 THEN k WHEN k % 7 = 1 THEN k - 1 END AS claim FROM c WHERE k % 3 = 0 OR (k % 7 = 1 AND (k - 1) % 3 <> 0)")
def _(t):
    c = cust(t)
    rights = c.where("k % 3 = 0").select(F.col("k").alias("claim"), "addr_norm").unionByName(c.where("k % 7 = 0 AND k % 3 != 0").select(F.col("k").alias("claim"), F.lit("none").alias("addr_norm")))
    by_address = resolve.join_key(c, rights, "addr_norm").select("k", F.lit("address").alias("via"), "claim")
    free = rights.join(by_address.select("claim").distinct(), "claim", "left_anti").select("claim", (F.col("claim") + 1).alias("k"))
    fallback = c.join(by_address.select("k"), "k", "left_anti").join(free, "k").select("k", F.lit("fallback").alias("via"), "claim")
    return by_address.unionByName(fallback)


@query("J22_range_join_house_number", "SELECT p_partkey FROM part a WHERE EXISTS (SELECT 1 FROM part b WHERE b.p_size % 10 = 0 AND a.p_brand = b.p_brand AND abs(a.p_partkey % 500 - b.p_partkey % 500) <= 5)")
def _(t):
    p = t.part.withColumn("number", F.col("p_partkey") % 500)
    return resolve.range_match(p, p.where("p_size % 10 = 0"), "p_brand", "number", 5).select("p_partkey")


@query("J24_semi_chain_gtfs", "SELECT DISTINCT s_suppkey FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey IN (0, 1))))")
def _(t):
    routes = t.customer.where("c_nationkey IN (0, 1)").select(F.col("c_custkey").alias("o_custkey"))
    trips = t.orders.select("o_custkey", F.col("o_orderkey").alias("l_orderkey"))
    times = t.lineitem.select("l_orderkey", F.col("l_suppkey").alias("s_suppkey"))
    return resolve.chain_semi((routes, "o_custkey"), (trips, "l_orderkey"), (times, "s_suppkey"), (t.supplier, "s_suppkey")).select("s_suppkey").distinct()


@query("J25_semi_address_set", FEED_CTE + "SELECT k, k IN (SELECT ck FROM o WHERE st = 'F' AND p > 400000) AS exempt FROM c")
def _(t):
    listed = feed(t).where("st = 'F' AND p > 400000").select("addr_norm").distinct().withColumn("hit", F.lit(True))
    return resolve.join_key(cust(t), listed, "addr_norm", "left").select("k", F.coalesce("hit", F.lit(False)).alias("exempt"))


@query("J26_anti_chain_brands", "SELECT c_custkey FROM customer WHERE NOT (c_custkey % 2 = 0 AND c_custkey % 5 = 3)")
def _(t):
    brands = t.customer.where("c_custkey % 2 = 0 AND c_custkey % 5 IN (0, 3)").select(F.upper("c_name").alias("brand"))
    return resolve.anti_brands(t.customer.withColumn("trade", E(s.COMPANY)), "trade", brands).select("c_custkey")


@query("J27_start_of_name_denylist", "SELECT p_partkey FROM part WHERE NOT regexp_matches(upper(p_name), '^(RED WIDGET|HOT)\\b')")
def _(t):
    return t.part.where(~resolve.denied_start(F.col("p_name"), ["RED WIDGET", "HOT"])).select("p_partkey")


@query("J28_lookup_area_by_code", "SELECT c_custkey, c_custkey % 25 // 2 AS first_area, (c_custkey % 25) // 2 + 10 AS last_area FROM customer")
def _(t):
    n = t.nation.select(F.col("n_nationkey").alias("code"))
    bridge = n.select("code", F.explode(F.array(F.floor(F.col("code") / 2), F.floor(F.col("code") / 2) + 10)).alias("area")).withColumn("o", F.col("area"))
    first = resolve.first_per_key(bridge, "code", "area", "o").withColumnRenamed("area", "first_area")
    last = resolve.first_per_key(bridge, "code", "area", "o", last=True).withColumnRenamed("area", "last_area")
    c = t.customer.select("c_custkey", (F.col("c_custkey") % 25).cast("int").alias("code"))
    return c.join(F.broadcast(first), "code", "left").join(F.broadcast(last), "code", "left").select("c_custkey", "first_area", "last_area")  # bridge: one row for each code of a fixed list


@query("J29_lookup_state_fallback_key", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_custkey::VARCHAR WHEN c_custkey % 3 = 0 THEN concat('s', c_custkey) END AS status FROM customer")
def _(t):
    c = t.customer.withColumn("key", F.concat(F.col("c_custkey").cast("string"), F.lit("||A M1A 1A1"))).withColumn("short", keys.strip_postal(F.col("key")))
    full = c.where("c_custkey % 2 = 0").select("key", F.col("c_custkey").cast("string").alias("status"))
    short = c.where("c_custkey % 3 = 0").select(F.col("short").alias("key"), F.concat(F.lit("s"), F.col("c_custkey").cast("string")).alias("status"))
    return resolve.lookup_with_fallback(c, full.unionByName(short), "key", "short", "status").select("c_custkey", "status")


@query("J30_label_resolution", """SELECT p_partkey, CASE WHEN p_size % 4 IN (0, 1) AND p_type IN ('SMALL', 'LARGE') THEN lower(p_type) ELSE split_part(p_name, ' ', 1) END AS labels, CASE WHEN p_size % 4 IN (0, 1) AND p_type IN ('SMALL', 'LARGE') THEN 'web' ELSE 'name' END AS label_source
FROM part WHERE (p_size % 4 IN (0, 1) AND p_type IN ('SMALL', 'LARGE')) OR split_part(p_name, ' ', 1) IN ('small', 'red', 'large')""")
def _(t):
    p = t.part
    verdicts = p.select("p_partkey", F.array(F.lower("p_type")).alias("labels"), F.lit("ok").alias("status"), F.when(F.col("p_size") % 4 <= 1, "yes").otherwise("no").alias("operating"))
    names = p.select("p_partkey", F.array(F.split_part("p_name", F.lit(" "), F.lit(1))).alias("labels"))
    r = resolve.resolve_labels(p.select("p_partkey"), verdicts, names, ["small", "large", "red"], "p_partkey")
    return r.select("p_partkey", F.array_join("labels", ",").alias("labels"), "label_source")


@query("J31_verification_merge", """SELECT k, CASE WHEN k % 4 = 0 THEN 'places' WHEN k % 4 <> 1 AND k % 3 = 0 THEN 'web' END AS via, CASE WHEN k % 4 = 0 AND k % 5 <> 0 THEN concat('http://p/', k) WHEN k % 4 <> 1 AND k % 3 = 0 AND k % 4 <> 0 THEN concat('http://v/', k) END AS site
FROM (SELECT c_custkey AS k FROM customer) WHERE k % 4 <> 1""")
def _(t):
    c = t.customer.select(F.col("c_custkey").alias("k"))
    places = c.where("k % 4 IN (0, 1)").select("k", F.when(F.col("k") % 4 == 0, "OPERATIONAL").otherwise("CLOSED").alias("status"), F.concat(F.lit("http://p/"), F.col("k").cast("string")).alias("site"))
    web = c.where("k % 3 = 0").select("k", F.concat(F.lit("http://v/"), F.col("k").cast("string")).alias("site"))
    bad = c.where("k % 5 = 0").select(F.concat(F.lit("http://p/"), F.col("k").cast("string")).alias("site"))
    return resolve.verification_merge(c, places, web, bad, "k").select("k", "via", "site")


_PLACES = f"""WITH p AS (SELECT p_partkey AS k, p_brand AS street, p_size AS num, list_distinct(string_split(upper(p_name), ' ')) AS w, {s.lon('p_partkey')} AS x, {s.lat('p_partkey')} AS y FROM part),
m AS (SELECT a.k, b.k AS c, a.street = b.street AND a.num = b.num AS same, 2 * 6371008.8::DOUBLE * asin(sqrt(pow(sin(radians(b.y - a.y) / 2), 2) + cos(radians(a.y)) * cos(radians(b.y)) * pow(sin(radians(b.x - a.x) / 2), 2))) AS d, a.w AS aw, b.w AS bw
    FROM p a JOIN p b ON a.k <> b.k AND ((a.street = b.street AND a.num = b.num) OR (abs(a.y - b.y) < 0.01 AND abs(a.x - b.x) < 0.02))),
v AS (SELECT k, c, same, d, len(list_filter(aw, lambda i: len(list_filter(bw, lambda j: i = j OR (length(i) >= 4 AND contains(j, i)) OR (length(j) >= 4 AND contains(i, j)))) > 0))::DOUBLE / greatest(len(aw), len(bw)) AS s FROM m),
one AS (SELECT k, arg_min(c, [-s, c]) AS c FROM v WHERE same AND s >= 0.25 GROUP BY k),
two AS (SELECT k, arg_min(c, [-s, c]) AS c FROM v WHERE d <= 600 AND s >= 0.2 AND k NOT IN (SELECT k FROM one) GROUP BY k)
SELECT k, c, 'address' AS via FROM one UNION ALL SELECT k, c, 'near' FROM two"""


@query("J31_verified_fields", """WITH c AS (SELECT c_custkey AS k FROM customer),
j AS (SELECT k, CASE WHEN k % 5 IN (0, 1) THEN 'OPERATIONAL' WHEN k % 5 = 2 THEN 'CLOSED_PERMANENTLY' END AS status, k % 5 < 4 AS match, k % 3 = 0 AS yes,
    CASE WHEN k % 5 < 4 AND k % 7 <> 0 AND k % 20 <> 0 THEN 'http://p/' || k END AS psite, CASE WHEN k % 3 = 0 AND k % 9 <> 0 THEN 'http://v/' || k END AS wsite,
    CASE WHEN k % 5 < 4 AND k % 2 = 0 THEN k * 1.0 END AS px, CASE WHEN k % 4 <> 0 THEN k * 2.0 END AS cx, CASE WHEN (k // 10) % 4 <> 0 THEN (k // 10) * 2.0 END AS fx FROM c),
t AS (SELECT *, CASE WHEN status = 'OPERATIONAL' THEN 'places' WHEN status IS NULL AND yes THEN 'web' END AS via FROM j)
SELECT k, via, CASE via WHEN 'places' THEN coalesce(psite, CASE WHEN yes THEN wsite END) WHEN 'web' THEN wsite END AS site, CASE WHEN via IS NOT NULL AND match THEN 'm' || k END AS maps_url,
CASE WHEN via IS NOT NULL THEN coalesce(px, cx, fx)::DOUBLE END AS x, CASE WHEN via IS NOT NULL THEN coalesce(px + 1, cx + 1, fx + 1)::DOUBLE END AS y FROM t""")
def _(t):
    c = t.customer.select(F.col("c_custkey").alias("k"), F.floor(F.col("c_custkey") / 10).alias("near"))
    k, text = F.col("k"), F.col("k").cast("string")
    x = F.when(k % 2 == 0, k * F.lit(1.0))
    places = c.where("k % 5 < 4").select(
        "k", F.when(k % 5 <= 1, "OPERATIONAL").when(k % 5 == 2, "CLOSED_PERMANENTLY").alias("status"), F.when(k % 7 != 0, F.concat(F.lit("http://p/"), text)).alias("site"), F.concat(F.lit("m"), text).alias("maps_url"),
        (k % 5).cast("double").alias("rating"), x.alias("x"), (x + 1).alias("y"))
    web = c.where("k % 3 <= 1").select("k", F.when(k % 3 == 0, "yes").otherwise("no").alias("operating"), F.concat(F.lit("http://v/"), text).alias("site"))
    bad = c.where("k % 20 = 0").select(F.concat(F.lit("http://p/"), text).alias("site")).unionByName(c.where("k % 9 = 0").select(F.concat(F.lit("http://v/"), text).alias("site")))
    known = c.where("k % 4 <> 0").select("k", (k * F.lit(2.0)).alias("x"), (k * F.lit(2.0) + 1).alias("y"))
    return resolve.verified_fields(c, places, web, bad, known, "k", "near").select("k", "via", "site", "maps_url", "x", "y")


@query("J32_fuzzy_candidate_match", _PLACES)
def _(t):
    p = t.part.select(F.col("p_partkey").alias("k"), F.col("p_brand").alias("street"), F.col("p_size").alias("num"), keys.name_tokens(F.col("p_name")).alias("w"), E(s.lon("p_partkey")).alias("x"), E(s.lat("p_partkey")).alias("y"))
    found = matching.match_places(p, p.withColumnRenamed("k", "c"), "k", "w", "street", "num", "x", "y", "c", 600.0, other=True)
    return found.select("k", "c", "via")


@query("J33_name_alias_join", "SELECT n_nationkey, CASE WHEN n_nationkey % 4 <> 3 THEN n_regionkey END AS region FROM nation")
def _(t):
    names = t.nation.select("n_nationkey", E("case when n_nationkey % 4 = 1 then concat('Old ', n_name) when n_nationkey % 4 = 3 then 'Nowhere' else n_name end").alias("name"))
    alias = t.nation.select(F.concat(F.lit("Old "), F.col("n_name")).alias("name"), F.col("n_name").alias("canon"))
    table = t.nation.select(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))
    return resolve.by_alias(names, "name", alias, table, "region").select("n_nationkey", "region")


@query("J34_crosscheck_recompute", "SELECT count(v)::BIGINT AS checked, count(v) FILTER (abs(claim - v) > 0.01)::BIGINT AS wrong, count(*) FILTER (v IS NULL)::BIGINT AS missing FROM (SELECT o_custkey, sum(o_totalprice) + CASE WHEN o_custkey % 9 = 0 THEN 1 ELSE 0 END AS claim FROM orders GROUP BY o_custkey ORDER BY md5(concat('s|', o_custkey::VARCHAR)), o_custkey LIMIT 500) LEFT JOIN (SELECT o_custkey, sum(o_totalprice) AS v FROM orders WHERE o_orderpriority <> '5-LOW' OR o_custkey % 4 > 0 GROUP BY 1) USING (o_custkey)")
def _(t):
    claim = t.orders.groupBy("o_custkey").agg(F.sum("o_totalprice").alias("v")).select("o_custkey", (F.col("v") + F.when(F.col("o_custkey") % 9 == 0, 1).otherwise(0)).alias("claim"))
    fresh = t.orders.where("o_orderpriority != '5-LOW' OR o_custkey % 4 > 0").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("value"))
    return resolve.crosscheck(claim, fresh, "o_custkey", 0.01, sample=500, seed="s")


@query("J35_outer_compare_tiers", "WITH a AS (SELECT p_partkey k FROM part WHERE p_size > 20), b AS (SELECT p_partkey k FROM part WHERE p_retailprice > 950) SELECT *, CASE WHEN \"both\" = 0 THEN 'disjoint' WHEN only_a = 0 THEN 'a in b' WHEN only_b = 0 THEN 'b in a' ELSE 'partial' END AS verdict FROM (SELECT count(*) FILTER (b.k IS NULL)::BIGINT AS only_a, count(*) FILTER (a.k IS NULL)::BIGINT AS only_b, count(*) FILTER (a.k IS NOT NULL AND b.k IS NOT NULL)::BIGINT AS \"both\" FROM a FULL JOIN b ON a.k = b.k)")
def _(t):
    return resolve.full_compare(t.part.where("p_size > 20"), t.part.where("p_retailprice > 950"), "p_partkey")


@query("J36_regression_semi", "SELECT p_partkey FROM part WHERE p_partkey % 97 = 0 OR concat(p_brand, '#', p_partkey % 50) IN (SELECT concat(p_brand, '#', p_partkey % 50) FROM part WHERE p_partkey % 89 = 0)")
def _(t):
    p = t.part.withColumn("addr", F.concat_ws("#", "p_brand", (F.col("p_partkey") % 50).cast("string")))
    return resolve.regressions(p, p.where("p_partkey % 97 = 0"), "p_partkey", p.where("p_partkey % 89 = 0"), "addr").select("p_partkey")


@query("J37_anti_already_done", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '2000-06-01')")
def _(t):
    done = t.orders.where("o_orderdate >= TIMESTAMP '2000-06-01'").select(F.col("o_custkey").alias("c_custkey"))
    return resolve.not_done(t.customer, done, "c_custkey").select("c_custkey")


@query("J38_context_annotate", "SELECT c_custkey, coalesce(n, 0)::BIGINT AS suppliers FROM customer LEFT JOIN (SELECT s_nationkey, count(*) AS n FROM supplier WHERE s_acctbal > 5000 GROUP BY s_nationkey) ON c_nationkey = s_nationkey")
def _(t):
    near = t.supplier.where("s_acctbal > 5000").select(F.col("s_nationkey").alias("c_nationkey"))
    return resolve.annotate_counts(t.customer, near, "c_nationkey", "suppliers").select("c_custkey", "suppliers")


@query("J40_key_to_group_map", FEED_CTE + "SELECT c_nationkey AS grp, count(*) AS n FROM o JOIN customer ON ck = c_custkey WHERE st = 'O' GROUP BY c_nationkey")
def _(t):
    group = t.customer.withColumn("addr_norm", keys.normalize_address(E(s.ADDRESS)))
    group = resolve.first_per_key(group.withColumn("grp", F.col("c_nationkey")), "addr_norm", "grp", "c_custkey", last=True)
    return resolve.join_key(feed(t).where("st = 'O'"), group, "addr_norm").groupBy("grp").agg(F.count(F.lit(1)).alias("n"))
