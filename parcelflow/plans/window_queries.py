"""Ranks, top-n feeds, sorts and set operations over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import mathx
from ..operators import aggregates as agg
from ..operators import feeds
from . import standins as s
from .registry import query

E = F.expr
_AREA = "SELECT c_nationkey AS area, count(*) AS n, round(avg(c_acctbal), 4) AS mean, count(*) FILTER (c_acctbal < 0)::BIGINT AS low FROM customer GROUP BY 1"


def areas(t):
    return t.customer.groupBy(F.col("c_nationkey").alias("area")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("c_acctbal"), 4).alias("mean"), F.count_if(F.col("c_acctbal") < 0).alias("low"))


@query("W01_rank_metrics", f"SELECT area, row_number() OVER (ORDER BY n DESC, area)::INT AS rank_n, row_number() OVER (ORDER BY mean DESC, area)::INT AS rank_mean, row_number() OVER (ORDER BY low, area)::INT AS rank_low FROM ({_AREA})")
def _(t):
    return feeds.ranked(areas(t), {"n": True, "mean": True, "low": False}, "area").select("area", "rank_n", "rank_mean", "rank_low")


@query("W02_dedup_keep_earliest", "SELECT o_custkey, o_orderpriority, arg_min(o_orderkey, [epoch(o_orderdate)::BIGINT, o_orderkey]) AS o_orderkey FROM orders GROUP BY ALL")
def _(t):
    return agg.keep_first(t.orders, ["o_custkey", "o_orderpriority"], F.col("o_orderdate"), F.col("o_orderkey")).select("o_custkey", "o_orderpriority", "o_orderkey")


@query("W03_dedup_keep_first", "SELECT p_name, min(p_partkey) AS p_partkey FROM part GROUP BY 1")
def _(t):
    return agg.keep_first(t.part, ["p_name"], F.col("p_partkey")).select("p_name", "p_partkey")


@query("W04_topn_per_group", "SELECT c_nationkey, c_custkey FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rn FROM customer) WHERE rn <= 10")
def _(t):
    return agg.first_n(t.customer, ["c_nationkey"], [F.desc("c_acctbal"), F.col("c_custkey")], 10).select("c_nationkey", "c_custkey")


@query("W05_minmax_normalise", f"SELECT area, CASE WHEN area % 9 = 0 THEN 50 ELSE round_even((v - min(v) OVER ()) / (max(v) OVER () - min(v) OVER ()) * 100, 1) END AS scaled, CASE WHEN area % 9 = 0 THEN 50 ELSE 100 - round_even((v - min(v) OVER ()) / (max(v) OVER () - min(v) OVER ()) * 100, 1) END AS inverse FROM (SELECT area, CASE WHEN area % 9 > 0 THEN mean END AS v FROM ({_AREA}))")
def _(t):
    a = areas(t).withColumn("v", F.when(F.col("area") % 9 > 0, F.col("mean")))
    return a.select("area", mathx.minmax(F.col("v")).alias("scaled"), mathx.minmax(F.col("v"), invert=True).alias("inverse"))


@query("W06_composite_index", f"SELECT area, round_even(n * 0.5::DOUBLE + (100 - low) * 0.3::DOUBLE + area * 0.2::DOUBLE, 1) AS score FROM ({_AREA})")
def _(t):
    return areas(t).select("area", mathx.composite(F.col("n"), 100 - F.col("low"), F.col("area")).alias("score"))


@query("W07_cumulative_share", "SELECT n_regionkey, n_nationkey, round(sum(n_nationkey + 1) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) / sum(n_nationkey + 1) OVER (PARTITION BY n_regionkey), 8) AS share FROM nation")
def _(t):
    return agg.cumulative_share(t.nation, "n_regionkey", "n_nationkey", F.col("n_nationkey") + 1).select("n_regionkey", "n_nationkey", "share")


@query("W08_first_unused_pick", f"WITH a AS ({_AREA}), x AS (SELECT area FROM a ORDER BY n DESC, area LIMIT 1), y AS (SELECT area FROM a WHERE area NOT IN (FROM x) ORDER BY mean DESC, area LIMIT 1) SELECT 1 AS pick, area FROM x UNION ALL SELECT 2, area FROM y")
def _(t):
    a = areas(t)
    by_n = a.withColumn("o", -F.col("n").cast("double"))
    by_mean = a.withColumn("o", -F.col("mean"))
    picked = feeds.first_unused([by_n, by_mean], "area", [F.col("o"), F.col("area")])
    return t.spark.createDataFrame(list(enumerate(picked, 1)), "pick int, area int")


@query("W09_slot_rotation", f"SELECT area, n FROM ({_AREA}) WHERE n >= 50 ORDER BY ((area - 7 - 1) % 25 + 25) % 25 LIMIT 1")
def _(t):
    return feeds.rotate(areas(t), "area", 7, 25, "n", 50).select("area", "n")


@query("W10_stratified_bands", "SELECT c_custkey, CASE WHEN rn <= 50 THEN 'top' ELSE 'middle' END AS band FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS rn FROM customer) WHERE rn <= 50 OR rn BETWEEN 200 AND 400")
def _(t):
    return feeds.bands(t.customer, [F.desc("c_acctbal"), F.col("c_custkey")], {"top": (1, 50), "middle": (200, 400)}).select("c_custkey", "band")


@query("W11_diversity_sample", "WITH o AS (SELECT *, md5(concat_ws('|', 'x', c_mktsegment, c_nationkey::VARCHAR, c_custkey::VARCHAR)) AS o FROM customer), g AS (SELECT *, row_number() OVER (PARTITION BY c_mktsegment, c_nationkey ORDER BY o) AS g FROM o), b AS (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY o) AS b FROM g WHERE g <= 2) SELECT c_mktsegment, c_nationkey, c_custkey FROM b WHERE b <= 20")
def _(t):
    return feeds.diversity_sample(t.customer.select("c_mktsegment", "c_nationkey", "c_custkey"), "c_mktsegment", "c_nationkey", 2, 20, "x")


@query("T01_feed_newest", "SELECT o_orderkey, o_orderdate::DATE AS d FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 300")
def _(t):
    return feeds.newest(t.orders, "o_orderdate", "o_orderkey", 300).select("o_orderkey", F.col("o_orderdate").cast("date").alias("d"))


@query("T02_feed_longest_running", "SELECT o_orderkey FROM orders ORDER BY coalesce(CASE WHEN o_orderkey % 3 > 0 THEN o_totalprice END, 0) DESC, o_orderkey LIMIT 50")
def _(t):
    return feeds.largest(t.orders, F.when(F.col("o_orderkey") % 3 > 0, F.col("o_totalprice")), "o_orderkey", 50).select("o_orderkey")


@query("T03_sort_lot_desc", "SELECT p_partkey FROM part ORDER BY coalesce(nullif(p_size, 7), 0) DESC, p_partkey LIMIT 500")
def _(t):
    return feeds.largest(t.part, F.nullif("p_size", F.lit(7)), "p_partkey", 500).select("p_partkey")


@query("T04_nulls_last_either_direction", "(SELECT 'up' AS dir, p_partkey FROM part ORDER BY nullif(p_size, 1) ASC NULLS LAST, p_partkey LIMIT 100) UNION ALL (SELECT 'down', p_partkey FROM part ORDER BY nullif(p_size, 50) DESC NULLS LAST, p_partkey LIMIT 100)")
def _(t):
    one = lambda name, gap, down: feeds.sorted_either(t.part, F.nullif("p_size", F.lit(gap)), "p_partkey", 100, down).select(F.lit(name).alias("dir"), "p_partkey")
    return one("up", 1, False).union(one("down", 50, True))


@query("T05_top_n_projection", "SELECT p_partkey, (SELECT count(*) FROM part WHERE p_size > 25) AS available FROM part WHERE p_size > 25 ORDER BY p_retailprice DESC, p_partkey LIMIT 200")
def _(t):
    return feeds.top_with_total(t.part.where("p_size > 25"), [F.desc("p_retailprice"), F.col("p_partkey")], 200).select("p_partkey", "available")


@query("T06_lead_story", f"SELECT c_custkey FROM customer JOIN (SELECT area FROM ({_AREA}) WHERE mean < 4600) ON area = c_nationkey ORDER BY c_acctbal DESC, c_custkey LIMIT 1")
def _(t):
    low = areas(t).where("mean < 4600").select(F.col("area").alias("c_nationkey"))
    return feeds.lead(t.customer, low, "c_nationkey", [F.desc("c_acctbal"), F.col("c_custkey")]).select("c_custkey")


@query("T07_legacy_by_area", "SELECT c_nationkey, o_orderkey FROM (SELECT c_nationkey, o_orderkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus <> 'F') WHERE rn <= 5")
def _(t):
    o = t.orders.where("o_orderstatus != 'F'").join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return agg.first_n(o, ["c_nationkey"], [F.col("o_orderdate"), F.col("o_orderkey")], 5).select("c_nationkey", "o_orderkey")


@query("T08_announce_queue", f"SELECT o_orderkey FROM orders WHERE o_orderdate::DATE BETWEEN {s.AS_OF_SQL} - 30 AND {s.AS_OF_SQL} AND o_custkey NOT IN (SELECT user_id * 10 FROM events) ORDER BY o_orderdate DESC, o_orderkey LIMIT 25")
def _(t):
    done = t.events.select((F.col("user_id") * 10).alias("o_custkey"))
    return feeds.announce_queue(t.orders, done, "o_custkey", "o_orderdate", "o_orderkey", s.AS_OF).select("o_orderkey")


@query("T09_recent_dev_feed", "SELECT doc_id, substr(text, 1, 240) AS teaser FROM documents WHERE source IN ('src0', 'src1') ORDER BY doc_id DESC LIMIT 30")
def _(t):
    return feeds.teasers(t.documents, F.col("source").isin("src0", "src1"), "doc_id", "text")


@query("T10_broken_link_sample", "SELECT page_id FROM pages WHERE page_id % 3 = 0 ORDER BY page_id DESC LIMIT 15")
def _(t):
    return feeds.broken_links(t.pages, F.col("page_id") % 3 != 0, "page_id").select("page_id")


@query("U01_curated_union", "WITH a AS (SELECT p_partkey FROM part WHERE p_size = 50), b AS (SELECT p_partkey FROM part WHERE p_retailprice > 950 ORDER BY p_size DESC, p_partkey LIMIT 500) SELECT p_partkey, 'a' AS part FROM a UNION ALL SELECT p_partkey, 'b' FROM b WHERE p_partkey NOT IN (FROM a)")
def _(t):
    b = t.part.where("p_retailprice > 950").orderBy(F.desc("p_size"), "p_partkey").limit(500)
    return feeds.curated_union(t.part.where("p_size = 50").select("p_partkey"), b.select("p_partkey"), "p_partkey")


@query("U02_or_filter_union_dedup", "SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT' OR o_totalprice > 450000")
def _(t):
    return feeds.any_filter(t.orders, "o_orderkey", F.col("o_orderpriority") == "1-URGENT", F.col("o_totalprice") > 450000)


@query("U03_target_union", "SELECT k, k IN (SELECT o_custkey FROM orders) AS known FROM (SELECT c_custkey AS k FROM customer WHERE c_acctbal < 0 UNION SELECT user_id + 1450 FROM events)")
def _(t):
    found = [t.customer.where("c_acctbal < 0").select(F.col("c_custkey").alias("k")), t.events.select((F.col("user_id") + 1450).alias("k"))]
    return feeds.target_union(found, "k", t.orders.select(F.col("o_custkey").alias("k")))


@query("U04_snapshot_diff", "WITH a AS (SELECT p_name FROM part WHERE p_partkey % 2 = 0), b AS (SELECT p_name FROM part WHERE p_partkey % 3 = 0) SELECT p_name, 'added' AS change FROM (FROM b EXCEPT ALL FROM a) UNION ALL SELECT p_name, 'removed' FROM (FROM a EXCEPT ALL FROM b)")
def _(t):
    return feeds.snapshot_diff(t.part.where("p_partkey % 2 = 0").select("p_name"), t.part.where("p_partkey % 3 = 0").select("p_name"))


@query("U05_dimension_prune", "SELECT p_brand AS key, p_brand < 'Brand#15' AS seeded FROM part GROUP BY p_brand HAVING p_brand < 'Brand#15' OR max(p_size) FILTER (p_partkey % 40 = 0) > 25")
def _(t):
    dim = t.part.select(F.col("p_brand").alias("key")).distinct().withColumn("seeded", F.col("key") < "Brand#15")
    return feeds.prune(dim, t.part.where("p_partkey % 40 = 0 AND p_size > 25").select(F.col("p_brand").alias("key")), "key", "seeded")


@query("U06_url_inventory", "SELECT DISTINCT url FROM (SELECT url FROM pages UNION ALL SELECT concat(url, '/x') FROM pages WHERE page_id % 2 = 0)")
def _(t):
    return feeds.url_inventory(t.pages, t.pages.where("page_id % 2 = 0").select(F.concat("url", F.lit("/x")).alias("url")))
