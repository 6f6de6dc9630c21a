"""Scalar functions over the driver's tables."""

from __future__ import annotations

import datetime as dt
import functools

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import dates, keys, mathx, text
from . import standins as s
from .registry import query

E = F.expr


def _map(values) -> str:
    return "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in values.items()) + "}"


_TOKENS = "list_filter(string_split_regex(upper(trim({})), '\\s+'), lambda t: t <> '')"


def _norm(x: str) -> str:
    return f"array_to_string(list_transform({_TOKENS.format(x)}, lambda t: coalesce(({_map(keys.STREET_TYPES)})[t], t)), ' ')"



@query("F01_normalize_address", f"SELECT c_custkey, {_norm(s.ADDRESS)} AS addr_norm FROM customer")
def _(t):
    return t.customer.select("c_custkey", keys.normalize_address(E(s.ADDRESS)).alias("addr_norm"))


@query("F02_expand_street_type", f"""SELECT c_custkey, array_to_string(list_concat(x[1:len(x) - 1], [coalesce(({_map(keys.STREET_TYPE_FULL)})[x[-1]], x[-1])]), ' ') AS addr_full
FROM (SELECT c_custkey, {_TOKENS.format(s.ADDRESS)} AS x FROM customer)""")
def _(t):
    return t.customer.select("c_custkey", keys.expand_street_type(E(s.ADDRESS)).alias("addr_full"))


@query("F03_entity_key", f"SELECT c_custkey, concat(upper(trim(c_name)), '||', upper(concat_ws(' ', {s.ADDRESS}, nullif(trim(case when c_custkey % 2 = 0 then ' ' else 'unit 4' end), '')))) AS entity_key FROM customer")
def _(t):
    return t.customer.select("c_custkey", keys.entity_key(F.col("c_name"), E(s.ADDRESS), E("case when c_custkey % 2 = 0 then ' ' else 'unit 4' end")).alias("entity_key"))


@query("F04_compose_address", "SELECT c_custkey, concat_ws(' ', cast(c_custkey as varchar), nullif(trim(c_mktsegment), ''), nullif(case when c_custkey % 3 = 0 then '' else 'ST' end, ''), nullif(case when c_custkey % 2 = 0 then 'W' end, '')) AS addr FROM customer")
def _(t):
    return t.customer.select("c_custkey", keys.compose(F.col("c_custkey"), F.col("c_mktsegment"), E("case when c_custkey % 3 = 0 then '' else 'ST' end"), E("case when c_custkey % 2 = 0 then 'W' end")).alias("addr"))


@query("F05_strip_postal", f"SELECT c_custkey, trim(regexp_replace(upper({s.POSTAL_ADDRESS}), '\\s+[A-Z]\\d[A-Z]\\s*\\d[A-Z]\\d$', '')) AS street FROM customer")
def _(t):
    return t.customer.select("c_custkey", keys.strip_postal(E(s.POSTAL_ADDRESS)).alias("street"))


@query("F06_area_code_of", f"SELECT c_custkey, nullif(regexp_extract(upper({s.POSTAL_ADDRESS}), '\\b(M[0-9][A-Z])\\b', 1), '') AS area FROM customer")
def _(t):
    return t.customer.select("c_custkey", keys.area_code(E(s.POSTAL_ADDRESS)).alias("area"))


@query("F07_district_of", f"SELECT c_custkey, ({_map(keys.DISTRICTS)})[substr({s.POSTAL}, 1, 2)] AS district FROM customer")
def _(t):
    return t.customer.select("c_custkey", keys.district(E(s.POSTAL_ADDRESS)).alias("district"))


@query("F08_strip_numeric_suffix", "SELECT n_nationkey, n_name AS hood FROM nation")
def _(t):
    return t.nation.select("n_nationkey", keys.strip_numeric_suffix(F.concat("n_name", F.lit(" ("), F.col("n_nationkey").cast("string"), F.lit(")"))).alias("hood"))


@query("F09_street_and_number", f"SELECT c_custkey, cast(c_custkey as int) AS number, upper(trim(regexp_replace(trim({s.ADDRESS}), '^\\d+\\S*\\s*', ''))) AS street FROM customer")
def _(t):
    return t.customer.select("c_custkey", keys.house_number(E(s.ADDRESS)).alias("number"), keys.street_of(E(s.ADDRESS)).alias("street"))


# Endings of company names.
COMPANY_ENDINGS = ("INC", "LTD", "LIMITED", "CORP", "CORPORATION", "CO", "COMPANY", "LLP")


def _company_sql(x: str) -> str:
    for _ in range(3):
        x = f"trim(regexp_replace(trim(regexp_replace({x}, '\\s+({'|'.join(COMPANY_ENDINGS)})\\.?\\s*$', '')), '\\.+$', ''))"
    return f"nullif({x}, '')"


@query("F10_normalize_company", f"SELECT c_custkey, {_company_sql(f'upper(trim({s.COMPANY}))')} AS company FROM customer")
def _(t):
    return t.customer.select("c_custkey", keys.normalize_company(E(s.COMPANY)).alias("company"))


@query("F11_clean_brand_name", f"SELECT c_custkey, trim(regexp_replace(trim(regexp_replace(upper(trim({s.COMPANY})), '\\s+(INC|LTD|LLC|CORP|CO|LIMITED)\\.?$', '')), '\\s*#\\s*\\d+$', '')) AS brand FROM customer")
def _(t):
    return t.customer.select("c_custkey", keys.clean_brand(E(s.COMPANY)).alias("brand"))


@query("F12_slugify", f"SELECT c_custkey, substr(concat(regexp_replace(regexp_replace(lower(trim(regexp_replace({s.COMPANY}, '[^\\w\\s-]', '', 'g'))), '[\\s_]+', '-', 'g'), '^-+|-+$', '', 'g'), '-', cast(c_custkey as varchar)), 1, 80) AS slug FROM customer")
def _(t):
    return t.customer.select("c_custkey", keys.slug(E(s.COMPANY), E(s.ADDRESS)).alias("slug"))


@query("F13_slug_label", "SELECT p_partkey, regexp_replace(regexp_replace(lower(trim(p_name)), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS label_key, regexp_replace(regexp_replace(lower(p_brand), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS brand_key FROM part")
def _(t):
    return t.part.select("p_partkey", keys.label_slug(F.concat("p_name", F.lit(" Kitchen"))).alias("label_key"), keys.label_slug(F.col("p_brand"), "-").alias("brand_key"))


@query("F14_register_label", """WITH seed AS (SELECT DISTINCT replace(lower(p_type), ' ', '_') AS key, p_type AS label FROM part WHERE p_partkey % 2 = 0 AND p_type < 'P'),
new AS (SELECT DISTINCT p_type AS label FROM part) SELECT key, label, true AS seeded FROM seed UNION ALL SELECT lower(label), label, false FROM new WHERE lower(label) NOT IN (SELECT key FROM seed)""")
def _(t):
    from ..operators import resolve

    seed = t.part.where("p_partkey % 2 = 0 AND p_type < 'P'").select(keys.label_slug(F.col("p_type")).alias("key"), F.col("p_type").alias("label")).distinct()
    return resolve.register_labels(seed, t.part.select(F.col("p_type").alias("label")))


@query("F15_normalize_labels", """SELECT p_partkey, array_to_string(list_distinct_ordered, ',') AS labels FROM (SELECT p_partkey,
CASE WHEN p_partkey % 4 = 0 THEN [split_part(p_name, ' ', 2)] WHEN p_partkey % 3 = 0 THEN [split_part(p_name, ' ', 1)] WHEN split_part(p_name, ' ', 1) = lower(p_type) THEN [lower(p_type)] ELSE [split_part(p_name, ' ', 1), lower(p_type)] END AS list_distinct_ordered FROM part)""")
def _(t):
    first, second = F.split_part("p_name", F.lit(" "), F.lit(1)), F.split_part("p_name", F.lit(" "), F.lit(2))
    many = F.when(F.col("p_partkey") % 4 != 0, F.array(F.concat(first, F.lit(" Food")), F.when(F.col("p_partkey") % 3 == 0, F.lit("Unknown")).otherwise(F.col("p_type")), first, F.lit("late")))
    return t.part.select("p_partkey", F.array_join(keys.normalize_labels(many, second), ",").alias("labels"))


RULES = [("round", ["RING", "GEAR"]), ("warm", ["HOT", "RED"]), ("tool", ["WIDGET", "BOLT"])]
_RULES_SQL = "CASE " + " ".join(f"WHEN {' OR '.join(f'contains(upper(p_name), {chr(39)}{k}{chr(39)})' for k in ks)} THEN '{l}'" for l, ks in RULES) + " END"


@query("F16_keyword_label", f"SELECT p_partkey, {_RULES_SQL} AS label FROM part")
def _(t):
    return t.part.select("p_partkey", keys.keyword_label(F.col("p_name"), RULES).alias("label"))


_STOP = "[" + ", ".join(f"'{w}'" for w in keys.NAME_STOP_WORDS) + "]"


def _name_tokens_sql(x: str) -> str:
    return f"list_filter(regexp_extract_all(upper(translate({x}, '{keys.ACCENTS}', '{keys.PLAIN}')), '[A-Z0-9]{{2,}}'), lambda w: NOT list_contains({_STOP}, w))"


@query("F17_name_tokens", f"SELECT c_custkey, array_to_string(list_sort(list_distinct({_name_tokens_sql('concat(c_name, chr(32), c_mktsegment, chr(32), chr(233), chr(39), chr(32), chr(84), chr(104), chr(101))')})), ' ') AS tokens FROM customer")
def _(t):
    return t.customer.select("c_custkey", F.array_join(F.array_sort(keys.name_tokens(F.concat_ws(" ", "c_name", "c_mktsegment", F.lit("é' The")))), " ").alias("tokens"))


_TA, _TB = "list_distinct(string_split(upper(p_name), ' '))", "list_distinct(string_split(upper(concat(split_part(p_name, ' ', 2), p_type, ' ', p_type)), ' '))"


@query("F18_name_overlap", f"SELECT p_partkey, round(len(list_filter(a, lambda x: len(list_filter(b, lambda y: x = y OR (length(x) >= 4 AND contains(y, x)) OR (length(y) >= 4 AND contains(x, y)))) > 0))::DOUBLE / greatest(len(a), len(b)), 6) AS overlap FROM (SELECT p_partkey, {_TA} AS a, {_TB} AS b FROM part)")
def _(t):
    a, b = keys.name_tokens(F.col("p_name")), keys.name_tokens(F.concat(F.split_part("p_name", F.lit(" "), F.lit(2)), F.col("p_type"), F.lit(" "), F.col("p_type")))
    return t.part.select("p_partkey", a.alias("a"), b.alias("b")).select("p_partkey", F.round(keys.name_overlap(F.col("a"), F.col("b")), 6).alias("overlap"))


@query("F19_address_agrees", f"SELECT c_custkey, contains(upper(concat(cast(c_custkey % 50 as varchar), ' HOUSEHOLD Ave')), regexp_extract({s.ADDRESS}, '^\\s*(\\d+)\\s+([A-Za-z]+)', 1)) AND contains(upper(concat(cast(c_custkey % 50 as varchar), ' HOUSEHOLD Ave')), upper(regexp_extract({s.ADDRESS}, '^\\s*(\\d+)\\s+([A-Za-z]+)', 2))) AS agrees FROM customer")
def _(t):
    return t.customer.select("c_custkey", keys.address_agrees(E(s.ADDRESS), F.concat((F.col("c_custkey") % 50).cast("string"), F.lit(" HOUSEHOLD Ave"))).alias("agrees"))


@query("F20_label_color", """WITH h AS (SELECT DISTINCT p_type AS label, (('0x' || substr(md5(p_type), 1, 8))::BIGINT % 360)::DOUBLE AS hue FROM part),
c AS (SELECT label, hue, (1 - abs(2 * 0.42::DOUBLE - 1)) * 0.58::DOUBLE AS c FROM h), x AS (SELECT *, c * (1 - abs((hue / 60) % 2 - 1)) AS x, 0.42::DOUBLE - c / 2 AS m, floor(hue / 60)::INT + 1 AS k FROM c)
SELECT label, '#' || lower(printf('%02x%02x%02x', trunc(([c, x, 0, 0, x, c][k] + m) * 255)::INT, trunc(([x, c, c, x, 0, 0][k] + m) * 255)::INT, trunc(([0, 0, x, c, c, x][k] + m) * 255)::INT)) AS color FROM x""")
def _(t):
    return t.part.select(F.col("p_type").alias("label")).distinct().select("label", keys.label_color(F.col("label")).alias("color"))


_HOST = "regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^www\\.', '')"


@query("F21_url_host_tier", f"SELECT page_id, {_HOST} AS host, CASE WHEN contains(lower(u), 'instagram.com') THEN 2 WHEN contains(lower(u), 'yelp.com') THEN 3 WHEN u = '' THEN 4 ELSE 1 END AS tier FROM (SELECT page_id, url, CASE page_id % 4 WHEN 0 THEN concat(url, '/instagram.com') WHEN 1 THEN concat(url, '/YELP.com') WHEN 2 THEN '' ELSE url END AS u FROM pages)")
def _(t):
    u = E("CASE page_id % 4 WHEN 0 THEN concat(url, '/instagram.com') WHEN 1 THEN concat(url, '/YELP.com') WHEN 2 THEN '' ELSE url END")
    return t.pages.select("page_id", keys.url_host(F.col("url")).alias("host"), keys.website_tier(u).alias("tier"))


@query("F22_best_website", """SELECT page_id, CASE page_id % 4 WHEN 0 THEN concat(url, '/v') WHEN 1 THEN url WHEN 2 THEN concat(url, '/v') ELSE concat(url, '/instagram.com') END AS site,
CASE page_id % 4 WHEN 0 THEN 'verify' WHEN 1 THEN 'places' WHEN 2 THEN 'verify' ELSE 'places-social' END AS site_source FROM pages""")
def _(t):
    p = E("CASE page_id % 4 WHEN 0 THEN concat(url, '/instagram.com') WHEN 1 THEN url WHEN 2 THEN concat(url, '/goo.gl/maps') ELSE concat(url, '/instagram.com') END")
    v = E("CASE page_id % 4 WHEN 0 THEN concat(url, '/v') WHEN 1 THEN concat(url, '/v') WHEN 2 THEN concat(url, '/v') END")
    return t.pages.select("page_id", keys.best_website(p, v).alias("b")).select("page_id", F.col("b.url").alias("site"), F.col("b.source").alias("site_source"))


@query("F23_extract_socials", "SELECT page_id, concat('shop', cast(page_id as varchar)) AS instagram, CASE WHEN page_id % 2 = 0 THEN 'abc' END AS x, concat('fb.', cast(page_id as varchar)) AS facebook FROM pages")
def _(t):
    body = E("concat(html, ' instagram.com/p/1 instagram.com/explore/ instagram.com/.shop', cast(page_id as string), './ twitter.com/intent?x ', case when page_id % 2 = 0 then 'x.com/abc#' else '' end, ' facebook.com/sharer? facebook.com/fb.', cast(page_id as string), '/')")
    return t.pages.select("page_id", *[keys.first_handle(body, p).alias(p) for p in ("instagram", "x", "facebook")])


def _body_sql(x: str) -> str:
    """An element runs to its closing tag or, without one, to the end of the page; DuckDB takes elements of one name at a time."""
    elements = [rf"(?is)<{name}\b[^>]*>.*?(?:</{name}>|\z)" for name in ("script", "style")]
    x = functools.reduce(lambda out, p: f"regexp_replace({out}, '{p}', ' ', 'g')", [*elements, "<[^>]+>"], x)
    quoted = [[v.replace("'", "''") for v in pair] for pair in text.ENTITIES]
    x = functools.reduce(lambda out, pair: f"replace({out}, '{pair[0]}', '{pair[1]}')", quoted, x)
    for rule in text.style_rules():
        x = "regexp_replace({}, '{}', ' ', 'g')".format(x, rule.replace("'", "''"))
    return f"substr(trim(regexp_replace({x}, '\\s+', ' ', 'g')), 1, 2000)"


_TITLE = "substr(trim(regexp_extract(html, '<title[^>]*>(.*?)</title>', 1, 'is')), 1, 200)"


@query("F24_html_to_text", f"SELECT page_id, {_TITLE} AS title, {_body_sql('html')} AS body FROM pages")
def _(t):
    return t.pages.select("page_id", text.page_title(F.col("html")).alias("title"), text.page_body(F.col("html")).alias("body"))


_SHORT = "length({0}) < 150 OR length(regexp_replace({0}, '[^\\p{{L}}]', '', 'g'))::DOUBLE / length({0}) < 0.55"


@query("F25_too_short_to_judge", f"SELECT page_id, {_SHORT.format('body')} AS body_short, {_SHORT.format('title')} AS title_short FROM (SELECT page_id, {_body_sql('html')} AS body, {_TITLE} AS title FROM pages)")
def _(t):
    parts = t.pages.select("page_id", text.page_body(F.col("html")).alias("body"), text.page_title(F.col("html")).alias("title"))
    return parts.select("page_id", *[text.too_short_to_judge(F.col(c)).alias(f"{c}_short") for c in ("body", "title")])


@query("F26_menu_link", "SELECT page_id, CASE page_id % 3 WHEN 0 THEN '/our-menu' WHEN 1 THEN '/x' ELSE '/about' END AS link FROM pages")
def _(t):
    html = E("concat('<a href=\"/about\">us</a><a class=q HREF=''/our-menu''>see</a> <a href=\"http://else.example/menu\">Menu</a>', case when page_id % 3 = 1 then '<a href=\"/x\">The Menu</a>' else '' end, case when page_id % 3 > 0 then '' else '' end)")
    html = F.when(F.col("page_id") % 3 == 0, html).when(F.col("page_id") % 3 == 1, F.replace(html, F.lit("/our-menu"), F.lit("/zz"))).otherwise(F.replace(html, F.lit("/our-menu"), F.lit("/zz")))
    return t.pages.select("page_id", F.try_element_at(text.menu_links(html), F.lit(1))["href"].alias("link"))


@query("F27_parse_verdict_json", "SELECT event_id, coalesce(nullif(json_extract_string(props, '$.k'), ''), '0')::INT AS k, CASE WHEN event_id % 3 = 0 THEN 'yes' ELSE 'unclear' END AS operating FROM events")
def _(t):
    raw = F.concat(F.lit("```json\nsure: {\"operating\": \""), F.when(F.col("event_id") % 3 == 0, "yes").otherwise("perhaps"), F.lit("\", \"inner\": "), F.col("props"), F.lit("}\n```"))
    v = F.from_json(text.first_object(raw), "operating string, inner struct<k:int>")
    return t.events.select("event_id", v.alias("v")).select("event_id", F.coalesce("v.inner.k", F.lit(0)).alias("k"), F.when(F.col("v.operating").isin("yes", "no", "unclear"), F.col("v.operating")).otherwise("unclear").alias("operating"))


@query("F28_json_list_field", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_type WHEN event_id % 3 = 1 THEN concat(event_type, ',b') END AS labels FROM events")
def _(t):
    raw = E("case event_id % 3 when 0 then concat('{\"c\": \"', event_type, '\"}') when 1 then concat('{\"c\": [\"', event_type, '\", \"b\"]}') else '{}' end")
    return t.events.select("event_id", F.array_join(text.list_field(raw, "c"), ",").alias("labels"))


@query("F29_announcement_text", "SELECT doc_id, CASE WHEN length(f) > 280 THEN concat(rtrim(substr(f, 1, 279)), '…') ELSE f END AS post FROM (SELECT doc_id, concat_ws(chr(10), concat('New: ', source), nullif(trim(replace(text, chr(10), ' ')), ''), lang) AS f FROM documents)")
def _(t):
    body = F.replace("text", F.lit("\n"), F.lit(" "))
    return t.documents.select("doc_id", text.announcement([F.concat(F.lit("New: "), F.col("source")), body, F.lit(""), F.col("lang")]).alias("post"))


@query("F30_escape_html", "SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;') AS safe FROM pages")
def _(t):
    return t.pages.select("page_id", text.escape_html(F.col("html")).alias("safe"))


@query("F31_strip_unit_query_address", f"SELECT c_custkey, trim({s.ADDRESS}) AS street, trim(split_part({s.POSTAL_ADDRESS}, 'M', 1)) AS asked FROM customer")
def _(t):
    return t.customer.select("c_custkey", keys.strip_unit(F.concat(E(s.ADDRESS), F.lit(", unit 3"))).alias("street"), keys.query_address(E(s.POSTAL_ADDRESS)).alias("asked"))


@query("D01_parse_date_multi", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 4 THEN NULL ELSE o_orderdate::DATE END AS parsed FROM orders")
def _(t):
    d = F.col("o_orderdate")
    raw = F.when(F.col("o_orderkey") % 5 == 0, F.date_format(d, "yyyy-MM-dd")).when(F.col("o_orderkey") % 5 == 1, F.date_format(d, "yyyy/MM/dd")).when(F.col("o_orderkey") % 5 == 2, F.date_format(d, "MM/dd/yyyy")).when(F.col("o_orderkey") % 5 == 3, F.date_format(d, "yyyy-MM-dd'T'HH:mm:ss"))
    return t.orders.select("o_orderkey", dates.parse_date(F.coalesce(raw, F.lit("n/a"))).alias("parsed"))


@query("D02_days_open", f"SELECT o_orderkey, greatest(date_diff('day', o_orderdate::DATE, {s.AS_OF_SQL}), 0)::INT AS days_open FROM orders")
def _(t):
    return t.orders.select("o_orderkey", dates.days_open(F.col("o_orderdate"), s.AS_OF).alias("days_open"))


@query("D03_years_operating", f"SELECT o_orderkey, round_even(date_diff('day', o_orderdate::DATE, {s.AS_OF_SQL}) / 365.25::DOUBLE, 1) + 0.0::DOUBLE AS years, round_even(date_diff('day', o_orderdate::DATE, {s.AS_OF_SQL}) / 365.25::DOUBLE, 0)::INT AS whole_years FROM orders")
def _(t):
    return t.orders.select("o_orderkey", dates.years_operating(F.col("o_orderdate"), s.AS_OF).cast("double").alias("years"), dates.years_operating(F.col("o_orderdate"), s.AS_OF, 0).cast("int").alias("whole_years"))


@query("D04_ago_label", f"""SELECT o_orderkey, CASE WHEN d <= 1 THEN 'today' WHEN d <= 60 THEN concat(d, 'd ago') WHEN d <= 365 THEN concat(round_even(d / 30.0::DOUBLE, 0)::INT, 'mo ago') ELSE concat(printf('%.1f', round_even(d / 365.0::DOUBLE, 1)), 'y ago') END AS ago,
CASE WHEN d <= 1 THEN 'today' WHEN d < 14 THEN concat(d, 'd') ELSE concat(d // 7, 'w') END AS licensed FROM (SELECT o_orderkey, greatest(date_diff('day', o_orderdate::DATE, {s.AS_OF_SQL}), 0)::INT AS d FROM orders)""")
def _(t):
    d = dates.days_open(F.col("o_orderdate"), s.AS_OF)
    return t.orders.select("o_orderkey", dates.ago_label(d).alias("ago"), dates.licensed_label(d).alias("licensed"))


@query("D05_latest_of_two", f"SELECT o_orderkey, greatest(o_orderdate::DATE, {s.CANCEL}) AS latest FROM orders")
def _(t):
    return t.orders.select("o_orderkey", dates.latest(F.col("o_orderdate").cast("date"), E(s.CANCEL)).alias("latest"))


@query("D06_age_days_due", """SELECT event_id, coalesce(CASE WHEN event_type = 'view' THEN age >= CASE user_id % 5 WHEN 1 THEN 180 WHEN 2 THEN 30 WHEN 3 THEN 14 WHEN 4 THEN 14 END WHEN event_type = 'click' THEN age >= 60 WHEN event_type = 'error' THEN age >= 7 END, true) AS due
FROM (SELECT *, date_diff('day', ts::DATE, DATE '2024-02-15') AS age FROM events)""")
def _(t):
    verdict = F.when(F.col("event_type") == "view", "yes").when(F.col("event_type") == "click", "no").when(F.col("event_type") == "error", "unclear")
    return t.events.select("event_id", dates.due(F.col("ts"), verdict, F.col("user_id") % 5, dt.datetime(2024, 2, 15)).alias("due"))


@query("M01_units_waterfall", """SELECT p_partkey, CASE WHEN p_size % 7 = 0 OR p_type = 'PROMO' THEN 0 WHEN p_size > 40 THEN p_size WHEN p_size > 20 THEN greatest(floor(p_size / 10.0::DOUBLE * p_retailprice / 85.0::DOUBLE), 1) ELSE 3 END::BIGINT AS units,
CASE WHEN p_size % 7 = 0 THEN 'unzoned' WHEN p_type = 'PROMO' THEN 'not residential' WHEN p_size > 40 THEN 'explicit' WHEN p_size > 20 THEN 'fsi' ELSE 'class default' END AS basis FROM part""")
def _(t):
    size = F.col("p_size")
    u = mathx.units_waterfall(size % 7 != 0, F.col("p_type") != "PROMO", F.when(size > 40, size), F.when(size > 20, size / F.lit(10.0)), F.col("p_retailprice"), F.lit(3))
    return t.part.select("p_partkey", u.alias("u")).select("p_partkey", "u.units", "u.basis")


@query("M02_structure_waterfall", """SELECT p_partkey, CASE WHEN p_size < 4 THEN 'vacant' WHEN p_retailprice > 1500 THEN 'row' WHEN p_size % 3 = 0 THEN 'detached' WHEN p_size % 3 = 1 THEN 'semi' ELSE 'unknown' END AS type,
CASE WHEN p_size % 3 = 0 THEN 'permit' WHEN p_size % 3 = 1 THEN 'survey' ELSE 'none' END AS type_source FROM part""")
def _(t):
    size = F.col("p_size")
    w = mathx.structure_waterfall([("permit", F.when(size % 3 == 0, F.lit("detached"))), ("survey", F.when(size % 3 <= 1, F.lit("semi")))], [(F.col("p_retailprice") > 1500, "row"), (size < 4, "vacant")])
    return t.part.select("p_partkey", w.alias("w")).select("p_partkey", "w.type", F.col("w.source").alias("type_source"))


@query("M03_existing_units", """SELECT p_partkey, CASE WHEN p_type = 'PROMO' THEN 0 WHEN p_size % 5 = 0 THEN p_size WHEN p_size % 2 = 1 THEN greatest(floor(least(greatest(round_even(p_size / 3.0::DOUBLE, 0), 1), 20) * p_retailprice / 90.0::DOUBLE), 1) WHEN p_size >= 12 THEN 8 WHEN p_size >= 9 THEN 3 ELSE 1 END::BIGINT AS units,
CASE WHEN p_type = 'PROMO' THEN 'vacant' WHEN p_size % 5 = 0 THEN 'permits' WHEN p_size % 2 = 1 THEN 'height' ELSE 'band' END AS basis FROM part""")
def _(t):
    size = F.col("p_size")
    u = mathx.existing_units(F.col("p_type") == "PROMO", F.when(size % 5 == 0, size), size.cast("double"), F.when(size % 2 == 1, F.col("p_retailprice")))
    return t.part.select("p_partkey", u.alias("u")).select("p_partkey", "u.units", "u.basis")


@query("M04_parcel_flags", "SELECT p_partkey, 1930 + p_size BETWEEN 1945 AND 1960 AND p_type <> 'PROMO' AS postwar, p_brand < 'Brand#2' AND p_size >= 15 AS back_lot, 2 * p_retailprice AS bonus FROM part")
def _(t):
    flags = mathx.parcel_flags(F.lit(1930) + F.col("p_size"), F.col("p_type") != "PROMO", F.col("p_brand") < "Brand#2", F.col("p_size"), F.col("p_retailprice"))
    return t.part.select("p_partkey", *[c.alias(n) for n, c in flags.items()])


@query("M05_weighted_score", """SELECT p_partkey, round_even(least(greatest(0.0::DOUBLE + solar * (0.2::DOUBLE / 1.0::DOUBLE) + least(canopy * 2, 100) * (0.2::DOUBLE / 1.0::DOUBLE) + walk * (0.1::DOUBLE / 1.0::DOUBLE) + transit * (0.2::DOUBLE / 1.0::DOUBLE) + bike * (0.1::DOUBLE / 1.0::DOUBLE) + head * (0.2::DOUBLE / 1.0::DOUBLE), 0), 100), 8) AS score
FROM (SELECT p_partkey, (p_size * 2)::DOUBLE AS solar, p_size::DOUBLE AS canopy, (p_partkey % 101)::DOUBLE AS walk, (p_partkey % 97)::DOUBLE AS transit, (p_partkey % 89)::DOUBLE AS bike, least(greatest((p_retailprice / (p_size * 20.0::DOUBLE) - 1) * 50, 0), 100) AS head FROM part)""")
def _(t):
    k = F.col("p_partkey")
    parts = {"solar": (F.col("p_size") * 2).cast("double"), "canopy": F.col("p_size").cast("double"), "walk": (k % 101).cast("double"), "transit": (k % 97).cast("double"), "bike": (k % 89).cast("double")}
    weights = {"solar": 0.2, "canopy": 0.2, "walk": 0.1, "transit": 0.2, "bike": 0.1, "headroom": 0.2}
    return t.part.select("p_partkey", mathx.weighted_score(parts, weights, F.col("p_size") * 20.0, F.col("p_retailprice"), 8).alias("score"))


@query("M06_solar_score", "SELECT p_partkey, p_retailprice / 1150 AS kw, CASE WHEN p_size % 4 > 0 THEN round_even(least(greatest(p_retailprice * 100 / 1800.0::DOUBLE, 0), 100) * (p_size / 50.0::DOUBLE), 5) END AS solar FROM part")
def _(t):
    return t.part.select("p_partkey", (F.col("p_retailprice") / 1150).alias("kw"), mathx.solar_score(F.col("p_retailprice"), F.lit(1800.0), F.when(F.col("p_size") % 4 > 0, F.col("p_size") / F.lit(50.0)), 5).alias("solar"))


@query("M07_pct_guard", "SELECT p_partkey, CASE WHEN p_size % 3 > 0 THEN round_even((p_size % 5) * 100.0::DOUBLE / (p_size % 3), 1) END AS pct FROM part")
def _(t):
    return t.part.select("p_partkey", mathx.pct(F.col("p_size") % 5, F.col("p_size") % 3).alias("pct"))


@query("M08_resolve_height", "SELECT p_partkey, CASE WHEN p_size % 5 - 2 > 0 THEN p_size % 5 - 2 WHEN p_size % 3 > 0 THEN p_size % 3 END AS height FROM part")
def _(t):
    return t.part.select("p_partkey", mathx.resolve_height(F.col("p_size") % 5 - 2, F.col("p_size") % 3).alias("height"))


@query("M09_event_cost", """SELECT event_id, round(coalesce(CASE WHEN event_id % 5 = 0 THEN value END, user_id * coalesce(p.price, 0)), 6) AS cost, round_even((user_id * (1.0::DOUBLE / 1e6) + event_id * (5.0::DOUBLE / 1e6) + 2 * 0.01::DOUBLE) * 0.5::DOUBLE, 9) AS token_cost
FROM events LEFT JOIN (VALUES ('view', 0.017::DOUBLE), ('click', 0.005::DOUBLE)) p(sku, price) ON sku = event_type""")
def _(t):
    prices = t.spark.createDataFrame([("view", 0.017), ("click", 0.005)], "sku string, price double")
    e = t.events.join(F.broadcast(prices), F.col("event_type") == F.col("sku"), "left")
    cost = F.coalesce(F.when(F.col("event_id") % 5 == 0, F.col("value")), F.col("user_id") * F.coalesce("price", F.lit(0.0)))
    return e.select("event_id", F.round(cost, 6).alias("cost"), mathx.token_cost(F.col("user_id"), F.col("event_id"), F.lit(2), 1.0, 5.0, 0.01, True, 9).alias("token_cost"))
