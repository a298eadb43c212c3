"""Queries behind the console and the feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import webtext as w
from ..operators import console as c
from ..operators import feeds
from .registry import registry, rounded
from .views import VIEWS, view

QUERIES, ORACLES, query = registry()

VIEWS["v_found"] = "SELECT l_orderkey AS batch, l_linenumber AS pos, CASE l_partkey % 11 WHEN 0 THEN 'CVE' WHEN 1 THEN 'IP' WHEN 2 THEN 'HASH' WHEN 3 THEN 'EMAIL' WHEN 4 THEN 'URL' WHEN 5 THEN 'MONEY' WHEN 6 THEN 'DATE' WHEN 7 THEN 'GEO' WHEN 8 THEN 'ORG' WHEN 9 THEN 'PERSON' ELSE 'EVENT' END AS kind, concat('Name ', CAST(l_partkey % 97 AS STRING)) AS value, round(1 - l_discount * 8, 2) AS confidence, l_suppkey % 5 + 1 AS count, l_suppkey AS source, CAST(l_quantity AS BIGINT) AS quantity FROM {lineitem}"


@query("p11_confidence_floors", "SELECT kind, count(*) AS n FROM v_found WHERE confidence >= CASE kind WHEN 'PERSON' THEN 0.35 WHEN 'ORG' THEN 0.25 WHEN 'GEO' THEN 0.2 WHEN 'EVENT' THEN 0.2 ELSE 0.3 END GROUP BY 1")
def p11(spark: SparkSession, sf: str) -> DataFrame:
    return c.confident(view(spark, sf, "v_found")).groupBy("kind").agg(F.count("*").alias("n"))


@query("p10_relevant_items", "WITH h AS (SELECT *, contains(lower(title), 'onthe') OR contains(lower(title), 'thein') AS hit FROM v_feed) SELECT item_id FROM h WHERE hit OR (SELECT count(*) FROM h WHERE hit) < 3")
def p10(spark: SparkSession, sf: str) -> DataFrame:
    return c.relevant_items(view(spark, sf, "v_feed"), ["onthe", "thein"]).select("item_id")


@query("a11_model_entities", "SELECT kind, lower(trim(value)) AS low, CAST(sum(count) AS BIGINT) AS count, max(confidence) AS confidence FROM v_found WHERE count >= 1 AND confidence BETWEEN 0 AND 1 GROUP BY 1, 2")
def a11(spark: SparkSession, sf: str) -> DataFrame:
    return c.model_entities(view(spark, sf, "v_found").withColumnRenamed("value", "name"), [])


@query("a13_confidence_histogram", "WITH b AS (SELECT CAST(least(floor(confidence * 10), 9) AS INTEGER) AS bin, count(*) AS n FROM v_found WHERE confidence BETWEEN 0 AND 1 GROUP BY 1) SELECT CAST(r AS INTEGER) AS bin, coalesce(n, 0) AS n FROM range(10) t(r) LEFT JOIN b ON bin = r")
def a13(spark: SparkSession, sf: str) -> DataFrame:
    return c.equal_bins(view(spark, sf, "v_found"), "confidence")


@query("a13_uneven_bins", "SELECT CASE WHEN confidence < 0.3 THEN '<.3' WHEN confidence < 0.5 THEN '.3-.5' WHEN confidence < 0.7 THEN '.5-.7' WHEN confidence < 0.9 THEN '.7-.9' ELSE '>=.9' END AS bin, count(*) AS n FROM v_found GROUP BY 1")
def a13u(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "v_found").groupBy(c.uneven_bins(F.col("confidence")).alias("bin")).agg(F.count("*").alias("n"))


_S = "coalesce(sum(count) FILTER (kind = '{}'), 0)"


@query("a14_threat_level", f"""WITH l AS (SELECT batch AS grp, CAST(least(100, floor((10 * {_S.format('CVE')} + 5 * {_S.format('IP')} + 8 * {_S.format('HASH')} + 2 * {_S.format('EMAIL')}) / 2.0 + 0.5)) AS INTEGER) AS level FROM v_found GROUP BY 1)
    SELECT grp, level, CASE WHEN level < 25 THEN 'low' WHEN level < 50 THEN 'guarded' WHEN level < 75 THEN 'elevated' ELSE 'severe' END AS band FROM l""")
def a14(spark: SparkSession, sf: str) -> DataFrame:
    return c.threat_level(view(spark, sf, "v_found").withColumn("grp", F.col("batch")), ["grp"])


@query("a15_threat_profile", f"""WITH s AS (SELECT 4 * {_S.format('CVE')} + 3 * {_S.format('IP')} + 5 * {_S.format('HASH')} AS a, 2 * {_S.format('PERSON')} + 3 * {_S.format('EMAIL')} AS b, 3 * {_S.format('GEO')} AS c, 2 * {_S.format('ORG')} + {_S.format('DATE')} + 2 * {_S.format('MONEY')} AS d, 4 * {_S.format('EVENT')} AS e, 2 * {_S.format('URL')} AS f FROM v_found),
    u AS (SELECT unnest(['CYBER', 'SURV', 'GEO', 'INTEL', 'SITUATION', 'NETWORK']) AS axis, unnest([a, b, c, d, e, f]) AS v, greatest(1, a, b, c, d, e, f) AS m FROM s) SELECT axis, CAST(floor(100.0 * v / m + 0.5) AS INTEGER) AS score FROM u""")
def a15(spark: SparkSession, sf: str) -> DataFrame:
    return c.threat_profile(view(spark, sf, "v_found"), [])


@query("a16_kind_scatter", "SELECT kind, CAST(floor(100 * avg(confidence) + 0.5) AS INTEGER) AS confidence, count(*) AS n FROM v_found GROUP BY 1")
def a16(spark: SparkSession, sf: str) -> DataFrame:
    return c.kind_scatter(view(spark, sf, "v_found"))


@query("a17_source_mix", "SELECT source, CAST(sum(items) AS BIGINT) AS items FROM v_fetch GROUP BY 1")
def a17(spark: SparkSession, sf: str) -> DataFrame:
    return c.source_mix(view(spark, sf, "v_fetch"))


@query("a18_source_health", "WITH s AS (SELECT source, avg(latency) AS l, arg_max(ok, (ts, event_id)) AS ok FROM v_fetch GROUP BY 1) SELECT source, round(l, 6) AS latency, ok, CASE WHEN l < 300 THEN 'live' WHEN l < 900 THEN 'slow' ELSE 'degraded' END AS band FROM s")
def a18(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(c.source_health(view(spark, sf, "v_fetch")))


@query("a19_activity_matrix", "WITH n AS (SELECT CAST(dayofweek(ts) AS INTEGER) AS day, CAST(hour(ts) AS INTEGER) AS hour, count(*) AS n FROM v_fetch GROUP BY 1, 2) SELECT CAST(r // 24 AS INTEGER) AS day, CAST(r % 24 AS INTEGER) AS hour, coalesce(n, 0) AS n FROM range(168) t(r) LEFT JOIN n ON day = r // 24 AND hour = r % 24")
def a19(spark: SparkSession, sf: str) -> DataFrame:
    return c.activity_matrix(view(spark, sf, "v_fetch"))


@query("a20_funnel", "SELECT count(*) AS crawled, count(*) FILTER (items > 0) AS with_entities, count(*) FILTER (items > 0 AND ok) AS extracted, count(*) FILTER (items > 0 AND ok AND latency >= 7) AS confident FROM v_fetch")
def a20(spark: SparkSession, sf: str) -> DataFrame:
    return c.funnel(view(spark, sf, "v_fetch"), F.col("latency") >= 7)


_KINDS = ", ".join(f"'{k}'" for k in c.KINDS)


@query("j12_dense_grid", f"WITH n AS (SELECT source, kind, count(*) AS n FROM v_found GROUP BY 1, 2), g AS (SELECT DISTINCT source FROM n) SELECT g.source, k AS kind, coalesce(n, 0) AS n FROM g CROSS JOIN (SELECT unnest([{_KINDS}]) AS k) LEFT JOIN n ON n.source = g.source AND n.kind = k")
def j12(spark: SparkSession, sf: str) -> DataFrame:
    return c.dense_grid(view(spark, sf, "v_found"), "source", "kind", c.KINDS)


@query("a21_source_kind_intensity", "WITH n AS (SELECT source, kind, count(*) AS n FROM v_found GROUP BY 1, 2) SELECT *, round(CAST(n AS DOUBLE) / greatest(max(n) OVER (PARTITION BY source), 1), 6) AS intensity FROM n")
def a21(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(c.row_intensity(view(spark, sf, "v_found").groupBy("source", "kind").agg(F.count("*").alias("n")), "source"))


@query("a23_fusion", """WITH s AS (SELECT o_custkey AS k, count(DISTINCT o_orderpriority) AS sources, count(*) * 5 AS items, count(*) AS entities, count(*) FILTER (o_orderstatus = 'P') AS leads, count(*) % 4 AS places, count(*) % 3 AS arcs, count(*) FILTER (o_totalprice > 499000) AS urgent, CASE o_custkey % 3 WHEN 0 THEN 'TITAN' WHEN 1 THEN 'Finance' ELSE 'Maritime' END AS posture FROM orders GROUP BY 1),
    r AS (SELECT *, CAST(floor(least(94, round(38 + 20 * least(1, sources / 3.0) + 14 * least(1, items / 45.0) + 10 * least(1, entities / 18.0) + 8 * least(1, leads / 4.0) + 10 * least(1, (places + arcs) / 14.0) + 100 * (least(0.08, 0.04 * urgent) + CASE WHEN posture = 'TITAN' AND least(1, (places + arcs) / 14.0) > 0.5 THEN 0.04 WHEN posture = 'Finance' AND leads > 0 THEN 0.03 ELSE 0 END), 9)) + 0.5) AS INTEGER) AS confidence FROM s)
    SELECT k, confidence, CASE WHEN confidence >= 78 OR urgent > 0 THEN 'escalate' WHEN confidence >= 60 THEN 'triage' ELSE 'watch' END AS band, CASE WHEN sources >= 3 THEN 'satisfied' WHEN sources >= 2 THEN 'partial' ELSE 'open' END AS corroboration,
      CASE WHEN entities > 0 OR leads > 0 THEN 'satisfied' ELSE 'partial' END AS continuity, CASE WHEN places > 0 THEN 'satisfied' ELSE 'open' END AS anchoring, CASE WHEN leads > 0 THEN 'partial' ELSE 'open' END AS provenance FROM r""")
def a23(spark: SparkSession, sf: str) -> DataFrame:
    n = F.count("*")
    o = view(spark, sf, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.countDistinct("o_orderpriority").alias("sources"), (n * 5).alias("items"), n.alias("entities"), F.count_if(F.col("o_orderstatus") == "P").alias("leads"), (n % 4).alias("places"), (n % 3).alias("arcs"), F.count_if(F.col("o_totalprice") > 499000).alias("urgent"))
    posture = F.when(F.col("k") % 3 == 0, "TITAN").when(F.col("k") % 3 == 1, "Finance").otherwise("Maritime")
    return c.fusion(o.withColumn("posture", posture)).select("k", "confidence", "band", "corroboration", "continuity", "anchoring", "provenance")


_GAZ = [("name 1", 10.0, 20.0, 0), ("name 12", 11.0, 21.0, 1), ("me 3", 12.0, 22.0, 2)]
_GAZ_SQL = "(VALUES " + ", ".join(f"('{n}', {a}, {b}, {i})" for n, a, b, i in _GAZ) + ") g(name, lat, lon, ord)"


def gazetteer(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_GAZ, "name string, lat double, lon double, ord int")


_PIN = f"""f AS (SELECT lower(value) AS low, CAST(sum(count) AS BIGINT) AS count, max(confidence) AS confidence FROM v_found WHERE kind = 'GEO' GROUP BY 1),
    p AS (SELECT low, arg_min((lat, lon), (low <> name, ord)) AS p FROM (SELECT DISTINCT low FROM f) JOIN {_GAZ_SQL} ON low = name OR contains(low, name) OR contains(name, low) GROUP BY 1)"""


@query("a24_map_pins", f"WITH {_PIN} SELECT f.low, count, confidence, CAST(p[1] AS DOUBLE) AS lat, CAST(p[2] AS DOUBLE) AS lon FROM f JOIN p USING (low)")
def a24(spark: SparkSession, sf: str) -> DataFrame:
    return c.map_pins(view(spark, sf, "v_found"), gazetteer(spark))


@query("j8_gazetteer_partial", f"WITH {_PIN} SELECT low, CAST(p[1] AS DOUBLE) AS lat, CAST(p[2] AS DOUBLE) AS lon FROM p")
def j8(spark: SparkSession, sf: str) -> DataFrame:
    names = view(spark, sf, "v_found").where("kind = 'GEO'").select(F.lower("value").alias("low")).distinct()
    return c.located(names, gazetteer(spark), "low").select("low", "lat", "lon")


@query("j7_gazetteer_exact", "WITH g AS (SELECT trim(regexp_replace(lower(n_name), '[^a-z0-9]+', ' ', 'g')) AS n, CAST(n_nationkey AS DOUBLE) AS lat FROM nation) SELECT c_custkey AS id, CASE WHEN c_acctbal / 100 BETWEEN -90 AND 90 THEN round(c_acctbal / 100, 6) ELSE round(g.lat, 6) END AS lat FROM customer LEFT JOIN g ON n = 'nation ' || c_nationkey")
def j7(spark: SparkSession, sf: str) -> DataFrame:
    known = view(spark, sf, "nation").select(F.upper("n_name").alias("name"), F.col("n_nationkey").cast("double").alias("lat"), F.lit(0.0).alias("lon"))
    places = view(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit("Nation-"), F.col("c_nationkey").cast("string")).alias("name"), (F.col("c_acctbal") / 100).alias("lat"), F.lit(1.0).alias("lon"))
    return rounded(c.stored_or_gazetteer(places, known).select("id", "lat"))


@query("a28_dossier_confidence", "SELECT o_custkey AS k, CAST(least(94, 42 + 8 * count(*) FILTER (o_orderstatus = 'F') + 2 * count(*) FILTER (o_orderstatus = 'O') + count(DISTINCT o_orderpriority) + CASE WHEN o_custkey % 2 = 0 THEN 12 ELSE 0 END) AS BIGINT) AS confidence FROM orders GROUP BY 1")
def a28(spark: SparkSession, sf: str) -> DataFrame:
    o = view(spark, sf, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count_if(F.col("o_orderstatus") == "F").alias("h"), F.count_if(F.col("o_orderstatus") == "O").alias("m"), F.countDistinct("o_orderpriority").alias("e"))
    return o.select("k", c.dossier_confidence(F.col("h"), F.col("m"), F.col("e"), F.col("k") % 2 == 0).cast("bigint").alias("confidence"))


_OK = "WITH o AS (SELECT *, row_number() OVER w AS k, epoch_us(ts) - min(epoch_us(ts)) OVER l AS us, count(*) OVER l AS c FROM v_fetch WHERE ok WINDOW w AS (PARTITION BY source ORDER BY ts, event_id), l AS (PARTITION BY source ORDER BY ts, event_id ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)), v AS (SELECT *, CASE WHEN c >= 2 THEN floor(c / (CASE WHEN us = 0 THEN 1 ELSE us / 60e6 END) * 10 + 0.5) / 10 END AS velocity FROM o)"


@query("w4_velocity", f"{_OK} SELECT event_id, source, velocity, coalesce(count(velocity) OVER b >= 4 AND avg(velocity) OVER b > 0.5 AND velocity > 3 * avg(velocity) OVER b, false) AS anomaly FROM v WINDOW b AS (PARTITION BY source ORDER BY ts, event_id ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING)")
def w4(spark: SparkSession, sf: str) -> DataFrame:
    return c.velocity(view(spark, sf, "v_fetch"), "source").select("event_id", "source", "velocity", "anomaly")


@query("w5_timeline", "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS bucket, count(*) FILTER (source = 'click') AS click, count(*) FILTER (source = 'view') AS view, count(*) FILTER (source = 'error') AS error FROM v_fetch GROUP BY 1 ORDER BY 1 DESC LIMIT 20")
def w5(spark: SparkSession, sf: str) -> DataFrame:
    return c.timeline(view(spark, sf, "v_fetch"), "source", ["click", "view", "error"], 20, F.col("ts").cast("date").cast("string"))


_COOL = """, o AS (SELECT DISTINCT source, sec FROM h), n AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY sec) AS i FROM o),
    r AS (SELECT source, sec, i, sec AS last, true AS hit FROM n WHERE i = 1 UNION ALL SELECT n.source, n.sec, n.i, CASE WHEN n.sec - r.last > {0} THEN n.sec ELSE r.last END, n.sec - r.last > {0} FROM r JOIN n ON n.source = r.source AND n.i = r.i + 1) SELECT source, sec FROM r WHERE hit"""


@query("w9_rate_spikes", """WITH RECURSIVE s AS (SELECT source, CAST(floor(epoch(ts)) AS BIGINT) AS sec FROM v_fetch), h AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY source ORDER BY sec RANGE BETWEEN 3599 PRECEDING AND CURRENT ROW) AS c FROM s) WHERE c >= 8)""" + _COOL.format(7200))
def w9(spark: SparkSession, sf: str) -> DataFrame:
    return c.rate_spikes(view(spark, sf, "v_fetch"), "source", within=3600, least=8, cool=7200).select("source", "sec")


@query("w9_bursts", """WITH RECURSIVE h AS (SELECT source, CAST(floor(epoch(ts)) AS BIGINT) AS sec FROM v_fetch WHERE items >= 25)""" + _COOL.format(5400))
def w9b(spark: SparkSession, sf: str) -> DataFrame:
    return c.bursts(view(spark, sf, "v_fetch"), "source", 25, 5400).select("source", "sec")


@query("w10_first_sightings", """WITH d AS (SELECT DISTINCT batch, pos, kind, value, confidence, row_number() OVER (PARTITION BY batch, pos ORDER BY value, kind) AS u FROM v_found), e AS (SELECT * FROM d WHERE u = 1),
    t AS (SELECT kind, value, batch FROM (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY pos) AS k FROM e WHERE kind IN ('CVE', 'IP', 'HASH', 'EMAIL')) WHERE k <= 3 UNION ALL SELECT kind, value, batch FROM (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY pos) AS k FROM e WHERE kind = 'GEO' AND confidence >= 0.75) WHERE k = 1)
    SELECT kind, value, min(batch) AS batch, CASE kind WHEN 'CVE' THEN 'critical' WHEN 'GEO' THEN 'info' ELSE 'high' END AS severity FROM t GROUP BY 1, 2""")
def w10(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql.window import Window

    one = F.row_number().over(Window.partitionBy("batch", "pos").orderBy("value", "kind"))
    return c.first_sightings(view(spark, sf, "v_found").select("batch", "pos", "kind", "value", "confidence").withColumn("u", one).where("u = 1"))


@query("t8_alerts", "SELECT event_id AS id, event_type AS severity FROM (SELECT event_id, CASE event_type WHEN 'error' THEN 'critical' WHEN 'click' THEN 'low' ELSE 'info' END AS event_type, ts FROM events) ORDER BY CASE event_type WHEN 'critical' THEN 0 WHEN 'low' THEN 3 ELSE 4 END, ts DESC, event_id LIMIT 80")
def t8(spark: SparkSession, sf: str) -> DataFrame:
    severity = F.when(F.col("event_type") == "error", "critical").when(F.col("event_type") == "click", "low").otherwise("info")
    return c.by_severity(view(spark, sf, "events").select(F.col("event_id").alias("id"), severity.alias("severity"), F.col("ts").alias("at"))).select("id", "severity")


@query("t9_primary_entity", "WITH e AS (SELECT batch, pos, kind, value, row_number() OVER (PARTITION BY batch ORDER BY CASE WHEN contains('about name 7', lower(value)) THEN 0 WHEN kind = 'EVENT' THEN 1 WHEN kind IN ('ORG', 'CVE', 'GEO') THEN 2 ELSE 3 END, pos, value) AS k FROM v_found) SELECT batch, value FROM e WHERE k = 1")
def t9(spark: SparkSession, sf: str) -> DataFrame:
    e = view(spark, sf, "v_found").withColumn("pos", F.struct("pos", "value"))
    return c.primary_entity(e, ["batch"], "about Name 7").select("batch", "value")


@query("t7_top_entities", "SELECT lower(value) AS low, CAST(sum(count) AS BIGINT) AS count FROM v_found GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def t7(spark: SparkSession, sf: str) -> DataFrame:
    return c.top_entities(view(spark, sf, "v_found"))


@query("u1_merged_feeds", """WITH k AS (SELECT *, regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) || regexp_extract(url, '^[a-z]+://[^/?#]*(/[^?#]*)', 1)), '/$', '') AS key FROM v_feed)
    SELECT item_id, source, key FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY CASE source WHEN 's2' THEN 1 WHEN 's0' THEN 2 ELSE 3 END, item_id) AS r FROM k) WHERE r = 1""")
def u1(spark: SparkSession, sf: str) -> DataFrame:
    return feeds.merged(view(spark, sf, "v_feed"), ["s2", "s0"]).select("item_id", "source", "key")


@query("u4_live_buffer", "SELECT event_id FROM events WHERE event_id % 3 <> 0 ORDER BY ts DESC, event_id LIMIT 100")
def u4(spark: SparkSession, sf: str) -> DataFrame:
    e = view(spark, sf, "events")
    return feeds.buffered(e.where("event_id % 3 = 0"), e, 100).select("event_id")


@query("a27_feed_metrics", "WITH f AS (SELECT source, count(*) AS scanned, round(avg(published), 6) AS latency, bool_and(item_id % 97 <> 1) AS ok, count(*) FILTER (item_id % 2 = 0) AS count FROM v_feed GROUP BY 1) SELECT source, scanned, latency, ok, count FROM f")
def a27(spark: SparkSession, sf: str) -> DataFrame:
    f = view(spark, sf, "v_feed")
    fetches = f.select("source", F.lit(1).cast("bigint").alias("scanned"), F.col("published").cast("double").alias("latency"), (F.col("item_id") % 97 != 1).alias("ok"))
    return rounded(feeds.source_metrics(f.where("item_id % 2 = 0"), fetches))


@query("j14_absent_only", "SELECT n_name FROM nation WHERE n_regionkey <> 2")
def j14(spark: SparkSession, sf: str) -> DataFrame:
    n = view(spark, sf, "nation")
    return feeds.absent(n, n.where("n_regionkey = 2"), "n_name").select("n_name")


def _items(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "v_feed").withColumn("tags", F.array("source", F.lit("Thein news")))


_PL = "trim(regexp_replace(regexp_replace(lower({}), 'https?://', ' ', 'g'), '[^a-z0-9]+', ' ', 'g'))"
_REL = f"""WITH t AS (SELECT *, {_PL.format('title')} AS t, {_PL.format('url')} AS u, {_PL.format("source || ' Thein news'")} AS g FROM v_feed),
    m AS (SELECT *, list_filter(['onthe', 'thein', 'example'], lambda x: contains(t || ' ' || u || ' ' || g, x)) AS m, list_filter(['onthe', 'thein', 'example'], lambda x: contains(t, x)) AS mt, list_filter(['onthe', 'thein', 'example'], lambda x: contains(g, x)) AS mg FROM t),
    s AS (SELECT item_id, published, CAST(CASE WHEN contains(t, 'the onthe thein example') THEN 12 ELSE 0 END + 5 * len(mt) + 3 * len(mg) + 2 * len(m) + CASE WHEN len(m) = 3 THEN 4 ELSE 0 END + least(4, round(log10(greatest(1, length(u))))) AS INTEGER) AS score, contains(t, 'the onthe thein example') OR len(m) >= 3 AS relevant FROM m)"""


@query("f14_relevance", f"{_REL} SELECT item_id, score, relevant FROM s")
def f14(spark: SparkSession, sf: str) -> DataFrame:
    r = w.relevance(F.col("title"), F.col("url"), F.col("tags"), "the onthe AND thein example")
    return _items(spark, sf).select("item_id", r["score"].alias("score"), r["relevant"].alias("relevant"))


_EITHER = f"""WITH t AS (SELECT *, {_PL.format('title')} AS t, {_PL.format('url')} AS u, {_PL.format("source || ' Thein news'")} AS g FROM v_feed),
    m AS (SELECT *, list_filter(['example', 'erthe', 'org'], lambda x: contains(t || ' ' || u || ' ' || g, x)) AS m, list_filter(['example', 'erthe', 'org'], lambda x: contains(t, x)) AS mt, list_filter(['example', 'erthe', 'org'], lambda x: contains(g, x)) AS mg FROM t),
    s AS (SELECT item_id, published, CAST(CASE WHEN contains(t, 'example erthe org') THEN 12 ELSE 0 END + 5 * len(mt) + 3 * len(mg) + 2 * len(m) + CASE WHEN len(m) = 3 THEN 4 ELSE 0 END + least(4, round(log10(greatest(1, length(u))))) AS INTEGER) AS score, contains(t, 'example erthe org') OR len(m) > 0 AS relevant FROM m)"""


@query("t6_ranked_feed", f"{_EITHER} SELECT item_id, score FROM s WHERE relevant ORDER BY score DESC, published DESC, item_id LIMIT 20")
def t6(spark: SparkSession, sf: str) -> DataFrame:
    return feeds.ranked(_items(spark, sf), "example OR erthe OR org", 20).select("item_id", "score")


@query("f13_query_terms", f"SELECT item_id, array_to_string(list_distinct_ordered, ' ') AS terms FROM (SELECT item_id, list_sort(list_distinct(list_filter(string_split({_PL.format('title')}, ' '), lambda x: length(x) > 2 AND x NOT IN ({', '.join(repr(x) for x in w.QUERY_PLAIN)}, 'not')))) AS list_distinct_ordered FROM v_feed)")
def f13(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "v_feed").select("item_id", F.array_join(F.array_sort(w.query_terms(F.col("title"))), " ").alias("terms"))


_DOMAIN = "CASE " + " ".join("WHEN regexp_matches(lower(q), '\\b(" + words + ")\\b') THEN '" + name + "'" for name, words in w.DOMAINS) + " ELSE 'geopolitical' END"
#: Titles as queries, with a word of some domain at the end of most.
_QUERY_WORDS = ["virus outbreak", "tanker piracy", "ransomware", "interest rate", "the sea ", "nothing else"]
_QUERY_SQL = "CASE item_id % 6 " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(_QUERY_WORDS)) + " END"


@query("f30_query_domain", f"SELECT item_id, {_DOMAIN} AS domain FROM (SELECT item_id, title || ' ' || {_QUERY_SQL} AS q FROM v_feed)")
def f30(spark: SparkSession, sf: str) -> DataFrame:
    last = F.get(F.array(*map(F.lit, _QUERY_WORDS)), (F.col("item_id") % 6).cast("int"))
    return view(spark, sf, "v_feed").select("item_id", w.query_domain(F.concat_ws(" ", "title", last)).alias("domain"))


@query("f31_title_fits", "SELECT item_id, list_contains(string_split(trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')), ' '), 'the') AS fits FROM v_feed")
def f31(spark: SparkSession, sf: str) -> DataFrame:
    term = w.lookup_term(F.lit('the "(onthe)"'))
    return view(spark, sf, "v_feed").select("item_id", w.title_fits(term, F.col("title")).alias("fits"))


@query("f29_anchor_offsets")
def f29(spark: SparkSession, sf: str) -> DataFrame:
    p = c.anchor_offset(F.col("id"), F.lit(10.0), F.lit(178.0))
    return rounded(view(spark, sf, "v_entities").select("id", p.alias("p")).select("id", "p.lat", "p.lon"))


@query("f29_arcs", "SELECT n_nationkey AS k, i, round(n_nationkey + (50 - n_nationkey) * i / 24.0, 6) AS lat FROM nation, range(25) t(i)")
def f29a(spark: SparkSession, sf: str) -> DataFrame:
    a = c.arc(F.col("n_nationkey").cast("double"), F.lit(0.0), F.lit(50.0), F.lit(10.0))
    return rounded(view(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), F.posexplode(a).alias("i", "p")).select("k", F.col("i").cast("bigint").alias("i"), "p.lat"))
