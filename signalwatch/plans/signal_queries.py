"""Queries over telemetry and signals, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import signals as s
from ..operators import telemetry as t
from .registry import registry, rounded
from .views import view

QUERIES, ORACLES, query = registry()

_MA = """WITH m AS (SELECT *, avg(value) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS moving_avg FROM v_telemetry)"""


@query("w1_rolling_mean", f"{_MA} SELECT event_id, event_type, round(moving_avg, 6) AS moving_avg FROM m")
def w1(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(t.rolling_mean(view(spark, sf, "v_telemetry"), ["event_type"], 5).select("event_id", "event_type", "moving_avg"))


@query("a1_telemetry_buckets", """WITH f AS (SELECT * FROM v_telemetry WHERE value >= 1), m AS (SELECT *, avg(value) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS ma FROM f)
    SELECT CAST(floor(epoch(ts) / 3600) * 3600 AS BIGINT) AS bucket, event_type, count(value) AS n, round(avg(value), 6) AS mean, round(min(value), 6) AS low, round(max(value), 6) AS high,
           round(stddev_samp(value), 6) AS deviation, round(arg_max(ma, (ts, event_id)), 6) AS last_avg FROM m GROUP BY 1, 2""")
def a1(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(t.telemetry(view(spark, sf, "v_telemetry"), ["event_type"], 3600, 5, least=1.0))


@query("a2_pair_counts", "SELECT drug, event, count(*) AS a FROM v_pairs GROUP BY 1, 2")
def a2(spark: SparkSession, sf: str) -> DataFrame:
    return s.pair_counts(view(spark, sf, "v_pairs"))


_TABLES = """p AS (SELECT drug, event, count(*) AS a FROM v_pairs GROUP BY 1, 2), q AS (SELECT drug, event, a, CAST(sum(a) OVER (PARTITION BY drug) - a AS BIGINT) AS b, CAST(sum(a) OVER (PARTITION BY event) - a AS BIGINT) AS c,
    CAST(sum(a) OVER () - sum(a) OVER (PARTITION BY drug) - sum(a) OVER (PARTITION BY event) + a AS BIGINT) AS d FROM p)"""


@query("j2_contingency", f"WITH {_TABLES} SELECT * FROM q")
def j2(spark: SparkSession, sf: str) -> DataFrame:
    return s.contingency(s.pair_counts(view(spark, sf, "v_pairs")))


_SCORES = """(a + 0.5) / (a + b + 0.5) / ((c + 0.5) / (c + d + 0.5)) AS prr0, CAST(a + b AS DOUBLE) * (a + c) / (a + b + c + d) AS e,
    (a + b + c + d) * pow(greatest(abs(CAST(a AS DOUBLE) * d - CAST(b AS DOUBLE) * c) - (a + b + c + d) / 2.0, 0), 2) / (CAST(a + b AS DOUBLE) * (c + d) * (a + c) * (b + d)) AS chi0"""


@query("a4_disproportionality", f"""WITH {_TABLES}, r AS (SELECT *, {_SCORES} FROM q)
    SELECT drug, event, a, b, c, d, round(greatest(e, 0.5), 6) AS expected, round(greatest(prr0, 0.5), 6) AS prr, round(greatest((a + 0.5) * (d + 0.5) / ((b + 0.5) * (c + 0.5)), 0.5), 6) AS ror,
           round(log2((a + 0.5) / (e + 0.5)), 6) AS ic, round(log2((a + 0.5) / (e + 0.5)) - 1.96 * sqrt(1 / greatest(a + 0.5, 1)) / ln(2), 6) AS ic_lower, round(greatest(chi0, 0.5), 6) AS chi_squared,
           a >= 3 AND prr0 >= 1.02 AND chi0 >= 1.0 AS is_signal FROM r""")
def a4(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(s.disproportionality(s.contingency(s.pair_counts(view(spark, sf, "v_pairs"))), prr=1.02, chi=1.0))


@query("a6_running_disproportionality", f"""WITH p AS (SELECT CAST(year(day) AS BIGINT) AS bucket, drug, event, count(*) AS k FROM v_pairs GROUP BY 1, 2, 3),
    q AS (SELECT x.bucket, x.drug, x.event, CAST(sum(y.k) FILTER (y.drug = x.drug AND y.event = x.event) AS BIGINT) AS a, CAST(sum(y.k) FILTER (y.drug = x.drug) AS BIGINT) AS of_drug,
          CAST(sum(y.k) FILTER (y.event = x.event) AS BIGINT) AS of_event, CAST(sum(y.k) AS BIGINT) AS total FROM p x JOIN p y ON y.bucket <= x.bucket GROUP BY 1, 2, 3),
    z AS (SELECT bucket, drug, event, a, of_drug - a AS b, of_event - a AS c, total - of_drug - of_event + a AS d FROM q), r AS (SELECT *, {_SCORES} FROM z)
    SELECT bucket, drug, event, a, b, c, d, round(greatest(CASE WHEN c + d = 0 THEN 0 ELSE prr0 END, 0.5), 6) AS prr FROM r""")
def a6(spark: SparkSession, sf: str) -> DataFrame:
    df = view(spark, sf, "v_pairs").withColumn("bucket", F.year("day").cast("bigint"))
    return rounded(s.disproportionality(s.running_tables(df, "bucket")).select("bucket", "drug", "event", "a", "b", "c", "d", "prr"))


@query("a3_bucket_counts", "SELECT keyword, district, CAST(day AS INTEGER) AS day, count(*) AS n FROM v_daily GROUP BY 1, 2, 3")
def a3(spark: SparkSession, sf: str) -> DataFrame:
    return s.bucket_counts(view(spark, sf, "v_daily"))


_EWMA = """WITH RECURSIVE c AS (SELECT keyword, district, CAST(day AS INTEGER) AS day, count(*) AS n FROM v_daily GROUP BY 1, 2, 3),
    o AS (SELECT *, row_number() OVER (PARTITION BY keyword, district ORDER BY day) AS i FROM c),
    f AS (SELECT keyword, district, day, n, i, greatest(CAST(n AS DOUBLE), 1) AS base, (n - greatest(CAST(n AS DOUBLE), 1)) AS z, CAST(n AS DOUBLE) AS mean, greatest(CAST(n AS DOUBLE), 1) AS var FROM o WHERE i = 1
      UNION ALL SELECT o.keyword, o.district, o.day, o.n, o.i, f.mean, (o.n - f.mean) / sqrt(greatest(f.var, 1)), 0.3 * o.n + 0.7 * f.mean, 0.3 * (o.n - f.mean) * (o.n - f.mean) + 0.7 * f.var
      FROM f JOIN o ON o.keyword = f.keyword AND o.district = f.district AND o.i = f.i + 1)"""


@query("w2_ewma_spikes", f"{_EWMA} SELECT keyword, district, day, n, round(base, 6) AS baseline, round(z, 6) AS z, CAST(least(i - 1, 14) AS INTEGER) AS prior, i > 5 AND z >= 1.5 AND n >= greatest(base * 1.5, 3) AS is_spike FROM f")
def w2(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(s.ewma_spikes(s.bucket_counts(view(spark, sf, "v_daily")), least_z=1.5))


@query("w3_prior_points", "WITH c AS (SELECT DISTINCT keyword, district, CAST(day AS INTEGER) AS day FROM v_daily) SELECT *, CAST(least(14, row_number() OVER (PARTITION BY keyword, district ORDER BY day) - 1) AS INTEGER) AS prior FROM c")
def w3(spark: SparkSession, sf: str) -> DataFrame:
    return s.prior_points(view(spark, sf, "v_daily"))


_NOW = "2024-01-15 00:00:00"
_CELLS = f"""c AS (SELECT floor(lat / 5) AS cy, floor(lon / 5) AS cx, sum(weight) AS w, count(*) AS population FROM v_obs WHERE ts BETWEEN TIMESTAMP '{_NOW}' - INTERVAL 7 DAYS AND TIMESTAMP '{_NOW}' GROUP BY 1, 2),
    r AS (SELECT *, sum(w) OVER () / count(*) OVER () AS e FROM c), l AS (SELECT *, CASE WHEN w <= e THEN 0 ELSE w * ln(w / e) - (w - e) END AS llr FROM r)"""
_ERFC = "((((1.061405429 * k - 1.453152027) * k + 1.421413741) * k - 0.284496736) * k + 0.254829592) * k * exp(-llr)"


@query("a5_poisson_clusters", f"""WITH {_CELLS}, x AS (SELECT *, 1 / (1 + 0.3275911 * sqrt(llr)) AS k FROM l)
    SELECT (cy + 0.5) * 5 AS centroid_lat, (cx + 0.5) * 5 AS centroid_lon, CAST(w AS BIGINT) AS observed, round(e, 6) AS expected, round(llr, 6) AS llr, round(CASE WHEN llr <= 0 THEN 1 ELSE {_ERFC} END, 6) AS p_value, population,
           w >= 3 AND w > e AND llr >= 0.5 AS is_cluster FROM x""")
def a5(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(s.poisson_clusters(view(spark, sf, "v_obs"), _NOW, degrees=5.0, least_llr=0.5))


@query("f21_cluster_p_values", f"WITH {_CELLS}, x AS (SELECT *, 1 / (1 + 0.3275911 * sqrt(llr)) AS k FROM l) SELECT CAST(cy AS BIGINT) AS cy, CAST(cx AS BIGINT) AS cx, round(llr, 6) AS llr, round({_ERFC}, 5) AS p FROM x WHERE llr > 0")
def f21(spark: SparkSession, sf: str) -> DataFrame:
    cells = s.poisson_clusters(view(spark, sf, "v_obs"), _NOW, degrees=5.0).where("llr > 0")
    return cells.select(F.floor(F.col("centroid_lat") / 5).alias("cy"), F.floor(F.col("centroid_lon") / 5).alias("cx"), F.round("llr", 6).alias("llr"), F.round("p_value", 5).alias("p"))


@query("f25_adr_signals", f"""WITH {_TABLES}, r AS (SELECT *, {_SCORES} FROM q)
    SELECT substr(sha256('adr|' || drug || '|' || event), 1, 32) AS id, 'adr' AS kind, round(least(greatest(prr0 / 10, 0), 1), 6) AS score, 'Possible ADR: ' || drug || ' ↔ ' || event AS title,
      printf('PRR=%.2f, ROR=%.2f, observed=%d', greatest(prr0, 0.5), greatest((a + 0.5) * (d + 0.5) / ((b + 0.5) * (c + 0.5)), 0.5), a) AS facts FROM r WHERE a >= 3 AND prr0 >= 1.02 AND chi0 >= 1.0""")
def f25_adr(spark: SparkSession, sf: str) -> DataFrame:
    scored = s.disproportionality(s.contingency(s.pair_counts(view(spark, sf, "v_pairs"))), prr=1.02, chi=1.0)
    facts = F.concat_ws(", ", F.regexp_extract("explanation", "PRR=[0-9.]+", 0), F.regexp_extract("explanation", "ROR=[0-9.]+", 0), F.regexp_extract("explanation", "observed=[0-9]+", 0))
    return rounded(s.adr_signals(scored).withColumn("facts", facts).drop("explanation"))


@query("f25_trend_signals", f"""{_EWMA} SELECT substr(sha256('trend|' || keyword || '|' || district || '|' || day), 1, 32) AS id, 'trend' AS kind, round(least(greatest(z / 10, 0), 1), 6) AS score, 'Volume spike: ' || keyword || ' in ' || district AS title,
      printf('z=%.2f, current=%.1f, baseline=%.1f.', z, CAST(n AS DOUBLE), base) AS explanation FROM f WHERE i > 5 AND z >= 1.5 AND n >= greatest(base * 1.5, 3)""")
def f25_trend(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(s.trend_signals(s.ewma_spikes(s.bucket_counts(view(spark, sf, "v_daily")), least_z=1.5)))


@query("f25_cluster_signals", f"""WITH {_CELLS} SELECT 'cluster' AS kind, round(least(greatest(llr / 20, 0), 1), 6) AS score, printf('Spatial cluster (%d reports near %.1f,%.1f)', CAST(w AS BIGINT), (cy + 0.5) * 5, (cx + 0.5) * 5) AS title FROM l WHERE w >= 3 AND w > e AND llr >= 0.5""")
def f25_cluster(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(s.cluster_signals(s.poisson_clusters(view(spark, sf, "v_obs"), _NOW, degrees=5.0, least_llr=0.5)).drop("id", "explanation"))


@query("a8_codes_by_system", "SELECT report_id, 'drug' AS system, string_agg(DISTINCT drug, ',' ORDER BY drug) AS codes FROM v_pairs GROUP BY 1 UNION ALL SELECT report_id, 'event', string_agg(DISTINCT event, ',' ORDER BY event) FROM v_pairs GROUP BY 1")
def a8(spark: SparkSession, sf: str) -> DataFrame:
    codes = view(spark, sf, "v_pairs").select("report_id", F.explode(F.map_from_arrays(F.array(F.lit("drug"), F.lit("event")), F.array("drug", "event"))).alias("system", "code"))
    return s.codes_by_system(codes, ["report_id"])


@query("p9_labels", "SELECT report_id, string_agg(DISTINCT coalesce(nullif(drug, 'Brand#1'), lower(drug)), ',' ORDER BY coalesce(nullif(drug, 'Brand#1'), lower(drug))) AS drugs, string_agg(DISTINCT event, ',' ORDER BY event) FILTER (event <> 'AF') AS events FROM v_pairs GROUP BY 1")
def p9(spark: SparkSession, sf: str) -> DataFrame:
    def entity(kind: str, surface: str, code, negated):
        return F.struct(F.lit(kind).alias("kind"), F.col(surface).alias("surface"), code.alias("code"), negated.alias("negated"), F.lit(False).alias("hypothetical"))

    rows = view(spark, sf, "v_pairs").select("report_id", F.explode(F.array(entity("DRUG", "drug", F.when(F.col("drug") != "Brand#1", F.col("drug")), F.lit(False)), entity("SYMPTOM", "event", F.col("event"), F.col("event") == "AF"))).alias("e"))
    labelled = s.labelled_entities(rows.groupBy("report_id").agg(F.collect_list("e").alias("medical_entities")))
    text = lambda c: F.when(F.size(c) > 0, F.array_join(F.array_sort(F.array_distinct(c)), ","))
    return labelled.select("report_id", text("drugs").alias("drugs"), text("events").alias("events"))


@query("p12_geo_presence", "SELECT event_id, round(lat, 6) AS lat, round(lon, 6) AS lon FROM (SELECT event_id, CASE WHEN event_id % 9 = 0 THEN NULL WHEN event_id % 7 = 0 THEN lat * 3 ELSE lat END AS lat, lon FROM v_obs) WHERE lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180")
def p12(spark: SparkSession, sf: str) -> DataFrame:
    """Some latitudes aren't numbers, some are out of range."""
    lat = F.when(F.col("event_id") % 9 == 0, "north").when(F.col("event_id") % 7 == 0, (F.col("lat") * 3).cast("string")).otherwise(F.col("lat").cast("string"))
    return rounded(s.located_only(view(spark, sf, "v_obs").select("event_id", lat.alias("lat"), "lon")))
