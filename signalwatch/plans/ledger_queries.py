"""Queries over chains, triage, exports, privacy and validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import console as c
from ..operators import ledger as g
from ..operators import signals as s
from ..operators.releases import BudgetSpent, ReleaseLedger
from ..sources.scratch import folder
from .registry import registry, rounded
from .views import view

QUERIES, ORACLES, query = registry()

_CHAIN = """WITH RECURSIVE r AS (SELECT chain, sequence, repeat('0', 64) AS prev_hash, sha256(repeat('0', 64) || payload) AS payload_hash FROM v_chain WHERE sequence = 1
    UNION ALL SELECT c.chain, c.sequence, r.payload_hash, sha256(r.payload_hash || c.payload) FROM r JOIN v_chain c ON c.chain = r.chain AND c.sequence = r.sequence + 1)"""


def _chain(spark: SparkSession, sf: str) -> DataFrame:
    return g.chained(view(spark, sf, "v_chain"))


@query("w8_chain_build", f"{_CHAIN} SELECT chain, sequence, prev_hash, payload_hash FROM r")
def w8(spark: SparkSession, sf: str) -> DataFrame:
    return _chain(spark, sf)


@query("w7_chain_verify", "SELECT chain, count(*) AS entries, CASE WHEN chain % 5 = 0 AND count(*) >= 4 THEN CAST(3 AS BIGINT) END AS broken_at FROM v_chain WHERE NOT (chain % 5 = 0 AND sequence = 2) GROUP BY 1")
def w7(spark: SparkSession, sf: str) -> DataFrame:
    """Every fifth chain lacks its second entry."""
    return g.verified(_chain(spark, sf).where("not (chain % 5 = 0 and sequence = 2)"))


@query("w7_chain_recompute", "SELECT chain, CAST(sequence AS BIGINT) AS sequence FROM v_chain WHERE (chain + sequence) % 11 = 0")
def w7r(spark: SparkSession, sf: str) -> DataFrame:
    """Entries whose payload was changed afterwards."""
    changed = view(spark, sf, "v_chain").withColumn("payload", F.when((F.col("chain") + F.col("sequence")) % 11 == 0, F.concat("payload", F.lit("!"))).otherwise(F.col("payload")))
    return g.recomputed(_chain(spark, sf), changed)


@query("t3_audit_tail", "SELECT * FROM (SELECT chain, sequence FROM v_chain ORDER BY sequence DESC, chain DESC LIMIT 25)")
def t3(spark: SparkSession, sf: str) -> DataFrame:
    return g.audit_tail(view(spark, sf, "v_chain").select("chain", "sequence"), 25, ["sequence", "chain"])


@query("j3_project_audit", "SELECT signal_id, seq, decision FROM v_triage WHERE signal_id IN (SELECT id FROM v_signals WHERE project_id = 'p3')")
def j3(spark: SparkSession, sf: str) -> DataFrame:
    return g.project_audit(view(spark, sf, "v_triage"), view(spark, sf, "v_signals"), "p3").select("signal_id", "seq", "decision")


@query("t1_listed_signals", "SELECT id, kind, score FROM v_signals WHERE project_id = 'p2' AND kind = 'adr' AND status = 'new' ORDER BY detected DESC, id LIMIT 50")
def t1(spark: SparkSession, sf: str) -> DataFrame:
    return g.listed(view(spark, sf, "v_signals"), "p2", "adr", "new", 50).select("id", "kind", "score")


@query("t2_triage_history", "SELECT seq, decided, actor, decision, tie FROM v_triage WHERE signal_id = 'sig-7'")
def t2(spark: SparkSession, sf: str) -> DataFrame:
    return g.history(view(spark, sf, "v_triage"), "sig-7", ["decided", "seq", "tie"]).select("seq", "decided", "actor", "decision", "tie")


@query("f28_triage_status", """WITH l AS (SELECT signal_id AS id, arg_max((actor, decision), (decided, seq, tie, actor, decision)) AS d FROM v_triage GROUP BY 1)
    SELECT s.id, CASE d[2] WHEN 'confirm' THEN 'confirmed' WHEN 'reject' THEN 'rejected' WHEN 'more_data' THEN 'more_data' ELSE status END AS status, d[1] AS assignee FROM v_signals s LEFT JOIN l USING (id)""")
def f28(spark: SparkSession, sf: str) -> DataFrame:
    return g.triaged(view(spark, sf, "v_signals"), view(spark, sf, "v_triage"), ["decided", "seq", "tie", "actor", "decision"]).select("id", "status", "assignee")


@query("a22_signals_by_status", "SELECT status, count(*) AS n FROM v_signals GROUP BY 1")
def a22(spark: SparkSession, sf: str) -> DataFrame:
    return g.by_status(view(spark, sf, "v_signals"))


@query("a31_project_rollup", """WITH s AS (SELECT 'p' || (c_custkey % 6) AS project_id, count(*) AS sources, count(*) FILTER (c_acctbal > 0) AS sources_enabled FROM customer GROUP BY 1),
    o AS (SELECT project_id, count(*) AS signals, count(*) FILTER (status = 'new') AS status_new, count(*) FILTER (status = 'confirmed') AS status_confirmed, count(*) FILTER (status = 'rejected') AS status_rejected, count(*) FILTER (status = 'more_data') AS status_more_data,
      count(*) FILTER (kind = 'adr') AS kind_adr, count(*) FILTER (kind = 'trend') AS kind_trend, count(*) FILTER (kind = 'cluster') AS kind_cluster FROM v_signals GROUP BY 1)
    SELECT o.*, coalesce(sources, 0) AS sources, coalesce(sources_enabled, 0) AS sources_enabled, status_new + status_more_data AS queue FROM o LEFT JOIN s USING (project_id)""")
def a31(spark: SparkSession, sf: str) -> DataFrame:
    sources = view(spark, sf, "customer").select(F.concat(F.lit("p"), (F.col("c_custkey") % 6).cast("string")).alias("project_id"), (F.col("c_acctbal") > 0).alias("enabled"))
    return g.rollup(view(spark, sf, "v_signals"), sources)


def _projects(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "region").select(F.concat(F.lit("p"), F.col("r_regionkey").cast("string")).alias("id"), F.lower("r_name").alias("slug"), F.col("r_name").alias("name"), F.lit("desk").alias("owner"))


def _full_signals(spark: SparkSession, sf: str) -> DataFrame:
    """Signals with a statistic of their kind (every tenth has none), codes of two systems and evidence."""
    n, day = F.col("n"), F.timestamp_seconds(F.col("detected") * 86400).cast("timestamp_ntz")
    has = lambda kind, *fields: F.when((F.col("kind") == kind) & (n % 10 != 0), F.struct(*fields, day.alias("window_start"), day.alias("window_end")))
    d = lambda c, name: c.cast("double").alias(name)
    adr = has("adr", F.concat(F.lit("drug"), (n % 5).cast("string")).alias("drug"), F.lit("fever").alias("event"), (n % 9).alias("observed"), d(n % 4, "expected"), d(n % 3, "prr"), d(n % 6, "ror"), d(n % 2, "ic"), d(n % 7, "ic_lower"), d(n % 8, "chi_squared"))
    trend = has("trend", F.lit("fever").alias("keyword"), F.when(n % 2 == 0, F.lit("north")).alias("district"), d(n % 5, "z_score"), d(n % 6, "baseline"), d(n % 11, "current"))
    cluster = has("cluster", d(n % 80, "centroid_lat"), d(n % 170, "centroid_lon"), F.lit(0.5).alias("radius_deg"), (n % 13).alias("population"), (n % 9).alias("observed"), d(n % 4, "expected"), d(n % 6, "log_likelihood"), F.lit(0.25).alias("p_value"))
    code = lambda system, code: F.struct(F.lit(system).alias("code_system"), code.alias("code"), F.lit("word").alias("surface"), F.when(n % 2 == 0, F.lit("Word")).alias("display_name"))
    codes = F.array(code("MedDRA", F.concat(F.lit("M"), (n % 3).cast("string"))), code("RxNorm", F.concat(F.lit("R"), (n % 4).cast("string"))), code("MedDRA", F.lit("M9")))
    return view(spark, sf, "v_signals").select(
        "id", "project_id", "kind", "score", "status", F.concat(F.lit("Signal "), n.cast("string")).alias("title"), F.lit("why").alias("explanation"), F.when(n % 3 == 0, F.lit("north")).alias("district"), day.alias("started_at"), day.alias("detected_at"),
        F.lit(None).cast("string").alias("audit_chain_head"), codes.alias("codes"), F.array(F.concat(F.lit("m"), n.cast("string"))).alias("evidence_mention_ids"), adr.alias("adr_stat"), trend.alias("trend_stat"), cluster.alias("cluster_stat"))


_NOW = "2024-06-01T00:00:00+00:00"


def _outbreaks(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return g.outbreak_forms(_full_signals(spark, sf), _projects(spark, sf), _NOW)


def _fields(rows: DataFrame, **paths: str) -> list:
    return [F.get_json_object("payload", p).alias(n) for n, p in paths.items()]


@query("j11_signal_projects", "SELECT id, r_name AS project, lower(r_name) AS slug FROM v_signals LEFT JOIN region ON project_id = 'p' || r_regionkey WHERE kind IN ('trend', 'cluster') AND n % 10 <> 0")
def j11(spark: SparkSession, sf: str) -> DataFrame:
    rows, _ = _outbreaks(spark, sf)
    return rows.select("id", *_fields(rows, project="$.header.project_name", slug="$.header.project_slug"))


_DAY = "strftime(DATE '1970-01-01' + CAST(detected AS INTEGER), '%Y-%m-%d') || 'T00:00:00+00:00'"
_CODES = """'{"MedDRA":[{"code":"M' || n % 3 || '","surface":"word"' || d || '},{"code":"M9","surface":"word"' || d || '}],"RxNorm":[{"code":"R' || n % 4 || '","surface":"word"' || d || '}]}'"""


@query("f26_outbreak_forms", f"""WITH s AS (SELECT *, CASE WHEN n % 2 = 0 THEN ',"display":"Word"' ELSE '' END AS d FROM v_signals) SELECT id, kind, 'IDSP-P' AS form, CASE WHEN n % 3 = 0 THEN 'north' END AS district, CAST(CASE kind WHEN 'cluster' THEN n % 9 ELSE n % 11 END AS VARCHAR) AS cases, {_DAY} AS started_at,
    CASE kind WHEN 'cluster' THEN CAST(n % 80 AS VARCHAR) || '.0' END AS lat, CASE kind WHEN 'trend' THEN CAST(n % 5 AS VARCHAR) || '.0' END AS z_score, CASE WHEN kind = 'trend' AND n % 2 = 0 THEN 'north' END AS trend_district, CASE kind WHEN 'cluster' THEN {_DAY} END AS cluster_end, {_CODES} AS codes, '1' AS evidence
    FROM s WHERE kind IN ('trend', 'cluster') AND n % 10 <> 0""")
def f26(spark: SparkSession, sf: str) -> DataFrame:
    rows, _ = _outbreaks(spark, sf)
    return rows.select("id", *_fields(rows, kind="$.header.signal_kind", form="$.form_type", district="$.outbreak.district", cases="$.outbreak.presumptive_case_count", started_at="$.outbreak.started_at", lat="$.statistics.cluster.centroid_lat",
        z_score="$.statistics.trend.z_score", trend_district="$.statistics.trend.district", cluster_end="$.statistics.cluster.window_end", codes="$.codes", evidence="$.evidence_mention_count"))


@query("f26_rejects", "SELECT id, 'needs a cluster or trend statistic' AS reason FROM v_signals WHERE kind = 'adr' OR n % 10 = 0")
def f26r(spark: SparkSession, sf: str) -> DataFrame:
    return _outbreaks(spark, sf)[1]


@query("f27_case_reports", """SELECT id, score >= 0.7 AS serious, CASE WHEN score >= 0.7 THEN '1' ELSE '2' END AS serious_code, 'SETU-' || id AS report, 'drug' || n % 5 AS drug, '[{"system":"RxNorm","code":"R' || n % 4 || '","surface":"word"}]' AS drugs,
    '[{"system":"MedDRA","code":"M' || n % 3 || '","surface":"word"},{"system":"MedDRA","code":"M9","surface":"word"}]' AS reactions, CAST(n % 3 AS VARCHAR) || '.0' AS prr, 'setu-aggregate-' || id AS patient, '["m' || n || '"]' AS evidence FROM v_signals WHERE kind = 'adr' AND n % 10 <> 0""")
def f27(spark: SparkSession, sf: str) -> DataFrame:
    rows, _ = g.case_forms(_full_signals(spark, sf), _projects(spark, sf), _NOW)
    return rows.select("id", "serious", *_fields(rows, serious_code="$.serious", report="$.safetyreportid", drug="$.drugs[0].medicinalproduct", drugs="$.drugs[0].drugcoding", reactions="$.reactions[0].reactioncoding", prr="$.statistics.prr", patient="$.patient.patientidentifier", evidence="$.evidence_mention_ids"))


@query("f27_rejects", "SELECT id, CASE WHEN kind <> 'adr' THEN 'needs an adr signal' ELSE 'needs an adverse event statistic' END AS reason FROM v_signals WHERE kind <> 'adr' OR n % 10 = 0")
def f27r(spark: SparkSession, sf: str) -> DataFrame:
    return g.case_forms(_full_signals(spark, sf), _projects(spark, sf), _NOW)[1]


@query("a26_keyword_versions", "SELECT o_orderkey AS id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS INTEGER) AS version FROM orders")
def a26(spark: SparkSession, sf: str) -> DataFrame:
    sets = view(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("project_id"), F.col("o_orderdate").alias("created"))
    return g.next_version(sets).select("id", "version")


@query("a29_noisy_counts")
def a29(spark: SparkSession, sf: str) -> DataFrame:
    counts = view(spark, sf, "v_signals").groupBy("project_id", "kind").agg(F.count("*").cast("double").alias("n"))
    return g.noisy(counts, ["project_id", "kind"], "n", 1.0, 0.5, 11)


@query("a29_released_counts", """SELECT release, project_id, kind, n, release = 'week-3' AS stored_before FROM (SELECT project_id, kind, CAST(count(*) AS DOUBLE) AS n FROM v_signals GROUP BY 1, 2), (VALUES ('week-1'), ('week-3')) AS r(release)""")
def a29_released(spark: SparkSession, sf: str) -> DataFrame:
    """Counts released under a budget of 1: one week for .6, one refused, one for .4, and that one asked for again at no cost. Each stored row with its count."""
    counts = view(spark, sf, "v_signals").groupBy("project_id", "kind").agg(F.count("*").cast("double").alias("n"))
    book, out = ReleaseLedger(spark, folder(spark, "releases"), "counts", 1.0), None
    for week, epsilon in (("week-1", 0.6), ("week-2", 0.6), ("week-3", 0.4), ("week-3", 0.4)):
        before = week in dict(book.entries())
        try:
            stored = book.release(counts, week, ["project_id", "kind"], "n", 1.0, epsilon, 11)
        except BudgetSpent:
            continue
        told = stored.join(counts, ["project_id", "kind"]).select(F.lit(week).alias("release"), "project_id", "kind", "n", F.lit(before).alias("stored_before"))
        out = told if out is None else out.where(F.col("release") != week).unionByName(told)
    return out


@query("a30_budget_ledger", """WITH RECURSIVE q AS (SELECT o_custkey AS key, o_orderkey AS seq, round(o_totalprice / 1000000, 3) AS epsilon, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders),
    r AS (SELECT key, seq, epsilon, i, epsilon <= 1 AS accepted, CASE WHEN epsilon <= 1 THEN epsilon ELSE 0 END AS spent FROM q WHERE i = 1
      UNION ALL SELECT q.key, q.seq, q.epsilon, q.i, r.spent + q.epsilon <= 1 + 1e-12, CASE WHEN r.spent + q.epsilon <= 1 + 1e-12 THEN r.spent + q.epsilon ELSE r.spent END FROM r JOIN q ON q.key = r.key AND q.i = r.i + 1)
    SELECT key, seq, accepted, round(spent, 6) AS spent FROM r""")
def a30(spark: SparkSession, sf: str) -> DataFrame:
    asked = view(spark, sf, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("seq"), F.round(F.col("o_totalprice") / 1000000, 3).alias("epsilon"))
    return rounded(g.charged(asked, 1.0).select("key", "seq", "accepted", "spent"))


BREAKER = """WITH RECURSIVE q AS (SELECT user_id AS source, event_id AS seq, event_type NOT IN ('error', 'view') AS ok, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
    r AS (SELECT source, seq, i, CASE WHEN ok THEN 0.7e0 + 0.3e0 ELSE 0.7e0 END AS health, CASE WHEN ok THEN 0 ELSE 1 END AS failures, NOT ok AND 0.7e0 < 0.3 AS is_open FROM q WHERE i = 1
      UNION ALL SELECT q.source, q.seq, q.i, 0.7e0 * r.health + CASE WHEN q.ok THEN 0.3e0 ELSE 0e0 END, CASE WHEN q.ok THEN 0 ELSE r.failures + 1 END,
        CASE WHEN q.ok THEN r.is_open AND 0.7e0 * r.health + 0.3e0 < 0.7 ELSE r.is_open OR 0.7e0 * r.health < 0.3 END FROM r JOIN q ON q.source = r.source AND q.i = r.i + 1)"""


@query("w11_source_breaker", BREAKER + """ SELECT source, seq, round(health, 6) AS health, failures, is_open, CAST(CASE WHEN NOT is_open AND failures = 0 THEN 60 ELSE 60 * least(pow(2, greatest(failures - 1, 0)), 16) END AS DOUBLE) AS delay FROM r""")
def w11(spark: SparkSession, sf: str) -> DataFrame:
    e = view(spark, sf, "events").select(F.col("user_id").alias("source"), F.col("event_id").alias("seq"), (~F.col("event_type").isin("error", "view")).alias("success"))
    return rounded(g.breaker(e))


@query("p1_validation", """SELECT c_custkey, array_to_string(list_filter([CASE WHEN trim(c_name) = '' THEN 'c_name:missing' END, CASE WHEN NOT c_acctbal BETWEEN 0 AND 9000 THEN 'c_acctbal:range' END, CASE WHEN c_mktsegment NOT IN ('BUILDING', 'MACHINERY') THEN 'c_mktsegment:enum' END,
    CASE WHEN NOT regexp_matches(c_name, '^Customer#[0-9]+[02468]$') THEN 'c_name:pattern' END], lambda x: x IS NOT NULL), ',') AS reasons FROM customer""")
def p1(spark: SparkSession, sf: str) -> DataFrame:
    rules = [g.required("c_name"), g.in_range("c_acctbal", 0, 9000), g.one_of("c_mktsegment", ["BUILDING", "MACHINERY"]), g.fits("c_name", "^Customer#[0-9]+[02468]$")]
    return g.validated(view(spark, sf, "customer"), rules).select("c_custkey", F.array_join("reasons", ",").alias("reasons"))


_UUID = "substr(md5({0}), 1, 8) || '-' || substr(md5({0}), 9, 4) || '-' || substr(md5({0}), 13, 4) || '-' || substr(md5({0}), 17, 4) || '-' || substr(md5({0}), 21, 12)"


@query("p1_signal_records", f"""WITH s AS (SELECT n, CASE WHEN n % 7 = 0 THEN id ELSE {_UUID.format('id')} END AS id, CASE WHEN n % 11 <> 0 THEN {_UUID.format('project_id')} END AS project_id, CASE WHEN n % 13 = 0 THEN 'rumour' ELSE kind END AS kind, CASE WHEN n % 17 = 0 THEN score + 1.5 ELSE score END AS score FROM v_signals)
    SELECT n, array_to_string(list_filter([CASE WHEN n % 7 = 0 THEN 'id:pattern' END, CASE WHEN n % 11 = 0 THEN 'project_id:missing' END, CASE WHEN n % 13 = 0 THEN 'kind:enum' END, CASE WHEN NOT score BETWEEN 0 AND 1 THEN 'score:range' END, CASE WHEN n % 19 = 0 THEN 'title:length' END,
      CASE WHEN n % 23 = 0 THEN 'audit_chain_head:pattern' END, 'guess:unknown'], lambda x: x IS NOT NULL), ',') AS reasons FROM s""")
def p1_records(spark: SparkSession, sf: str) -> DataFrame:
    """Signals as records: some ids are no UUID, some fields are missing or out of range, and one column isn't declared."""
    n = F.col("n")
    uuid = lambda c: F.regexp_replace(F.md5(F.col(c)), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    day = F.timestamp_seconds(F.col("detected") * 86400)
    rows = view(spark, sf, "v_signals").select(
        "n", F.when(n % 7 == 0, F.col("id")).otherwise(uuid("id")).alias("id"), F.when(n % 11 != 0, uuid("project_id")).alias("project_id"), F.when(n % 13 == 0, "rumour").otherwise(F.col("kind")).alias("kind"), F.when(n % 17 == 0, F.col("score") + 1.5).otherwise(F.col("score")).alias("score"),
        F.when(n % 19 == 0, " ").otherwise("Signal").alias("title"), F.lit("why").alias("explanation"), F.lit(None).cast("string").alias("district"), day.alias("started_at"), day.alias("detected_at"), "status", F.when(n % 23 == 0, "xyz").alias("audit_chain_head"), F.lit(1).alias("guess"))
    return g.validated_record(rows, "signal", ["n"]).select("n", F.array_join("reasons", ",").alias("reasons"))


@query("p2_forbidden_terms", r"SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i)(^|[^\p{L}\p{N}_])(stupid|moron|license)([^\p{L}\p{N}_]|$)')")
def p2(spark: SparkSession, sf: str) -> DataFrame:
    d = view(spark, sf, "documents").select("doc_id", F.struct("source", F.array("text").alias("texts")).alias("body"))
    return d.where(g.forbidden(d, ["stupid", "moron", "License"])).select("doc_id")


@query("p3_utc_timestamps", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(epoch(CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP)) AS BIGINT) - CASE WHEN o_orderkey % 3 = 1 THEN 0 ELSE 19800 END END AS s FROM orders")
def p3(spark: SparkSession, sf: str) -> DataFrame:
    text = F.concat(F.col("o_orderdate").cast("date").cast("string"), F.lit("T00:00:00"), F.when(F.col("o_orderkey") % 3 == 0, "").when(F.col("o_orderkey") % 3 == 1, "Z").otherwise("+05:30"))
    return view(spark, sf, "orders").select("o_orderkey", F.unix_seconds(g.utc_timestamp(text)).alias("s"))


@query("p4_absolute_urls", "SELECT page_id, page_id % 3 <> 0 AS fits FROM pages")
def p4(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "pages").select("page_id", g.absolute_url(F.when(F.col("page_id") % 3 != 0, F.col("url")).otherwise(F.regexp_replace("url", "^https?:", ""))).alias("fits"))


@query("f18_salvaged_json", """SELECT event_id, CASE WHEN event_id % 4 = 3 THEN NULL ELSE props END AS found, CASE WHEN event_id % 4 <> 3 THEN 'ok' WHEN event_id % 5 < 3 THEN 'retry' ELSE 'quarantine' END AS outcome FROM events""")
def f18(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("event_id") % 4
    text = F.when(k == 0, F.concat(F.lit("Here:\n```json\n"), "props", F.lit("\n```\nDone"))).when(k == 1, F.col("props")).when(k == 2, F.concat(F.lit("so "), "props", F.lit(" it is"))).otherwise(F.lit("none {"))
    return view(spark, sf, "events").select("event_id", g.salvaged_json(text).alias("found"), g.salvage_outcome(text, F.col("event_id") % 5).alias("outcome"))


@query("f20_canonical_json", """SELECT o_orderkey, sha256('{"deep":{"custkey":' || o_custkey || ',"list":["' || o_orderstatus || '"]},"o_orderkey":' || o_orderkey || ',"o_orderpriority":' || CASE WHEN o_orderkey % 3 = 0 THEN 'null' ELSE '"' || o_orderpriority || '"' END || '}') AS sha FROM orders""")
def f20(spark: SparkSession, sf: str) -> DataFrame:
    """Nested values and nulls; columns come in another order than the text has them."""
    o = view(spark, sf, "orders").select(F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderpriority")).alias("o_orderpriority"), "o_orderkey", F.struct(F.col("o_custkey").alias("custkey"), F.array("o_orderstatus").alias("list")).alias("deep"))
    return o.select("o_orderkey", F.sha2(g.canonical_json(o, ["o_orderpriority", "o_orderkey", "deep"]), 256).alias("sha"))


@query("f32_geojson", None)
def f32(spark: SparkSession, sf: str) -> DataFrame:
    return c.geojson(s.poisson_clusters(view(spark, sf, "v_obs"), "2024-01-15 00:00:00", degrees=5.0, least_llr=0.5).where("is_cluster"))
