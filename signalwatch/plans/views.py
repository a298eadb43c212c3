"""Stand-in tables: what the surveillance operators take in, derived from the given tables by one SQL text for Spark and oracle."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

VIEWS = {
    "v_telemetry": "SELECT event_id, ts, value, event_type, user_id FROM {events}",
    "v_pairs": "SELECT l_orderkey AS report_id, p_brand AS drug, concat(l_returnflag, l_linestatus) AS event, CAST(l_shipdate AS DATE) AS day FROM {lineitem} JOIN {part} ON l_partkey = p_partkey",
    "v_daily": "SELECT event_type AS keyword, CAST(user_id % 10 AS STRING) AS district, datediff(CAST(ts AS DATE), DATE '1970-01-01') AS day, event_id FROM {events}",
    "v_obs": "SELECT event_id, CAST((user_id * 37) % 170 - 85 AS DOUBLE) AS lat, CAST((user_id * 91) % 350 - 175 AS DOUBLE) AS lon, ts, CAST(1 AS DOUBLE) AS weight FROM {events}",
    "v_mentions": "SELECT doc_id AS mention_id, source AS project_id, text, lang FROM {documents}",
    "v_talk": "SELECT conv_id * 1000 + turn AS mention_id, role AS project_id, text FROM {conversations}",
    "v_entities": "SELECT concat('ORG-', CAST(s_suppkey AS STRING)) AS id, 'ORG' AS entity_type, s_name AS name, least(greatest(s_acctbal / 10000, 0.0), 1.0) AS confidence, s_suppkey AS updated FROM {supplier} "
    "UNION ALL SELECT concat('PERSON-', CAST(c_custkey AS STRING)), 'PERSON', c_name, least(greatest(c_acctbal / 10000, 0.0), 1.0), c_custkey FROM {customer} "
    "UNION ALL SELECT concat('GEO-', CAST(n_nationkey AS STRING)), 'GEO', n_name, 0.9, CAST(n_nationkey AS BIGINT) FROM {nation} "
    "UNION ALL SELECT concat('EVENT-', CAST(o_orderkey AS STRING)), 'EVENT', concat('Order ', CAST(o_orderkey AS STRING)), least(o_totalprice / 500000, 1.0), o_orderkey FROM {orders}",
    "v_edges": "SELECT concat('ORG-', CAST(s_suppkey AS STRING)) AS src, concat('GEO-', CAST(s_nationkey AS STRING)) AS dst, '1995-01-01' AS valid_from, concat('based in ', CAST(s_nationkey AS STRING)) AS evidence FROM {supplier} "
    "UNION ALL SELECT concat('PERSON-', CAST(c_custkey AS STRING)), concat('GEO-', CAST(c_nationkey AS STRING)), '1995-01-01', concat('lives in ', CAST(c_nationkey AS STRING)) FROM {customer} "
    "UNION ALL SELECT concat('PERSON-', CAST(o_custkey AS STRING)), concat('EVENT-', CAST(o_orderkey AS STRING)), CAST(CAST(o_orderdate AS DATE) AS STRING), concat('placed ', o_orderpriority) FROM {orders}",
    "v_fetch": "SELECT event_id, event_type AS source, ts, CAST(floor(value) AS BIGINT) AS items, event_type <> 'error' AS ok, value AS latency FROM {events}",
    "v_vec": "SELECT vec_id, embedding, label FROM {embeddings}",
    "v_feed": "SELECT page_id AS item_id, concat('s', CAST(page_id % 4 AS STRING)) AS source, url, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, (page_id * 7919) % 100000 AS published FROM {pages}",
    "v_signals": "SELECT concat('sig-', CAST(o_orderkey AS STRING)) AS id, concat('p', CAST(o_custkey % 7 AS STRING)) AS project_id, CASE o_orderkey % 3 WHEN 0 THEN 'adr' WHEN 1 THEN 'trend' ELSE 'cluster' END AS kind, "
    "CASE o_orderstatus WHEN 'O' THEN 'new' WHEN 'F' THEN 'confirmed' ELSE 'more_data' END AS status, round(o_totalprice / 500000, 6) AS score, datediff(CAST(o_orderdate AS DATE), DATE '1970-01-01') AS detected, o_orderkey AS n FROM {orders}",
    "v_triage": "SELECT concat('sig-', CAST(l_orderkey AS STRING)) AS signal_id, l_linenumber AS seq, concat('user', CAST(l_suppkey % 5 AS STRING)) AS actor, CASE l_returnflag WHEN 'A' THEN 'confirm' WHEN 'R' THEN 'reject' ELSE 'more_data' END AS decision, "
    "CAST(datediff(CAST(l_shipdate AS DATE), DATE '1970-01-01') AS BIGINT) AS decided, l_partkey AS tie FROM {lineitem}",
    "v_chain": "SELECT user_id AS chain, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS sequence, props AS payload FROM {events}",
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A stand-in table, or a given one."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = VIEWS[name]
    return spark.sql(text, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in sorted(set(re.findall(r"{(\w+)}", text)))})


def _duck(text: str) -> str:
    text = re.sub(r"{(\w+)}", r"\1", text).replace("AS STRING)", "AS VARCHAR)")
    return re.sub(r"datediff\(CAST\((\w+) AS DATE\), DATE '1970-01-01'\)", r"datediff('day', DATE '1970-01-01', CAST(\1 AS DATE))", text)


def oracle(body: str) -> str:
    """DuckDB SQL with the views that `body` names in front of it."""
    names = [n for n in VIEWS if re.search(rf"\b{n}\b", body)]
    ahead = ", ".join(f"{n} AS ({_duck(VIEWS[n])})" for n in names)
    body = body.strip()
    if not ahead:
        return body
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {ahead}, {body[15:]}"
    if body.upper().startswith("WITH "):
        return f"WITH {ahead}, {body[5:]}"
    return f"WITH {ahead} {body}"
