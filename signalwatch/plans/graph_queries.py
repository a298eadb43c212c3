"""Queries over entities, edges and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import grams, lexical_distance, name_vectors, normalized_name
from ..functions.stages import embedding, hashed_name_model, md5_place, nonzero_weights
from ..operators import extraction as x
from ..operators import graph as g
from ..operators import resolve as r
from ..operators import vector_index as vi
from ..operators import vectors as v
from ..sources.scratch import folder
from .registry import registry, rounded
from .views import view

QUERIES, ORACLES, query = registry()

_UID = "'rel:' || substr(sha256(src || '|' || dst || '|' || valid_from || '|' || evidence), 1, 32)"


def edges(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "v_edges").withColumn("uid", g.edge_uid(F.col("src"), F.col("dst"), F.col("valid_from"), F.col("evidence")))


@query("f19_edge_uid", f"SELECT src, dst, {_UID} AS uid FROM v_edges")
def f19(spark: SparkSession, sf: str) -> DataFrame:
    return edges(spark, sf).select("src", "dst", "uid")


@query("s14_entity_upsert", """WITH stored AS (SELECT *, 0 AS batch FROM v_entities WHERE updated % 3 <> 0), fresh AS (SELECT id, entity_type, upper(name) AS name, confidence, updated, 1 AS batch FROM v_entities WHERE updated % 2 = 0)
    SELECT id, entity_type, name, batch FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY batch DESC, name) AS k FROM (SELECT * FROM stored UNION ALL SELECT * FROM fresh)) WHERE k = 1""")
def s14(spark: SparkSession, sf: str) -> DataFrame:
    e = view(spark, sf, "v_entities")
    new = e.where("updated % 2 = 0").withColumn("name", F.upper("name")).withColumn("batch", F.lit(1))
    return g.upsert(e.where("updated % 3 <> 0").withColumn("batch", F.lit(0)), new, ["id"], [F.desc("batch"), F.col("name")]).select("id", "entity_type", "name", "batch")


@query("s15_collection_upsert", """SELECT signal_id, actor, decision, decided FROM (SELECT *, row_number() OVER (PARTITION BY signal_id, actor ORDER BY decided DESC, seq DESC, tie DESC) AS k FROM v_triage) WHERE k = 1""")
def s15(spark: SparkSession, sf: str) -> DataFrame:
    t = view(spark, sf, "v_triage")
    return g.upsert(t.where("seq % 2 = 0"), t.where("seq % 2 = 1"), ["signal_id", "actor"], [F.desc("decided"), F.desc("seq"), F.desc("tie")]).select("signal_id", "actor", "decision", "decided")


@query("w12_latest_per_key", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def w12(spark: SparkSession, sf: str) -> DataFrame:
    return g.latest_by_key(view(spark, sf, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", "event_type")


@query("j10_insert_absent_edges", f"""WITH e AS (SELECT *, {_UID} AS uid FROM v_edges), stored AS (SELECT uid FROM e WHERE src LIKE '%1'), x AS (SELECT *, 1 AS b FROM e UNION ALL SELECT *, 2 FROM e WHERE dst LIKE '%2')
    SELECT uid, src, dst FROM (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY b) AS k FROM x) WHERE k = 1 AND uid NOT IN (SELECT uid FROM stored)""")
def j10(spark: SparkSession, sf: str) -> DataFrame:
    e = edges(spark, sf)
    new = e.withColumn("b", F.lit(1)).unionByName(e.where("dst like '%2'").withColumn("b", F.lit(2)))
    return g.insert_absent(e.where("src like '%1'"), new, "uid", [F.col("b")]).select("uid", "src", "dst")


@query("p8_confident_events", "SELECT id, round(confidence, 6) AS confidence FROM v_entities WHERE entity_type = 'EVENT' AND confidence > 0.85")
def p8(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(g.confident_events(view(spark, sf, "v_entities")).select("id", "confidence"))


_GEO = f"""WITH e AS (SELECT DISTINCT src, dst, valid_from, {_UID} AS uid FROM v_edges), loc AS (SELECT * FROM v_entities WHERE entity_type = 'GEO' ORDER BY updated DESC, id LIMIT 5),
    rel AS (SELECT * FROM e WHERE src IN (SELECT id FROM loc) OR dst IN (SELECT id FROM loc) ORDER BY valid_from DESC, uid LIMIT 30)"""


@query("j4_geo_graph", f"""{_GEO} SELECT 'location' AS part, id FROM loc UNION ALL SELECT 'edge', uid FROM rel UNION ALL
    SELECT 'connected', id FROM v_entities WHERE entity_type IN ('ORG', 'PERSON') AND id IN (SELECT src FROM rel UNION SELECT dst FROM rel)""")
def j4(spark: SparkSession, sf: str) -> DataFrame:
    out = g.geo_graph(view(spark, sf, "v_entities"), edges(spark, sf), 5)
    part = lambda name, df, c: df.select(F.lit(name).alias("part"), F.col(c).alias("id"))
    return part("location", out["locations"], "id").unionByName(part("edge", out["relationships"], "uid")).unionByName(part("connected", out["connected"], "id"))


@query("t4_top_locations", "SELECT id, updated FROM v_entities WHERE entity_type = 'GEO' ORDER BY updated DESC, id LIMIT 10")
def t4(spark: SparkSession, sf: str) -> DataFrame:
    return g.top_locations(view(spark, sf, "v_entities"), 10).select("id", "updated")


_HOPS = """WITH ends AS (SELECT src AS id, dst AS t FROM v_edges UNION SELECT dst, src FROM v_edges), s AS (SELECT 'ORG-1' AS id), h1 AS (SELECT id, 0 AS hop FROM s UNION ALL SELECT DISTINCT t, 1 FROM ends WHERE id IN (SELECT id FROM s)),
    h2 AS (SELECT * FROM h1 UNION ALL SELECT DISTINCT t, 2 FROM ends WHERE id IN (SELECT id FROM h1)), h3 AS (SELECT * FROM h2 UNION ALL SELECT DISTINCT t, 3 FROM ends WHERE id IN (SELECT id FROM h2)), seen AS (SELECT id, min(hop) AS hop FROM h3 GROUP BY 1)"""


def _seen(spark: SparkSession, sf: str) -> DataFrame:
    return g.within_hops(view(spark, sf, "v_edges"), view(spark, sf, "v_entities").where("id = 'ORG-1'"))


@query("j5_k_hop", f"{_HOPS} SELECT id, CAST(hop AS INTEGER) AS hop FROM seen")
def j5(spark: SparkSession, sf: str) -> DataFrame:
    return _seen(spark, sf)


@query("j5_induced_edges", f"{_HOPS} SELECT src, dst, valid_from FROM v_edges WHERE src IN (SELECT id FROM seen) AND dst IN (SELECT id FROM seen)")
def j5_edges(spark: SparkSession, sf: str) -> DataFrame:
    return g.induced(view(spark, sf, "v_edges"), _seen(spark, sf)).select("src", "dst", "valid_from")


@query("j13_connected_entities", f"{_HOPS} SELECT id, entity_type, name FROM v_entities WHERE entity_type IN ('ORG', 'PERSON', 'GEO') AND trim(name) <> '' AND id IN (SELECT id FROM seen)")
def j13(spark: SparkSession, sf: str) -> DataFrame:
    return g.connected_entities(view(spark, sf, "v_entities"), _seen(spark, sf)).select("id", "entity_type", "name")


@query("u2_edge_ends", "SELECT src AS id FROM v_edges UNION SELECT dst FROM v_edges")
def u2(spark: SparkSession, sf: str) -> DataFrame:
    return g.edge_ends(view(spark, sf, "v_edges"))


@query("t5_vector_top_k", """WITH q AS (SELECT embedding AS e FROM v_vec WHERE vec_id = 0) SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(e AS DOUBLE[])), 6) AS cosine FROM v_vec, q ORDER BY round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(e AS DOUBLE[])), 9) DESC, vec_id LIMIT 5""")
def t5(spark: SparkSession, sf: str) -> DataFrame:
    rows = view(spark, sf, "v_vec")
    target = rows.where("vec_id = 0").select("embedding").first()
    return rounded(v.top_k(rows, target[0] if target else [1.0] * 64, 5).select("vec_id", "cosine"))


_UNIT = "list_transform(CAST(embedding AS DOUBLE[]), lambda x: CAST(x AS DOUBLE))"


@query("t5_nearest_to_many", f"""WITH u AS (SELECT vec_id, {_UNIT} AS e FROM v_vec), s AS (SELECT q.vec_id AS question, u.vec_id, round(list_cosine_similarity(q.e, u.e), 9) AS c FROM u q JOIN u ON true WHERE q.vec_id % 20 = 0)
    SELECT question, vec_id, round(c, 6) AS cosine FROM (SELECT *, row_number() OVER (PARTITION BY question ORDER BY c DESC, vec_id) AS k FROM s) WHERE k <= 5""")
def t5_many(spark: SparkSession, sf: str) -> DataFrame:
    """Every vector whose id is divisible by 20, against all."""
    rows = view(spark, sf, "v_vec")
    return rounded(v.nearest(rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("question"), "embedding"), rows, 5))


@query("t5_indexed_nearest")
def t5_indexed(spark: SparkSession, sf: str) -> DataFrame:
    """As t5_nearest_to_many, through an index that is built first; tests hold its recall against the exact search."""
    rows = view(spark, sf, "v_vec")
    index = vi.built(rows, folder(spark, "vectors"))
    return rounded(vi.search(index, rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("question"), "embedding"), 5))


@query("j9_unresolved", """WITH p AS (SELECT id FROM v_entities WHERE entity_type IN ('GEO', 'ORG')) SELECT count(*) AS arcs, count(*) FILTER (src NOT IN (SELECT id FROM p) OR dst NOT IN (SELECT id FROM p)) AS unresolved FROM v_edges""")
def j9_unresolved(spark: SparkSession, sf: str) -> DataFrame:
    points = view(spark, sf, "v_entities").where("entity_type in ('GEO', 'ORG')").select("id", F.lit(1.0).alias("lat"), F.lit(1.0).alias("lon"))
    return g.unresolved(g.plotted_arcs(view(spark, sf, "v_edges"), points))


@query("j9_plotted_arcs", """WITH p AS (SELECT id, CAST(updated AS DOUBLE) AS lat, -CAST(updated AS DOUBLE) AS lon FROM v_entities WHERE entity_type IN ('GEO', 'ORG'))
    SELECT src, dst, a.lat AS from_lat, b.lon AS to_lon, a.lat IS NOT NULL AND b.lat IS NOT NULL AS resolved FROM v_edges LEFT JOIN p a ON a.id = src LEFT JOIN p b ON b.id = dst""")
def j9(spark: SparkSession, sf: str) -> DataFrame:
    points = view(spark, sf, "v_entities").where("entity_type in ('GEO', 'ORG')").select("id", F.col("updated").cast("double").alias("lat"), (-F.col("updated").cast("double")).alias("lon"))
    return g.plotted_arcs(view(spark, sf, "v_edges"), points).select("src", "dst", "from_lat", "to_lon", "resolved")


_NORM = "array_to_string(list_transform(regexp_extract_all(lower({}), '[a-z0-9]+'), lambda t: CASE t WHEN 'co' THEN 'company' WHEN 'corp' THEN 'corporation' WHEN 'inc' THEN 'incorporated' WHEN 'intl' THEN 'international' WHEN 'ltd' THEN 'limited' ELSE t END), ' ')"


@query("f7_normalized_names", f"SELECT id, {_NORM.format('name || chr(32) || chr(67) || chr(111) || chr(46)')} AS norm FROM v_entities")
def f7(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "v_entities").select("id", normalized_name(F.concat("name", F.lit(" Co."))).alias("norm"))


@query("f8_name_grams", f"""WITH n AS (SELECT id, ' ' || {_NORM.format('name')} || ' ' AS p FROM v_entities)
    SELECT id, g, count(*) AS n FROM (SELECT id, unnest(list_transform(range(1, length(p) - 1), lambda i: substr(p, CAST(i AS INTEGER), 3))) AS g FROM n) GROUP BY 1, 2""")
def f8(spark: SparkSession, sf: str) -> DataFrame:
    # names are dealt out by id, so that their grams, many times as many, aren't
    names = view(spark, sf, "v_entities").select("id", normalized_name(F.col("name")).alias("norm")).repartition("id")
    return names.select("id", F.explode(grams(F.col("norm"), 3, 3)).alias("g")).groupBy("id", "g").agg(F.count("*").alias("n"))


def _hashed(key: str) -> str:
    """(key, b, w) from f (key, g): signed feature hashing to unit length."""
    return f"""h AS (SELECT {key}, CAST(('0x' || substr(md5(g), 1, 8)) AS BIGINT) % 192 AS b, CASE WHEN CAST(('0x' || substr(md5(g), 9, 1)) AS BIGINT) % 2 = 1 THEN 1.0 ELSE -1.0 END AS s FROM f),
    c AS (SELECT {key}, CAST(b AS INTEGER) AS b, CAST(sum(s) AS DOUBLE) AS w FROM h GROUP BY 1, 2), v AS (SELECT {key}, b, w / sqrt(sum(w * w) OVER (PARTITION BY {key})) AS w FROM c WHERE w <> 0)"""


_GRAMS = f"""WITH n AS (SELECT id, ' ' || {_NORM.format('name')} || ' ' AS p FROM v_entities), f AS (SELECT id, unnest(flatten(list_transform([3, 4, 5], lambda k: list_transform(range(1, length(p) - k + 2), lambda i: substr(p, CAST(i AS INTEGER), CAST(k AS INTEGER)))))) AS g FROM n), {_hashed('id')}"""
#: What the hook says of a model's 32-bit weights: each as a share of the largest, which small whole numbers give.
_SHARES = f"{_GRAMS} SELECT id, b, round(w / max(abs(w)) OVER (PARTITION BY id), 4) AS share FROM c WHERE w <> 0"
_FEATURES = "unnest(string_split({0}, ' ') || list_transform(range(1, length({0}) - 2), lambda i: substr({0}, CAST(i AS INTEGER), 4)))"


@query("f8_name_vectors", f"{_GRAMS} SELECT id, b, round(w, 6) AS w FROM v")
def f8v(spark: SparkSession, sf: str) -> DataFrame:
    """Sparse signed feature hashing of all names."""
    names = view(spark, sf, "v_entities").select("id", normalized_name(F.col("name")).alias("norm")).repartition("id")
    return name_vectors(names).select("id", F.explode("vec").alias("x")).select("id", "x.b", F.round("x.w", 6).alias("w"))


@query("x2_embedding_hook", _SHARES)
def x2(spark: SparkSession, sf: str) -> DataFrame:
    """A model behind the hook that hashes as f8_name_vectors does: every weight of every name."""
    embed = embedding(lambda: hashed_name_model(place=md5_place))
    names = view(spark, sf, "v_entities").select("id", normalized_name(F.col("name")).alias("norm")).repartition("id")
    weights = nonzero_weights(names.select("id", embed(F.col("norm")).alias("v")))
    return weights.select("id", "b", F.round(F.col("w").cast("double") / F.col("most"), 4).alias("share"))


@query("f9_hashed_vectors", f"WITH d AS (SELECT DISTINCT evidence, lower(evidence) AS p FROM v_edges), f AS (SELECT evidence, {_FEATURES.format('p')} AS g FROM d), {_hashed('evidence')} SELECT evidence, b, round(w, 6) AS w FROM v")
def f9(spark: SparkSession, sf: str) -> DataFrame:
    """Evidence of all edges: words and 4-character runs, hashed as a question is."""
    return g.embedded_evidence(view(spark, sf, "v_edges")).select("evidence", F.explode("vec").alias("x")).select("evidence", "x.b", F.round("x.w", 6).alias("w"))


_QUESTION = "who lives in 7 and who placed 1-urgent"
_NEAR = f"""d AS (SELECT evidence, lower(evidence) AS p FROM (SELECT DISTINCT evidence FROM v_edges) UNION ALL SELECT '?', '{_QUESTION}'), f AS (SELECT evidence, {_FEATURES.format('p')} AS g FROM d), {_hashed('evidence')},
    cos AS (SELECT x.evidence, round(sum(x.w * y.w), 9) AS cosine FROM v x JOIN v y ON y.evidence = '?' AND x.b = y.b WHERE x.evidence <> '?' GROUP BY 1),
    near AS (SELECT e.*, {_UID} AS uid FROM v_edges e LEFT JOIN cos USING (evidence) ORDER BY coalesce(cosine, 0) DESC, uid LIMIT 5)"""
_REACH = """ends AS (SELECT src AS id, dst AS t FROM v_edges UNION SELECT dst, src FROM v_edges), h0 AS (SELECT src AS id FROM near UNION SELECT dst FROM near), h1 AS (SELECT id FROM h0 UNION SELECT t FROM ends WHERE id IN (SELECT id FROM h0)),
    h2 AS (SELECT id FROM h1 UNION SELECT t FROM ends WHERE id IN (SELECT id FROM h1)), h3 AS (SELECT id FROM h2 UNION SELECT t FROM ends WHERE id IN (SELECT id FROM h2))"""


@query("t5_nearest_edges", f"WITH {_NEAR} SELECT uid, src, dst, evidence FROM near")
def t5_edges(spark: SparkSession, sf: str) -> DataFrame:
    return g.nearest_edges(edges(spark, sf), _QUESTION).select("uid", "src", "dst", "evidence")


@query("graph_question", f"""WITH {_NEAR}, {_REACH} SELECT 'edge' AS part, src AS id, dst AS label FROM v_edges WHERE src IN (SELECT id FROM h3) AND dst IN (SELECT id FROM h3)
    UNION ALL SELECT 'node', id, name FROM v_entities WHERE entity_type IN ('ORG', 'PERSON', 'GEO') AND trim(name) <> '' AND id IN (SELECT id FROM h3)""")
def graph_question(spark: SparkSession, sf: str) -> DataFrame:
    """From a question in words to the graph around the evidence nearest to it."""
    nodes, between = g.answered(edges(spark, sf), view(spark, sf, "v_entities"), _QUESTION)
    part = lambda name, df, i, label: df.select(F.lit(name).alias("part"), F.col(i).alias("id"), F.col(label).alias("label"))
    return part("edge", between, "src", "dst").unionByName(part("node", nodes, "id", "name"))


@query("f10_name_distances", f"""SELECT p_partkey AS k, round(CASE WHEN x = y THEN 0 ELSE levenshtein(x, y) / CAST(greatest(length(x), length(y)) AS DOUBLE) END, 6) AS d FROM (SELECT p_partkey, lower(p_name) AS x, lower(p_type) AS y FROM part)
    UNION ALL SELECT -c_custkey, round(levenshtein(lower(c_name), lower(n_name)) / CAST(greatest(length(c_name), length(n_name)) AS DOUBLE), 6) FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def f10(spark: SparkSession, sf: str) -> DataFrame:
    """Names of parts against their types, and of customers against their nations."""
    p = view(spark, sf, "part").select(F.col("p_partkey").alias("k"), F.lower("p_name").alias("x"), F.lower("p_type").alias("y"))
    c = view(spark, sf, "customer").join(view(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select((-F.col("c_custkey")).alias("k"), F.lower("c_name").alias("x"), F.lower("n_name").alias("y"))
    return p.unionByName(c).select("k", F.round(lexical_distance(F.col("x"), F.col("y")), 6).alias("d"))


def _variants(spark: SparkSession, sf: str) -> DataFrame:
    """New names: those stored in lower case, with a legal form added, or with a letter missing."""
    e = view(spark, sf, "v_entities").select("id", "entity_type", "name", "updated")
    changed = F.when(F.col("updated") % 3 == 0, F.concat(F.lower("name"), F.lit(" ltd"))).when(F.col("updated") % 3 == 1, F.lower("name")).otherwise(F.regexp_replace("name", "[er]", ""))
    return e.select(F.concat(F.lit("new-"), "id").alias("id"), "entity_type", changed.alias("name"))


@query("j6_entity_matches")
def j6(spark: SparkSession, sf: str) -> DataFrame:
    """Variants of all names against the names stored; tests hold it against brute force."""
    return rounded(r.matches(_variants(spark, sf), view(spark, sf, "v_entities").select("id", "entity_type", "name")))


@query("j6_merged_new")
def j6_new(spark: SparkSession, sf: str) -> DataFrame:
    """Variants and names among themselves; tests hold it against brute force."""
    return r.merged_new(_variants(spark, sf).unionByName(view(spark, sf, "v_entities").select("id", "entity_type", "name")))


@query("a9_merge_fold", "SELECT n_regionkey AS region, round(max(s_acctbal), 6) AS confidence, count(*) AS source_count, max(s_suppkey) AS updated FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1")
def a9(spark: SparkSession, sf: str) -> DataFrame:
    s = view(spark, sf, "supplier").join(view(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return rounded(r.folded(s.select(F.col("n_regionkey").alias("region"), F.col("s_acctbal").alias("confidence"), F.lit(1).cast("bigint").alias("source_count"), F.col("s_suppkey").alias("updated")), "region"))


#: A model's output for every supplier and customer: one entity, by its name in capitals or, for every fifth, by a name that nobody has, and an edge to its nation; some outputs are broken.
_SOURCES = """SELECT concat('ORG-', CAST(s_suppkey AS STRING)) AS of, s_suppkey AS k, 'ORG' AS t, s_name AS name, s_nationkey AS nation FROM {supplier} UNION ALL SELECT concat('PERSON-', CAST(c_custkey AS STRING)), c_custkey, 'PERSON', c_name, c_nationkey FROM {customer}"""
_TOLD = """SELECT concat('out-', of) AS id, of, k, t, nation, concat('new-', of) AS e, CASE WHEN k % 5 = 0 THEN md5(of) ELSE upper(name) END AS name, CASE WHEN k % 7 = 3 THEN CASE WHEN k % 2 = 0 THEN 'retry' ELSE 'quarantine' END ELSE 'ok' END AS outcome FROM src"""


def _outputs(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.sql(_TOLD.replace("src", "{src}"), src=spark.sql(_SOURCES, supplier=view(spark, sf, "supplier"), customer=view(spark, sf, "customer")))
    entity = F.struct(F.struct(F.col("e").alias("id"), F.col("t").alias("entity_type"), F.lit(0.5).alias("confidence"), F.lit(2).alias("source_count"), F.lit("2024-01-02T00:00:00Z").alias("last_updated")).alias("entity"), F.col("name").alias("canonical_name"))
    # a share beyond 1 is a fault of the whole output
    said = F.struct(F.when(F.col("outcome") == "ok", 0.5).otherwise(1.5).alias("confidence"), F.lit("2024-01-02T00:00:00Z").alias("valid_from"), F.lit("is in").alias("evidence_text"))
    edge = F.struct(F.col("e").alias("source_entity_id"), F.concat(F.lit("GEO-"), F.col("nation").cast("string")).alias("destination_entity_id"), said.alias("relationship"))
    json = F.to_json(F.struct(F.array(entity).alias("entities"), F.array(edge).alias("relationships")))
    return rows.select("id", F.concat(F.lit("Found:\n```json\n"), json, F.lit("\n```")).alias("text"), (F.col("k") % 2 * 2 + 1).alias("attempt"))


@query("graph_extraction", f"""WITH src AS ({_SOURCES.replace("{supplier}", "supplier").replace("{customer}", "customer").replace("STRING", "VARCHAR")}), told AS ({_TOLD}), good AS (SELECT *, CASE WHEN k % 5 = 0 THEN e ELSE of END AS now FROM told WHERE outcome = 'ok'),
    first AS (SELECT *, CASE WHEN k % 5 = 0 THEN e ELSE min(of) OVER (PARTITION BY t, lower(name)) END AS id2 FROM good), made AS (SELECT e AS id, name, CAST(2 AS BIGINT) AS n FROM first WHERE k % 5 = 0),
    old AS (SELECT v.id, v.name, CAST(1 + 2 * count(f.e) AS BIGINT) AS n FROM v_entities v LEFT JOIN first f ON f.id2 = v.id AND f.k % 5 <> 0 WHERE v.entity_type <> 'EVENT' GROUP BY 1, 2),
    ed AS (SELECT DISTINCT id2 AS src, 'GEO-' || nation AS dst FROM first)
    SELECT 'entity' AS part, id, name AS label, n FROM old UNION ALL SELECT 'entity', id, name, n FROM made UNION ALL SELECT 'edge', src, dst, CAST(0 AS BIGINT) FROM ed UNION ALL SELECT 'outcome', id, outcome, CAST(0 AS BIGINT) FROM told
    UNION ALL SELECT 'around', id, 'hop', CAST(0 AS BIGINT) FROM (SELECT src AS id FROM ed) UNION ALL SELECT 'around', dst, 'hop', CAST(1 AS BIGINT) FROM (SELECT DISTINCT dst FROM ed)""")
def graph_extraction(spark: SparkSession, sf: str) -> DataFrame:
    """From outputs to the graph: what is known merges, what isn't is created, edges follow, and what lies a step around."""
    stored = view(spark, sf, "v_entities").where("entity_type <> 'EVENT'").select("id", "entity_type", "name", "confidence", F.lit(1).cast("bigint").alias("source_count"), F.lit(0).cast("bigint").alias("updated"))
    graph = x.Graph(stored, edges(spark, sf).select("uid", "src", "dst", "valid_from", "evidence").limit(0), spark.createDataFrame([], "id string, canonical_id string"))
    step = x.ingested(_outputs(spark, sf), graph)
    part = lambda name, df, i, label, n: df.select(F.lit(name).alias("part"), F.col(i).alias("id"), label.alias("label"), n.cast("bigint").alias("n"))
    none = F.lit(0)
    return (
        part("entity", step.graph.entities, "id", F.col("name"), F.col("source_count")).unionByName(part("edge", step.graph.edges, "src", F.col("dst"), none))
        .unionByName(part("outcome", step.outcomes, "id", F.col("outcome"), none)).unionByName(part("around", x.around(step, 1), "id", F.lit("hop"), F.col("hop"))))
