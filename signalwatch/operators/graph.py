"""Property graph as tables: entities by id, immutable edges by uid, traversal by joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.names import evidence_features, hashed_vector, sparse_dot
from ..sources.scratch import written


def latest_by_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row a key: the first by `order` (falling columns; the last of them must decide ties)."""
    return df.withColumn("__k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__k = 1").drop("__k")


def upsert(stored: DataFrame, new: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """stored with new rows put in by key; the last writer wins. Both have the same columns."""
    return latest_by_key(stored.unionByName(new), keys, order)


def edge_uid(src: Column, dst: Column, valid_from: Column, evidence: Column) -> Column:
    """The identity of an edge: what it says and since when."""
    return F.concat(F.lit("rel:"), F.substring(F.sha2(F.concat_ws("|", src, dst, valid_from, evidence), 256), 1, 32))


def insert_absent(stored: DataFrame, new: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """Rows of new to add: the first of each key that stored doesn't have."""
    return latest_by_key(new, [key], order).join(stored.select(key), key, "left_anti")


def confident_events(entities: DataFrame, least: float = 0.85) -> DataFrame:
    """EVENT entities strictly above `least`; for batch and stream alike."""
    return entities.where((F.col("entity_type") == "EVENT") & (F.col("confidence") > least))


def top_locations(entities: DataFrame, limit: int) -> DataFrame:
    """The places updated last; ties by id."""
    return entities.where("entity_type = 'GEO'").orderBy(F.desc("updated"), "id").limit(limit)


def geo_graph(entities: DataFrame, edges: DataFrame, limit: int = 5000) -> dict[str, DataFrame]:
    """locations (latest `limit`, 1 to 20000), relationships that touch one (6 a location at most), and connected ORG and PERSON entities."""
    limit = min(20000, max(1, limit))
    locations = top_locations(entities, limit)
    ids = locations.select("id")
    near = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").unionByName(edges.join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select(*edges.columns)).dropDuplicates(["uid"])
    near = near.orderBy(F.desc("valid_from"), "uid").limit(6 * limit)
    ends = edge_ends(near)
    return {"locations": locations, "relationships": near, "connected": entities.where(F.col("entity_type").isin("ORG", "PERSON")).join(ends, "id", "left_semi")}


def edge_ends(edges: DataFrame) -> DataFrame:
    """(id): both ends of all edges, each once."""
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()


def within_hops(edges: DataFrame, seeds: DataFrame, hops: int = 3) -> DataFrame:
    """(id, hop): vertices at most `hops` undirected steps from seeds (id), with the fewest steps.

    Each step is an equi-join of the vertices that the step before reached for the first time, without those already reached, so a hub is
    expanded once. Each step is written to the shared folder, so no step is computed twice.
    """
    both = edges.select(F.col("src").alias("id"), F.col("dst").alias("to")).unionByName(edges.select(F.col("dst").alias("id"), F.col("src").alias("to")))
    fresh = written(seeds.select("id").distinct(), "hop")
    steps = fresh.withColumn("hop", F.lit(0))
    for k in range(1, hops + 1):
        fresh = written(both.join(fresh, "id", "left_semi").select(F.col("to").alias("id")).distinct().join(steps.select("id"), "id", "left_anti"), "hop")
        steps = steps.unionByName(fresh.withColumn("hop", F.lit(k)))
    return steps


def induced(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """Edges with both ends in vertices (id)."""
    ids = vertices.select("id")
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select(*edges.columns)


def connected_entities(entities: DataFrame, vertices: DataFrame) -> DataFrame:
    """Named ORG, PERSON and GEO entities of a subgraph."""
    return entities.where(F.col("entity_type").isin("ORG", "PERSON", "GEO") & (F.trim("name") != "")).join(vertices.select("id"), "id", "left_semi")


def plotted_arcs(edges: DataFrame, points: DataFrame) -> DataFrame:
    """edges with from_/to_ coordinates and resolved: both ends have a point (id, lat, lon). How many aren't: unresolved()."""
    a = points.select(F.col("id").alias("src"), F.col("lat").alias("from_lat"), F.col("lon").alias("from_lon"))
    b = points.select(F.col("id").alias("dst"), F.col("lat").alias("to_lat"), F.col("lon").alias("to_lon"))
    return edges.join(a, "src", "left").join(b, "dst", "left").withColumn("resolved", F.col("from_lat").isNotNull() & F.col("to_lat").isNotNull())


def unresolved(arcs: DataFrame) -> DataFrame:
    """(arcs, unresolved): how many arcs there are and how many of them can't be drawn."""
    return arcs.agg(F.count("*").alias("arcs"), F.count_if(~F.col("resolved")).alias("unresolved"))


def embedded_evidence(edges: DataFrame) -> DataFrame:
    """(evidence, vec): every distinct evidence text, embedded."""
    return edges.select("evidence").where("evidence is not null").distinct().withColumn("vec", hashed_vector(evidence_features(F.col("evidence"))))


def nearest_edges(edges: DataFrame, question: str, k: int = 5) -> DataFrame:
    """The k edges whose evidence is nearest to a question, by cosine rounded to nine places, then uid. Texts are embedded once each."""
    asked = hashed_vector(evidence_features(F.lit(question)))
    texts = embedded_evidence(edges).select("evidence", F.round(sparse_dot(F.col("vec"), asked), 9).alias("cosine"))
    return edges.join(texts, "evidence").orderBy(F.desc("cosine"), "uid").limit(k)


def answered(edges: DataFrame, entities: DataFrame, question: str, k: int = 5, hops: int = 3) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the graph around a question: the k nearest edges, what `hops` steps from their ends reach, and the edges between."""
    seen = within_hops(edges, edge_ends(nearest_edges(edges, question, k)), hops)
    return connected_entities(entities, seen), induced(edges, seen)
