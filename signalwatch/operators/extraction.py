"""From a model's outputs to the graph in one job: salvage, validation, resolution, upsert of entities, insertion of edges, what lies around."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written
from .graph import edge_uid, insert_absent, upsert, within_hops
from .ledger import salvaged_json, utc_timestamp
from .resolve import matches, merged_new

PAYLOAD = (
    "entities array<struct<entity:struct<id:string,entity_type:string,confidence:double,source_count:bigint,last_updated:string>,canonical_name:string>>, "
    "relationships array<struct<source_entity_id:string,destination_entity_id:string,relationship:struct<confidence:double,valid_from:string,evidence_text:string>>>"
)
# Types of entities.
TYPES = ["ORG", "PERSON", "GEO", "EVENT"]


@dataclass(frozen=True)
class Graph:
    """entities (id, entity_type, name, confidence, source_count, updated), edges (uid, src, dst, valid_from, evidence), aliases (id, canonical_id): ids that were merged into others."""

    entities: DataFrame
    edges: DataFrame
    aliases: DataFrame


@dataclass(frozen=True)
class Step:
    """graph: what the next batch starts from. outcomes (id, outcome, reasons): of every output. touched (id): entities that this batch names or merges into."""

    graph: Graph
    outcomes: DataFrame
    touched: DataFrame


def _bad(name: str, fits: Column) -> Column:
    """A reason, unless the condition holds; null counts as not."""
    return F.when(~F.coalesce(fits, F.lit(False)), F.lit(name))


def _entity_reasons(e: Column) -> Column:
    x = e["entity"]
    return F.array_compact(F.array(
        _bad("entity.id", F.trim(x["id"]) != ""), _bad("entity.entity_type", x["entity_type"].isin(TYPES)), _bad("entity.confidence", x["confidence"].between(0, 1)),
        _bad("entity.source_count", x["source_count"] >= 0), _bad("entity.last_updated", utc_timestamp(x["last_updated"]).isNotNull()), _bad("canonical_name", F.trim(e["canonical_name"]) != "")))


def _edge_reasons(r: Column) -> Column:
    x = r["relationship"]
    return F.array_compact(F.array(
        _bad("source_entity_id", F.trim(r["source_entity_id"]) != ""), _bad("destination_entity_id", F.trim(r["destination_entity_id"]) != ""), _bad("relationship.confidence", x["confidence"].between(0, 1)),
        _bad("relationship.valid_from", utc_timestamp(x["valid_from"]).isNotNull()), _bad("relationship.evidence_text", F.trim(x["evidence_text"]) != "")))


def extracted(outputs: DataFrame, most: int = 3) -> DataFrame:
    """outputs (id, text, attempt) as (id, outcome, reasons, entities, relationships).

    An output is `ok` if it holds a JSON object all of whose entities and relationships are valid; one fault rejects the whole, as a batch is written
    whole. Before attempt `most` a rejected one is to `retry` with its reasons, then it goes to `quarantine`. A list that is absent is empty.
    """
    read = outputs.withColumn("json", salvaged_json(F.col("text"))).withColumn("p", F.from_json("json", PAYLOAD))
    none = F.array().cast("array<string>")
    of = lambda name, reasons: F.coalesce(F.flatten(F.transform(F.col(f"p.{name}"), reasons)), none)
    faults = F.when(F.col("json").isNull(), F.array(F.lit("json"))).when(~F.startswith("json", F.lit("{")), F.array(F.lit("object"))).otherwise(F.array_distinct(F.concat(of("entities", _entity_reasons), of("relationships", _edge_reasons))))
    ok = F.size("reasons") == 0
    told = read.withColumn("reasons", faults).withColumn("outcome", F.when(ok, "ok").when(F.col("attempt") < most, "retry").otherwise("quarantine"))
    return told.select("id", "outcome", "reasons", *(F.when(ok, F.col(f"p.{c}")).alias(c) for c in ("entities", "relationships")))


def resolved(new: DataFrame, graph: Graph, match: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(id, canonical_id) of new entities (id, entity_type, name) that are neither stored nor settled before: the stored entity that each merges with, else the smallest id that it is one with among the new ones, else itself.

    match: by default against all stored names; NameIndex(...).matches reads only the buckets that the new names fall into.
    """
    known = graph.entities.select("id").unionByName(graph.aliases.select("id"))
    fresh = written(new.select("id", "entity_type", "name").join(known, "id", "left_anti"), "fresh")
    found = match(fresh) if match else matches(fresh, graph.entities.select("id", "entity_type", "name"))
    told = written(found.select("id", "action", "match_id"), "matched")
    made = fresh.join(told.where("action = 'create'").select("id"), "id", "left_semi")
    return told.where("action = 'merge'").select("id", F.col("match_id").alias("canonical_id")).unionByName(merged_new(made).select("id", F.col("merged_id").alias("canonical_id")))


def ingested(outputs: DataFrame, graph: Graph, most: int = 3, match: Callable[[DataFrame], DataFrame] | None = None) -> Step:
    """The graph after a batch of outputs (id, text, attempt).

    Of an entity that comes twice the latest row counts (ties: the surer, then the smaller name). One whose id is stored replaces what is stored, count included, if it is newer; one that merges adds its source
    count to the entity that it merges with, raises its confidence and renews its time, while the name stays. An id merges once: sent again it is known by its
    alias and counts nothing. Edges lead to the entities that their ends are now, and are inserted only if the graph lacks them.
    """
    told = written(extracted(outputs, most), "extracted")
    each = told.select(F.explode("entities").alias("e")).select("e.entity.*", F.trim("e.canonical_name").alias("name")).withColumn("updated", F.unix_seconds(utc_timestamp(F.col("last_updated"))))
    order = [F.desc("updated"), F.desc("confidence"), F.col("name"), F.col("entity_type"), F.desc("source_count")]
    columns = ["id", "entity_type", "name", "confidence", "source_count", "updated"]
    rows = written(upsert(each.select(*columns).limit(0), each.select(*columns), ["id"], order), "entities")
    new = written(resolved(rows, graph, match), "aliases")
    aliases = written(graph.aliases.unionByName(new.where("id <> canonical_id")), "aliases")

    own = rows.join(aliases.select("id"), "id", "left_anti")  # neither merged now nor before
    both = graph.entities.select(*columns, F.lit(0).alias("fresh")).unionByName(own.withColumn("fresh", F.lit(1)))
    base = upsert(both.limit(0), both, ["id"], [F.desc("updated"), F.col("fresh"), *order[1:]]).select(*columns)
    joined = rows.join(new.where("id <> canonical_id"), "id").groupBy(F.col("canonical_id").alias("id")).agg(F.max("confidence").alias("c"), F.sum("source_count").alias("n"), F.max("updated").alias("u"))
    entities = written(base.join(joined, "id", "left").select(
        "id", "entity_type", "name", F.greatest("confidence", "c").alias("confidence"), (F.col("source_count") + F.coalesce("n", F.lit(0))).alias("source_count"), F.greatest("updated", "u").alias("updated")), "entities")

    said = told.select(F.explode("relationships").alias("r")).select(F.col("r.source_entity_id").alias("src"), F.col("r.destination_entity_id").alias("dst"), F.col("r.relationship.valid_from").alias("valid_from"), F.col("r.relationship.evidence_text").alias("evidence"))
    for end in ("src", "dst"):
        said = said.join(aliases.select(F.col("id").alias(end), "canonical_id"), end, "left").withColumn(end, F.coalesce("canonical_id", end)).drop("canonical_id")
    said = said.withColumn("uid", edge_uid(F.col("src"), F.col("dst"), F.col("valid_from"), F.col("evidence"))).select("uid", "src", "dst", "valid_from", "evidence")
    edges = written(graph.edges.unionByName(insert_absent(graph.edges, said, "uid", [F.col("src"), F.col("dst")])), "edges")
    touched = own.select("id").unionByName(joined.select("id")).distinct()
    return Step(Graph(entities, edges, aliases), told.select("id", "outcome", "reasons"), touched)


def around(step: Step, hops: int = 3) -> DataFrame:
    """(id, hop): what lies within some steps of the entities that a batch touched."""
    return within_hops(step.graph.edges, step.touched, hops)
