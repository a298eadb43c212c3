"""From outputs to the graph: faults, merges, ids sent again, edges that follow."""

import json

import pytest

from signalwatch.operators import extraction as x
from signalwatch.operators import ledger
from signalwatch.operators.resolve import NameIndex

ENTITY = "id string, entity_type string, name string, confidence double, source_count bigint, updated bigint"
EDGE = "uid string, src string, dst string, valid_from string, evidence string"


def entity(i, name, kind="ORG", confidence=0.5, n=2, at="2024-01-02T00:00:00Z"):
    return {"entity": {"id": i, "entity_type": kind, "confidence": confidence, "source_count": n, "last_updated": at}, "canonical_name": name}


def edge(a, b, confidence=0.5, at="2024-01-01T00:00:00Z", evidence="works with"):
    return {"source_entity_id": a, "destination_entity_id": b, "relationship": {"confidence": confidence, "valid_from": at, "evidence_text": evidence}}


def outputs(spark, *payloads, attempt=1):
    rows = [(f"o{i}", p if isinstance(p, str) or p is None else "```json\n" + json.dumps(p) + "\n```", attempt) for i, p in enumerate(payloads)]
    return spark.createDataFrame(rows, "id string, text string, attempt int")


@pytest.fixture()
def graph(spark):
    stored = spark.createDataFrame([("s1", "ORG", "Corporation X", 0.76, 3, 1), ("s2", "ORG", "Harbor Forum", 0.4, 1, 1)], ENTITY)
    return x.Graph(stored, spark.createDataFrame([], EDGE), spark.createDataFrame([], "id string, canonical_id string"))


def test_faults(spark):
    good = {"entities": [entity("a", "A")], "relationships": [edge("a", "b")]}
    faults = [
        (good, []), ({}, []), ("none", ["json"]), (None, ["json"]), ("[1]", ["object"]), ({"entities": [entity("a", " ")]}, ["canonical_name"]), ({"entities": [entity("a", "A", "SHIP", 2.0, -1, "2024-01-02")]}, ["entity.confidence", "entity.entity_type", "entity.last_updated", "entity.source_count"]),
        ({"relationships": [edge("a", None, -1)]}, ["destination_entity_id", "relationship.confidence"]), ({"entities": [entity("a", "A"), None]}, None),
    ]
    for attempt, rejected in ((1, "retry"), (3, "quarantine")):
        got = {r["id"]: r for r in x.extracted(outputs(spark, *(p for p, _ in faults), attempt=attempt)).collect()}
        assert len(got) == len(faults)
        for i, (_, reasons) in enumerate(faults):
            r = got[f"o{i}"]
            assert r["outcome"] == ("ok" if reasons == [] else rejected) and (reasons is None or sorted(r["reasons"]) == reasons) and (reasons == [] or r["entities"] is None)


def test_salvage(spark):
    rows = ["```json\n{bad}\n``` then ```JSON\n[1]\n```", "a {\"b\": 1} c", "```json\n{bad}\n``` {\"b\": 1}", "{[}", None, ""]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string").orderBy("i").select(ledger.salvaged_json(x.F.col("t"))).collect()]
    assert got == ["[1]", '{"b": 1}', None, None, None, None]


@pytest.mark.parametrize("indexed", [False, True])
def test_graph_grows(spark, graph, tmp_path, indexed):
    match = None
    if indexed:
        index = NameIndex(spark, str(tmp_path / "names"), buckets=4)
        index.add(graph.entities.select("id", "entity_type", "name"), 0)
        match = index.matches
    first = {"entities": [entity("n1", "Corp. X", confidence=0.91), entity("n2", "Quite Other Works"), entity("n3", "quite other works", n=5), entity("s2", "Harbor Forum e.V.", confidence=0.2, n=9)], "relationships": [edge("n1", "n3"), edge("s1", "n2"), edge("n1", "s2")]}
    batch = outputs(spark, first, {"entities": [entity("bad", "B", confidence=7)]})
    step = x.ingested(batch, graph, match=match)
    rows = {r["id"]: (r["name"], r["confidence"], r["source_count"]) for r in step.graph.entities.collect()}
    # a merge keeps the name and adds counts; an id that is stored is replaced; two new names that are one have the smaller id
    assert rows == {"s1": ("Corporation X", 0.91, 5), "s2": ("Harbor Forum e.V.", 0.2, 9), "n2": ("Quite Other Works", 0.5, 7)}
    assert sorted((r["src"], r["dst"]) for r in step.graph.edges.collect()) == [("s1", "n2"), ("s1", "s2")]
    assert {tuple(r) for r in step.graph.aliases.collect()} == {("n1", "s1"), ("n3", "n2")} and {r[0] for r in step.touched.collect()} == {"s1", "s2", "n2"}
    assert {r["id"]: r["outcome"] for r in step.outcomes.collect()} == {"o0": "ok", "o1": "retry"}
    assert {(r["id"], r["hop"]) for r in x.around(step).collect()} == {("s1", 0), ("s2", 0), ("n2", 0)}
    again = x.ingested(batch, step.graph, match=match)
    for name in ("entities", "edges", "aliases"):
        assert sorted(getattr(again.graph, name).collect()) == sorted(getattr(step.graph, name).collect())
    older = x.ingested(outputs(spark, {"entities": [entity("s2", "Old", at="1970-01-01T00:00:00Z"), entity("n4", "Other Things", "GEO")], "relationships": [edge("n4", "s2")]}), step.graph)
    assert {r["id"]: r["name"] for r in older.graph.entities.collect()} == {"s1": "Corporation X", "s2": "Harbor Forum e.V.", "n2": "Quite Other Works", "n4": "Other Things"} and older.graph.edges.count() == 3


def test_nothing(spark, graph):
    step = x.ingested(outputs(spark, {}), graph)
    assert sorted(step.graph.entities.collect()) == sorted(graph.entities.collect()) and step.graph.edges.count() == step.touched.count() == 0
