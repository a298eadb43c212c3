"""Vectors of many names at once: what the column function gives, each gram hashed once, names dealt out by id."""

from pyspark.sql import functions as F

from signalwatch.functions.names import grams, hashed_vector, name_vectors
from signalwatch.functions.stages import hashed_name_model
from signalwatch.plans.graph_queries import QUERIES

SF = "/root/testdata/sf0.001"


def test_vectors_of_many_names(spark):
    names = spark.createDataFrame([("a", "acme widgets"), ("b", ""), ("c", None), ("d", " "), ("e", "x"), ("f", "aaaa aaaa"), ("g", "order 12")], "id string, norm string")
    flat = lambda df: {r["id"]: None if r["vec"] is None else [(x["b"], round(x["w"], 12)) for x in r["vec"]] for r in df.collect()}
    assert flat(name_vectors(names)) == flat(names.select("id", hashed_vector(grams(F.col("norm"))).alias("vec")))


def test_a_gram_is_hashed_once():
    asked = []
    model = hashed_name_model(place=lambda g, width: (asked.append(g), (len(g), 1))[1])
    model(["order 1", "order 12", "order 1"])
    model(["order 1"])
    assert len(asked) == len(set(asked))


def test_names_are_dealt_out(spark):
    """A few files are a few tasks, so names go by id before they are hashed."""
    for name in ("f8_name_vectors", "x2_embedding_hook"):
        assert "hashpartitioning(id" in QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_zeros_are_no_rows(spark):
    from signalwatch.functions.stages import nonzero_weights

    df = spark.createDataFrame([("a", [0.0, -0.5, 0.25]), ("b", [0.0, 0.0]), ("c", None), ("d", [])], "id string, v array<float>")
    assert sorted(map(tuple, nonzero_weights(df).collect())) == [("a", 1, -0.5, 0.5), ("a", 2, 0.25, 0.5)]
    assert "Generate" not in QUERIES["x2_embedding_hook"](spark, SF)._jdf.queryExecution().executedPlan().toString()
