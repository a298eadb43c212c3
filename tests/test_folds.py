"""Folds that carry state over batches, and recurrences cut into slices, against plain loops."""

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from signalwatch.operators import console, folds, ledger, signals


@pytest.fixture
def small_batches(spark):
    """Batches of a few rows, so that every key spans some."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "7")
    yield
    spark.conf.set(name, before)


def test_state_is_carried_over_batches(spark, small_batches):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None, "c"]), rng.choice([1, None]), i % 60, rng.choice([1, 2, None])) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, j int, at int, x int").repartition(5)
    out = folds.keyed_fold(df, ["k", "j"], ["at"], ["x"], "total bigint, odd boolean", 0, lambda s, at, x: (s + (x or 0), (s + (x or 0), at % 2 == 1) if x != 2 else None))
    want = []
    for key in {r[:2] for r in rows}:
        s = 0
        for _, _, at, x in sorted((r for r in rows if r[:2] == key), key=lambda r: (r[2], r[3] is not None, r[3] or 0)):
            s += x or 0
            if x != 2:
                want.append((*key, at, s, at % 2 == 1))
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(want, key=repr)
    assert out.columns == ["k", "j", "at", "total", "odd"]
    assert folds.keyed_fold(df.limit(0), ["k"], ["at"], ["x"], "total bigint", 0, lambda s, at, x: (s, (s,))).count() == 0


def test_chain_budget_and_breaker(spark, small_batches):
    rng = random.Random(2)
    text = {i: rng.choice([None, "", "é", "payload"]) for i in range(1, 301)}
    chain = {r["sequence"]: r for r in ledger.chained(spark.createDataFrame([("x", i, t) for i, t in text.items()] + [(None, 1, "p")], "chain string, sequence int, payload string")).where("chain = 'x'").collect()}
    before = ledger.GENESIS
    for i, t in sorted(text.items()):
        own = hashlib.sha256((before + (t or "")).encode()).hexdigest()
        assert (chain[i]["prev_hash"], chain[i]["payload_hash"]) == (before, own)
        before = own
    asked = [(k, i, rng.choice([0.3, 0.01, -1.0, 0.0, None, 0.25])) for k in ("a", "b") for i in range(200)]
    got = {(r["key"], r["seq"]): (r["epsilon"], r["accepted"], r["spent"]) for r in ledger.charged(spark.createDataFrame(asked, "key string, seq long, epsilon double"), 1.0).collect()}
    for key in ("a", "b"):
        spent = 0.0
        for _, i, e in sorted((r for r in asked if r[0] == key), key=lambda r: r[1]):
            ok = e is not None and e > 0 and spent + e <= 1 + 1e-12
            spent += e if ok else 0
            assert got[key, i] == (e, ok, spent)
    polls = [("s", i, rng.random() < 0.5) for i in range(400)]
    got = {r["seq"]: r for r in ledger.breaker(spark.createDataFrame(polls, "source string, seq long, success boolean")).collect()}
    h, f, o = 1.0, 0, False
    for _, i, ok in polls:
        h, f = 0.7 * h + (0.3 if ok else 0.0), 0 if ok else f + 1
        o = (o and h < 0.7) if ok else (o or h < 0.3)
        r = got[i]
        assert (r["failures"], r["is_open"]) == (f, o) and math.isclose(r["health"], h) and r["delay"] == (60.0 if not o and f == 0 else 60.0 * min(2.0 ** max(f - 1, 0), 16))
    assert any(r["is_open"] for r in got.values())


def test_cooled_without_a_pause(spark, small_batches):
    rng = random.Random(3)
    rows = [(k, s) for k in ("a", "b") for s in sorted({rng.randint(0, 3000) for _ in range(900)})]
    want = set()
    for key in ("a", "b"):
        last = None
        for _, s in sorted(r for r in rows if r[0] == key):
            if last is None or s - last > 90:
                want.add((key, s))
                last = s
    assert {tuple(r) for r in console.cooled(spark.createDataFrame(rows + rows[:5] + [("c", None)], "k string, sec int"), "k", "sec", 90).collect()} == want


@pytest.mark.parametrize("alpha", [0.3, 0.02, 0.97, 1.0])
def test_spikes_of_long_series(spark, alpha, monkeypatch):
    """One series of many slices and some short ones, null keys among them."""
    monkeypatch.setattr(folds, "FALL", 20)  # short slices
    rng = random.Random(4)
    series = {("hot", "1"): 3000, ("short", "1"): 3, (None, "1"): 200, ("short", None): 1}
    rows = [(k, d, day, rng.choice([0, 1, 2, 5, 9, 60])) for (k, d), size in series.items() for day in sorted(rng.sample(range(20_000), size))]
    got = {(r["keyword"], r["district"], r["day"]): r for r in signals.ewma_spikes(spark.createDataFrame(rows, "keyword string, district string, day int, n long"), alpha=alpha, least_z=1.0).collect()}
    assert len(got) == len(rows)
    for key in series:
        mean = var = 0.0
        for k, (_, _, day, n) in enumerate(r for r in rows if r[:2] == key):
            base = max(n, 1.0) if k == 0 else mean
            z = (n - base) / math.sqrt(max(1.0 if k == 0 else var, 1.0))
            r = got[(*key, day)]
            assert math.isclose(r["baseline"], base, rel_tol=1e-9, abs_tol=1e-9) and math.isclose(r["z"], z, rel_tol=1e-7, abs_tol=1e-7) and r["prior"] == min(k, 14)
            assert r["is_spike"] == (min(k, 14) >= 5 and z >= 1 and n >= max(base * 1.5, 3)) or math.isclose(z, 1, rel_tol=1e-6) or math.isclose(n, base * 1.5)
            mean, var = (n, max(n, 1.0)) if k == 0 else (alpha * n + (1 - alpha) * mean, alpha * (n - mean) ** 2 + (1 - alpha) * var)


def test_a_hot_series_is_many_tasks(spark):
    """Slices of one series, each a bounded number of rows."""
    df = spark.range(5000).select(F.lit("s").alias("k"), F.col("id").cast("int").alias("day"), F.lit(1.0).alias("x"))
    out = folds.decayed(df, ["k"], ["day"], F.floor(F.col("day") / 1000), 0.7, {"m": lambda place, _: F.col("x")})
    rows = out.orderBy("day").collect()
    assert len(rows) == 5000 and rows[0]["m_before"] is None and all(math.isclose(r["m"], 1 / 0.3, rel_tol=1e-9) for r in rows[100:]) and math.isclose(rows[1]["m"], 1.7)
    with pytest.raises(ValueError):
        folds.decayed(df, ["k"], ["day"], F.lit(0), 1.0, {"m": lambda place, _: F.col("x")})
