"""The release ledger: charged once, stored, refused beyond the budget."""

import pytest
from pyspark.sql import functions as F

from signalwatch.operators.releases import BudgetSpent, ReleaseLedger


def counts(spark, extra=0):
    return spark.range(50).select(F.col("id").cast("string").alias("k"), (F.col("id") * 3 + extra).cast("double").alias("n"))


def of(df):
    return {r["k"]: r["noisy"] for r in df.collect()}


def test_a_release_is_charged_once_and_read_again(spark, tmp_path):
    book = ReleaseLedger(spark, str(tmp_path), "project-1", 1.0)
    first = of(book.release(counts(spark), "week-1", ["k"], "n", 1.0, 0.6, 5))
    # the counts have changed since: what was released stays, and nothing is charged
    again = of(ReleaseLedger(spark, str(tmp_path), "project-1", 1.0).release(counts(spark, 100), "week-1", ["k"], "n", 1.0, 0.6, 99))
    assert first == again and len(first) == 50 and book.spent() == 0.6
    with pytest.raises(BudgetSpent):
        book.release(counts(spark), "week-2", ["k"], "n", 1.0, 0.5, 5)
    assert book.entries() == [("week-1", 0.6)] and not (tmp_path / "project-1" / "release=week-2").exists()
    book.release(counts(spark), "week-3", ["k"], "n", 1.0, 0.4, 6)
    assert book.entries() == [("week-1", 0.6), ("week-3", 0.4)] and abs(book.spent() - 1) < 1e-12
    other = ReleaseLedger(spark, str(tmp_path), "project-2", 1.0)
    assert other.spent() == 0 and of(other.release(counts(spark), "week-1", ["k"], "n", 1.0, 0.6, 7)) != first
    assert "n" not in spark.read.parquet(str(tmp_path / "project-1" / "release=week-1")).columns


def test_a_job_that_died_is_completed_without_a_second_charge(spark, tmp_path):
    book = ReleaseLedger(spark, str(tmp_path), "b", 1.0)
    book._charge("r", 0.9)
    got = of(book.release(counts(spark), "r", ["k"], "n", 1.0, 0.9, 5))
    assert book.entries() == [("r", 0.9)] and len(got) == 50
    (tmp_path / "b" / "release=r" / "_SUCCESS").unlink()  # a table that wasn't finished is written again, with the same noise
    assert of(book.release(counts(spark), "r", ["k"], "n", 1.0, 0.9, 5)) == got


def test_writers_at_once(spark, tmp_path):
    """Two that both find the budget free: one takes the entry, the other reads the ledger again and is refused."""
    book, rival = (ReleaseLedger(spark, str(tmp_path), "b", 1.0) for _ in range(2))
    create = book._create

    def late(name, text):
        if not rival.entries():
            rival._charge("rival", 0.7)
        return create(name, text)

    book._create = late
    with pytest.raises(BudgetSpent):
        book.release(counts(spark), "mine", ["k"], "n", 1.0, 0.7, 5)
    assert book.entries() == [("rival", 0.7)]
    book.release(counts(spark), "small", ["k"], "n", 1.0, 0.3, 5)
    assert book.entries() == [("rival", 0.7), ("small", 0.3)]


def test_what_is_refused(spark, tmp_path):
    book = ReleaseLedger(spark, str(tmp_path), "b", 1.0)
    for bad in ({"epsilon": 0.0}, {"epsilon": -1.0}, {"sensitivity": 0.0}, {"name": "a/b"}, {"epsilon": float("nan")}):
        with pytest.raises(ValueError):
            book.release(counts(spark), **({"name": "r", "keys": ["k"], "value": "n", "sensitivity": 1.0, "epsilon": 0.5, "seed": 1} | bad))
    assert book.entries() == []
    book.release(counts(spark).limit(0), "empty", ["k"], "n", 1.0, 0.5, 1)
    with pytest.raises(ValueError):
        book.release(counts(spark), "empty", ["k"], "n", 1.0, 0.4, 1)
    (tmp_path / "b" / "entry=2.json").touch()
    with pytest.raises(BudgetSpent):
        book.release(counts(spark), "next", ["k"], "n", 1.0, 0.1, 1)
    with pytest.raises(ValueError):
        ReleaseLedger(spark, str(tmp_path), "../b", 1.0)
