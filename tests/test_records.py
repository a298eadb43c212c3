"""The source that counts records: bounded batches, restart from offsets, logs that grow."""

import pytest

from signalwatch.sources.records import record_stream


def drained(spark, path, checkpoint, per_batch):
    """Reads all there is; the records of each batch."""
    batches = []
    query = record_stream(spark, str(path), per_batch).writeStream.option("checkpointLocation", str(checkpoint)).foreachBatch(lambda b, k: batches.append((k, [tuple(r) for r in b.collect()]))).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return [(k, rows) for k, rows in batches if rows]


def test_bounded_batches_and_restart(spark, tmp_path):
    logs, checkpoint = tmp_path / "logs", tmp_path / "checkpoint"
    logs.mkdir()
    lines = {"a": [f"a{i}" for i in range(30)], "b": [f"b-{i}é" for i in range(7)], "c": [""]}
    for name, of in lines.items():
        (logs / name).write_text("".join(f"{x}\n" for x in of))
    (logs / "_hidden").write_text("no\n")
    (logs / "a").open("a").write("half a rec")
    first = drained(spark, logs, checkpoint, 12)
    assert all(len(rows) <= 12 for _, rows in first) and len(first[0][1]) >= 8 and {r[0] for r in first[0][1]} == {"a", "b", "c"}
    assert sorted(r[::2] for _, rows in first for r in rows) == sorted((n, x) for n, of in lines.items() for x in of)
    with (logs / "a").open("a") as out:
        out.write("ord\nlast\n")
    (logs / "d").write_bytes(b"bad \xff byte\r\n")
    second = drained(spark, logs, checkpoint, 12)
    assert sorted(r[::2] for _, rows in second for r in rows) == [("a", "half a record"), ("a", "last"), ("d", "bad � byte")]
    assert min(k for k, _ in second) > max(k for k, _ in first)
    assert drained(spark, logs, checkpoint, 12) == []
    at = {(r[0], r[1]) for _, rows in first + second for r in rows}
    assert len(at) == 41  # each record has a place of its own


def test_a_failed_batch_is_read_again_as_it_was(spark, tmp_path):
    logs, checkpoint, seen = tmp_path / "logs", tmp_path / "checkpoint", []
    logs.mkdir()
    (logs / "a").write_text("".join(f"{i}\n" for i in range(10)))

    def each(batch, k):
        seen.append((k, [r["value"] for r in batch.collect()]))
        if k == 1:
            raise RuntimeError("lost")

    query = record_stream(spark, str(logs), 4).writeStream.option("checkpointLocation", str(checkpoint)).foreachBatch(each).start()
    with pytest.raises(Exception):
        query.processAllAvailable()
    query.stop()
    (logs / "a").open("a").write("10\n")
    again = drained(spark, logs, checkpoint, 4)
    assert again[0] == (1, [r for r in again[0][1]]) and [r[2] for r in again[0][1]] == seen[1][1] == ["4", "5", "6", "7"]
    assert [r[2] for _, rows in again[1:] for r in rows] == ["8", "9", "10"]


def test_no_logs_and_a_cut_log(spark, tmp_path):
    assert drained(spark, tmp_path / "none", tmp_path / "c1", 5) == []
    logs = tmp_path / "logs"
    logs.mkdir()
    (logs / "a").write_text("one\ntwo\n")
    assert [r[2] for _, rows in drained(spark, f"file:{logs}", tmp_path / "c2", 5) for r in rows] == ["one", "two"]
    (logs / "a").write_text("x\n")
    with pytest.raises(Exception, match="shorter"):
        drained(spark, f"file:{logs}", tmp_path / "c2", 5)
    with pytest.raises(ValueError, match="at least"):
        record_stream(spark, str(logs), 0)
