"""The annotation stream against its SQL where cues and surfaces stand in what is redacted."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

import __spark_entry__ as e

TEXTS = ["see https://example.org/s for more", "write to an@example.org or than@example.org", "ask @than an hour later", "https://example.org/an/than", "plain text of the day", "", None, "plandemic@example.org"]


def test_what_is_redacted_counts(spark, tmp_path):
    table = pa.table({"doc_id": pa.array(range(len(TEXTS)), pa.int64()), "text": pa.array(TEXTS, pa.string()), "lang": ["en"] * len(TEXTS), "source": ["s"] * len(TEXTS), "n_chars": pa.array([len(t or "") for t in TEXTS], pa.int64())})
    pq.write_table(table, tmp_path / "documents.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet')")
    want = c.execute(e.oracle_sql()["st1_annotation_stream"]).fetchall()
    got = e.queries()["st1_annotation_stream"](spark, str(tmp_path)).collect()
    key = lambda r: r[0]
    assert sorted((tuple(r) for r in got), key=key) == sorted((tuple(r) for r in want), key=key)
    assert {r[0]: r[1] for r in want}[0] == "sarcasm" and {r[0]: r[3] for r in want}[3] == 2
