"""Values worked out by hand from the definitions."""

import datetime as dt
import hashlib
import re

import pytest
from pyspark.sql import functions as F

from signalwatch.functions import annotate as a
from signalwatch.functions import webtext as w
from signalwatch.functions.names import normalized_name
from signalwatch.functions.stages import author_digest
from signalwatch.operators import console as c
from signalwatch.operators import graph as g
from signalwatch.operators import ledger, resolve
from signalwatch.operators import signals as s
from signalwatch.operators.telemetry import telemetry
from signalwatch.sources import landed


def test_disproportionality(spark):
    rows = spark.createDataFrame([("x", "y", 10, 20, 100, 1000), ("u", "y", 2, 20, 100, 1000), ("z", "z", 0, 0, 0, 0)], "drug string, event string, a long, b long, c long, d long")
    out = {r["drug"]: r for r in s.disproportionality(rows).collect()}
    x = out["x"]
    assert [round(x[k], 6) for k in ("prr", "ror", "expected", "ic", "chi_squared")] == [3.769758, 5.099017, 2.920354, 1.618172, 16.870719] and round(x["ic_lower"], 5) == 0.74553
    assert x["is_signal"] and not out["u"]["is_signal"] and not out["z"]["is_signal"] and out["z"]["ic"] == 0


def test_contingency(spark):
    pairs = spark.createDataFrame([("coldrif", "aki", 10), ("coldrif", "fever", 5), ("paracetamol", "aki", 3), ("paracetamol", "fever", 50)], "drug string, event string, a long")
    r = s.contingency(pairs).where("drug = 'coldrif' and event = 'aki'").first()
    assert (r["a"], r["b"], r["c"], r["d"]) == (10, 5, 3, 50)


def test_spike(spark):
    rows = [("k", "d", i, 2) for i in range(7)] + [("k", "d", 7, 40)]
    out = s.ewma_spikes(spark.createDataFrame(rows, "keyword string, district string, day int, n long")).orderBy("day").collect()
    assert out[-1]["z"] == 38.0 and out[-1]["baseline"] == 2.0 and [r["is_spike"] for r in out] == [False] * 7 + [True]


def test_cluster(spark):
    now = dt.datetime(2024, 1, 10)
    rows = [(10.2, 76.3, now, 1.0)] * 8 + [(20.0, 70.0, now, 1.0), (30.0, 60.0, now, 1.0)] + [(10.2, 76.3, now - dt.timedelta(days=30), 1.0)] * 10
    obs = spark.createDataFrame(rows, "lat double, lon double, ts timestamp_ntz, weight double")
    top = s.poisson_clusters(obs, "2024-01-10 00:00:00", least_llr=2.0).orderBy(F.desc("llr")).first()
    assert (round(top["expected"], 6), round(top["llr"], 6), round(top["p_value"], 5)) == (3.333333, 2.337083, 0.03062) and top["is_cluster"] and (top["centroid_lat"], top["centroid_lon"]) == (10.5, 76.5)
    assert s.poisson_clusters(obs, "2024-01-10 00:00:00").where("is_cluster").count() == 0


def test_telemetry(spark):
    t = lambda m, sec=0: dt.datetime(2024, 1, 1, 0, m, sec)
    rows = [(1, t(0), "ALPHA", 10.0), (2, t(0, 30), "ALPHA", 20.0), (3, t(1), "ALPHA", 30.0), (4, t(1), "BETA", 40.0)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, symbol string, value double")
    out = {(r["bucket"] % 3600, r["symbol"]): r for r in telemetry(df, ["symbol"], 60, 2, least=15.0).collect()}
    assert {k: (r["n"], r["mean"], r["last_avg"], r["deviation"]) for k, r in out.items()} == {(0, "ALPHA"): (1, 20.0, 20.0, None), (60, "ALPHA"): (1, 30.0, 25.0, None), (60, "BETA"): (1, 40.0, 40.0, None)}
    assert telemetry(df.where("symbol = 'ALPHA'"), ["symbol"], 60, 2, start="2024-01-01 00:01:00", end="2024-01-01 00:02:00").count() == 1


PII = [
    ("aadhaar 1234 5678 9012", "aadhaar [AADHAAR]"), ("pan ABCDE1234F.", "pan [PAN]."), ("call +91-9876543210 now", "call +[MOBILE] now"), ("mail patient@example.com", "mail [EMAIL]"),
    ("see https://x.org/a?b=1 ok", "see [URL] ok"), ("by @drsharma", "by [USER]"), ("", ""), ("nothing here", "nothing here"), ("a@b.org @user 1234-5678-9012", "[EMAIL] [USER] [AADHAAR]"),
]


def test_redaction(spark):
    out = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(PII)], "i int, text string").withColumn("f", a.pii_findings(F.col("text"))).select("i", a.redacted(F.col("text"), F.col("f")).alias("r"), "f", "text").collect()
    for r in out:
        assert r["r"] == PII[r["i"]][1]
        for f in r["f"]:
            assert r["text"][f["start"] : f["stop"]].strip()


def test_languages(spark):
    rows = [("मुझे बुखार है hello there", ["hi", "en"]), ("plain words", ["en"]), ("   ", []), ("காய்ச்சல்", ["ta"]), (" 12 !! ", ["en"])]
    out = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], "i int, text string").withColumn("s", a.language_segments(F.col("text"))).select("i", "text", "s", a.dominant_language(F.col("s")).alias("top"), a.needs_translation(F.col("s")).alias("needs")).collect()
    for r in out:
        assert [x["language"] for x in r["s"]] == rows[r["i"]][1]
        for x in r["s"]:
            assert r["text"][x["start"] : x["stop"]] == r["text"][x["start"] : x["stop"]].strip() != ""
    assert {r["i"]: r["top"] for r in out} == {0: "hi", 1: "en", 2: "en", 3: "ta", 4: "en"} and out[0]["needs"] and not out[1]["needs"]


def test_sentiment_and_misinformation(spark):
    rows = [("good pain fever",), ("  ",), ("neutral",), ("this vaccine causes autism",), ("totally not true",), ("#boycottnow",)]
    out = spark.createDataFrame(rows, "text string").select("text", a.sentiment(F.col("text")).alias("s"), a.misinformation(F.col("text")).alias("m")).collect()
    assert round(out[0]["s"]["polarity"], 4) == -0.3333 and out[0]["s"]["confidence"] == 0.5
    assert out[1]["s"] is None and out[1]["m"] is None and out[2]["s"]["confidence"] == 0.2
    assert [r["m"]["label"] for r in out[2:]] == ["clean", "likely_misinformation", "sarcasm", "coordinated_inauthentic"]


def test_authors(spark):
    out = [r[0] for r in spark.createDataFrame([("@alice",), ("@ALICE",), (None,), (" ",)], "h string").select(a.author_hash(F.col("h"), "s")).collect()]
    assert out[0] == out[1] and re.fullmatch("[0-9a-f]{16}", out[0]) and out[2] == out[3] == "anonymous"


def test_author_digests(spark):
    rows = ["@alice", " @ALICE ", None, "", "anonymous", "Zoé"]
    out = [r[0] for r in spark.createDataFrame([(i, h) for i, h in enumerate(rows)], "i int, h string").orderBy("i").select(author_digest("s")(F.col("h"))).collect()]
    assert out == [hashlib.blake2b(f"s::{h}".encode(), digest_size=8).hexdigest() for h in ("@alice", "@alice", "anonymous", "anonymous", "anonymous", "zoé")]


def test_bot_walls(spark):
    out = spark.createDataFrame([(429, ""), (200, "Checking your browser"), (403, ""), (200, "fine")], "s int, t string").select(w.bot_wall(F.col("s"), F.col("t"))["tier"]).collect()
    assert [r[0] for r in out] == ["soft_rate_limit", "interactive_challenge", "hard_block", "none"]


def test_resolution(spark):
    new = spark.createDataFrame([("n1", "ORG", "Corp X"), ("n2", "ORG", "Harbor Forum")], "id string, entity_type string, name string")
    stored = spark.createDataFrame([("s1", "ORG", "Corporation X")], "id string, entity_type string, name string")
    out = {r["id"]: r for r in resolve.matches(new, stored).collect()}
    assert out["n1"]["action"] == "merge" and out["n1"]["match_id"] == "s1" and out["n2"]["action"] == "create"
    merged = spark.createDataFrame([("s1", 0.76, 3, 1), ("s1", 0.91, 2, 5)], "id string, confidence double, source_count long, updated long")
    assert tuple(resolve.folded(merged, "id").first()) == ("s1", 0.91, 5, 5)
    assert spark.range(1).select(normalized_name(F.lit("Café  Intl. Ltd"))).first()[0] == "cafe international limited"


def test_graph(spark):
    edges = spark.createDataFrame([("a", "b", "2020", "x"), ("a", "b", "2021", "x"), ("b", "c", "2020", "y"), ("c", "d", "2020", "y"), ("d", "e", "2020", "y")], "src string, dst string, valid_from string, evidence string")
    uids = edges.select(g.edge_uid(*(F.col(k) for k in edges.columns)).alias("u")).distinct().count()
    assert uids == 5
    assert {(r["id"], r["hop"]) for r in g.within_hops(edges, spark.createDataFrame([("a",)], "id string")).collect()} == {("a", 0), ("b", 1), ("c", 2), ("d", 3)}
    events = spark.createDataFrame([("e1", "EVENT", 0.91), ("e2", "EVENT", 0.85), ("o", "ORG", 0.99)], "id string, entity_type string, confidence double")
    assert [r["id"] for r in g.confident_events(events).collect()] == ["e1"]


def test_privacy(spark):
    asked = spark.createDataFrame([("k", 1, 0.5), ("k", 2, 0.6), ("k", 3, 0.5)], "key string, seq long, epsilon double")
    assert [(r["seq"], r["accepted"]) for r in ledger.charged(asked, 1.0).orderBy("seq").collect()] == [(1, True), (2, False), (3, True)]
    noisy = ledger.noisy(spark.range(4000).select("id", F.lit(100.0).alias("n")), ["id"], "n", 1.0, 0.5, 3).agg(F.avg("noisy"), F.stddev("noisy")).first()
    assert abs(noisy[0] - 100) < 0.3 and abs(noisy[1] - 2 * 2**0.5) < 0.4


def test_anchor(spark):
    def fnv(text):
        h = 2166136261
        for ch in text:
            h = ((h ^ ord(ch)) * 16777619) & 0xFFFFFFFF
        return h

    import math

    for r in spark.createDataFrame([("GEO-1",), ("ORG-77",), ("x",)], "id string").select("id", c.anchor_offset(F.col("id"), F.lit(10.0), F.lit(20.0)).alias("p")).collect():
        h = fnv(r["id"])
        angle, far = math.radians(h % 360), 2.4 + (h % 7) * 0.45
        assert r["p"]["lat"] == pytest.approx(10 + math.sin(angle) * far) and r["p"]["lon"] == pytest.approx(20 + math.cos(angle) * far)


def test_posts(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"_meta": {}, "tweets": [{"id": "1", "text": "Coldrif syrup", "author": "a", "created_at": "x", "lang": "en"}, {"id": "2", "text": "else", "author": "b", "created_at": "x", "lang": "en"}]}')
    (tmp_path / "b.json").write_text('[{"id": "3", "text": "coldrif", "author": null, "created_at": "x", "lang": "hi"}]')
    (tmp_path / "c.json").write_text("{broken")
    posts = landed.replay_posts(spark, str(tmp_path))
    assert {(r["id"], r["origin"]) for r in posts.where(a.has_keyword(F.col("text"), ["coldrif"])).collect()} == {("1", "a.json"), ("3", "b.json")}
    assert {r["source_id"] for r in landed.health_mentions(posts, "posts", "p", "s").collect()} == {"1", "2", "3"}


def test_segments_are_found_once_for_the_language(spark):
    """Segments given as an expression are bound before languages are compared, not found again for each."""
    df = spark.createDataFrame([("the fever बुखार है बहुत",)], "text string").select(a.dominant_language(a.language_segments(F.col("text"))).alias("top"))
    assert df.first()["top"] == "hi" and df._jdf.queryExecution().analyzed().toString().count("regexp_extract_all") == 1


def test_surfaces_listed_twice_need_no_window_over_matches(spark):
    from signalwatch.operators.dictionary import dictionary_entities

    texts = spark.createDataFrame([(1, "Foo and foo")], "mention_id long, text string")
    words = spark.createDataFrame([("K", "FOO", None, 2), ("K", "foo", None, 1), ("K", "foo", "c", 3)], "kind string, surface string, code string, ord long")
    found = dictionary_entities(texts, words)
    assert sorted((r["code"] or "", r["start"]) for r in found.collect()) == [("", 0), ("", 8), ("c", 0), ("c", 8)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("Window")
