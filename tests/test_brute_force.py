"""Operators that SQL can't express, or not in full, against plain Python on small tables."""

import datetime as dt
import json
import random

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from signalwatch.functions import annotate as a
from signalwatch.functions import webtext as w
from signalwatch.functions.names import grams, hashed_vector, normalized_name
from signalwatch.functions.stages import STAGES, applied, embedding, hashed_name_model, stage
from signalwatch.operators import console, ledger, resolve, telemetry
from signalwatch.operators import signals as s
from signalwatch.operators.vectors import nearest
from signalwatch.sources import landed
from signalwatch.streaming import jobs

SF = "/root/testdata/sf0.001"
PATTERNS = [
    ("aadhaar", r"\b\d{4}[-\s]?\d{4}[-\s]?\d{4}\b"), ("pan", r"\b[A-Z]{5}\d{4}[A-Z]\b"), ("mobile", r"\b(?:\+?91[-\s]?|0)?[6-9]\d{9}\b"), ("email", r"\b[\w.+-]+@[\w-]+\.[\w.-]+\b"),
    ("url_handle", r"(?i:https?)://[^\s)<>]+", ), ("username", r"(?<![A-Za-z0-9_])@[A-Za-z0-9_]{2,32}\b"),
]
ODD = ["", "a@b.org @user 1234-5678-9012 ABCDE1234F +919876543210", "x" * 4000 + " me@x.org", "नमस्ते 1234 5678 9012 me@x.org", "1234 5678 9012 3456", "@a @ab @abc@def.gh", "https://u:p@x.org/@y (http://a.b)", "09876543210 9876543210a"]


def texts(spark, limit=None):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("text").unionByName(spark.read.parquet(f"{SF}/conversations.parquet").select("text"))
    return [r[0] for r in rows.collect()][:limit] + ODD


def test_redaction(spark):
    all_of = texts(spark)
    out = spark.createDataFrame(list(enumerate(all_of)), "i int, text string").withColumn("f", a.pii_findings(F.col("text"))).select("i", "f", a.redacted(F.col("text"), F.col("f")).alias("r")).collect()
    tokens = {k: t for k, _, t in a.PII}
    assert len(out) == len(all_of)
    for r in out:
        text = all_of[r["i"]]
        # the engine's \s is ASCII here, as in the patterns of the columns
        every = sorted((m.start(), m.start() - m.end(), o, m.end(), k) for o, (k, p) in enumerate(PATTERNS) for m in regex.finditer(p.replace(r"\s", r"[ \t\n\x0B\f\r]").replace(r"[^[ \t\n\x0B\f\r])<>]", r"[^ \t\n\x0B\f\r)<>]").replace(r"[-[ \t\n\x0B\f\r]]", r"[- \t\n\x0B\f\r]"), text))
        kept, end = [], -1
        for start, _, _, stop, kind in every:
            if start >= end:
                kept.append((start, stop, kind))
                end = stop
        assert [(f["start"], f["stop"], f["kind"]) for f in r["f"]] == kept, text[:200]
        clean, at = "", 0
        for start, stop, kind in kept:
            clean, at = clean + text[at:start] + tokens[kind], stop
        assert r["r"] == clean + text[at:]


def test_sentiment_scores(spark):
    all_of = texts(spark) + ["Good, bad: fever! goodness", "i  think we. my,", "अच्छा दर्द good", "i believe", "danger dangerous endanger"]

    def hits(low, cues):
        return sum(len(regex.findall(rf"(?<![\p{{L}}\p{{N}}_]){regex.escape(c)}(?![\p{{L}}\p{{N}}_])", low)) if c.isascii() else low.count(c) for c in cues)

    for r in spark.createDataFrame(list(enumerate(all_of)), "i int, text string").select("i", a.sentiment(F.col("text")).alias("s")).collect():
        low = all_of[r["i"]].lower()
        if not low.strip(" "):
            assert r["s"] is None
            continue
        p, n, u = (hits(low, c) for c in (a.POSITIVE, a.NEGATIVE, a.SUBJECTIVE))
        want = (0.0, 0.0, 0.2) if p + n + u == 0 else ((p - n) / max(p + n, 1), u / max(p + n + u, 1), max(0.3, min(0.9, (p + n + u) / 6)))
        assert tuple(r["s"]) == pytest.approx(want), low[:200]


def test_language_segments(spark):
    r = random.Random(2)
    words = ["plain", "बुखार", "காய்ச்சல்", "mixedबुखार", "ఆ", "12!", "ಸಾವು", "ok"]
    all_of = ["".join(r.choice(words) + r.choice([" ", "  ", "\n", "\t "]) for _ in range(r.randint(0, 40))) for _ in range(150)] + ["", "  ", " lead", "बु"]

    def script(token):
        counts = [(len(regex.findall(rf"\p{{Script={n}}}", token)), -i, n) for i, (n, _, _) in enumerate(a.SCRIPTS)]
        return max(counts)[2] if max(counts)[0] else "Latin"

    names = {n: (lang, tag) for n, lang, tag in a.SCRIPTS}
    for row in spark.createDataFrame(list(enumerate(all_of)), "i int, text string").select("i", a.language_segments(F.col("text")).alias("s")).collect():
        want = []
        for m in regex.finditer(r"\S+", all_of[row["i"]]):
            own = names[script(m[0])]
            if want and want[-1][2:] == own:
                want[-1] = (want[-1][0], m.end(), *own)
            else:
                want.append((m.start(), m.end(), *own))
        assert [tuple(x) for x in row["s"]] == want, all_of[row["i"]]


def named(spark, names, prefix):
    return spark.createDataFrame([(f"{prefix}{i}", "ORG", n) for i, n in enumerate(names)], "id string, entity_type string, name string")


def vectors(spark, names):
    rows = spark.createDataFrame(list(enumerate(names)), "i int, name string").select("i", normalized_name(F.col("name")).alias("norm")).select("i", "norm", hashed_vector(grams(F.col("norm"))).alias("v")).collect()
    out = np.zeros((len(names), 192))
    norms = [""] * len(names)
    for r in rows:
        norms[r["i"]] = r["norm"]
        for x in r["v"]:
            out[r["i"], x["b"]] = x["w"]
    return norms, out


def levenshtein(x, y):
    row = list(range(len(y) + 1))
    for i, c in enumerate(x):
        new = [i + 1]
        for j, d in enumerate(y):
            new.append(min(new[-1] + 1, row[j + 1] + 1, row[j] + (c != d)))
        row = new
    return row[-1]


def distance(x, y):
    return 0.0 if x == y else 1.0 if not x or not y else levenshtein(x, y) / max(len(x), len(y))


def company_names(r, n):
    parts = ["united", "general", "data", "steel", "north", "star", "global", "bank", "energy", "health", "media", "harbor", "valley", "motor", "union", "first", "royal", "delta"]
    ends = ["Inc", "Ltd", "Corp.", "Co", "Group", ""]
    return [" ".join([*(r.choice(parts).title() for _ in range(r.randint(1, 3))), r.choice(ends)]).strip() for _ in range(n)]


def varied(r, name):
    k = r.randrange(len(name))
    return r.choice([name.upper(), name[:k] + name[k + 1 :], name + " Ltd", name.replace("Corp.", "Corporation"), name])


@pytest.mark.parametrize("common", [5, 100])
def test_entity_matches(spark, common):
    """All merges that comparing every pair finds, and no others; common: how soon a gram is left to the second way."""
    r = random.Random(11)
    stored = company_names(r, 250) + ["", "Bank", "ABC"]
    new = [varied(r, n) for n in stored[:200] if n] + ["", "Zyx Qwv", "bank"]
    (norm_a, va), (norm_b, vb) = vectors(spark, new), vectors(spark, stored)
    far = np.array([[distance(x, y) for y in norm_b] for x in norm_a])
    near = np.clip(1 - va @ vb.T, 0, 2)
    allowed = (near <= 0.08) | ((far <= 0.42) & (near <= 0.2))
    got = {x["id"]: x for x in resolve.matches(named(spark, new, "n"), named(spark, stored, "s"), common=common).collect()}
    assert len(got) == len(new)
    right = total = 0
    for i in range(len(new)):
        best = min(range(len(stored)), key=lambda j: (round(near[i, j] + 0.15 * far[i, j], 9), f"s{j}"))
        if norm_a[i] and allowed[i, best]:
            total += 1
            right += got[f"n{i}"]["action"] == "merge" and norm_b[int(got[f"n{i}"]["match_id"][1:])] == norm_b[best]
        if not norm_a[i]:
            assert got[f"n{i}"]["action"] == "create"
    assert total > 100 and right >= 0.99 * total


def gram_counts(name):
    padded, out = f" {name} ", {}
    for n in (3, 4, 5):
        for i in range(len(padded) - n + 1 if name else 0):
            out[padded[i : i + n]] = out.get(padded[i : i + n], 0) + 1
    return out


def gram_cosine(x, y):
    dot = sum(n * y.get(g, 0) for g, n in x.items())
    return dot / (sum(n * n for n in x.values()) * sum(n * n for n in y.values())) ** 0.5 if x and y else 0.0


@pytest.mark.parametrize("common", [2, 20, 1000])
def test_candidates_lose_no_pair(spark, common):
    """Every pair whose gram counts reach the bound is a candidate, whichever grams count as common."""
    r = random.Random(17)
    names = list(dict.fromkeys(n.lower() for n in company_names(r, 90) + ["bank", "bank bank", "abc", "group group group"]))
    names += [n for n in (varied(r, x).lower() for x in names) if n and n not in names]
    df = spark.createDataFrame([("ORG", n) for n in names], "entity_type string, norm string").distinct()
    got = {(x["na"], x["nb"]) for x in resolve.candidates(df, df, 0.8, common).collect()}
    counts = {n: gram_counts(n) for n in names}
    want = {(x, y) for x in names for y in names if gram_cosine(counts[x], counts[y]) >= 0.8}
    assert want <= got and len(want) > len(names)


def test_merged_new(spark):
    r = random.Random(13)
    names = company_names(r, 60)
    names += [varied(r, n) for n in names]
    norm, v = vectors(spark, names)
    near = np.clip(1 - v @ v.T, 0, 2)
    counts = [gram_counts(n) for n in norm]
    label = {i: f"n{i}" for i in range(len(names))}
    while True:
        before = dict(label)
        for i in range(len(names)):
            for j in range(len(names)):
                # of names whose hashed vectors are near, those whose gram counts are: places shared by unlike grams make no links
                if norm[i] == norm[j] or (gram_cosine(counts[i], counts[j]) >= 0.8 and (near[i, j] <= 0.08 or (near[i, j] <= 0.2 and distance(norm[i], norm[j]) <= 0.42))):
                    label[i] = label[j] = min(label[i], label[j])
        if label == before:
            break
    got = {x["id"]: x["merged_id"] for x in resolve.merged_new(named(spark, names, "n")).collect()}
    assert got == {f"n{i}": label[i] for i in range(len(names))}


def test_density_limited(spark):
    r = random.Random(4)
    words = ["alpha", "beta", "and", "the", "with", "gamma", "delta9", "cookie", "subscribe"]
    blocks = lambda: "\n\n".join(" ".join(r.choice(words) for _ in range(r.randint(2, 40))) for _ in range(r.randint(1, 9)))
    all_of = [blocks() for _ in range(60)] + ["", "cookie consent", "<b>tags</b> " * 30, "a" * 1000]

    def density(t):
        tokens = regex.findall(r"[a-z0-9][a-z0-9_'-]{2,}", t.lower())
        if not tokens:
            return 0.0
        real = [x for x in tokens if x not in w.PLAIN_WORDS]
        marks = sum(len(regex.findall(p, t)) for p in (r"\n#", r"\n- ", r"\|"))
        return min(1.0, 0.6 * len(real) / len(tokens) + 0.3 * min(len(set(real)) / 160, 1) + 0.1 * min(marks / 24, 1))

    def limited(t, threshold, least, most):
        for p, by in ((r"(?s)<!--.*?-->", ""), (r"<[^>]+>", ""), (r"[ \t]+\n", "\n"), (r"\n{3,}", "\n\n"), (r"^\s+|\s+$", "")):
            t = regex.sub(p, by, t)
        out = ""
        for b in (x.strip() for x in regex.split(r"\n{2,}", t)):
            if not b or (len(regex.findall(w.TOKEN, b)) < 8 and regex.search(w.BOILERPLATE, b)):
                continue
            more = b if not out else f"{out}\n\n{b}"
            if len(more) > most:
                break
            out = more
            if len(more) >= least and density(more) >= threshold:
                break
        return out.strip() if out else t[:most].strip()

    got = spark.createDataFrame(list(enumerate(all_of)), "i int, text string").select("i", w.density_limited(F.col("text"), 0.62, 100, 600).alias("t")).collect()
    for x in got:
        assert x["t"] == limited(all_of[x["i"]], 0.62, 100, 600)


def test_name_kinds(spark):
    rows = {
        "Ebola": "EVENT", "Acme Holdings": "ORG", "Market Crisis": "EVENT", "JumpWire": "ORG", "Moz.com": "ORG", "Red Sea": "GEO", "John Smith": "PERSON", "Tuesday": None, "Xy": None, "Plainword": None, "A B C D E": None,
        "Reuters": None, "Vendor": None, "Cloud Vendor": "ORG",
    }
    got = {r["v"]: r["k"] for r in spark.createDataFrame([(k,) for k in rows], "v string").select("v", w.name_kind(F.col("v")).alias("k")).collect()}
    assert got == rows
    found = w.heuristic_entities(spark.createDataFrame([(1, "Ask HN: Acme Corp's plan by Zoé in Sri Lanka, CVE-2024-12345; a.b@c.org")], "id int, text string"))
    assert {(r["kind"], r["value"]) for r in found.collect()} >= {("GEO", "Sri Lanka"), ("CVE", "CVE-2024-12345"), ("EMAIL", "a.b@c.org")}
    asked = w.query_entities(spark.createDataFrame([(1, "covid-19 on a tanker near sri lanka, port of hamburg")], "id int, text string"))
    assert {(r["kind"], r["value"]) for r in asked.collect()} >= {("EVENT", "Covid-19"), ("GEO", "Maritime vessel"), ("GEO", "Sri Lanka")} and {r["weight"] for r in asked.collect()} == {3}
    only = w.heuristic_entities(spark.createDataFrame([(1, "John Smith a@b.org")], "id int, text string"), ["EMAIL"])
    assert [r["kind"] for r in only.collect()] == ["EMAIL"]


def event_table(spark, n=400):
    r = random.Random(7)
    start = dt.datetime(2024, 1, 1)
    rows = [(i, r.choice("aab") if i % 9 else None, start + dt.timedelta(seconds=r.randrange(40_000)), float(r.randrange(50)), r.random() < 0.8) for i in range(n)]
    return spark.createDataFrame(rows, "event_id long, source string, ts timestamp_ntz, value double, ok boolean")


def test_counted_entities(spark):
    """Against the list of mentions and against plain patterns, keys and surfaces included; and texts with nothing, nulls and edges that only ASCII knows."""
    odd = [None, "", "Acme Corp, ACME CORP and acme corp; Harbor Bank's Harbor Bank", "xSri Lanka Sri Lanka_ éSri Lanka Sri Lankan Oman\nUAE. One Two Three Four South Korea", "usd 5 EUR7 $ 9 xusd 3 cve-2024-12345 CVE-2024-12345", "United States United Kingdom United", "é" * 50 + "Ab’c Paris Hilton Of the World", "a" * 32 + " " + "A" * 65]
    df = spark.createDataFrame([(i, "pq"[i % 2], t) for i, t in enumerate(odd + texts(spark, 120))], "mention_id int, project string, text string")
    for keys in ([], ["project"]):
        got, want = w.counted_entities(df, keys), w.entity_counts(w.heuristic_entities(df), keys)
        assert sorted(got.columns) == sorted(want.columns)
        assert sorted(got.select(*want.columns).collect()) == sorted(want.collect())
    lands = sorted(r["value"] for r in w.heuristic_entities(df.select("mention_id", "text"), ["GEO"]).where(F.col("value").isin(w.COUNTRIES)).collect())
    plain = rf"(?a)\b(?:{'|'.join(w.COUNTRIES)})\b"
    assert lands == sorted(v for r in df.where("text is not null").collect() for v in regex.findall(plain, r["text"])) and "Sri Lanka" in lands
    assert w.counted_entities(df.where("false"), []).count() == 0


def test_sliced_windows(spark):
    """Cut into runs of a few rows, windows give what one window over the whole series gives; null keys are a series too."""
    df = event_table(spark)
    for keys in (["source"], []):
        whole = df.withColumn("m", F.avg("value").over(Window.partitionBy(*keys).orderBy("ts", "event_id").rowsBetween(-6, 0)))
        got = telemetry.rolling_mean(df, keys, 7, rows=11)
        assert sorted(got.columns) == sorted([*df.columns, "moving_avg"])
        assert {r["event_id"]: round(r["moving_avg"], 9) for r in got.collect()} == {r["event_id"]: round(r["m"], 9) for r in whole.collect()}
    one, many = (sorted((r["event_id"], r["k"], r["velocity"], r["anomaly"]) for r in console.velocity(df, "source", rows).collect()) for rows in (100_000, 1))
    assert [x[0] for x in one] == [x[0] for x in many] and one == many
    assert telemetry.rolling_mean(df.limit(0), ["source"], 7).count() == 0


def test_rate_spikes(spark):
    df = event_table(spark).where("source is not null")
    rows = sorted((r["source"], int((r["ts"] - dt.datetime(1970, 1, 1)).total_seconds())) for r in df.collect())
    want, last = set(), {}
    for source, sec in sorted(set(rows)):
        if sum(1 for x, t in rows if x == source and sec - 600 < t <= sec) >= 5 and sec - last.get(source, -(10**9)) > 900:
            want.add((source, sec))
            last[source] = sec
    assert {(r["source"], r["sec"]) for r in console.rate_spikes(df, "source", 600, 5, 900).collect()} == want and want


def test_located(spark):
    r = random.Random(3)
    names = ["".join(r.choice("ab c") for _ in range(r.randint(0, 7))) for _ in range(80)]
    gaz = [("".join(r.choice("abc ") for _ in range(r.randint(1, 4))), float(i), -float(i), i) for i in range(12)]
    got = {(x["low"], x["lat"]) for x in console.located(spark.createDataFrame([(n,) for n in names], "low string"), spark.createDataFrame(gaz, "name string, lat double, lon double, ord int"), "low").collect()}
    want = set()
    for n in names:
        fit = [((n != g, o), lat) for g, lat, _, o in gaz if n and (n == g or g in n or n in g)]
        if fit:
            want.add((n, min(fit)[1]))
    assert got == want


def test_noise(spark):
    counts = spark.createDataFrame([("p", i, 100.0) for i in range(3000)], "project string, k int, n double")
    one, two = ({r["k"]: r["noisy"] for r in ledger.noisy(counts.repartition(p), ["project", "k"], "n", 1.0, 0.5, 3).collect()} for p in (1, 7))
    assert one == two
    x = np.array(list(one.values())) - 100
    assert abs(x.mean()) < 0.3 and abs(x.std() - 2 * 2**0.5) < 0.4
    with pytest.raises(ValueError):
        ledger.noisy(counts, ["k"], "n", 1.0, 0.0, 3)
    asked = spark.createDataFrame([("k", 1, -5.0), ("k", 2, 0.0), ("k", 3, 1.0)], "key string, seq long, epsilon double")
    assert [(r["accepted"], r["spent"]) for r in ledger.charged(asked, 1.0).orderBy("seq").collect()] == [(False, 0.0), (False, 0.0), (True, 1.0)]


def test_nearest(spark, monkeypatch):
    import signalwatch.operators.vectors as v

    monkeypatch.setattr(v, "PIECE", 30)
    g = np.random.default_rng(1)
    x = g.normal(size=(150, 8))
    rows = spark.createDataFrame([(i, e.tolist()) for i, e in enumerate(x)] + [(900, None), (901, [0.0] * 8), (902, [1.0])], "vec_id long, embedding array<double>")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = nearest(rows.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "question"), rows, 4).collect()
    for q in range(0, 150, 20):
        want = np.lexsort((np.arange(150), -np.round(unit @ unit[q], 9)))[:4].tolist()
        assert sorted(r["vec_id"] for r in out if r["question"] == q) == sorted(want)


def test_reports_and_shapes(spark):
    rows = spark.createDataFrame([(0, 2, 1.5, 1.0, 2.0, None)], "bucket long, n long, mean double, low double, high double, last_avg double")
    assert rows.select(landed.bucket_report(rows)).first()[0] == " | 1970-01-01 00:00:00 | 2 | 1.5 | 1 | 2 | - | "
    obs = spark.createDataFrame([(10.2, 76.3, dt.datetime(2024, 1, 10), 1.0)] * 8 + [(20.0, 70.0, dt.datetime(2024, 1, 10), 1.0)], "lat double, lon double, ts timestamp_ntz, weight double")
    f = [json.loads(r[0]) for r in console.geojson(s.poisson_clusters(obs, "2024-01-10 00:00:00", least_llr=0.5).where("is_cluster")).collect()]
    assert [x["geometry"] for x in f] == [{"type": "Point", "coordinates": [76.5, 10.5]}] and f[0]["properties"]["observed"] == 8


def test_models_plug_in(spark):
    """A model takes a stage's place under its name, and the embedding hook runs one a task."""
    before = STAGES["translate"]
    try:
        stage("translate")(lambda df: df.withColumn("translated", F.upper("text")))
        out = applied(spark.createDataFrame([(1, "मुझे a@b.org")], "mention_id int, text string"), ["redact", "language", "translate", "sentiment"]).first()
        assert out["translated"] == out["text"].upper() and "[EMAIL]" in out["translated"]
    finally:
        STAGES["translate"] = before
    v = [np.array(r[0]) for r in spark.createDataFrame([("acme corp",), ("acme corp",), ("other",), (None,)], "t string").select(embedding(hashed_name_model)(F.col("t"))).collect()]
    assert np.allclose(v[0], v[1]) and abs(v[0] @ v[0] - 1) < 1e-5 and v[0] @ v[2] < 0.5 and not v[3].any()


def test_spike_stream_keeps_late_rows(spark, tmp_path):
    """Rows of a closed day go to the late table, a day is closed once, and what is open at the end is flushed once."""
    day = lambda d, h=1: dt.datetime(2024, 1, d, h)
    batches = [[("k", "d", day(1)), ("k", "d", day(1, 2)), ("k", "d", day(4))], [("k", "d", day(1, 5)), ("k", "d", day(5)), ("j", "d", day(4))], [("k", "d", day(9))]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, "keyword string, district string, ts timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    tables = jobs.SpikeTables(str(tmp_path / "out"))
    for _ in range(2):  # a restart finds nothing new
        jobs.spike_stream(jobs.read_stream(spark, str(tmp_path / "in"), "keyword string, district string, ts timestamp", 1), tables, str(tmp_path / "checkpoint")).start().awaitTermination()
    assert [(r["keyword"], r["ts"].day) for r in jobs.stored(spark, tables.late, "keyword string, district string, day int, ts timestamp").collect()] == [("k", 1)]
    jobs.flush(spark, tables)
    jobs.flush(spark, tables)
    got = sorted((r["keyword"], r["day"] - 19722, r["n"], r["prior"]) for r in jobs.stored(spark, tables.spikes, jobs.SPIKES).collect())
    assert got == [("j", 4, 1, 0), ("k", 1, 2, 0), ("k", 4, 1, 1), ("k", 5, 1, 2), ("k", 9, 1, 3)]


def test_graph_stream_inserts_edges_once(spark, tmp_path):
    entity = "struct<id:string,entity_type:string,name:string,confidence:double,updated:bigint>"
    edge = "struct<src:string,dst:string,valid_from:string,evidence:string>"
    schema = f"entities array<{entity}>, edges array<{edge}>"
    first = ([("a", "EVENT", "old", 0.9, 1), ("a", "EVENT", "new", 0.8, 2)], [("a", "b", "2020", "x"), ("a", "b", "2020", "x")])
    second = ([("a", "EVENT", "newest", 0.95, 3)], [("a", "b", "2020", "x"), ("a", "c", "2020", "y")])
    for rows in (first, second):
        spark.createDataFrame([rows], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    tables = jobs.GraphTables(str(tmp_path / "out"))
    jobs.graph_stream(jobs.read_stream(spark, str(tmp_path / "in"), schema, 1), tables, str(tmp_path / "checkpoint")).start().awaitTermination()
    entities, edges = jobs.graph_snapshot(spark, tables)
    assert [(r["id"], r["name"]) for r in entities.collect()] == [("a", "newest")] and sorted((r["src"], r["dst"]) for r in edges.collect()) == [("a", "b"), ("a", "c")]
    assert [r["confidence"] for r in jobs.stored(spark, tables.notices, jobs.ENTITIES).collect()] == [0.95]


def test_extraction_outcomes(spark, tmp_path):
    rows = [(1, 'so {"a": 1}', 1), (2, "none", 1), (3, "none", 3)]
    spark.createDataFrame(rows, "id long, text string, attempt int").write.parquet(str(tmp_path / "in"))
    good, again, bad = (str(tmp_path / x) for x in ("good", "again", "bad"))
    jobs.extraction_stream(jobs.read_stream(spark, str(tmp_path / "in"), "id long, text string, attempt int"), good, again, bad, str(tmp_path / "checkpoint")).start().awaitTermination()
    ids = lambda t, schema: [tuple(r)[:-1] for r in jobs.stored(spark, t, schema).collect()]
    assert ids(good, "id long, json string") == [(1, '{"a": 1}')] and ids(again, "id long, attempt int") == [(2, 2)] and ids(bad, "id long, attempt int") == [(3, 3)]


def test_forms(spark):
    stat = "struct<drug:string,event:string,observed:bigint,expected:double,prr:double,ror:double,ic:double,ic_lower:double,chi_squared:double,window_start:timestamp_ntz,window_end:timestamp_ntz>"
    trend = "struct<keyword:string,district:string,z_score:double,baseline:double,current:double,window_start:timestamp_ntz,window_end:timestamp_ntz>"
    cluster = "struct<centroid_lat:double,centroid_lon:double,radius_deg:double,population:bigint,observed:bigint,expected:double,log_likelihood:double,p_value:double,window_start:timestamp_ntz,window_end:timestamp_ntz>"
    schema = f"id string, project_id string, kind string, score double, status string, title string, explanation string, district string, started_at timestamp_ntz, detected_at timestamp_ntz, audit_chain_head string, codes array<struct<code_system:string,code:string,surface:string,display_name:string>>, evidence_mention_ids array<string>, adr_stat {stat}, trend_stat {trend}, cluster_stat {cluster}"
    now = dt.datetime(2024, 1, 2, 3, 4, 5)
    codes = [("RxNorm", "1", "syrup", None), ("MedDRA", "2", "fever", "Fever"), ("LOCAL", "3", "x", None)]
    rows = [
        ("s1", "p1", "adr", 0.7, "new", "t", "why", "north", now, now, "abcdef01", codes, ["m1", "m2"], ("syrup", "fever", 9, 1.5, 2.0, 3.0, 0.5, 0.1, 4.0, now, now), None, None),
        ("s2", None, "trend", 0.2, "new", "t", "why", None, now, now, None, [], [], None, ("fever", None, 3.0, 2.0, 7.5, now, now), None),
        ("s3", "p1", "adr", 0.9, "new", "t", "why", None, now, now, None, [], [], None, None, None),
    ]
    signals = spark.createDataFrame(rows, schema)
    projects = spark.createDataFrame([("p1", "slug", "Name", "own")], "id string, slug string, name string, owner string")
    forms, rejects = ledger.outbreak_forms(signals, projects, "2024-06-01T00:00:00+00:00", case_definition="def")
    out = {r["id"]: json.loads(r["payload"]) for r in forms.collect()}
    assert set(out) == {"s2"} and {r["id"] for r in rejects.collect()} == {"s1", "s3"}
    f = out["s2"]
    assert f["form_type"] == "IDSP-P" and f["outbreak"]["presumptive_case_count"] == 8 and f["outbreak"]["case_definition"] == "def" and "district" not in f["outbreak"] and "project_id" not in f["header"]
    assert f["statistics"]["trend"]["window_end"] == "2024-01-02T03:04:05+00:00" and "cluster" not in f["statistics"] and f["codes"] == {} and f["evidence_mention_count"] == 0
    cases, bad = ledger.case_forms(signals, projects, "2024-06-01T00:00:00+00:00", patient={"patientsex": "1"})
    (c,) = cases.collect()
    p = json.loads(c["payload"])
    assert c["serious"] and p["serious"] == "1" and p["safetyreportid"] == "SETU-s1" and p["patient"]["patientsex"] == "1" and p["header"]["project_slug"] == "slug" and p["header"]["audit_chain_head"] == "abcdef01"
    assert p["drugs"][0]["drugcoding"] == [{"system": "RxNorm", "code": "1", "surface": "syrup"}] and p["reactions"][0]["reactioncoding"] == [{"system": "MedDRA", "code": "2", "surface": "fever"}] and p["statistics"]["prr"] == 2.0
    assert {r["id"]: r["reason"] for r in bad.collect()} == {"s2": "needs an adr signal", "s3": "needs an adverse event statistic"}


def test_records(spark):
    rows = [("0" * 8 + "-0000-0000-0000-" + "0" * 12, "a", "confirm", None, dt.datetime(2024, 1, 1)), ("x", " ", "maybe", "r" * 9000, None)]
    df = spark.createDataFrame(rows, "signal_id string, actor string, decision string, rationale string, decided_at timestamp")
    assert [r["reasons"] for r in ledger.validated_record(df, "triage").orderBy("signal_id").collect()] == [[], ["signal_id:pattern", "actor:length", "decision:enum", "rationale:length", "decided_at:missing"]]
    assert ledger.validated_record(df.drop("actor").withColumn("more", F.lit(1)), "triage").orderBy("signal_id").first()["reasons"] == ["actor:missing", "more:unknown"]
    for record, fields in ledger.RECORDS.items():
        assert ledger.validated_record(spark.createDataFrame([(1,)], "nothing int"), record).first()["reasons"] == [*(f"{n}:missing" for n, k in fields if not k.endswith("?")), "nothing:unknown"]
