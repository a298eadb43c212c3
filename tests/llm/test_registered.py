"""The registered queries themselves, over the smallest tables with odd rows added, against brute force."""

import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from signalwatch.llm import language_id, queries

from test_operators import low, reach, shingles

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """The smallest tables and, in documents, rows without an id, text, language or source, empty and repeated rows, and two texts under one id."""
    root = str(tmp_path_factory.mktemp("odd"))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first = docs.orderBy("doc_id").limit(2).collect()
    extra = [(None, "alone 1234567 here", "en", "s"), (None, "alone 1234567 here", "en", "s"), (9001, None, None, None), (9002, "", "en", None), (9003, " \n\t ", None, "s"), (9004, "one two", "en", "s"), (9005, "One TWO", "de", "s"), (9006, "x 1234567 y", "en", "s"), (9006, "other text 7654321", "de", "s"), (first[0]["doc_id"], first[0]["text"], "en", "s"), (first[0]["doc_id"], first[1]["text"], "en", "s")]
    rows = spark.createDataFrame(extra, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    kinds = {f.name: f.dataType for f in docs.schema.fields}
    docs.unionByName(rows.select(*(F.col(c).cast(kinds[c]) for c in docs.columns))).withColumn("key", F.lit("k")).write.parquet(f"{root}/documents.parquet")
    for name in ("labels", "pages", "benchmark", "embeddings"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{root}/{name}.parquet")
    return root


@pytest.fixture(scope="module")
def documents(spark, odd):
    return [r.asDict() for r in spark.read.parquet(f"{odd}/documents.parquet").collect()]


def model():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.word_tokenizer())


def test_op1(spark, odd, documents):
    sets = [shingles(d["text"], 3) for d in documents]
    links = [(i, j) for i, j in combinations(range(len(sets)), 2) if sets[i] and sets[j] and documents[i]["doc_id"] is not None and documents[j]["doc_id"] is not None and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])]
    group = reach(range(len(sets)), links)
    smallest: dict[int, int] = {}
    for i, g in group.items():
        if documents[i]["doc_id"] is not None:
            smallest[g] = min(smallest.get(g, 1 << 60), documents[i]["doc_id"])
    want = Counter()
    for i, d in enumerate(documents):
        c = smallest[group[i]] if d["doc_id"] is not None else None
        want[d["doc_id"], len(sets[i]), c, c is not None and c == d["doc_id"]] += 1
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in queries.op1_minhash_dedup(spark, odd).collect())
    assert {k: v for k, v in got.items() if k[0] is not None} == {k: v for k, v in want.items() if k[0] is not None} and sum(got.values()) == len(documents)


def test_op2(spark, odd, documents):
    """Totals as if the documents had been counted once after all changes."""
    tokenize = model()
    labels = {r["doc_id"] for r in spark.read.parquet(f"{odd}/labels.parquet").where("quality = 0").collect()}
    want: dict[tuple, list[int]] = {}
    for d in documents:
        total = want.setdefault((d["source"], d["lang"]), [0, 0])
        if d["doc_id"] in labels:
            continue
        text = d["text"] or ""
        text = re.sub(r"\d{6,}", "0", text, flags=re.ASCII)
        total[0] += 1
        total[1] += len(tokenize.encode(text, add_special_tokens=False).ids)
    got = {(r["source"], r["lang"]): [r["docs"], r["tokens"]] for r in queries.op2_token_counts(spark, odd).collect()}
    assert got == want


def test_op4(spark, odd, documents):
    out = queries.op4_language_id(spark, odd).collect()
    pages = spark.read.parquet(f"{odd}/pages.parquet").count()
    assert Counter(r["doc_id"] for r in out if r["page_id"] is None) == Counter(d["doc_id"] for d in documents) + Counter({None: 0}) or sum(r["page_id"] is None for r in out) == len(documents)
    assert sum(r["page_id"] is not None for r in out) == pages and all(0 <= r["confidence"] <= 1 and (r["lang"] == "und") == (not r["kept"]) for r in out)
    right = [r["lang"] for r in out if r["doc_id"] is not None and r["doc_id"] < 9000 and r["kept"]]
    declared = {d["doc_id"]: d["lang"] for d in documents if d["doc_id"] is not None}
    assert np.mean([r["lang"] == declared[r["doc_id"]] for r in out if r["doc_id"] is not None and r["doc_id"] < 9000 and r["kept"] and declared[r["doc_id"]]]) > 0.9 and right


def test_text_evidence_is_plain_bayes(spark):
    """Trigram counts and log likelihoods against loops over every trigram."""
    rows = [("en", "The cat, the hat"), ("de", "Der Hut und die Katze"), ("en", "a bat é"), (None, "the Katze sat"), ("de", None)]
    df = spark.createDataFrame(rows, "declared string, text string")
    table = language_id.trigram_counts(df, ["de", "en"])

    def codes(text):
        data = np.frombuffer((text or "").encode(), np.uint8)
        plain = [c + 32 if 65 <= c <= 90 else c for c in data.tolist()]
        plain = [c if 97 <= c <= 122 or c >= 128 else 32 for c in plain]
        out = []
        for a, b, c in zip(plain, plain[1:], plain[2:]):
            if b != 32 and not (a == 32 and c == 32):
                x = (a * 0x9E3779B1 & 0xFFFFFFFF) ^ (b * 0x85EBCA77 & 0xFFFFFFFF) ^ (c * 0xC2B2AE3D & 0xFFFFFFFF)
                out.append((((x ^ x >> 15) * 0x2C1B3C6D) & 0xFFFFFFFF) >> 18)
        return out

    want = np.zeros_like(table)
    for lang, text in rows:
        if lang:
            np.add.at(want[["de", "en"].index(lang)], codes(text), 1)
    assert (table == want).all()
    log = np.log(want + 0.5) - np.log((want + 0.5).sum(1, keepdims=True))
    for r, (_, text) in zip(sorted(language_id.text_evidence(df.withColumn("i", F.monotonically_increasing_id()), table).collect(), key=lambda r: r["i"]), rows, strict=True):
        c = codes(text)
        total = log[:, c].sum(1) * (min(len(c), language_id.WEIGHT) / max(len(c), 1))
        assert r["trigrams"] == len(c) and np.allclose(r["text_log"], total - total.max(), atol=1e-3)


def test_op5(spark, odd, documents):
    """Every passage is shared, word for word in runs of 20, with another document; and nearly all documents with a shared run of 51 words have one."""
    words = [(d["doc_id"], (d["text"] or "").split()) for d in documents if d["doc_id"] is not None]

    def owners(n):
        own: dict[tuple, set] = {}
        for i, (doc, w) in enumerate(words):
            for k in range(len(w) - n + 1):
                own.setdefault(tuple(w[k : k + n]), set()).add((doc, tuple(w)))
        return own

    found = queries.op5_substring_dedup(spark, odd).collect()
    twenty = owners(20)
    by_doc: dict[int, list] = {}
    for doc, w in words:
        by_doc.setdefault(doc, []).append(w)
    for r in found:
        assert r["words"] >= 20 and any(len(twenty.get(tuple(w[k : k + 20]), ())) > 1 for w in by_doc[r["doc_id"]] for k in range(len(w) - 19))
    shared = {doc for own in owners(51).values() if len(own) > 1 for doc, _ in own}
    assert shared and len(shared & {r["doc_id"] for r in found}) >= 0.95 * len(shared)


def test_op6(spark, odd, documents):
    tokenize = model()
    want = Counter()
    for d in documents:
        ids = [*tokenize.encode(d["text"] or "", add_special_tokens=False).ids, 1]
        want[d["doc_id"], len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    out = queries.op6_packing(spark, odd).collect()
    assert len({r["sequence_id"] for r in out}) == len(out) and {r["offset"] for r in out} == {0}
    assert sum(r["length"] for r in out) == sum(n * k for (_, n, _), k in want.items())
    single = Counter((r["doc_id"], r["doc_tokens"], r["ids_crc32"]) for r in out if r["length"] == r["doc_tokens"])
    assert single == Counter({k: v for k, v in want.items() if k[1] & (k[1] - 1) == 0 and k[1] <= 2048})


@pytest.mark.parametrize(("name", "label", "parts", "held"), [("op7_toxicity", "toxic", 4, 2), ("op9_quality", "quality", 5, 0)])
def test_classifiers(spark, odd, documents, tmp_path, name, label, parts, held):
    """A row for each document, part by crc32, predicted by the threshold; labels of the held-out part change nothing."""
    query = queries.QUERIES[name]
    out = query(spark, odd).collect()
    assert len(out) == len(documents)
    for r in out:
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % parts == held) and r["predicted"] == int(r["score"] >= 0.3) and 0 <= r["score"] <= 1
    part = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(parts)) == held
    for t in ("documents",):
        spark.read.parquet(f"{odd}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    labels = spark.read.parquet(f"{odd}/labels.parquet")
    labels.withColumn(label, F.when(part, 1 - F.col(label)).otherwise(F.col(label))).write.parquet(f"{tmp_path}/labels.parquet")
    again = Counter((r["doc_id"], round(r["score"], 6)) for r in query(spark, str(tmp_path)).collect())
    assert again == Counter((r["doc_id"], round(r["score"], 6)) for r in out)


def test_op10(spark, odd):
    rows = spark.read.parquet(f"{odd}/embeddings.parquet").collect()
    x = {r["vec_id"]: (r["label"], np.array(r["embedding"], float)) for r in rows if r["embedding"] and None not in r["embedding"] and r["label"] is not None and np.linalg.norm(np.array(r["embedding"], float)) > 0}
    ids = sorted(x)
    unit = np.stack([x[i][1] / np.linalg.norm(x[i][1]) for i in ids])
    same = np.array([x[i][0] for i in ids])[:, None] == np.array([x[i][0] for i in ids])[None]
    link = same & (unit @ unit.T >= 0.93) & ~np.eye(len(ids), dtype=bool)
    want = reach([r["vec_id"] for r in rows], [(ids[i], ids[j]) for i, j in zip(*np.nonzero(np.triu(link)))])
    n = dict(zip(ids, link.sum(1).tolist(), strict=True))
    for r in queries.op10_embedding_dedup(spark, odd).collect():
        assert (r["n_links"], r["component_id"], r["kept"]) == (n.get(r["vec_id"], 0), want[r["vec_id"]], want[r["vec_id"]] == r["vec_id"])


def test_lowering_matches():
    assert low("ÀB") == "Àb"
