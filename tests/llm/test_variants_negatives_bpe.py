"""Spelling variants, hard negatives and byte-level BPE against brute force, with odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from signalwatch.llm import byte_bpe, hard_negatives, queries, spelling_variants

SF = "/root/testdata/sf0.001"


# spelling variants


def by_hand(docs, least_n=3, least_length=5, one_in=97):
    """(form, root, n, n_near, form_n) of each word, from pairs found by plain edits."""
    count = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            count[run if h % one_in else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    n = {w: k for w, k in count.items() if k >= least_n and len(w) >= least_length}
    letters = sorted({c for w in n for c in w})
    form, near = {}, {}
    for w in n:
        edits = {w[:i] + w[i + 1 :] for i in range(len(w))} | {w[:i] + c + w[i + d :] for c in letters for d in (0, 1) for i in range(len(w) + 1 - d)}
        near[w] = [x for x in edits if x in n and x != w]
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None)
    return out


def told(df):
    rows = df.collect()
    out = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}
    assert len(out) == len(rows)
    return out


def test_op12_whole_table(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert told(queries.op12_spelling_variants(spark, SF)) == by_hand(docs)


@pytest.mark.parametrize("most", [1, 30, 50_000])
def test_variants_whatever_the_cut(spark, most):
    rng = random.Random(5)
    base = ["".join(rng.choice("abcé") for _ in range(rng.randint(5, 7))) for _ in range(150)]
    long = "x" * 90
    # words that share all counts, words longer than a matrix row, and counts beyond what a vector holds
    words = base + ["abcab", "baacb", "cabab", "ababc", "aabbc"] + [long, long + "y", "y" + long, "x" * 300, "x" * 301, "x" * 299 + "y"]
    docs = [(k, " ".join([w] * rng.choice((3, 6, 7, 15)))) for k, w in enumerate(words)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = told(spelling_variants.variants(df, most=most))
    assert got == by_hand(docs)
    assert max(v[3] for v in got.values()) > 2 and any(v[1] != w for w, v in got.items())


def test_variants_odd_rows(spark):
    text = "Straße straße STRASSE; naïve/naive×naïve 中文 cafés cafes cafes"
    docs = [(None, text), (None, text), (1, None), (2, ""), (3, "12 \t\n"), (4, text + " \U0001f600" + text), (4, text)]
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, word string, n int")
    assert told(spelling_variants.variants(df)) == by_hand(docs) != {}
    assert told(spelling_variants.variants(df, least_n=10**6)) == {} == told(spelling_variants.variants(df.limit(0)))


def test_one_edit():
    for a, b, want in ((b"abc", b"abc", False), (b"abc", b"abd", True), (b"abc", b"abcd", True), (b"abc", b"xabc", True), (b"abc", b"acb", False), (b"abc", b"abcde", False), (b"aab", b"ab", True), (b"", b"a", True)):
        assert spelling_variants.one_edit(a, b) == spelling_variants.one_edit(b, a) == want


# hard negatives


def mined(rows, top=5, wanted=5):
    """As the contract says, over all pairs."""
    use = []
    for k, (i, label, v) in enumerate(rows):
        if i is None or label is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        use.append((i, (label + 1) % 10 if i % 7 == 0 else label, [int(np.floor(256 * float(x))) for x in v], k))
    out = Counter()
    for i, label, q, k in use:
        if i % 100:
            continue
        score = [(-sum(a * b for a, b in zip(q, p)), j, m, other) for j, other, p, m in use if m != k]
        for minus, pos, _, other in sorted(x for x in score if x[3] == label)[:top]:
            below = sorted(x for x in score if x[3] != label and 80 * -minus <= 100 * -x[0] <= 100 * -minus)
            for rank, (worse, neg, _, _) in enumerate(below[:wanted], 1):
                out[i, pos, rank, neg, -minus, -worse] += 1
    return out


def negatives(df, **more):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return Counter(tuple(r) for r in hard_negatives.hard_negatives(df.withColumn("label", label), F.col("vec_id") % 100 == 0, **more).collect())


def test_op11_whole_table(spark):
    rows = [(r["vec_id"], r["label"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert Counter(tuple(r) for r in queries.op11_hard_negatives(spark, SF).collect()) == mined(rows) != Counter()


@pytest.mark.parametrize("first", [1, 64])
def test_negatives_in_rounds(spark, monkeypatch, first):
    """Clustered vectors, where bounds stop early; copies and ties; small pieces and blocks."""
    monkeypatch.setattr(hard_negatives, "PIECE", 17), monkeypatch.setattr(hard_negatives, "BLOCK", 2)
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 6))
    rows = [(int(i), int(rng.integers(0, 3)), (centres[rng.integers(12)] + 0.05 * rng.normal(size=6)).tolist()) for i in range(600)]
    rows += [(1000 + i, i % 3, rows[0][2]) for i in range(80)]
    df = spark.createDataFrame([(*r, 1, "c") for r in rows], "vec_id long, label int, embedding array<double>, row int, second string")
    assert negatives(df, codewords=6, first=first) == mined(rows) != Counter()


def test_visits_stop_early(spark):
    """The bounds are worth something: on clustered vectors a list is certain before all rows are seen."""
    rng = np.random.default_rng(3)
    points = np.floor(256 * (np.repeat(np.eye(8) * 4, 40, 0) + 0.01 * rng.normal(size=(320, 8))))
    codes = (hard_negatives.codebook(points[:, :4], 5), hard_negatives.codebook(points[:, 4:], 5))
    near = [np.argmin(((p[:, None] - c[None]) ** 2).sum(2), 1) for p, c in zip((points[:, :4], points[:, 4:]), codes, strict=True)]
    far = [np.sqrt(((p - c[n]) ** 2).sum(1)) for p, c, n in zip((points[:, :4], points[:, 4:]), codes, near, strict=True)]
    cells = {}
    for i, j, a, b in zip(*near, *far, strict=True):
        c = cells.setdefault((i, j), {"first": i, "second": j, "n": 0, "far1": 0.0, "far2": 0.0})
        c["n"], c["far1"], c["far2"] = c["n"] + 1, max(c["far1"], a), max(c["far2"], b)
    index = hard_negatives.Index(codes, list(cells.values()))
    for x in points[::40]:
        score = points @ x
        seen = [b for b, *_ in hard_negatives.cells_by_bound(*index.bounds(x))]
        assert seen == sorted(seen, reverse=True)
        cell, popped, rest = index.visits(x, 0, 10, -np.inf)
        got = [k for k in range(len(points)) if near[1][k] in cell.get(near[0][k], [])]
        assert score[[k for k in range(len(points)) if k not in got]].max(initial=-np.inf) <= rest
        assert len(got) < len(points) and sorted(score[got])[-5] >= rest
        assert index.visits(x, popped, 10**9, -np.inf)[2] == -np.inf


def test_negatives_odd_rows(spark):
    rng = np.random.default_rng(4)
    rows = [(int(i), int(rng.integers(0, 2)), rng.normal(size=3).tolist()) for i in range(60)]
    rows += [(100, 0, [1.0, 1.0, 0.5]), (100, 0, [1.0, 1.0, 0.5]), (100, 1, [1.0, 1.0, 0.5]), (200, None, [1.0, 1.0, 1.0]), (300, 1, None), (400, 1, [1.0, None, 1.0]), (500, 1, [1.0, float("nan"), 1.0]), (None, 1, [1.0, 1.0, 1.0]), (600, 1, [0.0, 0.0, 0.0]), (700, 1, [float("inf"), 1.0, 1.0]), (900, 0, [1e-9, -1e-9, 1.0]), (-100, 1, [3.0, 2.0, 1.0])]
    kind = "vec_id long, label int, embedding array<double>"
    assert negatives(spark.createDataFrame(rows, kind), codewords=3) == mined(rows)
    # beyond what doubles hold exactly; shorter vectors count as filled up with zeros
    big = [(int(i), int(i) % 2, (rng.normal(size=3) * 60000).tolist()) for i in range(0, 300, 5)] + [(800, 0, [2.0]), (801, 1, [])]
    filled = [(i, k, [*v, *[0.0] * (3 - len(v))]) for i, k, v in big]
    assert negatives(spark.createDataFrame(big, kind), codewords=3) == mined(filled) != Counter()
    for few in ([], rows[60:61], [(200, None, None)]):
        assert negatives(spark.createDataFrame(few, kind)) == Counter()


# byte-level BPE


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.vocabulary(path).ranks, special_tokens={}), byte_bpe.vocabulary(path)


def raw(ids):
    return np.array(ids, "<u4").tobytes()


def test_op13_whole_table(spark, library):
    want = {}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        ids = library[0].encode_ordinary(r["text"] or "")
        want[r["doc_id"]] = (len(ids), hashlib.sha256(raw(ids)).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest())
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in queries.op13_byte_bpe(spark, SF).collect()}
    assert got == want


def test_pre_tokens_of_any_text(library):
    rng = random.Random(1)
    some = list("'''sstrevmldLS  \n\t\r 　 aBé1٣²!?.—漢\U0001f600\x1c\x85́‍<|>")
    texts = ["".join(rng.choice(some) for _ in range(rng.randint(0, 25))) for _ in range(20_000)]
    texts += [f"a{chr(c)}1{chr(c)} {chr(c)}'s \n{chr(c)}" for c in range(0, 0x110000, 7) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(texts), 5000):
        part = texts[at : at + 5000]
        assert library[1].encode(part) == [raw(library[0].encode_ordinary(t)) for t in part]


def test_perfect_hash(library):
    words = library[1]
    keys = list(words.ranks)
    others = [k + b"~~" for k in keys[:2000]] + [k[:-1] for k in keys if len(k) > 1 and k[:-1] not in words.ranks]
    every = keys + others
    data = np.frombuffer(b"".join(every) + bytes(8), np.uint8)
    size = np.array([len(k) for k in every])
    found = words.hash.find(data, np.cumsum(size) - size, size)
    assert (found[: len(keys)] == np.arange(len(keys))).all() and (found[len(keys) :] == np.where([k in words.ranks for k in others], [keys.index(k) if k in words.ranks else 0 for k in others], -1)).all()
    assert sorted(words.hash.key.tolist()) == list(range(len(keys)))
    small = byte_bpe.PerfectHash([b"a"])
    assert small.find(np.frombuffer(b"ab" + bytes(8), np.uint8), np.array([0, 1]), np.array([1, 1])).tolist() == [0, -1]


def test_bpe_odd_rows(spark, library, monkeypatch):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    long = ("lorem ipsum dolores " * 4000 + "x" * 5000 + "\n\n  " + "éè" * 3000 + " sit amet") * 3
    texts = [None, "", " ", "\n", "<|endoftext|>", "\x00\x00", long, long, "x" * 30_000, "a'b'c' 'll  'd", "repeat", "repeat"]
    df = spark.createDataFrame([(k // 2 or None, t, "i") for k, t in enumerate(texts)], "doc_id long, text string, ids string")
    out = byte_bpe.decoded(byte_bpe.encoded(df, path), path).collect()
    want = Counter((k // 2 or None, raw(library[0].encode_ordinary(t or "")), (t or "").encode()) for k, t in enumerate(texts))
    assert Counter((r["doc_id"], bytes(r["ids"]), bytes(r["decoded"])) for r in out) == want and all(r["n_tokens"] * 4 == len(r["ids"]) for r in out)
    assert byte_bpe.encoded(df.limit(0), path).count() == 0
    pieces = list(byte_bpe.segments(long, 1000))
    assert "".join(pieces) == long and len(pieces) > 50 and b"".join(library[1].encode(pieces)) == raw(library[0].encode_ordinary(long))
    with pytest.raises(ValueError):
        library[1].decode(np.array([60_000], np.uint32))
    monkeypatch.setattr(byte_bpe, "MEMORY", 5)  # results don't depend on what a worker remembers
    for t in ("qwzx vbnqq zzxq qwzx kjhg vbnqq", "kjhgf qwzx zzxq"):
        assert library[1].encode([t]) == [raw(library[0].encode_ordinary(t))]
