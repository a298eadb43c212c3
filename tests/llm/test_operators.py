"""Each operator against a plain version on small tables with nulls, empty and long texts, copies and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from itertools import combinations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from signalwatch.llm import decontamination, embedding_dedup, language_id, minhash_dedup, packing, quality, queries, shared, substring_dedup, textbytes, token_counts, toxicity, url_filter

DOCS = "doc_id long, text string, lang string, source string, n_chars long, component_id long, key string, hash string"
rng = random.Random(5)
VOCAB = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(400)]


def prose(n, r=rng):
    return " ".join(r.choice(VOCAB) for _ in range(n))


def frame(spark, texts, ids=None):
    rows = [(i if ids is None else ids[i], t, "en", f"s{i % 3}", 0, -1, "k", "h") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", low(text))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def reach(ids, links):
    label = {i: i for i in ids}
    while True:
        new = dict(label)
        for a, b in links:
            new[a] = new[b] = min(new[a], new[b])
        if new == label:
            return label
        label = new


def near_copies(r):
    base = [prose(60, r) for _ in range(6)]
    out = []
    for b in base:
        for _ in range(25):
            w = b.split()
            for _ in range(r.randint(0, 6)):
                w[r.randrange(len(w))] = r.choice(VOCAB)
            out.append(" ".join(w))
    return out


@pytest.mark.parametrize(("k", "per_cent"), [(3, 85), (5, 80)])
def test_near_duplicates(spark, k, per_cent):
    texts = near_copies(random.Random(k)) + [None, "", "  \n", "two words", "Two\tWORDS", "one", prose(5000), "É é", "é É"] + [prose(30) for _ in range(40)]
    texts += texts[:5]
    out = {r["doc_id"]: r for r in minhash_dedup.near_duplicates(frame(spark, texts), k, per_cent).collect()}
    sets = [shingles(t, k) for t in texts]
    links = [(a, b) for a, b in combinations(range(len(texts)), 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= per_cent * len(sets[a] | sets[b])]
    want = reach(range(len(texts)), links)
    assert len(out) == len(texts)
    for i in range(len(texts)):
        assert (out[i]["n_shingles"], out[i]["component_id"], out[i]["kept"]) == (len(sets[i]), want[i], want[i] == i)


def test_near_duplicates_of_nothing(spark):
    assert minhash_dedup.near_duplicates(frame(spark, [])).count() == 0
    out = minhash_dedup.near_duplicates(frame(spark, ["a b c", "a b c"], [None, 7])).collect()
    assert {(r["doc_id"], r["component_id"]) for r in out} == {(None, 7), (7, 7)}


def test_table_keys_are_pairs(spark):
    rows = spark.createDataFrame([(list(range(9)), list(range(9, 15)))], "first array<bigint>, second array<bigint>")
    keys = rows.select(minhash_dedup.table_keys()).first()[0]
    assert len(keys) == len(set(keys)) == 9 * 6


def test_only_shared_halves_make_keys(spark):
    classes = spark.createDataFrame([(1, [1, 2, 3, 4]), (2, [1, 9, 3, 8]), (3, [7, 6, 5, 0]), (4, [1, 10, 11, 12])], "rep long, halves array<bigint>")
    got = {r["rep"]: (set(r["first"]), set(r["second"])) for r in minhash_dedup.met_halves(classes, 2).collect()}
    assert got == {1: ({1}, {3}), 2: ({1}, {3})}


def test_rows_that_share_an_id(spark):
    """Of two texts under one doc_id each links with what it is like."""
    a, b = prose(60).split(), prose(60).split()
    texts = [" ".join(a), " ".join(b), " ".join([*b[:-1], "other"]), " ".join(a[1:])]
    out = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in minhash_dedup.near_duplicates(frame(spark, texts, [1, 1, 5, 7]), 3, 85).collect())
    assert [(i, c) for i, _, c in out] == [(1, 1), (1, 1), (5, 1), (7, 1)]
    groups = {(r["doc_id"], r["row"]): r["component"] for r in minhash_dedup.grouped(frame(spark, texts, [1, 1, 5, 7]).withColumn("row", F.length("text")), 3, 85).collect()}
    assert len(set(groups.values())) == 2 and groups[5, len(texts[2])] == groups[1, len(texts[1])]


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1060)] + [(5, 5)]
    want = reach({x for e in edges for x in e}, edges)
    got = {x["node"]: x["component"] for x in shared.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: v for k, v in want.items() if k in got} and {x for a, b in edges if a != b for x in (a, b)} == set(got)


def test_among_loses_no_row(spark, monkeypatch):
    """All rows with a wanted key come through, and with enough places few others; with too few, all."""
    df = spark.range(5000).select(F.col("id").alias("key"), F.lit("x").alias("text"))
    ids = spark.range(0, 5000, 50).select(F.col("id").alias("wanted"))
    out = shared.among(df, "key", ids)
    assert out.columns == df.columns and {50 * i for i in range(100)} <= {r["key"] for r in out.collect()} and out.count() < 110
    monkeypatch.setattr(shared, "PLACES", 64)
    assert {50 * i for i in range(100)} <= {r["key"] for r in shared.among(df, "key", ids).collect()} and shared.among(df, "key", ids.limit(0)).count() == 0


def test_word_hashes_do_not_depend_on_place():
    import pyarrow as pa

    texts = ["Alpha beta", "x  alpha", None, "", "beta ALPHA\nalpha"]
    seen = {}
    for _, _, offsets, data in textbytes.chunks(pa.array(texts), 4):
        start, end, row = textbytes.spans(offsets, data, textbytes.SPACE)
        for a, b, h in zip(start, end, textbytes.word_hashes(data, start, end), strict=True):
            seen.setdefault(bytes(data[a:b]).lower(), set()).add(int(h))
    assert {k: len(v) for k, v in seen.items()} == {b"alpha": 1, b"beta": 1, b"x": 1} and len({h for v in seen.values() for h in v}) == 3


def test_token_ledger(spark, tmp_path):
    path = queries.word_tokenizer()
    docs = frame(spark, ["a b", None, "", "a b"]).withColumn("source", F.when(F.col("doc_id") != 2, F.col("source")))
    counts = token_counts.counted(docs, path, "v1")
    table = str(tmp_path / "t")
    assert token_counts.commit(token_counts.inserts(counts), table, 0) and not token_counts.commit(token_counts.inserts(counts), table, 0)
    token_counts.commit(token_counts.deletes(counts.where("doc_id = 3")), table, 1)
    new = token_counts.counted(docs.where("doc_id = 0").withColumn("text", F.lit("a b c d")), path, "v1")
    token_counts.commit(token_counts.revisions(counts.where("doc_id = 0"), new), table, 2)
    (tmp_path / "t" / "batch=9").mkdir()  # a batch that died: no _SUCCESS
    got = {(r["source"], r["lang"], r["tokenizer"]): (r["docs"], r["tokens"]) for r in token_counts.totals(spark, table).collect()}
    assert got == {("s0", "en", "v1"): (1, 4), ("s1", "en", "v1"): (1, 0), (None, "en", "v1"): (1, 0)}
    token_counts.compact(spark, table, str(tmp_path / "c"))
    assert {tuple(r) for r in token_counts.totals(spark, str(tmp_path / "c")).collect()} == {(*k, *v) for k, v in got.items()}
    assert token_counts.totals(spark, str(tmp_path / "none")).count() == 0


ODD = ["Hello, world. it's", "don't.x", "A.B,C .,", "é É, ß.", "<|endoftext|> x", "a\x1cb", "日本 語.", "", "x" * 3000, "1,5 2.", "ΑΣ σς", "éa, b.", "tab\tnew\nline. nbsp, ok", "!!! ... ,,", "İstanbul, I."]


def test_tokens_are_the_tokenizers(spark):
    from tokenizers import Tokenizer

    from signalwatch.llm.tokens import encode_words

    model = Tokenizer.from_file(queries.word_tokenizer())
    texts = ODD + [prose(50) + ". " + prose(9).title() + "," for _ in range(20)]
    for text, ids in zip(texts, encode_words(texts, queries.word_tokenizer()), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == model.encode(text, add_special_tokens=False).ids, text


def test_memory_of_words_changes_nothing(monkeypatch):
    from signalwatch.llm import tokens

    path, texts = queries.word_tokenizer(), [prose(40, random.Random(k)) + ", end." for k in range(40)]
    whole = tokens.encode_words(texts, path)
    monkeypatch.setattr(tokens, "MEMORY_WORDS", 30)
    monkeypatch.setattr(tokens, "_memory", {})
    assert [tokens.encode_words([t], path)[0] for t in texts] == whole and len(tokens._memory[path][0]) < 120


def test_packing(spark):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(queries.word_tokenizer())
    texts = [None, "", "one", prose(3000), *ODD]
    out = packing.packed(frame(spark, texts), queries.word_tokenizer()).collect()
    assert len({r["sequence_id"] for r in out}) == len(out)
    for i, t in enumerate(texts):
        ids = [*model.encode(t or "", add_special_tokens=False).ids, 1]
        own = sorted((r for r in out if r["doc_id"] == i), key=lambda r: r["start"])
        assert [x for r in own for x in r["input_ids"]] == ids
        for r in own:
            piece = ids[r["start"] : r["start"] + r["length"]]
            assert 1 << r["bucket"] == r["length"] and r["length"] & (r["length"] - 1) == 0 and r["length"] <= 2048 and r["offset"] == 0 and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(np.array(piece, "<u4").tobytes())


def test_url_filter(spark):
    urls = ["http://A.example.org/es/1", "https://x.com/de/9?q", "http://y.com/fr/1", "http://z.com/", "http://notorg/", "http://b.org", "http://q.org?x=/es/", None, "no scheme", "http://example.org/en/1#x", "http://xexample.org/en/1", "ftp://u@w.com:80/de/", "http://a..org/x", "http://org/x"]
    pages = spark.createDataFrame([(i, u, "h", "rule", "x") for i, u in enumerate(urls)], "page_id long, url string, host string, rule string, digest string")
    rules = spark.createDataFrame(queries.URL_RULES * 2, "host string, path string, verdict string")
    for r in url_filter.judged(pages, rules).collect():
        u = urls[r["page_id"]]
        m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", u or "")
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        fit = [(len(h + p), h + p, v) for h, p, v in queries.URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fit) if fit else (0, None, "allow")
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, best[1], best[2]), u
    assert url_filter.judged(pages.limit(0), rules).count() == 0 and {r["verdict"] for r in url_filter.judged(pages, rules.limit(0)).collect()} == {"allow"}


def test_language(spark):
    r = random.Random(3)
    word = {x: ["".join(r.choice(x) for _ in range(r.randint(2, 6))) for _ in range(60)] for x in ("abcdeq", "mnopst", "uvwxyz")}
    rows = [(i, x[:2], None, f"h{i % 4}.org", " ".join(r.choice(word[x]) for _ in range(40)), 1.0) for i, x in enumerate(list(word) * 40)]
    rows += [(900, None, "de", None, rows[0][4], 1.0), (901, "mn", None, "h0.org", rows[0][4], 1.0), (902, "ab", None, "h", None, 1.0), (903, "ab", None, "h", "123 !!", 1.0), (904, "", "", "", "", 1.0)]
    out = {x["doc_id"]: x for x in language_id.identified(spark.createDataFrame(rows, "doc_id long, declared string, suffix string, host string, text string, p double").select("doc_id", "declared", "suffix", "host", "text")).collect()}
    assert len(out) == len(rows) and all(out[k]["lang"] == d and out[k]["kept"] for k, d, *_ in rows[:120])
    assert out[900]["lang"] == "ab" and out[901]["lang"] == "ab"
    assert [(out[k]["lang"], out[k]["kept"]) for k in (902, 903, 904)] == [("und", False)] * 3
    assert language_id.identified(spark.createDataFrame([], "doc_id long, declared string, suffix string, host string, text string")).count() == 0


def test_rare_languages_and_clashing_columns(spark):
    """One text of a language among 1,500 of another is still told, and key columns of any name come back as they were."""
    r = random.Random(23)
    word = {x: ["".join(r.choice(x) for _ in range(r.randint(2, 6))) for _ in range(60)] for x in ("abcdeq", "mnopst")}
    rows = [(i, "en", "h", " ".join(r.choice(word["abcdeq"]) for _ in range(30)), 0.5, "keep", 7) for i in range(1500)]
    rows.append((1500, "fi", "h", " ".join(r.choice(word["mnopst"]) for _ in range(30)), 0.5, "keep", 7))
    rows.append((1501, "not a language", "h", rows[0][3], 0.5, "keep", 7))
    table = spark.createDataFrame(rows, "doc_id long, declared string, host string, text string, p double, lang string, total int").withColumn("suffix", F.lit(None).cast("string"))
    found = language_id.identified(table)
    assert sorted(found.columns) == sorted(["doc_id", "p", "total", "lang", "confidence", "kept"])
    out = {x["doc_id"]: x for x in found.collect()}
    assert out[1500]["lang"] == "fi" and out[1500]["kept"] and out[1501]["lang"] == "en" and all(out[i]["lang"] == "en" for i in range(1500))
    assert all((x["p"], x["total"]) == (0.5, 7) for x in out.values())


def test_page_parts(spark):
    html = '<!DOCTYPE html><HTML class="a" lang="fr-FR"><script>var t="</p>";</script><!-- x --><p>Un mot</p>&amp;'
    r = spark.createDataFrame([(html,), (None,)], "h string").select(language_id.page_language(F.col("h")).alias("l"), language_id.page_text(F.col("h")).alias("t")).collect()
    assert r[0]["l"] == "fr-FR" and r[0]["t"].split() == ["Un", "mot"] and r[1]["t"] is None


def test_passages(spark):
    r = random.Random(9)
    shared_text = prose(80, r)
    texts = [prose(100, r) + " " + shared_text + " " + prose(50, r), prose(20, r) + "\n" + shared_text + "\n" + prose(70, r), prose(300, r), None, "", shared_text, prose(3, r), "é" * 9000, prose(200, r)]
    docs = frame(spark, texts)
    found = substring_dedup.repeated_passages(docs).collect()
    assert {x["doc_id"] for x in found} == {0, 1, 5} and {x["first_doc_id"] for x in found} == {0}
    assert {x["doc_id"] for x in found if x["kept"]} == {0}
    left = {x["doc_id"]: x["text"] for x in substring_dedup.without_repeats(docs).collect()}
    assert set(left) >= {0, 1, 2, 3, 4, 6, 7, 8} and all(left[i] == texts[i] for i in (0, 2, 3, 4, 6, 7, 8))
    middle = " ".join(shared_text.split()[25:55])
    assert middle in left[0] and middle not in left[1] and middle not in left.get(5, "")
    own = texts[1].split("\n")
    assert left[1].startswith(own[0][:40]) and left[1].endswith(own[2][-200:])
    assert substring_dedup.repeated_passages(docs.limit(0)).count() == 0
    assert set(substring_dedup.without_repeats(docs).columns) == set(docs.columns)


def test_passages_of_repeated_rows(spark):
    """Equal rows under one id are one document: alone they repeat nothing. Different texts under one id are cut each at its own places."""
    r = random.Random(19)
    passage = prose(59, r)
    a, b, c = prose(30, r) + " " + passage, passage + " " + prose(40, r), prose(90, r)
    once, twice = ({tuple(x) for x in substring_dedup.repeated_passages(frame(spark, t, i)).collect()} for t, i in (([a, b, c], [0, 1, 2]), ([a, a, b, b, c, c], [0, 0, 1, 1, 2, 2])))
    assert once == twice and {x[0] for x in once} == {0, 1} and all(x[3] >= 55 for x in once)
    left = substring_dedup.without_repeats(frame(spark, [a, a, b, b], [0, 0, 1, 1]).withColumn("__cuts0", F.lit(1)).withColumn("__row0", F.lit(2))).collect()
    assert sorted(len(x["text"].split()) > 60 for x in left) == [False, False, True, True] and left[0]["__cuts0"] == 1
    same_id = {x["text"] for x in substring_dedup.without_repeats(frame(spark, [a, b, c], [5, 5, 6])).collect()}
    assert c in same_id and len(same_id & {a, b}) == 1 and sum(map(len, same_id)) < len(a) + len(b) + len(c) - 250


def test_chance_repeats_are_no_passages(spark):
    """Every few words of a stand in another document, each beside other words: nothing of a is a passage."""
    r = random.Random(31)
    a, b, c = prose(120, r).split(), prose(120, r).split(), prose(60, r)
    parts = [a[k : k + 12] for k in range(0, 120, 6)]
    mosaic = [" ".join([*b[6 * k : 6 * k + 12], *p, *b[-6 * k - 12 : len(b) - 6 * k]]) for k, p in enumerate(parts)]
    texts = [" ".join(a), *mosaic, c + " " + prose(30, r), prose(30, r) + " " + c]
    n = len(texts)
    found = substring_dedup.repeated_passages(frame(spark, texts)).collect()

    def shared(i, x):
        w, own = 20, texts[i].encode()[x["start"] : x["start"] + x["bytes"]].decode().split()
        return x["words"] == len(own) >= w and any(f" {' '.join(own[:w])} " in f" {t} " for j, t in enumerate(texts) if j != i)

    assert all(shared(x["doc_id"], x) for x in found) and {n - 2, n - 1} <= {x["doc_id"] for x in found} and 0 not in {x["doc_id"] for x in found}
    left = {x["doc_id"]: x["text"] for x in substring_dedup.without_repeats(frame(spark, texts)).collect()}
    assert left[0] == texts[0] and left[n - 2] == texts[n - 2] and len(left[n - 1]) < len(texts[n - 1])


def test_chunks_resist_shifts():
    r = random.Random(4)
    text = prose(2000, r).encode()
    moved = b"inserted words " + text

    def pieces(raw):
        data = np.frombuffer(raw, np.uint8)
        ends = substring_dedup.cut_points(np.array([0, len(data)]), data, 4)
        return [raw[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    a, b = pieces(text), pieces(moved)
    assert b"".join(a) == text and len(set(a) - set(b)) <= 3


def test_cuts_do_not_depend_on_the_row_before():
    r = random.Random(14)
    for _ in range(200):
        before, own = prose(3, r).encode(), prose(4, r).encode()
        data = np.frombuffer(before + own, np.uint8)
        both = substring_dedup.cut_points(np.array([0, len(before), len(data)]), data, 2)
        alone = substring_dedup.cut_points(np.array([0, len(own)]), np.frombuffer(own, np.uint8), 2)
        assert (both[both > len(before)] - len(before)).tolist() == alone.tolist()


def contaminated(docs, items, n=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
    sought = {}
    for i, t in items:
        w = words(t)
        m = min(n, len(w))
        for p in range(len(w) - m + 1 if w else 0):
            sought.setdefault(tuple(w[p : p + m]), set()).add(str(i))
    out = {}
    for d, t in docs:
        w, hit, own = words(t), set(), set()
        for m in {len(k) for k in sought}:
            for p in range(len(w) - m + 1):
                if (k := tuple(w[p : p + m])) in sought:
                    hit.update(range(p, p + m))
                    own |= sought[k]
        out[d] = (len(w), len(hit), len(own), hashlib.sha256(",".join(sorted(own)).encode()).hexdigest(), bool(hit))
    return out


def test_decontamination(spark):
    r = random.Random(6)
    items = [(i, prose(r.randint(10, 40), r)) for i in range(20)] + [(90, "tiny item"), (91, None), (92, "!!"), (93, "one"), (94, prose(9, r)), (7, "tiny item")]
    texts = [prose(200, r) for _ in range(30)] + [None, "", "ONE", "a tiny, Item b", items[0][1] + " " + items[1][1], items[24][1].upper() + " x"]
    texts += [prose(50, r) + " " + " ".join(t.split()[k : k + 12]) + " " + prose(20, r) for k, (_, t) in enumerate(items[:10])] + ["  ".join(items[3][1].split()[:10]), " ".join(items[3][1].split()[:9])]
    got = {x["doc_id"]: tuple(x)[1:] for x in decontamination.contaminated(frame(spark, texts), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == contaminated(list(enumerate(texts)), items)
    empty = decontamination.contaminated(frame(spark, ["a b"]), spark.createDataFrame([], "item_id long, text string")).first()
    assert (empty["n_words"], empty["n_hit"], empty["contaminated"]) == (2, 0, False)


def test_lexicon():
    lex = toxicity.Lexicon({"idiot$": 3.0, "trash$": 2.0, "scumb": 1.0}, ("trash can",))
    hits = lambda t: [toxicity.fold(t)[a:b] for a, b, _ in lex.hits(toxicity.fold(t))]
    assert hits("You 1d10t!") == ["idiot"] and hits("ІDIОT, trаsh") == ["idiot", "trash"] and hits("idiotic trash can") == [] and hits("the trash can is trash") == ["trash"] and hits("") == [] and hits("scumbag, unscumb") == ["scumb"]
    assert toxicity.fold("Ｉｄ​iót") == "idiot"


def test_toxicity(spark):
    r = random.Random(8)
    texts = [prose(40, r) + (f" {r.choice(['moron', 'M0R0N', 'scum'])} " if i % 4 == 0 else " ") + prose(40, r) for i in range(400)] + [None, ""]
    docs = frame(spark, texts)
    labels = spark.createDataFrame([(i, int(i % 4 == 0), 1) for i in range(300)] + [(None, 1, 1), (5, None, 1)], "doc_id long, toxic int, text int")
    lexicon, curve = toxicity.learned(toxicity.sampled(docs, labels, "toxic"))
    assert {"moron$", "scum$"} <= set(lexicon.weights)
    out = {x["doc_id"]: x["score"] for x in toxicity.scored(docs, lexicon, curve).collect()}
    assert all((out[i] >= 0.3) == (i % 4 == 0) for i in range(400)) and out[400] == out[401] < 0.3
    none, flat = toxicity.learned(toxicity.sampled(docs, labels.limit(0), "toxic"))
    assert max(x["score"] for x in toxicity.scored(docs, none, flat).collect()) < 1e-9 and toxicity.scored(docs.limit(0), none, flat).count() == 0
    alone, one = toxicity.learned(toxicity.sampled(docs, labels.where("toxic = 0"), "toxic"))
    assert {x["score"] < 0.3 for x in toxicity.scored(docs, alone, one).collect()} == {True}


def test_scan_is_substring_search():
    """The automaton finds what looking for each word in turn finds, and safe phrases cover what lies within them."""
    r = random.Random(29)
    words = ["bad", "badly", "ugh", "rot", "rotten", "ab"]
    lex = toxicity.Lexicon({"bad$": 1.0, "rott": 2.0, "ugh$": 3.0, "ab$": 0.5}, ("bad day", "ugh ugh"))
    for _ in range(300):
        text = "".join(r.choice([*words, "day", " ", ", ", "x"]) for _ in range(12))
        plain = [(m.start(), m.end(), w) for p, w in ((r"bad(?![^\W\d_])", 1.0), (r"rott", 2.0), (r"ugh(?![^\W\d_])", 3.0), (r"ab(?![^\W\d_])", 0.5)) for m in re.finditer(rf"(?<![^\W\d_]){p}", text)]
        safe = [(m.start(), m.start() + len(p)) for p in lex.exceptions for m in re.finditer(rf"(?<![^\W\d_])(?={p}(?![^\W\d_]))", text) if p in ("bad day", "ugh ugh", *toxicity.EXCEPTIONS)]
        want = sorted(x for x in plain if not any(a <= x[0] and x[1] <= b for a, b in safe))
        assert sorted(lex.hits(text)) == want, text
    long = "a" * 60
    assert toxicity._word_before(f"{long} bad", 61) == long and toxicity._word_before("bad", 0) == "" and toxicity._word_before("x, bad", 3) == ""


def test_rare_and_short_toxic_words(spark):
    """A word in 2 % of toxic rows, as a small language's would be, and one of three letters are in the lexicon."""
    r = random.Random(18)
    texts = [prose(40, r) + (" moron " if i < 980 else " zut kretyn ") + prose(40, r) if i < 1000 else prose(80, r) for i in range(3000)]
    labels = spark.createDataFrame([(i, int(i < 1000)) for i in range(3000)], "doc_id long, toxic int")
    lexicon, _ = toxicity.learned(toxicity.sampled(frame(spark, texts), labels, "toxic"))
    assert lexicon.hits("kretyn") and lexicon.hits("zut") and not any(lexicon.hits(w) for w in VOCAB)


def test_word_vectors_are_sums(spark):
    """The table against loops over every token and its neighbours."""
    texts = [prose(30, random.Random(k)) + ", end!" for k in range(12)] + [None, ""]
    got, share = quality.word_vectors(frame(spark, texts))
    place, sign = quality._index()
    want, count = np.zeros((quality.CELLS, quality.WIDTH)), np.zeros(quality.CELLS)
    for t in texts:
        data = np.frombuffer((t or "").encode(), np.uint8)
        cells = quality.token_cells(np.array([0, len(data)]), data)[0].tolist()
        for i, c in enumerate(cells):
            count[c] += 1
            for j in range(max(0, i - quality.REACH), min(len(cells), i + quality.REACH + 1)):
                if j != i:
                    np.add.at(want[c], place[cells[j]], sign[cells[j]])
    assert np.allclose(share, count / count.sum())
    want -= want.sum(0) * share[:, None]
    assert np.allclose(got, want / np.maximum(np.linalg.norm(want, axis=1, keepdims=True), 1e-9), atol=1e-5)


def test_quality(spark):
    r = random.Random(12)
    texts = [prose(80, r) if i % 3 else " ### ".join(prose(3, r) + "%%%" for _ in range(20)) for i in range(360)] + [None, ""]
    docs = frame(spark, texts)
    vectors, share = quality.word_vectors(docs)
    assert abs(share.sum() - 1) < 1e-9
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(300)], "doc_id long, quality int")
    model = quality.trained(toxicity.sampled(docs, labels, "quality"), "quality", vectors, share)
    out = {x["doc_id"]: x["score"] for x in quality.scored(docs, model, vectors, share).collect()}
    right = np.mean([(out[i] >= 0.5) == (i % 3 > 0) for i in range(300, 360)])
    assert right >= 0.95 and all(0 <= v <= 1 for v in out.values()) and out[360] == out[361]
    unknown = quality.trained(toxicity.sampled(docs, labels.limit(0), "quality"), "quality", vectors, share)
    assert {x["score"] for x in quality.scored(docs, unknown, vectors, share).collect()} == {0.5} and quality.word_vectors(docs.limit(0))[1].sum() == 0
    single = quality.trained(toxicity.sampled(docs, labels.where("quality = 1"), "quality"), "quality", vectors, share)
    assert all(x["score"] > 0.9 for x in quality.scored(docs, single, vectors, share).collect())


def test_near_vectors(spark):
    g = np.random.default_rng(2)
    base = g.normal(size=(40, 16))
    rows = [(i, (base[i % 40] + g.normal(size=16) * r).tolist(), i % 2) for i, r in enumerate(g.uniform(0, 0.5, 300))]
    rows += [(400, rows[0][1], 0), (401, rows[0][1], 0), (402, None, 0), (403, [0.0] * 16, 0), (404, [math.nan] * 16, 0), (405, [None] * 16, 0), (406, rows[0][1], None), (407, rows[0][1][:8], 0), (408, [], 0), (409, [math.inf] * 16, 0)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, label int, rep long, block string")
    out = {r["vec_id"]: r for r in embedding_dedup.near_vectors(df).collect()}
    good = [(i, np.array(v, float), y) for i, v, y in rows if v and None not in v and y is not None and np.isfinite(v).all() and np.linalg.norm(v) > 0]
    links = [(a[0], b[0]) for a, b in combinations(good, 2) if a[2] == b[2] and len(a[1]) == len(b[1]) and a[1] @ b[1] / np.linalg.norm(a[1]) / np.linalg.norm(b[1]) >= 0.93]
    want = reach([r[0] for r in rows], links)
    assert len(links) > 50
    for i, *_ in rows:
        assert (out[i]["n_links"], out[i]["component_id"], out[i]["kept"]) == (sum(i in e for e in links), want[i], want[i] == i), i
    assert embedding_dedup.near_vectors(df.limit(0)).count() == 0


def test_many_equal_cells(spark):
    """More vectors in a cell than a piece holds."""
    g = np.random.default_rng(3)
    centre = g.normal(size=16)
    rows = [(i, (centre + g.normal(size=16) * 0.01).tolist(), 1) for i in range(700)]
    out = embedding_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert {(r["n_links"], r["component_id"]) for r in out} == {(699, 0)}


SF = "/root/testdata/sf0.001"


def test_vectors_that_share_an_id(spark):
    rows = [(1, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (2, [0.01, 1.0], 0), (None, [1.0, 0.0], 0)]
    out = sorted((r["vec_id"] or 0, r["n_links"], r["component_id"] or 0) for r in embedding_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect())
    assert out == [(0, 0, 0), (1, 0, 1), (1, 1, 1), (2, 1, 1)]


def test_many_pieces(spark, monkeypatch):
    """Slabs of several pieces, strips of several rows, guests: the same as all pairs."""
    monkeypatch.setattr(embedding_dedup, "PIECE_BYTES", 8 * 16 * 20)
    monkeypatch.setattr(embedding_dedup, "STRIP", 7)
    g = np.random.default_rng(9)
    base = g.normal(size=(6, 16))
    x = base[np.arange(240) % 6] + g.normal(size=(240, 16)) * 0.16
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = unit @ unit.T >= 0.93
    out = {r["vec_id"]: r["n_links"] for r in embedding_dedup.near_vectors(spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")).collect()}
    assert [out[i] for i in range(240)] == (links.sum(1) - 1).tolist() and 500 < links.sum() < 20_000


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracles(spark, name):
    import os

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    df = queries.QUERIES[name](spark, SF)
    cur = con.execute(queries.ORACLES[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(str, (tuple(r[c] for c in names) for r in df.collect()))) == sorted(map(str, cur.fetchall()))


def test_pipeline(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {r[0] for r in out.select("doc_id").distinct().collect()}
    near = {r["doc_id"] for r in minhash_dedup.near_duplicates(docs, 5, 80).where("not kept").collect()}
    assert kept and not kept & near and len(kept) > 0.5 * docs.count()
    totals = out.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("m")).where("n <> m").count()
    assert totals == 0
