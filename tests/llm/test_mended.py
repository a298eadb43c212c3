"""Inputs that once gave wrong results."""

import hashlib

from pyspark.sql import functions as F

from signalwatch.llm import queries, token_counts
from signalwatch.llm.decontamination import contaminated
from signalwatch.llm.url_filter import host_of, judged, path_of


def test_only_the_first_scheme_counts(spark):
    urls = {
        "http://a.com?u=http://b.com/de/x": ("a.com", "", None, "allow"),
        "http://x.org#http://y.com/fr/": ("x.org", "", None, "allow"),
        "http://a.com/de/?u=http://x.org/": ("a.com", "/de/", "com/de/", "block"),
        "see http://S.com/de/1": ("s.com", "/de/1", "com/de/", "block"),
        "://a.org/x": ("a.org", "/x", "org/", "allow"),
        "http://": ("", "", None, "allow"),
        "http:/a.com/de/": ("", "", None, "allow"),
        "a\nb://c.com/fr/\n?": ("c.com", "/fr/\n", "com/fr/", "allow"),
        None: ("", "", None, "allow"),
    }
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rules = spark.createDataFrame(queries.URL_RULES, "host string, path string, verdict string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in judged(pages, rules).collect()}
    assert got == dict(enumerate(urls.values()))
    assert pages.select(host_of(F.col("url")), path_of(F.col("url"))).where("url is null").first() == ("", "")


def test_the_sql_of_urls_says_the_same(spark):
    import duckdb

    urls = ["http://a.com?u=http://b.com/de/x", "http://x.org#http://y.com/fr/", "http://é.x.ORG/é?://", "x", "", None, "http://a.example.org/es/?a=http://b.com/fr/"]
    db = duckdb.connect()
    db.execute("create table pages (page_id bigint, url varchar)")
    db.executemany("insert into pages values (?, ?)", list(enumerate(urls)))
    want = {(r[0], *r[1:5]) for r in db.sql(f"select page_id, host, path, rule, verdict from ({queries.ORACLES['op3_url_filter']})").fetchall()}
    rules = spark.createDataFrame(queries.URL_RULES, "host string, path string, verdict string")
    out = judged(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules)
    assert {(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in out.collect()} == want


def test_rows_without_an_id_and_with_the_same_one(spark):
    item = "one two three four five six seven eight nine ten"
    docs = [(None, item), (None, "other words"), (2, "say " + item), (2, "clean words"), (2, "clean words"), (3, None), (None, None)]
    out = contaminated(spark.createDataFrame([(*d, "x", 0) for d in docs], "doc_id long, text string, id string, n_hit int"), spark.createDataFrame([("b", item)], "item_id string, text string"))
    got = sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) for r in out.collect())
    assert got == sorted([("None", 10, 10, 1, True), ("None", 2, 0, 0, False), ("2", 11, 10, 1, True), ("2", 2, 0, 0, False), ("2", 2, 0, 0, False), ("3", 0, 0, 0, False), ("None", 0, 0, 0, False)])
    assert {r["items_sha256"] for r in out.where("contaminated").collect()} == {hashlib.sha256(b"b").hexdigest()}


def test_compaction_remembers_batches(spark, tmp_path):
    rows = lambda n: spark.createDataFrame([("s", "en", "v", 1, n)], token_counts.CHANGES)
    first, second, third = (str(tmp_path / x) for x in "abc")
    assert token_counts.commit(rows(5), first, 1) and token_counts.commit(rows(4), first, 2) and not token_counts.commit(rows(4), first, 2)
    token_counts.compact(spark, first, second)
    assert not token_counts.commit(rows(4), second, 2) and not token_counts.commit(rows(4), second, 1) and token_counts.commit(rows(3), second, 0)
    assert [r["tokens"] for r in token_counts.totals(spark, second).collect()] == [12]
    token_counts.compact(spark, second, third)
    assert not any(token_counts.commit(rows(9), third, k) for k in (0, 1, 2)) and token_counts.commit(rows(1), third, 3)
    assert [(r["docs"], r["tokens"]) for r in token_counts.totals(spark, third).collect()] == [(4, 13)]
    token_counts.compact(spark, str(tmp_path / "none"), str(tmp_path / "empty"))
    assert token_counts.totals(spark, str(tmp_path / "empty")).count() == 0


def test_classes_that_wait_are_not_multiplied(spark):
    """A class waits in many buckets: what is counted is each class once, and no row of a bucket becomes two."""
    from signalwatch.llm.minhash_dedup import _present

    rows = [(key, rep, rep % 3) for key in range(50) for rep in range(3, 20)]
    there = _present(spark.createDataFrame(rows, "key long, rep long, leader long"))
    assert sorted(r[0] for r in there.collect()) == list(range(20))
    assert "Generate" not in there._jdf.queryExecution().executedPlan().toString()


def test_members_meet_once_for_a_leader(spark, monkeypatch):
    """Two members that share many buckets of a leader are compared once for it, and links that it doesn't make are found."""
    from collections import Counter

    from signalwatch.llm import minhash_dedup as m

    word = lambda k: f"w{k} "
    common = "".join(map(word, range(70)))
    texts = [common + "".join(map(word, range(70, 100)))] * 3
    texts += [common + "".join(map(word, range(1000 * k, 1000 * k + 28))) + f"x{j} " for k in range(1, 13) for j in range(2)]
    tasks, stars = [], []
    rest, led = m._rest, m._led
    monkeypatch.setattr(m, "_rest", lambda t, p: (tasks.append(t.collect()), rest(t, p))[1])
    monkeypatch.setattr(m, "_led", lambda star, *more: (stars.append(star.select("leader").distinct().count()), led(star, *more))[1])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in m.near_duplicates(docs, shingle=1, per_cent=80, rows=1, miss=1e-6).collect()}
    assert got == {0: 0, 1: 0, 2: 0} | {k: k - (k - 3) % 2 for k in range(3, 27)}
    met = Counter((x["rep"], y["rep"]) for t in tasks[0] for x in t["few"] for y in t["many"])
    assert met and max(met.values()) <= stars[0]
