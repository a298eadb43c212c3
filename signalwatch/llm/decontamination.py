"""Benchmark decontamination by winnowing, on built-in columns and joins only.

Every window of `span` words holds span-k+1 grams of k words; of each run of that many grams the smallest hash is a fingerprint. Two
texts that share `span` words in a row thus share a fingerprint. Documents that share one with the benchmark are extended: all
their windows meet the benchmark's in an equi-join on hash and text, so a hit is exact.

An item shorter than `span` words is one window of its own length; such lengths (fewer than `span` of them) are looked up
gram by gram in the same pass, since no fingerprint is sure to be kept for them.

Defined results: a null text has no words; items without words occur nowhere; every row is judged for itself, by its id and text together, so rows that share an id
or have none keep their own hits, and repeated rows have equal ones; columns of the inputs other than id and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What parts words: ASCII but for digits and small letters.
APART = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), APART, -1), "")


def _grams(words: Column, k: int) -> Column:
    """Hashes of all k-word grams; none where there are fewer words."""
    following = lambda i: [F.get(words, i + j) for j in range(1, k)]
    return F.transform(F.slice(words, 1, F.greatest(F.size(words) - (k - 1), F.lit(0))), lambda x, i: F.xxhash64(x, *following(i)))


def fingerprints(words: Column, span: int, k: int) -> Column:
    """The smallest hash of each run of span - k + 1 grams of k words; none where there are fewer than `span` words."""
    width = span - k + 1

    def least(grams: Column) -> Column:
        return F.transform(F.slice(grams, 1, F.greatest(F.size(grams) - (width - 1), F.lit(0))), lambda x, i: F.least(x, *(F.get(grams, i + j) for j in range(1, width))))

    return F.get(F.transform(F.array(_grams(words, k)), least), F.lit(0))


def prints(worded: DataFrame, span: int, k: int, short: list[int]) -> DataFrame:
    """(id, print) of worded (id, words): fingerprints, and all grams of the `short` lengths; each once for a row. One pass over the words."""
    every = F.concat(fingerprints(F.col("words"), span, k), *(_grams(F.col("words"), n) for n in short))
    return worded.select("id", F.explode(F.array_distinct(every)).alias("print"))


def _windows(worded: DataFrame, n: int) -> DataFrame:
    """(id, pos, len, window): every run of n words."""
    at = F.transform(F.sequence(F.lit(1), F.size("words") - (n - 1)), lambda i: F.struct(i.cast("int").alias("pos"), F.array_join(F.slice("words", i, n), " ").alias("window")))
    return worded.where(F.size("words") >= n).select("id", F.explode(at).alias("x")).select("id", "x.pos", F.lit(n).alias("len"), "x.window")


def _row_key(doc_id: Column, text: Column) -> Column:
    """What rows with the same id and text share: a digest of both, never null."""
    return F.unhex(F.md5(F.concat(F.coalesce(F.concat(F.lit("i"), doc_id.cast("string")), F.lit("n")), F.lit("\n"), F.coalesce(text, F.lit("")))))


def contaminated(docs: DataFrame, benchmark: DataFrame, span: int = 10, k: int = 6) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) for every row of docs (doc_id, text); benchmark: item_id, text."""
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).withColumn("id", _row_key(F.col("doc_id"), F.col("text")))
    worded = texts.select("doc_id", "id", words_of(F.col("text")).alias("words"))
    items = benchmark.select(F.col("item_id").alias("id"), words_of(F.col("text").cast("string")).alias("words")).where(F.size("words") > 0)
    # at most span - 1 lengths, whatever the number of items
    short = sorted(r[0] for r in items.where(F.size("words") < span).select(F.size("words")).distinct().collect())

    sought_prints = prints(items.where(F.size("words") >= span), span, k, [])
    for n in short:
        sought_prints = sought_prints.unionByName(items.where(F.size("words") == n).select("id", F.explode(_grams(F.col("words"), n)).alias("print")))
    suspects = prints(worded, span, k, short).join(sought_prints.select("print").distinct(), "print", "left_semi").select("id")
    near = texts.join(suspects.distinct(), "id", "left_semi").select("id", words_of(F.col("text")).alias("words"))

    sought = _windows(items, span)
    found = _windows(near, span)
    for n in short:
        sought = sought.unionByName(_windows(items.where(F.size("words") == n), n))
        found = found.unionByName(_windows(near, n))
    sought = sought.select(F.col("id").alias("item_id"), "len", "window").distinct()
    hits = found.join(sought.select("len", "window").distinct(), ["len", "window"]).select("id", "pos", "len", "window")

    before = Window.partitionBy("id").orderBy("pos", "len").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("pos") + F.col("len")
    fresh = F.greatest(end - F.greatest(F.coalesce(F.max(end).over(before), F.lit(0)), F.col("pos")), F.lit(0))
    covered = hits.select("id", "pos", "len").distinct().withColumn("fresh", fresh).groupBy("id").agg(F.sum("fresh").alias("n_hit"))
    of = hits.select("id", "len", "window").distinct().join(sought, ["len", "window"]).select("id", F.col("item_id").cast("string").alias("item_id")).distinct()
    named = of.groupBy("id").agg(F.count("*").alias("n_items"), F.array_join(F.sort_array(F.collect_list("item_id")), ",").alias("names"))
    out = worded.select("doc_id", "id", F.size("words").cast("bigint").alias("n_words")).join(covered.join(named, "id"), "id", "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("bigint")
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("bigint").alias("n_items"), F.sha2(F.coalesce("names", F.lit("")), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))
