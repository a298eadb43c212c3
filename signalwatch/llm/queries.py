"""The registered queries of this package: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import quality, toxicity
from .byte_bpe import decoded, encoded
from .decontamination import LOWER, UPPER, contaminated
from .embedding_dedup import near_vectors
from .hard_negatives import hard_negatives
from .language_id import identified, page_language, page_text
from .minhash_dedup import near_duplicates
from .packing import packed
from .shared import keep, scratch
from .spelling_variants import variants
from .substring_dedup import repeated_passages
from .token_counts import commit, counted, deletes, inserts, revisions, totals
from .url_filter import host_of, judged

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), shingle=3, per_cent=85)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after four batches of inserts, one sent twice, a batch of deletes (documents labelled low quality) and one
    of revisions (documents with long numbers, which are masked)."""
    docs, path, version = _table(spark, sf_dir, "documents"), word_tokenizer(), "word_bpe_49k"
    table = f"{scratch(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    numbers = F.coalesce(F.col("text").rlike(r"\d{6}"), F.lit(False))
    old = F.struct(F.lit(False).alias("new"), F.col("text"))
    new = F.struct(F.lit(True).alias("new"), F.regexp_replace("text", r"\d{6,}", "0").alias("text"))
    both = docs.select("doc_id", "source", "lang", numbers.alias("numbers"), F.explode(F.when(numbers, F.array(old, new)).otherwise(F.array(old))).alias("t"))
    counts = keep(counted(both.select("doc_id", "source", "lang", "numbers", "t.new", "t.text"), path, version, ("numbers", "new")))
    stored = counts.where("not new")
    for batch in (0, 1, 2, 3, 0):
        commit(inserts(stored.where(F.pmod(F.hash("doc_id"), F.lit(4)) == batch)), table, batch)
    low = _table(spark, sf_dir, "labels").where("quality = 0").select("doc_id").distinct()
    commit(deletes(stored.join(low, "doc_id", "left_semi")), table, 4)
    rest = counts.where("numbers").join(low, "doc_id", "left_anti")
    commit(revisions(rest.where("not new"), rest.where("new")), table, 5)
    return totals(spark, table)


#: (host, path, verdict)
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return judged(_table(spark, sf_dir, "pages"), rules)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document (declared: its lang; host: its source) and every page (declared: its markup; suffix and host: its URL's)."""
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").cast("bigint"), F.lit(None).cast("bigint").alias("page_id"), F.col("lang").alias("declared"), F.lit(None).cast("string").alias("suffix"), F.col("source").alias("host"), "text")
    host = host_of(F.col("url"))
    pages = _table(spark, sf_dir, "pages").select(F.lit(None).cast("bigint").alias("doc_id"), F.col("page_id").cast("bigint"), page_language(F.col("html")).alias("declared"), F.substring_index(host, ".", -1).alias("suffix"), host.alias("host"), page_text(F.col("html")).alias("text"))
    return identified(docs.unionByName(pages))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(_table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(_table(spark, sf_dir, "documents"), word_tokenizer(), end_id=1, most=2048, with_ids=False)


def _judged(scores: DataFrame, parts: int, held: int) -> DataFrame:
    part = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(parts)) == held, F.lit(False))
    return scores.select("doc_id", part.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def _to_learn(labels: DataFrame, parts: int, held: int) -> DataFrame:
    return labels.where(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(parts)) != held)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    lexicon, curve = toxicity.learned(toxicity.sampled(docs, _to_learn(_table(spark, sf_dir, "labels"), 4, 2), "toxic"))
    return _judged(toxicity.scored(docs, lexicon, curve), 4, 2)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    vectors, share = quality.word_vectors(docs)
    model = quality.trained(toxicity.sampled(docs, _to_learn(_table(spark, sf_dir, "labels"), 5, 0), "quality", quality.SAMPLE), "quality", vectors, share)
    return _judged(quality.scored(docs, model, vectors, share), 5, 0)


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(_table(spark, sf_dir, "embeddings"), least=0.93)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, vec_id = _table(spark, sf_dir, "embeddings"), F.col("vec_id").cast("bigint")
    label = F.when(vec_id % 7 == 0, (F.col("label").cast("bigint") + 1) % 10).otherwise(F.col("label").cast("bigint"))
    return hard_negatives(rows.select(vec_id.alias("vec_id"), label.alias("label"), "embedding"), F.col("vec_id") % 100 == 0)


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(_table(spark, sf_dir, "documents"))


def rank_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = decoded(encoded(_table(spark, sf_dir, "documents"), rank_file()), rank_file())
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES: dict[str, Query] = {
    "op1_minhash_dedup": op1_minhash_dedup,
    "op2_token_counts": op2_token_counts,
    "op3_url_filter": op3_url_filter,
    "op4_language_id": op4_language_id,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_packing": op6_packing,
    "op7_toxicity": op7_toxicity,
    "op8_decontamination": op8_decontamination,
    "op9_quality": op9_quality,
    "op10_embedding_dedup": op10_embedding_dedup,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_byte_bpe": op13_byte_bpe,
}

_RULES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)
_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLES: dict[str, str] = {
    "op3_url_filter": f"""
        WITH after AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
        parts AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*(/[^?#]*)', 1) AS path FROM after),
        rules(rh, rp, rv) AS (VALUES {_RULES}),
        fit AS (SELECT p.*, rh || rp AS r, rv, count(rh) OVER (PARTITION BY page_id) AS n_rules,
                       row_number() OVER (PARTITION BY page_id ORDER BY length(rh || rp) DESC NULLS LAST) AS k
                FROM parts p LEFT JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
        SELECT page_id, host, path, r AS rule, coalesce(rv, 'allow') AS verdict, n_rules FROM fit WHERE k = 1""",
    "op8_decontamination": f"""
        WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
        b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
        sought AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[p : p + least(len(w), 10) - 1], ' ') AS g
                   FROM (SELECT *, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS p FROM b WHERE len(w) > 0)),
        sizes AS (SELECT DISTINCT n FROM sought),
        runs AS (SELECT doc_id, n, p, array_to_string(w[p : p + n - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS p FROM d, sizes WHERE len(w) >= n)),
        hits AS (SELECT doc_id, p, n, g FROM runs SEMI JOIN (SELECT DISTINCT n, g FROM sought) USING (n, g)),
        covered AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hits) GROUP BY 1),
        items AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS names
                  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hits JOIN sought USING (n, g)) GROUP BY 1)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op11_hard_negatives": """
        WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                          list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
                   WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        pairs AS MATERIALIZED (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
                  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
        liked AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM pairs WHERE same
                  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
        SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, other AS negative_id, positive_score, score AS negative_score
        FROM liked JOIN pairs USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
        WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other)
        QUALIFY row_number() OVER w <= 5""",
}
