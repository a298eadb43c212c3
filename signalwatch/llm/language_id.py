"""Language identification by Bayesian fusion of four kinds of evidence.

log P(language | all) = log P(language | host) + log P(text | language) + log P(declared | language) + log P(suffix | language)

- text: hashed byte trigrams, counted by declared language over all rows (grouped sums of CODES cells a language).
- declared: the language that markup or metadata states; its reliability is estimated, as is that of address suffixes,
  from the text's own posterior, by grouped sums.
- host: global shares, smoothed into those of the domain (the last two labels), smoothed into those of the host.

Only the trigram table (languages x CODES numbers) and the sums by language leave the executors; tables by host
and suffix stay tables and are joined. Every declared language is a candidate, however rare: what counts as one is a code of two or three letters.

Defined results: null or empty text, declaration, suffix or host give no evidence, nor does a declaration of another form. A row without any letter, or whose best language has less
than `least` of the probability, is `und` and not kept. Repeated rows are judged alike. Key columns keep their names and values, but for those named lang, confidence or kept, which are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import keep, modest
from .textbytes import LOWER, chunks

CODES = 1 << 14
#: A text counts for so many independent trigrams at most: its trigrams overlap and share a subject.
WEIGHT = 40.0
#: Rows of prior weight by which a host's shares lean on its domain's, and a domain's on the global ones.
LEAN = 20.0
#: Digits and marks carry no language.
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
_LETTER[128:] = True


def _codes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code of the trigram that ends at each counted byte, row): marks and digits count as space, runs of space don't count."""
    low = np.where(_LETTER[LOWER[data]], LOWER[data], 32).astype(np.uint32)
    if len(low) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code = ((low[:-2] * np.uint32(0x9E3779B1)) ^ (low[1:-1] * np.uint32(0x85EBCA77)) ^ (low[2:] * np.uint32(0xC2B2AE3D)))
    code = ((code ^ (code >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(18)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    good = (row[:-2] == row[2:]) & (low[1:-1] != 32) & ((low[:-2] != 32) | (low[2:] != 32))
    return code[good].astype(np.int64), row[2:][good]


def trigram_counts(rows: DataFrame, languages: list[str]) -> np.ndarray:
    """[language, code] counts over all rows (declared, text): partial sums in each task, then one grouped sum."""
    place = {x: i for i, x in enumerate(languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(languages), CODES), np.int64)
        for batch in batches:
            own = np.array([place.get(x, -1) for x in batch.column(0).to_pylist()])
            for first, end, offsets, data in chunks(batch.column(1)):
                code, row = _codes(data, offsets)
                lang = own[first:end][row]
                total += np.bincount((lang * CODES + code)[lang >= 0], minlength=total.size).reshape(total.shape)
        at = np.flatnonzero(total.sum(0))
        yield pa.RecordBatch.from_arrays([pa.array(at), *(pa.array(total[i][at]) for i in range(len(languages)))], ["code", *(f"n{i}" for i in range(len(languages)))])

    names = [f"n{i}" for i in range(len(languages))]
    sums = rows.select("declared", "text").mapInArrow(run, "code bigint, " + ", ".join(f"{x} bigint" for x in names)).groupBy("code").agg(*(F.sum(x).alias(x) for x in names))
    out = np.zeros((len(languages), CODES))
    for r in sums.collect():  # CODES rows at most
        out[:, r["code"]] = [r[x] for x in names]
    return out


def text_evidence(rows: DataFrame, table: np.ndarray) -> DataFrame:
    """rows without text, with text_log (array: tempered log likelihoods, 0 for the best) and trigrams."""
    kept = [c for c in rows.columns if c != "text"]
    log = np.log(table + 0.5) - np.log((table + 0.5).sum(1, keepdims=True))
    log = np.ascontiguousarray(log.T).astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(batch.schema.get_field_index("text"))
            for first, end, offsets, data in chunks(text):
                code, row = _codes(data, offsets)
                n = np.bincount(row, minlength=end - first)
                total = np.stack([np.bincount(row, log[code, i], end - first) for i in range(log.shape[1])], 1)
                total *= (np.minimum(n, WEIGHT) / np.maximum(n, 1))[:, None]
                total -= total.max(1, keepdims=True)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(end - first + 1, dtype=np.int32) * log.shape[1]), pa.array(total.ravel()))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(first, end - first) for c in kept), flat, pa.array(n.astype(np.int64))], [*kept, "text_log", "trigrams"])

    schema = rows.drop("text").withColumn("text_log", F.array().cast("array<double>")).withColumn("trigrams", F.lit(0).cast("bigint")).schema
    return rows.select(*kept, "text").mapInArrow(run, schema)


def _softmax(x: Column) -> Column:
    e = F.transform(x, lambda v: F.exp(v - F.array_max(x)))
    return F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


#: Columns that identified() adds; a key column of such a name is replaced.
RESULT = ["lang", "confidence", "kept"]


def identified(rows: DataFrame, least: float = 0.5) -> DataFrame:
    """rows (declared, suffix, host, text and any key columns) without text, with lang, confidence, kept."""
    modest(rows.sparkSession)
    keys = [c for c in rows.columns if c not in ("declared", "suffix", "host", "text", *RESULT)]
    # one struct, so that no key column can clash with what is worked out here
    key = F.struct(*(F.col(f"`{c}`") for c in keys)) if keys else F.struct(F.lit(0).alias("none"))
    back = [F.col(f"key.`{c}`") for c in keys]
    blank = lambda c: F.when(F.trim(F.col(c).cast("string")) != "", F.lower(F.trim(F.col(c).cast("string"))))
    code = F.substring_index(blank("declared"), "-", 1)
    rows = rows.select(key.alias("key"), F.when(code.rlike("^[a-z]{2,3}$"), code).alias("declared"), blank("suffix").alias("suffix"), blank("host").alias("host"), F.col("text").cast("string").alias("text"))
    # codes of two or three letters only, so there are at most 18,252 of them whatever the table says
    languages = sorted(r[0] for r in rows.where("declared is not null").select("declared").distinct().collect())
    if not languages:
        return rows.select(*back, F.lit("und").alias("lang"), F.lit(0.0).alias("confidence"), F.lit(False).alias("kept"))
    k = len(languages)
    seen = keep(text_evidence(rows, trigram_counts(rows, languages)))
    posterior = seen.withColumn("post", _softmax(F.col("text_log"))).where("trigrams > 0")
    each = [F.sum(F.get("post", F.lit(i))).alias(f"s{i}") for i in range(k)]
    cells = [f"s{i}" for i in range(k)]

    world = posterior.agg(*each).first()
    mass = [float(world[c] or 0.0) for c in cells]
    all_mass = sum(mass) or 1.0
    prior = [(x + 1.0) / (all_mass + k) for x in mass]
    base = F.array(*map(F.lit, prior))

    def evidence(column: str) -> DataFrame:
        """(column, log_column): log P(value | language), smoothed by the value's share."""
        sums = posterior.where(F.col(column).isNotNull()).groupBy(column).agg(*each)
        share = (sum(F.col(c) for c in cells) + 1.0) / (all_mass + 1.0)
        return sums.select(column, F.array(*(F.log((F.col(c) + LEAN * share) / (mass[i] + LEAN)) for i, c in enumerate(cells))).alias(f"log_{column}"))

    def leaning(sums: DataFrame, key: list[str], parent: Column, name: str) -> DataFrame:
        total = sum(F.col(c) for c in cells)
        return sums.select(*key, F.array(*((F.col(c) + LEAN * F.get(parent, F.lit(i))) / (total + LEAN) for i, c in enumerate(cells))).alias(name))

    hosts = posterior.where("host is not null").groupBy("host").agg(*each).withColumn("domain", F.substring_index("host", ".", -2))
    domains = leaning(hosts.groupBy("domain").agg(*(F.sum(c).alias(c) for c in cells)), ["domain"], base, "domain_share")
    of_host = leaning(hosts.join(domains, "domain"), ["host"], F.col("domain_share"), "host_share")
    # written before it is joined, so that adaptive execution can split a host with very many rows
    full = seen.join(evidence("declared"), "declared", "left").join(keep(evidence("suffix")), "suffix", "left").join(keep(of_host.select("host", "host_share")), "host", "left")
    none = F.array(*[F.lit(0.0)] * k)
    share = F.coalesce("host_share", base)
    total = F.array(*(F.log(F.get(share, F.lit(i))) + F.get("text_log", F.lit(i)) + F.get(F.coalesce("log_declared", none), F.lit(i)) + F.get(F.coalesce("log_suffix", none), F.lit(i)) for i in range(k)))
    scored = full.withColumn("total", total).withColumn("p", _softmax(F.col("total"))).withColumn("confidence", F.array_max("p"))
    kept = (F.col("confidence") >= least) & (F.col("trigrams") > 0)
    best = F.get(F.array(*map(F.lit, languages)), (F.array_position("p", F.col("confidence")) - 1).cast("int"))
    return scored.select(*back, F.when(kept, best).otherwise("und").alias("lang"), "confidence", kept.alias("kept"))


def page_text(html: Column) -> Column:
    """What a page shows: without scripts, styles, comments and tags."""
    return F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " "), r"(?s)<[^>]*>|&\w+;", " ")


def page_language(html: Column) -> Column:
    return F.regexp_extract(html, r"""(?i)<html\b[^>]*?\blang\s*=\s*["']?([A-Za-z-]+)""", 1)
