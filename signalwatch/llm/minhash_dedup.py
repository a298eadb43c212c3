"""Near-duplicate documents by tensored MinHash banding, with every link confirmed on full shingle sets.

Two collections of m half keys of r minhashes each are computed, 2*m*r minhashes in all; every pair of a half key of the
one and a half key of the other is a table key of 2*r minhashes, m*m tables. A pair at the threshold shares no key with
probability at most `miss` a side.

Links are exact on what the tables propose, and no group is ever paired out:

1. Documents with equal sets become one class.
2. Halves that no other class has are in no shared key, so only pairs of shared halves become table keys.
3. In every table bucket the class with most copies leads; each member is checked against its leader. Copies of one text
   thus cost a number of checks in proportion to their number.
4. Where the buckets of a leader still span several components, its members outside the largest one are checked against all others, in
   blocks of bounded size; a member counts once for its leader, in however many buckets they meet. Each check of step 3 leaves a bit for every shingle of the leader; the bits that two members share,
   and the shingles beyond the leader's that others have too, bound their intersection from above. Pairs that pass go to the full sets.
5. Components are contracted by joins. Sums by key are written before they are joined, so adaptive execution can split a hot key.

Defined results: null or empty text has an empty set and links with nothing; fewer words than a shingle make one shingle of the
whole sequence; repeated rows are copies; rows that share a doc_id but not the text are documents of their own, each in its own component,
which the smallest doc_id in it names; a null doc_id never names a component. Other columns of the input are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import among, components, keep
from .textbytes import chunks, mix, shingle_sets

_U = np.uint64
#: Rows, and bytes of their bits, that a block of step 4 has at most: bounds the memory of a task.
BLOCK, BLOCK_BYTES = 512, 1 << 20


def half_keys(threshold: float, rows: int = 3, miss: float = 2e-4) -> int:
    """How many half keys of `rows` minhashes a collection needs."""
    return max(1, math.ceil(math.log(miss) / math.log1p(-(threshold**rows))))


def _seeds(n: int) -> tuple[np.ndarray, np.ndarray]:
    x = mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))
    return x[:n], x[n:] | _U(1)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _digests(sets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """[2, row]: a 128-bit digest of each set; sets come one after another, `at` their edges."""
    out = np.zeros((2, len(at) - 1), np.uint64)
    some = np.flatnonzero(np.diff(at))
    if len(some):
        starts = at[:-1][some]
        out[0, some], out[1, some] = np.add.reduceat(mix(sets ^ _U(0x51ED270B)), starts), np.add.reduceat(mix(sets + _U(0x2545F4914F6CDD1D)), starts)
    return out


def signatures(docs: DataFrame, shingle: int, m: int, rows: int) -> DataFrame:
    """(doc_id, row, n_shingles, d0, d1, halves): size and 128-bit digest of the set, half keys; row is carried along."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        xor, times = _seeds(2 * m * rows)
        for batch in batches:
            for first, end, offsets, data in chunks(batch.column(2)):
                sets, at = shingle_sets(offsets, data, shingle)
                size, digest = np.diff(at), _digests(sets, at)
                some = np.flatnonzero(size)
                low = np.zeros((len(size), 2 * m * rows), np.uint64)
                for j in range(2 * m * rows if len(some) else 0):
                    low[some, j] = np.minimum.reduceat((sets ^ xor[j]) * times[j], at[:-1][some])
                half = np.tile(np.arange(2 * m, dtype=np.uint64), (len(size), 1))
                for j in range(rows):
                    half = mix(half * _U(0x9FB21C651E98DF25) + low[:, j::rows])
                n = end - first
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(first, n), batch.column(1).slice(first, n), pa.array(size.astype(np.int64)), _signed(digest[0]), _signed(digest[1]),
                    pa.ListArray.from_arrays(pa.array(np.arange(0, n + 1, dtype=np.int32) * 2 * m), _signed(half.ravel())),
                ], ["doc_id", "row", "n_shingles", "d0", "d1", "halves"])

    return docs.select("doc_id", "row", "text").mapInArrow(run, "doc_id bigint, row bigint, n_shingles bigint, d0 bigint, d1 bigint, halves array<bigint>")


def full_sets(docs: DataFrame, shingle: int) -> DataFrame:
    """(d0, d1, shingles): the whole set of each document, as sorted 64-bit hashes, and its digest."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, offsets, data in chunks(batch.column(0)):
                sets, at = shingle_sets(offsets, data, shingle)
                digest = _digests(sets, at)
                yield pa.RecordBatch.from_arrays([_signed(digest[0]), _signed(digest[1]), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), _signed(sets))], ["d0", "d1", "shingles"])

    return docs.select("text").mapInArrow(run, "d0 bigint, d1 bigint, shingles array<bigint>")


def table_keys(first: str = "first", second: str = "second"):
    """The table keys of a row: every first half with every second half. A half tells its place, so a key tells its table."""
    return F.flatten(F.transform(first, lambda a: F.transform(second, lambda b: F.xxhash64(a, b))))


def met_halves(classes: DataFrame, m: int) -> DataFrame:
    """(rep, first, second): the half keys of a class that other classes have too, for classes with some of either collection.

    A table key is shared only where both its halves are, so 2*m rows a class go through a shuffle here in place of m*m,
    and only the pairs of shared halves make table keys.
    """
    placed = classes.select("rep", F.posexplode("halves").alias("pos", "half"))
    shared = keep(placed.groupBy("half").agg(F.count("*").alias("n")).where("n > 1").select("half"))
    halves = placed.join(shared, "half").groupBy("rep").agg(*(F.collect_list(F.when(own, F.col("half"))).alias(name) for own, name in ((F.col("pos") < m, "first"), (F.col("pos") >= m, "second"))))
    return halves.where((F.size("first") > 0) & (F.size("second") > 0))


def confirmed(pairs: DataFrame, sets: DataFrame, per_cent: int) -> DataFrame:
    """Of pairs (a, b) of classes, those with 100 * intersection >= per_cent * union of full sets."""
    left, right = (sets.select(F.col("rep").alias(x), F.col("shingles").alias(f"{x}s")) for x in "ab")
    both = F.size(F.array_intersect("as", "bs"))
    return pairs.join(left, "a").join(right, "b").where(100 * both >= per_cent * (F.size("as") + F.size("bs") - both)).select("a", "b")


def _led(star: DataFrame, sets: DataFrame, per_cent: int) -> DataFrame:
    """(rep, leader, shared, linked, bits): each member against its leader; a bit for each shingle of the leader, in order."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, lead = ((c.flatten().to_numpy(), np.concatenate(([0], np.cumsum(c.value_lengths().to_numpy())))) for c in (batch.column(2), batch.column(3)))
            shared, linked, bits = [], [], []
            for k in range(batch.num_rows):
                x, y = own[0][own[1][k] : own[1][k + 1]], lead[0][lead[1][k] : lead[1][k + 1]]
                has = np.isin(y, x, assume_unique=True)
                n = int(has.sum())
                shared.append(n), linked.append(100 * n >= per_cent * (len(x) + len(y) - n)), bits.append(np.packbits(has).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(shared, pa.int32()), pa.array(linked, pa.bool_()), pa.array(bits, pa.binary())], ["rep", "leader", "shared", "linked", "bits"])

    # leaders are few, so their sets go to the pairs first; then pairs and members meet
    leaders = among(sets, "rep", star.select("leader")).select(F.col("rep").alias("leader"), F.col("shingles").alias("lead"))
    full = star.join(leaders, "leader").join(sets.withColumnRenamed("shingles", "own"), "rep")
    return full.select("rep", "leader", "own", "lead").mapInArrow(run, "rep bigint, leader bigint, shared int, linked boolean, bits binary")


def _rest(tasks: DataFrame, per_cent: int) -> DataFrame:
    """Pairs of blocks that may link: (a, b). tasks: few, many; their rows have bits for the same leader."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: set[tuple[int, int]] = set()
            for at in range(batch.num_rows):
                xs, ys = batch.column("few")[at].as_py(), batch.column("many")[at].as_py()
                a, b = (np.frombuffer(b"".join(r["bits"] for r in rows), np.uint8).reshape(len(rows), -1) for rows in (xs, ys))
                size, of, ids, beyond = (np.array([y[k] for y in ys]) for k in ("n_shingles", "component", "rep", "beyond"))
                for k, x in enumerate(xs):
                    most = np.bitwise_count(b & a[k]).sum(1, dtype=np.int64) + np.minimum(beyond, x["beyond"])
                    fit = (of != x["component"]) & (100 * most >= per_cent * (size + x["n_shingles"] - most))
                    found.update((min(x["rep"], y), max(x["rep"], y)) for y in ids[fit].tolist())
            pairs = sorted(found)
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in pairs], pa.int64()), pa.array([x[1] for x in pairs], pa.int64())], ["a", "b"])

    return tasks.mapInArrow(run, "a bigint, b bigint").distinct()


def near_duplicates(docs: DataFrame, shingle: int = 5, per_cent: int = 80, rows: int = 3, miss: float = 2e-4) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs (doc_id integer, text)."""
    return grouped(docs.withColumn("row", F.lit(0).cast("bigint")), shingle, per_cent, rows, miss).drop("row", "component")


def grouped(docs: DataFrame, shingle: int, per_cent: int, rows: int = 3, miss: float = 2e-4) -> DataFrame:
    """(doc_id, row, n_shingles, component_id, kept, component) for every row of docs (doc_id, text, row: any number that is
    carried along). component tells groups apart even where their smallest doc_ids are equal; null for an empty set."""
    m = half_keys(per_cent / 100, rows, miss)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("row").cast("bigint").alias("row"), F.col("text").cast("string").alias("text"))
    signed = keep(signatures(docs, shingle, m, rows))
    digest = ["d0", "d1", "n_shingles"]
    same = signed.where("n_shingles > 0 and doc_id is not null").groupBy(*digest).agg(F.min("doc_id").alias("least_id"), F.count("*").alias("copies"), F.first("halves").alias("halves"))
    # written before use, so the number of a class stays what it is
    classes = keep(same.withColumn("rep", F.monotonically_increasing_id()))
    about = classes.drop("halves")

    placed = met_halves(classes, m).join(about.select("rep", "copies", "n_shingles"), "rep").select("rep", "copies", "n_shingles", F.explode(table_keys()).alias("key"))
    placed = keep(placed)
    led = keep(placed.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct(-F.col("copies"), "rep", "n_shingles")).alias("lead")).where("n > 1").select("key", F.col("lead.rep").alias("leader"), F.col("lead.n_shingles").alias("leader_size")))
    members = keep(placed.join(led, "key").select("key", "rep", "leader", "n_shingles", "leader_size"))
    wanted = keep(members.select("rep").distinct().join(about, "rep").select("rep", "d0", "d1", "least_id"))
    # whole texts aren't shuffled: sets are made where texts lie, and the digest says which are meant
    found = full_sets(among(docs, "doc_id", wanted.select("least_id")), shingle)
    sets = keep(found.join(wanted.select("rep", "d0", "d1"), ["d0", "d1"]).dropDuplicates(["d0", "d1"]).select("rep", "shingles"))
    pairs = keep(members.where("rep <> leader").select("rep", "leader", "n_shingles", "leader_size").distinct())
    star = keep(_led(pairs.select("rep", "leader"), sets, per_cent))
    links = star.where("linked").select(F.col("rep").alias("a"), F.col("leader").alias("b"))
    rest = _beyond_leaders(pairs, star, sets, links, per_cent)
    final = components(links if rest is None else links.unionByName(rest))

    named = about.join(final.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    named = keep(named.select(*digest, "component", "least_id"))
    least = keep(named.groupBy("component").agg(F.min("least_id").alias("component_id")))
    out = signed.select("doc_id", "row", *digest).join(named.join(least, "component").drop("least_id"), digest, "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "row", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"), "component")


def _present(waiting: DataFrame) -> DataFrame:
    """(rep): members and leaders of waiting, each once. A class may wait with many leaders, so its rows are made one on each side before the two are put together."""
    return waiting.select("rep").distinct().unionByName(waiting.select(F.col("leader").alias("rep")).distinct()).distinct()


def _beyond_leaders(pairs: DataFrame, star: DataFrame, sets: DataFrame, links: DataFrame, per_cent: int) -> DataFrame | None:
    """Links (a, b) between members of buckets that their leaders leave in several components; None where there are none.

    pairs: rep, leader, n_shingles, leader_size, each pair once. All buckets of a leader are looked at as one, so rows are as many as pairs, not as places in up to
    m*m buckets; members that share a bucket share its leader, so none of their pairs is lost.
    """
    first = keep(components(links))
    labelled = keep(pairs.join(first.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep")))
    shares = labelled.groupBy("leader", "component").agg(F.count("*").alias("n"))
    split = shares.groupBy("leader").agg(F.max(F.struct("n", "component")).alias("top"), F.sum("n").alias("total"), F.count("*").alias("k")).where("k > 1")
    split = keep(split.select("leader", F.col("top.component").alias("top"), "total"))
    waiting = keep(labelled.join(split, "leader"))
    if not waiting.limit(1).count():
        return None
    # shingles that one class alone has are in no intersection; with the leaders among the classes, the others beyond a leader's are known
    counted = sets.join(_present(waiting), "rep", "left_semi").select("rep", F.explode("shingles").alias("s")).groupBy("s").agg(F.count("*").alias("n"), F.min("rep").alias("rep"))
    alone = counted.where("n = 1").groupBy("rep").agg(F.count("*").alias("alone"))
    a_block = F.greatest(F.lit(1), F.least(F.lit(BLOCK), F.floor(F.lit(8 * BLOCK_BYTES) / F.greatest(F.col("leader_size"), F.lit(1)))))
    beyond = (F.col("n_shingles") - F.coalesce("alone", F.lit(0)) - F.col("shared")).alias("beyond")
    marked = star.join(alone, "rep", "left").select("rep", "leader", "shared", "bits", "alone")
    spread = waiting.join(marked, ["rep", "leader"]).withColumn("blocks", F.ceil(F.col("total") / a_block).cast("int")).withColumn("block", F.pmod(F.xxhash64("rep", "leader"), F.col("blocks")).cast("int"))
    row = F.struct("rep", "component", "n_shingles", beyond, "bits")
    few = spread.where("component <> top").groupBy("leader", F.col("block").alias("s"), "blocks").agg(F.collect_list(row).alias("few"))
    many = spread.groupBy("leader", F.col("block").alias("t")).agg(F.collect_list(row).alias("many"))
    tasks = few.withColumn("t", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).join(many, ["leader", "t"]).select("few", "many")
    return confirmed(keep(_rest(tasks, per_cent)), sets, per_cent)
