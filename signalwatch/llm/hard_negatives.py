"""Hard negatives by an inverted multi-index: exact ranked lists, found through cells that are visited in the order of a score bound.

Each half of a vector has a codebook of its own, fitted on a bounded sample; a vector's two nearest codewords are its cell, and every row is in one. An
anchor's inner product with a row is at most the sum of two half scores: with the row's codeword, plus the anchor's norm times the largest
distance of any row from that codeword. Such bounds add up, so a heap over two sorted lists gives the cells by falling bound. An anchor
visits cells until its list is certain: its last place scores above every bound still to come, or all that can come lies below the window it looks for.

First the anchors' positives are found so (the window is everything), then the negatives of each, whose scores lie in a window below the
positive's. Visits go in rounds, each with four times the rows of the one before; an anchor that is certain is done. Rows lie in bounded
pieces by first codeword and are met by blocks of anchors, so neither a frequent vector nor a full cell is one task. A task returns the
best few of each list.

Defined results: rows with a null id, label or vector, a null or non-finite component, or one of 2**26 or more once scaled take no part; where
lengths differ, missing components count as 0; repeated rows count each for themselves (ties go by id and then by an internal number); other columns are
ignored; with fewer rows than asked for, lists are shorter.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import keep

#: Codewords of a half, and rows they are fitted on at most.
CODEWORDS, SAMPLE = 16, 8192
#: Rows of a piece, anchors of a block, and rows that an anchor's first round is about.
PIECE, BLOCK, FIRST = 4096, 128, 4096
#: What a scaled component stays below, so that scores are exact in a long.
LARGEST = 1 << 26

Codes = tuple[np.ndarray, np.ndarray]


def vectors_of(rows: DataFrame, scale: int) -> DataFrame:
    """(row, vec_id, label, vector): usable rows under an internal number; vector: little-endian 32-bit floor(scale * component)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for v in batch.column(2).to_pylist():
                x = np.floor(scale * np.array(v, float)) if v is not None and None not in v else np.array([np.nan])
                out.append(x.astype("<i4").tobytes() if np.isfinite(x).all() and (np.abs(x) < LARGEST).all() else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], ["vec_id", "label", "vector"])

    plain = rows.where("vec_id is not null and label is not null").select(F.col("vec_id").cast("bigint"), F.col("label").cast("bigint"), F.col("embedding").cast("array<double>"))
    return plain.mapInArrow(run, "vec_id bigint, label bigint, vector binary").where("vector is not null").withColumn("row", F.monotonically_increasing_id())


def _matrix(vectors: pa.Array | list, width: int) -> np.ndarray:
    raw = vectors.to_pylist() if isinstance(vectors, pa.Array) else vectors
    if all(len(x) == 4 * width for x in raw):
        return np.frombuffer(b"".join(raw), "<i4").reshape(len(raw), width).astype(float)
    return np.array([np.pad(np.frombuffer(x, "<i4"), (0, width - len(x) // 4)) for x in raw], float).reshape(len(raw), width)


def codebook(points: np.ndarray, size: int, rounds: int = 12) -> np.ndarray:
    """k-means; each start is drawn in proportion to its squared distance from those before. Results need no good fit, only a fixed one."""
    rng = np.random.default_rng(11)
    centres, apart = points[:1], np.full(len(points), np.inf)
    while len(centres) < min(size, len(points)):
        apart = np.minimum(apart, ((points - centres[-1]) ** 2).sum(1))
        if not apart.sum():
            break
        centres = np.concatenate((centres, points[rng.choice(len(points), p=apart / apart.sum())][None]))
    for _ in range(rounds):
        near = _nearest(points, centres)
        count = np.bincount(near, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, near, points)
        centres = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centres)
    return centres


def _nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres * centres).sum(1)[None] - 2 * points @ centres.T, 1)


def fitted(rows: DataFrame, width: int, codewords: int = CODEWORDS) -> Codes:
    """A codebook for each half, from at most SAMPLE rows (those of least hash)."""
    sample = rows.select("vector").orderBy(F.xxhash64("row"), "row").limit(SAMPLE).toArrow()["vector"].combine_chunks()
    points = _matrix(sample, width)
    half = width // 2
    return codebook(points[:, :half], codewords), codebook(points[:, half:], codewords)


def assigned(rows: DataFrame, codes: Codes, width: int) -> DataFrame:
    """rows with first, second (codewords), and how far the row is from each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(3), width)
            near, far = [], []
            for points, centres in zip((x[:, : width // 2], x[:, width // 2 :]), codes, strict=True):
                near.append(_nearest(points, centres))
                far.append(np.sqrt(((points - centres[near[-1]]) ** 2).sum(1)))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(n.astype(np.int32)) for n in near), *map(pa.array, far)], ["row", "vec_id", "label", "vector", "first", "second", "far1", "far2"])

    return rows.select("row", "vec_id", "label", "vector").mapInArrow(run, "row bigint, vec_id bigint, label bigint, vector binary, first int, second int, far1 double, far2 double")


def cells_by_bound(one: np.ndarray, two: np.ndarray) -> Iterator[tuple[float, int, int]]:
    """(bound, i, j) for all pairs, by falling one[i] + two[j]: a heap over the two sorted lists."""
    a, b = np.argsort(-one, kind="stable"), np.argsort(-two, kind="stable")
    heap = [(-(one[a[0]] + two[b[0]]), 0, 0)]
    while heap:
        bound, i, j = heapq.heappop(heap)
        yield -bound, int(a[i]), int(b[j])
        if j + 1 < len(b):
            heapq.heappush(heap, (-(one[a[i]] + two[b[j + 1]]), i, j + 1))
        if j == 0 and i + 1 < len(a):
            heapq.heappush(heap, (-(one[a[i + 1]] + two[b[0]]), i + 1, 0))


class Index:
    """Codebooks, the radius of each codeword and the rows of each cell: 2 * CODEWORDS radii and CODEWORDS ** 2 counts, whatever the rows."""

    def __init__(self, codes: Codes, cells: list):
        self.codes, self.radii, self.count = codes, tuple(np.zeros(len(c)) for c in codes), {}
        for c in cells:
            self.count[c["first"], c["second"]] = c["n"]
            for radius, at, far in ((self.radii[0], c["first"], c["far1"]), (self.radii[1], c["second"], c["far2"])):
                radius[at] = max(radius[at], far)

    def bounds(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each codeword of a half the most that a row with it scores, with room for rounding."""
        half = len(x) // 2
        return tuple(c @ p + np.sqrt(p @ p) * r + 1e-6 * (1 + np.abs(c) @ np.abs(p) + np.sqrt(p @ p) * r) for c, p, r in zip(self.codes, (x[:half], x[half:]), self.radii, strict=True))

    def visits(self, x: np.ndarray, seen: int, rows: int, least: float) -> tuple[dict[int, list[int]], int, float]:
        """The next cells of an anchor that has popped `seen`: {first: [second]} of about `rows` rows with bounds of `least` or more, how many it has popped then, and the bound of what remains (minus infinity: nothing)."""
        out: dict[int, list[int]] = {}
        popped, got = 0, 0
        for bound, i, j in cells_by_bound(*self.bounds(x)):
            if bound < least:
                return out, popped, -np.inf
            if popped >= seen and (n := self.count.get((i, j))):  # a cell without rows holds nothing up
                if got >= rows:
                    return out, popped, bound
                out.setdefault(i, []).append(j)
                got += n
            popped += 1
        return out, popped, -np.inf


#: A list to fill: the anchor's `top` rows scoring from `low` to `high`, of its label or of others.
WANTED = "array<struct<list:int, low:bigint, high:bigint, own:boolean>>"
FOUND = "row bigint, list int, score bigint, vec_id bigint, other bigint"


def _visiting(anchors: DataFrame, index: Index, width: int, rows: int) -> DataFrame:
    """anchors (row, vec_id, label, vector, wanted, seen, least) with what they visit next: cells array<struct<first, seconds>>, seen, rest."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1), width)
            got = [index.visits(v, s, rows, b) for v, s, b in zip(x, batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            cells = pa.array([[{"first": i, "seconds": js} for i, js in sorted(g[0].items())] for g in got], pa.list_(pa.struct([("first", pa.int32()), ("seconds", pa.list_(pa.int32()))])))
            yield pa.RecordBatch.from_arrays([batch.column(0), cells, pa.array([g[1] for g in got], pa.int64()), pa.array([g[2] for g in got], pa.float64())], ["row", "cells", "seen", "rest"])

    return anchors.select("row", "vector", "seen", "least").mapInArrow(run, "row bigint, cells array<struct<first:int, seconds:array<int>>>, seen bigint, rest double")


def _scanned(tasks: DataFrame, width: int, top: int) -> DataFrame:
    """(row, list, score, vec_id, other): the best of every list in a task (anchors, members), members by second codeword."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                a, b = batch.column(0)[at].values, batch.column(1)[at].values
                second = b.field("second").to_numpy()
                order = np.argsort(second, kind="stable")
                edges = np.searchsorted(second[order], np.arange(second.max() + 2))
                rows, ids, labels = (b.field(c).to_numpy()[order] for c in ("row", "vec_id", "label"))
                x, y = _matrix(a.field("vector"), width), _matrix(b.field("vector"), width)[order]
                # no partial sum exceeds the product of norms; beyond what doubles hold, whole numbers are multiplied
                exact = np.sqrt((x * x).sum(1).max() * (y * y).sum(1).max()) < 1 << 52
                scores = (x @ y.T).astype(np.int64) if exact else x.astype(np.int64) @ y.T.astype(np.int64)
                found: list[tuple[int, int, int, int, int]] = []
                for k, (row, label, seconds, wanted) in enumerate(zip(*(a.field(c).to_pylist() for c in ("row", "label", "seconds", "wanted")), strict=True)):
                    visited = np.concatenate([np.arange(edges[j], edges[j + 1]) for j in seconds if j + 1 < len(edges)] or [np.zeros(0, int)])
                    visited = visited[rows[visited] != row]
                    score, own = scores[k, visited], labels[visited] == label
                    for w in wanted:
                        some = np.flatnonzero((own == w["own"]) & (score >= w["low"]) & (score <= w["high"]))
                        if len(some) > top:
                            last = -np.partition(-score[some], top - 1)[top - 1]
                            some = some[score[some] >= last]
                        some = some[np.lexsort((rows[visited[some]], ids[visited[some]], -score[some]))[:top]]
                        found.extend((row, w["list"], int(score[s]), int(ids[visited[s]]), int(rows[visited[s]])) for s in some)
                if found:
                    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), kinds, strict=True)], ["row", "list", "score", "vec_id", "other"])

    return tasks.select("anchors", "members").mapInArrow(run, FOUND)


def _best(found: DataFrame, top: int) -> DataFrame:
    """The first `top` of each list under their rank; those of a partition are cut before they are shuffled."""
    order = Window.partitionBy("row", "list").orderBy(F.col("score").desc(), "vec_id", "other")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def ranked_lists(anchors: DataFrame, pieces: DataFrame, index: Index, width: int, top: int, first: int = FIRST) -> DataFrame:
    """(row, list, score, vec_id, other, rank) for anchors (row, label, vector, wanted): each wanted list's first `top` rows of all, in rounds until every list is certain."""
    floor = F.array_min(F.transform("wanted", lambda w: w.low)).cast("double")
    active = keep(anchors.select("row", "label", "vector", "wanted", F.lit(0).cast("bigint").alias("seen"), floor.alias("least")))
    found = None
    while True:
        visits = keep(_visiting(active, index, width, first))
        cell = visits.select("row", F.explode("cells").alias("c")).select("row", "c.first", "c.seconds")
        block = F.pmod(F.xxhash64("row"), F.lit(max(1, -(-active.count() // BLOCK)))).cast("int")
        met = cell.join(active.select("row", "label", "vector", "wanted"), "row")
        blocks = met.groupBy("first", block.alias("block")).agg(F.collect_list(F.struct("row", "label", "vector", "seconds", "wanted")).alias("anchors"))
        new = _scanned(blocks.join(pieces, "first"), width, top)
        found = keep(_best(new if found is None else new.unionByName(found.drop("rank")), top))
        # a list is certain if it is full and scores above all bounds to come; an anchor must go on down to the lowest place of the others
        asked = active.select("row", F.explode("wanted").alias("w")).select("row", "w.list", "w.low")
        last = found.where(F.col("rank") == top).select("row", "list", F.col("score").alias("last"))
        need = asked.join(last, ["row", "list"], "left").select("row", F.coalesce("last", "low").cast("double").alias("least")).groupBy("row").agg(F.min("least").alias("least"))
        open_ = visits.select("row", "seen", "rest").join(need, "row").where(F.col("rest") >= F.col("least"))
        active = keep(active.select("row", "label", "vector", "wanted").join(open_.select("row", "seen", "least"), "row"))
        if not active.limit(1).count():
            return found
        first *= 4


def hard_negatives(rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 5, scale: int = 256, low: int = 80, high: int = 100, codewords: int = CODEWORDS, first: int = FIRST) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) from rows (vec_id, label, embedding).

    anchor: a condition on vec_id. An anchor's positives are its `positives` best rows of the same label; the negatives of each are the best rows of other labels with
    low * positive_score <= 100 * negative_score <= high * positive_score.
    """
    known = keep(vectors_of(rows, scale))
    width = known.agg(F.coalesce(F.max(F.length("vector")), F.lit(0))).first()[0] // 4
    none = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    if not width:
        return rows.sparkSession.createDataFrame([], none)
    codes = fitted(known, width, codewords)
    placed = keep(assigned(known, codes, width))
    index = Index(codes, placed.groupBy("first", "second").agg(F.count("*").alias("n"), F.max("far1").alias("far1"), F.max("far2").alias("far2")).collect())
    sizes = placed.groupBy("first").agg(F.ceil(F.count("*") / PIECE).cast("int").alias("n"))
    piece = F.pmod(F.xxhash64("row"), F.col("n")).cast("int")
    pieces = keep(placed.join(F.broadcast(sizes), "first").groupBy("first", piece.alias("piece")).agg(F.collect_list(F.struct("row", "vec_id", "label", "second", "vector")).alias("members")))
    asking = known.where(anchor)
    wide = 1 << 62
    everything = F.array(F.struct(F.lit(0).alias("list"), F.lit(-wide).alias("low"), F.lit(wide).alias("high"), F.lit(True).alias("own"))).cast(WANTED)
    liked = ranked_lists(asking.select("row", "label", "vector", everything.alias("wanted")), pieces, index, width, positives, first)
    share = lambda k: F.lit(k).cast("decimal(9,0)") * F.col("score").cast("decimal(19,0)") / 100
    each = keep(liked.select("row", F.col("rank").alias("list"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"), F.ceil(share(low)).cast("bigint").alias("low"), F.floor(share(high)).cast("bigint").alias("high")))
    windows = each.groupBy("row").agg(F.collect_list(F.struct("list", "low", "high", F.lit(False).alias("own"))).cast(WANTED).alias("wanted"))
    disliked = ranked_lists(asking.select("row", "label", "vector").join(windows, "row"), pieces, index, width, negatives, first)
    out = disliked.join(each, ["row", "list"]).join(asking.select("row", F.col("vec_id").alias("anchor_id")), "row")
    return out.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
