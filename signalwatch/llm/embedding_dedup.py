"""Near-duplicate vectors by a subspace pigeonhole join: exact links, no index.

Unit vectors are rotated (a fixed random rotation) and split into blocks of coordinates. If the squared distance of two vectors is
T at most, then in some block it is at most that block's share of T. Each block is range-joined on its own: vectors go to slabs of its first
coordinate, three times as wide as the budget's root, and those that near the next slab are guests there, so two vectors within the budget share a
slab; pairs within the block's budget are candidates. The first block in which a pair is within budget verifies it by cosine in
double precision, so the union over blocks counts every pair once.

Equal vectors of a label are one class with a count. Slabs are cut into pieces of PIECE_BYTES at most, and pairs of pieces are the
tasks, so no group is ever held whole; a slab's pieces are sent as often as it has pieces. A task returns counts of links and
a star for each component of what it linked, never its pairs; counts are added up and stars contracted.

Defined results: a null label, a null or zero vector, or one with null or non-finite components links with nothing; so do vectors of different length and
rows without a vec_id; repeated rows are copies and link with each other; rows that share a vec_id but not the vector are vectors of their own, each with its own
links, in the component that its smallest vec_id names; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import components, keep

BLOCKS = 4
#: Bytes of vectors in a piece, and rows of it that are compared at once: bound the memory of a task.
PIECE_BYTES, STRIP = 2 << 20, 512
#: Width of a slab, in roots of the block's budget.
SLAB = 3


def rotation(width: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(20).normal(size=(width, width)))
    return q * np.sign(np.diag(r))


def block_edges(width: int) -> list[tuple[int, int]]:
    at = np.linspace(0, width, min(BLOCKS, width) + 1).astype(int)
    return list(zip(at[:-1].tolist(), at[1:].tolist(), strict=True))


def budgets(width: int, least: float) -> list[float]:
    """Each block's share of the squared distance, in proportion to its coordinates, with room for rounding."""
    return [(2 - 2 * least) * (b - a) / width * (1 + 1e-9) + 1e-12 for a, b in block_edges(width)]


def _prepared(rows: DataFrame) -> DataFrame:
    """(vec_id, label, vector): the vector as bytes of doubles, null for rows that link with nothing."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, label, v in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                x = np.array(v, float) if v and None not in v else np.zeros(0)
                good = i is not None and label is not None and x.size > 0 and np.isfinite(x).all() and 0 < np.linalg.norm(x) < np.inf
                out.append(x.astype("<f8").tobytes() if good else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], ["vec_id", "label", "vector"])

    return rows.select("vec_id", "label", F.col("embedding").cast("array<double>")).mapInArrow(run, "vec_id bigint, label string, vector binary")


def _slabs(classes: DataFrame, least: float) -> DataFrame:
    """(rep, width, block, slab, guest): the slab of each class in each block, and the next one where it is a guest."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[int, int, int, int, bool]] = []
            for key, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x = np.frombuffer(raw, "<f8")
                z = rotation_of(len(x)) @ (x / np.linalg.norm(x))
                for k, ((a, _), budget) in enumerate(zip(block_edges(len(x)), budgets(len(x), least), strict=True)):
                    near = max(budget**0.5, 1e-6) * (1 + 1e-9)
                    slab = int(np.floor(z[a] / (SLAB * near)))
                    out.append((key, len(x), k, slab, False))
                    if z[a] >= (slab + 1) * SLAB * near - near - 1e-12:
                        out.append((key, len(x), k, slab + 1, True))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), *(pa.array([r[c] for r in out], pa.int32()) for c in (1, 2, 3)), pa.array([r[4] for r in out], pa.bool_())], ["rep", "width", "block", "slab", "guest"])

    return classes.select("rep", "vector").mapInArrow(run, "rep bigint, width int, block int, slab int, guest boolean")


_rotations: dict[int, np.ndarray] = {}


def rotation_of(width: int) -> np.ndarray:
    if width not in _rotations:
        _rotations[width] = rotation(width)
    return _rotations[width]


def _linked(a: np.ndarray, b: np.ndarray, block: int, least: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places in a and b (unit vectors) of the linked pairs whose first block within budget is this one, a strip of a at a time; same: pairs within a."""
    turn, parts, own = rotation_of(a.shape[1]), block_edges(a.shape[1]), budgets(a.shape[1], least)
    za, zb = a @ turn.T, b @ turn.T

    def near(k: int, rows: slice) -> np.ndarray:
        p, q = za[rows, slice(*parts[k])], zb[:, slice(*parts[k])]
        return (p * p).sum(1)[:, None] + (q * q).sum(1)[None] - 2 * p @ q.T <= own[k] + 1e-12

    for at in range(0, len(a), STRIP):
        rows = slice(at, min(at + STRIP, len(a)))
        within = near(block, rows)
        if same:
            within &= np.arange(len(b))[None] > np.arange(rows.start, rows.stop)[:, None]
        for k in range(block):
            if within.any():
                within &= ~near(k, rows)
        if within.any():
            i, j = np.nonzero(within & (a[rows] @ b.T >= least))
            yield i + at, j


def _side(members: pa.StructScalar) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(reps, copies, unit vectors) of a piece."""
    x = members.values
    raw = np.frombuffer(b"".join(x.field("vector").to_pylist()), "<f8").reshape(len(x), -1)
    return x.field("rep").to_numpy(), x.field("copies").to_numpy(), raw / np.linalg.norm(raw, axis=1, keepdims=True)


def _links(tasks: DataFrame, least: float) -> DataFrame:
    """(rep, n, other): links found for rep in a task, weighted by copies; and edges (rep, other) to the least of what it was linked with, with n 0."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                block = batch.column(0)[at].as_py()
                ids, copies, a = _side(batch.column(1)[at])
                same = not batch.column(2)[at].is_valid
                ids_b, copies_b, b = (ids, copies, a) if same else _side(batch.column(2)[at])
                shift = 0 if same else len(ids)
                every = ids if same else np.concatenate((ids, ids_b))
                count, label = np.zeros(len(every), np.int64), np.arange(len(every))
                for i, j in _linked(a, b, block, least, same):
                    j = j + shift
                    many = copies if same else np.concatenate((copies, copies_b))
                    np.add.at(count, i, many[j])
                    np.add.at(count, j, many[i])
                    while True:
                        low = np.minimum(label[i], label[j])
                        new = label.copy()
                        np.minimum.at(new, label[i], low), np.minimum.at(new, label[j], low)
                        new = new[new]
                        if (new == label).all():
                            break
                        label = new
                some, told = np.flatnonzero(count), np.flatnonzero(label != np.arange(len(label)))
                if len(some):
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((every[some], every[told]))), pa.array(np.concatenate((count[some], np.zeros(len(told), np.int64)))), pa.array([*[None] * len(some), *every[label[told]].tolist()], pa.int64())], ["rep", "n", "other"])

    return tasks.mapInArrow(run, "rep bigint, n bigint, other bigint")


def near_vectors(rows: DataFrame, least: float = 0.93) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of rows (vec_id integer, label, embedding array of numbers)."""
    prepared = keep(_prepared(rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("string").alias("label"), "embedding")))
    same = prepared.where("vector is not null").groupBy("label", "vector").agg(F.min("vec_id").alias("least_id"), F.count("*").alias("copies"))
    classes = keep(same.withColumn("rep", F.monotonically_increasing_id()))  # written before use, so the number of a class stays what it is
    placed = keep(_slabs(classes, least).join(classes.select("rep", "label"), "rep"))
    slab = ["label", "width", "block", "slab"]
    sizes = keep(placed.groupBy(*slab, "guest").agg(F.ceil(F.count("*") / F.greatest(F.lit(1), F.floor(F.lit(PIECE_BYTES) / (8 * F.col("width"))))).cast("int").alias("pieces")))
    full = placed.join(sizes, [*slab, "guest"]).withColumn("piece", F.pmod(F.xxhash64("rep"), F.col("pieces")).cast("int")).join(classes.select("rep", "copies", "vector"), "rep")
    pieces = keep(full.groupBy(*slab, "guest", "piece").agg(F.collect_list(F.struct("rep", "copies", "vector")).alias("members")))
    home = pieces.where("not guest").select(*slab, F.col("piece").alias("to"), F.col("members").alias("b"))
    met = pieces.select(*slab, "guest", "piece", F.col("members").alias("a")).join(home, slab).where("guest or piece <= `to`")
    tasks = met.select("block", "a", F.when(F.col("guest") | (F.col("piece") != F.col("to")), F.col("b")).alias("b"))
    found = keep(_links(tasks, least))
    counts = found.where("other is null").groupBy("rep").agg(F.sum("n").alias("n"))
    reach = components(found.where("other is not null"), "rep", "other")
    named = classes.join(counts, "rep", "left").join(reach.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    # equal vectors link too: copies - 1 of them
    named = keep(named.select("label", "vector", "least_id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"), "component"))
    smallest = keep(named.groupBy("component").agg(F.min("least_id").alias("component_id")))
    out = prepared.join(named.join(smallest, "component").select("label", "vector", "n", "component_id"), ["label", "vector"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(False)).alias("kept"))
