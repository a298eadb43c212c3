"""Quality: random-indexing word vectors pooled per document, then a two-layer network with calibrated probabilities.

Every token has a sparse random index vector that follows from its hash. A token's vector is the sum of the index vectors
of the tokens at most two places from it, over all documents: each task adds up its share and a grouped sum joins the shares. Tokens share
CELLS places by hash, so the table has a fixed size whatever the vocabulary. A document is the weighted mean and
spread of its tokens' vectors. The network is trained in numpy on at most SAMPLE labelled rows a class; a temperature,
fitted on rows that neither trained it nor chose its weights, turns its output into probabilities.

Defined results: null and empty texts have all-zero features and get the score of those; unlabelled rows and null labels teach nothing; with labels of
one kind only, every score is that kind's share, and without any label every score is .5 (nothing is known, so nothing is thrown out); repeated rows are scored alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import modest
from .textbytes import SPACE, chunks, mix, power_table

CELLS, WIDTH, NONZERO, REACH = 4096, 64, 4, 2
#: Labelled rows a class that the network is trained on.
SAMPLE = 20_000
CHUNK = 1 << 19
FEATURES = 2 * WIDTH + 1
_U = np.uint64

#: 0 space, 1 marks, 2 letters, digits and all beyond ASCII: a token is a run of 1 or of 2.
_KIND = np.ones(256, np.uint8)
_KIND[SPACE] = 0
_KIND[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 2


def _index() -> tuple[np.ndarray, np.ndarray]:
    x = mix(np.arange(1, CELLS * NONZERO + 1, dtype=np.uint64) * _U(0xA0761D6478BD642F)).reshape(CELLS, NONZERO)
    return (x % _U(WIDTH)).astype(np.int64), np.where(x >> _U(63), 1.0, -1.0)


def token_cells(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cell, row) of every token."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = _KIND[data]
    edge = np.concatenate((np.ones(1, bool), kind[1:] != kind[:-1], np.ones(1, bool)))
    edge[offsets] = True
    at = np.flatnonzero(edge)
    starts, ends = at[:-1], at[1:]
    real = kind[starts] > 0
    starts, ends = starts[real], ends[real]
    up, down = power_table(len(data) + 1)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + _U(1)) * down[: len(data)])))
    cell = mix((total[ends] - total[starts]) * up[starts]) % _U(CELLS)
    return cell.astype(np.int64), np.searchsorted(offsets[1:], starts, "right")


def word_vectors(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """([CELLS, WIDTH] vectors, [CELLS] share of all tokens), from all texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, sign = _index()
        total, count = np.zeros(CELLS * WIDTH), np.zeros(CELLS)
        for batch in batches:
            for _, _, offsets, data in chunks(batch.column(0), CHUNK):
                cell, row = token_cells(offsets, data)
                count += np.bincount(cell, minlength=CELLS)
                for d in range(1, REACH + 1):
                    near = row[d:] == row[:-d]
                    a, b = cell[:-d][near], cell[d:][near]
                    at = np.concatenate(((a[:, None] * WIDTH + place[b]).ravel(), (b[:, None] * WIDTH + place[a]).ravel()))
                    total += np.bincount(at, np.concatenate((sign[b].ravel(), sign[a].ravel())), CELLS * WIDTH)
        some = np.flatnonzero(count)
        table = total.reshape(CELLS, WIDTH)[some]
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(count[some]), *(pa.array(table[:, i]) for i in range(WIDTH))], ["cell", "n", *names])

    modest(docs.sparkSession)
    names = [f"v{i}" for i in range(WIDTH)]
    sums = docs.select(F.col("text").cast("string")).mapInArrow(run, "cell bigint, n double, " + ", ".join(f"{x} double" for x in names)).groupBy("cell").agg(F.sum("n").alias("n"), F.array(*(F.sum(x) for x in names)).alias("v"))
    vectors, share = np.zeros((CELLS, WIDTH)), np.zeros(CELLS)
    for r in sums.collect():  # CELLS rows at most
        vectors[r["cell"]], share[r["cell"]] = r["v"], r["n"]
    share /= max(share.sum(), 1.0)
    vectors -= vectors.sum(0) * share[:, None]  # what every token's neighbours have in common
    return (vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)).astype(np.float32), share


def features(offsets: np.ndarray, data: np.ndarray, vectors: np.ndarray, share: np.ndarray) -> np.ndarray:
    """[row, FEATURES]: weighted mean and spread of token vectors, and the logarithm of the number of tokens."""
    rows = len(offsets) - 1
    out = np.zeros((rows, FEATURES), np.float32)
    cell, row = token_cells(offsets, data)
    if len(cell):
        weight = (1e-3 / (1e-3 + share)).astype(np.float32)
        n = np.bincount(row, minlength=rows)
        some = np.flatnonzero(n)
        starts = np.concatenate(([0], np.cumsum(n[some])[:-1]))
        w = weight[cell]
        x = vectors[cell]
        all_w = np.maximum(np.add.reduceat(w, starts), 1e-6)[:, None]
        mean = np.add.reduceat(x * w[:, None], starts) / all_w
        square = np.add.reduceat(x * x * w[:, None], starts) / all_w
        out[some] = np.column_stack((mean, np.sqrt(np.maximum(square - mean * mean, 0)), np.log1p(n[some])))
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    """Two layers and a temperature; inputs are standardised."""

    def __init__(self, x: np.ndarray, y: np.ndarray, hidden: int = 32, steps: int = 3000) -> None:
        rng = np.random.default_rng(7)
        self.mid, self.scale = x.mean(0), x.std(0) + 1e-6
        order = rng.permutation(len(x))
        # one part chooses the weights, another the temperature, the rest trains
        n = len(x) // 8
        aside, last, own = order[:n], order[n : 2 * n], order[2 * n :]
        z = (x - self.mid) / self.scale
        self.w = [rng.normal(0, (2 / z.shape[1]) ** 0.5, (z.shape[1], hidden)), np.zeros(hidden), rng.normal(0, (1 / hidden) ** 0.5, hidden), np.zeros(1)]
        first, second = [np.zeros_like(a) for a in self.w], [np.zeros_like(a) for a in self.w]
        step, best = 0, (np.inf, self.w)
        for _ in range(max(40, -(-steps // max(1, -(-len(own) // 256))))):
            rng.shuffle(own)
            for at in range(0, len(own), 256):
                a, b = z[own[at : at + 256]], y[own[at : at + 256]]
                h = np.maximum(a @ self.w[0] + self.w[1], 0)
                g = (_sigmoid(h @ self.w[2] + self.w[3]) - b) / len(b)
                gh = (g[:, None] * self.w[2]) * (h > 0)
                step += 1
                for i, grad in enumerate((a.T @ gh + 1e-4 * self.w[0], gh.sum(0), h.T @ g + 1e-4 * self.w[2], g.sum(keepdims=True))):
                    first[i] = 0.9 * first[i] + 0.1 * grad
                    second[i] = 0.999 * second[i] + 0.001 * grad * grad
                    self.w[i] = self.w[i] - 3e-3 * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
            loss = self._loss(z[aside], y[aside], 1.0)
            if loss < best[0]:
                best = (loss, [a.copy() for a in self.w])
        self.w = best[1]
        self.heat = min(np.geomspace(0.25, 8, 61), key=lambda t: self._loss(z[last], y[last], t))

    def _raw(self, z: np.ndarray) -> np.ndarray:
        return np.maximum(z @ self.w[0] + self.w[1], 0) @ self.w[2] + self.w[3]

    def _loss(self, z: np.ndarray, y: np.ndarray, heat: float) -> float:
        if not len(y):
            return abs(np.log(heat))
        p = np.clip(_sigmoid(self._raw(z) / heat), 1e-6, 1 - 1e-6)
        return float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self._raw((x - self.mid) / self.scale) / self.heat)


class Share:
    """What there is to say with labels of one kind only."""

    def __init__(self, y: np.ndarray) -> None:
        self.share = float((y.sum() + 0.5) / (len(y) + 1))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.share)


def trained(sample: DataFrame, label: str, vectors: np.ndarray, share: np.ndarray):
    """A model from (text, label 0/1), a bounded sample."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, offsets, data in chunks(batch.column(0), CHUNK):
                x = features(offsets, data, vectors, share)
                yield pa.RecordBatch.from_arrays([pa.array([v.tobytes() for v in x], pa.binary()), batch.column(1).slice(first, end - first)], ["x", "y"])

    rows = sample.select("text", label).mapInArrow(run, "x binary, y int").toPandas()
    rows = rows.sort_values(["y", "x"])  # the same rows in the same order, however they came
    y = rows["y"].to_numpy(float)
    if len(set(y)) < 2:
        return Share(y)
    return Network(np.frombuffer(b"".join(rows["x"]), np.float32).reshape(len(rows), FEATURES).astype(float), y)


def scored(docs: DataFrame, model, vectors: np.ndarray, share: np.ndarray) -> DataFrame:
    """(doc_id, score) of whole texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, offsets, data in chunks(batch.column(1), CHUNK):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), pa.array(model(features(offsets, data, vectors, share)).astype(float))], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {kind}, score double")
