"""Byte-level BPE over a public rank file: two tiers of lookup, and decoding.

Texts are cut into pre-tokens as the rank file's pattern cuts them, all texts of a batch at once over their code points. A pre-token that is a
vocabulary entry itself is found by a minimal perfect hash: as many slots as entries, each key compared in full. What
misses is merged from its bytes: neighbours in a linked list, candidate pairs in a heap by rank and place. A
worker keeps the ids of words it has merged, in two generations of MEMORY each; results never depend on that memory.

No shuffle: ids follow from a text alone. A text of any length is whole; one of more than SEGMENT code points is handled in segments that end where a
pre-token surely does, so memory beyond the text and its ids stays bounded.

Defined results: a null text counts as empty and has no ids; repeated rows are encoded each for itself; special tokens are ordinary text; columns other than
doc_id and text are dropped; null ids decode to nothing, and ids outside the vocabulary are an error.
"""

from __future__ import annotations

import base64
import heapq
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import modest
from .textbytes import mix

#: Code points handled at once, and merged words of a generation, each of up to KEPT bytes.
SEGMENT, MEMORY, KEPT = 1 << 20, 300_000, 64

#: What the pattern tells apart, and the mark between texts.
SPACE, LETTER, NUMBER, OTHER, END = range(5)
#: Endings that an apostrophe binds, fixed by the pattern.
ENDINGS = ["s", "t", "re", "ve", "m", "ll", "d"]
MARK = 0x110000
_SURE = re.compile("(?<=[A-Za-z]) (?=[A-Za-z])")
_U = np.uint64
_SPREAD = 0x9E3779B97F4A7C15

_kinds: list[np.ndarray] = []


def kinds() -> np.ndarray:
    """The kind of each code point, by the Unicode tables of tiktoken: its matches of one class, over all code points, are that class."""
    if not _kinds:
        table = np.full(MARK + 1, OTHER, np.uint8)
        table[MARK] = END
        every = "".join(map(chr, (*range(0xD800), *range(0xE000, MARK))))
        for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s")):
            matches = tiktoken.Encoding("class", pat_str=pattern, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
            table[np.frombuffer(bytes(matches.encode_ordinary(every)).decode().encode("utf-32-le"), "<u4")] = kind
        _kinds.append(table)
    return _kinds[0]


def starts(points: np.ndarray) -> np.ndarray:
    """Where pre-tokens start in code points of texts that each end in MARK; a MARK starts one of its own."""
    kind = kinds()[points]
    before, after = np.concatenate(([END], kind[:-1])), np.concatenate((kind[1:], [END]))
    spaces, blank = kind == SPACE, points == 32
    after_blank = np.concatenate(([False], blank[:-1]))
    # the last space of a run stands apart if something follows it, and a blank goes with what follows
    first = np.where(spaces, (before != SPACE) | ((after != SPACE) & (after != END)), (before != kind) & ~after_blank) | (kind == END)
    quote = np.flatnonzero((points == 39) & (before != OTHER) & ~after_blank)
    padded = np.concatenate((points, [MARK, MARK]))
    one, two = padded[quote + 1], padded[quote + 2]
    for ending in ENDINGS:
        fits = (one == ord(ending[0])) & (two == ord(ending[1]) if len(ending) > 1 else True)
        first[quote[fits] + 1] = False
        first[quote[fits] + 1 + len(ending)] = True
    return np.flatnonzero(first)


class PerfectHash:
    """A minimal perfect hash of byte strings: each key has a slot of its own in a table as long as there are keys. Buckets of keys, the
    largest first, get the first displacement that sends all of them to free slots; a bucket of one key names its slot."""

    def __init__(self, keys: list[bytes]):
        self.size, self.length = len(keys), np.array([len(k) for k in keys], np.int64)
        self.longest = int(self.length.max())
        data = b"".join(keys)
        at = np.concatenate(([0], np.cumsum(self.length)))
        words, hashed = self._words(np.frombuffer(data + bytes(8), np.uint8), at[:-1], self.length)
        self.buckets = max(1, self.size // 2)
        home = (hashed % _U(self.buckets)).astype(np.int64)
        order = np.argsort(home, kind="stable")
        edges = np.searchsorted(home[order], np.arange(self.buckets + 1))
        self.shift, taken = np.zeros(self.buckets, np.int64), np.zeros(self.size, bool)
        slot = np.empty(self.size, np.int64)
        counts = np.diff(edges)
        for b in np.argsort(-counts, kind="stable"):
            own = order[edges[b] : edges[b + 1]]
            if len(own) < 2:
                break
            base = 0
            while True:
                tries = np.arange(base, base + 64)
                to = self._slots(hashed[own][None], tries[:, None])
                good = ~taken[to].any(1) & (np.diff(np.sort(to, 1), axis=1) > 0).all(1)
                if good.any():
                    break
                base += 64
            k = int(np.argmax(good))
            self.shift[b], slot[own], taken[to[k]] = base + k, to[k], True
        single, free = np.flatnonzero(counts == 1), np.flatnonzero(~taken)
        slot[order[edges[single]]] = free
        self.shift[single] = -1 - free
        self.key = np.empty(self.size, np.int64)
        self.key[slot] = np.arange(self.size)
        self.words, self.length = words[:, self.key], self.length[self.key]

    def _slots(self, hashed: np.ndarray, shift: np.ndarray) -> np.ndarray:
        return (mix(hashed + shift.astype(np.uint64) * _U(_SPREAD)) % _U(self.size)).astype(np.int64)

    def _words(self, data: np.ndarray, at: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the spans as rows of eight bytes each, their hashes); data has eight bytes more than its last span."""
        eights = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
        out, hashed = np.zeros((-(-self.longest // 8), len(at)), np.uint64), length.astype(np.uint64)
        for k in range(len(out)):
            some = slice(None) if k == 0 else np.flatnonzero(length > 8 * k)
            left = np.minimum(length[some] - 8 * k, 8).astype(np.uint64)
            out[k][some] = eights[at[some] + 8 * k] & (_U(0xFFFFFFFFFFFFFFFF) >> (_U(64) - _U(8) * left))
            hashed[some] = mix(hashed[some] * _U(_SPREAD) + out[k][some])
        return out, hashed

    def find(self, data: np.ndarray, at: np.ndarray, length: np.ndarray) -> np.ndarray:
        """The number of the key that each span (of a byte at least) is, or -1."""
        out = np.full(len(at), -1)
        some = np.flatnonzero(length <= self.longest)
        words, hashed = self._words(data, at[some], length[some])
        shift = self.shift[(hashed % _U(self.buckets)).astype(np.int64)]
        slot = np.where(shift < 0, -1 - shift, self._slots(hashed, np.maximum(shift, 0)))
        same = self.length[slot] == length[some]
        for k in range(len(words)):
            same &= self.words[k][slot] == words[k]
        out[some[same]] = self.key[slot[same]]
        return out


class Vocabulary:
    """Entries of a rank file, for whole pre-tokens, for pairs, and for decoding."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
        keys = list(self.ranks)
        self.hash, self.ids = PerfectHash(keys), np.array([self.ranks[k] for k in keys], np.uint32)
        by_id: list[bytes] = [b""] * (max(self.ranks.values()) + 1)
        for key, rank in self.ranks.items():
            by_id[rank] = key
        self.length = np.array([len(x) for x in by_id], np.int64)
        self.at, self.data, self.by_id = np.cumsum(self.length) - self.length, np.frombuffer(b"".join(by_id), np.uint8), by_id
        self.single = [self.ranks[bytes([c])] for c in range(256)]
        #: The rank of every pair of entries that makes an entry.
        self.pairs = {self.ranks[key[:k]] << 20 | self.ranks[key[k:]]: rank for key, rank in self.ranks.items() for k in range(1, len(key)) if key[:k] in self.ranks and key[k:] in self.ranks}
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def merged(self, word: bytes) -> bytes:
        """The ids of a word that is no entry: the pair of least rank merges first, of equals the leftmost."""
        n, pairs = len(word), self.pairs
        ids = [self.single[c] for c in word]
        pair = [pairs.get(a << 20 | b, -1) for a, b in zip(ids, ids[1:])]
        pair.append(-1)
        ahead, behind = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [rank << 32 | k for k, rank in enumerate(pair) if rank >= 0]
        heapq.heapify(heap)
        while heap:
            top = heapq.heappop(heap)
            rank, k = top >> 32, top & 0xFFFFFFFF
            if pair[k] != rank:
                continue
            gone = ahead[k]
            after, left = ahead[gone], behind[k]
            ids[k], ahead[k], pair[gone], ids[gone] = rank, after, -1, -1
            if after < n:
                behind[after] = k
                pair[k] = new = pairs.get(rank << 20 | ids[after], -1)
                if new >= 0:
                    heapq.heappush(heap, new << 32 | k)
            else:
                pair[k] = -1
            if left >= 0:
                pair[left] = new = pairs.get(ids[left] << 20 | rank, -1)
                if new >= 0:
                    heapq.heappush(heap, new << 32 | left)
        out = [i for i in ids if i >= 0]
        return struct.pack(f"<{len(out)}I", *out)

    def ids_of(self, words: list[bytes]) -> list[bytes]:
        """The ids of words that are no entries."""
        if len(self.young) >= MEMORY:
            self.young, self.old = {}, self.young
        young, old = self.young, self.old
        for word in set(words).difference(young):
            young[word] = old.get(word) or self.merged(word)
        out = list(map(young.__getitem__, words))
        for word in [w for w in words if len(w) > KEPT]:
            young.pop(word, None)
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit numbers."""
        joined = "\n".join(texts) + "\n"
        ends = np.cumsum([len(t) + 1 for t in texts]) - 1
        points = np.frombuffer(joined.encode("utf-32-le"), "<u4").copy()
        points[ends] = MARK
        raw = joined.encode()
        if len(raw) == len(points):
            place = np.arange(len(points) + 1)
        else:
            wide = np.ones(len(points), np.int64)
            for low in (0x80, 0x800, 0x10000):
                wide += (points >= low) & (points != MARK)
            place = np.concatenate(([0], np.cumsum(wide)))
        first = starts(points)
        at, until = place[first], place[np.append(first[1:], len(points))]
        token = points[first] != MARK
        first, at, until = first[token], at[token], until[token]
        key = self.hash.find(np.frombuffer(raw + bytes(8), np.uint8), at, until - at)
        hit, miss = key >= 0, np.flatnonzero(key < 0)
        others = self.ids_of([raw[a:b] for a, b in zip(at[miss].tolist(), until[miss].tolist(), strict=True)])
        count = np.ones(len(key), np.int64)
        count[miss] = [len(x) // 4 for x in others]
        edge = np.concatenate(([0], np.cumsum(count)))
        whole = np.zeros(edge[-1], bool)
        whole[edge[:-1][hit]] = True
        ids = np.empty(edge[-1], "<u4")
        ids[whole], ids[~whole] = self.ids[key[hit]], np.frombuffer(b"".join(others), "<u4")
        cut = (4 * edge[np.searchsorted(first, np.concatenate(([0], ends + 1)))]).tolist()
        data = ids.tobytes()
        return [data[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]

    def decode(self, ids: np.ndarray) -> bytes:
        if len(ids) and int(ids.max()) >= len(self.length):
            raise ValueError(f"no token has the id {int(ids.max())}")
        size = self.length[ids]
        edge = np.cumsum(size)
        total = int(edge[-1]) if len(edge) else 0
        return self.data[np.repeat(self.at[ids] - edge + size, size) + np.arange(total)].tobytes()


_loaded: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    if path not in _loaded:
        _loaded[path] = Vocabulary(path)
    return _loaded[path]


def segments(text: str, most: int = SEGMENT) -> Iterator[str]:
    """A text in pieces of about `most` code points, cut before a blank between two letters, where a pre-token always starts."""
    at = 0
    while len(text) - at > most and (cut := _SURE.search(text, at + most)):
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids) for every row of docs (doc_id, text); ids: little-endian unsigned 32-bit numbers. path: a rank file that every worker has."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path)
        for batch in batches:
            parts, row, size, out = [], [], 0, [[] for _ in range(batch.num_rows)]

            def flush() -> None:
                for k, ids in zip(row, words.encode(parts), strict=True):
                    out[k].append(ids)  # noqa: B023
                parts.clear(), row.clear()  # noqa: B023

            for k in range(batch.num_rows):
                for piece in segments(batch.column(1)[k].as_py() or ""):
                    parts.append(piece), row.append(k)
                    size += len(piece)
                    if size >= SEGMENT:
                        flush()
                        size = 0
            if parts:
                flush()
            ids = [b"".join(x) for x in out]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "n_tokens", "ids"])

    modest(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, n_tokens bigint, ids binary")


def decoded(coded: DataFrame, path: str) -> DataFrame:
    """coded (doc_id, n_tokens, ids) with `decoded`: the bytes that the ids stand for."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path)
        for batch in batches:
            text = [words.decode(np.frombuffer(x.as_py() or b"", "<u4")) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(text, pa.binary())], ["doc_id", "n_tokens", "ids", "decoded"])

    modest(coded.sparkSession)
    kind = coded.schema["doc_id"].dataType.simpleString()
    return coded.select("doc_id", "n_tokens", "ids").mapInArrow(run, f"doc_id {kind}, n_tokens bigint, ids binary, decoded binary")
