"""Spelling variants by a frequency-vector trie: words one inserted, deleted or replaced code point apart, and the commonest form of each.

A word is a vector of counts of letter groups (a letter of a-z with some of the others), and a path of a trie, one group a level. One edit adds
at most one letter of one group and takes at most one of another, so a search from a word goes depth first with a budget
of one surplus and one deficit; what it reaches is verified.

The trie is cut into subtrees that fit a task: a node with more than `most` words is cut again STEP levels below, and searches go down to
its children along the counts that their budget allows. A task is a subtree with a bounded piece of the searches that enter it, so neither
a common stem nor a busy node is held whole. Should more than `most` words share all counts, they meet in an equi-join on themselves
with one place left out, whose groups the alphabet bounds. A task returns counts and one best form a word, never pairs.

Defined results: null texts have no words; a null doc_id counts as an empty one in the typing rule; repeated rows count each for themselves;
words of any length are whole (counts beyond 127 count as 127 in vectors, which loses no word); columns other than doc_id and text are ignored; of
forms that occur equally often the first in code-point order wins.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import keep, modest

#: The letters by which the levels go: common ones first, since they part words most.
BY_LEVEL = "eaintrsoludcmpghbvfqzyxjkw"
#: Levels of the trie, and levels that one cut goes down.
GROUPS, STEP = len(BY_LEVEL), 2
#: The level of each Latin-1 byte.
LEVEL = np.arange(256) % GROUPS
LEVEL[[ord(c) for c in BY_LEVEL]] = range(GROUPS)
#: Words of a subtree, and searches that a task gets at once.
MOST, SEARCHES = 50_000, 25_000
#: Words of a leaf, pairs compared at once, letters of words that are compared as rows of a matrix, and distinct words a task counts before it hands them on.
LEAF, PAIRS, WIDE, HELD = 16, 1 << 15, 64, 200_000

#: Latin-1 bytes: A-Z lower-cased, a-z and 0xC0-0xFF as they are, a space for all others.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 192 else 32 for b in range(256))


def runs(text: str) -> list[bytes]:
    """The lower-cased letter runs of a text, in Latin-1, which holds every letter of a run."""
    return text.encode("latin-1", "replace").translate(TABLE).split()


def typed(run: bytes, doc: int, one_in: int) -> bytes:
    """The run as its document types it (doc: checksum of the id): now and then a letter is left out."""
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), doc)
    if h % one_in:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def word_counts(docs: DataFrame, least_length: int = 5, least_n: int = 3, one_in: int = 97) -> DataFrame:
    """(word, n) of whole texts (doc_id, text): words of `least_length` code points that occur `least_n` times."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[bytes, int] = {}

        def full() -> pa.RecordBatch:
            words = pa.array([w.decode("latin-1") for w in total], pa.string())
            out = pa.RecordBatch.from_arrays([words, pa.array(list(total.values()), pa.int64())], ["word", "n"])
            total.clear()
            return out

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                for w, n in Counter(runs(text or "")).items():
                    w = typed(w, own, one_in)
                    if len(w) >= least_length:
                        total[w] = total.get(w, 0) + n
                if len(total) > HELD:
                    yield full()
        if total:
            yield full()

    modest(docs.sparkSession)
    counted = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "word string, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_n)


def vectors(words: list[bytes]) -> np.ndarray:
    """Counts of letter groups, a row a word."""
    out = np.zeros((len(words), GROUPS), np.int8)
    short = [k for k, w in enumerate(words) if len(w) <= WIDE]
    letters = _letters([words[k] for k in short])
    groups = np.where(letters == 0, GROUPS, LEVEL[letters])
    for g in range(GROUPS):
        out[short, g] = (groups == g).sum(1)
    for k, w in enumerate(words):
        if len(w) > WIDE:
            out[k] = np.minimum(np.bincount(LEVEL[np.frombuffer(w, np.uint8)], minlength=GROUPS), 127)
    return out


def _letters(words: list[bytes]) -> np.ndarray:
    """A row of WIDE + 1 letters a word, filled up with zeros; a longer word has none."""
    short, wide = [w if len(w) <= WIDE else b"" for w in words], WIDE + 1
    return np.array(short, f"S{wide}").view(np.uint8).reshape(len(short), wide)


def one_edit(a: bytes, b: bytes) -> bool:
    """Exactly one code point inserted, deleted or replaced."""
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > 1 or a == b:
        return False
    at = next((k for k in range(len(b)) if a[k] != b[k]), len(b))
    return a[at + 1 :] == b[at + (len(a) == len(b)) :]


class _Words:
    """Words with their letters, lengths and vectors."""

    def __init__(self, words: list[str]):
        self.words = [w.encode("latin-1") for w in words]
        self.letters, self.size, self.vectors = _letters(self.words), np.array([len(w) for w in self.words], np.int64), vectors(self.words)
        #: A bit a level: whether its count is odd. One edit changes two of them at most.
        self.odd = (self.vectors & 1).astype(np.uint32) @ (np.uint32(1) << np.arange(GROUPS, dtype=np.uint32))

    def ranks(self, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places by falling n and code-point order, the rank of each place)."""
        by_rank = np.array(sorted(range(len(n)), key=lambda k: (-n[k], self.words[k])), np.int64)
        rank = np.empty(len(n), np.int64)
        rank[by_rank] = np.arange(len(n))
        return by_rank, rank


def _verified(a: _Words, b: _Words, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether a[i] and b[j] are one edit apart, for whole arrays of places."""
    la, lb = a.size[i], b.size[j]
    good = np.abs(la - lb) <= 1
    wide = good & ((la > WIDE) | (lb > WIDE))
    for k in np.flatnonzero(wide):
        good[k] = one_edit(a.words[i[k]], b.words[j[k]])
    rest = np.flatnonzero(good & ~wide)
    width = 1 + int(max(la[rest].max(initial=0), lb[rest].max(initial=0)))
    x, y = a.letters[i[rest], :width], b.letters[j[rest], :width]
    swap = la[rest] < lb[rest]
    x[swap], y[swap] = y[swap], x[swap]
    unlike = x != y
    first = np.argmax(unlike, 1)  # words of unequal length differ somewhere; of equal ones the sum tells
    moved = (x[:, 1:] == y[:, :-1]) | (np.arange(width - 1)[None] < first[:, None])
    good[rest] = np.where(la[rest] == lb[rest], unlike.sum(1) == 1, moved.all(1))
    return good


def reached(members: _Words, searches: _Words, depth: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(search, member) places one edit apart. Members share the first `depth` counts; the trie below them is their sorted vectors, searched depth first, all searches together."""
    order = np.lexsort(members.vectors[:, depth:].T[::-1]) if depth < GROUPS else np.arange(len(members.words))
    table, odd, own = members.vectors[order], members.odd[order], searches.vectors
    ahead = table[:1, :depth] - own[:, :depth]
    surplus, deficit = 1 - np.maximum(ahead, 0).sum(1), 1 - np.maximum(-ahead, 0).sum(1)
    within = (surplus >= 0) & (deficit >= 0)
    stack = [(depth, 0, len(table), np.flatnonzero(within), surplus[within], deficit[within])]
    while stack:
        level, low, high, who, more, less = stack.pop()
        if level == GROUPS or high - low <= LEAF or len(who) * (high - low) <= 32 * LEAF:
            step = max(1, PAIRS // (high - low))
            for at in range(0, len(who), step):
                some = slice(at, at + step)
                at_q, at_m = np.nonzero(np.bitwise_count(searches.odd[who[some], None] ^ odd[None, low:high]) <= 2)
                apart = table[low + at_m, level:] - own[who[some][at_q], level:]
                fits = (np.maximum(apart, 0).sum(1) <= more[some][at_q]) & (np.maximum(-apart, 0).sum(1) <= less[some][at_q])
                i, j = who[some][at_q[fits]], order[low + at_m[fits]]
                if len(i):
                    near = _verified(searches, members, i, j)
                    yield i[near], j[near]
            continue
        column = table[low:high, level]
        cuts = [0, *(np.flatnonzero(np.diff(column)) + 1).tolist(), high - low]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            change = column[a] - own[who, level]
            left, short = more - np.maximum(change, 0), less - np.maximum(-change, 0)
            ok = (left >= 0) & (short >= 0)
            if ok.any():
                stack.append((level + 1, low + a, low + b, who[ok], left[ok], short[ok]))


def _searched(tasks: DataFrame) -> DataFrame:
    """(word, n_near, form_n, form) of tasks (node, piece, depth, members (word, n), searches (word, n)): what a task found for each word.

    Searches come from this subtree or from those before it; the latter's finds count for both ends.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                depth = batch.column(0)[at].as_py()
                sides = [(_Words(x.field("word").to_pylist()), x.field("n").to_numpy()) for x in (batch.column(c)[at].values for c in (1, 2))]
                (members, _), (searches, _) = sides
                ranked = [words.ranks(n) for words, n in sides]
                count = [np.zeros(len(n), np.int64) for _, n in sides]
                best = [np.full(len(n), len(m)) for (_, n), (_, m) in zip(sides, sides[::-1], strict=True)]
                away = (searches.vectors[:, :depth] != members.vectors[:1, :depth]).any(1)
                for i, j in reached(members, searches, depth):
                    np.add.at(count[1], i, 1), np.minimum.at(best[1], i, ranked[0][1][j])
                    i, j = i[away[i]], j[away[i]]
                    np.add.at(count[0], j, 1), np.minimum.at(best[0], j, ranked[1][1][i])
                for side, other in ((0, 1), (1, 0)):
                    some = np.flatnonzero(count[side])
                    form = ranked[other][0][best[side][some]]
                    text = lambda k, rows: pa.array([sides[k][0].words[r].decode("latin-1") for r in rows], pa.string())  # noqa: E731, B023
                    yield pa.RecordBatch.from_arrays([text(side, some), pa.array(count[side][some]), pa.array(sides[other][1][form], pa.int64()), text(other, form)], ["word", "n_near", "form_n", "form"])

    # dealt out anew: little data, much work, so the shuffle before would be merged into a few partitions
    parts = int(tasks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return tasks.repartition(parts, "node", "piece").select("depth", "members", "searches").mapInArrow(run, "word string, n_near bigint, form_n bigint, form string")


def _path(words: DataFrame) -> DataFrame:
    """words with `path`: two hexadecimal digits a level."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = vectors([w.encode("latin-1") for w in batch.column(0).to_pylist()]).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([row.tobytes().hex() for row in v], pa.string())], ["word", "n", "path"])

    return words.select("word", "n").mapInArrow(run, "word string, n bigint, path string")


def _down(searches: DataFrame, depth: int, to: int) -> DataFrame:
    """Searches (word, n, path, node, more, less) at nodes of `depth`, sent to every node of depth `to` that their budget allows, their own or a later one."""
    for level in range(depth, to):
        own = F.conv(F.substring("path", 2 * level + 1, 2), 16, 10).cast("int")
        way = lambda change: F.struct((own + change).alias("c"), (F.col("more") - max(change, 0)).alias("more"), (F.col("less") - max(-change, 0)).alias("less"))  # noqa: E731, B023
        ways = F.filter(F.array(way(0), way(1), way(-1)), lambda x: (x.more >= 0) & (x.less >= 0) & x.c.between(0, 127))
        node = F.concat("node", F.lpad(F.lower(F.hex(F.col("x.c"))), 2, "0"))
        searches = searches.withColumn("x", F.explode(ways)).select("word", "n", "path", node.alias("node"), "x.more", "x.less")
        searches = searches.where(F.col("node") >= F.substring("path", 1, 2 * level + 2))
    return searches


def _without_one(kind: str, same_place: bool) -> Column:
    """Each word with one place left out, under a kind of key; same_place: the place is part of the key."""
    places = F.sequence(F.lit(1), F.length("word"))
    return F.transform(places, lambda i: F.struct(F.concat(F.lit(kind), i.cast("string") if same_place else F.lit("")).alias("kind"), F.concat(F.expr("word").substr(F.lit(1), i - 1), F.expr("word").substr(i + 1, F.length("word"))).alias("key")))


def _alike(searches: DataFrame, members: DataFrame) -> DataFrame:
    """As _searched, for nodes of words that share all counts: an equi-join on words with one place left out; a key's group is as large as the alphabet at most."""
    whole = lambda kind: F.array(F.struct(F.lit(kind).alias("kind"), F.col("word").alias("key")))
    a = searches.select("node", "word", F.col("n").alias("own"), (F.col("node") != F.substring("path", 1, 2 * GROUPS)).alias("away"), F.explode(F.concat(_without_one("r", True), _without_one("d", False), whole("i"))).alias("k")).select("node", "word", "own", "away", "k.kind", "k.key")
    b = members.select("node", F.col("word").alias("form"), "n", F.explode(F.concat(_without_one("r", True), whole("d"), _without_one("i", False))).alias("k")).select("node", "form", "n", "k.kind", "k.key")
    found = a.join(b, ["node", "kind", "key"]).where("word <> form").select("word", "own", "away", "form", "n").distinct()
    pairs = found.select("word", "form", "n").unionByName(found.where("away").select(F.col("form").alias("word"), F.col("word").alias("form"), F.col("own").alias("n")))
    best = F.min(F.struct((-F.col("n")).alias("n"), "form"))
    return pairs.groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best")).select("word", "n_near", (-F.col("best.n")).alias("form_n"), "best.form")


def near_words(words: DataFrame, most: int = MOST) -> DataFrame:
    """(word, n_near, form_n, form): how many of the words (word, n; distinct) are one edit from each, and the commonest of them; words without any are left out."""
    spark = words.sparkSession
    known = keep(_path(words))
    searches = known.select("word", "n", "path", F.lit("").alias("node"), F.lit(1).alias("more"), F.lit(1).alias("less"))
    members, found, depth = known.select("word", "n", "path", F.lit("").alias("node")), [], 0
    while True:
        size = keep(members.groupBy("node").agg(F.count("*").alias("size")))
        fits, large = size.where(F.col("size") <= most).select("node"), size.where(F.col("size") > most).select("node")
        here = keep(searches.join(size, "node"))  # only nodes that exist
        homes = members.join(fits, "node").groupBy("node").agg(F.collect_list(F.struct("word", "n")).alias("members"))
        many = here.where(F.col("size") <= most).groupBy("node").agg(F.ceil(F.count("*") / SEARCHES).cast("int").alias("pieces"))
        piece = F.pmod(F.xxhash64("word"), F.col("pieces")).cast("int")
        pieces = here.where(F.col("size") <= most).join(keep(many), "node").groupBy("node", piece.alias("piece")).agg(F.collect_list(F.struct("word", "n")).alias("searches"))
        found.append(keep(_searched(pieces.join(homes, "node").select("node", "piece", F.lit(depth).alias("depth"), "members", "searches"))))
        if not large.limit(1).count():
            break
        on, into = here.where(F.col("size") > most).drop("size"), members.join(large, "node")
        if depth == GROUPS:
            found.append(keep(_alike(on, into)))
            break
        to = min(depth + STEP, GROUPS)
        members = keep(into.withColumn("node", F.substring("path", 1, 2 * to)))
        searches, depth = _down(on, depth, to), to
    every = found[0]
    for one in found[1:]:
        every = every.unionByName(one)
    best = F.min(F.struct((-F.col("form_n")).alias("n"), "form"))
    return every.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select("word", "n_near", (-F.col("best.n")).alias("form_n"), "best.form")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of forms (word, form): pointers doubled until none moves. A form occurs twice as often as its word, so the rounds are few."""
    now = keep(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        then = keep(now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if not then.where("moved").limit(1).count():
            return then.select("word", "root")
        now = then.select("word", "root")


def variants(docs: DataFrame, times: int = 2, most: int = MOST, **rule) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word of docs (doc_id, text). form: the commonest word one edit away, if `times` as common at least; root: the last of the forms. rule: of word_counts."""
    words = keep(word_counts(docs, **rule))
    near = keep(near_words(words, most))
    good = F.col("form_n") >= times * F.col("n")
    told = keep(words.join(near, "word", "left").select("word", F.when(good, F.col("form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(good, F.col("form_n")).alias("form_n")))
    return told.join(_roots(told.where("form is not null")), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
