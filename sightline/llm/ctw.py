"""Language-model scores by context-tree weighting over bytes.

A text is its UTF-8 bytes, A-Z lower-cased, then an end mark. A symbol is nine binary
decisions: end or not, then the byte's bits from the top. Every decision has a context
tree of its own whose contexts are the 0 to DEPTH bytes before (line feeds before the
text's first). A node estimates with Krichevsky-Trofimov counts; its weighted probability
is half its own estimate and half the product of its children's, computed in logarithms
from the leaves up. Scoring mixes along the path: at each node the posterior share of
its own estimate, else what the longer context says. A context never seen says 1/2.

Training counts every (DEPTH + 1)-byte run of every training text. Counts are reduced in
each task and then by run. Trees are weighted in parts, a part being the runs with the same
last two context bytes; a part with more than 1 of SPLIT of all runs is split by the third
byte, and its depth 2 (at most 257 runs a part, so 257 x SPLIT) joins depths 0 and 1 (at
most 2 x 131,072 sums), which meet on the driver and go to the executors.

Scoring reads the texts once, however large the model is. The commonest SHARE of runs and of
words (`often` of each at most) are on every executor with what they are worth; of
all others a task gathers the distinct ones of a chunk of its texts, which travel to
the part of the tree they belong to, and back to the chunk, where each text has kept the
numbers of those it needs. What a part is asked is streamed past its tree, and a part
asked for more than ASKED runs is dealt out to several tasks. Nothing that grows with the
corpus is on the driver or broadcast.

Base score: unigram over words with 0.1 added, as the contract has it; words are told
apart by 64-bit numbers (two share one with a chance near 2^-60). bits_per_byte is the code
length per byte, null for empty texts.

Null and empty texts hold the end alone. Null doc_ids are training rows, as their text is
no number. With no training text every decision has probability 1/2 and the base score is
even over nothing known. Repeated rows are scored alike, a row each, and so are rows that
share a doc_id by their own texts. A very long text is read in parts of about GULP bytes that end
with white space, one after the other in one task. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WS, read, stored
from .textbits import _FOLD, word_numbers

DEPTH, OFTEN, SHARE = 5, 1 << 19, 1 / 8
#: Bytes of text at a time; how many runs a task holds before it hands them on; bytes of text of a chunk.
GULP, HELD, CHUNK = 3 << 20, 2_000_000, 64 << 20
#: A part with over 1 of SPLIT of all runs is split; one asked for more than ASKED runs is dealt out.
SPLIT, ASKED = 512, 20_000_000
END, BITS = 256, 9
_LOG_HALF = math.log(0.5)


def _lgamma(x: np.ndarray) -> np.ndarray:
    """log gamma for x > 0: Stirling's series at x + 8."""
    shift = np.zeros_like(x)
    for k in range(8):
        shift += np.log(x + k)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """log of the Krichevsky-Trofimov probability of any sequence with these counts."""
    a, b = zeros.astype(float), ones.astype(float)
    return _lgamma(a + 0.5) + _lgamma(b + 0.5) - _lgamma(a + b + 1) - math.log(math.pi)


class Layer:
    """Runs of one depth: sorted codes (context << 9 | symbol), counts; kt and w
    [run, decision]: the estimate of the decision taken, the node's own share."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray):
        self.codes, self.counts = codes, counts
        self.sums = np.concatenate([[0], np.cumsum(counts)])
        self.w = np.ones((len(codes), BITS), np.float32)

    def weigh(self, depth: int, below: tuple | None) -> tuple:
        """Sets w; below: (node keys, sums of log Pw) of the children, None at full
        depth. Returns the same for the layer above."""
        codes, keys, logs = self.codes, [], []
        context = codes >> np.uint64(BITS)
        for i in range(BITS):
            node = codes >> np.uint64(BITS - i)
            start = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]])) if len(node) else np.zeros(0, int)
            stop = np.append(start[1:], len(node))
            n = self.sums[stop] - self.sums[start]
            mid = np.searchsorted(codes, (node[start] << np.uint64(BITS - i)) + np.uint64(1 << (BITS - 1 - i)))
            ones = self.sums[stop] - self.sums[np.clip(mid, start, stop)]
            log_e = log_kt(n - ones, ones)
            prefix = (codes[start] & np.uint64(511)) >> np.uint64(BITS - i)
            number = np.uint64(1 << i) | prefix
            if below is None:
                log_w = log_e
            else:
                at = np.searchsorted(below[0], context[start] << np.uint64(BITS) | number)
                longer = below[1][at]
                log_w = np.logaddexp(_LOG_HALF + log_e, _LOG_HALF + longer)
                self.w[:, i] = np.repeat(np.exp(_LOG_HALF + log_e - log_w), stop - start)
            up = context[start] & np.uint64((1 << 8 * max(depth - 1, 0)) - 1)
            keys.append(up << np.uint64(BITS) | number)
            logs.append(log_w)
        keys, back = np.unique(np.concatenate(keys), return_inverse=True)
        return keys, np.bincount(back, np.concatenate(logs), len(keys))

    def mix(self, codes: np.ndarray, longer: np.ndarray) -> np.ndarray:
        """Probabilities [code, decision] at this depth from those of longer contexts."""
        out = np.full((len(codes), BITS), 0.5)
        low = codes & ~np.uint64(511)
        for i in range(BITS):
            size = np.uint64(1 << (BITS - i))
            node = codes - (codes - low) % size
            a, b, c = (np.searchsorted(self.codes, x) for x in (node, node + size // np.uint64(2), node + size))
            n = self.sums[c] - self.sums[a]
            right = self.sums[c] - self.sums[b]
            taken = np.where(codes >= node + size // np.uint64(2), right, n - right)
            w = self.w[np.minimum(a, max(len(self.w) - 1, 0)), i] if len(self.w) else np.ones(len(codes))
            out[:, i] = np.where(n > 0, w * (taken + 0.5) / (n + 1) + (1 - w) * longer[:, i], 0.5)
        return out


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys of all parts (keys, counts), with the sums of their counts."""
    keys, back = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(back, np.concatenate([n for _, n in parts]), len(keys)).astype(np.int64)


def _reduced(codes: np.ndarray, counts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Runs shortened to `depth` context bytes, sorted, with their counts."""
    keys, back = np.unique(codes & np.uint64((1 << (8 * depth + BITS)) - 1), return_inverse=True)
    return keys, np.bincount(back, counts, len(keys)).astype(np.int64)


def weighted(codes: np.ndarray, counts: np.ndarray, top: int, depth: int) -> tuple[list, tuple]:
    """Layers depth..top of runs, and the sums for the layer above top."""
    layers, below = [], None
    for d in range(depth, top - 1, -1):
        layers.append(Layer(*_reduced(codes, counts, d)))
        below = layers[-1].weigh(d, below)
    return layers, below


def log10_probability(codes: np.ndarray, layers: list, depth: int) -> np.ndarray:
    """Of the symbol of each run, by layers of depth, depth - 1, ... 0."""
    p = np.full((len(codes), BITS), 0.5)
    for k, layer in enumerate(layers):
        p = layer.mix(codes & np.uint64((1 << (8 * (depth - k) + BITS)) - 1), p)
    p[(codes & np.uint64(511)) >= END, 1:] = 1.0  # nothing is left to decide after the end
    return np.log10(p).sum(axis=1)


class Index:
    """Positions of 64-bit keys by open addressing in numpy; -1 if absent."""

    def __init__(self, keys: np.ndarray):
        self.keys, self.shift = keys, np.uint64(64 - max(4, int(2 * len(keys)).bit_length()))
        self.size = 1 << (64 - int(self.shift))
        self.slots = np.full(self.size, -1, np.int32)
        todo, at = np.arange(len(keys), dtype=np.int32), self._home(keys)
        self.steps = 0
        while len(todo):
            free = self.slots[at] < 0
            self.slots[at[free]] = todo[free]
            lost = self.slots[at] != todo
            todo, at = todo[lost], (at[lost] + 1) & (self.size - 1)
            self.steps += 1

    def _home(self, keys):
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(keys), -1, np.int32)
        at = self._home(keys)
        out = self.slots[at]
        todo = np.flatnonzero((out >= 0) & (self.keys[out] != keys))
        for _ in range(self.steps):
            if not len(todo):
                break
            at[todo] = (at[todo] + 1) & (self.size - 1)
            got = self.slots[at[todo]]
            out[todo] = got
            todo = todo[(got >= 0) & (self.keys[got] != keys[todo])]
        out[todo] = -1
        return out


def _gulps(batches: Iterator[pa.RecordBatch], column: int, gulp: int) -> Iterator[tuple[list[pa.RecordBatch], list[bytes]]]:
    """Batches, sliced, in groups of about gulp bytes of text."""
    held, texts, size = [], [], 0
    for batch in batches:
        start = 0
        for i, text in enumerate(batch.column(column).to_pylist()):
            texts.append((text or "").encode())
            size += len(texts[-1])
            if size >= gulp:
                held.append(batch.slice(start, i + 1 - start))
                yield held, texts
                held, texts, size, start = [], [], 0, i + 1
        if start < batch.num_rows:
            held.append(batch.slice(start))
    if held:
        yield held, texts


_SPACES = np.zeros(256, bool)
_SPACES[list(WS.encode())] = True


def _parts(texts: list[bytes], depth: int, size: int) -> Iterator[tuple[list[bytes], bytes, bool]]:
    """(texts, the bytes before the first, whether they end here): the texts as they are, but a single one longer than
    size in parts, each of which ends with the last white space before its size is reached, or the next one after."""
    if len(texts) > 1 or len(texts[0]) <= size:
        yield texts, b"\n" * depth, True
        return
    text, at = texts[0], 0
    space = np.flatnonzero(_SPACES[np.frombuffer(text, np.uint8)]) + 1
    while at < len(text):
        k = int(np.searchsorted(space, at + size, "right"))
        end = len(text) if at + size >= len(text) else int(space[k - 1]) if k and space[k - 1] > at else int(space[k]) if k < len(space) else len(text)
        yield [text[at:end]], (b"\n" * depth + text[max(0, at - depth) : at])[-depth:], end == len(text)
        at = end


def _runs(texts: list[bytes], depth: int, before: bytes | None = None, ends: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, starts, folded bytes joined by spaces): the codes of all positions, text by text. before:
    the bytes before each, line feeds by default; ends: whether an end follows."""
    pad = b"\n" * depth if before is None else before
    raw = _FOLD[np.frombuffer(b"".join(x for t in texts for x in (pad, t, b"\0")), np.uint8)]
    sizes = np.array([len(t) for t in texts], np.int64)
    begin = np.concatenate([[0], np.cumsum(sizes + depth + 1)])
    wide = raw.astype(np.uint64)
    wide[begin[1:] - 1] = END
    codes = wide.copy()
    for k in range(1, depth + 1):
        codes[k:] |= wide[:-k] << np.uint64(BITS + 8 * (k - 1))
    real = np.ones(len(raw), bool)
    for k in range(depth):
        real[begin[:-1] + k] = False
    if not ends:
        real[begin[1:] - 1] = False
    for k in range(depth):  # what stands before is no word of the text
        raw[begin[:-1] + k] = 32
    raw[begin[1:] - 1] = 32  # the ends part the words of neighbours
    return codes[real], np.concatenate([[0], np.cumsum(sizes + ends)])[:-1], raw


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0, F.lit(False))


def corpus_counts(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """kind, key, n over texts: kind 0 the runs, kind 1 the words (key 0: the end)."""

    def batch(kind: int, keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int8)), pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], names=["kind", "key", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {0: [], 1: []}
        for _, texts in _gulps(batches, 0, GULP):
            for some, before, ends in _parts(texts, depth, GULP):
                codes, _, raw = _runs(some, depth, before, ends)
                held[0].append(np.unique(codes, return_counts=True))
                del codes  # the words need the room
                keys, n = np.unique(word_numbers(raw)[0], return_counts=True)
                held[1].append((np.append(keys, np.zeros(int(ends), np.uint64)), np.append(n, np.full(int(ends), len(some)))))
                for kind, parts in held.items():
                    if sum(len(k) for k, _ in parts) >= HELD:
                        parts[:] = [_merged(parts)]
                        if len(parts[0][0]) > HELD // 2:
                            yield batch(kind, *parts.pop())
        for kind, parts in held.items():
            if parts:
                yield batch(kind, *_merged(parts))

    return docs.select("text").mapInArrow(run, "kind byte, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))


class Solver:
    """The tops of the trees and which parts are split: what every task needs to weigh a part."""

    def __init__(self, depth: int, tops: list):
        self.depth, self.tops = depth, tops

    def values(self, codes: np.ndarray, counts: np.ndarray, asked: np.ndarray, split: bool) -> np.ndarray:
        """log10 probabilities of the runs asked, by the trees of the runs counted (sorted)."""
        top = 3 if split else 2
        layers = weighted(codes, counts, top, self.depth)[0] if len(codes) else [Layer(codes, counts)] * (self.depth - top + 1)
        tops = self.tops if split else self.tops[1:]
        return log10_probability(asked, [*layers, *tops], self.depth)


#: Set in the numbers of split parts; above it stands the salt of a part that is dealt out.
_SPLIT, _SALT = 1 << 24, 32


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(split, counted runs, their counts, asked runs, their chunks) of a few parts at a time,
    from rows (part, asks, key, n) sorted by part and asks. A part's counts are together; what it
    is asked may come in several turns, each with its counts."""

    def turn(part, asks, key, n):
        for split in (False, True):
            own = (part & _SPLIT != 0) == split
            yes, no = own & (asks == 1), own & (asks == 0)
            if own.any():
                order = np.argsort(key[no])
                yield split, key[no][order], n[no][order], key[yes], n[yes]

    held, size = [], 0
    for batch in batches:
        part, asks, key, n = (np.asarray(batch.column(i)) for i in range(4))
        held.append((part, asks, key.view(np.uint64), n))
        size += len(part)
        if size < HELD:
            continue
        rows = tuple(np.concatenate(c) for c in zip(*held, strict=True))
        last = rows[0] == rows[0][-1]  # this part may go on
        counting = rows[1][-1] == 0
        now, keep = (~last, last) if counting else (np.ones(len(last), bool), last & (rows[1] == 0))
        yield from turn(*(c[now] for c in rows))
        held, size = [tuple(c[keep] for c in rows)], 0
    if held:
        yield from turn(*(np.concatenate(c) for c in zip(*held, strict=True)))


class Model:
    """The fitted counts (in the shared folder), the tops of the trees and the commonest runs and words."""

    def __init__(self, docs: DataFrame, depth: int = DEPTH, often: int = OFTEN, split: int = SPLIT):
        if not 2 <= depth <= 6:
            raise ValueError("depth is 2 to 6: a run is a 64-bit number")
        spark = docs.sparkSession
        self.depth = depth
        counted = stored(corpus_counts(docs, depth), "counts")
        got = {r["kind"]: r for r in counted.groupBy("kind").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("n")).collect()}
        self.tokens, self.distinct = (int(got[1]["n"]), got[1]["rows"]) if 1 in got else (0, 0)
        self.runs, self.words = counted.where("kind = 0").select("key", "n"), counted.where("kind = 1").select("key", "n")
        rows = got[0]["rows"] if 0 in got else 0
        large = self.runs.groupBy(self._two().alias("two")).count().where(F.col("count") * split > rows)
        self.hot = sorted(r["two"] for r in large.collect()) if depth > 2 else []  # at most `split` rows
        self.solver = spark.sparkContext.broadcast(Solver(depth, self._tops()))
        self.often = spark.sparkContext.broadcast((self._often_runs(often), self._often_words(often)))

    @staticmethod
    def _two() -> Column:
        return F.shiftright("key", BITS).bitwiseAND(0xFFFF)

    def _part(self) -> Column:
        two = self._two()
        return F.when(two.isin(self.hot), F.shiftright("key", BITS).bitwiseAND(0xFFFFFF) + _SPLIT).otherwise(two) if self.hot else two

    def _counted(self) -> DataFrame:
        return self.runs.select(self._part().cast("long").alias("part"), F.lit(0).cast("byte").alias("asks"), "key", "n")

    def _tops(self) -> list:
        """Layers 2 (of split parts), 1 and 0, from sums over the parts."""
        depth = self.depth

        def sums(batches):
            for split, codes, counts, _, _ in _gathered(batches):
                top = 3 if split else 2
                _, (keys, logs) = weighted(codes, counts, top, depth)
                short, n = _reduced(codes, counts, top - 1)
                size = len(keys) + len(short)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(size, top - 1, np.int8)), pa.array(np.append(np.ones(len(keys), np.int8), np.zeros(len(short), np.int8))), pa.array(np.append(keys, short).view(np.int64)), pa.array(np.append(logs, n.astype(float)))],
                    names=["depth", "log", "key", "value"],
                )

        parted = self._counted().repartition("part").sortWithinPartitions("part")
        got = parted.mapInArrow(sums, "depth byte, log byte, key long, value double").groupBy("depth", "log", "key").agg(F.sum("value").alias("value")).toArrow()
        d, log, key, value = (got.column(c).to_numpy() for c in ("depth", "log", "key", "value"))
        key, none = key.view(np.uint64), (np.zeros(0, np.uint64), np.zeros(0))
        of = {}
        for level in (2, 1):
            for kind in (0, 1):
                at = (d == level) & (log == kind)
                order = np.argsort(key[at])
                of[level, kind] = (key[at][order], value[at][order])
        two = Layer(of[2, 0][0], np.rint(of[2, 0][1]).astype(np.int64))
        up = two.weigh(2, of[2, 1]) if len(two.codes) else none
        short = _reduced(two.codes, two.counts, 1)

        def added(a, b):
            keys, back = np.unique(np.concatenate([a[0], b[0]]), return_inverse=True)
            return keys, np.bincount(back, np.concatenate([a[1], b[1]]), len(keys))

        codes, n = added(of[1, 0], short)
        one = Layer(codes, np.rint(n).astype(np.int64))
        if not len(codes):
            return [two, one, Layer(*none)]
        below = one.weigh(1, added(of[1, 1], up))
        zero = Layer(*_reduced(one.codes, one.counts, 0))
        zero.weigh(0, below)
        return [two, one, zero]

    @staticmethod
    def _common(df: DataFrame, often: int) -> DataFrame:
        """The rows with the largest n: about SHARE of all, often at most."""
        rows = df.count()
        if not rows:
            return df
        least = df.agg(F.percentile_approx("n", 1 - min(SHARE, often / rows), 10_000)).first()[0]
        while df.where(F.col("n") > least).count() > often:  # the sketch is off by a little
            least += 1 + least // 16
        return df.where(F.col("n") > least)

    def _often_runs(self, often: int) -> tuple[np.ndarray, np.ndarray]:
        """Sorted keys and log10 probabilities of the commonest runs."""
        solver = self.solver

        def solve(batches):
            for split, codes, counts, asked, _ in _gathered(batches):
                if len(asked):
                    yield pa.RecordBatch.from_arrays([pa.array(asked.view(np.int64)), pa.array(solver.value.values(codes, counts, asked, split))], names=["key", "value"])

        common = self._common(self.runs, often).select(self._part().cast("long").alias("part"), F.lit(1).cast("byte").alias("asks"), "key", F.lit(0).cast("long").alias("n"))
        rows = self._counted().unionByName(common).repartition("part").sortWithinPartitions("part", "asks")
        return self._table(rows.mapInArrow(solve, "key long, value double"))

    def _often_words(self, often: int) -> tuple[np.ndarray, np.ndarray]:
        return self._table(self._common(self.words, often).select("key", F.col("n").cast("double").alias("value")))

    @staticmethod
    def _table(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        got = df.toArrow()
        return got.column("key").to_numpy().view(np.uint64), got.column("value").to_numpy()

    def _answers(self, asks: DataFrame) -> DataFrame:
        """chunk, kind, key, value of what chunks ask (chunk, kind, key)."""
        solver = self.solver
        runs = asks.where("kind = 0").select(self._part().cast("long").alias("part"), F.lit(1).cast("byte").alias("asks"), "key", F.col("chunk").alias("n"))
        counted = self._counted()
        many = runs.groupBy("part").count().where(F.col("count") > ASKED).select("part", F.ceil(F.col("count") / ASKED).cast("int").alias("salts"))
        many = [(r["part"], r["salts"]) for r in many.collect()]  # no more than there are parts
        if many:
            table = F.broadcast(asks.sparkSession.createDataFrame(many, "part long, salts int"))
            salts, salted = F.coalesce("salts", F.lit(1)), F.col("part") + F.shiftleft(F.col("salt").cast("long"), _SALT)
            counted = counted.join(table, "part", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).withColumn("part", salted)
            runs = runs.join(table, "part", "left").withColumn("salt", F.pmod(F.hash("n"), salts)).withColumn("part", salted)
            counted, runs = (d.drop("salt", "salts") for d in (counted, runs))

        def solve(batches):
            for split, codes, counts, asked, chunk in _gathered(batches):
                if len(asked):
                    new, back = np.unique(asked, return_inverse=True)
                    value = solver.value.values(codes, counts, new, split)[back]
                    yield pa.RecordBatch.from_arrays([pa.array(chunk), pa.array(np.zeros(len(asked), np.int8)), pa.array(asked.view(np.int64)), pa.array(value)], names=["chunk", "kind", "key", "value"])

        rows = counted.unionByName(runs).repartition("part").sortWithinPartitions("part", "asks")
        of_runs = rows.mapInArrow(solve, "chunk long, kind byte, key long, value double")
        words = asks.where("kind = 1").select("chunk", "kind", "key").join(self.words, "key", "left")
        return of_runs.unionByName(words.select("chunk", "kind", "key", F.coalesce("n", F.lit(0)).cast("double").alias("value")))

    def score(self, docs: DataFrame) -> DataFrame:
        """doc_id, n_bytes, n_tokens, n_known, base_score, score, bits_per_byte: one row per row of docs."""
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        read_ = stored(rows.mapInArrow(_reader(self.often, self.depth, self.tokens, self.distinct), _READ), "texts-read")
        answers = self._answers(read_.where("kind < 2").select("chunk", "kind", "key"))
        # a text's columns are one struct, so that the many answers are short rows
        texts = read_.where("kind = 2").select("chunk", "kind", "key", F.lit(None).cast("double").alias("value"), F.struct(*_TEXT).alias("text"))
        both = texts.unionByName(answers, allowMissingColumns=True).select("chunk", "kind", "key", "value", "text")
        dealt = both.repartition("chunk").sortWithinPartitions("chunk", "kind", "key")
        out = dealt.mapInArrow(_finisher(self.tokens, self.distinct), "doc_id long, n_bytes long, n_tokens long, n_known long, base_score double, score double")
        return out.withColumn("bits_per_byte", F.when(F.col("n_bytes") > 0, -F.col("score") * math.log2(10) / F.col("n_bytes")))


_TEXT = {"doc_id": pa.int64(), "n_bytes": pa.int64(), "n_tokens": pa.int64(), "n_known": pa.int64(), "base_score": pa.float64(), "score": pa.float64(), "runs": pa.binary(), "words": pa.binary()}
#: What reading gives: kinds 0 and 1 ask for a run's and a word's worth; kind 2 is a text, the sums of
#: what is common in it, and the places of the rest (32 bits each) among what its chunk asks for, in order.
_READ = "chunk long, kind byte, key long, doc_id long, n_bytes long, n_tokens long, n_known long, base_score double, score double, runs binary, words binary"


def _reader(often, depth: int, tokens: int, distinct: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        (keys, worth), (names, counts) = often.value
        index, named = Index(keys), Index(names)
        even = math.log10(tokens + 0.1 * (distinct + 1))
        chunk, first = TaskContext.get().partitionId() << 24, True
        held: list[tuple] = []  # by gulp: columns of its texts, runs asked and their texts, words asked and theirs
        size = bytes_ = 0

        def close():
            asked, places = [], []
            for kind in (0, 1):
                every = np.concatenate([h[1][kind][0] for h in held])
                new, back = np.unique(every, return_inverse=True)
                asked.append(new)
                places.append(np.split(back.astype(np.int32), np.cumsum([len(h[1][kind][0]) for h in held])[:-1]))
            n = sum(map(len, asked))
            if n:
                none = [pa.nulls(n, t) for t in _TEXT.values()]
                kinds = np.repeat(np.array([0, 1], np.int8), [len(a) for a in asked])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, chunk)), pa.array(kinds), pa.array(np.concatenate(asked)), *none], names=["chunk", "kind", "key", *_TEXT])
            for g, (cols, need) in enumerate(held):
                n = len(cols[1])
                lists = []
                for kind in (0, 1):
                    cut = np.searchsorted(need[kind][1], np.arange(n + 1))
                    at = places[kind][g]
                    lists.append(pa.array([at[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary()))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, chunk)), pa.array(np.full(n, 2, np.int8)), pa.nulls(n, pa.int64()), *cols, *lists], names=["chunk", "kind", "key", *_TEXT])

        def measured(texts, before, ends):
            """Sums of what is common, by text: (score, base, known, tokens), then what is asked for with its texts, runs and words."""
            codes, starts, raw = _runs(texts, depth, before, ends)
            at = index.find(codes)
            known = at >= 0
            value = np.where(known, worth[at], 0.0) if len(worth) else np.zeros(len(codes))
            total = np.add.reduceat(value, starts) if len(codes) else np.zeros(len(texts))
            lost = np.flatnonzero(~known)
            asks = [(codes[lost].view(np.int64), np.searchsorted(starts, lost, "right") - 1)]
            del codes, at, known, value
            numbers, places = word_numbers(raw)
            begin = np.concatenate([[0], np.cumsum([len(t) + depth + 1 for t in texts])])
            doc = np.append(np.searchsorted(begin, places, "right") - 1, np.arange(len(texts) * ends))
            numbers = np.append(numbers, np.zeros(len(texts) * ends, np.uint64))
            order = np.argsort(doc, kind="stable")
            numbers, doc = numbers[order], doc[order].astype(np.int64)
            at = named.find(numbers)
            known = at >= 0
            c = counts[at[known]] if len(counts) else np.zeros(0)
            base = np.bincount(doc[known], np.log10(c + 0.1) - even, len(texts)).astype(float)
            asks.append((numbers[~known].view(np.int64), doc[~known]))
            return [total, base, np.bincount(doc[known], minlength=len(texts)), np.bincount(doc, minlength=len(texts))], asks

        for group, texts in _gulps(batches, 1, GULP):
            done = [measured(*part) for part in _parts(texts, depth, GULP)]
            total, base, found, count = (sum(sums[i] for sums, _ in done) for i in range(4))
            asks = [tuple(np.concatenate([asked[kind][i] for _, asked in done]) for i in (0, 1)) for kind in (0, 1)]
            ids = pa.concat_arrays([b.column(0) for b in group])
            cols = [ids, pa.array(np.array([len(t) for t in texts], np.int64)), pa.array(count.astype(np.int64)), pa.array(found.astype(np.int64)), pa.array(base), pa.array(total)]
            held.append((cols, asks))
            size, bytes_ = size + sum(len(a) for a, _ in asks), bytes_ + sum(map(len, texts))
            if size >= HELD or bytes_ >= CHUNK:
                yield from close()
                held.clear()
                size = bytes_ = 0
                chunk += 1
        if held:
            yield from close()

    return run


def _finisher(tokens: int, distinct: int):
    even = math.log10(tokens + 0.1 * (distinct + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, values = None, {0: [], 1: []}, {}
        for batch in batches:
            chunk, kind, value = np.asarray(batch.column(0)), np.asarray(batch.column(1)), batch.column(3).to_numpy(zero_copy_only=False)
            edges = np.flatnonzero(np.diff(chunk)) + 1
            for a, b in zip([0, *edges], [*edges, len(chunk)], strict=True):
                if a == b:
                    continue
                if chunk[a] != now:
                    now, parts, values = chunk[a], {0: [], 1: []}, {}
                for k in (0, 1):
                    parts[k].append(value[a:b][kind[a:b] == k])
                texts = np.flatnonzero(kind[a:b] == 2) + a
                if not len(texts):
                    continue
                if not values:  # all answers stand before the texts
                    values = {k: np.concatenate(v) for k, v in parts.items()}
                    words = np.log10(values[1] + 0.1) - even
                rows = dict(zip(_TEXT, batch.column(4).slice(int(texts[0]), len(texts)).flatten(), strict=True))
                need = [[np.frombuffer(x, np.int32) for x in rows[c].to_pylist()] for c in ("runs", "words")]
                known, base, score = (rows[c].to_numpy(zero_copy_only=False) for c in ("n_known", "base_score", "score"))
                score = score + np.array([values[0][x].sum() for x in need[0]], float)
                base = base + np.array([words[x].sum() for x in need[1]], float)
                known = known + np.array([np.count_nonzero(values[1][x]) for x in need[1]], np.int64)
                yield pa.RecordBatch.from_arrays([rows["doc_id"], rows["n_bytes"], rows["n_tokens"], pa.array(known.astype(np.int64)), pa.array(base), pa.array(score)], names=["doc_id", "n_bytes", "n_tokens", "n_known", "base_score", "score"])

    return run


def op1(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = Model(docs.where(~held_out()))
    return model.score(docs).select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score", "bits_per_byte")
