"""Near duplicates by SetSketch registers.

A document is the set of its distinct 5-word shingles. Its sketch has M registers; a
register is the least of one hash per shingle, read as an exponential time and kept as
the number of steps of ratio BASE below 1, truncated to a byte: exponentially spaced
minima, mergeable by maximum, equal with a chance that follows the Jaccard likeness.

1. Rows with equal sets are one class, numbered when the table of classes is written.
   Links, buckets and components know classes by that number alone; the row that holds a
   class (its smallest doc_id, nulls last) is a label beside it.
2. Classes meet in buckets: BANDS runs of ROWS registers. At 80 % likeness a pair
   misses every bucket with a chance below 1e-6: (1 - 0.8^5)^35.
3. Each class of a bucket is compared with the bucket's hub, its smallest number: first by
   sketch (a pair is dropped if its set sizes forbid the likeness or if the joint likelihood
   of its registers over all likenesses at or above the threshold lies EVIDENCE below that over
   all), then on full sets. A group of near copies is one component after that, at a row a class.
4. Buckets in which classes of different components are left are compared in blocks of about
   BLOCK classes or BLOCK_ITEMS shingles, so that no task holds a bucket and no pair is emitted:
   a component with a block's worth of a bucket has blocks of its own, which don't meet each
   other, and the rest share blocks. A pair lives in the first band it shares and passes the same
   two tests, likeliest first; a pair linked already through others is skipped, which leaves
   components as they are.
5. Components of the links spread by alternating star contractions.

Lower case is A-Z; words are runs without white space. Fewer than five words are one
shingle. Null, empty and blank texts have an empty set and are linked with nothing, not
even each other. Rows that share a doc_id are linked by their own texts, each in its own
class. Rows with a null doc_id are linked like any; a component is named by its smallest
doc_id, and only one of nulls alone has a null name. `near_groups` calls a row kept if its
doc_id is its component's name, so rows that share that doc_id are kept together. `keep_one`
keeps exactly one row of a component: of the smallest doc_id (nulls last) and there of the
smallest hash of the text; of rows alike in both, one by its other columns. Empty texts
all stay. Very long texts are one row's set and split their buckets into more blocks. An
empty table gives an empty table. Other columns pass through `keep_one`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free, read, release, stored
from .textbits import folded, mix64, shingles, word_numbers

WORDS, PERCENT = 5, 85
BASE, RATE, BANDS, ROWS = 1.09, 20.0, 35, 5
M, BLOCK, EVIDENCE = BANDS * ROWS, 512, 13.0
#: Shingles a block of a bucket holds, about: 16 MB of full sets.
BLOCK_ITEMS = 2_000_000
#: Candidate ids up to this many are sent to every executor (24 MB at most); beyond, they are joined.
BROADCAST_IDS = 1_000_000

_rng = np.random.default_rng(9)
_A = _rng.integers(1, 2**62, M, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 2**63, M, dtype=np.uint64)


def registers(items: np.ndarray) -> np.ndarray:
    """The sketch of a set of 64-bit numbers: M bytes."""
    least = np.full(M, np.uint64(2**64 - 1), np.uint64)
    for at in range(0, len(items), 4096):
        least = np.minimum(least, mix64(items[at : at + 4096, None] * _A + _B).min(axis=0))
    time = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**64) / RATE
    return np.clip(np.floor(1 - np.log(np.maximum(time, 1e-300)) / np.log(BASE)), 0, 255).astype(np.uint8)


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union of two sets."""
    return np.maximum(a, b)


_GRID = np.linspace(0.0, 1.0, 101)


def evidence(more, less, u, least: float) -> np.ndarray:
    """How far the log likelihood of any Jaccard >= least lies below that of the best
    one. more, less: registers in which the first (second) sketch is larger; u: the
    first set's share of both sizes."""
    chance = lambda x: -np.log(np.maximum(1 - x * (BASE - 1) / BASE, 1e-12)) / np.log(BASE)
    u = np.asarray(u, float)[:, None]
    top = np.minimum(u / (1 - u), (1 - u) / u)  # no Jaccard above the ratio of sizes
    j = _GRID * top
    p, q = chance(np.maximum(u - (1 - u) * j, 0)), chance(np.maximum(1 - u - u * j, 0))
    log = lambda x: np.log(np.maximum(x, 1e-9))
    more, less = np.asarray(more)[:, None], np.asarray(less)[:, None]
    of = more * log(p) + less * log(q) + (M - more - less) * log(1 - p - q)
    high = np.where(j >= np.minimum(least, top) - 1e-9, of, -np.inf).max(axis=1)
    return of.max(axis=1) - high


def linked(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """Whether two sorted sets share at least percent % of their union."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    both = int(np.count_nonzero(b[np.minimum(at, len(b) - 1)] == a)) if len(b) else 0
    return 100 * both >= percent * (len(a) + len(b) - both) and both > 0


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, n_shingles, a and b (128 bits that stand for the set), regs
    (null for empty sets). One pass over the texts, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, a, b, regs = [], [], [], []
            for text in batch.column(2).to_pylist():
                s = shingles(word_numbers(folded((text or "").encode()))[0], WORDS)
                size.append(len(s))
                a.append(int(mix64(s).sum(dtype=np.uint64).astype(np.int64)))
                b.append(int(mix64(s ^ np.uint64(0x5BD1E995)).sum(dtype=np.uint64).astype(np.int64)))
                regs.append(registers(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(size, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(regs, pa.binary())],
                names=["doc_id", "text_key", "n_shingles", "a", "b", "regs"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_key"), "text").mapInArrow(
        run, "doc_id long, text_key long, n_shingles long, a long, b long, regs binary"
    )


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, pa.Table]]:
    """(key, rows) of runs with equal first `keys` columns, from batches sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [np.asarray(batch.column(i)) for i in range(keys)]
        new = np.zeros(batch.num_rows, bool)
        new[0] = True
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        starts = [*np.flatnonzero(new), batch.num_rows]
        for s, e in zip(starts, starts[1:], strict=False):
            key = tuple(c[s].item() for c in cols)
            if held and key != last:
                yield last, pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(s, e - s))
            last = key
    if held:
        yield last, pa.Table.from_batches(held)


def _alike(p: np.ndarray, q: np.ndarray, n: np.ndarray, m: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(whether sketches p and q, rows of registers of sets of n and m shingles, may be of linked sets, how many registers are equal)."""
    equal = (p == q).sum(axis=1)
    keep = (100 * np.minimum(n, m) >= percent * np.maximum(n, m)) & (equal >= M * percent / 100 - 6 * np.sqrt(M * percent / 100 * (1 - percent / 100)))
    some = np.flatnonzero(keep)
    if len(some):
        keep[some] = evidence((p[some] > q[some]).sum(axis=1), (p[some] < q[some]).sum(axis=1), n[some] / (n[some] + m[some]), percent / 100) <= EVIDENCE
    return keep, equal


def _likely(band: int, left: np.ndarray, right: np.ndarray, size: np.ndarray, root: np.ndarray, regs: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(x, y, equal registers) of the pairs of rows left and right that may be linked, are of different
    components and share no earlier band."""
    out = []
    for at in range(0, len(left), 64):
        x = left[at : at + 64]
        fits = (100 * np.minimum(size[x][:, None], size[right]) >= percent * np.maximum(size[x][:, None], size[right])) & (root[x][:, None] != root[right])
        if left is right:
            fits &= x[:, None] < right
        a, b = np.nonzero(fits)
        a, b = x[a], right[b]
        for part in range(0, len(a), 16384):
            p, q = a[part : part + 16384], b[part : part + 16384]
            earlier = (regs[p, : band * ROWS] == regs[q, : band * ROWS]).reshape(len(p), band, ROWS).all(axis=2).any(axis=1) if band else np.zeros(len(p), bool)
            p, q = p[~earlier], q[~earlier]
            keep, equal = _alike(regs[p], regs[q], size[p], size[q], percent)
            out.append((p[keep], q[keep], equal[keep]))
    return tuple(np.concatenate(c) if out else np.zeros(0, np.int64) for c in (zip(*out, strict=True) if out else ((), (), ())))


def _registers(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, M)


def _buckets(classes: DataFrame) -> DataFrame:
    """band, key, id of the classes in buckets of two or more."""
    runs = F.array(*[F.struct(F.lit(k).alias("band"), F.xxhash64(F.expr(f"substring(regs, {k * ROWS + 1}, {ROWS})")).alias("key")) for k in range(BANDS)])
    bands = classes.select("id", F.explode(runs).alias("r")).select("r.band", "r.key", "id")
    full = bands.groupBy("band", "key").agg(F.count(F.lit(1)).alias("count"), F.min("id").alias("hub")).where("count > 1")
    return bands.join(full, ["band", "key"])


def _sets(docs: DataFrame, classes: DataFrame, ids: DataFrame) -> DataFrame:
    """id, items (the shingles) of classes asked for: a pass over the texts."""
    wanted = ids.join(classes.select("id", F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")), "id")
    if wanted.count() <= BROADCAST_IDS:
        wanted = F.broadcast(wanted)

    def items(batches):
        for batch in batches:
            sets = [shingles(word_numbers(folded((t or "").encode()))[0], WORDS).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["id", "items"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    texts = texts.join(wanted, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key")))
    return stored(texts.select("id", "text").mapInArrow(items, "id long, items binary").dropDuplicates(["id"]), "near-sets")


def _hub_links(docs: DataFrame, classes: DataFrame, buckets: DataFrame, percent: int) -> DataFrame:
    """x, y: links of classes with the hub of a bucket of theirs."""

    def likely(batches):
        for batch in batches:
            n, m = (np.asarray(batch.column(i)) for i in (2, 3))
            keep, _ = _alike(_registers(batch.column(4)), _registers(batch.column(5)), n, m, percent)
            yield batch.select([0, 1]).filter(pa.array(keep))

    def verify(batches):
        for batch in batches:
            a, b = ([np.frombuffer(s, np.uint64) for s in batch.column(i).to_pylist()] for i in (2, 3))
            yield batch.select([0, 1]).filter(pa.array([linked(p, q, percent) for p, q in zip(a, b, strict=True)], pa.bool_()))

    light = classes.select("id", "n", "regs")
    side = lambda d, c, *cols: d.select(F.col("id").alias(c), *[F.col(k).alias(f"{c}_{k}") for k in cols])
    pairs = buckets.where("id <> hub").select(F.col("id").alias("x"), F.col("hub").alias("y")).distinct()
    pairs = pairs.join(side(light, "x", "n", "regs"), "x").join(side(light, "y", "n", "regs"), "y").select("x", "y", "x_n", "y_n", "x_regs", "y_regs")
    found = stored(pairs.mapInArrow(likely, "x long, y long"), "hub-candidates")
    full = _sets(docs, classes, found.select(F.col("x").alias("id")).union(found.select("y")).distinct())
    both = found.join(side(full, "x", "items"), "x").join(side(full, "y", "items"), "y")
    return stored(both.select("x", "y", "x_items", "y_items").mapInArrow(verify, "x long, y long"), "hub-links")


_PAIR = ["band", "key", "ig", "ik", "jg", "jk"]


def _blocks(named: DataFrame) -> DataFrame:
    """band, key, a block pair (ig, ik, jg, jk), id, g, k: the classes (band, key, id, n, root) of buckets
    with several components, dealt into pairs of blocks. A block is (g, k): g a component that has a block's worth of the
    bucket, or -1, and k a number in it."""
    bucket = ["band", "key"]
    groups = named.groupBy(*bucket, "root").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("items"))
    worth = F.greatest(F.ceil(F.col("c") / BLOCK), F.least("c", F.ceil(F.col("items") / BLOCK_ITEMS)))
    groups = groups.withColumn("g", F.when((F.col("c") >= BLOCK) | (worth > 1), F.col("root")).otherwise(F.lit(-1)))
    several = groups.groupBy(*bucket).agg(F.count(F.lit(1)).alias("roots"), F.sum("c").alias("all")).where("roots > 1 AND all > 2").select(*bucket)
    own = groups.join(several, bucket)
    sizes = own.groupBy(*bucket, "g").agg(F.sum("c").alias("c"), F.sum("items").alias("items")).withColumn("blocks", worth.cast("int"))
    every = F.flatten(F.collect_list(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.col("g").alias("g"), k.alias("k")))))
    met = sizes.join(sizes.groupBy(*bucket).agg(every.alias("every")), bucket)
    met = met.select(*bucket, "g", "blocks", F.filter("every", lambda b: (b["g"] != F.col("g")) | (F.col("g") == -1)).alias("others"))
    placed = named.join(own.select(*bucket, "root", "g"), [*bucket, "root"]).join(met, [*bucket, "g"])
    d = placed.withColumn("k", F.pmod(F.hash("id"), F.col("blocks"))).withColumn("other", F.explode("others"))
    mine = F.struct("g", "k")
    i, j = F.least(mine, "other"), F.greatest(mine, "other")
    return d.select(*bucket, i["g"].alias("ig"), i["k"].alias("ik"), j["g"].alias("jg"), j["k"].alias("jk"), "id", "g", "k")


def _block_links(docs: DataFrame, classes: DataFrame, buckets: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """x, y: links between classes of different components, enough to connect all that are linked."""

    def pairs(key, rows):
        band, _, ig, ik, jg, jk = key
        ids, g, k, size, root = (np.asarray(rows.column(c)) for c in ("id", "g", "k", "n", "root"))
        left = np.flatnonzero((g == ig) & (k == ik))
        right = left if (ig, ik) == (jg, jk) else np.flatnonzero((g == jg) & (k == jk))
        return ids, _likely(band, left, right, size, root, _registers(rows.column("regs")), percent)

    def candidates(batches):
        for key, rows in _groups(batches, len(_PAIR)):
            _, (x, y, _) = pairs(key, rows)
            at = np.unique(np.concatenate([x, y])).astype(int)
            if len(at):
                yield from rows.select([*_PAIR, "id", "g", "k"]).take(at).combine_chunks().to_batches()

    def verify(batches):
        for key, rows in _groups(batches, len(_PAIR)):
            ids, (x, y, equal) = pairs(key, rows)
            sets = [np.frombuffer(s, np.uint64) for s in rows.column("items").to_pylist()]
            up, out = list(range(len(ids))), []

            def root(v):
                while up[v] != v:
                    up[v] = v = up[up[v]]
                return v

            for at in np.argsort(-equal, kind="stable"):
                p, q = int(x[at]), int(y[at])
                if root(p) != root(q) and linked(sets[p], sets[q], percent):
                    up[root(p)] = root(q)
                    out.append((int(ids[p]), int(ids[q])))
            if out:
                a, b = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["x", "y"])

    facts = classes.select("id", "n", "regs").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    named = stored(buckets.where("count > 2").select("band", "key", "id").join(facts.select("id", "n", "root"), "id"), "members")  # read several times below
    columns = [*_PAIR, "id", "g", "k", "n", "root", "regs"]
    dealt = _blocks(named).join(facts, "id").select(*columns)
    kinds = "band int, key long, ig long, ik int, jg long, jk int, id long, g long, k int"
    found = stored(dealt.repartition(*_PAIR).sortWithinPartitions(*_PAIR).mapInArrow(candidates, kinds), "near-candidates")
    full = _sets(docs, classes, found.select("id").distinct())
    both = found.join(full.join(facts, "id"), "id").select(*columns, "items")
    return both.repartition(*_PAIR).sortWithinPartitions(*_PAIR).mapInArrow(verify, "x long, y long").distinct()


def links(docs: DataFrame, classes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """x, y: links between classes, enough to connect all that are linked."""
    buckets = stored(_buckets(classes), "buckets")
    hubs = _hub_links(docs, classes, buckets, percent)
    roots = stored(components(hubs), "hub-roots")
    roots = roots.unionByName(roots.select(F.col("root").alias("id"), "root").distinct())
    return hubs.unionByName(_block_links(docs, classes, buckets, roots, percent))


def components(edges: DataFrame) -> DataFrame:
    """id, root of every id in edges (x, y): root is the smallest id it is connected to.
    Large-star and small-star contraction; each round is written to the shared folder."""
    e = stored(edges.where("x <> y").select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).distinct(), "edges")
    while True:
        mark = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("x", "y").cast("decimal(38,0)"))).first()
        if not mark[0]:
            break
        both = e.union(e.select("y", "x")).toDF("x", "y")
        low = both.groupBy("x").agg(F.least(F.min("y"), F.first("x")).alias("m"))
        big = both.join(low, "x").where("y > x").select(F.col("y").alias("x"), F.col("m").alias("y")).where("x <> y").distinct()
        low = big.groupBy("x").agg(F.min("y").alias("m"))
        small = big.join(low, "x").select(F.explode(F.array(F.struct("y", "m"), F.struct(F.col("x").alias("y"), "m"))).alias("p"))
        last, e = e, stored(small.select(F.col("p.y").alias("x"), F.col("p.m").alias("y")).where("x <> y").distinct(), "edges")
        release(last)
        if e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("x", "y").cast("decimal(38,0)"))).first() == mark:
            break
    return e.select(F.col("x").alias("id"), F.col("y").alias("root"))


def _labelled(docs: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """The sketches of all rows, and the classes with the label of their component:
    a, b, n_shingles, doc_id and text_key (the row that holds the class), component_id,
    and first (whether that row is the component's first)."""
    sk = stored(sketches(docs), "sketches")
    holder = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("r")
    classes = sk.where("n_shingles > 0").groupBy("a", "b", F.col("n_shingles").alias("n")).agg(holder, F.first("regs").alias("regs"))
    # the numbers are drawn while the table is written; whoever reads it finds the same ones
    classes = stored(classes.select("a", "b", "n", F.monotonically_increasing_id().alias("id"), "r.doc_id", "r.text_key", "regs"), "classes")
    roots = stored(components(links(docs, classes, percent)), "roots")
    members = roots.unionByName(roots.select(F.col("root").alias("id"), "root").distinct())
    light = classes.select("a", "b", F.col("n").alias("n_shingles"), "id", "doc_id", "text_key")
    held = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key", "id")
    least = members.join(light, "id").groupBy("root").agg(F.min(held).alias("least"))
    named = members.join(least, "root").select("id", F.col("least.doc_id").alias("name"), F.col("least.id").alias("lead"))
    named = light.join(named, "id", "left")
    alone = F.col("lead").isNull()
    return sk, named.select(
        "a", "b", "n_shingles", "doc_id", "text_key",
        F.when(alone, F.col("doc_id")).otherwise(F.col("name")).alias("component_id"),
        (alone | (F.col("lead") == F.col("id"))).alias("first"),
    )


def near_groups(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row per row of docs: doc_id, text_key, n_shingles, component_id, kept."""
    sk, named = _labelled(docs, percent)
    key = ["a", "b", "n_shingles"]
    out = sk.where("n_shingles > 0").join(named.select(*key, "component_id"), key).select("doc_id", "text_key", "n_shingles", "component_id")
    empty = sk.where("n_shingles = 0").select("doc_id", "text_key", "n_shingles", F.col("doc_id").alias("component_id"))
    return out.unionByName(empty).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """docs with one row of each component, and all empty texts. Rows go by an anti-join
    with the keys of those that don't hold their component; only rows alike in doc_id
    and text, of which one stays, are numbered."""
    sk, named = _labelled(docs, percent)
    key = ["a", "b", "n_shingles"]
    held = named.select(*key, F.struct("doc_id", "text_key").alias("holder"), "first")
    some = sk.where("n_shingles > 0").join(held, key)
    own = F.struct("doc_id", "text_key")
    id_, hash_, many, rest_ = free(docs, "_id", "_key", "_n", "_rest")
    named_ = (F.col("doc_id").alias(id_), F.col("text_key").alias(hash_))
    gone = some.where(~F.col("first") | ~own.eqNullSafe(F.col("holder"))).select(*named_).distinct()
    match = F.col("doc_id").cast("long").eqNullSafe(F.col(id_)) & (F.xxhash64("text") == F.col(hash_))
    kept = docs.join(gone, match, "left_anti")
    same = sk.where("n_shingles > 0").groupBy(*named_).agg(F.count(F.lit(1)).alias(many)).where(F.col(many) > 1)
    same = stored(same.drop(many), "repeated-rows")
    if same.isEmpty():
        return kept
    rest = [F.col(c).cast("string") for c in docs.columns if c not in ("doc_id", "text")]
    once = kept.join(same, match).withColumn(rest_, F.xxhash64(*rest) if rest else F.lit(0)).groupBy(id_, hash_)
    once = once.agg(F.min_by(F.struct(*docs.columns), rest_).alias("r")).select("r.*")
    return kept.join(same, match, "left_anti").unionByName(once)


def op9(spark, sf_dir: str) -> DataFrame:
    return near_groups(read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_shingles", "component_id", "kept")
