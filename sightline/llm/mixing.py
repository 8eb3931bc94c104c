"""Mixing sources to target weights along a time-varying curriculum.

Each source has a weight, which fixes how many words the mix takes from it, and a
schedule, a weight over training time that runs linearly from `first` at time 0 to
`last` at time 1. The integral of the schedule is the source's cumulative demand; a
document whose words lie around fraction u of what the source gives gets the time at
which that demand reaches u. Documents are then range-sorted by that position.

Targets: the shares of share x all words by weight, none above max_repeat times its
source's words; what is cut goes to the others by weight until none is above. Sources
are ranked, and their targets found, as a table: the driver sees a few sums. A
source's documents are taken in an order fixed by a hash of doc_id and text, whole
passes first; in the last pass a document is taken if its middle word lies before the
target, so taken words miss the target by at most half a document.

Running sums are kept per source and hash bucket, of which there are as many as
BUCKET_ROWS asks for and BUCKETS at least, so that a source with a third of all rows is summed by many tasks.
Rows alike in doc_id, text and source stand one behind the other and are taken each
by its own middle word; a long row of them is dealt out before it is written one by one.

Null texts have size 0; null sources are one source, last by code point. Rows that share a
doc_id only are documents of their own. Very long texts are counted whole, in one row. An
empty table, or one without words, gives targets of 0 and takes no words. Other columns
pass through `mix`, where rows alike in doc_id, text and source are all given the columns of
one of them; a column named position is replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD_RE, free, read, stored

WEIGHTS, SHARE, MAX_REPEAT = (5, 2, 1), 1.5, 2
#: (first, last) of the schedule that goes with each of WEIGHTS: heavy sources evenly, light ones later and later.
SCHEDULES = ((1.0, 1.0), (0.5, 1.5), (0.0, 2.0))
#: Rows of a bucket, about, and how many buckets there are at least; equal rows written by one task; sources up to which their table is sent to every executor.
BUCKET_ROWS, BUCKETS, EQUAL_ROWS, BROADCAST_SOURCES = 20_000, 256, 4096, 100_000


def targets(sizes: DataFrame, weights=WEIGHTS, schedules=SCHEDULES, share: float = SHARE, max_repeat: float = MAX_REPEAT) -> DataFrame:
    """sizes (source, words) with target, and first and last of its schedule. Weights and
    schedules repeat over sources in order of code points, null last."""
    order = (F.col("source").isNull(), F.col("source"))
    s = stored(sizes.repartitionByRange(*order).withColumn("pid", F.spark_partition_id()), "sources")
    before = s.groupBy("pid").count().withColumn("base", F.sum("count").over(W.orderBy("pid")) - F.col("count"))  # a row a partition
    rank = F.row_number().over(W.partitionBy("pid").orderBy(*order)) - 1 + F.col("base")
    of = lambda values: F.get(F.array(*[F.lit(float(v)) for v in values]), F.pmod(F.col("rank"), F.lit(len(weights))).cast("int"))
    s = s.join(F.broadcast(before.drop("count")), "pid").withColumn("rank", rank)
    s = stored(s.select("source", "words", of(weights).alias("weight"), of([a for a, _ in schedules]).alias("first"), of([z for _, z in schedules]).alias("last")), "ranked-sources")
    cap, some = max_repeat * F.col("words"), F.col("words") > 0
    total = share * float(s.agg(F.sum("words")).first()[0] or 0)
    unit, full = 0.0, -1
    while True:  # each round either caps another source or is the last
        over = some & (unit * F.col("weight") > cap)
        r = s.agg(F.count_if(over).alias("full"), F.sum(F.when(over, cap)).alias("capped"), F.sum(F.when(some & ~over, F.col("weight"))).alias("open")).first()
        if r["full"] == full or not r["open"]:
            break
        full, unit = r["full"], (total - float(r["capped"] or 0)) / r["open"]
    goal = F.when(~some, 0.0).when(unit * F.col("weight") > cap, cap).otherwise(unit * F.col("weight")).cast("double")
    return s.select("source", F.col("words").alias("source_size"), goal.alias("target"), "first", "last")


def _sized(docs: DataFrame) -> DataFrame:
    """One row per distinct (doc_id, text_key, source): size, and rows, how many input rows it stands for."""
    sized = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64("text").alias("text_key"),
        "source",
        F.coalesce(F.regexp_count("text", F.lit(WORD_RE)), F.lit(0)).cast("long").alias("size"),
    )
    return stored(sized.groupBy("doc_id", "text_key", "source").agg(F.first("size").alias("size"), F.count(F.lit(1)).alias("rows")), "sizes")


def plan(docs: DataFrame, weights=WEIGHTS, schedules=SCHEDULES, share: float = SHARE, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """One row per row of docs: doc_id, text_key, source, rows (how many are alike), size,
    source_size, target, copies, positions array<double> in [0, 1]."""
    return _planned(_sized(docs), weights, schedules, share, max_repeat)


def _planned(sized: DataFrame, weights, schedules, share, max_repeat) -> DataFrame:
    words = F.col("size") * F.col("rows")
    goals = stored(targets(sized.groupBy("source").agg(F.sum(words).alias("words")), weights, schedules, share, max_repeat), "targets")
    table = goals.withColumnRenamed("source", "s_source")
    if goals.count() <= BROADCAST_SOURCES:
        table = F.broadcast(table)
    facts = sized.agg(F.count(F.lit(1)).alias("n"), F.max("rows").alias("most")).first()
    h = F.xxhash64("doc_id", "text_key")
    hashed = sized.withColumn("h", h).withColumn("bucket", F.pmod(F.shiftrightunsigned(h, 20), F.lit(max(BUCKETS, -(-facts["n"] // BUCKET_ROWS)))))
    sums = hashed.groupBy("source", "bucket").agg(F.sum(words).alias("words"))
    before = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("b_source"), F.col("bucket").alias("b_bucket"), F.coalesce(F.sum("words").over(before), F.lit(0)).alias("base"))
    inside = W.partitionBy("source", "bucket").orderBy("h", "doc_id", "text_key").rowsBetween(W.unboundedPreceding, -1)
    placed = (
        hashed.withColumn("within", F.coalesce(F.sum(words).over(inside), F.lit(0)))
        .join(sums, F.col("source").eqNullSafe(F.col("b_source")) & (F.col("bucket") == F.col("b_bucket")))
        .join(table, F.col("source").eqNullSafe(F.col("s_source")))
    )
    row = lambda lo, hi, step=1: F.explode(F.sequence(lo, hi, F.lit(step).cast("long")))
    if (facts["most"] or 0) > EQUAL_ROWS:
        placed = placed.withColumn("part", row(F.lit(0).cast("long"), F.col("rows") - 1, EQUAL_ROWS)).repartition("h", "part")
        placed = placed.withColumn("row", row(F.col("part"), F.least(F.col("rows"), F.col("part") + EQUAL_ROWS) - 1))
    else:
        placed = placed.withColumn("row", row(F.lit(0).cast("long"), F.col("rows") - 1))
    middle = (F.col("base") + F.col("within") + F.col("size") * (F.col("row") + 0.5)).cast("double")
    turns = F.transform(F.sequence(F.lit(0), F.lit(max_repeat - 1)), lambda k: F.col("middle") + k * F.col("source_size"))
    a, d = F.col("first"), F.col("last") - F.col("first")
    mean = (F.col("first") + F.col("last")) / 2

    def time_of(x):  # inverse of the integral a t + d t^2 / 2, as a share of its whole
        u = F.when(F.col("target") > 0, x / F.col("target")).otherwise(F.lit(0.0)) * mean
        return F.least(F.lit(1.0), F.when(F.abs(d) < 1e-12, u / mean).otherwise((F.sqrt(F.greatest(F.lit(0.0), a * a + 2 * d * u)) - a) / F.when(F.abs(d) < 1e-12, F.lit(1.0)).otherwise(d)))

    return (
        placed.withColumn("middle", middle)
        .withColumn("turns", F.filter(turns, lambda x: x < F.col("target")))
        .withColumn("copies", F.size("turns"))
        .withColumn("positions", F.transform("turns", time_of))
        .select("doc_id", "text_key", "source", "rows", "size", "source_size", "target", "copies", "positions")
    )


def mix(docs: DataFrame, weights=WEIGHTS, schedules=SCHEDULES, share: float = SHARE, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """The mixed corpus: docs' rows, each once per copy taken, range-sorted by the
    extra column position. The only wide moves of the texts are the join with the
    plan and the range sort."""
    docs = docs.drop("position")
    sized = _sized(docs)
    planned = _planned(sized, weights, schedules, share, max_repeat).where("copies > 0")
    *key, many, at, rest_ = free(docs, "_id", "_key", "_source", "_rows", "_at", "_rest")
    taken = planned.select(F.col("doc_id").alias(key[0]), F.col("text_key").alias(key[1]), F.col("source").alias(key[2]), F.col("rows").alias(many), F.col("positions").alias(at))
    own = (F.col("doc_id").cast("long"), F.xxhash64("text"), F.col("source"))
    on = own[0].eqNullSafe(F.col(key[0])) & (own[1] == F.col(key[1])) & own[2].eqNullSafe(F.col(key[2]))
    spread = lambda d: d.select(*docs.columns, F.explode(at).alias("position"))
    if sized.where("rows > 1").isEmpty():
        out = spread(docs.join(taken, on))
    else:  # of rows alike one stands for all, and is taken as often as they are together
        taken = stored(taken, "taken")
        alike = taken.where(F.col(many) > 1)
        rest = [F.col(c).cast("string") for c in docs.columns if c not in ("doc_id", "text", "source")]
        one = docs.join(alike.select(*key).distinct(), on).withColumn(rest_, F.xxhash64(*rest) if rest else F.lit(0))
        one = one.groupBy(*key).agg(F.min_by(F.struct(*docs.columns), rest_).alias("r")).select("r.*")
        out = spread(docs.join(taken.where(F.col(many) == 1), on)).unionByName(spread(one.join(alike, on)))
    return out.repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id")


def op3(spark, sf_dir: str) -> DataFrame:
    """The plan in training order, documents by their first position, those not taken last."""
    p = plan(read(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    first = F.coalesce(F.get("positions", F.lit(0)), F.lit(2.0))
    out = p.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "positions")
    return out.repartitionByRange(first, "doc_id").sortWithinPartitions(first, "doc_id")
