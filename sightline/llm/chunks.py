"""Substring dedup by content-defined chunks.

A gear hash rolls over the UTF-8 bytes: h = 2 h + gear[byte] in 32 bits, so that it
depends on the last 32 bytes alone. A chunk ends where no hash of the REACH bytes on
either side is above it, so that a cut follows from the bytes near it and from nothing
before, and after MOST bytes in any case. Where a few words go on repeating, equal
hashes tie; there a cut follows the last one by over REACH bytes, a whole number of
rounds, so that these chunks are alike too. Chunks are told apart by 64-bit
digests; a digest held by two or more documents is a repeat, and the document with the
smallest doc_id keeps it.

Repeated chunks are anchors only. Where a row of them starts or ends, or goes over to
another partner (the keeper; for the keeper itself the largest doc_id that holds the
chunk), the text is compared byte by byte with the partner's, CONTEXT bytes far at most,
at the chunk's first place there. Chunks and what they were extended by make the spans;
spans still under SPAN bytes say nothing (a sentence, or two digests that met
by chance) and are left alone; fewer than 1 in 1,000 passages of 51 words are as short. Ends are exact against that one partner: bytes that only
a third document shares beside a chunk whose keeper is another are not added, and where
one word goes on repeating a few of its rounds may be missing.

Null and empty texts have no chunks. Repeats inside one document are not repeats here;
rows that share a doc_id count as one document, and so do rows with a null one, which is smaller
than any other; each row is cut by its own text. Positions and lengths are in bytes.
Texts are chunked whole, one row at a time. An empty table has no spans. Other columns
pass through `cut_repeats`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import free, read, stored

REACH, MOST, CONTEXT, SPAN = 20, 1024, 256, 140
_GEAR = np.random.default_rng(7).integers(0, 2**32, 256, dtype=np.uint32)


#: Stands for a null doc_id inside.
NONE = -(1 << 63)


def _doc() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NONE))


def _named(c: str) -> Column:
    return F.when(F.col(c) != NONE, F.col(c)).alias(c)


def _highest(x: np.ndarray, width: int) -> np.ndarray:
    """The maximum of every `width` neighbours."""
    n = 1
    while n < width:
        step = min(n, width - n)
        x, n = np.maximum(x[:-step], x[step:]), n + step
    return x


def ends(data: bytes, reach: int = REACH, most: int = MOST) -> list[int]:
    """Where the chunks of data end, in order; the last end is len(data)."""
    if not data:
        return []
    h = _GEAR[np.frombuffer(data, np.uint8)]
    for k in (1, 2, 4, 8, 16):  # sums over windows of 2, 4, ... 32 bytes
        h[k:] = h[k:] + (h[:-k] << np.uint32(k)) if len(h) > k else h[k:]
    out, last, cut = [], 0, 0
    if len(h) > 2 * reach:
        around, mid = _highest(h, reach), h[reach : len(h) - reach]
        cuts = np.flatnonzero((mid >= around[: len(mid)]) & (mid >= around[reach + 1 :])) + reach + 1
    else:
        cuts = np.zeros(0, np.int64)
    for at in cuts.tolist():
        if at - cut <= reach:
            continue
        while at - last > most:
            last += most
            out.append(last)
        out.append(at)
        last = cut = at
    while len(data) - last > most:
        last += most
        out.append(last)
    return out + [len(data)] * (last < len(data))


def digested(data: bytes) -> tuple[list[int], np.ndarray]:
    """The ends and the digests of the chunks of data."""
    at = ends(data)
    return at, np.array([xxhash.xxh3_64_intdigest(data[s:e]) for s, e in zip([0, *at], at, strict=False)], np.uint64).view(np.int64)


def chunks(docs: DataFrame) -> DataFrame:
    """doc_id (NONE for null), text_key, start, length, digest: a row per chunk; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stops, digests = [], []
            for text in batch.column(2).to_pylist():
                at, of = digested((text or "").encode())
                stops.append(at)
                digests.append(of)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(stops, pa.list_(pa.int32())), pa.array(digests, pa.list_(pa.int64()))], names=["doc_id", "text_key", "stops", "digests"])

    per_doc = docs.select(_doc().alias("doc_id"), F.xxhash64("text").alias("text_key"), "text").mapInArrow(run, "doc_id long, text_key long, stops array<int>, digests array<long>")
    start = F.when(F.col("i") == 0, 0).otherwise(F.get("stops", F.col("i") - 1))
    return per_doc.select("doc_id", "text_key", "stops", F.posexplode("digests").alias("i", "digest")).select(
        "doc_id", "text_key", start.alias("start"), (F.get("stops", "i") - start).alias("length"), "digest"
    )


def alike(a: bytes, b: bytes) -> int:
    """How many first bytes a and b share."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return int(np.argmax(np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)))


def _beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What stands before (side 0) or after (side 1) the first place of chunks asked for."""
    for batch in batches:
        out = []
        for doc, items, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            data = (text or "").encode()
            at, of = digested(data)
            first = dict(zip(reversed(of.tolist()), zip([0, *at][-2::-1], reversed(at), strict=True), strict=True))
            for c in items:
                if c["digest"] in first:
                    s, e = first[c["digest"]]
                    out.append((c["digest"], doc, c["side"], data[e : e + CONTEXT] if c["side"] else data[max(0, s - CONTEXT) : s]))
        cols = list(zip(*out, strict=True)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["digest", "partner", "side", "near"])


def _extended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What goes on alike before or after a chunk."""
    for batch in batches:
        out = []
        for doc, key, items, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            data = text.encode()
            for c in items:
                s, e = c["start"], c["start"] + c["length"]
                if c["side"]:
                    out.append((doc, key, e, e + alike(data[e : e + CONTEXT], c["near"]), c["keeper"]))
                else:
                    out.append((doc, key, s - alike(data[max(0, s - CONTEXT) : s][::-1], c["near"][::-1]), s, c["keeper"]))
        cols = list(zip(*out, strict=True)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "text_key", "start", "stop", "keeper"])


def repeats(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, start, stop, keeper, n: rows of n repeated chunks that have the
    same partner, and (n = 0) the bytes beside them that are alike too."""
    every = chunks(docs)
    common = every.groupBy("digest").agg(F.min("doc_id").alias("keeper"), F.max("doc_id").alias("other")).where("keeper < other")
    common = stored(common, "common-chunks")  # a plain exchange on either side of the join lets Spark split a hot digest's rows
    hit = every.join(common, "digest").withColumn("partner", F.when(F.col("keeper") < F.col("doc_id"), F.col("keeper")).otherwise(F.col("other"))).drop("other")
    hit = hit.withColumn("stop", F.col("start") + F.col("length")).repartition("doc_id", "text_key").distinct()
    order = W.partitionBy("doc_id", "text_key").orderBy("start")
    of = lambda at: F.struct(F.col(at).alias("at"), "keeper", "partner")
    hit = hit.withColumns({"opens": ~F.lag(of("stop")).over(order).eqNullSafe(of("start")), "closes": ~F.lead(of("start")).over(order).eqNullSafe(of("stop")), "i": F.row_number().over(order)})
    ends_ = hit.where("opens or closes")  # a row's first and last chunk, in turn
    last = F.when(F.col("closes"), F.struct("stop", "i")).otherwise(F.lead(F.struct("stop", "i")).over(order))
    edge = stored(ends_.withColumn("last", last).drop("stop"), "edge-chunks")
    sides = F.filter(F.array(F.when(F.col("opens"), 0), F.when(F.col("closes"), 1)), lambda x: x.isNotNull())
    edges = edge.select("doc_id", "text_key", "start", "length", "keeper", "digest", "partner", F.explode(sides).alias("side"))
    asked = edges.select("digest", "partner", "side").distinct().groupBy("partner").agg(F.collect_list(F.struct("digest", "side")).alias("items"))
    texts = docs.select(_doc().alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    beside = asked.join(texts, F.col("doc_id") == F.col("partner")).select("partner", "items", "text").mapInArrow(_beside, "digest long, partner long, side int, near binary")
    beside = stored(beside.dropDuplicates(["digest", "partner", "side"]), "beside")
    more = edges.join(beside, ["digest", "partner", "side"]).groupBy(F.col("doc_id").alias("__sl_id"), F.col("text_key").alias("__sl_key"))
    more = more.agg(F.collect_list(F.struct("start", "length", "keeper", "side", "near")).alias("items"))
    own = texts.join(more, F.col("doc_id").eqNullSafe(F.col("__sl_id")) & (F.col("text_key") == F.col("__sl_key"))).select("doc_id", "text_key", "items", "text")
    more = own.mapInArrow(_extended, "doc_id long, text_key long, start long, stop long, keeper long").where("start < stop").distinct()
    rows = edge.where("opens").select("doc_id", "text_key", F.col("start").cast("long"), F.col("last.stop").cast("long").alias("stop"), "keeper", (F.col("last.i") - F.col("i") + 1).alias("n"))
    return rows.unionByName(more.withColumn("n", F.lit(0)))


def _runs(found: DataFrame) -> DataFrame:
    """found with run, the number of the unbroken stretch of its document that a row lies in."""
    order = W.partitionBy("doc_id", "text_key").orderBy("start", "stop", "n", "keeper")
    reached = F.max("stop").over(order.rowsBetween(W.unboundedPreceding, -1))
    return found.withColumn("fresh", F.coalesce((reached < F.col("start")).cast("int"), F.lit(1))).withColumn("run", F.sum("fresh").over(order)).drop("fresh")


def spans(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """doc_id, text_key, start, length, n_chunks, first_doc_id, removable: the repeated
    spans of every document. n_chunks counts whole chunks; removable is how many of its
    bytes a smaller doc_id keeps; first_doc_id is the smallest doc_id that holds any of
    its chunks."""
    lost = F.col("keeper") < F.col("doc_id")
    order = W.partitionBy("doc_id", "text_key").orderBy("start", "stop", "n", "keeper").rowsBetween(W.unboundedPreceding, -1)
    reached = F.coalesce(F.max(F.when(lost, F.col("stop"))).over(order), F.lit(0))
    gone = F.when(lost, F.greatest(F.lit(0), F.col("stop") - F.greatest("start", reached))).otherwise(0)
    return (
        _runs(repeats(docs)).withColumn("gone", gone)
        .groupBy("doc_id", "text_key", "run")
        .agg(
            F.min("start").alias("start"),
            (F.max("stop") - F.min("start")).cast("long").alias("length"),
            F.sum("n").alias("n_chunks"),
            F.min("keeper").alias("first_doc_id"),
            F.sum("gone").cast("long").alias("removable"),
        )
        .where(F.col("length") >= span)
        .select(_named("doc_id"), "text_key", "start", "length", "n_chunks", _named("first_doc_id"), "removable")
    )


def cut_repeats(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """docs without the stretches of span bytes or more that smaller doc_ids keep, also
    where a stretch touches repeats that the document keeps itself. A code point cut
    in two by a stretch's edge goes with the stretch."""
    lost = _runs(repeats(docs).where("keeper < doc_id")).groupBy("doc_id", "text_key", "run").agg(F.min("start").alias("start"), (F.max("stop") - F.min("start")).alias("length"))
    id_, key, cuts_ = free(docs, "_id", "_key", "_cuts")
    gone = lost.where(F.col("length") >= span).groupBy(F.col("doc_id").alias(id_), F.col("text_key").alias(key)).agg(F.sort_array(F.collect_list(F.struct("start", "length"))).alias(cuts_))

    @F.pandas_udf("string")
    def without(text, cuts):
        def one(t, at):
            if at is None:
                return t
            data, out, last = t.encode(), [], 0
            for c in at:
                out.append(data[last : c["start"]])
                last = c["start"] + c["length"]
            return b"".join([*out, data[last:]]).decode(errors="ignore")

        return text.combine(cuts, one)

    joined = docs.join(gone, (_doc() == F.col(id_)) & (F.xxhash64("text") == F.col(key)), "left")
    return joined.withColumn("text", F.when(F.col(cuts_).isNull(), F.col("text")).otherwise(without("text", cuts_))).select(*docs.columns)


def op7(spark, sf_dir: str) -> DataFrame:
    return spans(read(spark, sf_dir, "documents").select("doc_id", "text")).drop("text_key")
