"""Packing by power-of-two decomposition.

A document of n tokens (its ids, then the end id) is cut into pieces of 2048 and
then one piece for every binary digit of the rest, longest first. Every piece is a
sequence of its own: no sequence crosses documents, and as each length is a power
of two none is padded. Sequences are numbered so that equal lengths lie together,
the buckets from which batches of one length are drawn; inside a bucket they follow doc_id, or a
given order (the curriculum's, in the pipeline).

Null or empty texts hold the end id alone. Rows that repeat a doc_id are documents
of their own, told apart by a fingerprint of the text; whole rows repeated get
sequences of their own too. Other columns of the input are ignored, but for the order's.
"""

from __future__ import annotations

import functools
import re
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import range_blocks, stored

MAX_LEN, END_ID = 2048, 1
#: Pieces of a range block, about; blocks and lengths up to which their numbers are sent to every executor.
BLOCK_PIECES, BROADCAST_BLOCKS = 250_000, 100_000
#: Words kept with their ids in each Python worker, about 60 MB.
CACHE = 300_000
#: The vocabulary's own word rule, written out for ASCII and Latin-1 letters; a text with other characters goes to the library whole.
_PLAIN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[0-9]+| ?[^ \t\n\x0b\x0c\rA-Za-zÀ-ÖØ-öø-ÿ0-9]+|[ \t\n\x0b\x0c\r]+(?![^ \t\n\x0b\x0c\r])|[ \t\n\x0b\x0c\r]+")
_OTHER = re.compile(r"[^\x00-\x7FÀ-ÖØ-öø-ÿ]")


class Encoder(dict):
    """Text to little-endian unsigned 32-bit ids, as `tokenizers` gives them for the
    JSON vocabulary with add_special_tokens=False. Byte-pair merges stay inside a
    word, so a word's ids are looked up in a bounded cache; a miss is merged by
    tiktoken over the same vocabulary, and texts out of the plain rule's reach
    (other scripts, the end marker's own string) by `tokenizers` itself."""

    def __init__(self, folder: str | None = None):
        import base64
        import os

        import public_tokenizers as public
        import tiktoken
        from tokenizers import Tokenizer

        at = (lambda name: os.path.join(folder, name)) if folder else public.path
        with open(at("byte_bpe_50k.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.merge = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.whole = Tokenizer.from_file(at("byte_bpe_50k.json"))

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHE:
            self.clear()
        got = self[word] = struct.pack(f"<{len(ids := self.merge._encode_single_piece(word))}I", *ids)
        return got

    def ids(self, text: str) -> bytes:
        if "<|endoftext|>" in text or _OTHER.search(text):
            import numpy as np

            return np.asarray(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(map(self.__getitem__, _PLAIN.findall(text)))


@functools.lru_cache(maxsize=1)
def encoder(folder: str | None = None) -> Encoder:
    """One a Python worker: vocabulary and cache outlive a task."""
    return Encoder(folder)


def cuts(n: int, max_len: int = MAX_LEN) -> Iterator[tuple[int, int]]:
    """(start, length) of each piece of a document of n tokens; max_len is a power of two."""
    at = 0
    while n - at >= max_len:
        yield at, max_len
        at += max_len
    step = max_len // 2
    while step:
        if (n - at) & step:
            yield at, step
            at += step
        step //= 2


def pieces(docs: DataFrame, folder: str | None = None, max_len: int = MAX_LEN, end_id: int = END_ID, with_ids: bool = True, order: Column | None = None) -> DataFrame:
    """Pieces with their ids: doc_id, text_key, at (the order given, else doc_id), start, length,
    ids_crc32, doc_tokens and, with with_ids, ids array<int>. One pass, no shuffle."""
    if max_len < 1 or max_len & (max_len - 1):
        raise ValueError("max_len must be a power of two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        encode, end = encoder(folder), end_id.to_bytes(4, "little")
        schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("at", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())] + [("ids", pa.list_(pa.int32()))] * with_ids)
        for batch in batches:
            out: list[tuple] = []
            for doc, key, place, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids = encode.ids(text or "") + end
                n = len(ids) // 4
                for at, size in cuts(n, max_len):
                    part = ids[4 * at : 4 * (at + size)]
                    out.append((doc, key, place, at, size, zlib.crc32(part), n) + ((np.frombuffer(part, "<u4").astype("i4"),) * with_ids))
            cols = list(zip(*out, strict=True)) or [[]] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    doc = F.col("doc_id").cast("long")
    kinds = "doc_id long, text_key long, at long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids
    return docs.select(doc, F.xxhash64("text").alias("text_key"), (doc if order is None else order.cast("long")).alias("at"), "text").mapInArrow(run, kinds)


def pack(docs: DataFrame, folder: str | None = None, max_len: int = MAX_LEN, with_ids: bool = False, order: Column | None = None) -> DataFrame:
    """Every piece as a sequence: the columns of `pieces` with sequence_id (0, 1, ..., longest
    bucket first, then by the order, a long column of docs, or doc_id, and start) and offset 0. The
    numbers come from counts by length and range block, of which there are as many as
    BLOCK_PIECES asks for, and a row number inside each block. An empty input gives no rows."""
    found = stored(pieces(docs, folder, max_len, with_ids=with_ids, order=order), "pieces")
    rows = found.count()
    found, _ = range_blocks(found, max(1, -(-rows // BLOCK_PIECES)), max(1, rows), "at", "text_key")
    counts = stored(found.groupBy("length", "block").count(), "block-counts")
    before, total = [], 0
    for r in sorted(counts.groupBy("length").agg(F.sum("count").alias("n")).collect(), key=lambda r: -r["length"]):  # a row a power of two
        before.append((r["length"], total))
        total += r["n"]
    if not before:
        return found.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")}).drop("block", "text_key", "at")
    start = F.broadcast(found.sparkSession.createDataFrame(before, "length long, bucket long"))
    inside = F.sum("count").over(W.partitionBy("length").orderBy("block")) - F.col("count")
    base = counts.join(start, "length").select("length", "block", (F.col("bucket") + inside).alias("base"))
    base = F.broadcast(base) if counts.count() <= BROADCAST_BLOCKS else base
    order_ = W.partitionBy("length", "block").orderBy(F.col("at").asc_nulls_first(), "doc_id", "text_key", "start", "ids_crc32")
    return (
        found.withColumn("rank", F.row_number().over(order_))
        .join(base, ["length", "block"])
        .withColumn("sequence_id", F.col("base") + F.col("rank") - 1)
        .withColumn("offset", F.lit(0).cast("long"))
        .drop("base", "rank", "block", "text_key", "at")
    )


def op8(spark, sf_dir: str) -> DataFrame:
    from .common import read

    return pack(read(spark, sf_dir, "documents")).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
