"""Line dedup over the whole corpus, in DataFrame functions only.

Lines are split at \\n; a line's key is the line stripped of white space at both
ends and lower-cased (A-Z). Keys of at least min_chars code points that at least
min_docs documents hold lose all their lines except in the largest doc_id holding
them. The other lines stay in place.

Null text: one empty line, kept; the text returned is then null as it was given
(the query's digest takes it as empty). Rows that repeat a doc_id count as one
document, and each is cut by its own text. Null doc_ids count as one document, which
is smaller than any other. Other columns pass through untouched, but for
n_lines and n_dropped, which are this operator's. An empty table gives
an empty table; very long texts are arrays of lines of one row and nothing more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WS, free, lower_ascii, read, stored

MIN_CHARS, MIN_DOCS = 20, 3


def _key(line: Column) -> Column:
    return lower_ascii(F.btrim(line, F.lit(WS)))


def _long_keys(docs: DataFrame, min_chars: int) -> DataFrame:
    """doc, row, pos, a, b: one row per line long enough; a and b are the 128 bits that stand for its key."""
    lines = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc"),
        F.xxhash64("text").alias("row"),
        F.posexplode(F.split(F.col("text"), "\n", -1)).alias("pos", "line"),
    ).withColumn("key", F.btrim("line", F.lit(WS)))
    return (
        lines.where(F.length("key") >= min_chars)
        .withColumn("key", lower_ascii(F.col("key")))
        .select("doc", "row", "pos", F.xxhash64("key").alias("a"), F.xxhash64(F.lit("b"), "key").alias("b"))
    )


def common_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """a, b, docs, keeper of the keys found in at least min_docs documents. Rows are
    first reduced by key and document, which deals a hot key over all tasks, then by key."""
    once = _long_keys(docs, min_chars).select("a", "b", "doc").distinct()
    return once.groupBy("a", "b").agg(F.count(F.lit(1)).alias("docs"), F.max("doc").alias("keeper")).where(F.col("docs") >= min_docs)


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """docs with their texts cut, and the long columns n_lines and n_dropped. The only
    rows that meet again by document are those of lines dropped."""
    docs = docs.drop("n_lines", "n_dropped")
    doc, row, at, held = free(docs, "_doc", "_row", "_at", "_lines")
    common = stored(common_lines(docs, min_chars, min_docs), "common-lines")  # plain exchanges let Spark split a hot line's rows
    gone = (
        _long_keys(docs, min_chars)
        .join(common, ["a", "b"])
        .where(F.col("doc") != F.col("keeper"))
        .groupBy(F.col("doc").alias(doc), F.col("row").alias(row))
        .agg(F.collect_set("pos").alias(at))
    )
    keyed = docs.withColumn(doc, F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))).withColumn(row, F.xxhash64("text"))
    lines = F.split(F.col("text"), "\n", -1)
    stay = F.transform(F.array_except(F.sequence(F.lit(0), F.size(held) - 1), F.col(at)), lambda i: F.get(held, i))
    cut = (
        keyed.join(gone, [doc, row], "left")
        .withColumn("n_lines", F.coalesce(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1, F.lit(1)).cast("long"))
        .withColumn("n_dropped", F.coalesce(F.size(at), F.lit(0)).cast("long"))
        .withColumn(held, F.when(F.col(at).isNotNull(), lines))
        .withColumn("text", F.when(F.col(at).isNotNull(), F.array_join(stay, "\n")).otherwise(F.col("text")))
    )
    return cut.select(*docs.columns, "n_lines", "n_dropped")


def op10(spark, sf_dir: str) -> DataFrame:
    out = dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP10_SQL = r"""
WITH lines AS (
  SELECT doc_id, i AS pos, parts[i] AS line FROM (
    SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i
    FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents))),
keyed AS (
  SELECT doc_id, pos, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
common AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (
  SELECT k.doc_id, k.pos, k.line, c.key IS NOT NULL AND k.doc_id <> c.keeper AS gone
  FROM keyed k LEFT JOIN common c ON k.key = c.key)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
