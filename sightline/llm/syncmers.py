"""Document fingerprints from closed syncmers, in DataFrame functions only.

A text is a sequence of symbols: its words, but code points one by one where a word is
longer than 32 of them, so that texts without spaces have anchors too. Every run of
S symbols has a hash. A run of K symbols is an anchor if the smallest hash among
its inner runs of S stands first or last: that depends on nothing outside the run, so
an edit moves only the anchors it touches. A fingerprint is the list of anchors in
order of the text, each 32 bits and its place among the symbols.

Likeness matches by position: of the anchors that two fingerprints share (each taken at
its first place), those count that stand in the same order in both as the shared one before
or after them, so that an anchor met by chance elsewhere doesn't. It is their number over that of
all distinct anchors of either: 1 for equal texts.

Null and blank texts have an empty fingerprint; two empty ones are alike (1), an empty
one and another are not (0). A text of fewer than K symbols is one anchor of
all of them; a longer one in which no run qualifies has its first run of K with the
smallest inner hash. Very long texts are arrays of one row and nothing more. Other columns
are ignored; an empty table gives an empty table. Documents that share a doc_id are
ordered by their texts' hashes, and rows alike in both are neighbours; null doc_ids come last.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import range_blocks, read, stored

K, S = 7, 2
#: Code points of a range block, about, and how many blocks there are at most (beyond, blocks grow and their sorts spill).
BLOCK_CHARS, BLOCKS = 8 << 20, 1 << 16
#: Words up to 32 code points, else single code points.
SYMBOL_RE = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D]{1,32}(?![^\x20\x09-\x0D])|[^\x20\x09-\x0D]"


def fingerprint(df: DataFrame, text: str, out: str, k: int = K, s: int = S) -> DataFrame:
    """df with the column out: array<long> of the anchors of the column text, each with its place
    among the symbols in the low 32 bits."""
    n, span = f"_{out}_n", k - s
    hashes, inner, runs = f"_{out}_h", f"_{out}_s", f"_{out}_r"
    more = lambda a, count: "".join(f", get({a}, i + {j})" for j in range(1, count))
    least = f"least(get({inner}, i){more(inner, span + 1)})"
    edge = f"(get({inner}, i) = {least} OR get({inner}, i + {span}) = {least})"
    return (
        df.withColumn(hashes, F.transform(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(SYMBOL_RE), F.lit(0)), lambda x: F.xxhash64(x)))
        .withColumn(n, F.size(hashes))
        .withColumn(inner, F.expr(f"transform({hashes}, (x, i) -> CASE WHEN i + {s} <= {n} THEN xxhash64(x{more(hashes, s)}) END)"))
        .withColumn(runs, F.expr(f"CASE WHEN {n} >= {k} THEN filter(sequence(0, {n} - {k}), i -> {edge}) END"))
        .withColumn(
            out,
            F.expr(f"""CASE WHEN {n} = 0 THEN cast(array() AS array<bigint>)
              WHEN {n} < {k} THEN array(shiftleft(cast(hash({hashes}) AS bigint), 32))
              WHEN size({runs}) > 0 THEN transform({runs}, i -> shiftleft(cast(hash(get({hashes}, i){more(hashes, k)}) AS bigint), 32) | i)
              ELSE transform(array(array_min(transform(sequence(0, {n} - {k}), i -> struct({least} AS m, i AS i, hash(get({hashes}, i){more(hashes, k)}) AS h)))), x -> shiftleft(cast(x.h AS bigint), 32) | x.i) END"""),
        )
        .drop(hashes, n, inner, runs)
    )


def with_likeness(df: DataFrame, a: str, b: str, out: str) -> DataFrame:
    """df with the column out: how alike the fingerprints a and b are, 0 to 1. All steps work on
    longs: anchor in the high 32 bits, then the side, then the place."""
    one, two, both, pairs = (f"_{out}_{x}" for x in ("a", "b", "all", "pairs"))
    firsts = lambda c: F.expr(f"filter({c}, (x, i) -> i = 0 OR shiftright(get({c}, i - 1), 32) <> shiftright(x, 32))")
    d = df.withColumn(one, F.array_sort(a)).withColumn(two, F.array_sort(b)).withColumn(one, firsts(one)).withColumn(two, firsts(two))
    d = d.withColumn(both, F.array_sort(F.concat(one, F.expr(f"transform({two}, x -> x | 2147483648L)"))))
    d = d.withColumn(pairs, F.expr(f"array_sort(transform(filter(sequence(0, size({both})), i -> shiftright(get({both}, i + 1), 32) = shiftright(get({both}, i), 32)), i -> shiftleft(get({both}, i) & 2147483647L, 32) | (get({both}, i + 1) & 2147483647L)))"))
    low = lambda x: f"({x} & 4294967295L)"
    in_order = F.expr(f"size(filter({pairs}, (p, i) -> size({pairs}) = 1 OR coalesce({low(f'get({pairs}, i - 1)')} < {low('p')}, false) OR coalesce({low(f'get({pairs}, i + 1)')} > {low('p')}, false)))")
    either = F.size(both) - F.size(pairs)
    return d.withColumn(out, F.when(either == 0, 1.0).otherwise(in_order / F.greatest(either, F.lit(1))).cast("double")).drop(one, two, both, pairs)


def as_text(a: Column) -> Column:
    """Anchors as hexadecimal numbers of eight digits, in order."""
    return F.array_join(F.transform(a, lambda x: F.substring(F.lower(F.lpad(F.hex(x), 16, "0")), 1, 8)), "")


def with_next(docs: DataFrame, columns: list[str], block_chars: int = BLOCK_CHARS, add: Callable = lambda d: d) -> DataFrame:
    """docs (doc_id long, tie long, text) with what `add` adds to them, and next_<c> of columns: that of
    the row next in descending (doc_id, tie), after the last the first. Rows are dealt into range blocks of about block_chars code points, a doc_id with
    more rows than a block into several by tie; each block also gets a copy of the row that
    follows it, found from the blocks' largest keys. Of very many rows alike in doc_id and tie,
    one is taken along: it is next to itself, as often as there are others like it. Then the column
    times says how many rows a row stands for."""
    spark, key = docs.sparkSession, ["doc_id", "tie"]
    facts = docs.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.length("text")).alias("chars")).first()
    n = min(BLOCKS, max(1, -(-(facts["chars"] or 0) // block_chars)))
    rows, twins = facts["rows"], None
    docs, many = range_blocks(docs, n, rows, "doc_id", "tie")
    if many:
        alike = docs.groupBy(F.col("doc_id").alias("a_id"), F.col("tie").alias("a_tie")).count().where(F.col("count") > 2 * rows // n + 100)
        alike = stored(alike, "equal-rows")  # at most n / 2 rows
        if not alike.isEmpty():
            docs = docs.withColumn("times", F.lit(1).cast("long"))
            same = F.col("doc_id").eqNullSafe(F.col("a_id")) & (F.col("tie") == F.col("a_tie"))
            some = F.broadcast(alike)
            twins = docs.join(some, same).dropDuplicates(key)
            docs = docs.join(some, same, "left_anti").unionByName(twins.drop("a_id", "a_tie", "count"))
            twins = twins.withColumn("times", F.col("count") - 1).drop("a_id", "a_tie", "count", "block")
    tops = sorted(docs.groupBy("block").agg(F.max(F.struct(F.coalesce("doc_id", F.lit(0)).alias("d"), "tie")).alias("top")).collect(), key=lambda r: r["block"])
    if not tops:
        return add(docs).drop("block", "tie").withColumns({f"next_{c}": F.col(c) for c in columns})
    # the largest row of each block follows the block above; the overall largest follows the lowest block
    above = [(r["block"], r["top"]["d"], r["top"]["tie"], tops[(i + 1) % len(tops)]["block"]) for i, r in enumerate(tops)]
    table = spark.createDataFrame(above, "block long, top_d long, top_tie long, goes long")
    ghosts = (
        docs.join(F.broadcast(table), "block")  # a row a block
        .where((F.coalesce("doc_id", F.lit(0)) == F.col("top_d")) & (F.col("tie") == F.col("top_tie")))
        .withColumn("block", F.col("goes")).drop("top_d", "top_tie", "goes").withColumn("ghost", F.lit(1))
    )
    both = add(docs.withColumn("ghost", F.lit(0)).unionByName(ghosts))
    order = W.partitionBy("block").orderBy("ghost", F.col("doc_id").desc_nulls_last(), F.col("tie").desc())
    out = both.withColumns({f"next_{c}": F.lead(c).over(order) for c in columns}).where("ghost = 0").drop("ghost", "block", "tie")
    return out.unionByName(add(twins).withColumns({f"next_{c}": F.col(c) for c in columns}).drop("tie")) if twins is not None else out


def _written_out(df: DataFrame, at_once: int = 4096) -> DataFrame:
    """Each row `times` times, long rows of equal ones dealt out before."""
    df = df.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1, F.lit(at_once).cast("long")))).repartition("doc_id", "part")
    df = df.withColumn("times", F.least(F.lit(at_once), F.col("times") - F.col("part"))).drop("part")
    return df.withColumn("times", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).drop("times")


def edited_and_next(docs: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """docs (doc_id, text, tie) with n_chars, edited (the last half of the text replaced by the
    start of the next document), fp, edited_fp, near_edited and near_next. One wide move of
    the texts, with their fingerprints, is all: a neighbour's start and fingerprint are taken in it."""
    d = with_next(docs, ["text", "fp"], block_chars, lambda d: fingerprint(d, "text", "fp"))
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.expr("substring(text, 1, length(text) - cast(floor(length(text) / 2) AS int))"), F.substring("next_text", F.lit(1), half))
    d = d.withColumn("edited", edited).withColumn("n_chars", F.length("text").cast("long")).drop("text", "next_text")
    d = with_likeness(fingerprint(d, "edited", "edited_fp"), "fp", "edited_fp", "near_edited")
    d = with_likeness(d, "fp", "next_fp", "near_next").drop("next_fp")
    return _written_out(d) if "times" in d.columns else d


def op6(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("text").alias("tie"))
    return edited_and_next(docs).select(
        "doc_id", "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("fp")).alias("fingerprint"),
        as_text(F.col("edited_fp")).alias("edited_fingerprint"),
        "near_edited", "near_next",
    )
