"""Quality by weak supervision, in DataFrame functions only.

Each rule looks at a few counts of a document and votes good (1), bad (-1) or abstains
(0). Expectation-maximisation over the counts of vote patterns, a table of at most
3^rules rows, estimates the share of good documents and how each rule votes on either
class; a document is kept if its posterior probability of being good is at least
`threshold`. Votes enter the posterior as log odds, so scoring is one JVM expression.
Two base conditions reject whatever the votes say: fewer than 10 words, or over 20 %
of the words in 5-word windows that the text repeats.

Null and blank texts have no words: every count is 0 and the base conditions reject
them. Identical rows get identical results, as do rows that share a doc_id by their own texts;
null doc_ids are judged like any. Very long texts are arrays of one row and nothing more. Other
columns pass through `keep_good`. An empty table keeps nothing and learns the starting values.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WS, free, read, stored, words

THRESHOLD, WINDOW = 0.5, 5
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_upper", "n_marks", "n_distinct")


def counts(docs: DataFrame) -> DataFrame:
    """docs' doc_id and text_key with the longs of COUNTS. A row is read once and
    nothing moves between tasks."""
    d = docs.select(F.col("doc_id"), F.coalesce("text", F.lit("")).alias("t"), F.xxhash64("text").alias("text_key"))
    d = d.withColumn("w", words(F.col("t")))
    d = d.withColumn("wh", F.transform("w", lambda x: F.xxhash64(x))).withColumn(
        "lines", F.filter(F.split("t", "\n", -1), lambda x: F.btrim(x, F.lit(WS)) != "")
    )
    d = d.select(
        "doc_id", "text_key", "wh",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").cast("long").alias("n_lines"),
        F.regexp_count("t", F.lit(r"\p{L}")).cast("long").alias("n_letters"),
        F.regexp_count("t", F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
        F.regexp_count("t", F.lit(r"[^\p{L}\p{N}\x20\x09-\x0D.,;:'’\"()-]")).cast("long").alias("n_marks"),
        F.size(F.array_distinct("wh")).cast("long").alias("n_distinct"),
    )
    step = ", ".join(f"get(wh, i + {k})" for k in range(1, WINDOW))
    d = d.withColumn("win", F.expr(f"transform(slice(wh, 1, greatest(size(wh) - {WINDOW - 1}, 0)), (x, i) -> xxhash64(x, {step}))"))
    d = d.withColumn("twice", F.size(F.array_distinct("win")) < F.size("win"))
    d = d.withColumn("s", F.expr("CASE WHEN twice THEN array_sort(transform(win, (x, i) -> struct(x AS h, i AS i))) END"))
    d = d.withColumn("at", F.expr("sort_array(transform(filter(s, (x, j) -> coalesce(get(s, j - 1).h = x.h, false) OR coalesce(get(s, j + 1).h = x.h, false)), x -> x.i))"))
    covered = f"aggregate(transform(at, (x, j) -> coalesce(least({WINDOW}, get(at, j + 1) - x), {WINDOW})), 0L, (a, x) -> a + x)"
    return d.withColumn("n_repeat_words", F.expr(f"coalesce({covered}, 0L)")).select("doc_id", "text_key", *COUNTS)


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def _vote(value: Column, good: Column, bad: Column) -> Column:
    return F.when(value.isNull(), 0).when(bad, -1).when(good, 1).otherwise(0)


def rules() -> dict[str, Column]:
    """The votes over COUNTS by name."""
    n, chars, lines = F.col("n_words"), F.col("word_chars"), F.col("n_lines")
    some = lambda a, b: F.try_divide(a.cast("double"), b.cast("double"))
    mean, symbols, letters = some(chars, n), some(F.col("n_symbols"), n), some(F.col("n_letters"), chars)
    upper, marks, dup = some(F.col("n_upper"), F.col("n_letters")), some(F.col("n_marks"), n), some(F.col("n_dup_lines"), lines)
    repeat, fresh = some(F.col("n_repeat_words"), n), some(F.col("n_distinct"), n)
    return {
        "length": _vote(n, n >= 50, n < 20),
        "word_length": _vote(mean, mean.between(3.5, 9), (mean < 2.5) | (mean > 12)),
        "symbols": _vote(symbols, symbols <= 0.01, symbols > 0.1),
        "letters": _vote(letters, letters >= 0.9, letters < 0.75),
        "upper": _vote(upper, upper <= 0.15, upper > 0.4),
        "marks": _vote(marks, marks <= 0.03, marks > 0.25),
        "dup_lines": _vote(dup, dup <= 0.05, dup > 0.3),
        "repeats": _vote(repeat, repeat <= 0.05, repeat > 0.2),
        "variety": _vote(fresh, fresh >= 0.35, (fresh < 0.15) & (n >= 50) & (n < 2000)),
    }


def votes(counted: DataFrame) -> DataFrame:
    return counted.withColumns({f"v_{k}": v for k, v in rules().items()})


def fit(voted: DataFrame, rounds: int = 200) -> dict:
    """EM over vote patterns: {'prior': p, 'rules': {name: {vote: (on good, on bad)}}},
    the chance of each vote, abstention included, on either class. It starts from the
    vote balance; counts are smoothed by one document a class, the share of good documents is held
    between 0.5 and 0.99 (corpora are mostly good, and a share of 1 would silence all votes), and a rule never turns
    against its meaning: a bad vote is at least as likely on bad documents, a good one
    on good documents."""
    names = list(rules())
    rows = voted.groupBy(*[f"v_{k}" for k in names]).count().collect()  # 3^rules rows at most
    patterns = sorted((tuple(r[f"v_{k}"] for k in names), r["count"]) for r in rows)
    likely = [(0.95, 0.4, 0.1)[min(2, v.count(-1))] for v, _ in patterns]
    model = {"prior": 0.9, "rules": {k: {1: (0.9, 0.6), 0: (0.09, 0.2), -1: (0.01, 0.2)} for k in names}}
    total = sum(n for _, n in patterns)
    for _ in range(rounds if patterns else 0):
        good = sum(p * n for p, (_, n) in zip(likely, patterns, strict=True))
        bad = total - good
        old, model = model, {"prior": min(0.99, max(0.5, good / total)), "rules": {}}
        for i, k in enumerate(names):
            on = {v: [1 / 3, 1 / 3] for v in (1, 0, -1)}
            for p, (votes_, n) in zip(likely, patterns, strict=True):
                on[votes_[i]][0] += p * n
                on[votes_[i]][1] += (1 - p) * n
            chance = {v: (x / (good + 1), y / (bad + 1)) for v, (x, y) in on.items()}
            if chance[-1][0] > chance[-1][1] or chance[1][0] < chance[1][1]:
                chance = {v: (sum(on[v]) / (total + 2),) * 2 for v in on}  # says nothing
            model["rules"][k] = chance
        likely = [posterior(v, model) for v, _ in patterns]
        if abs(old["prior"] - model["prior"]) < 1e-7:
            break
    return model


def _odds(chance: tuple) -> float:
    return math.log(chance[0] / chance[1])


def posterior(pattern, model: dict) -> float:
    """The chance that a document with these votes is good."""
    x = math.log(model["prior"] / (1 - model["prior"])) + sum(_odds(chance[v]) for v, chance in zip(pattern, model["rules"].values(), strict=True))
    return 1 / (1 + math.exp(-max(-500.0, min(500.0, x))))


def judged(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of docs: doc_id, text_key, COUNTS, votes, base_failed, quality, kept."""
    voted = votes(stored(counts(docs), "counts"))
    model = fit(voted)
    x = F.lit(math.log(model["prior"] / (1 - model["prior"])))
    for k, chance in model["rules"].items():
        x = x + F.when(F.col(f"v_{k}") > 0, _odds(chance[1])).when(F.col(f"v_{k}") < 0, _odds(chance[-1])).otherwise(_odds(chance[0]))
    return (
        voted.withColumn("base_failed", base_failed())
        .withColumn("quality", 1 / (1 + F.exp(-x)))
        .withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold))
    )


def keep_good(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows that the rules reject; columns as they were."""
    id_, key = free(docs, "_id", "_key")
    bad = judged(docs, threshold).where(~F.col("kept")).select(F.col("doc_id").alias(id_), F.col("text_key").alias(key)).distinct()
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col(id_)) & (F.xxhash64("text") == F.col(key)), "left_anti")


def op4(spark, sf_dir: str) -> DataFrame:
    out = judged(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")
