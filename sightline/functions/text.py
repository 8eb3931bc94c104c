"""Text scalars."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def similarity(a: Column, b: Column) -> Column:
    """Trimmed and lower-cased: 0 if either is empty, 1 if equal, 0.7 if one holds the
    other, else one minus the edit distance over the longer length, at least 0."""
    x, y = F.lower(F.trim(a)), F.lower(F.trim(b))
    far = F.levenshtein(x, y) / F.greatest(F.length(x), F.length(y))
    return (
        F.when(x.isNull() | y.isNull() | (x == "") | (y == ""), 0.0)
        .when(x == y, 1.0)
        .when(F.contains(x, y) | F.contains(y, x), 0.7)
        .otherwise(F.greatest(F.lit(0.0), 1 - far))
    )


#: The words that recognised text is held against, in order.
COMMON = (
    "提交", "取消", "确定", "保存", "删除", "编辑", "搜索", "设置", "登录", "注册", "退出", "返回", "下一步", "上一步", "完成", "确认", "关闭", "打开", "新建",
    "submit", "cancel", "ok", "save", "delete", "edit", "search", "settings", "login", "logout", "back", "next", "done", "close", "open", "new", "yes", "no",
)


def corrected(df: DataFrame, text: str, conf: str, words: Sequence[str] = COMMON, decay: float = 0.9) -> DataFrame:
    """Adds corrected and corrected_conf: texts of two or more characters become the
    first word of the list at the least distance, if that is at most 1, and lose
    confidence, exact hits too. The list is a constant; it is scanned in the row."""
    if not words:
        return df.withColumns({"corrected": F.col(text), "corrected_conf": F.col(conf)})
    best = F.array_min(F.transform(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(w).alias("w")) for i, w in enumerate(words)]), lambda x: F.struct(F.levenshtein(F.col(text), x["w"]).alias("d"), x["i"].alias("i"), x["w"].alias("w"))))
    near = (F.length(text) >= 2) & (F.col("_best.d") <= 1)
    return (
        df.withColumn("_best", best)
        .withColumns({"corrected": F.when(near, F.col("_best.w")).otherwise(F.col(text)), "corrected_conf": F.when(near, F.col(conf) * decay).otherwise(F.col(conf))})
        .drop("_best")
    )


def cut(c: Column, n: int) -> Column:
    return F.substring(c, 1, n)


def title_matches(title: Column, part: Column) -> Column:
    return F.contains(F.lower(title), F.lower(part))


def chain(c: Column) -> Column:
    """"click 1 2; type hi" as an array of arrays of words."""
    return F.transform(F.filter(F.split(c, ";"), lambda x: F.trim(x) != ""), lambda x: F.split(F.trim(x), r"\s+"))


def python_number(c: Column, whole: Column) -> Column:
    """Without a point where whole, else with one decimal."""
    return F.when(whole, F.format_string("%d", c.cast("long"))).otherwise(F.format_string("%.1f", c.cast("double")))


def safe_name(c: Column) -> Column:
    return c.rlike("^[A-Za-z0-9_-]{1,64}$")


@F.pandas_udf(T.DoubleType())
def exact_round(values: pd.Series, digits: pd.Series) -> pd.Series:
    """Correct rounding of the binary value, as Python's round; Spark's own goes
    through the shortest decimal. For sinks, not for the hot path."""
    return pd.Series([None if v != v else round(v, int(n)) for v, n in zip(values, digits, strict=True)], dtype="float64")


#: Attributes of an SVG or HTML tag as a map.
def attributes(tag: Column) -> Column:
    names = F.regexp_extract_all(tag, F.lit(r'([A-Za-z-]+)="[^"]*"'), F.lit(1))
    values = F.regexp_extract_all(tag, F.lit(r'[A-Za-z-]+="([^"]*)"'), F.lit(1))
    return F.map_from_entries(F.filter(F.arrays_zip(names.alias("k"), values.alias("v")), lambda e: e["k"].isNotNull()))


def translation(attr: Column) -> tuple[Column, Column]:
    part = lambda i: F.regexp_extract(attr, r"translate\(\s*(-?[\d.]+)[ ,]+(-?[\d.]+)\s*\)", i).try_cast("double")
    return F.coalesce(part(1), F.lit(0.0)), F.coalesce(part(2), F.lit(0.0))


#: The pattern that parts a prompt into words, and the ids of its start and end.
PROMPT = r"<\|startoftext\|>|<\|endoftext\|>|'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PROMPT_START, PROMPT_END = 49406, 49407


def prompt_ids(vocab: str, merges: str, length: int = 16):
    """A pandas UDF from texts to the token ids of prompts: start, byte pairs of each word, end, zeros up to
    length. vocab and merges are files of a byte-pair vocabulary, which every executor can read."""
    @F.pandas_udf("array<int>")
    def ids(texts: pd.Series) -> pd.Series:
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        t = Tokenizer(models.BPE.from_file(vocab, merges, end_of_word_suffix="</w>"))
        t.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(PROMPT), "removed", invert=True), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        out = [[PROMPT_START, *t.encode(x or "", add_special_tokens=False).ids, PROMPT_END] for x in texts]
        return pd.Series([x + [0] * (length - len(x)) for x in out])

    return ids
