"""From raw documents to training sequences: the stages of the corpus pipeline.

Each stage is one operator over all that the stage before kept, written as Parquet and
read again: quality rules, line dedup, near dedup, mixing along the curriculum (a document
taken twice is there twice), packing, which numbers the sequences of a length in the order
in which the mix was written. Near dedup links from 80 % of shared shingles on and keeps one
document of a group.

What a stage does with null, empty and very long texts, null or shared doc_ids, repeated
rows and an empty table, its operator's module says: base conditions reject texts of under
ten words at the first stage already, an empty table gives no sequences, and rows that share
a doc_id are documents of their own. Columns beyond doc_id, text and source pass through up
to packing, whatever their names, but for `position`, `n_lines` and `n_dropped`, which stages
use and drop.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sightline.llm.common import delete, fresh, read, written_order
from sightline.llm.line_dedup import dedup_lines
from sightline.llm.mixing import mix
from sightline.llm.near_dedup import keep_one
from sightline.llm.packing import pack
from sightline.llm.quality import keep_good

STAGES = [
    ("quality_rules", lambda spark, docs, sf_dir: keep_good(docs)),
    ("line_dedup", lambda spark, docs, sf_dir: dedup_lines(docs).drop("n_lines", "n_dropped")),
    ("near_dedup", lambda spark, docs, sf_dir: keep_one(docs, percent=80)),
    ("curriculum_mix", lambda spark, docs, sf_dir: mix(docs).drop("position")),
    ("packing", lambda spark, docs, sf_dir: pack(docs, order=written_order(docs))),
]

#: Merges of byte pairs, expectation-maximisation and components can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_on(spark, read(spark, sf_dir, "documents"), sf_dir)


def run_on(spark: SparkSession, docs: DataFrame, sf_dir: str = "") -> DataFrame:
    """The stages applied to docs; a stage's input is deleted once the next one is written."""
    before = None
    for name, stage in STAGES:
        path = fresh(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            delete(spark, before)
        before = path
    return docs
