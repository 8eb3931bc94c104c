"""Reports from JSON, and their elements; and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import boxes as B
from ..schema import REPORT, RUN, SHAPES, SLIDES, VERSION


def read_reports(spark: SparkSession, paths) -> DataFrame:
    """One row per file; report_id is its path. Damaged files give a row with _corrupt_record."""
    return spark.read.schema(REPORT).option("multiLine", True).json(paths).withColumn("report_id", F.col("_metadata.file_path"))


def _texts() -> Column:
    return F.transform(F.flatten(F.transform("s.texts", lambda t: F.coalesce(t["runs"], F.array().cast(f"array<struct<{RUN}>>")))), lambda r: F.struct(r["text"].alias("text"), r["color"].alias("color"), r["size_pt"].alias("size_pt")))


def elements(reports: DataFrame) -> DataFrame:
    """Rows of elements with ord, x1..y2 and the canvas. A report without elements gives
    its slides' shapes: box from position and size, runs as texts. Elements without a
    box keep nulls there."""
    size = F.coalesce("source.size_px", "source.viewport")
    cw = F.coalesce(F.get(size, F.lit(0)).cast("double"), F.get("source.slide_size_pt", F.lit(0)))
    ch = F.coalesce(F.get(size, F.lit(1)).cast("double"), F.get("source.slide_size_pt", F.lit(1)))
    head = reports.withColumns({"canvas_w": cw, "canvas_h": ch}).drop("_corrupt_record")
    has = F.coalesce(F.size("elements") > 0, F.lit(False))
    own = head.where(has).select("report_id", "canvas_w", "canvas_h", F.col("coordsys").alias("report_coordsys"), F.posexplode("elements").alias("ord", "e"))
    own = own.select("report_id", "ord", "canvas_w", "canvas_h", "e.*", F.lit(None).cast("string").alias("name")).withColumn("coordsys", F.col("coordsys"))
    shapes = F.flatten(F.transform(F.coalesce("slides", F.array().cast(SLIDES)), lambda s: F.coalesce(s["shapes"], F.array().cast(SHAPES))))
    rest = head.where(~has).select("report_id", "canvas_w", "canvas_h", F.posexplode(shapes).alias("ord", "s"))
    none = lambda t: F.lit(None).cast(t)
    rest = rest.select(
        "report_id", "ord", "canvas_w", "canvas_h", F.col("s.id").alias("id"), F.col("s.type").alias("type"), B.from_pos_size(F.col("s.pos_pt"), F.col("s.size_pt")).alias("bbox"), none("string").alias("text"), none("double").alias("conf"),
        none("struct<fill:string,text:string>").alias("color"), F.col("s.fill").alias("fill"), F.when(F.size(_texts()) > 0, _texts()).alias("texts"), none("string").alias("font"), none("int").alias("z"), F.array(F.lit("pptx")).alias("source"), F.lit("pt").alias("coordsys"), F.col("s.name").alias("name"),
    )
    both = own.unionByName(rest)
    return both.withColumns({n: F.get("bbox", F.lit(i)) for i, n in enumerate(("x1", "y1", "x2", "y2"))})


def sensors(reports: DataFrame) -> DataFrame:
    """The distinct sensors of all reports, by first report and place."""
    d = reports.select("report_id", F.posexplode("sensors").alias("at", "sensor"))
    return d.groupBy("sensor").agg(F.min(F.struct("report_id", "at")).alias("first")).orderBy("first").select("sensor")


def envelope(task: str, elements_: DataFrame, findings: DataFrame, metrics: DataFrame) -> DataFrame:
    """report_id, json: one envelope a report. Lists are sorted by ord; one report's rows meet in one row."""
    rows = lambda d, name: d.groupBy("report_id").agg(F.array_sort(F.collect_list(F.struct(*[c for c in d.columns if c != "report_id"]))).alias(name))
    d = rows(elements_, "elements").join(rows(findings, "findings"), "report_id", "full").join(metrics.select("report_id", F.struct(*[c for c in metrics.columns if c != "report_id"]).alias("metrics")), "report_id", "full")
    return d.select("report_id", F.to_json(F.struct(F.lit(VERSION).alias("schema"), F.lit(task).alias("task"), "elements", "findings", "metrics")).alias("json"))


def write_json(envelopes: DataFrame, path: str) -> None:
    envelopes.select("json").write.mode("overwrite").text(path)


def append_failures(failures: DataFrame, path: str, most_bytes: int = 512 * 1024, keep: int = 150) -> None:
    """Failures (with ts) added to a JSON log. A log over most_bytes is written anew from its last
    `keep` lines by ts before (a limit that is the feature)."""
    spark = failures.sparkSession
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    at = fs_path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(at) and fs.getContentSummary(at).getLength() > most_bytes:
        turned = fs_path(path.rstrip("/") + ".turned")
        fs.delete(turned, True)
        spark.read.schema(failures.schema).json(path).orderBy(F.desc("ts")).limit(keep).coalesce(1).write.json(turned.toString())
        fs.delete(at, True)
        fs.rename(turned, at)
    failures.write.mode("append").json(path)


def or_errors(reports: DataFrame) -> DataFrame:
    """report_id, json of the report or of {"error", "detail"} for files that were no JSON."""
    bad = F.to_json(F.struct(F.lit("not a report").alias("error"), F.col("_corrupt_record").alias("detail")))
    fine = F.to_json(F.struct(*[c for c in reports.columns if c not in ("report_id", "_corrupt_record")]))
    return reports.select("report_id", F.when(F.col("_corrupt_record").isNotNull(), bad).otherwise(fine).alias("json"), F.col("_corrupt_record").isNotNull().alias("failed"))


def merge_reports(steps: DataFrame) -> DataFrame:
    """One report a task from its steps' (task_id, step, failed, sensors, elements, anomalies, truncated; the
    arrays of any type): elements and anomalies in order of the steps, sensors as first seen, truncated
    if any is. Failed steps are left out."""
    d = steps.where(~F.coalesce("failed", F.lit(False)))
    kinds = dict(steps.dtypes)
    none = lambda c: F.coalesce(c, F.array().cast(kinds[c]))
    g = d.groupBy("task_id").agg(F.array_sort(F.collect_list(F.struct("step", none("sensors").alias("sensors"), none("elements").alias("elements"), none("anomalies").alias("anomalies")))).alias("s"), F.bool_or(F.coalesce("truncated", F.lit(False))).alias("truncated"))
    of = lambda c: F.flatten(F.transform("s", lambda x: x[c]))
    return g.select("task_id", F.array_distinct(of("sensors")).alias("sensors"), of("elements").alias("elements"), of("anomalies").alias("anomalies"), "truncated")


def merge_steps(steps: DataFrame) -> DataFrame:
    """steps (report_id, step, key, value): the value of the first step that has a key."""
    return steps.where("value IS NOT NULL").groupBy("report_id", "key").agg(F.min_by("value", "step").alias("value"))


def with_offset_ids(first: DataFrame, second: DataFrame) -> DataFrame:
    """Both sets of elements under one numbering: the second's ids start after the first's.
    source_kind says which set a row is from."""
    top = first.groupBy("report_id").agg((F.max("id") + 1).alias("_off"))
    moved = second.join(top, "report_id", "left").withColumn("id", F.col("id") + F.coalesce("_off", F.lit(0))).drop("_off")
    return first.withColumn("source_kind", F.lit("vision")).unionByName(moved.withColumn("source_kind", F.lit("a11y")), allowMissingColumns=True)
