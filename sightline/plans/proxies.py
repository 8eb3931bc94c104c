"""Elements, points and solids derived from the star-schema tables with whole-number
arithmetic, so that the operators can run, and be checked, at any scale."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report an order, an element a line. The order of lines is fixed by number, part and supplier."""
    # named before they are dealt by it, so that later steps by report find them dealt
    li = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("report_id"), "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_returnflag")
    w = W.partitionBy("report_id").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    x1, y1 = (F.col("l_partkey") * 37) % 800, (F.col("l_suppkey") * 53) % 600
    kind = F.when(F.col("l_returnflag") == "A", "ocr").when(F.col("l_returnflag") == "N", "dom").otherwise("detect")
    return li.select(
        "report_id",
        (F.row_number().over(w) - 1).alias("ord"),
        x1.cast("double").alias("x1"), y1.cast("double").alias("y1"),
        (x1 + 20 + 4 * F.col("l_quantity")).cast("double").alias("x2"), (y1 + 10 + 12 * F.col("l_linenumber")).cast("double").alias("y2"),
        (1 - 4 * F.col("l_discount")).alias("conf"), kind.alias("kind"), F.col("l_partkey").alias("seed"),
    )


ELEMENTS_SQL = """el AS (
  SELECT l_orderkey AS report_id,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS ord,
    CAST((l_partkey * 37) % 800 AS DOUBLE) AS x1, CAST((l_suppkey * 53) % 600 AS DOUBLE) AS y1,
    CAST((l_partkey * 37) % 800 + 20 + 4 * l_quantity AS DOUBLE) AS x2, CAST((l_suppkey * 53) % 600 + 10 + 12 * l_linenumber AS DOUBLE) AS y2,
    1 - 4 * l_discount AS conf, CASE l_returnflag WHEN 'A' THEN 'ocr' WHEN 'N' THEN 'dom' ELSE 'detect' END AS kind, l_partkey AS seed
  FROM lineitem)"""


def colors(seed) -> tuple:
    """Channels drawn from a whole number."""
    return (seed * 73) % 256, (seed * 151) % 256, (seed * 211) % 256


def parts3d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A solid a part; scenes are brands. lo and hi are corners in whole units."""
    p = read(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")
    lo = [((F.col("p_partkey") * k) % m).cast("double") for k, m in ((31, 400), (57, 300), (17, 200))]
    return p.select(F.col("p_brand").alias("scene"), F.col("p_partkey").alias("ord"), F.array(*lo).alias("lo"), F.array(*[c + F.col("p_size") for c in lo]).alias("hi"))


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as log lines of the kinds that the stream operators know."""
    e = read(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    line = F.lit("noise")
    for kind, text in (("click", "Window focused: 3"), ("purchase", "Windows changed: x"), ("view", "Workspaces changed"), ("error", "Overview toggled")):
        line = F.when(F.col("event_type") == kind, text).otherwise(line)
    return e.withColumn("line", line)


#: Pictures of 32 x 24 pixels drawn by rule, one a supplier: a bright bar whose width depends on the
#: number, and shades across and down.
WIDTH, HEIGHT = 32, 24


def _shades(s, x, y, late=False) -> tuple:
    bar = F.when(x < 6 * (s % 5), 190).otherwise(40)
    bar = F.when((s % 4 == 0) & x.between(8, 19) & y.between(6, 15), 235 - bar).otherwise(bar) if late else bar
    return (bar + s % 13 + x) % 256, (bar + (s * 7) % 29 + 2 * y) % 256, (bar * (s % 3) + x * y) % 256


def picture_px(spark: SparkSession, sf_dir: str, late: bool = False) -> DataFrame:
    """image_id, x, y, r, g, b, w, h. late: as they are later, every fourth with a changed block."""
    s = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("image_id"), F.explode(F.sequence(F.lit(0), F.lit(WIDTH * HEIGHT - 1))).alias("i"))
    d = s.select("image_id", (F.col("i") % WIDTH).alias("x"), F.floor(F.col("i") / WIDTH).cast("int").alias("y"))
    r, g, b = _shades(F.col("image_id"), F.col("x"), F.col("y"), late)
    return d.select("image_id", "x", "y", r.alias("r"), g.alias("g"), b.alias("b"), F.lit(WIDTH).alias("w"), F.lit(HEIGHT).alias("h"))


def pictures(spark: SparkSession, sf_dir: str, late: bool = False) -> DataFrame:
    """image_id, w, h, data: the same as bytes."""
    byte = lambda c: F.lpad(F.hex(F.col(c)), 2, "0")
    px = picture_px(spark, sf_dir, late).select("image_id", (F.col("y") * WIDTH + F.col("x")).alias("i"), F.concat(byte("r"), byte("g"), byte("b")).alias("p"))
    d = px.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("i", "p"))).alias("ps"))
    data = F.unhex(F.array_join(F.transform("ps", lambda s: s["p"]), ""))
    return d.select("image_id", F.lit(WIDTH).alias("w"), F.lit(HEIGHT).alias("h"), data.alias("data"))


PICTURES_SQL = """bars AS (SELECT s_suppkey AS image_id, i % 32 AS x, i // 32 AS y, CASE WHEN i % 32 < 6 * (s_suppkey % 5) THEN 190 ELSE 40 END AS bar
  FROM supplier, unnest(range(768)) AS t(i)),
px AS (SELECT image_id, x, y, (bar + image_id % 13 + x) % 256 AS r, (bar + (image_id * 7) % 29 + 2 * y) % 256 AS g, (bar * (image_id % 3) + x * y) % 256 AS b FROM bars),
gr AS (SELECT *, (19595 * r + 38470 * g + 7471 * b + 32768) // 65536 AS gray FROM px)"""


def dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report a supplier: some 600 boxes in seven rows, a row a line number."""
    li = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_suppkey").alias("report_id"), "l_quantity")
    x1, y1 = (F.col("l_orderkey") * 37) % 8000, 90 * F.col("l_linenumber") + F.col("l_partkey") % 3
    w = W.partitionBy("report_id").orderBy("l_orderkey", "l_linenumber", "l_partkey")
    return li.select("report_id", (F.row_number().over(w) - 1).alias("ord"), *[c.cast("double").alias(n) for c, n in ((x1, "x1"), (y1, "y1"), (x1 + 1 + F.col("l_quantity") % 9, "x2"), (y1 + 30, "y2"))])


DENSE_SQL = """de AS (SELECT l_suppkey AS report_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) - 1 AS ord, l_linenumber AS line,
  CAST((l_orderkey * 37) % 8000 AS DOUBLE) AS x1, CAST(90 * l_linenumber + l_partkey % 3 AS DOUBLE) AS y1, CAST((l_orderkey * 37) % 8000 + 1 + l_quantity % 9 AS DOUBLE) AS x2 FROM lineitem)"""
