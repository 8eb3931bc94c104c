"""What the corpus operators share: token rules, the shared folder, range blocks."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of every operator here: space, tab, line feed, VT, FF, CR.
WS = " \t\n\x0b\x0c\r"
#: Java regex for one white-space character and for one word.
WS_RE, WORD_RE = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_made: list[tuple[SparkSession, str]] = []


def lower_ascii(c: Column) -> Column:
    """A-Z lower-cased; every other character as it is."""
    return F.translate(c, UPPER, LOWER)


def words(text: Column) -> Column:
    """The words of a text as an array; null and blank texts have none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(WS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, WS_RE + "+"))


def scratch(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it
    is unset a temporary folder serves, but only if the master is local."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or (sc._jsc.sc().getCheckpointDir().get() if sc._jsc.sc().getCheckpointDir().isDefined() else None)
    if not root:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="sightline-")
        sc.setCheckpointDir(root)
    return root.rstrip("/")


def fresh(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder, deleted by `delete` or when the driver exits."""
    path = f"{scratch(spark)}/{what}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


@atexit.register
def _clean() -> None:
    for spark, path in _made:
        try:
            delete(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone: nothing is left to delete with
            return


def delete(spark: SparkSession, path: str) -> None:
    _made[:] = [m for m in _made if m[1] != path]
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def stored(df: DataFrame, what: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again: cuts the lineage,
    survives lost executors, and is computed once however often it is used."""
    path = fresh(df.sparkSession, what)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._sl_path = path
    return out


def release(df: DataFrame) -> None:
    """Deletes what `stored` wrote for df, which isn't read again."""
    delete(df.sparkSession, df._sl_path)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def free(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as make it none of df's columns (nor another of them)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def range_bounds(df: DataFrame, key: str, n: int) -> list:
    """At most n-1 ascending split points of a long column, about equal in rows;
    a sketch of bounded size is all that reaches the driver."""
    got = df.agg(F.percentile_approx(key, [i / n for i in range(1, n)], 20 * n).alias("q")).first()["q"]
    return sorted(set(got or []))


def block_of(c: Column, bounds: list) -> Column:
    """How many bounds lie below c (0 to len(bounds)), by binary search in JVM expressions:
    nested conditions for a few bounds, steps through an array for many."""
    def pick(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(c <= F.lit(bounds[mid]), pick(lo, mid)).otherwise(pick(mid + 1, hi))

    if len(bounds) <= 256:
        return pick(0, len(bounds)) if bounds else F.lit(0)
    held = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>")  # folded to one constant
    steps = F.array(*[F.lit(1 << k) for k in range(len(bounds).bit_length() - 1, -1, -1)])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.coalesce(F.get(held, at + step - 1) < c, F.lit(False)), at + step).otherwise(at))


def range_blocks(df: DataFrame, n: int, rows: int, key: str, tie: str) -> tuple[DataFrame, list]:
    """(df with block: about n ranges of key (nulls first), in order, and the keys split further). A key with more
    than two blocks' rows is a block of its own, split into several by ranges of tie, a 64-bit hash."""
    much, many = 2 * rows // n + 100, []
    if n > 1:
        hot = df.groupBy(key).count().where(F.col("count") > much)
        many = [(r[key], min(1 << 20, -(-n * r["count"] // rows))) for r in hot.collect()]  # at most n / 2 rows
    own = [i for i, _ in many if i is not None]
    bounds = sorted({*(range_bounds(df, key, n) if n > 1 else ()), *own, *(i - 1 for i in own)})
    block = F.when(F.col(key).isNull(), -1).otherwise(block_of(F.col(key), bounds)).cast("long")
    df = df.withColumn("block", F.shiftleft(block, 20))
    if many:
        table = F.broadcast(df.sparkSession.createDataFrame(many, "m_key long, m_parts int"))
        part = F.least(F.col("m_parts") - 1, F.floor((F.col(tie) / 2.0**64 + 0.5) * F.col("m_parts")))
        df = df.join(table, F.col(key).eqNullSafe(F.col("m_key")), "left").withColumn("block", F.col("block") + F.coalesce(part, F.lit(0))).drop("m_key", "m_parts")
    return df, many


def written_order(docs: DataFrame) -> Column | None:
    """The place of each row in the files that a Spark job wrote, in order of its partitions, as a long; None
    if docs isn't read from such files."""
    try:
        docs.select("_metadata.file_name", "_metadata.row_index")
    except AnalysisException:
        return None
    number = lambda pattern: F.coalesce(F.regexp_extract("_metadata.file_name", pattern, 1).try_cast("long"), F.lit(0))
    file = number(r"^part-(\d+)") * 4096 + F.least(number(r"-c(\d+)\."), F.lit(4095))
    return F.shiftleft(file, 32) + F.col("_metadata.row_index")
