"""What the operators share: scratch tables, word rules and ranks that no single task computes."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Fixed value: the white space that separates words, as Python's bytes.split() and strip() have it.
SPACES = b" \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset and the master is local, a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    key = spark.sparkContext.applicationId
    if key not in _OWN:
        _OWN[key] = "file://" + tempfile.mkdtemp(prefix="parchmint-")
    return _OWN[key]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder, removed when the driver ends."""
    path = f"{shared_folder(spark)}/parchmint-{name}-{uuid.uuid4().hex[:12]}"
    atexit.register(remove, spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch table; a session that has ended already leaves nothing to do."""
    context = spark.sparkContext
    if context._jsc is None:
        return
    where = context._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)


def exists(spark: SparkSession, path: str) -> bool:
    context = spark.sparkContext
    where = context._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(context._jsc.hadoopConfiguration()).exists(where)


def release(spark: SparkSession) -> None:
    """Let go of shuffle files of jobs that are done: executors delete them once the driver has collected what refers to them."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def running_total(df: DataFrame, group: list[str], order: list[Column], spread: Column, weight: Column, out: str, buckets: int = 4096) -> DataFrame:
    """Add `out`: the sum of weight over the rows that come before this one in its group.

    Rows go by (bucket of spread, order). A bucket is one window partition, so a group that holds
    a third of all rows is summed by many tasks; what is summed over whole buckets has at most
    `buckets` rows a group.
    """
    df = df.withColumn("_bucket", F.pmod(F.xxhash64(spread), F.lit(buckets)))
    sums = df.groupBy(*group, "_bucket").agg(F.sum(weight).alias("_sum"))
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_bucket").alias("_b"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    on = [F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(group)] + [F.col("_bucket") == F.col("_b")]
    joined = df.join(starts, on, "left")
    within = Window.partitionBy(*group, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    total = F.coalesce(F.sum(weight).over(within), F.lit(0)) + F.col("_start")
    return joined.withColumn(out, total.cast("long")).drop(*[f"_g{i}" for i in range(len(group))], "_b", "_start", "_bucket")


def join_one(rows: DataFrame, one: DataFrame, on: list[str], count: str, total: int, share: int = 1000, alike: bool = False) -> DataFrame:
    """rows joined with the one row that `one` has for each key, where a key may hold a third of all rows.

    `one` has in `count` how many of the `total` rows have its key. Keys with more than 1/share of them
    are fewer than share, so those go by broadcast; what is left has no hot key; `alike` has
    it shuffled at every size, even where Spark would broadcast a small side. Both sides are read twice: they are best tables.
    """
    many = F.col(count) * share > total
    hot = F.broadcast(one.where(many))  # fewer than `share` rows
    few = one.where(~many)
    cold = rows.join(hot.select(*on), on, "left_anti").join(few.hint("merge") if alike else few, on)
    return rows.join(hot, on).unionByName(cold)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bound the rows of an Arrow batch for this session: texts are long, and both sides hold whole batches."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def raw_text(text: pa.Scalar) -> bytes:
    """The UTF-8 bytes of a string scalar; null is empty."""
    return text.as_buffer().to_pybytes() if text.is_valid else b""


def distinct_names(taken: list[str], *wanted: str) -> list[str]:
    """Names for helper columns that clash with none of `taken`."""
    low = {x.lower() for x in taken}
    out = []
    for name in wanted:
        while name.lower() in low:
            name = "_" + name
        low.add(name.lower())
        out.append(name)
    return out
