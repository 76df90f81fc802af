"""Exact deduplication as a stateful stream: keyed state on disk, without expiry.

The stream keeps for each digest the stable id and the locator (file, row) of the document that stays
and how many have come. A hit, a document whose digest is known, is compared byte for byte with the
located content; documents whose digests agree while their bytes differ are grouped by their bytes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bitmap import key_bitmap, split_by
from .common import exists, join_one, saved, scratch_path, small_batches

#: Copies of one text that one task compares with the located content.
HOT = 1000
#: Spark's state store on local disk, snapshots and change logs in the shared folder.
STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # else each partition's store claims megabytes before it holds a row
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


@contextmanager
def _settings(spark: SparkSession, wanted: dict[str, str]) -> Iterator[None]:
    old = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _digested(table: DataFrame, id_col: str, text_col: str, digest: Callable[[Column], Column]) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    where = F.struct(F.col(id_col).cast("long").alias("id"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    return table.select(text.alias("text"), digest(text).alias("digest"), where.alias("at"))


def remember(spark: SparkSession, path: str, state: str, log: str, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256, max_bytes: str | None = None) -> None:
    """Run the stream over the Parquet files at path that it has not seen, then stop.

    state is the stream's checkpoint: a later call with the same one takes new files only and goes on
    with the same keyed state. log gets, for each batch, the digests that changed; a batch written
    again after a failure replaces itself. max_bytes bounds a batch.
    """
    schema = spark.read.parquet(path).schema
    glob = f"{path[:-1]}[{path[-1]}]"  # a pattern may name one file or a folder
    reader = spark.readStream.schema(schema)
    if max_bytes:
        reader = reader.option("maxBytesPerTrigger", max_bytes)
    rows = _digested(reader.parquet(glob), id_col, text_col, digest).select("digest", "at")
    known = rows.groupBy("digest").agg(F.max("at").alias("keep"), F.count("*").alias("n"))
    with _settings(spark, STORE):
        query = (
            known.writeStream.outputMode("update")
            .option("checkpointLocation", state)
            .foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{log}/batch={n}"))
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()


def dedup_exact(spark: SparkSession, path: str, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256, state: str | None = None, log: str | None = None, max_bytes: str | None = None) -> DataFrame:
    """One row for each row of the Parquet table at path: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their UTF-8 bytes are; null counts as empty. Of equal texts the row with the
    largest id stays; rows that share that id too are told apart by their locator, and one stays. A
    null id is smaller than any other. An empty table gives an empty table.

    Very long texts are compared whole. Other columns are not read. The stream shuffles 32-byte digests
    and locators with partial counts, so a text of which a third of all rows are copies is one row for
    each task. Texts move only for digests that came more than once and the few others that a filter of
    fixed size lets through. Hits meet the located content in parts of about HOT, for each of
    which it is repeated, and digests that hold more than a thousandth of all rows are joined by
    broadcast, so no task gets a group of copies whole.
    """
    state, log = state or scratch_path(spark, "state"), log or scratch_path(spark, "log")
    small_batches(spark)
    remember(spark, path, state, log, id_col, text_col, digest, max_bytes)
    table = _digested(spark.read.parquet(path), id_col, text_col, digest)
    if not exists(spark, log):
        return table.select(F.col("at.id").alias("id"), F.col("at.id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.sha2("text", 256).alias("text_sha256"))
    known = saved(spark.read.parquet(log).groupBy("digest").agg(F.max("keep").alias("keep"), F.max("n").alias("n")), "known")
    several = saved(known.where("n > 1").select("digest", F.col("keep").alias("k"), "n"), "several")
    key = F.xxhash64("digest").alias("key")
    passed = "text binary, digest binary, at struct<id:bigint,file:string,row:bigint>, key bigint"
    hits = saved(table.select("text", "digest", "at", key).mapInArrow(split_by(key_bitmap(several.select(key), "key"), True), passed).drop("key"), "hits")
    parts = F.ceil(F.col("n") / HOT).cast("int")
    joined = join_one(hits, several, ["digest"], "n", hits.count(), alike=True).withColumn("parts", parts)
    members = saved(joined.select("digest", "text", "parts", F.pmod(F.xxhash64("at"), F.col("parts")).cast("int").alias("part"), (F.col("at") == F.col("k")).alias("first")), "members")
    located = members.where("first").select(F.col("digest").alias("e"), F.col("text").alias("content"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("f")).hint("merge")
    differ = (F.col("digest") == F.col("e")) & (F.col("part") == F.col("f")) & (F.col("text") != F.col("content"))
    unlike = saved(members.where("not first").join(located, differ).select("digest").distinct(), "unlike")
    plain = saved(table.select("digest", "at", F.sha2("text", 256).alias("text_sha256")), "digests")
    told = join_one(plain, known, ["digest"], "n", plain.count(), alike=True).select("digest", "at", "text_sha256", "keep", "n")
    if unlike.limit(1).count():
        clash = table.join(unlike, "digest", "left_semi")
        groups = clash.groupBy("digest", "text").agg(F.max("at").alias("keep"), F.count("*").alias("n"))
        exact = clash.join(groups, ["digest", "text"]).select("digest", "at", F.sha2("text", 256).alias("text_sha256"), "keep", "n")
        told = told.join(unlike, "digest", "left_anti").unionByName(exact)
    return told.select(F.col("at.id").alias("id"), F.col("keep.id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("at") == F.col("keep")).alias("kept"), "text_sha256")

