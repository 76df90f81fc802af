"""Counters and distributions over an event table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Samples that a distribution looks back on.
SAMPLES = 1024


def label_key(name: Column, labels: Column) -> Column:
    """One key of a name and its labels, sorted by label."""
    pairs = F.transform(F.array_sort(F.map_entries(labels)), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return F.when(F.size(pairs) > 0, F.concat(name, F.lit("{"), F.array_join(pairs, ","), F.lit("}"))).otherwise(name)


def counters(events: DataFrame, key: Column, value: Column) -> DataFrame:
    return events.groupBy(key.alias("key")).agg(F.sum(value).alias("total"))


def nearest_rank(values: Column, q: float) -> Column:
    """The value at position round-half-even(q (n - 1)) of a sorted array."""
    at = F.bround(F.lit(float(q)) * (F.size(values) - 1).cast("double"), 0).cast("int")
    return F.get(values, at)


def latest_samples(events: DataFrame, key: str, order: list[Column], limit: int = SAMPLES) -> DataFrame:
    """The last `limit` rows of each key. A hot key is cut in its partitions first, then once more."""
    spread = events.withColumn("_part", F.spark_partition_id())
    for own in ([key, "_part"], [key]):
        window = Window.partitionBy(*own).orderBy(*order)
        spread = spread.withColumn("_n", F.row_number().over(window)).where(F.col("_n") <= limit)
    return spread.drop("_part", "_n")


def distributions(samples: DataFrame, key: str, value: str) -> DataFrame:
    """Count, bounds, mean and nearest-rank percentiles of bounded samples (see latest_samples)."""
    got = samples.groupBy(key).agg(F.count(value).alias("n"), F.min(value).alias("least"), F.max(value).alias("most"), F.avg(value).alias("mean"), F.array_sort(F.collect_list(value)).alias("_all"))
    return got.select(key, "n", "least", "most", F.round("mean", 6).alias("mean"), *[nearest_rank(F.col("_all"), q).alias(f"p{int(q * 100)}") for q in (0.5, 0.95, 0.99)])
