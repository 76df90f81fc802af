"""The local session that tests and the benchmark share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, shuffle: int = 8, memory: str = "8g") -> SparkSession:
    """A UTC session on local cores; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("parchmint")
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.useObjectHashAggregateExec", "false")  # lines come sorted by document: sort aggregates stream, hash tables of whole lines spill
        .config("spark.sql.python.filterPushdown.enabled", "true")  # sources.calls.ProviderSource asks for it
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")  # plans of thousands of expressions build in half the time
        .getOrCreate()
    )


def spread(df: DataFrame) -> DataFrame:
    """A table read with fewer tasks than the cluster has cores (few files, or few row groups in them), dealt over all of them.

    A table of more splits than cores, as any large one is, stays as it is and moves no row.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 0 < df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df
