"""The folder that all executors share, tables cut there, and ordering at scale."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def work_dir(spark: SparkSession) -> str:
    """A folder of this application in ``spark.checkpoint.dir``.

    Where the setting is missing, a session on one machine uses its warehouse; a cluster must name a folder that all
    executors share.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = os.path.join(spark.conf.get("spark.sql.warehouse.dir", "spark-warehouse"), "casework-work")
    return f"{base.rstrip('/')}/{spark.sparkContext.applicationId}"


def fresh(spark: SparkSession, kind: str = "parquet") -> str:
    return f"{work_dir(spark)}/casework-{uuid.uuid4().hex}.{kind}"


def clear(spark: SparkSession) -> None:
    """Deletes what this application wrote to the shared folder; no frame made before can be used afterwards."""
    path = spark._jvm.org.apache.hadoop.fs.Path(work_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, so that later plans do not recompute it."""
    path = fresh(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Deletes the table that ``cut`` has returned as ``df``; no frame made from it can be used afterwards."""
    spark = df.sparkSession
    for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


SPREAD_MOST = 4 << 30


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores, where its files give fewer parts than there are cores.

    Only small inputs (4 GB by the optimizer's estimate) that lie in few files are moved, 2 MB or more to a part; larger
    ones have parts enough and are left as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    parts = df.rdd.getNumPartitions()
    if parts >= cores:
        return df
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size > SPREAD_MOST:
        return df
    want = min(cores, max(8, size >> 21))
    return df.repartition(want) if want > parts else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in ("documents", "payloads", "dense_docs") else df


def ranked(df: DataFrame, order: list[Column | str], *, total: Column | None = None, rank: str = "rank", running: str = "running") -> DataFrame:
    """``df`` with ``rank`` (from 1) in the total order ``order`` and, where ``total`` is given, its running sum before the row.

    No row leaves its range: the rows are range-partitioned and written, a window numbers each range, and
    each range's offset comes from one row per range.  ``order`` must be total for a unique result.
    """
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    value = F.lit(0).cast("long") if total is None else total.cast("long")
    parts = cut(df.withColumn("_value", value).repartitionByRange(*cols).withColumn("_part", F.spark_partition_id()))
    sums = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("n"), F.sum("_value").alias("s")).orderBy("_part").collect()
    offsets, n, s = [], 0, 0
    for r in sums:  # one row per range
        offsets.append((r["_part"], n, s))
        n, s = n + r["n"], s + (r["s"] or 0)
    before = F.broadcast(df.sparkSession.createDataFrame(offsets, "_part int, _n long, _s long"))
    w = Window.partitionBy("_part").orderBy(*cols)
    out = parts.join(before, "_part").withColumn(rank, F.row_number().over(w) + F.col("_n"))
    if total is not None:
        out = out.withColumn(running, F.sum("_value").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_value") + F.col("_s"))
    return out.drop("_part", "_n", "_s", "_value")
