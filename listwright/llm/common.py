"""What the operators of this subpackage share: the shared folder, written tables, file access, ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from listwright.sources.shared import dropped, fewer, forgotten, fresh_dir, shared_dir, shipped, swept, written

__all__ = ["buckets_for", "dropped", "fewer", "forgotten", "free_name", "fresh_dir", "opened", "ranked", "shared_dir", "swept", "tune", "written"]

#: Rows of one Arrow batch. Texts may be long, so batches are kept small.
BATCH_ROWS = 512
#: Rows of one rank bucket at large sizes; every group has at least LEAST_BUCKETS buckets.
BUCKET_ROWS, LEAST_BUCKETS = 100_000, 64


def tune(spark: SparkSession) -> None:
    """Small Arrow batches, and this package on the path of Python workers wherever the driver was started from."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    shipped(spark)


def opened(path: str, mode: str):
    """A stream on a file of the shared folder, inside a Python worker, by the scheme of its URI."""
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(path)
    if mode == "w":
        system.create_dir(at.rpartition("/")[0], recursive=True)
        return system.open_output_stream(at, compression=None)
    return system.open_input_file(at)


def free_name(df: DataFrame, name: str) -> str:
    """name, lengthened until no column of df has it; Spark compares names without case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def buckets_for(rows: int) -> int:
    return max(LEAST_BUCKETS, -(-rows // BUCKET_ROWS))


def ranked(df: DataFrame, groups: list[str], hashed: Column, ties: list[Column], rows: int, name: str, facts: DataFrame | None = None) -> DataFrame:
    """df with the rank (long, from 0) of each row within its group, ordered by a hash.

    A window over (groups, bucket of the hash) ranks inside the bucket, and the sum of the counts of the group's earlier
    buckets is added, so that a group with a third of all rows is still sorted by many tasks. facts, a row for each group,
    adds its columns by the same join. The columns of groups must hold no null. df is read twice: give a written table."""
    n = buckets_for(rows)
    keyed = df.withColumn("__h", hashed).withColumn("__b", F.pmod(F.col("__h"), F.lit(n)).cast("int"))
    before = Window.partitionBy(*groups).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    counts = keyed.groupBy(*groups, "__b").agg(F.count(F.lit(1)).alias("__n"))
    offsets = counts.select(*groups, "__b", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__o"))
    if facts is not None:
        offsets = offsets.join(facts, groups)
    inside = F.row_number().over(Window.partitionBy(*groups, "__b").orderBy("__h", *ties)) - 1
    out = keyed.withColumn("__i", inside).join(offsets, [*groups, "__b"])
    return out.withColumn(name, (F.col("__o") + F.col("__i")).cast("long")).drop("__h", "__b", "__i", "__o")
