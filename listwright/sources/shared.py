"""Written tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from functools import cache
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Partitions that fewer() merges into one.
MERGED = 8


@cache
def _own_dir() -> str:
    return "file://" + tempfile.mkdtemp(prefix="listwright-")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where that is unset, a local session gets one of its own; a cluster, whose
    executors could not see it, gets an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (named or _own_dir()).rstrip("/")


def fresh_dir(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def fewer(df: DataFrame) -> DataFrame:
    """df in up to MERGED times fewer partitions, but never fewer than four for each core, so that results much smaller than
    what they are made of are not dealt into as many files. No shuffle. Adaptive plans, which have one, count as having
    the session's shuffle partitions; the others have those of their files."""
    spark, plan = df.sparkSession, df._jdf.queryExecution().executedPlan()
    adaptive = plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec"
    now = int(spark.conf.get("spark.sql.shuffle.partitions")) if adaptive else plan.execute().getNumPartitions()
    return df.coalesce(max(4 * spark.sparkContext.defaultParallelism, -(-now // MERGED)))


def written(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage of df with a table in the shared folder: a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = fresh_dir(spark, label)
    fewer(df).write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def forgotten(*tables: DataFrame) -> None:
    """Delete tables of written() that no later plan reads, by Hadoop's file system."""
    for t in tables:
        if path := getattr(t, "_written_at", None):
            dropped(t.sparkSession, path)


def dropped(spark: SparkSession, path: str) -> None:
    """Delete a folder that an operator wrote and no longer needs."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def swept(spark: SparkSession) -> None:
    """Have the files of finished shuffles deleted: Spark does so once the driver's heap has been collected."""
    spark._jvm.System.gc()


@cache
def _packed() -> str:
    root = Path(__file__).resolve().parents[2]
    at = Path(tempfile.mkdtemp(prefix="listwright-code-")) / "listwright_code.zip"
    with zipfile.ZipFile(at, "w") as z:
        for f in sorted((root / "listwright").rglob("*.py")):
            z.write(f, f.relative_to(root))
    return str(at)


def shipped(spark: SparkSession) -> SparkSession:
    """The session, with this package on the path of its Python workers wherever the driver was started from. Spark serves
    the archive from the driver to the executors."""
    if not getattr(spark.sparkContext, "_listwright_shipped", False):
        spark.sparkContext.addPyFile(_packed())
        spark.sparkContext._listwright_shipped = True
    return spark
