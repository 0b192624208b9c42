"""Windows, top-k, ranks and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from listwright.sources.shared import written


def _by(cols: list[str | Column]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in cols]


def top_per(df: DataFrame, by: list[str | Column], order: list[Column], n: int, name: str = "rn") -> DataFrame:
    """W-01, W-02: the first n rows of each group, numbered from 1. Catalyst limits each task's groups before the shuffle."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*_by(by)).orderBy(*order))).where(F.col(name) <= n)


def best_per(df: DataFrame, by: list[str | Column], order: list[Column]) -> DataFrame:
    """W-04, W-08: the first row of each group."""
    return top_per(df, by, order, 1, "__rn").drop("__rn")


def best_struct(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """W-04 by aggregation: the row whose order is least, combined on the map side; order must be ascending."""
    rest = [c for c in df.columns if c not in by]
    pick = df.groupBy(*by).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("row"))
    return pick.select(*by, "row.*")


def stratified_top(df: DataFrame, key: Column, stratum: str, order: list[Column], limit: int) -> DataFrame:
    """W-05: one row a key, then max(1, limit // strata) rows of each stratum."""
    one = best_per(df, [key], order)
    quota = F.greatest(F.lit(1), F.floor(F.lit(limit) / F.col("n_strata")))
    strata = one.agg(F.count_distinct(stratum).alias("n_strata"))
    ranked = one.withColumn("rn", F.row_number().over(Window.partitionBy(stratum).orderBy(*order)))
    return ranked.crossJoin(F.broadcast(strata)).where(F.col("rn") <= quota).drop("n_strata")  # strata: one row


def largest_groups(df: DataFrame, group: str, member: str, groups: int, members: int) -> DataFrame:
    """W-03: the largest groups by dense rank of (size desc, id), their first members by row number. Groups are ranked as
    aggregated rows, by a sorted limit, never by a window over all members."""
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("size")).orderBy(F.desc("size"), group).limit(groups)
    ranked = sizes.withColumn("cluster_rank", F.row_number().over(Window.orderBy(F.desc("size"), F.col(group))))  # `groups` rows
    return top_per(df.join(ranked, group), [group], [F.col(member)], members, "member_rank")


def summed_before(df: DataFrame, order: list[Column], weight: Column, name: str) -> DataFrame:
    """df with the sum (long) of a weight over all rows before, in one order of the whole table that leaves no ties.

    Rows are sorted by ranges; a window sums inside each range, and the sums of the ranges before, a row for each of them,
    are added: no task holds all rows."""
    ranges = df.repartitionByRange(*order).sortWithinPartitions(*order)
    ranges = ranges.select("*", weight.cast("long").alias("__w"), F.spark_partition_id().alias("__p"), F.monotonically_increasing_id().alias("__m"))
    rows = written(ranges, "ranges")
    before = lambda w: F.coalesce(F.sum("__w").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = rows.groupBy("__p").agg(F.sum("__w").alias("__w")).select("__p", before(Window.orderBy("__p")).alias("__o"))
    inside = rows.withColumn("__i", before(Window.partitionBy("__p").orderBy("__m")))
    return inside.join(F.broadcast(sums), "__p").withColumn(name, F.col("__o") + F.col("__i")).drop("__w", "__p", "__m", "__o", "__i")


def average_ranks(df: DataFrame, value: str, by: list[str] = (), name: str = "rank") -> DataFrame:
    """W-07: ranks from 1 with ties at their mean. Counts of equal values are ranked, not rows."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("__k"))
    if by:
        before = Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.withColumn("__before", F.coalesce(F.sum("__k").over(before), F.lit(0)))
    else:
        counts = summed_before(counts, [F.col(value)], F.col("__k"), "__before")
    return df.join(counts.select(*by, value, (F.col("__before") + (F.col("__k") + 1) / 2).alias(name)), [*by, value])


def gaps(df: DataFrame, by: str, number: str) -> DataFrame:
    """W-10: the numbers between a group's least and greatest that it lacks."""
    ends = df.groupBy(by).agg(F.min(number).alias("lo"), F.max(number).alias("hi"))
    every = ends.select(by, F.explode(F.sequence("lo", "hi")).alias(number))
    return every.join(df.select(by, number).distinct(), [by, number], "left_anti")


def rotated(base: Column, i: Column, n: Column) -> Column:
    """W-12: the i-th of 1..n counted from a base that wraps around."""
    return F.pmod(base - 1 + i, n) + 1


def scaled(value: str, by: list[str], low: float = 18.0, high: float = 100.0) -> Column:
    """W-13: low..high inside a group; high where all are equal."""
    w = Window.partitionBy(*by)
    lo, hi = F.min(value).over(w), F.max(value).over(w)
    return F.when(hi > lo, low + (high - low) * (F.col(value) - lo) / (hi - lo)).otherwise(high)


def position_of(shown: Column, item: Column) -> Column:
    """W-14: the index, from 0, of an item in what was shown; null if it wasn't."""
    return F.nullif(F.array_position(shown, item), F.lit(0)) - 1


def md5_order(seed: str, *keys: Column) -> Column:
    """A random but repeatable order that any SQL engine can make too."""
    return F.md5(F.concat_ws("|", F.lit(seed), *[k.cast("string") for k in keys]))


def sample_per(df: DataFrame, by: list[str], key: str, n: int, seed: str = "42") -> DataFrame:
    """T-06, T-07, T-08: n rows of each group in a seeded order."""
    return top_per(df, by, [md5_order(seed, F.col(key)), F.col(key)], n, "draw")


def last_of(df: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """P-25, T-05, X-04: the last n rows of each group by an explicit order (given descending)."""
    return top_per(df, by, order, n, "__rn").drop("__rn")


def quota_then_topup(df: DataFrame, path: str, url: str, order: str, limit: int) -> DataFrame:
    """S-06: distinct URLs (each at its first place), an equal quota for each path, then the earliest of the rest up to the
    limit."""
    one = best_per(df, [url], [F.col(order)])
    n = one.agg(F.greatest(F.lit(1), F.floor(F.lit(limit) / F.count_distinct(path))).alias("quota"))
    ranked = one.withColumn("rn", F.row_number().over(Window.partitionBy(path).orderBy(order))).crossJoin(F.broadcast(n))  # one row
    return ranked.withColumn("second", F.col("rn") > F.col("quota")).orderBy("second", order).limit(limit).drop("rn", "quota", "second")
