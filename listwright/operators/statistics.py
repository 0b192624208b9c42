"""Rank statistics as aggregates over counts of equal values: a hot group shrinks to its distinct values before it is sorted."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from listwright.operators.ranking import average_ranks, summed_before
from listwright.sources.shared import written

# Coefficients of Hart's rational approximation of the normal distribution in double precision.
HART_TOP = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
HART_BOTTOM = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)
ROOT_TWO_PI = 2.506628274631
#: Rows of a group that one task of the bootstrap draws from.
PART_ROWS = 20_000


def _horner(coefficients: tuple[float, ...], x: Column) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + c
    return out


def normal_tail(z: Column) -> Column:
    """The chance that a standard normal number exceeds z, in built-in functions."""
    a = F.abs(z)
    e = F.exp(-a * a / 2)
    far = a + 1 / (a + 2 / (a + 3 / (a + 4 / (a + 0.65))))
    tail = F.when(a > 37, 0.0).when(a < 7.07106781186547, e * _horner(HART_TOP, a) / _horner(HART_BOTTOM, a)).otherwise(e / far / ROOT_TWO_PI)
    return F.when(z >= 0, tail).otherwise(1 - tail)


def pair_counts(df: DataFrame, group: str, value: str, by: list[str] = (), least: int = 3, shift: Column | None = None) -> DataFrame:
    """For each pair a < b of groups (inside by) with `least` values each: (by, a, b, v, na, nb), the counts of each value.

    shift is added to the values of b."""
    counts = df.where(F.col(value).isNotNull() & F.col(group).isNotNull()).groupBy(*by, F.col(group).alias("g"), F.col(value).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("k"))
    sizes = counts.groupBy(*by, "g").agg(F.sum("k").alias("n")).where(F.col("n") >= least)
    x, y = sizes.select(*by, F.col("g").alias("a")), sizes.select(*by, F.col("g").alias("b"))
    pairs = (x.join(y, list(by)) if by else x.crossJoin(y)).where("a < b")  # pairs of group names, not of rows
    moved = F.col("v") + shift if shift is not None else F.col("v")
    left = pairs.join(counts.withColumnRenamed("g", "a"), [*by, "a"]).select(*by, "a", "b", "v", F.col("k").alias("na"), F.lit(0).cast("long").alias("nb"))
    right = pairs.join(counts.withColumnRenamed("g", "b"), [*by, "b"]).select(*by, "a", "b", moved.alias("v"), F.lit(0).cast("long").alias("na"), F.col("k").alias("nb"))
    return left.unionByName(right).groupBy(*by, "a", "b", "v").agg(F.sum("na").alias("na"), F.sum("nb").alias("nb"))


def mann_whitney(pairs: DataFrame, by: list[str] = ()) -> DataFrame:
    """M-16, M-17: u (of a), n1, n2, rank_biserial, p_two, p_less, p_greater by the normal approximation with tie and
    continuity corrections, from pair_counts()."""
    key = [*by, "a", "b"]
    before = Window.partitionBy(*key).orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    won = F.col("na") * (F.coalesce(F.sum("nb").over(before), F.lit(0)) + F.col("nb") / 2)
    t = (F.col("na") + F.col("nb")).cast("double")  # as longs, t * t * t overflows from 2,097,152 equal values on
    sums = pairs.select(*key, "na", "nb", won.alias("won"), (t * (t * t - 1)).alias("tie")).groupBy(*key).agg(
        F.sum("won").alias("u"), F.sum("na").alias("n1"), F.sum("nb").alias("n2"), F.sum("tie").alias("ties"))
    n = (F.col("n1") + F.col("n2")).cast("double")
    couples = F.col("n1").cast("double") * F.col("n2")
    spread = F.sqrt(couples / 12.0 * ((n + 1) - F.col("ties") / (n * (n - 1))))
    off = F.col("u") - couples / 2
    z = lambda d: F.try_divide(d - 0.5, spread)
    at_most_one = lambda p: F.least(F.lit(1.0), F.coalesce(p, F.lit(1.0)))
    return sums.select(
        *key, "n1", "n2", "u", (1 - 2 * F.col("u") / couples).alias("rank_biserial"),
        at_most_one(2 * normal_tail(z(F.abs(off)))).alias("p_two"), at_most_one(normal_tail(z(-off))).alias("p_less"), at_most_one(normal_tail(z(off))).alias("p_greater"),
    )


def holm(tests: DataFrame, p: str, by: list[str] = (), order: list[str] = ("a", "b")) -> DataFrame:
    """M-18: p_holm, the step-down correction over all tests of a family."""
    w = Window.partitionBy(*by).orderBy(p, *order)
    m = F.count(F.lit(1)).over(Window.partitionBy(*by))
    stepped = tests.withColumn("__s", F.least(F.lit(1.0), (m - F.row_number().over(w) + 1) * F.col(p)))
    return stepped.withColumn("p_holm", F.max("__s").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__s")


def pairwise(df: DataFrame, group: str, value: str, by: list[str] = (), least: int = 3) -> DataFrame:
    """M-18, M-19, M-24: Mann-Whitney tests of all pairs of groups."""
    return mann_whitney(pair_counts(df, group, value, by, least), by)


def hodges_lehmann(pairs: DataFrame, by: list[str] = ()) -> DataFrame:
    """M-21: the median of all differences a - b, from pair_counts(): differences of distinct values, weighted."""
    key = [*by, "a", "b"]
    x = pairs.where("na > 0").select(*key, F.col("v").alias("va"), "na")
    y = pairs.where("nb > 0").select(*key, F.col("v").alias("vb"), "nb")
    diffs = x.join(y, key).groupBy(*key, (F.col("va") - F.col("vb")).alias("d")).agg(F.sum(F.col("na") * F.col("nb")).alias("w"))
    return diffs.groupBy(*key).agg(F.expr("percentile(d, 0.5, w)").alias("hodges_lehmann"))


def equivalence(df: DataFrame, group: str, value: str, delta: float = 0.02, least: int = 1) -> DataFrame:
    """M-20: p_tost, the larger of two one-sided rank tests on samples shifted by the margin, and the verdict."""
    upper = mann_whitney(pair_counts(df, group, value, (), least, F.lit(delta))).select("a", "b", F.col("p_less").alias("p_upper"))
    lower = mann_whitney(pair_counts(df, group, value, (), least, F.lit(-delta))).select("a", "b", F.col("p_greater").alias("p_lower"))
    p = F.greatest("p_lower", "p_upper")
    return upper.join(lower, ["a", "b"]).select("a", "b", F.lit(delta).alias("delta"), p.alias("p_tost"), (p < 0.05).alias("equivalent"))


def sensitivity(df: DataFrame, group: str, value: str, grid: list[float]) -> DataFrame:
    """M-23: p_tost over a grid of margins; first_delta is the least margin at which a pair is equivalent."""
    out = None
    for delta in grid:
        one = equivalence(df, group, value, delta)
        out = one if out is None else out.unionByName(one)
    return out.withColumn("first_delta", F.min(F.when(F.col("equivalent"), F.col("delta"))).over(Window.partitionBy("a", "b")))


def spearman(df: DataFrame, x: str, y: str, by: list[str] = (), least: int = 3) -> DataFrame:
    """M-11: rank correlation of complete rows; null below `least` rows or without spread.

    The rows are written first: ranks are joined by value, and a mean that is made twice may differ in its last bits."""
    whole = written(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, F.col(x).alias("__x"), F.col(y).alias("__y")), "ranked")
    ranks = average_ranks(average_ranks(whole, "__x", by, "rx"), "__y", by, "ry")
    return ranks.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.when(F.count(F.lit(1)) >= least, F.try_divide(F.covar_pop("rx", "ry"), F.stddev_pop("rx") * F.stddev_pop("ry"))).alias("rho"))


def spearman_matrix(df: DataFrame, dims: list[str], least: int = 3) -> DataFrame:
    """M-12, M-25: rho of every pair of columns."""
    out = None
    for i, x in enumerate(dims):
        for y in dims[i + 1 :]:
            one = spearman(df, x, y, (), least).select(F.lit(x).alias("dim_a"), F.lit(y).alias("dim_b"), "n", "rho")
            out = one if out is None else out.unionByName(one)
    return out


def calibration_bins(df: DataFrame, prediction: str, target: str, bins: int = 10) -> DataFrame:
    """M-10: for each bin that has rows its centre, means, count and share of the error; the last bin is closed. Values
    outside 0..1 are in no bin but count in n."""
    edges = [i / bins for i in range(bins)]
    p = F.col(prediction)
    b = F.when(p.between(0.0, 1.0), F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e <= p)) - 1)
    n = df.agg(F.count(F.lit(1)).alias("n"))
    grouped = df.withColumn("bin", b).where("bin is not null").groupBy("bin").agg(F.avg(prediction).alias("predicted"), F.avg(target).alias("observed"), F.count(F.lit(1)).alias("k"))
    return grouped.crossJoin(F.broadcast(n)).select(  # n: one row
        "bin", ((F.col("bin") + 0.5) / bins).alias("centre"), "predicted", "observed", "k", (F.col("k") / F.col("n") * F.abs(F.col("predicted") - F.col("observed"))).alias("error"))


def top_quartile_auc(df: DataFrame, prediction: str, target: str) -> DataFrame:
    """M-13: the area under the curve for targets of at least their 75th percentile, by rank sums; null if all are alike."""
    q = df.agg(F.expr(f"percentile(`{target}`, 0.75)").alias("q3"))
    marked = df.crossJoin(F.broadcast(q)).withColumn("top", F.col(target) >= F.col("q3"))  # q: one row
    s = average_ranks(marked, prediction, [], "r").agg(F.sum(F.when(F.col("top"), F.col("r"))).alias("s"), F.count_if("top").alias("n1"), F.count_if(~F.col("top")).alias("n0"))
    return s.select("n1", "n0", F.try_divide(F.col("s") - F.col("n1") * (F.col("n1") + 1) / 2, F.col("n1") * F.col("n0")).alias("auc"))


def _index(seed: str, n: Column, *parts: str) -> Column:
    """A repeatable number below n that any SQL engine can make too."""
    h = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), *[F.col(p).cast("string") for p in parts])), 1, 12), 16, 10).cast("long")
    return F.pmod(h, n)


def best_of_n(df: DataFrame, key: str, prediction: str, target: str, n: int = 8, trials: int = 20_000, seed: str = "0") -> DataFrame:
    """M-14: what the predictor's choice among n draws scores, against one draw and the best; ties go to the first draw."""
    rows = summed_before(df.select(key, prediction, target), [F.col(key)], F.lit(1), "i")
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    draws = df.sparkSession.range(trials).withColumnRenamed("id", "trial").withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    draws = draws.crossJoin(F.broadcast(total)).withColumn("i", _index(seed, F.col("total"), "trial", "draw"))  # total: one row
    one = draws.join(rows, "i").groupBy("trial").agg(
        F.max_by(F.col(target), F.struct(F.col(prediction), -F.col("draw"))).alias("picked"), F.max(target).alias("oracle"), F.min_by(target, "draw").alias("random"))
    out = one.agg(F.avg("picked").alias("picked"), F.avg("random").alias("random"), F.avg("oracle").alias("oracle"), F.avg((F.col("picked") == F.col("oracle")).cast("int")).alias("top1_accuracy"))
    return out.withColumn("recovered", F.try_divide(F.col("picked") - F.col("random"), F.col("oracle") - F.col("random")))


def bootstrap_mean(df: DataFrame, group: str, key: str, value: str, rounds: int = 10_000, level: float = 0.95, seed: int = 42) -> DataFrame:
    """M-22: (group, low, high), a percentile interval of each group's mean from seeded resamples. Rows without a value don't
    count; a group without any has no row.

    A group's rows are dealt by a hash of the key to parts of about PART_ROWS. Each part gives, for all rounds, the sum of
    its draws and their number; a round's mean is the ratio of their totals. A group of one part draws as many rows as
    it has, the plain bootstrap. In larger groups the parts' numbers of draws are Poisson, so that parts need not know
    of each other; they make up the group's size to within a share of 1 / sqrt(rows)."""
    rows = df.where(F.col(value).isNotNull()).select(F.col(group).alias("g"), F.col(key).cast("string").alias("k"), F.col(value).cast("double").alias("v"))
    sizes = rows.groupBy(F.col("g").alias("of")).agg(F.ceil(F.count(F.lit(1)) / PART_ROWS).cast("int").alias("parts"))
    dealt = rows.join(sizes, F.col("g").eqNullSafe(F.col("of"))).drop("of")
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("k"), F.col("parts")).cast("int"))
    kind = df.schema[group].dataType.simpleString()

    def draw(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["k", "v"])
        x, name = part["v"].to_numpy(), part["g"].iloc[0]
        rng = np.random.default_rng([seed, zlib.crc32(str(name).encode()), int(part["part"].iloc[0])])
        n = np.full(rounds, len(x)) if part["parts"].iloc[0] == 1 else rng.poisson(len(x), rounds)
        sums, step = np.zeros(rounds), max(1, (1 << 22) // len(x))
        for at in range(0, rounds, step):
            many = n[at : at + step]
            drawn = np.concatenate((x[rng.integers(0, len(x), many.sum())], [0.0]))
            ends = np.cumsum(many)
            total = np.concatenate(([0.0], np.cumsum(drawn)))
            sums[at : at + step] = total[ends] - total[ends - many]
        return pd.DataFrame({"g": [name] * rounds, "r": np.arange(rounds, dtype=np.int32), "s": sums, "n": n})

    drawn = dealt.groupBy("g", "part").applyInPandas(draw, f"g {kind}, r int, s double, n long")
    means = drawn.groupBy("g", "r").agg((F.sum("s") / F.sum("n")).alias("m"))
    tail = (1 - level) / 2
    return means.groupBy(F.col("g").alias(group)).agg(F.expr(f"percentile(m, {tail})").alias("low"), F.expr(f"percentile(m, {1 - tail})").alias("high"))


def group_summary(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """A-11, A-14: n, mean, sd and standard error (0 for a single value), least and greatest."""
    sd = F.coalesce(F.stddev_samp(value), F.lit(0.0))
    return df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), sd.alias("sd"), (sd / F.sqrt(F.count(value))).alias("sem"), F.min(value).alias("low"), F.max(value).alias("high"))
