"""Operator 8: mixing sources to target weights by entropy balancing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from listwright.llm.common import fewer, forgotten, free_name, ranked, written

SEED = 8_128
WORD = r"[^\x20\x09-\x0D]+"
#: Rates are fixed-point numbers with so many binary places, so that sums of rates are exact whatever their order.
PLACES = 20
#: A Newton run ends when each source's tokens are within CLOSE of its target, as a share of it; after ROUNDS, NEAR must do.
CLOSE, NEAR, ROUNDS = 1e-10, 1e-6, 60


def targets(sources: DataFrame, share: float, cap: float, weights: tuple[float, ...]) -> DataFrame:
    """(src, tokens, n, target): a total of share times all tokens, dealt by weight with each source capped.

    sources has a row per source: src (struct of none and name), tokens, n. Weights repeat in order of the name by code
    point, null last. Capping and resharing the excess by weight until no source is above its cap ends at
    min(cap, level * weight) for one level; it is found by one pass in order of cap / weight."""
    by_name = Window.orderBy("src")
    by_fill = Window.orderBy("fill", "src")
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sources.withColumn("w", weight).withColumn("cap", F.col("tokens") * float(cap)).withColumn("fill", F.col("cap") / F.col("w"))
    everything = Window.partitionBy()
    s = s.withColumn("total", F.sum("tokens").over(everything) * float(share)).withColumn("all_w", F.sum("w").over(everything))
    s = s.withColumn("cap_before", F.coalesce(F.sum("cap").over(before), F.lit(0.0))).withColumn("w_before", F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    s = s.withColumn("level", (F.col("total") - F.col("cap_before")) / (F.col("all_w") - F.col("w_before")))
    s = s.withColumn("first", F.min(F.when(F.col("level") <= F.col("fill"), F.struct("fill", "src", "level"))).over(everything))
    target = F.least("cap", F.coalesce(F.col("first.level") * F.col("w"), F.col("cap")))
    return s.select("src", "tokens", "n", target.alias("target"))


def tilts(spread: DataFrame, sources: DataFrame, cap: float) -> DataFrame:
    """(src, tilt, mean): the solution of the convex dual, one multiplier a source, by safeguarded Newton rounds.

    Among all rates r in (0, cap), those of least relative entropy (of r against cap - r) that meet
    sum(r * size) = target satisfy r / (cap - r) = exp(tilt * size / mean size): an exponential tilt, kept under the cap.
    The dual's gradient and curvature of each round are two sums per source over spread (src, size, k), the counts of
    equal sizes. A Newton step that leaves the bracket of the root is replaced by its middle."""
    weighed = spread.join(sources.select("src", (F.col("tokens") / F.col("n")).alias("mean")), "src")
    weighed = written(weighed.where("size > 0").withColumn("x", F.col("size") / F.col("mean")).select("src", "x", (F.col("size") * F.col("k")).alias("mass")), "mix-sizes")
    pull = weighed.groupBy("src").agg((F.sum(F.col("mass") * F.col("x")) / F.sum("mass")).alias("pull"))
    share = F.col("target") / (F.col("tokens") * cap)
    full = share >= 1 - 1e-12
    first = sources.where("tokens > 0").join(pull, "src").select(
        "src", "target", (F.col("tokens") / F.col("n")).alias("mean"), full.alias("full"),
        F.when(full, 0.0).otherwise(F.log(share / (1 - share)) / F.col("pull")).alias("tilt"),
        F.lit(-float("inf")).alias("lo"), F.lit(float("inf")).alias("hi"), F.lit(1.0).alias("off"),
    )
    now = written(first, "mix-tilt")
    for _ in range(ROUNDS):
        p = 1 / (1 + F.exp(-F.col("tilt") * F.col("x")))
        sums = weighed.join(now.select("src", "tilt"), "src").groupBy("src").agg(F.sum(F.col("mass") * p * cap).alias("got"), F.sum(F.col("mass") * F.col("x") * p * (1 - p) * cap).alias("bend"))
        step = now.join(sums, "src").withColumn("over", F.col("got") - F.col("target"))
        step = step.withColumn("lo", F.when(F.col("over") <= 0, F.greatest("lo", "tilt")).otherwise(F.col("lo"))).withColumn("hi", F.when(F.col("over") >= 0, F.least("hi", "tilt")).otherwise(F.col("hi")))
        newton = F.col("tilt") - F.when(F.col("bend") > 0, F.col("over") / F.col("bend")).otherwise(0.0)
        far = F.col("tilt") * 2 + F.when(F.col("over") > 0, -1.0).otherwise(1.0)
        middle = F.when((F.col("lo") > -1e300) & (F.col("hi") < 1e300), (F.col("lo") + F.col("hi")) / 2).otherwise(far)
        inside = (F.col("bend") > 0) & (newton >= F.col("lo")) & (newton <= F.col("hi"))
        off = F.when(F.col("full"), 0.0).otherwise(F.abs("over") / F.col("target"))
        moved = F.when(off < CLOSE, F.col("tilt")).when(inside, newton).otherwise(middle)
        last, now = now, written(step.select("src", "target", "mean", "full", moved.alias("tilt"), "lo", "hi", off.alias("off")), "mix-tilt")
        forgotten(last)
        worst = now.agg(F.max("off")).first()[0]
        if worst is None or worst < CLOSE:
            break
    else:
        if worst > NEAR:
            raise RuntimeError(f"the dual did not converge: a source is off its target by {worst:.3g} of it")
    forgotten(weighed)
    return now.select("src", "full", F.expr("round(tilt, 9)").alias("tilt"), "mean")


def mixed(
    docs: DataFrame, key: str = "doc_id", source: str = "source", size: str | None = None, text: str = "text", share: float = 1.5, cap: int = 2,
    weights: tuple[float, ...] = (3, 1, 2), seed: int = SEED, carry_text: bool = True,
) -> DataFrame:
    """docs with size, source_size, target, rate (double), copies (int) and taken (long), DataFrame functions only.

    size counts the words of the text unless a column of sizes is named. Each source is to give `target` words. Rates
    come from tilts(); they are rounded into copies 0..cap by cumulative rounding down each source's documents in order
    of size, so a source misses its target by about half its longest document at most. Equal sizes have equal rates;
    among them a seeded hash of the key orders, in buckets, so that no group of equal sizes is sorted by one task.

    Null texts have size 0 and are never taken; a source without words has target 0; null is a source of its own, last.
    Rows that repeat a key are separate documents. Columns of the input with an output's name are replaced. An empty
    table gives an empty table."""
    new = ("size", "source_size", "target", "rate", "copies", "taken")
    kept = [c for c in docs.columns if c.lower() not in new and (carry_text or c != text)]
    count = F.col(f"`{size}`").cast("long") if size else F.coalesce(F.regexp_count(F.col(f"`{text}`"), F.lit(WORD)), F.lit(0)).cast("long")
    hashable = [c for c, t in docs.select(kept).dtypes if not t.startswith(("map", "variant"))]
    base = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.coalesce(count, F.lit(0)).alias("size"),
        F.struct(F.col(f"`{source}`").isNull().alias("none"), F.coalesce(F.col(f"`{source}`").cast("string"), F.lit("")).alias("name")).alias("src"),
        F.xxhash64(F.lit(seed), F.col(f"`{key}`")).alias("shuffled"), F.xxhash64(*[F.col(f"`{c}`") for c in hashable]).alias("whole"),
    )
    base = written(base, "mix-docs")
    spread = written(base.groupBy("src", "size").agg(F.count(F.lit(1)).alias("k")), "mix-spread")
    rows = spread.agg(F.sum("k")).first()[0] or 0
    sources = spread.groupBy("src").agg(F.sum(F.col("size") * F.col("k")).alias("tokens"), F.sum("k").alias("n"))
    sources = written(targets(sources, share, cap, weights), "mix-targets")
    tilt = tilts(spread, sources, float(cap))
    one = 1 << PLACES
    exact = F.when(F.col("full"), F.lit(cap * one)).otherwise(F.least(F.lit(cap * one), F.floor(one * cap / (1 + F.exp(-F.col("tilt") * F.col("size") / F.col("mean"))))))
    rates = spread.join(tilt, "src", "left").withColumn("q", F.when(F.col("size") > 0, F.coalesce(exact, F.lit(0))).otherwise(F.lit(0)).cast("long"))
    before = Window.partitionBy("src").orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, -1)
    rates = rates.withColumn("c", F.coalesce(F.sum(F.col("q") * F.col("k")).over(before), F.lit(0)) + (one >> 1))
    rates = rates.join(sources.select("src", F.col("tokens").alias("source_size"), "target"), "src").select("src", "size", "q", "c", "source_size", "target")
    out = ranked(base, ["src", "size"], F.col("shuffled"), [F.col("whole")], rows, "rank", rates)
    out = out.withColumn("copies", F.expr(f"int(((c + (rank + 1) * q) div {one}) - ((c + rank * q) div {one}))"))
    return out.select("row.*", "size", "source_size", "target", (F.col("q") / one).alias("rate"), "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def repeated(docs: DataFrame, copies: str = "copies") -> DataFrame:
    """Each row as often as its copies say; the column itself is dropped."""
    turn = free_name(docs, "turn")
    many = docs.where(F.col(copies) > 0).withColumn(turn, F.explode(F.sequence(F.lit(1), F.col(copies))))
    return many.drop(turn, copies)


def op8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document, with the words that the mixture takes of it. Null texts have size 0 and give none; a null
    source is one of its own, the last; repeated ids are separate documents; no documents give no rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return fewer(mixed(docs, carry_text=False).select("doc_id", "size", "source_size", "target", "taken", "copies", "rate", "source"))
