"""Operator 3: proportional stratified interleaving."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from listwright.llm.common import buckets_for, fewer, ranked, written

SEED = 20_240_229


def interleaved(docs: DataFrame, shards: int = 8, seed: int = SEED, key: str = "doc_id", source: str = "source") -> DataFrame:
    """docs with shard (int) and slot (long, gapless from 0 in each shard), DataFrame functions only.

    Rows are shuffled within each source by a seeded hash of the key and ranked; row r (from 0) of a source with n rows
    stands at the fraction (r + 0.5) / n. The table in order of that fraction is cut into shards of equal row counts (at
    most one apart), so each shard holds every source in its share of the whole, to within about one row.

    Both rankings are split into buckets (of the hash, then of the fraction, which is evenly spread by construction), so
    a source with a third of all rows is sorted by many tasks. Null sources form one stratum of their own. Rows with
    equal keys are ordered by a hash of all their values; wholly equal rows are interchangeable. Texts, if any, are
    carried along. Input columns named shard or slot are replaced. An empty table gives an empty table."""
    kept = [c for c in docs.columns if c.lower() not in ("shard", "slot")]
    hashable = [c for c, t in docs.select(kept).dtypes if not t.startswith(("map", "variant"))]
    base = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"),
        F.struct(F.col(f"`{source}`").isNull().alias("none"), F.coalesce(F.col(f"`{source}`").cast("string"), F.lit("")).alias("name")).alias("stratum"),
        F.xxhash64(F.lit(seed), F.col(f"`{key}`")).alias("shuffled"),
        F.xxhash64(*[F.col(f"`{c}`") for c in hashable]).alias("whole"),
    )
    base = written(base, "interleave")
    rows = base.count()
    sizes = base.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"))
    placed = ranked(base, ["stratum"], F.col("shuffled"), [F.col("whole")], rows, "rank", sizes)
    placed = placed.select("row", "stratum", ((F.col("rank") + 0.5) / F.col("n")).alias("at"), F.xxhash64(F.lit(seed), "stratum").alias("turn"))
    many = buckets_for(rows)
    placed = placed.withColumn("b", F.least(F.floor(F.col("at") * many), F.lit(many - 1)).cast("int"))
    placed = written(placed, "interleave")
    before = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("b").agg(F.count(F.lit(1)).alias("n")).select("b", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("o"))
    inside = F.row_number().over(Window.partitionBy("b").orderBy("at", "turn", "stratum")) - 1
    total = max(rows, 1)
    out = placed.withColumn("i", inside).join(offsets, "b").withColumn("pos", F.col("o") + F.col("i"))
    out = out.withColumn("shard", F.expr(f"int(pos * {shards} div {total})"))
    return out.select("row.*", "shard", F.expr(f"pos - (shard * {total}L + {shards - 1}) div {shards}").cast("long").alias("slot"))


def op3_interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard under the law `rows`. No group is kept together: the mixture decides, not the text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        "doc_id", "source", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32")
    )
    return fewer(interleaved(docs).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source"
    ))
