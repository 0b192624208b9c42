"""The driver's tables in the roles of listings, labels and ratings, in Spark and in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listwright.plans.registry import query
from listwright.sources import table

#: The same roles as common table expressions.
ROLES = {
    "listings": """listings AS (
      SELECT doc_id AS listing_id, source, CASE WHEN doc_id % 10 <> 0 THEN lang END AS occasion, CASE WHEN doc_id % 3 <> 0 THEN source END AS seller_id,
             n_chars AS reviews, text, CASE WHEN count(*) OVER (PARTITION BY md5(text)) > 1 THEN md5(text) END AS cluster_id
      FROM documents)""",
    "marks": "marks AS (SELECT doc_id AS listing_id, CAST(quality - toxic AS DOUBLE) AS score, quality, toxic FROM labels)",
    "ratings": """ratings AS (
      SELECT o_orderkey AS card_key, c_mktsegment AS condition, o_orderpriority AS occasion, o_totalprice / 500000 AS purchase_intent
      FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment <> 'HOUSEHOLD')""",
    "graded": """graded AS (
      SELECT l_orderkey * 10 + l_linenumber AS id, l_returnflag AS condition, l_discount AS purchase_intent, l_tax AS aesthetic, l_quantity / 50 AS fit
      FROM lineitem)""",
    "titles": """titles AS (
      SELECT p_partkey AS id, p_type, CASE p_partkey % 9
        WHEN 0 THEN concat(p_name, ' ', p_size, 'th Birthday') WHEN 1 THEN concat('Turning ', p_size + 9, ' for my Son') WHEN 2 THEN concat(p_name, ' age ', p_size)
        WHEN 3 THEN concat(p_size * 2, ' years old, for him') WHEN 4 THEN concat('Brother-in-law ', p_name) WHEN 5 THEN concat('My wife''s ', p_name, ' kids')
        WHEN 6 THEN concat('Happy 50th and ', p_size, 'rd') WHEN 7 THEN concat('Kidney ', p_name, ' at ', p_size) ELSE concat(p_name, ' card') END AS title,
        CASE p_partkey % 5 WHEN 0 THEN 'birthday/kids' WHEN 1 THEN 'birthday/milestone' WHEN 2 THEN 'birthday/relationship' WHEN 3 THEN 'birthday/general' END AS occasion
      FROM part)""",
    "brief": """briefs AS (
      SELECT o_orderkey AS card_id, o_orderpriority AS tag, CASE o_orderkey % 4
        WHEN 0 THEN concat('{"request":{"occasion":"', o_orderpriority, '"},"seed":', o_orderkey, '}') WHEN 1 THEN concat('{"occasion":"', o_orderstatus, '"}')
        WHEN 2 THEN '{"request":null,"seed":null}' ELSE NULL END AS brief
      FROM orders)""",
}


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as listings. A text that occurs more than once is a cluster; counts of texts, not windows, tell."""
    d = table(spark, sf_dir, "documents").withColumn("m", F.md5("text"))
    many = d.groupBy("m").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("m", F.col("m").alias("cluster_id"))
    return d.join(many, "m", "left").select(
        F.col("doc_id").alias("listing_id"), "source", F.when(F.col("doc_id") % 10 != 0, F.col("lang")).alias("occasion"),
        F.when(F.col("doc_id") % 3 != 0, F.col("source")).alias("seller_id"), F.col("n_chars").alias("reviews"), "text", "cluster_id",
    )


def _from_sql(name: str, cte: str) -> Callable[[SparkSession, str], DataFrame]:
    body = cte.partition(" AS (")[2].rstrip()[:-1]

    def make(spark: SparkSession, sf_dir: str) -> DataFrame:
        for t in TABLES:
            if t in _names(body):
                table(spark, sf_dir, t).createOrReplaceTempView(t)
        return spark.sql(body)

    return make


MAKERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {"listings": listings} | {n: _from_sql(n, c) for n, c in ROLES.items() if n != "listings"}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def _names(text: str) -> set[str]:
    return set("".join(c if c.isalnum() or c == "_" else " " for c in text).split())


def with_roles(text: str) -> str:
    """DuckDB SQL with the roles it names in front."""
    used = [c for n, c in ROLES.items() if {n, c.split(" ")[0]} & _names(text)]
    if not used:
        return text
    head = "WITH " + ",\n".join(used)
    body = text.strip()
    return f"{head},\n{body[4:].lstrip()}" if body[:4].upper() == "WITH" else f"{head}\n{body}"


def spark_sql(spark: SparkSession, sf_dir: str, text: str, **params) -> DataFrame:
    """Spark SQL over tables and roles by their names, as views of this session."""
    names = _names(text)
    for n, cte in ROLES.items():
        if {n, cte.split(" ")[0]} & names:
            MAKERS[n](spark, sf_dir).createOrReplaceTempView(cte.split(" ")[0])
    for t in TABLES:
        if t in names:
            table(spark, sf_dir, t).createOrReplaceTempView(t)
    return spark.sql(text, args=params or None)


def both(name: str, text: str, oracle: str | None = None) -> None:
    """Register a query that is SQL in either engine; the oracle's text differs where the dialects do."""
    query(name, with_roles(oracle or text))(lambda spark, sf_dir: spark_sql(spark, sf_dir, text))


def framed(name: str, oracle: str | None = None):
    """Register a DataFrame query with an oracle over the roles."""
    return query(name, with_roles(oracle) if oracle else None)
