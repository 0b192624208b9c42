"""Queries of SURVEY 2.2: each sink as the table that it leaves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listwright.operators import upserts as U
from listwright.plans.roles import MAKERS, both, framed
from listwright.sources import table

OLD = "SELECT p_partkey AS k, p_name AS title, p_brand AS url, CASE WHEN p_partkey % 2 = 0 THEN p_size END AS price, p_partkey AS first_seen, 1 AS last_seen FROM part WHERE p_partkey % 3 <> 0"
NEW = "SELECT p_partkey AS k, CASE WHEN p_partkey % 5 <> 0 THEN concat('new ', p_name) END AS title, p_type AS url, CASE WHEN p_partkey % 4 = 0 THEN p_size + 100 END AS price FROM part WHERE p_partkey % 2 = 0 OR p_partkey % 3 = 0"


def frame(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    for t in ("part", "documents", "labels", "orders", "events"):
        if t in text:
            table(spark, sf_dir, t).createOrReplaceTempView(t)
    return spark.sql(text)


@framed("k01_upsert_listings", f"""SELECT coalesce(n.k, o.k) AS k, CASE WHEN n.k IS NULL THEN o.title ELSE coalesce(n.title, o.title) END AS title, CASE WHEN n.k IS NULL THEN o.url ELSE n.url END AS url,
    CASE WHEN n.k IS NULL THEN o.price ELSE n.price END AS price, CASE WHEN o.k IS NULL THEN 2 ELSE o.first_seen END AS first_seen, CASE WHEN n.k IS NULL THEN o.last_seen ELSE 2 END AS last_seen FROM ({OLD}) o FULL JOIN ({NEW}) n ON o.k = n.k""")  # fmt: skip
def k01(spark: SparkSession, sf_dir: str) -> DataFrame:
    policy = {"title": U.FILL_NEW, "url": U.KEEP_NEW, "price": U.KEEP_NEW, "first_seen": U.KEEP_OLD, "last_seen": U.KEEP_NEW}
    return U.upserted(frame(spark, sf_dir, OLD), frame(spark, sf_dir, NEW), ["k"], policy, {"first_seen": F.lit(2).cast("long"), "last_seen": F.lit(2)})


SNAP = "SELECT user_id AS k, date_trunc('hour', ts) AS at, min(event_id) AS first_id FROM events WHERE {} GROUP BY 1, 2"


@framed("k02_append_snapshots", f"WITH o AS ({SNAP.format('event_id % 2 = 0')}), n AS ({SNAP.format('true')}) SELECT * FROM o UNION ALL SELECT * FROM n WHERE (k, at) NOT IN (SELECT (k, at) FROM o)".replace(" at", " at_").replace("at,", "at_,").replace(", at)", ", at_)"))
def k02(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = (frame(spark, sf_dir, SNAP.format(w).replace(" at,", " at_,")) for w in ("event_id % 2 = 0", "true"))
    return U.appended(old, new, ["k", "at_"])


@framed("k03_upsert_images", f"SELECT coalesce(n.k, o.k) AS k, CASE WHEN n.k IS NULL THEN o.url ELSE n.url END AS url FROM ({OLD}) o FULL JOIN ({NEW}) n ON o.k = n.k")
def k03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.upserted(frame(spark, sf_dir, OLD).select("k", "url"), frame(spark, sf_dir, NEW).select("k", "url"), ["k"], {"url": U.KEEP_NEW})


@framed("k04_write_once", f"SELECT coalesce(n.k, o.k) AS k, CASE WHEN n.k IS NULL THEN o.price ELSE coalesce(o.price, n.price) END AS price FROM ({OLD}) o FULL JOIN ({NEW}) n ON o.k = n.k")
def k04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.upserted(frame(spark, sf_dir, OLD).select("k", "price"), frame(spark, sf_dir, NEW).select("k", "price"), ["k"], {"price": U.FILL_OLD})


@framed("k05_upsert_features", f"SELECT coalesce(n.k, o.k) AS k, CASE WHEN n.k IS NULL THEN o.title ELSE n.title END AS title, CASE WHEN n.k IS NULL THEN 'v1' ELSE 'v2' END AS version FROM ({OLD}) o FULL JOIN ({NEW}) n ON o.k = n.k")
def k05(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = frame(spark, sf_dir, OLD).select("k", "title", F.lit("v1").alias("version"))
    return U.upserted(old, frame(spark, sf_dir, NEW).select("k", "title"), ["k"], {"title": U.KEEP_NEW, "version": U.KEEP_NEW}, {"version": F.lit("v2")})


@framed("k06_upsert_keeps_version", f"SELECT coalesce(n.k, o.k) AS k, CASE WHEN n.k IS NULL THEN o.title ELSE n.title END AS title, CASE WHEN o.k IS NULL THEN 'v2' ELSE 'v1' END AS version FROM ({OLD}) o FULL JOIN ({NEW}) n ON o.k = n.k")
def k06(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = frame(spark, sf_dir, OLD).select("k", "title", F.lit("v1").alias("version"))
    return U.upserted(old, frame(spark, sf_dir, NEW).select("k", "title"), ["k"], {"title": U.KEEP_NEW, "version": U.KEEP_OLD}, {"version": F.lit("v2")})


@framed("k07_recomputed_clusters", "SELECT d.doc_id, c.m AS cluster_id, c.n AS cluster_size FROM documents d LEFT JOIN (SELECT md5(text) AS m, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1) c ON md5(d.text) = c.m")
def k07(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("m"), F.lit("stale").alias("cluster_id"), F.lit(9).cast("long").alias("cluster_size"))
    sizes = d.groupBy("m").agg(F.count(F.lit(1)).alias("cluster_size")).where("cluster_size > 1")
    found = d.select("doc_id", "m").join(sizes, "m").select("doc_id", F.col("m").alias("cluster_id"), "cluster_size")
    return U.recomputed(d.drop("m"), found, "doc_id", ["cluster_id", "cluster_size"])


@framed("k09_upsert_labels", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN quality + 10 ELSE quality END AS score, 'judge' AS label_source FROM labels")
def k09(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "labels").select("doc_id", F.lit("judge").alias("label_source"), F.col("quality").alias("score"))
    new = old.where("doc_id % 2 = 0").withColumn("score", F.col("score") + 10)
    return U.upserted(old, new, ["doc_id", "label_source"], {"score": U.KEEP_NEW})


@framed("k10_rescored", "SELECT event_id, CASE WHEN event_type = 'click' THEN CAST(json_extract_string(props, '$.k') AS DOUBLE) ELSE value END AS score FROM events")
def k10(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumnRenamed("value", "score")
    return U.rescored(rows, "props", "k", F.col("event_type") == "click").select("event_id", "score")


@framed("k13_column_if_absent", "SELECT p_partkey, p_name, NULL::DOUBLE AS score FROM part")
def k13(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    return U.with_column_if_absent(U.with_column_if_absent(p, "score", "double"), "p_name", "string")


@framed("k14_wiped", "SELECT p_partkey, NULL::VARCHAR AS p_name FROM part")
def k14(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.wiped(table(spark, sf_dir, "part").select("p_partkey", "p_name"), ["p_name"])


@framed("k17_ratings_cache", "SELECT card_key, 'cached' AS origin FROM ratings WHERE card_key % 3 = 0 UNION ALL SELECT card_key, 'new' FROM ratings WHERE card_key % 3 <> 0")
def k17(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = MAKERS["ratings"](spark, sf_dir).select("card_key")
    return U.appended(r.where("card_key % 3 = 0").withColumn("origin", F.lit("cached")), r.withColumn("origin", F.lit("new")), ["card_key"])


@framed("k18_gallery_html", "SELECT source, concat('<section>', string_agg(concat('<figure>', listing_id, '</figure>'), '' ORDER BY listing_id), '</section>') AS html FROM listings GROUP BY source")
def k18(spark: SparkSession, sf_dir: str) -> DataFrame:
    figure = F.concat(F.lit("<figure>"), F.col("doc_id").cast("string"), F.lit("</figure>"))
    cards = table(spark, sf_dir, "documents").groupBy("source").agg(F.array_sort(F.collect_list(F.struct("doc_id", figure.alias("f")))).alias("c"))
    return cards.select("source", F.concat(F.lit("<section>"), F.array_join(F.transform("c", lambda x: x["f"]), ""), F.lit("</section>")).alias("html"))


@framed("k19_latex_rows", "SELECT concat(l_returnflag, ' & ', count(*), ' & ', printf('%.1f', sum(l_quantity)), ' \\\\') AS line FROM lineitem GROUP BY l_returnflag")
def k19(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("q"))
    return g.select(F.format_string("%s & %d & %.1f \\\\", "l_returnflag", "n", "q").alias("line"))


both("k20_manifest", "SELECT source, min(listing_id) AS cover, count(*) AS n FROM listings GROUP BY source")
