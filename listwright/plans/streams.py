"""Queries of SURVEY 2.10: event operators over a table of events, which run the same on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listwright import streaming as X
from listwright.plans.roles import framed
from listwright.sources import table


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


@framed("x02_rate_limit", """WITH RECURSIVE e AS (SELECT event_id, user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
    r AS (SELECT user_id, 1::BIGINT AS n, event_id, [ts] AS held, true AS allowed FROM e WHERE n = 1 UNION ALL SELECT s.user_id, s.n, s.event_id, CASE WHEN len(s.f) < 3 THEN list_append(s.f, s.ts) ELSE s.f END, len(s.f) < 3
    FROM (SELECT e.user_id, e.n, e.event_id, e.ts, list_filter(r.held, lambda t: e.ts - t <= INTERVAL 24 HOUR) AS f FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1) s) SELECT event_id, allowed FROM r""")  # fmt: skip
def x02(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = events(spark, sf_dir).select("event_id", "user_id", "ts")
    return X.rate_limited(calls, "user_id", "ts", 3, 24 * 3600).select("event_id", "allowed")


@framed("x03_latest_status", "SELECT user_id, max_by(event_type, (ts, event_id)) AS status FROM events GROUP BY user_id")
def x03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.latest_status(events(spark, sf_dir), "user_id", "event_type", "ts", "event_id")


@framed("x04_evicted_jobs", "SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn > 50")
def x04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.evicted(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", "o_orderkey").select("o_orderkey")


@framed("x05_first_choice", "SELECT user_id, min_by(event_type, (ts, event_type)) AS choice FROM events GROUP BY user_id")
def x05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.first_choice(events(spark, sf_dir), "user_id", "event_type", "ts")


@framed("x06_assembled_choices", """WITH r AS (SELECT l_orderkey AS job, l_partkey AS display_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_discount DESC, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS rank FROM lineitem), u AS (SELECT job, display_id, min(rank) AS rank FROM r GROUP BY 1, 2),
    s AS (SELECT l_orderkey AS job, list(DISTINCT l_partkey ORDER BY l_partkey) AS shown FROM lineitem GROUP BY 1) SELECT s.job, shown[1] AS chosen, u.rank AS chosen_rank, 0 AS shown_position, u.rank = 1 AS agreed_top1 FROM s JOIN u ON u.job = s.job AND u.display_id = shown[1]""")  # fmt: skip
def x06(spark: SparkSession, sf_dir: str) -> DataFrame:
    from listwright.operators.ranking import top_per

    li = table(spark, sf_dir, "lineitem")
    order = [F.desc("l_discount"), *map(F.col, ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))]
    ranking = top_per(li, ["l_orderkey"], order, 1 << 30, "rank").groupBy(F.col("l_orderkey").alias("job"), F.col("l_partkey").alias("display_id")).agg(F.min("rank").alias("rank"))
    shown = li.groupBy(F.col("l_orderkey").alias("job")).agg(F.array_sort(F.collect_set("l_partkey")).alias("shown")).withColumn("chosen", F.col("shown")[0])
    return X.assembled(shown, ranking)


@framed("x07_allowed_events", "SELECT event_id FROM events WHERE event_type IN ('click', 'error')")
def x07(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.allowed(events(spark, sf_dir), ("click", "error")).select("event_id")


@framed("x08_agreement_by_day", "SELECT date_trunc('day', ts) AS start, count(*) AS n, round(avg((value > 10)::INT), 6) AS rate FROM events GROUP BY 1")
def x08(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.agreement(events(spark, sf_dir).withColumn("agreed", F.col("value") > 10), "ts", "agreed").withColumn("rate", F.round("rate", 6))


@framed("x10_spaced_requests", """WITH RECURSIVE e AS (SELECT event_id, event_type, ts, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS n FROM events),
    r AS (SELECT event_type, n, event_id, ts AS starts_at FROM e WHERE n = 1 UNION ALL SELECT e.event_type, e.n, e.event_id, greatest(e.ts, r.starts_at + INTERVAL 600 SECOND) FROM r JOIN e ON e.event_type = r.event_type AND e.n = r.n + 1) SELECT event_id, starts_at FROM r""")  # fmt: skip
def x10(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = events(spark, sf_dir).select("event_id", "event_type", "ts")
    return X.spaced(calls, "event_type", "ts", 600.0, "event_id").select("event_id", "starts_at")


@framed("x03_running_total", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS n_so_far FROM events")
def x03b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.running_total(events(spark, sf_dir), "user_id", "ts", "event_id").select("event_id", "n_so_far")


@framed("x09_append_once", "SELECT user_id, min(event_id) AS first_id FROM events GROUP BY user_id")
def x09(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X-09, K-02 as a batch: of rows that repeat a key the first is appended."""
    e = events(spark, sf_dir)
    return X.first_choice(e.withColumn("one", F.lit(1)), "user_id", "event_id", "event_id").withColumnRenamed("choice", "first_id")


@framed("x01_heartbeats", """WITH m AS (SELECT user_id, epoch_us(ts) AS t, epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS p FROM events) SELECT user_id, CAST(sum(CASE WHEN p IS NULL THEN 0 ELSE greatest(0, (t - p + 3599999999) // 3600000000 - 1) END) AS BIGINT) AS beats FROM m GROUP BY user_id""")
def x01(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many heartbeats a stream of each user's messages needs between them, one an hour of silence."""
    return X.beats(events(spark, sf_dir), "user_id", "ts", "event_id", 3600)
