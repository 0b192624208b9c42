"""Queries of SURVEY 2.1 and 2.3 to 2.7: scans, predicates, joins, aggregates, windows, sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from listwright.operators import ranking as R
from listwright.operators.designs import design_key, representatives
from listwright.operators.statistics import group_summary
from listwright.plans.roles import MAKERS, both, framed, listings, spark_sql
from listwright.sources import latest, table

KEY = "coalesce(cluster_id, CAST(listing_id AS VARCHAR(20)))"


def role(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return MAKERS[name](spark, sf_dir)


# -- scans -------------------------------------------------------------------------------------------------------------

both("s01_scan", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_totalprice > 400000")


@framed("s02_sql_with_params", "SELECT count(*) AS n, CAST(sum(l_quantity) AS DOUBLE) AS quantity FROM lineitem WHERE l_returnflag = 'R' AND l_quantity <= 10")
def s02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark_sql(spark, sf_dir, "SELECT count(*) AS n, sum(l_quantity) AS quantity FROM lineitem WHERE l_returnflag = :flag AND l_quantity <= :most", flag="R", most=10)


@framed("s05_discovered_links", r"""SELECT page_id, len(list_distinct([x FOR x IN regexp_extract_all(html, '(?is)<a\b[^>]*\bhref\s*=\s*["'']([^"'']*)["'']', 1) IF x <> '' AND contains(x, '/')])) AS n_links,
    regexp_replace(url, '\?.*', '') AS bare_url FROM pages""")  # fmt: skip
def s05(spark: SparkSession, sf_dir: str) -> DataFrame:
    from listwright.functions.web import links, without_query

    return table(spark, sf_dir, "pages").select("page_id", F.size(links(F.col("html"), "/")).cast("long").alias("n_links"), without_query(F.col("url")).alias("bare_url"))


@framed("s06_quota_then_topup", """WITH one AS (SELECT p_name AS url, min(p_partkey) AS pos, min_by(p_type, p_partkey) AS path FROM part GROUP BY p_name),
    q AS (SELECT greatest(1, 20 // count(DISTINCT path)) AS quota FROM one), r AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY pos) AS rn FROM one)
    SELECT url, path, pos FROM r, q ORDER BY rn > quota, pos LIMIT 20""")  # fmt: skip
def s06(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select(F.col("p_type").alias("path"), F.col("p_name").alias("url"), F.col("p_partkey").alias("pos"))
    return R.quota_then_topup(part, "path", "url", "pos", 20)


@framed("s07_first_seen_urls", "SELECT regexp_replace(url, '[?#].*', '') AS bare, min(page_id) AS page_id FROM pages GROUP BY 1")
def s07(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").groupBy(F.regexp_replace("url", "[?#].*", "").alias("bare")).agg(F.min("page_id").alias("page_id"))


@framed("s19_latest_tag", "SELECT max_by(tag, (ts, tag)) AS tag FROM (SELECT CASE WHEN o_orderkey % 3 <> 0 THEN o_orderpriority END AS tag, o_orderdate AS ts FROM orders) WHERE tag IS NOT NULL")
def s19(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderpriority")).alias("tag"), F.col("o_orderdate").alias("at"))
    return latest(o, "tag", "at")


# -- projections, filters, predicates ----------------------------------------------------------------------------------

both("p01_coalesce", "SELECT l.listing_id, coalesce(m.score, 0) AS score, coalesce(l.occasion, '') AS occasion FROM listings l LEFT JOIN marks m ON l.listing_id = m.listing_id")


@framed("p02_design_key", f"SELECT listing_id, {KEY} AS design FROM listings")
def p02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listings(spark, sf_dir).select("listing_id", design_key().alias("design"))


both("p03_null_tests", "SELECT count(*) AS n FROM listings WHERE occasion IS NOT NULL AND cluster_id IS NULL")
both("p04_is_distinct_from", "SELECT listing_id FROM listings WHERE seller_id IS DISTINCT FROM source OR occasion IS DISTINCT FROM 'en'")
both("p05_any_of", "SELECT o_orderkey FROM orders WHERE array_contains(array('1-URGENT', '5-LOW'), o_orderpriority)", "SELECT o_orderkey FROM orders WHERE o_orderpriority = ANY(['1-URGENT', '5-LOW'])")


@framed("p06_optional_parameter", "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderpriority = '5-LOW' GROUP BY 1")
def p06(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "SELECT o_orderstatus, count(*) AS n FROM orders WHERE (:status IS NULL OR o_orderstatus = :status) AND (:priority IS NULL OR o_orderpriority = :priority) GROUP BY 1"
    return spark_sql(spark, sf_dir, text, status=None, priority="5-LOW")


both("p07_like", "SELECT p_partkey FROM part WHERE p_name LIKE 'small%' AND p_brand LIKE '%1'")
both("p08_between", "SELECT count(*) AS n, sum(CASE WHEN p_retailprice BETWEEN 950 AND 1000 THEN 1 ELSE 0 END) AS mid FROM part WHERE p_size BETWEEN 5 AND 20")


@framed("p09_json_has_key", "SELECT card_id, brief IS NOT NULL AND list_contains(json_keys(brief), 'request') AS has_request FROM briefs")
def p09(spark: SparkSession, sf_dir: str) -> DataFrame:
    from listwright.functions.web import has_key

    return role("brief", spark, sf_dir).select("card_id", has_key(F.col("brief"), "request").alias("has_request"))


@framed("p10_json_path", "SELECT card_id, coalesce(json_extract_string(brief, '$.request.occasion'), json_extract_string(brief, '$.occasion')) AS occasion FROM briefs")
def p10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from listwright.functions.web import json_path

    return role("brief", spark, sf_dir).select("card_id", json_path(F.col("brief"), "$.request.occasion", "$.occasion").alias("occasion"))


@framed("p11_json_null", "SELECT card_id, coalesce(json_type(brief, '$.request') = 'NULL', false) AS request_is_null FROM briefs")
def p11(spark: SparkSession, sf_dir: str) -> DataFrame:
    request = F.try_variant_get(F.try_parse_json("brief"), "$.request", "variant")
    return role("brief", spark, sf_dir).select("card_id", F.coalesce(F.is_variant_null(request), F.lit(False)).alias("request_is_null"))


both("p12_casts", "SELECT o_orderkey, CAST(o_orderkey AS VARCHAR(20)) AS t, CAST(o_totalprice > 200000 AS INT) AS high, CAST(o_custkey AS DOUBLE) AS d, try_cast(o_orderpriority AS INT) AS bad FROM orders")
both("p13_group_or_subtype", "SELECT id, split_part(occasion, '/', 1) AS grp FROM titles WHERE occasion = 'birthday' OR split_part(occasion, '/', 1) = 'birthday'")
both("p14_not_exists", "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)")
both("p15_not_in", "SELECT count(*) AS n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
both("p16_case_in_aggregate", "SELECT l_returnflag, count(DISTINCT CASE WHEN l_quantity > 25 THEN l_orderkey END) AS big FROM lineitem GROUP BY 1")
both("p17_literals", "SELECT o_orderkey, 'A' AS condition, CAST(NULL AS VARCHAR(9)) AS cover FROM orders")


@framed("p18_masks", "SELECT card_key, coalesce(occasion, '?') AS occasion FROM ratings WHERE condition IN ('BUILDING', 'MACHINERY') AND purchase_intent IS NOT NULL")
def p18(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = role("ratings", spark, sf_dir).where(F.col("condition").isin("BUILDING", "MACHINERY")).na.drop(subset=["purchase_intent"])
    return r.na.fill("?", ["occasion"]).select("card_key", "occasion")


both("p19_contains", "SELECT p_partkey FROM part WHERE contains(p_name, 'ring') OR contains(lower(p_type), 'eco')")


@framed("p20_remap", "SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 3 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 1 ELSE 0 END AS idx FROM orders")
def p20(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = F.create_map(*[F.lit(x) for kv in {"1-URGENT": 3, "2-HIGH": 2, "3-MEDIUM": 1}.items() for x in kv])
    return table(spark, sf_dir, "orders").select("o_orderkey", F.coalesce(known[F.col("o_orderpriority")], F.lit(0)).alias("idx"))


@framed("p21_validation", """SELECT reason, count(*) AS n FROM (SELECT CASE WHEN o_orderstatus NOT IN ('F', 'O') THEN 'status' WHEN o_totalprice > 450000 THEN 'price' WHEN o_custkey > o_orderkey THEN 'order' END AS reason FROM orders) GROUP BY reason""")
def p21(spark: SparkSession, sf_dir: str) -> DataFrame:
    reason = F.when(~F.col("o_orderstatus").isin("F", "O"), "status").when(F.col("o_totalprice") > 450000, "price").when(F.col("o_custkey") > F.col("o_orderkey"), "order")
    return table(spark, sf_dir, "orders").groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


both("p22_complete_rows", "SELECT l.listing_id FROM listings l JOIN marks m ON l.listing_id = m.listing_id WHERE l.occasion IS NOT NULL AND l.seller_id IS NOT NULL AND m.quality IS NOT NULL AND m.toxic IS NOT NULL")


@framed("p23_pinned_else_chosen", "SELECT id, coalesce(CASE WHEN id % 4 = 0 THEN 'pinned' END, CASE WHEN p_type IN ('ECONOMY', 'PROMO') THEN p_type END, 'warm') AS tone FROM titles")
def p23(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = role("titles", spark, sf_dir)
    return t.select("id", F.coalesce(F.when(F.col("id") % 4 == 0, "pinned"), F.when(F.col("p_type").isin("ECONOMY", "PROMO"), F.col("p_type")), F.lit("warm")).alias("tone"))


both("p24_whitelist", "SELECT event_id, user_id AS session_id, event_type FROM events")


@framed("p25_keep_last_40", """SELECT card_key, condition FROM (SELECT *, row_number() OVER (PARTITION BY condition ORDER BY card_key DESC) AS rn FROM ratings) WHERE condition <> 'BUILDING' OR rn <= 40""")
def p25(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = role("ratings", spark, sf_dir).select("card_key", "condition")
    return r.where("condition <> 'BUILDING'").unionByName(R.last_of(r.where("condition = 'BUILDING'"), ["condition"], [F.desc("card_key")], 40))


# -- joins -------------------------------------------------------------------------------------------------------------

both("j01_inner", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
both("j02_inner_with_predicate", "SELECT l.listing_id, m.quality FROM listings l JOIN marks m ON l.listing_id = m.listing_id AND m.toxic = 0")
both("j03_left", "SELECT l.listing_id, m.score FROM listings l LEFT JOIN marks m ON l.listing_id = m.listing_id")
both("j04_left_predicate_in_on", "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'F' GROUP BY c_custkey")
both("j05_star", """SELECT n_name, c_mktsegment, count(*) AS n, sum(l_quantity) AS quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
    JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name, c_mktsegment""")  # fmt: skip


@framed("j06_pending", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def j06(spark: SparkSession, sf_dir: str) -> DataFrame:
    from listwright.operators.upserts import pending

    return pending(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), ["doc_id"])


both("j07_semi", "SELECT doc_id, source FROM documents d LEFT SEMI JOIN labels b ON d.doc_id = b.doc_id", "SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
both("j08_left_then_null", "SELECT l.listing_id FROM listings l LEFT JOIN marks m ON l.listing_id = m.listing_id WHERE m.score IS NULL")


@framed("j12_differences", """WITH g AS (SELECT condition, purchase_intent AS v, count(*) AS k FROM graded GROUP BY ALL)
    SELECT a.condition AS a, b.condition AS b, count(*) AS distinct_pairs, CAST(sum(a.k * b.k) AS BIGINT) AS pairs FROM g a JOIN g b ON a.condition < b.condition GROUP BY 1, 2""")  # fmt: skip
def j12(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = role("graded", spark, sf_dir).groupBy("condition", "purchase_intent").agg(F.count(F.lit(1)).alias("k"))  # distinct values only
    a, b = g.alias("a"), g.alias("b")
    pairs = a.join(b, F.col("a.condition") < F.col("b.condition"))
    return pairs.groupBy(F.col("a.condition").alias("a"), F.col("b.condition").alias("b")).agg(F.count(F.lit(1)).alias("distinct_pairs"), F.sum(F.col("a.k") * F.col("b.k")).alias("pairs"))


both("j13_aligned_concat", "SELECT a.o_custkey, a.n AS f, b.n AS o FROM (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) a JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) b ON a.o_custkey = b.o_custkey")
both("j14_shared_items", "SELECT count(*) AS shared FROM (SELECT DISTINCT l_partkey FROM lineitem WHERE l_returnflag = 'A') a JOIN (SELECT DISTINCT l_partkey FROM lineitem WHERE l_returnflag = 'R') b ON a.l_partkey = b.l_partkey")
both("j15_merge_suffixes", "SELECT a.doc_id, a.quality AS quality_x, b.quality AS quality_y FROM labels a LEFT JOIN (SELECT doc_id, quality FROM labels WHERE toxic = 0) b ON a.doc_id = b.doc_id")
both("j16_lookup", "SELECT s_suppkey, coalesce(n_name, '?') AS nation FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey")


@framed("j17_keyed_zip", "SELECT doc_id, len(text) AS predicted FROM documents")
def j17(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outputs zipped to rows by key, not by place: the model's column is joined back."""
    d = table(spark, sf_dir, "documents")
    outputs = d.select("doc_id", F.length("text").cast("long").alias("predicted"))
    return d.select("doc_id").join(outputs, "doc_id")


both("j18_scalar_subqueries", "SELECT (SELECT count(*) FROM orders) AS orders_n, (SELECT count(*) FROM customer) AS customers_n, (SELECT max(l_quantity) FROM lineitem) AS most")

# -- aggregates --------------------------------------------------------------------------------------------------------

both("a01_count", "SELECT source, count(*) AS n FROM documents GROUP BY source")
both("a02_count_distinct", f"SELECT count(DISTINCT {KEY}) AS designs, count(DISTINCT seller_id) AS sellers FROM listings")
both("a03_count_filter", "SELECT count(*) AS n, count(*) FILTER (WHERE l_returnflag = 'R') AS returned, count(*) FILTER (WHERE l_discount > 0.05) AS cheap FROM lineitem")
both("a04_mixed_distinct", f"SELECT occasion, count(*) AS n, count(DISTINCT {KEY}) AS designs, count(DISTINCT CASE WHEN cluster_id IS NOT NULL THEN cluster_id END) AS clusters, count(*) FILTER (WHERE cluster_id IS NULL) AS single FROM listings GROUP BY occasion")
both("a05_matched_count", "SELECT l.source, count(*) AS n, count(m.score) AS labelled FROM listings l LEFT JOIN marks m ON l.listing_id = m.listing_id GROUP BY l.source")
both("a06_having", "SELECT cluster_id, count(DISTINCT source) AS sources FROM listings WHERE cluster_id IS NOT NULL GROUP BY cluster_id HAVING count(DISTINCT source) > 1")
both("a07_sum_of_booleans", "SELECT source, occasion, sum(CAST(cluster_id IS NOT NULL AS INT)) AS clustered, avg(reviews) AS reviews FROM listings GROUP BY source, occasion")
both("a08_sample_value", "SELECT source, min(left(text, 58)) AS sample FROM listings GROUP BY source")
both("a09_rare_groups", "SELECT occasion, count(*) AS n FROM listings GROUP BY occasion ORDER BY n, occasion NULLS FIRST LIMIT 5")
both("a10_size_histogram", "SELECT size, count(*) AS clusters FROM (SELECT cluster_id, count(*) AS size FROM listings WHERE cluster_id IS NOT NULL GROUP BY cluster_id) s GROUP BY size")


@framed("a11_mean_and_error", "SELECT condition, count(purchase_intent) AS n, avg(purchase_intent) AS mean, coalesce(stddev_samp(purchase_intent), 0) AS sd, coalesce(stddev_samp(purchase_intent), 0) / sqrt(count(purchase_intent)) AS sem, min(purchase_intent) AS low, max(purchase_intent) AS high FROM ratings GROUP BY condition".replace("avg(purchase_intent)", "round(avg(purchase_intent), 6)").replace("coalesce(stddev_samp(purchase_intent), 0) AS sd", "round(coalesce(stddev_samp(purchase_intent), 0), 6) AS sd").replace("coalesce(stddev_samp(purchase_intent), 0) / sqrt(count(purchase_intent))", "round(coalesce(stddev_samp(purchase_intent), 0) / sqrt(count(purchase_intent)), 6)"))
def a11(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = group_summary(role("ratings", spark, sf_dir), ["condition"], "purchase_intent")
    return s.select("condition", "n", *[F.round(c, 6).alias(c) for c in ("mean", "sd", "sem")], "low", "high")


@framed("a12_pivot", "SELECT occasion, " + ", ".join(f"round(avg(purchase_intent) FILTER (WHERE condition = '{c}'), 6) AS {c.lower()}" for c in ("AUTOMOBILE", "BUILDING", "FURNITURE", "MACHINERY")) + " FROM ratings GROUP BY occasion")
def a12(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["AUTOMOBILE", "BUILDING", "FURNITURE", "MACHINERY"]
    p = role("ratings", spark, sf_dir).groupBy("occasion").pivot("condition", names).agg(F.round(F.avg("purchase_intent"), 6))
    return p.select("occasion", *[F.col(n).alias(n.lower()) for n in names])


@framed("a13_dims_long", "SELECT condition, dim, round(avg(v), 6) AS mean FROM (UNPIVOT (SELECT condition, purchase_intent, aesthetic, fit FROM graded) ON purchase_intent, aesthetic, fit INTO NAME dim VALUE v) GROUP BY condition, dim")
def a13(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = role("graded", spark, sf_dir).unpivot(["condition"], ["purchase_intent", "aesthetic", "fit"], "dim", "v")
    return long.groupBy("condition", "dim").agg(F.round(F.avg("v"), 6).alias("mean"))


both("a15_value_counts", "SELECT coalesce(occasion, '(none)') AS occasion, count(*) AS n FROM listings GROUP BY 1")
both("a16_population_sd", "SELECT conv_id, round(stddev_pop(length(text)), 6) AS sd, round(avg(length(text)), 6) AS mean FROM conversations GROUP BY conv_id")


@framed("a17_repetition", "WITH n AS (SELECT trim(regexp_replace(translate(lower(text), '!\"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~', ''), '\\s+', ' ', 'g')) AS norm, text AS raw FROM documents), g AS (SELECT norm, count(*) AS k FROM n GROUP BY norm) SELECT CAST(sum(k) AS BIGINT) AS n, (SELECT count(DISTINCT raw) FROM n) AS exact, count(*) AS normalised, CAST(sum(k) - count(*) AS BIGINT) AS redundant, max(k) AS largest FROM g")
def a17(spark: SparkSession, sf_dir: str) -> DataFrame:
    from listwright.functions.titles import normalised

    n = table(spark, sf_dir, "documents").select(F.col("text").alias("raw")).withColumn("norm", normalised(F.col("raw")))
    per = n.groupBy("norm").agg(F.count(F.lit(1)).alias("k"))
    exact = n.agg(F.count_distinct("raw").alias("exact"))
    return per.agg(F.sum("k").alias("n"), F.count(F.lit(1)).alias("normalised"), (F.sum("k") - F.count(F.lit(1))).alias("redundant"), F.max("k").alias("largest")).crossJoin(exact).select("n", "exact", "normalised", "redundant", "largest")


both("a18_reconciliation", f"SELECT u.n AS unclustered, c.n AS clusters, d.n AS designs, u.n + c.n = d.n AS holds FROM (SELECT count(*) AS n FROM listings WHERE cluster_id IS NULL) u CROSS JOIN (SELECT count(DISTINCT cluster_id) AS n FROM listings) c CROSS JOIN (SELECT count(DISTINCT {KEY}) AS n FROM listings) d")


@framed("a19_order_string", "SELECT occasion, string_agg(condition, ' < ' ORDER BY m, condition) AS ordering FROM (SELECT occasion, condition, round(avg(purchase_intent), 9) AS m FROM ratings GROUP BY 1, 2) GROUP BY occasion")
def a19(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = role("ratings", spark, sf_dir).groupBy("occasion", "condition").agg(F.round(F.avg("purchase_intent"), 9).alias("m"))
    return m.groupBy("occasion").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("m", "condition"))), lambda x: x["condition"]), " < ").alias("ordering"))


both("a20_spread", "SELECT round(avg(sd), 6) AS mean_sd, round(avg(hi - lo), 6) AS mean_range, round(avg(sd) / (SELECT stddev_pop(l_discount) FROM lineitem), 6) AS ratio FROM (SELECT l_orderkey, stddev_pop(l_discount) AS sd, max(l_discount) AS hi, min(l_discount) AS lo FROM lineitem GROUP BY l_orderkey) b")


@framed("a21_weighted_error", "SELECT round(sum(w * pow(p - coalesce(t, 0), 2)) / greatest(sum(w), 1e-12), 9) AS mse FROM (SELECT l_discount AS p, CASE WHEN l_linenumber <> 3 THEN l_tax END AS t, CASE WHEN l_linenumber <> 3 THEN l_quantity ELSE 0 END AS w FROM lineitem)")
def a21(spark: SparkSession, sf_dir: str) -> DataFrame:
    from listwright.operators.scoring import weighted_error

    rows = table(spark, sf_dir, "lineitem").select(F.col("l_discount").alias("p"), F.when(F.col("l_linenumber") != 3, F.col("l_tax")).alias("t"), F.col("l_quantity").alias("w"))
    return rows.agg(F.round(weighted_error("p", "t", "w"), 9).alias("mse"))


both("a22_seed_spread", "SELECT l_linenumber AS metric, round(avg(l_tax), 6) AS mean, round(coalesce(stddev_samp(l_tax), 0), 6) AS sd FROM lineitem WHERE NOT isnan(l_tax) GROUP BY l_linenumber")
both("a23_usage", "SELECT sum(n) AS total, min(n) AS least, round(avg(n), 6) AS mean, max(n) AS most, round(avg(CAST(n > 6 AS INT)), 6) AS over_cap FROM (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id) c")


@framed("a24_median_card", "WITH m AS (SELECT *, median(purchase_intent) OVER (PARTITION BY condition, occasion) AS med FROM ratings) SELECT condition, occasion, min_by(card_key, (abs(purchase_intent - med), card_key)) AS card_key FROM m GROUP BY 1, 2")
def a24(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = role("ratings", spark, sf_dir)
    med = r.groupBy("condition", "occasion").agg(F.median("purchase_intent").alias("med"))
    return r.join(med, ["condition", "occasion"]).groupBy("condition", "occasion").agg(F.min_by("card_key", F.struct(F.abs(F.col("purchase_intent") - F.col("med")), F.col("card_key"))).alias("card_key"))


both("a25_first_below", "SELECT l_suppkey, min(CASE WHEN l_discount < 0.01 THEN l_orderkey END) AS first_below, max(l_discount) AS most FROM lineitem GROUP BY l_suppkey")

# -- windows, sorts, limits --------------------------------------------------------------------------------------------


@framed("w01_top_per_group", "SELECT occasion, card_key, rn FROM (SELECT *, row_number() OVER (PARTITION BY occasion ORDER BY purchase_intent DESC, card_key) AS rn FROM ratings) WHERE rn <= 20")
def w01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.top_per(role("ratings", spark, sf_dir), ["occasion"], [F.desc("purchase_intent"), F.col("card_key")], 20).select("occasion", "card_key", "rn")


@framed("w02_first_per_group", "SELECT source, listing_id FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY listing_id) AS rn FROM listings) WHERE rn <= 3")
def w02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.top_per(listings(spark, sf_dir), ["source"], [F.col("listing_id")], 3).select("source", "listing_id")


@framed("w03_largest_clusters", """WITH s AS (SELECT cluster_id, count(*) AS size FROM listings WHERE cluster_id IS NOT NULL GROUP BY 1 ORDER BY size DESC, cluster_id LIMIT 10),
    r AS (SELECT *, row_number() OVER (ORDER BY size DESC, cluster_id) AS cluster_rank FROM s), m AS (SELECT l.cluster_id, l.listing_id, r.size, r.cluster_rank, row_number() OVER (PARTITION BY l.cluster_id ORDER BY l.listing_id) AS member_rank FROM listings l JOIN r ON l.cluster_id = r.cluster_id)
    SELECT cluster_id, listing_id, size, cluster_rank, member_rank FROM m WHERE member_rank <= 4""")  # fmt: skip
def w03(spark: SparkSession, sf_dir: str) -> DataFrame:
    clustered = listings(spark, sf_dir).where("cluster_id is not null").select("cluster_id", "listing_id")
    return R.largest_groups(clustered, "cluster_id", "listing_id", 10, 4).select("cluster_id", "listing_id", "size", "cluster_rank", "member_rank")


@framed("w04_representatives", f"SELECT listing_id, design FROM (SELECT listing_id, {KEY} AS design, row_number() OVER (PARTITION BY {KEY} ORDER BY listing_id) AS rn FROM listings) WHERE rn = 1")
def w04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return representatives(listings(spark, sf_dir).select("listing_id", "cluster_id")).select("listing_id", design_key().alias("design"))


@framed("w04_best_scored", f"SELECT listing_id, score FROM (SELECT l.listing_id, m.score, row_number() OVER (PARTITION BY {KEY.replace('cluster_id', 'l.cluster_id').replace('listing_id', 'l.listing_id')} ORDER BY m.score DESC NULLS LAST, l.listing_id) AS rn FROM listings l LEFT JOIN marks m ON l.listing_id = m.listing_id) WHERE rn = 1")
def w04b(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = listings(spark, sf_dir).select("listing_id", "cluster_id").join(role("marks", spark, sf_dir), "listing_id", "left")
    return representatives(scored, by_score=True).select("listing_id", "score")


@framed("w05_stratified", f"""WITH d AS (SELECT *, row_number() OVER (PARTITION BY {KEY} ORDER BY listing_id) AS k FROM listings WHERE occasion IS NOT NULL), o AS (SELECT * FROM d WHERE k = 1),
    r AS (SELECT listing_id, occasion, row_number() OVER (PARTITION BY occasion ORDER BY listing_id) AS rn FROM o) SELECT listing_id, occasion, rn FROM r WHERE rn <= greatest(1, 40 // (SELECT count(DISTINCT occasion) FROM o))""")  # fmt: skip
def w05(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = listings(spark, sf_dir).where("occasion is not null").select("listing_id", "cluster_id", "occasion")
    return R.stratified_top(rows, design_key(), "occasion", [F.col("listing_id")], 40).select("listing_id", "occasion", "rn")


@framed("w06_best_designs", f"SELECT listing_id, reviews FROM (SELECT *, row_number() OVER (PARTITION BY {KEY} ORDER BY reviews DESC, listing_id) AS rn FROM listings) WHERE rn = 1 ORDER BY reviews DESC, listing_id LIMIT 25")
def w06(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = listings(spark, sf_dir).select("listing_id", "cluster_id", "reviews")
    return R.best_per(rows, [design_key()], [F.desc("reviews"), F.col("listing_id")]).orderBy(F.desc("reviews"), "listing_id").limit(25).select("listing_id", "reviews")


@framed("w07_average_rank", "SELECT id, rank() OVER (PARTITION BY condition ORDER BY purchase_intent) + (count(*) OVER (PARTITION BY condition, purchase_intent) - 1) / 2.0 AS r FROM graded")
def w07(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.average_ranks(role("graded", spark, sf_dir), "purchase_intent", ["condition"], "r").select("id", F.col("r").cast("double").alias("r"))


@framed("w08_canonical", "SELECT cluster_id, max_by(listing_id, (reviews, -listing_id)) AS canonical FROM listings WHERE cluster_id IS NOT NULL GROUP BY cluster_id")
def w08(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = listings(spark, sf_dir).where("cluster_id is not null")
    return rows.groupBy("cluster_id").agg(F.max_by("listing_id", F.struct(F.col("reviews"), -F.col("listing_id"))).alias("canonical"))


@framed("w10_gaps", "WITH e AS (SELECT l_orderkey, min(l_linenumber) AS lo, max(l_linenumber) AS hi FROM lineitem GROUP BY 1), s AS (SELECT l_orderkey, CAST(unnest(range(lo, hi + 1)) AS INT) AS l_linenumber FROM e) SELECT * FROM s ANTI JOIN lineitem USING (l_orderkey, l_linenumber)")
def w10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.gaps(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber")


@framed("w11_rerank", "SELECT l_orderkey, l_linenumber, l_partkey, r FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_discount DESC, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS r FROM lineitem) WHERE r <= 3")
def w11(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = [F.desc("l_discount"), *map(F.col, ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))]
    return R.top_per(table(spark, sf_dir, "lineitem"), ["l_orderkey"], order, 3, "r").select("l_orderkey", "l_linenumber", "l_partkey", "r")


@framed("w12_rotation", "SELECT o_orderkey, (o_orderkey - 1 + 3) % 7 + 1 AS turn FROM orders")
def w12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", R.rotated(F.col("o_orderkey"), F.lit(3), F.lit(7)).alias("turn"))


@framed("w13_minmax", "SELECT id, round(CASE WHEN hi > lo THEN 18 + 82 * (fit - lo) / (hi - lo) ELSE 100 END, 6) AS s FROM (SELECT id, fit, min(fit) OVER (PARTITION BY id // 10) AS lo, max(fit) OVER (PARTITION BY id // 10) AS hi FROM graded)")
def w13(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = role("graded", spark, sf_dir).withColumn("slate", F.expr("id div 10"))
    return g.select("id", F.round(R.scaled("fit", ["slate"]), 6).alias("s"))


@framed("w14_shown_position", "SELECT conv_id, CASE WHEN list_position(t, 3) > 0 THEN list_position(t, 3) - 1 END AS pos FROM (SELECT conv_id, list(turn ORDER BY turn DESC) AS t FROM conversations GROUP BY conv_id)")
def w14(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list("turn"), asc=False).alias("t"))
    return shown.select("conv_id", R.position_of(F.col("t"), F.lit(3).cast("long")).cast("int").alias("pos"))


both("t01_work_list", "SELECT listing_id, reviews FROM listings WHERE occasion IS NULL ORDER BY reviews DESC, listing_id LIMIT 30")
both("t02_ordered", "SELECT listing_id FROM listings WHERE seller_id IS NULL ORDER BY listing_id")
both("t03_largest_gaps", "SELECT o_orderkey, abs(o_totalprice - 250000) AS gap FROM orders ORDER BY gap DESC, o_orderkey LIMIT 15")
both("t04_recent", "SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50")


@framed("t06_sample_per_group", "SELECT source, listing_id FROM (SELECT source, listing_id, row_number() OVER (PARTITION BY source ORDER BY md5(concat_ws('|', '42', listing_id)), listing_id) AS rn FROM listings) WHERE rn <= 5")
def t06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.sample_per(listings(spark, sf_dir).select("source", "listing_id"), ["source"], "listing_id", 5).select("source", "listing_id")


@framed("t07_shuffled_slate", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY md5(concat_ws('|', '7', o_orderkey)), o_orderkey) AS pos FROM orders")
def t07(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy(R.md5_order("7", F.col("o_orderkey")), "o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.row_number().over(w).alias("pos"))


@framed("t08_sampled_pairs", "SELECT conv_id, a, b FROM (SELECT x.conv_id, x.turn AS a, y.turn AS b, row_number() OVER (PARTITION BY x.conv_id ORDER BY md5(concat_ws('|', '8', x.turn, y.turn)), x.turn, y.turn) AS rn FROM conversations x JOIN conversations y ON x.conv_id = y.conv_id AND x.turn < y.turn) WHERE rn <= 3")
def t08(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    pairs = c.select("conv_id", F.col("turn").alias("a")).join(c.select("conv_id", F.col("turn").alias("b")), "conv_id").where("a < b")
    return R.top_per(pairs, ["conv_id"], [R.md5_order("8", F.col("a"), F.col("b")), F.col("a"), F.col("b")], 3).select("conv_id", "a", "b")


# -- sets --------------------------------------------------------------------------------------------------------------

both("u01_union_all_counts", "SELECT 'orders' AS t, count(*) AS n FROM orders UNION ALL SELECT 'customer', count(*) FROM customer UNION ALL SELECT 'part', count(*) FROM part")


@framed("u02_concat_by_name", "SELECT s_suppkey AS id, s_name AS name, s_acctbal AS balance, NULL::VARCHAR AS segment FROM supplier UNION ALL SELECT c_custkey, c_name, NULL, c_mktsegment FROM customer")
def u02(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    return s.unionByName(c, allowMissingColumns=True)


@framed("u03_word_sets", "SELECT p_partkey, list_sort(list_intersect(a, b)) AS common, len(list_distinct(list_concat(a, b))) AS either FROM (SELECT p_partkey, string_split(p_name, ' ') AS a, ['small', 'ring', 'red'] AS b FROM part)")
def u03(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.split("p_name", " "), F.array(F.lit("small"), F.lit("ring"), F.lit("red"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_sort(F.array_intersect(a, b)).alias("common"), F.size(F.array_union(a, b)).cast("long").alias("either"))


@framed("u04_missing_members", "SELECT o_custkey, list_sort([x FOR x IN ['F', 'O', 'P'] IF NOT list_contains(s, x)]) AS missing FROM (SELECT o_custkey, list(DISTINCT o_orderstatus) AS s FROM orders GROUP BY 1)")
def u04(spark: SparkSession, sf_dir: str) -> DataFrame:
    want = F.array(F.lit("F"), F.lit("O"), F.lit("P"))
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.array_except(want, F.collect_set("o_orderstatus"))).alias("missing"))


@framed("u05_ordered_distinct", "WITH w AS (SELECT p_partkey, string_split(concat(p_name, ' ', p_name), ' ') AS a FROM part) SELECT p_partkey, array_to_string([x FOR x, i IN a IF list_position(a, x) = i], ' ') AS words FROM w")
def u05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.array_distinct(F.split(F.concat_ws(" ", "p_name", "p_name"), " ")), " ").alias("words"))
