"""Queries of SURVEY 2.9, M: splits, models and rank statistics."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listwright.operators import scoring as S
from listwright.operators import statistics as T
from listwright.plans.roles import MAKERS, both, framed, listings
from listwright.sources import table


def graded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return MAKERS["graded"](spark, sf_dir)


SPLIT = """SELECT listing_id, CASE WHEN t < floor(n * 0.7::DOUBLE) THEN 'train' WHEN t < floor(n * 0.7::DOUBLE) + floor(n * 0.15::DOUBLE) THEN 'val' ELSE 'test' END AS side FROM (SELECT listing_id, coalesce(seller_id, concat('__null_', listing_id)) AS g FROM listings)
    JOIN (SELECT g, row_number() OVER (ORDER BY md5(concat_ws('|', '42', g)), g) - 1 AS t, count(*) OVER () AS n FROM (SELECT DISTINCT coalesce(seller_id, concat('__null_', listing_id)) AS g FROM listings)) USING (g)"""


@framed("m01_group_split", SPLIT)
def m01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.group_split(listings(spark, sf_dir).select("listing_id", "seller_id"), "seller_id", "listing_id").select("listing_id", "side")


@framed("m02_targets", "SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE greatest(0, least(1, CAST(json_extract_string(props, '$.k') AS DOUBLE) / 50)) END AS aesthetic FROM events")
def m02(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("double") / 50
    raw = F.when(F.col("event_id") % 7 == 0, F.lit('{"x": 1}')).otherwise(F.to_json(F.struct(k.alias("aesthetic"))))
    return table(spark, sf_dir, "events").select("event_id", S.targets(raw)["aesthetic"].alias("aesthetic"))


@framed("m03_inverse_frequency", "SELECT o_orderkey, 1.0::DOUBLE / count(*) OVER (PARTITION BY o_orderpriority) AS w FROM orders")
def m03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", S.inverse_frequency("o_orderpriority").alias("w"))


def learnable(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("embedding")
    y = 0.5 + 0.3 * e[0] - 0.2 * e[1] + 0.1 * e[2]
    return table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("x"), y.cast("double").alias("y"))


ALPHAS = f"SELECT unnest({list(S.ALPHAS)}::DOUBLE[]) AS alpha"


@framed("m04_m05_ridge", f"""WITH r AS (SELECT vec_id, embedding[1]::DOUBLE AS u, embedding[2]::DOUBLE AS v, 0.5::DOUBLE + 0.3::DOUBLE * embedding[1] - 0.2::DOUBLE * embedding[2] + 0.1::DOUBLE * embedding[3] AS y FROM embeddings), m AS (SELECT count(*)::DOUBLE AS n, avg(u) AS mu, avg(v) AS mv, avg(y) AS my FROM r),
    z AS (SELECT vec_id, n, my, u - mu AS u, v - mv AS v, y - my AS y FROM r, m), g AS (SELECT sum(u * u) AS a, sum(u * v) AS b, sum(v * v) AS c, sum(u * y) AS p, sum(v * y) AS q FROM z),
    w AS (SELECT alpha, a + alpha AS a, b, c + alpha AS c, (a + alpha) * (c + alpha) - b * b AS det, ((c + alpha) * p - b * q) / ((a + alpha) * (c + alpha) - b * b) AS wu, ((a + alpha) * q - b * p) / ((a + alpha) * (c + alpha) - b * b) AS wv FROM g, ({ALPHAS})),
    e AS (SELECT alpha, wu, wv, sum(((y - wu * u - wv * v) / (1 - 1 / n - (c * u * u - 2 * b * u * v + a * v * v) / det)) ^ 2) AS loo FROM w, z GROUP BY ALL), best AS (SELECT * FROM e ORDER BY loo, alpha LIMIT 1)
    SELECT vec_id, best.alpha, round(greatest(0, least(1, my + wu * u + wv * v)), 6) AS s FROM z, best""")  # fmt: skip
def m04(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two features of a target that depends on three: the penalty is chosen by leave-one-out error, as SQL can say for two."""
    rows = learnable(spark, sf_dir).withColumn("x", F.slice("x", 1, 2))
    w, b, alpha = S.ridge(rows, "x", "y")
    return rows.select("vec_id", F.lit(alpha).alias("alpha"), F.round(S.ridge_score(F.col("x"), list(w), b), 6).alias("s"))


def noisy(spark: SparkSession, sf_dir: str) -> DataFrame:
    noise = F.pmod(F.col("vec_id") * 7919, F.lit(101)) / 50 - 1
    return learnable(spark, sf_dir).withColumn("y", F.col("y") + 0.2 * noise)


@framed("m04_ridge_of_noisy_scores")
def m04b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The penalty that leave-one-out errors choose of all; tests hold it against a refit without each row."""
    w, b, alpha = S.ridge(noisy(spark, sf_dir), "x", "y")
    return spark.createDataFrame([(float(alpha), float(b), [float(x) for x in w])], "alpha double, intercept double, weights array<double>")


@framed("m06_network_scores", "SELECT vec_id, round(1 / (1 + exp(-(greatest(embedding[1]::DOUBLE + 0.1, 0) - 0.5::DOUBLE * greatest(embedding[2]::DOUBLE, 0)))), 6) AS purchase_intent FROM embeddings")
def m06(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = np.zeros((64, 2))
    w[0, 0] = w[1, 1] = 1.0
    rows = S.network_scores(learnable(spark, sf_dir), "x", [(w, np.array([0.1, 0.0]))], {"purchase_intent": (np.array([[1.0], [-0.5]]), np.zeros(1))})
    return rows.select("vec_id", F.round("scores.purchase_intent", 6).alias("purchase_intent"))


@framed("m08_feature_stats", "SELECT CAST(i - 1 AS INT) AS i, round(avg(x), 6) AS mean, round(greatest(stddev_pop(x), 1e-6), 6) AS sd FROM (SELECT generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY i")
def m08(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.feature_stats(learnable(spark, sf_dir), "x").select("i", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"))


@framed("m09_isotonic", """WITH g AS (SELECT aesthetic AS x, sum(fit) AS s, count(*) AS n, row_number() OVER (ORDER BY aesthetic) AS i FROM graded GROUP BY 1), c AS (SELECT i, x, s, n, sum(s) OVER (ORDER BY i) AS ss, sum(n) OVER (ORDER BY i) AS nn FROM g),
    m AS (SELECT a.i AS lo, b.i AS hi, (b.ss - a.ss + a.s) / (b.nn - a.nn + a.n) AS m FROM c a JOIN c b ON a.i <= b.i), w AS (SELECT c.i, m.lo, min(m.m) AS m FROM c JOIN m ON m.lo <= c.i AND m.hi >= c.i GROUP BY 1, 2), f AS (SELECT i, max(m) AS fit FROM w GROUP BY 1)
    SELECT id, round(greatest(0, least(1, f.fit)), 6) AS calibrated FROM graded JOIN g ON aesthetic = x JOIN f USING (i)""")  # fmt: skip
def m09(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.isotonic(graded(spark, sf_dir).select("id", "aesthetic", "fit"), "aesthetic", "fit").select("id", F.round("calibrated", 6).alias("calibrated"))


@framed("m10_calibration", """WITH b AS (SELECT least(9, floor(fit * 10 + 1e-9))::INT AS bin, fit, purchase_intent * 10 AS t FROM graded), n AS (SELECT count(*) AS n FROM b)
    SELECT bin, count(*) AS k, round(avg(fit), 6) AS predicted, round(avg(t), 6) AS observed, round(count(*) / any_value(n) * abs(avg(fit) - avg(t)), 6) AS error FROM b, n GROUP BY bin""")  # fmt: skip
def m10(spark: SparkSession, sf_dir: str) -> DataFrame:
    bins = T.calibration_bins(graded(spark, sf_dir).withColumn("t", F.col("purchase_intent") * 10), "fit", "t")
    return bins.select("bin", "k", *[F.round(c, 6).alias(c) for c in ("predicted", "observed", "error")])


RHO = "round(corr(rx, ry), 6)"
RANKS = "SELECT {by}, rank() OVER (PARTITION BY {by} ORDER BY {x}) + (count(*) OVER (PARTITION BY {by}, {x}) - 1) / 2 AS rx, rank() OVER (PARTITION BY {by} ORDER BY {y}) + (count(*) OVER (PARTITION BY {by}, {y}) - 1) / 2 AS ry FROM graded"


@framed("m11_spearman", f"SELECT condition, count(*) AS n, {RHO} AS rho FROM ({RANKS.format(by='condition', x='fit', y='aesthetic')}) GROUP BY condition")
def m11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.spearman(graded(spark, sf_dir), "fit", "aesthetic", ["condition"]).withColumn("rho", F.round("rho", 6))


@framed("m12_spearman_matrix", " UNION ALL ".join(f"SELECT '{a}' AS dim_a, '{b}' AS dim_b, count(*) AS n, {RHO} AS rho FROM ({RANKS.format(by='1', x=a, y=b).replace('SELECT 1, ', 'SELECT ')})" for a, b in (("purchase_intent", "aesthetic"), ("purchase_intent", "fit"), ("aesthetic", "fit"))))
def m12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.spearman_matrix(graded(spark, sf_dir), ["purchase_intent", "aesthetic", "fit"]).withColumn("rho", F.round("rho", 6))


@framed("m13_top_quartile_auc", """WITH m AS (SELECT fit, purchase_intent >= (SELECT quantile_cont(purchase_intent, 0.75) FROM graded) AS top FROM graded), r AS (SELECT top, rank() OVER (ORDER BY fit) + (count(*) OVER (PARTITION BY fit) - 1) / 2 AS r FROM m),
    s AS (SELECT sum(r) FILTER (top) AS s, count(*) FILTER (top) AS n1, count(*) FILTER (NOT top) AS n0 FROM r) SELECT n1, n0, round((s - n1 * (n1 + 1) / 2) / (n1 * n0), 6) AS auc FROM s""")  # fmt: skip
def m13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.top_quartile_auc(graded(spark, sf_dir), "fit", "purchase_intent").withColumn("auc", F.round("auc", 6))


BEST = """WITH r AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS i, CAST(quality AS DOUBLE) AS p, CAST(toxic AS DOUBLE) + (doc_id % 10) / 10 AS t FROM labels), n AS (SELECT count(*) AS n FROM r), d AS (SELECT trial, draw, ('0x' || substr(md5(concat_ws('|', '0', trial, draw)), 1, 12))::BIGINT % n AS i FROM range(20000) a(trial), range(8) b(draw), n),
    o AS (SELECT trial, max_by(t, (p, -draw)) AS picked, max(t) AS oracle, min_by(t, draw) AS random FROM d JOIN r USING (i) GROUP BY trial) SELECT round(avg(picked), 6) AS picked, round(avg(random), 6) AS random, round(avg(oracle), 6) AS oracle, round(avg((picked = oracle)::INT), 6) AS top1_accuracy, round((avg(picked) - avg(random)) / (avg(oracle) - avg(random)), 4) AS recovered FROM o"""  # fmt: skip


@framed("m14_best_of_n", BEST)
def m14(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("double").alias("p"), (F.col("toxic") + F.col("doc_id") % 10 / 10).alias("t"))
    out = T.best_of_n(rows, "doc_id", "p", "t")
    return out.select(*[F.round(c, 6).alias(c) for c in ("picked", "random", "oracle", "top1_accuracy")], F.round("recovered", 4).alias("recovered"))


@framed("m15_one_hot_baseline", f"""WITH y AS (SELECT o_orderkey, o_orderpriority AS g, o_totalprice / 500000 AS y FROM orders), k AS (SELECT g, count(*)::DOUBLE AS n, avg(y) AS m, sum(y * y) AS yy FROM y GROUP BY g),
    c AS (SELECT alpha, g, n, m, yy, n / (n + alpha) AS s, n * alpha / (n + alpha) AS c FROM k, ({ALPHAS})), b AS (SELECT alpha, sum(c * m) / sum(c) AS b, sum(c) AS cc FROM c GROUP BY alpha), f AS (SELECT c.*, b + s * (m - b) AS fit, b, (1 - s) * c / (n * cc) + s / n AS h FROM c JOIN b USING (alpha)),
    e AS (SELECT alpha, sum((yy - 2 * fit * n * m + n * fit * fit) / (1 - h) ^ 2) AS loo FROM f GROUP BY alpha), best AS (SELECT alpha FROM e ORDER BY loo, alpha LIMIT 1)
    SELECT o_orderkey, round(fit, 6) AS s FROM y JOIN f USING (g) JOIN best USING (alpha)""")  # fmt: skip
def m15(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.array(*[(F.col("o_orderpriority") == k).cast("double") for k in kinds]).alias("x"), (F.col("o_totalprice") / 500000).alias("y"))
    w, b, _ = S.ridge(rows, "x", "y")
    return rows.select("o_orderkey", F.round(S.ridge_score(F.col("x"), list(w), b), 6).alias("s"))


# Rank tests: U and its spread in DuckDB from ranks of the two samples together.
def _u(shift: str = "0", where: str = "true", by: str = "") -> str:
    k, join = (f"{by}, ", f"a.{by} = b.{by} AND ") if by else ("", "")
    names = f"SELECT DISTINCT {k}condition FROM graded WHERE {where}"
    return f"""pr AS (SELECT {f'a.{by}, ' if by else ''}a.condition AS a, b.condition AS b FROM ({names}) a JOIN ({names}) b ON {join}a.condition < b.condition),
    s AS (SELECT {f'pr.{by}, ' if by else ''}a, b, condition = a AS in_a, CASE WHEN condition = a THEN purchase_intent ELSE purchase_intent + {shift} END AS v FROM pr JOIN graded ON {f'graded.{by} = pr.{by} AND ' if by else ''}(condition = a OR condition = b)),
    r AS (SELECT *, rank() OVER (PARTITION BY {k}a, b ORDER BY v) + (count(*) OVER (PARTITION BY {k}a, b, v) - 1) / 2 AS r, count(*) OVER (PARTITION BY {k}a, b, v) AS t FROM s),
    u AS (SELECT {k}a, b, count(*) FILTER (in_a) AS n1, count(*) FILTER (NOT in_a) AS n2, sum(r) FILTER (in_a) - count(*) FILTER (in_a) * (count(*) FILTER (in_a) + 1) / 2 AS u, sum(t::DOUBLE * t - 1) AS ties FROM r GROUP BY ALL),
    z AS (SELECT *, u - n1 * n2 / 2 AS off, sqrt(n1 * n2 / 12 * ((n1 + n2 + 1) - ties / ((n1 + n2) * (n1 + n2 - 1::DOUBLE)))) AS sd FROM u)"""


def _tail(z: str) -> str:
    """The normal tail in SQL, by the same approximation."""
    a = f"abs({z})"

    def horner(cs: tuple[float, ...]) -> str:
        out = f"{cs[0]!r}::DOUBLE"
        for c in cs[1:]:
            out = f"({out} * {a} + {c!r}::DOUBLE)"
        return out

    near = f"exp(-{a} * {a} / 2) * {horner(T.HART_TOP)} / {horner(T.HART_BOTTOM)}"
    far = f"exp(-{a} * {a} / 2) / ({a} + 1 / ({a} + 2 / ({a} + 3 / ({a} + 4 / ({a} + 0.65::DOUBLE))))) / {T.ROOT_TWO_PI}::DOUBLE"
    tail = f"CASE WHEN {a} > 37 THEN 0 WHEN {a} < 7.07106781186547 THEN {near} ELSE {far} END"
    return f"CASE WHEN {z} >= 0 THEN {tail} ELSE 1 - ({tail}) END"


@framed("m16_mann_whitney", f"WITH {_u()} SELECT a, b, n1, n2, round(u, 6) AS u, round(1 - 2 * u / (n1 * n2), 6) AS rank_biserial, round(least(1, 2 * ({_tail('((abs(off) - 0.5) / sd)')})), 6) AS p_two FROM z")
def m16(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = T.pairwise(graded(spark, sf_dir), "condition", "purchase_intent")
    return out.select("a", "b", "n1", "n2", F.round("u", 6).alias("u"), F.round("rank_biserial", 6).alias("rank_biserial"), F.round("p_two", 6).alias("p_two"))


@framed("m18_holm", f"WITH {_u()}, p AS (SELECT a, b, least(1, 2 * ({_tail('((abs(off) - 0.5) / sd)')})) AS p FROM z), h AS (SELECT *, least(1, (count(*) OVER () - row_number() OVER (ORDER BY p, a, b) + 1) * p) AS s FROM p) SELECT a, b, round(max(s) OVER (ORDER BY p, a, b ROWS UNBOUNDED PRECEDING), 6) AS p_holm FROM h")
def m18(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.holm(T.pairwise(graded(spark, sf_dir), "condition", "purchase_intent"), "p_two").select("a", "b", F.round("p_holm", 6).alias("p_holm"))


@framed("m19_pairwise_by_group", """WITH g AS (SELECT o_orderpriority AS occasion, o_orderstatus AS c, o_totalprice AS v FROM orders), s AS (SELECT x.occasion, x.c AS a, y.c AS b, sum((x.v > y.v)::INT + (x.v = y.v)::INT / 2) AS u FROM g x JOIN g y ON x.occasion = y.occasion AND x.c < y.c GROUP BY ALL) SELECT occasion, a, b, round(u, 6) AS u FROM s""")
def m19(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("occasion"), "o_orderstatus", "o_totalprice")
    return T.pairwise(rows, "o_orderstatus", "o_totalprice", ["occasion"], 2).select("occasion", "a", "b", F.round("u", 6).alias("u"))


def _tost(delta: str) -> str:
    up, low = _u(delta).replace("pr AS", "pr1 AS").replace("FROM pr JOIN", "FROM pr1 JOIN").replace("pr.", "pr1."), _u(f"-({delta})")
    for n in ("s", "r", "u", "z"):
        up = up.replace(f"\n    {n} AS (", f"\n    {n}1 AS (").replace(f"FROM {n})", f"FROM {n}1)").replace(f"FROM {n} GROUP", f"FROM {n}1 GROUP")
    return f"{up}, {low}, t AS (SELECT z.a, z.b, greatest(least(1, {_tail('((-z1.off - 0.5) / z1.sd)')}), least(1, {_tail('((z.off - 0.5) / z.sd)')})) AS p FROM z1 JOIN z USING (a, b))"


@framed("m20_equivalence", f"WITH {_tost('0.02::DOUBLE')} SELECT a, b, 0.02::DOUBLE AS delta, round(p, 6) AS p_tost, p < 0.05 AS equivalent FROM t")
def m20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.equivalence(graded(spark, sf_dir), "condition", "purchase_intent", 0.02).withColumn("p_tost", F.round("p_tost", 6))


@framed("m21_hodges_lehmann", """WITH g AS (SELECT condition, purchase_intent AS v, count(*) AS k FROM graded GROUP BY ALL), d AS (SELECT x.condition AS a, y.condition AS b, x.v - y.v AS d, sum(x.k * y.k) AS w FROM g x JOIN g y ON x.condition < y.condition GROUP BY ALL),
    c AS (SELECT *, sum(w) OVER (PARTITION BY a, b ORDER BY d) AS upto, sum(w) OVER (PARTITION BY a, b) AS total FROM d) SELECT a, b, round((min(d) FILTER (upto > (total - 1) // 2) + min(d) FILTER (upto > total // 2)) / 2, 6) AS hodges_lehmann FROM c GROUP BY a, b""")  # fmt: skip
def m21(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = T.hodges_lehmann(T.pair_counts(graded(spark, sf_dir), "condition", "purchase_intent"))
    return out.withColumn("hodges_lehmann", F.round("hodges_lehmann", 6))


@framed("m22_bootstrap")
def m22(spark: SparkSession, sf_dir: str) -> DataFrame:
    """10,000 resamples of each condition; too many for SQL, tests hold the operator against a loop."""
    return T.bootstrap_mean(MAKERS["ratings"](spark, sf_dir), "condition", "card_key", "purchase_intent")


@framed("m23_delta_sensitivity", " UNION ALL ".join(f"(WITH {_tost(f'{d}::DOUBLE')} SELECT a, b, {d}::DOUBLE AS delta, round(p, 6) AS p_tost FROM t)" for d in (0.001, 0.005, 0.02)))
def m23(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = T.sensitivity(graded(spark, sf_dir), "condition", "purchase_intent", [0.001, 0.005, 0.02])
    return out.select("a", "b", "delta", F.round("p_tost", 6).alias("p_tost"))


@framed("m24_judge_means", "SELECT l_linestatus AS judge, l_returnflag AS condition, count(l_discount) AS n, round(avg(l_discount), 6) AS mean FROM lineitem GROUP BY 1, 2")
def m24(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = T.group_summary(table(spark, sf_dir, "lineitem").select(F.col("l_linestatus").alias("judge"), F.col("l_returnflag").alias("condition"), "l_discount"), ["judge", "condition"], "l_discount")
    return s.select("judge", "condition", "n", F.round("mean", 6).alias("mean"))


@framed("m25_rank_agreement", """WITH m AS (SELECT c_mktsegment AS c, avg(o_totalprice) FILTER (o_orderstatus = 'F') AS f, avg(o_totalprice) FILTER (o_orderstatus = 'O') AS o FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1), r AS (SELECT rank() OVER (ORDER BY f) AS rf, rank() OVER (ORDER BY o) AS ro FROM m) SELECT count(*) AS n, round(corr(rf, ro), 6) AS rho FROM r""")
def m25(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    m = j.groupBy("c_mktsegment").pivot("o_orderstatus", ["F", "O"]).agg(F.avg("o_totalprice"))
    return T.spearman(m, "F", "O").withColumn("rho", F.round("rho", 6))


@framed("m26_tropes")
def m26(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").withColumn("headline", F.concat(F.lit("card "), F.col("vec_id").cast("string")))
    return S.tropes(e, "embedding", "headline", F.col("label"))


@framed("m29_image_views", "SELECT vec_id, round(a[1] / n, 6) AS x, round(a[64] / n, 6) AS y FROM (SELECT *, sqrt(list_sum([x * x FOR x IN a])) AS n FROM (SELECT vec_id, [(x::DOUBLE + y) / 2 FOR x, i IN embedding IF true] AS a0, [(x::DOUBLE + embedding[65 - i]) / 2 FOR x, i IN embedding] AS a FROM embeddings))".replace("[(x::DOUBLE + y) / 2 FOR x, i IN embedding IF true] AS a0, ", ""))
def m29(spark: SparkSession, sf_dir: str) -> DataFrame:
    from listwright.functions.vectors import mean_of

    v = F.transform("embedding", lambda x: x.cast("double"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", mean_of([v, F.reverse(v)]).alias("m"))
    return rows.select("vec_id", F.round(F.col("m")[0], 6).alias("x"), F.round(F.col("m")[63], 6).alias("y"))


both("m30_label_coverage", "SELECT l.source, count(m.quality) AS quality, count(m.toxic) AS toxic FROM listings l LEFT JOIN marks m ON l.listing_id = m.listing_id GROUP BY l.source")
both("m31_seed_spread", "SELECT l_linestatus, round(avg(m), 6) AS mean, round(stddev_samp(m), 6) AS sd, round(min(m), 6) AS low, round(max(m), 6) AS high FROM (SELECT l_linestatus, l_linenumber, avg(l_discount) AS m FROM lineitem GROUP BY 1, 2) s GROUP BY l_linestatus")


@framed("m32_persona_variation", """WITH w AS (SELECT conv_id, turn, regexp_extract_all(lower(text), '([a-z0-9'']+)', 1) AS s FROM conversations), o AS (SELECT *, row_number() OVER (ORDER BY md5(concat_ws('|', '42', conv_id)), conv_id) AS i FROM w WHERE turn = 0),
    p AS (SELECT true AS within_card, a.s AS x, b.s AS y FROM w a JOIN w b ON a.conv_id = b.conv_id AND a.turn < b.turn UNION ALL SELECT false, a.s, b.s FROM o a JOIN range(1, 9) k(k) ON true JOIN o b ON b.i = a.i + k)
    SELECT within_card, count(*) AS n, round(avg(CASE WHEN len(x) + len(y) = 0 THEN 0 ELSE len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))) END), 6) AS j FROM p GROUP BY 1""")  # fmt: skip
def m32(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Across cards pairs are sampled (T-08): each first turn with the next 8 in a seeded order."""
    from listwright.functions.titles import word_jaccard
    from listwright.operators.ranking import md5_order, summed_before

    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    a, b = c.alias("a"), c.alias("b")
    same = a.join(b, F.col("a.conv_id") == F.col("b.conv_id")).where("a.turn < b.turn").select(F.lit(True).alias("within_card"), F.col("a.text").alias("x"), F.col("b.text").alias("y"))
    first = summed_before(c.where("turn = 0"), [md5_order("42", F.col("conv_id")), F.col("conv_id")], F.lit(1), "i")
    after = first.select(F.col("text").alias("x"), F.explode(F.sequence(F.col("i") + 1, F.col("i") + 8)).alias("i"))
    other = after.join(first.select("i", F.col("text").alias("y")), "i").select(F.lit(False).alias("within_card"), "x", "y")
    return same.union(other).groupBy("within_card").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(word_jaccard(F.col("x"), F.col("y"))), 6).alias("j"))


@framed("m33_disagreement_driver", "SELECT id, CASE WHEN a >= b AND a >= c THEN 'aesthetic' WHEN b >= c THEN 'fit' ELSE 'intent' END AS driver FROM (SELECT id, round(abs(aesthetic - 0.04), 9) AS a, round(abs(fit - 0.5), 9) AS b, round(abs(purchase_intent - 0.05), 9) AS c FROM graded)")
def m33(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = lambda c, m: F.round(F.abs(F.col(c) - m), 9)
    worst = F.array_max(F.array(F.struct(d("aesthetic", 0.04).alias("d"), F.lit(3).alias("o"), F.lit("aesthetic").alias("dim")), F.struct(d("fit", 0.5).alias("d"), F.lit(2).alias("o"), F.lit("fit").alias("dim")), F.struct(d("purchase_intent", 0.05).alias("d"), F.lit(1).alias("o"), F.lit("intent").alias("dim"))))
    return graded(spark, sf_dir).select("id", worst["dim"].alias("driver"))


both("m34_parameter_sweep", "SELECT l_linenumber AS config, round(avg(l_discount), 6) AS mean, sum(CASE WHEN l_discount >= 0.05 THEN 1 ELSE 0 END) AS passed FROM lineitem GROUP BY l_linenumber")
