"""Hand-checked cases of column functions, statistics and sinks."""

import datetime as dt
import math
import random
import time
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from listwright.functions import titles as T
from listwright.functions import vectors as V
from listwright.functions import web
from listwright.operators import designs as D
from listwright.operators import ranking as R
from listwright.operators import scoring as S
from listwright.operators import statistics as M
from listwright.operators import upserts as U


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("text, want", [("Happy 29th", [29]), ("33rd and 3rd", [3, 33]), ("age 4", [4]), ("50 years old", [50]), ("at 60, turning 30", [30, 60]), ("", [])])
def test_ages(spark, text, want):
    assert one(spark, T.ages(F.col("t")), t=text) == want


def test_occasion_from_age(spark):
    assert [one(spark, T.occasion_from_age(F.lit(t))) for t in ("age 4", "50th", "14 years old", "none")] == [T.KIDS, T.MILESTONE, None, None]
    assert one(spark, T.ages_rule_out_kids(F.lit("16th Birthday Girl"))) and not one(spark, T.ages_rule_out_kids(F.lit("Girl")))


def test_final_occasion(spark):
    def got(title, label, score):
        return tuple(one(spark, T.final_occasion(F.lit(title), F.lit(label), F.lit(score))))

    assert got("14 Year Old Gift", T.KIDS, 0.99) == (T.GENERAL, 0.99)
    assert got("age 4", T.GENERAL, 0.2) == (T.KIDS, 1.0)
    assert got("Card", T.NOT_BIRTHDAY, 0.9) == (None, 0.9)
    assert got("Card", T.RELATIONSHIP, 0.3) == (T.GENERAL, 0.3)


def test_signals(spark):
    s = one(spark, T.signals(F.lit("Brother-in-law 40th, my Wife")))
    assert (s["kid_word"], s["milestone_age"], s["adult_age"], s["rel_word"]) == (False, True, True, True)
    assert one(spark, T.signals(F.lit("Kidney stone")))["kid_word"] is False
    assert one(spark, T.signals(F.lit("for my son")))["kid_word"] is True


@pytest.mark.parametrize("text, want", [("£3.99", (399, "GBP")), ("$12.50", (1250, "USD")), ("€5.00", (500, "EUR")), (None, (None, None)), ("Add to cart", (None, None)), ("£4", (400, "GBP")), ("From £2.50 per card", (250, "GBP"))])
def test_price(spark, text, want):
    assert tuple(one(spark, T.price(F.lit(text).cast("string")))) == want


@pytest.mark.parametrize("text, want", [("[[7]]", 7.0), ("[6]", 6.0), ("[2024]", None), ("[[0]]", None), ("[[11]] [3]", None), ("none", None)])
def test_rating(spark, text, want):
    assert one(spark, T.rating(F.lit(text))) == want


def test_pmf(spark):
    a = lambda xs: F.array(*[F.lit(float(x)) for x in xs])
    p = one(spark, V.pmf(a([0.61, 0.64, 0.70, 0.66, 0.62])))
    assert math.isclose(sum(p), 1) and p[0] == 0
    assert one(spark, V.pmf(a([0.5] * 5))) == [0.2] * 5
    assert one(spark, V.pmf(a([0.1, 0.2, 0.3, 0.4, 0.5]), 0.1))[0] > 0
    assert one(spark, V.sharpened(a([0.1, 0.2, 0.7]), 0.0)) == [0, 0, 1] and one(spark, V.sharpened(a([0.1, 0.9]), 1.0)) == [0.1, 0.9]


def test_bits_and_names(spark):
    assert one(spark, V.hamming(F.lit(0b1010), F.lit(0b1100))) == 2 and one(spark, V.hamming(F.lit(42), F.lit(42))) == 0
    assert one(spark, V.uuid5(F.lit("abc"))) == str(uuid.uuid5(uuid.NAMESPACE_OID, "abc"))
    assert one(spark, V.from_bits(F.lit("1" * 64))) == -1 and one(spark, V.top_byte(F.lit(-1))) == 255


@pytest.mark.parametrize("text, want", [('{"k": 1}', 1), ('Sure:\n```json\n{"k": 2}\n```', 2), ("{'k': 3}", 3), ('{"k": 4, "t": "a\nb"}', 4), ("no json", None), ("{broken", None)])
def test_repaired_json(spark, text, want):
    assert one(spark, F.try_variant_get(web.repaired_json(F.lit(text)), "$.k", "int")) == want


def test_listing_from_a_page_without_json_ld(spark):
    html = '<h1>A card</h1><div data-testid="work-description">Nice</div><span data-testid="product-price">$4.50</span><a href="/people/artshop/shop">x</a><img src="https://ih1.redbubble.net/image.1.1/papergc,x.jpg"><img src="https://ih1.redbubble.net/image.1.1/flat,x.jpg">'
    got = one(spark, web.listing(F.lit(html), F.lit("https://x/i/card/987654321/q")))
    assert (got["source_listing_id"], got["title"], got["description"], got["seller_id"], got["price_minor_units"], got["currency"]) == ("987654321", "A card", "Nice", "artshop", 450, "USD")
    assert got["image_urls"] == ["https://ih1.redbubble.net/image.1.1/flat,x.jpg"]


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (5, 6), (9, 9)], "u long, v long")
    assert {tuple(r) for r in D.connected_components(edges).collect()} == {(1, 1), (2, 1), (3, 1), (5, 5), (6, 5)}
    chain = spark.range(200).selectExpr("id as u", "id + 1 as v")
    assert D.connected_components(chain).where("component <> 0").count() == 0
    assert D.connected_components(edges.limit(0)).count() == 0


def test_banded_pairs_lose_nothing(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(-(2**62), 2**62, 40)
    near = [int(b) ^ sum(1 << int(k) for k in rng.choice(63, 6, replace=False)) for b in base]
    h = [int(x) for x in base] + near
    rows = spark.createDataFrame(list(enumerate(h)), "id long, h long")
    want = {(i, j) for i in range(80) for j in range(i + 1, 80) if bin((h[i] ^ h[j]) & (2**64 - 1)).count("1") <= 6}
    assert {tuple(r) for r in D.banded_hash_pairs(rows).collect()} == want


def test_hash_links_join_what_pairs_join(spark):
    rng = np.random.default_rng(2)
    base = [int(x) for x in rng.integers(-(2**62), 2**62, 12)]
    h = base * 3 + [b ^ 5 for b in base] + [b ^ (1 << 60) for b in base]  # copies, near ones, near ones of another bucket
    rows = spark.createDataFrame(list(enumerate(h)), "id long, h long")
    comps = lambda e: sorted(map(tuple, D.connected_components(e.withColumnsRenamed({"a": "u", "b": "v"})).collect()))
    pairs = D.hash_pairs(rows)
    assert comps(D.hash_links(rows)) == comps(pairs) and pairs.count() == 12 * 6
    assert D.banded_hash_pairs(rows).count() == 12 * 10 and D.hash_links(rows).count() < 12 * 4


def test_links_of_near_vectors(spark):
    v = [[1.0, 0.0], [0.99, 0.05], [0.0, 1.0], [-1.0, 0.0], [0.0, 0.0], None]
    near = D.nearest(spark.createDataFrame(list(enumerate(v)), "id long, v array<double>"), 2)
    assert [tuple(r) for r in D.similar_pairs(near).collect()] == [(0, 1)]


def test_sums_before_and_numbers_of_inserted_rows(spark):
    rows = spark.range(0, 5000, 1, 7).selectExpr("(id * 37) % 5000 AS k", "id % 3 AS w")
    got = R.summed_before(rows, [F.col("k")], F.col("w"), "s").orderBy("k").collect()
    assert [r["s"] for r in got] == [0, *np.cumsum([r["w"] for r in got])[:-1].tolist()]
    old, new = spark.createDataFrame([(7, "a"), (9, "b")], "card_id long, k string"), spark.createDataFrame([("d",), ("c",)], "k string")
    assert sorted(map(tuple, U.inserted(old, new, "card_id", ["k"]).select("k", "card_id").collect())) == [("c", 10), ("d", 11)]
    assert U.inserted(old.limit(0), new, "card_id", ["k"]).agg(F.max("card_id")).first()[0] == 2


def test_scores_fill_null_and_json_null(spark):
    old = spark.createDataFrame([(1, None), (2, "null"), (3, '{"a":1}'), (4, None)], "k int, s string")
    new = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z"), (9, "w")], "k int, s string")
    assert sorted(map(tuple, U.scores_filled(old, new, "k", "s").collect())) == [(1, "x"), (2, "y"), (3, '{"a":1}'), (4, None)]


@pytest.mark.parametrize("part_rows", [20_000, 16])
def test_bootstrap_is_that_of_a_loop(spark, monkeypatch, part_rows):
    monkeypatch.setattr(M, "PART_ROWS", part_rows)
    rng = np.random.default_rng(3)
    groups = {"a": rng.exponential(1, 40), "b": rng.normal(5, 2, 150), None: rng.normal(0, 1, 30)}
    rows = spark.createDataFrame([(g, i, float(x)) for g, xs in groups.items() for i, x in enumerate(xs)] + [("a", 99, None), ("z", 1, None)], "g string, k int, v double")
    got = {r["g"]: (r["low"], r["high"]) for r in M.bootstrap_mean(rows, "g", "k", "v").collect()}
    assert set(got) == set(groups)
    for g, xs in groups.items():
        means = rng.choice(xs, (20_000, len(xs))).mean(axis=1)
        spread = 0.08 * means.std() * (1 if part_rows > 1000 else 2)
        assert np.abs(np.array(got[g]) - np.quantile(means, [0.025, 0.975])).max() < spread, (g, got[g])
    again = M.bootstrap_mean(rows.repartition(7), "g", "k", "v")
    assert all(got[r["g"]] == pytest.approx((r["low"], r["high"])) for r in again.collect())


def test_ridge_penalty_by_refits(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(40, 6))
    y = x @ np.array([1, -1, 0, 0, 0, 0.5]) + 2 * rng.normal(size=40) + 3
    rows = spark.createDataFrame([(list(map(float, a)), float(b)) for a, b in zip(x, y, strict=True)], "x array<double>, y double")
    w, b, alpha = S.ridge(rows, "x", "y")

    def fit(x, y, a):
        mx, my = x.mean(axis=0), y.mean()
        w = np.linalg.solve((x - mx).T @ (x - mx) + a * np.eye(6), (x - mx).T @ (y - my))
        return w, my - mx @ w

    def loo(a):
        out = 0.0
        for i in range(40):
            keep = np.arange(40) != i
            v, c = fit(x[keep], y[keep], a)
            out += (y[i] - x[i] @ v - c) ** 2
        return out

    best = min(S.ALPHAS, key=loo)
    assert alpha == best and 0.001 < best < 10_000 and np.allclose(w, fit(x, y, best)[0]) and np.isclose(b, fit(x, y, best)[1])


def test_wrapped_lines_fit_their_box(spark):
    assert T.wrapped("a bb, ccc dd e", 8) == ["a bb,", "ccc dd e"] and T.wrapped("aaaa bbbb cc", 9) == ["aaaa bbbb", "cc"] and T.wrapped("", 5) == [""]
    size, lines = T.fitted("Happy Birthday, dear old friend", 400, 160)
    fits = lambda s: len(x := T.wrapped("Happy Birthday, dear old friend", 400, lambda t: len(t) * s * 0.55)) * s * 1.2 <= 160 and max(len(y) for y in x) * s * 0.55 <= 400
    assert fits(size) and not fits(size + 1) and " ".join(lines) == "Happy Birthday, dear old friend" and T.fitted("x" * 99, 400, 160) is None
    rows = spark.createDataFrame([("Hi",), (None,), ("x" * 99,)], "t string").select(T.fitted_lines(F.col("t"), 400, 160).alias("f")).collect()
    assert rows[0]["f"]["lines"] == ["Hi"] and rows[1]["f"]["size"] is None and rows[2]["f"]["lines"] is None


def test_steps_run_in_order_and_report(spark):
    from listwright.steps import Steps, discovered, reranked, retried

    s, ran = Steps(), []
    for name in ("scrape", "embed", "dedup"):
        s.step(name, f"does {name}")(lambda n, name=name: ran.append(name) or (1 // 0 if name == "embed" else n))
    assert [r["step"] for r in s.run(5, dry_run=True)] == ["scrape", "embed", "dedup"] and not ran
    report = s.main(["--from", "embed"], 5)
    assert ran == ["embed", "dedup"] and "ZeroDivision" in report[0]["error"] and report[1]["rows"] == 5
    assert [r["step"] for r in s.main(["--only", "scrape"], 1)] == ["scrape"]
    with pytest.raises(ValueError):
        s.chosen(only="nothing")

    class Shop:
        name, any_query = "shop", False

        def discover(self, spark, query, limit):
            return spark.range(limit).selectExpr(f"concat('u', id + {len(query)}) AS url")

        def score(self, features):
            return features.withColumn("pi", F.length("url") + F.col("url").endswith("3").cast("int"))

    known = spark.createDataFrame([("u2",)], "url string")
    found = discovered(spark, Shop(), ["a", "bb"], 3, known)
    assert sorted(map(tuple, found.collect())) == [("u1", "a"), ("u3", "a"), ("u4", "bb")] and discovered(spark, Shop(), [], 3).count() == 0
    assert [(r["rank"], r["url"]) for r in reranked(found, Shop(), "url", "pi", 2).orderBy("rank").collect()] == [(1, "u3"), (2, "u1")]

    calls, waits = [], []
    assert retried(lambda: calls.append(1) or (1 // 0 if len(calls) < 3 else "ok"), sleep=waits.append) == "ok" and waits == [1.0, 2.0]
    with pytest.raises(ZeroDivisionError):
        retried(lambda: 1 // 0, sleep=waits.append)


def test_upsert_policies(spark):
    old = spark.createDataFrame([(1, "a", "x", 1), (2, "b", "y", 1)], "k int, f string, n string, o int")
    new = spark.createDataFrame([(2, None, None, 5), (3, "c", "z", 5)], "k int, f string, n string, o int")
    got = U.upserted(old, new, ["k"], {"f": U.FILL_NEW, "n": U.KEEP_NEW, "o": U.KEEP_OLD})
    assert sorted(map(tuple, got.collect())) == [(1, "a", "x", 1), (2, "b", None, 1), (3, "c", "z", 5)]
    assert U.keys_hold(got, ["k"]) and not U.keys_hold(got.union(got), ["k"])


def ratings(spark, groups):
    return spark.createDataFrame([(g, float(v)) for g, vs in groups.items() for v in vs], "g string, v double")


def test_mann_whitney_signs_and_p(spark):
    got = M.pairwise(ratings(spark, {"A": range(10), "B": range(20, 30)}), "g", "v").first()
    assert got["u"] == 0 and got["rank_biserial"] == 1.0
    z = (50 - 0.5) / math.sqrt(100 / 12 * 21)
    assert math.isclose(got["p_two"], math.erfc(z / math.sqrt(2)), rel_tol=1e-9)
    same = M.pairwise(ratings(spark, {"A": range(10), "B": range(10)}), "g", "v").first()
    assert same["rank_biserial"] == 0 and same["p_two"] == 1.0


def many_equal(spark, values=(0.0, 0.0, 0.0)):
    """Three groups of 1,200,000 equal values each: the cube of two groups' count does not fit a long."""
    g, v = F.array(*map(F.lit, "ABC")), F.array(*map(F.lit, values))
    return spark.range(3_600_000).select(F.get(g, F.col("id") % 3).alias("g"), F.get(v, F.col("id") % 3).alias("v"))


def test_mann_whitney_of_many_equal_values(spark):
    rows = many_equal(spark).union(ratings(spark, {"A": range(1, 101)}))
    got = {(r["a"], r["b"]): r for r in M.pairwise(rows, "g", "v").collect()}
    n1, n2, t = 1_200_100, 1_200_000, 2_400_000
    u, n = 1_200_000 * 600_000 + 100 * 1_200_000, n1 + n2
    z = (u - n1 * n2 / 2 - 0.5) / math.sqrt(n1 * n2 / 12 * (n + 1 - (t**3 - t) / (n * (n - 1))))
    assert got["A", "B"]["u"] == u and math.isclose(got["A", "B"]["p_two"], math.erfc(z / math.sqrt(2)), rel_tol=1e-6)
    assert got["B", "C"]["p_two"] == 1.0 and len(got) == 3


def test_holm(spark):
    df = ratings(spark, {"A": range(12), "B": range(3, 15), "C": range(6, 18), "D": range(9, 21), "E": [1, 2]})
    got = M.holm(M.pairwise(df, "g", "v"), "p_two").collect()
    assert len(got) == 6 and all(r["p_holm"] >= r["p_two"] for r in got) and max(r["p_holm"] for r in got) <= 1
    assert {(r["a"], r["b"]) for r in got} == {(a, b) for a in "ABCD" for b in "ABCD" if a < b}


def test_holm_of_many_equal_values(spark):
    got = M.holm(M.pairwise(many_equal(spark), "g", "v"), "p_two").collect()
    assert {(r["a"], r["b"]): r["p_holm"] for r in got} == {("A", "B"): 1.0, ("A", "C"): 1.0, ("B", "C"): 1.0}


def test_hodges_lehmann_is_the_offset(spark):
    df = ratings(spark, {"A": [1, 2, 3, 4], "B": [1.5, 2.5, 3.5, 4.5]})
    assert M.hodges_lehmann(M.pair_counts(df, "g", "v", least=1)).first()["hodges_lehmann"] == -0.5
    assert M.hodges_lehmann(M.pair_counts(df.limit(0), "g", "v", least=1)).count() == 0


def test_equivalence_grows_with_the_margin(spark):
    df = ratings(spark, {"A": [i / 40 for i in range(40)], "B": [i / 40 + 0.01 for i in range(40)]})
    ps = [M.equivalence(df, "g", "v", d).first()["p_tost"] for d in (0.01, 0.1, 0.4)]
    assert ps[0] > ps[1] > ps[2] and ps[2] < 0.05


def test_equivalence_of_many_equal_values(spark):
    got = {(r["a"], r["b"]): r for r in M.equivalence(many_equal(spark, (0.0, 0.5, 1.0)), "g", "v", 0.5).collect()}
    assert len(got) == 3 and not any(r["equivalent"] for r in got.values()) and got["A", "B"]["p_tost"] == 1.0


def test_sensitivity_of_many_equal_values(spark):
    got = {(r["a"], r["b"], r["delta"]): r["first_delta"] for r in M.sensitivity(many_equal(spark, (0.0, 0.25, 0.25)), "g", "v", [0.25, 0.5]).collect()}
    assert len(got) == 6 and got["A", "B", 0.5] == 0.5 and got["B", "C", 0.25] == 0.25


def test_spearman_guards(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 4.0), (3.0, 9.0), (None, 1.0)], "x double, y double")
    assert M.spearman(df, "x", "y").first()["rho"] == pytest.approx(1.0)
    assert M.spearman(df, "x", "y", least=5).first()["rho"] is None
    assert M.spearman(df.withColumn("y", F.lit(1.0)), "x", "y").first()["rho"] is None


def test_spearman_of_values_that_change_when_made_again(spark):
    unsteady = F.udf(lambda i: i + random.random() / 1000, "double").asNondeterministic()
    df = spark.range(10).select(unsteady("id").alias("x"), unsteady("id").alias("y"))
    assert tuple(M.spearman(df, "x", "y").first()) == (10, pytest.approx(1.0))


def test_calibration(spark):
    df = spark.createDataFrame([(0.9, 0.0)] * 10 + [(1.0, 1.0)] * 10, "p double, t double")
    bins = M.calibration_bins(df, "p", "t").collect()
    assert [b["bin"] for b in bins] == [9] and bins[0]["k"] == 20
    got = S.isotonic(spark.createDataFrame([(i / 10, (i % 3) / 2) for i in range(10)], "p double, t double"), "p", "t").orderBy("p").collect()
    assert all(a["calibrated"] <= b["calibrated"] for a, b in zip(got, got[1:], strict=False))


def test_group_split_is_disjoint_and_stable(spark):
    rows = spark.range(300).selectExpr("id as listing_id", "case when id % 3 > 0 then concat('s', id % 40) end as seller_id")
    a = S.group_split(rows, "seller_id", "listing_id")
    assert a.where("seller_id is not null").groupBy("seller_id").agg(F.count_distinct("side").alias("n")).where("n > 1").count() == 0
    b = S.group_split(rows.orderBy(F.desc("listing_id")), "seller_id", "listing_id")
    assert sorted(map(tuple, a.select("listing_id", "side").collect())) == sorted(map(tuple, b.select("listing_id", "side").collect()))


def test_ridge_finds_a_linear_signal(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 8))
    y = 0.5 + x @ np.arange(8) / 100
    rows = spark.createDataFrame([(list(map(float, a)), float(b)) for a, b in zip(x, y, strict=True)], "x array<double>, y double")
    w, b, alpha = S.ridge(rows, "x", "y")
    assert np.allclose(w, np.arange(8) / 100, atol=1e-3) and abs(b - 0.5) < 1e-3 and alpha in S.ALPHAS


def test_images():
    grey, dark = bytes([240]) * (3 * 32 * 32), bytes([15]) * (3 * 32 * 32)
    ramp = np.repeat(np.arange(0, 256, 8, dtype=np.uint8)[None, :, None], 32, 0).repeat(3, 2).tobytes()
    assert S.complexity(32, 32, grey) == 0 and S.complexity(32, 32, ramp) > 0
    assert S.perceptual_hash(32, 32, ramp) != S.perceptual_hash(32, 32, ramp[::-1])
    p = S.palette(32, 32, dark)
    assert math.isclose(sum(c["weight"] for c in p), 1) and p[0]["L"] < 10


def test_ranking(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("a", 5), ("b", 2)], "g string, v int")
    assert sorted(r["rank"] for r in R.average_ranks(df, "v", ["g"]).collect()) == [1.0, 1.5, 1.5, 3.0]
    assert [tuple(r) for r in R.gaps(df, "g", "v").orderBy("v").collect()] == [("a", 2), ("a", 3), ("a", 4)]
    assert one(spark, R.position_of(F.array(F.lit("x"), F.lit("y")), F.lit("z"))) is None


def test_rate_limit_matches_a_loop(spark):
    from listwright.streaming import rate_limited, spaced

    rng = np.random.default_rng(5)
    start = dt.datetime(2024, 1, 1)
    calls = [(f"t{i % 3}", start + dt.timedelta(seconds=int(s))) for i, s in enumerate(sorted(rng.integers(0, 400, 120)))]
    got = {(r["token"], r["at"], i): r["allowed"] for i, r in enumerate(rate_limited(spark.createDataFrame(calls, "token string, at timestamp"), "token", "at", 3, 60).collect())}
    want = []
    for t in ("t0", "t1", "t2"):
        held = []
        for at in sorted(a for k, a in calls if k == t):
            held = [h for h in held if (at - h).total_seconds() <= 60]
            want.append((t, at, len(held) < 3))
            if len(held) < 3:
                held.append(at)
    assert sorted((t, a, ok) for (t, a, _), ok in got.items()) == sorted(want)
    rows = spark.createDataFrame([(*c, i) for i, c in enumerate(calls)], "token string, at timestamp, i int")
    got = {r["i"]: r["starts_at"] for r in spaced(rows, "token", "at", 7.5, "i").collect()}
    for t in ("t0", "t1", "t2"):
        free = start
        for at, i in sorted((at, i) for i, (k, at) in enumerate(calls) if k == t):
            assert got[i] == max(at, free)
            free = max(at, free) + dt.timedelta(seconds=7.5)


def test_heartbeats():
    from listwright.streaming import heartbeats

    assert heartbeats([], 35) == [10, 20, 30] and heartbeats([5, 14, 23, 32], 35) == []


def test_beats_of_a_table_are_those_of_a_loop(spark):
    from listwright.streaming import beats, heartbeats

    times = {"a": [0, 10, 35, 35, 66], "b": [0], "c": [0, 9, 30]}
    rows = [(j, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s), i) for j, ts in times.items() for i, s in enumerate(ts)]
    got = {r["job"]: r["beats"] for r in beats(spark.createDataFrame(rows, "job string, at timestamp, i int"), "job", "at", "i").collect()}
    assert got == {j: len(heartbeats([float(t) for t in ts[1:-1]], float(ts[-1]) - 0.001)) for j, ts in times.items()}


def test_sources(spark, tmp_path):
    from listwright import sources as s

    (tmp_path / "moon.json").write_text('[{"url": "u1", "title": "A", "image_urls": ["x"]}, {"url": "u2", "source": "shop"}]')
    assert sorted((r["url"], r["source"]) for r in s.curated(spark, str(tmp_path / "moon.json")).collect()) == [("u1", "moon"), ("u2", "shop")]
    (tmp_path / "train.log").write_text("noise\nseed=42 epoch=0150 train_loss=0.0035 val_pi_rho=0.598\n")
    assert tuple(s.training_log(spark, str(tmp_path / "train.log")).first()) == (42, 150, 0.0035, 0.598)
    (tmp_path / "ratings_judge1.csv").write_text("card_key,condition,occasion,occasion_fit,aesthetic,emotional_resonance,distinctiveness,purchase_intent\nk,A,b,1,1,1,1,0.5\n")
    assert s.ratings(spark, str(tmp_path / "ratings_*.csv")).first()["judge"] == "judge1"
    (tmp_path / "g.html").write_text('<img src="a.png"><figcaption>One</figcaption><img src="b.png"><figcaption>Two</figcaption>')
    assert [(r["src"], r["caption"]) for r in s.gallery(spark, str(tmp_path / "g.html")).orderBy("pos").collect()] == [("a.png", "One"), ("b.png", "Two")]
    s.dumped({"t": spark.range(3)}, str(tmp_path / "dump"))
    assert spark.read.parquet(str(tmp_path / "dump/t.parquet")).count() == 3
    assert s.blobs(spark, str(tmp_path / "g.html")).first()["scheme"] == "file"
    assert s.cached_pages(spark, str(tmp_path / "g.html")).first()["key"] == "g"


def test_append_sink_streams_allowed_events(spark, tmp_path):
    from listwright.streaming import append_sink

    rows = spark.createDataFrame([("choice", 1), ("other", 2), ("reveal", 3)], "event_type string, n int")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    append_sink(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    assert sorted(r["n"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 3]


def test_job_stream_passes_messages_and_ends(spark, tmp_path):
    from listwright.streaming import job_stream

    rows = spark.createDataFrame([("j", "progress"), ("j", "done"), ("k", "progress")], "job string, kind string")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = job_stream(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("jobs").outputMode("append").start()
    until = time.time() + 60
    while time.time() < until and spark.sql("select * from jobs where kind <> 'heartbeat'").count() < 3:
        time.sleep(0.5)
    q.stop()
    assert spark.sql("select * from jobs where kind <> 'heartbeat'").count() == 3


def test_pages_of_one_url_keep_their_own_content(spark, tmp_path):
    from listwright import plans

    rows = [(2, "u", "a"), (4, "u", "bbb"), (6, "u", "bbb"), (8, None, "cc"), (10, "w", None), (1, "u", "odd")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = plans.queries()["s16_reparsed_pages"](spark, str(tmp_path))
    assert sorted((r["page_id"], r["n"]) for r in got.collect()) == [(2, 1), (4, 3), (6, 3), (8, 2)]
