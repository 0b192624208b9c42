"""Operators 3 and 8 against their laws and against brute force."""

import math
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from listwright.llm.mixing import mixed, op8_mix, repeated, targets
from listwright.llm.sharding import interleaved, op3_interleave


def test_shards_hold_the_mixture(spark, sf):
    rows = op3_interleave(spark, sf).collect()
    n = Counter(r["shard"] for r in rows)
    assert sum(n.values()) == 200 and max(n.values()) - min(n.values()) <= 1 and set(n) == set(range(8))
    for k in n:
        assert sorted(r["slot"] for r in rows if r["shard"] == k) == list(range(n[k]))
    total, by = Counter(r["source"] for r in rows), Counter((r["source"], r["shard"]) for r in rows)
    assert all(abs(by[s, k] - total[s] / 8) <= 2 for s in total for k in n)


def test_shards_equal_brute_force(spark):
    rows = spark.range(103).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), (F.col("id") % 5 * (F.col("id") % 3)).cast("string")).alias("source"))
    keyed = rows.select("doc_id", "source", F.xxhash64(F.lit(20_240_229), "doc_id").alias("h")).collect()
    groups = defaultdict(list)
    for r in keyed:
        groups[r["source"]].append((r["h"] % 64, r["h"], r["doc_id"]))
    at = {d: (i + 0.5) / len(g) for g in groups.values() for i, (_, _, d) in enumerate(sorted(g))}
    got = {r["doc_id"]: (r["shard"], r["slot"]) for r in interleaved(rows).collect()}
    place = sorted(got, key=lambda d: got[d])
    assert all(at[a] <= at[b] for a, b in zip(place, place[1:], strict=False))
    assert [got[d][0] for d in place] == [i * 8 // 103 for i in range(103)]


def test_odd_rows_are_sharded(odd, none):
    got = interleaved(odd).collect()
    assert len(got) == 12 and {r["shard"] for r in got} == set(range(8)) and got[0]["size"] == "clash"
    assert interleaved(none).count() == 0


def test_mix_meets_targets(spark, sf):
    rows = op8_mix(spark, sf).collect()
    by = defaultdict(lambda: [0, 0.0, 0, 0])
    for r in rows:
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        b = by[r["source"]]
        b[0], b[1], b[2], b[3] = b[0] + r["taken"], r["target"], b[2] + r["size"], max(b[3], r["size"])
    total, weights = 1.5 * sum(b[2] for b in by.values()), {s: (3, 1, 2)[i % 3] for i, s in enumerate(sorted(by))}
    want, open_ = {}, set(by)
    while True:  # the excess over a cap is dealt again until none is above
        left = total - sum(want.values())
        w = sum(weights[s] for s in open_)
        over = {s for s in open_ if left * weights[s] / w > 2 * by[s][2] + 1e-9}
        if not over:
            break
        want |= {s: 2.0 * by[s][2] for s in over}
        open_ -= over
    want |= {s: left * weights[s] / w for s in open_}
    for s, b in by.items():
        assert math.isclose(b[1], want[s], rel_tol=1e-9) and abs(b[0] - b[1]) <= b[3]
    again = {r["doc_id"]: r["taken"] for r in op8_mix(spark, sf).collect()}
    assert again == {r["doc_id"]: r["taken"] for r in rows}


def test_rates_solve_the_dual(spark, sf):
    """Rates of one source lie on one exponential tilt, and meet its target."""
    rows = [r for r in op8_mix(spark, sf).collect() if 0 < r["rate"] < 2 and r["size"]]
    by = defaultdict(list)
    for r in rows:
        by[r["source"]].append((r["size"], math.log(r["rate"] / (2 - r["rate"]))))
    for pairs in by.values():
        slopes = [y / x for x, y in pairs]
        assert max(slopes) - min(slopes) < 1e-3 * max(1, abs(max(slopes, key=abs)))
    sums = defaultdict(float)
    for r in op8_mix(spark, sf).collect():
        sums[r["source"], r["target"]] += r["rate"] * r["size"]
    assert all(math.isclose(got, want, rel_tol=1e-4) for (_, want), got in sums.items())


def test_odd_rows_are_mixed(odd, none):
    got = mixed(odd).collect()
    assert len(got) == 12 and all(r["taken"] == 0 for r in got if r["text"] in (None, "", " \t\n "))
    assert sum(r["size"] for r in got) == repeated(mixed(odd).withColumn("copies", F.lit(1))).agg(F.sum("size")).first()[0]
    assert mixed(none).count() == 0


def test_targets_without_words(spark):
    s = spark.createDataFrame([((False, "a"), 0, 2), ((True, ""), 0, 1)], "src struct<none:boolean,name:string>, tokens long, n long")
    assert [r["target"] for r in targets(s, 1.5, 2, (3, 1, 2)).collect()] == [0, 0]
