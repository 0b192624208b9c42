"""Operator 2: near-duplicate embeddings by robust-pruned flat graphs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listwright.llm.common import fewer, forgotten, tune, written
from listwright.llm.simhash import Forest
from listwright.operators.graph import connected_components

COSINE = 0.98
#: Vectors of one shard on average, and the most of one unit of work: larger shards are dealt out as pairs of groups.
SHARD_ROWS, UNIT_ROWS = 1500, 4096
#: Bounds on the sample that centroids are fitted on, and on the centroids, of all labels together.
SAMPLE_ROWS, MOST_CENTROIDS, ROUNDS = 30_000, 8192, 6
#: Graph: out-degree, candidates, far candidates and slack of the pruning; search: beam; block of queries.
DEGREE, NEAREST, FAR, ALPHA, BEAM, BLOCK = 20, 48, 8, 1.2, 16, 128
#: Shards a vector belongs to, at first and at most; audited queries (twice) and the recall below which shards overlap more.
OVERLAP, MOST_OVERLAP, AUDIT, LEAST_RECALL = 2, 4, 256, 0.97
#: Edges that one step of the expansion looks at, which bounds its memory whatever the degrees.
WAVE = 1 << 21
#: Audited vectors with few neighbours have at most so many.
FEW = 8


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def centroids(x: np.ndarray, k: int, seed: int = 1) -> np.ndarray:
    """k directions (or fewer) by spherical k-means."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(ROUNDS):
        near = (x @ c.T).argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        long = np.linalg.norm(sums, axis=1)
        c = np.where(long[:, None] > 1e-9, sums / np.maximum(long, 1e-9)[:, None], c)
    return c


def robust_graph(x: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA, seed: int = 3) -> list[np.ndarray]:
    """Out-neighbours of each row of x (unit vectors): of the nearest and some far candidates, by increasing distance,
    one stays unless a kept one is alpha times nearer to it than the row is. Edges are kept in both directions."""
    n = len(x)
    if n < 2:
        return [np.zeros(0, np.int64) for _ in range(n)]
    y = x.astype(np.float32)
    rng, near = np.random.default_rng(seed), min(NEAREST, n - 1)
    far = rng.integers(0, n, (n, FAR))
    kept_u, kept_v = [], []
    for at in range(0, n, 512):
        s = y[at : at + 512] @ y.T
        rows = np.arange(len(s))
        s[rows, at + rows] = -2
        top = np.argpartition(-s, near - 1, axis=1)[:, :near]
        cand = np.concatenate((top, far[at : at + 512]), axis=1)
        d = 2 - 2 * np.take_along_axis(s, cand, axis=1)
        d[:, near:][(cand[:, near:, None] == top[:, None, :]).any(axis=2)] = 9
        order = np.argsort(d, axis=1, kind="stable")
        cand, d = np.take_along_axis(cand, order, axis=1), np.maximum(np.take_along_axis(d, order, axis=1), 0)
        open_ = d < 4
        for _ in range(degree):
            some = open_.any(axis=1)
            if not some.any():
                break
            pick = open_.argmax(axis=1)
            v = cand[rows, pick]
            kept_u.append(at + rows[some])
            kept_v.append(v[some])
            between = 2 - 2 * np.einsum("rcd,rd->rc", y[cand], y[v])
            open_ &= alpha * alpha * between > d
            open_[rows, pick] = False
    u, v = np.concatenate(kept_u), np.concatenate(kept_v)
    both = np.unique(np.concatenate((u * n + v, v * n + u)))
    u, v = both // n, both % n
    return np.split(v, np.searchsorted(u, np.arange(1, n)))


def _padded(lists: list[np.ndarray]) -> np.ndarray:
    """Neighbours as a table; -1 fills up."""
    width = max((len(a) for a in lists), default=0) or 1
    out = np.full((len(lists), width), -1, np.int64)
    for i, a in enumerate(lists):
        out[i, : len(a)] = a
    return out


def range_search(x: np.ndarray, graph: np.ndarray, queries: np.ndarray, least: float, beam: int = BEAM) -> np.ndarray:
    """For each query (a row number of x) a row of booleans: the rows found with a cosine of at least `least`.

    A greedy search with a beam goes from the medoid until the beam is expanded. Then the range expands: whatever lies
    in range has its neighbours looked at, until nothing new does. The query's own row is in range of itself."""
    n, q = len(x), len(queries)
    medoid = int((x @ x.mean(axis=0)).argmax())
    rows, seen, found = np.arange(q), np.zeros((q, n + 1), bool), np.zeros((q, n), bool)
    seen[:, n] = True  # where -1 points
    held = np.full((q, beam), -1)
    cos = np.full((q, beam), -9.0)
    done = np.ones((q, beam), bool)
    held[:, 0], cos[:, 0], done[:, 0] = medoid, x[queries] @ x[medoid], False
    seen[:, medoid] = True
    found[:, medoid] = cos[:, 0] >= least
    while not done.all():
        best = np.where(done, -9.0, cos).argmax(axis=1)
        on = ~done[rows, best]
        done[rows, best] = True
        near = np.where(on[:, None], graph[held[rows, best]], -1)
        new = ~seen[rows[:, None], near]
        r, c = np.nonzero(new)
        v = near[r, c]
        seen[r, v] = True
        s = np.full(near.shape, -9.0)
        s[r, c] = np.einsum("id,id->i", x[queries[r]], x[v])
        hit = s[r, c] >= least
        found[r[hit], v[hit]] = True
        ids, sims = np.concatenate((held, near), axis=1), np.concatenate((cos, s), axis=1)
        flags = np.concatenate((done, s < -2), axis=1)
        top = np.argpartition(-sims, beam - 1, axis=1)[:, :beam]
        held, cos, done = (np.take_along_axis(a, top, axis=1) for a in (ids, sims, flags))
    found[rows, queries] = True
    seen[rows, queries] = True
    wave, step = found.copy(), max(1, WAVE // graph.shape[1])
    while wave.any():
        r, u = np.nonzero(wave)
        wave = np.zeros_like(found)
        for at in range(0, len(r), step):
            rr, near = np.repeat(r[at : at + step], graph.shape[1]), graph[u[at : at + step]].ravel()
            new = ~seen[rr, near]
            code = np.unique(rr[new] * n + near[new])
            rr, v = code // n, code % n
            seen[rr, v] = True
            for k in range(0, len(rr), 65536):
                a, b = rr[k : k + 65536], v[k : k + 65536]
                hit = np.einsum("id,id->i", x[queries[a]], x[b]) >= least
                wave[a[hit], b[hit]] = True
        found |= wave
    return found


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, float) for v in column])


def _build(part: pd.DataFrame) -> pd.DataFrame:
    part = part.sort_values("rid", ignore_index=True)
    ids = part["rid"].to_numpy(np.int64)
    return pd.DataFrame({"rid": ids, "near": [ids[a] for a in robust_graph(unit(_matrix(part["embedding"])))]})


def _search(least: float):
    """Links of a unit by a search over the united lists."""

    def links(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("rid", ignore_index=True)
        n, ids, raw = len(part), part["rid"].to_numpy(np.int64), _matrix(part["embedding"])
        x, lists = unit(raw), []
        for near in part["near"]:
            near = np.asarray(near, np.int64)
            at = np.minimum(np.searchsorted(ids, near), n - 1)
            lists.append(np.unique(at[ids[at] == near]))
        graph, found = _padded(lists), np.zeros((n, n), bool)
        for at in range(0, n, BLOCK):
            found[at : at + BLOCK] = range_search(x, graph, np.arange(at, min(n, at + BLOCK)), least - 1e-9)
        found |= found.T
        return _counted(part, raw, *np.nonzero(np.triu(found, 1)), least)

    return links


def _compare(least: float):
    """Links of a unit by all its products: the exact way, where searches don't reach the recall asked for."""

    def links(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("rid", ignore_index=True)
        raw = _matrix(part["embedding"])
        x, a, b = unit(raw), [], []
        for at in range(0, len(x), BLOCK):
            i, j = np.nonzero(np.triu(x[at : at + BLOCK] @ x.T >= least - 1e-9, at + 1))
            a.append(i + at)
            b.append(j)
        return _counted(part, raw, np.concatenate(a), np.concatenate(b), least)

    return links


def _counted(part: pd.DataFrame, raw: np.ndarray, a: np.ndarray, b: np.ndarray, least: float) -> pd.DataFrame:
    """(rid, links, peers, root) of a unit's vectors from candidate pairs, each verified. A pair counts in the first shard
    that both ends share; links counts all copies of a vector, peers distinct vectors."""
    n, ids, norm, ok = len(part), part["rid"].to_numpy(np.int64), np.linalg.norm(raw, axis=1), np.zeros(len(a), bool)
    for k in range(0, len(a), 1 << 16):
        i, j = a[k : k + (1 << 16)], b[k : k + (1 << 16)]
        ok[k : k + (1 << 16)] = np.einsum("id,id->i", raw[i], raw[j]) / (norm[i] * norm[j]) >= least
    a, b = a[ok], b[ok]
    forest = Forest(n)
    forest.join(a, b)
    shard, g, lo, hi = part["shard"].iloc[0], part["g"].to_numpy(), part["lo"].iloc[0], part["hi"].iloc[0]
    own = (g[a] != g[b]) if lo != hi else np.ones(len(a), bool)
    kinds, kind = np.unique([",".join(map(str, sorted(s))) for s in part["shards"]], return_inverse=True)
    sets = [set(map(int, k.split(","))) for k in kinds]
    first = np.array([[min(s & t, default=-1) for t in sets] for s in sets])
    own &= first[kind[a], kind[b]] == shard
    times, links = part["times"].to_numpy(np.int64), np.zeros(n, np.int64)
    np.add.at(links, a[own], times[b[own]])
    np.add.at(links, b[own], times[a[own]])
    peers = np.bincount(a[own], minlength=n) + np.bincount(b[own], minlength=n)
    return pd.DataFrame({"rid": ids, "links": links, "peers": peers, "root": ids[forest.label]})


def _shards(reps: DataFrame, overlap: int) -> DataFrame:
    """reps with shards (array<long>): the nearest `overlap` cluster shards of the label. Labels too small to be split
    are one shard; the others have centroids, fitted on a bounded sample, that go out to all tasks (bounded too)."""
    spark = reps.sparkSession
    sizes = reps.groupBy("label").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > SHARD_ROWS)
    large = {r["label"]: r["n"] for r in sizes.orderBy(F.desc("n"), "label").limit(MOST_CENTROIDS // 2).collect()}
    if not large:
        return reps.withColumn("shards", F.array(F.xxhash64("label")))
    total = sum(large.values())
    share = min(1.0, SAMPLE_ROWS / total)
    named = reps.where(F.col("label").isin(list(large))) if len(large) < 1000 else reps
    chosen = named.where(F.pmod(F.xxhash64(F.lit(11), "rid"), F.lit(1 << 20)) < max(1, int(share * (1 << 20))))
    sample = chosen.select("label", "embedding").limit(2 * SAMPLE_ROWS).toPandas()
    fitted = {}
    for label, part in sample.groupby("label"):
        if label in large:
            k = max(2, min(-(-large[label] // SHARD_ROWS), MOST_CENTROIDS * large[label] // total))
            fitted[label] = centroids(unit(_matrix(part["embedding"])), k)
    sent = spark.sparkContext.broadcast(fitted)

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = b["base"].map(lambda h: [h]).to_numpy(object)
            for label, rows in b.groupby("label").groups.items():
                c = sent.value.get(label)
                if c is not None:
                    at = b.index.get_indexer(rows)
                    s = unit(_matrix(b["embedding"].iloc[at])) @ c.T
                    for i, top in zip(at, np.argsort(-s, axis=1, kind="stable")[:, :overlap], strict=True):
                        out[i] = [(int(b["base"].iloc[i]) & ~0xFFFFFF) | int(t) for t in top]
            yield b.drop(columns="base").assign(shards=out)

    kinds = ", ".join(f"{c} {t}" for c, t in reps.dtypes)
    return reps.withColumn("base", F.xxhash64("label")).mapInPandas(near, f"{kinds}, shards array<long>")


def _units(reps: DataFrame) -> DataFrame:
    """A row for each unit that a vector belongs to: (shard, lo, hi) with the vector's group g. A shard with over
    UNIT_ROWS vectors has groups by hash, and a unit for each pair of groups, so every pair meets in a bounded unit."""
    rows = reps.withColumn("shard", F.explode("shards"))
    big = rows.groupBy("label", "shard").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > UNIT_ROWS)
    big = big.select("label", "shard", F.ceil(F.col("n") / (UNIT_ROWS // 2 - 256)).cast("int").alias("groups"))
    rows = rows.join(big, ["label", "shard"], "left").withColumn("groups", F.coalesce("groups", F.lit(1)))
    rows = rows.withColumn("g", F.pmod(F.xxhash64(F.lit(13), "rid"), F.col("groups")).cast("int"))
    rows = rows.withColumn("mate", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))
    return rows.select("rid", "label", "embedding", "times", "shards", "shard", "g", F.least("g", "mate").alias("lo"), F.greatest("g", "mate").alias("hi"))


_FOUND = "rid long, links long, peers long, root long"


def _linked(reps: DataFrame, least: float, overlap: int) -> DataFrame:
    sharded = written(_shards(reps, overlap), "vector-shards")
    units = written(_units(sharded), "vector-units")
    key = ["label", "shard", "lo", "hi"]
    built = written(units.groupBy(*key).applyInPandas(_build, "rid long, near array<long>"), "vector-graph")
    union = built.groupBy("rid").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))
    found = written(units.join(union, "rid").groupBy(*key).applyInPandas(_search(least), _FOUND), "vector-links")
    forgotten(sharded, units, built)
    return found


def _compared(reps: DataFrame, least: float) -> DataFrame:
    """As _linked, with every pair of vectors of a label compared, in units of bounded size."""
    units = _units(reps.withColumn("shards", F.array(F.xxhash64("label"))))
    return written(units.groupBy("label", "shard", "lo", "hi").applyInPandas(_compare(least), _FOUND), "vector-links")


def _audit(reps: DataFrame, counted: DataFrame, least: float) -> float:
    """The recall of a bounded sample of vectors by brute force against all: the share of its distinct neighbours that a vector
    has found, as a mean over vectors, so that a group of many copies counts no more than another. Half of the sample are
    any vectors; the other half have found few neighbours, or none, where losses would show. The worse mean counts."""
    pool, recalls = reps.join(counted, "rid"), []
    for few in (False, True):
        some = pool.where(F.col("peers") <= FEW) if few else pool
        chosen = some.orderBy(F.xxhash64(F.lit(17), "rid"), "rid").limit(AUDIT).select("rid", "label", "embedding", "peers").toPandas()
        if len(chosen):
            recalls.append(_recall(reps, chosen, least))
    return min(recalls, default=1.0)


def _recall(reps: DataFrame, chosen: pd.DataFrame, least: float) -> float:
    raw, labels, ids = _matrix(chosen["embedding"]), chosen["label"].to_numpy(), chosen["rid"].to_numpy()
    norm = np.linalg.norm(raw, axis=1)

    def truth(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros(len(ids), np.int64)
        for b in batches:
            for label, rows in b.groupby("label"):  # vectors of a label have one length
                mine = np.flatnonzero(labels == label)
                if len(mine):
                    y = _matrix(rows["embedding"])
                    c = (raw[mine] @ y.T) / (norm[mine][:, None] * np.linalg.norm(y, axis=1)[None])
                    c[ids[mine][:, None] == rows["rid"].to_numpy()[None]] = -9
                    sums[mine] += (c >= least).sum(axis=1)
        yield pd.DataFrame({"i": np.arange(len(ids)), "n": sums})

    true = reps.mapInPandas(truth, "i int, n long").groupBy("i").agg(F.sum("n").alias("n")).toPandas().set_index("i")["n"]
    true = true.reindex(range(len(ids))).fillna(0).to_numpy()
    on = true > 0
    return float(np.minimum(1, chosen["peers"].to_numpy()[on] / true[on]).mean()) if on.any() else 1.0


def near_duplicate_vectors(rows: DataFrame, least: float = COSINE, key: str = "vec_id", label: str = "label", vector: str = "embedding") -> DataFrame:
    """(key, n_links, component_id, kept, audit_recall) for each row of rows.

    Only vectors of equal, non-null labels are compared, by cosine in double precision; every reported link is verified.
    Vectors that are null, zero, of another length than the label's others, or hold null or non-finite components link
    with nothing, nor do rows with a null key (component null, kept false). Equal vectors of a label are one vertex
    with a multiplicity. Rows that repeat a key are vertices of their own unless their vectors are equal. An empty table gives an empty table.

    Graphs are built on overlapping cluster shards, a vector's adjacency lists are united over its shards, and every
    vector is searched for in each of its shards over the united lists. A link is counted in the first shard that both
    ends share. audit_recall is measured by brute force for a bounded sample of queries; below LEAST_RECALL the
    graphs are made again with more overlap, and where the most overlap does not do, all pairs of a label are compared."""
    tune(rows.sparkSession)
    v = F.col(f"`{vector}`")
    fine = F.col(f"`{key}`").isNotNull() & F.col(f"`{label}`").isNotNull() & v.isNotNull() & (F.size(v) > 0)
    fine &= F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists(v, lambda e: e != 0)
    base = rows.select(F.col(f"`{key}`").alias("id"), F.col(f"`{label}`").alias("label"), v.cast("array<double>").alias("embedding"), F.coalesce(fine, F.lit(False)).alias("fine"))
    base = written(base, "vectors")
    good = base.where("fine")
    classes = good.groupBy("label", "embedding").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("times"))
    classes = written(classes.withColumn("rid", F.monotonically_increasing_id()), "vector-classes")  # numbers stand once written
    reps = classes.select("rid", F.concat_ws(" ", F.size("embedding"), F.col("label").cast("string")).alias("label"), "embedding", "times")
    overlap = OVERLAP
    while True:
        found = _linked(reps, least, overlap) if overlap <= MOST_OVERLAP else _compared(reps, least)
        counted = written(found.groupBy("rid").agg(F.sum("links").alias("links"), F.sum("peers").alias("peers")), "vector-counts")
        recall = _audit(reps, counted, least)
        if recall >= LEAST_RECALL or overlap > MOST_OVERLAP:
            break
        forgotten(found, counted)
        overlap += 1
    parts = connected_components(found.select(F.col("rid").alias("u"), F.col("root").alias("v")))
    of = counted.join(parts.withColumnRenamed("node", "rid"), "rid", "left").select("rid", "links", F.coalesce("component", "rid").alias("component"))
    of = classes.join(of, "rid")
    names = of.groupBy("component").agg(F.min("least").alias("component_id"))
    known = good.join(of.join(names, "component").drop("least"), ["label", "embedding"])
    whole = known.select("id", (F.col("links") + F.col("times") - 1).alias("n_links"), "component_id", (F.col("id") == F.col("component_id")).alias("kept"))
    other = base.where("not fine").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.col("id").isNotNull().alias("kept"))
    return whole.union(other).withColumn("audit_recall", F.lit(recall)).withColumnRenamed("id", key)


def op2_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each vector. Vectors that link with nothing (null, zero, not finite, without a label) are their own
    component; repeated ids stay separate rows; no vectors give no rows."""
    return fewer(near_duplicate_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))
