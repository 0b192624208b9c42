"""Model columns: splits, targets, ridge by closed form, stored networks, calibration, images."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from listwright.operators.ranking import md5_order, summed_before

DIMS = ("occasion_fit", "aesthetic", "emotional_resonance", "distinctiveness", "purchase_intent")
ALPHAS = tuple(float(a) for a in np.logspace(-3, 4, 22))


def group_split(df: DataFrame, group: str, key: str, train: float = 0.7, val: float = 0.15, seed: str = "42") -> DataFrame:
    """M-01: side (train, val or test) such that no group is on two sides; a null group is its row's own. Shares are of
    groups, rounded down; the order of groups depends on their names and the seed alone."""
    named = df.withColumn("__g", F.coalesce(F.col(group).cast("string"), F.concat(F.lit("__null_"), F.col(key).cast("string"))))
    groups = named.select("__g").distinct().withColumn("__h", md5_order(seed, F.col("__g")))
    groups = summed_before(groups, [F.col("__h"), F.col("__g")], F.lit(1), "__turn")
    groups = groups.crossJoin(F.broadcast(groups.agg(F.count(F.lit(1)).alias("__n"))))  # one row
    a, b = F.expr(f"floor(__n * {train}D)"), F.expr(f"floor(__n * {train}D) + floor(__n * {val}D)")
    sides = groups.select("__g", F.when(F.col("__turn") < a, "train").when(F.col("__turn") < b, "val").otherwise("test").alias("side"))
    return named.join(sides, "__g").drop("__g")


def targets(raw: Column, dims: tuple[str, ...] = DIMS) -> Column:
    """M-02: the dims of a JSON text, clamped to 0..1; null where one is missing (masked)."""
    of = lambda d: F.get_json_object(raw, f"$.{d}").try_cast("double")
    return F.struct(*[F.when(of(d).isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), of(d)))).alias(d) for d in dims])


def inverse_frequency(by: str) -> Column:
    """M-03: sampling weights that make all groups alike."""
    return 1 / F.count(F.lit(1)).over(Window.partitionBy(by))


def weighted_error(prediction: str, target: str, weight: str) -> Column:
    """A-21: masked, weighted mean square error; an aggregate."""
    w = F.when(F.col(target).isNotNull(), F.col(weight)).otherwise(0.0)
    return F.sum(w * F.pow(F.col(prediction) - F.coalesce(target, F.lit(0.0)), 2)) / F.greatest(F.sum(w), F.lit(1e-12))


class Gram:
    """Sums of products of centred-later columns: what ridge needs of any number of rows."""

    def __init__(self, d: int):
        self.n, self.xx, self.xy, self.x, self.y, self.yy = 0, np.zeros((d, d)), np.zeros(d), np.zeros(d), 0.0, 0.0


def gram(df: DataFrame, features: str, target: str) -> Gram:
    """One pass over all rows: each task sums its rows' products, and tasks' sums are added up pairwise. A sum is
    (d + 2)^2 numbers for d features, whatever the rows."""
    rows = df.where(F.col(target).isNotNull() & F.col(features).isNotNull()).select(F.col(features).alias("x"), F.col(target).cast("double").alias("y"))

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for b in batches:
            if len(b):
                m = np.column_stack((np.ones(len(b)), np.stack(b["x"].to_numpy()).astype(float), b["y"].to_numpy(float)))
                total = m.T @ m if total is None else total + m.T @ m
        if total is not None:
            yield pd.DataFrame({"i": np.arange(total.size), "s": total.ravel()})

    sums = rows.mapInPandas(part, "i long, s double").groupBy("i").agg(F.sum("s").alias("s")).orderBy("i").toPandas()["s"].to_numpy()
    side = int(round(np.sqrt(len(sums))))
    g, m = Gram(max(0, side - 2)), sums.reshape(side, side)
    if side:
        g.n, g.x, g.y, g.xx, g.xy, g.yy = int(round(m[0, 0])), m[0, 1:-1], m[0, -1], m[1:-1, 1:-1], m[1:-1, -1], m[-1, -1]
    return g


def ridge_weights(g: Gram, alpha: float) -> tuple[np.ndarray, float]:
    """(coefficients, intercept) of least squares with an L2 penalty; the intercept is not penalised."""
    mx, my = g.x / g.n, g.y / g.n
    a = g.xx - g.n * np.outer(mx, mx)
    w = np.linalg.solve(a + alpha * np.eye(len(mx)), g.xy - g.n * mx * my)
    return w, float(my - mx @ w)


def ridge(df: DataFrame, features: str, target: str, alphas: tuple[float, ...] = ALPHAS) -> tuple[np.ndarray, float, float]:
    """M-04: (coefficients, intercept, alpha) with alpha of least leave-one-out error, two passes over the rows: one for the
    products, one that scores all alphas at once by the hat matrix' diagonal."""
    g = gram(df, features, target)
    mx, my = g.x / g.n, g.y / g.n
    values, vectors = np.linalg.eigh(g.xx - g.n * np.outer(mx, mx))
    values = np.maximum(values, 0)
    b = vectors.T @ (g.xy - g.n * mx * my)
    shrink = np.array([1 / np.maximum(values + a, 1e-300) for a in alphas])
    rows = df.where(F.col(target).isNotNull() & F.col(features).isNotNull()).select(F.col(features).alias("x"), F.col(target).cast("double").alias("y"))

    def errors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros(len(alphas))
        for c in batches:
            if len(c):
                z = (np.stack(c["x"].to_numpy()).astype(float) - mx) @ vectors
                e = c["y"].to_numpy(float)[:, None] - my - z @ (shrink * b).T
                sums += ((e / np.maximum(1 - 1 / g.n - (z * z) @ shrink.T, 1e-12)) ** 2).sum(axis=0)
        yield pd.DataFrame({"i": np.arange(len(alphas)), "e": sums})

    loo = rows.mapInPandas(errors, "i int, e double").groupBy("i").agg(F.sum("e").alias("e")).orderBy("i").toPandas()["e"].to_numpy()
    alpha = alphas[int(loo.argmin())]
    return *ridge_weights(g, alpha), alpha


def ridge_score(features: Column, weights: list[float], intercept: float) -> Column:
    """M-05: dot product, intercept, clipped to 0..1, in built-in functions."""
    w = F.array(*[F.lit(float(x)) for x in weights])
    s = F.aggregate(F.zip_with(features, w, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda a, b: a + b)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), s + intercept))


def network_scores(df: DataFrame, features: str, layers: list[tuple[np.ndarray, np.ndarray]], heads: dict[str, tuple[np.ndarray, np.ndarray]], mean: np.ndarray | None = None, sd: np.ndarray | None = None) -> DataFrame:
    """M-06: a stored perceptron's scores as a column for each head: z-scored inputs, ReLU layers, sigmoid heads."""

    @F.pandas_udf(", ".join(f"{h} double" for h in heads))
    def score(x: pd.Series) -> pd.DataFrame:
        a = np.stack(x.to_numpy()).astype(float) if len(x) else np.zeros((0, len(layers[0][0])))
        if mean is not None:
            a = (a - mean) / np.maximum(sd, 1e-6)
        for w, b in layers:
            a = np.maximum(a @ w + b, 0)
        return pd.DataFrame({h: 1 / (1 + np.exp(-(a @ w + b).ravel())) for h, (w, b) in heads.items()})

    return df.withColumn("scores", score(F.col(features)))


def feature_stats(df: DataFrame, features: str) -> DataFrame:
    """M-08: mean and sd (population, at least 1e-6) of each place of an array."""
    return df.select(F.posexplode(features).alias("i", "x")).groupBy("i").agg(F.avg("x").alias("mean"), F.greatest(F.stddev_pop("x"), F.lit(1e-6)).alias("sd"))


def isotonic(df: DataFrame, prediction: str, target: str) -> DataFrame:
    """M-09: df with calibrated, the isotonic fit of the target, clipped to 0..1."""
    from pyspark.ml.regression import IsotonicRegression

    model = IsotonicRegression(featuresCol=prediction, labelCol=target, predictionCol="__fit").fit(df)
    return model.transform(df).withColumn("calibrated", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("__fit")))).drop("__fit")


def tropes(df: DataFrame, features: str, headline: str, score: Column, k: int = 5, seeds: int = 4, shown: int = 3) -> DataFrame:
    """M-26: clusters of designs by k-means (the best of some seeds), each with its first headlines joined by a pipe."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    from listwright.operators.ranking import top_per

    rows = df.withColumn("__v", array_to_vector(F.col(features))).withColumn("__s", score)
    models = [KMeans(k=k, seed=s, featuresCol="__v", predictionCol="trope").fit(rows) for s in range(seeds)]
    best = min(models, key=lambda m: m.summary.trainingCost)
    sized = best.transform(rows)
    sizes = sized.groupBy("trope").agg(F.count(F.lit(1)).alias("n"))
    heads = top_per(sized, ["trope"], [F.desc("__s"), F.col(headline)], shown).groupBy("trope")
    return heads.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", headline))), lambda x: x[headline]), " | ").alias("headlines")).join(sizes, "trope")


# -- images as arrays: raw RGB bytes with width and height ---------------------------------------------------------------

IMAGE = "width int, height int, rgb binary"


def _grey(width: int, height: int, rgb: bytes) -> np.ndarray:
    x = np.frombuffer(rgb, np.uint8).reshape(height, width, 3).astype(float)
    return x @ np.array([0.299, 0.587, 0.114])


def _shrunk(x: np.ndarray, side: int) -> np.ndarray:
    """Means over a side x side grid of boxes."""
    rows = np.linspace(0, x.shape[0], side + 1).astype(int)
    cols = np.linspace(0, x.shape[1], side + 1).astype(int)
    return np.array([[x[a : max(b, a + 1), c : max(d, c + 1)].mean() for c, d in zip(cols, cols[1:], strict=False)] for a, b in zip(rows, rows[1:], strict=False)])


def _cosines(n: int) -> np.ndarray:
    k, i = np.arange(n)[:, None], np.arange(n)[None]
    return np.cos(np.pi * k * (2 * i + 1) / (2 * n))


def perceptual_hash(width: int, height: int, rgb: bytes) -> int:
    """D-01: 64 bits: low frequencies of a 32 x 32 picture against their median, as a signed number."""
    c = _cosines(32)
    low = (c @ _shrunk(_grey(width, height, rgb), 32) @ c.T)[:8, :8]
    bits = (low > np.median(low)).ravel()
    h = int("".join("1" if b else "0" for b in bits), 2)
    return h - (1 << 64) if h >> 63 else h


def complexity(width: int, height: int, rgb: bytes) -> float:
    """M-28: half edges (Sobel), half entropy of the spectrum, each against its cap."""
    x = _grey(width, height, rgb) / 255
    p = np.pad(x, 1, mode="edge")
    gx = (p[:-2, 2:] + 2 * p[1:-1, 2:] + p[2:, 2:]) - (p[:-2, :-2] + 2 * p[1:-1, :-2] + p[2:, :-2])
    gy = (p[2:, :-2] + 2 * p[2:, 1:-1] + p[2:, 2:]) - (p[:-2, :-2] + 2 * p[:-2, 1:-1] + p[:-2, 2:])
    edge = float(np.hypot(gx, gy).mean())
    power = np.abs(np.fft.fft2(x - x.mean())) ** 2
    share = power.ravel() / power.sum() if power.sum() > 0 else np.ones(1)
    entropy = float(-(share[share > 0] * np.log(share[share > 0])).sum())
    return 0.5 * min(1.0, edge / 0.25) + 0.5 * min(1.0, entropy / 5)


def lab(rgb: np.ndarray) -> np.ndarray:
    """CIE L*a*b* (D65) of rows of sRGB 0..255."""
    c = rgb / 255
    lin = np.where(c <= 0.04045, c / 12.92, ((c + 0.055) / 1.055) ** 2.4)
    xyz = lin @ np.array([[0.4124564, 0.2126729, 0.0193339], [0.3575761, 0.7151522, 0.1191920], [0.1804375, 0.0721750, 0.9503041]])
    t = xyz / np.array([0.95047, 1.0, 1.08883])
    f = np.where(t > 216 / 24389, np.cbrt(t), (t * 24389 / 27 + 16) / 116)
    return np.column_stack((116 * f[:, 1] - 16, 500 * (f[:, 0] - f[:, 1]), 200 * (f[:, 1] - f[:, 2])))


def palette(width: int, height: int, rgb: bytes, k: int = 5, sample: int = 20_000, seed: int = 0) -> list[dict]:
    """M-27: k colours of a sample of pixels by k-means in Lab, with weights, the heaviest first."""
    rng = np.random.default_rng(seed)
    x = np.frombuffer(rgb, np.uint8).reshape(-1, 3).astype(float)
    x = lab(x[rng.choice(len(x), sample, replace=False)] if len(x) > sample else x)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(20):
        near = ((x[:, None] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
        c = np.array([x[near == i].mean(axis=0) if (near == i).any() else c[i] for i in range(len(c))])
    share = np.bincount(near, minlength=len(c)) / len(x)
    order = np.lexsort((c[:, 0], -share))
    return [{"L": float(c[i, 0]), "a": float(c[i, 1]), "b": float(c[i, 2]), "weight": float(share[i])} for i in order]


def image_features(images: DataFrame, key: str) -> DataFrame:
    """(key, phash, complexity, palette) of images (key, width, height, rgb); a picture without pixels has nulls."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, w, h, rgb in zip(b[key], b["width"], b["height"], b["rgb"], strict=True):
                fine = rgb is not None and w and h and len(rgb) == 3 * w * h
                out.append((k, perceptual_hash(w, h, rgb), complexity(w, h, rgb), palette(w, h, rgb)) if fine else (k, None, None, None))
            yield pd.DataFrame(out, columns=[key, "phash", "complexity", "palette"]).astype({"phash": "Int64"})

    kind = images.schema[key].dataType.simpleString()
    return images.select(key, "width", "height", "rgb").mapInPandas(each, f"{key} {kind}, phash long, complexity double, palette array<struct<L:double,a:double,b:double,weight:double>>")
