"""Operator 5: language identification by error-correcting output codes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from listwright.llm.common import fewer, free_name, tune

#: Hashed n-gram features (a power of two), the longest n, and the bound on labelled rows per language that are learned from.
FEATURE_BITS, LONGEST, TRAIN_ROWS = 15, 3, 1500
#: Letters that are handled at once; longer texts go in pieces, without loss at the seams.
PIECE = 1 << 20
#: Documents whose two nearest codewords are closer than this, on the score's scale, are ambiguous.
AMBIGUOUS = 0.1
SHARPNESS, SMOOTH = 6.0, 0.5
UNKNOWN = "und"
_MIX = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def pieces(text: str) -> Iterator[tuple[np.ndarray, int]]:
    """Lower-cased code points with runs of other signs as one space, and how many of them start an n-gram."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    letter = _letters()[points]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    points = np.where(letter, points, np.uint32(32))[keep]
    for at in range(0, len(points), PIECE):
        yield points[at : at + PIECE + LONGEST - 1], min(PIECE, len(points) - at)


def features(points: np.ndarray, starts: int) -> np.ndarray:
    """Feature numbers of all n-grams of 1..LONGEST that begin in the first `starts` places."""
    shift, out = np.uint32(32 - FEATURE_BITS), []
    h = np.zeros(len(points), np.uint32)
    for n in range(LONGEST):
        h = (h[: len(points) - n] if n else h) * _MIX[0]
        h = (h ^ (points[n:] * _MIX[1])) * _MIX[2]
        out.append(((h ^ (h >> np.uint32(15))) * _MIX[0] >> shift)[:starts])
    return np.concatenate(out)


@dataclass
class Model:
    """names: the learned languages; code: their words of +1 and -1; weight: a column of log-odds for each bit."""

    names: list[str]
    code: np.ndarray
    weight: np.ndarray
    trust: np.ndarray


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """n words of +1 and -1. Up to 7 classes: all splits into two (the exhaustive code); beyond: random words that keep
    their distance, 15 bits for each doubling of n."""
    if n < 2:
        return np.ones((n, 1))
    if n <= 7:
        return np.array([[1.0 if not c else (1.0 if k >> (c - 1) & 1 else -1.0) for k in range(2 ** (n - 1) - 1)] for c in range(n)])
    rng, bits, best = np.random.default_rng(seed), 15 * int(np.ceil(np.log2(n))), None
    for _ in range(50):
        code = rng.choice([-1.0, 1.0], (n, bits))
        apart = (bits - code @ code.T) / 2
        np.fill_diagonal(apart, bits)
        mixed = (np.abs(code.sum(axis=0)) < n).all()
        if mixed and (best is None or apart.min() > best[0]):
            best = (apart.min(), code)
    return best[1] if best else code


def fit(counts: dict[str, np.ndarray]) -> Model:
    """Binary classifiers from n-gram counts of each language: naive Bayes between the languages on either side of a
    bit, each language counting alike. A language's trust in a bit is how clearly its n-grams decide it."""
    names = sorted(counts)
    code = codewords(len(names))
    if not names:
        return Model([], code, np.zeros((1 << FEATURE_BITS, 0), np.float32), code)
    p = np.stack([counts[x] + SMOOTH for x in names]).astype(float)
    p /= p.sum(axis=1, keepdims=True)
    columns = []
    for bit in code.T:
        if len(names) < 2:
            columns.append(np.zeros(p.shape[1]))
        else:
            columns.append(np.log(p[bit > 0].mean(axis=0)) - np.log(p[bit < 0].mean(axis=0)))
    weight = np.stack(columns, axis=1)
    clear = (p @ weight) * code
    gain = 1 / np.maximum(np.abs(clear).mean(axis=0), 1e-9)
    trust = np.clip(clear * gain, 0.05, 1.0)
    return Model(names, code, (weight * gain).astype(np.float32), trust / trust.sum(axis=1, keepdims=True))


def decode(model: Model, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For rows of margins: the nearest codeword under exponential loss weighted by trust, its score, and the gap."""
    loss = np.einsum("cb,rcb->rc", model.trust, np.exp(-model.code[None] * np.clip(margins, -2, 2)[:, None, :]))
    weight = np.exp(-SHARPNESS * (loss - loss.min(axis=1, keepdims=True)))
    share = weight / weight.sum(axis=1, keepdims=True)
    best = share.argmax(axis=1)
    top = np.sort(share, axis=1)
    return best, top[:, -1], top[:, -1] - (top[:, -2] if share.shape[1] > 1 else 0.0)


def learn(docs: DataFrame, text: str, lang: str, seed: Column, most: int = TRAIN_ROWS) -> Model:
    """Fit on up to about `most` rows of each language (a seeded choice by hash; whole texts). Only languages' names and
    a table of 2^FEATURE_BITS counts for each of them come to the driver."""
    docs = docs.select(F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").cast("string").alias("lang"), seed.alias("h")).where("text is not null and lang is not null")
    sizes = {r["lang"]: r["n"] for r in docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return fit({})
    scale = 1 << 20
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, max(1, min(scale, scale * most // n)))])
    chosen = docs.where(F.pmod(F.col("h"), F.lit(scale)) < share[F.col("lang")]).select("text", "lang")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for x, k in zip(b["text"], b["lang"], strict=True):
                mine = sums.setdefault(k, np.zeros(1 << FEATURE_BITS, np.int64))
                for points, starts in pieces(x):
                    mine += np.bincount(features(points, starts), minlength=1 << FEATURE_BITS)
        for k, v in sums.items():
            at = np.flatnonzero(v)
            yield pd.DataFrame({"lang": k, "f": at.astype(np.int32), "n": v[at]})

    found = chosen.mapInPandas(count, "lang string, f int, n long").groupBy("lang", "f").agg(F.sum("n").alias("n")).toPandas()
    counts = {k: np.zeros(1 << FEATURE_BITS, np.int64) for k in sizes}
    for k, part in found.groupby("lang"):
        counts[k][part["f"].to_numpy()] = part["n"].to_numpy()
    return fit({k: v for k, v in counts.items() if v.any()})


def margins(model: Model, text: str) -> np.ndarray | None:
    """Mean weight of a whole text's n-grams for each bit; None without a letter."""
    total, n = np.zeros(model.weight.shape[1]), 0
    for points, starts in pieces(text):
        f = features(points, starts)
        if len(f) < 4096:
            total += model.weight[f].sum(axis=0, dtype=float)
        else:
            total += np.bincount(f, minlength=len(model.weight)) @ model.weight
        n += len(f)
    return total / n if n else None


def identified(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with lang_pred, score (0 to 1) and ambiguous. Null texts and texts without a letter are `und`, with score 0,
    as is everything if no language was learned. Input columns with those names are replaced."""
    tune(docs.sparkSession)
    kept = [c for c in docs.columns if c.lower() not in ("lang_pred", "score", "ambiguous")]

    @F.pandas_udf("lang_pred string, score double, ambiguous boolean")
    def predict(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            got = [margins(model, x) if isinstance(x, str) and model.names else None for x in batch]
            out = pd.DataFrame({"lang_pred": [UNKNOWN] * len(got), "score": 0.0, "ambiguous": False})
            on = [i for i, x in enumerate(got) if x is not None]
            if on:
                best, score, gap = decode(model, np.stack([got[i] for i in on]))
                out.loc[on, "lang_pred"] = [model.names[i] for i in best]
                out.loc[on, "score"] = score
                out.loc[on, "ambiguous"] = gap < AMBIGUOUS
            yield out

    once = predict.asNondeterministic()  # else a filter on the prediction would have it made twice
    told = free_name(docs, "told")
    seen = docs.select(*[F.col(f"`{c}`") for c in kept], once(F.col(f"`{text}`")).alias(told))
    return seen.select(*[F.col(f"`{c}`") for c in kept], f"{told}.*")


def _remainder(key: str) -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))), F.lit(5))


def trained(docs: DataFrame) -> Model:
    """The model of documents: learned from rows whose crc32 of doc_id leaves a remainder of 1 to 4 by 5. A null doc_id
    counts as the empty text, whose remainder is 0: such rows are not learned from."""
    return learn(docs.where(_remainder("doc_id") != 0), "text", "lang", F.xxhash64(F.lit(5), "doc_id"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document: null texts and texts without a letter are `und` with score 0; repeated ids stay separate
    rows; a null id counts as held out; no documents give no rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    found = identified(docs.withColumn("held_out", _remainder("doc_id") == 0), trained(docs))
    return fewer(found.select("doc_id", "held_out", "lang_pred", "score", "ambiguous"))
