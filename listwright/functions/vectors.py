"""Column functions on arrays of numbers, bit hashes and identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

OID_NAMESPACE = "6ba7b8129dad11d180b400c04fd430c8"


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda x, y: x + y)


def dot(a: Column, b: Column) -> Column:
    """F-21: the dot product, in double precision."""
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """F-21: null for a vector of length zero."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def unit(a: Column) -> Column:
    n = norm(a)
    return F.transform(a, lambda x: x / n)


def mean_of(vectors: list[Column]) -> Column:
    """M-29: the element-wise mean of vectors of one length, scaled to length one."""
    sums = vectors[0]
    for v in vectors[1:]:
        sums = F.zip_with(sums, v, lambda x, y: x + y)
    return unit(F.transform(sums, lambda x: x / len(vectors)))


def pmf(similarities: Column, epsilon: float = 0.0) -> Column:
    """F-18: similarities less their least one, as shares; epsilon goes to the first least; all equal: uniform."""
    low = F.array_min(similarities)
    first = F.array_position(similarities, low) - 1
    raised = F.transform(similarities, lambda x, i: x - low + F.when(i == first, epsilon).otherwise(0.0))
    s = total(raised)
    return F.when(s == 0, F.transform(similarities, lambda x: F.lit(1.0) / F.size(similarities))).otherwise(F.transform(raised, lambda x: x / s))


def sharpened(shares: Column, temperature: float) -> Column:
    """F-19: shares to the power 1/temperature; as they are at 1, one-hot at 0."""
    if temperature == 1.0:
        return shares
    if temperature == 0.0:
        top = F.array_position(shares, F.array_max(shares)) - 1
        return F.transform(shares, lambda x, i: F.when(i == top, 1.0).otherwise(0.0))
    powered = F.transform(shares, lambda x: F.pow(x, 1.0 / temperature))
    return F.transform(powered, lambda x: x / total(powered))


def expectation(shares: Column) -> Column:
    """The mean of 1..n under shares."""
    return total(F.transform(shares, lambda x, i: x * (i + 1)))


def hamming(a: Column, b: Column) -> Column:
    """F-22."""
    return F.bit_count(a.bitwiseXOR(b))


def top_byte(h: Column) -> Column:
    """F-23: the highest eight bits, unsigned."""
    return F.shiftrightunsigned(h, 56)


def from_bits(bits: Column) -> Column:
    """F-24: a text of 64 signs 0 and 1 as a signed long."""
    return F.conv(bits, 2, -10).cast("long")


def to_bits(h: Column) -> Column:
    """F-24: the other way."""
    return F.lpad(F.bin(h), 64, "0")


def uuid5(name: Column, namespace: str = OID_NAMESPACE) -> Column:
    """F-25: the name-based identifier of a text."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def content_path(data: Column, prefix: str = "images") -> Column:
    """F-26, K-15: the sharded path of a blob by its digest."""
    d = F.sha2(data, 256)
    return F.concat_ws("/", F.lit(prefix), F.substring(d, 1, 2), F.substring(d, 3, 2), d)


def url_key(url: Column) -> Column:
    """S-04: the cache key of a URL."""
    return F.sha2(F.encode(url, "UTF-8"), 256)


def luminance(r: Column, g: Column, b: Column) -> Column:
    """F-41: the lightness L* of an sRGB colour of 0..255."""
    lin = lambda c: F.when(c / 255 <= 0.04045, c / 255 / 12.92).otherwise(F.pow((c / 255 + 0.055) / 1.055, 2.4))
    y = 0.2126 * lin(r) + 0.7152 * lin(g) + 0.0722 * lin(b)
    return F.when(y > 216 / 24389, 116 * F.pow(y, 1 / 3) - 16).otherwise(y * 24389 / 27)


def text_colour(lightness: Column, dark: float = 55.0) -> Column:
    """F-41: light text on a dark ground."""
    return F.when(lightness < dark, "white").otherwise("black")


def capped_size(w: Column, h: Column, longest: int = 1030) -> Column:
    """F-42: width and height with the longer edge capped, halves to even."""
    long = F.greatest(w, h)
    by = F.when(long > longest, F.lit(float(longest)) / long).otherwise(F.lit(1.0))
    return F.struct(F.bround(w * by).cast("int").alias("width"), F.bround(h * by).cast("int").alias("height"))


def mask_box(region: Column, w: Column, h: Column, depth: float = 0.3, inset: float = 0.1) -> Column:
    """F-40: the box (x0, y0, x1, y1) of a headline region: a band at the top, the bottom or the middle."""
    y0 = F.when(region == "top", 0.0).when(region == "bottom", 1 - depth).otherwise((1 - depth) / 2)
    return F.struct(
        F.floor(w * inset).cast("int").alias("x0"), F.floor(h * y0).cast("int").alias("y0"),
        F.floor(w * (1 - inset)).cast("int").alias("x1"), F.floor(h * (y0 + depth)).cast("int").alias("y1"),
    )
