"""Column functions on HTML and on JSON that models write."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from listwright.functions.titles import digits_only, first_number, once, price

LD_BODY = r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>"


def tag_text(html: Column, tag: str) -> Column:
    """F-11: the text of the first element of a tag, without inner tags; null if there is none or it is blank."""
    inner = F.regexp_extract(html, rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}\s*>", 1)
    return F.nullif(F.trim(F.regexp_replace(F.regexp_replace(inner, "<[^>]*>", ""), r"\s+", " ")), F.lit(""))


def attribute(html: Column, tag: str, name: str, where: str = "") -> Column:
    """F-11: an attribute of the first element of a tag whose start tag matches `where`."""
    return F.nullif(F.regexp_extract(html, rf"(?is)<{tag}\b(?=[^>]*{where})[^>]*\b{name}\s*=\s*[\"']([^\"']*)[\"']", 1), F.lit(""))


def links(html: Column, containing: str = "") -> Column:
    """S-05: the distinct hrefs of a page that contain a text, in order."""
    found = F.regexp_extract_all(html, F.lit(r"(?is)<a\b[^>]*\bhref\s*=\s*[\"']([^\"']*)[\"']"), F.lit(1))
    return F.array_distinct(F.filter(found, lambda h: (h != "") & h.contains(containing)))


def without_query(url: Column) -> Column:
    """F-15."""
    return F.regexp_replace(url, r"\?.*", "")


def absolute(url: Column, base: str) -> Column:
    """F-15: a URL, or a path below a site."""
    return F.when(url.startswith("http"), url).otherwise(F.concat(F.lit(base), url))


def listing_number(url: Column) -> Column:
    """F-13: the first run of six digits or more behind a slash, else the URL itself."""
    return F.coalesce(F.nullif(F.regexp_extract(url, r"/(\d{6,})", 1), F.lit("")), url)


def json_ld(html: Column, kind: str) -> Column:
    """F-10: the first JSON-LD object of a type, as JSON text: a body, an element of a list, or one of @graph.

    Bodies that are no JSON are skipped."""
    bodies = F.regexp_extract_all(html, F.lit(LD_BODY), F.lit(1))
    parse = lambda s: F.from_json(s, "array<string>")
    items = F.flatten(F.transform(bodies, lambda b: F.coalesce(
        F.when(F.ltrim(b).startswith("["), parse(b)), parse(F.get_json_object(b, "$.@graph")), F.array(F.get_json_object(b, "$")))))
    named = F.filter(items, lambda x: (F.get_json_object(x, "$.@type") == kind) | F.coalesce(F.array_contains(parse(F.get_json_object(x, "$.@type")), kind), F.lit(False)))
    return F.get(named, F.lit(0))


# Fixed value: the pattern of a marketplace's image URLs.
IMAGE_URL = r"(?i)(https://ih\d+\.redbubble\.net/image\.[^\"'\s\\]+?\.(?:jpg|jpeg|png|webp))"


def image_id(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, r"/image\.([0-9.]+)/", 1), F.lit(""))


def variant_rank(url: Column) -> Column:
    """W-09: flat artwork first, tilted mock-ups last; jpg before the rest."""
    low = F.lower(url)
    kind = F.when(low.contains("/flat,"), 0).when(low.contains("/papergc,"), 2).otherwise(1)
    return F.struct(kind.alias("kind"), F.when(low.rlike(r"\.jpe?g$"), 0).otherwise(1).alias("ext"))


def cover_first(urls: Column) -> Column:
    """F-14: distinct URLs, the best variants first, otherwise in order."""
    ranked = F.transform(F.array_distinct(urls), lambda u, i: F.struct(variant_rank(u).alias("r"), i.alias("i"), u.alias("u")))
    return F.transform(F.array_sort(ranked), lambda x: x["u"])


def best_variants(html: Column) -> Column:
    """F-14: a page's image URLs, the best variant of each artwork, in order of first sight."""
    named = lambda u, i: F.struct(image_id(u).alias("id"), i.alias("i"), variant_rank(u).alias("r"), u.alias("u"))
    found = F.filter(F.transform(F.array_distinct(F.regexp_extract_all(html, F.lit(IMAGE_URL), F.lit(1))), named), lambda x: x["id"].isNotNull())
    first = lambda rows: once(F.array_sort(rows), lambda s: F.filter(s, lambda x, i: (i == 0) | (F.get(s, i - 1)["id"] != x["id"])))
    by_rank = lambda x: F.struct(x["id"].alias("id"), x["r"].alias("r"), x["i"].alias("i"), x["u"].alias("u"))
    pairs = lambda x: F.zip_with(first(x), first(F.transform(x, by_rank)), lambda a, b: F.struct(a["i"].alias("i"), b["u"].alias("u")))
    return once(found, lambda x: F.transform(F.array_sort(pairs(x)), lambda y: y["u"]))  # both sides are in order of id


def listing(html: Column, url: Column) -> Column:
    """F-12: a listing's fields, each from JSON-LD or else from the page."""
    return once(json_ld(html, "Product"), lambda ld: _listing(html, url, ld))


def _listing(html: Column, url: Column, ld: Column) -> Column:
    of = lambda path: F.get_json_object(ld, path)
    shown = price(F.regexp_extract(html, r"(?is)<[^>]*(?:data-testid=[\"']product-price[\"']|class=[\"']price[\"'])[^>]*>(.*?)<", 1))
    said = F.bround(F.coalesce(of("$.offers.price"), of("$.offers[0].price")).try_cast("double") * 100).cast("int")
    seller = F.coalesce(of("$.brand.name"), of("$.seller.name"), F.nullif(F.regexp_extract(html, r"/people/([^/?#\"']+)", 1), F.lit("")))
    return F.struct(
        listing_number(url).alias("source_listing_id"), url.alias("url"),
        F.coalesce(of("$.name"), tag_text(html, "h1")).alias("title"),
        F.coalesce(of("$.description"), F.nullif(F.trim(F.regexp_extract(html, r"(?is)data-testid=[\"']work-description[\"'][^>]*>(.*?)<", 1)), F.lit(""))).alias("description"),
        seller.alias("seller_id"), F.coalesce(said, shown["price_minor_units"]).alias("price_minor_units"),
        F.when(said.isNotNull(), F.upper(F.coalesce(of("$.offers.priceCurrency"), of("$.offers[0].priceCurrency")))).otherwise(shown["currency"]).alias("currency"),
        digits_only(F.coalesce(of("$.aggregateRating.reviewCount"), of("$.aggregateRating.ratingCount"))).alias("review_count"),
        first_number(of("$.aggregateRating.ratingValue")).alias("review_avg"), cover_first(best_variants(html)).alias("image_urls"),
    )


def repaired_json(text: Column) -> Column:
    """F-27: the outermost object of a model's answer as VARIANT: as written, or with control signs escaped, or with
    single quotes as double ones; null if none of these is JSON."""
    body = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    escaped = F.regexp_replace(F.replace(F.replace(F.replace(body, F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r")), F.lit("\t"), F.lit("\\t")), r"[\x00-\x1f]", "")
    quoted = F.regexp_replace(escaped, r"(?<!\\)'", '"')
    return F.when(body != "", F.coalesce(F.try_parse_json(body), F.try_parse_json(escaped), F.try_parse_json(quoted)))


def has_key(doc: Column, key: str) -> Column:
    """P-09: whether a JSON object has a key, be its value null."""
    return F.coalesce(F.array_contains(F.json_object_keys(doc), key), F.lit(False))


def json_path(doc: Column, *paths: str) -> Column:
    """P-10: the text at the first path that has one."""
    return F.coalesce(*[F.get_json_object(doc, p) for p in paths])


def is_json_null(doc: Column) -> Column:
    """P-11: the JSON value null, as against SQL's."""
    return F.coalesce(F.is_variant_null(F.try_parse_json(doc)), F.lit(False))
