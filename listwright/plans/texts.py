"""Queries of SURVEY 2.8: scalar functions over titles, pages, answers and vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from listwright.functions import titles as T
from listwright.functions import vectors as V
from listwright.functions import web
from listwright.plans.roles import MAKERS, framed
from listwright.sources import table

# DuckDB's side of the title rules: RE2 has no look-around, so word limits are written out.
AGES = """list_sort(list_distinct([CAST(x AS INT) FOR x IN list_concat(list_concat(regexp_extract_all(t, '\\b(\\d{1,3})(?:st|nd|rd|th)\\b', 1), regexp_extract_all(t, '\\bage\\s+(\\d{1,3})\\b', 1)),
    list_concat(regexp_extract_all(t, '\\b(\\d{1,3})\\s*(?:years?|yrs?)\\s*old\\b', 1), regexp_extract_all(t, '\\b(?:at|turning)\\s+(\\d{1,3})\\b', 1)))]))"""
KID = "len([a FOR a IN ages IF a <= 12]) > 0"
MILE = f"len([a FOR a IN ages IF list_contains([{', '.join(map(str, T.MILESTONE_AGES))}], a)]) > 0"
ADULT = "(len(ages) > 0 AND len([a FOR a IN ages IF a <= 12]) = 0)"
AGED = f"SELECT id, title, occasion, t, {AGES} AS ages FROM (SELECT id, title, occasion, lower(title) AS t FROM titles)"
LAW = "regexp_replace(lower(title), '\\b(son|daughter|mother|father|brother|sister)[\\s-]+in[\\s-]+law\\b', 'inlaw', 'g')"
HAS = lambda ws: f"regexp_matches(t, '(^|[^\\w])({'|'.join(ws)})($|[^\\w])')"
SIGNALS = f"SELECT id, occasion, {HAS(T.KID_WORDS)} AS kid_word, {KID} AS kid_age, {ADULT} AS adult_age, {MILE} AS milestone_age, {HAS(T.REL_WORDS)} AS rel_word FROM (SELECT *, {AGES} AS ages FROM (SELECT id, occasion, {LAW} AS t FROM titles))"


def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return MAKERS["titles"](spark, sf_dir)


@framed("f01_ages", f"SELECT id, array_to_string(ages, ',') AS ages FROM ({AGED})")
def f01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return titles(spark, sf_dir).select("id", F.array_join(T.ages(F.col("title")), ",").alias("ages"))


@framed("f02_occasion_from_age", f"SELECT id, CASE WHEN {KID} THEN 'birthday/kids' WHEN {MILE} THEN 'birthday/milestone' END AS by_age FROM ({AGED})")
def f02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return titles(spark, sf_dir).select("id", T.occasion_from_age(F.col("title")).alias("by_age"))


@framed("f03_ages_rule_out_kids", f"SELECT id, {ADULT} AS no_kid FROM ({AGED})")
def f03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return titles(spark, sf_dir).select("id", T.ages_rule_out_kids(F.col("title")).alias("no_kid"))


@framed("f04_final_occasion", f"""WITH c AS (SELECT *, coalesce(occasion, 'not_birthday') AS top, (id % 100) / 100 AS s, CASE WHEN {KID} THEN 'birthday/kids' WHEN {MILE} THEN 'birthday/milestone' END AS by_age, {ADULT} AS no_kid FROM ({AGED})),
    m AS (SELECT *, CASE WHEN by_age IS NOT NULL THEN by_age WHEN top = 'not_birthday' THEN CASE WHEN s >= 0.55 THEN NULL ELSE 'birthday/general' END WHEN s >= 0.55 THEN top ELSE 'birthday/general' END AS o FROM c)
    SELECT id, CASE WHEN o = 'birthday/kids' AND no_kid THEN 'birthday/general' ELSE o END AS occasion, CASE WHEN by_age IS NOT NULL THEN 1.0::DOUBLE ELSE s END AS confidence FROM m""")  # fmt: skip
def f04(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = T.final_occasion(F.col("title"), F.coalesce("occasion", F.lit(T.NOT_BIRTHDAY)), F.col("id") % 100 / 100)
    return titles(spark, sf_dir).select("id", got.alias("got")).select("id", "got.occasion", "got.confidence")


@framed("f05_whole_word", "SELECT id, regexp_matches(lower(title), '(^|[^\\w])kids($|[^\\w])') AS kids FROM titles")
def f05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return titles(spark, sf_dir).select("id", T.has_phrase(F.lower("title"), "kids").alias("kids"))


@framed("f06_signals", f"SELECT * EXCLUDE (occasion) FROM ({SIGNALS})")
def f06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return titles(spark, sf_dir).select("id", T.signals(F.col("title")).alias("s")).select("id", "s.*")


@framed("f07_violations", f"""SELECT id, concat_ws(',', CASE WHEN occasion = 'birthday/kids' AND adult_age THEN 'kids_but_adult_age' END,
    CASE WHEN occasion = 'birthday/kids' AND NOT adult_age AND NOT (kid_word OR kid_age) THEN 'kids_but_no_kid_signal' END, CASE WHEN occasion = 'birthday/milestone' AND NOT milestone_age THEN 'milestone_but_no_milestone_age' END,
    CASE WHEN occasion = 'birthday/relationship' AND NOT rel_word THEN 'relationship_but_no_relationship_word' END, CASE WHEN occasion = 'birthday/general' AND (kid_word OR kid_age) THEN 'general_but_kid_signal' END,
    CASE WHEN occasion = 'birthday/general' AND milestone_age THEN 'general_but_milestone_age' END, CASE WHEN occasion = 'birthday/general' AND rel_word THEN 'general_but_relationship_word' END) AS codes FROM ({SIGNALS})""")  # fmt: skip
def f07(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = titles(spark, sf_dir).withColumn("s", T.signals(F.col("title")))
    return rows.select("id", F.array_join(T.violations(F.col("occasion"), F.col("s")), ",").alias("codes"))


PRICED = "SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN concat('£', p_size, '.50') WHEN 1 THEN concat('From $ ', p_size, ',9 each') WHEN 2 THEN concat('€', p_size) WHEN 3 THEN 'Add to cart' ELSE concat(p_size, ' in 4.25 stars') END AS s FROM part"


def priced(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "part").createOrReplaceTempView("part")
    return spark.sql(PRICED)


@framed("f08_price", f"SELECT id, CAST(round(CAST(replace(nullif(regexp_extract(s, '([£$€])\\s*([0-9]+(?:[.,][0-9]{{1,2}})?)', 2), ''), ',', '.') AS DOUBLE) * 100) AS INT) AS minor, CASE regexp_extract(s, '([£$€])\\s*([0-9])', 1) WHEN '£' THEN 'GBP' WHEN '$' THEN 'USD' WHEN '€' THEN 'EUR' END AS currency FROM ({PRICED})")
def f08(spark: SparkSession, sf_dir: str) -> DataFrame:
    return priced(spark, sf_dir).select("id", T.price(F.col("s")).alias("p")).select("id", F.col("p.price_minor_units").alias("minor"), "p.currency")


@framed("f09_numbers", f"SELECT id, TRY_CAST(nullif(regexp_replace(s, '[^0-9]', '', 'g'), '') AS BIGINT) AS digits, TRY_CAST(nullif(regexp_extract(s, '[0-9]+(?:\\.[0-9]+)?'), '') AS DOUBLE) AS number FROM ({PRICED})")
def f09(spark: SparkSession, sf_dir: str) -> DataFrame:
    return priced(spark, sf_dir).select("id", T.digits_only(F.col("s")).alias("digits"), T.first_number(F.col("s")).alias("number"))


LD = """SELECT p_partkey AS id, concat('<html><head><script type="application/ld+json">', CASE p_partkey % 3 WHEN 0 THEN concat('{"@type":"Product","name":"', p_name, '","offers":{"price":"', p_size, '.25","priceCurrency":"gbp"}}')
    WHEN 1 THEN concat('{"@graph":[{"@type":"Thing"},{"@type":"Product","name":"', p_name, '"}]}') ELSE '{broken' END, '</script></head><body><h1> ', p_brand, ' <b>x</b></h1><span class="price">$', p_size, '</span><a href="/people/art', p_size, '/shop">x</a></body></html>') AS html,
    concat('https://shop.example/i/card/', 1000000 + p_partkey, '/q?x=1') AS url, p_name, p_brand, p_size FROM part"""  # fmt: skip


def marked_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "part").createOrReplaceTempView("part")
    return spark.sql(LD)


@framed("f10_json_ld", f"SELECT id, CASE WHEN id % 3 < 2 THEN p_name END AS name FROM ({LD})")
def f10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marked_up(spark, sf_dir).select("id", F.get_json_object(web.json_ld(F.col("html"), "Product"), "$.name").alias("name"))


@framed("f11_page_title", "SELECT page_id, nullif(trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<title\\b[^>]*>(.*?)</title\\s*>', 1), '<[^>]*>', '', 'g'), '\\s+', ' ', 'g')), '') AS title, nullif(regexp_extract(html, '(?is)<html\\b[^>]*\\blang\\s*=\\s*[\"'']([^\"'']*)[\"'']', 1), '') AS lang FROM pages")
def f11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", web.tag_text(F.col("html"), "title").alias("title"), web.attribute(F.col("html"), "html", "lang").alias("lang"))


@framed("f12_listing", f"SELECT CAST(1000000 + id AS VARCHAR) AS source_listing_id, CASE WHEN id % 3 < 2 THEN p_name ELSE concat(p_brand, ' x') END AS title, concat('art', p_size) AS seller_id, CASE WHEN id % 3 = 0 THEN p_size * 100 + 25 ELSE p_size * 100 END AS price_minor_units, CASE WHEN id % 3 = 0 THEN 'GBP' ELSE 'USD' END AS currency FROM ({LD})")
def f12(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = marked_up(spark, sf_dir).select(web.listing(F.col("html"), F.col("url")).alias("l"))
    return got.select("l.source_listing_id", "l.title", "l.seller_id", "l.price_minor_units", "l.currency")


@framed("f13_listing_number", "SELECT page_id, coalesce(nullif(regexp_extract(url, '/(\\d{6,})', 1), ''), url) AS number FROM pages")
def f13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", web.listing_number(F.col("url")).alias("number"))


IMAGES = "SELECT p_partkey AS id, ['https://ih1.redbubble.net/image.' || p_size || '.1/papergc,x.jpg', 'https://ih1.redbubble.net/image.' || p_size || '.1/raf,x.webp', 'https://ih1.redbubble.net/image.7.2/flat,' || p_size || '.' || CASE WHEN p_size % 2 = 0 THEN 'png' ELSE 'jpg' END] AS urls FROM part"


@framed("f14_image_variants", f"SELECT id, array_to_string([CASE WHEN id % 4 = 0 THEN urls[3] ELSE urls[2] END, CASE WHEN id % 4 = 0 THEN urls[2] ELSE urls[3] END], ' ') AS best, urls[3] AS cover FROM ({IMAGES})".replace("CASE WHEN id % 4 = 0 THEN urls[3] ELSE urls[2] END, CASE WHEN id % 4 = 0 THEN urls[2] ELSE urls[3] END", "urls[2], urls[3]"))
def f14(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "part").createOrReplaceTempView("part")
    rows = spark.sql(IMAGES.replace("[", "array(").replace("] AS urls", ") AS urls"))
    html = F.concat(F.lit('<img src="'), F.array_join("urls", '"><img src="'), F.lit('">'))
    best = web.best_variants(html)
    return rows.select("id", F.array_join(best, " ").alias("best"), F.get(web.cover_first(best), F.lit(0)).alias("cover"))


@framed("f15_urls", "SELECT page_id, regexp_replace(url, '\\?.*', '') AS bare, CASE WHEN starts_with(regexp_replace(url, '^https?://[^/]*', ''), 'http') THEN '' ELSE concat('https://base', regexp_replace(url, '^https?://[^/]*', '')) END AS absolute FROM pages")
def f15(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.regexp_replace("url", "^https?://[^/]*", "")
    return table(spark, sf_dir, "pages").select("page_id", web.without_query(F.col("url")).alias("bare"), web.absolute(path, "https://base").alias("absolute"))


ANSWERS = "SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN concat('Rating: [[', p_size % 12, ']]') WHEN 1 THEN concat('I say [', p_size % 14, '.5]') WHEN 2 THEN '[2024] and [[11]] or [3]' WHEN 3 THEN concat('[[x]] then [', p_size % 10, ']') ELSE 'none' END AS s FROM part"


@framed("f16_rating", f"SELECT id, CASE WHEN v BETWEEN 1 AND 10 THEN v END AS rating, CASE WHEN v BETWEEN 1 AND 10 THEN round((v - 1) / 9, 9) END AS scaled FROM (SELECT id, CAST(coalesce(nullif(regexp_extract(s, '\\[\\[(\\d+\\.?\\d*)\\]\\]', 1), ''), nullif(regexp_extract(s, '\\[(\\d+\\.?\\d*)\\]', 1), '')) AS DOUBLE) AS v FROM ({ANSWERS}))")
def f16(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "part").createOrReplaceTempView("part")
    got = spark.sql(ANSWERS).select("id", T.rating(F.col("s")).alias("rating"))
    return got.select("id", "rating", F.round(T.rescaled(F.col("rating"), 1, 10), 9).alias("scaled"))


def sims(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.transform(F.slice("embedding", 1, 5), lambda x: x.cast("double")).alias("s"))
    return v


LOW = "SELECT vec_id, [x::DOUBLE FOR x IN embedding[1:5]] AS s FROM embeddings"
PMF = f"SELECT vec_id, [(x - list_min(s)) / (list_sum(s) - 5 * list_min(s)) FOR x IN s] AS p FROM ({LOW})"


def _rounded(a: Column) -> list[Column]:
    return [F.round(a[i], 6).alias(f"p{i + 1}") for i in range(5)]


@framed("f18_pmf", f"SELECT vec_id, {', '.join(f'round(p[{i}], 6) AS p{i}' for i in range(1, 6))} FROM ({PMF})")
def f18(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sims(spark, sf_dir).withColumn("p", V.pmf(F.col("s"))).select("vec_id", *_rounded(F.col("p")))


@framed("f19_sharpened_pmf", f"SELECT vec_id, {', '.join(f'round(pow(p[{i}], 2) / list_sum([pow(x, 2) FOR x IN p]), 6) AS p{i}' for i in range(1, 6))} FROM ({PMF})")
def f19(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sims(spark, sf_dir).withColumn("p", V.sharpened(V.pmf(F.col("s")), 0.5)).select("vec_id", *_rounded(F.col("p")))


@framed("f20_ssr_score", """WITH a AS (SELECT vec_id // 5 AS st, vec_id % 5 AS k, embedding AS e FROM embeddings WHERE vec_id < 30), r AS (SELECT vec_id, embedding AS e FROM embeddings WHERE vec_id >= 30),
    c AS (SELECT r.vec_id, a.st, a.k, (1 + list_cosine_similarity([x::DOUBLE FOR x IN r.e], [x::DOUBLE FOR x IN a.e])) / 2 AS s FROM r, a), m AS (SELECT *, min(s) OVER (PARTITION BY vec_id, st) AS lo, sum(s) OVER (PARTITION BY vec_id, st) AS total FROM c),
    p AS (SELECT vec_id, k, avg((s - lo) / (total - 5 * lo)) AS q FROM m GROUP BY 1, 2) SELECT vec_id, round((sum(q * (k + 1)) - 1) / 4, 6) AS score FROM p GROUP BY vec_id""")  # fmt: skip
def f20(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    anchors = e.where("vec_id < 30").select(F.expr("vec_id div 5").alias("st"), (F.col("vec_id") % 5).alias("k"), F.col("embedding").alias("a"))
    near = e.where("vec_id >= 30").crossJoin(F.broadcast(anchors))  # 30 anchors, a fixed number
    near = near.select("vec_id", "st", "k", ((1 + V.cosine(F.col("embedding"), F.col("a"))) / 2).alias("s"))
    sets = near.groupBy("vec_id", "st").agg(F.array_sort(F.collect_list(F.struct("k", "s"))).alias("x"))
    parts = sets.select("vec_id", F.posexplode(V.pmf(F.transform("x", lambda y: y["s"]))).alias("k", "q"))
    mean = parts.groupBy("vec_id", "k").agg(F.avg("q").alias("q"))
    return mean.groupBy("vec_id").agg(F.round((F.sum(F.col("q") * (F.col("k") + 1)) - 1) / 4, 6).alias("score"))


@framed("f21_unit_vectors", "SELECT vec_id, round(sqrt(list_sum([x::DOUBLE * x FOR x IN embedding])), 6) AS n, round(list_cosine_similarity([x::DOUBLE FOR x IN embedding], [x::DOUBLE FOR x IN list_reverse(embedding)]), 6) AS c FROM embeddings")
def f21(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(V.norm(F.col("embedding")), 6).alias("n"), F.round(V.cosine(F.col("embedding"), F.reverse("embedding")), 6).alias("c"))


HASHES = "SELECT doc_id, ('0x' || substr(md5(text), 1, 16))::UBIGINT AS a, ('0x' || substr(md5(text), 17, 16))::UBIGINT AS b FROM documents"


def hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.md5("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.conv(F.substring(m, 1, 16), 16, -10).cast("long").alias("a"), F.conv(F.substring(m, 17, 16), 16, -10).cast("long").alias("b"))


@framed("f22_hamming", f"SELECT doc_id, CAST(bit_count(xor(a, b)) AS INT) AS bits, CAST(a >> 56 AS BIGINT) AS top FROM ({HASHES})")
def f22(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hashes(spark, sf_dir).select("doc_id", V.hamming(F.col("a"), F.col("b")).alias("bits"), V.top_byte(F.col("a")).alias("top"))


@framed("f24_bit_strings", f"SELECT doc_id, lpad(bin(a), 64, '0') AS bits, true AS same FROM ({HASHES})")
def f24(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = hashes(spark, sf_dir).withColumn("bits", V.to_bits(F.col("a")))
    return h.select("doc_id", "bits", (V.from_bits(F.col("bits")) == F.col("a")).alias("same"))


@framed("f26_content_path", "SELECT doc_id, concat('images/', substr(d, 1, 2), '/', substr(d, 3, 2), '/', d) AS path FROM (SELECT doc_id, sha256(text) AS d FROM documents)")
def f26(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", V.content_path(F.encode("text", "UTF-8")).alias("path"))


@framed("f25_uuid5", """SELECT c_custkey, concat_ws('-', substr(h, 1, 8), substr(h, 9, 4), concat('5', substr(h, 14, 3)), concat(substr('89ab', ('0x' || substr(h, 17, 1))::INT % 4 + 1, 1), substr(h, 18, 3)), substr(h, 21, 12)) AS uuid
    FROM (SELECT c_custkey, sha1(unhex('6ba7b8129dad11d180b400c04fd430c8') || encode(c_custkey::VARCHAR)) AS h FROM customer)""")  # fmt: skip
def f25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", V.uuid5(F.col("c_custkey").cast("string")).alias("uuid"))


@framed("f27_repaired_json", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 THEN NULL ELSE o_orderkey END AS k FROM orders")
def f27(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("o_orderkey").cast("string")
    text = F.when(n % 4 == 0, F.concat(F.lit('```json\n{"k": '), n, F.lit("}\n```"))).when(n % 4 == 1, F.concat(F.lit("Sure! {'k': "), n, F.lit("} done")))
    text = text.when(n % 4 == 2, F.concat(F.lit('{"t": "a\nb", "k": '), n, F.lit("}"))).otherwise("no object")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.try_variant_get(web.repaired_json(text), "$.k", "long").alias("k"))


WORDS = "regexp_extract_all(lower({}), '([a-z0-9'']+)', 1)"
HEADS = f"SELECT a.conv_id, a.turn, {WORDS.format('a.text')} AS h, {WORDS.format('b.text')} AS s FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1"


def answered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn with the one after it."""
    c = table(spark, sf_dir, "conversations")
    after = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("seen"))
    return c.select("conv_id", "turn", F.col("text").alias("headline")).join(after, ["conv_id", "turn"])


@framed("f28_overlap_recall", f"SELECT conv_id, turn, CASE WHEN len(h) = 0 THEN 0 ELSE round(len([w FOR w IN h IF list_contains(s, w)]) / len(h), 6) END AS recall FROM ({HEADS})")
def f28(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answered(spark, sf_dir).select("conv_id", "turn", F.round(T.overlap_recall(F.col("headline"), F.col("seen")), 6).alias("recall"))


@framed("f29_word_jaccard", f"SELECT conv_id, turn, CASE WHEN len(h) + len(s) = 0 THEN 0 ELSE round(len(list_intersect(h, s)) / len(list_distinct(list_concat(h, s))), 6) END AS j FROM ({HEADS})")
def f29(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answered(spark, sf_dir).select("conv_id", "turn", F.round(T.word_jaccard(F.col("headline"), F.col("seen")), 6).alias("j"))


@framed("f30_normalised", "SELECT id, trim(regexp_replace(translate(lower(title), '!\"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~', ''), '\\s+', ' ', 'g')) AS n FROM titles")
def f30(spark: SparkSession, sf_dir: str) -> DataFrame:
    return titles(spark, sf_dir).select("id", T.normalised(F.col("title")).alias("n"))


@framed("f31_caption", "SELECT doc_id, array_to_string(string_split(trim(regexp_replace(regexp_replace(text, '[\"''\\n\\r]', ' ', 'g'), '\\s+', ' ', 'g')), ' ')[1:8], ' ') AS c FROM documents")
def f31(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.caption(F.col("text")).alias("c"))


@framed("f32_scored_title", "SELECT id, printf('%s (score: %.2f)', trim(regexp_replace(title, '\\s+', ' ', 'g')), (id % 4) / 4) AS s FROM titles")
def f32(spark: SparkSession, sf_dir: str) -> DataFrame:
    return titles(spark, sf_dir).select("id", T.scored_title(F.col("title"), F.col("id") % 4 / 4).alias("s"))


OCCASIONS = ("birthday/kids", "christmas", "mothers_day", "fathers_day", "valentines_day", "easter", "anniversary/25", "wedding", "sympathy", "thank_you", "congratulations", "new_baby/girl", "leaving", "new_job/x", "get_well")


@framed("f33_greeting", f"""SELECT id, CASE WHEN o = 'birthday' THEN 'Happy Birthday' WHEN o = 'christmas' THEN 'Merry Christmas' WHEN o = 'mothers_day' THEN 'Happy Mother''s Day' WHEN o = 'fathers_day' THEN 'Happy Father''s Day'
    WHEN o = 'valentines_day' THEN 'Happy Valentine''s Day' WHEN o = 'easter' THEN 'Happy Easter' WHEN o = 'anniversary' THEN 'Happy Anniversary' WHEN o IN ('wedding', 'congratulations', 'new_baby') THEN 'Congratulations' WHEN o = 'sympathy' THEN 'With Sympathy'
    WHEN o = 'thank_you' THEN 'Thank You' WHEN o = 'leaving' THEN 'Good Luck' WHEN o = 'new_job' THEN 'New Job' WHEN o = 'get_well' THEN 'Get Well' END AS g FROM (SELECT id, split_part({list(OCCASIONS)}[(id % 16)::INT + 1], '/', 1) AS o FROM titles)""")  # fmt: skip
def f33(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = F.get(F.array(*map(F.lit, OCCASIONS)), F.col("id") % 16)  # the last is null
    return titles(spark, sf_dir).select("id", T.greeting(o).alias("g"))


@framed("f34_template", "SELECT id, concat('To ', title, ' on ', coalesce(occasion, ''), '!') AS prompt FROM titles")
def f34(spark: SparkSession, sf_dir: str) -> DataFrame:
    return titles(spark, sf_dir).select("id", T.rendered("To {{who}} on {{day}}!", {"who": F.col("title"), "day": F.col("occasion")}).alias("prompt"))


@framed("f35_slug", "SELECT id, trim(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM titles")
def f35(spark: SparkSession, sf_dir: str) -> DataFrame:
    return titles(spark, sf_dir).select("id", T.slug(F.col("title")).alias("slug"))


@framed("f36_font_rules", """WITH r(tone, font, pos) AS (VALUES ('ECONOMY', 'serif', 1), ('ECONOMY', 'sans', 2), ('PROMO', 'sans', 3), ('PROMO', 'script', 4), ('any', 'sans', 5), ('any', 'mono', 6)),
    m AS (SELECT id, font, min(pos) AS pos FROM titles JOIN r ON tone = p_type OR tone = 'any' GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY pos) AS n FROM m)
    SELECT id, string_agg(font, ',' ORDER BY pos) AS fonts FROM k WHERE n <= 3 GROUP BY id""")  # fmt: skip
def f36(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = {"ECONOMY": ["serif", "sans"], "PROMO": ["sans", "script"]}
    table_of = F.create_map(*[x for k, v in rules.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    fonts = F.array_distinct(F.concat(F.coalesce(table_of[F.col("p_type")], F.array().cast("array<string>")), F.array(F.lit("sans"), F.lit("mono"))))
    return titles(spark, sf_dir).select("id", F.array_join(F.slice(fonts, 1, 3), ",").alias("fonts"))


@framed("f37_hierarchical_lookup", "WITH s(occasion, m) AS (VALUES ('birthday/kids', 'kids.bin')), g(grp, m) AS (VALUES ('birthday', 'all.bin')) SELECT t.id, coalesce(s.m, g.m, 'base.bin') AS model FROM titles t LEFT JOIN s ON s.occasion = t.occasion LEFT JOIN g ON g.grp = split_part(t.occasion, '/', 1)")
def f37(spark: SparkSession, sf_dir: str) -> DataFrame:
    exact = F.create_map(F.lit("birthday/kids"), F.lit("kids.bin"))[F.col("occasion")]
    group = F.create_map(F.lit("birthday"), F.lit("all.bin"))[F.split_part("occasion", F.lit("/"), F.lit(1))]
    return titles(spark, sf_dir).select("id", T.hierarchical(exact, group, F.lit("base.bin")).alias("model"))


@framed("f38_route", "SELECT p_partkey, CASE WHEN contains(m, '/') THEN split_part(m, '/', 1) WHEN starts_with(m, 'local') THEN 'local' ELSE 'default' END AS provider, CASE WHEN contains(m, '/') THEN split_part(m, '/', 2) ELSE m END AS model FROM (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN concat('hub/', p_brand) WHEN 1 THEN concat('local-', p_size) ELSE p_brand END AS m FROM part)")
def f38(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 3
    m = F.when(k == 0, F.concat(F.lit("hub/"), "p_brand")).when(k == 1, F.concat(F.lit("local-"), F.col("p_size").cast("string"))).otherwise(F.col("p_brand"))
    rows = table(spark, sf_dir, "part").select("p_partkey", m.alias("m"))
    part = lambda i: F.split_part("m", F.lit("/"), F.lit(i))
    return rows.select("p_partkey", F.when(F.contains("m", F.lit("/")), part(1)).when(F.startswith("m", F.lit("local")), "local").otherwise("default").alias("provider"), F.when(F.contains("m", F.lit("/")), part(2)).otherwise(F.col("m")).alias("model"))


@framed("f39_fitted_lines")
def f39(spark: SparkSession, sf_dir: str) -> DataFrame:
    fit = T.fitted_lines(F.col("title"), 400, 160)
    return titles(spark, sf_dir).select("id", fit.alias("fit")).select("id", "fit.size", F.array_join("fit.lines", "|").alias("lines"))


@framed("f40_mask_box", "SELECT p_partkey, CAST(floor((p_size * 10) * 0.1::DOUBLE) AS INT) AS x0, CAST(floor(p_size * 20 * CASE p_size % 3 WHEN 0 THEN 0.0::DOUBLE WHEN 1 THEN 1 - 0.3::DOUBLE ELSE (1 - 0.3::DOUBLE) / 2 END) AS INT) AS y0 FROM part")
def f40(spark: SparkSession, sf_dir: str) -> DataFrame:
    region = F.when(F.col("p_size") % 3 == 0, "top").when(F.col("p_size") % 3 == 1, "bottom").otherwise("middle")
    box = V.mask_box(region, F.col("p_size") * 10, F.col("p_size") * 20)
    return table(spark, sf_dir, "part").select("p_partkey", box.alias("b")).select("p_partkey", "b.x0", "b.y0")


@framed("f41_text_colour", "WITH c AS (SELECT p_partkey, (p_size * 5) / 255 AS v FROM part), l AS (SELECT p_partkey, CASE WHEN v <= 0.04045 THEN v / 12.92 ELSE pow((v + 0.055) / 1.055, 2.4) END AS y FROM c) SELECT p_partkey, CASE WHEN 116 * pow(y, 1.0 / 3) - 16 < 55 THEN 'white' ELSE 'black' END AS colour FROM l")
def f41(spark: SparkSession, sf_dir: str) -> DataFrame:
    grey = F.col("p_size") * 5
    return table(spark, sf_dir, "part").select("p_partkey", V.text_colour(V.luminance(grey, grey, grey)).alias("colour"))


@framed("f42_capped_size", "SELECT p_partkey, CAST(round_even(w * f, 0) AS INT) AS width, CAST(round_even(h * f, 0) AS INT) AS height FROM (SELECT p_partkey, w, h, CASE WHEN greatest(w, h) > 1030 THEN 1030.0::DOUBLE / greatest(w, h) ELSE 1.0::DOUBLE END AS f FROM (SELECT p_partkey, p_size * 40 AS w, p_size * 57 AS h FROM part))")
def f42(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", V.capped_size(F.col("p_size") * 40, F.col("p_size") * 57).alias("s")).select("p_partkey", "s.width", "s.height")


@framed("f43_blend", "SELECT id, round(greatest(0, least(1, 0.7::DOUBLE * coalesce(CASE WHEN id % 3 = 0 THEN aesthetic END, purchase_intent) + 0.3::DOUBLE * fit * 2)), 9) AS s FROM graded")
def f43(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = MAKERS["graded"](spark, sf_dir)
    s = 0.7 * F.coalesce(F.when(F.col("id") % 3 == 0, F.col("aesthetic")), F.col("purchase_intent")) + 0.3 * F.col("fit") * 2
    return g.select("id", F.round(T.clamped(s), 9).alias("s"))


@framed("f45_stars", "SELECT id, CASE WHEN purchase_intent < 0.001 THEN '***' WHEN purchase_intent < 0.01 THEN '**' WHEN purchase_intent < 0.05 THEN '*' ELSE '' END AS stars FROM graded")
def f45(spark: SparkSession, sf_dir: str) -> DataFrame:
    return MAKERS["graded"](spark, sf_dir).select("id", T.stars(F.col("purchase_intent")).alias("stars"))


@framed("f46_ocr_tokens", "SELECT l_orderkey, string_agg(l_returnflag, ' ' ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS text, round(avg(l_quantity - 10), 6) AS conf FROM lineitem WHERE l_quantity >= 10 GROUP BY l_orderkey")
def f46(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", F.struct(F.concat(F.lit(" "), "l_returnflag").alias("text"), (F.col("l_quantity") - 10).cast("string").alias("conf")).alias("t"))
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["t"]).alias("tokens"))
    return rows.select("l_orderkey", T.ocr_text(F.col("tokens")).alias("o")).where("o.text <> ''").select("l_orderkey", "o.text", F.round("o.conf", 6).alias("conf"))


@framed("f47_first_key", "SELECT card_id, coalesce(json_extract_string(brief, '$.missing'), json_extract_string(brief, '$.seed'), json_extract_string(brief, '$.occasion')) AS v FROM briefs")
def f47(spark: SparkSession, sf_dir: str) -> DataFrame:
    return MAKERS["brief"](spark, sf_dir).select("card_id", web.json_path(F.col("brief"), "$.missing", "$.seed", "$.occasion").alias("v"))
