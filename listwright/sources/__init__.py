"""Sources: tables, files and pages as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from listwright.functions.vectors import url_key

CURATED = "source string, url string, title string, description string, seller_id string, price_minor_units int, currency string, review_count int, review_avg double, favourite_count int, is_bestseller boolean, image_urls array<string>, raw_metadata string"
RATINGS = "card_key string, condition string, occasion string, occasion_fit double, aesthetic double, emotional_resonance double, distinctiveness double, purchase_intent double"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """S-01: a table of the Parquet store."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def jdbc(spark: SparkSession, url: str, name: str, column: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 8) -> DataFrame:
    """S-01: a table of a database, read by ranges of a column where one is given."""
    r = spark.read.format("jdbc").option("url", url).option("dbtable", name).option("loginTimeout", "15")
    if column and bounds:
        r = r.option("partitionColumn", column).option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", parts)
    return r.load()


def sql(spark: SparkSession, text: str, views: dict[str, DataFrame], **params) -> DataFrame:
    """S-02: SQL with named parameters over DataFrames, which the text names as {name}."""
    return spark.sql(text, args=params or None, **views)


def file_stem(path: Column | None = None) -> Column:
    """The name of the file a row came from, without folder and extension."""
    return F.regexp_extract(path if path is not None else F.col("_metadata.file_path"), r"([^/]+?)(?:\.[^./]*)?$", 1)


def curated(spark: SparkSession, path: str, name: str | None = None) -> DataFrame:
    """S-08, S-17: listings from JSON arrays, a file or (with a name) a line each; a listing without a source has that name,
    else its file's."""
    rows = spark.read.schema(CURATED).option("multiLine", name is None).json(path)
    return rows.withColumn("source", F.coalesce("source", F.lit(name) if name else file_stem()))


def ratings(spark: SparkSession, path: str, schema: str = RATINGS, folder: str | None = None) -> DataFrame:
    """S-11, S-12: CSV files of ratings; ratings_<judge>.csv, or a folder <folder>=ratings_<judge>, gives the judge."""
    rows = spark.read.schema(f"{schema}, `{folder}` string" if folder else schema).option("header", True).csv(path)
    name = F.col(folder) if folder else file_stem()
    return rows.withColumn("judge", F.regexp_extract(name, r"^ratings_(.+)$", 1))


def gallery(spark: SparkSession, path: str) -> DataFrame:
    """S-13: the cards of HTML galleries: (file, pos, src, caption)."""
    page = spark.read.text(path, wholetext=True).select(file_stem().alias("file"), "value")
    form = r'(?is)<img[^>]*\bsrc="([^"]*)"[^>]*>\s*<figcaption>(.*?)</figcaption>'
    pairs = F.arrays_zip(F.regexp_extract_all("value", F.lit(form), F.lit(1)).alias("src"), F.regexp_extract_all("value", F.lit(form), F.lit(2)).alias("caption"))
    return page.select("file", F.posexplode(pairs).alias("pos", "card")).select("file", "pos", "card.src", "card.caption")


def training_log(spark: SparkSession, path: str) -> DataFrame:
    """S-14: (seed, epoch, loss, rho) of a log's progress lines."""
    form = r"seed=(\d+) epoch=(\d+) train_loss=([0-9.eE+-]+) val_pi_rho=([0-9.eE+-]+)"
    part = lambda i: F.regexp_extract("value", form, i)
    rows = spark.read.text(path).where(F.col("value").rlike(form))
    return rows.select(part(1).cast("int").alias("seed"), part(2).cast("int").alias("epoch"), part(3).cast("double").alias("loss"), part(4).cast("double").alias("rho"))


def coefficients(spark: SparkSession, path: str) -> DataFrame:
    """S-15: a stored linear model: a row for each head with its weights and intercept."""
    return spark.read.parquet(path)


def blobs(spark: SparkSession, path: str) -> DataFrame:
    """S-10: files as (path, scheme, content, key): the key is the content's digest."""
    rows = spark.read.format("binaryFile").load(path)
    return rows.select("path", F.regexp_extract("path", r"^([a-z0-9]+):", 1).alias("scheme"), "modificationTime", "content", F.sha2("content", 256).alias("key"))


def cached_pages(spark: SparkSession, path: str, ttl_days: int = 30) -> DataFrame:
    """S-04, S-16: cached pages that are not too old; a file's name is its URL's key."""
    rows = spark.read.format("binaryFile").load(path).where(F.col("modificationTime") > F.current_timestamp() - F.make_interval(days=F.lit(ttl_days)))
    return rows.select(file_stem(F.col("path")).alias("key"), F.col("content").cast("string").alias("html"))


def from_cache(urls: DataFrame, pages: DataFrame, url: str = "url", version: str | None = None) -> DataFrame:
    """S-16: pages of known URLs, to be parsed again. Where a URL is kept with several contents, the column version of both
    tables tells them apart. Pages without a URL are kept under an empty key."""
    keyed = urls.withColumn("key", F.coalesce(url_key(F.col(url)), F.lit("")))
    names = ["key", version] if version else ["key"]
    return keyed.join(pages, names).drop(*names)


def dumped(tables: dict[str, DataFrame], path: str) -> None:
    """S-18: every table as Parquet."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}.parquet")


def latest(df: DataFrame, tag: str, time: str) -> DataFrame:
    """S-19: the tag of the newest row that has one."""
    return df.where(F.col(tag).isNotNull()).agg(F.max_by(tag, F.struct(time, tag)).alias(tag))
