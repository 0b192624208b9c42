"""Sinks that change tables: each returns the table as it is after the change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEEP_NEW, KEEP_OLD, FILL_NEW, FILL_OLD = "new", "old", "new_or_old", "old_or_new"


def upserted(old: DataFrame, new: DataFrame, key: list[str], policy: dict[str, str], defaults: dict[str, Column] | None = None) -> DataFrame:
    """K-01, K-03..K-09: rows of `new` merged into `old` on a key by one full outer join.

    policy, for each other column and rows in both: new (overwrite, nulls too), old (keep), new_or_old and old_or_new
    (the first that is not null). defaults: values of columns that `new` lacks, for rows it inserts and, where the
    policy says new, updates. A key that `new` repeats must be made unique before."""
    defaults = defaults or {}
    a, b = old.alias("a"), new.withColumn("__in", F.lit(True)).alias("b")
    both = a.withColumn("__was", F.lit(True)).alias("a").join(b, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in key], "full")
    out = [F.when(F.col("b.__in"), F.col(f"b.{k}")).otherwise(F.col(f"a.{k}")).alias(k) for k in key]
    for c, rule in policy.items():
        was = F.col(f"a.{c}") if c in old.columns else F.lit(None)
        now = F.col(f"b.{c}") if c in new.columns else defaults.get(c, F.lit(None))
        merged = {KEEP_NEW: now, KEEP_OLD: was, FILL_NEW: F.coalesce(now, was), FILL_OLD: F.coalesce(was, now)}[rule]
        out.append(F.when(F.col("b.__in").isNull(), was).when(F.col("a.__was").isNull(), now).otherwise(merged).alias(c))
    return both.select(*out)


#: K-01's policy for listings.
LISTING_POLICY = {
    "url": KEEP_NEW, "title": FILL_NEW, "description": FILL_NEW, "seller_id": FILL_NEW, "price_minor_units": KEEP_NEW, "currency": FILL_NEW,
    "review_count": KEEP_NEW, "review_avg": KEEP_NEW, "favourite_count": KEEP_NEW, "is_bestseller": KEEP_NEW, "raw_metadata": FILL_NEW,
    "listing_created_at": KEEP_OLD, "first_seen_at": KEEP_OLD, "last_seen_at": KEEP_NEW,
}


def appended(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """K-02, K-17: rows whose key is new, once each, behind the old ones."""
    return old.unionByName(new.dropDuplicates(key).join(old.select(*key).distinct(), key, "left_anti"))


def recomputed(features: DataFrame, found: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """K-07: derived columns set anew from `found`, null where it has no row."""
    return features.drop(*cols).join(found.select(key, *cols), key, "left")


def rescored(labels: DataFrame, raw: str, dim: str, where: Column) -> DataFrame:
    """K-10: the score of some rows set from one dimension of their raw JSON, where it has that key."""
    from listwright.functions.web import has_key

    value = F.get_json_object(F.col(raw), f"$.{dim}").try_cast("double")
    return labels.withColumn("score", F.when(where & has_key(F.col(raw), dim), value).otherwise(F.col("score")))


def with_column_if_absent(df: DataFrame, name: str, kind: str) -> DataFrame:
    """K-13."""
    return df if name in df.columns else df.withColumn(name, F.lit(None).cast(kind))


def wiped(df: DataFrame, cols: list[str]) -> DataFrame:
    """K-14: derived columns emptied."""
    return df.withColumns({c: F.lit(None).cast(df.schema[c].dataType) for c in cols})


def pending(items: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """J-06, K-22: what is still to be done; a broken run resumes with this."""
    return items.join(done.select(*key), key, "left_anti")


def keys_hold(df: DataFrame, key: list[str]) -> bool:
    """A table's primary key, as an assertion before a write."""
    return df.groupBy(*key).count().where("count > 1").isEmpty()


def scores_filled(old: DataFrame, new: DataFrame, key: str, col: str) -> DataFrame:
    """K-08: a JSON column filled from `new` where it is null or JSON's null; all rows of old stay, none is added."""
    from listwright.functions.web import is_json_null

    rows = old.join(new.select(key, F.col(col).alias("__new")), key, "left")
    empty = F.col(col).isNull() | is_json_null(F.col(col))
    return rows.withColumn(col, F.when(empty & F.col("__new").isNotNull(), F.col("__new")).otherwise(F.col(col))).drop("__new")


def inserted(old: DataFrame, new: DataFrame, ident: str, order: list[str]) -> DataFrame:
    """K-11: the rows of `new` with the ids that follow the greatest of old, in an order without ties; ids don't change when
    the insert is tried again."""
    from listwright.operators.ranking import summed_before

    last = old.agg(F.coalesce(F.max(ident), F.lit(0)).cast("long").alias("__last"))  # one row
    rows = summed_before(new, [F.col(c) for c in order], F.lit(1), "__place")
    return rows.crossJoin(F.broadcast(last)).withColumn(ident, F.col("__last") + F.col("__place") + 1).drop("__last", "__place")


def reported(df: DataFrame, path: str, form: str, by: str | None = None) -> None:
    """K-16: a report as CSV with a header or as JSON lines, in folders by a column if one is named."""
    from listwright.sources.shared import fewer

    writer = fewer(df).write.format(form).option("header", True)
    (writer.partitionBy(by) if by else writer).save(path)
