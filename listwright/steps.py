"""What a run over the catalogue is made of: sources, scorers, named steps in order, and calls that are tried again."""

from __future__ import annotations

import argparse
import time
from collections.abc import Callable
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Source(Protocol):
    """V-01: a marketplace. discover gives the URLs (url) of one query's listings, parse the listings of pages (url, html); a
    source that is any_query lists the same whatever is asked for and is asked once."""

    name: str
    any_query: bool

    def discover(self, spark: SparkSession, query: str, limit: int) -> DataFrame: ...

    def parse(self, pages: DataFrame) -> DataFrame: ...


class Scorer(Protocol):
    """V-03: rows of features get a column for each head."""

    def score(self, features: DataFrame) -> DataFrame: ...


def discovered(spark: SparkSession, source: Source, queries: list[str], limit: int, known: DataFrame | None = None) -> DataFrame:
    """S-07: the distinct URLs of all queries that are not known yet (url, query: the first one in order)."""
    found = None
    for i, q in enumerate(queries[:1] if source.any_query else queries):
        one = source.discover(spark, q, limit).select("url", F.struct(F.lit(i).alias("i"), F.lit(q).alias("q")).alias("at"))
        found = one if found is None else found.union(one)
    if found is None:
        return spark.createDataFrame([], "url string, query string")
    new = found.groupBy("url").agg(F.min("at").alias("at")).select("url", F.col("at.q").alias("query"))
    return new if known is None else new.join(known.select("url"), "url", "left_anti")


def reranked(candidates: DataFrame, scorer: Scorer, key: str, head: str, top_k: int) -> DataFrame:
    """W-11: the best candidates by one head, with their rank from 1; ties in order of the key."""
    best = scorer.score(candidates).orderBy(F.desc_nulls_last(head), key).limit(top_k)
    rows = best.groupBy().agg(F.array_sort(F.collect_list(F.struct((-F.col(head)).alias("s"), *best.columns))).alias("all"))  # top_k rows
    return rows.select(F.posexplode("all").alias("i", "row")).select((F.col("i") + 1).alias("rank"), *[F.col(f"row.{c}") for c in best.columns])


class Steps:
    """V-02: steps by name, in the order in which they were added."""

    def __init__(self) -> None:
        self.known: dict[str, tuple[str, Callable]] = {}

    def step(self, name: str, says: str):
        def put(f: Callable) -> Callable:
            if name in self.known:
                raise ValueError(f"two steps are called {name}")
            self.known[name] = (says, f)
            return f

        return put

    def chosen(self, start: str | None = None, only: str | None = None) -> list[str]:
        names = list(self.known)
        for x in (start, only):
            if x is not None and x not in self.known:
                raise ValueError(f"no step {x}; there are {', '.join(names)}")
        return [only] if only else names[names.index(start) if start else 0 :]

    def run(self, *context, start: str | None = None, only: str | None = None, dry_run: bool = False) -> list[dict]:
        """A report row (step, says, seconds, rows, error) for each chosen step. A step that fails is reported and the next
        one goes on; a dry run only reports what would run."""
        out = []
        for name in self.chosen(start, only):
            says, f = self.known[name]
            row = {"step": name, "says": says, "seconds": None, "rows": None, "error": None}
            if not dry_run:
                began = time.monotonic()
                try:
                    row["rows"] = f(*context)
                except Exception as e:  # noqa: BLE001 it is in the report
                    row["error"] = f"{type(e).__name__}: {e}"
                row["seconds"] = time.monotonic() - began
            out.append(row)
        return out

    def main(self, argv: list[str] | None, *context) -> list[dict]:
        """run() by a command line: --from, --only, --dry-run."""
        p = argparse.ArgumentParser()
        p.add_argument("--from", dest="start")
        p.add_argument("--only")
        p.add_argument("--dry-run", action="store_true")
        a = p.parse_args(argv)
        return self.run(*context, start=a.start, only=a.only, dry_run=a.dry_run)


def retried(call: Callable, attempts: int = 4, wait_s: float = 1.0, factor: float = 2.0, most_s: float = 30.0, of: type[BaseException] = Exception, sleep: Callable[[float], None] = time.sleep):
    """X-11: the call's result; after an error of a kind it is made again, each time after a longer wait, and the last error
    is raised."""
    for i in range(attempts):
        try:
            return call()
        except of:
            if i == attempts - 1:
                raise
            sleep(min(most_s, wait_s * factor**i))
