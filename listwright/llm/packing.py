"""Operator 9: bulk-synchronous best-fit packing of token sequences."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listwright.llm.common import fewer, forgotten, fresh_dir, tune, written
from listwright.llm.tokens import IDS, encoder, vocabulary

CAPACITY, SEED = 4096, 4_096
#: Pieces and gaps of one slice, which a task holds; more than the capacity, so that every superstep opens sequences.
SLICE_ROWS = 1 << 15


def cut_pieces(docs: DataFrame, file: str, end: int, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, none, nth, piece, start, length, ids_crc32): the ids of each whole text and the end id, cut at the capacity.

    none tells a null key, which stands as 0. nth tells documents apart whose keys repeat: it is a hash of the ids, so equal
    rows stay equal."""
    tune(docs.sparkSession)
    kind, k = docs.schema[key].dataType.simpleString(), F.col(f"`{key}`")

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, last = encoder(file).ids, np.array([end], IDS).tobytes()
        for b in batches:
            row, whole, starts, sizes, crcs = [], [], [], [], []
            for i, t in enumerate(b["text"]):
                ids = (encode(t) if isinstance(t, str) else b"") + last
                every = zlib.crc32(ids)
                for at in range(0, len(ids), 2 * capacity):
                    part = np.frombuffer(ids[at : at + 2 * capacity], IDS)
                    row.append(i)
                    whole.append(every)
                    starts.append(at // 2)
                    sizes.append(len(part))
                    crcs.append(zlib.crc32(part.astype("<u4")))
            start = np.array(starts, np.int64)
            yield pd.DataFrame({"key": b["key"].to_numpy()[row], "none": b["none"].to_numpy()[row], "nth": np.array(whole, np.int64), "piece": start // capacity, "start": start, "length": np.array(sizes, np.int32), "ids_crc32": np.array(crcs, np.int64)})

    rows = docs.select(F.coalesce(k, F.lit(0).cast(kind)).alias("key"), k.isNull().alias("none"), F.col(f"`{text}`").alias("text"))
    return rows.mapInPandas(each, f"key {kind}, none boolean, nth long, piece int, start long, length int, ids_crc32 long")


class Gaps:
    """Open sequences as runs (gap, first sequence, how many), sorted by gap. All of a run have the same gap."""

    def __init__(self) -> None:
        self.sizes: list[int] = []
        self.runs: dict[int, list[tuple[int, int]]] = {}

    def put(self, gap: int, first: int, many: int) -> None:
        if gap <= 0 or many <= 0:
            return
        if gap not in self.runs:
            insort(self.sizes, gap)
            self.runs[gap] = []
        self.runs[gap].append((first, many))

    def successor(self, length: int) -> int | None:
        """The smallest gap of at least this length."""
        at = bisect_left(self.sizes, length)
        return self.sizes[at] if at < len(self.sizes) else None

    def take(self, gap: int) -> list[tuple[int, int]]:
        del self.sizes[bisect_left(self.sizes, gap)]
        return self.runs.pop(gap)


def least_sequences(lengths: dict[int, int], capacity: int) -> int:
    """A number of sequences that no packing of these pieces goes below: those over half the capacity need one each, and what
    is left there after the longest ones holds no piece of at least some length k; the best k counts."""
    n = np.zeros(capacity + 2, np.int64)
    n[list(lengths)] = list(lengths.values())
    size = np.arange(capacity + 2)
    many, total, half = np.cumsum(n), np.cumsum(n * size), capacity // 2
    k = np.arange(half + 1)
    alone, large = many[capacity] - many[capacity - k], many[capacity] - many[half]
    room = (large - alone) * capacity - (total[capacity - k] - total[half])
    small = total[half] - np.where(k > 0, total[np.maximum(k - 1, 0)], 0)
    return int((large + np.maximum(0, -((room - small) // capacity))).max()) if lengths else 0


def sweep(lengths: dict[int, int], capacity: int = CAPACITY, gaps: Gaps | None = None, fresh: int = 0, most: int | None = None) -> tuple[np.ndarray, dict[int, int], int]:
    """Best fit over the range-sorted pieces and gaps of one task: (rows, left, next new sequence).

    The sorted sides are runs: pieces of one length, gaps of one size. The longest pieces sweep the gaps upward from their
    successor, the smallest gap that holds them; where many pieces want one gap, the lowest ranks get it. A gap that took
    pieces is put back at what remains of it, and the next length follows. What no gap holds opens new sequences, up to
    `most` of them, and is left beyond. Rows (length, first rank, pieces, each, first sequence, offset) give the pieces of
    a length from that rank on, `each` to a sequence, to consecutive sequences."""
    gaps, rows, left = Gaps() if gaps is None else gaps, [], {}
    opened = 0
    for length in sorted(lengths, reverse=True):
        n, rank = lengths[length], 0

        def fill(first: int, many: int, gap: int) -> int:
            """Sequences of a run that got pieces; puts back what remains of their gaps."""
            nonlocal n, rank
            each = gap // length
            full = min(many, n // each)
            if full:
                rows.append((length, rank, full * each, each, first, capacity - gap))
                gaps.put(gap - each * length, first, full)
                rank, n = rank + full * each, n - full * each
            if n and full < many:
                rows.append((length, rank, n, n, first + full, capacity - gap))
                gaps.put(gap - n * length, first + full, 1)
                rank, n, full = rank + n, 0, full + 1
            return full

        while n and (gap := gaps.successor(length)) is not None:
            for first, many in gaps.take(gap):
                used = fill(first, many, gap) if n else 0
                gaps.put(gap, first + used, many - used)
        if n:
            many = -(-n // (capacity // length))
            many = many if most is None else min(many, most - opened)
            if many > 0:
                fill(fresh + opened, many, capacity)
                opened += many
            if n:
                left[length] = n
    return np.array(rows, np.int64).reshape(-1, 6), left, fresh + opened


def placed(length: np.ndarray, gap: np.ndarray, capacity: int, last: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One task's superstep over pieces (length, the longest first) and gaps (the smallest first): (sequence, offset, gap).

    Sequences are numbered: first those of the gaps given, then new ones. Pieces with sequence -1 are left to the next
    superstep: new sequences are opened up to a number that any packing needs, or without a bound in the last superstep.
    gap is what remains of each sequence."""
    runs = Gaps()
    for size, at, many in zip(*(x.tolist() for x in np.unique(gap, return_index=True, return_counts=True)), strict=True):
        runs.put(size, at, many)
    kinds, start, count = np.unique(-length, return_index=True, return_counts=True)
    begin = dict(zip((-kinds).tolist(), start.tolist(), strict=True))
    lengths = dict(zip((-kinds).tolist(), count.tolist(), strict=True))
    first, left, n = sweep(lengths, capacity, runs, len(gap), 0)
    second, _, n = sweep(left, capacity, runs, n, None if last else least_sequences(left, capacity))
    where, offset = np.full(len(length), -1, np.int64), np.zeros(len(length), np.int64)
    for plan, shift in ((first, {}), (second, {k: lengths[k] - v for k, v in left.items()})):
        for size, rank, many, each, sequence, at in plan.tolist():
            to = begin[size] + shift.get(size, 0) + rank
            i = np.arange(many)
            where[to : to + many], offset[to : to + many] = sequence + i // each, at + i % each * size
    rest = np.concatenate((gap, np.full(n - len(gap), capacity, np.int64)))
    np.subtract.at(rest, where[where >= 0], length[where >= 0])
    return where, offset, rest


def _superstep(kept: list[str], step: int, capacity: int, last: bool):
    """Pieces (sequence_id -1) and gaps of a slice: the pieces with kind placed or left, and the new sequences' gaps. No
    column holds a null, for which pandas would make long numbers floats."""
    names = [*kept, "sequence_id", "offset", "kind"]

    def each(part: pd.DataFrame) -> pd.DataFrame:
        old = part["sequence_id"].to_numpy(np.int64) >= 0
        docs = part[~old].sort_values(["length", "nth", "piece"], ascending=[False, True, True], kind="stable", ignore_index=True)
        open_ = part[old].sort_values(["length", "sequence_id"], ignore_index=True)
        where, offset, rest = placed(docs["length"].to_numpy(np.int64), open_["length"].to_numpy(np.int64), capacity, last)
        new = (step << 56) + (int(part["slice"].iloc[0]) << 24) + np.arange(len(rest) - len(open_))
        ids = np.concatenate((open_["sequence_id"].to_numpy(np.int64), new))
        docs["kind"] = np.where(where >= 0, "placed", "left")
        docs["sequence_id"], docs["offset"] = ids[where] if len(ids) else -1, offset
        fresh = np.flatnonzero(rest[len(open_) :] > 0) + len(open_)
        if last or not len(fresh):
            return docs[names]
        gaps = docs.iloc[np.zeros(len(fresh), int)].assign(length=rest[fresh], sequence_id=ids[fresh], offset=0, kind="gap")
        return pd.concat((docs, gaps))[names]

    return each


def packed(pieces: DataFrame, capacity: int = CAPACITY, most: int = SLICE_ROWS) -> DataFrame:
    """pieces with sequence_id and offset; lengths lie in 1..capacity, the columns are numbers, texts or truth values
    without nulls.

    Supersteps: pieces and gaps are sorted by ranges of their size (equal sizes by a hash, which ranks them), and each
    range's rows are dealt in turn to slices of about `most` rows, so that every slice has its share of every size. A task
    sweeps the pieces of its slice over the slice's gaps (see sweep), which needs no other slice's gaps, and opens new
    sequences up to the number that its pieces need at least. The pieces left, few, and the gaps of the sequences opened
    by the superstep go on to the next one, with fewer slices, until one slice takes all. With one slice the result is
    best-fit decreasing."""
    spark = pieces.sparkSession
    rows = written(pieces, "pieces")
    kept, out, step = pieces.columns, None, 0
    shape = ", ".join(f"`{c}` {t}" for c, t in pieces.dtypes)
    other = [F.lit(0).cast(t).alias(c) for c, t in pieces.dtypes if c != "length"]
    gaps = None
    while n := rows.count():
        every = rows.select(*kept, F.lit(-1).cast("long").alias("sequence_id"))
        if gaps is not None:
            needed = gaps.join(F.broadcast(rows.agg(F.min("length").alias("least"))), F.col("length") >= F.col("least"))  # one row
            every = every.unionByName(needed.select(*other, "length", "sequence_id"))
            n += needed.count()
        slices = -(-n // most)
        order = [F.desc("length"), F.xxhash64(F.lit(SEED + step), "key", "piece", "nth", "sequence_id")]
        dealt = every.repartitionByRange(*order).sortWithinPartitions(*order) if slices > 1 else every
        turn = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) + F.spark_partition_id()  # a row's place in its range
        dealt = dealt.withColumn("slice", F.pmod(turn, F.lit(slices)))

        path = fresh_dir(spark, "packing")
        done = dealt.groupBy("slice").applyInPandas(_superstep(kept, step, capacity, slices == 1), f"{shape}, sequence_id long, offset long, kind string")
        fewer(done).write.partitionBy("kind").parquet(path)
        done = spark.read.schema(f"{shape}, sequence_id long, offset long, kind string").parquet(path)
        one = done.where("kind = 'placed'").drop("kind")
        out = one if out is None else out.unionByName(one)
        forgotten(rows)
        rows, gaps, step = done.where("kind = 'left'").select(*kept), done.where("kind = 'gap'").select("length", "sequence_id"), step + 1
    return out if out is not None else rows.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")})


def packed_documents(docs: DataFrame, file: str, end: int, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, piece, start, length, ids_crc32, sequence_id, offset) for each piece of each document.

    Null and empty texts are the end id alone. Repeated rows are packed as often as they occur; null keys stay null.
    An empty table gives an empty table. Equal pieces may change places among themselves; which ones they are does not
    matter to any sequence."""
    found = packed(cut_pieces(docs, file, end, capacity, key, text), capacity)
    return fewer(found.select(F.when(~F.col("none"), F.col("key")).alias(key), "piece", "start", "length", "ids_crc32", "sequence_id", "offset"))


def op9_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each piece of each document. Null and empty texts are one piece of length 1; repeated ids stay separate
    documents; a null id stays null; no documents give no rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return packed_documents(docs, vocabulary("word_bpe_49k.json"), 1)
