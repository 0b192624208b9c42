"""Operator 6: token ids in files of a static range asymmetric numeral system."""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import cache
from typing import BinaryIO

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from listwright.llm.common import dropped, fewer, fresh_dir, opened, tune, written
from listwright.llm.tokens import IDS, encoder, vocabulary

#: Frequencies sum to 2^SCALE; states lie in [2^LOW, 2^(LOW + 32)) and shed 32 bits at a time.
SCALE, LOW = 20, 31
#: Ids of a block, lanes that are interleaved in a full block, ids of one file, and blocks that one task of a reader decodes.
BLOCK, LANES, FILE_IDS, UNIT_BLOCKS = 1 << 19, 4096, 1 << 24, 4
#: Bytes of texts whose ids are made together, and a text more at most.
GATHERED = 4 << 20
MAGIC, TABLE_MAGIC = b"LWRANS2\n", b"LWFREQ1\n"
_MARK = struct.Struct("<QQIIII")  # checkpoint: byte offset, first id in the file, ids, bytes, lanes, crc of the ids
_TAIL = struct.Struct("<QIIIII8s")  # documents, blocks, bytes of the directory, its ids' width, crc of the table, crc of directory and checkpoints, magic


class Damaged(ValueError):
    """A checksum or a length of the format does not hold."""


def frequencies(counts: np.ndarray) -> np.ndarray:
    """Integer frequencies that sum to 2^SCALE, at least 1 for each id that occurs."""
    seen = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.int64)
    if not len(seen):
        return out
    if len(seen) > 1 << SCALE:
        raise ValueError("more ids than the scale has slots")
    exact = counts[seen] / counts[seen].sum() * (1 << SCALE)
    share = np.maximum(1, np.floor(exact)).astype(np.int64)
    order = np.lexsort((seen, -(exact - share)))
    while (spare := (1 << SCALE) - int(share.sum())) != 0:
        if spare > 0:
            share[order[: min(spare, len(order))]] += 1
        else:
            large = np.lexsort((seen, -share))
            large = large[share[large] > 1][: max(1, min(-spare, len(seen) // 16 + 1))]
            share[large] -= 1
    out[seen] = share
    return out


class Table:
    """The shared table: frequency, start and the id of each slot."""

    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(np.uint64)
        self.start = np.concatenate(([0], np.cumsum(freq)))[:-1].astype(np.uint64)
        self.id_of = np.repeat(np.arange(len(freq)), freq).astype(np.uint32)

    def packed(self) -> bytes:
        body = zlib.compress(self.freq.astype("<u4").tobytes())
        return TABLE_MAGIC + struct.pack("<II", len(self.freq), zlib.crc32(body)) + body

    @staticmethod
    def unpacked(data: bytes) -> Table:
        n, crc = struct.unpack_from("<II", data, 8)
        if data[:8] != TABLE_MAGIC or zlib.crc32(data[16:]) != crc:
            raise Damaged("frequency table")
        freq = np.frombuffer(zlib.decompress(data[16:]), "<u4").astype(np.int64)
        if len(freq) != n or freq.sum() not in (0, 1 << SCALE):
            raise Damaged("frequency table")
        return Table(freq)


def encode_block(ids: np.ndarray, table: Table) -> tuple[bytes, int]:
    """(bytes, lanes): id i belongs to lane i mod lanes. The final states come first, then the words in reading order."""
    lanes = int(min(LANES, max(1, len(ids) // 128)))
    state = np.full(lanes, 1 << LOW, np.uint64)
    words: list[np.ndarray] = []
    for at in range((len(ids) - 1) // lanes * lanes, -1, -lanes):
        row = ids[at : at + lanes]
        f, c, x = table.freq[row], table.start[row], state[: len(row)]
        full = x >= f << np.uint64(LOW + 32 - SCALE)
        words.append((x[full] & np.uint64(0xFFFFFFFF)).astype("<u4"))
        x = np.where(full, x >> np.uint64(32), x)
        q = x // f
        state[: len(row)] = (q << np.uint64(SCALE)) + (x - q * f) + c
    return state.astype("<u8").tobytes() + np.concatenate(words[::-1] or [np.zeros(0, "<u4")]).tobytes(), lanes


def decode_block(data: bytes, n: int, lanes: int, table: Table) -> np.ndarray:
    if len(data) < 8 * lanes or (len(data) - 8 * lanes) % 4:
        raise Damaged("block length")
    state = np.frombuffer(data, "<u8", lanes).astype(np.uint64)
    words = np.frombuffer(data, "<u4", offset=8 * lanes)
    out, read, mask = np.empty(n, np.uint32), 0, np.uint64((1 << SCALE) - 1)
    for at in range(0, n, lanes):
        k = min(lanes, n - at)
        x = state[:k]
        slot = x & mask
        ids = table.id_of[slot]
        out[at : at + k] = ids
        x = table.freq[ids] * (x >> np.uint64(SCALE)) + slot - table.start[ids]
        low = np.flatnonzero(x < np.uint64(1 << LOW))
        if read + len(low) > len(words):
            raise Damaged("block ends early")
        x[low] = (x[low] << np.uint64(32)) | words[read : read + len(low)]
        read += len(low)
        state[:k] = x
    if read != len(words) or (state != np.uint64(1 << LOW)).any():
        raise Damaged("block does not end where it began")
    return out


class Writer:
    """A file: magic, blocks, directory (keys with their ids' counts), checkpoints of the blocks, tail. Blocks go out as they
    fill, so a writer holds a block and the documents that are put in, whatever the file's size."""

    def __init__(self, out: BinaryIO, table: Table, table_crc: int):
        self.out, self.table, self.table_crc = out, table, table_crc
        self.held, self.waiting, self.ids, self.at = [], 0, 0, len(MAGIC)
        self.keys, self.sizes, self.marks = [], [], []
        out.write(MAGIC)

    def put(self, key: int, ids: bytes) -> None:
        """A document's ids, one at least, as little-endian 16-bit numbers."""
        if not ids:
            raise ValueError("a document without ids")
        self.keys.append(key)
        self.sizes.append(len(ids) // 2)
        self.held.append(ids)
        self.waiting += len(ids) // 2
        if self.waiting >= BLOCK:
            rest = np.frombuffer(b"".join(self.held), IDS)
            whole = len(rest) // BLOCK * BLOCK
            for i in range(0, whole, BLOCK):
                self._block(rest[i : i + BLOCK])
            self.held, self.waiting = [rest[whole:].tobytes()], len(rest) - whole

    def _block(self, ids: np.ndarray) -> None:
        data, lanes = encode_block(ids, self.table)
        self.marks.append(_MARK.pack(self.at, self.ids, len(ids), len(data), lanes, zlib.crc32(ids.astype("<u4").tobytes())))
        self.out.write(data)
        self.at, self.ids = self.at + len(data), self.ids + len(ids)

    def close(self) -> tuple[int, int, int, int]:
        """(documents, ids, blocks, bytes) of the file."""
        if self.waiting:
            self._block(np.frombuffer(b"".join(self.held), IDS))
        directory = zlib.compress(np.array(self.keys, "<i8").tobytes() + np.array(self.sizes, "<u8").tobytes())
        index = directory + b"".join(self.marks)
        tail = _TAIL.pack(len(self.keys), len(self.marks), len(directory), IDS.itemsize, self.table_crc, zlib.crc32(index), MAGIC)
        self.out.write(index + tail)
        self.out.close()
        return len(self.keys), self.ids, len(self.marks), self.at + len(index) + len(tail)


class Reader:
    """Any block of a file by its checkpoint alone, and any document by the directory."""

    def __init__(self, f: BinaryIO, size: int, table: Table, table_crc: int | None = None):
        self.f, self.table = f, table
        if size < len(MAGIC) + _TAIL.size:
            raise Damaged("file is too short")
        n, blocks, length, width, crc, own, magic = _TAIL.unpack(self._bytes(size - _TAIL.size, _TAIL.size))
        begin = size - _TAIL.size - length - blocks * _MARK.size
        if magic != MAGIC or width != IDS.itemsize or begin < len(MAGIC) or table_crc not in (None, crc):
            raise Damaged("tail, or another frequency table")
        index = self._bytes(begin, length + blocks * _MARK.size)
        if zlib.crc32(index) != own:
            raise Damaged("directory")
        plain = zlib.decompress(index[:length])
        self.keys, self.sizes = np.frombuffer(plain, "<i8", n), np.frombuffer(plain, "<u8", n, 8 * n).astype(np.int64)
        self.marks = [_MARK.unpack_from(index, length + i * _MARK.size) for i in range(blocks)]
        self.starts = np.cumsum(self.sizes) - self.sizes
        if int(self.sizes.sum()) != sum(m[2] for m in self.marks):
            raise Damaged("directory and checkpoints differ")

    def _bytes(self, at: int, n: int) -> bytes:
        self.f.seek(at)
        return self.f.read(n)

    def block(self, i: int) -> np.ndarray:
        at, _, n, size, lanes, crc = self.marks[i]
        ids = decode_block(self._bytes(at, size), n, lanes, self.table)
        if zlib.crc32(ids.astype("<u4").tobytes()) != crc:
            raise Damaged(f"block {i}")
        return ids

    def documents(self, first: int, blocks: int) -> Iterator[tuple[int, int, np.ndarray]]:
        """(key, place of the first id in the file, ids) of the documents that begin in `blocks` blocks from the first-th on.
        Held are one block and one document."""
        if first >= len(self.marks):
            return
        now, at = first, self.marks[first][1]
        end = self.marks[first + blocks][1] if first + blocks < len(self.marks) else at + sum(m[2] for m in self.marks[first:])
        lo, hi = np.searchsorted(self.starts, (at, end))
        held = self.block(now)
        for key, size, start in zip(self.keys[lo:hi].tolist(), self.sizes[lo:hi].tolist(), self.starts[lo:hi].tolist(), strict=True):
            held, at = held[start - at :], start
            parts, have = [held], len(held)
            while have < size:
                now += 1
                parts.append(self.block(now))
                have += len(parts[-1])
            if len(parts) > 1:
                held = np.concatenate(parts)
            yield key, start, held[:size]


@cache
def _table(path: str) -> tuple[Table, int]:
    with opened(path, "r") as f:
        data = f.read()
    return Table.unpacked(data), zlib.crc32(data)


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows in batches of GATHERED bytes of text, and a row more at most: what texts have in common is looked up once."""
    held, size = [], 0
    for b in batches:
        long = pc.binary_length(b.column("text")).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        begins = np.flatnonzero(np.diff((np.cumsum(long) - long) // GATHERED, prepend=-1)).tolist()
        for i, j in zip(begins, [*begins[1:], len(b)], strict=False):
            held.append(b.slice(i, j - i))
            size += int(long[i:j].sum())
            if size >= GATHERED:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def tokenized(docs: DataFrame, path: str, key: str, text: str, file: str, end: int) -> DataFrame:
    """(none, key, ids, turn, counts) in a table written to path: the ids of each text and the end id as bytes, made where
    the texts are read; none tells a null key, turn tells equal rows apart. A row of counts alone, the last of each
    task that saw a document, holds how often the task's documents have each id."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, counts, names = encoder(file).rows, None, ["none", "key", "ids", "turn", "counts"]
        for b in _gathered(batches):
            bounds, ids = rows(b.column("text"), end)
            found = np.bincount(ids, minlength=1 << 16)
            counts = found if counts is None else counts + found
            held = pa.Array.from_buffers(pa.binary(), len(b), [None, pa.py_buffer((bounds * IDS.itemsize).astype(np.int32)), pa.py_buffer(ids)])
            yield pa.record_batch([b.column("none"), b.column("key"), held, b.column("turn"), pa.nulls(len(b), pa.binary())], names=names)
        if counts is not None:
            yield pa.record_batch([pa.array([False]), pa.array([0]), pa.array([None], pa.binary()), pa.array([0]), pa.array([counts.astype("<i8").tobytes()])], names=names)

    at = F.col(f"`{key}`").cast("long")
    rows = docs.select(F.coalesce(at, F.lit(0)).alias("key"), at.isNull().alias("none"), F.col(f"`{text}`").alias("text"), F.monotonically_increasing_id().alias("turn"))
    shape = "none boolean, key long, ids binary, turn long, counts binary"
    fewer(rows.mapInArrow(each, shape)).write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(shape).parquet(path)


def write_files(docs: DataFrame, path: str, file: str, end: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode the ids of all texts, in ascending order of the key, into files below path; returns their manifest (path,
    first, docs, n, blocks, bytes), itself a written table. first is the place of a file's first id in the corpus.

    Frequencies are counted over all ids and shared by all files. The ids, not the texts, are sorted by ranges of (key,
    hash of the ids, row), so a key that repeats is dealt to many tasks. Every task writes files under names of its own
    and the manifest lists those of the tasks that ended well, so a lost executor leaves at worst files that nobody reads.
    A null text is an end id alone; a null key comes first, as key 0 (the format's keys are numbers). Repeated keys stay
    separate, in the order of a hash of their ids. No documents: a manifest without rows."""
    spark = docs.sparkSession
    tune(spark)
    ids_path = fresh_dir(spark, "ids")
    rows = tokenized(docs, ids_path, key, text, file, end)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros(1 << 16, np.int64)
        for b in batches:
            for x in b["counts"]:
                sums += np.frombuffer(x, "<i8")
        at = np.flatnonzero(sums)
        yield pd.DataFrame({"id": at, "n": sums[at]})

    found = rows.where("counts is not null").select("counts").mapInPandas(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(max([end, *found["id"]]) + 1, np.int64)
    counts[found["id"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    table_path = f"{path}/table.freq"
    packed = Table(frequencies(counts)).packed()
    spark.createDataFrame([(bytearray(packed),)], "data binary").coalesce(1).mapInPandas(_putter(table_path), "size long").collect()

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, turn, writer, name = 0, 0, None, ""

        def over() -> pd.DataFrame:
            docs, n, blocks, size = writer.close()
            return pd.DataFrame({"part": [part], "turn": [turn], "path": [name], "docs": [docs], "n": [n], "blocks": [blocks], "bytes": [size]})

        for b in batches:
            for part, k, ids in zip(b["part"].tolist(), b["key"].tolist(), b["ids"], strict=True):  # one part: the range
                if writer is None:
                    name = f"{path}/{uuid.uuid4().hex}.rans"
                    writer = Writer(opened(name, "w"), *_table(table_path))
                writer.put(k, ids)
                if writer.ids + writer.waiting >= FILE_IDS:
                    yield over()
                    writer, turn = None, turn + 1
        if writer is not None:
            yield over()

    order = [F.col("none").desc(), F.col("key"), F.xxhash64("ids"), F.col("turn")]
    ranges = rows.where("counts is null").select("none", "key", "ids", "turn").repartitionByRange(*order).sortWithinPartitions(*order)
    ranges = ranges.select(F.spark_partition_id().alias("part"), "key", "ids")
    files = written(ranges.mapInPandas(encode, "part int, turn int, path string, docs long, n long, blocks int, bytes long"), "rans-files")
    dropped(spark, ids_path)
    before = Window.orderBy("part", "turn").rowsBetween(Window.unboundedPreceding, -1)  # a row a file
    return files.select("path", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"), "docs", "n", "blocks", "bytes")


def _putter(path: str):
    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for data in b["data"]:
                with opened(path, "w") as f:
                    f.write(bytes(data))
                yield pd.DataFrame({"size": [len(data)]})

    return put


def read_files(manifest: DataFrame, path: str) -> DataFrame:
    """(key, start, ids as little-endian 32-bit numbers) of every document in the manifest's files. A task decodes up to
    UNIT_BLOCKS blocks of a file, from their checkpoints, and the documents that begin in them."""
    table_path = f"{path}/table.freq"

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, size, base, begin in zip(b["path"], b["bytes"], b["first"], b["begin"], strict=True):
                with opened(name, "r") as f:
                    held, n = [], 0
                    for key, at, ids in Reader(f, int(size), *_table(table_path)).documents(int(begin), UNIT_BLOCKS):
                        held.append((key, base + at, ids.astype("<u4").tobytes()))
                        n += len(ids)
                        if len(held) == 256 or n >= BLOCK:
                            yield pd.DataFrame(held, columns=["key", "start", "ids"])
                            held, n = [], 0
                    if held:
                        yield pd.DataFrame(held, columns=["key", "start", "ids"])

    units = manifest.select("path", "bytes", "first", F.explode(F.expr(f"sequence(0, greatest(blocks, 1) - 1, {UNIT_BLOCKS})")).alias("begin"))
    parts = manifest.agg(F.sum(F.ceil(F.col("blocks") / UNIT_BLOCKS))).first()[0] or 1
    return units.repartition(min(int(parts), 65536), "path", "begin").mapInPandas(each, "key long, start long, ids binary")


def op6_rans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document, read back from the files. Null texts are the end id alone; repeated ids of documents stay
    separate rows, a null one reads back as 0; no documents give no rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    path = fresh_dir(spark, "rans")
    manifest = write_files(docs, path, vocabulary("byte_bpe_50k.json"), 2)
    back = read_files(manifest, path)
    return fewer(back.select(F.col("key").alias("doc_id"), "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32")))
