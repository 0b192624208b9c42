"""Operator 4: WARC archives with revisit records, and a reader that salvages what it can."""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO, NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listwright.llm.common import fewer, forgotten, fresh_dir, opened, tune, written

VERSION, DATE = "WARC/1.1", "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payloads of fewer bytes are never replaced by a revisit; bytes of an archive after which a task begins another.
LEAST_REVISIT, ARCHIVE_BYTES = 100, 32 << 20
CHUNK = 1 << 20


class Bad(ValueError):
    """What stands at a place is no whole record."""


class Found(NamedTuple):
    """A record (problem None) or a quarantined gap, with its place and length in the archive's bytes."""

    at: int
    size: int
    problem: str | None
    headers: dict[str, str]
    block: bytes


def _line(name: str, value: str) -> str:
    return f"{name}: {''.join(c if c >= ' ' else f'%{ord(c):02X}' for c in value)}\r\n"


def record_urn(key: int | None) -> str:
    return f"<urn:listwright:page:{'none' if key is None else key}>"


def record(key: int | None, url: str | None, payload: bytes, refers_to: int | None = None, date: str = DATE) -> bytes:
    """A response record, or a revisit of another page's record with the HTTP head alone (its Content-Length is that of
    the payload left out)."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = f"{VERSION}\r\n" + _line("WARC-Type", "revisit" if refers_to is not None else "response") + _line("WARC-Record-ID", record_urn(key)) + _line("WARC-Date", date)
    if url is not None:
        head += _line("WARC-Target-URI", url)
    if key is not None:
        head += _line("X-Page-ID", str(key))
    head += _line("WARC-Payload-Digest", "sha256:" + hashlib.sha256(payload).hexdigest())
    if refers_to is not None:
        head += _line("WARC-Profile", PROFILE) + _line("WARC-Refers-To", record_urn(refers_to)) + _line("X-Refers-To-Page-ID", str(refers_to))
    head += _line("Content-Type", "application/http; msgtype=response") + _line("WARC-Block-Digest", "sha256:" + hashlib.sha256(block).hexdigest())
    return (head + _line("Content-Length", str(len(block))) + "\r\n").encode() + block + b"\r\n\r\n"


def member(data: bytes, level: int = 6) -> bytes:
    """A record as one gzip member, with nothing in it that changes from run to run."""
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _record_in(read, at: int, end: int) -> tuple[dict[str, str], bytes, int]:
    """(headers, block, length) of the plain record at a place; read(at, n) gives up to n bytes. A head may be of any length."""
    n = 1 << 12
    while (stop := (head := read(at, n)).find(b"\r\n\r\n")) < 0:
        if not head.startswith(b"WARC/"):
            raise Bad("no version line")
        if len(head) < n:
            raise Bad("record head does not end")
        n *= 4
    first, *lines = head[:stop].split(b"\r\n")
    if not first.startswith(b"WARC/"):
        raise Bad("no version line")
    headers = {}
    for line in lines:
        name, colon, value = line.partition(b":")
        if not colon:
            raise Bad("header line without a name")
        headers[name.decode("utf-8", "replace").strip()] = value.decode("utf-8", "replace").strip()
    size = headers.get("Content-Length", "")
    if not size.isdecimal() or at + stop + 8 + int(size) > end:
        raise Bad("content length missing or beyond the end")
    block = read(at + stop + 4, int(size) + 4)
    if block[-4:] != b"\r\n\r\n":
        raise Bad("record does not end where its length says")
    block = block[:-4]
    _check(headers.get("WARC-Block-Digest"), block, "block")
    payload = payload_of(headers, block)
    if payload is not None:
        _check(headers.get("WARC-Payload-Digest"), payload, "payload")
    return headers, block, stop + 8 + int(size)


def _check(digest: str | None, data: bytes, what: str) -> None:
    kind, _, value = (digest or "").partition(":")
    if kind in ("sha256", "sha1", "md5") and len(value) == 2 * hashlib.new(kind).digest_size and hashlib.new(kind, data).hexdigest() != value.lower():
        raise Bad(f"{what} digest")


def _digested(headers: dict[str, str]) -> bool:
    kind, _, value = headers.get("WARC-Block-Digest", "").partition(":")
    return kind in ("sha256", "sha1", "md5") and len(value) == 2 * hashlib.new(kind).digest_size


def payload_of(headers: dict[str, str], block: bytes) -> bytes | None:
    """The HTTP body of a response; the block of other records that hold their payload; None for a revisit."""
    if headers.get("WARC-Type") == "revisit":
        return None
    if headers.get("Content-Type", "").startswith("application/http"):
        return block.partition(b"\r\n\r\n")[2]
    return block


def _member_at(f: BinaryIO, at: int) -> tuple[bytes, int, str | None]:
    """(content, length, problem) of the gzip member at a place; its checksum and length must hold. With a problem, the
    content is what decompresses before it."""
    f.seek(at)
    z, out, read, problem = zlib.decompressobj(31), [], 0, None
    while not z.eof and problem is None:
        chunk = f.read(CHUNK)
        if not chunk:
            problem = "member ends early"
            break
        read += len(chunk)
        before = z.copy()
        try:
            out.append(z.decompress(chunk))
        except zlib.error:
            problem = "member is damaged"
            out.append(_until_damage(before, chunk))
    return b"".join(out), read - len(z.unused_data), problem


def _until_damage(z, chunk: bytes) -> bytes:
    """What a chunk gives before it fails, by smaller and smaller steps."""
    out, at, step = [], 0, 1 << 12
    while step:
        before = z.copy()
        try:
            out.append(z.decompress(chunk[at : at + step]))
            at += step
        except zlib.error:
            z, step = before, step >> 4
    return b"".join(out)


def _inside(data: bytes, at: int, size: int, problem: str | None) -> Iterator[Found]:
    """The records of a member's content, and a gap of length 0 for each stretch between that is none. The search goes on
    at the next version line. In a damaged member only records whose digest holds are known to be whole."""
    i, gap = 0, None
    while i < len(data):
        try:
            headers, block, n = _record_in(lambda a, k: data[a : a + k], i, len(data))
            if problem == "member is damaged" and not _digested(headers):
                raise Bad("record without a digest in a damaged member")
        except Bad as e:
            gap = gap or str(e)
            i = data.find(b"WARC/", i + 1)
            if i < 0:
                break
            continue
        if gap:
            yield Found(at, 0, gap, {}, b"")
            gap = None
        yield Found(at, size, None, headers, block)
        i += n
    if gap and not problem:  # the rest of a member with a problem is in its own gap
        yield Found(at, 0, gap, {}, b"")


def _next_start(f: BinaryIO, at: int, end: int) -> int:
    """The next place from which a member or a version line might begin; the end if there is none."""
    while at < end:
        f.seek(at)
        data = f.read(CHUNK + 8)
        best = len(data)
        i = data.find(b"\x1f\x8b\x08")
        while 0 <= i < best:
            if i + 3 >= len(data) or data[i + 3] & 0xE0 == 0:
                best = i
            i = data.find(b"\x1f\x8b\x08", i + 1)
        i = data.find(b"WARC/")
        if 0 <= i < best:
            best = i
        if best < len(data):
            return at + best
        at += CHUNK
    return end


def salvage(f: BinaryIO, end: int) -> Iterator[Found]:
    """All whole records of an archive of `end` bytes (gzip members, plain records or both), and the gaps between them.

    Checked are members' checksums, heads, lengths and digests. After a failure the next member or version line that
    passes all checks goes on; the bytes before it are one gap, with the first problem met. Every byte of the archive
    belongs to one record or gap (records of one member share the member's place). Inside a member the search goes on at
    the next version line; what is lost there is a gap of length 0 at the member's place. Of a damaged member the
    records before the damage are kept, with length 0, since its bytes are a gap. Memory: one record or member."""

    def plain(at: int, n: int) -> bytes:
        f.seek(at)
        return f.read(n)

    at, gap, problem = 0, None, ""
    while at < end:
        try:
            mark = plain(at, 5)
            if mark[:3] == b"\x1f\x8b\x08":
                data, size, trouble = _member_at(f, at)
                found = list(_inside(data, at, 0 if trouble else size, trouble))
                if trouble:
                    if any(x.problem is None for x in found):
                        if gap is not None:
                            yield Found(gap, at - gap, problem, {}, b"")
                        gap, problem = at, trouble
                        yield from found
                    raise Bad(trouble)
                if not any(x.problem is None for x in found):
                    raise Bad(found[0].problem if found else "member is empty")
            elif mark == b"WARC/":
                headers, block, size = _record_in(plain, at, end)
                found = [Found(at, size, None, headers, block)]
            else:
                raise Bad("neither member nor version line")
        except Bad as e:
            if gap is None:
                gap, problem = at, str(e)
            at = _next_start(f, at + 1, end)
            continue
        if gap is not None:
            yield Found(gap, at - gap, problem, {}, b"")
            gap = None
        yield from found
        at += size
    if gap is not None:
        yield Found(gap, end - gap, problem, {}, b"")


def revisits(pages: DataFrame, key: str, html: str, least: int = LEAST_REVISIT) -> DataFrame:
    """(id, digest, refers_to) of the pages whose payload a page of a smaller key has too."""
    payload = F.encode(F.coalesce(F.col(f"`{html}`"), F.lit("")), "UTF-8")
    narrow = pages.select(F.col(f"`{key}`").alias("id"), F.sha2(payload, 256).alias("digest"), F.octet_length(payload).alias("n")).where(F.col("n") >= least)
    narrow = written(narrow.select("id", "digest"), "warc-digests")
    first = narrow.groupBy("digest").agg(F.min("id").alias("refers_to"), F.count(F.lit(1)).alias("k")).where("k > 1").drop("k")
    found = narrow.join(first, "digest").where("refers_to is not null and not (id <=> refers_to)").select("id", "digest", "refers_to").distinct()
    return written(found, "warc-revisits")  # its size is known then: Spark broadcasts it if small, else payloads are shuffled


def write_archives(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """A record for each page, in gzip members, in archives below path; returns their manifest (path, bytes, records), a
    written table that names the archives of tasks that ended well only.

    A payload is the html in UTF-8, null: empty. Among equal payloads of 100 bytes or more the smallest key's page is the
    response and the others revisit it. Pages that repeat that key are all responses; pages with a null key revisit it,
    or are responses where no key is known. Pages are dealt out by key, so equal payloads don't meet in one task."""
    tune(pages.sparkSession)
    payload = F.encode(F.coalesce(F.col(f"`{html}`"), F.lit("")), "UTF-8")
    rows = pages.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{url}`").alias("url"), payload.alias("payload"), F.sha2(payload, 256).alias("digest"))
    refs = revisits(pages, key, html)
    known = refs.withColumnRenamed("id", "rid").withColumnRenamed("digest", "rdigest")
    rows = rows.join(known, (F.col("digest") == F.col("rdigest")) & F.col("id").eqNullSafe(F.col("rid")), "left").select("id", "url", "payload", "refers_to")

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, name, size, records = None, "", 0, 0
        for b in batches:
            for k, u, p, r in zip(b["id"], b["url"], b["payload"], b["refers_to"], strict=True):
                if out is None:
                    name, size, records = f"{path}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = opened(name, "w")
                data = member(record(None if pd.isna(k) else int(k), u, bytes(p), None if pd.isna(r) else int(r)))
                out.write(data)
                size, records = size + len(data), records + 1
                if size >= ARCHIVE_BYTES:
                    out.close()
                    out = None
                    yield pd.DataFrame({"path": [name], "bytes": [size], "records": [records]})
        if out is not None:
            out.close()
            yield pd.DataFrame({"path": [name], "bytes": [size], "records": [records]})

    manifest = written(fewer(rows).mapInPandas(each, "path string, bytes long, records long"), "warc-manifest")
    forgotten(refs)
    return manifest


def read_archives(manifest: DataFrame) -> DataFrame:
    """(path, at, size, problem, headers, payload, length) of the archives that manifest (path, bytes) names, an archive a
    task: records, and gaps with their problem. payload is null for a revisit, length its payload's in either case."""
    tune(manifest.sparkSession)
    names = ["path", "at", "size", "problem", "headers", "payload", "length"]

    def length(x: Found, payload: bytes | None) -> int | None:
        if payload is not None:
            return len(payload)
        for line in x.block.split(b"\r\n"):
            if line.lower().startswith(b"content-length:"):
                return int(line[15:])
        return None

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, end in zip(b["path"], b["bytes"].tolist(), strict=True):
                with opened(path, "r") as f:
                    held, size = [], 0
                    for x in salvage(f, end):
                        payload = None if x.problem else payload_of(x.headers, x.block)
                        held.append((path, x.at, x.size, x.problem, x.headers, payload, None if x.problem else length(x, payload)))
                        size += len(x.block)
                        if size > 4 * CHUNK or len(held) == 512:
                            yield pd.DataFrame(held, columns=names).astype({"length": "Int64"})
                            held, size = [], 0
                    if held:
                        yield pd.DataFrame(held, columns=names).astype({"length": "Int64"})

    files = max(1, manifest.count())
    shape = "path string, at long, size long, problem string, headers map<string,string>, payload binary, length long"
    return manifest.select("path", "bytes").repartition(min(files, 4096), "path").mapInPandas(each, shape)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A revisit's length and digest are those its record states; a response's are taken from the payload. What the reader
    quarantines is logged beside the archives, and the query raises if there is any or a page is not read back. Null
    html is an empty payload; repeated ids stay separate records; no pages give no rows."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    path = fresh_dir(spark, "warc")
    manifest = write_archives(pages, path)
    stated = F.substring_index(F.col("headers")["WARC-Payload-Digest"], ":", -1)
    back = written(read_archives(manifest).select(
        F.col("headers")["X-Page-ID"].cast("long").alias("page_id"), F.col("length").alias("payload_bytes"),
        F.coalesce(F.sha2("payload", 256), stated).alias("payload_digest"), F.col("headers")["WARC-Type"].alias("record_type"),
        F.col("headers")["X-Refers-To-Page-ID"].cast("long").alias("refers_to"), F.col("headers")["WARC-Target-URI"].alias("url"), "problem", "path", "at", "size",
    ), "warc-read")
    whole(back, pages.count(), f"{path}/gaps")
    return back.drop("problem", "path", "at", "size")


def whole(back: DataFrame, records: int, log: str) -> None:
    """Raise unless what was read (path, at, size, problem) are so many records and no gap. Gaps are written to the log, a
    table of (path, at, size, problem), first."""
    n = back.agg(F.count(F.lit(1)).alias("rows"), F.count("problem").alias("gaps")).first()
    if n["gaps"]:
        back.where("problem is not null").select("path", "at", "size", "problem").write.parquet(log)
    if n["gaps"] or n["rows"] != records:
        raise RuntimeError(f"{records} records were written, {n['rows'] - n['gaps']} and {n['gaps']} gaps were read; the gaps are listed in {log}")


#: What op4_warc must return, in DuckDB SQL over pages.
OP4_SQL = """
WITH p AS (
  SELECT page_id, url, coalesce(html, '') AS t FROM pages
), d AS (
  SELECT page_id, url, strlen(t) AS n, sha256(t) AS digest FROM p
), f AS (
  SELECT digest, min(page_id) AS first_id FROM d WHERE n >= 100 GROUP BY digest
)
SELECT d.page_id, CAST(d.n AS BIGINT) AS payload_bytes, d.digest AS payload_digest,
       CASE WHEN f.first_id IS NULL OR f.first_id = d.page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN f.first_id = d.page_id THEN NULL ELSE f.first_id END AS refers_to, d.url
FROM d LEFT JOIN f ON d.digest = f.digest AND d.n >= 100
"""
