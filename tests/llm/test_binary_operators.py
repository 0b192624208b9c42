"""Operators 2, 4 and 10: links, archives, media."""

import hashlib
import io
import random
import zlib

import duckdb
import numpy as np
import pytest

from listwright.llm import mpeg, vectors, warc
from listwright.llm.common import fresh_dir
from listwright.llm.queries import ORACLE_SQL, QUERIES


def exact_links(ids, labels, raw):
    n = len(ids)
    x = raw / np.linalg.norm(raw, axis=1, keepdims=True)
    near = (x @ x.T >= 0.98) & (labels[:, None] == labels[None])
    np.fill_diagonal(near, False)
    comp = np.arange(n)
    while True:
        new = np.array([min([comp[i], *comp[near[i]]]) for i in range(n)])
        if (new == comp).all():
            return near.sum(axis=1), ids[comp]
        comp = new


def test_vectors_near_copies(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(150, 16))
    raw = np.concatenate((base, base[:60] + 0.02 * rng.normal(size=(60, 16)), base[0] + 0.02 * rng.normal(size=(120, 16)), base[5:8]))
    labels = rng.integers(0, 2, len(raw))
    labels[150:] = np.concatenate((labels[:60], np.full(120, labels[0]), labels[5:8]))
    rows = [(i, [float(v) for v in x], int(k)) for i, (x, k) in enumerate(zip(raw, labels, strict=True))]
    bad = [(900, None, 0), (901, [0.0] * 16, 0), (902, [float("nan")] * 16, 0), (903, [None] + [1.0] * 15, 0), (904, list(map(float, base[0])), None), (None, list(map(float, base[0])), int(labels[0]))]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: r for r in vectors.near_duplicate_vectors(df).collect()}
    n, comp = exact_links(np.arange(len(raw)), labels, raw)
    assert [got[i]["n_links"] for i in range(len(raw))] == n.tolist() and [got[i]["component_id"] for i in range(len(raw))] == comp.tolist()
    assert all(got[i]["kept"] == (comp[i] == i) for i in range(len(raw)))
    assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i for i in (900, 901, 902, 903, 904)) and got[None]["kept"] is False
    assert vectors.near_duplicate_vectors(df.limit(0)).count() == 0


def test_vectors_in_shards_and_units(spark, monkeypatch):
    """Many shards, and shards dealt out as pairs of groups."""
    monkeypatch.setattr(vectors, "SHARD_ROWS", 60)
    monkeypatch.setattr(vectors, "UNIT_ROWS", 640)
    rng = np.random.default_rng(3)
    base = rng.normal(size=(300, 16))
    raw = np.concatenate((base, base + 0.02 * rng.normal(size=base.shape), base[0] + 0.02 * rng.normal(size=(700, 16))))
    df = spark.createDataFrame([(i, [float(v) for v in x], 1) for i, x in enumerate(raw)], "vec_id long, embedding array<double>, label int")
    got = vectors.near_duplicate_vectors(df).orderBy("vec_id").collect()
    n, comp = exact_links(np.arange(len(raw)), np.ones(len(raw)), raw)
    found = np.array([r["n_links"] for r in got])
    assert (found <= n).all() and found.sum() >= 0.97 * n.sum() and got[0]["audit_recall"] >= 0.97
    assert (np.array([r["component_id"] for r in got]) == comp).mean() >= 0.97


def test_vectors_query_against_brute_force(spark, sf):
    """The registered query on a whole table, and on one with the same vectors turned into near copies."""
    rows = sorted(spark.read.parquet(f"{sf}/embeddings.parquet").collect(), key=lambda r: r["vec_id"])
    got = {r["vec_id"]: r for r in QUERIES["op2_vectors"](spark, sf).collect()}
    ids, labels, raw = np.array([r["vec_id"] for r in rows]), np.array([r["label"] for r in rows]), np.array([r["embedding"] for r in rows], float)
    n, comp = exact_links(ids, labels, raw)
    assert [got[i]["n_links"] for i in ids] == n.tolist() and [got[i]["component_id"] for i in ids] == comp.tolist() and all(got[i]["kept"] == (c == i) for i, c in zip(ids, comp, strict=True))


def test_exact_way_where_searches_fail(spark, monkeypatch, tmp_path):
    """With graphs that hold no edges the audit sees the loss, and all pairs are compared."""
    rng = np.random.default_rng(9)
    base = rng.normal(size=(120, 16))
    raw = np.concatenate((base, base[:50] + 0.02 * rng.normal(size=(50, 16)), base[0] + 0.02 * rng.normal(size=(300, 16))))
    rows = spark.createDataFrame([(i, [float(v) for v in x], i % 2, "clash") for i, x in enumerate(raw)], "vec_id long, embedding array<double>, label int, rid string")
    monkeypatch.setattr(vectors, "UNIT_ROWS", 640)
    monkeypatch.setattr(vectors, "SHARD_ROWS", 60)
    monkeypatch.setattr(vectors, "_linked", lambda reps, least, overlap: vectors._compared(reps, 2.0))
    rows.union(rows.where("vec_id = 3")).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = sorted(vectors.op2_vectors(spark, str(tmp_path)).collect(), key=lambda r: r["vec_id"])
    ids = np.array([r["vec_id"] for r in got])
    n, comp = exact_links(ids, ids % 2, raw[ids])
    assert len(got) == 471 and [r["n_links"] for r in got] == n.tolist() and [r["component_id"] for r in got] == comp.tolist() and got[0]["audit_recall"] == 1.0


def test_range_search_on_the_graph():
    rng = np.random.default_rng(4)
    x = vectors.unit(np.concatenate((rng.normal(size=(500, 8)), np.ones(8) + 0.05 * rng.normal(size=(80, 8)))))
    graph = vectors._padded(vectors.robust_graph(x))
    found = vectors.range_search(x, graph, np.arange(len(x)), 0.9)
    want = x @ x.T >= 0.9
    assert not (found & ~want).any() and (found & want).sum() >= 0.95 * want.sum()


def test_warc_query_equals_its_sql(spark, sf):
    duckdb.sql(f"CREATE OR REPLACE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    want = duckdb.sql(ORACLE_SQL["op4_warc"]).df().sort_values("page_id", ignore_index=True)
    got = QUERIES["op4_warc"](spark, sf).toPandas().sort_values("page_id", ignore_index=True)[list(want.columns)]
    assert len(got) == len(want) == 50
    assert all((got[c].fillna(-1) == want[c].fillna(-1)).all() for c in want.columns)


def test_warc_odd_pages(spark):
    long = "x" * 500
    rows = [(3, "http://a/\r\nX: 1", long), (1, None, long), (1, None, long), (2, "u", "short"), (4, "u", "short"), (None, "n", long), (5, "e", None), (6, "é", "é" * 60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    back = warc.read_archives(warc.write_archives(pages, fresh_dir(spark, "warc-test"))).collect()
    assert not any(r["problem"] for r in back) and len(back) == 8
    by = sorted((str(r["headers"].get("X-Page-ID")), r["headers"]["WARC-Type"], r["headers"].get("X-Refers-To-Page-ID"), r["length"]) for r in back)
    assert by == [("1", "response", None, 500), ("1", "response", None, 500), ("2", "response", None, 5), ("3", "revisit", "1", 500), ("4", "response", None, 5), ("5", "response", None, 0), ("6", "response", None, 120), ("None", "revisit", "1", 500)]
    assert warc.read_archives(warc.write_archives(pages.limit(0), fresh_dir(spark, "warc-test"))).count() == 0


@pytest.mark.parametrize("zipped", [True, False])
def test_salvage(zipped):
    recs = [warc.record(i, f"http://a/{i}", random.Random(i).randbytes(300 + 7 * i)) for i in range(30)]
    parts = [warc.member(r) if zipped else r for r in recs]
    at = np.cumsum([0, *map(len, parts)])
    data = bytearray(b"".join(parts))
    assert [x.headers["X-Page-ID"] for x in warc.salvage(io.BytesIO(data), len(data))] == [str(i) for i in range(30)]
    data[at[6] - 60] ^= 0x40  # in record 5's payload
    del data[at[13] - 90 : at[13] - 80]  # from record 12's
    data = b"junk\x1f\x8b\x08junk" + bytes(data[:-20])
    found = list(warc.salvage(io.BytesIO(data), len(data)))
    whole = [int(x.headers["X-Page-ID"]) for x in found if not x.problem]
    assert whole == [i for i in range(29) if i not in (5, 12)]
    gaps = [(x.at, x.size) for x in found if x.problem]
    assert len(gaps) == 4 and gaps[0] == (0, 11) and sum(x.size for x in found) == len(data)
    assert list(warc.salvage(io.BytesIO(b""), 0)) == [] and [x.problem is not None for x in warc.salvage(io.BytesIO(b"x" * 99), 99)] == [True]


def test_salvage_inside_members():
    recs = [warc.record(i, f"http://a/{i}", random.Random(i).randbytes(3000)) for i in range(9)]
    ids = lambda data: [int(x.headers["X-Page-ID"]) for x in warc.salvage(io.BytesIO(data), len(data)) if not x.problem]
    at = np.cumsum([0, *map(len, recs)])
    broken = bytearray(b"".join(recs))
    broken[at[4] - 90] ^= 1  # record 3's payload
    data = warc.member(bytes(broken)) + warc.member(warc.record(9, "u", b"x"))
    found = list(warc.salvage(io.BytesIO(data), len(data)))
    assert ids(data) == [0, 1, 2, 4, 5, 6, 7, 8, 9] and [x.problem for x in found if x.problem] == ["block digest"]
    whole = warc.member(b"".join(recs))
    assert ids(whole[: len(whole) // 2]) == [0, 1, 2, 3] and ids(whole[:-3]) == list(range(9))
    hurt = bytearray(whole)
    hurt[-6] ^= 1  # the member's checksum
    assert ids(bytes(hurt)) == list(range(9))
    hurt = bytearray(whole + data)
    hurt[len(whole) // 2] ^= 1
    got = ids(bytes(hurt))
    assert got[:4] == [0, 1, 2, 3] and got[-9:] == ids(data)
    gaps = [x for x in warc.salvage(io.BytesIO(hurt), len(hurt)) if x.problem == "member is damaged"]
    assert [(x.at, x.size) for x in gaps] == [(0, len(whole))]


def test_heads_of_any_length(spark, tmp_path):
    url = "http://a/" + "u" * 300_000
    data = warc.record(1, url, b"x" * 200)
    for archive in (data, warc.member(data)):
        assert [(x.problem, x.headers["WARC-Target-URI"]) for x in warc.salvage(io.BytesIO(archive), len(archive))] == [(None, url)]
    spark.createDataFrame([(1, url, "x" * 200), (2, "b", "y")], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    assert {(r["page_id"], r["url"]) for r in warc.op4_warc(spark, str(tmp_path)).collect()} == {(1, url), (2, "b")}
    back = spark.createDataFrame([("a", 0, 9, None), ("a", 9, 4, "block digest")], "path string, at long, size long, problem string")
    warc.whole(back.where("problem is null"), 1, str(tmp_path / "none"))
    for i, rows in enumerate((back, back.where("problem is null"))):
        with pytest.raises(RuntimeError):
            warc.whole(rows, 2, str(tmp_path / f"gaps{i}"))
    assert spark.read.parquet(str(tmp_path / "gaps0")).collect() == [("a", 9, 4, "block digest")] and not (tmp_path / "gaps1").exists()


def test_media_query(spark, sf, odd, none):
    text = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in QUERIES["op10_mpeg"](spark, sf).collect():
        raw = text[r["doc_id"]].encode()
        payload = raw + bytes(-len(raw) % 64)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    got = mpeg.parsed(mpeg.stored(odd)).collect()
    assert len(got) == 12 and all(r["payload"] is not None and len(r["payload"]) % 64 == 0 and r["payload"] for r in got)
    assert mpeg.parsed(mpeg.stored(none)).count() == 0


def test_audio_frames():
    m = mpeg.media_of(b"x" * 6400, 6390)
    a = mpeg.audio_of(m)
    assert a.tags["n_bytes"] == "6390" and a.info["frames"] == len(a.offsets) == 5 and a.info["bytes"] == len(m) - 128 - len(m[: m.index(b"\xff\xfa")])
    assert (a.samples, a.hertz, a.duration_us) == (5760, 32000, 180_000) and a.variable and not a.gaps and not a.bad_crc
    assert [a.seek(t) for t in (0, 0.036, 0.179, 0.18)] == [a.offsets[0], a.offsets[1], a.offsets[4], None]
    assert all(m[o : o + 2] == b"\xff\xfa" for o in a.offsets) and mpeg.payload_of(a) == b"x" * 6400
    assert mpeg.crc16(b"") == 0xFFFF and mpeg.header(b"\xff\xfb\x90\x00").size == 417


def walked(m):
    """(samples, frame sizes, offsets, ancillary bytes) by a parser of its own: MPEG-1 Layer III at 32 kHz, mono, protected."""
    kbits = [0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320]
    at = 10 + (m[6] << 21 | m[7] << 14 | m[8] << 7 | m[9])
    offsets, body, end = [], b"", len(m) - 128
    assert m[:3] == b"ID3" and m[end : end + 3] == b"TAG"
    while at < end:
        assert m[at : at + 2] == b"\xff\xfa" and m[at + 2] & 0x0F == 8 and m[at + 3] == 0xC0
        size = 144 * kbits[m[at + 2] >> 4] * 1000 // 32000
        offsets.append(at)
        body += m[at + 23 : at + size] if len(offsets) > 1 else b""
        at += size
    assert at == end and int.from_bytes(m[offsets[0] + 31 : offsets[0] + 35], "big") == len(offsets) - 1 and m[offsets[0] + 23 : offsets[0] + 27] == b"Xing"
    return offsets[1:], body


def test_media_query_against_another_parser(spark, sf):
    media = {r["key"]: bytes(r["media"]) for r in mpeg.stored(spark.read.parquet(f"{sf}/documents.parquet")).collect()}
    rows = QUERIES["op10_mpeg"](spark, sf).collect()
    assert len(rows) == len(media)
    for r in rows:
        m = media[r["doc_id"]]
        offsets, body = walked(m)
        seek, n = zlib.crc32(np.array(offsets, "<i8").tobytes()), len(offsets)
        assert hashlib.sha256(body[: r["payload_bytes"]]).hexdigest() == r["payload_sha256"] and not any(body[r["payload_bytes"] :])
        assert (r["media_bytes"], r["media_sha256"]) == (len(m), hashlib.sha256(m).hexdigest())
        sizes = {b - a for a, b in zip(offsets, [*offsets[1:], len(m) - 128], strict=True)}
        assert r["feature"] == f"frames={n};hertz=32000;samples={1152 * n};us={36_000 * n};vbr={int(len(sizes) > 1)};seek={seek:08x}"


def test_tags_of_all_versions():
    m = mpeg.media_of(b"x" * 640, 640)
    plain = m[10 + mpeg._from_syncsafe(m[6:10]) :]
    old = b"\x00a\0\xe9\xff\0t"
    tag2 = b"TXX" + len(old.replace(b"\xff\0", b"\xff")).to_bytes(3, "big") + old
    wide = b"\x01" + "ключ".encode("utf-16") + b"\0\0" + "знач".encode("utf-16")
    tag3 = b"TXXX" + len(wide).to_bytes(4, "big") + b"\0\0" + wide
    late = b"\x00b\0\xff\0z"
    tag4 = b"TXXX" + mpeg._syncsafe(len(late) + 4) + b"\0\x03" + mpeg._syncsafe(len(late) - 1) + late
    wanted = [(2, 0x80, tag2, {"a": "é\xfft"}), (3, 0, tag3, {"ключ": "знач"}), (3, 0x80, tag3.replace(b"\xff", b"\xff\0"), {"ключ": "знач"}), (4, 0, tag4, {"b": "\xffz"})]
    for version, flags, tag, want in wanted:
        data = b"ID3" + bytes((version, 0, flags)) + mpeg._syncsafe(len(tag)) + tag + plain
        a = mpeg.audio_of(data)
        assert a.tags == want and not a.gaps and a.offsets, (version, a.tags)


def test_checksums_of_layer_one():
    for mode, guarded in ((0xC0, 16), (0x00, 32), (0x40, 18), (0x70, 24)):
        word = bytes((0xFF, 0xFE, 4 << 4, mode))
        h = mpeg.header(word)
        assert (h.layer, h.protected, h.guarded, h.size) == (1, True, guarded, 12000 * 128 // 44100 * 4)
        body = bytes(range(1, 1 + h.size - 6))
        frame = word + mpeg.crc16(word[2:4] + body[:guarded]).to_bytes(2, "big") + body
        bad = word + b"\0\0" + body
        a = mpeg.audio_of(frame * 2 + bad + frame)
        assert a.bad_crc == [2 * h.size] and len(a.offsets) == 4 and a.samples == 4 * 384


def test_audio_damage():
    m = mpeg.media_of(b"x" * 6400, 6400)
    whole = mpeg.audio_of(m)
    noisy = mpeg.audio_of(b"junk\xff\xfbzz" + m)
    assert noisy.gaps == [(0, 8)] and noisy.body == whole.body
    flipped = bytearray(m)
    flipped[whole.offsets[1] + 8] ^= 1
    assert mpeg.audio_of(bytes(flipped)).bad_crc == [whole.offsets[1]]
    cut = bytearray(m)
    del cut[whole.offsets[2] + 100 : whole.offsets[2] + 110]
    lost = mpeg.audio_of(bytes(cut))
    assert len(lost.offsets) == 4 and len(lost.gaps) == 1
    with pytest.raises(ValueError):
        mpeg.payload_of(lost)
    assert mpeg.audio_of(b"").offsets == [] and mpeg.audio_of(b"\xff" * 500).offsets == []
