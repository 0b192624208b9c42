"""Operators 5, 6, 7 and 9: held-out accuracy, round trips, exact ids, surrogates."""

import io
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from listwright.llm import langid, packing, pii, rans, tokens
from listwright.llm.common import fresh_dir
from listwright.llm.tokens import IDS, Encoder, vocabulary

ODD_TEXTS = [
    "", " ", "  a  b ", "a\n b", "it.\nThe x", "don't we'll  go\t\tnow", "x <|endoftext|> y <|startoftext|>", "ΑΣ ΣΑΣ. ǅ", "été née.", "...,, . , a.b. c,",
    "日本語 テスト。 foo١٢3 4x", "a\x1cb \x1c c", "İstanbul İI.", "x" * 200 + " y", "\n a", "'s 't", "A\r\nB \r\n C", "🙂 🙂🙂.", "½ ² x².", "word. word, word", "à é",
]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_are_the_tokenizers(spark, sf, name):
    """Of a tokenizer as the library gives it, special tokens' strings inside texts too."""
    e, plain, rng = Encoder(vocabulary(name)), Tokenizer.from_file(vocabulary(name)), random.Random(5)
    signs = "ab C.,'s\n\t  é½²_-<|>1٣日\x1c\x85İß\u0301"
    texts = ODD_TEXTS + ["".join(rng.choices(signs, k=rng.randint(0, 14))) for _ in range(3000)] + [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    for t in texts * 2:
        assert np.frombuffer(e.ids(t), IDS).tolist() == plain.encode(t, add_special_tokens=False).ids, repr(t[:50])


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_rows_of_ids_are_the_tokenizers(spark, sf, name, monkeypatch):
    """Many texts at once, each different part looked up once; texts encoded one at a time in between change nothing."""
    e, plain, rng = Encoder(vocabulary(name)), Tokenizer.from_file(vocabulary(name)), random.Random(7)
    signs = ["a", "é", "Wort", "word", ", ", ". ", ",", ".", '"', "'", "'s", " ", " ", "\n", "\n\n", "\t", "\r\n", "&&&", "12", "½", "漢字", "\x02", "\x02,", "\x1c", "\x85", "\xa0", "<|endoftext|>", "x" * 60]
    made = ["".join(rng.choice(signs[: 12 if i % 2 else None]) + rng.choice(["", " "]) for _ in range(rng.randint(0, 12))) for i in range(4000)]
    texts = [None, *ODD_TEXTS, *made, *[r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]]
    want = [[*(plain.encode(t, add_special_tokens=False).ids if t else []), 7] for t in texts]
    for kept in (tokens.KEPT_BYTES, 20_000):
        monkeypatch.setattr(tokens, "KEPT_BYTES", kept)
        for at in range(0, len(texts), 700):
            bounds, ids = e.rows(pa.array(texts[at : at + 700], pa.string()), 7)
            assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:], strict=False)] == want[at : at + 700]
            assert all(np.frombuffer(e.ids(t), IDS).tolist() == w[:-1] for t, w in zip(texts[at : at + 700], want[at : at + 700], strict=True) if t and len(t) < 100)
    bounds, ids = e.rows(pa.array([], pa.string()), 7)
    assert bounds.tolist() == [0] and not len(ids)


def test_rows_look_up_each_part_once():
    e, asked, merged = Encoder(vocabulary("byte_bpe_50k.json")), [], []
    found, one = e.found, e.merged
    e.found, e.merged = lambda parts: asked.append(parts) or found(parts), lambda line: merged.append(line) or one(line)
    e.rows(pa.array(["Qzu qzorb, qzorb. qzorb &&&\nqzorb"] * 500), 2)
    assert len(asked[0]) == len(set(asked[0])) == 6 and sum("qzorb" in x for x in merged) == 2


def test_texts_are_gathered_by_bytes(monkeypatch):
    monkeypatch.setattr(rans, "GATHERED", 100)
    sizes = [0, 10, 250, None, 30, 80, 99, 1, 1, 500, 20]
    batch = pa.record_batch([pa.array(range(len(sizes))), pa.array([None if n is None else "x" * n for n in sizes], pa.string())], names=["key", "text"])
    got = list(rans._gathered(iter([batch.slice(0, 0), batch, batch.slice(0, 2), batch.slice(3)])))
    assert [k for b in got for k in b.column("key").to_pylist()] == [*range(11), 0, 1, *range(3, 11)]
    assert all(sum(map(len, filter(None, b.column("text").to_pylist()[:-1]))) < 200 and len(b) for b in got)


def test_special_strings_as_text_and_bounded_memory(monkeypatch):
    monkeypatch.setattr(tokens, "KEPT_BYTES", 20_000)
    e, plain = Encoder(vocabulary("byte_bpe_50k.json"), special_as_text=True), Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    plain.encode_special_tokens = True
    for t in [f"w{i} x<|endoftext|>y" for i in range(300)]:
        assert np.frombuffer(e.ids(t), IDS).tolist() == plain.encode(t, add_special_tokens=False).ids
    assert e.parts.size <= 20_000 and 50256 in np.frombuffer(Encoder(vocabulary("byte_bpe_50k.json")).ids("a<|endoftext|>"), IDS)


def test_blocks_of_the_numeral_system():
    rng = np.random.default_rng(1)
    for n in (1, 2, 127, 5000, 600_000):
        ids = np.minimum(rng.geometric(0.01, n), 900).astype(np.uint16)
        table = rans.Table(rans.frequencies(np.bincount(ids, minlength=1000)))
        data, lanes = rans.encode_block(ids, table)
        assert (rans.decode_block(data, n, lanes, table) == ids).all()
        assert (rans.Table.unpacked(table.packed()).freq == table.freq).all()
        with pytest.raises(rans.Damaged):
            rans.decode_block(data[:-4], n, lanes, table)


def test_file_checkpoints_and_checksums():
    ids = np.random.default_rng(2).integers(0, 300, 1_200_000).astype(np.uint16)
    table = rans.Table(rans.frequencies(np.bincount(ids)))
    sizes, out = {3: 700_000, 5: 1, 9: 499_998, 4: 1}, io.BytesIO()
    out.close, writer, at = lambda: None, rans.Writer(out, table, 7), 0
    for k, n in sizes.items():
        writer.put(k, ids[at : at + n].tobytes())
        at += n
    assert writer.close()[:3] == (4, 1_200_000, 3)
    data = out.getvalue()
    read = lambda x, crc=7: rans.Reader(io.BytesIO(x), len(x), table, crc)
    docs = [(3, 0, 700_000), (5, 700_000, 1), (9, 700_001, 499_998), (4, 1_199_999, 1)]
    for step in (1, 2, 9):
        got = [d for i in range(0, 3, step) for d in read(data).documents(i, step)]
        assert [(k, a, len(x)) for k, a, x in got] == docs and (np.concatenate([x for _, _, x in got]) == ids).all()
    assert (read(data).block(2) == ids[2 * rans.BLOCK :]).all() and [k for k, _, _ in read(data).documents(1, 1)] == [5, 9]
    for broken, crc in ((data, 8), (data[:-60] + bytes([data[-60] ^ 1]) + data[-59:], 7), (data[:90] + bytes([data[90] ^ 1]) + data[91:], 7), (data[:-1], 7), (b"", 7)):
        with pytest.raises((rans.Damaged, zlib.error)):
            list(read(broken, crc).documents(0, 3))


def test_extreme_frequencies():
    f = rans.frequencies(np.array([10**9, 1, 0, 1]))
    assert f.sum() == 1 << rans.SCALE and f[1] == f[3] == 1 and f[2] == 0
    assert rans.frequencies(np.ones(50_000, int)).sum() == 1 << rans.SCALE


def test_token_files(spark, sf, odd, none):
    tok = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    at = 0
    for r in rans.op6_rans(spark, sf).orderBy("doc_id").collect():
        ids = np.array([*tok.encode(docs[r["doc_id"]], add_special_tokens=False).ids, 2], "<u4")
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(ids))
        at += len(ids)
    path = fresh_dir(spark, "rans-test")
    back = rans.read_files(rans.write_files(odd, path, vocabulary("byte_bpe_50k.json"), 2), path).orderBy("start").collect()
    assert [r["key"] for r in back] == [0, 1, 2, 3, 4, 4, 5, 6, 7, 8, 9, 10] and len(back[3]["ids"]) == 4
    path = fresh_dir(spark, "rans-test")
    spark.conf.set("spark.sql.shuffle.partitions", "150")  # more ranges than files are written at once
    many = spark.range(0, 6000, 1, 40).selectExpr("(id * 7919) % 6000 AS doc_id", "repeat('ab c ', cast(id % 9 as int)) AS text")
    try:
        got = rans.read_files(rans.write_files(many, path, vocabulary("byte_bpe_50k.json"), 2), path).orderBy("start").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert [r["key"] for r in got] == list(range(6000)) and all(a["start"] + len(a["ids"]) // 4 == b["start"] for a, b in zip(got, got[1:], strict=False))
    path = fresh_dir(spark, "rans-test")
    assert rans.read_files(rans.write_files(none, path, vocabulary("byte_bpe_50k.json"), 2), path).count() == 0


def best_fit_decreasing(lengths, cap):
    bins = []
    for x in sorted(map(int, lengths), reverse=True):
        fits = [b for b in bins if b[0] >= x]
        if fits:
            min(fits)[0] -= x
        else:
            bins.append([cap - x])
    return len(bins)


def check_placed(where, offset, length, cap, start=()):
    used = dict(enumerate(cap - g for g in start))
    for s, o, x in sorted(zip(where.tolist(), offset.tolist(), length.tolist(), strict=True)):
        if s >= 0:
            assert used.get(s, 0) == o
            used[s] = o + x
    assert max(used.values(), default=0) <= cap
    return len(used)


def test_a_sweep_is_best_fit_decreasing():
    rng = np.random.default_rng(4)
    for cap, lengths in ((16, rng.integers(1, 17, 400)), (4096, rng.integers(1, 4097, 300)), (10, np.array([3] * 50 + [10] * 4 + [7]))):
        lengths = -np.sort(-lengths)
        where, offset, rest = packing.placed(lengths, np.zeros(0, np.int64), cap, True)
        assert check_placed(where, offset, lengths, cap) == best_fit_decreasing(lengths, cap) == len(rest)
        assert rest.sum() == cap * len(rest) - lengths.sum()


def test_least_sequences_and_gaps_first():
    rng = np.random.default_rng(5)
    for _ in range(200):
        cap = int(rng.integers(4, 40))
        lengths = -np.sort(-rng.integers(1, cap + 1, int(rng.integers(1, 60))))
        counts = {int(k): int(v) for k, v in zip(*np.unique(lengths, return_counts=True), strict=True)}
        least = packing.least_sequences(counts, cap)
        assert -(-lengths.sum() // cap) <= least <= best_fit_decreasing(lengths, cap)
        gap = np.sort(rng.integers(1, cap + 1, int(rng.integers(0, 9))))
        where, offset, rest = packing.placed(lengths, gap, cap, False)
        check_placed(where, offset, lengths, cap, gap.tolist())
        assert (rest >= 0).all() and len(rest) - len(gap) <= least
        for x in lengths[where < 0]:
            assert not (rest >= x).any()  # what is left fits nowhere
    assert packing.least_sequences({}, 8) == 0 and packing.least_sequences({5: 3, 3: 3}, 8) == 3 and packing.least_sequences({5: 3, 4: 1}, 8) == 4


@pytest.mark.parametrize("most", [64, 700, 10_000])
def test_supersteps(spark, most):
    rng = np.random.default_rng(6)
    lengths = np.concatenate((rng.integers(1, 61, 2500), np.full(900, 22)))  # a third of all pieces are alike, and three of them don't fit
    rows = spark.createDataFrame([(i, 0, 0, int(x), i) for i, x in enumerate(lengths)], "key long, nth long, piece int, length int, start long")
    got = packing.packed(rows, 60, most).collect()
    assert sorted((r["key"], r["length"]) for r in got) == list(enumerate(lengths.tolist()))
    by = {}
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert by.get(r["sequence_id"], 0) == r["offset"]
        by[r["sequence_id"]] = r["offset"] + r["length"]
    best = best_fit_decreasing(lengths, 60)
    assert max(by.values()) <= 60 and len(by) <= 1.03 * best and (most < 10_000 or len(by) == best)


def check_packing(rows):
    by = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert by.get(r["sequence_id"], 0) == r["offset"]
        by[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(by.values(), default=0) <= 4096
    return len(by)


def test_packing(spark, sf, odd, none):
    tok = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = packing.op9_best_fit(spark, sf).collect()
    want = {}
    for d, t in docs.items():
        ids = np.array([*tok.encode(t, add_special_tokens=False).ids, 1], "<u4")
        want |= {(d, i): (i * 4096, len(ids[i * 4096 :][:4096]), zlib.crc32(ids[i * 4096 :][:4096])) for i in range(-(-len(ids) // 4096))}
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in rows} == want
    assert check_packing(rows) <= -(-sum(v[1] for v in want.values()) // 4096) + 1
    rows = packing.packed_documents(odd, vocabulary("word_bpe_49k.json"), 1).collect()
    check_packing(rows)
    assert sum(r["doc_id"] == 4 for r in rows) == 2 and sum(r["doc_id"] is None for r in rows) == 1 and sum(r["doc_id"] == 5 for r in rows) > 5
    assert packing.packed_documents(none, vocabulary("word_bpe_49k.json"), 1).count() == 0


def test_language_on_held_out_rows(spark, sf, odd, none):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lang = {r["doc_id"]: r["lang"] for r in docs.collect()}
    rows = langid.op5_language(spark, "/root/testdata/sf0.01").collect()
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == 1000 and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.97 * len(held) and all(0 <= r["score"] <= 1 for r in rows)
    model = langid.trained(docs)
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identified(odd, model).collect()}
    assert (got[3], got[4], got[7], got[8], got[1], got[None]) == ("und", "und", "und", "und", "en", "de")
    assert langid.identified(none, model).count() == 0
    assert {r["lang_pred"] for r in langid.identified(odd, langid.fit({})).collect()} == {"und"}


def test_pieces_lose_no_n_gram(monkeypatch):
    text = "abc déf ghi " * 50
    whole = np.sort(np.concatenate([langid.features(p, n) for p, n in langid.pieces(text)]))
    monkeypatch.setattr(langid, "PIECE", 17)
    assert (np.sort(np.concatenate([langid.features(p, n) for p, n in langid.pieces(text)])) == whole).all()


def test_codewords_keep_their_distance():
    for n in (2, 4, 7, 30):
        c = langid.codewords(n)
        d = (c.shape[1] - c @ c.T) / 2 + np.eye(n) * 99
        assert d.min() >= (1 if n == 2 else 2)


MENTIONS = "Mail ann.lee@corp-x.com or ANN.LEE@CORP-X.COM, call +1 (826) 555-4081 190.137.223.204 or +1 826 555 4081. Card 4111-1111-1111-1111 not 9807915762804490. Mrs. Anna Müller, Frau ANNA MÜLLER, Госпожа Анна Петрова, Herr Weber. token = \"f3ef4d6b2755a36d\" DE89 3704 0044 0532 0130 00"


def test_surrogates_keep_kind_gender_script_and_format():
    new, spans = pii.replaced(MENTIONS, b"k")
    got = [(s["kind"], new[s["start"] : s["start"] + s["length"]]) for s in spans]
    by = lambda k: [t for kind, t in got if kind == k]
    assert by("email")[0].upper() == by("email")[1] and by("email")[0] != "ann.lee@corp-x.com"
    assert pii._digits(by("phone")[0]) == pii._digits(by("phone")[1]) and by("phone")[0][:4] == "+1 ("
    assert pii.luhn(pii._digits(by("card")[0])) and "9807915762804490" in new
    assert by("person")[0].upper() == by("person")[1] and by("person")[0].split()[0] in pii.GIVEN["LATIN", "f"]
    assert by("person")[2].split()[0] in pii.GIVEN["CYRILLIC", "f"] and pii.script_of(by("person")[2][-1]) == "CYRILLIC"
    assert pii.iban_holds(by("iban")[0].replace(" ", "")) and len(by("secret")[0]) == 16
    assert pii.replaced(MENTIONS, b"other")[0] != new and pii.replaced(MENTIONS, b"k")[0] == new


def test_collisions_are_resolved(spark):
    cores = [f"{i}.{j}.{k}.{m}" for i in range(1, 8) for j in range(8) for k in range(8) for m in range(8)]  # of 10,000 of their form
    rows = spark.createDataFrame([("ip", c) for c in cores], "kind string, core string")
    got = pii.nonces(rows, b"k").collect()
    new = [pii.surrogate("ip", r["core"], r["nonce"], b"k") for r in got]
    assert len(set(new)) == len(cores) and not set(new) & set(cores) and any(r["nonce"] for r in got)


def test_collided_surrogates_reach_the_texts(spark):
    cores = [f"{i}.{j}.{k}.{m}" for i in range(1, 5) for j in range(8) for k in range(8) for m in range(4)]
    docs = spark.createDataFrame([(i, f"from {c} to {c}") for i, c in enumerate(cores)], "doc_id long, text string")
    texts = [r["text"].split() for r in pii.pseudonymised(docs).collect()]
    assert all(t[1] == t[3] for t in texts) and len({t[1] for t in texts}) == len(cores) and not {t[1] for t in texts} & set(cores)


def test_private_data_goes_and_clean_texts_stay(spark, sf, odd, none):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = pii.op7_surrogates(spark, sf).collect()
    for r in rows:
        old = docs[r["doc_id"]]
        real = [old[s:e] for _, s, e, _ in pii.entities(old)]
        assert len(real) == r["n_entities"] and not any(x in r["text"] for x in real) and (real or old == r["text"])
    got = pii.pseudonymised(odd)
    assert sorted(str(r["text"]) for r in got.collect()) == sorted(str(r["text"]) for r in odd.collect()) and got.where(F.size("entities") > 0).count() == 0
    assert pii.pseudonymised(none).count() == 0


@pytest.mark.parametrize(("text", "ibans"), [
    ("An AT61 1904 3002 3457 3201 BIC OPSKATWW.", ["AT61 1904 3002 3457 3201"]), ("BE68 5390 0754 7034 EUR 500 und", ["BE68 5390 0754 7034"]),
    ("ES91 2100 0418 4502 0005 1332 2024 USD", ["ES91 2100 0418 4502 0005 1332"]), ("SE45 5000 0000 0583 9825 7466", ["SE45 5000 0000 0583 9825 7466"]),
    ("DE89 3704 0044 0532 0130 00 BIC", ["DE89 3704 0044 0532 0130 00"]), ("NO93 8601 1117 947 IBAN", ["NO93 8601 1117 947"]), ("AT611904300234573201 BIC", ["AT611904300234573201"]),
    ("XX00 AT61 1904 3002 3457 3201 BIC", ["AT61 1904 3002 3457 3201"]), ("AT61 1904 3002 3457 3202 BIC", []),
])
def test_ibans_end_at_their_length(text, ibans):
    assert [text[s:e] for kind, s, e, _ in pii.entities(text) if kind == "iban"] == ibans
    assert not any(x in pii.replaced(text, b"k")[0] for x in ibans)


@pytest.mark.parametrize(("text", "names"), [
    ("Mr. John Q. Smith came", ["John Q. Smith"]), ("Mr. John Q Smith came", ["John Q Smith"]), ("Frau Anna Maria Müller sagt", ["Anna Maria Müller"]),
    ("Herr von Braun und Madame de Gaulle.", ["von Braun", "de Gaulle"]), ("Señora María de la Cruz, Frau Dr. Weber", ["María de la Cruz", "Dr. Weber"]),
    ("Mr. Smith's Dog and Mr. O'Brien’s", ["Smith", "O'Brien"]), ("Mr. van der Berg and", ["van der Berg"]), ("Herr und Frau Meier", ["Meier"]), ("Mr. de facto", []), ("Frau Dr. med", []),
])
def test_whole_names_are_found(text, names):
    assert [text[s:e] for kind, s, e, _ in pii.entities(text) if kind == "person"] == names
    new = pii.replaced(text, b"k")[0]
    assert not any(n.split()[-1] in new for n in names) and all(p in new.split() for n in names for p in n.split() if p in ("von", "de", "la", "der"))


def test_partial_mentions_agree(spark):
    text = "Mr. John Smith, Mr. Smith, Mr. Smith's hat, Mr. John Q. SMITH, Mr. John, Mrs. Smith and Herr von Smith."
    new, spans = pii.replaced(text, b"k")
    got = [new[s["start"] : s["start"] + s["length"]].split() for s in spans]
    family, given = got[0][1], got[0][0]
    assert got[1] == got[2] == got[5] == [family] and got[6] == ["von", family] and got[3] == [given, got[3][1], family.upper()] and got[4] == [given]
    assert family != "Smith" and given in pii.GIVEN["LATIN", "m"] and f"{family}'s hat" in new and got[3][1] != "Q."


def test_untitled_repeats_agree():
    new, spans = pii.replaced("Mr. John Smith met Mr. Smith. John Smith said hi; Smith left the Smithy. Dr. Jane Roe and Roe's hat.", b"k")
    got = [new[s["start"] : s["start"] + s["length"]] for s in spans]
    family, roe = got[1], got[4].split()[1]
    assert got[0] == got[2] and got[0].split()[1] == family == got[3] and got[5] == roe and len(got) == 6
    assert "Smith " not in new and "Roe" not in new and "Jane" not in new and "the Smithy." in new


@pytest.mark.parametrize("text", ["Miss Universe won", "Ms. Pac-Man ran", "my secret: something else", "the token: Important", "password = required_", ""])
def test_what_is_no_private_data_stays(text):
    assert pii.replaced(text, b"k")[0] == text or text.endswith("_")


@pytest.mark.parametrize("entity", ["שלום@example.com", "محمد@site.com", "राम@उदाहरण.in", "ກຸ້ງ@ex.com", "李雷@例子.cn", "Ὀδυσσεύς@site.gr"])
def test_letters_of_all_scripts_go(entity):
    for nonce in range(9):
        new = pii.surrogate("email", entity.lower(), nonce, b"k")
        assert all(a != b and (not b.isalpha() or pii.script_of(a) == pii.script_of(b)) for a, b in zip(entity.lower().partition("@")[0], new, strict=False) if a.isalpha()), new
    new = pii.replaced(f"to {entity} and", b"k")[0]
    assert entity not in new and new.startswith("to ") and new.endswith(" and") and "@" in new


PLANTED = {  # kind: what must go
    "email": ["ann.lee@corp-x.com", "o'neil_7@mail.example.org"[2:]], "phone": ["+1 (826) 555-4081", "+49 30 1234567", "212-555-0187"], "card": ["4111 1111 1111 1111", "5500005555555559"],
    "iban": ["GB82 WEST 1234 5698 7654 32"], "ssn": ["123-45-6789"], "ip": ["190.137.223.204"], "secret": ["f3ef4d6b2755a36d99"], "person": ["Jonathan Quill", "Marguerite Dubois"],
}


def test_planted_entities_go(spark):
    """What was put into clean prose, not what the operator finds."""
    lead = {"secret": 'token = "', "person": "Mr. "}
    clean = ["No numbers here but 42 and 3.14, on 2024-01-05 at 10:30.", "Version 1.2.3 of 10,000 rows; call 911."]
    texts = [f"Before this, {lead.get(k, '')}{x}, and after." for k, xs in PLANTED.items() for x in xs]
    docs = spark.createDataFrame(list(enumerate(texts + clean)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.pseudonymised(docs).collect()}
    for i, (k, x) in enumerate((k, x) for k, xs in PLANTED.items() for x in xs):
        new = got[i]["text"]
        assert x not in new and new.startswith("Before this, ") and new.endswith(", and after.") and [e["kind"] for e in got[i]["entities"]] == [k], (x, new)
    assert [got[len(texts) + i]["text"] for i in range(2)] == clean
    other = {r["doc_id"]: r["text"] for r in pii.pseudonymised(docs, key=b"other").collect()}
    assert all(other[i] != got[i]["text"] for i in range(len(texts)))


def test_many_names_have_surrogates_of_their_own(spark):
    names = [f"{a}{b}" for a in ("Bar", "Mol", "Ker", "Tan", "Ros", "Vil") for b in ("ta", "no", "ri", "lu", "ke", "so")]
    docs = spark.createDataFrame([(i, f"Mr. {n} Li met Mr. {n}a. Then Mr. {n} Li left") for i, n in enumerate(names)], "doc_id long, text string")
    texts = [r["text"].replace(".", "").split() for r in pii.pseudonymised(docs).collect()]
    assert all(t[1:3] == t[8:10] for t in texts) and len({t[1] for t in texts}) == len({t[5] for t in texts}) == len(names) and len({t[2] for t in texts}) == 1
