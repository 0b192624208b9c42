"""The pipeline against a brute-force version of each stage."""

import re
from itertools import combinations

import corpus_pipeline as c
from listwright.llm import langid, pii


def shingles(text):
    words = re.findall(rb"[^\x20\x09-\x0d]+", text.encode().lower())
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = {}
    for name, stage in c.STAGES:
        before = docs
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = ([r.asDict() for r in before.collect()], [r.asDict() for r in docs.collect()], docs.columns)
    assert all(v[2] == c.COLUMNS for k, v in seen.items() if k != "packing")

    before, after, _ = seen["language"]
    lettered = {r["doc_id"] for r in before if r["text"] and any(x.isalpha() for x in r["text"])}
    assert {r["doc_id"] for r in after} == lettered and all(r["lang"] != langid.UNKNOWN for r in after)

    before, after, _ = seen["near_duplicates"]
    sets = {r["doc_id"]: shingles(r["text"]) for r in before}
    group = {d: d for d in sets}
    for d, e in combinations(sorted(sets), 2):
        both = len(sets[d] & sets[e])
        if group[d] != group[e] and 5 * both >= 4 * (len(sets[d]) + len(sets[e]) - both):
            lo, hi = sorted((group[d], group[e]))
            group = {x: lo if g == hi else g for x, g in group.items()}
    assert sorted(r["doc_id"] for r in after) == sorted(set(group.values())) and len(after) < len(before)

    before, after, _ = seen["private_data"]
    new = {r["doc_id"]: r for r in after}
    for r in before:
        real = [r["text"][s:e] for _, s, e, _ in pii.entities(r["text"])]
        assert not any(x in new[r["doc_id"]]["text"] for x in real) and new[r["doc_id"]]["n_chars"] == len(new[r["doc_id"]]["text"])
    assert len(after) == len(before)

    before, after, _ = seen["mixture"]
    words = {r["doc_id"]: len(r["text"].split()) for r in before}
    total, got = sum(words.values()), sum(words[r["doc_id"]] for r in after)
    assert abs(got - 1.5 * total) < 0.1 * total

    before, after, _ = seen["packing"]
    assert len(after) >= len(before) and len({(r["doc_id"]) for r in after}) == len({r["doc_id"] for r in before})
    by = {}
    for r in sorted(after, key=lambda r: (r["sequence_id"], r["offset"])):
        assert by.get(r["sequence_id"], 0) == r["offset"]
        by[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(by.values()) <= 4096


def test_run(spark, sf):
    assert c.run(spark, sf).count() > 0 and c.ORACLE_SQL is None


def test_near_duplicates_come_by_the_trie_too(spark, monkeypatch):
    """Without any MinHash block, near copies within the fingerprint's budget are found still; others wait for the blocks."""
    from listwright.llm import simhash

    words = [f"w{i}" for i in range(3000)]
    near = [*words[:1500], "other", *words[1501:]]
    far = [w + "x" if i % 60 == 0 else w for i, w in enumerate(words)]
    a, b, c = (simhash.shingle_hashes(" ".join(x)) for x in (words, near, far))
    fps = [simhash.set_fingerprint(x) for x in (a, b, c)]
    assert (fps[0] ^ fps[1]).bit_count() <= simhash.BUDGET < (fps[0] ^ fps[2]).bit_count()
    docs = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate((words, near, far, ["alone"]))], "doc_id long, text string")
    assert len(simhash.alike([a, c])) == 1
    assert sorted(r["doc_id"] for r in simhash.one_of_each(docs).collect()) == [0, 3]
    nodes = spark.createDataFrame([(i, simhash._signed(f)) for i, f in enumerate(fps)], "node long, fp long")
    got = {r["node"]: r["group"] for r in simhash.trie_groups(nodes).collect()}
    assert got[0] == got[1] != got[2]
    monkeypatch.setattr(simhash, "sketch", lambda hashes: [])
    assert sorted(r["doc_id"] for r in simhash.one_of_each(docs).collect()) == [0, 2, 3]
