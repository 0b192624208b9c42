"""Operator 1 against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from listwright.llm.simhash import Forest, fingerprint, fingerprint_links, near_duplicates, one_of_each, op1_simhash, trie_links


def plain(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


@settings(max_examples=60, deadline=None)
@given(st.one_of(st.none(), st.text(alphabet="abAB é \t\n\x0b\x1c", max_size=60)))
def test_fingerprint(text):
    assert fingerprint(text) == plain(text)


def components(values):
    f = Forest(len(values))
    for i, v in enumerate(values):
        j = np.flatnonzero(np.bitwise_count(values ^ v) <= 4)
        f.join(np.full(len(j), i), j)
    return f.label


def family(seed, n=400):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**63, n, dtype=np.uint64)
    flip = lambda b, k: b ^ np.bitwise_or.reduce(np.uint64(1) << rng.choice(64, k, replace=False).astype(np.uint64))
    return np.unique(np.concatenate((base, [flip(b, int(rng.integers(1, 7))) for b in base], [flip(base[0], 3) for _ in range(200)])).astype(np.uint64))


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_self_join(seed):
    v = family(seed)
    z = np.zeros(len(v), int)
    assert (trie_links(z, v, z, z) == components(v)).all()


@pytest.mark.parametrize("most", [10**6, 60])
def test_links_over_blocks_and_split_nodes(spark, most):
    v = family(3)
    v = np.unique(np.concatenate((v, v[0] ^ (np.arange(150, dtype=np.uint64) << np.uint64(3)))))  # one block value of many
    rows = spark.createDataFrame([(int(x),) for x in v.view(np.int64)], "fp long")
    at = {int(x): i for i, x in enumerate(v.view(np.int64))}
    f = Forest(len(v))
    got = fingerprint_links(rows, most=most).collect()
    f.join(np.array([at[r["u"]] for r in got]), np.array([at[r["v"]] for r in got]))
    assert (f.label == components(v)).all()


def test_query(spark, sf):
    got = op1_simhash(spark, sf).collect()
    text = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    v = np.array([plain(text[r["doc_id"]]) for r in got], np.uint64)
    assert [r["fingerprint"] for r in got] == [f"{x:016x}" for x in v.tolist()]
    label = components(v)
    least = {}
    for r, k in zip(got, label, strict=True):
        least[k] = min(least.get(k, r["doc_id"]), r["doc_id"])
    assert [r["component_id"] for r in got] == [least[k] for k in label]


def test_odd_rows(odd, none):
    got = {(r["doc_id"], r["component_id"]) for r in near_duplicates(odd).collect()}
    assert {(1, 1), (2, 1), (3, 3), (4, 3), (7, 3), (None, None)} <= got
    kept = one_of_each(odd).collect()
    assert sorted(str(r["doc_id"]) for r in kept if r["doc_id"] in (1, 2, 3, 4, 7, None)) == ["1", "3", "None"]
    assert near_duplicates(none).count() == 0 and one_of_each(none).count() == 0


def planted():
    """Texts of 300 words, with copies in which one word in a hundred is changed, one in forty, and one in ten."""
    rng, rows = random.Random(5), []
    for i in range(12):
        words = [f"w{rng.randrange(10**6)}" for _ in range(300)]
        rows.append((10 * i, " ".join(words)))
        for k, step in enumerate((100, 40, 10), 1):
            rows.append((10 * i + k, " ".join(f"x{i}" if j % step == step // 2 else w for j, w in enumerate(words))))
    return rows


@pytest.mark.parametrize("most", [1024, 3])
def test_near_copies_of_similarity_four_fifths_go(spark, most):
    rows = planted() + [(1000 + i, "a group of copies " * 20 + " ".join(f"c{j}" for j in range(200)) + f" end{i}") for i in range(30)]
    sets = {k: {" ".join(w[j : j + 5]) for j in range(len(w) - 4)} for k, t in rows for w in [t.split()]}
    group = {k: k for k in sets}
    links = [(a, b) for a in sets for b in sets if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    for _ in range(4):
        for a, b in links:
            group[a] = group[b] = min(group[a], group[b])
    kept = one_of_each(spark.createDataFrame(rows, "doc_id long, text string"), most=most).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(set(group.values()))
    assert {10 * i + 1 for i in range(12)}.isdisjoint(r["doc_id"] for r in kept) and {10 * i + 3 for i in range(12)} <= {r["doc_id"] for r in kept}
