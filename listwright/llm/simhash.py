"""Operator 1: SimHash near-duplicates by a binary trie self-join; and the pipeline's stage, on the Jaccard similarity of
word shingles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listwright.llm.common import fewer, free_name, swept, tune, written
from listwright.operators.graph import connected_components

BITS, BUDGET, SEED, WORDS = 64, 4, 42, 4
#: The pipeline's near-duplicates: shingles of so many words, whose sets have at least this Jaccard similarity.
ALIKE_WORDS, ALIKE = 5, (4, 5)
#: Blocks of the longer fingerprint (MinHash) and values a block: sets of similarity 0.8 share a block but once in 2e7 pairs.
SKETCH_BLOCKS, BLOCK_VALUES = 32, 4
#: Distinct sets of a block value that a task compares; those with more are dealt out as pairs of parts of this size.
MOST_ALIKE = 1024
#: Leaves of one trie that a task holds; a block value with more fingerprints is dealt out as pairs of trie nodes.
MOST_LEAVES = 100_000
#: Pairs of nodes that one step of the descent holds.
FRONTIER = 1 << 19
_PIECE = 1 << 16
_BITS_OF = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """The SimHash of a text's word shingles, repeats included, as an unsigned integer; 0 for a text without words.

    A-Z are lower-cased, words are runs of bytes other than space and 0x09-0x0D, a shingle is `words` words joined by
    single spaces (the whole sequence if there are fewer), its hash XXH64 with seed 42. A bit is 1 if it is set in more
    than half of the hashes."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    line = b" ".join(parts)
    n = max(1, len(parts) - words + 1)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    stops = ends[words - 1 :] if len(parts) >= words else ends[-1:]
    del parts
    digest, ones = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    for at in range(0, n, _PIECE):
        spans = zip(starts[at : at + _PIECE].tolist(), stops[at : at + _PIECE].tolist(), strict=False)
        ones += _ones(np.array([digest(line[s:e], SEED) for s, e in spans], dtype="<u8"))
    return _majority(ones, n)


def _ones(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit."""
    cells = hashes.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8) + np.arange(0, 2048, 256, dtype=np.int64)
    return (np.bincount(cells.ravel(), minlength=2048).reshape(8, 256) @ _BITS_OF).ravel()


def _majority(ones: np.ndarray, n: int) -> int:
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def set_fingerprint(hashes: np.ndarray) -> int:
    """The SimHash of a set of shingles by their hashes; 0 for none."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), _PIECE):
        ones += _ones(hashes[at : at + _PIECE])
    return _majority(ones, len(hashes))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(id, fp): the key of each row and its fingerprint as a signed long. Null texts count as empty."""
    kind = docs.schema[key].dataType.simpleString()

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "fp": np.array([_signed(fingerprint(t)) for t in b["text"]], dtype=np.int64)})

    return docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text")).mapInPandas(each, f"id {kind}, fp long")


class Forest:
    """Sets of leaves, as the smallest leaf of each."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        label = self.label
        while True:
            x, y = label[a], label[b]
            apart = x != y
            if not apart.any():
                break
            np.minimum.at(label, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
            while True:
                up = label[label]
                if (up == label).all():
                    break
                label = up
            self.label = label


def trie_links(group: np.ndarray, leaf: np.ndarray, depth: np.ndarray, cross: np.ndarray, budget: int = BUDGET) -> np.ndarray:
    """The smallest linked leaf (by index) of each leaf, for many tries at once.

    leaf: distinct unsigned 64-bit keys, sorted within group (sorted, one trie each). All leaves of a group share their
    first depth bits. cross: the group joins only leaves whose next bits up to that depth differ (0: all pairs).

    Pairs of nodes go down together as ranges of leaves. A pair with child ranges on different bits gains an error;
    pairs over budget end, and so do pairs whose leaves are known to be linked already. Pairs of single leaves are
    compared outright."""
    n, forest = len(leaf), Forest(len(leaf))
    if n < 2:
        return forest.label
    for turn in range(0, BITS, 8):  # chains of neighbours in rotated orders: what is linked already needs no descent
        order = np.lexsort(((leaf << np.uint64(turn)) | (leaf >> np.uint64(64 - turn)) if turn else leaf, group))
        a, b = order[:-1], order[1:]
        near = (group[a] == group[b]) & (np.bitwise_count(leaf[a] ^ leaf[b]) <= budget) & (cross[a] == 0)
        forest.join(a[near], b[near])
    zeros: dict[int, np.ndarray] = {}

    def zeros_at(d: int) -> np.ndarray:
        if d not in zeros:
            zeros[d] = np.concatenate(([0], np.cumsum(((leaf >> np.uint64(63 - d)) & np.uint64(1)) == 0))).astype(np.int32)
        return zeros[d]

    change = np.concatenate(([0], np.cumsum(forest.label[1:] != forest.label[:-1])))
    heads = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    tails = np.append(heads[1:], n)
    work: list[tuple[int, np.ndarray]] = []
    first = depth[heads]
    for d in np.unique(first):  # a pair: start and end of A, start and end of B, errors
        on = first == d
        plain = on & (cross[heads] == 0)
        if plain.any():
            h, t = heads[plain], tails[plain]
            work.append((int(d), np.stack((h, t, h, t, np.zeros_like(h)))))
        for g in np.flatnonzero(on & (cross[heads] > 0)):
            to = int(cross[heads[g]])
            lead = leaf[heads[g] : tails[g]] >> np.uint64(64 - to)
            cut = heads[g] + int(np.searchsorted(lead, lead[-1]))
            if cut > heads[g]:
                errors = int(np.bitwise_count(lead[0] ^ lead[-1]))
                if errors <= budget:
                    work.append((to, np.array([[heads[g]], [cut], [cut], [tails[g]], [errors]])))
    found: list[tuple[np.ndarray, np.ndarray]] = []
    held = 0
    while work:
        d, pairs = work.pop()
        if pairs.shape[1] > FRONTIER:
            half = pairs.shape[1] // 2
            work += [(d, pairs[:, half:]), (d, pairs[:, :half])]
            continue
        a0, a1, b0, b1, e = pairs
        size_a, size_b = a1 - a0, b1 - b0
        same = a0 == b0
        label = forest.label
        joined = (change[a1 - 1] == change[a0]) & (change[b1 - 1] == change[b0]) & (label[a0] == label[b0])
        live = (size_a > 0) & (size_b > 0) & (e <= budget) & ~joined
        single = live & (size_a == 1) & (size_b == 1)
        if single.any():
            a, b = a0[single], b0[single]
            near = np.bitwise_count(leaf[a] ^ leaf[b]) <= budget
            found.append((a[near], b[near]))
            held += int(near.sum())
        live &= ~single
        if held > FRONTIER or (held and not work and not live.any()):
            forest.join(np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found]))
            change = np.concatenate(([0], np.cumsum(forest.label[1:] != forest.label[:-1])))
            found, held = [], 0
        if d == BITS or not live.any():
            continue
        a0, a1, b0, b1, e, same = a0[live], a1[live], b0[live], b1[live], e[live], same[live]
        z = zeros_at(d)
        am, bm = a0 + z[a1] - z[a0], b0 + z[b1] - z[b0]
        other = ~same
        down = np.concatenate(
            (
                np.stack((a0, am, b0, bm, e)), np.stack((am, a1, bm, b1, e)), np.stack((a0, am, bm, b1, e + 1)),
                np.stack((am[other], a1[other], b0[other], bm[other], e[other] + 1)),
            ), axis=1,
        )
        down = down[:, (down[1] > down[0]) & (down[3] > down[2]) & (down[4] <= budget)]
        if down.shape[1]:
            work.append((d + 1, down))
    if held:
        forest.join(np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found]))
    return forest.label


def _blocks(budget: int) -> list[tuple[int, int]]:
    """(first bit from the top, width) of budget + 1 blocks: leaves within the budget agree on one block at least."""
    cuts = [round(i * BITS / (budget + 1)) for i in range(budget + 2)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def _join_partition(budget: int):
    """Rows (fp, block, value, p, lo, hi), sorted by unit: links as (u, v), where u is linked to v through some chain."""
    blocks = _blocks(budget)

    def links(part: pd.DataFrame) -> pd.DataFrame:
        unit = part[["block", "value", "lo", "hi"]].to_numpy()
        new = np.concatenate(([True], (unit[1:] != unit[:-1]).any(axis=1)))
        fp = part["fp"].to_numpy().astype(np.int64).view(np.uint64)
        turn = np.array([b[0] for b in blocks], np.uint64)[part["block"].to_numpy()]
        rotated = np.where(turn == 0, fp, (fp << turn) | (fp >> ((np.uint64(64) - turn) % np.uint64(64))))
        group = np.cumsum(new)
        order = np.lexsort((rotated, group))
        width = np.array([b[1] for b in blocks])[part["block"].to_numpy()][order]
        p, lo, hi = (part[c].to_numpy()[order] for c in ("p", "lo", "hi"))
        label = trie_links(group[order], rotated[order], width + np.where(lo == hi, p, 0), np.where(lo == hi, 0, width + p), budget)
        signed = part["fp"].to_numpy()[order]
        moved = np.flatnonzero(label != np.arange(len(label)))
        return pd.DataFrame({"u": signed[moved], "v": signed[label[moved]]})

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        rows = 0
        for b in batches:
            if not len(b):
                continue
            held.append(b)
            rows += len(b)
            if rows >= MOST_LEAVES:
                part = pd.concat(held, ignore_index=True)
                unit = part[["block", "value", "lo", "hi"]].to_numpy()
                last = np.flatnonzero((unit != unit[-1]).any(axis=1))
                if len(last):  # the last unit may go on in the next batch
                    yield links(part.iloc[: last[-1] + 1])
                    part = part.iloc[last[-1] + 1 :]
                held, rows = [part], len(part)
        if rows:
            yield links(pd.concat(held, ignore_index=True))

    return each


def fingerprint_links(nodes: DataFrame, budget: int = BUDGET, most: int = MOST_LEAVES) -> DataFrame:
    """(u, v) over the distinct longs of nodes.fp: chains of pairs that differ in at most budget bits join the same
    values as all such pairs do, in at most budget + 1 rows a value.

    The trie is joined with itself once for each of budget + 1 rotations that bring one block of bits to the top, where
    no error is allowed: two values within the budget agree on some block, so each trie pair that matters starts at a
    node of the block's depth, and those nodes are dealt out to tasks. A node with more than `most` leaves is dealt out as
    pairs of nodes some bits further down, with the errors between them, so that no task holds it whole."""
    blocks = _blocks(budget)
    each = F.array(*[F.struct(F.lit(i).alias("block"), F.shiftrightunsigned(F.shiftleft("fp", at), BITS - width).alias("value")) for i, (at, width) in enumerate(blocks)])
    rows = nodes.select("fp", F.explode(each).alias("k")).select("fp", "k.block", "k.value")
    hot = rows.groupBy("block", "value").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most)
    hot = hot.select("block", "value", F.least(F.lit(12), F.ceil(F.log2(F.col("n") / most)) + 1).cast("int").alias("p"))
    rows = rows.join(hot, ["block", "value"], "left").withColumn("p", F.coalesce("p", F.lit(0)))
    at = F.element_at(F.array(*[F.lit(a + w) for a, w in blocks]), F.col("block") + 1)
    turned = F.expr("(shiftleft(fp, cast(at % 64 as int)) | if(at % 64 = 0, 0L, shiftrightunsigned(fp, cast(64 - at % 64 as int))))")
    lead = F.when(F.col("p") > 0, F.expr("shiftrightunsigned(turned, cast(64 - p as int))")).otherwise(F.lit(0).cast("long"))
    rows = rows.withColumn("at", at).withColumn("turned", turned).withColumn("lead", lead)
    mates = F.expr(f"filter(sequence(0L, cast(shiftleft(1, p) - 1 as bigint)), x -> bit_count(x ^ lead) <= {budget})")
    rows = rows.withColumn("mate", F.explode(F.when(F.col("p") > 0, mates).otherwise(F.array(F.col("lead")))))
    rows = rows.select("fp", "block", "value", "p", F.least("lead", "mate").alias("lo"), F.greatest("lead", "mate").alias("hi"))
    unit = ["block", "value", "lo", "hi"]
    return rows.repartition(*unit).sortWithinPartitions(*unit).mapInPandas(_join_partition(budget), "u long, v long")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", budget: int = BUDGET) -> DataFrame:
    """(key, fp, component_id) for each row of docs.

    Rows link when their fingerprints differ in at most `budget` bits; component_id is the smallest key that links reach.
    Equal fingerprints are one node of the trie whatever their number, so copies are never paired. Null and empty texts
    have fingerprint 0. A null key takes part in links but is never a component_id (a component of null keys alone has
    null). Rows that repeat a key stay separate rows. An empty table gives an empty table."""
    tune(docs.sparkSession)
    prints = written(fingerprints(docs, key, text), "simhash")
    nodes = written(prints.groupBy("fp").agg(F.min("id").alias("least")), "simhash-nodes")
    parts = connected_components(fingerprint_links(nodes.select("fp"), budget))
    named = nodes.join(parts.withColumnRenamed("node", "fp"), "fp")
    names = named.groupBy("component").agg(F.min("least").alias("name"))
    linked = named.join(names, "component").select("fp", "name")
    where = nodes.join(linked, "fp", "left").select("fp", F.coalesce("name", "least").alias("component_id"))
    return prints.join(where, "fp").select(F.col("id").alias(key), "fp", "component_id")


def shingle_hashes(text: str | None, words: int = ALIKE_WORDS) -> np.ndarray:
    """The distinct hashes, sorted, of a text's shingles, cut and hashed as those of the fingerprint; none without words."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    line = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1)).tolist()
    stops = (ends[words - 1 :] if len(parts) >= words else ends[-1:]).tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(line[a:b], SEED) for a, b in zip(starts, stops, strict=False)], dtype=np.uint64))


_TURNS = np.random.default_rng(SEED).integers(0, 1 << 63, (2, SKETCH_BLOCKS * BLOCK_VALUES, 1)).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def sketch(hashes: np.ndarray) -> list[int]:
    """The MinHash blocks of a set of hashes as signed longs: in each, the least of its hashes in some random orders."""
    least = np.full(SKETCH_BLOCKS * BLOCK_VALUES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 1 << 12):
        np.minimum(least, (hashes[at : at + (1 << 12)] * _TURNS[0] + _TURNS[1]).min(axis=1), out=least)
    rows = least.astype("<u8").reshape(SKETCH_BLOCKS, BLOCK_VALUES)
    return [_signed(xxhash.xxh64_intdigest(r.tobytes(), i)) for i, r in enumerate(rows)]


def alike(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Pairs (i, j) of sets of similarity ALIKE or more, such that their chains join what all such pairs join.

    The sets that are not reached yet are compared with each set reached, so that a group of n copies takes n comparisons."""
    up, down = ALIKE
    size = np.array([len(x) for x in sets])
    left, out = np.arange(len(sets)), []
    work: list[int] = []
    while len(left):
        if not work:
            work, left = [int(left[0])], left[1:]
        x = work.pop()
        near = (np.minimum(size[left], size[x]) * down >= up * np.maximum(size[left], size[x])) & (size[left] > 0)
        if size[x] == 0 or not near.any():
            continue
        these = left[near]
        every = np.concatenate([sets[i] for i in these])
        at = np.minimum(np.searchsorted(sets[x], every), size[x] - 1)
        both = np.add.reduceat((sets[x][at] == every).astype(np.int64), np.concatenate(([0], np.cumsum(size[these])[:-1])))
        got = these[both * down >= up * (size[these] + size[x] - both)]
        out += [(x, int(i)) for i in got]
        work += got.tolist()
        left = left[~np.isin(left, got)]
    return out


def _alike_partition(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (unit, lo, hi, node, hashes), sorted by unit: links (u, v) of nodes."""
    now, nodes, sets = None, [], []

    def links() -> pd.DataFrame:
        pairs = alike(sets)
        return pd.DataFrame({"u": np.array([nodes[a] for a, _ in pairs], np.int64), "v": np.array([nodes[b] for _, b in pairs], np.int64)})

    for b in batches:
        for unit, node, hashes in zip(zip(b["unit"], b["lo"], b["hi"], strict=True), b["node"], b["hashes"], strict=True):
            if unit != now:
                if nodes:
                    yield links()
                now, nodes, sets = unit, [], []
            nodes.append(node)
            sets.append(np.asarray(hashes, np.int64).view(np.uint64))
    if nodes:
        yield links()


def trie_groups(nodes: DataFrame, budget: int = BUDGET) -> DataFrame:
    """nodes with their group: the smallest fingerprint fp that links within the budget reach, itself included."""
    parts = connected_components(fingerprint_links(nodes.select("fp").distinct(), budget))
    return nodes.join(parts.withColumnRenamed("node", "__fp"), F.col("fp") == F.col("__fp"), "left").withColumn("group", F.coalesce("component", "fp")).drop("__fp", "component")


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", most: int = MOST_ALIKE) -> DataFrame:
    """docs without the rows that have an earlier near-duplicate: one row of each component stays, that of its smallest
    key; of rows that repeat this key, the one whose values hash lowest. Rows with null keys count as largest.

    Rows link when their sets of five-word shingles have a Jaccard similarity of 0.8 or more. Candidates are joined by the
    trie of the sets' SimHash fingerprints (near_duplicates' step, with its budget); similar sets beyond the budget share
    a block of a MinHash fingerprint. Each candidate is verified on the whole sets. Equal sets are one node; nodes of the
    same group or block value are compared in one task up to `most`, and as pairs of parts of that size beyond."""
    marked = free_name(docs, "mark")
    numbered = docs.withColumn(marked, F.xxhash64(*[F.col(f"`{c}`") for c, t in docs.dtypes if not t.startswith(("map", "variant"))]))
    pick = F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("mark"))
    ids = docs.schema[key].dataType.simpleString()

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sets = [shingle_hashes(t) for t in b["text"]]
            nodes = np.array([_signed(xxhash.xxh64_intdigest(x.tobytes(), SEED)) for x in sets], dtype=np.int64)
            fps = np.array([_signed(set_fingerprint(x)) for x in sets], dtype=np.int64)
            yield pd.DataFrame({"id": b["id"], "mark": b["mark"], "node": nodes, "fp": fps, "blocks": [sketch(x) for x in sets]})

    def again(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"node": b["node"], "hashes": [shingle_hashes(t).view(np.int64) for t in b["text"]]})

    tune(docs.sparkSession)
    rows = numbered.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text"), F.col(marked).alias("mark"))
    prints = rows.mapInPandas(each, f"id {ids}, mark long, node long, fp long, blocks array<long>")
    nodes = written(prints.groupBy("node").agg(F.min(pick).alias("first"), F.first("fp").alias("fp"), F.first("blocks").alias("blocks")), "alike-nodes")
    blocks = nodes.select("node", F.explode("blocks").alias("unit")).unionByName(trie_groups(nodes).select("node", F.xxhash64(F.lit("trie"), "group").alias("unit")))
    members = [F.count(F.lit(1)).alias("n"), *[F.bit_xor(F.xxhash64(F.lit(i), "node")).alias(f"x{i}") for i in (1, 2)]]
    shared = blocks.groupBy("unit").agg(*members).where("n > 1")
    shared = shared.groupBy("n", "x1", "x2").agg(F.min("unit").alias("unit"))  # blocks of the same nodes: one of them
    units = blocks.join(shared.select("unit", F.ceil(F.col("n") / most).cast("int").alias("parts")), "unit")
    units = units.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).withColumn("mate", F.explode(F.expr("sequence(0, parts - 1)")))
    units = written(units.select("unit", F.least("part", "mate").alias("lo"), F.greatest("part", "mate").alias("hi"), "node"), "alike-units")
    texts = nodes.join(units.select("node").distinct(), "node").select("node", F.col("first.id").alias("__id"), F.col("first.mark").alias("__mark"))
    i, at = F.col("id"), F.col("__id")  # as below: texts are dealt by their mark alone, and a node has one mark
    same = (F.col("mark") == F.col("__mark")) & (((i >= at) & (i <= at)) | (i.isNull() & at.isNull()))
    texts = rows.join(texts, same).select("node", "mark", "text").dropDuplicates(["node", "mark"]).select("node", "text")
    sets = texts.mapInPandas(again, "node long, hashes array<long>")
    unit = ["unit", "lo", "hi"]
    links = units.join(sets, "node").repartition(*unit).sortWithinPartitions(*unit).mapInPandas(_alike_partition, "u long, v long")
    parts = connected_components(links).withColumnRenamed("node", "at")
    swept(docs.sparkSession)  # of the shuffled texts and sets, before whole documents are shuffled
    groups = nodes.join(parts, F.col("node") == F.col("at"), "left")
    alone = groups.where("component is null").select("first")
    grouped = groups.where("component is not null").groupBy("component").agg(F.min("first").alias("first")).select("first")
    mark, id_ = free_name(numbered, "first_mark"), free_name(numbered, "first_id")
    kept = alone.union(grouped).select(F.col("first.mark").alias(mark), F.col("first.id").alias(id_))
    k = F.col(f"`{key}`")  # not as an equality: so rows are dealt by their mark alone, once for both steps
    here = (F.col(marked) == F.col(mark)) & (((k >= F.col(id_)) & (k <= F.col(id_))) | (k.isNull() & F.col(id_).isNull()))
    return numbered.join(kept, here, "left_semi").dropDuplicates([marked, key]).drop(marked)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document with its fingerprint and the smallest id that links reach. Null and empty texts have
    fingerprint 0; repeated ids stay separate rows; a null id names no component; no documents give no rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = near_duplicates(docs)
    return fewer(found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"))
