"""Operator 9: SimHash near-duplicates by the generalised pigeonhole.

Bits of the fingerprints are grouped into partitions, correlated bits together. Fingerprints within
distance t must agree within threshold T_i on some partition i if the thresholds' sum is t - m + 1
for m partitions; a threshold of -1 leaves a partition out. Dynamic programming allocates unequal
thresholds by the estimated candidates (from the partition values' counts and the bits' odds of
differing over all fingerprints) plus the probes they cost.

Two uses:

`link` (exact, distance up to 2): a probe also has to agree on one of t + 1 groups of the bits outside its
partition, by the same principle, so chance agreements don't grow with the corpus. Probes joined to the
index give candidate pairs, verified bit by bit; components of these are the classes. A value that
more than CROWD distinct fingerprints have would make too many pairs; those are linked around points instead:
fingerprints at distance 2 or less share a point at distance 1 or less from each, a point has at most 65
members, and linking each to the smallest around it gives the same components. So no group is gathered
and a fingerprint makes a bounded number of pairs.

`near_classes` (the pipeline's stage; five-word shingles, similarity of 0.8 or more, exact): 512-bit
fingerprints of shingle sets, whose distance estimates the similarity to about 0.04. The programme picks
thresholds at which a pair at the limit is probed with the chance PROBED. Members of a shared value are put
in order by further bits, and neighbours are candidates. Candidates near enough by distance are verified by their
shingle sets: first each node with its nearest, then those that still stand in two classes.
That makes one class of most copies, at a cost in proportion to the rows. An exact join then finds every
pair that probing left out: shingles are put in one order, those in many rows last; two
sets as similar as asked for share some of their first shingles (`first_shingles`), enough of them for the
rest to suffice. Pairs of different classes that do so are verified alike, the best of every two classes first. A shared shingle costs the rows
outside its largest class times all its rows; so where these are many, nodes outside are first compared with one
member of that class for each shingle, which joins most of a large family. Common shingles are salted,
pairs are dealt over blocks, and none is dropped. So every class is a component of the graph of all pairs at the limit or above.

Defined cases: null text is empty; texts without words have fingerprint zero and link with each
other; fewer words than a shingle make one shingle of all; repeated rows each get their row; a null
doc_id never names a component unless it has no other; an empty table gives an empty result;
columns other than doc_id and text are not read.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.llm.common import Stash, lean, small_batches, table
from spanloom.llm.components import components

BITS, WIDE = 64, 512
SIMILARITY, SHINGLE, PROBED, EXTRA = 0.8, 5, 0.5, 1.25
CROWD = 64
SEED = 42
UNSURE = 3.0
BROADCAST_TEXTS = 100_000
RARE, RARE_STEPS, MOST_COMMON = 5_000, 10, 1_000_000  # what the order of shingles tells apart; any order is right
BROADCAST_SHINGLES = 500_000
BLOCK, FAMILY, CROWDED, EARLIER, NEXT, BEST = 4000, 300, 10_000, 64, 2, 8
PIECE = 200
PART_BYTES, LEAST_PART_BITS, MOST_PART_BITS = 3 << 20, 8, 14  # of text whose shingles are counted at a time


def shingle_hashes(text: str | None, k: int) -> np.ndarray:
    """XXH64 of each k-word shingle, repeats included; only A-Z are lower-cased."""
    said = (text or "").encode("utf-8", "replace").lower().split()
    if not said:
        return np.zeros(0, np.uint64)
    joined = b" ".join(said)
    if len(said) <= k:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, said), np.int64, len(said)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts[: len(said) - k + 1].tolist(), ends[k - 1 :].tolist())], np.uint64)


def majority(rows: np.ndarray) -> np.ndarray:
    """rows: big-endian bytes, one row for each shingle. Packed bits that are set in over half of them."""
    counts = np.zeros(rows.shape[1] * 8, np.int64)
    for at in range(0, len(rows), 255):  # sums of 255 bits fit a byte
        counts += np.add.reduce(np.unpackbits(rows[at : at + 255], axis=1), axis=0, dtype=np.uint8)
    return np.packbits(2 * counts > len(rows))


def fingerprint(text: str | None, k: int = 3) -> int:
    h = shingle_hashes(text, k)
    if not len(h):
        return 0
    return int.from_bytes(majority(h.astype(">u8").view(np.uint8).reshape(-1, 8)).tobytes(), "big")


def wide_fingerprint(text: str | None, k: int = SHINGLE) -> bytes:
    return wide_of(np.unique(shingle_hashes(text, k)))


def wide_of(h: np.ndarray) -> bytes:
    """Of the set of shingles: each is spread to WIDE bits by a fixed mixing of its hash."""
    if not len(h):
        return bytes(WIDE // 8)
    spread = np.empty((len(h), WIDE // 64), ">u8")
    for j in range(WIDE // 64):
        z = h + np.uint64((j + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        spread[:, j] = z ^ (z >> np.uint64(31))
    return majority(spread.view(np.uint8)).tobytes()


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


# ---- partitions and thresholds


def group_bits(close: np.ndarray, sizes: list[int]) -> list[list[int]]:
    """Greedy: each partition starts with a free bit and takes the bits most correlated with it."""
    free, out = list(range(len(close))), []
    for size in sizes:
        group = [free.pop(0)] if free else []
        sums = close[group[0]].copy() if group else None
        while len(group) < size and free:
            best = max(free, key=lambda b: sums[b])
            free.remove(best)
            group.append(best)
            sums += close[best]
        out.append(group)
    return out


def allocate(costs: list[dict[int, float]], gains: list[dict[int, int]], need: int) -> tuple[list[int], float]:
    """A threshold for each partition: the least cost whose gains reach need. By dynamic programming."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for cost, gain in zip(costs, gains):
        grown: dict[int, tuple[float, list[int]]] = {}
        for have, (spent, chosen) in best.items():
            for t, c in cost.items():
                k = min(need, have + gain[t])
                if k not in grown or spent + c < grown[k][0]:
                    grown[k] = (spent + c, [*chosen, t])
        best = grown
    if need not in best:
        return [max(c) for c in costs], math.inf
    spent, chosen = best[need]
    return chosen, spent


def odds_within(p: np.ndarray, most: int) -> np.ndarray:
    """Chance that at most t of independent bits differ, t from 0 to most; p: each bit's chance to differ."""
    dist = np.zeros(most + 1)
    dist[0] = 1
    for x in p:
        dist[1:] = dist[1:] * (1 - x) + dist[:-1] * x
        dist[0] *= 1 - x
    return np.cumsum(dist)


def together(fps: DataFrame, bits: int) -> tuple[np.ndarray, int]:
    """How often each pair of bits is set together, over all fingerprints (column fp), and their number."""

    def rows(batches):
        total = np.zeros((bits, bits), np.int64)
        for b in batches:
            x = np.unpackbits(np.frombuffer(b"".join(v if isinstance(v, bytes) else int(v).to_bytes(8, "big", signed=True) for v in b.fp), np.uint8).reshape(len(b), -1), axis=1).astype(np.float32)
            total += (x.T @ x).astype(np.int64)
        if total.any():
            yield pd.DataFrame({"cell": np.arange(bits * bits), "n": total.ravel()})

    out, n = np.zeros(bits * bits), fps.count()
    cells = fps.select("fp").mapInPandas(rows, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # bits x bits at most
    out[cells["cell"].to_numpy()] = cells["n"].to_numpy()
    return out.reshape(bits, bits), n


def closeness(both: np.ndarray, n: int) -> np.ndarray:
    share = np.diag(both) / max(1, n)
    sd = np.sqrt(np.maximum(share * (1 - share), 1e-9))
    close = np.abs(both / max(1, n) - np.outer(share, share)) / np.outer(sd, sd)
    np.fill_diagonal(close, 0)
    return close


def plan(fps: DataFrame, distance: int) -> list[tuple[list[int], list[int], int]]:
    """Probes for all pairs within distance: the bits of a partition, a group of the other bits that has to agree
    as well, and the partition's threshold."""
    both, n = together(fps, BITS)
    close, share = closeness(both, n), np.diag(both) / max(1, n)
    differ = 2 * share * (1 - share)
    layouts = [group_bits(close, [BITS // m + (i < BITS % m) for i in range(m)]) for m in range(2, distance + 2)]
    flat = [g for layout in layouts for g in layout]
    keyed = fps.select(F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.col("fp").bitwiseAND(F.lit(mask(g))).alias("value")) for i, g in enumerate(flat)))).alias("k")).select("k.*")
    squares = dict(keyed.groupBy("i", "value").count().groupBy("i").agg(F.sum(F.col("count").cast("double") ** 2)).toPandas().itertuples(index=False))
    found = []
    at = 0
    for layout in layouts:
        costs, gains = [], []
        for i, group in enumerate(layout):
            within = odds_within(differ[group], distance)
            balls = np.cumsum([math.comb(len(group), t) for t in range(distance + 1)])
            costs.append({-1: 0.0} | {t: float(balls[t] * n + squares.get(at + i, 0) * within[t] / max(within[0], 1e-12)) for t in range(distance + 1)})
            gains.append({t: t + 1 for t in range(-1, distance + 1)})
        at += len(layout)
        thresholds, cost = allocate(costs, gains, distance + 1)
        found.append((cost, list(zip(layout, thresholds))))
    out = []
    for group, t in min(found, key=lambda x: x[0])[1]:
        rest = [b for b in range(BITS) if b not in group]
        n_rest, parts = len(rest), distance + 1
        inner = group_bits(close[np.ix_(rest, rest)], [n_rest // parts + (i < n_rest % parts) for i in range(parts)])
        out += [(group, [rest[b] for b in part], t) for part in inner if t >= 0]
    return out


def mask(bits: list[int]) -> int:
    """Bit 0 is the first of the fingerprint's digits."""
    return signed(sum(1 << (63 - b) for b in bits))


def ball(bits: list[int], radius: int) -> list[int]:
    """All patterns of at most radius of these bits."""
    out = [0]
    for _ in range(radius):
        out = sorted({x ^ (1 << (63 - b)) for x in out for b in bits} | set(out))
    return [signed(x) for x in out]


def keyed(fps: DataFrame, probes: list[tuple[list[int], list[int], int]]) -> DataFrame:
    """The index: (fp, i, value), the bits that probe i looks at."""
    return fps.select("fp", F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.col("fp").bitwiseAND(F.lit(mask(own + other))).alias("value")) for i, (own, other, _) in enumerate(probes)))).alias("k")).select("fp", "k.*")


def asked(fps: DataFrame, probes: list[tuple[list[int], list[int], int]]) -> DataFrame:
    """(fp, i, value, own): every value that a partner within the probe's threshold may have; own marks the fingerprint's own."""
    return fps.select("fp", F.explode(F.array(*(
        F.struct(F.lit(i).alias("i"), F.col("fp").bitwiseAND(F.lit(mask(own + other))).bitwiseXOR(F.lit(x)).alias("value"), F.lit(int(x == 0)).alias("own"))
        for i, (own, other, t) in enumerate(probes) for x in ball(own, t)
    ))).alias("k")).select("fp", "k.*")


def accompanied(fps: DataFrame, probes: list[tuple[list[int], list[int], int]]) -> DataFrame:
    """The distinct fingerprints for which a probe finds another one."""
    index = keyed(fps, probes).groupBy("i", "value").agg(F.count("*").alias("n"))
    if all(t == 0 for *_, t in probes):
        index = index.where("n > 1")
    return asked(fps, probes).join(index, ["i", "value"]).where("n > own").select("fp").distinct()


def probed_links(spark: SparkSession, fps: DataFrame, probes: list[tuple[list[int], list[int], int]], distance: int) -> DataFrame:
    """Links (a, b) that join all fingerprints within distance. Candidates come from the probes and are verified bit by bit.
    A value that more than CROWD fingerprints have would make too many pairs: what asks for it or has it is linked around
    points instead, which finds the same components at 65 rows a fingerprint."""
    company = Stash(spark, "company").put(accompanied(fps, probes))
    index, wants = keyed(company, probes), asked(company, probes)
    crowds = index.groupBy("i", "value").agg(F.count("*").alias("n")).where(F.col("n") > CROWD).select("i", "value")
    crowds = Stash(spark, "crowds").put(crowds)
    other = index.join(crowds, ["i", "value"], "left_anti").withColumnRenamed("fp", "b")
    pairs = wants.withColumnRenamed("fp", "a").join(other, ["i", "value"]).where((F.col("a") != F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance))
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    if not crowds.limit(1).count():
        return pairs
    crowded = wants.join(crowds, ["i", "value"], "left_semi").select("fp").unionByName(index.join(crowds, ["i", "value"], "left_semi").select("fp")).distinct()
    return pairs.unionByName(around_points(crowded, distance))


def around_points(fps: DataFrame, distance: int) -> DataFrame:
    """Links (a, b) among distinct fingerprints: fingerprints within 2 share a point within 1 of each, those within 1 the
    point without the bit that differs. A point has at most 65 members; each is linked to the smallest, if close enough."""
    if distance == 1:
        point = F.array(*(F.struct(F.lit(b).alias("b"), F.col("fp").bitwiseAND(F.lit(signed(~(1 << b) & 0xFFFFFFFFFFFFFFFF))).alias("v")) for b in range(BITS)))
    else:
        point = F.array(*(F.col("fp").bitwiseXOR(F.lit(x)) for x in ball(list(range(BITS)), 1)))
    groups = fps.select("fp", F.explode(point).alias("c")).groupBy("c").agg(F.collect_set("fp").alias("members")).where(F.size("members") > 1)
    pairs = groups.select(F.explode("members").alias("a"), F.array_min("members").alias("b"))
    return pairs.where((F.col("a") != F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)).distinct()


def link(spark: SparkSession, fps: DataFrame, distance: int = 2) -> DataFrame:
    """fps: distinct column fp (signed 64-bit). Returns (node, root) for those with a neighbour within distance (0 to 2)."""
    if distance not in (0, 1, 2):
        raise ValueError("distance must be 0, 1 or 2")
    if distance == 0:  # equal fingerprints are one row already
        return components(spark, fps.select(F.col("fp").alias("a"), F.col("fp").alias("b")))
    return components(spark, probed_links(spark, fps, plan(fps, distance), distance))


def fingerprints(docs: DataFrame, k: int = 3) -> DataFrame:
    """(doc_id, fp) of every row; fp is the fingerprint as a signed long."""

    def rows(batches):
        for b in batches:
            yield pd.DataFrame({"doc_id": b.doc_id, "fp": np.array([signed(fingerprint(t, k)) for t in b.text], np.int64)})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return small_batches(docs).select("doc_id", "text").mapInPandas(rows, f"doc_id {kind}, fp long")


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def simhash_classes(spark: SparkSession, docs: DataFrame, k: int = 3, distance: int = 2) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, the smallest doc_id reachable, of every row."""
    prints = Stash(spark, "simhash").put(fingerprints(docs, k))
    firsts = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = link(spark, firsts.select("fp"), distance)
    joined = firsts.join(roots, firsts.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    smallest = joined.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = joined.join(smallest, "root").select("fp", "component_id")
    return prints.join(classes, "fp").select("doc_id", hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


# ---- the pipeline's stage


def differing_share(similarity: float) -> float:
    """Expected share of differing bits of two equally large sets with this Jaccard similarity."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def wide_plan(prints: DataFrame, similarity: float) -> list[tuple[list[int], int]]:
    """Partitions of the wide fingerprints and their thresholds (-1, 0 or 1): the least estimated rows and candidates at which a
    pair at the limit is probed with the chance PROBED, or at EXTRA times what threshold 0 everywhere would give if that is
    less. Partitions don't overlap and hold bits that go together; their width follows the number of fingerprints, so that a
    value is shared by few by chance."""
    both, n = together(prints, WIDE)
    close, share = closeness(both, n), np.diag(both) / max(1, n)
    differ = 2 * share * (1 - share)
    width = min(48, max(10, math.ceil(math.log2(max(2, n))) + 4))
    count = WIDE // width
    groups = group_bits(close, [WIDE // count + (i < WIDE % count) for i in range(count)])
    p, units, costs, gains = differing_share(similarity), 1000, [], []
    for g in groups:
        chance, at_random = odds_within(np.full(len(g), p), 1), odds_within(differ[g], 1)
        balls = {0: 1, 1: 1 + len(g)}
        costs.append({-1: 0.0} | {t: balls[t] * n + float(n) * n * float(at_random[t]) for t in balls})
        gains.append({-1: 0} | {t: round(-units * math.log1p(-min(chance[t], 1 - 1e-9))) for t in balls})
    need = min(round(-units * math.log(1 - PROBED)), round(EXTRA * sum(g[0] for g in gains)))
    chosen, _ = allocate(costs, gains, need)
    return [(g, t) for g, t in zip(groups, chosen) if t >= 0]


def near_links(spark: SparkSession, prints: DataFrame, similarity: float, probes: list[tuple[list[int], int]]) -> DataFrame:
    """prints: (node, fp) distinct. Candidates (a, b, apart) from the probes: members of a shared value are put in order by
    further bits, and each is paired with the NEXT ones behind it, as far as the fingerprints' distance allows the similarity.
    The order is made by ranges, so a value that many share is cut over tasks (at a cut some pairs are left to the exact join)."""
    limit = differing_share(similarity) * WIDE
    most = limit + UNSURE * math.sqrt(limit * (1 - limit / WIDE))  # pairs at the limit itself scatter around it
    weights = [np.left_shift(1, np.arange(len(g), dtype=np.int64)) for g, _ in probes]
    # threshold 1: partners agree in all bits but one, which is left out and named in the key
    forms = [(i, w - w * (np.arange(len(w)) == b), b + 1) for i, ((_, t), w) in enumerate(zip(probes, weights)) for b in (range(len(w)) if t else [-1])]
    rest = [np.random.default_rng(SEED + i).permutation(np.setdiff1d(np.arange(WIDE), g))[:63] for i, (g, _) in enumerate(probes)]
    place = np.left_shift(1, np.arange(63, dtype=np.int64)[::-1])

    def keys(batches):
        for b in batches:
            for at in range(0, b.num_rows, PIECE):
                part = b.slice(at, PIECE)
                bits = np.unpackbits(np.frombuffer(b"".join(part.column("fp").to_pylist()), np.uint8).reshape(part.num_rows, -1), axis=1)
                node = part.column("node").to_numpy()
                for i, w, gone in forms:
                    value = ((bits[:, probes[i][0]] @ w) * np.int64(64) + gone).astype(np.uint64)
                    value = value * np.uint64(0x9E3779B97F4A7C15) ^ (np.uint64(i) << np.uint64(56))
                    yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(bits[:, rest[i]] @ place), pa.array(node)], ["key", "more", "node"])

    stash = Stash(spark, "keys")
    found = stash.put(prints.mapInArrow(keys, "key long, more long, node long"))

    def behind(batches):
        last: list[tuple[int, int]] = []
        for b in batches:
            key, node = (np.concatenate([np.array([x[i] for x in last], np.int64), b.column(c).to_numpy()]) for i, c in ((0, "key"), (1, "node")))
            left, right = [], []
            for d in range(1, NEXT + 1):
                for_new = np.arange(max(d, len(last)), len(key))  # pairs that end in this batch
                same = for_new[(key[for_new] == key[for_new - d]) & (node[for_new] != node[for_new - d])]
                left.append(np.minimum(node[same], node[same - d]))
                right.append(np.maximum(node[same], node[same - d]))
            last = list(zip(key[-NEXT:].tolist(), node[-NEXT:].tolist()))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], ["a", "b"])

    pairs = stash.put(found.repartitionByRange("key", "more", "node").sortWithinPartitions("key", "more", "node").mapInArrow(behind, "a long, b long").distinct())
    side = lambda name: prints.select(F.col("node").alias(name), F.col("fp").alias(f"fp_{name}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    word = lambda name, j: F.conv(F.substring(F.hex(f"fp_{name}"), 8 * j + 1, 8), 16, 10).cast("long")
    apart = reduce(lambda x, y: x + y, [F.bit_count(word("a", j).bitwiseXOR(word("b", j))) for j in range(WIDE // 32)])
    out = Stash(spark, "links").put(both.select("a", "b", apart.alias("apart")).where(F.col("apart") <= most))
    stash.drop_older(0)
    return out


def verified(spark: SparkSession, docs: DataFrame, holders: DataFrame, pairs: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose shingle sets are as similar as asked for. holders: (node, doc_id, text_hash), a row of each node.
    Pairs are dealt by the smallest node near them, so that a text is sent once or twice for all its pairs. Where more than
    FAMILY nodes meet, they are cut into blocks, and pairs are dealt by their two blocks: a task holds the sets of two at most."""
    stash = Stash(spark, "pairs")
    pairs = stash.put(pairs.select("a", "b").distinct())
    ends = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = ends.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("near"))
    of = lambda x: near.select(F.col("node").alias(x), F.col("near").alias(f"near_{x}"))
    placed = stash.put(pairs.join(of("a"), "a").join(of("b"), "b").select(F.least("near_a", "near_b").alias("root"), "a", "b"))
    sizes = stash.put(placed.groupBy("root").agg(F.ceil(F.least(2 * F.count("*"), F.approx_count_distinct("a") + F.approx_count_distinct("b")) / FAMILY).alias("blocks")).where("blocks > 1"))
    sizes = F.broadcast(sizes) if sizes.count() <= BROADCAST_SHINGLES else sizes  # the large ones only
    block = lambda x: F.pmod(F.xxhash64(x), F.coalesce("blocks", F.lit(1))).cast("int")
    dealt = stash.put(placed.join(sizes, "root", "left").select("root", F.least(block("a"), block("b")).alias("low"), F.greatest(block("a"), block("b")).alias("high"), "a", "b"))
    wanted = dealt.select("root", "low", "high", F.col("a").alias("node")).unionByName(dealt.select("root", "low", "high", F.col("b").alias("node"))).distinct()
    placed = stash.put(wanted.join(holders, "node").withColumnsRenamed({"doc_id": "at_id", "text_hash": "at_hash"}))
    few = placed.count() <= BROADCAST_TEXTS
    known = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    texts = known.join(F.broadcast(placed) if few else placed, known["doc_id"].eqNullSafe(placed["at_id"]) & (known["text_hash"] == placed["at_hash"]))
    none = F.lit(None)
    sent = texts.select("root", "low", "high", F.lit(0).alias("kind"), F.col("node").alias("a"), none.cast("long").alias("b"), "text")
    sent = sent.unionByName(dealt.select("root", "low", "high", F.lit(1).alias("kind"), "a", "b", none.cast("string").alias("text")))
    sent = sent.repartition("root", "low", "high").sortWithinPartitions("root", "low", "high", "kind")

    def rows(batches):
        lean()
        at, sets = None, {}
        for b in batches:
            left, right = [], []
            for *group, kind, x, y, text in zip(*(b.column(i).to_pylist() for i in range(6)), b.column(6)):
                if group != at:
                    at, sets = group, {}
                if kind == 0:
                    sets[x] = np.unique(shingle_hashes(text.as_py(), SHINGLE))
                    continue
                sx, sy = sets[x], sets[y]
                common = len(np.intersect1d(sx, sy, assume_unique=True))
                if common >= similarity * (len(sx) + len(sy) - common):
                    left.append(x)
                    right.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])

    out = Stash(spark, "verified").put(sent.mapInArrow(rows, "a long, b long"))
    stash.drop_older(0)
    return out


def common_shingles(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles in more than two rows of docs (up to RARE_STEPS times as many in large tables), sorted, and in how many rows each
    is. All rows are counted. Which shingles are told apart, MOST_COMMON at most, only sets the order. A batch's shingles are
    sent as one row for each part of the hashes, so that the JVM holds no row for a shingle; a part is counted at a time."""
    n_rows, size = docs.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    least = 2 * min(RARE_STEPS, max(1, n_rows // RARE))
    part_bits = min(MOST_PART_BITS, max(LEAST_PART_BITS, ((size or 0) // PART_BYTES).bit_length()))
    starts = np.arange(1 << part_bits, dtype=np.uint64) << np.uint64(64 - part_bits)

    def by_part(shingle, data):
        ends = np.append(np.searchsorted(shingle, starts), len(shingle)) * (data.nbytes // max(1, len(shingle)))
        return pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)])

    def cut(batches):
        lean()
        for b in batches:
            made = [np.unique(shingle_hashes(t.as_py(), SHINGLE)) for t in b.column("text")]
            shingle, n = np.unique(np.concatenate(made or [np.zeros(0, np.uint64)]), return_counts=True)
            once, more = shingle[n == 1], shingle[n > 1]
            pairs = np.column_stack([more, n[n > 1].astype(np.uint64)])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(starts), dtype=np.int32)), by_part(once, once), by_part(more, pairs)], ["part", "once", "more"])

    def counted(once, more):
        pairs = np.frombuffer(b"".join(more), np.uint64).reshape(-1, 2)
        once = np.frombuffer(b"".join(once), np.uint64)
        shingle, n = np.concatenate([once, pairs[:, 0]]), np.concatenate([np.ones(len(once), np.int64), pairs[:, 1].astype(np.int64)])
        order = np.argsort(shingle)
        shingle, n = shingle[order], n[order]
        first = np.flatnonzero(np.append(True, shingle[1:] != shingle[:-1])) if len(shingle) else np.zeros(0, np.int64)
        n = np.add.reduceat(n, first) if len(first) else n
        return pa.RecordBatch.from_arrays([pa.array(shingle[first][n > least].view(np.int64)), pa.array(n[n > least])], ["shingle", "n"])

    def count(batches):
        at, once, more = None, [], []
        for b in batches:
            for part, x, y in zip(*(c.to_pylist() for c in b.columns)):
                if part != at:
                    yield counted(once, more)
                    at, once, more = part, [], []
                once.append(x)
                more.append(y)
        yield counted(once, more)

    sent = docs.select("text").mapInArrow(cut, "part int, once binary, more binary").where("length(once) + length(more) > 0")
    counts = sent.repartition("part").sortWithinPartitions("part").mapInArrow(count, "shingle long, n long")
    counts = counts.orderBy(F.desc("n"), "shingle").limit(MOST_COMMON).toArrow().sort_by("shingle")
    return counts["shingle"].to_numpy(), counts["n"].to_numpy()


def first_shingles(h: np.ndarray, common: tuple[np.ndarray, np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Of a set (signed hashes): as many of the first in the common order as leave too few to be similar without them,
    and in about how many rows each is (0: not common)."""
    known, count = common
    often = np.zeros(len(h), np.int64)
    if len(known):
        at = np.minimum(np.searchsorted(known, h), len(known) - 1)
        often = np.where(known[at] == h, count[at], 0)
    if not len(h):
        return h, often
    first = np.lexsort((h, often))[: len(h) - math.ceil(similarity * len(h) - 1e-9) + 1]
    return h[first], often[first]


def shared_firsts(spark: SparkSession, sets: DataFrame) -> DataFrame:
    """sets: (node, root, size, first, often), repeats allowed. (shingle, node, size, pos) of the first shingles that nodes of
    several roots have. One shuffle of all first shingles, by shingle and, for common ones, a salt; what only one root has goes."""
    stash = Stash(spark, "first")
    spots = F.arrays_zip("first", "often")
    placed = sets.select("node", "root", "size", F.posexplode(spots).alias("pos", "s")).select("node", "root", "size", "pos", F.col("s.first").alias("shingle"), F.ceil(F.col("s.often") / BLOCK).cast("int").alias("salts"))
    placed = placed.withColumn("salt", F.when(F.col("salts") > 1, F.pmod(F.xxhash64("node"), F.col("salts"))).otherwise(0).cast("int"))
    group = Window.partitionBy("shingle", "salt")  # about BLOCK rows: a third of all rows can only share a common shingle
    held = placed.withColumns({"low": F.min("root").over(group), "high": F.max("root").over(group)}).where("low <> high or salts > 1")
    held = stash.put(held.drop("low", "high", "salt"))
    mixed = stash.put(held.groupBy("shingle").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("shingle"))
    few = mixed.count() <= BROADCAST_SHINGLES
    out = Stash(spark, "shared").put(held.join(F.broadcast(mixed) if few else mixed, "shingle").select("shingle", "node", "size", "pos").distinct())
    stash.drop_older(0)
    return out


def by_class(stash: Stash, shared: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """shared with each node's root, and of the shingles that still have several roots: main, the root with most rows,
    n, the rows, and outside, those of other roots."""
    few = roots.count() <= BROADCAST_SHINGLES
    rooted = stash.put(shared.join(F.broadcast(roots) if few else roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    counts = rooted.groupBy("shingle", "root").agg(F.count("*").alias("k"))
    sizes = counts.groupBy("shingle").agg(F.max(F.struct("k", "root")).alias("top"), F.sum("k").alias("n"))
    return rooted, sizes.select("shingle", F.col("top.root").alias("main"), "n", (F.col("n") - F.col("top.k")).alias("outside")).where("outside > 0")


def star_pairs(spark: SparkSession, shared: DataFrame, roots: DataFrame, similarity: float) -> tuple[DataFrame, int]:
    """For shingles with more than CROWDED pairs to compare: each node outside the shingle's largest class with one member of
    that, another for each shingle. Returns the pairs (a, b) and how many rows stand outside."""
    rooted, sizes = by_class(Stash(spark, "rooted"), shared, roots)
    crowded = Stash(spark, "crowded").put(sizes.where(F.col("outside") * F.col("n") > CROWDED))
    outside = crowded.agg(F.sum("outside")).first()[0] or 0
    inside = rooted.join(crowded, "shingle")
    picks = inside.where("root = main").groupBy("shingle").agg(F.min(F.struct(F.xxhash64("node", "shingle").alias("h"), "node", "size")).alias("p"))
    pairs = inside.where("root <> main").join(picks, "shingle").where(F.least("size", "p.size") >= similarity * F.greatest("size", "p.size") - 1e-6)
    return pairs.select(F.least("node", "p.node").alias("a"), F.greatest("node", "p.node").alias("b")).distinct(), outside


def exact_pairs(spark: SparkSession, shared: DataFrame, roots: DataFrame, similarity: float) -> DataFrame:
    """All pairs (a, b, score, root_a, root_b) of different roots that may be similar enough, by the first shingles that they share. What two sets
    have in common lies in both firsts, or behind the firsts of the one whose firsts end earlier: so the number shared decides.
    Of shingles with more than CROWDED pairs, the rows carry what their nodes share earlier (up to EARLIER shingles), and a
    pair meets only at the first that it shares: there, what stands behind decides. The score grows with what may be common."""
    stash = Stash(spark, "sizes")
    rooted, sizes = by_class(stash, shared, roots)
    crowded = F.col("outside") * F.col("n") > CROWDED
    sizes = stash.put(sizes.select("shingle", "main", crowded.alias("crowded"), F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")))
    sized = rooted.join(F.broadcast(sizes) if sizes.count() <= BROADCAST_SHINGLES else sizes, "shingle")
    sized = stash.put(sized)
    crowds = sized.where("crowded").groupBy("node").agg(F.count("*").alias("k"))
    lists = sized.join(crowds, "node").groupBy("node").agg(F.max("k").alias("k"), F.collect_list(F.struct("pos", "shingle")).alias("held")).where(F.size("held") <= EARLIER)  # first shingles of one text
    lists = stash.put(lists)
    before = F.transform(F.filter("held", lambda x: x["pos"] < F.col("pos")), lambda x: x["shingle"])
    thick = sized.where("crowded").join(lists, "node", "left").withColumn("before", before).drop("held")
    larger, both = F.greatest("size_a", "size_b"), F.col("size_a") + F.col("size_b")
    once = (F.col("root_b") == F.col("main_b")) | (F.col("node_a") < F.col("node_b"))
    alike = (F.col("root_a") != F.col("root_b")) & once & (F.least("size_a", "size_b") >= similarity * larger - 1e-6)

    rest = F.least(F.col("size_a") - F.col("pos_a"), F.col("size_b") - F.col("pos_b"))

    def met(df: DataFrame, kept: Column, sure: Column, more: tuple[str, ...] = ()) -> DataFrame:
        named = lambda d, x: d.select("shingle", "block", *(F.col(c).alias(f"{c}_{x}") for c in ("node", "root", "size", "main", "pos", *more)))
        a = named(df.where("root <> main").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))), "a")
        b = named(df.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")), "b")
        pairs = a.join(b, ["shingle", "block"]).where(alike & kept)
        turned = F.col("node_a") > F.col("node_b")
        enough = similarity / (1 + similarity) * both - F.ceil(similarity * larger - 1e-9) + 1 - 1e-6  # of first shingles shared
        return pairs.select(
            F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b"), F.when(turned, F.col("root_b")).otherwise(F.col("root_a")).alias("root_a"),
            F.when(turned, F.col("root_a")).otherwise(F.col("root_b")).alias("root_b"), sure.alias("sure"), enough.alias("enough"), (rest / both).alias("score"))

    told = F.col("before_a").isNotNull() & F.col("before_b").isNotNull()
    first = ~F.arrays_overlap("before_a", "before_b") & ((1 + similarity) * rest >= similarity * both - 1e-6)
    rows = met(sized.where("not crowded"), F.lit(True), F.lit(False)).unionByName(met(thick, ~told | first, told, ("before",)))
    counted = rows.groupBy("a", "b").agg(F.max("sure").alias("sure"), F.count_if(~F.col("sure")).alias("n"), *(F.first(c).alias(c) for c in ("enough", "root_a", "root_b")), F.max("score").alias("score"))
    of = lambda x: lists.select(F.col("node").alias(x), F.col("k").alias(f"k_{x}"))
    uncounted = F.when(F.col("k_a").isNotNull() & F.col("k_b").isNotNull(), F.least("k_a", "k_b")).otherwise(0)  # crowded ones, where both have lists
    known = counted.join(of("a"), "a", "left").join(of("b"), "b", "left")
    out = Stash(spark, "exact").put(known.where(F.col("sure") | (F.col("n") + uncounted >= F.col("enough"))).select("a", "b", "score", "root_a", "root_b"))
    stash.drop_older(0)
    return out


def near_classes(spark: SparkSession, docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, text_hash, root): the class of every row."""
    common = spark.sparkContext.broadcast(common_shingles(small_batches(docs)))

    def rows(batches):
        lean()
        for b in batches:
            for at in range(0, b.num_rows, PIECE):
                part, made = b.slice(at, PIECE), []
                for t in part.column("text").to_pylist():
                    h = np.unique(shingle_hashes(t, SHINGLE))
                    made.append((signed(xxhash.xxh64_intdigest(h.tobytes(), SEED)), wide_of(h), len(h), *first_shingles(h.view(np.int64), common.value, similarity)))
                node, fp, size, first, often = zip(*made)
                made = [pa.array(node, pa.int64()), pa.array(fp, pa.binary()), pa.array(size, pa.int32()), pa.array(first, pa.list_(pa.int64())), pa.array(often, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_hash"), *made], ["doc_id", "text_hash", "node", "fp", "size", "first", "often"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    made = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(rows, f"doc_id {kind}, text_hash long, node long, fp binary, size int, first array<long>, often array<long>")
    stash = Stash(spark, "wide")
    kept = stash.put(made)  # equal sets are one node
    common.destroy()
    # the row that shows a node's text, and stands for it: the same one wherever the node is met
    held = stash.put(kept.groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("h")).select("node", "h.doc_id", "h.text_hash"))
    prints = stash.put(kept.groupBy("node").agg(F.first("fp").alias("fp")))
    links = near_links(spark, prints, similarity, wide_plan(prints, similarity))
    union = lambda pairs, known: known if not pairs.limit(1).count() else stash.put(components(spark, pairs.select("a", "b").unionByName(known.select(F.col("node").alias("a"), F.col("root").alias("b")))))
    rooted = lambda df, roots, x: df.join(roots.select(F.col("node").alias(x), F.col("root").alias(f"root_{x}")), x, "left").withColumn(f"root_{x}", F.coalesce(f"root_{x}", x))
    apart = lambda pairs, roots: rooted(rooted(pairs, roots, "a"), roots, "b").where("root_a <> root_b").select("a", "b")
    # first each node with its nearest candidate, then those whose ends are still apart
    ends = links.select("a", "b", "apart").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"), "apart"))
    nearest = ends.groupBy("a").agg(F.min_by("b", F.struct("apart", "b")).alias("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    none = spark.range(0).select(F.col("id").alias("node"), F.col("id").alias("root"))  # rows of a list would need Python workers of their own
    roots = union(verified(spark, docs, held, nearest, similarity), none)
    roots = union(verified(spark, docs, held, apart(links, roots), similarity), roots)
    few = roots.count() <= BROADCAST_SHINGLES
    sets = kept.join(F.broadcast(roots) if few else roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "size", "first", "often")
    shared = shared_firsts(spark, sets)
    left = math.inf
    while True:  # large families that probing left in several classes, as long as a round halves what stands outside
        pairs, outside = star_pairs(spark, shared, roots, similarity)
        if not outside or outside > left / 2:
            break
        roots, left = union(verified(spark, docs, held, pairs, similarity), roots), outside
    pairs = exact_pairs(spark, shared, roots, similarity)
    # one link makes two classes one, so the best pairs of every two classes come first
    slot = F.pmod(F.xxhash64("a", "b"), F.lit(BEST)).alias("slot")
    best = pairs.groupBy(F.least("root_a", "root_b"), F.greatest("root_a", "root_b"), slot).agg(F.max_by(F.struct("a", "b"), F.struct("score", "a", "b")).alias("p"))
    best = stash.put(best.select("p.*"))
    roots = union(verified(spark, docs, held, best, similarity), roots)
    now = lambda x: roots.select(F.col("node").alias(f"root_{x}"), F.col("root").alias(f"now_{x}"))
    met = pairs.select("root_a", "root_b").distinct().join(now("a"), "root_a", "left").join(now("b"), "root_b", "left")
    two = stash.put(met.where(F.coalesce("now_a", "root_a") != F.coalesce("now_b", "root_b")).select("root_a", "root_b"))
    rest = pairs.join(F.broadcast(two) if two.count() <= BROADCAST_SHINGLES else two, ["root_a", "root_b"], "left_semi").join(best, ["a", "b"], "left_anti")
    roots = union(verified(spark, docs, held, rest, similarity), roots)
    classes = Stash(spark, "classes").put(kept.join(roots, "node", "left").select("doc_id", "text_hash", F.coalesce("root", "node").alias("root")))
    stash.drop_older(0)
    return classes


def near_dedup(spark: SparkSession, docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row of each class stays, that with the smallest doc_id (nulls last; of equal ones the smallest text hash)."""
    classes = near_classes(spark, docs, similarity)
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    best = classes.groupBy("root").agg(F.min(rank).alias("best")).select(F.col("best.doc_id").alias("kept_id"), F.col("best.text_hash").alias("kept_hash"))
    kept = docs.join(best, docs["doc_id"].eqNullSafe(best["kept_id"]) & (F.xxhash64(docs["text"]) == best["kept_hash"]), "left_semi")
    if classes.groupBy("doc_id", "text_hash").count().where("count > 1").limit(1).count():
        kept = kept.dropDuplicates(["doc_id", "text"])
    return kept


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_classes(spark, table(spark, sf_dir, "documents"))
