"""Operator 7: document fingerprints as invertible Bloom lookup sketches.

A text is cut into paragraphs: at line ends, after sentence marks, and inside long stretches at words
picked by their own hash, so an edit leaves all paragraphs outside it as they were. The digest of each
paragraph (the n-th of equal ones counts as another) is added to three cells, which keep a count, the
exclusive-or of the digests and that of a check hash. The sketch of one version minus that of
another holds only what differs; peeling cells with one digest recovers these, and where that fails the
sketches are made again FACTOR times as large (after RETRIES times, which takes colliding digests, the digests
themselves are compared). Likeness is the share of common digests.

Peeling runs over all pairs of a batch at once, in numpy; a pair's size depends on its difference. The fingerprint
columns hold the first size, CELLS; from these strings alone differences of about a dozen paragraphs
can be told, and likeness beyond that comes from the larger sketches of the retries.

Rows are dealt to buckets of neighbouring keys, at most MOST_BUCKETS, by cuts found from the keys alone. A bucket streams through
a task in sorted order, so a large one costs time and spill but no memory.

Defined cases: a null text is empty; two texts without paragraphs are alike (1.0); equal doc_ids are
put in order by the texts' hash, null doc_ids come last; repeated rows count as rows; in a table of one
row that row is its own next; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.common import Stash, small_batches, table

CELLS, FACTOR, HASHES = 18, 4, 3
LONG, WORDS_MOST = 160, 64
RETRIES = 10  # sketches of about five million cells
BUCKET_BYTES, MOST_BUCKETS, CUT_ROWS, MOST_CUT_ROWS = 4 << 20, 100_000, 20, 400_000
SENTENCE = re.compile(r"\n+|(?<=[.!?])[ \t]+")


def paragraphs(text: str) -> list[str]:
    out = []
    for x in SENTENCE.split(text):
        if len(x) <= LONG:
            if x:
                out.append(x)
            continue
        part: list[str] = []
        for w in x.split(" "):
            part.append(w)
            if len(part) >= WORDS_MOST or not zlib.crc32(w.encode("utf-8", "replace")) & 7:
                out.append(" ".join(part))
                part = []
        if part:
            out.append(" ".join(part))
    return out


def digests(text: str) -> np.ndarray:
    seen: dict[str, int] = {}
    out = []
    for x in paragraphs(text):
        n = seen[x] = seen.get(x, -1) + 1
        out.append(xxhash.xxh64_intdigest(x, n))
    return np.array(out, np.uint64)


def mix(x: np.ndarray, salt: int) -> np.ndarray:
    z = x + np.uint64(salt * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


class Cells:
    """Sketches side by side; sketch i has sizes[i] cells (a multiple of HASHES) from starts[i] on."""

    def __init__(self, sizes: np.ndarray):
        self.sizes = sizes.astype(np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])
        total = int(self.starts[-1])
        self.count, self.keys, self.check = np.zeros(total, np.int64), np.zeros(total, np.uint64), np.zeros(total, np.uint64)

    def at(self, which: np.ndarray, keys: np.ndarray, j: int) -> np.ndarray:
        third = self.sizes[which] // HASHES
        return self.starts[which] + j * third + (mix(keys, j + 1) % third.astype(np.uint64)).astype(np.int64)

    def add(self, which: np.ndarray, keys: np.ndarray, sign: np.ndarray) -> None:
        check = mix(keys, 99)
        for j in range(HASHES):
            i = self.at(which, keys, j)
            np.add.at(self.count, i, sign)
            np.bitwise_xor.at(self.keys, i, keys)
            np.bitwise_xor.at(self.check, i, check)

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each sketch: digests recovered from the first version, from the second, and whether nothing is left."""
        n = len(self.sizes)
        owner = np.repeat(np.arange(n), self.sizes)
        plus, minus = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for _ in range(200):
            pure = np.flatnonzero((np.abs(self.count) == 1) & (mix(self.keys, 99) == self.check))
            if not len(pure):
                break
            found = np.unique(np.stack([owner[pure].astype(np.uint64), self.keys[pure]]), axis=1, return_index=True)[1]
            which, keys, sign = owner[pure[found]], self.keys[pure[found]], self.count[pure[found]]
            np.add.at(plus, which[sign > 0], 1)
            np.add.at(minus, which[sign < 0], 1)
            self.add(which, keys, -sign)
        dirty = np.zeros(n, bool)
        dirty[owner[(self.count != 0) | (self.keys != 0) | (self.check != 0)]] = True
        return plus, minus, ~dirty


def likenesses(pairs: list[tuple[np.ndarray, np.ndarray]], cells: int = CELLS) -> np.ndarray:
    """Share of common digests of each pair, recovered from sketches alone."""
    out = np.ones(len(pairs))
    todo = np.array([i for i, (a, b) in enumerate(pairs) if len(a) or len(b)], np.int64)
    for _ in range(RETRIES):
        if not len(todo):
            return out
        c = Cells(np.full(len(todo), cells))
        for side, sign in ((0, 1), (1, -1)):
            each = [pairs[i][side] for i in todo]
            which = np.repeat(np.arange(len(todo)), [len(x) for x in each])
            c.add(which, np.concatenate(each) if each else np.zeros(0, np.uint64), np.full(len(which), sign))
        plus, minus, whole = c.peel()
        na, nb = (np.array([len(pairs[i][s]) for i in todo]) for s in (0, 1))
        whole &= na - plus == nb - minus
        out[todo[whole]] = ((na - plus) / np.maximum(na + minus, 1))[whole]
        todo, cells = todo[~whole], cells * FACTOR
    for i in todo:  # only colliding digests get here
        a, b = pairs[i]
        common = sum((Counter(a.tolist()) & Counter(b.tolist())).values())
        out[i] = common / max(1, len(a) + len(b) - common)
    return out


def recover(a: str, b: str, cells: int = CELLS) -> tuple[set[int], set[int]]:
    """The paragraph digests that only a has, and those that only b has."""
    da, db = digests(a), digests(b)
    for _ in range(RETRIES):
        c = Cells(np.array([cells]))
        for keys, sign in ((da, 1), (db, -1)):
            c.add(np.zeros(len(keys), np.int64), keys, np.full(len(keys), sign))
        got: tuple[set[int], set[int]] = (set(), set())
        while True:
            pure = np.flatnonzero((np.abs(c.count) == 1) & (mix(c.keys, 99) == c.check))
            if not len(pure):
                break
            keys, first = np.unique(c.keys[pure], return_index=True)
            sign = c.count[pure[first]]
            for k, s in zip(keys.tolist(), sign.tolist()):
                got[s < 0].add(k)
            c.add(np.zeros(len(keys), np.int64), keys, -sign)
        if not (c.count.any() or c.keys.any() or c.check.any()):
            return got
        cells *= FACTOR
    return set(da.tolist()) - set(db.tolist()), set(db.tolist()) - set(da.tolist())


def sketches(each: list[np.ndarray], cells: int = CELLS) -> list[str]:
    """The sketch of each list of digests as text: the cells' counts, digests and checks (32 bits), base64."""
    c = Cells(np.full(len(each), cells))
    which = np.repeat(np.arange(len(each)), [len(x) for x in each])
    c.add(which, np.concatenate(each) if each else np.zeros(0, np.uint64), np.ones(len(which), np.int64))
    count, keys, check = (x.reshape(len(each), cells) for x in (c.count.astype("<i4"), c.keys.astype("<u8"), c.check.astype("<u4")))
    return [base64.b64encode(a.tobytes() + b.tobytes() + d.tobytes()).decode() for a, b, d in zip(count, keys, check)]


def edited(text: str, other: str) -> str:
    third = len(text) // 3
    return text[: len(text) - third] + other[:third]


COLUMNS = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def compare(keys: list, texts: list[str], cells: int) -> list[list]:
    """The COLUMNS of all but the last text; each is held against the one behind it."""
    n = len(texts) - 1
    own = [digests(t) for t in texts]
    new = [edited(a, b) for a, b in zip(texts, texts[1:])]
    changed = [digests(t) for t in new]
    return [
        keys[:n], [len(t) for t in texts[:n]], [hashlib.sha256(t.encode("utf-8", "replace")).hexdigest() for t in new], sketches(own[:n], cells), sketches(changed, cells),
        likenesses(list(zip(own[:n], changed)), cells), likenesses(list(zip(own[:n], own[1:])), cells),
    ]


def place(key: Column | str = "doc_id", tie: Column | None = None) -> Column:
    """What rows are ordered by: known keys, the key, then the text's hash."""
    key = F.col(key) if isinstance(key, str) else key
    return F.struct(key.isNotNull().alias("known"), key.alias("doc_id"), (F.xxhash64("text") if tie is None else tie).alias("tie"))


def bucket_cuts(keys: DataFrame, buckets: int, n: int) -> list:
    """Ascending places that cut the rows into buckets of about one size, from a sample, chosen by hash, of some rows a
    bucket. They only deal the rows: any cuts give the same result."""
    if buckets < 2:
        return []
    each = max(2, min(CUT_ROWS, MOST_CUT_ROWS // buckets))
    drawn = keys.where(F.pmod(F.xxhash64("place"), F.lit(max(1, n // (buckets * each)))) == 0).select("place").distinct()
    spots = [r.place for r in drawn.orderBy("place").collect()]
    return [spots[i] for i in sorted({len(spots) * i // buckets for i in range(1, buckets)})] if spots else []


def ordered_with_next(docs: DataFrame) -> DataFrame:
    """(bucket, last, doc_id, text): buckets of neighbouring doc_ids, descending, each with the row that follows it
    (last = 1) behind its own rows. The table is read twice, first for keys only, and the texts are shuffled once."""
    spark, d = docs.sparkSession, docs.select("doc_id", "text")
    keys = Stash(spark, "keys").put(d.select(place().alias("place"), F.octet_length("text").alias("bytes")))
    n, size = keys.agg(F.count("*"), F.sum("bytes")).first()
    buckets = min(MOST_BUCKETS, max(1, math.ceil((size or 0) / BUCKET_BYTES)))
    kind = keys.schema["place"].dataType.simpleString()
    cuts = spark.createDataFrame([(bucket_cuts(keys, buckets, n),)], f"cuts array<{kind}>")  # one row
    halves = [1 << k for k in reversed(range(buckets.bit_length()))]
    below = lambda p: F.aggregate(F.array(*map(F.lit, halves)), F.lit(0), lambda at, step: F.when(F.get(F.col("cuts"), at + step - 1) <= p, at + step).otherwise(at))
    heads = keys.crossJoin(F.broadcast(cuts)).groupBy(below(F.col("place")).alias("bucket")).agg(F.max("place").alias("head")).orderBy("bucket").collect()  # a row for each bucket
    after = [heads[(i + 1) % len(heads)].bucket for i in range(len(heads))]  # the bucket above; round to the lowest from the top
    small = spark.createDataFrame([(h.bucket, h.head, to) for h, to in zip(heads, after)], f"at int, head {kind}, goes int")
    rows = d.withColumn("place", place()).crossJoin(F.broadcast(cuts)).withColumn("bucket", below(F.col("place"))).drop("cuts")
    known = rows.join(F.broadcast(small), F.col("bucket") == F.col("at"))
    own, behind = F.struct(F.col("bucket"), F.lit(0).alias("last")), F.struct(F.col("goes").alias("bucket"), F.lit(1).alias("last"))
    both = known.select("doc_id", "text", "place", F.explode(F.when(F.col("place").eqNullSafe(F.col("head")), F.array(own, behind)).otherwise(F.array(own))).alias("b"))
    dealt = both.select("doc_id", "text", "place", "b.bucket", "b.last").repartitionById(max(1, buckets), F.col("bucket"))
    return dealt.sortWithinPartitions("bucket", "last", F.col("place").desc()).select("bucket", "last", "doc_id", "text")


def fingerprint_versions(docs: DataFrame, cells: int = CELLS) -> DataFrame:
    kind = docs.schema["doc_id"].dataType
    ready = ordered_with_next(small_batches(docs))

    def rows(batches):
        bucket, keys, texts, closed = None, [], [], False
        key_type = None

        def out():
            made = compare(keys, texts, cells)
            types = [key_type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(made, types)], COLUMNS)

        for b in batches:
            key_type = b.schema.field("doc_id").type
            for which, last, key, text in zip(*(c.to_pylist() for c in b.columns)):
                if which != bucket:
                    bucket, keys, texts, closed = which, [], [], False
                if closed:  # the row that follows the bucket, repeated
                    continue
                keys.append(key)
                texts.append(text or "")
                closed = last == 1
                if closed or len(texts) > 500:  # the last text is the next one's first
                    yield out()
                    keys, texts = keys[-1:], texts[-1:]

    return ready.mapInArrow(rows, f"doc_id {kind.simpleString()}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op7_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_versions(table(spark, sf_dir, "documents"))
