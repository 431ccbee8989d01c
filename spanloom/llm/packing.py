"""Operator 6: best-two-fit packing of token ids into sequences.

A bin is filled greedily, the largest unpacked length that fits first. Then its smallest document
makes room: of all pairs of unpacked lengths that fit the expanded gap more tightly, the tightest
replaces it, again and again while that narrows the gap.

Bins depend only on lengths, and there are at most `capacity` of these. So the plan is made once,
globally, from the histogram of lengths: a pattern of lengths is found and used as often as the
counts allow. The plan is a list of rank ranges within each length, a few thousand rows whatever the
number of documents; each piece finds its place from its rank among the pieces of its length. Ranks
come from the position within a written partition plus the counts of the partitions before it, so no
length is ever sorted or gathered, however many pieces share it. These counts are broadcast up to BROADCAST_CELLS; beyond,
pieces are joined to them by task and length, so no key has more rows than one task made.

Defined cases: a null text is empty and makes one piece with the separator alone; repeated rows and
null keys are packed as rows of their own; an empty table gives an empty result; columns other than
doc_id and text are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.llm.common import Stash, small_batches, table
from spanloom.llm.tokens import Encoder, encoder, tokenizer_path

CAPACITY, SEPARATOR = 2048, 0
STEP = 44  # bits of a rank
BROADCAST_CELLS = 200_000


def cut_pieces(b: pd.DataFrame, encoder: Encoder, capacity: int, with_ids: bool) -> pd.DataFrame:
    """Rows of (at, piece, start, length, ids_crc32, ids); at is the row in b."""
    end = np.array([SEPARATOR], "<u4").tobytes()
    out = []
    for at, ids in enumerate(encoder.ids([t or "" for t in b.text])):
        data = ids + end
        for piece, lo in enumerate(range(0, len(data), 4 * capacity)):
            part = data[lo : lo + 4 * capacity]
            out.append((at, piece, lo // 4, len(part) // 4, zlib.crc32(part), part if with_ids else None))
    return pd.DataFrame(out, columns=["at", "piece", "start", "length", "ids_crc32", "ids"])


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids, little-endian unsigned 32-bit), and where each piece stands:
    part, the task that made it, and place, its rank among that task's pieces of its length."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, part int, place long" + ", ids binary" * with_ids

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, seen = encoder(path), np.zeros(capacity + 1, np.int64)
        part = TaskContext.get().partitionId()
        for b in batches:
            out = cut_pieces(b, known, capacity, with_ids)
            out["place"] = out.groupby("length").cumcount() + seen[out.length.to_numpy(np.int64)]
            seen += np.bincount(out.length.to_numpy(np.int64), minlength=capacity + 1)
            out["part"], out["doc_id"] = part, b.doc_id.iloc[out["at"]].array
            yield out[[c.split()[0] for c in schema.split(", ")]]

    return small_batches(docs).select("doc_id", "text").mapInPandas(rows, schema)


@dataclass
class Plan:
    """Rank ranges: pieces of `length` ranked from `first` on go `copies` to a sequence from `sequence` on, at `offset`."""

    length: np.ndarray
    first: np.ndarray
    copies: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    sequences: int

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        i = np.searchsorted((self.length << STEP) + self.first, (length << STEP) + rank, "right") - 1
        within = rank - self.first[i]
        return self.sequence[i] + within // self.copies[i], self.offset[i] + within % self.copies[i] * length


def tightest_pair(left: np.ndarray, gap: int, above: int) -> tuple[int, int] | None:
    """Two unpacked lengths whose sum is the largest up to gap, and more than above."""
    lengths = np.flatnonzero(left[: max(gap, 1)])
    if not len(lengths):
        return None
    at = np.searchsorted(lengths, np.minimum(gap - lengths, lengths), "right") - 1
    alone = (at >= 0) & (lengths[at] == lengths) & (left[lengths] < 2)
    at = at - alone
    sums = np.where(at >= 0, lengths + lengths[at], 0)
    best = int(np.argmax(sums))
    return (int(lengths[best]), int(lengths[at[best]])) if sums[best] > above else None


def fill(left: np.ndarray, capacity: int) -> dict[int, int]:
    """One bin: copies by length. left: how many pieces of each length are unpacked."""
    free, inside, gap = left.copy(), {}, capacity
    while gap:
        fits = np.flatnonzero(free[1 : gap + 1])
        if not len(fits):
            break
        length = int(fits[-1]) + 1
        copies = min(int(free[length]), gap // length)
        inside[length] = inside.get(length, 0) + copies
        free[length] -= copies
        gap -= copies * length
    while gap:
        smallest = min(inside)
        pair = tightest_pair(free, gap + smallest, smallest)
        if not pair:
            break
        inside[smallest] -= 1
        free[smallest] += 1
        for length in pair:
            inside[length] = inside.get(length, 0) + 1
            free[length] -= 1
        inside = {k: v for k, v in inside.items() if v}
        gap += smallest - sum(pair)
    return inside


def make_plan(counts: np.ndarray, capacity: int = CAPACITY) -> Plan:
    """counts[n]: pieces of length n, for n up to capacity."""
    left, used, sequence, out = counts.astype(np.int64).copy(), np.zeros(capacity + 1, np.int64), 0, []
    left[0] = 0
    while left.any():
        inside = fill(left, capacity)
        times = min(int(left[n]) // k for n, k in inside.items())
        offset = 0
        for n in sorted(inside, reverse=True):
            out.append((n, used[n], inside[n], sequence, offset))
            offset += n * inside[n]
            used[n] += times * inside[n]
            left[n] -= times * inside[n]
        sequence += times
    cells = np.array(sorted(out), np.int64).reshape(-1, 5).T
    return Plan(*cells, sequence)


def pack(spark: SparkSession, docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Every piece with its sequence_id and offset; with_ids adds its token ids."""
    stash = Stash(spark, "pieces")
    made = stash.put(pieces(docs, path or tokenizer_path(), capacity, with_ids))
    cells = stash.put(made.groupBy("part", "length").agg(F.count("*").alias("n")))
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in cells.groupBy("length").agg(F.sum("n")).toPandas().itertuples(index=False):
        counts[length] = n  # capacity rows at most
    plan = make_plan(counts, capacity)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = cells.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    few = cells.count() <= BROADCAST_CELLS  # a row for each task and length, so it grows with the table
    ranked = made.join(F.broadcast(starts) if few else starts.hint("merge"), ["part", "length"]).withColumn("rank", F.col("base") + F.col("place"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long" + ", ids binary" * with_ids

    def rows(batches):
        for b in batches:
            b["sequence_id"], b["offset"] = plan.place(b.length.to_numpy(np.int64), b["rank"].to_numpy(np.int64))
            yield b[[c.split()[0] for c in schema.split(", ")]]

    return ranked.mapInPandas(rows, schema)


def op6_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark, table(spark, sf_dir, "documents"))
