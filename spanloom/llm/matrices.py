"""Operator 3: best-fit-decreasing packing into id matrices.

Documents become token ids and a separator; longer ones than a row are cut losslessly into pieces.
Pieces are dealt to shards of about SHARD_DOCS documents by a hash of their place; in each, pieces in decreasing length go to the
bin with the least sufficient room, found in a segment tree over room sizes. A shard writes one row
for each sequence: ids (padded with PAD), cumulative segment lengths and positions that start
again at each segment. Both matrices are little-endian, 16 bits a value if the vocabulary fits, else 32.

Defined cases: a null text is empty and makes a piece with the separator alone; repeated rows and
null keys are packed as rows of their own; an empty table gives an empty result; columns other than
doc_id and text are not read. Each shard leaves at most one bin that a larger shard might have
filled better.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.common import small_batches, table
from spanloom.llm.packing import CAPACITY, cut_pieces
from spanloom.llm.tokens import encoder, tokenizer_path

PAD, SHARD_DOCS, SHARDS_A_TASK = 0, 2000, 4
SCHEMA = "sequence_id long, n_tokens int, n_segments int, doc_ids array<{kind}>, pieces array<int>, starts array<long>, cumulative_lengths array<int>, input_ids binary, position_ids binary"


class Rooms:
    """Segment tree over room sizes 0 to capacity; a leaf counts the bins with that room."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, room: int, which: int) -> None:
        self.bins[room].append(which)
        i = self.size + room
        while i:
            self.count[i] += 1
            i >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """Removes and returns (bin, room) with the smallest room of at least `least`."""
        i = self.size + least
        if not self.count[i]:
            while i > 1 and (i & 1 or not self.count[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i = 2 * i if self.count[2 * i] else 2 * i + 1
        room = i - self.size
        while i:
            self.count[i] -= 1
            i >>= 1
        return self.bins[room].pop(), room


def best_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> list[list[int]]:
    """Bins of indices into lengths."""
    rooms, bins = Rooms(capacity), []
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        found = rooms.take(need)
        if found is None:
            bins.append([])
            found = len(bins) - 1, capacity
        bins[found[0]].append(i)
        rooms.add(found[1] - need, found[0])
    return bins


def matrices(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, shard_docs: int = SHARD_DOCS) -> DataFrame:
    path = path or tokenizer_path()
    unit = "<u2" if encoder(path).tokenizer.get_vocab_size() <= 65536 else "<u4"
    shards = max(1, math.ceil(docs.count() / shard_docs))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def cut(batches):
        known, made = encoder(path), 0
        part = TaskContext.get().partitionId()
        for b in batches:
            out = cut_pieces(b, known, capacity, True)
            out["part"], out["place"] = part, np.arange(made, made + len(out))
            made += len(out)
            out["doc_id"] = b.doc_id.iloc[out["at"]].array
            out["ids"] = [np.frombuffer(x, "<u4").astype(unit).tobytes() for x in out.ids]
            yield out[["doc_id", "piece", "start", "length", "ids_crc32", "ids", "part", "place"]]

    made = small_batches(docs).select("doc_id", "text").mapInPandas(cut, f"doc_id {kind}, piece int, start long, length int, ids_crc32 long, ids binary, part int, place long")
    # by where a piece was made, so that equal rows go to different shards, and a task made again deals them alike
    dealt = made.withColumn("shard", F.pmod(F.xxhash64("part", "place"), F.lit(shards))).repartition(math.ceil(shards / SHARDS_A_TASK), "shard")
    blank = np.full(capacity, PAD, unit).tobytes()
    width = len(blank) // capacity

    def pack_shard(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values(["doc_id", "piece", "ids_crc32"], na_position="last", kind="stable", ignore_index=True)
        shard, lengths, out = int(b.shard.iloc[0]), b.length.to_numpy(np.int64), []
        keys = b.doc_id.astype(object).where(b.doc_id.notna(), None).tolist()
        pieces, starts, ids = b.piece.tolist(), b.start.tolist(), b.ids.tolist()
        for k, inside in enumerate(best_fit_decreasing(lengths, capacity)):
            own = lengths[inside]
            ends = np.cumsum(own)
            total = int(ends[-1])
            positions = np.zeros(capacity, unit)
            positions[:total] = np.arange(total) - np.repeat(ends - own, own)
            row = b"".join([ids[i] for i in inside]) + blank[: width * (capacity - total)]
            out.append((k * shards + shard, total, len(own), [keys[i] for i in inside], [pieces[i] for i in inside], [starts[i] for i in inside], [0, *ends.tolist()], row, positions.tobytes()))
        return pd.DataFrame(out, columns=[c.split()[0] for c in SCHEMA.split(", ")])

    return dealt.groupBy("shard").applyInPandas(pack_shard, SCHEMA.format(kind=kind))


def write_matrices(docs: DataFrame, out: str, **settings) -> None:
    """Parquet files of the packed rows; see above for the binary columns."""
    matrices(docs, **settings).write.mode("overwrite").parquet(out)


def op3_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrices(table(spark, sf_dir, "documents"))
