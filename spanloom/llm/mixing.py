"""Operator 10: mixing sources to target weights by iterative proportional fitting.

Tokens are counted by source, language and topic. The counts are raked: scaled to each margin's target
in turn until all margins hold. A cell's weight is its raked share over its own; documents are
sampled with a probability in proportion to it, by a hash of their key, so that every run and every
retried task chooses the same ones. The rate is the largest at which no probability is above 1 (or
as asked for), so the expected tokens have the target margins.

A document's topic, where none is given, is the largest of TOPICS classes of its words (a hash of each
distinct word of five letters or more); it stands for any classifier's label.

Scale: one pass over the texts, whose output is written without them. All categories are raked, however
many. Only cells that have tokens are held: up to DRIVER_CELLS on the driver, more as a table that takes one
factor a category and step. Counting is combined before its shuffle. Weights are broadcast if they are few;
else only those of the largest cells, so that no key of the join has most rows.

Defined cases: null source, language or topic is a category of its own; null and empty texts count one
token, so each document can be drawn; repeated rows with one key share their fate; null keys are drawn by
their text; targets for categories without tokens are dropped and the rest scaled up; categories without a
target keep their own share; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.common import Stash, small_batches, table

MARGINS = ("source", "lang", "topic")
TOPICS, LETTERS = 8, 5
DRIVER_CELLS = 200_000
BROADCAST_CELLS = 20_000
FLATTEN = 0.7
ROUNDS, CLOSE = 200, 1e-10
SEED = 2024


def topic_of(text: str) -> tuple[int, str]:
    """Words in the text, and its class."""
    said = text.lower().split()
    scores = [0] * TOPICS
    for w, n in Counter(said).items():
        if len(w) >= LETTERS:
            scores[zlib.crc32(w.encode("utf-8", "replace")) % TOPICS] += n
    return max(1, len(said)), f"topic{max(range(TOPICS), key=lambda i: (scores[i], -i))}"


def counted(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, source, lang, topic and n_tokens of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    given = "topic" in docs.columns

    def rows(batches):
        for b in batches:
            got = [topic_of(t or "") for t in b.text]
            b["n_tokens"] = [n for n, _ in got]
            if not given:
                b["topic"] = [t for _, t in got]
            yield b[["doc_id", "text_hash", "source", "lang", "topic", "n_tokens"]]

    d = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"), *(F.col(c).cast("string").alias(c) for c in MARGINS if c != "topic" or given))
    return small_batches(d).mapInPandas(rows, f"doc_id {kind}, text_hash long, source string, lang string, topic string, n_tokens long")


def rake(table_: np.ndarray, targets: list[np.ndarray]) -> np.ndarray:
    """Scales a table of non-negative counts until the sums along each axis are in proportion to its targets."""
    return rake_cells(table_.ravel(), [c.ravel() for c in np.indices(table_.shape)], targets).reshape(table_.shape)


def rake_cells(counts: np.ndarray, codes: list[np.ndarray], targets: list[np.ndarray]) -> np.ndarray:
    """The same for the cells that are there; codes: each cell's category, by margin."""
    x = counts / max(counts.sum(), 1e-300)
    for _ in range(ROUNDS):
        worst = 0.0
        for code, target in zip(codes, targets):
            sums = np.bincount(code, x, len(target))
            x = x * np.divide(target, sums, out=np.zeros_like(sums), where=sums > 0)[code]
            worst = max(worst, float(np.abs(sums - target).max(initial=0)))
        if worst < CLOSE:
            break
    return x


def aims(sums: np.ndarray, names: list[str], target: Mapping[str, float] | None) -> np.ndarray:
    """Target shares of a margin: as given, or the own shares to the power FLATTEN."""
    own = sums / max(sums.sum(), 1e-300)
    want = np.array([target.get(k, s) for k, s in zip(names, own)]) if target else own**FLATTEN
    want = np.where(own > 0, want, 0)
    return want / max(want.sum(), 1e-300)


def category(c: Column) -> Column:
    """Nulls apart from every text."""
    return F.coalesce(F.concat(F.lit("="), c), F.lit("null"))


def weights_on_driver(spark: SparkSession, cells: DataFrame, keys: list[str], given: list[Mapping[str, float] | None], keep_share: float | None) -> DataFrame:
    """The cells, DRIVER_CELLS at most, with weight and probability."""
    held = cells.toPandas().sort_values(keys, ignore_index=True)
    axes = [pd.Categorical(held[k]) for k in keys]
    codes, n = [a.codes.astype(np.int64) for a in axes], held.n.to_numpy(float)
    wanted = [aims(np.bincount(c, n), list(a.categories), g) for c, a, g in zip(codes, axes, given)]
    share = n / n.sum()
    weight = rake_cells(n, codes, wanted) / share
    chance = probabilities(weight, share, keep_share)
    return spark.createDataFrame(list(zip(*(held[k] for k in keys), held.n.tolist(), weight.tolist(), chance.tolist())), [*keys, "n", "weight", "probability"])


def weights_by_tables(spark: SparkSession, cells: DataFrame, keys: list[str], given: list[Mapping[str, float] | None], keep_share: float | None) -> DataFrame:
    """The same, with grouped sums and joins in place of arrays."""
    known, stash = Stash(spark, "aims"), Stash(spark, "rake")
    total = float(cells.agg(F.sum("n")).first()[0])
    wanted = []
    for k, g in zip(keys, given):
        own = cells.groupBy(k).agg((F.sum("n") / total).alias("own")).where("own > 0")
        if g:
            own = own.join(spark.createDataFrame([(c, float(v)) for c, v in g.items()], f"{k} string, given double"), k, "left").withColumn("want", F.coalesce("given", "own"))
        else:
            own = own.withColumn("want", F.col("own") ** FLATTEN)
        own = known.put(own.select(k, "want"))
        wanted.append(own.withColumn("want", F.col("want") / max(own.agg(F.sum("want")).first()[0], 1e-300)))
    now = cells.withColumn("x", F.col("n") / total)
    for _ in range(ROUNDS):
        worst = 0.0
        for k, want in zip(keys, wanted):
            step = stash.put(now.groupBy(k).agg(F.sum("x").alias("sum")).join(want, k).select(k, F.abs(F.col("sum") - F.col("want")).alias("off"), F.when(F.col("sum") > 0, F.col("want") / F.col("sum")).otherwise(0.0).alias("factor")))
            size, off = step.agg(F.count("*"), F.max("off")).first()
            worst = max(worst, off)
            factors = step.select(k, "factor")
            now = stash.put(now.join(F.broadcast(factors) if size <= BROADCAST_CELLS else factors, k).withColumn("x", F.col("x") * F.col("factor")).drop("factor"))
            stash.drop_older()
        if worst < CLOSE:
            break
    share = F.col("n") / total
    now = now.withColumn("weight", F.col("x") / share)
    least, most = now.agg(F.min(F.when(F.col("weight") > 0, F.col("weight"))), F.max("weight")).first()
    low, high = 0.0, 1 / max(least, 1e-12)
    for _ in range(20 if keep_share is not None else 0):  # as in probabilities, 31 places a pass
        places = np.linspace(low, high, 33)
        kept = now.agg(*(F.sum(F.least(F.lit(1.0), F.col("weight") * float(x)) * share) for x in places[1:-1])).first()
        at = sum(k < keep_share for k in kept)
        low, high = float(places[at]), float(places[at + 1])
    chance = F.col("weight") / most if keep_share is None else F.least(F.lit(1.0), F.col("weight") * high)
    return now.select(*keys, "n", "weight", chance.alias("probability"))


def mixed(spark: SparkSession, docs: DataFrame, targets: Mapping[str, Mapping[str, float]] | None = None, keep_share: float | None = None) -> DataFrame:
    """doc_id, text_hash, source, lang, topic, n_tokens, weight, probability and sampled of every row.
    targets: shares by margin and category. keep_share: expected share of tokens to keep, as far as probabilities allow."""
    stash = Stash(spark, "mixing")
    keys = [f"c_{m}" for m in MARGINS]
    rows = stash.put(counted(docs).withColumns({k: category(F.col(m)) for k, m in zip(keys, MARGINS)}))
    cells = stash.put(rows.groupBy(*keys).agg(F.sum("n_tokens").alias("n")))
    n_cells = cells.count()
    if not n_cells:
        return rows.select("doc_id", "text_hash", *MARGINS, "n_tokens", F.lit(0.0).alias("weight"), F.lit(0.0).alias("probability"), F.lit(False).alias("sampled"))
    given = [{"null" if k is None else f"={k}": v for k, v in (targets or {}).get(m, {}).items()} or None for m in MARGINS]
    weights = stash.put((weights_on_driver if n_cells <= DRIVER_CELLS else weights_by_tables)(spark, cells, keys, given, keep_share))
    if n_cells <= BROADCAST_CELLS:
        joined = rows.join(F.broadcast(weights.drop("n")), keys)
    else:
        largest = stash.put(weights.orderBy(F.desc("n"), *keys).limit(BROADCAST_CELLS).drop("n"))
        joined = rows.join(F.broadcast(largest), keys).unionByName(rows.join(F.broadcast(largest), keys, "left_anti").join(weights.drop("n"), keys))
    drawn = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), F.col("text_hash").cast("string"))), F.lit(SEED)).bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53))
    return joined.select("doc_id", "text_hash", *MARGINS, "n_tokens", "weight", "probability", (drawn < F.col("probability")).alias("sampled"))


def probabilities(weight: np.ndarray, share: np.ndarray, keep_share: float | None) -> np.ndarray:
    """In proportion to the weights and at most 1; without keep_share the margins are met exactly in expectation."""
    if keep_share is None:
        return weight / weight.max()
    low, high = 0.0, 1 / max(weight[weight > 0].min(), 1e-12)
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if float((np.minimum(1, mid * weight) * share).sum()) < keep_share else (low, mid)
    return np.minimum(1, high * weight)


def sampled(spark: SparkSession, docs: DataFrame, **settings) -> DataFrame:
    """The sampled rows of docs, with its columns."""
    out = mixed(spark, docs, **settings).where("not sampled").select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash")).distinct()
    return docs.join(out, docs["doc_id"].eqNullSafe(out["gone_id"]) & (F.xxhash64(docs["text"]) == out["gone_hash"]), "left_anti")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(spark, table(spark, sf_dir, "documents")).drop("text_hash")
