"""Operator 4: rule statistics of whole texts and robust multivariate outliers. DataFrame functions only.

Each text gets counts of words, symbols, repeated lines and repeated five-word windows. Logarithms of
their rates make a vector. For each language and source a minimum-covariance-determinant estimate
is made of the texts that pass the base rules. From three starts (medians with quartile ranges alone, with
correlations of hyperbolic tangents, and with those of spatial signs) concentration steps take the three
quarters of the group that are nearest by Mahalanobis distance and estimate mean and covariance
again; after TRIALS steps the start with the least determinant goes on until it stops falling. A text is rejected if
its squared distance is above CUTOFF.

Groups of any size are estimated alike: an estimate counts PRIOR rows more, which are spread as the whole
table's own estimate says. So a group of a few texts is judged much as the table is, and from some hundreds on
by itself, without a size at which the rule changes.

Scale: the statistics are made within a row, in linearithmic time, and written once without the
texts. A step aggregates moments by group and distance bin, combined before the shuffle, so a group
that holds a third of all rows costs as many rows as bins (BINS at most); the nearest three quarters
are whole bins of it. Results don't depend on the order of rows but for rounding in sums.

Variances have a floor (FLOOR squared, in log units), since over three quarters of a group often have
no symbol or repeat at all and their scatter would be zero.

Defined cases: null text has no words; null language or source is a group of its own; repeated rows
count and are returned each; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.llm.common import Stash, table, words

WINDOW = 5
SHARE = 0.75
BINS = 1024
PRIOR, TRIALS = 20, 2
BROADCAST_GROUPS = 20_000
#: The vector and the floor of each coordinate's standard deviation.
COORDINATES = ("v_words", "v_word_length", "v_symbols", "v_lines", "v_repeats")
FLOOR = (0.5, 0.1, 0.4, 0.5, 0.5)
REJECTED_SHARE = 1e-9


def statistics(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns in keep, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of every row."""
    text = F.coalesce("text", F.lit(""))
    said = docs.select("doc_id", *keep, text.alias("_t"), words(F.col("text")).alias("_w"))
    has_word = lambda x: x.rlike(r"[^\x20\x09-\x0D]")
    windows = F.transform(F.sequence(F.lit(0), F.size("_w") - WINDOW), lambda i: F.xxhash64(*(F.get(F.col("_w"), i + k) for k in range(WINDOW))))
    counted = said.select(
        "doc_id", *keep,
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        (F.length("_t") - F.length(F.regexp_replace("_t", r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        F.filter(F.split("_t", "\n"), has_word).alias("_lines"),
        F.when(F.size("_w") >= WINDOW, windows).otherwise(F.array().cast("array<bigint>")).alias("_h"),
    )
    # only texts in which a window comes back need their places
    placed = F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    doubled = counted.withColumns({
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "_s": F.when(F.size(F.array_distinct("_h")) < F.size("_h"), placed),
    })
    same = lambda s, i: F.coalesce(s["h"] == F.get(F.col("_s"), i - 1)["h"], F.lit(False)) | F.coalesce(s["h"] == F.get(F.col("_s"), i + 1)["h"], F.lit(False))
    at = F.sort_array(F.transform(F.filter("_s", same), lambda s: s["i"]))
    start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("n"))
    covered = F.aggregate(at, start, lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n")), lambda a: a["n"])
    return doubled.select("doc_id", *keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", F.coalesce(covered, F.lit(0)).alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def vector() -> dict[str, Column]:
    per = lambda c, n: F.log1p(100 * F.col(c) / F.greatest(F.col(n), F.lit(1)))
    return dict(zip(COORDINATES, (F.log1p("n_words"), F.log1p(F.col("word_chars") / F.greatest("n_words", F.lit(1))), per("n_symbols", "n_words"), F.log1p("n_dup_lines"), per("n_repeat_words", "n_words"))))


# ---- chi-square


def chi2_share(x: float, df: int) -> float:
    """Share of a chi-square distribution below x, by the series of the incomplete gamma function."""
    a, z = df / 2, x / 2
    if z <= 0:
        return 0.0
    term = total = 1 / a
    n = a
    while term > total * 1e-16:
        n += 1
        term *= z / n
        total += term
    return min(1.0, total * math.exp(-z + a * math.log(z) - math.lgamma(a)))


def chi2_quantile(share: float, df: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_share(mid, df) < share else (low, mid)
    return high


P = len(COORDINATES)
CUTOFF = chi2_quantile(1 - REJECTED_SHARE, P)
#: Makes the covariance of the nearest SHARE that of the whole, were it normal.
CONSISTENT = SHARE / chi2_share(chi2_quantile(SHARE, P), P + 2)


# ---- estimates


def attach(rows: DataFrame, small: DataFrame, key: str, few: bool) -> DataFrame:
    """Joins a few rows for each group; broadcast only if the groups have been counted to be few."""
    return rows.join(F.broadcast(small) if few else small, key)


def cholesky(df: DataFrame) -> DataFrame:
    """Adds the factor l0_0, l1_0, ... of the covariance in c0_0, c1_0, ..., row by row."""
    for i in range(P):
        for j in range(i + 1):
            rest = F.col(f"c{i}_{j}")
            for k in range(j):
                rest = rest - F.col(f"l{i}_{k}") * F.col(f"l{j}_{k}")
            df = df.withColumn(f"l{i}_{j}", F.sqrt(F.greatest(rest, F.lit(1e-12))) if i == j else rest / F.col(f"l{j}_{j}"))
    return df


def lower() -> list[tuple[int, int]]:
    return [(i, j) for i in range(P) for j in range(i + 1)]


def starts(stash: Stash, fit: DataFrame, few: bool) -> DataFrame:
    """Three rows for each pool: medians as mean, and shapes made of quartile ranges and, but for the first, correlations of
    bounded scores. Medians and quartiles come from counts of values in steps of 1/64."""
    long = fit.select("pool", F.posexplode(F.array(*(F.floor(F.col(c) * 64) for c in COORDINATES))).alias("i", "b"))
    bins = long.groupBy("pool", "i", "b").agg(F.count("*").alias("n"))
    order = Window.partitionBy("pool", "i").orderBy("b")
    share = bins.select("pool", "i", "b", (F.sum("n").over(order) / F.sum("n").over(Window.partitionBy("pool", "i"))).alias("upto"))
    at = lambda q: F.min(F.when(F.col("upto") >= q, (F.col("b") + 0.5) / 64))
    spots = share.groupBy("pool", "i").agg(at(0.5).alias("median"), (at(0.75) - at(0.25)).alias("range"))
    wide = stash.put(spots.groupBy("pool").agg(
        *(F.max(F.when(F.col("i") == i, F.col("median"))).alias(f"m{i}") for i in range(P)),
        *(F.max(F.when(F.col("i") == i, F.sqrt((F.col("range") / 1.349) ** 2 + FLOOR[i] ** 2))).alias(f"s{i}") for i in range(P)),
    ))
    z = [(F.col(c) - F.col(f"m{i}")) / F.col(f"s{i}") for i, c in enumerate(COORDINATES)]
    length = F.sqrt(sum((x**2 for x in z[1:]), z[0] ** 2) + 1e-12)
    scores = {1: [F.tanh(x) for x in z], 2: [x / length for x in z]}
    sums = attach(fit, wide, "pool", few).groupBy("pool").agg(F.count("*").alias("n"), *(F.sum(f[i] * f[j]).alias(f"q{k}_{i}_{j}") for k, f in scores.items() for i, j in lower()))
    both = stash.put(wide.join(sums, "pool"))
    # PRIOR rows without correlation keep every shape proper
    root = lambda k, i: F.sqrt(F.col(f"q{k}_{i}_{i}") + 1e-9)
    cor = lambda k, i, j: F.lit(1.0) if i == j else F.lit(0.0) if k == 0 else F.col("n") / (F.col("n") + PRIOR) * F.col(f"q{k}_{i}_{j}") / root(k, i) / root(k, j)
    means = [f"m{i}" for i in range(P)]
    out = [cholesky(both.select("pool", F.lit(k).alias("start"), *means, *((cor(k, i, j) * F.col(f"s{i}") * F.col(f"s{j}")).alias(f"c{i}_{j}") for i, j in lower()))) for k in range(3)]
    rows = out[0].unionByName(out[1]).unionByName(out[2])
    return stash.put(rows.select("pool", "start", *means, *(f"l{i}_{j}" for i, j in lower()), F.lit(math.inf).alias("log_det")))


def distance(df: DataFrame) -> DataFrame:
    """Adds y0, y1, ... with the sum of squares d2: the deviations from the mean, solved against the Cholesky factor."""
    for i in range(P):
        rest = F.col(COORDINATES[i]) - F.col(f"m{i}")
        for j in range(i):
            rest = rest - F.col(f"l{i}_{j}") * F.col(f"y{j}")
        df = df.withColumn(f"y{i}", rest / F.col(f"l{i}_{i}"))
    return df.withColumn("d2", sum((F.col(f"y{i}") ** 2 for i in range(1, P)), F.col("y0") ** 2))


def concentrate(stash: Stash, fit: DataFrame, now: DataFrame, few: bool, prior: DataFrame | None) -> DataFrame:
    """One concentration step: means and Cholesky factors of the nearest SHARE of each pool, from each of its starts."""
    far = distance(attach(fit, now, "pool", few))
    dev = [F.col(COORDINATES[i]) - F.col(f"m{i}") for i in range(P)]
    sums = {f"s{i}": F.sum(dev[i]) for i in range(P)} | {f"q{i}_{j}": F.sum(dev[i] * dev[j]) for i, j in lower()}
    binned = far.withColumn("bin", F.least(F.floor(32 * F.log2(1 + F.col("d2"))), F.lit(BINS - 1)))
    bins = binned.groupBy("pool", "start", "bin").agg(F.count("*").alias("n"), *(c.alias(k) for k, c in sums.items()))
    group = Window.partitionBy("pool", "start")
    taken = bins.withColumns({"nearer": F.sum("n").over(group.orderBy("bin")) - F.col("n"), "whole": F.sum("n").over(group)}).where(F.col("nearer") < SHARE * F.col("whole"))
    total = taken.groupBy("pool", "start").agg(F.sum("n").alias("n"), *(F.sum(k).alias(k) for k in sums))
    df = total.join(now.select("pool", "start", *(f"m{i}" for i in range(P))), ["pool", "start"])
    mean = {i: F.col(f"m{i}") + F.col(f"s{i}") / F.col("n") for i in range(P)}
    cov = {(i, j): CONSISTENT * (F.col(f"q{i}_{j}") / F.col("n") - F.col(f"s{i}") * F.col(f"s{j}") / F.col("n") ** 2) for i, j in lower()}
    if prior is not None:
        df, own = df.crossJoin(F.broadcast(prior)), F.col("n") / (F.col("n") + PRIOR)  # one row
        cov = {(i, j): own * c + (1 - own) * F.col(f"t{i}_{j}") + own * (1 - own) * (mean[i] - F.col(f"u{i}")) * (mean[j] - F.col(f"u{j}")) for (i, j), c in cov.items()}
        mean = {i: own * m + (1 - own) * F.col(f"u{i}") for i, m in mean.items()}
    floor = lambda i, j: FLOOR[i] ** 2 if i == j else 0.0
    df = df.select("pool", "start", *(m.alias(f"m{i}") for i, m in mean.items()), *((c + floor(i, j)).alias(f"c{i}_{j}") for (i, j), c in cov.items()))
    log_det = sum((F.log(f"l{i}_{i}") for i in range(1, P)), F.log("l0_0")) * 2
    return stash.put(cholesky(df).select("pool", "start", *(f"m{i}" for i in range(P)), *(f"l{i}_{j}" for i, j in lower()), log_det.alias("log_det")))


def estimate(spark: SparkSession, fit: DataFrame, prior: DataFrame | None = None) -> DataFrame:
    """One row for each pool: mean m0.., Cholesky factor l0_0.., and log_det of the estimate. prior: one row of mean u0.. and
    covariance t0_0.., without floors."""
    stash = Stash(spark, "mcd")
    few = fit.select("pool").distinct().count() <= BROADCAST_GROUPS
    now = starts(stash, fit, few)
    for _ in range(TRIALS):
        now = concentrate(stash, fit, now, few, prior)
        stash.drop_older()
    now = stash.put(now.groupBy("pool").agg(F.min_by(F.struct(*now.columns[1:]), F.struct("log_det", "start")).alias("b")).select("pool", "b.*"))
    state = math.inf
    while True:  # the floors bound the determinants from below, and each round but the last lowers them
        before, state = state, now.agg(F.sum("log_det")).first()[0] or 0.0
        if before - state < 1e-6 * max(1.0, abs(state)):
            return now
        now = concentrate(stash, fit, now, few, prior)
        stash.drop_older()


def judge(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The rule counts of every row, base_failed, kept, and distance2 (null only where no text of the group passes the base rules)."""
    cell = F.to_json(F.struct("lang", "source"))  # nulls are left out of it, so they equal no text
    rows = statistics(docs, ("lang", "source")).withColumns({"pool": cell, "base_failed": base_failed()}).withColumns(vector())
    rows = Stash(spark, "rules").put(rows)
    fit = rows.where("not base_failed").select("pool", *COORDINATES)
    whole = estimate(spark, fit.withColumn("pool", F.lit("all")))
    square = lambda i, j: sum((F.col(f"l{i}_{k}") * F.col(f"l{j}_{k}") for k in range(1, j + 1)), F.col(f"l{i}_0") * F.col(f"l{j}_0"))
    prior = whole.select(*(F.col(f"m{i}").alias(f"u{i}") for i in range(P)), *((square(i, j) - (FLOOR[i] ** 2 if i == j else 0.0)).alias(f"t{i}_{j}") for i, j in lower()))
    estimates = estimate(spark, fit, prior)
    known = F.broadcast(estimates) if estimates.count() <= BROADCAST_GROUPS else estimates
    judged = distance(rows.join(known, "pool", "left"))
    kept = ~F.col("base_failed") & (F.coalesce("d2", F.lit(0.0)) <= CUTOFF)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), F.col("d2").alias("distance2"))


def op4_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark, table(spark, sf_dir, "documents"))
