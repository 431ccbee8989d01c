"""The job queue and the login limiter as state machines: over a stream, and over a table of events."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from spanloom.operators.folds import fold_rows

# Fixed values.
ATTEMPTS = 3
FAILS, FAIL_WINDOW, BLOCK = 5, 15 * 60 * 1000, 60 * 60 * 1000
JOB = "id string, type string, status string, payload string, progress int, attempts int, error string, created_at timestamp"


def enqueue(jobs: DataFrame, new: DataFrame) -> DataFrame:
    fresh = new.withColumns({"status": F.lit("queued"), "progress": F.lit(0), "attempts": F.lit(0), "error": F.lit(None).cast("string")})
    return jobs.unionByName(fresh.select(jobs.columns))


def recover(jobs: DataFrame) -> DataFrame:
    """After a crash: running jobs are queued again."""
    return jobs.withColumn("status", F.when(F.col("status") == "running", "queued").otherwise(F.col("status")))


def claim(jobs: DataFrame) -> DataFrame:
    """The oldest queued job is running with one attempt more, or in error if it has had them all; no other job changes."""
    oldest = jobs.where("status = 'queued'").agg(F.min(F.struct("created_at", "id")).alias("o")).select("o.id").withColumn("hit", F.lit(True))
    worn = F.col("attempts") >= ATTEMPTS
    hit = F.coalesce("hit", F.lit(False))
    joined = jobs.join(F.broadcast(oldest), "id", "left")  # one row
    return joined.withColumns({
        "status": F.when(hit & worn, "error").when(hit, "running").otherwise(F.col("status")),
        "error": F.when(hit & worn, "too many attempts").otherwise(F.col("error")),
        "attempts": F.when(hit & ~worn, F.col("attempts") + 1).otherwise(F.col("attempts")),
    }).select(jobs.columns)


def finish(jobs: DataFrame, job_id: str, error: str | None = None) -> DataFrame:
    """A thrown error is final; only recovery leads to another attempt."""
    it = F.col("id") == job_id
    done = "done" if error is None else "error"
    return jobs.withColumns({"status": F.when(it, done).otherwise(F.col("status")), "progress": F.when(it & F.lit(error is None), 100).otherwise(F.col("progress")), "error": F.when(it, F.lit(error)).otherwise(F.col("error"))})


def recovered(jobs: DataFrame) -> DataFrame:
    """How many jobs `recover` puts back."""
    return jobs.agg(F.count_if(F.col("status") == "running").alias("recovered"))


def claim_all(jobs: DataFrame) -> DataFrame:
    """The same for every queued job at once: what a cluster works off together."""
    hit, worn = F.col("status") == "queued", F.col("attempts") >= ATTEMPTS
    return jobs.withColumns({
        "status": F.when(hit & worn, "error").when(hit, "running").otherwise(F.col("status")),
        "error": F.when(hit & worn, "too many attempts").otherwise(F.col("error")),
        "attempts": F.when(hit & ~worn, F.col("attempts") + 1).otherwise(F.col("attempts")),
    })


def finish_all(jobs: DataFrame, outcome: DataFrame) -> DataFrame:
    """outcome: id, error (null: done), of running jobs. Those without an outcome stay running, for recovery."""
    told = outcome.groupBy("id").agg(F.max("error").alias("_error"), F.lit(True).alias("_told"))
    hit = F.col("_told").isNotNull() & (F.col("status") == "running")
    done = hit & F.col("_error").isNull()
    return jobs.join(told, "id", "left").withColumns({
        "status": F.when(done, "done").when(hit, "error").otherwise(F.col("status")),
        "progress": F.when(done, 100).otherwise(F.col("progress")),
        "error": F.when(done, None).when(hit, F.col("_error")).otherwise(F.col("error")),
    }).select(jobs.columns)


def run_queue(spark: SparkSession, stream: DataFrame, work: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, once: bool = True):
    """The worker's loop over a stream of new jobs. Jobs live in a table of numbered versions under path: each micro-batch recovers
    what a crash left running, adds the new jobs, claims, works and finishes. `work` gets the running jobs and returns (id, error).
    The claim is written before the work begins, so a crash counts as an attempt; a batch run again adds no job twice."""

    def newest() -> tuple[int, DataFrame | None]:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
        numbers = [int(s.getPath().getName()[1:]) for s in (fs.listStatus(at) if fs.exists(at) else []) if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
        return (max(numbers), spark.read.schema(JOB).parquet(f"{path}/v{max(numbers)}")) if numbers else (0, None)

    def put(jobs: DataFrame) -> DataFrame:
        number = newest()[0] + 1
        jobs.write.mode("overwrite").parquet(f"{path}/v{number}")
        return spark.read.schema(JOB).parquet(f"{path}/v{number}")

    def each(batch: DataFrame, number: int) -> None:
        _, known = newest()
        jobs = batch if known is None else recover(known).unionByName(batch.join(known, "id", "left_anti"))
        jobs = put(claim_all(jobs))
        put(finish_all(jobs, work(jobs.where("status = 'running'"))))

    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="2 seconds")).start()


POLLS, POLL_SECONDS = 180, 1.0  # fixed values


def wait_for(status: Callable[[], str | None], polls: int = POLLS, seconds: float = POLL_SECONDS) -> str | None:
    """Asks for a job's newest status until it has ended; its last status after so many polls."""
    now = None
    for _ in range(polls):
        now = status()
        if now in ("done", "error"):
            break
        time.sleep(seconds)
    return now


def drain(stream: DataFrame, work: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, once: bool = True):
    """Runs `work` on every micro-batch of queued jobs and appends its rows. A batch that was running at a crash is run
    again from the checkpoint, and writes to a folder of its own number, so its rows aren't doubled."""

    def each(batch: DataFrame, number: int) -> None:
        work(batch.where("status = 'queued'")).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="2 seconds")).start()


def latest_by_key(stream: DataFrame, key: str = "key") -> DataFrame:
    """The newest status of each key, for update mode."""
    return stream.groupBy(key).agg(F.max_by("status", F.struct("created_at", "id")).alias("status"))


# ---- login limiter


def step(state: tuple[int, int, int], ts: int, outcome: str) -> tuple[tuple[int, int, int], bool]:
    """state: first failure, failures, blocked until. Returns the state after an attempt, and whether it was let in."""
    first, fails, until = state
    if ts < until:
        return state, False
    if until:
        first, fails, until = 0, 0, 0
    if outcome == "success":
        return (0, 0, 0), True
    if not fails or ts - first > FAIL_WINDOW:
        first, fails = ts, 0
    fails += 1
    return (first, fails, ts + BLOCK if fails >= FAILS else 0), True


LIMIT = "key string, ts long, outcome string, allowed boolean, blocked_until long"


def limited(events: DataFrame) -> DataFrame:
    """events: key, ts (ms), outcome, and seq (of any type that sorts) to order attempts of one time (else those are ordered by
    outcome). Whether each attempt was let in. A key's attempts stream through in order, with only the state kept."""

    def one(state: tuple[int, int, int], r: dict) -> tuple[tuple[int, int, int], tuple]:
        state, allowed = step(state, r["ts"], r["outcome"])
        return state, (r["key"], r["ts"], r["outcome"], allowed, state[2])

    unread = ("seq",) if "seq" in events.columns else ()
    return fold_rows(events.select("key", "ts", "outcome", *unread), "key", ["ts", *(unread or ["outcome"])], (0, 0, 0), one, LIMIT, unread)


def limited_stream(events: DataFrame) -> DataFrame:
    """The same over a stream; a key without attempts for as long as a block lasts is forgotten."""

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        now = state.get if state.exists else (0, 0, 0)
        out = []
        for pdf in batches:
            for ts, outcome in pdf.sort_values(["ts", "seq" if "seq" in pdf else "outcome"], kind="stable")[["ts", "outcome"]].itertuples(index=False):
                now, allowed = step(tuple(now), int(ts), outcome)
                out.append((key[0], ts, outcome, allowed, now[2]))
        state.update(now)
        state.setTimeoutDuration(BLOCK)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in LIMIT.split(", ")])

    return events.groupBy("key").applyInPandasWithState(fold, LIMIT, "first long, fails long, until long", "append", GroupStateTimeout.ProcessingTimeTimeout)
