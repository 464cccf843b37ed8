"""Running jobs as a stream of protocol lines, with a state for each job that outlives the stream's restarts."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from siltworks.ship import ship_code
from siltworks.streaming.protocol import KINDS

#: A job's last lines that its state keeps.
TAIL = 40
STATE = "n bigint, bad bigint, rounds bigint, at bigint, progress double, round_at bigint, round bigint, score double, done boolean, tail_at array<bigint>, tail array<string>"
JOBS = "job string, n_lines bigint, n_bad bigint, n_rounds bigint, progress double, round bigint, score double, done boolean, tail_at array<bigint>, tail array<string>"


def numbered_lines(lines: DataFrame, line: str = "value") -> DataFrame:
    """``job, at, line`` of lines ``job at text``: whose they are and their number in the job; other lines are left out."""
    parts = F.split(F.col(line), " ", 3)
    out = lines.select(F.get(parts, F.lit(0)).alias("job"), F.get(parts, F.lit(1)).try_cast("bigint").alias("at"), F.get(parts, F.lit(2)).alias("line"))
    return out.where("at IS NOT NULL AND line IS NOT NULL")


def _payload(line: str) -> tuple[str, dict | None]:
    """A line's kind and, for the kinds of the protocol, its JSON object; None where it is none."""
    kind, _, body = line.partition(" ")
    if kind not in KINDS:
        return "TEXT", None
    try:
        found = json.loads(body)
    except ValueError:
        return kind, None
    return kind, found if isinstance(found, dict) else None


def _number(value, kind):
    return kind(value) if isinstance(value, (int, float)) and not isinstance(value, bool) else None


def follow(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Fold new lines of a job into its state and tell it. Lines of a batch may come in any order: the number decides.

    Chunks are read one by one; what is kept is ``TAIL`` lines, the open round and a few numbers, however many lines come.
    """
    n, bad, rounds, at, progress, round_at, round_, score, done, tail_at, tail = state.get if state.exists else (0, 0, 0, None, None, None, None, None, False, [], [])
    last = list(zip(tail_at, tail, strict=True))
    for chunk in chunks:
        for number, line in zip(chunk["at"].tolist(), chunk["line"].tolist(), strict=True):
            kind, data = _payload(line)
            n += 1
            bad += kind != "TEXT" and data is None
            done = done or (kind == "DONE" and data is not None)
            if data is None:
                continue
            if kind == "PROGRESS" and (at is None or number > at):
                at, progress = number, _number(data.get("progress"), float)
            elif kind == "ROUND":
                rounds += 1
                if round_at is None or number > round_at:
                    round_at, round_, score = number, _number(data.get("round"), int), _number(data.get("score"), float)
        last = sorted([*last, *zip(chunk["at"].tolist(), chunk["line"].tolist(), strict=True)])[-TAIL:]
    tail_at, tail = [int(i) for i, _ in last], [line for _, line in last]
    state.update((n, bad, rounds, at, progress, round_at, round_, score, done, tail_at, tail))
    row = (key[0], n, bad, rounds, progress, round_, score, done, tail_at, tail)
    yield pd.DataFrame([row], columns=[field.split()[0] for field in JOBS.split(", ")])


def job_states(lines: DataFrame) -> DataFrame:
    """A row for each job with new lines in a micro-batch: what is known of it so far. ``lines`` is ``job, at, line``."""
    ship_code(lines.sparkSession)
    return lines.groupBy("job").applyInPandasWithState(follow, JOBS, STATE, "update", GroupStateTimeout.NoTimeout)


def run_jobs(spark: SparkSession, source: str, checkpoint: str, out: str, files_per_batch: int = 2) -> int:
    """Read all line files that are new in ``source`` and write each micro-batch's states below ``out``; how many batches ran.

    A batch that is repeated after a failure overwrites its own folder. The state is in ``checkpoint``: a later run goes on
    from there. Both, and ``out``, must be in a folder that the cluster shares.
    """
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(source)

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/part={number}")

    query = job_states(numbered_lines(lines)).writeStream.foreachBatch(write).outputMode("update")
    run = query.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    run.awaitTermination()
    return len({p["batchId"] for p in run.recentProgress if p["numInputRows"]})


def latest_states(spark: SparkSession, out: str) -> DataFrame:
    """The newest state of each job."""
    states = spark.read.parquet(out).drop("part")
    columns = [c for c in states.columns if c not in ("job", "batch")]
    newest = states.groupBy("job").agg(F.max_by(F.struct(*columns), "batch").alias("s"))
    return newest.select("job", "s.*")
