"""Recording of systems: what is still to be asked, asked in tuples and appended to a log that can be resumed."""

from __future__ import annotations

import os
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paritylens.operators import log
from paritylens.schemas import roster_order
from paritylens.sources.files import read_samples

#: (text, input_id, sample_idx) -> output; an exception is a failed call.
System = Callable[[str, str, int], str]


class PreflightFailed(RuntimeError):
    """An arm does not answer; nothing was written."""


class RecordingFailed(RuntimeError):
    """Every arm failed in tuple after tuple."""


class RunPaused(RuntimeError):
    """The run was stopped between slices; it goes on from its log."""

    def __init__(self, done: int, left: int):
        super().__init__(f"{done} tuples recorded, {left} left")
        self.done, self.left = done, left


def preflight(systems: dict[str, System], text: str, input_id: str) -> None:
    """Ask every arm once, before anything is written."""
    silent = []
    for arm, system in systems.items():
        try:
            system(text, input_id, 0)
        except Exception as why:  # noqa: BLE001 - whatever a system raises
            silent.append(f"{arm}: {type(why).__name__}: {why}")
    if silent:
        raise PreflightFailed("; ".join(silent))


def _ask(systems: dict[str, System], roster: list[str], session: int, most_dead: int) -> Callable:
    schema = "input_id string, arm string, sample_idx int, `order` long, output string, latency_ms double, ts double, model_id string, finish_reason string, error string, session int"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        dead = 0
        for batch in batches:
            rows = []
            for t in batch.itertuples(index=False):
                lead = t.sample_idx % len(roster)
                failed = 0
                for i, arm in enumerate(roster[lead:] + roster[:lead]):
                    begun, out, error = time.perf_counter(), "", None
                    try:
                        out = systems[arm](t.text, t.input_id, t.sample_idx)
                    except Exception as why:  # noqa: BLE001
                        error = f"{type(why).__name__}: {why}"
                        failed += 1
                    rows.append((t.input_id, arm, t.sample_idx, t.place * len(roster) + i, out, (time.perf_counter() - begun) * 1e3, time.time(), None, None, error, session))
                dead = dead + 1 if failed == len(roster) else 0
                if most_dead and dead >= most_dead:
                    raise RecordingFailed(f"{dead} tuples in a row without an answer, the last: {error}")
            yield pd.DataFrame(rows, columns=[c.split()[0].strip("`") for c in schema.split(", ")])

    return run, schema


def record(
    spark: SparkSession, inputs: DataFrame, systems: dict[str, System], k: int, folder: str, recording_id: str, slice_tuples: int = 10_000, should_stop: Callable[[], bool] | None = None, abort_after_dead: int = 3, check_arms: bool = True
) -> DataFrame:
    """Samples of k answers of every arm to every input, appended to ``folder``/``recording_id``.d; only what is left is asked.

    ``inputs``: input_id, text.  All arms of a tuple are asked in one place,
    the leading arm rotating; a task's lines appear when it ends or not at
    all, so no tuple is ever in part on disk.  ``should_stop`` is asked
    between slices of the plan.
    """
    missing = {"A", "A_prime"} - set(systems)
    if missing:
        raise ValueError(f"missing arms {sorted(missing)}")
    roster = roster_order(set(systems))
    if check_arms:
        first = inputs.orderBy("input_id").first()
        if first is None:
            raise ValueError("no inputs to record")
        preflight(systems, first["text"], first["input_id"])
    tried = 0
    while True:
        seen = _known(spark, folder, recording_id)
        session, top = (0, -1)
        plan = inputs.select(F.lit(recording_id).alias("recording_id"), "input_id", "text").dropDuplicates(["input_id"]).withColumn("sample_idx", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
        if seen is not None:
            last = seen.agg(F.max("session_no").alias("s"), F.max("ord").alias("o")).first()
            session, top = (last["s"] if tried else last["s"] + 1), last["o"]
            done = log.tuples(seen, tuple(roster)).where("complete and not dead").select("input_id", "sample_idx")
            plan = plan.join(done, ["input_id", "sample_idx"], "left_anti")
        left = plan.count()
        if not left:
            return seen
        if should_stop is not None and should_stop():
            raise RunPaused(tried, left)
        # One slice is as small as it was asked to be, so one task may number it.
        base = (top + len(roster)) // len(roster)
        place = F.row_number().over(Window.orderBy("input_id", "sample_idx")) - 1 + base
        part = plan.orderBy("input_id", "sample_idx").limit(slice_tuples).withColumn("place", place.cast("long"))
        asked = part.repartition(spark.sparkContext.defaultParallelism, "input_id").sortWithinPartitions("place")
        run, schema = _ask(systems, roster, session, abort_after_dead)
        lines = asked.select("input_id", "text", "sample_idx", "place").mapInPandas(run, schema)
        try:
            lines.write.option("ignoreNullFields", "false").mode("append").json(f"{folder}/{recording_id}.d/{session}-{tried}")
        except Exception as why:
            if "RecordingFailed" in str(why):
                raise RecordingFailed(f"every arm fails; {tried} tuples stand in the log") from why
            raise
        tried += min(left, slice_tuples)


def _known(spark: SparkSession, folder: str, recording_id: str) -> DataFrame | None:
    """Samples recorded so far; None before the first."""
    root = f"{folder}/{recording_id}.d"
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    return read_samples(spark, os.path.join(root, "*"), recording_id)
