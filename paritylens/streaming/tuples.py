"""An extension: the log as a stream.

The batch operators read a whole log; these follow one that grows.  Samples
arrive as JSON lines, late and more than once; a watermark on the time of
arrival bounds the state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paritylens.schemas import SAMPLE_LINE, TRIO


def follow(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """Samples of a folder of JSON lines as they appear; ill-shaped lines are skipped."""
    raw = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(folder)
    s = raw.select(F.from_json("value", SAMPLE_LINE).alias("s"), F.current_timestamp().alias("arrived"))
    return s.where("s.input_id is not null and s.arm is not null and s.sample_idx is not null").select("s.*", "arrived")


def without_repeats(samples: DataFrame, time: str = "arrived", late: str = "1 hour") -> DataFrame:
    """Each (input, sample, arm) once; a repeat within the watermark is dropped."""
    return samples.withWatermark(time, late).dropDuplicatesWithinWatermark(["input_id", "sample_idx", "arm"])


def complete_tuples(samples: DataFrame, roster: tuple[str, ...] = TRIO, time: str = "arrived", late: str = "1 hour") -> DataFrame:
    """(input_id, sample_idx, n_arms, complete) as they stand; use update mode."""
    seen = samples.withWatermark(time, late).where(F.col("arm").isin(list(roster)))
    n = F.size(F.collect_set("arm"))
    return seen.groupBy("input_id", "sample_idx").agg(n.alias("n_arms"), (n == len(roster)).alias("complete"))


def event_rates(events: DataFrame, time: str, window: str = "1 hour", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Counts and sums of events per window and type."""
    w = F.window(time, window, slide) if slide else F.window(time, window)
    return events.withWatermark(time, late).groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
