"""Several comparisons of one roster at once: every pairing is a key of the same frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: pairing -> (left, repeat of left, right), for the roster of two systems run twice.
DESIGN_R = {
    "primary": ("A", "A_prime", "B"),
    "reverse": ("B", "B_prime", "A"),
    "replicate_b": ("A", "A_prime", "B_prime"),
    "replicate_a": ("A_prime", "A", "B"),
    "stored": ("B", "B_prime", "A_prime"),
}


#: Comparisons of two recordings of one system: the second against the first one's own repeat, against its own, and within the second.
DRIFT = {
    "cross_p1null": ("p1.A", "p1.A_prime", "p2.A"),
    "cross_p2null": ("p2.A", "p2.A_prime", "p1.A"),
    "within_p2": ("p2.A", "p2.A_prime", "p2.B"),
}


def phases(samples: DataFrame, recordings: DataFrame) -> DataFrame:
    """Samples of every recording and its successor as one, arms marked by phase.

    ``recordings``: recording_id, repeats allowed.  The window has one row per
    recording.  A recording takes part twice, but for the first and the last one.
    """
    ids = recordings.select("recording_id").where("recording_id is not null").distinct()
    pairs = ids.withColumn("next", F.lead("recording_id").over(Window.orderBy("recording_id"))).where("next is not null")
    both = F.concat_ws("/", "recording_id", "next").alias("both")
    roles = pairs.select(F.col("recording_id"), both, F.lit("p1.").alias("phase")).unionByName(pairs.select(F.col("next").alias("recording_id"), both, F.lit("p2.").alias("phase")))
    return samples.join(roles, "recording_id").withColumn("arm", F.concat("phase", "arm")).drop("recording_id", "phase").withColumnRenamed("both", "recording_id")


def pairing_map(spark: SparkSession, pairings: dict[str, tuple[str, str, str]]) -> DataFrame:
    rows = [(p, src, dst) for p, arms in pairings.items() for src, dst in zip(arms, ("A", "A_prime", "B"))]
    return spark.createDataFrame(rows, "pairing string, src_arm string, arm string")


def relabel(samples: DataFrame, pairings: dict[str, tuple[str, str, str]]) -> DataFrame:
    """Samples once per pairing they take part in, with the arm they play there; others leave.

    The map has three rows per pairing and is broadcast.
    """
    m = F.broadcast(pairing_map(samples.sparkSession, pairings))
    return samples.withColumnRenamed("arm", "src_arm").join(m, "src_arm").drop("src_arm")


def orientation(found: DataFrame, by: list[str]) -> DataFrame:
    """(by..., input_id, side): found in primary only, reverse only or both; ``found``: by..., pairing, input_id."""
    has = lambda p: F.bool_or(F.col("pairing") == p)
    s = found.where("pairing in ('primary', 'reverse')").groupBy(*by, "input_id").agg(has("primary").alias("p"), has("reverse").alias("r"))
    return s.select(*by, "input_id", F.when(F.col("p") & F.col("r"), "both").when(F.col("p"), "primary_only").otherwise("reverse_only").alias("side"))


def aligned(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    """Inputs that two reports kept, in the first one's order ``pos``."""
    return a.alias("a").join(b.drop("pos").alias("b"), by)


def near_and_far(near: DataFrame, far: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., stratum, target, decoys): decoys of two pairings beside the target of the first."""
    return near.join(far.select(*keys, F.col("decoy").alias("far")), keys).select(*keys, "stratum", "target", F.array("decoy", "far").alias("decoys"))
