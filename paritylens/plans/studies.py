"""Compositions of a study: faults of rising severity, graded matrices, diagnoses and the queue of a campaign."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paritylens.functions import text as X
from paritylens.operators import fdr, faults, grading, judging, log
from paritylens.plans import detect as plan
from paritylens.session import cut_lineage


def titrate(samples: DataFrame, cells: list[tuple[str, float]], q: float = 0.10, share: float = 1.0, seed: int = 0) -> DataFrame:
    """(recording_id, fault, severity, n_flagged, n_fired, tp, realised_fdr, recall, falls) of every fault and severity.

    Each cell injects its fault into the candidate's answers and is detected
    and graded against the inputs it changed.  All cells are keys of one plan:
    baselines are brought to modes once and shared.
    """
    moded = cut_lineage(plan.with_modes(samples).select("recording_id", "input_id", "arm", "sample_idx", "ord", "line_no", "output", "finish_reason", "error", "mode", "shape"))
    cell = F.explode(F.array(*(F.struct(F.lit(n).alias("fault"), F.lit(float(s)).alias("severity")) for n, s in cells)))
    keep = ["recording_id", "fault", "severity", "input_id", "arm", "ord", "line_no", "mode", "shape", "activated"]
    both = moded.where("arm in ('A', 'A_prime')").withColumn("cell", cell).select("*", "cell.*").withColumn("activated", F.lit(False)).select(*keep)
    candidate = moded.where("arm = 'B'")
    for name, severity in cells:
        hit = faults.inject(candidate, name, severity, "B2", share, seed).withColumns({"fault": F.lit(name), "severity": F.lit(float(severity)), "mode": X.normalise(F.col("output")), "shape": X.shape(F.col("output"))})
        both = both.unionByName(hit.select(*keep))
    both = cut_lineage(both)
    by = ["recording_id", "fault", "severity"]
    flagged = plan.judged(plan.scores(both, by), by, q)[0].where("flagged")
    truth = both.groupBy(*by, "input_id").agg(F.bool_or("activated").alias("fired"))
    graded = grading.grade(flagged, truth, by)
    every = truth.select(*by).distinct().join(graded, by, "left").fillna(0, ["n_flagged", "n_fired", "tp"])
    return grading.titration(every, ["recording_id"])


def graded_matrix(samples: DataFrame, labels: DataFrame, provenance: dict[str, str], q: float = 0.10) -> DataFrame:
    """One row per recording and channel: sizes, flags, grades against the labels, and where the row comes from."""
    by = ["recording_id", "channel"]
    flagged = plan.detect(samples, ["recording_id"], q)[0]
    j = flagged.join(log.touched(labels), ["recording_id", "input_id"], "left").withColumn("fired", F.coalesce("fired", F.lit(False)))
    m = j.groupBy(*by).agg(F.count(F.lit(1)).alias("n_inputs"), F.count_if("flagged").alias("n_flagged"), F.count_if("fired").alias("n_fired"), F.count_if(F.col("flagged") & F.col("fired")).alias("tp"))
    m = m.withColumn("realised_fdr", F.try_divide((F.col("n_flagged") - F.col("tp")).cast("double"), F.col("n_flagged"))).withColumn("recall", F.try_divide(F.col("tp").cast("double"), F.col("n_fired")))
    return m.withColumns({k: F.lit(v) for k, v in provenance.items()})


def diagnosis_rows(samples: DataFrame, labels: DataFrame) -> DataFrame:
    """(recording_id, channel, input_id, fired, target, decoy): what the arrays of a diagnosis hold, one row for each entry."""
    scored = plan.scores(plan.with_modes(samples), ["recording_id"])
    return scored.join(log.touched(labels), ["recording_id", "input_id"], "left").select("recording_id", "channel", "input_id", F.coalesce("fired", F.lit(False)).alias("fired"), "target", "decoy")


def campaign_queue(samples: DataFrame, seed: str, q: float = 0.10) -> DataFrame:
    """(recording_id, place, input_id, X, Y): the inputs that any pairing flags, in blind order for a judge."""
    found = plan.design_r(samples, q).select("recording_id", "input_id").distinct()
    return judging.queue(found.select("recording_id", "input_id", F.lit("A").alias("left"), F.lit("B").alias("right")), seed, ["recording_id"])


def campaign_result(queue: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(recording_id, model, n): verdicts x and y opened by the queue, others under their own name."""
    j = queue.join(verdicts, ["recording_id", "input_id"])
    model = F.when(F.col("verdict") == "x", F.col("X")).when(F.col("verdict") == "y", F.col("Y")).otherwise(F.col("verdict"))
    return j.groupBy("recording_id", model.alias("model")).agg(F.count(F.lit(1)).alias("n"))


def closest_checks(samples: DataFrame, q: float = 0.10) -> DataFrame:
    """The check of each recording that came closest to a finding."""
    return fdr.closest(plan.detect(samples, ["recording_id"], q)[2], ["recording_id"], plan.PARTITION_CHANNELS)
