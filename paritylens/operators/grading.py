"""Flags against ground truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def grade(flags: DataFrame, truth: DataFrame, by: list[str]) -> DataFrame:
    """(by..., n_flagged, n_fired, tp, realised_fdr, recall); a ratio without a denominator is null.

    ``flags``: by..., input_id of flagged inputs; ``truth``: by..., input_id, fired.
    """
    f = flags.select(*by, "input_id").distinct().withColumn("f", F.lit(True))
    t = truth.where("fired").select(*by, "input_id").distinct().withColumn("t", F.lit(True))
    both = f.join(t, [*by, "input_id"], "full")
    n = lambda c: F.count_if(c)
    s = both.groupBy(*by).agg(n("f").alias("n_flagged"), n("t").alias("n_fired"), F.count_if(F.col("f") & F.col("t")).alias("tp"))
    return s.withColumn("realised_fdr", F.try_divide((F.col("n_flagged") - F.col("tp")).cast("double"), F.col("n_flagged"))).withColumn("recall", F.try_divide(F.col("tp").cast("double"), F.col("n_fired")))


def realised_fdr(n_flagged: Column, tp: Column) -> Column:
    """The library's form: 0 where nothing is flagged."""
    return F.coalesce(F.try_divide((n_flagged - tp).cast("double"), n_flagged), F.lit(0.0))


def activation_rate(inputs: DataFrame, truth: DataFrame, by: list[str]) -> DataFrame:
    """(by..., n_inputs, n_fired, rate) of the inputs that a fault really touched."""
    hit = truth.where("fired").select(*by, "input_id").distinct().withColumn("t", F.lit(1))
    s = inputs.select(*by, "input_id").distinct().join(hit, [*by, "input_id"], "left").groupBy(*by).agg(F.count(F.lit(1)).alias("n_inputs"), F.count("t").alias("n_fired"))
    return s.withColumn("rate", F.col("n_fired") / F.col("n_inputs"))


def gradable(rates: DataFrame, q: float) -> DataFrame:
    """Adds floor, gradable and the corpus size advised at this rate; the floor is rounded here, not raised."""
    least = round(1 / q)
    return rates.withColumn("floor", F.lit(least)).withColumn("gradable", F.col("n_fired") >= least).withColumn("advised", F.when(F.col("rate") > 0, F.floor(F.lit(float(least)) / F.col("rate"))))


def titration(rows: DataFrame, by: list[str] = ()) -> DataFrame:
    """Adds ``falls`` where recall drops by more than 0.05 from one severity of a fault to the next; no recall counts as 0."""
    r = F.coalesce("recall", F.lit(0.0))
    before = F.lag(r).over(Window.partitionBy(*by, "fault").orderBy("severity"))
    return rows.withColumn("falls", F.coalesce(r < before - 0.05, F.lit(False)))
