"""Inputs that differ only in case, accents, layout or punctuation at the ends."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paritylens.functions.text import dedup_key


def groups(inputs: DataFrame) -> DataFrame:
    """(pos, input_id, key, kept_id, n): every input with the one that stands for it, the first by pos.

    Null texts form one group.  Group facts come from partial sums, so a hot
    group costs one row per task.
    """
    keyed = inputs.select("pos", "input_id", F.coalesce(dedup_key(F.col("text")), F.lit("")).alias("key"))
    first = keyed.groupBy("key").agg(F.min_by("input_id", "pos").alias("kept_id"), F.count(F.lit(1)).alias("n"))
    return keyed.join(first, "key")


def duplication_rate(grouped: DataFrame) -> DataFrame:
    s = grouped.agg(F.count(F.lit(1)).alias("n_inputs"), F.countDistinct("key").alias("n_kept"))
    return s.withColumn("rate", F.coalesce(F.try_divide((F.col("n_inputs") - F.col("n_kept")).cast("double"), F.col("n_inputs")), F.lit(0.0)))


def ordered_ids(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by..., input_id, place): distinct ids in the order they are first seen."""
    first = rows.groupBy(*by, "input_id").agg(F.min("line_no").alias("pos"))
    return first.select(*by, "input_id", (F.row_number().over(Window.partitionBy(*by).orderBy("pos")) - 1).alias("place"))
