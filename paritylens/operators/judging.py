"""Blind queues of cases and the verdicts read back from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paritylens.functions.text import stable_hash


def queue(cases: DataFrame, seed: str, by: list[str] = ()) -> DataFrame:
    """Cases in the order of a hash, the side of each model by another: (by..., place, input_id, X, Y).

    Not the order that a seeded shuffle gives, but as fixed.  A queue is what
    one person reads, so the places of one are counted in one task.
    """
    by = list(by)
    h = stable_hash(F.lit(seed), F.col("input_id"))
    side = F.pmod(stable_hash(F.lit(seed + "/side"), F.col("input_id")), F.lit(2)) == 0
    x = cases.select(*by, "input_id", F.when(side, F.col("left")).otherwise(F.col("right")).alias("X"), F.when(side, F.col("right")).otherwise(F.col("left")).alias("Y"), h.alias("h"))
    return x.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy("h", "input_id"))).drop("h")


def verdicts(lines: DataFrame, by: list[str]) -> DataFrame:
    """(by..., case_no, input_id, verdict) of queue lines (by..., line_no, line).

    ``## Cas n (id: X)`` opens a case; the ``verdict:`` lines up to the next
    belong to it.  égal is written egal; an empty verdict is blank.
    """
    no = F.expr("try_cast(nullif(regexp_extract(line, '^## Cas ([0-9]+)', 1), '') AS INT)")
    case_id = F.nullif(F.regexp_extract("line", r"^## Cas [0-9]+ \(id: ([^)]*)\)", 1), F.lit(""))
    w = Window.partitionBy(*by).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    carried = lines.withColumn("case_no", F.last(no, True).over(w)).withColumn("input_id", F.last(case_id, True).over(w))
    said = F.trim(F.lower(F.regexp_extract("line", r"^verdict:(.*)$", 1)))
    return carried.where(F.col("line").startswith("verdict:") & F.col("case_no").isNotNull()).select(*by, "case_no", "input_id", F.when(said == "", "blank").when(said == "égal", "egal").otherwise(said).alias("verdict"))


def tally(given: DataFrame, by: list[str]) -> DataFrame:
    """(by..., verdict, n)."""
    return given.groupBy(*by, "verdict").agg(F.count(F.lit(1)).alias("n"))


def by_model(given: DataFrame, key: DataFrame) -> DataFrame:
    """(model, n): verdicts X and Y opened by the key; others under their own name.  Refused unless every case has one verdict."""
    if key.count() != given.count():
        raise ValueError("the verdicts don't match the cases")
    j = given.join(key, "input_id")
    model = F.when(F.col("verdict") == "x", F.col("X")).when(F.col("verdict") == "y", F.col("Y")).otherwise(F.col("verdict"))
    return j.groupBy(model.alias("model")).agg(F.count(F.lit(1)).alias("n"))
