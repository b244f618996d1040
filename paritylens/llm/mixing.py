"""Problem 7: a corpus whose sources have target shares of its size.

Systematic sampling: within a source, documents stand in the order of a hash;
each expects the same number of copies, the running sum of these is moved by
one random offset, and a document is used once for every integer that the sum
crosses at it.  So a document is used ``floor`` or ``ceil`` of its expected
copies, never more often than its cap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Hex digits of the hash that split a source into ranges, so that no task sorts a whole source.
RANGE_DIGITS = 3


def _uniform(hash_hex: Column) -> Column:
    return F.conv(F.substring(hash_hex, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def mixing_plan(docs: DataFrame, targets: DataFrame, source: str, size: str, total: float | None = None, seed: str = "mix") -> DataFrame:
    """(source, target_share, max_repeats, n_docs, available, expected, offset), one row for each listed source.

    ``total`` is the size to reach; a source that can't give its share under
    its cap then gives what it has.  Without it, the largest size is taken at
    which every listed source that has documents meets its share, the shares
    of the others being spread in proportion.  Documents without a positive
    size, and those of sources that aren't listed, can't be used.  A source
    that is listed twice has the sum of its shares and its least cap.
    """
    have = docs.where(F.col(size) > 0).groupBy(F.col(source).alias("source")).agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.col(size).cast("long")).alias("available"))
    wanted = targets.where(F.col("source").isNotNull()).groupBy("source").agg(F.sum("target_share").alias("target_share"), F.min("max_repeats").cast("long").alias("max_repeats"))
    plan = wanted.join(have, "source", "left").select("source", "target_share", "max_repeats", F.coalesce("n_docs", F.lit(0)).alias("n_docs"), F.coalesce("available", F.lit(0)).alias("available"))
    usable = F.when((F.col("available") > 0) & (F.col("target_share") > 0), F.col("target_share"))
    present = F.sum(usable).over(Window.partitionBy(F.lit(1)))  # one row per listed source
    plan = plan.withColumn("share", usable / present)
    if total is None:
        goal = F.min(F.col("available") * F.col("max_repeats") / F.col("share")).over(Window.partitionBy(F.lit(1)))
    else:
        goal = F.lit(float(total))
    expected = F.least(F.col("share") * goal / F.col("available"), F.col("max_repeats").cast("double"))
    offset = _uniform(F.md5(F.concat_ws("|", F.lit(seed), F.col("source"))))
    return plan.select("source", "target_share", "max_repeats", "n_docs", "available", F.coalesce(expected, F.lit(0.0)).alias("expected"), offset.alias("offset"))


def copies(docs: DataFrame, plan: DataFrame, doc_id: str, source: str, size: str, seed: str = "mix") -> DataFrame:
    """(doc_id, source, size, copies) of the documents that are used at least once."""
    rows = docs.where(F.col(size) > 0).select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.col(size).cast("long").alias("size"))
    rows = rows.join(plan.where("expected > 0").select("source", "expected", "offset"), "source")
    rows = rows.withColumn("h", F.md5(F.concat_ws("|", F.lit(seed), F.col("doc_id").cast("string")))).withColumn("range", F.substring("h", 1, RANGE_DIGITS))
    # A place in the source is the place in the range after all lower ranges:
    # at most 16 ** RANGE_DIGITS rows per source are summed in one place.
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = rows.groupBy("source", "range").count().select("source", "range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("source", "range").orderBy("h", "doc_id", "size"))
    rows = rows.withColumn("within", within).join(ranges, ["source", "range"])
    place = F.col("before") + F.col("within")
    used = F.floor(place * F.col("expected") + F.col("offset")) - F.floor((place - 1) * F.col("expected") + F.col("offset"))
    return rows.select("doc_id", "source", "size", used.cast("long").alias("copies")).where("copies > 0")


def mix_report(docs: DataFrame, targets: DataFrame, doc_id: str, source: str, size: str, total: float | None = None, seed: str = "mix") -> DataFrame:
    """One row per listed source: target, cap, documents, how many are used, repeats, tokens and actual share."""
    plan = mixing_plan(docs, targets, source, size, total, seed)
    used = copies(docs, plan, doc_id, source, size, seed).groupBy("source").agg(
        F.count(F.lit(1)).alias("docs_used"), F.sum("copies").alias("repeats"), F.max("copies").alias("most_repeats"), F.sum(F.col("copies") * F.col("size")).alias("tokens")
    )
    out = plan.join(used, "source", "left").select(
        "source", "target_share", "max_repeats", "n_docs", "available", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("docs_used", "repeats", "most_repeats", "tokens"))
    )
    every = F.sum("tokens").over(Window.partitionBy(F.lit(1)))
    return out.withColumn("share", F.round(F.coalesce(F.col("tokens") / F.nullif(every, F.lit(0)), F.lit(0.0)), 9))
