"""How well a score tells texts that mean the same from texts that don't."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Bounds of a share; null where n is 0."""
    p, zz = k / F.nullif(n, F.lit(0)), z * z
    mid = (p + zz / (2 * n)) / (1 + zz / n)
    half = z * F.sqrt(p * (1 - p) / n + zz / (4 * n * n)) / (1 + zz / n)
    return F.when(n > 0, F.greatest(F.lit(0.0), mid - half)), F.when(n > 0, F.least(F.lit(1.0), mid + half))


def auc(scores: DataFrame, by: list[str], positive: str = "positive", score: str = "score") -> DataFrame:
    """(by..., n_pos, n_neg, auc) by mid-ranks; null if a side is empty.

    Counts are collapsed to distinct scores, so ranks need one row per score.
    """
    c = scores.groupBy(*by, F.col(score).alias("s")).agg(F.count_if(F.col(positive)).alias("p"), F.count_if(~F.col(positive)).alias("n"))
    below = F.coalesce(F.sum("n").over(Window.partitionBy(*by).orderBy("s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    won = c.withColumn("won", F.col("p") * (below * 2 + F.col("n")))
    s = won.groupBy(*by).agg(F.sum("p").alias("n_pos"), F.sum("n").alias("n_neg"), F.sum("won").alias("w"))
    return s.select(*by, "n_pos", "n_neg", F.try_divide(F.col("w").cast("double"), 2.0 * F.col("n_pos") * F.col("n_neg")).alias("auc"))


def thresholds(scores: DataFrame, fpr: float, per_shape: bool) -> DataFrame:
    """(level, threshold): the score that a share ``fpr`` of preserving pairs exceeds."""
    level = F.col("shape") if per_shape else F.lit("__global__")
    return scores.where("relation = 'PRESERVING'").groupBy(level.alias("level")).agg(F.percentile("score", F.lit(1 - fpr)).alias("threshold"))


def evaluate(scores: DataFrame, fpr: float = 0.05, per_shape: bool = False) -> DataFrame:
    """One row per level and category: n, detected (score > threshold), rate with Wilson bounds, AUC and median.

    Breaking categories keep their name, register ones are marked [reg] and
    preserving ones [fp]; the last have no AUC.
    """
    level = F.col("shape") if per_shape else F.lit("__global__")
    x = scores.withColumn("level", level).join(thresholds(scores, fpr, per_shape), "level")
    name = F.when(F.col("relation") == "BREAKING", F.col("category")).when(F.col("relation") == "REGISTER", F.concat(F.lit("[reg] "), "category")).otherwise(F.concat(F.lit("[fp] "), "category"))
    x = x.withColumn("name", name)
    agg = x.groupBy("level", "name").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("score") > F.col("threshold")).alias("detected"), F.median("score").alias("median_score"), F.first("threshold").alias("threshold"))
    # Each category against all preserving pairs of its level: counts by score meet in one window.
    c = x.groupBy("level", "name", "relation", "score").agg(F.count(F.lit(1)).alias("k"))
    pres = F.sum(F.when(F.col("relation") == "PRESERVING", F.col("k")).otherwise(0))
    upto = pres.over(Window.partitionBy("level").orderBy("score").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    here = pres.over(Window.partitionBy("level", "score"))
    ranked = c.select("*", upto.alias("upto"), here.alias("here"), pres.over(Window.partitionBy("level")).alias("np")).where("relation <> 'PRESERVING'")
    a = ranked.groupBy("level", "name").agg(F.try_divide(F.sum(F.col("k") * (2 * F.col("upto") - F.col("here"))).cast("double"), 2.0 * F.sum("k") * F.first("np")).alias("auc"))
    lo, hi = wilson(F.col("detected"), F.col("n"))
    out = agg.join(a, ["level", "name"], "left")
    return out.select("level", F.col("name").alias("category"), "n", "detected", (F.col("detected") / F.col("n")).alias("rate"), lo.alias("lo"), hi.alias("hi"), "auc", "median_score", "threshold")


def separability(scores: DataFrame) -> DataFrame:
    """AUC of breaking against preserving pairs; register pairs play no part."""
    return auc(scores.where("relation <> 'REGISTER'").withColumn("positive", F.col("relation") == "BREAKING"), [])


def balanced_accuracy(scores: DataFrame) -> DataFrame:
    """(threshold, tpr, fpr, balanced) for thresholds 0.05 to 0.95, both directions having to reach it."""
    grid = F.explode(F.transform(F.sequence(F.lit(1), F.lit(19)), lambda i: i)).alias("i")
    least = F.least("forward", "backward")
    hit = least >= F.col("i") / F.lit(20.0)
    # Nineteen rows per pair, summed before they are shuffled.
    c = scores.select("same", "forward", "backward", grid).groupBy("i").agg(F.count_if(F.col("same") & hit).alias("tp"), F.count_if(F.col("same")).alias("p"), F.count_if(~F.col("same") & hit).alias("fp"), F.count_if(~F.col("same")).alias("n"))
    tpr, fpr = F.try_divide(F.col("tp").cast("double"), F.col("p")), F.try_divide(F.col("fp").cast("double"), F.col("n"))
    return c.select((F.col("i") / F.lit(20.0)).alias("threshold"), tpr.alias("tpr"), fpr.alias("fpr"), ((tpr + 1 - fpr) / 2).alias("balanced"))


def best_threshold(grid: DataFrame) -> DataFrame:
    """The threshold of greatest balanced accuracy; of equal ones the least."""
    return grid.agg(F.max_by(F.struct("threshold", "balanced"), F.struct("balanced", -F.col("threshold"))).alias("b")).select("b.*")


def detection_rates(scores: DataFrame, two_tailed: list[str] = (), fpr: float = 0.05) -> DataFrame:
    """(channel, category, n, rate) of every category of every channel.

    One tail holds the share ``fpr`` of preserving pairs, or two tails half of
    it each; verbosity counts as hedging of the register.
    """
    x = scores.withColumn("category", F.when(F.col("category") == "verbosity", "hedging").otherwise(F.col("category"))).withColumn("relation", F.when(F.col("category") == "hedging", "REGISTER").otherwise(F.col("relation")))
    both = F.col("channel").isin(list(two_tailed)) if two_tailed else F.lit(False)
    t = x.where("relation = 'PRESERVING'").groupBy("channel").agg(F.percentile("score", F.lit(1 - fpr)).alias("one"), F.percentile("score", F.lit(1 - fpr / 2)).alias("hi"), F.percentile("score", F.lit(fpr / 2)).alias("lo"))
    hit = F.when(both, (F.col("score") > F.col("hi")) | (F.col("score") < F.col("lo"))).otherwise(F.col("score") > F.col("one"))
    return x.join(t, "channel").groupBy("channel", "category").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(hit.cast("double")), 9).alias("rate"))


def blind_spots(scores: DataFrame, columns: list[str], two_tailed: list[str] = (), fpr: float = 0.05) -> DataFrame:
    """``detection_rates`` with the categories of ``columns`` as columns; a channel without a category has null there."""
    return detection_rates(scores, two_tailed, fpr).groupBy("channel").pivot("category", columns).agg(F.first("rate"))


def describe(df: DataFrame, by: list[str], value: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count(value).alias("n"), F.min(value).alias("min"), F.median(value).alias("median"), F.max(value).alias("max"))


def upper_median(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """The value at place n div 2, counted from 0; no mean of two."""
    c = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("k"))
    upto = F.sum("k").over(Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    n = F.sum("k").over(Window.partitionBy(*by))
    return c.select(*by, value, upto.alias("upto"), n.alias("n")).where(F.col("upto") > F.floor(F.col("n") / 2)).groupBy(*by).agg(F.min(value).alias("upper_median"))
