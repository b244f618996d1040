"""Thresholds with a calibrated share of false discoveries.

Scores are compared as keys, whole numbers of 1e-9.  Counts above a cut are
running sums over distinct keys, so a stratum needs as many rows as it has
distinct scores.  Decoys are pooled within a stratum, never paired.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SCALE = 1e9
MIN_STRATUM = 30
POOLED = "__pooled__"


def key(score: Column) -> Column:
    return F.rint(score * F.lit(SCALE)).cast("long")


def floor_of(q: float, r: int = 1) -> int:
    """The fewest discoveries that can be reported at q."""
    return math.ceil(1 / (q * r) - 1e-9)


def effective_strata(scores: DataFrame, by: list[str], least: int = MIN_STRATUM) -> DataFrame:
    """Adds eff_stratum: strata below ``least`` inputs are pooled."""
    n = scores.groupBy(*by, "stratum").agg(F.count(F.lit(1)).alias("__n"))
    return scores.join(n, [*by, "stratum"]).withColumn("eff_stratum", F.when(F.col("__n") < least, F.lit(POOLED)).otherwise(F.col("stratum"))).drop("__n")


def _unfolded(fold: list[str]) -> tuple[Column, Column]:
    two = F.col("channel").isin(fold) if fold else F.lit(False)
    side = lambda c: key(F.when(two, F.abs(F.col(c))).otherwise(F.col(c)))
    return side("target"), side("decoy")


def cuts(scores: DataFrame, by: list[str], fold: list[str] = ("nli_directional",), divisor: int = 1) -> DataFrame:
    """(by..., score_key, nt, nd, at_target, est): counts at or above every distinct key.

    ``scores`` has target and decoy, or decoys ARRAY; ``est`` is
    (1 + nd / divisor) / max(1, nt).
    """
    t, d = _unfolded(list(fold))
    decoys = F.transform("decoys", lambda x: key(x)) if "decoys" in scores.columns else F.array(d)
    both = F.concat(F.array(F.struct(t.alias("k"), F.lit(1).alias("t"), F.lit(0).alias("d"))), F.transform(decoys, lambda x: F.struct(x.alias("k"), F.lit(0).alias("t"), F.lit(1).alias("d"))))
    per_key = scores.select(*by, F.explode(both).alias("x")).groupBy(*by, F.col("x.k").alias("score_key")).agg(F.sum("x.t").alias("t"), F.sum("x.d").alias("d"))
    down = Window.partitionBy(*by).orderBy(F.col("score_key").desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    run = per_key.select(*by, "score_key", (F.col("t") > 0).alias("at_target"), F.sum("t").over(down).alias("nt"), F.sum("d").over(down).alias("nd"))
    return run.withColumn("est", (1 + F.col("nd") / F.lit(float(divisor))) / F.greatest(F.col("nt"), F.lit(1)))


def select(table: DataFrame, strata: DataFrame, by: list[str], q: float) -> DataFrame:
    """(by..., threshold_key, n_discoveries, fdr_hat): the cut with most discoveries among those with est <= q.

    A stratum without such a cut keeps its row: threshold null, 0, null.
    """
    ok = table.where("at_target").where(F.col("est") <= q)
    best = ok.groupBy(*by).agg(F.max_by(F.struct("score_key", "nt", "est"), F.struct("nt", "score_key")).alias("b"))
    out = strata.select(*by).distinct().join(best, by, "left")
    return out.select(*by, F.col("b.score_key").alias("threshold_key"), F.coalesce("b.nt", F.lit(0)).cast("long").alias("n_discoveries"), F.col("b.est").alias("fdr_hat"))


def best_cut(table: DataFrame, by: list[str]) -> DataFrame:
    """(by..., cut_key, targets_above, decoys_above, estimate, separated): the least estimate; of equal ones the highest cut."""
    b = table.where("at_target").groupBy(*by).agg(F.min_by(F.struct("score_key", "nt", "nd", "est"), F.struct(F.col("est"), -F.col("score_key"))).alias("b"))
    return b.select(*by, F.col("b.score_key").alias("cut_key"), F.col("b.nt").alias("targets_above"), F.col("b.nd").alias("decoys_above"), F.col("b.est").alias("estimate"), ((F.col("b.nd") == 0) & (F.col("b.nt") > 0)).alias("separated"))


def flag(scores: DataFrame, selections: DataFrame, by: list[str], fold: list[str] = ("nli_directional",)) -> DataFrame:
    """Adds threshold_key and flagged: the key of the target is at or above the threshold."""
    t, _ = _unfolded(list(fold))
    return scores.join(selections.select(*by, "threshold_key"), by, "left").withColumn("flagged", F.coalesce(t >= F.col("threshold_key"), F.lit(False)))


def findings(flagged: DataFrame, by: list[str]) -> DataFrame:
    """(by..., input_id, stratum, n_channels, channels): inputs with at least one flag; order by n_channels desc, input_id."""
    return flagged.where("flagged").groupBy(*by, "input_id", "stratum").agg(F.count(F.lit(1)).alias("n_channels"), F.array_join(F.array_sort(F.collect_list("channel")), ",").alias("channels"))


def top_findings(found: DataFrame, by: list[str], top: int = 25) -> DataFrame:
    """``findings`` with their ``place``: most channels first, then by id, the first ``top`` of each group."""
    w = Window.partitionBy(*by).orderBy(F.col("n_channels").desc(), "input_id")
    return found.withColumn("place", F.row_number().over(w)).where(F.col("place") <= top)


def reading(q: float) -> Column:
    """What a best cut says in words of a code."""
    return (
        F.when(F.col("estimate").isNull(), "no inputs").when(F.col("n_discoveries") > 0, "flagged").when(F.col("separated"), "under the floor").when(F.col("estimate") < 0.5, "partly separated").otherwise("no separation")
    )


def competition(scores: DataFrame, by: list[str], q: float, fold: list[str] = ("nli_directional",)) -> tuple[DataFrame, DataFrame]:
    """(selections, flagged inputs) where each target competes with the best of its own decoys.

    A tie is the decoy's.  est = (1 + losses) / (r * max(1, wins)).
    """
    t, d = _unfolded(list(fold))
    top = F.array_max(F.transform("decoys", lambda x: key(x))) if "decoys" in scores.columns else d
    r = F.size("decoys") if "decoys" in scores.columns else F.lit(1)
    w = scores.withColumn("r", r).withColumn("w_key", F.greatest(t, top)).withColumn("wins", t > top)
    per = w.groupBy(*by, "w_key").agg(F.count_if("wins").alias("w"), F.count_if(~F.col("wins")).alias("l"), F.max("r").alias("r"))
    down = Window.partitionBy(*by).orderBy(F.col("w_key").desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    run = per.select(*by, "w_key", "r", F.sum("w").over(down).alias("nw"), F.sum("l").over(down).alias("nl")).withColumn("est", (1 + F.col("nl")) / (F.col("r") * F.greatest(F.col("nw"), F.lit(1))))
    best = run.where(F.col("est") <= q).where("nw > 0").groupBy(*by).agg(F.max_by(F.struct("w_key", "nw", "est"), F.struct("nw", "w_key")).alias("b"))
    sel = scores.select(*by).distinct().join(best, by, "left").select(*by, F.col("b.w_key").alias("threshold_key"), F.coalesce("b.nw", F.lit(0)).cast("long").alias("n_discoveries"), F.col("b.est").alias("fdr_hat"))
    flagged = w.join(sel.select(*by, "threshold_key"), by).withColumn("flagged", F.coalesce(F.col("wins") & (F.col("w_key") >= F.col("threshold_key")), F.lit(False)))
    return sel, flagged


def sign_statistic(scores: DataFrame, by: list[str]) -> DataFrame:
    """(by..., m, share): of inputs whose target and decoy differ, the share with the greater target; null if none differ."""
    t, d = key(F.col("target")), key(F.col("decoy"))
    return scores.groupBy(*by).agg(F.count_if(t != d).alias("m"), F.try_divide(F.count_if(t > d).cast("double"), F.count_if(t != d).cast("double")).alias("share"))


def closest(best: DataFrame, by: list[str], channels: list[str]) -> DataFrame:
    """The least estimate over channels and strata; of equal ones the first channel."""
    place = F.array_position(F.array(*(F.lit(c) for c in channels)), F.col("channel"))
    return best.groupBy(*by).agg(F.min_by(F.struct("channel", "eff_stratum", "estimate"), F.struct("estimate", place, "eff_stratum")).alias("b")).select(*by, "b.*")
