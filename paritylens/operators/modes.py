"""Answers grouped into modes, and the distances of two clouds of answers.

One aggregate holds what every channel needs: for each (pairing, input, mode)
how often the baseline, its repeat and the candidate gave that mode.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

EPS = 1e-9


def mode_counts(samples: DataFrame, by: list[str], mode: str = "mode") -> DataFrame:
    """(by..., mode, ca, cp, cb) of usable samples with arms A, A_prime and B."""
    n = lambda arm: F.count_if(F.col("arm") == arm)
    return samples.groupBy(*by, F.col(mode).alias("mode")).agg(n("A").alias("ca"), n("A_prime").alias("cp"), n("B").alias("cb"))


def mode_shares(samples: DataFrame, by: list[str], mode: str = "mode") -> DataFrame:
    """(by..., arm, mode, n, share)."""
    counts = samples.groupBy(*by, "arm", F.col(mode).alias("mode")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.groupBy(*by, "arm").agg(F.sum("n").alias("total"))
    return counts.join(total, [*by, "arm"]).select(*by, "arm", "mode", "n", (F.col("n") / F.col("total")).alias("share"))


def _ratio(top: Column, bottom: Column) -> Column:
    return F.coalesce(F.try_divide(top.cast("double"), bottom.cast("double")), F.lit(0.0))


def distances(counts: DataFrame, by: list[str]) -> DataFrame:
    """One row per input: sizes, and target and decoy of mode_share, dispersion and novel_mode.

    Sums of whole numbers are divided once, so the result does not depend on
    the order of rows.  Inputs that lack an arm are dropped.
    """
    whole = Window.partitionBy(*by)
    x = counts.select("*", *(F.sum(c).over(whole).alias(n) for c, n in (("ca", "na"), ("cp", "np"), ("cb", "nb")))).where("na > 0 and np > 0 and nb > 0")
    diff = lambda c, n: F.sum(F.abs(F.col("ca") * F.col(n) - F.col(c) * F.col("na")))
    sq = lambda c: F.sum(F.col(c) * F.col(c))
    novel = lambda c: F.sum(F.when(F.col("ca") == 0, F.col(c)).otherwise(0))
    s = x.groupBy(*by, "na", "np", "nb").agg(
        diff("cb", "nb").alias("dt"), diff("cp", "np").alias("dd"), sq("ca").alias("qa"), sq("cp").alias("qp"), sq("cb").alias("qb"), novel("cb").alias("vt"), novel("cp").alias("vd"),
        F.count(F.lit(1)).alias("n_modes"),
    )
    spread = lambda n, q: _ratio(F.col(n) * F.col(n) - F.col(q), F.col(n) * F.col(n))
    a, p, b = spread("na", "qa"), spread("np", "qp"), spread("nb", "qb")
    moved = lambda u, v: (F.greatest(u, v) - F.least(u, v)) / (F.greatest(u, v) + F.lit(EPS))
    return s.select(
        *by, "na", "np", "nb", "n_modes",
        _ratio(F.col("dt"), 2 * F.col("na") * F.col("nb")).alias("mode_share_t"), _ratio(F.col("dd"), 2 * F.col("na") * F.col("np")).alias("mode_share_d"),
        moved(a, b).alias("dispersion_t"), moved(a, p).alias("dispersion_d"),
        _ratio(F.col("vt"), F.col("nb")).alias("novel_mode_t"), _ratio(F.col("vd"), F.col("np")).alias("novel_mode_d"),
        a.alias("dispersion_a"), p.alias("dispersion_p"), b.alias("dispersion_b"),
    )


CHANNELS = ["mode_share", "dispersion", "novel_mode", "embedding", "nli_contradiction", "nli_directional"]


def long_scores(wide: DataFrame, keep: list[str], channels: list[str]) -> DataFrame:
    """(keep..., channel, target, decoy), one row per channel."""
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("channel"), F.col(f"{c}_t").alias("target"), F.col(f"{c}_d").alias("decoy")) for c in channels)))
    return wide.select(*keep, each.alias("s")).select(*keep, "s.channel", "s.target", "s.decoy")


def modal_shape(samples: DataFrame, by: list[str], shape: Column) -> DataFrame:
    """(by..., stratum): the commonest shape of the baseline's cloud; of equal ones, the one met first."""
    n = samples.where("arm = 'A'").groupBy(*by, shape.alias("shape")).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("ord", "line_no")).alias("first"))
    return n.groupBy(*by).agg(F.max_by("shape", F.struct("n", -F.col("first.ord"), -F.col("first.line_no"))).alias("stratum"))


def drift(tokens: DataFrame, by: list[str]) -> DataFrame:
    """(by..., drift_t, drift_d): 1 - shared / all words of two clouds, words counted as often as they occur.

    ``tokens``: by..., arm, word.  Two clouds without words have no drift.
    """
    return drift_of_counts(mode_counts(tokens, by, "word"), by)


def drift_of_counts(c: DataFrame, by: list[str]) -> DataFrame:
    """The same of (by..., word, ca, cp, cb)."""
    part = lambda x: F.lit(1.0) - F.coalesce(F.try_divide(F.sum(F.least("ca", x)).cast("double"), F.sum(F.greatest("ca", x)).cast("double")), F.lit(1.0))
    return c.groupBy(*by).agg(part("cb").alias("drift_t"), part("cp").alias("drift_d"))


def centroid_distance(vectors: DataFrame, by: list[str], vector: str = "embedding") -> DataFrame:
    """(by..., embedding_t, embedding_d): 1 - cosine of the mean unit vectors of two clouds; a mean of length 0 has distance 0.

    Means are taken per dimension in partial sums; no cloud is collected.
    """
    norm = F.sqrt(F.aggregate(F.col(vector), F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    unit = vectors.select(*by, "arm", F.posexplode(F.transform(F.col(vector), lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(F.lit(0.0)))).alias("dim", "x"))
    mean = unit.groupBy(*by, "dim").agg(*(F.avg(F.when(F.col("arm") == a, F.col("x"))).alias(n) for a, n in (("A", "a"), ("A_prime", "p"), ("B", "b"))))
    dot = lambda x, y: F.sum(F.col(x) * F.col(y))
    s = mean.groupBy(*by).agg(dot("a", "a").alias("aa"), dot("p", "p").alias("pp"), dot("b", "b").alias("bb"), dot("a", "b").alias("ab"), dot("a", "p").alias("ap"))
    far = lambda xy, y: F.when((F.col("aa") > 0) & (F.col(y) > 0), 1 - F.col(xy) / F.sqrt(F.col("aa") * F.col(y))).otherwise(F.lit(0.0))
    return s.where("aa is not null and pp is not null and bb is not null").select(*by, far("ab", "bb").alias("embedding_t"), far("ap", "pp").alias("embedding_d"))


#: Surface drift above which an embedding says nothing about meaning.
DRIFT_LIMIT = 0.25


def gate(scores: DataFrame, recording: list[str], limit: float = DRIFT_LIMIT) -> DataFrame:
    """Embedding scores under the drift gate: (skipped, target, decoy).

    An input whose target drift exceeds ``limit`` is blocked and scores 0 for
    both; a channel with more than half of its inputs blocked is skipped.
    """
    blocked = F.col("drift_t") > limit
    share = scores.groupBy(*recording).agg((F.count_if(blocked) * 2 > F.count(F.lit(1))).alias("skipped"))
    zero = lambda c: F.when(blocked, F.lit(0.0)).otherwise(F.col(c))
    return scores.join(share, recording).withColumn("allowed", ~blocked).withColumn("embedding_t", zero("embedding_t")).withColumn("embedding_d", zero("embedding_d"))


def positional_pairs(samples: DataFrame, by: list[str]) -> DataFrame:
    """(by..., place, side, a, b): outputs at equal places of A and B (side t) and of A and A' (side d); the longer cloud's rest has no partner."""
    w = Window.partitionBy(*by, "arm").orderBy("sample_idx", "ord", "line_no")
    x = samples.select(*by, "arm", "output", F.row_number().over(w).alias("place"))
    a = x.where("arm = 'A'").select(*by, "place", F.col("output").alias("a"))
    other = x.where("arm <> 'A'").select(*by, "place", F.when(F.col("arm") == "B", "t").otherwise("d").alias("side"), F.col("output").alias("b"))
    return a.join(other, [*by, "place"])


def positional(pairs: DataFrame, by: list[str], score: str) -> DataFrame:
    """Mean of scores given for pairs of outputs at equal places of two clouds."""
    return pairs.groupBy(*by).agg(F.avg(score).alias(score))


def judged_pair(contradiction: Column, contradiction_back: Column, entailment: Column, entailment_back: Column) -> Column:
    """STRUCT<contradiction, directional> of what a judge says of a pair in both directions: the greater contradiction, and the signed difference of entailments."""
    return F.struct(F.greatest(contradiction, contradiction_back).alias("contradiction"), (entailment - entailment_back).alias("directional"))


def judged_scores(pairs: DataFrame, by: list[str]) -> DataFrame:
    """(by..., nli_contradiction_t and _d, nli_directional_t and _d): means over pairs (by..., side, judged)."""
    mean = lambda side, c: F.avg(F.when(F.col("side") == side, F.col(f"judged.{c}")))
    return pairs.groupBy(*by).agg(*(mean(x, c).alias(f"nli_{c}_{x}") for c in ("contradiction", "directional") for x in "td"))


def greedy_clusters(samples: DataFrame, by: list[str], same: Callable[[list[tuple[str, str]]], list[bool]], mode: str = "mode") -> DataFrame:
    """(by..., mode, cluster, calls): modes joined by a predicate that isn't transitive.

    Distinct modes come by falling count, then by text; each belongs to the
    first representative that matches it, or is one itself.  ``calls`` counts
    the comparisons of each mode with the representatives before it.  Only the
    distinct modes of one cloud are in one place.
    """
    counts = samples.groupBy(*by, F.col(mode).alias("mode")).agg(F.count(F.lit(1)).alias("n"))

    def run(cloud: pa.Table) -> pa.Table:
        cloud = cloud.sort_by([("n", "descending"), ("mode", "ascending")])
        texts = cloud.column("mode").to_pylist()
        owner = np.full(len(texts), -1)
        # Who stands first among those without an owner represents what matches it of the rest.
        while (free := np.flatnonzero(owner < 0)).size:
            lead, rest = free[0], free[1:]
            owner[lead] = lead
            if rest.size:
                owner[rest[np.array(same([(texts[lead], texts[i]) for i in rest]), bool)]] = lead
        leads = owner == np.arange(len(texts))
        calls = int((np.cumsum(leads) - leads).sum())
        out = {c: cloud.column(c) for c in by} | {"mode": cloud.column("mode"), "cluster": pa.array([texts[i] for i in owner], pa.string()), "calls": pa.array([calls] * len(texts), pa.int32())}
        return pa.table(out)

    kinds = {f.name: f.dataType.simpleString() for f in counts.schema.fields}
    return counts.groupBy(*by).applyInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in by) + ", mode string, cluster string, calls int")


def clustered_distances(samples: DataFrame, by: list[str], same: Callable[[list[tuple[str, str]]], list[bool]]) -> DataFrame:
    """``distances`` where a predicate joins modes: clusters of (A, B) give the target, those of (A, A') the decoy.

    (by..., mode_share_t and _d, dispersion_t and _d, novel_mode_t and _d); clouds of one pair share their clusters.
    """
    out = None
    for arm, side in (("B", "t"), ("A_prime", "d")):
        pair = samples.where(F.col("arm").isin("A", arm))
        labelled = pair.join(greedy_clusters(pair, by, same), [*by, "mode"]).withColumn("mode", F.col("cluster"))
        # The other arm plays both parts, so the target of the pair is its distance.
        twice = labelled.withColumn("arm", F.explode(F.when(F.col("arm") == "A", F.array(F.lit("A"))).otherwise(F.array(F.lit("A_prime"), F.lit("B")))))
        one = distances(mode_counts(twice, by), by).select(*by, *(F.col(f"{c}_t").alias(f"{c}_{side}") for c in ("mode_share", "dispersion", "novel_mode")))
        out = one if out is None else out.join(one, by)
    return out


def costs(counts: DataFrame, by: list[str]) -> DataFrame:
    """Per recording: clusterings, samples clustered and distinct modes of the joint clouds (A, B) and (A, A')."""
    per = counts.groupBy(*by, "input_id").agg(F.sum("ca").alias("a"), F.sum("cp").alias("p"), F.sum("cb").alias("b"), F.count_if(F.expr("ca + cb > 0")).alias("mt"), F.count_if(F.expr("ca + cp > 0")).alias("md")).where("a > 0 and p > 0 and b > 0")
    return per.groupBy(*by).agg((2 * F.count(F.lit(1))).alias("clusterings"), F.sum(2 * F.col("a") + F.col("b") + F.col("p")).alias("samples_clustered"), F.sum(F.col("mt") + F.col("md")).alias("distinct_modes"))
