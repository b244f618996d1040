import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from paritylens.operators import fdr

U, L = 0.8333333333333334, 0.8333333333333333
BY = ["channel", "eff_stratum"]


def frame(spark, targets, decoys):
    rows = [("mode_share", "s", f"i{i:04d}", float(t), float(d)) for i, (t, d) in enumerate(zip(targets, decoys))]
    return spark.createDataFrame(rows, "channel string, eff_stratum string, input_id string, target double, decoy double")


def run(spark, targets, decoys, q=0.10):
    s = frame(spark, targets, decoys)
    table = fdr.cuts(s, BY)
    sel = fdr.select(table, s, BY, q)
    return table, sel.first(), fdr.best_cut(table, BY).first(), fdr.flag(s, sel, BY)


def brute(targets, decoys, q):
    t, d = np.round(targets, 9), np.round(decoys, 9)
    best = (0, None, None)
    for c in np.unique(t):
        n = int((t >= c).sum())
        est = (1 + int((d >= c).sum())) / max(1, n)
        if est <= q and n > best[0]:
            best = (n, round(c * 1e9), est)
    return best


def test_floats_that_are_one_score_are_one_cut(spark):
    targets = 3 * [U] + 5 * [L] + 5 * [1] + 11 * [2 / 3] + 3 * [1 / 2] + 6 * [1 / 3] + 3 * [1 / 6] + 4 * [0]
    decoys = [U] + 7 * [L] + [1] + 3 * [2 / 3] + 13 * [1 / 2] + 8 * [1 / 3] + 6 * [1 / 6] + [0]
    table, sel, best, _ = run(spark, targets, decoys)
    at = {r.score_key: r.est for r in table.collect()}
    assert at[833333333] == pytest.approx(10 / 13)
    assert (best.cut_key, best.targets_above, best.decoys_above, best.estimate) == (10**9, 5, 1, 0.4)
    assert sel.n_discoveries == 0 and sel.threshold_key is None


@pytest.mark.parametrize("targets,decoys,n,threshold", [(10 * [1] + 10 * [U] + 20 * [0.5], 2 * [L] + 38 * [0.5], 10, 10**9), (10 * [U] + 10 * [L] + 20 * [0.5], 40 * [0.5], 20, 833333333)])
def test_tied_decoys_block_and_lower_floats_pass(spark, targets, decoys, n, threshold):
    _, sel, _, flags = run(spark, targets, decoys)
    assert (sel.n_discoveries, sel.threshold_key) == (n, threshold)
    assert flags.where("flagged").count() == n


def test_selection_equals_a_scan_of_all_cuts(spark):
    g = random.Random(3)
    rows, want = [], {}
    for c in range(30):
        k = g.choice([3, 5, 12])
        t = [max(g.randint(0, k), g.randint(0, k)) / k for _ in range(60)]
        d = [g.randint(0, k) / k * g.choice([1, 0.3]) for _ in range(60)]
        want[f"c{c}"] = brute(t, d, 0.2)
        rows += [(f"c{c}", "s", f"i{i}", x, y) for i, (x, y) in enumerate(zip(t, d))]
    for parts in (1, 7):
        s = spark.createDataFrame(rows, "channel string, eff_stratum string, input_id string, target double, decoy double").repartition(parts)
        sel = fdr.select(fdr.cuts(s, BY), s, BY, 0.2).collect()
        assert {r.channel: (r.n_discoveries, r.threshold_key) for r in sel} == {k: v[:2] for k, v in want.items()}


def test_competition_is_not_pooling(spark):
    t, d = 9 * [1.0] + [0.5], 9 * [0.6] + [0.3]
    _, sel, _, _ = run(spark, t, d)
    assert sel.n_discoveries == 0
    sel, flags = fdr.competition(frame(spark, t, d), BY, 0.10)
    assert sel.first().n_discoveries == 10 and flags.where("flagged").count() == 10
    assert fdr.competition(frame(spark, 12 * [L], 12 * [U]), BY, 0.10)[0].first().n_discoveries == 0


def test_floor_with_three_decoys(spark):
    t = 4 * [1.0] + 8 * [0.1]
    rows = [("mode_share", "s", f"i{i}", x, [0.2] * 3 if i < 4 else [0.5] * 3) for i, x in enumerate(t)]
    s = spark.createDataFrame(rows, "channel string, eff_stratum string, input_id string, target double, decoys array<double>")
    assert fdr.floor_of(0.1) == 10 and fdr.floor_of(0.1, 3) == 4 and fdr.floor_of(0.3) == 4
    assert fdr.competition(s, BY, 0.10)[0].first().n_discoveries == 4
    lost = s.withColumn("decoys", F.when(F.col("input_id") == "i0", F.array(F.lit(1.5), F.lit(0.2), F.lit(0.2))).otherwise(F.col("decoys")))
    assert fdr.competition(lost, BY, 0.10)[0].first().n_discoveries == 0


def test_small_strata_are_pooled(spark):
    s = spark.range(100).select(F.lit("mode_share").alias("channel"), F.when(F.col("id") < 90, "big").otherwise("tiny").alias("stratum"))
    assert {r[0] for r in fdr.effective_strata(s, ["channel"]).select("eff_stratum").distinct().collect()} == {"big", fdr.POOLED}


def test_ratio_sign_readings_and_folding(spark):
    s = frame(spark, [1, 1, 0.5, 0.2], [0.5, 0.2, 0.5, 0.9])
    r = fdr.sign_statistic(s, BY).first()
    assert (r.m, r.share) == (3, pytest.approx(2 / 3))
    two = s.select("channel", "eff_stratum", "target", F.array("decoy", F.lit(0.0)).alias("decoys"))
    assert {x.score_key: x.est for x in fdr.cuts(two, BY, divisor=2).collect()}[10**9] == pytest.approx(0.5)
    signed = frame(spark, [-1.0] * 20, [0.1] * 20).withColumn("channel", F.lit("nli_directional"))
    table = fdr.cuts(signed, BY)
    sel = fdr.select(table, signed, BY, 0.1)
    got = fdr.flag(signed, sel, BY)
    assert got.where("flagged and target = -1").count() == 20
    line = sel.join(fdr.best_cut(table, BY), BY).select(fdr.reading(0.1).alias("r")).first()
    assert line.r == "flagged"


def test_no_inputs_keep_no_rows(spark):
    s = frame(spark, [1.0], [0.0]).limit(0)
    assert fdr.cuts(s, BY).count() == 0 and fdr.select(fdr.cuts(s, BY), s, BY, 0.1).count() == 0
