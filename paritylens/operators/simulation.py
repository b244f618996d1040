"""The estimator under designs of known truth: cells of simulated inputs, one row for each cell and repetition.

A cell draws, for every input, shares of modes and clouds of ``k`` samples from
them, scores the clouds by the distance of their counts and applies the
selection rules.  Repetitions have generators of their own seeds, so any
partitioning gives the same figures; parity with other implementations is of
distributions, not of draws.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Design of a cell: what it is, samples, inputs changed, strength, dependence and its kind, decoy sets.
DESIGN = "block int, kind string, k int, changed int, strength double, rho double, variant string, r int, modes int"

_RHOS = (0.0, 0.3, 0.5, 0.7)


def designs(n: int = 40) -> list[tuple]:
    """The nine blocks: mixtures, many modes, a tied decoy, three baselines, no change for the sign statistic, dependence on the candidate, on the stored side, several decoy sets, and a novel mode of exact size."""
    half = n // 2
    rows = [(1, "mixture", k, half, s, 0.0, "none", 1, 4) for k in (6, 20) for s in (0.3, 0.6, 0.9)]
    rows += [(2, "mixture", 20, half, 0.6, 0.0, "none", 1, m) for m in (2, 4, 8)]
    rows += [(3, "mixture", 20, 0, 0.0, rho, "tied", 1, 4) for rho in _RHOS]
    rows += [(4, "three", k, half, 0.6, 0.0, "none", 3, 4) for k in (6, 20)]
    rows += [(5, "mixture", k, 0, 0.0, 0.0, "none", 1, 4) for k in (6, 20)]
    rows += [(6, "candidate", k, 0, 0.0, rho, v, 1, 4) for k in (6, 20) for v in ("chain", "anchor") for rho in _RHOS]
    rows += [(7, "stored", k, 0, 0.0, rho, v, 1, 4) for k in (6, 20) for v in ("chain", "anchor") for rho in _RHOS]
    rows += [(8, "many", k, 0, 0.0, rho, "chain", r, 4) for r in (1, 2, 3) for k in (6, 20) for rho in _RHOS]
    return rows + [(9, "shock", k, half, eps, 0.0, "none", 1, 5) for k in (6, 20) for eps in (0.2, 0.4, 0.6, 0.8)]


def _cloud(g: np.random.Generator, shares: np.ndarray, k: int) -> np.ndarray:
    """(inputs, k) modes drawn by the running shares."""
    edges = np.cumsum(shares, axis=1)[:, None, :-1]
    return (g.random((len(shares), k, 1)) >= edges).sum(axis=2)


def _dependent(g: np.random.Generator, cloud: np.ndarray, rho: float, variant: str) -> np.ndarray:
    """A sample repeats the one before it (chain) or the first (anchor) with chance ``rho``."""
    again = g.random(cloud.shape) < rho
    again[:, 0] = False
    if variant == "anchor":
        return np.where(again, cloud[:, :1], cloud)
    # The last place that was drawn anew holds until the next one.
    at = np.maximum.accumulate(np.where(again, 0, np.arange(cloud.shape[1])), axis=1)
    return np.take_along_axis(cloud, at, axis=1)


def _distance(x: np.ndarray, y: np.ndarray, modes: int) -> np.ndarray:
    """Distances as whole numbers of 1e-9."""
    count = lambda c: (c[:, :, None] == np.arange(modes)).sum(axis=1)
    return np.rint(np.abs(count(x) - count(y)).sum(axis=1) / (2 * x.shape[1]) * 1e9).astype(np.int64)


def pick(targets: np.ndarray, decoys: np.ndarray, q: float, estimate: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """Which targets stand at or above the cut that reports most of them with an estimate of at most ``q``."""
    cuts = np.unique(targets)
    above = lambda x: len(x) - np.searchsorted(np.sort(x), cuts, "left")
    t, d = above(targets), above(decoys)
    fits = np.flatnonzero((estimate(t, d) <= q) & (t > 0))
    return targets >= cuts[fits[0]] if len(fits) else np.zeros(len(targets), bool)


def pooled(r: int = 1) -> Callable:
    """(1 + d / r) / t: decoys of r sets pooled."""
    return lambda t, d: (1 + d / r) / np.maximum(t, 1)


def parked(r: int) -> Callable:
    """(1 + d) / (r t): one count for r sets.  It does not hold its budget; it is here to be measured and nothing selects by it."""
    return lambda t, d: (1 + d) / (r * np.maximum(t, 1))


def compete(targets: np.ndarray, decoys: np.ndarray, q: float) -> np.ndarray:
    """Every target against the best of its own decoys (rows of ``decoys``); ties are the decoy's."""
    r, best = len(decoys), decoys.max(axis=0)
    top, wins = np.maximum(targets, best), targets > best
    cuts = np.unique(top)
    above = lambda x: len(x) - np.searchsorted(np.sort(x), cuts, "left")
    w, lost = above(top[wins]), above(top[~wins])
    fits = np.flatnonzero(((1 + lost) / (r * np.maximum(w, 1)) <= q) & (w > 0))
    return wins & (top >= cuts[fits[0]]) if len(fits) else np.zeros(len(targets), bool)


def _cell(g: np.random.Generator, c, n: int, q: float) -> tuple[dict[str, np.ndarray], np.ndarray, float]:
    """(flags of every rule, truth, sign statistic) of one cell."""
    modes, k = c.modes, c.k
    shares = g.dirichlet(np.ones(modes - (c.kind == "shock")), n)
    truth = np.arange(n) < c.changed
    if c.kind == "shock":
        shares = np.hstack([shares, np.zeros((n, 1))])
        novel = np.zeros(modes)
        novel[-1] = 1.0
        other = (1 - c.strength) * shares + c.strength * novel
    else:
        other = (1 - c.strength) * shares + c.strength * g.dirichlet(np.ones(modes), n)
    changed = np.where(truth[:, None], other, shares)
    far = lambda x, y: _distance(x, y, modes)
    a, b, b2 = _cloud(g, shares, k), _cloud(g, changed, k), _cloud(g, changed, k)
    repeats = [_cloud(g, shares, k) for _ in range(max(c.r, 1))]
    if c.variant == "tied":
        repeats[0] = np.where(g.random((n, k)) < c.rho, a, repeats[0])
    if c.kind in ("candidate", "many"):
        b = _dependent(g, b, c.rho, c.variant)
    if c.kind == "stored":
        a = _dependent(g, a, c.rho, c.variant)
        target, sets = far(a, b), [far(b, b2)]
    else:
        target, sets = far(a, b), [far(a, x) for x in repeats]
    flags = {"single": pick(target, sets[0], q, pooled())}
    if c.kind in ("mixture", "shock"):
        own = far(b, b2)
        flags["pooled"] = pick(target, np.concatenate([sets[0], own]), q, pooled(2))
        flags["max"] = pick(target, np.maximum(sets[0], own), q, pooled())
    if c.kind == "three":
        flags["star"] = pick(target, np.concatenate(sets[:2]), q, pooled(2))
        flags["all_pairs"] = pick(target, np.concatenate([*sets[:2], far(repeats[0], repeats[1])]), q, pooled(3))
    if c.kind == "many":
        flags["competition"] = compete(target, np.stack(sets), q)
        flags["parked"] = pick(target, np.concatenate(sets), q, parked(c.r))
    apart = target != sets[0]
    return flags, truth, float((target > sets[0])[apart].mean()) if apart.any() else float("nan")


def cells(spark: SparkSession, rows: list[tuple] | None = None, reps: int = 100, n: int = 40, q: float = 0.10, seed: int = 0) -> DataFrame:
    """(design..., rep, rule, n_flagged, n_false, n_true, sign) of every design, repetition and rule."""
    design = spark.createDataFrame(designs(n) if rows is None else rows, DESIGN)
    work = design.crossJoin(spark.range(reps).withColumnRenamed("id", "rep")).repartition(spark.sparkContext.defaultParallelism)  # a list of designs times repetitions, no data
    names = [f.name for f in design.schema.fields]
    ranks = {r: i for i, r in enumerate(designs(n) if rows is None else rows)}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for c in batch.itertuples(index=False):
                own = tuple(getattr(c, x) for x in names)
                flags, truth, sign = _cell(np.random.default_rng([seed, c.block, ranks[own], int(c.rep)]), c, n, q)
                out += [(*own, c.rep, rule, int(f.sum()), int((f & ~truth).sum()), int((f & truth).sum()), sign) for rule, f in flags.items()]
            yield pd.DataFrame(out, columns=[*names, "rep", "rule", "n_flagged", "n_false", "n_true", "sign"])

    return work.mapInPandas(run, DESIGN + ", rep long, rule string, n_flagged long, n_false long, n_true long, sign double")


def summary(found: DataFrame) -> DataFrame:
    """One row per design and rule: mean share of false flags, power, how often anything is flagged, sign statistic."""
    keys = [x.split()[0] for x in DESIGN.split(", ")]
    return found.groupBy(*keys, "rule").agg(
        F.count(F.lit(1)).alias("reps"), F.avg(F.when(F.col("n_flagged") > 0, F.col("n_false") / F.col("n_flagged")).otherwise(0.0)).alias("fdp"),
        F.avg(F.when(F.col("changed") > 0, F.col("n_true") / F.col("changed"))).alias("power"), F.avg((F.col("n_flagged") > 0).cast("double")).alias("any"), F.avg(F.nanvl("sign", F.lit(None).cast("double"))).alias("sign"),
    )
