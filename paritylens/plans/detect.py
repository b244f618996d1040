"""Composed plans: detection over recordings, several pairings at once, and the report."""

from __future__ import annotations

import hashlib
import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paritylens.functions import text as X
from paritylens.operators import conformance, fdr, log, modes, pairings
from paritylens.schemas import TRIO
from paritylens.session import cut_lineage

PARTITION_CHANNELS = ["mode_share", "dispersion", "novel_mode"]


def with_modes(samples: DataFrame, roster: tuple[str, ...] = TRIO) -> DataFrame:
    """Usable samples of replayed tuples with mode and shape.

    Text work is done where the line is read: a join on the text would gather
    all samples of a frequent answer in one task, and Python after the
    exchange by input would hide from the planner that inputs are together.
    """
    said = F.when(F.col("error").isNull(), F.col("output"))
    return log.usable(log.replayed(samples.withColumns({"mode": X.normalise(said), "shape": X.shape(said)}), roster))


def scores(moded: DataFrame, by: list[str]) -> DataFrame:
    """(by..., input_id, stratum, channel, target, decoy) of the partition channels."""
    keys = [*by, "input_id"]
    wide = modes.distances(modes.mode_counts(moded, keys), keys)
    strata = modes.modal_shape(moded, keys, F.col("shape"))
    return modes.long_scores(wide.join(strata, keys), [*keys, "stratum"], PARTITION_CHANNELS)


def judged(scored: DataFrame, by: list[str], q: float, least: int = fdr.MIN_STRATUM) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(flagged scores, selections, best cuts) per recording, channel and effective stratum.

    The scores, one row per input and channel, are written once; cuts,
    selections and flags are made of that table and not of the log again.
    """
    group = [*by, "channel", "eff_stratum"]
    scored = cut_lineage(scored)
    eff = fdr.effective_strata(scored, [*by, "channel"], least)
    table = fdr.cuts(eff, group)
    sel = fdr.select(table, eff, group, q)
    best = fdr.best_cut(table, group)
    return fdr.flag(eff, sel, group), sel, best


def detect(samples: DataFrame, by: list[str] = ("recording_id",), q: float = 0.10) -> tuple[DataFrame, DataFrame, DataFrame]:
    by = list(by)
    return judged(scores(with_modes(samples), by), by, q)


def surface_drift(kept: DataFrame, by: list[str]) -> DataFrame:
    """(by..., input_id, drift_t, drift_d) of the words of both clouds of each input.

    Words of each distinct output of an input are cut once and weighted by how often it was given.
    """
    keys = [*by, "input_id"]
    n = lambda arm: F.count_if(F.col("arm") == arm)
    per = kept.groupBy(*keys, "output").agg(n("A").alias("a"), n("A_prime").alias("p"), n("B").alias("b"))
    tokens = per.select(*keys, "a", "p", "b", F.explode(X.word_tokens(F.col("output"))).alias("word"))
    counts = tokens.groupBy(*keys, "word").agg(F.sum("a").alias("ca"), F.sum("p").alias("cp"), F.sum("b").alias("cb"))
    return modes.drift_of_counts(counts, keys)


def all_scores(moded: DataFrame, by: list[str], vectors: DataFrame | None = None, judged_pairs: DataFrame | None = None, limit: float = modes.DRIFT_LIMIT) -> tuple[DataFrame, DataFrame]:
    """(scores, channels) of every channel that has what it needs.

    ``vectors``: by..., input_id, arm and embedding of every sample, by a model
    of the caller.  ``judged_pairs``: by..., input_id, side (t or d) and the four
    numbers of ``modes.judged_pair`` for outputs at equal places.
    scores: by..., input_id, stratum, channel, target, decoy.  channels: by...,
    channel, n_inputs, n_blocked, skipped; a skipped channel has no scores.
    """
    keys = [*by, "input_id"]
    wide = modes.distances(modes.mode_counts(moded, keys), keys).join(modes.modal_shape(moded, keys, F.col("shape")), keys)
    wide = cut_lineage(wide.select(*keys, "stratum", *(f"{c}_{x}" for c in PARTITION_CHANNELS for x in "td")))
    inputs = wide.select(*keys, "stratum")
    n = inputs.groupBy(*by).agg(F.count(F.lit(1)).alias("n_inputs"))
    row = [*by, "channel", "n_inputs", "n_blocked", "skipped"]
    none = lambda names, why: n.withColumn("channel", F.explode(F.array(*(F.lit(c) for c in names)))).withColumns({"n_blocked": F.lit(0).cast("long"), "skipped": F.lit(why).cast("string")}).select(*row)
    found = [modes.long_scores(wide, [*keys, "stratum"], PARTITION_CHANNELS)]
    channels = [none(PARTITION_CHANNELS, None)]
    if vectors is None:
        channels.append(none(["embedding"], "no embedder"))
    else:
        far = inputs.join(modes.centroid_distance(vectors, keys), keys).join(surface_drift(moded, by), keys, "left").fillna(0.0, ["drift_t"])
        gated = cut_lineage(modes.gate(far, by, limit))
        found.append(modes.long_scores(gated.where("not skipped"), [*keys, "stratum"], ["embedding"]))
        state = gated.groupBy(*by).agg(F.count(F.lit(1)).alias("n_inputs"), F.count_if(~F.col("allowed")).alias("n_blocked"), F.bool_or("skipped").alias("s"))
        channels.append(state.select(*by, F.lit("embedding").alias("channel"), "n_inputs", "n_blocked", F.when(F.col("s"), "surface drift").alias("skipped")))
    names = ["nli_contradiction", "nli_directional"]
    if judged_pairs is None:
        channels.append(none(names, "no judge"))
    else:
        means = inputs.join(modes.judged_scores(judged_pairs, keys), keys)
        found.append(modes.long_scores(means, [*keys, "stratum"], names))
        channels.append(none(names, None))
    scored, state = found[0], channels[0]
    for x in found[1:]:
        scored = scored.unionByName(x)
    for x in channels[1:]:
        state = state.unionByName(x)
    return scored, state


def notes(samples: DataFrame, k: int, channels: DataFrame, by: str = "recording_id") -> DataFrame:
    """(recording_id, note, n): what a reader of a report has to know, one row for each note that applies.

    dropped: inputs without a usable sample in some arm; short: inputs with
    fewer than k in one; gated: inputs whose embedding was held back; midnight:
    the recording passes a UTC midnight.
    """
    n = lambda arm: F.count_if((F.col("arm") == arm) & F.col("__ok"))
    kept = log.replayed(samples).withColumn("__ok", F.col("error").isNull())
    sizes = kept.groupBy(by, "input_id").agg(F.least(*(n(a) for a in TRIO)).alias("least"))
    counts = sizes.groupBy(by).agg(F.count_if(F.col("least") == 0).alias("dropped"), F.count_if((F.col("least") > 0) & (F.col("least") < k)).alias("short"))
    held = channels.where("channel = 'embedding' and skipped is null").select(by, F.col("n_blocked").alias("gated"))
    day = log.sessions(samples).select(by, F.col("midnight").cast("long").alias("midnight"))
    both = counts.join(held, by, "left").join(day, by, "left")
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("note"), F.coalesce(F.col(c), F.lit(0)).cast("long").alias("n")) for c in ("dropped", "short", "gated", "midnight"))))
    return both.select(by, each.alias("x")).select(by, "x.*").where("n > 0")


def design_r(samples: DataFrame, q: float = 0.10) -> DataFrame:
    """(recording_id, pairing, input_id, stratum, n_channels, channels): findings of all pairings from one scan."""
    four = with_modes(samples, ("A", "A_prime", "B", "B_prime"))
    rel = pairings.relabel(four, pairings.DESIGN_R)
    by = ["recording_id", "pairing"]
    flagged, _, _ = judged(scores(rel, by), by, q)
    return fdr.findings(flagged, by)


def pools(samples: DataFrame) -> DataFrame:
    """(recording_id, arm, output, pos): outputs in the order of first seen inputs, then of samples."""
    kept = log.usable(log.replayed(samples)).withColumn("seen", F.min("line_no").over(Window.partitionBy("recording_id", "input_id")))
    return kept.select("recording_id", "arm", "output", F.struct("seen", "sample_idx", "line_no").alias("pos"))


def rules(samples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(contract, violations) of every recording."""
    # Texts are parsed once; the tables written here are small against the log.
    p = cut_lineage(conformance.profile(pools(samples), ["recording_id"]))
    contract = cut_lineage(conformance.induce(p, ["recording_id"]))
    return contract, conformance.violations(p, contract, ["recording_id"])


def config_hash(instruments: dict, params: dict, corpus: str, defaults: dict | None = None) -> str:
    """First 16 hex digits of the SHA-256 of the canonical JSON; a parameter at its default plays no part."""
    usual = defaults or {}
    kept = {k: v for k, v in params.items() if not (k in usual and usual[k] == v)}
    body = json.dumps({"instruments": instruments, "params": kept, "corpus": corpus}, sort_keys=True, separators=(",", ":"), default=str)
    return hashlib.sha256(body.encode()).hexdigest()[:16]


def _line(inputs: DataFrame) -> Column:
    return F.concat(F.col("input_id"), F.coalesce(F.concat(F.lit("\0"), F.col("text")), F.lit("")), F.lit("\n"))


def corpus_fingerprint(inputs: DataFrame) -> DataFrame:
    """One row: 16 hex digits over the ids in order with their texts.

    A digest of one stream is sequential; the sorted rows come to one place in
    Arrow batches and go through it there, none of them held.
    """

    def run(batches):
        h = hashlib.sha256()
        for batch in batches:
            for line in batch.column("line").to_pylist():
                h.update(line.encode())
        yield pa.RecordBatch.from_arrays([pa.array([h.hexdigest()[:16]])], names=["fingerprint"])

    lines = inputs.where(F.col("input_id").isNotNull()).select("input_id", _line(inputs).alias("line"))
    # Ranges are sorted apart; one task reads them one behind the other.
    return lines.orderBy("input_id", "line").select("line").coalesce(1).mapInArrow(run, "fingerprint string")


def corpus_digest(inputs: DataFrame, digits: int = 4) -> DataFrame:
    """One row: 16 hex digits that tell corpora of any size apart, the digest of the digests of hash ranges.

    Not the digits of ``corpus_fingerprint``, but made in parallel.  ``digits``
    sets 16 ** digits ranges; a range should fit in a task.
    """
    h = inputs.where(F.col("input_id").isNotNull()).select(F.sha2(_line(inputs), 256).alias("h"))
    parts = h.groupBy(F.substring("h", 1, digits).alias("r")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("d"))
    return parts.agg(F.substring(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "d"))), lambda x: x["d"]), ""), 256), 1, 16).alias("fingerprint"))


def report(flagged: DataFrame, selections: DataFrame, best: DataFrame, by: list[str], q: float, top: int = 25) -> DataFrame:
    """One JSON text per recording: what each channel found or how close it came, and the first findings."""
    group = [*by, "channel", "eff_stratum"]
    line = selections.join(best, group, "left").withColumn("reading", fdr.reading(q))
    channels = line.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("channel", "eff_stratum", "n_discoveries", "fdr_hat", "estimate", "targets_above", "decoys_above", "reading"))).alias("channels"))
    found = fdr.findings(flagged, by)
    total = found.groupBy(*by).agg(F.count(F.lit(1)).alias("n_findings"))
    # Ranked before they are gathered, so a row holds ``top`` of them at most.
    shown = fdr.top_findings(found, by, top).groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "input_id", "channels"))), lambda x: F.struct(x["input_id"].alias("input_id"), x["channels"].alias("channels"))).alias("findings"))
    first = total.join(shown, by)
    out = channels.join(first, by, "left")
    return out.select(*by, F.to_json(F.struct(F.lit(q).alias("q"), F.lit(fdr.floor_of(q)).alias("floor"), F.coalesce("n_findings", F.lit(0)).alias("n_findings"), "channels", "findings")).alias("report"))


def report_text(reports: DataFrame, by: list[str]) -> DataFrame:
    """(by..., text): each JSON report as lines for a reader."""
    channel = "struct<channel:string,eff_stratum:string,n_discoveries:bigint,fdr_hat:double,estimate:double,targets_above:bigint,decoys_above:bigint,reading:string>"
    r = F.from_json("report", f"struct<q:double,floor:int,n_findings:bigint,channels:array<{channel}>,findings:array<struct<input_id:string,channels:string>>>")
    x = reports.select(*by, r.alias("r"))
    row = lambda c: F.format_string("  %s [%s]: %d flagged, %s", c["channel"], c["eff_stratum"], c["n_discoveries"], c["reading"])
    found = lambda f: F.format_string("  %s (%s)", f["input_id"], f["channels"])
    none = F.array().cast("array<string>")
    head = F.array(F.format_string("%d inputs flagged at q = %s", "r.n_findings", F.col("r.q").cast("string")))
    floor = F.when(F.col("r.n_findings") == 0, F.array(F.format_string("nothing can be reported below %d inputs", "r.floor"))).otherwise(none)
    more = F.col("r.n_findings") - F.coalesce(F.size("r.findings"), F.lit(0))
    rest = F.when(more > 0, F.array(F.format_string("  and %d more", more))).otherwise(none)
    lines = F.concat(head, floor, F.array(F.lit("checks")), F.transform("r.channels", row), F.coalesce(F.concat(F.array(F.lit("findings")), F.transform("r.findings", found), rest), none))
    return x.select(*by, F.array_join(lines, "\n").alias("text"))
