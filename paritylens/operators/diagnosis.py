"""Decisions, their majorities and what varies between arms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paritylens.functions import text as X


def decisions(samples: DataFrame) -> DataFrame:
    return samples.withColumn("decision", X.decision(F.col("output")))


def majorities(decided: DataFrame, by: list[str]) -> DataFrame:
    """(by..., arm, decision): the commonest; of equal ones the first by name."""
    n = decided.groupBy(*by, "arm", "decision").agg(F.count(F.lit(1)).alias("n"))
    most = n.groupBy(*by, "arm").agg(F.max("n").alias("n"))
    return n.join(most, [*by, "arm", "n"]).groupBy(*by, "arm").agg(F.min("decision").alias("decision"))


def flips(majority: DataFrame, truth: DataFrame, by: list[str]) -> DataFrame:
    """(by..., fired, n, flips_decoy, flips_target): inputs whose majority differs between A and A', and A and B."""
    of = lambda a: F.max(F.when(F.col("arm") == a, F.col("decision")))
    w = majority.groupBy(*by, "input_id").agg(of("A").alias("a"), of("A_prime").alias("p"), of("B").alias("b")).where("a is not null and p is not null and b is not null")
    j = w.join(truth.select(*by, "input_id", "fired"), [*by, "input_id"], "left").withColumn("fired", F.coalesce("fired", F.lit(False)))
    return j.groupBy(*by, "fired").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.expr("a <> p")).alias("flips_decoy"), F.count_if(F.expr("a <> b")).alias("flips_target"))


def distinct_fraction(samples: DataFrame, by: list[str], mode: str = "mode") -> DataFrame:
    """(by..., arm, fraction): mean over clouds of distinct modes by samples."""
    c = samples.groupBy(*by, "input_id", "arm").agg((F.countDistinct(mode) / F.count(F.lit(1))).alias("f"))
    return c.groupBy(*by, "arm").agg(F.round(F.avg("f"), 9).alias("fraction"))


def output_profile(samples: DataFrame, by: list[str]) -> DataFrame:
    """Counts of what outputs look like: empty, JSON inside, decision first, decision anywhere, at least three full stops."""
    o = F.col("output")
    return samples.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(X.strip(o) != "").alias("nonempty"), F.count_if(X.json_slice(o)).alias("json_inside"), F.count_if(X.strip(o).rlike(r"\A(APPROVE|DECLINE|ESCALATE)\b")).alias("decision_first"),
        F.count_if(o.rlike(X.DECISION)).alias("decision_anywhere"), F.count_if(F.regexp_count(o, F.lit(r"\.")) >= 3).alias("three_stops"),
    )


def repeats(samples: DataFrame, by: list[str]) -> DataFrame:
    """(by..., raw, normalised, least_prefix): how far repeated answers agree."""
    first = samples.groupBy(*by).agg(F.min_by("output", F.struct("sample_idx", "line_no")).alias("first"))
    j = samples.join(first, by)
    return j.groupBy(*by).agg(F.countDistinct("output").alias("raw"), F.countDistinct(X.normalise(F.col("output"))).alias("normalised"), F.min(X.common_prefix(F.col("output"), F.col("first"))).alias("least_prefix"))


def prose_metrics(df: DataFrame, text: str, by: list[str]) -> DataFrame:
    """Per text: words, dashes per thousand words, sentences, mean words of a sentence, bold spans, ids."""
    t = F.col(text)
    words = X.word_count(t)
    sents = F.size(F.filter(F.split(t, r"(?<=[.!?])\s+"), lambda x: F.trim(x) != ""))
    return df.select(
        *by, words.alias("words"), F.round(F.coalesce(F.try_divide(F.regexp_count(t, F.lit("—")) * 1000.0, words), F.lit(0.0)), 6).alias("dashes_per_1000"), sents.alias("sentences"),
        F.round(F.coalesce(F.try_divide(words.cast("double"), sents), F.lit(0.0)), 6).alias("words_per_sentence"), F.regexp_count(t, F.lit(r"\*\*[^*\n]+\*\*")).alias("bold_spans"), F.regexp_count(t, F.lit(r"\b[A-Z]{2,4}-[0-9]{3,}\b")).alias("ids"),
    )


def tool_scores(calls: DataFrame) -> DataFrame:
    """Per model: calls, hits and their share, chains that are whole, tokens of the schema.

    ``calls``: model, wanted, called, chain_ok, schema_tokens.
    """
    return calls.groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.expr("wanted = called")).alias("hits"), F.round(F.avg((F.col("wanted") == F.col("called")).cast("double")), 9).alias("share"), F.count_if("chain_ok").alias("chains_ok"), F.max("schema_tokens").alias("schema_tokens"))
