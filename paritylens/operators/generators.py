"""Recordings made by rule: behaviours, their perturbations, stub arms, and simulations of the estimator."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paritylens.functions.text import uniform
from paritylens.operators import simulation
from paritylens.schemas import TRIO


def _least(probs: Column) -> Column:
    return F.array_position(probs, F.array_min(probs))


def move_share(probs: Column, strength: float) -> Column:
    """Every mode gives ``strength`` of its share to the least likely one, the first of equal ones."""
    at = _least(probs)
    given = F.aggregate(probs, F.lit(0.0), lambda a, p: a + p * F.lit(strength)) - F.element_at(probs, at.cast("int")) * F.lit(strength)
    return F.transform(probs, lambda p, i: F.when(i + 1 == at, p + given).otherwise(p * F.lit(1 - strength)))


def add_mode(probs: Column, strength: float) -> Column:
    """Shares scaled down and a new mode with ``strength`` behind them."""
    return F.concat(F.transform(probs, lambda p: p * F.lit(1 - strength)), F.array(F.lit(float(strength))))


def collapse(probs: Column, strength: float) -> Column:
    """Every mode gives ``strength`` of its share to the likeliest."""
    at = F.array_position(probs, F.array_max(probs))
    given = F.aggregate(probs, F.lit(0.0), lambda a, p: a + p * F.lit(strength)) - F.array_max(probs) * F.lit(strength)
    return F.transform(probs, lambda p, i: F.when(i + 1 == at, p + given).otherwise(p * F.lit(1 - strength)))


def draw(modes: Column, probs: Column, u: Column) -> Column:
    """The mode at which the running share first exceeds ``u``."""
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("at"))
    at = F.aggregate(probs, start, lambda a, p: F.struct((a["sum"] + p).alias("sum"), (a["at"] + F.when(a["sum"] + p <= u, 1).otherwise(0)).alias("at")))["at"]
    return F.element_at(modes, F.least(at + 1, F.size(modes)))


#: Seeds of the arms, apart from each other.
ARM_SEEDS = {"A": 0, "A_prime": 1_000_003, "B": 2_000_003}


def stub_recording(behaviours: DataFrame, k: int, seed: int = 0, roster: tuple[str, ...] = TRIO) -> DataFrame:
    """(input_id, arm, sample_idx, ord, output): k draws per input and arm.

    ``behaviours``: input_id, modes, probs and probs_b, the candidate's.
    Draws are hashes of seed, arm, input and number, so any partitioning
    gives the same recording.
    """
    arms = F.explode(F.array(*(F.struct(F.lit(a).alias("arm"), F.lit(i).alias("pos"), F.lit(seed + ARM_SEEDS.get(a, 3_000_017 + i)).alias("arm_seed")) for i, a in enumerate(roster))))
    calls = behaviours.withColumn("a", arms).withColumn("sample_idx", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    u = uniform(F.concat_ws("|", F.col("a.arm_seed").cast("string"), "input_id", F.col("sample_idx").cast("string")))
    out = draw(F.col("modes"), F.when(F.col("a.arm") == "B", F.col("probs_b")).otherwise(F.col("probs")), u)
    return calls.select("input_id", F.col("a.arm").alias("arm"), "sample_idx", (F.col("sample_idx") * len(roster) + F.pmod(F.col("a.pos") - F.col("sample_idx"), F.lit(len(roster)))).cast("long").alias("ord"), out.alias("output"))


def invoke(invocations: DataFrame, system, schema: str) -> DataFrame:
    """Answers of a system under test: ``system(pandas frame) -> pandas frame``, called with batches of invocations."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield system(b)

    return invocations.mapInPandas(run, schema)


def with_jitter(samples: DataFrame, share: float, seed: int = 0, output: str = "output") -> DataFrame:
    """Outputs whose layout, and nothing else, changes with chance ``share``: a blank line, a bullet or another end."""
    key = lambda what: F.concat_ws("|", F.lit(f"{what}{seed}"), "arm", "input_id", F.col("sample_idx").cast("string"))
    o = F.col(output)
    kind = F.floor(uniform(key("kind")) * 2.9999)
    other = F.when(kind == 0, F.concat(o, F.lit("\n"))).when(kind == 1, F.concat(F.lit("- "), o)).otherwise(F.concat(F.lit("**"), o, F.lit("**")))
    return samples.withColumn(output, F.when(uniform(key("jitter")) < share, other).otherwise(o))


def sticky(behaviours: DataFrame, principals: list[str]) -> DataFrame:
    """Behaviours (input_id, principal, modes, probs, probs_b) whose change reaches only some principals; a missing principal is refused."""
    who = F.when(F.col("principal").isNull(), F.raise_error(F.lit("a sticky change needs a principal"))).otherwise(F.col("principal"))
    return behaviours.withColumn("probs_b", F.when(who.isin(principals), F.col("probs_b")).otherwise(F.col("probs")))


def _pick(options: list, key: Column) -> Column:
    """One of the options, by a hash."""
    every = F.array(*(F.lit(x) for x in options))
    return F.element_at(every, (F.floor(uniform(key) * F.lit(len(options) - 1e-6)) + 1).cast("int"))


def pack(spark: SparkSession, vocabulary: dict, n: int = 24, seed: int = 0) -> dict[str, DataFrame]:
    """Dimension tables of an invented domain: principals, entities, events, documents and cases, of any size.

    ``vocabulary``: names, statuses, products, kinds of documents, and the
    prefixes of ids.  Values are hashes of seed and id; ids are numbers, so
    the tables are made where they are used.
    """
    v = vocabulary
    key = lambda what, *c: F.concat_ws("|", F.lit(f"{seed}/{what}"), *c)
    n_owners = max(4, n // 3)
    number = lambda what, low, high, *c: (F.lit(low) + F.floor(uniform(key(what, *c)) * F.lit(high - low + 0.999999))).cast("int")
    owners = spark.range(n_owners).select(F.concat(F.lit(v["principal"] + "-"), (F.col("id") + 100).cast("string")).alias("id"), F.element_at(F.array(*(F.lit(x) for x in v["names"])), (F.col("id") % len(v["names"]) + 1).cast("int")).alias("name"))
    owners = owners.select("*", (number("income", 28, 96, "id") * 1000).alias("annual_income"), (number("debt", 0, 27, "id") * 1000).alias("existing_debt"), number("years", 1, 12, "id").alias("years_on_record"))
    entities = spark.range(n).select(
        F.concat(F.lit(v["entity"] + "-"), (F.col("id") * 7 + 4000).cast("string")).alias("id"), F.concat(F.lit(v["principal"] + "-"), (F.col("id") % n_owners + 100).cast("string")).alias("principal_id"), F.col("id").alias("ordinal"),
    )
    entities = entities.select("*", _pick(v["statuses"], key("status", "id")).alias("status"), _pick(v["products"], key("product", "id")).alias("product"), number("quantity", 1, 180, "id").alias("quantity"))
    events = entities.select(F.col("id").alias("entity_id"), F.explode(F.sequence(F.lit(0), number("events", 2, 5, "id") - 1)).alias("ordinal"))
    events = events.withColumn("id", F.concat_ws("-E", "entity_id", F.col("ordinal").cast("string"))).select("id", "entity_id", "ordinal", (number("amount", 4, 6700, "id") * 10).alias("amount"), F.date_add(F.lit("2026-01-01").cast("date"), number("day", 0, 270, "id")).alias("date"))
    documents = spark.range(max(6, n // 2)).select(F.concat(F.lit("DOC-"), (F.col("id") * 3 + 5500).cast("string")).alias("id"))
    documents = documents.select("id", _pick(v["documents"], key("kind", "id")).alias("kind"), (uniform(key("valid", "id")) > 0.3).alias("valid"))
    cases = spark.range(max(4, n // 4)).select(F.concat(F.lit("CS-"), (F.col("id") * 11 + 200).cast("string")).alias("id"), F.lit("open").alias("state"))
    return {"principals": owners, "entities": entities, "events": events, "documents": documents, "cases": cases}


def corpus(spark: SparkSession, templates: list[tuple[str, str]], tables: dict[str, list[str]], n: int, tag: str, users: int = 0, seed: int = 0) -> DataFrame:
    """(input_id, kind, text, principal): n requests, templates in turn, every name in braces filled from its list in turn.

    ``tables``: what a name may stand for, by name; ``amount`` is drawn by a hash.
    """
    rows = spark.range(n)
    at = lambda size: (F.col("id") % size + 1).cast("int")
    pairs = F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(t).alias("text")) for k, t in templates))
    text = F.col("t.text")
    for name, options in {**tables, "amount": None}.items():
        if options is None:
            value = _pick(["100", "1000", "5000"], F.concat_ws("|", F.lit(f"{seed}/amount"), F.col("id").cast("string")))
        else:
            value = F.element_at(F.array(*(F.lit(x) for x in options)), at(len(options)))
        text = F.replace(text, F.lit("{" + name + "}"), value)
    rows = rows.withColumn("t", F.element_at(pairs, at(len(templates))))
    who = F.concat(F.lit("user"), (F.col("id") % users).cast("string")) if users else F.lit(None).cast("string")
    return rows.select(F.concat_ws("-", F.lit(tag), "t.kind", F.format_string("%03d", "id")).alias("input_id"), F.col("t.kind").alias("kind"), text.alias("text"), who.alias("principal"))


def factorial(seeds: DataFrame, shapes: dict[str, str], edits: dict[str, tuple[str, dict[str, Column]]]) -> DataFrame:
    """(seed_id, shape, category, relation, a, b): every seed in every shape with every edit.

    ``seeds``: seed_id and the fields that a shape names in braces.  ``edits``:
    category -> (relation, fields with what they become).  Seeds, shapes and
    edits are lists that people write; their product stays one.
    """
    fields = [c for c in seeds.columns if c != "seed_id"]

    def filled(template: str, values: dict[str, Column]) -> Column:
        out = F.lit(template)
        for name in fields:
            out = F.replace(out, F.lit("{" + name + "}"), values.get(name, F.col(name)).cast("string"))
        return out

    cells = [
        F.struct(F.lit(s).alias("shape"), F.lit(c).alias("category"), F.lit(relation).alias("relation"), filled(t, {}).alias("a"), filled(t, changed).alias("b"))
        for s, t in shapes.items()
        for c, (relation, changed) in edits.items()
    ]
    return seeds.select("seed_id", F.explode(F.array(*cells)).alias("x")).select("seed_id", "x.*")


def null_designs(spark: SparkSession, reps: int, n: int = 40, k: int = 20, q: float = 0.10, rho: float = 0.0, seed: int = 0) -> DataFrame:
    """(rep, flagged, false_flagged, realised) of the plain rule where nothing changed, or where a shock moved a share ``rho`` of the inputs."""
    changed = int(round(n * rho))
    kind = ("shock", changed, 1.0, 5) if changed else ("mixture", 0, 0.0, 4)
    found = simulation.cells(spark, [(0, kind[0], k, kind[1], kind[2], 0.0, "none", 1, kind[3])], reps, n, q, seed).where("rule = 'single'")
    return found.select("rep", F.col("n_flagged").alias("flagged"), F.col("n_false").alias("false_flagged"), (F.col("n_false") > 0).cast("double").alias("realised"))
