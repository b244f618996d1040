"""Rules mined from the baseline and checked against the candidate.

Outputs are collapsed to distinct texts with counts before anything is parsed,
every text is parsed once, and all rules are evaluated in one pass over the
distinct texts.  Rules are rows; nothing is collected.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paritylens.functions import text as X
from paritylens.session import cut_lineage

HARD, BAND, ENUM_MOST = 0.99, 0.60, 6
#: Rules in the order they are proposed.
KINDS = ["nonempty", "no_control_chars", "no_unicode_escape", "no_refusal_marker", "ends_with_terminator", "word_count_range", "line_count_range", "script_subset", "parses_json", "json_key_present", "json_key_type", "json_enum"]


def profile(pools: DataFrame, by: list[str]) -> DataFrame:
    """(by..., arm, output, n, pos, facts...) of distinct outputs; ``pos`` is the first place in the pool.

    ``pools``: by..., arm (A, A_prime or B), output and pos.
    """
    d = pools.groupBy(*by, "arm", "output").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("pos"))
    o = F.col("output")
    return d.select(
        "*", X.word_count(o).alias("words"), X.line_count(o).alias("lines"), X.scripts(o).alias("scripts"), X.json_facts(o).alias("json"),
        (X.strip(o) != "").alias("nonempty"), (~X.has_control(o)).alias("no_control_chars"), (~X.has_escape(o)).alias("no_unicode_escape"), (~X.refuses(o)).alias("no_refusal_marker"), X.terminated(o).alias("ends_with_terminator"),
    )


def candidates(profiled: DataFrame, by: list[str]) -> DataFrame:
    """(by..., kind, key, lo, hi, allowed): rules that the baseline's outputs propose."""
    a = profiled.where("arm = 'A'")
    obj = F.col("json.object")
    total = a.groupBy(*by).agg(
        F.min("words").alias("w0"), F.max("words").alias("w1"), F.min("lines").alias("l0"), F.max("lines").alias("l1"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("scripts")))).alias("scripts"), F.count_if(obj).alias("objects"),
    )
    none, no = F.lit(None).cast("long"), F.lit(None).cast("array<string>")
    rule = lambda kind, key=None, lo=none, hi=none, allowed=no: F.struct(F.lit(kind).alias("kind"), F.lit(key).cast("string").alias("key"), lo.cast("long").alias("lo"), hi.cast("long").alias("hi"), allowed.alias("allowed"))
    fixed = F.array(*(rule(k) for k in KINDS[:5]), rule("word_count_range", lo=F.col("w0"), hi=F.col("w1")), rule("line_count_range", lo=F.col("l0"), hi=F.col("l1")))
    more = F.concat(fixed, F.when(F.size("scripts") > 0, F.array(rule("script_subset", allowed=F.col("scripts")))).otherwise(F.array().cast(fixed_type(fixed, total))), F.when(F.col("objects") > 0, F.array(rule("parses_json"))).otherwise(F.array().cast(fixed_type(fixed, total))))
    general = total.select(*by, F.explode(more).alias("r")).select(*by, "r.*")
    # Keys of objects; a key makes rules if every object has it.
    pairs = a.where(obj).select(*by, F.explode(F.arrays_zip("json.keys", "json.types", "json.values")).alias("p")).select(*by, F.col("p.keys").alias("key"), F.col("p.types").alias("type"), F.col("p.values").alias("value"))
    keys = pairs.groupBy(*by, "key").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("type").alias("types"), F.min("type").alias("type"), F.countDistinct("value").alias("values"))
    keys = keys.join(total.select(*by, "objects"), by).where("n = objects")
    few = pairs.join(keys.where(f"values > 1 and values <= {ENUM_MOST}").select(*by, "key"), [*by, "key"], "left_semi").groupBy(*by, "key").agg(F.array_sort(F.collect_set("value")).alias("allowed"))
    shape = lambda df, kind, allowed: df.select(*by, F.lit(kind).alias("kind"), "key", none.alias("lo"), none.alias("hi"), allowed.alias("allowed"))
    found = general.unionByName(shape(keys, "json_key_present", no)).unionByName(shape(keys.where("types = 1"), "json_key_type", F.array("type"))).unionByName(shape(few, "json_enum", F.col("allowed")))
    for propose in PROPOSALS:
        found = found.unionByName(propose(profiled, by))
    return found


def fixed_type(column: Column, df: DataFrame) -> str:
    return df.select(column.alias("x")).schema["x"].dataType.simpleString()


#: Kinds of rules by name: a column expression of the profiled output and the rule; the order is that of proposal.
HOLDS: dict[str, Callable[[Column], Column]] = {}
#: Further proposals of rules: (profiled, by) -> (by..., kind, key, lo, hi, allowed).
PROPOSALS: list[Callable[[DataFrame, list[str]], DataFrame]] = []


def rule(kind: str, propose: Callable[[DataFrame, list[str]], DataFrame] | None = None) -> Callable:
    """Register how a kind of rule is checked and, for a kind of the caller's own, what proposes it.

    The function gets the rule as STRUCT<kind, key, lo, hi, allowed> and makes
    a boolean column of it and the columns of ``profile``.
    """

    def register(holds: Callable[[Column], Column]) -> Callable[[Column], Column]:
        HOLDS[kind] = holds
        if kind not in KINDS:
            KINDS.append(kind)
        if propose is not None:
            PROPOSALS.append(propose)
        return holds

    return register


def unregister(kind: str, propose: Callable | None = None) -> None:
    """Take a kind of the caller's own out again."""
    HOLDS.pop(kind)
    KINDS.remove(kind)
    if propose is not None:
        PROPOSALS.remove(propose)


def _place(r: Column) -> Column:
    """Where the key of a rule stands among the names of an object; 0 for nowhere."""
    return F.array_position(F.coalesce(F.col("json.keys"), F.array().cast("array<string>")), r["key"])


def _at_key(r: Column, what: str) -> Column:
    return F.when(_place(r) > 0, F.try_element_at(F.col(f"json.{what}"), _place(r).cast("int")))


for _plain in KINDS[:5]:
    rule(_plain)(lambda r, c=_plain: F.col(c))
rule("word_count_range")(lambda r: F.col("words").between(r["lo"], r["hi"]))
rule("line_count_range")(lambda r: F.col("lines").between(r["lo"], r["hi"]))
rule("script_subset")(lambda r: F.size(F.array_except("scripts", r["allowed"])) == 0)
rule("parses_json")(lambda r: F.col("json.valid"))
rule("json_key_present")(lambda r: F.col("json.object") & (_place(r) > 0))
rule("json_key_type")(lambda r: F.col("json.object") & F.array_contains(r["allowed"], _at_key(r, "types")))
rule("json_enum")(lambda r: F.col("json.object") & F.array_contains(r["allowed"], _at_key(r, "values")))


def _holds(r: Column) -> Column:
    """Whether a profiled output keeps rule ``r``: one expression over all registered kinds."""
    out = F.when(F.lit(False), F.lit(False))
    for kind, holds in HOLDS.items():
        out = out.when(r["kind"] == kind, holds(r))
    return F.coalesce(out, F.lit(False))


RULE = ["kind", "key", "lo", "hi", "allowed"]


def induce(profiled: DataFrame, by: list[str]) -> DataFrame:
    """(by..., rule..., s_base, s_decoy, tier, pruned): support in A and A', and what it makes of the rule.

    A rule is hard at HARD in both, band at BAND, else discarded; it is pruned
    if A alone makes it hard.
    """
    rules = candidates(profiled, by)
    # At most a few dozen rules of a recording; the written table has a known size, so the planner broadcasts it while it is small.
    packed = cut_lineage(rules.groupBy(*by).agg(F.collect_list(F.struct(*RULE)).alias("rules")))
    seen = profiled.where("arm in ('A', 'A_prime')").join(packed, by)
    kept = seen.select(*by, "arm", "n", F.explode(F.transform("rules", lambda r: F.struct(*(r[c].alias(c) for c in RULE), _holds(r).alias("ok")))).alias("r"))
    flat = kept.select(*by, "arm", "n", "r.*")
    support = lambda arm: F.coalesce(F.try_divide(F.sum(F.when((F.col("arm") == arm) & F.col("ok"), F.col("n")).otherwise(0)).cast("double"), F.sum(F.when(F.col("arm") == arm, F.col("n")).otherwise(0))), F.lit(0.0))
    s = flat.groupBy(*by, *RULE).agg(support("A").alias("s_base"), support("A_prime").alias("s_decoy"))
    least = F.least("s_base", "s_decoy")
    return s.withColumn("tier", F.when(least >= HARD, "hard").when(least >= BAND, "band").otherwise("discarded")).withColumn("pruned", (F.col("s_base") >= HARD) & (F.col("s_decoy") < HARD))


def in_order(broken: DataFrame) -> DataFrame:
    """Violations as a report lists them: by falling rate, then in the order of proposal."""
    return broken.orderBy(F.col("rate").desc(), "rule_ord", "key")


def violations(profiled: DataFrame, contract: DataFrame, by: list[str]) -> DataFrame:
    """(by..., kind, key, n_total, n_violating, rate, examples) of hard rules that outputs of B break.

    Examples are the first three in pool order, cut to 160 characters; rows in
    order of rate, then of proposal, by ``rule_ord``.
    """
    hard = cut_lineage(contract.where("tier = 'hard'").groupBy(*by).agg(F.collect_list(F.struct(*RULE)).alias("rules")))
    b = profiled.where("arm = 'B'").join(hard, by)
    flat = b.select(*by, "output", "n", "pos", F.explode(F.transform("rules", lambda r: F.struct(r["kind"].alias("kind"), r["key"].alias("key"), _holds(r).alias("ok")))).alias("r")).select(*by, "output", "n", "pos", "r.*")
    counts = flat.groupBy(*by, "kind", "key").agg(F.sum("n").alias("n_total"), F.sum(F.when(~F.col("ok"), F.col("n")).otherwise(0)).alias("n_violating")).where("n_violating > 0")
    first = flat.where("not ok").select(*by, "output", "pos", "kind", "key").withColumn("r", F.row_number().over(Window.partitionBy(*by, "kind", "key").orderBy("pos", "output"))).where("r <= 3")
    examples = first.groupBy(*by, "kind", "key").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", F.substring("output", 1, 160).alias("o")))), lambda x: x["o"]).alias("examples"))
    null_safe = [counts[c].eqNullSafe(examples[c]) for c in [*by, "kind", "key"]]
    order = F.array_position(F.array(*(F.lit(k) for k in KINDS)), F.col("kind"))
    return counts.join(examples, null_safe).select(*(counts[c] for c in [*by, "kind", "key"]), "n_total", "n_violating", (F.col("n_violating") / F.col("n_total")).alias("rate"), "examples").withColumn("rule_ord", order)
