"""Deterministic faults of outputs, and whom they touch."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from paritylens.functions import text as X
from paritylens.operators.log import failed  # noqa: F401

# Texts that faults put into an output.
REFUSAL_TEXT = "I'm sorry, but I can't help with that request."
ESCAPE_TEXT = " \\uC548\\uB155"
PREAMBLE = "Based on the information available at the time of review, "
GLYPHS = "สวัสดี"
# End of the value list.

REGIMES = ("B0", "B1", "B2", "B3")
_CHANGED = StructType([StructField("output", StringType()), StructField("activated", BooleanType())])


def cell_id(fault_class: str, name: str, severity: float, regime: str) -> str:
    return f"{fault_class}:{name}@{severity:g}/{regime}"


def in_blast(regime: str, share: float, seed: int, cell: str, input_id: Column, principal: Column | None = None) -> Column:
    """Whether a fault of that regime reaches an input: B0 and B1 all, B2 by input, B3 by principal."""
    if regime in ("B0", "B1"):
        return F.lit(True)
    if regime == "B3" and principal is None:
        raise ValueError("regime B3 needs a principal")
    key = input_id if regime == "B2" else F.when(principal.isNull(), F.raise_error(F.lit("regime B3 needs a principal"))).otherwise(principal)
    return X.uniform(F.concat_ws("|", F.lit(str(seed)), F.lit(cell), key)) < share


def _result(active: Column, changed: Column, o: Column) -> Column:
    active = F.coalesce(active, F.lit(False))
    return F.struct(F.when(active, changed).otherwise(o).alias("output"), active.alias("activated"))


def omission(o: Column, severity: float) -> Column:
    parts = F.filter(F.split(X.strip(o), r"(?<=[.!?])\s+"), lambda x: x != "")
    n = F.size(parts)
    drop = F.least(F.greatest(F.bround(n * F.lit(severity)).cast("int"), F.lit(1)), n - 1)
    return _result(n >= 2, F.array_join(F.slice(parts, 1, F.greatest(n - drop, F.lit(0))), " "), o)


def _split(o: Column) -> Column:
    return F.filter(F.split(o, r"\s+"), lambda x: x != "")


def truncation(o: Column, severity: float) -> Column:
    w = _split(o)
    keep = F.greatest(F.lit(4), F.floor(F.size(w) * F.lit(1.0 - severity)).cast("int"))
    return _result((F.size(w) >= 8) & (keep < F.size(w)), F.array_join(F.slice(w, 1, keep), " "), o)


def script_corruption(o: Column, severity: float) -> Column:
    """Foreign words at places that a hash of the output gives."""
    w = _split(o)
    n = F.greatest(F.lit(1), F.bround(F.size(w) * F.lit(severity)).cast("int"))
    at = F.array_sort(F.transform(F.sequence(F.lit(1), n), lambda i: F.pmod(F.xxhash64(o, i), (F.size(w) + 1).cast("long")).cast("int")))
    with_marks = F.flatten(F.transform(F.sequence(F.lit(0), F.size(w)), lambda p: F.concat(F.array_repeat(F.lit(GLYPHS), F.size(F.filter(at, lambda x: x == p))), F.slice(w, p + 1, 1))))
    return _result(X.strip(o) != "", F.array_join(with_marks, " "), o)


def unicode_escape(o: Column, severity: float) -> Column:
    return _result(X.strip(o) != "", F.concat(o, F.lit(ESCAPE_TEXT)), o)


def refusal(o: Column, severity: float) -> Column:
    return _result(X.strip(o) != "", F.lit(REFUSAL_TEXT), o)


def verbosity(o: Column, severity: float) -> Column:
    return _result(X.strip(o) != "", F.concat(F.lit(PREAMBLE), o), o)


def schema_break(o: Column, severity: float) -> Column:
    """A JSON object made unparseable, or without its first key."""

    @F.pandas_udf(_CHANGED)
    def run(s: pd.Series) -> pd.DataFrame:
        rows = []
        for x in s:
            try:
                value = json.loads(x.strip()) if x is not None else None
            except (ValueError, RecursionError):
                value = None
            if not isinstance(value, dict) or not value:
                rows.append((x, False))
            elif severity >= 0.75:
                rows.append((x.strip().rstrip("}") + ",}", True))
            else:
                rows.append((json.dumps({k: v for k, v in value.items() if k != min(value)}), True))
        return pd.DataFrame(rows, columns=["output", "activated"])

    return run(o)


INJECTIONS = {"omission": omission, "output_truncation": truncation, "script_corruption": script_corruption, "unicode_escape": unicode_escape, "refusal": refusal, "schema_break": schema_break, "verbosity": verbosity}


def inject(samples: DataFrame, name: str, severity: float, regime: str = "B0", share: float = 1.0, seed: int = 0, fault_class: str = "F", principal: str | None = None) -> DataFrame:
    """Samples with a fault in the outputs it reaches, and whether it changed them in ``activated``.

    Failed samples pass through.  A truncated output's finish_reason is length.
    """
    cell = cell_id(fault_class, name, severity, regime)
    reach = in_blast(regime, share, seed, cell, F.col("input_id"), F.col(principal) if principal else None) & F.col("error").isNull()
    out = samples.withColumn("__r", reach).withColumn("__c", INJECTIONS[name](F.col("output"), severity))
    out = out.withColumn("activated", F.coalesce(F.col("__r") & F.col("__c.activated"), F.lit(False))).withColumn("output", F.when(F.col("activated"), F.col("__c.output")).otherwise(F.col("output")))
    if name == "output_truncation" and "finish_reason" in samples.columns:
        out = out.withColumn("finish_reason", F.when(F.col("activated"), "length").otherwise(F.col("finish_reason")))
    return out.drop("__r", "__c")


def prompt_regression(calls: DataFrame, regime: str, share: float, seed: int, cell: str) -> DataFrame:
    """Adds activated: the input is reached, its prompt has the changed lines, it was answered and the answer is one that the lines govern."""
    return calls.withColumn("activated", in_blast(regime, share, seed, cell, F.col("input_id")) & F.col("exposed") & F.col("answered") & F.col("governed"))


def prompt_edit(lines: Column, add: list[str], remove: list[str]) -> Column:
    """Lines of a prompt without those of ``remove`` and with ``add`` after them."""
    return F.concat(F.filter(lines, lambda x: ~x.isin(remove)) if remove else lines, F.array(*(F.lit(a) for a in add)).cast("array<string>"))


#: Ceilings of the lines that an edit of each rung adds and removes.
LADDER = {1: (1, 1), 2: (2, 3), 3: (9, 23)}


@dataclass(frozen=True)
class PromptEdit:
    """A change of a prompt's lines, by how much it may grow: its rung is a third of the severity each."""

    name: str
    rung: int
    added: int
    removed: int
    apply: Callable[[Column], Column]
    evidence: str = ""

    @property
    def severity(self) -> float:
        return self.rung / 3


#: Edits by name.
PROMPT_EDITS: dict[str, PromptEdit] = {}


def register_edit(edit: PromptEdit) -> PromptEdit:
    """Add an edit to the catalogue; one that outgrows its rung, or whose name is taken, is refused."""
    most_added, most_removed = LADDER[edit.rung]
    if edit.added > most_added or edit.removed > most_removed:
        raise ValueError(f"{edit.name}: +{edit.added}/-{edit.removed} lines exceeds rung {edit.rung} (+{most_added}/-{most_removed})")
    if edit.name in PROMPT_EDITS:
        raise ValueError(f"{edit.name} is in the catalogue")
    PROMPT_EDITS[edit.name] = edit
    return edit


def edited(prompts: DataFrame, lines: str = "lines") -> DataFrame:
    """Prompts once for every edit of the catalogue: name, severity, lines, n_added, n_removed, and whether it holds its rung."""
    cells = [F.struct(F.lit(e.name).alias("name"), F.lit(e.severity).alias("severity"), e.apply(F.col(lines)).alias("after"), F.lit(LADDER[e.rung][0]).alias("a"), F.lit(LADDER[e.rung][1]).alias("r")) for e in PROMPT_EDITS.values()]
    x = prompts.withColumn("__e", F.explode(F.array(*cells)))
    gone, new = F.size(F.array_except(lines, "__e.after")), F.size(F.array_except("__e.after", lines))
    return x.select(*prompts.columns, F.col("__e.name").alias("edit"), F.col("__e.severity").alias("severity"), F.col("__e.after").alias("after"), new.alias("n_added"), gone.alias("n_removed"), ((new <= F.col("__e.a")) & (gone <= F.col("__e.r"))).alias("holds"))


def _appended(*lines: str) -> Callable[[Column], Column]:
    return lambda x: prompt_edit(x, list(lines), [])


register_edit(PromptEdit("line_injected", 1, 1, 0, _appended("Mention that the team reviews its procedures this quarter.")))
register_edit(PromptEdit("last_line_dropped", 1, 0, 1, lambda x: F.slice(x, 1, F.greatest(F.size(x) - 1, F.lit(0)))))
register_edit(PromptEdit("lines_resurrected", 2, 2, 0, _appended("Close with a note that this is provisional.", "Address the reader formally.")))
register_edit(PromptEdit("first_lines_dropped", 2, 0, 3, lambda x: F.slice(x, 4, F.greatest(F.size(x) - 3, F.lit(0)))))
