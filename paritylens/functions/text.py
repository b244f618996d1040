"""Text and JSON functions as columns.

Functions that Spark has no builtin for (NFKC, case folding, names of code
points, JSON as the recorder parses it) are Arrow-batched; plain ASCII takes a
path of builtins with the same result.
"""

from __future__ import annotations

import json
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType, StructField, StructType

# Punctuation that is written in one way.
PUNCTUATION = {"‘": "'", "’": "'", "‚": "'", "‛": "'", "“": '"', "”": '"', "„": '"', "‟": '"', "–": "-", "—": "-", "−": "-", " ": " ", "…": "..."}
# Patterns of headings, list markers and emphasis, of refusals, escapes, control characters and sentence ends.
HEADING = r"(?m)^\s*#{1,6}\s+"
MARKER = r"(?m)^\s*(?:[-*+•–—]|\d+[.)])\s+"
REFUSAL = r"\b(i (?:can(?:no|')t|am unable to|won'?t) (?:help|assist|provide|comply)|as an ai\b|i'?m sorry,? but\b)"
ESCAPE = r"\\u[0-9a-fA-F]{4}"
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f]"
TERMINATOR = r"[.!?\"')\]}…]\s*$"
DECISION = r"\b(APPROVE|DECLINE|ESCALATE)\b"
# End of the value list.

SHORT_WORDS = 45


def _plain(c: Column) -> Column:
    return c.rlike(r"\A[\t\n\r\x20-\x7E]*\z")


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"\A\s+|\s+\z", "")


def normalise_text_py(text: str) -> str:
    t = unicodedata.normalize("NFKC", text)
    for a, b in PUNCTUATION.items():
        t = t.replace(a, b)
    for pattern, by in ((HEADING, ""), (MARKER, ""), (r"[*_`]", ""), (r"[ \t]+", " "), (r"\n{2,}", "\n")):
        t = re.sub(pattern, by, t)
    return "\n".join(x for x in (line.strip() for line in t.split("\n")) if x).strip()


def normalise_json_py(text: str) -> str | None:
    try:
        return json.dumps(json.loads(text), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    except (ValueError, TypeError, RecursionError):
        return None


def dedup_key_py(text: str) -> str:
    t = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).casefold()
    return re.sub(r"^[^\w]+|[^\w]+$", "", re.sub(r"\s+", " ", t).strip())


def _mapped(fn, kind):
    @F.pandas_udf(kind)
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else fn(x))

    return run


_text_udf = _mapped(normalise_text_py, StringType())
_json_udf = _mapped(normalise_json_py, StringType())
_key_udf = _mapped(dedup_key_py, StringType())


def _json_facts(text: str) -> tuple:
    try:
        v = json.loads(text)
    except (ValueError, TypeError, RecursionError):
        return (False, False, None, None, None)
    if not isinstance(v, dict):
        return (True, False, None, None, None)
    return (True, True, list(v), [type(x).__name__ for x in v.values()], [str(x) for x in v.values()])


_JSON = StructType([StructField("valid", BooleanType()), StructField("object", BooleanType()), StructField("keys", ArrayType(StringType())), StructField("types", ArrayType(StringType())), StructField("values", ArrayType(StringType()))])


@F.pandas_udf(_JSON)
def _json_facts_udf(s: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([(None,) * 5 if x is None else _json_facts(x) for x in s], columns=_JSON.names)


def script_families_py(text: str) -> list[str]:
    return sorted({(unicodedata.name(c, "UNKNOWN").split() or ["UNKNOWN"])[0] for c in set(text) if c.isalpha()})


_scripts_udf = _mapped(script_families_py, ArrayType(StringType()))


def scripts(c: Column) -> Column:
    """Families of writing in a text; plain ASCII needs no lookup of names."""
    return F.when(_plain(c), F.when(c.rlike("[A-Za-z]"), F.array(F.lit("LATIN"))).otherwise(F.array().cast("array<string>"))).otherwise(_scripts_udf(F.when(~_plain(c), c)))


def maybe_json(c: Column) -> Column:
    """False where a text can't be a JSON value by its first character."""
    return c.rlike(r'\A\s*[{\["tfnNI\d-]')


def json_facts(c: Column) -> Column:
    """STRUCT<valid, object, keys, types, values> of a text as JSON, parsed once; texts that can't be JSON cross no boundary."""
    none = F.struct(F.lit(False).alias("valid"), F.lit(False).alias("object"), *(F.lit(None).cast("array<string>").alias(x) for x in ("keys", "types", "values")))
    return F.when(maybe_json(c), _json_facts_udf(F.when(maybe_json(c), c))).otherwise(none)


def normalise_text(c: Column) -> Column:
    """Layout and punctuation in one form: no headings, list markers, emphasis, blank lines.

    The builtins serve plain ASCII, which has none of the punctuation to be replaced.
    """
    t = c
    for pattern, by in ((HEADING, ""), (MARKER, ""), (r"[*_`]", ""), (r"[ \t]+", " "), (r"(?m)^[ \t\r]+|[ \t\r]+$", ""), (r"\n{2,}", "\n"), (r"\A\s+|\s+\z", "")):
        t = F.regexp_replace(t, pattern, by)
    return F.when(_plain(c), t).otherwise(_text_udf(F.when(~_plain(c), c)))


def normalise(c: Column) -> Column:
    """JSON with sorted keys and no layout where it parses, else normalise_text."""
    s = strip(c)
    looks = s.rlike(r"\A[{\[]") | (s == "")
    return F.coalesce(_json_udf(F.when(looks & (s != ""), s)), normalise_text(s))


def sentences(c: Column) -> Column:
    return F.filter(F.split(normalise_text(c), r"(?<=[.!?])\s+"), lambda x: x != "")


def dedup_key(c: Column) -> Column:
    """Without case, accents, layout and punctuation at the ends."""
    plain = F.regexp_replace(F.trim(F.regexp_replace(F.lower(c), r"\s+", " ")), r"\A[^A-Za-z0-9_]+|[^A-Za-z0-9_]+\z", "")
    return F.when(_plain(c), plain).otherwise(_key_udf(F.when(~_plain(c), c)))


def word_tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(normalise_text(c)), F.lit(r"(?U)(\w+)"), F.lit(1))


def word_count(c: Column) -> Column:
    return F.size(F.filter(F.split(c, r"(?U)\s+"), lambda x: x != ""))


def line_count(c: Column) -> Column:
    """Lines; a line end at the end of the text begins no further one."""
    parts = F.split(c, "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]", -1)
    return F.when(c == "", 0).otherwise(F.size(parts) - F.when(F.element_at(parts, -1) == "", 1).otherwise(0))


def shape(c: Column) -> Column:
    """json, list, short or prose, by structure alone."""
    s = strip(c)
    return (
        F.when(s == "", "short").when(json_facts(s)["valid"], "json").when(F.regexp_count(s, F.lit(MARKER)) >= 2, "list").when(word_count(s) <= SHORT_WORDS, "short").otherwise("prose")
    )


def refuses(c: Column) -> Column:
    return c.rlike("(?i)" + REFUSAL)


def has_escape(c: Column) -> Column:
    return c.rlike(ESCAPE)


def has_control(c: Column) -> Column:
    return c.rlike(CONTROL)


def terminated(c: Column) -> Column:
    s = F.regexp_replace(c, r"\s+\z", "")
    return (s != "") & s.rlike(TERMINATOR)


def decision(c: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(c, DECISION, 1), F.lit("")), F.lit("NONE"))


def without_thinking(c: Column) -> Column:
    """What follows the last </think>."""
    return F.when(c.contains("</think>"), F.regexp_replace(F.regexp_replace(c, r"(?s)\A.*</think>", ""), r"\A\s+", "")).otherwise(c)


def json_slice(c: Column) -> Column:
    """Whether the text from the first { to the last } is a JSON object."""
    part = F.regexp_extract(c, r"(?s)(\{.*\})", 1)
    return F.coalesce(json_facts(F.when(part != "", part))["object"], F.lit(False))


def stable_hash(*parts: Column) -> Column:
    """First 8 bytes of the SHA-256 of the parts joined by |, as an unsigned number."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 16), 16, 10).cast("decimal(20,0)")


def uniform(key: Column) -> Column:
    """A number in [0, 1] from the first 4 bytes of a SHA-256."""
    return F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double") / F.lit(4294967295.0)


def short_id(c: Column) -> Column:
    parts = F.split(c, "-")
    return F.concat_ws("-", F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), 2))


def names_model(c: Column, names: list[str]) -> Column:
    """Whether a text gives away a model's name."""
    return c.rlike("(?i)" + "|".join(re.escape(n) for n in names))


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the common prefix of two texts."""
    n = F.least(F.length(a), F.length(b))
    differs = F.filter(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")), lambda i: F.substr(a, i, F.lit(1)) != F.substr(b, i, F.lit(1)))
    return F.coalesce(F.try_element_at(differs, F.lit(1)) - 1, n)


FUNCTIONS = {"pl_normalise_text": _text_udf, "pl_normalise_json": _json_udf, "pl_dedup_key": _key_udf, "pl_script_families": _scripts_udf}


def register(spark) -> None:
    """The functions without a builtin, for SQL text."""
    for name, fn in FUNCTIONS.items():
        spark.udf.register(name, fn)
