"""Problem 5: texts that stop before their own end.

A stack automaton over the brackets and quotes of every text that begins as
JSON notes what it leaves open; of every text it is noted whether it breaks
off in an escape or a broken character and whether it has a terminator, an open
bracket or an open code fence.  Prose and lists need no terminator everywhere,
so an open last line is judged against baselines counted over all records: how lines of that
shape usually go on, which values and word endings complete list items have,
and at which size the records of a source pile up.

All of it is made of builtin expressions.  Python only folds the few texts
that hold characters other than those of the stable class of problem 2.
"""

from __future__ import annotations

import functools
import sys
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from paritylens.llm.consistent import is_consistent
from paritylens.llm.lookalikes import LOOKALIKES
from paritylens.session import cut_lineage, spread

#: Words up to which the shape of an open last line is compared with others.
SHAPE_WORDS = 8
#: Records that end in a shape before it is a usual ending; a line cut inside a word has a shape of its own.
LEAST_ENDS = 3
#: A size is a limit of its source if this many records, and this share of the source's, have exactly that size, most of them open, and none is larger.
LIMIT_RECORDS, LIMIT_SHARE = 5, 0.02
#: Least shares among complete list items for a form of value, two and three last letters.
VALUE_SHARE, ENDING_SHARE, RARE_ENDING_SHARE = 0.005, 0.0003, 0.00005

# Reasons that report a limit.
LIMIT_REASONS = ["length", "max_tokens", "max_length", "token_limit"]

_BLANKS = " \t\n\r\x0b\x0c"
_JSON = r"\A(?:\{\s*(?:[\"}]|\z)|\[\s*(?:[\[{\"\]\d-]|\z))"
_CLOSERS = "\"'”’»)]}*_`"
_TERMINATORS = [".", "!", "?", "。", "！", "？"]
_ITEM = r"\A\s*[-*•–+]\s*"
_NAMED = r"\A\p{L}+\s*:\s*"
_ESCAPE = r"\\(?:u[0-9a-fA-F]{0,3}|x[0-9a-fA-F]?)?\z"
_CODE = r"(?<![\p{L}\p{N}_])[A-Za-z]{1,4}-?\p{Nd}[\p{Nd}/-]*(?:(?<=\p{Nd})(?![\p{L}\p{N}_])|(?<=[/-])(?=[\p{L}\p{N}_]))"
_EDGE = "\"'“”.,:;!?()[]*_`-"
_VALUE_EDGE = "\"'“”.,;!?()*_"


@functools.cache
def _without_ink() -> dict[int, None]:
    return {o: None for o in range(sys.maxunicode + 1) if unicodedata.category(chr(o)) == "Cf"}


@F.pandas_udf(StringType())
def _fold(texts: pd.Series) -> pd.Series:
    """Compatibility forms and look-alikes as plain letters, characters without ink left out; three C calls a text."""
    gone, looks = _without_ink(), str.maketrans(LOOKALIKES)
    return texts.map(lambda x: x if x is None else unicodedata.normalize("NFKC", x.translate(gone)).translate(looks))


def json_open(body: Column) -> Column:
    """Whether a text that begins as a JSON object or array leaves it open; null if it does not begin so.

    Escaped characters and whole strings are taken out, the brackets that
    remain run through a stack; brackets that never matched are no JSON.
    """
    rest = F.regexp_replace(F.regexp_replace(body, r"(?s)\\.", ""), r'"[^"]*"', "")
    brackets = F.regexp_replace(F.substring_index(rest, '"', 1), r"[^{}\[\]]+", "")

    def step(stack: Column, c: Column) -> Column:
        top = F.right(stack, F.lit(1))
        matched = ((c == "}") & (top == "{")) | ((c == "]") & (top == "["))
        return F.when(c.isin("{", "["), F.concat(stack, c)).when(matched, F.substring(stack, F.lit(1), F.length(stack) - 1)).when(c == "", stack)

    stack = F.aggregate(F.split(brackets, ""), F.lit(""), step)
    return F.when(body.rlike(_JSON), F.when(stack.isNotNull(), (stack != "") | rest.contains('"')))


def _tokens(pieces: Column, edge: str) -> Column:
    """Pieces between blanks without the given characters at their edges."""
    return F.filter(F.transform(pieces, lambda w: F.trim(w, F.lit(edge))), lambda w: w != "")


def _mask(word: Column) -> Column:
    """Numbers as 9, names as N, other words in lower case."""
    return F.when(word.rlike(r"\A\p{Nd}[\p{Nd}./-]*\z"), "9").when(word.rlike(r"\A[\p{L}&&[^a-zß-ÿ]][\p{L}&&[^A-ZÀ-Þ]]+\z"), "N").otherwise(F.lower(word))


def _value(text: Column) -> Column:
    """Shape of a value: numbers as 9, letter codes with their digits counted, names as N."""
    one = lambda w: (
        F.when(w.rlike(r"\A[A-Za-z]\p{Nd}*\z"), F.concat(F.lit("A"), (F.length(w) - 1).cast("string"))).when(w.rlike(r"\A\p{Nd}+\z"), "9").when(w.rlike(r"\A\p{L}"), "N").otherwise("?")
    )
    return F.array_join(F.transform(_tokens(F.split(text, r"\s+"), _VALUE_EDGE), one), " ")


def _ending(text: Column) -> Column:
    """The last three letters of the last word; empty if there is none of two letters."""
    return F.lower(F.right(F.regexp_extract(text, r"(\p{L}{2,})[^\p{L}\p{N}_]*\z", 1), F.lit(3)))


def _closed(line: Column) -> Column:
    """Whether a line has a terminator, behind which only quotes and brackets close."""
    return F.right(F.rtrim(line, F.lit(_CLOSERS)), F.lit(1)).isin(_TERMINATORS)


def _left_open(line: Column) -> Column:
    """Whether a line opens a round, square or curly bracket or a quote with a direction and never closes it."""
    marks = F.regexp_replace(line, r"[^()\[\]{}«»“”]+", "")
    # Innermost pairs go first; what opens in the rest stays open.
    for _ in range(3):
        marks = F.regexp_replace(marks, r"\(\)|\[\]|\{\}|«»|“”", "")
    return F.when(line.rlike(r"[(\[{«“]"), marks.rlike(r"[(\[{«“][^)\]}»”]*\z")).otherwise(F.lit(False))


def with_facts(rows: DataFrame, text: str) -> DataFrame:
    """``rows`` with what the automaton notes of each text, which is dropped.

    json_open (null: no JSON), broken, closed, signed, place, shape (null:
    longer than SHAPE_WORDS), starts (shorter shapes that the last line goes on
    from), value (of the last of a list of named values; '' if it lacks one),
    ending, values and endings (of the lines before), n_chars, n_bytes.
    """
    x = F.col(text)
    stable = is_consistent(x)
    # Each select uses the columns of the one before, so none is computed twice.
    rows = rows.withColumn("__odd", F.when(~stable, x)).withColumn("__fold", F.coalesce(_fold(F.col("__odd")), x)).drop("__odd")
    rows = rows.withColumn("__body", F.rtrim(F.col("__fold"), F.lit(_BLANKS)))
    rows = rows.withColumn("__lines", F.split("__body", "\n"))
    rows = rows.withColumns({"__tail": F.element_at("__lines", -1), "__before": F.filter(F.slice("__lines", 1, F.size("__lines") - 1), lambda y: F.trim(y) != "")})
    rows = rows.withColumn("__last", F.trim(F.col("__tail"), F.lit(_BLANKS)))
    coded = F.when(F.col("__last").rlike(r"\p{Nd}"), F.regexp_replace("__last", _CODE, "9")).otherwise(F.col("__last"))
    rows = rows.withColumns({"__pieces": F.split(coded, r"\s+"), "__items": F.when(F.col("__tail").rlike(_ITEM) & (F.size("__before") > 0), F.filter("__lines", lambda y: y.rlike(_ITEM)))})
    # More words than a shape has are only counted where the first pieces are too few.
    rows = rows.withColumn("__words", _tokens(F.slice("__pieces", 1, 3 * SHAPE_WORDS), _EDGE))
    few = (F.size("__words") <= SHAPE_WORDS) & (F.size("__pieces") > 3 * SHAPE_WORDS)
    rows = rows.withColumn("__words", F.when(few, _tokens(F.col("__pieces"), _EDGE)).otherwise(F.col("__words")))
    rows = rows.withColumns({
        "__n": F.size("__words"),
        "__masked": F.transform(F.slice("__words", 1, SHAPE_WORDS + 1), _mask),
        "__items": F.transform("__items", lambda y: F.regexp_replace(y, _ITEM, "")),
    })
    value_of = lambda y: F.regexp_replace(y, _NAMED, "")
    is_named = lambda y: y.rlike(_NAMED)
    rows = rows.withColumns({"__mine": F.element_at("__items", -1).rlike(_NAMED), "__others": F.filter(F.slice("__items", 1, F.greatest(F.size("__items") - 1, F.lit(0))), is_named)})
    # A list of named values: all items before this one are named.
    alone = F.col("__mine") & (F.size("__items") == 1) & (F.size(F.split(F.trim(value_of(F.element_at("__items", -1))), r"\s+")) <= 3)
    listed = F.coalesce(((F.size("__others") == F.size("__items") - 1) & (F.size("__items") > 1)) | alone, F.lit(False))
    rows = rows.withColumn("__listed", listed)
    others = F.transform("__others", value_of)
    rows = rows.withColumn("value", F.when(F.col("__listed"), F.when(F.col("__mine"), _value(value_of(F.element_at("__items", -1)))).otherwise("")))
    empty = F.array().cast("array<string>")
    closed = _closed(F.col("__last")) & ~F.col("__last").rlike(r"\A(?:\p{Nd}+[.)]|[-*•–+]|#+)\z")
    fence = F.when(F.col("__body").contains("```"), F.size(F.split("__body", "```")) % 2 == 0).otherwise(F.lit(False))
    end = F.right("__body", F.lit(8))
    place = F.when(F.size("__before") == 0, "only").when(F.trim(F.element_at("__lines", -2), F.lit(_BLANKS)) == "", "paragraph").otherwise("line")
    rows = rows.withColumns({
        "json_open": json_open(F.trim(F.col("__body"), F.lit(_BLANKS))),
        "broken": end.rlike("[�…]\\z") | end.rlike(_ESCAPE) | F.rtrim(x, F.lit(_BLANKS)).endswith("…"),
        "closed": closed & ~fence & ~_left_open(F.col("__last")),
        "place": place,
        "shape": F.when(F.col("__n") <= SHAPE_WORDS, F.array_join("__masked", " ")),
        "starts": F.when(F.col("__n") > 1, F.transform(F.sequence(F.lit(1), F.least(F.col("__n") - 1, F.lit(SHAPE_WORDS))), lambda k: F.array_join(F.slice("__masked", 1, k), " "))).otherwise(empty),
        "ending": F.when(F.col("__listed") & F.col("__mine") & F.col("value").endswith("N"), F.nullif(_ending(value_of(F.element_at("__items", -1))), F.lit(""))),
        "values": F.when(F.col("__listed"), F.transform(others, _value)).otherwise(empty),
        "endings": F.when(F.col("__listed"), F.filter(F.transform(others, _ending), lambda y: y != "")).otherwise(empty),
        "n_chars": F.length(x),
        "n_bytes": F.octet_length(x),
    })
    rows = rows.withColumn("signed", (F.col("place") == "paragraph") & (F.col("__n") > 0) & (F.col("__n") <= 4) & F.coalesce(_closed(F.trim(F.element_at("__before", -1), F.lit(_BLANKS))), F.lit(False)))
    return rows.drop(text, *(c for c in rows.columns if c.startswith("__")))


def _limits(rows: DataFrame, size: str) -> DataFrame:
    """(source, limit): the size at which the records of a source pile up, if they do and most of them are open there."""
    is_open = F.coalesce("json_open", ~F.col("closed"))
    counts = rows.groupBy("source", size).agg(F.count(F.lit(1)).alias("n"), F.count_if(is_open).alias("open"))
    top = counts.groupBy("source").agg(F.max_by(F.struct("n", "open"), size).alias("at"), F.max(size).alias("limit"), F.sum("n").alias("every"))
    piled = (F.col("at.n") >= LIMIT_RECORDS) & (F.col("at.n") >= LIMIT_SHARE * F.col("every")) & (F.col("at.open") * 2 >= F.col("at.n"))
    return top.where(piled).select("source", F.col("limit").alias(f"{size}_limit"))


def _inside_words(goes_on: DataFrame, ends: DataFrame) -> DataFrame:
    """(place, shape, goes_on) of shapes that break off inside the last word of a shape that goes on.

    Only shapes that end often enough to be usual are asked for, so only what
    shares its words but the last with one of these is taken apart.
    """
    stem = F.regexp_extract("shape", r"\A(.* )?", 0)
    usual = ends.where(F.col("ends") >= LEAST_ENDS).select("place", "shape")
    rows = goes_on.withColumn("stem", stem).join(usual.select("place", stem.alias("stem")).distinct(), ["place", "stem"], "left_semi")
    rows = rows.withColumn("word", F.substring("shape", F.length("stem") + 1, F.length("shape"))).where("length(word) > 1")
    cuts = rows.select("place", F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda k: F.concat("stem", F.left("word", k)))).alias("shape"), "goes_on")
    return cuts.groupBy("place", "shape").agg(F.sum("goes_on").alias("goes_on")).join(usual, ["place", "shape"], "left_semi")


def endings(df: DataFrame, id_col: str, text: str, source: str | Column, done: str | Column | None = None, reason: str | Column | None = None) -> DataFrame:
    """(id, source, cut, why) of every record with a text.

    ``done`` false says that the transfer stopped; ``reason`` is only a
    hint, used where the structure leaves the end open.  Null and empty texts
    have no row; a null source is a source of its own; equal rows are judged
    alike and each has its row.
    """
    col = lambda c: F.col(c) if isinstance(c, str) else c
    flag = F.lit(None).cast("boolean") if done is None else col(done)
    why = F.lit(None).cast("string") if reason is None else col(reason)
    rows = df.where(F.col(text).isNotNull() & (F.trim(text) != "")).select(
        F.col(id_col).alias("id"), F.coalesce(col(source), F.lit("")).alias("source"), flag.alias("done"), F.lower(F.trim(why)).alias("reason"), F.col(text).alias("text")
    )
    rows = cut_lineage(with_facts(spread(rows), "text"))
    # Baselines over all records.
    lines = rows.where("json_open is null")
    ends = lines.where("not closed and shape is not null").groupBy("place", "shape").agg(F.count(F.lit(1)).alias("ends"))
    goes_on = lines.select("place", F.explode("starts").alias("shape")).groupBy("place", "shape").agg(F.count(F.lit(1)).alias("goes_on"))
    goes_on = goes_on.unionByName(_inside_words(goes_on, ends)).groupBy("place", "shape").agg(F.sum("goes_on").alias("goes_on"))
    every = lines.select(F.explode("values").alias("value")).groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    value_share = every.crossJoin(F.broadcast(every.agg(F.sum("n").alias("total")))).select("value", (F.col("n") / F.col("total")).alias("value_share"))
    tails = lines.select(F.explode("endings").alias("ending")).groupBy("ending").agg(F.count(F.lit(1)).alias("n"))
    total = F.broadcast(tails.agg(F.sum("n").alias("total")))
    three = tails.crossJoin(total).select("ending", (F.col("n") / F.col("total")).alias("share3"))
    two = tails.groupBy(F.expr("right(ending, 2)").alias("ending2")).agg(F.sum("n").alias("n")).crossJoin(total).select("ending2", (F.col("n") / F.col("total")).alias("share2"))
    # Only lines that the automaton leaves open are compared with the baselines.
    decided = F.when(F.col("json_open").isNotNull(), F.when(F.col("json_open"), "json value open").otherwise("")).when(F.col("broken"), "broken at the end").when(~F.coalesce("done", F.lit(True)), "transfer not done")
    judged = rows.join(_limits(rows, "n_chars"), "source", "left").join(_limits(rows, "n_bytes"), "source", "left")
    decided = decided.when((F.col("n_chars") == F.col("n_chars_limit")) | (F.col("n_bytes") == F.col("n_bytes_limit")), "at the limit of its source").when(F.col("closed"), "").when(F.col("value").isNull() & F.col("signed"), "")
    judged = judged.withColumn("why", decided)
    settled = judged.where("why is not null").select("id", "source", "reason", "why")
    rest = judged.where("why is null").select("id", "source", "reason", "place", "shape", "value", "ending")
    # Rows without a key to look up are settled before the joins, so none of them gathers at a null.
    plain = rest.where("value = '' or (value is null and shape is null)").withColumn("why", F.when(F.col("value") == "", "item incomplete").otherwise("sentence open"))
    reported = F.coalesce(F.col("reason").isin(LIMIT_REASONS), F.lit(False))
    items = rest.where("value <> ''").join(value_share, "value", "left").withColumn("common", F.coalesce("value_share", F.lit(0.0)) >= VALUE_SHARE)
    unnamed = items.where("ending is null").withColumn("why", F.when(F.col("common"), "").otherwise("item incomplete"))
    named = items.where("ending is not null").withColumn("ending2", F.expr("right(ending, 2)")).join(three, "ending", "left").join(two, "ending2", "left")
    share2, share3 = F.coalesce("share2", F.lit(0.0)), F.coalesce("share3", F.lit(0.0))
    odd = ((share2 < ENDING_SHARE) & (share3 < RARE_ENDING_SHARE)) | (reported & (share3 < RARE_ENDING_SHARE))
    named = named.withColumn("why", F.when(~F.col("common"), "item incomplete").when(odd, "word of an item incomplete").otherwise(""))
    ended = F.coalesce(F.col("ends"), F.lit(0))
    usual = (ended >= LEAST_ENDS) & (ended > F.coalesce(F.col("goes_on"), F.lit(0)))
    shaped = rest.where("value is null and shape is not null").join(ends, ["place", "shape"], "left").join(goes_on, ["place", "shape"], "left").withColumn("why", F.when(usual, "").otherwise("sentence open"))
    columns = ["id", "source", "reason", "why"]
    rest = plain.select(*columns).unionByName(unnamed.select(*columns)).unionByName(named.select(*columns)).unionByName(shaped.select(*columns))
    return settled.unionByName(rest).select("id", "source", (F.col("why") != "").alias("cut"), F.nullif("why", F.lit("")).alias("why"))


def truncation_rates(judged: DataFrame) -> DataFrame:
    """(source, n_texts, n_cut, rate) of what ``endings`` found."""
    return judged.groupBy("source").agg(F.count(F.lit(1)).alias("n_texts"), F.sum(F.col("cut").cast("long")).alias("n_cut"), F.avg(F.col("cut").cast("double")).alias("rate"))
