"""Problem 4: the share of repeated words within each text.

A word is repeated if it belongs to a run of RUN consecutive words that
already began at an earlier place of the same text.  The exact share is
needed only for texts that cheap rules can't decide.  Each rule states a
condition that every case meets, so their order changes the work and never
the result; it is chosen by rejections per cost, both measured on a bounded
sample of all texts inside one task.
"""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paritylens.llm.words import words
from paritylens.session import spread

#: Words of a run, least number of words of a case, least share of a case.
RUN, LEAST_WORDS, LEAST_SHARE = 5, 40, 0.3
#: Texts whose rejections and cost order the rules (about as many; at most twice), and times they are measured.
SAMPLE, ROUNDS = 400, 4

Rule = Callable[[Column, Column], Column]


def _exceeds(part: Column, whole: Column, share: Fraction) -> Column:
    return part * F.lit(share.denominator) >= whole * F.lit(share.numerator)


def rules(run: int, least_words: int, share: Fraction) -> dict[str, Rule]:
    """Conditions on a text and its words that hold for every case."""

    def again(items: Column) -> Column:
        return F.size(items) - F.size(F.array_distinct(items))

    def pairs(w: Column) -> Column:
        last = F.greatest(F.size(w) - 1, F.lit(0))
        return F.zip_with(F.slice(w, 1, last), F.slice(w, 2, last), lambda a, b: F.concat_ws(" ", a, b))

    return {
        # n words need n letters and n - 1 characters between them.
        "length": lambda x, w: F.length(x) >= 2 * least_words - 1,
        "count": lambda x, w: F.size(w) >= least_words,
        # A repeated word has occurred before, so it isn't the first of its kind.
        "kinds": lambda x, w: _exceeds(again(w), F.size(w), share),
        # Of a repeated run, all pairs of neighbours have occurred before; where
        # two runs abut, one pair may be new.
        "pairs": lambda x, w: _exceeds(run * again(pairs(w)), (run - 1) * F.size(w), share),
    }


def _on_pair(rule: Rule) -> Callable[[Column], Column]:
    return lambda pair: rule(pair["x"], pair["w"])


#: Rules that ask for the text only, and not for its words.
OF_TEXT = ["length"]


def _measured(sample: DataFrame, every: dict[str, Rule]) -> tuple[dict[str, list[bool]], dict[str, int]]:
    """What each rule keeps of the sampled texts, and the nanoseconds it takes; ``words`` is the cut into words.

    ``sample`` has one row with all texts.  The clock is read before and after
    each rule within the task, so neither the start of a job nor of a task
    counts; the first of ROUNDS rounds warms up, of the others the least counts.
    """

    def timed(value: Column) -> Column:
        clock = lambda: F.reflect(F.lit("java.lang.System"), F.lit("nanoTime"))
        return F.struct(clock().alias("begun"), value.alias("got"), clock().alias("ended"))

    rounds = sample.select("texts", F.explode(F.sequence(F.lit(1), F.lit(ROUNDS))).alias("round"))
    cut = rounds.select("round", "texts", timed(F.transform("texts", lambda x: words(x))).alias("words"))
    both = cut.select("round", "words", F.arrays_zip(F.col("texts").alias("x"), F.col("words.got").alias("w")).alias("both"))
    rows = both.select("round", F.struct("words.begun", "words.ended").alias("words"), *(timed(F.transform("both", _on_pair(rule))).alias(name) for name, rule in every.items()))
    got = sorted(rows.collect(), key=lambda r: r["round"])
    cost = {k: max(1, min(int(r[k]["ended"]) - int(r[k]["begun"]) for r in got[1:])) for k in ["words", *every]}
    return {k: got[0][k]["got"] for k in every}, cost


def order_rules(texts: DataFrame, text: str, run: int, least_words: int, share: Fraction) -> list[str]:
    """Names of the rules: next is always the one that rejects most of the texts still left, per cost.

    The first rule on words also pays for cutting the text into words.
    Selectivity and cost come from a seeded sample of all texts, about SAMPLE
    of them; they are estimates that only set the order.
    """
    every = rules(run, least_words, share)
    rows = texts.select(text)
    n = rows.count()
    some = rows.sample(False, min(1.0, SAMPLE / n), 7) if n else rows
    sample = [r[0] for r in some.where(F.col(text).isNotNull()).limit(2 * SAMPLE).collect()]
    if not sample:
        return list(every)
    keeps, cost = _measured(texts.sparkSession.createDataFrame([(sample,)], "texts array<string>").coalesce(1), every)
    alive, order, left = [True] * len(sample), [], list(every)
    while left:
        cut = cost["words"] if set(order) <= set(OF_TEXT) else 0
        gain = {k: sum(a and not kept for a, kept in zip(alive, keeps[k])) / (cost[k] + (0 if k in OF_TEXT else cut)) for k in left}
        best = max(left, key=gain.get)
        order.append(best)
        left.remove(best)
        alive = [a and kept for a, kept in zip(alive, keeps[best])]
    return order


def repeated_share(df: DataFrame, id_col: str, text: str, run: int = RUN) -> DataFrame:
    """(id, n_words, n_repeated, share) of every text; exact.

    Null texts have no row; texts with fewer than ``run`` words, or none,
    have no repeated words and share 0.  Rows with the same id are taken as
    separate texts.
    """
    return _shares(df.where(F.col(text).isNotNull()).select(F.col(id_col).alias("id"), words(F.col(text)).alias("w")), run)


def _shares(texts: DataFrame, run: int) -> DataFrame:
    """(id, n_words, n_repeated, share) of rows (id, w)."""
    # Runs of one text stay in the task that has the text: rid is unique and
    # the exchange by it moves each text once.
    rows = texts.withColumn("rid", F.struct("id", F.xxhash64("w")))
    rows = rows.groupBy("rid").agg(F.first("w").alias("w"), F.count(F.lit(1)).alias("rows"))
    n = F.size("w")
    starts = F.transform(F.sequence(F.lit(1), n - run + 1), lambda i: F.xxhash64(F.slice(F.col("w"), i, run), F.crc32(F.array_join(F.slice(F.col("w"), i, run), " "))))
    grams = rows.select("rid", "rows", n.alias("n_words"), F.posexplode_outer(F.when(n >= run, starts)).alias("at", "gram"))
    earlier = F.row_number().over(Window.partitionBy("rid", "gram").orderBy("at")) > 1
    begun = grams.withColumn("again", F.col("at").isNotNull() & earlier)
    nxt = F.lead("at").over(Window.partitionBy("rid", "again").orderBy("at"))
    # A repeated start covers its run up to the next repeated start.
    cover = begun.withColumn("cover", F.when(F.col("again"), F.least(F.lit(run), F.coalesce(nxt - F.col("at"), F.lit(run)))).otherwise(0))
    total = cover.groupBy("rid").agg(F.first("n_words").alias("n_words"), F.sum("cover").cast("int").alias("n_repeated"), F.first("rows").alias("rows"))
    total = total.withColumn("rows", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))))
    return total.select(F.col("rid.id").alias("id"), "n_words", "n_repeated", (F.when(F.col("n_words") > 0, F.col("n_repeated") / F.col("n_words")).otherwise(F.lit(0.0))).alias("share"))


def repetitive(df: DataFrame, id_col: str, text: str, run: int = RUN, least_words: int = LEAST_WORDS, least_share: float = LEAST_SHARE) -> DataFrame:
    """(id, n_words, n_repeated, share) of texts with at least that many words and that share of repeated ones.

    Texts that are null, empty or too short are no cases.
    """
    share = Fraction(str(least_share))
    every = rules(run, least_words, share)
    order = order_rules(df, text, run, least_words, share)
    first = next(i for i, name in enumerate(order) if name not in OF_TEXT)

    def all_of(names: list[str]) -> Column:
        # Nested so that a rejected text costs none of the later rules.
        passed = F.lit(True)
        for name in reversed(names):
            passed = F.when(every[name](F.col("text"), F.col("w")), passed).otherwise(F.lit(False))
        return passed

    rest = spread(df.where(F.col(text).isNotNull()).select(F.col(id_col).alias("id"), F.col(text).alias("text"))).where(all_of(order[:first]))
    # The generator keeps the words from being cut anew for every rule.
    rest = rest.select("id", "text", F.explode(F.array(words(F.col("text")))).alias("w")).where(all_of(order[first:]))
    exact = _shares(rest.select("id", "w"), run)
    return exact.where((F.col("n_words") >= least_words) & _exceeds(F.col("n_repeated"), F.col("n_words"), share))
