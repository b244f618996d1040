"""Problem 2: one consistent form for texts that look the same.

A text is exploded to positioned code points, joined with broadcast tables
of decompositions and look-alikes, its combining marks are put in the order
of their classes, base letters and marks are recomposed and the string is put
together again.  Texts are processed whole.

Two shortcuts leave the result as it is: a text made only of characters that
the tables map to themselves is its own form, and within the other texts runs
of such characters travel as one piece.
"""

from __future__ import annotations

import functools
import sys
import unicodedata

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paritylens.llm.lookalikes import LOOKALIKES, NO_INK
from paritylens.session import cut_lineage, spread

#: Characters that are their own form and do not combine with what follows
#: unless that is itself outside this class.
STABLE = r"\t\n\x20-\x7EÀ-ÖØ-öø-ÿĀ-İĴ-ľŁ-ňŊ-ž–—‘-„•€"
_BREAKS = "\x0b\x0c\x1c\x1d\x1e\x85  "
#: Of records with byte-identical texts, this many first ones (and one more)
#: stand for the others; different texts are always paired with each other.
REPRESENTATIVES = 64
#: Groups of copies above this size are ranked in SALTS tasks.
HOT_GROUP, SALTS = 10_000, 32
#: Records of a class on either side of one tile of pairs.
BLOCK = 2_000


def _invisible(c: str) -> bool:
    o, kind = ord(c), unicodedata.category(c)
    return kind == "Cf" or (kind == "Cc" and c not in "\n\t" + _BREAKS) or any(a <= o <= b for a, b in NO_INK)


def _parts(c: str) -> str:
    """What one code point becomes before marks are ordered."""
    if c in _BREAKS:
        return "\n"
    if unicodedata.category(c) == "Zs":
        return " "
    if _invisible(c):
        return ""
    out = "".join(LOOKALIKES.get(x, x) for x in unicodedata.normalize("NFKD", LOOKALIKES.get(c, c)))
    return "".join(" " if unicodedata.category(x) == "Zs" else "" if _invisible(x) else x for x in out)


@functools.cache
def _tables() -> tuple[list, list]:
    """(code point -> parts with class and joining flag), (base -> {marks -> composed letter}).

    Both are made by rule from the Unicode data of the interpreter: about
    20,000 and 500 rows, whatever the data.
    """
    every = [chr(o) for o in range(sys.maxunicode + 1) if not 0xD800 <= o <= 0xDFFF]
    composed: dict[str, dict[str, str]] = {}
    second = set()
    for c in every:
        full = unicodedata.normalize("NFD", c)
        if len(full) > 1 and unicodedata.normalize("NFC", full) == c:
            composed.setdefault(full[0], {})[full[1:]] = c
            second.update(x for x in full[1:] if not unicodedata.combining(x))
    rows = []
    for c in every:
        parts = _parts(c)
        marked = [(x, unicodedata.combining(x), bool(unicodedata.combining(x)) or x in second) for x in parts]
        if parts != c or any(m[2] for m in marked):
            rows.append((c, marked))
    return rows, [(b, m) for b, m in sorted(composed.items())]


def _broadcast_tables(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    rows, composed = _tables()
    parts = spark.createDataFrame(rows, "ch string, parts array<struct<ch:string,ccc:int,joins:boolean>>")
    bases = spark.createDataFrame(composed, "base string, letters map<string,string>")
    return F.broadcast(parts), F.broadcast(bases)


def is_consistent(text: Column) -> Column:
    """True where the text is certain to be its own consistent form."""
    # Runs of the plainest characters go through one range instead of the whole class.
    return text.rlike(rf"\A(?:[\x20-\x7E]++|[{STABLE}])*+\z")


def text_key(text: Column) -> Column:
    """128 bits that stand for a text; stored as binary."""
    return F.unhex(F.md5(text))


def work_pieces(spark: SparkSession) -> int:
    """Partitions for the few texts that need work per character: a quarter of a whole shuffle, but every core."""
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) // 4)


def _forms(texts: DataFrame) -> DataFrame:
    """(k, text) with unique k -> (k, form)."""
    parts, bases = _broadcast_tables(texts.sparkSession)
    # A piece is either a run of stable characters, or unstable characters
    # with the one stable character they may combine with.
    piece = F.regexp_extract_all(F.regexp_replace("text", "\r\n?", "\n"), F.lit(rf"[{STABLE}]+(?![^{STABLE}])|[{STABLE}]?[^{STABLE}]+"), F.lit(0))
    points = F.flatten(F.transform(piece, lambda p: F.when(p.rlike(rf"\A[{STABLE}]+\z"), F.array(p)).otherwise(F.split(p, ""))))
    # All steps below group by k, so this is the only exchange.  Its pieces are
    # few bytes and much work, so their number is given and not left to their size.
    rows = texts.repartition(work_pieces(texts.sparkSession), "k").select("k", F.posexplode(points).alias("pos", "ch"))
    rows = rows.join(parts, "ch", "left")
    own = F.array(F.struct(F.col("ch"), F.lit(0).alias("ccc"), F.lit(False).alias("joins")))
    rows = rows.select("k", "pos", F.posexplode_outer(F.coalesce("parts", own)).alias("sub", "part"))
    rows = rows.select("k", "pos", F.coalesce("sub", F.lit(0)).alias("sub"), F.coalesce(F.col("part.ch"), F.lit("")).alias("ch"), F.coalesce(F.col("part.ccc"), F.lit(0)).alias("ccc"), F.coalesce(F.col("part.joins"), F.lit(False)).alias("joins"))
    rows = rows.where((F.col("ch") != "") | (F.col("pos") == 0))
    order = Window.partitionBy("k").orderBy("pos", "sub").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("at", F.sum(F.when(F.col("joins"), 0).otherwise(1)).over(order))
    # No mark moves past a character without a class.
    rows = rows.withColumn("wall", F.sum(F.when(F.col("ccc") == 0, 1).otherwise(0)).over(order))
    cluster = rows.groupBy("k", "at").agg(
        F.max(F.when(~F.col("joins"), F.col("ch"))).alias("base"),
        # Order by class; equal classes keep their place.
        F.array_sort(F.collect_list(F.when(F.col("joins"), F.struct("wall", "ccc", "pos", "sub", "ch")))).alias("marks"),
    )
    cluster = cluster.join(bases, "base", "left")
    start = F.struct(F.lit("").alias("joined"), F.lit("").alias("kept"), F.lit(-1).alias("last"))

    def step(acc: Column, mark: Column) -> Column:
        longer = F.concat(acc["joined"], mark["ch"])
        free = (acc["kept"] == "") | ((acc["last"] < mark["ccc"]) & (acc["last"] > 0))
        fits = free & F.coalesce(F.element_at(F.col("letters"), longer).isNotNull(), F.lit(False))
        return F.when(fits, F.struct(longer.alias("joined"), acc["kept"].alias("kept"), acc["last"].alias("last"))).otherwise(
            F.struct(acc["joined"].alias("joined"), F.concat(acc["kept"], mark["ch"]).alias("kept"), F.when(acc["last"] == 0, 0).otherwise(mark["ccc"]).alias("last"))
        )

    folded = F.aggregate("marks", start, step)
    letter = F.coalesce(F.when(folded["joined"] == "", F.col("base")).otherwise(F.element_at(F.col("letters"), folded["joined"])), F.lit(""))
    cluster = cluster.select("k", "at", F.when(F.size("marks") == 0, F.coalesce("base", F.lit(""))).otherwise(F.concat(letter, folded["kept"])).alias("piece"))
    return cluster.groupBy("k").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "piece"))), lambda x: x["piece"]), "").alias("form"))


def consistent_form(df: DataFrame, text: str, out: str = "form") -> DataFrame:
    """``df`` with the consistent form of ``text`` in the new column ``out``.

    Null stays null, the empty text stays empty, equal texts get equal forms.
    Other columns may have any name but ``out`` and ``__k``.
    """
    clean = df.where(F.col(text).isNull() | is_consistent(F.col(text))).withColumn(out, F.col(text))
    dirty = df.where(F.col(text).isNotNull() & ~is_consistent(F.col(text))).withColumn("__k", text_key(F.col(text)))
    distinct = dirty.groupBy(F.col("__k").alias("k")).agg(F.first(text).alias("text"))
    forms = _forms(distinct).select(F.col("k").alias("__k"), F.col("form").alias(out))
    return clean.unionByName(dirty.join(forms, "__k").drop("__k"))


def same_form_classes(df: DataFrame, by: list[str], id_col: str, text: str) -> DataFrame:
    """(by..., id, raw, form_key, n_records, n_texts) of records whose form another record shares.

    ``raw`` and ``form_key`` are 128-bit keys of the text and of its form.
    Null texts, and rows without an id, belong to no class.  A repeated row with the same id counts once.
    """
    records = consistent_form(spread(df.where(F.col(text).isNotNull() & F.col(id_col).isNotNull()).select(*by, F.col(id_col).alias("id"), F.col(text).alias("__text"))), "__text", "__form")
    records = records.select(*by, "id", text_key(F.col("__text")).alias("raw"), text_key(F.col("__form")).alias("form_key"))
    records = cut_lineage(records.dropDuplicates([*by, "id", "raw"]))
    # Copies are counted per text before the classes meet, so a hot class
    # sends one row per map task and text.
    sizes = records.groupBy(*by, "form_key", "raw").agg(F.count(F.lit(1)).alias("n")).groupBy(*by, "form_key").agg(F.sum("n").alias("n_records"), F.count(F.lit(1)).alias("n_texts"))
    return records.join(sizes.where("n_records > 1"), [*by, "form_key"])


def first_copies(members: DataFrame, group: list[str]) -> DataFrame:
    """``members`` (group..., id, raw) with ``first``: whether a record is among the first REPRESENTATIVES + 1 ids of its text in its class."""
    text = [*group, "raw"]
    many = cut_lineage(members.groupBy(*text).agg(F.count(F.lit(1)).alias("n_copies")).where(F.col("n_copies") > REPRESENTATIVES + 1))
    if many.isEmpty():
        return members.withColumn("first", F.lit(True))
    salted = members.select(*text, "id").join(many, text).withColumn("salt", F.when(F.col("n_copies") > HOT_GROUP, F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).otherwise(F.lit(0)))
    rank = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy("id"))
    first = salted.withColumn("r", rank(*text, "salt")).where(F.col("r") <= REPRESENTATIVES + 1)
    first = first.withColumn("r", rank(*text)).where(F.col("r") <= REPRESENTATIVES + 1)
    last = first.groupBy(*text).agg(F.max("id").alias("last"))
    return members.join(last, text, "left").withColumn("first", F.coalesce(F.col("id") <= F.col("last"), F.lit(True))).drop("last")


def class_pairs(marked: DataFrame, group: list[str], different: Column | None = None) -> DataFrame:
    """Pairs id_a < id_b of each class.

    ``marked``: group..., id, raw and first of ``first_copies``, and what
    ``different`` compares of ``a`` and ``b``.  All pairs of different texts
    are listed, but of more than REPRESENTATIVES + 1 copies of one text only
    the first ones meet every record of the class, the others meet the first
    ones of each text.  Classes above BLOCK records are cut into tiles.
    """
    sizes = marked.groupBy(*group).agg(F.ceil(F.count_if("first") / BLOCK).cast("int").alias("p"), F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("q")).where("q > 1")
    rows = marked.join(sizes, group, "left").withColumns({"p": F.coalesce("p", F.lit(1)), "q": F.coalesce("q", F.lit(1))})
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    a = rows.where("first").withColumn("i", own("p")).withColumn("j", every("q")).alias("a")
    b = rows.withColumn("j", own("q")).withColumn("i", every("p")).alias("b")
    on = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in [*group, "i", "j"]]
    # Two first ones meet twice.
    on.append((F.col("a.id") < F.col("b.id")) | (~F.col("b.first") & (F.col("a.id") > F.col("b.id"))))
    pairs = a.join(b, on + ([different] if different is not None else []))
    return pairs.select(*[F.col(f"a.{g}").alias(g) for g in group], F.least("a.id", "b.id").alias("id_a"), F.greatest("a.id", "b.id").alias("id_b"))


def lookalike_pairs(df: DataFrame, by: list[str], id_col: str, text: str) -> DataFrame:
    """(by..., id_a, id_b): records whose texts look the same but differ in code points."""
    group = [*by, "form_key"]
    members = cut_lineage(same_form_classes(df, by, id_col, text).where("n_texts > 1").select(*group, "id", "raw"))
    return class_pairs(cut_lineage(first_copies(members, group)), group, F.col("a.raw") != F.col("b.raw")).select(*by, "id_a", "id_b")
