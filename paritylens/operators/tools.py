"""Reads of a tool layer as joins of calls with dimension tables, and what a fault changes in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paritylens.functions.text import uniform

#: Most rows of a catalogue that are broadcast.
POLICIES = 1_000


def argument(args: Column, *names: str) -> Column:
    """The first argument present of several spellings; ``id`` stands in for each."""
    keys = [k for n in names for k in (n, n.replace("_", ""), n.split("_")[0], "id")]
    return F.coalesce(*(F.try_element_at(args, F.lit(k)) for k in dict.fromkeys(keys)))


def lookup(calls: DataFrame, entities: DataFrame, key: str, stale_status: str | None = None) -> DataFrame:
    """Calls with the entity they ask for; ``error`` where there is none.  A stale read shows the first status."""
    e = entities.withColumn("status", F.lit(stale_status)) if stale_status else entities
    j = calls.join(e.withColumnRenamed("id", key).withColumn("__hit", F.lit(True)), key, "left")
    return j.withColumn("error", F.when(F.col("__hit").isNull(), F.concat(F.lit("no such entity: "), F.coalesce(F.col(key).cast("string"), F.lit("None"))))).drop("__hit")


def search(calls: DataFrame, events: DataFrame, key: str, low: str = "low", high: str = "high") -> DataFrame:
    """(call..., n, total) of an entity's events with low <= amount <= high; either bound may be null."""
    j = calls.join(events, key, "left").withColumn("__in", F.coalesce(_inside(low, high) & F.col("amount").isNotNull(), F.lit(False)))
    return j.groupBy(*calls.columns).agg(F.count_if("__in").alias("n"), F.coalesce(F.round(F.sum(F.when(F.col("__in"), F.col("amount"))), 2), F.lit(0.0)).alias("total"))


def _inside(low: str, high: str) -> Column:
    return (F.col(low).isNull() | (F.col("amount") >= F.col(low))) & (F.col(high).isNull() | (F.col("amount") <= F.col(high)))


def search_items(calls: DataFrame, events: DataFrame, key: str, order: list[str], low: str = "low", high: str = "high") -> DataFrame:
    """(call..., n, items): the events themselves that ``search`` counts, in the order of ``order``.

    A call's row holds its own events only; these are as many as the entity has.
    """
    rest = [c for c in events.columns if c not in (key, *order)]
    event = F.when(F.coalesce(_inside(low, high) & F.col("amount").isNotNull(), F.lit(False)), F.struct(*order, *rest))
    found = calls.join(events, key, "left").groupBy(*calls.columns).agg(F.array_sort(F.collect_list(event)).alias("items"))
    return found.withColumn("n", F.size("items").cast("long"))


def policy(calls: DataFrame, policies: DataFrame) -> DataFrame:
    """Calls with the first policy whose name holds the topic or is held by it.

    Policies are a catalogue; up to POLICIES of them are broadcast for the
    comparison of texts.  Distinct topics are compared once.
    """
    topics = calls.select("topic").distinct()
    t, n = F.lower("topic"), F.lower("name")
    few = policies.limit(POLICIES + 1).count() <= POLICIES
    hit = topics.join(F.broadcast(policies) if few else policies, n.contains(t) | t.contains(n), "left")
    first = hit.groupBy(F.col("topic").alias("__topic")).agg(F.min_by("name", "ordinal").alias("policy"))
    return calls.join(first, F.col("topic").eqNullSafe(F.col("__topic")), "left").drop("__topic")


def compute(numerator: Column, denominator: Column) -> Column:
    """STRUCT<ratio, error>: a ratio of 4 places, or why there is none."""
    why = F.when(numerator.isNull() | denominator.isNull(), "need both").when(denominator == 0, "denominator is zero")
    return F.struct(F.when(why.isNull(), F.round(F.try_divide(numerator.cast("double"), denominator.cast("double")), 4)).alias("ratio"), why.alias("error"))


def evaluate(principals: DataFrame, years_least: float, ratio_most: float) -> DataFrame:
    """Adds ratio and meets_criteria; no income counts as 1."""
    income = F.when(F.coalesce(F.col("annual_income"), F.lit(0)) == 0, F.lit(1)).otherwise(F.col("annual_income"))
    ratio = F.round(F.col("existing_debt") / income, 4)
    return principals.withColumn("ratio", ratio).withColumn("meets_criteria", (F.col("years_on_record") >= years_least) & (ratio <= ratio_most))


def evaluate_first(principals: DataFrame, policies: DataFrame) -> DataFrame:
    """Principals against the first policy by ``ordinal``: ratio, meets_criteria and the policy's name; one row is broadcast."""
    first = policies.agg(F.min_by(F.struct("policy", "min_years_on_record", "max_ratio"), "ordinal").alias("p")).select("p.*")
    income = F.when(F.coalesce(F.col("annual_income"), F.lit(0)) == 0, F.lit(1)).otherwise(F.col("annual_income"))
    rated = principals.withColumn("ratio", F.round(F.col("existing_debt") / income, 4)).crossJoin(F.broadcast(first))
    return rated.withColumn("meets_criteria", (F.col("years_on_record") >= F.col("min_years_on_record")) & (F.col("ratio") <= F.col("max_ratio"))).drop("min_years_on_record", "max_ratio")


def history_items(principals: DataFrame, entities: DataFrame, key: str, order: list[str]) -> DataFrame:
    """(principal..., items): what each principal owns, in the order of ``order``; an empty list for nothing."""
    rest = [c for c in entities.columns if c not in (key, *order)]
    own = entities.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, *rest))).alias("items"))
    none = F.array().cast(own.schema["items"].dataType)
    return principals.join(own, key, "left").withColumn("items", F.coalesce("items", none))


def history(principals: DataFrame, entities: DataFrame, key: str) -> DataFrame:
    """(principal..., n_owned, total) of what each principal owns."""
    own = entities.groupBy(key).agg(F.count(F.lit(1)).alias("n_owned"), F.round(F.sum("amount"), 2).alias("total"))
    return principals.join(own, key, "left").withColumn("n_owned", F.coalesce("n_owned", F.lit(0))).withColumn("total", F.coalesce("total", F.lit(0.0)))


def verify(calls: DataFrame, documents: DataFrame, key: str, stale: bool = False) -> DataFrame:
    """Calls with ``valid``; a stale read finds every known document valid."""
    d = documents.withColumn("valid", F.lit(True)) if stale else documents
    return calls.join(d.withColumnRenamed("id", key), key, "left")


def act(calls: DataFrame, cases: DataFrame, key: str) -> DataFrame:
    """Calls with the case they act on; the reason is cut to 120 characters."""
    return calls.join(cases.withColumnRenamed("id", key), key, "left").withColumn("reason", F.substring("reason", 1, 120))


def stale_view(rows: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """The oldest item twice and the latest gone, where there are at least two."""
    w = Window.partitionBy(*by).orderBy(order)
    return rows.withColumn(value, F.coalesce(F.lag(value).over(w), F.col(value)))


#: Shares of reads that the levels of degraded retrieval replace.
DEGRADED_LADDER = (0.10, 0.20, 0.30)


def degraded(rows: DataFrame, noise: float, seed: int, key: str, value: str) -> DataFrame:
    """Each value, with chance ``noise`` by a hash, replaced by that of another row of its bucket.

    The other row is the next one in hash order within 1 of 256 buckets, so
    no task sees all rows.
    """
    named = lambda *x: F.concat_ws("|", *(F.lit(p) for p in x), F.lit(str(seed)), F.col(key).cast("string"))
    x = rows.withColumn("__u", uniform(named())).withColumn("__b", F.substring(F.sha2(named("bucket"), 256), 1, 2)).withColumn("__h", F.sha2(named("order"), 256))
    w = Window.partitionBy("__b").orderBy("__h", key)
    other = F.coalesce(F.lead(value).over(w), F.first(value).over(w))
    return x.withColumn("degraded", F.col("__u") < noise).withColumn(value, F.when(F.col("__u") < noise, other).otherwise(F.col(value))).drop("__u", "__b", "__h")


def mixed_lists(rows: DataFrame, noise: float, seed: int, owner: str, item: str) -> DataFrame:
    """(owner, items): lists in the order of their own items, a share ``noise`` of which are shown as others'."""
    shown = degraded(rows.withColumn("__item", F.col(item)), noise, seed, item, "__item")
    return shown.groupBy(owner).agg(F.transform(F.array_sort(F.collect_list(F.struct(item, "__item"))), lambda x: x["__item"]).alias("items"))


def changed_calls(clean: DataFrame, faulty: DataFrame, call: list[str], result: str) -> DataFrame:
    """(input_id, sample_idx, activated): any call of the sample got another result."""
    j = clean.select(*call, F.col(result).alias("a")).join(faulty.select(*call, F.col(result).alias("b")), call)
    return j.groupBy("input_id", "sample_idx").agg(F.bool_or(~F.col("a").eqNullSafe(F.col("b"))).alias("activated"))


def withdrawn(calls: DataFrame, gone: list[str]) -> DataFrame:
    """(input_id, activated): the baseline used a tool that is withdrawn."""
    return calls.groupBy("input_id").agg(F.bool_or(F.col("tool").isin(gone)).alias("activated"))
