"""The append-only log: last write, complete tuples, dead tuples, health, progress and plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paritylens.schemas import TRIO, TUPLE


def failed() -> Column:
    return F.col("error").isNotNull() & (F.col("error") != "")


def last_write(samples: DataFrame) -> DataFrame:
    """Of each (tuple, arm) the line that stands last in its file."""
    # By input, so that what is asked of tuples and of inputs next moves nothing again.
    w = Window.partitionBy(*TUPLE, "arm").orderBy(F.col("line_no").desc())
    return samples.repartition("recording_id", "input_id").withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def _arms(roster: tuple[str, ...]) -> Column:
    """Arms of the roster that a group of lines has."""
    return sum((F.max(F.when(F.col("arm") == a, 1).otherwise(0)) for a in roster[1:]), F.max(F.when(F.col("arm") == roster[0], 1).otherwise(0)))


def tuples(samples: DataFrame, roster: tuple[str, ...] = TRIO) -> DataFrame:
    """(tuple..., complete, dead) of every tuple of the latest lines."""
    per = last_write(samples).groupBy(*TUPLE).agg((_arms(roster) == len(roster)).alias("complete"), F.count_if(failed()).alias("n_failed"))
    return per.select(*TUPLE, "complete", (F.col("complete") & (F.col("n_failed") >= len(roster))).alias("dead"))


def replayed(samples: DataFrame, roster: tuple[str, ...] = TRIO) -> DataFrame:
    """What a resumed run keeps: the latest lines of tuples that are complete and not dead.

    One exchange by input serves both windows, and the clouds of inputs after them.
    """
    whole = Window.partitionBy(*TUPLE)
    has = [F.max(F.when(F.col("arm") == a, 1).otherwise(0)).over(whole) for a in roster]
    marked = last_write(samples).withColumns({"__arms": sum(has[1:], has[0]), "__failed": F.sum(F.when(failed(), 1).otherwise(0)).over(whole)})
    return marked.where((F.col("__arms") == len(roster)) & (F.col("__failed") < len(roster))).drop("__arms", "__failed")


def usable(samples: DataFrame) -> DataFrame:
    """Samples without an error; empty outputs stay."""
    return samples.where("error is null")


#: Messages that a recording's health names.
MESSAGES = 5


def health(samples: DataFrame, roster: tuple[str, ...] = TRIO) -> DataFrame:
    """Per recording: lines, errors, empty outputs, tuples, dead tuples, error rate and first messages."""
    latest = last_write(samples)
    per_tuple = latest.groupBy(*TUPLE).agg(F.count(F.lit(1)).alias("n"), F.count_if(failed()).alias("bad"), F.count_if(F.trim("output") == "").alias("empty"))
    counts = per_tuple.groupBy("recording_id").agg(
        F.sum("n").alias("samples"), F.sum("bad").alias("errored"), F.sum("empty").alias("empty"), F.count(F.lit(1)).alias("tuples"), F.count_if((F.col("bad") > 0) & (F.col("bad") == F.col("n"))).alias("dead"), (F.sum("bad") / F.sum("n")).alias("error_rate"),
    )
    # Distinct messages first, then only the first ones of a recording stay together.
    said = latest.where(failed()).select("recording_id", F.substring("error", 1, 80).alias("said")).distinct()
    first = said.withColumn("r", F.row_number().over(Window.partitionBy("recording_id").orderBy("said"))).where(F.col("r") <= MESSAGES)
    messages = first.groupBy("recording_id").agg(F.array_join(F.array_sort(F.collect_list("said")), "; ").alias("messages"))
    return counts.join(messages, "recording_id", "left").withColumn("messages", F.coalesce("messages", F.lit("")))


def planned(samples: DataFrame, k: int) -> DataFrame:
    """Every (recording, input) with each sample number below k."""
    return samples.select("recording_id", "input_id").distinct().withColumn("sample_idx", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))


def progress(samples: DataFrame, k: int, roster: tuple[str, ...] = TRIO) -> DataFrame:
    """Per recording: planned tuples, those done, those done but not planned, those left."""
    done = tuples(samples, roster).where("complete").select(*TUPLE, F.lit(1).alias("d"))
    both = planned(samples, k).withColumn("p", F.lit(1)).join(done, TUPLE, "full")
    return both.groupBy("recording_id").agg(F.count("p").alias("planned"), F.count_if(F.expr("p = 1 and d = 1")).alias("done"), F.count_if(F.expr("p is null and d = 1")).alias("stale"), F.count_if(F.expr("p = 1 and d is null")).alias("left_over"))


def remaining(samples: DataFrame, k: int, roster: tuple[str, ...] = TRIO) -> DataFrame:
    """Planned tuples that still need a run, with their place in the whole plan.

    The place is counted before done tuples leave, so it stays the same when
    a run resumes.  Done needs every arm and an output in each.
    """
    place = F.row_number().over(Window.partitionBy("recording_id").orderBy("input_id", "sample_idx")) - 1
    full = last_write(samples).where((F.trim("output") != "") & ~F.coalesce(failed(), F.lit(False))).groupBy(*TUPLE).agg(F.collect_set("arm").alias("arms"))
    done = full.where(F.size(F.array_except(F.array(*(F.lit(a) for a in roster)), "arms")) == 0)
    return planned(samples, k).withColumn("place", place).join(done, TUPLE, "left_anti")


def schedule(samples: DataFrame, k: int, roster: tuple[str, ...] = TRIO, grouped: bool = True) -> DataFrame:
    """The calls of a recording in order: inputs first or sample numbers first, the leading arm rotating."""
    calls = planned(samples, k).select("*", F.posexplode(F.array(*(F.lit(a) for a in roster))).alias("pos", "arm"))
    turn = F.pmod(F.col("pos") - F.col("sample_idx"), F.lit(len(roster)))
    by = ["input_id", "sample_idx"] if grouped else ["sample_idx", "input_id"]
    return calls.withColumn("ord", F.row_number().over(Window.partitionBy("recording_id").orderBy(*by, turn)) - 1).drop("pos")


def sessions(samples: DataFrame) -> DataFrame:
    """Per recording: sessions, time from first to last stamp, whether it passes a UTC midnight; unset stamps (0) don't count."""
    ts = F.when(F.col("ts") != 0, F.col("ts"))
    day = lambda x: F.floor(x / F.lit(86400.0))
    return samples.groupBy("recording_id").agg(F.countDistinct("session_no").alias("sessions"), F.round(F.coalesce(F.max(ts) - F.min(ts), F.lit(0.0)), 3).alias("span_s"), F.coalesce(day(F.min(ts)) != day(F.max(ts)), F.lit(False)).alias("midnight"))


def interleaving(samples: DataFrame) -> DataFrame:
    """Per recording the longest run of one arm in calling order."""
    w = Window.partitionBy("recording_id").orderBy("ord", "line_no")
    a = Window.partitionBy("recording_id", "arm").orderBy("ord", "line_no")
    runs = samples.select("recording_id", "arm", (F.row_number().over(w) - F.row_number().over(a)).alias("run")).groupBy("recording_id", "arm", "run").count()
    return runs.groupBy("recording_id").agg(F.max("count").alias("longest_run"))


def dead_runs(samples: DataFrame, roster: tuple[str, ...] = TRIO) -> DataFrame:
    """Per recording the longest run of dead tuples in the order they were written."""
    latest = last_write(samples).groupBy(*TUPLE).agg(F.min("line_no").alias("line"), (F.count_if(failed()) >= len(roster)).alias("dead"))
    w = Window.partitionBy("recording_id").orderBy("line")
    d = Window.partitionBy("recording_id", "dead").orderBy("line")
    runs = latest.select("recording_id", "dead", (F.row_number().over(w) - F.row_number().over(d)).alias("run")).groupBy("recording_id", "dead", "run").count()
    return runs.groupBy("recording_id").agg(F.coalesce(F.max(F.when(F.col("dead"), F.col("count"))), F.lit(0)).alias("longest_dead"))


def in_flight(recordings: DataFrame, params: list[str]) -> DataFrame:
    """(recording_id, other_id): unfinished recordings of the same parameters that a new one must wait for."""
    same = None
    for p in params:
        eq = F.col(f"a.{p}").eqNullSafe(F.col(f"b.{p}"))
        same = eq if same is None else same & eq
    a, b = recordings.alias("a"), recordings.where("not finished").alias("b")
    return a.join(b, same & (F.col("a.recording_id") != F.col("b.recording_id"))).select("a.recording_id", F.col("b.recording_id").alias("other_id"))


def decoy_independence(arms: DataFrame) -> DataFrame:
    """(recording_id, arm, warning): reasons to doubt the repeat as a null.

    ``arms``: recording_id, arm, seed, sampling_seed; null is unset.  Where A
    and A_prime show the same seed, that is one warning, named under A; any
    other arm whose sampling is pinned has its own.
    """
    shown = F.coalesce("sampling_seed", "seed")
    of = lambda a: F.max(F.when(F.col("arm") == a, shown))
    shared = arms.groupBy("recording_id").agg((of("A") == of("A_prime")).alias("shared")).where("shared")
    baseline = F.col("arm").isin("A", "A_prime")
    pinned = arms.where("sampling_seed is not null").join(shared, "recording_id", "left").where(~(F.coalesce("shared", F.lit(False)) & baseline))
    own = pinned.select("recording_id", "arm", F.when(baseline, "pinned baseline").otherwise("pinned candidate").alias("warning"))
    return shared.select("recording_id", F.lit("A").alias("arm"), F.lit("shared seed").alias("warning")).unionByName(own)


def latest_labels(labels: DataFrame) -> DataFrame:
    """Of labels given more than once, the last line counts."""
    return labels.groupBy(*TUPLE).agg(F.max_by("hit", "line_no").alias("hit"))


def merge_labels(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old labels with the new ones laid over them."""
    both = old.select(*TUPLE, "hit").withColumn("__n", F.lit(0)).unionByName(new.select(*TUPLE, "hit").withColumn("__n", F.lit(1)))
    return both.groupBy(*TUPLE).agg(F.max_by("hit", "__n").alias("hit"))


def touched(labels: DataFrame) -> DataFrame:
    """Inputs of which any sample was hit."""
    return latest_labels(labels).groupBy("recording_id", "input_id").agg(F.bool_or(F.coalesce("hit", F.lit(False))).alias("fired"))
