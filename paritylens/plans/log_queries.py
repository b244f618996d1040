"""Queries over the recorded log and its labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paritylens.operators import dedup, faults, grading, log
from paritylens.plans.registry import LAST, query, table
from paritylens.sources.files import untraceable

K = 12


def samples(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "samples")


@query(f"WITH {LAST} SELECT recording_id, input_id, sample_idx, arm, line_no, output FROM last")
def s2_last_write(spark, d):
    return log.last_write(samples(spark, d)).select("recording_id", "input_id", "sample_idx", "arm", "line_no", "output")


@query(f"WITH {LAST} SELECT recording_id, input_id, sample_idx, complete AND failed AS dead FROM tup WHERE complete")
def s3_complete_tuples(spark, d):
    return log.tuples(samples(spark, d)).where("complete").select("recording_id", "input_id", "sample_idx", "dead")


@query(f"WITH {LAST} SELECT recording_id, input_id, sample_idx, arm, line_no FROM kept")
def s4_replayed(spark, d):
    return log.replayed(samples(spark, d)).select("recording_id", "input_id", "sample_idx", "arm", "line_no")


@query(f"""WITH {LAST},
pt AS (SELECT recording_id, input_id, sample_idx, count(*) AS n, count(*) FILTER (WHERE error IS NOT NULL AND error <> '') AS bad, count(*) FILTER (WHERE trim(output) = '') AS empty FROM last GROUP BY ALL),
msg AS (SELECT recording_id, array_to_string(list_slice(list_sort(list(DISTINCT substr(error, 1, 80))), 1, 5), '; ') AS messages FROM last WHERE error IS NOT NULL AND error <> '' GROUP BY 1)
SELECT p.recording_id, CAST(sum(n) AS BIGINT) AS samples, CAST(sum(bad) AS BIGINT) AS errored, CAST(sum(empty) AS BIGINT) AS empty, count(*) AS tuples, count(*) FILTER (WHERE bad > 0 AND bad = n) AS dead,
  round(sum(bad) / sum(n), 9) AS error_rate, coalesce(any_value(messages), '') AS messages FROM pt p LEFT JOIN msg USING (recording_id) GROUP BY 1""")
def s5_health(spark, d):
    return log.health(samples(spark, d)).withColumn("error_rate", F.round("error_rate", 9))


@query(f"""WITH {LAST}, planned AS (SELECT recording_id, input_id, CAST(i AS INTEGER) AS sample_idx FROM (SELECT DISTINCT recording_id, input_id FROM samples), range({K}) r(i)),
bt AS (SELECT recording_id, p.sample_idx IS NOT NULL AS p, t.sample_idx IS NOT NULL AS d FROM (SELECT *, 1 AS one FROM planned) p FULL JOIN (SELECT * FROM tup WHERE complete) t USING (recording_id, input_id, sample_idx))
SELECT recording_id, count(*) FILTER (WHERE p) AS planned, count(*) FILTER (WHERE p AND d) AS done, count(*) FILTER (WHERE d AND NOT p) AS stale, count(*) FILTER (WHERE p AND NOT d) AS left_over FROM bt GROUP BY 1""")
def s6_progress(spark, d):
    return log.progress(samples(spark, d), K)


LABELS = "lab AS (SELECT recording_id, input_id, sample_idx, arg_max(hit, line_no) AS hit FROM activation GROUP BY ALL), fired AS (SELECT recording_id, input_id, bool_or(coalesce(hit, false)) AS fired FROM lab GROUP BY ALL)"


@query(f"WITH {LABELS} SELECT recording_id, input_id, fired FROM fired")
def s8_touched_inputs(spark, d):
    return log.touched(table(spark, d, "activation"))


@query("""WITH o AS (SELECT * FROM activation WHERE line_no % 2 = 0 AND hit IS NOT NULL), n AS (SELECT * FROM activation WHERE line_no % 2 = 1 AND hit IS NOT NULL),
ol AS (SELECT recording_id, input_id, sample_idx, arg_max(hit, line_no) AS hit FROM o GROUP BY ALL), nl AS (SELECT recording_id, input_id, sample_idx, arg_max(hit, line_no) AS hit FROM n GROUP BY ALL)
SELECT recording_id, input_id, sample_idx, coalesce(nl.hit, ol.hit) AS hit FROM ol FULL JOIN nl USING (recording_id, input_id, sample_idx)""")
def s9_merged_labels(spark, d):
    labels = table(spark, d, "activation").where("hit is not null")
    return log.merge_labels(log.latest_labels(labels.where("line_no % 2 = 0")), log.latest_labels(labels.where("line_no % 2 = 1")))


@query("SELECT recording_id, line_no, concat_ws(',', CASE WHEN model_id IS NULL THEN 'model_id' END, CASE WHEN finish_reason IS NULL THEN 'finish_reason' END) AS missing FROM samples WHERE model_id IS NULL OR finish_reason IS NULL")
def s12_untraceable_rows(spark, d):
    return untraceable(samples(spark, d), ["model_id", "finish_reason"]).select("recording_id", "line_no", "missing")


RECORDINGS = f"""rec AS (SELECT recording_id, count(DISTINCT arm) AS n_arms, count(DISTINCT input_id) // 25 AS size_class, recording_id IN (SELECT recording_id FROM activation GROUP BY 1 HAVING count(*) > 60) AS finished FROM samples GROUP BY 1)"""


@query(f"WITH {RECORDINGS} SELECT a.recording_id, b.recording_id AS other_id FROM rec a JOIN rec b ON a.n_arms IS NOT DISTINCT FROM b.n_arms AND a.size_class IS NOT DISTINCT FROM b.size_class AND a.recording_id <> b.recording_id AND NOT b.finished")
def s14_in_flight(spark, d):
    done = table(spark, d, "activation").groupBy("recording_id").count().where("count > 60").select("recording_id", F.lit(True).alias("finished"))
    rec = samples(spark, d).groupBy("recording_id").agg(F.countDistinct("arm").alias("n_arms"), F.floor(F.countDistinct("input_id") / 25).alias("size_class"))
    return log.in_flight(rec.join(done, "recording_id", "left").withColumn("finished", F.coalesce("finished", F.lit(False))), ["n_arms", "size_class"])


@query(f"WITH {LAST} SELECT recording_id, arm, count(*) AS n FROM usable GROUP BY ALL")
def f1_usable_samples(spark, d):
    return log.usable(log.replayed(samples(spark, d))).groupBy("recording_id", "arm").agg(F.count(F.lit(1)).alias("n"))


SIZES = "sz AS (SELECT recording_id, input_id, count(*) FILTER (WHERE arm = 'A') AS na, count(*) FILTER (WHERE arm = 'A_prime') AS np, count(*) FILTER (WHERE arm = 'B') AS nb FROM usable GROUP BY ALL)"


def _sizes(spark, d):
    n = lambda a: F.count_if(F.col("arm") == a)
    return log.usable(log.replayed(samples(spark, d))).groupBy("recording_id", "input_id").agg(n("A").alias("na"), n("A_prime").alias("np"), n("B").alias("nb"))


@query(f"WITH {LAST}, {SIZES} SELECT recording_id, input_id FROM sz WHERE na > 0 AND np > 0 AND nb > 0")
def f2_usable_inputs(spark, d):
    return _sizes(spark, d).where("na > 0 and np > 0 and nb > 0").select("recording_id", "input_id")


@query(f"WITH {LAST}, {SIZES} SELECT recording_id, count(*) FILTER (WHERE least(na, np, nb) < {K}) AS short_clouds FROM sz GROUP BY 1")
def f4_short_clouds(spark, d):
    return _sizes(spark, d).groupBy("recording_id").agg(F.count_if(F.least("na", "np", "nb") < K).alias("short_clouds"))


@query("SELECT DISTINCT input_id, CAST('0x' || substr(sha256('7|F5:omission@0.5/B2|' || input_id), 1, 8) AS BIGINT) / 4294967295e0 < 0.4e0 AS reached FROM samples")
def f5_blast_radius(spark, d):
    cell = faults.cell_id("F5", "omission", 0.5, "B2")
    return samples(spark, d).select("input_id", faults.in_blast("B2", 0.4, 7, cell, F.col("input_id")).alias("reached")).distinct()


@query(f"""WITH {LABELS}, n AS (SELECT recording_id, count(DISTINCT input_id) AS n_inputs FROM samples GROUP BY 1),
f AS (SELECT s.recording_id, count(*) AS n_fired FROM (SELECT DISTINCT recording_id, input_id FROM samples) s JOIN fired f USING (recording_id, input_id) WHERE fired GROUP BY 1)
SELECT n.recording_id, n_inputs, coalesce(n_fired, 0) AS n_fired, round(coalesce(n_fired, 0) / n_inputs, 9) AS rate, 10 AS floor, coalesce(n_fired, 0) >= 10 AS gradable,
  CASE WHEN n_fired > 0 THEN CAST(floor(10e0 / (n_fired / n_inputs)) AS BIGINT) END AS advised FROM n LEFT JOIN f USING (recording_id)""")
def f6_a27_gradability(spark, d):
    rates = grading.activation_rate(samples(spark, d), log.touched(table(spark, d, "activation")), ["recording_id"])
    return grading.gradable(rates, 0.10).withColumn("rate", F.round("rate", 9))


@query("""WITH m AS (SELECT recording_id, arm, min(model_id) AS model_id FROM samples GROUP BY ALL)
SELECT a.recording_id, a.model_id IS NOT DISTINCT FROM p.model_id AS same_model FROM m a JOIN m p ON a.recording_id = p.recording_id AND a.arm = 'A' AND p.arm = 'A_prime'""")
def f7_decoy_independence(spark, d):
    of = lambda a: F.min(F.when(F.col("arm") == a, F.col("model_id")))
    both = samples(spark, d).groupBy("recording_id").agg(of("A").alias("a"), of("A_prime").alias("p"), F.count_if(F.col("arm") == "A").alias("na"), F.count_if(F.col("arm") == "A_prime").alias("np"))
    return both.where("na > 0 and np > 0").select("recording_id", F.col("a").eqNullSafe(F.col("p")).alias("same_model"))


@query("SELECT recording_id, input_id, row_number() OVER (PARTITION BY recording_id ORDER BY pos) - 1 AS place FROM (SELECT recording_id, input_id, min(line_no) AS pos FROM samples GROUP BY ALL)")
def d3_ordered_inputs(spark, d):
    return dedup.ordered_ids(samples(spark, d), ["recording_id"]).withColumn("place", F.col("place").cast("long"))


@query("""WITH a AS (SELECT recording_id, list(DISTINCT arm) AS arms FROM samples GROUP BY 1)
SELECT recording_id, array_to_string(list_concat(list_filter(['A', 'A_prime', 'B'], lambda x: list_contains(arms, x)), list_sort(list_filter(arms, lambda x: NOT list_contains(['A', 'A_prime', 'B'], x)))), ',') AS roster FROM a""")
def d4_rosters(spark, d):
    arms = samples(spark, d).groupBy("recording_id").agg(F.array_sort(F.collect_set("arm")).alias("arms"))
    trio = F.array(*(F.lit(a) for a in ("A", "A_prime", "B")))
    return arms.select("recording_id", F.concat_ws(",", F.concat(F.array_intersect(trio, "arms"), F.array_except("arms", trio))).alias("roster"))


@query(f"""WITH p AS (SELECT recording_id, input_id, CAST(i AS INTEGER) AS sample_idx FROM (SELECT DISTINCT recording_id, input_id FROM samples), range({K}) r(i)),
c AS (SELECT p.*, arm, pos FROM p, (VALUES ('A', 0), ('A_prime', 1), ('B', 2)) v(arm, pos))
SELECT recording_id, input_id, sample_idx, arm, row_number() OVER (PARTITION BY recording_id ORDER BY input_id, sample_idx, ((pos - sample_idx) % 3 + 3) % 3) - 1 AS ord FROM c""")
def d5_d6_schedule(spark, d):
    return log.schedule(samples(spark, d), K).withColumn("ord", F.col("ord").cast("long"))


@query(f"""WITH {LAST}, p AS (SELECT recording_id, input_id, CAST(i AS INTEGER) AS sample_idx FROM (SELECT DISTINCT recording_id, input_id FROM samples), range({K}) r(i)),
q AS (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY input_id, sample_idx) - 1 AS place FROM p),
ok AS (SELECT recording_id, input_id, sample_idx FROM last WHERE trim(output) <> '' AND (error IS NULL OR error = '') GROUP BY ALL HAVING count(DISTINCT arm) FILTER (WHERE arm IN ('A', 'A_prime', 'B')) = 3)
SELECT q.* FROM q ANTI JOIN ok USING (recording_id, input_id, sample_idx)""")
def d7_remaining(spark, d):
    return log.remaining(samples(spark, d), K).withColumn("place", F.col("place").cast("long"))


@query("""SELECT recording_id, count(DISTINCT session_no) AS sessions, round(coalesce(max(nullif(ts, 0)) - min(nullif(ts, 0)), 0), 3) AS span_s,
coalesce(floor(min(nullif(ts, 0)) / 86400) <> floor(max(nullif(ts, 0)) / 86400), false) AS midnight FROM samples GROUP BY 1""")
def a17_sessions(spark, d):
    return log.sessions(samples(spark, d))


@query("""WITH r AS (SELECT recording_id, arm, row_number() OVER (PARTITION BY recording_id ORDER BY ord, line_no) - row_number() OVER (PARTITION BY recording_id, arm ORDER BY ord, line_no) AS run FROM samples)
SELECT recording_id, max(n) AS longest_run FROM (SELECT recording_id, arm, run, count(*) AS n FROM r GROUP BY ALL) GROUP BY 1""")
def w2_interleaving(spark, d):
    return log.interleaving(samples(spark, d))


@query("SELECT recording_id, input_id, arm, line_no, row_number() OVER (PARTITION BY recording_id, input_id, arm ORDER BY line_no) - 1 AS call_no FROM samples")
def w4_call_numbers(spark, d):
    from pyspark.sql.window import Window

    w = Window.partitionBy("recording_id", "input_id", "arm").orderBy("line_no")
    return samples(spark, d).select("recording_id", "input_id", "arm", "line_no", (F.row_number().over(w) - 1).cast("long").alias("call_no"))


@query(f"""WITH {LAST}, t AS (SELECT recording_id, input_id, sample_idx, min(line_no) AS line, count(*) FILTER (WHERE error IS NOT NULL AND error <> '') >= 3 AS dead FROM last GROUP BY ALL),
r AS (SELECT recording_id, dead, row_number() OVER (PARTITION BY recording_id ORDER BY line) - row_number() OVER (PARTITION BY recording_id, dead ORDER BY line) AS run FROM t)
SELECT recording_id, coalesce(max(CASE WHEN dead THEN n END), 0) AS longest_dead FROM (SELECT recording_id, dead, run, count(*) AS n FROM r GROUP BY ALL) GROUP BY 1""")
def w6_dead_runs(spark, d):
    return log.dead_runs(samples(spark, d))


@query(f"""WITH {LAST}, c AS (SELECT recording_id, round(sum(latency_ms), 3) AS cost FROM last GROUP BY 1) SELECT recording_id, cost, round(sum(cost) OVER (ORDER BY recording_id ROWS UNBOUNDED PRECEDING), 3) AS upto FROM c""")
def w9_cumulative_cost(spark, d):
    from pyspark.sql.window import Window

    c = log.last_write(samples(spark, d)).groupBy("recording_id").agg(F.round(F.sum("latency_ms"), 3).alias("cost"))
    # One row per recording, as a plan of jobs is.
    return c.withColumn("upto", F.round(F.sum("cost").over(Window.orderBy("recording_id").rowsBetween(Window.unboundedPreceding, 0)), 3))
