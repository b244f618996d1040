from pyspark.sql import functions as F

from paritylens.llm.mixing import copies, mix_report, mixing_plan


def frames(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 1, "small").otherwise("mid").alias("source"), (F.col("id") % 90 + 10).alias("n_tokens"), F.lit(1).alias("range"))
    odd = spark.createDataFrame([(9001, "hot", None, 1), (9002, None, 5, 1), (9003, "unlisted", 5, 1), (9004, "hot", 0, 1)], "doc_id long, source string, n_tokens long, range int")
    targets = spark.createDataFrame([("hot", 0.3, 2), ("small", 0.2, 4), ("mid", 0.4, 1), ("gone", 0.1, 3)], "source string, target_share double, max_repeats int")
    return docs.unionByName(odd), targets


def test_shares_are_met_and_caps_hold(spark):
    docs, targets = frames(spark)
    got = {r.source: r for r in mix_report(docs, targets, "doc_id", "source", "n_tokens").collect()}
    assert set(got) == {"hot", "small", "mid", "gone"} and got["gone"].tokens == 0
    for s, share in (("hot", 3 / 9), ("small", 2 / 9), ("mid", 4 / 9)):
        assert abs(got[s].share - share) < 0.02, s
        assert got[s].most_repeats <= got[s].max_repeats
    assert abs(sum(r.share for r in got.values()) - 1) < 1e-6


def test_systematic_sampling_uses_floor_or_ceil(spark):
    docs, targets = frames(spark)
    plan = mixing_plan(docs, targets, "source", "n_tokens", total=200_000)
    e = {r.source: r.expected for r in plan.collect()}
    used = copies(docs, plan, "doc_id", "source", "n_tokens").collect()
    for r in used:
        assert int(e[r.source]) <= r.copies <= int(e[r.source]) + 1
    n = {s: sum(r.copies for r in used if r.source == s) for s in e}
    every = {r.source: r["count"] for r in docs.where("n_tokens > 0").groupBy("source").count().collect()}
    assert all(abs(n[s] - e[s] * every.get(s, 0)) <= 1 for s in e)
    assert not {9001, 9002, 9003, 9004} & {r.doc_id for r in used}


def test_no_rows(spark):
    docs, targets = frames(spark)
    assert {r.tokens for r in mix_report(docs.limit(0), targets, "doc_id", "source", "n_tokens").collect()} == {0}
    assert mix_report(docs, targets.limit(0), "doc_id", "source", "n_tokens").count() == 0
