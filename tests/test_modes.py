import pytest
from pyspark.sql import functions as F

from paritylens.operators import modes
from paritylens.plans import detect


def cloud(spark, a, p, b, input_id="i"):
    rows = [("r", input_id, arm, m, k) for arm, xs in (("A", a), ("A_prime", p), ("B", b)) for k, m in enumerate(xs)]
    return spark.createDataFrame(rows, "recording_id string, input_id string, arm string, mode string, ord int")


def dist(spark, a, p, b):
    keys = ["recording_id", "input_id"]
    return modes.distances(modes.mode_counts(cloud(spark, a, p, b), keys), keys).first()


def test_distances_of_known_clouds(spark):
    a10, b10, half = ["a"] * 10, ["b"] * 10, ["a"] * 5 + ["b"] * 5
    r = dist(spark, a10, a10, b10)
    assert (r.mode_share_t, r.mode_share_d, r.novel_mode_t, r.novel_mode_d) == (1, 0, 1, 0)
    r = dist(spark, a10, half, half)
    assert r.mode_share_t == 0.5 and r.dispersion_b == 0.5 and r.dispersion_a == 0
    assert dist(spark, ["a"] * 10, a10, ["a"] * 5 + ["z"] * 5).novel_mode_t == 0.5
    assert dist(spark, ["a"] * 5 + ["z"] * 5, a10, a10).novel_mode_t == 0
    assert dist(spark, list("aaaaabbbcc"), a10, a10).dispersion_t > 0.9


def test_an_input_without_an_arm_is_dropped(spark):
    assert dist(spark, ["a"], [], ["b"]) is None


def test_modal_shape_tie_is_the_first_met(spark):
    s = spark.createDataFrame([("r", "i", "A", "list", 3, 1), ("r", "i", "A", "json", 1, 2), ("r", "i", "A", "list", 5, 3), ("r", "i", "A", "json", 7, 4)], "recording_id string, input_id string, arm string, shape string, ord int, line_no int")
    assert modes.modal_shape(s, ["recording_id", "input_id"], F.col("shape")).first().stratum == "json"


def test_drift(spark):
    t = lambda a, p, b: modes.drift(cloud(spark, a, p, b).withColumnRenamed("mode", "word"), ["input_id"]).first()
    r = t(["x", "y"], ["x", "y"], ["u", "v"])
    assert (r.drift_t, r.drift_d) == (1.0, 0.0)


def test_greedy_clusters_count_their_calls(spark):
    s = cloud(spark, list("abcab"), [], [])
    got = modes.greedy_clusters(s, ["input_id"], lambda pairs: [x == y for x, y in pairs]).collect()
    assert {r.cluster for r in got} == set("abc") and {r.calls for r in got} == {3}


def test_gate_blocks_both_scores_or_the_channel(spark):
    rows = [("r", f"i{i}", d, 0.5, 0.4) for i, d in enumerate([0.1, 0.2, 0.9])]
    s = spark.createDataFrame(rows, "recording_id string, input_id string, drift_t double, embedding_t double, embedding_d double")
    got = {r.input_id: r for r in modes.gate(s, ["recording_id"]).collect()}
    assert not got["i0"].skipped and (got["i2"].embedding_t, got["i2"].embedding_d) == (0, 0) and got["i1"].embedding_t == 0.5
    more = s.withColumn("drift_t", F.lit(0.9))
    assert all(r.skipped for r in modes.gate(more, ["recording_id"]).collect())


def test_centroids(spark):
    rows = [(1, "A", [1.0, 0.0]), (1, "A_prime", [2.0, 0.0]), (1, "B", [0.0, 3.0]), (2, "A", [0.0, 0.0]), (2, "A_prime", [1.0, 0.0]), (2, "B", [1.0, 0.0])]
    v = spark.createDataFrame(rows, "input_id int, arm string, embedding array<float>")
    got = {r.input_id: (r.embedding_t, r.embedding_d) for r in modes.centroid_distance(v, ["input_id"]).collect()}
    assert got == {1: (pytest.approx(1.0), pytest.approx(0.0)), 2: (0.0, 0.0)}


def recording(spark, changed, n=60, k=8):
    rows = []
    for i in range(n):
        for arm in ("A", "A_prime", "B"):
            for s in range(k):
                h = (i * 7 + s * 3 + len(arm)) % 4
                out = "DECLINE now." if arm == "B" and i < changed else ("APPROVE it." if h else "ESCALATE it.")
                rows.append(("r", i * 100 + s * 3 + len(rows) % 3, f"i{i:03d}", arm, s, len(rows), out, 1.0, 1.0, None, None, None, 0))
    return spark.createDataFrame(rows, "recording_id string, line_no long, input_id string, arm string, sample_idx int, ord long, output string, latency_ms double, ts double, model_id string, finish_reason string, error string, session_no int")


def test_detect_finds_what_changed_and_stays_silent_otherwise(spark):
    flagged, sel, best = detect.detect(recording(spark, 20))
    found = {r.input_id for r in flagged.where("flagged").select("input_id").distinct().collect()}
    assert found == {f"i{i:03d}" for i in range(20)}
    quiet, _, _ = detect.detect(recording(spark, 0))
    assert quiet.where("flagged").count() == 0
    assert "flagged" in detect.report(flagged, sel, best, ["recording_id"], 0.10).first().report


def test_a_tighter_level_never_finds_more(spark):
    s = detect.scores(detect.with_modes(recording(spark, 12)), ["recording_id"])
    n = [detect.judged(s, ["recording_id"], q)[0].where("flagged").count() for q in (0.05, 0.1, 0.3)]
    assert n == sorted(n)


def test_partitions_do_not_matter(spark):
    r = recording(spark, 15, n=40)
    rows = [sorted(map(tuple, detect.scores(detect.with_modes(r.repartition(p)), ["recording_id"]).collect())) for p in (1, 7)]
    assert rows[0] == rows[1]


def test_drift_control_compares_every_recording_with_the_next(spark, data, tmp_path):
    from paritylens.plans import catalogue

    log = spark.read.parquet(f"{data}/samples.parquet")
    one = log.where(F.col("recording_id") == log.agg(F.min("recording_id")).first()[0])
    for name, ids in (("three", "abc"), ("one", "a"), ("none", "")):
        rows = one.limit(0)
        for i in ids:
            rows = rows.unionByName(one.withColumn("recording_id", F.lit(i)))
        rows.write.parquet(f"{tmp_path}/{name}/samples.parquet")
    run = lambda name: {(r.recording_id, r.pairing) for r in catalogue.queries()["q10_drift_control"](spark, f"{tmp_path}/{name}").collect()}
    assert run("three") == {(p, k) for p in ("a/b", "b/c") for k in ("cross_p1null", "cross_p2null", "within_p2")}
    assert run("one") == run("none") == set()
