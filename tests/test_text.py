import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from paritylens.functions import text as X


def apply(spark, fn, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.o for r in df.select("i", fn(F.col("t")).alias("o")).orderBy("i").collect()]


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="aB .-*#_`1)\n\t{}[]\":,é’…ﬁ", max_size=25), min_size=40, max_size=50))
def test_builtin_path_equals_the_exact_one(spark, texts):
    assert apply(spark, X.normalise_text, texts) == [X.normalise_text_py(t) for t in texts]
    assert apply(spark, X.dedup_key, texts) == [X.dedup_key_py(t) for t in texts]


def test_known_forms(spark):
    got = apply(spark, X.normalise, ["## Result\n**Approved** for _March_", '{"b": 2, "a": 1}', '{\n "a": 1,\n "b": 2}', '{"a": 1,}', "- One.\n- Two.", "1. One.\n2. Two.", "", None])
    assert got[0] == "Result\nApproved for March" and got[1] == got[2] == '{"a":1,"b":2}' and got[3] == '{"a": 1,}' and got[4] == got[5] and got[6] == "" and got[7] is None


def test_shapes(spark):
    texts = ['{"a": 1}', "- a\n- b\n- c", "Approved.", "word " * 200, "- a", "", "42", "NaN", None]
    assert apply(spark, X.shape, texts)[:8] == ["json", "list", "short", "prose", "short", "short", "json", "json"]


def test_counts_and_marks(spark):
    assert apply(spark, X.line_count, ["", "a", "a\n", "a\nb", "a\r\nb\n"]) == [len(t.splitlines()) for t in ["", "a", "a\n", "a\nb", "a\r\nb\n"]]
    assert apply(spark, X.word_count, [" a  b\n", ""]) == [2, 0]
    assert apply(spark, X.terminated, ["Yes. ", "no", "", 'said "x"']) == [True, False, False, True]
    assert apply(spark, X.refuses, ["I'm sorry, but no", "I cannot help", "I may not know"]) == [True, True, False]
    assert apply(spark, X.scripts, ["abc", "สวัสดี a", "12", "漢"]) == [["LATIN"], ["LATIN", "THAI"], [], ["CJK"]]
    assert apply(spark, X.decision, ["DECLINE x APPROVE", "decline", "DECLINED"]) == ["DECLINE", "NONE", "NONE"]
    assert apply(spark, X.without_thinking, ["a</think> b</think>\n c", "x"]) == ["c", "x"]
    assert apply(spark, X.json_slice, ['say {"a": 1} ok', "{x}", "none"]) == [True, False, False]
    assert apply(spark, X.short_id, ["a-b-c", "a"]) == ["b-c", "a"]
    assert apply(spark, lambda c: X.common_prefix(c, F.lit("abcd")), ["abxd", "abcd", "abcde", "", "x"]) == [2, 4, 4, 0, 0]


def test_hashes(spark):
    import hashlib

    h = int.from_bytes(hashlib.sha256(b"7|x").digest()[:8], "big")
    assert int(apply(spark, lambda c: X.stable_hash(F.lit("7"), c), ["x"])[0]) == h
    u = int.from_bytes(hashlib.sha256(b"k").digest()[:4], "big") / 0xFFFFFFFF
    assert apply(spark, X.uniform, ["k"])[0] == pytest.approx(u, abs=0)


def test_functions_in_sql(spark):
    X.register(spark)
    assert spark.sql("""SELECT pl_normalise_json('{"b":1,"a":2}') AS x""").first().x == '{"a":2,"b":1}'
