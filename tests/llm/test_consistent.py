import itertools
import unicodedata

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from paritylens.llm import consistent as C
from paritylens.llm.lookalikes import LOOKALIKES

POOL = list("aeouAO -1") + ["é", "ü", "Å", "ﬁ", "Ａ", "½", "²", "가", "ᄀ", "ᅡ", "ᆨ", "а", "Ο", "ӓ", "́", "̈", "̣", "̧", "̰", "ǖ", "ᾂ", "़", "ে", "া", "\U0001D400"]


def forms(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    return {r.id: r.form for r in C.consistent_form(df, "text").collect()}


def expected(text):
    looks = lambda s: "".join(LOOKALIKES.get(c, c) for c in s)
    return unicodedata.normalize("NFC", looks(unicodedata.normalize("NFKD", looks(text))))


@settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet=st.sampled_from(POOL), max_size=12), min_size=40, max_size=60))
def test_equals_normalisation_of_mapped_text(spark, texts):
    got = forms(spark, texts)
    assert got == {i: expected(t) for i, t in enumerate(texts)}


def test_what_a_reader_does_not_see(spark):
    same = ["Café au lait-1", "Café au lait-1", "Ｃａｆé au lait‑1", "C​af­é au lait-1", "Саfé au lait-1"]
    assert len(set(forms(spark, same).values())) == 1
    different = ["Cafe au lait", "café au lait", "Café  au lait", "Café\nau lait", "Café au lait.", "Café\tau lait"]
    assert len(set(forms(spark, different).values())) == len(different)


def test_null_empty_long_and_other_columns(spark):
    long = "x́é" * 50_000
    df = spark.createDataFrame([(None, 1, 2), ("", 1, 2), (long, 1, 2), (long, 3, 4)], "text string, id int, k int")
    got = C.consistent_form(df, "text").collect()
    assert sorted((r.form is None, r.form == "", r.k) for r in got) == [(False, False, 2), (False, False, 4), (False, True, 2), (True, False, 2)]
    assert {r.form for r in got if r.form} == {unicodedata.normalize("NFC", long)}
    assert C.consistent_form(df.limit(0), "text").count() == 0


def test_pairs_are_those_of_brute_force(spark):
    texts = ["abc", "аbc", "ａbc", "abc", "abd", None, "", "ABC", "x​", "x", "x"]
    df = spark.createDataFrame([("t", i, t, "clash") for i, t in enumerate(texts)], "tbl string, id long, text string, form string")
    got = {tuple(r) for r in C.lookalike_pairs(df, ["tbl"], "id", "text").collect()}
    want = {("t", a, b) for (a, x), (b, y) in itertools.combinations(list(enumerate(texts)), 2) if x is not None and y is not None and x != y and forms(spark, [x, y])[0] == forms(spark, [x, y])[1]}
    assert got == want


def test_a_hot_class_is_listed_by_its_first_records(spark, monkeypatch):
    monkeypatch.setattr(C, "REPRESENTATIVES", 3)
    monkeypatch.setattr(C, "HOT_GROUP", 20)
    df = spark.range(60).select(F.lit("t").alias("tbl"), "id", F.when(F.col("id") == 0, "аbc").otherwise("abc").alias("text"))
    got = C.lookalike_pairs(df, ["tbl"], "id", "text").collect()
    assert {(r.id_a, r.id_b) for r in got} >= {(0, i) for i in range(1, 60)}
    classes = C.same_form_classes(df, ["tbl"], "id", "text").collect()
    assert len(classes) == 60 and {(r.n_records, r.n_texts) for r in classes} == {(60, 2)}


def test_a_hot_text_hides_no_pair_of_other_texts(spark, monkeypatch):
    monkeypatch.setattr(C, "REPRESENTATIVES", 3)
    monkeypatch.setattr(C, "HOT_GROUP", 20)
    if hasattr(C, "BLOCK"):
        monkeypatch.setattr(C, "BLOCK", 7)
    texts = {**{i: "abc" for i in range(1, 41)}, 50: "аbc", 51: "ａbc", **{i: "abс" for i in range(60, 72)}}
    df = spark.createDataFrame([("t", i, t) for i, t in texts.items()], "tbl string, id long, text string")
    got = [(r.id_a, r.id_b) for r in C.lookalike_pairs(df, ["tbl"], "id", "text").collect()]
    place = {i: sum(texts[j] == t for j in texts if j < i) for i, t in texts.items()}
    want = {(a, b) for a, b in itertools.combinations(texts, 2) if texts[a] != texts[b] and min(place[a], place[b]) <= 3}
    assert len(got) == len(set(got)) and set(got) == want


def test_every_copy_of_a_hot_text_meets_the_other_one(spark):
    texts = {**{i: "Cafe\u0301 Bar" for i in range(1, 71)}, 100: "Caf\u00e9 Bar"}
    df = spark.createDataFrame([("t", i, t) for i, t in texts.items()], "tbl string, id long, text string")
    assert sorted((r.id_a, r.id_b) for r in C.lookalike_pairs(df, ["tbl"], "id", "text").collect()) == [(i, 100) for i in range(1, 71)]
