import random
from fractions import Fraction

import regex

from paritylens.llm.repetition import order_rules, repeated_share, repetitive, rules
from paritylens.llm.words import WORD, words


def brute(text, run=5):
    w = regex.findall(WORD, text.lower())
    seen, again = set(), [False] * len(w)
    for i in range(len(w) - run + 1):
        g = tuple(w[i : i + run])
        if g in seen:
            again[i : i + run] = [True] * run
        seen.add(g)
    return len(w), sum(again)


def texts(n=150):
    g = random.Random(7)
    out = []
    for i in range(n):
        w = [f"w{g.randint(0, 30)}" for _ in range(g.randint(0, 80))]
        for _ in range(g.randint(0, 4)):
            if len(w) > 8:
                p, k = g.randrange(len(w) - 6), g.randint(3, 9)
                w += w[p : p + k]
        out.append((i, " ".join(w)))
    return [*out, (900, "und " * 60), (901, ""), (902, "a b c d"), (903, "a b c d e " * 2)]


def test_shares_are_exact(spark):
    rows = texts()
    df = spark.createDataFrame([*((*r, 1) for r in rows), (None, None, 1)], "id long, text string, w int")
    got = {r.id: (r.n_words, r.n_repeated) for r in repeated_share(df, "id", "text").collect()}
    assert got == {i: brute(x) for i, x in rows}


def test_cases_do_not_depend_on_the_order_of_rules(spark):
    rows = texts()
    df = spark.createDataFrame(rows, "id long, text string")
    want = {i for i, x in rows if brute(x)[0] >= 40 and brute(x)[1] * 10 >= brute(x)[0] * 3}
    assert {r.id for r in repetitive(df, "id", "text").collect()} == want
    for name, rule in rules(5, 40, Fraction("0.3")).items():
        kept = {r.id for r in df.where(rule(df.text, words(df.text))).collect()}
        assert want <= kept, name
    assert sorted(order_rules(df, "text", 5, 40, Fraction("0.3"))) == ["count", "kinds", "length", "pairs"]


def test_repeated_rows_long_text_and_no_rows(spark):
    long = " ".join(f"v{i % 9000}" for i in range(20_000))
    df = spark.createDataFrame([(1, long), (1, long), (2, "a")], "id long, text string")
    assert sorted(r.id for r in repetitive(df, "id", "text").collect()) == [1, 1]
    assert repetitive(df.limit(0), "id", "text").count() == 0


def test_the_cheap_rule_comes_first_and_the_order_is_stable(spark):
    g = random.Random(3)
    rows = [(i, " ".join(f"w{g.randint(0, 500)}" for _ in range(g.choice([5, 20, 200])))) for i in range(2000)]
    df = spark.createDataFrame(rows, "id long, text string").repartition(5)
    orders = [order_rules(df, "text", 5, 40, Fraction("0.3")) for _ in range(3)]
    # Two thirds are short, which the length tells at next to no cost.
    assert all(o[0] == "length" for o in orders) and len({tuple(o) for o in orders}) == 1
    order = order_rules(df.where("length(text) > 300"), "text", 5, 40, Fraction("0.3"))
    assert order.index("kinds") < order.index("length")
