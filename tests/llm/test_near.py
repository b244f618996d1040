import random
from collections import Counter

import pytest
import regex

from paritylens.llm import near as N
from paritylens.llm import words

WORD = regex.compile(words.WORD)


def brute(rows, t=0.7):
    bags = [(i, Counter(WORD.findall(x.lower())), x) for i, x in rows if x is not None and i is not None]
    out = set()
    for a in range(len(bags)):
        for b in range(a + 1, len(bags)):
            (i, x, s), (j, y, u) = bags[a], bags[b]
            common, every = sum((x & y).values()), sum((x | y).values())
            if (every and common >= t * every - 1e-12) or (not every and s == u):
                out.add((min(i, j), max(i, j)))
    return {p for p in out if p[0] != p[1]}


def mails(n, seed=1):
    g = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)] + list("0123456789abc")
    rows = []
    for i in range(n):
        if rows and g.random() < 0.5:
            words = g.choice(rows)[1].split()
            for _ in range(g.randint(0, max(1, len(words) // 4))):
                p = g.randrange(len(words))
                words[p : p + g.randint(0, 1)] = [g.choice(vocab)] * g.randint(0, 1)
            g.shuffle(words) if g.random() < 0.3 else None
            rows.append((i, " ".join(words) or "x"))
        else:
            rows.append((i, " ".join(g.choice(vocab) for _ in range(g.randint(3, 40)))))
    return rows


@pytest.mark.parametrize("block,chunk", [(20_000, 200_000), (15, 50)])
def test_pairs_are_those_of_brute_force(spark, monkeypatch, block, chunk):
    monkeypatch.setattr(N, "BLOCK", block)
    monkeypatch.setattr(N, "CHUNK", chunk)
    rows = mails(260) + [(1000, None), (1001, ""), (1002, ""), (1003, "..."), (1004, "a b c"), (1005, "A, b. C!"), (None, "a b c")]
    df = spark.createDataFrame(rows, "id long, text string")
    got = [tuple(r) for r in N.near_pairs(df, "id", "text", 0.7).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute(rows)


def test_single_letters_do_not_collide(spark):
    rows = [(i, f"{a} {a} {b} q w e r t z") for i, (a, b) in enumerate([("6", "7"), ("7", "6"), ("c", "d"), ("a", "b")])]
    df = spark.createDataFrame(rows, "id long, text string")
    assert {tuple(r) for r in N.near_pairs(df, "id", "text", 0.7).collect()} == brute(rows)


def test_classes_members_and_links(spark):
    rows = [(1, "a b c d e f g h i j"), (2, "J i h g f e d c b a"), (3, "a b c d e f g h i k"), (4, "z")]
    df = spark.createDataFrame([(*r, 0, "x") for r in rows], "id long, text string, n int, tokens string")
    members, links = N.near_classes(df, "id", "text", 0.8)
    assert {(r.id, r.rep, r.n_records) for r in members.collect()} == {(1, 1, 2), (2, 1, 2), (3, 3, 1), (4, 4, 1)}
    assert [(r.rep_a, r.rep_b, round(r.similarity, 6)) for r in links.collect()] == [(1, 3, round(9 / 11, 6))]


def test_repeated_rows_long_texts_and_no_rows(spark):
    long = " ".join(f"v{i}" for i in range(30_000))
    df = spark.createDataFrame([(1, long), (1, long), (2, long + " more"), (3, "short")], "id long, text string")
    assert {tuple(r) for r in N.near_pairs(df, "id", "text", 0.8).collect()} == {(1, 2)}
    assert N.near_pairs(df.limit(0), "id", "text", 0.8).count() == 0


def test_different_texts_of_large_classes_are_all_paired(spark, monkeypatch):
    if hasattr(N, "PIECE"):
        monkeypatch.setattr(N, "PIECE", 30)
    g = random.Random(2)
    words = [f"w{i}" for i in range(20)]
    rows = []
    for i in range(150):
        g.shuffle(words)
        rows.append((i, " ".join(words + ["end" if i % 2 else "stop"])))
    # Copies of one text are only met by the first of them.
    rows += [(1000 + i, "one two three four five") for i in range(70)] + [(2000 + i, f"five four {x}") for i, x in enumerate(["three two one", "two three one"])]
    got = [tuple(r) for r in N.near_pairs(spark.createDataFrame(rows, "id long, text string"), "id", "text", 0.7).collect()]
    assert len(got) == len(set(got)) and set(got) == {(a, b) for a, b in brute(rows) if not 1065 <= a < 2000 or b >= 2000}
