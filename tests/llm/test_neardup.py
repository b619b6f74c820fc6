import random

import pytest

from lodestrata.llm import neardup
from lodestrata.llm.common import WORD_RE
from lodestrata.llm.graph import components

SCHEMA = "doc_id long, text string, kept string"


def shingles(text):
    w = WORD_RE.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[i : i + 5]) for i in range(len(w) - 4)])


def brute(rows):
    sets = [(i, shingles(t)) for i, t, *_ in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j, (_, b) in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                root[find(i)] = find(j)
    low = {}
    for i, (doc, _) in enumerate(sets):
        k = find(i)
        low[k] = doc if low.get(k) is None else low[k] if doc is None else min(low[k], doc)
    return sorted(((doc, len(s), low[find(i)], doc == low[find(i)]) for i, (doc, s) in enumerate(sets)), key=str)


def told(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in df.collect()), key=str)


def corpus(seed):
    r = random.Random(seed)
    word = lambda: r.choice("abcdefgh") + r.choice("xyz") + str(r.randrange(60))
    rows, n = [], 0
    for _ in range(25):
        base = [word() for _ in range(r.choice([1, 3, 5, 12, 40, 120]))]
        for _ in range(r.choice([1, 1, 2, 6, 30])):
            w = list(base)
            for _ in range(r.randrange(0, 4)):
                w[r.randrange(len(w))] = word()
            rows.append((n, " ".join(w), "x"))
            n += 1
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rows = corpus(seed)
    assert told(neardup.near_duplicates(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_recursion_and_shuffled_texts(spark, monkeypatch):
    """With no node of several classes outside its largest component counting as small at first, no estimates and no broadcast, the deeper levels give the same."""
    monkeypatch.setattr(neardup, "REST", 1)
    rows = corpus(3)
    assert told(neardup.near_duplicates(spark.createDataFrame(rows, SCHEMA), slack=1.0, most_broadcast=-1)) == brute(rows)


def test_recall_at_the_threshold(spark):
    """Ten thousand pairs of similarity 0.75 to 0.8, in the company of others that share most of their minwise tokens: at least 0.99 are linked."""
    r = random.Random(11)
    rows, want = [], 0
    for k in range(10_000):
        w = [f"{r.randrange(10**6)}" for _ in range(64)]
        x = list(w)
        # one changed word in the middle costs five shingles of 60: 55 / 65 are shared; the second is at the end and costs one to three
        x[r.randrange(10, 50)] = "x"
        x[-1 - r.randrange(3)] = "y"
        a, b = shingles(" ".join(w)), shingles(" ".join(x))
        if 75 * len(a | b) <= 100 * len(a & b) <= 85 * len(a | b):
            want += 1
            rows += [(2 * k, " ".join(w), "x"), (2 * k + 1, " ".join(x), "x")]
    got = neardup.near_duplicates(spark.createDataFrame(rows, SCHEMA)).where("doc_id % 2 = 1 AND component_id = doc_id - 1").count()
    assert want > 5_000 and got >= 0.99 * want


def test_cases(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, " \t\n", "x"), (4, "One two", "x"), (5, "one TWO", "x"), (6, "É é", "x"), (7, "é É", "x"), (8, "w " * 30_000, "x"), (9, "w " * 29_000, "x"), (None, "one two", "x"), (None, "alone here", "x"), (4, "One two", "x")]
    assert told(neardup.near_duplicates(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_empty(spark):
    assert neardup.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(1, 200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5, 5)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 201)} | {i: 1000 for i in range(1000, 1300)}
