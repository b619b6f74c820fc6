"""The prefix trie against a dictionary of prefixes, and its parts against loops."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from lodestrata.llm import trie

from comparison import duck, same

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest(), role, text))
    own = {c: [x[3:] for x in sorted(t)] for c, t in own.items()}
    nodes, kids = defaultdict(list), defaultdict(set)
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(np.fmod(c, 100))
        whole[c] = tuple(own.get(base, [])[:h] + turns[h:])
        for d in range(len(whole[c]) + 1):
            nodes[whole[c][:d]].append(c)
            if d:
                kids[whole[c][: d - 1]].add(whole[c][:d])
    leaves, saved = defaultdict(int), defaultdict(int)
    for key, of in nodes.items():
        for d in range(len(key) + 1):
            leaves[key[:d]] += not kids[key]
            saved[key[:d]] += (len(of) - 1) * len(key[-1][1]) if key else 0
    ends = defaultdict(list)
    for c in sorted(whole):
        ends[whole[c]].append(str(c))
    return sorted(((min(of), len(k), min(nodes[k[:-1]]) if k else None, len(of), len(kids[k]), leaves[k], saved[k], hashlib.sha256(",".join(ends[k]).encode()).hexdigest()) for k, of in nodes.items()), key=str)


def run(spark, rows, **how):
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, depth int, r string").repartition(3)
    return sorted((tuple(r[c] for c in COLUMNS) for r in trie.prefix_trie(frame, **how).collect()), key=str)


def some_rows(n, longest, seed):
    """Few different turns, so prefixes are shared at all depths; copies, nulls, turns without a number, a long conversation, ids below 0."""
    rng, rows = random.Random(seed), []
    for c in range(-40, n):
        copy = rng.random() < 0.3
        length = rng.choice([1, 2, 3, 5, 9, longest])
        for t in range(length):
            rows.append((c, None if rng.random() < 0.02 else t, rng.choice(["user", "assistant", None]) if not copy else "user", None if rng.random() < 0.05 else "ab" * (1 if copy else rng.randint(0, 2))))
    rows += [(None, 0, "user", "lost"), (5, 0, "user", "twice"), (5, 0, "user", "twice"), (7777, 3, None, None)]
    rows += [(3000, t, "user", " ".join(f"word{t}{i}" for i in range(20_000))) for t in range(4)]
    return rows


@pytest.mark.parametrize("width, block", [(2, 3), (32, 1 << 16)])
def test_dictionary_of_prefixes(spark, width, block):
    rows = some_rows(90, 40, width)
    assert run(spark, rows, width=width, block=block) == brute(rows)


def test_small_tables(spark):
    assert run(spark, []) == []
    for rows in ([(7, 0, "user", "hello")], [(c, 0, "user", "same") for c in range(12)]):
        assert run(spark, rows) == brute(rows)


def test_smaller_values(spark):
    rng = np.random.default_rng(5)
    for _ in range(40):
        v = rng.integers(0, 5, rng.integers(1, 60))
        before, after = trie._smaller(v)
        for i, x in enumerate(v):
            assert before[i] == max((j for j in range(i) if v[j] < x), default=-1)
            assert after[i] == min((j for j in range(i + 1, len(v)) if v[j] < x), default=len(v))
    v = [int(x) for x in rng.integers(0, 9, 300)]
    frame = spark.createDataFrame([(i + 1, x) for i, x in enumerate(v)], "i long, v long")
    line = [-1, *v, -1]
    for r in trie.nearest_smaller(frame, 301, block=7).collect():
        p = max(j for j in range(r.i) if line[j] < r.v)
        n = min(j for j in range(r.i + 1, 302) if line[j] < r.v)
        assert (r.p, r.pv, r.n, r.nv) == (p, line[p], n, line[n])
    values = spark.createDataFrame(list(enumerate(v)), "r long, value long")
    asked = [(s, e) for s in range(0, 300, 17) for e in range(s, 300, 23)]
    got = {(r.s, r.e): r.least for r in trie.interval_minima(values, spark.createDataFrame(asked, "s long, e long"), 300, block=7).collect()}
    assert got == {(s, e): min(v[s : e + 1]) for s, e in asked}


def test_sql(spark):
    folder = "/root/testdata/sf0.001"
    same(trie.op11_prefix_trie(spark, folder), duck(folder), trie.OP11_SQL)
