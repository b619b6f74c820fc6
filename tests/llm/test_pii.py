"""Personal data: base spans against the plain patterns, the dynamic programme against all ways to cut, and what the model finds and leaves."""

import hashlib
import itertools
import math
import random
import re
import time

import pytest

from lodestrata.llm import pii
from lodestrata.llm.common import table

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain(text):
    def fits(kind, said):
        d = re.sub("[^0-9]", "", said)
        if kind == "card":
            return 14 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(d[::-1])) % 10 == 0
        return kind == "email" or (10 <= len(d) <= 15 if kind == "phone" else all(int(x) <= 255 for x in said.split(".")))

    found = [(m.start(), list(PLAIN).index(k), k, m.end()) for k, p in PLAIN.items() for m in re.finditer(p, text) if fits(k, m[0])]
    return [(s, e, k) for s, _, k, e in sorted(found)]


@pytest.fixture(scope="module")
def rows(spark):
    return [(r.doc_id, r.text) for r in table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def model(rows):
    found = {(t[s:e], t[s - 1 : s], t[e : e + 1], pii.joined([(a - s, b - s, k) for a, b, k in pii.base_spans(t) if s <= a < e])) for _, t in rows if t for s, e in pii.stretches(t)}
    return pii.learn(pii.examples(sorted(found)))


def test_base_spans_are_the_patterns():
    rng, signs = random.Random(3), "0123456789012345.. -+()@ax_%:é"
    texts = ["".join(rng.choices(signs, k=rng.randint(0, 40))) for _ in range(20_000)]
    texts += ["1.2.3.4.5.6.7.8.9", "001.002.0003.255", "1.2.3.256", "a@b.c@d.e@f", "@a.b", "a@@b.c", "x.@y.zz. a@b-.c-", "٣+1 (603) 555-8791", "4111 1111-1111 1111", "a@b..c a@b.c."]
    for t in texts:
        assert pii.base_spans(t) == plain(t), t


def test_long_runs_cost_their_length():
    began = time.time()
    for t in ("a" * 400_000, "1" * 400_000, "1." * 200_000, "+" * 200_000, "a@" * 200_000, "a at " * 80_000, "1 " * 100_000, " ".join(f"word{i}" for i in range(60_000)), "+1 (" * 100_000):
        pii.base_spans(t), pii.stretches(t)
    assert time.time() - began < 30


def test_all_ways_to_cut():
    rng = random.Random(4)
    for text in ("+1 (603) 555-8791 170.106.47.218", "12 4111111111111111 4111111111111111", "1.2.3.4 5.6.7.8", "603 555 8791 603 555 8791", "ann at mail dot example dot com"):
        g = pii.Graph(pii.candidates(text, " ", " "))
        m = pii.Model()
        m.weights = {f: rng.uniform(-1, 1) for *_, fs in g.spans for f in fs} | {f"{a}>{b}": rng.uniform(-1, 1) for a in range(5) for b in range(1, 5)}

        def ways(t, y):
            """(score, spans) of all ways from point t after label y."""
            if t == len(g.points) - 1:
                yield 0.0, ()
                return
            for score, rest in ways(t + 1, 0):
                yield score, rest
            for n, (s, e, label, fs) in enumerate(g.spans):
                if s == t:
                    own = sum(m.weights[f] for f in fs) + m._step(y, label)
                    for score, rest in ways(e, label):
                        yield own + score, (n, *rest)

        every = list(ways(0, 0))
        assert len(every) > 1
        assert m.best(g) == list(max(every, key=lambda w: w[0])[1])
        total, expected = m.expected(g)
        assert math.isclose(total, math.log(sum(math.exp(s) for s, _ in every)), rel_tol=1e-9)
        for f in itertools.islice(sorted(m.weights), 0, None, 7):
            if " " in f:
                want = sum(math.exp(s - total) * sum(g.spans[n][3].count(f) for n in ns) for s, ns in every)
                assert math.isclose(expected[f], want, rel_tol=1e-7, abs_tol=1e-12)


def test_rewritings_that_were_not_learned_from(model):
    rng, good, wrong, n, clean = random.Random(99), 0, 0, 0, 0
    for _ in range(150):
        d = "".join(rng.choices("0123456789", k=15))
        card = next(d + c for c in "0123456789" if pii.luhn(d + c))
        spans = {"card": card, "ip": ".".join(str(rng.randint(0, 255)) for _ in range(4)), "phone": f"+1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}", "email": f"{rng.choice(['kim', 'lee'])}.{rng.randint(1, 99)}@mail{rng.randint(0, 9)}.example.com"}
        for kind, said in spans.items():
            cases = pii.rewritten(kind, said, rng)
            if kind != "email":
                other = spans[rng.choice(["card", "ip", "phone"])]
                cases.append((f"{said} {other}", [(0, len(said), kind), (len(said) + 1, len(said) + 1 + len(other), next(k for k, v in spans.items() if v == other))]))
            for text, gold in cases:
                whole = f"see {text}, and so on"
                base = pii.base_spans(whole)
                got = sorted(base + [x for s, e in pii.stretches(whole) for x in pii.added(model, {"at": s, "text": whole[s:e], "left": whole[s - 1 : s], "right": whole[e : e + 1], "base": pii.joined([(max(a, s) - s, min(b, e) - s, k) for a, b, k in base if a < e and b > s])})])
                want = sorted((s + 4, e + 4, k) for s, e, k in gold)
                if gold:
                    n, good = n + 1, good + (want == got)
                else:
                    clean, wrong = clean + 1, wrong + bool(got)
    assert good > 0.9 * n and wrong < 0.02 * clean, (good, n, wrong, clean)


def test_rows(spark, rows):
    odd = [(None, "call +1 (603) 555-8791 170.106.47.218 now"), (1, None), (1, ""), (1, "mail kim.7@mail1.example.com"), (1, "mail kim.7@mail1.example.com"), (5, " ".join(f"no{i}" for i in range(50_000)))]
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in rows + odd], "doc_id long, text string, spans string, base string").repartition(4)
    got = pii.personal_data(docs).collect()
    assert len(got) == len(rows) + len(odd)
    key = lambda r: tuple(str(x) for x in r)
    want = []
    for i, t in rows + odd:
        base = plain(t or "")
        want.append((i, *(sum(k == kind for *_, k in base) for kind in PLAIN), hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, e, k in base).encode()).hexdigest()))
    assert sorted((tuple(r[c] for c in ("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256")) for r in got), key=key) == sorted(want, key=key)
    by_digest = {r.base_sha256: r for r in got}
    for i, t in rows + odd:
        base = plain(t or "")
        r = by_digest[hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, e, k in base).encode()).hexdigest()]
        spans = pii.split(r.spans)
        assert set(base) <= set(spans) and len(spans) == len(base) + r.n_added
    [call] = [r for r in got if r.doc_id is None]
    assert call.spans == "phone:5:22,ip:23:37"
    assert sum(r.n_added for r in got) < 0.1 * sum(sum(r[f"n_{k}"] for k in PLAIN) for r in got)


def test_no_base_spans(spark):
    docs = spark.createDataFrame([(1, "nothing 12 here"), (2, None)], "doc_id long, text string")
    assert [r.spans for r in pii.personal_data(docs).collect()] == ["", ""]
    assert pii.personal_data(docs.limit(0)).collect() == []
