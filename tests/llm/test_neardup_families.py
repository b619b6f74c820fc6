import random

from lodestrata.llm import neardup
from lodestrata.llm.common import ASCII_LOWER, WORD_RE, low_words


def _brute(texts):
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in texts)]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(texts))]


def test_texts_around_a_common_core_are_not_all_compared(spark, monkeypatch):
    rng = random.Random(5)
    core, texts = [f"c{i}" for i in range(120)], []
    for _ in range(500):
        words, rate = list(core), rng.uniform(0, 0.16)
        texts.append(" ".join(f"r{rng.randrange(10**6)}" if rng.random() < rate else w for w in words))
    seen, links = [], neardup._Join.links

    def counted(self, pairs):
        seen.append(pairs.distinct().count())
        return links(self, pairs)

    monkeypatch.setattr(neardup._Join, "links", counted)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(df).collect()}
    assert [got[i] for i in range(len(texts))] == _brute(texts)
    assert sum(seen) < 30 * len(texts), seen


def test_branches_of_a_family_do_not_multiply(spark, monkeypatch):
    rng = random.Random(7)
    core, texts = [f"c{i}" for i in range(120)], []
    for _ in range(400):
        words, rate = list(core), rng.uniform(0, 0.16)
        texts.append(" ".join(f"r{rng.randrange(10**6)}" if rng.random() < rate else w for w in words))
    rows, deeper = spark.sparkContext.accumulator(0), neardup._deeper

    def counted(batches):
        for b in deeper(batches):
            rows.add(b.num_rows)
            yield b

    monkeypatch.setattr(neardup, "_deeper", counted)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(df).collect()}
    assert [got[i] for i in range(len(texts))] == _brute(texts)
    assert 0 < rows.value < 2 * neardup.TREES * len(texts), rows.value


def test_words_are_those_of_the_rule():
    text = "A\x1cb \x85c\xa0D e \x0bF\x0c\rG\tÉÀİ \ud800x\n\x00"
    assert low_words(text) == [w.encode("utf-8", "surrogatepass") for w in WORD_RE.findall(text.translate(ASCII_LOWER))]
