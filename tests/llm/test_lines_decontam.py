import random

import pytest

from lodestrata.llm import decontam, lines


def line_sets(text):
    out = []
    for s in (text or "").split("\n"):
        w = [x for x in s.lower().replace("\t", " ").split(" ") if x]
        out.append(frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[i : i + 5]) for i in range(len(w) - 4)]))
    return out


def brute_lines(rows):
    seen, out = [], {}
    for doc, text in sorted(rows):
        keep = []
        for s, t in zip((text or "").split("\n"), line_sets(text)):
            if not (t and any(100 * len(t & o) >= 75 * len(t | o) for o in seen)):
                keep.append(s)
            if t:
                seen.append(t)
        out[doc] = "\n".join(keep) if text is not None else None
    return out


@pytest.mark.parametrize("limit", [1_000_000, -1])
def test_lines_against_brute_force(spark, limit):
    r = random.Random(5)
    word = lambda: "w" + str(r.randrange(200))
    pool = [[word() for _ in range(r.choice([1, 4, 5, 9, 30, 60]))] for _ in range(30)]
    rows = []
    for doc in range(40):
        text = []
        for _ in range(r.randrange(1, 6)):
            w = list(r.choice(pool)) if r.random() < 0.6 else [word() for _ in range(r.randrange(1, 40))]
            for _ in range(r.choice([0, 0, 1, 2])):
                w[r.randrange(len(w))] = word()
            text.append(" ".join(w).title() if r.random() < 0.1 else " ".join(w))
        rows.append((doc, "\n".join(text)))
    df = spark.createDataFrame([(*x, "y") for x in rows], "doc_id long, text string, at string")
    got = {x.doc_id: x.text for x in lines.dedup_lines(df, most_broadcast=limit).collect()}
    assert got == brute_lines(rows)


def test_line_cases(spark):
    rows = [(1, None), (2, ""), (3, "\n \n\t\n"), (4, "a b"), (5, "A  b\nc"), (6, "x " * 20_000), (7, "x " * 20_000 + "\nz")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: x.text for x in lines.dedup_lines(df).collect()}
    assert got == brute_lines(rows)
    same = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (2, "a b c"), (None, "q")], "doc_id long, text string")
    assert sorted(((x.doc_id, x.text) for x in lines.dedup_lines(same).collect()), key=str) == sorted([(1, "a b c"), (1, "a b c"), (2, ""), (None, "q")], key=str)
    assert lines.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_line_like_a_settled_one(spark):
    """The last line is like the second alone, which the first one settles; the first has all tokens in common that the two can meet by."""
    w = [f"w{i}" for i in range(44)]
    rows = [(1, " ".join(w)), (2, " ".join(w[:34])), (3, " ".join(w[:28]))]
    rows += [(4 + k, " ".join(w[24:] + [f"q{k}x{i}" for i in range(40)])) for k in range(5)]
    got = {x.doc_id: x.text for x in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_lines(rows)
    assert got[3] == ""


@pytest.mark.parametrize("size", [1_000, 5_000_000])
def test_batches_to_workers_are_bounded_by_bytes(spark, size):
    """Long texts don't fill a worker by the thousand, and the session keeps its own setting."""
    import pyarrow as pa

    from lodestrata.llm.common import BATCH, stored

    def held(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"])

    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    df = spark.range(0, 20_000_000 // size, 1, 1).selectExpr(f"repeat('x', {size}) AS t")
    most = stored(df.mapInArrow(held, "n long"), "test-batches").selectExpr("max(n)").first()[0]
    assert most <= BATCH + 2 * size and spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == before


def words(text):
    out, now = [], ""
    for c in (text or "") + " ":
        c = c.lower() if "A" <= c <= "Z" else c
        if c.isascii() and not (c.isdigit() or "a" <= c <= "z"):
            if now:
                out.append(now)
            now = ""
        else:
            now += c
    return out


def brute_decontam(docs, items):
    out = {}
    wins = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - 9)) if w else ():
            wins.setdefault(tuple(w[k : k + 10]), set()).add("" if i is None else str(i))
    for doc, t in docs:
        w, hit, ids = words(t), set(), set()
        for win, own in wins.items():
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k : k + len(win)]) == win:
                    hit.update(range(k, k + len(win)))
                    ids |= own
        if hit:
            out[doc] = (len(hit), sorted(ids))
    return out


@pytest.mark.parametrize("limit", [100_000, -1])
def test_decontam_against_brute_force(spark, limit):
    r = random.Random(9)
    word = lambda: r.choice(["the", "of", "É", "é", "x1", "y2", "Zed", "q" + str(r.randrange(30))])
    items = [(k, " ".join(word() for _ in range(r.choice([1, 2, 9, 10, 11, 25])))) for k in range(12)] + [(3, "the the the"), (None, "lone item"), (50, None), (51, "--")]
    docs = []
    for k in range(60):
        w = [word() for _ in range(r.randrange(0, 50))]
        if k % 3 == 0:
            w[5:5] = r.choice(items[:12])[1].upper().split()
        docs.append((k, r.choice([" ", ", ", "\n"]).join(w)))
    docs += [(100, None), (101, ""), (102, "LONE-item!"), (103, "lone item " * 5000)]
    d = spark.createDataFrame([(*x, 0) for x in docs], "doc_id long, text string, len int")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {x.doc: (x.n_hit, x["items"]) for x in decontam.decontaminate(d, b, most_broadcast=limit).collect()}
    assert got == brute_decontam(docs, items)


def test_decontam_empty(spark):
    d, b = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    full = spark.createDataFrame([(1, "a b c")], "k long, text string")
    assert decontam.decontaminate(d, full.withColumnRenamed("k", "item_id")).count() == 0
    assert decontam.decontaminate(full.withColumnRenamed("k", "doc_id"), b).count() == 0


def test_decontam_beyond_ascii(spark):
    """Lower-casing A-Z alone, whatever stands beside a letter: sigma before a dot, dotted and dotless i, the Kelvin sign; repeated rows and null ids."""
    letters = "\u039f\u0394\u039f\u03a3"
    items = [(1, f"{letters}.\u0391\u0392\u0393 alpha beta gamma delta epsilon zeta eta theta iota"), (2, "\u0130stanbul \u212aelvin I\u0131 one two"), (3, f"{letters.lower()} {letters}"), (3, "x y"), (None, "alone \u03c3\u03c2")]
    docs = [(1, items[0][1]), (2, items[0][1].replace(".", " ")), (3, "so \u0130STANBUL, \u212aELVIN i\u0131 ONE two."), (4, "istanbul kelvin i\u0131 one two"), (5, f"{letters}' {letters}"), (6, f"{letters.lower()}'{letters}."), (None, "ALONE-\u03c3\u03c2!"), (7, "alone \u03c3\u03c3"), (1, items[0][1])]
    d = spark.createDataFrame([(*x, 0, 0) for x in docs], "doc_id long, text string, th int, w int")
    for limit in (100_000, -1):
        got = {x.doc: (x.n_hit, x["items"]) for x in decontam.decontaminate(d, spark.createDataFrame(items, "item_id long, text string"), most_broadcast=limit).collect()}
        assert got == brute_decontam(docs, items) and len(got) == 5 and got[1][0] == 11


def test_lines_with_clashing_columns(spark):
    names = "doc_id long, text string, _h int, _doc int, doc int, th int, at int, gone int, row int, own int, hash int, line_count int"
    df = spark.createDataFrame([(k, "a b c d e f\nx" if k < 2 else f"t{k}", *range(10)) for k in range(3)], names)
    got = lines.dedup_lines(df)
    assert got.columns == [*df.columns, "lines_removed"]
    assert sorted((r.doc_id, r.text, r._h, r._doc, r.hash, r.line_count, r.lines_removed) for r in got.collect()) == [(0, "a b c d e f\nx", 0, 1, 8, 2, 0), (1, "", 0, 1, 8, 2, 2), (2, "t2", 0, 1, 8, 1, 0)]
