from lodestrata.operators import strata


def test_seeds_share_one_numbering(spark, monkeypatch):
    """Draws of several seeds at once are those of each by itself, and items are numbered once."""
    items = spark.createDataFrame([(i, [str(i)[: n + 1] for n in range(len(str(i)))]) for i in range(60)], "id long, path array<string>")
    bands = [(1, 2), (3, 4)]
    alone = {s: sorted(map(tuple, strata.stratified_pairs(items, bands, 9, s).collect())) for s in "01"}
    made, plain = [], strata.running
    monkeypatch.setattr(strata, "running", lambda *a: made.append(a[-1]) or plain(*a))
    both = strata.stratified_pairs(items, bands, 9, ["0", "1"]).collect()
    assert {s: sorted(tuple(r)[1:] for r in both if r.seed == s) for s in "01"} == alone
    assert made == ["items", "cells"]
