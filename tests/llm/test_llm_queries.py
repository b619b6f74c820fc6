import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import corpus_pipeline
from comparison import duck, same
from lodestrata.llm import catalog, decontam, langid, neardup
from lodestrata.llm.common import WORD_RE

from test_lines_decontam import brute_decontam, brute_lines
from test_mixing_warc import brute_targets
from test_neardup import brute as brute_near

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_matches_sql(spark, name):
    same(catalog.QUERIES[name](spark, SF), duck(SF), catalog.ORACLES[name])


def test_native_operators_use_no_python(spark):
    for name in ("op7_line_dedup", "op10_decontamination"):
        plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_pipeline_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    model = langid.fit(docs)
    text = {k: r.text for k, r in rows.items() if (x := langid.grams(r.text)) is not None and model.predict(x)[2] >= corpus_pipeline.LEAST_LIKENESS}
    assert len(text) >= 0.97 * len(rows)
    left = brute_lines(list(text.items()))
    text = {k: t for k, t in left.items() if t == text[k] or WORD_RE.search(t)}
    near = brute_near(sorted(text.items()))
    text = {k: text[k] for k, _, c, _ in near if k == c}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    bad = brute_decontam(list(text.items()), items)
    text = {k: t for k, t in text.items() if k not in bad}
    sizes, size = {}, {k: len(WORD_RE.findall(t)) for k, t in text.items()}
    for k in text:
        sizes[rows[k].source] = sizes.get(rows[k].source, 0) + size[k]
    target = brute_targets(sizes, {s: i % 3 + 1 for i, s in enumerate(sorted(sizes))})
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in got} <= set(text) and len(got) == len({r.doc_id for r in got})
    assert all(r.text == text[r.doc_id] and r.mix_size == size[r.doc_id] and 0 < r.mix_taken <= 3 * r.mix_size for r in got)
    for s in sizes:
        assert abs(sum(r.mix_taken for r in got if r.source == s) - target[s]) <= 2


def test_stages_return_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    extra = docs.selectExpr("*", "1 AS score", "'x' AS kept", "2 AS th", "3 AS id")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, extra, SF)
        assert out.columns == extra.columns and dict(out.dtypes) == dict(extra.dtypes), name
        assert stage(spark, extra.limit(0), SF).count() == 0
        null = spark.createDataFrame([(None,) * 9], ", ".join(f"{n} {t}" for n, t in extra.dtypes))
        stage(spark, extra.unionByName(null), SF).count()
    assert corpus_pipeline.STAGES[-1][1](spark, extra.limit(0), SF).count() == 0
    assert decontam and neardup


def test_near_dedup_keeps_unrelated_texts_of_one_id(spark):
    one, two, three = ("alpha beta gamma delta epsilon zeta", "quite another text of some words", "and a third one that nobody links")
    rows = [(1, one, "a"), (1, two, "a"), (None, two + " x y z u v w", "a"), (None, three, "a"), (2, "more of it", "a"), (2, "more of it", "b"), (3, one, "a"), (None, None, "a"), (4, " ", "a"), (4, "", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = [(r.doc_id, r.text) for r in corpus_pipeline.near_dedup(spark, docs, SF).collect()]
    want = [(1, one), (1, two), (None, two + " x y z u v w"), (None, three), (2, "more of it"), (None, None), (4, " "), (4, "")]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_language_stage_rejects_what_was_not_learned(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = [
        "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem.", "Все люди рождаются свободными и равными в своем достоинстве и правах.",
        "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan.", "xqzv jkwq zzxk qwpl vbnm xcvq " * 5, "12345 --", None,
    ]
    known = {r.doc_id for r in docs.select("doc_id").collect()}
    # clean texts that nothing was learned from
    other = spark.read.parquet(SF.replace("0.001", "0.01") + "/documents.parquet").where("n_chars BETWEEN 300 AND 3000").join(spark.read.parquet(SF.replace("0.001", "0.01") + "/labels.parquet").where("quality = 1 AND toxic = 0"), "doc_id")
    fine = [r.text for r in other.orderBy("doc_id").collect() if r.doc_id not in known][:30]
    assert len(fine) >= 20
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    more = spark.createDataFrame([(10**9 + k, t, None, "x", 1) for k, t in enumerate(odd + fine)], schema)
    kept = {r.doc_id for r in corpus_pipeline.language_id(spark, docs.select("doc_id", "text", "lang", "source", "n_chars").unionByName(more), SF).collect()}
    assert {k for k in kept if k >= 10**9} == {10**9 + len(odd) + k for k in range(len(fine))}


def test_last_stage_and_op5_with_clashing_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(50).selectExpr("*", "1 AS mix_size", "2 AS mix_row", "3 AS MIX_TAKEN", "4 AS b")
    out = corpus_pipeline.mixing_sources(spark, docs, SF)
    assert [c.lower() for c in out.columns] == [*(c for c in docs.columns if not c.lower().startswith("mix_") or c == "mix_row"), "mix_size", "mix_taken"]
    assert out.count() > 0 and out.select("mix_row", "b").distinct().collect() == [(2, 4)]


def test_op5_query_against_brute_force(spark):
    rows = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = catalog.QUERIES["op5_mix_sources"](spark, SF).collect()
    size = {k: len(WORD_RE.findall(r.text or "")) for k, r in rows.items()}
    sizes = {}
    for k, r in rows.items():
        sizes[r.source] = sizes.get(r.source, 0) + size[k]
    target = brute_targets(sizes, {s: i % 3 + 1 for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))})
    assert sorted(r.doc_id for r in got) == sorted(rows)
    for r in got:
        s = rows[r.doc_id].source
        assert (r.size, r.source_size) == (size[r.doc_id], sizes[s]) and 0 <= r.taken <= 3 * r.size and abs(r.target - target[s]) <= 1e-3 * (1 + target[s])
    for s in sizes:
        assert abs(sum(r.taken for r in got if rows[r.doc_id].source == s) - target[s]) <= 2
