import base64
import hashlib
import itertools
import random

from pyspark.sql import functions as F

from lodestrata.llm import mixing, warc
from lodestrata.llm.common import word_count


def brute_targets(sizes, weights, most=3):
    """Water filling by bisection on the level."""
    total = sum(sizes.values())
    lo, hi = 0.0, 1e12
    for _ in range(200):
        mid = (lo + hi) / 2
        if sum(min(most * sizes[s], mid * weights[s]) for s in sizes) < total:
            lo = mid
        else:
            hi = mid
    return {s: min(most * sizes[s], hi * weights[s]) for s in sizes}


def test_targets():
    r = random.Random(1)
    for _ in range(50):
        sizes = {f"s{i}": r.choice([0, 1, 10, 500, 10_000]) for i in range(r.randrange(1, 9))}
        if sum(sizes.values()):
            weights = {s: i % 3 + 1 for i, s in enumerate(sorted(sizes))}
            got, want = mixing.fill_targets(sizes, weights, sum(sizes.values()), 3), brute_targets(sizes, weights)
            assert all(abs(got[s] - want[s]) < 1e-3 * (1 + want[s]) for s in sizes)


def test_flow_is_of_least_cost():
    """Against every way to share out small capacities."""
    r = random.Random(2)
    for _ in range(30):
        patterns = {("a",): r.randrange(4), ("b",): r.randrange(4), ("a", "b"): r.randrange(4)}
        quotas = {"a": r.randrange(9), "b": r.randrange(9)}
        got = mixing.route(patterns, quotas, 3)
        cost = lambda n, f: sum(max(0, f - e * n) for e in (1, 2))
        best = None
        for fa, fb, fab_a, fab_b in itertools.product(*(range(3 * n + 1) for n in (patterns["a",], patterns["b",], patterns["a", "b"], patterns["a", "b"]))):
            if fa + fab_a <= quotas["a"] and fb + fab_b <= quotas["b"] and fab_a + fab_b <= 3 * patterns["a", "b"]:
                key = (-(fa + fb + fab_a + fab_b), cost(patterns["a",], fa) + cost(patterns["b",], fb) + cost(patterns["a", "b"], fab_a + fab_b))
                best = key if best is None else min(best, key)
        assert (-sum(got.values()), sum(cost(patterns[k], got[k]) for k in patterns)) == best


def test_mix(spark):
    r = random.Random(3)
    rows = [(k, " ".join("w" for _ in range(r.randrange(0, 60))), r.choice(["b", "a", "c", "c", "c", None])) for k in range(300)]
    rows += [(300, None, "a"), (301, "", "d"), (302, "x y z", "e"), (303, "same row", "a"), (303, "same row", "a")]
    df = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, source string, size int")
    mixed, report = mixing.mix(df, word_count(F.col("text")), F.array("source"))
    got, targets = mixed.collect(), {x.source: x for x in report.collect()}
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    order = [*sorted(s for s in sizes if s is not None), None]
    want = brute_targets(sizes, {s: i % 3 + 1 for i, s in enumerate(order)})
    assert len(got) == len(rows)
    for s in sizes:
        assert targets[s].source_size == sizes[s] and abs(targets[s].target - want[s]) < 1e-3 * (1 + want[s])
        assert abs(sum(x.mix_taken for x in got if x.source == s) - targets[s].target) <= 2
    assert all(0 <= x.mix_taken <= 3 * x.mix_size for x in got)
    assert sorted(mixing.mix(df.repartition(7), word_count(F.col("text")), F.array("source"))[0].collect(), key=str) == sorted(got, key=str)


def test_overlapping_sources(spark):
    df = spark.createDataFrame([(k, "w " * 10, ["a", "b"] if k < 50 else ["b"]) for k in range(100)], "doc_id long, text string, sources array<string>")
    mixed, report = mixing.mix(df, word_count(F.col("text")), F.col("sources"), weights={"a": 1, "b": 3})
    assert {r.source: r.source_size for r in report.collect()} == {"a": 500, "b": 1000}
    assert sum(r.mix_taken for r in mixed.collect()) == 1000
    assert mixing.mix(df.limit(0), word_count(F.col("text")), F.col("sources"))[0].count() == 0


def test_base32(spark):
    for b in (b"", b"abc", b"x" * 1000):
        got = spark.range(1).select(warc.base32_sha1(F.lit(b))).first()[0]
        assert got == base64.b32encode(hashlib.sha1(b).digest()).decode()


def archive(spark, rows, tmp_path, **how):
    path = f"file://{tmp_path}/archive"
    warc.write_archive(spark.createDataFrame(rows, "page_id long, url string, html string, header string"), path, **how)
    return path


def test_round_trip(spark, tmp_path):
    rows = [(1, "http://a/1", "<p>é</p>", "x"), (2, "http://a/2\r\nX: y", "<p>é</p>", "x"), (3, None, None, "x"), (4, "u\\r\\\\n\\\r", "", "x"), (None, "v", "", "x"), (7, "w", "z" * 300_000, "x"), (9, "w", "q", "x"), (9, "w", "q", "x")]
    path = archive(spark, rows, tmp_path)
    assert warc.read_payloads(spark, path).count() == 4
    got = {(r.page_id, r.record_type, r.refers_to) for r in warc.read_records(spark, path).collect()}
    assert got == {(1, "revisit", 2), (2, "response", None), (3, "revisit", 4), (4, "response", None), (None, "revisit", 4), (7, "response", None), (9, "response", None), (9, "revisit", 9)}
    read = warc.read_records(spark, path).collect()
    assert sorted(str(r.url) for r in read) == sorted(str(u) for _, u, _, _ in rows)  # exact bytes, line ends included
    ids = [next(x for x in r.header.split("\r\n") if x.startswith("WARC-Record-ID")) for r in read]
    assert len(set(ids)) == len(ids)
    assert {x.split(": ", 1)[1] for r in read for x in r.header.split("\r\n") if x.startswith("WARC-Refers-To:")} <= {x.split(": ", 1)[1] for x in ids}
    built = warc.reconstruct(spark, path).collect()
    assert len(built) == len(rows)
    for r in built:
        head, _, body = bytes(r.record).partition(b"\r\n\r\n")
        assert head.startswith(b"WARC/1.1\r\n") and body.endswith(b"\r\n\r\n")
        assert body[:-4] == (b"" if r.record_type == "revisit" else bytes(r.payload))
    assert sorted(bytes(r.payload).decode() for r in built) == sorted(h or "" for _, _, h, _ in rows)


def test_small_payloads_and_damage(spark, tmp_path):
    path = archive(spark, [(1, "u", "ab", ""), (2, "v", "ab", ""), (3, "w", "abcdef", ""), (4, "x", "abcdef", "")], tmp_path, min_bytes=5)
    assert {(r.page_id, r.record_type) for r in warc.read_records(spark, path).collect()} == {(1, "response"), (2, "response"), (3, "revisit"), (4, "response")}
    bad = f"file://{tmp_path}/bad"
    spark.read.parquet(f"{path}/payloads").withColumn("payload", F.encode(F.lit("no"), "UTF-8")).write.parquet(f"{bad}/payloads")
    try:
        warc.read_payloads(spark, bad).collect()
        raise AssertionError("damage passed")
    except Exception as x:
        assert "digest" in str(x)


def test_empty_archive(spark, tmp_path):
    path = archive(spark, [], tmp_path)
    assert warc.reconstruct(spark, path).count() == 0
