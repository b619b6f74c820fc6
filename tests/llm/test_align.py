"""Tokenizer alignment against a brute force over byte ranges."""

import hashlib
import itertools
from collections import Counter, defaultdict

import pytest
import sentencepiece
from tokenizers import Tokenizer

from lodestrata.llm import align
from lodestrata.llm.common import stored

FOLDER = align.tokenizer_folder()
FILES = f"{FOLDER}/byte_bpe_50k.json", f"{FOLDER}/piece_bpe_32k.model"
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def brute(rows):
    """All token pairs of a document, compared by their byte ranges; the files' own libraries and nothing of the operator."""
    a, b = Tokenizer.from_file(FILES[0]), sentencepiece.SentencePieceProcessor(model_file=FILES[1])
    a.encode_special_tokens = True
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    char = {chr(x): x for x in own} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in own)}

    def spans(parts):
        out, at = [], 0
        for i, raw in parts:
            out.append((i, at, at + len(raw)))
            at += len(raw)
        return out

    told, seen = [], Counter()
    for doc_id, text in rows:
        groups, links = [], []
        if text:
            whole = (" " + text).encode()
            pa_ = [(i, bytes(char[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
            pb_ = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
            if b"".join(x for _, x in pa_) == whole == b"".join(x for _, x in pb_):
                sa, sb = spans(pa_), spans(pb_)
                end_a, end_b, i, j = {e for *_, e in sa}, {e for *_, e in sb}, 0, 0
                for cut in sorted(end_a & end_b):
                    ga = list(itertools.takewhile(lambda x: x[1] < cut, itertools.islice(sa, i, None)))  # noqa: B023
                    gb = list(itertools.takewhile(lambda x: x[1] < cut, itertools.islice(sb, j, None)))  # noqa: B023
                    i, j = i + len(ga), j + len(gb)
                    groups.append((ga, gb))
                    links += [(x[0], y[0]) for x in ga for y in gb if x[1] < y[2] and y[1] < x[2]]
        seen.update(set(links))
        told.append((doc_id, groups, links))
    best = defaultdict(int)
    for (x, _), n in seen.items():
        best[x] = max(best[x], n)
    return sorted(
        ((doc_id, sum(len(g) for g, _ in groups), sum(len(h) for _, h in groups), len(groups), len(links), sum(seen[p] == best[p[0]] for p in links), sum(seen[p] for p in links), hashlib.sha256(";".join(",".join(str(x[0]) for x in g) + "|" + ",".join(str(x[0]) for x in h) for g, h in groups).encode()).hexdigest() if groups else "") for doc_id, groups, links in told),
        key=str,
    )


ROWS = [
    (1, "The quick brown fox jumps over the lazy dog."), (2, "naïve café — 東京タワー 🙂🙂 Ünïcödé"), (3, None), (4, ""), (5, " "), (6, "  two  spaces \n\n and\tlines\r\n"),
    (7, "<|endoftext|> <s> </s> <unk> <0x41> [INST]"), (8, "a▁b"), (9, "\x00\x01\x7f"), (10, "The quick brown fox jumps over the lazy dog."), (10, "The quick brown fox jumps over the lazy dog."),
    (None, "fox fox fox fox 12345 3.14159"), (11, "é ﬁ ① Å ​­﻿"), (12, "x" * 3000), (13, " " * 900 + "end"), (14, "don't we'll I'M 'tis   　x"),
    (15, " ".join(f"word{i}{chr(97 + i % 26) * (i % 7)}" for i in range(600))),
]


@pytest.fixture(scope="module")
def told():
    return brute(ROWS)


def run(spark, rows, **how):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, pairs string, n_a int").repartition(3)
    groups = stored(align.align(docs, *FILES), "test-align")
    return sorted((tuple(r[c] for c in COLUMNS) for r in align.score_links(groups, stored(align.pair_counts(groups), "test-align"), **how).collect()), key=str)


def test_all_pairs_of_byte_ranges(spark, told):
    assert run(spark, ROWS) == told
    by_id = {r[0]: r for r in told}
    assert all(by_id[i][1:] == (0, 0, 0, 0, 0, 0, "") for i in (3, 4, 8))
    assert by_id[1][1] > 5 and by_id[15][4] > 1000


def test_counts_dealt_in_shards(spark, told, monkeypatch):
    monkeypatch.setattr(align, "SHARD_PAIRS", 1000)
    assert run(spark, ROWS, most_pairs=10) == told


def test_empty_table(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, None)]) == [(1, 0, 0, 0, 0, 0, 0, "")]


def test_whole_table(spark):
    from lodestrata.llm.common import table

    docs = [(r.doc_id, r.text) for r in table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text").collect()]
    got = sorted((tuple(r[c] for c in COLUMNS) for r in align.op13_tokenizer_alignment(spark, "/root/testdata/sf0.001").collect()), key=str)
    assert got == brute(docs)


def test_the_fast_library_gives_the_files_ids():
    own = Tokenizer.from_file(FILES[0])
    own.encode_special_tokens = True
    for text in (t for _, t in ROWS if t):
        assert align.byte_level(FILES[0]).encode(" " + text) == own.encode(" " + text, add_special_tokens=False).ids


def test_long_pieces_are_seen():
    n = align.LONG_PIECE
    for text, long in (("a " * 900, False), ("x" * (n - 1), False), ("a " + "x" * n, True), ("a" + " " * n + "b", True), ("a" + " \n" * n, True), (" " * (n - 1) + "a b c", False), ("a  " * n, False), ("", False), (" " * n, True)):
        assert align.has_long_piece(text) == long
