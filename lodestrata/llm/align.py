"""Alignment of two tokenizers over the same bytes.

Each byte of a text gets a label: no token ends here, one of A ends, one of B ends, or both. A regular expression over this label string
cuts it after each both-label; a span's labels say how many tokens of A and of B make up its group, and every label that isn't "none" ends
a stretch of bytes that lies in one token of A and one of B: a link. How many documents hold an id pair linked is counted over all of them.
"""

from __future__ import annotations

import hashlib
import importlib.util
import json
import os
import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

#: Fixed value: how the byte-level vocabulary's texts are cut before its merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_SPAN = re.compile(b"[12]*3")
#: Up to so many id pairs (12 bytes each) their counts go to every task; more are dealt out by pair, with the documents' pairs beside them.
MOST_PAIRS = 4_000_000
#: So many pairs of counts lie in one shard when they are dealt out.
SHARD_PAIRS = 1_000_000
#: So many pairs are counted together in a task before they are shuffled.
HELD_PAIRS = 4_000_000
#: Over so many tasks a shard's documents are dealt.
SALTS = 32
#: A word or run of blanks of so many characters is merged by the vocabulary file's own library, which is slower on usual words, but not on these.
LONG_PIECE = 400
_LONG_BLANK = re.compile(r"\s{%d}" % LONG_PIECE)

GROUPS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary"
_GROUPS = pa.schema([("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("pairs", pa.binary()), ("times", pa.binary())])


def tokenizer_folder() -> str:
    """Where the installed vocabulary files are; any other folder can be given to the operator."""
    return os.path.dirname(importlib.util.find_spec("public_tokenizers").origin)


def _byte_of_char() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, the others by number from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def has_long_piece(text: str) -> bool:
    """Whether a word or a run of blanks has LONG_PIECE characters or more."""
    words = text.split()
    if max(map(len, words), default=0) >= LONG_PIECE:
        return True
    blanks = len(text) - sum(map(len, words))
    # each gap between words has one blank at least, so a long run needs as many more
    return blanks >= LONG_PIECE + max(0, len(words) - 2) and bool(_LONG_BLANK.search(text))


class Vocabulary:
    """encode(text) -> ids, and the bytes of every id."""

    def __init__(self, encode: Callable[[str], list[int]], pieces: list[bytes]):
        self.encode, self.pieces = encode, pieces
        self.sizes = np.array([len(p) for p in pieces], np.int64)


@lru_cache(maxsize=4)
def byte_level(path: str) -> Vocabulary:
    """A byte-level BPE file (JSON). Ids of merged pieces rise with the rank of their merge, so ranks are the ids, and a library that merges by rank gives the same ids faster than the file's own, which still does long words; a file whose ids aren't so goes by its own library alone. Special tokens are plain text."""
    import tiktoken
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        said = json.load(f)
    special = {t["content"] for t in said.get("added_tokens", ())}
    byte = _byte_of_char()
    ids = {bytes(byte[c] for c in piece): i for piece, i in said["model"]["vocab"].items() if piece not in special}
    pieces = [b""] * (1 + max([*ids.values(), *(t["id"] for t in said.get("added_tokens", ()))]))
    for piece, i in ids.items():
        pieces[i] = piece
    own = Tokenizer.from_file(path)
    own.encode_special_tokens = True
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

    def slow(text: str) -> list[int]:
        return own.encode(text, add_special_tokens=False).ids

    merges = [m.split(" ") if isinstance(m, str) else m for m in said["model"]["merges"]]
    ranks = [said["model"]["vocab"].get("".join(m), -1) for m in merges]
    if ranks != sorted(set(ranks)) or len(ids) != 256 + len(merges):
        return Vocabulary(slow, pieces)
    fast = tiktoken.Encoding("byte-level", pat_str=PATTERN, mergeable_ranks=ids, special_tokens={})
    return Vocabulary(lambda text: slow(text) if has_long_piece(text) else fast.encode_ordinary(text), pieces)


@lru_cache(maxsize=4)
def piece_level(path: str) -> Vocabulary:
    """A sentencepiece file. U+2581 is a space, a byte piece its byte; control pieces have no bytes."""
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = []
    for i in range(own.get_piece_size()):
        said = own.id_to_piece(i)
        pieces.append(bytes([int(said[3:5], 16)]) if own.is_byte(i) else b"" if own.is_control(i) or own.is_unknown(i) else said.replace("▁", " ").encode())
    return Vocabulary(lambda text: own.encode(text, num_threads=1), pieces)


def labels(a_ends: np.ndarray, b_ends: np.ndarray, n: int) -> bytes:
    """One digit a byte: 0 no end, 1 an end of A, 2 of B, 3 of both."""
    out = np.full(n, 48, np.uint8)
    out[a_ends - 1] += 1
    out[b_ends - 1] += 2
    return out.tobytes()


def aligned(said: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(tokens of A, tokens of B) of every group of a label string."""
    spans = _SPAN.findall(said.translate(None, b"0"))  # bytes where no token ends count for nothing
    n = len(spans)
    # all labels of a span but its last are ends of one of the two alone
    n_a = np.fromiter(map(bytes.count, spans, repeat(b"1")), np.int64, n) + 1
    return n_a, np.fromiter(map(len, spans), np.int64, n) - n_a + 1


class Aligner:
    def __init__(self, a: Vocabulary, b: Vocabulary):
        self.a, self.b = a, b
        # what is written for an id within its group and at the end of its part of it, padded with zero bytes
        texts = [f"{i}{end}".encode() for v, ends in ((a, ",|"), (b, ",;")) for i in range(len(v.pieces)) for end in ends]
        self.texts = np.array(texts, f"S{max(map(len, texts))}")

    def ids(self, text: str | None) -> tuple[list[int], list[int]]:
        """The ids of both, none if the text is null or empty or one of the two doesn't give back its bytes."""
        if not text:
            return [], []
        whole = (" " + text).encode("utf-8", "surrogatepass")
        got = self.a.encode(" " + text), self.b.encode(text)
        if any(b"".join(map(v.pieces.__getitem__, ids)) != whole for v, ids in zip((self.a, self.b), got)):
            return [], []
        return got

    def row(self, text: str | None) -> tuple[int, int, int, int, str, bytes, bytes]:
        ids_a, ids_b = self.ids(text)
        if not ids_a:
            return 0, 0, 0, 0, "", b"", b""
        ia, ib = np.array(ids_a, np.int64), np.array(ids_b, np.int64)
        size_a, size_b = self.a.sizes[ia], self.b.sizes[ib]
        some_a, some_b = size_a > 0, size_b > 0
        if not (some_a.all() and some_b.all()):  # a piece without bytes overlaps nothing
            ia, ib, size_a, size_b = ia[some_a], ib[some_b], size_a[some_a], size_b[some_b]
        ends_a, ends_b = np.cumsum(size_a), np.cumsum(size_b)
        said = labels(ends_a, ends_b, int(ends_a[-1]))
        n_a, n_b = aligned(said)
        # every label that isn't 0 ends a stretch in one token of each
        marks = np.frombuffer(said, np.uint8)
        marks = marks[marks != 48] - 48
        at_a, at_b = np.cumsum(marks & 1) - (marks & 1), np.cumsum(marks >> 1) - (marks >> 1)
        pairs, times = np.unique((ia[at_a] << 16 | ib[at_b]).astype(np.uint32), return_counts=True)
        return len(ia), len(ib), len(n_a), len(marks), self._digest(ia, ib, n_a, n_b), pairs.astype("<u4").tobytes(), times.astype(np.uint8 if times.max() < 256 else "<u4").tobytes()

    def _digest(self, ia: np.ndarray, ib: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> str:
        """SHA-256 of `a1,a2|b1;...`: where each id stands among all is known from the groups' sizes."""
        ends_a, ends_b = np.cumsum(n_a), np.cumsum(n_b)
        place_a = np.arange(len(ia)) + np.repeat(ends_b - n_b, n_a)
        place_b = np.arange(len(ib)) + np.repeat(ends_a, n_b)
        last_a, last_b = np.zeros(len(ia), np.int64), np.zeros(len(ib), np.int64)
        last_a[ends_a - 1] = 1
        last_b[ends_b - 1] = 1
        code = np.empty(len(ia) + len(ib), np.int64)
        code[place_a], code[place_b] = ia * 2 + last_a, (ib + len(self.a.pieces)) * 2 + last_b
        said = self.texts[code].tobytes().translate(None, b"\0")
        return hashlib.sha256(said[:-1]).hexdigest()


@lru_cache(maxsize=2)
def aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(byte_level(path_a), piece_level(path_b))


def _groups(path_a: str, path_b: str) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(path_a, path_b)
        for batch in batches:
            held, size = [], 0
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                held.append((doc_id.as_py(), *own.row(text.as_py())))
                size += len(held[-1][6])
                if size > 1 << 25:  # long texts go on by themselves
                    yield _batch(held, _GROUPS)
                    held, size = [], 0
            if held:
                yield _batch(held, _GROUPS)

    return run


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)


def align(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Per row of docs (doc_id, text): tokens of both, groups, links, a digest of the groups, and its distinct linked id pairs (id of A << 16 | id of B, 32 bits each, ascending) with how often each occurs.

    Null and empty texts, and those that one of the two doesn't give back, have no tokens. Rows stand for themselves: repeated rows, equal
    or null doc_ids each give their own. An empty table gives no rows; other columns are left out. A long text is held whole by one task, with some 30 bytes a byte.
    """
    return docs.select("doc_id", "text").mapInArrow(_groups(path_a, path_b), GROUPS)


def _tally(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out(held: list[np.ndarray]) -> pa.RecordBatch:
        pairs, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(pairs.astype(np.int64)), pa.array(n.astype(np.int64))], ["pair", "docs"])

    held, size = [], 0
    for batch in batches:
        for x in batch.column(0):
            held.append(np.frombuffer(x.as_py(), "<u4"))
            size += len(held[-1])
            if size >= HELD_PAIRS:
                yield out(held)
                held, size = [], 0
    if size:
        yield out(held)


def pair_counts(groups: DataFrame) -> DataFrame:
    """(pair, docs): how many documents hold an id pair linked; counted per task, then summed."""
    return groups.where("n_links > 0").select("pairs").mapInArrow(_tally, "pair long, docs long").groupBy("pair").agg(F.sum("docs").alias("docs"))


def _times(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, np.uint8 if len(raw) == n else "<u4").astype(np.int64)


def _judged(pairs: np.ndarray, times: np.ndarray, known: np.ndarray, docs: np.ndarray, best: np.ndarray) -> tuple[int, int]:
    """(links whose count is the highest of their id of A, sum of counts over links)"""
    at = np.searchsorted(known, pairs)
    return int(times[docs[at] == best[at]].sum()), int((times * docs[at]).sum())


def _best(known: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """The highest count of each pair's id of A."""
    most = np.zeros(1 << 16, np.int64)
    np.maximum.at(most, known >> 16, docs)
    return most[known >> 16]


OUT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
_OUT = pa.schema([("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("n_best", pa.int64()), ("count_sum", pa.int64()), ("groups_sha256", pa.string())])


def score_links(groups: DataFrame, counts: DataFrame, most_pairs: int = MOST_PAIRS) -> DataFrame:
    """n_best and count_sum of every row of align()'s table, from pair_counts()'s table.

    Counts of up to most_pairs pairs are sent to the tasks. Beyond that pairs are dealt out in shards by id of A, so that a shard knows its
    ids' highest counts; each document sends each shard its pairs of it as one packed row, and the answers are summed.
    """
    spark, n = groups.sparkSession, counts.count()
    if n <= most_pairs:
        got = counts.orderBy("pair").toArrow()
        known, docs = got.column("pair").to_numpy(), got.column("docs").to_numpy()
        sent = spark.sparkContext.broadcast((known.astype(np.uint32), docs, _best(known, docs)))

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = []
                for r in batch.to_pylist():
                    pairs = np.frombuffer(r["pairs"], "<u4")
                    n_best, total = _judged(pairs, _times(r["times"], len(pairs)), *sent.value) if len(pairs) else (0, 0)
                    rows.append((r["doc_id"], r["n_a"], r["n_b"], r["n_groups"], r["n_links"], n_best, total, r["groups_sha256"]))
                if rows:
                    yield _batch(rows, _OUT)

        return groups.mapInArrow(run, OUT)

    shards = max(2, -(-n // SHARD_PAIRS))
    rows = stored(groups.withColumn("row", F.monotonically_increasing_id()), "align-rows")
    parts = rows.where("n_links > 0").select("row", "pairs", "times").mapInArrow(_dealt(shards), "shard long, row long, pairs binary, times binary")
    # a shard's counts fit a task, its documents needn't: they are salted over several tasks, each with the shard's counts ahead of them
    parts = parts.select("shard", F.pmod(F.xxhash64("row"), F.lit(SALTS)).alias("salt"), F.col("row").alias("id"), F.lit(0).cast("long").alias("docs"), "pairs", "times", F.lit(1).alias("kind"))
    known = counts.select(F.pmod(F.shiftright("pair", 16), F.lit(shards)).alias("shard"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"), F.col("pair").alias("id"), "docs", F.lit(None).cast("binary").alias("pairs"), F.lit(None).cast("binary").alias("times"), F.lit(0).alias("kind"))
    met = parts.unionByName(known).repartition("shard", "salt").sortWithinPartitions("shard", "salt", "kind", "id")
    summed = met.mapInArrow(_met, "row long, n_best long, count_sum long").groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    joined = rows.join(summed, "row", "left")
    return joined.select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", F.lit(0)).alias("n_best"), F.coalesce("count_sum", F.lit(0)).alias("count_sum"), "groups_sha256")


_DEALT = pa.schema([("shard", pa.int64()), ("row", pa.int64()), ("pairs", pa.binary()), ("times", pa.binary())])
_ANSWER = pa.schema([("row", pa.int64()), ("n_best", pa.int64()), ("count_sum", pa.int64())])


def _dealt(shards: int) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                pairs = np.frombuffer(r["pairs"], "<u4")
                times, shard = _times(r["times"], len(pairs)), (pairs >> 16) % shards
                yield _batch([(int(s), r["row"], pairs[shard == s].tobytes(), times[shard == s].astype("<u4").tobytes()) for s in np.unique(shard)], _DEALT)

    return run


def _met(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by shard and salt, a shard's counts (kind 0) before its documents' pairs (kind 1)."""
    now, known, docs, ready = None, [], [], None
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            if (r["shard"], r["salt"]) != now:
                now, known, docs, ready = (r["shard"], r["salt"]), [], [], None
            if r["kind"] == 0:
                known.append(r["id"])
                docs.append(r["docs"])
                continue
            if ready is None:
                k, d = np.array(known, np.int64), np.array(docs, np.int64)
                ready = k.astype(np.uint32), d, _best(k, d)
            out.append((r["id"], *_judged(np.frombuffer(r["pairs"], "<u4"), np.frombuffer(r["times"], "<u4").astype(np.int64), *ready)))
        if out:
            yield _batch(out, _ANSWER)


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = tokenizer_folder()
    groups = stored(align(table(spark, sf_dir, "documents"), f"{folder}/byte_bpe_50k.json", f"{folder}/piece_bpe_32k.model"), "align-groups")
    counts = stored(pair_counts(groups), "align-counts")
    return score_links(groups, counts)
