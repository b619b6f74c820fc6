"""MinHash near-dedup as a chosen-path set similarity join.

Every document is a set of word shingles and has WIDTH minwise hashes of it. A tree branches its documents: a node selects one or two
of the WIDTH coordinates (4/3 on average, one over the similarity looked for, so that a pair at that similarity is expected to stay
together in one branch), and documents with equal minwise tokens there go to the same child. TREES independent trees bring a pair of
similarity 0.75 together but for a chance below 1e-9 a first level, which is what the recall rests on. Candidates are confirmed on full sets.

Work stays linear where a node is large. Equal sets are one class from the start. In every node of the first level each class is compared
with a pivot, the class that meets most others in its nodes, and then with the one that does so among those of other components: a large group of
near copies is linked by as many comparisons as it has members. What remains in a
node are pairs of different components: nodes with at most REST classes outside their largest component compare these with all
others exhaustively; larger ones branch once more (STEP), which parts texts that have a frequent shingle in common and nothing else.

What is together even then resembles a common text, and branching further would multiply it: classes of similarity s stay together in
4/3 s branches a level. So the classes of nodes that are still large, and the texts that would meet more than HEAVY others in small nodes with
the classes of these, are joined by the rarest of their shingles instead: in one order for all, the first n - ceil(0.75 n) + 1 of two
similar sets of n have one in common, and what follows the first common one must suffice. This is exact in any order, so it is taken from
counts over an eighth of these classes; the texts' own shingles come first, and what all share comes last and is hardly ever met.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordHashes, drop_stored, low_words, mix64, stored, table, window_hashes
from .graph import components

WIDTH, TREES, REST, STEP, GRAM = 64, 20, 16, 1, 5
#: Comparisons of one class within its nodes; and so many of the most frequent shingles at most are sent to the tasks that put shingles in order (16 bytes each; the rest count as rare).
HEAVY, MOST_COMMON = 64, 200_000
#: Words whose hashes a worker remembers, some 130 bytes each.
MOST_WORDS = 100_000
#: Pivots of a node.
ROUNDS = 2
_A = mix64(np.arange(1, WIDTH + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
#: Estimates this far below the similarity are sorted out before the confirmation: 4.6 standard deviations of WIDTH coordinates, a chance of 2e-6 to lose a
#: pair at the very threshold. 1 turns this off: every candidate is confirmed on full sets.
SLACK = 0.25


def shingle_set(text: str | None, cache: WordHashes, gram: int = GRAM) -> np.ndarray:
    """Sorted hashes of the distinct shingles; of fewer words all together as one; none without words."""
    words = low_words(text) if text else []
    if not words:
        return np.empty(0, np.uint64)
    h = cache.of(words)
    if len(h) < gram:
        return np.array([xxhash.xxh64_intdigest(h.tobytes(), seed=len(h))], np.uint64)
    return np.unique(window_hashes(h, gram))


def minwise(s: np.ndarray) -> np.ndarray:
    """WIDTH minwise hashes of a non-empty set. 32 bits each: with fewer, unlike documents meet in first-level nodes by chance, as the square of their number."""
    low = np.full(WIDTH, 0xFFFFFFFF, np.uint64)
    for i in range(0, len(s), 2048):
        low = np.minimum(low, ((s[i : i + 2048, None] * _A) >> np.uint64(32)).min(0))
    return low.astype(np.uint32)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _describe(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cache = WordHashes(MOST_WORDS)
    for b in batches:
        n, ids, sigs = [], [], []
        for t in b.column(1).to_pylist():
            s = shingle_set(t, cache)
            n.append(len(s))
            ids.append(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).astype(np.int64) if len(s) else None)
            sigs.append(minwise(s).tobytes() if len(s) else None)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.int64()), pa.array(sigs, pa.binary())], ["doc", "n", "cid", "sig"])


def _sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cache = WordHashes(MOST_WORDS)
    for b in batches:
        cids, sets, size = [], [], 0
        for cid, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            cids.append(cid)
            sets.append(shingle_set(t, cache).tobytes())
            size += len(sets[-1])
            if size > 1 << 23:
                yield pa.RecordBatch.from_arrays([pa.array(cids, pa.int64()), pa.array(sets, pa.binary())], ["cid", "elements"])
                cids, sets, size = [], [], 0
        yield pa.RecordBatch.from_arrays([pa.array(cids, pa.int64()), pa.array(sets, pa.binary())], ["cid", "elements"])


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, WIDTH)


def _branch(path: np.ndarray, sig: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Children of each row: (row number, new path). A node selects its coordinates by its own path, so all its documents agree on them."""
    rows = np.arange(len(path))
    out_rows, out_paths = [], []
    two = mix64(path + np.uint64(2)) % np.uint64(3) == 0
    for k in (1, 3):
        c = mix64(path + np.uint64(k)) % np.uint64(WIDTH)
        if k == 3:
            first = mix64(path + np.uint64(1)) % np.uint64(WIDTH)
            c = np.where(c == first, (c + np.uint64(1)) % np.uint64(WIDTH), c)
        new = mix64(mix64(path + np.uint64(k) * np.uint64(0x51ED270B)) + (c << np.uint64(32)) + sig[rows, c.astype(np.int64)].astype(np.uint64))
        mine = rows if k == 1 else rows[two]
        out_rows.append(mine)
        out_paths.append(new[mine])
    return np.concatenate(out_rows), np.concatenate(out_paths)


def _roots(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cid, sig) -> (path, cid) for the first level of every tree."""
    for b in batches:
        if not b.num_rows:
            continue
        cid, sig = b.column(0).to_numpy(zero_copy_only=False), _matrix(b.column(1))
        for t in range(TREES):
            rows, path = _branch(np.full(len(cid), t + 1, np.uint64) * np.uint64(0x2545F4914F6CDD1D), sig)
            yield pa.RecordBatch.from_arrays([_signed(path), pa.array(cid[rows])], ["path", "cid"])


def _deeper(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            path, cid, sig = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64), b.column(1).to_numpy(zero_copy_only=False), _matrix(b.column(2))
            for _ in range(STEP):
                rows, path = _branch(path, sig)
                cid, sig = cid[rows], sig[rows]
            yield pa.RecordBatch.from_arrays([_signed(path), pa.array(cid)], ["path", "cid"])


def _estimate(least: float):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                near = (_matrix(b.column(2)) == _matrix(b.column(3))).mean(1) >= least
                yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(near)), b.column(1).filter(pa.array(near))], ["a", "b"])

    return run


def _confirm(percent: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(keep, pa.bool_())), b.column(1).filter(pa.array(keep, pa.bool_()))], ["a", "b"])

    return run


def _elements(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for x in b.column(0):
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(x.as_buffer(), np.int64))], ["token"])


def _prefixes(percent: int, common: Broadcast):
    """(cid, root, heavy, elements) -> (token, cid, root, heavy, n, pos) of the prefix of each set, shingles ordered by their counts in common and then by a hash."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, counts = common.value
        for b in batches:
            for i, x in enumerate(b.column(3)):
                e = np.frombuffer(x.as_buffer(), np.uint64)
                at = np.minimum(np.searchsorted(names, e), max(0, len(names) - 1))
                c = np.where(names[at] == e, counts[at], 0) if len(names) else np.zeros(len(e), np.int64)
                size = len(e) - -(-percent * len(e) // 100) + 1
                first = e[np.lexsort((mix64(e), c))[:size]]
                same = b.slice(i, 1).take(pa.array(np.zeros(size, np.int64)))
                yield pa.RecordBatch.from_arrays([_signed(first), *same.columns[:3], pa.array(np.full(size, len(e), np.int64)), pa.array(np.arange(size))], ["token", "cid", "root", "heavy", "n", "pos"])

    return run


class _Join:
    def __init__(self, docs: DataFrame, classes: DataFrame, percent: int, slack: float, most_broadcast: int):
        self.docs, self.classes, self.percent, self.slack, self.most = docs, classes, percent, slack, most_broadcast

    def sets(self, ids: DataFrame, n: int) -> DataFrame:
        """(cid, elements) of the n classes (cid, first_hash)."""
        ids = F.broadcast(ids) if n <= self.most else ids  # two longs a row
        texts = self.docs.withColumn("first_hash", F.xxhash64("text")).join(ids, "first_hash").select("cid", "text").dropDuplicates(["cid"])
        return stored(texts.mapInArrow(_sets, "cid long, elements binary"), "neardup-sets")

    def by_rarity(self, rows: DataFrame) -> DataFrame:
        """The pairs (a, b) of the classes in rows (cid, root, heavy) that have a shingle of both prefixes in common, of different roots, one of the two heavy."""
        p, spark = self.percent, rows.sparkSession
        ids = stored(rows.join(self.classes.select("cid", "first_hash"), "cid"), "neardup-heavy")
        sets = self.sets(ids.select("cid", "first_hash"), ids.count())
        some = sets.where(F.pmod(F.xxhash64("cid"), F.lit(8)) == 0).select("elements").mapInArrow(_elements, "token long")
        top = some.groupBy("token").count().where("count > 1").orderBy(F.desc("count"), "token").limit(MOST_COMMON).toArrow()
        names, counts = top["token"].to_numpy().view(np.uint64), top["count"].to_numpy()
        order = np.argsort(names)
        common = spark.sparkContext.broadcast((names[order], counts[order]))
        first = ids.select("cid", "root", "heavy").join(sets, "cid").mapInArrow(_prefixes(p, common), "token long, cid long, root long, heavy boolean, n long, pos long")
        first = stored(first, "neardup-prefixes")
        a, b = (first.select("token", *(F.col(c).alias(c + k) for c in ("cid", "root", "heavy", "n", "pos"))) for k in "12")
        new = (F.col("root1") != F.col("root2")) & (~F.col("heavy2") | (F.col("cid1") < F.col("cid2")))
        fits = (F.least("n1", "n2") * 100 >= F.greatest("n1", "n2") * p) & (F.least(F.col("n1") - F.col("pos1"), F.col("n2") - F.col("pos2")) * (100 + p) >= (F.col("n1") + F.col("n2")) * p)
        pairs = a.where("heavy1").join(b, (a["token"] == b["token"]) & new & fits).select(F.least("cid1", "cid2").alias("a"), F.greatest("cid1", "cid2").alias("b")).distinct()
        pairs = stored(pairs, "neardup-rare")
        drop_stored(ids, sets, first)
        return pairs

    def links(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) of classes whose full sets are similar, each once, confirmed."""
        p = self.percent
        one = self.classes.select(F.col("cid").alias("a"), F.col("n").alias("na"), F.col("sig").alias("siga"))
        two = self.classes.select(F.col("cid").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("sigb"))
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        met = pairs.join(one, "a").join(two, "b").where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * p)
        near = stored(met.select("a", "b", "siga", "sigb").mapInArrow(_estimate(p / 100 - self.slack), "a long, b long"), "neardup-near")
        ids = near.select(F.col("a").alias("cid")).unionByName(near.select(F.col("b").alias("cid"))).distinct().join(self.classes.select("cid", "first_hash"), "cid")
        ids = stored(ids, "neardup-ids")
        n = ids.count()
        if not n:
            drop_stored(ids)
            return near
        sets = self.sets(ids, n)
        full = near.join(sets.select(F.col("cid").alias("a"), F.col("elements").alias("x")), "a").join(sets.select(F.col("cid").alias("b"), F.col("elements").alias("y")), "b")
        found = stored(full.select("a", "b", "x", "y").mapInArrow(_confirm(p), "a long, b long"), "neardup-links")
        drop_stored(near, ids, sets)
        return found


def near_duplicates(docs: DataFrame, doc: str = "doc_id", text: str = "text", percent: int = 75, slack: float = SLACK, most_broadcast: int = 1_000_000) -> DataFrame:
    """One row per row of docs: doc (its id), n_shingles, component_id (smallest id reachable by links), kept (it is that one), text_hash (to tell rows of one id apart), class_id (the component itself, which ids needn't tell apart; null without shingles).

    Defined results: null, empty and blank texts have no shingles and no links; equal texts are linked; rows with a null id have the smallest
    id of their component, which is null if no other is; of repeated ids all rows with the smallest one are kept; an empty table gives
    no rows; columns of docs other than doc and text aren't read and can't clash. Shingles and classes go by 64-bit hashes.
    """
    own = docs.select(F.col(doc).alias("doc"), F.col(text).alias("text"))
    told = stored(own.select(F.struct("doc", F.xxhash64("text").alias("th")).alias("doc"), "text").mapInArrow(_describe, f"doc struct<doc: {own.schema['doc'].dataType.simpleString()}, th: long>, n long, cid long, sig binary"), "neardup-docs")
    rows = told.select(F.col("doc.doc").alias("doc"), F.col("doc.th").alias("th"), "n", "cid", "sig")
    classes = stored(rows.where("n > 0").groupBy("cid").agg(F.min("doc").alias("first"), F.max("n").alias("n"), F.min("th").alias("first_hash"), F.first("sig").alias("sig")), "neardup-classes")
    join = _Join(own.select("text"), classes, percent, slack, most_broadcast)

    level = stored(classes.select("cid", "sig").mapInArrow(_roots, "path long, cid long"), "neardup-paths")
    sizes = level.groupBy("path").agg(F.count("*").alias("size")).where("size > 1")
    shared = stored(level.join(sizes, "path"), "neardup-shared")
    drop_stored(level)
    # who meets most others is next to what they have in common
    hubs = stored(shared.groupBy("cid").agg(F.struct(F.sum("size").alias("meets"), "cid").alias("hub")), "neardup-hubs")
    links, roots, spent = None, None, [hubs]
    for k in range(ROUNDS):
        rows = shared.select("path", "cid").join(hubs, "cid")
        rows = rows.withColumn("root", F.col("cid")) if k == 0 else rows.join(roots.withColumnRenamed("node", "cid"), "cid", "left").select("path", "cid", "hub", F.coalesce("root", "cid").alias("root"))
        pivots = rows.groupBy("path").agg(F.max(F.struct("hub", "root")).alias("p"))
        if k:  # of those that the first one hasn't linked
            pivots = rows.join(pivots, "path").where(F.col("root") != F.col("p.root")).groupBy("path").agg(F.max(F.struct("hub", "root")).alias("p"))
        found = join.links(rows.join(pivots.select("path", F.col("p.hub.cid").alias("b"), F.col("p.root").alias("rb")), "path").where(F.col("root") != F.col("rb")).select(F.col("cid").alias("a"), "b"))
        spent += [found, roots]
        links = found if links is None else links.unionByName(found)
        roots = components(links)

    def mixed(level: DataFrame, tag: str) -> DataFrame:
        """The nodes that hold more than one component."""
        labelled = level.join(roots.withColumnRenamed("node", "cid"), "cid", "left").select("path", "cid", F.coalesce("root", "cid").alias("root"))
        groups = labelled.groupBy("path", "root").agg(F.count("*").alias("m")).groupBy("path").agg(F.sum("m").alias("all"), F.max(F.struct("m", "root")).alias("top"))
        groups = groups.select("path", F.col("top.root").alias("top"), "all", (F.col("all") - F.col("top.m")).alias("rest")).where("rest > 0")
        return stored(labelled.join(groups, "path"), tag)

    nodes = mixed(shared.select("path", "cid"), "neardup-level0")
    level = nodes.where(F.col("rest") > REST).select("path", "cid").join(classes.select("cid", "sig"), "cid").select("path", "cid", "sig")
    level = stored(level.mapInArrow(_deeper, "path long, cid long").distinct(), "neardup-branches")
    deep = mixed(level, "neardup-level1")
    drop_stored(shared, level)
    done = nodes.where(F.col("rest") <= REST).unionByName(deep.where(F.col("rest") <= REST))
    large = deep.where(F.col("rest") > REST)
    few = done.where("root <> top").select("path", F.col("cid").alias("a"), F.col("root").alias("ra"), "all")
    heavy = few.groupBy("a").agg(F.sum("all").alias("meets")).where(F.col("meets") > HEAVY).select("a")
    heavy = stored(heavy.unionByName(large.where("root <> top").select(F.col("cid").alias("a"))).distinct(), "neardup-outsiders")
    n = heavy.count()
    own = F.broadcast(heavy) if n <= most_broadcast else heavy  # a long a row
    met = few.join(own, "a", "left_anti").join(done.select("path", F.col("cid").alias("b"), F.col("root").alias("rb"), "top"), "path")
    met = met.join(own.select(F.col("a").alias("b"), F.lit(True).alias("heavy")), "b", "left")
    more = met.where((F.col("ra") != F.col("rb")) & ((F.col("rb") == F.col("top")) | (F.col("a") < F.col("b")) | F.col("heavy"))).select("a", "b")
    rare = None
    if n:
        among = done.join(few.join(own, "a", "left_semi").select("path").distinct(), "path", "left_semi").select("cid", "root").unionByName(large.select("cid", "root")).distinct()
        rare = join.by_rarity(among.join(own.select(F.col("a").alias("cid"), F.lit(True).alias("heavy")), "cid", "left").select("cid", "root", F.coalesce("heavy", F.lit(False)).alias("heavy")))
        more = more.unionByName(rare)
    late = join.links(more)
    before, roots = roots, components(links.unionByName(late))
    drop_stored(before, *spent, late, heavy, rare, nodes, deep)

    of = classes.select("cid", "first").join(roots.withColumnRenamed("node", "cid"), "cid", "left").select("cid", "first", F.coalesce("root", "cid").alias("root"))
    low = of.groupBy("root").agg(F.min("first").alias("component_id"))
    of = of.join(low, "root").select(F.col("cid").alias("_cid"), "component_id", F.col("root").alias("class_id"))
    slim = told.select(F.col("doc.doc").alias("doc"), F.col("doc.th").alias("text_hash"), "n", "cid")
    met = slim.join(of, F.col("cid") == F.col("_cid"), "left")
    component = F.when(F.col("_cid").isNull(), F.col("doc")).otherwise(F.col("component_id"))
    out = stored(met.select(F.col("doc").alias(doc), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc").eqNullSafe(component).alias("kept"), "text_hash", "class_id"), "neardup")
    drop_stored(told, classes, roots)
    return out


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text_hash", "class_id")


OP3_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct([array_to_string(w[j : j + 4], ' ') FOR j IN range(1, len(w) - 3)]) END AS t FROM w),
c AS (SELECT min(doc_id) AS c, list_sort(t) AS t FROM s WHERE len(t) > 0 GROUP BY list_sort(t)),
e AS (SELECT c, len(t) AS n, unnest(t) AS t FROM c),
m AS (SELECT a.c AS a, b.c AS b FROM e a JOIN e b ON a.t = b.t AND a.c <> b.c GROUP BY a.c, b.c, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
r(c, root) AS (SELECT c, c FROM c UNION SELECT m.b, r.root FROM r JOIN m ON m.a = r.c AND r.root < m.b),
k AS (SELECT c, min(root) AS root FROM r GROUP BY c)
SELECT s.doc_id, len(s.t)::BIGINT AS n_shingles, coalesce(k.root, s.doc_id) AS component_id, coalesce(k.root, s.doc_id) = s.doc_id AS kept
FROM s LEFT JOIN c ON len(s.t) > 0 AND c.t = list_sort(s.t) LEFT JOIN k ON k.c = c.c
"""
