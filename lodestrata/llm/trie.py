"""The prefix trie of all conversations, as the Cartesian tree over the longest common prefixes of the sorted ones.

1. Turns are digests. Conversations are sorted without any of them whole in one row: blocks of `WIDTH` digests get their rank among all
   distinct blocks, blocks of `WIDTH` ranks theirs, and so on until one block is left of each; its rank is the conversation's. Equal
   conversations are one class from there on, however many they are.
2. The common prefix of neighbours in that order is read off the same blocks, from the top down.
3. Nearest smaller values on both sides, in blocks of the prefix lengths: within a block with a stack, beyond it by the blocks' minima, which
   name the block that holds the answer. Entries of one length between the same two smaller ones are one node; the others follow from it:
   its interval of classes, its depth, and the depth of its parent, which is the larger one of the two smaller values. Classes that are a
   prefix of no other are the leaves.
4. Depths missing between a node and its parent are nodes with one child each. What is summed or counted over subtrees is a difference of
   running sums over classes; the smallest member is a minimum over the interval, by blocks again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop_stored, stored, table

WIDTH = 32
#: A block of classes has so many, or more where there would be more than MOST_BLOCKS blocks: a number a block is known to every task.
BLOCK, MOST_BLOCKS = 1 << 16, 1 << 18
#: So many depths are spelled out from one row; so many ids of members are hashed as one piece.
DEPTHS, IDS = 4096, 512
NO_ENDS = hashlib.sha256(b"").hexdigest()


def numbered(df: DataFrame, keys: list[str], tag: str, sums: tuple[str, ...] = ()) -> DataFrame:
    """df's rows with `at`, their place in the order of keys (unique together) from 0, and cum_x, the running sum of x (none below 0), for x in sums; a table.

    A range of keys a task, numbered by itself and stored; the tasks' totals, a row each, give the offsets.
    """
    schema = T.StructType([*df.schema.fields, T.StructField("at", T.LongType()), *(T.StructField(f"cum_{s}", T.LongType()) for s in sums), T.StructField("_task", T.LongType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n, carried = TaskContext.get().partitionId(), 0, dict.fromkeys(sums, 0)
        for b in batches:
            columns = [*b.columns, pa.array(np.arange(n, n + b.num_rows))]
            n += b.num_rows
            for s in sums:
                run_ = np.cumsum(b.column(b.schema.get_field_index(s)).to_numpy(zero_copy_only=False).astype(np.int64)) + carried[s]
                carried[s] = int(run_[-1]) if len(run_) else carried[s]
                columns.append(pa.array(run_))
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.full(b.num_rows, task, np.int64))], names=[f.name for f in schema])

    rows = stored(df.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema), tag)
    counted = ["at", *(f"cum_{s}" for s in sums)]
    totals = sorted(map(tuple, rows.groupBy("_task").agg(F.max("at") + 1, *(F.max(c) for c in counted[1:])).collect()))
    offsets, before = [], [0] * len(counted)
    for task, *own in totals:
        offsets.append((task, *before))
        before = [a + b for a, b in zip(before, own)]
    known = df.sparkSession.createDataFrame(offsets, "_task long, " + ", ".join(f"_{c} long" for c in counted))
    out = rows.join(F.broadcast(known), "_task").select(*df.columns, *((F.col(c) + F.col(f"_{c}")).alias(c) for c in counted))
    out._stored_at = rows._stored_at
    return out


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns: c, d from 1, code, chars; conversations: c, size), both tables. Turns go by turn (null first), those of one number by their digest; a hot conversation is spread over tasks like any other rows."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))
    turns = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("c"), "turn", F.substring(digest, 1, 16).alias("code"), F.length(text).cast("long").alias("chars"), F.monotonically_increasing_id().alias("tie"))
    turns = numbered(turns, ["c", "turn", "code", "tie"], "trie-turns")
    base = F.col("c") - F.col("c") % 100
    own = turns.groupBy("c").agg(F.min("at").alias("first"), F.count("*").alias("n")).withColumns({"base": base, "h": F.crc32(F.col("c").cast("string").cast("binary")) % 6})
    own = stored(own, "trie-own")
    heads = own.select(F.col("c").alias("base"), F.col("n").alias("of_base"))
    convs = stored(own.join(heads, "base", "left").withColumn("k", F.least("h", F.coalesce("of_base", F.lit(0)))), "trie-convs")
    placed = turns.select("c", "at", "code", "chars").join(convs.select("c", "first", "h", "k"), "c").withColumn("p", F.col("at") - F.col("first"))
    kept = placed.where("p >= h").select("c", (F.col("k") + F.col("p") - F.col("h") + 1).alias("d"), "code", "chars")
    bases = turns.where(F.col("c") % 100 == 0).select(F.col("c").alias("base"), "at", "code", "chars").join(own.select(F.col("c").alias("base"), "first"), "base").select("base", (F.col("at") - F.col("first")).alias("p"), "code", "chars").where("p < 5")
    given = bases.join(convs.select("c", "base", "h"), "base").where("p < h").select("c", (F.col("p") + 1).alias("d"), "code", "chars")
    out = stored(kept.unionByName(given), "trie-rebuilt")
    sizes = stored(convs.select("c", (F.col("k") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("size")), "trie-sizes")
    drop_stored(turns, own, convs)
    return out, sizes


def ranked(turns: DataFrame, sizes: DataFrame, width: int = WIDTH) -> tuple[DataFrame, list[DataFrame]]:
    """(members: c, r; levels from the top: at, parts). r is the rank of the conversation among the distinct ones; a level's parts are the ranks at the next, or digests at the last."""
    longest = sizes.agg(F.max("size")).first()[0] or 0
    items, levels = turns.select("c", (F.col("d") - 1).alias("i"), F.col("code").alias("x")), []
    while True:
        block = items.groupBy("c", F.floor(F.col("i") / width).alias("i")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("parts"))
        top = longest <= width
        if top:  # conversations without turns are an empty block
            block = sizes.select("c").join(block.select("c", "parts"), "c", "left").select("c", F.coalesce("parts", F.array().cast(block.schema["parts"].dataType)).alias("parts"))
        block = stored(block, "trie-blocks")
        level = numbered(block.select("parts").distinct(), ["parts"], "trie-level")
        levels.insert(0, level)
        named = block.join(level, "parts")
        if top:
            members = stored(named.select("c", F.col("at").alias("r")), "trie-members")
            drop_stored(block)
            return members, levels
        items, longest = named.select("c", "i", F.col("at").alias("x")), -(-longest // width)


def common_prefixes(levels: list[DataFrame], width: int = WIDTH) -> DataFrame:
    """(i, v): the number of turns that class i has in common with class i - 1; a table."""
    pairs = levels[0].select(F.col("at").alias("i"), F.col("parts").alias("b")).join(levels[0].select((F.col("at") + 1).alias("i"), F.col("parts").alias("a")), "i").withColumn("v", F.lit(0).cast("long"))
    done = []
    for depth, below in zip(range(len(levels) - 1, -1, -1), [*levels[1:], None]):
        differ = F.array_position(F.zip_with("a", "b", lambda x, y: F.coalesce(x == y, F.lit(False))), False)
        pairs = stored(pairs.withColumn("j", differ).withColumn("v", F.col("v") + (F.col("j") - 1) * width**depth), "trie-lcp")
        if below is None:
            done.append(pairs.select("i", "v"))
            break
        both = F.col("j") <= F.least(F.size("a"), F.size("b"))
        done.append(pairs.where(~both).select("i", "v"))
        met = pairs.where(both).select("i", "v", F.element_at("a", F.col("j").cast("int")).alias("x"), F.element_at("b", F.col("j").cast("int")).alias("y"))
        pairs = met.join(below.select(F.col("at").alias("x"), F.col("parts").alias("a")), "x").join(below.select(F.col("at").alias("y"), F.col("parts").alias("b")), "y").select("i", "v", "a", "b")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return stored(out, "trie-prefixes")


def _smaller(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the nearest strictly smaller values before (-1: none) and after (len: none)."""
    n = len(v)
    before, after, stack, values = [-1] * n, [n] * n, [], v.tolist()
    for i, x in enumerate(values):
        while stack and values[stack[-1]] > x:
            after[stack.pop()] = i
        # an equal one has the same smaller one before it
        before[i] = (before[stack[-1]] if values[stack[-1]] == x else stack[-1]) if stack else -1
        stack.append(i)
    return np.array(before, np.int64), np.array(after, np.int64)


def _blocks(n: int, block: int) -> int:
    return max(block, -(-n // MOST_BLOCKS))


def _known(df: DataFrame, at: str, value: str, size: int, n: int) -> np.ndarray:
    """The smallest value of each block of `size` of n places: at most MOST_BLOCKS numbers, which the driver and every task may hold."""
    got = df.groupBy(F.floor(F.col(at) / size).alias("b")).agg(F.min(value).alias("m")).toArrow()
    out = np.full(-(-n // size), np.iinfo(np.int64).max, np.int64)
    out[got.column("b").to_numpy()] = got.column("m").to_numpy()
    return out


_NEAREST = "i long, v long, p long, pv long, n long, nv long, left long, right long"


def nearest_smaller(lcp: DataFrame, classes: int, block: int = BLOCK) -> DataFrame:
    """(i, v, p, pv, n, nv) for i, v of lcp (i from 1 to classes - 1): the nearest places before and after i with a smaller value, and their values. Places 0 and `classes` have -1; a table."""
    size = _blocks(classes, block)
    minima = _known(lcp, "i", "v", size, classes)
    before, after = _smaller(minima)

    def target(v: int, b: int, links: np.ndarray, step: int) -> int | None:
        b += step
        while 0 <= b < len(minima) and minima[b] >= v:
            b = int(links[b])
        return b if 0 <= b < len(minima) else None

    def inside(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("i")
        i, v = rows.i.to_numpy(), rows.v.to_numpy()
        p, n = _smaller(v)
        b = int(i[0]) // size
        left, right = p < 0, n >= len(v)
        to_left = {x: target(x, b, before, -1) for x in set(v[left].tolist())}
        to_right = {x: target(x, b, after, 1) for x in set(v[right].tolist())}
        out = pd.DataFrame({"i": i, "v": v, "p": np.where(left, 0, i[p]), "pv": np.where(left, -1, v[p]), "n": np.where(right, classes, i[np.minimum(n, len(v) - 1)]), "nv": np.where(right, -1, v[np.minimum(n, len(v) - 1)])})
        out["left"] = pd.array([to_left[x] if at else None for x, at in zip(v.tolist(), left)], "Int64")
        out["right"] = pd.array([to_right[x] if at else None for x, at in zip(v.tolist(), right)], "Int64")
        return out

    rows = stored(lcp.groupBy(F.floor(F.col("i") / size).alias("b")).applyInPandas(inside, _NEAREST), "trie-nearest")
    if len(minima) == 1:  # nothing lies beyond the only block
        return rows

    def beyond(key, held: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        held = held.sort_values("i")
        i, v = held.i.to_numpy(), held.v.to_numpy()
        found = []
        for side, step in ((0, -1), (1, 1)):
            q = asked.v[asked.side == side].to_numpy()
            if not len(q):
                continue
            seen = v[::step]
            low = np.minimum.accumulate(seen)  # falling: the first place below q is the nearest one
            at = np.searchsorted(-low, -q, side="right")
            place = i[::step][at]
            found.append(pd.DataFrame({"b": np.full(len(q), key[0], np.int64), "side": np.full(len(q), side, np.int64), "v": q, "place": place, "value": seen[at]}))
        return pd.concat(found)

    asked = rows.where("left IS NOT NULL").select(F.col("left").alias("b"), F.lit(0).cast("long").alias("side"), "v").unionByName(rows.where("right IS NOT NULL").select(F.col("right").alias("b"), F.lit(1).cast("long").alias("side"), "v")).distinct()
    answers = stored(lcp.withColumn("b", F.floor(F.col("i") / size)).groupBy("b").cogroup(asked.groupBy("b")).applyInPandas(_if_asked(beyond), "b long, side long, v long, place long, value long"), "trie-beyond")
    side = lambda s, b, place, value: answers.where(F.col("side") == s).select(F.col("b").alias(b), "v", F.col("place").alias(place), F.col("value").alias(value))
    out = rows.join(side(0, "left", "lp", "lv"), ["left", "v"], "left").join(side(1, "right", "rp", "rv"), ["right", "v"], "left")
    out = stored(out.select("i", "v", F.coalesce("lp", "p").alias("p"), F.coalesce("lv", "pv").alias("pv"), F.coalesce("rp", "n").alias("n"), F.coalesce("rv", "nv").alias("nv")), "trie-nearest")
    drop_stored(rows, answers)
    return out


def _if_asked(f: Callable) -> Callable:
    def run(key, held: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        return f(key, held, asked) if len(held) and len(asked) else pd.DataFrame({"b": [], "side": [], "v": [], "place": [], "value": []}, dtype="int64")

    return run


def _table(v: np.ndarray) -> list[np.ndarray]:
    """Minima over runs of 1, 2, 4, ... places."""
    out = [v]
    while 2 ** len(out) <= len(v):
        half = 2 ** (len(out) - 1)
        out.append(np.minimum(out[-1][:-half], out[-1][half:]))
    return out


def _least(known: list[np.ndarray], first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The minimum over each first..last."""
    power = np.floor(np.log2(last - first + 1)).astype(np.int64)
    out = np.empty(len(first), np.int64)
    for k in np.unique(power):
        at = power == k
        out[at] = np.minimum(known[k][first[at]], known[k][last[at] - 2**k + 1])
    return out


def interval_minima(values: DataFrame, intervals: DataFrame, n: int, block: int = BLOCK) -> DataFrame:
    """(s, e, least): the least `value` of values (r from 0 to n - 1) over each interval s..e. Whole blocks within an interval are known by their minima; its ends are looked up in theirs."""
    size = _blocks(n, block)
    minima = _known(values, "r", "value", size, n)

    def inner(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = _table(minima)
        for f in frames:
            first, last = f.s.to_numpy() // size + 1, f.e.to_numpy() // size - 1
            some = last >= first
            if some.any():
                yield pd.DataFrame({"s": f.s[some], "e": f.e[some], "least": _least(known, first[some], last[some])})

    def ends(key, held: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(held) or not len(asked):
            return pd.DataFrame({"f": [], "t": [], "m": []}, dtype="int64")
        held = held.sort_values("r")
        start = int(held.r.iloc[0])
        return pd.DataFrame({"f": asked.f, "t": asked.t, "m": _least(_table(held.value.to_numpy()), asked.f.to_numpy() - start, asked.t.to_numpy() - start)})

    of = lambda c: F.floor(F.col(c) / size)
    pieces = F.array(F.struct(F.col("s").alias("f"), F.least("e", (of("s") + 1) * size - 1).alias("t")), F.struct(F.greatest("s", of("e") * size).alias("f"), F.col("e").alias("t")))
    cut = intervals.select("s", "e", F.explode(F.array_distinct(pieces)).alias("x")).select("s", "e", F.col("x.f").alias("f"), F.col("x.t").alias("t"))
    asked = cut.select("f", "t").distinct().withColumn("b", of("f"))
    found = values.withColumn("b", of("r")).groupBy("b").cogroup(asked.groupBy("b")).applyInPandas(ends, "f long, t long, m long")
    least = cut.join(found, ["f", "t"]).select("s", "e", F.col("m").alias("least"))
    if len(minima) > 2:
        least = least.unionByName(intervals.select("s", "e").mapInPandas(inner, "s long, e long, least long"))
    return least.groupBy("s", "e").agg(F.min("least").alias("least"))


def digests(members: DataFrame) -> DataFrame:
    """(r, ends_sha256) of the ids of each class's members, ascending, joined by commas. Ids are spelled out in pieces by as many tasks as there are ranges of (r, c); a class's pieces then pass one hash in a stream."""

    def pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            r, c = b.column(0).to_numpy(), b.column(1).to_numpy()
            cuts = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
            starts = [s for a, z in zip(cuts, [*cuts[1:], len(r)]) for s in range(a, z, IDS)]
            stops = [*starts[1:], len(r)]
            yield pa.RecordBatch.from_arrays([pa.array(r[starts]), pa.array(c[starts]), pa.array([",".join(map(str, c[s:e].tolist())) for s, e in zip(starts, stops)], pa.string())], names=["r", "c", "ids"])

    def hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for b in batches:
            out = []
            for r, ids in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
                if r != now:
                    if state is not None:
                        out.append((now, state.hexdigest()))
                    now, state = r, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], names=["r", "ends_sha256"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([state.hexdigest()])], names=["r", "ends_sha256"])

    spelled = members.select("r", "c").repartitionByRange("r", "c").sortWithinPartitions("r", "c").mapInArrow(pieces, "r long, c long, ids string")
    return spelled.repartition("r").sortWithinPartitions("r", "c").mapInArrow(hashed, "r long, ends_sha256 string")


def prefix_trie(conversations: DataFrame, width: int = WIDTH, block: int = BLOCK) -> DataFrame:
    """One row per node of the trie of rebuilt conversations: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    conversations: conv_id, turn, role, text. Turns go by turn (null first), and those of one number by a digest of role and text; repeated rows
    are turns of their own; null role and text are empty. Rows without conv_id belong to no conversation and are left out; an empty table
    has no nodes, not even a root; a conversation without turns counts at the root alone. Other columns are left out. A text is
    seen by one expression only, which turns it into a digest and a length, however long; a conversation of any length is spread over rows.
    """
    turns, sizes = rebuilt(conversations)
    members, levels = ranked(turns, sizes, width)
    lcp = common_prefixes(levels, width)
    own = members.join(sizes, "c").groupBy("r").agg(F.count("*").alias("n"), F.min("c").alias("value"), F.min("size").alias("size"))
    own = stored(own, "trie-classes")
    drop_stored(sizes, *levels)
    classes = own.count()
    smaller = nearest_smaller(lcp, classes, block)
    # turns of each class, in the order of classes, with running lengths
    spelled = numbered(own.select("r", F.col("value").alias("c")).join(turns, "c").select("r", "d", "chars"), ["r", "d"], "trie-spelled", ("chars",))
    whole = spelled.groupBy("r").agg(F.min(F.col("cum_chars") - F.col("chars")).alias("zero"), F.max("cum_chars").alias("end"))
    shared = spelled.select("r", F.col("d").alias("v"), F.col("cum_chars").alias("shared"))
    before, behind = lcp.select(F.col("i").alias("r"), "v"), lcp.select((F.col("i") - 1).alias("r"), F.col("v").alias("next"))
    facts = own.join(before, "r", "left").join(behind, "r", "left").fillna(-1, ["v", "next"]).join(whole, "r", "left").join(shared, ["r", "v"], "left").fillna(0, ["zero", "end"])
    facts = facts.select(
        "r", "n", "value", "size", "v", "next", "zero", (F.col("end") - F.col("zero")).alias("chars"), (F.col("next") < F.col("size")).cast("long").alias("leaf"),
        (F.col("n") * (F.col("end") - F.col("zero"))).alias("held"), (F.col("end") - F.coalesce("shared", "zero")).alias("fresh"),
    )
    facts = numbered(facts, ["r"], "trie-facts", ("n", "leaf", "held", "fresh"))
    drop_stored(turns, lcp, own)
    inner = smaller.groupBy("p", "v").agg(F.count("*").alias("cuts"), F.min("n").alias("n"), F.min("pv").alias("pv"), F.min("nv").alias("nv"))
    inner = inner.select(F.col("p").alias("s"), (F.col("n") - 1).alias("e"), F.col("v").alias("deep"), F.greatest("pv", "nv").alias("up"), F.when(F.col("pv") >= F.col("nv"), F.col("p")).otherwise(F.col("n")).alias("q"), (F.col("cuts") + 1).alias("parts"))
    leaves = facts.where("leaf = 1").select(F.col("r").alias("s"), F.col("r").alias("e"), F.col("size").alias("deep"), F.greatest("v", "next").alias("up"), F.when(F.col("v") >= F.col("next"), F.col("r")).otherwise(F.col("r") + 1).alias("q"), F.lit(0).cast("long").alias("parts"))
    nodes = stored(inner.unionByName(leaves), "trie-nodes")
    least = interval_minima(facts.select("r", "value"), nodes.select("s", "e"), classes, block)
    counted = ("n", "leaf", "held", "fresh")
    start = facts.select(F.col("r").alias("s"), F.col("size").alias("own_size"), "zero", F.col("chars").alias("own_chars"), *((F.col(f"cum_{c}") - F.col(c)).alias(f"a_{c}") for c in counted), F.col("fresh").alias("own_fresh"))
    stop = facts.select(F.col("r").alias("e"), *(F.col(f"cum_{c}").alias(f"z_{c}") for c in counted))
    over = lambda c: F.col(f"z_{c}") - F.col(f"a_{c}")
    nodes_ = nodes.join(start, "s").join(stop, "e").join(least, ["s", "e"])
    nodes_ = nodes_.select(
        "s", "deep", "up", "q", "zero", F.col("least").alias("conv_id"), over("n").alias("n_convs"), over("leaf").alias("n_leaves"), over("held").alias("held"),
        (F.col("own_chars") + over("fresh") - F.col("own_fresh")).alias("once"), (F.col("own_size") == F.col("deep")).alias("ends"),
        F.when(F.col("parts") > 0, F.col("parts") - (F.col("own_size") == F.col("deep")).cast("long")).otherwise(0).alias("children"),
    )
    nodes_ = stored(nodes_, "trie-nodes")
    drop_stored(nodes, facts)
    # the parent holds place q, and its interval begins where q's smaller value before it is
    above = nodes_.select("s", "deep", "q", "up").where("up >= 0").join(smaller.select(F.col("i").alias("q"), F.col("p").alias("ps")), "q")
    above = above.join(nodes_.select(F.col("s").alias("ps"), F.col("deep").alias("up"), F.col("conv_id").alias("parent")), ["ps", "up"]).select("s", "deep", "parent")
    full = nodes_.join(above, ["s", "deep"], "left").join(digests(members).withColumnRenamed("r", "s"), "s", "left")
    first = F.greatest(F.col("up") + 1, F.lit(0))
    full = full.withColumn("from", F.explode(F.sequence(first, F.col("deep"), F.lit(DEPTHS).cast("long")))).withColumn("depth", F.explode(F.sequence("from", F.least("deep", F.col("from") + DEPTHS - 1))))
    text = spelled.select(F.col("r").alias("s"), F.col("d").alias("depth"), (F.col("cum_chars") - F.col("chars")).alias("cum"))
    out = full.join(text, ["s", "depth"], "left").withColumn("pre", F.coalesce(F.col("cum") - F.col("zero"), F.lit(0)))
    last = F.col("depth") == F.col("deep")
    return out.select(
        "conv_id", "depth", F.when(F.col("depth") > 0, F.when(F.col("depth") == F.col("up") + 1, F.col("parent")).otherwise(F.col("conv_id"))).alias("parent_conv_id"), "n_convs",
        F.when(last, F.col("children")).otherwise(1).cast("long").alias("n_children"), "n_leaves", (F.col("held") - F.col("n_convs") * F.col("pre") - F.col("once") + F.col("pre")).alias("saved_tokens"),
        F.when(last & F.col("ends"), F.col("ends_sha256")).otherwise(NO_ENDS).alias("ends_sha256"),
    )


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


OP11_SQL = r"""
WITH RECURSIVE o AS MATERIALIZED (SELECT conv_id AS c, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS code, length(coalesce(text, '')) AS chars,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS p FROM conversations WHERE conv_id IS NOT NULL),
k AS MATERIALIZED (SELECT c, c - c % 100 AS base, xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(range(1, length(c::VARCHAR) + 1), lambda i: [ascii((c::VARCHAR)[i])::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), 4294967295) % 6 AS h FROM (SELECT DISTINCT c FROM o)),
m AS (SELECT k.c, o.p, 0 AS own, o.code, o.chars FROM k JOIN o ON o.c = k.base AND o.p < k.h UNION ALL SELECT k.c, o.p, 1, o.code, o.chars FROM k JOIN o ON o.c = k.c AND o.p >= k.h),
t AS MATERIALIZED (SELECT c, code, chars, row_number() OVER (PARTITION BY c ORDER BY own, p) AS d FROM m),
x AS (SELECT c, d, chars, sha256(string_agg(code, '') OVER (PARTITION BY c ORDER BY d ROWS UNBOUNDED PRECEDING)) AS key FROM t UNION ALL SELECT c, 0, 0, 'root' FROM k),
y AS MATERIALIZED (SELECT *, lead(key) OVER (PARTITION BY c ORDER BY d) AS nxt, lag(key) OVER (PARTITION BY c ORDER BY d) AS up FROM x),
n AS MATERIALIZED (SELECT key, any_value(d) AS d, min(c) AS c, count(*) AS convs, count(DISTINCT nxt) AS children, any_value(up) AS up, any_value(chars) AS chars, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE nxt IS NULL), '')) AS ends FROM y GROUP BY key),
s AS (SELECT a.key, count(*) FILTER (WHERE n.children = 0) AS leaves, sum((n.convs - 1) * n.chars) AS saved FROM n JOIN y a ON a.c = n.c AND a.d <= n.d GROUP BY a.key)
SELECT n.c AS conv_id, n.d AS depth, u.c AS parent_conv_id, n.convs AS n_convs, n.children AS n_children, s.leaves AS n_leaves, s.saved::BIGINT AS saved_tokens, n.ends AS ends_sha256
FROM n JOIN s ON s.key = n.key LEFT JOIN n u ON u.key = n.up
"""
