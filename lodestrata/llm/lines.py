"""Line dedup as an exact set-similarity join, by DataFrame functions alone.

A line's tokens are its distinct runs of five words (of fewer words: all of them as one). A line goes if an earlier line, in the order of
doc_id and line number, has a Jaccard similarity of at least `similar` with it; lines of the same words have similarity 1.

1. Lines of the same words are one class, which its first line stands for.
2. Screen: of n tokens in any fixed order, the first n - ceil(t n) + l must have l in common with the first ones of a similar line. In
   the order of the tokens' hashes, and with an l that grows with n, this costs one count, and leaves only the classes that share as many
   of those tokens with others; sequences of frequent words that two lines share by chance don't suffice. It settles no line.
3. The join, over what is left: tokens are counted, and a line's are ordered by rarity and hash. A token that no other line has needs no
   row: how many of these a line has says where its others stand, and a line whose prefix they fill has no similar one. Prefixes are
   joined under the length and positional filters, and pairs verified on whole sets.
   A token of many lines isn't joined all with all: each of its lines is compared with the token's first line, which settles the copies of
   one text by one comparison each, then what is still open with the first open line after it, and only what `ROUNDS` of these leave
   open with all earlier lines of the token.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import drop_stored, stored, table

GRAM, ROUNDS = 5, 2
#: One more token must be shared for so many tokens of a line.
SPAN = 16


def low_text(text: Column) -> Column:
    """A text in lower case with all blanks but line ends as spaces. A search of bytes for each kind of blank costs less than one regular expression."""
    low = F.lower(text)
    for blank in "\t\x0b\x0c\r":
        low = F.replace(low, F.lit(blank), F.lit(" "))
    return low


def with_tokens(lines: DataFrame, line: str, *keep: str) -> DataFrame:
    """The columns in keep, h (hash of the words of a line of a low_text()) and t: hashes of the distinct runs of GRAM words (a shorter line is one run). Two different runs have the same hash by a chance of 1 in 2**64.

    The array of words is a variable of an outer lambda, so it is neither copied into a row between steps nor looked up in it once a word.
    """

    def parts(w: Column) -> Column:
        runs = F.transform(w, lambda x, i: F.xxhash64(x, *(F.get(w, i + k) for k in range(1, GRAM))))  # nulls past the end leave a hash as it is
        return F.struct(F.xxhash64(w).alias("h"), F.slice(runs, F.lit(1), F.greatest(F.size(w) - GRAM + 1, F.lit(1))).alias("r"))

    words = F.array(F.array_remove(F.split(F.col(line), " "), ""))
    runs = lines.select(*keep, F.get(F.transform(words, parts), F.lit(0)).alias("s")).select(*keep, "s.h", "s.r")  # read more than once, so not made anew for each
    return runs.select(*keep, "h", F.when(F.size("r") > 1, F.array_distinct("r")).otherwise(F.col("r")).alias("t"))


def prefix_size(n: Column, percent: int) -> Column:
    """n - ceil(percent n / 100) + 1, in whole numbers."""
    return (n - F.floor((n * percent + 99) / 100) + 1).cast("int")


def shared_at_least(n: Column, percent: int) -> Column:
    """l for a line of n tokens: 1, and one more for every SPAN tokens of the shortest similar line."""
    return 1 + F.floor(F.floor((n * percent + 99) / 100) / SPAN)


def _near(size: int, most: int, df: DataFrame) -> DataFrame:
    """df, to be broadcast where its counted size is within the bound."""
    return F.broadcast(df) if size <= most else df


def removed_lines(docs: DataFrame, doc: str = "doc_id", text: str = "text", percent: int = 75, most_broadcast: int = 1_000_000) -> DataFrame:
    """(doc, th, gone): for each different (doc, text hash) with removed lines, their numbers from 0.

    Counted tables up to most_broadcast rows (of 50 bytes or less) are broadcast, larger ones shuffled. Defined results: null texts
    and lines without words have no tokens, and stay; equal rows of docs are one document for the order, so equal rows lose the same
    lines; ties in doc_id go by the hash of the text; an empty table gives no rows. Other columns of docs aren't read.
    """
    # hashed before the lines are dealt out, or every line would carry its whole text
    whole = docs.select(F.col(doc).alias("doc"), F.xxhash64(text).alias("th"), F.split(low_text(F.coalesce(F.col(text), F.lit(""))), "\n").alias("all"))
    cut = whole.select("doc", "th", F.posexplode_outer("all").alias("at", "line"))  # never empty; posexplode would have Spark split twice, to filter empty ones
    sets = with_tokens(cut.where(F.btrim("line") != ""), "line", "doc", "th", "at")
    more = F.floor(F.size("t") / SPAN).cast("int")  # l - 1, of the line itself: similar lines have at least shared_at_least() in common
    lines = stored(sets.select("doc", "th", "at", "h", F.size("t").alias("n"), F.slice(F.sort_array("t"), F.lit(1), prefix_size(F.size("t"), percent) + more).alias("prefix")), "lines")
    place = F.struct("doc", "th", "at").alias("place")

    # 1. lines of the same words
    same = stored(lines.groupBy("h").agg(F.min(place).alias("place"), F.count("*").alias("n")).where("n > 1").select("h", "place"), "lines-same")
    known = _near(same.count(), most_broadcast, same.select(F.col("h").alias("_h"), F.col("place").alias("_place")))
    leads = lines.join(known, F.col("h") == F.col("_h"), "left").where(F.col("_h").isNull() | place.eqNullSafe(F.col("_place")))

    # 2. the screen
    # dealt out once, for the tokens of two different lines and for the lines that have these: both read all columns, or Spark would shuffle twice
    tokens = leads.select("h", "n", F.explode("prefix").alias("token")).repartition("token")
    shared = tokens.groupBy("token").agg(F.min("h").alias("a"), F.max("h").alias("b"), F.max("n").alias("most")).where("a < b AND most > 0").select("token")
    near = tokens.join(shared.hint("shuffle_hash"), "token", "left_semi")  # shared grows with the input: one row a token, so only it is hashed and nothing sorted
    near = stored(near.groupBy("h", "n").count().where(F.col("count") >= shared_at_least(F.col("n"), percent)).select("h"), "lines-near")  # repeated rows of docs count more than once, which loses nothing
    wanted = leads.select("doc", "th", "at", "h").join(_near(near.count(), most_broadcast, near), "h", "left_semi")
    wanted = stored(wanted.groupBy("doc", "th").agg(F.collect_set("at").alias("ats")), "lines-wanted")
    own = docs.select(F.col(doc).alias("_doc"), F.xxhash64(text).alias("_th"), F.col(text).alias("_text")).join(_near(wanted.count(), most_broadcast // 2, wanted), F.col("_doc").eqNullSafe(F.col("doc")) & (F.col("_th") == F.col("th")))
    own = own.select("doc", "th", "ats", F.split(low_text(F.col("_text")), "\n").alias("all")).select("doc", "th", "all", F.explode("ats").alias("at")).select(place, F.get("all", F.col("at")).alias("line"))
    full = stored(with_tokens(own, "line", "place").dropDuplicates(["h"]), "lines-full")

    # 3. the join by rarity
    each = full.select("h", F.size("t").alias("n"), F.explode("t").alias("token")).repartition("token")  # dealt out once, as above
    dup = each.groupBy("token").agg(F.count("*").alias("c"), F.min("h").alias("a"), F.max("h").alias("b"), F.max("n").alias("most")).where("a < b AND most > 0").select("token", "c")
    own = Window.partitionBy("h")  # a line's own tokens
    held = each.join(dup.hint("shuffle_hash"), "token").select("h", "n", "token", F.row_number().over(own.orderBy("c", "token")).alias("k"), F.count("*").over(own).alias("held"))
    held = held.withColumn("pos", (F.col("n") - F.col("held") + F.col("k") - 1).cast("int"))  # tokens that only this line has are the rarest of all, and come first
    held = held.where(F.col("pos") < prefix_size(F.col("n"), percent))
    met = stored(held.join(full.select("h", "place"), "h").select("h", "place", "n", "pos", "token"), "lines-prefixes")

    least = F.floor(((F.col("n") + F.col("n2")) * percent + (99 + percent)) / (100 + percent))  # the overlap that the similarity needs
    # no token before a pair's first shared one is shared, so what follows it in the shorter rest must suffice
    fits = (F.least("n", "n2") * 100 >= F.greatest("n", "n2") * percent) & (F.least(F.col("n") - F.col("pos"), F.col("n2") - F.col("pos2")) >= least)

    def verified(pairs: DataFrame, tag: str) -> DataFrame:
        """h of the lines that an earlier one matches."""
        a, b = full.select("h", F.col("t").alias("t1")), full.select(F.col("h").alias("h2"), F.col("t").alias("t2"))
        both = pairs.select("h", "h2").distinct().join(a, "h").join(b, "h2").withColumn("both", F.size(F.array_intersect("t1", "t2")))
        return stored(both.where(F.col("both") * 100 >= (F.size("t1") + F.size("t2") - F.col("both")) * percent).select("h").distinct(), tag)

    def heads(rows: DataFrame) -> DataFrame:
        """The first line of each token."""
        first = rows.groupBy("token").agg(F.min(F.struct("place", "h", "n", "pos")).alias("o"), F.count("*").alias("c")).where("c > 1")
        return first.select("token", F.col("o.h").alias("h2"), F.col("o.n").alias("n2"), F.col("o.pos").alias("pos2"), F.col("o.place").alias("place2"))

    first = stored(heads(met), "lines-heads")
    n_first = first.count()
    left = group = stored(met.join(_near(n_first, most_broadcast, first.select("token")), "token", "left_semi"), "lines-groups")
    settled, spent = [], [group]
    for k in range(ROUNDS):
        first = first if k == 0 else stored(heads(left), f"lines-heads{k}")
        n_first = n_first if k == 0 else first.count()
        after = left.join(_near(n_first, most_broadcast // 2, first), "token").where(F.col("place2") < F.col("place"))
        found = verified(after.where(fits), f"lines-settled{k}")
        settled.append(found)
        # the first line of a token has no earlier one there; the others stay open there until a match is found, the first open one too: before it are settled lines
        still = after.select(*group.columns) if k == 0 else left
        left = stored(still.join(_near(found.count(), most_broadcast, found), "h", "left_anti").select(*group.columns), f"lines-left{k}")
        spent += [first, left]
    earlier = group.select("token", F.col("h").alias("h2"), F.col("n").alias("n2"), F.col("pos").alias("pos2"), F.col("place").alias("place2"))
    settled.append(verified(left.join(earlier, "token").where((F.col("place2") < F.col("place")) & fits), "lines-late"))

    gone = same
    for part in settled:
        gone = gone.unionByName(part.select("h", F.lit(None).cast(same.schema["place"].dataType).alias("place")))
    gone = stored(gone.groupBy("h").agg(F.max(F.col("place").isNull()).alias("whole"), F.max("place").alias("first")), "lines-gone")
    hit = lines.select("doc", "th", "at", "h").join(_near(gone.count(), most_broadcast, gone), "h").where(F.col("whole") | ~F.struct("doc", "th", "at").eqNullSafe(F.col("first")))
    out = stored(hit.groupBy("doc", "th").agg(F.sort_array(F.collect_set("at")).alias("gone")), "lines-out")
    drop_stored(lines, same, near, wanted, full, met, gone, *settled, *spent)
    return out


def dedup_lines(docs: DataFrame, doc: str = "doc_id", text: str = "text", percent: int = 75, most_broadcast: int = 1_000_000) -> DataFrame:
    """docs with the text that is left, and line_count and lines_removed (long).

    Defined results: null text stays null with no line; a document may be left with no line at all (empty text); input columns called
    line_count or lines_removed are replaced in their place, all others stay as they are, whatever their names.
    """
    gone = removed_lines(docs, doc, text, percent, most_broadcast)
    gone = _near(gone.count(), most_broadcast // 4, gone)
    # the columns of docs travel as one, so none of their names can clash
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(doc).alias("own"), F.xxhash64(text).alias("hash"))
    met = rows.join(gone, F.col("own").eqNullSafe(F.col("doc")) & (F.col("hash") == F.col("th")), "left")
    said = F.col("row")[text]
    new = {
        text: F.when(F.col("gone").isNull(), said).otherwise(F.array_join(F.filter(F.split(said, "\n"), lambda x, i: ~F.array_contains("gone", i)), "\n")),
        "line_count": F.when(said.isNull(), 0).otherwise(F.octet_length(said) - F.octet_length(F.replace(said, F.lit("\n"), F.lit(""))) + 1).cast("long"),
        "lines_removed": F.coalesce(F.size("gone"), F.lit(0)).cast("long"),
    }
    names = [*docs.columns, *(c for c in ("line_count", "lines_removed") if c not in docs.columns)]
    return met.select(*(new.get(c, F.col("row")[c]).alias(c) for c in names))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", F.col("line_count").alias("n_lines"), F.col("lines_removed").alias("n_removed"), F.coalesce("text", F.lit("")).alias("text"))


OP7_SQL = r"""
WITH l AS (SELECT doc_id, i, s, regexp_extract_all(lower(s), '[^\x20\x09-\x0D]+') AS w
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS s, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)),
k AS (SELECT *, array_to_string(w, ' ') AS words FROM l WHERE len(w) > 0),
c AS (SELECT words, any_value(w) AS w, min((doc_id, i)) AS place FROM k GROUP BY words),
n AS (SELECT words, place, row_number() OVER () AS id, list_distinct(CASE WHEN len(w) < 5 THEN [words] ELSE [array_to_string(w[j : j + 4], ' ') FOR j IN range(1, len(w) - 3)] END) AS t FROM c),
t AS (SELECT id, place, len(t) AS n, unnest(t) AS t FROM n),
m AS (SELECT a.id, b.id AS id2, a.n AS n, b.n AS n2, count(*) AS met FROM t a JOIN t b ON a.t = b.t AND b.place < a.place GROUP BY ALL),
g AS (SELECT DISTINCT words FROM m JOIN n USING (id) WHERE 100 * met >= 75 * (m.n + m.n2 - met)),
f AS (SELECT l.doc_id, l.i, l.s, NOT (len(l.w) = 0 OR ((l.doc_id, l.i) = c.place AND g.words IS NULL)) AS gone
  FROM l LEFT JOIN c ON c.words = array_to_string(l.w, ' ') AND len(l.w) > 0 LEFT JOIN g ON g.words = c.words)
SELECT d.doc_id, count(f.i)::BIGINT AS n_lines, coalesce(count(*) FILTER (WHERE f.gone), 0)::BIGINT AS n_removed, coalesce(string_agg(f.s, chr(10) ORDER BY f.i) FILTER (WHERE NOT f.gone), '') AS text
FROM documents d LEFT JOIN f USING (doc_id) GROUP BY d.doc_id
"""
