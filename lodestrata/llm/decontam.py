"""Benchmark decontamination as a prefix-filtered set join, by DataFrame functions alone.

A window is what must be found: `size` consecutive words of an item, or the whole of a shorter item. A document contains a window only if
it contains every word of it, so one necessary word is enough to join on; the words of a window are ordered by how often the documents
have them, and the rarest is that prefix. A match at a place is then bound by position and length (the window must fit into the
document around the word), and the window's words are compared with the document's, all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ascii_lower, drop_stored, stored, table

#: Fixed value: what separates the words of this contract.
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


#: The same separators one by one, less A-Z, which lower() has turned into words.
SEPARATORS = "".join(chr(k) for k in range(128) if not chr(k).isalnum())
ENDS = r"^[\x00-\x2F\x3A-\x60\x7B-\x7F]+|[\x00-\x2F\x3A-\x60\x7B-\x7F]+\z"


def words(text: Column) -> Column:
    """Words of a text, lower-cased A-Z; [''] for a text without words and for null."""
    return F.split(F.regexp_replace(ascii_lower(F.coalesce(text, F.lit(""))), ENDS, ""), BREAK)


def low(text: Column) -> Column:
    """Lower case beyond A-Z as well, which is much cheaper than A-Z alone, and the same of a whole text as of its words: the one letter whose lower case depends on what stands beside it has one form here."""
    return F.replace(F.lower(text), F.lit("\u03c2"), F.lit("\u03c3"))


def low_words(text: Column) -> Column:
    """words() as low() has them, as many of them, and equal wherever words() are."""
    return F.split(F.btrim(low(F.coalesce(text, F.lit(""))), F.lit(SEPARATORS)), BREAK)


def item_windows(benchmark: DataFrame, size: int = 10, item: str = "item_id", text: str = "text") -> DataFrame:
    """(item, window): the distinct windows of each item; items without words have none."""
    rows = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item"), words(F.col(text)).alias("w")).where("w[0] <> ''")
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1)))
    return rows.select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i, size))).alias("window")).distinct()


def find(docs: DataFrame, windows: DataFrame, doc: str = "doc_id", text: str = "text", most_broadcast: int = 100_000) -> DataFrame:
    """(doc, th, start, len, window): every occurrence of a window; th is the hash of the text, which with doc tells rows apart.

    windows: (item, window). Their number is counted first: up to most_broadcast distinct ones (a bound of some 40 MB) the documents are
    streamed past them and nothing of a document is shuffled. Beyond it, words in documents and necessary words are shuffled to meet,
    without the text. Either finds places in lower case beyond A-Z as well; these go back to their documents, where the exact words are
    compared.
    """
    each = windows.select("window").distinct().withColumn("low", F.transform("window", low))
    small = each.count() <= most_broadcast
    hint = F.broadcast if small else (lambda x: x)
    base = docs.select(F.col(doc).alias("doc"), F.xxhash64(text).alias("th"), low_words(F.col(text)).alias("w"))
    # an array of words is never empty; posexplode would have Spark split every text twice, to filter empty ones
    spread = base.select("doc", "th", "w", F.posexplode_outer("w").alias("at", "word"))
    needed = each.select(F.explode("low").alias("word")).distinct()
    counts = stored(spread.select("word").join(hint(needed), "word").groupBy("word").count(), "decontam-words")
    ranked = each.select("window", "low", F.posexplode("low").alias("offset", "word")).join(counts, "word", "left")
    # windows with a word that no document has can't occur; of the others the rarest word is kept, then the first by spelling
    rarest = ranked.groupBy("window", "low").agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("n"), "word", "offset")).alias("r")).where("r.n > 0").select(F.col("r.word").alias("word"), F.col("r.offset").alias("offset"), "window", "low", F.size("window").alias("len"))
    at = F.col("at") - F.col("offset")
    if small:
        fits = (at >= 0) & (at + F.col("len") <= F.size("w"))
        # both ends of a window come before the comparison of all its words
        ends = (F.get("w", at) == F.get("low", F.lit(0))) & (F.get("w", at + F.col("len") - 1) == F.get("low", F.col("len") - 1))
        places = spread.join(F.broadcast(rarest), "word").where(fits & ends & (F.slice("w", at + 1, F.col("len")) == F.col("low")))
    else:
        places = spread.select("doc", "th", "at", F.size("w").alias("n"), "word").join(rarest, "word").where((at >= 0) & (at + F.col("len") <= F.col("n")))
    places = stored(places.select("doc", "th", at.alias("start"), "len", "window").distinct(), "decontam-near")
    wanted = places.select("doc", "th").distinct()
    wanted = (F.broadcast(wanted) if wanted.count() <= most_broadcast else wanted).withColumnsRenamed({"doc": "_doc", "th": "_th"})
    whole = docs.select(F.col(doc).alias("doc"), F.xxhash64(text).alias("th"), F.col(text).alias("text")).join(wanted, F.col("doc").eqNullSafe(F.col("_doc")) & (F.col("th") == F.col("_th")), "left_semi")
    whole = whole.dropDuplicates(["doc", "th"]).select(F.col("doc").alias("_doc"), F.col("th").alias("_th"), words(F.col("text")).alias("w"))
    met = places.join(whole, F.col("doc").eqNullSafe(F.col("_doc")) & (F.col("th") == F.col("_th")))
    found = stored(met.where(F.slice("w", F.col("start") + 1, F.col("len")) == F.col("window")).select("doc", "th", "start", "len", "window"), "decontam-places")
    drop_stored(counts, places)
    return found


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = 10, doc: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", most_broadcast: int = 100_000) -> DataFrame:
    """docs' columns doc and text's hash `th` with n_words, n_hit, n_items, items (sorted strings), one row per different (doc, text) that has a hit.

    A word is hit if an occurrence of a window covers it; occurrences are merged as intervals within a document. Defined results: null or
    empty texts have no words and no hits; an item of fewer words than size is one window, one of none is nothing; null item ids read as
    ''; equal rows of docs share one row here; a null doc_id is an id like others; empty tables give no rows; other columns of either table
    aren't read and can't clash.
    """
    windows = stored(item_windows(benchmark, size, item, item_text), "decontam-windows")
    places = find(docs, windows, doc, text, most_broadcast)
    before = Window.partitionBy("doc", "th").orderBy("start", "len").rowsBetween(Window.unboundedPreceding, -1)  # a document's own places
    stop = F.col("start") + F.col("len")
    spans = places.select("doc", "th", "start", "len").distinct().withColumn("reach", F.max(stop).over(before))
    hit = spans.groupBy("doc", "th").agg(F.sum(F.greatest(F.lit(0), stop - F.greatest("start", F.coalesce("reach", F.lit(0))))).cast("long").alias("n_hit"))
    items = places.select("doc", "th", "window").distinct().join(windows, "window").groupBy("doc", "th").agg(F.sort_array(F.collect_set("item")).alias("items"))
    items = items.withColumnsRenamed({"doc": "_doc", "th": "_th"})
    out = stored(hit.join(items, F.col("doc").eqNullSafe(F.col("_doc")) & (F.col("th") == F.col("_th"))).select("doc", "th", "n_hit", F.size("items").cast("long").alias("n_items"), "items"), "decontam")
    drop_stored(windows, places)
    return out


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate(docs, table(spark, sf_dir, "benchmark"))
    w = low_words(F.col("text"))
    n = F.when(F.get(w, F.lit(0)) == "", 0).otherwise(F.size(w)).cast("long")
    rows = docs.select("doc_id", F.xxhash64("text").alias("_th"), n.alias("n_words"))
    met = rows.join(found, F.col("doc_id").eqNullSafe(F.col("doc")) & (F.col("_th") == F.col("th")), "left")
    hit = F.coalesce("n_hit", F.lit(0))
    return met.select("doc_id", "n_words", hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).alias("n_items"), F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


OP10_SQL = r"""
WITH lowered AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + 9], ' ') AS s FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS i FROM items WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM windows),
places AS (SELECT r, i, n, array_to_string(w[i : i + n - 1], ' ') AS s FROM (SELECT r, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM lowered, lens WHERE len(w) >= n)),
found AS (SELECT r, i, p.n, item_id FROM places p JOIN windows USING (n, s)),
hits AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(generate_series(i, i + n - 1)) AS k FROM found) GROUP BY r),
ids AS (SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS list FROM (SELECT DISTINCT r, coalesce(item_id::VARCHAR, '') AS id FROM found) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM lowered LEFT JOIN hits USING (r) LEFT JOIN ids USING (r)
"""
